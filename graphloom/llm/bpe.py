"""Byte-level BPE by rank files, encoding and decoding.

A text is split by the pattern that belongs to the ranks, and each match is merged by itself: the adjacent
pair whose joined bytes have the lowest rank goes first, the leftmost of equals.  Pairs wait in a queue
of one bucket a rank.  A hierarchical bitmap (one bit a rank, one bit a word of 64 ranks, one bit a word of
those) marks the buckets in use, so that find-first-set on three words gives the next rank however long the
match is.  The parts of a match are a doubly linked list over byte positions; a queue entry is a position,
and an entry whose pair has changed since it was queued is skipped when it comes up.

A merge costs a constant number of steps but for the heap of its own bucket, so a match of a million
bytes (one very long word, a run of one character) is merged in about linear time.  Matches of up to
CACHED bytes are kept in a bounded cache of the worker process.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_input

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Most entries of the cache, which is emptied when full, and most bytes of a match that it keeps.
CACHE_ENTRIES, CACHED = 600_000, 64
#: Texts of more characters are split a block of matches at a time; ids decoded at a time; bytes of results that make a batch.
LONG, BLOCK, BATCH_BYTES = 1 << 20, 1 << 16, 8 << 20


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merger:
    """Merges one match at a time.

    The queue: `buckets` holds positions by rank, leftmost first; `low` has a bit for each bucket in use, `mid` a bit for
    each word of `low` and `top` a bit for each word of `mid`.  It is empty between matches and is used again.
    Its steps stand in the loop itself, since calls would double the time of a merge.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)

    def ids(self, match: bytes) -> list[int]:
        rank_of, buckets, low, mid, top = self.ranks.get, self.buckets, self.low, self.mid, 0
        whole = rank_of(match)
        if whole is not None:
            return [whole]
        n = len(match)
        # The parts are a linked list over their first positions; the last two entries stand beyond the end.
        after, before = [*range(1, n + 2)], [*range(-1, n)]
        # The rank of the part at a position joined with the next one; None: there is none, or no part starts here.
        pair = [rank_of(match[at : at + 2]) for at in range(n - 1)]
        pair += (None, None)
        fresh = [(rank, at) for at, rank in enumerate(pair) if rank is not None]
        while True:
            for rank, at in fresh:
                bucket = buckets[rank]
                if bucket:
                    heappush(bucket, at)
                else:
                    bucket.append(at)
                    word = rank >> 6
                    low[word] |= 1 << (rank & 63)
                    mid[word >> 6] |= 1 << (word & 63)
                    top |= 1 << (word >> 6)
            fresh = []
            if not top:
                break
            # Find first set, from the top: the next rank.
            i = (top & -top).bit_length() - 1
            bits = mid[i]
            word = i << 6 | (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = word << 6 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket.pop()
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    mid[i] = bits = mid[i] & (mid[i] - 1)
                    if not bits:
                        top &= top - 1
            if pair[at] != rank:  # stale
                continue
            gone = after[at]
            end = after[at] = after[gone]
            before[end], pair[at], pair[gone] = at, None, None
            if end < n:
                pair[at] = rank = rank_of(match[at : after[end]])
                if rank is not None:
                    fresh.append((rank, at))
            left = before[at]
            if left >= 0:
                pair[left] = rank = rank_of(match[left:end])
                if rank is not None:
                    fresh.append((rank, left))
        out, at = [], 0
        while at < n:
            out.append(rank_of(match[at : after[at]]))
            at = after[at]
        return out


class Codec:
    """Texts to ids and back, with the ids of short matches in a bounded cache, as bytes."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES):
        import regex

        ranks = read_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the single bytes {missing}")
        merge = Merger(ranks).ids

        class Known(dict):
            def __missing__(self, match):
                raw = match.encode()
                ids = array("i", merge(raw)).tobytes()
                if len(raw) <= CACHED:
                    if len(self) >= entries:
                        self.clear()
                    self[match] = ids
                return ids

        self.ids_of, self.pattern = Known().__getitem__, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimals = {rank: b"%d" % rank for rank in self.tokens}

    def matches(self, text: str) -> Iterator[list[str]]:
        """The matches of a text in lists, a bounded number at a time for long texts."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while block := [m.group() for m in islice(found, BLOCK)]:
            yield block

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as 32-bit integers."""
        return np.frombuffer(b"".join([b"".join(map(self.ids_of, block)) for block in self.matches(text)]), np.intc)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, in blocks.  An id outside the ranks raises KeyError."""
        for i in range(0, len(ids), BLOCK):
            yield b"".join(map(self.tokens.__getitem__, ids[i : i + BLOCK].tolist()))

    def listed(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decimal ids joined by commas, in blocks."""
        for i in range(0, len(ids), BLOCK):
            yield (b"," if i else b"") + b",".join(map(self.decimals.__getitem__, ids[i : i + BLOCK].tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker process: pickled functions bring no globals of their own, so it hangs on a module that outlives a task."""
    held = sys.modules.setdefault("_graphloom_worker", types.ModuleType("_graphloom_worker")).__dict__
    key = ("bpe", path, pattern)
    if key not in held:
        held[key] = Codec(path, pattern)
    return held[key]


def _batches(rows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(bytes, row) pairs as record batches of about BATCH_BYTES."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row's whole text, without special tokens.

    Null and empty texts have no ids; null and repeated ids and repeated rows stay as they are; an empty table
    gives no rows; other columns of docs are never read.  There are no ties: the leftmost of equal ranks goes first.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(batches):
        use = codec(path, pattern)
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                ids = use.encode(t.as_py() or "")
                yield 4 * len(ids) + 16, (i.as_py(), ids)

    return text_input(docs).mapInArrow(lambda batches: _batches(rows(batches), schema), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded (binary): the bytes that each row's ids stand for; null ids are none.  An id outside the ranks raises."""
    path, pattern = path or ranks_path(), split_pattern()
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def rows(batches):
        use = codec(path, pattern)
        for b in batches:
            for i, ids in zip(b.column(0), b.column(1)):
                raw = b"".join(use.decode(_numbers(ids)))
                yield len(raw) + 16, (i.as_py(), raw)

    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _batches(rows(batches), schema), "doc_id long, decoded binary")


def _numbers(ids: pa.Scalar) -> np.ndarray:
    return ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)


def round_trip_digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows: SHA-256 of the decimal ids joined by commas, and of the bytes that decoding gives, both taken block by block."""
    path, pattern = path or ranks_path(), split_pattern()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(batches):
        use = codec(path, pattern)
        for b in batches:
            for i, found in zip(b.column(0), b.column(1)):
                ids, listed, raw = _numbers(found), hashlib.sha256(), hashlib.sha256()
                for part in use.listed(ids):
                    listed.update(part)
                for part in use.decode(ids):
                    raw.update(part)
                yield 256, (i.as_py(), len(ids), listed.hexdigest(), raw.hexdigest())

    return encoded.select("doc_id", "ids").mapInArrow(
        lambda batches: _batches(rows(batches), schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(encode_documents(table(spark, sf_dir, "documents")))
