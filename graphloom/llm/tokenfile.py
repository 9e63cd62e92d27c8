"""Token-id files: an adaptive context-mixing range coder.

Ids are coded in blocks.  A block is reset and checksummed on its own: its models start
empty, and a reader needs nothing before it.  Within a block the ids are laid out in
lanes, each a contiguous run, and one step codes an id of every lane, so numpy does a
step's work for all lanes at once.

Three predictions drive the coder: order 2 and order 1 name the id that last followed
the one or two ids before, with a confidence count each; order 0 is an adaptive
frequency table.  How far each is trusted is learned: the pair of confidences picks a
cell whose counts of "order 2 was right / order 1 was right / neither" give the shares
of the interval.  Models are shared by a block's lanes and updated after each step, by
encoder and decoder alike.  The coder is a carry-less range coder on 64 bits that gives out 16 at a time.

Block layout, little-endian: magic "GLR1", u32 ids, u32 lanes, u32 crc32 of the ids,
u32 words, then for each lane a u32 count of its words, then the words (u16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_input
from .tokens import tokenizer_path, word_encoder

MAGIC, END_ID = b"GLR1", 2
ALPHABET, HASH_BITS, BLOCK_IDS, LANE_IDS = 49_408, 18, 1 << 21, 256
ROW_IDS = 1 << 21
#: An interval is kept above 2**40, so that the rarest id's share of the smallest part of it is never empty.
_TOP, _LEAST, _LOW32 = np.uint64(1 << 48), np.uint64((1 << 40) - 1), np.uint64((1 << 32) - 1)
_U16, _U48 = np.uint64(16), np.uint64(48)


class _Models:
    """What encoder and decoder both know before a step."""

    def __init__(self, lanes: int, alphabet: int, hash_bits: int):
        self.alphabet, self.mask = alphabet, (1 << hash_bits) - 1
        # An entry is an id and, in its low four bits, the confidence in it.
        self.two, self.one = np.zeros(1 << hash_bits, np.int32), np.zeros(alphabet, np.int32)
        cell = np.arange(512)
        self.seen = np.stack([1 + 2 * ((cell >> 4) & 15), 1 + 2 * (cell & 15), np.full(512, 8)], 1).astype(np.float64)
        self.seen[256:, 1] = 0.01
        self.a = self.b = np.zeros(lanes, np.int64)
        self.count, self.waiting, self.step, self.due = np.ones(alphabet, np.int64), [], 0, 1
        self._shares()
        self._table()

    def _shares(self) -> None:
        p = self.seen / self.seen.sum(1, keepdims=True)
        self.w2 = np.clip(p[:, 0] * 65536, 16, 65000).astype(np.uint64)
        self.w1 = np.maximum(16, np.minimum(p[:, 1] * 65536, 65536 - 64 - self.w2.astype(np.float64))).astype(np.uint64)

    def _table(self) -> None:
        self.cum = np.zeros(self.alphabet + 1, np.uint64)
        np.cumsum(self.count, out=self.cum[1:], dtype=np.uint64)
        self.total = self.cum[-1]
        self.cum32 = self.cum[1:].astype(np.uint32)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose part of the order-0 table holds each value."""
        return np.searchsorted(self.cum32, v.astype(np.uint32), side="right")

    def predict(self, n: int):
        """For the first n lanes: the predicted ids and the shares of the interval."""
        self.h = (self.a[:n] * 0x9E5 + self.b[:n] * 0x1F35B) & self.mask
        self.g2, self.g1 = self.two[self.h], self.one[self.b[:n]]
        self.n2, self.n1 = self.g2 & 15, self.g1 & 15
        c2, c1 = self.g2 >> 4, self.g1 >> 4
        self.cell = ((self.n2 << 4) + self.n1 + ((c1 == c2) * np.int32(256))).astype(np.int64)
        return c2, c1, self.w2[self.cell], self.w1[self.cell]

    def update(self, ids: np.ndarray, kind: np.ndarray) -> None:
        n = len(ids)
        self.seen += np.bincount(self.cell * 3 + kind, minlength=1536).reshape(512, 3)
        fresh = ids.astype(np.int32) << 4
        for at, was, sure, entries in ((self.h, self.g2, self.n2, self.two), (self.b[:n], self.g1, self.n1, self.one)):
            wrong = np.where(sure == 0, fresh, was - np.minimum(sure, 2))
            entries[at] = np.where(was - sure == fresh, was + (sure < 15), wrong)
        self.a[:n], self.b[:n] = self.b[:n], ids
        self.waiting.append(ids[kind == 2])
        self.step += 1
        if self.step == self.due:
            self.count += 24 * np.bincount(np.concatenate(self.waiting), minlength=self.alphabet)
            self.waiting.clear()
            self.due = min(2 * self.due, self.due + 32)
            self._table()
        if self.step < 32 or self.step % 8 == 0:
            self._shares()


def _layout(n: int, lane_ids: int) -> tuple[int, int]:
    lanes = max(1, -(-n // lane_ids))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, alphabet: int = ALPHABET, hash_bits: int = HASH_BITS, lane_ids: int = LANE_IDS) -> bytes:
    n = len(ids)
    lanes, steps = _layout(n, lane_ids)
    grid = np.zeros((lanes, steps), np.int32)
    grid.ravel()[:n] = ids
    grid = np.ascontiguousarray(grid.T)
    if n and int(ids.max()) >= alphabet:
        raise ValueError("an id lies outside the alphabet")
    m = _Models(lanes, alphabet, hash_bits)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out_lane, out_word = [], []

    def renorm(at=None):
        """Gives out the settled top words, of all lanes or of those named."""
        lo, sp = (low, span) if at is None else (low[at], span[at])
        settled = (lo ^ (lo + sp)) < _TOP
        go = np.flatnonzero(settled | (sp <= _LEAST))
        while len(go):
            who = go if at is None else at[go]
            lo, sp, fine = lo[go], sp[go], settled[go]
            sp = np.where(fine, sp, (~lo + np.uint64(1)) & _LEAST)
            out_lane.append(who.astype(np.uint16 if lanes <= 65536 else np.uint32))
            out_word.append((lo >> _U48).astype(np.uint16))
            lo, sp = lo << _U16, sp << _U16
            low[who], span[who] = lo, sp
            settled = (lo ^ (lo + sp)) < _TOP
            go, at = np.flatnonzero(settled | (sp <= _LEAST)), who

    for t in range(steps):
        k = lanes if (lanes - 1) * steps + t < n else -(-(n - t) // steps)
        x = grid[t, :k]
        c2, c1, w2, w1 = m.predict(k)
        kind = np.where(c2 == x, 0, np.where(c1 == x, 1, 2))
        r = span[:k] >> _U16
        edge2, edge1 = w2 * r, (w2 + w1) * r
        start, size = np.where(kind == 0, np.uint64(0), edge2), np.where(kind == 0, edge2, edge1 - edge2)
        miss = np.flatnonzero(kind == 2)
        if len(miss):
            y, e = x[miss], edge1[miss]
            r0 = ((r[miss] << _U16) - e) // m.total
            c = m.cum[y]
            start[miss] = e + c * r0
            size[miss] = (m.cum[y + 1] - c) * r0
        low[:k] += start
        span[:k] = size
        renorm(None if k == lanes else np.arange(k))
        m.update(x, kind)
    for shift in (48, 32):  # a value whose low half is zero lies in every interval of 2**32 or more
        if shift == 48:
            low = low + _LOW32
        out_lane.append(np.arange(lanes).astype(np.uint16 if lanes <= 65536 else np.uint32))
        out_word.append(((low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    word = word[np.argsort(lane, kind="stable")]
    counts = np.bincount(lane, minlength=lanes).astype("<u4")
    crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
    return MAGIC + struct.pack("<IIII", n, lanes, crc, len(word)) + counts.tobytes() + word.astype("<u2").tobytes()


def decode_block(data: bytes, at: int = 0, alphabet: int = ALPHABET, hash_bits: int = HASH_BITS, lane_ids: int = LANE_IDS) -> tuple[np.ndarray, int]:
    """The ids of the block at an offset, and where the next block begins.  A wrong checksum raises."""
    if data[at : at + 4] != MAGIC:
        raise ValueError("not a block of ids")
    n, lanes, crc, words = struct.unpack_from("<IIII", data, at + 4)
    at += 20
    counts = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    word = np.concatenate([np.frombuffer(data, "<u2", words, at + 4 * lanes), np.zeros(8, np.uint16)]).astype(np.uint64)
    end = at + 4 * lanes + 2 * words
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.int32)
    m = _Models(lanes, alphabet, hash_bits)
    place = np.concatenate([[0], np.cumsum(counts)[:-1]])
    stop = np.cumsum(counts)
    low, span, code = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(lanes, np.uint64)

    def more(who):
        w = np.where(place[who] < stop[who], word[place[who]], np.uint64(0))
        place[who] += 1
        return w

    everyone = np.arange(lanes)
    for _ in range(4):
        code = (code << _U16) | more(everyone)
        np.minimum(place, len(word) - 1, out=place)

    def renorm(at=None):
        lo, sp = (low, span) if at is None else (low[at], span[at])
        settled = (lo ^ (lo + sp)) < _TOP
        go = np.flatnonzero(settled | (sp <= _LEAST))
        while len(go):
            who = go if at is None else at[go]
            lo, sp, fine = lo[go], sp[go], settled[go]
            sp = np.where(fine, sp, (~lo + np.uint64(1)) & _LEAST)
            p = place[who]
            code[who] = (code[who] << _U16) | np.where(p < stop[who], word[np.minimum(p, len(word) - 1)], np.uint64(0))
            place[who] = p + 1
            lo, sp = lo << _U16, sp << _U16
            low[who], span[who] = lo, sp
            settled = (lo ^ (lo + sp)) < _TOP
            go, at = np.flatnonzero(settled | (sp <= _LEAST)), who

    for t in range(steps):
        k = lanes if (lanes - 1) * steps + t < n else -(-(n - t) // steps)
        c2, c1, w2, w1 = m.predict(k)
        r, v = span[:k] >> _U16, code[:k] - low[:k]
        edge2, edge1 = w2 * r, (w2 + w1) * r
        first = v < edge2
        x = np.where(first, c2, c1)
        start, size = np.where(first, np.uint64(0), edge2), np.where(first, edge2, edge1 - edge2)
        miss = np.flatnonzero(v >= edge1)
        if len(miss):
            e = edge1[miss]
            r0 = ((r[miss] << _U16) - e) // m.total
            y = m.find(np.minimum((v[miss] - e) // r0, m.total - np.uint64(1)))
            c = m.cum[y]
            x[miss] = y
            start[miss] = e + c * r0
            size[miss] = (m.cum[y + 1] - c) * r0
        low[:k] += start
        span[:k] = size
        renorm(None if k == lanes else np.arange(k))
        m.update(x, np.where(c2 == x, 0, np.where(c1 == x, 1, 2)))
        grid[t, :k] = x
    ids = np.ascontiguousarray(grid.T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block of ids is damaged")
    return ids, end


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes every text and writes its ids in ascending doc_id order to the shared folder; returns the files' rows.

    A row holds consecutive whole documents: their ids and token counts, the place of its first token in its part, and its blocks.
    Files are ordered: part p holds smaller doc_ids than part p + 1.  Null doc_ids come first, ties in the order of their texts.
    Null or empty texts give the end id alone.
    """
    path, end = tokenizer or tokenizer_path(), int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encode, part = word_encoder(path), TaskContext.get().partitionId()
        names, sizes, parts, held, before = [], [], [], 0, 0

        def row():
            nonlocal held, before
            ids = np.frombuffer(b"".join(parts), "<u4")
            # Blocks of even length, so that none is a sliver.
            k = max(1, -(-len(ids) // BLOCK_IDS))
            blocks = b"".join(encode_block(x) for x in np.array_split(ids, k))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([blocks], pa.binary())],
                names=["part", "first", "n_ids", "doc_ids", "doc_tokens", "blocks"],
            )
            before += len(ids)
            held = 0
            names.clear(), sizes.clear(), parts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py()) + end
                names.append(doc_id), sizes.append(len(ids) // 4), parts.append(ids)
                held += len(ids) // 4
                if held >= ROW_IDS:
                    yield row()
        if names:
            yield row()

    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = text_input(docs).repartitionByRange(parts, keys[0], F.xxhash64("text")).sortWithinPartitions(keys[0], F.xxhash64("text"))
    return stored(ordered.mapInArrow(run, "part int, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, blocks binary"), codec="uncompressed")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    spark = files.sparkSession
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each shuffle partition at most
    starts, total = [], 0
    for part, n in sorted(per_part):
        starts.append((part, total))
        total += n
    at = F.broadcast(spark.createDataFrame(starts, "part int, _start long"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                first, names, sizes, data = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()
                start, crcs, starts, place, ids, used = first, [], [], 0, np.zeros(0, "<u4"), 0
                for n in sizes:
                    crc, left = 0, n
                    while left:
                        if used == len(ids):
                            ids, place = decode_block(data, place)
                            used = 0
                        take = ids[used : used + left]
                        crc = zlib.crc32(take.tobytes(), crc)
                        used += len(take)
                        left -= len(take)
                    crcs.append(crc), starts.append(start)
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.join(at, "part").select((F.col("first") + F.col("_start")).alias("first"), "doc_ids", "doc_tokens", "blocks")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
