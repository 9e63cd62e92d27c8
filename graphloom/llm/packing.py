"""Hierarchical multi-length packing of token ids into training sequences.

A document longer than the window gives whole windows of its own.  What remains is routed
to the smallest tier (a power of two) that holds it.  Each task packs its tiers from
the longest down: a document opens a window of its tier, and documents of shorter
tiers fill the gap, the last of them cut to end exactly at the window's end.  Every
window so filled is a power of two long and carries no padding.  What is left at a
task's end, less than one window, is cut by powers of two as well.  Sequences are dealt to step
groups in serpentine order of their attention cost, so groups do alike work.

The operator is narrow: no shuffle, memory bounded by `hold` waiting documents a tier
plus one input batch.
"""

from __future__ import annotations

import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, table, text_input
from .tokens import tokenizer_path, word_encoder

WINDOW, END_ID, TIERS, GROUP, HOLD = 2048, 1, (2048, 1024, 512, 256), 64, 4096
#: Most words that a worker keeps with their ids.
CACHED = 150_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long, tier int, step_group long"


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


class Packer:
    """Packs the documents of one task.  add() takes (key, n tokens); sequences() gives lists of (key, start, length)."""

    def __init__(self, tiers=TIERS, hold: int = HOLD):
        self.tiers, self.hold = tuple(sorted(tiers, reverse=True)), hold
        self.window = self.tiers[0]
        self.waiting = {t: deque() for t in self.tiers}
        self.done: list[list[tuple[object, int, int]]] = []

    def add(self, key, n: int) -> None:
        at = 0
        while n - at >= self.window:
            self.done.append([(key, at, self.window)])
            at += self.window
        if at < n:
            self._route(key, at, n - at)
            if len(self.waiting[self._tier(n - at)]) >= self.hold:
                self.pack()

    def _tier(self, n: int) -> int:
        return min(t for t in self.tiers if t >= n)

    def _route(self, key, start: int, n: int) -> None:
        self.waiting[self._tier(n)].append((key, start, n))

    def _fill(self, tier: int, pieces: list, room: int) -> int:
        """Fills a window's room from the tiers below (or its own): whole documents while they fit, then one that is cut."""
        while room:
            source = next((t for t in self.tiers if t <= max(room, self.tiers[-1]) and t <= tier and self.waiting[t]), None) or next((t for t in reversed(self.tiers) if self.waiting[t]), None)
            if source is None:
                return room
            key, start, n = self.waiting[source].popleft()
            take = min(n, room)
            pieces.append((key, start, take))
            room -= take
            if take < n:
                self._route(key, start + take, n - take)
        return 0

    def pack(self) -> None:
        """Packs every full window that the waiting documents give, the longest tier first."""
        for tier in self.tiers:
            while self.waiting[tier] and self._total() >= tier:
                pieces = [self.waiting[tier].popleft()]
                self._fill(tier, pieces, tier - pieces[0][2])
                self.done.append(pieces)

    def _total(self) -> int:
        total = 0
        for q in self.waiting.values():
            for _, _, n in q:
                total += n
                if total >= self.window:
                    return total
        return total

    def finish(self) -> None:
        self.pack()
        rest = self._total()
        while rest:
            size = 1 << (rest.bit_length() - 1)
            pieces: list = []
            self._fill(self.window, pieces, size)
            self.done.append(pieces)
            rest -= size

    def sequences(self):
        out, self.done = self.done, []
        return out


def step_groups(costs: list[int], group: int = GROUP) -> list[int]:
    """A group number for each sequence: in order of cost, dealt back and forth over the groups."""
    groups = max(1, -(-len(costs) // group))
    order = sorted(range(len(costs)), key=lambda i: (-costs[i], i))
    out = [0] * len(costs)
    for rank, i in enumerate(order):
        lap, at = divmod(rank, groups)
        out[i] = at if lap % 2 == 0 else groups - 1 - at
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tiers=TIERS, group: int = GROUP, hold: int = HOLD) -> DataFrame:
    """One row for each piece of each document.

    Null or empty texts give the end id alone; null, repeated or tied doc_ids are packed row by row like any other.
    An empty table gives no rows.  Columns besides doc_id and text are not read.
    sequence_id is the task's number times 2**36 plus a count within the task; a task that is run again gives the same rows.
    """
    modest_batches(docs.sparkSession)
    path, end, window = tokenizer or tokenizer_path(), int(end_id).to_bytes(4, "little"), max(tiers)

    def run(batches):
        from pyspark import TaskContext

        encode, packer = word_encoder(path, CACHED), Packer(tiers, hold)
        base = TaskContext.get().partitionId() << 36
        held: dict = {}  # key -> [doc_id, ids, tokens not yet given out]
        rows = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens", "tier", "step_group")}
        count = groups = key = 0

        def emit(final: bool):
            nonlocal count, groups
            done = packer.sequences()
            if not done:
                return
            steps = step_groups([sum(n * n for _, _, n in s) for s in done], group)
            for s, step in zip(done, steps):
                at, total = 0, sum(n for _, _, n in s)
                padded = total if power_of_two(total) else window
                for k, start, n in s:
                    doc_id, ids, left = held[k]
                    for name, value in zip(rows, (doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + count, at, total, padded, max(s[0][2], padded), base + groups + step)):
                        rows[name].append(value)
                    at += n
                    if left == n:
                        del held[k]
                    else:
                        held[k][2] = left - n
                count += 1
            groups += max(steps) + 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "tier" else pa.int64()) for n, v in rows.items()], names=list(rows))
            for v in rows.values():
                v.clear()
            return out

        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1)
            for doc_id, text in zip(ids_of, texts):
                ids = encode(text.as_py()) + end
                held[key] = [doc_id, ids, len(ids) // 4]
                packer.add(key, len(ids) // 4)
                key += 1
            if len(packer.done) >= 16 * group:
                emit(False)
            if len(rows["doc_id"]) >= 20_000:
                yield flush()
        packer.finish()
        emit(True)
        if rows["doc_id"]:
            yield flush()

    return text_input(docs).mapInArrow(run, SCHEMA)


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
