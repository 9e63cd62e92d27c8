"""Duplicates: pairs, thresholds, merge plans, components."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import cosine
from ..storage import discard, shared_folder, written  # noqa: F401
from .graph import undirected
from .vector import pairs_among, similar_pairs

#: Parts that class_percentiles cuts a range into; a power of two, so that cuts are exact.
BINS = 1 << 14
#: Characters and texts of a block that near_groups() compares with another, about.
BLOCK_CHARS, BLOCK_TEXTS = 2_000_000, 2_000


def near_duplicates(memories: DataFrame, related: DataFrame, least: float = P.NEAR_DUP_SIMILARITY, limit: int | None = P.NEAR_DUP_LIMIT) -> DataFrame:
    """Linked pairs (a < b, once each) of nodes whose cosine is `least` or more; similarity to four places."""
    v = memories.select("id", "embedding").where("embedding is not null")
    pairs = undirected(related).join(v.select(F.col("id").alias("a"), F.col("embedding").alias("ea")), "a").join(v.select(F.col("id").alias("b"), F.col("embedding").alias("eb")), "b")
    hit = pairs.withColumn("_s", cosine("ea", "eb")).where(F.col("_s") >= least).select("a", "b", F.round("_s", 4).alias("similarity"))
    return hit if limit is None else hit.orderBy(F.desc("similarity"), "a", "b").limit(limit)


def close_pairs(nodes: DataFrame, most: float = P.THREAT_DISTANCE) -> DataFrame:
    """(a, b, distance), a < b, of all nodes within the distance."""

    def near(x, y):
        def strip(rows, s, own):
            hit = s >= 1 - most
            i, j = np.nonzero(hit if own is None else hit & own)
            a, b = x.column("id").take(pa.array(i + rows.start)), y.column("id").take(pa.array(j))
            first = pc.less(a, b)
            return pa.table({"a": pc.if_else(first, a, b), "b": pc.if_else(first, b, a), "distance": 1 - s[i, j]})

        return strip

    kind = dict(nodes.dtypes)["id"]
    return pairs_among(nodes.select("id", "embedding"), near, f"a {kind}, b {kind}, distance double")


def close_links(nodes: DataFrame, most: float = P.THREAT_DISTANCE, apart: bool = False) -> DataFrame:
    """(a, b, pairs): links of nodes within the distance that join all those that close_pairs() does, directly or by others, and no more.

    Of two blocks' pairs only a forest leaves the task, a link for each node at most, however many pairs there are.  On rows without a link `pairs` is how
    many pairs of a strip lie within the distance, on the others null.  With `apart` pairs whose `tags` share an entry don't count.
    """

    def near(x, y):
        shared = _classes(x, y, "tag-overlap", ()) if apart else None
        root = np.arange(x.num_rows + y.num_rows)

        def strip(rows, s, own):
            hit = s >= 1 - most
            if own is not None:
                hit &= own
            if apart:
                hit &= shared(rows, None) == 0
            theirs = root[: y.num_rows] if own is not None else root[x.num_rows :]
            n, i, j = hit.sum(1), [], []
            for r in np.flatnonzero(n):
                me = rows.start + r
                at = np.flatnonzero(hit[r])
                at = at[theirs[at] != root[me]]
                if len(at):
                    new, first = np.unique(theirs[at], return_index=True)
                    i += [me] * len(new)
                    j += at[first].tolist()
                    gone = np.zeros(len(root), bool)
                    gone[new] = True
                    root[gone[root]] = root[me]
            a, b = x.column("id").take(pa.array(i, pa.int64())).combine_chunks(), y.column("id").take(pa.array(j, pa.int64())).combine_chunks()
            links = pa.table({"a": a, "b": b, "pairs": pa.nulls(len(i), pa.int64())})
            return pa.concat_tables([links, pa.table({"a": pa.nulls(1, a.type), "b": pa.nulls(1, b.type), "pairs": pa.array([int(n.sum())], pa.int64())})])

        return strip

    kind = dict(nodes.dtypes)["id"]
    return pairs_among(nodes.select("id", "embedding", *(["tags"] if apart else [])), near, f"a {kind}, b {kind}, pairs long")


def linked_similarity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cosine of each edge's two ends."""
    v = nodes.select("id", "embedding")
    e = edges.join(v.select(F.col("id").alias("src"), F.col("embedding").alias("ea")), "src").join(v.select(F.col("id").alias("dst"), F.col("embedding").alias("eb")), "dst")
    return e.select("src", "dst", cosine("ea", "eb").alias("similarity"))


def pair_plan(nodes: DataFrame, plan: list[tuple[str, tuple[str, ...], str, tuple[str, ...]]], least: float = P.FRAMEWORK_SIMILARITY) -> DataFrame:
    """Similarity edges for each (source prefix, levels, target prefix, levels) of a plan, in one table."""
    out = None
    for sp, sl, tp, tl in plan:
        a = nodes.where(F.col("id").startswith(sp) & F.col("level").isin(*sl))
        b = nodes.where(F.col("id").startswith(tp) & F.col("level").isin(*tl))
        e = similar_pairs(a, b, least).withColumn("pair", F.lit(f"{sp}>{tp}"))
        out = e if out is None else out.unionByName(e)
    return out


def pair_distances(threats: DataFrame, mode: str = "tag-overlap", dominant: tuple[str, ...] = ()) -> DataFrame:
    """(class, distance) of every pair of threats with vectors of some length."""

    def each(x, y):
        classes = _classes(x, y, mode, dominant)

        def strip(rows, s, own):
            c = classes(rows, own)
            at = c >= 0
            return pa.table({"class": pc.if_else(pa.array(c[at] == 1), "within", "between"), "distance": 1 - s[at]})

        return strip

    return pairs_among(threats.select("id", "embedding", "tags"), each, "class string, distance double")


def _marks(t: pa.Table, mode: str, dominant: tuple[str, ...]) -> np.ndarray | dict:
    """Of a table's tags what decides the class of a pair: the rows of each tag, or each row's only dominant tag by its number (-1: none or several)."""
    tags = [set(x or ()) - {None} for x in t.column("tags").to_pylist()]
    if mode != "tag-overlap":
        own = [[i for i, d in enumerate(dominant) if d in x] for x in tags]
        return np.array([o[0] if len(o) == 1 else -1 for o in own], np.int64)
    rows: dict = {}
    for i, x in enumerate(tags):
        for tag in x:
            rows.setdefault(tag, []).append(i)
    return {tag: np.array(at) for tag, at in rows.items()}


def _classes(x: pa.Table, y: pa.Table, mode: str, dominant: tuple[str, ...]):
    """A function of rows of x, and of the pairs that count, to the classes of their pairs with y: 1 (within), 0 (between) or -1 (not counted)."""
    a, b = _marks(x, mode, dominant), _marks(y, mode, dominant)

    def of(rows: slice, own: np.ndarray | None) -> np.ndarray:
        out = np.zeros((rows.stop - rows.start, y.num_rows), np.int8)
        if mode == "tag-overlap":
            for tag in a.keys() & b.keys():
                at = a[tag][np.searchsorted(a[tag], rows.start) : np.searchsorted(a[tag], rows.stop)] - rows.start
                out[np.ix_(at, b[tag])] = 1
        else:
            out[a[rows, None] == b] = 1
            out[(a[rows, None] < 0) | (b < 0)] = -1
        if own is not None:
            out[~own] = -1
        return out

    return of


def class_sums(threats: DataFrame, mode: str = "tag-overlap", dominant: tuple[str, ...] = ()) -> DataFrame:
    """(class, pairs, mean_distance) over pair_distances(), summed where the pairs are made: two rows leave each strip of them."""

    def sums(x, y):
        classes = _classes(x, y, mode, dominant)

        def strip(rows, s, own):
            c = classes(rows, own)
            d = [(1 - s)[c == k] for k in (1, 0)]
            return pa.table({"class": ["within", "between"], "n": pa.array([len(v) for v in d], pa.int64()), "total": [float(v.sum()) for v in d]})

        return strip

    found = pairs_among(threats.select("id", "embedding", "tags"), sums, "class string, n long, total double").where("n > 0")
    return found.groupBy("class").agg(F.sum("n").alias("pairs"), (F.sum("total") / F.sum("n")).alias("mean_distance"))


def _counted(threats: DataFrame, mode: str, dominant: tuple[str, ...], ranges: list[tuple[int, float, float]]) -> dict[tuple[int, int], int]:
    """How many distances of a class lie in each of BINS parts of the ranges (class, low, width), by range and part."""

    def count(x, y):
        classes = _classes(x, y, mode, dominant)

        def strip(rows, s, own):
            c, d = classes(rows, own), np.maximum(1 - s, 0.0)
            out = []
            for r, (k, low, width) in enumerate(ranges):
                v = d[(c == k) & (d >= low) & (d < low + width)]
                n = np.bincount(((v - low) * (BINS / width)).astype(np.int64))
                hit = np.flatnonzero(n)
                out.append(pa.table({"at": np.full(len(hit), r, np.int64), "part": hit, "n": n[hit]}))
            return pa.concat_tables(out)

        return strip

    found = pairs_among(threats.select("id", "embedding", "tags"), count, "at long, part long, n long")
    return {(r["at"], r["part"]): r["n"] for r in found.groupBy("at", "part").agg(F.sum("n").alias("n")).collect()}  # BINS a range at most


def class_percentiles(threats: DataFrame, wanted: dict[str, float], mode: str = "tag-overlap", dominant: tuple[str, ...] = ()) -> dict[str, float | None]:
    """The percentile of the distances of each class named (within, between), with linear interpolation; None for a class without pairs.

    No pair leaves the tasks that make it: each round counts the distances in parts of the ranges that hold the two values to interpolate
    between, and the next one takes those parts as ranges, until they are narrower than 1e-12.
    """
    numbers = {"within": 1, "between": 0}
    ranges = [(numbers[c], 0.0, 4.0) for c in wanted]
    first, out = _counted(threats, mode, dominant, ranges), {}
    places = []  # class, rank within the range, low, width
    for r, (c, p) in enumerate(wanted.items()):
        n = sum(k for (at, _), k in first.items() if at == r)
        if n:
            at = p * (n - 1)
            places += [[c, math.floor(at), 0.0, 4.0, at], [c, math.ceil(at), 0.0, 4.0, at]]
        else:
            out[c] = None
    counts = first
    while places:
        for place in places:
            c, rank, low, width, _ = place
            r = ranges.index((numbers[c], low, width))
            parts = sorted((part, k) for (at, part), k in counts.items() if at == r)
            for part, k in parts:
                if rank < k or part == parts[-1][0]:
                    break
                rank -= k
            place[1:4] = rank, low + part * (width / BINS), width / BINS
        if places[0][3] < 1e-12:
            break
        ranges = list(dict.fromkeys((numbers[c], low, width) for c, _, low, width, _ in places))
        counts = _counted(threats, mode, dominant, ranges)
    for (c, _, low, _, at), (_, _, high, _, _) in zip(places[::2], places[1::2]):
        out[c] = low + (high - low) * (at - math.floor(at))
    return out


def recommended(threats: DataFrame, mode: str = "tag-overlap", dominant: tuple[str, ...] = (), **bounds) -> DataFrame:
    """recommend() of pair_distances(), without making a table of the pairs."""
    found = class_percentiles(threats, {"within": 0.9, "between": 0.1}, mode, dominant)
    row = threats.sparkSession.range(1).select(*[F.lit(found[c]).cast("double").alias(name) for c, name in (("within", "within_p90"), ("between", "between_p10"))])
    return judged(row, **bounds)


def recommend(distances: DataFrame, low: float = P.RECOMMEND_LOW, high: float = P.RECOMMEND_HIGH) -> DataFrame:
    """p90 of distances within, p10 between, and a threshold halfway if they leave a gap, clamped, with a warning where a person should look; zeros where a class has no distances."""
    p = distances.agg(F.expr("percentile(distance, 0.9) FILTER (WHERE class = 'within')").alias("within_p90"), F.expr("percentile(distance, 0.1) FILTER (WHERE class = 'between')").alias("between_p10"))
    return judged(p, low, high)


def judged(p: DataFrame, low: float = P.RECOMMEND_LOW, high: float = P.RECOMMEND_HIGH) -> DataFrame:
    """recommend() of a row of the two percentiles (within_p90, between_p10)."""
    gap = F.col("within_p90") < F.col("between_p10")
    mid = F.round((F.col("within_p90") + F.col("between_p10")) / 2, 2)
    fixed = F.least(F.greatest(mid, F.lit(low)), F.lit(high))
    few = F.col("within_p90").isNull() | F.col("between_p10").isNull()
    shown = lambda c: F.round(F.when(few, 0.0).otherwise(F.col(c)), 4).alias(c)
    warning = F.when(few, "insufficient data for recommendation").when(gap & (mid < low), f"clamped to lower bound {low}").when(gap & (mid > high), f"clamped to upper bound {high}").when(~gap, "no clean gap; manual decision required")
    return p.select(
        shown("within_p90"), shown("between_p10"), F.when(gap & (mid == fixed), "clean_gap").when(gap, "clamped").otherwise("no_gap_manual_required").alias("status"),
        F.when(gap, fixed).alias("recommended"), warning.alias("warning"),
    )


def drift(recommendation: DataFrame, current: float = P.THREAT_DISTANCE, most: float = P.DRIFT_LIMIT) -> DataFrame:
    d = F.coalesce(F.abs(F.col("recommended") - current), F.lit(0.0))
    return recommendation.select("*", F.round(d, 4).alias("drift"), (F.round(d, 4) <= most).alias("passed"))


def gate(pairs: DataFrame, most: int = P.MERGE_GATE, force: bool = False) -> DataFrame:
    """The pairs, if they are few enough or forced.  Counts no further than the limit."""
    if not force:
        gated(pairs.limit(most + 1).count(), most)
    return pairs


def gated(pairs: int, most: int = P.MERGE_GATE) -> None:
    if pairs > most:
        raise ValueError(f"more than {most} candidate pairs; force to go on")


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id that each paired id reaches.  Large-star and small-star rounds on tables in the shared folder."""
    e = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError("components did not settle")


def merge_plan(pairs: DataFrame, nodes: DataFrame, by: list) -> DataFrame:
    """(source, target): each component's members merge into its first node in the given order."""
    comp = components(pairs).join(nodes, "id")
    ranked = comp.withColumn("_n", F.row_number().over(W.partitionBy("root").orderBy(*by))).select("root", "id", "_n")
    target = ranked.where("_n = 1").select("root", F.col("id").alias("target"))
    return ranked.where("_n > 1").join(target, "root").select(F.col("id").alias("source"), "target")


def greedy_merges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, similarity) as a scan in falling similarity would merge them, each node once.

    Rounds take every pair that comes first among the remaining pairs of both its ends; no better pair can block it, so the result is the scan's.
    The canonical node has the higher importance, then the earlier creation, then the smaller id.
    """
    rest = written(pairs.select("a", "b", "similarity"))
    out = None
    while True:
        order = [F.desc("similarity"), F.asc("a"), F.asc("b")]
        ends = rest.select("a", "b", "similarity", F.explode(F.array("a", "b")).alias("end"))
        first = ends.withColumn("_n", F.row_number().over(W.partitionBy("end").orderBy(*order))).where("_n = 1").groupBy("a", "b", "similarity").agg(F.count("*").alias("_k"))
        taken = written(first.where("_k = 2").drop("_k"))
        if taken.isEmpty():
            break
        out = taken if out is None else out.unionByName(taken)
        used = taken.select(F.explode(F.array("a", "b")).alias("x")).distinct()
        rest = written(rest.join(used.withColumnRenamed("x", "a"), "a", "left_anti").join(used.withColumnRenamed("x", "b"), "b", "left_anti").select("a", "b", "similarity"))
    out = rest.limit(0) if out is None else out
    n = nodes.select("id", "importance", "created_at")
    key = lambda p: F.struct(-F.col(f"{p}i"), F.col(f"{p}c"), F.col(p))
    j = out.join(n.select(F.col("id").alias("a"), F.col("importance").alias("ai"), F.col("created_at").alias("ac")), "a").join(n.select(F.col("id").alias("b"), F.col("importance").alias("bi"), F.col("created_at").alias("bc")), "b")
    wins = key("a") < key("b")
    return j.select(F.when(wins, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(wins, F.col("a")).otherwise(F.col("b")).alias("target"), "similarity")


def greedy_canonicals(threats: DataFrame, most: float, baseline: float) -> DataFrame:
    """(threshold, merged): how many threats, taken in order of creation, lie within the threshold of an earlier one that was kept."""
    widest, least = max(most, baseline), min(most, baseline)

    def near(x, y):
        def strip(rows, s, own):
            hit = s > 1 - widest - 1e-12
            i, j = np.nonzero(hit if own is None else hit & own)
            one, other = x.select(["id", "created_at"]).take(pa.array(i + rows.start)), y.select(["id", "created_at"]).take(pa.array(j))
            (a, u), (b, v) = ((t.column("id"), t.column("created_at")) for t in (one, other))
            none, also = pc.is_null(u), pc.is_null(v)
            less = pc.or_(pc.fill_null(pc.less(u, v), False), pc.and_(none, pc.invert(also)))
            same = pc.or_(pc.fill_null(pc.equal(u, v), False), pc.and_(none, also))
            first = pc.or_(less, pc.and_(same, pc.less(a, b)))
            d = 1 - s[i, j]
            found = pa.table({"a": pc.if_else(first, a, b), "b": pc.if_else(first, b, a), "narrow": d < least + 1e-12})
            return found.filter(pa.array(d < widest + 1e-12))

        return strip

    kind, out = dict(threats.dtypes)["id"], None
    # The table of pairs grows with the square of the nodes: it holds no distances, and is there once for both thresholds.
    pairs = written(pairs_among(threats.select("id", "embedding", "created_at"), near, f"a {kind}, b {kind}, narrow boolean"))
    for t in (most, baseline):
        n = absorbed_ends(pairs if t == widest else pairs.where("narrow")).agg(F.count("*").alias("merged")).select(F.lit(float(t)).alias("threshold"), "merged")
        out = n if out is None else out.unionByName(n)
    out = written(out)
    discard(pairs)
    return out


def _handy(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """A written table of ids as the small side of a join: broadcast up to the limit (16 bytes a row), so that the large side isn't shuffled."""
    return F.broadcast(df) if df.count() * 16 <= limit else df


def absorbed_ends(pairs: DataFrame) -> DataFrame:
    """(b): of pairs (a, b) in which a comes before b, each b that lies near to a canonical a, once.

    As if the nodes were taken in order and each became canonical unless one that is canonical already lies near: a node is absorbed
    once an earlier canonical one is known, and canonical once all its earlier neighbours are absorbed.  Rounds go on until all is decided; a round's
    tables go when the next one's are there.
    """
    left, before, parts = pairs.select("a", "b"), None, []
    while True:
        canonical = written(left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))
        hit = written(left.join(_handy(canonical), "a", "left_semi").select("b").distinct())
        parts.append(hit)
        gone = _handy(hit)
        left = written(left.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
        discard(canonical, *([] if before is None else [before]))
        before = left
        if left.isEmpty():
            discard(left)
            return functools.reduce(DataFrame.unionByName, parts)


def sample_pairs(distances: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of each class, by a seeded hash."""
    w = W.partitionBy("class").orderBy(F.xxhash64(*[F.col(x) for x in distances.columns], F.lit(seed)))
    return distances.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _grams(text: str, q: int) -> np.ndarray:
    """Hashes of a text's q-grams, each with its number among equal ones, so that repeats count."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(c) - q + 1, 0), np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(h) + i]
    h.sort()
    return h + (np.arange(len(h)) - np.searchsorted(h, h)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _starts(text: str) -> int:
    """How many matching blocks SequenceMatcher can find at most with this second text: from 200 characters on each but one at the very start holds a character that is not popular."""
    if len(text) < 200:
        return len(text)
    n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
    return int(n[n <= len(text) // 100 + 1].sum()) + 1


def _may_be_near(x: list[str], y: list[str], one: bool) -> list[tuple[int, int]]:
    """Links (places in x, then y) that join all texts whose ratio can reach 0.9: a forest of them, not every pair.

    Blocks of m characters in all make up a ratio of 2m / (a + b).  They lie apart, so that k blocks leave m - k (q - 1) common q-grams at
    least, and there are no more of them than _starts() says, nor than characters left over.  Pairs with fewer common q-grams are no links.
    """
    texts = x if one else x + y
    size, starts = np.array([len(t) for t in texts]), [_starts(t) for t in texts]
    sides = [(range(len(texts)), range(len(texts)))] if one else [(range(len(x)), range(len(x), len(texts))), (range(len(x), len(texts)), range(len(x)))]
    root, out = np.arange(len(texts)), []
    fit = lambda b, q: 0.9 * size[b] / 1.1 - (q - 1) * min(starts[b], size[b] / 5.5 + 1)
    best = [next((q for q in (12, 8, 5, 3, 2) if fit(b, q) >= 0.3 * size[b]), 1) for b in range(len(texts))]
    for firsts, seconds in sides:
        for q in sorted({best[b] for b in seconds}):
            held = [_grams(texts[a], q) for a in firsts]
            gram, owner = np.concatenate(held), np.repeat(np.array(firsts), [len(g) for g in held])
            order = np.argsort(gram, kind="stable")
            gram, owner = gram[order], owner[order]
            for b in (b for b in seconds if best[b] == q):
                own = _grams(texts[b], q)
                low, high = np.searchsorted(gram, own), np.searchsorted(gram, own, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(texts))
                both = size + size[b]
                least = np.ceil(0.45 * both - 1e-6)
                blocks = np.minimum(starts[b], both - 2 * least + 1)
                hit = np.zeros(len(texts), bool)
                hit[firsts.start : firsts.stop] = True
                hit &= (common >= least - (q - 1) * blocks) & (least <= np.minimum(size, size[b])) & (root != root[b])
                for other in np.unique(root[hit]):
                    out.append((b, int(np.flatnonzero(hit & (root == other))[0])))
                    root[root == other] = root[b]
    return out


def near_groups(texts: DataFrame) -> DataFrame:
    """(id, root) of distinct texts (section, id, norm), not empty: texts of one section whose ratio is 0.9 or more have one root.  Texts that meet none may be left out.

    Only texts whose lengths are within 11 to 9 are compared, in blocks that hold about BLOCK_CHARS characters, by common q-grams.
    """
    band = F.floor(F.log(F.length("norm")) / math.log(1.2223)).cast("int")  # 11 / 9, and some more for rounding
    t = texts.withColumns({"_band": band, "_n": F.length("norm")})
    parts = F.ceil(F.greatest(F.sum("_n") / BLOCK_CHARS, F.count("*") / BLOCK_TEXTS)).cast("int")
    sizes = t.groupBy("section", "_band").agg(parts.alias("_parts"))
    now = sizes.select(F.col("section").alias("_s"), F.col("_band").alias("_b"), "_parts")
    near = sizes.select(F.col("section").alias("_s"), F.explode(F.array(F.col("_band") - 1, F.col("_band") + 1)).alias("_b"), F.struct("_band", "_parts").alias("_by"))
    near = near.groupBy("_s", "_b").agg(F.collect_list("_by").alias("_near"))  # two at most
    at = lambda df: F.col("section").eqNullSafe(F.col("_s")) & (F.col("_band") == F.col("_b"))
    t = t.join(now, at(now)).drop("_s", "_b").join(near, at(near), "left").drop("_s", "_b")
    me = F.struct(F.col("_band").alias("band"), F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("block"))
    blocks = lambda b, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(b.alias("band"), k.cast("int").alias("block")))
    others = F.flatten(F.transform(F.coalesce("_near", F.array().cast("array<struct<_band:int,_parts:int>>")), lambda o: blocks(o["_band"], o["_parts"])))
    t = t.select("section", "id", "norm", me.alias("_me"), F.explode(F.concat(blocks(F.col("_band"), F.col("_parts")), others)).alias("_other"))
    t = t.select("section", "id", "norm", F.least("_me", "_other").alias("_x"), F.greatest("_me", "_other").alias("_y"), (F.col("_me") <= F.col("_other")).alias("_left"))

    def meet(g: pa.Table) -> pa.Table:
        left, right = g.filter(g.column("_left")), g.filter(pc.invert(g.column("_left")))
        one = g.column("_x")[0].as_py() == g.column("_y")[0].as_py()
        ids = pa.concat_tables([left, right]).column("id").to_pylist()
        pairs = _may_be_near(left.column("norm").to_pylist(), right.column("norm").to_pylist(), one) if one or left.num_rows and right.num_rows else []
        return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.string()), "b": pa.array([ids[j] for _, j in pairs], pa.string())})

    return components(t.groupBy("section", "_x", "_y").applyInArrow(meet, "a string, b string"))


def compress_sections(rows: DataFrame, section: str = "section") -> DataFrame:
    """Within each section, in rank order, a row near in text to an earlier one is absorbed: the higher importance gives the content, the ids are kept.

    Only rows whose texts may be near to each other, directly or by others, are gone through together.
    """
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        import re

        return texts.map(lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (t or "").lower())).strip())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        alike = lambda m: m.real_quick_ratio() >= 0.9 and m.quick_ratio() >= 0.9 and m.ratio() >= 0.9  # noqa: E731  the first two bound the third
        known = lambda n: 0 if pd.isna(n) else n
        out: list[dict] = []
        for r in pdf.sort_values(["rank", "id"], kind="stable").itertuples():
            t, m, hit = r.norm, SequenceMatcher(None, "", r.norm), None
            for o in out:
                m.set_seq1(o["norm"])
                if o["norm"] == t or alike(m):
                    hit = o
                    break
            if hit is None:
                out.append({"section": r.section, "rank": r.rank, "id": r.id, "norm": t, "fact": r.fact, "importance": r.importance, "ids": [str(r.id)]})
            else:
                hit["ids"].append(str(r.id))
                if known(r.importance) > known(hit["importance"]):
                    hit.update(fact=r.fact, importance=r.importance, norm=t)
        return pd.DataFrame([{**o, "ids": ",".join(o["ids"])} for o in out])[["section", "rank", "id", "fact", "importance", "ids"]]

    t = rows.select(F.col(section).cast("string").alias("section"), "rank", "id", "fact", F.col("importance").cast("int").alias("importance")).withColumn("norm", normal("fact"))
    key = F.sha2(F.concat(F.coalesce("section", F.lit("\u0001")), F.lit("\u0000"), "norm"), 256)
    t = written(t.withColumn("_key", key))
    roots = near_groups(t.where("norm <> ''").select("section", F.col("_key").alias("id"), "norm").dropDuplicates(["id"]))
    t = t.join(roots.select(F.col("id").alias("_key"), "root"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    many = t.groupBy("root").agg(F.count("*").alias("_n")).where("_n > 1").select("root")
    kind = {n: d for n, d in t.dtypes}
    shape = f"section string, rank {kind['rank']}, id {kind['id']}, fact string, importance int, ids string"
    found = t.where("norm <> ''").join(many, "root", "left_semi").groupBy("root").applyInPandas(run, shape)
    alone = t.where("norm = ''").unionByName(t.where("norm <> ''").join(many, "root", "left_anti"))
    out = found.unionByName(alone.select("section", "rank", "id", "fact", "importance", F.col("id").cast("string").alias("ids")))
    place = F.row_number().over(W.partitionBy("section").orderBy(F.asc_nulls_last("rank"), "id"))
    return out.select("section", place.cast("long").alias("rank"), "fact", "importance", "ids")


def wired(sources: DataFrame, targets: DataFrame, k: int, least: float, keep=None, reason: str = "Embedding similarity %.4f") -> DataFrame:
    """(src, dst, similarity, rationale): each source's k nearest targets, those that pass `keep`, and of them the ones at `least` or more."""
    near = similar_pairs(sources, targets, -2.0, k=k)
    if keep is not None:
        near = near.join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    near = near.where(F.col("similarity") >= least)
    return near.select("src", "dst", F.round("similarity", 4).alias("similarity"), F.format_string(reason, "similarity").alias("rationale"))
