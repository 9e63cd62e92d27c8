"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint's 64 bits are cut into m segments on a ring.  If two fingerprints differ in
at most t bits, then from some segment on, every run of i consecutive segments differs in
at most i * t / m bits (Qin, Xiao 2018).  While i * t / m < 1 such a run is equal, so
the first `equal` segments of the chain form a join key; the longer prefixes are tested on the
candidates, and then the whole distance.

Keys that few fingerprints share are joined in pairs.  For a key that more share
(a large group of near copies) pairs would grow with the square of the group; its
fingerprints instead meet at points: each is sent to itself and its 64 neighbours at one
bit, and two fingerprints at distance 2 or less share a point.  That loses no link and grows with the
group's size.  Exact copies are one fingerprint throughout.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import ARROW_ROWS, BATCH_ROWS, discard, fixed, maybe_broadcast, small_enough, stored, table, text_input, unused

SHINGLE, SEED, BITS, DISTANCE, SEGMENTS, PAIRWISE = 3, 42, 64, 2, 5, 24


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' hashes.  Fewer words than a shingle's are one shingle; none give zero."""
    import xxhash

    w = words_of(text)
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*[w[i:] for i in range(shingle)])) if len(w) > shingle else [b" ".join(w)]
    n, ones = 0, np.zeros(BITS, np.int64)
    hashes = np.fromiter((h(g, SEED) for g in grams), np.uint64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """doc_id, fp (64 bits in a long), of every row; a null text has no words."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint((t.as_py() or "").encode(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return text_input(docs).mapInArrow(run, "doc_id long, fp long")


def segment_cuts(segments: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def equal_run(segments: int, distance: int) -> int:
    """How many segments at a chain's start must be equal: the largest i with i * distance / segments < 1."""
    return max(1, -(-segments // distance) - 1) if distance else segments


def ring_links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose transitive closure is that of all pairs within the distance.

    fps: a column fp without repeats.  Keys shared by at most `pairwise` fingerprints give all their pairs; larger ones meet
    at points of Hamming distance 1, which is exact for distances up to 2.
    """
    if segments <= distance or distance > 2:
        raise ValueError("the distance must be 2 at most and there must be more segments than it")
    cuts, run = segment_cuts(segments), equal_run(segments, distance)
    mask = lambda i: ((1 << cuts[i % segments][1]) - 1) << cuts[i % segments][0]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    masks = [signed(sum(mask(i + j) for j in range(run))) for i in range(segments)]
    keys = F.array(*[F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    keyed = stored(fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.seg", "k.key"))
    shared = keyed.groupBy("seg", "key").agg(F.count("*").alias("n")).where("n > 1")
    few = keyed.join(shared.where(F.col("n") <= pairwise).select("seg", "key"), ["seg", "key"])
    groups = few.groupBy("seg", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most `pairwise` each
    pairs = groups.select("seg", F.posexplode("fps").alias("i", "a"), "fps").select("seg", "a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
    d = lambda m: F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(signed(m))))
    whole: Column = F.lit(False)
    for i in range(segments):
        chain, ok = 0, F.col("seg") == i
        for j in range(segments):
            chain |= mask(i + j)
            if j + 1 >= run:
                ok = ok & (d(chain) <= (j + 1) * distance // segments)
        whole = whole | ok
    links = pairs.where(whole).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()
    many = keyed.join(shared.where(F.col("n") > pairwise).select("seg", "key"), ["seg", "key"]).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)).cast("long") for i in range(BITS)])
    points = many.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("point"))
    if distance < 2:
        points = points.where("point = fp") if distance == 0 else points
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("_max")).where("a < _max").select("point", "a")
    stars = points.join(least, "point").where("fp > a").select("a", F.col("fp").alias("b")).distinct()
    if distance == 1:  # a shared point may lie between two that differ in two bits
        stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return links.unionByName(stars)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): for every node of a link, the smallest node it reaches.  Alternating large-star and small-star rounds, each written to the shared folder."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, stored(small)
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS, pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, fp, component_id of every row.

    Texts without words have fingerprint zero and are linked like any other.  A null doc_id belongs to its component but is never its
    smallest id, unless it has no other.  Repeated rows stay.  An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(ring_links(least.select("fp"), distance, segments, pairwise))
    # Only fingerprints with links are in `roots`; the others are their own.
    grouped = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: Bits of the prints that near copies are pruned by, segments of their ring, how alike texts must be, and how many standard deviations the prints of such texts may differ beyond the mean.
PRINT_BITS, RING, ALIKE, SLACK = 256, 16, 0.8, 5.0
#: Longest chain of segments that is tested before the whole print.
CHAIN = 4
#: Texts of fewer shingles go to the exact check without the ring: few shingles make a coarse print.
SURE = 64
#: Shingles in `COMMON_LEAST` or more of a sample of 1 in `COMMON_SAMPLE` texts come last in the order of prefixes, the `COMMON` commonest of them at most.  Results do not depend on it.
COMMON, COMMON_SAMPLE, COMMON_LEAST = 50_000, 16, 3
#: Most members, and shingles, of a crowded key that one side of a task compares.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Words to hashes, kept up to a bound."""

    def __missing__(self, word):
        import xxhash

        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < 60_000:
            self[word] = h
        return h


def shingle_hashes(text: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted.  Fewer words than a shingle's are one shingle, and so are none."""
    w = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    k = min(shingle, len(w))
    out = np.full(max(1, len(w) - k + 1) if k else 1, k, np.uint64)
    for i in range(k):
        out = out * ODD + h[i : len(w) - k + 1 + i]
        out ^= out >> np.uint64(31)
    return np.unique(out.view(np.int64))


def wide_print(grams: np.ndarray, bits: int = PRINT_BITS) -> np.ndarray:
    """The SimHash of a set of shingle hashes, `bits` bits in words of 64: a bit is set if over half of the hashes, mixed anew for each word, have it."""
    out = np.empty(bits // 64, np.uint64)
    x = grams.view(np.uint64)
    for j in range(len(out)):
        x = (x ^ (x >> np.uint64(30))) * MIX + ODD
        x ^= x >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 65536):
            ones += np.unpackbits(x[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[j] = np.packbits(2 * ones > len(x), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def most_bits(similarity: float, bits: int = PRINT_BITS, slack: float = SLACK) -> int:
    """The bits in which the prints of two texts of this Jaccard similarity differ on average, and `slack` standard deviations."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def on_ring(differences: list, limit: int, longest: int = CHAIN):
    """Whether some chain of consecutive segments stays within i * limit / m at each length i up to `longest`.  `differences`: by segment, numbers, arrays or columns."""
    m, found = len(differences), None
    for start in range(m):
        total, chain = 0, None
        for i in range(longest):
            total = total + differences[(start + i) % m]
            within = total <= (i + 1) * limit // m
            chain = within if chain is None else chain & within
        found = chain if found is None else found | chain
    return found


def near_prints(pairs: DataFrame, a: str, b: str, limit: int, bits: int = PRINT_BITS, segments: int = RING) -> DataFrame:
    """Of pairs with their prints (arrays of 64 bits) those that pass the chains, and then the full Hamming check."""
    each, width = segments * 64 // bits, bits // segments
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    masks = [signed(((1 << width) - 1) << (width * i)) for i in range(each)]
    words = [F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i)) for i in range(bits // 64)]
    met = fixed(pairs, "_ring", F.array(*[F.bit_count(w.bitwiseAND(F.lit(k))) for w in words for k in masks]))
    met = met.where(on_ring([F.get(F.col("_ring"), i) for i in range(segments)], limit))
    return met.where(F.aggregate("_ring", F.lit(0), lambda x, y: x + y) <= limit).drop("_ring")


def pieces(batches, rows: int = 512):
    """Batches of fewer rows, as long lists are made of each."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def least_shared(similarity: float, a, b):
    """Shingles that sets of these sizes must share to be alike."""
    return (a + b) * (similarity / (1 + similarity)) - 1e-6


def print_words(t: pa.Table) -> np.ndarray:
    """The prints of a table's rows, one row of the result a word of 64 bits."""
    return np.concatenate([np.asarray(p.values) for p in t.column("print")]).view(np.uint64).reshape(t.num_rows, -1).T


def feasible(t: pa.Table, similarity: float, limit: int, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which members of a crowded key (`rows` by all) may be alike with this shingle as their first common one, and are not joined yet: by sizes, places, roots, and chains of their prints' segments."""
    size, at, root, own = (t.column(c).to_numpy() for c in ("size", "at", "root", "own"))
    a = lambda v: v[rows, None]
    out = (a(root) != root) & (np.minimum(a(size - at), size - at) >= least_shared(similarity, a(size), size))
    if t.column("x")[0].as_py() != t.column("y")[0].as_py():
        out &= a(own) != own
    y, x = np.nonzero(out)
    if len(y):
        each, width = RING * 64 // PRINT_BITS, PRINT_BITS // RING
        part = lambda v: [((v[rows[y]] ^ v[x]) >> np.uint64(width * j)) & np.uint64((1 << width) - 1) for j in range(each)]
        differences = [np.bitwise_count(d).astype(np.int16) for v in words for d in part(v)]
        out[y, x] = (np.minimum(size[rows[y]], size[x]) < SURE) | (on_ring(differences, limit) & (sum(differences) <= limit))
    return out


def feasible_rows(t: pa.Table, similarity: float, limit: int, rows: int = 32):
    """(members, their rows of `feasible`), few at a time, so that memory grows with the block and not with its square."""
    words = print_words(t)
    for i in range(0, t.num_rows, rows):
        some = np.arange(i, min(i + rows, t.num_rows))
        yield some, feasible(t, similarity, limit, some, words)


def block_members(similarity: float, limit: int):
    """The members of a crowded key, of one block or of two, that have a feasible partner."""
    return lambda t: t.filter(pa.array(np.concatenate([able.any(axis=1) for _, able in feasible_rows(t, similarity, limit)])))


def block_links(similarity: float, limit: int):
    """For the same members, with their shingles: links that join all that are alike and not joined yet."""

    def run(t: pa.Table) -> pa.Table:
        fid, size = (t.column(c).to_numpy() for c in ("fid", "size"))
        _, flat = np.unique(np.concatenate([np.asarray(g.values) for g in t.column("grams")]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        _, group = np.unique(t.column("root").to_numpy(), return_inverse=True)
        mark, a, b = np.zeros(flat.max() + 1, bool), [], []
        for i, able in ((i, row) for some, part in feasible_rows(t, similarity, limit) for i, row in zip(some, part)):
            open_ = able & (group != group[i]) & (np.arange(len(fid)) > i)
            if open_.any():
                part = flat[starts[i] : starts[i] + size[i]]
                mark[part] = True
                shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                mark[part] = False
                for j in np.flatnonzero(open_ & (shared >= least_shared(similarity, size, size[i]))):
                    if group[j] != group[i]:
                        a.append(fid[i])
                        b.append(fid[j])
                        group[group == group[j]] = group[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _fid(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in arrays])]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """The shingles known to be common, sorted, from a sample of the texts by hash; they only order prefixes."""

    def run(batches):
        hashes = WordHashes()
        for b in pieces(batches):
            g, n = np.unique(np.concatenate([np.zeros(0, np.int64), *[shingle_hashes((t.as_py() or "").encode(), shingle, hashes) for t in b.column(0)]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n, pa.int64())], names=["g", "n"])

    sample = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(COMMON_SAMPLE)) == 0)
    often = sample.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    return np.sort(np.array([r.g for r in often.orderBy(F.desc("n"), "g").limit(COMMON).collect()], np.int64))  # bounded by COMMON


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of at most `rows` rows for what is run inside."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def alike_groups(docs: DataFrame, *keep: str, **options) -> DataFrame:
    """grouped_alike(), whose Python steps all run before it returns, in batches of few rows, as texts and shingles are long."""
    with small_batches(docs.sparkSession):
        return grouped_alike(docs, *keep, **options)


def grouped_alike(docs: DataFrame, *keep: str, shingle: int = 5, similarity: float = ALIKE, pairwise: int = PAIRWISE, block: int = BLOCK) -> DataFrame:
    """doc_id, fid, root and the columns in `keep` of every row: rows have one root if a chain of texts whose shingles' Jaccard similarity reaches `similarity` joins them.

    Two sets alike from t on share one of the first n - ceil(t * n) + 1 shingles of each in any order common to all; those are the
    keys here, with shingles known to be common last.  A fid stands for a set of shingles, so exact copies are one.  Candidates of a key pass the sizes' and
    places' bounds, then the pigeonring filter on wide prints (chains of segments within proportional budgets, then the whole distance), then the exact similarity.
    The prints' limit lies SLACK standard deviations beyond the mean at `similarity`: about one pair in 10**6 just at the threshold goes missed, all others are certain.

    First all members of a key meet its smallest and largest fid.  Of keys whose members that has not joined, those of up to `pairwise` fids
    give their pairs; larger ones are compared block by block in tasks of bounded size, which give links and no pairs.
    Null and empty texts are one set of shingles, and so one group.  Repeated rows share their group.  An empty table gives no rows.
    """
    limit = most_bits(similarity)
    common = common_shingles(docs, shingle)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"), *keep)
    kept = source.schema.fields[3:]

    def run(batches):
        hashes = WordHashes()
        for b in pieces(batches):
            grams = [shingle_hashes((t.as_py() or "").encode(), shingle, hashes) for t in b.column(1)]
            fid, size = np.array([_fid(g) for g in grams], np.int64), np.array([len(g) for g in grams], np.int32)
            prints = [wide_print(g) for g in grams]
            first = []
            for g in grams:
                if len(common):
                    last = common[np.searchsorted(common, g).clip(0, len(common) - 1)] == g
                    g = np.concatenate([g[~last], g[last]])
                first.append(g[: len(g) - math.ceil(similarity * len(g) - 1e-6) + 1])
            columns = [b.column(0), pa.array(fid), pa.array(size), _lists(prints), b.column(2), _lists(first), *b.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fid", "size", "print", "th", "first", *keep])

    schema = StructType([StructField("doc_id", LongType()), StructField("fid", LongType()), StructField("size", IntegerType()), StructField("print", ArrayType(LongType())), StructField("th", LongType()), StructField("first", ArrayType(LongType())), *kept])
    rows = stored(source.mapInArrow(run, schema))
    reps = stored(rows.select("fid", "size", "print", "th", "first").dropDuplicates(["fid"]))
    keyed = reps.select("fid", "size", F.posexplode("first").alias("at", "key"))
    keys = stored(reps.select("fid", F.explode("first").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("fid").alias("lo"), F.max("fid").alias("hi")).where("n > 1"))
    shared = stored(keyed.join(maybe_broadcast(keys, 40), "key"))
    def ring(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of fids, those whose prints pass the pigeonring filter, or are too short for it."""
        pairs = stored(pairs)
        sides = [F.broadcast(x) if small else x for small in [small_enough(reps, 64)] for x in (reps.select(F.col("fid").alias(c), *[F.col(k).alias(c + k) for k in ("size", "print")]) for c in "ab")]
        met = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("asize", "bsize") >= similarity * F.greatest("asize", "bsize") - 1e-6)
        short = F.least("asize", "bsize") < SURE
        return near_prints(met.where(~short), "aprint", "bprint", limit).select("a", "b").unionByName(met.where(short).select("a", "b"))

    def grams_of(fids: DataFrame) -> DataFrame:
        """fid, grams of the given fids, read from their texts again."""

        def again(batches):
            hashes = WordHashes()
            for b in pieces(batches):
                grams = [shingle_hashes((t.as_py() or "").encode(), shingle, hashes) for t in b.column(1)]
                same = pa.array([f == _fid(g) for f, g in zip(b.column(0).to_pylist(), grams)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(grams)], names=["fid", "grams"]).filter(same)

        wanted = stored(reps.join(maybe_broadcast(fids, 16), "fid", "left_semi").select("fid", F.col("th").alias("_th")))
        texts = source.select("text", "_th").join(maybe_broadcast(wanted, 24), "_th").groupBy("fid").agg(F.first("text").alias("text"))
        return stored(texts.mapInArrow(again, "fid long, grams array<long>"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that are alike."""
        pairs = stored(ring(pairs))
        grams = grams_of(pairs.select(F.col("a").alias("fid")).unionByName(pairs.select(F.col("b").alias("fid"))).distinct())
        met = pairs.join(grams.select(F.col("fid").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("fid").alias("b"), F.col("grams").alias("gb")), "b")
        out = stored(met.where(F.size(F.array_intersect("ga", "gb")) >= least_shared(similarity, F.size("ga"), F.size("gb"))).select("a", "b"))
        discard(grams)
        return out

    stars = shared.select("fid", F.explode(F.array("lo", "hi")).alias("hub")).where("fid <> hub")
    links = verified(stars.select(F.least("fid", "hub").alias("a"), F.greatest("fid", "hub").alias("b")).distinct())
    roots = stored(components(links))
    rooted = shared.drop("lo", "hi").join(maybe_broadcast(roots, 24), F.col("fid") == F.col("node"), "left").select("key", "fid", "size", "at", "n", F.coalesce("root", "fid").alias("root"))
    rooted = stored(rooted)
    discard(shared)
    discard(keys)
    apart = rooted.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.sum("size").alias("_all")).where("_lo < _hi").select("key", "_all")
    rest = stored(rooted.join(maybe_broadcast(stored(apart), 24), "key"))
    few = rest.where(F.col("n") <= pairwise).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fid", "size", "at", "root"))).alias("f"))  # at most `pairwise` each
    pairs = few.select("f", F.posexplode("f").alias("i", "a")).select("a", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("b")).where("a.root <> b.root")
    most = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))  # a pair's first common shingle is followed by all the others
    pairs = pairs.where(most >= least_shared(similarity, F.col("a.size"), F.col("b.size"))).select(F.col("a.fid").alias("a"), F.col("b.fid").alias("b")).distinct()
    more = verified(pairs)
    crowded = rest.where(F.col("n") > pairwise)
    if not crowded.isEmpty():
        blocks = F.ceil(F.greatest(F.col("n") / block, F.col("_all") / BLOCK_SHINGLES)).cast("long")
        dealt = crowded.withColumn("own", F.pmod(F.xxhash64("fid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "n", "_all")
        prints = reps.select("fid", "print")
        dealt = dealt.join(maybe_broadcast(stored(prints.join(maybe_broadcast(crowded.select("fid").distinct(), 16), "fid", "left_semi")), 64), "fid")
        able = stored(dealt.groupBy("key", "x", "y").applyInArrow(block_members(similarity, limit), dealt.schema))
        of = grams_of(able.select("fid").distinct())
        more = more.unionByName(able.join(of, "fid").groupBy("key", "x", "y").applyInArrow(block_links(similarity, limit), "a long, b long"))
    roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    out = rows.select("doc_id", "fid", *keep)
    return out.join(maybe_broadcast(roots, 24), out.fid == roots.node, "left").select("doc_id", "fid", F.coalesce("root", "fid").alias("root"), *keep)


def alike_documents(docs: DataFrame, shingle: int = 5, similarity: float = ALIKE, pairwise: int = PAIRWISE, block: int = BLOCK) -> DataFrame:
    """doc_id, fid, component_id (the smallest doc_id) of every row, by alike_groups."""
    found = stored(alike_groups(docs, shingle=shingle, similarity=similarity, pairwise=pairwise, block=block))
    smallest = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "root").select("doc_id", "fid", "component_id")


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one of the smallest doc_id (null comes last), then of the smallest hash of its text, then of all its columns.

    Ids need be neither unique nor known: rows of different groups stay, whatever their ids.
    Word shingles here take five words and texts are alike from a similarity of 0.8 on, as stages on shingles do.
    """
    hash_, rank_, kept_, row_ = unused(docs, "_hash", "_rank", "_kept", "_row")
    hashed = docs.withColumn(hash_, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text"), F.col(hash_).alias("row"))
    found = alike_groups(hashed.select("doc_id", "text", rank.alias(rank_)), rank_)
    kept = found.groupBy("root").agg(F.min(rank_).alias("r")).select(F.col("r.doc_id").alias(kept_), F.col("r.row").alias(row_))
    out = hashed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_)) & (F.col(hash_) == F.col(row_)), "left_semi")
    # What is left more than once are rows alike in every column.
    return out.dropDuplicates(["doc_id", hash_]).select(*[f"`{c}`" for c in docs.columns])
