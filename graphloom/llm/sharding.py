"""Sharding along a Hilbert curve over quantised metadata.

Size, language, source and id are each quantised to `BITS` bits, in order and with
about equally many rows a level; rows are sorted by
their index on the Hilbert curve through that grid and the sorted run is cut into
shards whose row counts differ by one at most.  Neighbours on the curve are near in
every dimension, so a filter on a value or a range of any of them prunes shards.

The text is read once, for its size and checksum; what is shuffled is a digest of a
few numbers a row.  Ranges are cut by (curve index, text hash, doc_id), so a hot cell or a hot
group of copies spreads over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

SHARDS, BITS = 40, 4


def hilbert_index(dims: list[Column], bits: int) -> list[tuple[str, Column]]:
    """Columns, to be added in turn, whose last ("h") is the Hilbert index of the point.

    The transform (Skilling 2004) works on the transposed form: bit planes from the top are
    inverted or exchanged, Gray-encoded, and interleaved.
    """
    n, steps = len(dims), []
    x = [f"_x{i}" for i in range(n)]
    for name, d in zip(x, dims):
        steps.append((name, d.cast("long")))
    for q in range(bits - 1, 0, -1):
        p = (1 << q) - 1
        for i in range(n):
            on = F.col(x[i]).bitwiseAND(F.lit(1 << q)) != 0
            if i == 0:
                steps.append((x[0], F.when(on, F.col(x[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(x[0]))))
            else:
                steps.append(("_t", F.when(on, F.lit(0).cast("long")).otherwise(F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(p)))))
                steps.append((x[i], F.col(x[i]).bitwiseXOR(F.col("_t"))))
                steps.append((x[0], F.when(on, F.col(x[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(x[0]).bitwiseXOR(F.col("_t")))))
    for i in range(1, n):
        steps.append((x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1]))))
    t: Column = F.lit(0).cast("long")
    for q in range(bits - 1, 0, -1):
        t = F.when(F.col(x[n - 1]).bitwiseAND(F.lit(1 << q)) != 0, t.bitwiseXOR(F.lit((1 << q) - 1))).otherwise(t)
    steps.append(("_t", t))
    h: Column = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            h = F.shiftleft(h, 1).bitwiseOR(F.shiftright(F.col(x[i]).bitwiseXOR(F.col("_t")), b).bitwiseAND(F.lit(1)))
    steps.append(("h", h))
    return steps


def number_cuts(df: DataFrame, names: list[str], levels: int) -> list[list]:
    """For each numeric column at most levels - 1 values, its approximate quantiles; a mergeable sketch of bounded size gives them."""
    shares = [i / levels for i in range(1, levels)]
    found = df.agg(*[F.percentile_approx(c, shares).alias(c) for c in names]).first()
    return [sorted(v or []) for v in found]


def value_cuts(df: DataFrame, name: str, levels: int) -> list:
    """At most levels - 1 values of a column, for each level from 1 on the first value that reaches it: as many parts of the rows, or more, come before.  Values that span several levels repeat.

    Values are counted and ranked in ranges, with the totals of ranges added up on the driver; a value is never split, however many rows hold it.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
    counts = stored(counts.repartitionByRange(parts, name).sortWithinPartitions(name).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    total, starts = 0, []
    for part, n in sorted(counts.groupBy("_part").agg(F.sum("_n")).collect()):  # a row for each shuffle partition at most
        starts.append((part, total))
        total += n
    begins = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.floor((F.col("_start") + earlier) * levels / max(1, total))
    firsts = counts.join(F.broadcast(begins), "_part").select(name, level.alias("_level")).groupBy("_level").agg(F.min(name).alias("v"))
    reached = sorted((r["_level"], r["v"]) for r in firsts.collect())  # a row for each level at most
    discard(counts)
    return [min(v for at, v in reached if at >= k) for k in range(1, levels) if reached and reached[-1][0] >= k]


def level_of(value: Column, cuts: list) -> Column:
    """How many of the cuts are not above the value; 0 for null."""
    return sum((F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Every row with its shard and its slot there, by the law `rows`.

    Null texts count as no bytes (size 16, checksum of nothing); null lang, source or doc_id count as the lowest level.
    Any ids of 64 bits will do.  Equal rows keep separate slots.  An empty table gives no rows; extra columns are not read.
    """
    levels = 1 << bits
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    digest = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (bytes_ + 16).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("_text"),
            F.col("lang").cast("string").alias("_lang"),
            F.col("source").cast("string").alias("_source"),
        )
    )
    sizes, ids = number_cuts(digest, ["size", "doc_id"], levels)
    cuts = {"size": sizes, "_lang": value_cuts(digest, "_lang", levels), "_source": value_cuts(digest, "_source", levels), "doc_id": ids}
    dims = [level_of(F.col(c), v) for c, v in cuts.items() if v]  # a column of one value, or of none, is no dimension
    out = digest.withColumns({f"_d{i}": d for i, d in enumerate(dims)}) if dims else digest.withColumn("h", F.lit(0).cast("long"))
    for name, c in hilbert_index([F.col(f"_d{i}") for i in range(len(dims))], bits) if dims else []:
        out = out.withColumn(name, c)
    keys = ["h", "_text", F.col("doc_id").asc_nulls_first()]
    out = out.select("doc_id", "size", "text_crc32", "h", "_text")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The id is the partition's number above bit 33 and the row's place in it below.
    run = stored(out.select("doc_id", "size", "text_crc32", "h", F.monotonically_increasing_id().alias("_at")))
    counts = run.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n")).collect()  # a row for each shuffle partition at most
    total, before = 0, []
    for part, n in sorted(counts):
        before.append((part, total))
        total += n
    starts = docs.sparkSession.createDataFrame(before, "_part long, _start long")
    base, extra = divmod(total, shards)
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    long_rows = extra * (base + 1)
    run = run.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part").withColumn("_rank", rank)
    first = F.col("_rank") < long_rows
    shard = F.when(first, F.floor(F.col("_rank") / (base + 1))).otherwise(extra + F.floor((F.col("_rank") - long_rows) / max(1, base)))
    slot = F.when(first, F.pmod(F.col("_rank"), F.lit(base + 1))).otherwise(F.pmod(F.col("_rank") - long_rows, F.lit(max(1, base))))
    return run.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("curve_index")
    )


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
