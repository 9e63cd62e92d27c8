"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a side of a join may have, by count times row width, to be broadcast.
BROADCAST_BYTES = 32 << 20
#: Most rows of an Arrow batch, as texts are long.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; only where that is unset and driver and executors are one process (as in tests), one under /tmp is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file:///tmp/checkpoints/graphloom"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: later steps reread it instead of computing it again, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def modest_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From here on Arrow batches of the session hold at most `rows` rows.  Whoever runs a stage's plan does so after the stage has returned, so the setting stays; results don't depend on it."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def with_text(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, int, int]:
    """The columns in `keep` (none: doc_id), where the text stands as a string, and where they begin: a text that is kept anyway goes to Python once."""
    kept = docs.select(*[f"`{c}`" for c in keep]) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if "text" in kept.columns and dict(kept.dtypes)["text"] == "string":
        return kept, kept.columns.index("text"), 0
    (text,) = unused(kept, "_text")
    return docs.select(F.col("text").cast("string").alias(text), *([f"`{c}`" for c in keep] or [F.col("doc_id").cast("long").alias("doc_id")])), 0, 1


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as set it apart from df's columns in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if df's rows, counted up to the limit and no further, fit the broadcast bound."""
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, row_bytes) else df


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once a row.  A plain column may be copied by the optimiser into filters and into every step of a lambda that names it; the output of a generator isn't."""
    return df.withColumn(name, F.explode(F.array(value)))


def arrow_schema(fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield f(b)

    return run


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; a null is empty."""
    a = batch.column(batch.schema.get_field_index(column))
    return [b"" if x is None else x for x in a.cast(pa.large_binary() if pa.types.is_large_string(a.type) else pa.binary()).to_pylist()]


def text_input(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with whatever else is named; other columns never reach a scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
