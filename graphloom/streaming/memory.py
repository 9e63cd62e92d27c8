"""A memory table fed by streams: de-duplicated ingest, recall after a response, and maintenance that catches up.

The table is a folder of numbered versions.  A version's rows are written first and its number is committed last, as one small file;
readers take committed versions only, so they never see half a batch, and a batch that runs again either finds its commit and does
nothing or overwrites what its first attempt left.  What repeats a memory or recalls it is a row of `hits`, not a rewrite.  One writer at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..operators import memory_ingest as N
from ..operators.filters import long_due, short_due
from ..storage import written

HITS = "id {id}, kind string, times long, at timestamp, version long"
COMMITS = "number long, run string, batch long, version long"


def _append(df: DataFrame, target: str, part: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{target}/{part}/version={version}")


def create_table(memories: DataFrame, target: str) -> None:
    """A table that begins with these memories, as version 0."""
    spark, kind = memories.sparkSession, dict(memories.dtypes)["id"]
    _append(memories, target, "memories", 0)
    _append(spark.createDataFrame([], HITS.format(id=kind)).drop("version"), target, "hits", 0)
    _append(spark.createDataFrame([(0, "", -1)], "number long, run string, batch long"), target, "commits", 0)


def commits(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(COMMITS).parquet(f"{target}/commits")


def current_version(spark: SparkSession, target: str) -> int:
    return commits(spark, target).agg(F.max("number")).first()[0]


def memories(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The memories as of a committed version (the latest if none is named): recalls and repeats raise the strength up to 1, repeats also count as reinforcements."""
    upto = current_version(spark, target) if version is None else version
    first = spark.read.parquet(f"{target}/memories/version=0")
    rows = spark.read.schema(first.schema.add("version", "long")).parquet(f"{target}/memories").where(F.col("version") <= upto).drop("version")
    kind = dict(rows.dtypes)["id"]
    hits = spark.read.schema(HITS.format(id=kind)).parquet(f"{target}/hits").where(F.col("version") <= upto)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("times")))
    sums = hits.groupBy("id").agg(of("reinforce").alias("_n"), of("recall").alias("_r"), F.max(F.when(F.col("kind") == "reinforce", F.col("at"))).alias("_at"), F.max("at").alias("_used"))
    n, r, on = F.coalesce("_n", F.lit(0)), F.coalesce("_r", F.lit(0)), F.col("_used").isNotNull()
    raised = F.least(F.lit(1.0), F.coalesce("strength", F.col("importance") / F.lit(5.0)) + n * P.EXPLICIT_INCREMENT + r * P.RECALL_INCREMENT)
    count = F.coalesce("reinforcement_count", F.lit(0))
    return rows.join(sums, "id", "left").withColumns({
        "decay_rate": F.when((n > 0) & (count == 0), F.lit(P.CONSOLIDATED_DECAY_RATE)).otherwise(F.col("decay_rate")), "reinforcement_count": (count + n).cast("int"),
        "recall_count": (F.coalesce("recall_count", F.lit(0)) + r).cast("int"), "strength": F.when(on, raised).otherwise(F.col("strength")),
        "last_reinforced_at": F.coalesce("_at", "last_reinforced_at"),
    }).select(*rows.columns)


def commit_batch(spark: SparkSession, target: str, run: str, batch: int, write: Callable[[int, int], None]) -> bool:
    """Runs write(last version, new version) and commits it, unless this batch of this run is committed already."""
    done = commits(spark, target)
    if not done.where((F.col("run") == run) & (F.col("batch") == batch)).isEmpty():
        return False
    last = current_version(spark, target)
    write(last, last + 1)
    _append(spark.createDataFrame([(last + 1, run, batch)], "number long, run string, batch long").coalesce(1), target, "commits", last + 1)
    return True


def _run_of(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def ingest_memories(stream: DataFrame, target: str, checkpoint: str, now: Column | None = None, most: float = P.DEDUP_DISTANCE):
    """A writer that adds a stream's rows (seq, id, fact, embedding, importance, ...) to a table: each batch is resolved against the table and itself, in the order of seq.

    Only the facts' keys and the vectors of stored memories are read.  New rows become memories, repeats become hits.
    """
    at = F.current_timestamp() if now is None else now

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession

        def add(last: int, version: int) -> None:
            rows = written(batch)
            held = memories(spark, target, last)
            stored = held.select("id", "fact", "embedding", "status", "ephemeral")
            result = written(N.resolved(rows.select("seq", "id", "fact", "embedding"), stored, most))
            fresh = N.as_new(rows.join(result.where("how = 'new'").select("id"), "id", "left_semi").drop("seq"), at)
            shape = held.limit(0)
            missing = [c for c in shape.columns if c not in fresh.columns]
            fresh = fresh.withColumns({c: F.lit(None) for c in missing}).select(*[F.col(f.name).cast(f.dataType) for f in shape.schema])
            _append(fresh, target, "memories", version)
            hits = result.where("how <> 'new'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("times"))
            _append(hits.select("id", F.lit("reinforce").alias("kind"), "times", at.alias("at")), target, "hits", version)

        commit_batch(spark, target, _run_of(checkpoint), n, add)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def recall_after(responses: DataFrame, target: str, checkpoint: str, now: Column | None = None):
    """A writer that counts what searches answered: rows (id) of responses become recalls, apart from the search itself; ids that the table lacks are dropped."""
    at = F.current_timestamp() if now is None else now

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession

        def add(last: int, version: int) -> None:
            known = memories(spark, target, last).select("id")
            hits = batch.groupBy("id").agg(F.count("*").alias("times")).join(known, "id", "left_semi")
            _append(hits.select("id", F.lit("recall").alias("kind"), "times", at.alias("at")), target, "hits", version)
            _append(memories(spark, target, last).limit(0), target, "memories", version)

        commit_batch(spark, target, _run_of(checkpoint), n, add)

    return responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# --- maintenance -------------------------------------------------------------------------------

RUN_LOG = "job string, ran_at timestamp, ok boolean, detail string"
#: When each job is due, from the moment and its last successful run: the short rest every six hours; the long rest at three, or as soon as it is overdue.
DUE = {"short_rest": short_due, "long_rest": long_due}


def due_jobs(log: DataFrame, now: Column, jobs: dict[str, Callable] | None = None) -> DataFrame:
    """(job, last, due) of each job.  Only successful runs count; a job that never ran is due; however many windows were missed, it is due once."""
    jobs = DUE if jobs is None else jobs
    names = log.sparkSession.createDataFrame([(j, i) for i, j in enumerate(jobs)], "job string, place int")
    last = log.where("ok").groupBy("job").agg(F.max("ran_at").alias("last"))
    rows = names.join(last, "job", "left").withColumn("now", now)
    due = F.coalesce(*[F.when(F.col("job") == j, F.col("last").isNull() | rule(F.col("now"), F.col("last"))) for j, rule in jobs.items()])
    return rows.select("job", "place", "last", due.alias("due"))


def catch_up(spark: SparkSession, log: str, now: datetime, work: dict[str, Callable[[datetime], str | None]], rules: dict[str, Callable] | None = None) -> list[tuple[str, bool]]:
    """Runs the due jobs, each once, in the order of the rules, and logs them; (job, ok) of those run.

    A job that fails is logged as such and is due again; it doesn't keep the others from running.  A job without work is left out.
    """
    held = run_log(spark, log)
    due = due_jobs(held, F.lit(now.isoformat(sep=" ")).cast("timestamp"), rules).where("due").orderBy("place").collect()
    ran = []
    for job in (r["job"] for r in due if r["job"] in work):
        try:
            ok, detail = True, work[job](now)
        except Exception as e:  # noqa: BLE001  (whatever a job raises is its result)
            ok, detail = False, f"{type(e).__name__}: {e}"[:1000]
        spark.createDataFrame([(job, now, ok, detail)], RUN_LOG).coalesce(1).write.mode("append").parquet(log)
        ran.append((job, ok))
    return ran


def run_log(spark: SparkSession, log: str) -> DataFrame:
    """The runs so far; a log that doesn't exist yet is begun."""
    spark.createDataFrame([], RUN_LOG).coalesce(1).write.mode("ignore").parquet(log)
    return spark.read.schema(RUN_LOG).parquet(log)
