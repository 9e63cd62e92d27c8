"""Ingest plans: reports to threats, documents to chunks, memories with their edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as T
from ..functions.scalar import threat_id
from ..operators import aggregates as A
from ..operators.graph import sequence_chain
from ..operators.memory_ingest import resolved
from ..operators.mutations import create_only, with_ends
from ..storage import written


def threat_candidates(reports: DataFrame) -> DataFrame:
    """(report, pos, id, text, severity, trend, techniques) of the first occurrence of each sentence of a report (doc_id, body) that names a behaviour and a technique."""
    s = T.sentences(reports)
    first = s.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "sentence").orderBy("pos"))).where("_n = 1")
    hit = first.where(T.is_threat_candidate("sentence"))
    report = F.col("doc_id").cast("string")
    return hit.select(report.alias("report"), "pos", threat_id(report, "sentence").alias("id"), F.col("sentence").alias("text"), T.severity("sentence").alias("severity"), T.trend("sentence").alias("trend"), F.transform(T.techniques("sentence"), lambda t: t["technique"]).alias("techniques"))


def threats_from_reports(reports: DataFrame, threats: DataFrame, embed: Callable[[DataFrame], DataFrame], techniques: DataFrame, most: float = P.THREAT_DISTANCE) -> dict[str, DataFrame]:
    """New threats, IDENTIFIES and technique edges, and the quarantined sentences.

    embed adds an `embedding` column to rows of (id, text).  Candidates come report by report and sentence by sentence; one whose nearest threat, known
    or made before it, is nearer than the threshold is that threat.  A report's edge to a threat says what its last such sentence says; edges to unknown
    techniques are dropped.
    """
    clean, bad = T.guard(threat_candidates(reports), "text")
    clean = written(clean)
    vec = written(embed(clean.select("id", "text").dropDuplicates(["id"])))
    seq = F.concat_ws("\x00", "report", F.lpad(F.col("pos").cast("string"), 12, "0"))
    batch = clean.select(seq.alias("seq"), "id", F.col("text").alias("fact")).join(vec.select("id", "embedding"), "id")
    # Sentences of one text have one vector; the known threats' texts play no part.
    known = threats.select("id", F.lit(None).cast("string").alias("fact"), "embedding", F.lit("active").alias("status"), F.lit(False).alias("ephemeral"))
    found = written(resolved(batch, known, most, strict=True, key=lambda c: F.sha2(c, 256)))
    named = clean.join(found.select("id", F.col("target").alias("threat")), "id")
    last = F.max_by(F.struct("severity", "trend", F.substring("text", 1, 200).alias("source_terminology")), "pos")
    identifies = named.groupBy(F.col("report").alias("src"), F.col("threat").alias("dst")).agg(last.alias("e")).select("src", "dst", "e.*")
    maps = named.select(F.col("threat").alias("src"), F.explode("techniques").alias("dst")).distinct()
    return {
        "threats": vec.join(found.where("how = 'new'").select("id"), "id", "left_semi"), "identifies": identifies,
        "techniques": maps.join(techniques.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "quarantine": bad,
    }


def document_chunks(docs: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Chunks of Markdown documents that pass the guard, with HAS_CHUNK and HAS_NEXT edges; a quarantined chunk breaks the chain."""
    c = T.markdown_chunks(docs).withColumn("id", F.concat_ws(".", F.col("doc_id").cast("string"), "sequence")).withColumn("stored", ~T.has_injection("body"))
    kept = c.where("stored")
    return {
        "chunks": kept.drop("stored") if known is None else create_only(known, kept.drop("stored")),
        "has_chunk": kept.select(F.col("doc_id").alias("src"), F.col("id").alias("dst")),
        "has_next": sequence_chain(c),
        "quarantine": c.where("NOT stored").select(F.sha2("body", 256).alias("key"), "body"),
    }


def snapshot_delta(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, before, after, change) of table sizes around a job."""
    b, a = A.sizes(**before).withColumnRenamed("rows", "before"), A.sizes(**after).withColumnRenamed("rows", "after")
    out = b.join(a, "name", "full_outer").na.fill(0)
    return out.withColumn("change", F.col("after") - F.col("before"))


def wired_edges(edges: DataFrame, old: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges with both ends known, added where the pair has none yet."""
    return create_only(old, with_ends(edges, src, dst), "src", "dst")
