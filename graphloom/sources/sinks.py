"""Sinks: graph dump and restore, subgraph export, quarantine, embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cache_key
from ..operators.mutations import create_only, with_ends


def dump(memories: DataFrame, edges: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """All memories under path/nodes and every edge table, with its type, under path/edges."""
    memories.write.mode("overwrite").format(fmt).save(f"{path}/nodes")
    out = None
    for name, e in edges.items():
        rest = [x for x in e.columns if x not in ("src", "dst")]
        part = e.select(F.lit(name).alias("type"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.to_json(F.struct(*rest)).alias("props") if rest else F.lit("{}").alias("props"))
        out = part if out is None else out.unionByName(part)
    if out is not None:
        out.write.mode("overwrite").partitionBy("type").format(fmt).save(f"{path}/edges")


def restore(spark: SparkSession, path: str, old_nodes: DataFrame, old_edges: DataFrame, allowed: tuple[str, ...], fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges (type, src, dst, props)): dumped nodes with an id, and edges of the allowed types whose ends exist, added where missing."""
    nodes = create_only(old_nodes, spark.read.schema(old_nodes.schema).format(fmt).load(f"{path}/nodes").where("id is not null"))
    e = spark.read.format(fmt).load(f"{path}/edges").where(F.col("type").isin(*allowed)).where("src is not null and dst is not null")
    e = with_ends(e.select("type", "src", "dst", "props"), nodes.select(F.col("id").cast("string").alias("id")), nodes.select(F.col("id").cast("string").alias("id")))
    return nodes, create_only(old_edges, e.select("type", "src", "dst", "props"), "type", "src", "dst")


def subgraph(nodes: DataFrame, edges: DataFrame, where) -> tuple[DataFrame, DataFrame]:
    """The nodes that pass, and the edges between them."""
    n = nodes.where(where)
    ids = n.select("id")
    return n, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def quarantine(flagged: DataFrame, path: str, body: str = "body") -> None:
    flagged.select(F.sha2(F.col(body), 256).alias("key"), F.col(body).alias("body")).dropDuplicates(["key"]).write.mode("append").parquet(path)


def cached_embeddings(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with vectors where the cache has them, rows to embed)."""
    keyed = texts.withColumn("cache_key", cache_key(model, text))
    hit = keyed.join(cache.select(F.col("key").alias("cache_key"), F.col("embedding").alias("cached")), "cache_key", "left")
    return hit.where("cached is not null"), hit.where("cached is null").drop("cached")


def report(rows: DataFrame, line) -> DataFrame:
    """One text per section: its lines in order."""
    return rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
