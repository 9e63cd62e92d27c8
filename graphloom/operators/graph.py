"""Joins and traversals over typed edges (src, dst, properties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..storage import written


#: Edges of a task where nodes are reached step by step, about.
TASK_EDGES = 100_000


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the ids named in a table (column id)."""
    return nodes.join(ids.select("id").distinct(), "id")


def expand(edges: DataFrame, nodes: DataFrame, how: str = "inner", end: str = "dst") -> DataFrame:
    """Edges with the columns of the nodes at one end."""
    return edges.join(nodes.withColumnRenamed("id", end), end, how)


def without(nodes: DataFrame, edges: DataFrame, end: str = "src") -> DataFrame:
    """Nodes that have no edge at that end."""
    return nodes.join(edges.select(F.col(end).alias("id")), "id", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Each linked pair once, a < b, whichever way its edges run."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()


def typed(**tables: DataFrame) -> DataFrame:
    """Edge tables as one, with their names in `type`."""
    out = None
    for name, df in tables.items():
        part = df.select("src", "dst", F.lit(name).alias("type"), F.col("weight") if "weight" in df.columns else F.lit(None).cast("double").alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids, loops left out."""
    a, b = ids.select(F.col("id").alias("src")).distinct(), ids.select(F.col("id").alias("dst")).distinct()
    return edges.where("src <> dst").join(a, "src", "left_semi").join(b, "dst", "left_semi")


def neighbours(hits: DataFrame, edges: DataFrame, targets: DataFrame, cap: int = P.NEIGHBOUR_CAP) -> DataFrame:
    """src, id, type, weight (4 places): the heaviest edges of each hit to targets that aren't hits, `cap` a hit."""
    near = edges.join(hits.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    near = near.join(hits.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti").join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    w = W.partitionBy("src").orderBy(F.desc("weight"), "dst", "type")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("src", F.col("dst").alias("id"), "type", F.round("weight", 4).alias("weight"))


def reach(starts: DataFrame, edges: DataFrame, hops: int, least: int = 1) -> DataFrame:
    """(start, id): nodes within `least` to `hops` steps.  A fixed number of joins, each with its repeats removed, so growth is bounded by the nodes reached.

    Tasks grow in number with the edges (TASK_EDGES each), so that one's memory doesn't.
    """
    if not 0 <= hops <= P.MAX_HOPS and least:
        raise ValueError(f"hops run from 0 to {P.MAX_HOPS}")
    step = written(edges.select("src", "dst").distinct())
    parts = -(-step.count() // TASK_EDGES)
    wide = parts > int(step.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, *keys: df.repartition(parts, *keys) if wide else df
    now = starts.select(F.col("id").alias("start"), F.col("id")).distinct()
    out = now if least == 0 else None
    for i in range(1, hops + 1):
        now = deal(now, "id").join(deal(step, "src"), F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"))
        if i < hops:
            now = deal(now, "start", "id").distinct()
        if i >= least:
            out = now if out is None else out.unionByName(now)
    return deal(out if out is not None else now.limit(0), "start", "id").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[x for x in edges.columns if x not in ("src", "dst")])


def closure(starts: DataFrame, contains: DataFrame, most: int | None = None, upward: bool = True) -> DataFrame:
    """(start, id, depth): every ancestor (or descendant) and the node itself, at its least depth.

    One round a level: the last level's nodes take a step, and what a start has seen before goes, so cycles end and
    nodes with many paths to them cost one row each.  With `most` a hierarchy deeper than that raises.  Null ids reach nothing.
    """
    edges = (reversed_edges(contains) if upward else contains).select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    front = seen = written(starts.where("id IS NOT NULL").select(F.col("id").alias("start"), "id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        step = front.join(edges, front.id == edges.src).select("start", F.col("dst").alias("id")).distinct()
        front = written(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        if most is not None and depth > most:
            raise ValueError(f"the hierarchy is deeper than {most}")
        seen = seen.unionByName(front)


def trace_up(controls: DataFrame, contains: DataFrame, addresses: DataFrame, precepts: DataFrame, fulfils: DataFrame, attributes: DataFrame, requires: DataFrame) -> DataFrame:
    """(start, kind, id, name): precepts that a control or its ancestors address and that fulfil an attribute, those attributes, and the norms that require such a precept."""
    up = closure(controls, contains).select("start", F.col("id").alias("src"))
    met = up.join(addresses, "src").select("start", F.col("dst").alias("precept")).distinct()
    paths = met.join(fulfils.select(F.col("src").alias("precept"), F.col("dst").alias("attribute")), "precept")
    named = lambda df, col, nodes, kind: df.select("start", F.col(col).alias("id")).distinct().join(nodes.select("id", "name"), "id").select("start", F.lit(kind).alias("kind"), "id", "name")
    norms = paths.select("start", "precept").distinct().join(requires.select(F.col("src").alias("norm"), F.col("dst").alias("precept")), "precept")
    return (
        named(paths, "precept", precepts, "precept").unionByName(named(paths, "attribute", attributes, "attribute"))
        .unionByName(norms.select("start", F.lit("norm").alias("kind"), F.col("norm").alias("id"), F.col("norm").cast("string").alias("name")).distinct())
    )


def trace_down(controls: DataFrame, supports: DataFrame, has_chunk: DataFrame, about_control: DataFrame, org=None) -> DataFrame:
    """(control, kind, id, items): chunks that support a control by document, and its evidence and gap memories of an organisation or of none."""
    key = controls.select(F.col("id").alias("dst")).distinct()
    chunks = supports.join(key, "dst", "left_semi").select(F.col("dst").alias("control"), F.col("src").alias("chunk"))
    docs = chunks.join(has_chunk.select(F.col("src").alias("document"), F.col("dst").alias("chunk")), "chunk")
    by_doc = docs.groupBy("control", F.lit("document").alias("kind"), F.col("document").cast("string").alias("id")).agg(F.countDistinct("chunk").alias("items"))
    about = about_control.join(key, "dst", "left_semi").where(F.col("relationship_type").isin("evidence", "gap"))
    if org is not None:
        about = about.where(F.col("org_id").isNull() | (F.col("org_id") == F.lit(org)))
    memories = about.groupBy(F.col("dst").alias("control"), F.col("relationship_type").alias("kind"), F.lit(None).cast("string").alias("id")).agg(F.countDistinct("src").alias("items"))
    return by_doc.unionByName(memories)


def hydrate(memories: DataFrame, about_control: DataFrame, cites_doc: DataFrame) -> DataFrame:
    """Memories with the controls and documents they link to, as sorted lists."""
    controls = about_control.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.col("dst").alias("id"), "relationship_type"))).alias("controls"))
    docs = cites_doc.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("documents"))
    return memories.join(controls, "id", "left").join(docs, "id", "left")


def top_by(df: DataFrame, k: int, by: list[Column], *keys: str) -> DataFrame:
    """The first k rows of each group in the given order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("_rank") <= k).drop("_rank")


def first_seen(sections: list[tuple[str, DataFrame]], key: str = "id", order: str = "rank") -> DataFrame:
    """Ranked sections as one table; a key stays only in the first section that holds it, at its best rank."""
    out = None
    for i, (name, df) in enumerate(sections):
        part = df.select(key, order).withColumn("section", F.lit(name)).withColumn("_p", F.lit(i))
        out = part if out is None else out.unionByName(part)
    w = W.partitionBy(key).orderBy("_p", order)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def sequence_chain(chunks: DataFrame, key: str = "doc_id", order: str = "sequence", ok: str = "stored") -> DataFrame:
    """HAS_NEXT edges between neighbours that were both stored; a skipped chunk breaks the chain."""
    w = W.partitionBy(key).orderBy(order)
    prev = chunks.withColumn("_prev", F.lag("id").over(w)).withColumn("_ok", F.lag(ok).over(w))
    return prev.where(F.col(ok) & F.col("_ok")).select(F.col("_prev").alias("src"), F.col("id").alias("dst"))


def forward_filled(df: DataFrame, columns: list[str], order: str, *keys: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in columns})


def capped_log(log: DataFrame, cap: int = P.LOG_CAP, at: str = "ran_at", *keys: str) -> DataFrame:
    """The latest `cap` entries of each log."""
    w = W.partitionBy(*keys).orderBy(F.desc(at)) if keys else W.partitionBy(F.lit(0)).orderBy(F.desc(at))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n") if keys else log.orderBy(F.desc(at)).limit(cap)
