"""Exact vector search and similarity joins.

Single queries are a sort-limit over one distance column.  Joins of many vectors with
many run in blocks: both sides are cut into blocks and each pair of blocks is one group's
product, a table with itself only once for each two blocks.  Only pairs that pass leave the kernel, or sums over pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import params as P
from ..functions.scalar import cosine, score

#: Vectors of a side that one task holds at a time, about, and rows of a product that are there at once.
BLOCK, ROWS = 10_000, 512
#: Most rows that a strip's pairs leave a task in at a time.
SENT = 1 << 16
#: The first columns of a product, whose k-th best similarity bounds that of all.
FIRST = 1024


def as_vector(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def top_k(nodes: DataFrame, vector, k: int, embedding: str = "embedding") -> DataFrame:
    """The k nearest nodes by cosine distance, ties by id; later filters don't bring in others.  The vector column goes."""
    near = nodes.where(F.col(embedding).isNotNull()).withColumn("distance", 1 - cosine(embedding, as_vector(vector)))
    return near.drop(embedding).orderBy("distance", "id").limit(k)


def search(nodes: DataFrame, vector, limit: int = 10, where: Column | None = None, prefilter: Column | None = None, min_score: float | None = None) -> DataFrame:
    """top_k, then the filters.  With prefilter the nearest are taken among the rows that pass it."""
    hits = top_k(nodes if prefilter is None else nodes.where(prefilter), vector, limit)
    if where is not None:
        hits = hits.where(where)
    hits = hits.withColumn("score", score("distance"))
    return hits if min_score is None else hits.where(F.col("score") >= min_score)


def overfetch(limit: int, factor: int = P.PERSON_OVERFETCH, cap: int = P.PERSON_OVERFETCH_CAP) -> int:
    return min(limit * factor, cap)


def nearest_within(nodes: DataFrame, vector, threshold: float) -> DataFrame:
    """The single nearest node, if it lies within the threshold."""
    return top_k(nodes, vector, 1).where(F.col("distance") <= threshold)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column at length one, a row each; a vector without length stays zero."""
    flat, n = pc.list_flatten(column).to_numpy().astype(np.float64), len(column)
    if len(set(pc.unique(pc.list_value_length(column)).to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    m = flat.reshape(n, len(flat) // n if n else 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _blocks(df: DataFrame, blocks: int) -> DataFrame:
    return df.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def _best(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k best entries, rounded to 12 places, ties to the first column; entries far below `least` may go missed."""
    bound = np.full(len(s), least - 1e-9)
    if s.shape[1] > k:  # the k-th best of some columns can't lie above the k-th best of all
        bound = np.maximum(bound, np.partition(np.nan_to_num(s[:, :FIRST], nan=-np.inf), -min(k, FIRST), axis=1)[:, -min(k, FIRST)] - 1e-9)
    i, j = np.nonzero(s >= bound[:, None])
    order = np.lexsort((j, -np.round(s[i, j], 12), i))
    i, j = i[order], j[order]
    at = np.arange(len(i)) - np.searchsorted(i, i)
    return i[at < k], j[at < k]


def similar_pairs(left: DataFrame, right: DataFrame, least: float, strict: bool = True, block: int = BLOCK, k: int | None = None) -> DataFrame:
    """(src, dst, similarity) of left and right rows (id, embedding) with similarity above `least` (at it too unless strict); with k, those of the k best of each src.

    Vectors must have one length; a vector without length is similar to nothing (0).  Each task holds two blocks of vectors and a strip of their product.
    """
    kind_l, kind_r = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    a = left.select("id", "embedding").where("embedding is not null")
    b = right.select("id", "embedding").where("embedding is not null")
    na, nb = (max(1, -(-side.count() // block)) for side in (a, b))
    na = max(na, -(-a.sparkSession.sparkContext.defaultParallelism // nb))
    a = _blocks(a, na).select(F.col("_block").alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("_c"), "id", "embedding")
    b = _blocks(b, nb).select(F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("_br"), F.col("_block").alias("_bc"), F.col("id").alias("other"), F.col("embedding").alias("vector"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("other")
        rows, columns, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if x.num_rows and y.num_rows:
            u, v = _unit(x.column("embedding")), _unit(y.column("vector"))
            for at in range(0, len(u), ROWS):
                s = u[at : at + ROWS] @ v.T
                i, j = np.nonzero(s > least if strict else s >= least) if k is None else _best(s, k, least)
                rows.append(i + at), columns.append(j), found.append(s[i, j])
        return pa.table({"src": x.column("id").take(pa.array(np.concatenate(rows))), "dst": y.column("other").take(pa.array(np.concatenate(columns))), "similarity": np.concatenate(found)})

    out = a.groupBy("_r", "_c").cogroup(b.groupBy("_br", "_bc")).applyInArrow(meet, f"src {kind_l}, dst {kind_r}, similarity double")
    if k is not None:
        from pyspark.sql import Window as W

        w = W.partitionBy("src").orderBy(F.desc(F.round("similarity", 12)), "dst")
        passes = F.col("similarity") > least if strict else F.col("similarity") >= least
        out = out.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & passes)
    return out


def pairs_among(nodes: DataFrame, found: Callable[[pa.Table, pa.Table], Callable], schema: str, block: int = BLOCK) -> DataFrame:
    """The rows that found() gives for every two of the nodes (id, embedding, what else it needs), each pair of ids once.

    found(x, y) of two blocks gives a function of strips: of `rows`, a slice of x, of their similarities with all of y, and where x and y are
    one block, of the entries that count (else None).  A strip's rows leave the task before the next strip is made, so a task never holds those of
    two blocks.  Blocks are in the order of ids, so that a pair's similarity is the same whenever it is computed.
    """
    v = nodes.where("id is not null and embedding is not null")
    blocks = max(-(-v.count() // block), math.ceil(math.sqrt(2 * v.sparkSession.sparkContext.defaultParallelism)))
    dealt = _blocks(v, blocks).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"_x": F.least("_block", "_other"), "_y": F.greatest("_block", "_other")}).drop("_other")
    empty = StructType.fromDDL(schema)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id")
        x, y = (t.filter(pc.equal(t.column("_block"), k)) for k in key)
        shape, t = to_arrow_schema(empty), None
        if x.num_rows and y.num_rows:
            u, w = _unit(x.column("embedding")), _unit(y.column("embedding"))
            x, y = x.drop_columns("embedding"), y.drop_columns("embedding")
            strip = found(x, y)
            own = pc.rank(x.column("id"), tiebreaker="dense").to_numpy() if key[0] == key[1] else None
            for at in range(0, len(u), ROWS):
                rows = slice(at, min(at + ROWS, len(u)))
                yield from strip(rows, u[rows] @ w.T, None if own is None else own > own[rows, None]).cast(shape).to_batches(SENT)

    return dealt.groupBy("_x", "_y").applyInArrow(meet, schema)


def neighbour_links(nodes: DataFrame, k: int = P.AUTO_LINK_K, most: float = P.AUTO_LINK_DISTANCE, existing: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): each node's k nearest, itself counted and then left out, within the distance (strictly); edges that exist already are left out."""
    near = similar_pairs(nodes, nodes, 1 - most - 1e-9, k=k).where("src <> dst").where((1 - F.col("similarity")) < most)
    out = near.select("src", "dst", F.col("similarity").alias("weight"))
    return out if existing is None else out.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def rediscovered(nodes: DataFrame, existing: DataFrame, strength: float = P.REDISCOVERY_STRENGTH, k: int = P.AUTO_LINK_K, most: float = P.AUTO_LINK_DISTANCE) -> DataFrame:
    """(src, dst, weight): edges that nodes of at least this strength lack to their nearest among all nodes."""
    strong = nodes.where((F.col("strength") >= strength) & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("id", "embedding")
    near = similar_pairs(strong, nodes.select("id", "embedding"), 1 - most - 1e-9, k=k).where("src <> dst").where((1 - F.col("similarity")) < most)
    return near.select("src", "dst", F.col("similarity").alias("weight")).join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def supports_links(chunks: DataFrame, controls: DataFrame, k: int = P.AUTO_SUPPORTS_K, most: float = P.AUTO_SUPPORTS_DISTANCE) -> DataFrame:
    """(src, dst, confidence): each chunk's k nearest controls within the distance."""
    near = similar_pairs(chunks, controls, 1 - most - 1e-9, k=k).where((1 - F.col("similarity")) < most)
    return near.select("src", "dst", F.round("similarity", 4).alias("confidence"))


def capacity(nodes: DataFrame, size: int = P.INDEX_CAPACITY) -> DataFrame:
    n = F.count("embedding")
    pct = F.round(100.0 * n / size, 2)
    return nodes.agg(n.alias("embedded"), pct.alias("utilisation_pct"), (100.0 * n / size >= P.CAPACITY_WARN).alias("near_capacity"))
