"""Graph writes as functions from one snapshot of a table to the next.

Parquet has no update in place: each function returns the new table, and counts where
the caller needs them.  Joins are on keys; every change is a column expression, so a
table that doesn't change is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import c, days_between, decayed
from .graph import inside


def create_only(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key exists already change nothing."""
    keys = list(keys or ("id",))
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",), overwrite: tuple[str, ...] | None = None, keep_if_null: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """New keys are added; of existing ones the `overwrite` columns (None: all but created_at) take the new values, or the old where the new is null and named in keep_if_null."""
    n = new.dropDuplicates(list(keys)).withColumn("_new", F.lit(True)).alias("n")
    o = old.withColumn("_old", F.lit(True)).alias("o")
    both = o.join(n, list(keys), "full_outer")
    cols = []
    for name, kind in old.dtypes:
        if name in keys:
            cols.append(F.col(name))
            continue
        was, now = F.col(f"o.{name}"), F.col(f"n.{name}") if name in new.columns else F.lit(None).cast(kind)
        changes = name in new.columns and (name != "created_at" if overwrite is None else name in overwrite)
        value = F.when(F.col("_new").isNull(), was).when(F.col("_old").isNull(), now)
        value = value.otherwise((F.coalesce(now, was) if name in keep_if_null else now) if changes else was)
        if defaults and name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        cols.append(value.alias(name))
    return both.select(*cols)


def with_ends(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges whose two nodes exist; the others are dropped."""
    return edges.join(src.select(F.col("id").alias("src")), "src", "left_semi").join(dst.select(F.col("id").alias("dst")), "dst", "left_semi")


def archived(nodes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Active nodes named are archived; the state of others doesn't change."""
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    go = F.coalesce(F.col("_hit"), F.lit(False)) & (F.coalesce(F.col("status"), F.lit("active")) == "active")
    out = hit.withColumn("status", F.when(go, "archived").otherwise(F.col("status")))
    return (out.withColumn("archived_at", F.when(go, now).otherwise(F.col("archived_at"))) if "archived_at" in nodes.columns else out).drop("_hit")


def restored(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "archived"), "active").otherwise(F.col("status"))).drop("_hit")


def deleted(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids and whatever hangs on them."""
    gone = ids.select("id").distinct()
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), e.select(*edges.columns)


def purge_ephemeral(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, purged)."""
    e = F.coalesce(F.col("ephemeral"), F.lit(False))
    return nodes.where(~e), nodes.where(e)


#: How the properties of edges that fall together are joined.
MERGE_RULES = {"weight": F.max, "activation_count": F.sum, "last_activated_at": F.max, "decay_rate": F.min}


def rewire(edges: DataFrame, merges: DataFrame, both_ends: bool = True) -> DataFrame:
    """Edges with each merged id (merges: source, target) replaced by its target; edges that fall together become one.

    Edges between a source and its own target are left as they are.  Weight is the greatest, activations are summed (none counts 0), the
    last activation is the latest, the decay rate the least.
    """
    m = merges.select("source", "target")
    a = edges.join(m.select(F.col("source").alias("src"), F.col("target").alias("_ts")), "src", "left")
    if both_ends:
        a = a.join(m.select(F.col("source").alias("dst"), F.col("target").alias("_td")), "dst", "left")
    else:
        a = a.withColumn("_td", F.lit(None).cast(dict(a.dtypes)["_ts"]))
    src, dst = F.coalesce("_ts", "src"), F.coalesce("_td", "dst")
    moved = a.withColumn("_loop", src == dst).withColumn("_s", F.when(F.col("_loop"), F.col("src")).otherwise(src)).withColumn("_d", F.when(F.col("_loop"), F.col("dst")).otherwise(dst))
    rules = []
    for name in edges.columns:
        if name in ("src", "dst"):
            continue
        rule = MERGE_RULES.get(name, F.min)
        rules.append((F.coalesce(rule(name), F.lit(0)).cast("int") if name == "activation_count" else rule(name)).alias(name))
    grouped = moved.groupBy(F.col("_s").alias("src"), F.col("_d").alias("dst"))
    return (grouped.agg(*rules) if rules else grouped.agg(F.count("*").alias("_n")).drop("_n")).select(*edges.columns)


def merge_memories(nodes: DataFrame, merges: DataFrame, **edges: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Nodes with the sources marked merged, the edge tables rewired, and the MERGED_INTO edges."""
    m = merges.select(F.col("source").alias("id"), F.col("target").alias("_t"))
    out = nodes.join(m, "id", "left").withColumn("status", F.when(F.col("_t").isNotNull(), "merged").otherwise(F.col("status")))
    if "superseded_by" in nodes.columns:
        out = out.withColumn("superseded_by", F.coalesce(F.col("_t").cast("string"), F.col("superseded_by")))
    only_src = {"about", "in_strand"}
    return out.drop("_t"), {n: rewire(e, merges, n not in only_src) for n, e in edges.items()}, merges.select(F.col("source").alias("src"), F.col("target").alias("dst"))


def rewire_keep_first(edges: DataFrame, merges: DataFrame, end: str = "dst") -> DataFrame:
    """Edges of merged nodes moved to their targets; where the target has the edge already, its properties win."""
    m = merges.select(F.col("source").alias(end), F.col("target").alias("_t"))
    moved = edges.join(m, end, "left").withColumn("_own", F.col("_t").isNull()).withColumn("_end", F.coalesce("_t", end))
    other = "src" if end == "dst" else "dst"
    rest = [x for x in edges.columns if x not in ("src", "dst")]
    best = moved.groupBy(F.col(other), F.col("_end")).agg(F.max_by(F.struct(F.lit(1).alias("_"), *[F.col(x) for x in rest]), F.struct(F.col("_own"), F.hash(F.col(end)))).alias("_p"))
    return best.select(F.col(other), F.col("_end").alias(end), *[F.col(f"_p.{x}").alias(x) for x in rest]).select(*edges.columns)


def merge_threats(threats: DataFrame, merges: DataFrame, identifies: DataFrame, techniques: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Threats with sources archived, both edge tables rewired, and per source how many edges it had."""
    m = merges.select(F.col("source").alias("id"), F.col("target").alias("_t"))
    hit = F.col("_t").isNotNull()
    out = threats.join(m, "id", "left").withColumn("archived", hit | F.coalesce(F.col("archived"), F.lit(False)) if "archived" in threats.columns else hit)
    out = out.withColumn("merged_into", F.col("_t").cast("string")).withColumn("merged_at", F.when(hit, now)).drop("_t")
    n_i = identifies.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("identifies_rewired"))
    n_t = techniques.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("techniques_rewired"))
    counts = m.select("id").join(n_i, "id", "left").join(n_t, "id", "left").na.fill(0)
    return out, rewire_keep_first(identifies, merges, "dst"), rewire_keep_first(techniques, merges, "src"), counts


def replace_links(edges: DataFrame, ids: DataFrame, new: DataFrame) -> DataFrame:
    """All edges of the named sources give way to the new ones."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select(*edges.columns).unionByName(new.select(*edges.columns))


def current_strength() -> Column:
    """The strength, or a fifth of the importance where there is none yet; null without either."""
    return F.coalesce(F.col("strength"), F.col("importance") / F.lit(5.0))


def recalled(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Recall: count and strength rise a little, and so do the edges inside the recalled set."""
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    on = F.col("_hit").isNotNull()
    out = hit.withColumn("recall_count", F.coalesce("recall_count", F.lit(0)) + F.when(on, 1).otherwise(0)).withColumn("strength", F.when(on, F.least(F.lit(1.0), current_strength() + P.RECALL_INCREMENT)).otherwise(F.col("strength")))
    return out.drop("_hit"), strengthened(edges, ids, now, P.EDGE_RECALL_INCREMENT)


def strengthened(edges: DataFrame, ids: DataFrame, now: Column, by: float) -> DataFrame:
    within = inside(edges, ids).select("src", "dst").distinct().withColumn("_in", F.lit(1))
    e = edges.join(within, ["src", "dst"], "left")
    on = F.col("_in").isNotNull()
    e = e.withColumn("weight", F.when(on, F.least(F.lit(1.0), F.coalesce("weight", F.lit(P.DEFAULT_EDGE_WEIGHT)) + by)).otherwise(F.col("weight")))
    if "activation_count" in edges.columns:
        e = e.withColumn("activation_count", F.when(on, F.coalesce("activation_count", F.lit(0)) + 1).otherwise(F.col("activation_count")))
    if "last_activated_at" in edges.columns:
        e = e.withColumn("last_activated_at", F.when(on, now).otherwise(F.col("last_activated_at")))
    return e.select(*edges.columns)


def reinforced(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Explicit reinforcement: strength rises by 0.2, and the first time the decay rate falls to the consolidated one."""
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    on = F.col("_hit").isNotNull()
    n = F.coalesce("reinforcement_count", F.lit(0))
    out = hit.withColumn("decay_rate", F.when(on & (n == 0), F.lit(P.CONSOLIDATED_DECAY_RATE)).otherwise(F.col("decay_rate")))
    out = out.withColumn("reinforcement_count", n + F.when(on, 1).otherwise(0)).withColumn("strength", F.when(on, F.least(F.lit(1.0), current_strength() + P.EXPLICIT_INCREMENT)).otherwise(F.col("strength")))
    if "last_reinforced_at" in nodes.columns:
        out = out.withColumn("last_reinforced_at", F.when(on, now).otherwise(F.col("last_reinforced_at")))
    return out.drop("_hit"), strengthened(edges, ids, now, P.EDGE_EXPLICIT_INCREMENT)


def decay_nodes(nodes: DataFrame, edges: DataFrame, now: Column, anchor: str = "last_reinforced_at", floor: str = "min_strength") -> DataFrame:
    """Strength decayed since its anchor, which is then set to now, slowed by incoming edges.  Rows without a strength, a rate or an anchor stay."""
    on = F.col("strength").isNotNull() & F.col("decay_rate").isNotNull() & F.col(anchor).isNotNull()
    w = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("_in"))
    out = nodes.join(w, "id", "left")
    new = decayed("strength", "decay_rate", days_between(now, anchor), F.coalesce(F.col(floor), F.lit(0.0)), F.coalesce("_in", F.lit(0.0)))
    return out.withColumns({"strength": F.when(on, new).otherwise(F.col("strength")), anchor: F.when(on, now).otherwise(F.col(anchor))}).drop("_in")


def decay_edges(edges: DataFrame, now: Column) -> DataFrame:
    """Weight decayed since the last activation, which is then set to now.  Edges without a weight or a rate never decay."""
    on = F.col("weight").isNotNull() & F.col("decay_rate").isNotNull() & F.col("last_activated_at").isNotNull()
    new = decayed("weight", "decay_rate", days_between(now, "last_activated_at"), F.lit(0.0))
    return edges.withColumn("weight", F.when(on, new).otherwise(F.col("weight"))).withColumn("last_activated_at", F.when(on, now).otherwise(F.col("last_activated_at")))


def prune_candidates(edges: DataFrame, now: Column, weight: float = P.HARD_PRUNE_FLOOR, days: int = P.HARD_PRUNE_DAYS) -> DataFrame:
    return edges.where((F.col("weight") < weight) & (days_between(now, "last_activated_at") >= days))


def weak_edges(edges: DataFrame, below: float = P.WEAK_EDGE, limit: int = 200) -> DataFrame:
    return edges.where(F.col("weight") < below).orderBy("weight", "src", "dst").limit(limit)


def short_rest(nodes: DataFrame, edges: DataFrame, now: Column, days: int = P.SHORT_REST_DAYS) -> tuple[DataFrame, DataFrame]:
    """Decay of what was recalled or used lately, and of edges inside that set; everything else stays, rows without a strength, a rate or an anchor among it."""
    lately = (F.coalesce("recall_count", F.lit(0)) > 0) | (days_between(now, "last_used_at") <= days)
    lately = F.coalesce(lately & F.col("strength").isNotNull() & F.col("decay_rate").isNotNull() & F.col("last_reinforced_at").isNotNull(), F.lit(False))
    scope = nodes.where(lately).select("id")
    done = decay_nodes(nodes.where(lately), edges, now)
    rest = nodes.where(~lately)
    within = inside(edges, scope).select("src", "dst").distinct()
    e = decay_edges(edges.join(within, ["src", "dst"], "left_semi"), now).unionByName(edges.join(within, ["src", "dst"], "left_anti"))
    return done.unionByName(rest), e


def long_rest(nodes: DataFrame, edges: DataFrame, now: Column, prune: bool = True, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report): decay first, which resets the activation times, then pruning of what is still weak and old.  A dry run reports on the edges as they were."""
    n, e = (nodes, edges) if dry_run else (decay_nodes(nodes, edges, now), decay_edges(edges, now))
    gone = prune_candidates(e, now)
    report = gone.agg(F.count("*").alias("prune_candidates")).withColumn("edges_pruned", F.col("prune_candidates")).withColumn("pruned", F.when(F.lit(prune and not dry_run), F.col("prune_candidates")).otherwise(0))
    if prune and not dry_run:
        e = e.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*edges.columns)
    return n, e, report


def preserved_text(old: DataFrame, new: DataFrame, column: str = "body") -> DataFrame:
    """Fresh rows whose non-empty earlier text wins."""
    was = old.select("id", F.col(column).alias("_was"))
    return new.join(was, "id", "left").withColumn(column, F.coalesce(F.when(F.col("_was") != "", F.col("_was")), F.col(column))).drop("_was")


def backfilled(df: DataFrame, **defaults) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), v if isinstance(v, Column) else F.lit(v)) for n, v in defaults.items()})


def annotated(nodes: DataFrame, marks: DataFrame, *columns: str) -> DataFrame:
    """Nodes with the marked columns where a mark is given."""
    m = marks.select("id", *[F.col(x).alias(f"_{x}") for x in columns])
    out = nodes.join(m, "id", "left")
    return out.withColumns({x: F.coalesce(F.col(f"_{x}"), F.col(x)) if x in nodes.columns else F.col(f"_{x}") for x in columns}).drop(*[f"_{x}" for x in columns])


def new_memory_edges(new: DataFrame, strands: DataFrame, default: str = "inbox") -> DataFrame:
    """IN_STRAND rows of new memories (column strands: a list): weight 1 to each known strand, or 0.3 to the inbox where none is known."""
    named = new.select("id", F.explode_outer("strands").alias("dst")).join(strands.select(F.col("id").alias("dst"), F.lit(True).alias("_known")), "dst", "left")
    ok = named.where("_known").select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    rest = new.select(F.col("id").alias("src")).join(ok.select("src"), "src", "left_anti").select("src", F.lit(default).alias("dst"), F.lit(P.INBOX_WEIGHT).alias("weight"))
    return ok.unionByName(rest)


def task_scores(tasks: DataFrame) -> DataFrame:
    from ..functions.scalar import priority_score

    return tasks.withColumn("priority_score", priority_score(c("value"), c("effort")))
