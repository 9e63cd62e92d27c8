"""Listings, logs, crosswalks, tasks and other operators on records."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import priority_score
from .mutations import deleted, replace_links, with_ends
from .similarity import components

#: Relations between tasks.
TASK_RELATIONS = ("BLOCKS", "DEPENDS_ON")
#: Words left of this belong to the watermark; a first word left of VERSO stands on a left-hand page.
WATERMARK, VERSO = 30, 55


def listing(nodes: DataFrame, *order, name: str | None = None) -> DataFrame:
    """The nodes in an order; where a name column is given, nodes without one are hidden."""
    return (nodes.where(F.col(name).isNotNull()) if name else nodes).orderBy(*order)


def chunks_by_confidence(supports: DataFrame) -> DataFrame:
    """Chunks that support a control, the surest first, ties by id."""
    return supports.orderBy(F.desc("confidence"), "src", "dst")


def collected(edges: DataFrame) -> DataFrame:
    """(id, ends, first): the distinct targets of each source, sorted, and the smallest as its first."""
    ends = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("ends"))
    return ends.withColumn("first", F.get("ends", 0))


def operation_line() -> Column:
    """A line of the operation log; what an entry lacks is unknown, or left out where it is optional."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("unknown"))
    some = lambda name: F.when(F.length(name) > 0, F.concat(F.lit(f"  {name}: "), F.col(name)))
    return F.concat_ws("", F.concat_ws("  ", known("ran_at"), known("operation"), known("memory_id")), some("fields_updated"), some("target_id"))


def maintenance_line() -> Column:
    """A line of the maintenance log; counts of zero are left out but for nodes and edges."""
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("string")
    some = lambda name, what: F.when(F.col(name) != 0, F.concat(F.lit(", "), F.col(name).cast("string"), F.lit(f" edges {what}")))
    at = F.translate(F.substring(F.coalesce("ran_at", F.lit("unknown")), 1, 19), "T", " ")
    name = F.translate(F.coalesce("operation", F.lit("unknown")), "_", "-")
    dry = F.when(F.coalesce("dry_run", F.lit(False)), " (dry-run)")
    return F.concat_ws("", F.lit("  "), at, F.lit("  "), name, dry, F.lit(": "), n("nodes_affected"), F.lit(" nodes, "), n("edges_affected"), F.lit(" edges decayed"), some("edges_discovered", "discovered"), some("edges_pruned", "pruned"))


def crosswalk(records: DataFrame, nodes: DataFrame, prefix: str, source: Column, key: str = "key") -> DataFrame:
    """(src, dst): records (with `key`, the target's name in capitals) resolved to subcategory nodes whose id is the prefix and that name in small letters.

    `source` makes the source's id from a record.  Records without a source, without a key or of an unknown key are dropped.
    """
    known = nodes.where(F.col("id").startswith(prefix) & (F.col("level") == "subcategory"))
    known = known.select(F.col("id").alias("dst"), F.upper(F.expr(f"substring(id, {len(prefix) + 1})")).alias("_key"))
    named = records.select(source.alias("src"), F.trim(key).alias("_key")).where((F.length("src") > 0) & (F.length("_key") > 0))
    return named.join(known, "_key").select("src", "dst")


def static_crosswalk(nodes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(src, dst) of a fixed table whose two nodes exist, each once."""
    fixed = nodes.sparkSession.createDataFrame(pairs, "src string, dst string").distinct()
    return with_ends(fixed, nodes, nodes)


def semantic_groups(nodes: DataFrame, pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """(id, canonical) of groups that the pairs (a, b) join, the members of exact groups (ids in `exact`) left out first.

    Canonical is the oldest, then the most important (none counts as 3), then the smallest id.
    """
    left = pairs.join(exact.select(F.col("id").alias("a")).distinct(), "a", "left_anti").join(exact.select(F.col("id").alias("b")).distinct(), "b", "left_anti")
    members = components(left).join(nodes.select("id", "created_at", F.coalesce(F.nullif("importance", F.lit(0)), F.lit(3)).alias("importance")), "id")
    first = members.groupBy("root").agg(F.min(F.struct("created_at", (-F.col("importance")).alias("importance"), "id")).alias("f"))
    return members.join(first, "root").select("id", F.col("f.id").alias("canonical"))


def patched(nodes: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Nodes with the scalars of the patches (id and some of the nodes' columns); a null patches nothing, and what is patched is dated."""
    columns = [c for c in patches.columns if c != "id"]
    p = patches.select("id", F.struct(*columns).alias("_p"))
    hit = nodes.join(p, "id", "left")
    new = {c: F.coalesce(F.col(f"_p.{c}"), F.col(c)) for c in columns}
    return hit.withColumns(new | {"updated_at": F.when(F.col("_p").isNotNull(), now).otherwise(F.col("updated_at"))}).drop("_p")


def patched_links(edges: DataFrame, ids: DataFrame, new: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """All links of the patched ids give way to the new ones; to targets that don't exist there is none, where the targets are given."""
    if targets is not None:
        new = new.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return replace_links(edges, ids, new)


def patched_persons(about: DataFrame, patches: DataFrame, memories: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ABOUT edges, persons): the links of patched active memories to persons give way to person_ids of the patches (id, person_ids; null patches nothing), other links stay, and persons that don't exist yet are made."""
    live = memories.where("coalesce(status, 'active') = 'active'").select("id")
    meant = patches.where("person_ids IS NOT NULL").join(live, "id", "left_semi")
    new = meant.select(F.col("id").alias("src"), F.explode("person_ids").alias("dst")).where("dst IS NOT NULL")
    old = meant.select(F.col("id").alias("src")).distinct().withColumn("_patched", F.lit(True))
    person = persons.select(F.col("id").alias("dst")).distinct().withColumn("_person", F.lit(True))
    kept = about.join(old, "src", "left").join(person, "dst", "left").where("_patched IS NULL OR _person IS NULL").select(*about.columns)
    made = new.select(F.col("dst").alias("id")).distinct().join(persons, "id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), persons.unionByName(made, allowMissingColumns=True)


def patched_memories(memories: DataFrame, patches: DataFrame, now: Column, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Active memories with the patches' scalars; where fact or so_what is patched, text is put together and embedded anew.

    embed gives `embedding` to rows of (id, text).  A patch of nothing, or of a memory that isn't active or known, changes nothing.
    """
    live = memories.where("coalesce(status, 'active') = 'active'").select("id")
    columns = [c for c in patches.columns if c != "id"]
    says = functools.reduce(operator.or_, [F.col(c).isNotNull() for c in columns], F.lit(False))
    patches = patches.where(says).join(live, "id", "left_semi")
    out = patched(memories, patches, now)
    spoken = [c for c in ("fact", "so_what") if c in columns]
    if not spoken:
        return out
    anew = patches.where(functools.reduce(operator.or_, [F.col(c).isNotNull() for c in spoken])).select("id")
    text = F.concat_ws(" ", F.coalesce("fact", F.lit("")), F.nullif("so_what", F.lit("")))
    texts = out.join(anew, "id", "left_semi").select("id", text.alias("text"))
    fresh = embed(texts).select("id", F.col("text").alias("_text"), F.col("embedding").alias("_embedding"))
    new = out.join(fresh, "id", "left")
    return new.withColumns({"text": F.coalesce("_text", "text"), "embedding": F.coalesce("_embedding", F.col("embedding").cast("array<double>"))}).select(*out.columns)


def updated_tasks(tasks: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Tasks patched as nodes are; where value or effort is patched and both are known, the priority is computed anew."""
    axes = [F.col(c).isNotNull() for c in ("value", "effort") if c in patches.columns]
    touched = patches.select("id", functools.reduce(operator.or_, axes, F.lit(False)).alias("_t"))
    out = patched(tasks, patches, now).join(touched, "id", "left")
    score = F.coalesce(priority_score("value", "effort"), F.col("priority_score"))
    return out.withColumn("priority_score", F.when(F.col("_t"), score).otherwise(F.col("priority_score"))).drop("_t")


def linked_tasks(links: DataFrame, tasks: DataFrame, new: DataFrame, relation: str) -> DataFrame:
    """Links (src, dst, type) with the new ones between tasks that exist, each once."""
    if relation not in TASK_RELATIONS:
        raise ValueError(f"no relation between tasks: {relation}")
    return links.unionByName(with_ends(new.select("src", "dst"), tasks, tasks).withColumn("type", F.lit(relation))).distinct()


def deleted_tasks(tasks: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and links without the ids."""
    return deleted(tasks, links, ids)


def even_sample(rows: DataFrame, group: str, order: str, most: int = 10) -> DataFrame:
    """Of each group every s-th row in order, from the first on, `most` at most, where s is its size over `most`, rounded down, at least 1."""
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy(group)) / most))
    at = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    out = rows.withColumns({"_n": n, "_at": at})
    return out.where((F.col("_at") % F.col("_n") == 0) & (F.col("_at") < F.col("_n") * most)).drop("_n", "_at")


def length_stats(chunks: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, n, least, most, mean, p50, p95) of the lengths: the median, and the length at place 0.95 n from 0.

    Lengths are counted before they are ordered, so that no group's rows gather in one task.
    """
    w = W.partitionBy(group).orderBy("l")
    counts = chunks.where(F.col(text).isNotNull()).groupBy(group, F.length(text).alias("l")).agg(F.count("*").alias("k"))
    upto = counts.withColumns({"upto": F.sum("k").over(w), "n": F.sum("k").over(W.partitionBy(group))})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("l")))
    n = F.col("n")
    return upto.groupBy(group, "n").agg(
        F.min("l").alias("least"), F.max("l").alias("most"), (F.sum(F.col("l") * F.col("k")) / F.sum("k")).alias("mean"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("p50"), at(F.floor(n * F.lit(0.95))).alias("p95"),
    )


def page_words(words: DataFrame, page: str = "page", at: str = "at") -> DataFrame:
    """The words that are no watermark, each with its page's kind: a page whose first such word (of ties the leftmost) stands far left is a verso."""
    kept = words.where(F.col("x0") >= WATERMARK)
    kind = kept.groupBy(page).agg(F.min_by("x0", F.struct(at, "x0")).alias("_x")).select(page, F.when(F.col("_x") < VERSO, "verso").otherwise("recto").alias("kind"))
    return kept.join(kind, page)
