"""Composite reads: wake-up, search with its neighbours, tasks, reports, calibration, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import priority_score, truncated
from ..functions.text import has_injection
from ..operators import aggregates as A
from ..operators import cluster as C
from ..operators import graph as G
from ..operators import mutations as M
from ..operators import similarity as S
from ..operators import vector as V
from ..operators.communities import louvain
from ..operators.filters import active, any_of
from ..storage import written


def core_order():
    return [F.desc("importance"), F.desc_nulls_last("strength"), F.desc(F.coalesce("reinforcement_count", F.lit(0))), F.desc(F.coalesce("recall_count", F.lit(0))), F.desc("created_at"), F.asc("id")]


def ranked(df: DataFrame, order: list, limit: int) -> DataFrame:
    """id, rank of the first rows.  The sort keeps `limit` rows a partition; the window runs over those few only."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("id", "rank")


def about(memories: DataFrame, edges: DataFrame, node) -> DataFrame:
    """Memories with an ABOUT edge to the node, each once."""
    return memories.join(edges.where(F.col("dst") == F.lit(node)).select(F.col("src").alias("id")).distinct(), "id", "left_semi")


def wake_up(memories: DataFrame, topic=None, about_edges: DataFrame | None = None, agent=None, person=None, core: int = 4, topics: int = 5, companion: int = P.COMPANION_LIMIT, conversant: int = P.CONVERSANT_LIMIT) -> DataFrame:
    """(section, rank, id): core memories, topic recall, and the anchors: memories about the calling agent (companion) and about the person addressed (conversant), each only where one is named.

    An id stays in the first section that has it.
    """
    m = memories.where(active())
    sections = [("core", ranked(m, core_order(), core))]
    if topic is not None:
        hits = V.top_k(memories, topic, topics).where(active()).select("id", "distance")
        sections.append(("topic", hits.withColumn("rank", F.row_number().over(W.orderBy("distance", "id"))).select("id", "rank")))
    if agent is not None:
        sections.append(("companion", ranked(about(m, about_edges, agent), [F.desc("importance"), F.desc(F.coalesce("strength", F.lit(0.0))), F.asc("id")], companion)))
    if person is not None:
        sections.append(("conversant", ranked(about(m, about_edges, person), [F.desc("importance"), F.desc("created_at"), F.asc("id")], conversant)))
    return G.first_seen(sections).select("section", "rank", "id")


def project_section(memories: DataFrame, topic, project, r: int) -> DataFrame:
    """The best r of one project among the max(4 r, r) nearest."""
    near = V.top_k(memories, topic, max(4 * r, r)).where(F.col("project") == F.lit(project))
    return near.orderBy("distance", "id").limit(r)


def search_with_neighbours(memories: DataFrame, edges: DataFrame, vector, limit: int = 10, cap: int = 3) -> DataFrame:
    """(src, id, type, weight): the neighbours of a search's hits."""
    hits = V.search(memories, vector, limit, active())
    return G.neighbours(hits, edges, memories.where(active()), cap)


def recent(memories: DataFrame, now, days: int, limit: int) -> DataFrame:
    since = memories.where(active()).where(F.col("created_at") >= F.timestamp_micros(F.unix_micros(now) - days * F.lit(86_400_000_000)))
    return since.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def by_file(memories: DataFrame, condition, limit: int) -> DataFrame:
    return memories.where(active()).where(condition).orderBy(F.desc("importance"), F.desc("created_at"), F.desc("id")).limit(limit)


def next_tasks(tasks: DataFrame, projects: DataFrame, limit: int) -> DataFrame:
    """Open and active tasks that are no templates (one that doesn't say isn't) by priority times the project's weight, then by due date, those without one last."""
    t = tasks.where(~F.coalesce("is_template", F.lit(False)) & F.col("status").isin("open", "active")).withColumn("priority_score", priority_score("value", "effort"))
    out = t.join(projects.select(F.col("id").alias("project"), F.col("weight").alias("_w")), "project", "left")
    out = out.withColumn("effective_score", F.coalesce("priority_score", F.lit(1.0)) * F.coalesce("_w", F.lit(1.0))).drop("_w")
    return out.orderBy(F.desc("effective_score"), F.asc_nulls_last("due_on"), "id").limit(limit)


def stale_tasks(tasks: DataFrame) -> DataFrame:
    """Committed tasks that nobody touched since they were made."""
    return tasks.where(F.col("committed") & F.col("untouched") & ~F.col("status").isin("done", "abandoned")).orderBy("due_on", "id")


def threat_report(identifies: DataFrame, threat_technique: DataFrame, mitigates: DataFrame, threats: DataFrame) -> dict[str, DataFrame]:
    return {
        "top": A.top_threats(identifies, 10),
        "open": A.unmitigated(threat_technique, mitigates),
        "controls": A.threats_with_controls(threats, threat_technique, mitigates),
        "counts": A.sizes(threats=threats, identifies=identifies, techniques=threat_technique),
    }


def calibration(threats: DataFrame, mode: str = "tag-overlap") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary by class, recommendation, drift)."""
    rec = S.recommended(threats, mode)
    return A.summary(S.pair_distances(threats, mode), "distance", "class"), rec, S.drift(rec)


def calibration_drift(threats: DataFrame, mode: str = "tag-overlap") -> DataFrame:
    """The drift of calibration() alone, for which no table of the pairs is made, as the summary needs one."""
    return S.drift(S.recommended(threats, mode))


def cross_report_pairs(threats: DataFrame, identifies: DataFrame, most: float = P.THREAT_DISTANCE) -> DataFrame:
    """(a, b, distance) of threats within the distance that no report identifies both."""
    seen = A.reports_per_threat(identifies)
    p = S.close_pairs(threats, most)
    p = p.join(seen.select(F.col("id").alias("a"), F.col("reports").alias("sa")), "a", "left").join(seen.select(F.col("id").alias("b"), F.col("reports").alias("sb")), "b", "left")
    empty = F.array().cast("array<string>")
    return p.where(~F.arrays_overlap(F.coalesce("sa", empty), F.coalesce("sb", empty))).select("a", "b", "distance")


def cross_report_links(threats: DataFrame, identifies: DataFrame, most: float = P.THREAT_DISTANCE) -> DataFrame:
    """(a, b, pairs): links that join what cross_report_pairs() does, and on rows without a link how many such pairs there are (close_links)."""
    seen = A.reports_per_threat(identifies).select("id", F.col("reports").alias("tags"))
    return S.close_links(threats.select("id", "embedding").join(seen, "id", "left"), most, apart=True)


def dedup_plan(threats: DataFrame, identifies: DataFrame, most: float = P.THREAT_DISTANCE, force: bool = False, links: DataFrame | None = None) -> DataFrame:
    """(source, target): cross-report pairs within the distance, behind the gate, merged by component into the most identified, oldest node.  links: those of cross_report_links(), where they are there already."""
    links = written(cross_report_links(threats, identifies, most)) if links is None else links
    seen = A.reports_per_threat(identifies)
    nodes = threats.join(seen.select("id", "identifies"), "id", "left").na.fill(0, ["identifies"])
    if not force:
        S.gated(links.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
    return S.merge_plan(links.where("a IS NOT NULL"), nodes, [F.desc("identifies"), F.asc("created_at"), F.asc("id")])


def threat_counts(threats: DataFrame, identifies: DataFrame, techniques: DataFrame) -> DataFrame:
    """One row: active_threats, archived_threats, identifies_edges, technique_edges."""
    gone = F.coalesce("archived", F.lit(False)) if "archived" in threats.columns else F.lit(False)
    t = threats.agg(F.count(F.when(~gone, 1)).alias("active_threats"), F.count(F.when(gone, 1)).alias("archived_threats"))
    return t.crossJoin(F.broadcast(identifies.agg(F.count("*").alias("identifies_edges")))).crossJoin(F.broadcast(techniques.agg(F.count("*").alias("technique_edges"))))


def dedup_applied(
    threats: DataFrame, identifies: DataFrame, techniques: DataFrame, targets: DataFrame, now, most: float = P.THREAT_DISTANCE, force: bool = False, dry_run: bool = False,
) -> dict[str, DataFrame]:
    """The dedup plan carried out: threats, identifies and techniques after it, its merges, the counts before and after, and an entry for the log.

    Threats that are archived or have no vector take no part.  TARGETS edges of threats would be left behind by a merge, so any such edge stops the job before
    it begins, as more candidate pairs than the gate allows do.  A dry run has the plan and leaves the tables as they are, without an entry.
    """
    if not targets.join(threats.select(F.col("id").alias("src")), "src", "left_semi").isEmpty():
        raise ValueError("threats have TARGETS edges, which merges don't move")
    live = threats.where(F.col("embedding").isNotNull() & ~(F.coalesce("archived", F.lit(False)) if "archived" in threats.columns else F.lit(False)))
    links = written(cross_report_links(live, identifies, most))
    merges = written(dedup_plan(live, identifies, most, force, links))
    before = threat_counts(threats, identifies, techniques).withColumn("at", F.lit("before"))
    after = (threats, identifies, techniques) if dry_run else M.merge_threats(threats, merges, identifies, techniques, now)[:3]
    after = [written(df) for df in after]
    entry = merges.agg(F.count("*").alias("merges_attempted"), F.array_sort(F.collect_list(F.struct("source", "target"))).alias("m")).crossJoin(F.broadcast(links.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("candidates_found"))))
    entry = entry.select(
        F.lit("auto_merge").alias("operation"), now.cast("string").alias("ran_at"), F.lit(most).alias("threshold"), "candidates_found", "merges_attempted", F.col("merges_attempted").alias("merges_succeeded"),
        F.transform("m", lambda x: x["source"]).alias("source_ids"), F.transform("m", lambda x: x["target"]).alias("canonical_ids"),
    )
    counts = before.unionByName(threat_counts(*after).withColumn("at", F.lit("after")))
    return {"threats": after[0], "identifies": after[1], "techniques": after[2], "merges": merges, "counts": counts, "log": entry.limit(0) if dry_run else entry}


def cluster_analysis(nodes: DataFrame, edges: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, community), zones."""
    v = C.normalised(nodes)
    k = k or C.silhouette_sweep(v)[0]
    members = C.kmeans(v, k).join(louvain(edges), "id", "left")
    return members, A.zones(members)


def cluster_job(nodes: DataFrame, edges: DataFrame, now, k: int | None = None, bridges: int = 20, label: str = "domain", whole: DataFrame | None = None) -> dict[str, DataFrame]:
    """Clusters of vectors and communities of links, put together: annotated nodes, zones, compositions and the most central nodes.

    nodes: id, embedding, a label.  A node without a vector has no cluster and one without links no community.  Betweenness is that of the whole graph's edges
    (by default these), of which the top `bridges` annotate nodes.
    """
    members = written(C.kmeans(C.normalised(nodes), k or C.silhouette_sweep(C.normalised(nodes))[0]).join(louvain(edges), "id", "full_outer"))
    central = written(C.top_central(C.betweenness(edges if whole is None else whole).join(nodes.select("id"), "id", "left_semi"), bridges))
    marks = members.join(central, "id", "left").withColumn("cluster_updated_at", now)
    named = members.join(nodes.select("id", label), "id", "left")
    return {
        "nodes": M.annotated(nodes, marks, "cluster", "community", "betweenness", "cluster_updated_at"),
        "zones": C.ranked_zones(members.where("cluster IS NOT NULL AND community IS NOT NULL")),
        "clusters": A.composition(named.where("cluster IS NOT NULL"), "cluster", label),
        "communities": A.composition(named.where("community IS NOT NULL"), "community", label),
        "bridges": central,
    }


def presentable(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, dropped): memories fit to be read out, and how many were kept back for injections.

    Those tagged untrusted go without being counted, those with an injection in fact or so_what are counted; a fact of over 500 characters
    is cut, and the text put together anew from it.
    """
    trusted = memories.where(~F.coalesce(F.array_contains("tags", "untrusted"), F.lit(False)))
    spoken = F.concat_ws(" ", F.coalesce("fact", F.lit("")), F.coalesce("so_what", F.lit("")))
    checked = written(trusted.withColumn("_bad", has_injection(spoken)))
    cut = F.length("fact") > P.FACT_CAP
    fact = F.when(cut, truncated("fact", P.FACT_CAP, "[…]")).otherwise(F.col("fact"))
    text = F.when(cut, F.concat_ws(" ", fact, F.nullif("so_what", F.lit("")))).otherwise(F.col("text"))
    kept = checked.where("NOT _bad").withColumns({"text": text, "fact": fact}).drop("_bad")
    return kept, checked.agg(F.count_if("_bad").alias("dropped"))


def task_list(tasks: DataFrame, owned_by: DataFrame, for_project: DataFrame, status: str | None = None, agent=None, project=None, committed: bool = False) -> DataFrame:
    """Tasks that are no templates, one row an owner and project (null where there is none), by status, owner, project and commitment where these are named."""
    t = tasks.where(~F.coalesce("is_template", F.lit(False)))
    if status is not None:
        t = t.where(F.col("status") == status)
    if committed:
        t = t.where("committed_at IS NOT NULL")
    out = t.join(owned_by.select(F.col("src").alias("id"), F.col("dst").alias("agent_id")), "id", "left").join(for_project.select(F.col("src").alias("id"), F.col("dst").alias("project_id")), "id", "left")
    for column, want in (("agent_id", agent), ("project_id", project)):
        if want is not None:
            out = out.where(F.col(column) == F.lit(want))
    return out


def tagged(memories: DataFrame, tags) -> DataFrame:
    return memories.where(any_of("tags", tags))
