"""The long rest and the dedup job on literal graphs, and threats in reading order."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from graphloom.plans import composites as Z
from graphloom.plans import ingest as I
from graphloom.plans.rest import full_long_rest

DAY = dt.datetime(2024, 3, 1)
NODE = "id long, embedding array<double>, status string, ephemeral boolean, importance int, strength double, min_strength double, decay_rate double, created_at timestamp, last_reinforced_at timestamp"


@pytest.fixture
def graph(spark):
    at = DAY - dt.timedelta(days=10)
    m = [
        (1, [1.0, 0.0], "active", False, 5, 0.9, 0.0, 0.01, DAY, at), (2, [1.0, 0.01], None, None, 3, 0.9, 0.0, 0.01, DAY, at), (3, [0.0, 1.0], "active", False, 3, 0.9, 0.0, 0.01, DAY, at),
        (4, [0.01, 1.0], "archived", False, 3, 0.1, 0.0, 0.07, DAY, at), (5, [-1.0, 0.0], "active", False, 1, None, None, None, DAY, at), (6, [1.0, 0.02], "active", False, 3, 0.9, 0.0, 0.01, DAY, None),
    ]
    old = DAY - dt.timedelta(days=200)
    related = [(1, 3, 0.5, 2, at, 0.005), (1, 5, 0.005, 1, old, None), (3, 4, 0.005, 0, old, 0.005), (2, 5, None, None, None, None)]
    return (
        spark.createDataFrame(m, NODE), spark.createDataFrame(related, "src long, dst long, weight double, activation_count int, last_activated_at timestamp, decay_rate double"),
        spark.createDataFrame([(3, 1, 1.0)], "src long, dst long, weight double"), F.lit("2024-03-01 00:00:00").cast("timestamp"),
    )


def test_long_rest(graph):
    m, related, leads, now = graph
    out = full_long_rest(m, related, leads, now, prune=True, auto_merge=0.99, near_duplicate=0.9, k=3, most=0.1, capacity=6)
    r = out.report.first()
    assert (r["nodes_decayed"], r["edges_decayed"], r["embedded_memory_count"], r["index_utilisation_pct"], r["index_near_capacity"]) == (4, 2, 6, 100.0, True)
    # 1, 2, 3 and 6 are strong: 1-2, 1-6, 2-1, 2-6, 6-1, 6-2 are made (3-4 is there); 3-4, never activated and dated by its decay, counts as well.
    assert (r["edges_discovered"], r["edges_pruned"], r["near_duplicate_count"], r["auto_merged_count"]) == (7, 1, 3, 1)
    nodes = {x["id"]: x for x in out.memories.collect()}
    assert nodes[2]["status"] == "merged" and nodes[6]["status"] == "active" and nodes[1]["status"] == "active"
    # Node 1 has LEADS_TO weight 1 coming in, which slows its decay.
    assert math.isclose(nodes[1]["strength"], 0.9 * math.exp(-0.01 / 1.5 * 10)) and math.isclose(nodes[2]["strength"], 0.9 * math.exp(-0.1)) and nodes[6]["strength"] == 0.9 and nodes[5]["strength"] is None
    edges = {(x["src"], x["dst"]): x for x in out.related.collect()}
    # The weak edge 1-5 is gone; what stands there now came from 2 by the merge.
    assert edges[(1, 5)]["weight"] is None
    assert edges[(1, 6)]["decay_rate"] == 0.005 and (2, 6) not in edges and (2, 5) not in edges
    assert [tuple(x) for x in out.merged_into.collect()] == [(2, 1)]
    assert [(x["a"], x["b"]) for x in out.candidates.collect()] == [(1, 2), (2, 6), (1, 6)]
    log = out.log.collect()
    assert [x["operation"] for x in log] == ["long_rest", "auto_merge"] and (log[1]["source_id"], log[1]["canonical_id"]) == ("2", "1") and log[0]["nodes_affected"] == 4


def test_report_counts_edges_before_merge(graph):
    """One rest tells how many RELATED_TO edges there are before its merges: those a rest without merges leaves."""
    m, related, leads, now = graph
    options = {"prune": True, "near_duplicate": 0.9, "k": 3, "most": 0.1}
    merged, plain = full_long_rest(m, related, leads, now, auto_merge=0.99, **options), full_long_rest(m, related, leads, now, **options)
    n = plain.related.count()
    assert merged.report.first()["edges_before_merge"] == plain.report.first()["edges_before_merge"] == n > merged.related.count()


def test_all_alike_pairs_are_reviewed_and_merged(spark):
    """1,100 linked pairs of copies: none is left out, however many there are."""
    now, n = F.lit("2024-03-01 00:00:00").cast("timestamp"), 1100
    m = spark.range(2 * n).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.lit("active").alias("status"), F.lit(False).alias("ephemeral"), F.lit(3).alias("importance"), F.lit(None).cast("double").alias("strength"))
    m = m.withColumns({"min_strength": F.lit(0.0), "decay_rate": F.lit(0.01), "created_at": now, "last_reinforced_at": now})
    related = spark.range(n).select((2 * F.col("id")).alias("src"), (2 * F.col("id") + 1).alias("dst"), F.lit(0.5).alias("weight"))
    r = full_long_rest(m, related, related.limit(0), now, auto_merge=0.9, near_duplicate=0.9).report.first()
    assert (r["edges_before_merge"], r["near_duplicate_count"], r["auto_merged_count"]) == (n, n, n)


def test_dry_run_changes_nothing(graph):
    m, related, leads, now = graph
    out = full_long_rest(m, related, leads, now, prune=True, dry_run=True, auto_merge=0.5, near_duplicate=0.9, k=3, most=0.1)
    assert sorted(map(str, out.memories.collect())) == sorted(map(str, m.collect())) and sorted(map(str, out.related.collect())) == sorted(map(str, related.collect()))
    r = out.report.first()
    assert (r["edges_discovered"], r["edges_pruned"], r["auto_merged_count"], r["dry_run"]) == (6, 2, 0, True) and out.log.count() == 0


def test_rest_of_nothing(graph):
    m, related, leads, now = graph
    r = full_long_rest(m.limit(0), related.limit(0), leads.limit(0), now, prune=True, auto_merge=0.9).report.first()
    assert (r["nodes_decayed"], r["edges_discovered"], r["edges_pruned"], r["near_duplicate_count"], r["auto_merged_count"], r["index_utilisation_pct"]) == (0, 0, 0, 0, 0, 0.0)


def test_dedup_applied(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    t = spark.createDataFrame([(1, [1.0, 0.0], DAY, False), (2, [1.0, 0.1], DAY, False), (3, [1.0, 0.05], DAY, None), (4, [0.0, 1.0], DAY, False), (5, [1.0, 0.0], DAY, True)], "id long, embedding array<double>, created_at timestamp, archived boolean")
    e = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 2), ("r1", 3), ("r4", 4)], "src string, dst long")
    k = spark.createDataFrame([(1, "T1"), (2, "T1"), (3, "T2")], "src long, dst string")
    none = spark.createDataFrame([], "src long, dst long")
    out = Z.dedup_applied(t, e, k, none, now, 0.28)
    # 1 and 3 share a report, but both meet 2.
    assert sorted(tuple(r) for r in out["merges"].collect()) == [(1, 2), (3, 2)]
    counts = {r["at"]: r.asDict() for r in out["counts"].collect()}
    assert [counts["before"][c] for c in ("active_threats", "archived_threats", "identifies_edges", "technique_edges")] == [4, 1, 5, 3]
    assert [counts["after"][c] for c in ("active_threats", "archived_threats", "identifies_edges", "technique_edges")] == [2, 3, 4, 2]
    log = out["log"].first()
    assert (log["candidates_found"], log["merges_succeeded"], log["source_ids"], log["canonical_ids"]) == (2, 2, [1, 3], [2, 2])
    dry = Z.dedup_applied(t, e, k, none, now, 0.28, dry_run=True)
    assert dry["merges"].count() == 2 and dry["log"].count() == 0 and {r["archived_threats"] for r in dry["counts"].collect()} == {1}
    with pytest.raises(ValueError, match="TARGETS"):
        Z.dedup_applied(t, e, k, spark.createDataFrame([(1, 7)], "src long, dst long"), now)


def test_threats_in_reading_order(spark):
    """The first of near copies in a report is the threat, whatever the hashes, and the last one's words stand on the edge."""
    body = "Attackers deployed ransomware with critical effect across the network. Then attackers deployed ransomware, with moderate effect and fewer cases. Unrelated words stand here for long enough. Later attackers deployed ransomware in a widespread and growing way."
    embed = lambda d: d.withColumn("embedding", F.array(F.lit(1.0), F.length("text") / 1e6))
    known = spark.createDataFrame([], "id string, embedding array<double>")
    for name in ("r1", "a", "zz9"):
        reports = spark.createDataFrame([(name, body)], "doc_id string, body string")
        out = I.threats_from_reports(reports, known, embed, spark.createDataFrame([("T1486",)], "id string"))
        first = out["threats"].collect()
        assert len(first) == 1 and first[0]["text"].startswith("Attackers deployed ransomware with critical")
        (edge,) = out["identifies"].collect()
        assert (edge["src"], edge["dst"]) == (name, first[0]["id"]) and (edge["severity"], edge["trend"]) == ("high", "increasing") and edge["source_terminology"].startswith("Later")
        assert [tuple(r) for r in out["techniques"].collect()] == [(first[0]["id"], "T1486")]


def test_startup_profile(spark):
    from graphloom.plans.startup import Profile, startup

    m = spark.createDataFrame([(i, [1.0, i / 10], "fact" if i != 3 else "event", "archived" if i == 9 else None, False, 5 - i % 3, None, 0, 0, DAY, f"m{i}") for i in range(12)], "id long, embedding array<double>, type string, status string, ephemeral boolean, importance int, strength double, reinforcement_count int, recall_count int, created_at timestamp, fact string")
    p = Profile()
    strands = spark.createDataFrame([(0, p.agent_anchor[0]), (1, p.supplement[0]), (2, p.supplement[0]), (3, p.supplement[0]), (4, p.supplement[0]), (5, p.user_anchor[0]), (6, "other"), (7, p.session[0]), (9, p.agent_anchor[0])], "src long, dst string")
    about = spark.createDataFrame([(i, "me") for i in (0, 1, 2, 3, 4, 9)] + [(5, "ann"), (0, "ann"), (6, "proj"), (7, "proj"), (8, "proj"), (9, "proj")], "src long, dst string")
    made = spark.createDataFrame([(0, "bot"), (1, "bot"), (4, "bot"), (6, "bot")], "src long, dst string")
    got = sorted(tuple(r) for r in startup(m, strands, about, made, "me", "bot", "ann", "proj", [1.0, 0.8]).collect())
    # 3 is of another type, 9 archived; of the supplement's three two fit: the more important 1 (4) and 4 (4) before 2 (3).
    assert got == [("global_agent_baseline", 1, 0), ("global_agent_baseline", 2, 1), ("global_agent_baseline", 3, 4), ("global_user_baseline", 1, 5), ("project_baseline", 1, 6), ("project_baseline", 2, 8)]
    # Nothing is about this agent: what the project's agent made stands in.
    other = sorted(tuple(r) for r in startup(m, strands, about, made, "nobody", "bot").collect())
    assert other == [("global_agent_baseline", 1, 0), ("global_agent_baseline", 2, 1), ("global_agent_baseline", 3, 4)]
    assert startup(m.limit(0), strands, about, made, "me", "bot", "ann", "proj", [1.0, 0.8]).count() == 0
