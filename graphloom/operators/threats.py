"""Threat-driven traversals: what threats mean for the business, for techniques and for assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of severities and trends, the worst first; a label outside the lists weighs nothing.
SEVERITY = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
TREND = {"increasing": 1.5, "stable": 1.0, "decreasing": 0.5}


def _weight(label: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(label == k, v) for k, v in table.items()], F.lit(0.0))


def _label(weight: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(weight == v, k) for k, v in table.items()])


def assessed(identifies: DataFrame) -> DataFrame:
    """(id, severity, trend, weight, reports) of each identified threat: the worst severity and trend that any report gives it, and their product."""
    s, t = F.max(_weight(F.col("severity"), SEVERITY)), F.max(_weight(F.col("trend"), TREND))
    per = identifies.groupBy(F.col("dst").alias("id")).agg(s.alias("s"), t.alias("t"), F.countDistinct("src").alias("reports"))
    return per.select("id", _label(F.col("s"), SEVERITY).alias("severity"), _label(F.col("t"), TREND).alias("trend"), (F.col("s") * F.col("t")).alias("weight"), "reports")


def strategic(identifies: DataFrame, jeopardises: DataFrame, fulfils: DataFrame) -> DataFrame:
    """(threat, precept, attribute, severity, trend, score): each way from an identified threat over a precept it jeopardises to an attribute that this fulfils, scored by the threat's weight shared among the precept's attributes."""
    ways = jeopardises.select(F.col("src").alias("id"), F.col("dst").alias("precept")).distinct().join(assessed(identifies), "id")
    ends = fulfils.select(F.col("src").alias("precept"), F.col("dst").alias("attribute")).distinct()
    share = ends.groupBy("precept").agg(F.count("*").alias("n"))
    return ways.join(ends, "precept").join(share, "precept").select(F.col("id").alias("threat"), "precept", "attribute", "severity", "trend", (F.col("weight") / F.col("n")).alias("score"))


def heat_map(paths: DataFrame, fulfils: DataFrame) -> DataFrame:
    """(attribute, severity, threats, precepts, of_precepts, score) for every attribute and every severity, empty cells included."""
    axis = fulfils.groupBy(F.col("dst").alias("attribute")).agg(F.countDistinct("src").alias("of_precepts"))
    cells = axis.select("attribute", "of_precepts", F.explode(F.array(*[F.lit(s) for s in SEVERITY])).alias("severity"))
    full = paths.groupBy("attribute", "severity").agg(F.countDistinct("threat").alias("threats"), F.countDistinct("precept").alias("precepts"), F.sum("score").alias("score"))
    return cells.join(full, ["attribute", "severity"], "left").na.fill(0, ["threats", "precepts", "score"])


def tactical(identifies: DataFrame, threat_technique: DataFrame, mitigates: DataFrame) -> DataFrame:
    """(threat, technique, controls, score): the techniques of identified threats with the controls that counter them; an uncountered one has the threat's weight, others a part of it that falls with each control."""
    t = threat_technique.select(F.col("src").alias("id"), F.col("dst").alias("technique")).distinct().join(assessed(identifies), "id")
    c = mitigates.groupBy(F.col("dst").alias("technique")).agg(F.countDistinct("src").alias("controls"))
    out = t.join(c, "technique", "left").na.fill(0, ["controls"])
    return out.select(F.col("id").alias("threat"), "technique", "controls", (F.col("weight") / (1 + F.col("controls"))).alias("score"))


def asset_centric(identifies: DataFrame, targets: DataFrame, protected_by: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(asset, threats, controls, evidenced, exposed, score): assets that identified threats target, the controls that protect them and how many of these have evidence (id); score sums the threats' weights over one more than the evidenced (or, without evidence, all) controls."""
    hit = targets.select(F.col("src").alias("id"), F.col("dst").alias("asset")).distinct().join(assessed(identifies), "id")
    per = hit.groupBy("asset").agg(F.countDistinct("id").alias("threats"), F.sum("weight").alias("w"))
    p = protected_by.select(F.col("src").alias("asset"), F.col("dst").alias("control")).distinct()
    p = p.withColumn("ok", F.lit(1)) if evidence is None else p.join(evidence.select(F.col("id").alias("control")).distinct().withColumn("ok", F.lit(1)), "control", "left")
    guards = p.groupBy("asset").agg(F.count("*").alias("controls"), F.count("ok").alias("evidenced"))
    out = per.join(guards, "asset", "left").na.fill(0, ["controls", "evidenced"])
    return out.select("asset", "threats", "controls", "evidenced", (F.col("evidenced") == 0).alias("exposed"), (F.col("w") / (1 + F.col("evidenced"))).alias("score"))


def priorities(identifies: DataFrame, threat_technique: DataFrame, mitigates: DataFrame) -> DataFrame:
    """(threat, severity, trend, coverage, priority): severity times trend times the share of the threat's techniques that no control counters; a threat without techniques counts as uncovered."""
    t = tactical(identifies, threat_technique, mitigates).groupBy(F.col("threat").alias("id")).agg(F.avg((F.col("controls") > 0).cast("double")).alias("coverage"))
    out = assessed(identifies).join(t, "id", "left").na.fill(0.0, ["coverage"])
    return out.select(F.col("id").alias("threat"), "severity", "trend", "coverage", (F.col("weight") * (1 - F.col("coverage"))).alias("priority"))
