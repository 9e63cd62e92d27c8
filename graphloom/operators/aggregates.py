"""Coverage, gap and distribution reports."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..storage import written


def pct(part, whole):
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def attribute_coverage(attributes: DataFrame, fulfils: DataFrame, addresses: DataFrame, supports: DataFrame) -> DataFrame:
    """Per attribute: controls that reach it through a precept, how many have a supporting chunk, the share, and the uncovered ids."""
    reach = fulfils.select(F.col("src").alias("precept"), F.col("dst").alias("id")).join(addresses.select(F.col("src").alias("control"), F.col("dst").alias("precept")), "precept")
    reach = reach.select("id", "control").distinct()
    covered = supports.select(F.col("dst").alias("control")).distinct().withColumn("covered", F.lit(True))
    flags = reach.join(covered, "control", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    per = flags.groupBy("id").agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"), F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("control")))).alias("uncovered"))
    out = attributes.select("id").join(per, "id", "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("covered", F.lit(0))
    return out.select("id", total.alias("total_controls"), done.alias("covered_controls"), pct(done, total).alias("coverage_pct"), F.coalesce("uncovered", F.array().cast(per.schema["uncovered"].dataType)).alias("uncovered"))


def gap_analysis(controls: DataFrame, supports: DataFrame, about_control: DataFrame) -> DataFrame:
    """Per control: supporting chunks, evidence memories, and covered (both), partial (one) or uncovered."""
    chunks = supports.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("chunk_count"))
    evidence = about_control.where("relationship_type = 'evidence'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("memory_count"))
    out = controls.select("id").join(chunks, "id", "left").join(evidence, "id", "left").na.fill(0, ["chunk_count", "memory_count"])
    both, one = (F.col("chunk_count") > 0) & (F.col("memory_count") > 0), (F.col("chunk_count") > 0) | (F.col("memory_count") > 0)
    return out.withColumn("status", F.when(both, "covered").when(one, "partial").otherwise("uncovered"))


def top_threats(identifies: DataFrame, n: int) -> DataFrame:
    """The threats that most reports identify, with their severities and trends."""
    per = identifies.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("reports"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"), F.array_join(F.array_sort(F.collect_set("trend")), ",").alias("trends"))
    return per.orderBy(F.desc("reports"), "id").limit(n)


def technique_coverage(threat_technique: DataFrame, mitigates: DataFrame, technique_cluster: DataFrame) -> DataFrame:
    """Per threat: its techniques, the controls that mitigate any, and the clusters of the techniques.

    Threats of the same techniques fare alike, and so do controls that mitigate the same ones: sets of techniques are joined, with the
    number of controls of each, and not threats with controls.
    """
    per = threat_technique.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("set"))
    sets = per.select("set").distinct().select("set", F.explode("set").alias("technique"))
    marks = mitigates.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("by"))
    marks = marks.groupBy("by").agg(F.count("*").alias("n"))
    met = sets.join(marks.select("by", "n", F.explode("by").alias("technique")), "technique").select("set", "by", "n").distinct()
    controls = met.groupBy("set").agg(F.sum("n").alias("controls"))
    clusters = sets.join(technique_cluster, "technique").groupBy("set").agg(F.countDistinct("cluster").alias("clusters"))
    known = per.join(controls, "set", "left").join(clusters, "set", "left")
    return known.select("id", F.size("set").cast("long").alias("techniques"), F.coalesce("controls", F.lit(0)).alias("controls"), F.coalesce("clusters", F.lit(0)).alias("clusters"))


def controls_per_technique(threat_technique: DataFrame, mitigates: DataFrame) -> DataFrame:
    """(threat, technique, controls) of every threat and technique, an edge that comes twice counting twice; a technique's controls are counted before they meet its threats."""
    n = mitigates.groupBy("dst").agg(F.count("src").alias("_m"))
    t = threat_technique.groupBy("src", "dst").agg(F.count("*").alias("_t")).join(n, "dst", "left")
    return t.select(F.col("src").alias("threat"), F.col("dst").alias("technique"), (F.col("_t") * F.coalesce("_m", F.lit(0))).alias("controls"))


def unmitigated(threat_technique: DataFrame, mitigates: DataFrame) -> DataFrame:
    """Per threat: techniques that no control mitigates, repeats kept."""
    bare = threat_technique.join(mitigates.select("dst").distinct(), "dst", "left_anti")
    return bare.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("open_techniques"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("open_ids"))


def threats_with_controls(threats: DataFrame, threat_technique: DataFrame, mitigates: DataFrame) -> DataFrame:
    t = threat_technique.join(mitigates.select("dst").distinct(), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("has", F.lit(1))
    return threats.select("id").join(t, "id", "left").agg(F.count("has").alias("with_controls"), (F.count("*") - F.count("has")).alias("without_controls"))


def sizes(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table, in one job."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def memory_stats(memories: DataFrame, edges: DataFrame, weak: float = P.WEAK_EDGE) -> DataFrame:
    m = memories.agg(
        F.count("*").alias("total"), F.round(F.avg("strength"), 4).alias("mean_strength"), F.round(F.median("strength"), 4).alias("median_strength"),
        F.count_if(F.col("strength") <= F.col("min_strength")).alias("at_floor"), F.count_if(F.col("strength") >= 1).alias("at_max"),
    )
    e = edges.agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 4).alias("mean_weight"), F.count_if(F.col("weight") < weak).alias("weak_edges"))
    return m.crossJoin(e)  # a row each


def incoming_weight(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    w = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("incoming"))
    return nodes.join(w, "id", "left").na.fill(0.0, ["incoming"])


def summary(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """count, mean, median, p10, p50, p90, min, max with linear interpolation; zeros when there are no rows."""
    out = df.groupBy(*keys).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    named = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    found = percentiles(df.select(*keys, x), x, named, *keys)
    out = out.join(found.select(*[F.col(k).alias(f"_{k}") for k in keys], *named), _same(keys, "_") if keys else F.lit(True), "left")
    r = lambda v, name: F.round(F.coalesce(F.col(v), F.lit(0.0)), 4).alias(name)
    return out.select(*keys, "count", r("mean", "mean"), r("p50", "median"), r("p10", "p10"), r("p50", "p50"), r("p90", "p90"), r("min", "min"), r("max", "max"))


def _same(keys: tuple[str, ...], mark: str):
    """That columns equal those with a mark before their names, null to null."""
    return functools.reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys])


def percentiles(df: DataFrame, x: str, named: dict[str, float], *keys: str) -> DataFrame:
    """(keys, a column for each name): exact percentiles with linear interpolation; groups without values are left out.

    Values are counted, sorted over the cluster, and each part's place in its group follows from the parts before it: only the parts that
    hold a wanted place are numbered, so no task holds a group.
    """
    by = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_k0")]
    ks = tuple(f"_k{i}" for i in range(len(by)))
    counts = written(df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_v")).groupBy(*ks, "_v").agg(F.count("*").alias("_n")))
    dealt = written(counts.repartitionByRange(*ks, "_v").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*ks, "_part").agg(F.sum("_n").alias("_n"))
    before = W.partitionBy(*ks).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*ks, "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.sum("_n").over(W.partitionBy(*ks)).alias("_all"))
    at = {name: F.lit(float(p)) * (F.col("_all") - 1) for name, p in named.items()}
    places = F.array(*[f(v).cast("long") for v in at.values() for f in (F.floor, F.ceil)])
    held = parts.where(F.exists(places, lambda i: (i >= F.col("_from")) & (i < F.col("_from") + F.col("_n"))))
    held = held.select(*[F.col(k).alias(f"_{k}") for k in ks], F.col("_part").alias("_p"), "_from", "_all")
    rows = dealt.join(F.broadcast(held), _same(ks, "_") & (F.col("_part") == F.col("_p"))).select(*ks, "_part", "_v", "_n", "_from", "_all")
    rows = rows.withColumn("_to", F.col("_from") + F.sum("_n").over(W.partitionBy(*ks, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    value = lambda i: F.max(F.when((i >= F.col("_to") - F.col("_n")) & (i < F.col("_to")), F.col("_v")))
    ends = [c for name, v in at.items() for c in (F.max(v).alias(f"_at_{name}"), value(F.floor(v)).alias(f"_low_{name}"), value(F.ceil(v)).alias(f"_high_{name}"))]
    out = rows.groupBy(*ks).agg(*ends)

    def between(name: str):
        v, low, high = F.col(f"_at_{name}"), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(low == high, low).otherwise((F.ceil(v) - v) * low + (v - F.floor(v)) * high).alias(name)

    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[between(n) for n in named])


def index_percentiles(df: DataFrame, x: str, ps: tuple[int, ...], *keys: str) -> DataFrame:
    """(keys, p, value): the value at place floor(p / 100 * n), counted from zero, of the sorted values.

    Ranks come from a window over each group; for one global group pass a key that splits it or use an exact percentile.
    """
    w, all_ = W.partitionBy(*keys).orderBy(x), W.partitionBy(*keys)
    ranked = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("value"), (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(all_).alias("_n"))
    wanted = ranked.withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps])))
    return wanted.where(F.col("_i") == F.least(F.floor(F.col("p") * F.col("_n") / 100), F.col("_n") - 1)).select(*keys, "p", "value")


def histogram(df: DataFrame, x: str, low: float, high: float, width: float) -> DataFrame:
    """(bin, low, count) with every bin, empty ones too; a value outside [low, high) counts in the last bin, also one below."""
    n = round((high - low) / width)
    i = F.floor((F.col(x) - low) / width)
    counts = df.where(F.col(x).isNotNull()).groupBy(F.when((F.col(x) < low) | (i >= n), n - 1).otherwise(i).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counts), "bin", "left").na.fill(0, ["count"]).select("bin", F.round(low + F.col("bin") * width, 4).alias("low"), "count")


def range_histogram(df: DataFrame, x: str, n: int = 10) -> DataFrame:
    """(bin, count): n equal bins from the least to the greatest value, the last one closed."""
    lo_hi = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / n
    at = F.when(w > 0, F.least(F.floor((F.col(x) - F.col("lo")) / w), F.lit(n - 1))).otherwise(0).cast("int")
    return df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(lo_hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))


def natural_gaps(df: DataFrame, x: str, least: float = 0.03) -> DataFrame:
    """(low, high, gap) between neighbouring sorted values, widest first.

    Values are reduced to their distinct set before the one global order is taken, and only gaps leave it.
    """
    v = df.where(F.col(x).isNotNull()).select(F.col(x).alias("low")).distinct()
    nxt = v.select("low", F.lead("low").over(W.orderBy("low")).alias("high"))
    return nxt.select("low", "high", (F.col("high") - F.col("low")).alias("gap")).where(F.col("gap") >= least).orderBy(F.desc("gap"), "low")


def pass_counts(df: DataFrame, x: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, passed) in one pass over the rows."""
    row = df.agg(*[F.count_if(F.col(x) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("passed")) for i, t in enumerate(thresholds)])).alias("r")).select("r.*")


def group_coverage(groups: DataFrame, edges: DataFrame, group: str = "group") -> DataFrame:
    """Per group: members, members with an edge, edges, the share covered; groups without edges too."""
    per = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    out = groups.join(per, "id", "left").groupBy(group).agg(F.count("*").alias("members"), F.count("n").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return out.withColumn("covered_pct", pct(F.col("covered"), F.col("members")))


def gate(report: DataFrame, least_pct: float = P.GATE_PCT, least_edges: int = P.GATE_EDGES) -> DataFrame:
    total = report.agg(F.sum("covered").alias("covered"), F.sum("members").alias("members"), F.sum("edges").alias("edges"))
    share = pct(F.col("covered"), F.col("members"))
    return total.select(share.alias("covered_pct"), "edges", ((share >= least_pct) & (F.col("edges") >= least_edges)).alias("passed"))


def acceptance(checks: DataFrame) -> DataFrame:
    """(name, rows, least, passed) from counts and their minimums."""
    return checks.withColumn("passed", F.col("rows") >= F.col("least"))


def composition(members: DataFrame, cluster: str, label: str, top: int = 4) -> DataFrame:
    """Per cluster: its most frequent labels with whole percentages."""
    n = members.groupBy(cluster, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(cluster))
    ranked = n.withColumn("pct", F.round(100.0 * F.col("n") / total)).withColumn("rank", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("n"), label)))
    return ranked.where(F.col("rank") <= top).select(cluster, "rank", label, "n", F.col("pct").cast("int").alias("pct"))


def zones(members: DataFrame, a: str = "community", b: str = "cluster") -> DataFrame:
    return members.groupBy(a, b).agg(F.count("*").alias("size")).orderBy(F.desc("size"), a, b)


def exact_duplicates(df: DataFrame, text: str = "fact", key: str = "id") -> DataFrame:
    """Groups of equal text, case aside: the first id, and how many share it."""
    return df.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def reports_per_threat(identifies: DataFrame) -> DataFrame:
    return identifies.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(F.col("src").cast("string"))).alias("reports"), F.count("*").alias("identifies"))
