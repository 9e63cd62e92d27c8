"""Queries over norms, parameters and threats: inheritance, bindings and threat-driven traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import inheritance as H
from .operators import threats as T
from .registry import query
from .views import Graph


def _t(prefix: str, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def _applies(g: Graph):
    """Every third nation, every fourth supplier and all regions have a set of jurisdictions; some claim more than lies above."""
    n, s, r = g.table("nation"), g.table("supplier"), g.table("region")
    k = lambda c: F.col(c)
    rows = [
        r.select(_t("r", k("r_regionkey")).alias("src"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select("src", _t("j", (F.substring("src", 2, 9).cast("int") + k("j")) % 6).alias("dst")),
        n.where("n_nationkey % 3 = 0").select(_t("n", k("n_nationkey")).alias("src"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("src", _t("j", (F.substring("src", 2, 9).cast("int") + k("j")) % 6).alias("dst")),
        s.where("s_suppkey % 4 = 0").select(_t("s", k("s_suppkey")).alias("src"), _t("j", k("s_suppkey") % 6).alias("dst")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_APPLIES = """applies(src, dst) AS (SELECT 'r' || r_regionkey, 'j' || ((r_regionkey + j) % 6) FROM region, range(5) t(j)
    UNION ALL SELECT 'n' || n_nationkey, 'j' || ((n_nationkey + j) % 6) FROM nation, range(3) t(j) WHERE n_nationkey % 3 = 0 UNION ALL SELECT 's' || s_suppkey, 'j' || (s_suppkey % 6) FROM supplier WHERE s_suppkey % 4 = 0)"""
_SUPPLY = """supply(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
nodes(id) AS (SELECT src FROM supply UNION SELECT dst FROM supply), walk(id, anc, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT w.id, s.src, w.depth + 1 FROM walk w JOIN supply s ON s.dst = w.anc)"""


def _nodes(g: Graph):
    return g.supply.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query("g11_norm_jurisdictions", f"""
WITH RECURSIVE {_SUPPLY}, {_APPLIES}, sets AS (SELECT w.id, count(DISTINCT a.src) AS n FROM walk w JOIN applies a ON a.src = w.anc GROUP BY w.id)
SELECT w.id, a.dst AS jurisdiction FROM walk w JOIN applies a ON a.src = w.anc JOIN sets s ON s.id = w.id GROUP BY w.id, a.dst, s.n HAVING count(*) = s.n""")  # fmt: skip
def _(g):
    return H.norm_jurisdictions(_nodes(g), g.supply, _applies(g))


@query("g11_widened", f"""
WITH RECURSIVE {_SUPPLY}, {_APPLIES}, near AS (SELECT id, arg_min(anc, depth) AS ancestor FROM walk WHERE depth > 0 AND anc IN (SELECT src FROM applies) GROUP BY id)
SELECT a.src AS id, a.dst AS jurisdiction, n.ancestor FROM applies a JOIN near n ON n.id = a.src WHERE NOT EXISTS (SELECT 1 FROM applies b WHERE b.src = n.ancestor AND b.dst = a.dst)""")  # fmt: skip
def _(g):
    return H.widened(_nodes(g), g.supply, _applies(g))


@query("g11_control_jurisdictions", f"""
WITH RECURSIVE {_SUPPLY}, {_APPLIES}, sets AS (SELECT w.id, count(DISTINCT a.src) AS n FROM walk w JOIN applies a ON a.src = w.anc GROUP BY w.id),
norms AS (SELECT w.id, a.dst AS jurisdiction FROM walk w JOIN applies a ON a.src = w.anc JOIN sets s ON s.id = w.id GROUP BY w.id, a.dst, s.n HAVING count(*) = s.n),
over_(src, dst) AS (SELECT 'b' || p_brand, 'c' || p_partkey FROM part), maps(src, dst) AS (SELECT 's' || l_suppkey, 'c' || l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT 'n' || (length(p_brand) + p_size) % 25, 'b' || p_brand FROM part WHERE p_size < 3)
SELECT DISTINCT c.dst AS id, n.jurisdiction FROM over_ c JOIN maps m ON m.dst IN (c.dst, c.src) JOIN norms n ON n.id = m.src""")  # fmt: skip
def _(g):
    p, li = g.table("part"), g.table("lineitem")
    over = p.select(_t("b", F.col("p_brand")).alias("src"), _t("c", F.col("p_partkey")).alias("dst"))
    maps = li.where("l_quantity > 45").select(_t("s", F.col("l_suppkey")).alias("src"), _t("c", F.col("l_partkey")).alias("dst")).unionByName(
        p.where("p_size < 3").select(_t("n", (F.length("p_brand") + F.col("p_size")) % 25).alias("src"), _t("b", F.col("p_brand")).alias("dst")))
    return H.control_jurisdictions(over.select(F.col("dst").alias("id")), over, maps, H.norm_jurisdictions(_nodes(g), g.supply, _applies(g)))


@query("g11_bound_parameters", f"""
WITH RECURSIVE {_SUPPLY}, sources AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'section' ELSE 'policy' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'retired' ELSE 'active' END AS status,
        CASE o_orderkey % 3 WHEN 0 THEN 'r' || n_regionkey WHEN 1 THEN 'n' || c_nationkey ELSE 's' || (1 + o_orderkey % (SELECT count(*) FROM supplier)) END AS org, o_totalprice, o_orderdate
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
needs AS (SELECT DISTINCT 's' || l_suppkey AS org, l_partkey AS control, l_partkey || '_prm_' || k AS param FROM lineitem, range(2) t(k) WHERE l_quantity > 25),
cand AS (SELECT n.org, n.param, s.o_totalprice AS value, s.id AS source, w.depth, row_number() OVER (PARTITION BY n.org, n.param ORDER BY w.depth, s.kind DESC, s.o_orderdate DESC, s.id) AS place
        FROM (SELECT DISTINCT org, param FROM needs) n JOIN walk w ON w.id = n.org JOIN lineitem l ON l.l_partkey || '_prm_' || (l.l_linenumber % 3) = n.param JOIN sources s ON s.id = l.l_orderkey AND s.org = w.anc WHERE s.status = 'active')
SELECT n.org, n.control, n.param, c.value, c.source, c.depth AS distance, c.source IS NOT NULL AS bound FROM needs n LEFT JOIN cand c ON c.org = n.org AND c.param = n.param AND c.place = 1""")  # fmt: skip
def _(g):
    k = F.col("o_orderkey")
    people = g.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(g.table("nation"), "n_nationkey")
    suppliers = g.table("supplier").agg(F.count("*").alias("suppliers"))
    o = g.table("orders").join(people, "o_custkey").crossJoin(F.broadcast(suppliers))
    org = F.when(k % 3 == 0, _t("r", F.col("n_regionkey"))).when(k % 3 == 1, _t("n", F.col("n_nationkey"))).otherwise(_t("s", 1 + k % F.col("suppliers")))
    sources = o.select(k.alias("id"), F.when(k % 2 == 0, "section").otherwise("policy").alias("kind"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("status"), org.alias("org"))
    li = g.table("lineitem")
    facts = g.table("orders").select(k.alias("src"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("bound_at"))
    binds = li.select(F.col("l_orderkey").alias("src"), F.concat(F.col("l_partkey").cast("string"), F.lit("_prm_"), (F.col("l_linenumber") % 3).cast("string")).alias("param")).distinct().join(facts, "src")
    requests = li.where("l_quantity > 25").select(_t("s", F.col("l_suppkey")).alias("org"), F.col("l_partkey").alias("control")).distinct()
    params = requests.select(F.col("control").alias("src")).distinct().select("src", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("src", F.concat(F.col("src").cast("string"), F.lit("_prm_"), F.col("k").cast("string")).alias("dst"))
    return H.bound_parameters(requests, params, binds, sources, g.supply)


# --- threat-driven traversals ----------------------------------------------------------------

_ASSESSED = """assessed AS (SELECT dst AS id, max(CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 ELSE 0 END)::DOUBLE AS s,
    max(CASE trend WHEN 'increasing' THEN 1.5 WHEN 'stable' THEN 1.0 WHEN 'decreasing' THEN 0.5 ELSE 0 END)::DOUBLE AS t FROM identifies GROUP BY dst),
named AS (SELECT id, s * t AS weight, CASE s WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS severity, CASE t WHEN 1.5 THEN 'increasing' WHEN 1 THEN 'stable' WHEN 0.5 THEN 'decreasing' END AS trend FROM assessed)"""
_JEOPARDISES = "jeopardises AS (SELECT l_partkey AS src, 'p' || (l_partkey % 40) AS dst FROM lineitem WHERE l_quantity < 10 UNION SELECT l_partkey, 'p' || (l_suppkey % 40) FROM lineitem WHERE l_quantity < 3)"
_FULFILS = "fulfils AS (SELECT DISTINCT 'p' || (p_partkey % 40) AS src, 'a' || (p_size % 12) AS dst FROM part WHERE p_partkey % 40 % 5 <> 0)"


def _jeopardises(g: Graph):
    li = g.table("lineitem")
    a = li.where("l_quantity < 10").select(F.col("l_partkey").alias("src"), _t("p", F.col("l_partkey") % 40).alias("dst"))
    return a.unionByName(li.where("l_quantity < 3").select(F.col("l_partkey").alias("src"), _t("p", F.col("l_suppkey") % 40).alias("dst")))


def _fulfils(g: Graph):
    return g.table("part").where("p_partkey % 40 % 5 <> 0").select(_t("p", F.col("p_partkey") % 40).alias("src"), _t("a", F.col("p_size") % 12).alias("dst"))


_STRATEGIC = f"""{_ASSESSED}, {_JEOPARDISES}, {_FULFILS}, shares AS (SELECT src, count(*) AS n FROM fulfils GROUP BY src),
ways AS (SELECT j.src AS threat, j.dst AS precept, f.dst AS attribute, a.severity, a.trend, a.weight / s.n AS score FROM jeopardises j JOIN named a ON a.id = j.src JOIN fulfils f ON f.src = j.dst JOIN shares s ON s.src = j.dst)"""


@query("g10_strategic_paths", f"WITH {_STRATEGIC} SELECT threat, precept, attribute, severity, trend, round(score, 6) AS score FROM ways")
def _(g):
    return T.strategic(g.identifies, _jeopardises(g), _fulfils(g)).withColumn("score", F.round("score", 6))


@query("g10_heat_map", f"""
WITH {_STRATEGIC} SELECT c.attribute, c.severity, c.of_precepts, count(DISTINCT w.threat) AS threats, count(DISTINCT w.precept) AS precepts, round(coalesce(sum(w.score), 0), 4) AS score
FROM (SELECT dst AS attribute, severity, count(*) AS of_precepts FROM fulfils, (VALUES ('critical'), ('high'), ('medium'), ('low')) v(severity) GROUP BY ALL) c LEFT JOIN ways w ON w.attribute = c.attribute AND w.severity = c.severity GROUP BY ALL""")  # fmt: skip
def _(g):
    return T.heat_map(T.strategic(g.identifies, _jeopardises(g), _fulfils(g)), _fulfils(g)).withColumn("score", F.round("score", 4))


@query("g10_tactical_paths", f"""
WITH {_ASSESSED}, c AS (SELECT dst, count(DISTINCT src) AS n FROM mitigates GROUP BY dst)
SELECT t.src AS threat, t.dst AS technique, coalesce(c.n, 0) AS controls, round(a.weight / (1 + coalesce(c.n, 0)), 6) AS score FROM (SELECT DISTINCT * FROM threat_technique) t JOIN named a ON a.id = t.src LEFT JOIN c ON c.dst = t.dst""")  # fmt: skip
def _(g):
    return T.tactical(g.identifies, g.threat_technique, g.mitigates).withColumn("score", F.round("score", 6))


@query("g10_asset_exposure", f"""
WITH {_ASSESSED}, targets AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity < 8), guards AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity > 48),
e AS (SELECT DISTINCT dst FROM about_control WHERE relationship_type = 'evidence'), p AS (SELECT g.src, count(*) AS controls, count(e.dst) AS evidenced FROM guards g LEFT JOIN e ON e.dst = g.dst GROUP BY g.src),
h AS (SELECT t.dst AS asset, count(*) AS threats, sum(a.weight) AS w FROM targets t JOIN named a ON a.id = t.src GROUP BY t.dst)
SELECT asset, threats, coalesce(controls, 0) AS controls, coalesce(evidenced, 0) AS evidenced, coalesce(evidenced, 0) = 0 AS exposed, round(w / (1 + coalesce(evidenced, 0)), 6) AS score FROM h LEFT JOIN p ON p.src = h.asset""")  # fmt: skip
def _(g):
    li = g.table("lineitem")
    targets = li.where("l_quantity < 8").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    guards = li.where("l_quantity > 48").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    evidence = g.about_control.where("relationship_type = 'evidence'").select(F.col("dst").alias("id"))
    return T.asset_centric(g.identifies, targets, guards, evidence).withColumn("score", F.round("score", 6))


@query("g10_priorities", f"""
WITH {_ASSESSED}, k AS (SELECT t.src AS id, avg((t.dst IN (SELECT dst FROM mitigates))::INT) AS coverage FROM (SELECT DISTINCT * FROM threat_technique) t GROUP BY t.src)
SELECT a.id AS threat, a.severity, a.trend, round(coalesce(k.coverage, 0), 6) AS coverage, round(a.weight * (1 - coalesce(k.coverage, 0)), 6) AS priority FROM named a LEFT JOIN k ON k.id = a.id""")  # fmt: skip
def _(g):
    out = T.priorities(g.identifies, g.threat_technique, g.mitigates)
    return out.withColumns({"coverage": F.round("coverage", 6), "priority": F.round("priority", 6)})
