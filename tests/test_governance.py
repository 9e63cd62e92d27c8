"""Inheritance, parameter bindings and threat traversals on literal graphs."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import inheritance as H
from graphloom.operators import threats as T


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def tuples(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_jurisdictions(spark):
    tree = edges(spark, ("root", "a"), ("a", "b"), ("root", "c"), ("c", "d"))
    scope = edges(spark, ("root", "EU"), ("root", "DE"), ("root", "FR"), ("a", "DE"), ("b", "DE"), ("b", "US"), ("d", "FR"), ("d", "FR"), ("lone", "JP"))
    norms = H.norm_jurisdictions(ids(spark, "root", "a", "b", "c", "d", "lone", "none"), tree, scope)
    assert tuples(norms, "id", "jurisdiction") == {("root", "EU"), ("root", "DE"), ("root", "FR"), ("a", "DE"), ("b", "DE"), ("c", "EU"), ("c", "DE"), ("c", "FR"), ("d", "FR"), ("lone", "JP")}
    assert tuples(H.widened(ids(spark, "a", "b", "d", "lone"), tree, scope), "id", "jurisdiction", "ancestor") == {("b", "US", "a")}
    controls = H.control_jurisdictions(ids(spark, "K", "K1", "K2"), edges(spark, ("K", "K1"), ("K", "K2")), edges(spark, ("a", "K"), ("d", "K1"), ("none", "K2")), norms)
    assert tuples(controls, "id", "jurisdiction") == {("K", "DE"), ("K1", "DE"), ("K1", "FR"), ("K2", "DE")}


def test_bound_parameters(spark):
    day = dt.datetime
    orgs = edges(spark, ("group", "firm"), ("firm", "unit"))
    sources = spark.createDataFrame([
        ("p-group", "policy", "active", "group"), ("s-group", "section", "active", "group"), ("p-firm", "policy", "active", "firm"), ("p-firm2", "policy", "active", "firm"), ("s-unit", "section", "draft", "unit"), ("p-other", "policy", "active", "other"),
    ], "id string, kind string, status string, org string")
    binds = spark.createDataFrame([
        ("p-group", "x", "90 days", day(2024, 5, 1)), ("s-group", "x", "60 days", day(2024, 1, 1)), ("p-firm", "x", "30 days", day(2024, 1, 1)), ("p-firm2", "x", "20 days", day(2024, 2, 1)), ("s-unit", "x", "1 day", day(2024, 9, 1)),
        ("p-group", "y", "all", day(2024, 1, 1)), ("s-group", "y", "some", day(2023, 1, 1)), ("p-other", "z", "no", day(2024, 1, 1)), ("p-firm", "w", None, day(2024, 1, 1)), ("p-firm", "v", "undated", None), ("p-firm2", "v", "dated", day(2020, 1, 1)),
    ], "src string, param string, value string, bound_at timestamp")
    params = edges(spark, ("ac-1", "x"), ("ac-1", "y"), ("ac-1", "z"), ("ac-2", "x"), ("ac-2", "w"), ("ac-2", "v"))
    requests = spark.createDataFrame([("unit", "ac-1"), ("unit", "ac-2"), ("group", "ac-1"), ("unit", "ac-1")], "org string, control string")
    got = H.bound_parameters(requests, params, binds, sources, orgs)
    assert tuples(got, "org", "control", "param", "value", "source", "distance", "bound") == {
        ("unit", "ac-1", "x", "20 days", "p-firm2", 1, True), ("unit", "ac-1", "y", "some", "s-group", 2, True), ("unit", "ac-1", "z", None, None, None, False),
        ("unit", "ac-2", "x", "20 days", "p-firm2", 1, True), ("unit", "ac-2", "w", None, None, None, False), ("unit", "ac-2", "v", "dated", "p-firm2", 1, True),
        ("group", "ac-1", "x", "60 days", "s-group", 0, True), ("group", "ac-1", "y", "some", "s-group", 0, True), ("group", "ac-1", "z", None, None, None, False),
    }
    assert got.count() == 9 and tuples(H.unbound(got), "org", "params", "controls") == {("unit", 2, 2), ("group", 1, 1)}
    p = '{{{{ insert: param, param-id="{}" }}}}'.format
    texts = spark.createDataFrame([("ac-1", f"Keep {p('x')} and {p('z')}, {p('x')}."), ("ac-2", "Nothing $1 to fill"), ("ac-9", "elsewhere"), ("ac-2", None)], "control string, text string")
    assert tuples(H.rendered(texts, got), "org", "control", "text") == {
        ("unit", "ac-1", f"Keep 20 days and {p('z')}, 20 days."), ("group", "ac-1", f"Keep 60 days and {p('z')}, 60 days."), ("unit", "ac-2", "Nothing $1 to fill"), ("unit", "ac-2", None),
    }
    empty = requests.limit(0)
    assert H.bound_parameters(empty, params, binds, sources, orgs).count() == 0


def test_nearest_value(spark):
    tree = edges(spark, ("r", "a"), ("a", "b"), ("q", "b"))
    values = spark.createDataFrame([("r", "low"), ("q", "high"), ("a", None)], "id string, value string")
    got = H.nearest_value(ids(spark, "b", "a", "x"), tree, values)
    assert tuples(got, "id", "value", "holder", "distance") == {("b", "high", "q", 1), ("a", "low", "r", 1), ("x", None, None, None)}


def test_threat_traversals(spark):
    seen = spark.createDataFrame([("r1", "t1", "high", "stable"), ("r2", "t1", "critical", "decreasing"), ("r1", "t2", "medium", "increasing"), ("r1", "t3", "odd", None)], "src string, dst string, severity string, trend string")
    assert tuples(T.assessed(seen), "id", "severity", "trend", "weight", "reports") == {("t1", "critical", "stable", 4.0, 2), ("t2", "medium", "increasing", 3.0, 1), ("t3", None, None, 0.0, 1)}
    fulfils = edges(spark, ("p1", "trust"), ("p1", "safety"), ("p2", "trust"), ("p3", "idle"))
    ways = T.strategic(seen, edges(spark, ("t1", "p1"), ("t1", "p1"), ("t2", "p2"), ("t9", "p2")), fulfils)
    assert tuples(ways, "threat", "precept", "attribute", "score") == {("t1", "p1", "trust", 2.0), ("t1", "p1", "safety", 2.0), ("t2", "p2", "trust", 3.0)}
    cells = T.heat_map(ways, fulfils)
    assert cells.count() == 12
    assert tuples(cells.where("threats > 0"), "attribute", "severity", "threats", "precepts", "of_precepts", "score") == {("trust", "critical", 1, 1, 2, 2.0), ("safety", "critical", 1, 1, 1, 2.0), ("trust", "medium", 1, 1, 2, 3.0)}
    techniques, mitigates = edges(spark, ("t1", "T1"), ("t1", "T2"), ("t2", "T3")), edges(spark, ("c1", "T1"), ("c2", "T1"), ("c1", "T1"))
    assert tuples(T.tactical(seen, techniques, mitigates), "threat", "technique", "controls", "score") == {("t1", "T1", 2, 4 / 3), ("t1", "T2", 0, 4.0), ("t2", "T3", 0, 3.0)}
    assert tuples(T.priorities(seen, techniques, mitigates), "threat", "coverage", "priority") == {("t1", 0.5, 2.0), ("t2", 0.0, 3.0), ("t3", 0.0, 0.0)}
    exposed = T.asset_centric(seen, edges(spark, ("t1", "A"), ("t2", "A"), ("t2", "B"), ("t8", "C")), edges(spark, ("A", "c1"), ("A", "c2"), ("B", "c2")), ids(spark, "c1"))
    assert tuples(exposed, "asset", "threats", "controls", "evidenced", "exposed", "score") == {("A", 2, 2, 1, False, 3.5), ("B", 1, 1, 0, True, 3.0)}
    assert T.heat_map(ways.limit(0), fulfils).agg(F.sum("threats")).first()[0] == 0
