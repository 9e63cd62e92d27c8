"""What nodes inherit: jurisdictions of norms and controls, and values bound to parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import closure

# Fixed value: how a text names a parameter.
PLACEHOLDER = r'\{\{\s*insert:\s*param,\s*param-id="([^"]*)"\s*\}\}'
#: Kinds of binding sources, the most specific first.
SPECIFICITY = ("section", "policy")


def norm_jurisdictions(norms: DataFrame, contains: DataFrame, applies_in: DataFrame) -> DataFrame:
    """(id, jurisdiction) of every norm: of its own and its ancestors' sets, what all allow.

    A norm without a set of its own has its nearest ancestor's; a set narrows what lies above and never widens it.  Norms without a set
    on their way up have no rows.
    """
    own = applies_in.select(F.col("src").alias("anc"), F.col("dst").alias("jurisdiction")).distinct()
    up = closure(norms, contains).select(F.col("start").alias("id"), F.col("id").alias("anc"))
    sets = up.join(own.select("anc").distinct(), "anc").groupBy("id").agg(F.count("*").alias("sets"))
    allowed = up.join(own, "anc").groupBy("id", "jurisdiction").agg(F.count("*").alias("allow"))
    return allowed.join(sets, "id").where("allow = sets").select("id", "jurisdiction")


def widened(norms: DataFrame, contains: DataFrame, applies_in: DataFrame) -> DataFrame:
    """(id, jurisdiction, ancestor): what a norm claims for itself although its nearest ancestor with a set lacks it: errors of the data."""
    own = applies_in.select(F.col("src").alias("id"), F.col("dst").alias("jurisdiction")).distinct()
    holders = own.select(F.col("id").alias("anc")).distinct()
    up = closure(norms, contains).where("depth > 0").select(F.col("start").alias("id"), F.col("id").alias("anc"), "depth")
    nearest = up.join(holders, "anc").groupBy("id").agg(F.min_by("anc", F.struct("depth", "anc")).alias("ancestor"))
    claims = own.join(nearest, "id")
    return claims.join(own.select(F.col("id").alias("ancestor"), "jurisdiction"), ["ancestor", "jurisdiction"], "left_anti").select("id", "jurisdiction", "ancestor")


def control_jurisdictions(controls: DataFrame, contains: DataFrame, maps_to: DataFrame, norms: DataFrame) -> DataFrame:
    """(id, jurisdiction) of every control: all that the norms (id, jurisdiction) bring that map to it or to an ancestor of it."""
    direct = maps_to.select(F.col("src").alias("norm"), F.col("dst").alias("anc")).join(norms.select(F.col("id").alias("norm"), "jurisdiction"), "norm").select("anc", "jurisdiction").distinct()
    up = closure(controls, contains).select(F.col("start").alias("id"), F.col("id").alias("anc"))
    return up.join(direct, "anc").select("id", "jurisdiction").distinct()


def bound_parameters(requests: DataFrame, has_param: DataFrame, binds: DataFrame, sources: DataFrame, orgs: DataFrame) -> DataFrame:
    """(org, control, param, value, source, distance, bound) for each parameter of the controls that an organisation has in scope.

    requests: (org, control).  has_param: control to param (src, dst).  binds: (src, param, value, bound_at).  sources: (id, kind, status, org) of policies and
    their sections.  orgs: organisations under organisations (src over dst).  Only active sources bind.  The value bound nearest up
    the organisations counts; there a section's goes before a policy's, then the latest, then the smaller source.
    A parameter that nothing binds is reported with bound = false.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(SPECIFICITY)], F.lit(len(SPECIFICITY)))
    live = sources.where("status = 'active'").select(F.col("id").alias("src"), rank.alias("rank"), F.col("org").alias("scope"))
    age = F.coalesce(-F.unix_micros(F.col("bound_at").cast("timestamp")), F.lit(2**63 - 1))
    order = F.struct("rank", age.alias("age"), "src")
    # One binding a parameter and organisation, before any meets a request.
    best = binds.join(live, "src").where("value IS NOT NULL").groupBy("param", "scope").agg(F.min_by(F.struct("value", "src"), order).alias("b"))
    needs = requests.select("org", "control").distinct().join(has_param.select(F.col("src").alias("control"), F.col("dst").alias("param")).distinct(), "control")
    up = closure(requests.select(F.col("org").alias("id")), orgs).select(F.col("start").alias("org"), F.col("id").alias("scope"), F.col("depth").alias("distance"))
    wanted = needs.select("org", "param").distinct().join(up, "org").join(best, ["param", "scope"])
    found = wanted.groupBy("org", "param").agg(F.min_by(F.struct("b.value", "b.src", "distance"), "distance").alias("f"))
    out = needs.join(found, ["org", "param"], "left")
    return out.select("org", "control", "param", F.col("f.value").alias("value"), F.col("f.src").alias("source"), F.col("f.distance").alias("distance"), F.col("f").isNotNull().alias("bound"))


def rendered(texts: DataFrame, values: DataFrame, text: str = "text", keys: tuple[str, ...] = ("org", "control")) -> DataFrame:
    """texts with their placeholders replaced by the values (keys..., param, value); those without a value stay as they are.

    One row a text and organisation: texts are joined with the organisations that have values for them on the keys both have.
    """
    on = [k for k in keys if k in texts.columns]
    held = values.where("value IS NOT NULL").groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("param", "value")))).alias("_values"))
    every = values.select(*keys).distinct().join(held, list(keys), "left")
    return texts.join(every, on).withColumn(text, _filled(F.col(text), F.col("_values"))).drop("_values")


def _filled(text: Column, values: Column) -> Column:
    names, whole = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    between = F.split(text, PLACEHOLDER)
    pieces = F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.when(i < F.size(names), F.coalesce(F.try_element_at(values, F.get(names, i)), F.get(whole, i))), F.lit(""))))
    return F.array_join(pieces, "")


def unbound(values: DataFrame) -> DataFrame:
    """(org, params, controls): how many parameters each organisation leaves open, over how many controls."""
    return values.where(~F.col("bound")).groupBy("org").agg(F.countDistinct("param").alias("params"), F.countDistinct("control").alias("controls"))


def nearest_value(nodes: DataFrame, contains: DataFrame, values: DataFrame) -> DataFrame:
    """(id, value, holder, distance): the value of the nearest of a node and its ancestors that has one, of equally near ones the smallest holder's; null where none has."""
    up = closure(nodes, contains).select(F.col("start").alias("id"), F.col("id").alias("holder"), F.col("depth").alias("distance"))
    held = values.where("value IS NOT NULL").select(F.col("id").alias("holder"), "value")
    w = W.partitionBy("id").orderBy("distance", "holder", "value")
    first = up.join(held, "holder").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return nodes.select("id").distinct().join(first, "id", "left").select("id", "value", "holder", "distance")
