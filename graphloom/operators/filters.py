"""Predicates, validation and projections over node tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import c, days_between, hours_since


def active() -> Column:
    """Not archived, merged or ephemeral; a missing flag counts as active."""
    return (F.coalesce(F.col("status"), F.lit("active")) == "active") & ~F.coalesce(F.col("ephemeral"), F.lit(False))


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are given."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def any_of(column: str, wanted: Iterable[str]) -> Column:
    """The list column shares an item with `wanted`; a null list doesn't."""
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted]).cast("array<string>")), F.lit(False))


def touches_file(path: str, role: str = "any") -> Column:
    has = lambda col: F.coalesce(F.array_contains(col, path), F.lit(False))
    return {"modified": has("files_modified"), "read": has("files_read"), "any": has("files_modified") | has("files_read")}[role]


def include_exclude(column: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    ok = F.lit(True)
    if include:
        ok = ok & any_of(column, include)
    if exclude:
        ok = ok & ~any_of(column, exclude)
    return ok


def recent(column: str, now: Column, days: int) -> Column:
    return F.col(column) >= now - F.make_interval(days=F.lit(days))


def validity(now) -> Column:
    """active, announced or expired, by a norm's dates."""
    now = c(now)
    return F.when(F.col("valid_until") < now, "expired").when(F.col("valid_from") > now, "announced").otherwise("active")


def not_deprecated(column: str = "status") -> Column:
    """Drops deprecated rows, and those without a status."""
    return F.col(column) != "deprecated"


def errors(rules: dict[str, tuple[str, Iterable[str]]], *more: tuple[Column, str]) -> Column:
    """An array of messages: a field (name -> (column, allowed words)) outside its vocabulary, and every further (failure, message)."""
    found = [F.when(F.col(col).isNotNull() & ~F.col(col).isin(*allowed), F.lit(f"invalid {name}")) for name, (col, allowed) in rules.items()]
    found += [F.when(bad, F.lit(message)) for bad, message in more]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def modality_error() -> Column:
    return F.col("modality").isNotNull() & (F.coalesce(F.col("statement_type"), F.lit("")) != "normative")


# The layers of the two matrices.
MAIN_LAYERS = ("contextual", "conceptual", "logical", "physical", "component", "operational")
SERVICE_LAYERS = ("contextual", "conceptual", "logical", "physical", "component")


def layer_error() -> Column:
    """The layer doesn't fit the cell_role: a matrix cell needs one of its matrix's layers, any other role takes one of either or none."""
    layer, role = F.col("layer"), F.coalesce("cell_role", F.lit(""))
    of = lambda layers: F.coalesce(layer.isin(*layers), F.lit(False))
    return F.when(role == "main-matrix-cell", ~of(MAIN_LAYERS)).when(role == "service-mgmt-cell", ~of(SERVICE_LAYERS)).otherwise(layer.isNotNull() & ~of(MAIN_LAYERS) & ~of(SERVICE_LAYERS))


def framework_errors() -> Column:
    """What is wrong with a framework node's modality, layer and cell role, as messages."""
    return errors({}, (modality_error(), "modality needs statement_type normative"), (layer_error(), "layer doesn't fit cell_role"))


def succession_errors(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, error) of deprecated rows whose superseded_by is missing, empty or names no known node."""
    gone = rows.where("status = 'deprecated'").select("id", F.nullif("superseded_by", F.lit("")).alias("superseded_by"))
    there = known.select(F.col("id").alias("superseded_by"), F.lit(True).alias("_known")).distinct()
    bad = gone.join(there, "superseded_by", "left").where("_known IS NULL")
    return bad.select("id", F.when(F.col("superseded_by").isNull(), "superseded_by is required").otherwise("superseded_by is unknown").alias("error"))


def missing(ids: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The wanted ids that no node has."""
    return ids.select(F.col(key)).distinct().join(nodes.select(F.col("id").alias(key)), key, "left_anti")


def disjoint(a: str, b: str) -> Column:
    empty = F.array().cast("array<string>")
    return ~F.arrays_overlap(F.coalesce(F.col(a), empty), F.coalesce(F.col(b), empty))


def leaves(df: DataFrame, levels: Iterable[str], not_prefix: Iterable[str] = ()) -> DataFrame:
    df = df.where(F.col("level").isin(*levels))
    for p in not_prefix:
        df = df.where(~F.col("id").startswith(p))
    return df


def filled(df: DataFrame) -> DataFrame:
    """Missing lists empty, missing weights at their default."""
    for name, kind in df.dtypes:
        if kind == "array<string>":
            df = df.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
        elif name == "weight":
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(P.DEFAULT_EDGE_WEIGHT)))
    return df


def rest_status(now, last_short, last_long) -> list[Column]:
    """Overdue flags, days since, and the action to take.  A rest that never ran is overdue; a long rest covers a short one."""
    short, long_ = hours_since(now, last_short), hours_since(now, last_long)
    over_s, over_l = short > 24 * P.SHORT_REST_DAYS, long_ > 24 * P.LONG_REST_DAYS
    ago = lambda h: F.when(h != float("inf"), F.round(h / 24, 1))
    never = F.when(c(last_long).isNull(), "long_rest_never_ran").when(c(last_short).isNull(), "short_rest_never_ran")
    action = never.when(over_s & over_l, "both").when(over_l, "long_rest").when(over_s, "short_rest").otherwise("none")
    return [over_s.alias("short_overdue"), over_l.alias("long_overdue"), ago(short).alias("short_days_ago"), ago(long_).alias("long_days_ago"), action.alias("recommended_action")]


def short_due(now, last, every: float = 6.0) -> Column:
    return hours_since(now, last) >= every


def long_due(now, last, least: float = 20.0, overdue: float = 27.0, hour: int = 3) -> Column:
    h = hours_since(now, last)
    return (h >= overdue) | ((h >= least) & (F.hour(c(now)) == hour))


def age_days(now, column) -> Column:
    return F.round(days_between(now, column), 1)
