"""Scalar column functions: decay, time, identifiers, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import params as P


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cosine(a, b) -> Column:
    """Cosine similarity of two arrays in double; 0 if either is empty or has no length.  Of unequal lengths the products stop at the shorter; the norms are whole."""
    n = F.least(F.size(c(a)), F.size(c(b)))
    x, y = F.slice(c(a), 1, n), F.slice(c(b), 1, n)
    zero = F.lit(0.0)
    total = lambda v: F.aggregate(v, zero, lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda p: p.cast("double") * p.cast("double"))))
    size = norm(c(a)) * norm(c(b))
    return F.when((n > 0) & (size > 0), dot / size).otherwise(zero)


def distance(a, b) -> Column:
    return 1 - cosine(a, b)


def score(dist) -> Column:
    """1 - distance, to four places."""
    return F.round(1 - c(dist), 4)


def days_between(now, then) -> Column:
    """Fractional days from `then` to `now`."""
    return (F.unix_micros(c(now)) - F.unix_micros(c(then))) / F.lit(86_400_000_000.0)


def hours_since(now, then) -> Column:
    """Hours since a time; infinite if it is missing."""
    return F.coalesce((F.unix_micros(c(now)) - F.unix_micros(c(then))) / F.lit(3_600_000_000.0), F.lit(float("inf")))


def parse_time(text) -> Column:
    """An ISO time, without a zone in UTC; null if it can't be read."""
    return F.try_to_timestamp(c(text))


def time_label(ts) -> Column:
    return F.concat(F.date_format(c(ts), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def decayed(strength, rate, days, floor, incoming=None, factor: float = P.MODULATION_FACTOR, cap: float = P.MODULATION_CAP) -> Column:
    """max(floor, min(1, strength * exp(-rate' * days))): incoming edge weight divides the rate by min(1 + factor * weight, cap)."""
    divisor = F.lit(1.0) if incoming is None else F.greatest(F.least(1 + F.lit(factor) * c(incoming), F.lit(cap)), F.lit(1e-9))
    return F.greatest(c(floor), F.least(F.lit(1.0), c(strength) * F.exp(-c(rate) / divisor * c(days))))


def initial_strength(importance) -> Column:
    return F.lit(P.INITIAL_STRENGTH_FACTOR) * c(importance) / 5


def strength_floor(importance) -> Column:
    return F.lit(P.IMPORTANCE_FLOOR_FACTOR) * c(importance) / 5


def level(x) -> Column:
    """H, M, L as 3, 2, 1; null for anything else."""
    x = c(x)
    out = None
    for name, n in P.LEVELS.items():
        out = F.when(x == name, n) if out is None else out.when(x == name, n)
    return out


def priority_score(value, effort) -> Column:
    """value over effort; null unless both are given."""
    return level(value).cast("double") / level(effort)


def attack_id(x, major=None) -> Column:
    root = F.concat(F.lit("attack-enterprise"), F.lit("") if major is None else F.concat(F.lit("-v"), F.split(c(major), r"\.")[0]))
    return root if x is None else F.concat(F.lit("attack-enterprise."), c(x))


def control_id(x) -> Column:
    return F.concat(F.lit("sp800-53r5."), F.upper(F.trim(c(x))))


def base_control(x) -> Column:
    """A control id without its enhancement: AC-2(1) is AC-2."""
    return F.regexp_replace(F.trim(c(x)), r"\s*\(.*$", "")


def unpadded_control(x) -> Column:
    """AC-01 is AC-1; an enhancement goes too."""
    return F.regexp_replace(base_control(F.upper(c(x))), r"-0+(\d)", "-$1")


def csf_key(x) -> Column:
    return F.upper(F.trim(c(x)))


def numbered_id(prefix, number, width: int = 2) -> Column:
    return F.concat(c(prefix), F.lpad(c(number).cast("string"), width, "0"))


#: Clause numbers that a published crosswalk misprints.
CLAUSE_FIXES = {"6.11": "6.1.1", "6.13": "6.1.3"}


def clause_ids(x) -> Column:
    """Clause text to ids: 'Mandatory Clause: 7.1, 7.2' gives two, 'Annex A Controls: 5.1' one under `a.`, anything unnumbered none."""
    x = F.trim(c(x))
    fixes = F.create_map(*[F.lit(v) for kv in CLAUSE_FIXES.items() for v in kv])
    clauses = F.transform(F.split(F.regexp_replace(x, r"^Mandatory Clause:", ""), ","), lambda p: F.trim(p))
    clauses = F.transform(F.filter(clauses, lambda p: p.rlike(r"^\d+(\.\d+)*$")), lambda p: F.concat(F.lit("iso-27001-2022."), F.coalesce(F.element_at(fixes, p), p)))
    annex = F.regexp_replace(F.trim(F.regexp_replace(x, r"^Annex A Controls:", "")), r",+$", "")
    return (
        F.when(x.startswith("Mandatory Clause:"), clauses)
        .when(x.startswith("Annex A Controls:") & annex.rlike(r"^\d+(\.\d+)*$"), F.array(F.concat(F.lit("iso-27001-2022.a."), annex)))
        .otherwise(F.array().cast("array<string>"))
    )


def parent_id(x) -> Column:
    """An id without its last dotted part; null if it has one part."""
    return F.when(c(x).contains("."), F.regexp_replace(c(x), r"\.[^.]*$", ""))


def threat_id(report, text) -> Column:
    return F.concat(F.lit("threat-"), c(report), F.lit("-"), F.substring(F.sha1(c(text)), 1, 8))


def cache_key(model: str, text) -> Column:
    return F.sha2(F.concat(F.lit(model + ":"), c(text)), 256)


def truncated(x, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c(x)) > n, F.concat(F.substring(c(x), 1, n), F.lit(tail))).otherwise(c(x))


def first_and_more(items, k: int) -> Column:
    """The first k of an array joined by commas, and how many more there are."""
    a = c(items)
    head = F.array_join(F.slice(a, 1, k), ", ")
    return F.when(F.size(a) > k, F.concat(head, F.lit(" +"), (F.size(a) - k).cast("string"), F.lit(" more"))).otherwise(head)


def first_paragraph(x, limit: int | None = None) -> Column:
    p = F.trim(F.split(c(x), "\n\n")[0])
    return F.substring(p, 1, limit) if limit else p


def framework_label(x, prefixes: dict[str, str]) -> Column:
    """A label by the id's beginning, else its first dotted part."""
    out = None
    for p, label in prefixes.items():
        out = F.when(c(x).startswith(p), label) if out is None else out.when(c(x).startswith(p), label)
    rest = F.split(c(x), r"\.")[0]
    return rest if out is None else out.otherwise(rest)


def as_list(x) -> Column:
    """Text to a list: null stays, a JSON array is read, a bare word is one item, a malformed array one item unchanged."""
    x = c(x)
    read = F.from_json(x, ArrayType(StringType()))
    return F.when(x.isNull(), F.lit(None).cast("array<string>")).when(F.trim(x).startswith("[") & read.isNotNull(), read).otherwise(F.array(x))


def full_text(fact, so_what) -> Column:
    return F.concat(c(fact), F.when(c(so_what).isNotNull() & (c(so_what) != ""), F.concat(F.lit(" "), c(so_what))).otherwise(F.lit("")))
