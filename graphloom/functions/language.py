"""Language detection by character trigrams, learned from labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of profiles that are broadcast; beyond them the join shuffles.
SMALL_PROFILES = 500_000
#: Most languages that are summed side by side.
MANY_LANGUAGES = 64


def trigrams(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, gram, n): the trigrams of a text's lower-cased words, each word between two blanks.  Words are counted before they are cut up, so a word that comes often is cut once a group."""
    words = texts.select(*keys, F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("_w")).where("_w <> ''").groupBy(*keys, "_w").agg(F.count("*").alias("_c"))
    padded = words.withColumn("_w", F.concat(F.lit(" "), "_w", F.lit(" ")))
    grams = padded.select(*keys, "_c", F.explode(F.transform(F.sequence(F.lit(1), F.length("_w") - 2), lambda i: F.substring("_w", i, F.lit(3)))).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.sum("_c").alias("n"))


def learned(labelled: DataFrame, text: str = "body", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(profiles, floors): the log-probability of each gram in each language with one added to every count, as a gain over an unseen gram (lang, gram, gain), and that of an unseen one (lang, floor)."""
    counts = trigrams(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang).withColumnRenamed(lang, "lang")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kinds = counts.agg(F.countDistinct("gram").alias("kinds"))
    floors = sums.crossJoin(F.broadcast(kinds)).select("lang", (-F.log(F.col("total") + F.col("kinds"))).alias("floor"))
    return counts.select("lang", "gram", F.log(F.col("n") + 1).alias("gain")), floors


def detected(chunks: DataFrame, profiles: DataFrame, floors: DataFrame, text: str = "body", *keys: str) -> DataFrame:
    """(keys, lang, margin) of every row: the likeliest language, ties to the first name, and how much likelier a gram it is on average than the next one; null without letters or profiles.

    The keys must name one row each; rows of one key are one text.
    """
    langs = sorted(r["lang"] for r in floors.select("lang").limit(MANY_LANGUAGES + 1).collect())
    if 0 < len(langs) <= MANY_LANGUAGES and profiles.limit(SMALL_PROFILES + 1).count() <= SMALL_PROFILES:
        # A text's grams are summed in the task that cuts them: a row of sums leaves it, not the grams.
        gain = lambda x: F.sum(F.when(F.col("lang") == x, F.col("gain")))
        wide = profiles.groupBy("gram").agg(*[gain(x).alias(f"_g{i}") for i, x in enumerate(langs)])
        words = chunks.select(*keys, F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("_w")).where("_w <> ''").withColumn("_w", F.concat(F.lit(" "), "_w", F.lit(" ")))
        cut = words.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("_w") - 2), lambda i: F.substring("_w", i, F.lit(3)))).alias("gram"))
        sums = cut.join(F.broadcast(wide), "gram", "left").groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(len(langs))])
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.col(f"_g{i}").alias("gain")) for i, x in enumerate(langs)]))
        every = sums.select(*keys, "n", each.alias("_s")).select(*keys, "n", "_s.lang", "_s.gain").join(F.broadcast(floors), "lang")
    else:
        grams = trigrams(chunks, text, *keys)
        gains = grams.join(profiles, "gram").groupBy(*keys, "lang").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
        size = grams.groupBy(*keys).agg(F.sum("n").alias("n"))
        every = size.crossJoin(F.broadcast(floors)).join(gains, [*keys, "lang"], "left")
    # Every language is scored, those without a gram of the text at their floor.
    scored = every.select(*keys, "lang", F.round(F.coalesce("gain", F.lit(0.0)) / F.col("n") + F.col("floor"), 9).alias("score"))
    best = scored.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "lang"))), 1, 2).alias("b"))
    found = best.select(*keys, F.col("b")[0]["lang"].alias("lang"), (F.get("b", F.lit(1))["less"] - F.col("b")[0]["less"]).alias("margin"))
    return chunks.select(*keys).distinct().join(found, list(keys), "left")


def accuracy(found: DataFrame, truth: DataFrame, *keys: str) -> float:
    """The share of rows with a known language (keys, lang) that got it."""
    both = truth.where("lang IS NOT NULL").join(found.select(*keys, F.col("lang").alias("_found")), list(keys), "left")
    return both.agg(F.avg(F.coalesce((F.col("lang") == F.col("_found")).cast("int"), F.lit(0)))).first()[0] or 0.0
