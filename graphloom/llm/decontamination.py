"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Every k-gram of words is hashed; of each window of w consecutive k-grams the smallest hash is kept
(Schleimer, Wilkerson, Aiken 2003).  A span of k + w - 1 words that a document shares with an
item makes both keep the same hash, so joining the kept hashes finds every such document.  Here
k + w - 1 is the length of a contract window, so nothing is missed.  Found documents are
extended on each alignment: the windows of the item that recur there word for word are its hits.

Items shorter than a window are one window each; their whole text is hashed and looked up among the
documents' grams of that length, which costs nothing where there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed, maybe_broadcast, stored, table, unused

SPAN, GRAM = 10, 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java pattern of what separates words, after A-Z are lowered.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """The words of a text: runs of ASCII letters and digits and of whatever isn't ASCII; [] for null."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), BREAKS)
    return F.filter(parts, lambda w: w != "")


def gram_hashes(n: str, k: int, of: str = "words") -> Column:
    """Hashes of the k-grams of an array of words, in order; [] if it has fewer."""
    hashed = F.transform(F.sequence(F.lit(0), F.col(n) - k), lambda i: F.xxhash64(*[F.get(F.col(of), i + j) for j in range(k)]))
    return F.when(F.col(n) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: str, w: int) -> Column:
    """The smallest hash of each window of w hashes, without repeats.  Fewer than w hashes have no window."""
    size = F.size(hashes)
    least = F.transform(F.sequence(F.lit(0), size - w), lambda i: F.least(*[F.get(F.col(hashes), i + j) for j in range(w)]))
    return F.when(size >= w, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def whole_grams(k: int) -> Column:
    """Hashes of all grams of k words of the column `words`, without repeats, as short items are hashed."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.xxhash64(F.lit(k), F.xxhash64(F.slice("words", i, k)))))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, n: distinct items with words."""
    return fixed(benchmark, "words", words("text")).select("item_id", "words").distinct().withColumn("n", F.size("words")).where("n > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    Null texts and texts without words have no hits; null or repeated doc_ids are told apart by text_key, the text's hash, so
    repeated rows get their own equal results.  An empty benchmark leaves everything clean; items that share an item_id count once.
    """
    width = span - gram + 1
    items = stored(_items(benchmark).select("item_id", "words", "n", F.xxhash64("words").alias("item_key")))
    long_items = fixed(fixed(items.where(F.col("n") >= span), "h", gram_hashes("n", gram)), "kept", winnowed("h", width))
    prints = long_items.select(F.explode("kept").alias("print")).distinct()
    short = items.where(F.col("n") < span)
    lengths = sorted(r[0] for r in short.select("n").distinct().collect())  # span - 1 values at most
    short_prints = short.select(F.xxhash64("n", F.xxhash64(F.col("words"))).alias("print")).distinct()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = fixed(source, "words", words("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "words", F.size("words").alias("n"))
    marked = fixed(fixed(base, "h", gram_hashes("n", gram)), "kept", winnowed("h", width))
    for k in lengths:
        marked = fixed(marked.withColumnRenamed("kept", "_kept"), "kept", F.when(F.col("n") >= k, F.concat("_kept", whole_grams(k))).otherwise(F.col("_kept"))).drop("_kept")
    # One row a document without a print, which carries its length, and one for each kept hash.
    rows = marked.select("doc_id", "text_key", "n", F.explode_outer(F.concat(F.array(F.lit(None).cast("bigint")), "kept")).alias("print"))
    all_prints = maybe_broadcast(prints.unionByName(short_prints).distinct().withColumn("known", F.lit(True)), 24)
    found = stored(rows.join(all_prints, "print", "left").where(F.col("print").isNull() | F.col("known")).select("doc_id", "text_key", "n", "print"))

    suspects = found.where("print is not null")
    owners = long_items.select("item_key", F.explode("kept").alias("print")).unionByName(short.select("item_key", F.xxhash64("n", F.xxhash64(F.col("words"))).alias("print")))
    pairs = suspects.join(maybe_broadcast(owners, 24), "print").select("doc_id", "text_key", "item_key", "print").distinct()
    item_words = items.select("item_key", "words", "n").dropDuplicates(["item_key"])
    with_items = pairs.groupBy("doc_id", "text_key", "item_key").agg(F.collect_set("print").alias("prints")).join(maybe_broadcast(item_words, 400), "item_key")
    per_doc = with_items.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_key", F.col("words").alias("iw"), F.col("n").alias("m"))).alias("items"))
    per_doc = stored(per_doc.select("doc_id", "text_key", "items"))
    keyed = source.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    on = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))
    fits = maybe_broadcast(per_doc.select("doc_id", "text_key").distinct(), 24)
    texts = keyed.alias("d").join(fits.alias("p"), on, "left_semi").dropDuplicates(["doc_id", "text_key"])
    joined = fixed(texts.alias("d").join(per_doc.alias("p"), on).select("d.doc_id", "d.text_key", "d.text", "items"), "dw", words("text"))
    # Each place of the document where the item's first gram of a window stands gives an alignment; every window on it is compared word for word.
    cases = fixed(joined.withColumn("dn", F.size("dw")), "dh", gram_hashes("dn", gram, "dw")).select("doc_id", "text_key", "dw", "dn", "dh", F.explode("items").alias("it"))
    cases = fixed(cases.select("doc_id", "text_key", "dw", "dn", "dh", "it.item_key", "it.iw", "it.m"), "ih", gram_hashes("m", gram, "iw"))
    anchors = F.filter(F.sequence(F.lit(0), F.size("dh") - 1), lambda p: F.array_contains(F.col("ih"), F.get(F.col("dh"), p)))
    whole = F.filter(F.sequence(F.lit(0), F.col("dn") - F.col("m")), lambda p: F.slice("dw", p + 1, F.col("m")) == F.col("iw"))
    long_hits = F.filter(
        F.col("anchors"),
        lambda p: F.array_contains(F.col("grams"), F.array_join(F.slice("dw", p + 1, span), " ")),
    )
    cases = fixed(cases, "anchors", F.when((F.col("m") >= span) & (F.size("dh") > 0), anchors).otherwise(F.array().cast("array<int>")))
    cases = fixed(cases, "grams", F.when(F.col("m") >= span, F.transform(F.sequence(F.lit(1), F.col("m") - span + 1), lambda i: F.array_join(F.slice("iw", i, span), " "))).otherwise(F.array().cast("array<string>")))
    cases = fixed(cases, "places", F.when(F.col("m") >= span, long_hits).when(F.col("dn") >= F.col("m"), whole).otherwise(F.array().cast("array<int>")))
    hits = cases.where(F.size("places") > 0).select("doc_id", "text_key", "item_key", F.least(F.col("m"), F.lit(span)).alias("m"), "places")
    hits = stored(hits)
    # Words hit: the union of the intervals, places in order; each adds what reaches beyond those before.
    spans = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("a"), (p + F.col("m")).alias("e")))))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["a"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end")))
    n_hit = fixed(spans, "c", covered).select("doc_id", "text_key", F.col("c.n").alias("n_hit"))
    named = hits.select("doc_id", "text_key", "item_key").distinct().join(maybe_broadcast(items.select("item_key", F.col("item_id").cast("string").alias("item_id")).distinct(), 64), "item_key")
    ids = named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    verdict = n_hit.join(ids, (n_hit.doc_id.eqNullSafe(ids.doc_id)) & (n_hit.text_key == ids.text_key)).select(n_hit.doc_id.alias("_d"), n_hit.text_key.alias("_t"), "n_hit", "ids")
    every = found.where("print is null")
    out = every.join(verdict, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_words"), n.alias("n_hit"), F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def op7_decontamination_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs in which no window of a benchmark item occurs, unchanged."""
    d, t = unused(docs, "_d", "_t")
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    return docs.join(maybe_broadcast(found, 24), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left_anti")
