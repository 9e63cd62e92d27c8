"""Spelling variants: words that differ by one edit, joined by even partition.

By the pigeonhole principle one edit leaves one of a word's two halves whole.  Every word of l characters is indexed under both its
halves (the first l // 2 characters, the others), with l and the side in the key.  Words of l characters find each other under equal keys
(a replaced character); a word of l + 1 characters probes with the substrings that can be such halves: its start, and its end shifted by one.

A key that many words share (a common beginning) isn't compared pair by pair: the part of the word outside the key differs by the same one
edit, so it is halved again, and so on until keys are small or only one character is left, where a group is no larger than the alphabet
allows.  No pair is lost by that, no group is collected, and every pair that a join puts out is a verified one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored, table, text_input

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: The noise of the counted words: one run in so many loses a character.
ONE_IN = 31
#: Most pairs that the words of one key are compared in.
PAIRS = 1000
#: Tasks that the rows of a crowded key are spread over where crowded keys can't be broadcast.
SALTS = 16
#: Distinct words counted in a task before their counts are passed on, and most letters of a word that is counted there.
HELD, SHORT = 300_000, 64


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """word, n: the words of at least so many letters and occurrences, over all whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.  If `one_in` divides the crc32 h of
    "<doc_id>:<run>" the run's character at h % length is left out (0: never).  Null and empty texts have no words, a null id
    counts as empty text, repeated rows count as often as they stand there, an empty table gives no words.
    """
    # Latin-1 has one byte for each of these letters; every other character becomes "?", which is none of them.
    runs = re.compile(b"[a-z\xc0-\xff]{%d,}" % least_length).findall

    def run(batches):
        counts: Counter[bytes] = Counter()

        def passed_on(found):
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                start = zlib.crc32(f"{i.as_py()}:".encode() if i.is_valid else b":")
                long: Counter[bytes] = Counter()
                for word, n in Counter(runs((t.as_py() or "").encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if one_in and h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        (counts if len(word) <= SHORT else long)[word] += n
                if long:
                    yield passed_on(long)
                if len(counts) >= HELD:
                    yield passed_on(counts)
                    counts.clear()
        if counts:
            yield passed_on(counts)

    found = text_input(docs).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice, under the keys of the halves of its rest, the characters [lo, hi) outside its key; the other half is the new rest.  A `longer` row has one character more than the words it looks for, and its second half starts one later."""
    lo, hi, word = F.col("lo"), F.col("hi"), F.col("word")
    extra = F.col("longer").cast("int")
    middle = lo + F.floor((hi - lo - extra) / 2).cast("int")
    first = F.xxhash64("key", F.lit(1), F.substring(word, lo + 1, middle - lo))
    second = F.xxhash64("key", F.lit(2), F.substring(word, middle + extra + 1, hi - middle - extra))
    halves = F.array(
        F.struct(first.alias("key"), middle.alias("lo"), hi.alias("hi")),
        F.struct(second.alias("key"), lo.alias("lo"), (middle + extra).alias("hi")),
    )
    return rows.select("word", "n", "longer", F.inline(halves))


def crowded_keys(rows: DataFrame, most: int) -> DataFrame:
    """The keys whose words make more than so many pairs and can still be halved."""
    short, long = F.sum(F.when(F.col("longer"), 0.0).otherwise(1.0)), F.sum(F.col("longer").cast("double"))
    rest = F.max(F.col("hi") - F.col("lo") - F.col("longer").cast("int"))
    counts = rows.groupBy("key").agg(short.alias("short"), long.alias("long"), rest.alias("rest"))
    return counts.where((F.col("rest") > 1) & (F.col("short") * ((F.col("short") - 1) / 2 + F.col("long")) > most)).select("key")


def under_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose key is (left_semi) or isn't (left_anti) among keys.  Few keys are broadcast; else the rows of each key are spread over SALTS tasks."""
    few = maybe_broadcast(keys, 32)
    if few is not keys:
        return rows.join(few, "key", how)
    salts = keys.select("key", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(salts, ["key", "salt"], how).drop("salt")


def one_edit(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of rows under one key that are exactly one edit apart; of equal lengths a < b, else b is the longer word."""
    a = rows.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, (a.key == b.key) & near).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n), each pair once: all words that differ by exactly one inserted, deleted or replaced character.

    `words` has distinct words with their counts n; null words are in no pair, and an empty table gives none.
    """
    size = F.length("word")
    roles = F.array(*[F.struct(F.lit(longer).alias("longer"), F.xxhash64(size - int(longer)).alias("key")) for longer in (False, True)])
    known = words.where(F.col("word").isNotNull() & (size > 0))
    rows = halved(known.select("word", "n", F.lit(0).alias("lo"), size.alias("hi"), F.inline(roles)))
    found = []
    while True:
        crowded = stored(crowded_keys(rows, pairs))
        if crowded.isEmpty():
            found.append(one_edit(rows))
            break
        found.append(stored(one_edit(under_keys(rows, crowded, "left_anti"))))
        rows = halved(stored(under_keys(rows, crowded, "left_semi")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def last_of(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along its form to the last, by doubling the steps until none leads on."""
    paths = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if paths.join(on, "root", "left_semi").isEmpty():
            return paths
        paths = stored(paths.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(words: DataFrame, factor: int = FACTOR, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n; distinct words).

    A word's form is its near word of largest n (of equals the first in code-point order), if that n is at least
    `factor` times its own; counts grow along forms, so these end.  A word without form is its own root.
    """
    known = stored(words.select("word", F.col("n").cast("long").alias("n")))
    links = stored(near_pairs(known, pairs))
    near = links.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        links.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    # A word has at most a few thousand near words: one for each letter at each place.
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = (-F.col("best.less") >= F.lit(factor) * F.col("n")) & F.col("best").isNotNull()
    out = stored(
        known.join(best, "word", "left").select(
            "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, -F.col("best.less")).alias("form_n")
        )
    )
    roots = last_of(out.where(F.col("form").isNotNull()))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
