"""Language detection: held-out accuracy, and rows out of the ordinary."""

import math
import re

from pyspark.sql import functions as F

from graphloom.functions import language as N
from graphloom.functions import text as T

SF = "/root/testdata/sf0.01"


def test_held_out_chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("text", "body")
    held = docs.where("doc_id % 5 = 0")
    profiles, floors = N.learned(docs.where("doc_id % 5 <> 0"))
    chunks = T.sliding_chunks(held)
    found = N.detected(chunks, profiles, floors, "body", "doc_id", "sequence")
    truth = chunks.join(held.select("doc_id", "lang"), "doc_id").select("doc_id", "sequence", "lang")
    assert N.accuracy(found, truth, "doc_id", "sequence") >= 0.97


def test_small_profiles_by_hand(spark):
    docs = spark.createDataFrame([("en", "the The"), ("de", "Der die"), (None, "not learned"), ("fr", None), ("de", "")], "lang string, body string")
    profiles, floors = N.learned(docs)
    got = {(r["lang"], r["gram"]): round(r["gain"], 12) for r in profiles.collect()}
    assert got == {("en", " th"): round(math.log(3), 12), ("en", "the"): round(math.log(3), 12), ("en", "he "): round(math.log(3), 12)} | {("de", x): round(math.log(2), 12) for x in (" de", "der", "er ", " di", "die", "ie ")}
    assert {r["lang"]: round(r["floor"], 12) for r in floors.collect()} == {"en": round(-math.log(6 + 9), 12), "de": round(-math.log(6 + 9), 12)}
    rows = [(1, "THE"), (2, "die der"), (3, ""), (4, None), (5, "123 --"), (6, "xyz"), (2, "die der"), (7, "the " * 5000)]
    found = N.detected(spark.createDataFrame(rows, "id long, body string").withColumn("lang", F.lit("zz")).withColumn("n", F.lit(0)), profiles, floors, "body", "id")
    assert {r["id"]: r["lang"] for r in found.collect()} == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: "de", 7: "en"}
    assert math.isclose({r["id"]: r["margin"] for r in found.collect()}[1], math.log(3), abs_tol=1e-8)
    assert N.detected(spark.createDataFrame(rows, "id long, body string"), profiles.limit(0), floors.limit(0), "body", "id").where("lang IS NOT NULL").count() == 0


def test_grams_of_a_text_are_not_grouped(spark):
    docs = spark.createDataFrame([("en", "the cat sat"), ("de", "der hund die")], "lang string, body string")
    found = N.detected(spark.createDataFrame([(1, "the the der"), (2, "die")], "id long, body string"), *N.learned(docs), "body", "id")
    assert not re.search(r"Aggregate \[id#\w+, (gram|_w)#", found._jdf.queryExecution().optimizedPlan().toString())
    assert {r["id"]: r["lang"] for r in found.collect()} == {1: "en", 2: "de"}


def test_large_profiles_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "the cat sat"), ("de", "der hund die")], "lang string, body string")
    profiles, floors = N.learned(docs)
    rows = spark.createDataFrame([(1, "the the der"), (2, "die xyz"), (3, "!")], "id long, body string")
    small = sorted(map(tuple, N.detected(rows, profiles, floors, "body", "id").collect()))
    monkeypatch.setattr(N, "SMALL_PROFILES", 1)
    large = sorted(map(tuple, N.detected(rows, profiles, floors, "body", "id").collect()))
    assert [r[:2] for r in small] == [r[:2] for r in large]
    assert all(x[2] == y[2] or math.isclose(x[2], y[2], abs_tol=1e-8) for x, y in zip(small, large))
