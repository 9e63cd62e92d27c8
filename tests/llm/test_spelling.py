"""Spelling variants against brute force and on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import spelling
from graphloom.llm.common import table

SF = "/root/testdata/sf0.001"


def words_by_hand(rows, least_length=7, least_count=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def near(a, b):
    """By definition: equal but for one place, or equal once one character is left out of the longer."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n, factor=10):
    links = defaultdict(set)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for size, some in by_length.items():
        for i, a in enumerate(some):
            for b in some[i + 1 :] + by_length.get(size + 1, []):
                if near(a, b):
                    links[a].add(b)
                    links[b].add(a)
    form = {w: min(links[w], key=lambda x: (-n[x], x)) for w in n if links[w]}
    form = {w: f for w, f in form.items() if n[f] >= factor * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(links[w]), n.get(form.get(w))) for w in n}


def as_tuples(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_query_is_brute_force(spark):
    got = as_tuples(spelling.op11_spelling_variants(spark, SF))
    n = words_by_hand([(d["doc_id"], d["text"]) for d in table(spark, SF, "documents").collect()])
    assert len(got) == len(n) and set(got) == variants_by_hand(n)


@pytest.mark.parametrize("pairs", [0, 3, 1000])
@pytest.mark.parametrize("letters,least,most", [("ab", 1, 7), ("abé", 4, 9), ("a", 1, 9)])
def test_crowded_keys_lose_nothing(spark, letters, least, most, pairs):
    rng = random.Random(f"{letters}{pairs}")
    n = {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))): 0 for _ in range(250)}
    n = {w: rng.choice([1, 2, 10, 11, 100, 1000, 20_000]) for w in n}
    got = as_tuples(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), pairs=pairs))
    assert len(got) == len(n) and set(got) == variants_by_hand(n)


def test_common_beginning(spark, monkeypatch):
    """One key that every word shares, with crowded keys too many to broadcast."""
    monkeypatch.setattr(spelling, "maybe_broadcast", lambda df, row_bytes: df)
    rng = random.Random(9)
    n = {"commonbeginning" + "".join(rng.choice("xyz") for _ in range(15)): 1 for _ in range(150)}
    for w in list(n):
        at = rng.randrange(len(w))
        n[w[:at] + rng.choice("xyzq") + w[at + 1 :]] = 30
        n[w[:at] + w[at + 1 :]] = 500
    got = as_tuples(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), pairs=20))
    assert set(got) == variants_by_hand(n)


def test_chain_of_forms(spark):
    n = {f"{'a' * i}{'b' * (12 - i)}": 10**i for i in range(9)}
    got = as_tuples(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert set(got) == variants_by_hand(n) and {r[2] for r in got} == {"a" * 8 + "b" * 4}


def test_awkward_rows(spark, tmp_path):
    long = " ".join(f"VeryLong{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}Word" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "Größere größere ÉCLAIRS éclairs Éclairs a×bcdefg÷h naïveté_naïveté"), (3, "Größere größere ÉCLAIRS éclairs Éclairs a×bcdefg÷h naïveté_naïveté"),
            (None, "nameless nameless namless namess1nameless"), (4, long), (5, "y" * 5000 + " " + "y" * 5000 + " " + "y" * 4999), (6, "日本語wordsafter日本語wordsafter \x00seventh seventh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "form")})
    got = as_tuples(spelling.spelling_variants(spelling.word_counts(docs)))
    n = words_by_hand(rows)
    assert len(got) == len(n) and set(got) == variants_by_hand(n)
    assert spelling.spelling_variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_counts_passed_on_in_parts_add_up(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 1)
    docs = spark.createDataFrame([(i, "wordone wordtwo " * 3) for i in range(40)], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == words_by_hand([(i, "wordone wordtwo " * 3) for i in range(40)])
