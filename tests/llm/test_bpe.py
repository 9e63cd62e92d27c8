"""Byte-level BPE against the tiktoken library and on awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=bpe.split_pattern(), mergeable_ranks=bpe.read_ranks(bpe.ranks_path()), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.ranks_path(), bpe.split_pattern(), entries=50)


def test_is_the_library_on_every_kind_of_character(codec, library):
    for first in [*range(0, 0x3100), *range(0x3100, 0x110000, 97)]:
        if not 0xD800 <= first < 0xE000:
            text = f"a {chr(first)}{chr(first)}b1{chr(first)} 2\n"
            assert codec.encode(text).tolist() == library.encode_ordinary(text), hex(first)


@pytest.mark.parametrize("letters", ["ab", "abcde", "etaoin ", "éèa", "aA1. \n\t", "日本語x", "<|endoftext|>"])
def test_is_the_library_on_random_texts(codec, library, letters):
    rng = random.Random(letters)
    for n in (0, 1, 2, 10, 100, 5000):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000 + "x", "ab" * 50_000, "word " * 300_000, "\n" * 70_001])
def test_very_long_matches_and_texts(codec, library, text):
    ids = codec.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert b"".join(codec.decode(ids)) == text.encode()
    assert b"".join(codec.listed(ids)) == ",".join(map(str, ids.tolist())).encode()


def test_merges_where_ranks_do_not_follow_the_merges():
    """Brute force over small made-up ranks: a whole match with a rank stays whole, a new pair may rank below the last one."""
    rng = random.Random(5)
    for _ in range(300):
        tokens = {bytes([c]) for c in b"abc"} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(12)}
        ranks = {t: i for i, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}
        merger = bpe.Merger(ranks)
        for _ in range(10):
            match = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
            parts = [match] if match in ranks else [bytes([c]) for c in match]
            while True:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert merger.ids(match) == [ranks[p] for p in parts]
            assert not any(merger.buckets) and not any(merger.low) and not any(merger.mid)


def test_query(spark, library):
    got = {r["doc_id"]: r for r in bpe.op12_byte_bpe(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        text, r = d["text"] or "", got[d["doc_id"]]
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (4, "x" * 100_000), (5, "\x00 é\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(7)).withColumn("match", F.lit("m"))
    encoded = bpe.encode_documents(docs)
    back = sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in bpe.decode_documents(encoded).collect())
    assert back == sorted((i or -1, (t or "").encode()) for i, t in rows)
    digests = bpe.round_trip_digests(encoded).collect()
    assert sorted(r["n_tokens"] for r in digests)[:2] == [0, 0] and len(digests) == len(rows)
    assert bpe.round_trip_digests(bpe.encode_documents(docs.limit(0))).count() == 0


def test_unknown_ids_and_ranks_without_bytes_raise(codec, tmp_path):
    with pytest.raises(KeyError):
        list(codec.decode(np.array([60_000], np.int32)))
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.Codec(str(tmp_path / "few"), bpe.split_pattern())
