"""Whitening against numpy and on awkward rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import whitening
from graphloom.llm.common import table

SF = "/root/testdata/sf0.01"


def by_numpy(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(axis=0)
    apart = (x * n - s) / n
    e, v = np.linalg.eigh(apart.T @ apart / n)
    return x, n, s, apart, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def test_query_is_numpy(spark):
    got = whitening.op13_embedding_whitening(spark, SF).collect()
    rows = table(spark, SF, "embeddings").collect()
    x, n, s, apart, e, v, total = by_numpy([r["embedding"] for r in rows], 32)
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    w = np.zeros((n, 32))
    for r in got:
        i = place[r["vec_id"]]
        w[i, r["component"] - 1] = r["whitened"]
        assert r["deviation"] == sum(int(d) ** 2 for d in x[i] * n - s)
        assert math.isclose(r["explained"], e[r["component"] - 1] / total, rel_tol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9
    want = apart @ v / np.sqrt(e)
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-6


def test_awkward_rows(spark):
    rows = [(1, [0.5, 1.0], "a"), (2, None, "a"), (3, [None, 1.0], "a"), (4, [float("nan"), 1.0], "b"), (5, [float("inf"), 0.0], "b"), (6, [], "b"),
            (7, [1.0, 2.0, 3.0], "c"), (8, [-0.25, 0.1], "c"), (8, [-0.25, 0.1], "c"), (None, [0.0, -1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").withColumn("n", F.lit(0)).repartition(3)
    kept = whitening.whole_numbers(df)
    assert sorted(r["vec_id"] or 0 for r in kept.collect()) == [0, 1, 8, 8]
    fitted = whitening.fit(kept)
    x, n, s, apart, e, v, total = by_numpy([[0.5, 1.0], [-0.25, 0.1], [-0.25, 0.1], [0.0, -1.0]], 2)
    assert fitted.n == 4 and fitted.sums.tolist() == s.tolist()
    assert np.allclose(fitted.eigenvalues, e) and math.isclose(fitted.total, total) and np.allclose(np.abs(fitted.components), np.abs(v))
    out = whitening.whiten(kept, fitted)
    assert out.count() == 4 and whitening.identity_error(out, 2) < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]]])
def test_nothing_to_whiten(spark, tmp_path, vectors):
    spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op13_embedding_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_rank_deficient(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    kept = whitening.whole_numbers(df)
    fitted = whitening.fit(kept)
    assert len(fitted.eigenvalues) == 1 and math.isclose(fitted.eigenvalues[0], fitted.total)
    assert whitening.identity_error(whitening.whiten(kept, fitted), 1) < 1e-9


def test_large_counts_stay_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**6), 10**6, (5, 3)) + 10**9
    n, s = 10**10, x.sum(axis=0) * 10**9
    exact = [sum((Fraction(int(c)) * n - int(t)) ** 2 for c, t in zip(r, s)) for r in x]
    assert whitening.deviations(x, n, s) == exact


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whole_numbers(df)
