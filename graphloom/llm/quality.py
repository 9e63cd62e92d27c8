"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text.  The weights maximise the
Bradley-Terry likelihood that, of a preferred and a rejected document, the preferred
one scores higher: logistic loss on the difference of their features.  A document
is accepted if its score exceeds the quantile of training scores at the share of
rejected labels; scores are given as probabilities that cross 0.5 there.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, modest_batches, table, text_input, unused, with_text

#: Documented bound of the training sample: the labelled rows with the smallest hashes of their ids.
SAMPLE = 12_000
PAIRS = 60_000
FOLDS, HELD_OUT = 3, 1

FEATURES = (
    "bias", "empty", "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "newline", "bang", "hash", "dollar", "percent", "ampersand", "star", "pipe", "comma", "period", "other_symbol",
    "distinct_words", "repeat_next", "top_word", "long_words", "distinct_lines", "repeat_shape", "upper_words", "symbol_words", "short_lines",
)
_WIDTH = len(FEATURES)
_MARKED = re.compile(rb"[!#$%&*|](?=\s)")


def features(text: bytes) -> list[float]:
    """Features of a text's UTF-8 bytes; all of it is read.  An empty text has its own."""
    n = len(text)
    words = text.split()
    if not words:
        return [1.0, 1.0] + [0.0] * (_WIDTH - 2)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    k = len(words)
    named = [int(counts[c]) for c in b"!#$%&*|,."]
    other = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) - sum(named)
    lowered = text.lower().split()
    distinct = set(lowered)
    lines = text.split(b"\n")
    top = lowered.count(max(distinct, key=len)) if len(distinct) < 4 else 0
    again = sum(map(bytes.__eq__, lowered, lowered[1:]))
    marks = len(_MARKED.findall(text)) / k
    upper_words = sum(map(bytes.isupper, words))
    return [
        1.0, 0.0, np.log1p(n) / 10, np.log1p(k) / 8, min(n / k, 40) / 10, counts[65:91].sum() / n, counts[48:58].sum() / n, counts[32] / n, min(1.0, 10 * counts[10] / n),
        *[min(1.0, 10 * c / n) for c in named], min(1.0, 10 * other / n), len(distinct) / k, again / k, top / k, sum(1 for w in distinct if len(w) > 20) / len(distinct),
        len(set(lines)) / len(lines), (k - len(distinct)) / k * min(1.0, k / 200), upper_words / k, marks, sum(1 for x in lines if len(x) < 24) / len(lines),
    ]


def _feature_rows(column: int, keep: list[int]):
    def run(batches):
        for b in batches:
            rows = np.array([features((t.as_py() or "").encode()) for t in b.column(column)], np.float32).reshape(-1, _WIDTH)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.FixedSizeListArray.from_arrays(rows.ravel(), _WIDTH).cast(pa.list_(pa.float32()))], names=[*[b.schema.names[i] for i in keep], "features"])

    return run


@dataclasses.dataclass
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -40, 40)))


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 400, penalty: float = 1e-3, seed: int = 7) -> BradleyTerry:
    """Fits on rows of features with labels 0 or 1.  Without both labels there are no pairs: every score is 0.5 or more, nothing is rejected."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(_WIDTH), np.ones(_WIDTH))
    scale = np.where(scale < 1e-9, 1.0, scale)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(mean, scale, np.zeros(x.shape[1] if x.ndim == 2 else _WIDTH), -1.0, 1.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -6, 6)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, speed = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(rounds):  # Nesterov's method on the convex loss
        at = w + 0.9 * speed
        grad = -(d * (1 / (1 + np.exp(np.clip(d @ at, -40, 40))))[:, None]).mean(0) + penalty * at
        speed = 0.9 * speed - 0.5 * grad
        w = w + speed
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / len(y)))
    slope = 1.0
    for _ in range(50):  # the slope of a logistic curve through the threshold, by Newton's method
        t = np.clip(slope * (s - threshold), -40, 40)
        p = 1 / (1 + np.exp(-t))
        g, h = ((p - y) * (s - threshold)).mean() + 1e-3 * slope, (p * (1 - p) * (s - threshold) ** 2).mean() + 1e-3
        slope = float(np.clip(slope - np.clip(g / h, -1, 1), 0.05, 50))
    return BradleyTerry(mean, scale, w, threshold, slope)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text, y of at most `bound` labelled training rows, chosen by the hash of their ids.  Null ids, labels and texts give no training rows."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # at most `bound` rows of two numbers: safe to broadcast
    # Rows that repeat an id are bounded, too: by a hash of the text, so that the choice doesn't hang on their order.
    rows = text_input(documents).where("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train_quality(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = SAMPLE) -> BradleyTerry:
    sample = labelled_sample(documents, labels, "quality", folds, held_out, bound).select("y", "text", F.xxhash64("doc_id").alias("k"))
    rows = sample.mapInArrow(_feature_rows(1, [0, 2]), "y int, k long, features array<float>").toArrow()  # a row an id: `bound` at most
    order = np.lexsort((rows["y"].to_numpy(), rows["k"].to_numpy()))
    x = np.array(rows["features"].to_pylist(), np.float64).reshape(-1, _WIDTH)[order]
    return fit_bradley_terry(x, rows["y"].to_numpy()[order])


def score_quality(docs: DataFrame, model: BradleyTerry, *keep: str, score: str = "score") -> DataFrame:
    """doc_id (and the columns named) with the score, under the name given.

    A null text scores as an empty one; equal texts score alike; repeated rows and null ids stay as they are; an empty table gives no rows.  Other columns are not read.
    """

    source, at, first = with_text(docs, keep)

    def run(batches):
        for b in batches:
            x = np.array([features((t.as_py() or "").encode()) for t in b.column(at)], np.float32).reshape(-1, _WIDTH)
            yield pa.RecordBatch.from_arrays([*b.columns[first:], pa.array(model.probability(x), pa.float64())], names=[*b.schema.names[first:], score])

    return source.mapInArrow(run, StructType([*source.schema.fields[first:], StructField(score, DoubleType())]))


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose predicted label is 1, unchanged."""
    modest_batches(spark)
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_score")
    return score_quality(docs, model, *docs.columns, score=score).where(F.col(score) >= 0.5).drop(score)
