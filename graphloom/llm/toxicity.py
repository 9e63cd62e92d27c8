"""Toxicity: maximum-scoring segments over token log-odds.

A token's score is the log-odds of its rates in toxic and clean training texts under an
informative Dirichlet prior (Monroe, Colaresi, Quinn 2008), shrunk by its standard error.  A
linear scan (Ruzzo, Tompa 1999) finds every maximal segment of positive total.  With
the scores' Gumbel parameters (Karlin, Altschul 1990), fitted on clean texts, each segment gets a normalised
score; the expected number of chance segments as good, and a logistic curve over it, give
the text's score.  Segments that pass the significance level are reported as passages.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import fold, modest_batches, table, unused, with_text
from .quality import labelled_sample

SAMPLE = 16_000
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
PRIOR, MIN_TOXIC, Z_CUT = 0.1, 5, 3.0
SIGNIFICANT = 1e-2
#: Most tokens that a task counts at a time.
COUNTED = 100_000

#: The bytes of a token: ASCII letters and digits, and whatever isn't ASCII.
SEPARATORS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(SEPARATORS).split()


STEMS = (4, 5, 6, 7)


def with_stems(words) -> set[bytes]:
    """The distinct words, and the beginnings of longer ones (4 to 7 characters, marked with *), so that inflected and compound forms share counts."""
    out = set(words)
    for w in list(out):
        c = w.decode("utf-8", "replace")
        out.update(c[:k].encode() + b"*" for k in STEMS if len(c) > k)
    return out


class Lexicon(dict):
    """Scores of words: the word's own, else its best stem's, else None.  Answers are kept, up to a bound."""

    def __init__(self, scores: dict[bytes, float], bound: int = 300_000):
        self.scores, self.bound = scores, bound

    def __missing__(self, word: bytes):
        s = self.scores.get(word)
        if s is None and len(word) > STEMS[0]:
            c = word.decode("utf-8", "replace")
            s = max((x for x in (self.scores.get(c[:k].encode() + b"*") for k in STEMS if len(c) > k) if x is not None), default=None)
        if len(self) >= self.bound:
            self.clear()
        self[word] = s
        return s


def log_odds(toxic: dict, clean: dict, n_toxic: int, n_clean: int, prior: float = PRIOR) -> dict[bytes, float]:
    """For each token: the lower bound, Z_CUT standard errors in, of its log-odds ratio; only positive ones are kept.

    The prior holds `prior` times as many counts as the corpus, shared out as in the corpus.
    """
    out, whole = {}, n_toxic + n_clean
    held = prior * whole
    for w, a in toxic.items():
        b = clean.get(w, 0)
        p = prior * (a + b)
        d = math.log((a + p) / (n_toxic + held - a - p)) - math.log((b + p) / (n_clean + held - b - p))
        se = math.sqrt(1 / (a + p) + 1 / (b + p))
        if d - Z_CUT * se > 0:
            out[w] = d - Z_CUT * se
    return out


def maximal_segments(places: list[int], scores: list[float], step: float) -> list[tuple[int, int, float]]:
    """Every maximal segment (first token, one past the last, score) of a text whose tokens at `places` score as given and whose others score `step` (below 0)."""
    stack: list[list] = []  # [first, end, left total, right total]
    total, at = 0.0, 0
    for i, s in zip(places, scores):
        total += (i - at) * step
        left, total, at = total, total + s, i + 1
        new = [i, i + 1, left, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append(new)
    return [(a, b, r - l) for a, b, l, r in stack]


@dataclasses.dataclass
class ToxicModel:
    scores: dict[bytes, float]
    step: float
    decay: float  # lambda: chance segments above s fall off as exp(-decay * s)
    start: float  # K
    weight: float
    bias: float

    def __post_init__(self):
        self.lexicon = Lexicon(self.scores)

    def evidence(self, text: bytes) -> tuple[float, list[tuple[int, int, float]], int]:
        """The log of how far the best segments outdo chance, all segments, and the number of tokens."""
        words = tokens(text)
        hits = [(i, s) for i, s in enumerate(map(self.lexicon.__getitem__, words)) if s is not None]
        if not hits:
            return 0.0, [], len(words)
        segments = maximal_segments([i for i, _ in hits], [s for _, s in hits], self.step)
        space = math.log(max(self.start * len(words), 1e-9) + 1)
        # Sum over the significant segments: two passages are more evidence than one.
        total = sum(max(0.0, self.decay * s - space) for _, _, s in segments)
        best = max(self.decay * s for _, _, s in segments) - space
        return math.copysign(math.log1p(abs(total or best)), total or best), segments, len(words)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.weight * evidence + self.bias))))

    def passages(self, text: bytes) -> list[tuple[int, int, float]]:
        """Segments that chance would give less than SIGNIFICANT times in a text of this length."""
        _, segments, n = self.evidence(text)
        return [(a, b, s) for a, b, s in segments if self.start * n * math.exp(-self.decay * s) < SIGNIFICANT]


def _gumbel(scores: dict[bytes, float], step: float, clean: dict, n_clean: int) -> tuple[float, float]:
    """lambda solves sum(p * exp(lambda * s)) = 1 over clean tokens; K is the usual rough value."""
    hit = [(clean.get(w, 0) + 0.5, s) for w, s in scores.items()]
    p = np.array([c for c, _ in hit]) / max(1, n_clean)
    s = np.array([x for _, x in hit])
    rest = max(0.0, 1 - p.sum())
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 600))).sum() + rest * math.exp(mid * step) < 1 else (low, mid)
    return (low + high) / 2, 0.1


def fit_toxicity(toxic: dict, clean: dict, n_toxic: int, n_clean: int, examples: list[tuple[bytes, int]]) -> ToxicModel:
    """Scores from token counts, then a logistic curve on examples (text, label).  Without both labels nothing is toxic."""
    scores = log_odds(toxic, clean, n_toxic, n_clean) if n_toxic and n_clean else {}
    # The drift is set so that clean text drifts down twice as fast as its chance hits lift it.
    lift = sum((clean.get(w, 0) + 0.5) * s for w, s in scores.items()) / max(1, n_clean)
    step = -max(0.01, 2 * lift)
    decay, start = _gumbel(scores, step, clean, n_clean) if scores else (1.0, 0.1)
    model = ToxicModel(scores, step, decay, start, 0.0, -6.0)
    if scores and examples:
        model.weight, model.bias = fit_curve(np.array([model.evidence(t)[0] for t, _ in examples]), np.array([y for _, y in examples], float))
    return model


def token_counts(batches, most: int = COUNTED):
    """Batches (token, toxic, clean) over batches (label, text): in how many texts of each label a token is, and under an empty token the sums.  A count is passed on in parts: one holds `most` tokens and a text's own at most."""

    def part():
        names = list(totals[0].keys() | totals[1].keys())
        sides = [pa.array([sum(t.values()), *[t[w] for w in names]], pa.int64()) for t in (totals[1], totals[0])]
        return pa.RecordBatch.from_arrays([pa.array([b"", *names], pa.binary()), *sides], names=["token", "toxic", "clean"])

    totals = [Counter(), Counter()]
    for b in batches:
        for y, text in zip(b.column(0), b.column(1)):
            totals[y.as_py()].update(with_stems(tokens(text.as_py().encode())))  # a text counts a token once, so that no repetition outweighs other texts
            if len(totals[0]) + len(totals[1]) >= most:
                yield part()
                totals = [Counter(), Counter()]
    yield part()


def train_toxicity(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = SAMPLE) -> ToxicModel:
    """Counts tokens of the sampled texts on the executors; only tokens of MIN_TOXIC toxic texts or more come to the driver.

    The curve is fitted on the sampled texts' evidence, which the executors compute with the scores.
    """

    sample = labelled_sample(documents, labels, "toxic", folds, held_out, bound).select("y", "text")
    counts = sample.mapInArrow(token_counts, "token binary, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = counts.where((F.col("toxic") >= MIN_TOXIC) | (F.octet_length("token") == 0)).toArrow().to_pylist()
    toxic, clean, n_toxic, n_clean = {}, {}, 0, 0
    for r in sorted(rows, key=lambda r: r["token"]):
        if r["token"] == b"":
            n_toxic, n_clean = r["toxic"], r["clean"]
        else:
            toxic[r["token"]], clean[r["token"]] = r["toxic"], r["clean"]
    model = fit_toxicity(toxic, clean, n_toxic, n_clean, [])
    if not model.scores:
        return model

    def weigh(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.evidence(t.as_py().encode())[0] for t in b.column(1)], pa.float64())], names=["y", "x"])

    points = sample.mapInArrow(weigh, "y int, x double").toArrow()  # a row an id: `bound` at most
    x, y = points["x"].to_numpy(), points["y"].to_numpy().astype(float)
    order = np.lexsort((y, x))
    model.weight, model.bias = fit_curve(x[order], y[order])
    return model


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and bias of a logistic curve; (0, -6) if one label is missing."""
    if not 0 < y.sum() < len(y):
        return 0.0, -6.0
    a, b = 1.0, -2.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        q = p * (1 - p)
        g = np.array([((p - y) * x).mean() + 1e-3 * a, (p - y).mean()])
        h = np.array([[(q * x * x).mean() + 1e-3, (q * x).mean()], [(q * x).mean(), q.mean() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - move[0], b - move[1]
    return float(a), float(b)


def score_toxicity(docs: DataFrame, model: ToxicModel, *keep: str, score: str = "score", passages: str = "passages") -> DataFrame:
    """doc_id (and the columns named) with score and the passages' token spans, under the names given.

    A null text scores as an empty one; equal texts score alike; repeated rows and null ids stay as they are; an empty table gives no rows.  Other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    source, at, first = with_text(docs, keep)

    def run(batches):
        for b in batches:
            scores, spans = [], []
            for t in b.column(at):
                x, segments, n = model.evidence((t.as_py() or "").encode())
                scores.append(model.probability(x))
                spans.append([{"start": a, "end": e, "score": s} for a, e, s in segments if model.start * n * math.exp(-model.decay * s) < SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([*b.columns[first:], pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*b.schema.names[first:], score, passages])

    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))
    return source.mapInArrow(run, StructType([*source.schema.fields[first:], StructField(score, DoubleType()), StructField(passages, span)]))


def op2_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are not predicted toxic, unchanged."""
    modest_batches(spark)
    model = train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score, passages = unused(docs, "_score", "_passages")
    return score_toxicity(docs, model, *docs.columns, score=score, passages=passages).where(F.col(score) < CUT).drop(score, passages)
