"""Log-bilinear language model with noise-contrastive estimation.

P(word | context) = P(class | context) * P(word | class, context).  The commonest words are classes of
their own; the next few thousand are dealt over groups, each a class; every other word, known or
not, belongs to a class named by its shape (a hash of its last letters), so an unknown word has a class too.

Both factors are log-bilinear (Mnih, Hinton 2007) but for shapes: a context vector, the sum of those of the words at the
two places before and of the mean over the WINDOW tokens before, is multiplied with the vectors of all classes, and
then with those of the words of the class.  Training is noise-contrastive (Gutmann, Hyvarinen 2010; Mnih, Teh 2012) in numpy, against class
frequencies and, in a group, against its words' frequencies.  Scoring takes batched matrix products over all classes and over all words of a group, so
its probabilities are normalised.  In a class of a shape, P(word | class) is the word's discounted count; the mass discounted is the
probability of the class's one unknown word.

Every training text takes part, once.  Texts are dealt over buckets of about BUCKET tokens by a hash of their ids and contents and sorted by it;
a model is trained on each bucket and the models are averaged by tokens, so the fit doesn't depend on how the table is stored or read.

Word counts cover all training texts and never leave the cluster whole: the commonest words (a bounded
table) are looked up where texts are read; the others are summed by text and joined to the counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, stored, table, text_input

FOLDS, HELD_OUT = 7, 2
#: Classes of single words (the end of a text is one), groups, words with vectors of their own in all, classes by shape, and the size of vectors.
TOP, GROUPS, WORDS, SHAPES, DIM, ORDER, WINDOW = 40, 40, 2000, 48, 16, 2, 64
CLASSES, PLACES = TOP + GROUPS + SHAPES, WORDS + SHAPES
#: Words looked up in memory by each task, by count; all others are joined.
HEAD = 120_000
#: Every training text trains the vectors, in one pass; tokens of a bucket.
NOISE, EPOCHS, BATCH, RATE, INSIDE, BUCKET = 6, 1, 4096, 0.3, 2, 4_000_000
#: AdaGrad's sums before any step.
FLAT = 1e-5
DISCOUNT = 0.6
END = b""
#: Tokens of a product over all classes, and of one over the words of groups.
CHUNK, RUN = 512, 32_768


def tokens(text: bytes) -> list[bytes]:
    """The words of a text and its end."""
    w = text.lower().split()
    w.append(END)
    return w


def shape(word: bytes) -> int:
    """A hash of a word's last four bytes, which names the class of a word without a vector of its own."""
    return zlib.crc32(word[-4:]) % SHAPES


class Ids(dict):
    """Words to ids: their rank, or -1 - shape for words beyond the head, kept up to a bound."""

    def __missing__(self, word):
        i = -1 - shape(word)
        if len(self) < 350_000:
            self[word] = i
        return i


def class_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The class and the place in the context tables of each id; the last SHAPES entries serve the negative ids."""
    ids = np.arange(len(words))
    shapes = np.array([shape(w) for w in words] + list(range(SHAPES))[::-1], np.int64)  # id -1 - k stands at the end's k-th from behind
    classes, places = TOP + GROUPS + shapes, WORDS + shapes
    own = ids < WORDS
    places[: len(ids)][own] = ids[own]
    classes[: len(ids)][own] = np.where(ids[own] < TOP, ids[own], TOP + ids[own] % GROUPS)
    return classes.astype(np.int32), places.astype(np.int32)


#: Parameters by name: of classes, of grouped words, of contexts by place before, of the window's mean, and the two biases.
SHAPE_OF = {"target": (CLASSES, DIM), "word": (WORDS, DIM), "place": (ORDER * PLACES, DIM), "mean": (CLASSES, DIM), "bias": (CLASSES,), "word_bias": (WORDS,)}


def split(params: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, dims in SHAPE_OF.items():
        out[name] = params[at : at + math.prod(dims)].reshape(dims)
        at += math.prod(dims)
    return out


def initial(class_noise: np.ndarray, word_noise: np.ndarray, seed: int = 3) -> np.ndarray:
    """All parameters as one vector: small random vectors, and the logarithms of the frequencies as biases."""
    rng = np.random.default_rng(seed)
    out = rng.normal(0, 0.1, sum(math.prod(d) for d in SHAPE_OF.values())).astype(np.float32)
    p = split(out)
    p["bias"][:] = np.log(np.maximum(class_noise, 1e-30))
    p["word_bias"][:] = np.log(np.maximum(word_noise, 1e-30))
    return out


def group_noise(counts: np.ndarray) -> np.ndarray:
    """The share of each word of the groups in its group, given the counts of words 0 to WORDS - 1; 0 for words there aren't."""
    out = np.zeros(WORDS)
    n = np.zeros(WORDS)
    n[: len(counts)] = counts[:WORDS]
    n[:TOP] = 0
    for g in range(GROUPS):
        own = slice(g, None, GROUPS)
        if n[own].sum():
            out[own] = n[own] / n[own].sum()
    return out


def hidden(p: dict, classes: np.ndarray, places: np.ndarray, starts: np.ndarray, a: int, b: int) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """The context vectors of tokens a to b of texts laid end to end, and what they are made of: the places before, the window's start and its share.

    Before a text's start stands its end (id 0).
    """
    at = np.arange(a, b)
    before = [np.where(at - i >= starts[a:b], places[np.maximum(at - i, 0)], 0) + (i - 1) * PLACES for i in range(1, ORDER + 1)]
    first = np.maximum(starts[a:b], at - WINDOW)
    lo = int(first[0]) if len(first) else a
    run = np.zeros((b - lo + 1, DIM), np.float32)
    np.cumsum(p["mean"].take(classes[lo:b], axis=0), axis=0, out=run[1:])
    share = (1 / (at - first + 8)).astype(np.float32)
    h = run[a - lo : b - lo] - run.take(first - lo, axis=0)
    h *= share[:, None]
    for i in before:
        h += p["place"].take(i, axis=0)
    return h, before, first, share


def log_probabilities(params: np.ndarray, ids: np.ndarray, classes: np.ndarray, places: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The normalised natural log-probability of each token's class and, in a group, of its word there."""
    p = split(params)
    there = group_noise(counts) > 0
    out = np.empty(len(classes), np.float64)
    for start in range(0, len(classes), RUN):
        end = min(len(classes), start + RUN)
        hs, *_ = hidden(p, classes, places, starts, start, end)
        run = classes[start:end]
        for a in range(0, end - start, CHUNK):
            h, own = hs[a : a + CHUNK], run[a : a + CHUNK]
            s = h @ p["target"].T
            s += p["bias"]
            logs = s[np.arange(len(s)), own].astype(np.float64)
            np.minimum(s, 80, out=s)
            np.exp(s, out=s)
            out[start + a : start + a + len(own)] = logs - np.log(s.sum(1))
        grouped = np.flatnonzero((run >= TOP) & (run < TOP + GROUPS))
        if len(grouped):
            # The words of a group stand GROUPS apart, so a group's products are one batch.
            order = grouped[np.argsort(run[grouped].astype(np.int16), kind="stable")]
            cuts = np.flatnonzero(np.r_[True, run[order][1:] != run[order][:-1], True])
            for x, y in zip(cuts, cuts[1:]):
                rows, g = order[x:y], int(run[order[x]]) - TOP
                t = hs[rows] @ p["word"][g::GROUPS].T + p["word_bias"][g::GROUPS]
                t = np.where(there[g::GROUPS], np.minimum(t, 80), -np.inf)
                out[start + rows] += t[np.arange(len(rows)), ids[start + rows] // GROUPS] - np.log(np.exp(t).sum(1))
    return out


def _squash(d: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(d, -30, 30, out=d)
    np.negative(d, out=d)
    np.exp(d, out=d)
    d += 1
    return np.reciprocal(d, out=d)


class Trainer:
    """Noise-contrastive estimation by minibatches of neighbouring tokens with AdaGrad steps."""

    def __init__(self, params: np.ndarray, class_noise: np.ndarray, word_noise: np.ndarray, rate: float = RATE, seed: int = 11):
        self.params, self.rate, self.rng, self.seen = params.astype(np.float32), rate, np.random.default_rng(seed), 0
        self.p, self.total = split(self.params), {k: np.full(d, FLAT, np.float32) for k, d in SHAPE_OF.items()}
        self.class_noise, self.cum = np.log(np.maximum(NOISE * class_noise, 1e-30)).astype(np.float32), np.cumsum(class_noise)
        self.word_noise = np.log(np.maximum(INSIDE * word_noise, 1e-30)).astype(np.float32)
        # Of each group, its words' cumulated shares, shifted by the group's number: one search draws from any group.
        self.within = np.concatenate([np.minimum(np.cumsum(word_noise[g::GROUPS]), 1 - 1e-9) + g for g in range(GROUPS)])
        self.per = WORDS // GROUPS

    def step(self, name: str, at: np.ndarray, rows: np.ndarray) -> None:
        """An AdaGrad step along gradients by row, repeated rows summed."""
        n = len(self.p[name])
        if rows.ndim == 1:
            grad = np.bincount(at, rows, n).astype(np.float32)
        else:
            grad = np.empty(self.p[name].shape, np.float32)
            for i, column in enumerate(np.ascontiguousarray(rows.T)):
                grad[:, i] = np.bincount(at, column, n)
        self.move(name, grad)

    def move(self, name: str, grad: np.ndarray) -> None:
        self.total[name] += grad * grad
        grad *= np.float32(self.rate)
        grad /= np.sqrt(self.total[name])
        self.p[name] -= grad

    def fit(self, ids: np.ndarray, classes: np.ndarray, places: np.ndarray, starts: np.ndarray, epochs: int = EPOCHS) -> None:
        n = len(classes)
        size = max(128, min(BATCH, n // 64))  # short runs make steps enough, too
        for _ in range(epochs):
            for a in self.rng.permutation(np.arange(0, n, size)):
                self.batch(ids, classes, places, starts, int(a), int(min(n, a + size)))
        self.seen += n

    def batch(self, ids, classes, places, starts, a: int, b: int) -> None:
        p, scale = self.p, np.float32(1 / (b - a))
        h, before, first, share = hidden(p, classes, places, starts, a, b)
        own = classes[a:b]
        other = np.searchsorted(self.cum, self.rng.random(NOISE * 8) * self.cum[-1]).clip(0, CLASSES - 1)  # shared by the batch
        k = np.float32(len(other) / NOISE)
        target, target_other = p["target"].take(own, axis=0), p["target"].take(other, axis=0)
        g_own = (_squash(np.einsum("ij,ij->i", h, target) + p["bias"][own] - self.class_noise[own]) - 1) * scale
        g_other = h @ target_other.T
        g_other += p["bias"][other] - self.class_noise[other]
        g_other = _squash(g_other)
        g_other *= scale / k
        gh = g_own[:, None] * target + g_other @ target_other
        steps = [("target", np.concatenate([own, other]), np.concatenate([g_own[:, None] * h, g_other.T @ h])), ("bias", np.concatenate([own, other]), np.concatenate([g_own, g_other.sum(0)]))]
        grouped = np.flatnonzero((own >= TOP) & (own < TOP + GROUPS))
        if len(grouped):
            g, hg = own[grouped] - TOP, h[grouped]
            drawn = np.searchsorted(self.within, self.rng.random((len(g), INSIDE)) + g[:, None]).clip((g * self.per)[:, None], (g * self.per + self.per - 1)[:, None])
            words = np.concatenate([ids[a:b][grouped][:, None], (drawn - (g * self.per)[:, None]) * GROUPS + g[:, None]], axis=1)
            vectors = p["word"].take(words, axis=0)
            d = np.einsum("ij,ikj->ik", hg, vectors) + p["word_bias"][words] - self.word_noise[words]
            e = _squash(d)
            e[:, 0] -= 1
            e *= scale
            gh[grouped] += np.einsum("ik,ikj->ij", e, vectors)
            steps += [("word", words.ravel(), (e[:, :, None] * hg[:, None, :]).reshape(-1, DIM)), ("word_bias", words.ravel(), e.ravel())]
        columns = np.ascontiguousarray(gh.T)  # the same rows for each place before, whose contexts are tables of their own
        self.move("place", np.concatenate([np.stack([np.bincount(at - i * PLACES, c, PLACES) for c in columns], 1) for i, at in enumerate(before)]).astype(np.float32))
        # The mean's gradient: each token takes back from all of its window.
        lo = int(first[0])
        spread = gh * share[:, None]
        back = np.zeros((b - lo + 1, DIM), np.float32)
        begins = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        sums = np.cumsum(spread, axis=0, dtype=np.float64)[np.r_[begins[1:] - 1, -1]]
        back[first[begins] - lo] += np.diff(sums, axis=0, prepend=0)
        back[a - lo : b - lo] -= spread
        steps.append(("mean", classes[lo:b], np.cumsum(back, axis=0)[:-1]))
        for s in steps:
            self.step(*s)


def _laid_out(texts: list[bytes], ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ids of texts laid end to end, where each token's text begins, the texts' sizes, and their words."""
    words = [tokens(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    starts = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)
    return flat, starts, sizes, words


def training(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """The texts that the model is made from: all that are not held out."""
    return text_input(docs).where(fold("doc_id", folds) != held_out)


def word_counts(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """word (bytes; the end is empty), c: counts over all training texts, summed by task before the shuffle."""

    def run(batches):
        total: Counter = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return b

        for b in batches:
            for t in b.column(1):
                total.update(tokens((t.as_py() or "").encode()))
            if len(total) > 400_000:
                yield out()
        yield out()

    return training(docs, folds, held_out).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _groups(batches, limit: int = 2_000_000):
    """Lists of (key, text bytes) of bounded total size, from a column of keys and one of texts."""
    rows, size = [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1)):
            raw = (t.as_py() or "").encode()
            rows.append((d, raw))
            size += len(raw)
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _by_bucket(batches):
    """(bucket, groups) of batches sorted by bucket; groups never cross buckets."""
    rows, size, bucket = [], 0, None
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1)):
            if rows and (k != bucket or size >= 2_000_000):
                yield bucket, rows
                rows, size = [], 0
            raw = (t.as_py() or "").encode()
            bucket, size = k, size + len(raw)
            rows.append(raw)
    if rows:
        yield bucket, rows


def train_vectors(texts: DataFrame, tokens_: int, head: list[bytes], class_noise: np.ndarray, word_noise: np.ndarray) -> np.ndarray:
    """The parameters, from all rows of texts (doc_id, text): one model a bucket, averaged by the tokens each has seen.

    `tokens_` sets the number of buckets.  Without texts the parameters are the initial ones, which are the frequencies.
    """
    class_of, place_of = class_table(head)
    start, known = initial(class_noise, word_noise), {w: i for i, w in enumerate(head)}
    buckets = max(1, -(-tokens_ // BUCKET))

    def fit(batches):
        ids, own, last = Ids(known), None, None

        def out(t):
            x = np.append(t.params.astype(np.float64) * t.seen, float(t.seen))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)), pa.int32()), pa.array(x, pa.float64())], names=["i", "x"])

        for bucket, group in _by_bucket(batches):
            if bucket != last:
                if own:
                    yield out(own)
                own, last = Trainer(start, class_noise, word_noise, seed=11 + bucket), bucket
            flat, starts, _, _ = _laid_out(group, ids)
            own.fit(flat, class_of[flat], place_of[flat], starts)
        if own:
            yield out(own)

    key = F.xxhash64("doc_id", "text")
    dealt = texts.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), "text", F.xxhash64(key, F.lit(1)).alias("k"))
    dealt = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "k", "text").select("bucket", "text")
    learned = sorted(dealt.mapInArrow(fit, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect())  # as many rows as parameters
    return (np.array([x for _, x in learned[:-1]]) / learned[-1][1]).astype(np.float32) if learned else start


def score_texts(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts are empty: the end alone.  Repeated rows keep their own results.  Without training texts N is 0: every word is unknown.
    An empty table gives no rows; other columns are not read.
    """
    counts = stored(word_counts(docs, folds, held_out))
    known, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    rows = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow().to_pylist()  # bounded by HEAD
    rows = [(r["word"], r["c"]) for r in sorted(rows, key=lambda r: (r["word"] != END, -r["c"], r["word"]))]
    if not rows or rows[0][0] != END:
        rows.insert(0, (END, 0))
    head, head_counts = [bytes(w) for w, _ in rows], np.array([c for _, c in rows], np.float64)
    class_of, place_of = class_table(head)
    own_vectors = set(head[:WORDS])

    # Tokens and types of each shape's class, over all counts.
    def shapes(batches):
        tokens_, types = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w not in own_vectors:
                    tokens_[shape(w)] += c
                    types[shape(w)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES), pa.int32()), pa.array(tokens_), pa.array(types)], names=["k", "n", "v"])

    n_of, v_of = np.zeros(SHAPES), np.zeros(SHAPES)
    for k, n, v in counts.select("word", "c").mapInArrow(shapes, "k int, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():  # a row a shape
        n_of[k], v_of[k] = n, v
    # Classes without words have no probability; shapes always have their unknown word.
    class_noise = np.bincount(class_of[: min(WORDS, len(head))], head_counts[:WORDS] + 1, minlength=CLASSES)
    class_noise[TOP + GROUPS :] = n_of + 1
    class_noise /= class_noise.sum()
    word_noise = group_noise(head_counts + 1)
    params = train_vectors(training(docs, folds, held_out), total, head, class_noise, word_noise)

    denominator = math.log10(total + known + 1)
    inside = np.log10(np.maximum(n_of, 1))
    # log10 P(unknown | class): the mass discounted, or all of it where the class has no counts.
    unknown = np.where(n_of > 0, np.log10(np.maximum(DISCOUNT * v_of, 1e-9) / np.maximum(n_of, 1)), 0.0)
    pad = np.zeros(SHAPES)
    base_of = np.concatenate([np.log10(head_counts + 1) - denominator, pad])
    beyond = np.arange(len(head)) >= WORDS
    inside_of = np.concatenate([np.where(beyond, np.log10(np.maximum(head_counts - DISCOUNT, 1e-9)) - inside[np.maximum(class_of[: len(head)] - TOP - GROUPS, 0)], 0.0), pad])
    all_ids, seen = {w: i for i, w in enumerate(head)}, np.concatenate([head_counts > 0, pad > 0])

    def score(batches):
        ids, serial = Ids(all_ids), 0
        for group in _groups(batches):
            flat, starts, sizes, words = _laid_out([t for _, t in group], ids)
            places = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            logs = log_probabilities(params, flat, class_of[flat], place_of[flat], starts, head_counts + 1) / math.log(10) + inside_of[flat]
            sums, base, hits = (np.add.reduceat(x, places) for x in (logs, base_of[flat], seen[flat].astype(np.int64)))
            rest: list[Counter] = [Counter() for _ in words]
            beyond_head = np.flatnonzero(flat < 0)
            texts = np.searchsorted(places + sizes, beyond_head, side="right")
            for d, i in zip(texts.tolist(), (beyond_head - places[texts]).tolist()):
                rest[d][words[d][i]] += 1
            columns = ([d for d, _ in group], list(range(serial, serial + len(group))), sizes, hits, base, sums, [list(r) for r in rest], [list(r.values()) for r in rest])
            serial += len(group)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(columns, kinds)], names=["doc_id", "serial", "n_tokens", "n_head", "base", "model", "words", "times"])

    first = text_input(docs).mapInArrow(score, "doc_id long, serial long, n_tokens long, n_head long, base double, model double, words array<binary>, times array<long>")
    first = stored(first.withColumn("row", F.spark_partition_id().cast("long") * (1 << 33) + F.col("serial")).drop("serial"))
    # The rest of each text's words meet their counts; a word of the rest may be unknown.
    rest = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    joined = rest.join(counts, "word", "left")
    k = F.pmod(F.crc32(F.expr("substring(word, -4, 4)")), F.lit(SHAPES))
    logs = lambda a: F.element_at(F.array(*[F.lit(float(x)) for x in a]), (k + 1).cast("int"))
    c = F.col("c")
    base = F.col("n") * (F.log10(F.coalesce(c, F.lit(0)) + 1) - F.lit(denominator))
    own = F.col("n") * F.when(c.isNull(), logs(unknown)).otherwise(F.log10(c - F.lit(DISCOUNT)) - logs(inside))
    tail = joined.groupBy("row").agg(F.sum(base).alias("tail_base"), F.sum(own).alias("tail_model"), F.sum(F.when(c.isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"))
    out = first.drop("words", "times").join(tail, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("tail_model", F.lit(0.0))).alias("score"),
    )


def op5_log_bilinear_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
