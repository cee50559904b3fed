"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed to ``BUCKETS``; its vector
is the mean of their embeddings, so a misspelling that was never seen shares most of its
vector with the word it spells. A document is the mean of its words' vectors, weighted by
the square root of their numbers and drawn to zero by ``PAD`` empty words, under a linear
softmax over clean and toxic. Embeddings and softmax are trained together in numpy
with Adam in batches on a bounded sample of labelled rows: those of smallest seeded hash, up to
``TRAIN_ROWS`` rows and ``TRAIN_CHARS`` characters together, whichever comes first. A word of
fewer than ``MIN_DOCS`` of them adds nothing to the fit, as it would let n-grams learn single
documents by heart; at scoring it has a vector like any other.

The model is linear in the bags, so scoring needs one number per bucket: the embedding
times the difference of the softmax rows. That table of fixed size is what executors get.

Defined cases: null and empty texts have no words and score the model's bias; without
labelled rows, or with one label only, the score is the smoothed share of label 1;
repeated rows score alike.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, packed, whole_text

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
TRAIN_ROWS = 12_000
TRAIN_CHARS = 100_000_000
BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIM = 4
EPOCHS, LEAST_STEPS = 6, 80
BATCH = 500
RATE = 0.1
PENALTY = 3e-4
SCALE = 2000.0
MIN_DOCS = 2
PAD = 20
SEED = 7
#: Words whose n-grams are taken at once, and characters of the texts that are scored at once.
WORDS = 1 << 13
CHARS = 1 << 21

_EDGE = string.punctuation


def words_of(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGE))]


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all ``words`` and the number of each word's buckets.

    Every word is read as ``<word>``: n-grams of 3 to 5 characters, then the word itself.
    """
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    buckets, counts = zip(*(_bags(words[i : i + WORDS]) for i in range(0, len(words), WORDS)))
    return np.concatenate(buckets), np.concatenate(counts)


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    line = "<" + "><".join(words) + ">"
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the end of the word
    owner = np.repeat(np.arange(len(words)), sizes)
    # Each length's hashes extend those of one character less.
    parts, owners = [], []
    base = np.uint64(0x100000001B3)
    power = np.uint64(14695981039346656037)
    rolled = np.full(len(codes), power)
    for n in range(1, max(GRAMS) + 1):
        rolled = (rolled[: len(codes) - n + 1] ^ codes[n - 1 :]) * base
        if n in GRAMS:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            parts.append(rolled[at] + np.uint64(n))
            owners.append(owner[at])
    whole = np.add.reduceat(codes * (base ** (np.arange(len(codes), dtype=np.uint64) - np.repeat(ends - sizes, sizes).astype(np.uint64))), ends - sizes)
    parts.append(whole)
    owners.append(np.arange(len(words)))
    mixed, of = np.concatenate(parts), np.concatenate(owners)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(of, kind="stable")
    return ((mixed >> np.uint64(64 - 18)).astype(np.int32) % BUCKETS)[order], np.bincount(of, minlength=len(words))


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each run of ``counts`` rows; every run has a row at least."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0) / counts.reshape(-1, *[1] * (values.ndim - 1))


def weight(times: np.ndarray) -> np.ndarray:
    """Weight of a word that a text has so many times: junk that repeats one word hardly counts more than once."""
    return np.sqrt(times)


def features(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Bags of the texts' common words: pairs (document, word) with shares, then each word's buckets and their number."""
    ids: dict[str, int] = {}
    doc_of, word_of, times = [], [], []
    for d, text in enumerate(texts):
        found, n = np.unique([ids.setdefault(w, len(ids)) for w in words_of(text)], return_counts=True)
        doc_of.append(np.full(len(found), d))
        word_of.append(found.astype(np.int64))
        n = weight(n)
        times.append(n / (n.sum() + PAD))
    doc, word, share = np.concatenate(doc_of), np.concatenate(word_of), np.concatenate(times)
    # Words of few documents would only let the n-grams learn single documents by heart.
    common = np.bincount(word, minlength=len(ids)) >= MIN_DOCS
    keep, word_id = common[word], np.cumsum(common) - 1
    bucket, count = bags([w for w, i in ids.items() if common[i]])
    return doc[keep], word_id[word[keep]], share[keep], bucket, count


def fit(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Score per bucket and bias, from joint training of embeddings and softmax."""
    y = np.array(labels, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    scores, bias = np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return scores, bias
    read = features(texts)
    if not len(read[-1]):
        return scores, bias
    return descend(y, bias, *read)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of runs that begin at ``first`` and hold ``size`` entries."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def descend(y: np.ndarray, bias: float, doc: np.ndarray, word: np.ndarray, share: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """Adam on cross entropy in batches, with a quadratic penalty, which keeps n-grams of little evidence small."""
    used, bucket = np.unique(bucket, return_inverse=True)
    rng = np.random.default_rng(SEED)
    params = [rng.normal(0, 0.01, (len(used), DIM)), rng.normal(0, 0.3, (DIM, 2)), np.array([0.0, bias])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    truth = np.stack([1 - y, y], 1)
    first, size = np.searchsorted(doc, np.arange(len(y))), np.bincount(doc, minlength=len(y))
    bag = np.cumsum(count) - count
    batches = max(1, round(len(y) / BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps = epochs * batches

    def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)

    step = 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(y)), batches):
            step += 1
            pairs = _spans(first[chosen], size[chosen])
            of, weights = np.repeat(np.arange(len(chosen)), size[chosen]), share[pairs, None] * SCALE
            own, at = np.unique(word[pairs], return_inverse=True)
            n = count[own]
            grams = bucket[_spans(bag[own], n)]
            table, soft, shift = params
            vectors = np.add.reduceat(table[grams], np.cumsum(n) - n, axis=0) / n[:, None] if len(n) else np.zeros((0, DIM))
            means = summed(of, vectors[at] * weights, len(chosen))
            z = means @ soft + shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - truth[chosen]) / len(chosen)
            to_word = summed(at, (error @ soft.T)[of] * weights, len(own)) / n[:, None]
            grads = [summed(grams, np.repeat(to_word, n, axis=0), len(used)) + PENALTY * table, means.T @ error + PENALTY * soft, error.sum(0)]
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for i, g in enumerate(grads):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[i] = params[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    table, soft, shift = params
    scores = np.zeros(BUCKETS, np.float32)
    scores[used] = SCALE * (table @ (soft[:, 1] - soft[:, 0]))
    return scores, float(shift[1] - shift[0])


def score_texts(texts: list[str | None], scores: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text; a word's bag is read once for all texts."""
    ids: dict[str, int] = {}
    per_text = [[ids.setdefault(w, len(ids)) for w in words_of(t)] for t in texts]
    names = list(ids)
    parts = (_bags(names[i : i + WORDS]) for i in range(0, len(names), WORDS))
    word_score = np.concatenate([np.empty(0), *(_means(scores[bucket].astype(np.float64), count) for bucket, count in parts)])
    sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
    words = np.fromiter((i for x in per_text for i in x), np.int64, int(sizes.sum()))
    pairs, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(ids)) + words, return_counts=True)
    text, word = np.divmod(pairs, max(1, len(ids)))
    n = weight(n)
    sums = np.bincount(text, n * word_score[word], len(sizes)) / (np.bincount(text, n, len(sizes)) + PAD)
    return 1 / (1 + np.exp(-np.clip(bias + sums, -500, 500)))


def fold(doc_id: str | Column = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[np.ndarray, float]:
    """Fit on labelled documents outside the held-out fold, in order of a seeded hash of their ids.

    The sample is chosen by ids alone, before any text is read; texts are taken in the same
    order until ``chars`` is reached. Of an id's repeated rows the least text and the larger
    label count. One task fits; the driver gets the finished table.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")).orderBy("h", "doc_id").limit(rows)
    read = docs.select("doc_id", whole_text().alias("text"))
    found = read.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            table = pd.concat(parts).sort_values(["h", "doc_id"])
            size = table["text"].str.len()
            table = table[size.cumsum() - size < chars].sort_values("doc_id")
            scores, bias = fit(table["text"].tolist(), table["toxic"].tolist())
            yield pd.DataFrame({"scores": [scores.tobytes()], "bias": [bias]})

    learnt = found.repartition(1).mapInPandas(learn, "scores binary, bias double").first()
    return (np.frombuffer(learnt["scores"], np.float32), learnt["bias"]) if learnt else fit([], [])


def toxicity(text: Column, model: tuple[np.ndarray, float], spark: SparkSession) -> Column:
    """Score of ``text`` between 0 and 1."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores, bias = sent.value
        for texts in batches:
            # A text counts as some thousand characters at least, so that a share's rows are bounded too.
            share = (texts.str.len() + (CHARS >> 9)).cumsum().to_numpy(np.int64) // CHARS
            parts = np.split(texts.to_numpy(object), np.flatnonzero(np.diff(share)) + 1)
            yield pd.Series(np.concatenate([score_texts(x.tolist(), scores, bias) for x in parts]) if len(texts) else np.empty(0))

    return scored(text)


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold."""
    return packed(docs).where(toxicity(whole_text("row.text"), model, docs.sparkSession) < threshold).select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), toxicity(whole_text(), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
