"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed single words, word pairs and pairs with one word between. Learning rates are kept per coordinate,
and the L1 term leaves most weights at exactly zero, so the model is a short list of buckets and weights that goes to every task.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the smallest hash of the id among the
labelled documents); everything else covers all rows. Defined results: a null, empty or wordless text gets the base rate; without any labelled row the score is 0.25 for
all; rows with a null label or id are not learned from; repeated rows get equal scores. Texts are read whole. A column of the input
that has the name of a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, with_computed

#: most labelled rows that are learned from
SAMPLE_ROWS = 16_000
#: a bucket is learned if it occurs in at least so many of them
LEAST_ROWS = 3
#: hash buckets, as a power of two; so many that a clean document seldom meets the bucket of a toxic word
BUCKET_BITS = 32
#: the first bits of a bucket, by which most of a document's buckets are dismissed before the weights are searched
PREFIX_BITS = 20
WORD = re.compile(r"[^\W\d_]+")
#: hashes of words kept in each Python worker
CACHE_ENTRIES = 100_000
_word_hashes: dict[str, int] = {}


@dataclass(frozen=True)
class FtrlParameters:
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 8
    seed: int = 7


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


def _hashes(words: list[str]) -> np.ndarray:
    known = _word_hashes
    new = {w: xxhash.xxh64_intdigest(w.encode()) for w in set(words) if w not in known}
    if len(known) + len(new) > CACHE_ENTRIES:
        known = {w: known[w] for w in set(words) if w in known} | new
    else:
        known.update(new)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def features(text: str | None) -> np.ndarray:
    """The distinct hash buckets of a text: words, neighbouring words, words with one between."""
    h = _hashes(WORD.findall((text or "").lower()))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    skips = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(0x27D4EB2F165667C5)
    mixed = np.concatenate([h, pairs, skips])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, as packed buckets x and label toxic, in the order of the hash of their id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # ids without a document must not use up the rows
    chosen = known.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id", "toxic").limit(rows)

    @F.pandas_udf("binary")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts], dtype=object)

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_order", "doc_id", "toxic", buckets("text").alias("x"))
    return found.orderBy("_order", "doc_id", "toxic", "x").limit(rows).select("x", "toxic")


def trained(sample: DataFrame) -> ToxicityModel:
    """The model, fitted in one task over the bounded sample; only the weights come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x.as_buffer(), np.uint32), y) for b in batches for x, y in zip(b.column("x"), b.column("toxic").to_pylist())]
        model = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.buckets.tobytes()]), pa.array([model.weights.tobytes()])],
                                         ["bias", "buckets", "weights"])

    found = sample.mapInArrow(run, "bias double, buckets binary, weights binary").collect()
    if not found:
        return fit([])
    return ToxicityModel(found[0]["bias"], np.frombuffer(found[0]["buckets"], np.uint32), np.frombuffer(found[0]["weights"], np.float32))


def _frequent(sample: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The sorted buckets that occur in LEAST_ROWS rows or more; a first count by 26 bits keeps the sort small."""
    coarse = np.zeros(1 << 26, dtype=np.uint8)
    for x, _ in sample:
        at = x >> np.uint32(BUCKET_BITS - 26)
        coarse[at] = np.minimum(coarse[at], LEAST_ROWS) + 1
    found = []
    for start in range(0, 1 << BUCKET_BITS, 1 << BUCKET_BITS - 4):  # the buckets of a row ascend, so a sixteenth of all is a slice of each row
        edges = np.array([start, start + (1 << BUCKET_BITS - 4) - 1], dtype=np.uint32)
        parts = []
        for x, _ in sample:
            part = x[np.searchsorted(x, edges[0]):np.searchsorted(x, edges[1], "right")]
            parts.append(part[coarse[part >> np.uint32(BUCKET_BITS - 26)] >= LEAST_ROWS])
        buckets = np.concatenate(parts)
        del parts
        buckets.sort()
        first = np.flatnonzero(np.diff(buckets, prepend=~buckets[:1]))
        found.append(buckets[first[np.diff(first, append=len(buckets)) >= LEAST_ROWS]])
    return np.concatenate(found)


def fit(sample: list[tuple[np.ndarray, int]], p: FtrlParameters = FtrlParameters()) -> ToxicityModel:
    """Online FTRL-proximal over the sample, which is used up; the intercept starts at the base rate and is not regularised."""
    positive = sum(y for _, y in sample)
    rate = (positive + 0.5) / (len(sample) + 2.0)
    start = float(np.log(rate / (1 - rate)))
    if positive in (0, len(sample)):
        return ToxicityModel(start)
    buckets = _frequent(sample)
    rows = []
    while sample:  # a row is given back as soon as its positions are known
        x, y = sample.pop()
        at = np.searchsorted(buckets, x)
        rows.append((at[_member(buckets, x, at)].astype(np.int32), y))
    rows.reverse()
    z, n = np.zeros(len(buckets)), np.zeros(len(buckets))
    bias, bias_n = start, 1.0

    def weights(at):
        small = np.abs(z[at]) <= p.l1
        w = -(z[at] - np.sign(z[at]) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        return np.where(small, 0.0, w)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / p.alpha
            z[x] += g - sigma * w
            n[x] += g * g
            bias_n += g * g
            bias -= p.alpha * g / np.sqrt(bias_n)
    w = weights(slice(None))
    kept = np.flatnonzero(w)
    return ToxicityModel(bias, buckets[kept], w[kept].astype(np.float32))


def _member(buckets: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return buckets[np.minimum(at, len(buckets) - 1)] == x if len(buckets) else np.zeros(len(x), dtype=bool)


class Scorer:
    """Sums the weights of a document's buckets."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.prefixes = np.zeros(1 << PREFIX_BITS, dtype=bool)
        self.prefixes[model.buckets >> np.uint32(BUCKET_BITS - PREFIX_BITS)] = True

    def __call__(self, text: str | None) -> float:
        x = features(text)
        x = x[self.prefixes[x >> np.uint32(BUCKET_BITS - PREFIX_BITS)]]
        at = np.searchsorted(self.model.buckets, x)
        logit = self.model.bias + float(self.model.weights[at[_member(self.model.buckets, x, at)]].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def with_scores(docs: DataFrame, model: ToxicityModel, score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``keep``, with the probability of label 1, from the whole text alone."""
    def make():
        scorer = Scorer(model)
        return lambda part: {score: [float(scorer(text)) for text in part.column("text").to_pylist()]}

    return with_computed(docs, f"`{score}` double", make, keep=keep)


def scored_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``keep``, with score and predicted (1 from a score of 0.5 on)."""
    model = trained(labelled_sample(docs, labels, rows))
    return with_scores(docs, model, keep=keep).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
