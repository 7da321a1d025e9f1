"""Language identification by string kernels: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the mean over n = 1, 2, 3 of the cosine of their sets of character n-grams. Landmarks and ridge rows are a
bounded sample per language. Prediction is (presence x landmark presence) x ridge coefficients; that product is associative, so the
right part is multiplied once after the fit and a batch of texts is scored by one matrix product per n.

Defined results: a null text or one without a letter is ``und`` with score 0, also when nothing was learned. Rows with a null language,
text or id are not learned from; with one language only, all texts with letters get it. Texts are read whole; repeated rows get equal
results. A column of the input that has the name of a result column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored, with_computed

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
#: hash bins of each order
BINS = 1 << 16
#: most rows of one language that are learned from, and most landmarks of one language
ROWS_PER_LANGUAGE = 500
LANDMARKS_PER_LANGUAGE = 48
#: most rows that are learned from in all
SAMPLE_ROWS = 4000
RIDGE = 1e-2
#: texts scored in one matrix product
BATCH = 128
_OTHER = re.compile(r"[\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: bins that a landmark has, and for each of them and each language the folded coefficient
    bins: np.ndarray
    coefficients: np.ndarray


class Presence:
    """The set of n-gram bins of a text, through one scratch array that is cleared after each text."""

    def __init__(self) -> None:
        self.flags = np.zeros(len(ORDERS) * BINS, dtype=bool)

    def of(self, text: str | None) -> np.ndarray | None:
        """Sorted bins of all orders, or None for a text without letters."""
        plain = f" {_OTHER.sub(' ', (text or '').lower()).strip()} "
        if not any(map(str.isalpha, plain)):
            return None
        letters = np.frombuffer(plain.encode("utf-32-le", "replace"), dtype=np.uint32)
        mixed = np.zeros(len(letters), dtype=np.uint32)
        for k, n in enumerate(ORDERS):
            mixed = mixed[:len(letters) - n + 1] * np.uint32(31) + letters[n - 1:] * _MULTIPLIERS[k]
            self.flags[(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)) + np.uint32(k * BINS)] = True
        bins = np.flatnonzero(self.flags)
        self.flags[bins] = False
        return bins.astype(np.uint32)


def _sizes(bins: np.ndarray) -> np.ndarray:
    """The number of bins of each order."""
    return np.diff(np.searchsorted(bins, np.arange(len(ORDERS) + 1) * BINS))


def _kernel_rows(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Presence over ``columns``, each order scaled by the size of the text's own set, so that a product of two is the kernel."""
    place = np.full(len(ORDERS) * BINS, len(columns), dtype=np.int64)
    place[columns] = np.arange(len(columns))
    out = np.zeros((len(sets), len(columns) + 1), dtype=np.float32)
    for row, bins in zip(out, sets):
        scale = 1 / np.sqrt(np.maximum(_sizes(bins), 1) * len(ORDERS))
        row[place[bins]] = scale[bins // BINS]
    return out[:, :-1]


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[np.ndarray, str]]:
    """About ``per_language`` rows of each language outside the held-out fold, chosen by the hash of their id; ``rows`` at most.

    Where the languages are so many that this exceeds ``rows``, each has an equal part of ``rows``. What chance draws above the bound is
    cut from all languages alike, and the row with the smallest hash of each language always stays.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    unit = (F.xxhash64("doc_id") / F.lit(2.0**64)) + 0.5
    counts = known.groupBy("lang").agg(F.count("*").alias("_rows"), F.min(unit).alias("_least"))
    counts = stored(counts.orderBy("lang").limit(rows))  # one row per language, and no more languages than rows to learn from
    bound = min(per_language, rows / max(counts.count(), 1))
    chosen = known.join(F.broadcast(counts), "lang").withColumn("_order", F.when(unit == F.col("_least"), 0.0).otherwise(unit * F.col("_rows")))
    chosen = chosen.filter(F.col("_order") < bound).orderBy("_order", "doc_id", "lang", "text").limit(rows)

    @F.pandas_udf("binary")
    def bins(texts: pd.Series) -> pd.Series:
        presence = Presence()
        found = [presence.of(t) for t in texts]
        return pd.Series([None if b is None else b.tobytes() for b in found], dtype=object)

    taken = chosen.select("lang", bins("text").alias("x")).collect()
    return [(np.frombuffer(r["x"], np.uint32), r["lang"]) for r in taken if r["x"] is not None]


def fit(sample: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> LanguageModel:
    languages = sorted({lang for _, lang in sample})
    taken: dict[str, int] = dict.fromkeys(languages, 0)
    chosen = []
    for bins, lang in sample:
        if taken[lang] < landmarks:
            taken[lang] += 1
            chosen.append(bins)
    if not sample:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    columns = np.unique(np.concatenate(chosen)).astype(np.int64)
    marks = _kernel_rows(chosen, columns).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    sound = values > 1e-8 * values.max()
    whiten = vectors[:, sound] / np.sqrt(values[sound])
    mapped = np.concatenate([_kernel_rows([b for b, _ in sample[i:i + BATCH]], columns) @ (marks.T @ whiten)
                             for i in range(0, len(sample), BATCH)])
    wanted = np.where(np.array([lang for _, lang in sample])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = np.array([1 / sum(1 for _, other in sample if other == lang) for lang in languages])
    weight = balance[[languages.index(lang) for _, lang in sample]][:, None]
    weight = weight * len(sample) / weight.sum()
    normal = mapped.T @ (mapped * weight) + ridge * len(sample) * np.eye(mapped.shape[1]) / 100
    ridge_rows = np.linalg.solve(normal, mapped.T @ (wanted * weight))
    return LanguageModel(languages, columns, (marks.T @ (whiten @ ridge_rows)).astype(np.float32))


def with_predictions(docs: DataFrame, model: LanguageModel, prediction: str = "lang_pred", score: str = "score", keep: list[str] | None = None,
                     sharpness: float = 4.0, unlearned: str | None = UNDETERMINED) -> DataFrame:
    """``docs`` with the predicted language and its score, the softmax of the one-versus-rest values.

    ``unlearned`` is the prediction for texts with letters when the model has no language.
    """
    def make():
        presence = Presence()

        def compute(part):
            names, scores = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
            sets = [presence.of(text) for text in part.column("text").to_pylist()]
            rows = [i for i, bins in enumerate(sets) if bins is not None]
            if not model.languages:
                for i in rows:
                    names[i] = unlearned
            elif rows:
                values = _kernel_rows([sets[i] for i in rows], model.bins) @ model.coefficients
                shares = np.exp(sharpness * (values - values.max(axis=1, keepdims=True)))
                scores[rows] = shares.max(axis=1) / shares.sum(axis=1)
                for i, best in zip(rows, values.argmax(axis=1)):
                    names[i] = model.languages[best]
            return {prediction: names, score: scores}

        return compute

    return with_computed(docs, f"`{prediction}` string, `{score}` double", make, rows=BATCH, keep=keep)


def identified_documents(docs: DataFrame, rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns in ``keep``, with lang_pred and score."""
    return with_predictions(docs, fit(labelled_sample(docs, rows)), keep=keep)
