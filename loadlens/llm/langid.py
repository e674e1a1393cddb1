"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are not letters becomes one
space, and all n-grams of 1 to ``orders`` characters are hashed into ``buckets``
counters per order.  Training counts n-grams per language in every task and adds
the counters up with one small shuffle; the matrix of log-probabilities has
``orders * buckets`` rows and one column per language, and is broadcast.  Scoring
is a sum of matrix rows per text, done in numpy for a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from loadlens.llm.common import ship, slices, spare, stored

UNDETERMINED = "und"
#: The broadcast matrix may have so many cells (4 bytes each).
MATRIX_CELLS = 64 << 20

#: Characters of a text that are taken together.
PART = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.array([32], np.uint64)


@dataclass(frozen=True)
class Grams:
    """How texts become counters."""

    orders: int = 3
    buckets_log2: int = 16

    @property
    def width(self) -> int:
        return self.orders << self.buckets_log2


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities (n-gram bucket, language) and log-priors of the languages."""

    grams: Grams
    languages: tuple[str, ...]
    priors: np.ndarray
    logs: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _code_points(text: str) -> Iterator[np.ndarray]:
    """Lower-cased letters with one space before, between and after runs of them, in parts of ``PART`` characters."""
    lower, begun, inside = text.lower(), False, False
    for at in range(0, len(lower), PART):
        points = np.frombuffer(lower[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letters()[points]
        # A space stands for the first of several other characters after a letter.
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        keep[0] |= inside
        inside = bool(letters[-1])
        found = np.where(letters, points, np.uint32(32))[keep].astype(np.uint64)
        if len(found):
            yield found if begun else np.concatenate((_SPACE, found))
            begun = True
    if inside:
        yield _SPACE


def gram_parts(text: str, grams: Grams) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of a text, part by part; order n has buckets of its own.

    A part begins with the last characters of the one before, so the grams of a text are the same
    in one part or in many.
    """
    shift, tail = np.uint64(64 - grams.buckets_log2), np.empty(0, np.uint64)
    for fresh in _code_points(text):
        points = np.concatenate((tail, fresh))
        found, code = [], points
        for n in range(1, grams.orders + 1):
            if len(points) < n:
                break
            code = points if n == 1 else code[:-1] * np.uint64(0x110000) + points[n - 1 :]
            # Those that end in the tail have been given out.
            mixed = (code[max(0, len(tail) - n + 1) :] + np.uint64(n)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MIX
            found.append(((mixed >> shift) + np.uint64((n - 1) << grams.buckets_log2)).astype(np.int64))
        tail = points[len(points) - min(len(points), grams.orders - 1) :]
        yield np.concatenate(found)


def hashed_grams(text: str, grams: Grams) -> np.ndarray:
    """Bucket of every n-gram of a text."""
    return np.concatenate([np.empty(0, np.int64), *gram_parts(text, grams)])


def gram_counts(docs: DataFrame, text: str, lang: str, grams: Grams) -> DataFrame:
    """Counts per (lang, bucket) over all rows; bucket -1 counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                documents[name] = documents.get(name, 0) + 1
                if name not in totals:
                    totals[name] = np.zeros(grams.width, np.int64)
                for found in gram_parts(body, grams):
                    totals[name] += np.bincount(found, minlength=grams.width)
        for name, counted in totals.items():
            used = np.flatnonzero(counted)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [name] * (len(used) + 1),
                    "bucket": np.append(used, -1),
                    "n": np.append(counted[used], documents[name]),
                }
            )

    ship()
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counted = known.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", grams: Grams = Grams(), smoothing: float = 0.5) -> LanguageModel:
    """Train on all rows that have a text and a language.

    Rows with NULL in either column are left out; texts without letters count for
    the prior only; repeated rows count each time.  An empty table gives a model
    without languages.  The matrix is collected: its size is languages times
    ``grams.width`` cells, at most ``MATRIX_CELLS``.  With more languages than fit, take fewer
    buckets (``Grams(buckets_log2=13)`` has room for 2,730); it is an error otherwise, as no language is left out.
    """
    found = stored(gram_counts(docs, text, lang, grams), "grams")
    most = MATRIX_CELLS // grams.width
    languages = sorted(r[0] for r in found.select("lang").distinct().limit(most + 1).collect())
    if len(languages) * grams.width > MATRIX_CELLS:
        raise ValueError(f"too many languages for a broadcast matrix of {MATRIX_CELLS} cells")
    counts = np.zeros((grams.width, len(languages)), np.float64)
    documents = np.zeros(len(languages), np.float64)
    if languages:
        place = {name: i for i, name in enumerate(languages)}
        rows = found.toPandas()
        column = rows["lang"].map(place).to_numpy(np.int64)
        bucket, n = rows["bucket"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
        counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
        documents[column[bucket < 0]] = n[bucket < 0]
    # Each order is a distribution of its own.
    logs = np.empty_like(counts, np.float32)
    for k in range(grams.orders):
        part = slice(k << grams.buckets_log2, (k + 1) << grams.buckets_log2)
        smooth = counts[part] + smoothing
        logs[part] = np.log(smooth / smooth.sum(axis=0))
    priors = np.log((documents + 1) / (documents.sum() + max(1, len(languages))))
    return LanguageModel(grams, tuple(languages), priors, logs)


def log_scores(text: str, model: LanguageModel) -> np.ndarray | None:
    """Log-prior plus log-likelihood per language; None for a text without letters."""
    total, seen = model.priors.copy(), False
    for found in gram_parts(text, model.grams):
        if len(found):
            seen = True
            bucket, n = np.unique(found, return_counts=True) if len(found) > 4096 else (found, None)
            rows = model.logs[bucket]
            total += rows.sum(axis=0, dtype=np.float64) if n is None else n @ rows.astype(np.float64)
    return total if seen else None


def language_of(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score): the likeliest language and its posterior probability.

    ``und`` with score 0 for NULL, texts without a letter, and a model without
    languages.  Equal scores go to the language that comes first by code point.
    """
    shared = ship().sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            texts = batch.tolist()
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for start, end in slices(texts):
                for i in range(start, end):
                    total = log_scores(texts[i], known) if texts[i] and known.languages else None
                    if total is not None:
                        best = int(total.argmax())
                        names[i] = known.languages[best]
                        scores[i] = 1.0 / np.exp(total - total[best]).sum()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and, last, a struct ``_language`` (lang_pred, score); its name is longer if ``docs`` has it."""
    return docs.withColumn(spare(docs, "_language"), language_of(model, F.col(text)))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows whose language the model tells with a posterior of at least ``least``.

    Rejected: NULL texts, texts without a letter, and texts that no language
    explains clearly better than the others.  The columns stay as they are, whatever they are called; texts of any length are
    scored whole, repeated rows alike, and an empty table stays empty.
    """
    found = identify(docs, model, text)
    name = found.columns[-1]
    sure = (F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= least)
    return found.where(sure).drop(name)
