"""Toxicity: a support vector machine on a gap-tolerant string kernel with Nyström landmarks.

The kernel of two words counts the subsequences of three letters they share, each
weighted by ``DECAY`` to the power of the spans it covers in both, so that letters in
between ("i.d.i.o.t", "idxiot") lower a match and do not undo it; it is normalised by
the words' own kernels.  Landmarks are words of labelled training sentences, those that
set the classes apart and common ones.  With Z the landmarks and K their kernel matrix, a
word becomes the vector ``k(w, Z) K^-1/2``, on which a linear SVM approximates the kernel
machine.  A sentence is as toxic as its worst word, and labels are known for whole
sentences only, so training is multiple-instance: all words of clean sentences are clean
examples, and a toxic document is represented by the words that stand out in it, found
anew in each round.  The document score is a logistic function of its two worst
sentences, fitted on the training documents.

Machine and map are linear, so a word's margin is one number: each worker computes
it once for the distinct words of a batch and remembers it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from loadlens.functions.ordered import running
from loadlens.llm.common import CACHE_ENTRIES, ship, slices, stored

DECAY = 0.6
#: Power of the normalised kernel (again a kernel, of pairs of subsequences), so that close matches count most.
POWER = 2
#: Letters a-z, then classes of other letters; 0 is anything else and only widens gaps.
ALPHABET = 32
#: Longer words are cut into overlapping pieces.
PIECE = 16
#: A sentence longer than this is cut.
SENTENCE_WORDS = 12
#: Landmarks: words that set toxic documents apart, common words, and those named HARD.
MARKED, COMMON = 56, 16
#: Words of clean sentences that the first machine takes for toxic.
HARD = 32
#: Training reads about so many characters of labelled documents of each class.
TRAINING_CHARS = 1_500_000
ROUNDS = 3
#: Words whose kernels are computed together, pieces of long words likewise, and triples held at a time.
TOGETHER, PIECES, TRIPLES = 1 << 15, 1 << 12, 1 << 19

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGES = ".,;:!?\"'()[]{}<>|/%$#&*+-=_~"
_SPACED = re.compile(r"(?<!\S)(?:\w\s){3,}\w(?!\w)")


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence; letters spaced one by one ("i d i o t") are one word."""
    out = []
    for part in _parts(text):
        # What is not a letter at the ends of a word changes no kernel.
        words = [w for w in (x.strip(_EDGES) for x in part) if w]
        # A word counts once in a sentence.
        out.extend(
            list(dict.fromkeys(words[i : i + SENTENCE_WORDS])) for i in range(0, len(words), SENTENCE_WORDS)
        )
    return out


def _parts(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence as they stand, letters spaced one by one joined."""
    lower = (text or "").lower()
    parts = _SENTENCE.split(lower)
    # A sentence has such letters only if the text has.
    if _SPACED.search(lower):
        parts = [_SPACED.sub(lambda m: "".join(m.group().split()), p) for p in parts]
    return [p.split() for p in parts]


def _code(letter: str) -> int:
    if "a" <= letter <= "z":
        return ord(letter) - 96
    return 27 + ord(letter) % 5 if letter.isalpha() else 0


class _Codes(dict):
    def __missing__(self, letter: str) -> int:
        self[letter] = value = _code(letter)
        return value


_codes = _Codes()


@cache
def _triples(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples i < j < k, and the decayed span of each."""
    places = np.array(list(combinations(range(width), 3)), np.int64).reshape(-1, 3)
    return places, (DECAY ** (places[:, 2] - places[:, 0] + 1.0)).astype(np.float32)


def own_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, by the usual recursion, for many words of one length."""
    n, width = codes.shape
    equal = (codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)
    equal = np.ascontiguousarray(equal.transpose(1, 2, 0)).astype(np.float32) * DECAY**2
    prefix = np.ones((width + 1, width + 1, n), np.float32)
    for _ in range(2):
        longer = np.zeros_like(prefix)
        for i in range(width):
            run = np.zeros(n, np.float32)
            for j in range(width):
                run = DECAY * run + equal[i, j] * prefix[i, j]
                longer[i + 1, j + 1] = DECAY * longer[i, j + 1] + run
        prefix = longer
    return (equal * prefix[:width, :width]).sum(axis=(0, 1))


def _letters(words: list[str]) -> np.ndarray:
    """Codes of words of one length, a row for each."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)
    codes = _LATIN[np.minimum(points, 127)]
    other = points > 126
    if other.any():
        found, at = np.unique(points[other], return_inverse=True)
        codes[other] = np.array([_codes[chr(c)] for c in found.tolist()], np.int32)[at]
    return codes


_LATIN = np.array([_code(chr(c)) for c in range(128)], np.int32)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length at a time: their indices, kernels with themselves, triple codes, and weights.

    At most about ``TRIPLES`` triples are held together, whatever the number of words.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for width in np.unique(lengths[lengths >= 3]).tolist():
        every = np.flatnonzero(lengths == width)
        places, weights = _triples(width)
        step = max(1, TRIPLES // len(weights))
        for at in (every[k : k + step] for k in range(0, len(every), step)):
            codes = _letters([words[i] for i in at.tolist()])
            a, b, c = (codes[:, places[:, k]] for k in range(3))
            # Triples with something that is not a letter get the code 0, which no landmark has.
            triple = np.where((a > 0) & (b > 0) & (c > 0), (a * ALPHABET + b) * ALPHABET + c, 0)
            yield at, own_kernel(codes), triple, weights


def pieces(word: str) -> list[str]:
    """A word, or overlapping pieces of a long one."""
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


@dataclass(frozen=True)
class Sparse:
    """A landmark matrix by rows: for each triple the landmarks that have it, and their values."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @classmethod
    def of(cls, matrix: np.ndarray) -> Sparse:
        row, column = np.nonzero(matrix)
        start = np.searchsorted(row, np.arange(len(matrix) + 1))
        return cls(start, column, matrix[row, column], matrix.shape[1])


def kernel_with(words: list[str], landmarks: np.ndarray | Sparse) -> np.ndarray:
    """Kernels of words with landmarks: the normalised subsequence kernel to the power POWER."""
    marks = landmarks if isinstance(landmarks, Sparse) else Sparse.of(landmarks)
    out = np.zeros((len(words), marks.width), np.float32)
    many = np.diff(marks.start)
    for at, own, triple, weights in subsequences(words):
        n = many[triple]
        row, col = np.nonzero(n)
        if len(row):
            code, n = triple[row, col], n[row, col]
            ends = np.cumsum(n)
            entry = np.arange(ends[-1]) + np.repeat(marks.start[code] - (ends - n), n)
            cell = np.repeat(row * marks.width, n) + marks.column[entry]
            shared = np.bincount(cell, np.repeat(weights[col], n) * marks.value[entry], len(at) * marks.width)
            out[at] = shared.reshape(len(at), -1) / np.sqrt(np.maximum(own, 1e-9))[:, None]
    return out**POWER


def landmark_matrix(landmarks: list[str]) -> np.ndarray:
    """Vectors of length one in the space of triples, a column for each landmark."""
    out = np.zeros((ALPHABET**3, len(landmarks)), np.float32)
    for at, own, triple, weights in subsequences(landmarks):
        np.add.at(out, (triple, at[:, None]), weights / np.sqrt(np.maximum(own, 1e-9))[:, None])
    out[0] = 0
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """Landmarks, the kernel machine's weight per landmark and the document calibration."""

    landmarks: tuple[str, ...]
    weights: np.ndarray
    bias: float
    calibration: tuple[float, float, float]


def word_kernels(words: list[str], landmarks: Sparse) -> np.ndarray:
    """Kernels of words of any length with the landmarks; a long word has the largest of its pieces.

    Pieces are taken ``PIECES`` at a time, so a word of any length needs no more memory than its text.
    """
    out = np.zeros((len(words), landmarks.width), np.float32)
    short = [i for i, w in enumerate(words) if len(w) <= PIECE]
    out[short] = kernel_with([words[i] for i in short], landmarks)
    every = ((i, p) for i, w in enumerate(words) if len(w) > PIECE for p in pieces(w))
    while part := list(islice(every, PIECES)):
        owner = np.array([i for i, _ in part])
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        most = np.maximum.reduceat(kernel_with([p for _, p in part], landmarks), first, axis=0)
        out[owner[first]] = np.maximum(out[owner[first]], most)
    return out


class WordScores(dict):
    """A word's share in the margin of its sentence; computed for many words together.

    Words are looked up as they stand; what is left of one without the marks at its ends is scored
    once.  A word of marks only is no word and has minus infinity.
    """

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.landmarks, self.weights = Sparse.of(landmark_matrix(list(model.landmarks))), model.weights
        self.bare: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        if len(self.bare) > CACHE_ENTRIES:
            self.bare.clear()
        self.bare[""] = -np.inf
        fresh = {w: w.strip(_EDGES) for w in words if w not in self}
        new = list(set(fresh.values()).difference(self.bare))
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            self.bare.update(zip(part, (word_kernels(part, self.landmarks) @ self.weights).tolist()))
        self.update((w, self.bare[b]) for w, b in fresh.items())


def worst_two(margins: np.ndarray) -> tuple[float, float]:
    if not len(margins):
        return -3.0, -3.0
    top = np.sort(margins)[-2:]
    return float(top[-1]), float(top[0])


def sentence_margins(texts: list[str | None], known: WordScores, bias: float) -> list[np.ndarray]:
    """Margin of every sentence of each text: the largest share of its words plus the bias.

    Sentences are those of ``sentences``, cut after as many words.
    """
    parts = [_parts(t) for t in texts]
    words = [w for part in parts for each in part for w in each]
    known.learn(set(words))
    values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
    real = values > -np.inf
    lengths = np.fromiter((len(each) for part in parts for each in part), np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
    sentence = np.repeat(np.arange(len(lengths)), lengths)[real]
    if not len(sentence):
        return [np.empty(0)] * len(texts)
    new = np.diff(sentence, prepend=-1) > 0
    begun = np.flatnonzero(new)
    place = np.arange(len(sentence)) - np.repeat(begun, np.diff(np.append(begun, len(sentence))))
    start = np.flatnonzero(place % SENTENCE_WORDS == 0)
    margins = np.maximum.reduceat(values[real], start) + bias
    return np.split(margins, np.searchsorted(owner[sentence[start]], np.arange(1, len(texts))))


def score_texts(texts: list[str | None], model: ToxicityModel, known: WordScores) -> np.ndarray:
    """Score of each text, 0 to 1; a slice of texts at a time."""
    if not model.landmarks:
        return np.zeros(len(texts))
    a, b, c = model.calibration
    tops = [worst_two(m) for start, end in slices(texts) for m in sentence_margins(texts[start:end], known, model.bias)]
    top = np.array(tops).reshape(-1, 2)
    return 1 / (1 + np.exp(-np.clip(top @ np.array([a, b]) + c, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient descent; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y, weight = y.astype(x.dtype), (weight / weight.sum()).astype(x.dtype)
    rate = x.dtype.type(1 / (2 * np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] + penalty))
    w, ahead, t = np.zeros(x1.shape[1], x.dtype), np.zeros(x1.shape[1], x.dtype), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        grad = -2 * x1.T @ (weight * y * slack) + x.dtype.type(penalty) * np.append(ahead[:-1], x.dtype.type(0))
        new, t_new = ahead - rate * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = (new + (t - 1) / t_new * (new - w)).astype(x.dtype), new, t_new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        hess = (x1 * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x1 + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hess, x1.T @ (weight * (p - y)) + 1e-2 * w)
    return w


def _distinct(candidates: Iterator[str], most: int, chosen: list[str]) -> list[str]:
    """Candidates in order, without those much like one already chosen."""
    out: list[str] = []
    for word in candidates:
        have = chosen + out
        if len(out) == most:
            break
        alike = kernel_with([word], landmark_matrix(have))[0] if have else np.zeros(1)
        if alike.max() < 0.6 and next((own[0] for _, own, _, _ in subsequences([word])), 0) > 0:
            out.append(word)
    return out


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()")


def choose_landmarks(toxic: list[list[list[str]]], clean: list[list[list[str]]]) -> tuple[list[str], list[str]]:
    """Words that most set toxic documents apart, and the commonest words of clean documents."""

    def holding(docs):
        every = ({_bare(x) for s in words for x in s} for words in docs)
        return Counter(w for words in every for w in words if 3 <= len(w) <= PIECE)

    bad, good = holding(toxic), holding(clean)

    def apart(word: str) -> float:
        # Log-likelihood ratio of the word's document counts, for words commoner in toxic ones.
        a, b = bad[word] + 0.5, good[word] + 0.5
        both = (a + b) / (len(toxic) + len(clean))
        more = a / len(toxic) > b / len(clean)
        return a * np.log(a / len(toxic) / both) + b * np.log(b / len(clean) / both) if more else 0.0

    marked = _distinct(iter(sorted(bad, key=lambda w: (-apart(w), w))[:2000]), MARKED, [])
    common = sorted(good, key=lambda w: (-good[w], w))[:2000]
    return marked, _distinct(iter(common), COMMON, marked)


def _machine(names: list[str], marked: list[str], toxic: list[set[str]], clean: list[set[str]]) -> tuple[np.ndarray, float]:
    """Weight per landmark and bias.

    A toxic document is represented by words that stand out in it: at first its marked
    words, then its word with the largest margin and all with a clear one; a word
    that clean documents hold, or that fewer than three toxic documents show, is left out.  All
    words of clean documents are clean examples, by the number of documents, and half of their
    weight goes to the words with the largest margin of a clean document.
    """
    matrix = Sparse.of(landmark_matrix(names))
    values, vectors = np.linalg.eigh(kernel_with(names, matrix).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    vocabulary = sorted(set().union(*toxic, *clean))
    place = {w: i for i, w in enumerate(vocabulary)}
    kernels = [word_kernels(vocabulary[i : i + TOGETHER], matrix) for i in range(0, len(vocabulary), TOGETHER)]
    x = np.concatenate(kernels) @ root.astype(np.float32)
    bad, good = ([np.array(sorted(place[w] for w in d)) for d in part] for part in (toxic, clean))
    held = np.bincount(np.concatenate(good), minlength=len(vocabulary))
    shown = Counter(_bare(vocabulary[i]) for own in bad for i in own.tolist())
    able = (held == 0) & np.array([shown[_bare(w)] >= 3 for w in vocabulary])
    sign = set(marked)
    first = np.array([_bare(w) in sign for w in vocabulary])
    found, hard = [own[first[own] & able[own]] for own in bad], held
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(ROUNDS):
        seen = np.bincount(np.concatenate(found), minlength=len(vocabulary))
        if not seen.any():
            break
        risk = 0.25 * held / held.sum() + 0.25 * hard / hard.sum()
        rows = np.flatnonzero(seen + risk)
        y = np.where(seen[rows] > 0, 1.0, -1.0)
        w, bias = _svm(x[rows], y, np.where(y > 0, 0.5 * seen[rows] / seen.sum(), risk[rows]))
        margin = x @ w + bias
        found = [own[able[own] & ((margin[own] >= 0.5) | (margin[own] == margin[own].max()))] for own in bad]
        hard = np.bincount([own[margin[own].argmax()] for own in good], minlength=len(vocabulary))
    return (root @ w).astype(np.float32), bias


def train(toxic: list[str], clean: list[str], prior: float = 0.5, hard: int = HARD) -> ToxicityModel:
    """Fit on labelled texts; without texts of both classes the model scores everything 0.

    ``prior`` is the share of toxic texts that the score is calibrated to.
    """
    texts = [sorted(set(part)) for part in (toxic, clean)]
    docs = [[d for d in map(sentences, part) if d] for part in texts]
    if not docs[0] or not docs[1]:
        return ToxicityModel((), np.zeros(0), 0.0, (0.0, 0.0, -30.0))
    marked, common = choose_landmarks(*docs)
    names = marked + common
    if not names:
        return ToxicityModel((), np.zeros(0), 0.0, (0.0, 0.0, -30.0))
    bad, good = ([{w for s in d for w in s} for d in part] for part in docs)
    weights, bias = _machine(names, marked, bad, good)
    share = WordScores(ToxicityModel(tuple(names), weights, bias, (0, 0, 0)))
    share.learn(set().union(*good))
    suspects = Counter(_bare(max(sorted(d), key=share.get))[:PIECE] for d in good)
    names += _distinct((w for w, _ in sorted(suspects.items(), key=lambda x: (-x[1], x[0]))), hard, names)
    weights, bias = _machine(names, marked, bad, good)
    known = WordScores(ToxicityModel(tuple(names), weights, bias, (0, 0, 0)))
    tops = np.array([worst_two(m) for part in texts for m in sentence_margins(part, known, bias)])
    label = np.repeat([1, 0], [len(part) for part in texts])
    weight = np.where(label == 1, prior / label.mean(), (1 - prior) / (1 - label.mean()))
    a, b, c = _logistic(tops, label, weight)
    return ToxicityModel(tuple(names), weights, bias, (float(a), float(b), float(c)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", label_id: str = "doc_id", chars: int = TRAINING_CHARS) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows given.

    Of each class at most ``chars`` characters of whole texts are read, in the order of a hash of id and
    text, texts of more than a sixteenth of that left out; rows without id, text or label are left out, and repeated texts count once.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    place = F.xxhash64("doc_id", "text").alias("place")
    sizes = named.select("doc_id", place, F.length("text").cast("long").alias("n")).where(F.col("n") <= chars // 16)
    sizes = stored(sizes.join(known, "doc_id").select("toxic", "place", "n"), "labelled")
    counts = {r["toxic"]: (r["rows"], r["n"]) for r in sizes.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    # Far fewer rows than all: those whose place gives about twice the characters.
    share = F.when(F.col("toxic") == 1, 2 * chars / max(1, counts.get(1, (0, 0))[1])).otherwise(2 * chars / max(1, counts.get(0, (0, 0))[1]))
    drawn = sizes.where(F.pmod("place", F.lit(1 << 20)) / float(1 << 20) < share).distinct()
    drawn = running(drawn, ["toxic"], ["place", "n"], sums={"upto": F.col("n")}).where(F.col("upto") <= chars)
    # At most ``chars`` of each class come to the driver.
    chosen = F.broadcast(drawn.select("toxic", "place"))
    rows = named.withColumn("place", place).join(chosen, "place").select("toxic", "place", "text").distinct().collect()
    texts = [[r["text"] for r in sorted(rows, key=lambda r: r["place"]) if r["toxic"] == k] for k in (1, 0)]
    total = sum(n for n, _ in counts.values())
    return train(*texts, counts.get(1, (0, 0))[0] / max(1, total))


def toxicity_of(model: ToxicityModel, text: Column) -> Column:
    """Score of a text column, 0 to 1; NULL and texts without words score as the emptiest text.

    Very long texts are scored whole, and a very long word in pieces of a bounded number at a time.
    """
    shared = ship().sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = shared.value, WordScores(shared.value)
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), model, known))

    return score(text)
