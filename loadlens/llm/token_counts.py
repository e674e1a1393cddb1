"""Token counts of a unigram tokenizer, with a trie shared by all pre-tokens.

A text is split into pre-tokens; a pre-token's token count is that of its best
segmentation, the one with the largest sum of piece scores.  The forward score of a
position depends on the characters before it only, so pre-tokens with a common prefix
share its scores: the distinct pre-tokens of a batch are inserted in a trie whose nodes
keep the best score and the number of pieces that reach it, and a node is computed once.
The counts of whole pre-tokens are remembered.  A trie that has grown beyond
``MOST_NODES`` is dropped and begun anew, which bounds memory and changes no result.

Nothing is shuffled: each task counts its own texts.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Mapping
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from loadlens.llm.common import CACHE_ENTRIES, ship, slices

MOST_NODES = 400_000


def zipf_scores(path: str) -> dict[str, float]:
    """Log-probabilities of a vocabulary file (base64 piece and rank per line) by Zipf's law.

    Pieces are byte strings, kept as Latin-1 text; a piece of rank r has a probability
    in proportion to 1 / (r + 1).
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class Trie:
    """Forward scores of all prefixes of the inserted pre-tokens."""

    def __init__(self, scores: Mapping[str, float]):
        #: Scores of all ends of pieces, -inf for those that are no piece: a text that is not in here ends no piece.
        self.ends = {piece[k:]: -math.inf for piece in scores for k in range(1, len(piece))}
        self.ends.update(scores)
        self.clear()

    def clear(self) -> None:
        #: Node of (parent, character); the root is node 0.
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0.0], [0]

    def count(self, word: str) -> int:
        """Number of pieces of the best segmentation; of equally good ones the shortest.

        Every single byte has to be a piece, so that each word can be segmented.
        """
        child, best, pieces, end = self.child, self.best, self.pieces, self.ends.get
        path = [0]
        for i, letter in enumerate(word):
            key = (path[-1], letter)
            node = child.get(key)
            if node is None:
                top, fewest = -math.inf, 0
                for start in range(i, -1, -1):
                    score = end(word[start : i + 1])
                    if score is None:  # what is longer ends no piece either
                        break
                    before = path[start]
                    score += best[before]
                    if score > top or (score == top and pieces[before] + 1 < fewest):
                        top, fewest = score, pieces[before] + 1
                node = child[key] = len(best)
                best.append(top)
                pieces.append(fewest)
            path.append(node)
        return pieces[path[-1]]


class Counter:
    """Token counts of texts; remembers those of pre-tokens."""

    def __init__(self, scores: Mapping[str, float], pattern: str):
        self.trie, self.known = Trie(scores), {}
        self.split = regex.compile(pattern).findall

    def learn(self, words: set[str]) -> None:
        # In order, so that words of a common prefix come one after the other.
        for word in sorted(words.difference(self.known)):
            if len(self.trie.best) > MOST_NODES:
                self.trie.clear()
            self.known[word] = self.trie.count(word.encode("utf-8", "replace").decode("latin-1"))

    def count(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        for start, end in slices(texts):
            parts = [self.split(t) if t else [] for t in texts[start:end]]
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            self.learn(set(chain.from_iterable(parts)))
            for part in parts:
                yield len(part), sum(map(self.known.__getitem__, part))


def token_count(text: Column, vocabulary: str, pattern: str) -> Column:
    """struct(n_pretokens, n_tokens) of a text column; NULL and empty texts have none.

    ``vocabulary`` is the path of a vocabulary file, read once on the driver and broadcast
    (a fixed size), ``pattern`` the regular expression of pre-tokens.
    """
    shared = ship().sparkContext.broadcast(zipf_scores(vocabulary))

    @pandas_udf("n_pretokens long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value, pattern)
        for texts in batches:
            yield pd.DataFrame(list(counter.count(texts.tolist())), columns=["n_pretokens", "n_tokens"])

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``_tokens`` (n_pretokens, n_tokens).

    Repeated rows and missing ids make no difference; an empty table gives no rows.
    """
    return docs.withColumn("_tokens", token_count(F.col(text), vocabulary, pattern))
