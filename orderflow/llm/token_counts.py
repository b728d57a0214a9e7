"""Word-piece counts by a linear longest-match automaton.

Greedy tokenization takes, from the start of a word, the longest vocabulary
piece that its rest begins with, again and again. The automaton is the trie
of the pieces; where a character has no edge, a failure link leads to the
node that is reached after the pieces which greedy matching pops off there,
and the number of those pieces is stored with the link. One pass over a word
follows edges and links and adds the numbers up, so that the count is known
in linear time and no piece is ever built.

Words are runs of non-white-space, matched with ``▁`` in front. A word that
can't be matched to its end counts as one unknown token.

The vocabulary is read on the driver; the automaton is a fixed size (that of
the vocabulary) and broadcast. Counts of words met before are kept by each
Python worker up to a bound.

Defined cases: null and empty text has no words and no tokens; repeated rows
are counted each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import kept_by_worker

WORD_START = "▁"
#: Words that a Python worker keeps counts of (speed only).
CACHE_WORDS = 700_000
#: Code points take 21 bits; an edge's key is node << 21 | code point.
_BITS = 21


class Automaton:
    """``edges``: node and character to node; ``fail``: the link (-1: none); ``popped``: its number of pieces."""

    def __init__(self, pieces: Iterable[str]):
        edges: dict[int, int] = {}
        final, parent, depth = [False], [0], [0]
        for piece in pieces:
            node = 0
            for c in piece:
                key = node << _BITS | ord(c)
                if key not in edges:
                    edges[key] = len(final)
                    final.append(False)
                    parent.append(node)
                    depth.append(depth[node] + 1)
                node = edges[key]
            if node:
                final[node] = True
        fail, popped = [-1] * len(final), [0] * len(final)
        by_node: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, child in edges.items():
            by_node[key >> _BITS].append((key & ((1 << _BITS) - 1), child))
        queue = deque(by_node[0])
        while queue:
            c, v = queue.popleft()
            queue.extend(by_node[v])
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            at, count = fail[parent[v]], popped[parent[v]]
            while at >= 0 and (to := edges.get(at << _BITS | c)) is None:
                at, count = fail[at], count + popped[at]
            if at >= 0:
                fail[v], popped[v] = to, count
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: str) -> int:
        """The number of greedy pieces; -1 if matching stops before the end."""
        edges, fail, popped, node, total = self.edges, self.fail, self.popped, 0, 0
        for c in word:
            o = ord(c)
            while (to := edges.get(node << _BITS | o)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return total


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.automaton.count(WORD_START + word)
        return n


def _count(broadcast, key: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = kept_by_worker(key, lambda: _Counts(broadcast.value))
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = text.split() if text else []
                counts = np.fromiter(map(kept.__getitem__, words), np.int64, len(words))
                unknown = int((counts < 0).sum())
                out.append((len(words), int(counts.sum()) + 2 * unknown, unknown))
            yield pd.concat([pdf[["doc_id"]].astype("Int64").reset_index(drop=True),
                             pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")], axis=1)

    return run


def token_counts(docs: DataFrame, pieces: Iterable[str], *, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row; unknown words are among the tokens, one each."""
    pieces = list(pieces)
    key = hashlib.md5("\n".join(pieces).encode()).hexdigest()
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(_count(automaton, key), "doc_id long, n_words long, n_tokens long, n_unknown long"))
