"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language label; the label sequence is scored by
per-word features (character bigrams and trigrams of the word with its
boundaries, affixes of three letters, and the word itself as lexicon entry,
all hashed) and by learned transitions between the labels of neighbouring
words, so that code-switched texts are labelled piece by piece. Word
probabilities come from forward-backward over the whole text. A document's
language is the label with the largest share of word probability, its score
that share.

Training reads a bounded sample (``docs_per_label`` documents of each
language, least by hash, ``sequences_per_doc`` runs of ``sequence_words``
words evenly spread over each) and adds sequences switched between documents
of different languages; words take their document's language as label. The
weights are fitted on the driver on that sample; prediction is spread over
all partitions.

A long text is a chain like any other: blocks of ``BLOCK`` words are reduced
to transfer matrices, messages pass from block to block, and all blocks are
then finished side by side, which is exact.

Defined cases: null text or a text without a letter gets ``und`` and score 0;
without any labelled row every text does; ties go to the first label in
order; repeated rows are predicted each; extra columns are ignored by ``fit``
and kept by ``predict``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import broadcast_if_small, held_out, kept_by_worker, learnable, materialise

UNKNOWN = "und"
#: Bounds of the training sample.
DOCS_PER_LABEL, SEQUENCES_PER_DOC, SEQUENCE_WORDS = 200, 12, 30
#: Hashed features (rows of weights; one more row is always zero).
FEATURES = 1 << 18
ITERATIONS, RATE, RIDGE = 25, 0.2, 1e-5
#: Words of a text that make one block, words that a task labels at a time, words kept per Python worker (speed only).
BLOCK, WORDS_AT_ONCE, CACHE_WORDS = 32, 150_000, 300_000
#: Rows of the sample's list (label and hash) up to which it is broadcast.
SMALL_ROWS = 100_000

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES + 1, labels)
    transitions: np.ndarray  # (labels, labels), from row to column

    def key(self) -> str:
        return hashlib.md5(self.weights.tobytes() + self.transitions.tobytes()).hexdigest()


def learnable_rows(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return learnable(F.col(id_col), 4, 2)


def held_out_rows(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; not those with a null doc_id."""
    return held_out(F.col(id_col), 4, 2)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; none if the text has no letter."""
    words = _WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words, one after another, and where each word's begin."""
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    flat = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32) \
        .astype(np.uint64)
    at = np.arange(len(flat))
    left = np.repeat(ends, lengths) - at  # characters from here to the word's end, this one included
    mix = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]

    def row(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * mix[3]
        return ((h ^ (h >> np.uint64(29))) * mix[0] >> np.uint64(46)).astype(np.int64)  # 18 bits

    padded = np.concatenate([flat, np.zeros(3, np.uint64)])
    gram = padded[:-3] * mix[0] ^ padded[1:-2] * mix[1]
    two = np.where(left >= 2, row(gram, 1), FEATURES)
    gram = gram ^ padded[2:-1] * mix[2]
    three = np.where(left >= 3, row(gram, 2), FEATURES)
    gram = gram ^ padded[3:] * mix[3]
    # with four characters, the first is the word's start or the last its end
    edge = (left >= 4) & ((left == np.repeat(lengths, lengths)) | (left == 4))
    four = np.where(edge, row(gram, 3), FEATURES)
    lexicon = np.full(len(flat), FEATURES)
    lexicon[ends - lengths] = row(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64), 4)
    return np.stack([two, three, four, lexicon], axis=1).ravel(), (ends - lengths) * 4


def potentials(weights: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[rows], starts, axis=0)


# ---- training


def _sequences(per_doc: int, words: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                found = words_of(text)
                count = min(per_doc, -(-len(found) // words))
                for k in range(count):
                    at = (len(found) * k // count) if count * words < len(found) else k * words
                    out.append((label, found[at:at + words]))
            yield pd.DataFrame(out, columns=["label", "words"])

    return run


def fit(docs: DataFrame, *, docs_per_label: int = DOCS_PER_LABEL, sequences_per_doc: int = SEQUENCES_PER_DOC,
        sequence_words: int = SEQUENCE_WORDS, iterations: int = ITERATIONS, text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Learn from the non-null texts and languages of ``docs``."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()) \
        .select(F.col(lang_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # the hashes are ranked without the texts; of equal texts one is read
    least = Window.partitionBy("label").orderBy("h")
    chosen = materialise(rows.select("label", "h").distinct().withColumn("k", F.row_number().over(least))
                         .where(F.col("k") <= docs_per_label).select("label", "h"), "language-sample")
    sample = (rows.join(broadcast_if_small(chosen, SMALL_ROWS), ["label", "h"])
              .groupBy("label", "h").agg(F.first("text").alias("text")).select("label", "text")
              .mapInPandas(_sequences(sequences_per_doc, sequence_words), "label string, words array<string>")
              .toPandas())
    sample = sample.sort_values(["label", "words"], key=lambda c: c.map(str)).reset_index(drop=True)
    return fit_sequences(list(sample["label"]), [list(w) for w in sample["words"]], iterations, sequence_words)


def fit_sequences(names: list[str], texts: list[list[str]], iterations: int = ITERATIONS,
                  length: int = SEQUENCE_WORDS) -> Model:
    labels = sorted(set(names))
    n = len(labels)
    if not labels:
        return Model([], np.zeros((FEATURES + 1, 0), np.float32), np.zeros((0, 0), np.float32))
    own = [labels.index(x) for x in names]
    # switched sequences: pieces of two sequences of any language, in turn
    rng = np.random.default_rng(0)
    sequences = [(w, [y] * len(w)) for y, w in zip(own, texts, strict=True)]
    for i, j in zip(rng.permutation(len(texts))[:len(texts) // 2], rng.permutation(len(texts))[:len(texts) // 2]):
        a, b = int(rng.integers(3, 15)), int(rng.integers(3, 15))
        pieces = [(texts[i][:a], own[i]), (texts[j][:b], own[j]), (texts[i][a:2 * a], own[i])]
        sequences.append(([w for p, _ in pieces for w in p][:length], [y for p, y in pieces for _ in p][:length]))
    words = sorted({w for ws, _ in sequences for w in ws})
    place = {w: k for k, w in enumerate(words)}
    ids, ys = (np.full((len(sequences), length), -1) for _ in range(2))
    for k, (ws, y) in enumerate(sequences):
        ids[k, :len(ws)], ys[k, :len(ws)] = [place[w] for w in ws], y
    order = np.argsort(-(ids >= 0).sum(1), kind="stable")
    ids, ys = ids[order], ys[order]
    rows, starts = features(words)
    used, rows = np.unique(rows, return_inverse=True)  # only these rows get weights
    owner = np.repeat(np.arange(len(words)), np.diff(np.r_[starts, len(rows)]))
    zero = np.flatnonzero(used == FEATURES)
    mask = ids >= 0
    total = mask.sum()
    params = [np.zeros((len(used), n)), np.zeros((n, n))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    seen = np.zeros((n, n))
    np.add.at(seen, (ys[:, :-1][mask[:, 1:]], ys[:, 1:][mask[:, 1:]]), 1)
    truth = np.zeros((len(words), n))
    np.add.at(truth, (ids[mask], ys[mask]), 1)
    for step in range(1, iterations + 1):
        scores = potentials(params[0], rows, starts)
        e = np.exp(scores - scores.max(1, keepdims=True))[ids]
        a = np.exp(params[1])
        alpha = np.ones_like(e)
        beta = np.ones_like(e)
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        active = mask.sum(0)  # sequences are in order of length
        for t in range(1, length):
            x = (alpha[:active[t], t - 1] @ a) * e[:active[t], t]
            alpha[:active[t], t] = x / x.sum(1, keepdims=True)
        expected = np.zeros((n, n))
        for t in range(length - 1, 0, -1):
            k = active[t]
            y = e[:k, t] * beta[:k, t]
            pair = alpha[:k, t - 1, :, None] * a * y[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            x = y @ a.T
            beta[:k, t - 1] = x / x.sum(1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        counts = np.stack([np.bincount(ids[mask], gamma[..., c][mask], len(words)) for c in range(n)], axis=1)
        by_word = (truth - counts) / total
        by_row = np.stack([np.bincount(rows, by_word[owner, c], len(used)) for c in range(n)], axis=1)
        by_row[zero] = 0
        for p, g, m in zip(params, [by_row - RIDGE * params[0], (seen - expected) / total], moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += RATE * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros((FEATURES + 1, n), np.float32)
    weights[used] = params[0]
    weights[FEATURES] = 0
    return Model(labels, weights, params[1].astype(np.float32))


# ---- prediction


class _Words(dict):
    """Numbers of words, given at first sight; ``new`` holds those without potentials yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class Labeller:
    """Word probabilities of texts under a model; keeps the potentials of words seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.a = np.exp(model.transitions.astype(np.float64))
        # the message before the first word: after a transition it weighs all labels alike
        self.begin = np.linalg.lstsq(self.a.T, np.ones(len(model.labels)), rcond=None)[0]
        self._reset()

    def _reset(self) -> None:
        self.ids, self.table = _Words(), np.zeros((0, len(self.model.labels)), np.float32)

    def _potentials(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > CACHE_WORDS:
            self._reset()
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if new := self.ids.new:
            known = len(self.ids) - len(new)
            if len(self.ids) > len(self.table):
                more = np.zeros((max(len(self.ids), 2 * len(self.table)), self.table.shape[1]), np.float32)
                more[:known] = self.table[:known]
                self.table = more
            for lo in range(0, len(new), 20_000):
                part = new[lo:lo + 20_000]
                x = potentials(self.model.weights, *features(part))
                self.table[known + lo:known + lo + len(part)] = np.exp(x - x.max(1, keepdims=True))
            self.ids.new = []
        return self.table[at]

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        """(all words, labels): forward-backward over each text's words; no text is empty."""
        n = len(self.model.labels)
        sizes = np.array([len(t) for t in texts])
        e = self._potentials([w for t in texts for w in t])
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        # words sit in blocks of their text; the places after its last word change nothing
        word = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = np.repeat(first * BLOCK, sizes) + word
        grid = np.ones((int(blocks.sum()) * BLOCK, n))
        grid[cell] = e
        grid = grid.reshape(-1, BLOCK, n)
        used = np.zeros(len(grid) * BLOCK, bool)
        used[cell] = True
        used = used.reshape(-1, BLOCK)
        a = self.a
        transfer = np.broadcast_to(np.eye(n), (len(grid), n, n)).copy()
        for t in range(BLOCK):
            moved = (transfer @ a) * grid[:, t, None, :]
            moved /= moved.max((1, 2), keepdims=True)
            transfer = np.where(used[:, t, None, None], moved, transfer)
        # messages between the blocks of each text, texts with many blocks first
        order = np.argsort(-blocks, kind="stable")
        ahead, back = np.empty((len(grid), n)), np.empty((len(grid), n))
        message = np.tile(self.begin, (len(texts), 1))
        for j in range(int(blocks.max())):
            rows = order[:int(np.searchsorted(-blocks[order], -j, "left"))]
            at = first[rows] + j
            ahead[at] = message[rows]
            x = np.einsum("ki,kij->kj", message[rows], transfer[at])
            message[rows] = x / x.sum(1, keepdims=True)
        message = np.ones((len(texts), n))
        for j in range(int(blocks.max()) - 1, -1, -1):
            rows = order[:int(np.searchsorted(-blocks[order], -j, "left"))]
            at = first[rows] + j
            back[at] = message[rows]
            x = np.einsum("kij,kj->ki", transfer[at], message[rows])
            message[rows] = x / np.abs(x).max(1, keepdims=True)
        # all blocks side by side
        forward = np.empty_like(grid)
        x = ahead
        for t in range(BLOCK):
            moved = (x @ a) * grid[:, t]
            moved /= moved.sum(1, keepdims=True)
            x = np.where(used[:, t, None], moved, x)
            forward[:, t] = x
        y = back
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= y
            moved = (grid[:, t] * y) @ a.T
            moved /= moved.max(1, keepdims=True)
            y = np.where(used[:, t, None], moved, y)
        p = forward.reshape(-1, n)[cell]
        return p / p.sum(1, keepdims=True)


def _portions(texts: list[list[str]]) -> Iterator[list[int]]:
    """Numbers of the texts with words, so many at a time as hold WORDS_AT_ONCE words."""
    now, size = [], 0
    for k, words in enumerate(texts):
        if words:
            now.append(k)
            size += len(words)
            if size >= WORDS_AT_ONCE:
                yield now
                now, size = [], 0
    if now:
        yield now


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    text_at, key = own.index(text_col), model.key()
    # columns travel under numbers, so that clashing names can't meet
    sent = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(own)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in sent.schema.fields])
    schema = schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker = kept_by_worker(key, lambda: Labeller(model))
        for batch in batches:
            texts = batch.column(text_at)
            languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            step = 500
            for lo in range(0, len(texts) if model.labels else 0, step):
                found = [words_of(t) if t else [] for t in texts.slice(lo, step).to_pylist()]
                for portion in _portions(found):
                    p = worker.probabilities([found[k] for k in portion])
                    sizes = np.array([len(found[k]) for k in portion])
                    share = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                    for k, row in zip(portion, share, strict=True):
                        best = int(row.argmax())
                        languages[lo + k], scores[lo + k] = model.labels[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores)],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    found = sent.mapInArrow(run, schema)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], "lang_pred", "score")


def label_words(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, labels): the most probable language of every word of a text."""
    key = model.key()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = kept_by_worker(key, lambda: Labeller(model))
        for pdf in batches:
            found = [words_of(t) if t else [] for t in pdf["text"]]
            labels: list[list[str]] = [[] for _ in found]
            for portion in _portions(found) if model.labels else ():
                best = worker.probabilities([found[k] for k in portion]).argmax(1)
                cut = np.cumsum([len(found[k]) for k in portion])[:-1]
                for k, part in zip(portion, np.split(best, cut), strict=True):
                    labels[k] = [model.labels[b] for b in part]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "words": found, "labels": labels})

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, "doc_id long, words array<string>, labels array<string>"))
