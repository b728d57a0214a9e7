"""Ranked lexical search over a length-stratified index.

Terms are runs of ``0-9 a-z`` and characters outside ASCII, A-Z lower-cased.
With N documents that have terms, L terms in all of them, n terms in a
document, df documents holding a term and tf its occurrences in one:
w = floor(1000 ln((2 N + 2) / (2 df + 1))), the normaliser
m = 100 - 25 + (25 n N) div L, and a document's score is the sum of
w * ((1000000000 tf) div (1000 tf + 12 m)) over the query's terms, repeats
included. A query gets its ``k`` highest documents with a score above 0, equal
scores by ascending doc_id.

1. ``build_index``: one pass over the texts counts every document's terms and
   keeps the postings of the vocabulary (the queries' terms). N, L and df are
   sums over all documents. Documents with the same m form a stratum; a stratum
   of more than ``BLOCK_DOCS`` documents is dealt into blocks by hash, so a
   length that a third of all documents share is many rows. A row of the index
   holds one block: its documents, and by term and tf the documents that have
   the term so often.
2. ``search``: within a stratum the impact depends on tf alone, so it is
   computed once per tf. A task reads the blocks of its part of the index,
   bounds each query's score in each block by the impacts of the largest tfs,
   and visits a query's blocks from the highest bound on, until the bound is
   below its k-th score so far. The tasks' best rows are ranked in two steps.

The vocabulary travels to the tasks with its terms' weights. ``VOCABULARY_BYTES``
bounds it: ``ranked`` deals longer query sets into blocks of queries, one index each.

Defined cases: null text has no terms; a document without terms is in no
result; every row of ``docs`` is a document, so equal rows rank one after the
other; rows with a null id come after all others of equal score; equal query
rows are one query, a query without terms (or with none that a document has)
has no rows, a null query id is an id; w may be 0 or negative where every
document has the term; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import LOWER, UPPER, broadcast_if_small, materialise

TOP = 20
#: Documents to a block of a stratum.
BLOCK_DOCS = 8192
#: Bytes of distinct query terms that one index is built for.
VOCABULARY_BYTES = 32 << 20
#: Parts that a query's rows are ranked in before the last ranking.
RANK_PARTS = 32
#: Strata (distinct normalisers) up to which their sizes are broadcast.
SMALL_ROWS = 100_000
#: Stands for a null id, after all others.
NO_ID = 2 ** 63 - 1

_TERM_BYTES = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b
                    if b > 127 or chr(b).isdigit() or chr(b) in LOWER else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: all separators are ASCII, so its bytes can be mapped and split at spaces."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


@dataclass
class Index:
    """``blocks``: the written rows (see ``build_index``); ``weights``: w by term number; ``vocabulary``: term to number."""

    blocks: DataFrame
    weights: np.ndarray
    vocabulary: dict[bytes, int]


def _forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with terms; terms: their vocabulary terms' numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = terms_of(text)
                if words:
                    tf = Counter(words)
                    known = sorted((vocabulary[t], c) for t, c in tf.items() if t in vocabulary)
                    rows.append((doc_id, len(words), [t for t, _ in known], [c for _, c in known]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"]).astype({"doc_id": "int64"})

    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInPandas(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _pack(pdf: pd.DataFrame, m: int) -> dict:
    """One row of the index: a block's documents, with those that have a term equally often side by side."""
    sizes = pdf["terms"].map(len).to_numpy()
    terms, tfs = (np.concatenate([np.asarray(x, np.int32) for x in pdf[c]]) for c in ("terms", "tfs"))
    doc = np.repeat(np.arange(len(pdf), dtype=np.int32), sizes)
    order = np.lexsort((doc, tfs, terms))
    terms, tfs, doc = terms[order], tfs[order], doc[order]
    new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])][:len(terms)])
    return {"m": m, "docs": pdf["doc_id"].to_numpy(np.int64).tobytes(), "terms": terms[new].tobytes(),
            "tfs": tfs[new].tobytes(), "starts": np.r_[new, len(doc)].astype(np.int64).tobytes(), "postings": doc.tobytes()}


def build_index(docs: DataFrame, vocabulary: list[bytes], *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of the vocabulary's terms over all documents, written to the shared folder.

    Rows (m, docs, terms, tfs, starts, postings): group g of a block is the documents
    ``postings[starts[g]:starts[g + 1]]`` (places in ``docs``) that have ``terms[g]`` ``tfs[g]`` times.
    """
    number = {t: i for i, t in enumerate(vocabulary)}
    forward = materialise(_forward(docs, number, id_col, text_col), "forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the vocabulary
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
                        for t in range(len(vocabulary))], np.int64)
    exact = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else F.lit(c).cast("decimal(20,0)")
    m = F.lit(75) + F.call_function("div", F.lit(25).cast("decimal(3,0)") * exact("n").cast("decimal(14,0)")
                                    * exact(n_docs), exact(max(n_terms, 1)))
    forward = forward.where(F.size("terms") > 0).withColumn("m", m)
    strata = materialise(forward.groupBy("m").agg(F.count("*").alias("n_docs")), "strata-sizes")
    dealt = (forward.join(broadcast_if_small(strata, SMALL_ROWS), "m")
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_docs") / BLOCK_DOCS))))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None  # the rows of a block, which batches may cut
        for pdf in batches:
            for k, rows in pdf.groupby(["m", "block"], sort=False):
                if k != key and held:
                    yield pd.DataFrame([_pack(pd.concat(held), key[0])])
                    held = []
                held.append(rows)
                key = k
        if held:
            yield pd.DataFrame([_pack(pd.concat(held), key[0])])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (dealt.select("m", "block", "doc_id", "terms", "tfs").repartition(parts, "m", "block")
              .sortWithinPartitions("m", "block", "doc_id")
              .mapInPandas(pack, "m long, docs binary, terms binary, tfs binary, starts binary, postings binary"))
    return Index(materialise(blocks, "strata"), weights, number)


class _Block:
    """A block with the impacts of its groups."""

    def __init__(self, row, weights: np.ndarray) -> None:
        self.docs = np.frombuffer(row.docs, np.int64)
        self.terms, tfs = np.frombuffer(row.terms, np.int32), np.frombuffer(row.tfs, np.int32).astype(np.int64)
        self.starts, self.postings = np.frombuffer(row.starts, np.int64), np.frombuffer(row.postings, np.int32)
        distinct, at = np.unique(tfs, return_inverse=True)  # impacts once per tf
        self.gains = weights[self.terms] * ((1_000_000_000 * distinct) // (1000 * distinct + 12 * row.m))[at]
        last = np.flatnonzero(np.r_[self.terms[1:] != self.terms[:-1], True])
        self.first_group = np.r_[0, last[:-1] + 1]
        self.own_terms = self.terms[last]
        self.most = np.maximum.reduceat(self.gains, self.first_group)  # most that a term can add

    def scores(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of all documents of the block for a query's terms (sorted) and their repeats."""
        at = np.searchsorted(self.own_terms, terms)
        has = at < len(self.own_terms)
        has[has] = self.own_terms[at[has]] == terms[has]
        out = np.zeros(len(self.docs), np.int64)
        ends = np.r_[self.first_group[1:], len(self.terms)]
        for t, n in zip(at[has], times[has]):
            lo, hi = self.first_group[t], ends[t]
            gains = np.repeat(n * self.gains[lo:hi], np.diff(self.starts[lo:hi + 1]))
            out[self.postings[self.starts[lo]:self.starts[hi]]] += gains  # a document is in one group of a term
        return out


def _visit(blocks: list[_Block], queries: list[tuple], n_terms: int, k: int) -> Iterator[tuple]:
    """(query, doc_id, score) of each query's k best documents in these blocks."""
    flat = np.concatenate([q[1] for q in queries]) if queries else np.zeros(0, np.int64)
    times = np.concatenate([q[2] for q in queries]) if queries else np.zeros(0, np.int64)
    firsts = np.cumsum([0, *(len(q[1]) for q in queries[:-1])]) if queries else np.zeros(0, np.int64)
    bounds = np.zeros((len(blocks), len(queries)), np.int64)
    for b, block in enumerate(blocks):
        most = np.zeros(n_terms, np.int64)
        most[block.own_terms] = np.maximum(block.most, 0)
        if queries:
            bounds[b] = np.add.reduceat(most[flat] * times, firsts)
    for i, (query, terms, repeats) in enumerate(queries):
        best = np.zeros((2, 0), np.int64)  # scores, ids
        for b in np.argsort(-bounds[:, i], kind="stable"):
            bound = bounds[b, i]
            if bound <= 0 or best.shape[1] == k and bound < best[0, -1]:
                break  # equal bounds may hold smaller ids
            scores = blocks[b].scores(terms, repeats)
            good = np.flatnonzero(scores >= max(1, best[0, -1] if best.shape[1] == k else 1))
            best = np.concatenate([best, np.stack([scores[good], blocks[b].docs[good]])], axis=1)
            best = best[:, np.lexsort((best[1], -best[0]))[:k]]
        yield from ((query, int(d), int(s)) for s, d in best.T)


def search(index: Index, queries: list[tuple[int, list[bytes]]], k: int = TOP) -> DataFrame:
    """(query, rank, doc_id, score) of the k best documents for each (query, terms)."""
    number, weights = index.vocabulary, index.weights
    asked = []
    for query, terms in queries:
        counts = sorted(Counter(number[t] for t in terms if t in number).items())
        if counts:
            asked.append((query, np.array([t for t, _ in counts]), np.array([c for _, c in counts], np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [_Block(row, weights) for pdf in batches for row in pdf.itertuples()]
        yield pd.DataFrame(list(_visit(blocks, asked, len(weights), k)), columns=["query", "doc_id", "score"], dtype="int64")

    found = index.blocks.mapInPandas(run, "query long, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id"))
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), RANK_PARTS))
    for by in (["query", "part"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("query", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def _query_blocks(queries: list, most_bytes: int) -> Iterator[list]:
    """The queries in blocks whose terms take ``most_bytes`` at most (or one query each)."""
    upto, block = 0, 0
    numbered = []
    for q in queries:
        size = sum(map(len, set(q[-1])))
        if upto and upto + size > most_bytes:
            block, upto = block + 1, 0
        upto += size
        numbered.append((block, q))
    for _, rows in groupby(numbered, key=lambda x: x[0]):
        yield [q for _, q in rows]


def ranked(docs: DataFrame, queries: DataFrame, *, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           query_id_col: str = "item_id", query_text_col: str = "text",
           vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``docs`` for each row of ``queries``.

    The query set is given, and so is read to the driver, a block of queries at a time.
    """
    rows = queries.select(F.col(query_id_col).alias("id"), F.col(query_text_col).alias("text")).distinct()
    kind, results = rows.schema["id"].dataType, []
    spark = docs.sparkSession
    read = ((r.id, terms_of(r.text)) for r in rows.orderBy("id", "text").toLocalIterator())
    for block in _query_blocks([q for q in read if q[1]], vocabulary_bytes):
        vocabulary = sorted({t for _, terms in block for t in terms})
        index = build_index(docs, vocabulary, id_col=id_col, text_col=text_col)
        found = search(index, [(i, terms) for i, (_, terms) in enumerate(block)], k)
        ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query long, item_id {kind.simpleString()}")
        results.append(found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out
