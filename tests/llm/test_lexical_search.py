"""Ranked search against scores added up in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from orderflow.llm import lexical_search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, queries, k=20):
    """docs: (id, text); queries: (id, text); Counter of (query id, rank, doc id, score)."""
    tfs = [(i, Counter(plain_terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, length = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    want = Counter()
    for q, text in set(queries):
        scored = []
        for i, c in tfs:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        want.update((q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k]))
    return want


QUERIES = [(1, "the shared passage has exactly these words in it"), (2, "KAS, kas kas loT"), (3, None), (4, ""), (5, "!?"),
           (6, "nowhere-to-be-found zzz"), (7, "é lox Subscribe letter"), (None, "words letter now"), (2, "KAS, kas kas loT"),
           (2, "nund lond mit"), (9, "x")]


@pytest.mark.parametrize("block_docs, query_bytes, k", [(8192, 1 << 20, 20), (3, 12, 20), (5, 1 << 20, 2)])
def test_ranking(spark, docs, block_docs, query_bytes, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block_docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_ranking(rows, QUERIES, k)
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    got = lexical_search.ranked(docs, queries, k=k, vocabulary_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want
    assert len({x[0] for x in want}) >= 5 and any(x[2] is None for x in want) or k == 2


def test_equal_scores_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(50, 0, -1)] + [(0, "other text entirely")],
                                 "doc_id long, text string").repartition(7)
    queries = spark.createDataFrame([("q", "words")], "item_id string, text string")
    got = sorted(map(tuple, lexical_search.ranked(docs, queries).collect()))
    assert [x[1:3] for x in got] == [(r, r) for r in range(1, 21)]
    assert Counter(got) == plain_ranking([(r.doc_id, r.text) for r in docs.collect()], [("q", "words")])


def test_no_rows(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "kas")], "item_id long, text string")
    assert lexical_search.ranked(docs, none).count() == 0
    assert lexical_search.ranked(empty, some).count() == 0
    assert lexical_search.ranked(empty, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_below_the_bound_are_not_visited(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "rare " * 3 + "pad " * (i % 40)) for i in range(400)]
                                 + [(i, "pad " * 30) for i in range(400, 900)], "doc_id long, text string")
    index = lexical_search.build_index(docs, [b"rare"])
    rows = index.blocks.collect()
    blocks = [lexical_search._Block(r, index.weights) for r in rows]
    assert len({r.m for r in rows}) > 20 and sum(len(b.docs) for b in blocks) == 400
    visited = []
    scores = lexical_search._Block.scores
    monkeypatch.setattr(lexical_search._Block, "scores", lambda b, *a: visited.append(b) or scores(b, *a))
    found = list(lexical_search._visit(blocks, [(0, np.array([0]), np.array([1]))], 1, 5))
    assert len(found) == 5 and len(visited) < len(blocks) / 4


def test_terms_are_cut_at_ascii_separators():
    text = "A-b_c 9Z É€ß\x7f\x1cx　y @[`{"
    assert [t.decode() for t in lexical_search.terms_of(text)] == plain_terms(text)
