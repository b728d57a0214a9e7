"""The Jaccard join against all pairs of plain Python sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderflow.llm import ngram_join


def plain_set(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_result(rows, percent=90, k=3):
    """Counter of (doc_id, n_shingles, component_id)."""
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_texts():
    """Chains of small edits, a dense group about one text, texts that share a passage, and texts of one passage only."""
    r = random.Random(4)
    out = []
    base = [f"w{r.randrange(400)}" for _ in range(130)]
    out += [edited(r, base, r.randint(0, 5)) for _ in range(90)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(25):
        chain[(i * 7) % 100] = f"d{i}"
        out.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(40))
    out += [passage + " " + " ".join(f"q{r.randrange(9999)}" for _ in range(r.randint(0, 60))) for _ in range(80)]
    out += [" ".join(f"u{r.randrange(50)}" for _ in range(r.randint(1, 9))) for _ in range(40)]
    out += ["Two Words", "two words", "two\twords ", "two", "TWO", "words two", "É é", "é É", out[0].upper(), out[3] + " "]
    return out


@pytest.mark.parametrize("params", [{}, {"max_region": 8}, {"percent": 75}, {"percent": 99}, {"shingle_words": 1}])
def test_components(spark, docs, near_texts, params, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_DOCS", 20)
    monkeypatch.setattr(ngram_join, "SMALL_ROWS", 3 if params else ngram_join.SMALL_ROWS)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i * 3, t) for i, t in enumerate(near_texts)]
    rows += [(2 ** 60 + 1, near_texts[0]), (2 ** 60 + 3, "far from all the others in here"), (None, near_texts[1]), (-5, near_texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = plain_result(rows, params.get("percent", 90), params.get("shingle_words", 3))
    got = ngram_join.near_components(df, **params)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == want
    assert max(Counter(k[2] for k in want).values()) > 20 or params.get("percent") == 99


def test_few_frequent_shingles_may_be_named(spark, near_texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_DOCS", 2)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 10)
    rows = list(enumerate(near_texts))
    got = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_result(rows)


def test_no_rows_and_no_words(spark, empty):
    assert ngram_join.near_components(empty).count() == 0
    rows = [(1, None), (2, ""), (2, " \n"), (None, "\t"), (3, "\x1c")]
    got = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter([(1, 0, 1), (2, 0, 2), (2, 0, 2), (None, 0, None), (3, 1, 3)])


def test_other_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "A b c d", 8, "y")], "doc_id long, text string, row int, home string")
    assert sorted(map(tuple, ngram_join.near_components(df).collect())) == [(1, 2, 1), (2, 2, 1)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(55, 98))
def test_regions_lose_no_link(seed, percent):
    """Recursive halves against all pairs, for clustered sets."""
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(int(r.integers(1, 12))):
        base = r.integers(0, 400, int(r.integers(5, 60)))
        for _ in range(int(r.integers(1, 25))):
            keep = r.random(len(base)) > r.random() * 0.2
            sets.append(np.unique(np.concatenate([base[keep], r.integers(0, 400, int(r.integers(0, 4))), base[:1]])).astype(np.uint64))
    guest = r.random(len(sets)) < 0.3
    got = set()
    ngram_join._Sets(sets, percent).join(np.arange(len(sets)), guest, lambda i, j: got.add((min(i, j), max(i, j))))
    want = set()
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(np.intersect1d(a, sets[j]))
            if 100 * k >= percent * (len(a) + len(sets[j]) - k) and not (guest[i] and guest[j]):
                want.add((j, i))
    assert got == want


def test_bad_parameters(empty):
    for bad in ({"percent": 100}, {"percent": 20}, {"shingle_words": 0}):
        with pytest.raises(ValueError):
            ngram_join.near_components(empty, **bad)
