"""Periodic runs against every diagonal compared word by word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderflow.llm import periodic_runs


def plain_runs(w, min_words=6, min_periods=4):
    """(start, length, period): matches along each diagonal; of equal stretches the least period."""
    least = {}
    for q in range(1, len(w) // min_periods + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(min_words, min_periods * q) and j > i:
                least.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def got_runs(w, **params):
    return list(zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(w, np.int64), **params))))


def split(text):
    return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.lists(st.tuples(st.integers(0, 80), st.integers(1, 12),
                                                                    st.integers(0, 90)), max_size=4))
def test_runs_of_sequences(words, copies):
    for at, period, n in copies:  # make some stretches periodic
        for i in range(at + period, min(at + period + n, len(words))):
            words[i] = words[i - period]
    assert got_runs(words) == plain_runs(words)
    assert got_runs(words, min_words=9, min_periods=5) == plain_runs(words, 9, 5)


def test_long_sequences_take_linear_steps():
    n = 300_000
    assert got_runs(np.zeros(n)) == [(0, n, 1)]
    assert got_runs(np.arange(n) % 60_000) == [(0, n, 60_000)]
    r = np.random.default_rng(3).integers(0, 2, n)  # two words, each n / 2 times
    r[1000:9000] = np.arange(8000) % 1777 % 2 + 5 * (np.arange(8000) % 1777)
    assert (1000, 8000, 1777) in got_runs(r)


def test_runs_of_few_periods_are_refused():
    with pytest.raises(ValueError):
        got_runs([1] * 9, min_periods=3)


def plain_result(text):
    w = split(text)
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return tuple(runs), " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_of_documents(spark, docs, empty, monkeypatch):
    r = random.Random(8)
    texts = ["ha " * 40, "a b\n" * 9, "a b c a b c a b c a b", "la " * 5, "x " + "ha ha ho " * 6 + "y ha ha ha ha ha ha",
             " ".join(["one two"] * 4 + ["one one"] * 5 + ["end"]), "é É " * 30, "a\x1cb " * 7, "a  a\t\ta\x0ba a\ra a",
             " ".join(r.choice("ab") for _ in range(1500))]
    more = spark.createDataFrame([(900 + i, t, "en", "a", 1, 7, 8, "t", "l") for i, t in enumerate(texts)], docs.schema)
    every = docs.union(more).union(more)  # repeated rows
    want = Counter((x.doc_id, *plain_result(x.text)) for x in every.collect())
    for words_at_once in (periodic_runs.WORDS_AT_ONCE, 50):
        monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", words_at_once)
        got = periodic_runs.periodic_runs(every)
        assert got.columns == [*docs.columns, "runs", "collapsed"]
        assert Counter((x.doc_id, tuple(map(tuple, x.runs)), x.collapsed) for x in got.collect()) == want
    assert sum(bool(k[1]) for k in want) >= 8
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_own_columns_of_the_results_names(spark):
    df = spark.createDataFrame([(1, "a " * 9, 5, "z")], "doc_id long, text string, runs int, __found string")
    got = periodic_runs.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "__found", "runs", "collapsed"]
    assert got.first().runs == [(0, 9, 1)] and got.first()["__found"] == "z"


def plain_cycles(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    g, w = h // 10, split(text)
    if h % 10 or text is None:
        return text
    if not w:
        return ""
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return " ".join(w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))])


def test_cycles(spark, docs):
    rows = docs.collect()
    assert sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows) > 3
    got = Counter((r.doc_id, r.text) for r in periodic_runs.with_cycles(docs).collect())
    assert got == Counter((r.doc_id, r.text if r.doc_id is None else plain_cycles(r.doc_id, r.text)) for r in rows)
