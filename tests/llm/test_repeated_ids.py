"""Near duplicates where ids repeat with different texts: no component may lose its document."""

from collections import Counter, defaultdict

import pytest

from orderflow.llm import simhash_dedup

from .test_exact_operators import plain_components, plain_fp

BASE = " ".join(f"w{k}" for k in range(400))


@pytest.mark.parametrize("many_rows", [simhash_dedup.MANY_ROWS, 0])
def test_every_component_keeps_one_row(spark, docs, many_rows, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "MANY_ROWS", many_rows)
    rows = docs.collect()
    texts = {r.doc_id: r.text for r in rows}
    extra = [(40, texts[2]),                         # id 40: a copy of document 2 besides its own text
             (500, texts[4]), (500, "a text that only id five hundred has, far from every other one"),
             (500, "a text that only id five hundred has, far from every other one"),
             (600, BASE), (600, BASE + " "), (601, BASE),  # one component, two texts under its least id
             (700, None), (700, "")]
    more = spark.createDataFrame([(i, t, "en", "a", 1, 7, 8, "t", "l") for i, t in extra], docs.schema)
    every = [(r.doc_id, r.text) for r in rows] + extra
    comp = plain_components([(i, plain_fp(t)) for i, t in every], 4)
    # components are told apart by the fingerprints that plain_components links
    got = [(r.doc_id, r.text) for r in simhash_dedup.keep_one_per_component(docs.union(more)).collect()]
    assert Counter(t for i, t in got if i is None) == Counter(t for i, t in every if i is None)
    of = labels([plain_fp(t) for _, t in every], 4)
    least = defaultdict(set)
    for i, t in every:
        if i is not None:
            least[of[plain_fp(t)]].add(comp[plain_fp(t)])
    kept = defaultdict(list)
    for i, t in got:
        if i is not None:
            kept[of[plain_fp(t)]].append(i)
    assert {k: set(v) for k, v in kept.items()} == least
    assert all(len(v) == 1 for v in kept.values())
    assert (40, texts[40]) in got and (5, texts_of(every, 5)[0]) in got and (5, texts_of(every, 5)[1]) in got


def texts_of(rows, doc_id):
    return sorted(t for i, t in rows if i == doc_id)


def labels(fps, radius):
    """The least fingerprint that each one reaches."""
    values = sorted(set(fps))
    root = {v: v for v in values}
    find = lambda v: v if root[v] == v else find(root[v])
    for k, a in enumerate(values):
        for b in values[k + 1:]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}
