import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, size int, term string, label string"


def rows_of(texts, sources=("a", "b", None)):
    return [(i, t, ("en", "de")[i % 2], sources[i % len(sources)], len(t or ""), 7, 8, "t", "l")
            for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Small texts with copies, near copies, shared lines and passages, blanks, nulls and one long text."""
    r = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re", "Ã©", "T") for b in ("s", "t", "nd", "ö", "x", "")]
    passage = "the shared passage has exactly these words in it and goes on for some more words here"
    out = []
    for i in range(60):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 6))]
        if i % 7 == 0:
            lines.insert(1, "  Subscribe to OUR letter now\t")
        if i % 9 == 0:
            lines.append(passage + ", " + passage)
        out.append("\n".join(lines))
    out[10] = out[11] = out[12]
    out[20] = out[21] + " extra"
    out += [None, "", " \n\t ", "12 34 !!", "one", "one two", "ONE\rtwo\x0bthree four five", "x" * 5000,
            " ".join(r.choice(words) for _ in range(6000)), "a\n\nb\n", "   wide", "\x1cab 'S it's"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, a repeated row, an id with two texts and a null id, with extra columns of clashing names."""
    rows = rows_of(texts)
    rows += [rows[3], rows[3], (5, "another text under id five", "en", "a", 1, 7, 8, "t", "l"),
             (None, "a row without an id, words words words", None, None, 1, 7, 8, "t", "l")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
