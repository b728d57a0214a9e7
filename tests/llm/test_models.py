"""Learned operators: exact inference, held-out accuracy, defined cases; the pipeline; the entry without the folder."""

import os
import shutil
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderflow.llm import compression_quality, language_crf, queries

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def model(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return language_crf.fit(d.where(language_crf.learnable_rows()), docs_per_label=40)


def plain_forward_backward(m, words):
    e = np.exp(language_crf.potentials(m.weights, *language_crf.features(words)).astype(float))
    a = np.exp(m.transitions.astype(float))
    alpha, beta = [e[0] / e[0].sum()], [np.ones(len(m.labels))]
    for x in e[1:]:
        y = (alpha[-1] @ a) * x
        alpha.append(y / y.sum())
    for x in e[:0:-1]:
        y = a @ (x * beta[0])
        beta.insert(0, y / y.sum())
    p = np.array(alpha) * np.array(beta)
    return p / p.sum(1, keepdims=True)


def test_blocks_give_exact_probabilities(model, texts):
    found = [w for t in texts if t and (w := language_crf.words_of(t))]
    got = language_crf.Labeller(model).probabilities(found)
    assert np.abs(got - np.concatenate([plain_forward_backward(model, w) for w in found])).max() < 1e-5


def test_switched_text_is_labelled_in_pieces(spark, model):
    by = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 600")
          .groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    cut = {k: language_crf.words_of(v)[:30] for k, v in by.items()}
    text = " ".join(cut["de"] + cut["es"])
    got = language_crf.label_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got.words == cut["de"] + cut["es"]
    assert got.labels[:25].count("de") > 21 and got.labels[35:].count("es") > 21


def test_language_accuracy(spark):
    got = queries.QUERIES["op4_language_crf"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_cases(spark, docs, empty, model):
    got = language_crf.predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.count() == docs.count()
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0)
    assert language_crf.predict(empty, model).count() == 0
    nothing = language_crf.fit(empty)
    assert {r.lang_pred for r in language_crf.predict(docs, nothing).collect()} == {"und"}
    one = language_crf.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language_crf.predict(docs, one).collect()} == {"und", "de"}


def test_quality_accuracy(spark):
    got = queries.QUERIES["op6_compression_quality"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].score.mean() - held[held.quality == 0].score.mean() > 0.6


def test_quality_cases(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 7, 0), (None, 1, 0), (2, None, 0), (3, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = compression_quality.fit(docs, labels)
    got = compression_quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = compression_quality.fit(docs, labels.where("quality = 5"))
    assert {r.score for r in compression_quality.score(docs, none).collect()} == {0.5}
    only = compression_quality.fit(docs, labels.where("quality = 1"))
    assert {round(r.score, 3) for r in compression_quality.score(docs, only).collect()} == {0.999}
    assert compression_quality.score(empty, model).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(rows) > 500
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in rows)
    assert [r.start for r in ordered[1:]] == [r.start + r.n_tokens for r in ordered[:-1]]


def test_stages_keep_columns_and_pass_empty_tables(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    trained = corpus_pipeline.STAGES[1:]
    for _, stage in trained:
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, empty, SF).count() == 0


def test_entry_without_the_subpackage():
    to = tempfile.mkdtemp(prefix="orderflow-bare-")
    shutil.copytree(f"{ROOT}/orderflow", f"{to}/orderflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", to)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split()[1:] == ["False", "False"], done.stderr[-1500:]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
