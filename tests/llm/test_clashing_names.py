"""Columns of documents that are named like the language prediction keep their values."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from orderflow.llm import compression_quality, decontamination, language_crf, line_dedup


def test_language_stage_keeps_own_columns(spark, docs):
    table = docs.withColumns({"lang_pred": F.lit("own"), "score": F.col("doc_id") * 2})
    got = corpus_pipeline.language_stage(spark, table, "unused")
    assert got.columns == table.columns
    rows = got.collect()
    assert len(rows) > 10
    assert {r.lang_pred for r in rows} == {"own"}
    assert all(r.score == (None if r.doc_id is None else 2 * r.doc_id) for r in rows)


def owned(docs, *names):
    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in names})


def test_line_dedup_keeps_own_columns(docs):
    names = ("__id", "__key", "__lines", "__LINES_", "__dropped", "__text_key", "h1", "key", "pos", "keep")
    table = owned(docs.where("doc_id IS NOT NULL"), *[n for n in names if n not in docs.columns])
    got = line_dedup.dedup_lines(table)
    assert got.columns == [*table.columns, "n_lines", "n_dropped"]
    want = line_dedup.dedup_lines(docs.where("doc_id IS NOT NULL"))
    plain = lambda df: sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())
    assert plain(got) == plain(want)
    assert all(r["__key"] == f"__key of {r.doc_id}" and r["__id"] == f"__id of {r.doc_id}" for r in got.collect())


def test_phrase_hits_keep_own_columns(spark, docs):
    items = spark.createDataFrame([(1, "one two"), (2, "the shared passage has exactly these words in it and goes")],
                                  "item_id long, text string")
    table = owned(docs.where("doc_id IS NOT NULL"), "__key", "__doc", "__found", "__r", "doc", "item", "shift")
    got = decontamination.phrase_hits(table, items)
    assert got.columns == [*table.columns, "n_words", "n_hit", "items"]
    want = decontamination.phrase_hits(docs.where("doc_id IS NOT NULL"), items)
    plain = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())
    assert plain(got) == plain(want) and any(r[2] for r in plain(got))
    assert all(r["__found"] == f"__found of {r.doc_id}" for r in got.collect())


def test_predict_keeps_nested_columns_of_any_name(spark, docs):
    model = language_crf.fit(docs)
    inner = F.struct(F.col("doc_id").alias("a name: with `marks`"), *[F.lit(k).alias(f"field {k}") for k in range(40)])
    table = docs.withColumns({"own struct": inner, "own map": F.create_map(F.lit("k"), F.array(inner))})
    got = language_crf.predict(table, model)
    assert got.columns == [*table.columns, "lang_pred", "score"]
    assert [f.dataType.typeName() for f in got.schema if f.name.startswith("own")] == ["struct", "map"]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r["own struct"][0] == r.doc_id and r["own struct"]["field 39"] == 39 and r["own map"]["k"][0][1] == 0 for r in rows)


def test_null_id_is_in_no_fold(spark):
    ids = spark.createDataFrame([(None,), *[(i,) for i in range(12)]], "doc_id long")
    for module, modulus, left in ((language_crf, 4, 2), (compression_quality, 3, 1)):
        got = ids.select("doc_id", module.held_out_rows().alias("held"), module.learnable_rows().alias("learn")).collect()
        assert (got[0].held, got[0].learn) == (False, False)
        assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % modulus == left) and r.learn != r.held for r in got[1:])
