"""The pipeline's rows against its stages redone in plain Python over a small folder of tables."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from orderflow.llm import language_crf, source_mix
from orderflow.session import scratch_path

from .test_exact_operators import ITEMS, plain_components, plain_fp, plain_ids, words


def test_pipeline_rows(spark, docs):
    sf = scratch_path(spark, "small-sf")
    docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_crf.fit(table.where(language_crf.learnable_rows()))
    rows = [r for r in language_crf.predict(table, model).collect()
            if r.lang_pred != "und" and r.score >= corpus_pipeline.LANGUAGE_SCORE]
    comp = plain_components([(r.doc_id, plain_fp(r.text)) for r in rows], 4)
    rows = [r for r in rows if comp[plain_fp(r.text)] == r.doc_id]
    wins = {tuple(w[k:k + 10]) for _, t in ITEMS for w in [words(t)] if w for k in range(max(1, len(w) - 9))}
    clean = []
    for r in rows:
        w = words(r.text)
        if not any(tuple(w[k:k + len(x)]) == x for x in wins for k in range(len(w) - len(x) + 1)):
            clean.append(r)
    copies = {r.doc_id: r.copies for r in
              source_mix.with_copies(table.where(table.doc_id.isin([r.doc_id for r in clean]))).collect()}
    want, start = [], 0
    for r in sorted(clean, key=lambda r: r.doc_id):
        ids = np.array([*plain_ids(r.text or ""), 1], "<u4")
        for _ in range(copies[r.doc_id]):
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert 10 < len(clean) < len(rows)
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(want)
