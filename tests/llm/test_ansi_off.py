"""Rows do not depend on ANSI mode, in which ``size`` of null is null instead of -1."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderflow.llm import decontamination, line_dedup, source_mix

from .test_exact_operators import ITEMS


def by_text(df):
    return Counter(map(repr, df.collect()))


@pytest.mark.parametrize("run", [
    lambda docs, items: decontamination.phrase_hits(docs, items),
    lambda docs, items: decontamination.drop_contaminated(docs, items),
    lambda docs, items: line_dedup.dedup_lines(docs),
    lambda docs, items: docs.select("doc_id", source_mix.n_words(F.col("text")).alias("n"))])
def test_ansi_off_gives_the_same_rows(spark, docs, run):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = by_text(run(docs, items))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = by_text(run(docs, items))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == want and want
