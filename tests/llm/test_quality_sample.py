"""The quality classifier's sample and evidence against plain forms."""

from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from orderflow.llm import compression_quality
from orderflow.llm.common import least_by_hash


@pytest.mark.parametrize("k", [1, 40, 5000])
def test_least_by_hash(spark, k):
    df = spark.range(6000).select("id", F.when(F.col("id") % 50 == 0, 0).otherwise(1).alias("label"))
    df = df.union(df.where("id < 900")).union(spark.range(1).selectExpr("CAST(NULL AS LONG)", "1"))
    rows = df.select("id", "label", F.xxhash64("id").alias("h")).distinct().collect()
    want = Counter()
    for label in (0, 1):
        own = sorted((r.h, r.id is not None, r.id or 0, r.id) for r in rows if r.label == label)[:k]
        want.update((label, x[3], n + 1) for n, x in enumerate(own))
    got = least_by_hash(df, "label", "id", k)
    assert Counter((r.label, r.id, r.k) for r in got.collect()) == want


def test_a_bound_that_was_too_low_is_raised(spark):
    # ids chosen for large hashes: far fewer lie below the first bound than on average
    ids = spark.range(40000).where(F.xxhash64("id") > 2 ** 62).selectExpr("id", "1 AS label")
    assert least_by_hash(ids, "label", "id", 30).count() == 30


def test_least_by_hash_of_no_rows(spark):
    assert least_by_hash(spark.createDataFrame([], "id long, label int"), "label", "id", 5).count() == 0


def test_ranking_reads_a_bounded_number_of_rows(spark):
    df = spark.range(400_000).selectExpr("id", "1 AS label")
    before = least_by_hash(df, "label", "id", 100)
    assert before.count() == 100 and before.agg(F.max("k")).first()[0] == 100


def plain_size(data, dictionary):
    own = zstandard.ZstdCompressionDict(dictionary)
    c = zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=own, write_content_size=False,
                                 write_checksum=False, write_dict_id=False)
    n = compression_quality.BLOCK_BYTES
    return sum(len(c.compress(data[k:k + n])) for k in range(0, len(data), n))


def test_scores_are_calibrated_differences_of_compressed_sizes(spark):
    import math
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    may = compression_quality.learnable_rows()
    model = compression_quality.fit(docs.where(may), labels.where(may), docs_per_label=60)
    some = docs.where("doc_id % 9 = 0")
    got = {r.doc_id: r.score for r in compression_quality.score(some, model).collect()}
    for r in some.collect():
        data = (r.text or "").encode()
        good, bad = plain_size(data, model.good), plain_size(data, model.bad)
        evidence = (bad - good) / (bad + good) if data else 0.0
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(model.slope * evidence + model.offset))))
