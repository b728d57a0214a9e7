"""The training-corpus pipeline: documents in, token files out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import decontamination, language_crf, simhash_dedup, source_mix, token_files
from orderflow.session import configure, scratch_path

#: Mean word probability of the predicted language below which a document is rejected.
LANGUAGE_SCORE = 0.35
#: Model predictions and fingerprints take part in it: not expressible in SQL.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: not ``und`` and with a sufficient score."""
    configure(spark)
    model = language_crf.fit(docs.where(language_crf.learnable_rows("doc_id")))
    clash = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(c).alias(n) for c, n in clash.items()])
    judged = language_crf.predict(named, model, text_col=clash["text"])
    return (judged.where((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE))
            .select(*[F.col(n).alias(c) for c, n in clash.items()]))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each SimHash component."""
    configure(spark)
    return simhash_dedup.keep_one_per_component(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold any window of a benchmark item."""
    configure(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents to reach the sources' target weights."""
    configure(spark)
    return source_mix.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what they hold per document."""
    configure(spark)
    path, out = public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "corpus-tokens")
    token_files.write_token_files(docs, out, path)
    return token_files.token_file_summary(spark, out, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mix_stage),
    ("token_files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
