"""Registered queries of the training-data operators, with SQL where it can express them.

``QUERIES``: name -> fn(spark, sf_dir); ``ORACLES``: name -> DuckDB SQL over
the same tables.  Queries pass production parameters to the operators and
derive the columns to compare from their real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import (
    compression_quality,
    decontamination,
    fingerprints,
    language_crf,
    lexical_search,
    license_rules,
    line_dedup,
    ngram_join,
    periodic_runs,
    simhash_dedup,
    source_mix,
    token_counts,
    token_files,
)
from orderflow.llm.common import materialise
from orderflow.session import configure, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, path)
    return token_files.token_file_summary(spark, out, path)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, p, ls[p] AS line,
         translate(trim(ls[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM split)
), shared AS (
  SELECT k, min(doc_id) AS home FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE s.home <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.p)
                       FILTER (WHERE s.home IS NULL OR s.home = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN shared s ON l.k = s.k
GROUP BY l.doc_id
"""


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.with_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLES["op9_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS name, md5(text) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), c AS (
  SELECT *, CASE WHEN size > 0 THEN floor(ln(size) * 8) ELSE -1 END AS cls,
         floor(('0x' || substr(md5(concat_ws(':', '0', doc_id::VARCHAR, h)), 1, 8))::BIGINT
               / 4294967296.0::DOUBLE * 65536) AS slot
  FROM d
), dealt AS (
  SELECT *, floor(slot * ceil(count(*) OVER (PARTITION BY name, cls) / 1000) / 65536) AS bucket FROM c
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY cls, bucket, size, doc_id, h) - 1 AS k FROM dealt
), src AS (
  SELECT source, name, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM c GROUP BY source, name
), tries AS (  -- every number of capped sources, by ratio of cap and weight
  SELECT a.name, (1.5 * (SELECT sum(source_size) FROM src) - coalesce(sum(2.0 * b.source_size), 0))::DOUBLE
         / ((SELECT sum(w) FROM src) - coalesce(sum(b.w), 0)) AS lv, any_value(2.0 * a.source_size / a.w) AS ratio
  FROM src a LEFT JOIN src b ON (2.0 * b.source_size / b.w, coalesce(b.name, '~'), b.name)
                              < (2.0 * a.source_size / a.w, coalesce(a.name, '~'), a.name)
  GROUP BY a.name
), targets AS (
  SELECT name, source_size,
         least(2.0 * source_size, w * (SELECT max(lv) FROM tries WHERE lv < ratio))::DOUBLE AS target,
         (('0x' || substr(md5('offset 0:' || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS u
  FROM src
), taken AS (
  SELECT doc_id, size, source_size, target,
         (floor(r * (k + 1) + u) - floor(r * k + u))::BIGINT AS copies
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r
        FROM placed JOIN targets USING (name))
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM taken
"""


@query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = simhash_dedup.fingerprints(table(spark, sf_dir, "documents"))
    return (simhash_dedup.near_components(fps)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.phrase_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op3_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM bw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM wins
), grams AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lengths WHERE len(w) >= n)
), met AS (
  SELECT g.doc_id, g.s, g.n, v.item_id FROM grams g JOIN wins v ON g.n = v.n AND g.win = v.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM met)) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id
)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_crf.fit(docs.where(language_crf.learnable_rows()))
    return (language_crf.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", language_crf.held_out_rows().alias("held_out"), "lang_pred", "score"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and for doc_ids divisible by 20 the number of documents within the radius (itself too)."""
    rows = materialise(fingerprints.edited(table(spark, sf_dir, "documents")), "edited")
    a, b = fingerprints.words_of(F.col("fp"))
    rows = rows.withColumns({"a": a, "b": b})
    per_fp = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    asks = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    queries = rows.where(asks)
    near = (fingerprints.within_radius(queries, per_fp).join(per_fp, ["a", "b"])
            .groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(F.sum("n").alias("n_near")))
    # only the queries' rows meet their counts; the others have none and are not shuffled
    return (queries.join(near, ["a", "b"], "left")
            .unionByName(rows.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
            .select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
                    F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near"))


@query
def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    may = compression_quality.learnable_rows()
    model = compression_quality.fit(docs.where(may), labels.where(may))
    return (compression_quality.score(docs, model)
            .select("doc_id", compression_quality.held_out_rows().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), pieces)


@query
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (license_rules.scan_licenses(table(spark, sf_dir, "documents"))
            .select("doc_id", F.size("licenses").cast("long").alias("n_matches"),
                    F.array_join("licenses", ",").alias("licenses"),
                    F.array_join(F.col("sentences").cast("array<string>"), ",").alias("sentences")))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_cycles(table(spark, sf_dir, "documents")))
    # greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"),
                                                              (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
                    F.col("best.n").alias("length"), (-F.col("best.q")).alias("period"),
                    F.expr("best.n * 1000 div -best.q").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))


ORACLES["op11_periodic_runs"] = r"""
WITH h AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents
), split AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM h
), placed AS (
  SELECT doc_id, o, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN g % len(o) END AS a, g FROM split
), cycled AS (
  SELECT doc_id, n, o, a, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), words AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM cycled)
), pairs AS (
  SELECT x.doc_id, x.i, x.i - y.i AS q FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n
), grouped AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(i) - q AS s, count(*) + q AS len FROM grouped GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, s, len, min(q) AS q FROM stretches GROUP BY doc_id, s, len
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t
  FROM words w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id
), per AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'len': len, 'q': q}, {'l': -len, 's': s, 'q': q}) AS b,
         string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS l
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length,
       b.q::BIGINT AS period, (1000 * b.len // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH terms AS (
  SELECT doc_id, t, tf, sum(tf) OVER (PARTITION BY doc_id)::BIGINT AS n FROM (
    SELECT doc_id, t, count(*) AS tf FROM (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents) GROUP BY doc_id, t)
), totals AS (
  SELECT count(DISTINCT doc_id) AS nd, sum(tf)::BIGINT AS l FROM terms
), weights AS (
  SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM terms, totals GROUP BY t, nd
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN terms USING (t), totals GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


# all pairs with a common shingle; a document reaches its component's least id over its links (cycles are cut by UNION)
ORACLES["op13_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
         ELSE w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY u, v
), links AS (
  SELECT u, v FROM shared JOIN sizes a ON u = a.doc_id JOIN sizes b ON v = b.doc_id WHERE 100 * k >= 90 * (a.n + b.n - k)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON d.doc_id = c.u
"""
