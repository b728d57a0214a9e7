"""Line de-duplication across documents.

Every text is split at line feeds; a line's key is the line with ASCII white
space stripped at both ends and A-Z lower-cased.  Keys of ``min_chars`` code
points or more that at least ``min_docs`` documents hold lose all their lines
except those in the smallest doc_id that holds the key.

Lines are exploded to (key hash, doc_id, position); the text itself stays
behind.  Hashes are counted with map-side partial aggregation, the keys over
the threshold are joined back to the positions (a key in a third of all
documents is a skewed inner join, which AQE splits), and each document gets
the list of its dropped positions, from which its remaining lines are put
together in order.  Keys are compared by 128 bits of hash.

Defined cases: null or empty text is one empty line; rows with a null doc_id
are kept whole and not counted; repeated rows with one doc_id are one
document; an empty table gives an empty result; extra columns are kept by
``dedup_lines`` and never read, whatever their names, but for any named
``n_lines`` or ``n_dropped``, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import BLANKS, ascii_lower, fresh, size_or_zero


def dropped_positions(docs: DataFrame, *, min_docs: int = 2, min_chars: int = 10,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, dropped): the positions of the lines that documents lose, documents without any left out."""
    lines = (docs.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                     F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
             .withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS))))
             .where(F.char_length("key") >= min_chars)
             .select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit("line"), "key").alias("h2")))
    if min_docs == 2:  # two documents hold the key where its least and greatest doc_id differ
        repeated = (lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"))
                    .where("keep <> last"))
    else:
        repeated = (lines.select("h1", "h2", "doc_id").distinct()
                    .groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))
                    .where(F.col("n") >= min_docs))
    return (lines.join(repeated.select("h1", "h2", "keep"), ["h1", "h2"]).where("doc_id <> keep")
            .groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("dropped")))


def dedup_lines(docs: DataFrame, *, min_docs: int = 2, min_chars: int = 10,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its remaining lines as text, and the columns ``n_lines`` and ``n_dropped`` added."""
    drops = dropped_positions(docs, min_docs=min_docs, min_chars=min_chars, id_col=id_col, text_col=text_col)
    # names on the way that no own column has
    id_, text_key, dropped, key, cut = (fresh(docs, n) for n in ("__id", "__text_key", "__dropped", "__key", "__lines"))
    drops = drops.select(F.col("doc_id").alias(id_), F.col("text_key").alias(text_key), F.col("dropped").alias(dropped))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*own).withColumn(key, F.xxhash64(text_col))
    joined = rows.join(drops, (F.col(id_col) == F.col(id_)) & (F.col(key) == F.col(text_key)), "left")
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n", -1)
    n = F.size(lines)
    # positions in order without the dropped ones, in one hashed pass
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col(dropped))
    remaining = (F.when(F.col(dropped).isNull(), F.coalesce(text_col, F.lit("")))
                 .otherwise(F.array_join(F.transform(kept, lambda p: F.get(cut, p)), "\n")))
    return (joined.withColumn(cut, lines)
            .select(*[c for c in own if c != text_col], remaining.alias(text_col),
                    F.size(cut).cast("long").alias("n_lines"),
                    size_or_zero(dropped).cast("long").alias("n_dropped"))
            .select(*own, "n_lines", "n_dropped"))
