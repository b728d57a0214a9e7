"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words.  Sources get targets in words by
weight, capped at ``max_epochs`` times their size, the excess going to the
others by weight (water filling).  All documents of a source expect the same
number of copies r = target / source size.  Going through the source in one
order, document k is emitted once for each integer in the interval
(r*k + u, r*(k+1) + u], u being the source's one random offset in [0, 1).

The order runs by size class, so that every class is taken in proportion and
the words taken come near the target.  Positions are prefix sums in two
steps: rows are dealt into buckets of bounded expected size per (source, size
class), the buckets' counts are summed up over one row per bucket, and a
row's place in its bucket is added.  A source with a third of all rows
therefore spreads over many buckets, and so does a size.

Only DataFrame functions run; the same input gives the same mix, as offset and
order come from hashes.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; a source without words takes none; rows with equal doc_id are
ordered by size and text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import BLANK_RUN, BLANKS, broadcast_if_small, materialise, size_or_zero

#: Rows that a bucket is meant to hold, and the slots that a (source, class) can be dealt into at most.
BUCKET_ROWS, SLOTS = 1000, 65_536
#: Plan rows (about 60 bytes each) up to which the plan is broadcast; beyond, it is joined by shuffle.
SMALL_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(size_or_zero(F.split(bare, BLANK_RUN, -1))).cast("long")


def _fraction(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) with ``target``: ``share`` of all words by cycling weights, capped, excess reshared.

    With sources in order of cap per weight, the water level is the first at
    which the next source's cap isn't reached, and later ones would be lower;
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    rows = (sizes.withColumn("weight", F.get(weight, (F.row_number().over(by_name) - 1) % len(weights)))
            .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")))
    # equal ratios may come in any order: their caps are reached together
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    level = F.when(left / left_weight * F.col("weight") < F.col("cap"), left / left_weight)
    return (rows.withColumn("level", level)
            .withColumn("level", F.max("level").over(every))
            .select("source", "source_size",
                    F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")))


def with_copies(docs: DataFrame, *, seed: int = 0, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                max_epochs: float = 2.0, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and the number of ``copies`` of each row; ``keep``: more columns.

    One pass over the texts counts rows and words by (source, class, slot);
    the plan of the mix is made from these counts.  The second pass moves
    each row once, to its bucket.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(""))  # never null, null source apart
    chance = _fraction(F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text_col))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), name.alias("name"),
                        n_words(F.col(text_col)).alias("size"), F.floor(chance * SLOTS).cast("int").alias("slot"),
                        F.md5(text_col).alias("text_md5"), *[F.col(c).alias(f"kept_{c}") for c in keep])
            # never null, or the joins on it would filter by it and count the words once more; log of 0 is null
            .withColumn("class", F.coalesce(F.floor(F.log("size") * 8), F.lit(-1))))
    counts = materialise(rows.groupBy("name", "source", "class", "slot")
                         .agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-counts")
    deal = materialise(counts.groupBy("name", "class").agg(F.sum("n").alias("n"))
                       .select("name", "class", F.ceil(F.col("n") / bucket_rows).alias("buckets")), "mix-deal")
    deal = broadcast_if_small(deal, SMALL_ROWS)
    bucket = F.floor(F.col("slot") * F.col("buckets") / SLOTS)
    earlier = Window.partitionBy("name").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.join(deal, ["name", "class"]).groupBy("name", "class", bucket.alias("bucket"))
              .agg(F.sum("n").alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    sizes = counts.groupBy("name", "source").agg(F.sum("words").alias("source_size"))
    targets = (source_targets(sizes.drop("name"), weights, share, max_epochs)
               .withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = materialise(starts.join(targets, "name")
                       .select("name", "class", "bucket", "start", "source_size", "target", rate.alias("rate"),
                               _fraction(F.lit(f"offset {seed}"), F.col("name")).alias("offset")), "mix-plan")
    in_bucket = Window.partitionBy("name", "class", "bucket").orderBy("size", "doc_id", "text_md5")
    ranked = (rows.join(deal, ["name", "class"])
              .withColumn("bucket", bucket)
              .withColumn("place", F.row_number().over(in_bucket) - 1)
              .join(broadcast_if_small(plan, SMALL_ROWS), ["name", "class", "bucket"]))
    at = F.col("start") + F.col("place")
    copies = (F.floor(F.col("rate") * (at + 1) + F.col("offset")) - F.floor(F.col("rate") * at + F.col("offset")))
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
                         *[F.col(f"kept_{c}").alias(c) for c in keep])


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **params) -> DataFrame:
    """The mixed corpus: ``docs``' rows, each as often as it has copies."""
    others = [c for c in docs.columns if c not in (id_col, source_col)]
    clash = {c: f"own_{i}" for i, c in enumerate(others)}
    rows = docs.select(id_col, source_col, *[F.col(c).alias(clash[c]) for c in others])
    mixed = with_copies(rows, id_col=id_col, text_col=clash[text_col], source_col=source_col,
                        keep=list(clash.values()), **params)
    names = {id_col: "doc_id", source_col: "source"} | clash
    return (mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*[F.col(names[c]).alias(c) for c in docs.columns]))
