"""Benchmark decontamination with a positional inverted index.

Words are runs of ``0-9 a-z`` and characters outside ASCII, A-Z lower-cased
first. A window is ``window`` consecutive words of an item, or the whole item
if it has fewer (but some). A document word inside any occurrence of a window
is hit.

1. Corpus frequencies of the benchmark's words, counted over all documents.
2. Per window its rarest words; a window with a word that no document has
   can't occur and is left out.
3. The index: for each of these words all (document, position) postings,
   written to the shared folder.
4. Position lists are shifted by the word's place in the item and intersected,
   rarest first: what remains is (item, document, shift).
5. Shifts are checked word by word against the document, which also joins
   overlapping windows and gives exact hits.

Everything runs as DataFrame functions. The index joins are shuffle joins on
words or on (word, document, position), a benchmark side is broadcast only
after its rows are counted, and texts move once, for the check. Documents are
told apart by a 64-bit hash of id and text; a collision only adds candidates
that the check refuses.

``phrase_hits`` gives exact phrase matches, ``proximity_matches`` documents
that have an item's rarest words close together in any order.

Defined cases: null text has no words; an item without words matches nothing;
an item with a null id counts as item ``null``; repeated items are one, and
repeated documents each get their result; empty tables give no hits; extra
columns are kept, whatever their names, but for any named ``n_words``,
``n_hit`` or ``items``, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import ascii_lower, broadcast_if_small, fresh, materialise, size_or_zero

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, RAREST = 10, 2
#: Words, anchors or items (some hundred bytes each at most in practice) up to which the benchmark side is broadcast.
SMALL_ROWS = 100_000


def _split(text: Column) -> Column:
    """Words with an empty string where the text starts or ends with a separator; positions count from there."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def _count(parts: Column) -> Column:
    empty = lambda c: F.when(c == "", 1).otherwise(0)
    return (F.size(parts) - empty(F.get(parts, F.lit(0)))
            - F.when(F.size(parts) > 1, empty(F.element_at(parts, -1))).otherwise(0)).cast("long")


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, q): the items that have words, each once."""
    return materialise(
        benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"),
                         F.array_remove(_split(F.col(text_col)), "").alias("q"))
        .where(F.size("q") > 0).distinct().select(F.xxhash64("item_id", "q").alias("item"), "item_id", "q"),
        "items")


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_key(id_col, text_col).alias("doc"), F.posexplode(_split(F.col(text_col))).alias("pos", "term"))


def _frequencies(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, n): occurrences of the given terms in all documents; terms without any are left out."""
    words = _words(docs, id_col, text_col).select("term")
    return words.join(broadcast_if_small(terms, SMALL_ROWS), "term", "left_semi").groupBy("term") \
        .agg(F.count("*").alias("n"))


def _anchors(items: DataFrame, frequencies: DataFrame, window: int, rarest: int) -> DataFrame:
    """(item, anchors): per window its rarest words as (n, pos, term), rarest first, each such list once per item."""
    places = items.select("item", F.size("q").alias("len"), F.posexplode("q").alias("pos", "term"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - (window - 1)),
                        F.least(F.col("pos"), F.greatest(F.lit(0), F.col("len") - window)))
    return (places.join(frequencies, "term", "left")
            .select("item", F.explode(starts).alias("start"),
                    F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "term").alias("word"))
            .groupBy("item", "start").agg(F.sort_array(F.collect_list("word")).alias("words"))
            .where(F.col("words")[0]["n"] > 0)
            .select("item", F.slice("words", 1, rarest).alias("anchors")).distinct())


def build_index(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``terms`` (term): a written table (term, doc, pos) over all documents."""
    return materialise(_words(docs, id_col, text_col).join(broadcast_if_small(terms, SMALL_ROWS), "term", "left_semi")
                       .select("term", "doc", "pos"), "postings")


def _plan(docs: DataFrame, items: DataFrame, window: int, rarest: int, id_col: str, text_col: str):
    terms = materialise(items.select(F.explode("q").alias("term")).distinct(), "benchmark-terms")
    frequencies = _frequencies(docs, terms, id_col, text_col)
    anchors = materialise(_anchors(items, frequencies, window, rarest), "anchors")
    needed = materialise(anchors.select(F.explode("anchors.term").alias("term")).distinct(), "anchor-terms")
    return anchors, build_index(docs, needed, id_col=id_col, text_col=text_col)


def _candidates(anchors: DataFrame, index: DataFrame, rarest: int) -> DataFrame:
    """(item, doc, shift) where the anchors' position lists, shifted, meet: a document's word is at shift + its place."""
    first = broadcast_if_small(anchors, SMALL_ROWS).withColumn("term", F.col("anchors")[0]["term"])
    found = index.join(first, "term").select("item", "doc", "anchors",
                                             (F.col("pos") - F.col("anchors")[0]["pos"]).alias("shift"))
    for k in range(1, rarest):
        this = F.get("anchors", F.lit(k))
        sought = found.where(this.isNotNull()).withColumns({"term": this["term"], "pos": F.col("shift") + this["pos"]})
        met = sought.join(index, ["term", "doc", "pos"], "left_semi").select("item", "doc", "anchors", "shift")
        found = met.union(found.where(this.isNull()))
    return found.select("item", "doc", "shift").distinct()


def _checked(words: Column, found: Column, window: int) -> Column:
    """Per candidate of a document: its item_id and the positions that its occurring windows cover."""

    def one(c: Column) -> Column:
        n = F.least(F.lit(window), F.size(c["q"]))
        starts = F.sequence(F.greatest(F.lit(0), -c["shift"]), F.greatest(F.greatest(F.lit(0), -c["shift"]),
                                                                           F.size(c["q"]) - n))
        same = lambda s: (s + n <= F.size(c["q"])) & (
            F.slice(words, c["shift"] + s + 1, n) == F.slice(c["q"], s + 1, n))
        covered = F.transform(F.filter(starts, same),
                              lambda s: F.sequence(c["shift"] + s, c["shift"] + s + n - 1))
        return F.struct(c["item_id"].alias("item_id"), F.array_distinct(F.flatten(covered)).alias("hit"))

    return F.filter(F.transform(found, one), lambda r: F.size(r["hit"]) > 0)


def phrase_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, rarest: int = RAREST,
                id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, and ``items``: the sorted ids of the items that have occurring windows."""
    doc, met, key, out = (fresh(docs, n) for n in ("__doc", "__found", "__key", "__r"))  # no own column has them
    items = _items(benchmark, item_id_col, item_text_col)
    anchors, index = _plan(docs, items, window, rarest, id_col, text_col)
    found = (_candidates(anchors, index, rarest).join(broadcast_if_small(items, SMALL_ROWS), "item")
             .groupBy(F.col("doc").alias(doc))
             .agg(F.collect_list(F.struct("item_id", "shift", "q")).alias(met)))
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    rows = docs.select(*own, _key(id_col, text_col).alias(key))
    joined = rows.join(found, F.col(key) == F.col(doc), "left")

    def result(words: Column) -> Column:
        return F.struct(_count(words).alias("n"),
                        F.when(F.col(met).isNotNull(), _checked(words, F.col(met), window)).alias("hits"))

    # the one-element array binds the split words once, for all uses within the lambda
    joined = joined.withColumn(out, F.explode(F.transform(F.array(_split(F.col(text_col))), result)))
    return joined.select(
        *own, F.col(out)["n"].alias("n_words"),
        size_or_zero(F.array_distinct(F.flatten(F.col(out)["hits"]["hit"]))).cast("long").alias("n_hit"),
        F.coalesce(F.sort_array(F.array_distinct(F.col(out)["hits"]["item_id"])),
                   F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that hold any window of an item."""
    clash = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(c).alias(n) for c, n in clash.items()])
    ids = {"id_col": clash[params.pop("id_col", "doc_id")], "text_col": clash[params.pop("text_col", "text")]}
    return (phrase_hits(named, benchmark, **ids, **params).where("n_hit = 0")
            .select(*[F.col(n).alias(c) for c, n in clash.items()]))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, *, span: int = 20, terms: int = 3,
                      id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """(item_id, doc, pos): places of an item's rarest word that has its other rarest words at most ``span`` away.

    An item takes the ``terms`` rarest of its distinct words that documents have (all, if they are fewer; none: no match);
    ``doc`` is the hash of id and text. Positions meet through buckets of
    ``span``, so the range test is an equi-join with two neighbours.
    """
    items = _items(benchmark, item_id_col, item_text_col)
    vocabulary = materialise(items.select(F.explode("q").alias("term")).distinct(), "benchmark-terms")
    frequencies = materialise(_frequencies(docs, vocabulary, id_col, text_col), "frequencies")
    # words that no document has can't be near anything: an item goes by its others
    rare = (items.select("item", "item_id", F.explode(F.array_distinct("q")).alias("term"))
            .join(frequencies, "term")
            .groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("words"))
            .select("item", "item_id", F.slice("words.term", 1, terms).alias("rare")))
    rare = materialise(rare, "rare-terms")
    index = build_index(docs, rare.select(F.explode("rare").alias("term")).distinct(),
                        id_col=id_col, text_col=text_col)
    centre = (index.join(broadcast_if_small(rare, SMALL_ROWS).withColumn("term", F.col("rare")[0]), "term")
              .select("item", "item_id", "rare", "doc", F.col("pos").alias("centre")))
    near = index.select("term", "doc", "pos", F.floor(F.col("pos") / span).alias("bucket"))
    for k in range(1, terms):
        other = F.get("rare", F.lit(k))
        sought = (centre.where(other.isNotNull())
                  .withColumns({"term": other, "bucket": F.explode(F.sequence(
                      F.floor(F.col("centre") / span) - 1, F.floor(F.col("centre") / span) + 1))}))
        met = (sought.join(near, ["term", "doc", "bucket"]).where(F.abs(F.col("pos") - F.col("centre")) <= span)
               .select(*centre.columns).distinct())
        centre = met.union(centre.where(other.isNull()))
    return centre.select("item_id", "doc", F.col("centre").alias("pos")).distinct()
