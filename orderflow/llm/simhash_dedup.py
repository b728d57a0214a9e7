"""Near-duplicate detection by 64-bit SimHash and bit-sliced comparison.

A document's shingles are runs of ``shingle_words`` words (ASCII white space
apart, A-Z lower-cased, repeats included); a fingerprint bit is set if more
than half of the shingles' XXH64 values (seed 42) have it.  Fingerprints link
at ``radius`` or fewer differing bits; components are what links reach.

Equal fingerprints are one node.  The 64 bits are cut into radius + 2 blocks:
fingerprints within the radius agree on two of them at least, so every pair
of blocks gives a table of buckets, and all links lie within buckets.  A
bucket's comparisons are bit-sliced: the XORed pairs are stored as vertical
bit planes, 64 pairs a word, carry-save counters add plane after plane to
all distances at once, and blocks of pairs are abandoned as soon as every
distance in them is over the radius.  A bucket gives the edges of a spanning
forest of its links, never all its pairs; nothing but edges leaves a task.

A bucket of more than ``max_bucket`` fingerprints is cut into chunks by hash
and each pair of chunks is compared as a bucket of its own, so none is
dropped and no task holds more than two chunks.

Defined cases: a text without words (or null) has fingerprint zero and links
like any other; rows with a null doc_id get the component of the documents
they link to, null if there is none, and always stay in
``keep_one_per_component``; a doc_id with several texts belongs to each of
their components and stays wherever it is the smallest; rows equal in doc_id
and text are one; an empty table gives an empty result; extra columns are
kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import LOWER, UPPER, broadcast_if_small, kept_by_worker, materialise
from orderflow.llm.graph import components

SEED = 42
SHINGLE_WORDS, RADIUS = 4, 4
#: Fingerprints that a bucket may hold before it is compared in chunks.
MAX_BUCKET = 4096
#: Pairs whose bit planes a task holds at once, shingles whose bits it unpacks at once, pairs to a block.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE, BLOCK_PAIRS = 1 << 18, 1 << 16, 1 << 12
#: Rows of the hot-bucket table, and (id, text hash) pairs (16 bytes) of the rows that go, up to which they are broadcast.
SMALL_ROWS, MANY_ROWS = 100_000, 1_000_000

_QUARTERS = [(h, np.uint64((2 ** 64 - 1) // (2 ** h + 1))) for h in (32, 16, 8, 4, 2, 1)]
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    words = text.encode().translate(_LOWER).split()  # bytes split at ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[shingle_words:])], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The majority bits as a signed 64-bit integer."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[lo:lo + SHINGLES_AT_ONCE]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long; if ``keyed`` also text_key, XXH64 of the text."""
    more = ["text_key"] if keyed else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker("nothing", lambda: None)  # make room
        for pdf in batches:
            fps = [simhash(shingle_hashes(t, shingle_words)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": np.array(fps, np.int64),
                                **{c: pdf[c] for c in more}})

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"),
                        *[F.xxhash64(text_col).alias(c) for c in more])
            .mapInPandas(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more))))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """The bits of 64-bit values (a multiple of 64 of them) as 64 rows; bit i of word w is value 64 w + i's.

    Transposes blocks of 64 by 64 bits by swapping ever smaller quarters.
    """
    x = values.reshape(-1, 64).copy()
    for half, mask in _QUARTERS:
        y = x.reshape(len(x), -1, 2, half)
        upper, lower = y[:, :, 0], y[:, :, 1]
        swap = ((upper >> np.uint64(half)) ^ lower) & mask
        lower ^= swap
        upper ^= swap << np.uint64(half)
    return np.ascontiguousarray(x.T)


def within_radius(diffs: np.ndarray, radius: int) -> np.ndarray:
    """Indices of the XORed pairs with ``radius`` or fewer bits set (radius below 7)."""
    n = len(diffs)
    pad = -n % BLOCK_PAIRS
    planes = bit_planes(np.concatenate([diffs, np.full(pad, 2 ** 64 - 1, np.uint64)]))
    planes = planes.reshape(64, -1, BLOCK_PAIRS // 64)
    alive = np.arange(planes.shape[1])
    ones, twos, fours, over = (np.zeros(planes.shape[1:], np.uint64) for _ in range(4))
    limit = radius + 1  # a distance of at least this is over
    for k in range(0, 64, 2):
        a, b = planes[k][alive], planes[k + 1][alive]
        # carry-save: ones + a + b = new ones + 2 * carry
        half = ones ^ a
        carry = (ones & a) | (half & b)
        ones = half ^ b
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        over |= carry
        if k % 8 == 6 or k == 62:
            at_least = {1: ones | twos | fours, 2: twos | fours, 3: fours | (twos & ones), 4: fours,
                        5: fours & (twos | ones), 6: fours & twos, 7: fours & twos & ones}[limit]
            over |= at_least
            left = (~over).any(axis=1)
            if not left.all():
                alive, ones, twos, fours, over = (x[left] for x in (alive, ones, twos, fours, over))
            if not len(alive):
                return np.zeros(0, np.int64)
    found = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
    block, place = np.nonzero(found)
    index = alive[block] * BLOCK_PAIRS + place
    return index[index < n]


def _pairs_of(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs within consecutive groups of these sizes, some at a time."""
    last = np.repeat(np.cumsum(sizes), sizes)  # end of each row's group
    own = np.arange(len(last))
    partners = last - own - 1
    upto = np.cumsum(partners)
    lo = 0
    while lo < len(own):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
        counts = partners[lo:hi]
        i = np.repeat(own[lo:hi], counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        yield i, i + 1 + np.arange(len(i)) - first
        lo = hi


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _edges_of(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links within consecutive buckets."""
    nodes, at = np.unique(fps, return_inverse=True)
    values = fps.view(np.uint64)
    root = np.arange(len(nodes))
    for i, j in _pairs_of(sizes):
        hit = within_radius(values[i] ^ values[j], radius)
        if len(hit):
            known = np.nonzero(root != np.arange(len(nodes)))[0]
            root = _forest(len(nodes), np.concatenate([known, at[i[hit]]]),
                           np.concatenate([root[known], at[j[hit]]]))
    linked = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[root[linked]]


def _compare(radius: int) -> Callable:
    """A mapInPandas function over rows sorted by bucket and part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            bucket, part = rows["bucket"].to_numpy(), rows["part"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]) \
                if len(rows) else np.zeros(0, np.int64)
            if not len(starts):
                continue
            rest = rows.iloc[starts[-1]:]  # its bucket may go on
            yield from edges(rows["fp"].to_numpy()[:starts[-1]], np.diff(starts))
        if rest is not None:
            yield from edges(rest["fp"].to_numpy(), np.array([len(rest)]))

    def edges(fps: np.ndarray, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
        shared = np.repeat(sizes > 1, sizes)
        if shared.any():
            u, v = _edges_of(np.ascontiguousarray(fps[shared]), sizes[sizes > 1], radius)
            yield pd.DataFrame({"u": u, "v": v})

    return run


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (u, v) between the distinct values of ``fp`` that span all links within the radius."""
    if not 0 < radius < 7:
        raise ValueError("the radius must be 1 to 6")
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    cut = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(edges, edges[1:])]
    width = max(b - a for a, b in zip(edges, edges[1:]))
    keys = [F.lit(t).cast("long") * (1 << 2 * width) + cut[i] * (1 << width) + cut[j]
            for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("bucket"))
    large = materialise(rows.groupBy("bucket").count().where(F.col("count") > max_bucket)
                        .select("bucket", F.ceil(F.col("count") * 2 / max_bucket).cast("int").alias("chunks")),
                        "large-buckets")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda k: F.least(k, chunk) * F.col("chunks") + F.greatest(k, chunk))
    rows = (rows.join(broadcast_if_small(large, SMALL_ROWS), "bucket", "left")
            .select("fp", "bucket", F.explode(F.coalesce(parts, F.array(F.lit(0)))).alias("part")))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part")
            .mapInPandas(_compare(radius), "u long, v long"))


def _labelled(fps: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """The rows of ``fps`` (doc_id, fp, ...) with their component's label (its least fp) and component_id."""
    fps = materialise(fps, "fingerprints")
    labels = components(links(fps, radius, max_bucket))
    firsts = (fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
              .join(labels, F.col("fp") == F.col("node"), "left")
              .select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = firsts.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = firsts.join(least, "label").select("fp", "label", "component_id")
    return fps.join(of_fp, "fp").select(*fps.columns, "label", "component_id")


def near_components(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of the rows of ``fps`` (doc_id, fp)."""
    return _labelled(fps, radius, max_bucket).select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                           shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` without all but one row of each component: of its smallest doc_id, the smallest (fp, text hash)."""
    fps = fingerprints(docs, shingle_words=shingle_words, id_col=id_col, text_col=text_col, keyed=True)
    found = materialise(_labelled(fps, radius, MAX_BUCKET), "components")
    # rows are told apart by id and text hash: one id's texts may belong to several components
    least = found.where("doc_id = component_id")
    repeats = materialise(least.groupBy("label").agg(F.min(F.struct("fp", "text_key")).alias("first"),
                                                     F.count("*").alias("n")).where("n > 1")
                          .select("label", "first"), "repeats")
    again = (least.join(broadcast_if_small(repeats, SMALL_ROWS), "label")
             .withColumn("stays", F.struct("fp", "text_key") == F.col("first")))
    others = materialise(found.where("doc_id <> component_id").select("doc_id", "text_key")
                         .union(again.where("NOT stays").select("doc_id", "text_key"))
                         .distinct().select(F.col("doc_id").alias("__other"), F.col("text_key").alias("__other_key")),
                         "others")
    is_in = lambda rows: ((F.col(id_col) == rows["__other"])
                          & (F.xxhash64(text_col) == rows["__other_key"]))
    others = broadcast_if_small(others, MANY_ROWS)
    kept = docs.join(others, is_in(others), "left_anti")
    if repeats.isEmpty():
        return kept
    same = materialise(again.where("stays").select(F.col("doc_id").alias("__other"),
                                                   F.col("text_key").alias("__other_key")).distinct(), "same")
    same = broadcast_if_small(same, MANY_ROWS)
    return (kept.join(same, is_in(same), "left_anti")
            .union(kept.join(same, is_in(same), "left_semi").dropDuplicates([id_col, text_col])))
