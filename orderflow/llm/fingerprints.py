"""Document fingerprints: 128-bit SimHash with an exact search within a Hamming radius.

A text's terms are its pairs of neighbouring words (A-Z lower-cased; a single
word is its own term). Every distinct term votes with weight 1 + ln(number of
occurrences) for the bits of its hash that are set and against the others;
the signs of the sums are the fingerprint. The likeness of two fingerprints
is the share of bits they agree on, about 0.5 for unrelated texts.

``within_radius`` finds all stored fingerprints at ``radius`` or fewer
differing bits. The bits are cut into blocks, each of which may differ in at
most 0 or 1 bits; these add up so that a pair within the radius keeps to them
in one block at least. A stored fingerprint has a row per block (4 at radius
6), and a query looks each block up as it is and with every bit flipped that
may differ. They meet by equal keys, the distance is checked within the join,
and a pair found in several blocks is kept in the first one. No radius is
approximate, and no bucket is capped.

``edited`` makes for each document the text whose last third is replaced by
the beginning of the next document (descending doc_id, the first after the
last). Documents are dealt into ranges of doc_id, compressed on the way; the
last document of each range is sent to the neighbouring range too, so that
neighbours meet without a global order in one task.

Defined cases: a text without words (or null, taken as empty) has fingerprint
zero; rows with a null doc_id come last; repeated doc_ids are ordered by the
md5 of their text; an only document is its own next one; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import LOWER, UPPER, kept_by_worker

BITS, RADIUS = 128, 6
#: Word hashes that a Python worker keeps (speed only); terms whose bits are unpacked at once.
CACHE_WORDS, TERMS_AT_ONCE = 700_000, 1 << 14

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
# odd 64-bit constants to mix word hashes with
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _scramble(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[k]
    return h ^ (h >> np.uint64(29))


def fingerprint(text: str) -> bytes:
    """16 bytes."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return bytes(BITS // 8)
    hashes = kept_by_worker("word hashes", _WordHashes)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    terms = h if len(h) == 1 else h[:-1] * _MIX[0] + h[1:] * _MIX[1]
    terms, counts = np.unique(terms, return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS)
    for lo in range(0, len(terms), TERMS_AT_ONCE):
        part = terms[lo:lo + TERMS_AT_ONCE]
        both = np.stack([_scramble(part, 2), _scramble(part ^ _MIX[3], 3)], axis=1)
        bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
        votes += weights[lo:lo + TERMS_AT_ONCE] @ bits
    return np.packbits(2 * votes > weights.sum(dtype=np.float64), bitorder="little").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() / BITS


# ---- documents and their edited texts


def _sender(bounds: np.ndarray, last: int | None) -> Callable:
    """A mapInPandas function: fingerprints texts and sends them, compressed, to their range and as peeks to others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64")
            known = ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
            # range k holds the ids over bounds[k - 1], up to bounds[k]; null ids are in range 0
            home = np.searchsorted(bounds, known, "left")
            data = [t.encode() for t in pdf["text"]]
            rows = pd.DataFrame({"range": home, "peek": 0, "doc_id": ids, "tie": [hashlib.md5(d).digest() for d in data],
                                 "fp": [fingerprint(t) for t in pdf["text"]], "packed": [pack(d) for d in data]})
            yield rows
            # the greatest id of a range is the next one below the range above; the greatest of all follows the least
            at = rows[(home < len(bounds)) & (known == bounds[np.minimum(home, len(bounds) - 1)])
                      & ids.notna().to_numpy()] if len(bounds) else rows[:0]
            yield at.assign(range=at["range"] + 1, peek=1)
            top = rows[(ids == last).fillna(False).to_numpy(bool)] if last is not None else rows
            yield top.assign(range=0, peek=2)

    return run


def _editor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of range, peek and descending doc_id: each meets the row after it."""
    unpack = zstandard.ZstdDecompressor().decompress
    before = None
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if before is not None and before[0].peek == 0 and before[0].range == row.range:
                out.append(_edited(*before, row, text := unpack(row.packed).decode()))
            else:
                text = unpack(row.packed).decode() if row.peek == 0 else ""
            before = row, text
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited",
                                         "near_next"]).astype({"doc_id": "Int64"})


def _edited(row, text: str, after, after_text: str) -> tuple:
    third = len(text) // 3
    new = text[:len(text) - third] + after_text[:third]
    fp = fingerprint(new)
    return (row.doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), row.fp, fp,
            likeness(row.fp, fp), likeness(row.fp, after.fp))


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # bounds are ids that occur, so each range but the last ends with a document
    parts = [F.lit(k / n) for k in range(1, n)] or [F.lit(0.5)]
    ends = rows.agg(F.percentile_approx("doc_id", F.array(*parts), F.lit(20 * n)).alias("b"),
                    F.max("doc_id").alias("last")).first()
    bounds = np.unique(np.array([b for b in ends["b"] or [] if b < ends["last"]], np.int64))
    sent = rows.mapInPandas(_sender(bounds, ends["last"]),
                            "range int, peek int, doc_id long, tie binary, fp binary, packed binary")
    return (sent.repartitionById(len(bounds) + 1, F.col("range"))
            .sortWithinPartitions("range", "peek", F.col("doc_id").desc_nulls_last(), "tie")
            .mapInPandas(_editor, "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, "
                                  "near_edited double, near_next double"))


# ---- search within a radius


def words_of(fp: Column) -> list[Column]:
    """A 16-byte fingerprint as two longs."""
    return [F.conv(F.hex(F.substring(fp, 8 * k + 1, 8)), 16, -10).cast("long") for k in (0, 1)]


def _blocks(radius: int) -> list[tuple[int, int, int]]:
    """(lo, hi, may): bits lo to hi, of which ``may`` (0 or 1) may differ; blocks that no search needs are left out.

    A pair that differs in over ``may`` bits of every block differs in the sum of may + 1, radius + 1, at least.
    """
    n = max(3, radius // 2 + 1)  # no more than 43 bits each, and may + 1 is 2 at most
    parts = [(radius + 1) * k // n for k in range(n + 1)]
    return [(BITS * k // n, BITS * (k + 1) // n, parts[k + 1] - parts[k] - 1) for k in range(n) if parts[k + 1] > parts[k]]


def _cut(a: Column, b: Column, lo: int, hi: int) -> Column:
    """Bits lo to hi of the 128 bits (a, b), counted from a's lowest."""
    part = lambda c, x, y: F.shiftrightunsigned(c, x).bitwiseAND(F.lit((1 << (y - x)) - 1))
    if hi <= 64:
        return part(a, lo, hi)
    if lo >= 64:
        return part(b, lo - 64, hi - 64)
    return part(a, lo, 64) + part(b, 0, hi - 64) * (1 << (64 - lo))


def block_tables(fps: DataFrame, radius: int = RADIUS, *, flips: bool = False) -> DataFrame:
    """Rows (a, b, ...) once per block, with its number ``block`` and its bits ``key``; with ``flips``, once more for
    each bit that may differ, flipped."""
    blocks = _blocks(radius)
    keys = F.array(*[_cut(F.col("a"), F.col("b"), lo, hi) for lo, hi, _ in blocks])
    at = [F.struct(F.lit(k).alias("block"), F.lit(flip).cast("long").alias("flip"))
          for k, (lo, hi, may) in enumerate(blocks)
          for flip in [0] + [1 << bit for bit in range(hi - lo) if flips and may]]
    return (fps.withColumn("t", F.explode(F.array(*at)))
            .select("*", "t.block", keys[F.col("t.block")].bitwiseXOR(F.col("t.flip")).alias("key")).drop("t"))


def within_radius(queries: DataFrame, stored: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, qa, qb, bits): each pair of a stored (a, b) and a query (a, b) at ``radius`` or fewer bits.

    Both sides are made distinct; equal fingerprints are found too, with 0 bits.
    """
    q = block_tables(queries.select("a", "b").distinct(), radius, flips=True) \
        .select(F.col("a").alias("qa"), F.col("b").alias("qb"), "block", "key")
    s = block_tables(stored.select("a", "b").distinct(), radius)
    xa, xb = F.col("a").bitwiseXOR(F.col("qa")), F.col("b").bitwiseXOR(F.col("qb"))
    bits = F.bit_count(xa) + F.bit_count(xb)
    first = F.coalesce(*[F.when(F.bit_count(_cut(xa, xb, lo, hi)) <= may, k)
                         for k, (lo, hi, may) in enumerate(_blocks(radius))])
    # size estimates leave out what explode adds, so that a side of many times the broadcast threshold would be broadcast
    return (s.alias("s").join(q.hint("merge").alias("q"), (F.col("s.block") == F.col("q.block"))
                              & (F.col("s.key") == F.col("q.key")) & (bits <= radius) & (first == F.col("q.block")))
            .select("a", "b", "qa", "qb", bits.alias("bits")))
