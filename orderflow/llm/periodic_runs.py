"""Periodic runs of words: stretches that repeat with a smallest period.

Words are runs of anything but ASCII white space. A run is a stretch of
consecutive words of smallest period q, at least ``min_periods`` periods and
``min_words`` words long, that no neighbouring word extends keeping the
period. ``collapsed`` is the text without every word that some run contains
after that run's first q words, single-spaced.

Method: an online sparse diagonal DP. On diagonal q a word matches if it
equals the word q places before; a run is a diagonal's stretch of matches. A
word's earlier occurrences lengthen the diagonals they lie on; a diagonal that
is not lengthened ends, and is a run if it was long enough. Word by word,
frequent words would make that quadratic, so diagonals q of [k, 2k), k a power
of two, advance k words at a time: a run there has 3 k matches or more, so it
passes two places divisible by k whose last k words lie on it. Only those
places look up the earlier occurrences (at most k of them) of their last k
words, which is at most one step per word and k. Both ends, each within k
words, are found by halving steps over the shorter blocks' numbers. A stretch
that several diagonals give has the least of them as its smallest period: the
others are its multiples.

Documents of one batch go through the DP together, some hundred thousand words
at a time, numbered so that words of different documents never match; a longer
document goes alone. Nothing is shuffled.

Defined cases: null and blank texts have no words, no runs and an empty
``collapsed``; an empty table gives an empty result; repeated rows each get
their result; own columns stay, but for any named ``runs`` or ``collapsed``,
which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import BLANK_RUN, fresh

MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that go through the DP at once, unless a single document has more.
WORDS_AT_ONCE = 200_000
RESULT = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _blocks(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the 2 k words that end at each place, from those of k words; -1 where they occur once."""
    out = np.full(len(ids), -1, np.int64)
    here = np.flatnonzero(ids >= 0)
    here = here[here >= k]
    here = here[ids[here - k] >= 0]
    if len(here):
        _, number, count = np.unique(ids[here - k] * (ids.max() + 1) + ids[here], return_inverse=True,
                                     return_counts=True)
        again = count[number] > 1
        out[here[again]] = number[again]
    return out


def _steps(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, diagonal) for the places divisible by k whose last k words occur k to 2 k - 1 words before."""
    n = len(ids)
    known = np.flatnonzero(ids >= 0)
    keys = np.sort(ids[known] * n + known)
    at = known[known % k == 0]
    base = ids[at] * n
    lo = np.searchsorted(keys, base + np.maximum(at - 2 * k + 1, 0))
    hi = np.searchsorted(keys, base + at - k, "right")
    hi[at < k] = lo[at < k]
    count = hi - lo
    place, first = np.repeat(at, count), np.repeat(np.cumsum(count) - count, count)
    earlier = keys[np.repeat(lo, count) + np.arange(len(place)) - first] % n
    return place, place - earlier


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS,
              min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence of word numbers, by start, then period.

    ``min_periods`` must be 4 or more: the DP passes every such run's blocks twice.
    """
    if min_periods < 4:
        raise ValueError("runs of fewer than 4 periods may pass no two blocks")
    n = len(words)
    _, number, count = np.unique(words, return_inverse=True, return_counts=True)
    levels = [np.where(count[number] > 1, number, -1)]  # of blocks of 1, 2, 4, ... words
    found, k = [], 1
    while max(min_words, min_periods * k) <= n and (levels[-1] >= 0).any():
        place, lag = _steps(levels[-1], k)
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        new = np.r_[True, (lag[1:] != lag[:-1]) | (place[1:] - place[:-1] != k)] if len(lag) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(lag)][:len(first)] - 1
        q, lo, hi = lag[first], place[first] - k, place[last]  # matches from lo + 1 to hi
        need = np.maximum(min_words, min_periods * q) - q
        may = hi - lo + 2 * (k - 1) >= need
        q, lo, hi, need = q[may], lo[may], hi[may], need[may]
        for level in range(len(levels) - 2, -1, -1):
            s, ids = 1 << level, levels[level]
            here = (lo - q >= 0) & (ids[lo] >= 0) & (ids[lo] == ids[lo - q])
            lo = lo - s * here
            to = np.minimum(hi + s, n - 1)
            here = (hi + s < n) & (ids[to] >= 0) & (ids[to] == ids[to - q])
            hi = hi + s * here
        long = hi - lo >= need
        found.append(np.stack([lo + 1 - q, hi - lo + q, q])[:, long])
        levels.append(_blocks(levels[-1], k))
        k *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _of_texts(docs: list[list[bytes]], min_words: int, min_periods: int) -> Iterator[tuple[list, str]]:
    flat = [w for words in docs for w in words]
    sizes = np.array([len(words) for words in docs])
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    words = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    words += np.repeat(np.arange(len(docs)), sizes) * len(number)  # apart from document to document
    start, length, period = find_runs(words, min_words, min_periods)
    ends = np.cumsum(sizes)
    of = np.searchsorted(ends, start, "right")
    drops = np.zeros(len(flat) + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, start + length, -1)
    dropped = np.cumsum(drops[:-1]) > 0
    first = np.searchsorted(of, np.arange(len(docs) + 1))
    for d, own in enumerate(docs):
        base, rows = ends[d] - sizes[d], slice(first[d], first[d + 1])
        if first[d] < first[d + 1]:
            gone = dropped[base:ends[d]]
            own = [w for w, g in zip(own, gone) if not g]
        runs = [{"start": s, "length": m, "period": q} for s, m, q in
                zip((start[rows] - base).tolist(), length[rows].tolist(), period[rows].tolist())]
        yield runs, b" ".join(own).decode()


def periodic_runs(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS,
                  min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``."""

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, held, n = [], [], 0
            for text in texts:
                words = text.encode().split() if text else []  # bytes split at ASCII white space alone
                if held and n + len(words) > WORDS_AT_ONCE:
                    rows += _of_texts(held, min_words, min_periods)
                    held, n = [], 0
                held.append(words)
                n += len(words)
            rows += _of_texts(held, min_words, min_periods) if held else []
            yield pd.DataFrame({"runs": [r for r, _ in rows], "collapsed": [c for _, c in rows]})

    own, work = [c for c in docs.columns if c not in ("runs", "collapsed")], fresh(docs, "__found")
    return (docs.select(*own, found(text_col).alias(work))
            .select(*own, F.col(work)["runs"].alias("runs"), F.col(work)["collapsed"].alias("collapsed")))


def with_cycles(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where the texts of a tenth of the ids repeat some of their words up to their end.

    With h the crc32 of the id in decimal, g = h div 10 and n words: where 10 divides h and n > 0, words from
    a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words that begin there. A null id or text is left as it is.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def cycled(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        cycle = F.slice(words, a + 1, p)
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise("")

    words = F.array_remove(F.split(F.col(text_col), BLANK_RUN, -1), "")
    # the one-element array binds the split words once, for all uses within the lambda
    made = F.transform(F.array(words), cycled)[0]
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), made)
                           .otherwise(F.col(text_col)))
