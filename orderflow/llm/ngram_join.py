"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

Words are runs of anything but ASCII white space, A-Z lower-cased; a
document's set holds its distinct runs of ``SHINGLE_WORDS`` words, or its whole
sequence if it has fewer. 1 - similarity is a metric, and r = 1 - percent / 100
is the radius of the join.

1. Equal sets are one node (told apart by 128 bits of digest; a shingle is 64
   bits of hash).
2. Pivots: min-hash values that ``DENSE`` nodes or more share name a pivot, the
   least of those nodes. A node belongs to the Voronoi region of the pivot that
   agrees with it in most min-hashes, its nearest by estimate; a node without a
   pivot is a region of its own. Dense groups become a few regions.
3. Boundary nodes are replicated: a node goes as a guest to every region of a
   smaller label with a member that it may link to. Sets within r share a
   shingle among their first n - ceil(n percent / 100) + 1, whatever one order
   all sets are kept in (here by hash, with the shingles that most documents
   have last), and sizes differ by at most the factor percent / 100. Guests of
   a region of one node are dropped if a contraction of the metric, the
   similarity of their counts of shingles in classes of hashes, is too low already.
4. Regions are joined exactly: within a task two far members become pivots, the
   distances to both and the triangle inequality deal the others into two
   halves, with those whose distances differ by 2 r at most in both, and the
   halves are joined likewise until they are small or no longer shrink. Only the
   edges of a spanning forest leave a task. A region of more than ``MAX_REGION``
   nodes is dealt into chunks and each pair of chunks joined as a region.
5. ``graph.components`` gives the components.

Texts are read three times (profiles, prefixes, sets of nodes in regions that
have anything to join) and not moved. What is broadcast is bounded: at most
``HOT_ROWS`` frequent shingles (the threshold rises until they are as few) and
``SMALL_ROWS`` rows of a counted list; beyond that a list is a shuffle join.

Defined cases: a text without words (or null) has an empty set, size 0, is
linked with nothing and its own component; rows with a null doc_id get the
component of the documents they link to, null if there is none; a doc_id with
several texts belongs to each one's component, row by row; repeated rows each
get their result; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import LOWER, UPPER, broadcast_if_small, kept_by_worker, materialise
from orderflow.llm.graph import components

SHINGLE_WORDS, PERCENT = 3, 90
#: Min-hashes of a node, nodes that make a shared one name a pivot, min-hashes that must agree with the pivot.
HASHES, DENSE, AGREE = 8, 8, 3
#: Documents that make a shingle a frequent one, at least; most frequent shingles; most rows of other lists sent to all tasks.
HOT_DOCS, HOT_ROWS, SMALL_ROWS = 64, 1_000_000, 2_000_000
#: Nodes that a region may hold before it is joined in chunks; nodes compared without further pivots.
MAX_REGION, LEAF = 2048, 48
#: Shingles to a class, on average, in the counts that are compared before sets; classes at least.
CLASS_SIZE, CLASSES = 16, 32

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().translate(_LOWER).split() if text else []  # bytes split at ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(shingle_words, len(words))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i:len(h) - k + 1 + i]) * _ODD[i % 8]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _over_sets(read: Callable[[np.ndarray], tuple], names: list[str], keys: list[str], shingle_words: int) -> Callable:
    """A mapInPandas function: the key columns and what ``read`` makes of each row's set, for rows with one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker("nothing", lambda: None)  # make room
        for pdf in batches:
            rows = []
            for i, text in enumerate(pdf["text"]):
                found = shingle_set(text, shingle_words)
                if len(found):
                    rows.append((i, *read(found)))
            out = pd.DataFrame(rows, columns=["at", *names])
            taken = pdf[keys].iloc[out["at"].to_numpy(np.int64)].reset_index(drop=True)
            yield pd.concat([taken, out[names]], axis=1)

    return run


def _profile(found: np.ndarray) -> tuple:
    a, b = (xxhash.xxh3_64_intdigest(found.tobytes(), seed) for seed in (1, 2))
    bits = max(CLASSES, len(found) // CLASS_SIZE).bit_length() - 1
    classes = np.minimum(np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255)
    mins = [int((found * odd).min().view(np.int64)) for odd in _ODD[:HASHES]]
    window = found[:len(found) // 8 + 1].view(np.int64)
    return (np.uint64(a).view(np.int64), np.uint64(b).view(np.int64), len(found), mins, classes.astype(np.uint8).tobytes(), window)


def _nodes(profiles: DataFrame) -> DataFrame:
    """(id, a, b, row, n, mins, classes, first): the distinct sets; row: the key of one row that has it."""
    same = profiles.groupBy("a", "b").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), F.min("n").alias("n"),
                                          F.min("mins").alias("mins"), F.min("classes").alias("classes"))
    return materialise(materialise(same, "sets").withColumn("id", F.monotonically_increasing_id()), "nodes")


def _homes(nodes: DataFrame) -> DataFrame:
    """(id, row, n, home, crowd): the region that each node belongs to, named by its pivot or by itself; crowd: its nodes, if many."""
    hashes = nodes.select("id", F.posexplode("mins").alias("k", "value"))
    pivots = hashes.groupBy("k", "value").agg(F.min("id").alias("pivot"), F.count("*").alias("nodes")).where(F.col("nodes") >= DENSE)
    near = (hashes.join(pivots, ["k", "value"]).groupBy("id", "pivot").agg(F.count("*").alias("agree"))
            .where(F.col("agree") >= AGREE))
    best = near.groupBy("id").agg(F.max_by("pivot", F.struct("agree", -F.col("pivot"))).alias("pivot"))
    homes = materialise(nodes.select("id", "row", "n").join(best, "id", "left")
                        .select("id", "row", "n", F.coalesce("pivot", "id").alias("home")), "homes")
    crowds = materialise(homes.groupBy("home").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 1), "crowds")
    return materialise(homes.join(broadcast_if_small(crowds, SMALL_ROWS), "home", "left")
                       .select("id", "row", "n", "home", "crowd"), "homes")


def _frequent(profiles: DataFrame) -> np.ndarray:
    """The shingles among the first eighth of their sets in most rows: at most HOT_ROWS, in HOT_DOCS rows each at least."""
    counts = materialise(profiles.select(F.explode("window").alias("s")).groupBy("s").agg(F.count("*").alias("rows"))
                         .where(F.col("rows") > HOT_DOCS), "frequent")
    least = HOT_DOCS
    while counts.where(F.col("rows") > least).count() > HOT_ROWS:
        least *= 2
    return np.sort(np.array([r.s for r in counts.where(F.col("rows") > least).toLocalIterator()], np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, homes: DataFrame, frequent: np.ndarray, percent: int, shingle_words: int) -> DataFrame:
    """(s, id, home, n, crowd): the first shingles of every node, frequent ones last in the order."""

    def read(found: np.ndarray) -> tuple:
        k = prefix_length(len(found), percent)
        if len(frequent):
            hot = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
            found = np.concatenate([found[~hot][:k], found[hot]])
        return (found[:k].view(np.int64),)

    kept = docs.mapInPandas(_over_sets(read, ["prefix"], ["row"], shingle_words), "row long, prefix array<long>")
    kept = materialise(kept.join(homes, "row").select("id", "home", "n", "crowd", "prefix"), "prefixes")
    return kept.select(F.explode("prefix").alias("s"), "id", "home", "n", "crowd")


def _guests(prefixes: DataFrame, percent: int) -> DataFrame:
    """(id, home, crowd): nodes to be replicated to a region of a smaller name than their own."""
    of_region = (prefixes.where("crowd IS NOT NULL").groupBy("s", "home", "crowd").agg(F.min("n"), F.max("n"))
                 .union(prefixes.where("crowd IS NULL").select("s", "home", "crowd", "n", "n"))
                 .toDF("s", "home", "crowd", "least", "most"))
    met = (prefixes.alias("x").join(of_region.alias("r"), "s")
           .where("r.home < x.home").where((F.col("x.n") * 100 >= F.col("least") * percent)
                                           & (F.col("x.n") * percent <= F.col("most") * 100))
           .select("x.id", F.col("r.home").alias("home"), F.col("r.crowd").alias("crowd")).distinct())
    return materialise(met, "guests")


def _folded(classes: bytes, size: int) -> np.ndarray:
    """Counts of ``size`` classes from those of as many or more; each class halves in two."""
    counts = np.frombuffer(classes, np.uint8).astype(np.int64)
    return counts.reshape(size, -1).sum(1)


def _shared_at_most(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if b"\xff" in a or b"\xff" in b:  # counts stop at 255
        return 2 ** 62
    return int(np.minimum(_folded(a, size), _folded(b, size)).sum())


def _may_link(percent: int) -> Callable:
    @F.pandas_udf("boolean")
    def run(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        shared = np.minimum([_shared_at_most(a, b) for a, b in zip(x, y)], np.minimum(n, m).to_numpy())
        return pd.Series(100 * shared >= percent * (n.to_numpy() + m.to_numpy() - shared))
    return run


class _Sets:
    """Some sets side by side, compared by shared shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sizes = np.array([len(s) for s in sets])
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.own = np.split(numbers, np.cumsum(self.sizes)[:-1])
        self.flag = np.zeros(len(numbers), np.int64)
        self.percent = percent

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        self.flag[self.own[i]] = 1
        flat = self.flag[np.concatenate([self.own[j] for j in others])]
        out = np.add.reduceat(flat, np.r_[0, np.cumsum(self.sizes[others])[:-1]])
        self.flag[self.own[i]] = 0
        return out

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        shared = self.shared(i, others)
        return 1 - shared / (self.sizes[i] + self.sizes[others] - shared)

    def links(self, i: int, others: np.ndarray) -> np.ndarray:
        n, m = self.sizes[i], self.sizes[others]
        others = others[(100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))]
        if not len(others):
            return others
        shared = self.shared(i, others)
        return others[100 * shared >= self.percent * (n + self.sizes[others] - shared)]

    def join(self, rows: np.ndarray, guest: np.ndarray, found: Callable[[int, int], None]) -> None:
        """Report links among ``rows`` (places); pairs of guests are joined elsewhere."""
        if len(rows) > LEAF:
            radius = 1 - self.percent / 100 + 1e-9
            first = self.distances(rows[0], rows)
            second = self.distances(rows[np.argmax(first)], rows)
            near, far = rows[first - second <= 2 * radius], rows[second - first <= 2 * radius]
            if len(near) + len(far) <= 1.25 * len(rows) and max(len(near), len(far)) < len(rows):
                self.join(near, guest, found)
                self.join(far, guest, found)
                return
        for k, i in enumerate(rows[:-1]):
            others = rows[k + 1:]
            for j in self.links(i, others[~guest[others]] if guest[i] else others):
                found(i, j)


def _edges_of(rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Edges that span the links between the rows of one region."""
    rows = rows.drop_duplicates("id")
    if len(rows) < 2:
        return
    ids, guest = rows["id"].to_numpy(np.int64), rows["guest"].to_numpy(bool)
    root = np.arange(len(ids))
    edges = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def found(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((int(ids[i]), int(ids[j])))

    sets = _Sets([np.frombuffer(s, np.uint64) for s in rows["shingles"]], percent)
    sets.join(np.arange(len(ids)), guest, found)
    yield from edges


def _join_regions(percent: int) -> Callable:
    """A mapInPandas function over rows sorted by region and part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            region, part = rows["region"].to_numpy(), rows["part"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (part[1:] != part[:-1])][:len(rows)])
            if not len(starts):
                continue
            rest = rows.iloc[starts[-1]:]  # its region may go on
            edges = [e for a, b in zip(starts, starts[1:]) for e in _edges_of(rows.iloc[a:b], percent)]
            yield pd.DataFrame(edges, columns=["u", "v"], dtype="int64")
        if rest is not None:
            yield pd.DataFrame(list(_edges_of(rest, percent)), columns=["u", "v"], dtype="int64")

    return run


def _edges(docs: DataFrame, profiles: DataFrame, nodes: DataFrame, percent: int, shingle_words: int, max_region: int) -> DataFrame:
    """(u, v): edges between node ids that span all links."""
    homes = _homes(nodes)
    guests = _guests(_prefixes(docs, homes, _frequent(profiles), percent, shingle_words), percent)
    # a region of one node: the guest is compared by counts first
    sizes = nodes.select("id", "n", "classes")
    sole = (homes.where("crowd IS NULL").select("id", "home").join(sizes, "id")  # not always the pivot itself
            .select("home", F.col("n").alias("m"), F.col("classes").alias("others")))
    alone = (guests.where("crowd IS NULL").join(sizes, "id").join(sole, "home")
             .where(_may_link(percent)("n", "m", "classes", "others")).select("id", "home"))
    visits = materialise(alone.union(guests.where("crowd IS NOT NULL").select("id", "home")), "visits")
    hosts = homes.join(visits.select("home").distinct(), "home", "left_semi").where("crowd IS NULL")
    rows = materialise(visits.select(F.col("home").alias("region"), "id", F.lit(True).alias("guest"))
                       .union(homes.where("crowd IS NOT NULL").select("home", "id", F.lit(False)))
                       .union(hosts.select("home", "id", F.lit(False))), "regions")
    needed = materialise(homes.join(rows.select("id").distinct(), "id", "left_semi").select("row", "id"), "needed")
    read = docs.join(broadcast_if_small(needed, SMALL_ROWS), "row")
    sets = read.mapInPandas(_over_sets(lambda found: (found.tobytes(),), ["shingles"], ["id"], shingle_words),
                            "id long, shingles binary")
    sets = materialise(sets.dropDuplicates(["id"]), "shingle-sets")
    large = materialise(rows.groupBy("region").count().where(F.col("count") > max_region)
                        .select("region", F.ceil(F.col("count") * 2 / max_region).cast("int").alias("chunks")), "large-regions")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda k: F.least(k, chunk) * F.col("chunks") + F.greatest(k, chunk))
    dealt = (rows.join(broadcast_if_small(large, SMALL_ROWS), "region", "left")
             .select("region", "id", "guest", F.explode(F.coalesce(parts, F.array(F.lit(0)))).alias("part")))
    parts_n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.join(sets, "id").repartition(parts_n, "region", "part").sortWithinPartitions("region", "part")
            .mapInPandas(_join_regions(percent), "u long, v long"))


def near_components(docs: DataFrame, *, percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS,
                    max_region: int = MAX_REGION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id: the smallest doc_id reachable over links."""
    if not 50 <= percent < 100 or not 1 <= shingle_words <= 8:
        raise ValueError("percent must be 50 to 99, shingle_words 1 to 8")
    # ids pass pandas as text: a column with nulls would become floating point
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(id_col, text_col).alias("row"))
    profiles = materialise(rows.mapInPandas(
        _over_sets(_profile, ["a", "b", "n", "mins", "classes", "window"], ["doc_id", "row"], shingle_words),
        "doc_id string, row long, a long, b long, n long, mins array<long>, classes binary, window array<long>")
        .withColumn("doc_id", F.col("doc_id").cast("long")), "profiles")
    nodes = _nodes(profiles)
    labels = components(_edges(rows.select("row", "text"), profiles, nodes, percent, shingle_words, max_region))
    labelled = (nodes.select("id", "a", "b", "first").join(labels, F.col("id") == F.col("node"), "left")
                .select("a", "b", "first", F.coalesce("label", "id").alias("label")))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_set = labelled.join(least, "label").select("a", "b", "component_id")
    linked = profiles.select("doc_id", F.col("n").alias("n_shingles"), "a", "b").join(of_set, ["a", "b"]).drop("a", "b")
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    own = F.col("doc_id").cast("long")
    alone = rows.where(blank).select(own, F.lit(0).cast("long"), own)
    return linked.select("doc_id", "n_shingles", "component_id").union(alone)
