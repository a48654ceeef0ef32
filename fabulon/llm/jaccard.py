"""Operator 8: n-gram Jaccard join by count vectors in R-trees.

Texts become sets of hashed word shingles. Hashes fall into groups, and the counts of a set's
groups are a point. Two sets share at most the sum over the groups of the smaller counts, and a
node of an R-tree bounds that for all its points by their coordinate maxima; pairs whose bound
reaches the overlap that the similarity needs are verified on the whole sets.

The number of groups follows the size of a set, so that unlike sets of any size stay far below
that overlap. It is a power of two, and a point folds into one of half as many groups by adding
its halves; the sizes of similar sets are at most a third apart, so their numbers of groups are
equal or neighbours, and each tree is searched with the points of its own and the next number.

In one tree over all sets the bound of a node prunes little, as the space has many dimensions and
inner nodes are wide. So the points are first dealt out: two sets that are similar enough share one
of the first hashes of each in a global order (rarer hashes first), so each such hash has a tree of
its own over the sets that hold it. Equal trees are built once. Trees work three times: first each
set finds one partner, the pairs are verified, and sets that are thereby connected count as one class.
Trees that still hold several classes then find, for every two classes, the best partner in the
larger one for each set of the smaller one. Those that hold several even after that are joined in
full across classes. No pair of a class need be looked at again, so large groups of copies cost what
their members cost.

How rare a hash is, is read off a table of COUNTERS counters, the same at every size: all hashes
of all texts are counted, those that share a counter together. The order changes the cost only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulon.llm.common import Stretches, checkpointed, groups_of, joined_bytes, mapped, mixed, partitions, slices, small_batches
from fabulon.llm.graph import components

#: Points of a leaf, children of a node.
LEAF = 32
#: Counters of the table of how frequent hashes are, and those of one block of it; 16 bits of each are sent.
COUNTERS, COUNTER_BLOCK = 1 << 22, 1 << 14
#: So many pairs name at most twice as many documents, 16 MB of ids, which are broadcast.
FEW = 1_000_000
#: Bytes of points compared at once.
AT_ONCE = 8 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, one text after another, and len + 1 offsets.

    Words are separated by white space (ASCII); A-Z are lower-cased. A text with fewer words is
    one shingle, one without words an empty set. 62-bit hashes stand for shingles.
    """
    data, offsets = joined_bytes(texts)
    data = _LOWER[data]
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    end = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    # Words with one space after each, so that a shingle is one stretch of bytes.
    keep = word[1:-1].copy()
    keep[end[end < len(data)]] |= _SPACE[data[end[end < len(data)]]]
    place = np.concatenate([[0], np.cumsum(keep)])
    flat = np.where(_SPACE[data], 32, data)[keep].astype(np.uint8)
    hashes = Stretches(flat)
    of = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    out, sizes = [], np.zeros(len(texts), dtype=np.int64)
    last = np.minimum(np.arange(len(start)) + words - 1, (first + count)[of] - 1)
    usable = (np.arange(len(start)) + words <= (first + count)[of]) | (np.arange(len(start)) == first[of])
    all_ = hashes.of(place[start], place[end[last]])
    for i in np.flatnonzero(count).tolist():
        a, z = first[i], first[i] + count[i]
        own = np.sort(all_[a:z][usable[a:z]])
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate([*out, np.zeros(0, dtype=np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def set_ids(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash for each set, equal for equal sets; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    out = mixed(sums[offsets[1:]] - sums[offsets[:-1]] + (offsets[1:] - offsets[:-1]).astype(np.uint64)) | np.uint64(1)
    return np.where(offsets[1:] > offsets[:-1], out, np.uint64(0)).view(np.int64)


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def counter_of(flat: np.ndarray) -> np.ndarray:
    """The counter of each hash."""
    return (flat >> np.uint64(64 - 22)).astype(np.int64)


def frequency(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 16 bits."""
    return np.minimum(np.log2(np.maximum(counts, 1).astype(np.float64)) * 2048, 65535).astype("<u2")


def first_hashes(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray, frequent: np.ndarray, percent: int) -> list[np.ndarray]:
    """For each row the hashes of its set of which a similar set must share one: all but so many as any partner must overlap, less one, in the order of (frequency, hash)."""
    rank = frequent[counter_of(flat)].astype(np.uint64) << np.uint64(48) | flat >> np.uint64(16)
    out = []
    for i in rows.tolist():
        a, z = offsets[i], offsets[i + 1]
        n = z - a
        out.append(flat[a:z][np.argsort(rank[a:z], kind="stable")[: n - -(-percent * n // 100) + 1]])
    return out


def groups(n: np.ndarray) -> np.ndarray:
    """Groups of the point of a set of size n: the power of two from n on, of larger sets from n / 2 on, 16 at least."""
    least = np.maximum(np.minimum(n, 256), n / 2)
    return 1 << np.ceil(np.log2(np.maximum(least, 16))).astype(np.int64)


def points_of(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The counts of each set's hashes by group, one byte each, or four if a count needs them, packed."""
    sizes, out = np.diff(offsets), []
    for a, z, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), groups(sizes).tolist(), strict=True):
        p = np.bincount(((flat[a:z] >> np.uint64(20)) & np.uint64(g - 1)).astype(np.int64), minlength=g)
        out.append(zlib.compress((p.astype(np.uint8) if p.max() < 256 else p.astype(np.int32)).tobytes(), 1))
    return out


def _matrix(raw: list[bytes], g: int) -> np.ndarray:
    if all(len(p) == g for p in raw):
        return np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, g)
    return np.stack([np.frombuffer(p, dtype=np.uint8 if len(p) == g else np.int32) for p in raw]).astype(np.int32)


def folded(points: np.ndarray) -> np.ndarray:
    """Points of half as many groups."""
    half = points.shape[1] // 2
    out = points[:, :half].astype(np.int32) + points[:, half:]
    return out.astype(np.uint8) if out.size and out.max() < 256 else out


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed minima of the rows of a and b, row by row (b may be a single row)."""
    out = np.empty(len(a), dtype=np.int64)
    step = max(1, AT_ONCE // (4 * a.shape[1]))
    for at in range(0, len(a), step):
        out[at : at + step] = np.minimum(a[at : at + step], b if b.ndim == 1 else b[at : at + step]).sum(axis=1, dtype=np.int32)
    return out


class RTree:
    """Points packed into leaves by halving; every node keeps its coordinate maxima, and the least and largest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._tiled(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, least, most = self.points, self.sizes, self.sizes
        while True:
            cuts = np.arange(0, len(top), LEAF)
            top, least, most = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((top, least, most))
            if len(top) == 1:
                break

    @staticmethod
    def _tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows in the order of leaves: halved by size while it varies by a third, then along the widest coordinate."""
        out, todo = [], [np.arange(len(points))]
        while todo:
            r = todo.pop()
            if len(r) <= LEAF:
                out.append(r)
                continue
            s = sizes[r]
            by = s if 3 * int(s.max()) >= 4 * int(s.min()) else points[r][:, int(points[r].var(axis=0).argmax())]
            r = r[np.argsort(by, kind="stable")]
            half = LEAF * max(1, len(r) // LEAF // 2)
            todo += [r[half:], r[:half]]
        return np.concatenate(out)

    def leaves(self, q: np.ndarray, n: np.ndarray, percent: int, done: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that its bound admits and that are not done), from the root down."""
        todo = [(len(self.levels) - 1, 0, np.arange(len(q)))]
        while todo:
            level, node, who = todo.pop()
            who = who[~done[who]]
            top, least, most = (x[node] for x in self.levels[level])
            who = who[(100 * n[who] >= percent * least) & (100 * most >= percent * n[who])]
            if len(who):
                who = who[overlaps(q[who], top) >= need(n[who], np.maximum(least, -(-percent * n[who] // 100)), percent)]
            if len(who) == 0:
                continue
            if level == 0:
                yield node, who
            else:
                below = range(node * LEAF, min((node + 1) * LEAF, len(self.levels[level - 1][0])))
                todo += [(level - 1, c, who) for c in reversed(below)]

    def admitted(self, leaf: int, who: np.ndarray, q: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, bound) for each of the queries and rows of a leaf that the bound of the two admits."""
        rows = np.arange(leaf * LEAF, min((leaf + 1) * LEAF, len(self.points)))
        size, own = self.sizes[rows][None], n[who][:, None]
        x, y = np.nonzero((100 * own >= percent * size) & (100 * size >= percent * own))
        x, y = who[x], rows[y]
        bound = overlaps(q[x], self.points[y]) if len(x) < 2 or len(x) * q.shape[1] <= AT_ONCE else np.concatenate([overlaps(q[x[a : a + 4096]], self.points[y[a : a + 4096]]) for a in range(0, len(x), 4096)])
        ok = bound >= need(n[x], self.sizes[y], percent)
        return x[ok], self.order[y[ok]], bound[ok]


def searches(raw: list[bytes], n: np.ndarray, rank: np.ndarray, classes: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, bound): pairs of different rows whose bound admits them, in parts.

    With classes, all pairs of rows of different classes, each once. Without, for each row that has
    a partner some of them: of the first leaf that has any, in each of its trees, the best one and
    the one of the least rank.
    """
    kind = groups(n)
    bands = {g: np.flatnonzero(kind == g) for g in np.unique(kind).tolist()}
    points = {g: _matrix([raw[i] for i in rows.tolist()], g) for g, rows in bands.items()}
    for g, rows in bands.items():
        tree = RTree(points[g], n[rows])
        for own, above in ((True, g), (False, 2 * g)):
            if above not in bands:
                continue
            who_rows, q = bands[above], points[g] if own else folded(points[above])
            done = np.zeros(len(q), dtype=bool)
            for leaf, who in tree.leaves(q, n[who_rows], percent, done):
                x, y, bound = tree.admitted(leaf, who, q, n[who_rows], percent)
                if classes is None:
                    ok = who_rows[x] != rows[y]
                    x, y, bound = x[ok], y[ok], bound[ok]
                    best = best_partner(x, y, bound)
                    first = best_partner(x, y, -rank[rows[y]])  # the same one for as many as can be, so that they are one class
                    x, y = np.concatenate([best[0], first[0]]), np.concatenate([best[1], first[1]])
                    done[x] = True
                    bound = np.zeros(len(x), dtype=np.int64)
                else:
                    ok = (classes[who_rows[x]] != classes[rows[y]]) & (x < y if own else True)
                    x, y, bound = x[ok], y[ok], bound[ok]
                if len(x):
                    yield who_rows[x], rows[y], bound


def small_trees(raw: list[bytes], n: np.ndarray, start: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As searches, for many trees of at most LEAF points at once: rows start[i] to start[i + 1] are one, all of them a leaf."""
    sizes = np.diff(start)
    x, y = [], []
    for m in np.unique(sizes).tolist():
        i, j = np.triu_indices(m, 1)
        first = start[:-1][sizes == m]
        x.append((first[:, None] + i[None]).ravel())
        y.append((first[:, None] + j[None]).ravel())
    x, y = np.concatenate(x), np.concatenate(y)
    near = (100 * n[x] >= percent * n[y]) & (100 * n[y] >= percent * n[x])
    x, y = x[near], y[near]
    kind, bound = groups(n), np.zeros(len(x), dtype=np.int64)
    low = np.minimum(kind[x], kind[y])
    for g in np.unique(low).tolist():
        rows = np.flatnonzero((kind == g) | (kind == 2 * g))
        at = np.zeros(len(n), dtype=np.int64)
        at[rows] = np.arange(len(rows))
        wide = kind[rows] == 2 * g
        own = np.zeros((len(rows), g), dtype=np.int32)
        if (~wide).any():
            own[~wide] = _matrix([raw[i] for i in rows[~wide].tolist()], g)
        if wide.any():
            own[wide] = folded(_matrix([raw[i] for i in rows[wide].tolist()], 2 * g))
        some = np.flatnonzero(low == g)
        step = max(1, AT_ONCE // (4 * g))
        for a in range(0, len(some), step):
            p = some[a : a + step]
            bound[p] = np.minimum(own[at[x[p]]], own[at[y[p]]]).sum(axis=1)
    ok = bound >= need(n[x], n[y], percent)
    return x[ok], y[ok], bound[ok]


def across(x: np.ndarray, y: np.ndarray, bound: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of rows of different classes the best one for each row of the class with fewer rows and each other class."""
    _, number, size = np.unique(classes, return_inverse=True, return_counts=True)
    a, b = number[x], number[y]
    swap = (size[a] > size[b]) | ((size[a] == size[b]) & (a > b))
    x, y, b = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, a, b)
    at = np.lexsort((y, -bound, b, x))
    x, y, b, bound = x[at], y[at], b[at], bound[at]
    head = np.ones(len(x), dtype=bool)
    head[1:] = (x[1:] != x[:-1]) | (b[1:] != b[:-1])
    return x[head], y[head], bound[head]


def best_partner(x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each x the pair of the highest bound (of equal ones the least y)."""
    at = np.lexsort((y, -bound, x))
    x, y = x[at], y[at]
    head = np.ones(len(x), dtype=bool)
    head[1:] = x[1:] != x[:-1]
    return x[head], y[head]


def links_and_sets(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text", mark_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, set_id, and mark if its column is named) and (links: a, b set ids that are similar enough and enough to connect all such).

    The links connect exactly the sets that a chain of similar pairs connects.
    """
    spark = docs.sparkSession
    width = partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias("mark") for c in (mark_col,) if c])
    mark = ["mark"] * bool(mark_col)

    def measure(batches):
        """A row for each document and, of each task, the blocks of its counters."""
        counters, any_ = np.zeros(COUNTERS, dtype=np.uint32), False
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                flat, offsets = shingle_sets(b.column("text"), words)
                ids = set_ids(flat, offsets)
                np.add.at(counters, counter_of(flat), np.uint32(1))
                any_ = any_ or len(flat) > 0
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(ids), pa.array(np.ones(len(ids), dtype=bool)), pa.array(points_of(flat, offsets), pa.binary()), *[b.column(m) for m in mark]],
                    names=["doc_id", "n", "key", "is_doc", "point", *mark],
                )
        if any_:
            blocks = counters.reshape(-1, COUNTER_BLOCK)
            some = np.flatnonzero(blocks.any(axis=1))
            packed = [zlib.compress(blocks[i].tobytes(), 1) for i in some.tolist()]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(some), none, pa.array(np.zeros(len(some), dtype=bool)), pa.array(packed, pa.binary()), *[none] * len(mark)], names=["doc_id", "n", "key", "is_doc", "point", *mark])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, p in zip(b.column("n").to_pylist(), b.column("point"), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(p.as_py()), dtype=np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([frequency(v).tobytes() for v in sums.values()], pa.binary())], names=["n", "point"])

    measured = checkpointed(source.transform(mapped, measure, "doc_id long, n long, key long, is_doc boolean, point binary" + ", mark long" * bool(mark_col)))
    points = measured.filter("is_doc").groupBy(F.col("key").alias("set_id")).agg(F.min("n").alias("n"), F.min("point").alias("point"))
    rows = measured.filter("is_doc").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("set_id"), *mark)
    # Two bytes for each of COUNTERS counters, whatever the corpus.
    frequent = np.zeros(COUNTERS, dtype="<u2")
    for r in measured.filter("not is_doc").select("n", "point").repartition(width, "n").transform(mapped, added, "n long, point binary").collect():
        frequent[r.n * COUNTER_BLOCK : (r.n + 1) * COUNTER_BLOCK] = np.frombuffer(r.point, dtype="<u2")
    sent = spark.sparkContext.broadcast(frequent)
    del frequent

    def keys(batches):
        seen: set[int] = set()
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                flat, offsets = shingle_sets(b.column("text"), words)
                ids = set_ids(flat, offsets)
                new = np.array([i for i, s in enumerate(ids.tolist()) if s and s not in seen and not seen.add(s)], dtype=np.int64)
                if len(new):
                    heads = first_hashes(flat, offsets, new, sent.value, percent)
                    owners = np.repeat(ids[new], [len(h) for h in heads])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(owners)], names=["key", "set_id"])

    def trees(batches):
        """(tree, set_id) for each hash that several sets hold; a tree is named by a hash of its sets, so equal ones have one name."""
        for t in groups_of(batches, "key"):
            k, s = (t.column(c).to_numpy() for c in ("key", "set_id"))
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            k, s = k[new], s[new]
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(start, len(k)))
            name = mixed(np.add.reduceat(mixed(s.view(np.uint64)), start)).view(np.int64)
            many = np.repeat(sizes > 1, sizes)
            tree, s = np.repeat(name, sizes)[many], s[many]
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(s)], names=["tree", "set_id"])

    dealt = source.transform(mapped, keys, "key long, set_id long").repartition(width, "key").sortWithinPartitions("key", "set_id")
    members = checkpointed(dealt.transform(mapped, trees, "tree long, set_id long").distinct())

    def whole(batches):
        seen: set[int] = set()  # repeated rows meet in one task
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                flat, offsets = shingle_sets(b.column("text"), words)
                ids = set_ids(flat, offsets)
                new = [i not in seen and not seen.add(i) for i in ids.tolist()]
                arrays = [pa.array(ids), pa.array([flat[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["set_id", "hashes"]).filter(pa.array(new, pa.bool_()))

    def searched(batches, round_: int):
        for t in groups_of(batches, "tree"):
            tree, ids, n = (t.column(c).to_numpy() for c in ("tree", "set_id", "n"))
            raw = list(map(zlib.decompress, t.column("point").to_pylist()))
            classes = t.column("class").to_numpy() if round_ else None
            start = np.append(np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])), len(tree))
            sizes = np.diff(start)
            found = []
            small = np.flatnonzero(sizes <= LEAF)
            if len(small):  # their rows side by side, as trees of one leaf each
                at = np.concatenate([np.arange(start[i], start[i + 1]) for i in small.tolist()])
                x, y, bound = small_trees([raw[i] for i in at.tolist()], n[at], np.concatenate([[0], np.cumsum(sizes[small])]), percent)
                x, y = at[x], at[y]
                if round_:
                    apart = classes[x] != classes[y]
                    x, y = x[apart], y[apart]
                else:
                    x, y = best_partner(np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([bound, bound]))
                found.append((ids[x], ids[y], tree[x]))
            for i in np.flatnonzero(sizes > LEAF).tolist():
                a, z = int(start[i]), int(start[i + 1])
                own, parts = classes[a:z] if round_ else None, []
                for part in searches(raw[a:z], n[a:z], np.arange(z - a), own, percent):
                    parts.append(part)
                    if round_ == 1 and sum(len(p[0]) for p in parts) > 1 << 20:
                        parts = [across(*(np.concatenate(p) for p in zip(*parts, strict=True)), own)]
                if round_ == 1 and parts:
                    parts = [across(*(np.concatenate(p) for p in zip(*parts, strict=True)), own)]
                found += [(ids[a + x], ids[a + y], tree[a + x]) for x, y, _ in parts]
            found = np.concatenate([np.stack([np.minimum(x, y), np.maximum(x, y), z]) for x, y, z in found] + [np.zeros((3, 0), dtype=np.int64)], axis=1)
            pairs = np.unique(found, axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, pairs)), names=["a", "b", "tree"])

    def verified(pairs: DataFrame) -> DataFrame:
        def test(batches):
            for b in batches:
                x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
                ok = []
                for p, q in zip(x, y, strict=True):
                    p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    both = int((q[at] == p).sum())
                    ok.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        pairs = checkpointed(pairs.select("a", "b").distinct())
        named = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        one = rows.groupBy("set_id").agg(F.min("doc_id").alias("_id")).join(named, "set_id", "left_semi").select("_id")
        if pairs.count() <= FEW:  # two ids for each pair at most: small enough to send; else texts are dealt by id
            one = F.broadcast(one)
        # Only the sets in some pair are made again, from the text of one document each.
        with small_batches(spark):
            sets = checkpointed(source.join(one, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text").transform(mapped, whole, "set_id long, hashes binary"))
            x = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
            y = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
            return checkpointed(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").transform(mapped, test, "a long, b long"))

    def close(batches):
        """Rows of a tree that have another of a size that allows the similarity."""
        for t in groups_of(batches, "tree"):
            tree, n = t.column("tree").to_numpy(), t.column("n").to_numpy()  # by size in each tree
            next_ = (tree[1:] == tree[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = np.zeros(len(tree), dtype=bool)
            keep[1:] |= next_
            keep[:-1] |= next_
            yield from t.select(["tree", "set_id"]).filter(pa.array(keep)).to_batches()

    # Dealt by a hash of the tree: a repartition by the column itself is left out where rows come from a join by tree,
    # and such a join can become a broadcast at run time, which leaves the rows where they are.
    by_tree = lambda df, *order: df.repartition(width, F.xxhash64("tree")).sortWithinPartitions("tree", *order)
    found = "a long, b long, tree long"
    near = checkpointed(by_tree(members.join(points.select("set_id", "n"), "set_id"), "n", "set_id").transform(mapped, close, "tree long, set_id long"))
    pairs = checkpointed(by_tree(near.join(points, "set_id"), "set_id").transform(mapped, lambda b: searched(b, 0), found))
    links = verified(pairs)
    # A tree in which no set found a partner has none for the later rounds either.
    seats = checkpointed(near.join(pairs.select("tree").distinct(), "tree", "left_semi").join(points, "set_id"))
    for round_ in (1, 2):
        classes = checkpointed(components(links))
        own = seats.join(classes, seats["set_id"] == classes["id"], "left").select("tree", "set_id", "n", "point", F.coalesce("component", "set_id").alias("class"))
        split = own.groupBy("tree").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("tree")
        links = links.unionByName(verified(by_tree(own.join(split, "tree", "left_semi"), "set_id").transform(mapped, lambda b, r=round_: searched(b, r), found)))
    return rows, links


def join_similar(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    component_id is the smallest doc_id that links reach, itself included: documents link when
    100 * intersection >= percent * union of their shingle sets. A null, empty or blank text has
    an empty set and is linked with nothing: its component is its own id. Equal sets (copies,
    repeated rows) link. A null id takes part in links but is never the smallest unless all ids of
    a component are null. Other columns are not read; an empty table gives an empty result.
    """
    rows, links = links_and_sets(docs, percent, words, id_col, text_col)
    classes = components(links)
    full = rows.filter("set_id <> 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = full.join(classes, full["set_id"] == classes["id"], "left").select("set_id", "least", F.coalesce("component", "set_id").alias("class"))
    smallest = named.groupBy("class").agg(F.min("least").alias("component_id"))
    by_set = named.join(smallest, "class").select("set_id", "component_id")
    return rows.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, mark_col: str, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """mark: the value of mark_col, a long that tells rows apart, of one row of each group that links connect.

    It is the row of the smallest doc_id, null last, and of several rows of that id the one with
    the smallest mark. An empty text is linked with nothing: one row of each id stays, and every
    one without an id.
    """
    rows, links = links_and_sets(docs, percent, words, id_col, text_col, mark_col)
    classes = components(links)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    full = rows.filter("set_id <> 0").groupBy("set_id").agg(F.min(order).alias("least"))
    named = full.join(classes, full["set_id"] == classes["id"], "left").select("least", F.coalesce("component", "set_id").alias("class"))
    first = named.groupBy("class").agg(F.min("least").alias("least")).select("least.mark")
    empty = rows.filter("set_id = 0").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("mark")).alias("own")).agg(F.min("mark").alias("mark"))
    return first.unionByName(empty.select("mark"))
