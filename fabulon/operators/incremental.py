"""The incremental resolver: mention groups linked window by window to a growing set of entities."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulon.operators.resolve import K1, B
from fabulon.session import cut

ATTEMPTS = 3
#: Terms, counted as often as they occur, in a block of entities and in one of groups: what a task holds, whatever the table.
BLOCK_TERMS, ASKED_TERMS = 2_000_000, 1_000_000
#: Scores, and products of a group's and an entity's weight of a term, that are in memory at once.
_CELLS = 1 << 20
_SLAB = 256


def _unpacked(packed: bytes) -> tuple[np.ndarray, ...]:
    size = int.from_bytes(packed[:8], "little")
    return pickle.loads(pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True))


def _row(*arrays: np.ndarray) -> pa.RecordBatch:
    raw = pickle.dumps(tuple(arrays), protocol=5)
    packed = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])


def _least(a: np.ndarray) -> np.ndarray:
    """a in the narrowest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def _counted(ids: np.ndarray, terms: np.ndarray, counts: np.ndarray, by_term: bool) -> tuple[np.ndarray, ...]:
    """Different ids and terms in order, and each pair's positions in these and summed count, sorted by term and id or by id and term."""
    own, i = np.unique(ids, return_inverse=True)
    words, t = np.unique(terms, return_inverse=True)
    pairs, at = np.unique(t * len(own) + i if by_term else i * len(words) + t, return_inverse=True)
    i, t = (pairs % len(own), pairs // len(own)) if by_term else (pairs // len(words), pairs % len(words))
    return own, words, i, t, np.bincount(at, counts).astype(np.int64)


def _entity_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of all entities of a task: their ids and lengths, their terms, and for each term the entities that have it and how often."""
    held, waiting, size = None, [], 0

    def merged():
        parts = [*([] if held is None else [held]), *waiting]
        own, words, i, t, n = _counted(*(np.concatenate([p[k] for p in parts]) for k in range(3)), by_term=True)
        return own[i], words[t], n

    for b in batches:
        lists = b.column("terms")
        ids = np.repeat(b.column("entity").to_numpy(), np.diff(lists.offsets.to_numpy()))
        terms = lists.flatten().to_numpy()
        waiting.append((ids, terms, np.ones(len(ids), dtype=np.int64)))
        size += len(ids)
        if size >= BLOCK_TERMS:
            held, waiting, size = merged(), [], 0
    if waiting:
        held = merged()
    if held is not None and len(held[0]):
        own, words, i, t, n = _counted(*held, by_term=True)
        yield _row(own, np.bincount(i, n, minlength=len(own)), words, _least(np.bincount(t, minlength=len(words))), _least(i), _least(n))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many entities of a block have each term."""
    for b in batches:
        for block in b.column("block"):
            _, _, words, df, _, _ = _unpacked(block.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(df.astype(np.int64))], names=["term", "df"])


def _asked_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of all groups of a task: their ids, their terms with weights, and for each group its terms and how often it has them."""
    parts = [tuple(b.column(c).to_numpy() for c in ("query", "term", "idf")) for b in batches if b.num_rows]
    if parts:
        ids, terms, idf = (np.concatenate([p[k] for p in parts]) for k in range(3))
        own, words, i, t, n = _counted(ids, terms, np.ones(len(ids), dtype=np.int64), by_term=False)
        weight = np.zeros(len(words))
        weight[np.searchsorted(words, terms)] = idf
        yield _row(own, words, weight, _least(np.bincount(i, minlength=len(own))), _least(t), _least(n))


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then start[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of rows with at most so much together, a row at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def best_of(entities: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...], mean: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, entities, scores): of every group that shares a term with an entity of the block the best one, the least of several.

    Every pair is scored. Terms that many groups and many entities have are multiplied as dense matrices, the others pair by pair.
    """
    ids, lengths, words, df, who, tf = entities
    queries, terms, idf, sizes, term, qn = asked
    who, tf, df, n = who.astype(np.int64), tf.astype(np.float64), df.astype(np.int64), len(ids)
    first = np.cumsum(df) - df
    held = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[who] / mean))
    place = np.minimum(np.searchsorted(words, terms), len(words) - 1)
    found = words[place] == terms
    query = np.repeat(np.arange(len(queries)), sizes)
    mine = found[term]
    query, weight, term = query[mine], (idf[term] * qn)[mine], place[term[mine]]
    start = np.searchsorted(query, np.arange(len(queries) + 1))
    common = np.bincount(term, minlength=len(words)) * df > len(queries) * n / 100
    pairs = np.concatenate([[0], np.cumsum(df[term])])
    few = 10 * pairs[-1] < len(queries) * n
    for a, b in _stretches(pairs[start[1:]] - pairs[start[:-1]], _CELLS) if few else _stretches(np.full(len(queries), n), _CELLS):
        own = slice(start[a], start[b])
        q, w, t = query[own] - a, weight[own], term[own]
        if few:
            at = _runs(first[t], df[t])
            cells, back = np.unique(np.repeat(q * n, df[t]) + who[at], return_inverse=True)
            scores = np.round(np.bincount(back, np.repeat(w, df[t]) * held[at]), 6) if len(cells) else np.zeros(0)
            order = np.lexsort((cells, -scores, cells // n))
            order = order[np.unique(cells[order] // n, return_index=True)[1]]
            yield queries[a + cells[order] // n], ids[cells[order] % n], scores[order]
            continue
        total = np.zeros((b - a) * n)
        hot = common[t]
        which, col = np.unique(t[hot], return_inverse=True)
        for k in range(0, len(which), _SLAB):
            some = which[k : k + _SLAB]
            left, right = np.zeros((b - a, len(some))), np.zeros((len(some), n))
            inside = (col >= k) & (col < k + _SLAB)
            left[q[hot][inside], col[inside] - k] = w[hot][inside]
            at = _runs(first[some], df[some])
            right[np.repeat(np.arange(len(some)), df[some]), who[at]] = held[at]
            total += (left @ right).ravel()
        q, w, t = q[~hot], w[~hot], t[~hot]
        for c, d in _stretches(df[t], _CELLS):
            at = _runs(first[t[c:d]], df[t[c:d]])
            total += np.bincount(np.repeat(q[c:d] * n, df[t[c:d]]) + who[at], np.repeat(w[c:d], df[t[c:d]]) * held[at], minlength=len(total))
        scores = np.round(total.reshape(b - a, n), 6)
        near = scores.argmax(axis=1)  # the first of several, so the least id
        yield queries[a:b], ids[near], scores[np.arange(b - a), near]


def _best(mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, asked in zip(b.column("block"), b.column("asked"), strict=True):
                for found in best_of(_unpacked(block.as_py()), _unpacked(asked.as_py()), mean):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query", "near", "score"])

    return run


def nearest(groups: DataFrame, settled: DataFrame, asked: DataFrame, terms: Column, seen: list, own: list) -> DataFrame:
    """(query, near, score): the entity with the best BM25 score of each row of asked, the least of several.

    settled: (group_id, entity, n), asked: (group_id, n); their terms come from groups of the windows seen and own. All pairs
    are scored, but no row stands for a pair: entities and groups are cut into blocks of bounded size, packed, and every block
    of entities meets every block of groups in a task of its own. Hashes of 64 bits stand for terms.
    """
    spark = groups.sparkSession
    n, total = settled.agg(F.countDistinct("entity"), F.sum("n")).first()
    wanted = asked.agg(F.sum("n")).first()[0]
    if not total or not wanted:
        return spark.createDataFrame([], "query long, near long, score double")
    hashed = F.transform(terms, lambda t: F.xxhash64(t))
    carried = groups.drop("key").withColumnRenamed("window", "_window")
    parts = -(-total // BLOCK_TERMS)
    # What the groups carry moves; it is taken apart after it has moved, when it is larger.
    learned = carried.filter(F.col("_window").isin(seen)).join(settled.select("group_id", "entity"), "group_id").repartition(parts, "entity")
    blocks = cut(learned.select("entity", hashed.alias("terms")).mapInArrow(_entity_block, "block binary")).coalesce(parts)
    df = blocks.mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    posted = carried.filter(F.col("_window").isin(own)).join(asked.select("group_id"), "group_id").select(F.col("group_id").alias("query"), F.explode(hashed).alias("term"))
    parts = -(-wanted // ASKED_TERMS)
    weighed = posted.join(df, "term").select("query", "term", idf.alias("idf")).repartition(parts, "query")
    queries = cut(weighed.mapInArrow(_asked_block, "block binary")).coalesce(parts).withColumnRenamed("block", "asked")
    pairs = blocks.hint("shuffle_replicate_nl").crossJoin(queries)  # reads both from where they were written; nothing is written for a pair
    best = pairs.mapInArrow(_best(total / n), "query long, near long, score double")
    return best.groupBy("query").agg(F.max_by("near", F.struct("score", -F.col("near"))).alias("near"), F.max("score").alias("score"))


def resolve_windows(groups: DataFrame, link: float, new: float, terms: Column | None = None) -> DataFrame:
    """(group_id, entity, decision, window) for groups (group_id, window, key, terms).

    Windows run in order; inside one, groups see the entities as they stood at its start, so they
    resolve in parallel. A group whose key an entity has links to it; else its terms are scored
    against the entities' terms: a best score of `link` links, one of `new` or less makes an entity,
    in between the group waits for the next window, for at most ATTEMPTS windows, then it is new.
    Groups of one key that are new together are one entity, named by the least group. Groups without
    terms are left out.

    terms makes the terms of what groups carry beside group_id, window and key (by default their column terms).
    groups is read several times in each window; what is written of it is what it carries, once for each join.
    """
    terms = F.col("terms") if terms is None else terms
    heads = cut(groups.select("group_id", "window", "key", F.size(terms).cast("long").alias("n"))).filter("n > 0")
    numbers = [r[0] for r in heads.filter("window is not null").select("window").distinct().orderBy("window").collect()]  # one for each window
    columns = ["group_id", "window", "key", "n"]
    waiting, done = None, None
    for i, number in enumerate(numbers):
        own = heads.filter(F.col("window") == number).withColumn("attempts", F.lit(0))
        own = own if waiting is None else own.unionByName(waiting)
        if done is None:
            judged = own.withColumn("exact", F.lit(None).cast("long")).withColumn("near", F.lit(None).cast("long")).withColumn("score", F.lit(None).cast("double"))
        else:
            keys = done.groupBy("key").agg(F.min("entity").alias("exact"))
            known = cut(own.join(keys, "key", "left"))
            rest = known.filter("exact is null").select("group_id", "n").dropDuplicates(["group_id"])
            best = nearest(groups, done.dropDuplicates(["group_id"]), rest, terms, numbers[:i], numbers[max(0, i - ATTEMPTS + 1) : i + 1])
            judged = known.join(best, F.col("group_id") == F.col("query"), "left").drop("query")
        last = F.lit(i == len(numbers) - 1) | (F.col("attempts") >= ATTEMPTS - 1)
        judged = judged.withColumn("decision", F.when(F.col("exact").isNotNull() | (F.col("score") >= link), "LINK").when((F.coalesce("score", F.lit(0.0)) > new) & ~last, "DEFER").otherwise("NEW"))
        founder = F.min(F.when(F.col("decision") == "NEW", F.col("group_id"))).over(Window.partitionBy("key"))
        judged = cut(judged.withColumn("entity", F.when(F.col("decision") == "LINK", F.coalesce("exact", "near")).when(F.col("decision") == "NEW", founder)))
        rows = judged.filter("decision <> 'DEFER'").select("group_id", "entity", "decision", F.lit(number).alias("settled"), "key", "n")
        done = rows if done is None else done.unionByName(rows)
        waiting = judged.filter("decision = 'DEFER'").select(*columns, (F.col("attempts") + 1).alias("attempts"))
        # Nothing refers to what was moved for this window any more: let Spark remove it now, not when memory happens to run short.
        gc.collect()
        groups.sparkSession.sparkContext._jvm.System.gc()
    if done is None:
        return groups.select("group_id", F.lit(None).cast("long").alias("entity"), F.lit("").alias("decision"), "window").limit(0)
    return done.select("group_id", "entity", "decision", F.col("settled").alias("window"))
