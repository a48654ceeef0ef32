"""Operator 5: near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if its projection exceeds a threshold, so it lies in
a cap around it. Directions come from a random product code: the rotated space is cut into
blocks, each with a few random codewords, and every choice of one codeword for each block is a
filter. A vector is list-decoded to all filters it passes without visiting the others: codewords
of one block whose score cannot be made up by the best of the other are dropped first. Vectors
that share a filter (and a label) meet; their cosines are computed in double precision.

Equal vectors of one label count as one with a weight, so that copies never meet each other.

Caps shrink as the table grows, so that the number of chance meetings for each vector stays the
same, and each vector passes FILTERS of each code on average. In smaller caps a pair at cosine 0.93
shares fewer of them, so the number of codes grows with the table and misses stay as rare.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import ceil, log2
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from fabulon.llm.common import checkpointed, groups_of, partitions, spread_key
from fabulon.llm.graph import components

#: Filters of one code that a vector passes on average.
FILTERS = 12
#: Independent product codes of a table of up to FEW vectors: how many filters a vector passes varies less over several small codes than over a large one.
CODES, FEW = 4, 2000
#: Codes more for each doubling beyond that.
MORE = 0.4
#: Vectors that pass one filter on average.
MEETING = 32
#: Vectors of one label and filter compared at once; more are cut into chunks, and every two chunks meet.
CHUNK = 1024
#: Scores of vectors against codewords held at once, eight bytes each.
SCORES = 1 << 22


@lru_cache(maxsize=32)
def code(dims: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rotation, the codewords of both blocks, and the threshold, for a table of so many vectors."""
    share = min(0.2, MEETING / max(rows, 1))
    r = np.random.default_rng([seed, dims])
    turn = np.linalg.qr(r.normal(size=(dims, dims)))[0]
    words = max(4, round((FILTERS / share) ** 0.5))
    half = (dims + 1) // 2
    return turn, r.normal(size=(half, words)), r.normal(size=(dims - half, words)), NormalDist().inv_cdf(1 - share)


def codes(rows: int) -> int:
    """Codes for a table of so many vectors."""
    return ceil(CODES + MORE * log2(max(rows, FEW) / FEW))


def filter_type(rows: int) -> np.dtype:
    """The least type that holds the number of every filter of all codes."""
    return np.dtype("<i4" if codes(rows) * code(1, rows, 0)[1].shape[1] ** 2 < 1 << 31 else "<i8")


def decode(unit: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters of all codes that each unit vector passes, ordered by row and filter."""
    parts = [_decode(unit, rows, seed) for seed in range(codes(rows))]
    size = code(unit.shape[1], rows, 0)[1].shape[1] ** 2
    row, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + i * size for i, p in enumerate(parts)])
    at = np.lexsort((own, row))
    return row[at], own[at]


def _decode(unit: np.ndarray, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    turn, one, two, least = code(unit.shape[1], rows, seed)
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    few = max(1, SCORES // one.shape[1])  # vectors, and pairs of vector and codeword, whose scores are held at once
    for start in range(0, len(unit), few):
        x = unit[start : start + few] @ turn
        a, b = x[:, : one.shape[0]] @ one, x[:, one.shape[0] :] @ two
        top = b.max(axis=1) if b.shape[1] else np.zeros(len(x))
        row, first = np.nonzero(a >= (least - top)[:, None])
        for at in range(0, len(row), few):
            r, f = row[at : at + few], first[at : at + few]
            i, second = np.nonzero(b[r] >= (least - a[r, f])[:, None])
            out.append((start + r[i], f[i].astype(np.int64) * two.shape[1] + second))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _incidence(lists: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), len(kept)), dtype=np.float32)
    for i, own in enumerate(lists):
        at = np.searchsorted(kept, own)
        at = at[at < len(kept)]
        hit = at[np.isin(kept[at], own)]
        out[i, hit] = 1
    return out


def compare(linked: np.ndarray, alone: bool, weights_a: np.ndarray, weights_b: np.ndarray, filters_a: list[bytes], filters_b: list[bytes], number: np.dtype, here: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a and b (alone: a with itself), given who is linked: the weight linked to each row at its first common filter if that is this one, the class of each row (a row number) by all links, and the rows that have links.

    A pair may meet at several filters; counting it at its first common one counts it once.
    """
    ra, rb = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    n = len(weights_a) + (0 if alone else len(weights_b))
    counts, classes = np.zeros(n, dtype=np.int64), np.arange(n)
    if len(ra) == 0:
        return counts, classes, ra
    linked = linked[np.ix_(ra, rb)]
    near, far = ([np.frombuffer(f[i], dtype=number) for i in r] for f, r in ((filters_a, ra), (filters_b, rb)))
    seen, times = np.unique(np.concatenate([x[x < here] for x in (near if alone else near + far)]), return_counts=True)
    seen = seen[times > 1]
    own = linked if len(seen) == 0 else linked & (_incidence(near, seen) @ _incidence(far, seen).T < 0.5)
    at_b = rb if alone else rb + len(weights_a)
    counts[ra] += own @ weights_b[rb]
    if not alone:
        counts[at_b] += weights_a[ra] @ own
    low_a, low_b = ra.copy(), at_b.copy()
    while True:
        new_a = np.minimum(low_a, np.where(linked, low_b[None, :], n).min(axis=1))
        new_b = np.minimum(low_b, np.where(linked, new_a[:, None], n).min(axis=0))
        if alone:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    classes[ra], classes[at_b] = low_a, low_b
    return counts, classes, np.unique(np.concatenate([ra, at_b]))


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector.

    Vectors link when their labels are equal and their cosine is at least `least`. A vector that
    is null, empty, zero, or holds null or non-finite components, or whose label is null, links
    with nothing and is its own component; so do vectors of different lengths with each other.
    Rows that repeat an id (null ids too) count as one vector, the least by label and components.
    Other columns are not read; an empty table gives an empty result.
    """
    spark, width = vectors.sparkSession, partitions(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = v.filter(sound & F.col("vec_id").isNotNull())
    def by_length(batches):
        for b in batches:
            lists = b.column("v")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dims)
                yield b, pick, lists.take(pa.array(pick)).flatten().to_numpy().reshape(-1, dims)

    def digested(batches):
        for b, pick, x in by_length(batches):
            labels = b.column("label").take(pa.array(pick)).to_pylist()
            digests = [hashlib.blake2b(r.tobytes(), key=hashlib.blake2b(c.encode(), digest_size=16).digest(), digest_size=16).digest() for r, c in zip(x + 0.0, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(pick)), pa.array(digests, pa.binary())], names=["vec_id", "digest"])

    named = valid.mapInArrow(digested, "vec_id long, digest binary")
    # Of equal vectors of one label the least id stands for all.
    same = named.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    same = checkpointed(same)
    valid = valid.join(same.select(F.col("rep").alias("vec_id"), "weight"), "vec_id")
    rows = same.count()
    number = filter_type(rows)
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"  # single components travel as they are; all arithmetic is in double

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares within range
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def decoded(batches):
        for b, pick, x in by_length(batches):
            row, own = decode(unit(x), rows)
            at = pa.array(pick[row])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at), pa.array(np.full(len(row), x.shape[1])), pa.array(own)], names=["vec_id", "label", "dims", "filter"])

    def packed(batches):
        for b, pick, x in by_length(batches):
            row, own = decode(unit(x), rows)
            ends = np.cumsum(np.bincount(row, minlength=len(x)))
            lists = [p.tobytes() for p in np.split(own.astype(number), ends[:-1])]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(pick)), b.column("weight").take(pa.array(pick)), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(lists, pa.binary())], names=["vec_id", "weight", "raw", "filters"])

    key = ["label", "dims", "filter"]
    passed = valid.mapInArrow(decoded, "vec_id long, label string, dims long, filter long")
    crowds = passed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    met = passed.join(crowds.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), key)
    met = met.withColumn("own", F.pmod(spread_key("vec_id"), F.col("chunks")).cast("int"))
    # A vector goes to the meetings of its chunk with every chunk; one meeting for most filters.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).withColumn("meeting", F.xxhash64(*key, "low", "high"))
    # Vectors join once it is known who meets whom, so that they move for meetings only, and once.
    carried = valid.mapInArrow(packed, "vec_id long, weight long, raw binary, filters binary")
    dealt = met.select("meeting", "own", "low", "high", "vec_id", "filter").join(carried, "vec_id").repartition(width, "meeting").sortWithinPartitions("meeting", "own", "vec_id")

    def meet(batches):
        for t in groups_of(batches, "meeting"):
            m, own, low, high, ids, here, weight = (t.column(c).to_numpy() for c in ("meeting", "own", "low", "high", "vec_id", "filter", "weight"))
            raw, lists = t.column("raw").to_pylist(), t.column("filters").to_pylist()
            start = np.append(np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])), len(m))
            out = [[], [], []]
            for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                alone = bool(low[s] == high[s])
                cut = e - s if alone else int(np.searchsorted(own[s:e], low[s], side="right"))
                if e - s < 2 or not alone and cut in (0, e - s):
                    continue
                x = unit(np.frombuffer(b"".join(raw[s:e]), dtype=kind).reshape(e - s, -1).astype(np.float64))
                w, f = weight[s:e], lists[s:e]
                other = slice(0, e - s) if alone else slice(cut, e - s)
                linked = x[:cut] @ x[other].T >= least
                if alone:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                counts, classes, hit = compare(linked, alone, w[:cut], w[other], f[:cut], f[other], number, int(here[s]))
                for o, y in zip(out, (ids[s + hit], counts[hit], ids[s + classes[hit]]), strict=True):
                    o.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["vec_id", "n", "root"])

    # What a vector found at one meeting is one row: links are never written out as pairs.
    found = dealt.mapInArrow(meet, "vec_id long, n long, root long").groupBy("vec_id", "root").agg(F.sum("n").alias("n"))
    found = checkpointed(found)
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    classes = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    # What holds for the one that stands for equal vectors holds for each of them, and they link with each other.
    each = same.join(links, same["rep"] == links["vec_id"], "left").drop("vec_id").join(classes, same["rep"] == classes["vec_id"], "left")
    each = each.select("digest", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = v.select("vec_id").join(named.join(each, "digest").drop("digest"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
