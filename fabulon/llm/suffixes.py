"""Operator 6: removal of repeated byte strings by a distributed, common-prefix-aware merge sort.

Every string of `length` bytes that also starts earlier is removed. Sorting all suffixes would
move the corpus many times over, so only suffixes that can matter are sorted. Of each string of
`length` bytes the k-byte stretch with the least hash is its anchor: equal strings have equal
anchors at equal places. Anchors are dealt by hash, and those that occur once are dropped.

The suffixes that start at the remaining anchors are sorted in each slice of documents into
runs, front-coded (each suffix says how many bytes it shares with the one before it), and
exchanged. A task merges its runs with a loser tree that carries the common prefixes along, so
that bytes known to be equal are not compared again. Neighbours in merged order with a long
enough common prefix, grouped further by the bytes left of the anchor, are the repeated strings.
Most occurrences lie inside longer repeats. If all bytes that a string around the anchor can
reach are the same as at an earlier occurrence, every string around it is a repeat; these are
settled by two 64-bit hashes of the surroundings, and only one occurrence of each surroundings is
sorted, and that only where an anchor has several. Occurrences are first dealt by surroundings, the
earliest of each kept, and only these by anchor, so that a common passage does not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fabulon.llm.common import Rolling, groups_of, joined_bytes, mapped, mixed, partitions, slices

NULL_ID = -(1 << 63)
#: Mask of an occurrence all of whose strings are repeats.
_ALL = -1
#: Place of a suffix: document order number << 40 | byte position.
_ORD = 40
SLICE = 2 << 20
#: Bytes of text handled at once where nothing is compared within a slice: numbers for each byte take some hundred times as much.
NARROW = 1 << 19
#: Other numbers for the bytes, which make of one polynomial hash a second.
_ANOTHER = np.random.default_rng(40).permutation(256).astype(np.uint8)


def _least(h: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """pick over h[i : i + w] for each i with w values left."""
    out, have = h, 1
    while 2 * have <= w:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(h) - w + 1], out[w - have : w - have + len(h) - w + 1]) if w > have else out[: len(h) - w + 1]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and hashes of the anchors of all strings of `length` bytes inside one document; of equal least hashes all."""
    n, w = len(data), length - k + 1
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = Rolling(data).windows(k)
    low = _least(h, w)
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        low[max(a, z - length + 1) : z] = 0  # strings that would run past their document
    low = np.concatenate([np.zeros(w - 1, dtype=np.uint64), low, np.zeros(w - 1, dtype=np.uint64)])
    at = np.flatnonzero((_least(low, w, np.maximum) == h) & (h > 0))
    return at, h[at]


def _numbered(batches, state: list, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches sorted by (doc, mark), with the order number of each row's text under its id, and whether the row repeats the one before."""
    for batch in batches:
        for b in slices(batch, "text", limit):
            order, again = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=bool)
            for i, now in enumerate(zip(b.column("doc").to_pylist(), b.column("mark").to_pylist(), strict=True)):
                if state and state[0][0] == now[0]:
                    again[i] = state[0] == now
                    order[i] = state[1] + (not again[i])
                state[:] = [now, int(order[i])]
            yield b, order, again


class Run:
    """A sorted run read from its front coding: suffixes one by one with the length of the prefix shared with the one before."""

    def __init__(self, shared: bytes, tails: bytes, sizes: bytes):
        self.shared, self.tails, self.sizes = shared, tails, sizes
        self.i, self.at, self.text = -1, 0, b""

    def advance(self) -> int:
        """To the next suffix; bytes it shares with the last one, or -1 at the end."""
        self.i += 1
        if self.i >= len(self.shared):
            return -1
        lcp, end = self.shared[self.i], self.at + self.sizes[self.i]
        self.text = self.text[:lcp] + self.tails[self.at : end]
        self.at = end
        return lcp


def common(a: bytes, b: bytes, known: int) -> int:
    """Bytes that a and b share, of which `known` are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index in run, bytes shared with the suffix before) over all runs in order; equal suffixes in run order.

    A loser tree: each inner node holds the loser of its match and the prefix it shares with the
    winner that passed. Two suffixes are compared by these lengths to the last winner first: the
    one that shares more is smaller, and only if both share the same are bytes read, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    lcp = [0] * size  # prefix shared with the last winner; -1: the run is at its end
    for i in range(size):
        lcp[i] = -1 if i >= len(runs) or runs[i].advance() < 0 else 0
    loser = [0] * size

    def wins(a: int, b: int) -> bool:
        """Whether a goes before b; the other's lcp becomes its prefix shared with the winner."""
        x, y = lcp[a], lcp[b]
        if x != y:
            return x > y
        if x < 0:
            return a < b
        s, t = runs[a].text, runs[b].text
        n = common(s, t, x)
        first = a < b if n == len(s) == len(t) else (n == len(s) or (n < len(t) and s[n] < t[n]))
        lcp[b if first else a] = n
        return first

    winner = list(range(2 * size))
    for i in range(size):
        winner[size + i] = i
    for node in range(size - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if wins(a, b) else (b, a)
    top = winner[1] if size > 1 else 0
    while lcp[top] >= 0:
        yield top, runs[top].i, lcp[top]
        lcp[top] = runs[top].advance()
        node = (size + top) // 2
        while node:
            if not wins(top, loser[node]):
                top, loser[node] = loser[node], top
            node //= 2


def repeated(shared: np.ndarray, left: np.ndarray, lefts: np.ndarray, rights: np.ndarray, rank: np.ndarray, length: int, k: int) -> np.ndarray:
    """For suffixes in sorted order, a bit mask: bit a is set if the string that starts a bytes before the anchor occurs before.

    shared: common prefix with the suffix before. left: bytes before each anchor, nearest first.
    lefts, rights: how many bytes of the document lie before and from the anchor. rank: text order.
    """
    n, by_rank = len(shared), np.argsort(rank, kind="stable")
    masks, h = np.zeros(n, dtype=np.int64), np.full(n, 1, dtype=np.uint64)
    for a in range(length - k + 1):
        if a:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + left[:, a - 1].astype(np.uint64))
        group = np.cumsum(shared < length - a).astype(np.uint64)
        ok = by_rank[(lefts[by_rank] >= a) & (rights[by_rank] >= length - a)]
        if len(ok) < 2:
            continue
        _, first, which = np.unique(mixed(h[ok] + group[ok] * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True, return_inverse=True)
        masks[ok[first[which] != np.arange(len(ok))]] |= np.int64(1) << np.int64(a)
    return masks


_BLOB = ("docs", "places", "rights", "lefts", "left", "shared", "tails", "sizes")


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 40, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining text, if asked) for each row of docs.

    Texts are UTF-8 bytes, null reads as empty; removed is each byte covered by a string of
    `length` bytes that also starts earlier: in a smaller doc_id, or earlier in the same document.
    A null id orders before all others. Rows with one id and different texts are documents of
    their own, in a fixed order; rows equal in both are one document, and each gets its result.
    In `kept`, a character of which a part is removed is left out whole. The columns named
    in carry come along; others are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    width, w = partitions(spark), length - k
    if not 0 < w < 63 or length > 255:
        raise ValueError("length - k must be 1 to 62, and length 255 at most")
    # One exchange of the texts, by id; the three passes below read the same shuffle files.
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"), *[F.struct(*carry).alias("carried")] * bool(carry)).repartition(width, "doc")

    def first(batches):
        for b, order, again in _numbered(batches, [], NARROW):
            data, offsets = joined_bytes(b.column("text"))
            at, h = anchors(data, offsets, length, k)
            row = np.searchsorted(offsets, at, side="right") - 1
            new = ~again[row]
            at, h, row = at[new], h[new], row[new]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc").take(pa.array(row)), pa.array(order[row] << _ORD | (at - offsets[row]))], names=["key", "doc", "place"])

    def several(batches):
        """Rows whose key the row before or after has too."""
        held, before = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            key = b.column("key").to_numpy()
            same = key[1:] == key[:-1]
            hit = np.zeros(len(key), dtype=bool)
            hit[1:] |= same
            hit[:-1] |= same
            hit[0] |= before is not None and before == key[0]
            yield b.slice(0, len(key) - 1).filter(pa.array(hit[:-1]))
            before, held = (key[-2] if len(key) > 1 else before), b.slice(len(key) - 1)
        if held is not None and before is not None and before == held.column("key")[0].as_py():
            yield held

    found = source.sortWithinPartitions("doc", "mark").transform(mapped, first, "key long, doc long, place long")
    found = found.repartition(width, "key").sortWithinPartitions("key").transform(mapped, several, "key long, doc long, place long")
    # As many places as a document's length allows. Left joins, so that all passes read one exchange of the texts.
    by_doc = found.groupBy("doc").agg(F.collect_list("place").alias("found"))

    def located(batches):
        """Of each slice: its bytes, and of each found place its id, the place, its byte position and how far its document reaches."""
        for b, order, again in _numbered(batches, []):
            data, offsets = joined_bytes(b.column("text"))
            lists = b.column("found")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            place = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), sizes)
            own = (place >> _ORD == order[row]) & ~again[row]
            place, row = place[own], row[own]
            if len(place) == 0:
                continue
            ids = b.column("doc").to_numpy()[row]
            at = np.lexsort((place, ids))
            place, row, ids = place[at], row[at], ids[at]
            pos = (place & ((1 << _ORD) - 1)) + offsets[row]
            yield data, ids, place, pos, np.minimum(offsets[row + 1] - pos, length), np.minimum(pos - offsets[row], w)

    def surround(batches, settled: bool):
        """Occurrences with hashes of anchor and surroundings; or those settled because the slice has their surroundings before."""
        for data, ids, place, pos, rights, lefts in located(batches):
            hashes, other = Rolling(data), Rolling(_ANOTHER[data])
            shape = (lefts * 256 + rights).astype(np.uint64)
            around, also = (mixed(h.of(pos - lefts, pos + rights) + shape) for h in (hashes, other))
            first_ = np.zeros(len(pos), dtype=bool)
            at = np.lexsort((also, around))  # stable, and rows are in text order
            first_[at] = np.concatenate([[True], (around[at[1:]] != around[at[:-1]]) | (also[at[1:]] != also[at[:-1]])])
            if settled:
                yield pa.RecordBatch.from_arrays([pa.array(ids[~first_]), pa.array(place[~first_])], names=["doc", "place"])
            else:
                key = hashes.of(pos, pos + k).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[first_]) for x in (key, around.view(np.int64), also.view(np.int64), ids, place)], names=["key", "around", "also", "doc", "place"])

    def earliest(batches):
        """Of each surroundings all but the first are settled; the first goes on, with the hash of its anchor."""
        for t in groups_of(batches, "around"):
            key, around, also = (t.column(c).to_numpy() for c in ("key", "around", "also"))
            head = np.ones(t.num_rows, dtype=bool)
            head[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1]) | (also[1:] != also[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key, mask=~head), *[t.column(c).combine_chunks() for c in ("doc", "place")]], names=["key", "doc", "place"])

    kept = ("doc", "mark", "text", *["carried"] * bool(carry), "found")
    read = source.join(by_doc, "doc", "left").select(*kept).sortWithinPartitions("doc", "mark")
    done = read.transform(mapped, lambda b: surround(b, True), "doc long, place long")
    placed = read.transform(mapped, lambda b: surround(b, False), "key long, around long, also long, doc long, place long")
    decided = placed.repartition(width, "around").sortWithinPartitions("around", "also", "key", "doc", "place").transform(mapped, earliest, "key long, doc long, place long")
    # Sent are the first ones of anchors that have several surroundings.
    heads = decided.filter("key is not null").repartition(width, "key").sortWithinPartitions("key")
    to_send = heads.transform(mapped, several, "key long, doc long, place long").groupBy("doc").agg(F.collect_list("place").alias("found"))

    def runs(batches):
        for data, ids, place, pos, rights, lefts in located(batches):
            part_of = (Rolling(data).of(pos, pos + k) % np.uint64(width)).astype(np.int64)
            padded = np.concatenate([np.zeros(w, dtype=np.uint8), data, np.zeros(length, dtype=np.uint8)])
            for part in np.unique(part_of).tolist():
                i = np.flatnonzero(part_of == part)
                right = padded[(pos[i] + w)[:, None] + np.arange(length)]
                right[np.arange(length)[None] >= rights[i, None]] = 0
                s = np.argsort(right.view(f"S{length}").ravel(), kind="stable")
                i, right = i[s], right[s]
                left = padded[(pos[i] + w)[:, None] - 1 - np.arange(w)]
                left[np.arange(w)[None] >= lefts[i, None]] = 0
                differ = right[1:] != right[:-1]
                shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), length)]).astype(np.uint8)[: len(i)]
                tail = np.arange(length)[None] >= shared[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids[i], place[i], rights[i].astype(np.uint8), lefts[i].astype(np.uint8), left, shared, right[tail], (length - shared).astype(np.uint8))],
                    names=["part", *_BLOB],
                )

    def combine(batches):
        held: list[dict] = []
        part = None
        for b in batches:
            for r in b.to_pylist():
                if held and r["part"] != part:
                    yield from _settled(held, length, k)
                    held = []
                part = r["part"]
                held.append(r)
        if held:
            yield from _settled(held, length, k)

    blobs = source.join(to_send, "doc", "left").select(*kept).sortWithinPartitions("doc", "mark").transform(mapped, runs, "part int, " + ", ".join(f"{c} binary" for c in _BLOB))
    # Runs of a part come in no fixed order; ranks settle which occurrence is first, not run order.
    marks = blobs.repartition(width, "part").sortWithinPartitions("part").transform(mapped, combine, "doc long, place long, mask long")
    whole = decided.filter("key is null").select("doc", "place").unionByName(done)
    marks = marks.unionByName(whole.select("doc", "place", F.lit(_ALL).cast("long").alias("mask")))
    marked = marks.groupBy("doc").agg(F.collect_list(F.struct("place", "mask")).alias("found"))

    def cut(batches):
        for b, order, _ in _numbered(batches, [], NARROW):
            data, offsets = joined_bytes(b.column("text"))
            lists = b.column("found")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            place, mask = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row = np.repeat(np.arange(b.num_rows), sizes)
            own = place >> _ORD == order[row]
            place, mask, row = place[own], mask[own], row[own]
            pos, start, end = (place & ((1 << _ORD) - 1)) + offsets[row], offsets[row], offsets[row + 1]
            step = np.zeros(len(data) + 1, dtype=np.int32)
            all_ = mask == _ALL
            low, high = np.maximum(start, pos - w)[all_], np.minimum(pos, end - length)[all_]
            fits = low <= high
            np.add.at(step, low[fits], 1)
            np.add.at(step, high[fits] + length, -1)
            pos, mask = pos[~all_], mask[~all_]
            for back in range(w + 1):
                at = pos[mask >> back & 1 > 0] - back
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            head = gone & np.concatenate([[True], ~gone[:-1]])[: len(gone)]
            edges = offsets[:-1][offsets[:-1] < len(gone)]
            head[edges] = gone[edges]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, head))
            removed, spans = np.diff(removed[offsets]), np.diff(spans[offsets])
            rests = [data[x:z].tobytes() if r == 0 else data[x:z][~gone[x:z]].tobytes() for x, z, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True)]
            ids = pc.if_else(pc.equal(b.column("doc"), NULL_ID), pa.scalar(None, pa.int64()), b.column("doc"))
            arrays = [ids, pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in rests], pa.string())]
            if keep_text:
                texts = pa.array(_whole_characters(data, offsets, gone, removed, rests), pa.string())
                arrays.append(pc.if_else(b.column("text").is_valid(), texts, pa.scalar(None, pa.string())))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)]
            if carry:
                arrays, names = [*arrays, b.column("carried")], [*names, "carried"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if keep_text else "")
    schema = StructType([*StructType.fromDDL(schema).fields, *[f for f in source.schema if f.name == "carried"]])
    out = source.join(marked, "doc", "left").select(*kept).sortWithinPartitions("doc", "mark").transform(mapped, cut, schema)
    return out.select(*[c for c in out.columns if c != "carried"], *[F.col("carried")[c].alias(c) for c in carry])


def _whole_characters(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, removed: np.ndarray, rests: list[bytes]) -> list[str]:
    """The remaining texts, cut at character borders."""
    if not removed.any():
        return [x.decode() for x in rests]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    part = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
    return [x.decode() if r == 0 else data[a:z][~part[a:z]].tobytes().decode() for x, r, a, z in zip(rests, removed.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _settled(rows: list[dict], length: int, k: int, chunk: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Marks of one part, found by merging its runs, whole groups of equal anchors at a time."""

    def batch(docs, places, masks):
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(places), pa.array(masks)], names=["doc", "place", "mask"])

    w = length - k
    runs = [Run(r["shared"], r["tails"], r["sizes"]) for r in rows]
    start = np.cumsum([0] + [len(r["shared"]) for r in rows])
    docs, places = (np.frombuffer(b"".join(r[c] for r in rows), dtype=np.int64) for c in ("docs", "places"))
    rights, lefts = (np.frombuffer(b"".join(r[c] for r in rows), dtype=np.uint8).astype(np.int64) for c in ("rights", "lefts"))
    left = np.frombuffer(b"".join(r["left"] for r in rows), dtype=np.uint8).reshape(-1, w)
    if len(docs) == 0:
        return
    rank = np.empty(len(docs), dtype=np.int64)
    rank[np.lexsort((places, docs))] = np.arange(len(docs))

    def settle(at: list[int], shared: list[int]):
        i, s = np.array(at, dtype=np.int64), np.array(shared, dtype=np.int64)
        s = np.minimum(s, np.minimum(rights[i], np.concatenate([[0], rights[i[:-1]]])))  # beyond a document's end lies padding
        masks = repeated(s, left[i], lefts[i], rights[i], rank[i], length, k)
        hit = np.flatnonzero(masks)
        return batch(docs[i[hit]], places[i[hit]], masks[hit])

    at: list[int] = []
    shared: list[int] = []
    for run, index, lcp in merged(runs):
        if len(at) >= chunk and lcp < k:
            yield settle(at, shared)
            at, shared = [], []
        at.append(int(start[run]) + index)
        shared.append(lcp)
    if at:
        yield settle(at, shared)
