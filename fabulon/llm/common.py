"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of output that a generator of Arrow batches gathers before it hands a batch on.
FLUSH_BYTES = 8 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read again: lineage ends here.

    The folder is spark.checkpoint.dir of the session. Where that is unset a local session gets a
    temporary one; a cluster must name a shared one.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp("checkpoints"))
    # Nothing refers to the steps before the last checkpoint any more: let Spark remove their shuffle files now, not when memory happens to run short.
    gc.collect()
    sc._jvm.System.gc()
    return df.checkpoint(eager=True)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, and at their end the memory that a Python process would keep for its next task: hash tables, and what the allocator holds."""
    try:
        yield from batches
    finally:
        Rolling._up = Rolling._down = np.ones(1, dtype=np.uint64)
        Stretches._up, Stretches._down = [], []
        gc.collect(0)
        with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df through run, by Arrow batches; memory goes back when a task ends."""
    return df.mapInArrow(lambda batches: released(run(batches)), schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Steps carried out inside send at most so many rows to Python at once: for rows of whole sets, ten times as long as texts' rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no classifier may learn labels from: crc32(id as text) mod folds is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def spread_key(*cols: Column) -> Column:
    """A hash that is independent of the one by which Spark deals rows out."""
    return F.xxhash64(F.lit(0x5EED), *cols)


def judged(texts: Column, judge: Callable[[], Callable[[pa.Array], pa.Array]], ddl: str) -> Column:
    """A column made of each text in Python: judge() loads a model once for each task, and what it gives makes of an array of texts an array of results.

    Only texts travel to Python and only results come back; the other columns of a row wait in the JVM. Texts come
    in slices of a megabyte. The column counts as nondeterministic, so that a filter on it does not make it twice.
    """

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = judge()

        def each():
            for a in arrays:
                batch = pa.RecordBatch.from_arrays([a], names=["text"])
                parts = [own(b.column("text")) for b in slices(batch, "text", 1 << 20)]
                yield pa.concat_arrays(parts) if parts else own(a)

        yield from released(each())

    return F.arrow_udf(run, ddl).asNondeterministic()(texts)


class Batches:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> None:
        self.rows.append(row)
        self.bytes += size

    def ready(self) -> bool:
        return self.bytes >= FLUSH_BYTES

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about limit bytes together (a longer text is a part of its own)."""
    start = size = 0
    for i, v in enumerate(batch.column(text)):
        n = len(v.as_buffer()) if v.is_valid else 0
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


#: Base of the polynomial hash (odd, so that it has an inverse modulo 2**64).
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretches of one byte array, by differences of prefix sums."""

    _up = _down = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._up) <= n:
            Rolling._up, Rolling._down = (_powers(b, max(n + 1, 1 << 20)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling._up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the stretches [start, end)."""
        return mixed((self.sums[end] - self.sums[start]) * Rolling._down[start])

    def windows(self, k: int) -> np.ndarray:
        """Mixed hashes of every stretch of k bytes, in order."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * Rolling._down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


_P = np.uint64((1 << 31) - 1)
#: Bases of the two hashes modulo that prime.
_BASES = (1_192_384_741, 252_246_292)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x under 2**63."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), int(_P))))])
    return out[:n].astype(np.uint32)  # half the memory


class Stretches:
    """Hashes of any stretches of one byte array: two polynomials modulo a prime in 62 bits, mixed.

    Modulo 2**64 some plain texts collide for any base (Thue-Morse words); modulo a prime none
    are known to.
    """

    _up: list[np.ndarray] = []
    _down: list[np.ndarray] = []

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not Stretches._up or len(Stretches._up[0]) <= n:
            size = max(n + 1, 1 << 20)
            Stretches._up = [_prime_powers(b, size) for b in _BASES]
            Stretches._down = [_prime_powers(pow(b, -1, int(_P)), size) for b in _BASES]
        own, self.sums = data.astype(np.uint64) + np.uint64(1), []
        for up in Stretches._up:
            sums = np.zeros(n + 1, dtype=np.uint64)
            terms = own * up[:n]  # under 2**39 each, so that 2**24 of them fit; else reduced to under 2**31
            np.cumsum(terms if n < 1 << 24 else _mod(terms), out=sums[1:])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        one, two = (_mod(_mod(s[end] - s[start]) * down[start]) for s, down in zip(self.sums, Stretches._down, strict=True))
        return mixed(one << np.uint64(31) | two)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that all bits of a hash are usable."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after another, and len + 1 offsets (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups_of(batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows from batches sorted by key; a group spans tables never."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1])) if np.all(k[:-1] <= k[1:]) else 0
        if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
            if cut == 0:
                yield pa.Table.from_batches(held)
                held = [b]
                continue
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
