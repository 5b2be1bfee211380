"""Shared folder tables and vectorised byte-level text helpers.

The text helpers see a run of documents as one byte buffer plus offsets, so
that word splitting and hashing cost a few numpy passes instead of a Python
step for each word. A run holds whole documents of about ``RUN_BYTES``; a
longer document is a run of its own, so memory follows the longest document.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone import session
from lodestone.session import dropped as drop_written  # noqa: F401
from lodestone.session import shared_dir  # noqa: F401

RUN_BYTES = 1 << 20


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python whole texts in smaller batches than the default of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    # workers give memory back instead of keeping it in many arenas
    spark.sparkContext.environment.setdefault("MALLOC_ARENA_MAX", "2")
    spark.sparkContext.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")


def trim() -> None:
    """Return freed memory to the system: idle Python workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str, *, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again."""
    return session.written(df, name, codec=codec)


#: Keys that :func:`join_counted` broadcasts at most, and the least rows that make a key one of them.
HOT_KEYS, HOT_ROWS = 100_000, 1_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], total: int, *, count: str = "n") -> DataFrame:
    """``rows`` joined with ``keys``, unique keys of which ``count`` says how many of the ``total`` rows have them.

    Keys with more than one row in ``HOT_KEYS`` of all (and ``HOT_ROWS`` at least) are
    broadcast; there are at most ``HOT_KEYS`` of them, and their rows stay where they
    are. So no shuffled key has more rows than that. ``count`` is left out.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = keys.where(F.col(count) > least).drop(count)
    cold = keys.where(F.col(count) <= least).drop(count)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with columns ``c0``, ``c1`` and so on, so that none clashes with an operator's own."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = pc.cast(column, pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), ends


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Whole documents in runs of about ``limit`` bytes: (rows, bytes, offsets from 0)."""
    data, ends = byte_view(column)
    n, row = len(ends) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield slice(row, stop), data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop
    trim()


def segments(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a document's edge."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def table_of(*spans: tuple[int, int]) -> np.ndarray:
    """A 256-entry truth table, true for the bytes of the inclusive spans."""
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


NOT_SPACE = ~table_of((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all bytes beyond ASCII.
WORDLIKE = ~table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_letters = np.random.default_rng(20240607).integers(0, 2**64, 256, np.uint64) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(RUN_BYTES, 1 << max(n, 1).bit_length()) + 1
    if size not in _powers:
        inverse = pow(_BASE, -1, 2**64)
        tables = []
        for base in (_BASE % 2**64, inverse):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > RUN_BYTES + 1:  # one very long document: its tables are not kept
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def segment_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's bytes, the same wherever the segment stands."""
    powers, inverse = _power_tables(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_letters[buffer] * powers[: len(buffer)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Longer segments are hashed by their bytes alone.
SHORT = 64


def segment_keys(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Like :func:`segment_hashes`, for words and lines of any text.

    Sums modulo 2 ** 64 can be made to agree on long strings built for it, whatever
    the base; segments longer than ``SHORT`` bytes therefore take XXH3.
    """
    out = segment_hashes(buffer, starts, ends)
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        view = memoryview(np.ascontiguousarray(buffer))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def numbered_within(rows: DataFrame, key: str, order: list, *, ranges: list, keep: list[str], name: str = "pos") -> DataFrame:
    """Columns ``keep`` and the rows' numbers from 1 within ``key``, in the order of ``order``.

    Rows are dealt out in ranges of (``key``, ``ranges``), where ``ranges`` are
    expressions that the order refines, so a key with very many rows is spread over
    tasks. A range has at most one key that began before it, and so the numbers to
    start from are at most one row a range; these are broadcast. ``key`` must be in
    ``keep``; a null key is a key like any other, and equal rows are numbered in any order.
    """
    # ranges first: the order's own columns may be long texts, of which Spark would sample range bounds
    dealt = rows.repartitionByRange(F.col(key), *ranges).sortWithinPartitions(F.col(key), *order).select(*keep, F.spark_partition_id().alias("range"))
    at = keep.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(at)
            fresh = np.ones(n, bool)
            same = pc.equal(ids[1:], ids[:-1])
            both = pc.and_(pc.is_null(ids[1:]), pc.is_null(ids[:-1]))
            fresh[1:] = ~pc.or_(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False)
            first = ids[0].as_py()
            if last == (first,):
                fresh[0] = False
            starts = np.flatnonzero(fresh)
            index = np.arange(n)
            begun = np.searchsorted(starts, index, "right") - 1
            number = np.where(begun >= 0, index - starts[begun] if len(starts) else 0, index + done) + 1
            last, done = (ids[n - 1].as_py(),), int(number[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int64))], names=[*keep, "range", "nth"])
        trim()

    schema = StructType([*dealt.schema.fields, StructField("nth", LongType())])
    split = written(dealt.mapInArrow(run, schema), "numbered")
    held = split.groupBy(F.col(key).alias("held"), F.col("range").alias("held_range")).agg(F.max("nth").alias("n"))
    before = F.sum("n").over(Window.partitionBy("held").orderBy("held_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("held", "held_range", before.alias("before")).where("before > 0")  # at most one row for each range
    joined = split.join(F.broadcast(starts), (F.col("range") == F.col("held_range")) & F.col(key).eqNullSafe(F.col("held")), "left")
    return joined.select(*keep, (F.col("nth") + F.coalesce("before", F.lit(0))).alias(name))


def digests_of_sequences(members: DataFrame, group: str, order: str, piece: str, *, separator: str, pieces: int = 1000) -> DataFrame:
    """(``group``, ``sha256``): the digest of each group's ``piece`` strings in order, joined by ``separator``.

    A digest is made from front to back, so a group is hashed by one task, which
    reads it as a stream. Tasks that hold ranges of the order join up to ``pieces``
    strings beforehand, so even a group with a large part of all rows comes as few rows.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held = None, None, []
        for batch in batches:
            out = []
            for g, o, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (g != key or len(held) >= pieces):
                    out.append((key, first, separator.join(held)))
                    held = []
                if not held:
                    key, first = g, o
                held.append(p)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), batch.schema.types, strict=True)], names=batch.schema.names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, first, separator.join(held)), batch.schema.types, strict=True)], names=batch.schema.names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for g, _, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and g == key:
                    state.update(separator.encode())
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = g, hashlib.sha256()
                state.update(p.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.types[0]), pa.array([d for _, d in out])], names=["group", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.types[0]), pa.array([state.hexdigest()])], names=["group", "sha256"])

    chosen = members.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(piece).cast("string").alias("piece"))
    joined = chosen.repartitionByRange("group", "order").sortWithinPartitions("group", "order").mapInArrow(join, chosen.schema)
    kind = chosen.schema["group"].dataType.simpleString()
    return joined.repartition("group").sortWithinPartitions("group", "order").mapInArrow(digest, f"group {kind}, sha256 string").withColumnRenamed("group", group)


#: SQL for the unsigned CRC-32 of the ASCII string {x}, a bit at a time.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
         lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT)"""
