"""Exact substring dedup by a logarithmic family of suffix arrays.

Which suffixes: of each 200-byte window the suffix that starts at the window's
least hashed 48-byte head stands for the window. Equal windows choose equal
suffixes, so a copied window is never missed, and the arrays hold about one suffix
in 75 bytes. The windows that share a chosen suffix are neighbours; with their 200
bytes each they form a block of text around it.

Family: a batch's suffixes are written as they come, and its level is the array of
their distinct heads in a fixed order (that of a hash: only equality counts) with the
number of suffixes at each, bucketed and sorted. A head that any share of all
suffixes begins with is one row there. A new level is merge-scanned against each
older one for heads that both have, which are where long matches can be; two levels
of equal rank merge into one of the next, their numbers added. Equal buckets meet
without a shuffle. A family can be stored, and later batches added to it.

Resolution: two suffixes with equal blocks repeat each other's windows wholly. For
a block that is equal to no other, the windows are compared with those of the other
blocks at that head, one of each kind, at the same distance from the head.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import byte_view, drop_written, join_counted, load, released, runs, segment_hashes, segments, shared_dir, trim, written

LENGTH = 200
HEAD = 48
#: Batches of the query.
BATCHES = 4
#: Kinds of blocks at one head that one task compares (about a megabyte); heads with more are compared by halving, in shuffles.
KINDS = 4_000
#: Windows in the stretches that halving starts from: a power of two of at most LENGTH.
STRETCH = 128


def chosen_suffixes(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, head: int = HEAD):
    """(document, first window, windows, distance of the suffix, head hash, block hash) of each chosen suffix."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = np.arange(len(data) - head + 1)
    heads = segment_hashes(data, at, at + head)
    # the leftmost least head of each window: minima of blocks from the left and from the right
    width = length - head + 1
    value = (heads >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    padded = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(value)] = value
    padded = padded.reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    suffix = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    suffix = suffix[start]
    new = np.flatnonzero(np.concatenate([[True], (suffix[1:] != suffix[:-1]) | (doc[1:] != doc[:-1])])[: len(doc)])
    count = np.diff(np.append(new, len(doc)))
    start, suffix, doc = start[new], suffix[new], doc[new]
    body = data.tobytes()
    digest = xxhash.xxh64_intdigest
    blocks = np.array([digest(body[s:e]) for s, e in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)], np.uint64)
    return doc, start - offsets[doc], count, suffix - start, heads[suffix], blocks


SUFFIX = "head bigint, block bigint, windows smallint, distance smallint, doc bigint, row bigint, start int"
_ROW = ["doc", "row"]


def suffixes(docs: DataFrame) -> DataFrame:
    """The chosen suffixes of keyed documents (``doc``, ``row``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch.column(2)):
                owner, start, count, distance, head, block = chosen_suffixes(data, offsets)
                at = pa.array(owner)
                columns = [pa.array(head.view(np.int64)), pa.array(block.view(np.int64)), pa.array(count.astype(np.int16)), pa.array(distance.astype(np.int16)), *[batch.column(k)[rows].take(at) for k in (0, 1)], pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "block", "windows", "distance", "doc", "row", "start"])

    return docs.mapInArrow(run, SUFFIX)


class SuffixFamily:
    """Levels of suffix arrays, the suffixes themselves, and the heads that were found to occur again."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []
        self.suffixes: list[DataFrame] = []
        self.again: list[DataFrame] = []

    def _array(self, heads: DataFrame) -> str:
        """Write (``head``, ``n``), dealt out by head, as a level."""
        name = f"suffixes_{uuid.uuid4().hex}"
        heads.write.bucketBy(self.buckets, "head").sortBy("head").option("compression", "zstd").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        drop_written(self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")

    def add(self, batch: DataFrame) -> None:
        """Index the suffixes of a batch of documents and note the heads that they share with others."""
        self.suffixes.append(written(batch, "suffixes", codec="zstd"))
        new = self._array(self.suffixes[-1].groupBy("head").agg(F.count("*").alias("n")))
        own = self.spark.table(new)
        again = own.where("n > 1").select("head")
        for _, level in self.levels:
            again = again.unionByName(own.select("head").join(self.spark.table(level).select("head"), "head"))
        self.again.append(written(again, "heads"))
        self.levels.append((0, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = self.spark.table(a).withColumnRenamed("n", "m").join(self.spark.table(b), "head", "full_outer")
            self.levels.append((rank + 1, self._array(both.select("head", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))))
            self._drop(a)
            self._drop(b)

    def repeated(self) -> DataFrame:
        """All suffixes whose head occurs again."""
        heads = functools.reduce(DataFrame.unionByName, self.again).distinct()
        levels = functools.reduce(DataFrame.unionByName, [self.spark.table(level) for _, level in self.levels])
        heads = written(levels.join(heads, "head").groupBy("head").agg(F.sum("n").alias("n")), "heads")
        every = functools.reduce(DataFrame.unionByName, self.suffixes)
        return join_counted(every, heads, ["head"], every.count())

    def store(self, path: str) -> None:
        """Note at ``path`` where the family's tables are, so that :meth:`stored` finds them in a later session."""
        tables = [("level", rank, self.spark.table(level).inputFiles()) for rank, level in self.levels]
        tables += [(kind, None, df.inputFiles()) for kind, part in (("suffixes", self.suffixes), ("heads", self.again)) for df in part]
        rows = [(k, kind, rank, os.path.dirname(files[0]) if files else None) for k, (kind, rank, files) in enumerate(tables)]
        self.spark.createDataFrame(rows, "k int, kind string, rank int, path string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def stored(cls, spark: SparkSession, path: str, buckets: int | None = None) -> SuffixFamily:
        """A family from the tables that :meth:`store` noted. Its levels are bucketed anew; the tables themselves stay."""
        family = cls(spark, buckets)
        for r in spark.read.parquet(path).orderBy("k").collect():  # a row for each table
            if r.path is None:
                continue
            df = spark.read.parquet(r.path)
            if r.kind == "level":
                family.levels.append((r.rank, family._array(df.repartition(family.buckets, "head"))))
            else:
                (family.suffixes if r.kind == "suffixes" else family.again).append(df)
        return family

    def drop(self) -> None:
        """Delete the family's tables."""
        for _, level in self.levels:
            self._drop(level)
        for df in (*self.suffixes, *self.again):
            drop_written(df)
        self.levels, self.suffixes, self.again = [], [], []


def _blocks(docs: DataFrame, open_kinds: DataFrame) -> DataFrame:
    """The text of the blocks to compare: ``head``, ``kinds``, ``alone``, ``doc``, ``row``, ``start``, ``distance``, ``body``."""
    asked = open_kinds.groupBy(*_ROW).agg(F.collect_list(F.struct("head", "kinds", "alone", "start", "windows", "distance")).alias("asked"))
    names = ["head", "kinds", "alone", "start", "windows", "distance"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                data, ends = byte_view(part.column(2))
                lists = part.column(3)
                flat = lists.flatten()
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                col = {n: flat.field(k) for k, n in enumerate(names)}
                begin = ends[owner] + col["start"].to_numpy()
                stop = begin + col["windows"].to_numpy() + LENGTH - 1
                body = data.tobytes() if len(owner) else b""
                blocks = pa.array([body[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([col["head"], col["kinds"], col["alone"], *[part.column(k).take(pa.array(owner)) for k in (0, 1)], col["start"], col["distance"], blocks], names=["head", "kinds", "alone", *_ROW, "start", "distance", "body"])
        trim()

    return docs.join(asked, _ROW).select(*_ROW, "text", "asked").mapInArrow(cut, "head bigint, kinds bigint, alone boolean, doc bigint, row bigint, start int, distance smallint, body binary")


def _windows(body: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, place in the block, hash) of each window of some blocks."""
    lengths = np.array([len(x) for x in body.to_pylist()], np.int64)
    data = np.frombuffer(b"".join(body.to_pylist()), np.uint8)
    count = lengths - LENGTH + 1
    block = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[block] + place
    return block, place, segment_hashes(data, start, start + LENGTH)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, from blocks sorted by head."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        head, alone, doc, row, first, distance = (table.column(c).to_numpy() for c in ("head", "alone", *_ROW, "start", "distance"))
        block, place, value = _windows(table.column("body").chunk(0))
        where = place - distance[block]
        order = np.lexsort((value, where, head[block]))
        h, w, v = head[block][order], where[order], value[order]
        same = (h[1:] == h[:-1]) & (w[1:] == w[:-1]) & (v[1:] == v[:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= alone[block]
        begin, end = segments(twice, np.flatnonzero(place == 0))
        at = block[begin]
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(row[at]), pa.array((first[at] + place[begin]).astype(np.int32)), pa.array((first[at] + place[end - 1] + LENGTH).astype(np.int32))], names=[*_ROW, "a", "b"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for s in range(0, batch.num_rows, 2000):
            part = batch.slice(s, 2000)
            held.append(part)
            size += part.num_rows
            if size >= 6000:
                table = pa.Table.from_batches(held)
                heads = table.column("head").to_numpy()
                new = np.flatnonzero(heads[1:] != heads[:-1]) + 1
                if len(new):
                    yield spans(table.slice(0, new[-1]))
                    table = table.slice(new[-1])
                held, size = table.to_batches(), table.num_rows
    if size:
        yield spans(pa.Table.from_batches(held))
    trim()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block as stretches of STRETCH windows whose first place is a multiple of STRETCH.

    Where the block does not fill a stretch, zeros stand in; ``lo`` and ``hi`` tell
    where its own bytes are.
    """
    names = ["head", "place", "windows", *_ROW, "a", "lo", "hi", "alone", "body"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in batches:
        for s in range(0, batch.num_rows, 2000):
            part = batch.slice(s, 2000)
            out: list[list] = [[] for _ in names]
            for head, _, alone, doc, row, first, distance, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                begin = LENGTH - distance  # never negative
                low, high = begin // STRETCH * STRETCH, -(-(begin + len(body) - LENGTH + 1) // STRETCH) * STRETCH
                filled = bytes(begin - low) + body
                filled += bytes(high - low + LENGTH - 1 - len(filled))
                for at in range(0, high - low, STRETCH):
                    for column, x in zip(out, (head, low + at, STRETCH, doc, row, first - (begin - low) + at, first, first + len(body), alone, filled[at : at + STRETCH + LENGTH - 1]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)
    trim()


def _many_kinds(blocks: DataFrame) -> DataFrame:
    """Spans of repeated windows at heads with very many kinds of blocks, by halving stretches.

    A stretch equal to another at its place is repeated wholly. If the bytes that
    all its windows have in common occur once, none is repeated. Else its halves
    are looked at. One stretch of each kind goes on, so a block leaves a few rows in
    a round, and rows that many documents share are summed before the shuffle.
    """
    now = written(blocks.mapInArrow(_stretches, "head bigint, place int, windows int, doc bigint, row bigint, a int, lo int, hi int, alone boolean, body binary"), "stretches")
    at = ["head", "place", "windows"]
    found = None
    while not now.isEmpty():
        # what reaches beyond a block's own bytes equals nothing else
        whole = F.expr(f"a >= lo AND a + windows + {LENGTH - 1} <= hi")
        named = now.withColumn("all", F.when(whole, F.xxhash64("body")).otherwise(F.xxhash64("body", *_ROW, "lo")))
        kinds = named.groupBy(*at, "all").agg(F.count("*").alias("n"), F.min(F.struct(*_ROW, "a", "lo", "hi", "alone", "body")).alias("one"))
        kinds = written(kinds, "kinds")
        several = kinds.where("n > 1").select(*at, "all")
        spans = named.where("alone").join(several, [*at, "all"]).select(*_ROW, "a", (F.col("a") + F.col("windows") + LENGTH - 1).alias("b"))
        spans = written(spans, "spans")
        found = spans if found is None else found.unionByName(spans)
        core = F.expr(f"xxhash64(substring(one.body, windows, {LENGTH + 1} - windows))")
        kinds = kinds.where(f"windows > 1 AND one.a + windows - 1 >= one.lo AND one.a + {LENGTH} <= one.hi")
        kinds = kinds.select(*at, "one.doc", "one.row", "one.a", "one.lo", "one.hi", (F.col("one.alone") & (F.col("n") == 1)).alias("alone"), "one.body", core.alias("core"))
        mixed = kinds.groupBy(*at, "core").agg(F.count("*").alias("n"), F.max("alone").alias("any")).where("n > 1 AND any").select(*at, "core")
        half = F.expr("windows div 2").cast("int")
        cut = lambda skip: F.expr(f"substring(body, {skip} + 1, windows div 2 + {LENGTH - 1})")
        halves = F.array(
            F.struct(F.col("place").alias("place"), F.col("a").alias("a"), cut("0").alias("body")),
            F.struct((F.col("place") + half).alias("place"), (F.col("a") + half).alias("a"), cut("windows div 2").alias("body")),
        )
        going = kinds.join(mixed, [*at, "core"]).select("head", half.alias("windows"), *_ROW, "lo", "hi", "alone", F.explode(halves).alias("h"))
        now = written(going.select("head", "h.place", "windows", *_ROW, "h.a", "lo", "hi", "alone", "h.body"), "stretches")
    return found


def repeated_spans(docs: DataFrame, family: SuffixFamily) -> DataFrame:
    """Spans (``doc``, ``row``, ``a``, ``b``) of the documents' bytes that stand in a repeated window, not merged."""
    found = written(family.repeated(), "repeated")
    same = ["head", "block", "windows"]
    kinds = written(found.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct(*_ROW, "start", "distance")).alias("one")), "kinds")
    several = kinds.where("n > 1").select(*same, "n")
    whole = join_counted(found, several, same, found.count()).select(*_ROW, F.col("start").alias("a"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("b"))
    open_heads = kinds.groupBy("head").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("head", "kinds")
    open_kinds = kinds.join(open_heads, "head").select("head", "kinds", (F.col("n") == 1).alias("alone"), "one.doc", "one.row", "one.start", "windows", "one.distance")
    blocks = written(_blocks(docs, open_kinds), "blocks")
    few = blocks.where(F.col("kinds") <= KINDS).repartition("head").sortWithinPartitions("head")
    parts = few.mapInArrow(_compare, "doc bigint, row bigint, a int, b int")
    many = blocks.where(F.col("kinds") > KINDS)
    if not many.isEmpty():
        parts = parts.unionByName(_many_kinds(many))
    spans = written(whole.unionByName(parts), "spans")
    for df in (found, kinds, blocks):
        drop_written(df)
    return spans


def drop_repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``.

    Bytes inside a 200-byte string that also starts elsewhere, in the same or in
    another row, are removed; what is left is joined. Null texts count as empty.
    Rows equal in id and text are copies of each other like any two rows. Other
    columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ident = F.col(doc_id).cast("bigint")
    keyed = docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(ident.isNull(), body).alias("row"), body.alias("text"))
    family = SuffixFamily(docs.sparkSession)
    for k in range(batches):
        part = keyed.where(F.pmod(F.shiftright("row", 7), F.lit(batches)) == k)
        family.add(suffixes(part.select(*_ROW, "text")))
    spans = repeated_spans(keyed.select(*_ROW, "text"), family)
    family.drop()
    released(docs.sparkSession)
    per_row = spans.groupBy(*_ROW).agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                data, ends = byte_view(part.column(1))
                lists = part.column(2)
                out, total, gone, count = [], np.diff(ends), [], []
                for r in range(part.num_rows):
                    own = data[ends[r] : ends[r + 1]]
                    if not lists[r].is_valid:
                        out.append(own.tobytes())
                        gone.append(0)
                        count.append(0)
                        continue
                    flat = lists[r].values
                    change = np.zeros(len(own) + 1, np.int32)
                    np.add.at(change, flat.field(0).to_numpy(), 1)
                    np.add.at(change, flat.field(1).to_numpy(), -1)
                    cut = np.cumsum(change)[:-1] > 0
                    out.append(own[~cut].tobytes())
                    gone.append(int(cut.sum()))
                    count.append(len(segments(cut, np.array([0, len(cut)]))[0]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()), pa.array(total), pa.array(gone, pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])
        trim()

    joined = keyed.join(per_row, _ROW, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(apply, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
