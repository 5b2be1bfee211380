"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that differ in at most ``MAX_DIFFER`` bits agree wholly in two of six
pieces of their bits, so each distinct fingerprint is filed under the 15 masks of
two pieces; a mask and its bits are a bucket. In a bucket the fingerprints are
sorted by Gray rank, in which neighbours differ in few bits, and each ``FAN``
neighbours form a node that holds the bits on which all of them agree; ``FAN``
nodes form a node of the next level, up to one root. Pairs of nodes are compared
from the root down on the bits that both patterns have and their parents' did not;
the differences add up, and a pair of nodes with too many is dropped with all that
stands below. Of the pairs that a task finds in a bucket only a spanning forest
leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.shared import LOWER, NOT_SPACE, join_counted, load, runs, segments, written

WORDS = 4
SEED = 42
MAX_DIFFER = 4
#: Widths of the pieces from the top bit; MAX_DIFFER + 2 pieces, so two of them always agree.
PIECES = (11, 11, 11, 11, 10, 10)
#: Children of a node of the index.
FAN = 8
#: Fingerprints in a bucket that one task takes; larger buckets are dealt out as pairs of blocks.
BLOCK = 20_000
#: Pairs of nodes looked at in one step.
STEP = 1 << 20


def fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text; zero without words."""
    parts = [np.zeros(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for _, data, offsets in runs(column):
        n = len(offsets) - 1
        inside = NOT_SPACE[data]
        starts, ends = segments(inside, offsets)
        # one space after each word, other white space dropped
        keep = inside.copy()
        keep[ends[ends < len(data)]] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        text = np.where(inside, LOWER[data], np.uint8(32))[keep].tobytes()
        starts, ends, first = place[starts], place[ends], np.searchsorted(starts, offsets)
        count = np.diff(first)
        shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        total, begin = shingles.sum(), np.cumsum(shingles) - shingles
        head = np.repeat(first[:-1] - begin, shingles) + np.arange(total)
        tail = head + np.repeat(np.minimum(count, words), shingles) - 1
        out = np.zeros(n, np.uint64)
        some = np.flatnonzero(shingles)
        if total:
            hashes = np.array([digest(text[s:e], SEED) for s, e in zip(starts[head].tolist(), ends[tail].tolist(), strict=True)], np.uint64)
            ones = np.zeros((len(some), 64), np.int64)
            for lo in range(0, total, 1 << 17):  # in steps, as a bit takes a byte here
                hi = min(total, lo + (1 << 17))
                bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                a, b = np.searchsorted(begin[some], lo, "right") - 1, np.searchsorted(begin[some], hi)
                ones[a:b] += np.add.reduceat(bits, np.maximum(begin[some][a:b] - lo, 0), axis=0, dtype=np.int64)
            over = 2 * ones > shingles[some][:, None]
            out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
        parts.append(out)
    return np.concatenate(parts)


def with_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(``doc_id``, ``fp``) of each row; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), words).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def masks() -> list[int]:
    ends = np.cumsum(PIECES)
    pieces = [((1 << w) - 1) << int(64 - e) for w, e in zip(PIECES, ends, strict=True)]
    return [a | b for a, b in combinations(pieces, 2)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _roots(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (a, b) to what ``label`` has joined; each label is the least entry of its set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def gray_index(bucket: np.ndarray, fp: np.ndarray, fan: int = FAN) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of nodes from the fingerprints up: (first child, bucket, shared bits, their values).

    ``fp`` is sorted by bucket and Gray rank. On the lowest level a node is a
    fingerprint, and on the last each bucket has one node.
    """
    levels = [(np.arange(len(fp)), bucket, np.full(len(fp), np.iinfo(np.uint64).max), fp)]
    while True:
        _, own, same, value = levels[-1]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        if not place.any():
            return levels
        first = np.flatnonzero(place % fan == 0)
        ones, any_ones = np.bitwise_and.reduceat(value, first), np.bitwise_or.reduceat(value, first)
        shared = np.bitwise_and.reduceat(same, first) & ~(ones ^ any_ones)
        levels.append((first, own[first], shared, ones & shared))


def linked(bucket: np.ndarray, fp: np.ndarray, differ: int = MAX_DIFFER) -> np.ndarray:
    """For each entry the least entry reachable over pairs of one bucket with at most ``differ`` differing bits.

    Entries are distinct in a bucket and sorted by bucket and Gray rank.
    """
    label = np.arange(len(fp))
    if not len(fp):
        return label
    levels = gray_index(bucket, fp)
    roots = np.arange(len(levels[-1][0]))
    zero = np.zeros(len(roots), np.uint64)
    # ranges of nodes of a level that are still to be compared with each other; the differences so far, and the bits they were counted on
    work = [(len(levels) - 1, roots, roots + 1, roots, roots + 1, zero.astype(np.uint8), zero)]
    while work:
        level, *part = work.pop()
        a0, a1, b0, b1, gone, seen = part
        size = (a1 - a0) * (b1 - b0)
        if size.sum() > STEP and len(size) > 1:
            half = min(max(1, int(np.searchsorted(np.cumsum(size), size.sum() // 2))), len(size) - 1)
            work += [(level, *(x[k] for x in part)) for k in (slice(half), slice(half, None))]
            continue
        pair = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        width = (b1 - b0)[pair]
        a, b = a0[pair] + k // width, b0[pair] + k % width
        ok = a <= b if level else a < b
        a, b, gone, seen = a[ok], b[ok], gone[pair[ok]], seen[pair[ok]]
        first, _, shared, value = levels[level]
        both = shared[a] & shared[b]
        gone = gone + np.bitwise_count((value[a] ^ value[b]) & both & ~seen)
        ok = gone <= differ
        a, b, gone, seen = a[ok], b[ok], gone[ok], both[ok]
        if not len(a):
            continue
        if level == 0:
            label = _roots(a, b, label)
        else:
            end = np.append(first, len(levels[level - 1][0]))
            work.append((level - 1, first[a], end[a + 1], first[b], end[b + 1], gone, seen))
    return label


def near_links(fps: DataFrame, *, fp: str = "fp", differ: int = MAX_DIFFER, block: int = BLOCK) -> DataFrame:
    """Links (``a``, ``b``) that join the same fingerprints as all pairs that differ in at most ``differ`` bits.

    ``fps`` has distinct fingerprints and is read twice. A bucket of more than
    ``block`` fingerprints is divided into blocks and each pair of blocks is a bucket.
    """
    assert differ <= len(PIECES) - 2
    # masks as signed 64-bit literals
    signed = [m - (1 << 64) if m >> 63 else m for m in masks()]
    filed = fps.select(F.col(fp).alias("fp"), F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "bits"))
    filed = filed.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    large = filed.groupBy("mask", "bits").count().where(F.col("count") > block)
    large = written(large.select("mask", "bits", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "buckets")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        divided = filed.join(large, ["mask", "bits"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        divided = divided.select("fp", "mask", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        filed = filed.join(large, ["mask", "bits"], "left_anti").select("fp", "mask", "bits", "lo", "hi").unionByName(divided)
    keys = ["mask", "bits", "lo", "hi"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(fp, bucket):
            order = np.lexsort((gray_rank(fp), bucket))
            fp, bucket = fp[order], bucket[order]
            label = linked(bucket, fp, differ)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fp[at], fp[label[at]])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
            if size >= 1 << 17:
                fp, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
                if len(new):
                    cut = new[-1]
                    bucket = np.searchsorted(new, np.arange(cut), "right")
                    yield out(fp[:cut].view(np.uint64), bucket)
                    held, size = [[x[cut:] for x in (fp, *cols)]], len(fp) - cut
                else:
                    held = [[fp, *cols]]
        if size:
            fp, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            yield out(fp.view(np.uint64), np.searchsorted(new, np.arange(len(fp)), "right"))

    return filed.repartition(*keys).sortWithinPartitions(*keys).select("fp", *keys).mapInArrow(search, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, differ: int = MAX_DIFFER) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the least id that links of at most ``differ`` bits lead to,
    the row's own included; null only where no linked row has an id. Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows
    and ids stay. Other columns are not read.
    """
    marked = written(with_fingerprints(docs, doc_id=doc_id, text=text, words=words), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(fps.select("fp"), differ=differ), "a", "b")
    rooted = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "root", "first")
    members = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    grouped = join_counted(rooted, members, ["root"], fps.count()).select("fp", "component_id")
    component = written(fps.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "components")
    joined = join_counted(marked, component, ["fp"], marked.count())
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents"))
