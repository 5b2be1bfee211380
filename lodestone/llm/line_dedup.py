"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is a sequence of line ids. In round k every position has the rank of the
2**k lines that begin there among all such prefixes that occur twice or more: the
suffix array sorted to depth 2**k. The ranks of the next round number the pairs of
the ranks at a position and 2**k lines on, in their order. Positions whose prefix
occurs once leave the array, as no other suffix shares those lines. The positions
of one rank are an interval of the array whose longest common prefix has at least
2**k lines; those of them whose ranks also agree where a prefix of n lines (2**k to
2**(k+1)) has its last 2**k lines form the interval of common prefix n.

In an interval of n lines, all positions but the first in the corpus are later
copies of a repeated run. A line is deleted if it stands in a later copy with at
least ``MIN_WORDS`` words in all. Overlapping copies join to maximal runs. Not all n
need be looked at: every line of such a run stands in the shortest sufficient run
that begins at the run's first line, or in the shortest one that ends at the line
itself. So a line asks for at most two intervals, and as equal lines have equal
words, all positions of an interval ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import NOT_SPACE, drop_written, join_counted, load, plain_names, runs, segments, trim, written
from lodestone.operators.metrics import numbered

MIN_WORDS = 50
_KEY = ["d", "key"]
_AT = [*_KEY, "line"]


def sufficient_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of the shortest runs of at least ``least`` words from and up to each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)  # run at[i] .. end[i] - 1
    ok = end <= n
    forward = np.column_stack([at[ok], end[ok] - at[ok]])
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    ok = total[1:] >= least
    backward = np.column_stack([start[ok], at[ok] + 1 - start[ok]])
    both = np.unique(np.concatenate([forward, backward]), axis=0)
    return both[:, 0], both[:, 1]


def document_keys(doc_id: str, text: str) -> list:
    """Columns ``d`` (the id, least for null) and ``key`` (a hash of the text): rows with equal ones are one document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col(doc_id).isNull(), body).alias("key")]


def line_table(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per line of ``docs`` (``d``, ``key``, ``text``): ``d``, ``key``, ``line``, a 128-bit id (``low``, ``high``) and ``runs``.

    ``runs`` has the lengths, in lines, of the sufficient runs that begin at the line.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch.column(2)):
                body = data.tobytes()
                word_starts, _ = segments(NOT_SPACE[data], offsets)
                breaks = np.flatnonzero(data == 0x0A)
                doc, line, ids, lengths, sizes = [], [], [], [], []
                for r in range(len(offsets) - 1):
                    lo, hi = offsets[r], offsets[r + 1]
                    inner = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)]
                    starts, ends = np.append(lo, inner + 1), np.append(inner, hi)
                    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
                    first, lines = sufficient_runs(words, min_words)
                    doc.append(np.full(len(starts), r + rows.start))
                    line.append(np.arange(len(starts)))
                    ids += [xxhash.xxh3_128_digest(body[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    lengths.append(lines)
                    sizes.append(np.bincount(first, minlength=len(starts)))
                at = pa.array(np.concatenate(doc))
                low, high = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2).T
                asked = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), pa.array(np.concatenate(lengths), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(line), pa.int32()), pa.array(low.copy()), pa.array(high.copy()), asked],
                    names=[*_AT, "low", "high", "runs"],
                )

    return docs.select(*_KEY, "text").mapInArrow(cut, "d bigint, key bigint, line int, low bigint, high bigint, runs array<int>")


def _ranks(prefixes: DataFrame, by: list[str]) -> DataFrame:
    """Ranks (``rank``) and counts (``n``) of the prefixes that occur more than once, in the order of ``by``."""
    often = prefixes.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    return written(numbered(often, *[F.col(c) for c in by], name="rank"), "numbers")


def later_copies(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame | None:
    """Runs of lines that also begin earlier: ``d``, ``key``, ``line`` (first), ``lines``; None without any.

    ``docs`` has ``d``, ``key`` and ``text``, rows equal in the first two once. Each
    round's tables are written out, and deleted when the next are.
    """
    lines = written(line_table(docs, min_words=min_words), "lines")
    total = lines.count()
    numbers = _ranks(lines, ["low", "high"])
    ranked = written(join_counted(lines, numbers, ["low", "high"], total).select(*_AT, "rank", "runs"), "ranks")
    drop_written(numbers)
    drop_written(lines)
    asked = written(ranked.select(*_AT, F.explode("runs").alias("lines")).withColumn("level", F.floor(F.log2("lines")).cast("int")), "asked")
    deepest = asked.agg(F.max("level")).first()[0]
    if deepest is None:
        return None
    ranked, found, level = ranked.select(*_AT, "rank"), None, 0
    while True:
        step = 1 << level
        interval = asked.where(F.col("level") == level).drop("level").join(ranked.withColumnRenamed("rank", "head"), _AT)
        if level:
            tails = ranked.select(*_KEY, F.col("line").alias("tail_line"), F.col("rank").alias("tail"))
            interval = interval.withColumn("tail_line", F.col("line") + F.col("lines") - step).join(tails, [*_KEY, "tail_line"]).drop("tail_line")
        else:
            interval = interval.withColumn("tail", F.col("head"))
        interval = written(interval, "intervals")
        same = ["head", "tail", "lines"]
        firsts = written(interval.groupBy(*same).agg(F.min(F.struct(*_AT)).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
        copies = join_counted(interval, firsts, same, total).where(F.struct(*_AT) > F.col("first")).select(*_AT, "lines")
        copies = written(copies, "copies")
        drop_written(interval)
        drop_written(firsts)
        found = copies if found is None else found.unionByName(copies)
        if level == deepest:
            break
        ahead = ranked.select(*_KEY, (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
        pairs = written(ranked.withColumnRenamed("rank", "first").join(ahead, _AT), "pairs")
        drop_written(ranked)
        numbers = _ranks(pairs, ["first", "next"])
        ranked = written(join_counted(pairs, numbers, ["first", "next"], total).select(*_AT, "rank"), "ranks")
        drop_written(numbers)
        drop_written(pairs)
        if ranked.isEmpty():
            break
        level += 1
    drop_written(ranked)
    drop_written(asked)
    return found


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut, and two new columns: ``n_lines`` and ``n_lines_removed``.

    Positions are in the order of ``doc_id`` (null first), a hash of the text, and
    the line; rows equal in id and text are one document and are all cut alike.
    Null texts stay null, other texts are their kept lines joined by newlines.
    All other columns are passed on, whatever their names; columns named like the
    two new ones are replaced.
    """
    docs = docs.drop("n_lines", "n_lines_removed")
    plain = plain_names(docs)
    names = dict(zip(docs.columns, plain.columns, strict=True))
    body = names[text]
    keyed = plain.withColumn(body, F.col(body).cast("string")).select("*", *document_keys(names[doc_id], body))
    # rows equal in id and text count once
    every = keyed.select(*_KEY, F.col(body).alias("text"))
    repeated = written(every.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*_KEY), "repeated")
    if not repeated.isEmpty():
        every = every.join(repeated, _KEY, "left_anti").unionByName(every.join(repeated, _KEY, "left_semi").dropDuplicates(_KEY))
    copies = later_copies(every, min_words=min_words)
    if copies is None:
        joined = keyed.withColumn("cuts", F.lit(None).cast("array<struct<line:int,lines:int>>"))
    else:
        cuts = copies.groupBy(*_KEY).agg(F.collect_list(F.struct("line", "lines")).alias("cuts"))  # at most two for each line of the document
        joined = keyed.join(cuts, _KEY, "left")
    keep = [c for c in plain.columns if c != body]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                texts, counts, gone = [], [], []
                for whole, found in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True):
                    counts.append(0 if whole is None else whole.count("\n") + 1)
                    if found:
                        lines = whole.split("\n")
                        change = np.zeros(len(lines) + 1, np.int64)
                        for run in found:
                            change[run["line"]] += 1
                            change[run["line"] + run["lines"]] -= 1
                        left = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                        gone.append(len(lines) - len(left))
                        whole = "\n".join([lines[i] for i in left])
                    else:
                        gone.append(0)
                    texts.append(whole)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, body, "n_lines", "n_lines_removed"])
        trim()

    schema = joined.select(*keep).schema.add(body, "string").add("n_lines", "long").add("n_lines_removed", "long")
    out = joined.select(*keep, body, "cuts").mapInArrow(apply, schema)
    return out.select(*[F.col(v).alias(k) for k, v in names.items()], "n_lines", "n_lines_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_lines_removed", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
