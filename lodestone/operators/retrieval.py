"""Batches of queries against chunks: top-k, filters, fusion, modes and refusal.

A query table has ``query_id`` and ``q_vec``; a chunk table has ``chunk_id``,
``source``, ``anchor``, ``folder``, ``tags``, ``content`` and ``vec``. Results carry
``query_id``, the chunk's columns, ``score`` and ``rank``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions import text as T
from lodestone.session import written

#: Queries that are sent to all tasks at once; more are taken in blocks of so many, or of so many bytes.
QUERY_BLOCK = 10_000
BLOCK_BYTES = 64 << 20
#: Pairs of a query and a chunk that a task scores in one step.
TILE = 1 << 21
QUERIES_AT_ONCE = 1_024
#: Rows of an Arrow batch that a search hands on.
OUT_ROWS = 20_000
#: The reasons of a refusal.
NO_EVIDENCE, LOW_SCORE, NOT_CITABLE = "未检索到足够证据", "最高检索相关度低于可靠回答阈值", "检索片段缺少可追溯的路径、anchor 或原文"


def ranked(df: DataFrame, k: int | None, *order: Column, by: tuple[str, ...] = ("query_id",), rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. Spark cuts each task's rows to ``k`` before the shuffle."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(rank) <= k)


def _best(place: np.ndarray, chunk: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best pairs of each query; of equal scores those whose chunk comes first in the order of keys."""
    order = np.lexsort((place[chunk], -score, query))
    chunk, query, score = chunk[order], query[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return chunk[keep], query[keep], score[keep]


def _nearest(v: np.ndarray, q: np.ndarray, place: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row of ``v``, row of ``q``, score) of the ``k`` best rows of ``v`` for each row of ``q``.

    A matrix product finds the candidates, with a margin for its rounding; their scores
    are then added in the order of the dimensions, so equal vectors have equal scores.
    Pairs below ``floor``, a score for each row of ``q``, are left out. Some queries are taken
    at a time, and what is below their k-th score so far is dropped, so that memory hangs on
    ``TILE`` and on the hits.
    """
    size = np.sqrt((v * v).sum(1).max())
    found = []
    for at in range(0, len(q), QUERIES_AT_ONCE):
        part = q[at : at + QUERIES_AT_ONCE]
        margin = 1e-9 * size * np.sqrt((part * part).sum(1))
        least = np.full(len(part), -np.inf) if floor is None else floor[at : at + QUERIES_AT_ONCE] - margin
        kept, fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        step = max(1, TILE // len(part))
        for lo in range(0, len(v), step):
            rough = part @ v[lo : lo + step].T
            over = rough >= least[:, None]
            many = np.flatnonzero(np.count_nonzero(over, axis=1) > k)
            if len(many):
                some = rough[many]
                least[many] = np.maximum(least[many], np.partition(some, -k, axis=1)[:, -k] - margin[many])
                over[many] = some >= least[many, None]
            query, chunk = np.nonzero(over)
            chunk = chunk + lo
            score = np.zeros(len(query))
            for j in range(v.shape[1]):
                score += part[query, j] * v[chunk, j]
            fresh.append((chunk, query, score))
            if lo + step >= len(v) or sum(len(x[1]) for x in fresh) > max(2 * k * len(part), TILE // 16):
                kept, fresh = _best(place, *(np.concatenate(x) for x in zip(kept, *fresh, strict=True)), k), []
                n = np.bincount(kept[1], minlength=len(part))
                full = np.flatnonzero(n >= k)
                last = np.cumsum(n)[full] - 1
                least[full] = np.maximum(least[full], kept[2][last] - margin[full])
        found.append((kept[0], kept[1] + at, kept[2]))
    chunk, query, score = (np.concatenate(x) for x in zip(*found, strict=True))
    if floor is not None:
        good = score >= floor[query]
        chunk, query, score = chunk[good], query[good], score[good]
    return chunk, query, score


def _raised(best: np.ndarray, query: np.ndarray, score: np.ndarray) -> np.ndarray:
    """``best``, the ``k`` greatest scores of each query so far in rising order, with the scores of more hits, which are sorted by query and fall."""
    if not len(query):
        return best
    rows, first, n = np.unique(query, return_index=True, return_counts=True)
    k = best.shape[1]
    for lo in range(0, len(rows), QUERIES_AT_ONCE):
        own, begin, size = (x[lo : lo + QUERIES_AT_ONCE] for x in (rows, first, n))
        col = np.arange(k)
        more = np.where(col < size[:, None], score[np.minimum(begin[:, None] + col, len(score) - 1)], -np.inf)
        best[own] = np.sort(np.concatenate([best[own], more], axis=1), axis=1)[:, -k:]
    return best


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, *, key: str = "chunk_id", where: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of ``chunks`` for each query, by exact score; ties by ``key``.

    ``where`` is applied before scoring, so it reaches the scan. The query set is
    sent to all tasks in blocks of at most ``block`` rows and ``BLOCK_BYTES``; the chunk
    table is read once a block, with the columns that are given here. A task keeps the ``k``
    best scores of each query, and hands on only rows of a batch that reach them. A vector that is null, of another length than the query's or holds
    a null or no finite number is no hit, and such a query has none.
    """
    spark = chunks.sparkSession
    if where is not None:
        chunks = chunks.where(where)
    rest = [c for c in chunks.columns if c != "vec"]
    schema = StructType([*[chunks.schema[c] for c in rest], queries.schema["query_id"], StructField("score", DoubleType())])
    out = None

    def search(shared, width):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            so_far = np.full((len(q), k), -np.inf)
            for batch in batches:
                vec = batch.column("vec")
                rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vec), width), False).to_numpy(zero_copy_only=False))
                v = vec.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
                whole = np.isfinite(v).all(axis=1)
                rows, v = rows[whole], v[whole]
                if not len(rows):
                    continue
                place = np.empty(batch.num_rows, np.int64)
                place[pc.sort_indices(batch.column(key), null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
                chunk, query, score = _nearest(v, q, place[rows], k, so_far[:, 0])
                so_far = _raised(so_far, query, score)
                for lo in range(0, len(query), OUT_ROWS):
                    some = slice(lo, lo + OUT_ROWS)
                    at = pa.array(rows[chunk[some]])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in rest], ids.take(pa.array(query[some])), pa.array(score[some])], names=schema.names)

        return run

    for width, n in queries.where(F.size("q_vec") > 0).groupBy(F.size("q_vec")).count().collect():  # a row for each length
        blocks = -(-n // max(1, min(block, BLOCK_BYTES // (8 * width))))
        for b in range(blocks):
            part = queries.where((F.size("q_vec") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
            held = part.select("query_id", F.col("q_vec").cast("array<double>")).toArrow()
            q = held["q_vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(q).all(axis=1)
            if not good.any():
                continue
            shared = spark.sparkContext.broadcast((held["query_id"].combine_chunks().filter(pa.array(good)), q[good]))
            best = ranked(chunks.mapInArrow(search(shared, width), schema), k, F.desc("score"), F.asc(key))
            out = best if out is None else out.unionByName(best)
    return ranked(spark.createDataFrame([], schema), k, F.desc("score"), F.asc(key)) if out is None else out


def topk_per_source(asked: DataFrame, chunks: DataFrame, k: int, *, score: Column, key: str = "chunk_id") -> DataFrame:
    """For each (``query_id``, ``source``) asked for, the ``k`` best chunks of that source."""
    return ranked(asked.join(chunks, "source").withColumn("score", score), k, F.desc("score"), F.asc(key), by=("query_id", "source"), rank="source_rank")


#: Chunks and askings that one task scores against each other at a time.
CELL_ROWS = 20_000


def dealt_in_cells(asked: DataFrame, chunks: DataFrame, key: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """Askings and chunks with ``cell_name``, what meets what, and ``bucket``, what a task holds at a time: about two cells of rows at most.

    A cell of a source with more than an eighth of ``cell`` rows is a bucket; such sources are at most eight in ``cell``
    rows, and are broadcast with their numbers of cells. Smaller sources share buckets by hash.
    """
    sizes = asked.groupBy("source").agg(F.count("*").alias("qs"), F.lit(0).cast("bigint").alias("cs")).unionByName(chunks.groupBy("source").agg(F.lit(0).cast("bigint").alias("qs"), F.count("*").alias("cs")))
    sizes = written(sizes.groupBy("source").agg(F.sum("qs").alias("qs"), F.sum("cs").alias("cs")), "cells")
    shared = max(1, -(-4 * (sizes.agg(F.sum(F.col("qs") + F.col("cs"))).first()[0] or 0) // cell))
    large = sizes.where((F.col("qs") + F.col("cs")) * 8 > cell).select("source", *[F.greatest(F.ceil(F.col(c) / cell), F.lit(1)).cast("int").alias(f"cell_{c}") for c in ("qs", "cs")])

    def dealt(df, own, other, by):
        out = df.where("source IS NOT NULL").join(F.broadcast(large), "source", "left")
        mine = F.pmod(F.xxhash64(by), F.coalesce(f"cell_{own}", F.lit(1))).cast("int")
        out = out.withColumn(f"in_{own}", mine).withColumn(f"in_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"cell_{other}", F.lit(1)) - 1)))
        name = F.concat_ws("/", "in_qs", "in_cs", "source")
        few = F.concat(F.lit("shared/"), F.pmod(F.xxhash64("source"), F.lit(shared)).cast("string"))
        return out.withColumn("cell_name", name).withColumn("bucket", F.when(F.col("cell_qs").isNull(), few).otherwise(F.col("cell_name"))).drop("cell_qs", "cell_cs", "in_qs", "in_cs")

    return dealt(asked, "qs", "cs", "query_id"), dealt(chunks, "cs", "qs", key)


def vector_topk_per_source(asked: DataFrame, chunks: DataFrame, k: int, *, key: str = "chunk_id", cell: int = CELL_ROWS) -> DataFrame:
    """Like :func:`topk_per_source` with the inner product of ``q_vec`` and ``vec``, by matrix products.

    A source's chunks and its askings are dealt into cells of about ``cell`` rows a
    side, every cell of the one against every cell of the other, so a source with a
    third of all chunks is scored by many tasks; small sources share a bucket
    (:func:`dealt_in_cells`). Each cell hands on the ``k`` best chunks of each asking, and a worker holds one bucket. Vectors that are null, of
    another length than the query's, or hold a null or no finite number are no hits.
    """
    left_names, right_names = [c for c in asked.columns if c != "q_vec"], [c for c in chunks.columns if c not in ("vec", "source")]
    schema = StructType([*[asked.schema[c] for c in left_names], *[chunks.schema[c] for c in right_names], StructField("score", DoubleType())])

    def vectors(table: pa.Table, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        vec = table.column(name).combine_chunks()
        rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vec), width), False).to_numpy(zero_copy_only=False))
        v = vec.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
        whole = np.isfinite(v).all(axis=1)
        return rows[whole], v[whole]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            names = pa.chunked_array([*left.column("cell_name").chunks, *right.column("cell_name").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            place = np.empty(right.num_rows, np.int64)
            place[pc.sort_indices(right.column(key), null_placement="at_start").to_numpy()] = np.arange(right.num_rows)
            for width in pc.unique(pc.list_value_length(left.column("q_vec"))).to_pylist():
                if not width:
                    continue
                (q_rows, q), (c_rows, v) = vectors(left, "q_vec", width), vectors(right, "vec", width)
                q_cell, c_cell = names[q_rows], names[left.num_rows + c_rows]
                q_order, c_order = np.argsort(q_cell, kind="stable"), np.argsort(c_cell, kind="stable")
                for x in np.intersect1d(q_cell, c_cell):
                    qs = q_order[slice(*np.searchsorted(q_cell[q_order], [x, x + 1]))]
                    cs = c_order[slice(*np.searchsorted(c_cell[c_order], [x, x + 1]))]
                    for part in np.array_split(qs, -(-len(qs) // 1024)):
                        chunk, query, value = _nearest(v[cs], q[part], place[c_rows[cs]], k)
                        for out, more in zip(found, (q_rows[part][query], c_rows[cs][chunk], value), strict=True):
                            out.append(more)
        at_q, at_c, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        columns = [*[left.column(c).take(pa.array(at_q)) for c in left_names], *[right.column(c).take(pa.array(at_c)) for c in right_names], pa.array(value.astype(np.float64))]
        return pa.table(columns, names=schema.names)

    asks, has = dealt_in_cells(asked, chunks, key, cell)
    asks, has = asks.toDF(*asks.columns), has.toDF(*has.columns)  # both may come from one table
    best = asks.groupBy("bucket").cogroup(has.groupBy("bucket")).applyInArrow(score, schema)
    return ranked(best, k, F.desc("score"), F.asc(key), by=("query_id", "source"), rank="source_rank")


def keep_tagged(hits: DataFrame, tag: str) -> DataFrame:
    """Hits whose ``tags`` hold the tag, exactly and in the same case; taken after the top-k."""
    return hits.where(F.array_contains("tags", tag))


def above(hits: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return hits.where(F.col(score) >= threshold)


def best_per_place(hits: DataFrame, *, by: tuple[str, ...] = ("source", "anchor"), key: str = "chunk_id") -> DataFrame:
    """One hit for each place of a query: the best, ties by ``key``."""
    return ranked(hits, 1, F.desc("score"), F.asc(key), by=("query_id", *by), rank="place_rank").drop("place_rank")


def basic_retrieval(queries: DataFrame, chunks: DataFrame, *, k: int = 10, threshold: float = 0.35, where: Column | None = None, tag: str | None = None) -> DataFrame:
    """Top-k (five times as many if a tag is asked for), tag, threshold, one hit a place, top-k."""
    hits = vector_topk(queries, chunks, 5 * k if tag else k, where=where).drop("rank")
    hits = keep_tagged(hits, tag) if tag else hits
    return ranked(best_per_place(above(hits, threshold)), k, F.desc("score"), F.asc("chunk_id"))


def capped(hits: DataFrame, most: int = 5) -> DataFrame:
    return hits.where(F.col("rank") <= most)


def best_hits(hits: DataFrame, most: int = 30) -> DataFrame:
    """One graph hit for each source of a query, the best ``most`` of them, with ``graph_rank``."""
    one = ranked(hits, 1, F.desc("graph_score"), F.asc("path"), by=("query_id", "source"), rank="r").drop("r")
    return ranked(one, most, F.desc("graph_score"), F.asc("source"), rank="graph_rank")


def fused(base: DataFrame, expanded: DataFrame, *, graph_weight: float = 0.25, threshold: float = 0.35) -> DataFrame:
    """Reciprocal-rank fusion of vector hits and chunks found through the graph.

    ``base`` has ``query_id, source, anchor, score, rank``; ``expanded`` has ``query_id,
    source, anchor, score, graph_score, graph_rank``. A chunk that only the graph
    found gets the next vector rank after the base hits, in graph order.
    """
    place = ["query_id", "source", "anchor"]
    counts = base.groupBy("query_id").agg(F.max("rank").alias("n_base"))
    graph = ranked(expanded.select(*place, F.col("score").alias("g_text"), "graph_score", "graph_rank"), None, F.asc("graph_rank"), F.asc("anchor"), rank="offset").join(counts, "query_id", "left")
    both = base.select(*place, F.col("score").alias("b_text"), F.col("rank").alias("vector_rank")).join(graph, place, "full_outer")
    text = F.greatest("b_text", "g_text")
    vector_rank = F.coalesce("vector_rank", F.coalesce("n_base", F.lit(0)) + F.col("offset"))
    graph_score = F.coalesce("graph_score", F.lit(0.0))
    final = F.when(graph_score > 0, (1 - F.lit(graph_weight)) * text + F.lit(graph_weight) * graph_score).otherwise(text)
    rank_score = 1 / (60 + vector_rank) + F.when(F.col("graph_rank").isNotNull(), F.lit(graph_weight) / (60 + F.col("graph_rank"))).otherwise(F.lit(0.0))
    out = both.select(*place, text.alias("text_score"), graph_score.alias("graph_score"), "graph_rank", final.alias("final"), rank_score.alias("rank_score"))
    out = out.where(F.col("final") >= threshold)
    out = ranked(out, None, F.desc("rank_score"), F.desc("final"), F.asc("source"), F.asc("anchor"))
    return out.withColumn("score", F.least(F.lit(1.0), "final")).drop("final")


def community_sources(matches: DataFrame, members: DataFrame, evidence: DataFrame, most: int = 30) -> DataFrame:
    """Sources behind the matched communities: ``query_id, source, community_score, community_ids``, the best ``most``.

    A community contributes its first ``most`` sources in the order of their names.
    """
    of = members.join(evidence.select("node_id", "source"), "node_id").select("community_id", "source").distinct()
    of = ranked(of, most, F.asc("source"), by=("community_id",), rank="r").drop("r")
    found = matches.join(of, "community_id").groupBy("query_id", "source").agg(
        F.max("score").alias("community_score"),
        F.transform(F.array_sort(F.collect_set(F.struct(-F.col("score"), F.col("community_id")))), lambda x: x["community_id"]).alias("community_ids"),
    )
    return ranked(found, most, F.desc("community_score"), F.asc("source"), rank="source_order")


def global_fusion(expanded: DataFrame, *, threshold: float = 0.35, k: int = 10) -> DataFrame:
    """0.75 of the text score and 0.25 of the community score, at most 1; the best ``k``."""
    final = F.lit(0.75) * F.col("score") + F.lit(0.25) * F.col("community_score")
    out = expanded.withColumn("final", final).where(F.col("final") >= threshold)
    out = out.withColumn("score", F.least(F.lit(1.0), "final")).drop("final")
    return ranked(out, k, F.desc("score"), F.asc("source"), F.asc("anchor"))


def with_fallback(found: DataFrame, basic: DataFrame) -> DataFrame:
    """The basic result of each query of which nothing was found."""
    return found.unionByName(basic.join(found.select("query_id").distinct(), "query_id", "left_anti"), allowMissingColumns=True)


def route(mode: str, *, local: bool = True, communities: bool = True) -> str:
    """The retriever that a mode leads to, given what is available."""
    if mode not in ("auto", "basic", "local", "global"):
        raise ValueError(f"unknown mode: {mode}")
    if mode in ("auto", "local"):
        return "local" if local else "basic"
    if mode == "global":
        return "global" if communities else "basic"
    return "basic"


def traces(queries: DataFrame, **steps: DataFrame) -> DataFrame:
    """A row per query with the number of rows of each step."""
    out = queries.select("query_id")
    for name, df in steps.items():
        out = out.join(df.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left")
    return out.fillna(0, list(steps))


def refusals(queries: DataFrame, evidence: DataFrame, threshold: float = 0.35) -> DataFrame:
    """``query_id`` and ``reason``: why a query can't be answered, null if it can."""
    citable = (F.col("score") >= threshold) & (T.strip(F.col("source")) != "") & (T.strip(F.col("anchor")) != "") & (T.strip(F.col("content")) != "")
    facts = evidence.groupBy("query_id").agg(F.max("score").alias("best"), F.max(F.coalesce(citable, F.lit(False))).alias("citable"))
    reason = F.when(F.col("best").isNull(), NO_EVIDENCE).when(F.col("best") < threshold, LOW_SCORE).when(~F.col("citable"), NOT_CITABLE)
    return queries.select("query_id").join(facts, "query_id", "left").select("query_id", reason.alias("reason"))
