"""An inverted-file index of vectors that skips cells and still gives the exact best rows.

Vectors are dealt to the nearest of a few centroids. A cell keeps how far its rows are
from the centroid, in distance and in angle, so no row of it can score more than

* ``q . c + |q| * radius``, as ``q . v = q . c + q . (v - c)``, nor more than
* ``|q| * longest * cos(angle(q, c) - widest)``, as ``v`` is at most ``widest`` off ``c``.

A search scores each query's most promising cells first. The score of its k-th hit there is
a floor: cells whose bound is below cannot hold a better row and are not read for it; all
others are. So the rows are those of a search over everything, whatever the vectors are;
the better they cluster, the fewer cells are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from lodestone.operators.retrieval import ranked, vector_topk_per_source
from lodestone.session import dropped, written

#: Rows that centroids are fitted on at most, those with the least hash of the key; all rows are indexed.
SAMPLE = 20_000
#: Centroids are held by the driver and every task.
MAX_CELLS = 16_384


def _usable(vec: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a vector of ``width`` finite numbers, and these."""
    if isinstance(vec, pa.ChunkedArray):
        vec = vec.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vec), width), False).to_numpy(zero_copy_only=False))
    v = vec.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    whole = np.isfinite(v).all(axis=1)
    return rows[whole], v[whole]


def _nearest_centroid(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centroids * centroids).sum(1) - 2 * part @ centroids.T, axis=1) for part in np.array_split(v, len(v) // 4096 + 1)])


def _angles(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The angle between rows of ``v`` and ``c``; the widest there is where one of them is zero."""
    size = np.sqrt((v * v).sum(-1) * (c * c).sum(-1))
    cos = np.divide((v * c).sum(-1), size, out=np.full(size.shape, -1.0), where=size > 0)
    return np.arccos(np.clip(cos, -1, 1))


def fit_centroids(rows: DataFrame, cells: int, width: int, *, key: str = "chunk_id", sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """At most ``cells`` centroids by Lloyd's rounds over at most ``sample`` rows; one at zero if no row has a vector."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be from 1 to {MAX_CELLS}")
    held = rows.where(F.size("vec") == width).orderBy(F.xxhash64(key), key).select(F.col("vec").cast("array<double>").alias("vec")).limit(sample).toArrow()
    _, v = _usable(held["vec"], width)
    distinct = np.unique(v, axis=0)
    if not len(distinct):
        return np.zeros((1, width))
    at = distinct[np.random.default_rng(len(distinct)).permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        own = _nearest_centroid(v, at)
        sums, n = np.zeros_like(at), np.bincount(own, minlength=len(at))
        np.add.at(sums, own, v)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        if np.array_equal(moved, at):
            break
        at = moved
    return at


def build_index(rows: DataFrame, path: str, *, cells: int, width: int, key: str = "chunk_id", sample: int = SAMPLE) -> VectorIndex:
    """Write an index of ``rows`` (``key``, ``vec`` and any columns but ``cell``) below ``path``.

    Every row with ``width`` finite numbers is indexed; others are no hits of any
    query of that width, and are left out. Rows of a large cell are split over files.
    The facts of the cells are written last: a lost build leaves nothing that opens.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(fit_centroids(rows, cells, width, key=key, sample=sample))
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("off", DoubleType()), StructField("angle", DoubleType()), StructField("long", DoubleType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            held, v = _usable(batch.column("vec"), width)
            if len(held):
                own = _nearest_centroid(v, at)
                c = at[own]
                facts = [own.astype(np.int32), np.sqrt(((v - c) ** 2).sum(1)), _angles(v, c), np.sqrt((v * v).sum(1))]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(held)).columns, *map(pa.array, facts)], names=schema.names)

    folder = f"{path}/rows-{uuid.uuid4().hex}"
    rows.mapInArrow(deal, schema).hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(folder)
    stored = spark.read.schema(schema).parquet(folder)
    found = stored.groupBy("cell").agg(F.max("off").alias("radius"), F.max("angle").alias("widest"), F.max("long").alias("longest"), F.count("*").alias("n"))
    named = spark.createDataFrame([(i, c) for i, c in enumerate(shared.value.tolist())], "cell int, centroid array<double>")
    facts = named.join(found, "cell").select("cell", "centroid", "radius", "widest", "longest", "n", F.lit(folder).alias("folder"), F.to_json(F.struct(F.lit(schema.json()).alias("s"), F.lit(key).alias("k"), F.lit(width).alias("w"))).alias("about"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return VectorIndex(spark, path)


class VectorIndex:
    """An index written by :func:`build_index`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        held = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most ``MAX_CELLS``
        self.n = np.array([r["n"] for r in held], np.int64)
        self.cells = np.array([r["cell"] for r in held], np.int32)
        self.rows = None
        if held:
            about = json.loads(held[0]["about"])
            schema, self.key, self.width = StructType.fromJson(json.loads(about["s"])), about["k"], about["w"]
            self.rows = spark.read.schema(schema).parquet(held[0]["folder"])
            self.centroids = np.array([r["centroid"] for r in held])
            self.facts = np.array([[r["radius"], r["widest"], r["longest"]] for r in held])

    def _asks(self, queries: DataFrame, k: int, probes: int, rest: bool) -> DataFrame:
        """(``query_id``, ``q_vec``, ``source``): the cells to score first, or after them those whose bound reaches ``floor``."""
        shared = self.spark.sparkContext.broadcast((self.centroids, self.facts, self.n, self.cells))
        width = self.width
        schema = StructType([queries.schema["query_id"], StructField("q_vec", ArrayType(DoubleType())), StructField("source", IntegerType())])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, facts, n, cells = shared.value
            for batch in batches:
                held, every = _usable(batch.column("q_vec"), width)
                floors = batch.column("floor").to_numpy(zero_copy_only=False)[held]
                for lo in range(0, len(held), 256):
                    q, rows, floor = every[lo : lo + 256], held[lo : lo + 256], floors[lo : lo + 256]
                    size = np.sqrt((q * q).sum(1))[:, None]
                    slack = 1e-9 * size * (np.sqrt((centroids * centroids).sum(1)) + facts[:, 0] + facts[:, 2]) + 1e-300
                    inner = q @ centroids.T
                    off = np.maximum(0, _angles(q[:, None, :], centroids[None]) - facts[:, 1] - 1e-7)
                    bound = np.minimum(inner + size * facts[:, 0], size * facts[:, 2] * np.maximum(0, np.cos(np.minimum(off, np.pi)))) + slack
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    early = np.empty(order.shape, bool)
                    np.put_along_axis(early, order, (np.arange(order.shape[1]) < probes) | (before < k), axis=1)
                    query, cell = np.nonzero(~early & (bound >= floor[:, None]) if rest else early)
                    if len(query):
                        at = pa.array(rows[query])
                        vec = pa.FixedSizeListArray.from_arrays(pa.array(q[query].ravel()), width).cast(pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), vec, pa.array(cells[cell])], names=schema.names)

        return queries.select("query_id", F.col("q_vec").cast("array<double>").alias("q_vec"), "floor").mapInArrow(choose, schema)

    def _scored(self, asks: DataFrame, k: int) -> DataFrame:
        cells = [r["source"] for r in asks.select("source").distinct().collect()]  # at most ``MAX_CELLS``
        rows = self.rows.where(F.col("cell").isin(cells) if cells else F.lit(False)).drop("off", "angle", "long")
        rows = rows.withColumnsRenamed({"source": "own_source", "cell": "source"} if "source" in rows.columns else {"cell": "source"})
        found = ranked(vector_topk_per_source(asks, rows, k, key=self.key), k, F.desc("score"), F.asc(self.key)).drop("source", "source_rank")
        return found.withColumnRenamed("own_source", "source")

    def search(self, queries: DataFrame, k: int, *, probes: int = 2) -> DataFrame:
        """The ``k`` best rows of each query, as :func:`vector_topk` gives them, and ``cells_read`` of each query.

        ``queries`` has unique ``query_id`` and ``q_vec``; vectors that are null, of
        another width or not finite have no hits. The first cells are the best ``probes``
        by bound, and more where these have fewer than ``k`` rows; ``probes`` decides the
        time, not the result.
        """
        if self.rows is None:
            raise ValueError(f"{self.path}: an index without rows; search the table itself")
        q = queries.select("query_id", "q_vec", F.lit(float("-inf")).alias("floor"))
        first = written(self._asks(q, k, probes, False), "first-cells")
        best = written(self._scored(first, k).drop("rank"), "first-hits")
        floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        q = q.drop("floor").join(floors, "query_id", "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf"))))
        more = written(self._asks(q, k, probes, True), "more-cells")
        hits = ranked(best.unionByName(self._scored(more, k).drop("rank")), k, F.desc("score"), F.asc(self.key))
        read = first.unionByName(more).groupBy("query_id").agg(F.count("*").alias("cells_read"))
        out = written(hits.join(read, "query_id"), "hits")
        for df in (first, best, more):
            dropped(df)
        return out
