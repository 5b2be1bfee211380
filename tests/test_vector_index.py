"""The index gives the rows of the search over everything, and reads fewer cells where vectors cluster."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators.vector_index import VectorIndex, build_index

SCHEMA = "chunk_id int, source string, vec array<double>, content string"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "source", "content", "score", "rank").collect())


@pytest.mark.parametrize("kind", ["clusters", "random", "ties"])
def test_hits_are_those_of_all_rows(spark, tmp_path, kind):
    rng = random.Random(kind)
    centres = [[rng.gauss(0, 5) for _ in range(6)] for _ in range(8)]

    def vec():
        if kind == "ties":
            return [float(rng.randint(-1, 1)) for _ in range(6)]
        # a third of all rows are of one cluster
        c = centres[0 if rng.random() < 1 / 3 else rng.randrange(8)] if kind == "clusters" else [0.0] * 6
        return [x + rng.gauss(0, 0.2 if kind == "clusters" else 1) for x in c]

    chunks = [(i, f"s{i % 5}", vec(), f"text {i}") for i in range(400)]
    chunks += [(900, "x", None, ""), (901, "x", [1.0], ""), (902, "x", [float("nan")] * 6, ""), (903, "x", [0.0] * 6, "zero")]
    queries = [(q, vec()) for q in range(30)] + [(90, None), (91, [1.0]), (92, [0.0] * 6)]
    c = spark.createDataFrame(chunks, SCHEMA).repartition(5)
    q = spark.createDataFrame(queries, "query_id int, q_vec array<double>").repartition(3)
    index = build_index(c, str(tmp_path / "index"), cells=12, width=6)
    assert int(index.n.sum()) == 401  # every row that can be hit
    found = VectorIndex(spark, str(tmp_path / "index")).search(q, 7)
    assert rows_of(found) == rows_of(R.vector_topk(q.where(F.size("q_vec") == 6), c, 7))
    read = found.groupBy().agg(F.avg("cells_read")).first()[0]
    assert read < (6 if kind == "clusters" else 13)


def test_more_hits_than_rows_and_no_rows(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", [1.0, 0.0], "x"), (2, "b", [1.0, 0.0], "x")], SCHEMA)
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, q_vec array<double>")
    assert [r.chunk_id for r in build_index(c, str(tmp_path / "two"), cells=5, width=2).search(q, 9).orderBy("rank").collect()] == [1, 2]
    assert build_index(c, str(tmp_path / "two"), cells=5, width=2).search(q.limit(0), 9).count() == 0
    with pytest.raises(ValueError):
        build_index(c.limit(0), str(tmp_path / "none"), cells=5, width=2).search(q, 9)
    with pytest.raises(ValueError):
        build_index(c, str(tmp_path / "many"), cells=0, width=2)
