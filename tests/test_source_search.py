"""The best chunks of each source asked for, by cells, against the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.vectors import dot
from lodestone.operators import retrieval as R


@pytest.mark.parametrize("cell", [7, 20_000])
def test_cells_give_what_the_join_gives(spark, cell):
    rng = random.Random(cell)
    vec = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]
    # one source has a third of all chunks, and all queries ask for it
    chunks = [(i, "hot" if i % 3 == 0 else f"s{i % 17}", vec(), f"text {i}") for i in range(300)]
    chunks += [(900, "hot", None, "no vector"), (901, "hot", [1.0], "short"), (902, "hot", [1.0, float("nan"), 0.0, 0.0], "no number"), (903, None, vec(), "no source")]
    queries = {q: vec() for q in range(40)}
    asked = [(q, s, v, q + 0.5) for q, v in queries.items() for s in ["hot", f"s{q % 19}", f"s{(q * 7) % 17}", "unknown"]] + [(99, "hot", None, 0.0), (98, None, vec(), 0.0)]
    a = spark.createDataFrame(list({(q, s): (q, s, v, g) for q, s, v, g in asked}.values()), "query_id int, source string, q_vec array<double>, graph_score double").repartition(3)
    c = spark.createDataFrame(chunks, "chunk_id int, source string, vec array<double>, content string").repartition(5)
    names = ["query_id", "source", "chunk_id", "content", "graph_score", "score", "source_rank"]
    got = R.vector_topk_per_source(a, c, 3, cell=cell).select(*names).collect()
    whole = c.where("chunk_id < 900")
    want = R.topk_per_source(a.where("q_vec IS NOT NULL"), whole, 3, score=dot(F.col("q_vec"), F.col("vec"))).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 200
    assert R.vector_topk_per_source(a.limit(0), c, 3).count() == 0 and R.vector_topk_per_source(a, c.limit(0), 3).count() == 0
