"""Work that must not grow faster than the input: repeated texts, gold by class, many queries."""

import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.operators import chunking as C
from lodestone.operators import graph as G
from lodestone.operators import joins as J
from lodestone.operators import lookups as L
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.operators import retrievers as V
from lodestone.operators import semantic_build as B
from lodestone.session import written


def test_repeated_texts_are_scored_once(spark):
    """200 million pairs of an asking and a chunk, but six pairs of texts."""
    chunks = spark.range(100_000).select(F.lit("s").alias("source"), F.format_string("%06d", "id").alias("anchor"), F.element_at(F.array(F.lit("red ring"), F.lit("blue ring"), F.lit(None).cast("string")), (F.col("id") % 3 + 1).cast("int")).alias("content"))
    asked = spark.range(2_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "Red ring").otherwise("bolt").alias("question"), F.lit("s").alias("source"))
    began = time.monotonic()
    got = L.lexical_rerank(asked, chunks, 3).select("query_id", "anchor", "score", "source_rank").toPandas()
    assert time.monotonic() - began < 120
    assert len(got) == 6_000
    first = got[got.query_id == 0].sort_values("source_rank")
    assert first.anchor.tolist() == ["000000", "000003", "000006"] and first.score.tolist() == [0.95] * 3
    other = got[got.query_id == 1].sort_values("source_rank")
    assert other.anchor.tolist() == ["000000", "000001", "000002"] and other.score.tolist() == [0.45] * 3


def test_rerank_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["red", "ring", "blue", "bolt", "", "green plate"]
    text = lambda n: [None if k == 0 else " ".join(rng.choice(words, 2)) for k in rng.integers(0, 9, n)]
    chunks = pd.DataFrame({"source": [f"s{k}" for k in rng.integers(0, 3, 300)], "anchor": [f"a{k:03}" for k in rng.permutation(300)], "content": text(300)})
    asked = pd.DataFrame({"query_id": range(40), "question": text(40), "source": [f"s{k}" for k in rng.integers(0, 3, 40)]})
    got = L.lexical_rerank(spark.createDataFrame(asked, "query_id long, question string, source string"), spark.createDataFrame(chunks, "source string, anchor string, content string"), 4).toPandas()

    def grams(x):
        x = "".join((x if isinstance(x, str) else "").lower().split())
        return {x[k : k + 2] for k in range(max(1, len(x) - 1))} - {""}

    want = []
    for q in asked.itertuples():
        own = chunks[chunks.source == q.source]
        pairs = [(len(grams(q.question) & grams(c)), len(grams(q.question) | grams(c))) for c in own.content]
        scored = sorted((-round(0.45 + 0.5 * (a / b if b else 0), 6), anchor) for (a, b), anchor in zip(pairs, own.anchor, strict=True))
        want += [(q.query_id, anchor, -s, r + 1) for r, (s, anchor) in enumerate(scored[:4])]
    assert sorted(got[["query_id", "anchor", "score", "source_rank"]].itertuples(index=False, name=None)) == sorted(want)


def test_bigrams_of_repeated_texts_are_compared_once(spark):
    """12 million rows, of 180 pairs of texts."""
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("large part "), F.col("id") % 3)).alias("text"))
    questions = spark.range(60).select(F.concat(F.lit("a large ring of number "), "id").alias("question"))
    began = time.monotonic()
    got = L.bigram_scores(rows, "text", questions)
    n, null, best = got.agg(F.count("*"), F.max(F.when(F.col("text").isNull(), F.col("score"))), F.max("score")).first()
    assert time.monotonic() - began < 25
    assert (n, null) == (12_000_000, 0.45) and best > 0.45


def _traced(v, q, k):
    tracemalloc.start()
    try:
        found = R._nearest(v, q, np.arange(len(v)), k)
        return found, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_search_hangs_on_its_hits():
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(6_000, 16)), rng.normal(size=(4_000, 16))
    (chunk, query, score), most = _traced(v, q, 50)
    assert most < 160  # candidates of all tiles at once took several times this
    assert len(query) == 200_000
    for k in (0, 1_023, 1_024, 3_999):
        exact = v @ q[k]
        assert sorted(chunk[query == k]) == sorted(np.argsort(-exact)[:50])
        assert np.allclose(score[query == k], np.sort(exact)[::-1][:50])


def test_a_task_hands_on_what_reaches_its_best(spark):
    """Copies and scores that rise from batch to batch: the same hits as without the floor."""
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(300, 4)), 4, axis=0) * np.linspace(0.5, 2, 1_200)[:, None].round(1)
    chunks = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "chunk_id long, vec array<double>").coalesce(1)
    queries = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("q_vec"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = R.vector_topk(queries, chunks, 7).select("query_id", "rank", "chunk_id").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    score = np.zeros((120, 1_200))
    for j in range(4):
        score += v[::10, j][:, None] * v[:, j]
    want = {(10 * i, r + 1, int(c)) for i in range(120) for r, c in enumerate(np.lexsort((np.arange(1_200), -score[i]))[:7])}
    assert set(got.itertuples(index=False, name=None)) == want


def test_gold_by_class_needs_no_row_per_pair(spark):
    """A gold of 900 million pairs."""
    items = spark.range(300_000).select(F.col("id").alias("item"), (F.col("id") % 3).alias("label"))
    queries = spark.range(9_000).select(F.col("id").alias("query_id"), F.when(F.col("id") < 8_999, F.col("id") % 3).alias("label"))
    hits = queries.select("query_id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")).select("query_id", (F.col("query_id") + F.col("k")).alias("item"), (F.col("k") + 1).alias("rank"))
    began = time.monotonic()
    got = M.class_metrics(hits, queries, items, ks=(1, 5)).toPandas()
    assert time.monotonic() - began < 60
    assert len(got) == 8_999 and (got.recall_5 * 100_000).round(6).eq(2).all() and got.first_hit_rank.eq(1).all()
    few = queries.where("query_id < 40"), items.where("item < 60")
    want = M.query_metrics(hits, few[0].join(few[1], "label").select("query_id", "item"), ks=(1, 5)).toPandas().sort_values("query_id")
    pd.testing.assert_frame_equal(M.class_metrics(hits, *few, ks=(1, 5)).toPandas().sort_values("query_id").reset_index(drop=True), want.reset_index(drop=True))


def test_merges_are_dealt_to_more_tasks_as_chunks_grow(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_CHUNKS", 40)
    notes = spark.range(200).select(F.concat(F.lit("n"), "id", F.lit(".md")).alias("source"), F.concat(F.lit("n"), "id").alias("filename"), F.lit("").alias("folder"), F.array(F.lit("t")).alias("tags"), F.array().cast("array<string>").alias("aliases"), F.concat(F.lit("# A\n\n[[n"), F.col("id") + 1, F.lit("]]\n\n## B\n\nText")).alias("content"))
    chunks = written(C.chunks(notes), "chunks")
    found = G.resolved(G.links(chunks), notes)
    nodes, edges = G.structure_nodes(notes, chunks, found), G.structure_edges(notes, chunks, found)
    assert nodes.rdd.getNumPartitions() == edges.rdd.getNumPartitions() == 10  # 400 chunks
    assert nodes.groupBy("type").count().orderBy("type").collect() == [("document", 200), ("section", 400), ("tag", 1), ("unresolved", 1)]
    assert edges.groupBy("type").count().orderBy("type").collect() == [("HAS_SECTION", 400), ("LINKS_TO", 200), ("TAGGED_WITH", 200)]


def test_the_search_behind_an_answer_runs_once(spark):
    """Each step and each attempt read the hits; the search was run again for every one of them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    hits = spark.createDataFrame([(q, 1, "p.md", "a", "S", "H", "f", "Body text here", 0.9) for q in (1, 2)], "query_id int, rank int, source string, anchor string, section_title string, heading string, filename string, content string, score double")
    questions = spark.createDataFrame([(q, f"what #{q}") for q in (1, 2, 3)], "query_id int, question string")
    out = V.answered(lambda: lambda prompt: "nothing", questions, hits.mapInArrow(counted, hits.schema), "{context} {history}{question}")
    assert sorted((r.query_id, r.status, r.attempts) for r in out.collect()) == [(q, "insufficient_evidence", 2 if q < 3 else 0) for q in (1, 2, 3)]
    assert seen.value == 2


def test_model_calls_are_dealt_to_all_tasks(spark, tmp_path):
    """Chunks that lie in one file were asked about by one task."""
    folder = str(tmp_path)

    def client():
        import pathlib

        from pyspark import TaskContext

        (pathlib.Path(folder) / str(TaskContext.get().partitionId())).touch()
        return lambda prompt: '{"entities": [], "relationships": []}'

    chunks = written(spark.range(2000).select(F.lit("s").alias("source"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("text").alias("content")).coalesce(1), "chunks")
    answers, failed, calls, _ = B.extraction_rounds(chunks, None, B.Extractor(client))
    assert answers.count() == 2000 and failed.isEmpty() and calls == [2000]
    assert len(list(tmp_path.iterdir())) == spark.sparkContext.defaultParallelism


def test_small_networks_split_no_keys(spark):
    """Finding and splitting hot keys was half of the jobs of communities of some 100,000 links."""
    rows = spark.range(1).select(F.lit("n").alias("b"))
    assert J.hot_keys(rows, "b", total=500_000) is None and J.hot_keys(rows, "b", total=1_000_001) is not None


def test_a_worker_holds_about_a_cell(spark):
    """Forty sources of a cell each were dealt to forty tasks by hash, of which some had four or five."""
    from collections import Counter

    chunks = spark.range(40 * 20 + 200).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < 800, F.concat(F.lit("s"), F.col("id") % 40)).otherwise(F.concat(F.lit("t"), "id")).alias("source"))
    asked = spark.range(40 * 100).select(F.col("id").alias("query_id"), F.concat(F.lit("s"), F.col("id") % 40).alias("source"))
    asks, has = R.dealt_in_cells(asked, chunks, "chunk_id", 100)
    rows = Counter(r.bucket for df in (asks, has) for r in df.select("bucket").collect())
    assert sum(rows.values()) == 5000 and max(rows.values()) <= 200
    assert {r.bucket for r in asks.collect()} <= {r.bucket for r in has.collect()}
