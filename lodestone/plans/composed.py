"""Queries of whole retrievers and of the answer loop, over a vault derived from the embeddings.

Forty sources s0 to s39 have links s(i) to s(7i + 3 mod 40) and mention ten
entities; the nearest rows of a label stand for entities and community reports.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.operators import retrieval as R
from lodestone.operators import retrievers as V
from lodestone.plans.queries import BASIC, SCORES, _vectors, query, table


def _notes(spark) -> DataFrame:
    n = spark.range(40).select(F.col("id").alias("i"), F.concat(F.lit("s"), "id").alias("source"))
    return n.withColumn("target", F.concat(F.lit("s"), F.pmod(F.col("i") * 7 + 3, F.lit(40))))


def _graph(spark) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: documents, the entities e0 to e9 that they mention, and links."""
    notes = _notes(spark)
    node = lambda i, kind, source: notes.select(i.alias("id"), F.lit(kind).alias("type"), source.alias("source"))
    entity = F.concat(F.lit("e"), F.pmod("i", F.lit(10)))
    nodes = node(T.document_id(F.col("source")), "document", F.col("source")).unionByName(node(entity, "entity", F.lit("")).distinct())
    edge = lambda b, kind, w: notes.select(F.concat(F.lit(kind[0]), "i").alias("id"), T.document_id(F.col("source")).alias("source_id"), b.alias("target_id"), F.lit(kind).alias("type"), w.alias("weight"))
    links = edge(T.document_id(F.col("target")), "LINKS_TO", (F.pmod("i", F.lit(5)) + 5) / 10)
    return nodes, links.unionByName(edge(entity, "ABOUT", F.lit(0.9)))


def _firsts(spark, d, key: str, name: str) -> DataFrame:
    """The vector of the first row of each label, as ``key``."""
    v = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec"))
    return v.select(F.concat(F.lit(name), "label").alias(key), "vec")


FIRSTS = "firsts AS (SELECT label, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY label), near AS (SELECT q.vec_id AS query_id, f.label, list_dot_product(q.embedding::DOUBLE[], f.vec::DOUBLE[]) AS score FROM embeddings q CROSS JOIN firsts f WHERE q.vec_id % 10 = 0)"

LOCAL = f"""WITH {BASIC}, {FIRSTS}, notes AS (SELECT i, 's' || i AS source, 's' || ((i * 7 + 3) % 40) AS target, ((i % 5) + 5)::DOUBLE / 10 AS weight, i % 10 AS entity FROM range(40) r(i)
), step AS (SELECT source AS a, target AS b, weight FROM notes UNION ALL SELECT target, source, weight FROM notes
), seeds AS (SELECT DISTINCT query_id, source FROM hits
), met AS (
  SELECT s.query_id, b AS source, weight * 0.85::DOUBLE AS score FROM seeds s JOIN step ON a = s.source WHERE NOT EXISTS (FROM seeds o WHERE o.query_id = s.query_id AND o.source = b)
  UNION ALL SELECT n.query_id, t.source, 0.9::DOUBLE * 0.85::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'e' || label) AS r FROM near) n JOIN notes t ON t.entity = n.label WHERE r <= 10 AND score >= 0.2
), reached AS (SELECT query_id, source, max(score) AS graph_score FROM met GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, source) AS graph_rank FROM reached QUALIFY graph_rank <= 30
), expanded AS (SELECT r.*, c.anchor, c.score FROM ranked r JOIN (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS r FROM scored) c ON c.query_id = r.query_id AND c.source = r.source AND c.r = 1
), g AS (SELECT e.*, row_number() OVER (PARTITION BY e.query_id ORDER BY graph_rank, e.anchor) AS o, coalesce(n.n, 0) AS n_base FROM expanded e LEFT JOIN (SELECT query_id, max(rank) AS n FROM hits GROUP BY query_id) n ON n.query_id = e.query_id
), f AS (SELECT coalesce(b.query_id, g.query_id) AS query_id, coalesce(b.source, g.source) AS source, coalesce(b.anchor, g.anchor) AS anchor, greatest(b.score, g.score) AS text_score, coalesce(graph_score, 0) AS graph_score,
  1 / (60 + coalesce(b.rank, n_base + o)) + coalesce(0.25 / (60 + graph_rank), 0) AS rank_score FROM hits b FULL JOIN g ON b.query_id = g.query_id AND b.source = g.source AND b.anchor = g.anchor
), s AS (SELECT *, CASE WHEN graph_score > 0 THEN 0.75 * text_score + 0.25 * graph_score ELSE text_score END AS final FROM f)
SELECT query_id, source, anchor, round(graph_score, 6) AS graph_score, round(least(1, final), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, final DESC, source, anchor) AS rank FROM s WHERE final >= 0.2"""


@query(LOCAL)
def local_retrieval(spark, d):
    chunks, queries = _vectors(spark, d)
    out = V.local_retrieval(queries, chunks, *_graph(spark), entities=_firsts(spark, d, "entity_id", "e"), threshold=0.2, max_hops=1)
    return out.select("query_id", "source", "anchor", F.round("graph_score", 6).alias("graph_score"), F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {BASIC}, {FIRSTS}, best AS (SELECT query_id, label, score FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'K' || label) = 1
    ), sources AS (SELECT query_id, 's' || i AS source, score AS community_score FROM best, range(40) r(i) WHERE i % 10 = label AND label < 8
    ), expanded AS (SELECT c.*, s.community_score FROM sources s JOIN (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS r FROM scored) c ON c.query_id = s.query_id AND c.source = s.source AND c.r = 1
    ), f AS (SELECT *, 0.75 * score + 0.25 * community_score AS final FROM expanded
    ), found AS (SELECT query_id, source, anchor, least(1, final) AS score, true AS by_community, row_number() OVER (PARTITION BY query_id ORDER BY least(1, final) DESC, source, anchor) AS rank FROM f WHERE final >= 0.2 QUALIFY rank <= 10)
    SELECT query_id, source, anchor, round(score, 6) AS score, by_community, rank FROM found
    UNION ALL SELECT query_id, source, anchor, round(score, 6), false, rank FROM hits WHERE query_id NOT IN (SELECT query_id FROM sources)"""
)
def global_retrieval(spark, d):
    chunks, queries = _vectors(spark, d)
    notes = _notes(spark)
    members = notes.where("i % 10 < 8").select(F.concat(F.lit("K"), F.pmod("i", F.lit(10))).alias("community_id"), F.col("i").alias("node_id"))
    evidence = notes.select(F.col("i").alias("node_id"), "source")
    out = V.global_retrieval(queries, chunks, _firsts(spark, d, "community_id", "K"), members, evidence, threshold=0.2, max_reports=1)
    return out.select("query_id", "source", "anchor", F.round("score", 6).alias("score"), F.col("community_score").isNotNull().alias("by_community"), "rank")


def _model():
    """A stand-in for a model: what it says hangs on the number in the question."""

    def ask(prompt: str) -> str:
        n = int(prompt.rsplit("#", 1)[1])
        if n % 4 == 0:
            return json.dumps({"status": "answered", "answer": [{"text": f"Answer {n}", "evidence_ids": ["ev_1"]}]})
        if n % 4 == 1:
            return json.dumps({"status": "insufficient_evidence", "reason": "no"})
        if n % 4 == 2:
            return json.dumps({"status": "answered", "answer": [{"text": "Answer", "evidence_ids": ["ev_99"]}]})
        return "I do not know"

    return ask


@query(
    f"""WITH {SCORES}, t AS (SELECT query_id, score, source, rank FROM top WHERE query_id % 50 <> 40), q AS (SELECT vec_id AS query_id, vec_id // 10 % 4 AS k FROM embeddings WHERE vec_id % 10 = 0)
    SELECT q.query_id, CASE WHEN t.query_id IS NOT NULL AND k = 0 THEN 'answered' ELSE 'insufficient_evidence' END AS status,
      CASE WHEN t.query_id IS NULL THEN '未检索到足够证据' WHEN k = 1 THEN 'no' WHEN k = 2 THEN '引用校验失败：unknown evidence' WHEN k = 3 THEN '引用校验失败：no JSON object with a status' END AS reason,
      CASE WHEN t.query_id IS NULL THEN 0 WHEN k < 2 THEN 1 ELSE 2 END AS attempts, CASE WHEN t.query_id IS NOT NULL AND k = 0 THEN t.source END AS cited
    FROM q LEFT JOIN t ON t.query_id = q.query_id AND t.rank = 1"""
)
def answer_loop(spark, d):
    chunks, queries = _vectors(spark, d)
    hits = R.vector_topk(queries, chunks, 10).where("query_id % 50 <> 40").withColumns({"section_title": F.lit("T"), "heading": F.lit("T"), "filename": F.lit("f")})
    questions = queries.select("query_id", F.concat(F.lit("Question #"), F.floor(F.col("query_id") / 10).cast("string")).alias("question"))
    out = V.answered(_model, questions, hits, "{context}\n{history}\n{question}")
    return out.select("query_id", "status", "reason", "attempts", F.col("citations")[0]["document_path"].alias("cited"))


@query(
    f"""WITH {SCORES}, cited AS (SELECT query_id, source, anchor, rank, substr(source, 2)::INT % 10 AS k FROM top WHERE rank <= 2), docs AS (SELECT DISTINCT query_id, source, k FROM cited)
    SELECT query_id, 'supports' AS type, count(*) AS n FROM cited GROUP BY 1
    UNION ALL SELECT query_id, 'community_match', count(DISTINCT k) FROM docs WHERE k < 8 GROUP BY 1
    UNION ALL SELECT query_id, 'community_source', count(*) FROM docs WHERE k < 8 GROUP BY 1
    UNION ALL SELECT query_id, 'vector_search', 1 FROM docs WHERE k >= 8 GROUP BY 1
    UNION ALL SELECT query_id, 'retrieved_document', count(*) FROM docs WHERE k >= 8 GROUP BY 1"""
)
def path_edges(spark, d):
    chunks, queries = _vectors(spark, d)
    hits = R.vector_topk(queries, chunks, 2)
    cite = F.struct(F.concat(F.lit("cite_"), "rank").alias("id"), F.col("source").alias("document_path"), "anchor")
    answers = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(cite)).alias("citations")).withColumns({"status": F.lit("answered"), "question": F.lit("?")})
    communities = _notes(spark).where("i % 10 < 8").select("source", F.concat(F.lit("K"), F.pmod("i", F.lit(10))).alias("community_id"))
    of = hits.select("query_id", "source").distinct().join(communities, "source")
    _, edges = A.path_view(answers, hits, "global", communities=of)
    return edges.groupBy("query_id", "type").agg(F.count("*").alias("n"))
