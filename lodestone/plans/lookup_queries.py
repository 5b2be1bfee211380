"""Queries of lookups, caches, state and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import lookups as L
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.plans.queries import _GRAMS, SCORES, _vectors, query, table


def _asked(spark, d):
    """A query for each order with a key divisible by 50: three customers, one twice, one unknown."""
    o = table(spark, d, "orders").where("o_orderkey % 50 = 0")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    return o.select(F.col("o_orderkey").alias("query_id"), F.array(name(F.col("o_custkey")), name(F.col("o_custkey") + 1), name(F.col("o_custkey")), F.lit("c-1")).alias("sources"))


@query(
    """WITH o AS (SELECT o_orderkey AS query_id, o_custkey AS k FROM orders WHERE o_orderkey % 50 = 0), a AS (SELECT query_id, 0 AS position, k FROM o UNION ALL SELECT query_id, 1, k + 1 FROM o)
    SELECT query_id, position, c_name FROM a JOIN customer ON c_custkey = k"""
)
def parents_by_sources(spark, d):
    parents = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"), "c_name")
    return L.parents_of(_asked(spark, d), parents).select("query_id", "position", "c_name")


@query("SELECT o_orderkey AS query_id, min(l_linenumber) AS chunk_id, arg_min(l_quantity, (l_linenumber, l_quantity)) AS content FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 50 = 0 AND l_returnflag = 'N' GROUP BY o_orderkey")
def child_by_citation(spark, d):
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_returnflag").alias("anchor"), F.col("l_linenumber").alias("chunk_id"), F.col("l_quantity").alias("content"))
    asked = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("source"), F.lit("N").alias("anchor"))
    return L.cited_children(asked, chunks).select("query_id", "chunk_id", "content")


@query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def list_sources(spark, d):
    return L.sources_of(table(spark, d, "documents"))


def _parts(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("n"), "p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "entity").otherwise("document").alias("type"), F.col("p_name").alias("name"))


@query("SELECT 'n' || p_partkey AS id, p_name AS name FROM part WHERE p_size % 2 = 0")
def list_entities(spark, d):
    return L.entities_of(_parts(spark, d)).select("id", "name")


@query("SELECT s_suppkey AS id, s_acctbal AS rank FROM supplier WHERE s_suppkey % 3 <> 0")
def list_reports(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("summary"), F.col("s_acctbal").alias("rank"))
    return L.reports_of(s).select("id", "rank")


@query("SELECT l_orderkey, l_linenumber, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 50 = 0")
def node_by_id(spark, d):
    asked = table(spark, d, "lineitem").where("l_orderkey % 50 = 0").select("l_orderkey", "l_linenumber", F.concat(F.lit("n"), "l_partkey").alias("node"))
    return L.nodes_by_id(asked, _parts(spark, d)).select("l_orderkey", "l_linenumber", "name")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages")
def collection_sizes(spark, d):
    return L.sizes(**{t: table(spark, d, t) for t in ("documents", "embeddings", "pages")})


@query("SELECT 'node' AS kind, count(*) AS n FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'edge', count(*) FROM lineitem WHERE l_returnflag = 'R'")
def semantic_network(spark, d):
    edges = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "RELATED_TO").otherwise("LINKS_TO").alias("type"))
    nodes, edges = L.semantic_network(_parts(spark, d), edges)
    return L.sizes(node=nodes, edge=edges).withColumnRenamed("name", "kind")


@query(
    """SELECT source, count(*) AS n_keys, sum((n > 1)::INT) AS n_shared FROM (SELECT source, least(doc_id % 7, doc_id % 5) AS a, greatest(doc_id % 7, doc_id % 5) AS b, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source"""
)
def summary_keys(spark, d):
    pair = F.array(*[F.pmod("doc_id", F.lit(k)).cast("string") for k in (7, 5, 7)])
    keyed = table(spark, d, "documents").select("source", L.summary_key(pair, F.lit("model"), F.lit("prompt")).alias("key"))
    return keyed.groupBy("source", "key").agg(F.count("*").alias("n")).groupBy("source").agg(F.count("*").alias("n_keys"), F.sum((F.col("n") > 1).cast("int")).alias("n_shared"))


@query("SELECT user_id AS key, arg_max(event_type, ts) AS response FROM events WHERE event_id IN (SELECT arg_max(event_id, ts) FROM events GROUP BY user_id) GROUP BY user_id UNION ALL SELECT -1, 'kept'")
def cache_put(spark, d):
    e = table(spark, d, "events")
    cols = lambda df, key, response, ts: df.select(key.alias("key"), response.alias("response"), ts.alias("updated_at"))
    old = cols(e.where("event_id % 3 = 0").dropDuplicates(["user_id"]), F.col("user_id"), F.lit("old"), F.col("ts")).unionByName(cols(e.limit(1), F.lit(-1).cast("bigint"), F.lit("kept"), F.col("ts")))
    return L.cache_put(old, cols(e, F.col("user_id"), F.col("event_type"), F.col("ts"))).select("key", "response")


@query("SELECT s_name AS source FROM supplier WHERE s_suppkey % 4 < 2")
def changed_sources(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("source"), F.lit("f1").alias("fingerprint"))
    state = s.where("k % 4 > 0").withColumn("fingerprint", F.when(F.col("k") % 4 == 1, "f0").otherwise("f1"))
    return L.changed_sources(s, state).select("source")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n_keys, CASE WHEN event_id % 4 > 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def graph_rows(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "no json").otherwise(F.col("props")).alias("metadata_json"))
    return L.graph_rows(e).select("event_id", F.size("metadata").alias("n_keys"), F.col("metadata")["k"].alias("k"))


@query("SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS p FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name DESC) AS p FROM nation) USING (p)")
def zipped_rows(spark, d):
    n = table(spark, d, "nation").select("n_name", (-F.rank().over(M.Window.orderBy("n_name"))).alias("o"))
    return M.zipped(table(spark, d, "region").select("r_name"), "r_name", n, "o").select("r_name", "n_name")


@query("""SELECT doc_id, 'questanswer_' || (doc_id % 3 + 1) || 'docs-' || substr(sha256('questanswer_' || (doc_id % 3 + 1) || 'docs' || chr(0) || coalesce(nullif(lang, 'en'), doc_id::VARCHAR) || chr(0) || doc_id), 1, 12) AS case_id, (doc_id % 3 + 1)::INT AS n FROM documents""")
def case_ids(spark, d):
    task = F.concat(F.lit("questanswer_"), (F.pmod("doc_id", F.lit(3)) + 1).cast("string"), F.lit("docs"))
    docs = table(spark, d, "documents").withColumn("task", task)
    return docs.select("doc_id", M.case_id(F.col("task"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.col("doc_id")).alias("case_id"), M.evidence_count(F.col("task")).alias("n"))


EVIDENCE = f"""{SCORES}, gold AS (SELECT q.vec_id AS query_id, c.vec_id AS item FROM embeddings q JOIN embeddings c ON q.label = c.label AND c.vec_id // 10 = q.vec_id // 10 WHERE q.vec_id % 10 = 0),
per AS (SELECT g.query_id, count(t.chunk_id) / count(*) AS r, count(t.chunk_id) = count(*) AS a, count(t.chunk_id) > 0 AS o, min(t.rank) AS f FROM gold g LEFT JOIN top t ON t.query_id = g.query_id AND t.chunk_id = g.item GROUP BY g.query_id)"""


def _evidence(spark, d):
    chunks, queries = _vectors(spark, d)
    hits = R.vector_topk(queries, chunks, 10).select("query_id", F.col("chunk_id").alias("item"), "rank")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label", (F.floor(F.col("vec_id") / 10) * 10).alias("query_id"))
    return queries, hits, queries.join(rows, ["query_id", "label"]).select("query_id", "item")


@query(f"WITH {EVIDENCE} SELECT query_id, round(r, 6) AS evidence_recall, a AS all_recalled, o AS any_recalled, f AS first_relevant_rank FROM per")
def evidence_recall(spark, d):
    _, hits, gold = _evidence(spark, d)
    return M.evidence_recall(hits, gold, 10).withColumn("evidence_recall", F.round("evidence_recall", 6))


@query(f"WITH {EVIDENCE} SELECT round(avg(r), 6) AS evidence_recall, round(avg(a::INT), 6) AS all_recalled, round(avg(o::INT), 6) AS any_recalled, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM per")
def evidence_means(spark, d):
    _, hits, gold = _evidence(spark, d)
    out = M.evidence_means(M.evidence_recall(hits, gold, 10))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {SCORES} SELECT 1.0::DOUBLE AS nonempty, 10.0::DOUBLE AS sources_a_query, round((SELECT count(DISTINCT chunk_id) FROM top) / (SELECT count(*) FROM embeddings), 6) AS coverage")
def retrieval_diagnostics(spark, d):
    queries, hits, _ = _evidence(spark, d)
    out = M.retrieval_diagnostics(queries, hits, table(spark, d, "embeddings").select(F.col("vec_id").alias("item")))
    return out.select("nonempty", "sources_a_query", F.round("coverage", 6).alias("coverage"))


@query(
    f"""WITH t AS (SELECT p_partkey, p_brand, p_name, regexp_replace(lower(p_name), '\\s+', '', 'g') AS t FROM part), g AS (SELECT p_partkey, p_brand, p_name, {_GRAMS} AS g FROM t),
    s AS (SELECT q.p_partkey AS query_id, g.p_brand AS source, lpad(g.p_partkey::VARCHAR, 9, '0') AS anchor, round(0.45 + 0.5 * len(list_intersect(g.g, q.g)) / (len(g.g) + len(q.g) - len(list_intersect(g.g, q.g))), 6) AS score FROM g q JOIN g ON g.p_brand = q.p_brand WHERE q.p_partkey % 50 = 0)
    SELECT query_id, source, anchor, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, anchor) AS source_rank FROM s QUALIFY source_rank <= 3"""
)
def lexical_rerank(spark, d):
    p = table(spark, d, "part")
    asked = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("question"), F.col("p_brand").alias("source"))
    chunks = p.select(F.col("p_brand").alias("source"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("anchor"), F.col("p_name").alias("content"))
    return L.lexical_rerank(asked, chunks, 3).select("query_id", "source", "anchor", "score", "source_rank")


@query("SELECT o_custkey AS query_id, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS position, max(o_totalprice) AS score FROM orders GROUP BY o_custkey")
def best_seed_chunk(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.lit("s").alias("source"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("score"))
    return L.best_seed_chunks(o).select("query_id", "position", "score")


@query("SELECT '{\"entities\":[{\"name\":\"' || s_name || '\"}],\"relationships\":[]}' AS extraction FROM supplier")
def extraction_json(spark, d):
    one = F.array(F.struct(F.col("s_name").alias("name")))
    return table(spark, d, "supplier").select(L.extraction_json(one, F.array().cast("array<string>")).alias("extraction"))
