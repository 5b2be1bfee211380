"""Whole retrievers: through the graph, through communities, and by mode; and the answers drawn from them.

Tables are those of :mod:`lodestone.operators.retrieval` and :mod:`lodestone.operators.graph`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.operators import semantic as S
from lodestone.session import written

#: Fixed value: how the reason of an answer begins that no attempt could make valid.
INVALID = "引用校验失败"


def best_chunks(queries: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best chunk of each source that a query asks for (``query_id``, ``source`` and more columns)."""
    wanted = asked.join(queries.select("query_id", "q_vec"), "query_id")
    return R.vector_topk_per_source(wanted, chunks, 1).drop("source_rank")


def entity_seeds(queries: DataFrame, entities: DataFrame, nodes: DataFrame, *, k: int = 10, threshold: float = 0.35) -> DataFrame:
    """(``query_id``, ``node``): the ``k`` nearest entities (``entity_id``, ``vec``) that reach the threshold and are nodes of the graph."""
    known = nodes.where("type = 'entity'").select(F.col("id").alias("node"))
    near = R.above(R.vector_topk(queries, entities.select("entity_id", "vec"), k, key="entity_id"), threshold)
    return near.select("query_id", F.col("entity_id").alias("node")).join(known, "node", "left_semi")


def local_retrieval(
    queries: DataFrame,
    chunks: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    *,
    entities: DataFrame | None = None,
    k: int = 10,
    threshold: float = 0.35,
    where: Column | None = None,
    max_seeds: int = 10,
    max_hops: int = 2,
    max_neighbors: int = 30,
    graph_weight: float = 0.25,
) -> DataFrame:
    """Vector hits and what the graph leads to from them, fused by rank.

    The seeds are the places of the best ``max_seeds`` vector hits, and the entities
    nearest to the query. Of all that is reached each source counts once, by its best
    path, and gives its best chunk. ``where`` filters chunks, also those found through
    the graph. A query with neither hits nor entities has no rows. The columns are
    those of :func:`lodestone.operators.retrieval.fused` and ``path``.
    """
    chunks = chunks if where is None else chunks.where(where)
    base = written(R.basic_retrieval(queries, chunks, k=k, threshold=threshold).select("query_id", "chunk_id", "source", "anchor", "score", "rank"), "base")
    seeds = base.where(F.col("rank") <= max_seeds)
    reach = {"max_hops": max_hops, "max_neighbors": max_neighbors}
    hits = G.graph_hits(G.expand(G.seed_nodes(seeds, nodes), edges, **reach), nodes, seeds, most=max_neighbors)
    if entities is not None:
        started = written(entity_seeds(queries, entities, nodes, k=max_seeds, threshold=threshold), "entities")
        hits = hits.unionByName(G.graph_hits(G.expand(started, edges, **reach), nodes, most=max_neighbors))
    hits = written(R.best_hits(hits.drop("rank"), max_neighbors), "hits")
    expanded = best_chunks(queries, hits.select("query_id", "source", "graph_score", "graph_rank"), chunks)
    out = R.fused(base, expanded, graph_weight=graph_weight, threshold=threshold)
    return out.join(hits.select("query_id", "source", "path"), ["query_id", "source"], "left")


def global_retrieval(
    queries: DataFrame, chunks: DataFrame, reports: DataFrame, members: DataFrame, evidence: DataFrame, *, k: int = 10, threshold: float = 0.35, where: Column | None = None, max_reports: int = 10, max_sources: int = 30
) -> DataFrame:
    """The best chunks of the sources behind the ``max_reports`` nearest community reports (``community_id``, ``vec``).

    A query whose reports lead to no source gets its basic result, with null
    ``community_score``; one whose sources all stay below the threshold gets nothing.
    """
    chunks = chunks if where is None else chunks.where(where)
    matches = R.vector_topk(queries, reports.select("community_id", "vec"), max_reports, key="community_id")
    sources = written(R.community_sources(matches, members, evidence, max_sources).drop("source_order"), "sources")
    columns = ["query_id", "chunk_id", "source", "anchor", "score", "community_score", "community_ids", "rank"]
    found = R.global_fusion(best_chunks(queries, sources, chunks), threshold=threshold, k=k).select(*columns)
    rest = queries.join(sources.select("query_id").distinct(), "query_id", "left_anti")
    basic = R.basic_retrieval(rest, chunks, k=k, threshold=threshold)
    return found.unionByName(basic.select(*[c for c in columns if not c.startswith("community")]), allowMissingColumns=True)


def retrieval(mode: str, queries: DataFrame, chunks: DataFrame, *, graph: tuple[DataFrame, DataFrame] | None = None, entities: DataFrame | None = None, communities: tuple[DataFrame, DataFrame, DataFrame] | None = None, **settings) -> DataFrame:
    """The retriever that ``mode`` leads to, given a graph (nodes, edges) and communities (reports, members, evidence)."""
    chosen = R.route(mode, local=graph is not None, communities=communities is not None)
    if chosen == "local":
        return local_retrieval(queries, chunks, *graph, entities=entities, **settings)
    if chosen == "global":
        return global_retrieval(queries, chunks, *communities, **settings)
    return R.basic_retrieval(queries, chunks, **settings)


def prompts(questions: DataFrame, hits: DataFrame, template: str) -> DataFrame:
    """(``query_id``, ``prompt``): ``template`` with ``{context}``, ``{question}`` and ``{history}`` filled in."""
    history = F.coalesce("history", F.lit("")) if "history" in questions.columns else F.lit("")
    both = questions.join(A.evidence_json(hits), "query_id")
    prompt = F.lit(template)
    for name, value in (("{history}", history), ("{question}", F.coalesce("question", F.lit(""))), ("{context}", F.col("evidence"))):
        prompt = F.replace(prompt, F.lit(name), value)
    return both.select("query_id", prompt.alias("prompt"))


def answered(client: Callable[[], Callable[[str], str]], questions: DataFrame, hits: DataFrame, template: str, *, threshold: float = 0.35, retries: int = 1, most: int = 5) -> DataFrame:
    """A row per question: ``query_id``, ``status``, ``answer``, ``citations``, ``reason``, ``attempts``.

    A question without usable evidence is refused before a model is asked. An answer
    that is no valid output, or breaks the citation rules, is asked for again, up to
    ``retries`` times; what is left then is refused with what was wrong. Each attempt
    is one job over the questions that are still open, and is written out. So are the
    hits, which all steps read: the search behind them runs once.
    """
    hits = written(hits, "evidence")
    refused = written(R.refusals(questions, hits, threshold).where("reason IS NOT NULL"), "refused")
    done = [refused.select("query_id", F.lit("insufficient_evidence").alias("status"), "reason", F.lit(0).alias("attempts"))]
    usable = written(hits.join(refused, "query_id", "left_anti"), "usable")
    open_ = written(prompts(questions.join(refused, "query_id", "left_anti"), usable, template), "prompts")
    wrong = None
    for attempt in range(1, retries + 2):
        asked = written(S.answered_by(client, open_, retries=0), "outputs")
        built = written(A.responses(asked.select("query_id", F.col("response").alias("output")), usable), "responses")
        broken = A.violations(built.where("status = 'answered' AND error IS NULL"), usable, threshold=threshold, most=most)
        broken = broken.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "code", T.blank_to_null(F.col("subject"))))), "；").alias("broken"))
        judged = built.join(broken, "query_id", "left").join(asked.select("query_id", F.col("error").alias("failed")), "query_id")
        judged = written(judged.withColumn("wrong", F.coalesce("failed", "error", "broken")), "judged")
        done.append(judged.where("wrong IS NULL").select("query_id", "status", "answer", "citations", "reason", F.lit(attempt).alias("attempts")))
        wrong = judged.where("wrong IS NOT NULL")
        if attempt == retries + 1 or wrong.isEmpty():
            break
        open_ = open_.join(wrong, "query_id", "left_semi")
    done.append(wrong.select("query_id", F.lit("insufficient_evidence").alias("status"), F.concat(F.lit(INVALID + "："), "wrong").alias("reason"), F.lit(attempt).alias("attempts")))
    out = done[1]
    for part in (done[0], *done[2:]):
        out = out.unionByName(part, allowMissingColumns=True)
    return out
