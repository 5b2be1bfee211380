"""Answers with citations: built from model output, and validated against the evidence."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.retrieval import NO_EVIDENCE

OUTPUT = "status string, answer array<struct<text:string,evidence_ids:array<string>>>, reason string"
#: Fixed value: the message of a refusal.
REFUSAL = "根据现有文档无法确定该问题的答案。"


def evidence_rows(hits: DataFrame) -> DataFrame:
    """Evidence as a model sees it: ``ev_1`` and so on in rank order."""
    title = T.section_title(F.col("section_title"), F.col("heading"), F.col("filename"))
    return hits.select("query_id", F.concat(F.lit("ev_"), F.col("rank").cast("string")).alias("evidence_id"), F.col("source").alias("document_path"), "anchor", title.alias("section_title"), "content", F.round("score", 4).alias("score"))


def evidence_json(hits: DataFrame) -> DataFrame:
    """(``query_id``, ``evidence``): the evidence of a query as one JSON text."""
    rows = evidence_rows(hits)
    listed = F.array_sort(F.collect_list(F.struct(F.length("evidence_id").alias("n"), F.struct("evidence_id", "document_path", "anchor", "section_title", "content", "score").alias("e"))))
    return rows.groupBy("query_id").agg(F.to_json(F.transform(listed, lambda x: x["e"])).alias("evidence"))


def history_text(turns: DataFrame, last: int = 6) -> DataFrame:
    """(``session``, ``history``): the last turns of each session, a line each."""
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))
    kept = turns.withColumn("r", rank).where(F.col("r") <= last)
    lines = F.array_sort(F.collect_list(F.struct("turn", T.spoken(F.col("role"), F.col("text")).alias("line"))))
    return kept.groupBy("session").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def responses(outputs: DataFrame, hits: DataFrame) -> DataFrame:
    """(``query_id``, ``status``, ``answer``, ``citations``, ``reason``, ``error``) from model outputs (``query_id``, ``output``).

    Evidence becomes ``cite_1`` and so on in the order of first use. What is no
    JSON object, has another status, an empty item, or evidence that does not
    exist gets an error and no answer.
    """
    parsed = outputs.select("query_id", F.from_json(T.json_object(F.col("output")), OUTPUT).alias("o"))
    items = parsed.where("o.status = 'answered'").select("query_id", F.posexplode("o.answer").alias("item", "a"))
    items = items.select("query_id", "item", T.strip(F.coalesce("a.text", F.lit(""))).alias("text"), F.array_distinct(F.coalesce("a.evidence_ids", F.array().cast("array<string>"))).alias("ids"))
    used = items.select("query_id", "item", F.posexplode("ids").alias("at", "evidence_id"))
    known = evidence_rows(hits)
    used = used.join(known, ["query_id", "evidence_id"], "left")
    firsts = used.groupBy("query_id", "evidence_id").agg(F.min(F.struct("item", "at")).alias("first"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    named = firsts.withColumn("n", order).select("query_id", "evidence_id", "n", F.concat(F.lit("cite_"), F.col("n").cast("string")).alias("id"))
    cites = known.join(named, ["query_id", "evidence_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.struct("id", "document_path", "anchor", "section_title", T.quote(F.col("content")).alias("quote"), "score").alias("c")))).alias("cs"))
    cites = cites.select("query_id", F.transform("cs", lambda x: x["c"]).alias("citations"))
    lines = used.join(named, ["query_id", "evidence_id"]).groupBy("query_id", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("citation_ids"))
    answer = items.join(lines, ["query_id", "item"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item", "text", "citation_ids"))).alias("a"))
    answer = answer.select("query_id", F.transform("a", lambda x: F.struct(x["text"].alias("text"), x["citation_ids"].alias("citation_ids"))).alias("answer"))
    bad = items.groupBy("query_id").agg(F.max((F.col("text") == "") | (F.size("ids") == 0)).alias("bad_item"))
    loose = used.groupBy("query_id").agg(F.max(F.col("document_path").isNull()).alias("bad_id"))
    out = parsed.join(bad, "query_id", "left").join(loose, "query_id", "left").join(answer, "query_id", "left").join(cites, "query_id", "left")
    refused = F.col("o.status") == "insufficient_evidence"
    error = (
        F.when(F.col("o").isNull() | F.col("o.status").isNull(), "no JSON object with a status")
        .when(refused, None)
        .when(F.col("o.status") != "answered", "unknown status")
        .when(F.col("answer").isNull(), "empty answer")
        .when(F.col("bad_item"), "an item without text or evidence")
        .when(F.coalesce("bad_id", F.lit(False)), "unknown evidence")
    )
    good = error.isNull() & ~F.coalesce(refused, F.lit(False))
    return out.select("query_id", F.col("o.status").alias("status"), F.when(good, F.col("answer")).alias("answer"), F.when(good, F.col("citations")).alias("citations"), F.when(refused, F.coalesce(T.blank_to_null(F.col("o.reason")), F.lit(NO_EVIDENCE))).alias("reason"), error.alias("error"))


def violations(answers: DataFrame, evidence: DataFrame, *, threshold: float = 0.35, require_citations: bool = True, most: int = 5) -> DataFrame:
    """(``query_id``, ``code``, ``subject``): every way in which a response breaks the citation rules.

    ``answers`` has ``query_id, status, answer`` (array of text, citation_ids) and
    ``citations`` (array of id, document_path, anchor, quote, section_title, score);
    ``evidence`` has ``query_id, source, anchor, section_title, content, score``.
    """
    row = lambda df, code, subject=None: df.select("query_id", F.lit(code).alias("code"), (F.lit("") if subject is None else subject.cast("string")).alias("subject"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    cites = answers.select("query_id", F.posexplode("citations").alias("at", "c")).select("query_id", "at", "c.*")
    no_id = F.coalesce("id", F.lit("")) == ""
    listed = cites.where(~no_id)
    counts = listed.groupBy("query_id", "id").agg(F.count("*").alias("n"))
    bare = (F.coalesce("document_path", F.lit("")) == "") | (F.coalesce("anchor", F.lit("")) == "") | (F.coalesce("quote", F.lit("")) == "")
    found = evidence.select("query_id", F.col("source").alias("document_path"), "anchor", F.col("section_title").alias("e_title"), F.col("content").alias("e_content"), F.col("score").alias("e_score"))
    checked = listed.where(~bare).join(found, ["query_id", "document_path", "anchor"], "left")
    matched = checked.where(F.col("e_content").isNotNull())
    items = answers.select("query_id", F.posexplode("answer").alias("item", "a")).select("query_id", (F.col("item") + 1).alias("item"), T.strip(F.coalesce("a.text", F.lit(""))).alias("text"), F.col("a.citation_ids").alias("ids"))
    said = items.where("text <> ''")
    cited = said.where(~empty("ids")) if require_citations else said
    uses = cited.select("query_id", F.explode("ids").alias("id"))
    every = [
        row(answers.where(F.coalesce("status", F.lit("")) != "answered"), "status_not_answered"),
        row(answers.where(empty("answer")), "answer_empty"),
        row(answers.where(F.col("citations").isNull()), "citations_missing"),
        row(cites.where(no_id), "citation_id_empty", F.col("at")),
        row(counts.where("n > 1"), "citation_id_repeated", F.col("id")),
        row(listed.where(bare), "citation_metadata_empty", F.col("id")),
        row(checked.where(F.col("e_content").isNull()), "citation_not_in_evidence", F.col("id")),
        row(matched.where(~F.contains("e_content", "quote")), "quote_not_in_content", F.col("id")),
        row(matched.where(F.col("score").isNull()), "score_invalid", F.col("id")),
        row(matched.where((F.col("score") < threshold) | (F.col("score").isNotNull() & (F.col("e_score") < threshold))), "score_below_threshold", F.col("id")),
        row(matched.where(~F.col("section_title").eqNullSafe(F.col("e_title"))), "section_title_differs", F.col("id")),
        row(items.where("text = ''"), "item_empty", F.col("item")),
        row(uses.join(counts, ["query_id", "id"], "left_anti"), "unknown_citation", F.col("id")),
        row(counts.join(uses, ["query_id", "id"], "left_anti"), "unused_citation", F.col("id")),
        row(counts.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > most), "too_many_citations"),
    ]
    if require_citations:
        every += [row(said.where(empty("ids")), "item_without_citation", F.col("item")), row(answers.join(counts, "query_id", "left_anti"), "no_citation")]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def footer(citations: Column) -> Column:
    """The line of sources below an answer; empty without citations."""
    refs = F.array_distinct(F.transform(F.filter(citations, lambda x: (x["document_path"] != "") & (x["anchor"] != "")), lambda x: F.concat(F.lit("["), x["document_path"], F.lit("#"), x["anchor"], F.lit("]"))))
    return F.when(F.coalesce(F.size(refs), F.lit(0)) > 0, F.concat(F.lit("\n\n来源："), F.array_join(refs, "、"))).otherwise(F.lit(""))


#: The labels of a path view.
GRAPH_SEARCH, VECTOR_SEARCH, VECTOR_NODE, FOUND_DOCUMENT, COMMUNITY_MATCH, COMMUNITY_SOURCE, SUPPORTS, CITED = "图搜索", "语义检索", "向量检索", "命中文档", "社区匹配", "包含来源", "支持答案", "最终引用"


def view_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 16))


def path_view(answers: DataFrame, evidence: DataFrame, mode: str = "basic", *, steps: DataFrame | None = None, communities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the ways from questions to the evidence that their answers cite.

    ``answers`` has ``query_id, question, status, citations``, ``evidence`` the
    ``query_id, source, anchor`` of what was retrieved. A cited document is reached
    through the graph in mode ``local`` if ``steps`` has its path (``query_id, source,
    step, node, type, name, edge_type``; the edge is the one from the step before),
    through its communities in mode ``global`` if ``communities`` has some (``query_id,
    source, community_id``), and else by vector search. The end of a path that is a
    document or a section is the cited document itself. Questions that are not
    answered, or cite nothing that was retrieved, have no rows; each node and edge of
    a question comes once.
    """
    cites = answers.where("status = 'answered'").select("query_id", "question", F.posexplode("citations").alias("at", "c")).select("query_id", "question", "at", "c.*")
    cites = cites.join(evidence.select("query_id", F.col("source").alias("document_path"), "anchor").distinct(), ["query_id", "document_path", "anchor"], "left_semi")
    document, citation = view_id("document", F.col("document_path")), view_id("citation", F.col("id"))
    documents = cites.select("query_id", "document_path").distinct()
    query = F.lit("query")
    node = lambda df, i, kind, label: df.select("query_id", i.alias("id"), kind.alias("type"), label.cast("string").alias("label"))
    edge = lambda df, a, b, kind, label: df.select("query_id", a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), label.alias("label"))
    number = F.concat(F.lit(CITED + " ["), (F.col("at") + 1).cast("string"), F.lit("]"))
    nodes = [
        node(cites, query, query, F.coalesce("question", F.lit(""))),
        node(documents, document, F.lit("document"), F.regexp_extract("document_path", "([^/]*)$", 1)),
        node(cites, citation, F.lit("citation"), number),
    ]
    edges = [edge(cites, document, citation, "supports", F.lit(SUPPORTS))]
    linked = None
    if mode == "local" and steps is not None:
        way = steps.withColumnRenamed("source", "document_path").join(documents, ["query_id", "document_path"])
        line = Window.partitionBy("query_id", "document_path").orderBy("step")
        end = F.lead("step").over(line).isNull() & F.col("type").isin("document", "section")
        kind = F.when(F.col("type").isin("entity", "community", "document"), F.col("type")).otherwise("graph")
        own = F.concat(kind, F.lit(":"), F.substring(F.sha2(F.col("node"), 256), 1, 16))
        way = way.select("query_id", "document_path", "step", "edge_type", F.coalesce(T.blank_to_null(F.col("name")), "node").alias("name"), kind.alias("kind"), end.alias("end"), F.when(end, document).otherwise(own).alias("i"))
        way = way.withColumns({"before": F.lag("i").over(line), "last": F.lead("i").over(line).isNull()})
        nodes.append(node(way.where("NOT end"), F.col("i"), F.col("kind"), F.col("name")))
        edges.append(edge(way.where("before IS NULL"), query, F.col("i"), "graph_search", F.lit(GRAPH_SEARCH)))
        edges.append(edge(way.where("before IS NOT NULL"), F.col("before"), F.col("i"), "graph_relation", F.coalesce("edge_type", F.lit(""))))
        edges.append(edge(way.where("last AND NOT end"), F.col("i"), document, "retrieved_document", F.lit(FOUND_DOCUMENT)))
        linked = way.select("query_id", "document_path").distinct()
    if mode == "global" and communities is not None:
        behind = communities.withColumnRenamed("source", "document_path").join(documents, ["query_id", "document_path"])
        community = view_id("community", F.col("community_id"))
        nodes.append(node(behind, community, F.lit("community"), F.col("community_id")))
        edges.append(edge(behind, query, community, "community_match", F.lit(COMMUNITY_MATCH)))
        edges.append(edge(behind, community, document, "community_source", F.lit(COMMUNITY_SOURCE)))
        linked = behind.select("query_id", "document_path").distinct()
    rest = documents if linked is None else documents.join(linked, ["query_id", "document_path"], "left_anti")
    vector = F.lit("retrieval:vector")
    nodes.append(node(rest, vector, F.lit("retrieval"), F.lit(VECTOR_NODE)))
    edges.append(edge(rest, query, vector, "vector_search", F.lit(VECTOR_SEARCH)))
    edges.append(edge(rest, vector, document, "retrieved_document", F.lit(FOUND_DOCUMENT)))
    all_nodes = functools.reduce(DataFrame.unionByName, nodes).groupBy("query_id", "id", "type").agg(F.min("label").alias("label"))
    all_edges = functools.reduce(DataFrame.unionByName, edges).where("source <> target").groupBy("query_id", "source", "target", "type").agg(F.min("label").alias("label"))
    return all_nodes, all_edges
