"""The semantic layer built end to end, and kept: extraction, evidence, merged graph, summaries, one commit.

Tables of the set: ``node_evidence``, ``edge_evidence`` and ``source_state`` by source,
``extractions`` and ``summaries`` (caches) by key, ``entities`` by node, ``relations``
by edge. A build touches the buckets of what has changed: entities and relations are
merged again only where evidence came or went.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import semantic as S
from lodestone.operators.lookups import changed_sources, summary_key
from lodestone.operators.tableset import TableSet
from lodestone.session import written

Client = Callable[[], Callable[[str], str]]
#: What is added to a prompt; the wording is free.
AGAIN = "\n\nThe last answer was not one valid JSON object. Answer with one JSON object only."
MORE = "\n\nOnly give entities and relationships that were missed before, in the same form."
NODE_EVIDENCE = "node_id string, chunk_id string, source string, anchor string, entity_name string, entity_type string, raw_description string, aliases array<string>, confidence double, quote string"
EDGE_EVIDENCE = "edge_id string, chunk_id string, source string, anchor string, source_node_id string, target_node_id string, raw_description string, strength double, predicate string, confidence double, quote string"


@dataclasses.dataclass(frozen=True)
class Extractor:
    """A model and how it is asked; ``prompt`` has ``{types}`` and ``{text}``."""

    client: Client
    model: str = "model"
    prompt: str = "{text}"
    version: str = "1"
    types: tuple[str, ...] = ()
    min_confidence: float = 0.0
    gleanings: int = 0
    retries: int = 1

    @property
    def versions(self) -> list[str]:
        return [self.model, self.prompt, self.version, "|".join(self.types), repr(self.min_confidence), str(self.gleanings)]

    def rendered(self, text: Column, round: int) -> Column:
        before, _, after = self.prompt.replace("{types}", ", ".join(self.types)).partition("{text}")
        return F.concat(F.lit(before), text, F.lit(after + (MORE if round else "")))


def _valid(response: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(T.json_object(response))).startswith("OBJECT"), F.lit(False))


#: Chunks that one task asks about, or reads the answers of, about.
TASK_CHUNKS = 20_000


def dealt(rows: DataFrame, n: int, by: str) -> DataFrame:
    """``rows`` dealt evenly to as many tasks as ``n`` chunks ask for.

    A model's calls and the reading of its answers take long for few bytes, so tasks by bytes would be few, and uneven.
    """
    return rows.repartition(max(-(-n // TASK_CHUNKS), rows.sparkSession.sparkContext.defaultParallelism), by)


def extraction_rounds(chunks: DataFrame, cache: DataFrame | None, extractor: Extractor) -> tuple[DataFrame, DataFrame, list[int], int]:
    """(good answers, failures, calls of each round, cache hits) for ``chunks`` with ``chunk_id, content``.

    Answers are ``key, chunk_id, round, response``; what ``cache`` has under its key is
    not asked again. A round is one job over the chunks whose last round still found
    something; an answer that is no JSON object is asked for again, ``retries`` times,
    in jobs over such chunks only. Answers are written before they are used, so that no
    model is asked twice. Failures are ``chunk_id, error``.
    """
    spark = chunks.sparkSession
    good = spark.createDataFrame([], "key string, chunk_id string, round int, response string")
    failed = spark.createDataFrame([], "chunk_id string, error string")
    todo, calls = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("content")), []
    known, total = 0, chunks.count()
    for r in range(extractor.gleanings + 1):
        key = S.cache_key(F.col("chunk_id"), F.sha2("content", 256), *[F.lit(v) for v in extractor.versions[:3]], F.lit(r))
        asked = written(todo.withColumn("key", key), "asked")
        hits = asked.join(cache.select("key", "response"), "key") if cache is not None else asked.withColumn("response", F.lit("")).where("false")
        left = asked.join(hits.select("key"), "key", "left_anti")
        known += hits.count()
        ask, n, answers = extractor.rendered(F.col("content"), r), 0, hits.select("key", "chunk_id", "content", "response")
        for turn in range(extractor.retries + 1):
            prompts = left.select("key", "chunk_id", "content", (ask if turn == 0 else F.concat(ask, F.lit(AGAIN))).alias("prompt"))
            said = written(S.answered_by(extractor.client, dealt(prompts, total, "key"), retries=0).withColumn("ok", _valid(F.col("response"))), "said")
            n += said.count()
            answers = answers.unionByName(said.where("ok").select("key", "chunk_id", "content", "response"))
            left = said.where("NOT ok").select("key", "chunk_id", "content", "response", "error")
            if left.isEmpty():
                break
        calls.append(n)
        failed = failed.unionByName(left.select("chunk_id", F.coalesce("error", F.lit("no JSON object")).alias("error")))
        answers = written(answers, "answers")
        good = good.unionByName(answers.select("key", "chunk_id", F.lit(r).alias("round"), "response"))
        found = F.from_json(T.json_object(F.col("response")), S.EXTRACTION)
        size = lambda c: F.coalesce(F.size(c), F.lit(0))
        todo = answers.withColumn("x", found).where((size("x.entities") > 0) | (size("x.relationships") > 0)).select("chunk_id", "content")
        if r < extractor.gleanings and todo.isEmpty():
            break
    return good, failed, calls, known


def joined_rounds(answers: DataFrame) -> DataFrame:
    """(``chunk_id``, ``response``): the answers of all rounds of a chunk as one JSON object, in the order of rounds."""
    parsed = answers.select("chunk_id", "round", F.from_json(T.json_object(F.col("response")), S.EXTRACTION).alias("x"))
    rounds = parsed.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("round", "x"))).alias("r"))  # as many as there are rounds
    every = lambda c: F.flatten(F.filter(F.transform("r", lambda x: x["x"][c]), lambda y: y.isNotNull())).alias(c)
    return rounds.select("chunk_id", F.to_json(F.struct(every("entities"), every("relationships"))).alias("response"))


def evidence_of(chunks: DataFrame, responses: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """Node and edge evidence of chunks (``source, anchor, chunk_id, content``) from their responses."""
    place = chunks.select("source", F.coalesce("anchor", F.lit("")).alias("anchor"), F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("content"))
    asked = written(dealt(place.join(responses, "chunk_id"), chunks.count(), "chunk_id"), "responses")
    found = written(S.entities(asked, types=list(extractor.types) or None, min_confidence=extractor.min_confidence), "entities")
    of = asked.select("chunk_id", "source", "anchor")
    nodes = found.join(of, "chunk_id").select("node_id", "chunk_id", "source", "anchor", F.col("name").alias("entity_name"), F.col("type").alias("entity_type"), F.col("description").alias("raw_description"), "aliases", "confidence", "quote")
    related = S.relationships(asked, found, min_confidence=extractor.min_confidence).join(of, "chunk_id")
    edges = related.select("edge_id", "chunk_id", "source", "anchor", "source_node_id", "target_node_id", F.col("description").alias("raw_description"), "strength", "predicate", "confidence", "quote")
    return written(nodes, "node-evidence"), written(edges, "edge-evidence")


def _or_empty(store: TableSet, name: str, schema: str) -> DataFrame:
    found = store.read(name)
    return store.spark.createDataFrame([], schema) if found is None else found


def _replace_sources(store: TableSet, gone: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """Evidence of the sources ``gone`` goes, fresh evidence comes, and what it touches is merged again."""
    spark = store.spark
    for name, schema, key, fresh, merge, target in (
        ("node_evidence", NODE_EVIDENCE, "node_id", nodes, S.merged_entities, "entities"),
        ("edge_evidence", EDGE_EVIDENCE, "edge_id", edges, S.merged_relations, "relations"),
    ):
        fresh = spark.createDataFrame([], schema) if fresh is None else fresh
        old = _or_empty(store, name, schema)
        touched = written(old.join(gone, "source", "left_semi").select(key).unionByName(fresh.select(key)).distinct(), "touched")
        store.change(name, fresh, by="source", gone=gone)
        left = store.read(name).join(touched, key, "left_semi")
        store.change(target, written(merge(left), target), by=key, gone=touched)


def described(store: TableSet, summarize: Client, *, versions: tuple[str, ...] = ("", "")) -> dict[str, int]:
    """Items with several descriptions get a model's summary of them in place of the merged text; cached by the descriptions.

    A failing call leaves the merged description as it is and is tried again at the next build.
    """
    spark = store.spark
    calls = hits = 0
    for kind, name, schema, key, target in (("entity", "node_evidence", NODE_EVIDENCE, "node_id", "entities"), ("relationship", "edge_evidence", EDGE_EVIDENCE, "edge_id", "relations")):
        groups = S.description_groups(_or_empty(store, name, schema), key)
        asked = groups.select(F.col(key).alias("item"), "descriptions", summary_key(F.col("descriptions"), F.lit(kind), F.col(key), *[F.lit(v) for v in versions]).alias("key"))
        asked = written(asked, "groups")
        cache = _or_empty(store, "summaries", "key string, kind string, item string, summary string")
        have = asked.join(cache.select("key", "summary"), "key")
        miss = asked.join(cache.select("key"), "key", "left_anti")
        prompts = miss.select("key", "item", F.to_json(F.struct(F.lit(kind).alias("kind"), "descriptions")).alias("prompt"))
        said = written(S.answered_by(summarize, prompts, retries=0), "summaries")
        new = said.where("response IS NOT NULL").select("key", F.lit(kind).alias("kind"), "item", F.col("response").alias("summary"))
        calls, hits = calls + said.where("response IS NOT NULL").count(), hits + have.count()
        store.change("summaries", new, by="key")
        told = written(have.select("item", "summary").unionByName(new.select("item", "summary")), "told")
        if target in store.tables and not told.isEmpty():
            rows = store.read(target)
            out = rows.join(told.withColumnRenamed("item", key), key).withColumn("description", F.col("summary")).select(*rows.columns)
            store.change(target, written(out, target), by=key)
    return {"summary_llm_calls": calls, "summary_cache_hits": hits}


def build(store: TableSet, chunks: DataFrame, extractor: Extractor, *, changed_only: bool = True, source: str | None = None, summarize: Client | None = None) -> dict:
    """Bring the semantic layer up to ``chunks`` (``source, anchor, chunk_id, content``) in one commit; returns what was done.

    Sources whose fingerprint is known are skipped if ``changed_only``. A source with a
    failed chunk keeps its old evidence and fingerprint, and its good answers stay in
    the cache. Without ``source`` the chunks are all there are: sources that are gone
    are pruned. With ``source`` only that one is built. Nothing counts before the
    commit, so a build that is lost leaves the old version.
    """
    if source is not None:
        chunks = chunks.where(F.replace("source", F.lit("\\"), F.lit("/")) == source.replace("\\", "/"))
        if chunks.isEmpty():
            raise ValueError(f"no such source: {source}")
    prints = written(S.fingerprint(chunks, *extractor.versions), "prints")
    state = _or_empty(store, "source_state", "source string, fingerprint string")
    todo = written(changed_sources(prints, state) if changed_only else prints, "todo")
    mine = written(chunks.join(todo.select("source"), "source", "left_semi"), "mine")
    answers, failed, calls, known = extraction_rounds(mine, store.read("extractions"), extractor)
    store.change("extractions", answers, by="key")
    ids = mine.select("source", F.col("chunk_id").cast("string").alias("chunk_id"))
    bad = written(failed.join(ids, "chunk_id").groupBy("source").agg(F.min("error").alias("error"), F.count("*").alias("chunks")), "bad")
    done = written(todo.join(bad, "source", "left_anti"), "done")
    nodes, edges = evidence_of(mine.join(done.select("source"), "source", "left_semi"), joined_rounds(answers), extractor)
    gone = state.select("source").where("false") if source is not None else state.join(prints, "source", "left_anti").select("source")
    gone = written(gone.distinct(), "gone")
    n_done, n_gone = done.count(), gone.count()
    stats = {"documents_total": prints.count(), "documents_indexed": n_done, "documents_failed": bad.count(), "pruned_sources": n_gone, "chunks_total": mine.count(), "llm_calls": sum(calls), "cache_hits": known}
    stats["documents_skipped"] = stats["documents_total"] - todo.count()
    if n_done or n_gone:
        _replace_sources(store, gone.unionByName(done.select("source")), nodes, edges)
        store.change("source_state", done.select("source", "fingerprint"), by="source", gone=gone)
        if summarize is not None:
            stats |= described(store, summarize, versions=(extractor.model, extractor.version))
    stats["errors"] = bad
    stats["version"] = store.commit()
    return stats


def delete_source(store: TableSet, source: str) -> int:
    """Take one source's evidence and state away, merge again what it touched, commit; an unknown source changes nothing."""
    path = source.replace("\\", "/")
    gone = store.spark.createDataFrame([(path,)], "source string")
    _replace_sources(store, gone)
    state = _or_empty(store, "source_state", "source string, fingerprint string")
    store.change("source_state", state.where("false"), by="source", gone=gone)
    return store.commit()
