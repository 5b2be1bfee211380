"""The semantic layer: validated extractions, evidence merges, caches and model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.sync import digests, last_of

EXTRACTION = (
    "entities array<struct<name:string,type:string,description:string,aliases:array<string>,evidence_quote:string,confidence:string>>,"
    "relationships array<struct<source:string,target:string,description:string,strength:string,predicate:string,evidence_quote:string,confidence:string>>"
)


def _text(c: str) -> Column:
    return T.strip(F.coalesce(F.col(c), F.lit("")))


def _sure(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(1.0)).otherwise(T.bounded(c, 0.0, 1.0))


def entities(extractions: DataFrame, *, types: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Valid entities of (``chunk_id``, ``content``, ``response``): one for each chunk, type and normal name, the last one.

    An entity needs a name, a type (one of ``types`` if given), a description, the
    confidence, and a quote that stands in the content.
    """
    parsed = extractions.select("chunk_id", "content", F.from_json(T.json_object(F.col("response")), EXTRACTION).alias("x"))
    rows = parsed.select("chunk_id", "content", F.posexplode("x.entities").alias("pos", "e"))
    rows = rows.select("chunk_id", "content", "pos", "e.*")
    rows = rows.select("chunk_id", "content", "pos", _text("name").alias("name"), T.entity_type(F.col("type")).alias("type"), _text("description").alias("description"), F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.strip), lambda x: x != "").alias("aliases"), _text("evidence_quote").alias("quote"), _sure(F.col("confidence")).alias("confidence"))
    good = (F.col("name") != "") & (F.col("type") != "") & (F.col("description") != "") & (F.col("quote") != "") & F.contains("content", "quote") & (F.col("confidence") >= min_confidence)
    rows = rows.where(good).withColumns({"norm": T.entity_name(F.col("name")), "aliases": F.array_distinct("aliases")})
    if types:
        allowed = rows.sparkSession.createDataFrame([(t,) for t in types], "t string").select(T.entity_type(F.col("t")).alias("type"))
        rows = rows.join(F.broadcast(allowed), "type", "left_semi")
    last = F.row_number().over(Window.partitionBy("chunk_id", "type", "norm").orderBy(F.desc("pos")))
    same = Window.partitionBy("chunk_id", "type", "norm")  # an entity of one chunk
    mentioned = F.array_distinct(F.flatten(F.collect_list("aliases").over(same)))
    rows = rows.withColumns({"mentioned": mentioned, "first_pos": F.min("pos").over(same), "r": last}).where("r = 1")
    return rows.select("chunk_id", T.stable_id("entity", F.col("type"), F.col("norm")).alias("node_id"), "name", "norm", "type", "description", "aliases", "quote", "confidence", "pos", "mentioned", "first_pos")


def relationships(extractions: DataFrame, found: DataFrame, *, min_confidence: float = 0.0) -> DataFrame:
    """Valid relationships between the entities of a chunk, named by name or alias.

    A name beats an alias; of equal names the last entity, of equal aliases the
    first. One row for each pair and description, the last one.
    """
    by_name = found.select("chunk_id", F.col("norm").alias("mention"), "node_id", F.lit(0).alias("kind"), (-F.col("pos")).alias("turn"))
    by_alias = found.select("chunk_id", F.explode("mentioned").alias("alias"), "node_id", "first_pos").select("chunk_id", T.entity_name(F.col("alias")).alias("mention"), "node_id", F.lit(1).alias("kind"), F.col("first_pos").alias("turn"))
    first = F.row_number().over(Window.partitionBy("chunk_id", "mention").orderBy("kind", "turn"))
    mentions = by_name.unionByName(by_alias).withColumn("r", first).where("r = 1").select("chunk_id", "mention", "node_id")
    parsed = extractions.select("chunk_id", "content", F.from_json(T.json_object(F.col("response")), EXTRACTION).alias("x"))
    rows = parsed.select("chunk_id", "content", F.posexplode("x.relationships").alias("pos", "e")).select("chunk_id", "content", "pos", "e.*")
    rows = rows.select("chunk_id", "content", "pos", T.entity_name(F.col("source")).alias("a"), T.entity_name(F.col("target")).alias("b"), _text("description").alias("description"), F.when(F.col("strength").isNull(), 1.0).otherwise(T.bounded(F.col("strength"), 0.0, 10.0)).alias("strength"), T.predicate(F.coalesce("predicate", F.lit(""))).alias("predicate"), _text("evidence_quote").alias("quote"), _sure(F.col("confidence")).alias("confidence"))
    rows = rows.where((F.col("description") != "") & (F.col("quote") != "") & F.contains("content", "quote") & (F.col("confidence") >= min_confidence))
    rows = rows.join(mentions.select("chunk_id", F.col("mention").alias("a"), F.col("node_id").alias("source_node_id")), ["chunk_id", "a"])
    rows = rows.join(mentions.select("chunk_id", F.col("mention").alias("b"), F.col("node_id").alias("target_node_id")), ["chunk_id", "b"]).where("source_node_id <> target_node_id")
    last = F.row_number().over(Window.partitionBy("chunk_id", "source_node_id", "target_node_id", "description").orderBy(F.desc("pos")))
    rows = rows.withColumn("r", last).where("r = 1")
    return rows.select("chunk_id", T.stable_id("semantic-edge", F.col("source_node_id"), F.col("target_node_id")).alias("edge_id"), "source_node_id", "target_node_id", "description", "strength", "predicate", "quote", "confidence")


def merged_rounds(rounds: DataFrame, *key: str, round: str = "round") -> DataFrame:
    """Rows of several extraction rounds: for each key that of the last round."""
    return last_of(rounds, list(key), round)


def _described(evidence: DataFrame, key: str, seen: Column) -> DataFrame:
    """(``key``, ``description``) merged from the distinct descriptions of each item, in the order in which they are first seen."""
    rows = evidence.select(key, T.strip(F.col("raw_description")).alias("d"), seen.alias("seen")).where("d <> ''")
    once = rows.groupBy(key, "d").agg(F.min("seen").alias("seen"))
    listed = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seen", "d"))).alias("l"))
    return listed.select(key, T.merged_descriptions(F.transform("l", lambda x: x["d"])).alias("description"))


def merged_entities(evidence: DataFrame) -> DataFrame:
    """One row per ``node_id`` from its evidence, the surest first: name, type, aliases, description, frequency.

    ``evidence`` has ``node_id, chunk_id, entity_name, entity_type, raw_description,
    aliases, confidence``; a null confidence counts as the least. Evidence is reduced
    before it is shuffled: a row holds the different aliases and descriptions of an
    entity, never its chunks, which :func:`entity_units` lists as rows.
    """
    order = F.coalesce(-F.col("confidence"), F.lit(float("inf")))
    first = F.min(F.struct(order.alias("order"), "chunk_id", "entity_name", "entity_type"))
    facts = evidence.groupBy("node_id").agg(first.alias("first"), F.countDistinct("chunk_id").alias("frequency"))
    named = evidence.select("node_id", order.alias("order"), "chunk_id", F.posexplode("aliases").alias("pos", "alias"))
    named = named.groupBy("node_id", "alias").agg(F.min(F.struct("order", "chunk_id", "pos")).alias("seen"))
    named = named.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "alias"))), lambda x: x["alias"]).alias("aliases"))
    described = _described(evidence, "node_id", F.struct(order.alias("order"), "chunk_id"))
    out = facts.join(named, "node_id", "left").join(described, "node_id", "left")
    return out.select(
        "node_id",
        F.col("first.entity_name").alias("name"),
        F.col("first.entity_type").alias("entity_type"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("description", F.lit("")).alias("description"),
        "frequency",
    )


def entity_units(evidence: DataFrame) -> DataFrame:
    """(``node_id``, ``chunk_id``, ``confidence``): the chunks that name each entity, with the highest confidence."""
    return evidence.where("chunk_id IS NOT NULL").groupBy("node_id", "chunk_id").agg(F.max("confidence").alias("confidence"))


def merged_relations(evidence: DataFrame) -> DataFrame:
    """One RELATED_TO edge per ``edge_id``: weight from the mean strength, the commonest predicate (first seen of equals)."""
    facts = evidence.groupBy("edge_id").agg(
        F.min("source_node_id").alias("source_id"),
        F.min("target_node_id").alias("target_id"),
        F.avg("strength").alias("mean_strength"),
        F.sum("strength").alias("strength"),
        F.countDistinct("chunk_id").alias("frequency"),
    )
    counts = evidence.groupBy("edge_id", "predicate").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))
    named = counts.groupBy("edge_id").agg(
        F.min_by("predicate", F.struct(-F.col("n"), "first", "predicate")).alias("predicate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "n")))).alias("predicates"),
    )
    weight = F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.col("mean_strength") / 10 * 0.7))
    out = facts.join(named, "edge_id").join(_described(evidence, "edge_id", F.col("chunk_id")), "edge_id", "left")
    return out.select("edge_id", "source_id", "target_id", weight.alias("weight"), "strength", "frequency", "predicate", "predicates", F.coalesce("description", F.lit("")).alias("description"))


def mention_edges(evidence: DataFrame) -> DataFrame:
    section = T.section_id(F.col("source"), F.col("anchor"))
    return evidence.select(T.stable_id("edge", section, F.col("node_id"), F.lit("MENTIONS"), F.col("chunk_id")).alias("id"), section.alias("source_id"), F.col("node_id").alias("target_id"), F.lit("MENTIONS").alias("type"), F.lit(0.8).alias("weight"), F.col("source").alias("evidence_source"), F.col("anchor").alias("evidence_anchor"), F.col("chunk_id").alias("evidence_chunk_id"))


def description_groups(evidence: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Items with at least ``least`` different descriptions: the key and the sorted descriptions."""
    groups = evidence.select(key, T.strip(F.col("raw_description")).alias("d")).where("d <> ''").groupBy(key).agg(F.array_sort(F.collect_set("d")).alias("descriptions"))
    return groups.where(F.size("descriptions") >= least)


def replaced_evidence(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Evidence after the sources in ``new`` are replaced; of equal (item, chunk) the last by ``ord`` stays."""
    fresh = last_of(new, [key, "chunk_id"], "ord").drop("ord")
    return old.join(new.select("source").distinct(), "source", "left_anti").unionByName(fresh)


def pruned(df: DataFrame, valid: DataFrame, source: str = "source") -> DataFrame:
    """Rows whose source is still valid."""
    return df.join(valid.select(source).distinct(), source, "left_semi")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fingerprint(chunks: DataFrame, *versions: str) -> DataFrame:
    """(``source``, ``fingerprint``) over the ids and texts (null: empty) of a source's chunks, and versions."""
    hashed = chunks.select("source", "chunk_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    return digests(hashed, ["source"], "chunk_id", "hash").select("source", cache_key(F.col("digest"), *[F.lit(v) for v in versions]).alias("fingerprint"))


def cached(asked: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses) of requests against good cache rows."""
    good = cache.where("status = 'ok'").drop("status") if "status" in cache.columns else cache
    return asked.join(good, key), asked.join(good, key, "left_anti")


def answered_by(client: Callable[[], Callable[[str], str]], prompts: DataFrame, *, prompt: str = "prompt", retries: int = 1) -> DataFrame:
    """Add ``response`` and ``error``: a model client is made once a task; a failing row keeps its error and stops nothing."""
    keep = [c for c in prompts.columns if c not in ("response", "error")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for f in frames:
            out = []
            for text in f[prompt]:
                for _ in range(retries + 1):
                    try:
                        found = (ask(text), None)
                        break
                    except Exception as e:  # noqa: BLE001
                        found = (None, f"{type(e).__name__}: {e}")
                out.append(found)
            f = f.copy()
            f["response"], f["error"] = [a for a, _ in out], [b for _, b in out]
            yield f

    return prompts.select(*keep).mapInPandas(run, prompts.select(*keep).schema.add("response", "string").add("error", "string"))


def bounded_ranks(reports: DataFrame) -> DataFrame:
    """Reports with a title and a summary; ranks kept from 0 to 10, what is no number counts 0."""
    return reports.where((T.strip(F.col("title")) != "") & (T.strip(F.col("summary")) != "")).withColumn("rank", T.bounded(F.col("rank"), 0.0, 10.0))
