"""Lookups, listings, caches and state over the library's tables, for batches of keys."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as T
from lodestone.operators import semantic as S
from lodestone.session import written

#: The tables that the library keeps, with their columns.
SCHEMAS = {
    "nodes": "id string, type string, name string, source string, anchor string, owner_source string, content_hash string, description string, metadata map<string,string>",
    "edges": "id string, source_id string, target_id string, type string, weight double, predicate string, evidence_source string, evidence_anchor string, evidence_chunk_id string, metadata map<string,string>",
    "cache": "key string, kind string, response string, status string, error string, updated_at timestamp",
    "source_state": "source string, fingerprint string, updated_at timestamp",
    "communities": "id string, cluster int, level int, parent_id string, title string, summary string, full_content string, rank double",
    "members": "community_id string, node_id string",
}


def emptied(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows: what a reset writes."""
    return spark.createDataFrame([], SCHEMAS[table])


def migrated(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns of ``table`` in their order and types; columns of an older version that are missing are empty or zero.

    Further columns are left out. Keys (the first column) are never made up: a table
    without its key is an error.
    """
    schema = StructType.fromDDL(SCHEMAS[table])
    key = schema.fields[0].name
    if key not in df.columns:
        raise ValueError(f"{table}: no column {key}")
    blank = {"string": F.lit(""), "double": F.lit(0.0), "int": F.lit(0)}
    out = []
    for field in schema.fields:
        kind = field.dataType.simpleString()
        default = blank.get(kind, F.lit(None)).cast(field.dataType)
        out.append((F.coalesce(F.col(field.name).cast(field.dataType), default) if field.name in df.columns and field.name != key else F.col(key).cast(field.dataType) if field.name == key else default).alias(field.name))
    return df.select(*out)


def parents_of(asked: DataFrame, parents: DataFrame) -> DataFrame:
    """The parent of each source that a query asks for (``query_id``, ``sources``), in the order asked, each once; unknown ones are left out."""
    each = asked.select("query_id", F.posexplode(F.array_distinct("sources")).alias("position", "source"))
    return each.join(parents, "source")


def cited_children(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of each citation (``query_id``, ``source``, ``anchor``): of several the one with the least ``chunk_id`` (and content)."""
    place = ["source", "anchor"]
    first = chunks.groupBy(*place).agg(F.min(F.struct("chunk_id", "content")).alias("c")).select(*place, "c.*")
    return asked.join(first, place)


def sources_of(parents: DataFrame) -> DataFrame:
    """Distinct sources, without empty ones."""
    return parents.select("source").where("source <> ''").distinct()


def nodes_by_id(asked: DataFrame, nodes: DataFrame, id_column: str = "node") -> DataFrame:
    return asked.join(nodes.withColumnRenamed("id", id_column), id_column)


def entities_of(nodes: DataFrame) -> DataFrame:
    """The entities, in the order of name and id."""
    return nodes.where("type = 'entity'").orderBy("name", "id")


def reports_of(communities: DataFrame) -> DataFrame:
    """Communities that have a summary, best rank first."""
    return communities.where(T.strip(F.col("summary")) != "").orderBy(F.desc("rank"), "id")


def semantic_network(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entities and the relations between them."""
    return nodes.where("type = 'entity'"), edges.where("type = 'RELATED_TO'")


def snapshot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges in the order of their ids, so that two exports of one graph are alike."""
    return nodes.orderBy("id"), edges.orderBy("id")


def sizes(**tables: DataFrame) -> DataFrame:
    """(``name``, ``n``): the number of rows of each table, in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, counts)


def of_source(df: DataFrame, source: str, column: str = "source") -> DataFrame:
    """Rows of one source, whichever slashes its path was written with; no such row is an error."""
    path = F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    found = df.where(path == source.replace("\\", "/"))
    if found.isEmpty():
        raise ValueError(f"no such source: {source}")
    return found


def summary_key(descriptions: Column, *versions: Column) -> Column:
    """Cache key of a summary: the same for the same descriptions in any order."""
    return S.cache_key(F.to_json(F.array_sort(F.array_distinct(descriptions))), *versions)


def report_key(context: Column, *versions: Column) -> Column:
    """Cache key of a report: its context (a struct) without the title, which is no part of what is reported on."""
    return S.cache_key(F.to_json(context.dropFields("title")), *versions)


def cache_put(cache: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """The cache with ``rows`` put in; of rows with one key the latest ``updated_at`` stays, and a new row takes the place of an old one."""
    fresh = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("updated_at", F.xxhash64(*rows.columns))).alias("r")).select(key, "r.*")
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*cache.columns))


def changed_sources(fingerprints: DataFrame, state: DataFrame) -> DataFrame:
    """Sources whose ``fingerprint`` is new or differs from that of the state table: what a build has to do."""
    return fingerprints.join(state.select("source", "fingerprint"), ["source", "fingerprint"], "left_anti")


def extraction_json(entities: Column, relationships: Column) -> Column:
    """An extraction as JSON, as a cache keeps it."""
    return F.to_json(F.struct(entities.alias("entities"), relationships.alias("relationships")))


def graph_rows(rows: DataFrame, metadata: str = "metadata_json") -> DataFrame:
    """Stored rows with their metadata parsed; what is no JSON object gives an empty map."""
    parsed = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.withColumn("metadata", parsed).drop(metadata)


def best_seed_chunks(scored: DataFrame) -> DataFrame:
    """The best chunk of each seed (``query_id``, ``source``, ``position``, ``score``); of equal scores the first."""
    rest = [c for c in scored.columns if c not in ("query_id", "source")]
    return scored.groupBy("query_id", "source").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("position"))).alias("b")).select("query_id", "source", "b.*")


#: Tasks that the distinct texts of one source are spread over.
SPREAD = 16


#: Scores of distinct texts that are broadcast at most.
FEW_SCORES = 500_000


def bigram_scores(rows: DataFrame, text: str, questions: DataFrame) -> DataFrame:
    """``rows`` with each ``question`` (distinct texts) and the ``score`` of its bigrams against ``text``.

    Each distinct text is scored once; the scores are written out, so that no join works them out again.
    """
    asked = F.broadcast(questions.select("question", T.bigrams(F.col("question")).alias("b")))
    texts = rows.select(F.col(text).alias("said")).distinct().select("said", T.bigrams(F.col("said")).alias("a"))
    scores = written(texts.crossJoin(asked).select("said", "question", T.overlap_score(F.col("a"), F.col("b")).alias("score")), "scores")
    scores = F.broadcast(scores) if scores.count() <= FEW_SCORES else scores
    return rows.join(scores, F.col(text).eqNullSafe(F.col("said"))).drop("said")


def lexical_rerank(asked: DataFrame, chunks: DataFrame, k: int, *, where: Column | None = None, tag: str | None = None) -> DataFrame:
    """The ``k`` best chunks of each source asked for (``query_id``, ``question``, ``source``) by shared bigrams; ties by anchor.

    Equal texts have equal scores, so only distinct ones of a source are scored. Of chunks with
    one text only the first ``k`` by anchor can be hits, and of texts only the ``k`` that come
    first by score and least anchor.
    """
    chunks = chunks if where is None else chunks.where(where)
    chunks = chunks if tag is None else chunks.where(F.array_contains("tags", tag))
    chunks = chunks.where("source IS NOT NULL").withColumn("said", F.coalesce("content", F.lit("")))
    asked = asked.where("source IS NOT NULL").withColumn("wanted", F.coalesce("question", F.lit("")))
    first = lambda df, *by, order: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= k).drop("r")
    texts = chunks.groupBy("source", "said").agg(F.min("anchor").alias("least"), F.bool_or(F.col("anchor").isNull()).alias("open"))
    texts = texts.select("source", "said", F.when(~F.col("open"), F.col("least")).alias("least"), T.bigrams(F.col("said")).alias("grams"), F.pmod(F.xxhash64("said"), F.lit(SPREAD)).alias("part"))
    questions = asked.select("source", "wanted").distinct().withColumn("asked_for", T.bigrams(F.col("wanted")))
    questions = questions.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    pairs = questions.join(texts, ["source", "part"]).select("source", "wanted", "said", "least", T.overlap_score(F.col("grams"), F.col("asked_for")).alias("score"))
    pairs = first(pairs, "source", "wanted", order=[F.desc("score"), F.asc("least")]).drop("least")
    best = pairs.join(first(chunks, "source", "said", order=[F.asc("anchor")]), ["source", "said"])
    best = best.withColumn("source_rank", F.row_number().over(Window.partitionBy("source", "wanted").orderBy(F.desc("score"), F.asc("anchor")))).where(F.col("source_rank") <= k)
    rest = [c for c in chunks.columns if c not in ("source", "said")]
    return asked.join(best, ["source", "wanted"]).select("source", *[c for c in asked.columns if c not in ("source", "wanted")], *rest, "score", "source_rank")
