"""From raw documents to token ids in five stages, each an operator of ``lodestone.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps, with
the columns of ``documents``; the last returns token ids. ``run`` writes each stage's
result to the shared folder, so that a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import bpe_encode, tokenizer_path
from lodestone.llm.classifier import fit, score
from lodestone.llm.decontam import find_contamination, flagged
from lodestone.llm.line_dedup import document_keys, drop_repeated_lines
from lodestone.llm.shared import join_counted, load, plain_names, text_batches, written
from lodestone.llm.simhash import simhash_groups

#: Documents that score lower go.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    text_batches(spark)
    weights = fit(docs, load(spark, sf_dir, "labels"))
    plain = plain_names(docs)
    text = plain.columns[docs.columns.index("text")]
    return score(plain, weights, text=text).where(F.col("score") >= LEAST_QUALITY).drop("score").toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of line runs; ``n_chars`` follows, and documents of which no word is left go."""
    text_batches(spark)
    out = drop_repeated_lines(docs)
    cut = F.col("n_lines_removed") > 0
    out = out.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the least id, of several with it that with the least key.

    A document is an id and a text, so rows with one id and unlike texts are chosen
    from apart. Of rows that agree in both one stays, the least by a hash of all columns.
    A document without an id goes if one of its group has an id.
    """
    text_batches(spark)
    plain = plain_names(docs)
    names = dict(zip(docs.columns, plain.columns, strict=True))
    doc_id, text = F.col(names["doc_id"]).cast("bigint"), F.coalesce(F.col(names["text"]).cast("string"), F.lit(""))
    keyed = plain.select("*", F.xxhash64(doc_id.isNull(), doc_id, text).alias("key"))
    groups = simhash_groups(keyed.select("key", text.alias("text")), doc_id="key")
    counted = written(groups.groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count("*").alias("n")), "groups")
    ids = keyed.groupBy("key").agg(F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"))).alias("id"))
    first = counted.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id.none", "id.id", "key")).alias("first"))
    chosen = written(counted.join(first.select(F.col("first.key").alias("key")), "key").select("key", "n"), "chosen")
    total = counted.agg(F.sum("n")).first()[0] or 0
    once = join_counted(keyed, chosen.where("n = 1"), ["key"], total).select(*plain.columns)
    # rows that agree in id and text; two documents that share a key by chance both stay
    many = join_counted(keyed, chosen.where("n > 1"), ["key"], total)
    every = F.struct(*plain.columns)
    kept = many.groupBy("key", doc_id.alias("id"), F.sha2(text, 256).alias("text")).agg(F.min_by(every, F.struct(F.xxhash64(*plain.columns), F.to_json(every))).alias("row"))
    return once.unionByName(kept.select(*[F.col(f"row.{c}").alias(c) for c in plain.columns])).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the contamination rule finds."""
    text_batches(spark)
    plain = plain_names(docs)
    names = dict(zip(docs.columns, plain.columns, strict=True))
    keyed = plain.select("*", *document_keys(names["doc_id"], names["text"]))
    found = flagged(find_contamination(keyed, load(spark, sf_dir, "benchmark"), doc_id="d", doc_key="key", text=names["text"]))
    bad = written(found.where("contaminated").select(F.col("doc_id").alias("d"), F.col("doc_key").alias("key")).distinct(), "contaminated")
    return keyed.join(bad, ["d", "key"], "left_anti").select(*plain.columns).toDF(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed as little-endian unsigned 32-bit integers, checked by decoding."""
    text_batches(spark)
    path = tokenizer_path()
    coded = bpe_encode(docs, path, keep=["doc_id", "text"], decoded="decoded")
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Logistic regression, suffix intervals, fingerprints and BPE have no SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
