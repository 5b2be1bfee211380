"""URL filters: host-suffix and path-prefix expressions joined on short digests.

Each distinct URL is expanded into the expressions that a rule could equal: the
host suffixes with as many labels as some rule's host has, and the path prefixes
as long as some rule's path. The expressions meet the rules on the first four
bytes of a SHA-256 digest; the full digest then confirms, and the longest
rule decides. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import join_counted, plain_names

#: Fixed rules of the pages query: (host, path, verdict).
PAGE_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: A rule table with at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_RULES = 100_000


def url_parts(url):
    """(host, path) of a URL column; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=PAGE_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each row of ``pages``.

    A rule fits its host and all subdomains where the URL's path starts with the
    rule's path; the longest fitting rule (host and path together) wins, between
    equals the longer path, then block. Rules with a null are ignored, and so is
    a repeated rule. Without a fitting rule ``rule`` is null and the verdict is
    ``default``: a lookup in a list lets pass what the list does not name. Null
    and malformed URLs have an empty host and path; they take no part in the join.
    Rows keep their number and order of columns; columns of these four names are
    replaced, and no other name does harm. Rows of a frequent URL stay where they are.
    """
    plain = plain_names(pages)
    names = dict(zip(pages.columns, plain.columns, strict=True))
    rows = plain.withColumn("j_url", F.col(names[url]).cast("string"))
    rules = rules.select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    shape = rules.agg(
        F.collect_set(F.size(F.split("r_host", r"\.", -1))).alias("labels"),
        F.collect_set(F.length("r_path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    host, path = url_parts(F.col("j_url"))
    known = rows.where(F.col("j_url").contains("://"))
    counted = known.groupBy("j_url").agg(F.count("*").alias("n"))
    urls = counted.select("j_url", host.alias("j_host"), path.alias("j_path"))
    labels = F.array(*[F.lit(int(x)) for x in sorted(shape["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(int(x)) for x in sorted(shape["lengths"])]).cast("array<int>")
    parts = F.split("j_host", r"\.", -1)
    expressions = (
        urls.withColumn("labels", F.explode(labels))
        .where(F.col("labels") <= F.size(parts))
        .withColumn("suffix", F.expr("substring_index(j_host, '.', -labels)"))
        .withColumn("length", F.explode(lengths))
        .where(F.col("length") <= F.length("j_path"))
        .select("j_url", _digest(F.col("suffix"), F.expr("substring(j_path, 1, length)")).alias("digest"))
    )
    listed = rules.select(_digest(F.col("r_host"), F.col("r_path")).alias("r_digest"), "r_host", "r_path", "r_verdict")
    listed = listed.withColumn("short", F.substring("r_digest", 1, 8))
    if shape["n"] <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    size = F.length("r_host") + F.length("r_path")
    won = (
        expressions.withColumn("short", F.substring("digest", 1, 8))
        .join(listed, "short")
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("j_url")
        .agg(F.max(F.struct(size, F.length("r_path"), F.col("r_verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("won"))
        .select("j_url", F.col("won.rule").alias("j_rule"), F.col("won.r_verdict").alias("j_verdict"))
    )
    every = counted.join(won, "j_url", "left")
    found = join_counted(known, every, ["j_url"], known.count())
    none = F.lit(None).cast("string")
    rest = rows.where(~F.coalesce(F.col("j_url").contains("://"), F.lit(False))).select("*", none.alias("j_rule"), none.alias("j_verdict"))
    host, path = url_parts(F.col("j_url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return found.unionByName(rest).select(
        *[F.col(names[c]).alias(c) for c in kept],
        host.alias("host"),
        path.alias("path"),
        F.col("j_rule").alias("rule"),
        F.coalesce("j_verdict", F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), r(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
