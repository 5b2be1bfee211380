"""Retrieval metrics, corpus preparation for evaluation, and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import written

KS = (1, 3, 5, 10, 20)


def metric_names(ks=KS, mrr_k: int = 10, ndcg_k: int = 10) -> list[str]:
    return [*[f"{m}_{k}" for k in ks for m in ("recall", "hit_rate")], f"mrr_{mrr_k}", f"ndcg_{ndcg_k}"]


def query_metrics(retrieved: DataFrame, gold: DataFrame, *, ks=KS, mrr_k: int = 10, ndcg_k: int = 10) -> DataFrame:
    """A row per query of ``gold``: recall, hit rate, MRR and nDCG at the cut-offs, ``first_hit_rank`` and ``hit``.

    ``retrieved`` has ``query_id, item, rank`` (items once a query); ``gold`` has
    ``query_id, item``. Relevance is binary.
    """
    gold = gold.select("query_id", "item").distinct()
    need = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = retrieved.join(gold, ["query_id", "item"]).select("query_id", "rank")
    return _metrics(need, hits, ks, mrr_k, ndcg_k)


def class_metrics(retrieved: DataFrame, queries: DataFrame, items: DataFrame, *, ks=KS, mrr_k: int = 10, ndcg_k: int = 10) -> DataFrame:
    """:func:`query_metrics` where the gold of a query is all items of its class, without a row per query and item.

    ``queries`` has ``query_id, label``, one class a query, ``items`` has ``item, label``. A
    class is counted once, and only the items that were retrieved are looked up.
    """
    asked, items = queries.select("query_id", "label").distinct(), items.select("item", "label").distinct()
    sizes = items.groupBy("label").agg(F.count("*").alias("n_gold"))
    need = asked.join(sizes, "label").select("query_id", "n_gold")
    own = retrieved.join(asked, "query_id")
    hits = own.join(items, ["item", "label"]).select("query_id", "rank")
    return _metrics(need, hits, ks, mrr_k, ndcg_k)


def _metrics(need: DataFrame, hits: DataFrame, ks, mrr_k: int, ndcg_k: int) -> DataFrame:
    """Metrics from the size of each query's gold and the ranks of its hits."""
    within = lambda k: F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    sums = [within(k).alias(f"n{k}") for k in ks]
    dcg = F.sum(F.when(F.col("rank") <= ndcg_k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    facts = hits.groupBy("query_id").agg(*sums, dcg.alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    first = F.when(F.col("first") <= max(ks), F.col("first"))
    columns = []
    for k in ks:
        n = F.coalesce(F.col(f"n{k}"), F.lit(0))
        columns += [(n / F.col("n_gold")).alias(f"recall_{k}"), F.when(n > 0, 1.0).otherwise(0.0).alias(f"hit_rate_{k}")]
    return need.join(facts, "query_id", "left").select(
        "query_id",
        *columns,
        F.when(F.col("first") <= mrr_k, 1 / F.col("first")).otherwise(0.0).alias(f"mrr_{mrr_k}"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias(f"ndcg_{ndcg_k}"),
        first.alias("first_hit_rank"),
        first.isNotNull().alias("hit"),
    )


def mean_metrics(per_query: DataFrame, *by: str, names: list[str] | None = None) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.avg(n).alias(n) for n in names or metric_names()])


def latency_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, nearest-rank p50 and p95, least and most."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_ms"), rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """Rows numbered from 1 over the whole table, without one task for all rows.

    Rows are dealt out in ranges of the order; a range's first number comes from
    the counts of the ranges before it. The ranges are written out first, so that
    counts and numbers see the same ones. Rows with equal ``order`` are numbered in any order.
    """
    split = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = split.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = counts.select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return split.withColumn("__within", within).join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def corpus_of(passages: DataFrame, *, prefix: str = "corpus") -> DataFrame:
    """Distinct passages: ``source``, ``text``, ``roles``, ``sample_ids``.

    ``passages`` has ``sample_id, role, text``. Texts are stripped, empty ones left
    out, and numbered in their order: ``prefix/doc_0001.md``.
    """
    texts = passages.select("sample_id", "role", T.strip(F.col("text")).alias("text")).where("text <> ''")
    groups = texts.groupBy("text").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("sample_id")).alias("sample_ids"))
    return numbered(groups, F.col("text")).select(F.format_string(f"{prefix}/doc_%04d.md", "position").alias("source"), "text", "roles", "sample_ids")


def gold_of(passages: DataFrame, corpus: DataFrame, role: str = "positive") -> DataFrame:
    """(``query_id``, ``item``): the corpus sources of each sample's passages of a role."""
    texts = passages.where(F.col("role") == role).select(F.col("sample_id").alias("query_id"), T.strip(F.col("text")).alias("text"))
    return texts.join(corpus.select("text", F.col("source").alias("item")), "text").select("query_id", "item").distinct()


def hash_sample(df: DataFrame, n: int, key: str, seed: str = "20260813") -> DataFrame:
    """``n`` rows in the order of a seeded hash of ``key``; of equal keys one counts."""
    return df.dropDuplicates([key]).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).limit(n)


def head_per_group(df: DataFrame, n: int, by: str, *order) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= n)


def compared_retrievers(basic: DataFrame, local: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall at ``k`` of both, their difference, MRR, and how many queries gain or lose all hits."""
    return compared_metrics(query_metrics(basic, gold, ks=(k,)), query_metrics(local, gold, ks=(k,)), k)


def compared_metrics(basic: DataFrame, local: DataFrame, k: int = 5) -> DataFrame:
    """:func:`compared_retrievers` from the metrics of each query."""
    a = basic.select("query_id", F.col(f"recall_{k}").alias("a"), F.col("mrr_10").alias("a_mrr"))
    b = local.select("query_id", F.col(f"recall_{k}").alias("b"), F.col("mrr_10").alias("b_mrr"))
    return a.join(b, "query_id").agg(
        F.avg("a").alias("basic_recall"),
        F.avg("b").alias("local_recall"),
        (F.avg("b") - F.avg("a")).alias("recall_delta"),
        F.avg("a_mrr").alias("basic_mrr"),
        F.avg("b_mrr").alias("local_mrr"),
        F.sum(F.when((F.col("a") == 0) & (F.col("b") > 0), 1).otherwise(0)).alias("wins"),
        F.sum(F.when((F.col("a") > 0) & (F.col("b") == 0), 1).otherwise(0)).alias("harms"),
    )


def set_scores(found: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """Precision and recall of a set of rows against a gold set."""
    found, gold = found.select(*on).distinct(), gold.select(*on).distinct()
    joined = found.withColumn("f", F.lit(1)).join(gold.withColumn("g", F.lit(1)), on, "full_outer")
    both = F.sum(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0))
    return joined.agg(F.count("f").alias("n_found"), F.count("g").alias("n_gold"), both.alias("n_both")).select("*", (F.col("n_both") / F.col("n_found")).alias("precision"), (F.col("n_both") / F.col("n_gold")).alias("recall"))


def evidence_recall(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """A row per query of ``gold``: the share of its evidence among the first ``k``, whether all or any of it is, and the first rank."""
    gold = gold.select("query_id", "item").distinct()
    need = gold.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = retrieved.where(F.col("rank") <= k).join(gold, ["query_id", "item"]).groupBy("query_id").agg(F.countDistinct("item").alias("n"), F.min("rank").alias("first_relevant_rank"))
    n = F.coalesce("n", F.lit(0))
    facts = need.join(hits, "query_id", "left")
    return facts.select("query_id", (n / F.col("need")).alias("evidence_recall"), (n == F.col("need")).alias("all_recalled"), (n > 0).alias("any_recalled"), "first_relevant_rank")


def evidence_means(per_query: DataFrame, *by: str) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("int"))
    return per_query.groupBy(*by).agg(F.avg("evidence_recall").alias("evidence_recall"), share("all_recalled").alias("all_recalled"), share("any_recalled").alias("any_recalled"), F.avg(F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0))).alias("mrr"))


def retrieval_diagnostics(queries: DataFrame, retrieved: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: the share of queries with a source, sources a query, and the share of the corpus (``item``) that was retrieved."""
    each = queries.select("query_id").join(retrieved.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    per_query = each.agg(F.avg((F.col("n") > 0).cast("int")).alias("nonempty"), F.avg("n").alias("sources_a_query"))
    seen = retrieved.agg(F.countDistinct("item").alias("seen")).crossJoin(corpus.agg(F.countDistinct("item").alias("all")))
    return per_query.crossJoin(seen).select("nonempty", "sources_a_query", (F.col("seen") / F.greatest("all", F.lit(1))).alias("coverage"))  # one row each


def zipped(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of both in the places that they have in their orders, as far as both go; ``position`` counts from 1."""
    return numbered(left, F.col(left_order)).join(numbered(right, F.col(right_order)), "position")


def case_id(task, item_id, index):
    """Id of an evaluation case: its task and twelve digits of a hash."""
    index = index.cast("string")
    return F.concat(task, F.lit("-"), F.substring(F.sha2(F.concat_ws("\0", task, F.coalesce(T.blank_to_null(item_id.cast("string")), index), index), 256), 1, 12))


def evidence_count(task):
    """How many documents a task's name asks for."""
    return F.regexp_extract(task, r"(\d+)docs?$", 1).cast("int")


def safety(local: DataFrame, forbidden: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row: the share of ``negatives`` (queries with no answer) that got nothing from the graph, and how many forbidden items came back."""
    pass_rate = negatives.select("query_id").join(local.select("query_id").distinct().withColumn("met", F.lit(1)), "query_id", "left").agg(F.avg(F.when(F.col("met").isNull(), 1.0).otherwise(0.0)).alias("safe_negative_rate"))
    leaks = local.select("query_id", "item").distinct().join(forbidden.select("query_id", "item").distinct(), ["query_id", "item"]).agg(F.count("*").alias("leaks"))
    return pass_rate.crossJoin(leaks)  # one row each
