"""A vault of linked notes made from the star-schema tables, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: The notes in SQL that Spark and DuckDB both read.
NOTES_SQL = r"""
SELECT concat('nations/', n_name, '.md') AS source, concat('N', CAST(n_nationkey AS VARCHAR(20))) AS alias, 'nation' AS tag,
       concat('# ', n_name, '{nl}{nl}A nation of [[regions/R', CAST(n_regionkey AS VARCHAR(20)), '|its region]].{nl}') AS content
FROM nation
UNION ALL
SELECT concat('suppliers/S', CAST(s_suppkey AS VARCHAR(20)), '.md'), s_name, 'supplier',
       concat('# Supplier ', CAST(s_suppkey AS VARCHAR(20)), '{nl}{nl}From [[N', CAST(s_nationkey AS VARCHAR(20)), ']] with `[[code]]`.{nl}{nl}## Parts{nl}{nl}See [[P', CAST(s_suppkey AS VARCHAR(20)), ']] and ![[pic.png]] and [[ghost-', CAST(s_suppkey % 7 AS VARCHAR(20)), ']].')
FROM supplier
UNION ALL
SELECT concat('parts/', lower(replace(p_brand, '#', '-')), '/P', CAST(p_partkey AS VARCHAR(20)), '.md'), '', lower(p_type),
       concat('# ', p_name, '{nl}{nl}Made by [[suppliers/S', CAST(p_partkey % 100 AS VARCHAR(20)), '#Parts|maker]].{nl}{nl}## Notes ##{nl}{nl}', p_type, ' before [[P', CAST(p_partkey + 1 AS VARCHAR(20)), ']].')
FROM part
"""


def notes_sql() -> str:
    return NOTES_SQL.replace("{nl}", "\n")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, filename, folder, tags, aliases, content``."""
    names = ("nation", "supplier", "part")
    sql = notes_sql()
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    raw = spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})
    src = F.col("source")
    return raw.select("source", T.stem(src).alias("filename"), T.parent_dir(src).alias("folder"), F.array("tag").alias("tags"), F.filter(F.array("alias"), lambda x: x != "").alias("aliases"), "content")
