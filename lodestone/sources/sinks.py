"""Writers: Parquet tables, JSON lines and graph exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *, by: str | None = None, buckets: int = 64) -> None:
    """Parquet, split by a hash of ``by`` if given, so that one source's rows can be found and replaced."""
    if by:
        df = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")).repartition("bucket")
        df.write.mode("overwrite").partitionBy("bucket").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def gephi_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("Id"), F.col("name").alias("Label"), F.col("type").alias("Type"), F.col("source").alias("Source"), F.col("anchor").alias("Anchor"))


def gephi_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("Source"), F.col("target_id").alias("Target"), F.lit("Directed").alias("Type"), F.col("type").alias("Label"), F.col("weight").alias("Weight"), F.col("evidence_source").alias("EvidenceSource"), F.col("evidence_anchor").alias("EvidenceAnchor"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GraphML file, with ``part`` and ``id`` as their order."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), esc(c), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("part"), "id", F.concat(F.lit('<node id="'), esc("id"), F.lit('">'), data("label", "name"), data("type", "type"), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), "id", F.concat(F.lit('<edge id="'), esc("id"), F.lit('" source="'), esc("source_id"), F.lit('" target="'), esc("target_id"), F.lit('">'), data("type", "type"), data("weight", "weight"), F.lit("</edge>")).alias("line"))
    frame = nodes.sparkSession.createDataFrame(
        [(0, "", '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, id string, line string"
    )
    return frame.unionByName(n).unionByName(e)
