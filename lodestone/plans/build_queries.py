"""Queries of what is kept up to date: the semantic build of a vault of parts, and the structure graph of a vault."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lodestone.operators import graph_upkeep as U
from lodestone.operators import semantic_build as B
from lodestone.operators.tableset import TableSet
from lodestone.plans.queries import SQL, query, table
from lodestone.plans.vault_tables import notes
from lodestone.session import shared_dir


def reader():
    """A scripted model: the first word of a part's note and its maker, and that the one is made by the other."""

    def ask(prompt: str) -> str:
        text, _, more = prompt.partition(".")
        name, _, maker = text.partition(" by ")
        if more:  # asked for what was missed
            return '{"entities": [], "relationships": []}'
        word = name.split(" ")[0]
        said = lambda n, kind, what: {"name": n, "type": kind, "description": what, "evidence_quote": n, "confidence": 0.9}
        link = {"source": word, "target": maker, "description": "made by", "strength": len(name) % 10, "predicate": "made by", "evidence_quote": " by ", "confidence": 0.9}
        return json.dumps({"entities": [said(word, "material", "a kind of part"), said(maker, "maker", "a maker")], "relationships": [link]})

    return ask


def _notes(spark, d, maker):
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("source"), F.concat(F.lit("a"), "p_size").alias("anchor"), F.concat(F.lit("c"), "p_partkey").alias("chunk_id"), F.concat("p_name", F.lit(" by "), maker, F.lit(".")).alias("content"))


@query(
    """WITH p AS (
      SELECT split_part(p_name, ' ', 1) AS w, CASE WHEN p_brand LIKE '%1' THEN 'REMADE' ELSE p_type END AS m, length(p_name) % 10 AS strength
      FROM part WHERE p_brand NOT LIKE 'Brand#5%' AND p_brand <> 'Brand#22'
    )
    SELECT 'entity' AS kind, w AS name, 'a kind of part' AS description, count(*) AS frequency, 0.0::DOUBLE AS strength FROM p GROUP BY w
    UNION ALL SELECT 'entity', m, 'a maker', count(*), 0.0 FROM p GROUP BY m
    UNION ALL SELECT 'relation', w || ' > ' || m, 'made by', count(*), sum(strength)::DOUBLE FROM p WHERE lower(w) <> lower(m) GROUP BY w, m
    UNION ALL SELECT 'source', p_brand, '', 1, 0.0 FROM part WHERE p_brand NOT LIKE 'Brand#5%' AND p_brand <> 'Brand#22' GROUP BY p_brand"""
)
def semantic_build(spark, d):
    """Four commits: all parts; sources that end in 1 get another maker, and those of Brand#5 are pruned; nothing; one source is deleted. Names that differ in case only are one mention, which no relation joins."""
    root = f"{shared_dir(spark)}/semantic-{uuid.uuid4().hex}"
    ext = B.Extractor(reader, gleanings=1)
    B.build(TableSet(spark, root), _notes(spark, d, F.col("p_type")), ext)
    changed = _notes(spark, d, F.when(F.col("p_brand").endswith("1"), "REMADE").otherwise(F.col("p_type"))).where("source NOT LIKE 'Brand#5%'")
    B.build(TableSet(spark, root), changed, ext)
    B.build(TableSet(spark, root), changed, ext)
    B.delete_source(TableSet(spark, root), "Brand#22")
    store = TableSet(spark, root)
    nodes, edges = store.read("entities"), store.read("relations")
    ends = edges.join(nodes.select(F.col("node_id").alias("source_id"), F.col("name").alias("a")), "source_id").join(nodes.select(F.col("node_id").alias("target_id"), F.col("name").alias("b")), "target_id")
    none = F.lit(0.0).alias("strength")
    out = nodes.select(F.lit("entity").alias("kind"), "name", "description", "frequency", none)
    out = out.unionByName(ends.select(F.lit("relation").alias("kind"), F.concat_ws(" > ", "a", "b").alias("name"), "description", "frequency", "strength"))
    return out.unionByName(store.read("source_state").select(F.lit("source").alias("kind"), F.col("source").alias("name"), F.lit("").alias("description"), F.lit(1).cast("bigint").alias("frequency"), none))


@query(SQL["structure_edges"])
def upkept_edges(spark, d):
    """The vault as it was: a third of the parts missing, another third with other links, a nation's alias gone, and notes more
    whose names are those of parts. One batch of changes makes it the vault as it is, so links of notes that did not change
    find other notes, or none."""
    now, part = notes(spark, d), F.crc32("source") % 3
    in_parts = F.col("source").startswith("parts/")
    kept = now.where(~in_parts | (part != 0))
    other = F.when(in_parts & (part == 1), F.concat(F.lit("# Earlier\n\nSee [[regions/R1]] and [[P7]].\n\n"), "content")).otherwise(F.col("content"))
    nameless = F.when(F.col("source").startswith("nations/A"), F.array().cast("array<string>")).otherwise(F.col("aliases"))
    more = now.where(in_parts & (part == 2)).withColumns({"source": F.concat(F.lit("old/"), "filename", F.lit(".md")), "folder": F.lit("old")})
    was = kept.withColumns({"content": other, "aliases": nameless}).unionByName(more)
    root = f"{shared_dir(spark)}/upkept-{uuid.uuid4().hex}"
    U.apply_changes(TableSet(spark, root), was, buckets=8)
    changed = now.where((in_parts & (part < 2)) | F.col("source").startswith("nations/A"))
    U.apply_changes(TableSet(spark, root), changed, more.select("source"), buckets=8)
    _, edges = U.graph_tables(TableSet(spark, root))
    ends = F.when(F.col("type") == "LINKS_TO", F.col("evidence_source")).otherwise(F.col("source_id"))
    return edges.where("type <> 'HAS_SECTION'").select("type", ends.alias("source_id"), "target_id", "weight")
