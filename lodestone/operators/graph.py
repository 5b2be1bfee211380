"""The structure graph of a vault: links, nodes, edges, neighbours and bounded expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import dropped, written

WEIGHTS = {"HAS_SECTION": 0.2, "LINKS_TO": 1.0, "TAGGED_WITH": 0.35, "MENTIONS": 0.8}
#: Edges of these types cost no hop.
FREE = ("HAS_SECTION", "MENTIONS")
DECAY = 0.85


def links(chunks: DataFrame) -> DataFrame:
    """A row per wikilink of the chunks: ``source, anchor, chunk_id, raw, target, target_anchor, alias, embedded``."""
    found = chunks.select("source", "anchor", "chunk_id", F.explode(T.wikilinks(F.col("content"))).alias("l"))
    return found.select("source", "anchor", "chunk_id", "l.raw", "l.target", F.col("l.anchor").alias("target_anchor"), "l.alias", "l.embedded")


def provided(notes: DataFrame) -> DataFrame:
    """The names that links can mean a note by, each once: ``key, note, source``, the key ``path:``, ``name:`` or ``alias:`` and the name."""
    return provided_rows(notes).distinct()


def provided_rows(notes: DataFrame) -> DataFrame:
    """:func:`provided`, a name as often as the note gives it."""
    paths = notes.select("source", T.unix_path(F.col("source")).alias("note"), "aliases")
    paths = paths.withColumn("path", T.casefold(F.regexp_replace(T.without_md(F.col("note")), "^/+|/+$", "")))
    path = paths.select(F.concat(F.lit("path:"), "path").alias("key"), "note", "source")
    name = paths.select(F.concat(F.lit("name:"), T.base_name(F.col("path"))).alias("key"), "note", "source")
    alias = paths.select("note", "source", F.explode("aliases").alias("alias")).select(T.casefold(T.strip(F.col("alias"))).alias("k"), "note", "source").where("k <> ''")
    return path.unionByName(name).unionByName(alias.select(F.concat(F.lit("alias:"), "k").alias("key"), "note", "source"))


def _with_keys(found: DataFrame) -> DataFrame:
    """Links with ``t``, the target as a path, and the names that it may be: ``k_path``, ``k_beside``, ``k_name``."""
    target = T.unix_path(T.strip(T.url_decoded(F.col("target"))))
    plain = F.regexp_replace(T.without_md(F.col("t")), "^/+|/+$", "")
    folder = T.parent_dir(F.col("source"))
    # a path's ".." is kept as it is written, "." is not
    beside = F.when(folder == "", F.col("plain")).otherwise(F.concat(folder, F.lit("/"), F.col("plain")))
    out = found.withColumn("t", target).withColumn("plain", plain)
    return out.withColumns({"k_path": T.casefold(F.col("plain")), "k_beside": T.casefold(F.regexp_replace(T.without_md(beside), "^/+|/+$", "")), "k_name": T.casefold(T.base_name(F.col("plain")))})


def wanted(found: DataFrame) -> DataFrame:
    """The reverse index of links, each pair once: ``key`` as in :func:`provided`, and the ``source`` whose links may mean it."""
    return wanted_rows(found).distinct()


def wanted_rows(found: DataFrame) -> DataFrame:
    """:func:`wanted`, a pair as often as links have it."""
    out = _with_keys(found).where("t <> ''").where(~(F.col("embedded") | T.is_attachment(F.col("t"))))
    keys = F.array(F.concat(F.lit("path:"), "k_path"), F.concat(F.lit("path:"), "k_beside"), F.concat(F.lit("alias:"), "k_path"), F.concat(F.lit("name:"), "k_name"))
    return out.select(F.explode(keys).alias("key"), "source")


def resolved(found: DataFrame, notes: DataFrame) -> DataFrame:
    """Add ``status`` (resolved, ambiguous, unresolved, attachment) and ``resolved_source`` to links.

    A target is sought as a whole path, then below the linking note's folder, then
    as an alias, then as a file name; the last two only count if they are unique.
    An empty target is the note itself. Four equi-joins on keys that are unique
    on the note side, so no link multiplies.
    """
    return resolved_by(found, provided(notes))


def resolved_by(found: DataFrame, names: DataFrame) -> DataFrame:
    """:func:`resolved` with rows of :func:`provided`: those of all keys of :func:`wanted` must be there."""
    of = lambda kind: names.where(F.col("key").startswith(f"{kind}:")).withColumn("key", F.substring("key", len(kind) + 2, 1 << 30))
    exact = of("path").groupBy(F.col("key").alias("path")).agg(F.max("note").alias("note"))
    # the note of a name that has one only, and how many it has: never a list of them
    some = lambda kind: of(kind).groupBy(F.col("key").alias(f"{kind[0]}_key")).agg(F.countDistinct("note").alias(f"{kind}_n"), F.min("note").alias(f"{kind}_note"))
    out = _with_keys(found)
    out = out.join(exact.select(F.col("path").alias("k_path"), F.col("note").alias("by_path")), "k_path", "left")
    out = out.join(exact.select(F.col("path").alias("k_beside"), F.col("note").alias("by_beside")), "k_beside", "left")
    out = out.join(some("alias"), F.col("k_path") == F.col("a_key"), "left")
    out = out.join(some("name"), F.col("k_name") == F.col("n_key"), "left")
    own = F.col("t") == ""
    attachment = F.col("embedded") | T.is_attachment(F.col("t"))
    many = F.when(F.col("alias_n").isNotNull(), F.col("alias_n") > 1).otherwise(F.coalesce(F.col("name_n") > 1, F.lit(False)))
    single = F.when(F.col("alias_n") == 1, F.col("alias_note")).when(F.col("alias_n").isNull() & (F.col("name_n") == 1), F.col("name_note"))
    place = F.when(own, F.col("source")).when(~attachment, F.coalesce("by_path", "by_beside", single))
    status = F.when(own, "resolved").when(attachment, "attachment").when(place.isNotNull(), "resolved").when(many, "ambiguous").otherwise("unresolved")
    return out.select(*found.columns, place.alias("resolved_source"), status.alias("status"))


def _node(df: DataFrame, id: Column, type: str, name: Column, *, source=None, anchor=None, content_hash=None, order: Column | None = None, **metadata: Column) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    data = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]) if metadata else F.create_map().cast("map<string,string>")
    return df.select(id.alias("id"), F.lit(type).alias("type"), text(name).alias("name"), text(source).alias("source"), text(anchor).alias("anchor"), text(source).alias("owner_source"), text(content_hash).alias("content_hash"), data.alias("metadata"), (order if order is not None else text(source)).alias("ord"), F.col("source").alias("writer"))


def _edge(df: DataFrame, id: Column, a: Column, b: Column, type: str, *, source: Column, anchor: Column | None = None, chunk: Column | None = None) -> DataFrame:
    none = F.lit("")
    return df.select(id.alias("id"), a.alias("source_id"), b.alias("target_id"), F.lit(type).alias("type"), F.lit(WEIGHTS[type]).alias("weight"), source.alias("evidence_source"), (none if anchor is None else anchor).alias("evidence_anchor"), (none if chunk is None else chunk).alias("evidence_chunk_id"))


#: Chunks whose writes one task merges, about.
TASK_CHUNKS = 50_000


def spread(writes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Writes dealt by id to as many tasks as the chunks ask for.

    A merge of texts sorts what its task has, so a task must not get more as the vault
    grows; dealt by id beforehand, rows are merged where they are and not sorted by the reading tasks too.
    """
    n = -(-chunks.count() // TASK_CHUNKS)
    return writes.repartition(max(n, writes.sparkSession.sparkContext.defaultParallelism), "id")


def structure_nodes(notes: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Document, section, tag and unresolved nodes, each id once (see :func:`upserted_nodes`). ``chunks`` are counted."""
    return upserted_nodes(spread(node_writes(notes, chunks, found), chunks))


def node_writes(notes: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that :func:`structure_nodes` merges, with the source that writes each as ``writer``.

    Writers are ordered by source, and for one id a note's own row comes after
    the rows of links to it, so that a link never blanks a note.
    """
    doc, src = T.document_id(F.col("source")), F.col("source")
    documents = _node(notes, doc, "document", F.coalesce(T.blank_to_null(F.col("filename")), T.stem(src)), source=src, content_hash=F.sha2("content", 256), order=F.concat(F.lit("1"), src), exists=F.lit("true"), folder=F.col("folder"), aliases=F.array_join("aliases", "|"))
    part = _node(chunks, T.section_id(src, F.col("anchor")), "section", F.coalesce(T.blank_to_null(F.col("section_title")), T.blank_to_null(F.col("anchor")), F.lit(T.UNTITLED)), source=src, anchor=F.col("anchor"), content_hash=F.sha2("content", 256), chunk_id=F.col("chunk_id"))
    tags = notes.select("source", F.explode(F.array_distinct("tags")).alias("tag"))
    tag = _node(tags, T.stable_id("tag", T.casefold(F.col("tag"))), "tag", F.col("tag"), order=F.concat_ws("\0", "source", "tag"), normalized=T.casefold(F.col("tag")))
    tag = tag.withColumns({"source": F.lit(""), "owner_source": F.lit("")})
    linked = found.where("status = 'resolved'")
    to = _node(linked, T.document_id(F.col("resolved_source")), "document", T.stem(F.col("resolved_source")), source=F.col("resolved_source"), order=F.concat(F.lit("0"), src), exists=F.lit("true"))
    name = F.coalesce(T.blank_to_null(F.col("target")), F.concat(F.lit("#"), F.col("target_anchor")))
    loose = _node(found.where("status IN ('unresolved', 'ambiguous')"), T.stable_id("unresolved", T.casefold(name)), "unresolved", name, order=src, status=F.col("status"))
    return documents.unionByName(part).unionByName(tag).unionByName(to).unionByName(loose)


def structure_edges(notes: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """HAS_SECTION, TAGGED_WITH and LINKS_TO edges, each id once. ``chunks`` are counted."""
    return upserted_edges(spread(edge_writes(notes, chunks, found), chunks))


def edge_writes(notes: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that :func:`structure_edges` merges, written by ``evidence_source``."""
    src, doc = F.col("source"), T.document_id(F.col("source"))
    section = T.section_id(src, F.col("anchor"))
    has = _edge(chunks, T.stable_id("edge", doc, section, F.lit("HAS_SECTION")), doc, section, "HAS_SECTION", source=src, anchor=F.col("anchor"), chunk=F.col("chunk_id"))
    tags = notes.select("source", F.explode(F.array_distinct("tags")).alias("tag"))
    tag = T.stable_id("tag", T.casefold(F.col("tag")))
    tagged = _edge(tags, T.stable_id("edge", doc, tag, F.lit("TAGGED_WITH")), doc, tag, "TAGGED_WITH", source=src)
    name = F.coalesce(T.blank_to_null(F.col("target")), F.concat(F.lit("#"), F.col("target_anchor")))
    target = F.when(F.col("status") == "resolved", T.document_id(F.col("resolved_source"))).otherwise(T.stable_id("unresolved", T.casefold(name)))
    kept = found.where("status <> 'attachment'").withColumn("target_node", target)
    to = _edge(kept, T.stable_id("edge", section, F.col("target_node"), F.lit("LINKS_TO"), F.col("chunk_id"), F.col("raw")), section, F.col("target_node"), "LINKS_TO", source=src, anchor=F.col("anchor"), chunk=F.col("chunk_id"))
    return has.unionByName(tagged).unionByName(to).withColumn("ord", F.col("evidence_source"))


def upserted_nodes(writes: DataFrame) -> DataFrame:
    """Writes of nodes in the order of ``ord``, merged by id.

    Type and name come from the last write; of source, anchor, owner and hash the
    last non-empty value stays; metadata are merged key by key, later ones win.
    """
    last = lambda c: F.max_by(c, F.struct("ord", c))
    filled = lambda c: F.coalesce(F.max_by(F.col(c), F.when(F.col(c) != "", F.struct("ord", c))), F.lit(""))
    base = writes.groupBy("id").agg(last("type").alias("type"), last("name").alias("name"), *[filled(c).alias(c) for c in ("source", "anchor", "owner_source", "content_hash")])
    pairs = writes.select("id", "ord", F.explode("metadata").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", F.struct("ord", "v")).alias("v"))
    merged = pairs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return base.join(merged, "id", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def upserted_edges(writes: DataFrame) -> DataFrame:
    """The last write of each edge id, whole."""
    rest = [c for c in writes.columns if c not in ("id", "ord")]
    return writes.groupBy("id").agg(F.max(F.struct("ord", *rest)).alias("w")).select("id", *[F.col(f"w.{c}").alias(c) for c in rest])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tag, unresolved and entity nodes that no edge touches."""
    used = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    return nodes.where(F.col("type").isin("tag", "unresolved", "entity")).join(used, "id", "left_anti")


def without_source(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a note is deleted: its sections and edges go, its own node stays, marked as gone."""
    edges = edges.where(F.col("evidence_source") != source)
    own = F.col("owner_source") == source
    nodes = nodes.where(~(own & (F.col("type") == "section")))
    gone = own & (F.col("type") == "document")
    kept = F.map_filter("metadata", lambda k, v: k != "exists")
    nodes = nodes.withColumns({"content_hash": F.when(gone, F.lit("")).otherwise(F.col("content_hash")), "metadata": F.when(gone, F.map_concat(kept, F.create_map(F.lit("exists"), F.lit("false")))).otherwise(F.col("metadata"))})
    return nodes.join(orphans(nodes, edges).select("id"), "id", "left_anti"), edges


def replaced_source(old: DataFrame, new: DataFrame, by: str = "evidence_source") -> DataFrame:
    """``old`` without the rows of the sources in ``new``, and ``new``."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``kind``, ``type``, ``n``): how many nodes and edges of each type."""
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def adjacency(edges: DataFrame, most: int = 30) -> DataFrame:
    """(``node``, ``neighbor``, ``edge_id``, ``type``, ``weight``, ``forward``, ``edge_rank``) in both directions, the heaviest ``most`` of a node.

    A self-loop is one neighbour.
    """
    keep = [F.col("id").alias("edge_id"), "type", "weight"]
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbor"), *keep, F.lit(True).alias("forward"))
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbor"), *keep, F.lit(False).alias("forward"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), F.asc("edge_id")))
    return out.unionByName(back).withColumn("edge_rank", rank).where(F.col("edge_rank") <= most)


def seed_nodes(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``query_id``, ``node``) of (``query_id``, ``source``, ``anchor``): the section and the document, where they exist."""
    section = F.when(F.coalesce("anchor", F.lit("")) != "", T.section_id(F.col("source"), F.col("anchor")))
    asked = seeds.select("query_id", F.explode(F.array(section, T.document_id(F.col("source")))).alias("node")).where("node IS NOT NULL").distinct()
    return asked.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")


def expand(seeds: DataFrame, edges: DataFrame, *, max_hops: int = 2, max_neighbors: int = 30, min_score: float = 0.0) -> DataFrame:
    """Best-score expansion for all queries at once: ``query_id, node, score, depth, path``.

    Each step multiplies the score by the edge's weight and ``DECAY``, and costs a
    hop unless the edge is free. A node keeps its best label and expands from it
    only. Labels are settled in rounds: as a step shrinks a score at least by
    ``DECAY``, all labels above ``DECAY`` times a query's best open score are final.
    Each round is an equi-join with the adjacency, written out.
    """
    near = written(adjacency(edges, max_neighbors).withColumnRenamed("edge_rank", "near_rank"), "adjacency")
    none = F.lit(None)
    start = seeds.select("query_id", "node").distinct()
    frontier = start.select("query_id", "node", F.lit(1.0).alias("score"), none.cast("double").alias("pred_score"), F.lit(0).alias("depth"), none.cast("int").alias("pred_depth"), none.cast("string").alias("pred_id"), F.array("node").alias("path"), none.cast("int").alias("edge_rank"))
    order = [F.desc("score"), F.desc("pred_score"), F.asc("pred_depth"), F.asc("pred_id"), F.asc("path"), F.asc("edge_rank")]
    first = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*order)) == 1
    settled = None
    while True:
        best = frontier.groupBy("query_id").agg(F.max("score").alias("top"))
        labels = frontier.withColumn("first", first).join(best, "query_id")
        labels = written(labels.withColumn("final", F.col("first") & (F.col("score") > DECAY * F.col("top"))).drop("first", "top"), "labels")
        if labels.isEmpty():
            break
        final = labels.where("final").drop("final")
        settled = final if settled is None else settled.unionByName(final)
        depth = F.col("depth") + F.when(F.col("type").isin(*FREE), 0).otherwise(1)
        step = final.join(near, "node").select(
            "query_id",
            F.col("neighbor").alias("node"),
            (F.col("score") * F.col("weight") * F.lit(DECAY)).alias("score"),
            F.col("score").alias("pred_score"),
            depth.alias("depth"),
            F.col("depth").alias("pred_depth"),
            F.col("node").alias("pred_id"),
            F.concat("path", F.array("neighbor")).alias("path"),
            F.col("near_rank").alias("edge_rank"),
        )
        step = step.where((F.col("depth") <= max_hops) & (F.col("score") > min_score))
        frontier = labels.where("NOT final").drop("final").unionByName(step).join(settled.select("query_id", "node"), ["query_id", "node"], "left_anti")
    dropped(near)
    return settled.select("query_id", "node", "score", "depth", "path") if settled is not None else start.select("query_id", "node", F.lit(1.0).alias("score"), F.lit(0).alias("depth"), F.array("node").alias("path"))


def graph_hits(expanded: DataFrame, nodes: DataFrame, excluded: DataFrame | None = None, most: int = 20) -> DataFrame:
    """Best label of each source among the document and section nodes reached: ``query_id, source, graph_score, path, rank``.

    Seeds themselves (paths of one node) are no hits; ``excluded`` has (``query_id``, ``source``).
    """
    places = nodes.where("type IN ('document', 'section') AND source <> ''").select(F.col("id").alias("node"), "source")
    found = expanded.where(F.size("path") > 1).join(places, "node")
    if excluded is not None:
        found = found.join(excluded.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
    one = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), F.asc("path")))
    found = found.withColumn("r", one).where("r = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("source")))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "source", F.least(F.lit(1.0), "score").alias("graph_score"), "path", "rank")


def described_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The best edge of each step of a path, in either direction: ``path_id, step, source, target, edge_id, type, traversed_forward``."""
    steps = paths.select("path_id", F.posexplode("path").alias("step", "node"))
    following = F.lead("node").over(Window.partitionBy("path_id").orderBy("step"))
    steps = steps.withColumn("target", following).where("target IS NOT NULL").withColumnRenamed("node", "source")
    pair = lambda a, b: F.struct(F.least(a, b), F.greatest(a, b))
    listed = edges.select(pair("source_id", "target_id").alias("pair"), F.col("id").alias("edge_id"), "type", "weight", "source_id")
    joined = steps.withColumn("pair", pair("source", "target")).join(listed, "pair")
    best = F.row_number().over(Window.partitionBy("path_id", "step").orderBy(F.desc("weight"), F.asc("edge_id")))
    return joined.withColumn("r", best).where("r = 1").select("path_id", "step", "source", "target", "edge_id", "type", (F.col("source_id") == F.col("source")).alias("traversed_forward"))


def neighbors(edges: DataFrame, nodes: DataFrame, asked: DataFrame, most: int = 30) -> DataFrame:
    """The 1-hop star of each asked node (``node``)."""
    near = adjacency(edges.join(asked.select(F.col("node").alias("source_id")), "source_id", "left_semi").unionByName(edges.join(asked.select(F.col("node").alias("target_id")), "target_id", "left_semi")).dropDuplicates(["id"]), most)
    return near.join(asked.select("node"), "node", "left_semi").join(nodes.select(F.col("id").alias("neighbor"), F.col("type").alias("neighbor_type"), "name"), "neighbor")
