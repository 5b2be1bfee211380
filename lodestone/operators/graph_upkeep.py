"""The structure graph of a vault, kept up to date from changed notes.

A set of tables holds the notes, their chunks and links; what these write into the graph
is worked out where it is read. Two indexes by name make a batch cost what it changes: ``provided`` lists the
names of each note (path, file name, aliases), and ``wanted`` the notes whose links may
mean a name. Where the notes behind a name change, only the links that want it are
resolved again, and only notes of which a link came out otherwise write anew.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import graph as G
from lodestone.operators.sync import last_of, latest_changes
from lodestone.operators.tableset import BUCKETS, TableSet
from lodestone.session import dropped, written

NOTE = ["source", "filename", "folder", "tags", "aliases", "content"]
#: What is kept of a chunk; ids are hashes of these, which no compression makes smaller, and are worked out where they are read.
CHUNK = ["source", "anchor", "section_title", "chunk_index", "content"]
LINK = ["source", "anchor", "chunk_index", "raw", "target", "target_anchor", "alias", "embedded"]

_written = functools.partial(written, codec="zstd")


def _stored(store: TableSet, name: str, keys: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of a table by key; none of the shape of ``like`` where it was never written."""
    rows = store.read_keys(name, keys)
    return like.limit(0) if rows is None else rows


def _identified(rows: DataFrame) -> DataFrame:
    """Chunks or links with their ``chunk_id``."""
    return rows.withColumn("chunk_id", T.chunk_id(F.col("source"), F.col("anchor"), F.col("chunk_index")))


def _reindexed(store: TableSet, name: str, old: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """Put the ``new`` rows of an index in place of the ``old``, both as often as they come; the rows that differ."""
    both = old.withColumn("step", F.lit(-1)).unionByName(new.withColumn("step", F.lit(1)))
    differ = both.groupBy(*new.columns).agg(F.min("step").alias("step"), F.max("step").alias("most")).where("step = most").drop("most")
    differ = _written(differ, name)
    store.change(name, differ.where("step = 1").drop("step"), by="key", gone=differ.where("step = -1").drop("step"), alike=True, buckets=buckets)
    return differ


def apply_changes(store: TableSet, notes: DataFrame, gone: DataFrame | None = None, *, buckets: int = BUCKETS) -> DataFrame:
    """Put ``notes`` in place of those with their sources, delete the sources in ``gone``, and commit once.

    Returns the sources that wrote anew: the changed ones, and those of which a link
    came out otherwise. The graph is then that of a build from all notes. Of rows of
    one source that with the greatest content stays; a source in both is replaced;
    rows without a source are left out. ``buckets`` counts at a table's first write. Nothing counts before the commit, so a lost
    driver leaves the version before, and the same changes can be applied again.
    """
    wide = notes.select(*NOTE).where("source IS NOT NULL")
    fresh = _written(last_of(wide.withColumn("order", F.to_json(F.struct("content", "tags", "aliases"))), ["source"], "order").select(*NOTE), "fresh-notes")
    own = fresh.select("source")
    changed = _written((own if gone is None else own.unionByName(gone.select("source").where("source IS NOT NULL"))).distinct(), "changed")
    before = _stored(store, "notes", changed, fresh).select(*NOTE)
    named = _reindexed(store, "provided", G.provided_rows(before), G.provided_rows(fresh), buckets)
    names = _written(named.select("key").distinct(), "names")

    chunks = _written(C.chunks(fresh).select(*CHUNK), "fresh-chunks")
    links = _written(G.links(chunks.withColumnRenamed("chunk_index", "chunk_id")).withColumnRenamed("chunk_id", "chunk_index").select(*LINK), "fresh-links")
    shape = links.withColumns({"resolved_source": F.lit(None).cast("string"), "status": F.lit("")})
    stale = _stored(store, "links", changed, shape).select(*LINK)
    want = _reindexed(store, "wanted", G.wanted_rows(stale), G.wanted_rows(links), buckets)

    # sources whose links may mean a name that other notes have now
    asking = _written(_stored(store, "wanted", names, want.drop("step")).select("source").distinct().join(changed, "source", "left_anti"), "asking")
    others = _written(_stored(store, "links", asking, shape).select(*shape.columns), "asking-links")
    todo = links.withColumn("changed", F.lit(True)).unionByName(others.select(*LINK, F.lit(False).alias("changed")))
    known = store.read_buckets("provided", G.wanted_rows(todo).select("key"))
    found = _written(G.resolved_by(todo, known), "found")
    again = found.where("NOT changed").select(*shape.columns)
    moved = _written(again.exceptAll(others).select("source").distinct(), "moved")
    writers = _written(changed.unionByName(moved), "writers")
    anew = _written(again.join(moved, "source", "left_semi").select(*shape.columns), "moved-links")
    said = _identified(found.where("changed").select(*shape.columns).unionByName(anew))
    for name, rows, replaced in (("notes", fresh, changed), ("chunks", chunks, changed), ("links", said, writers)):
        store.change(name, rows, by="source", gone=replaced, buckets=buckets)
    store.commit()
    for df in (fresh, changed, named, names, chunks, links, want, asking, others, found, moved, anew):
        dropped(df)
    return writers


def replace_all(store: TableSet, notes: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """Make the tables those of ``notes`` alone: stored sources that are not among them go."""
    old = store.read("notes")
    return apply_changes(store, notes, None if old is None else old.select("source"), buckets=buckets)


def graph_tables(store: TableSet) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as they stand: what notes, chunks and links write, merged by id as one build from all notes would."""
    kept = store.read("notes"), _identified(store.read("chunks")), store.read("links")
    return G.structure_nodes(*kept), G.structure_edges(*kept)


def watch_graph(changes: DataFrame, root: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, *, every: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the tables below ``root`` up to date from a change stream; without ``every`` all that is there, then stop.

    ``parse`` makes notes of the last (``source``, ``content``) of each source. A batch
    that is run again after a loss gives the same tables.
    """

    def step(batch: DataFrame, _: int) -> None:
        last = written(latest_changes(batch, tie=["change", "content"]), "batch")
        store = TableSet(batch.sparkSession, root)
        apply_changes(store, parse(last.where("change <> 'deleted'").select("source", "content")), last.where("change = 'deleted'").select("source"), buckets=buckets)
        dropped(last)

    write = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (write.trigger(processingTime=every) if every else write.trigger(availableNow=True)).start()
