"""A graph kept up to date by batches of changes equals one built from all notes."""

import functools
import json
import random

import pytest
from test_graph import SCHEMA, VAULT, note

from lodestone.operators import chunking as C
from lodestone.operators import graph as G
from lodestone.operators import graph_upkeep
from lodestone.operators.tableset import TableSet
from lodestone.streaming.changes import read_changes


class U:
    """Few buckets: the tables are small."""

    apply_changes = functools.partial(graph_upkeep.apply_changes, buckets=3)
    replace_all = functools.partial(graph_upkeep.replace_all, buckets=3)
    watch_graph = functools.partial(graph_upkeep.watch_graph, buckets=3)
    graph_tables = graph_upkeep.graph_tables


def plain(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def same_as_rebuilt(spark, store, notes):
    df = spark.createDataFrame(notes, SCHEMA)
    chunks = C.chunks(df)
    found = G.resolved(G.links(chunks), df)
    nodes, edges = U.graph_tables(store)
    assert plain(store.read("links").select(*found.columns)) == plain(found)
    assert plain(nodes) == plain(G.structure_nodes(df, chunks, found))
    assert plain(edges) == plain(G.structure_edges(df, chunks, found))
    assert plain(store.read("provided")) == plain(G.provided(df)) and plain(store.read("wanted")) == plain(G.wanted(G.links(chunks)))


def test_only_links_that_could_mean_the_change(spark, tmp_path):
    store = TableSet(spark, str(tmp_path / "g"))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    sources = lambda df: {r.source for r in df.collect()}
    assert sources(U.apply_changes(store, frame(VAULT))) == {n[0] for n in VAULT}
    # a missing note comes: the one broken link is resolved, nobody else writes
    new = note("late/No Such Note.md", "Late", "Body", "Here now.")
    assert sources(U.apply_changes(store, frame([new]))) == {new[0], "broken/source.md"}
    # one of two notes of a name goes: an ambiguous link is resolved; a note that is not there goes without a trace;
    # a text changes, its names do not: nobody else writes; repeated rows count once
    edit = note("direct/target.md", "Goal", "Body", "Something to add: [[twohop/start]].")
    gone = spark.createDataFrame([("duplicates/two/Guide.md",), ("never/there.md",), (None,)], "source string")
    assert sources(U.apply_changes(store, frame([edit, edit]), gone)) == {edit[0], "duplicates/two/Guide.md", "never/there.md", "duplicates/source.md"}
    left = [edit if n[0] == edit[0] else n for n in VAULT if n[0] != "duplicates/two/Guide.md"] + [new]
    same_as_rebuilt(spark, TableSet(spark, store.root), left)
    status = {(r.source, r.target): r.status for r in store.read("links").collect()}
    assert status["broken/source.md", "No Such Note"] == status["duplicates/source.md", "Guide"] == "resolved"


def test_random_changes(spark, tmp_path):
    rnd = random.Random(5)
    words = ["a", "b", "Index", "x/a", "y/b", "Straße", "pic.png", "", "nope", "./a", "x/index"]

    def made(source):
        links = " ".join(f"{rnd.choice(['', '', '!'])}[[{rnd.choice(words)}]]" for _ in range(3))
        return note(source, rnd.choice("TU"), "Body", links, rnd.sample(["s", "t"], rnd.randrange(3)), rnd.sample(["nope", "b", "INDEX", " "], rnd.randrange(3)))

    places = [f"{folder}/{name}.md" for folder in ("x", "y", "z") for name in ("a", "b", "index", "STRASSE")]
    now = {s: made(s) for s in places[:8]}
    store = TableSet(spark, str(tmp_path / "g"))
    U.replace_all(store, spark.createDataFrame(list(now.values()), SCHEMA))
    for _ in range(1):
        gone = rnd.sample(sorted(now), 2)
        fresh = {s: made(s) for s in rnd.sample(places, 3)}
        now = {s: n for s, n in now.items() if s not in gone} | fresh
        U.apply_changes(store, spark.createDataFrame(list(fresh.values()), SCHEMA), spark.createDataFrame([(s,) for s in gone], "source string"))
        same_as_rebuilt(spark, store, list(now.values()))
    half = list(now.values())[:4]
    U.replace_all(store, spark.createDataFrame(half, SCHEMA))
    same_as_rebuilt(spark, store, half)


def test_lost_before_the_commit(spark, tmp_path, monkeypatch):
    store = TableSet(spark, str(tmp_path / "g"))
    U.apply_changes(store, spark.createDataFrame(VAULT[:6], SCHEMA))

    def lost(self):
        raise RuntimeError("lost")

    more = spark.createDataFrame(VAULT[6:9], SCHEMA)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(TableSet, "commit", lost)
        U.apply_changes(TableSet(spark, store.root), more)
    same_as_rebuilt(spark, TableSet(spark, store.root), VAULT[:6])


def test_watched(spark, tmp_path):
    from pyspark.sql import functions as F

    def parse(df):
        none = F.array().cast("array<string>")
        return df.select("source", F.lit("n").alias("filename"), F.lit("").alias("folder"), none.alias("tags"), none.alias("aliases"), "content")

    (tmp_path / "in").mkdir()
    row = lambda s, c, t, x: json.dumps({"source": s, "change": c, "ts": f"2024-01-01T00:00:0{t}", "content": x})
    for k, lines in enumerate([[row("a.md", "new", 1, "# A\n\n[[b]]")], [row("b.md", "new", 2, "# B")], [row("b.md", "updated", 3, "# B"), row("b.md", "deleted", 4, None)]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        U.watch_graph(read_changes(spark, str(tmp_path / "in")), str(tmp_path / "g"), parse, str(tmp_path / "cp")).awaitTermination()
        got = [(r.source, r.status) for r in TableSet(spark, str(tmp_path / "g")).read("links").collect()]
        assert got == [("a.md", "resolved" if k == 1 else "unresolved")]


def test_files_stay_near_the_text(spark, tmp_path):
    """Ids are hashes, which no compression makes smaller: stored for each write they were several times the notes."""
    notes = [note(f"n/{i}.md", f"Note {i}", "Body", f"{'Some words of the note. ' * 3}[[{i + 1}]] [[{i + 2}]]", ["t"]) for i in range(2000)]
    store = TableSet(spark, str(tmp_path / "g"))
    U.apply_changes(store, spark.createDataFrame(notes, SCHEMA))
    size = sum(p.stat().st_size for p in (tmp_path / "g").rglob("*.parquet"))
    assert size < 5 * sum(len(n[-1]) for n in notes)
    same_as_rebuilt(spark, TableSet(spark, store.root), notes)
