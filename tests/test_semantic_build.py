"""The semantic layer is built, changed, pruned and deleted from in whole commits."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import semantic_build as B
from lodestone.operators.tableset import TableSet

CHUNKS = "source string, anchor string, chunk_id string, content string"
PEOPLE = ("people.md", "a", "c1", "Zhang leads ABC Corp.")
COMPANY = ("company.md", "b", "c2", "ABC Corp sits in Rome. ABC Corp bought XYZ.")


def scripted(log, fail=()):
    """A model that knows four names, writes down each call, and fails on texts with a word of ``fail``."""

    def client():
        def entity(name, kind, said, text):
            return {"name": name, "type": kind, "description": said, "evidence_quote": name, "confidence": 0.9} if name in text else None

        def ask(prompt):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(json.dumps(prompt) + "\n")
            if any(w in prompt for w in fail):
                return "no json at all"
            if "missed before" in prompt:
                return json.dumps({"entities": [entity("Rome", "geo", "a city", prompt)] if "Rome" in prompt else [], "relationships": []})
            found = [entity("Zhang", "person", "a person", prompt), entity("ABC Corp", "organization", "led by Zhang" if "Zhang" in prompt else "sits in Rome", prompt), entity("XYZ", "organization", "bought", prompt)]
            links = [("Zhang", "ABC Corp", "leads"), ("ABC Corp", "XYZ", "bought")]
            return "```json\n" + json.dumps({"entities": [x for x in found if x], "relationships": [{"source": a, "target": b, "description": d, "strength": 5, "predicate": d, "evidence_quote": d, "confidence": 0.9} for a, b, d in links if a in prompt and b in prompt]}) + "\n```"

        return ask

    return client


def calls(log):
    return sum(len(open(f"{log}/{f}").readlines()) for f in os.listdir(log))


@pytest.fixture
def place(tmp_path):
    os.mkdir(tmp_path / "log")
    return str(tmp_path / "store"), str(tmp_path / "log")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNKS).coalesce(1)


def names(store):
    return {r.name: r.frequency for r in store.read("entities").collect()}


def test_build_skips_caches_prunes_and_deletes(spark, place):
    root, log = place
    ext = B.Extractor(scripted(log), gleanings=1)
    first = B.build(TableSet(spark, root), frame(spark, PEOPLE, COMPANY), ext)
    assert (first["documents_indexed"], first["llm_calls"], first["cache_hits"]) == (2, 4, 0) and calls(log) == 4
    store = TableSet(spark, root)
    assert names(store) == {"Zhang": 1, "ABC Corp": 2, "XYZ": 1, "Rome": 1}
    assert store.read("relations").count() == 2 and store.read("source_state").count() == 2
    assert {r.description for r in store.read("entities").where("name = 'ABC Corp'").collect()} == {"led by Zhang；sits in Rome。"}

    again = B.build(TableSet(spark, root), frame(spark, PEOPLE, COMPANY), ext)
    assert again["documents_skipped"] == 2 and again["llm_calls"] == 0 and calls(log) == 4
    forced = B.build(TableSet(spark, root), frame(spark, PEOPLE, COMPANY), ext, changed_only=False)
    assert forced["documents_indexed"] == 2 and forced["llm_calls"] == 0 and forced["cache_hits"] == 4 and calls(log) == 4

    changed = ("company.md", "b", "c2", "ABC Corp is small.")
    B.build(TableSet(spark, root), frame(spark, PEOPLE, changed), ext)
    assert names(TableSet(spark, root)) == {"Zhang": 1, "ABC Corp": 2}
    pruned = B.build(TableSet(spark, root), frame(spark, PEOPLE), ext)
    store = TableSet(spark, root)
    assert pruned["pruned_sources"] == 1 and names(store) == {"Zhang": 1, "ABC Corp": 1} and store.read("edge_evidence").count() == 1
    B.delete_source(store, "people.md")
    store = TableSet(spark, root)
    assert names(store) == {} and all(store.read(t).count() == 0 for t in ("node_evidence", "edge_evidence", "relations", "source_state"))
    B.delete_source(store, "unknown.md")
    with pytest.raises(ValueError):
        B.build(TableSet(spark, root), frame(spark, PEOPLE), ext, source="unknown.md")


def test_one_source_alone_and_failures_keep_the_old_evidence(spark, place):
    root, log = place
    B.build(TableSet(spark, root), frame(spark, PEOPLE, COMPANY), B.Extractor(scripted(log)))
    only = ("people.md", "a", "c1", "Zhang went away.")
    got = B.build(TableSet(spark, root), frame(spark, only, COMPANY), B.Extractor(scripted(log)), source="people.md")
    assert got["documents_total"] == 1 and names(TableSet(spark, root)) == {"Zhang": 1, "ABC Corp": 1, "XYZ": 1}
    before = calls(log)
    broken = ("company.md", "b", "c2", "ABC Corp BROKEN")
    got = B.build(TableSet(spark, root), frame(spark, only, broken, ("new.md", "", "c3", None)), B.Extractor(scripted(log, fail=("BROKEN",)), retries=2))
    assert got["documents_failed"] == 1 and calls(log) - before == 3 + 1  # asked three times, and the empty note once
    assert [r.source for r in got["errors"].collect()] == ["company.md"]
    store = TableSet(spark, root)
    assert names(store) == {"Zhang": 1, "ABC Corp": 1, "XYZ": 1} and store.read("source_state").count() == 3


def test_a_build_that_is_lost_leaves_the_old_version(spark, place, monkeypatch):
    root, log = place
    B.build(TableSet(spark, root), frame(spark, PEOPLE, COMPANY), B.Extractor(scripted(log)))
    before = {t: sorted(map(str, TableSet(spark, root).read(t).collect())) for t in ("node_evidence", "edge_evidence", "entities", "relations", "source_state", "extractions")}

    def lost(self):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(TableSet, "commit", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            B.build(TableSet(spark, root), frame(spark, PEOPLE), B.Extractor(scripted(log)))
    store = TableSet(spark, root)
    assert {t: sorted(map(str, store.read(t).collect())) for t in before} == before
    late, early = TableSet(spark, root), TableSet(spark, root)
    B.delete_source(early, "people.md")
    with pytest.raises(RuntimeError, match="meanwhile"):
        B.delete_source(late, "company.md")


def test_summaries_are_applied_and_cached(spark, place):
    root, log = place

    def summarize():
        def ask(prompt):
            with open(f"{log}/s{os.getpid()}", "a") as f:
                f.write("\n")
            return "SUMMARY of " + str(len(json.loads(prompt)["descriptions"]))

        return ask

    ext = B.Extractor(scripted(log))
    first = B.build(TableSet(spark, root), frame(spark, PEOPLE, COMPANY), ext, summarize=summarize)
    of = lambda: {r.name: r.description for r in TableSet(spark, root).read("entities").collect()}
    assert first["summary_llm_calls"] == 1 and of()["ABC Corp"] == "SUMMARY of 2" and of()["Zhang"] == "a person"
    second = B.build(TableSet(spark, root), frame(spark, PEOPLE, COMPANY), ext, changed_only=False, summarize=summarize)
    assert second["summary_llm_calls"] == 0 and second["summary_cache_hits"] == 1 and of()["ABC Corp"] == "SUMMARY of 2"


def test_table_set_rewrites_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "set")
    store = TableSet(spark, root)
    rows = spark.range(100).select((F.col("id") % 20).alias("k"), "id")
    store.change("t", rows, by="k", buckets=8)
    assert store.commit() == 0
    store = TableSet(spark, root)
    before = dict(store.tables["t"]["files"])
    store.change("t", rows.where("k = 3").withColumn("id", F.col("id") + 1000), by="k", gone=spark.range(4, 5).toDF("k"))
    assert TableSet(spark, root).read("t").count() == 100  # nothing counts before the commit
    store.commit()
    store = TableSet(spark, root)
    after = store.tables["t"]["files"]
    assert 1 <= sum(before[b] != after.get(b) for b in before) <= 2
    assert sorted(map(tuple, store.read("t").collect())) == sorted((k % 20, k + 1000 * (k % 20 == 3)) for k in range(100) if k % 20 != 4)
    store.change("t", rows.where("false"), by="k", gone=spark.range(20).toDF("k"))
    store.commit()
    assert TableSet(spark, root).read("t").count() == 0
