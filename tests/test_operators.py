"""Texts, chunks, retrieval, the semantic layer, answers, upkeep, sources and streams."""

import io
import json
import tarfile
import zipfile

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vectors import dot as dot_product
from lodestone.operators import answers as A
from lodestone.operators import chunking as C
from lodestone.operators import communities as Q
from lodestone.operators import embedding as E
from lodestone.operators import lookups as L
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.operators import retrievers as V
from lodestone.operators import semantic as S
from lodestone.operators import sync as Y
from lodestone.session import Config
from lodestone.sources import sinks, vault
from lodestone.streaming import changes as Z


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_texts(spark):
    assert one(spark, "　Ｈello  World_Two!　", T.slug) == "hello-world-two"
    assert one(spark, " Straße,。", T.entity_name) == "strasse"
    assert one(spark, " works at/with ", T.predicate) == "WORKS_AT_WITH" and one(spark, "!!", T.predicate) == "RELATED_TO"
    assert one(spark, "nan", lambda c: T.bounded(c, 0.0, 1.0)) == 0.0 and one(spark, "7", lambda c: T.bounded(c, 0.0, 1.0)) == 1.0
    assert one(spark, "a%20b+c", T.url_decoded) == "a b+c"
    assert one(spark, "x/Y.tar.md", T.stem) == "Y.tar" and one(spark, "a/b/c.md", T.parent_dir) == "a/b"
    assert one(spark, 'Well: ```json\n{"a": {"b": 1}}\n```', T.json_object) == '{"a": {"b": 1}}'
    assert one(spark, "#one 两#no #三/四-x", T.inline_tags) == ["one", "三/四-x"]
    links = one(spark, "a [[T#S|n]] `[[x]]` ![[p.png]]\n~~~\n[[y]]\n~~~\n[[...]] [[a && b]] [[ Z ]]", T.wikilinks)
    assert [(x.target, x.anchor, x.alias, x.embedded) for x in links] == [("T", "S", "n", False), ("p.png", "", "", True), ("Z", "", "", False)]
    both = spark.createDataFrame([("ab c", "abd")], "a string, b string").select(T.overlap_score(T.bigrams(F.col("a")), T.bigrams(F.col("b"))).alias("x"))
    assert both.first().x == pytest.approx(0.45 + 0.5 / 3, abs=1e-6)


def test_windows():
    assert C.window_spans("word " * 100, 80, 10)[:2] == [(0, 80), (70, 150)]
    assert C.window_spans("x" * 250, 100, 20) == [(0, 100), (80, 180), (160, 250)]
    assert C.window_spans("", 10, 2) == []
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab \n.。xxxx") for _ in range(rng.randint(1, 80)))
        size = rng.randint(1, 20)
        overlap = rng.randrange(size)
        spans = C.window_spans(text, size, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), (c, _) in zip(spans, spans[1:], strict=False):
            # the cut is behind the last stop of the second half, or the window is full
            stops = [e for e in range(a + max(1, size // 2) + 1, a + size + 1) if text[e - 1] in "\n。. "]
            assert b == max(stops, default=a + size) and c == max(a + 1, b - overlap)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbers_over_many_ranges(spark, coalesce):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"), F.repeat(F.lit("x"), 50).alias("more"))
        out = M.numbered(df, F.col("text"))
        line = out.agg(F.countDistinct("position").alias("n"), F.min("position").alias("a"), F.max("position").alias("b")).first()
        assert tuple(line) == (200_000, 1, 200_000)
        firsts = [r.text for r in out.orderBy("position").limit(5).collect()]
        assert firsts == [r.text for r in df.orderBy("text").limit(5).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_chunks(spark):
    body = "Before.\n# Title ##\nText\n## Same\none\n## Same\ntwo\n#no heading\n### C#\n" + "long words " * 60
    notes = spark.createDataFrame([("n.md", "n", "", body)], "source string, filename string, folder string, content string")
    rows = C.chunks(notes, size=200, overlap=20, max_len=300).orderBy("position", "chunk_index").collect()
    assert [r.heading for r in rows[:4]] == ["", "Title", "Same", "Same"] and rows[4].heading == "C"
    assert rows[1].anchor == "title" and rows[2].anchor == "same" and rows[3].anchor.startswith("same-") and rows[0].anchor.startswith("before-")
    assert len(rows) > 5 and len({r.chunk_id for r in rows}) == len(rows) and all(len(r.content) <= 200 for r in rows[4:])
    assert C.parents(notes).first().document_id == rows[0].document_id


def test_fusion_vectors(spark):
    base = spark.createDataFrame([(1, "a.md", "x", 0.8, 1)], "query_id int, source string, anchor string, score double, rank int")
    graph = spark.createDataFrame([(1, "b.md", "y", 0.7, 0.9, 1)], "query_id int, source string, anchor string, score double, graph_score double, graph_rank int")
    rows = R.fused(base, graph, threshold=0.35).orderBy("rank").collect()
    assert [r.source for r in rows] == ["b.md", "a.md"]
    assert rows[0].score == pytest.approx(0.75) and rows[0].rank_score == pytest.approx(1 / 62 + 0.25 / 61)
    chunk = spark.createDataFrame([(1, "s.md", "a", 0.8, 0.9)], "query_id int, source string, anchor string, score double, community_score double")
    assert R.global_fusion(chunk).first().score == pytest.approx(0.825)


def test_refusal_route_trace(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "query_id int")
    hits = spark.createDataFrame([(1, "s", "a", "text", 0.2), (2, "s", "", "text", 0.9), (3, "s", "a", "text", 0.9)], "query_id int, source string, anchor string, content string, score double")
    got = {r.query_id: r.reason for r in R.refusals(q, hits).collect()}
    assert got == {0: R.NO_EVIDENCE, 1: R.LOW_SCORE, 2: R.NOT_CITABLE, 3: None}
    assert R.route("auto", local=False) == "basic" and R.route("global") == "global"
    with pytest.raises(ValueError):
        R.route("other")
    assert {r.query_id: r.hits for r in R.traces(q, hits=hits).collect()} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_vector_blocks_give_the_same(spark):
    q = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)], "query_id int, q_vec array<float>")
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "chunk_id int, vec array<float>")
    one_block, many = R.vector_topk(q, c, 3), R.vector_topk(q, c, 3, block=2)
    assert one_block.exceptAll(many).isEmpty() and one_block.count() == 21


def test_topk_is_exact(spark):
    rng = random.Random(5)
    vectors = [[rng.choice((-0.3, 0.1, 0.7)) for _ in range(6)] for _ in range(60)]
    chunks = [(f"c{i:03d}", rng.choice(vectors)) for i in range(400)]  # many equal vectors, so many ties
    odd = [("n", None), ("short", [1.0]), ("hole", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 6)]
    asked = [(i, rng.choice(vectors)) for i in range(23)] + [(90, None), (91, [1.0] * 5), (92, [])]
    c = spark.createDataFrame(chunks + odd, "chunk_id string, vec array<float>").withColumn("note", F.col("chunk_id")).repartition(3)
    q = spark.createDataFrame(asked, "query_id int, q_vec array<float>").withColumn("other", F.lit(1))
    dot = dot_product(F.col("q_vec"), F.col("vec"))
    pairs = q.where("query_id < 90").crossJoin(c.where("chunk_id LIKE 'c%'")).withColumn("score", dot)
    want = R.ranked(pairs, 5, F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "note", "score", "rank")
    want = sorted(map(tuple, want.collect()))
    for block in (10_000, 7):
        got = R.vector_topk(q, c, 5, block=block).select("query_id", "chunk_id", "note", "score", "rank")
        assert sorted(map(tuple, got.collect())) == want
    assert R.vector_topk(q.where("query_id >= 90"), c, 5).isEmpty()
    assert R.vector_topk(q, c.limit(0), 5).isEmpty() and R.vector_topk(q.limit(0), c, 5).isEmpty()


def test_metric_vectors(spark):
    r = spark.createDataFrame([("a", "x", 1), ("a", "g1", 2), ("a", "g2", 3)], "query_id string, item string, rank int")
    g = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "z")], "query_id string, item string")
    rows = {x.query_id: x for x in M.query_metrics(r, g, ks=(1, 3)).collect()}
    ideal = 1 + 1 / 1.584962500721156
    assert rows["a"].recall_3 == 1 and rows["a"].recall_1 == 0 and rows["a"].mrr_10 == 0.5
    assert rows["a"].ndcg_10 == pytest.approx((1 / 1.584962500721156 + 0.5) / ideal) and rows["b"].hit is False
    lat = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 100)], "ms double")
    s = M.latency_stats(lat, "ms").first()
    assert (s.n, s.mean_ms, s.p50_ms, s.p95_ms) == (5, 40.0, 30.0, 100.0)
    p = spark.createDataFrame([("q1", "positive", "A"), ("q1", "positive", " B "), ("q1", "negative", "N1"), ("q2", "positive", "A"), ("q2", "negative", "N1"), ("q2", "negative", "")], "sample_id string, role string, text string")
    corpus = M.corpus_of(p)
    assert [x.source for x in corpus.orderBy("source").collect()] == [f"corpus/doc_000{i}.md" for i in (1, 2, 3)]
    assert M.gold_of(p, corpus).count() == 3
    both = M.compared_retrievers(r.where("item = 'x'"), r, g, k=5).first()
    assert both.wins == 1 and both.harms == 0
    assert M.set_scores(r, g, ["item"]).first().n_both == 2


def extraction(entities, relations):
    return json.dumps({"entities": entities, "relationships": relations})


def test_extraction_rules(spark):
    text = "Ada met Charles in London."
    e = lambda name, **k: {"name": name, "type": "Person", "description": "d", "aliases": [], "evidence_quote": name, "confidence": 0.9} | k
    r = lambda a, b, **k: {"source": a, "target": b, "description": "met", "evidence_quote": "met", "strength": 99, "predicate": "met with"} | k
    rows = [
        ("c1", text, "Here: ```json\n" + extraction([e("Ada", aliases=["The Countess"]), e("ADA", description="later", evidence_quote="Ada"), e("Charles"), e("Nobody", evidence_quote="absent"), e("London", type="Thing")], [r("the countess", "charles"), r("Ada", "ada"), r("Ada", "London")]) + "\n```"),
        ("c2", text, "no json"),
        ("c3", text, None),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, content string, response string")
    found = S.entities(df, types=["person"], min_confidence=0.5)
    assert sorted((x.name, x.description) for x in found.collect()) == [("ADA", "later"), ("Charles", "d")]
    rel = S.relationships(df, found).collect()
    assert len(rel) == 1 and rel[0].strength == 10.0 and rel[0].predicate == "MET_WITH"  # an alias stays with the entity that a later one replaced


def test_evidence_merges(spark):
    ev = spark.createDataFrame([("n", "c2", "B", "t", "two；", ["x"], 0.5), ("n", "c1", "A", "t", "one。", ["y", "x"], 0.9), ("n", "c1", "A", "t", "one。", [], 0.9)], "node_id string, chunk_id string, entity_name string, entity_type string, raw_description string, aliases array<string>, confidence double")
    r = S.merged_entities(ev).first()
    assert (r.name, r.description, r.frequency, r.aliases) == ("A", "one；two。", 2, ["y", "x"])
    units = S.entity_units(ev).orderBy(F.desc("confidence")).collect()
    assert [(u.node_id, u.chunk_id, u.confidence) for u in units] == [("n", "c1", 0.9), ("n", "c2", 0.5)]
    bare = spark.createDataFrame([("m", "c1", "M", "t", None, None, None), ("m", "c2", "N", "t", " ", [], 0.1)], ev.schema)
    r = S.merged_entities(bare).first()
    assert (r.name, r.description, r.frequency, r.aliases) == ("N", "", 2, [])
    assert S.merged_entities(ev.limit(0)).isEmpty()
    rel = spark.createDataFrame([("e", "a", "b", c, d, s, p) for c, d, s, p in (("c1", "x", 4.0, "P"), ("c2", "x", 8.0, "Q"), ("c3", "", 0.0, "Q"), ("c4", "y", 0.0, "P"))], "edge_id string, source_node_id string, target_node_id string, chunk_id string, raw_description string, strength double, predicate string")
    r = S.merged_relations(rel).first()
    assert (r.predicate, r.strength, r.frequency, r.description, r.predicates) == ("P", 12.0, 4, "x；y。", {"P": 2, "Q": 2}) and r.weight == pytest.approx(0.21)
    assert S.description_groups(rel, "edge_id").first().descriptions == ["x", "y"]


def test_model_calls_keep_going(spark):
    def client():
        def ask(p):
            if p == "bad":
                raise RuntimeError("no")
            return p.upper()

        return ask

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "i int, prompt string")
    got = {r.i: (r.response, r.error) for r in S.answered_by(client, df).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "RuntimeError: no")}


def test_hierarchy(spark):
    rows = [(f"{x}{i}", f"{x}{j}", 1.0) for x in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, strength double")
    nodes = spark.createDataFrame([(f"{x}{i}",) for x in "ab" for i in range(5)] + [("z",)], "node string")
    got = Q.hierarchy(edges, nodes, rounds=8)
    groups = sorted(tuple(sorted(r.n)) for r in got.where("level = 0").groupBy("community").agg(F.collect_list("node").alias("n")).collect())
    assert groups == [tuple(f"a{i}" for i in range(5)), tuple(f"b{i}" for i in range(5)), ("z",)]
    parts = {r.node: r.component for r in Q.components(edges, nodes).collect()}
    assert parts["b4"] == "a0" and parts["z"] == "z"


def test_answer_round(spark):
    hits = spark.createDataFrame([(1, 1, "p.md", "a", "", "H", "f", "Body text here", 0.912345)], "query_id int, rank int, source string, anchor string, section_title string, heading string, filename string, content string, score double")
    out = spark.createDataFrame([(1, '{"status": "answered", "answer": [{"text": "So.", "evidence_ids": ["ev_1"]}]}')], "query_id int, output string")
    r = A.responses(out, hits)
    row = r.first()
    assert row.error is None and row.citations[0].section_title == "H" and row.citations[0].score == 0.9123 and row.answer[0].citation_ids == ["cite_1"]
    ev = hits.select("query_id", "source", "anchor", F.lit("H").alias("section_title"), "content", "score")
    assert A.violations(r, ev).isEmpty()
    assert r.select(A.footer(F.col("citations")).alias("f")).first().f == "\n\n来源：[p.md#a]"
    said = r.withColumn("question", F.lit("Why?"))
    nodes, edges = A.path_view(said, ev)
    assert sorted(n.type for n in nodes.collect()) == ["citation", "document", "query", "retrieval"]
    assert sorted(e.type for e in edges.collect()) == ["retrieved_document", "supports", "vector_search"]
    steps = spark.createDataFrame([(1, "p.md", 0, "doc:x", "document", "X", None), (1, "p.md", 1, "ent:y", "entity", "Y", "MENTIONS"), (1, "p.md", 2, "doc:p", "document", "P", "MENTIONS")], "query_id int, source string, step int, node string, type string, name string, edge_type string")
    nodes, edges = A.path_view(said, ev, "local", steps=steps)
    assert sorted((n.type, n.label) for n in nodes.collect()) == [("citation", "最终引用 [1]"), ("document", "X"), ("document", "p.md"), ("entity", "Y"), ("query", "Why?")]
    assert sorted((e.type, e.label) for e in edges.collect()) == [("graph_relation", "MENTIONS"), ("graph_relation", "MENTIONS"), ("graph_search", "图搜索"), ("supports", "支持答案")]
    nodes, edges = A.path_view(said, ev, "local", steps=steps.where("step < 2"))
    assert ("retrieved_document", "命中文档") in {(e.type, e.label) for e in edges.collect()}
    nodes, edges = A.path_view(said, ev, "global", communities=spark.createDataFrame([(1, "p.md", "K1"), (1, "other.md", "K2")], "query_id int, source string, community_id string"))
    assert sorted(e.type for e in edges.collect()) == ["community_match", "community_source", "supports"]
    assert A.path_view(said, ev.where("source = 'x'"))[0].isEmpty()
    assert json.loads(A.evidence_json(hits).first().evidence)[0]["evidence_id"] == "ev_1"


def test_upkeep(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "source string, mtime string")
    index = spark.createDataFrame([("b", "1", 4), ("c", "1", 4), ("d", "1", 4)], "source string, mtime string, index_version int")
    diff = Y.snapshot_diff(disk, index, version=4)
    assert {(r.source, r.change) for r in diff.collect()} == {("a", "new"), ("b", "updated"), ("d", "deleted")}
    fresh = disk.withColumn("index_version", F.lit(4))
    assert Y.synced(index, fresh, diff).exceptAll(fresh).isEmpty()
    turns = spark.createDataFrame([("s", i, f"t{i}") for i in range(4)], "session string, turn int, text string")
    assert {r.turn: r.window for r in Y.running_history(turns, 2).collect()}[3] == ["t2", "t3"]
    assert Y.kept_sessions(spark.createDataFrame([("a", 1), ("b", 2)], "session string, first_seen int"), 1).first().session == "b"


def test_last_rows_and_digests(spark):
    events = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "u"), (None, 3, "n")], "source string, ts int, change string")
    got = {(r.source, r.ts, r.change) for r in Y.latest_changes(events, tie="change").collect()}
    assert got == {("a", 2, "z"), ("b", None, "u"), (None, 3, "n")}
    rounds = events.withColumnRenamed("ts", "round")
    assert {r.change for r in S.merged_rounds(rounds.where("source = 'a' AND change <> 'z'"), "source").collect()} == {"y"}
    old = spark.createDataFrame([("s1", "e", "c1"), ("s2", "e", "c2")], "source string, edge_id string, chunk_id string")
    new = spark.createDataFrame([("s2", "e", "c3", 1), ("s2", "e", "c3", 2), ("s2", "f", "c3", 1)], "source string, edge_id string, chunk_id string, ord int")
    assert sorted((r.source, r.edge_id, r.chunk_id) for r in S.replaced_evidence(old, new, "edge_id").collect()) == [("s1", "e", "c1"), ("s2", "e", "c3"), ("s2", "f", "c3")]
    # a digest depends on the items, not on their order or partitions
    chunks = spark.range(300).selectExpr("'s' || id % 2 AS source", "'c' || id AS chunk_id", "'text ' || id AS content")
    mark = lambda df, *v: {r.source: r.fingerprint for r in S.fingerprint(df, *v).collect()}
    first = mark(chunks, "v1")
    assert mark(chunks.orderBy(F.desc("chunk_id")).repartition(7), "v1") == first
    assert mark(chunks, "v2")["s0"] != first["s0"]
    one_less = mark(chunks.where("chunk_id <> 'c4'"), "v1")
    assert one_less["s1"] == first["s1"] and one_less["s0"] != first["s0"]


def test_community_rows(spark):
    members = spark.createDataFrame([(0, "a", None, x) for x in "edcba"] + [(1, "a", "a", x) for x in "ab"], "level int, community string, parent string, node string")
    entities = spark.createDataFrame([(x, x.upper()) for x in "abcde"], "node_id string, name string")
    got = {r.level: r for r in Q.community_rows(members, entities).collect()}
    assert (got[0].title, got[0].size, got[0].parent) == ("A / B / C", 5, None) and (got[1].title, got[1].size, got[1].parent) == ("A / B", 2, "a")
    again = {r.level: r.id for r in Q.community_rows(members.repartition(5), entities).collect()}
    assert again == {k: r.id for k, r in got.items()} and len(set(again.values())) == 2


def test_config():
    assert Config.from_dict({"top_k": 3}).top_k == 3
    for bad in ({"nope": 1}, {"api_key": "x"}, {"top_k": 0}, {"chunk_overlap": 900}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)


def test_sources(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "sub dir").mkdir(parents=True)
    (root / ".obsidian").mkdir()
    (root / "sub dir" / "a.md").write_text('---\ntags: [x, "y"]\naliases:\n  - Other\n---\n# A\n#z [[B|b]]\n')
    (root / "b.md").write_text("plain")
    (root / "bad.md").write_bytes(b"\xff\xfe\xff")
    (root / "c.txt").write_text("no")
    (root / ".obsidian" / "d.md").write_text("no")
    rows = {r.source: r for r in vault.read_vault(spark, str(root)).collect()}
    assert set(rows) == {"sub dir/a.md", "b.md"}
    a = rows["sub dir/a.md"]
    assert (a.tags, a.aliases, a.links, a.folder, a.filename) == (["x", "y", "z"], ["Other"], ["B"], "sub dir", "a") and a.content.startswith("# A")
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert vault.read_json_lines(spark, str(tmp_path / "x.jsonl"), "id string").where("id IS NOT NULL").count() == 2
    (tmp_path / "t.json").write_text('{"one": [{"q": "a"}, {"q": "b"}], "two": []}')
    assert vault.read_json_tasks(spark, str(tmp_path / "t.json"), "struct<q:string>").count() == 2
    (tmp_path / "q.csv").write_text('﻿id,text\n1,"a ""b"""\n')
    assert vault.read_csv(spark, str(tmp_path / "q.csv")).first().asDict() == {"id": "1", "text": 'a "b"'}
    arc = tmp_path / "arc"
    arc.mkdir()
    with zipfile.ZipFile(arc / "z.zip", "w") as z:
        z.writestr("s-part2.txt", "two")
        z.writestr("s-part1.txt", "one")
    with tarfile.open(arc / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("u.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"\xffab"))
    members = vault.read_archives(spark, str(arc))
    assert {r.name: r.text for r in vault.joined_parts(members).collect()} == {"s.txt": "one\ntwo", "u.txt": "�ab"}
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    assert sorted(r.text for r in vault.read_line_corpus(spark, str(tmp_path / "l.txt")).collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("n<1", "document", 'a "b" & c', "s", "x")], "id string, type string, name string, source string, anchor string")
    edges = spark.createDataFrame([("e", "n<1", "n<1", "LINKS_TO", 1.0, "s", "x")], "id string, source_id string, target_id string, type string, weight double, evidence_source string, evidence_anchor string")
    lines = [r.line for r in sinks.graphml(nodes, edges).orderBy("part", "id").collect()]
    from xml.dom.minidom import parseString

    doc = parseString("".join(lines))
    assert doc.getElementsByTagName("node")[0].getAttribute("id") == "n<1" and len(doc.getElementsByTagName("edge")) == 1
    sinks.write_table(nodes, str(tmp_path / "t"), by="id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.write_csv(sinks.gephi_nodes(nodes), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().Label == 'a "b" & c'
    sinks.write_json_lines(nodes, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    inbox, table = tmp_path / "inbox", str(tmp_path / "table")
    inbox.mkdir()
    build = lambda df: df.select("source", F.upper("content").alias("content"))
    event = lambda s, c, t, x=None: json.dumps({"source": s, "change": c, "ts": f"2024-01-01T00:00:{t:02d}", "content": x})
    (inbox / "1.json").write_text("\n".join([event("a", "created", 1, "one"), event("b", "created", 2, "two"), event("a", "modified", 3, "three")]))
    stream = lambda: Z.watch(Z.read_changes(spark, str(inbox)), table, build, str(tmp_path / "ck")).awaitTermination()
    stream()
    rows = lambda: {r.source: r.content for r in Z.current_table(spark, table).collect()}
    assert rows() == {"a": "THREE", "b": "TWO"}
    (inbox / "2.json").write_text("\n".join([event("b", "deleted", 4), event("c", "created", 5, "four")]))
    stream()
    assert rows() == {"a": "THREE", "c": "FOUR"}
    settled = Z.settled_changes(spark.read.schema(Z.CHANGE).json(str(inbox)))
    assert {(r.source, r.change) for r in settled.collect()} >= {("a", "modified")}


def test_batches_rewrite_their_buckets(spark, tmp_path):
    table = str(tmp_path / "table")
    build = lambda df: df.select("source", F.explode(F.split("content", " ")).alias("word"))
    at = lambda *rows: spark.createDataFrame(list(rows), "source string, change string, ts int, content string").withColumn("ts", F.timestamp_seconds("ts"))
    apply = lambda *rows: Z.apply_batch(spark, at(*rows), table, build, buckets=8)
    state = lambda: sorted((r.source, r.word) for r in Z.current_table(spark, table).collect())
    assert Z.current_table(spark, table) is None
    first = [(f"s{i}", "created", 1, f"a{i} b{i}") for i in range(30)]
    apply(*first)
    want = sorted((f"s{i}", f"{x}{i}") for i in range(30) for x in "ab")
    assert state() == want
    apply(("s3", "modified", 2, "new"), ("s3", "modified", 2, "least"))  # a tie: the greater content
    want = sorted([w for w in want if w[0] != "s3"] + [("s3", "new")])
    assert state() == want
    assert len([p for p in (tmp_path / "table" / "v1").iterdir() if p.name.startswith("bucket=")]) == 1
    (tmp_path / "table" / "v2").mkdir()  # a version that was never finished
    apply(("s3", "modified", 2, "new"))  # again: the same table
    assert state() == want
    apply()
    assert Z.current_version(spark, table) == 2
    apply(*[(s, "deleted", 3, None) for s, *_ in first])
    assert state() == []
    apply(("t", "created", 4, "x"))
    assert state() == [("t", "x")]
    assert {p.name for p in (tmp_path / "table" / "versions").iterdir()} == {"3", "4"}
    assert not [p for v in ("v0", "v1") for p in (tmp_path / "table" / v).iterdir() if p.name.startswith("bucket=")]


def test_answers_are_asked_for_again(spark, tmp_path):
    folder = str(tmp_path)

    def client():
        import pathlib

        def ask(prompt):
            seen = pathlib.Path(folder) / prompt.split("#")[1]
            first = not seen.exists()
            seen.touch()
            if prompt.endswith("#3") and first:
                raise OSError("busy")
            bad = '{"status": "answered", "answer": [{"text": "So.", "evidence_ids": []}]}'
            good = '{"status": "answered", "answer": [{"text": "So.", "evidence_ids": ["ev_1"]}]}'
            return bad if first or prompt.endswith("#2") else good

        return ask

    hits = spark.createDataFrame([(q, 1, "p.md", "a", "S", "H", "f", "Body text here", 0.9 if q < 4 else 0.1) for q in (1, 2, 3, 4)], "query_id int, rank int, source string, anchor string, section_title string, heading string, filename string, content string, score double")
    questions = spark.createDataFrame([(q, f"what #{q}") for q in range(1, 6)], "query_id int, question string")
    got = {r.query_id: r for r in V.answered(client, questions, hits, "{context} {history}{question}").collect()}
    assert {q: (r.status, r.attempts) for q, r in got.items()} == {1: ("answered", 2), 2: ("insufficient_evidence", 2), 3: ("answered", 2), 4: ("insufficient_evidence", 0), 5: ("insufficient_evidence", 0)}
    assert got[1].citations[0].quote == "Body text here" and got[2].reason.startswith(V.INVALID) and got[4].reason == R.LOW_SCORE and got[5].reason == R.NO_EVIDENCE


def test_local_retrieval_goes_through_entities(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "query_id int, q_vec array<float>")
    chunks = spark.createDataFrame([(1, "a.md", "x", "t", [1.0, 0.0]), (2, "b.md", "y", "t", [0.6, 0.8]), (3, "c.md", "z", "t", [0.8, 0.6]), (4, "d.md", "w", "t", [0.8, 0.6])], "chunk_id int, source string, anchor string, content string, vec array<float>")
    doc = lambda s: spark.createDataFrame([(s,)], "s string").select(T.document_id(F.col("s")).alias("i")).first().i
    nodes = spark.createDataFrame([*[(doc(f"{s}.md"), "document", f"{s}.md") for s in "abcd"], ("E", "entity", ""), ("F", "other", "")], "id string, type string, source string")
    edges = spark.createDataFrame([("1", doc("a.md"), doc("b.md"), "LINKS_TO", 1.0), ("2", doc("c.md"), "E", "MENTIONS", 0.8), ("3", doc("d.md"), "F", "MENTIONS", 0.8)], "id string, source_id string, target_id string, type string, weight double")
    entities = spark.createDataFrame([("E", [1.0, 0.0]), ("F", [1.0, 0.0]), ("G", [0.0, 1.0])], "entity_id string, vec array<float>")
    found = V.local_retrieval(queries, chunks, nodes, edges, entities=entities, k=1, threshold=0.35).collect()
    got = {r.source: r for r in found}
    assert set(got) == {"a.md", "b.md", "c.md"} and {r.query_id for r in found} == {1}  # F is no entity; the second query finds nothing
    assert got["b.md"].graph_score == pytest.approx(0.85) and got["c.md"].graph_score == pytest.approx(0.68) and len(got["b.md"].path) == 2
    assert V.retrieval("global", queries, chunks, k=1).count() == 1  # without communities: basic
    with pytest.raises(ValueError):
        V.retrieval("other", queries, chunks)


def test_embedding_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([(1, "Hello world"), (2, "hello  WORLD"), (3, None), (4, "other text")], "id int, content string")
    got = {r.id: r.vec for r in E.embedded(df.repartition(2)).collect()}
    assert got[1] == got[2] and not any(got[3]) and sum(x * x for x in got[4]) == pytest.approx(1, abs=1e-5)
    lengths = E.embedded(df, lambda: lambda texts: [[len(x), 1.0] for x in texts], batch=1)
    assert lengths.where("id = 3").first().vec == [0.0, 1.0]
    old = spark.createDataFrame([("a", "document")], "id string, type string")
    new = L.migrated(old, "nodes")
    assert new.schema.simpleString() == L.emptied(spark, "nodes").schema.simpleString() and new.first().description == "" and L.emptied(spark, "edges").isEmpty()
    with pytest.raises(ValueError):
        L.migrated(old.drop("id"), "nodes")
    paths = spark.createDataFrame([("a\\b.md", 1), ("c.md", 2)], "source string, n int")
    assert L.of_source(paths, "a/b.md").first().n == 1
    with pytest.raises(ValueError):
        L.of_source(paths, "x.md")
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "id string, n int")
    assert [r.id for r in L.snapshot(rows, rows)[0].collect()] == ["a", "b"]
    context = spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t1", "y")], "title string, body string").select(F.struct("title", "body").alias("c"))
    assert context.select(L.report_key(F.col("c")).alias("k")).distinct().count() == 2
    seen = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, item string")
    safe = M.safety(seen, seen.where("query_id = 1"), spark.createDataFrame([(2,), (3,)], "query_id int")).first()
    assert (safe.safe_negative_rate, safe.leaks) == (0.5, 1)
