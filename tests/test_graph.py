"""Links, the structure graph of a small vault, and bounded expansion."""

import heapq
import random

from pyspark.sql import functions as F

from lodestone.operators import chunking as C
from lodestone.operators import graph as G


def note(source, title, section, body, tags=(), aliases=()):
    return (source, source.rsplit("/", 1)[-1][:-3], source.rsplit("/", 1)[0], list(tags), list(aliases), f"# {title}\n\nOpening words.\n\n## {section}\n\n{body}")


#: 27 notes: one file per case of the link rules.
VAULT = [
    note("direct/source.md", "Start", "Body", "Read [[direct/target#Body|this one]].", ["linked"]),
    note("direct/target.md", "Goal", "Body", "Nothing to add."),
    note("backlink/caller.md", "Caller", "Body", "Based on [[backlink/topic]]."),
    note("backlink/topic.md", "Topic", "Body", "Cited elsewhere."),
    note("twohop/start.md", "First", "Body", "Then [[twohop/middle]]."),
    note("twohop/middle.md", "Second", "Body", "Then [[twohop/answer]]."),
    note("twohop/answer.md", "Third", "Body", "The end."),
    note("cycle/a.md", "Ring A", "Body", "[[cycle/b]]"),
    note("cycle/b.md", "Ring B", "Body", "[[cycle/c]]"),
    note("cycle/c.md", "Ring C", "Body", "[[cycle/a]]"),
    note("tags/alpha.md", "Alpha", "Body", "First of a pair.", ["pair"]),
    note("tags/beta.md", "Beta", "Body", "Second of a pair.", ["pair", "late"]),
    note("tags/gamma.md", "Gamma", "Body", "On its own.", ["single"]),
    note("aliases/source.md", "By Alias", "Body", "See [[Second Name]]."),
    note("aliases/target.md", "Named", "Body", "Has another name.", aliases=["Second Name"]),
    note("relative/folder/source.md", "Near", "Body", "See [[target]]."),
    note("relative/folder/target.md", "Nearby", "Body", "Beside it."),
    note("duplicates/one/Guide.md", "Guide One", "Body", "A guide."),
    note("duplicates/two/Guide.md", "Guide Two", "Body", "A guide too."),
    note("duplicates/source.md", "Unsure", "Body", "See [[Guide]]."),
    note("broken/source.md", "Broken", "Body", "See [[No Such Note]]."),
    note("attachments/source.md", "Pictures", "Body", "![[plan.png]] and [[sheet.pdf]]", ["media"]),
    note("code/source.md", "Code", "Body", "`[[not/this]]`\n```\n[[nor/this]]\n```\n[[code/real]]"),
    note("code/real.md", "Real", "Body", "Real indeed.", ["code"]),
    note("filters/allowed/entry.md", "Entry", "Body", "To [[filters/allowed/goal]] and [[filters/blocked/secret]]."),
    note("filters/allowed/goal.md", "Allowed", "Body", "Fine.", ["open"]),
    note("filters/blocked/secret.md", "Hidden", "Body", "Not for all.", ["blocked"]),
]
SCHEMA = "source string, filename string, folder string, tags array<string>, aliases array<string>, content string"


def vault(spark):
    notes = spark.createDataFrame(VAULT, SCHEMA)
    chunks = C.chunks(notes)
    found = G.resolved(G.links(chunks), notes)
    return notes, chunks, found


def test_structure_graph(spark):
    notes, chunks, found = vault(spark)
    status = {(r.source, r.target): (r.status, r.resolved_source) for r in found.collect()}
    assert status["aliases/source.md", "Second Name"] == ("resolved", "aliases/target.md")
    assert status["relative/folder/source.md", "target"] == ("resolved", "relative/folder/target.md")
    assert status["duplicates/source.md", "Guide"][0] == "ambiguous"
    assert status["broken/source.md", "No Such Note"] == ("unresolved", None)
    assert status["attachments/source.md", "plan.png"][0] == "attachment" == status["attachments/source.md", "sheet.pdf"][0]
    assert {t for s, t in status if s == "code/source.md"} == {"code/real"}
    nodes, edges = G.structure_nodes(notes, chunks, found), G.structure_edges(notes, chunks, found)
    stats = {(r.kind, r.type): r.n for r in G.graph_stats(nodes, edges).collect()}
    assert stats["node", "document"] == 27 and stats["node", "section"] == 54 == stats["edge", "HAS_SECTION"]
    assert stats["node", "unresolved"] == 2 and stats["node", "tag"] == 8 and stats["edge", "TAGGED_WITH"] == 9
    assert stats["edge", "LINKS_TO"] == 14
    names = {r.source: r.name for r in nodes.where("type = 'document'").collect()}
    assert names["aliases/target.md"] == "target"
    hashes = nodes.where("type = 'document' AND content_hash = ''").count()
    assert hashes == 0  # a link never blanks a note
    again = G.structure_edges(notes.repartition(3), chunks.repartition(2), found.repartition(5))
    assert edges.exceptAll(again).isEmpty()


def test_expansion_scores_of_the_vault(spark):
    notes, chunks, found = vault(spark)
    nodes, edges = G.structure_nodes(notes, chunks, found), G.structure_edges(notes, chunks, found)
    seeds = spark.createDataFrame([("direct", "direct/source.md", "body"), ("tag", "tags/alpha.md", "body"), ("alias", "aliases/source.md", "by-alias"), ("none", "broken/source.md", "body")], "query_id string, source string, anchor string")
    out = G.expand(G.seed_nodes(seeds, nodes), edges)
    hits = {(r.query_id, r.source): r.graph_score for r in G.graph_hits(out, nodes, seeds).collect()}
    assert abs(hits["direct", "direct/target.md"] - 0.85) < 1e-12
    assert abs(hits["tag", "tags/beta.md"] - (0.35 * 0.85) ** 2) < 1e-12
    assert abs(hits["alias", "aliases/target.md"] - 0.2 * 0.85 * 0.85) < 1e-12
    assert not [k for k in hits if k[0] == "none"]


def queue_expansion(edges, seeds, hops, most):
    near = {}
    for i, a, b, kind, w in edges:
        near.setdefault(a, []).append((-w, i, b, kind))
        if a != b:
            near.setdefault(b, []).append((-w, i, a, kind))
    best = {s: (1.0, 0) for s in seeds}
    queue = [(-1.0, 0, s) for s in seeds]
    heapq.heapify(queue)
    while queue:
        score, depth, node = heapq.heappop(queue)
        if -score < best[node][0]:
            continue
        for w, _, other, kind in sorted(near.get(node, []))[:most]:
            d = depth + (kind not in G.FREE)
            s = -score * -w * G.DECAY
            if d <= hops and s > best.get(other, (0.0,))[0]:
                best[other] = (s, d)
                heapq.heappush(queue, (-s, d, other))
    return best


def test_expansion_equals_a_priority_queue(spark):
    rng = random.Random(11)
    all_edges, seeds, want = [], [], {}
    for g in range(12):
        nodes = [f"g{g}n{k}" for k in range(rng.randint(3, 12))]
        edges = [(f"g{g}e{k:02d}", rng.choice(nodes), rng.choice(nodes), rng.choice(["LINKS_TO", "HAS_SECTION", "MENTIONS", "TAGGED_WITH"]), rng.choice([0.2, 0.35, 0.8, 1.0, 0.61])) for k in range(rng.randint(2, 20))]
        all_edges += edges
        start = rng.sample(nodes, 2)
        seeds += [(f"q{g}", s) for s in start]
        for node, (score, depth) in queue_expansion(edges, start, 2, 4).items():
            want[f"q{g}", node] = score
    df = spark.createDataFrame(all_edges, "id string, source_id string, target_id string, type string, weight double")
    got = G.expand(spark.createDataFrame(seeds, "query_id string, node string"), df, max_hops=2, max_neighbors=4)
    assert {(r.query_id, r.node): r.score for r in got.collect()} == want


def test_deleting_a_note_keeps_its_node(spark):
    notes, chunks, found = vault(spark)
    nodes, edges = G.without_source(G.structure_nodes(notes, chunks, found), G.structure_edges(notes, chunks, found), "tags/gamma.md")
    gone = nodes.where(F.col("source") == "tags/gamma.md").collect()
    assert [r.type for r in gone] == ["document"] and gone[0].content_hash == "" and gone[0].metadata["exists"] == "false"
    assert nodes.where("name = 'single'").isEmpty() and edges.where("evidence_source = 'tags/gamma.md'").isEmpty()
