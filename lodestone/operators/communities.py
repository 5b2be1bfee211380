"""Communities of the entity network: components, modularity levels, contexts and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.joins import even_join, hot_keys
from lodestone.operators.sync import digests
from lodestone.session import dropped, written


def components(edges: DataFrame, nodes: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(``node``, ``component``): the least node id reachable, by alternating star steps over equi-joins."""
    now = written(edges.select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return nodes.select("node").distinct().join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


#: Weights are counted in millionths, so that sums do not hang on their order.
UNIT = 1_000_000
#: Rounds of moving and of merging before the network is contracted.
MOVES, MERGES = 6, 3
NODE = ["node", "k", "label", "scope", "all"]


def _best(near: DataFrame, own: DataFrame) -> DataFrame:
    """For each node the label with the greatest gain among its neighbours' and its own: ``node, to, gain, stay`` and the node's columns.

    ``near`` has a row per link: ``node, k, all, to, size, w``; ``own`` a row per node
    with its present label as ``to``. Both sums combine before the shuffle, so a hub
    is not gathered. Equal gains go to the label that is there, then to the least.
    """
    present = own.select("node", "k", "all", F.col("label").alias("to"), "size", F.lit(0).cast("bigint").alias("w"), F.lit(True).alias("here"), "scope")
    both = near.select("node", "k", "all", "to", "size", "w", F.lit(False).alias("here"), F.lit(None).cast("string").alias("scope")).unionByName(present)
    to = both.groupBy("node", "to").agg(F.sum("w").alias("w"), *[F.max(c).alias(c) for c in ("k", "all", "size", "here", "scope")])
    rest = F.col("size") - F.when(F.col("here"), F.col("k")).otherwise(0)
    to = to.withColumn("gain", F.col("w") - F.col("k").cast("double") * rest / F.col("all"))
    first = F.min(F.struct((-F.col("gain")).alias("loss"), (~F.col("here")).alias("away"), "to"))
    mine = F.max(F.when(F.col("here"), F.struct("to", "gain")))
    out = to.groupBy("node").agg(first.alias("first"), mine.alias("mine"), *[F.max(c).alias(c) for c in ("k", "all", "scope")])
    return out.select("node", "k", "all", "scope", F.col("first.to").alias("to"), (-F.col("first.loss")).alias("gain"), F.col("mine.to").alias("label"), F.col("mine.gain").alias("stay"))


def _coin(what: str, *seed: int) -> Column:
    return F.xxhash64(what, *[F.lit(s) for s in seed])


def _sized(nodes: DataFrame, total: int) -> DataFrame:
    """Nodes with ``size``, the strength of all nodes of their label."""
    sizes = nodes.groupBy("label").agg(F.sum("k").alias("size"))
    return even_join(nodes, sizes, ["label"], hot_keys(nodes, "label", total=total))


def _near(edges: DataFrame, labelled: DataFrame, hot: DataFrame) -> DataFrame:
    """Links with the label at their far end: ``node, k, all, to, size, w``."""
    ends = labelled.select(F.col("node").alias("b"), F.col("label").alias("to"), "size")
    return even_join(edges, ends, ["b"], hot).select(F.col("a").alias("node"), "k", "all", "to", "size", "w")


def _moves(edges: DataFrame, nodes: DataFrame, hot: DataFrame, total: int, seed: int, rounds: int) -> tuple[DataFrame, bool, int, bool]:
    """Local moving, a seeded share of the nodes at a time: (nodes, settled, rounds used, anything moved)."""
    any_moved = False
    for k in range(rounds):
        sized = _sized(nodes, total)
        best = _best(_near(edges, sized, hot), sized)
        better = (F.col("to") != F.col("label")) & (F.col("gain") > F.col("stay"))
        turn = F.pmod(_coin("node", seed, k // 2), F.lit(2)) == k % 2
        # of two that would only change places, one waits
        seen = Observation()
        best = best.observe(seen, F.count(F.when(better, 1)).alias("better"), F.count(F.when(better & turn, 1)).alias("moved"))
        nodes = written(best.select("node", "k", F.when(better & turn, F.col("to")).otherwise(F.col("label")).alias("label"), "scope", "all"), "moved")
        any_moved = any_moved or seen.get["moved"] > 0
        if not seen.get["better"]:
            return nodes, True, k + 1, any_moved
    return nodes, False, rounds, any_moved


def _refined(edges: DataFrame, nodes: DataFrame, hot: DataFrame, total: int, seed: int) -> DataFrame:
    """(``node``, ``part``): each community taken apart into well-connected parts.

    All nodes begin alone. In a round, nodes that are still alone and drew tails join
    the part, of those in their community that drew heads, with the greatest gain over
    staying alone. A part that takes in does not move, so parts are connected.
    """
    inner = edges.join(nodes.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    inner = even_join(inner, nodes.select(F.col("node").alias("b"), F.col("label").alias("lb")), ["b"], hot).where("la = lb AND a <> b")
    inner = written(inner.select("a", "b", "w", "k", "all"), "inner")
    now = nodes.select("node", "k", F.col("node").alias("label"), "scope", "all")
    for r in range(MERGES):
        sized = _sized(now, total).withColumn("alone", (F.col("size") == F.col("k")) & (F.col("label") == F.col("node")))
        tails = F.pmod(_coin("label", seed, r), F.lit(2)) == 1
        open_to = sized.where(~tails)
        alone = sized.where(tails & F.col("alone"))
        links = inner.join(alone.select(F.col("node").alias("a")), "a", "left_semi")
        best = _best(_near(links, open_to, hot), alone)
        joining = best.where((F.col("to") != F.col("label")) & (F.col("gain") > 0)).select("node", F.col("to").alias("joined"))
        seen = Observation()
        after = now.join(joining, "node", "left").observe(seen, F.count("joined").alias("joined"))
        now = written(after.select("node", "k", F.coalesce("joined", "label").alias("label"), "scope", "all"), "refined")
        if not seen.get["joined"]:
            break
    dropped(inner)
    return now.select("node", F.col("label").alias("part"))


def _contracted(edges: DataFrame, nodes: DataFrame, parts: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network whose nodes are the parts; links inside a part become its loop, labels are the communities."""
    to = even_join(edges.select("a", "b", "w"), parts.select(F.col("node").alias("b"), F.col("part").alias("pb")), ["b"], hot)
    to = to.join(parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a")
    links = to.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w"))
    joined = nodes.join(parts, "node").groupBy("part").agg(F.sum("k").alias("k"), F.min("label").alias("label"), F.min("scope").alias("scope"), F.max("all").alias("all"))
    whole = written(joined.withColumnRenamed("part", "node").select(*NODE), "nodes")
    return written(links.join(whole.select(F.col("node").alias("a"), "k", "all"), "a"), "network"), whole


def leiden(edges: DataFrame, nodes: DataFrame, *, seed: int = 42, rounds: int = 120) -> DataFrame:
    """(``node``, ``community``, ``scope``): connected communities of high modularity within each scope.

    ``edges`` has ``a, b, w`` in both directions, each pair once, ``w`` in whole units;
    ``nodes`` has ``node, scope``, and edges stay inside a scope. Nodes move to the
    neighbouring community with the best gain; communities are refined into
    well-connected parts; the parts become the nodes of a smaller network, where moving
    goes on from the communities found, until a pass moves nothing and contracts
    nothing. All of it is joins and sums over tables that are written out. What still
    moves after ``rounds`` rounds in all is an error. A community is named by its least
    node, and is split if it is not connected.
    """
    strength = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    known = written(nodes.select("node", "scope").join(strength, "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"), "scope"), "strength")
    sums = known.groupBy("scope").agg(F.sum("k").alias("all"))
    count = known.count()
    base = written(even_join(known, sums, ["scope"], hot_keys(known, "scope", total=count)).where("k > 0").select("node", "k", F.col("node").alias("label"), "scope", "all"), "nodes")
    links = written(edges.select("a", "b", "w").join(base.select(F.col("node").alias("a"), "k", "all"), "a"), "network")
    first, at, used = links, base.select("node", F.col("node").alias("top")), 0
    now = base
    while True:
        total = max(count, links.count())
        hot = hot_keys(links, "b", total=total)
        hot = hot if hot is None else written(hot, "hubs")
        now, settled, took, any_moved = _moves(links.where("a <> b"), now, hot, total, seed + used, min(MOVES, rounds - used))
        used += took
        if not settled and used >= rounds:
            raise RuntimeError(f"communities: nodes still move after {rounds} rounds")
        n, groups = now.agg(F.count("*"), F.countDistinct("label")).first()
        if n == groups or settled and not any_moved:
            break
        parts = written(_refined(links.where("a <> b"), now, hot, total, seed + used), "parts")
        if parts.agg(F.countDistinct("part")).first()[0] == n:
            if settled:
                break
            continue
        links, now = _contracted(links, now, parts, hot)
        at = written(at.join(parts.select(F.col("node").alias("top"), "part"), "top").select("node", F.col("part").alias("top")), "mapped")
    labels = at.join(now.select(F.col("node").alias("top"), "label"), "top").select("node", "label")
    # names, and what is not connected apart
    labels = written(labels, "labels")
    inside = first.join(labels.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b").where("ca = cb")
    parts = components(inside.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")), known)
    return parts.join(known.select("node", "scope"), "node").select("node", F.col("component").alias("community"), "scope")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of (``node``, ``community``) over ``edges`` with ``a, b, w`` in both directions."""
    of = labels.select("node", "community")
    k = edges.join(of.withColumnRenamed("node", "a"), "a").groupBy("community").agg(F.sum("w").alias("k"))
    both = edges.join(of.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside, total = both.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)), F.sum("w")).first()
    squares = k.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0]
    return float(inside / total - squares / total**2) if total else 0.0


def both_ways(edges: DataFrame) -> DataFrame:
    """``a, b, w`` in both directions from ``source_id, target_id, strength``; parallel edges add up, loops go."""
    weighted = edges.select("source_id", "target_id", F.round(F.greatest(F.col("strength"), F.lit(1e-4)) * UNIT).cast("bigint").alias("w")).where("source_id <> target_id")
    both = weighted.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "w").unionByName(weighted.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def hierarchy(edges: DataFrame, nodes: DataFrame, *, max_size: int = 100, seed: int = 42, levels: int = 60, rounds: int = 120) -> DataFrame:
    """(``level``, ``community``, ``parent``, ``node``): connected communities, the large ones split again.

    Level 0 clusters the whole network (:func:`leiden`); a community of more than
    ``max_size`` nodes is clustered again on the next level, as a network of its own
    links, until it does not split further. What has not settled after ``rounds``
    rounds of moving or ``levels`` levels is an error. Isolated nodes are communities
    of their own on level 0. No component has to fit into one task. A community is
    named by its least node.
    """
    both = written(both_ways(edges), "network")
    labels = written(nodes.select("node", F.lit("").alias("scope")).distinct(), "labels")
    out = None
    for level in range(levels):
        a, b = (labels.select(F.col("node").alias(x), F.col("scope").alias(f"s{x}")) for x in "ab")
        inside = both if level == 0 else written(both.join(a, "a").join(b, "b").where("sa = sb").select("a", "b", "w"), "inside")
        found = written(leiden(inside, labels, seed=seed + level, rounds=rounds), "level")
        rows = found.select(F.lit(level).alias("level"), "community", F.nullif(F.col("scope"), F.lit("")).alias("parent"), "node")
        out = rows if out is None else out.unionByName(rows)
        sizes = found.groupBy("community", "scope").agg(F.count("*").alias("n"))
        whole = sizes.join(labels.groupBy("scope").agg(F.count("*").alias("all")), "scope").where("n = all AND scope <> ''")
        again = sizes.where(F.col("n") > max_size).select("community").join(whole.select("community"), "community", "left_anti")
        labels = written(found.join(again, "community", "left_semi").select("node", F.col("community").alias("scope")), "labels")
        if labels.isEmpty():
            break
    else:
        raise RuntimeError(f"hierarchy: communities of more than {max_size} nodes still split after {levels} levels")
    return out


def community_rows(members: DataFrame, entities: DataFrame) -> DataFrame:
    """A row per community: id over level and members, title of the first three names, size.

    Members are in the order of their ids; one whose entity is unknown doesn't count.
    Only the three first members of a community ever come together in a row; its text
    units are rows of :func:`community_units`.
    """
    keys = ["level", "community"]
    rows = written(members.join(entities.select(F.col("node_id").alias("node"), "name"), "node"), "members")
    facts = rows.groupBy(*keys).agg(F.min("parent").alias("parent"), F.count("*").alias("size"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("node"))).where("r <= 3")
    titles = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("names"))
    out = facts.join(titles, keys).join(digests(rows, keys, "node"), keys)
    title = F.array_join(F.transform("names", lambda x: x["name"]), " / ")
    ident = T.stable_id("community", F.col("level").cast("string"), F.col("digest"))
    return out.select(*keys, "parent", ident.alias("id"), title.alias("title"), "size")


def community_units(members: DataFrame, units: DataFrame) -> DataFrame:
    """(``level``, ``community``, ``chunk_id``): the text units of each community's members; ``units`` has ``node_id, chunk_id``."""
    return members.join(units.select(F.col("node_id").alias("node"), "chunk_id"), "node").select("level", "community", "chunk_id").distinct()


def contexts(members: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a report is written from, all communities at once: rows of entities and rows of relations, by ``community_id``.

    Relations are those with both ends in the community: two equi-joins on members.
    Rows stay rows; a caller that needs one text per community picks what fits a prompt.
    """
    inside = members.join(entities, "node_id").select("community_id", "node_id", "name", "description")
    a = relations.join(members.select(F.col("node_id").alias("source_id"), "community_id"), "source_id")
    between = a.join(members.select(F.col("node_id").alias("target_id"), "community_id"), ["target_id", "community_id"])
    return inside, between.select("community_id", "edge_id", "source_id", "target_id", "description")


def community_edges(rows: DataFrame, members: DataFrame) -> DataFrame:
    """IN_COMMUNITY and PARENT_COMMUNITY edges. ``rows`` has ``id, parent_id``; ``members`` has ``community_id, node_id``."""
    node = F.col("node_id")
    into = members.select(T.stable_id("edge", node, F.col("community_id"), F.lit("IN_COMMUNITY")).alias("id"), node.alias("source_id"), F.col("community_id").alias("target_id"), F.lit("IN_COMMUNITY").alias("type"), F.lit(0.25).alias("weight"))
    up = rows.where("parent_id <> ''").select(T.stable_id("edge", F.col("id"), F.col("parent_id"), F.lit("PARENT_COMMUNITY")).alias("id"), F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("PARENT_COMMUNITY").alias("type"), F.lit(0.15).alias("weight"))
    return into.unionByName(up)


def sources_of(members: DataFrame, evidence: DataFrame, most: int = 30) -> DataFrame:
    """(``community_id``, ``source``): the first ``most`` sources of each community."""
    of = members.join(evidence.select("node_id", "source"), "node_id").select("community_id", "source").distinct()
    return of.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("source"))).where(F.col("r") <= most).drop("r")
