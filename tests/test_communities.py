"""Communities settle, or the call says that they did not."""

import pytest

from lodestone.operators import communities as Q
from lodestone.plans.queries import QUERIES


def net(spark):
    rows = [(f"{x}{i}", f"{x}{j}", 1.0) for x in "abcd" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("c2", "d2", 1.0)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, strength double").coalesce(1)
    nodes = spark.createDataFrame([(f"{x}{i}",) for x in "abcd" for i in range(5)], "node string").coalesce(1)
    return edges, nodes


def test_bounds_are_not_silent(spark):
    edges, nodes = net(spark)
    with pytest.raises(RuntimeError, match="still move"):
        Q.hierarchy(edges, nodes, rounds=2)
    with pytest.raises(RuntimeError, match="still split"):
        Q.hierarchy(edges, nodes, max_size=2, levels=1)


def test_query_reads_all_suppliers(spark, tmp_path):
    spark.range(240).selectExpr("id as s_suppkey", "id % 2 as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(2).selectExpr("id as n_nationkey", "id as n_regionkey").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    got = QUERIES["community_hierarchy"](spark, str(tmp_path)).where("level = 0").toPandas()
    assert set(got["node"]) == {f"s{i}" for i in range(240)} | {"n0", "n1", "r0", "r1"}
    groups = {frozenset(g["node"]) for _, g in got.groupby("community")}
    assert groups == {frozenset({f"s{i}" for i in range(k, 240, 2)} | {f"n{k}", f"r{k}"}) for k in (0, 1)}


def found(spark, rows, nodes=(), **more):
    edges = spark.createDataFrame(rows, "source_id string, target_id string, strength double").coalesce(1)
    names = sorted({x for r in rows for x in r[:2]} | set(nodes))
    both = Q.both_ways(edges).cache()
    labels = Q.leiden(both, spark.createDataFrame([(x, "") for x in names], "node string, scope string").coalesce(1), **more).cache()
    return labels, Q.modularity(both, labels)


def connected(rows, groups):
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for g in groups:
        seen, todo = set(), [min(g)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, set()) & g
        assert seen == g


def test_ring_of_cliques_and_path_reach_the_known_modularity(spark):
    ring = [(f"c{c:02d}n{i}", f"c{c:02d}n{j}", 1.0) for c in range(20) for i in range(5) for j in range(i)] + [(f"c{c:02d}n0", f"c{(c + 1) % 20:02d}n1", 1.0) for c in range(20)]
    labels, q = found(spark, ring)
    groups = [set(g["node"]) for _, g in labels.toPandas().groupby("community")]
    connected(ring, groups)
    assert q >= 0.99 * (10 / 11 - 1 / 20)  # a clique each: 200 of 220 links inside, 20 equal parts
    path = [(f"p{i:03d}", f"p{i + 1:03d}", 1.0) for i in range(120)]
    labels, q = found(spark, path, ["alone"])
    groups = [set(g["node"]) for _, g in labels.toPandas().groupby("community")]
    connected(path, groups)
    assert {"alone"} in groups and q >= 0.99 * (110 / 120 - (10 * 22**2 + 20**2) / 240**2)  # eleven parts of eleven nodes


def test_hubs_do_not_change_the_result(spark, monkeypatch):
    from lodestone.operators import joins

    rows = [(f"h{k}", f"h{k}x{i:02d}", 1.0) for k in range(3) for i in range(30)] + [("h0", "h1", 1.0), ("h1", "h2", 1.0)]
    plain, q = found(spark, rows)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_KEYS", 50)
    split, p = found(spark, rows)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect())) and p == q
    assert {frozenset(g["node"]) for _, g in plain.toPandas().groupby("community")} == {frozenset([f"h{k}", *(f"h{k}x{i:02d}" for i in range(30))]) for k in range(3)}
