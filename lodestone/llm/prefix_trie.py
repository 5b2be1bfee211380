"""A prefix trie over conversations, built level by level.

A node is a distinct sequence of the first d turns; its members are the
conversations that begin with it, and the least of their ids names it. Per depth,
the live conversations are grouped by (parent node, next turn). Equal conversations
enter as one with a weight, and one that is alone at a node needs no more grouping:
its further nodes form a chain. So there are as many rounds as the longest prefix
that two different conversations share has turns. Leaves and savings are then rolled
up by joins from the deepest level to the root.

A turn is known by the SHA-256 digest of its role and text, so texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import CRC32_SQL, digests_of_sequences, drop_written, join_counted, load, numbered_within, written

#: Turns of a chain that one task sums up.
CHAIN_BLOCK = 4096


def turn_rows(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``pos``, ``digest``, ``chars``) of each turn, positions from 1.

    Turns come in the order of ``turn``, nulls first; equal or null turns in the
    order of role and text, so repeated rows are turns of their own. Null roles and
    texts count as empty. Rows without an id belong to no conversation and are left out.
    """
    part = rows.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    part = part.withColumns({"digest": F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256)), "chars": F.char_length("text").cast("bigint")})
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranges = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    return written(numbered_within(part, "conv_id", order, ranges=ranges, keep=["conv_id", "digest", "chars"]), "turns")


def _head(conv_id):
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: (their turns, one row ``conv_id, n_turns`` for each conversation).

    The first h turns of conversation c are those of conversation ``c - c % 100``
    (fewer if it has fewer, none if there is none), then come c's own turns after its
    first h; h is the CRC-32 of c's decimal digits modulo 6. Remainders have the sign of c.
    """
    convs = written(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "conversations")
    known = convs.select("conv_id", "n", _head(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = known.join(bases, "base", "left").withColumn("from_base", F.least("h", F.coalesce("n_base", F.lit(0))))
    known = written(known, "heads")
    total = turns.count()
    own = join_counted(turns, known.select("conv_id", "n", "h", "from_base"), ["conv_id"], total).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("from_base")).alias("pos"), "digest", "chars")
    first = turns.where("pos <= 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    begun = known.where("from_base > 0").select("conv_id", "base", "from_base").join(first, "base").where("pos <= from_base")  # at most 199 conversations a base
    every = known.select("conv_id", (F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return written(own.unionByName(begun.select("conv_id", "pos", "digest", "chars")), "rebuilt"), written(every, "every")


def _classes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations: (``conv_id, rep``) and (``rep, n_turns, weight``); the least id stands for its class.

    Conversations are equal if the sums over their turns' digests, taken with the
    positions and in five lanes, are.
    """
    hexed = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), F.col("digest")), 256)
    lanes = turns.select("conv_id", *[F.conv(F.substring(hexed, 1 + 12 * k, 12), 16, 10).cast("decimal(18,0)").alias(f"l{k}") for k in range(5)])
    sums = lanes.groupBy("conv_id").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(5)])
    names = [f"l{k}" for k in range(5)]
    keyed = convs.join(sums, "conv_id", "left").select("conv_id", "n_turns", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    keyed = written(keyed.select("conv_id", "n_turns", F.concat_ws(",", F.col("n_turns").cast("string"), *names).alias("kind")), "kinds")
    classes = written(keyed.groupBy("kind", "n_turns").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "classes")
    members = join_counted(keyed.select("conv_id", "kind"), classes.select("kind", "rep", "n"), ["kind"], keyed.count())
    return written(members.select("conv_id", "rep"), "members"), classes.select("rep", "n_turns", F.col("n").alias("weight"))


def _chains(chains: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of conversations that are alone from depth ``top`` on: ``rep, depth, chars, saved`` (summed to the end)."""
    on = turns.join(chains.select(F.col("rep").alias("conv_id"), "top", "weight"), "conv_id").where("pos >= top")
    part = on.select(F.col("conv_id").alias("rep"), F.col("pos").alias("depth"), "chars", "top", "weight")
    # only what has copies saves anything, and long chains are summed in blocks
    plain = part.where("weight = 1").select("rep", "depth", "chars", F.lit(0).cast("bigint").alias("saved"))
    some = part.where("weight > 1").withColumn("block", F.floor(F.col("depth") / CHAIN_BLOCK))
    blocks = some.groupBy("rep", "block").agg(F.sum("chars").alias("n"))
    after = F.coalesce(F.sum("n").over(Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("chars").over(Window.partitionBy("rep", "block").orderBy(F.desc("depth")))
    summed = some.withColumn("within", within).join(blocks.select("rep", "block", after.alias("after")), ["rep", "block"])
    return plain.unionByName(summed.select("rep", "depth", "chars", ((F.col("weight") - 1) * (F.col("within") + F.col("after"))).alias("saved")))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, members_chars, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` is as from :func:`turn_rows` and ``convs`` has ``conv_id, n_turns`` of
    every conversation, those without turns too: they are members of the root alone.
    ``conv_id`` is the node's least member and, with ``depth``, its key. ``ends_sha256``
    hashes the ids of the members that end at the node. No conversations: no nodes.
    """
    spark = turns.sparkSession
    members, classes = _classes(turns, convs)
    classes = written(classes, "classes")
    root = classes.agg(F.min("rep").alias("rep"), F.sum("weight").alias("n")).first()
    if root["rep"] is None:
        empty = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, chars bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
        return spark.createDataFrame([], empty)
    n_turns = int(classes.agg(F.sum("n_turns")).first()[0])
    kept = join_counted(turns, classes.select(F.col("rep").alias("conv_id"), F.col("n_turns").alias("n")), ["conv_id"], n_turns)
    # by position, so that a level reads its own turns only
    by_depth = written(kept.select("conv_id", "pos", "digest", "chars").repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "by-depth")

    # down: shared nodes of each depth, and conversations that are alone from there on
    live = written(classes.select("rep", F.lit(root["rep"]).cast("bigint").alias("node"), "n_turns", "weight"), "live")
    shared = {0: spark.createDataFrame([(root["rep"], None, root["n"], 0)], "conv_id bigint, parent bigint, n_convs bigint, chars bigint")}
    alone, ends, depth, steps = {}, [], 0, [live]
    while True:
        ends.append(live.where(F.col("n_turns") == depth).select(F.lit(depth).cast("bigint").alias("depth"), F.col("node").alias("conv_id"), "rep"))
        going = live.where(F.col("n_turns") > depth)
        if going.isEmpty():
            break
        depth += 1
        level = by_depth.where(F.col("pos") == depth).select(F.col("conv_id").alias("rep"), "digest", "chars")
        step = written(going.join(level, "rep").select("rep", F.col("node").alias("parent"), "n_turns", "weight", "digest", "chars"), "step")
        groups = step.groupBy("parent", "digest").agg(F.min("rep").alias("node"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"), F.count("*").alias("n"), F.max("n_turns").alias("n_turns"))
        groups = written(groups, "groups")
        shared[depth] = groups.where("n > 1").select(F.col("node").alias("conv_id"), "parent", "n_convs", "chars")
        alone[depth] = groups.where("n = 1").select(F.col("node").alias("rep"), "parent", F.lit(depth).cast("bigint").alias("top"), F.col("n_convs").alias("weight"), "n_turns")
        many = groups.where("n > 1").select("parent", "digest", "node", "n")
        live = written(join_counted(step, many, ["parent", "digest"], step.count()).select("rep", "node", "n_turns", "weight"), "live")
        steps += [live, step]

    # chains, and what their tops hand up
    chains = None
    for part in alone.values():
        chains = part if chains is None else chains.unionByName(part)
    pieces = []
    tops = None
    if chains is not None:
        chains = written(chains, "alone")
        sums = written(_chains(chains, by_depth), "chains")
        held = sums.join(chains, "rep")
        tops = written(held.where("depth = top").select("depth", F.col("rep").alias("conv_id"), "parent", F.lit(1).cast("bigint").alias("n_leaves"), "saved"), "tops")
        pieces.append(
            held.select(
                F.col("rep").alias("conv_id"),
                "depth",
                F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"),
                F.col("weight").alias("n_convs"),
                "chars",
                F.when(F.col("depth") < F.col("n_turns"), 1).otherwise(0).cast("bigint").alias("n_children"),
                F.lit(1).cast("bigint").alias("n_leaves"),
                F.col("saved").alias("saved_tokens"),
            )
        )
        ends.append(chains.select(F.col("n_turns").alias("depth"), F.col("rep").alias("conv_id"), "rep"))

    # up: children's leaves and savings join their parents, the deepest level first
    below = None
    for d in range(depth, -1, -1):
        nodes = shared[d]
        if below is not None:
            given = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"))
            nodes = nodes.join(given, "conv_id", "left")
        else:
            nodes = nodes.withColumns({c: F.lit(None).cast("bigint") for c in ("n_children", "leaves", "below")})
        level = nodes.select(
            "conv_id",
            F.lit(d).cast("bigint").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "chars",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("below", F.lit(0))).alias("saved_tokens"),
        )
        level = written(level, "level")
        pieces.append(level)
        below = level.select("conv_id", F.col("parent_conv_id").alias("parent"), "n_leaves", F.col("saved_tokens").alias("saved"))
        if tops is not None:
            below = below.unionByName(tops.where(F.col("depth") == d).select("conv_id", "parent", "n_leaves", "saved"))

    every = pieces[0]
    for part in pieces[1:]:
        every = every.unionByName(part)
    ended = ends[0]
    for part in ends[1:]:
        ended = ended.unionByName(part)
    single = classes.where("weight = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))
    copied = classes.where("weight > 1").select("rep", F.col("weight").alias("n"))
    copies = written(join_counted(members, copied, ["rep"], int(root["n"])), "copies")
    hashed = digests_of_sequences(copies, "rep", "conv_id", "conv_id", separator=",").withColumnRenamed("sha256", "ends_sha256")
    ended = ended.join(single.unionByName(hashed), "rep").select("depth", "conv_id", "ends_sha256")
    out = written(every.join(ended, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "trie")
    for part in (*steps, by_depth, members, copies):
        drop_written(part)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt_turns(turn_rows(load(spark, sf_dir, "conversations")))
    return prefix_trie(turns, convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32_SQL.format(x="conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
), q AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS key,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
), m AS (
  SELECT conv_id, depth, chars, key, coalesce(before, '') AS before, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM q
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM q) FROM c
), n AS (
  SELECT min(conv_id) AS conv_id, depth, key, min(before) AS before, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY depth, key
), k AS (SELECT before AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.key = n.before LEFT JOIN k ON k.depth = n.depth AND k.key = n.key
JOIN (
  SELECT a.depth, a.key, count(*) FILTER (l.n_children IS NULL) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM n a JOIN n b ON b.depth >= a.depth AND starts_with(b.key, a.key) LEFT JOIN k l ON l.depth = b.depth AND l.key = b.key GROUP BY a.depth, a.key
) s ON s.depth = n.depth AND s.key = n.key
"""
