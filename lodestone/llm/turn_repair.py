"""Repair of broken conversations, each distinct structure solved once.

Every row of a conversation becomes one letter: who speaks, and what is wrong with
the row. The letters in order are the conversation's signature. Many conversations
have one signature, so the cheapest edits are sought once for each distinct one, by a
memoised recursion; the audit (an edit for each letter, and insertions) then joins
back to the conversations that have the signature, and the edits are replayed on
their rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import CRC32_SQL, drop_written, join_counted, load, numbered_within, trim, written

#: Signature letters: by column system, user, assistant, other; by row sound, truncated, to be deleted.
SOUND, TRUNCATED, DELETED = "suao", "SUAO", "1234"
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
#: Letters that one task joins at a time, and the depth at which the recursion stops to take breath.
BLOCK, DEEP = 4096, 200
NAMES = {"u": "user", "a": "assistant"}
#: What may be spoken in each state, and the state after it. 0: nothing yet, 1: after system, 2: after user, 3: after assistant.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_DONE = (0, 3)


def cheapest_edits(signature: str) -> tuple[int, str, str]:
    """(cost, audit, speakers) of the cheapest way to spoken order ``(s?(ua)+)?``.

    The audit has K (keep), R (another role) or D (delete) for each letter and I
    (insert) between them; of equally cheap audits the least in ASCII order is taken.
    ``speakers`` has the role after the edit under each letter of the audit, ``-``
    under D. The edits after a letter depend only on the state there, so what is best
    from (letter, state) on is found once. No two options of a state begin alike, so
    comparing their own letters settles a tie.
    """

    def edits(at: int, state: int) -> Iterator[tuple[int, str, str, int]]:
        """Ways past one letter without an insertion: (cost, letter, speaker, state after)."""
        kind = signature[at]
        yield DELETE, "D", "-", state
        if kind in DELETED:
            return
        cut = CUT if kind in TRUNCATED else 0
        who = kind.lower()
        if who in _NEXT[state]:
            yield cut, "K", who, _NEXT[state][who]
        for role in ("u", "a"):
            if role in _NEXT[state]:
                yield cut + REROLE, "R", role, _NEXT[state][role]

    def openings(state: int) -> Iterator[tuple[int, str, str, int]]:
        """Up to two insertions; a third would only lead back to where one did."""
        cost, letters, speakers = 0, "", ""
        for _ in range(3):
            yield cost, letters, speakers, state
            role = "a" if state == 2 else "u"
            cost, letters, speakers, state = cost + INSERT, letters + "I", speakers + role, _NEXT[state][role]

    @functools.cache
    def best(at: int, state: int) -> tuple[int, str, str, int]:
        """(cost from here to the end, this step's letters, its speakers, the state after it)."""
        found = []
        for cost, letters, speakers, now in openings(state):
            if at == len(signature):
                if now in _DONE:
                    found.append((cost, letters, speakers, now))
                continue
            for more, letter, speaker, after in edits(at, now):
                found.append((cost + more + best(at + 1, after)[0], letters + letter, speakers + speaker, after))
        return min(found)

    for at in range(len(signature), 0, -DEEP):  # so that the recursion is never deeper than that
        for state in _NEXT:
            best(at, state)
    cost, audit, speakers, state = best(0, 0)[0], [], [], 0
    for at in range(len(signature) + 1):
        _, letters, who, state = best(at, state)
        audit.append(letters)
        speakers.append(who)
    return cost, "".join(audit), "".join(speakers)


def illegal_pairs(signature: str) -> int:
    """Neighbours whose roles do not follow each other."""
    who = [SOUND[max(k.find(c) for k in (SOUND, TRUNCATED, DELETED))] for c in signature]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:], strict=False))


def conversation_rows(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text``; null roles and texts become one space."""
    return rows.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`conversation_rows` with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties the text, 2 takes its stops away, 3 repeats the row, 4
    makes it the user's. A null in the hashed string is one space.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = rows.withColumn("hit", F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = hit.withColumns({"text": text, "role": F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))})
    return hit.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("hit", "copy")


def audited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation, its rows with their places ``pos``).

    Of each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, speakers``. ``rows`` is as from :func:`conversation_rows`; they are taken by
    turn, nulls first, equal or null turns in the order of role and text. A row's first
    fault counts: no visible character, an earlier row with its role and text, no stop
    as the last visible character. Rows with a null id are one conversation with a
    null id.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranges = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    placed = written(numbered_within(rows, "conv_id", order, ranges=ranges, keep=["conv_id", "turn", "role", "text"]), "rows")

    first = F.substring("role", 1, 1)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    facts = placed.select(
        # a null id must find itself in joins
        F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("conv"),
        "turn",
        "pos",
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("who"),
        F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256).alias("said"),
        (last == "").alias("is_blank"),
        (~last.isin(".", "!", "?")).alias("is_cut"),
    )
    facts = written(facts, "facts")
    said = facts.groupBy("conv", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = written(join_counted(facts.select("conv", "said", "pos"), said, ["conv", "said"], facts.count()).where("pos > first").select("conv", "pos", F.lit(True).alias("again")), "again")
    facts = facts.join(again, ["conv", "pos"], "left")
    fault = F.when(F.col("is_blank"), "blank").when(F.coalesce("again", F.lit(False)), "duplicate").when(F.col("is_cut"), "truncated")
    letter = F.translate("who", SOUND, DELETED)
    facts = facts.select("conv", "turn", "pos", fault.alias("fault"), F.when(F.col("fault").isin("blank", "duplicate"), letter).when(F.col("fault") == "truncated", F.upper("who")).otherwise(F.col("who")).alias("letter"))
    facts = written(facts, "letters")

    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    counts = facts.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1).alias("span"), count("blank"), count("duplicate"), count("truncated"))
    turns = facts.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("turns"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), "")
    blocks = facts.withColumn("at", F.col("pos")).groupBy("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(joined("letter").alias("letters"))
    signed = blocks.withColumn("at", F.col("block")).groupBy("conv").agg(joined("letters").alias("signature"))
    each = counts.join(turns, "conv", "left").join(signed, "conv")
    each = written(each.select("conv", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "signature"), "signatures")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(s, n, illegal_pairs(s), *cheapest_edits(s)) for s, n in zip(f["signature"], f["n"], strict=True)]
            yield pd.DataFrame(out, columns=["signature", "n", "illegal", "cost", "audit", "speakers"])

    distinct = each.groupBy("signature").agg(F.count("*").alias("n"))
    solved = written(distinct.mapInPandas(solve, "signature string, n bigint, illegal bigint, cost bigint, audit string, speakers string"), "solved")
    done = written(join_counted(each, solved, ["signature"], each.count()).select(F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), *[c for c in each.columns[1:-1]], "illegal", "cost", "audit", "speakers"), "audited")
    for part in (facts, again, each, solved):
        drop_written(part)
    return done, placed


def replayed(done: DataFrame, placed: DataFrame, *, texts: bool = True) -> DataFrame:
    """The rows after their edits: ``conv_id, at, role, text``, ``at`` from 0; or, without ``texts``, (``conv_id, repaired_sha256``).

    A conversation's audit travels before its rows to the task that replays it, row by
    row, so no conversation is held in memory. The digest is of ``role:text`` lines; a
    conversation of which nothing stays has that of the empty string.
    """
    headed = done.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.col("audit").alias("role"), F.col("speakers").alias("text"))
    line = headed.unionByName(placed.select("conv_id", "pos", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def edited(rows):
        """The kept, changed and inserted rows, after (conv_id, None, None, None) for each conversation."""
        audit, speakers, at, n, key = "", "", 0, 0, None
        for conv, pos, role, text in rows:
            if pos == 0:
                while at < len(audit):  # what is inserted at the end of the conversation before
                    yield key, n, NAMES[speakers[at]], ""
                    at, n = at + 1, n + 1
                audit, speakers, at, n, key = role, text, 0, 0, conv
                yield conv, None, None, None
                continue
            while audit[at] == "I":
                yield key, n, NAMES[speakers[at]], ""
                at, n = at + 1, n + 1
            if audit[at] != "D":
                yield key, n, role if audit[at] == "K" else NAMES[speakers[at]], text
                n += 1
            at += 1
        while at < len(audit):
            yield key, n, NAMES[speakers[at]], ""
            at, n = at + 1, n + 1

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, size = [pa.int64(), pa.int64(), pa.string(), pa.string()], [], 0
        frame = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "at", "role", "text"])
        for row in edited(rows_of(batches)):
            if row[1] is not None:
                out.append(row)
                size += len(row[3])
            if size > 1 << 22 or len(out) >= 10_000:
                yield frame()
                out, size = [], 0
        if out:
            yield frame()
        trim()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        frame = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([d for _, d in out])], names=["conv_id", "repaired_sha256"])
        for conv, at, role, text in edited(rows_of(batches)):
            if at is None:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = conv, hashlib.sha256()
                if len(out) >= 10_000:
                    yield frame()
                    out = []
                continue
            state.update(f"\n{role}:{text}".encode() if at else f"{role}:{text}".encode())
        if state is not None:
            out.append((key, state.hexdigest()))
        if out:
            yield frame()
        trim()

    return line.mapInArrow(whole, "conv_id bigint, at bigint, role string, text string") if texts else line.mapInArrow(digest, "conv_id bigint, repaired_sha256 string")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_rows(load(spark, sf_dir, "conversations"))
    done, placed = audited(damaged(rows))
    hashes = replayed(done, placed, texts=False)
    each = done.drop("speakers").withColumnRenamed("conv_id", "c").join(hashes.withColumnRenamed("conv_id", "h"), F.col("c").eqNullSafe(F.col("h")))
    every = rows.select("conv_id").distinct()
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = every.join(each, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), h AS (SELECT *, {CRC32_SQL.format(x="k")} % 20 AS hit FROM o
), d AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h CROSS JOIN (SELECT unnest([0, 1]) AS copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM d
), f AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS who, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
         CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM p
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND coalesce(prev, '') || who NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM f GROUP BY conv_id
), ins(st, cost, letters, lines, nxt) AS (
  VALUES (0, 0, '', [], 0), (0, 2, 'I', ['user:'], 2), (0, 4, 'II', ['user:', 'assistant:'], 3), (1, 0, '', [], 1), (1, 2, 'I', ['user:'], 2), (1, 4, 'II', ['user:', 'assistant:'], 3),
         (2, 0, '', [], 2), (2, 2, 'I', ['assistant:'], 3), (2, 4, 'II', ['assistant:', 'user:'], 2), (3, 0, '', [], 3), (3, 2, 'I', ['user:'], 2), (3, 4, 'II', ['user:', 'assistant:'], 3)
), go(st, who, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ops(st, op, who, nxt) AS (
  SELECT st, 'K', who, nxt FROM go UNION ALL SELECT st, 'R', who, nxt FROM go WHERE who <> 's' UNION ALL SELECT st, 'D', '', st FROM (SELECT DISTINCT st FROM go)
), r AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS st, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM c
  UNION ALL
  SELECT conv_id, pos, st, best.cost, best.audit, best.lines FROM (
    SELECT conv_id, pos, st, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
      SELECT r.conv_id, f.pos, ops.nxt AS st, r.cost + ins.cost + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN op <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
             r.audit || ins.letters || op AS audit,
             r.lines || ins.lines || CASE op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE ops.who WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] END AS lines
      FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1 JOIN ins ON ins.st = r.st JOIN ops ON ops.st = ins.nxt
      WHERE op = 'D' OR f.fault IN ('', 'truncated') AND (op = 'R' OR ops.who = f.who)
    ) GROUP BY conv_id, pos, st
  )
), z AS (
  SELECT r.conv_id, min({{'cost': r.cost + ins.cost, 'audit': audit || letters, 'lines': r.lines || ins.lines}}) AS best
  FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.pos JOIN ins ON ins.st = r.st WHERE ins.nxt IN (0, 3) GROUP BY r.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(z.best.cost, 0) AS cost, coalesce(z.best.audit, '') AS audit, sha256(coalesce(array_to_string(z.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM e.conv_id
"""
