"""Incremental upkeep: snapshot differences, upserts, histories and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(disk: DataFrame, index: DataFrame, *, version: int) -> DataFrame:
    """(``source``, ``change``) where disk and index differ: new, updated (time or version) or deleted."""
    a = disk.select("source", F.col("mtime").alias("d_mtime"), F.lit(True).alias("d"))
    b = index.select("source", F.col("mtime").alias("i_mtime"), F.col("index_version").alias("i_version"), F.lit(True).alias("i"))
    both = a.join(b, "source", "full_outer")
    stale = ~F.col("d_mtime").eqNullSafe(F.col("i_mtime")) | ~F.col("i_version").eqNullSafe(F.lit(version))
    change = F.when(F.col("i").isNull(), "new").when(F.col("d").isNull(), "deleted").when(stale, "updated")
    return both.select("source", change.alias("change")).where("change IS NOT NULL")


def synced(index: DataFrame, fresh: DataFrame, changes: DataFrame, by: str = "source") -> DataFrame:
    """The index after the changes: rows of changed and deleted sources go, fresh rows come."""
    return index.join(changes.select(by), by, "left_anti").unionByName(fresh.join(changes.where("change <> 'deleted'").select(by), by, "left_semi"), allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def last_of(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """For each key the row with the greatest ``order`` (nulls are the least); reduced before the shuffle."""
    last = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order))
    return rows.groupBy(*[F.col(c).alias(f"key{i}") for i, c in enumerate(key)]).agg(last.alias("last")).select("last.*")


def latest_changes(events: DataFrame, *, key: str = "source", order: str = "ts", tie: str | list[str] | None = None) -> DataFrame:
    """The last event of each key: what a debounced batch applies. ``tie`` names columns that decide between equal times."""
    ties = [tie] if isinstance(tie, str) else tie or []
    return last_of(events, [key], order, *ties)


def digests(rows: DataFrame, keys: list[str], item: str, *more: str) -> DataFrame:
    """(``keys``, ``digest``): a SHA-256 over each group's items in order.

    Items are hashed in up to 65,536 parts by their own hash, then the parts' hashes:
    no task holds the items of a large group.
    """
    part = F.substring(F.sha2(F.col(item), 256), 1, 4)
    listed = lambda *c: F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*c)))), 256)
    parts = rows.groupBy(*keys, part.alias("part")).agg(listed(item, *more).alias("hash"))
    return parts.groupBy(*keys).agg(listed("part", "hash").alias("digest"))


def quiet_batches(events: DataFrame, quiet_seconds: float = 2.0, *, key: str = "source", ts: str = "ts") -> DataFrame:
    """Number the batches of each key's changes: one ends when the key is quiet for so long."""
    line = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(line).cast("timestamp"))
    starts = F.when(gap.isNull() | (gap >= int(quiet_seconds * 1e6)), 1).otherwise(0)
    return events.withColumn("starts", starts).withColumn("batch", F.sum("starts").over(line)).drop("starts")


def last_turns(turns: DataFrame, n: int, *, session: str = "session", turn: str = "turn") -> DataFrame:
    return turns.withColumn("r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))).where(F.col("r") <= n).drop("r")


def running_history(turns: DataFrame, n: int = 6, *, session: str = "session", turn: str = "turn", text: str = "text") -> DataFrame:
    """Each turn with the texts of the last ``n`` turns, itself included."""
    frame = Window.partitionBy(session).orderBy(turn).rowsBetween(-(n - 1), 0)
    return turns.withColumn("window", F.collect_list(text).over(frame))


def kept_sessions(sessions: DataFrame, most: int = 100, *, session: str = "session", first_seen: str = "first_seen") -> DataFrame:
    """The ``most`` sessions that began last."""
    return sessions.orderBy(F.desc(first_seen), F.desc(session)).limit(most)
