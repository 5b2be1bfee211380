"""Several tables that change together: one manifest names the files of all of them."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.streaming.changes import _delete as delete_folder
from lodestone.streaming.changes import _names as names_in

#: Parts of a table; a change rewrites those with a changed key.
BUCKETS = 64


class TableSet:
    """Tables below ``root``, dealt by a hash of a key into buckets of Parquet files.

    :meth:`change` writes the touched buckets of a table anew, beside the old ones;
    :meth:`commit` then writes one manifest with the buckets of all tables, and only
    with it do the changes count, all at once. Work that is lost before leaves the old
    version whole. Files that neither this manifest nor the one before names are
    deleted, so a reader has until the commit after next. One writer at a time: a
    commit over a version that another has written meanwhile is an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.base = self._last()
        self.tables = self._manifest(self.base)
        self.staged = 0

    def _last(self) -> int:
        whole = [int(n) for n in names_in(self.spark, f"{self.root}/versions") if "_SUCCESS" in names_in(self.spark, f"{self.root}/versions/{n}")]
        return max(whole, default=-1)

    def _manifest(self, version: int) -> dict[str, dict]:
        if version < 0:
            return {}
        rows = self.spark.read.schema("name string, body string").parquet(f"{self.root}/versions/{version}").collect()
        out = {r["name"]: json.loads(r["body"]) for r in rows}
        for t in out.values():
            t["files"] = {int(b): p for b, p in t["files"].items()}
        return out

    def read(self, name: str) -> DataFrame | None:
        """The table as it stands with the changes staged here; None if it was never written."""
        t = self.tables.get(name)
        return None if t is None else self._rows(t, t["files"].values())

    def read_buckets(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The rows of the buckets in which ``keys``, one column, fall: all rows with such a key, and others."""
        t = self.tables.get(name)
        if t is None:
            return None
        own = F.pmod(F.xxhash64(keys.columns[0]), F.lit(t["buckets"])).cast("int")
        asked = {r[0] for r in keys.select(own).distinct().collect()}  # at most ``buckets``
        return self._rows(t, [t["files"][b] for b in asked & t["files"].keys()])

    def read_keys(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The table's rows with a key in ``keys``, one column of distinct keys; only their buckets are read."""
        rows, asks = self.read_buckets(name, keys), keys.toDF("asked_key")
        return None if rows is None else rows.join(asks, rows[self.tables[name]["by"]].eqNullSafe(asks["asked_key"]), "left_semi")

    def _rows(self, t: dict, paths) -> DataFrame:
        schema, paths = StructType.fromJson(t["schema"]), sorted(paths)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def change(self, name: str, fresh: DataFrame, *, by: str, gone: DataFrame | None = None, alike: bool = False, buckets: int = BUCKETS) -> None:
        """Put ``fresh`` in place of all rows with a key of its own or of ``gone``, a column of keys.

        With ``alike`` only the rows of ``gone`` go, those that are alike in all columns. Null keys are a key. Columns are those of the first write; ``fresh`` should be
        cheap to read twice.
        """
        t = self.tables.get(name) or {"schema": fresh.schema.jsonValue(), "buckets": buckets, "by": by, "files": {}}
        if t["by"] != by:
            raise ValueError(f"{name}: keyed by {t['by']}, not by {by}")
        names = StructType.fromJson(t["schema"]).names
        own = F.pmod(F.xxhash64(by), F.lit(t["buckets"])).cast("int")
        keys = fresh.select(by) if gone is None else fresh.select(by).unionByName(gone.select(by))
        touched = {r[0] for r in keys.select(own).distinct().collect()}  # at most ``buckets``
        if not touched:
            self.tables[name] = t
            return
        paths = [t["files"][b] for b in touched & t["files"].keys()]
        rows = fresh.select(*names)
        if paths:
            on = names if alike else [by]
            drop = (gone.select(*on) if alike else keys.distinct()).withColumnsRenamed({c: f"gone_{c}" for c in on})
            old = self._rows(t, paths)
            same = functools.reduce(Column.__and__, [old[c].eqNullSafe(drop[f"gone_{c}"]) for c in on])
            rows = old.join(drop, same, "left_anti").select(*names).unionByName(rows)
        folder = f"data/{name}-{uuid.uuid4().hex}"
        # a rebalance splits a bucket that a hot key makes too large for one task
        rows.withColumn("bucket", own).hint("rebalance", F.col("bucket")).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        made = {int(n.split("=")[1]) for n in names_in(self.spark, f"{self.root}/{folder}") if n.startswith("bucket=")}
        files = {b: p for b, p in t["files"].items() if b not in touched} | {b: f"{folder}/bucket={b}" for b in made}
        self.tables[name] = t | {"files": files}
        self.staged += 1

    def commit(self) -> int:
        """Make all changes since the last commit count at once; the new version's number."""
        version = self.base + 1
        if self._last() != self.base:
            raise RuntimeError(f"{self.root}: version {self._last()} was written meanwhile")
        rows = [(n, json.dumps(t)) for n, t in self.tables.items()]
        self.spark.createDataFrame(rows, "name string, body string").coalesce(1).write.parquet(f"{self.root}/versions/{version}")
        if version >= 2:
            paths = lambda tables: {p for t in tables.values() for p in t["files"].values()}
            for p in paths(self._manifest(version - 2)) - paths(self._manifest(version - 1)) - paths(self.tables):
                delete_folder(self.spark, f"{self.root}/{p}")
            delete_folder(self.spark, f"{self.root}/versions/{version - 2}")
        self.base, self.staged = version, 0
        return version
