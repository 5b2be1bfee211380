"""Session helper, configuration, and tables that cut lineage."""

from __future__ import annotations

import dataclasses
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@dataclasses.dataclass(frozen=True)
class Config:
    """Settings of retrieval, chunking and the graph, with their defaults."""

    top_k: int = 10
    score_threshold: float = 0.35
    max_citations: int = 5
    require_citations: bool = True
    max_retry: int = 1
    chunk_size: int = 800
    chunk_overlap: int = 100
    chunk_max_len: int = 2000
    max_hops: int = 2
    max_seeds: int = 10
    max_neighbors: int = 30
    graph_weight: float = 0.25
    community_max_size: int = 100
    community_seed: int = 42
    ignore_dirs: tuple[str, ...] = (".obsidian", ".git", ".trash")

    def __post_init__(self):
        for name in ("top_k", "max_citations", "chunk_size", "chunk_max_len", "max_neighbors", "max_seeds", "community_max_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 0 <= self.graph_weight <= 1 or not 0 <= self.score_threshold <= 1:
            raise ValueError("graph_weight and score_threshold must be from 0 to 1")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Settings from a mapping; unknown names are an error, and so are secrets."""
        known = {f.name for f in dataclasses.fields(cls)}
        for name in values:
            if any(word in name.lower() for word in ("secret", "api_key", "password", "token")):
                raise ValueError(f"secrets do not belong in settings: {name}")
            if name not in known:
                raise ValueError(f"unknown setting: {name}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def session(app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with adaptive execution; settings given at submission stay."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, as one machine runs
    all of it; on a cluster executors would write where nobody else reads, so that is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str = "step", *, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later failures cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from :func:`written`."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
