"""Readers: Markdown vaults, JSON lines, CSV, archives and line corpora."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lodestone.functions import text as T


def frontmatter_lists(body: str | None) -> dict[str, list[str]]:
    """``tags`` and ``aliases`` of a frontmatter: lists, inline lists, comma texts or scalars; broken ones count as none."""
    out: dict[str, list[str]] = {"tags": [], "aliases": []}
    key = None
    for line in (body or "").splitlines():
        if line[:1].isalpha() and ":" in line:
            key, _, value = line.partition(":")
            key, value = key.strip(), value.strip()
            if key in out and value:
                value = value[1:-1] if value.startswith("[") and value.endswith("]") else value
                parts = value.split(",") if key == "tags" or "," in value else [value]
                out[key] += [p.strip().strip("\"'") for p in parts if p.strip().strip("\"'")]
        elif key in out and line.lstrip().startswith("- "):
            out[key].append(line.lstrip()[2:].strip().strip("\"'"))
    return out


@F.pandas_udf(StructType().add("tags", ArrayType(StringType())).add("aliases", ArrayType(StringType())))
def _front(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([frontmatter_lists(b) for b in body], columns=["tags", "aliases"])


def read_vault(spark: SparkSession, path: str, ignore_dirs: tuple[str, ...] = (".obsidian", ".git", ".trash")) -> DataFrame:
    """Notes below ``path``: ``source, filename, folder, mtime, tags, aliases, links, content``.

    Only ``.md`` files outside ignored folders; files that are not UTF-8 are left
    out. Frontmatter is taken off; its tags and the text's ``#tags`` make ``tags``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    place = T.url_decoded(F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", ""))
    relative = F.substring_index(place, root, -1)
    parts = F.split(relative, "/")
    rows = files.withColumn("source", relative).where(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in ignore_dirs])) & F.is_valid_utf8(F.col("content").cast("string")))
    body = T.strip(F.col("content").cast("string"))
    rows = rows.select("source", "modificationTime", body.alias("raw"))
    pieces = F.split(F.col("raw"), "---", 3)
    front = F.col("raw").startswith("---") & (F.size(pieces) == 3)
    rows = rows.select("source", "modificationTime", F.when(front, pieces[1]).alias("front"), F.when(front, T.strip(pieces[2])).otherwise(F.col("raw")).alias("content"))
    rows = rows.withColumn("f", _front(F.col("front")))
    return rows.select(
        "source",
        T.stem(F.col("source")).alias("filename"),
        T.parent_dir(F.col("source")).alias("folder"),
        F.date_format(F.col("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("mtime"),
        F.array_distinct(F.concat("f.tags", T.inline_tags(F.col("content")))).alias("tags"),
        "f.aliases",
        F.transform(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.substring_index(x, "|", 1)).alias("links"),
        "content",
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped and broken ones give nulls."""
    return spark.read.schema(schema).json(path)


def read_json_tasks(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(``task``, ``item``) of one JSON object that maps tasks to lists."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, array<{item}>>")).alias("task", "items")).select("task", F.explode("items").alias("item"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; a byte-order mark is no part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_line_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document a line; empty lines are left out."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("text")).where("text <> ''")


def _members(data: bytes) -> Iterator[tuple[str, str]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                if not name.endswith("/"):
                    yield name, z.read(name).decode("utf-8", "replace")
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read().decode("utf-8", "replace")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(``archive``, ``name``, ``text``) of the files in zip and tar archives; an archive is read by one task, file by file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for place, data in zip(f["path"], f["content"], strict=True):
                for name, text in _members(data):
                    yield pd.DataFrame([(place, name, text)], columns=["archive", "name", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, text string")


def joined_parts(members: DataFrame) -> DataFrame:
    """Files named ``x-part2.txt`` put together in the order of their numbers: (``name``, ``text``)."""
    base, part = F.regexp_replace("name", r"-part\d+(?=\.[^.]*$)", ""), F.coalesce(F.regexp_extract("name", r"-part(\d+)\.[^.]*$", 1).try_cast("int"), F.lit(0))
    listed = F.array_sort(F.collect_list(F.struct(part.alias("p"), "name", "text")))
    return members.groupBy(base.alias("base")).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text")).withColumnRenamed("base", "name")
