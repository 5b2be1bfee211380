"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A text's features are its token unigrams and bigrams, hashed to ``SIZE`` slots;
tokens are runs of letters and digits and runs of other visible characters, with
A-Z lower-cased, plus a mark for words in capitals. A feature's value is the square
root of its count, and a text's values have unit length, so a score is one sparse
dot product. The follow-the-regularised-leader learner keeps per-slot sums and
gets exact zeros for weights that do not pay their way (L1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import LOWER, NOT_SPACE, WORDLIKE, load, mixed, plain_names, runs, segment_hashes, segments, table_of, trim

#: Slots of the hashed features.
SIZE = 1 << 18
#: Labelled texts that training uses at most, chosen by a hash of the id; all if fewer.
SAMPLE = 3_000
EPOCHS = 3

_CAPITALS = table_of((0x41, 0x5A))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, offsets) of a run of texts."""
    n = len(offsets) - 1
    low = LOWER[data]
    word, other = WORDLIKE[low], NOT_SPACE[data] & ~WORDLIKE[low]
    starts, ends, kind = [], [], []
    for k, mask in enumerate((word, other)):
        s, e = segments(mask, offsets)
        starts.append(s)
        ends.append(e)
        kind.append(np.full(len(s), k))
    starts, ends, kind = np.concatenate(starts), np.concatenate(ends), np.concatenate(kind)
    order = np.argsort(starts, kind="stable")
    starts, ends, kind = starts[order], ends[order], kind[order]
    token = segment_hashes(low, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    capitals = np.concatenate([[0], np.cumsum(_CAPITALS[data])])
    shout = np.flatnonzero(capitals[ends] - capitals[starts] >= 2)
    same = pair[token[1:][pair] == token[:-1][pair]]
    keys = np.concatenate([token, mixed(token[pair] * np.uint64(3) + token[pair + 1]), np.full(len(shout), 11, np.uint64), np.full(len(same), 13, np.uint64)])
    docs = np.concatenate([doc, doc[pair], doc[shout], doc[same]])
    both, counts = np.unique(docs.astype(np.uint64) * np.uint64(SIZE) + mixed(keys) % np.uint64(SIZE), return_counts=True)
    docs, slots = (both // np.uint64(SIZE)).astype(np.int64), (both % np.uint64(SIZE)).astype(np.int64)
    norms = np.sqrt(np.bincount(docs, weights=counts, minlength=n))
    return slots, np.sqrt(counts) / norms[docs], np.searchsorted(docs, np.arange(n + 1))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal over (slots, values, label) rows in turn; the last weight is the bias."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            slots, values, label = rows[k]
            at, x = np.append(slots, SIZE), np.append(values, 1.0)
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    return weights(np.arange(SIZE + 1))


def labelled_rows(docs: DataFrame, labels: DataFrame, *, label: str, sample: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of at most ``sample`` labelled rows, in the order of a hash of their ids.

    Only the chosen rows' features reach the driver, at most ``SIZE`` slots each.
    Rows with a null id or label are left out. Of repeated ids the least label counts
    and the text with the least hash, so that the order of the rows changes nothing.
    """
    chosen = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("id"), F.lit(9)), "id").limit(sample)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch.column(2)):
                slots, values, ends = features(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (slots.astype(np.int32), values.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], *lists], names=["id", "label", "slots", "values"])

    joined = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    joined = joined.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("id", "label", "one.text")
    table = joined.mapInArrow(featurise, "id bigint, label int, slots array<int>, values array<float>").toArrow()
    table = table.sort_by([("id", "ascending")])
    slots, values = (table.column(c).combine_chunks() for c in ("slots", "values"))
    return [(slots[k].values.to_numpy(), values[k].values.to_numpy(), int(y)) for k, y in enumerate(table.column("label").to_pylist())]  # views, not copies


def held_out(doc_id="doc_id"):
    """Rows never learnt from: crc32 of the id as text, modulo 3, is 1. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from labelled rows that are not held out."""
    weights = train(labelled_rows(docs, labels.where(~held_out()), label=label, sample=sample))
    trim()
    return weights


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out`` (0 to 1), which replaces one of its name. Null and empty texts score by the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    plain = plain_names(docs)
    names = dict(zip(docs.columns, plain.columns, strict=True))
    keep = [c for name, c in names.items() if name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            parts = [np.zeros(0)]
            for _, data, offsets in runs(batch.column(len(keep))):
                slots, values, ends = features(data, offsets)
                sums = np.concatenate([[0.0], np.cumsum(w[slots] * values)])
                parts.append(1 / (1 + np.exp(-np.clip(np.diff(sums[ends]) + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(parts))], names=[*keep, "score"])

    chosen = plain.select(*keep, F.col(names[text]).cast("string").alias("text"))
    scored = chosen.mapInArrow(run, chosen.drop("text").schema.add("score", "double"))
    return scored.select(*[F.col(c).alias(name) for name, c in names.items() if name != out], F.col("score").alias(out))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, load(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
