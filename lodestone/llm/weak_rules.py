"""Quality rules combined by weak supervision.

Each rule looks at a measure of its own (only ``symbols`` counts what ``marks`` counts
too) and votes good (1), bad (-1) or doubtful (2), or abstains (0) where a text is too
short for it.
Expectation-maximisation estimates, from the votes alone, the share of good documents
and how each rule votes on good and on bad ones. A document is kept where the
posterior probability of being good is at least a threshold: one bad vote of a rule
that errs does not drop it, and doubts of several rules may. There are at most
4 ** len(RULES) vote patterns, so the corpus enters the estimate as a count for each
pattern, over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import NOT_SPACE, load, mixed, runs, segment_keys, segments, table_of, written

SYMBOLS = table_of(*[(b, b) for b in b"#*$%&|<>"])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_marks", "n_distinct"]
_UPPER = table_of((0x41, 0x5A))
#: ASCII punctuation, symbols included.
_MARKS = table_of((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _later_copies(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True for each entry equal to an earlier one of its document."""
    order = np.lexsort((key, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(order), bool)
    out[order] = same
    return out


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text of a column; null and empty texts count zero."""
    parts = []
    for _, data, offsets in runs(column):
        n = len(offsets) - 1
        per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])  # noqa: E731,B023
        inside = NOT_SPACE[data]
        starts, ends = segments(inside, offsets)
        first = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(n), np.diff(first))
        words = segment_keys(data, starts, ends)
        # windows of three words that occur twice or more in their document
        repeated = np.zeros(len(words), bool)
        if len(words) >= 3:
            at = np.flatnonzero(doc[2:] == doc[:-2])
            a, b, c = words[at], words[at + 1], words[at + 2]
            key = mixed(mixed(mixed(a) + b) + c)
            order = np.lexsort((key, doc[at]))
            same = (doc[at][order][1:] == doc[at][order][:-1]) & (key[order][1:] == key[order][:-1])
            twice = np.zeros(len(order), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for step in range(3):
                repeated[at[twice] + step] = True
        line_starts, line_ends = segments(data != 0x0A, offsets)
        with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[with_word], line_ends[with_word]
        line_first = np.searchsorted(line_starts, offsets)
        line_doc = np.repeat(np.arange(n), np.diff(line_first))
        again = _later_copies(line_doc, segment_keys(data, line_starts, line_ends))
        parts.append(
            np.column_stack(
                [
                    np.diff(first),
                    per_doc(inside & ((data & 0xC0) != 0x80)),
                    per_doc(SYMBOLS[data]),
                    np.bincount(line_doc[again], minlength=n),
                    np.bincount(doc[repeated], minlength=n),
                    per_doc(_UPPER[data]),
                    np.diff(line_first),
                    per_doc(_MARKS[data]),
                    np.bincount(doc[~_later_copies(doc, words)], minlength=n),
                ]
            ).astype(np.int64)
        )
    table = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
    return dict(zip(COUNTS, table.T, strict=True))


def with_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the COUNTS of each row's whole text; rows stay as they are, repeated ones too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[c]) for c in COUNTS]], names=["doc_id", *COUNTS])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(count, schema)


BAD, ABSTAIN, GOOD, DOUBTFUL = -1, 0, 1, 2
#: Shares of fewer words than these say little: but for length and symbols, rules abstain.
FEW_WORDS = 30


def _vote(bad, good):
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(DOUBTFUL)).cast("tinyint")


def votes() -> dict:
    """Column of each rule's vote over the COUNTS."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    symbols, marks, upper = F.col("n_symbols"), F.col("n_marks"), F.col("n_upper")
    again, repeats, distinct = F.col("n_dup_lines"), F.col("n_repeat_words"), F.col("n_distinct")
    asked = n >= FEW_WORDS
    rate = lambda bad, good: F.when(asked, _vote(bad, good)).otherwise(F.lit(ABSTAIN)).cast("tinyint")
    return {
        "length": _vote(n < 10, n >= 50),
        "word_size": rate((10 * chars > 63 * n) | (chars < 4 * n), (10 * chars <= 58 * n) & (10 * chars >= 45 * n)),
        "symbols": F.when(10 * symbols > n, F.lit(BAD)).otherwise(rate(F.lit(False), 50 * symbols <= n)).cast("tinyint"),
        "marks": rate(10 * marks > 3 * n, 5 * marks <= n),
        "capitals": rate(10 * upper > chars, 25 * upper <= chars),
        "dup_lines": rate((again >= 2) & (5 * again > lines), 20 * again <= lines),
        "repeats": rate(10 * repeats > 3 * n, 20 * repeats <= n),
        "variety": rate(10 * distinct < 3 * n, 2 * distinct >= n),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of being good for each vote pattern, by expectation-maximisation; each rule's rates on good and on bad.

    For each class a rule has the rates of its bad, doubtful and good votes, among
    its votes; an abstention says nothing. A pattern starts with the share of good
    among its good and bad votes, and one good vote more, so without a bad vote in the
    corpus all are good. One document more in each class, and one more vote of each
    kind, keep the rates off zero; nothing else holds them.
    """
    kinds = [patterns == k for k in (BAD, DOUBTFUL, GOOD)]
    good = 1.0 + kinds[2].sum(axis=1)
    posterior = good / (good + kinds[0].sum(axis=1))
    rates = lambda w: (lambda t: t / t.sum(axis=0))(np.array([w @ k for k in kinds]) + 1.0)
    on_good = on_bad = rates(counts * 0.0)
    for _ in range(rounds):
        w_good, w_bad = counts * posterior, counts * (1 - posterior)
        on_good, on_bad = rates(w_good), rates(w_bad)
        prior = (w_good.sum() + 1.0) / (counts.sum() + 2.0)
        odds = np.log(prior / (1 - prior)) + sum(k @ np.log(g / b) for k, g, b in zip(kinds, on_good, on_bad, strict=True))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return posterior, on_good, on_bad


def judge(counts: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Add ``quality`` (posterior), ``good`` and ``any_bad`` (a rule voted bad) to rows that have the COUNTS.

    ``counts`` should be cheap to read twice. Empty tables and texts work: a text
    without words gets the bad votes that its counts call for.
    """
    rules = votes()
    voted = counts.withColumns({f"v_{k}": v for k, v in rules.items()})
    names = [f"v_{k}" for k in rules]
    seen = voted.groupBy(*names).count().collect()  # at most 4 ** len(rules) rows
    patterns = np.array([[r[n] for n in names] for r in seen], np.int8).reshape(-1, len(names))
    posterior, _, _ = fit_votes(patterns, np.array([r["count"] for r in seen], float))
    spark = counts.sparkSession
    schema = ", ".join(f"{n} tinyint" for n in names) + ", quality double, any_bad boolean"
    table = spark.createDataFrame([(*map(int, p), float(q), bool((p == BAD).any())) for p, q in zip(patterns, posterior, strict=True)], schema)
    return voted.join(F.broadcast(table), names).withColumn("good", F.col("quality") >= threshold).drop(*names)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(written(with_counts(load(spark, sf_dir, "documents")), "counts"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality", "any_bad")
