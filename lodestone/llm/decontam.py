"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns documents into index segments, one row for a run of
documents: sorted terms, and for each term its postings, the positions of that
word in the segment. Segments hold all words, so a stored index serves any test set,
and are split by document, so building and searching need no shuffle and no key
gathers rows. ``search`` sends a block of test items (of at most ``BLOCK_WORDS``
words, so what is broadcast is bounded; more items make more blocks) to all segments.

In a segment the words of all items are looked up at once, from the segment's terms;
only phrases with all words present go on. Each starts from the postings of its
rarest term and intersects them, shifted by the terms' offsets, with the lists of the
other terms from rare to frequent. A proximity match starts from the rarest term too
and asks the other lists for all words of the phrase in a stretch that is ``slop``
words longer than it, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import LOWER, WORDLIKE, load, runs, segment_keys, segments, trim, written

#: Words in a window; an item of fewer words is one window.
WINDOW = 13
#: Words by which a stretch with all words of a window may be longer than it.
SLOP = 3
#: Test words that are sent to every task at once; further items go in further blocks.
BLOCK_WORDS = 1_000_000

SEGMENT = "segment string, doc_ids array<bigint>, doc_keys array<bigint>, word_offsets array<int>, terms array<bigint>, term_offsets array<int>, postings array<int>"
FOUND = "segment string, row int, doc_id bigint, doc_key bigint, n_words bigint, hits array<int>, items array<string>, near_hits array<int>, near_items array<string>"
_NAMES = ["segment", "doc_ids", "doc_keys", "word_offsets", "terms", "term_offsets", "postings"]
_TYPES = [pa.string(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())]]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term of each word, and the offset of each document's first word."""
    low = LOWER[data]
    starts, ends = segments(WORDLIKE[low], offsets)
    return segment_keys(low, starts, ends).view(np.int64), np.searchsorted(starts, offsets)


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", doc_key: str | None = None) -> DataFrame:
    """Index segments of ``docs``: postings of every word.

    ``doc_key`` names a second column of ids, where rows need more than ``doc_id`` to
    tell them apart. Null texts have no words; null and repeated ids are kept as they
    are, a row each; other columns are not read.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            for rows, data, offsets in runs(batch.column(2)):
                terms, word_offsets = _words(data, offsets)
                order = np.argsort(terms, kind="stable").astype(np.int32)
                distinct, first = np.unique(terms[order], return_index=True)
                columns = [str(uuid.uuid4()), batch.column(0)[rows], batch.column(1)[rows], word_offsets.astype(np.int32), distinct, np.append(first, len(order)).astype(np.int32), order]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
        trim()

    key = F.col(doc_key).cast("bigint") if doc_key else F.lit(None).cast("bigint")
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), key.alias("doc_key"), F.col(text).cast("string").alias("text")).mapInArrow(build, SEGMENT)


class Phrases(NamedTuple):
    """The windows of some test items, as places in the list of all their words."""

    names: list[str]  # of the items
    vocabulary: np.ndarray  # sorted terms of the words
    words: np.ndarray  # of all items, as places in the vocabulary
    first: np.ndarray  # word of each window
    length: np.ndarray
    owner: np.ndarray  # item of each window


def item_windows(item_ids: list, texts: list, window: int = WINDOW) -> Phrases:
    """Windows of the items. Items without an id or without words have none."""
    names, terms, first, length, owner, at = [], [np.zeros(0, np.int64)], [], [], [], 0
    for item, text in zip(item_ids, texts, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        own, _ = _words(data, np.array([0, len(data)]))
        if item is None or not len(own):
            continue
        n = min(window, len(own))
        first.append(at + np.arange(len(own) - n + 1))
        length.append(np.full(len(first[-1]), n))
        owner.append(np.full(len(first[-1]), len(names)))
        names.append(str(item))
        terms.append(own)
        at += len(own)
    vocabulary, words = np.unique(np.concatenate(terms), return_inverse=True)
    first, length, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, length, owner))
    return Phrases(names, vocabulary, words.astype(np.int32), first, length, owner)


class _Segment:
    """The candidates of a segment: windows whose words all occur, their terms' lists ordered from rare to frequent."""

    def __init__(self, phrases: Phrases, terms: np.ndarray, term_offsets: np.ndarray, postings: np.ndarray, doc_of: np.ndarray):
        self.postings, self.doc_of, self.begin = postings, doc_of, term_offsets
        place = np.searchsorted(phrases.vocabulary, terms)
        place[place == len(phrases.vocabulary)] = 0
        known = np.flatnonzero(phrases.vocabulary[place] == terms) if len(phrases.vocabulary) else np.zeros(0, np.int64)
        term_of = np.full(len(phrases.vocabulary), -1)
        term_of[place[known]] = known
        term = term_of[phrases.words]
        present = np.concatenate([[0], np.cumsum(term >= 0)])
        self.window = np.flatnonzero(present[phrases.first + phrases.length] - present[phrases.first] == phrases.length)
        self.length = phrases.length[self.window]
        wide = int(self.length.max()) if len(self.window) else 0
        offset = np.minimum(np.arange(wide), self.length[:, None] - 1)
        grid = term[phrases.first[self.window][:, None] + offset]
        counts = np.where(np.arange(wide) < self.length[:, None], np.diff(term_offsets)[grid], np.iinfo(np.int64).max)
        self.rarity = np.argsort(counts, axis=1, kind="stable")
        self.term = np.take_along_axis(grid, self.rarity, axis=1)
        # the lists of all terms, one behind the other, as one sorted list
        self.listed = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(term_offsets)) << 32 | postings

    def rarest(self) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, position) of each posting of the candidates' rarest terms."""
        rare = self.term[:, 0] if len(self.window) else np.zeros(0, np.int64)
        n = np.diff(self.begin)[rare]
        at = np.repeat(np.arange(len(rare)), n)
        return at, self.postings[np.repeat(self.begin[rare] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def ahead(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first posting of each term at or behind a position; a large number if there is none."""
        found = np.searchsorted(self.listed, term.astype(np.int64) << 32 | np.maximum(position, 0))
        inside = found < self.begin[term + 1]
        return np.where(inside, self.postings[np.where(inside, found, 0)], 1 << 40)

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, first position) of each occurrence inside one document."""
        at, position = self.rarest()
        start = position - self.rarity[at, 0] if len(at) else position
        keep = (start >= 0) & (start + self.length[at] <= len(self.doc_of))
        at, start = at[keep], start[keep]
        for step in range(1, self.rarity.shape[1]):
            asked = step < self.length[at]
            place = start + self.rarity[at, step]
            keep = ~asked | (self.ahead(self.term[at, step], place) == place)
            at, start = at[keep], start[keep]
        keep = self.doc_of[start] == self.doc_of[start + self.length[at] - 1]
        return at[keep], start[keep]

    def near(self, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidate, first, last position) of stretches of at most ``slop`` words more than the phrase that hold all its words."""
        at, position = self.rarest()
        for step in range(1, self.rarity.shape[1]):  # each other word at most so far away
            reach = self.length[at] + slop - 1
            keep = (step >= self.length[at]) | (self.ahead(self.term[at, step], position - reach) <= position + reach)
            at, position = at[keep], position[keep]
        reach = self.length[at] + slop
        start = np.repeat(position - reach + 1, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        at = np.repeat(at, reach)
        both = np.unique(np.column_stack([at, start])[start >= 0], axis=0)
        at, start = both[:, 0], both[:, 1]
        # a stretch begins with a word of the phrase and ends with the last that it needs
        last = np.zeros(len(at), np.int64)
        begins = np.zeros(len(at), bool)
        for step in range(self.rarity.shape[1]):
            asked = step < self.length[at]
            place = self.ahead(self.term[at, step], start)
            begins |= asked & (place == start)
            last = np.where(asked, np.maximum(last, place), last)
            keep = last < start + self.length[at] + slop
            at, start, last, begins = at[keep], start[keep], last[keep], begins[keep]
        at, start, last = at[begins], start[begins], last[begins]
        keep = self.doc_of[start] == self.doc_of[last]
        return at[keep], start[keep], last[keep]


def search(index: DataFrame, phrases: Phrases, *, slop: int | None = None) -> DataFrame:
    """One row per document of the index: ``segment``, ``row``, ``doc_id``, ``doc_key``, ``n_words`` and what was found.

    ``hits`` are the document's word positions inside an occurrence of a phrase and
    ``items`` the ids of the items with occurring phrases, both sorted. ``near_hits``
    and ``near_items`` say the same of proximity matches, exact ones among them; they
    are empty without ``slop``.
    """
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def lists(doc_of: np.ndarray, words: np.ndarray, owner: np.ndarray, names: list[str], first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, pa.Array]:
        step = np.zeros(len(doc_of) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, last + 1, -1)
        hit = np.flatnonzero(np.cumsum(step)[:-1] > 0)
        pairs = np.unique(np.column_stack([doc_of[first], owner]), axis=0)
        hit_at, pair_at = np.searchsorted(hit, words), np.searchsorted(pairs[:, 0], np.arange(len(words)))
        local = hit - np.repeat(words[:-1], np.diff(hit_at))
        items = pa.array([names[i] for i in pairs[:, 1]], pa.string())
        return pa.ListArray.from_arrays(pa.array(hit_at, pa.int32()), pa.array(local, pa.int32())), pa.ListArray.from_arrays(pa.array(pair_at, pa.int32()), items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        none = np.zeros(0, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, keys, words, terms, term_offsets, postings = (batch.column(c)[r].values for c in range(1, 7))
                words, terms, term_offsets, postings = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, terms, term_offsets, postings))
                doc_of = np.repeat(np.arange(len(ids)), np.diff(words))
                part = _Segment(phrases, terms, term_offsets, postings, doc_of)
                at, first = part.exact() if len(part.window) else (none, none)
                exact = lists(doc_of, words, phrases.owner[part.window[at]], phrases.names, first, first + part.length[at] - 1)
                at, first, last = part.near(slop) if slop is not None and len(part.window) else (none, none, none)
                near = lists(doc_of, words, phrases.owner[part.window[at]], phrases.names, first, last)
                head = [pa.array([batch.column(0)[r].as_py()] * len(ids), pa.string()), pa.array(np.arange(len(ids)), pa.int32()), ids, keys, pa.array(np.diff(words), pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *exact, *near], names=["segment", "row", "doc_id", "doc_key", "n_words", "hits", "items", "near_hits", "near_items"])
        trim()

    return index.mapInArrow(find, FOUND)


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list, list]]:
    """The test items in blocks of about ``block_words`` words, read in turn."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(item_id), F.col(text).cast("string")).where(F.col(text).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += 1 + len(row[1]) // 4
        if size >= block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def search_all(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """:func:`search` for all ``items``, block by block: each block's finds are written out before the next is sent."""
    blocks = item_blocks(items, item_id, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    found = search(index, item_windows(*first, window), slop=slop)
    if second is None:
        return found
    found = written(found, "found")
    place = ["segment", "row", "doc_id", "doc_key", "n_words"]
    for block in (second, *blocks):
        more = search(index, item_windows(*block, window), slop=slop)
        found = found.unionByName(written(more.where("size(items) > 0 OR size(near_items) > 0"), "found"))
    # a document has at most one row for each block
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_hits", "near_items")]
    return found.groupBy("segment", "row").agg(*[F.first(c).alias(c) for c in place[2:]], *merged)


def find_contamination(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", doc_key: str | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``doc_key``, ``n_words``, ``hits`` (positions), ``items``, ``near_hits`` and ``near_items``.

    Items without an id or without words have no windows; repeated items count
    once. Empty tables give no rows, or rows without hits.
    """
    index = written(build_index(docs, doc_id=doc_id, text=text, doc_key=doc_key), "postings")
    return search_all(index, items, item_id=item_id, item_text=item_text, window=window, slop=slop, block_words=block_words)


def flagged(found: DataFrame) -> DataFrame:
    """The contamination rule: at least one hit word, and one hit in twenty words. Proximity matches are counted beside it."""
    n_hit = F.size("hits").cast("bigint")
    ids = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "doc_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.size("near_hits").cast("bigint").alias("n_near"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), slop=SLOP)).drop("doc_key")
