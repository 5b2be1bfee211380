"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised, closed with an end token and cut into pieces of at most
``capacity`` tokens. Which pieces share a sequence depends on their lengths only,
so the corpus enters the search as a histogram of at most ``capacity`` lengths. Per
bin, the longest length that is left is fixed, and a subset-sum over bitsets finds
the fullest combination of the others that fits; it is then removed, as often as
its lengths are there. Each removal takes at least half of what is left of some
length, so there are at most ``capacity * log2(pieces)`` combinations however large
the corpus is. Pieces then find their place by their number among the pieces of
their length, which is arithmetic on a row.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import tokenizer_path
from lodestone.llm.shared import load, trim, written

#: Tokens of a sequence, and the token that ends a document.
CAPACITY, END_ID = 2048, 0
#: Words of which a worker keeps the ids, in each of two generations, and the longest of them.
KEPT_WORDS, KEPT_CHARS = 150_000, 48
#: ``str.split`` takes these for spaces; the tokenizer does not.
_NOT_SPACES = re.compile(r"[\x1c-\x1f]")
_SPACES = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Texts in letters that stay as they are under NFC and have one small letter each, and the tokenizer's words of them.
LATIN = re.compile(r"[\x00-įı-ſ]*")
_L, _N, _S = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class SpacedTokenizer:
    """Token ids of texts by a tokenizer that drops white space, so that what stands between spaces is encoded alone.

    Texts of Latin letters are split into words here, and the library's model gets
    each distinct word once, many at a time. Of all other texts the library encodes
    what stands between spaces, frequent pieces once.
    """

    #: What the files for this class say of themselves; fixed values.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    END = "</w>"
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        split, level = [*before.get("pretokenizers", []), {}, {}][:2]
        known = {"normalizer": {"type": "Sequence", "normalizers": self.NORMALIZERS}, "post_processor": None}
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain = all(not model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if {k: spec[k] for k in known} != known or split.get("pattern") != {"Regex": self.WORDS} or level != byte_level or model["end_of_word_suffix"] != self.END or not plain:
            raise ValueError(f"{path}: not a tokenizer of lower-case words with end marks")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # for words split already, between single spaces
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for k, i in model["vocab"].items() if k.endswith(self.END)]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        # by whether they are words of Latin texts or pieces between spaces; those of late, and those before
        self.words: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
        self.older: dict[bool, dict[str, bytes]] = {True: {}, False: {}}

    def _encoded(self, words: list[str], latin: bool) -> Iterator[bytes]:
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            if not latin:
                yield from (np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(part, add_special_tokens=False))
                continue
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            assert len(stops) == len(part)
            data = ids.tobytes()
            yield from (data[a:b] for a, b in zip([0, *stops], stops, strict=False))

    def _know(self, need: set[str], latin: bool) -> list[str]:
        """Have ids for ``need``; returns words too long to be kept."""
        if len(self.words[latin]) > KEPT_WORDS:
            self.older[latin], self.words[latin] = self.words[latin], {}
        words, older = self.words[latin], self.older[latin]
        need.difference_update(words)
        for w in need & older.keys():
            words[w] = older[w]
        new = list(need.difference(words))
        words.update(zip(new, self._encoded(new, latin), strict=True))
        return [w for w in new if len(w) > KEPT_CHARS]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        split = []
        for t in texts:
            t = t or ""
            latin = LATIN.fullmatch(t) is not None and not any(x in t for x in self.special)
            split.append((latin, LATIN_WORDS.findall(t.lower()) if latin else _SPACES.split(t) if _NOT_SPACES.search(t) else t.split()))
        get, long = {}, {}
        for kind in (True, False):
            long[kind] = self._know(set().union(*[words for latin, words in split if latin == kind]), kind)
            get[kind] = self.words[kind].__getitem__
        out = [b"".join(map(get[latin], words)) for latin, words in split]
        for kind, words in long.items():
            for w in words:
                del self.words[kind][w]
        return out


_tokenizers: dict[str, SpacedTokenizer] = {}


def cut_pieces(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, rows: int = 256) -> DataFrame:
    """The pieces of each document: ``doc_id, piece, start, length, ids_crc32, ids, part, nth``; written.

    ``ids`` are packed little-endian unsigned 32-bit integers, ``ids_crc32`` their
    checksum. A document is its ids and ``end_id``; null and empty texts are one
    piece of that token alone. Longer documents are cut into pieces of ``capacity``,
    the last of which may be shorter. Every row is a document, repeated rows and null
    ids too. ``nth`` numbers the pieces of a length from 0 within ``part``, the task
    that made them. Other columns are left out.
    """
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if path not in _tokenizers:
            _tokenizers[path] = SpacedTokenizer(path)
        seen = np.zeros(capacity + 1, np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                coded = [x + end for x in _tokenizers[path].encode(piece.column(1).to_pylist())]
                many = [-(-len(x) // width) for x in coded]
                cut = [x[s : s + width] for x in coded for s in range(0, len(x), width)]
                lengths = np.array([len(x) // 4 for x in cut], np.int64)
                order = np.argsort(lengths, kind="stable")
                same = lengths[order]
                first = np.searchsorted(same, same)
                nth = np.empty(len(cut), np.int64)
                nth[order] = seen[same] + np.arange(len(cut)) - first
                seen += np.bincount(lengths, minlength=capacity + 1)
                number = np.concatenate([np.arange(n) for n in many]) if many else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))),
                        pa.array(number, pa.int32()),
                        pa.array(number * capacity, pa.int64()),
                        pa.array(lengths),
                        pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                        pa.array(cut, pa.binary()),
                        pa.array(np.full(len(cut), part), pa.int64()),
                        pa.array(nth),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"],
                )
        trim()

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    made = chosen.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part bigint, nth bigint")
    return written(made, "pieces")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations of lengths that use up ``counts``: (times, [(length, copies), ...]), longest lengths first.

    Each is the fullest that the lengths left allow beside the longest of them; of
    equally full ones the one of longer lengths, so that short ones stay to fill
    later bins.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    lengths = sorted(left, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        room = capacity - longest
        bits, mask, full = 1, (1 << room + 1) - 1, 1 << room
        steps = []  # (length, copies, sums reachable before)
        for n in lengths:
            if bits & full:
                break
            many = min(left[n] - (n == longest), room // n)
            copies = 1
            while many > 0:
                take = min(copies, many)
                steps.append((n, take, bits))
                bits |= bits << n * take & mask
                many -= take
                copies *= 2
        best = bits.bit_length() - 1
        used = {longest: 1}
        for n, take, before in reversed(steps):
            if not before >> best & 1:
                best -= n * take
                used[n] = used.get(n, 0) + take
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        lengths = [n for n in lengths if left[n]]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


class Places:
    """Where the k-th piece of a length goes under a plan."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        rows, given, base = [], {}, 0
        for times, used in plan:
            offset = 0
            for n, k in used:
                at = given.get(n, 0)
                rows.append((n << 44 | at, at, base, k, offset))
                given[n] = at + times * k
                offset += n * k
            base += times
        rows.sort()
        self.key, self.first, self.base, self.copies, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.n_bins = base

    def of(self, length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the k-th piece of each length."""
        at = np.searchsorted(self.key, (length << 44) | k, "right") - 1
        inside, copies = k - self.first[at], self.copies[at]
        return self.base[at] + inside // copies, self.offset[at] + inside % copies * length


def place(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of :func:`cut_pieces` with ``sequence_id`` and ``offset`` in place of ``part`` and ``nth``.

    Other columns pass through; leave ``ids`` out where they are not needed, so that
    they are not shuffled. The plan is made from the histogram of all lengths and
    goes to the tasks as arrays of at most ``capacity * log2(pieces)`` combinations.
    An empty table gives no rows.
    """
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    every = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan_bins(every, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    keep = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = pieces.join(starts, ["part", "length"]).select(*keep, (F.col("before") + F.col("nth")).alias("nth"))
    at = keep.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, len(keep)))
            sequence, offset = places.value.of(length, k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ranked.drop("nth").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(``sequence_id``, ``n_tokens``, ``ids``, ``doc_ids``, ``starts``): the training sequences, pieces put together in order.

    ``placed`` must have ``ids``. A group has at most ``capacity`` tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    groups = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, x: s + x["length"])
    return groups.select("sequence_id", total.alias("n_tokens"), joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))


def least_bins(lengths: Iterable[int], capacity: int) -> int:
    """No packing has fewer bins than this: all tokens divided by the capacity, or the pieces over half of it."""
    lengths = list(lengths)
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def op13_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    pieces = cut_pieces(load(spark, sf_dir, "documents"), path or tokenizer_path("word_bpe_49k.json"))
    placed = place(pieces.drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
