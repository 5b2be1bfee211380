"""Byte-level BPE by a traversal that shares prefixes.

For merge-rank BPE the encoding of a prefix is decided by its last token: the
last token of a prefix p is the longest vocabulary entry t that ends p such that
t stays apart from the last token of p without t. The distinct words of a batch,
in sorted order, are the leaves of a trie in depth-first order; walking them with
a stack of last tokens computes each shared prefix once. A word's ids are then
read backwards from its last token.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import load, plain_names, trim

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Scripts where all Unicode versions in use agree on letters, numbers and spaces.
SETTLED = regex.compile(r"[\x00-՗ -⁯←-⋿ぁ-ゖ゠-ヿ一-鿯가-힣！-ﾟ]*")
#: The same pattern with its classes written out, for texts in Latin script only.
LATIN = re.compile(r"[\x00-ɏ]*")
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words in each of the two generations that a worker keeps between batches.
KEPT_WORDS = 120_000
#: Pairs of tokens whose test a worker keeps, and steps between states.
KEPT_PAIRS = 300_000
KEPT_STEPS = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies use for each byte, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Encodes and decodes with a tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, model = _byte_letters(), spec["model"]
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {to_bytes(k): v for k, v in model["vocab"].items()}
        self.bytes_of = {v: k for k, v in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {v: k.encode() for k, v in self.special.items()}
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.merge, self.parts = {}, {}
        for rank, (a, b) in enumerate(pairs):
            left, right = self.ids[to_bytes(a)], self.ids[to_bytes(b)]
            made = self.ids[to_bytes(a) + to_bytes(b)]
            self.merge[left, right] = (rank, made)
            self.parts.setdefault(made, (left, right, rank))
        self.apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # suffixes that can still grow into a token, as states; of each the tokens that end it, longest first
        self.prefixes = {k[:n] for k in self.ids for n in range(len(k) + 1)}
        self.states: dict[bytes, int] = {b"": 0}
        self.names: list[bytes] = [b""]
        self.ending: list[list[tuple[int, int]]] = [[]]
        self.goes: dict[int, int] = {}
        size = max(self.bytes_of) + 1
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._library = None
        self._path = path

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just these two tokens.

        Undoes the merges of both tokens, latest first, and looks each time for a
        merge across the seam that would have come before the one undone.
        """
        a, b, before = left, right, (1 << 30, 1)
        parts, merge = self.parts, self.merge
        while True:
            across = merge.get((a, b))
            if across is not None and (across[0], 0) < before:
                ok = False
                break
            rank_a = parts[a][2] if a in parts else -1
            rank_b = parts[b][2] if b in parts else -1
            if rank_a < 0 and rank_b < 0:
                ok = True
                break
            if rank_a > rank_b:
                # of equal ranks the left one is merged first, so a seam merge of this rank would be too late
                a, before = parts[a][1], (rank_a, 0)
            else:
                b, before = parts[b][0], (rank_b, 1)
        self.apart[left << 32 | right] = ok
        return ok

    def _merged(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: lowest rank first, leftmost of equals."""
        out = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            rank, at = min((self.merge.get(pair, (1 << 30, 0))[0], i) for i, pair in enumerate(zip(out, out[1:], strict=False)))
            if rank == 1 << 30:
                break
            out[at : at + 2] = [self.merge[out[at], out[at + 1]][1]]
        return out

    def _go(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        name = self.names[state] + bytes([byte])
        while name not in self.prefixes:
            name = name[1:]
        to = self.states.get(name)
        if to is None:
            to = self.states[name] = len(self.names)
            self.names.append(name)
            ends = [(self.ids[name[i:]], len(name) - i) for i in range(len(name)) if name[i:] in self.ids]
            self.ending.append([(t, n) for t, n in ends if self._merged(name[len(name) - n :]) == [t]])
        self.goes[state << 8 | byte] = to
        return to

    def encode_words(self, words: set[str]) -> None:
        """Add the ids of distinct words to ``self.words``, walking their trie depth first."""
        last: list[int] = [-1]  # last[i]: last token of the current path's first i bytes
        at: list[int] = [0]  # and the state there
        path = b""
        apart, goes, ending, lengths, done = self.apart, self.goes, self.ending, self.lengths.tolist(), self.words
        for data, word in sorted([(w.encode(), w) for w in words]):
            shared, most = 0, min(len(path), len(data))
            while shared < most and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :], at[shared + 1 :]
            state = at[shared]
            for end, byte in enumerate(data[shared:], shared + 1):
                state = goes.get(state << 8 | byte) or self._go(state, byte)
                at.append(state)
                for token, n in ending[state]:
                    before = last[end - n]
                    if before < 0:
                        break
                    ok = apart.get(before << 32 | token)
                    if ok or ok is None and self._stays_apart(before, token):
                        break
                last.append(token)
            path = data
            found, end = [], len(data)
            while end:
                token = last[end]
                found.append(token)
                end -= lengths[token]
            found.reverse()
            done[word] = struct.pack(f"<{len(found)}I", *found)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's words of a text without special tokens."""
        if LATIN.fullmatch(text):
            return LATIN_PATTERN.findall(text)
        if SETTLED.fullmatch(text):
            return PATTERN.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        cut = []
        for text in texts:
            parts: list = []
            at = 0
            for m in self.split.finditer(text or "") if self.split and "<|" in (text or "") else ():
                parts += [self.pieces(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            cut.append([*parts, self.pieces((text or "")[at:])])
        need = set()
        for parts in cut:
            for p in parts:
                if not isinstance(p, int):
                    need.update(p)
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        if len(self.goes) > KEPT_STEPS:
            self.goes.clear()
        words, older = self.words, self.older
        need.difference_update(words)
        for w in need & older.keys():
            words[w] = older[w]
        self.encode_words(need.difference(words))
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(words.__getitem__, p)) for p in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; broken UTF-8 is replaced."""
        tokens = np.frombuffer(ids, "<u4")
        n = self.lengths[tokens]
        shift = self.starts[tokens] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(n.sum())].tobytes().decode("utf-8", "replace")


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def bpe_encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None, rows: int = 256) -> DataFrame:
    """Columns ``keep`` (default: all) and ``ids``, each text's token ids as packed binary.

    With ``decoded`` also a column of that name with the ids decoded, in the same pass.

    Null counts as empty and gives no ids; rows are independent, so repeated rows
    and ids do no harm. ``rows`` texts share a trie.
    """
    more = [decoded] if decoded else []
    plain = plain_names(docs)
    names = dict(zip(docs.columns, plain.columns, strict=True))
    names_kept = [c for c in (keep if keep is not None else docs.columns) if c not in (ids, *more)]
    keep = [names[c] for c in names_kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                coded = enc.encode(part.column(len(keep)).to_pylist())
                columns = [pa.array(coded, pa.binary())]
                if decoded:
                    columns.append(pa.array([enc.decode(x) for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=[*keep, "ids", *(["decoded"] if decoded else [])])
        trim()

    chosen = plain.select(*keep, F.col(names[text]).cast("string").alias("text"))
    schema = chosen.drop("text").schema.add("ids", "binary")
    if decoded:
        schema = schema.add("decoded", "string")
    coded = chosen.mapInArrow(run, schema)
    return coded.select(*[F.col(c).alias(name) for name, c in zip(names_kept, keep, strict=True)], F.col("ids").alias(ids), *[F.col("decoded").alias(name) for name in more])


def bpe_decode(coded: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the decoded ids; null ids give null."""
    keep = [c for c in coded.columns if c != text]
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                decoded = [None if x is None else enc.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.string())], names=[*keep, text])
        trim()

    return coded.select(*keep).mapInArrow(run, coded.select(*keep).schema.add(text, "string"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path()
    docs = load(spark, sf_dir, "documents")
    both = bpe_encode(docs, path, keep=["doc_id"], decoded="decoded")
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
