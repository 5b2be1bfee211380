"""The prefix trie, the repair of conversations and the packing of sequences, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from compare import rows as as_rows
from compare import tables
from pyspark.sql import functions as F

from lodestone.llm import chat, packing, prefix_trie, shared, turn_repair
from lodestone.llm.bpe import tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
#: Names that the operators use themselves.
EXTRA = ["pos", "digest", "chars", "rep", "node", "depth", "n", "h", "base", "range", "nth", "held", "hit", "copy", "conv", "letter", "audit", "cost", "said", "kind", "weight", "length", "part", "piece", "ids"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crowded(df):
    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(EXTRA)})


def conversations(n=60, seed=1):
    """Few words, so that many conversations begin alike; nulls, ties, repeated rows and repeated conversations."""
    rng = random.Random(seed)
    out = []
    for c in range(n):
        conv = rng.choice([c, c, c + 100, 3, 107, -5])
        for t in range(rng.randint(0, 6)):
            turn = rng.choice([t, t, t, None, 1])
            out.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b?", "no stop", "", " \n", None, "é\U0001f600!"])))
    return out


def by_conversation(rows, null):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, null if r is None else r, null if x is None else x))
    key = lambda v: (*v[:2], v[2].encode(), v[3].encode())
    return {c: sorted(v, key=key) for c, v in convs.items()}


# ---- 11 -----------------------------------------------------------------------------------


def trie(rows):
    own = {c: [v[2:] for v in t] for c, t in by_conversation(rows, "").items() if c is not None}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for k, who in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ends = sorted(c for c in who if len(convs[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), sum(len(x) == len(k) + 1 for x in below), sum(map(leaf, below)), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tried(df):
    turns, convs = prefix_trie.rebuilt_turns(prefix_trie.turn_rows(df))
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, convs).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)  # frequent turns and copies take the other way round
    monkeypatch.setattr(shared, "HOT_KEYS", 1000)
    monkeypatch.setattr(prefix_trie, "CHAIN_BLOCK", 2)
    rows = conversations(80, seed) + [(None, 0, "user", "nobody's")]
    same = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in (500, 501, 502, 540) for t in range(9)]  # copies, long chains with savings
    rows += same + [(503, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(7)] + [(100, 0, "user", "begin " * 9)]
    assert tried(crowded(spark.createDataFrame(rows, SCHEMA))) == trie(rows)


def test_prefix_trie_of_nothing_and_of_the_turnless(spark):
    assert tried(spark.createDataFrame([], SCHEMA)) == []
    assert tried(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    rows = [(c, 0, "user", "x") for c in range(101, 160)]  # some lose their only turn, as there is no conversation 100
    got = tried(spark.createDataFrame(rows, SCHEMA))
    assert got == trie(rows) and len(got) == 2


def test_prefix_trie_query(spark):
    got = prefix_trie.op11_prefix_trie(spark, DATA).toPandas()
    assert as_rows(got) == as_rows(tables(DATA).execute(prefix_trie.OP11_SQL).fetchdf())
    rows = duckdb.sql(f"select * from read_parquet('{DATA}/conversations.parquet')").fetchall()
    assert as_rows(got)[0] and len(got) == len(trie(rows))


def test_numbers_of_a_key_that_fills_many_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 30 > 0, F.col("id") % 11).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = shared.numbered_within(df, "k", [F.col("v")], ranges=[F.col("v")], keep=["k", "v"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.v, r.pos))
    assert sum(map(len, by.values())) == 5000
    for v in by.values():
        assert [p for _, p in sorted(v)] == list(range(1, len(v) + 1))


# ---- 12 -----------------------------------------------------------------------------------


def allowed(order):
    return re.fullmatch("(s?(ua)+)?", order)


def cheapest(signature):
    """All edits with at most two insertions in a place, tried one by one."""
    best = None
    gaps = ["", "I", "II"]
    kinds = ["D" if c in turn_repair.DELETED else "DKR" for c in signature]
    for ops in itertools.product(*kinds):
        for inserted in itertools.product(gaps, repeat=len(signature) + 1):
            audit = "".join(i + o for i, o in zip(inserted, [*ops, ""], strict=True))
            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[o] for o in audit) + sum(o != "D" and c in turn_repair.TRUNCATED for o, c in zip(ops, signature, strict=True))
            if best and (cost, audit) > best[:2]:
                continue
            free = [["u", "a"] if o in "RI" else [""] if o == "D" else None for o in audit]
            at = iter([c.lower() for c in signature])
            for k, o in enumerate(audit):
                if o != "I":
                    c = next(at)
                    if o == "K":
                        free[k] = [c]
            for who in itertools.product(*free):
                if allowed("".join(who)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, "".join(w or "-" for w in who))
    return best


def test_cheapest_edits():
    rng = random.Random(3)
    kinds = turn_repair.SOUND + turn_repair.TRUNCATED + turn_repair.DELETED
    every = ["", *kinds, *(a + b for a in "sua" for b in "suaSUA1o")] + ["".join(rng.choices(kinds, k=rng.randint(3, 4))) for _ in range(60)]
    for signature in every:
        assert turn_repair.cheapest_edits(signature) == cheapest(signature), signature


def test_long_signatures_need_no_deep_recursion():
    cost, audit, speakers = turn_repair.cheapest_edits("s" + "ua" * 30_000 + "u")
    assert (cost, audit, speakers) == (2, "K" * 60_002 + "I", "s" + "ua" * 30_001)


def repaired(rows):
    out = {}
    hurt = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 0:
            continue
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        hurt += [(c, t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    convs = by_conversation(hurt, " ")
    for c in {r[0] for r in rows}:
        turns = [v[1] for v in convs.get(c, []) if v[0]]
        said = [v[2:] for v in convs.get(c, [])]
        faults = []
        for k, (_, x) in enumerate(said):
            seen = x.strip(" \t\n\v\f\r")
            faults.append("blank" if not seen else "duplicate" if said[k] in said[:k] else "truncated" if seen[-1] not in ".!?" else "")
        who = [r[:1] if r[:1] in ("s", "u", "a") else "o" for r, _ in said]
        signature = "".join(turn_repair.DELETED["suao".index(w)] if f in ("blank", "duplicate") else w.upper() if f else w for w, f in zip(who, faults, strict=True))
        cost, audit, speakers = turn_repair.cheapest_edits(signature)
        lines, at = [], 0
        for o, w in zip(audit, speakers, strict=True):
            role = {"u": "user", "a": "assistant"}.get(w)
            if o == "I":
                lines.append(f"{role}:")
                continue
            if o != "D":
                lines.append(f"{said[at][0] if o == 'K' else role}:{said[at][1]}")
            at += 1
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))
    return out


def test_turn_repair(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    monkeypatch.setattr(shared, "HOT_KEYS", 1000)
    monkeypatch.setattr(turn_repair, "BLOCK", 3)
    rows = [r for seed in range(4) for r in conversations(80, seed)] + [(None, 0, "user", "nobody's."), (None, None, "assistant", "nobody's."), (9000, 5, None, None)]
    rows += [(c, 0, "user", "only one.") for c in range(2000, 2060)]  # some lose their only row
    crowded(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == repaired(rows) and len(got) == len({r[0] for r in rows})
    assert ("", sha("")) in {(r.audit, r.repaired_sha256) for r in got}


def test_turn_repair_texts(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What"), (1, 2, "user", "What"), (1, 3, "assistant", "x" * 3_000_000 + "."), (None, 0, "user", "?"), (2, 0, "tool", "\t")]
    done, placed = turn_repair.audited(turn_repair.conversation_rows(crowded(spark.createDataFrame(rows, SCHEMA))))
    assert {r.conv_id: (r.cost, r.audit, r.illegal) for r in done.collect()} == {1: (6, "IKKDK", 1), None: (2, "KI", 0), 2: (3, "D", 0)}
    got = sorted(map(tuple, turn_repair.replayed(done, placed).where("conv_id = 1").collect()))
    assert [(a, r, t[:5]) for _, a, r, t in got] == [(0, "user", ""), (1, "assistant", "Hello"), (2, "user", "What"), (3, "assistant", "xxxxx")]
    empty = turn_repair.audited(turn_repair.conversation_rows(spark.createDataFrame([], SCHEMA)))
    assert empty[0].count() == 0 and turn_repair.replayed(*empty).count() == 0 and turn_repair.replayed(*empty, texts=False).count() == 0


def test_turn_repair_query(spark):
    got = turn_repair.op12_turn_repair(spark, DATA).toPandas()
    assert as_rows(got) == as_rows(tables(DATA).execute(turn_repair.OP12_SQL).fetchdf())


# ---- 13 -----------------------------------------------------------------------------------


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(at, room):
        nonlocal best
        if len(room) >= best:
            return
        if at == len(lengths):
            best = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= lengths[at]}.values():
            room[k] -= lengths[at]
            go(at + 1, room)
            room[k] += lengths[at]
        go(at + 1, [*room, capacity - lengths[at]])

    go(0, [])
    return best


def test_plans_are_full_and_near_the_fewest_bins():
    rng, more = random.Random(5), 0
    for _ in range(120):
        capacity = rng.choice([10, 20, 37])
        lengths = [rng.randint(1, rng.choice([capacity, capacity // 2])) for _ in range(rng.randint(1, 11))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_bins(counts, capacity)
        used = defaultdict(int)
        for times, bin_ in plan:
            assert times > 0 and sum(n * k for n, k in bin_) <= capacity
            for n, k in bin_:
                used[n] += times * k
        assert used == counts
        bins = sum(t for t, _ in plan)
        more += bins - fewest(lengths, capacity)
    assert more <= 2  # of 120 cases


def test_each_bin_is_the_fullest_beside_its_longest():
    rng = random.Random(6)
    for _ in range(60):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), 6)}
        left = dict(counts)
        for times, bin_ in packing.plan_bins(counts, 30):
            longest = max(n for n in left if left[n])
            have = [n for n, c in left.items() for _ in range(c - (n == longest))]
            sums = {0}
            for n in have:
                sums |= {s + n for s in sums}
            assert bin_[0][0] == longest and sum(n * k for n, k in bin_) == longest + max(s for s in sums if s <= 30 - longest)
            for n, k in bin_:
                left[n] -= times * k
    assert packing.plan_bins({}, 8) == []
    with pytest.raises(ValueError):
        packing.plan_bins({9: 1}, 8)


def test_huge_counts_need_few_combinations():
    rng = random.Random(7)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    plan = packing.plan_bins(counts, 2048)
    bins, tokens = sum(t for t, _ in plan), sum(n * c for n, c in counts.items())
    assert len(plan) < 2048 * 30 and bins <= 1.006 * max(-(-tokens // 2048), sum(c for n, c in counts.items() if n > 1024))


TRICKY = ["", None, " \n\t ", "it's we'LL don'T", "Ünï çødé 漢字 \U0001f600 ﬁ é ́x", "<|endoftext|> a<|startoftext|>b <| endoftext|>", "a\x1cb\x1dc \x1e d\x85e\xa0f g　h i\x00j\x7f", "1234 x9y ９", "word " * 5000, "x" * 30_000, "ß ΣΑΣ İ İ"]


def test_spaced_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.SpacedTokenizer(path)
    rng = random.Random(8)
    letters = "ab'sS tT.,!?09é́漢\U0001f600ﬁΣ<|>\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​　"
    texts = TRICKY + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(2000)]
    assert own.encode(texts) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    with pytest.raises(ValueError):
        packing.SpacedTokenizer(tokenizer_path())


def packed_rows(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    return sorted(out, key=str)


def packing_is_gapless(rows):
    ends = defaultdict(int)
    for s, offset, length in sorted((r.sequence_id, r.offset, r.length) for r in rows):
        assert offset == ends[s]
        ends[s] += length
    assert max(ends.values(), default=0) <= 2048
    return len(ends)


def test_packing_query(spark, tmp_path):
    texts = [x[0] for x in duckdb.sql(f"select text from read_parquet('{DATA}/documents.parquet')").fetchall()] + TRICKY
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0]), (None, "no id"), (None, "no id")]
    crowded(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op13_packing(spark, str(tmp_path)).collect()
    assert sorted([tuple(r[:5]) for r in got], key=str) == packed_rows(rows)
    assert packing_is_gapless(got) <= packing.least_bins([r.length for r in got], 2048) + 1


def test_sequences_and_empty_table(spark):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(k, "a b c d e " * k) for k in range(1, 30)], "doc_id bigint, text string")
    pieces = packing.cut_pieces(df, path, capacity=64)
    placed = packing.place(pieces, capacity=64)
    whole = packing.sequences(placed).collect()
    parts = {(r.sequence_id, r.offset): bytes(r.ids) for r in placed.collect()}
    for r in whole:
        assert len(r.ids) == 4 * r.n_tokens <= 256
        for at, start in enumerate(r.starts):
            end = r.starts[at + 1] if at + 1 < len(r.starts) else r.n_tokens
            assert bytes(r.ids[4 * start : 4 * end]) == parts[r.sequence_id, start]
    assert sum(r.n_tokens for r in whole) == sum(5 * k + 1 for k in range(1, 30))
    none = packing.cut_pieces(df.where("false"), path)
    assert packing.place(none).count() == 0 and packing.sequences(packing.place(none)).count() == 0


@pytest.mark.parametrize("at", [0, 13])
def test_long_conversations_are_checked_in_slices(spark, at):
    """Slices give what one task does; a template that rewrites history at one length is found in any of them."""

    def template(turns):
        text = chat.marked_turns(turns)
        return "!" + text if len(turns) == at else text

    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} <|im_end|> {t}" * (t % 3)) for c, n in ((1, 5), (2, 12), (None, 13), (4, 41)) for t in range(n)]
    rows += [(5, 3, "user", "same")] * 20 + [(5, None, None, None)] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    want = {tuple(r) for r in _plain(chat.format_conversations(df, template, long=1000))}
    for long, size in ((6, 100), (0, 1)):
        got = list(_plain(chat.format_conversations(df, template, long=long, size=size)))
        assert len(got) == 5 and set(got) == want
    assert sum(r[5] for r in want) == sum(n >= at > 0 for n in (5, 12, 13, 41, 22))


def _plain(df):
    assert df.columns == ["conv_id", "n_turns", "formatted", "starts", "ends", "rewrites", "checked"]
    return (tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())
