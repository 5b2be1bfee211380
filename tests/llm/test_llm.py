"""The ten operators against brute force, on small tables with nulls, empty texts, repeated rows and extra columns."""

import hashlib
import html
import math
import os
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, classifier, components, decontam, html_text, line_dedup, simhash, substring_dedup, url_filter, weak_rules

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
#: Clashing names that the operators use themselves.
EXTRA = {"row": 1, "key": "k", "score": 0.5, "host": "h", "fp": 7, "d": 1, "line": 2, "ids": "x", "label": 3}


def crowded(df, **more):
    return df.withColumns({k: F.lit(v) for k, v in (EXTRA | more).items() if k not in df.columns})


def documents(n=60):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet') order by doc_id limit {n}").fetchall()
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t "), (1003, rows[0][1]), (1004, rows[0][1]), (1005, "Ünï çødé 漢字 \U0001f600 " * 40)]


def frame(spark, rows):
    return crowded(spark.createDataFrame(rows, "doc_id bigint, text string"))


def empty(spark):
    return frame(spark, [])


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- 1 ------------------------------------------------------------------------------------


def removed(docs):
    count = Counter()
    for _, b in docs:
        count.update(b[s : s + 200] for s in range(len(b) - 199))
    out = []
    for i, b in docs:
        cut = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                cut[s : s + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(cut)))
        out.append((i, len(b), sum(cut), spans, sha(bytes(x for x, y in zip(b, cut, strict=True) if not y))))
    return sorted(out)


@pytest.mark.parametrize("kinds", [1000, 1])
def test_substring_dedup(spark, monkeypatch, kinds):
    monkeypatch.setattr(substring_dedup, "KINDS", kinds)
    rng = random.Random(kinds)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = documents(25)[:25] + [(2000 + k, rng.choice("xyz") * k + passage[k * 7 : 400 + 20 * k] + "".join(rng.choice("ij") for _ in range(50))) for k in range(12)]
    rows += [(3000, "a" * 450), (3001, None), (3002, ""), (3003, passage[:199]), (3004, "ab" * 150)]
    got = substring_dedup.drop_repeated_bytes(frame(spark, rows), batches=3).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == removed([(i, (t or "").encode()) for i, t in rows])


def test_substring_dedup_repeated_rows_and_empty_table(spark):
    rows = [(1, "q" * 150 + "w" * 150), (1, "q" * 150 + "w" * 150), (None, "short")]
    got = substring_dedup.drop_repeated_bytes(frame(spark, rows), batches=2).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(5, 0), (300, 300), (300, 300)]
    assert substring_dedup.drop_repeated_bytes(empty(spark), batches=2).count() == 0


def test_a_stored_family_takes_further_batches(spark, tmp_path):
    rows = documents(25)[:25] + [(2000 + k, "".join(random.Random(k // 2).choices("abcdefgh ", k=500))) for k in range(6)]
    body = [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text")]
    parts = [frame(spark, rows[k::3]).select(*body) for k in range(3)]
    whole, early = substring_dedup.SuffixFamily(spark), substring_dedup.SuffixFamily(spark, 3)
    for part in parts:
        whole.add(substring_dedup.suffixes(part))
    for part in parts[:2]:
        early.add(substring_dedup.suffixes(part))
    early.store(str(tmp_path / "family"))
    late = substring_dedup.SuffixFamily.stored(spark, str(tmp_path / "family"))
    late.add(substring_dedup.suffixes(parts[2]))
    assert [rank for rank, _ in late.levels] == [rank for rank, _ in whole.levels] == [1, 0]
    a, b = (Counter(map(tuple, f.repeated().select("head", "block", "doc", "start").collect())) for f in (whole, late))
    assert a == b and a


def test_substring_dedup_of_texts_longer_than_a_run(spark):
    from lodestone.llm.shared import RUN_BYTES

    passage = "".join(random.Random(4).choices("abcdefgh ", k=1000))
    filler = [hashlib.sha256(b"%d" % k).hexdigest() for k in range(2 * RUN_BYTES // 64 + 100)]
    rows = [(1, "".join(filler)), (2, passage), (3, "".join(filler[:50]) + passage[:300])]
    got = {r.doc_id: r for r in substring_dedup.drop_repeated_bytes(frame(spark, rows), batches=2).collect()}
    assert got[1].n_removed == 50 * 64 and got[2].n_removed == 300 and got[3].kept == b"" and got[1].kept == "".join(filler[50:]).encode()


# ---- 2 ------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = "<|im_end|><|im_start|>assistant ok <|\\ <<|n|>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, None, "sys\ntem", None), (2, 1, None, ""), (None, 0, "assistant", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = crowded(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    whole = lambda turns: sha("".join(f"{r}\n{t}\n" for r, t in turns).encode())
    assert got[1].turns_sha256 == whole([("user", tricky), ("assistant", tricky)]) and got[1].loss_sha256 == sha(tricky.encode())
    assert got[2].turns_sha256 == whole([("sys\ntem", ""), ("", "")]) and got[2].loss_chars == 0
    assert got[None].loss_chars == 1 and got[3].loss_sha256 == sha(b"aab") and got[3].n_turns == 3
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_rewriting_template_is_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rewrites = lambda ts: f"{len(ts)} turns\n" + "".join(t for _, t in ts)
    assert chat.locate(turns, rewrites)[1] is None
    many = [("user" if k % 2 else "assistant", str(k)) for k in range(200)]
    whole, spans = chat.locate_in_windows(many, chat.marked_turns, 16)
    assert (whole, spans) == chat.locate(many, chat.marked_turns) and spans[-1][1] == len(whole)
    last_only = lambda ts: "".join(t for _, t in ts[-100:])
    assert chat.locate_in_windows(many, last_only, 16)[1] is None  # not seen in a window, but in the whole


def test_chat_rewriting_at_one_length_only_is_found(spark):
    def template(turns):
        text = chat.marked_turns(turns)
        return text.upper() if len(turns) == 90 else text

    rows = [(c, k, "user" if k % 2 else "assistant", f"turn {k}") for c, n in ((1, 150), (2, 80)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(df, template)
    assert {r.conv_id: (r.rewrites, r.checked) for r in out.collect()} == {1: (True, True), 2: (False, True)}
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert got[1].turns_sha256 is None and got[1].loss_chars is None and got[1].formatted_chars > 0 and got[2].n_turns == 80 and got[2].loss_chars > 0
    unseen = chat.format_conversations(df, template, window=16)
    assert {r.conv_id: (r.rewrites, r.checked) for r in unseen.collect()} == {1: (False, False), 2: (False, False)}


# ---- 3 ------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    pieces = ["<|endoftext|>", "<|", "a", " ", "\n", "'s", "é", "漢", "\U0001f600", "՘", "\u088f", "12", "!!", "\xa0", "\u2003", "the ", "\x00", "\x1c", "\x85", "ſ"]
    rows = documents(30) + [(5000 + k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for k in range(200)] + [(6000, "ab" * 2000)]
    out = bpe.bpe_decode(bpe.bpe_encode(frame(spark, rows), path, keep=["doc_id", "text", "row"]), path).collect()
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        assert list(memoryview(bytes(r.ids)).cast("I")) == want[r.doc_id]
        assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    once = bpe.bpe_encode(frame(spark, rows), path, keep=["doc_id"], decoded="text").collect()
    assert {r.doc_id: (r.ids, r.text) for r in once} == {r.doc_id: (r.ids, r.decoded) for r in out}
    assert bpe.bpe_encode(empty(spark), path).count() == 0


def test_bpe_settled_scripts_split_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    for cp in [*range(0x558), *range(0x2000, 0x2070), *range(0x3041, 0x3100), *range(0x4E00, 0x4F00), *range(0xFF01, 0xFFA0)]:
        s = f"a{chr(cp)}1{chr(cp)}!{chr(cp)}"
        want = [s[a:b] for _, (a, b) in split.pre_tokenize_str(s)]
        if bpe.SETTLED.fullmatch(s):
            assert bpe.PATTERN.findall(s) == want
        if bpe.LATIN.fullmatch(s):
            assert bpe.LATIN_PATTERN.findall(s) == want


# ---- 4 ------------------------------------------------------------------------------------


def counted(t):
    t = t or ""
    w = re.findall(WORD, t)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))


def test_quality_rules(spark):
    rows = documents(200) + [(7000, "a b c a b c"), (7001, "x\n\nx \nx\n"), (7002, "# $ %")]
    got = {r.doc_id: r for r in weak_rules.judge(weak_rules.with_counts(frame(spark, rows))).collect()}
    for i, t in rows:
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counted(t)
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{DATA}/labels.parquet')").fetchall())
    long = [i for i, t in rows if i in labels and len(re.findall(WORD, t)) >= 50]
    assert sum(got[i].good == (labels[i] == 1) for i in long) >= 0.95 * len(long)
    assert weak_rules.judge(weak_rules.with_counts(empty(spark))).count() == 0


def plain_votes(t):
    """-1 bad, 1 good, 2 doubtful, 0 not asked."""
    n, chars, symbols, dup, rep = counted(t)
    w = re.findall(WORD, t or "")
    upper, lines = len(re.findall("[A-Z]", t or "")), sum(1 for x in (t or "").split("\n") if x)
    marks, distinct = sum(c in string.punctuation for c in t or ""), len(set(w))

    def rule(bad, good):
        return 0 if n < 30 else -1 if bad else 1 if good else 2

    return (
        -1 if n < 10 else 1 if n >= 50 else 2,
        rule(chars > 6.3 * n or chars < 4 * n, 4.5 * n <= chars <= 5.8 * n),
        -1 if symbols > n / 10 else rule(False, symbols <= n / 50),
        rule(10 * marks > 3 * n, marks <= n / 5),
        rule(upper > chars / 10, upper <= chars / 25),
        rule(dup >= 2 and dup > lines / 5, dup <= lines / 20),
        rule(10 * rep > 3 * n, rep <= n / 20),
        rule(10 * distinct < 3 * n, distinct >= n / 2),
    )


def plain_posteriors(votes, rounds=100):
    """Expectation-maximisation one document and one rule at a time."""
    rules = range(len(votes[0]))
    p = [(1 + v.count(1)) / (1 + v.count(1) + v.count(-1)) for v in votes]
    for _ in range(rounds):
        good, bad = ([{k: 1.0 for k in (-1, 1, 2)} for _ in rules] for _ in range(2))
        for v, q in zip(votes, p, strict=True):
            for r in rules:
                if v[r]:
                    good[r][v[r]] += q
                    bad[r][v[r]] += 1 - q
        for t in good + bad:
            total = sum(t.values())
            t.update({k: x / total for k, x in t.items()})
        prior = (sum(p) + 1) / (len(p) + 2)
        odds = [math.log(prior / (1 - prior)) + sum(math.log(good[r][v[r]] / bad[r][v[r]]) for r in rules if v[r]) for v in votes]
        p = [1 / (1 + math.exp(-x)) for x in odds]
    return p


def test_quality_rules_query(spark):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet')").fetchall()
    got = {r.doc_id: r for r in weak_rules.op4_quality_rules(spark, DATA).collect()}
    assert len(got) == len(rows)
    for (i, t), quality in zip(rows, plain_posteriors([plain_votes(t) for _, t in rows]), strict=True):
        n, chars, symbols, dup, rep = counted(t)
        failed = n < 50 or 100 * rep > 50 * n
        assert tuple(got[i])[:7] == (i, n, chars, symbols, dup, rep, failed)
        assert got[i].quality == pytest.approx(quality, abs=1e-9) and got[i].kept == (not failed and quality >= 0.5)


def test_quality_is_estimated_not_all_must_pass(spark):
    data = DATA.replace("sf0.001", "sf0.1")
    got = weak_rules.op4_quality_rules(spark, data).collect()
    good = {r.doc_id: r.quality >= 0.5 for r in got}
    assert any(good[r.doc_id] and r.any_bad for r in got) and any(not good[r.doc_id] and not r.any_bad for r in got)
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{data}/labels.parquet')").fetchall())
    long = [r for r in got if r.n_words >= 50 and r.doc_id in labels]
    by_em = sum(good[r.doc_id] == (labels[r.doc_id] == 1) for r in long)
    assert by_em > sum(r.any_bad == (labels[r.doc_id] == 0) for r in long) and by_em >= 0.99 * len(long)


def test_quality_rates_without_bad_votes():
    votes = np.array([[1, 1, 0], [2, 1, 1], [1, 2, 2]], np.int8)
    posterior, on_good, _ = weak_rules.fit_votes(votes, np.array([50.0, 3.0, 2.0]))
    assert (posterior >= 0.5).all() and np.allclose(on_good.sum(axis=0), 1)
    assert len(weak_rules.fit_votes(votes[:0], np.zeros(0))[0]) == 0


# ---- 5 ------------------------------------------------------------------------------------


def low_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("block", [10**6, 40])
def test_decontamination(spark, block):
    items = duckdb.sql(f"select item_id, text from read_parquet('{DATA}/benchmark.parquet') limit 12").fetchall() + [(900, "Short Item"), (901, "..."), (902, None), (None, "ere the of"), (903, "Short item!")]
    rows = documents(120) + [(8000, "a short ITEM, short item short"), (8001, items[0][1].upper()), (8002, "short"), (8003, "item short")]
    windows = {}
    for i, t in items:
        w = low_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, hit, found = low_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    df = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontam.written(decontam.build_index(frame(spark, rows)), "postings")
    found = decontam.flagged(decontam.search_all(index, df, block_words=block))
    assert sorted(tuple(r)[:1] + tuple(r)[2:7] for r in found.collect()) == sorted(want)
    # the stored index serves another test set
    other = decontam.flagged(decontam.search_all(index, spark.createDataFrame([(7, rows[1][1])], df.schema))).where("contaminated")
    assert rows[1][0] in {r.doc_id for r in other.collect()}


def near_words(words, phrase, slop):
    """Positions in stretches of at most ``slop`` words more than the phrase that begin with one of its words and hold all."""
    out = set()
    for a in range(len(words)):
        if words[a] in phrase:
            lasts = [next((k for k in range(a, len(words)) if words[k] == x), None) for x in phrase]
            if None not in lasts and max(lasts) - a + 1 <= len(phrase) + slop:
                out |= set(range(a, max(lasts) + 1))
    return out


@pytest.mark.parametrize("slop", [0, 3])
def test_proximity_matches(spark, slop):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 16)))) for i in range(6)] + [(77, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    rows = [(i, " ".join(rng.choice("abcdefghijk") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(100, "One two three, four five NEW six seven eight nine ten eleven twelve thirteen."), (101, "seven six five four three two one x eight nine ten eleven twelve thirteen"), (102, None)]
    got = {r.doc_id: r for r in decontam.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), slop=slop).collect()}
    for i, t in rows:
        w, hits, found = low_words(t), set(), set()
        for item, text in items:
            p = low_words(text)
            n = min(13, len(p))
            for k in range(len(p) - n + 1):
                if new := near_words(w, p[k : k + n], slop):
                    hits |= new
                    found.add(str(item))
        assert got[i].near_hits == sorted(hits) and got[i].near_items == sorted(found)
        assert set(got[i].hits) <= hits and set(got[i].items) <= found
    assert got[100].items == [] and ("77" in got[100].near_items) == ("77" in got[101].near_items) == (slop == 3)


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontam.find_contamination(empty(spark), items).count() == 0
    assert not decontam.flagged(decontam.find_contamination(frame(spark, [(1, "a b c")]), items.limit(0))).first().contaminated


# ---- 6 ------------------------------------------------------------------------------------


def without_copies(rows, least):
    lines = {i: (t or "").split("\n") for i, t in rows}
    words = {i: [len(re.findall(WORD, x)) for x in lines[i]] for i in lines}
    first = {}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                if sum(words[i][a:b]) >= least:
                    first.setdefault(tuple(lines[i][a:b]), (i, a))
    out = {}
    for i in lines:
        dead = set()
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                if sum(words[i][a:b]) >= least and first[tuple(lines[i][a:b])] < (i, a):
                    dead |= set(range(a, b))
        out[i] = "\n".join(x for k, x in enumerate(lines[i]) if k not in dead)
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = ["a b c", "d", "e f", "", "g h i j", "k", "l m", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(40)] + [(40, None), (41, ""), (42, "d\n" * 30)]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(frame(spark, rows), min_words=8).collect()}
    want = without_copies(rows, 8)
    assert {i: r.text or "" for i, r in got.items()} == want and got[40].text is None and got[0].key == "k"
    twice = line_dedup.drop_repeated_lines(frame(spark, [(1, "w " * 60), (1, "w " * 60), (None, "w " * 60)]))
    assert sorted(r.n_lines_removed for r in twice.collect()) == [0, 1, 1]
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("least", [50, 5])
def test_line_dedup_of_the_documents(spark, least):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet') where len(string_split(coalesce(text, ''), chr(10))) <= 60").fetchall()
    got = {r.doc_id: r.text or "" for r in line_dedup.drop_repeated_lines(frame(spark, rows), min_words=least).collect()}
    assert got == without_copies(rows, least)


def test_line_dedup_of_repeated_rows_and_clashing_names(spark):
    body = "\n".join(f"line {k}" for k in range(70))
    rows = [(1, body, 5, "a")] * 3 + [(2, "x\n" + body, 6, "b"), (2, "y", 7, None), (None, body, 8, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `key` bigint, d string").withColumns({"__d": F.lit(1), "cuts": F.lit("c"), "c0": F.lit(0), "n_lines": F.lit(None), "runs": F.lit(2)})
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "key", "d", "__d", "cuts", "c0", "runs", "n_lines", "n_lines_removed"]
    got = Counter(tuple(r)[:4] for r in out.collect())
    assert got == Counter([(1, "", 5, "a")] * 3 + [(2, "x", 6, "b"), (2, "y", 7, None), (None, body, 8, "d")])


# ---- 7 ------------------------------------------------------------------------------------


def fingerprint(t):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(values):
    fp = np.array(values, np.uint64)
    label = np.arange(len(fp))
    while True:
        new = np.array([label[np.bitwise_count(fp ^ x) <= 4].min() for x in fp])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("block", [20_000, 3])
def test_simhash(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = documents(150) + [(9000, "one"), (9001, "ONE"), (9002, "two words"), (9003, "  ")]
    got = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    values = [fingerprint(t) for _, t in rows]
    label = reachable(values)
    assert {i: got[i].fingerprint for i, _ in rows} == {i: f"{v:016x}" for (i, _), v in zip(rows, values, strict=True)}
    assert [got[i].component_id for i, _ in rows] == [min(rows[k][0] for k in np.flatnonzero(label == x)) for x in label]
    assert simhash.simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize(("step", "block"), [(1 << 20, 10**6), (300, 10**6), (1 << 20, 40)])
def test_simhash_links_of_many_near_fingerprints(spark, monkeypatch, step, block):
    monkeypatch.setattr(simhash, "STEP", step)
    rng = random.Random(step)
    values = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), block=block)
    roots = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    label = reachable(values)
    groups = Counter(roots.get(v, v) for v in signed)
    assert sorted(groups.values()) == sorted(Counter(label.tolist()).values())
    bits = {tuple(p) for p in np.bitwise_count(np.array([[a ^ b] for a, b in zip(values, values[1:], strict=False)], np.uint64))}
    assert bits  # fingerprints differ


# ---- 8 ------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div>{outside}
<article><header class="article-header"><h1>Head &amp; line</h1></header><p>One <b>bold</b>\n text&nbsp;here<br>more<p>Two &lt;tag&gt;<aside>Side</aside><div class="ad">Buy</div>
<ul><li>item<li>item</ul><form><input> Send</form><section class="comments"><article>Nice!</article></section></article><footer>&copy; me</footer></body></html>"""


def test_html_text(spark):
    rows = [(1, "http://a.com/x/1", PAGE.replace("{outside}", "<p>Shared words</p><p>Own words 1</p>")), (2, "http://a.com/x/2", PAGE.replace("{outside}", "<p>Shared words</p><p>Own words 2</p>")), (3, "http://b.com/", "plain &eacute; text"), (4, None, None), (5, "nowhere", ""), (3, "http://b.com/", "plain &eacute; text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df = crowded(df)
    got = sorted(html_text.main_text(df).select("page_id", "text").collect())
    body = "Head & line\nOne bold text here more\nTwo <tag>\nitem\nitem"
    assert [tuple(r) for r in got] == [(1, "Own words 1\n" + body), (2, "Own words 2\n" + body), (3, "plain é text"), (3, "plain é text"), (4, ""), (5, "")]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_text_of_the_pages(spark):
    rows = duckdb.sql(f"select page_id, html from read_parquet('{DATA}/pages.parquet')").fetchall()
    got = {r.page_id: r.text for r in html_text.op8_html_text(spark, DATA).collect()}
    for i, h in rows:
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", h, re.DOTALL)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        assert got[i] == "\n".join(b for b in blocks if b)


def test_shared_blocks_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 12))], np.int64) for _ in range(2))
        s = html_text.shared_blocks(a, b)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        rest = iter(b.tolist())
        assert s.sum() == t[-1, -1] and all(x in rest for x in a[s].tolist())


def test_neighbours_are_the_nearest_urls_and_do_not_hang_on_ranges(spark):
    rng = random.Random(8)
    rows = [(f"h{k % 3 // 2}", "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))), k, 100 + k, 200 + k) for k in range(60)]
    df = spark.createDataFrame(rows, "host string, path string, page_id bigint, key bigint, digest bigint")
    got = {r.digest: r.near for r in html_text.neighbours(df.repartition(7)).collect()}
    want = {}
    for h in ("h0", "h1"):
        own = sorted(r for r in rows if r[0] == h)
        for i, r in enumerate(own):
            beside = [own[j] for j in (i - 1, i + 1) if 0 <= j < len(own)]
            want[r[-1]] = max(beside, key=lambda o: len(os.path.commonprefix([r[1], o[1]])))[-1]
    assert got == want


# ---- 9 ------------------------------------------------------------------------------------


def test_classifier(spark):
    d = "/root/testdata/sf0.01"
    got = classifier.op9_quality_classifier(spark, d).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{d}/labels.parquet')").df()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and got.score.between(0, 1).all()
    m = got.merge(labels)
    m = m[m.held_out]
    rank, good = m.score.rank(), m.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (m.predicted == m.quality).mean() > 0.93


def test_classifier_edges(spark):
    docs = frame(spark, [(1, "good words here"), (2, None), (3, ""), (None, "bad ### words"), (1, "good words here")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id bigint, quality int")
    weights = classifier.fit(docs, labels)
    out = classifier.score(docs, weights, out="p").collect()
    assert len(out) == 5 and all(0 < r.p < 1 and not math.isnan(r.p) for r in out) and out[0].score == 0.5
    assert classifier.score(empty(spark), classifier.fit(empty(spark), labels.limit(0))).count() == 0


def plain_features(t):
    """Slots and values of a text, a token at a time."""
    b = (t or "").encode()
    low = re.sub(b"[A-Z]", lambda m: m[0].lower(), b)
    found = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    one = lambda a, b: classifier.segment_hashes(np.frombuffer(low, np.uint8), np.array([a]), np.array([b]))[0]
    tokens = [one(a, e) for a, e in found]
    keys = [*tokens]
    with np.errstate(over="ignore"):
        for x, y in zip(tokens, tokens[1:], strict=False):
            keys.append(classifier.mixed(np.array([x * np.uint64(3) + y]))[0])
            if x == y:
                keys.append(np.uint64(13))
    keys += [np.uint64(11) for a, e in found if len(re.findall(b"[A-Z]", b[a:e])) >= 2]
    counts = Counter(int(classifier.mixed(np.array([k], np.uint64))[0] % np.uint64(classifier.SIZE)) for k in keys)
    total = sum(counts.values())
    return {k: float(np.float32(math.sqrt(c) / math.sqrt(total))) for k, c in counts.items()}


def plain_ftrl(rows, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    for epoch in range(classifier.EPOCHS):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[r]
            x = {**x, classifier.SIZE: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return weight


def test_classifier_query_against_plain_ftrl(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet')").fetchall())
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{DATA}/labels.parquet') order by doc_id").fetchall()
    rows = [(plain_features(texts[i]), y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    weight = plain_ftrl(rows)
    for r in classifier.op9_quality_classifier(spark, DATA).collect():
        x = {**plain_features(texts[r.doc_id]), classifier.SIZE: 1.0}
        want = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
        assert r.score == pytest.approx(want, abs=1e-4) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_classifier_does_not_hang_on_the_order_of_rows(spark):
    rows = [(k % 5, f"word{k} " * 9) for k in range(40)]
    labels = [(k % 5, k % 2) for k in range(20)]
    weights = [classifier.fit(frame(spark, r).repartition(n), spark.createDataFrame(y, "doc_id bigint, quality int")) for r, y, n in ((rows, labels, 1), (rows[::-1], labels[::-1], 3))]
    assert (weights[0] == weights[1]).all() and weights[0].any()


# ---- 10 -----------------------------------------------------------------------------------


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.PAGE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def test_url_filter(spark):
    urls = [None, "", "x", "http://", "://org/", "HTTP://Example.ORG/es/a?b://c", "http://a.b.example.org/en/1x#y", "http://notexample.org/en/1", "http://example.org", "ftp://x.com/fr/", "http://x.com/de/?q", "http://x.com/De/", "http://org./", "http://a..org/", "http://u@example.org:80/es/", "http://é.org/é", "http://x.com?/fr/", "a\nb://x.com/fr/\nz", "http://x.com/fr/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, None)], "page_id bigint, url string")
    df = crowded(df, rule="r", verdict="v", path="p", j_url="u", j_rule="x", j_host="y", n="z", digest="d", c0="c")
    got = url_filter.judge_urls(df, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, got), key=key) == sorted([(k, *judged(u)) for k, u in enumerate(urls)] + [(0, *judged(None))], key=key)
    no_rules = url_filter.judge_urls(df, url_filter.rule_table(spark).limit(0))
    assert {r.verdict for r in no_rules.collect()} == {"allow"} and url_filter.judge_urls(df.limit(0), url_filter.rule_table(spark)).count() == 0


def test_url_filter_takes_a_column_with_an_inner_name_and_frequent_urls(spark, monkeypatch):
    from lodestone.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    df = spark.createDataFrame([("http://x.com/de/1", k) for k in range(9)] + [("http://y.org/", 9), (None, 10)], "j_url string, j_rule bigint")
    got = url_filter.judge_urls(df, url_filter.rule_table(spark), url="j_url").collect()
    assert sorted((r.j_rule, r.rule, r.verdict) for r in got) == [(k, "com/de/", "block") for k in range(9)] + [(9, "org/", "allow"), (10, None, "allow")]


# ---- hashes that no text can make collide -----------------------------------------------------


def twins(n=1024):
    """Two strings of which sums modulo 2 ** 64 agree, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_built_collisions_are_told_apart(spark):
    from lodestone.llm import decontam, shared

    a, b = twins()
    data = np.frombuffer((a + b).encode(), np.uint8)
    starts, ends = np.array([0, len(a)]), np.array([len(a), 2 * len(a)])
    assert len(set(shared.segment_hashes(data, starts, ends).tolist())) == 1 and len(set(shared.segment_keys(data, starts, ends).tolist())) == 2
    got = weak_rules.with_counts(frame(spark, [(1, f"{a}\n{b}\n{a}")])).collect()[0]
    assert got.n_dup_lines == 1
    bench = spark.createDataFrame([("i", a)], "item_id string, text string")
    hits = {r.doc_id: r.n_hit for r in decontam.flagged(decontam.find_contamination(frame(spark, [(1, a), (2, b)]).withColumn("k", F.col("doc_id")), bench, doc_id="doc_id", doc_key="k")).collect()}
    assert hits == {1: 1, 2: 0}


# ---- SQL and the pipeline -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_chat_format", "op10_url_filter"])
def test_queries_equal_their_sql(spark, name):
    from compare import rows, tables

    import __spark_entry__ as e

    got, want = e.queries()[name](spark, DATA).toPandas(), tables(DATA).execute(e.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = duckdb.sql(f"select item_id, text from read_parquet('{DATA}/benchmark.parquet')").fetchall()
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5 and p.ORACLE_SQL is None
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns and out.schema == docs.schema
            docs = p.written(out, "test-stage")
            after = {r.doc_id: r for r in docs.collect()}
            assert set(after) <= set(before) and docs.count() == len(after)
        if k == 0:
            labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{DATA}/labels.parquet')").fetchall())
            assert sum(labels[i] == 1 for i in after if i in labels) >= 0.9 * sum(v == 1 for v in labels.values())
        if k == 1:
            want = without_copies([(i, r.text) for i, r in before.items()], line_dedup.MIN_WORDS)
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in want.items() if t == (before[i].text or "") or re.search(WORD, t)}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if k == 2:
            ids = sorted(before)
            label = reachable([fingerprint(before[i].text) for i in ids])
            assert set(after) == {min(ids[j] for j in np.flatnonzero(label == x)) for x in set(label.tolist())}
        if k == 3:
            windows = {tuple(w[s : s + 13]) for _, t in items for w in [low_words(t)] for s in range(max(1, len(w) - 12))}
            for i, r in before.items():
                w = low_words(r.text)
                hit = {s + j for s in range(len(w) - 12) if tuple(w[s : s + 13]) in windows for j in range(13)}
                assert (i not in after) == (bool(hit) and 20 * len(hit) >= len(w))
        if k == 4:
            done = out.collect()
            assert {r.doc_id for r in done} == set(after) and all(r.round_trip for r in done) and all(r.n_tokens * 4 == len(r.ids) for r in done)


def test_pipeline_takes_nulls_repeats_and_clashing_names(spark):
    import corpus_pipeline as p

    rows = duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet') order by doc_id limit 60").fetchall()
    rows = [*rows, *rows[:3], (None, None), (None, rows[5][1]), (None, rows[5][1]), (900, None), (901, ""), (902, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    more = {"__key": F.lit("k"), "__d": F.lit(1.5), "__score": F.lit(2), "__text": F.lit("t"), "key": F.lit("x"), "d": F.lit("y"), "score": F.lit(0), "ids": F.lit(3), "decoded": F.lit(4), "count": F.lit(5), "c0": F.lit(6), "cuts": F.lit(7), "fp": F.lit(8)}
    docs = p.written(df.withColumns(more), "crowded")
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DATA)
        n = docs.count()
        docs = p.written(out, "crowded")
        assert docs.count() <= n
        if k < 4:
            assert docs.columns == df.withColumns(more).columns
            assert docs.count() == 0 or tuple(docs.select(*[f"`{c}`" for c in more]).first()) == ("k", 1.5, 2, "t", "x", "y", 0, 3, 4, 5, 6, 7, 8)
    assert docs.count() and docs.where("NOT round_trip").count() == 0


def test_pipeline_takes_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0 or docs is None
