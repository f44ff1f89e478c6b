"""Each operator against a brute-force version, and on awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from loomwell.llm.shingle import shingles as shingle_list
from loomwell.llm import bitslice, bpechunk, chatfmt, components, htmltext, neardup, ordermin, pii, segments, simhash, subdedup, tokencount, toxicity, winnow

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, print string"


def rows(texts, ids=None):
    return [(i, t, "en", "s", None, "x", "y") for i, t in zip(ids or range(len(texts)), texts)]


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, clashing extra columns."""
    long = prose(1, 30_000)
    texts = [None, "", "   ", "one", "Ünï códe ↯ 😀", long, long, long + " tail", prose(2, 60), prose(2, 60), prose(3, 25) + " " + prose(2, 60), "a  b\n\n c", "null id"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, None]
    return spark.createDataFrame(rows(texts, ids), DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 1 toxicity


def test_toxicity_learns_and_finds_misspellings(spark, awkward, empty):
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(prose(i, 40, 5000) + (f" you {['blorgface', 'snurfling'][i % 8 // 4]} " if bad else " ") + prose(i + 999, 20, 5000))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows(texts), DOC)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"))
    assert any("blorgface".startswith(t) for t in model.terms)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(out[i].predicted == y for i, y in labels) >= 396
    scorer = toxicity.Scorer(model)
    assert scorer.score("so you blorgfacce there") > scorer.score("so you friend there")
    quoted, abuse = 'they said "the blorgface" again', "they are the blorgface again"
    assert scorer.score(quoted) < 0.5 <= scorer.score(abuse)
    assert scorer.score("she wrote that the word “blorgface” is rude") < 0.5
    both = toxicity.score(spark.createDataFrame(rows([quoted, abuse]), DOC), model).orderBy("doc_id").collect()
    assert [r.predicted for r in both] == [0, 1]
    odd = toxicity.score(awkward, model).collect()
    assert len(odd) == 13 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(awkward, model).count() == 13
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(awkward, none).collect()} == {0.0}


def test_levenshtein_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    r = random.Random(4)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randrange(5, 9))) for _ in range(30)})
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(3, 11)))
        near = [i for i, t in enumerate(terms) if distance(w, t) <= 1]
        assert trie.near(w) == (min(near) if near else None)
        if near:  # the quick test before the automaton never hides a match
            assert trie.match(w) is not None


# --- 2 SimHash


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) > len(parts))


def brute_classes(prints, radius):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("n,radius", [(20, 2), (500, 2), (300, 9)])
def test_bit_sliced_comparison(n, radius):
    r = random.Random(n)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = []
    for _ in range(n):
        x = r.choice(base)
        for _ in range(r.randrange(12)):
            x ^= 1 << r.randrange(64)
        prints.append(x)
    a = np.array(prints, np.uint64)[:, None]
    want = {(i, j) for j in range(n) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= radius}
    got = set(zip(*bitslice.near_neighbours(a, np.array([0]), np.array([n]), radius)))
    assert got == want
    short = bitslice.tree(*bitslice.near_neighbours(a, np.array([0]), np.array([n]), radius), a)
    assert len(short[0]) == n - len(set(brute_classes(prints, radius)))
    left, right = bitslice.classes(a, radius)
    assert {(min(i, j), max(i, j)) for i, j in zip(left, right)} <= want and len(left) < n
    parent = list(range(n))
    for _ in range(n):
        for i, j in zip(left, right):
            parent[i] = parent[j] = min(parent[i], parent[j])
    assert parent == brute_classes(prints, radius)


def test_simhash_classes(spark, awkward, empty):
    r = random.Random(8)
    texts = []
    for k in range(30):
        words = prose(k, 200, 3000).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(r.randrange(3)):
                copy[r.randrange(200)] = "CHANGED"
            texts.append(" ".join(copy))
    out = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows(texts), DOC)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [out[i].print[0] & (2**64 - 1) for i in range(len(texts))] == prints
    assert [out[i].component_id for i in range(len(texts))] == brute_classes(prints, 2)
    nulls = simhash.near_duplicates(spark.createDataFrame(rows([texts[0], texts[1], "unlike", "unlike"], [None, 7, None, None]), DOC)).collect()
    assert sorted(x.component_id or -1 for x in nulls) == ([-1, -1, 7, 7] if bin(prints[0] ^ prints[1]).count("1") <= 2 else [-1, -1, -1, 7])
    odd = simhash.near_duplicates(awkward).collect()
    assert len(odd) == 13
    assert {x.component_id for x in odd if x.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def brute_alike(texts, size=5, similarity=0.8):
    sets = [set(shingle_list(t.encode(), size)) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return least


def family(seed, copies, words=120, changes=8):
    """Near copies of one text, some alike and some not."""
    r = random.Random(seed)
    whole = prose(seed, words, 3000).split()
    for _ in range(copies):
        copy = list(whole)
        for _ in range(r.randrange(changes)):
            copy[r.randrange(words)] = f"changed{r.randrange(4)}"
        yield " ".join(copy)


@pytest.mark.parametrize("chunk_rows,chunk_bytes", [(1024, 1 << 24), (9, 9000)])
def test_near_duplicates_equal_brute_force(spark, awkward, empty, monkeypatch, chunk_rows, chunk_bytes):
    monkeypatch.setattr(neardup, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(neardup, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(neardup, "HEADS", 2)
    texts = ["", "a b", "A B", "   ", *family(1, 60), *family(2, 60, changes=14), *[t for k in range(3, 9) for t in family(k, 6)]]
    texts += [prose(77, 200, 3000) + " " + prose(78, 50, 3000), prose(77, 200, 3000) + " " + prose(79, 50, 3000)]  # 0.65
    docs = spark.createDataFrame(rows(texts), DOC)
    out = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs).collect()}
    want = brute_alike(texts)
    assert [out[i] for i in range(len(texts))] == want
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(want)
    odd = neardup.near_duplicates(awkward).collect()
    assert len(odd) == 13 and {x.component_id for x in odd if x.doc_id in (0, 1, 2)} == {0} and {x.component_id for x in odd if x.doc_id in (4, 5, 6, 7)} == {4, 5}
    assert [x.component_id for x in odd if x.doc_id is None] == [None]
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in neardup.keep_first(awkward).collect()) == [-1, 0, 3, 4, 5, 8, 9, 10]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_first(empty).count() == 0


def test_near_duplicates_wide_rows_and_small_joins(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    texts = [t for k in range(4) for t in family(k, 12)]
    out = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows(texts), DOC)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_alike(texts)


def test_unlike_texts_of_one_id_all_stay(spark):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    data = [(5, a, 1), (5, b, 2), (9, b, 3), (9, b, 3), (9, c, 4), (None, c, 5), (None, prose(4, 50), 6), (None, prose(4, 50), 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, near_id long").selectExpr("*", "1 near_k1", "'x' near_k2", "2 as hit_k1", "2 as nth", "map('a', 1) as near_nth")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or -1, x.text) for x in kept.collect()) == sorted([(5, a), (5, b), (9, c), (-1, prose(4, 50))])
    clean = winnow.keep_clean(docs, spark.createDataFrame([(1, b)], "item_id long, text string"))
    assert clean.columns == docs.columns and {x.text for x in clean.collect()} == {a, c, prose(4, 50)}


def test_common_counts():
    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(9000), r.randrange(0, 6000))), np.uint32) for _ in range(9)]
    got = neardup.common_counts(sets)
    assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(9) for j in range(9) if i != j)


def test_common_counts_range_by_range(monkeypatch):
    monkeypatch.setattr(neardup, "VALUES", 500)
    r = np.random.default_rng(1)
    pool = np.sort(r.integers(0, 1 << 32, 900, dtype=np.uint64).astype(np.uint32))
    sets = [np.unique(r.choice(pool, k)) for k in (0, 1, 700, 800, 850)]
    got = neardup.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5) if i != j)


def test_comparing_holds_little_memory():
    r = np.random.default_rng(2)
    n, each = 2000, 1000  # pairs of like sets, 8 MB in all
    grams = [np.unique(r.integers(0, 1 << 32, each, dtype=np.uint64).astype(np.uint32)) for _ in range(n // 2)]
    prints = r.integers(0, 1 << 62, (n // 2, 2))
    print_ = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), pa.array(np.repeat(prints, 2, axis=0).ravel()))
    columns = [pa.array(np.repeat(np.arange(n // 2), 2)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), pa.array(np.arange(n)), print_, pa.array([g.tobytes() for g in grams for _ in range(2)], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "i", "j", "node", "label", "print", "grams"])
    tracemalloc.start()
    out = [tuple(x.values()) for b in neardup._compare(neardup.radius_of(0.8), 0.8)([batch]) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(out) == [(k, k + 1) for k in range(0, n, 2)]
    assert peak < 60 << 20
    assert neardup.tasks_of(neardup.TASK_BYTES * 300, 200) == [300] and neardup.tasks_of(neardup.TASK_BYTES * 200, 200) == []


def test_large_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    r = random.Random(3)
    base = r.getrandbits(64)
    prints = sorted({base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(200)})
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(p)]) for i, p in enumerate(prints)], "node long, print array<long>")
    got = {x.node: x.root for x in components.connected_components(simhash.links(df, simhash.block_keys(2), 2)).collect()}
    want = brute_classes(prints, 2)
    assert [got.get(i, i) for i in range(len(prints))] == want


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(5, 5), (None, 3)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in parent}


# --- 3 and 7 tokens

ODD_TEXTS = ["", "  a  b ", "a\n b", "a \n b", "x <|endoftext|> y  <|endoftext|>z", "a  b   c", " lead", "trail ", "a\n\n  b\t c", "é" * 3000, "  ", "\n", "don't  we'll 123 4 5.6", "日本語 テキスト です", "  x  y", "ab" * 20_000, "🙂 🙂🙂 ‍ x"]


def many_texts():
    r = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "é", ".", "1", "'s", "<|endoftext|>", " ", "\t", "日", "😀", "the "]
    return ODD_TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)] + [prose(3, 4000), prose(4, 50) + prose(3, 4000)]


def test_token_counts(spark, awkward, empty):
    texts = many_texts()
    want = [len(c.ids) for c in tokencount.library(PATH).encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(PATH).count(texts).tolist() == want
    out = tokencount.count_tokens(spark.createDataFrame(rows([*texts, None]), DOC), PATH).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out} == {i: (len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip([*texts, ""], [*want, 0]))}
    assert tokencount.count_tokens(awkward, PATH).count() == 13 and tokencount.count_tokens(empty, PATH).count() == 0


def test_bpe_round_trip(spark, awkward, empty, monkeypatch):
    texts = many_texts()
    lib = tokencount.library(PATH)
    codes = [c.ids for c in lib.encode_batch(texts, add_special_tokens=False)]
    for limit in (10**9, 50):
        monkeypatch.setattr(bpechunk, "MEMO_CHARS", limit)
        codec = bpechunk.Codec(PATH)
        assert [x.tolist() for x in codec.encode(texts)] == codes and [x.tolist() for x in codec.encode(texts[::-1])] == codes[::-1]
        assert [codec.decode(c) for c in codes] == lib.decode_batch(codes, skip_special_tokens=False)
    assert codec.decode([200, 201, 50256]) == lib.decode([200, 201, 50256], skip_special_tokens=False)
    out = {r.doc_id: r for r in bpechunk.encode(spark.createDataFrame(rows(texts), DOC), PATH).collect()}
    assert [out[i].ids for i in range(len(texts))] == codes and [out[i].decoded for i in range(len(texts))] == texts
    short = {r.doc_id: r for r in bpechunk.encode(spark.createDataFrame(rows(texts), DOC), PATH, keep=False).collect()}
    assert all(short[i].ids_sha256 == hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(codes))
    assert bpechunk.encode(awkward, PATH).count() == 13 and bpechunk.encode(empty, PATH).count() == 0


def test_shared_passages_are_chunked_alike():
    passage = prose(9, 3000)
    a, b = (set(bpechunk.Codec(PATH)._split(x + passage)) for x in ("", "some other opening "))
    assert len(a & b) >= len(a) - 2


# --- 4 PII


def test_pii(spark, awkward, empty):
    assert pii.base_spans("mail a.b@c.de, 1.2.3.4 and 1.2.3.256; 4111 1111 1111 1111, +1 (555) 010-4477") == [
        ("email", 5, 13), ("ip", 15, 22), ("card", 38, 57), ("phone", 59, 76)
    ]
    assert pii.base_spans("9" * 5000 + " 1.2.3." + "9" * 5000) == []
    field = pii.train()
    finder = pii.Finder(field)
    held = pii.labelled_rows(300, 99)
    hit = total = wrong = 0
    for (_, spans), got in zip(held, finder.find([t for t, _ in held])):
        found = {g[:3] for g in got}
        total, hit, wrong = total + len(spans), hit + len(found & set(spans)), wrong + len(found - set(spans))
    assert hit >= 0.93 * total and wrong <= 0.05 * total
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows(["call (555) 010-4477 now", "a@b.co x", None]), DOC), field).collect()}
    assert out[0].spans == "phone:5:19" and out[0].n_phone == 0 and out[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[1].n_email == 1 and out[2].spans == ""
    masked = pii.mask(spark.createDataFrame(rows(["write a@b.co today", None]), DOC), field).collect()
    assert [r.text for r in masked] == ["write <EMAIL> today", None] and masked[0].n_chars == 19
    assert pii.find(awkward, field).count() == 13 and pii.find(empty, field).count() == 0


# Written by hand, not by the table that the field is trained on.
HAND = [
    ("Please reach Maria under maria.lopez (at) kontor (dot) example before Friday.", ["email:maria.lopez (at) kontor (dot) example"]),
    ("Contact: j_smith [at] mail-host [dot] org, thanks!", ["email:j_smith [at] mail-host [dot] org"]),
    ("For press: press(at)werk.example or the desk.", ["email:press(at)werk.example"]),
    ("my address is tom @ farm.example since May", ["email:tom @ farm.example"]),
    ("The printer answers on 10[.]0[.]0[.]17 again.", ["ip:10[.]0[.]0[.]17"]),
    ("blocked host 203 . 0 . 113 . 9 yesterday", ["ip:203 . 0 . 113 . 9"]),
    ("ping 192(.)168(.)1(.)20 failed twice", ["ip:192(.)168(.)1(.)20"]),
    ("Card no. 4111.1111.1111.1111 was charged.", ["card:4111.1111.1111.1111"]),
    ("paid with 5500/0000/0000/0004 at noon", ["card:5500/0000/0000/0004"]),
    ("call the office at (555) 010-4477 today", ["phone:(555) 010-4477"]),
    ("Tel 555-010-4477, ask for Ines", ["phone:555-010-4477"]),
    ("0049 555 0104477 is the German line", ["phone:0049 555 0104477"]),
    ("fax: 555.010.4477 or by post", ["phone:555.010.4477"]),
    ("ring 1-555-010-4477 after six", ["phone:1-555-010-4477"]),
    ("Meet me at the dot on the map, 3 pm.", []), ("Version 2.4.1 of 12/03/2024 fixed 17 bugs.", []), ("ISBN 978-3-1234-5678-0 costs 12.50 euros", []),
    ("see pages 100-104 and 210-222 of volume 7", []), ("The year 1999 (at last) ended on a Friday.", []), ("order 123456789 shipped 2024-05-06 10:30", []),
    ("a ratio of 4:3, 16:9 and 1.85", []), ("@anna wrote in #2024 about 5%", []), ("commit 9f3a77c1d0 by build 20240506", []), ("room 12.3.4 in house 7", []),
]


def test_pii_on_sentences_written_by_hand():
    hit = meant = wrong = 0
    for (t, want), got in zip(HAND, pii.Finder(pii.train()).find([t for t, _ in HAND])):
        found = {f"{k}:{t[a:b]}" for k, a, b, *_ in got}
        meant, hit, wrong = meant + len(want), hit + len(found & set(want)), wrong + len(found - set(want))
    assert meant == 14 and hit >= 10 and wrong <= 2  # recall 0.71, precision 0.83


def plain_base(text):
    """The base patterns by another regex engine, with checks of its own."""
    def passes_luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= sum(c.isdigit() for c in m) <= 19 and passes_luhn([c for c in m if c.isdigit()])),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, pattern, good in tests for m in regex.finditer(pattern, text) if good(m.group())]


def test_base_spans_equal_another_engine():
    r = random.Random(4)
    bits = ["a", "b.c", "@", ".", "-", " ", "+", "(", ")", "12", "255", "256", "0", "4111", "1111", "5500", "%", "x", "\n", "0004", "1.2.3.4", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(3000)]
    assert all(sorted(pii.base_spans(t)) == sorted(plain_base(t)) for t in texts) and sum(bool(plain_base(t)) for t in texts) > 500


def test_viterbi_equals_brute_force():
    import itertools

    field = pii.train()
    r = np.random.default_rng(0)
    for n in (1, 2, 4):
        e = r.normal(size=(n, len(pii.LABELS)))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=n), key=lambda p: sum(e[i, x] for i, x in enumerate(p)) + field.move[-1, p[0]] + sum(field.move[a, b] for a, b in zip(p, p[1:])))
        longer = r.normal(size=(n + 2, len(pii.LABELS)))
        assert tuple(field.viterbi([e, longer])[0]) == best


# --- 5 order MinHash


def test_order_minhash(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENT_BYTES", 2000)
    texts = [prose(i, random.Random(i).randrange(0, 80)) for i in range(60)] + ["", None, "ab", "é😀" * 30]
    docs = spark.createDataFrame(rows(texts), DOC).repartition(5)
    plan = segments.segment_plan(docs, 2000)
    assert len(plan.first) > 3
    out = {r.doc_id: r for r in ordermin.fingerprint_documents(docs).collect()}
    flat = [t or "" for t in texts]
    for i, t in enumerate(flat):
        after = flat[(i + 1) % len(flat)]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        assert out[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and out[i].n_chars == len(t)
        assert out[i].fingerprint == ordermin.fingerprint(t).astype(">u4").tobytes().hex()
        assert out[i].near_edited == ordermin.likeness(ordermin.fingerprint(t), ordermin.fingerprint(changed))
        assert out[i].near_next == ordermin.likeness(ordermin.fingerprint(t), ordermin.fingerprint(after))
    odd = ordermin.fingerprint_documents(awkward).collect()
    assert len(odd) == 13 and len({r.fingerprint for r in odd if r.doc_id == 8}) == 1
    assert ordermin.fingerprint_documents(empty).count() == 0
    one = ordermin.fingerprint_documents(spark.createDataFrame(rows(["hello world"]), DOC)).first()
    assert one.near_next == 1.0


def plain_order_print(text):
    """Order MinHash by its definition, one k-mer and one hash function at a time, in whole numbers."""
    if not text:
        return [0] * ordermin.ROWS
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    points = [ord(c) + 1 for c in text] + [0] * (ordermin.K - len(text))
    plain, ranked, seen = [], [], collections.Counter()
    for i in range(len(points) - ordermin.K + 1):
        h = 0
        for x in points[i : i + ordermin.K]:
            h = (h * 0x9E3779B97F4A7C15 + x) & top
        h = mix(h)
        n, seen[h] = seen[h], seen[h] + 1
        plain.append(h)
        ranked.append((mix((h + n * 0x9E3779B97F4A7C15) & top) if n else h) >> 32)
    out = []
    for r in range(ordermin.ROWS):
        value = [u * int(ordermin._ODD[r, 0]) % (1 << 32) ^ int(ordermin._ADD[r, 0]) for u in ranked]
        least = sorted(range(len(value)), key=lambda i: (value[i], i))[: ordermin.PICK]
        lo, hi = (min(least), max(least)) if len(least) > 1 else (0, 0)
        out.append(max(mix((mix(plain[lo]) * 3 + plain[hi] + r) & top) >> 32, 1))
    return out


def test_order_minhash_equals_its_definition():
    texts = ["", "a", "ab cd", "abcde", "abcdef", "aaaaaaaaaaaaaaaa", "é😀" * 9, prose(3, 60), "x y " * 40]
    for t in texts:
        assert ordermin.fingerprint(t).tolist() == plain_order_print(t)


def plain_ratios(rows):
    """Ratio and fused ratio of each tag path, from the sums written out."""
    ratio = {}
    for path in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == path]
        chars, marks, links = sum(len(r[1]) for r in own), sum(c in ".,!?:;…。，、！？؟" for r in own for c in r[1]), sum(r[2] for r in own)
        ratio[path] = chars / len(own) * (1 + marks / len(own)) * (1 - links / chars) * (0.001 if any(r[3] for r in own) else 1)
    bell = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
    smooth = [sum(bell[d] * ratio[rows[i + d][0]] for d in bell if 0 <= i + d < len(rows)) / sum(bell.values()) for i in range(len(rows))]
    fused = {}
    for path in ratio:
        near = [s for r, s in zip(rows, smooth) if r[0] == path]
        fused[path] = (ratio[path] * sum(near) / len(near)) ** 0.5
    return ratio, fused


def test_tag_path_ratios(monkeypatch):
    rows_ = htmltext.blocks(PAGE.replace("{open}", "<article>").replace("{close}", "</article>"))
    ratio, fused, _ = htmltext._ratios(rows_)
    want = plain_ratios(rows_)
    assert ratio == pytest.approx(want[0]) and fused == pytest.approx(want[1]) and len(ratio) > 6
    # without the lists the threshold alone tells the article from menus, adverts and footers
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    pages = pq.read_table(path, columns=["html"]).column(0).to_pylist()
    real = [[b[1] for b in htmltext.blocks(p or "") if "article" in b[0] and not b[3]] for p in pages]
    assert sum(htmltext.main_text(p) == "\n".join(a) for p, a in zip(pages, real)) == len(pages)
    for name in ("ASIDE", "NEVER", "ROLES"):
        monkeypatch.setattr(htmltext, name, set())
    got = [collections.Counter(htmltext.main_text(p).split("\n")) for p in pages]
    want = [collections.Counter(a) for a in real]
    both, all_got, all_want = (sum(sum(c.values()) for c in x) for x in ([g & w for g, w in zip(got, want)], got, want))
    assert both >= 0.93 * all_got and both >= 0.98 * all_want


def test_order_counts():
    a, b = "abcdefgh" * 40, "".join(reversed("abcdefgh" * 40))
    same_bag = " ".join(sorted(prose(1, 300).split())), " ".join(sorted(prose(1, 300).split(), reverse=True))
    f = lambda x, y: ordermin.likeness(ordermin.fingerprint(x), ordermin.fingerprint(y))
    assert f(a, a) == 1 and f(a, b) < 0.2 and f(*same_bag) < 0.7
    text = prose(5, 400)
    assert f(text, text.replace("w7 ", "w8 ", 1)) > 0.8


# --- 6 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav>{open}
<h1>A &amp; B</h1><p><b>First   paragraph, with commas, and words.<br>More of it. Yes.<p>Second one: it is longer, and ends here. &#233;</p>
<ul><li>item, one.</li><li>item two is here.</li></ul><form><label>Mail</label><input></form><script>var t="<p>no</p>";</script>
<div class="ad">Buy this now, it is good.</div><p>Short.</p>{close}<section id="comments"><p>A reader writes, at length, that all of it is wrong. Really.</p></section>
<aside>Related things, many of them.</aside><footer>&copy; someone</footer></body></html>"""
WANT = "A & B\nFirst paragraph, with commas, and words. More of it. Yes.\nSecond one: it is longer, and ends here. é\nitem, one.\nitem two is here.\nShort."


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>")])
def test_html(open_, close):
    assert htmltext.main_text(PAGE.replace("{open}", open_).replace("{close}", close)) == WANT


def test_html_odd(spark):
    texts = [None, "", "plain text, only. Here.", "<p>a < b, yes. <!-- open", "<p>x<script>never closed", "<" * 5000, "<div>" * 3000 + "deep text, here. ok", "<p a='>unclosed <p>more"]
    df = spark.createDataFrame([(i, "u", t, "z") for i, t in enumerate(texts)], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert len(out) == len(texts) and out[0].text == "" and out[1].n_chars == 0 and out[2].text == "plain text, only. Here." and out[3].text == "a < b, yes."
    assert htmltext.extract(df.limit(0)).count() == 0


# --- 8 decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(texts, items):
    found = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found[tuple(w[k : k + n])].add(i)
    out = []
    for t in texts:
        w, hit, which = words_of(t), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                z = found.get(tuple(w[k : k + n]))
                if z:
                    hit |= set(range(k, k + n))
                    which |= z
        out.append((len(w), len(hit), len(which), sorted(map(str, which))))
    return out


def test_one_common_run_of_words(spark):
    """A run of GRAM words of the benchmark 100,000 times in one text, and in many texts."""
    item = prose(1, 14, 90000)
    gram = " ".join(item.split()[4:9])
    texts = [" ".join([gram] * 100_000), " ".join([gram + f" u{k}" for k in range(300)]), gram + " " + item, item.upper() * 2]
    texts += [f"{gram} v{k}" for k in range(300)]
    bench = spark.createDataFrame([(1, item), (2, gram + " " + prose(2, 9))], "item_id long, text string")
    out = {r.doc_id: r for r in winnow.decontaminate(spark.createDataFrame(rows(texts), DOC), bench).collect()}
    assert [(out[i].n_words, out[i].n_hit, out[i].n_items, out[i]["items"]) for i in range(len(texts))] == brute_hits(texts, [(1, item), (2, gram + " " + prose(2, 9))])


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, awkward, empty, monkeypatch, small):
    if not small:
        monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    items = [(i, prose(100 + i, 12 + i, 60)) for i in range(12)] + [(20, "Only Three words"), (21, "single"), (22, ""), (23, None), (24, "aa " * 14), (7, prose(107, 19, 60)), (25, prose(100, 12, 60))]
    texts = []
    for i in range(40):
        item = items[i % 12][1].split()
        a, n = random.Random(i).randrange(0, 4), random.Random(i).randrange(8, 13)
        texts.append(prose(i, 30, 60) + " " + ", ".join(item[a : a + n]).upper() + " " + prose(i + 7, 9, 60))
    texts += ["x only three WORDS y", "Single!", "aa " * 40, "", None, "É " + items[0][1], items[0][1] + " " + items[1][1]]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    out = {r.doc_id: r for r in winnow.decontaminate(spark.createDataFrame(rows(texts), DOC), bench).collect()}
    assert [(out[i].n_words, out[i].n_hit, out[i].n_items, out[i]["items"]) for i in range(len(texts))] == brute_hits(texts, items)
    assert len(winnow.decontaminate(awkward, bench).collect()) == 13
    assert winnow.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in winnow.decontaminate(awkward, bench.limit(0)).collect())


# --- 9 substring dedup


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        cover = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                cover[k : k + 20] = [True] * 20
            seen.add(key)
        out.append((len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode()))
    return out


def passages():
    shared = [prose(500 + i, 19 + 6 * i) for i in range(4)]
    texts = [prose(i, 40) + " " + shared[i % 4] + " " + prose(i + 50, 30) for i in range(40)]
    return texts + [texts[3], "z " * 70, "", None, " ".join(shared), shared[2] + " " + shared[2]]


def test_substring_dedup(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(subdedup, "PART_ENTRIES", 300)
    texts = passages()
    docs = spark.createDataFrame(rows(texts), DOC).repartition(4)
    monkeypatch.setattr(subdedup, "segment_plan", lambda d: segments.segment_plan(d, 2000))
    out = {r.doc_id: r for r in subdedup.remove_repeats(docs).collect()}
    assert [(out[i].n_words, out[i].n_removed, out[i].kept) for i in range(len(texts))] == brute_repeats(texts)
    assert subdedup.remove_repeats(awkward).count() == 13 and subdedup.remove_repeats(empty).count() == 0


def test_fingerprint_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(subdedup, "INDEX_RUNS", 2)
    texts = passages()
    path = str(tmp_path / "index")
    got, other = {}, subdedup.FingerprintIndex(spark)
    for a in range(0, len(texts), 10):
        batch = rows(texts)[a : a + 10]
        index = subdedup.FingerprintIndex(spark, path)  # opened again: nothing is kept in the object
        if a == 20:  # a batch that failed left a folder behind
            (tmp_path / "index" / f"run-{index.made + 1:08d}").mkdir()
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in index.add(spark.createDataFrame(batch, DOC)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts) and len(index.runs) <= 3
    assert len(list((tmp_path / "index").glob("run-*"))) <= 6
    assert other.add(spark.createDataFrame(rows(texts[:3]), DOC)).count() == 3 and other.path != subdedup.FingerprintIndex(spark).path


def test_merge_join_verifies():
    h, c = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint16)
    assert subdedup.merge_join(np.array([5, 5, 9, 10], np.uint64), np.array([2, 7, 3, 3], np.uint16), h, c).tolist() == [True, False, True, False]
    a = subdedup.unsqueeze(subdedup.squeeze(h, c))
    assert a[0].tolist() == [5, 5, 9] and a[1].tolist() == [1, 2, 3]


# --- 10 chat


def test_chat(spark):
    r = random.Random(6)
    nasty = ["\\### Assistant: </turn> ok", "<turn user>", "\\l \\b \\\\", "", None, "plain words here", "é😀 > <"]
    turns = []
    for c in [*range(25), None]:
        if r.random() < 0.5 or c == 0:
            turns.append((c, 0, "system", "be kind <x>", "q"))
        for t in range(1, r.randrange(2, 500 if c == 3 else 12)):
            turns.append((c, t, ["user", "assistant"][t % 2], r.choice(nasty) if r.random() < 0.4 else prose(t, r.randrange(1, 400)), "q"))
    turns += [(50, 1, "assistant", "tie", "q"), (50, 1, "assistant", "tie", "q"), (50, 1, None, "no role", "q"), (50, None, "user", "no turn", "q"), (51, 0, "assistant", prose(1, 5000), "q")]
    turns += [(52, 0, "system", prose(9, 900), "q")] + [(52, t, ["user", "assistant"][t % 2], prose(t, [40, 300, 500, 1200][t % 4]), "q") for t in range(1, 30)]
    turns += [(53, 0, "system", prose(9, 4000), "q")] + [(53, t, ["user", "assistant"][t % 2], prose(t, 300), "q") for t in range(1, 30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, window string")
    windows, full = chatfmt.format_windows(df), 0
    out = {x.conv_id: x for x in chatfmt.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in turns:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert out.keys() == by.keys()
    for c, ts in by.items():
        ts.sort()
        assert out[c].n_turns == len(ts)
        assert out[c].turns == "".join(f"{x[2]}\n{x[3]}\n" for x in ts)
        assert out[c].loss_text == "".join(x[3] for x in ts if x[2] == "assistant")
    for w in windows.collect():
        body = re.findall(r"<turn ([^<>]*)>([^<>]*)</turn>\n", w.formatted)
        assert "".join(f"<turn {a}>{b}</turn>\n" for a, b in body) == w.formatted and len(body) > w.repeated
        tokens = [len(regex.findall(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]", z.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\"))) + 4 for _, z in body]
        assert sum(tokens) <= chatfmt.BUDGET or len(body) == 1
        full += sum(tokens) > chatfmt.BUDGET // 2
        assert all(t <= chatfmt.HISTORY for (r_, _), t in zip(body[: w.repeated], tokens) if r_ != "system")
        if w.conv_id == 0 and w.window > 1 and len(body) > 1:
            assert body[0] == ("system", "be kind \\lx\\g")
        if w.conv_id == 52 and w.repeated:  # a system turn of 904 tokens goes along only where it fits
            assert sum(tokens) <= chatfmt.BUDGET and {r_ for r_, _ in body[: w.repeated]} <= {"system", "user", "assistant"}
    assert full > 10
    assert chatfmt.read_back(chatfmt.format_windows(df.limit(0))).count() == 0


def test_refused_links_do_not_hide_alike_texts(spark):
    """A family at mutual similarity 0.74, each text with a partner at 0.83: partners stay together."""
    common, texts = prose(1, 600, 90000), []
    for k in range(50):
        own = prose(100 + k, 100, 90000).split()
        texts += [" ".join([common, *own]), " ".join([common, *own[:35], prose(900 + k, 65, 90000)])]
    r = random.Random(1)
    r.shuffle(texts)
    out = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows(texts), DOC)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_alike(texts)


def test_share_of_like_pairs_that_are_compared():
    """Keys and radius at similarity 0.8, as counted over drawn pairs of sets."""
    draw = np.random.default_rng(5)
    radius, met, near = neardup.radius_of(0.8), 0, 0
    for _ in range(1000):
        h = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
        a, b = np.unique(h[:450]), np.unique(h[50:])  # 400 of 500
        met += bool((neardup.band_keys(a) == neardup.band_keys(b)).any())
        near += int(np.bitwise_count(neardup.print_of(a) ^ neardup.print_of(b)).sum()) <= radius
    assert met >= 990 and near >= 995


def test_html_without_article_keeps_all_containers():
    first, second, intro = "Some words of text, in a first part. " * 5, "More words of text, in another part. " * 5, "An intro of the text, in words, that is long enough. " * 3
    note = "<div class=footer><p>All rights, reserved. By us.</p></div>"
    two = f"<html><body><div id=a><h2>One</h2><p>{first}</p></div><div id=b><h2>Two</h2><p>{second}</p></div>{note}</body></html>"
    assert htmltext.main_text(two).split("\n") == ["One", first.strip(), "Two", second.strip()]
    post = f"<body><div class=menu><p>Go home</p></div><div class=post><h1>Title</h1><p>{intro}</p><div class=text><p>{first}</p></div></div>{note}</body>"
    assert htmltext.main_text(post).split("\n") == ["Title", intro.strip(), first.strip()]


def test_values_on_awkward_rows(spark, awkward):
    """Nulls, empty and long texts, repeated rows, a null id: each operator's values, not only its row count."""
    import tokenizers

    data = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in awkward.collect()))
    ids, texts = [i if known else None for known, i, _ in data], [t for _, _, t in data]
    in_order = lambda df: sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    sizes = [len(tokenizers.Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) for t in texts]
    assert [(r.doc_id, r.n_tokens) for r in in_order(tokencount.count_tokens(awkward, PATH, 512))] == list(zip(ids, sizes))
    assert [(r.doc_id, r.n_tokens) for r in in_order(bpechunk.encode(awkward, PATH, keep=False))] == list(zip(ids, sizes))
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    digests = [hashlib.sha256(listed(plain_base(t)).encode()).hexdigest() for t in texts]
    assert [(r.doc_id, r.base_sha256) for r in in_order(pii.find(awkward))] == list(zip(ids, digests))
    # rows of one id are equal here but for doc_id 8, whose two texts are equal too
    kept = [(i, *b) for i, b in zip(ids, brute_repeats(texts))]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in subdedup.remove_repeats(awkward).collect()), key=str) == sorted(kept, key=str)
    prints = [brute_print(t) for t in texts]
    least = brute_classes(prints, 2)
    names = [min((i for i, c in zip(ids, least) if c == m and i is not None), default=None) for m in least]
    got = sorted(((r.doc_id, r.print[0] & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(awkward).collect()), key=str)
    assert got == sorted(zip(ids, prints, names), key=str)
    plain = brute_hits(texts, [(1, texts[-1])])
    out = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in winnow.decontaminate(awkward, spark.createDataFrame([(1, texts[-1])], "item_id long, text string")).collect()), key=str)
    assert out == sorted([(i, *p[:3]) for i, p in zip(ids, plain)], key=str)
