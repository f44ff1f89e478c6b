"""Exact values of the text, number and vector functions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.functions import clean, fmt, normalize, quality, schedule, vector
from loomwell.operators import bpe, matrix_state, segment


def values(spark, make, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text,want",
    [("Ã¡gua coraÃ§Ã£o", "água coração"), ("“A” ‘b’", "\"A\" 'b'"), ("a—b", "a-b"), ("a  b   c", "a b c"), ("a \n b", "a\nb"), ("ação", "ação"), ("é", "é"), ("xÃ\u0083¡", "xÃ¡")],
)
def test_normalise(spark, text, want):
    assert values(spark, normalize.normalize, [text]) == [want]


def whitespace_by_state(text):
    out, space, line = [], False, False
    for c in text:
        if c in " \t":
            if not space and not line:
                out.append(" ")
                space = True
        elif c == "\n":
            if not line:
                if space:
                    out.pop()
                out.append("\n")
                line, space = True, False
        else:
            out.append(c)
            space = line = False
    return "".join(out)


def test_whitespace_equals_an_automaton(spark):
    r = random.Random(0)
    texts = ["".join(r.choice("ab \t\n") for _ in range(r.randrange(12))) for _ in range(400)]
    assert values(spark, normalize.whitespace, texts) == [whitespace_by_state(t) for t in texts]


def test_markup(spark):
    long = "words that make this line long enough to be kept"
    texts = [f"{{{{Info|a{{{{x}}}}b}}}}{long}", f"[[A|label]] {long}", f"{{| x |}} {long}", f"<ref>n</ref>{long} cons- tituição", "{{" + "x" * 20_000 + "}}" + long, "short", f"a<b> {long}"]
    assert values(spark, clean.clean, texts) == [long, f"label {long}", long, f"{long} constituição", long, "", f"a {long}"]
    assert [clean.unescape_or_keep(t) for t in ("&lt;&#65;&amp;", "&lt; &nbsp;", "a & b", "&#0;", "x")] == ["<A&", "&lt; &nbsp;", "a & b", "&#0;", "x"]


def test_every_markup_step_changes_something(spark):
    from loomwell.plans import text_queries as q

    df = spark.createDataFrame([(t,) for t in q.MARKUP], "text string")
    for s in (*clean.BEFORE, clean.TEMPLATE, *clean.AFTER, *clean.LATE):
        if s.name not in ("c17", "c23"):
            assert df.filter(clean.apply(F.col("text"), s) != F.col("text")).count(), s.name
    head = spark.createDataFrame([("== T ==",), ("a\n== T ==",), ("x\n\n\n\ny",)], "text string")
    assert [r[0] for r in head.select(clean.apply(F.col("text"), clean.AFTER[-1])).collect()] == ["T\n", "a\n== T ==", "x\n\n\n\ny"]


def test_line_audit(spark):
    lines = ["A" * 60, "ok \\x41", "CAPS " * 12 + "\\x41", "﻿x", "strngthz", "plain line, nothing else", "日" * 10]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    rows = quality.audit_line(df).orderBy("i").collect()
    assert [r.score for r in rows] == [None, None, 0.9, 5.5, 0.8, None, 9.0]
    assert rows[4].reason == "Impossible Consonant Cluster (len=8)"
    kept = quality.audit_line(df).select("i", quality.purge_decision(F.col("line"), F.col("score"), F.col("reason")).alias("d")).orderBy("i").collect()
    assert [r.d for r in kept][:6] == ["kept", "kept", "garbage", "garbage", "kept", "kept"]


def test_formats(spark):
    df = spark.createDataFrame([(85_000_000, 1024, 45), (1_500_000_000, 1_500_000, 125), (768, 16_000_000_000, 3725), (395_950, 999, 0)], "n long, b long, s long")
    assert [tuple(r) for r in df.select(fmt.params(F.col("n")), fmt.size(F.col("b")), fmt.duration(F.col("s"))).collect()] == [
        ("85.0M", "1.0 KB", "45s"), ("1.50B", "1.5 MB", "2m5s"), ("768", "16.00 GB", "1h2m5s"), ("395.9K", "999 B", "0s")
    ]
    total = {n: v * m + l * (13 * 0 + 5 * m * m + 2 * m * f + 11 * m) + 4 * m for n, v, m, l, f in schedule.PRESETS}
    got = spark.createDataFrame(schedule.PRESETS, "n string, v long, m long, l long, f long").select("n", schedule.parameters(F.col("v"), F.col("m"), F.col("l"), F.col("f")).alias("p"))
    assert {r.n: r.p for r in got.collect()} == total and round(total["140m"] / 1e6, 1) == 116.7


def test_vectors(spark):
    x = [0.5, -1.0, 3.0, 3.0]
    df = spark.createDataFrame([(x, [1.0, 2.0, 3.0, 4.0])], "x array<double>, z array<double>")
    r = df.select(vector.softmax(F.col("x")).alias("p"), vector.argmax(F.col("x")).alias("a"), vector.cross_entropy(F.col("x"), F.lit(2)).alias("c"), vector.l2_distance(F.col("x"), F.col("z")).alias("d"), vector.ema(F.col("x")).alias("e"), vector.inverse_cdf(F.array(F.lit(0.2), F.lit(0.8)), F.lit(0.5)).alias("i")).first()
    e = np.exp(np.array(x) - 3)
    assert np.allclose(r.p, e / e.sum()) and r.a == 3 and math.isclose(r.c, -math.log(e[2] / e.sum())) and math.isclose(r.d, float(np.linalg.norm(np.array(x) - [1, 2, 3, 4])))
    ema = x[0]
    for v in x[1:]:
        ema = 0.99 * ema + 0.01 * v
    assert math.isclose(r.e, ema) and r.i == 1
    k, v = [0.1, -0.4, 2.0], [1.0, 2.0, -3.0]
    out = spark.createDataFrame([(k, v)], "k array<double>, v array<double>").select(vector.wkv(F.col("k"), F.col("v"), -0.5, 0.3).alias("y")).first().y
    num, den, want = 0.0, 0.0, []
    for a, b in zip(k, v):
        want.append((num + math.exp(a + 0.3) * b) / (den + math.exp(a + 0.3)))
        num, den = num * math.exp(-0.5) + math.exp(a) * b, den * math.exp(-0.5) + math.exp(a)
    assert np.allclose(out, want, atol=1e-6)


def test_matrix_state(spark):
    r = np.random.default_rng(0)
    cols = ("r", "w", "k", "v", "neg", "adapt")
    data = {c: r.normal(size=(5, 4)) * 0.3 for c in cols}
    rows = [(1, t, *[data[c][t].tolist() for c in cols]) for t in range(5)]
    df = spark.createDataFrame(rows, "seq long, t long, " + ", ".join(f"{c} array<double>" for c in cols))
    got = {x.t: x.y for x in matrix_state.run(df, 2, 2).collect()}
    s = np.zeros((2, 2, 2))
    for t in range(5):
        for h in range(2):
            p = {c: data[c][t].reshape(2, 2)[h] for c in cols}
            s[h] = s[h] * np.exp(p["w"])[None, :] + s[h] @ np.outer(p["neg"], p["adapt"]) + np.outer(p["v"], p["k"])
            assert np.allclose(got[t][2 * h : 2 * h + 2], s[h] @ p["r"])


@pytest.mark.parametrize("text,want", [("hello world", ["Ġhello", "Ġworld"]), ("a ,b", ["Ġa", "Ġ", ",", "b"]), (". a b", [".", "Ġa", "Ġb"]), ("", []), (" a", ["Ġa"]), ("(x y).z", ["(", "Ġx", "Ġy", ")", ".", "z"]), ("a  b\n", ["Ġa", "Ġb"])])
def test_pre_tokens(text, want):
    assert bpe.pre_tokens(text) == want


def test_bpe_training(spark, tmp_path):
    docs = spark.createDataFrame([("abab abab abab cab cab",)] * 5, "text string")
    words = bpe.word_counts(docs)
    vocab = bpe.train(words, 256 + 5 + 6)
    assert vocab.merges[0] == (97, 98)  # the most frequent pair, counted exactly
    vocab.save(f"{tmp_path}/v.json")
    again = bpe.Vocabulary.load(f"{tmp_path}/v.json")
    assert again.merges == vocab.merges and again.tokens == vocab.tokens
    text = "abab xyz, é [PAD] cab"
    ids = [i for w in bpe.pre_tokens(text) for i in vocab.encode_word(w)]
    assert vocab.decode(ids) == " " + text and not set(ids) & set(vocab.special.values())
    out = bpe.encode(spark.createDataFrame([(1, text)], "i int, text string"), vocab)
    assert out.first().tokens == [vocab.special["[BOS]"], *ids, vocab.special["[EOS]"]]
    back = bpe.decode(out.select("i", F.array_append("tokens", F.lit(99_999)).alias("t")), vocab, "t", "i").first().text
    assert back == "[BOS] " + text + "[EOS]"


@pytest.mark.parametrize("n", [33, 34, 64, 65, 16, 0])
def test_windows(spark, n):
    tokens = [i % 250 + 4 for i in range(n)]
    rows = segment.windows(spark.createDataFrame([(tokens,)], "t array<int>"), "t", 16).orderBy("idx").collect()
    assert len(rows) == max(0, (n - 17) // 16)
    assert all(r.input == tokens[r.idx * 16 : r.idx * 16 + 16] and r.target == tokens[r.idx * 16 + 1 : r.idx * 16 + 17] for r in rows)


def test_split_and_batches(spark):
    ids = spark.range(150).withColumnRenamed("id", "idx")
    assert segment.split_tail(ids, "idx", 150, 0.1).filter("split = 'val'").count() == 100
    assert segment.split_tail(ids, "idx", 90, 0.1).filter("idx < 90 and split = 'train'").count() == 0
    rows = segment.batches(ids, "idx", 64, "idx").orderBy("batch_id").collect()
    assert [r.n for r in rows] == [64, 64, 22] and rows[2].idx[-1] == 149


def test_positions_without_a_global_sort(spark):
    rows = [(i * 7 % 101, list(range(i % 5))) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, t array<int>").repartition(5)
    got = {r.k: r.offset for r in segment.stream_positions(df, "t", "k")[0].collect()}
    at, want = 0, {}
    for k, t in sorted(rows):
        want[k] = at
        at += len(t)
    assert got == want


def plain_training(words, size, min_pair):
    seqs = [(list(w.encode()), n) for w, n in words]
    merges, new = [], 256 + len(bpe.SPECIAL)
    while new < size:
        counts = {}
        for ids, n in seqs:
            for p in zip(ids, ids[1:]):
                counts[p] = counts.get(p, 0) + n
        pair = min(counts, key=lambda p: (-counts[p], p), default=None)
        if pair is None or counts[pair] < min_pair:
            break
        seqs = [(bpe.merged(ids, {pair: new}), n) for ids, n in seqs]
        merges.append(pair)
        new += 1
    return merges


def test_bpe_training_on_any_number_of_words(spark):
    r = random.Random(4)
    words = list({"".join(r.choice("abcde") for _ in range(r.randrange(1, 9))): r.randrange(5, 30) for _ in range(60)}.items()) + [("aaaaaaa", 9)]
    df = spark.createDataFrame(words, "word string, freq long")
    want = plain_training(words, 256 + 5 + 40, 5)
    assert len(want) == 40
    assert bpe.train(df, 256 + 5 + 40, min_pair=5).merges == want
    assert plain_training(words, 32_000, 5) == bpe.train(df, 32_000, min_pair=5).merges
    assert bpe.train(df, 256 + 5 + 40, min_pair=5, most_words=3).merges == want


def test_bpe_queries_train_as_the_reference(spark, tmp_path):
    from loomwell.plans import text_queries

    text = " ".join(["often"] * 30 + ["seldom"] * 5 + ["rarely"] * 4)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = [bytes(x.token).decode() for x in text_queries.k1(spark, str(tmp_path)).collect()]
    assert "Ġoften" in tokens and "Ġseldom" in tokens and not any("rar" in t for t in tokens)
    assert (bpe.TRAIN_FREQUENCY, bpe.VOCABULARY) == (5, 32_000)


def test_nearest_and_quotient(spark):
    rows = [(0.285, 1.0, 0.0), (-4e-6, 0.0, 0.0), (-0.0, -2.0, 0.0), (1e305, 6.0, 3.0), (float("nan"), None, 0.0), (float("-inf"), float("nan"), 0.0), (None, 1.0, None), (-2.5, 0.0, 2.0)]
    got = spark.createDataFrame(rows, "x double, a double, b double").select(vector.nearest(F.col("x"), 5), vector.nearest(F.col("x"), 0), vector.quotient(F.col("a"), F.col("b"))).collect()
    want = [(0.285, 0.0, math.inf), (-0.0, -0.0, math.nan), (-0.0, -0.0, -math.inf), (1e305, 1e305, 2.0), (math.nan, math.nan, None), (-math.inf, -math.inf, math.nan), (None, None, None), (-2.5, -3.0, 0.0)]
    assert [repr(tuple(r)) for r in got] == [repr(r) for r in want]
