"""The dataset build, windows over the stream, reports and vector operations, against values written out."""

import pytest
from pyspark.sql import functions as F

from loomwell.functions import fmt, schedule, vector
from loomwell.operators import bpe, build, pilot, segment
from loomwell.sources import text


def test_documents_are_blocks_or_lines(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n \nc d\r\n\r\n\n"), (2, "x\n  y \n"), (3, ""), (4, "\n\n\n"), (5, None)], "doc_id int, text string")
    got = [tuple(r) for r in build.documents_of(df, "text", "doc_id").orderBy("doc_id", "part").collect()]
    assert got == [(1, 0, "a\nb\n"), (1, 1, "c d\n"), (2, 0, "x"), (2, 1, "  y "), (2, 2, ""), (3, 0, "")]


def test_build_filters_twice_encodes_and_repeats(spark):
    keep, shrinks = "palavra " * 20, "a" + " " * 200 + "b"
    files = spark.createDataFrame([(1, keep + "\n" + shrinks + "\nshort", 2), (2, keep.upper(), 0), (3, None, 1)], "doc_id int, text string, weight int")
    out = build.build(files, "weight", bpe.Vocabulary.base(), 100, "doc_id").orderBy("doc_id", "pass_no", "part").collect()
    assert [(r.doc_id, r.pass_no, r.part) for r in out] == [(1, 1, 0), (1, 2, 0), (2, 1, 0)]
    assert out[0].tokens[0] == 258 and out[0].tokens[-1] == 259 and out[0].n_tokens == len(out[0].tokens)
    assert bpe.Vocabulary.base().decode(out[0].tokens[1:-1]) == " " + keep.strip()


@pytest.mark.parametrize("n,length", [(1000, 64), (129, 64), (128, 64), (65, 64), (3, 32), (0, 8), (2000, 7)])
def test_stream_windows(spark, n, length):
    stream = [i % 250 + 4 for i in range(n)]
    cuts = sorted({0, n, *[x for x in (1, 2, 70, 71, 400) if x < n]})
    rows = [(k, stream[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(99, [])]
    got = build.stream_windows(spark.createDataFrame(rows, "doc_id long, tokens array<int>"), "tokens", "doc_id", length).orderBy("idx").collect()
    assert len(got) == max(0, (n - length - 1) // length)
    for i, r in enumerate(got):
        assert r.idx == i and r.input == stream[i * length : i * length + length] and r.target == stream[i * length + 1 : i * length + length + 1]


def test_windows_of_an_array_have_no_copies(spark):
    df = spark.createDataFrame([(1, list(range(200)))], "k int, t array<int>")
    got = segment.windows(df, "t", 64, "k").orderBy("idx").collect()
    assert [(r.idx, r.input[0], r.target[-1]) for r in got] == [(0, 0, 64), (1, 64, 128)]


def test_vector_operations(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [float("nan"), float("inf")])], "a array<double>, bad array<double>")
    one = df.select(
        vector.softmax(F.col("a")).alias("p"), vector.log_sum_exp(F.col("a")).alias("l"), vector.finite_or_zero(F.col("bad")).alias("z"), vector.finite_or_zero(F.col("a")).alias("f"),
        F.transform("a", vector.gelu).alias("g"), vector.group_norm(F.col("a"), 2, 2).alias("n"),
    ).first()
    assert [round(x, 6) for x in one.p] == [0.032059, 0.087144, 0.236883, 0.643914] and round(one.l, 6) == 4.44019
    assert [tuple(x) for x in one.z] == [(0, 0.0)] and [tuple(x) for x in one.f] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    assert [round(x, 5) for x in one.g] == [0.84134, 1.9545, 2.99595, 3.99987]
    assert [round(x, 5) for x in one.n] == [-0.99872, 0.99872, -0.99872, 0.99872]


def test_softmax_of_many_values(spark):
    p = spark.range(1).select(vector.softmax(F.transform(F.sequence(F.lit(1), F.lit(32_000)), lambda i: (i % 7).cast("double"))).alias("p")).first().p
    assert len(p) == 32_000 and abs(sum(p) - 1) < 1e-9


def test_report_lines(spark):
    df = spark.createDataFrame([(100, 51200, 2, 1.5, 2.25, 64), (0, 0, 0, fmt.FLOAT_MAX, 1.0, 0)], "s long, t long, e long, b double, v double, w long")
    got = [r[0] for r in df.select(fmt.training_summary(*[F.col(c) for c in "stebvw"])).collect()]
    assert got[0] == "Steps: 100 | Tokens: 51200 | Epochs: 2 | Best Loss: 1.5000 | Best Eval: 2.2500 | Time: 64s | 0.8K tok/s"
    assert got[1] == "Steps: 0 | Tokens: 0 | Epochs: 0 | Best Loss: 340282346638528859811704183484516925440.0000 | Best Eval: 1.0000 | Time: 0s | 0.0K tok/s"
    rates = spark.createDataFrame([(3e-4,), (1e-5,), (1.0,), (25.0,), (1e-12,)], "x double")
    assert [r[0] for r in rates.select(fmt.scientific(F.col("x"), 2)).collect()] == ["3.00e-4", "1.00e-5", "1.00e0", "2.50e1", "1.00e-12"]
    verdict = vector.shape_verdict(*[F.lit(x) for x in (2, 3, 4, 23, 24, 4, 4)])
    assert spark.range(1).select(verdict).first()[0] == "expected B*T*C = 24, got k=23, v=24"


def test_initial_values(spark):
    rows = {(r.layer, r.channel): r for r in schedule.initial_values(spark, 3, 5).collect()}
    assert [round(rows[0, c].decay, 4) for c in range(5)] == [-4.0, -3.1, -2.2, -1.3, -0.4] and rows[2, 0].decay == -5.0
    assert [rows[0, c].first for c in range(5)] == [-0.5, -0.25, 0.0, 0.25, 0.5] and rows[2, 4].mix_k == 1.0 and round(rows[1, 2].mix_v, 6) == 0.857107


def test_special_names_and_pilot(spark):
    assert bpe.Vocabulary.base(special=["[A]"], more=["[B]", "[A]"]).special == {"[A]": 256, "[B]": 257}
    assert bpe.Vocabulary.base(special=["[A]"]).pad == 0 and bpe.Vocabulary.base().pad == 256
    with pytest.raises(KeyError):
        bpe.Vocabulary.base(special=["[BOS]"]).edges()
    tokens = spark.createDataFrame([(i, "x" * (i % 20)) for i in range(30)], "id int, text string")
    assert [r.id for r in pilot.long_tokens(tokens, "id", "text").collect()] == [19, 18, 17, 16, 15, 14, 13, 12, 11]
    lines = spark.createDataFrame([(i, f"uma linha comum de texto {i % 3} com palavras bastante longas") for i in range(600)], "n int, line string")
    got = {(r.section, r.id): r.text for r in pilot.run(lines, "line", "n").collect()}
    assert got[("slice", 256)] == "[PAD]" and pilot.SENTENCE in got.values()


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("b.txt", "a.txt", "c.md"):
        (folder / name).write_text(f"text of {name}\nmore")
    assert [p.rsplit("/", 1)[1] for p in text.listing(spark, str(folder))] == ["a.txt", "b.txt"] and text.listing(spark, str(folder / "c.md")) == [str(folder / "c.md")]
    with pytest.warns(UserWarning, match="nowhere"):
        found = text.sources(spark, [f"{folder}:3", f"{tmp_path}/nowhere", f"{folder}/a.txt"])
    assert [(w, len(f)) for _, w, f in found] == [(3, 2), (1, 1)]
    with pytest.raises(FileNotFoundError):
        text.resolve_dataset(spark, str(folder))
    (folder / "train.bin").write_bytes(b"")
    assert text.resolve_dataset(spark, str(folder)).endswith("/train.bin") and text.resolve_dataset(spark, "x.bin", "val.bin") == "x.bin"
    assert text.resolve_dataset(spark, str(folder), "val.bin") == str(folder)
    text.write_one_to_one(text.whole_files(spark, str(folder)), str(tmp_path / "one"))
    back = spark.read.text(str(tmp_path / "one"), wholetext=True).select("file", "value").collect()
    assert {(r.file, r.value.strip()) for r in back} == {("a.txt", "text of a.txt\nmore"), ("b.txt", "text of b.txt\nmore")}
    lines = spark.createDataFrame([("x", "kept"), ("y", "garbage")], "line string, decision string")
    text.write_purged(lines, str(folder), str(tmp_path / "purged"))
    assert [r.value for r in spark.read.text(str(tmp_path / "purged")).collect()] == ["x"]
    with pytest.raises(ValueError):
        text.write_purged(lines, str(folder), str(folder) + "/")
