"""Text, wiki and token-file sources; streams."""

import bz2

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.functions import vector
from loomwell.sources import text, tokenfile, wiki
from loomwell.streaming import streams

DUMP = """<mediawiki>
<page><title>T0</title><ns>0</ns><revision><text>{long} &amp; more</text></revision></page>
<page><title>2020-01-01</title><ns>1</ns><revision><text>{long}</text></revision></page>
<page><title>R</title><ns>0</ns><revision><text>#REDIRECT [[T0]] {long}</text></revision></page>
<page><title>S</title><ns>0</ns><revision><text>short</text></revision></page>
<page><title>L</title><ns>0</ns><revision><text>first {long}</text><text>last {long}</text></revision></page>
</mediawiki>""".replace("{long}", "word " * 40)


def test_wiki_dump(spark, tmp_path):
    raw = DUMP.encode()
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(raw[:300]) + bz2.compress(raw[300:]))
    rows = wiki.pages(spark, str(tmp_path / "d.xml.bz2"))
    assert rows.count() == 5
    kept = {r.title: r.text for r in wiki.articles(rows).collect()}
    assert kept.keys() == {"T0", "L"} and "& more" in kept["T0"] and kept["L"].startswith("last")


def test_invalid_utf8(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\xffb")
    (tmp_path / "b.txt").write_bytes("é".encode())
    (tmp_path / "c.md").write_bytes(b"no")
    got = {how: sorted(r.text for r in text.whole_files(spark, str(tmp_path), how).collect()) for how in ("empty", "lossy", "drop")}
    assert got == {"empty": ["", "é"], "lossy": ["a�b", "é"], "drop": ["é"]}
    with pytest.raises(Exception, match="INVALID_UTF8"):
        text.whole_files(spark, str(tmp_path), "raise").collect()


def test_token_file(spark, tmp_path):
    spark.dataSource.register(tokenfile.TokenFile)
    chunks = [(0, [1, 2, 3, 4, 5]), (1, [100, 101, 65535])]
    spark.createDataFrame(chunks, "n int, tokens array<int>").orderBy("n").coalesce(1).select("tokens").write.format("tokenfile").mode("append").save(str(tmp_path / "out"))
    assert tokenfile.concatenate(str(tmp_path / "out"), str(tmp_path / "t.bin")) == 8
    raw = (tmp_path / "t.bin").read_bytes()
    assert int.from_bytes(raw[:8], "little") == 8 and np.frombuffer(raw[8:], "<u2").tolist() == [1, 2, 3, 4, 5, 100, 101, 65535]
    back = spark.read.format("tokenfile").load(str(tmp_path / "t.bin")).orderBy("pos").collect()
    assert [r.token for r in back] == [1, 2, 3, 4, 5, 100, 101, 65535]
    (tmp_path / "bad.bin").write_bytes((9).to_bytes(8, "little") + b"\0\0")
    with pytest.raises(ValueError):
        tokenfile.TokenReader(str(tmp_path / "bad.bin"))


def test_shards(spark, tmp_path):
    text.write_shards(spark.createDataFrame([(f"a{i}",) for i in range(25)], "text string").coalesce(1), str(tmp_path / "s"), rows=10)
    assert len(list((tmp_path / "s").glob("part-*"))) == 3


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    keep = "these are ordinary words in an ordinary line of text"
    (tmp_path / "in/a.txt").write_text(f"[[x|{keep}]]\nshort\n\nSTRNGTHZ KRZPTW\n", encoding="utf-8")
    lines = streams.text_stream(spark, str(tmp_path / "in"))
    run = streams.cleaned(lines).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [r.line for r in spark.table("cleaned").collect()] == [keep]
    run = streams.flag_counts(lines).writeStream.outputMode("complete").format("memory").queryName("flags").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert tuple(spark.table("flags").first()) == (3, 1)


def test_stateful_recurrence(spark, tmp_path):
    r = np.random.default_rng(1)
    k, v = r.normal(size=12).tolist(), r.normal(size=12).tolist()
    rows = [(s, t, k[t] + s, v[t]) for s in range(2) for t in range(12)]
    for i, part in enumerate((rows[:6] + rows[12:18], rows[6:12] + rows[18:])):
        spark.createDataFrame(part, "seq long, t long, k double, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq long, t long, k double, v double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    run = streams.wkv_state(stream, -0.5, 0.3).writeStream.format("memory").queryName("wkv").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(x.seq, x.t): x.y for x in spark.table("wkv").collect()}
    whole = spark.createDataFrame([(s, [x + s for x in k], v) for s in range(2)], "seq long, k array<double>, v array<double>")
    for x in whole.select("seq", F.posexplode(vector.wkv(F.col("k"), F.col("v"), -0.5, 0.3)).alias("t", "y")).collect():
        assert abs(got[(x.seq, x.t)] - x.y) < 1e-9
