"""Commands over folders, records and errors, against values written out."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell import commands, errors
from loomwell.functions import fmt, quality, records
from loomwell.operators import bpe

LINE = "uma linha comum de texto com palavras bastante longas para que a regra dos cem bytes seja sempre cumprida aqui"


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(f"{LINE}\n{LINE}\n\n{LINE}\n", encoding="utf-8")
    (folder / "b.txt").write_text(f"{LINE}\nshort\n", encoding="utf-8")
    (folder / "c.md").write_text("not read", encoding="utf-8")
    return folder


def tokens(path):
    raw = path.read_bytes()
    ids = np.frombuffer(raw[8:], "<u2").tolist()
    assert int.from_bytes(raw[:8], "little") == len(ids)
    return ids


def test_tokenizer_build_and_tokenize(spark, tmp_path, corpus, capsys):
    commands.main(["train-tokenizer", "-c", str(corpus), "-o", str(tmp_path / "t"), "-v", "300", "--special-tokens", "[BOS], [EOS],,[X]"], spark)
    path = str(tmp_path / "t/tokenizer.json")
    vocab = bpe.Vocabulary.load(path)
    assert vocab.special == {"[BOS]": 256, "[EOS]": 257, "[X]": 258} and len(vocab.tokens) <= 300
    commands.main(["build-dataset", "--tokenizer", path, "--output", str(tmp_path / "d/train.bin"), "--source", f"{corpus}:2", "--source", f"{corpus}/b.txt"], spark)
    ids = tokens(tmp_path / "d/train.bin")
    # two passes of the two blocks of a and the one line of b that is long enough, then b once more
    assert ids.count(256) == ids.count(257) == 2 * 3 + 1
    pieces = [vocab.decode(list(map(int, x.split(",")))) for x in ",".join(map(str, ids)).removeprefix("256,").removesuffix(",257").split(",257,256,")]
    one, two = f" {LINE}", f" {LINE} {LINE}"
    assert pieces == [two, one, one] * 2 + [one]
    commands.main(["build-dataset", "--tokenizer", path, "--output", str(tmp_path / "d/l.bin"), "--source", str(corpus), "--no-blocks"], spark)
    assert tokens(tmp_path / "d/l.bin").count(256) == 4
    commands.main(["tokenize", "-i", str(corpus), "-o", str(tmp_path / "k"), "-t", path], spark)
    assert tokens(tmp_path / "k/train.bin").count(256) == 3
    assert "tokens written" in capsys.readouterr().out


def test_clean_audit_and_info(spark, tmp_path, corpus, capsys):
    (corpus / "sub").mkdir()
    (corpus / "sub/d.txt").write_bytes(b"a\xffb")
    commands.main(["audit-corpus", "-i", str(corpus), "-o", str(tmp_path / "report")], spark)
    rows = [r.value for p in sorted((tmp_path / "report").glob("part-*")) for r in spark.read.text(str(p)).collect()]
    assert rows[0] == "SCORE\tPATH\tISSUES" and len(rows) == 4
    assert [r.split("\t")[2] for r in rows[1:]] == ['["Muito curto"]', '["Muito curto"]', '["Erro leitura"]']
    (corpus / "e.txt").write_text(f"[[x|{LINE}]]\n{{{{box}}}}\n", encoding="utf-8")
    commands.main(["clean-corpus", "-i", str(corpus), "-o", str(tmp_path / "clean"), "--verbose"], spark)
    got = {r.file: r.value.strip() for r in spark.read.text(str(tmp_path / "clean"), wholetext=True).select("file", "value").collect()}
    assert got.keys() == {"a.txt", "b.txt", "e.txt"} and got["e.txt"] == LINE and got["b.txt"] == LINE
    commands.main(["info", "--model-size", "unknown"], spark)
    assert "140m" in capsys.readouterr().out


def test_process_wiki(spark, tmp_path):
    page = "<page><title>T</title><ns>0</ns><revision><text>{}</text></revision></page>"
    (tmp_path / "d.xml").write_text(f"<mediawiki>{page.format((LINE + chr(10)) * 3)}{page.format(LINE)}</mediawiki>", encoding="utf-8")
    row = commands.process_wiki(spark, str(tmp_path / "d.xml"), str(tmp_path / "out")).first()
    assert row.articles == 1 and row.bytes == 3 * len(LINE)


def test_an_empty_folder_builds_an_empty_file(spark, tmp_path):
    (tmp_path / "none").mkdir()
    bpe.Vocabulary.base().save(str(tmp_path / "v.json"))
    with pytest.warns(UserWarning):
        assert commands.build_dataset(spark, str(tmp_path / "v.json"), str(tmp_path / "x.bin"), [str(tmp_path / "none"), str(tmp_path / "nowhere")]) == 0
    assert tokens(tmp_path / "x.bin") == []


def test_records(spark):
    df = spark.createDataFrame([(7, 12, 2.5, 3e-4, 0.125)], "t long, i long, x double, r double, g double")
    t, i, x, r, g = (F.col(c) for c in "tixrg")
    got = df.select(
        records.step_line(t, i, x, r, g), records.eval_line(t, i, x, F.exp(x)), records.checkpoint_line(t, i, F.lit("a/b")), records.epoch_line(t, i), records.sample_line(t, F.lit("p"), F.repeat(F.lit("é"), F.lit(150))),
        records.meta_text(i, r, x, x, g), records.evaluation_text(x, F.exp(x), i), records.validation_text(x, F.exp(x), g, g, x), records.generation_record(F.lit('a"'), F.lit("b"), i, F.lit("1b"), F.lit(0.8), F.lit(40)),
    ).first()
    assert list(got) == [
        "[     7s] Step     12 | Loss: 2.5000 | PPL:    12.18 | LR: 3.00e-4 | GradNorm: 0.1250", "[     7s] EVAL Step     12 | Loss: 2.5000 | PPL: 12.18",
        "[     7s] CHECKPOINT Step 12 -> a/b", "[     7s] === EPOCH 12 ===", f'[     7s] SAMPLE: "p" -> "{"é" * 100}"',
        "step=12\nlr=3.000000e-4\nema_loss=2.500000\nbest_loss=2.500000\nlast_update_norm=0.125000\n", "Loss: 2.5000 | PPL: 12.18 | Tokens: 12",
        "Loss: 2.5000 | PPL: 12.18 | Acc@1: 12.50% | Acc@5: 12.50% | H: 2.50",
        '{"full_text":"a\\"b","generated_text":"b","model_size":"1b","prompt":"a\\"","temperature":0.800000011920929,"tokens_generated":12,"top_k":40}',
    ]


def test_side_files_read_back(spark):
    texts = ["step=5\nema_loss=1.5\nbest_loss=2", "step=x\nema_loss=\nbest_loss=?", " step=5", "", "step=1\nstep=2\r\nema_loss=3"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, meta string")
    got = [tuple(r) for r in df.orderBy("n").select(*records.parse_meta(F.col("meta")).values()).collect()]
    assert got == [(5, 1.5, 2.0), (0, 10.0, fmt.FLOAT_MAX), (None, None, None), (None, None, None), (2, 3.0, None)]


def test_error_kinds():
    found = errors.KINDS["FileNotFound"](path="x")
    assert isinstance(found, FileNotFoundError) and isinstance(found, errors.LoomwellError) and str(pickle.loads(pickle.dumps(found))) == "File not found: x"
    assert len(errors.KINDS) == 15 and str(errors.KINDS["UnknownToken"](id=7)) == "Unknown token ID: 7"


def test_unreadable_contents(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a\xff")), (2, bytearray(b"ok")), (3, bytearray())], "n int, content binary")
    got = {r.n: (r.score, r.bytes, r.issues) for r in quality.score_contents(rows).collect()}
    assert got == {1: (0.0, 0, ["Erro leitura"]), 2: (0.0, 2, ["Muito curto"]), 3: (0.0, 0, ["Muito curto"])}
