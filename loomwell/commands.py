"""The corpus commands over folders of text: `python -m loomwell COMMAND ...`.

Rows stay in Spark; the driver sees the vocabulary, file names and totals only.  Training, generation and
GPU commands are tensor programs and not here.
"""

from __future__ import annotations

import argparse
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clean, fmt, normalize, quality, schedule
from .operators import bpe, build
from .session import ship
from .sources import text, tokenfile, wiki


def process_wiki(spark: SparkSession, input: str, output: str, min_chars: int = 200) -> DataFrame:
    """Articles of a dump, normalised and cleaned, in text shards; returns (articles, bytes)."""
    rows = wiki.articles(wiki.pages(spark, input)).select(clean.clean(normalize.normalize(F.col("text"))).alias("text"))
    text.write_shards(rows.filter(F.octet_length("text") >= min_chars), output)
    # a shard holds each article and an empty line after it
    return spark.read.text(output).agg(F.count_if(F.col("value") == "").alias("articles"), F.sum(F.octet_length("value")).alias("bytes"))


def train_tokenizer(spark: SparkSession, corpus: str, output: str, vocab_size: int = 32_000, special_tokens: str | None = None) -> bpe.Vocabulary:
    """tokenizer.json from all lines, normalised; given special tokens take the place of the usual ones."""
    names = [x.strip() for x in (special_tokens or "").split(",") if x.strip()]
    # whole files, as a line of a file that is not UTF-8 is not used either
    lines = text.whole_files(spark, corpus, "drop").select(F.explode(F.split("text", "\r?\n")).alias("line"))
    words = bpe.word_counts(lines.select(normalize.normalize(F.col("line")).alias("text")))
    vocab = bpe.train(words, vocab_size, names or None)
    os.makedirs(output, exist_ok=True)
    vocab.save(os.path.join(output, "tokenizer.json"))
    return vocab


def _write_tokens(spark: SparkSession, rows: DataFrame, target: str, *order: str) -> int:
    """One token file of the rows in order."""
    spark.dataSource.register(tokenfile.TokenFile)
    parent = os.path.dirname(os.path.abspath(target))
    os.makedirs(parent, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=parent) as parts:
        rows.orderBy(*order).select("tokens").write.format("tokenfile").mode("append").save(parts)
        return tokenfile.concatenate(parts, target)


def tokenize(spark: SparkSession, input: str, output: str, tokenizer: str) -> int:
    """train.bin of the parts between empty lines, 100 bytes or more each; returns the number of tokens."""
    parts = text.whole_files(spark, input, "lossy").select("path", F.posexplode(F.split("text", "\n\n")).alias("part", "text"))
    parts = parts.withColumn("text", normalize.trim(F.col("text"))).filter(F.octet_length("text") >= 100)
    rows = bpe.encode(parts.withColumn("text", normalize.normalize(F.col("text"))), bpe.Vocabulary.load(tokenizer))
    return _write_tokens(spark, rows, os.path.join(output, "train.bin"), "path", "part")


def clean_corpus(spark: SparkSession, input: str, output: str) -> DataFrame:
    """Each file normalised and cleaned under its own name; returns (path, before, after) in bytes."""
    rows = text.whole_files(spark, input, "empty").withColumn("cleaned", clean.clean(normalize.normalize(F.col("text"))))
    text.write_one_to_one(rows, output, text="cleaned")
    return rows.select("path", F.octet_length("text").alias("before"), F.octet_length("cleaned").alias("after"))


def audit_corpus(spark: SparkSession, input: str, output: str) -> DataFrame:
    """The report, worst files first, as text; returns (approved, rejected)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(input)
    scored = quality.score_contents(raw.select("path", "content"))
    lines = scored.select(F.lit(1).alias("n"), "score", "path", quality.report_line(F.col("score"), F.col("path"), F.col("issues")).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("n"), F.lit(0.0).alias("score"), F.lit("").alias("path"), F.lit(quality.REPORT_HEAD).alias("value"))
    head.union(lines).orderBy("n", "score", "path").select("value").write.text(output)
    good = F.col("score") >= quality.APPROVED
    return scored.agg(F.count_if(good).alias("approved"), F.count_if(~good).alias("rejected"))


def build_dataset(spark: SparkSession, tokenizer: str, output: str, sources: list[str], min_chars: int = 100, blocks: bool = True, markup: bool = False) -> int:
    """One token file of weighted sources, source by source, pass by pass; returns the number of tokens."""
    files = None
    for n, (path, weight, found) in enumerate(text.sources(spark, sources)):
        if found:
            rows = text.whole_files(spark, path, "raise").select(F.lit(n).alias("source"), F.lit(weight).alias("weight"), "path", "text")
            files = rows if files is None else files.union(rows)
    if files is None:
        files = spark.createDataFrame([], "source int, weight int, path string, text string")
    rows = build.build(files, "weight", bpe.Vocabulary.load(tokenizer), min_chars, "source", "path", markup=markup, blocks=blocks)
    return _write_tokens(spark, rows, output, "source", "pass_no", "path", "part")


def info(spark: SparkSession, model_size: str = "85m") -> DataFrame:
    """(name, parameters, seq, memory, fits) of a preset at three lengths, one row a batch; unknown sizes are the smallest."""
    name = model_size.lower().removesuffix("-v7")
    row = next((p for p in schedule.PRESETS if p[0] == name), schedule.PRESETS[0])
    rows = spark.createDataFrame([(*row, q) for q in (256, 512, 1024)], "name string, v long, m long, l long, f long, seq long")
    v, m, l, f = (F.col(c) for c in "vmlf")
    params = schedule.parameters(v, m, l, f)
    used = schedule.memory(params, v, m, l, f, F.lit(1), F.col("seq"))
    return rows.select("name", fmt.params(params).alias("parameters"), "seq", fmt.size(used).alias("memory"), (used < 15_000_000_000).alias("fits"))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomwell")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("process-wiki", "tokenize", "clean-corpus", "audit-corpus"):
        one = sub.add_parser(name)
        one.add_argument("-i", "--input", required=True)
        one.add_argument("-o", "--output", required=True)
        if name == "process-wiki":
            one.add_argument("--min-chars", type=int, default=200)
        elif name == "tokenize":
            one.add_argument("-t", "--tokenizer", required=True)
        elif name == "clean-corpus":
            one.add_argument("--verbose", action="store_true")
    one = sub.add_parser("train-tokenizer")
    one.add_argument("-c", "--corpus", required=True)
    one.add_argument("-o", "--output", required=True)
    one.add_argument("-v", "--vocab-size", type=int, default=32_000)
    one.add_argument("--special-tokens")
    one = sub.add_parser("build-dataset")
    one.add_argument("--tokenizer", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--source", action="append", required=True, help="PATH[:WEIGHT], may be repeated")
    one.add_argument("--min-chars", type=int, default=100)
    one.add_argument("--blocks", action=argparse.BooleanOptionalAction, default=True)
    one.add_argument("--clean", action="store_true")
    sub.add_parser("info").add_argument("--model-size", default="85m")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = ship(spark or SparkSession.builder.appName("loomwell").getOrCreate())
    if args.command == "process-wiki":
        process_wiki(spark, args.input, args.output, args.min_chars).show()
    elif args.command == "train-tokenizer":
        print(len(train_tokenizer(spark, args.corpus, args.output, args.vocab_size, args.special_tokens).tokens), "tokens")
    elif args.command == "tokenize":
        print(tokenize(spark, args.input, args.output, args.tokenizer), "tokens written")
    elif args.command == "clean-corpus":
        sizes = clean_corpus(spark, args.input, args.output)
        if args.verbose:
            sizes.orderBy("path").show(truncate=False)
        percent = F.when(F.sum("before") > 0, (1 - F.sum("after") / F.sum("before")) * 100).otherwise(0.0)
        sizes.agg(F.count("*").alias("files"), F.sum("before").alias("before"), F.sum("after").alias("after"), fmt.fixed(percent, 1).alias("percent")).show()
    elif args.command == "audit-corpus":
        audit_corpus(spark, args.input, args.output).show()
    elif args.command == "build-dataset":
        print(build_dataset(spark, args.tokenizer, args.output, args.source, args.min_chars, args.blocks, args.clean), "tokens written")
    else:
        info(spark, args.model_size).show(truncate=False)
