"""The dataset build: sources to documents to token rows, and windows over the whole token stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as cleaner
from ..functions import normalize
from . import bpe, segment


def documents_of(files: DataFrame, text: str, *keys: str, blocks: bool = True) -> DataFrame:
    """(keys, part, text): blocks of files that hold an empty line, lines of the others (of all, without `blocks`), parts from 0.

    A block is a run of lines with something on them, joined by line breaks.  No row leaves its file's task.
    """
    lines = F.split(F.regexp_replace(text, "\r+\n|\r+\\z", "\n"), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, line):
        blank = line.rlike(r"(?U)^\s*\z")
        closes = blank & (acc["open"] != "")
        done = F.when(closes, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(blank, "").otherwise(F.concat(acc["open"], line, F.lit("\n"))).alias("open"))

    ended = F.concat(lines, F.array(F.lit("")))
    runs = F.aggregate(ended, start, step, lambda acc: acc["done"])
    parts = F.when(segment.has_blank_line(F.col(text)), runs).otherwise(lines) if blocks else lines
    return files.select(*keys, F.posexplode(parts).alias("part", "text"))


def flush(docs: DataFrame, least: int, compose: bool = True, markup: bool = False) -> DataFrame:
    """Trim, drop what has fewer than `least` bytes, normalise, clean if asked, drop again."""
    rows = docs.withColumn("text", normalize.trim(F.col("text"))).filter(F.octet_length("text") >= least)
    text = normalize.normalize(F.col("text"), compose=compose)
    rows = rows.withColumn("text", cleaner.clean(text) if markup else text)
    return rows.filter(F.octet_length("text") >= least)


def encode(docs: DataFrame, vocab: bpe.Vocabulary) -> DataFrame:
    """Adds tokens, [BOS] and [EOS] around, and n_tokens."""
    return bpe.encode(docs, vocab).withColumn("n_tokens", F.size("tokens").cast("long"))


def build(files: DataFrame, weight: str, vocab: bpe.Vocabulary, least: int, *keys: str, markup: bool = False, blocks: bool = True) -> DataFrame:
    """(keys, pass_no, part, tokens, n_tokens): each file's documents once for each pass of its source.

    Texts are cut, normalised and encoded once; passes repeat the finished rows.
    """
    rows = documents_of(files, "text", weight, *keys, blocks=blocks)
    rows = encode(flush(rows, least, markup=markup), vocab)
    return segment.replicate(rows, weight).select(*keys, "pass_no", "part", "tokens", "n_tokens")


def stream_windows(rows: DataFrame, tokens: str, order: str, length: int) -> DataFrame:
    """(idx, input, target) of every window of `length` of the rows' tokens in one stream, in the order of a numeric key.

    A window reads length + 1 tokens, windows begin every `length`; there are (n - length - 1) / length of
    them, whole division, of n tokens.  Rows are placed by prefix sums (segment.stream_positions), cut
    where windows begin, and only the pieces of one window meet.
    """
    placed, total = segment.stream_positions(rows.filter(F.size(tokens) > 0), tokens, order)
    count = max(0, (total - length - 1) // length)
    first = F.greatest(F.floor((F.col("offset") - 1) / length), F.lit(0))
    last = F.least(F.floor((F.col("offset") + F.size(tokens) - 1) / length), F.lit(count - 1))

    def piece(i):
        low = F.greatest(i * length, F.col("offset"))
        high = F.least(i * length + length, F.col("offset") + F.size(tokens) - 1)
        return F.struct(i.alias("idx"), low.alias("at"), F.slice(tokens, (low - F.col("offset") + 1).cast("int"), (high - low + 1).cast("int")).alias("t"))

    some = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    pieces = placed.select(F.explode(F.transform(some, piece)).alias("p")).select("p.*")
    whole = pieces.groupBy("idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"])).alias("t"))
    return whole.select("idx", F.slice("t", 1, length).alias("input"), F.slice("t", 2, length).alias("target"))
