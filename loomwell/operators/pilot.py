"""Vocabulary pilot: a sample of lines, a small vocabulary, a look at its tokens, a round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize, quality
from . import bpe

# Lines sampled, ids trained, least frequency, least bytes of a line, ids shown, long tokens looked for.
LINES, IDS, FREQUENCY, LEAST, SHOWN, TAIL, LONG, FOUND = 20_000, 20_000, 5, 20, (256, 306), 5_000, 10, 10
SENTENCE = "De acordo com o Art. 1º da Constituição Federal, a soberania é inalienável."


def first_lines(lines: DataFrame, count: int, *order: str) -> DataFrame:
    """The first `count` lines of more than LEAST bytes, in order."""
    return lines.filter(F.octet_length(normalize.trim(F.col("line"))) > LEAST).orderBy(*order).limit(count)


def id_slice(tokens: DataFrame, id_: str) -> DataFrame:
    return tokens.filter((F.col(id_) >= SHOWN[0]) & (F.col(id_) < SHOWN[1]))


def long_tokens(tokens: DataFrame, id_: str, text: str) -> DataFrame:
    """Of the last TAIL ids the FOUND highest whose text has more than LONG bytes; fewer ids than TAIL: of all."""
    last = tokens.agg((F.max(id_) + 1).alias("n"))
    some = tokens.join(F.broadcast(last), F.col(id_) >= F.col("n") - TAIL).filter(F.octet_length(text) > LONG)
    return some.orderBy(F.desc(id_)).limit(FOUND).drop("n")


def run(lines: DataFrame, line: str, *order: str) -> DataFrame:
    """(section, id, text): vocabulary size, slice of ids, long tokens and the test sentence after a round trip."""
    spark = lines.sparkSession
    rows = lines.withColumn("line", normalize.normalize(F.col(line))).filter(quality.hash_percent(F.col("line")) < 10)
    sample = first_lines(rows, LINES, *order).select(F.col("line").alias("text"))
    vocab = bpe.train(bpe.word_counts(sample, min_frequency=FREQUENCY), IDS, min_pair=FREQUENCY)
    tokens = spark.createDataFrame([(i, vocab.decode([i])) for i in range(len(vocab.tokens))], "id int, text string")
    coded = [i for w in bpe.pre_tokens(SENTENCE) for i in vocab.encode_word(w)]
    facts = spark.createDataFrame([("size", len(vocab.tokens), ""), ("round_trip", len(coded), vocab.decode(coded).strip())], "section string, id int, text string")
    parts = [id_slice(tokens, "id").select(F.lit("slice").alias("section"), "id", "text"), long_tokens(tokens, "id", "text").select(F.lit("long").alias("section"), "id", "text")]
    return facts.union(parts[0]).union(parts[1])
