"""The stateless Column pipeline over streams, counters, and the recurrence with kept state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clean, normalize, quality


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of *.txt files as they arrive."""
    return spark.readStream.option("pathGlobFilter", "*.txt").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def cleaned(lines: DataFrame) -> DataFrame:
    """Normalised and stripped lines that stay valid."""
    out = lines.withColumn("line", normalize.normalize(F.col("line"))).withColumn("line", clean.trim(clean.clean_markup(F.col("line"))))
    return out.filter(clean.valid_line(F.col("line")))


def flag_counts(lines: DataFrame) -> DataFrame:
    """Running counts of lines and dirty lines (update mode)."""
    scored = quality.audit_line(lines.filter(~F.col("line").rlike(r"(?U)^\s*\z")))
    return scored.agg(F.count("*").alias("lines"), F.count("score").alias("flagged"))


def wkv_state(rows: DataFrame, w: float, u: float) -> DataFrame:
    """(seq, t, k, v) -> (seq, t, y): the recurrence step with (aa, bb, pp) kept for each seq."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        aa, bb, pp = state.get if state.exists else (0.0, 0.0, -1e30)
        for f in frames:
            f = f.sort_values("t")
            out = []
            for k, v in zip(f["k"], f["v"]):
                top = max(pp, u + k)
                a, b = math.exp(u + k - top), math.exp(pp - top)
                out.append(min(20.0, max(-20.0, (a * v + b * aa) / (a + b * bb + 1e-8))))
                top = max(w + pp, k)
                c, d = math.exp(w + pp - top), math.exp(k - top)
                aa, bb, pp = c * aa + d * v, c * bb + d, top
            yield pd.DataFrame({"seq": f["seq"], "t": f["t"], "y": out})
        state.update((aa, bb, pp))

    return rows.groupBy("seq").applyInPandasWithState(step, "seq long, t long, y double", "aa double, bb double, pp double", "append", GroupStateTimeout.NoTimeout)
