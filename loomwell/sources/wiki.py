"""Wiki dumps through the XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("ns", T.IntegerType()),
    T.StructField("revision", T.StructType([T.StructField("text", T.ArrayType(T.StringType()))])),
])
MIN_BYTES = 100


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, text) of every page of an .xml or .xml.bz2 dump; of several texts the last."""
    raw = spark.read.format("xml").option("rowTag", "page").option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", False).schema(PAGE).load(path)
    return raw.select("title", "ns", F.element_at("revision.text", -1).alias("text"))


def is_redirect(text: Column) -> Column:
    low = F.lower(text)
    return F.startswith(low, F.lit("#redirect")) | F.startswith(low, F.lit("#redirecionamento"))


def articles(df: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    return df.filter((F.col("ns") == 0) & (F.octet_length("text") >= min_bytes) & (F.col("title") != "") & ~is_redirect(F.col("text")))
