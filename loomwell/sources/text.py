"""Text scans and sinks, source specs, path resolution."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors


def _file_system(spark: SparkSession, path: str):
    """The path's Hadoop file system and the path itself: any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def listing(spark: SparkSession, path: str) -> list[str]:
    """The *.txt files right under a folder, sorted by path; a single file is itself, whatever its name."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    if fs.getFileStatus(target).isFile():
        return [path]
    found = [x for x in fs.listStatus(target) if x.isFile() and x.getPath().getName().endswith(".txt")]
    return sorted(f"{path.rstrip('/')}/{x.getPath().getName()}" for x in found)


def sources(spark: SparkSession, specs: list[str]) -> list[tuple[str, int, list[str]]]:
    """(path, weight, files) of each `path[:weight]`; a path that does not exist is left out with a warning."""
    out = []
    for spec in specs:
        head, _, tail = spec.rpartition(":")
        digits = tail.removeprefix("+")
        path, weight = (head, max(int(digits), 1)) if head and digits.isascii() and digits.isdigit() else (spec, 1)
        if exists(spark, path):
            out.append((path, weight, listing(spark, path)))
        else:
            warnings.warn(f"source does not exist: {path}", stacklevel=2)
    return out


def resolve_dataset(spark: SparkSession, path: str, name: str = "train.bin") -> str:
    """`name` inside the folder if it is there, else the path itself if it is a .bin file.

    For validation data (val.bin) a path that is neither is returned as it is; for training data that is an error.
    """
    inside = f"{path.rstrip('/')}/{name}"
    if name != "train.bin" and path.endswith(".bin"):
        return path
    if exists(spark, inside):
        return inside
    if path.endswith(".bin") or name != "train.bin":
        return path
    raise errors.KINDS["FileNotFound"](path=path)


def whole_files(spark: SparkSession, path: str, invalid: str = "lossy", recursive: bool = False) -> DataFrame:
    """(path, text) of *.txt files.  Invalid UTF-8: "empty", "lossy", "raise" or "drop"."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive).load(path)
    text = F.col("content").cast("string")
    return _policy(raw.select("path", text.alias("text")), "text", invalid)


def line_files(spark: SparkSession, path: str, invalid: str = "raise") -> DataFrame:
    """(path, line) of *.txt files."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return _policy(raw, "line", invalid)


def _policy(df: DataFrame, name: str, invalid: str) -> DataFrame:
    c = F.col(name)
    if invalid == "drop":
        return df.filter(F.is_valid_utf8(c))
    how = {"empty": F.when(F.is_valid_utf8(c), c).otherwise(""), "lossy": F.make_valid_utf8(c), "raise": F.validate_utf8(c)}
    return df.withColumn(name, how[invalid])


def source_spec(spec: Column) -> tuple[Column, Column]:
    """`path[:weight]`, cut at the last colon; a weight of 0 or none is 1."""
    fits = spec.rlike(r"^(?s).*:\+?\d+\z")
    path = F.when(fits, F.regexp_extract(spec, r"(?s)^(.*):\+?(\d+)\z", 1)).otherwise(spec)
    weight = F.when(fits, F.greatest(F.regexp_extract(spec, r"(?s)^(.*):\+?(\d+)\z", 2).try_cast("int"), F.lit(1))).otherwise(1)
    return path, F.coalesce(weight, F.lit(1))


def write_shards(df: DataFrame, path: str, text: str = "text", rows: int = 10_000) -> None:
    """Text files of at most `rows` articles, each followed by an empty line."""
    df.select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.option("maxRecordsPerFile", rows).text(path)


def write_one_to_one(df: DataFrame, path: str, source: str = "path", text: str = "text") -> None:
    """Each input file's text under a folder of the same file name (file=NAME): one task each, nothing collected."""
    name = F.element_at(F.split(source, "/"), -1)
    df.select(F.col(text).alias("value"), name.alias("file")).repartition("file").write.partitionBy("file").text(path)


def write_purged(lines: DataFrame, source: str, path: str, decision: str = "decision", line: str = "line") -> None:
    """The kept lines, in a new folder: what is being read is never overwritten."""
    if path.rstrip("/") == source.rstrip("/"):
        raise ValueError("the purged lines need a folder of their own")
    lines.filter(F.col(decision) == "kept").select(F.col(line).alias("value")).write.text(path)
