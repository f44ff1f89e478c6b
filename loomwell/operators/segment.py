"""Documents, lines, blocks, windows, splits, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_VALIDATION = 100


def lines(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """One row for each line: keys, line_no from 0, line."""
    return df.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def blocks(df: DataFrame, path: str = "path", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Runs of non-blank lines of a file, joined by line breaks: (path, block_no, block)."""
    order = Window.partitionBy(path).orderBy(line_no)
    blank = F.col(line).rlike(r"(?U)^\s*\z")
    cut = df.withColumn("__blank", blank).withColumn("__n", F.sum(F.col("__blank").cast("long")).over(order)).filter("not __blank")
    parts = cut.groupBy(path, "__n").agg(F.sort_array(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col(line).alias("s")))).alias("p"))
    made = parts.select(path, "__n", F.array_join(F.transform("p", lambda x: x["s"]), "\n").alias("block"))
    return made.select(path, (F.row_number().over(Window.partitionBy(path).orderBy("__n")) - 1).alias("block_no"), "block")


def has_blank_line(content: Column, head: int = 1 << 20) -> Column:
    """Whether the first MiB (bytes) holds an empty line: block mode or line mode."""
    return F.contains(F.substring(F.encode(content, "UTF-8"), 1, head), F.lit(b"\n\n"))


def replicate(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Each row once for each full pass of its source: adds pass_no."""
    return df.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.greatest(F.col(weight).cast("int"), F.lit(1)))))


def window_count(n: Column, length: int) -> Column:
    return F.greatest(F.floor((n - length - 1) / length), F.lit(0))


def windows(df: DataFrame, tokens: str, length: int, *keys: str) -> DataFrame:
    """(keys, idx, input, target) of every window of an array of tokens; stride = length."""
    count = window_count(F.size(tokens), length).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    # slices are cut before the rows are made, so no row carries the whole array
    made = F.transform(at, lambda i: F.struct(i.alias("idx"), F.slice(tokens, i * length + 1, length).alias("input"), F.slice(tokens, i * length + 2, length).alias("target")))
    return df.select(*keys, F.explode(made).alias("w")).select(*keys, "w.idx", "w.input", "w.target")


BUCKETS = 256


def range_bucket(df: DataFrame, key: str, buckets: int = BUCKETS) -> Column:
    """Bucket number that grows with a numeric key; bounds are approximate quantiles."""
    at = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, at, 10 * buckets)).first()[0] or []))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key)))


def row_numbers(df: DataFrame, name: str, bucket: Column, *order) -> DataFrame:
    """Adds `name`, the position from 0 in the order, without sorting everything in one task.

    `bucket` must not fall along the order.  Rows are numbered inside their bucket; the sizes of
    the buckets, a table of one row for each, give what comes before.
    """
    rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__size"))
    before = sizes.select("__b", (F.sum("__size").over(Window.orderBy("__b")) - F.col("__size")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return rows.join(F.broadcast(before), "__b").withColumn(name, nth + F.col("__before")).drop("__b", "__before")


def stream_positions(df: DataFrame, tokens: str, key: str) -> tuple[DataFrame, int]:
    """df with the global offset of each row's first token, in the order of a numeric key, and the number of all tokens."""
    rows = df.withColumn("__b", range_bucket(df, key)).withColumn("__n", F.size(tokens).cast("long"))
    # one row for each bucket, BUCKETS at most
    sums = sorted((r[0], r[1]) for r in rows.groupBy("__b").agg(F.sum("__n")).collect())
    starts, total = [], 0
    for bucket, n in sums:
        starts.append((bucket, total))
        total += n
    before = df.sparkSession.createDataFrame(starts, "__b int, __before long")
    within = F.sum("__n").over(Window.partitionBy("__b").orderBy(key)) - F.col("__n")
    return rows.join(F.broadcast(before), "__b").withColumn("offset", within + F.col("__before")).drop("__b", "__n", "__before"), total


def split_tail(df: DataFrame, idx: str, total: int, ratio: float) -> DataFrame:
    """Last max(floor(total * ratio), MIN_VALIDATION) rows are for validation."""
    held = max(int(total * ratio), MIN_VALIDATION)
    return df.withColumn("split", F.when(F.col(idx) >= max(total - held, 0), "val").otherwise("train"))


def shuffle_rank(key: Column, seed: int, epoch: int) -> Column:
    """Sort key of a seeded permutation, the same on every engine; the effective seed of an
    epoch is seed + 2 * epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed + 2 * epoch)), key.cast("string")))


def shuffle_bucket(key: Column, seed: int, epoch: int) -> Column:
    """The leading byte of shuffle_rank: a bucket for row_numbers."""
    return F.conv(F.substring(shuffle_rank(key, seed, epoch), 1, 2), 16, 10).cast("int")


def batches(df: DataFrame, order: str, size: int, *cols: str) -> DataFrame:
    """(batch_id, n, one array for each column) in the order of a numeric key; the last may be partial."""
    rows = row_numbers(df, "__n", range_bucket(df, order), order).withColumn("batch_id", F.floor(F.col("__n") / size))
    packed = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("__n", *cols))).alias("p"))
    return packed.select("batch_id", F.size("p").alias("n"), *[F.col("p").getField(c).alias(c) for c in cols])
