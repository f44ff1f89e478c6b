"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread

#: Rows handled at a time inside a Python worker, so its memory does not follow Spark's batch size.
SLICE_ROWS = 1024

#: Bytes of an Arrow batch between Spark and a Python worker, where the session keeps Spark's own bound.
ARROW_KEY, ARROW_DEFAULT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ready(spark: SparkSession) -> SparkSession:
    """The package for the workers, and batches of at most ARROW_BYTES: both sides hold several at a time."""
    if spark.conf.get(ARROW_KEY) == ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, ARROW_BYTES)
    return ship(spark)


def trimmed(run):
    """The function of mapInArrow, after which the worker, kept for later tasks, returns its free memory."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # a C library without it

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared folder; a local session that names none (tests) gets its own, a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomwell-ckpt-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage (reliable checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{sc._jvm.java.util.UUID.randomUUID()}"


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches cut to at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    """Values of a string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def text_input(df: DataFrame, *ids: str) -> DataFrame:
    """Only the columns an operator reads; null text is empty."""
    return df.select(*ids, F.coalesce(F.col("text"), F.lit("")).alias("text"))
