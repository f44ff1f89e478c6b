"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        work = tempfile.mkdtemp(prefix="loomwell-")
        tree = os.path.join(work, "tree", "loomwell")
        shutil.copytree(here, tree, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(work, "loomwell"), "zip", os.path.join(work, "tree")))
        atexit.register(shutil.rmtree, work, True)  # executors may fetch it at any time until then
        _shipped.add(sc.applicationId)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its scan has fewer tasks than there are cores, else df itself.

    A small file is one task however much work its rows are.  A large table has more tasks than cores
    and is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
