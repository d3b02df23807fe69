"""Broadcast hints only for what is small, and results that are computed once."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are sent to all tasks at most.
SMALL_BYTES = 8_000_000


def hinted(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """df with a broadcast hint if its counted rows, of about row_bytes each, allow it; else joins with it are shuffled."""
    most = SMALL_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def written(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir, which driver and executors share; in local mode, where all is one machine, a temporary folder will do."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


@contextmanager
def released(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, an action's shuffle files are removed when it ends, and Arrow batches have so many rows at most; the settings are put back.

    For steps that each end in an action: nothing reads the shuffle files of one that is done."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Rows a partition, about, where each row is much work.
PART_ROWS = 50_000


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt by a column, in partitions whose number grows with the rows, for work on each row that may not wait for what the input's files happen to be cut into."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // PART_ROWS)), by)
