"""What the operators of this package share: table access, shared scratch space, Arrow row functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that are sent to all tasks at most; a join with more is shuffled.
SMALL_BYTES = 8_000_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, with only the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where all is one machine, a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def released_shuffles(spark: SparkSession):
    """Within it, an action's shuffle files are removed when it ends, not when the driver next collects garbage; the setting is put back.

    For steps that each end in a checkpoint: nothing reads the shuffle files of a step that is done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hinted(small: DataFrame, row_bytes: int = 16) -> DataFrame:
    """small (already computed) with a broadcast hint if its counted rows, of about row_bytes each, allow it."""
    return F.broadcast(small) if small.count() * row_bytes <= SMALL_BYTES else small


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder for files of this run."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def map_columns(df: DataFrame, make: Callable[[], Callable[..., Iterator | list]], ddl: str | T.StructType, rows: int = 1000) -> DataFrame:
    """Run a function over slices of at most `rows` rows in Arrow batches.

    make() is called once a task and returns the function; that gets one Python list a
    column and returns the output columns, each a list or an Arrow array.
    """
    schema = schema_of(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)
    # texts are long: batches of the default size of 10,000 rows would be held by the executor and its Python worker at once
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = each(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)
