"""Session helpers shared by tests, bench and the command line."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf, broadcast
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: The setting that names the folder all executors share.
SHARED_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("formquarry")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Only on one machine, as in tests, a folder of its own is made where none is set; a cluster without a
    shared folder is refused, since its executors could not see a local one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get(SHARED_DIR, None)
    if not current:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"{SHARED_DIR} is not set: a cluster needs a folder that all executors share")
        current = tempfile.mkdtemp(prefix="formquarry-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return current


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back; the files go when the session's JVM ends."""
    spark = df.sparkSession
    folder = f"{ensure_shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows; else the join it is for shuffles.

    Give it a stored table: the rows of one are counted from the footers of its files. ``rows`` is chosen with the
    width of a row in mind, so that the broadcast stays below some 100 MB.
    """
    return broadcast(df) if df.count() <= rows else df


def _encodable(value):
    """A value of plain Python types with ``?`` for what UTF-8 has no bytes for."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, dict):
        return {k: _encodable(v) for k, v in value.items()}
    return [_encodable(v) for v in value] if isinstance(value, list) else value


def arrow_function(of_row: Callable, returns: str) -> Callable:
    """A column function that calls ``of_row`` for each row of an Arrow batch and makes typed values of what it returns.

    It counts as nondeterministic, so that a plan has it once however many columns and filters use its result.
    """
    kind = to_arrow_type(DataType.fromDDL(returns))

    def of_batch(*columns: pa.Array) -> pa.Array:
        rows = [of_row(*row) for row in zip(*(c.to_pylist() for c in columns))]
        try:
            return pa.array(rows, type=kind)
        except UnicodeEncodeError:  # half of a surrogate pair, which JSON can spell and UTF-8 can't
            return pa.array([_encodable(row) for row in rows], type=kind)

    of_batch.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return arrow_udf(of_batch, returns).asNondeterministic()
