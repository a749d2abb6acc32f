"""Session set-up and the shared scratch area.

Intermediate tables are parquet files in the folder named by ``spark.checkpoint.dir``, so that every
executor can read them and a lost executor only costs the re-read of a file.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Row bound under which a lookup table may travel to every executor.
BROADCAST_MAX_ROWS = 100_000


def build_session(app_name: str = "cohortflow", cores: int | str = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    width = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortflow-"))
    return spark.sparkContext.getCheckpointDir()


_scopes: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder, or below that of the innermost ``scratch_scope``."""
    parent = _scopes[-1] if _scopes else f"{_scratch_root(spark)}/cohortflow/{spark.sparkContext.applicationId}"
    return f"{parent}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are made inside are deleted at the end, so results must be written inside as well."""
    path = scratch_path(spark, "scope")
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Used where several passes follow (fits, quantiles) or where a value such as the range partition
    number must not change between passes. Later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def local_table(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A table of a few rows held in the plan itself (Arrow, so that no Python worker is started)."""
    names = schema.names
    records = [dict(zip(names, (_plain(value) for value in row))) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(schema)), schema)


def _plain(value):
    return {k: _plain(v) for k, v in value.asDict().items()} if isinstance(value, Row) else value


def lookup_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` ready to be the small side of an equi-join.

    A table counted to be within ``max_rows`` is sent to every executor. A larger one is returned
    as it is, and the join shuffles (AQE splits hot keys).
    """
    rows = bounded_rows(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(local_table(df.sparkSession, rows, df.schema))
