"""Cutting lineage and keeping broadcasts within a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Rows a fitted-state table (bins, coefficients, quantiles per group) may have
# before it is treated as ordinary distributed data.
MAX_STATE_ROWS = 2_000_000
# What may be sent to every task: rows fetched to find out, and bytes.
MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 16 << 20
# Whether Spark deletes a query's shuffle files when the query ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="scorelake-checkpoint-")
    sc.setCheckpointDir(shared)


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes what was sampled."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def staging_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; else those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For inputs that several passes read: an expensive plan runs once, its shuffle files go, and later
    passes still prune columns and push filters into the scan.
    """
    path = staging_path(df.sparkSession)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Compute ``df`` once and mark it for broadcast only when it is small.

    Up to ``max_rows`` rows and ``max_bytes`` come back as a local table with a
    broadcast hint.  Beyond either the result is checkpointed and carries no hint, so joins with it
    stay shuffle joins that adaptive execution can still split on skew.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows <= max_rows and table.nbytes <= max_bytes:
        return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))
    return materialise(df)


def collect_state(df: DataFrame, max_rows: int = MAX_STATE_ROWS, what: str = "state") -> list[Row]:
    """Collect a fitted-state table, refusing one that is not small."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; it is not fitted state")
    return rows
