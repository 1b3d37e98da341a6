"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED, _STORED = "_statemesh_shipped", "_statemesh_stored"


def ship(spark: SparkSession) -> None:
    """Give every executor, also those that join later, this package for its Python workers; once per context."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="statemesh-"), "statemesh_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, under ``spark.checkpoint.dir``; one of our own only where that is unset and the
    master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "statemesh-checkpoints")
    return f"{root.rstrip('/')}/statemesh"


def _note(spark: SparkSession, kind: str, name: str) -> None:
    sc = spark.sparkContext
    setattr(sc, _STORED, [*getattr(sc, _STORED, []), (kind, name)])


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df once to the shared folder and return the table read back: what is costly to make is made once, and a lost
    executor does not bring it back to life as work."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _note(df.sparkSession, "path", path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like stored(), bucketed by a column: later groupings by it read the table without moving it again."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch(df.sparkSession)}/{table}"
    _note(df.sparkSession, "table", table)
    _note(df.sparkSession, "path", path)
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def clear_stored(spark: SparkSession) -> int:
    """Drop what stored() and stored_by() have written in this context, and say how many folders went. Only for results that
    were read to the end: DataFrames over them cannot be read any more."""
    sc, jvm, gone = spark.sparkContext, spark._jvm, 0
    for kind, name in getattr(sc, _STORED, []):
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = jvm.org.apache.hadoop.fs.Path(name)
            gone += bool(path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True))
    setattr(sc, _STORED, [])
    return gone


#: Rows of a task, where the work for each is costly.
ROWS_A_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, and over as many tasks as its rows ask for, if its scan has fewer: for costly work per row after a
    small scan. The rows are counted, which for Parquet files reads their footers."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
