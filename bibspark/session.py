"""Session helpers: checkpoint location and lineage cuts."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="bibspark-checkpoint-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_written: list[str] = []


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete an intermediate table when its program ends.

    Lazy results may read the table until then, so it cannot go earlier.
    """
    if not _written:
        atexit.register(_delete_written, spark)
    _written.append(path)


def _delete_written(spark: SparkSession) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is scratch
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the optimizer
    real sizes for the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _delete_at_end(spark, path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread_scan(scan: DataFrame) -> DataFrame:
    """Spread a scan over the cores of a *local* session; on a cluster the scan stays as it is, without a shuffle.

    The local test tables have one row group each, which would keep a single core busy.
    """
    context = scan.sparkSession.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    return scan.repartition(context.defaultParallelism) if local else scan
