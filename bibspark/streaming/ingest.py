"""Incremental ingest with Structured Streaming, and its batch form.

The registry is kept as one folder per micro-batch.  The folder's name is a hash of the stream's own id and the batch id,
so a batch that runs again after a failure replaces its own output and nothing else, and a stream with a new checkpoint,
whose batch ids start again at 0, never meets the folders of an earlier one.  The order of batches is a running number
``seq`` in the rows; a batch that runs again keeps its number.

Every ``COMPACT_AFTER`` batches the registry is folded into a snapshot, a folder of the same shape whose number is that of the last
batch in it.  From then on a batch reads the snapshot and what came after: the numbers are constant in a file, so the Parquet scan
skips all earlier folders by their footers, however many there were.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .. import constants as K
from ..functions import names as N
from ..functions import text as T
from ..operators.maintain import add_files

DELTA_COLUMNS = [*K.REGISTRY_FIELDS, "row_ord"]
COMPACT_AFTER = 16


def select_for_ingest(files: DataFrame, registry: DataFrame, force: bool = False,
                      statuses: tuple[str, ...] = ()) -> DataFrame:
    """Files to process, with the reason: not indexed, forced, or an indexed row in a wanted status."""
    known = registry.filter("pdf_path <> ''").groupBy(F.col("pdf_path").alias("path")).agg(
        F.max_by("match_status", "row_ord").alias("_status"))
    wanted: Column = F.when(F.col("_status").isNull(), "unindexed")
    if force:
        wanted = wanted.otherwise("force")
    elif statuses:
        wanted = wanted.when(F.col("_status").isin(*statuses), F.concat(F.lit("status:"), "_status"))
    return (files.join(known, "path", "left").withColumn("reason", wanted)
            .filter(F.col("reason").isNotNull()).drop("_status"))


def _deltas(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", root).parquet(root)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
            raise
        return None


def _snapshot(spark: SparkSession, root: str, before: int | None) -> tuple[str, int] | None:
    """``(part, number)`` of the latest snapshot below ``before``."""
    try:
        known = spark.read.schema("part string, seq bigint").json(f"{root}/_snapshots")
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None
    if before is not None:
        known = known.filter(F.col("seq") < before)
    latest = known.agg(F.max(F.struct("seq", "part")).alias("s")).first().s
    return (latest.part, latest.seq) if latest else None


def current_deltas(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Rows of the latest snapshot and of all batches after it, up to the one before ``before``."""
    deltas = _deltas(spark, root)
    if deltas is None:
        return None
    if before is not None:
        deltas = deltas.filter(F.col("seq") < before)
    if snapshot := _snapshot(spark, root, before):
        part, number = snapshot
        deltas = deltas.filter(F.col("seq") >= number).filter((F.col("seq") > number) | (F.col("part").cast("string") == part))
    return deltas


def read_registry(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Current registry: per id the row of the latest batch, or of the latest one whose number is below ``before``."""
    deltas = current_deltas(spark, root, before)
    if deltas is None:
        schema = T_.StructType([*[T_.StructField(c, T_.StringType()) for c in K.REGISTRY_FIELDS],
                                T_.StructField("row_ord", T_.LongType())])
        return spark.createDataFrame([], schema)
    cols = [c for c in DELTA_COLUMNS if c != "paper_id"]
    latest = deltas.groupBy("paper_id").agg(F.max_by(F.struct(*cols), "seq").alias("r"))
    return latest.select(*[F.col("paper_id") if c == "paper_id" else F.col(f"r.{c}").alias(c) for c in DELTA_COLUMNS])


def fold(spark: SparkSession, root: str, seq: int, after: int) -> None:
    """Write a snapshot of all batches below ``seq`` when more than ``after`` came since the last one.

    Batches below the running one are committed, so none of them runs again.  The snapshot counts once it is announced; a crash before
    that leaves rows that repeat the latest state.
    """
    snapshot = _snapshot(spark, root, seq)
    if seq - (snapshot[1] + 1 if snapshot else 0) <= after:
        return
    folder = batch_folder("snapshot", seq - 1)
    read_registry(spark, root, seq).withColumn("seq", F.lit(seq - 1).cast("long")).write.mode("overwrite").parquet(f"{root}/{folder}")
    spark.createDataFrame([(folder.removeprefix("part="), seq - 1)], "part string, seq bigint").write.mode("append").json(f"{root}/_snapshots")


def batch_folder(stream_id: str, batch_id: int) -> str:
    return "part=" + hashlib.sha256(f"{stream_id}|{batch_id}".encode()).hexdigest()[:24]


def _number(spark: SparkSession, root: str, folder: str) -> int:
    """The batch's own running number if it ran before, else the next one."""
    deltas = _deltas(spark, root)
    if deltas is None:
        return 0
    mine = deltas.filter(F.col("part").cast("string") == folder.removeprefix("part=")).agg(F.max("seq")).first()[0]
    last = current_deltas(spark, root).agg(F.max("seq")).first()[0]
    return mine if mine is not None else 0 if last is None else last + 1


def ingest_batch(incoming: DataFrame, registry_root: str, batch_id: int, chunk_root: str | None = None,
                 log_root: str | None = None, stream_id: str = "", compact_after: int = COMPACT_AFTER) -> None:
    """Add one batch of ``incoming(ord, path, text, s2_id, title, authors, year, venue, doi, url)``."""
    spark = incoming.sparkSession
    folder = batch_folder(stream_id, batch_id)
    seq = _number(spark, registry_root, folder)
    fold(spark, registry_root, seq, compact_after)
    registry = read_registry(spark, registry_root, before=seq)
    added = add_files(registry, incoming, K.API_CHUNK_CHARS, K.API_CHUNK_OVERLAP)
    out = f"{registry_root}/{folder}"
    added.rows.select(*DELTA_COLUMNS, F.lit(seq).cast("long").alias("seq")).write.mode("overwrite").parquet(out)
    if chunk_root:
        added.chunks.write.mode("overwrite").parquet(f"{chunk_root}/{folder}")
    if log_root:
        counts = added.skipped.groupBy("reason").agg(F.count("*").alias("n")).unionByName(
            spark.read.parquet(out).agg(F.count("*").alias("n")).select(F.lit("added").alias("reason"), "n"))
        counts.write.mode("overwrite").json(f"{log_root}/{folder}")


def compact_registry(spark: SparkSession, root: str, target: str) -> None:
    """Write the current registry as the first batch of a new root, so that later batches fold one folder less each."""
    current = read_registry(spark, root)
    current.withColumn("seq", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{target}/{batch_folder('compacted', 0)}")


def start_ingest(stream: DataFrame, to_incoming, registry_root: str, checkpoint: str, chunk_root: str | None = None,
                 log_root: str | None = None):
    """Process everything new since the last run, then stop.

    ``to_incoming`` maps a batch of the source to the columns :func:`ingest_batch` takes.  The stream's id is the one that
    Spark keeps in the checkpoint.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream_id = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()[0]
        ingest_batch(to_incoming(batch), registry_root, batch_id, chunk_root, log_root, stream_id)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
