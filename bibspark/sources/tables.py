"""Registry, records, texts, bibliography, journal and log readers and writers."""
from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .. import constants as K
from .. import schemas
from ..functions import names as N
from ..functions import text as T
from ..operators.index import with_defaults
from ..session import materialize

TSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}


def read_registry_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Registry import: tab separated, quotes doubled, line breaks inside values allowed.

    ``row_ord`` numbers the rows in file order, files in the order of their paths.
    """
    return with_defaults(read_quoted(spark, path, schemas.REGISTRY, "row_ord"))


def read_quoted(spark: SparkSession, path: str, schema: T_.StructType, name: str, options: dict | None = None) -> DataFrame:
    """Rows of delimited files with a header line, numbered in file order in ``name``; one large file is read by many tasks.

    A line belongs to the row before it when an odd number of quotes stands before it in its file.  So the lines of each split are
    numbered for both cases at once, a prefix sum over the splits (a few numbers each) tells which case holds, and only rows of several
    lines are put together again.  Values that hold a quote must be quoted, as all writers of this format do.  Empty lines
    between rows are skipped, missing values are empty.
    """
    options = {k: v for k, v in {**TSV, **(options or {})}.items() if k != "header"}
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
        (F.length("value") - F.length(F.replace("value", F.lit(options["quote"]), F.lit("")))).alias("_quotes"))
    split = Window.partitionBy("_path", "_start").orderBy("_id")
    before = F.coalesce(F.sum("_quotes").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("_odd", before.cast("int"))
    heads = lambda odd: F.when((F.col("_odd") == odd) & (F.col("value") != ""), 1).otherwise(0)
    so_far = split.rowsBetween(Window.unboundedPreceding, 0)
    # one scan is numbered and written; everything below reads the same numbers
    lines = materialize(lines.withColumn("_n0", F.sum(heads(0)).over(so_far)).withColumn("_n1", F.sum(heads(1)).over(so_far)), "lines")
    splits = lines.groupBy("_path", "_start").agg((F.sum("_quotes") % 2).alias("_parity"), F.max("_n0").alias("_m0"), F.max("_n1").alias("_m1"))
    in_file = Window.partitionBy("_path").orderBy("_start")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_open", earlier("_parity", in_file) % 2).withColumn("_rows", F.when(F.col("_open") == 0, F.col("_m0")).otherwise(F.col("_m1")))
    first = Window.partitionBy("_path")
    splits = splits.withColumn("_in_file", F.sum("_rows").over(first)).filter("_in_file > 0")
    splits = splits.withColumn("_base", earlier("_rows", Window.orderBy("_path", "_start"))).withColumn(
        "_file", F.dense_rank().over(Window.orderBy("_path"))).withColumn("_first", F.min("_base").over(first))
    known = lines.join(splits.select("_path", "_start", "_open", "_base", "_file", "_first"), ["_path", "_start"])
    head = F.col("_odd") == F.col("_open")
    row = F.col("_base") + F.when(F.col("_open") == 0, F.col("_n0")).otherwise(F.col("_n1")) - 1
    known = known.select("value", "_start", "_id", head.alias("_head"), (F.col("_quotes") % 2).alias("_odd"), row.alias("_row"),
                         (row - F.col("_file")).alias(name), (row == F.col("_first")).alias("_header"))
    known = known.filter("NOT _header AND NOT (_head AND value = '')")
    whole = known.filter("_head AND _odd = 0").select(name, "value")
    parts = known.filter("NOT (_head AND _odd = 0)").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_start", "_id", "value"))).alias("p"))
    joined = parts.select(name, F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return whole.unionAll(joined).select(F.from_csv("value", fields, options).alias("r"), name).select("r.*", name).na.fill("")


def in_file_order(scan: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan by path, place of the split in the file, and place in the split.

    Spark packs splits into tasks by size, so its own row ids do not follow the files.  The scan is written once with its ids;
    only one number a split is gathered, and the rows are not sorted.
    """
    part = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = materialize(scan.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_id")), "numbered-scan")
    splits = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("_part", (before - F.col("_first")).alias("_shift"))
    return rows.join(shifts, "_part").withColumn(name, F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def write_registry_tsv(registry: DataFrame, path: str) -> None:
    """Export in the same dialect, in row order."""
    ordered = registry.orderBy("row_ord") if "row_ord" in registry.columns else registry
    options = TSV
    with_defaults(ordered).select(*K.REGISTRY_FIELDS).write.options(
        **options, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


# --- versioned tables ------------------------------------------------------------------

def write_version(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write a full new version next to the old ones, then announce it.

    Readers switch when the announcement row is there, so no table is overwritten while it is read.
    """
    version = time.time_ns() if version is None else version
    df.write.mode("overwrite").parquet(f"{root}/v{version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version bigint").write.mode("append").json(f"{root}/announced")
    return version


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    latest = spark.read.schema("version bigint").json(f"{root}/announced").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v{latest}")


# --- records -----------------------------------------------------------------------------

def read_records(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """One JSON document per file; unreadable files give an all-null record, which is dropped.

    With ``root``, relative paths are made absolute.
    """
    r = spark.read.schema(schemas.RECORD).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    r = r.filter(F.col("paper_id").isNotNull())
    return map_record_paths(r, lambda p: absolute(p, root)) if root else r


def write_records(records: DataFrame, path: str, root: str) -> None:
    """JSON lines; paths under ``root`` are stored relative to it."""
    map_record_paths(records, lambda p: relative(p, root)).write.json(path)


def relative(path: Column, root: str) -> Column:
    """``path`` without ``root`` in front; the root is plain text, not a pattern."""
    head = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def absolute(path: Column, root: str) -> Column:
    return F.when((T.blank(path) == "") | F.startswith(path, F.lit("/")), path).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), path))


def map_record_paths(records: DataFrame, change) -> DataFrame:
    art = F.col("artifacts").withField("text_path", change(F.col("artifacts.text_path"))).withField(
        "chunk_path", change(F.col("artifacts.chunk_path")))
    return records.withColumn("pdf_path", change(F.col("pdf_path"))).withColumn(
        "artifacts", F.when(F.col("artifacts").isNotNull(), art))


def migrate_records(records: DataFrame) -> DataFrame:
    """Fill content kind and text kind of older records."""
    has_file = T.blank("pdf_path") != ""
    kind = T.first_filled("content_kind", F.when(has_file, K.PDF_BACKED).otherwise(K.REFERENCE_ONLY))
    text_kind = T.first_filled("artifacts.text_kind", F.when(has_file, "pdf_text").otherwise("metadata_stub"))
    art = F.struct(F.col("artifacts.text_path").alias("text_path"), F.col("artifacts.chunk_path").alias("chunk_path"),
                   text_kind.alias("text_kind"))
    return records.withColumn("content_kind", kind).withColumn("artifacts", art)


# --- files and texts ------------------------------------------------------------------------

def list_files(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """``(path, length, modified)`` of a file tree; the content is never read.

    Hidden files are skipped by Spark, upload folders by the filter.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return (f.select(_below(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"))
            .filter(~F.contains("path", F.lit("temp_uploads/"))))


def hash_files(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """``(path, sha256, paper_id)`` from the file contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return f.select(_below(F.col("path"), root).alias("path"), F.sha2("content", 256).alias("sha256")).withColumn(
        "paper_id", N.content_id("sha256"))


def _below(path: Column, root: str) -> Column:
    """Path relative to ``root``; file URIs carry a scheme that the given root may not have."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    stem = root.split(":", 1)[-1] if ":" in root else root
    return relative(bare, "/" + stem.strip("/"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(paper_id, text)`` from one text file per paper."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("paper_id"), F.col("value").alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.json(path)


# --- bibliography ------------------------------------------------------------------------------

def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, raw)``: one row per entry that starts with ``@`` in the first column.

    The file is split by Spark's line separator, so one large file is read by many tasks.
    """
    lines = spark.read.option("lineSep", "\n@").text(path)
    body = T.strip("value")
    return in_file_order(lines, "ord").select(
        "ord",
        F.when(F.startswith(body, F.lit("@")), body).otherwise(F.concat(F.lit("@"), body)).alias("raw")).filter(body != "")


def write_bibliography(entries: DataFrame, path: str, single_file: bool = False) -> None:
    """Entry texts in key order; range partitioned, one file only on request."""
    ordered = entries.orderBy("bibtex_key").select(F.concat(F.regexp_replace("raw", r"\s+$", ""), F.lit("\n")).alias("value"))
    (ordered.coalesce(1) if single_file else ordered).write.text(path)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    return read_quoted(spark, path, schemas.JOURNALS, "ord")


# --- logs -----------------------------------------------------------------------------------

def append_log(df: DataFrame, path: str, action: str) -> None:
    """Append audit rows with the action and a UTC time stamp."""
    df.select(F.lit(action).alias("action"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias(
        "timestamp"), F.struct(*df.columns).alias("payload")).write.mode("append").json(path)
