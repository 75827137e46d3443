"""Exact deduplication with DataFrame operations only.

Rows are grouped by a 128-bit hash of the normalised text.  In each group the row with the smallest *stable id* stays;
stable ids run downwards from the largest ``id_col``, so the newest document is the one kept.  Groups of two and more
are then compared byte by byte: a second pass groups the texts of possible members by (hash, text), where equal texts
meet already before the shuffle, and a hash with two different texts is a collision, whose rows are grouped by text.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, maybe_member, private


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """``(<id_col>, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Null texts equal empty ones.  Of rows that repeat the largest id, one is kept.  A null id is smaller than any
    other; a group of null ids has a null ``keep_id`` and one kept row.  An empty table gives an empty result.
    Further columns are not looked at.
    """
    norm = ascii_lower(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    hashed = base.select("id", hash128(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("sha"))
    facts = materialize(hashed.withColumn("row", F.monotonically_increasing_id()), "dedup-facts")
    groups = facts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))

    several = groups.filter("n > 1").select(F.col("h").alias("gh"))
    texts = base.select(hash128(F.col("norm")).alias("h"), "norm")
    variants = maybe_member(texts, F.col("h"), several, F.col("gh")).groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"))
    collided = materialize(variants.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h"),
                           "dedup-collisions")
    if collided.isEmpty():
        rows = facts.join(groups, "h")
    else:
        safe = facts.join(collided, "h", "left_anti")
        parted = base.select("id", "norm", hash128(F.col("norm")).alias("h")).join(collided, "h", "left_semi")
        by_text = parted.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
        again = materialize(
            parted.join(by_text, ["h", "norm"])
            .select(F.unhex(F.sha2("norm", 256)).alias("h"), "id", F.sha2("norm", 256).alias("sha"),
                    F.monotonically_increasing_id().alias("row"), "n", "keep_id"), "dedup-collided")
        rows = safe.join(groups, "h").unionByName(again.select("h", "id", "sha", "row", "n", "keep_id"))
    # repeated ids: the first of the rows that carry the kept id
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    twins = facts.filter("id IS NOT NULL").groupBy("id", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1)
    nulls = facts.filter("id IS NULL").limit(1)
    if twins.isEmpty() and nulls.isEmpty():
        kept = rows.withColumn("kept", same)
    else:
        first = (rows.filter(same).groupBy("sha").agg(F.min("row").alias("first")))
        kept = rows.join(first, "sha").withColumn("kept", same & (F.col("row") == F.col("first")))
    return kept.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept",
                       F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat one id and text are one row."""
    groups = dedup_groups(docs, id_col, text_col)
    sha, kept_id, kept_sha = private("sha"), private("id"), private("kept")
    marks = groups.filter("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_sha))
    keyed = docs.withColumn(sha, F.sha2(ascii_lower(F.col(text_col)), 256))
    out = keyed.join(marks, F.col(sha).eqNullSafe(F.col(kept_sha)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    repeated = groups.groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([id_col, sha])
    return out.drop(sha)
