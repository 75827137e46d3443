"""Join and ranking building blocks that stay balanced when one key is hot."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HOT_KEYS, SALTS = 1000, 32    # keys that split_lookup spreads, and over how many places


def spread_blank(key: Column, by: Column) -> Column:
    """Give rows without a key a filler of their own, so an outer join does not send them all to one task.

    The filler starts with a control character and matches nothing.
    """
    return F.when((key == "") | key.isNull(), F.concat(F.lit("\u0001"), F.xxhash64(by).cast("string"))).otherwise(key)


def split_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Left outer (or inner) join that is safe for any distribution of the left keys.

    The ``HOT_KEYS`` most frequent keys of the left side (counted with map-side combine; their list is the only broadcast) get
    one of ``SALTS`` salts in each left row, and their right rows are repeated for every salt.  All other keys hold less than a
    thousandth of the rows each.  Rows without a key match nothing and are spread too.  No row is dropped.
    """
    salt, hot = "_salt", "_hot"
    hottest = F.broadcast(left.groupBy(key).agg(F.count("*").alias(salt)).orderBy(F.col(salt).desc()).limit(HOT_KEYS).select(key, F.lit(True).alias(hot)))
    salted = left.join(hottest, key, "left").withColumn(salt, F.when(
        F.col(hot) | F.col(key).isNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0).cast("int")).drop(hot)
    salts = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hottest, key, "left").withColumn(salt, F.explode(salts)).drop(hot)
    return salted.join(repeated, [key, salt], how).drop(salt)


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``row_number`` inside groups of any size.

    Rows are range-partitioned by group and sort keys, numbered per (range, group), and shifted
    by the counts of the earlier ranges of the same group.  No task sees more than one range,
    so a group with a third of all rows is ranked by many tasks.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    # the sort expressions become columns, so every step below orders by the same values
    plain = [c for c, _ in map(_split_order, order)]
    down = [d for _, d in map(_split_order, order)]
    sorted_by = lambda: [F.col(k).desc() if d else F.col(k).asc() for k, d in zip(keys, down)]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(plain, keys)])
    ranged = materialize(
        keyed.repartitionByRange(*[F.col(g) for g in group], *sorted_by())
        .withColumn("_range", F.spark_partition_id()), "ranges")
    shifts = (
        ranged.groupBy("_range", *group).agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*sorted_by()))
    return (
        ranged.withColumn("_local", local)
        .join(shifts, ["_range", *group])
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, name)
    )


def _split_order(c: Column | tuple[Column, str]) -> tuple[Column, bool]:
    """``(column, "desc")`` or a plain column for ascending."""
    return (c[0], c[1] == "desc") if isinstance(c, tuple) else (c, False)


def unique_keys(df: DataFrame, key: Column, value: str, name: str) -> DataFrame:
    """Keys that belong to exactly one row, with that row's value.  Keys with two or more rows are left out."""
    return (
        df.select(key.alias("key"), F.col(value).alias("_v")).filter("key <> ''")
        .groupBy("key").agg(F.count("*").alias("_n"), F.min("_v").alias(name))
        .filter("_n = 1").drop("_n")
    )
