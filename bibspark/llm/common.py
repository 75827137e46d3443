"""Helpers of the subpackage: normalisation, Arrow maps, bounded membership filters."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: slots of the membership bitmap; the broadcast is ``SLOTS / 8`` bytes (1 MB) at any input size
SLOTS = 1 << 23

__all__ = ["UPPER", "arrow_map", "ascii_lower", "give_back", "materialize", "maybe_member", "private"]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def private(name: str) -> str:
    """A working column name that no input column clashes with."""
    return f"_{name}_{uuid.uuid4().hex[:6]}"


def arrow_map(df: DataFrame, fn: Callable[[Iterable], Iterable], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Return free memory of this Python process to the system; workers outlive their tasks, the driver its stages."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1


def maybe_member(df: DataFrame, key: Column, keys: DataFrame, other: Column, negate: bool = False) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys``: all that are, and few others.

    The keys are folded into a bitmap of fixed size (1 MB), which is broadcast; so the filter costs no shuffle of
    ``df`` and its size does not follow the data.  Where the bitmap fills up the filter only gets weaker: the exact
    join that follows decides.  Null keys are never members.  ``negate`` gives the other rows.
    """
    bucket, bits = private("bucket"), private("bits")
    bitmap = (keys.filter(other.isNotNull()).select(_slot(other).alias("s")).groupBy(F.bitmap_bucket_number("s").alias(bucket))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias(bits)))
    place = F.bitmap_bit_position(_slot(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("bit_get", byte, F.pmod(place, F.lit(8)).cast("int")) == 1
    if negate:
        joined = df.join(F.broadcast(bitmap), F.bitmap_bucket_number(_slot(key)) == F.col(bucket), "left")
        return joined.filter(~F.coalesce(hit, F.lit(False))).drop(bucket, bits)
    return (df.filter(key.isNotNull()).join(F.broadcast(bitmap), F.bitmap_bucket_number(_slot(key)) == F.col(bucket))
            .filter(hit).drop(bucket, bits))
