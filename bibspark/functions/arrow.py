"""Arrow batch functions for what Spark has no builtin for.

They short-circuit in the JVM where they can: only values that may change reach a Python worker.
The functions are built when used, since return types need a running session.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PARSED_BIB
from . import worker

cloudpickle.register_pickle_by_value(worker)


def html_unescape(c: Column) -> Column:
    """Character references to text.  Values without ``&`` are passed as null to the worker."""
    return F.coalesce(F.pandas_udf(worker.unescape, "string")(F.when(F.contains(c, F.lit("&")), c)), c)


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition, then drop everything outside ASCII."""
    return F.coalesce(F.pandas_udf(worker.fold, "string")(F.when(c.rlike("[^\\x00-\\x7f]"), c)), c)


def parse_bib(raw: Column | str, recover: bool = False) -> Column:
    """One bibliography entry to ``entry_type, bibtex_key, fields, error``; ``recover`` keeps the readable fields of damaged ones."""
    def parse(batch: pa.Array) -> pa.Array:
        return worker.parse_entries(batch, recover)

    return F.arrow_udf(parse, PARSED_BIB)(raw)


def split_balanced(text: Column | str) -> Column:
    return F.pandas_udf(worker.split_closed, "array<string>")(text)
