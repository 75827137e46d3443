"""Batch import: which incoming entries are new."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..session import materialize
from .joins import split_lookup

KEY_ORDER = ["doi", "key", "title"]


def _lowered(c: Column) -> Column:
    return T.strip(F.lower(T.blank(c)))


def _keys(df: DataFrame, id_col: str | None, **columns: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("kind"), _lowered(c).alias("value")) for n, c in columns.items()])
    base = df.select(*([id_col] if id_col else []), F.explode(pairs).alias("p"))
    return base.filter("p.value <> ''").select(*([id_col] if id_col else []), F.concat_ws(
        "\u0001", "p.kind", "p.value").alias("k"))


def with_minted_keys(incoming: DataFrame) -> DataFrame:
    """Add ``minted_key``: the key that an entry ``(authors, year, title)`` without one gets when it is accepted, else empty."""
    minted = N.batch_bib_key(T.first_filled("authors", F.lit("author")), "year", "title")
    return incoming.withColumn("minted_key", F.when(T.strip(T.blank("bibtex_key")) == "", minted).otherwise(""))


def accept_batch(incoming: DataFrame, registry: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Accept ``incoming(ord, doi, bibtex_key, title[, minted_key])`` greedily in order.

    An entry is skipped when its DOI, key or title is in the registry or belongs to an entry accepted
    before it; skipped entries do not block later ones.  A minted key does not stop its own entry, but once accepted it
    belongs to it like any other.  Adds ``accepted`` and ``reason``.

    Rounds: every entry that is first among the undecided for all of its keys is accepted, then all later ones
    that share a key with it are skipped.  Each round decides at least the first undecided entry, so
    the result is exact for any input; unrelated entries are decided in the same round.
    """
    keys = _keys(incoming, "ord", doi=F.col("doi"), key=F.col("bibtex_key"), title=F.col("title")).withColumn("checked", F.lit(True))
    if "minted_key" in incoming.columns:
        keys = keys.unionByName(_keys(incoming, "ord", key=F.col("minted_key")).withColumn("checked", F.lit(False)))
    keys = materialize(keys, "keys")
    known = materialize(_keys(registry, None, doi=F.col("doi"), key=F.col("bibtex_key"),
                              title=F.col("resolved_title")).distinct(), "known")
    blocked = keys.filter("checked").join(known, "k", "left_semi").select("ord").distinct()
    open_keys = materialize(keys.join(blocked, "ord", "left_anti"), "open")
    accepted = incoming.select("ord").join(keys, "ord", "left_anti")         # nothing to compare: always new
    rounds = 0
    while not open_keys.isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("batch acceptance did not finish within max_rounds")
        first = open_keys.groupBy("k").agg(F.min("ord").alias("first"))
        ready = materialize(
            split_lookup(open_keys, first, "k").groupBy("ord")
            .agg(F.bool_and(~F.col("checked") | (F.col("ord") == F.col("first"))).alias("ready")).filter("ready").select("ord"), "ready")
        taken = open_keys.join(ready, "ord", "left_semi").groupBy("k").agg(F.min("ord").alias("taken"))
        late = split_lookup(open_keys, taken, "k").filter("checked AND taken < ord").select("ord")
        open_keys = materialize(open_keys.join(late.unionByName(ready), "ord", "left_anti"), "open")
        accepted = accepted.unionByName(ready)
    accepted = accepted.withColumn("accepted", F.lit(True))

    # reason of a skipped entry: the first of DOI, key, title that was taken before its turn
    owners = keys.join(accepted.select("ord"), "ord", "left_semi").groupBy("k").agg(F.min("ord").alias("owner"))
    claims = owners.unionByName(known.select("k", F.lit(-1).cast("bigint").alias("owner"))).groupBy("k").agg(
        F.min("owner").alias("owner"))
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(KEY_ORDER) for x in (n, i)])
    kind = F.substring_index("k", "\u0001", 1)
    reasons = (
        split_lookup(keys.filter("checked"), claims, "k").filter(F.col("owner") < F.col("ord"))
        .groupBy("ord").agg(F.min_by(kind, F.element_at(rank, kind)).alias("reason")))
    return (
        incoming.join(accepted, "ord", "left").join(reasons, "ord", "left")
        .withColumn("accepted", F.coalesce("accepted", F.lit(False)))
        .withColumn("reason", F.when(F.col("accepted"), "").otherwise(T.blank("reason"))))


def split_by_existing(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Which incoming entries the registry already has, with the reason; no in-batch comparison."""
    out = incoming
    for kind, col, reg in (("doi", "doi", "doi"), ("key", "bibtex_key", "bibtex_key"), ("title", "title", "resolved_title")):
        have = registry.select(_lowered(F.col(reg)).alias("k")).filter("k <> ''").distinct().withColumn(f"_{kind}", F.lit(True))
        out = out.withColumn("k", F.when(_lowered(F.col(col)) != "", _lowered(F.col(col))).otherwise(
            F.concat(F.lit("\u0001"), F.col("ord").cast("string")))).join(have, "k", "left").drop("k")
    reason = F.when(F.col("_doi"), "doi").when(F.col("_key"), "key").when(F.col("_title"), "title").otherwise("")
    return out.withColumn("reason", reason).drop("_doi", "_key", "_title")
