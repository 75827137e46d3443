"""Exact top-k inner products over impact-ordered posting segments, score at a time.

Rows are dealt over shards of bounded size.  A shard keeps, for each dimension and sign, the places of its vectors in segments of
equal quantised impact (size of the component), largest first; components of the lowest level have no posting.  A query
processes the segments of all dimensions by descending impact times its own component: scores grow, and the squared lengths of what
is still missing of the vector and of the query shrink with each posting.  The product of both lengths bounds what the unread
postings can still change (Cauchy-Schwarz), so a vector whose score plus that bound is below the k-th best known score is
out by proof.  A query stops when few vectors are left; those are rescored exactly.

Each block of queries first meets one shard.  The k-th best scores found there are the thresholds with which it meets all others.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .whitening import usable

SCALE, K = 1024, 10
SHARD, QUERY_BLOCK = 4096, 2048
#: quantised sizes of a component; the lowest has no postings
LEVELS = 7
#: postings between two looks at the bounds, and the share of a shard that may be left when a query stops
STEP, LEFT = 1 << 15, 1 / 4
LONG_MAX = (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


def segments(vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Impact order of one shard: places, and per segment its dimension, greatest size and first posting.

    Within a dimension and sign the segments follow each other by descending size.
    """
    n, dim = vectors.shape
    size = np.abs(vectors)
    unit = float(size.max(initial=0)) / LEVELS or 1.0
    level = np.minimum((size / unit).astype(np.int64), LEVELS - 1)
    key = ((np.arange(dim) * 2 + (vectors < 0)) * LEVELS + (LEVELS - 1 - level)).ravel()
    by_key = np.argsort(key, kind="stable")
    by_key = by_key[level.ravel()[by_key] > 0]
    segment, first = np.unique(key[by_key], return_index=True)
    return by_key // dim, segment // (2 * LEVELS), (LEVELS - segment % LEVELS) * unit, first


class Shard:
    """One row of the index as arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, dimension: np.ndarray, top: np.ndarray, first: np.ndarray):
        self.ids, self.vectors, self.places, self.dimension, self.top, self.first = ids, vectors.astype(np.float64), places.astype(np.intp), dimension, top, first
        self.end = np.append(first[1:], len(places))
        self.values = self.vectors[places, np.repeat(dimension, self.end - first)]
        self.squares, self.lengths = self.values**2, (self.vectors**2).sum(1)

    def possible(self, query: np.ndarray, threshold: float, k: int, counts: list) -> np.ndarray:
        """Places of all vectors that the bounds cannot keep out of the best ``k``, or below ``threshold``."""
        n = len(self.ids)
        enough = max(k, int(n * LEFT))
        if n <= enough:
            return np.arange(n)
        impact = np.abs(query)[self.dimension] * self.top
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        first, end = self.first[order], self.end[order]
        ends = np.cumsum(end - first)
        score, mine, yours = np.zeros(n), self.lengths.copy(), np.full(n, (query**2).sum())
        slack = 1e-9 * np.sqrt(self.lengths * yours[0])  # more than all rounding together
        i, left = 0, np.arange(n)
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
            spans = [slice(a, b) for a, b in zip(first[i:j].tolist(), end[i:j].tolist())]
            at = np.concatenate([self.places[s] for s in spans])
            weight = np.repeat(query[self.dimension[order[i:j]]], end[i:j] - first[i:j])
            score += np.bincount(at, np.concatenate([self.values[s] for s in spans]) * weight, n)
            mine -= np.bincount(at, np.concatenate([self.squares[s] for s in spans]), n)
            yours -= np.bincount(at, weight * weight, n)
            counts[0] += len(at)
            i = j
            missing = np.sqrt(np.maximum(mine, 0) * np.maximum(yours, 0)) + slack
            # the k-th best of what is sure so far
            sure = max(threshold, np.partition(score - missing, n - k)[n - k])
            left = np.flatnonzero(score + missing >= sure)
            if len(left) <= enough:
                break
        return left

    def search(self, query: np.ndarray, query_id: int, k: int, threshold: float, counts: list) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of the best ``k`` rows with a score of at least ``threshold``; rows with the query's id take no part."""
        own = int(np.searchsorted(self.ids, query_id, "right") - np.searchsorted(self.ids, query_id, "left"))
        near = self.possible(query, threshold, k + own, counts)
        near = near[self.ids[near] != query_id]
        counts[1] += len(near) * len(query)
        most = float(np.abs(query).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * len(query)
        if most < 2.0**53:
            scores = (self.vectors[near] @ query).astype(np.int64)
        else:  # whole numbers of any size; beyond a long the scores stay at its ends
            exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in self.vectors[near]]
            scores = np.array([max(-LONG_MAX - 1, min(LONG_MAX, s)) for s in exact], np.int64)
        good = np.flatnonzero(scores.astype(np.float64) >= threshold) if np.isfinite(threshold) else np.arange(len(near))
        best = good[np.lexsort((self.ids[near[good]], ~scores[good]))[:k]]
        return self.ids[near[best]], scores[best]


def matrix(v: pd.Series, scale: int) -> np.ndarray:
    """``floor(scale * c)``: whole numbers that a double holds exactly."""
    return np.floor(np.stack([np.asarray(x, np.float64) for x in v]) * scale)


def pack_shard(key: tuple, rows: pd.DataFrame, scale: int) -> pd.DataFrame:
    """One row of the index: its vectors in the smallest type that holds them, by id, and their segments."""
    rows = rows.sort_values("id", kind="stable")
    vectors = matrix(rows["v"], scale)
    places, dimension, top, first = segments(vectors)
    small = np.abs(vectors).max(initial=0) < 1 << 15
    arrays = [rows["id"].to_numpy(np.int64), vectors.astype(np.int16 if small else np.float64), places.astype(np.int32), dimension.astype(np.int32),
              top.astype(np.float64), first.astype(np.int64)]
    return pd.DataFrame([[*key, small, *[x.tobytes() for x in arrays]]], columns=["dim", "shard", "small", *PARTS])


def pack_queries(key: tuple, rows: pd.DataFrame, scale: int) -> pd.DataFrame:
    least = rows["least"].astype(float).fillna(-np.inf).to_numpy()
    arrays = [rows["id"].to_numpy(np.int64), matrix(rows["v"], scale), least]
    return pd.DataFrame([[*key, *[x.tobytes() for x in arrays]]], columns=["dim", "qb", "ids", "vectors", "least"])


PARTS = ["ids", "vectors", "places", "dimension", "top", "first"]
INDEX = "dim int, shard int, small boolean, " + ", ".join(f"{x} binary" for x in PARTS)


def search_cell(shards: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list = [[], [], []]
    if len(shards) and len(blocks):
        s, b = shards.iloc[0], blocks.iloc[0]
        kinds = [np.int64, np.int16 if s["small"] else np.float64, np.int32, np.int32, np.float64, np.int64]
        parts = [np.frombuffer(s[x], kind) for x, kind in zip(PARTS, kinds)]
        parts[1] = parts[1].reshape(-1, s["dim"])
        shard, counts = Shard(*parts), [0, 0]
        queries = np.frombuffer(b["vectors"], np.float64).reshape(-1, s["dim"])
        for query, query_id, least in zip(queries, np.frombuffer(b["ids"], np.int64), np.frombuffer(b["least"], np.float64)):
            ids, scores = shard.search(query, query_id, k, least, counts)
            out[0].append(np.full(len(ids), query_id, np.int64))
            out[1].append(ids)
            out[2].append(scores)
    return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in zip(("query_id", "vec_id", "score"), out)})


def build_index(rows: DataFrame, shards: Column, scale: int) -> DataFrame:
    """A row for each shard of ``rows(id, v, dim)``; every row of the table goes to a shard by its place, so copies spread too."""
    dealt = rows.select("id", "v", "dim", F.pmod(F.xxhash64(F.monotonically_increasing_id()), shards).cast("int").alias("shard"))
    return dealt.groupBy("dim", "shard").applyInPandas(lambda key, part: pack_shard(key, part, scale), INDEX)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
          shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its ``k`` largest inner products with rows of other ids, exactly.

    Components c become ``floor(scale * c)``; ``score`` is the inner product of these whole numbers (products beyond a long stay
    at its ends), ties go to the smaller id.  Ids are whole numbers; rows with a null id take no part, nor do null, empty,
    null-holding and non-finite vectors.  Repeated rows are candidates of their own; of query rows with one id the smallest vector asks.
    Vectors are compared with those of their own length only.  A query with fewer than ``k`` candidates gets them all, one with none
    no row; an empty table gives an empty result.  Other columns are not read.
    """
    good = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.size(vec_col).alias("dim"),
                       F.coalesce(is_query, F.lit(False)).alias("q"))
    asking = materialize(rows.filter("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    # one row for each length that occurs, no more than the longest vector has entries
    facts = F.broadcast(materialize(
        rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
        .join(asking.groupBy("dim").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks")), "dim"), "lengths"))
    index = materialize(build_index(rows.join(facts, "dim"), F.col("shards"), scale), "impact-index").join(facts, "dim")
    dealt = asking.join(facts, "dim").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    first = F.col("qb") % F.col("shards") == F.col("shard")
    cells = index.select("*", others(F.col("blocks")).alias("qb"))

    def search(thresholds: DataFrame | None, seeds: bool) -> DataFrame:
        asked = dealt.join(thresholds, "id", "left") if thresholds is not None else dealt.withColumn("least", F.lit(None).cast("double"))
        blocks = asked.select("dim", "qb", "id", "v", "least").groupBy("dim", "qb").applyInPandas(
            lambda key, part: pack_queries(key, part, scale), "dim int, qb int, ids binary, vectors binary, least binary").join(facts, "dim")
        wanted = first if seeds else ~first
        left = cells.filter(wanted).select("dim", "shard", "qb", "small", *PARTS)
        right = blocks.select("*", others(F.col("shards")).alias("shard")).filter(wanted).select("dim", "shard", "qb", "ids", "vectors", "least")
        cell = ["dim", "shard", "qb"]
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(lambda s, b: search_cell(s, b, k), FOUND)

    seeds = materialize(search(None, True), "first-answers")
    # a long as a double may be off by its rounding; the threshold stays below it
    least = F.min("score").cast("double")
    full = seeds.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), (least - 1 - F.abs(least) * 1e-12).alias("least")).filter(F.col("n") == k)
    found = seeds.unionAll(search(full.drop("n"), False))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
