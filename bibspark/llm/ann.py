"""Nearest neighbours by inner product with query-aware collision counting.

Vectors get one more component so that the largest inner product is the smallest distance.  Rows are dealt over blocks of
bounded size; each block keeps, for each of ``projections`` random lines, its vectors sorted by their place on the line.
A query opens a window around its own place on every line and widens all windows step by step (virtual rehashing);
vectors that fall into at least ``collide`` of the windows are candidates.  When a block has enough of them they are verified
by their exact inner products; the best of all blocks are merged in Spark.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PROJECTIONS = 96
#: share of the windows a candidate must fall into
COLLIDE = 0.62
#: a block widens its windows until so many candidates are found: a share of the block, and a least number
SHARE, LEAST = 0.25, 600
FIRST_WIDTH, WIDEN = 0.5, 1.06
BLOCK, QUERY_BLOCK = 8192, 2048


def lines(dim: int, m: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim + 1, m))


class Index:
    """Sorted projection arrays of one block, and the rank of every vector in each (blocks have at most 65535 rows)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float):
        order = np.argsort(ids)
        self.ids, self.vectors, self.bound = ids[order], vectors[order], bound
        spare = np.sqrt(np.maximum(bound - (self.vectors ** 2).sum(1), 0))
        places = np.column_stack([self.vectors, spare]) @ lines(vectors.shape[1])
        by_place = np.argsort(places, axis=0, kind="stable")
        self.sorted = np.take_along_axis(places, by_place, 0).T.copy()
        self.rank = np.empty(self.sorted.shape, np.uint16)
        for j in range(len(self.rank)):
            self.rank[j, by_place[:, j]] = np.arange(len(ids), dtype=np.uint16)

    def windows(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places of each query's window on each line."""
        lo = np.empty(at.shape, np.int64)
        hi = np.empty(at.shape, np.int64)
        for j in range(at.shape[1]):
            lo[:, j] = np.searchsorted(self.sorted[j], at[:, j] - width, "left")
            hi[:, j] = np.searchsorted(self.sorted[j], at[:, j] + width, "right")
        return lo.astype(np.uint16), (hi - lo).astype(np.uint16)

    def collisions(self, lo: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Per vector, on how many lines it lies in the window of one query."""
        return np.add.reduce(((self.rank - lo[:, None]) < span[:, None]).view(np.uint8), axis=0, dtype=np.uint8)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        """``(query, ids, scores)`` of the best verified candidates of each query."""
        n, m = len(self.ids), len(self.sorted)
        enough = min(n, max(LEAST, int(k + SHARE * n)))
        need = int(np.ceil(COLLIDE * m))
        found: list = [None] * len(queries)
        if enough == n:
            found = [np.arange(n)] * len(queries)
        else:
            at = np.column_stack([queries, np.zeros(len(queries))]) @ lines(queries.shape[1])
            width = FIRST_WIDTH * np.sqrt(self.bound)
            few = np.arange(min(8, len(queries)))  # they only tell where to begin
            while True:
                lo, span = self.windows(at[few], width)
                if np.median([(self.collisions(lo[q], span[q]) >= need).sum() for q in few]) >= enough:
                    break
                width *= WIDEN
            width /= WIDEN
            waiting = np.arange(len(queries))
            while len(waiting):
                lo, span = self.windows(at[waiting], width)
                short = []
                for x, q in enumerate(waiting):
                    hit = np.flatnonzero(self.collisions(lo[x], span[x]) >= need)
                    if len(hit) >= enough:
                        found[q] = hit
                    else:
                        short.append(q)
                waiting = np.array(short, int)
                width *= WIDEN
        for q in range(len(queries)):
            near = found[q][self.ids[found[q]] != query_ids[q]]
            scores = self.vectors[near] @ queries[q]
            if len(near) > 4 * k:
                top = np.partition(scores, len(scores) - k)[len(scores) - k]
                near, scores = near[scores >= top], scores[scores >= top]
            best = np.lexsort((self.ids[near], -scores))[:k]
            yield q, self.ids[near][best], scores[best]


def search_cell(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    columns = ["query_id", "vec_id", "score"]
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    stack = lambda c: np.stack([np.asarray(x, np.float64) for x in c])
    index = Index(rows["id"].to_numpy(), stack(rows["v"]), float(rows["bound"].iloc[0]))
    out = []
    query_ids = queries["id"].to_numpy()
    for q, ids, scores in index.search(stack(queries["v"]), query_ids, k):
        out.append(pd.DataFrame({"query_id": np.full(len(ids), query_ids[q]), "vec_id": ids, "score": scores}))
    return pd.concat(out)[columns]


def usable(v: Column) -> Column:
    """Neither null nor zero, nor with a null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its ``k`` nearest found among all other ids.

    Ids are whole numbers; null ids and unusable vectors take no part.  Of rows with one id the smallest vector counts.
    Vectors are compared with those of their own length only.  Ties go to the smaller id.  A query with fewer than ``k``
    candidates gets them all, one with none no row; an empty table gives an empty result.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("n_q"), F.max(square).alias("bound"))
    # blocks hold a bounded number of rows, queries are dealt in blocks too: each meets each once
    facts = facts.select("dim", "bound", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("n_q") / query_block).cast("int").alias("q_blocks"))
    dealt = rows.join(facts, "dim")
    slot = F.xxhash64("id")
    data = dealt.filter("q_blocks > 0").select("dim", F.pmod(slot, F.col("blocks")).cast("int").alias("b"),
                                               F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), "id", "v", "bound")
    asked = dealt.filter("q").select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
                                     F.pmod(slot, F.col("q_blocks")).cast("int").alias("qb"), "id", "v").toDF("dim", "b", "qb", "id", "v")
    cell = ["dim", "b", "qb"]
    found = (data.groupBy(*cell).cogroup(asked.groupBy(*cell))
             .applyInPandas(lambda a, b: search_cell(a, b, k), "query_id long, vec_id long, score double"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
