"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated n-gram model with absolute discounting in backoff form over the words of the training rows;
unseen words keep a share.  Unigrams are add-one estimates.  Every n-gram of the training rows is a state: there is no
least count, and none of them is collected anywhere.

Rows are dealt over *blocks* by a hash, n-grams over *buckets* by their first word.  A block knows its texts as runs of word
codes and numbers its own n-grams exactly, as a tree of words, followers and their followers.  It sends each bucket the part of
the tree that belongs there with the counts of its training rows.  The bucket adds up what all blocks sent and answers in the
order it was asked, so an answer is counts only: how often the n-gram occurs, and how many different words follow it.  With the
answers a block has the part of the automaton that its texts can reach, and traverses them.

Frequent words would make their buckets large, so their followers, and those of contexts of very frequent words alone, are
spread over ``SPREAD`` buckets; the parts add up.  Only the codes of frequent words travel with the tasks, a megabyte at most.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import arrow_map, materialize

ORDER = 3
#: the followers of a word are spread if it has this share of the tokens; those of a longer context if all its words have the second
WORD_SHARE = 2.0 ** -9
NGRAM_SHARE = 2.0 ** -6
SPREAD = 64
DISCOUNT = 0.75
#: words with a code of two bytes; all others are coded by their hash
CODES = 65_000
#: tokens of a block and of a bucket
BLOCK = 1 << 20
#: entries that a counting task holds before it passes them on
HELD = 1 << 20

#: hashes of the closing token, which is predicted, and of the opening one, which is context only
END, OPEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
U64 = np.uint64
RARE = U64(1 << 63)


# --- token streams -------------------------------------------------------------------------

def streams(column: pa.Array):
    """``(hashes, bounds, first row, last row)`` of each slice: per row the opening token, the words and the closing token."""
    offsets, raw = kernel.utf8(column)
    for i, j in kernel.slices(offsets):
        w = kernel.Words(offsets, raw, i, j, kernel.BLANKS)
        h, counts = w.hashes(), w.counts
        bounds = np.concatenate([[0], np.cumsum(counts + 2)])
        out = np.full(int(bounds[-1]), END, U64)
        out[bounds[:-1]] = OPEN
        row_of = np.repeat(np.arange(j - i), counts)
        out[np.arange(len(h)) + 2 * row_of + 1] = h
        yield out, bounds, i, j


def places(bounds: np.ndarray) -> np.ndarray:
    """Place of each token in its row."""
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


class Tally:
    """Counts of hashes, held in arrays of bounded size."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, keys: np.ndarray, count: np.ndarray):
        self.parts.append((keys, count))
        self.rows += len(keys)
        if self.rows > HELD:
            self.fold()
            if self.rows > HELD // 2:
                yield self.flush()

    def fold(self) -> None:
        keys, counts = (np.concatenate(c) for c in zip(*self.parts))
        keys, inverse = np.unique(keys, return_inverse=True)
        self.parts = [(keys, np.bincount(inverse, counts, len(keys)).astype(np.int64))]
        self.rows = len(keys)

    def flush(self) -> pa.RecordBatch:
        self.fold()
        keys, count = self.parts[0]
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(kernel.as_long(keys)), pa.array(count)], ["h", "c"])


def word_counts(batches):
    """Counts of the words of the training rows of ``(learn, text)``; the opening token counts the tokens of all rows."""
    tally = Tally()
    for b in batches:
        learn = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for tokens, bounds, i, j in streams(b.column(1)):
            use = np.repeat(learn[i:j], np.diff(bounds)) & (places(bounds) > 0)
            keys, count = np.unique(tokens[use], return_counts=True)
            yield from tally.add(np.append(keys, OPEN), np.append(count, len(tokens)))
    if tally.parts:
        yield tally.flush()


# --- arrays in binary columns ----------------------------------------------------------------

def cells(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per run of ``values``."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64)),
                                                                      pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def pack(values: np.ndarray, bounds: np.ndarray, small=np.uint8) -> list[pa.Array]:
    """Runs of numbers as two binary columns: narrow ones, and the wide ones that a narrow one stands for with its largest value."""
    top = np.iinfo(small).max
    wide = values >= top
    before = np.concatenate([[0], np.cumsum(wide)])
    return [cells(np.where(wide, top, values).astype(small), bounds), cells(values[wide].astype(U64), before[bounds])]


def unpack(table: pa.Table, name: str, small=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows and how many each row has."""
    def read(column, kind):
        offsets, raw = kernel.utf8(column)
        return raw[offsets[0]:offsets[-1]].copy().view(kind), np.diff(offsets) // np.dtype(kind).itemsize
    narrow, sizes = read(table.column(name), small)
    out = narrow.astype(U64)
    out[narrow == np.iinfo(small).max] = read(table.column(name + "_wide"), U64)[0]
    return out, sizes


def packed(names: list[str]) -> list[str]:
    return [n + s for n in names for s in ("", "_wide")]


def ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


# --- blocks ----------------------------------------------------------------------------------

class Layout:
    """What all blocks agree on: codes of words, numbers of blocks and buckets, and which contexts are spread.

    Codes of frequent words are ranks by count from 1 on, 0 is the opening token; ``often`` of the first are spread as words,
    ``hot`` of them as words of longer contexts.
    """

    def __init__(self, hashes: np.ndarray, often: int, hot: int, size: int, order: int):
        hashes = np.concatenate([[OPEN], hashes]).astype(U64)
        by = np.argsort(hashes)
        self.hashes, self.ranks = hashes[by], by.astype(U64)
        self.often, self.hot = often, min(often, hot)
        self.size, self.order, self.spread = size, order, min(SPREAD, size)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.ranks[at], tokens | RARE)


class Block:
    """The n-grams of some rows, numbered exactly, and the entries by which buckets are asked for them.

    Level ``n`` has n-grams ``0 .. sizes[n]``; ``index[n]`` is the n-gram that ends at each token or -1, ``counts[n]`` how often
    training rows have it.  ``entries[n]`` are the n-grams in the order of asking; a spread one occurs once per bucket, but its
    count goes to its first.
    """

    def __init__(self, layout: Layout, table: pa.Table):
        codes, lengths = unpack(table, "w", np.uint16)
        learn = table.column("learn").to_numpy().astype(bool)
        self.bounds = ends(lengths)
        self.place = places(self.bounds)
        train = np.repeat(learn, lengths)
        self.words, u = np.unique(codes, return_inverse=True)
        width = len(self.words)
        self.index, self.counts, self.sizes = [u], [np.bincount(u, train, width).astype(np.int64)], [width]
        self.parents, self.lasts = [np.zeros(0, np.int64)], [np.arange(width)]
        for n in range(2, layout.order + 1):
            at = np.flatnonzero(self.place >= n - 1)
            # the number of the context and of the last word in one: a block has far fewer than 2 ** 31 of each
            keys, inverse = np.unique(self.index[-1][at - 1].astype(np.int64) * width + u[at], return_inverse=True)
            index = np.full(len(codes), -1)
            index[at] = inverse
            self.index.append(index)
            self.counts.append(np.bincount(inverse, train[at], len(keys)).astype(np.int64))
            self.sizes.append(len(keys))
            self.parents.append(keys // width)
            self.lasts.append(keys % width)
        self._lay_out(layout)

    def _lay_out(self, layout: Layout) -> None:
        k, size = layout.spread, layout.size
        mixed = kernel.mix(self.words + U64(1))
        turn = ((mixed >> U64(32)) % U64(k)).astype(np.int64)
        often, hot = self.words <= layout.often, self.words <= layout.hot
        home, slot, spread, chain = (mixed % U64(size)).astype(np.int64), np.zeros(len(self.words), np.int64), often, often & hot
        self.entries, self.sent, self.children, self.bucket = [], [], [], []
        for n in range(layout.order):
            parent, last = self.parents[n], self.lasts[n]
            if n:
                up_slot, up_spread, up_entry = slot, spread, entry_of
                home = home[parent]
                slot = (up_slot[parent] + np.where(up_spread[parent], turn[last], 0)) % k
                chain = chain[parent] & hot[last]
                spread = chain
            grams = self.sizes[n]
            many = np.flatnonzero(spread)
            number = np.zeros(grams, np.int64)
            number[many] = np.arange(len(many))
            gram = np.concatenate([np.arange(grams), np.repeat(many, k - 1)])
            step = np.concatenate([np.zeros(grams, np.int64), np.tile(np.arange(1, k), len(many))])
            at = (slot[gram] + step) % k
            if n:
                rank_up = up_entry(parent[gram], at)
                by = np.argsort(rank_up, kind="stable")
                self.children.append(np.bincount(rank_up, minlength=len(self.entries[-1])))
            else:
                by = np.argsort((home[gram] + at) % size, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))

            def entry_of(g, s, rank=rank, slot=slot, spread=spread, number=number, grams=grams):
                step = np.where(spread[g], (s - slot[g]) % k, 0)
                return rank[np.where(step == 0, g, grams + number[g] * (k - 1) + step - 1)]

            self.entries.append(gram[by])
            self.sent.append(np.where(step == 0, self.counts[n][gram], 0)[by])
            self.bucket.append(((home[gram] + at) % size)[by])

    def totals(self, n: int, values: np.ndarray) -> np.ndarray:
        """Answers to the entries of a level, added up by n-gram."""
        return np.bincount(self.entries[n], values, self.sizes[n])


def code_rows(layout: Layout):
    """``(id, learn, block, text)`` to rows of word codes."""
    def run(batches):
        for b in batches:
            for tokens, bounds, i, j in streams(b.column(3)):
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in range(3)] + pack(layout.codes(tokens), bounds, np.uint16),
                                                 ["id", "learn", "block", "w", "w_wide"])
    return run


def ask_names(order: int) -> list[str]:
    return packed([f"{c}{n}" for n in range(order) for c in ("last", "count", "children")][:-1])


def answer_names(order: int) -> list[str]:
    return packed([f"{c}{n}" for n in range(order) for c in ("count", "followers")][:-1])


def ask(layout: Layout):
    """The n-grams of a block by bucket."""
    def run(table: pa.Table) -> pa.Table:
        block = Block(layout, table)
        asked = np.unique(block.bucket[0])
        columns = [pa.array(np.full(len(asked), table.column("block")[0].as_py(), np.int32)), pa.array(asked.astype(np.int32))]
        for n in range(layout.order):
            # buckets without entries of a level are empty runs of it
            bounds = np.append(np.searchsorted(block.bucket[n], asked), len(block.bucket[n]))
            columns += pack(block.words[block.lasts[n][block.entries[n]]], bounds, np.uint16)
            columns += pack(block.sent[n], bounds)
            if n < layout.order - 1:
                columns += pack(block.children[n], bounds)
        return pa.Table.from_arrays(columns, ["block", "bucket", *ask_names(layout.order)])
    return run


def answer(layout: Layout):
    """Counts and numbers of followers over all blocks, in the order each block asked."""
    def run(table: pa.Table) -> pa.Table:
        columns, parent, up, children = [], None, 0, None
        levels = []
        for n in range(layout.order):
            last, sizes = unpack(table, f"last{n}", np.uint16)
            _, key = np.unique(last, return_inverse=True)
            if n:
                # runs of children stand in the order of their parents, row by row
                key += np.repeat(parent, children.astype(np.int64)) * (int(key.max(initial=0)) + 1)
                keys, first, key = np.unique(key, return_index=True, return_inverse=True)
                owner = np.repeat(parent, children.astype(np.int64))[first]
            groups = int(key.max(initial=-1)) + 1
            count = np.bincount(key, unpack(table, f"count{n}")[0], groups).astype(np.int64)
            if n:
                levels[-1][2] = np.bincount(owner[count > 0], minlength=up)
            levels.append([key, count, None, ends(sizes)])
            if n < layout.order - 1:
                parent, up, children = key, groups, unpack(table, f"children{n}")[0]
        for key, count, followers, bounds in levels:
            columns += pack(count[key], bounds)
            if followers is not None:
                columns += pack(followers[key], bounds)
        return pa.Table.from_arrays([table.column("block"), table.column("bucket"), *columns], ["block", "bucket", *answer_names(layout.order)])
    return run


# --- traversal -------------------------------------------------------------------------------

def traverse(arcs: list[np.ndarray], fails: list[np.ndarray]) -> np.ndarray:
    """Weights of the tokens, all of which go down from the longest context at once.

    ``arcs[n]`` is the weight of the (n+1)-gram that ends at a token, NaN where there is no such arc; ``fails[n]`` the failure weight
    of the state of the n+1 tokens before, 0 where there is no such state.
    """
    weight, moving = np.zeros(len(arcs[0])), np.ones(len(arcs[0]), bool)
    for n in range(len(arcs) - 1, 0, -1):
        arc = moving & ~np.isnan(arcs[n])
        weight[arc] += arcs[n][arc]
        moving &= ~arc
        weight[moving] += fails[n - 1][moving]
    weight[moving] += arcs[0][moving]
    return weight


def score_block(layout: Layout, total: int, types: int):
    """Scores of the rows of a block, which has the answers of all buckets it asked."""
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(layout, rows)
        answers = answers.sort_by("bucket")
        tokens = len(block.place)
        arcs, fails, chance, context, after = [], [], None, None, None
        for n in range(layout.order):
            count = block.totals(n, unpack(answers, f"count{n}")[0])
            if n == 0:
                seen = count[block.index[0]]
                chance = (seen + 1) / (total + types + 1)
                arcs.append(np.log10(chance))
                known = (seen > 0) & (block.place > 0)
            else:
                at = np.flatnonzero(block.place >= n)
                before = block.index[n - 1][at - 1]
                base, c = np.maximum(context[before], 1), count[block.index[n][at]]
                left = np.where(after[before] > 0, np.clip(DISCOUNT * after[before] / base, 1e-9, 1.0), 1.0)
                chance[at] = np.where(c > 0, (c - DISCOUNT) / base, 0.0) + left * chance[at]
                arc, fail = np.full(tokens, np.nan), np.zeros(tokens)
                arc[at] = np.where(c > 0, np.log10(chance[at]), np.nan)
                fail[at] = np.log10(left)
                arcs.append(arc)
                fails.append(fail)
            if n < layout.order - 1:
                context, after = count, block.totals(n, unpack(answers, f"followers{n}")[0])
        lengths = np.diff(block.bounds)
        row_of, counted = np.repeat(np.arange(len(lengths)), lengths), block.place > 0
        add = lambda values: np.bincount(row_of[counted], values[counted], len(lengths))
        return pa.Table.from_arrays(
            [rows.column("id"), pa.array(lengths - 1), pa.array(add(known).astype(np.int64)), pa.array(np.full(len(lengths), total, np.int64)),
             pa.array(add(arcs[0])), pa.array(add(traverse(arcs, fails)))],
            ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def learn(rows: DataFrame, order: int = ORDER) -> tuple[Layout, int, int]:
    """Layout, number of tokens and of different words of the training rows of ``(learn, text)``."""
    counted = materialize(arrow_map(rows, word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    mark = F.col("h") == int(OPEN.astype(np.int64))
    words = counted.filter(~mark)
    total, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens = counted.filter(mark).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    frequent = words.orderBy(F.desc("c"), "h").limit(CODES).toArrow()  # a megabyte at any corpus size
    counts = frequent.column("c").to_numpy()
    often, hot = (int((counts >= max(1.0, share * total)).sum()) for share in (WORD_SHARE, NGRAM_SHARE))
    # as many as the tokens need; small inputs still use all shuffle partitions
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(-(-tokens // BLOCK), min(parts, -(-tokens // 4096)), 1)
    return Layout(frequent.column("h").to_numpy().view(U64), often, hot, size, order), total, types


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``(<id_col>, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased, compared by 63 bits of a hash; each text ends in a closing
    token.  Null texts are empty ones and have the closing token alone.  Repeated rows are scored alike; rows equal in id and text
    share a block.  Without training rows every token has probability ``1 / 1``.  Null ids are kept, an empty table gives an empty
    result, further columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    use = F.coalesce(train, F.lit(False)).alias("learn")
    layout, total, types = learn(docs.select(use, F.col(text_col).alias("text")), order)
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(layout.size)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), use, block.alias("block"), F.col(text_col).alias("text"))
    binary = lambda names: "".join(f", {n} binary" for n in names)
    # both uses read all columns of this shuffle, so Spark makes it once
    coded = arrow_map(rows, code_rows(layout), f"id {id_type}, learn boolean, block int, w binary, w_wide binary").repartition(layout.size, "block")
    asked = coded.groupBy("block").applyInArrow(ask(layout), "block int, bucket int" + binary(ask_names(order)))
    answers = (asked.repartition(layout.size, "bucket").groupBy("bucket")
               .applyInArrow(answer(layout), "block int, bucket int" + binary(answer_names(order))).repartition(layout.size, "block"))
    scored = coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score_block(layout, total, types),
        f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
