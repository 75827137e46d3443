"""Periodic runs of words: a suffix automaton whose link tree is recoloured by last occurrence.

The states on the way from a prefix to the root are all suffixes that end there.  Appending a word gives that whole way a new
colour, the place of the word (the access of a link-cut tree).  A piece of the way that had one colour before holds the suffixes
that last ended at that place: if the longest of them is at least as long as the two ends lie apart, a square ends here, its
period is that distance, and the length of the suffix says how far the period reaches to the left.  The last place where the
same square start is met ends the run.  The automaton is built in one pass over the words, the accesses follow in the order of
the words; ways are kept as heavy chains with stacks of colour segments, so an access touches a logarithmic number of chains
and each segment it removes was pushed once.
"""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import arrow_map

LEAST, EXPONENT = 6, 4
#: words that are looked at together for repeated grams
SLICE_WORDS = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Link and longest length of every state, and the state of every prefix."""
    follow, link, longest, prefixes, last = [{}], [-1], [0], [], 0
    for word in words:
        new = len(longest)
        longest.append(longest[last] + 1)
        follow.append({})
        link.append(0)
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            old = follow[at][word]
            if longest[old] == longest[at] + 1:
                link[new] = old
            else:  # the shorter suffixes of ``old`` get a state of their own
                part = len(longest)
                longest.append(longest[at] + 1)
                follow.append(follow[old].copy())
                link.append(link[old])
                link[old] = link[new] = part
                while at >= 0 and follow[at].get(word) == old:
                    follow[at][word] = part
                    at = link[at]
        prefixes.append(new)
        last = new
    return link, longest, prefixes


def chains(link: list[int], longest: list[int]) -> list[int]:
    """Top state of the heavy chain of every state."""
    n = len(link)
    by_length = np.argsort(np.array(longest), kind="stable").tolist()
    size, heavy = [1] * n, [0] * n
    for state in reversed(by_length[1:]):
        size[link[state]] += size[state]
    most = [0] * n
    for state in by_length[1:]:
        up = link[state]
        if size[state] > most[up]:
            most[up], heavy[up] = size[state], state
    top = list(range(n))
    for state in by_length[1:]:
        if heavy[link[state]] == state and link[state]:
            top[state] = top[link[state]]
    return top


def runs_of(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``words`` with ``length >= max(least, exponent * period)``, in order."""
    link, longest, prefixes = automaton(words)
    top = chains(link, longest)
    colours: dict[int, list] = {}  # per chain: (longest length of the segment, colour), the shortest one last
    ends: dict[tuple[int, int], int] = {}
    for place, state in enumerate(prefixes):
        squares = {}
        while state > 0:
            head, depth, done = top[state], longest[state], 0
            stack = colours.setdefault(head, [])
            while stack and stack[-1][0] <= depth:
                done, colour = stack.pop()
                if done >= (exponent - 1) * (place - colour):
                    squares[place - colour] = max(done, squares.get(place - colour, 0))
            if stack and done < depth and depth >= (exponent - 1) * (place - stack[-1][1]):
                period = place - stack[-1][1]
                squares[period] = max(depth, squares.get(period, 0))
            stack.append((depth, place))
            state = link[head]
        for period, suffix in squares.items():
            ends[place - period - suffix + 1, period] = place
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items() if end - start + 1 >= least)


def gram(least: int, exponent: int) -> int:
    """Largest k so that every k-gram inside any run occurs in it again, one period on or back: length - 2 * period + 1."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, max(2, least)))


def stretches(hashes: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Places ``(from, to)`` outside of which no run can lie; ``bounds`` are the ends of the texts in ``hashes``.

    Inside a run every gram comes again at the distance of the period, at most a share of the run.  So what lies between
    grams without a repeat that near can be looked at by itself, and this again for the shorter stretches that are left.
    Equal hashes of different words only make stretches longer.
    """
    k = gram(least, exponent)
    grams = kernel.windows(hashes, k)
    if not len(grams):
        return []
    text = np.searchsorted(bounds, np.arange(len(grams)), "right")
    whole = np.arange(len(grams)) + k <= bounds[text]
    order = np.lexsort((np.arange(len(grams)), grams, text))
    order = order[whole[order]]
    near = np.full(len(grams), np.iinfo(np.int64).max)
    if len(order) > 1:
        same = (grams[order[1:]] == grams[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        gap = order[1:] - order[:-1]
        np.minimum.at(near, order[1:][same], gap[same])
        np.minimum.at(near, order[:-1][same], gap[same])
    keep = near < np.iinfo(np.int64).max
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).view(np.int8)))
        cut = np.flatnonzero(keep[1:] & keep[:-1] & (text[1:] != text[:-1])) + 1
        edge = np.sort(np.concatenate([edge, cut, cut]))
        first, last = edge[0::2], edge[1::2]
        words = last - first + k - 1
        at = np.flatnonzero(keep)
        good = (near[at] * exponent <= np.repeat(words, last - first)) & np.repeat(words >= least, last - first)
        if good.all():
            return list(zip(first.tolist(), (first + words).tolist()))
        keep[at[~good]] = False


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words that no run repeats: of every run the first period stays."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def _search(texts: list[bytes], least: int, exponent: int):
    """``(number of words, runs, collapsed)`` of each text."""
    words = [t.split() for t in texts]  # on blanks and 09-0D, nothing else
    bounds = np.cumsum([len(w) for w in words])
    found: list[list] = [[] for _ in texts]
    hashes = np.fromiter((hash(x) for w in words for x in w), np.int64, int(bounds[-1])).view(np.uint64)
    for a, b in stretches(hashes, bounds, least, exponent):
        i = int(np.searchsorted(bounds, a, "right"))
        base = int(bounds[i]) - len(words[i])
        found[i] += [(a - base + s, length, p) for s, length, p in runs_of(words[i][a - base:b - base], least, exponent)]
    for w, runs in zip(words, found):
        runs.sort()
        yield len(w), runs, b" ".join(collapse(w, runs) if runs else w)


def _kernel(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).fill_null(b"")
            i, n = 0, len(texts)
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            while i < n:
                j, room = i + 1, 8 * SLICE_WORDS - int(size[i])
                while j < n and size[j] <= room:
                    room -= int(size[j])
                    j += 1
                rows = list(_search(texts[i:j].to_pylist(), least, exponent))
                best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None) for _, r, _ in rows]
                as_run = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
                yield pa.RecordBatch.from_arrays([
                    ids[i:j], pa.array([r[0] for r in rows], pa.int64()), pa.array([[as_run(x) for x in r[1]] for r in rows], pa.list_(RUN)),
                    pa.array([as_run(x) for x in best], RUN), pa.array([r[2] for r in rows], pa.binary()).view(pa.string())],
                    ["id", "n_words", "runs", "best", "collapsed"])
                i = j
    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``(<id_col>, n_words, runs, best, collapsed)``: all runs of each row's text.

    Words are what blanks and 09-0D separate, compared byte for byte.  A run is a stretch of words with smallest period
    ``period`` and ``length >= max(least, exponent * period)`` that no neighbouring word extends with that period
    (``exponent >= 2``).  ``runs`` is ordered by start, then period; ``best`` is the run with the greatest length / period (ties:
    smallest start, then period), null without a run.  ``collapsed`` has the words that no run contains after its first period,
    joined by one blank.  Null texts count as empty: no words, no runs, empty ``collapsed``.  Every row gives one row, repeated ids
    and null ids too; other columns are not read.  Memory follows the longest stretch of a text that may hold a run, about half
    a kilobyte a word; everything else is looked at in slices.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run has an exponent of at least 2 and at least one word")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, "
              "best struct<start: long, length: long, period: long>, collapsed string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _kernel(least, exponent), schema).withColumnRenamed("id", id_col)
