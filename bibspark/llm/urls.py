"""URL filter: exact host/path rules first, else a logistic regression on hashed character n-grams of host and path."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import UPPER, arrow_map

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)

# --- the labelled table: a small one, built from word lists by rule ------------------------

#: words of hosts and paths that training labels ``block`` and ``allow``
BLOCK_WORDS = ["casino", "poker", "pills", "cheap-pills", "viagra", "spam-farm", "spam", "porn", "xxx", "adult", "escort", "torrent",
               "warez", "crack", "betting", "payday-loans", "replica-watches", "link-farm", "click-bait", "free-money",
               "bets", "ads", "ad-tracker"]
ALLOW_WORDS = ["news", "blog", "docs", "library", "museum", "school", "science", "weather", "recipes", "garden", "travel", "history",
               "forum", "shop", "music", "sports", "health", "archive", "journal", "community"]
#: neutral site names are pairs of these
SYLLABLES = ["the", "an", "er", "re", "ti", "ba", "lo", "nu", "in", "st", "mar", "dor"]
PLACES = ["{w}.example.com/en/{n}", "www.{w}.example.net/{w}/{n}.html", "m.{w}.example.org/de/{n}/", "blog.{w}.example.com/fr/{n}",
          "{w}-online.example.org/es/{n}", "www.site{n}.example.com/{w}/{n}"]


def labelled_urls() -> list[tuple[str, int]]:
    """``(url, 1 to block)``: every word in every place, and neutral names in two places each."""
    named = [("https://" + place.format(w=w, n=17 + 7 * i), label)
             for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)) for i, w in enumerate(words) for place in PLACES]
    neutral = [("https://" + PLACES[(i + k) % 4].format(w=a + b, n=11 + 13 * i + k), 0)
               for i, a in enumerate(SYLLABLES) for k, b in enumerate(SYLLABLES) if a != b]
    return named + neutral


# --- features and model --------------------------------------------------------------------

def grams(offsets: np.ndarray, data: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every character n-gram of every row; rows are padded with a blank on both sides."""
    lens = np.diff(offsets)
    padded = lens + 2
    first = np.cumsum(padded) - padded
    buf = np.full(int(padded.sum()), 32, np.uint8)
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(first + 1, lens)
    buf[at] = data[offsets[0]:offsets[-1]]
    row_of = np.repeat(np.arange(len(lens)), padded)
    left = np.repeat(first + padded, padded) - np.arange(len(buf))
    code = kernel.BYTE_CODE[buf]
    rows, buckets = [], []
    for n in GRAMS:
        ok = np.flatnonzero(left >= n)
        h = np.full(len(ok), np.uint64(salt * 8 + n))
        for t in range(n):
            h += code[ok + t] * np.uint64(kernel.STEP[t])
        rows.append(row_of[ok])
        buckets.append((kernel.mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and the weight of one n-gram of each row (rows have unit length if no n-gram repeats)."""
    (r1, b1), (r2, b2) = grams(*kernel.utf8(host), 1), grams(*kernel.utf8(path), 2)
    rows, buckets = np.concatenate([r1, r2]), np.concatenate([b1, b2])
    return rows, buckets, 1.0 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(host)), 1))


def split_url(url: str) -> tuple[str, str]:
    """Host and path as the DataFrame columns define them, for the training table."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:stop]


def train(table: list[tuple[str, int]], epochs: int = 300, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent; the table is small by contract."""
    parts = [split_url(u) for u, _ in table]
    y = np.array([label for _, label in table], float)
    rows, buckets, unit = features(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        z = np.bincount(rows, w[buckets], len(y)) * unit + b
        err = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(buckets, (err * unit)[rows], BUCKETS) / len(y) + decay * w)
        b -= rate * err.mean()
    return w, b


# --- DataFrame side ------------------------------------------------------------------------

def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest rule that fits, of ``(action, host, path)`` rules; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = action = F.lit(None).cast("string")
    for act, rh, rp in reversed(ordered):
        fits = ((host == rh) | F.endswith(host, F.lit("." + rh))) & F.startswith(path, F.lit(rp))
        rule, action = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], table: list[tuple[str, int]] | None = None,
               id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``(<id_col>, host, path, rule, verdict, score)``, one row per row of ``pages``.

    ``score`` is the model's probability of ``block`` on host and path; a fitting rule overrides it.  A null url or one
    without ``://`` has empty host and path and is judged by the model alone.  Repeated rows are judged alike, other
    columns are not read, an empty table gives an empty result.
    """
    weights, bias = train(table or labelled_urls())
    weights = weights.astype(np.float32)
    id_type = pages.schema[id_col].dataType.simpleString()
    parts = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))

    def scored(batches):
        for b in batches:
            rows, buckets, unit = features(b.column("host"), b.column("path"))
            z = np.bincount(rows, weights[buckets], b.num_rows) * unit + bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], ["id", "host", "path", "score"])

    out = arrow_map(parts, scored, f"id {id_type}, host string, path string, score double")
    rule, action = best_rule(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(action, model).alias("verdict"), "score")
