"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its subwords (byte n-grams of words padded with blanks, and the words
themselves).  Training is stochastic gradient descent in numpy on a bounded sample of labelled rows.  Because the
average and the softmax layer are linear, prediction needs only one number per bucket and language; each distinct word
of a slice is scored once.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import arrow_map, give_back

BUCKETS = 1 << 16
DIM = 16
GRAMS = (2, 3, 4)
#: the training sample: so many rows a language at most (in expectation of a hash sample), of texts up to this length
PER_LANG, MAX_CHARS = 1500, 20_000
UNKNOWN = "und"
#: distinct words that are scored at a time, and bytes of texts that make a slice of a prediction
WORDS, SLICE = 8192, 1 << 19


def word_buckets(words: kernel.Words, pick: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, number)`` of the subwords of the picked words, word after word."""
    lens, starts = words.length[pick], words.start[pick]
    padded = lens + 2
    first = np.cumsum(padded) - padded
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    buf = np.full(int(padded.sum()), 32, np.uint8)
    buf[place + np.repeat(first + 1, lens)] = words.data[place + np.repeat(starts, lens)]
    left = np.repeat(first + padded, padded) - np.arange(len(buf))
    code = kernel.BYTE_CODE[buf]
    word_of = np.repeat(np.arange(len(pick)), padded)
    owners, buckets = [np.arange(len(pick))], [h[pick] & np.uint64(BUCKETS - 1)]
    for n in GRAMS:
        ok = np.flatnonzero(left >= n)
        g = np.full(len(ok), np.uint64(n))
        for t in range(n):
            g += code[ok + t] * np.uint64(kernel.STEP[t])
        owners.append(word_of[ok])
        buckets.append(kernel.mix(g) & np.uint64(BUCKETS - 1))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def slices_of(column: pa.Array, limit: int):
    """``(words, hash, distinct, inverse, letters)`` of each slice."""
    offsets, raw = kernel.utf8(column)
    for i, j in kernel.slices(offsets, limit):
        w = kernel.Words(offsets, raw, i, j, kernel.BLANKS)
        h = w.hashes()
        _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
        base = offsets[i]
        ascii_letters = np.concatenate([[0], np.cumsum((w.data >= 97) & (w.data <= 122))])
        letters = np.diff(ascii_letters[offsets[i:j + 1] - base]) > 0
        for k in np.flatnonzero(~letters):
            text = raw[offsets[i + k]:offsets[i + k + 1]].tobytes()
            letters[k] = any(ch.isalpha() for ch in text.decode("utf-8", "replace"))
        yield w, h, pick, inverse, letters


# --- training (on the driver, on the bounded sample) ----------------------------------------

def sample_matrix(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct buckets and their shares."""
    out = []
    for w, h, pick, inverse, _ in slices_of(texts, 1 << 20):
        owner, bucket = word_buckets(w, pick, h)
        order = np.argsort(owner, kind="stable")
        owner, bucket = owner[order], bucket[order]
        at = np.searchsorted(owner, np.arange(len(pick) + 1))
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            ids, times = np.unique(inverse[a:b], return_counts=True)
            if not len(ids):
                out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
                continue
            n = at[ids + 1] - at[ids]
            flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[ids], n)
            weight = np.bincount(bucket[flat], np.repeat(times, n), BUCKETS)
            hot = np.flatnonzero(weight).astype(np.int32)
            out.append((hot, (weight[hot] / weight.sum()).astype(np.float32)))
    return out


def train(rows: list, labels: np.ndarray, n_langs: int, least_epochs: int = 6, least_steps: int = 1000, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax layer by mini-batch gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    top = np.zeros((DIM, n_langs), np.float32)
    size, done = 16, 0
    epochs = max(least_epochs, -(-least_steps * size // max(len(rows), 1)))
    steps = epochs * (len(rows) // size + 1)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), size):
            part = [int(x) for x in order[k:k + size] if len(rows[x][0])]
            done += 1
            if not part:
                continue
            lens = np.array([len(rows[x][0]) for x in part])
            ids, val = np.concatenate([rows[x][0] for x in part]), np.concatenate([rows[x][1] for x in part])
            first = np.cumsum(lens) - lens
            hidden = np.add.reduceat(emb[ids] * val[:, None], first)
            z = hidden @ top
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            step = rate * (1 - done / (steps + 1))
            back = (p @ top.T).astype(np.float32)
            top -= step * (hidden.T @ p).astype(np.float32)
            order_ids = np.argsort(ids, kind="stable")
            grad = (np.repeat(back, lens, 0) * val[:, None])[order_ids]
            uniq, at = np.unique(ids[order_ids], return_index=True)
            emb[uniq] -= step * DIM * np.add.reduceat(grad, at)
    return emb, top


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


class Model:
    """``table`` has the logits of each bucket; ``scale`` the calibration; below ``floor`` a text is rejected."""

    def __init__(self, langs: list[str], table: np.ndarray, scale: float, floor: float):
        self.langs, self.table, self.scale, self.floor = langs, table, scale, floor


def fit(texts: pa.Array, langs: list[str]) -> Model:
    """Train on four fifths of the sample, calibrate the temperature and the rejection floor on the rest."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 1), np.float32), 1.0, 0.0)
    y = np.array([names.index(x) for x in langs])
    rows = sample_matrix(texts)
    held = np.arange(len(rows)) % 5 == 4
    fit_on = [i for i in range(len(rows)) if not held[i]]
    emb, top = train([rows[i] for i in fit_on], y[fit_on], len(names))
    table = (emb @ top).astype(np.float32)
    check = [i for i in np.flatnonzero(held) if len(rows[i][0])]
    scale, floor = 1.0, 0.0
    if check:
        z = np.array([(table[rows[i][0]] * rows[i][1][:, None]).sum(0) for i in check])
        losses = [(-np.log(softmax(z * s)[np.arange(len(check)), y[check]] + 1e-12).mean(), s) for s in (0.25, 0.5, 1, 1.5, 2, 3, 4, 6, 8)]
        scale = float(min(losses)[1])
        floor = float(min(softmax(z * scale).max(1).min(), 1.4 / len(names)))
    return Model(names, table, scale, floor)


def train_sample(docs: DataFrame, text_col: str, lang_col: str, key: Column, learn: Column) -> tuple[pa.Array, list[str]]:
    """A hash sample of the labelled rows, about ``PER_LANG`` for each language; all rows where there are fewer."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= MAX_CHARS))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    if not counts:
        return pa.array([], pa.string()), []
    slot = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 24))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col(lang_col) == lang) & (slot < min(1 << 24, int((1 << 24) * PER_LANG / n) + 1)))
    got = rows.filter(keep).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), key.alias("k")).toArrow()
    order = np.argsort([zlib.crc32(f"{k} {t}".encode()) for k, t in zip(got.column("k").to_pylist(), got.column("t").to_pylist())], kind="stable")
    got = got.take(pa.array(order))
    return got.column("t").combine_chunks(), got.column("l").to_pylist()


# --- prediction ----------------------------------------------------------------------------

def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(<id_col>, lang_pred, score, rejected)``, one row per row of ``docs``.

    Learns from rows where ``learn`` holds and the language is not null; predicts from the text alone.  ``score`` is the
    calibrated probability of the predicted language.  A null text or one without a letter is ``und`` with score 0 and
    rejected; so is every text if no row is labelled.  Other texts are rejected (but keep their prediction) when their
    score is below the lowest score of the calibration rows, at most 1.4 times an even guess.  Repeated rows are
    predicted alike; further columns are not read.
    """
    model = fit(*train_sample(docs, text_col, lang_col, F.col(id_col), learn))
    id_type = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), predictor(model),
                    f"id {id_type}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def judge(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language (the last is unknown), score and rejection of each text."""
    best, score, reject = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
    for w, h, pick, inverse, letters in slices_of(column, SLICE):
        z, n = np.zeros((len(pick), model.table.shape[1]), np.float32), np.zeros(len(pick))
        for a in range(0, len(pick), WORDS):  # distinct words, a bounded number at a time
            part = pick[a:a + WORDS]
            owner, bucket = word_buckets(w, part, h)
            n[a:a + len(part)] = np.bincount(owner, minlength=len(part))
            for c in range(z.shape[1]):
                z[a:a + len(part), c] = np.bincount(owner, model.table[bucket, c], len(part))
        rows = len(w.counts)
        row_of = np.repeat(np.arange(rows), w.counts)
        total = np.maximum(np.bincount(row_of, n[inverse], rows), 1)
        logits = np.stack([np.bincount(row_of, z[inverse, c], rows) for c in range(z.shape[1])], 1) / total[:, None]
        p = softmax(logits * model.scale)
        ok = letters & bool(model.langs)
        top = np.where(ok, p.max(1), 0.0)
        best.append(np.where(ok, p.argmax(1), len(model.langs)))
        score.append(top)
        reject.append(~ok | (top < model.floor))
    return np.concatenate(best), np.concatenate(score), np.concatenate(reject)


def predictor(model: Model):
    """Arrow function over ``(id, t)``."""
    names = np.array([*model.langs, UNKNOWN], dtype=object)

    def predict(batches):
        for b in batches:
            best, score, reject = judge(model, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(reject)],
                                             ["id", "lang_pred", "score", "rejected"])
    return predict


def keep_identified(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    model = fit(*train_sample(docs, text_col, lang_col, F.col(id_col), learn))
    give_back()  # what training held on the driver

    def keep(texts: pa.Array) -> pa.Array:
        good = pa.array(~judge(model, texts)[2])
        give_back()
        return good

    # texts alone go to the workers, the rows wait in the JVM
    return docs.filter(F.arrow_udf(keep, "boolean")(F.col(f"`{text_col}`")))
