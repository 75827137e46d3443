"""Sequence packing: best-fit decreasing, certified by lower bounds from dual-feasible functions, with exchange rounds.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut.  Full pieces are sequences of
their own.  The others are dealt over partitions of bounded size and packed there by best-fit decreasing.  For each
partition the largest bound that a family of dual-feasible functions gives tells whether its number of sequences is
certainly least.  Partitions with a gap, and the one loosely filled sequence that any partition may have, give up their
loosest sequences; these pieces are dealt anew to fewer partitions and packed again, until no round saves a sequence or
the bound over all pieces is met.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

CAPACITY = 2048
#: pieces that one task packs; the number of partitions follows the number of pieces
PER_TASK = 40_000
#: distinct words a task remembers before it starts anew; bounds the memory, not the result
REMEMBERED = 600_000
PIECES = "id {t}, row long, piece int, start long, length int, ids_crc32 long"


# --- tokens --------------------------------------------------------------------------------

class WordEncoder:
    """Token ids of texts, word by word.

    The vocabulary drops white space and never joins tokens across it, so a text's ids are its words' ids in a row.
    ASCII punctuation other than the apostrophe splits off a letter or digit before it.  Words of plain letters are one
    unit of the vocabulary each and end in a token that closes words, so many of them are encoded as one text.  A text with
    ``<|`` is encoded whole, as special tokens are found before anything is split.
    """

    def __init__(self, vocabulary: bytes):
        import re
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_buffer(vocabulary)
        names = self.tok.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.split = re.compile(rb"(?<=[0-9A-Za-z])(?=[!-&(-/:-@\[-`{-~])").sub
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        text = [w.decode() for w in words]
        plain = [i for i, w in enumerate(text) if w.isalpha() and max(w) < "ɐ"]
        other = sorted(set(range(len(text))).difference(plain))
        for i, ids in zip(other, self._ids([text[i] for i in other])):
            self.known[words[i]] = ids.tobytes()
        for k in range(0, len(plain), 1000):
            part = plain[k:k + 1000]
            ids = self._ids([" ".join(text[i] for i in part)])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):  # not one unit a word: encode each by itself
                for i, own in zip(part, self._ids([text[i] for i in part])):
                    self.known[words[i]] = own.tobytes()
                continue
            blob, a = ids.tobytes(), 0
            for i, b in zip(part, (ends * 4).tolist()):
                self.known[words[i]], a = blob[a:b], b

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = {i: self._ids([t.decode()])[0].tobytes() for i, t in enumerate(texts) if b"<|" in t}  # may hold special tokens
        parts = [[] if i in whole else self.split(b" ", t.lower()).split() for i, t in enumerate(texts)]
        if len(self.known) > REMEMBERED:
            self.known = {}
        self.learn(list(set().union(*parts).difference(self.known)))
        known = self.known
        return [whole[i] if i in whole else b"".join([known[w] for w in p]) for i, p in enumerate(parts)]


def encoded(batches, vocabulary, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = WordEncoder(vocabulary)
    for b in batches:
        ids, row, texts = b.column(0), b.column(1).to_numpy(), b.column(2)
        step = 256
        for k in range(0, b.num_rows, step):
            raw = [x or b"" for x in texts.slice(k, step).cast(pa.large_binary()).to_pylist()]
            take, piece, start, length, crc, blobs = [], [], [], [], [], []
            for i, blob in enumerate(enc.encode(raw)):
                blob += b"\0\0\0\0"
                for n, a in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[a:a + 4 * capacity]
                    take.append(k + i)
                    piece.append(n)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        blobs.append(part)
            arrays = [ids.take(pa.array(take, pa.int64())), pa.array(row[take]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int32()), pa.array(crc, pa.int64())] + ([pa.array(blobs, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)


def pieces(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """``(id, row, piece, start, length, ids_crc32[, ids])`` for every piece of every row of ``docs``.

    A document is its token ids and a closing 0; so an empty or null text has one id.  ``row`` tells repeated ids apart;
    read it from a materialised result only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the file's size is fixed, 2 MB
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
    schema = PIECES.format(t=id_type) + (", ids binary" if with_ids else "")
    return arrow_map(rows, lambda batches: encoded(batches, shared.value, capacity, with_ids), schema)


# --- packing one partition ------------------------------------------------------------------

def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest bound of the dual-feasible functions, in whole numbers.

    The families are the threshold function (sizes over ``capacity - e`` count as full ones, sizes under ``e`` as none)
    for every ``e``, the rounding functions ``k = 1 .. 20`` and each rounding after the sum of sizes itself.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    many, mass = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    full = many[capacity] - many[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    best = max(best, int((full + -(-middle // capacity)).max()))
    for k in range(1, 21):  # k parts: floor((k+1) x / capacity) / k, and x itself where that is whole
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        value = np.where(whole, x * k, (scaled // capacity) * capacity)  # over k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each piece, by best-fit decreasing; the smallest room that suffices comes from a bit set of rooms."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, used = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = present >> s
        if fits:
            room = s + ((fits & -fits).bit_length() - 1)
            stack = by_room[room]
            k = stack.pop()
            if not stack:
                present ^= 1 << room
        else:
            room, k, used = capacity, used, used + 1
        bins[i] = k
        left = room - s
        if left:
            if not by_room[left]:
                present |= 1 << left
            by_room[left].append(k)
    return bins, used


def pack_part(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack the pieces of one partition; ``gap`` is its bins beyond the certified least number."""
    pdf = pdf.sort_values(["row", "piece"], kind="stable").reset_index(drop=True)
    sizes = pdf["length"].to_numpy(np.int64)
    bins, used = best_fit(sizes, capacity)
    fill = np.bincount(bins, sizes, used)
    order = np.lexsort((np.arange(len(bins)), bins))
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    base = np.maximum.accumulate(np.where(first, starts, 0))
    offset = np.empty(len(bins), np.int64)
    offset[order] = starts - base
    return pdf.assign(bin=bins, offset=offset, fill=fill[bins].astype(np.int64), bins=used, gap=used - lower_bound(sizes, capacity))


PACKED = "part int, row long, piece int, length int, bin long, offset long, fill long, bins long, gap long"


def _pack_round(loose: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    dealt = loose.select(F.pmod(F.xxhash64("row", "piece", F.lit(seed)), F.lit(parts)).cast("int").alias("part"), "row", "piece", "length")
    packed = dealt.groupBy("part").applyInPandas(lambda pdf: pack_part(pdf, capacity)[[c.split()[0] for c in PACKED.split(", ")]], PACKED)
    return materialize(packed, "packed")


def pack(parts: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK, max_rounds: int = 4) -> tuple[DataFrame, list[dict]]:
    """``(row, piece, sequence_id, offset)`` for pieces ``(row, piece, length)`` and a report for each round.

    ``parts`` must be a materialised table.  Sequence ids are unique numbers without meaning.  A round's result stands
    only if it needs fewer sequences for the pieces that were given up; ``max_rounds`` bounds the work, not the result:
    every piece is placed after the first round.
    """
    full = parts.filter(F.col("length") == capacity)
    loose = parts.filter(F.col("length") < capacity)
    n = loose.count()
    report: list[dict] = []
    placed: list[DataFrame] = []
    if n:
        total = loose.agg(F.sum("length")).first()[0]
        now = _pack_round(loose, -(-n // per_task), 0, capacity)
        for turn in range(1, max_rounds + 1):
            facts = now.groupBy("part").agg(F.first("bins").alias("bins"), F.first("gap").alias("gap")).agg(
                F.sum("bins").alias("bins"), F.sum("gap").alias("gap"), F.count(F.lit(1)).alias("parts")).first()
            report.append({"round": turn - 1, "pieces": n, "bins": facts.bins, "gap": facts.gap, "parts": facts.parts})
            if facts.parts == 1 or facts.gap == 0 or turn == max_rounds:
                break
            # give up the loosest bins of partitions with a gap: those that leave more than the mean room of the partition
            room = (F.col("bins") * capacity - F.sum("length").over(_of_part())) / F.col("bins")
            marked = now.withColumn("room", room).withColumn("open", (F.col("gap") > 0) & (F.lit(capacity) - F.col("fill") > F.col("room")))
            marked = materialize(marked, "marked")
            kept, given = marked.filter("NOT open"), marked.filter("open")
            size = given.count()
            if not size:
                break
            before = given.select("part", "bin").distinct().count()
            again = _pack_round(given, max(1, min(facts.parts - 1, -(-size // per_task))), turn, capacity)
            after = again.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
            if after >= before:
                break
            placed.append(kept.select("row", "piece", "part", "bin", "offset", F.lit(turn - 1).alias("turn")))
            now, n = again, size
        placed.append(now.select("row", "piece", "part", "bin", "offset", F.lit(len(report)).alias("turn")))
        report.append({"total_bound": -(-total // capacity)})
    ids = F.shiftleft(F.col("turn").cast("long"), 56).bitwiseOR(F.shiftleft(F.col("part").cast("long"), 32)).bitwiseOR(F.col("bin"))
    out = full.select("row", "piece", F.xxhash64("row", "piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    for p in placed:
        out = out.unionByName(p.select("row", "piece", ids.alias("sequence_id"), "offset"))
    # full pieces have a sequence each, numbered below zero in a written table; the others' numbers hold up to 2**24 partitions of 2**32 bins
    alone = materialize(full.select("row", "piece", F.monotonically_increasing_id().alias("n")), "full-pieces")
    return out.unionByName(alone.select("row", "piece", (-F.col("n") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))), report


def _of_part():
    from pyspark.sql import Window
    return Window.partitionBy("part")


def pack_documents(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """``(<id_col>, piece, start, length, ids_crc32, sequence_id, offset[, ids])``, one row per piece.

    Repeated rows and null ids are documents of their own; null and empty texts have the closing id alone; an empty
    table gives an empty result; further columns are not read.
    """
    cut = materialize(pieces(docs, vocabulary, capacity, id_col, text_col, with_ids), "pieces")
    place, _ = pack(cut.select("row", "piece", "length"), capacity)
    out = cut.join(place, ["row", "piece"]).withColumnRenamed("id", id_col).withColumn("length", F.col("length").cast("long"))
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the packed token ids themselves, of a result with ``ids``.

    A sequence has at most ``capacity`` tokens, so each group is small.
    """
    rows = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return rows.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
