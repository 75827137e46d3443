"""License scan by diagonal voting.

Every rolling pair of words of every text is joined, in Spark, to the places where license templates have that pair.  A
match at text word ``p`` and template word ``q`` votes for the diagonal ``p - q``.  Votes are added up by text, template
and diagonal; neighbouring diagonals of a template (a word was put in or left out) are merged; the spans that remain are
verified on the words of the text.
"""
from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import arrow_map, materialize, maybe_member

K = 2
#: a merged span stands if so much of its template is there in order
COVER = 0.6
#: diagonals this close to each other are one span
NEAR = 4

# fixed values: phrases that must stand word for word, with their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: opening sentences of public licenses and notices, with the labels that the method adds
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
}


def templates() -> list[tuple[int, list[bytes], str, bool]]:
    """``(number, words, label, exact)``; phrases first."""
    rows = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in NOTICES.items()]
    return [(i, text.encode().split(), label, exact) for i, (text, label, exact) in enumerate(rows)]


def template_table(spark) -> DataFrame:
    """``(h, template, q)``: word pairs of all templates; as many rows as the fixed templates have words."""
    rows = []
    for i, words, _, _ in templates():
        offsets = np.array([0, len(b" ".join(words))], np.int64)
        raw = np.frombuffer(b" ".join(words), np.uint8)
        h = kernel.windows(kernel.Words(offsets, raw, 0, 1, kernel.NOT_ALNUM).hashes(), K)
        rows += [(int(x), i, q) for q, x in enumerate(kernel.as_long(h).tolist())]
    return spark.createDataFrame(rows, "h long, template int, q int")


# --- Arrow functions -----------------------------------------------------------------------

def count_words(batches):
    for b in batches:
        offsets, raw = kernel.utf8(b.column(2))
        n = [kernel.Words(offsets, raw, i, j, kernel.NOT_ALNUM).counts for i, j in kernel.slices(offsets)]
        if n:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n))], ["id", "x", "n_words"])


def rolling(batches):
    """All word pairs: ``(id, x, p, h)``."""
    for b in batches:
        offsets, raw = kernel.utf8(b.column(2))
        for i, j in kernel.slices(offsets):
            w = kernel.Words(offsets, raw, i, j, kernel.NOT_ALNUM)
            h = kernel.windows(w.hashes(), K)
            row_of = np.repeat(np.arange(i, j), w.counts)
            ok = np.flatnonzero(row_of[:len(h)] == row_of[K - 1:K - 1 + len(h)])
            rows = row_of[ok]
            place = ok - w.bounds[rows - i]
            for k in range(0, len(ok), 1 << 16):
                part = slice(k, k + (1 << 16))
                take = pa.array(rows[part])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(place[part].astype(np.int32)),
                                                  pa.array(kernel.as_long(h[ok[part]]))], ["id", "x", "p", "h"])


FOUND = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,last:int,cover:double>>"


def verify(batches):
    """``(id, x, text, spans)`` to labels; a span is ``(template, first, last)`` in words."""
    known = {i: (words, label, exact) for i, words, label, exact in templates()}
    for b in batches:
        out = []
        for text, spans in zip(b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist()):
            raw = np.frombuffer(text or b"", np.uint8)
            w = kernel.Words(np.array([0, len(raw)], np.int64), raw, 0, 1, kernel.NOT_ALNUM)
            base, kept = [], []
            for s in spans:
                words, label, exact = known[s["template"]]
                first, last = max(0, s["first"]), min(len(w.start), s["last"])
                here = [w.word(k) for k in range(first, last)]
                if exact:
                    if here == words:
                        base.append((first, label))
                        kept.append({"label": label, "first": first, "last": last, "cover": 1.0})
                    continue
                same = sum(m.size for m in difflib.SequenceMatcher(None, here, words, False).get_matching_blocks())
                if same >= COVER * len(words):
                    kept.append({"label": label, "first": first, "last": last, "cover": same / len(words)})
            size = {label: len(words) for words, label, _ in known.values()}
            notices, chosen = sorted((k for k in kept if k["label"] not in PHRASES.values()), key=lambda k: (-k["cover"] * size[k["label"]], k["first"], k["label"])), []
            for k in notices:  # of notices that overlap, the one with the most words in place
                if all(k["first"] >= c["last"] or c["first"] >= k["last"] for c in chosen):
                    chosen.append(k)
            kept = [k for k in kept if k["label"] in PHRASES.values() or k in chosen]
            starts = [p for p, _ in base]
            out.append({"n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted({k["label"] for k in kept})),
                        "score": max((k["cover"] for k in kept), default=0.0), "spans": kept})
        if out:
            kinds = pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("cover", pa.float64())])
            column = lambda name, t: pa.array([o[name] for o in out], t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), column("n_base", pa.int64()), column("first_word", pa.int64()), column("last_word", pa.int64()),
                 column("base_labels", pa.string()), column("labels", pa.string()), column("score", pa.float64()), column("spans", pa.list_(kinds))],
                ["id", "x", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


# --- DataFrame side ------------------------------------------------------------------------

def spans_of(votes: DataFrame, spark) -> DataFrame:
    """``(id, x, template, first, last)``: diagonals with enough votes, neighbours merged."""
    facts = spark.createDataFrame([(i, len(words), exact) for i, words, _, exact in templates()], "template int, size int, exact boolean")
    votes = votes.join(F.broadcast(facts), "template")
    whole = votes.filter("exact AND votes = size - 1").select("id", "x", "template", F.col("d").alias("first"), (F.col("d") + F.col("size")).alias("last"))
    order = Window.partitionBy("id", "x", "template").orderBy("d")
    rough = votes.filter("NOT exact AND (votes >= 2 OR size <= 6)")
    edge = (F.col("d") - F.lag("d").over(order) > NEAR) | F.lag("d").over(order).isNull()
    run = F.sum(edge.cast("int")).over(order)
    merged = (rough.withColumn("run", run).groupBy("id", "x", "template", "run", "size")
              .agg(F.sum("votes").alias("votes"), F.min("d").alias("d0"), F.max("d").alias("d1"))
              .filter(F.col("votes") + 1 >= F.col("size") * COVER * 0.7)
              .select("id", "x", "template", F.col("d0").alias("first"), (F.col("d1") + F.col("size")).alias("last")))
    return whole.unionByName(merged)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``, one row per row of ``docs``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come from the phrases that stand word for word;
    ``labels`` and ``score`` (the largest covered share of a template) also from the notices.  Texts without a find, null
    and empty ones have 0, null, empty strings and score 0.  Repeated rows get equal results.  Null ids are kept; an
    empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    x = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), x.alias("x"), F.col(text_col).alias("text"))
    facts = arrow_map(rows, count_words, f"id {id_type}, x long, n_words long")
    pairs = arrow_map(rows, rolling, f"id {id_type}, x long, p int, h long")
    hits = pairs.join(F.broadcast(template_table(spark)), "h")  # some 150 rows, fixed by the templates
    # repeated rows of one id and text vote together: the places of a diagonal are counted once
    votes = (hits.select("id", "x", "template", (F.col("p") - F.col("q")).alias("d"), "q").distinct()
             .groupBy("id", "x", "template", "d").agg(F.count(F.lit(1)).alias("votes")))
    spans = materialize(spans_of(votes, spark), "license-spans")
    listed = spans.groupBy("id", "x").agg(F.sort_array(F.collect_list(F.struct("template", "first", "last"))).alias("spans"))
    listed = listed.select(F.col("id").alias("fid"), F.col("x").alias("fx"), "spans")
    likely = maybe_member(rows, F.col("x"), spans.select(F.col("x").alias("sx")), F.col("sx"))
    same = (F.col("x") == F.col("fx")) & F.col("id").eqNullSafe(F.col("fid"))
    full = likely.join(listed, same).select("id", "x", "text", "spans").dropDuplicates(["id", "x"])
    found = arrow_map(full, verify, f"id {id_type}, x long, {FOUND}").withColumnRenamed("id", "fid").withColumnRenamed("x", "fx")
    out = facts.join(found, same, "left")
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                      none("base_labels", ""), none("labels", ""), none("score", 0.0), "spans")
