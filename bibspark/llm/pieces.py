"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into *units*: a run of word marks and what follows up to the next mark; no piece of the vocabulary has a mark
behind another character (``read_model`` checks it), so tokens never cross units.  Each distinct unit is spread into its
substrings of bounded length, these are joined to the piece table, and the matches are gathered as the unit's edges.  A
Spark higher-order fold turns edges into tokens: for a unigram model Viterbi over the scores; for a byte-pair model, whose ids
are defined by merges and not by the best sum of scores, the same edges are merged best first, leftmost on ties.
Characters without a piece become byte pieces.  Decoding joins ids back to pieces and puts them together by place.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MARK = "▁"


@dataclass(frozen=True)
class PieceModel:
    """Normal pieces with ids and scores, and the id of byte 0 (or -1)."""

    pieces: list[tuple[str, int, float]]
    first_byte: int
    unknown: int
    longest: int
    kind: str


def read_model(path: str, kind: str = "bpe") -> PieceModel:
    """Read a public model file on the driver; ``kind`` is how its ids are defined, ``bpe`` or ``unigram``."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in ids]
    if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
        raise ValueError("a piece has a word mark behind another character: units would not be independent")
    first = next((i for i in range(sp.get_piece_size()) if sp.is_byte(i)), -1)
    return PieceModel(pieces, first, sp.unk_id(), max(len(p) for p, _, _ in pieces), kind)


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """``(piece, id, score)``: as many rows as the vocabulary, a fixed number."""
    return spark.createDataFrame(model.pieces, "piece string, id int, score double")


def units_of(text: Column) -> Column:
    """Units of a text; an empty or null one has none."""
    escaped = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.regexp_extract_all(escaped, F.lit(f"({MARK}+[^{MARK}]*)"), F.lit(1))).otherwise(F.array().cast("array<string>"))


# --- encoding ------------------------------------------------------------------------------

def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``(unit, edges)`` of distinct units; an edge is ``(s, e, id, score)`` for the substring from s to e.

    The rows of a unit stay where they are: the piece table is broadcast (a vocabulary of fixed size), so grouping its edges
    needs no shuffle of its own.
    """
    n = F.length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    subs = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("len"))
    subs = subs.select("unit", "s", (F.col("s") + F.col("len")).alias("e"), F.substring("unit", F.col("s") + 1, F.col("len")).alias("piece"))
    edges = subs.join(F.broadcast(pieces), "piece")
    return edges.groupBy("unit").agg(F.collect_list(F.struct("s", "e", "id", "score")).alias("edges"))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge_fold(n: Column, edges: Column, finish) -> Column:
    """Merges, best first: the edge of the best score that joins two neighbouring tokens, until there is none.

    The state is the array of token bounds; ``finish`` gets the last one.
    """
    def step(bounds: Column, _: Column) -> Column:
        joins = F.filter(edges, lambda e: (e["e"] - e["s"] > 1) & (F.array_position(bounds, e["s"]) > 0)
                         & (F.element_at(F.concat(bounds, F.array(F.lit(-1), F.lit(-1))), F.array_position(bounds, e["s"]).cast("int") + 2) == e["e"]))
        best = F.array_min(F.transform(joins, lambda e: F.struct((-e["score"]).alias("cost"), e["s"].alias("s"), e["e"].alias("e"))))
        return bind(best, lambda b: F.when(b.isNull(), bounds).otherwise(F.filter(bounds, lambda x: (x <= b["s"]) | (x >= b["e"]))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), step, finish)


def viterbi_fold(n: Column, edges: Column, unknown_cost: float, finish) -> Column:
    """Viterbi: the largest sum of scores; a character without a piece costs ``unknown_cost``.

    The state has the best sum and its token bounds for each place up to the present one.
    """
    start = F.array(F.struct(F.lit(0.0).alias("sum"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, at: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda e: e["e"] == at), lambda e: bind(F.element_at(best, e["s"] + 1), lambda b: F.struct(
            (b["sum"] + e["score"]).alias("sum"), F.concat(b["path"], F.array(at)).alias("path"))))
        skip = bind(F.element_at(best, at), lambda b: F.struct((b["sum"] - unknown_cost).alias("sum"), F.concat(b["path"], F.array(at)).alias("path")))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(skip)))))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: bind(F.element_at(best, -1)["path"], finish))


def token_ids(unit: Column, bounds: Column, edges: Column, model: PieceModel) -> Column:
    """Ids between the bounds: pieces, else the bytes of the character, else the unknown id."""
    def ids(i: Column) -> Column:
        s, e = F.element_at(bounds, i), F.element_at(bounds, i + 1)
        piece = F.transform(F.filter(edges, lambda x: (x["s"] == s) & (x["e"] == e)), lambda x: x["id"])
        if model.first_byte < 0:
            return bind(piece, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.lit(model.unknown))))
        code = F.hex(F.encode(F.substring(unit, s + 1, e - s), "UTF-8"))
        raw = bind(code, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1, F.lit(2)),
                                               lambda k: F.conv(F.substring(c, k, F.lit(2)), 16, 10).cast("int") + model.first_byte))
        return bind(piece, lambda p: F.when(F.size(p) > 0, p).otherwise(raw))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), ids))


def encode_units(units: DataFrame, model: PieceModel) -> DataFrame:
    """``(unit, ids)`` for a table of distinct units."""
    edges = lattice(units, piece_table(units.sparkSession, model), model.longest)
    whole = units.join(edges, "unit", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<s:int,e:int,id:int,score:double>>")))
    n, edges = F.length("unit"), F.col("edges")
    finish = lambda bounds: token_ids(F.col("unit"), bounds, edges, model)
    if model.kind == "bpe":
        ids = merge_fold(n, edges, finish)
    else:
        ids = viterbi_fold(n, edges, 10.0 - min(s for _, _, s in model.pieces), finish)
    return whole.select("unit", ids.alias("ids"))


def encode(rows: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """``rows`` with a column ``ids`` (array of int) of the tokens of each whole text.

    Null and empty texts have no tokens.  Repeated rows are encoded alike.  Other columns stay; ``rows`` must have no
    column ``ids``.  An empty table gives an empty result.
    """
    keyed = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    placed = keyed.select("_row", F.posexplode(units_of(F.col(text_col))).alias("_at", "unit"))
    # a unit's partial counts meet before the shuffle, so frequent units are not hot here
    coded = materialize(encode_units(placed.groupBy("unit").agg(F.lit(1).alias("one")).select("unit"), model), "units")
    found = placed.join(coded, "unit")
    lists = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "ids"))).alias("p"))  # as long as the text
    out = keyed.join(lists, "_row", "left")
    return out.withColumn("ids", F.coalesce(F.flatten(F.transform("p", lambda x: x["ids"])), F.array().cast("array<int>"))).drop("_row", "p")


# --- decoding ------------------------------------------------------------------------------

def decode(rows: DataFrame, model: PieceModel, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the text of each id list; an empty or null list gives an empty text."""
    spark = rows.sparkSession
    keyed = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    table = piece_table(spark, model).select("id", F.encode(F.replace("piece", F.lit(MARK), F.lit(" ")), "UTF-8").alias("b"))
    if model.first_byte >= 0:
        raw = spark.range(256).select((F.col("id") + model.first_byte).cast("int").alias("id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("b"))
        table = table.unionByName(raw)
    parts = keyed.select("_row", F.posexplode(ids_col).alias("_at", "id")).join(F.broadcast(table), "id")  # vocabulary of fixed size
    texts = parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "b"))).alias("p"))
    joined = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["b"])), "")), "UTF-8")
    out = keyed.join(texts.select("_row", F.substring(joined, F.lit(2), F.length(joined)).alias("decoded")), "_row", "left")
    return out.withColumn("decoded", F.coalesce("decoded", F.lit(""))).drop("_row")
