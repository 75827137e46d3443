"""Relevance search for a whole table of queries in one plan.

``search`` turns one query into column expressions and reads all rows.  Here an inverted index ``(t, row_ord, fields)`` meets the
words of all queries in one join; what a score needs beyond shared words comes from further equi-joins (equal titles, keys and DOIs,
contained phrases, words inside DOIs, years).  Everything is reduced to counts and flags per (query, row) by aggregation, so no text
is shuffled for the scoring, and the score is the same sum of the same parts as in ``search``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import names as N
from ..functions import text as T
from ..session import materialize
from .joins import split_lookup
from .search import relevance_order, round2
from .similarity import contained_pairs, within_words

W = K.WEIGHTS
#: bits of a posting: where a word occurs in a row
TITLE, AUTHOR, VENUE, FILENAME, ABSTRACT, SURNAME, FIRST_SURNAME, YEAR, ABBREVIATION, TITLE_NORM = (1 << i for i in range(10))
COVERING = TITLE | AUTHOR | VENUE | FILENAME | SURNAME | YEAR
#: bits of the other evidence
EXACT, INSIDE, PART, PAPER_ID, BIBTEX_KEY, DOI, DOI_WORD, ABSTRACT_PHRASE = (1 << i for i in range(8))
COUNTS = [f"c_{x}" for x in "title author venue filename abstract covered overlap any_author first_author abbreviation phrases late_phrases".split()]


def postings(index: DataFrame) -> DataFrame:
    """The inverted index ``(t, row_ord, fields)`` of a search index: one row per word and row.  Write it next to the index."""
    surnames = N.all_author_surnames("authors")
    one = lambda c: F.filter(F.array(c), lambda t: t != "")
    fields = [("title_tokens", TITLE), ("author_tokens", AUTHOR), ("venue_tokens", VENUE), ("filename_tokens", FILENAME), ("abstract_tokens", ABSTRACT),
              (surnames, SURNAME), (F.slice(surnames, 1, 1), FIRST_SURNAME), (one(T.strip("year")), YEAR), (one(T.compact("filename_abbreviation")), ABBREVIATION),
              (T.informative_tokens("title_norm"), TITLE_NORM)]
    marked = lambda c, bit: F.transform(c, lambda t: F.struct(t.alias("t"), F.lit(bit).alias("f")))
    listed = F.concat(*[marked(c, bit) for c, bit in fields])
    return index.select("row_ord", F.inline(listed)).groupBy("t", "row_ord").agg(F.bit_or("f").alias("fields"))


def parsed_queries(queries: DataFrame) -> DataFrame:
    """Everything of ``(query_id, query)`` that a score looks at; blank queries are left out."""
    text = T.blank("query")
    years = F.filter(F.transform(F.filter("tokens", lambda t: F.regexp(t, F.lit("^[0-9]{4}$"))), lambda t: t.cast("int")), lambda y: (y >= 1800) & (y <= 2100))
    return queries.filter(T.strip(text) != "").select(
        "query_id", T.normalize_title(text).alias("qn"), T.compact(text).alias("compact"), T.normalize_doi(text).alias("qd"),
        T.informative_tokens(text).alias("tokens"), T.informative_tokens(T.normalize_title(text)).alias("norm_tokens"),
        F.filter(T.quoted_phrases(text), lambda p: p != "").alias("phrases")).withColumn("years", years)


def _numbered(texts: DataFrame) -> DataFrame:
    return materialize(texts.filter("s <> ''").distinct().withColumn("id", F.monotonically_increasing_id()), "texts")


def _contained(smalls: DataFrame, bigs: DataFrame) -> DataFrame:
    """``(small_s, big_s)``: every text of ``smalls(s)`` with every text of ``bigs(s)`` that holds it."""
    a, b = _numbered(smalls), _numbered(bigs)
    return (contained_pairs(a, b).join(a.select(F.col("id").alias("small"), F.col("s").alias("small_s")), "small")
            .join(b.select(F.col("id").alias("big"), F.col("s").alias("big_s")), "big").filter(F.contains("big_s", F.col("small_s"))).select("small_s", "big_s"))


def _evidence(df: DataFrame, flag: int = 0, **counts: Column) -> DataFrame:
    return df.select("query_id", "row_ord", F.lit(flag).alias("flags"), *[counts.get(c.removeprefix("c_"), F.lit(0)).cast("int").alias(c) for c in COUNTS])


def _shared_words(words: DataFrame, q: DataFrame, include_abstract: bool) -> DataFrame:
    asked = q.select("query_id", F.explode(F.array_union("tokens", "norm_tokens")).alias("t"), "tokens", "norm_tokens").select(
        "query_id", "t", F.array_contains("tokens", F.col("t")).alias("own"), F.array_contains("norm_tokens", F.col("t")).alias("norm"))
    covering = COVERING | (ABSTRACT if include_abstract else 0)
    met = split_lookup(words, asked, "t", "inner")
    on = lambda bits, which="own": (F.col("fields").bitwiseAND(bits) != 0) & F.col(which)
    found = _evidence(met.filter(on(covering | ABBREVIATION | FIRST_SURNAME) | on(TITLE_NORM, "norm")), title=on(TITLE), author=on(AUTHOR), venue=on(VENUE),
                      filename=on(FILENAME), abstract=on(ABSTRACT) if include_abstract else F.lit(0), covered=on(covering), overlap=on(TITLE_NORM, "norm"),
                      any_author=on(SURNAME), first_author=on(FIRST_SURNAME), abbreviation=on(ABBREVIATION))
    return found.groupBy("query_id", "row_ord").agg(F.max("flags").alias("flags"), *[F.sum(c).cast("int").alias(c) for c in COUNTS])


def _equal(index: DataFrame, q: DataFrame) -> list[DataFrame]:
    norm = q.filter("qn <> ''")
    pair = lambda rows, key, asked, by, flag: _evidence(
        rows.select("row_ord", key.alias("k")).filter("k <> ''").join(asked.select("query_id", F.col(by).alias("k")), "k"), flag)
    return [pair(index, F.col("title_norm"), norm, "qn", EXACT), pair(index, F.col("paper_id_norm"), norm, "compact", PAPER_ID),
            pair(index, F.col("bibtex_key_norm"), norm, "compact", BIBTEX_KEY), pair(index, T.normalize_doi("doi"), q.filter("qd <> ''"), "qd", DOI)]


def _contained_texts(index: DataFrame, q: DataFrame, include_abstract: bool) -> list[DataFrame]:
    asked = materialize(
        q.select("query_id", F.lit(-1).alias("no"), F.col("qn").alias("small_s")).filter("small_s <> ''")
        .unionAll(q.select("query_id", F.posexplode("phrases").alias("no", "small_s"))), "asked-phrases")
    column = lambda c, kind: index.select("row_ord", F.col(c).alias("big_s"), F.lit(kind).alias("title")).filter("big_s <> ''")
    held = column("title_norm", True)
    held = materialize(held.unionAll(column("abstract_norm", False)) if include_abstract else held, "held-texts")
    inside = _contained(asked.select(F.col("small_s").alias("s")), held.select(F.col("big_s").alias("s")))
    hits = materialize(asked.join(inside, "small_s").join(held, "big_s").groupBy("query_id", "row_ord", "no").agg(
        F.bool_or("title").alias("in_title"), F.bool_or(~F.col("title")).alias("in_abstract")), "phrase-hits")
    whole, phrases = hits.filter("no < 0"), hits.filter("no >= 0").groupBy("query_id", "row_ord").agg(
        F.count_if("in_title").alias("a"), F.count_if(~F.col("in_title") & F.col("in_abstract")).alias("b"))
    part = _contained(index.select(F.col("title_norm").alias("s")), q.select(F.col("qn").alias("s")))
    parts = q.select("query_id", F.col("qn").alias("big_s")).join(part, "big_s").join(index.select("row_ord", F.col("title_norm").alias("small_s")), "small_s")
    return [_evidence(whole.filter("in_title"), INSIDE), _evidence(whole.filter("in_abstract"), ABSTRACT_PHRASE), _evidence(parts, PART),
            _evidence(phrases, phrases=F.col("a"), late_phrases=F.col("b"))]


def _doi_words(index: DataFrame, q: DataFrame) -> DataFrame:
    own = q.select("query_id", F.explode(F.filter("tokens", lambda t: (F.length(t) >= 4) & ~F.regexp(t, F.lit("^[0-9]+$")))).alias("u"))
    dois = index.select("row_ord", F.lower("doi").alias("w")).filter("w <> ''")
    return _evidence(own.join(within_words(own, dois), "u").join(dois, "w").select("query_id", "row_ord").distinct(), DOI_WORD)


def _years(index: DataFrame, q: DataFrame, limit: int) -> DataFrame:
    """Rows that may win by their year alone: of each year the first ``limit`` by title.

    Rows of one year score at least as high for the year and come in this order, so no other row without further evidence can be
    among the best.
    """
    by_year = Window.partitionBy("y").orderBy(T.casefold("title"), "row_ord")
    first = index.select("row_ord", "title", N.year_int("year").alias("y")).filter("y is not null").withColumn("n", F.row_number().over(by_year)).filter(F.col("n") <= limit)
    reach = int(-(-W["year"] // W["year_step"])) - 1
    near = q.select("query_id", F.explode("years").alias("asked")).select(
        "query_id", F.explode(F.sequence(F.col("asked") - reach, F.col("asked") + reach)).alias("y")).distinct()
    return _evidence(near.join(first.select("row_ord", "y"), "y"))


def _score(include_abstract: bool) -> Column:
    """The parts of ``search.score_parts`` in their order, from counts and flags."""
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    flag = lambda cond, w: F.when(cond, w).otherwise(0.0)
    c = {x.removeprefix("c_"): F.col(x).cast("double") for x in COUNTS}
    n = F.greatest(F.size("tokens"), F.lit(1))
    union = F.size("norm_tokens") + F.col("n_title") - c["overlap"]
    blend = F.when((F.size("norm_tokens") == 0) | (F.col("n_title") == 0), 0.0).otherwise(F.least(
        F.lit(1.0), c["overlap"] / F.size("norm_tokens") * 0.65 + c["overlap"] / union * 0.35))
    similar = F.when((F.col("qn") == "") | ~F.col("titled") | has(INSIDE), 0.0).when(has(PART), 0.92).otherwise(blend)
    gap = F.array_min(F.transform("years", lambda y: F.abs(F.col("y") - y)))
    boost = F.greatest(F.lit(0.0), F.lit(W["year"]) - gap * W["year_step"])
    zero = F.lit(0.0)
    parts = [
        flag(has(EXACT), W["title_exact"]), flag(has(INSIDE) & ~has(EXACT), W["title_phrase"]),
        F.when(similar >= K.TITLE_SIMILARITY_MIN, round2(similar * W["title_similarity"])).otherwise(0.0),
        flag(has(PAPER_ID), W["paper_id"]), flag(has(BIBTEX_KEY), W["bibtex_key"]), flag(has(DOI), W["doi_exact"]),
        round2(c["title"] * W["title_token"] + c["title"] / n * W["title_coverage"]), flag(has(DOI_WORD), W["doi_token_match"]),
        round2(c["author"] * W["author_token"]), flag(c["any_author"] > 0, W["any_author_match"]), flag(c["first_author"] > 0, W["first_author_match"]),
        F.when(gap == 0, boost).otherwise(0.0), F.when(gap > 0, boost).otherwise(0.0),
        round2(c["venue"] * W["venue_token"]), flag(c["abbreviation"] > 0, W["venue_abbreviation_match"]), round2(c["filename"] * W["filename_token"]),
        *([round2(c["abstract"] * W["abstract_token"]), flag(has(ABSTRACT_PHRASE), W["abstract_phrase"])] if include_abstract else []),
        c["phrases"] * W["title_phrase_match"], c["late_phrases"] * W["abstract_phrase_match"] if include_abstract else zero,
        F.when(F.size("tokens") > 0, round2(c["covered"] / n * W["query_coverage"])).otherwise(0.0)]
    return round2(reduce(lambda a, b: a + F.coalesce(b, zero), parts, zero))


def search_table(index: DataFrame, queries: DataFrame, limit: int = 10, no_abstract: bool = False, words: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` rows of ``index`` for every ``queries(query_id, query)``: ``(query_id, row_ord, paper_id, title, year, score, rank)``.

    Scores and order are those of ``search``.  ``words`` is the written result of ``postings`` for this index.  Query ids are unique and
    ``row_ord`` is; blank and null queries give no rows.  A word that a third of all rows share is spread over many tasks.
    """
    q = materialize(parsed_queries(queries), "parsed-queries")
    words = postings(index) if words is None else words
    parts = [_shared_words(words, q, not no_abstract), *_equal(index, q), *_contained_texts(index, q, not no_abstract), _doi_words(index, q), _years(index, q, limit)]
    pairs = reduce(DataFrame.unionByName, parts).groupBy("query_id", "row_ord").agg(F.bit_or("flags").alias("flags"), *[F.sum(c).alias(c) for c in COUNTS])
    rows = index.select("row_ord", "paper_id", "title", "year", N.year_int("year").alias("y"), F.size(T.informative_tokens("title_norm")).alias("n_title"),
                        (F.col("title_norm") != "").alias("titled"))
    asked = q.select("query_id", "qn", "tokens", "norm_tokens", "years")
    scored = pairs.join(rows, "row_ord").join(asked, "query_id").withColumn("score", _score(not no_abstract)).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*relevance_order()))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "row_ord", "paper_id", "title", "year", "score", "rank")
