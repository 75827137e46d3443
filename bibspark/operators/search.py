"""Filters, explainable relevance scoring, top-k and full-text search."""
from __future__ import annotations

import re
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import names as N
from ..functions import text as T
from ..plans.spec import QueryText, parse_year_range
from .joins import split_lookup

W = K.WEIGHTS


@dataclass(frozen=True)
class Filters:
    author: str = ""
    year: str = ""
    venue: str = ""
    doi: str = ""
    has_pdf: bool = False
    reference_only: bool = False
    exclude_ids: tuple[str, ...] = field(default_factory=tuple)


def apply_filters(index: DataFrame, f: Filters) -> DataFrame:
    """Row filters; all are plain predicates, so they reach the Parquet scan where it can use them."""
    if f.has_pdf and f.reference_only:
        raise ValueError("has_pdf and reference_only exclude each other")
    out = index
    if author := QueryText(f.author).norm:
        out = out.filter(F.contains("authors_norm", F.lit(author)))
    if venue := QueryText(f.venue).norm:
        out = out.filter(F.contains("venue_norm", F.lit(venue)))
    if f.doi.strip():
        out = out.filter(T.normalize_doi("doi") == T.normalize_doi(F.lit(f.doi)))
    span = parse_year_range(f.year)
    if span:
        low, high = span
        year = N.year_int("year")
        if low is not None:
            out = out.filter(year >= low)
        if high is not None:
            out = out.filter(year <= high)
    if f.has_pdf:
        out = out.filter(F.col("content_kind") == K.PDF_BACKED)
    if f.reference_only:
        out = out.filter(F.col("content_kind") == K.REFERENCE_ONLY)
    if f.exclude_ids:
        out = out.filter(~F.col("paper_id").isin(*f.exclude_ids))
    return out


def round2(c: Column) -> Column:
    """Two decimals, ties on the binary value to even."""
    return F.rint(c * 100) / 100


def _count(flags: list[Column]) -> Column:
    return sum((f.cast("double") for f in flags), F.lit(0.0))


def _with_pieces(index: DataFrame) -> DataFrame:
    """The index with what several score parts or queries read, computed once a row."""
    pieces = {"_surnames": N.all_author_surnames("authors"), "_title_words": T.informative_tokens("title_norm"), "_doi": T.normalize_doi("doi"),
              "_doi_lower": F.lower("doi"), "_year": N.year_int("year"), "_year_text": T.strip("year"), "_abbreviation": T.compact("filename_abbreviation")}
    return index.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in pieces.items()]))).alias("_p")).select("*", "_p.*").drop("_p")


def score_parts(q: QueryText, include_abstract: bool = True) -> dict[str, Column]:
    """Named score parts of one query as columns over the search index ``_with_pieces``; 0 when a part does not apply."""
    qn, toks = F.lit(q.norm), q.tokens
    n = max(len(toks), 1)
    has = lambda column: [F.array_contains(column, t) for t in toks]
    zero = F.lit(0.0)
    flag = lambda cond, w: F.when(cond, w).otherwise(0.0)
    title = F.col("title_norm")
    parts: dict[str, Column] = {}

    if q.norm:
        filled = title != ""
        inside = F.contains(title, qn)
        similar = T.similarity_from_parts(
            qn, title, F.array(*[F.lit(t) for t in q.norm_tokens]).cast("array<string>"), F.col("_title_words"))
        parts["title_exact"] = flag(filled & (title == qn), W["title_exact"])
        parts["title_phrase"] = flag(filled & (title != qn) & inside, W["title_phrase"])
        parts["title_similarity"] = F.when(
            filled & ~inside & (similar >= K.TITLE_SIMILARITY_MIN), round2(similar * W["title_similarity"])
        ).otherwise(0.0)
        parts["paper_id"] = flag(F.col("paper_id_norm") == q.compact, W["paper_id"])
        parts["bibtex_key"] = flag(F.col("bibtex_key_norm") == q.compact, W["bibtex_key"])
    if q.text.strip():
        qd = T.normalize_doi(F.lit(q.text))
        parts["doi_exact"] = flag((qd != "") & (F.col("_doi") == qd), W["doi_exact"])

    hits = _count(has("title_tokens"))
    parts["title_tokens"] = round2(hits * W["title_token"] + hits / n * W["title_coverage"])
    doi_words = [t for t in toks if len(t) >= 4 and not t.isdigit()]
    doi_hits = [F.contains("_doi_lower", F.lit(t)) for t in doi_words]
    parts["doi_token_match"] = flag(_count(doi_hits) > 0, W["doi_token_match"]) if doi_hits else zero
    parts["author_tokens"] = round2(_count(has("author_tokens")) * W["author_token"])
    surnames = F.col("_surnames")
    lit_tokens = F.array(*[F.lit(t) for t in toks]).cast("array<string>")
    parts["any_author_match"] = flag(F.arrays_overlap(surnames, lit_tokens), W["any_author_match"])
    parts["first_author_match"] = flag(
        F.array_contains(lit_tokens, F.coalesce(F.try_element_at(surnames, F.lit(1)), F.lit(""))), W["first_author_match"])

    if q.years:
        gaps = [F.abs(F.col("_year") - y) for y in q.years]
        gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        boost = F.greatest(zero, F.lit(W["year"]) - gap * W["year_step"])
        parts["year_match"] = F.when(gap == 0, boost).otherwise(0.0)
        parts["year_proximity_match"] = F.when(gap > 0, boost).otherwise(0.0)
    parts["venue_tokens"] = round2(_count(has("venue_tokens")) * W["venue_token"])
    abbreviation = F.col("_abbreviation")
    parts["venue_abbreviation_match"] = flag(F.array_contains(lit_tokens, abbreviation), W["venue_abbreviation_match"])
    parts["filename_tokens"] = round2(_count(has("filename_tokens")) * W["filename_token"])
    if include_abstract:
        parts["abstract_tokens"] = round2(_count(has("abstract_tokens")) * W["abstract_token"])
        if q.norm:
            parts["abstract_phrase"] = flag(F.contains("abstract_norm", qn), W["abstract_phrase"])
    if q.phrases:
        in_title = [F.contains(title, F.lit(p)) for p in q.phrases]
        parts["title_phrase_match"] = _count(in_title) * W["title_phrase_match"]
        if include_abstract:
            only_abstract = [~t & F.contains("abstract_norm", F.lit(p)) for t, p in zip(in_title, q.phrases)]
            parts["abstract_phrase_match"] = _count(only_abstract) * W["abstract_phrase_match"]

    token_columns = ["title_tokens", "author_tokens", "venue_tokens", "filename_tokens"]
    token_columns += ["abstract_tokens"] if include_abstract else []
    covered = []
    for t in toks:
        found = (F.col("_year_text") == t) | F.array_contains(surnames, t)
        for c in token_columns:
            found = found | F.array_contains(c, t)
        covered.append(found)
    parts["query_coverage"] = round2(_count(covered) / n * W["query_coverage"]) if toks else zero
    return parts


def with_score(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Add ``score_breakdown`` (non-zero parts only) and their sum ``score``."""
    named = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.coalesce(v, F.lit(0.0)))])
    total = F.aggregate(F.map_values("score_breakdown"), F.lit(0.0), lambda a, v: a + v)
    # one breakdown per row, exploded: the parts are computed once, not once more for a filter on the score
    return df.select("*", F.explode(F.array(F.map_filter(named, lambda _, v: v > 0))).alias("score_breakdown")).withColumn("score", round2(total))


def explanation(breakdown: str = "score_breakdown", top: int = 3) -> Column:
    """The ``top`` largest parts as ``name=value``; ties by name."""
    ranked = F.array_sort(F.transform(F.map_entries(breakdown), lambda e: F.struct(
        (-e["value"]).alias("neg"), e["key"].alias("name"))))
    # %g style: six significant digits, no trailing zeros
    shown = lambda v: F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
    labels = F.transform(F.slice(ranked, 1, top), lambda e: F.concat(e["name"], F.lit("="), shown(-e["neg"])))
    return F.when(F.size(breakdown) == 0, "filters only").otherwise(F.array_join(labels, ", "))


def relevance_order() -> list[Column]:
    """Buckets of five points, then newer first, then title; row order breaks the last ties."""
    return [F.floor(F.col("score") / 5).desc(), F.coalesce(N.year_int("year"), F.lit(0)).desc(),
            T.casefold("title").asc(), F.col("row_ord").asc()]


def fulltext_document(texts: DataFrame, q: QueryText) -> DataFrame:
    """Whole-document matches: phrase, distinct tokens, and a snippet cut from the raw text.

    One regular expression finds all query tokens in a single pass over each text.
    """
    any_token = F.lit("(?i)(?<![A-Za-z0-9])(?:" + "|".join(q.tokens) + ")(?![A-Za-z0-9])") if q.tokens else None
    hits = (F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", any_token, F.lit(0)), F.lower)))
            if q.tokens else F.array().cast("array<string>"))
    # the phrase in the raw text: its words with any run of other characters between them; texts with
    # letters that fold to several characters are compared in normalised form
    loose = "(?i)" + "[^A-Za-z0-9]+".join(q.norm.split(" "))
    if q.norm:
        normalized = F.regexp_replace(T.casefold_text("text"), "[^a-z0-9]+", " ")
        phrase = F.col("text").rlike(loose) | (F.col("text").rlike(T.FOLDING_LETTERS) & F.contains(normalized, F.lit(q.norm)))
    else:
        phrase = F.lit(False)

    def finish(x: Column) -> Column:
        at = F.greatest(F.regexp_instr("text", F.lit(loose)) - 81, F.lit(0))
        snippet = F.when(x["phrase"], T.squeeze(F.substring(F.col("text"), at + 1, F.lit(220)))).otherwise("")
        score = F.when(x["phrase"], W["fulltext_phrase"]).otherwise(0.0) + F.size(x["hits"]) * W["fulltext_token"]
        return F.struct(score.alias("fulltext_score"), x["hits"].alias("token_hits"), snippet.alias("snippet"))

    # zero or one match per text, exploded: the texts are searched once, not once more for a filter
    match = F.transform(F.array(F.struct(hits.alias("hits"), phrase.alias("phrase"))), finish)
    return texts.select("paper_id", F.explode(F.filter(match, lambda m: m["fulltext_score"] > 0)).alias("m")).select(
        "paper_id", "m.*")


def fulltext_lines(texts: DataFrame, q: QueryText, lines_per_text: int = 2, max_patterns: int | None = None) -> DataFrame:
    """Line matches: the first matching lines of each text, scored per line and summed.

    The limit of lines is the feature; it is applied inside the row.  All query words are used unless ``max_patterns``
    names how many.
    """
    patterns = sorted(q.tokens)[:max_patterns] or [re.escape(q.text)]
    line_rx = F.lit("(?i)" + "|".join(patterns))
    matching = F.slice(F.filter(F.split("text", "\n"), lambda x: F.regexp(x, line_rx)), 1, lines_per_text)
    qt = F.array(*[F.lit(t) for t in q.tokens]).cast("array<string>")
    scored = F.transform(matching, lambda x: F.struct(
        T.squeeze(x).alias("line"),
        F.array_intersect(T.informative_tokens(T.squeeze(x)), qt).alias("hits"),
        F.contains(T.normalize_title(x), F.lit(q.norm)).alias("phrase") if q.norm else F.lit(False).alias("phrase")))
    total = F.aggregate("scored", F.lit(0.0), lambda a, s: a + F.size(s["hits"]) * W["fulltext_token"]
                        + F.when(s["phrase"], W["fulltext_phrase"]).otherwise(0.0))
    return (
        texts.withColumn("scored", scored).filter(F.size("scored") > 0)
        .select(
            "paper_id", total.alias("fulltext_score"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("scored", lambda s: s["hits"])))).alias("token_hits"),
            F.filter(F.transform("scored", lambda s: s["line"]), lambda x: x != "").alias("snippets"))
    )


def add_fulltext(scored: DataFrame, hits: DataFrame) -> DataFrame:
    """Add full-text scores to scored rows; rows without a hit keep their score."""
    ft = F.coalesce(F.col("fulltext_score"), F.lit(0.0))
    return (
        scored.join(hits.select("paper_id", "fulltext_score"), "paper_id", "left")
        .withColumn("score", round2(F.col("score") + ft))
        .withColumn("score_breakdown", F.when(ft > 0, F.map_concat(
            "score_breakdown", F.create_map(F.lit("fulltext"), ft))).otherwise(F.col("score_breakdown")))
        .drop("fulltext_score")
    )


def rank_rows(index: DataFrame, query: str, filters: Filters = Filters(), *, texts: DataFrame | None = None,
              scope: str = "auto", no_abstract: bool = False) -> DataFrame:
    """Filtered and scored rows, unsorted; with a query only rows that score above zero."""
    q = QueryText(query)
    scoped = apply_filters(index, filters)
    if not query:
        return with_score(scoped, {"none": F.lit(0.0)})
    scored = with_score(_with_pieces(scoped), score_parts(q, not no_abstract)).select(*index.columns, "score_breakdown", "score")
    if texts is not None and scope != "metadata":
        # ``auto`` reads the texts only when no row matched; the probe stops at the first match.
        if scope == "fulltext" or scored.filter("score > 0").isEmpty():
            scored = add_fulltext(scored, fulltext_document(texts, q))
    return scored.filter("score > 0")


RESULT_COLUMNS = ["paper_id", "bibtex_key", "title", "authors", "year", "venue", "doi", "content_kind",
                  "canonical_url", "filename", "pdf_path", "text_path", "chunk_path"]


def search(index: DataFrame, query: str, filters: Filters = Filters(), *, texts: DataFrame | None = None,
           scope: str = "auto", no_abstract: bool = False, limit: int = 10) -> DataFrame:
    """Top ``limit`` rows with score, breakdown and explanation."""
    rows = rank_rows(index, query, filters, texts=texts, scope=scope, no_abstract=no_abstract)
    top = rows.orderBy(*relevance_order()).limit(limit)
    rank = F.row_number().over(Window.orderBy(*relevance_order()))
    return top.select(*RESULT_COLUMNS, "row_ord", "score", "score_breakdown",
                      explanation().alias("match_explanation"), rank.alias("rank"))


def search_many(index: DataFrame, queries: list[str], limit: int = 10, no_abstract: bool = False) -> DataFrame:
    """Several queries in one pass over the index.

    The queries are a list held by the caller; longer ones are taken 64 at a time, which keeps the generated code small.
    Each row carries one score per query; the rank filter keeps ``limit`` rows per query and task before the shuffle.
    """
    if len(queries) > 64:
        groups = [search_many(index, queries[i:i + 64], limit, no_abstract).withColumn("query_id", F.col("query_id") + i)
                  for i in range(0, len(queries), 64)]
        return reduce(DataFrame.unionByName, groups)

    def total(text: str) -> Column:
        parts = score_parts(QueryText(text), not no_abstract)
        return round2(sum((F.coalesce(p, F.lit(0.0)) for p in parts.values()), F.lit(0.0)))

    per_query = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query"), total(q).alias("score"))
                          for i, q in enumerate(queries)])
    hits = (_with_pieces(index).select("paper_id", "title", "year", "row_ord", F.explode(per_query).alias("h"))
            .select("h.*", "paper_id", "title", "year", "row_ord").filter("score > 0"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*relevance_order()))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit)


def resolve_targets(ranked: DataFrame) -> DataFrame:
    """Is the best hit of each query unambiguous?

    ``ranked`` holds result lists (``query_id``, ``paper_id``, ``score``, ``rank``) that a search limited.
    A winner is named when it is the only hit or the only one within reach of its own score.
    """
    top = F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))
    near = F.col("score") >= F.greatest(F.lit(8.0), F.col("top") * 0.8)
    stats = ranked.withColumn("top", top).groupBy("query_id").agg(
        F.count("*").alias("hits"), F.max("top").alias("top_score"), F.count_if(near).alias("plausible"),
        F.min_by("paper_id", "rank").alias("first_id"))
    return stats.select("query_id", "hits", "top_score", "plausible", F.when(
        (F.col("hits") == 1) | (F.col("plausible") == 1), F.col("first_id")).otherwise("").alias("paper_id"))


def exact_identifier(index: DataFrame, identifier: str) -> DataFrame:
    """First row whose id, key or DOI equals the identifier in compact form."""
    token = QueryText(identifier).compact
    if not token:
        return index.limit(0)
    same = (F.col("paper_id_norm") == token) | (F.col("bibtex_key_norm") == token) | (T.compact("doi") == token)
    return index.filter(same).orderBy("row_ord").limit(1)


def lookup_identifiers(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Bulk form of :func:`exact_identifier`: ``ids(identifier)`` to the first matching row.

    Aggregates map-side per token before the join, so repeated identifiers cost nothing extra.
    """
    forms = F.array_distinct(F.array("paper_id_norm", "bibtex_key_norm", T.compact("doi")))
    by_token = (
        index.select("paper_id", "row_ord", F.explode(forms).alias("token")).filter("token <> ''")
        .groupBy("token").agg(F.min_by("paper_id", "row_ord").alias("paper_id"))
    )
    wanted = ids.select("identifier").distinct().withColumn("token", T.compact("identifier"))
    return wanted.join(by_token, "token", "left").select("identifier", T.blank("paper_id").alias("paper_id"))


def contains_all_tokens(index: DataFrame, text: str, *, exclude_id: str = "", skip_supplements: bool = False,
                        limit: int = 10) -> DataFrame:
    """Rows whose title, authors and key contain every word; the first ``limit`` in row order."""
    wanted = text.lower().split()
    if not wanted:
        return index.limit(0)
    hay = F.lower(F.concat_ws(" ", T.first_filled("title"), T.blank("authors"), T.blank("bibtex_key")))
    out = index
    for w in wanted:
        out = out.filter(F.contains(hay, F.lit(w)))
    if exclude_id:
        out = out.filter(F.col("paper_id") != exclude_id)
    if skip_supplements:
        out = out.filter(F.col("match_status") != "matched_supplement")
    return out.orderBy("row_ord").limit(limit)


def in_folder(registry: DataFrame, folder: str | None) -> DataFrame:
    """Main listing of one folder; ``None`` is all, ``""`` the root.  Supplements are left out."""
    main = registry.filter(F.col("match_status") != "matched_supplement")
    if folder is None:
        return main
    parts = F.split("pdf_path", "/")
    middle = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    where = (F.size(parts) == 2) if folder == "" else (middle == folder)
    return main.filter((F.col("pdf_path") != "") & where)


def sort_listing(df: DataFrame, field_name: str, ascending: bool = True) -> DataFrame:
    """Sort by any column: numbers for ``year`` and ``relevance``, case-insensitive text otherwise."""
    if field_name == "relevance":
        key = F.coalesce(F.col("score"), F.lit(0.0))
    elif field_name == "year":
        key = F.coalesce(F.regexp_extract("year", r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    else:
        key = F.lower(T.blank("content_kind" if field_name == "type" else field_name))
    return df.orderBy(key.asc() if ascending else key.desc(), F.col("row_ord").asc())


def supplements_of(registry: DataFrame) -> DataFrame:
    """Pairs of a paper and its supplements (same key, supplement status, other id)."""
    child = registry.filter((F.col("match_status") == "matched_supplement") & (F.col("bibtex_key") != "")).select(
        F.col("paper_id").alias("supplement_id"), "bibtex_key")
    parent = registry.filter(F.col("bibtex_key") != "").select("paper_id", "bibtex_key")
    return parent.join(child, "bibtex_key").filter("paper_id <> supplement_id")


def supplement_groups(registry: DataFrame) -> DataFrame:
    """``(bibtex_key, paper_id, is_supplement, n_papers, n_supplements)``: one row per row of every key that has a supplement.

    The class of a key with its counts and its members; the pairs of ``supplements_of`` are each supplement with the other members.
    """
    rows = registry.filter("bibtex_key <> ''").select("bibtex_key", "paper_id", (F.col("match_status") == "matched_supplement").alias("is_supplement"))
    classes = rows.groupBy("bibtex_key").agg(F.count_if(~F.col("is_supplement")).alias("n_papers"), F.count_if("is_supplement").alias("n_supplements")).filter("n_supplements > 0")
    return split_lookup(rows, classes, "bibtex_key", "inner").select("bibtex_key", "paper_id", "is_supplement", "n_papers", "n_supplements")


def record_detail(ids: DataFrame, registry: DataFrame, records: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry row, record and bibliography entry of each ``ids(paper_id)``; equi-joins, so any number of ids."""
    entry = entries.groupBy("bibtex_key").agg(F.max_by("raw", "ord").alias("raw_bibtex"))
    rows = registry.join(ids.select("paper_id"), "paper_id", "left_semi")
    record = records.select("paper_id", F.struct(*records.columns).alias("record"))
    return rows.join(record, "paper_id", "left").join(entry, "bibtex_key", "left")
