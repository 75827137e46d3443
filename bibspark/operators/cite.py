"""Citations in documents: numbering and rendering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from .index import join_journals
from .joins import rank_within, split_lookup


def cited_keys(citations: DataFrame, registry: DataFrame, bib_keys: DataFrame) -> DataFrame:
    """``(doc_id, pos, idx, bibtex_key)``: cited rows that have a bibliography entry; others are dropped."""
    known = registry.filter("paper_id <> '' and bibtex_key <> ''").groupBy("paper_id").agg(
        F.max_by("bibtex_key", "row_ord").alias("bibtex_key"))
    cited = citations.select("doc_id", "pos", F.posexplode("paper_ids").alias("idx", "paper_id"))
    return (
        split_lookup(cited, known.join(bib_keys.select("bibtex_key").distinct(), "bibtex_key", "left_semi"), "paper_id")
        .filter(F.col("bibtex_key").isNotNull()).select("doc_id", "pos", "idx", "bibtex_key"))


def number_citations(cited: DataFrame) -> DataFrame:
    """``(doc_id, bibtex_key, number)``: numbers by first appearance in each document."""
    first = cited.groupBy("doc_id", "bibtex_key").agg(F.min(F.struct("pos", "idx")).alias("first"))
    return rank_within(first, ["doc_id"], [F.col("first")], "number").select("doc_id", "bibtex_key", "number")


def collapse_runs(numbers: Column, collapse: bool = True) -> Column:
    """Sorted numbers as text; runs of three or more become ``a–b`` when ``collapse`` is set."""
    ns = F.array_sort(F.array_distinct(numbers))
    if not collapse:
        return F.array_join(F.transform(ns, lambda n: n.cast("string")), ",")
    has = lambda n: F.array_contains(ns, n)
    # a number inside a run is dropped; the end of a long run is joined with a dash
    piece = lambda n: (
        F.when(has(n - 1) & has(n + 1), F.lit(""))
        .when(has(n - 1) & has(n - 2), F.concat(F.lit("–"), n.cast("string")))
        .otherwise(F.concat(F.lit(","), n.cast("string"))))
    return F.regexp_replace(F.array_join(F.transform(ns, piece), ""), "^,", "")


def citation_texts(citations: DataFrame, cited: DataFrame, numbers: DataFrame, collapse: bool = True) -> DataFrame:
    """``(doc_id, pos, citation)`` for every citation; empty when nothing in it resolves.

    The numbers of one citation are as many as its ids, so the collected list is one source row's.
    """
    pair = lambda df: df.withColumn("dk", F.concat_ws("\u0001", "doc_id", "bibtex_key"))
    numbered = split_lookup(pair(cited), pair(numbers).select("dk", "number"), "dk")
    per_citation = numbered.groupBy("doc_id", "pos").agg(F.collect_set("number").alias("ns"))
    return citations.select("doc_id", "pos").join(per_citation, ["doc_id", "pos"], "left").select(
        "doc_id", "pos", T.blank(collapse_runs("ns", collapse)).alias("citation"))


def render_nar(entries: DataFrame, journals: DataFrame) -> DataFrame:
    """One citation string per entry in the author-initials, abbreviated-journal style."""
    f = lambda n: T.blank(F.try_element_at("fields", F.lit(n)))
    norm = lambda n: T.blank(F.col(f"normalized.{n}"))
    named = join_journals(
        entries.withColumn("journal_name", T.normalize_venue(T.first_filled(f("shortjournal"), f("journal"), norm("venue")))),
        journals, "journal_name")
    authors = F.array_join(F.filter(F.transform(
        N.split_bib_authors(T.first_filled(f("author"), norm("authors"))), N.author_with_initials),
        lambda a: a != ""), ", ")
    journal = T.squeeze(F.replace(T.first_filled("citation_abbreviation", f("shortjournal"), "journal_name"),
                                  F.lit("."), F.lit(" ")))
    title, doi = T.first_filled(norm("title"), f("title")), T.first_filled(norm("doi"), f("doi"))
    year, volume = T.first_filled(norm("year"), f("year")), f("volume")
    pages = N.compress_pages(T.first_filled(f("pages"), f("page")))
    filled = lambda c: F.nullif(c, F.lit(""))
    issue = F.concat_ws("; ", filled(year), filled(volume))
    serial = F.concat_ws(":", filled(issue), filled(pages))
    dotted = lambda c: F.when(c != "", F.concat(c, F.lit(".")))
    text = F.concat_ws(" ", dotted(authors), dotted(title), dotted(journal), dotted(serial),
                       F.when(doi != "", F.concat(F.lit("doi:"), doi)))
    return named.select("bibtex_key", T.strip(text).alias("citation"))
