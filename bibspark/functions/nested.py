"""Accessors over nested works, candidates and records as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import text as T
from .arrow import html_unescape

ColumnLike = T.ColumnLike


def _filled(c: Column) -> Column:
    return F.nullif(T.blank(c), F.lit(""))


# --- works ------------------------------------------------------------------------

def work_fields(w: Column) -> dict[str, Column]:
    """Bibliographic fields of a works struct; missing values are empty strings."""
    first = lambda c: T.blank(F.try_element_at(w[c], F.lit(1)))
    year_from = lambda c: F.try_element_at(
        F.try_element_at(w[c]["date-parts"], F.lit(1)), F.lit(1))
    author = F.transform(w["author"], lambda a: T.strip(F.concat_ws(
        " ", F.nullif(T.strip(T.blank(a["given"])), F.lit("")), F.nullif(T.strip(T.blank(a["family"])), F.lit("")))))
    return {
        "title": first("title"),
        "authors": T.blank(F.array_join(F.filter(author, lambda a: a != ""), ", ")),
        "year": T.blank(F.coalesce(year_from("published-print"), year_from("published-online"),
                                   year_from("issued")).cast("string")),
        "venue": T.normalize_venue(first("container-title")),
        "doi": T.blank(w["DOI"]),
        "url": T.blank(w["URL"]),
        "abstract": T.strip_tags(w["abstract"]),
        "volume": T.strip(T.blank(w["volume"])),
        "number": T.strip(T.blank(w["issue"])),
        "pages": T.strip(T.blank(w["page"])),
        "publisher": T.strip(T.blank(w["publisher"])),
        "issn": T.strip(first("ISSN")),
    }


def report_fields(work: ColumnLike) -> Column:
    """The fields of a works map that reports keep."""
    return F.map_filter(T.col(work), lambda k, _: k.isin(K.REPORT_WORK_FIELDS))


# --- candidates -----------------------------------------------------------------------

def candidate_fields(c: Column) -> dict[str, Column]:
    """Candidate struct as normalised metadata."""
    ids = c["externalIds"]
    doi = F.coalesce(_filled(F.try_element_at(ids, F.lit("DOI"))), _filled(F.try_element_at(ids, F.lit("doi"))), F.lit(""))
    names = F.transform(c["authors"], lambda a: T.blank(a["name"]))
    return {
        "title": T.squeeze(T.blank(c["title"])),
        "authors": comma_list(T.blank(F.array_join(names, ", "))),
        "year": T.blank(c["year"].cast("string")),
        "venue": T.normalize_venue(F.coalesce(_filled(c["journal"]["name"]), T.blank(c["venue"]))),
        "doi": T.normalize_doi(doi),
        "url": T.strip(T.blank(c["url"])),
        "abstract": T.squeeze(T.blank(c["abstract"])),
        "semantic_scholar_paper_id": T.strip(T.blank(c["paperId"])),
    }


def comma_list(c: ColumnLike) -> Column:
    """Trim the parts of a comma list and drop empty ones."""
    parts = F.filter(F.transform(F.split(T.blank(c), ","), T.strip), lambda p: p != "")
    return F.array_join(parts, ", ")


def metadata_fields(title: ColumnLike, authors: ColumnLike, year: ColumnLike, venue: ColumnLike,
                    doi: ColumnLike, url: ColumnLike, abstract: ColumnLike) -> dict[str, Column]:
    """Common clean-up of a metadata record."""
    return {
        "title": T.squeeze(T.blank(title)),
        "authors": comma_list(authors),
        "year": T.strip(T.blank(year)),
        "venue": T.normalize_venue(venue),
        "doi": T.normalize_doi(doi),
        "url": T.strip(T.blank(url)),
        "abstract": T.squeeze(T.blank(abstract)),
    }


def merged_work_candidate(w: Column, c: Column) -> dict[str, Column]:
    """Works metadata enriched with a candidate's abstract, id and URL."""
    work, cand = work_fields(w), candidate_fields(c)
    return work | {
        "abstract": T.first_filled(work["abstract"], cand["abstract"]),
        "semantic_scholar_paper_id": cand["semantic_scholar_paper_id"],
        "url": T.first_filled(T.strip(work["url"]), cand["url"]),
    }


def canonical_url(manual_url: ColumnLike, work_url: ColumnLike, candidate_url: ColumnLike) -> Column:
    return T.strip(T.first_filled(manual_url, work_url, candidate_url))


# --- records ------------------------------------------------------------------------

def abstract_of(variant: str = "search") -> Column:
    """Abstract of a record: resolved, manual, candidate, works; first non-empty wins.

    ``search`` drops markup and hides supplements' abstracts; ``bib`` only squeezes blanks.
    """
    sources = [F.col("resolved_metadata.abstract"), F.col("manual_override.abstract"),
               F.col("semantic_scholar.best_candidate.abstract"), F.col("crossref.metadata.abstract")]
    if variant == "bib":
        return T.first_filled(*[T.squeeze(T.blank(s)) for s in sources])
    text = T.first_filled(*[T.strip_tags(html_unescape(T.blank(s))) for s in sources])
    hidden = (T.strip(T.blank("match_status")) == "matched_supplement") | F.col("supplement_parent").isNotNull()
    return F.when(hidden, "").otherwise(text)
