"""Authors, years, page ranges, identifiers, keys and file names as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import text as T
from .arrow import ascii_fold

ColumnLike = T.ColumnLike


def _last_word(c: Column) -> Column:
    return F.coalesce(F.try_element_at(T.words(c), F.lit(-1)), F.lit(""))


def _before(c: Column, sep: str) -> Column:
    return T.strip(F.substring_index(c, sep, 1))


def _surname(author: Column) -> Column:
    """Surname of one author: text before a comma, else the last word."""
    return F.when(F.contains(author, F.lit(",")), _before(author, ",")).otherwise(_last_word(author))


def first_author_surname(authors: ColumnLike, squeeze_first: bool = False) -> Column:
    """Normalised surname of the first author.

    ``squeeze_first`` collapses blanks first and looks for a case-sensitive ``and``
    (the form used when comparing two metadata sources).
    """
    text = T.squeeze(T.blank(authors)) if squeeze_first else T.strip(T.blank(authors))
    probe = text if squeeze_first else F.lower(text)
    first_and = _before(text, " and ")
    first_comma = _before(text, ",")
    name = F.when(
        F.contains(probe, F.lit(" and ")),
        F.when(F.contains(first_and, F.lit(",")), _before(first_and, ",")).otherwise(_last_word(first_and)),
    ).otherwise(_last_word(first_comma))
    return T.normalize_title(name)


def all_author_surnames(authors: ColumnLike) -> Column:
    text = T.strip(T.blank(authors))
    parts = F.when(
        F.contains(F.lower(text), F.lit(" and ")), F.split(text, f"(?i)[{K.SPACE}]+and[{K.SPACE}]+")
    ).otherwise(F.split(text, ","))
    names = F.filter(F.transform(parts, lambda p: T.strip(p)), lambda p: p != "")
    return F.filter(F.transform(names, lambda a: T.normalize_title(_surname(a))), lambda s: s != "")


def filename_surname(authors: ColumnLike) -> Column:
    """Surname for file names; keeps one leading particle such as ``van``."""
    parts = T.words(_before(T.blank(authors), ","))
    n = F.size(parts)
    particle = F.coalesce(F.lower(F.try_element_at(parts, F.lit(-2))).isin(K.NAME_PARTICLES), F.lit(False))
    name = F.when((n >= 2) & particle, F.array_join(F.slice(parts, -2, 2), " ")).otherwise(
        F.try_element_at(parts, F.lit(-1)))
    return F.when(n == 0, "Unknown").otherwise(T.first_filled(safe_fragment(name), F.lit("Unknown")))


def split_bib_authors(authors: ColumnLike) -> Column:
    """Author list of a bibliography field: ``and`` separated, or comma separated full names."""
    text = T.squeeze(T.blank(authors))
    by_and = F.filter(F.transform(F.split(text, " and "), T.strip), lambda p: p != "")
    by_comma = F.filter(F.transform(F.split(text, ","), T.strip), lambda p: p != "")
    full_names = F.size(F.filter(by_comma, lambda p: F.contains(p, F.lit(" "))))
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.contains(text, F.lit(" and ")), by_and)
        .when((F.size(by_comma) > 1) & (full_names >= F.greatest(F.lit(2), F.size(by_comma) - 1)), by_comma)
        .otherwise(F.array(text))
    )


def authors_for_citeproc(authors: ColumnLike) -> Column:
    text = T.squeeze(T.blank(authors))
    parts = F.filter(F.transform(F.split(text, ","), T.strip), lambda p: p != "")
    return F.when(~F.contains(text, F.lit(" and ")) & (F.size(parts) >= 2), F.array_join(parts, " and ")).otherwise(text)


def initials(c: ColumnLike) -> Column:
    return F.array_join(F.regexp_extract_all(T.blank(c), F.lit("([A-Za-z])[A-Za-z]*"), F.lit(1)), "")


def author_with_initials(author: ColumnLike) -> Column:
    """``Surname AB``."""
    text = T.squeeze(T.blank(author))
    parts = F.split(text, " ")
    given_after_comma = F.substring(text, F.locate(",", text) + F.lit(1), F.length(text))
    given_words = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    joined = F.when(
        F.contains(text, F.lit(",")), F.concat(_before(text, ","), F.lit(" "), initials(given_after_comma))
    ).otherwise(F.concat(F.element_at(parts, -1), F.lit(" "), initials(given_words)))
    return F.when((F.size(parts) == 1) & ~F.contains(text, F.lit(",")), text).otherwise(T.strip(joined))


def year_in(c: ColumnLike) -> Column:
    """First 19xx/20xx year as int, else null."""
    return F.regexp_extract(T.blank(c), f"({K.YEAR_PATTERN})", 1).try_cast("int")


def year_int(c: ColumnLike) -> Column:
    """Four-digit year string as int, else null."""
    text = T.strip(T.blank(c))
    return F.when(text.rlike("^[0-9]{4}$"), text.try_cast("int"))


def compress_pages(c: ColumnLike) -> Column:
    """``1234--1238`` -> ``1234\u20138``; other dashes become en dashes."""
    text = T.squeeze(T.blank(c))
    start = T.strip(F.substring_index(text, "--", 1))
    end = T.strip(F.substring(text, F.locate("--", text) + F.lit(2), F.length(text)))
    # longest common prefix: one group captures it from "start|end"
    shared = F.length(F.regexp_extract(F.concat(start, F.lit("|"), end), r"^(\d*)\d*\|\1", 1))
    tail = F.substring(end, shared + 1, F.length(end))
    short = F.concat(start, F.lit("\u2013"), F.when(tail == "", end).otherwise(tail))
    return (
        F.when(~F.contains(text, F.lit("--")), F.replace(text, F.lit("-"), F.lit("\u2013")))
        .when(start.rlike(r"^\d+$") & end.rlike(r"^\d+$"), short)
        .otherwise(F.replace(text, F.lit("--"), F.lit("\u2013")))
    )


def authors_overlap(a: ColumnLike, b: ColumnLike) -> Column:
    long_tokens = lambda c: F.filter(T.informative_tokens(c), lambda t: F.length(t) >= 3)
    return F.arrays_overlap(long_tokens(a), long_tokens(b))


# --- keys and names ---------------------------------------------------------------

def short_hash(c: ColumnLike) -> Column:
    return F.substring(F.sha2(T.col(c), 256), 1, 16)


def content_id(sha256: ColumnLike) -> Column:
    return F.concat(F.lit("sha256-"), F.substring(T.col(sha256), 1, 16))


def reference_id(s2_id: ColumnLike, doi: ColumnLike, title: ColumnLike, year: ColumnLike,
                 authors: ColumnLike, venue: ColumnLike) -> Column:
    """Identifier of a record without a file: external id, else DOI, else a hash of the citation."""
    s2 = T.strip(T.blank(s2_id))
    nd = T.normalize_doi(doi)
    safe = F.regexp_replace(F.regexp_replace(nd, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    first = _before(T.blank(authors), ",")
    citation = F.concat_ws("|", T.normalize_title(title), T.strip(T.blank(year)), T.normalize_title(first),
                           T.normalize_title(venue))
    return (
        F.when(s2 != "", F.concat(F.lit("s2-"), s2))
        .when(nd != "", F.concat(F.lit("doi-"), safe))
        .otherwise(F.concat(F.lit("bib-"), short_hash(citation)))
    )


def bib_key(authors: ColumnLike, year: ColumnLike, title: ColumnLike, fallback: ColumnLike) -> Column:
    """Citation key: surname, year, alphabetically first informative title token."""
    fb = T.col(fallback)
    first = F.when(T.blank(authors) != "", _before(T.blank(authors), ",")).otherwise(fb)
    surname = F.coalesce(F.try_element_at(T.words(first), F.lit(-1)), fb)
    raw = F.concat(surname, T.first_filled(T.blank(year), F.lit("undated")), T.first_title_token(title))
    return F.replace(T.slug(raw), F.lit("-"), F.lit(""))


def batch_bib_key(authors: ColumnLike, year: ColumnLike, title: ColumnLike) -> Column:
    """Key used for imported entries without one: author token, year, title token."""
    return F.concat(T.first_title_token(authors), T.first_filled(year, F.lit("undated")),
                    T.first_title_token(T.first_filled(title, F.lit("title"))))


def safe_fragment(c: ColumnLike) -> Column:
    """ASCII text that is safe inside a file name."""
    text = F.regexp_replace(T.blank(c), "[\u2010\u2011\u2012\u2013\u2014\u2212]", "-")
    text = F.replace(ascii_fold(text), F.lit("&"), F.lit("and"))
    text = F.regexp_replace(text, r'[/:?*"<>|]+', " ")
    text = F.regexp_replace(text, r"\s*-\s*", "-")
    text = F.regexp_replace(text, r"\.{2,}", ".")
    return F.regexp_replace(T.squeeze(text), r"^[ .\-_]+|[ .\-_]+$", "")


def venue_stem(c: ColumnLike) -> Column:
    """First three letters of every longer word: ``Nature Communications`` -> ``NatCom``."""
    ws = F.filter(T.words(F.regexp_replace(T.blank(c), "[^A-Za-z]+", " ")), lambda w: F.length(w) >= 3)
    return F.array_join(F.transform(ws, lambda w: F.initcap(F.substring(w, 1, 3))), "")


def artifact_stem(key: ColumnLike, venue: ColumnLike) -> Column:
    suffix = venue_stem(venue)
    return F.when(suffix != "", F.concat_ws("_", T.col(key), suffix)).otherwise(T.col(key))


def supplement_suffix(filename: ColumnLike) -> Column:
    name = T.blank(filename)
    return (
        F.when(name.rlike(r"(?iU)\bSM\b"), " - SM")
        .when(name.rlike(r"(?iU)\b(?:SI|supp|supplement)\b"), " - SI")
        .otherwise("")
    )


def base_name(path: ColumnLike) -> Column:
    return F.substring_index(T.col(path), "/", -1)


def file_stem(filename: ColumnLike) -> Column:
    return F.regexp_replace(T.blank(filename), r"(?<=.)\.[^.]*$", "")


def best_pdf_url(oa_url: ColumnLike, external_ids: ColumnLike) -> Column:
    """Direct PDF link, else arXiv, else PubMed Central, else any open-access link."""
    url = T.strip(T.blank(oa_url))
    ids = T.col(external_ids)
    arxiv = T.strip(T.blank(F.try_element_at(ids, F.lit("ArXiv"))))
    pmc = T.strip(T.blank(F.try_element_at(ids, F.lit("PubMedCentral"))))
    pmc_id = F.when(F.startswith(F.upper(pmc), F.lit("PMC")), pmc).otherwise(F.concat(F.lit("PMC"), pmc))
    return (
        F.when(F.contains(F.lower(url), F.lit(".pdf")), url)
        .when(arxiv != "", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf")))
        .when(pmc != "", F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmc_id, F.lit("/pdf")))
        .otherwise(url)
    )
