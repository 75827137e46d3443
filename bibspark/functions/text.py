"""String normalisation, tokens and title similarity as Column expressions.

All helpers stay inside Catalyst, so they run in whole-stage codegen (or in the
higher-order-function evaluator) without a Python worker.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

ColumnLike = Column | str

# --- fixed values: full case folding where it differs from lower-casing and the
# result still leaves ASCII letters behind (code point -> folded text) -------------
CASE_FOLDS = {
    "\u00df": "ss", "\u1e9e": "ss", "\u017f": "s",
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl",
    "\ufb05": "st", "\ufb06": "st",
    "\u0149": "\u02bcn", "\u01f0": "j\u030c", "\u1e96": "h\u0331", "\u1e97": "t\u0308",
    "\u1e98": "w\u030a", "\u1e99": "y\u030a", "\u1e9a": "a\u02be",
}


FOLDING_LETTERS = "[" + "".join(CASE_FOLDS) + "]"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: ColumnLike) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def first_filled(*cs: ColumnLike) -> Column:
    """First non-empty value, or the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def strip_chars(c: ColumnLike, chars: str) -> Column:
    """Trim both ends by a regular-expression character set."""
    return F.regexp_replace(col(c), f"^[{chars}]+|[{chars}]+$", "")


def strip(c: ColumnLike) -> Column:
    """Trim white space.  One parameter, so it can be handed to ``transform`` as it is."""
    return strip_chars(c, K.SPACE)


def squeeze(c: ColumnLike) -> Column:
    """Collapse every white-space run to one blank and trim."""
    return F.trim(F.regexp_replace(col(c), f"[{K.SPACE}]+", " "))


def words(c: ColumnLike) -> Column:
    """White-space separated words; no empty strings."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c: ColumnLike) -> Column:
    return F.size(words(c))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once; keeps nested expressions small.

    For values that a larger expression needs several times, mostly inside lambdas, where Spark
    does not share common subexpressions.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def casefold(c: ColumnLike) -> Column:
    """Unicode case folding, as far as the a-z0-9 filters can see a difference."""
    return F.lower(reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), CASE_FOLDS.items(), col(c)))


def casefold_text(c: ColumnLike) -> Column:
    """The same for long texts: the replacements only run when an affected letter is there."""
    c = col(c)
    return F.when(c.rlike(FOLDING_LETTERS), casefold(c)).otherwise(F.lower(c))


def normalize_title(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(casefold(blank(c)), "[^a-z0-9]+", " "))


def compact(c: ColumnLike) -> Column:
    return F.regexp_replace(casefold(blank(c)), "[^a-z0-9]+", "")


def titleish(c: ColumnLike) -> Column:
    """Underscores and dash runs become blanks."""
    return squeeze(F.regexp_replace(F.replace(col(c), F.lit("_"), F.lit(" ")), "[-\u2010\u2011\u2013\u2014]+", " "))


def slug(c: ColumnLike) -> Column:
    hyphenated = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(hyphenated, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def clean_text(c: ColumnLike) -> Column:
    """Trim; words that mean "no value" become the empty string."""
    trimmed = strip(blank(c))
    return F.when(F.lower(trimmed).isin(K.NULLISH), "").otherwise(trimmed)


def is_filled(c: ColumnLike) -> Column:
    return clean_text(c) != ""


def normalize_doi_candidate(c: ColumnLike) -> Column:
    value = F.regexp_replace(strip(c), r"[.,);\]]+$", "")
    value = F.regexp_replace(value, r"(?i)/-/(?:dcsupplemental|supplemental).*", "")
    value = F.regexp_replace(value, r"(?iU)\.[gtsfe]\d{3}$", "")
    return F.when(
        value.rlike(r"(?iU)^10\.7554/elife\.\d+\.\d{3}$"), F.regexp_replace(value, r"(?U)\.\d{3}$", "")
    ).otherwise(value)


def normalize_doi(c: ColumnLike) -> Column:
    bare = F.regexp_replace(strip(blank(c)), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return F.lower(normalize_doi_candidate(bare))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_venue(c: ColumnLike) -> Column:
    venue = F.replace(F.replace(squeeze(blank(c)), F.lit("\\&"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    return F.coalesce(F.try_element_at(_literal_map(K.CANONICAL_VENUES), casefold(venue)), venue)


def venue_alias(c: ColumnLike) -> Column:
    """Venue key for a known alias, else the empty string."""
    return F.coalesce(F.try_element_at(_literal_map(K.VENUE_ALIASES), compact(c)), F.lit(""))


def venue_key(c: ColumnLike) -> Column:
    """Venue key for a known alias, else the compact name itself."""
    return F.coalesce(F.try_element_at(_literal_map(K.VENUE_ALIASES), compact(c)), compact(c))


def strip_tags(c: ColumnLike) -> Column:
    return squeeze(F.regexp_replace(blank(c), "<[^>]+>", " "))


def normalize_bib_key(c: ColumnLike) -> Column:
    return casefold(clean_text(c))


def title_year_key(title: ColumnLike, year: ColumnLike) -> Column:
    t, y = normalize_title(title), clean_text(year)
    return F.when((t != "") & (y != ""), F.concat_ws("|", t, y)).otherwise("")


def strip_supplement_markers(c: ColumnLike) -> Column:
    lead = (rf"(?i)^[{K.SPACE}]*(?:supporting information(?: for)?|"
            rf"supplementary (?:information|materials)(?: for)?)[{K.SPACE}]*")
    text = F.regexp_replace(col(c), lead, "")
    text = F.regexp_replace(text, r"(?iU)\b(?:SI|supplementary materials|supporting information)\b", "")
    return titleish(text)


def is_generic_title(c: ColumnLike) -> Column:
    return normalize_title(c).isin(K.GENERIC_TITLES)


# --- tokens -------------------------------------------------------------------

def tokens(c: ColumnLike) -> Column:
    return F.transform(F.regexp_extract_all(blank(c), F.lit(K.TOKEN_PATTERN), F.lit(0)), F.lower)


def informative_tokens(c: ColumnLike) -> Column:
    """Distinct tokens longer than one character that are not stop words, in text order."""
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    keep = F.filter(tokens(c), lambda t: F.length(t) > 1)
    return F.array_except(keep, stop)


def first_title_token(c: ColumnLike) -> Column:
    return F.coalesce(F.array_min(informative_tokens(c)), F.lit("paper"))


def quoted_phrases(c: ColumnLike) -> Column:
    raw = F.regexp_extract_all(col(c), F.lit('"([^"]+)"'), F.lit(1))
    return F.transform(F.filter(raw, lambda p: strip(p) != ""), normalize_title)


def similarity_from_parts(qn: Column, tn: Column, qt: Column, tt: Column) -> Column:
    """Title similarity from normalised strings and their informative tokens."""
    overlap = F.size(F.array_intersect(qt, tt)).cast("double")
    union = F.size(qt) + F.size(tt) - overlap
    blend = overlap / F.size(qt) * 0.65 + overlap / union * 0.35
    return (
        F.when((qn == "") | (tn == ""), 0.0)
        .when(qn == tn, 1.0)
        .when(F.contains(tn, qn) | F.contains(qn, tn), 0.92)
        .when((F.size(qt) == 0) | (F.size(tt) == 0), 0.0)
        .otherwise(F.least(F.lit(1.0), blend))
    )


def title_similarity(query: ColumnLike, title: ColumnLike) -> Column:
    """1.0 when equal, 0.92 when one contains the other, else a coverage/Jaccard blend."""
    def parts(c: ColumnLike) -> Column:
        return let(normalize_title(c), lambda n: F.struct(n.alias("n"), informative_tokens(n).alias("t")))

    pair = F.struct(parts(query).alias("q"), parts(title).alias("t"))
    return let(pair, lambda p: similarity_from_parts(p["q"]["n"], p["t"]["n"], p["q"]["t"], p["t"]["t"]))


def dedupe_queries(queries: ColumnLike) -> Column:
    """Query texts in order, one per normalised form; empty ones are left out."""
    pairs = F.transform(col(queries), lambda q: F.struct(normalize_title(q).alias("n"), squeeze(q).alias("q")))
    kept = let(pairs, lambda ps: F.filter(ps, lambda p, i: (p["n"] != "") & (
        F.array_position(F.transform(ps, lambda x: x["n"]), p["n"]) == i + 1)))
    return F.transform(kept, lambda p: p["q"])
