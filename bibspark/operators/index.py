"""Registry defaulting, search index build, and venue/journal joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.nested import abstract_of

CARRIED = ["row_ord"]


def with_defaults(df: DataFrame) -> DataFrame:
    """Project rows onto the registry columns; derive content kind and bibliography type when empty."""
    have = set(df.columns)
    base = {f: T.blank(f) if f in have else F.lit("") for f in K.REGISTRY_FIELDS}
    base["content_kind"] = T.first_filled(
        base["content_kind"], F.when(base["pdf_path"] != "", K.PDF_BACKED).otherwise(K.REFERENCE_ONLY))
    base["bibtex_type"] = T.first_filled(
        base["bibtex_type"], F.when(base["item_type"] == "book", "book").otherwise("article"))
    extra = [F.col(c) for c in df.columns if c not in base]
    return df.select(*[base[f].alias(f) for f in K.REGISTRY_FIELDS], *extra)


def row_title() -> Column:
    return T.first_filled("resolved_title", "title_query")


def journal_lookup(journals: DataFrame) -> DataFrame:
    """One row per canonical journal; the last row of a spelling wins.

    Needs an ``ord`` column for the file order.  Grouping combines map-side, so
    a journal that fills a third of the table is no hot task.
    """
    canon = T.normalize_venue(T.strip(F.col("journal")))
    return (
        journals.select(
            canon.alias("venue_canon"), "ord",
            T.strip(T.blank("citation_abbreviation")).alias("citation_abbreviation"),
            T.strip(T.blank("filename_abbreviation")).alias("filename_abbreviation"))
        .filter("venue_canon <> ''")
        .groupBy("venue_canon")
        .agg(F.max_by(F.struct("citation_abbreviation", "filename_abbreviation"), "ord").alias("j"))
        .select("venue_canon", "j.*")
    )


def join_journals(df: DataFrame, journals: DataFrame, venue: str = "venue") -> DataFrame:
    """Add both abbreviations of a row's journal (empty when unknown).

    No broadcast hint: the journal side is broadcast when Spark measures it below
    the threshold and shuffled (with skew splitting) when it is not.
    """
    keyed = df.withColumn("venue_canon", T.normalize_venue(venue))
    return (
        keyed.join(journal_lookup(journals), "venue_canon", "left")
        .withColumn("citation_abbreviation", T.blank("citation_abbreviation"))
        .withColumn("filename_abbreviation", T.blank("filename_abbreviation"))
    )


def build_search_index(registry: DataFrame, records: DataFrame | None, journals: DataFrame) -> DataFrame:
    """The 27 search columns plus ``row_ord`` and the journal's file abbreviation.

    Write the result as Parquet and search that: every normalisation is paid once.
    """
    rows = with_defaults(registry)
    if records is not None:
        abstracts = records.select("paper_id", abstract_of("search").alias("abstract"))
        rows = rows.join(abstracts, "paper_id", "left").withColumn("abstract", T.blank("abstract"))
    elif "abstract" not in rows.columns:
        rows = rows.withColumn("abstract", F.lit(""))
    rows = join_journals(rows.withColumn("title", row_title()), journals)
    sorted_tokens = lambda c: F.array_sort(T.informative_tokens(c))
    venue_words = F.array_union(T.informative_tokens("venue"), F.array_union(
        T.informative_tokens("citation_abbreviation"), T.informative_tokens("filename_abbreviation")))
    raw = ["paper_id", "bibtex_key", "content_kind", "item_type", "title", "authors", "year", "venue", "doi",
           "canonical_url", "filename", "pdf_path", "text_path", "chunk_path", "abstract"]
    return rows.select(
        *raw,
        T.compact("paper_id").alias("paper_id_norm"),
        T.compact("bibtex_key").alias("bibtex_key_norm"),
        *[T.normalize_title(c).alias(n) for c, n in (
            ("title", "title_norm"), ("authors", "authors_norm"), ("venue", "venue_norm"),
            ("filename", "filename_norm"), ("abstract", "abstract_norm"))],
        sorted_tokens("title").alias("title_tokens"),
        sorted_tokens("authors").alias("author_tokens"),
        F.array_sort(venue_words).alias("venue_tokens"),
        sorted_tokens("filename").alias("filename_tokens"),
        sorted_tokens("abstract").alias("abstract_tokens"),
        "filename_abbreviation",
        *[c for c in CARRIED if c in rows.columns],
    )
