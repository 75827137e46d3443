"""Registry-shaped views derived from the given tables.

``documents`` becomes a registry (one row per document), its texts, a bibliography,
works, candidates, records and change tables.  Every view is a projection of a whole
table; nothing is sampled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REGISTRY_FIELDS
from ..session import spread_scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_scan(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _s(c: Column) -> Column:
    return c.cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def registry(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """23 registry columns plus ``row_ord`` and ``lang``, and ``more`` columns of the documents."""
    d = F.col("doc_id")
    line = F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"\s+", " "))
    filename = F.concat(F.lit("doc_"), _s(d), F.when(d % 25 == 7, " - SI").otherwise(""), F.lit(".pdf"))
    k = d - F.when(d % 50 == 3, 1).otherwise(0)
    year = F.when(d % 31 == 4, "n/a").otherwise(_s(F.lit(1980) + F.col("n_chars") % 45))
    return documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), _s(d)).alias("paper_id"),
        F.lit("article").alias("item_type"),
        F.when(d % 10 == 9, "reference_only").otherwise("pdf_backed").alias("content_kind"),
        F.when(d % 10 == 9, "").otherwise(F.concat_ws("/", F.lit("articles"), "source", filename)).alias("pdf_path"),
        F.sha2("text", 256).alias("pdf_sha256"),
        filename.alias("filename"),
        F.when(d % 46 == 5, "").otherwise(line).alias("title_query"),
        F.when(d % 23 == 5, "").otherwise(line).alias("resolved_title"),
        F.concat(F.lit("Ada Name"), _s(d % 97), F.lit(", Bo Name"), _s(d % 13)).alias("authors"),
        year.alias("year"),
        F.element_at(F.array(
            F.lit("nature genetics"), F.lit("PLOS ONE"), F.lit("Journal of Molecular Biology"), F.lit("bioRxiv"),
            F.lit("Nature Structural &amp; Molecular Biology"), F.lit("")), (d % 6 + 1).cast("int")).alias("venue"),
        F.when(d % 4 == 0, "").otherwise(F.concat(
            F.when(d % 7 == 0, "https://doi.org/").otherwise(""), F.lit("10.1234/abc."),
            F.lpad(_s(k), 6, "0"))).alias("doi"),
        F.when(d % 3 == 0, F.concat(F.lit("S"), _s(d))).otherwise("").alias("semantic_scholar_paper_id"),
        F.lit("").alias("match_confidence"),
        F.element_at(F.array(*[F.lit(x) for x in (
            "matched", "matched_via_doi", "manual_verified", "needs_manual_review", "not_found")]),
            (d % 5 + 1).cast("int")).alias("match_status"),
        F.when(d % 8 == 1, "book").otherwise("").alias("bibtex_type"),
        F.when(d % 4 == 2, F.concat(F.lit("https://example.org/"), _s(d))).otherwise("").alias("canonical_url"),
        F.when(d % 41 == 6, "").otherwise(F.concat(
            F.lit("name"), _s(d % 97), year, F.regexp_extract(F.lower(line), "[a-z0-9]+", 0))).alias("bibtex_key"),
        F.concat(F.lit("texts/doc-"), _s(d), F.lit(".txt")).alias("text_path"),
        F.when(d % 9 == 0, "").otherwise(F.concat(F.lit("chunks/doc-"), _s(d), F.lit(".jsonl"))).alias("chunk_path"),
        F.lit("").alias("abstract_source"),
        F.lit("").alias("date_indexed"),
        F.when(d % 37 == 3, "see supporting information").otherwise("").alias("notes"),
        d.alias("row_ord"),
        F.col("lang"), *more,
    )


def registry_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select(*REGISTRY_FIELDS, "row_ord")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), _s(F.col("doc_id"))).alias("paper_id"), "text")


def planted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; two of three carry a DOI planted after the first line or at the end."""
    d = F.col("doc_id")
    doi = F.concat(F.lit("10.1234/abc."), F.lpad(_s(d), 6, "0"))
    head = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(head) + 1, F.length("text"))
    text = (
        F.when(d % 3 == 1, F.concat(head, F.lit("\nhttps://doi.org/"), doi, rest))
        .when(d % 3 == 2, F.concat(F.col("text"), F.lit("\nReferences\ncited by doi: "), doi, F.lit(". 10.1234/abc.")))
        .otherwise(F.col("text"))
    )
    return documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), _s(d)).alias("paper_id"),
        F.concat(F.lit("Name"), _s(d % 97), F.lit(" "), _s(F.lit(1980) + F.col("n_chars") % 45),
                 F.lit(" NatGenet - "), F.regexp_replace(F.substring_index("text", "\n", 1), "[/]", " "), F.lit(".pdf")).alias("filename"),
        text.alias("text"),
    )


def bib_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliography entry per non-empty key: ``(ord, entry_type, bibtex_key, raw)``."""
    r = registry(spark, sf_dir).filter("bibtex_key <> ''")
    entry_type = F.when(F.col("row_ord") % 8 == 1, "book").otherwise("article")
    raw = F.concat(
        F.lit("@"), F.when(F.col("row_ord") % 8 == 1, "Book").otherwise("article"), F.lit("{"), F.col("bibtex_key"),
        F.lit(",\n  title = {"), F.col("resolved_title"),
        F.lit("},\n  Author = \""), F.col("authors"),
        F.lit("\",\n  year = "), F.when(F.col("year") == "n/a", "{}").otherwise(F.col("year")),
        F.lit(",\n  "), F.when(F.col("row_ord") % 8 == 1, "publisher").otherwise("journal"),
        F.lit(" = {{"), F.col("venue"), F.lit("}},\n  doi={"), F.col("doi"),
        F.lit("},\n  x-local = {n "), _s(F.col("row_ord")), F.lit("},\n  pages = {1"),
        _s(F.col("row_ord") % 90 + 10), F.lit("--1"), _s(F.col("row_ord") % 90 + 15), F.lit("}\n}"),
    )
    return r.select(F.col("row_ord").alias("ord"), entry_type.alias("entry_type"), "bibtex_key", raw.alias("raw"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk works table: one row per document DOI, some with another title or no title."""
    d = F.col("row_ord")
    words = F.split("title_query", " ")
    title = (
        F.when(d % 11 == 2, F.lit("Abstract"))
        .when(d % 5 == 1, F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)), " "))
        .when(d % 7 == 3, F.concat(F.lit("Unrelated report "), _s(d)))
        .otherwise(F.col("title_query"))
    )
    y = F.col("year").try_cast("int")
    parts = F.struct(F.array(F.array(y + (d % 3).cast("int") - 1)).alias("date-parts"))
    none = F.lit(None).cast("struct<`date-parts`:array<array<int>>>")
    return registry(spark, sf_dir).select(
        F.concat(F.lit("10.1234/ABC."), F.lpad(_s(d), 6, "0")).alias("DOI"),
        F.concat(F.lit("https://works.example.org/"), _s(d)).alias("URL"),
        F.concat(F.lit("<jats:p>Work <i>"), _s(d), F.lit("</i></jats:p>")).alias("abstract"),
        _s(d % 40).alias("volume"), _s(d % 12).alias("issue"),
        F.concat(_s(d), F.lit("-"), _s(d + 7)).alias("page"), F.lit("Pub").alias("publisher"),
        F.array(title).alias("title"),
        F.array(F.when(F.col("venue") == "bioRxiv", "Nature Genetics").otherwise(F.col("venue"))).alias("container-title"),
        F.array(F.lit("1234-5678")).alias("ISSN"),
        F.array(
            F.struct(F.lit("Ada").alias("given"), F.concat(F.lit("Name"), _s(d % 97)).alias("family")),
            F.struct(F.lit("Bo").alias("given"), F.concat(F.lit("Name"), _s(d % 13)).alias("family")),
        ).alias("author"),
        F.when(d % 2 == 0, parts).otherwise(none).alias("published-print"),
        none.alias("published-online"),
        parts.alias("issued"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk candidate table: every document title once more, some shortened, some with other years."""
    d = F.col("row_ord")
    words = F.split("title_query", " ")
    title = F.when(d % 3 == 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)), " ")) \
        .when(d % 3 == 1, F.col("title_query")) \
        .otherwise(F.array_join(F.reverse(words), " "))
    y = F.col("year").try_cast("int")
    return registry(spark, sf_dir).select(
        F.concat(F.lit("C"), _s(d)).alias("paperId"),
        title.alias("title"),
        F.concat(F.lit("Abstract of "), _s(d)).alias("abstract"),
        F.col("venue"),
        F.concat(F.lit("https://c.example.org/"), _s(d)).alias("url"),
        (y + (d % 4).cast("int") - 1).alias("year"),
        F.array(F.struct(F.concat(F.lit("Ada Name"), _s(d % 97)).alias("name")),
                F.struct(F.concat(F.lit("Bo Name"), _s(d % 13)).alias("name"))).alias("authors"),
        F.when(d % 4 != 0, F.create_map(F.lit("DOI"), F.concat(F.lit("10.1234/abc."), F.lpad(_s(d), 6, "0"))))
         .when(d % 8 == 0, F.create_map(F.lit("ArXiv"), F.concat(F.lit("2001."), _s(d))))
         .otherwise(F.create_map(F.lit("PubMedCentral"), _s(d))).alias("externalIds"),
        F.when(d % 5 == 0, F.struct(F.lit("Nature Genetics").alias("name"))).alias("journal"),
        F.struct(F.when(d % 6 == 0, F.concat(F.lit("https://x.example.org/"), _s(d), F.lit(".pdf")))
                 .otherwise("").alias("url")).alias("openAccessPdf"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provenance record per document; the accepted source rotates with the id."""
    from ..schemas import RECORD, REGISTRY

    d = F.col("row_ord")
    y = F.col("year").try_cast("int")
    null = F.lit(None)
    work = F.struct(
        F.col("doi").alias("DOI"), F.concat(F.lit("https://works.example.org/"), _s(d)).alias("URL"),
        F.concat(F.lit("<p>Work "), _s(d), F.lit("</p>")).alias("abstract"),
        _s(d % 40).alias("volume"), _s(d % 12).alias("issue"), F.lit("1-2").alias("page"),
        F.lit("Pub").alias("publisher"),
        F.array(F.concat(F.col("title_query"), F.lit(" revised"))).alias("title"),
        F.array("venue").alias("container-title"), F.array(F.lit("1234-5678")).alias("ISSN"),
        F.array(F.struct(F.lit("Ada").alias("given"), F.concat(F.lit("Name"), _s(d % 97)).alias("family"))).alias("author"),
        null.cast("struct<`date-parts`:array<array<int>>>").alias("published-print"),
        null.cast("struct<`date-parts`:array<array<int>>>").alias("published-online"),
        F.struct(F.array(F.array(y)).alias("date-parts")).alias("issued"))
    cand = F.struct(
        F.concat(F.lit("C"), _s(d)).alias("paperId"), F.col("title_query").alias("title"),
        F.when(d % 2 == 0, F.concat(F.lit("Abstract &amp; <b>more</b> "), _s(d))).otherwise("").alias("abstract"),
        F.col("venue"), F.concat(F.lit("https://c.example.org/"), _s(d)).alias("url"), y.alias("year"),
        F.array(F.struct(F.concat(F.lit("Cy Name"), _s(d % 97)).alias("name"))).alias("authors"),
        F.create_map(F.lit("DOI"), F.col("doi")).alias("externalIds"),
        null.cast("struct<name:string>").alias("journal"), null.cast("struct<url:string>").alias("openAccessPdf"))
    manual = F.struct(
        F.concat(F.lit("Manual "), _s(d)).alias("title"), F.lit("Man Ual").alias("authors"), F.lit("2001").alias("year"),
        F.lit("plos one").alias("venue"), F.lit("").alias("doi"),
        F.when(d % 12 == 0, F.concat(F.lit("https://m.example.org/"), _s(d))).otherwise("").alias("url"),
        F.lit("Manual abstract").alias("abstract"),
        F.concat(F.lit("@book{man"), _s(d), F.lit(",\n title={Raw},\n doi={10.1/"), _s(d), F.lit("}\n}")).alias("raw_bibtex"),
        F.lit("").alias("bibtex_key"), F.lit("").alias("parsed_bibtex_type"), F.lit("checked").alias("source_note"))
    parent = F.struct(*[F.col(f.name) for f in REGISTRY])
    shaped = registry(spark, sf_dir).select(
        "paper_id", "content_kind",
        F.element_at(F.array(F.lit("manual_bibtex"), F.lit("crossref_doi_primary"), F.lit("manual_supplement_link"),
                             F.lit("semantic_scholar_primary"), F.lit("")), (d % 5 + 1).cast("int")).alias("metadata_source"),
        F.when(F.col("pdf_path") != "", F.concat(F.lit("/library/"), F.col("pdf_path"))).otherwise("").alias("pdf_path"),
        F.when(d % 17 == 2, "bad").otherwise(F.col("pdf_sha256")).alias("pdf_sha256"),
        F.when(d % 19 == 4, "other.pdf").otherwise(F.col("filename")).alias("filename"),
        "item_type", "title_query",
        F.when(d % 5 == 1, "matched_via_doi").otherwise(F.col("match_status")).alias("match_status"),
        F.lit("2024-01-01T00:00:00+00:00").alias("date_indexed"),
        (d % 100 / 100.0).alias("match_confidence"),
        F.array(F.lit("w1")).alias("warnings"), F.array().cast("array<string>").alias("crossref_warnings"),
        F.array().cast("array<string>").alias("doi_candidates"),
        null.cast("struct<abstract:string>").alias("resolved_metadata"),
        F.when(d % 5 == 0, manual).alias("manual_override"),
        F.struct((d % 5 == 1).alias("accepted"), F.when(d % 7 == 0, "HTTP 404").otherwise("").alias("error"),
                 F.when(d % 5 <= 1, work).alias("metadata")).alias("crossref"),
        F.struct(F.lit("").alias("api_error"), F.when(d % 5 != 2, cand).alias("best_candidate")).alias("semantic_scholar"),
        F.when(d % 5 == 2, parent).alias("supplement_parent"),
        F.struct("text_path", "chunk_path", F.lit("").alias("text_kind")).alias("artifacts"),
        F.struct(F.lit("").alias("error")).alias("text_extraction"),
        F.array().alias("maintenance"),
        "row_ord",
    )
    return shaped.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in RECORD], "row_ord")


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal table with spelling variants, derived from the venues in the registry view."""
    from ..functions import names as N

    base = registry(spark, sf_dir).filter("venue <> ''")
    variant = F.when(F.col("row_ord") % 3 == 0, F.upper("venue")).otherwise(F.col("venue"))
    return base.groupBy(variant.alias("journal")).agg(F.min("row_ord").alias("ord")).select(
        "journal",
        F.when(F.col("ord") % 2 == 1, N.venue_stem("journal")).otherwise("").alias("filename_abbreviation"),
        F.concat(N.venue_stem("journal"), F.lit(".")).alias("citation_abbreviation"),
        F.lit("derived").alias("citation_source"), "ord")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation cites registry rows turn by turn: ``(doc_id, pos, paper_ids)``."""
    n = documents(spark, sf_dir).agg(F.count("*")).scalar()
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        _s(c).alias("doc_id"), t.alias("pos"),
        F.array(F.concat(F.lit("doc-"), _s((c * 7 + t * 3) % n)),
                F.concat(F.lit("doc-"), _s((c * 7 + t) % n))).alias("paper_ids"))
