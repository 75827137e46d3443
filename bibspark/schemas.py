"""Table schemas."""
from pyspark.sql import types as T

from .constants import REGISTRY_FIELDS


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


REGISTRY = T.StructType(_strings(*REGISTRY_FIELDS))
TEXTS = T.StructType(_strings("paper_id", "filename", "text"))
JOURNALS = T.StructType(_strings("journal", "filename_abbreviation", "citation_abbreviation", "citation_source"))
DATE_PARTS = T.StructType([T.StructField("date-parts", T.ArrayType(T.ArrayType(T.IntegerType())))])
WORK = T.StructType([
    *_strings("DOI", "URL", "abstract", "volume", "issue", "page", "publisher"),
    T.StructField("title", T.ArrayType(T.StringType())),
    T.StructField("container-title", T.ArrayType(T.StringType())),
    T.StructField("ISSN", T.ArrayType(T.StringType())),
    T.StructField("author", T.ArrayType(T.StructType(_strings("given", "family")))),
    T.StructField("published-print", DATE_PARTS),
    T.StructField("published-online", DATE_PARTS),
    T.StructField("issued", DATE_PARTS),
])
CANDIDATE = T.StructType([
    *_strings("paperId", "title", "abstract", "venue", "url"),
    T.StructField("year", T.IntegerType()),
    T.StructField("authors", T.ArrayType(T.StructType(_strings("name")))),
    T.StructField("externalIds", T.MapType(T.StringType(), T.StringType())),
    T.StructField("journal", T.StructType(_strings("name"))),
    T.StructField("openAccessPdf", T.StructType(_strings("url"))),
])
OVERRIDE_FIELDS = ["title", "authors", "year", "venue", "doi", "url", "abstract", "raw_bibtex",
                   "bibtex_key", "parsed_bibtex_type", "source_note"]
EVENT = T.StructType([*_strings("action", "timestamp", "merged_from_paper_id"),
                      T.StructField("identity_signals", T.ArrayType(T.StringType())), T.StructField("deleted_drop_pdf", T.BooleanType())])

RECORD = T.StructType([
    *_strings("paper_id", "content_kind", "metadata_source", "pdf_path", "pdf_sha256", "filename",
              "item_type", "title_query", "match_status", "date_indexed"),
    T.StructField("match_confidence", T.DoubleType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("crossref_warnings", T.ArrayType(T.StringType())),
    T.StructField("doi_candidates", T.ArrayType(T.StringType())),
    T.StructField("resolved_metadata", T.StructType(_strings("abstract"))),
    T.StructField("manual_override", T.StructType(_strings(*OVERRIDE_FIELDS))),
    T.StructField("crossref", T.StructType([
        T.StructField("accepted", T.BooleanType()), *_strings("error"), T.StructField("metadata", WORK)])),
    T.StructField("semantic_scholar", T.StructType([
        *_strings("api_error"), T.StructField("best_candidate", CANDIDATE)])),
    T.StructField("supplement_parent", REGISTRY),
    T.StructField("artifacts", T.StructType(_strings("text_path", "chunk_path", "text_kind"))),
    T.StructField("text_extraction", T.StructType(_strings("error"))),
    T.StructField("maintenance", T.ArrayType(EVENT)),
])
PARSED_BIB = T.StructType([
    *_strings("entry_type", "bibtex_key"),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    *_strings("error"),
])
