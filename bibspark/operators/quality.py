"""Row predicates and audits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import names as N
from ..functions import text as T


def _title() -> Column:
    return T.first_filled("resolved_title", "title_query")


def is_malformed() -> Column:
    """No id, no valid content kind, or no title."""
    return (
        ~T.is_filled("paper_id")
        | ~T.clean_text("content_kind").isin(K.PDF_BACKED, K.REFERENCE_ONLY)
        | ~T.is_filled(_title())
    )


def _any_of(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def _joined(fields: list[str], clean: bool) -> Column:
    parts = [F.nullif(T.clean_text(f), F.lit("")) if clean else T.blank(f) for f in fields]
    return F.concat_ws(" ", *parts)


def is_supplement(variant: str = "audit", text: str = "text", max_chars: int | None = None) -> Column:
    """Supplement detection.

    ``audit``     word pattern over names, titles and notes, or the linked status
    ``merge``     marker list that also looks at notes and status
    ``reconcile`` marker list over names, titles and status
    ``bib``       short marker list
    ``file``      file name, or the text (its first ``max_chars`` characters, if given)
    """
    names = ["filename", "pdf_path", "resolved_title", "title_query"]
    if variant == "audit":
        return (T.clean_text("match_status") == "matched_supplement") | _joined(names + ["notes"], True).rlike(
            K.SUPPLEMENT_PATTERN)
    if variant == "merge":
        return _any_of(T.casefold(_joined(names + ["notes", "match_status"], True)), K.SUPPLEMENT_TOKENS_MERGE)
    if variant == "reconcile":
        return _any_of(T.casefold(_joined(names + ["match_status"], False)), K.SUPPLEMENT_TOKENS_RECONCILE)
    if variant == "bib":
        return _any_of(T.casefold(_joined(names + ["match_status"], False)), K.SUPPLEMENT_TOKENS_BIB)
    if variant == "file":
        body = F.col(text) if max_chars is None else F.substring(text, 1, max_chars)
        return T.blank("filename").rlike(r"(?iU)\b(?:SI|supp|supplement|supplementary|SM)\b") | body.rlike(
            r"(?iU)\b(?:supporting information|supplementary information|supplementary materials)\b")
    raise ValueError(variant)


def is_preprint(c: T.ColumnLike) -> Column:
    return _any_of(T.casefold(T.blank(c)), K.PREPRINT_TOKENS)


# --- file names -------------------------------------------------------------------

def _stem() -> Column:
    return F.regexp_replace(T.blank("filename"), r"(?i)\.pdf$", "")


def filename_looks_bad(min_chars: int = 20) -> Column:
    stem = _stem()
    return ((F.length(T.strip(stem)) < min_chars) | ~F.contains(stem, F.lit(" - "))
            | stem.rlike(r"^(?:[0-9A-Za-z]+[-_.]?)+$"))


def filename_looks_downloaded() -> Column:
    return F.lower(_stem()).rlike("|".join(K.DOWNLOAD_PATTERNS))


def filename_needs_touchup(min_chars: int = 20) -> Column:
    stem = _stem()
    loose = F.contains(stem, F.lit(" -")) | F.contains(stem, F.lit("- "))
    return (F.length(T.strip(stem)) < min_chars) | (loose & ~F.contains(stem, F.lit(" - ")))


# --- audits ------------------------------------------------------------------------

def _issues(checks: list[tuple[Column, str | Column]]) -> Column:
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in checks]))


def broken_rows(registry: DataFrame) -> DataFrame:
    """Rows with missing or generic metadata and the list of issues."""
    bad = lambda c, extra=(): (T.strip(c) == "") | F.lower(c).isin("none", "n/a", "null", *extra)
    title, key = _title(), T.blank("bibtex_key")
    authors, year, venue = T.blank("authors"), T.blank("year"), T.blank("venue")
    issues = _issues([
        (bad(title), "Missing title"),
        (bad(authors, ("author",)), "Missing or generic authors"),
        (~year.rlike(r"(?U)^\d+$"), "Missing or invalid year"),
        (bad(venue), "Missing journal/venue"),
        (T.strip(key) == "", "Missing BibTeX key"),
    ])
    return registry.select(
        "paper_id", T.first_filled(title, F.lit("Untitled")).alias("title"), authors.alias("authors"),
        year.alias("year"), venue.alias("venue"), T.blank("doi").alias("doi"), key.alias("bibtex_key"),
        issues.alias("issues"), "pdf_path", "content_kind",
    ).filter(F.size("issues") > 0)


def malformed_rows(registry: DataFrame) -> DataFrame:
    return registry.filter(is_malformed())


def row_summary(registry: DataFrame) -> DataFrame:
    plain = ["paper_id", "content_kind", "item_type", "bibtex_key", "year", "venue", "doi", "match_status",
             "pdf_sha256", "filename", "pdf_path", "canonical_url"]
    return registry.select(
        *[T.clean_text(c).alias(c) for c in plain], T.clean_text(_title()).alias("title"),
        is_supplement("audit").alias("supplement_like"), is_malformed().alias("malformed"))


def eligibility(rows: DataFrame, *, include_manual: bool = False, only_semantic: bool = False,
                statuses: tuple[str, ...] = ()) -> DataFrame:
    """Add ``skip_reason`` ("" = eligible) to registry rows joined with ``metadata_source``,
    ``record_pdf_path`` and ``record_filename``.  The first failing check names the reason."""
    source = T.strip(T.blank("metadata_source"))
    base = N.base_name(T.strip(T.blank("record_pdf_path")))
    name = T.strip(T.blank("record_filename"))
    reason = F.when(F.col("content_kind") != K.PDF_BACKED, F.lit("not_pdf_backed")).when(
        is_supplement("reconcile"), "supplement")
    if not include_manual:
        reason = reason.when(source.isin(K.PROTECTED_SOURCES), F.concat(F.lit("protected_source:"), source))
    if only_semantic:
        reason = reason.when(~T.casefold(source).isin(K.SEMANTIC_SOURCES), F.concat(
            F.lit("not_semantic_source:"), T.first_filled(source, F.lit("(blank)"))))
    if statuses:
        reason = reason.when(~F.col("match_status").isin(*statuses),
                             F.concat(F.lit("status_filtered:"), "match_status"))
    reason = (
        reason.when(T.blank("pdf_path") == "", "missing_pdf_path")
        .when(T.blank("text_path") == "", "missing_text_path")
        .when((base != "") & (name != "") & (base != name), F.concat(F.lit("invalid_record_filename:"), name))
        .otherwise(""))
    return rows.withColumn("skip_reason", reason)


def record_violations(records: DataFrame, file_hashes: DataFrame | None = None) -> DataFrame:
    """Integrity checks of records; ``file_hashes(pdf_path, actual_sha256)`` adds presence and hash checks."""
    r = records
    if file_hashes is not None:
        r = r.join(file_hashes, "pdf_path", "left")
    path = T.strip(T.blank("pdf_path"))
    kind = T.strip(T.blank("content_kind"))
    needs_file = (kind == K.PDF_BACKED) | (path != "")
    name = T.strip(T.blank("filename"))
    sha = T.strip(T.blank("pdf_sha256"))
    checks = [
        (T.strip(T.blank("paper_id")) == "", "paper_id_missing"),
        ((kind != "") & ~kind.isin(K.PDF_BACKED, K.REFERENCE_ONLY), "invalid_content_kind"),
        (needs_file & (path == ""), "missing_pdf_path"),
        (needs_file & (path != "") & (name != "") & (N.base_name(path) != name), "filename_mismatch"),
    ]
    if file_hashes is not None:
        checks += [
            (needs_file & (path != "") & F.col("actual_sha256").isNull(), "pdf_not_found"),
            (needs_file & F.col("actual_sha256").isNotNull() & (sha != "") & (F.col("actual_sha256") != sha),
             "sha256_mismatch"),
        ]
    return r.select("paper_id", _issues(checks).alias("violations")).filter(F.size("violations") > 0)


def stale_reference_rows(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Reference rows whose core fields are all empty although their record holds a manual entry."""
    core = F.concat(*[T.strip(T.blank(c)) for c in ("resolved_title", "authors", "year", "venue", "bibtex_key")])
    rows = registry.filter((F.col("content_kind") == K.REFERENCE_ONLY) & (core == "")
                           & (T.strip(T.blank("paper_id")) != "")).select("paper_id")
    manual = records.filter(T.strip(T.blank("manual_override.raw_bibtex")) != "").select("paper_id")
    return rows.join(manual, "paper_id", "left_semi")


def bib_missing_fields(entry_type: T.ColumnLike, fields: T.ColumnLike) -> Column:
    """Names of required fields an entry lacks; the venue field depends on the entry type."""
    has = lambda n: T.blank(F.try_element_at(T.col(fields), n)) != ""
    venue = venue_field(entry_type)
    return _issues([(~has(F.lit(n)), n) for n in ("title", "author", "year")] + [(~has(venue), venue)])


def venue_field(entry_type: T.ColumnLike) -> Column:
    m = F.create_map(*[F.lit(x) for kv in K.VENUE_FIELD_BY_TYPE.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(T.strip(T.blank(entry_type)))), F.lit(K.DEFAULT_VENUE_FIELD))


def metadata_losses(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Names of fields that are filled now and empty in the proposal."""
    return _issues([((T.squeeze(T.blank(old)) != "") & (T.squeeze(T.blank(new)) == ""), n) for n, old, new in pairs])


def field_changes(pairs: list[tuple[str, Column, Column]]) -> Column:
    """``field -> (current, proposed)`` for non-empty proposals that differ."""
    value = lambda c: T.strip(T.blank(c))
    everything = F.create_map(*[x for n, old, new in pairs for x in (
        F.lit(n), F.struct(value(old).alias("current"), value(new).alias("proposed")))])
    return F.map_filter(everything, lambda _, v: (v["proposed"] != "") & (v["proposed"] != v["current"]))


def outcome_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with ``count_if`` per named condition."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
