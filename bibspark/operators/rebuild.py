"""Registry rows from records, guarded refresh, and reconciliation against works."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import bibtex as B
from ..functions import names as N
from ..functions import nested as V
from ..functions import text as T
from .bib import dedupe_keys, match_entries
from .joins import spread_blank
from .maintain import upsert
from .quality import eligibility, field_changes, is_preprint, metadata_losses
from .resolve import resolve_dois


def _relative(path: Column, root: str) -> Column:
    head = root.rstrip("/") + "/"
    return F.when(F.startswith(T.blank(path), F.lit(head)), F.substring(T.blank(path), len(head) + 1, 1 << 30)).otherwise(T.blank(path))


def rows_from_records(records: DataFrame, registry: DataFrame, parsed_bib: DataFrame, root: str = "/library") -> DataFrame:
    """Registry rows rebuilt from records.

    Metadata precedence: manual entry, accepted work, supplement parent, candidate.  Keys come from the
    manual entry, the parent, or the bibliography entry that matches.
    """
    r = records.withColumn("_manual_raw", F.when(
        T.strip(T.blank("manual_override.raw_bibtex")) != "", B.parse_bib(F.col("manual_override.raw_bibtex"))))
    parsed_ok = F.coalesce((F.col("_manual_raw.error") == "") & (F.col("_manual_raw.bibtex_key") != ""), F.lit(False))
    raw_meta = B.normalized_metadata(F.col("_manual_raw.fields"))
    m = {n: T.first_filled(F.col(f"manual_override.{n}"), F.when(parsed_ok, raw_meta[n]))
         for n in ("title", "authors", "year", "doi", "url", "abstract")}
    m["venue"] = T.first_filled(T.normalize_venue("manual_override.venue"), F.when(parsed_ok, raw_meta["venue"]))
    m["key"] = T.first_filled("manual_override.bibtex_key", F.when(parsed_ok, F.col("_manual_raw.bibtex_key")))
    m["type"] = T.first_filled("manual_override.parsed_bibtex_type", F.when(parsed_ok, F.col("_manual_raw.entry_type")))

    has_manual = F.col("manual_override").isNotNull()
    has_work = (F.coalesce("crossref.accepted", F.lit(False)) | (T.blank("match_status") == "matched_via_doi")) & F.col(
        "crossref.metadata").isNotNull()
    has_parent = F.col("supplement_parent").isNotNull()
    cand_struct = F.col("semantic_scholar.best_candidate")
    work, cand = V.work_fields(F.col("crossref.metadata")), V.candidate_fields(cand_struct)
    raw_cand = {
        "title": T.blank(cand_struct["title"]),
        "authors": T.blank(F.array_join(F.transform(cand_struct["authors"], lambda a: T.blank(a["name"])), ", ")),
        "year": cand["year"], "venue": cand["venue"],
        "doi": T.first_filled(F.try_element_at(cand_struct["externalIds"], F.lit("DOI")),
                              F.try_element_at(cand_struct["externalIds"], F.lit("doi")))}
    parent = {n: T.blank(F.col(f"supplement_parent.{c}")) for n, c in (
        ("title", "resolved_title"), ("authors", "authors"), ("year", "year"))}
    parent |= {"venue": T.normalize_venue("supplement_parent.venue"), "doi": F.lit("")}

    def pick(n: str) -> Column:
        return F.when(has_manual, m[n]).when(has_work, work[n]).when(has_parent, parent[n]).otherwise(raw_cand[n])

    strip = lambda c: T.strip(T.blank(c))
    kind = T.first_filled(strip("content_kind"), F.when(T.blank("pdf_path") != "", K.PDF_BACKED).otherwise(K.REFERENCE_ONLY))
    notes = F.array_join(F.filter(F.flatten(F.array(
        F.array(strip("text_extraction.error"), strip("semantic_scholar.api_error"), strip("crossref.error")),
        F.coalesce("warnings", F.array()), F.coalesce("crossref_warnings", F.array()),
        F.array(strip("manual_override.source_note")))), lambda n: n != ""), " | ")
    url = F.when(has_work, work["url"])
    d = r.select(
        T.blank("paper_id").alias("paper_id"), T.blank("item_type").alias("item_type"), kind.alias("content_kind"),
        _relative(F.col("pdf_path"), root).alias("pdf_path"), T.blank("pdf_sha256").alias("pdf_sha256"),
        T.blank("filename").alias("filename"), T.blank("title_query").alias("title_query"),
        pick("title").alias("resolved_title"), pick("authors").alias("authors"), pick("year").alias("year"),
        pick("venue").alias("venue"), pick("doi").alias("doi"),
        cand["semantic_scholar_paper_id"].alias("semantic_scholar_paper_id"),
        T.blank(F.col("match_confidence").cast("string")).alias("match_confidence"),
        T.blank("match_status").alias("match_status"),
        V.canonical_url(m["url"], url, cand_struct["url"]).alias("canonical_url"),
        _relative(F.col("artifacts.text_path"), root).alias("text_path"),
        _relative(F.col("artifacts.chunk_path"), root).alias("chunk_path"),
        F.when(has_manual & (T.blank("manual_override.abstract") != ""), "manual_verified")
         .when(T.blank(cand_struct["abstract"]) != "", "semantic_scholar").otherwise("").alias("abstract_source"),
        T.blank("date_indexed").alias("date_indexed"), notes.alias("notes"),
        has_manual.alias("_manual"), has_parent.alias("_parent"), m["key"].alias("_mkey"), m["type"].alias("_mtype"),
        T.blank("supplement_parent.bibtex_key").alias("_pkey"))
    # key the bibliography is asked for: the known key of the row, or the key the record brings itself
    known = registry.select("paper_id", F.col("bibtex_key").alias("_known"))
    d = d.join(known, "paper_id", "left").withColumn("existing_key", F.when(F.col("_manual"), F.col("_mkey")).when(
        F.col("_parent"), F.col("_pkey")).otherwise(T.blank("_known")))
    d = match_entries(d.withColumn("title", F.col("resolved_title")), parsed_bib)
    minted = N.bib_key("authors", "year", "resolved_title", T.first_filled(N.file_stem("filename"), F.lit("paper")))
    own = F.col("_manual") | F.col("_parent")
    # a minted key may be the key of an entry that no other level found; its type counts then
    types = dedupe_keys(parsed_bib, "last").select(F.col("bibtex_key").alias("_minted"), F.col("entry_type").alias("_minted_type"))
    d = d.withColumn("_minted", F.when(own | (F.col("entry_key") != ""), spread_blank(F.lit(""), F.col("paper_id"))).otherwise(
        minted)).join(types, "_minted", "left")
    key = F.when(F.col("_manual"), F.col("_mkey")).when(F.col("_parent"), F.col("_pkey")).otherwise(
        T.first_filled("entry_key", minted))
    btype = T.first_filled(F.when(own, F.col("_mtype")), F.col("entry_type"), T.blank("_minted_type"),
                           F.when(F.col("item_type") == "book", "book").otherwise("article"))
    d = d.withColumn("bibtex_key", key).withColumn("bibtex_type", btype)
    return d.select(*K.REGISTRY_FIELDS)


PROTECTED_FIELDS = ["resolved_title", "authors", "year", "venue", "doi", "bibtex_key", "canonical_url"]
REQUIRED_FILE_FIELDS = ["pdf_path", "filename", "text_path", "chunk_path"]


def refresh(registry: DataFrame, rebuilt: DataFrame, allow_lossy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace rows by their rebuilt form unless that would lose metadata or break a row with text.

    Returns the planned registry and the refused rows with their reasons.
    """
    old = registry.select("paper_id", "row_ord", *[F.col(c).alias(f"_old_{c}") for c in PROTECTED_FIELDS])
    d = rebuilt.join(old, "paper_id")
    losses = metadata_losses([(c, F.col(f"_old_{c}"), F.col(c)) for c in PROTECTED_FIELDS])
    missing = F.array_compact(F.array(*[
        F.when((F.col("content_kind") == K.PDF_BACKED) & (T.strip(c) == ""), F.lit(f"missing:{c}"))
        for c in REQUIRED_FILE_FIELDS]))
    bad_kind = F.when(~F.col("content_kind").isin(K.PDF_BACKED, K.REFERENCE_ONLY), F.array(F.lit("invalid_content_kind"))).otherwise(
        F.array().cast("array<string>"))
    problems = F.concat(bad_kind, missing)
    if not allow_lossy:
        problems = F.concat(problems, F.transform(losses, lambda n: F.concat(F.lit("loss:"), n)))
    d = d.withColumn("problems", problems)
    good = d.filter(F.size("problems") == 0).select(*K.REGISTRY_FIELDS, "row_ord")
    return upsert(registry.select(*K.REGISTRY_FIELDS, "row_ord"), good), d.filter(F.size("problems") > 0).select(
        "paper_id", "problems")


# --- reconcile ------------------------------------------------------------------------

def _work_pairs(w: dict[str, Column]) -> list[tuple[str, Column, Column]]:
    named = [(n, F.col(n), w[f]) for n, f in (
        ("resolved_title", "title"), ("authors", "authors"), ("year", "year"), ("venue", "venue"), ("doi", "doi"),
        ("canonical_url", "url"))]
    return named + [(f"bibtex.{n}", F.lit(""), w[n]) for n in ("volume", "number", "pages", "issn", "publisher")]


def rewrite_reasons(w: dict[str, Column]) -> Column:
    """Why applying works metadata would change the identity or version of a row; empty = pure enrichment."""
    title = T.squeeze(T.first_filled("resolved_title", "title_query"))
    new_title = T.squeeze(w["title"])
    sim = T.title_similarity(title, new_title)
    doi, new_doi = T.normalize_doi("doi"), T.normalize_doi(w["doi"])
    differ = lambda a, b: (a != "") & (b != "") & (a != b)
    first = lambda c: N.first_author_surname(c, squeeze_first=True)
    venue, new_venue = T.squeeze(T.blank("venue")), T.squeeze(w["venue"])
    preprint_doi = F.startswith(doi, F.lit("10.1101/")) | F.startswith(doi, F.lit("10.48550/"))
    return F.array_compact(F.array(
        F.when((title != "") & (new_title != "") & (sim < 0.92),
               F.concat(F.lit("title_changed_score="), F.format_string("%.3f", sim))),
        F.when(differ(doi, new_doi), "doi_changed"),
        F.when(differ(T.squeeze(T.blank("year")), T.squeeze(w["year"])), "year_changed"),
        F.when(differ(first("authors"), first(w["authors"])), "first_author_changed"),
        F.when(is_preprint(venue) & (new_venue != "") & ~is_preprint(new_venue), "preprint_to_journal"),
        F.when(preprint_doi & differ(doi, new_doi), "preprint_doi_to_journal_doi")))


def reconcile(registry: DataFrame, records: DataFrame, text_facts: DataFrame, works: DataFrame, *,
              min_score: float = K.DOI_ACCEPT, apply_rewrites: bool = False, **eligible) -> DataFrame:
    """Evaluate registry rows against works found through the DOIs in their texts.

    ``text_facts`` comes from :func:`bibspark.operators.resolve.with_text_facts`.  Result columns: skip
    reason, accepted, score, job type, reasons, changed fields, and whether the policy lets it apply.
    """
    meta = records.select("paper_id", "metadata_source", F.col("pdf_path").alias("record_pdf_path"),
                          F.col("filename").alias("record_filename"))
    rows = eligibility(registry.join(meta, "paper_id", "left"), **eligible)
    facts = text_facts.join(rows.filter("skip_reason = ''").select("paper_id", F.array(
        T.first_filled("resolved_title", "title_query"), T.blank("title_query")).alias("_row_titles")), "paper_id")
    # the row's own titles count as targets too
    facts = facts.withColumn("title_candidates", F.concat("_row_titles", "title_candidates")).drop("_row_titles")
    found = resolve_dois(facts, works).select(
        "paper_id", "best_doi", "best_score", "decision", "work", F.col("warnings").alias("work_warnings"))
    has_text = text_facts.select("paper_id", F.lit(True).alias("_text"))
    d = rows.join(has_text, "paper_id", "left").join(found, "paper_id", "left")
    d = d.withColumn("skip_reason", F.when((F.col("skip_reason") == "") & F.col("_text").isNull(), "missing_text_content")
                     .otherwise(F.col("skip_reason")))
    eligible_row = F.col("skip_reason") == ""
    w = V.work_fields(F.col("work"))
    known = F.col("work").isNotNull() & eligible_row
    d = d.withColumn("changes", F.when(known, field_changes(_work_pairs(w)))).withColumn(
        "rewrite_reasons", F.when(known, rewrite_reasons(w))).withColumn(
        "losses", F.when(known, metadata_losses([
            ("resolved_title", T.first_filled("resolved_title", "title_query"), w["title"]), ("authors", F.col("authors"), w["authors"]),
            ("year", F.col("year"), w["year"]), ("venue", F.col("venue"), w["venue"]), ("doi", F.col("doi"), w["doi"])])))
    lossy = F.coalesce(F.size("losses") > 0, F.lit(False))
    accepted = eligible_row & F.coalesce((F.col("decision") == "accepted") & (F.col("best_score") >= min_score), F.lit(False)) & ~lossy
    rewrite = F.coalesce(F.size("rewrite_reasons") > 0, F.lit(False))
    job = F.when(known, F.when(rewrite, "rewrite_entry").otherwise("enrich_existing_entry")).otherwise("")
    return d.select(
        *registry.columns,
        F.when(lossy & eligible_row, F.concat(F.lit("metadata_loss:"), F.array_join("losses", ","))).otherwise(
            F.col("skip_reason")).alias("skip_reason"),
        accepted.alias("accepted"),
        F.when(~eligible_row, "skip").when(accepted, "upgrade_to_crossref").otherwise("review_or_skip").alias("proposed_action"),
        F.when(eligible_row, F.col("best_doi")).alias("best_doi"), F.when(eligible_row, F.col("best_score")).alias("best_score"),
        job.alias("job_type"), F.coalesce("rewrite_reasons", F.array().cast("array<string>")).alias("rewrite_reasons"),
        F.coalesce("changes", F.create_map().cast("map<string,struct<current:string,proposed:string>>")).alias("changes"),
        (accepted & (F.lit(apply_rewrites) | ~rewrite)).alias("applies"), "work")


def apply_reconciliation(evaluated: DataFrame, registry_columns: list[str]) -> DataFrame:
    """Registry with the works metadata of all rows that the policy lets apply."""
    w = V.work_fields(F.col("work"))
    new = {"resolved_title": w["title"], "authors": w["authors"], "year": w["year"], "venue": w["venue"], "doi": w["doi"],
           "canonical_url": T.first_filled(w["url"], F.col("canonical_url")), "match_status": F.lit("matched_via_doi")}
    return evaluated.select(*[
        F.when(F.col("applies"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in registry_columns])
