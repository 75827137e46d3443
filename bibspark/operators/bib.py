"""Bibliography import, audit, representatives and export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import bibtex as B
from ..functions import names as N
from ..functions import nested as V
from ..functions import text as T
from .index import row_title
from .joins import spread_blank, unique_keys
from .quality import is_supplement
from ..session import materialize


def parse_entries(entries: DataFrame, recover: bool = False) -> DataFrame:
    """``entries(ord, raw)`` to ``(ord, entry_type, bibtex_key, fields, raw, error)``; a map, no shuffle.

    With ``recover`` a damaged entry keeps the fields that fill whole lines and has no error; only texts without an entry header fail.
    """
    # exploded: an entry is parsed once, not once more for a filter on its error
    return entries.select("ord", F.col("raw"), F.explode(F.array(B.parse_bib("raw", recover))).alias("p")).select(
        "ord", "p.entry_type", "p.bibtex_key", "p.fields", T.strip("raw").alias("raw"), "p.error")


def with_normalized(parsed: DataFrame) -> DataFrame:
    meta = B.normalized_metadata(F.col("fields"))
    return parsed.withColumn("normalized", F.struct(*[v.alias(k) for k, v in meta.items()]))


def dedupe_keys(parsed: DataFrame, keep: str = "last") -> DataFrame:
    """One entry per key: the first or the last in file order.  Aggregates map-side."""
    cols = F.struct(*[c for c in parsed.columns if c != "bibtex_key"])
    pick = F.max_by(cols, "ord") if keep == "last" else F.min_by(cols, "ord")
    return parsed.filter("error = ''").groupBy("bibtex_key").agg(pick.alias("e")).select(
        *[F.col("bibtex_key") if c == "bibtex_key" else F.col(f"e.{c}").alias(c) for c in parsed.columns])


def canonicalize(parsed: DataFrame) -> DataFrame:
    """Entry text in canonical form and the names of fields it leaves out."""
    meta = B.normalized_metadata(F.col("fields"))
    fields = B.preserved_fields("entry_type", F.col("fields"), meta)
    kept = parsed.select(
        "ord", "entry_type", "bibtex_key", B.ignored_fields("entry_type", F.col("fields")).alias("ignored_fields"),
        T.let(fields, lambda f: F.struct(f.alias("fields"), B.render_entry("entry_type", "bibtex_key", f).alias("raw"))).alias("e"))
    return kept.select("ord", "entry_type", "bibtex_key", "ignored_fields", "e.fields", "e.raw")


def audit(parsed: DataFrame) -> DataFrame:
    """Findings ``(kind, bibtex_key, ord, other_ord, detail)``.

    Parse errors, keys used again (with the first position), headers inside another entry, and text
    behind the last entry.
    """
    parsed = materialize(parsed.select("ord", "bibtex_key", "raw", "error"), "audited")  # five readers, one parse
    none = F.lit(None).cast("bigint")
    ord_ = F.col("ord").cast("bigint")
    errors = parsed.filter("error <> ''").select(
        F.lit("parse_error").alias("kind"), F.lit("").alias("bibtex_key"), ord_.alias("ord"), none.alias("other_ord"),
        F.substring_index("raw", "\n", 1).alias("detail"))
    good = parsed.filter("error = ''")
    firsts = good.groupBy("bibtex_key").agg(F.count("*").alias("n"), F.min("ord").alias("first")).filter("n > 1")
    from .joins import split_lookup
    again = split_lookup(good.select("bibtex_key", "ord"), firsts, "bibtex_key").filter("ord > first").select(
        F.lit("duplicate_key").alias("kind"), "bibtex_key", ord_.alias("ord"),
        F.col("first").cast("bigint").alias("other_ord"), F.lit("").alias("detail"))
    inner = F.regexp_instr(F.substring(F.col("raw"), F.lit(2), F.length("raw")), F.lit(r"@[A-Za-z0-9_:-]+\s*\{"))
    start = F.greatest(inner - 41, F.lit(0))
    context = F.replace(F.substring(F.col("raw"), start + 1, inner + 79 - start), F.lit("\n"), F.lit("\\n"))
    nested = parsed.filter(inner > 0).select(
        F.lit("embedded_header").alias("kind"), F.lit("").alias("bibtex_key"), ord_.alias("ord"), none.alias("other_ord"),
        context.alias("detail"))
    last = parsed.agg(F.max_by("raw", "ord").alias("raw"), F.max("ord").alias("ord")).filter(
        F.col("raw").isNotNull() & ~F.endswith(F.regexp_replace("raw", "\n+$", ""), F.lit("}")))
    trailing = last.select(F.lit("trailing_text").alias("kind"), F.lit("").alias("bibtex_key"), ord_.alias("ord"),
                           none.alias("other_ord"), F.lit("").alias("detail"))
    return errors.unionByName(again).unionByName(nested).unionByName(trailing)


# --- representative rows -----------------------------------------------------------------

def representatives(registry: DataFrame, records: DataFrame | None) -> DataFrame:
    """Registry row that speaks for each bibliography key: main papers first, then richer metadata."""
    rows = registry.filter(T.strip(T.blank("bibtex_key")) != "")
    if records is not None:
        extra = records.select("paper_id", V.abstract_of("bib").alias("abstract"),
                               F.struct("crossref.metadata", "manual_override.raw_bibtex").alias("record"))
        rows = rows.join(extra, "paper_id", "left").withColumn("abstract", T.blank("abstract"))
    elif "abstract" not in rows.columns:
        rows = rows.withColumn("abstract", F.lit(""))
    fields = ["resolved_title", "authors", "year", "venue", "doi", "canonical_url", "abstract"]
    richness = sum((F.when(T.strip(T.blank(f)) != "", 1).otherwise(0) for f in fields), F.lit(0))
    score = (F.when(is_supplement("bib"), 0).otherwise(100)
             + F.when(F.col("content_kind") == K.PDF_BACKED, 20).otherwise(0) + richness)
    key = T.strip("bibtex_key")
    order = F.struct(score, F.length("abstract"), F.length(T.blank("doi")), -F.col("row_ord"))
    cols = [c for c in rows.columns if c != "bibtex_key"]
    return (
        rows.groupBy(key.alias("bibtex_key"))
        .agg(F.max_by(F.struct(*cols, score.alias("representative_score")), order).alias("r"))
        .select("bibtex_key", "r.*"))


def rebuild_bibliography(registry: DataFrame, records: DataFrame, existing: DataFrame) -> DataFrame:
    """``(bibtex_key, entry_type, fields, raw)`` for every key in the registry.

    Original fields come from the record's manual entry, else from the existing entry with the key;
    normalised metadata of the representative row overwrites them.
    """
    reps = representatives(registry, records)
    first = dedupe_keys(existing, "first").select(
        "bibtex_key", F.col("entry_type").alias("old_type"), F.col("fields").alias("old_fields"))
    d = reps.join(first, "bibtex_key", "left")
    manual = F.when(T.blank("record.raw_bibtex") != "", B.parse_bib(T.blank("record.raw_bibtex")))
    d = d.withColumn("manual", manual)
    ok = F.coalesce((F.col("manual.error") == "") & (F.col("manual.bibtex_key") != ""), F.lit(False))
    entry_type = T.first_filled(F.when(ok, F.col("manual.entry_type")), F.when(~ok, F.col("old_type")),
                                T.blank("bibtex_type"), F.lit("article"))
    original = F.when(ok, F.col("manual.fields")).otherwise(F.col("old_fields"))
    work = V.work_fields(F.col("record.metadata"))
    meta = V.metadata_fields(row_title(), "authors", "year", "venue", "doi", "canonical_url", "abstract")
    d = d.withColumn("entry_type", entry_type)
    more = {n: T.blank(work[n]) for n in ("volume", "number", "pages", "publisher", "issn")}
    fields = B.preserved_fields("entry_type", original, meta, more)
    return d.withColumn("fields", fields).select(
        "bibtex_key", "entry_type", "fields", B.render_entry("entry_type", "bibtex_key", F.col("fields")).alias("raw"))


def abbreviate_journals(entries: DataFrame, journals: DataFrame, strip_dots: bool = False) -> DataFrame:
    """Replace the journal field by its citation abbreviation where the journal table has one."""
    short = (
        journals.select(T.strip(T.blank("journal")).alias("journal"),
                        T.strip(T.blank("citation_abbreviation")).alias("short"), "ord")
        .filter("journal <> '' and short <> ''").groupBy("journal").agg(F.max_by("short", "ord").alias("short")))
    name = T.strip(T.blank(F.try_element_at("fields", F.lit("journal"))))
    d = entries.withColumn("journal", spread_blank(name, F.col("bibtex_key"))).join(short, "journal", "left")
    new = F.replace("short", F.lit("."), F.lit("")) if strip_dots else F.col("short")
    fields = F.when(F.col("short").isNotNull(), B.overlay(F.col("fields"), F.create_map(F.lit("journal"), new))).otherwise(
        F.col("fields"))
    return d.withColumn("fields", fields).select(
        "bibtex_key", "entry_type", "fields", B.render_entry("entry_type", "bibtex_key", F.col("fields")).alias("raw"))


def citation_entries(entries: DataFrame, journals: DataFrame) -> DataFrame:
    """Entries for a citation processor: abbreviated journal (by canonical name) and ``and`` separated authors."""
    from .index import join_journals
    d = join_journals(entries.withColumn("_journal", T.blank(F.try_element_at("fields", F.lit("journal")))), journals, "_journal")
    author = N.authors_for_citeproc(T.first_filled(F.try_element_at("fields", F.lit("author")), "normalized.authors"))
    extra = F.create_map(F.lit("journal"), F.col("citation_abbreviation"), F.lit("author"), author)
    fields = B.clean_fields("entry_type", B.overlay(F.col("fields"), extra))
    return d.withColumn("fields", fields).select(
        "bibtex_key", "entry_type", "fields", B.render_entry("entry_type", "bibtex_key", F.col("fields")).alias("raw"))


def field_types_for_registry(registry: DataFrame, parsed: DataFrame) -> DataFrame:
    """Schema migration: bibliography type from the entry with the row's key, else from the item type."""
    types = dedupe_keys(parsed, "last").select("bibtex_key", F.col("entry_type").alias("_type"))
    d = registry.withColumn("_k", spread_blank(F.col("bibtex_key"), F.col("paper_id"))).join(
        types.withColumnRenamed("bibtex_key", "_k"), "_k", "left")
    fallback = T.first_filled("bibtex_type", F.when(F.col("item_type").isin("book", "article"), F.col("item_type"))
                              .otherwise("misc"))
    return d.withColumn("bibtex_type", F.coalesce("_type", fallback)).drop("_k", "_type")


# --- entry for a row ------------------------------------------------------------------------

def match_entries(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Bibliography entry of each ``rows(paper_id, existing_key, title, authors, year, doi)``.

    Existing key, else DOI (ties by title and year), else title and year (ties by author overlap),
    else title; every level needs a unique answer.  Adds ``entry_key``, ``entry_type``, ``matched_by``.
    """
    e = parsed.filter("error = ''")
    meta = B.normalized_metadata(F.col("fields"))
    e = e.select("ord", "bibtex_key", "entry_type", meta["doi"].alias("doi"), meta["authors"].alias("authors"),
                 T.normalize_title(meta["title"]).alias("t"), meta["year"].alias("y"))
    e = materialize(e, "entry_keys")        # read by every level, parsed once
    rows = materialize(rows.withColumn("_t", T.normalize_title("title")).withColumn("_d", T.normalize_doi("doi")), "match_rows")
    cat = lambda *cs: F.when(sum((F.when(c == "", 1).otherwise(0) for c in cs), F.lit(0)) == 0,
                             F.concat_ws("|", *cs)).otherwise("")
    t, y = F.col("t"), F.col("y")
    title_year = cat(t, y)
    doi_title_year = F.when((F.col("doi") != ""), F.concat_ws("|", "doi", t, y)).otherwise("")

    rt, ry, rd = F.col("_t"), T.strip(T.blank("year")), F.col("_d")
    by_key = e.filter("bibtex_key <> ''").groupBy(F.col("bibtex_key").alias("key")).agg(F.max("ord").alias("key_ord"))
    # author ties: per (title|year, token) the smallest and largest entry; equal over all tokens = one entry
    by_author = (
        e.filter(title_year != "").select(title_year.alias("ty"), "ord", F.explode(F.filter(
            T.informative_tokens("authors"), lambda w: F.length(w) >= 3)).alias("w"))
        .groupBy("ty", "w").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")))
    row_ty = cat(rt, ry)
    author_hits = (
        rows.filter(row_ty != "").select("paper_id", row_ty.alias("ty"), F.explode(F.filter(
            T.informative_tokens("authors"), lambda w: F.length(w) >= 3)).alias("w"))
        .join(by_author, ["ty", "w"]).groupBy("paper_id")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo = hi")
        .select("paper_id", F.col("lo").alias("author_ord")))
    title_year_level = unique_keys(e, title_year, "ord", "title_year_ord")
    levels = [
        ("key", T.strip(T.blank("existing_key")), by_key),
        ("doi", rd, unique_keys(e, F.col("doi"), "ord", "doi_ord")),
        ("doi_title", F.when(rd != "", F.concat_ws("|", rd, rt, ry)).otherwise(""),
         unique_keys(e, doi_title_year, "ord", "doi_title_ord")),
        ("title_year", row_ty, title_year_level),
        ("title", rt, unique_keys(e, t, "ord", "title_ord")),
    ]
    out = rows
    for _, key, right in levels:
        out = out.withColumn("key", spread_blank(key, F.col("paper_id"))).join(right, "key", "left").drop("key")
    out = out.join(author_hits, "paper_id", "left")
    order = ["key", "doi", "doi_title", "title_year", "author", "title"]
    by = F.lit("")
    for n in reversed(order):
        by = F.when(F.col(f"{n}_ord").isNotNull(), n).otherwise(by)
    chosen = out.withColumn("matched_by", by).withColumn("ord", F.coalesce(*[f"{n}_ord" for n in order])).drop(
        *[f"{n}_ord" for n in order])
    # rows without an entry get a negative filler, so they spread over all tasks
    chosen = chosen.withColumn("ord", F.coalesce("ord", -F.abs(F.xxhash64("paper_id")) - 1))
    return chosen.join(e.select("ord", F.col("bibtex_key").alias("entry_key"), F.col("entry_type")), "ord", "left").withColumn(
        "entry_key", T.blank("entry_key")).withColumn("entry_type", T.blank("entry_type")).drop("ord", "_t", "_d")
