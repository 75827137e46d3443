"""Registry maintenance as planned frames.

Every operator returns the new table and, where rows are refused or changed, an audit frame.
Nothing is written here; :mod:`bibspark.sources` writes a planned table when the caller applies it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import names as N
from ..functions import nested as V
from ..functions import parsing as P
from ..functions import text as T
from ..session import materialize
from .chunks import chunk_texts, stub_text
from .index import row_title, with_defaults
from .joins import spread_blank, split_lookup, unique_keys
from .linkage import connected_components
from .quality import filename_looks_bad, filename_looks_downloaded, filename_needs_touchup, is_supplement


def upsert(base: DataFrame, updates: DataFrame, key: str = "paper_id") -> DataFrame:
    """Replace rows with the same key, append the others.

    A replaced row keeps its ``row_ord``; new rows follow behind the largest one in update order.  Of
    several updates for one key the last one counts.
    """
    if "row_ord" in updates.columns:
        cols = [c for c in updates.columns if c != key]
        last_of = updates.groupBy(key).agg(F.max_by(F.struct(*cols), "row_ord").alias("_u"))
        updates = last_of.select(key, *[F.col(f"_u.`{c}`").alias(c) for c in cols])
    if "row_ord" not in base.columns:
        return base.join(updates.select(key), key, "left_anti").unionByName(updates.select(base.columns))
    old = base.select(key, F.col("row_ord").alias("_old"))
    last = base.agg(F.coalesce(F.max("row_ord"), F.lit(-1))).scalar()
    ord_ = F.coalesce(F.col("_old"), last + 1 + F.col("row_ord"))
    new = updates.join(old, key, "left").withColumn("row_ord", ord_).select(base.columns)
    return base.join(updates.select(key), key, "left_anti").unionByName(new)


def delete_rows(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("paper_id"), "paper_id", "left_anti")


def key_usage(registry: DataFrame, excluding: DataFrame | None = None) -> DataFrame:
    """``(bibtex_key, n)`` over the rows that stay."""
    rows = registry if excluding is None else delete_rows(registry, excluding)
    return (rows.select(T.clean_text("bibtex_key").alias("bibtex_key")).filter("bibtex_key <> ''")
            .groupBy("bibtex_key").agg(F.count("*").alias("n")))


@dataclass(frozen=True)
class Deletion:
    registry: DataFrame
    removed_keys: DataFrame      # bibliography keys no remaining row uses
    dependents: dict[str, DataFrame]


def delete_cascade(registry: DataFrame, ids: DataFrame, **tables: DataFrame) -> Deletion:
    """Drop rows, their dependent rows (records, texts, chunks) and the keys nobody uses any more."""
    gone = registry.join(ids.select("paper_id"), "paper_id", "left_semi")
    keys = gone.select(T.clean_text("bibtex_key").alias("bibtex_key")).filter("bibtex_key <> ''").distinct()
    unused = keys.join(key_usage(registry, ids), "bibtex_key", "left_anti")
    return Deletion(delete_rows(registry, ids), unused, {n: delete_rows(t, ids) for n, t in tables.items()})


# --- merge -------------------------------------------------------------------------

MERGED_FIELDS = ["resolved_title", "authors", "year", "venue", "doi", "semantic_scholar_paper_id", "match_confidence",
                 "match_status", "bibtex_type", "canonical_url", "bibtex_key", "abstract_source", "notes"]


def identity_signals(keep: str = "k", drop: str = "d") -> Column:
    """What two rows (structs) share: DOI, key, title and year, content hash."""
    def both(f) -> Column:
        a, b = f(F.col(keep)), f(F.col(drop))
        return (a != "") & (a == b)
    # a known title with both years empty still counts as the same title and year
    title_year = lambda r: F.when(T.normalize_title(T.first_filled(r["resolved_title"], r["title_query"])) == "", "")\
        .otherwise(F.concat_ws("|", T.normalize_title(T.first_filled(r["resolved_title"], r["title_query"])),
                               T.clean_text(r["year"])))
    return F.array_compact(F.array(
        F.when(both(lambda r: T.normalize_doi(r["doi"])), "same_doi"),
        F.when(both(lambda r: T.normalize_bib_key(r["bibtex_key"])), "same_bibtex_key"),
        F.when(both(title_year), "same_title_year"),
        F.when(both(lambda r: T.clean_text(r["pdf_sha256"])), "same_pdf_sha256")))


def _as_struct(df: DataFrame, name: str, id_name: str) -> DataFrame:
    extra = is_supplement("merge").alias("supplement")
    return df.select(F.col("paper_id").alias(id_name), F.struct(*df.columns, extra).alias(name))


@dataclass(frozen=True)
class Merge:
    registry: DataFrame
    refused: DataFrame           # keep_id, drop_id, reason
    merged: DataFrame            # keep_id, drop_id, signals


def merge_pairs(registry: DataFrame, pairs: DataFrame, force: bool = False) -> Merge:
    """Merge ``pairs(keep_id, drop_id)``: blanks of the kept row are filled, dropped rows disappear.

    Refused are pairs of a row with itself, pairs that share nothing, supplements dropped into a main paper, all but the
    first keeper of a row that is dropped twice (``already_dropped``), and, where pairs run in a circle, the pair that
    drops the circle's first row (``keep_is_dropped``).  Chains end in one survivor: the row that no pair drops.  The
    survivor of several rows is filled from them in row order; it always stays, so no value is lost.
    """
    j = pairs.distinct().join(_as_struct(registry, "k", "keep_id"), "keep_id", "left").join(
        _as_struct(registry, "d", "drop_id"), "drop_id", "left")
    reason = F.when(F.col("keep_id") == F.col("drop_id"), "same_row").when(
        F.col("k").isNull() | F.col("d").isNull(), "unknown_row")
    if not force:
        reason = reason.when(F.size("signals") == 0, "no_shared_identity").when(
            F.col("d.supplement") & ~F.col("k.supplement"), "drop_is_supplement")
    j = j.withColumn("signals", identity_signals()).withColumn("reason", reason)
    j = materialize(j.select("keep_id", "drop_id", "signals", "reason", F.col("k.row_ord").alias("keep_ord"), F.col("d.row_ord").alias("drop_ord")), "pairs")
    # one keeper for each dropped row: the first in row order
    good = j.filter("reason is null")
    keeper = good.groupBy("drop_id").agg(F.min_by("keep_id", F.struct("keep_ord", "keep_id")).alias("first_keep"))
    good = good.join(keeper, "drop_id")
    twice = good.filter("keep_id <> first_keep").select("keep_id", "drop_id", F.lit("already_dropped").alias("reason"))
    good = materialize(good.filter("keep_id = first_keep").drop("first_keep"), "merge-pairs")
    if good.join(good.select(F.col("drop_id").alias("keep_id")), "keep_id", "left_semi").isEmpty():
        groups = good.withColumn("survivor_ord", F.col("keep_ord"))  # no row is both kept and dropped
    else:
        # one survivor for each connected group: the row that is never dropped, else the first
        members = connected_components(good.select(F.col("keep_ord").alias("a"), F.col("drop_ord").alias("b")))
        dropped = good.select(F.col("drop_ord").alias("node"), F.lit(True).alias("goes"))
        survivor = members.join(dropped, "node", "left").groupBy("component").agg(
            F.coalesce(F.min(F.when(F.col("goes").isNull(), F.col("node"))), F.min("node")).alias("survivor_ord"))
        groups = materialize(good.join(members.withColumnRenamed("node", "drop_ord"), "drop_ord").join(survivor, "component"), "merge-groups")
    circle = groups.filter("drop_ord = survivor_ord").select("keep_id", "drop_id", F.lit("keep_is_dropped").alias("reason"))
    groups = groups.filter("drop_ord <> survivor_ord")
    # first filled value over the dropped rows, field by field; constant-size aggregates
    source = groups.select("drop_ord", "survivor_ord").join(registry.withColumnRenamed("row_ord", "drop_ord"), "drop_ord")
    firsts = [F.min_by(T.clean_text(c), F.when(T.clean_text(c) != "", F.col("drop_ord"))).alias(f"_{c}") for c in MERGED_FIELDS]
    fill = source.groupBy(F.col("survivor_ord").alias("row_ord")).agg(*firsts)
    kept = delete_rows(registry, groups.select(F.col("drop_id").alias("paper_id"))).join(fill, "row_ord", "left")
    # a row that stays as it is keeps even its "no value" words
    value = lambda c: F.when(T.clean_text(c) != "", F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c)))
    out = kept.select(*[value(c).alias(c) if c in MERGED_FIELDS else F.col(c) for c in registry.columns])
    refused = j.filter("reason is not null").select("keep_id", "drop_id", "reason").unionByName(twice).unionByName(circle)
    names = registry.select(F.col("row_ord").alias("survivor_ord"), F.col("paper_id").alias("survivor_id"))
    return Merge(out, refused, groups.join(names, "survivor_ord").select(F.col("survivor_id").alias("keep_id"), "drop_id", "signals"))


def merge_records(records: DataFrame, merged: DataFrame, timestamp: Column | None = None, deleted_pdf: bool = False) -> DataFrame:
    """Records after a merge: blanks of the kept record are filled, and each dropped row leaves an event that names it and what it shared."""
    drop = merged.join(records.select(F.col("paper_id").alias("drop_id"), F.struct(*records.columns).alias("d")),
                       "drop_id", "left")
    filled = lambda c: F.when(T.clean_text(F.col(f"d.{c}")) != "", F.col("drop_id"))
    scalars = ["title_query", "match_status", "metadata_source", "item_type"]
    aggs = [F.min_by(F.col(f"d.{c}"), filled(c)).alias(f"_{c}") for c in scalars]
    for c in ("manual_override", "semantic_scholar", "crossref", "match_confidence", "warnings", "crossref_warnings"):
        aggs.append(F.min_by(F.col(f"d.{c}"), F.when(F.col(f"d.{c}").isNotNull(), F.col("drop_id"))).alias(f"_{c}"))
    at = timestamp if timestamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    event = F.struct(F.lit("dedup_keep").alias("action"), at.alias("timestamp"), F.col("drop_id").alias("merged_from_paper_id"),
                     F.col("signals").alias("identity_signals"), F.lit(deleted_pdf).alias("deleted_drop_pdf"))
    # a record holds the list of its own events
    events = drop.groupBy(F.col("keep_id").alias("paper_id")).agg(*aggs, F.array_sort(F.collect_list(F.struct("drop_id", event.alias("e")))).alias("_events"))
    kept = records.join(merged.select(F.col("drop_id").alias("paper_id")), "paper_id", "left_anti").join(
        events, "paper_id", "left")
    no_manual = F.col("manual_override").isNull() | (T.clean_text("manual_override.raw_bibtex") == "")
    new = {c: F.when(T.clean_text(c) != "", F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))) for c in scalars}
    new["manual_override"] = F.when(no_manual, F.coalesce("_manual_override", "manual_override")).otherwise(
        F.col("manual_override"))
    for c in ("semantic_scholar", "crossref", "match_confidence", "warnings", "crossref_warnings"):
        new[c] = F.coalesce(c, f"_{c}")
    new["maintenance"] = F.when(F.col("_events").isNotNull(), F.concat(
        F.coalesce("maintenance", F.array()), F.transform("_events", lambda x: x["e"]))).otherwise(F.col("maintenance"))
    return kept.select(*[new.get(c, F.col(c)).alias(c) for c in records.columns])


@dataclass(frozen=True)
class MergedLibrary:
    registry: DataFrame
    bibliography: DataFrame
    records: DataFrame
    texts: DataFrame
    chunks: DataFrame
    files: DataFrame             # pdf_path of dropped rows, to delete
    log: DataFrame               # keep_id, drop_id, signals, removed_key, warning
    refused: DataFrame           # keep_id, drop_id, reason


def merge_library(registry: DataFrame, pairs: DataFrame, bibliography: DataFrame, records: DataFrame, texts: DataFrame, chunks: DataFrame,
                  force: bool = False, delete_pdf: bool = False, timestamp: Column | None = None) -> MergedLibrary:
    """A merge with everything that hangs on the dropped rows.

    Their records, texts and chunks go, and the bibliography entry of their key goes when no row of the merged registry uses it.
    The kept rows' records name what they took in.  Files of dropped rows are listed for deletion with ``delete_pdf``; else the log warns
    that they stay.  Nothing is deleted here.
    """
    m = merge_pairs(registry, pairs, force)
    merged = materialize(m.merged, "merged")
    rows = materialize(m.registry, "merged-registry")
    dropped = merged.select(F.col("drop_id").alias("paper_id"))
    gone = materialize(registry.join(dropped, "paper_id", "left_semi").select(
        F.col("paper_id").alias("drop_id"), T.clean_text("bibtex_key").alias("key"), T.clean_text("pdf_path").alias("pdf_path"), "content_kind"), "dropped-rows")
    unused = gone.select(F.col("key").alias("bibtex_key")).filter("bibtex_key <> ''").distinct().join(key_usage(rows), "bibtex_key", "left_anti")
    stays = (F.col("content_kind") == K.PDF_BACKED) & (F.col("pdf_path") != "")
    warning = F.lit("") if delete_pdf else F.when(stays, "the file of the dropped row stays without a row").otherwise("")
    removed = unused.select(F.col("bibtex_key").alias("key"), F.col("bibtex_key").alias("removed_key"))
    log = merged.join(gone, "drop_id").join(removed, "key", "left").select(
        "keep_id", "drop_id", "signals", F.coalesce("removed_key", F.lit("")).alias("removed_key"), warning.alias("warning"))
    files = gone.filter(F.lit(delete_pdf) & (F.col("pdf_path") != "")).select("pdf_path").distinct()
    return MergedLibrary(rows, bibliography.join(unused, "bibtex_key", "left_anti"), merge_records(records, merged, timestamp, delete_pdf),
                         delete_rows(texts, dropped), delete_rows(chunks, dropped), files, log, m.refused)


# --- links, overrides, moves ---------------------------------------------------------

def link_supplements(registry: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``links(child_id, parent_id)`` take over their parent's citation; the DOI is cleared."""
    parent = registry.select(F.col("paper_id").alias("parent_id"), F.struct(
        row_title().alias("title"), "authors", "year", "venue", "canonical_url", "bibtex_key").alias("p"))
    link = links.join(parent, "parent_id").select(F.col("child_id").alias("paper_id"), "p")
    d = registry.join(link, "paper_id", "left")
    linked = F.col("p").isNotNull()
    new = {"resolved_title": F.col("p.title"), "title_query": F.col("p.title"), "authors": F.col("p.authors"),
           "year": F.col("p.year"), "venue": F.col("p.venue"), "doi": F.lit(""),
           "match_status": F.lit("matched_supplement"), "canonical_url": F.col("p.canonical_url"),
           "bibtex_key": F.col("p.bibtex_key"), "abstract_source": F.lit("")}
    return d.select(*[F.when(linked, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                      for c in registry.columns])


def apply_overrides(registry: DataFrame, overrides: DataFrame, status: str = "manual_verified") -> DataFrame:
    """Verified metadata replaces a row's metadata; notes are appended and a key is minted when none exists."""
    names = ["title", "authors", "year", "venue", "doi", "url", "abstract", "bibtex_key", "source_note"]
    o = overrides.select("paper_id", F.struct(*[T.blank(n).alias(n) for n in names]).alias("o"))
    d = registry.join(o, "paper_id", "left")
    minted = N.bib_key("o.authors", "o.year", "o.title", N.file_stem("filename"))
    notes = F.array_join(F.filter(F.array(T.strip("notes"), T.strip("o.source_note")), lambda n: n != ""), " | ")
    new = {"resolved_title": F.col("o.title"), "authors": F.col("o.authors"), "year": F.col("o.year"),
           "venue": F.col("o.venue"), "doi": F.col("o.doi"), "match_status": F.lit(status),
           "bibtex_type": T.first_filled("bibtex_type", F.lit("article")),
           "canonical_url": T.first_filled("o.url", "canonical_url"),
           "bibtex_key": T.first_filled(T.strip("o.bibtex_key"), "bibtex_key", minted),
           "abstract_source": F.when(F.col("o.abstract") != "", "manual_verified").otherwise(""), "notes": notes}
    hit = F.col("o").isNotNull()
    return d.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                      for c in registry.columns])


def move_paths(registry: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``moves(paper_id, new_path)`` to the planned registry and an audit of every move.

    Only rows with text move; a path another row holds is refused.
    """
    wanted = moves.join(registry.select("paper_id", "pdf_path", "content_kind"), "paper_id", "left")
    taken = registry.select(F.col("pdf_path").alias("new_path")).filter("new_path <> ''").distinct().withColumn(
        "taken", F.lit(True))
    wanted = wanted.join(taken, "new_path", "left")
    status = (F.when(F.col("content_kind").isNull(), "unknown_row")
              .when((F.col("content_kind") != K.PDF_BACKED) | (F.col("pdf_path") == ""), "no_tracked_file")
              .when(F.col("taken"), "destination_exists").otherwise("planned"))
    audit = wanted.select("paper_id", F.col("pdf_path").alias("from_path"), F.col("new_path").alias("to_path"),
                          status.alias("status"))
    go = audit.filter("status = 'planned'").select("paper_id", "to_path")
    d = registry.join(go, "paper_id", "left")
    new = {"pdf_path": F.coalesce("to_path", "pdf_path"),
           "filename": F.coalesce(N.base_name("to_path"), F.col("filename"))}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in registry.columns]), audit


def resolve_incoming_duplicates(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(paper_id, action, new_path)``: ``use_new_path`` repoints the row, ``delete_new_file`` keeps it."""
    moved = decisions.filter("action = 'use_new_path'").select("paper_id", F.col("new_path").alias("to_path"))
    d = registry.join(moved, "paper_id", "left")
    new = {"pdf_path": F.coalesce("to_path", "pdf_path"),
           "filename": F.coalesce(N.base_name("to_path"), F.col("filename"))}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in registry.columns])


def untracked(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``files(path)`` that no registry row tracks; paths compare case-insensitively."""
    known = registry.filter("pdf_path <> ''").select(F.lower("pdf_path").alias("_p"))
    return (
        files.withColumn("_p", F.lower("path")).join(known, "_p", "left_anti").drop("_p")
        .filter(F.endswith(F.lower("path"), F.lit(".pdf")) & ~F.startswith(N.base_name("path"), F.lit("."))
                & ~F.contains("path", F.lit("/temp_uploads/")))
        .withColumn("filename", N.base_name("path"))
        .withColumn("folder", F.when(F.col("path").rlike("^[^/]+/[^/]+$"), ".").otherwise(
            F.regexp_extract("path", "^[^/]+/(.*)/[^/]+$", 1))))


def not_indexed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``files(path, sha256)`` whose path and whose content are both unknown: two anti joins."""
    clean = lambda c: F.regexp_replace(F.lower(c), "^/+|/+$", "")
    paths = registry.filter("pdf_path <> ''").select(clean(F.col("pdf_path")).alias("_p"))
    hashes = registry.filter("pdf_sha256 <> ''").select(F.col("pdf_sha256").alias("sha256"))
    return (files.withColumn("_p", clean(F.col("path"))).join(paths, "_p", "left_anti").drop("_p")
            .join(hashes, "sha256", "left_anti"))


# --- bulk additions ---------------------------------------------------------------------

def add_references(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows for ``incoming(ord, s2_id, title, authors, year, venue, doi, url, abstract, bibtex_key, bibtex_type)``.

    A uniquely matching row is updated and keeps its id, key and files; otherwise an id is minted.
    Returns update rows for :func:`upsert`; of several items for one id the last one stays.
    """
    from .resolve import match_existing

    keyed = incoming.withColumn("paper_id", F.col("ord").cast("string"))
    m = match_existing(keyed, registry).withColumnRenamed("matched_id", "existing_id")
    old_cols = ["bibtex_type", "bibtex_key", "content_kind", "text_path", "chunk_path", "item_type", "pdf_path",
                "pdf_sha256", "filename"]
    old = registry.select(F.col("paper_id").alias("existing_id"), F.struct(*old_cols).alias("x"))
    m = m.withColumn("existing_id", spread_blank(F.col("existing_id"), F.col("paper_id"))).join(old, "existing_id", "left")
    x = lambda c: T.blank(F.col(f"x.{c}"))
    meta = V.metadata_fields("title", "authors", "year", "venue", "doi", "url", "abstract")
    minted = N.reference_id("s2_id", meta["doi"], meta["title"], meta["year"], meta["authors"], meta["venue"])
    pid = F.when(F.col("x").isNotNull(), F.col("existing_id")).otherwise(minted)
    btype = T.first_filled(x("bibtex_type"), T.blank("bibtex_type"), F.lit("article"))
    kind = T.first_filled(x("content_kind"), F.lit(K.REFERENCE_ONLY))
    is_ref = kind == K.REFERENCE_ONLY
    rows = m.select(
        pid.alias("paper_id"), T.first_filled(x("item_type"), F.when(btype == "book", "book").otherwise("article")).alias("item_type"),
        kind.alias("content_kind"), x("pdf_path").alias("pdf_path"), x("pdf_sha256").alias("pdf_sha256"),
        x("filename").alias("filename"), T.blank("title").alias("title_query"), meta["title"].alias("resolved_title"),
        meta["authors"].alias("authors"), meta["year"].alias("year"), meta["venue"].alias("venue"),
        meta["doi"].alias("doi"), T.strip(T.blank("s2_id")).alias("semantic_scholar_paper_id"),
        F.lit("manual_verified").alias("match_status"), btype.alias("bibtex_type"), meta["url"].alias("canonical_url"),
        T.first_filled(x("bibtex_key"), T.blank("bibtex_key"),
                       N.bib_key(meta["authors"], meta["year"], meta["title"], F.lit("reference"))).alias("bibtex_key"),
        F.when(is_ref, F.concat(F.lit("text/"), pid, F.lit(".txt"))).otherwise(x("text_path")).alias("text_path"),
        F.when(is_ref, F.concat(F.lit("chunks/"), pid, F.lit(".jsonl"))).otherwise(x("chunk_path")).alias("chunk_path"),
        F.when(meta["abstract"] != "", "manual_verified").otherwise("").alias("abstract_source"),
        F.col("ord").alias("row_ord"), meta["abstract"].alias("_abstract"))
    cols = [c for c in rows.columns if c != "paper_id"]
    last = rows.groupBy("paper_id").agg(F.max_by(F.struct(*cols), "row_ord").alias("r")).select("paper_id", "r.*")
    return with_defaults(last)


def reference_stubs(added: DataFrame) -> DataFrame:
    """``(paper_id, text)`` stand-in documents of added rows without text."""
    return added.filter(F.col("content_kind") == K.REFERENCE_ONLY).select(
        "paper_id", stub_text("resolved_title", "authors", "year", "venue", "doi", "canonical_url", "_abstract",
                              "bibtex_key").alias("text"))


@dataclass(frozen=True)
class FileAddition:
    rows: DataFrame              # update rows for upsert
    chunks: DataFrame
    skipped: DataFrame           # path, duplicate_of, reason


def add_files(registry: DataFrame, incoming: DataFrame, target: int = K.CHUNK_CHARS,
              overlap: int = K.CHUNK_OVERLAP) -> FileAddition:
    """Add ``incoming(ord, path, text, s2_id, title, authors, year, venue, doi, url)`` items with text.

    Ids come from the content hash.  Known content, known paths and matches to rows with text are
    skipped; a matching reference row is upgraded and keeps its id and key.  Of several new items
    with the same content the first stays.
    """
    from .resolve import match_existing

    d = incoming.withColumn("sha256", F.sha2("text", 256)).withColumn("paper_id", F.col("ord").cast("string"))
    first = d.groupBy("sha256").agg(F.min("ord").alias("first_ord"))
    d = split_lookup(d, first, "sha256")
    hashes = registry.filter("pdf_sha256 <> '' and content_kind = 'pdf_backed'").groupBy(
        F.col("pdf_sha256").alias("sha256")).agg(F.min_by("paper_id", "row_ord").alias("hash_id"))
    paths = registry.filter("pdf_path <> ''").groupBy(F.col("pdf_path").alias("path")).agg(
        F.min_by("paper_id", "row_ord").alias("path_id"))
    d = match_existing(d.drop("text"), registry).join(hashes, "sha256", "left").join(paths, "path", "left")
    rows = registry.select(F.col("paper_id").alias("matched_id"), F.struct(
        "content_kind", "bibtex_key", "bibtex_type").alias("x"))
    d = d.withColumn("matched_id", spread_blank(F.col("matched_id"), F.col("paper_id"))).join(rows, "matched_id", "left")
    reason = (F.when(F.col("hash_id").isNotNull(), "known_content").when(F.col("path_id").isNotNull(), "known_path")
              .when(F.col("x.content_kind") == K.PDF_BACKED, "matches_row_with_text")
              .when(F.col("ord") > F.col("first_ord"), "repeated_content"))
    d = d.withColumn("reason", reason)
    skipped = d.filter("reason is not null").select(
        "path", T.blank(F.coalesce("hash_id", "path_id", F.when(F.col("x").isNotNull(), F.col("matched_id")))).alias("duplicate_of"),
        "reason")
    new = d.filter("reason is null")
    pid = F.when(F.col("x.content_kind") == K.REFERENCE_ONLY, F.col("matched_id")).otherwise(N.content_id("sha256"))
    new = new.withColumn("item", P.item_type("path")).withColumn("pid", pid)
    filename = N.base_name("path")
    btype = T.first_filled(T.blank("x.bibtex_type"), F.when(F.col("item") == "book", "book").otherwise("article"))
    built = new.select(
        F.col("pid").alias("paper_id"), F.col("item").alias("item_type"), F.lit(K.PDF_BACKED).alias("content_kind"),
        F.col("path").alias("pdf_path"), F.col("sha256").alias("pdf_sha256"), filename.alias("filename"),
        T.blank("title").alias("title_query"), T.blank("title").alias("resolved_title"), T.blank("authors").alias("authors"),
        T.blank("year").alias("year"), T.blank("venue").alias("venue"), T.blank("doi").alias("doi"),
        T.blank("s2_id").alias("semantic_scholar_paper_id"), F.lit("manual_verified").alias("match_status"),
        btype.alias("bibtex_type"), T.blank("url").alias("canonical_url"),
        T.first_filled(T.blank("x.bibtex_key"), N.bib_key("authors", "year", "title", N.file_stem(filename))).alias("bibtex_key"),
        F.concat(F.lit("text/"), "pid", F.lit(".txt")).alias("text_path"),
        F.concat(F.lit("chunks/"), "pid", F.lit(".jsonl")).alias("chunk_path"),
        F.col("ord").alias("row_ord"))
    cols = [c for c in built.columns if c != "paper_id"]
    built = built.groupBy("paper_id").agg(F.min_by(F.struct(*cols), "row_ord").alias("r")).select("paper_id", "r.*")
    texts = incoming.select("ord", "text").join(
        built.select("paper_id", F.col("row_ord").alias("ord")), "ord").select("paper_id", "text")
    return FileAddition(with_defaults(built), chunk_texts(texts, target, overlap), skipped)


# --- rename plan ----------------------------------------------------------------------------

def journal_file_names(journals: DataFrame | None, spark) -> DataFrame:
    """``(venue, abbrev)``: journal table first, the built-in abbreviations for the rest."""
    builtin = spark.createDataFrame(list(K.FILE_ABBREVIATIONS.items()), "venue string, abbrev string").withColumn(
        "level", F.lit(1)).withColumn("ord", F.lit(0).cast("bigint"))
    if journals is None:
        return builtin.select("venue", "abbrev")
    over = F.create_map(*[F.lit(x) for kv in K.FILE_ABBREVIATION_OVERRIDES.items() for x in kv])
    cite = T.strip(T.blank("citation_abbreviation"))
    short = F.regexp_replace(N.safe_fragment(cite), r"[ .]", "")
    table = journals.select(
        T.strip(T.blank("journal")).alias("venue"),
        T.first_filled(T.strip(T.blank("filename_abbreviation")), F.try_element_at(over, cite), short).alias("abbrev"),
        F.lit(2).alias("level"), F.col("ord").cast("bigint").alias("ord")).filter("venue <> '' and abbrev <> ''")
    return builtin.unionByName(table).groupBy("venue").agg(
        F.max_by("abbrev", F.struct("level", "ord")).alias("abbrev"))


def with_canonical_name(registry: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Add ``target_name`` (``Author YEAR Journal - Title.pdf``); null when status, year or title is missing."""
    d = registry.withColumn("_venue", T.strip(T.blank("venue"))).join(
        abbreviations.withColumnRenamed("venue", "_venue"), "_venue", "left")
    year, name = T.clean_text("year"), T.blank("filename")
    behind = F.substring(name, F.call_function("locate", year, name) + F.length(year), F.length(name))
    token = F.replace(N.safe_fragment(F.regexp_replace(F.substring_index(behind, " - ", 1), r"^[ _\-]+|[ _\-]+$", "")),
                      F.lit(" "), F.lit(""))
    from_name = F.when((year != "") & F.contains(name, year) & F.contains(behind, F.lit(" - "))
                       & F.length(token).between(2, 18), token)
    compact = F.substring(F.replace(N.safe_fragment("_venue"), F.lit(" "), F.lit("")), 1, 24)
    journal = F.coalesce("abbrev", from_name, F.nullif(compact, F.lit("")), F.lit("UnknownJournal"))
    title = T.first_filled(T.strip(T.blank("resolved_title")), T.strip(T.blank("title_query")))
    target = F.concat(N.filename_surname("authors"), F.lit(" "), year, F.lit(" "), journal, F.lit(" - "),
                      N.safe_fragment(title), N.supplement_suffix("filename"), F.lit(".pdf"))
    ready = F.col("match_status").isin(K.RESOLVED_STATUSES) & (year != "") & (title != "")
    return d.withColumn("target_name", F.when(ready, target)).drop("_venue", "abbrev")


def rename_plan(registry: DataFrame, abbreviations: DataFrame, *, bad_only: bool = False, downloaded_only: bool = False,
                touchup_only: bool = False, min_chars: int = 20) -> DataFrame:
    """``(paper_id, current_path, target_path)`` with ``(2)``, ``(3)`` … behind colliding names."""
    from .joins import rank_within

    d = with_canonical_name(registry.filter(F.startswith("pdf_path", F.lit("articles/"))), abbreviations)
    d = d.filter(F.col("target_name").isNotNull() & (F.col("target_name") != N.base_name("pdf_path")))
    for wanted, test in ((bad_only, filename_looks_bad(min_chars)), (downloaded_only, filename_looks_downloaded()),
                         (touchup_only, filename_needs_touchup(min_chars))):
        if wanted:
            d = d.filter(test)
    target = F.concat(F.regexp_replace("pdf_path", "[^/]*$", ""), F.col("target_name"))
    d = d.select("paper_id", "row_ord", F.col("pdf_path").alias("current_path"), target.alias("target"))
    # names that rows outside the plan (or earlier in it) already hold count as taken
    held = registry.filter("pdf_path <> ''").groupBy(F.col("pdf_path").alias("target")).agg(F.lit(1).alias("held"))
    ranked = rank_within(split_lookup(d, held, "target"), ["target"], [F.col("row_ord")], "n")
    n = F.col("n") + F.coalesce("held", F.lit(0))
    return ranked.select("paper_id", "current_path", F.when(n == 1, F.col("target")).otherwise(F.concat(
        F.regexp_replace("target", r"\.pdf$", ""), F.lit(" ("), n.cast("string"), F.lit(").pdf"))).alias("target_path"))


# --- journal normalisation ---------------------------------------------------------------------

def normalize_venues(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry with canonical venues and the number of changed rows."""
    new = T.normalize_venue("venue")
    changed = registry.agg(F.count_if(new != F.col("venue")).alias("changed"))
    return registry.withColumn("venue", new), changed


def dedupe_journals(journals: DataFrame) -> DataFrame:
    """One row per journal (case-insensitive, canonical name); the first row with a file abbreviation stays."""
    name = T.normalize_venue("journal")
    has = T.strip(T.blank("filename_abbreviation")) != ""
    cols = ["filename_abbreviation", "citation_abbreviation", "citation_source"]
    d = journals.withColumn("journal", name)
    return (d.groupBy(T.casefold("journal").alias("k"))
            .agg(F.max_by(F.struct("journal", *cols), F.struct(has, -F.col("ord"))).alias("r"))
            .select("r.*").orderBy(F.lower("journal")))


def normalize_bib_journals(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with canonical journal names and the number of changed entries."""
    old = T.blank(F.try_element_at("fields", F.lit("journal")))
    new = T.normalize_venue(old)
    changed = parsed.agg(F.count_if(new != old).alias("changed"))
    return parsed.withColumn("fields", F.transform_values(
        "fields", lambda k, v: F.when(k == "journal", T.normalize_venue(v)).otherwise(v))), changed


def link_new_supplements(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows for new supplement files ``incoming(ord, path, text, parent_id)``; use with :func:`upsert`.

    Metadata comes from the parent, the id from the content, the DOI stays empty.
    """
    parent = registry.select(F.col("paper_id").alias("parent_id"), F.struct(
        row_title().alias("title"), "authors", "year", "venue", "bibtex_type", "canonical_url", "bibtex_key").alias("p"))
    d = incoming.select("ord", "path", "parent_id", F.sha2("text", 256).alias("sha256")).join(parent, "parent_id")
    pid, name = N.content_id("sha256"), N.base_name("path")
    return with_defaults(d.select(
        pid.alias("paper_id"), P.item_type("path").alias("item_type"), F.lit(K.PDF_BACKED).alias("content_kind"),
        F.col("path").alias("pdf_path"), F.col("sha256").alias("pdf_sha256"), name.alias("filename"),
        N.file_stem(name).alias("title_query"), T.first_filled("p.title", F.lit("Untitled")).alias("resolved_title"),
        *[F.col(f"p.{c}").alias(c) for c in ("authors", "year", "venue", "bibtex_type", "canonical_url", "bibtex_key")],
        F.lit("matched_supplement").alias("match_status"), F.concat(F.lit("text/"), pid, F.lit(".txt")).alias("text_path"),
        F.concat(F.lit("chunks/"), pid, F.lit(".jsonl")).alias("chunk_path"), F.col("ord").alias("row_ord")))
