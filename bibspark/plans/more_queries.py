"""Further registered queries: round trips through the sources, listings, and functions without a query of their own."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources as SRC
from ..functions import names as N
from ..functions import nested as NV
from ..functions import parsing as P
from ..functions import text as T
from ..functions import bibtex as BX
from ..operators import accept, bib, linkage, maintain, quality, query_table, search
from ..session import scratch_path
from . import sql as S
from . import views as V
from .queries import _BIBSUP, _BIBV, _DOIS, _PAIRS, _PLANTED, _RECON, _SIGNALS, _SUPP_MERGE, _WORKT, MANY, ORACLES, _dups, _facts, _neighbours, _parsed, joined, query, search_index

# --- sources ---------------------------------------------------------------------------------


@query("registry_round_trip", S.with_registry("SELECT paper_id, resolved_title, notes, year, doi, row_ord FROM registry"))
def registry_round_trip(spark, sf):
    """Export as TSV and import again; rows are numbered in file order."""
    out = scratch_path(spark, "registry-tsv")
    SRC.write_registry_tsv(V.registry(spark, sf), out)
    return SRC.read_registry_tsv(spark, out).select("paper_id", "resolved_title", "notes", "year", "doi", "row_ord")


@query("bibliography_round_trip", S.with_registry("""SELECT bibtex_key, CASE WHEN row_ord % 8 = 1 THEN 'book' ELSE 'article' END AS entry_type, '' AS error
  FROM registry WHERE bibtex_key <> ''"""))
def bibliography_round_trip(spark, sf):
    out = scratch_path(spark, "bibliography")
    SRC.write_bibliography(bib.parse_entries(V.bib_entries(spark, sf)), out)
    return bib.parse_entries(SRC.read_bibliography(spark, out)).select("bibtex_key", "entry_type", "error")


@query("journals_round_trip", S.with_registry("""SELECT journal, count(*) AS n FROM (SELECT DISTINCT CASE WHEN row_ord % 3 = 0 THEN upper(venue) ELSE venue END AS journal
  FROM registry WHERE venue <> '') GROUP BY journal"""))
def journals_round_trip(spark, sf):
    from ..sources.tables import TSV, read_journals
    out = scratch_path(spark, "journals")
    options = {k: v for k, v in TSV.items() if k != "multiLine"}
    V.journals(spark, sf).drop("ord").write.options(**options).csv(out)
    return read_journals(spark, out).groupBy("journal").agg(F.count("*").alias("n"))


@query("audit_log", S.with_registry("SELECT 'refused' AS action, paper_id, year FROM registry WHERE year = 'n/a'"))
def audit_log(spark, sf):
    from ..sources.tables import append_log
    out = scratch_path(spark, "log")
    append_log(V.registry(spark, sf).filter("year = 'n/a'").select("paper_id", "year"), out, "refused")
    return spark.read.schema("action string, payload struct<paper_id:string,year:string>").json(out).select("action", "payload.paper_id", "payload.year")


# --- filters and listings ----------------------------------------------------------------------

@query("filter_doi", S.with_registry(f"SELECT paper_id, title_query FROM registry WHERE {S.doi('doi')} = '10.1234/abc.000102'"))
def filter_doi(spark, sf):
    rows = search.rank_rows(search_index(spark, sf), "", search.Filters(doi="https://doi.org/10.1234/ABC.000102"))
    return rows.select("paper_id").join(V.registry(spark, sf).select("paper_id", "title_query"), "paper_id")


@query("filter_reference_only", S.with_registry("SELECT paper_id FROM registry WHERE content_kind = 'reference_only'"))
def filter_reference_only(spark, sf):
    return search.rank_rows(search_index(spark, sf), "", search.Filters(reference_only=True)).select("paper_id")


@query("listing_by_year", S.with_registry("""SELECT paper_id, year FROM registry
  ORDER BY coalesce(try_cast(regexp_extract(year, '^[ ]*([+-]?[0-9]+)', 1) AS INT), 0) DESC, row_ord LIMIT 50"""))
def listing_by_year(spark, sf):
    return search.sort_listing(V.registry(spark, sf), "year", ascending=False).limit(50).select("paper_id", "year")


@query("clusters_in_report_order", _dups("SELECT component, size FROM classified ORDER BY size DESC, component LIMIT 20"))
def clusters_in_report_order(spark, sf):
    """Largest clusters first; ``first_ord`` is the cluster's smallest row, as ``component`` is."""
    _, facts = _facts(spark, sf)
    return linkage.order_clusters(linkage.classify_clusters(facts)).limit(20).select("component", "size")


@query("outcome_counts", S.with_registry(f"""SELECT count(*) AS total, count(*) FILTER ({S.doi('doi')} <> '') AS with_doi, count(*) FILTER (match_status = 'not_found') AS not_found
  FROM registry"""))
def outcome_counts(spark, sf):
    return quality.outcome_counts(V.registry(spark, sf), with_doi=T.normalize_doi("doi") != "", not_found=F.col("match_status") == "not_found")


# --- functions ---------------------------------------------------------------------------------

@query("artifact_stems", S.with_registry(f"""SELECT paper_id, CASE WHEN s <> '' THEN bibtex_key || '_' || s ELSE bibtex_key END AS stem
  FROM (SELECT paper_id, bibtex_key, {S.STEM} AS s FROM (SELECT *, venue AS v FROM registry))"""))
def artifact_stems(spark, sf):
    return V.registry(spark, sf).select("paper_id", N.artifact_stem("bibtex_key", "venue").alias("stem"))


@query("item_types", S.with_registry("""SELECT paper_id, ['article', 'book', 'unknown'][(row_ord % 3 + 1)::INT] AS item_type FROM registry"""))
def item_types(spark, sf):
    d = F.col("row_ord") % 3
    path = F.concat(F.when(d == 0, "library/Articles/").when(d == 1, "BOOKS/x/").otherwise("articles-old/"), "filename")
    return V.registry(spark, sf).select("paper_id", P.item_type(path).alias("item_type"))


@query("query_lists", S.with_registry(f"""SELECT paper_id, CASE WHEN {S.norm('title_query')} <> '' THEN {S.squeeze('title_query')} || '|' ELSE '' END || 'Q ' || paper_id AS queries FROM registry"""))
def query_lists(spark, sf):
    again = F.concat(F.lit(" "), "title_query", F.lit("!"))
    return V.registry(spark, sf).select("paper_id", joined(T.dedupe_queries(F.array(F.col("title_query"), again, F.lit(""), F.concat(F.lit("Q "), "paper_id")))).alias("queries"))


@query("works_with_candidates", S.with_registry("""SELECT '10.1234/ABC.' || lpad(row_ord::VARCHAR, 6, '0') AS doi, 'https://works.example.org/' || row_ord AS url, 'C' || row_ord AS semantic_scholar_paper_id
  FROM registry"""))
def works_with_candidates(spark, sf):
    key = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    w = V.works(spark, sf).select(key("DOI").alias("k"), F.struct("*").alias("w"))
    c = V.candidates(spark, sf).select(key("paperId").alias("k"), F.struct("*").alias("c"))
    fields = NV.merged_work_candidate(F.col("w"), F.col("c"))
    return w.join(c, "k").select(*[fields[n].alias(n) for n in ("doi", "url", "semantic_scholar_paper_id")])


@query("report_fields", S.with_registry("SELECT paper_id, 'DOI=' || doi || '|volume=' || (row_ord % 40) AS fields FROM registry"))
def report_fields(spark, sf):
    work = F.create_map(F.lit("volume"), (F.col("row_ord") % 40).cast("string"), F.lit("x-internal"), F.lit("no"), F.lit("DOI"), F.col("doi"))
    kept = F.array_sort(F.map_entries(NV.report_fields(work)))
    return V.registry(spark, sf).select("paper_id", joined(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("fields"))


# --- merges of more than two rows -----------------------------------------------------------------

def _chains(spark, sf) -> DataFrame:
    """In each ten rows: 0 takes 1, 1 takes 2 (a chain), 4 and 5 take each other (a circle), 6 and 7 both take 8."""
    n = V.documents(spark, sf).count()
    i = F.col("row_ord")
    pairs = F.filter(F.array(*[F.struct(i.alias("base"), F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in ((0, 1), (1, 2), (4, 5), (5, 4), (6, 8), (7, 8))]),
                     lambda p: (p["base"] + p["k"] < n) & (p["base"] + p["d"] < n))
    flat = V.registry(spark, sf).filter(i % 10 == 0).select(F.explode(pairs).alias("p"))
    nid = lambda c: F.concat(F.lit("doc-"), (F.col("p.base") + F.col(f"p.{c}")).cast("string"))
    return flat.select(nid("k").alias("keep_id"), nid("d").alias("drop_id"))


_MERGED = ("resolved_title", "year", "venue", "doi", "notes")


@query("merge_chains", S.with_registry(f"""SELECT r.paper_id, {', '.join(f"CASE WHEN {S.clean('r.' + c)} <> '' THEN r.{c} ELSE coalesce(f.{c}, r.{c}) END AS {c}" for c in _MERGED)}
  FROM registry r LEFT JOIN filled f ON f.s = r.row_ord WHERE r.row_ord NOT IN (SELECT d FROM gone)""",
  # every walk along the pairs, from each row that no pair drops and from the first row of each circle
  """pair AS (SELECT row_ord + k AS k, row_ord + d AS d FROM registry, (VALUES (0, 1), (1, 2), (4, 5), (6, 8)) AS t(k, d)
    WHERE row_ord % 10 = 0 AND row_ord + d IN (SELECT row_ord FROM registry))""",
  """gone AS (WITH RECURSIVE walk(s, d) AS (SELECT k, d FROM pair WHERE k NOT IN (SELECT d FROM pair)
    UNION SELECT w.s, p.d FROM walk w JOIN pair p ON p.k = w.d) SELECT * FROM walk)""",
  f"filled AS (SELECT g.s, {', '.join(f'''arg_min({S.clean('x.' + c)}, x.row_ord) FILTER ({S.clean('x.' + c)} <> '') AS {c}''' for c in _MERGED)} FROM gone g JOIN registry x ON x.row_ord = g.d GROUP BY g.s)"))
def merge_chains(spark, sf):
    return maintain.merge_pairs(V.registry(spark, sf), _chains(spark, sf), force=True).registry.select("paper_id", *_MERGED)


# --- search over tables of queries -------------------------------------------------------------


@query("search_query_table", ORACLES["search_batch"])
def search_query_table(spark, sf):
    """The queries of ``search_batch`` as a table: inverted index, joins and partial aggregation instead of one expression per query."""
    asked = spark.createDataFrame(list(enumerate(MANY)), "query_id int, query string")
    return query_table.search_table(search_index(spark, sf), asked, 10).select(
        "query_id", "paper_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("search_every_title")
def search_every_title(spark, sf):
    """Every registry row asks with the first words of its title, its first author and its year."""
    rows = V.registry(spark, sf)
    asked = rows.select(F.col("row_ord").alias("query_id"), F.concat_ws(
        " ", F.substring_index("title_query", " ", 4), F.substring_index("authors", ",", 1), "year").alias("query"))
    return query_table.search_table(search_index(spark, sf), asked, 10).select(
        "query_id", "paper_id", "score", F.col("rank").cast("bigint").alias("rank"))


# --- damaged entries ---------------------------------------------------------------------------


@query("bib_recovered", S.with_registry("""SELECT ord, entry_type, bibtex_key, title, authors AS author, CASE WHEN ord % 7 = 3 THEN '' ELSE year END AS year,
  doi_raw AS doi, venue_raw AS venue, CASE WHEN ord % 7 = 3 THEN '' ELSE p1 || '--' || p2 END AS pages FROM bibv""", _BIBV))
def bib_recovered(spark, sf):
    """Every seventh entry has a field without a value; its fields that fill a line stay, bare numbers and unknown names go."""
    broken = F.when(F.col("ord") % 7 == 3, F.regexp_replace("raw", "\n  doi=", "\n  note {x},\n  doi=")).otherwise(F.col("raw"))
    parsed = bib.parse_entries(V.bib_entries(spark, sf).select("ord", broken.alias("raw")), recover=True).filter("error = ''")
    f = lambda n: T.blank(F.try_element_at("fields", F.lit(n)))
    return parsed.select("ord", "entry_type", "bibtex_key", *[f(n).alias(n) for n in ("title", "author", "year", "doi")],
                         T.first_filled(f("journal"), f("publisher")).alias("venue"), f("pages").alias("pages"))


# --- a merge with everything that hangs on it ------------------------------------------------------

_SIGNAL_NAMES = ["same_doi", "same_bibtex_key", "same_pdf_sha256", "same_title_year"]
_MERGED_KEY = f"CASE WHEN {S.clean('r.bibtex_key')} <> '' THEN r.bibtex_key WHEN {S.clean('d.bibtex_key')} <> '' THEN {S.clean('d.bibtex_key')} ELSE r.bibtex_key END"


@query("merge_library", S.with_registry("""
  SELECT 'registry' AS frame, paper_id AS id, bibtex_key AS value FROM after
  UNION ALL SELECT DISTINCT 'bibliography', bibtex_key, '' FROM registry WHERE bibtex_key <> '' AND bibtex_key NOT IN (SELECT bibtex_key FROM unused)
  UNION ALL SELECT 'records', r.paper_id, coalesce('dedup_keep ' || g.drop_id || ' ' || g.signals || ' true', '') FROM registry r LEFT JOIN good g ON g.keep_id = r.paper_id WHERE r.paper_id NOT IN (SELECT drop_id FROM good)
  UNION ALL SELECT 'texts', paper_id, '' FROM after
  UNION ALL SELECT 'chunks', paper_id || '#' || i, '' FROM after, (VALUES (0), (1)) AS t(i)
  UNION ALL SELECT DISTINCT 'files', pdf_path, '' FROM registry WHERE pdf_path <> '' AND paper_id IN (SELECT drop_id FROM good)
  UNION ALL SELECT 'log', g.drop_id, CASE WHEN d.bibtex_key IN (SELECT bibtex_key FROM unused) THEN d.bibtex_key ELSE '' END FROM good g JOIN registry d ON d.paper_id = g.drop_id""",
  _PAIRS, f"""good AS (SELECT mp.*, concat_ws('+', {', '.join(f"CASE WHEN {dict(zip(_SIGNAL_NAMES, _SIGNALS))[n]} THEN '{n}' END" for n in ('same_doi', 'same_bibtex_key', 'same_title_year', 'same_pdf_sha256'))}) AS signals
    FROM mp JOIN registry k ON k.paper_id = keep_id JOIN registry d ON d.paper_id = drop_id
    WHERE ({' OR '.join(_SIGNALS)}) AND NOT ({_SUPP_MERGE.replace('{r}', 'd')} AND NOT {_SUPP_MERGE.replace('{r}', 'k')}))""",
  f"after AS (SELECT r.paper_id, {_MERGED_KEY} AS bibtex_key FROM registry r LEFT JOIN good g ON g.keep_id = r.paper_id LEFT JOIN registry d ON d.paper_id = g.drop_id WHERE r.paper_id NOT IN (SELECT drop_id FROM good))",
  "unused AS (SELECT bibtex_key FROM registry WHERE bibtex_key <> '' AND paper_id IN (SELECT drop_id FROM good) AND bibtex_key NOT IN (SELECT bibtex_key FROM after))"))
def merge_library(spark, sf):
    """Registry, bibliography, records, texts, chunks, files and log after the merges of ``merge_pairs``."""
    chunks = V.texts(spark, sf).select("paper_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    m = maintain.merge_library(V.registry(spark, sf), _neighbours(spark, sf), V.bib_entries(spark, sf), V.records(spark, sf), V.texts(spark, sf), chunks,
                               delete_pdf=True, timestamp=F.lit("2024-01-01T00:00:00+00:00"))
    event = lambda e: F.concat_ws(" ", e["action"], e["merged_from_paper_id"], F.array_join(e["identity_signals"], "+"), e["deleted_drop_pdf"].cast("string"))
    frame = lambda df, name, i, value=F.lit(""): df.select(F.lit(name).alias("frame"), i.alias("id"), value.alias("value"))
    return (
        frame(m.registry, "registry", F.col("paper_id"), F.col("bibtex_key"))
        .unionAll(frame(m.bibliography, "bibliography", F.col("bibtex_key")).distinct())
        .unionAll(frame(m.records, "records", F.col("paper_id"), F.array_join(F.transform("maintenance", event), ";")))
        .unionAll(frame(m.texts, "texts", F.col("paper_id"))).unionAll(frame(m.chunks, "chunks", F.concat_ws("#", "paper_id", "i")))
        .unionAll(frame(m.files, "files", F.col("pdf_path"))).unionAll(frame(m.log, "log", F.col("drop_id"), F.col("removed_key"))))


# --- title lines -----------------------------------------------------------------------------------



def _n_words(x: str) -> str:
    return f"len({S.words(x)})"


def _cut(x: str, pattern: str) -> str:
    """Text before the first match of ``pattern``, when it has five words; a captured shortest head replaces the look-ahead."""
    head = f"trim(regexp_extract({x}, '^(.*?)(?:{pattern})', 1), ' ,;:-')"
    return f"CASE WHEN regexp_matches({x}, '^(.*?)(?:{pattern})') AND {_n_words(head)} >= 5 THEN {head} END"


_WORDS = "[\\p{L}\\p{M}\\p{N}_.''-]"
_TEXTS = "texts AS (SELECT 'doc-' || doc_id AS paper_id, text FROM documents)"
_LINES = f"""raw_lines AS (SELECT paper_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
  kept AS (SELECT paper_id, pos, trim(l, chr(32) || chr(9) || chr(13)) AS l FROM raw_lines),
  text_lines AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS i, {S.titleish('l')} AS x FROM kept WHERE l <> ''
    AND NOT regexp_matches(l, '^\\[Page \\d+\\]$') AND NOT regexp_matches(l, '(?i)\\b(?:doi|received|accepted|published online|open access|check for updates)\\b')
    AND NOT (regexp_matches(l, '^[A-Z\\s&,:;.-]{{3,}}$') AND {_n_words('l')} <= 8) AND NOT regexp_matches(l, '(?i)@|\\bAffiliations?\\b|\\bCorrespondence\\b'))"""
_PREFIXES = f"""labels AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(x, '^(?:[A-Z]\\s+){{2,}}[A-Z]?\\s*', ''),
    '(?i)^(?:research|report|article|review|perspective|resource)\\s+', ''), '(?i)^(?:molecular biology|dynamic genome|genome biology|biophysics|cell biology)\\s+', '')) AS t FROM text_lines),
  prefixes AS (SELECT paper_id, i, x, coalesce({_cut('t', f"\\s[A-Z]{_WORDS}+(?:\\s+[A-Z]{_WORDS}+){{0,3}}(?:\\p{{Nd}}|[*†‡])")}, {_cut('t', "[.?!:]\\s+[A-Z]")}, t) AS p FROM labels)"""


@query("text_lines", f"WITH {_TEXTS}, {_LINES} SELECT paper_id, i, x AS line FROM text_lines")
def text_lines(spark, sf):
    return V.texts(spark, sf).select("paper_id", F.posexplode(P.text_lines("text")).alias("i", "line")).select(
        "paper_id", (F.col("i") + 1).cast("bigint").alias("i"), "line")


@query("title_prefixes", f"WITH {_TEXTS}, {_LINES}, {_PREFIXES} SELECT paper_id, i, p AS prefix FROM prefixes")
def title_prefixes(spark, sf):
    lines = V.texts(spark, sf).select("paper_id", F.posexplode(P.text_lines("text")).alias("i", "line"))
    return lines.select("paper_id", (F.col("i") + 1).cast("bigint").alias("i"), P.title_prefix("line").alias("prefix"))


_NO_ET_AL = "NOT contains(lower({x}), 'et al')"
_TITLES = f"""{_LINES}, {_PREFIXES},
  top AS (SELECT paper_id, i, {S.titleish("x || ' ' || lead(x) OVER (PARTITION BY paper_id ORDER BY i)")} AS v FROM text_lines WHERE i <= 8 AND {_n_words('x')} >= 2),
  found AS (SELECT paper_id, CASE WHEN i <= 25 THEN 0 ELSE 2 END AS part, i, 0 AS sub, p AS v FROM prefixes WHERE p <> x AND {_n_words('p')} BETWEEN 5 AND 25 AND {_NO_ET_AL.format(x='p')}
    UNION ALL SELECT paper_id, CASE WHEN i <= 25 THEN 0 ELSE 2 END, i, 1, x FROM prefixes WHERE {_n_words('x')} BETWEEN 5 AND 25 AND length(x) >= 25 AND {_NO_ET_AL.format(x='x')}
      AND NOT regexp_matches(x, '(?i)\\b(?:abstract|summary|introduction|significance|results|supporting information|supplementary)\\b')
      AND NOT regexp_matches(x, '(?i)\\b(?:university|department|institute|laboratory|school|center|centre)\\b')
    UNION ALL SELECT paper_id, 1, i, 0, v FROM top WHERE v IS NOT NULL AND {_n_words('v')} BETWEEN 6 AND 20 AND {_NO_ET_AL.format(x='v')}),
  once AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY paper_id, v ORDER BY part, i, sub) = 1),
  guesses AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY part, i, sub) <= 4)"""
ORACLES["title_candidates"] = f"""WITH {_TEXTS}, {_TITLES}
  SELECT 'doc-' || doc_id AS paper_id, coalesce(titles, '') AS titles FROM documents LEFT JOIN
    (SELECT paper_id, string_agg(v, '|' ORDER BY part, i, sub) AS titles FROM guesses GROUP BY 1) b ON b.paper_id = 'doc-' || doc_id"""


# --- the rebuilt bibliography ------------------------------------------------------------------------


def _field(name: str, value: str) -> str:
    return f"CASE WHEN {value} <> '' THEN '  {name} = {{' || {value} || '}}' END"


def _either(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' THEN {a} ELSE {b} END"


_ARTICLE = ["title", "author", "year", "journal", "volume", "number", "pages", "doi", "url", "abstract", "issn", "publisher"]
_BOOK = ["title", "author", "year", "publisher", "volume", "pages", "doi", "url", "abstract"]
ORACLES["bib_rebuild"] = S.with_registry(f"""
  SELECT bibtex_key, entry_type, '@' || entry_type || '{{' || bibtex_key || ',' || chr(10) || array_to_string(list_filter(CASE WHEN entry_type = 'book'
    THEN [{', '.join(_field(n, n) for n in _BOOK)}] ELSE [{', '.join(_field(n, n) for n in _ARTICLE)}] END, lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' || chr(10) AS raw FROM rebuilt""",
  _BIBV,
  f"""facts AS (SELECT *, trim(bibtex_key) AS k, CASE WHEN row_ord % 5 = 0 THEN 'Manual abstract' WHEN row_ord % 5 <> 2 AND row_ord % 2 = 0 THEN 'Abstract &amp; <b>more</b> ' || row_ord
      WHEN row_ord % 5 <= 1 THEN '<p>Work ' || row_ord || '</p>' ELSE '' END AS abs FROM registry WHERE trim(bibtex_key) <> '')""",
  f"""reps AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY k ORDER BY
      (CASE WHEN {_BIBSUP} THEN 0 ELSE 100 END + CASE WHEN content_kind = 'pdf_backed' THEN 20 ELSE 0 END + (resolved_title <> '')::INT + (authors <> '')::INT + (year <> '')::INT
        + (venue <> '')::INT + (doi <> '')::INT + (canonical_url <> '')::INT + (abs <> '')::INT) DESC, length(abs) DESC, length(doi) DESC, row_ord) = 1)""",
  "olds AS (SELECT * FROM bibv QUALIFY row_number() OVER (PARTITION BY bibtex_key ORDER BY ord) = 1)",
  f"""shaped AS (SELECT r.k AS bibtex_key, r.row_ord % 5 = 0 AS manual, r.row_ord % 5 <= 1 AS work, CASE WHEN r.row_ord % 5 = 0 THEN 'book' ELSE o.entry_type END AS entry_type, r.row_ord AS d,
      {S.squeeze("CASE WHEN r.resolved_title <> '' THEN r.resolved_title ELSE r.title_query END")} AS mt, r.authors AS ma, r.year AS my, {S.venue('r.venue')} AS mv, {S.doi('r.doi')} AS md,
      r.canonical_url AS url, r.abs AS abstract, o.title AS ot, o.authors AS oa, o.year AS oy, o.venue_raw AS ov, o.doi_raw AS od, o.p1 || '--' || o.p2 AS op, o.book AS obook
      FROM reps r JOIN olds o ON o.bibtex_key = r.k)""",
  f"""rebuilt AS (SELECT bibtex_key, entry_type, {_either('mt', "CASE WHEN manual THEN 'Raw' ELSE ot END")} AS title, {_either('ma', "CASE WHEN manual THEN '' ELSE oa END")} AS author,
      {_either('my', "CASE WHEN manual THEN '' ELSE oy END")} AS year, {_either('mv', "CASE WHEN manual OR obook THEN '' ELSE ov END")} AS journal,
      CASE WHEN entry_type = 'book' AND mv <> '' THEN mv WHEN work THEN 'Pub' WHEN obook AND NOT manual THEN ov ELSE '' END AS publisher,
      CASE WHEN work THEN (d % 40)::VARCHAR ELSE '' END AS volume, CASE WHEN work THEN (d % 12)::VARCHAR ELSE '' END AS number,
      CASE WHEN work THEN '1-2' WHEN manual THEN '' ELSE op END AS pages, {_either('md', "CASE WHEN manual THEN '10.1/' || d ELSE od END")} AS doi,
      url, abstract, CASE WHEN work THEN '1234-5678' ELSE '' END AS issn FROM shaped)""")


# --- DOIs against works, with the titles of the texts ---------------------------------------------------

ORACLES["doi_resolution_titles"] = S.with_registry(f"""
  SELECT paper_id, doi AS best_doi, round(score, 4) AS best_score, CASE WHEN score >= 0.55 THEN 'accepted' WHEN score >= 0.35 THEN 'review' ELSE 'rejected' END AS decision, attempts,
    concat_ws('|', CASE WHEN wy IS NOT NULL AND wy <> hint THEN 'crossref_year_hint_mismatch:' || hint || '!=' || wy END,
      CASE WHEN vk NOT IN ('', 'naturegenetics') THEN 'crossref_venue_hint_mismatch:naturegenetics!=' || vk END) AS warnings
  FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS attempts, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pr DESC, place) AS k FROM (
    SELECT *, CASE WHEN wn IN ('', 'abstract', 'proceedings of the national academy of sciences') THEN -1.0 ELSE best
      + CASE WHEN wy = hint THEN 0.08 WHEN abs(wy - hint) = 1 THEN 0.03 ELSE 0.0 END + CASE WHEN vk = 'naturegenetics' THEN 0.08 ELSE 0.0 END END AS score FROM (
      SELECT paper_id, doi, pr, place, wn, wy, hint, vk, coalesce(max({S.sim('q', 'wn', 'qt', 'wt')}), 0.0) AS best FROM hits LEFT JOIN targets USING (paper_id) GROUP BY ALL))) WHERE k = 1""",
  _PLANTED, _DOIS, "texts AS (SELECT paper_id, text FROM planted)", _TITLES,
  f"""named AS (SELECT paper_id, list_filter(list_transform(string_split(replace(regexp_replace(filename, '[.][^.]*$', ''), '_', ' '), ' - '), lambda x: trim(x)), lambda x: x <> '') AS c FROM planted)""",
  f"""targets AS (SELECT paper_id, {S.norm('v')} AS q, {S.tokens(S.norm('v'))} AS qt FROM (SELECT paper_id, v FROM guesses UNION ALL
    SELECT paper_id, CASE WHEN len(c) >= 3 THEN {S.titleish('c[-1]')} WHEN len(c) = 2 AND len({S.words(S.titleish('c[2]'))}) >= 4 THEN {S.titleish('c[2]')}
      WHEN len(c) = 2 THEN {S.titleish("c[1] || ' ' || c[2]")} ELSE '' END FROM named) WHERE v <> '')""",
  f"""hits AS (SELECT d.paper_id, d.doi, d.pr, d.place, {S.norm('w.t')} AS wn, {S.tokens(S.norm('w.t'))} AS wt, w.y AS wy, (1980 + x.n_chars % 45)::INT AS hint, {S.venue_key('w.v')} AS vk
    FROM dois d JOIN documents x ON 'doc-' || x.doc_id = d.paper_id JOIN (SELECT '10.1234/abc.' || lpad(row_ord::VARCHAR, 6, '0') AS wd, {_WORKT} AS t,
      {S.venue("CASE WHEN venue = 'bioRxiv' THEN 'Nature Genetics' ELSE venue END")} AS v, CASE WHEN year <> 'n/a' THEN year::INT + row_ord % 3 - 1 END AS y FROM registry) w ON w.wd = lower(d.doi))""")


# --- reconciliation ---------------------------------------------------------------------------------------

_TWO = S.titleish("c[1] || ' ' || c[2]")
_FILE_TITLE = (f"CASE WHEN len(c) >= 3 THEN {S.titleish('c[-1]')} WHEN len(c) = 2 AND len({S.words(S.titleish('c[2]'))}) >= 4 THEN {S.titleish('c[2]')} "
               f"WHEN len(c) = 2 THEN {_TWO} ELSE '' END")
_NAMED = """named AS (SELECT paper_id, list_filter(list_transform(string_split(replace(regexp_replace(filename, '[.][^.]*$', ''), '_', ' '), ' - '), lambda x: trim(x)), lambda x: x <> '') AS c FROM planted)"""
_OLD_TITLE = "CASE WHEN r.resolved_title <> '' THEN r.resolved_title ELSE r.title_query END"
ORACLES["reconcile"] = S.with_registry(f"""
  SELECT paper_id, CASE WHEN skip = '' AND lost <> '' THEN 'metadata_loss:' || lost ELSE skip END AS skip_reason, ok AS accepted,
    CASE WHEN skip <> '' THEN 'skip' WHEN ok THEN 'upgrade_to_crossref' ELSE 'review_or_skip' END AS proposed_action, doi AS best_doi, round(score, 4) AS best_score,
    CASE WHEN doi IS NULL THEN '' WHEN reasons <> '' THEN 'rewrite_entry' ELSE 'enrich_existing_entry' END AS job_type, reasons AS rewrite_reasons, changed, ok AND reasons = '' AS applies
  FROM (SELECT *, skip = '' AND coalesce(score, -1) >= 0.55 AND lost = '' AS ok FROM judged)""",
  _PLANTED, _DOIS, "texts AS (SELECT paper_id, text FROM planted)", _TITLES, _NAMED,
  f"""eligible AS (SELECT *, CASE WHEN content_kind <> 'pdf_backed' THEN 'not_pdf_backed' WHEN {_RECON} THEN 'supplement'
    WHEN row_ord % 5 = 0 THEN 'protected_source:manual_bibtex' WHEN row_ord % 5 = 2 THEN 'protected_source:manual_supplement_link'
    WHEN row_ord % 19 = 4 THEN 'invalid_record_filename:other.pdf' ELSE '' END AS skip FROM registry)""",
  f"""targets AS (SELECT paper_id, {S.norm('v')} AS q, {S.tokens(S.norm('v'))} AS qt FROM (SELECT paper_id, v FROM guesses UNION ALL SELECT paper_id, {_FILE_TITLE} FROM named
    UNION ALL SELECT paper_id, {_OLD_TITLE.replace('r.', '')} FROM registry UNION ALL SELECT paper_id, title_query FROM registry) WHERE v <> '')""",
  f"""works AS (SELECT row_ord AS d, {_WORKT} AS t, {S.venue("CASE WHEN venue = 'bioRxiv' THEN 'Nature Genetics' ELSE venue END")} AS v, CASE WHEN year <> 'n/a' THEN year::INT + row_ord % 3 - 1 END AS y FROM registry)""",
  f"""hits AS (SELECT d.paper_id, d.doi, d.pr, d.place, w.d, {S.norm('w.t')} AS wn, {S.tokens(S.norm('w.t'))} AS wt, w.y AS wy, w.t, w.v, (1980 + x.n_chars % 45)::INT AS hint, {S.venue_key('w.v')} AS vk
    FROM dois d JOIN documents x ON 'doc-' || x.doc_id = d.paper_id JOIN works w ON lower(d.doi) = '10.1234/abc.' || lpad(w.d::VARCHAR, 6, '0'))""",
  f"""scores AS (SELECT paper_id, doi, pr, place, d, t, v, wy, CASE WHEN wn IN ('', 'abstract', 'proceedings of the national academy of sciences') THEN -1.0 ELSE coalesce(max({S.sim('q', 'wn', 'qt', 'wt')}), 0.0)
      + CASE WHEN wy = hint THEN 0.08 WHEN abs(wy - hint) = 1 THEN 0.03 ELSE 0.0 END + CASE WHEN vk = 'naturegenetics' THEN 0.08 ELSE 0.0 END END AS score
    FROM hits LEFT JOIN targets USING (paper_id) WHERE paper_id IN (SELECT paper_id FROM eligible WHERE skip = '') GROUP BY paper_id, doi, pr, place, d, t, v, wy, wn, hint, vk)""",
  "chosen AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pr DESC, place) = 1)",
  f"""paired AS (SELECT r.*, f.doi AS found_doi, f.score, f.d, coalesce(f.v, '') AS new_venue, coalesce(f.wy::VARCHAR, '') AS new_year, trim(coalesce(f.t, '')) AS new_title,
    {S.squeeze(_OLD_TITLE)} AS old_title, lower('10.1234/ABC.' || lpad(f.d::VARCHAR, 6, '0')) AS new_doi, {S.doi('r.doi')} AS old_doi FROM eligible r LEFT JOIN chosen f USING (paper_id))""",
  f"""likeness AS (SELECT *, {S.sim(S.norm('old_title'), S.norm('new_title'), S.tokens(S.norm('old_title')), S.tokens(S.norm('new_title')))} AS likeness FROM paired)""",
  f"""judged AS (SELECT paper_id, skip, found_doi AS doi, score, CASE WHEN found_doi IS NULL THEN '' ELSE concat_ws(',', CASE WHEN old_title <> '' AND new_title = '' THEN 'resolved_title' END,
      CASE WHEN year <> '' AND new_year = '' THEN 'year' END) END AS lost,
    CASE WHEN found_doi IS NULL THEN '' ELSE concat_ws('|', CASE WHEN old_title <> '' AND new_title <> '' AND likeness < 0.92 THEN 'title_changed_score=' || printf('%.3f', likeness) END,
      CASE WHEN old_doi <> '' AND old_doi <> new_doi THEN 'doi_changed' END, CASE WHEN new_year <> '' AND year <> new_year THEN 'year_changed' END,
      CASE WHEN lower(venue) LIKE '%biorxiv%' AND new_venue <> '' THEN 'preprint_to_journal' END) END AS reasons,
    CASE WHEN found_doi IS NULL THEN '' ELSE concat_ws('|', 'bibtex.issn', 'bibtex.number', 'bibtex.pages', 'bibtex.publisher', 'bibtex.volume', 'canonical_url', 'doi',
      CASE WHEN new_title <> '' AND new_title <> trim(resolved_title) THEN 'resolved_title' END, CASE WHEN new_venue <> '' AND new_venue <> trim(venue) THEN 'venue' END,
      CASE WHEN new_year <> '' AND new_year <> trim(year) THEN 'year' END) END AS changed FROM likeness)""")


# --- batches with minted keys ----------------------------------------------------------------------------

_TOKEN = "coalesce({0}[1], 'paper')"
_MINTED = (f"{_TOKEN.format(S.tokens('authors'))} || CASE WHEN year <> '' THEN year ELSE 'undated' END || "
           + _TOKEN.format(S.tokens("CASE WHEN title <> '' THEN title ELSE 'title' END")))


@query("batch_accept_minted", "WITH RECURSIVE " + S.REGISTRY + ", " + _BIBV + f""", known AS (SELECT list(DISTINCT k) AS ks FROM (
    SELECT 'd' || lower(trim(doi)) AS k FROM registry WHERE row_ord % 10 = 0 AND doi <> '' UNION ALL SELECT 'k' || lower(bibtex_key) FROM registry WHERE row_ord % 10 = 0 AND bibtex_key <> ''
    UNION ALL SELECT 't' || lower(trim(resolved_title)) FROM registry WHERE row_ord % 10 = 0 AND resolved_title <> '')),
  entries AS (SELECT ord, row_number() OVER (ORDER BY ord) AS i, CASE WHEN d <> '' THEN 'd' || d ELSE '-' END AS kd, CASE WHEN ord % 3 = 0 THEN '-' ELSE 'k' || lower(bibtex_key) END AS kk,
    'k' || lower(CASE WHEN ord % 3 = 0 THEN {_MINTED} ELSE bibtex_key END) AS kept, CASE WHEN title <> '' THEN 't' || lower(title) ELSE '-' END AS kt FROM (SELECT *, {S.doi('doi_raw')} AS d FROM bibv)),
  walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS ord, ''::VARCHAR AS reason, ks AS taken, ''::VARCHAR AS bibtex_key FROM known
    UNION ALL SELECT e.i, e.ord, CASE WHEN list_contains(w.taken, e.kd) THEN 'doi' WHEN list_contains(w.taken, e.kk) THEN 'key' WHEN list_contains(w.taken, e.kt) THEN 'title' ELSE '' END,
      CASE WHEN list_contains(w.taken, e.kd) OR list_contains(w.taken, e.kk) OR list_contains(w.taken, e.kt) THEN w.taken ELSE list_concat(w.taken, list_filter([e.kd, e.kept, e.kt], lambda x: x <> '-')) END, e.kept
    FROM walk w JOIN entries e ON e.i = w.i + 1)
  SELECT ord, reason = '' AS accepted, reason, substr(bibtex_key, 2) AS bibtex_key FROM walk WHERE i > 0""")
def batch_accept_minted(spark, sf):
    """Every third entry comes without a key and gets one from its author, year and title."""
    meta = BX.normalized_metadata(F.col("fields"))
    inc = _parsed(spark, sf).select("ord", meta["doi"].alias("doi"), F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("bibtex_key")).alias("bibtex_key"),
                                    meta["title"].alias("title"), meta["authors"].alias("authors"), meta["year"].alias("year"))
    done = accept.accept_batch(accept.with_minted_keys(inc), V.registry(spark, sf).filter("row_ord % 10 = 0"))
    return done.select("ord", "accepted", "reason", F.lower(T.first_filled("bibtex_key", "minted_key")).alias("bibtex_key"))
