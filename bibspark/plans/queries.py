"""Registered queries: each one a Spark callable and, where SQL can say it, a DuckDB twin."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import arrow
from ..functions import bibtex as BX
from ..functions import names as N
from ..functions import nested as NV
from ..functions import parsing as P
from ..functions import text as T
from ..operators import accept, bib, chunks, cite, index, linkage, maintain, quality, rebuild, resolve, search, similarity
from ..session import materialize, scratch_path
from . import sql as S
from . import views as V
from .spec import QueryText

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEARCH_TEXT = 'the erntre "the there" of this 1995 nature Name5'
MANY = ["thing of erntre 1999", "name7 plos one", "doc 12 heed thheha", "10.1234/abc.000101", "Vièle aile mentoiier"]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


def joined(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def r4(c: Column) -> Column:
    return F.round(c, 4)


# --- projections ----------------------------------------------------------------------

@query("registry_defaults", S.with_registry(f"""
  SELECT paper_id, content_kind, CASE WHEN bibtex_type <> '' THEN bibtex_type ELSE 'article' END AS bibtex_type,
    {S.venue('venue')} AS venue, year, doi FROM registry"""))
def registry_defaults(spark, sf):
    d = index.with_defaults(V.registry(spark, sf).drop("content_kind"))
    return d.select("paper_id", "content_kind", "bibtex_type", T.normalize_venue("venue").alias("venue"), "year", "doi") \
        .withColumn("content_kind", F.when(F.col("content_kind") == "", "x").otherwise(F.col("content_kind")))


@query("title_norm", f"""
  WITH t AS (SELECT 'd' || doc_id AS id, split_part(text, chr(10), 1) AS s FROM documents
    UNION ALL SELECT 'p' || page_id, regexp_extract(html, '<title>([^<]*)', 1) FROM pages)
  SELECT id, {S.norm('s')} AS title, {S.compact('s')} AS compact, {S.slug('s')} AS slug, {S.titleish('s')} AS titleish,
    {S.norm("regexp_extract(s, '[^ ]+$')")} AS last_word FROM t""")
def title_norm(spark, sf):
    t = V.documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
                                      F.substring_index("text", "\n", 1).alias("s")).unionByName(
        V.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
                                           F.regexp_extract("html", "<title>([^<]*)", 1).alias("s")))
    return t.select("id", T.normalize_title("s").alias("title"), T.compact("s").alias("compact"), T.slug("s").alias("slug"),
                    T.titleish("s").alias("titleish"),
                    T.normalize_title(F.regexp_extract("s", "[^ ]+$", 0)).alias("last_word"))


@query("doi_norm", S.with_registry(f"""SELECT paper_id, {S.doi('doi')} AS doi, {S.doi("doi || '.g001'")} AS figure_doi,
  {S.doi("doi || '/-/DCSupplemental/x'")} AS supp_doi FROM registry"""))
def doi_norm(spark, sf):
    return V.registry(spark, sf).select(
        "paper_id", T.normalize_doi("doi").alias("doi"), T.normalize_doi(F.concat("doi", F.lit(".g001"))).alias("figure_doi"),
        T.normalize_doi(F.concat("doi", F.lit("/-/DCSupplemental/x"))).alias("supp_doi"))


@query("tokens_informative", f"""SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS tokens,
  coalesce(({S.tokens('text')})[1], 'paper') AS first_token FROM documents""")
def tokens_informative(spark, sf):
    t = T.informative_tokens("text")
    return V.documents(spark, sf).select("doc_id", joined(F.array_sort(t), " ").alias("tokens"),
                                         T.first_title_token("text").alias("first_token"))


_LAST = "regexp_extract(trim(regexp_replace({}, ' +', ' ', 'g')), '[^ ]+$')"


@query("author_fields", S.with_registry(f"""SELECT paper_id,
  {S.norm(_LAST.format("split_part(authors, ',', 1)"))} AS first_surname,
  array_to_string({S.surnames('authors')}, '|') AS surnames, authors AS nothing_lost,
  'Name' || (row_ord % 97) || ' A, Name' || (row_ord % 13) || ' B' AS initials,
  CASE WHEN year = 'n/a' THEN NULL ELSE year::INT END AS year,
  'Ada Name' || (row_ord % 97) || ' and Bo Name' || (row_ord % 13) AS citeproc FROM registry"""))
def author_fields(spark, sf):
    return V.registry(spark, sf).select(
        "paper_id", N.first_author_surname("authors").alias("first_surname"),
        joined(N.all_author_surnames("authors")).alias("surnames"),
        joined(N.split_bib_authors("authors"), ", ").alias("nothing_lost"),
        joined(F.transform(N.split_bib_authors("authors"), N.author_with_initials), ", ").alias("initials"),
        N.year_in("year").alias("year"), N.authors_for_citeproc("authors").alias("citeproc"))


@query("reference_ids", S.with_registry(f"""SELECT paper_id,
  CASE WHEN semantic_scholar_paper_id <> '' THEN 's2-' || semantic_scholar_paper_id
    WHEN doi <> '' THEN 'doi-' || regexp_replace({S.doi('doi')}, '[^a-z0-9]+', '-', 'g')
    ELSE 'bib-' || substr(sha256({S.norm('resolved_title')} || '|' || year || '|' || {S.norm("split_part(authors, ',', 1)")}
      || '|' || {S.norm('venue')}), 1, 16) END AS reference_id,
  {S.sub(S.slug("'Name' || (row_ord % 97) || year || coalesce((" + S.tokens('resolved_title') + ")[1], 'paper')"), '-', '')} AS key,
  'sha256-' || substr(pdf_sha256, 1, 16) AS content_id FROM registry"""))
def reference_ids(spark, sf):
    return V.registry(spark, sf).select(
        "paper_id", N.reference_id("semantic_scholar_paper_id", "doi", "resolved_title", "year", "authors", "venue").alias("reference_id"),
        N.bib_key("authors", "year", "resolved_title", N.file_stem("filename")).alias("key"),
        N.content_id("pdf_sha256").alias("content_id"))


@query("candidate_links", S.with_registry("""SELECT 'C' || row_ord AS id,
  CASE WHEN row_ord % 6 = 0 THEN 'https://x.example.org/' || row_ord || '.pdf'
    WHEN row_ord % 4 <> 0 THEN '' WHEN row_ord % 8 = 0 THEN 'https://arxiv.org/pdf/2001.' || row_ord || '.pdf'
    ELSE 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || row_ord || '/pdf' END AS pdf_url FROM registry"""))
def candidate_links(spark, sf):
    return V.candidates(spark, sf).select(F.col("paperId").alias("id"), N.best_pdf_url("openAccessPdf.url", "externalIds").alias("pdf_url"))


@query("candidate_metadata", S.with_registry(f"""SELECT 'C' || row_ord AS id, authors, {S.venue("CASE WHEN row_ord % 5 = 0 THEN 'Nature Genetics' ELSE venue END")} AS venue,
  CASE WHEN row_ord % 4 <> 0 THEN '10.1234/abc.' || lpad(row_ord::VARCHAR, 6, '0') ELSE '' END AS doi,
  CASE WHEN year = 'n/a' THEN '' ELSE (year::INT + row_ord % 4 - 1)::VARCHAR END AS year, 'paper:C' || row_ord AS identity FROM registry"""))
def candidate_metadata(spark, sf):
    c = V.candidates(spark, sf).select(F.struct("*").alias("c"))
    f = NV.candidate_fields(F.col("c"))
    return c.select(f["semantic_scholar_paper_id"].alias("id"), f["authors"].alias("authors"), f["venue"].alias("venue"),
                    f["doi"].alias("doi"), f["year"].alias("year"), resolve.candidate_identity(F.col("c")).alias("identity"))


@query("work_metadata", S.with_registry(f"""SELECT '10.1234/ABC.' || lpad(row_ord::VARCHAR, 6, '0') AS doi,
  'Ada Name' || (row_ord % 97) || ', Bo Name' || (row_ord % 13) AS authors, 'Work ' || row_ord AS abstract,
  {S.venue("CASE WHEN venue = 'bioRxiv' THEN 'Nature Genetics' ELSE venue END")} AS venue,
  CASE WHEN year = 'n/a' THEN '' ELSE (year::INT + row_ord % 3 - 1)::VARCHAR END AS year, (row_ord % 40)::VARCHAR AS volume,
  (row_ord % 12)::VARCHAR AS number, row_ord || '-' || (row_ord + 7) AS pages, '1234-5678' AS issn FROM registry"""))
def work_metadata(spark, sf):
    f = NV.work_fields(F.col("w"))
    return V.works(spark, sf).select(F.struct("*").alias("w")).select(*[f[n].alias(n) for n in (
        "doi", "authors", "abstract", "venue", "year", "volume", "number", "pages", "issn")])


# --- search -----------------------------------------------------------------------------

def search_index(spark, sf) -> DataFrame:
    """Index over the registry view, written once; the second line of a text is its abstract, taken in the same scan."""
    second = F.coalesce(F.try_element_at(F.split("text", "\n", 3), F.lit(2)), F.lit(""))
    return materialize(index.build_search_index(V.registry(spark, sf, second.alias("abstract")), None, V.journals(spark, sf)), "search-index")


def _search_oracle(text: str, where: str, limit: int, columns: str = "paper_id, title, year, score", abstract: bool = True) -> str:
    return S.with_registry(
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {S.ORDER}) AS rank FROM "
        f"({S.search_sql(text, where, abstract)}) WHERE score > 0) WHERE rank <= {limit}", *S.index_ctes())


@query("search_topk", _search_oracle(SEARCH_TEXT, "true", 20, "paper_id, title, year, score, rank"))
def search_topk(spark, sf):
    return search.search(search_index(spark, sf), SEARCH_TEXT, limit=20).select(
        "paper_id", "title", "year", "score", F.col("rank").cast("bigint").alias("rank"))


@query("search_filtered", _search_oracle(
    "nature of the thing 2001", "yi BETWEEN 1990 AND 2010 AND contains(authors_norm, 'bo name3') AND contains(venue_norm, 'nature') "
    "AND content_kind = 'pdf_backed' AND paper_id NOT IN ('doc-3', 'doc-16')", 25, abstract=False))
def search_filtered(spark, sf):
    f = search.Filters(author="Bo Name3", year="1990-2010", venue="Nature", has_pdf=True, exclude_ids=("doc-3", "doc-16"))
    return search.search(search_index(spark, sf), "nature of the thing 2001", f, no_abstract=True, limit=25).select(
        "paper_id", "title", "year", "score")


@query("search_batch", S.with_registry(
    "SELECT query_id, paper_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY " + S.ORDER
    + ") AS rank FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS query_id, * FROM ({S.search_sql(t)})" for i, t in enumerate(MANY)) + ") WHERE score > 0) WHERE rank <= 10",
    *S.index_ctes()))
def search_batch(spark, sf):
    return search.search_many(search_index(spark, sf), MANY, 10).select(
        "query_id", "paper_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _explain_oracle() -> str:
    parts = S.score_parts(SEARCH_TEXT)
    entries = "[" + ", ".join(f"{{'v': coalesce({e}, 0.0), 'n': {S.q(n)}}}" for n, e in parts.items()) + "]"
    show = "regexp_replace(printf('%.2f', p.v), '[.]?0+$', '')"
    return S.with_registry(f"""
      SELECT paper_id, string_agg(n || '=' || {show.replace('p.v', 'v')}, ', ' ORDER BY v DESC, n) AS match_explanation
      FROM (SELECT paper_id, p.v AS v, p.n AS n, row_number() OVER (PARTITION BY paper_id ORDER BY p.v DESC, p.n) AS i
        FROM (SELECT paper_id, unnest({entries}) AS p FROM ix) WHERE p.v > 0) WHERE i <= 3 GROUP BY paper_id""", *S.index_ctes())


@query("search_explain", _explain_oracle())
def search_explain(spark, sf):
    rows = search.rank_rows(search_index(spark, sf), SEARCH_TEXT)
    return rows.select("paper_id", search.explanation().alias("match_explanation"))


@query("ambiguity_check", S.with_registry(
    "SELECT query_id, count(*) AS hits, max_by(score, -rank) AS top_score, count(*) FILTER (score >= greatest(8.0, 0.8 * top)) AS plausible, "
    "CASE WHEN count(*) = 1 OR count(*) FILTER (score >= greatest(8.0, 0.8 * top)) = 1 THEN min_by(paper_id, rank) ELSE '' END AS paper_id "
    "FROM (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "
    + S.ORDER + ") AS rank FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS query_id, * FROM ({S.search_sql(t)})" for i, t in enumerate(MANY)) + ") WHERE score > 0) WHERE rank <= 10) GROUP BY query_id",
    *S.index_ctes()))
def ambiguity_check(spark, sf):
    return search.resolve_targets(search.search_many(search_index(spark, sf), MANY, 10))


@query("identifier_lookup", S.with_registry("""
  SELECT identifier, coalesce(min_by(paper_id, row_ord), '') AS paper_id FROM (
    SELECT DISTINCT upper(replace(identifier, '.', '')) AS identifier FROM (
      SELECT doi AS identifier FROM registry WHERE doi <> '' UNION SELECT bibtex_key FROM registry WHERE bibtex_key <> ''
      UNION SELECT 'none-' || paper_id FROM registry)) i
  LEFT JOIN (SELECT paper_id, row_ord, unnest([pid_n, key_n, """ + S.compact("doi") + """]) AS tok FROM ix) t
    ON t.tok = """ + S.compact("identifier") + """ AND t.tok <> '' GROUP BY identifier""", *S.index_ctes()))
def identifier_lookup(spark, sf):
    r = V.registry(spark, sf)
    ids = r.select(F.explode(F.array("doi", "bibtex_key", F.concat(F.lit("none-"), "paper_id"))).alias("identifier")).filter(
        "identifier <> ''").select(F.upper(F.replace("identifier", F.lit("."), F.lit(""))).alias("identifier"))
    return search.lookup_identifiers(search_index(spark, sf), ids)


FULLTEXT = "thble of the heed"
_FT = QueryText(FULLTEXT)


@query("fulltext_document", f"""
  SELECT paper_id, score AS fulltext_score, array_to_string(hits, ' ') AS token_hits FROM (
    SELECT *, (CASE WHEN contains({S.norm('text')}, {S.q(_FT.norm)}) THEN 4.0 ELSE 0.0 END + 2.0 * len(hits))::DOUBLE AS score FROM (
      SELECT 'doc-' || doc_id AS paper_id, text, list_sort(list_intersect({S.tokens('text')}, {S.lst(_FT.tokens)})) AS hits FROM documents))
  WHERE score > 0""")
def fulltext_document(spark, sf):
    return search.fulltext_document(V.texts(spark, sf), _FT).select("paper_id", "fulltext_score", joined("token_hits", " ").alias("token_hits"))


@query("fulltext_lines", f"""
  SELECT paper_id, sum(2.0 * len(hits) + CASE WHEN contains({S.norm('line')}, {S.q(_FT.norm)}) THEN 4.0 ELSE 0.0 END)::DOUBLE AS fulltext_score,
    string_agg({S.squeeze('line')}, '|' ORDER BY i) AS snippets
  FROM (SELECT *, list_intersect({S.tokens('line')}, {S.lst(_FT.tokens)}) AS hits FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY i) AS k FROM (
      SELECT 'doc-' || doc_id AS paper_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    WHERE regexp_matches(line, {S.q('|'.join(_FT.tokens))}, 'i')) WHERE k <= 2) GROUP BY paper_id""")
def fulltext_lines(spark, sf):
    return search.fulltext_lines(V.texts(spark, sf), _FT).select("paper_id", "fulltext_score", joined("snippets").alias("snippets"))


@query("search_fulltext_gate", f"""
  SELECT paper_id, score AS score FROM (
    SELECT 'doc-' || doc_id AS paper_id, (2.0 * len(list_intersect({S.tokens('text')}, ['heed', 'thble'])))::DOUBLE AS score FROM documents)
  WHERE score > 0""")
def search_fulltext_gate(spark, sf):
    q = "thble heed"
    ix = search_index(spark, sf)
    no_meta = ix.select(*[c for c in ix.columns if not c.startswith(("title", "abstract"))]).withColumns(
        {c: F.lit("") for c in ("title", "title_norm", "abstract", "abstract_norm")}).withColumns(
        {c: F.array().cast("array<string>") for c in ("title_tokens", "abstract_tokens")})
    return search.rank_rows(no_meta, q, texts=V.texts(spark, sf), scope="auto").select("paper_id", "score")


@query("token_filter", S.with_registry("""SELECT paper_id, resolved_title FROM (SELECT paper_id, resolved_title, row_ord FROM registry
  WHERE contains(lower(concat_ws(' ', resolved_title, authors, bibtex_key)), 'the') AND contains(lower(concat_ws(' ', resolved_title, authors, bibtex_key)), 'name1')
    AND match_status <> 'matched_supplement' ORDER BY row_ord LIMIT 10)"""))
def token_filter(spark, sf):
    r = V.registry(spark, sf).withColumn("title", F.col("resolved_title"))
    return search.contains_all_tokens(r, "The Name1", skip_supplements=True).select("paper_id", "resolved_title")


@query("folder_listing", S.with_registry("SELECT paper_id, pdf_path FROM registry WHERE pdf_path LIKE 'articles/src3/%' AND pdf_path NOT LIKE 'articles/src3/%/%'"))
def folder_listing(spark, sf):
    return search.in_folder(V.registry(spark, sf), "src3").select("paper_id", "pdf_path")


@query("sorted_listing", S.with_registry("""SELECT paper_id, row_number() OVER (ORDER BY CASE WHEN year = 'n/a' THEN 0 ELSE year::INT END DESC, row_ord) AS place FROM registry"""))
def sorted_listing(spark, sf):
    from ..operators.joins import rank_within
    year = F.coalesce(F.regexp_extract("year", r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    return rank_within(V.registry(spark, sf).select("paper_id", "year", "row_ord", F.lit(1).alias("g")), ["g"],
                       [(year, "desc"), F.col("row_ord")], "place").select("paper_id", "place")


# --- duplicates ---------------------------------------------------------------------------

_KEYS = f"""keys AS (
  SELECT row_ord, 'doi' AS key_type, {S.doi(S.clean('doi'))} AS key FROM registry WHERE match_status <> 'matched_supplement'
  UNION ALL SELECT row_ord, 'bibtex_key', {S.fold(S.clean('bibtex_key'))} FROM registry
  UNION ALL SELECT row_ord, 'title_year', CASE WHEN {S.norm(S.filled('resolved_title', 'title_query'))} <> '' AND {S.clean('year')} <> ''
    THEN {S.norm(S.filled('resolved_title', 'title_query'))} || '|' || {S.clean('year')} ELSE '' END FROM registry
  UNION ALL SELECT row_ord, 'pdf_sha256', {S.clean('pdf_sha256')} FROM registry)"""
_COMP = """edges AS (SELECT DISTINCT a.row_ord AS a, b.m AS b FROM keys a JOIN (SELECT key_type, key, min(row_ord) AS m FROM keys WHERE key <> '' GROUP BY ALL HAVING count(*) > 1) b
    USING (key_type, key)),
  both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
  members AS (SELECT node AS row_ord, min(seen) AS component FROM reach GROUP BY node)"""
_FACTS = f"""facts AS (SELECT component, row_ord, paper_id, {S.is_malformed()} AS malformed, {S.is_supp_audit()} AS supp,
    content_kind = 'pdf_backed' AS pdf, nullif({S.doi(S.clean('doi'))}, '') AS k_doi, nullif({S.fold(S.clean('bibtex_key'))}, '') AS k_bib,
    nullif(CASE WHEN {S.norm(S.filled('resolved_title', 'title_query'))} <> '' AND {S.clean('year')} <> ''
      THEN {S.norm(S.filled('resolved_title', 'title_query'))} || '|' || {S.clean('year')} ELSE '' END, '') AS k_ty, nullif(pdf_sha256, '') AS k_sha,
    (CASE WHEN content_kind = 'pdf_backed' THEN 100 ELSE 0 END + CASE WHEN {S.is_supp_audit()} THEN 0 ELSE 50 END + CASE WHEN doi <> '' THEN 20 ELSE 0 END
      + CASE WHEN canonical_url <> '' THEN 10 ELSE 0 END + CASE WHEN match_status IN ('matched', 'matched_via_doi', 'manual_verified') THEN 5 ELSE 0 END
      + CASE WHEN contains(filename, ' - ') THEN 3 ELSE 0 END) AS points, doi <> '' AS has_doi
  FROM registry JOIN members USING (row_ord)),
  clusters AS (SELECT component, count(*) AS size, bool_or(malformed) AS mal, bool_and(pdf) AS all_pdf, bool_or(supp) AS any_supp, bool_and(supp) AS all_supp,
    count(DISTINCT k_doi) = 1 AS sd, count(DISTINCT k_bib) = 1 AS sb, count(DISTINCT k_ty) = 1 AS st, count(DISTINCT k_sha) = 1 AS ss,
    max_by(paper_id, [points::VARCHAR[1:0], lpad(points::VARCHAR, 6, '0'), pdf::INT::VARCHAR, (NOT supp)::INT::VARCHAR, has_doi::INT::VARCHAR, paper_id]) AS preferred FROM facts GROUP BY component),
  classified AS (SELECT *, CASE WHEN mal THEN 'malformed_rows' WHEN all_supp THEN 'supplement_cluster' WHEN any_supp AND all_pdf THEN 'main_plus_supplement'
    WHEN ss AND all_pdf THEN 'exact_pdf_content_duplicate' WHEN sd AND st AND all_pdf THEN 'likely_duplicate_pdf_copies'
    WHEN sb AND st THEN 'likely_duplicate_records' ELSE 'manual_review' END AS classification FROM clusters)""".replace("points::VARCHAR[1:0], ", "")


def _dups(body: str) -> str:
    return ("WITH RECURSIVE " + S.REGISTRY + ", " + _KEYS + ", " + _COMP + ", " + _FACTS + "\n" + body)


def _facts(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = linkage.linkable(V.registry(spark, sf))
    return rows, materialize(linkage.with_member_facts(linkage.duplicate_members(rows)), "facts")


@query("dup_keys", S.with_registry("SELECT key_type, key, count(*) AS n_rows, min(row_ord) AS first_ord FROM keys WHERE key <> '' GROUP BY ALL HAVING count(*) > 1", _KEYS))
def dup_keys(spark, sf):
    return linkage.shared_keys(linkage.relation_keys(linkage.linkable(V.registry(spark, sf))))


@query("dup_components", _dups("SELECT row_ord, component FROM members"))
def dup_components(spark, sf):
    rows = linkage.linkable(V.registry(spark, sf))
    return linkage.connected_components(linkage.star_edges(linkage.relation_keys(rows))).select(
        F.col("node").alias("row_ord"), "component")


@query("dup_classified", _dups("""SELECT component, size, classification, array_to_string(list_filter([CASE WHEN sd THEN 'same_doi' END, CASE WHEN sb THEN 'same_bibtex_key' END,
  CASE WHEN st THEN 'same_title_year' END, CASE WHEN ss THEN 'same_pdf_sha256' END], lambda x: x IS NOT NULL), '|') AS labels, preferred AS preferred_keep_paper_id FROM classified"""))
def dup_classified(spark, sf):
    _, facts = _facts(spark, sf)
    return linkage.classify_clusters(facts).select("component", "size", "classification", joined("shared_identity_labels").alias("labels"),
                                                   "preferred_keep_paper_id")


@query("dup_members", _dups("""SELECT component, paper_id, row_number() OVER (PARTITION BY component ORDER BY points DESC, pdf DESC, (NOT supp) DESC, has_doi DESC, paper_id DESC, row_ord) AS keep_rank FROM facts"""))
def dup_members(spark, sf):
    _, facts = _facts(spark, sf)
    return linkage.rank_members(facts).select("component", "paper_id", "keep_rank")


@query("dup_summary", _dups(f"""SELECT 'total_rows' AS measure, count(*) AS n FROM registry UNION ALL SELECT 'duplicate_groups', count(*) FROM classified
  UNION ALL SELECT 'malformed_singletons', count(*) FROM registry WHERE {S.is_malformed()} AND row_ord NOT IN (SELECT row_ord FROM members)
  UNION ALL SELECT 'class:' || classification, count(*) FROM classified GROUP BY 1"""))
def dup_summary(spark, sf):
    rows, facts = _facts(spark, sf)
    return linkage.summarize(rows, linkage.classify_clusters(facts), facts)


@query("dup_relation_counts", _dups("SELECT component, key_type, count(DISTINCT key) AS n_keys FROM keys JOIN members USING (row_ord) WHERE key <> '' GROUP BY ALL"))
def dup_relation_counts(spark, sf):
    rows, facts = _facts(spark, sf)
    return linkage.relation_counts(rows, facts)


_SAFE = """pairs AS (SELECT c.preferred AS keep_id, f.paper_id AS drop_id FROM facts f JOIN classified c USING (component)
  WHERE classification IN ('exact_pdf_content_duplicate', 'likely_duplicate_pdf_copies', 'likely_duplicate_records') AND f.paper_id <> c.preferred)"""


@query("merge_plan", _dups("SELECT keep_id, drop_id FROM (SELECT c.preferred AS keep_id, f.paper_id AS drop_id FROM facts f JOIN classified c USING (component) WHERE classification IN "
                           "('exact_pdf_content_duplicate', 'likely_duplicate_pdf_copies', 'likely_duplicate_records') AND f.paper_id <> c.preferred)"))
def merge_plan(spark, sf):
    _, facts = _facts(spark, sf)
    return linkage.plan_merges(facts, linkage.classify_clusters(facts))


# neighbours as merge pairs: every even row keeps, the next row drops
_PAIRS = "mp AS (SELECT 'doc-' || row_ord AS keep_id, 'doc-' || (row_ord + 1) AS drop_id FROM registry WHERE row_ord % 2 = 0 AND row_ord + 1 < (SELECT count(*) FROM registry))"
_SUPP_MERGE = S.any_of(S.fold("concat_ws(' ', " + ", ".join(f"nullif({S.clean('{r}.' + c)}, '')" for c in (
    "filename", "pdf_path", "resolved_title", "title_query", "notes", "match_status")) + ")"), K.SUPPLEMENT_TOKENS_MERGE)


def _same(e: str) -> str:
    return f"({e.replace('@', 'k.')} <> '' AND {e.replace('@', 'k.')} = {e.replace('@', 'd.')})"


_TITLE = "CASE WHEN @resolved_title <> '' THEN @resolved_title ELSE @title_query END"
_SIGNALS = [_same(S.doi("@doi")), _same(S.fold(S.clean("@bibtex_key"))), _same(S.clean("@pdf_sha256")),
            f"({_same(S.norm(_TITLE))} AND {S.clean('k.year')} = {S.clean('d.year')})"]


@query("merge_pairs", S.with_registry(f"""
  SELECT r.paper_id, {', '.join(f"CASE WHEN {S.clean('r.' + c)} <> '' THEN r.{c} WHEN {S.clean('d.' + c)} <> '' THEN {S.clean('d.' + c)} ELSE r.{c} END AS {c}"
                                for c in ('resolved_title', 'year', 'venue', 'doi', 'canonical_url', 'bibtex_key', 'notes'))}
  FROM registry r LEFT JOIN good g ON g.keep_id = r.paper_id LEFT JOIN registry d ON d.paper_id = g.drop_id
  WHERE r.paper_id NOT IN (SELECT drop_id FROM good)""", _PAIRS, f"""good AS (SELECT mp.* FROM mp JOIN registry k ON k.paper_id = keep_id JOIN registry d ON d.paper_id = drop_id
  WHERE ({' OR '.join(_SIGNALS)}) AND NOT ({_SUPP_MERGE.replace('{r}', 'd')} AND NOT {_SUPP_MERGE.replace('{r}', 'k')}))"""))
def merge_pairs(spark, sf):
    m = maintain.merge_pairs(V.registry(spark, sf), _neighbours(spark, sf))
    return m.registry.select("paper_id", "resolved_title", "year", "venue", "doi", "canonical_url", "bibtex_key", "notes")


def _neighbours(spark, sf) -> DataFrame:
    r = V.registry(spark, sf)
    n = V.documents(spark, sf).agg(F.count("*")).scalar()
    nid = lambda c: F.concat(F.lit("doc-"), c.cast("string"))
    return r.filter((F.col("row_ord") % 2 == 0) & (F.col("row_ord") + 1 < n)).select(
        nid(F.col("row_ord")).alias("keep_id"), nid(F.col("row_ord") + 1).alias("drop_id"))


@query("merge_refused", S.with_registry(f"""SELECT keep_id, drop_id, CASE WHEN NOT ({' OR '.join(_SIGNALS)}) THEN 'no_shared_identity' ELSE 'drop_is_supplement' END AS reason
  FROM mp JOIN registry k ON k.paper_id = keep_id JOIN registry d ON d.paper_id = drop_id
  WHERE NOT ({' OR '.join(_SIGNALS)}) OR ({_SUPP_MERGE.replace('{r}', 'd')} AND NOT {_SUPP_MERGE.replace('{r}', 'k')})""", _PAIRS))
def merge_refused(spark, sf):
    return maintain.merge_pairs(V.registry(spark, sf), _neighbours(spark, sf)).refused


# --- audits --------------------------------------------------------------------------------

@query("broken_audit", S.with_registry(f"""SELECT paper_id, array_to_string(issues, '|') AS issues, title FROM (SELECT paper_id, {S.filled('resolved_title', 'title_query', "'Untitled'")} AS title, list_filter([
  CASE WHEN {S.filled('resolved_title', 'title_query')} = '' THEN 'Missing title' END,
  CASE WHEN NOT regexp_matches(year, '^[0-9]+$') THEN 'Missing or invalid year' END,
  CASE WHEN venue = '' THEN 'Missing journal/venue' END, CASE WHEN bibtex_key = '' THEN 'Missing BibTeX key' END], lambda x: x IS NOT NULL) AS issues FROM registry) WHERE len(issues) > 0"""))
def broken_audit(spark, sf):
    return quality.broken_rows(V.registry(spark, sf)).select("paper_id", joined("issues").alias("issues"), "title")


@query("malformed_audit", S.with_registry(f"SELECT paper_id, title_query FROM registry WHERE {S.is_malformed()}"))
def malformed_audit(spark, sf):
    return quality.malformed_rows(V.registry(spark, sf)).select("paper_id", "title_query")


@query("row_summary", S.with_registry(f"""SELECT {S.clean('paper_id')} AS paper_id, {S.clean('year')} AS year, {S.clean(S.filled('resolved_title', 'title_query'))} AS title,
  {S.is_supp_audit()} AS supplement_like, {S.is_malformed()} AS malformed FROM registry"""))
def row_summary(spark, sf):
    return quality.row_summary(V.registry(spark, sf)).select("paper_id", "year", "title", "supplement_like", "malformed")


_RECON = S.any_of(S.fold("concat_ws(' ', filename, pdf_path, resolved_title, title_query, match_status)"), K.SUPPLEMENT_TOKENS_RECONCILE)
_BIBSUP = S.any_of(S.fold("concat_ws(' ', filename, pdf_path, resolved_title, title_query, match_status)"), K.SUPPLEMENT_TOKENS_BIB)


@query("supplement_flags", S.with_registry(f"""SELECT paper_id, {S.is_supp_audit()} AS audit, {_SUPP_MERGE.replace('{r}.', '')} AS merge, {_RECON} AS reconcile, {_BIBSUP} AS bib,
  CASE WHEN regexp_matches(filename, '\\bSI\\b', 'i') THEN ' - SI' ELSE '' END AS suffix FROM registry"""))
def supplement_flags(spark, sf):
    return V.registry(spark, sf).select("paper_id", *[quality.is_supplement(v).alias(v) for v in ("audit", "merge", "reconcile", "bib")],
                                        N.supplement_suffix("filename").alias("suffix"))


@query("filename_quality", S.with_registry("""SELECT paper_id, (length(stem) < 20 OR NOT contains(stem, ' - ') OR regexp_matches(stem, '^(?:[0-9A-Za-z]+[-_.]?)+$')) AS bad,
  regexp_matches(lower(stem), '^1-s2\\.0-|^elife-\\d+|^bio[a-z]*rxiv[-_]|^supplement|^full[-_ ]?text|^main$|^s\\d+(?:[-_.]\\d+)*$|^article$') AS downloaded,
  (length(stem) < 20 OR ((contains(stem, ' -') OR contains(stem, '- ')) AND NOT contains(stem, ' - '))) AS touchup
  FROM (SELECT paper_id, regexp_replace(filename, '\\.pdf$', '', 'i') AS stem FROM registry)"""))
def filename_quality(spark, sf):
    return V.registry(spark, sf).select("paper_id", quality.filename_looks_bad().alias("bad"), quality.filename_looks_downloaded().alias("downloaded"),
                                        quality.filename_needs_touchup().alias("touchup"))


@query("eligibility", S.with_registry(f"""SELECT paper_id, CASE WHEN content_kind <> 'pdf_backed' THEN 'not_pdf_backed' WHEN {_RECON} THEN 'supplement'
  WHEN row_ord % 5 = 0 THEN 'protected_source:manual_bibtex' WHEN row_ord % 5 = 2 THEN 'protected_source:manual_supplement_link'
  WHEN row_ord % 19 = 4 THEN 'invalid_record_filename:other.pdf' ELSE '' END AS skip_reason FROM registry"""))
def eligibility(spark, sf):
    meta = V.records(spark, sf).select("paper_id", "metadata_source", F.col("pdf_path").alias("record_pdf_path"), F.col("filename").alias("record_filename"))
    return quality.eligibility(V.registry(spark, sf).join(meta, "paper_id", "left")).select("paper_id", "skip_reason")


@query("record_integrity", S.with_registry("""SELECT paper_id, array_to_string(v, '|') AS violations FROM (SELECT paper_id, list_filter([
  CASE WHEN pdf_path <> '' AND row_ord % 19 = 4 THEN 'filename_mismatch' END, CASE WHEN pdf_path <> '' AND row_ord % 13 = 5 THEN 'pdf_not_found' END,
  CASE WHEN pdf_path <> '' AND row_ord % 13 <> 5 AND row_ord % 17 = 2 THEN 'sha256_mismatch' END], lambda x: x IS NOT NULL) AS v FROM registry) WHERE len(v) > 0"""))
def record_integrity(spark, sf):
    hashes = V.registry(spark, sf).filter("pdf_path <> '' and row_ord % 13 <> 5").select(
        F.concat(F.lit("/library/"), "pdf_path").alias("pdf_path"), F.col("pdf_sha256").alias("actual_sha256"))
    return quality.record_violations(V.records(spark, sf), hashes).select("paper_id", joined("violations").alias("violations"))


@query("stale_refs", S.with_registry("SELECT paper_id FROM registry WHERE content_kind = 'reference_only' AND row_ord % 5 = 0 OR (row_ord % 10 = 5 AND row_ord % 3 = 0)"))
def stale_refs(spark, sf):
    blank = F.col("row_ord") % 3 == 0
    r = V.registry(spark, sf).withColumn("content_kind", F.when(F.col("row_ord") % 10 == 5, "reference_only").otherwise(F.col("content_kind")))
    for c in ("resolved_title", "authors", "year", "venue", "bibtex_key"):
        r = r.withColumn(c, F.when(blank, "").otherwise(F.col(c)))
    return quality.stale_reference_rows(r, V.records(spark, sf))


@query("metadata_diff", S.with_registry(f"""SELECT paper_id, array_to_string(list_filter([CASE WHEN {S.filled('resolved_title')} <> wt AND wt <> '' THEN 'resolved_title' END,
    CASE WHEN wv <> '' AND venue <> wv THEN 'venue' END, CASE WHEN wy <> '' AND year <> wy THEN 'year' END], lambda x: x IS NOT NULL), '|') AS changed,
  array_to_string(list_filter([CASE WHEN year <> '' AND wy = '' THEN 'year' END], lambda x: x IS NOT NULL), '|') AS lost
  FROM (SELECT *, title_query AS wt, {S.venue('venue')} AS wv, CASE WHEN year = 'n/a' THEN '' ELSE (year::INT + row_ord % 3 - 1)::VARCHAR END AS wy FROM registry)"""))
def metadata_diff(spark, sf):
    y = F.col("year").try_cast("int")
    r = V.registry(spark, sf).withColumn("wt", F.col("title_query")).withColumn("wv", T.normalize_venue("venue")).withColumn(
        "wy", T.blank((y + (F.col("row_ord") % 3).cast("int") - 1).cast("string")))
    pairs = [("resolved_title", F.col("resolved_title"), F.col("wt")), ("venue", F.col("venue"), F.col("wv")), ("year", F.col("year"), F.col("wy"))]
    order = F.array(*[F.lit(n) for n, _, _ in pairs])
    changes = F.map_keys(quality.field_changes(pairs))
    return r.select("paper_id", joined(F.array_intersect(order, changes)).alias("changed"), joined(quality.metadata_losses(pairs[2:])).alias("lost"))


@query("untracked_items", S.with_registry("""SELECT path, filename, folder FROM (SELECT 'articles/' || source || '/doc_' || doc_id || CASE WHEN doc_id % 25 = 7 THEN ' - SI' ELSE '' END || '.pdf' AS path,
  'doc_' || doc_id || CASE WHEN doc_id % 25 = 7 THEN ' - SI' ELSE '' END || '.pdf' AS filename, source AS folder, doc_id FROM documents) WHERE doc_id % 10 = 9"""))
def untracked_items(spark, sf):
    files = V.documents(spark, sf).select(F.concat(F.lit("articles/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"),
                                                   F.when(F.col("doc_id") % 25 == 7, " - SI").otherwise(""), F.lit(".pdf")).alias("path"))
    return maintain.untracked(files, V.registry(spark, sf))


@query("not_indexed", S.with_registry("""SELECT path, sha256 FROM (SELECT 'articles/x/' || doc_id || '.pdf' AS path, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || 'x' END) AS sha256 FROM documents)
  WHERE sha256 NOT IN (SELECT pdf_sha256 FROM registry)"""))
def not_indexed(spark, sf):
    d = F.col("doc_id")
    files = V.documents(spark, sf).select(F.concat(F.lit("articles/x/"), d.cast("string"), F.lit(".pdf")).alias("path"),
                                          F.sha2(F.when(d % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))), 256).alias("sha256"))
    return maintain.not_indexed(files, V.registry(spark, sf)).select("path", "sha256")


# --- matching -------------------------------------------------------------------------------

_INC = """inc AS (SELECT row_ord AS ord, 'in-' || row_ord AS paper_id, CASE WHEN row_ord % 6 = 0 THEN semantic_scholar_paper_id ELSE '' END AS s2_id,
  CASE WHEN row_ord % 2 = 0 THEN upper(doi) ELSE '' END AS doi, upper(title_query) AS title, year FROM registry)"""


@query("unique_match_cascade", S.with_registry(f"""SELECT paper_id, coalesce(e.m, d.m, t.m, '') AS matched_id,
    CASE WHEN e.m IS NOT NULL THEN 'external_id' WHEN d.m IS NOT NULL THEN 'doi' WHEN t.m IS NOT NULL THEN 'title_year' ELSE '' END AS matched_by
  FROM inc LEFT JOIN (SELECT semantic_scholar_paper_id AS k, min(paper_id) AS m FROM registry WHERE semantic_scholar_paper_id <> '' GROUP BY 1 HAVING count(*) = 1) e ON e.k = inc.s2_id
  LEFT JOIN (SELECT {S.doi('doi')} AS k, min(paper_id) AS m FROM registry WHERE doi <> '' GROUP BY 1 HAVING count(*) = 1) d ON d.k = {S.doi('inc.doi')}
  LEFT JOIN (SELECT {S.norm(S.filled('resolved_title', 'title_query'))} AS k, year AS y, min(paper_id) AS m FROM registry GROUP BY 1, 2 HAVING count(*) = 1) t
    ON t.k = {S.norm('inc.title')} AND t.k <> '' AND t.y = inc.year""", _INC))
def unique_match_cascade(spark, sf):
    r = V.registry(spark, sf)
    return resolve.match_existing(_incoming(r), r).select("paper_id", "matched_id", "matched_by")


def _incoming(r: DataFrame) -> DataFrame:
    o = F.col("row_ord")
    return r.select(o.alias("ord"), F.concat(F.lit("in-"), o.cast("string")).alias("paper_id"),
                    F.when(o % 6 == 0, F.col("semantic_scholar_paper_id")).otherwise("").alias("s2_id"),
                    F.when(o % 2 == 0, F.upper("doi")).otherwise("").alias("doi"), F.upper("title_query").alias("title"), "year",
                    F.when(o % 4 == 1, F.col("pdf_sha256")).otherwise("none").alias("sha256"))


@query("file_duplicate_check", S.with_registry(f"""SELECT paper_id, coalesce(h.m, CASE WHEN r.content_kind = 'pdf_backed' THEN c.m END, '') AS duplicate_of FROM (
    SELECT inc.*, coalesce(e.m, d.m, t.m) AS m FROM inc
    LEFT JOIN (SELECT semantic_scholar_paper_id AS k, min(paper_id) AS m FROM registry WHERE semantic_scholar_paper_id <> '' GROUP BY 1 HAVING count(*) = 1) e ON e.k = inc.s2_id
    LEFT JOIN (SELECT {S.doi('doi')} AS k, min(paper_id) AS m FROM registry WHERE doi <> '' GROUP BY 1 HAVING count(*) = 1) d ON d.k = {S.doi('inc.doi')}
    LEFT JOIN (SELECT {S.norm(S.filled('resolved_title', 'title_query'))} AS k, year AS y, min(paper_id) AS m FROM registry GROUP BY 1, 2 HAVING count(*) = 1) t
      ON t.k = {S.norm('inc.title')} AND t.k <> '' AND t.y = inc.year) c
  LEFT JOIN (SELECT pdf_sha256 AS k, min_by(paper_id, row_ord) AS m FROM registry WHERE content_kind = 'pdf_backed' GROUP BY 1) h
    ON h.k = (SELECT pdf_sha256 FROM registry x WHERE x.row_ord = c.ord) AND c.ord % 4 = 1
  LEFT JOIN (SELECT paper_id AS pid, content_kind FROM registry) r ON r.pid = c.m""", _INC))
def file_duplicate_check(spark, sf):
    r = V.registry(spark, sf)
    return resolve.match_incoming_files(_incoming(r), r).select("paper_id", "duplicate_of")


def _parsed(spark, sf) -> DataFrame:
    return bib.parse_entries(V.bib_entries(spark, sf))


_BIBV = f"""bibv AS (SELECT row_ord AS ord, CASE WHEN row_ord % 8 = 1 THEN 'book' ELSE 'article' END AS entry_type, bibtex_key, {S.squeeze('resolved_title')} AS title, authors,
    CASE WHEN year = 'n/a' THEN '' ELSE year END AS year, CASE WHEN venue = '' THEN '{{}}' ELSE '{{' || venue || '}}' END AS venue_raw, doi AS doi_raw,
    '1' || (row_ord % 90 + 10) AS p1, '1' || (row_ord % 90 + 15) AS p2, row_ord % 8 = 1 AS book FROM registry WHERE bibtex_key <> '')"""


@query("bib_parse", S.with_registry("""SELECT ord, entry_type, bibtex_key, title, authors AS author, year, doi_raw AS doi, venue_raw AS venue,
  'n ' || ord AS x_local, p1 || '--' || p2 AS pages FROM bibv""", _BIBV))
def bib_parse(spark, sf):
    f = lambda n: T.blank(F.try_element_at("fields", F.lit(n)))
    return _parsed(spark, sf).select("ord", "entry_type", "bibtex_key", *[f(n).alias(n) for n in ("title", "author", "year", "doi")],
                                     T.first_filled(f("journal"), f("publisher")).alias("venue"), f("x-local").alias("x_local"), f("pages").alias("pages"))


_LINE = "CASE WHEN {v} <> '' THEN '  {n} = {{' || {v} || '}}' END"


def _line(n: str, v: str) -> str:
    return f"CASE WHEN {v} <> '' THEN '  {n} = {{' || {v} || '}}' END"


@query("bib_canonical", S.with_registry(f"""SELECT ord, CASE WHEN book THEN 'x-local' ELSE 'x-local' END AS ignored_fields,
  '@' || entry_type || '{{' || bibtex_key || ',' || chr(10) || array_to_string(list_filter(CASE WHEN book THEN
    [{_line('title', 'title')}, {_line('author', 'authors')}, {_line('year', 'year')}, {_line('publisher', 'venue_raw')}, {_line('pages', "p1 || '--' || p2")}, {_line('doi', S.doi('doi_raw'))}]
    ELSE [{_line('title', 'title')}, {_line('author', 'authors')}, {_line('year', 'year')}, {_line('journal', 'venue_raw')}, {_line('pages', "p1 || '--' || p2")}, {_line('doi', S.doi('doi_raw'))}] END,
    lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' || chr(10) AS raw
  FROM (SELECT * REPLACE (replace(venue_raw, '&amp;', '&') AS venue_raw) FROM bibv)""", _BIBV))
def bib_canonical(spark, sf):
    return bib.canonicalize(_parsed(spark, sf)).select("ord", joined("ignored_fields").alias("ignored_fields"), "raw")


@query("bib_audit", S.with_registry("""SELECT 'duplicate_key' AS kind, bibtex_key, ord, first AS other_ord FROM (SELECT *, min(ord) OVER (PARTITION BY k2) AS first, k2 AS bibtex_key2 FROM
    (SELECT ord, regexp_replace(bibtex_key, '[a-z]+$', '') AS k2 FROM bibv)) t(ord, bibtex_key, first, b) WHERE ord > first
  UNION ALL SELECT 'parse_error', '', ord, NULL FROM bibv WHERE ord % 29 = 1""".replace("FROM (SELECT *, min(ord) OVER (PARTITION BY k2) AS first, k2 AS bibtex_key2 FROM\n    (SELECT ord, regexp_replace(bibtex_key, '[a-z]+$', '') AS k2 FROM bibv)) t(ord, bibtex_key, first, b)",
   "FROM (SELECT ord, k2 AS bibtex_key, min(ord) OVER (PARTITION BY k2) AS first FROM (SELECT ord, regexp_replace(bibtex_key, '[a-z]+$', '') AS k2 FROM bibv WHERE ord % 29 <> 1))"), _BIBV))
def bib_audit(spark, sf):
    """Keys shortened so that some repeat, and every 29th entry broken."""
    e = V.bib_entries(spark, sf)
    short = F.regexp_replace("bibtex_key", "[a-z]+$", "")
    raw = F.replace("raw", F.concat(F.lit("{"), "bibtex_key", F.lit(",")), F.concat(F.lit("{"), short, F.lit(",")))
    broken = F.when(F.col("ord") % 29 == 1, F.concat(F.lit("@article{k,\n title {x}\n}"))).otherwise(raw)
    return bib.audit(bib.parse_entries(e.select("ord", broken.alias("raw")))).select("kind", "bibtex_key", "ord", "other_ord")


@query("bib_missing_fields", S.with_registry("""SELECT ord, array_to_string(list_filter([CASE WHEN title = '' THEN 'title' END, CASE WHEN year = '' THEN 'year' END], lambda x: x IS NOT NULL), '|') AS missing FROM bibv""", _BIBV))
def bib_missing_fields(spark, sf):
    return _parsed(spark, sf).select("ord", joined(quality.bib_missing_fields("entry_type", "fields")).alias("missing"))


@query("bib_representative", S.with_registry(f"""SELECT k AS bibtex_key, max_by(paper_id, [lpad(s::VARCHAR, 5, '0'), lpad(la::VARCHAR, 9, '0'), lpad(ld::VARCHAR, 5, '0'), lpad((999999999 - row_ord)::VARCHAR, 9, '0')]) AS paper_id, max(s)::BIGINT AS score
  FROM (SELECT *, CASE WHEN bibtex_key LIKE 'name1%' THEN 'name1' ELSE bibtex_key END AS k, length(abstract) AS la, length(doi) AS ld,
    (CASE WHEN {_BIBSUP} THEN 0 ELSE 100 END + CASE WHEN content_kind = 'pdf_backed' THEN 20 ELSE 0 END + (resolved_title <> '')::INT + (authors <> '')::INT + (year <> '')::INT + (venue <> '')::INT
      + (doi <> '')::INT + (canonical_url <> '')::INT + (abstract <> '')::INT) AS s
    FROM (SELECT *, CASE WHEN row_ord % 5 = 0 THEN 'Manual abstract' WHEN row_ord % 5 <> 2 AND row_ord % 2 = 0 THEN 'Abstract &amp; <b>more</b> ' || row_ord
      WHEN row_ord % 5 <= 1 THEN '<p>Work ' || row_ord || '</p>' ELSE '' END AS abstract FROM registry WHERE bibtex_key <> '')) GROUP BY 1"""))
def bib_representative(spark, sf):
    r = V.registry(spark, sf).withColumn("bibtex_key", F.when(F.startswith("bibtex_key", F.lit("name1")), "name1").otherwise(F.col("bibtex_key")))
    return bib.representatives(r, V.records(spark, sf)).select("bibtex_key", "paper_id", F.col("representative_score").cast("bigint").alias("score"))


@query("record_detail", S.with_registry("""SELECT r.paper_id, r.bibtex_key, CASE WHEN row_ord % 5 = 1 THEN 'matched_via_doi' ELSE match_status END AS record_status, coalesce(length(regexp_extract(k, '.*')), 0)::INT AS key_chars
  FROM registry r LEFT JOIN (SELECT DISTINCT bibtex_key AS k FROM registry WHERE bibtex_key <> '') ON k = r.bibtex_key WHERE row_ord % 2 = 0"""))
def record_detail(spark, sf):
    r = V.registry(spark, sf)
    d = search.record_detail(r.filter("row_ord % 2 = 0").select("paper_id"), r, V.records(spark, sf).drop("row_ord"), _parsed(spark, sf).filter("error = ''"))
    key = F.regexp_extract(T.blank("raw_bibtex"), r"\{([^,]*),", 1)
    return d.select("paper_id", "bibtex_key", F.col("record.match_status").alias("record_status"), F.length(key).alias("key_chars"))


@query("bib_journals_normalized", S.with_registry(f"""SELECT ord, {S.venue("replace(replace(venue_raw, '{', ''), '}', '')")} AS journal FROM bibv WHERE NOT book""", _BIBV))
def bib_journals_normalized(spark, sf):
    plain = _parsed(spark, sf).filter("entry_type = 'article'").withColumn("fields", F.transform_values(
        "fields", lambda k, v: F.regexp_replace(v, r"^\{|\}$", "")))
    return maintain.normalize_bib_journals(plain)[0].select("ord", T.blank(F.try_element_at("fields", F.lit("journal"))).alias("journal"))


@query("new_supplements", S.with_registry("""SELECT 'sha256-' || substr(sha256(d.text || 'S'), 1, 16) AS paper_id, CASE WHEN p.resolved_title <> '' THEN p.resolved_title WHEN p.title_query <> '' THEN p.title_query ELSE 'Untitled' END AS resolved_title,
  p.bibtex_key, 'S' || d.doc_id AS title_query FROM documents d JOIN registry p ON p.row_ord = d.doc_id"""))
def new_supplements(spark, sf):
    d = F.col("doc_id")
    inc = V.documents(spark, sf).select(d.alias("ord"), F.concat(F.lit("articles/s/S"), d.cast("string"), F.lit(".pdf")).alias("path"),
                                        F.concat("text", F.lit("S")).alias("text"), F.concat(F.lit("doc-"), d.cast("string")).alias("parent_id"))
    return maintain.link_new_supplements(V.registry(spark, sf), inc).select("paper_id", "resolved_title", "bibtex_key", "title_query")


@query("bib_rebuild")
def bib_rebuild(spark, sf):
    return bib.rebuild_bibliography(V.registry(spark, sf), V.records(spark, sf), _parsed(spark, sf)).select("bibtex_key", "entry_type", "raw")


@query("bib_abbreviated", S.with_registry("""SELECT bibtex_key, CASE WHEN s IS NOT NULL THEN s ELSE venue END AS journal FROM (SELECT bibtex_key, venue, row_ord FROM registry WHERE bibtex_key <> '' AND row_ord % 8 <> 1)
  LEFT JOIN (SELECT journal, max_by(replace(citation_abbreviation, '.', ''), ord) AS s FROM journals GROUP BY 1) ON journal = venue""", S.JOURNALS))
def bib_abbreviated(spark, sf):
    plain = _parsed(spark, sf).filter("entry_type = 'article'").withColumn("fields", F.transform_values(
        "fields", lambda k, v: F.regexp_replace(v, r"^\{|\}$", "")))
    return bib.abbreviate_journals(plain, V.journals(spark, sf), strip_dots=True).select(
        "bibtex_key", T.blank(F.try_element_at("fields", F.lit("journal"))).alias("journal"))


@query("bib_type_migration", S.with_registry("""SELECT paper_id, CASE WHEN bibtex_key <> '' THEN (CASE WHEN l % 8 = 1 THEN 'book' ELSE 'article' END) WHEN bibtex_type <> '' THEN bibtex_type ELSE 'article' END AS bibtex_type
  FROM registry LEFT JOIN (SELECT bibtex_key AS k, max(row_ord) AS l FROM registry GROUP BY 1) ON k = bibtex_key"""))
def bib_type_migration(spark, sf):
    return bib.field_types_for_registry(V.registry(spark, sf), _parsed(spark, sf)).select("paper_id", "bibtex_type")


_ASK = """ask AS (SELECT paper_id, CASE WHEN row_ord % 3 = 0 THEN bibtex_key ELSE '' END AS existing_key, resolved_title AS title, authors, year, CASE WHEN row_ord % 2 = 0 THEN doi ELSE '' END AS doi, row_ord FROM registry)"""


@query("bib_entry_cascade", S.with_registry(f"""SELECT paper_id, coalesce(bk, bd, bdt, bty, bau, bt, '') AS entry_key, CASE WHEN bk IS NOT NULL THEN 'key' WHEN bd IS NOT NULL THEN 'doi' WHEN bdt IS NOT NULL THEN 'doi_title'
    WHEN bty IS NOT NULL THEN 'title_year' WHEN bau IS NOT NULL THEN 'author' WHEN bt IS NOT NULL THEN 'title' ELSE '' END AS matched_by FROM (
  SELECT a.*, (SELECT max_by(bibtex_key, ord) FROM e WHERE e.bibtex_key = a.existing_key) AS bk,
    (SELECT CASE WHEN count(*) = 1 THEN min(bibtex_key) END FROM e WHERE e.doi = a.d AND a.d <> '') AS bd,
    (SELECT CASE WHEN count(*) = 1 THEN min(bibtex_key) END FROM e WHERE e.doi = a.d AND a.d <> '' AND e.t = a.t AND e.year = a.year) AS bdt,
    (SELECT CASE WHEN count(*) = 1 THEN min(bibtex_key) END FROM e WHERE e.t = a.t AND a.t <> '' AND a.year <> '' AND e.year = a.year) AS bty,
    (SELECT CASE WHEN count(*) = 1 THEN min(bibtex_key) END FROM e WHERE e.t = a.t AND a.t <> '' AND a.year <> '' AND e.year = a.year AND list_has_any(e.au, a.au)) AS bau,
    (SELECT CASE WHEN count(*) = 1 THEN min(bibtex_key) END FROM e WHERE e.t = a.t AND a.t <> '') AS bt
  FROM (SELECT *, {S.doi('doi')} AS d, {S.norm('title')} AS t, list_filter({S.tokens('authors')}, lambda w: length(w) >= 3) AS au FROM ask) a)""",
  _BIBV, _ASK, f"e AS (SELECT ord, bibtex_key, {S.doi('doi_raw')} AS doi, {S.norm('title')} AS t, year, list_filter({S.tokens('authors')}, lambda w: length(w) >= 3) AS au FROM bibv)"))
def bib_entry_cascade(spark, sf):
    o = F.col("row_ord")
    ask = V.registry(spark, sf).select("paper_id", F.when(o % 3 == 0, F.col("bibtex_key")).otherwise("").alias("existing_key"), F.col("resolved_title").alias("title"),
                                       "authors", "year", F.when(o % 2 == 0, F.col("doi")).otherwise("").alias("doi"))
    return bib.match_entries(ask, _parsed(spark, sf)).select("paper_id", "entry_key", "matched_by")


# --- text jobs ---------------------------------------------------------------------------

@query("markup_strip", f"""SELECT page_id, {S.squeeze(S.sub('html', '<[^>]+>', ' '))} AS text FROM pages""")
def markup_strip(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("text"))


@query("markup_unescaped", f"""SELECT page_id, {S.squeeze(S.sub("replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')", '<[^>]+>', ' '))} AS text FROM pages""")
def markup_unescaped(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.strip_tags(arrow.html_unescape(F.col("html"))).alias("text"))


@query("chunks", """
  WITH RECURSIVE lines AS (SELECT doc_id, text, trim(l, ' ') AS p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
      SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l, ' ') <> ''),
  ends AS (SELECT doc_id, max(i) AS n FROM lines GROUP BY 1),
  fold AS (SELECT doc_id, 1::BIGINT AS i, p AS cur, 0::BIGINT AS frm, NULL::VARCHAR AS out, NULL::BIGINT AS s, NULL::BIGINT AS k FROM lines WHERE i = 1
    UNION ALL
    SELECT f.doc_id, f.i + 1, CASE WHEN fits THEN f.cur || chr(10) || chr(10) || l.p ELSE l.p END,
      CASE WHEN fits THEN f.frm ELSE greatest(0, hit + length(f.cur) - 60) END, CASE WHEN fits THEN NULL ELSE f.cur END, CASE WHEN fits THEN NULL ELSE hit END, f.i
    FROM (SELECT f.*, length(f.cur) + 2 + length(l.p) <= 500 AS fits,
            CASE WHEN strpos(substr(l.text, (f.frm + 1)::BIGINT), f.cur) > 0 THEN f.frm + strpos(substr(l.text, (f.frm + 1)::BIGINT), f.cur) - 1 ELSE f.frm END AS hit, l.p AS p
          FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1) f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
  closed AS (SELECT doc_id, i, out AS text, s FROM fold WHERE out IS NOT NULL
    UNION ALL SELECT f.doc_id, f.i + 1, f.cur, CASE WHEN strpos(substr(d.text, (f.frm + 1)::BIGINT), f.cur) > 0 THEN f.frm + strpos(substr(d.text, (f.frm + 1)::BIGINT), f.cur) - 1 ELSE f.frm END
      FROM fold f JOIN ends e ON e.doc_id = f.doc_id AND e.n = f.i JOIN documents d ON d.doc_id = f.doc_id)
  SELECT 'doc-' || doc_id || ':chunk-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR, 4, '0') AS chunk_id, s AS char_start, s + length(text) AS char_end, text FROM closed""")
def chunks_query(spark, sf):
    """Lines as paragraphs, since the given texts have no blank lines."""
    return chunks.chunk_texts(V.texts(spark, sf), 500, 60, "\n").select("chunk_id", "char_start", "char_end", "text")


@query("chunks_default", f"""SELECT 'doc-' || doc_id || ':chunk-0001' AS chunk_id, strpos(text, s) - 1 AS char_start, strpos(text, s) - 1 + length(s) AS char_end, sha256(text) AS text_sha256
  FROM (SELECT *, {S.strip('text')} AS s FROM documents) WHERE s <> ''""")
def chunks_default(spark, sf):
    return chunks.chunk_texts(V.texts(spark, sf)).select("chunk_id", "char_start", "char_end", "text_sha256")


@query("reference_stubs", S.with_registry(f"""SELECT paper_id, 'REFERENCE ONLY - NO PDF ATTACHED' || chr(10) || {S.squeeze('resolved_title')} || chr(10) || 'Authors: ' || authors || chr(10) || 'Year: ' || year || chr(10) || 'Venue: ' || {S.venue('venue')}
  || chr(10) || 'DOI: ' || {S.doi('doi')} || chr(10) || 'URL: ' || canonical_url || chr(10) || 'Abstract: ' || chr(10) || rtrim('BibTeX key: ' || bibtex_key) || chr(10) AS text FROM registry"""))
def reference_stubs(spark, sf):
    return V.registry(spark, sf).select("paper_id", chunks.stub_text("resolved_title", "authors", "year", "venue", "doi", "canonical_url", F.lit(""), "bibtex_key").alias("text"))


_PLANTED = """planted AS (SELECT doc_id, 'doc-' || doc_id AS paper_id, 'Name' || (doc_id % 97) || ' ' || (1980 + n_chars % 45) || ' NatGenet - '
    || regexp_replace(head, '[/]', ' ', 'g') || '.pdf' AS filename,
  CASE WHEN doc_id % 3 = 1 THEN head || chr(10) || 'https://doi.org/' || pd || substr(text, length(head) + 1)
    WHEN doc_id % 3 = 2 THEN text || chr(10) || 'References' || chr(10) || 'cited by doi: ' || pd || '. 10.1234/abc.' ELSE text END AS text
  FROM (SELECT *, split_part(text, chr(10), 1) AS head, '10.1234/abc.' || lpad(doc_id::VARCHAR, 6, '0') AS pd FROM documents))"""
_DOIS = f"""windows AS (SELECT paper_id, 'filename' AS region, 0.2 AS base, 0 AS w, filename AS t FROM planted
    UNION ALL SELECT paper_id, 'first_page', 0.45, 1, substr(text, 1, 6000) FROM planted UNION ALL SELECT paper_id, 'front_window', 0.35, 2, substr(text, 1, 6000) FROM planted
    UNION ALL SELECT paper_id, 'broad_window', 0.15, 3, substr(text, 1, 20000) FROM planted
    UNION ALL SELECT paper_id, 'body', 0.05, 4, text FROM planted),
  raw AS (SELECT DISTINCT * FROM (SELECT *, regexp_replace(unnest(regexp_extract_all(t, '(?i)\\b10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+\\b')), '[.,);\\]]+$', '') AS d FROM windows)),
  placed AS (SELECT *, strpos(lower(t), lower(d)) - 1 AS pos FROM raw WHERE length(regexp_replace(d, '^[^/]*/', '')) >= 8 AND regexp_matches(regexp_replace(d, '^[^/]*/', ''), '[0-9]')),
  ctx AS (SELECT *, lower({S.squeeze('substr(t, greatest(0, pos - 90) + 1, pos + length(d) + 90 - greatest(0, pos - 90))')}) AS low FROM placed),
  scored AS (SELECT paper_id, d AS doi, region, pos, w, round(base + CASE WHEN pos < 300 THEN 0.2 WHEN pos < 1200 THEN 0.12 WHEN pos < 4000 THEN 0.05 ELSE 0.0 END
    + CASE WHEN contains(low, 'doi:') OR contains(low, 'doi.org/') THEN 0.18 ELSE 0.0 END - CASE WHEN regexp_matches(low, 'references|bibliography|cited by|et al[.]') THEN 0.2 ELSE 0.0 END, 4)::DOUBLE AS pr FROM ctx),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, doi ORDER BY pr DESC, pos, w) AS k FROM scored) WHERE k = 1),
  dois AS (SELECT paper_id, doi, region, pos, pr, (row_number() OVER (PARTITION BY paper_id ORDER BY pr DESC, pos, doi DESC) - 1)::INT AS place FROM best)"""


@query("doi_candidates", f"WITH {_PLANTED}, {_DOIS} SELECT paper_id, place, doi, region AS source_region, pos::INT AS position, pr AS priority_score FROM dois")
def doi_candidates(spark, sf):
    d = V.planted_texts(spark, sf).select("paper_id", F.posexplode(P.doi_candidates("text", "filename")).alias("place", "c"))
    return d.select("paper_id", "place", "c.doi", "c.source_region", "c.position", "c.priority_score")


@query("doi_extract", f"""SELECT 'doc-' || doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '10.1234/abc.' || lpad(doc_id::VARCHAR, 6, '0') END AS dois FROM documents""")
def doi_extract(spark, sf):
    """Every DOI in the whole text; truncated fragments are left out."""
    return V.planted_texts(spark, sf).select("paper_id", joined(P.dois_in("text")).alias("dois"))


@query("title_candidates")
def title_candidates(spark, sf):
    return V.texts(spark, sf).select("paper_id", joined(P.title_candidates("text")).alias("titles"))


@query("filename_hints", """SELECT 'doc-' || doc_id AS paper_id, (1980 + n_chars % 45)::INT AS year_hint, 'naturegenetics' AS venue_hint FROM documents""")
def filename_hints(spark, sf):
    return P.with_filename_hints(V.planted_texts(spark, sf).drop("text")).select("paper_id", "year_hint", "venue_hint")


@query("filename_titles", f"""WITH {_PLANTED} SELECT paper_id, CASE WHEN len(c) >= 3 THEN {S.titleish('c[-1]')} WHEN len(c) = 2 AND len({S.words(S.titleish('c[2]'))}) >= 4 THEN {S.titleish('c[2]')}
  WHEN len(c) = 2 THEN {S.titleish("c[1] || ' ' || c[2]")} ELSE '' END AS title_query
  FROM (SELECT paper_id, list_filter(list_transform(string_split(replace(regexp_replace(filename, '[.][^.]*$', ''), '_', ' '), ' - '), lambda x: trim(x)), lambda x: x <> '') AS c FROM planted)""")
def filename_titles(spark, sf):
    return P.with_title_query(V.planted_texts(spark, sf).drop("text")).select("paper_id", "title_query")


# --- similarity and resolution ----------------------------------------------------------------

_CAND = """cand AS (SELECT DISTINCT """ + S.norm("t") + """ AS t FROM (SELECT CASE WHEN row_ord % 3 = 0 THEN array_to_string(list_slice(string_split(title_query, ' '), 1, greatest(1, len(string_split(title_query, ' ')) - 1)), ' ')
  WHEN row_ord % 3 = 1 THEN title_query ELSE array_to_string(list_reverse(string_split(title_query, ' ')), ' ') END AS t FROM registry))"""


def _sim_oracle(theta: float) -> str:
    return S.with_registry(f"""SELECT q_norm, t_norm, round(s, 4) AS similarity FROM (SELECT a.q AS q_norm, b.t AS t_norm, {S.sim('a.q', 'b.t', 'a.k', 'b.k')} AS s
      FROM (SELECT q, {S.tokens('q')} AS k FROM qs WHERE q <> '') a, (SELECT t, {S.tokens('t')} AS k FROM cand WHERE t <> '') b) WHERE s >= {theta}""",
        _CAND, "qs AS (SELECT DISTINCT " + S.norm("title_query") + " AS q FROM registry)")


@query("similarity_join", _sim_oracle(0.7))
def similarity_join(spark, sf):
    return similarity.similar_titles(V.registry(spark, sf), "title_query", V.candidates(spark, sf), "title", 0.7).select(
        "q_norm", "t_norm", r4(F.col("similarity")).alias("similarity"))


@query("similarity_benchmark", f"""SELECT q AS q_norm, t AS t_norm, round(s, 4) AS similarity FROM (SELECT q, t, {S.sim('q', 't', 'qk', 'tk')} AS s FROM
    (SELECT q, {S.tokens('q')} AS qk FROM (SELECT DISTINCT {S.norm("split_part(text, chr(10), 1)")} AS q FROM benchmark) WHERE q <> ''),
    (SELECT t, {S.tokens('t')} AS tk FROM (SELECT DISTINCT {S.norm('l')} AS t FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE t <> '')) WHERE s >= 0.9""")
def similarity_benchmark(spark, sf):
    """First lines of the benchmark items against every line of every document."""
    items = V.table(spark, sf, "benchmark").select(F.substring_index("text", "\n", 1).alias("q"))
    lines = V.documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("l"))
    return similarity.similar_titles(items, "q", lines, "l", 0.9).select("q_norm", "t_norm", r4(F.col("similarity")).alias("similarity"))


_WORKT = """CASE WHEN row_ord % 11 = 2 THEN 'Abstract' WHEN row_ord % 5 = 1 THEN array_to_string(list_slice(string_split(title_query, ' '), 1, greatest(1, len(string_split(title_query, ' ')) - 1)), ' ')
  WHEN row_ord % 7 = 3 THEN 'Unrelated report ' || row_ord ELSE title_query END"""


@query("doi_resolution", S.with_registry(f"""SELECT paper_id, doi AS best_doi, round(score, 4) AS best_score, CASE WHEN score >= 0.55 THEN 'accepted' WHEN score >= 0.35 THEN 'review' ELSE 'rejected' END AS decision, attempts
  FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS attempts, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pr DESC, place) AS k FROM (
    SELECT paper_id, doi, pr, place, CASE WHEN wn IN ('', 'abstract', 'proceedings of the national academy of sciences') THEN -1.0 ELSE {S.sim('q', 'wn', 'qt', 'wt')}
      + CASE WHEN wy = hint THEN 0.08 WHEN abs(wy - hint) = 1 THEN 0.03 ELSE 0.0 END + CASE WHEN vk = 'naturegenetics' THEN 0.08 ELSE 0.0 END END AS score FROM (
      SELECT d.*, {S.norm('r.title_query')} AS q, {S.tokens(S.norm('r.title_query'))} AS qt, {S.norm('w.t')} AS wn, {S.tokens(S.norm('w.t'))} AS wt, w.y AS wy,
        (SELECT 1980 + n_chars % 45 FROM documents x WHERE 'doc-' || x.doc_id = d.paper_id) AS hint, {S.venue_key('w.v')} AS vk
      FROM dois d JOIN registry r USING (paper_id) JOIN (SELECT '10.1234/abc.' || lpad(row_ord::VARCHAR, 6, '0') AS wd, {_WORKT} AS t, year, {S.venue("CASE WHEN venue = 'bioRxiv' THEN 'Nature Genetics' ELSE venue END")} AS v,
        CASE WHEN year <> 'n/a' THEN year::INT + row_ord % 3 - 1 END AS y FROM registry) w ON w.wd = lower(d.doi)))) WHERE k = 1""", _PLANTED, _DOIS))
def doi_resolution(spark, sf):
    """Targets are the registry titles, so that SQL can follow."""
    texts = P.with_filename_hints(V.planted_texts(spark, sf)).select(
        "paper_id", "year_hint", "venue_hint", P.doi_candidates("text", "filename").alias("doi_candidates"))
    facts = texts.join(V.registry(spark, sf).select("paper_id", "title_query"), "paper_id").withColumn(
        "title_candidates", F.array().cast("array<string>"))
    return resolve.resolve_dois(facts, V.works(spark, sf)).select(
        "paper_id", "best_doi", r4(F.col("best_score")).alias("best_score"), "decision", "attempts")


@query("doi_resolution_titles")
def doi_resolution_titles(spark, sf):
    facts = materialize(resolve.with_text_facts(V.planted_texts(spark, sf)), "text_facts")
    return resolve.resolve_dois(facts, V.works(spark, sf)).select(
        "paper_id", "best_doi", r4(F.col("best_score")).alias("best_score"), "decision", "attempts", joined("warnings").alias("warnings"))


_RETRIEVED = f"""cands AS (SELECT 'C' || row_ord AS id, t, CASE WHEN year = 'n/a' THEN '' ELSE (year::INT + row_ord % 4 - 1)::VARCHAR END AS cy, {S.norm('t')} AS tn FROM (SELECT *,
      CASE WHEN row_ord % 3 = 0 THEN array_to_string(list_slice(string_split(title_query, ' '), 1, greatest(1, len(string_split(title_query, ' ')) - 1)), ' ')
        WHEN row_ord % 3 = 1 THEN title_query ELSE array_to_string(list_reverse(string_split(title_query, ' ')), ' ') END AS t FROM registry)),
  tn AS (SELECT tn, {S.tokens('tn')} AS tt FROM (SELECT DISTINCT tn FROM cands WHERE tn <> '')),
  qn AS (SELECT qn, {S.tokens('qn')} AS qt FROM (SELECT DISTINCT {S.norm('title_query')} AS qn FROM registry) WHERE qn <> ''),
  pairs AS (SELECT qn, tn, s FROM (SELECT qn.qn, tn.tn, {S.sim('qn.qn', 'tn.tn', 'qt', 'tt')} AS s FROM qn, tn) WHERE s >= 0.63),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tn ORDER BY id) AS k FROM cands WHERE tn <> '') WHERE k <= 10),
  found AS (SELECT * FROM (SELECT p.qn, p.s, c.id, c.cy, c.t, row_number() OVER (PARTITION BY p.qn ORDER BY p.s DESC, c.id) AS n FROM pairs p JOIN pool c USING (tn)) WHERE n <= 10)"""


@query("candidate_rank", S.with_registry(f"""SELECT r.paper_id, row_number() OVER (PARTITION BY r.paper_id ORDER BY round(s, 4) DESC, cy DESC, t DESC, 'paper:' || id DESC) AS rank, 'paper:' || id AS identity,
  round(s, 4) AS score, round(s, 4) AS similarity FROM registry r JOIN found ON qn = {S.norm('r.title_query')} WHERE r.title_query <> ''""", _RETRIEVED))
def candidate_rank(spark, sf):
    facts = P.with_filename_hints(V.registry(spark, sf).select("paper_id", "filename", "item_type", "title_query"))
    queries = facts.filter("title_query <> ''").select("paper_id", F.lit(0).alias("ord"), F.col("title_query").alias("query"), "filename", "item_type", "year_hint", "venue_hint")
    attempts = resolve.candidate_attempts(queries, resolve.retrieve_candidates(queries, V.candidates(spark, sf)))
    return resolve.merge_candidates(attempts).select("paper_id", F.col("rank").cast("bigint").alias("rank"), "identity", "score", "similarity")


@query("candidate_choice", S.with_registry(f"""SELECT r.paper_id, r.title_query AS query, CASE WHEN s IS NULL THEN 'not_found' WHEN s >= 0.9 THEN 'matched' WHEN s >= 0.75 THEN 'needs_manual_review' ELSE 'not_found' END AS status,
  coalesce(s, 0.0)::DOUBLE AS best_score, coalesce(n, 0)::INT AS n_candidates, id AS candidate FROM registry r LEFT JOIN (SELECT qn, round(max(s), 4) AS s, count(*) AS n, min_by(id, n) AS id FROM found GROUP BY qn) f
  ON f.qn = {S.norm('r.title_query')} WHERE r.title_query <> ''""", _RETRIEVED))
def candidate_choice(spark, sf):
    facts = P.with_filename_hints(V.registry(spark, sf).select("paper_id", "filename", "item_type", "title_query"))
    queries = facts.filter("title_query <> ''").select("paper_id", F.lit(0).alias("ord"), F.col("title_query").alias("query"), "filename", "item_type", "year_hint", "venue_hint")
    attempts = resolve.candidate_attempts(queries, resolve.retrieve_candidates(queries, V.candidates(spark, sf)))
    return resolve.choose_attempt(attempts).select("paper_id", "query", "status", "best_score", "n_candidates", F.col("best.c.paperId").alias("candidate"))


@query("supplement_parents", S.with_registry(f"""SELECT paper_id, pid AS parent_id, round(s, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY s DESC, po) AS k FROM (
    SELECT a.paper_id, p.paper_id AS pid, p.row_ord AS po, {S.sim('a.q', 'p.t', 'a.qt', 'p.tt')} AS s FROM (
      SELECT *, EXISTS (SELECT 1 FROM parents x WHERE dir <> '' AND starts_with(x.pdf_path, dir || '/')) AS scoped FROM (SELECT paper_id, regexp_replace(pdf_path, '/[^/]*$', '') AS dir, {S.norm('title_query')} AS q,
        {S.tokens(S.norm('title_query'))} AS qt FROM registry WHERE ({S.is_supp_audit()} OR row_ord % 5 >= 3) AND len({S.words('title_query')}) >= 4)) a
    JOIN parents p ON (NOT a.scoped OR starts_with(p.pdf_path, a.dir || '/'))) WHERE s >= 0.9) WHERE k = 1""",
  f"parents AS (SELECT paper_id, row_ord, pdf_path, t, {S.tokens('t')} AS tt FROM (SELECT *, {S.norm(S.filled('resolved_title', 'title_query'))} AS t FROM registry WHERE match_status IN ('matched', 'matched_via_doi', 'matched_supplement')) WHERE t <> '')"))
def supplement_parents(spark, sf):
    r = V.registry(spark, sf)
    supp = r.filter(quality.is_supplement("audit") | (F.col("row_ord") % 5 >= 3)).select("paper_id", "pdf_path", F.array("title_query").alias("title_candidates"))
    return resolve.supplement_parents(supp, r).select("paper_id", "parent_id", r4(F.col("similarity")).alias("similarity"))


@query("resolve_all")
def resolve_all(spark, sf):
    t = V.planted_texts(spark, sf).withColumn("pdf_path", F.concat(F.lit("articles/src1/"), "filename")).withColumn("item_type", F.lit("article"))
    return resolve.resolve(t, V.works(spark, sf), V.candidates(spark, sf), V.registry(spark, sf)).select(
        "paper_id", "match_status", "metadata_source", "resolved_title", "authors", "year", "venue", "doi", "match_confidence", "notes")


# --- citations ----------------------------------------------------------------------------

_CITED = """cites AS (SELECT conv_id::VARCHAR AS doc_id, turn AS pos, (conv_id * 7 + turn * 3) % (SELECT count(*) FROM documents) AS i0, (conv_id * 7 + turn) % (SELECT count(*) FROM documents) AS i1 FROM conversations),
  cited AS (SELECT doc_id, pos, idx, bibtex_key FROM (SELECT doc_id, pos, 0 AS idx, i0 AS i FROM cites UNION ALL SELECT doc_id, pos, 1, i1 FROM cites) JOIN registry ON row_ord = i WHERE bibtex_key <> ''),
  nums AS (SELECT doc_id, bibtex_key, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos * 10 + idx)) AS number FROM cited GROUP BY doc_id, bibtex_key)"""


def _cited(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = V.citations(spark, sf)
    keys = V.registry(spark, sf).filter("bibtex_key <> ''").select("bibtex_key")
    return c, materialize(cite.cited_keys(c, V.registry(spark, sf), keys), "cited")


@query("cite_numbers", S.with_registry("SELECT doc_id, bibtex_key, number FROM nums", _CITED))
def cite_numbers(spark, sf):
    return cite.number_citations(_cited(spark, sf)[1])


@query("cite_texts", S.with_registry("""SELECT c.doc_id, c.pos, coalesce(string_agg(n, ',' ORDER BY number), '') AS citation FROM cites c LEFT JOIN (SELECT DISTINCT doc_id, pos, number, number::VARCHAR AS n FROM cited JOIN nums USING (doc_id, bibtex_key)) x
  ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY c.doc_id, c.pos""", _CITED))
def cite_texts(spark, sf):
    c, cited = _cited(spark, sf)
    return cite.citation_texts(c, cited, cite.number_citations(cited))


@query("cite_nar", S.with_registry(f"""SELECT bibtex_key, trim(concat_ws(' ', 'Name' || (ord % 97) || ' A, Name' || (ord % 13) || ' B.', CASE WHEN title <> '' THEN title || '.' END, CASE WHEN jn <> '' THEN jn || '.' END,
    concat_ws(':', nullif(year, ''), p1 || '–' || CASE WHEN p1[2] = p2[2] THEN substr(p2, 3) ELSE substr(p2, 2) END) || '.', CASE WHEN d <> '' THEN 'doi:' || d END)) AS citation
  FROM (SELECT *, {S.doi('doi_raw')} AS d, {S.squeeze("replace(coalesce(nullif(cite, ''), vn), '.', ' ')")} AS jn FROM (SELECT *, {S.venue("replace(venue_raw, '&amp;', '&')")} AS vn FROM bibv) LEFT JOIN jl ON vc = vn)""",
  _BIBV, S.JOURNALS, S.JOURNAL_LOOKUP))
def cite_nar(spark, sf):
    return cite.render_nar(bib.with_normalized(_parsed(spark, sf)), V.journals(spark, sf))


# --- journals -------------------------------------------------------------------------------

@query("journal_join", S.with_registry(f"""SELECT paper_id, {S.venue('venue')} AS venue_canon, coalesce(cite, '') AS citation_abbreviation, coalesce(file, '') AS filename_abbreviation
  FROM registry LEFT JOIN jl ON vc = {S.venue('venue')}""", S.JOURNALS, S.JOURNAL_LOOKUP))
def journal_join(spark, sf):
    return index.join_journals(V.registry(spark, sf), V.journals(spark, sf)).select("paper_id", "venue_canon", "citation_abbreviation", "filename_abbreviation")


@query("journal_dedup", S.with_registry(f"""SELECT max_by(j, [(filename_abbreviation <> '')::INT, -ord]) AS journal, max_by(filename_abbreviation, [(filename_abbreviation <> '')::INT, -ord]) AS filename_abbreviation
  FROM (SELECT *, {S.venue('journal')} AS j FROM journals) GROUP BY lower(j)""", S.JOURNALS))
def journal_dedup(spark, sf):
    return maintain.dedupe_journals(V.journals(spark, sf)).select("journal", "filename_abbreviation")


@query("normalize_venues", S.with_registry(f"SELECT paper_id, {S.venue('venue')} AS venue, ({S.venue('venue')}) <> venue AS changed FROM registry"))
def normalize_venues(spark, sf):
    r = V.registry(spark, sf)
    return maintain.normalize_venues(r)[0].select("paper_id", "venue").join(r.select("paper_id", F.col("venue").alias("old")), "paper_id").select(
        "paper_id", "venue", (F.col("venue") != F.col("old")).alias("changed"))


# --- maintenance ------------------------------------------------------------------------------

@query("upsert", S.with_registry("""SELECT paper_id, resolved_title, row_ord FROM registry WHERE row_ord % 4 <> 1
  UNION ALL SELECT paper_id, 'updated', row_ord FROM registry WHERE row_ord % 4 = 1
  UNION ALL SELECT 'new-' || paper_id, 'new', (SELECT max(row_ord) FROM registry) + 1 + row_ord FROM registry WHERE row_ord % 4 = 3"""))
def upsert(spark, sf):
    r = V.registry_only(spark, sf)
    o = F.col("row_ord")
    upd = r.filter(o % 4 == 1).withColumn("resolved_title", F.lit("updated")).unionByName(
        r.filter(o % 4 == 3).withColumn("paper_id", F.concat(F.lit("new-"), "paper_id")).withColumn("resolved_title", F.lit("new")))
    return maintain.upsert(r, upd).select("paper_id", "resolved_title", "row_ord")


@query("delete_cascade", S.with_registry("""SELECT DISTINCT bibtex_key FROM registry WHERE row_ord % 3 = 0 AND bibtex_key <> '' AND bibtex_key NOT IN (SELECT bibtex_key FROM registry WHERE row_ord % 3 <> 0)"""))
def delete_cascade(spark, sf):
    r = V.registry(spark, sf)
    return maintain.delete_cascade(r, r.filter("row_ord % 3 = 0").select("paper_id"), texts=V.texts(spark, sf)).removed_keys


@query("key_usage", S.with_registry("SELECT bibtex_key, count(*) AS n FROM registry WHERE row_ord % 3 <> 0 AND bibtex_key <> '' GROUP BY 1"))
def key_usage(spark, sf):
    r = V.registry(spark, sf)
    return maintain.key_usage(r, r.filter("row_ord % 3 = 0").select("paper_id"))


@query("link_supplements", S.with_registry("""SELECT r.paper_id, CASE WHEN p.paper_id IS NULL THEN r.resolved_title ELSE CASE WHEN p.resolved_title <> '' THEN p.resolved_title ELSE p.title_query END END AS resolved_title,
  coalesce(p.bibtex_key, r.bibtex_key) AS bibtex_key, CASE WHEN p.paper_id IS NULL THEN r.doi ELSE '' END AS doi, CASE WHEN p.paper_id IS NULL THEN r.match_status ELSE 'matched_supplement' END AS match_status
  FROM registry r LEFT JOIN registry p ON r.row_ord % 25 = 7 AND p.row_ord = r.row_ord - 1"""))
def link_supplements(spark, sf):
    r = V.registry(spark, sf)
    links = r.filter("row_ord % 25 = 7").select(F.col("paper_id").alias("child_id"), F.concat(F.lit("doc-"), (F.col("row_ord") - 1).cast("string")).alias("parent_id"))
    return maintain.link_supplements(r, links).select("paper_id", "resolved_title", "bibtex_key", "doi", "match_status")


@query("supplements_of", S.with_registry("""SELECT p.paper_id, s.paper_id AS supplement_id FROM linked p JOIN linked s ON s.st = 'matched_supplement' AND p.k = s.k AND p.k <> '' AND p.paper_id <> s.paper_id""",
  """linked AS (SELECT r.paper_id, coalesce(p.bibtex_key, r.bibtex_key) AS k, CASE WHEN p.paper_id IS NULL THEN r.match_status ELSE 'matched_supplement' END AS st
    FROM registry r LEFT JOIN registry p ON r.row_ord % 25 = 7 AND p.row_ord = r.row_ord - 1)"""))
def supplements_of(spark, sf):
    r = V.registry(spark, sf)
    links = r.filter("row_ord % 25 = 7").select(F.col("paper_id").alias("child_id"), F.concat(F.lit("doc-"), (F.col("row_ord") - 1).cast("string")).alias("parent_id"))
    return search.supplements_of(maintain.link_supplements(r, links)).select("paper_id", "supplement_id")


@query("supplement_groups", S.with_registry("""SELECT k AS bibtex_key, paper_id, st = 'matched_supplement' AS is_supplement, count(*) FILTER (st <> 'matched_supplement') OVER w AS n_papers,
  count(*) FILTER (st = 'matched_supplement') OVER w AS n_supplements FROM linked WHERE k <> '' WINDOW w AS (PARTITION BY k) QUALIFY n_supplements > 0""",
  """linked AS (SELECT r.paper_id, coalesce(p.bibtex_key, r.bibtex_key) AS k, CASE WHEN p.paper_id IS NULL THEN r.match_status ELSE 'matched_supplement' END AS st
    FROM registry r LEFT JOIN registry p ON r.row_ord % 25 = 7 AND p.row_ord = r.row_ord - 1)"""))
def supplement_groups(spark, sf):
    r = V.registry(spark, sf)
    links = r.filter("row_ord % 25 = 7").select(F.col("paper_id").alias("child_id"), F.concat(F.lit("doc-"), (F.col("row_ord") - 1).cast("string")).alias("parent_id"))
    return search.supplement_groups(maintain.link_supplements(r, links))


@query("apply_overrides", S.with_registry("""SELECT paper_id, CASE WHEN h THEN 'Verified ' || row_ord ELSE resolved_title END AS resolved_title, CASE WHEN h THEN '2001' ELSE year END AS year,
  CASE WHEN h THEN 'manual_verified' ELSE match_status END AS match_status, CASE WHEN h THEN concat_ws(' | ', nullif(notes, ''), 'checked') ELSE notes END AS notes,
  CASE WHEN h AND bibtex_key = '' THEN 'roe2001' || least('verified', CASE WHEN length(row_ord::VARCHAR) > 1 THEN row_ord::VARCHAR ELSE 'verified' END) ELSE bibtex_key END AS bibtex_key FROM (SELECT *, row_ord % 5 = 2 AS h FROM registry)"""))
def apply_overrides(spark, sf):
    r = V.registry(spark, sf)
    o = r.filter("row_ord % 5 = 2").select("paper_id", F.concat(F.lit("Verified "), F.col("row_ord").cast("string")).alias("title"), F.lit("Jane Roe").alias("authors"), F.lit("2001").alias("year"),
                                           F.lit("v").alias("venue"), F.lit("").alias("doi"), F.lit("").alias("url"), F.lit("").alias("abstract"), F.lit("").alias("bibtex_key"), F.lit("checked").alias("source_note"))
    return maintain.apply_overrides(r, o).select("paper_id", "resolved_title", "year", "match_status", "notes", "bibtex_key")


@query("move_paths", S.with_registry("""SELECT paper_id, pdf_path AS from_path, 'articles/moved/' || (row_ord // 2) || '.pdf' AS to_path, CASE WHEN content_kind <> 'pdf_backed' THEN 'no_tracked_file' ELSE 'planned' END AS status FROM registry WHERE row_ord % 2 = 0"""))
def move_paths(spark, sf):
    r = V.registry(spark, sf)
    moves = r.filter("row_ord % 2 = 0").select("paper_id", F.concat(F.lit("articles/moved/"), F.expr("row_ord div 2").cast("string"), F.lit(".pdf")).alias("new_path"))
    return maintain.move_paths(r, moves)[1]


@query("incoming_duplicates", S.with_registry("""SELECT paper_id, CASE WHEN row_ord % 6 = 0 THEN 'articles/new/' || row_ord || '.pdf' ELSE pdf_path END AS pdf_path, CASE WHEN row_ord % 6 = 0 THEN row_ord || '.pdf' ELSE filename END AS filename FROM registry"""))
def incoming_duplicates(spark, sf):
    r = V.registry(spark, sf)
    d = r.filter("row_ord % 3 = 0").select("paper_id", F.when(F.col("row_ord") % 2 == 0, "use_new_path").otherwise("delete_new_file").alias("action"),
                                           F.concat(F.lit("articles/new/"), F.col("row_ord").cast("string"), F.lit(".pdf")).alias("new_path"))
    return maintain.resolve_incoming_duplicates(r, d).select("paper_id", "pdf_path", "filename")


def _safe(e: str) -> str:
    e = S.sub(f"strip_accents({S.sub(e, '[‐‑‒–—−]', '-')})", "[^\\x00-\\x7f]", "")
    e = S.sub(f"replace({e}, '&', 'and')", '[/:?*"<>|]+', " ")
    e = S.sub(S.sub(e, r"\s*-\s*", "-"), r"[.]{2,}", ".")
    return S.sub(S.squeeze(e), r"^[ ._-]+|[ ._-]+$", "")


@query("rename_plan", S.with_registry(f"""SELECT paper_id, pdf_path AS current_path, CASE WHEN n = 1 THEN target || '.pdf' ELSE target || ' (' || n || ').pdf' END AS target_path FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY row_ord) AS n FROM (SELECT paper_id, pdf_path, row_ord, regexp_replace(pdf_path, '[^/]*$', '') || 'Name' || (row_ord % 97) || ' ' || year || ' '
    || coalesce(a, nullif(substr(replace({_safe('venue')}, ' ', ''), 1, 24), ''), 'UnknownJournal') || ' - ' || {_safe(S.filled('resolved_title', 'title_query'))} || CASE WHEN row_ord % 25 = 7 THEN ' - SI' ELSE '' END AS target
    FROM registry LEFT JOIN (SELECT journal, max_by(coalesce(nullif(filename_abbreviation, ''), replace(citation_abbreviation, '.', '')), ord) AS a FROM journals GROUP BY 1) ON journal = venue
    WHERE pdf_path <> '' AND match_status IN ('matched', 'matched_via_doi', 'manual_verified') AND year <> 'n/a' AND {S.filled('resolved_title', 'title_query')} <> ''))""", S.JOURNALS))
def rename_plan(spark, sf):
    return maintain.rename_plan(V.registry(spark, sf), maintain.journal_file_names(V.journals(spark, sf), spark))


@query("reconcile")
def reconcile(spark, sf):
    facts = materialize(resolve.with_text_facts(V.planted_texts(spark, sf)), "text_facts")
    d = rebuild.reconcile(V.registry(spark, sf), V.records(spark, sf), facts, V.works(spark, sf))
    return d.select("paper_id", "skip_reason", "accepted", "proposed_action", "best_doi", r4(F.col("best_score")).alias("best_score"), "job_type",
                    joined("rewrite_reasons").alias("rewrite_reasons"), joined(F.array_sort(F.map_keys("changes"))).alias("changed"), "applies")


@query("batch_accept", "WITH RECURSIVE " + S.REGISTRY + ", " + _BIBV + f""", known AS (SELECT list(DISTINCT k) AS ks FROM (
    SELECT 'd' || lower(trim(doi)) AS k FROM registry WHERE row_ord % 10 = 0 AND doi <> '' UNION ALL SELECT 'k' || lower(bibtex_key) FROM registry WHERE row_ord % 10 = 0 AND bibtex_key <> ''
    UNION ALL SELECT 't' || lower(trim(resolved_title)) FROM registry WHERE row_ord % 10 = 0 AND resolved_title <> '')),
  entries AS (SELECT ord, row_number() OVER (ORDER BY ord) AS i, CASE WHEN d <> '' THEN 'd' || d ELSE '-' END AS kd, CASE WHEN bibtex_key <> '' THEN 'k' || lower(bibtex_key) ELSE '-' END AS kk,
    CASE WHEN title <> '' THEN 't' || lower(title) ELSE '-' END AS kt FROM (SELECT *, {S.doi('doi_raw')} AS d FROM bibv)),
  walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS ord, ''::VARCHAR AS reason, ks AS taken FROM known
    UNION ALL SELECT e.i, e.ord, CASE WHEN list_contains(w.taken, e.kd) THEN 'doi' WHEN list_contains(w.taken, e.kk) THEN 'key' WHEN list_contains(w.taken, e.kt) THEN 'title' ELSE '' END,
      CASE WHEN list_contains(w.taken, e.kd) OR list_contains(w.taken, e.kk) OR list_contains(w.taken, e.kt) THEN w.taken ELSE list_concat(w.taken, list_filter([e.kd, e.kk, e.kt], lambda x: x <> '-')) END
    FROM walk w JOIN entries e ON e.i = w.i + 1)
  SELECT ord, reason = '' AS accepted, reason FROM walk WHERE i > 0""")
def batch_accept(spark, sf):
    meta = BX.normalized_metadata(F.col("fields"))
    inc = _parsed(spark, sf).select("ord", meta["doi"].alias("doi"), "bibtex_key", meta["title"].alias("title"))
    return accept.accept_batch(inc, V.registry(spark, sf).filter("row_ord % 10 = 0")).select("ord", "accepted", "reason")


_NEW = f"""SELECT ord, CASE WHEN d <> '' AND d IN (SELECT lower(trim(doi)) FROM registry WHERE row_ord % 10 = 0) THEN 'doi' WHEN lower(bibtex_key) IN (SELECT lower(bibtex_key) FROM registry WHERE row_ord % 10 = 0 AND bibtex_key <> '') THEN 'key'
  WHEN lower(title) <> '' AND lower(title) IN (SELECT lower(trim(resolved_title)) FROM registry WHERE row_ord % 10 = 0) THEN 'title' ELSE '' END AS reason FROM (SELECT *, {S.doi('doi_raw')} AS d FROM bibv)"""


@query("import_existing", S.with_registry(_NEW, _BIBV))
def import_existing(spark, sf):
    meta = BX.normalized_metadata(F.col("fields"))
    inc = _parsed(spark, sf).select("ord", meta["doi"].alias("doi"), "bibtex_key", meta["title"].alias("title"))
    return accept.split_by_existing(inc, V.registry(spark, sf).filter("row_ord % 10 = 0")).select("ord", "reason")


@query("rebuild_from_records", S.with_registry(f"""SELECT paper_id, content_kind, pdf_path, CASE WHEN m = 0 THEN 'Manual ' || row_ord WHEN m = 1 THEN title_query || ' revised' WHEN m = 2 THEN resolved_title ELSE title_query END AS resolved_title,
  CASE WHEN m = 0 THEN 'Man Ual' WHEN m = 1 THEN 'Ada Name' || (row_ord % 97) WHEN m = 2 THEN authors ELSE 'Cy Name' || (row_ord % 97) END AS authors,
  CASE WHEN m = 0 THEN '2001' WHEN m = 2 THEN year WHEN year = 'n/a' THEN '' ELSE year END AS year, CASE WHEN m = 0 THEN 'PLoS ONE' ELSE {S.venue('venue')} END AS venue,
  CASE WHEN m = 0 THEN '10.1/' || row_ord WHEN m = 2 THEN '' ELSE doi END AS doi,
  CASE WHEN m = 0 AND row_ord % 12 = 0 THEN 'https://m.example.org/' || row_ord WHEN m = 1 THEN 'https://works.example.org/' || row_ord WHEN m = 2 THEN '' ELSE 'https://c.example.org/' || row_ord END AS canonical_url,
  CASE WHEN m = 0 THEN 'manual_verified' WHEN m <> 2 AND row_ord % 2 = 0 THEN 'semantic_scholar' ELSE '' END AS abstract_source,
  concat_ws(' | ', CASE WHEN row_ord % 7 = 0 THEN 'HTTP 404' END, 'w1', CASE WHEN m = 0 THEN 'checked' END) AS notes FROM (SELECT *, row_ord % 5 AS m FROM registry)"""))
def rebuild_from_records(spark, sf):
    return rebuild.rows_from_records(V.records(spark, sf), V.registry(spark, sf), _parsed(spark, sf)).select(
        "paper_id", "content_kind", "pdf_path", "resolved_title", "authors", "year", "venue", "doi", "canonical_url", "abstract_source", "notes")


@query("refresh_guard", S.with_registry("""SELECT paper_id, array_to_string(p, '|') AS problems FROM (SELECT paper_id, list_filter([CASE WHEN content_kind = 'pdf_backed' AND chunk_path = '' THEN 'missing:chunk_path' END,
  CASE WHEN row_ord % 5 IN (1, 3, 4) AND year = 'n/a' THEN 'loss:year' END, CASE WHEN row_ord % 5 = 2 AND doi <> '' THEN 'loss:doi' END, CASE WHEN row_ord % 5 = 2 AND canonical_url <> '' THEN 'loss:canonical_url' END],
  lambda x: x IS NOT NULL) AS p FROM registry) WHERE len(p) > 0"""))
def refresh_guard(spark, sf):
    r = V.registry(spark, sf)
    rebuilt = materialize(rebuild.rows_from_records(V.records(spark, sf), r, _parsed(spark, sf)), "rebuilt")
    return rebuild.refresh(r, rebuilt)[1].select("paper_id", joined("problems").alias("problems"))


def _file_items(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    return V.documents(spark, sf).select(
        d.alias("ord"), F.concat(F.lit("articles/in/"), d.cast("string"), F.lit(".pdf")).alias("path"), "text", F.lit("").alias("s2_id"),
        F.concat(F.lit("Item "), d.cast("string")).alias("title"), F.lit("Jane Roe").alias("authors"), F.lit("2020").alias("year"),
        F.lit("").alias("venue"), F.lit("").alias("doi"), F.lit("").alias("url"))


@query("add_files", S.with_registry("""SELECT 'sha256-' || substr(sha256(text), 1, 16) AS paper_id, 'articles/in/' || min(doc_id) || '.pdf' AS pdf_path FROM documents
  WHERE sha256(text) NOT IN (SELECT pdf_sha256 FROM registry WHERE row_ord % 2 = 0 AND content_kind = 'pdf_backed') GROUP BY sha256(text)"""))
def add_files(spark, sf):
    return maintain.add_files(V.registry(spark, sf).filter("row_ord % 2 = 0"), _file_items(spark, sf)).rows.select("paper_id", "pdf_path")


@query("add_references", S.with_registry(f"""SELECT paper_id, max_by(content_kind, row_ord) AS content_kind, max_by(bibtex_key, row_ord) AS bibtex_key, max_by(text_path, row_ord) AS text_path, max_by(title, row_ord) AS resolved_title FROM (
    SELECT m.row_ord, coalesce(x.paper_id, minted) AS paper_id, coalesce(x.content_kind, 'reference_only') AS content_kind, {S.filled('x.bibtex_key', 'mkey')} AS bibtex_key, m.title,
      CASE WHEN coalesce(x.content_kind, 'reference_only') = 'reference_only' THEN 'text/' || coalesce(x.paper_id, minted) || '.txt' ELSE x.text_path END AS text_path
    FROM (SELECT r.row_ord, {S.squeeze('r.resolved_title')} AS title, coalesce(d.m, t.m) AS mid, {S.sub(S.slug("'Name' || (row_ord % 97) || year || coalesce((" + S.tokens('resolved_title') + ")[1], 'paper')"), '-', '')} AS mkey,
        CASE WHEN r.doi <> '' THEN 'doi-' || regexp_replace({S.doi('r.doi')}, '[^a-z0-9]+', '-', 'g') ELSE 'bib-' || substr(sha256({S.norm('r.resolved_title')} || '|' || r.year || '|' || {S.norm("split_part(r.authors, ',', 1)")} || '|' || {S.norm(S.venue('r.venue'))}), 1, 16) END AS minted
      FROM registry r LEFT JOIN (SELECT {S.doi('doi')} AS k, min(paper_id) AS m FROM registry WHERE doi <> '' AND row_ord % 2 = 0 GROUP BY 1 HAVING count(*) = 1) d ON d.k = {S.doi('r.doi')}
      LEFT JOIN (SELECT {S.norm(S.filled('resolved_title', 'title_query'))} AS k, year AS y, min(paper_id) AS m FROM registry WHERE row_ord % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1) t
        ON t.k = {S.norm('r.resolved_title')} AND t.k <> '' AND t.y = r.year) m LEFT JOIN registry x ON x.paper_id = m.mid) GROUP BY paper_id"""))
def add_references(spark, sf):
    r = V.registry(spark, sf)
    inc = r.select(F.col("row_ord").alias("ord"), F.lit("").alias("s2_id"), F.col("resolved_title").alias("title"), "authors", "year", "venue", "doi",
                   F.lit("").alias("url"), F.lit("").alias("abstract"), F.lit("").alias("bibtex_key"), F.lit("").alias("bibtex_type"))
    return maintain.add_references(r.filter("row_ord % 2 = 0"), inc).select("paper_id", "content_kind", "bibtex_key", "text_path", "resolved_title")


@query("incremental_ingest", """SELECT 'sha256-' || substr(sha256(text), 1, 16) AS paper_id, sha256(text) AS pdf_sha256 FROM documents GROUP BY sha256(text)""")
def incremental_ingest(spark, sf):
    """Two drops of the document table through the file stream; the second run only sees the second drop."""
    from ..streaming import ingest as G
    base = scratch_path(spark, "ingest")
    d = V.documents(spark, sf)
    to_incoming = lambda b: b.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("articles/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "text",
        F.lit("").alias("s2_id"), F.concat(F.lit("Item "), F.col("doc_id").cast("string")).alias("title"), F.lit("Jane Roe").alias("authors"),
        F.lit("2020").alias("year"), F.lit("").alias("venue"), F.lit("").alias("doi"), F.lit("").alias("url"))
    for part in (0, 1):
        d.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(d.schema).parquet(f"{base}/in")
        G.start_ingest(stream, to_incoming, f"{base}/registry", f"{base}/checkpoint").awaitTermination()
    return G.read_registry(spark, f"{base}/registry").select("paper_id", "pdf_sha256")


from . import more_queries  # noqa: E402, F401 - registers its queries here
