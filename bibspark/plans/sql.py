"""SQL text building blocks for the DuckDB twins of the registered queries."""
from __future__ import annotations

from .. import constants as K
from ..functions.text import CASE_FOLDS
from .spec import QueryText

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def sub(e: str, rx: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({e}, {q(rx)}, {q(to)}, '{flags}')"


def strip(e: str) -> str:
    return sub(e, f"^{WS}+|{WS}+$")


def squeeze(e: str) -> str:
    return f"trim({sub(e, WS + '+', ' ')})"


def fold(e: str) -> str:
    for k, v in CASE_FOLDS.items():
        e = f"replace({e}, {q(k)}, {q(v)})"
    return f"lower({e})"


def norm(e: str) -> str:
    return f"trim({sub(fold(e), '[^a-z0-9]+', ' ')})"


def compact(e: str) -> str:
    return sub(fold(e), "[^a-z0-9]+", "")


def titleish(e: str) -> str:
    return squeeze(sub(f"replace({e}, '_', ' ')", "[-‐‑–—]+", " "))


def slug(e: str) -> str:
    return f"coalesce(nullif({sub(sub(f'lower({e})', '[^a-z0-9]+', '-'), '^-+|-+$')}, ''), 'untitled')"


def clean(e: str) -> str:
    s = strip(e)
    return f"CASE WHEN lower({s}) IN ({', '.join(q(x) for x in K.NULLISH)}) THEN '' ELSE {s} END"


def filled(*es: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({e}, '')" for e in es) + ", '')"


def doi(e: str) -> str:
    v = sub(strip(e), r"^https?://(?:dx\.)?doi\.org/", "", "gi")
    v = sub(strip(v), r"[.,);\]]+$")
    v = sub(v, r"/-/(?:dcsupplemental|supplemental).*", "", "gi")
    v = sub(v, r"\.[gtsfe]\d{3}$", "", "gi")
    return (f"lower(CASE WHEN regexp_matches({v}, {q(chr(94) + r'10[.]7554/elife[.][0-9]+[.][0-9]{3}$')}, 'i') "
            f"THEN {sub(v, '[.][0-9]{3}$')} ELSE {v} END)")


def venue(e: str) -> str:
    v = f"replace(replace({squeeze(e)}, '\\&', '&'), '&amp;', '&')"
    whens = " ".join(f"WHEN {q(k)} THEN {q(c)}" for k, c in K.CANONICAL_VENUES.items())
    return f"CASE {fold(v)} {whens} ELSE {v} END"


def venue_key(e: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(c)}" for k, c in K.VENUE_ALIASES.items())
    return f"CASE {compact(e)} {whens} ELSE {compact(e)} END"


def words(e: str) -> str:
    return f"list_filter(string_split({squeeze(e)}, ' '), lambda w: w <> '')"


def tokens(e: str) -> str:
    stop = ", ".join(q(w) for w in K.STOP_WORDS)
    return (f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({e}, '[A-Za-z0-9]+'), "
            f"lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({stop}))))")


def sim(qn: str, tn: str, qt: str, tt: str) -> str:
    o = f"len(list_intersect({qt}, {tt}))::DOUBLE"
    return (f"CASE WHEN {qn} = '' OR {tn} = '' THEN 0.0 WHEN {qn} = {tn} THEN 1.0 "
            f"WHEN contains({tn}, {qn}) OR contains({qn}, {tn}) THEN 0.92 "
            f"WHEN len({qt}) = 0 OR len({tt}) = 0 THEN 0.0 "
            f"ELSE least(1.0, 0.65 * {o} / len({qt}) + 0.35 * {o} / (len({qt}) + len({tt}) - {o})) END::DOUBLE")


def year_int(e: str) -> str:
    return f"CASE WHEN regexp_matches({strip(e)}, '^[0-9]{{4}}$') THEN try_cast({strip(e)} AS INT) END"


def round2(e: str) -> str:
    return f"(round_even(({e}) * 100, 0) / 100)"


def surnames(e: str) -> str:
    """Normalised surnames of a comma list without ``and`` (the shape of the registry view)."""
    last = f"list_transform(list_filter(list_transform(string_split({e}, ','), lambda a: {strip('a')}), lambda a: a <> ''), " \
           f"lambda a: {norm('regexp_extract(a, ' + q('[^ ]+$') + ')')})"
    return last


def _joined(*es: str) -> str:
    return "concat_ws(' ', " + ", ".join(es) + ")"


def is_supp_audit(r: str = "") -> str:
    parts = _joined(*[f"nullif({clean(r + c)}, '')" for c in ("filename", "pdf_path", "resolved_title", "title_query", "notes")])
    words_ = "si|sm|supp|supplement|supplementary|supporting information|supporting material|supporting materials|appendix"
    return (f"({clean(r + 'match_status')} = 'matched_supplement' OR "
            f"regexp_matches({parts}, {q('(?:^|[^A-Za-z0-9])(?:' + words_ + ')(?:$|[^A-Za-z0-9])')}, 'i'))")


def any_of(e: str, needles) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(n)})" for n in needles) + ")"


def is_malformed() -> str:
    return (f"({clean('paper_id')} = '' OR {clean('content_kind')} NOT IN ('pdf_backed', 'reference_only') "
            f"OR {clean(filled('resolved_title', 'title_query'))} = '')")


REGISTRY = """registry AS (
  SELECT 'doc-' || doc_id AS paper_id, 'article' AS item_type,
    CASE WHEN doc_id % 10 = 9 THEN 'reference_only' ELSE 'pdf_backed' END AS content_kind,
    CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'articles/' || source || '/' || fn END AS pdf_path,
    sha256(text) AS pdf_sha256, fn AS filename,
    CASE WHEN doc_id % 46 = 5 THEN '' ELSE line END AS title_query,
    CASE WHEN doc_id % 23 = 5 THEN '' ELSE line END AS resolved_title,
    'Ada Name' || (doc_id % 97) || ', Bo Name' || (doc_id % 13) AS authors, yr AS year,
    ['nature genetics', 'PLOS ONE', 'Journal of Molecular Biology', 'bioRxiv',
     'Nature Structural &amp; Molecular Biology', ''][(doc_id % 6 + 1)::INT] AS venue,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE (CASE WHEN doc_id % 7 = 0 THEN 'https://doi.org/' ELSE '' END)
      || '10.1234/abc.' || lpad((doc_id - CASE WHEN doc_id % 50 = 3 THEN 1 ELSE 0 END)::VARCHAR, 6, '0') END AS doi,
    CASE WHEN doc_id % 3 = 0 THEN 'S' || doc_id ELSE '' END AS semantic_scholar_paper_id, '' AS match_confidence,
    ['matched', 'matched_via_doi', 'manual_verified', 'needs_manual_review', 'not_found'][(doc_id % 5 + 1)::INT] AS match_status,
    CASE WHEN doc_id % 8 = 1 THEN 'book' ELSE '' END AS bibtex_type,
    CASE WHEN doc_id % 4 = 2 THEN 'https://example.org/' || doc_id ELSE '' END AS canonical_url,
    CASE WHEN doc_id % 41 = 6 THEN '' ELSE 'name' || (doc_id % 97) || yr || regexp_extract(lower(line), '[a-z0-9]+', 0) END AS bibtex_key,
    'texts/doc-' || doc_id || '.txt' AS text_path,
    CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'chunks/doc-' || doc_id || '.jsonl' END AS chunk_path,
    '' AS abstract_source, '' AS date_indexed,
    CASE WHEN doc_id % 37 = 3 THEN 'see supporting information' ELSE '' END AS notes, doc_id AS row_ord, lang
  FROM (SELECT *, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS line,
          'doc_' || doc_id || CASE WHEN doc_id % 25 = 7 THEN ' - SI' ELSE '' END || '.pdf' AS fn,
          CASE WHEN doc_id % 31 = 4 THEN 'n/a' ELSE (1980 + n_chars % 45)::VARCHAR END AS yr FROM documents))"""


def with_registry(body: str, *more: str) -> str:
    return "WITH " + ", ".join([REGISTRY, *more]) + "\n" + body


STEM = "array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(v, '[^A-Za-z]+', ' ', 'g')), ' '), " \
       "lambda w: length(w) >= 3), lambda w: upper(w[1]) || lower(substr(w, 2, 2))), '')"
JOURNALS = f"""journals AS (
  SELECT v AS journal, CASE WHEN ord % 2 = 1 THEN {STEM} ELSE '' END AS filename_abbreviation,
    {STEM} || '.' AS citation_abbreviation, 'derived' AS citation_source, ord
  FROM (SELECT CASE WHEN row_ord % 3 = 0 THEN upper(venue) ELSE venue END AS v, min(row_ord) AS ord
        FROM registry WHERE venue <> '' GROUP BY 1))"""
JOURNAL_LOOKUP = f"""jl AS (SELECT vc, max_by(citation_abbreviation, ord) AS cite, max_by(filename_abbreviation, ord) AS file
  FROM (SELECT *, {venue(strip('journal'))} AS vc FROM journals) WHERE vc <> '' GROUP BY vc)"""

# search index without stored abstracts: the abstract column is the second line of the text
ABSTRACTS = "abstracts AS (SELECT 'doc-' || doc_id AS paper_id, split_part(text, chr(10), 2) AS abstract FROM documents)"
INDEX = f"""base AS (SELECT r.*, {filled('resolved_title', 'title_query')} AS title, coalesce(abstract, '') AS abstract,
    coalesce(cite, '') AS cite, coalesce(file, '') AS file
  FROM registry r LEFT JOIN abstracts USING (paper_id) LEFT JOIN jl ON jl.vc = ({venue('r.venue')})),
ix AS (SELECT *, {compact('paper_id')} AS pid_n, {compact('bibtex_key')} AS key_n, {norm('title')} AS title_norm,
    {norm('authors')} AS authors_norm, {norm('venue')} AS venue_norm, {norm('abstract')} AS abstract_norm,
    {tokens('title')} AS tt, {tokens('authors')} AS aut, {tokens("venue || ' ' || cite || ' ' || file")} AS vt,
    {tokens('filename')} AS ft, {tokens('abstract')} AS bt, {surnames('authors')} AS sn, {doi('doi')} AS doi_n,
    {year_int('year')} AS yi FROM base)"""


def score_parts(text: str, abstract: bool = True) -> dict[str, str]:
    qq = QueryText(text)
    W, T = K.WEIGHTS, lst(qq.tokens)
    n = max(len(qq.tokens), 1)
    hit = lambda c: f"len(list_intersect({c}, {T}))::DOUBLE"
    flag = lambda c, w: f"CASE WHEN {c} THEN {w} ELSE 0.0 END"
    N = q(qq.norm)
    tn_tokens = tokens("title_norm")
    s = sim(N, "title_norm", lst(qq.norm_tokens), tn_tokens)
    p = {
        "title_exact": flag(f"title_norm <> '' AND title_norm = {N}", W["title_exact"]),
        "title_phrase": flag(f"title_norm <> '' AND title_norm <> {N} AND contains(title_norm, {N})", W["title_phrase"]),
        "title_similarity": f"CASE WHEN title_norm <> '' AND NOT contains(title_norm, {N}) AND ({s}) >= 0.45 "
                            f"THEN {round2(f'({s}) * 55.0')} ELSE 0.0 END",
        "paper_id": flag(f"pid_n = {q(qq.compact)}", W["paper_id"]),
        "bibtex_key": flag(f"key_n = {q(qq.compact)}", W["bibtex_key"]),
        "doi_exact": flag(f"doi_n = {doi(q(text))} AND doi_n <> ''", W["doi_exact"]),
        "title_tokens": round2(f"{hit('tt')} * 9.0 + {hit('tt')} / {n} * 18.0"),
        "author_tokens": round2(f"{hit('aut')} * 6.0"),
        "any_author_match": flag(f"list_has_any(sn, {T})", W["any_author_match"]),
        "first_author_match": flag(f"list_contains({T}, coalesce(sn[1], ''))", W["first_author_match"]),
        "venue_tokens": round2(f"{hit('vt')} * 4.0"),
        "venue_abbreviation_match": flag(f"list_contains({T}, {compact('file')})", W["venue_abbreviation_match"]),
        "filename_tokens": round2(f"{hit('ft')} * 2.5"),
    }
    words_ = [t for t in qq.tokens if len(t) >= 4 and not t.isdigit()]
    if words_:
        p["doi_token_match"] = flag(any_of("lower(doi)", words_), W["doi_token_match"])
    if qq.years:
        gap = "least(" + ", ".join(f"abs(yi - {y})" for y in qq.years) + ")"
        boost = f"greatest(0.0, 35.0 - {gap} * 10.0)"
        p["year_match"] = f"CASE WHEN {gap} = 0 THEN {boost} ELSE 0.0 END"
        p["year_proximity_match"] = f"CASE WHEN {gap} > 0 THEN {boost} ELSE 0.0 END"
    if abstract:
        p["abstract_tokens"] = round2(f"{hit('bt')} * 2.0")
        p["abstract_phrase"] = flag(f"contains(abstract_norm, {N})", W["abstract_phrase"])
    for ph in qq.phrases:
        pass
    if qq.phrases:
        p["title_phrase_match"] = " + ".join(flag(f"contains(title_norm, {q(x)})", 40.0) for x in qq.phrases)
        if abstract:
            p["abstract_phrase_match"] = " + ".join(flag(
                f"NOT contains(title_norm, {q(x)}) AND contains(abstract_norm, {q(x)})", 15.0) for x in qq.phrases)
    extra = ["bt"] if abstract else []
    every = "list_concat(tt, list_concat(aut, list_concat(vt, list_concat(ft, list_concat(sn, [trim(year)])))))"
    for c in extra:
        every = f"list_concat({every}, {c})"
    p["query_coverage"] = round2(f"len(list_intersect({every}, {T}))::DOUBLE / {n} * 50.0")
    return p


ORDER = "floor(score / 5) DESC, coalesce(yi, 0) DESC, lower(title), row_ord"


def search_sql(text: str, where: str = "true", abstract: bool = True) -> str:
    total = " + ".join(f"coalesce({e}, 0.0)" for e in score_parts(text, abstract).values())
    return f"SELECT *, {round2(total)} AS score FROM ix WHERE {where}"


def index_ctes() -> list[str]:
    return [JOURNALS, JOURNAL_LOOKUP, ABSTRACTS, INDEX]
