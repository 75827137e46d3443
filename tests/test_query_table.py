"""Search over a table of queries against one search per query."""
from bibspark.operators import index, query_table, search
from bibspark.plans import views as V
from pyspark.sql import functions as F


def one_by_one(ix, queries, limit, **how):
    out = {}
    for i, text in queries:
        rows = search.search(ix, text, limit=limit, **how).select("rank", "row_ord", "score").collect() if (text or "").strip() else []
        out[i] = sorted(map(tuple, rows))
    return out


def build(spark, rows):
    cols = "paper_id bibtex_key title_query authors year venue doi filename abstract row_ord".split()
    reg = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} {'bigint' if c == 'row_ord' else 'string'}" for c in cols))
    journals = spark.createDataFrame([("Nature Genetics", "Nat. Genet.", "NatGenet", 0)], "journal string, citation_abbreviation string, filename_abbreviation string, ord bigint")
    return index.build_search_index(reg, None, journals)


ROWS = [
    ("doc-1", "lee2001gene", "Gene folding maps", "Ann Lee and Bo Kim", "2001", "Nature Genetics", "10.1/fold.maps", "gene.pdf", "We map the folding of a gene"),
    ("doc-2", "kim2003maps", "Maps", "Bo Kim", "2003", "Cell", "10.1/abc", "maps.pdf", "deep gene folding maps in cells"),
    ("doc-3", "", "The genes", "Lee, Ann", "1999", "", "", "x.pdf", ""),
    ("doc-4", "ng2001", "", "Ng", "2001", "Nature Genetics", "https://doi.org/10.1/fold", "untitled.pdf", "loop extrusion"),
    ("doc-5", "q", "Loop extrusion in 2001: a gene folding maps study", "Van der Berg, Kim", "n/a", "bioRxiv", "", "loop.pdf", "nothing"),
    ("doc-6", "zz", "Quiet years", "Zed", "2002", "", "", "y.pdf", ""), ("doc-7", "zy", "Another year", "Zed", "2004", "", "", "y2.pdf", ""),
    ("doc-8", "zx", "Gene folding maps", "Ann Lee", "2001", "", "", "", "again"),
]
QUERIES = ["gene folding maps", "Gene", "map", "ene fold", "the", "a", "2001", "2005 lee", "lee2001gene", "DOC 2", "10.1/fold.maps", "https://doi.org/10.1/abc", "fold abcd",
           '"gene folding" maps "loop extrusion"', "natgenet kim", "we map the folding", "folding gene maps of loop", "maps", "zed 2003 1801", "", "   ", None, "!!!", "Ünï gene",
           "genes and maps in nature genetics by lee 1999", "x pdf", '"" "!"', "loop extrusion in 2001 a gene folding maps study with more"]


def test_every_kind_of_evidence(spark):
    ix = build(spark, ROWS)
    queries = list(enumerate(QUERIES))
    table = spark.createDataFrame(queries, "query_id bigint, query string")
    for limit, no_abstract in ((3, False), (20, True), (20, False)):
        got = {i: [] for i, _ in queries}
        for r in query_table.search_table(ix, table, limit, no_abstract).collect():
            got[r.query_id].append((r["rank"], r.row_ord, r.score))
        want = one_by_one(ix, queries, limit, no_abstract=no_abstract)
        assert {i: sorted(v) for i, v in got.items()} == want


def test_queries_from_the_registry(spark, sf):
    reg = V.registry(spark, sf, F.coalesce(F.try_element_at(F.split("text", "\n", 3), F.lit(2)), F.lit("")).alias("abstract"))
    ix = index.build_search_index(reg, None, V.journals(spark, sf))
    table = reg.select(F.col("row_ord").alias("query_id"), F.concat_ws(" ", F.substring_index("title_query", " ", 4), F.substring_index("authors", ",", 1), "year").alias("query"))
    rows = query_table.search_table(ix, table, 5).collect()
    asked = {r.query_id: r.query for r in table.collect()}
    for i in (0, 5, 17, 46):
        want = [tuple(r) for r in search.search(ix, asked[i], limit=5).select("rank", "row_ord", "score").collect()]
        assert sorted((r["rank"], r.row_ord, r.score) for r in rows if r.query_id == i) == sorted(want)
    assert len({r.query_id for r in rows}) == len(asked)
