"""Column helpers against hand-derived values."""
import pytest
from pyspark.sql import functions as F

from bibspark.functions import bibtex as BX
from bibspark.functions import names as N
from bibspark.functions import nested as V
from bibspark.functions import parsing as P
from bibspark.functions import text as T
from bibspark.functions import worker
from bibspark.operators import search
from bibspark.plans.spec import QueryText, parse_year_range


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def lit(spark, f, *args):
    """Evaluate ``f`` on columns, not on literals, so nothing is folded away."""
    df = spark.createDataFrame([args], [f"a{i}" for i in range(len(args))])
    return df.select(f(*[F.col(f"a{i}") for i in range(len(args))]).alias("r")).first()[0]


@pytest.mark.parametrize("text, want", [
    ("Straße of  DNA–binding (2020)", "strasse of dna binding 2020"), ("ﬁne ﬀ ﬅ ŉ ǰ", "fine ff st n j"), ("", ""), ("  ÉÀ ", "")])
def test_normalize_title(spark, text, want):
    assert lit(spark, T.normalize_title, text) == want
    assert lit(spark, lambda c: F.trim(F.regexp_replace(T.casefold_text(c), "[^a-z0-9]+", " ")), text) == want
    assert QueryText(text).norm == want


@pytest.mark.parametrize("doi, want", [
    ("https://doi.org/10.7554/eLife.12345.001", "10.7554/elife.12345"), ("10.1371/journal.pone.0012345.g001", "10.1371/journal.pone.0012345"),
    ("http://dx.doi.org/10.1073/pnas.1/-/DCSupplemental", "10.1073/pnas.1"), (" 10.1000/AbC). ", "10.1000/abc"), ("", "")])
def test_normalize_doi(spark, doi, want):
    assert lit(spark, T.normalize_doi, doi) == want


@pytest.mark.parametrize("a, b, want", [
    ("deep learning", "Deep learning methods", 0.92), ("protein folding dynamics", "Dynamics of protein unfolding", 0.65 * 2 / 3 + 0.35 / 2),
    ("", "x", 0.0), ("A b", "a  B", 1.0), ("of the", "in a box", 0.0)])
def test_title_similarity(spark, a, b, want):
    assert lit(spark, T.title_similarity, a, b) == pytest.approx(want)


def test_tokens_and_venues(spark):
    assert lit(spark, T.informative_tokens, "The role of a p53 in DNA, DNA") == ["role", "p53", "dna"]
    assert lit(spark, T.first_title_token, "of the") == "paper"
    assert lit(spark, T.normalize_venue, "nature structural &amp; molecular biology") == "Nature Structural and Molecular Biology"
    assert lit(spark, T.normalize_venue, "  My   Journal ") == "My Journal"
    assert lit(spark, T.venue_key, "Nat. Genet.") == "naturegenetics"
    assert lit(spark, T.clean_text, " N/A ") == ""
    assert lit(spark, T.quoted_phrases, 'x "A-b c" "" y') == ["a b c"]
    assert lit(spark, T.strip_supplement_markers, "Supporting information for The Big Paper SI") == "The Big Paper"


@pytest.mark.parametrize("pages, want", [
    ("1234--1238", "1234–8"), ("99--105", "99–105"), ("12--12", "12–12"), ("5-9", "5–9"), ("a1--a5", "a1–a5"), ("", "")])
def test_compress_pages(spark, pages, want):
    assert lit(spark, N.compress_pages, pages) == want


def test_names(spark):
    assert lit(spark, N.author_with_initials, "Watson, James D.") == "Watson JD"
    assert lit(spark, N.author_with_initials, "Francis Crick") == "Crick F"
    assert lit(spark, N.author_with_initials, "Plato") == "Plato"
    assert lit(spark, N.all_author_surnames, "Doe, Jane and Roe, Ann") == ["doe", "roe"]
    assert lit(spark, N.all_author_surnames, "Jane Doe, Ann Roe") == ["doe", "roe"]
    assert lit(spark, N.split_bib_authors, "Ada Lovelace, Alan Turing") == ["Ada Lovelace", "Alan Turing"]
    assert lit(spark, N.split_bib_authors, "Lovelace, Ada") == ["Lovelace, Ada"]
    assert lit(spark, N.filename_surname, "Ludwig van Beethoven, X") == "van Beethoven"
    assert lit(spark, N.filename_surname, "") == "Unknown"
    assert lit(spark, N.safe_fragment, "Ünïcode — A/B: c?") == "Unicode-A B c"
    assert lit(spark, N.artifact_stem, "k1", "Nature Communications") == "k1_NatCom"
    assert lit(spark, N.year_int, "20x") is None and lit(spark, N.year_in, "in 2010a 1999") == 1999


def test_ids(spark):
    rid = lambda *a: lit(spark, N.reference_id, *a)
    assert rid("", "10.1038/S41586-020-2649-2", "", "", "", "") == "doi-10-1038-s41586-020-2649-2"
    assert rid("abc", "10.1/x", "", "", "", "") == "s2-abc"
    assert rid("", "", "T", "2001", "A B", "v").startswith("bib-")
    assert lit(spark, N.bib_key, "Jane Roe, X", "", "The zeta alpha", "stem") == "roeundatedalpha"


def test_dois_and_candidates(spark):
    assert lit(spark, P.dois_in, "see 10.1038/s41586-020-2649-2. and 10.1073/pnas") == ["10.1038/s41586-020-2649-2"]
    got = lit(spark, P.doi_candidates, "Title\nhttps://doi.org/10.1000/abc.12345\n" + "x " * 4000 + "\nReferences 10.1000/zzz.99999", "a.pdf")
    assert [g.doi for g in got] == ["10.1000/abc.12345", "10.1000/zzz.99999"]
    assert got[0].source_region == "first_page" and got[0].priority_score == pytest.approx(0.83)
    assert got[1].source_region == "broad_window" and got[1].priority_score == pytest.approx(-0.05)


def test_chunks(spark):
    text = "aaa\n\nbbbb\n\ncc\n \ndddddd"
    got = lit(spark, lambda c: P.chunk_array(c, 9, 2), text)
    assert [c.text for c in got] == ["aaa\n\nbbbb", "cc", "dddddd"]
    assert all(text[c.char_start:c.char_end] == c.text for c in got)
    assert lit(spark, P.chunk_array, "  \n\n ") == []


def test_title_lines(spark):
    text = ("NATURE ARTICLES\n[Page 1]\nResearch A model of how long proteins fold in water Jane Roe1 and X\n"
            "doi: 10.1/1\nDepartment of Things at the Big University of Somewhere\n"
            "This plain sentence is a long enough title line\n")
    got = lit(spark, P.title_candidates, text)
    assert got[0] == "A model of how long proteins fold in water"
    assert "This plain sentence is a long enough title line" in got


def test_filename_titles(spark):
    df = spark.createDataFrame([("Roe 2010 NatGenet - A title of some words.pdf",), ("Roe 2010 Cell - X - Deep_title.pdf",),
                                ("smith_2004_natgenet_genome_maps.pdf",)], ["filename"])
    got = [r.title_query for r in P.with_title_query(df).collect()]
    assert got == ["A title of some words", "Deep title", "genome maps"]
    hints = [(r.year_hint, r.venue_hint) for r in P.with_filename_hints(df).collect()]
    assert hints == [(2010, "naturegenetics"), (2010, "cell"), (2004, "naturegenetics")]


def test_year_ranges():
    assert parse_year_range("2020-") == (2020, None) and parse_year_range("-2020") == (None, 2020)
    assert parse_year_range("2010-2020") == (2010, 2020) and parse_year_range("2020") == (2020, 2020)
    assert parse_year_range("") is None
    for bad in ("2020-2010", "-", "20x"):
        with pytest.raises(ValueError):
            parse_year_range(bad)


def test_entry_parser():
    kind, key, fields, error = worker.parse_entry('@Article{k1,\n title = {A {B} c},\n Author="X \\"q\\" Y", year=2001,\n note={a=b, c}\n}')
    assert (kind, key, error) == ("article", "k1", "")
    assert fields == {"title": "A {B} c", "author": 'X \\"q\\" Y', "year": "2001", "note": "a=b, c"}
    assert worker.parse_entry("no")[3] and worker.parse_entry("@x{}")[3] and worker.parse_entry("@a{k, title {x}}")[3]


def test_entry_splitters(spark):
    text = "@a{k1, t={x @b{in}}}\n@c{k2, t={y}} @d{k3,\n t={z}}"
    assert len(lit(spark, lambda c: BX.split_entries(c, "line"), text)) == 2
    assert len(lit(spark, lambda c: BX.split_entries(c, "header"), text)) == 4
    assert lit(spark, lambda c: BX.split_entries(c, "balanced"), text + " @e{open") == [
        "@a{k1, t={x @b{in}}}", "@c{k2, t={y}}", "@d{k3,\n t={z}}"]


def test_render_entry(spark):
    df = spark.createDataFrame([("article", {"title": "T", "author": "A", "year": "2000", "x": "y", "journal": "Old"})],
                               "entry_type string, fields map<string,string>")
    meta = V.metadata_fields(F.lit("New"), F.lit("A"), F.lit(""), F.lit("cell reports"), F.lit(""), F.lit(""), F.lit(""))
    fields = BX.preserved_fields("entry_type", F.col("fields"), meta)
    got = df.select(BX.render_entry("entry_type", F.lit("k"), fields).alias("r"), BX.ignored_fields("entry_type", F.col("fields")).alias("i")).first()
    assert got.r == "@article{k,\n  title = {New},\n  author = {A},\n  year = {2000},\n  journal = {Cell Reports}\n}\n"
    assert got.i == ["x"]


def test_explanation_order(spark):
    df = spark.range(1).select(F.create_map(*[F.lit(x) for x in ("b", 2.0, "a", 2.0, "c", 9.5, "d", 1.0)]).alias("score_breakdown"))
    assert df.select(search.explanation()).first()[0] == "c=9.5, a=2, b=2"


def test_damaged_entries_keep_what_can_be_read():
    raw = ('@Book{k9,\n title = {One {Two}\n three},\n note {lost},\n AUTHOR="A and B" ,\n  year = 2001,\n doi={10.1/x} extra\n},\n url = {u}\n, abstract = {no line start}\n}')
    assert worker.parse_entry(raw)[3]
    assert worker.parse_entry(raw, True) == ("book", "k9", {"title": "One {Two", "author": "A and B", "doi": "10.1/x} extra", "url": "u"}, "")
    assert worker.parse_entry("no header", True)[3] and worker.parse_entry(None, True)[3]
    whole = '@a{k, title = {x}, x = 1}'
    assert worker.parse_entry(whole, True) == worker.parse_entry(whole)
    assert worker.parse_entry('@a{k,\n title = {x\n year = {y}\n}', True)[2] == {"title": "x year = {y}"}
