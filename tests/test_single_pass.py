"""Costly steps run once: counted in the plans, with results that stay."""
import pyarrow as pa
from pyspark.sql import functions as F

from bibspark.functions import parsing as P
from bibspark.functions import worker
from bibspark.operators import bib, resolve, search, similarity
from bibspark.plans import queries as Q
from bibspark.plans import views as V


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_parsed_in_pieces():
    raw = ["@Article{k%d,\n title = {T %d},\n year=2001\n}" % (i, i) for i in range(3 * worker.ENTRIES + 5)] + [None, "junk"]
    got = worker.parse_entries(pa.array(raw)).to_pylist()
    assert [(g["entry_type"], g["bibtex_key"], dict(g["fields"]), g["error"]) for g in got] == [worker.parse_entry(r) for r in raw]
    assert len(worker.parse_entries(pa.array([], pa.string()))) == 0


def test_a_filter_on_the_error_does_not_parse_again(spark, sf):
    parsed = bib.parse_entries(V.bib_entries(spark, sf)).filter("error = ''").select("ord", "fields")
    assert parsed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_canonical_fields_are_computed_once(spark, sf):
    assert plan(bib.canonicalize(bib.parse_entries(V.bib_entries(spark, sf)))).count("map_zip_with") <= 3


def test_scores_read_a_written_index_and_are_computed_once(spark, sf):
    ix = Q.search_index(spark, sf)
    assert ix.inputFiles() and all("search-index" in f for f in ix.inputFiles())
    assert plan(search.rank_rows(ix, "nature of the thing 2001").select("paper_id", "score")).count("map_filter") == 1


def test_parents_come_from_written_tables(spark, sf):
    r = V.registry(spark, sf)
    supp = r.filter(F.col("row_ord") % 5 >= 3).select("paper_id", "pdf_path", F.array("title_query").alias("title_candidates"))
    assert not any("documents.parquet" in f for f in resolve.supplement_parents(supp, r).inputFiles())


def test_uneven_sides_give_the_brute_force_pairs(spark):
    import random
    rng = random.Random(5)
    words = ["gene", "genes", "fold", "map", "maps", "loop", "of", "a", "in", "ene", "extrusion", "study"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    few, many = sorted({title() for _ in range(12)}), sorted({title() for _ in range(300)})
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    for left, right in ((few, many), (many, few)):
        prepared = similarity.prepare(frame(left, "q"), "q", frame(right, "t"), "t")
        got = sorted((r.q_norm, r.t_norm, r.similarity) for r in similarity.part_pairs(prepared).collect())
        assert got == sorted((q, t, 1.0 if q == t else 0.92) for q in left for t in right if q in t or t in q)


def test_containment_never_pairs_titles_of_one_side(spark, monkeypatch):
    asked = []
    whole = similarity.contained_pairs
    monkeypatch.setattr(similarity, "contained_pairs", lambda a, b: asked.append((a.count(), b.count())) or whole(a, b))
    few, many = [f"gene fold map {i}" for i in range(2)], [f"loop in study {i}" for i in range(30)]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    similarity.part_pairs(similarity.prepare(frame(few, "q"), "q", frame(many, "t"), "t")).collect()
    assert sorted(asked) == [(2, 30), (30, 2)]


def test_title_guesses_in_order_and_only_as_far_as_needed(spark):
    full = [f"Line number {i} of the front matter words" for i in range(6)]
    late = [f"short {i}" for i in range(26)] + ["A late line with enough words here", "A late line with enough words here", "Another late line with enough words"]
    df = spark.createDataFrame([(full, 4), (late, 3), ([], 0)], "ls array<string>, n int")
    guess = P.titles_from_lines(F.col("ls"))
    got = {r.n: r.g for r in df.select("n", guess.alias("g")).collect()}
    assert got[4] == full[:4] and got[0] == []
    assert got[3] == late[26:27] + late[28:]
    assert plan(df.select(guess.alias("g"))).count("aggregate(") >= 2  # a fold that stops, not a map over all lines


def test_texts_behind_doi_candidates_are_searched_once(spark, sf):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def search(doc):
        seen.add(1)
        return ["10.1234/abc.%06d" % doc]

    docs = V.documents(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("paper_id"))
    found = F.transform(search("doc_id"), lambda d: F.struct(F.lit(0.5).alias("priority_score"), d.alias("doi")))
    facts = docs.select("paper_id", F.lit(2000).alias("year_hint"), F.lit("").alias("venue_hint"), F.lit("a title").alias("title_query"),
                        F.array().cast("array<string>").alias("title_candidates"), found.alias("doi_candidates"))
    assert resolve.resolve_dois(facts, V.works(spark, sf)).count() == docs.count() == seen.value
