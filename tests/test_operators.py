"""Operators against brute force and as properties."""
import random

import pytest
from pyspark.sql import functions as F

from bibspark import constants as K
from bibspark.functions import parsing as P
from bibspark.functions import text as T
from bibspark.operators import accept, bib, cite, index, joins, linkage, maintain, quality, rebuild, resolve, search, similarity
from bibspark.plans import views as V
from bibspark.session import materialize


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(3)
    pairs = {"chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(100, 160)],
             "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]}[shape]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = {r.node: r.component for r in linkage.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == brute_components(pairs)


def test_hot_key_edges(spark):
    """One key on a third of all rows: no group larger than its salt, and still one component."""
    keys = spark.range(900).select(F.lit("doi").alias("key_type"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"), F.col("id").alias("row_ord"))
    edges = linkage.star_edges(keys, salts=16)
    assert edges.groupBy("b").count().agg(F.max("count")).first()[0] <= 40
    got = linkage.connected_components(edges).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(0, 300)]


def test_split_lookup_matches_plain_join(spark):
    left = spark.range(400).select(F.col("id"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 50, 3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "v").collect()))
    got = sorted(map(tuple, joins.split_lookup(left, right, "k").select("id", "k", "v").collect()))
    assert got == want


def test_rank_within(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7 % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("s"))
    got = {(r.g, r.id): r["rank"] for r in joins.rank_within(df, ["g"], [(F.col("s"), "desc"), F.col("id")]).collect()}
    rows = [tuple(r) for r in df.select("g", "s", "id").collect()]
    want = {}
    for g in (0, 1):
        for i, (_, _, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[(g, x)] = i
    assert got == want


def python_similarity(a, b, stop):
    toks = lambda s: {w for w in s.split() if len(w) > 1 and w not in stop}
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.92
    qa, qb = toks(a), toks(b)
    if not qa or not qb:
        return 0.0
    o = len(qa & qb)
    return min(1.0, 0.65 * o / len(qa) + 0.35 * o / len(qa | qb))


@pytest.mark.parametrize("theta", [0.66, 0.75, 0.9])
def test_similarity_join_is_exact(spark, theta):
    rnd = random.Random(5)
    words = ["a", "of", "art", "smart", "gene", "genes", "fold", "protein", "x1", "the", "map", "deep", "net"]
    make = lambda n: [" ".join(rnd.choices(words, k=rnd.randint(1, 7))) for _ in range(n)]
    left, right = set(make(120)), set(make(120)) | {"ar", "m", "rt ge"}
    from bibspark import constants as K
    want = {(a, b): python_similarity(a, b, K.STOP_WORDS) for a in left for b in right}
    want = {k: round(v, 6) for k, v in want.items() if v >= theta}
    df = lambda rows: spark.createDataFrame([(r,) for r in rows], "t string")
    rows = similarity.similar_titles(df(left), "t", df(right), "t", theta).collect()
    assert len(rows) == len({(r.q_norm, r.t_norm) for r in rows})
    assert {(r.q_norm, r.t_norm): round(r.similarity, 6) for r in rows} == want


def greedy(entries, known):
    taken = {k: set(v) for k, v in known.items()}
    out = {}
    for o, *values in entries:
        reason = next((k for k, v in zip(("doi", "key", "title"), values) if v and v in taken[k]), "")
        out[o] = reason
        if not reason:
            for k, v in zip(("doi", "key", "title"), values):
                if v:
                    taken[k].add(v)
    return out


def test_batch_acceptance(spark):
    rnd = random.Random(11)
    entries = [(i, rnd.choice(["", *"abcdefgh"]), f"k{rnd.randrange(30)}", rnd.choice(["", *(f"t{j}" for j in range(15))])) for i in range(60)]
    known = {"doi": {"h"}, "key": {"k3"}, "title": {"t7"}}
    reg = spark.createDataFrame([("h", "", ""), ("", "K3", ""), ("", "", "T7")], "doi string, bibtex_key string, resolved_title string")
    df = spark.createDataFrame(entries, "ord bigint, doi string, bibtex_key string, title string")
    got = {r.ord: (r.reason, r.accepted) for r in accept.accept_batch(df, reg).collect()}
    want = greedy(entries, known)
    assert {o: r for o, (r, _) in got.items()} == want
    assert all(ok == (r == "") for r, ok in got.values())


def test_minted_keys_block_later_entries_only(spark):
    rnd = random.Random(12)
    entries = [(i, rnd.choice(["", "", *"abcdef"]), rnd.choice(["", "", *(f"k{j}" for j in range(9))]), rnd.choice(["", "", "t1", "t2"]), f"k{rnd.randrange(9)}") for i in range(80)]
    entries = [(o, d, k, t, "" if k else m) for o, d, k, t, m in entries]
    taken, want = {"d": {"b"}, "k": {"k3"}, "t": set()}, {}
    for o, d, k, t, m in entries:
        want[o] = next((n for n, kind, v in (("doi", "d", d), ("key", "k", k), ("title", "t", t)) if v and v in taken[kind]), "")
        if not want[o]:
            for kind, v in (("d", d), ("k", k or m), ("t", t)):
                if v:
                    taken[kind].add(v)
    df = spark.createDataFrame(entries, "ord bigint, doi string, bibtex_key string, title string, minted_key string")
    reg = spark.createDataFrame([("b", "k3", "")], "doi string, bibtex_key string, resolved_title string")
    assert {r.ord: r.reason for r in accept.accept_batch(df, reg).collect()} == want


def test_batch_acceptance_example(spark):
    df = spark.createDataFrame([(0, "d1", "", "t1"), (1, "d1", "", "t2"), (2, "d2", "", "t2")], "ord bigint, doi string, bibtex_key string, title string")
    empty = spark.createDataFrame([], "doi string, bibtex_key string, resolved_title string")
    assert [r.accepted for r in accept.accept_batch(df, empty).orderBy("ord").collect()] == [True, False, True]


def test_upsert_twice_changes_nothing(spark, sf):
    r = V.registry_only(spark, sf)
    upd = r.filter("row_ord % 5 = 0").withColumn("year", F.lit("1900"))
    once = maintain.upsert(r, upd)
    twice = maintain.upsert(once, upd)
    assert once.exceptAll(twice).isEmpty() and once.count() == r.count()


def test_merge_never_blanks(spark, sf):
    r = V.registry(spark, sf)
    pairs = r.filter("row_ord % 2 = 0 and row_ord < 198").select("paper_id", F.concat(F.lit("doc-"), (F.col("row_ord") + 1).cast("string"))).toDF("keep_id", "drop_id")
    merged = maintain.merge_pairs(r, pairs, force=True).registry.select("paper_id", *[F.col(c).alias(f"n_{c}") for c in maintain.MERGED_FIELDS])
    j = r.join(merged, "paper_id")
    lost = [F.col(c) != "" for c in maintain.MERGED_FIELDS]
    cond = F.lit(False)
    for c in maintain.MERGED_FIELDS:
        cond = cond | ((T.clean_text(c) != "") & (F.col(f"n_{c}") != F.col(c)))
    assert lost and j.filter(cond).isEmpty()


def test_unique_match_skips_shared_keys(spark):
    reg = spark.createDataFrame([("p1", "10.1/a", "T one", "2000", 0), ("p2", "10.1/a", "T two", "2000", 1), ("p3", "", "T two", "2001", 2)],
                                "paper_id string, doi string, resolved_title string, year string, row_ord bigint").withColumn(
        "semantic_scholar_paper_id", F.lit("")).withColumn("title_query", F.lit(""))
    inc = spark.createDataFrame([("i1", "", "10.1/A", "t two", "2000"), ("i2", "", "", "t  TWO", "2001"), ("i3", "", "10.1/a", "other", "2000")],
                                "paper_id string, s2_id string, doi string, title string, year string")
    got = {r.paper_id: (r.matched_id, r.matched_by) for r in resolve.match_existing(inc, reg).collect()}
    assert got == {"i1": ("p2", "title_year"), "i2": ("p3", "title_year"), "i3": ("", "")}


def test_reconcile_reasons(spark):
    row = ("A title", "", "Jane Roe", "2001", "bioRxiv", "10.1101/1")
    df = spark.createDataFrame([row], "resolved_title string, title_query string, authors string, year string, venue string, doi string")
    same = {"title": F.lit("A title"), "authors": F.lit("Jane Roe"), "year": F.lit("2001"), "venue": F.lit("biorxiv"), "doi": F.lit("10.1101/1")}
    assert df.select(rebuild.rewrite_reasons(same)).first()[0] == []
    assert df.select(rebuild.rewrite_reasons(same | {"venue": F.lit("Nature")})).first()[0] == ["preprint_to_journal"]
    moved = same | {"doi": F.lit("10.1038/x"), "year": F.lit("2002"), "authors": F.lit("Ann Doe")}
    assert df.select(rebuild.rewrite_reasons(moved)).first()[0] == [
        "doi_changed", "year_changed", "first_author_changed", "preprint_doi_to_journal_doi"]


def test_cluster_classes(spark):
    base = dict(paper_id="a", content_kind="pdf_backed", match_status="matched", filename="x.pdf", pdf_path="p", resolved_title="T", title_query="",
                notes="", doi="", bibtex_key="", year="2000", canonical_url="", pdf_sha256="s")
    def run(*rows):
        df = spark.createDataFrame([{**base, **r, "row_ord": i} for i, r in enumerate(rows)])
        c = linkage.classify_clusters(linkage.with_member_facts(df.withColumn("component", F.lit(0)))).first()
        return c.classification, c.preferred_keep_paper_id
    assert run({}, {"paper_id": "b"}) == ("exact_pdf_content_duplicate", "b")
    assert run({"pdf_sha256": "1", "doi": "10.1/a"}, {"paper_id": "b", "pdf_sha256": "2", "doi": "10.1/A"})[0] == "likely_duplicate_pdf_copies"
    assert run({}, {"paper_id": "b", "filename": "x SI.pdf"}) == ("main_plus_supplement", "a")
    assert run({"resolved_title": ""}, {"paper_id": "b"})[0] == "malformed_rows"
    assert run({"content_kind": "reference_only", "bibtex_key": "K"}, {"paper_id": "b", "bibtex_key": "k", "pdf_sha256": ""}) == ("likely_duplicate_records", "b")


def test_citation_runs(spark):
    df = spark.createDataFrame([([3, 1, 2, 7, 5, 6, 10],), ([1, 2],), ([],), ([4, 4],)], "ns array<bigint>")
    assert [r[0] for r in df.select(cite.collapse_runs("ns")).collect()] == ["1–3,5–7,10", "1,2", "", "4"]


def test_supplement_parent_prefers_own_folder(spark):
    reg = spark.createDataFrame([("p1", 0, "articles/a/x.pdf", "Deep models of protein folding", "matched"), ("p2", 1, "articles/b/y.pdf", "Deep models of protein folding", "matched"),
                                 ("p3", 2, "articles/b/z.pdf", "Some other thing altogether here", "matched")],
                                "paper_id string, row_ord bigint, pdf_path string, resolved_title string, match_status string").withColumn("title_query", F.lit(""))
    supp = spark.createDataFrame([("s1", "articles/b/s.pdf", ["Supporting information for Deep models of protein folding"]), ("s2", "articles/c/s.pdf", ["Deep models of protein folding"]),
                                  ("s3", "articles/b/t.pdf", ["Nothing like the known titles"])], "paper_id string, pdf_path string, title_candidates array<string>")
    got = {r.paper_id: r.parent_id for r in resolve.supplement_parents(supp, reg).collect()}
    assert got == {"s1": "p2", "s2": "p1"}


def test_bib_audit_positions(spark):
    raw = ["@a{k1,\n t={x}}", "@a{k2, t={y}}", "@a{k1, t={z @b{c}}}", "@a{bad t={}", "@a{k1, t={w}} tail"]
    df = spark.createDataFrame(list(enumerate(raw)), "ord bigint, raw string")
    got = {(r.kind, r.bibtex_key, r.ord, r.other_ord) for r in bib.audit(bib.parse_entries(df)).collect()}
    assert got == {("duplicate_key", "k1", 2, 0), ("duplicate_key", "k1", 4, 0), ("embedded_header", "", 2, None),
                   ("parse_error", "", 3, None), ("trailing_text", "", 4, None)}


def test_resolution_decisions(spark, sf):
    facts = materialize(resolve.with_text_facts(V.planted_texts(spark, sf)), "facts")
    rows = resolve.resolve_dois(facts, V.works(spark, sf)).collect()
    for r in rows:
        want = "accepted" if r.best_score >= 0.55 else "review" if r.best_score >= 0.35 else "rejected"
        assert r.decision == want and r.best_doi.startswith("10.1234/")
    assert {r.decision for r in rows} >= {"accepted", "rejected"}


def test_refresh_refuses_losses(spark, sf):
    r = V.registry_only(spark, sf)
    rebuilt = r.drop("row_ord").withColumn("year", F.when(F.col("paper_id") == "doc-1", "").otherwise(F.col("year")))
    planned, refused = rebuild.refresh(r, rebuilt)
    problems = {x.paper_id: x.problems for x in refused.collect()}
    assert problems["doc-1"] == ["loss:year"]
    assert planned.filter("paper_id = 'doc-1'").first().year != "" and planned.count() == r.count()


def test_outcome_counts(spark, sf):
    got = quality.outcome_counts(V.registry(spark, sf), pdf=F.col("content_kind") == "pdf_backed").first()
    assert (got.total, got.pdf) == (200, 180)


def _merge_rows(spark):
    rows = [(f"p{i}", f"10.1/same", f"title {i}" if i > 1 else "", "note three" if i == 3 else "", i) for i in range(1, 6)]
    r = spark.createDataFrame(rows, "paper_id string, doi string, resolved_title string, notes string, row_ord bigint")
    for c in K.REGISTRY_FIELDS:
        if c not in r.columns:
            r = r.withColumn(c, F.lit(""))
    return r


def _merged(spark, pairs):
    m = maintain.merge_pairs(_merge_rows(spark), spark.createDataFrame(pairs, "keep_id string, drop_id string"))
    rows = {x.paper_id: (x.resolved_title, x.notes) for x in m.registry.collect()}
    return rows, sorted((x.keep_id, x.drop_id, x.reason) for x in m.refused.collect()), sorted((x.keep_id, x.drop_id) for x in m.merged.collect())


def test_merge_chain_ends_in_one_survivor(spark):
    rows, refused, merged = _merged(spark, [("p1", "p2"), ("p2", "p3")])
    assert set(rows) == {"p1", "p4", "p5"} and rows["p1"] == ("title 2", "note three")
    assert refused == [] and merged == [("p1", "p2"), ("p1", "p3")]


def test_merge_circle_keeps_its_first_row(spark):
    rows, refused, _ = _merged(spark, [("p1", "p2"), ("p2", "p1")])
    assert set(rows) == {"p1", "p3", "p4", "p5"} and rows["p1"][0] == "title 2"
    assert refused == [("p2", "p1", "keep_is_dropped")]


def test_merge_of_one_row_into_two_takes_the_first(spark):
    rows, refused, merged = _merged(spark, [("p4", "p3"), ("p1", "p3"), ("p1", "p1"), ("p1", "p9")])
    assert set(rows) == {"p1", "p2", "p4", "p5"} and rows["p1"][1] == "note three" and rows["p4"][1] == ""
    assert ("p4", "p3", "already_dropped") in refused and merged == [("p1", "p3")]


def test_repeated_works_give_one_attempt(spark, sf):
    facts = resolve.with_text_facts(V.planted_texts(spark, sf)).filter("size(doi_candidates) > 0").limit(40)
    works = V.works(spark, sf)
    once, twice = resolve.resolve_dois(facts, works), resolve.resolve_dois(facts, works.unionByName(works))
    assert once.count() == twice.count() and once.select("paper_id", "decision").exceptAll(twice.select("paper_id", "decision")).isEmpty()


def test_similar_titles_reach_down_to_reviewable_scores(spark):
    long = " ".join(f"word{i}" for i in range(1000))
    left = spark.createDataFrame([("alpha beta gamma delta",), (long,)], "q string")
    right = spark.createDataFrame([("alpha beta gamma omega sigma",), ("zeta",), (long + " tail",)], "t string")
    got = {(r.q_norm[:10], r.t_norm[:10]): r.similarity for r in similarity.similar_titles(left, "q", right, "t", 0.6).collect()}
    assert got[("alpha beta", "alpha beta")] == pytest.approx(0.65 * 3 / 4 + 0.35 * 3 / 6) and got[("word0 word", "word0 word")] == 0.92


def test_title_keys_are_prefixes(spark):
    """A title of 3,000 words gives no more keys than its prefix, and no array is shuffled."""
    long = " ".join(f"word{i}" for i in range(3000))
    left = spark.createDataFrame([("alpha beta gamma delta",), (long,)], "q string")
    right = spark.createDataFrame([("alpha beta gamma omega sigma",), (long + " tail",)], "t string")
    for theta in (0.63, 0.7, 0.9):
        prepared = similarity.prepare(left, "q", right, "t")
        keys = similarity.title_keys(prepared.words, theta).groupBy("t", "size_t").count().collect()
        assert {r.size_t for r in keys} == {5, 3001} and all(r["count"] <= r.size_t for r in keys)
        asked = similarity.query_keys(prepared.words, theta, 3001).groupBy("q", "size_q").count().collect()
        assert all(r["count"] <= 2 * (1 - theta) * r.size_q + 12 for r in asked)
        shuffled = (prepared.titles, prepared.words, similarity.query_keys(prepared.words, theta, 3001), similarity.title_keys(prepared.words, theta),
                    similarity.overlap_candidates(prepared.words, theta))
        assert not any("array" in kind for frame in shuffled for _, kind in frame.dtypes)


def test_containment_keys_miss_nothing(spark):
    rnd = random.Random(3)
    words = ["a", "ab", "abc", "bc", "c", "cab", "the", "of"]
    titles = sorted({" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(250)})
    df = spark.createDataFrame(list(enumerate(titles)), "id bigint, s string")
    found = {(titles[r.small], titles[r.big]) for r in similarity.contained_pairs(df, df).collect() if r.small != r.big}
    want = {(a, b) for a in titles for b in titles if a != b and a in b}
    assert want <= found and len(found) < 0.6 * len(titles) ** 2


@pytest.mark.parametrize("rounds", [(), (0.92,), (0.9, 0.75)])
def test_candidates_by_descending_threshold(spark, rounds):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(14)]
    make = lambda n: [" ".join(rnd.choices(words, k=rnd.randint(2, 7))) for _ in range(n)]
    queries, titles = make(60), make(300)
    titles += titles[:40] + queries[:5] * 3 + [""]
    cands = [(f"C{i}", t) for i, t in enumerate(titles)]
    from bibspark import constants as K
    got = resolve.retrieve_candidates(spark.createDataFrame([(q,) for q in queries], "query string"),
                                      spark.createDataFrame(cands, "paperId string, title string"), 4, 0.63, rounds).collect()
    got = {r.q_norm: [(x.n, round(x.similarity, 6), x.c.paperId) for x in r.found] for r in got}
    for q in set(queries):
        scored = sorted((-python_similarity(q, t, K.STOP_WORDS), i) for i, t in cands if t)
        want = [(n + 1, round(-s, 6), i) for n, (s, i) in enumerate([x for x in scored if -x[0] >= 0.63][:4])]
        assert got.get(q, []) == want


def test_dois_behind_every_window_are_found(spark):
    text = "x " * 12_000 + "see doi: 10.1234/abc.000042 here"
    d = spark.createDataFrame([(text, "f.pdf")], "text string, filename string")
    row = d.select(P.doi_candidates("text", "filename").alias("c")).first()
    assert [(c.doi, c.source_region) for c in row.c] == [("10.1234/abc.000042", "body")]


def test_search_takes_more_queries_than_fit_one_pass(spark, sf):
    ix = index.build_search_index(V.registry(spark, sf), None, V.journals(spark, sf))
    words = [r.w for r in V.registry(spark, sf).select(F.regexp_extract(F.lower("resolved_title"), "[a-z]+", 0).alias("w")).filter("w <> ''").distinct().limit(70).collect()]
    got = search.search_many(ix, words, limit=1)
    assert got.select("query_id").distinct().count() > 64
