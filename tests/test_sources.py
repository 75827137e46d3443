"""Readers, writers and incremental ingest."""
import hashlib

from pyspark.sql import functions as F

from bibspark import sources as S
from bibspark.operators import bib
from bibspark.plans import views as V
from bibspark.streaming import ingest as G


def test_registry_tsv_round_trip(spark, sf, tmp_path):
    r = V.registry_only(spark, sf).withColumn("notes", F.when(F.col("row_ord") == 3, 'say "x"\tand\nmore').otherwise(F.col("notes")))
    S.write_registry_tsv(r.coalesce(1), str(tmp_path / "r"))
    back = S.read_registry_tsv(spark, str(tmp_path / "r"))
    cols = [c for c in back.columns if c not in ("row_ord", "bibtex_type")]
    assert r.select(cols).exceptAll(back.select(cols)).isEmpty() and back.count() == 200


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    S.write_version(spark.range(3), root, 1)
    S.write_version(S.read_latest(spark, root).unionAll(spark.range(3, 5)), root, 2)
    assert S.read_latest(spark, root).count() == 5


def test_records_round_trip(spark, sf, tmp_path):
    rec = V.records(spark, sf).drop("row_ord")
    S.write_records(rec, str(tmp_path / "rec"), "/library")
    raw = spark.read.json(str(tmp_path / "rec"))
    assert raw.filter("pdf_path like '/library/%'").isEmpty()
    back = spark.read.schema(rec.schema).json(str(tmp_path / "rec"))
    assert S.map_record_paths(back, lambda p: S.absolute(p, "/library")).select("paper_id", "pdf_path").exceptAll(
        rec.select("paper_id", "pdf_path")).isEmpty()
    one = tmp_path / "one"
    one.mkdir()
    (one / "a.json").write_text('{\n "paper_id": "a",\n "pdf_path": "articles/x.pdf"\n}')
    (one / "b.json").write_text("{ broken")
    got = S.read_records(spark, str(one), "/lib").collect()
    assert [(g.paper_id, g.pdf_path) for g in got] == [("a", "/lib/articles/x.pdf")]


def test_files_and_texts(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/temp_uploads").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"one")
    (tmp_path / "in/sub/B.PDF").write_bytes(b"two")
    (tmp_path / "in/.hidden.pdf").write_bytes(b"three")
    (tmp_path / "in/temp_uploads/c.pdf").write_bytes(b"four")
    root = str(tmp_path / "in")
    assert sorted(r.path for r in S.list_files(spark, root).collect()) == ["a.pdf", "sub/B.PDF"]
    hashes = {r.path: r.sha256 for r in S.hash_files(spark, root).collect()}
    assert hashes["a.pdf"] == hashlib.sha256(b"one").hexdigest()
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/p1.txt").write_text("x\n\ny")
    assert [tuple(r) for r in S.read_texts(spark, str(tmp_path / "txt")).collect()] == [("p1", "x\n\ny")]


def test_bibliography_round_trip(spark, sf, tmp_path):
    parsed = bib.parse_entries(V.bib_entries(spark, sf))
    S.write_bibliography(parsed, str(tmp_path / "bib"), single_file=True)
    back = bib.parse_entries(S.read_bibliography(spark, str(tmp_path / "bib")))
    cols = ["bibtex_key", "entry_type", F.array_sort(F.map_entries("fields")).alias("f"), "error"]
    assert back.select(cols).exceptAll(parsed.select(cols)).isEmpty() and back.count() == parsed.count()
    keys = [r.bibtex_key for r in back.orderBy("ord").collect()]
    assert keys == sorted(keys)


def test_selection_reasons(spark, sf):
    r = V.registry(spark, sf)
    files = r.filter("pdf_path <> ''").select(F.col("pdf_path").alias("path")).unionByName(spark.createDataFrame([("new.pdf",)], "path string"))
    assert [x.reason for x in G.select_for_ingest(files, r).collect()] == ["unindexed"]
    reasons = {x.reason for x in G.select_for_ingest(files, r, statuses=("not_found",)).collect()}
    assert reasons <= {"unindexed", "status:not_found"}
    assert G.select_for_ingest(files, r, force=True).count() == files.count()


def items(docs):
    d = F.col("doc_id")
    e = F.lit("")
    return docs.select(d.alias("ord"), F.concat(F.lit("articles/"), d.cast("string"), F.lit(".pdf")).alias("path"), "text", e.alias("s2_id"),
                       F.concat(F.lit("Item "), d.cast("string")).alias("title"), F.lit("J R").alias("authors"), F.lit("2020").alias("year"),
                       e.alias("venue"), e.alias("doi"), e.alias("url"))


def test_stream_equals_batch_and_reruns_are_safe(spark, sf, tmp_path):
    docs = V.documents(spark, sf)
    base = str(tmp_path)
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        G.start_ingest(spark.readStream.schema(docs.schema).parquet(f"{base}/in"), items, f"{base}/reg", f"{base}/cp",
                       f"{base}/chunks", f"{base}/log").awaitTermination()
    streamed = {r.pdf_sha256 for r in G.read_registry(spark, f"{base}/reg").collect()}
    G.ingest_batch(items(docs), f"{base}/reg2", 0)
    once = {r.pdf_sha256 for r in G.read_registry(spark, f"{base}/reg2").collect()}
    G.ingest_batch(items(docs), f"{base}/reg2", 0)
    again = G.read_registry(spark, f"{base}/reg2")
    assert streamed == once == {r.pdf_sha256 for r in again.collect()}
    assert again.count() == len(once)
    G.ingest_batch(items(docs), f"{base}/reg2", 1)
    assert G.read_registry(spark, f"{base}/reg2").count() == len(once)


def test_two_checkpoints_share_one_registry(spark, sf, tmp_path):
    docs, base = V.documents(spark, sf), str(tmp_path)
    counts = []
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).write.parquet(f"{base}/in{part}")
        stream = spark.readStream.schema(docs.schema).parquet(f"{base}/in{part}")
        G.start_ingest(stream, items, f"{base}/reg", f"{base}/cp{part}").awaitTermination()
        counts.append(G.read_registry(spark, f"{base}/reg").count())
    assert counts == [docs.filter("doc_id % 2 = 0").select("text").distinct().count(), docs.select("text").distinct().count()]
    G.compact_registry(spark, f"{base}/reg", f"{base}/new")
    assert G.read_registry(spark, f"{base}/new").exceptAll(G.read_registry(spark, f"{base}/reg")).isEmpty()


def test_rows_are_numbered_in_file_order(spark, sf, tmp_path):
    r = V.registry_only(spark, sf)
    for name, rows in (("a.tsv", r.filter("paper_id = 'doc-199'")), ("b.tsv", r.filter("row_ord < 50") if "row_ord" in r.columns else r.limit(50))):
        S.write_registry_tsv(rows.coalesce(1), str(tmp_path / f"out-{name}"))
        part = next((tmp_path / f"out-{name}").glob("part-*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(part.read_bytes())
    got = S.read_registry_tsv(spark, str(tmp_path / "in")).orderBy("row_ord").collect()
    assert got[0].paper_id == "doc-199" and [x.row_ord for x in got] == list(range(len(got)))


def test_roots_are_plain_text(spark):
    d = spark.createDataFrame([("/data/a+b/x.pdf",), ("/data/aab/x.pdf",)], "p string")
    from bibspark.sources import tables
    assert [x[0] for x in d.select(tables.relative(F.col("p"), "/data/a+b")).collect()] == ["x.pdf", "/data/aab/x.pdf"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """Quoted line breaks, quotes and empty lines across splits: the rows and order of a plain reader."""
    import csv
    import random
    rnd = random.Random(4)
    bits = ["a", "b c", '"', '""', "\n", "\n\n", "\t", "x\ty", ",", "é", "long " * 30, ""]
    cols = [f.name for f in __import__("bibspark.schemas").schemas.JOURNALS]
    folder = tmp_path / "j"
    folder.mkdir()
    want = []
    for k in range(3):
        with open(folder / f"f{k}.tsv", "w", newline="") as f:
            w = csv.writer(f, delimiter="\t", lineterminator="\n")
            w.writerow(cols)
            for i in range((0, 400, 250)[k]):
                row = [f"{k}-{i}"] + ["".join(rnd.choices(bits, k=rnd.randrange(4))) for _ in cols[1:]]
                want.append(tuple(row))
                w.writerow(row)
                if i % 50 == 7:
                    f.write("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        tasks = spark.read.text(str(folder)).rdd.getNumPartitions()
        rows = S.read_journals(spark, str(folder)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 10
    assert [r.ord for r in rows] == list(range(650))
    assert [tuple(r[c] for c in cols) for r in rows] == want


def test_ingest_folds_old_batches_into_snapshots(spark, tmp_path):
    """Snapshots change neither the registry nor a batch that runs again, and later batches skip what they cover."""
    def batch(n):
        rows = [(i, f"articles/{n}-{i}.pdf", f"Text {n} {i} " * 20, "", f"Title number {n} {i}", "Ann Lee", "2001", "Cell", f"10.1/x{n}{i}", "") for i in range(3)]
        return spark.createDataFrame(rows, "ord bigint, path string, text string, s2_id string, title string, authors string, year string, venue string, doi string, url string")

    state = lambda root: sorted(map(tuple, G.read_registry(spark, root).collect()))
    plain, folded = str(tmp_path / "plain"), str(tmp_path / "folded")
    for n in range(5):
        G.ingest_batch(batch(n), plain, n, stream_id="s", compact_after=100)
        G.ingest_batch(batch(n), folded, n, stream_id="s", compact_after=1)
    assert state(plain) == state(folded) and len(state(plain)) == 15
    numbers = [r.seq for r in spark.read.schema("part string, seq bigint").json(f"{folded}/_snapshots").collect()]
    assert sorted(numbers) == [1, 3]
    read = G.current_deltas(spark, folded)
    assert {r.seq for r in read.select("seq").distinct().collect()} == {3, 4} and read.count() == 12 + 3
    G.ingest_batch(batch(4), folded, 4, stream_id="s", compact_after=1)  # runs again
    assert state(plain) == state(folded)
