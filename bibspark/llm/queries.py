"""Registered queries of the subpackage and their SQL twins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, jaccard, langid, licenses, lm, packing, pieces, pii, runs, topk, urls, whitening

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(c: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(folds))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_exact_dedup", f"""
WITH t AS (SELECT doc_id, {LOWER_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_groups(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    return langid.identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


#: fixed values of the registered query: (action, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "net", "/fr/")]


@query("op10_url_filter")
def op10_url_filter(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def vocabulary(name: str) -> bytes:
    """Bytes of a public tokenizer's file, read on the driver; executors get them with the tasks."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links_found")


@query("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op3_lm_score")
def op3_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 7) == 2
    scored = lm.score_texts(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: the key of the registered query and of the pipeline; a deployment passes its own secret
PII_KEY = b"surrogate-key-for-tests"


@query("op9_pii_surrogates")
def op9_pii_surrogates(spark, sf_dir):
    out = pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_entities"), F.concat_ws(",", F.array_sort(F.array_distinct("pii_kinds"))).alias("kinds"))


@query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    """Tokens of every turn of ``conversations`` and whether they decode to its text."""
    import public_tokenizers
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    both = pieces.decode(pieces.encode(turns, model), model)
    return both.select("conv_id", "turn", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth text (by the crc32 of its id) goes on in a circle from one of its words.

    With h the checksum, g = floor(h / 10) and n words, each word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.expr("_h div 10")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # texts outside the tenth are not split
    d = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), words))
    d = d.withColumn("_n", F.size("_w").cast("long")).withColumn("_a", F.when(F.col("_n") > 0, g % F.greatest("_n", F.lit(1))))
    d = d.withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)"))
    turned = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return d.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = runs.find_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.col("best")
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
r AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
      FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r)
SELECT query_id, rank::integer AS rank, vec_id, score FROM n WHERE rank <= 10"""


@query("op13_exact_topk", OP13_SQL)
def op13_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
