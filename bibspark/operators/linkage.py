"""Duplicate linkage: shared keys, connected components, classification, survivors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..session import materialize
from .index import row_title
from .joins import rank_within, split_lookup
from .quality import is_malformed, is_supplement

SALTS = 1024


def linkable(registry: DataFrame) -> DataFrame:
    """Rows that take part: everything but linked supplements."""
    return registry.filter(T.clean_text("match_status") != "matched_supplement")


def _key_columns(strict_compat: bool) -> list[tuple[str, Column]]:
    doi = T.normalize_doi("doi") if strict_compat else T.normalize_doi(T.clean_text("doi"))
    return [("doi", doi), ("bibtex_key", T.normalize_bib_key("bibtex_key")),
            ("title_year", T.title_year_key(row_title(), "year")), ("pdf_sha256", T.clean_text("pdf_sha256"))]


def relation_keys(rows: DataFrame, strict_compat: bool = False) -> DataFrame:
    """``(key_type, key, row_ord)``: one row per non-empty identity key.

    ``strict_compat`` also links rows whose DOI is a "no value" word.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("key_type"), c.alias("key")) for n, c in _key_columns(strict_compat)])
    return rows.select("row_ord", F.explode(pairs).alias("k")).select("k.*", "row_ord").filter("key <> ''")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Keys used by two or more rows."""
    return (keys.groupBy("key_type", "key").agg(F.count("*").alias("n_rows"), F.min("row_ord").alias("first_ord"))
            .filter("n_rows > 1"))


def star_edges(keys: DataFrame, salts: int = SALTS) -> DataFrame:
    """Edges that connect the rows of each key: two-level stars, never a clique.

    Rows of a key are first tied to the smallest row of their salt, then the salts' smallest
    rows to the smallest of all.  The largest group any task sees is 1/``salts`` of a key.
    """
    salt = F.pmod(F.xxhash64("row_ord"), F.lit(salts))
    local = keys.withColumn("hub", F.min("row_ord").over(Window.partitionBy("key_type", "key", salt)))
    spokes = local.filter("row_ord <> hub").select(F.col("row_ord").alias("a"), F.col("hub").alias("b"))
    hubs = local.filter("row_ord = hub").withColumn(
        "top", F.min("hub").over(Window.partitionBy("key_type", "key")))
    rims = hubs.filter("hub <> top").select(F.col("hub").alias("a"), F.col("top").alias("b"))
    return spokes.unionByName(rims)


def _contract(edges: DataFrame, order: Column | None) -> DataFrame:
    """Every node points to the smallest of itself and its neighbours; aggregates map-side."""
    rank = lambda c: F.struct(order(F.col(c)).alias("h"), F.col(c).alias("v"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        .select(F.col("a").alias("node"), F.least(rank("a"), F.col("best"))["v"].alias("label"))
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of an edge list; ``component`` is the smallest node.

    Contraction: each round maps every node to its smallest neighbour and replaces the edges by
    edges between the images, so nodes and edges shrink together.  Odd rounds order by node id
    (stars collapse at once), even rounds by a fresh hash (long chains halve in expectation).
    The maps are composed from the smallest back to the first.  Each round is written to the
    shared folder, which cuts the lineage.  Every round maps all nodes but the smallest of their neighbourhood to another
    one, so each component loses at least half of its nodes and the rounds end by themselves.
    """
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "edges")
    # the centre of a star has many edges on the left of these joins; adaptive execution splits such partitions (left sides may be split)
    maps: list[DataFrame] = []
    while left.count():  # from the file footers
        seed = len(maps)
        order = (lambda c: c) if seed % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(seed)))
        step = materialize(_contract(left, order), "labels")
        maps.append(step)
        la = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = left.join(la, "a", "left").join(lb, "b", "left").filter("la <> lb")
        left = materialize(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(),
                           "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    roots = maps[-1]
    for step in reversed(maps[:-1]):
        onward = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
        roots = materialize(
            step.join(onward, "label", "left")
            .select("node", F.coalesce("root", "label").alias("label")), "roots")
    smallest = roots.groupBy("label").agg(F.min(F.least("node", "label")).alias("component"))
    return roots.join(smallest, "label", "left").select("node", "component")


def duplicate_members(rows: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Registry rows that belong to a cluster of two or more, with ``component`` (its smallest row)."""
    members = connected_components(star_edges(relation_keys(rows, strict_compat)))
    return rows.join(members.withColumnRenamed("node", "row_ord"), "row_ord")


# --- per-cluster facts --------------------------------------------------------------------

def keep_score() -> Column:
    """Ordering struct of a row as survivor: points, then the single criteria, then the id."""
    pdf = T.clean_text("content_kind") == K.PDF_BACKED
    main = ~is_supplement("audit")
    doi = T.is_filled("doi")
    points = (
        F.when(pdf, 100).otherwise(0) + F.when(main, 50).otherwise(0) + F.when(doi, 20).otherwise(0)
        + F.when(T.is_filled("canonical_url"), 10).otherwise(0)
        + F.when(T.clean_text("match_status").isin(K.KEEP_STATUSES), 5).otherwise(0)
        + F.when(F.contains(T.clean_text("filename"), F.lit(" - ")), 3).otherwise(0))
    return F.struct(points.alias("points"), pdf.cast("int").alias("pdf"), main.cast("int").alias("main"),
                    doi.cast("int").alias("doi"), T.clean_text("paper_id").alias("id"))


def with_member_facts(members: DataFrame) -> DataFrame:
    clean_doi = F.when(T.is_filled("doi"), T.normalize_doi("doi")).otherwise("")
    return members.select(
        "component", "row_ord", "paper_id", "match_status",
        keep_score().alias("keep"), is_malformed().alias("malformed"), is_supplement("audit").alias("supplement"),
        (T.clean_text("content_kind") == K.PDF_BACKED).alias("pdf"),
        F.nullif(clean_doi, F.lit("")).alias("k_doi"),
        F.nullif(T.normalize_bib_key("bibtex_key"), F.lit("")).alias("k_bib"),
        F.nullif(T.title_year_key(row_title(), "year"), F.lit("")).alias("k_title_year"),
        F.nullif(T.clean_text("pdf_sha256"), F.lit("")).alias("k_sha"))


def _single(c: str) -> Column:
    """Exactly one distinct value among the rows that have one."""
    return F.coalesce(F.min(c) == F.max(c), F.lit(False))


def classify_clusters(facts: DataFrame) -> DataFrame:
    """One row per cluster: size, shared labels, class, advice, survivor.

    Only constant-size aggregates (min, max, any, every, max_by), so partial aggregation absorbs
    a cluster of any size.
    """
    c = facts.groupBy("component").agg(
        F.count("*").alias("size"), F.min("row_ord").alias("first_ord"),
        F.bool_or("malformed").alias("malformed"), F.bool_and("pdf").alias("all_pdf"),
        F.bool_or("supplement").alias("any_supp"), F.bool_and("supplement").alias("all_supp"),
        _single("k_doi").alias("same_doi"), _single("k_bib").alias("same_bibtex_key"),
        _single("k_title_year").alias("same_title_year"), _single("k_sha").alias("same_pdf_sha256"),
        F.max("keep")["id"].alias("preferred_keep_paper_id"))
    kind = (
        F.when(F.col("malformed"), "malformed_rows")
        .when(F.col("all_supp"), "supplement_cluster")
        .when(F.col("any_supp") & F.col("all_pdf"), "main_plus_supplement")
        .when(F.col("same_pdf_sha256") & F.col("all_pdf"), "exact_pdf_content_duplicate")
        .when(F.col("same_doi") & F.col("same_title_year") & F.col("all_pdf"), "likely_duplicate_pdf_copies")
        .when(F.col("same_bibtex_key") & F.col("same_title_year"), "likely_duplicate_records")
        .otherwise("manual_review"))
    labels = F.array_compact(F.array(*[
        F.when(F.col(n), n) for n in ("same_doi", "same_bibtex_key", "same_title_year", "same_pdf_sha256")]))
    advice = F.create_map(*[F.lit(x) for kv in K.DUPLICATE_ADVICE.items() for x in kv])
    return c.select(
        "component", "size", "first_ord", kind.alias("classification"), F.element_at(advice, kind).alias("recommendation"),
        labels.alias("shared_identity_labels"), "preferred_keep_paper_id")


def order_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.col("size").desc(), F.col("first_ord").asc())


def rank_members(facts: DataFrame) -> DataFrame:
    """Members in keep order, 1 is the survivor.  Balanced for clusters of any size."""
    return rank_within(facts, ["component"], [(F.col("keep"), "desc"), F.col("row_ord")], "keep_rank")


def summarize(rows: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """``(measure, n)``: totals, malformed rows outside clusters, clusters per class."""
    loose = rows.filter(is_malformed()).join(members.select("row_ord"), "row_ord", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    per_class = clusters.groupBy("classification").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("class:"), "classification").alias("measure"), "n")
    return (count(rows, "total_rows").unionByName(count(clusters, "duplicate_groups"))
            .unionByName(count(loose, "malformed_singletons")).unionByName(per_class))


def relation_counts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct keys per cluster and key type."""
    keys = relation_keys(rows).join(members.select("row_ord", "component"), "row_ord")
    return (keys.select("component", "key_type", "key").distinct()
            .groupBy("component", "key_type").agg(F.count("*").alias("n_keys")))


def plan_merges(facts: DataFrame, clusters: DataFrame,
                classes: tuple[str, ...] = ("exact_pdf_content_duplicate", "likely_duplicate_pdf_copies",
                                            "likely_duplicate_records")) -> DataFrame:
    """``(keep_id, drop_id)`` pairs of the clusters that are safe to consolidate."""
    safe = clusters.filter(F.col("classification").isin(*classes)).select("component", "preferred_keep_paper_id")
    return (
        split_lookup(facts.select("component", "paper_id"), safe, "component")
        .filter(F.col("preferred_keep_paper_id").isNotNull() & (F.col("paper_id") != F.col("preferred_keep_paper_id")))
        .select(F.col("preferred_keep_paper_id").alias("keep_id"), F.col("paper_id").alias("drop_id"))
    )
