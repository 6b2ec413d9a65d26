"""Retrieval of candidate standards: exact dense top-k, BM25, their union, and candidates of several names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_variants
from .dense import topk_cosine
from .sparse import bm25, tokens  # noqa: F401  part of this module's interface

def merge_dense(name_hits: DataFrame, meaning_hits: DataFrame, k: int = 10, name_weight: float = 0.6) -> DataFrame:
    """query_id, std_id, score, rank: the k best by the weighted sum. A standard absent from one window adds nothing for it; of equal scores
    those found by name come first, then the smaller id."""
    n = name_hits.select("query_id", "std_id", F.col("score").alias("__n"))
    m = meaning_hits.select("query_id", "std_id", F.col("score").alias("__m"))
    both = n.join(m, ["query_id", "std_id"], "full_outer")
    score = F.lit(name_weight) * F.coalesce("__n", F.lit(0.0)) + F.lit(1.0 - name_weight) * F.coalesce("__m", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("__n").isNull(), "std_id")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "std_id", "score", "rank")


def dense_search(queries: DataFrame, standards: DataFrame, k: int = 10, name_weight: float = 0.6, by: str | None = "std_type") -> DataFrame:
    """queries: query_id, name_vector, meaning_vector[, std_type]; standards: std_id and the same. Each path looks at max(5k, 50)."""
    window = max(5 * k, 50)
    side = lambda v: topk_cosine(queries.withColumn("vector", F.col(v)), standards.withColumn("vector", F.col(v)), window, "query_id", "std_id", by=by)
    return merge_dense(side("name_vector"), side("meaning_vector"), k, name_weight)


def hybrid_union(dense: DataFrame, name_sparse: DataFrame, meaning_sparse: DataFrame) -> DataFrame:
    """query_id, std_id, three scores (4 digits, absent 0), source and place: dense hits first, then those only sparse by name, then only by
    meaning, each by rank. Each input: query_id, std_id, score, rank."""
    paths = [("dense", dense), ("name", name_sparse), ("meaning", meaning_sparse)]
    rows = None
    for n, (name, df) in enumerate(paths):
        part = df.select("query_id", "std_id", F.lit(n).alias("path"), "rank", *[F.when(F.lit(name == x), F.round("score", 4)).alias(x) for x, _ in paths])
        rows = part if rows is None else rows.unionByName(part)
    got = rows.groupBy("query_id", "std_id").agg(
        F.min(F.struct("path", "rank")).alias("first"), *[F.max(x).alias(x) for x, _ in paths], F.count(F.lit(1)).alias("n"),
    )
    d = F.col("dense").isNotNull()
    source = F.when(d & (F.col("n") == 1), "dense").when(d, "both").when(F.col("n") == 2, "sparse_both").when(F.col("name").isNotNull(), "name_sparse").otherwise("meaning_sparse")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return got.select(
        "query_id", "std_id", *[F.coalesce(x, F.lit(0.0)).alias(c) for x, c in (("dense", "dense_score"), ("name", "name_sparse_score"), ("meaning", "meaning_sparse_score"))],
        source.alias("source"), place.cast("int").alias("place"),
    )


def fetch_candidates(hits: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The hits with their standards' columns, those that the dictionary lacks dropped."""
    return hits.join(dictionary.select("std_id", "std_name", "std_type", "definition", "domain_id", "domain_name", "domain_type"), "std_id")


def explode_names(fields: DataFrame, name_col: str = "field_name") -> DataFrame:
    """fields with variant and variant_pos: the name itself (0), then its synonyms."""
    return fields.select("*", F.posexplode(name_variants(name_col)).alias("variant_pos", "variant"))


def merge_variants(hits: DataFrame) -> DataFrame:
    """row_index, std_id, three scores, source and place of hits of all variants (row_index, variant, variant_pos, std_id, place, scores): the largest
    score of each path; the place of the first variant that found it; source tells which name found it on which paths."""
    paths = [("dense_score", "dense"), ("name_sparse_score", "name_sparse"), ("meaning_sparse_score", "meaning_sparse")]
    used = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(p)) for c, p in paths]))
    text = F.when(F.size(used) > 0, F.concat("variant", F.array_join(used, "、"), F.lit("召回")))
    rows = hits.withColumn("__text", text)
    merged = rows.groupBy("row_index", "std_id").agg(
        F.min(F.struct("variant_pos", "place")).alias("first"), *[F.max(c).alias(c) for c, _ in paths],
        F.sort_array(F.collect_list(F.when(F.col("__text").isNotNull(), F.struct("variant_pos", "__text")))).alias("texts"),
    )
    place = F.row_number().over(Window.partitionBy("row_index").orderBy("first", "std_id"))
    return merged.select(
        "row_index", "std_id", *[c for c, _ in paths], F.array_join(F.transform("texts", lambda t: t["__text"]), "；").alias("source"), place.cast("int").alias("place")
    )
