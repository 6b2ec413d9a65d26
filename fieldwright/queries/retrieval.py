"""Queries of retrieval and of the jobs from end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enummap, maintain, retrieve, scoring
from ..plans import build, jobs
from ..sources.index import read_index
from ..sources.tables import shared_dir
from .derive import DICTIONARY_SQL, RESULTS_SQL, SHEET_SQL, dictionary, results, sheet, table

Q: dict = {}
O: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return keep


_COS = "list_cosine_similarity(a.e, b.e)"
_E = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"


@query(f"""SELECT 'v' || a.vec_id AS "value", 'I' || b.label AS item_id, 't' || b.vec_id AS value_text, round({_COS}, 5) AS score FROM ({_E}) a, ({_E}) b WHERE {_COS} >= 0.25
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, 'I' || b.label, 't' || b.vec_id) <= 20""")
def e8_enum_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("key", F.col("vec_id").cast("string"))
    texts = e.select(F.concat(F.lit("v"), "key").alias("value"), F.col("embedding").alias("vector"))
    known = e.select(F.concat(F.lit("t"), "key").alias("value_text"), F.col("embedding").alias("vector"), F.concat(F.lit("I"), F.col("label").cast("string")).alias("item_id"))
    hits = enummap.similar_values(texts, known.drop("item_id"), known.drop("vector"), top=20, least=0.25)
    return hits.select("value", "item_id", "value_text", F.round("score", 5).alias("score"))


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS std_id, round({_COS}, 5) AS score FROM ({_E}) a JOIN ({_E}) b ON a.label = b.label QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10""")
def e9_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    hits = retrieve.topk_cosine(
        e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "std_id"), 10, "query_id", "std_id", vec="embedding", by="label"
    )
    return hits.select("query_id", "std_id", F.round("score", 5).alias("score"))


_TWO = f"SELECT x.vec_id, x.label, x.e AS n, y.e AS m FROM ({_E}) x JOIN ({_E}) y ON y.vec_id = x.vec_id + 1 - 2 * (x.vec_id % 2)"
_MERGED = f"""WITH t AS ({_TWO}), p AS (SELECT a.vec_id AS q, b.vec_id AS i, list_cosine_similarity(a.n, b.n) AS sn, list_cosine_similarity(a.m, b.m) AS sm FROM t a JOIN t b ON a.label = b.label),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sn DESC, i) AS rn, row_number() OVER (PARTITION BY q ORDER BY sm DESC, i) AS rm FROM p),
 s AS (SELECT q, i, rn, 0.6::DOUBLE * CASE WHEN rn <= 50 THEN sn ELSE 0 END + 0.4::DOUBLE * CASE WHEN rm <= 50 THEN sm ELSE 0 END AS score FROM r WHERE rn <= 50 OR rm <= 50)
 SELECT q AS query_id, i AS std_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, rn > 50, i) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, rn > 50, i) <= 10"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") + 1 - 2 * (F.col("vec_id") % 2)).alias("vec_id"), F.col("embedding").alias("meaning_vector"))
    return e.join(other, "vec_id").select("vec_id", F.col("label").alias("std_type"), F.col("embedding").alias("name_vector"), "meaning_vector")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieve.dense_search(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "std_id"))


@query(f"SELECT query_id, std_id, round(score, 5) AS score, rank FROM ({_MERGED})")
def e10_dense_merge(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "std_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_TOK = "[a-z0-9à-öø-ÿœß]+"
_BM25 = f"""WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '{_TOK}') AS t FROM documents), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS w FROM benchmark),
 n AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d), p AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
 f AS (SELECT w, count(*) AS df FROM p GROUP BY w), s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))) AS score FROM q JOIN p USING (w) JOIN f USING (w), n GROUP BY ALL)
 SELECT item_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 5"""


@query(_BM25)
def e11_bm25(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), 5, "item_id", "doc_id")
    return hits.select("item_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_PATHS = [("dense", 3, 1, 0.07), ("name", 5, 2, 0.5), ("meaning", 7, 1, 0.3)]


def _path_sql(mult: int, step: int, fall: float) -> str:
    return f"SELECT c_custkey AS query_id, 'D' || lpad(CAST(((c_custkey * {mult} + r * {step}) % 20) AS VARCHAR), 7, '0') AS std_id, 3 - r * {fall}::DOUBLE AS score, r AS rank FROM customer, (SELECT unnest(range(1, 6)) AS r)"


def _path(spark: SparkSession, d: str, mult: int, step: int, fall: float) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    return c.selectExpr("query_id", f"'D' || lpad(CAST((query_id * {mult} + rank * {step}) % 20 AS STRING), 7, '0') AS std_id", f"3 - rank * {fall}D AS score", "rank")


_UNION = f"""WITH a AS ({_path_sql(*_PATHS[0][1:])}), n AS ({_path_sql(*_PATHS[1][1:])}), m AS ({_path_sql(*_PATHS[2][1:])}),
 k AS (SELECT query_id, std_id FROM a UNION SELECT query_id, std_id FROM n UNION SELECT query_id, std_id FROM m),
 j AS (SELECT k.*, a.score AS sa, n.score AS sn, m.score AS sm, CASE WHEN a.rank IS NOT NULL THEN a.rank WHEN n.rank IS NOT NULL THEN 10 + n.rank ELSE 20 + m.rank END AS o FROM k LEFT JOIN a USING (query_id, std_id) LEFT JOIN n USING (query_id, std_id) LEFT JOIN m USING (query_id, std_id))
 SELECT query_id, std_id, round(coalesce(sa, 0), 4) AS dense_score, round(coalesce(sn, 0), 4) AS name_sparse_score, round(coalesce(sm, 0), 4) AS meaning_sparse_score,
  CASE WHEN sa IS NOT NULL THEN CASE WHEN sn IS NULL AND sm IS NULL THEN 'dense' ELSE 'both' END WHEN sn IS NOT NULL AND sm IS NOT NULL THEN 'sparse_both' WHEN sn IS NOT NULL THEN 'name_sparse' ELSE 'meaning_sparse' END AS source,
  row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM j"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.hybrid_union(*[_path(spark, d, *p[1:]) for p in _PATHS])


@query(_UNION)
def e12_hybrid_union(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).withColumn("place", F.col("place").cast("bigint"))


@query(f"SELECT h.query_id, h.std_id, h.place, c.std_name, c.domain_id FROM ({_UNION}) h JOIN (SELECT * FROM ({DICTIONARY_SQL}) QUALIFY row_number() OVER (PARTITION BY std_id ORDER BY pos DESC) = 1) c USING (std_id)")
def e13_fetch(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import dictionary as dic

    return retrieve.fetch_candidates(_hybrid(spark, d), dic.dedupe(dictionary(spark, d))).select("query_id", "std_id", F.col("place").cast("bigint").alias("place"), "std_name", "domain_id")


@query(f"""WITH h AS (SELECT query_id // 2 AS row_index, query_id % 2 AS vp, 'n' || (query_id % 2) AS v, * FROM ({_UNION})),
 t AS (SELECT *, concat_ws('、', CASE WHEN dense_score > 0 THEN 'dense' END, CASE WHEN name_sparse_score > 0 THEN 'name_sparse' END, CASE WHEN meaning_sparse_score > 0 THEN 'meaning_sparse' END) AS ps FROM h)
 SELECT row_index, std_id, max(dense_score) AS dense_score, max(name_sparse_score) AS name_sparse_score, max(meaning_sparse_score) AS meaning_sparse_score, string_agg(v || ps || '召回', '；' ORDER BY vp) AS source,
  row_number() OVER (PARTITION BY row_index ORDER BY min(vp * 1000 + place), std_id) AS place FROM t GROUP BY row_index, std_id""")
def e14_multi_name(spark: SparkSession, d: str) -> DataFrame:
    h = _hybrid(spark, d).selectExpr("*", "query_id DIV 2 AS row_index", "query_id % 2 AS variant_pos", "'n' || CAST(query_id % 2 AS STRING) AS variant")
    return retrieve.merge_variants(h).withColumn("place", F.col("place").cast("bigint"))


_R = f"SELECT row_index, count(*) AS n, arg_max(is_ok, arrival) AS ok, arg_max(verdict, arrival) AS v FROM ({RESULTS_SQL}) GROUP BY row_index"


@query(f"SELECT s.row_index, CASE WHEN r.n = 1 AND r.ok THEN r.v ELSE s.field_name END AS name, CASE WHEN r.n = 1 THEN 'D-' || r.v ELSE '' END AS meaning, coalesce(r.n, 0) = 1 AS merges FROM ({SHEET_SQL}) s LEFT JOIN ({_R}) r USING (row_index)")
def b14_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Names and definitions by the derived results, and whether a merge would be asked for."""
    s = sheet(spark, d)
    r = scoring.reconcile(s.select("row_index"), results(spark, d))
    rows = maintain.apply_names(s, r.withColumnsRenamed({"verdict": "normalized_name", "is_ok": "changed"}))
    rows = maintain.apply_definitions(rows, r.select("row_index", "status", F.concat(F.lit("D-"), "verdict").alias("business_meaning"), F.lit("r").alias("reasoning")))
    asked = maintain.merge_requests(rows).select("row_index", F.lit(True).alias("merges"))
    return rows.join(asked, "row_index", "left").select("row_index", F.col("normalized_name").alias("name"), F.col("generated_meaning").alias("meaning"), F.coalesce("merges", F.lit(False)).alias("merges"))


@query()
def w2_standard_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The whole mapping of non-enum fields; candidates go to review, as no model answers."""
    return jobs.standard_mapping(sheet(spark, d), dictionary(spark, d), scoring.hashing_embedder(64), k=5)


@query()
def w3_enum_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The whole mapping of enum fields, the first candidate standard chosen by a plain rule."""
    def first(pdf):
        c = pdf["candidates"].map(lambda x: x[0])
        return pdf[["row_index"]].assign(selection="复用已有标准", selected_std_id=c.map(lambda x: x["std_id"]), selected_std_name=c.map(lambda x: x["std_name"]), reasoning="first")

    return jobs.enum_mapping(sheet(spark, d), dictionary(spark, d), scoring.hashing_embedder(64), first)


@query()
def w4_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """The whole maintenance job without a model: names stay, definitions are blank."""
    return jobs.standard_maintenance(sheet(spark, d), None, None, None)


def _before(cast: str) -> str:
    """The dictionary as it was before: some ids, classes and definitions were others."""
    return f"""SELECT pos, CASE WHEN pos % 7 = 0 THEN 'X' || std_id ELSE std_id END AS std_id, std_name, CASE WHEN pos % 11 = 3 AND std_type = '文本类' THEN '编码类' ELSE std_type END AS std_type,
      CASE WHEN pos % 13 = 5 THEN definition || ' before' ELSE definition END AS definition FROM {cast}"""


def _indexed(src: str) -> str:
    return f"""SELECT trim(std_id) AS std_id, std_type, trim(std_name) AS name_text, trim(definition) AS meaning_text FROM (SELECT * FROM ({src}) QUALIFY row_number() OVER (PARTITION BY std_id ORDER BY pos DESC) = 1)
      WHERE std_type <> '代码枚举类' AND trim(std_id) <> '' AND trim(std_name) <> '' AND trim(definition) <> ''"""


@query(f"""WITH a AS ({_indexed(f"SELECT * FROM ({_before(f'({DICTIONARY_SQL})')})")}), b AS ({_indexed(DICTIONARY_SQL)})
  SELECT b.*, CASE WHEN a.std_id IS NULL THEN 2 ELSE 1 END::BIGINT AS since FROM b LEFT JOIN a USING (std_id, std_type, name_text, meaning_text)""")
def a12_index_build(spark: SparkSession, d: str) -> DataFrame:
    """The index after two builds: of the dictionary as it was before, then as it is. since: the build that a record's content is of."""
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    now = dictionary(spark, d)
    was = spark.sql(_before("{rows}"), rows=now)
    embed = scoring.hashing_embedder(64)
    for version in (was, now):
        build.index_build(version, path, embed)
    return read_index(spark, path).select("std_id", "std_type", "name_text", "meaning_text", "since")
