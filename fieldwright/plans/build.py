"""The builds: the index of standards, and the dictionary itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.names import enum_names
from ..functions.vocab import ENUM
from ..operators import dictionary as dic
from ..operators import retrieve
from ..operators.joins import join_one
from ..operators.scoring import embed_texts
from ..sources.index import Folder, current, read_index, write_version
from ..sources.tables import export_dictionary, kept

TEXTS = {"name_text": "name_vector", "meaning_text": "meaning_vector"}
INDEX = ["std_id", *TEXTS, *TEXTS.values(), "content", "since", "std_type"]


def with_vectors(rows: DataFrame, vectors: DataFrame, text_col: str, out: str) -> DataFrame:
    """rows with the vector (text, vector) of a text column; a text that very many rows share is no task's alone."""
    counts = rows.groupBy(text_col).agg(F.count(F.lit(1)).alias("n"))
    one = vectors.select(F.col("text").alias(text_col), F.col("vector").alias(out))
    return join_one(rows, one, text_col, counts, rows.count(), "std_id", "left")


def index_build(dictionary: DataFrame, path: str, embed: Callable, most_bytes: int = 4000, limit: int | None = None) -> DataFrame:
    """Brings the index at path up to the dictionary, and returns std_type, state and n: how many of its records were added, changed (in class
    or text), kept or removed.

    Records are told apart by a hash of their class and texts. Only texts that no record of the index has are embedded, each once. Only
    classes in which something changed are written, as a new version that readers see at once (sources.index); if nothing changed there is
    none. since is the version in which a record got its present content. limit: records a class, the first by pos."""
    spark = dictionary.sparkSession
    records = dic.index_records(dic.dedupe(dictionary), most_bytes)
    if limit is not None:
        records = dic.first_n_per_class(records, limit)
    fresh = kept(records.select("std_id", "std_type", *TEXTS, F.sha2(F.to_json(F.struct("std_type", *TEXTS)), 256).alias("content")))
    old = read_index(spark, path)
    if old is None:
        known = spark.createDataFrame([], "text string, vector array<float>")
        old_keys = spark.createDataFrame([], "std_id string, old_content string, old_type string, old_since bigint")
    else:
        known = old.select(F.col("name_text").alias("text"), F.col("name_vector").alias("vector")).union(old.select("meaning_text", "meaning_vector")).dropDuplicates(["text"])
        old_keys = old.select("std_id", F.col("content").alias("old_content"), F.col("std_type").alias("old_type"), F.col("since").alias("old_since"))

    same = F.col("content") == F.col("old_content")
    state = F.when(F.col("old_content").isNull(), "added").when(F.col("content").isNull(), "removed").when(same, "kept").otherwise("changed")
    both = kept(fresh.select("std_id", "std_type", "content").join(old_keys, "std_id", "full_outer").withColumn("state", state))
    moved = both.where("state != 'kept'")
    touched = sorted({r.c for r in moved.select(F.explode(F.array("std_type", "old_type")).alias("c")).where("c is not null").distinct().collect()})  # classes are few
    counts = kept(both.groupBy(F.coalesce("std_type", "old_type").alias("std_type"), "state").agg(F.count(F.lit(1)).alias("n")))
    if not touched:
        return counts

    texts = fresh.select(F.col("name_text").alias("text")).union(fresh.select("meaning_text")).distinct()
    made = kept(texts.join(known.select("text"), "text", "left_anti").withColumn("vector", embed_texts("text", embed)))
    vectors = known.unionByName(made)
    rows = fresh.where(F.col("std_type").isin(touched))
    for text, vector in TEXTS.items():
        rows = with_vectors(rows, vectors, text, vector)
    number = (current(spark, path) or {"version": 0})["version"] + 1
    since = both.select("std_id", F.when(F.col("state") == "kept", F.col("old_since")).otherwise(F.lit(number)).cast("bigint").alias("since"))
    write_version(kept(rows.join(since, "std_id").select(*INDEX)), path, touched)
    return counts


def self_check(index: DataFrame) -> DataFrame:
    """std_type, std_id, found_id, ok: whether the first record of each class is found by its own name (or one of the same name is)."""
    first = index.groupBy("std_type").agg(F.min_by(F.struct("std_id", "name_vector", "name_text"), "std_id").alias("r")).select("std_type", F.col("r.std_id").alias("query_id"), "r.name_vector", "r.name_text")
    hits = retrieve.topk_cosine(first, index, 1, "query_id", "std_id", "name_vector", by="std_type").select("query_id", F.col("std_id").alias("found_id"))
    named = hits.join(index.select(F.col("std_id").alias("found_id"), F.col("name_text").alias("found_text")), "found_id")
    out = first.join(named, "query_id", "left")
    return out.select("std_type", F.col("query_id").alias("std_id"), "found_id", F.coalesce(F.col("found_text") == F.col("name_text"), F.lit(False)).alias("ok"))


def dictionary_build(
    dictionary: DataFrame, domains: DataFrame, proposed: DataFrame | None = None, rules: DataFrame | None = None, corrections: list[DataFrame] = (),
    path: str | None = None, state: str | None = None, resume: bool = False,
) -> dict[str, DataFrame]:
    """standards, domains and details (enum_id, code, value) of a dictionary built in phases; with path, also written there as the four tables of an
    export.

    nonenum: domains of the other classes by name, then those of proposed ids (std_id, domain_id) that fit the class. codeenum: names of enum
    standards put right, rules tidied or replaced (rules: std_id, rule), a new domain and enum id for each. pruned: rows without use go.
    corrected: each of corrections (std_id, new_rule, new_caliber) is laid over in turn; n_edits adds up.

    With state, a folder, each phase is kept there; with resume, phases that are there are read, so that a run goes on where the last one
    ended. Otherwise what is there is replaced. Without it phases are kept in the shared folder."""
    spark = dictionary.sparkSession
    cols = [c for c in dictionary.columns if c != "domain_hint"]

    def phase(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not state:
            return kept(make())
        at = f"{state.rstrip('/')}/{name}"
        if not (resume and "_SUCCESS" in Folder(spark, at).names()):
            make().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)

    def nonenum() -> DataFrame:
        rows = dic.match_domains(dictionary.where(F.col("std_type") != ENUM), domains).select(cols)
        return rows if proposed is None else dic.apply_domain_ids(rows, proposed, domains)

    def codeenum() -> DataFrame:
        n = enum_names(F.col("std_name"), F.col("std_name_en"), F.col("phys_name"))
        rows = dictionary.where(F.col("std_type") == ENUM).select(cols)
        rows = rows.withColumns({"std_name": n["name"], "std_name_en": n["english"], "phys_name": n["physical"]})
        told = spark.createDataFrame([], "std_id string, __rule string") if rules is None else rules.select("std_id", F.col("rule").alias("__rule"))
        rule = F.coalesce(F.when(F.col("__rule") != "", F.col("__rule")), enums.tidy_rule("rule"), F.col("rule"))
        rows = rows.join(told, "std_id", "left").withColumn("rule", rule).drop("__rule")
        return dic.new_enum_domains(rows).select(cols)

    def corrected() -> DataFrame:
        rows = pruned.withColumn("n_edits", F.lit(0))
        for c in corrections:
            rows = dic.overlay(rows.withColumnRenamed("n_edits", "__edits"), c).withColumn("n_edits", F.col("n_edits") + F.col("__edits")).drop("__edits")
        return rows

    other, coded = phase("nonenum", nonenum), phase("codeenum", codeenum)
    pruned = phase("pruned", lambda: dic.prune(other.unionByName(coded)))
    standards = phase("corrected", corrected)
    out = {
        "standards": standards, "domains": dic.all_domains(domains, coded),
        "details": standards.where((F.col("std_type") == ENUM) & (F.coalesce("enum_id", F.lit("")) != "")).select("enum_id", F.explode(enums.strict_detail("rule")).alias("p")).select("enum_id", "p.code", "p.value"),
    }
    if path:
        export_dictionary(standards.drop("n_edits"), out["domains"], out["details"], path)
    return out
