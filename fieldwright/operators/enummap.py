"""Mapping of enum fields: similar values, greedy one-to-one scores, recall, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.vocab import ENUM, MODIFY, MODIFY_REUSE, NEW_ALL, NEW_STANDARD, REUSE, REUSE_REUSE
from .retrieve import topk_cosine
from .scoring import CALL_FAILED, CALL_FAILED_REASON, DUPLICATE, DUPLICATE_REASON, FAILED, MISSING, MISSING_REASON


def enum_fields(sheet: DataFrame) -> DataFrame:
    """Enum rows with at least one valid pair, and the pairs."""
    return sheet.where(F.col("field_type") == ENUM).withColumn("pairs", enums.valid_pairs("enum_values")).where(F.size("pairs") > 0)


def field_pairs(fields: DataFrame) -> DataFrame:
    """row_index, pos, code, value: one row a pair, in order."""
    return fields.select("row_index", F.posexplode("pairs").alias("pos", "p")).select("row_index", "pos", "p.code", "p.value")


def similar_values(
    texts: DataFrame, dictionary_texts: DataFrame, records: DataFrame, top: int = 300, least: float = 0.8
) -> DataFrame:
    """value, item_id, value_text, score, hit_pos: for each field text the best dictionary records of cosine at least least.

    texts: value, vector; dictionary_texts: value_text, vector, each text once; records: item_id, value_text. Distinct texts are compared; the hits are
    fanned out to records by an equi-join and only then cut to the best top."""
    near = topk_cosine(texts, dictionary_texts, top, "value", "value_text", least=least)
    fanned = near.join(records.select("item_id", "value_text").distinct(), "value_text")
    w = Window.partitionBy("value").orderBy(F.col("score").desc(), "item_id", "value_text")
    return fanned.withColumn("hit_pos", F.row_number().over(w)).where(F.col("hit_pos") <= top).select("value", "item_id", "value_text", "score", "hit_pos")


def greedy_scores(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """row_index, item_id, score, matched: each code's greedy one-to-one score.

    pairs: row_index, pos, code, value; hits: value, item_id, value_text, score, hit_pos. In the order of the field's pairs, a pair takes the best value
    of the code that no pair before has taken (ties: the earlier hit), which counts 1. Codes are independent of each other, so each group (row, code) is
    folded on its own; it holds at most pairs x hits."""
    rows = pairs.join(hits, "value")
    step = F.struct("pos", F.negate("score").alias("worse"), "hit_pos", "value_text", "code", "value")
    grouped = rows.groupBy("row_index", "item_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    kind = "struct<used:array<string>,done:array<int>,matched:array<struct<code:string,value:string>>>"

    def fold(state: Column, x: Column) -> Column:
        free = ~F.array_contains(state["done"], x["pos"]) & ~F.array_contains(state["used"], x["value_text"])
        return F.when(
            free,
            F.struct(
                F.array_append(state["used"], x["value_text"]).alias("used"), F.array_append(state["done"], x["pos"]).alias("done"),
                F.array_append(state["matched"], F.struct(x["code"].alias("code"), x["value"].alias("value"))).alias("matched"),
            ).cast(kind),
        ).otherwise(state)

    start = F.from_json(F.lit('{"used":[],"done":[],"matched":[]}'), kind)
    out = grouped.withColumn("end", F.aggregate("steps", start, fold))
    return out.select("row_index", "item_id", F.size("end.matched").alias("score"), F.col("end.matched").alias("matched"))


def unmatched_values(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    return pairs.join(hits.select("value").distinct(), "value", "left_anti").select("row_index", "pos", "value")


def recall(scores: DataFrame, sizes: DataFrame, top: int = 5) -> DataFrame:
    """The codes kept per row, with operation and rank. sizes: row_index, n (its number of pairs). A code needs n - floor(n / 3)."""
    kept = scores.join(sizes, "row_index").where((F.col("n") > 0) & (F.col("score") >= F.col("n") - F.floor(F.col("n") / 3)))
    w = Window.partitionBy("row_index").orderBy(F.col("score").desc(), "item_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("operation", F.when(F.col("score") == F.col("n"), REUSE).otherwise(MODIFY))


def details(pairs: Column, matched: Column) -> Column:
    """struct(matched_values, missing_values) as code-value, in the field's order; only value texts are compared."""
    seen = F.transform(matched, lambda m: m["value"])
    text = lambda xs: F.transform(xs, lambda p: F.concat(p["code"], F.lit("-"), p["value"]))
    return F.struct(
        text(F.filter(pairs, lambda p: F.array_contains(seen, p["value"]))).alias("matched_values"),
        text(F.filter(pairs, lambda p: ~F.array_contains(seen, p["value"]))).alias("missing_values"),
    )


def suggestion(item_id: Column, missing: Column) -> Column:
    return F.when(F.size(missing) > 0, F.concat(F.lit("向枚举代码"), item_id, F.lit("补充: "), F.array_join(missing, ", "))).otherwise("")


def locate(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """chosen (row_index, selected_std_id, ...) with the first candidate by rank whose standards hold the chosen one: item_id, operation,
    missing_values; null if none does. candidates: row_index, rank, item_id, operation, missing_values, std_id (one row a standard)."""
    first = candidates.groupBy("row_index", F.col("std_id").alias("selected_std_id")).agg(
        F.min_by(F.struct("item_id", "operation", "missing_values"), "rank").alias("__c")
    )
    joined = chosen.join(first, ["row_index", "selected_std_id"], "left")
    return joined.select(*chosen.columns, "__c.item_id", "__c.operation", "__c.missing_values")


def outcome(rows: DataFrame) -> DataFrame:
    """rows with mapping_result, llm_reason and enum_code_suggestion. They carry n_candidates, fetch_error, status, selection, selected_std_id,
    reasoning and, from locate, item_id, operation and missing_values."""
    f, c = F.col, F.coalesce
    located = f("item_id").isNotNull()
    failed = f("call_failed") if "call_failed" in rows.columns else F.lit(None).cast("string")
    result = (
        F.when(c("fetch_error", F.lit("")) != "", "候选检索失败，需人工复核").when(f("n_candidates") == 0, NEW_ALL).when(f("status") == FAILED, CALL_FAILED)
        .when(f("status") == DUPLICATE, "LLM返回重复结果，需人工复核").when(f("status") == MISSING, "LLM未返回该行结果，需人工复核").when(f("selection") == NEW_STANDARD, NEW_ALL)
        .when(~located, "LLM返回异常结果，需人工复核").when(f("operation") == REUSE, REUSE_REUSE).otherwise(MODIFY_REUSE)
    )
    reason = (
        F.when(c("fetch_error", F.lit("")) != "", f("fetch_error")).when(f("n_candidates") == 0, "枚举值召回无候选枚举代码，判定新增枚举代码并新增标准")
        .when(f("status") == FAILED, F.concat(F.lit(CALL_FAILED_REASON), failed)).when(f("status") == DUPLICATE, DUPLICATE_REASON).when(f("status") == MISSING, MISSING_REASON)
        .when((f("selection") != NEW_STANDARD) & ~located, F.concat(F.lit("LLM 选中的标准编号 "), f("selected_std_id"), F.lit(" 不在召回候选内，需人工复核")))
        .otherwise(f("reasoning"))
    )
    out = rows.withColumn("mapping_result", result).withColumn("llm_reason", reason)
    return out.withColumn("enum_code_suggestion", F.when(f("mapping_result") == MODIFY_REUSE, suggestion(f("item_id"), f("missing_values"))).otherwise(""))


def candidate_text(candidates: Column) -> Column:
    """Enum candidates (item_id, item_name, score, operation, standards) as one cell."""
    def one(c: Column) -> Column:
        ids = F.array_join(F.transform(c["standards"], lambda s: s["std_id"]), "+")
        return F.concat(c["item_id"], F.lit(" "), F.coalesce(c["item_name"], F.lit("")), F.lit("(得分"), c["score"].cast("string"), F.lit("/n,"), c["operation"], F.lit(",标准"), ids, F.lit(")"))

    return F.array_join(F.transform(candidates, one), "; ")


def selection_request(candidates: DataFrame) -> DataFrame:
    """row_index, candidates: the standards of its enum codes in order, each once. candidates: row_index, rank, std_pos, std_id, std_name, definition."""
    w = Window.partitionBy("row_index", "std_id").orderBy("rank", "std_pos")
    once = candidates.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    item = F.struct("rank", "std_pos", "std_id", "std_name", F.coalesce("definition", F.lit("")).alias("definition"))
    return once.groupBy("row_index").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["std_id"].alias("std_id"), x["std_name"].alias("std_name"), x["definition"].alias("definition"))).alias("candidates"))
