"""Dictionary entries for new standards: names, definitions, merged definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .scoring import FAILED, OK


def name_requests(entries: DataFrame) -> DataFrame:
    return entries.select("row_index", "field_name", "field_type", "enum_values", "business_meaning")


def apply_names(entries: DataFrame, reconciled: DataFrame) -> DataFrame:
    """entries with normalized_name: the scorer's where one result came and changed the name, else the original."""
    r = reconciled.select("row_index", "status", F.col("normalized_name").alias("__n"), F.col("changed").alias("__c"))
    new = F.when((F.col("status") == OK) & F.col("__c") & (F.coalesce("__n", F.lit("")) != ""), F.col("__n")).otherwise(F.col("field_name"))
    return entries.join(r, "row_index", "left").withColumn("normalized_name", new).drop("status", "__n", "__c")


def definition_requests(entries: DataFrame) -> DataFrame:
    return entries.select("row_index", F.col("normalized_name").alias("field_name"), "field_type", "is_enum", "enum_values")


def apply_definitions(entries: DataFrame, reconciled: DataFrame) -> DataFrame:
    """entries with generated_meaning and generated_reason: blank with the reason where no single result came."""
    r, why = _judged(reconciled, "business_meaning")
    return entries.join(r, "row_index", "left").withColumn("generated_meaning", F.coalesce("__m", F.lit(""))).withColumn("generated_reason", why).drop("__s", "__m", "__e")


def _judged(reconciled: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """(row_index, __s, __m the text where one came, __e the call's fault; the reason why there is none)."""
    fault = F.col("call_failed") if "call_failed" in reconciled.columns else F.lit(None).cast("string")
    text = F.when(F.col("status") == OK, strip_ws(F.coalesce(column, F.lit("")))).otherwise("")
    r = reconciled.select("row_index", F.col("status").alias("__s"), text.alias("__m"), fault.alias("__e"))
    why = (
        F.when(F.coalesce("__m", F.lit("")) != "", "").when(F.col("__s") == OK, "LLM 返回空定义，需人工复核")
        .when(F.col("__s") == FAILED, F.concat(F.lit("LLM 调用失败: "), "__e")).otherwise("LLM 调用成功但该行结果缺失/重复，需人工复核")
    )
    return r, why


def apply_merges(entries: DataFrame, reconciled: DataFrame) -> DataFrame:
    """entries with merged_meaning and definition_reason: rows whose definition was not generated keep that reason."""
    r, why = _judged(reconciled, "merged_meaning")
    reason = F.when(F.col("generated_meaning") == "", F.col("generated_reason")).otherwise(why)
    return entries.join(r, "row_index", "left").withColumn("merged_meaning", F.coalesce("__m", F.lit(""))).withColumn("definition_reason", reason).drop("__s", "__m", "__e")


def merge_requests(entries: DataFrame) -> DataFrame:
    """Only entries whose definition was generated."""
    return entries.where(F.col("generated_meaning") != "").select("row_index", F.col("normalized_name").alias("field_name"), "business_meaning", "generated_meaning")


def maintenance_table(entries: DataFrame) -> DataFrame:
    """The output columns; the id stays blank until a standard is issued. definition_reason says why a definition is blank."""
    return entries.select(
        "row_index", F.lit("").alias("std_id"), F.col("normalized_name").alias("field_name"), "field_type", "is_enum", "enum_values",
        F.coalesce("merged_meaning", F.lit("")).alias("business_meaning"), "definition_reason",
    )
