"""Summaries of runs, token usage, and comparison with expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws, token_estimate
from ..functions.vocab import FAILED, MODIFY_REUSE, NEW_ALL, NEW_STANDARD, PASSED, REUSE_REUSE


def summary(df: DataFrame, verdict: str, labels: list[str], by: list[str] | None = None, other: str = "other") -> DataFrame:
    """One row (a group): rows, the number of each label as n_0, n_1, ..., and of all other verdicts."""
    cols = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(verdict) == x).alias(f"n_{i}") for i, x in enumerate(labels)], F.count_if(~F.coalesce(F.col(verdict).isin(labels), F.lit(False))).alias(f"n_{other}")]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def quality_summary(checked: DataFrame) -> DataFrame:
    return summary(checked, "check_result", [PASSED, FAILED])


def mapping_summary(mapped: DataFrame) -> DataFrame:
    """Reused (n_0), new (n_1), failed searches (n_2) and other verdicts of the rows that were mapped."""
    return summary(mapped.where("mapping_result != ''"), "mapping_result", ["复用已有标准", NEW_STANDARD, "候选检索失败，需人工复核"])


def enum_summary(mapped: DataFrame) -> DataFrame:
    return summary(mapped.where("mapping_result != ''"), "mapping_result", [NEW_ALL, REUSE_REUSE, MODIFY_REUSE])


def maintenance_summary(entries: DataFrame) -> DataFrame:
    """n_rows, n_renamed and n_merged. entries: field_name, normalized_name, generated_meaning, merged_meaning."""
    differs = lambda a, b: F.count_if(F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit("")))
    return entries.agg(F.count(F.lit(1)).alias("n_rows"), differs("normalized_name", "field_name").alias("n_renamed"), differs("merged_meaning", "generated_meaning").alias("n_merged"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Tokens by (module, label) and in total (both null). calls: module, label, prompt, answer, prompt_tokens, answer_tokens; a group whose recorded
    tokens are all 0 is estimated from its texts."""
    got = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("answer_tokens", F.lit(0))
    est = token_estimate(F.coalesce("prompt", F.lit(""))) + token_estimate(F.coalesce("answer", F.lit("")))
    per = calls.groupBy("module", "label").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(got).alias("__g"), F.sum(est).alias("__e"))
    per = per.withColumn("tokens", F.when(F.col("__g") == 0, F.col("__e")).otherwise(F.col("__g")).cast("bigint"))
    return per.groupingSets([("module", "label"), ()], "module", "label").agg(F.sum("n_calls").alias("n_calls"), F.sum("tokens").alias("tokens"))


def call_usage(calls: DataFrame) -> DataFrame:
    """Usage that jobs have noted (scoring.Calls.usage), by (module, label) and in total (both null): n_calls, cached_input, uncached_input,
    output and tokens."""
    sums = [F.sum(c).alias(c) for c in ("cached_input", "uncached_input", "output")]
    out = calls.groupingSets([("module", "label"), ()], "module", "label").agg(F.count(F.lit(1)).alias("n_calls"), *sums)
    return out.withColumn("tokens", F.col("cached_input") + F.col("uncached_input") + F.col("output"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def comparable(c: Column) -> Column:
    """Null as empty, whole numbers without a decimal point, stripped."""
    s = strip_ws(F.coalesce(c.cast("string"), F.lit("")))
    return F.regexp_replace(s, r"^(-?[0-9]+)\.0+$", "$1")


def compare(actual: DataFrame, expected: DataFrame, cols: list[str], key: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """(differences: key, column, actual, expected on the rows that both have; one row with both row counts and the columns each lacks)."""
    shared = [c for c in cols if c in actual.columns and c in expected.columns]
    a = actual.select(key, *[comparable(F.col(c)).alias(f"a_{c}") for c in shared])
    e = expected.select(key, *[comparable(F.col(c)).alias(f"e_{c}") for c in shared])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("actual"), F.col(f"e_{c}").alias("expected")) for c in shared]))
    found = a.join(e, key).select(key, cells.alias("x")).select(key, "x.*").where("actual != expected")
    lacks = lambda df: F.array(*[F.lit(c) for c in cols if c not in df.columns]).cast("array<string>")
    counts = actual.agg(F.count(F.lit(1)).alias("n_actual")).crossJoin(expected.agg(F.count(F.lit(1)).alias("n_expected")))  # one row each
    return found, counts.withColumn("missing_actual", lacks(actual)).withColumn("missing_expected", lacks(expected))


def shorten(c: Column, most: int = 60) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def difference_sample(found: DataFrame, key: str = "row_index", rows: int = 20) -> DataFrame:
    """The first differences by row and column, long values cut: a report, so limited by purpose."""
    return found.orderBy(key, "column").limit(rows).select(key, "column", shorten(F.col("actual")).alias("actual"), shorten(F.col("expected")).alias("expected"))
