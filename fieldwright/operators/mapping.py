"""Mapping of fields of other classes than enum: renames, domain filter, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import date_kind, domain_conflict
from ..functions.names import datetime_name, is_indicator, needs_datetime_rename, needs_flag_rename
from ..functions.vocab import FLAG, NEW_STANDARD, NON_ENUM, NUMBER
from ..sources.tables import kept
from .joins import join_one
from .scoring import DUPLICATE, DUPLICATE_REASON, MISSING, MISSING_REASON, OK


def non_enum_fields(sheet: DataFrame) -> DataFrame:
    return sheet.where(F.col("field_type").isin(NON_ENUM))


def flag_rename_requests(fields: DataFrame) -> DataFrame:
    return fields.where(needs_flag_rename("field_type", "enum_values")).select("row_index", "field_name", "business_meaning", "enum_values")


def datetime_rename_requests(fields: DataFrame) -> DataFrame:
    return fields.where(needs_datetime_rename("field_type", "field_name", "data_example")).select(
        "row_index", "field_name", "business_meaning", "data_example", date_kind("data_example").alias("detected_type")
    )


def rename_by_rule(fields: DataFrame) -> DataFrame:
    """Datetime fields renamed by the written rule: the suffix of the sample's kind in place of another one, or added."""
    new = F.when(needs_datetime_rename("field_type", "field_name", "data_example"), datetime_name("field_name", date_kind("data_example"))).otherwise(F.col("field_name"))
    return fields.withColumn("field_name", new)


def drop_indicators_by_rule(fields: DataFrame) -> DataFrame:
    """fields less the number fields that the written rule takes for statistics."""
    return fields.where(~((F.col("field_type") == NUMBER) & is_indicator("field_name", "business_caliber")))


def numeric_requests(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("field_type") == NUMBER).select("row_index", "field_name", "business_caliber")


def drop_indicators(fields: DataFrame, reconciled: DataFrame) -> DataFrame:
    """fields less those judged a statistic; rows whose result is missing or came twice stay. reconciled: row_index, status, is_indicator."""
    gone = reconciled.where((F.col("status") == OK) & F.col("is_indicator")).select("row_index")
    return fields.join(gone, "row_index", "left_anti")


def apply_renames(fields: DataFrame, reconciled: DataFrame) -> DataFrame:
    """fields with the scorer's name and definition where one result came and is not blank; else the original."""
    r = reconciled.where(F.col("status") == OK).select("row_index", F.col("rewritten_field_name").alias("__f"), F.col("rewritten_business_meaning").alias("__m"))
    full = lambda new, old: F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(old)
    rows = fields.join(r, "row_index", "left")
    new = {"field_name": full(F.col("__f"), F.col("field_name")), "business_meaning": full(F.col("__m"), F.col("business_meaning"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in fields.columns])


def filter_domains(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates kept, per row the detail text and eliminated ids). candidates: row_index, place, std_id, domain_type, field_type,
    data_example. Flags keep all, blank samples keep all, else candidates whose domain rules the sample out go."""
    free = (F.col("field_type") == FLAG) | (F.coalesce("data_example", F.lit("")) == "")
    rows = candidates.withColumn("__conflict", F.when(free, False).otherwise(domain_conflict("domain_type", "data_example")))
    d = F.coalesce("domain_type", F.lit(""))
    note = F.when(F.col("__conflict"), F.concat(F.lit("备选标准"), "std_id", F.lit("域类型"), d, F.lit("与数据示例'"), "data_example", F.lit("'冲突，已淘汰"))).otherwise(
        F.concat(F.lit("备选标准"), "std_id", F.lit("域类型"), d, F.lit("无冲突"))
    )
    per_row = rows.withColumn("__note", note).groupBy("row_index").agg(
        F.first("field_type").alias("__t"), F.first("data_example").alias("__s"),
        F.sort_array(F.collect_list(F.struct("place", "__note"))).alias("__d"), F.sort_array(F.collect_list(F.when(F.col("__conflict"), F.struct("place", "std_id")))).alias("__e"),
    )
    text = F.when(F.col("__t") == FLAG, "标志类字段，域类型恒定通过").when(F.coalesce("__s", F.lit("")) == "", "无数据示例，跳过域类型冲突检测").otherwise(
        F.array_join(F.transform("__d", lambda x: x["__note"]), "; ")
    )
    return rows.where(~F.col("__conflict")).drop("__conflict"), per_row.select("row_index", text.alias("domain_check_details"), F.transform("__e", lambda x: x["std_id"]).alias("eliminated"))


def selection_requests(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fields with a candidate left, and their (std_id, std_name, definition) in order."""
    item = F.struct("place", "std_id", "std_name", F.coalesce("definition", F.lit("")).alias("definition"))
    listed = candidates.groupBy("row_index").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["std_id"].alias("std_id"), x["std_name"].alias("std_name"), x["definition"].alias("definition"))).alias("candidates"))
    return fields.select("row_index", "field_name", "field_type", "business_meaning", "data_example").join(listed, "row_index")


def outcome(fetch_error: Column, n_candidates: Column, status: Column, selection: Column) -> Column:
    """The verdict of a row: a failed search and doubtful results go to review, no candidate left means a new standard."""
    return (
        F.when(F.coalesce(fetch_error, F.lit("")) != "", "候选检索失败，需人工复核").when(n_candidates == 0, NEW_STANDARD)
        .when(status == DUPLICATE, "LLM返回重复结果，需人工复核").when(status == MISSING, "LLM未返回该行结果，需人工复核").otherwise(selection)
    )


def outcome_reason(fetch_error: Column, n_candidates: Column, status: Column, reasoning: Column) -> Column:
    """Why: the search's fault, that nothing is left, what is doubtful, or the scorer's reasoning."""
    return (
        F.when(F.coalesce(fetch_error, F.lit("")) != "", fetch_error).when(n_candidates == 0, "无备选标准或备选标准经域类型筛选后全部淘汰，直接新增标准")
        .when(status == DUPLICATE, DUPLICATE_REASON).when(status == MISSING, MISSING_REASON).otherwise(reasoning)
    )


def candidate_text(candidates: Column) -> Column:
    """Candidates as one cell: id name, one a line."""
    return F.array_join(F.transform(candidates, lambda c: F.concat(c["std_id"], F.lit(" "), F.coalesce(c["std_name"], F.lit("")))), "\n")


def name_variants_by(fields: DataFrame, groups: DataFrame, name_col: str = "field_name", key: str = "row_index") -> DataFrame:
    """fields with variant and variant_pos: each name (0), then one variant for each other member of the group of its longest listed suffix, in the
    group's order. groups: group_id, pos, suffix, of any size; blank members and groups of one do not count, and of groups that share a
    suffix the one of the largest id has it. Names are looked up by their endings, not by the table's suffixes in turn; an ending, a group or a
    name that very many rows have is dealt over several tasks. Null and blank names have themselves only."""
    members = groups.select("group_id", "pos", F.trim("suffix").alias("suffix")).where("suffix != ''")
    sizes = members.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("pos", "suffix"))).alias("members")).where("size(members) > 1")
    sizes = kept(sizes)
    owner = kept(sizes.select("group_id", F.explode("members").alias("m")).groupBy(F.col("m.suffix").alias("suffix")).agg(F.max("group_id").alias("group_id")))
    longest = owner.agg(F.coalesce(F.max(F.length("suffix")), F.lit(0))).first()[0]
    names = kept(fields.groupBy(F.col(name_col).alias("__name")).agg(F.count(F.lit(1)).alias("n")).where("__name != ''"))
    ends = names.select("__name", F.explode(F.sequence(F.lit(1), F.least(F.length("__name"), F.lit(max(longest, 1))))).alias("len")).select("__name", "len", F.expr("right(__name, len)").alias("suffix"))
    n_ends = names.agg(F.coalesce(F.sum(F.least(F.length("__name"), F.lit(max(longest, 1)))), F.lit(0))).first()[0]
    counts = ends.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    met = join_one(ends, owner, "suffix", counts, n_ends, "__name").groupBy("__name").agg(F.max_by(F.struct("suffix", "group_id"), "len").alias("m"))
    met = kept(met.select("__name", "m.suffix", "m.group_id"))
    counts = met.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    grouped = join_one(met, sizes, "group_id", counts, met.count(), "__name")
    stem = F.expr("left(__name, length(__name) - length(suffix))")
    others = F.filter("members", lambda m: m["suffix"] != F.col("suffix"))
    listed = grouped.select("__name", F.transform(others, lambda m: F.concat(stem, m["suffix"])).alias("__others"))
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_one(fields.withColumn("__name", F.col(name_col)), listed, "__name", names.select("__name", "n"), total, key, "left")
    variants = F.concat(F.array(F.col(name_col)), F.coalesce("__others", F.array().cast("array<string>")))
    return joined.select(*[F.col(f"`{c}`") for c in fields.columns], F.posexplode(variants).alias("variant_pos", "variant"))
