"""The dictionary of standards: cleaning, lookups, domain match, enum items, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.text import strip_ws, utf8_cut
from ..functions.vocab import CODE, DATETIME, ENUM, FLAG, NON_ENUM
from ..sources.tables import first_per_key, last_per_key


def dedupe(dictionary: DataFrame) -> DataFrame:
    """The last row of each std_id by pos, with n_rows, how many there were."""
    n = F.count(F.lit(1)).over(Window.partitionBy("std_id"))
    return last_per_key(dictionary.withColumn("n_rows", n), ["std_id"], ["pos"])


def index_records(dictionary: DataFrame, most_bytes: int = 4000) -> DataFrame:
    """std_id, name_text, meaning_text and std_type of the non-enum standards that have all three; texts stripped, the definition cut."""
    cells = {c: strip_ws(c) for c in ("std_id", "std_name", "definition")}
    kept = dictionary.where(F.col("std_type").isin(NON_ENUM)).withColumns(cells).where(" and ".join(f"coalesce({c}, '') != ''" for c in cells))
    return kept.select("std_id", F.col("std_name").alias("name_text"), utf8_cut("definition", most_bytes).alias("meaning_text"), "std_type", "pos")


def first_n_per_class(records: DataFrame, n: int, by: str = "std_type", order: str = "pos") -> DataFrame:
    return records.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def by_ids(ids: DataFrame, dictionary: DataFrame, key: str = "std_id") -> tuple[DataFrame, DataFrame]:
    """(rows of the dictionary for the ids, order columns of ids kept; ids it lacks)."""
    return ids.join(dictionary, key), ids.join(dictionary.select(key), key, "left_anti")


def by_name(names: DataFrame, dictionary: DataFrame, name_col: str = "name", class_col: str | None = None) -> DataFrame:
    """Every standard of exactly that name, stripped on both sides, and of that class if one is given."""
    left = names.withColumn("__n", strip_ws(name_col))
    right = dictionary.withColumn("__m", strip_ws("std_name"))
    on = F.col("__n") == F.col("__m")
    if class_col:
        on = on & (F.col(class_col) == F.col("std_type"))
    return left.join(right, on).drop("__n", "__m")


def enum_items(dictionary: DataFrame) -> DataFrame:
    """item_id, item_name and pairs of every enum code: of its rows with a valid pair, the first by pos."""
    rows = dictionary.where(F.col("std_type") == ENUM).select(
        strip_ws("enum_id").alias("item_id"), strip_ws("std_name").alias("item_name"), enums.valid_pairs("rule").alias("pairs"), "pos"
    )
    kept = rows.where((F.coalesce("item_id", F.lit("")) != "") & (F.size("pairs") > 0))
    return first_per_key(kept, ["item_id"], ["pos"]).drop("pos")


def enum_value_records(items: DataFrame) -> DataFrame:
    """item_id, code, value: one row a pair with a value."""
    return items.select("item_id", F.explode("pairs").alias("p")).select("item_id", "p.code", "p.value").where("value != ''")


def distinct_values(records: DataFrame) -> DataFrame:
    """Each value text once: what has to be embedded."""
    return records.select("value").where(F.coalesce("value", F.lit("")) != "").distinct()


def backfill(item_ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per item_id asked for: item_name (of the first row that cites it), its standards in order and the pairs of the first row with a
    valid pair. Codes without a valid pair are dropped."""
    rows = dictionary.select(strip_ws("enum_id").alias("item_id"), "std_id", "std_name", "definition", "pos", enums.valid_pairs("rule").alias("pairs"))
    cited = rows.join(item_ids.select("item_id").distinct(), "item_id")
    found = cited.groupBy("item_id").agg(
        F.min_by("std_name", "pos").alias("item_name"),
        F.sort_array(F.collect_list(F.struct("pos", "std_id", "std_name", "definition"))).alias("standards"),
        F.min_by(F.when(F.size("pairs") > 0, F.col("pairs")), F.when(F.size("pairs") > 0, F.col("pos"))).alias("pairs"),
    )
    return found.where("pairs is not null")


def match_domains(dictionary: DataFrame, domains: DataFrame, name_col: str = "domain_hint") -> DataFrame:
    """dictionary with domain_name, domain_id, domain_type and enum_id for its datetime, flag and code rows.

    By (class, domain name) first; then 机构号 stands for the class's 通用编号, or the codes' one, and 时间戳 for the datetime domain
    with 时间戳 in its name (the one of the lowest id, so that runs agree); then a flag without a match takes 标志. domains: one row per
    class and name. The aliases are three rows at most and are sent along."""
    d = domains.select(F.col("std_type").alias("__t"), F.col("domain_name").alias("__n"), *[F.col(c).alias(f"__{c}") for c in ("domain_id", "domain_type", "enum_id")])
    d = first_per_key(d, ["__t", "__n"], ["__domain_id"])
    hint = F.col(name_col)
    rows = dictionary.join(d, (F.col("std_type") == F.col("__t")) & (hint == F.col("__n")), "left")
    general = F.min_by(F.struct("__n", "__domain_id", "__domain_type"), F.when(F.col("__n") == "通用编号", F.when(F.col("__t") == CODE, "1"))).alias("general")
    stamp = F.min_by(F.struct("__n", "__domain_id", "__domain_type"), F.when((F.col("__t") == DATETIME) & F.col("__n").contains("时间戳"), F.col("__domain_id"))).alias("stamp")
    flag = F.min_by(F.struct("__n", "__domain_id", "__domain_type"), F.when((F.col("__t") == FLAG) & (F.col("__n") == "标志"), "1")).alias("flag")
    own = d.where(F.col("__n") == "通用编号").select(F.col("__t").alias("__gt"), F.struct("__n", "__domain_id", "__domain_type").alias("own_general"))
    rows = rows.crossJoin(F.broadcast(d.agg(general, stamp, flag))).join(F.broadcast(own), F.col("std_type") == F.col("__gt"), "left")  # one row; one row a class
    match = (
        F.when(F.col("__domain_id").isNotNull(), F.struct("__n", "__domain_id", "__domain_type"))
        .when(hint == "机构号", F.coalesce("own_general", "general")).when(hint == "时间戳", F.col("stamp"))
    )
    match = F.coalesce(match, F.when(F.col("std_type") == FLAG, F.col("flag")))
    covered = F.col("std_type").isin(DATETIME, FLAG, CODE)
    keep = [c for c in dictionary.columns if c not in ("domain_name", "domain_id", "domain_type", "enum_id")]
    part = lambda c: F.when(covered, match[c])
    return rows.select(
        *keep, part("__n").alias("domain_name"), part("__domain_id").alias("domain_id"), part("__domain_type").alias("domain_type"),
        F.when(covered & F.col("__domain_id").isNotNull(), F.coalesce("__enum_id", F.lit(""))).when(covered & match.isNotNull(), "").alias("enum_id"),
    )


def apply_domain_ids(dictionary: DataFrame, proposed: DataFrame, domains: DataFrame, key: str = "std_id") -> DataFrame:
    """dictionary with the domain of the proposed id (key, domain_id), where that id is one of the row's class."""
    d = domains.select(F.col("std_type").alias("__t"), F.col("domain_id").alias("__d"), F.col("domain_name").alias("__n"), F.col("domain_type").alias("__y"))
    p = proposed.select(key, F.col("domain_id").alias("__p"))
    rows = dictionary.join(p, key, "left").join(d, (F.col("std_type") == F.col("__t")) & (F.col("__p") == F.col("__d")), "left")
    hit = F.col("__d").isNotNull()
    new = {"domain_id": "__d", "domain_name": "__n", "domain_type": "__y"}
    return rows.select(*[F.when(hit, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.when(hit, "").otherwise(F.col(c)).alias(c) if c == "enum_id" else F.col(c) for c in dictionary.columns])


def overlay(dictionary: DataFrame, corrections: DataFrame, key: str = "std_id", keep_caliber_if_absent: bool = False) -> DataFrame:
    """dictionary with corrections (key, new_rule, new_caliber) and n_edits. A non-empty new rule that differs replaces the rule; on every
    corrected row the caliber is replaced, by empty text too, unless keep_caliber_if_absent."""
    c = corrections.select(key, "new_rule", "new_caliber", F.lit(True).alias("__c"))
    rows = dictionary.join(c, key, "left")
    rule, caliber = F.coalesce("rule", F.lit("")), F.coalesce("caliber", F.lit(""))
    new_caliber = F.coalesce("new_caliber", F.lit(""))
    change_rule = F.coalesce(F.col("__c") & (F.coalesce("new_rule", F.lit("")) != "") & (F.col("new_rule") != rule), F.lit(False))
    change_caliber = F.coalesce(F.col("__c") & (new_caliber != caliber), F.lit(False))
    if keep_caliber_if_absent:
        change_caliber = change_caliber & (new_caliber != "")
    return rows.select(
        *[F.when(change_rule, F.col("new_rule")).otherwise(F.col(x)).alias(x) if x == "rule" else F.when(change_caliber, new_caliber).otherwise(F.col(x)).alias(x) if x == "caliber" else F.col(x) for x in dictionary.columns],
        (change_rule.cast("int") + change_caliber.cast("int")).alias("n_edits"),
    )


def prune(dictionary: DataFrame) -> DataFrame:
    """Without rows of other classes named ...标志 and without non-enum rows that have no domain."""
    return dictionary.where(~pruned())


def pruned() -> Column:
    named = (F.col("std_type") != FLAG) & F.coalesce(F.col("std_name"), F.lit("")).endswith("标志")
    return named | ((F.col("std_type") != ENUM) & (F.coalesce("domain_id", F.lit("")) == ""))


def new_enum_domains(entries: DataFrame, order: str = "pos") -> DataFrame:
    """entries with domain_name (the name without 代码), domain_id CDE00001..., enum_id ENM00001... in order and domain_type by the longest
    code of the rule."""
    from .scoring import number_rows

    n = number_rows(entries, order, "__n").withColumn("__z", F.lpad(F.col("__n").cast("string"), 5, "0"))
    number = F.when(F.col("__n") > 99999, F.col("__n").cast("string")).otherwise(F.col("__z"))
    name = F.coalesce("std_name", F.lit(""))
    keep = [c for c in entries.columns if c not in ("domain_name", "domain_id", "domain_type", "enum_id")]
    return n.select(
        *keep, F.regexp_replace(name, "代码$", "").alias("domain_name"), F.concat(F.lit("CDE"), number).alias("domain_id"),
        enums.enum_domain_type("rule").alias("domain_type"), F.concat(F.lit("ENM"), number).alias("enum_id"),
    )


def all_domains(old: DataFrame, new: DataFrame) -> DataFrame:
    cols = ["domain_id", "domain_name", "domain_type", "std_type", "enum_id"]
    return old.select(*cols).unionByName(new.select(*cols))
