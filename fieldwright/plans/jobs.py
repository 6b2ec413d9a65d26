"""The jobs from end to end: each takes DataFrames and the user's scorers and returns the sheet with its result columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.vocab import KEY_ITEMS
from ..operators import dictionary as dic
from ..operators import enummap, maintain, mapping, quality, retrieve
from ..operators.joins import join_one
from ..operators.scoring import FAILED, OK, RESULTS, Calls, embed_distinct, reconcile, run_scorer
from ..sources.tables import kept, overwrite_enum, write_back

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def _ask(
    requests: DataFrame, scorer: Scorer | None, kind: str, size: int, checkpoint: Callable[[DataFrame], DataFrame], on_error: str = "missing", by: str | None = None, calls: Calls | None = None,
    shared: DataFrame | None = None,
) -> DataFrame:
    """Request rows with results and status. Results are kept before they are joined, so a retry does not ask again. Without a scorer every
    row is missing. on_error: what a call that raises means for its rows (see run_scorer). calls: how to call; a log gets a folder for each
    module and kind, and the usage is noted there. shared: see run_scorer."""
    if scorer is None:
        results = requests.sparkSession.createDataFrame([], f"row_index bigint, {RESULTS[kind]}, call_failed string, arrival bigint")
    else:
        calls = calls or Calls()
        own = replace(calls, log=f"{calls.log.rstrip('/')}/{calls.module}-{kind}") if calls.log else calls
        got = checkpoint(run_scorer(requests, scorer, RESULTS[kind], size, by=by, on_error=on_error, calls=own, usage=True, shared=shared).withColumn("arrival", F.monotonically_increasing_id()))
        calls.noted.append(got.where("usage is not null").select(F.lit(calls.module).alias("module"), F.lit(kind).alias("label"), "usage.*"))
        results = got.where("usage is null").drop("usage")
    return reconcile(requests.select("row_index"), results)


def rule_enum_results(rows: DataFrame) -> DataFrame:
    """What the enum scorer would return, by the written rules alone (one result a row)."""
    n = enums.normalised("enum_values")
    return quality.enum_requests(rows).select("row_index", F.lit("ok").alias("status"), n["has_codes"].alias("has_codes"), n["normalized"].alias("normalized"))


def quality_check(
    sheet: DataFrame, meaning: Scorer | None = None, class_check: Scorer | None = None, antonym: Scorer | None = None, sample: Scorer | None = None,
    enum_normalise: Scorer | None = None, checkpoint: Callable[[DataFrame], DataFrame] = kept, ask_meaning: bool = True, key_items: list[tuple] = KEY_ITEMS,
    calls: Calls | None = None,
) -> DataFrame:
    """sheet with check_result, fail_reason, soft_check_result, its enum column normalised. Without an enum scorer lists are normalised by the written
    rules; with ask_meaning off, the meaning check is left out altogether. A call that fails leaves its rows without a meaning or enum result
    (for review); of the soft checks it says that they were not executed. key_items: the rules of the key-item notes."""
    calls = calls and calls.of("quality_check")
    rows = quality.check_rules(sheet)
    if enum_normalise is None:
        e = rule_enum_results(rows)
    else:
        e = _ask(quality.enum_requests(rows), enum_normalise, "enum_normalise", 10, checkpoint, calls=calls).select("row_index", "status", "has_codes", "normalized")
    rows = quality.add_consistency(rows.join(e.withColumnRenamed("status", "enum_status"), "row_index", "left"))
    m = None
    if ask_meaning:
        m = _ask(quality.meaning_requests(rows), meaning, "meaning", 10, checkpoint, calls=calls).select(
            "row_index", F.col("status").alias("meaning_status"), F.col("is_meaningful").alias("scored_meaningful"), F.col("reasoning").alias("scored_reason")
        )
        m = m.withColumn("meaning_status", F.when(F.col("meaning_status") != "missing", F.col("meaning_status")))
        rows = rows.join(m, "row_index", "left")
    else:
        rows = rows.withColumn("meaning_status", F.lit("ok")).withColumn("scored_meaningful", F.lit(True)).withColumn("scored_reason", F.lit(""))
    done = quality.combine(rows)
    asked = quality.soft_requests(done)
    for kind, scorer, names in (
        ("class_check", class_check, {"status": "class_status", "is_correct": "is_correct", "correct_type": "correct_type", "reasoning": "class_reason", "failed": "class_failed"}),
        ("antonym", antonym, {"status": "antonym_status", "is_antonym": "is_antonym", "failed": "antonym_failed"}),
        ("sample", sample, {"status": "sample_status", "is_valid": "is_valid", "reasoning": "sample_reason", "failed": "sample_failed"}),
    ):
        if scorer is None:  # not asked: no note
            blank = {"status": "string", "is_correct": "boolean", "correct_type": "string", "reasoning": "string", "is_antonym": "boolean", "is_valid": "boolean", "failed": "boolean"}
            done = done.select("*", *[F.lit(None).cast(blank[a]).alias(b) for a, b in names.items()])
        else:
            r = _ask(asked[kind], scorer, kind, 10, checkpoint, "mark", calls=calls).withColumn("failed", F.col("status") == FAILED).select("row_index", *[F.col(a).alias(b) for a, b in names.items()])
            done = done.join(r, "row_index", "left")
    done = quality.soft_notes(done, key_items)
    results = done.select("row_index", "check_result", "fail_reason", "soft_check_result", overwrite_enum(F.col("enum_values"), F.col("normalized_enum")).alias("__enum"))
    out = write_back(sheet, results)
    return out.withColumn("enum_values", F.when(F.col("__enum") != "", F.col("__enum")).otherwise(F.col("enum_values"))).drop("__enum")


def standard_mapping(
    sheet: DataFrame, dictionary: DataFrame, embed: Callable, select: Scorer | None = None, k: int = 10, checkpoint: Callable[[DataFrame], DataFrame] = kept,
    numeric: Scorer | None = None, datetime_rename: Scorer | None = None, flag_rename: Scorer | None = None, fetch_errors: DataFrame | None = None,
    index: DataFrame | None = None, calls: Calls | None = None, synonyms: DataFrame | None = None,
) -> DataFrame:
    """The non-enum fields mapped onto the dictionary: mapping_result, selected_std_id, selected_std_name, llm_reason, candidates and
    domain_check_details.

    Number fields that are statistics go first, then datetime and flag fields are renamed: by the scorers, or by the written rules where none
    is given (flags then keep their names). A failed call keeps rows and names; one of the selection lets the job fail. Each distinct name
    and definition of a class is searched once. Without a selection scorer rows with candidates are for review. fetch_errors:
    row_index and fetch_error of rows whose candidates could not be had elsewhere. index: a built index (plans.build), whose vectors are then taken
    instead of embedding the dictionary again. synonyms: groups of suffixes (mapping.name_variants_by) in place of the listed ones."""
    calls = calls and calls.of("standard_mapping")
    fields = mapping.non_enum_fields(sheet)
    if "business_caliber" not in fields.columns:
        fields = fields.withColumn("business_caliber", F.lit(""))
    if numeric is None:
        fields = mapping.drop_indicators_by_rule(fields)
    else:
        fields = mapping.drop_indicators(fields, _ask(mapping.numeric_requests(fields), numeric, "numeric", 5, checkpoint, calls=calls))
    if datetime_rename is None:
        fields = mapping.rename_by_rule(fields)
    else:
        fields = mapping.apply_renames(fields, _ask(mapping.datetime_rename_requests(fields), datetime_rename, "rename", 5, checkpoint, calls=calls))
    if flag_rename is not None:
        fields = mapping.apply_renames(fields, _ask(mapping.flag_rename_requests(fields), flag_rename, "rename", 5, checkpoint, calls=calls))
    fields = checkpoint(fields)
    standards = checkpoint(dic.dedupe(dictionary))
    if index is None:
        index = dic.index_records(standards)
        vectors = checkpoint(embed_distinct(embed_distinct(index, "name_text", embed, "name_vector"), "meaning_text", embed, "meaning_vector"))
    else:
        vectors = index
    asked = ["field_type", "variant", "business_meaning"]
    named = retrieve.explode_names(fields) if synonyms is None else mapping.name_variants_by(fields, synonyms)
    distinct = checkpoint(named.select(*asked).distinct().withColumn("query_id", F.monotonically_increasing_id()).withColumn("std_type", F.col("field_type")))
    queries = checkpoint(embed_distinct(embed_distinct(distinct, "variant", embed, "name_vector"), "business_meaning", embed, "meaning_vector"))
    dense = retrieve.dense_search(queries, vectors, k)
    by_name = retrieve.bm25(distinct, index, k, "query_id", "std_id", "variant", "name_text", by="std_type")
    by_meaning = retrieve.bm25(distinct, index, k, "query_id", "std_id", "business_meaning", "meaning_text", by="std_type")
    hits = checkpoint(retrieve.hybrid_union(dense, by_name, by_meaning))
    rows_of = named.select("row_index", "variant_pos", *asked).join(distinct.drop("std_type"), asked).drop("field_type", "business_meaning")
    merged = retrieve.fetch_candidates(retrieve.merge_variants(hits.join(rows_of, "query_id")), standards).join(fields.select("row_index", "field_type", "data_example"), "row_index")
    merged = checkpoint(merged)
    left, info = mapping.filter_domains(merged)
    if fetch_errors is None:
        fetch_errors = fields.sparkSession.createDataFrame([], "row_index bigint, fetch_error string")
    left = checkpoint(left.join(fetch_errors.select("row_index"), "row_index", "left_anti"))
    requests = checkpoint(mapping.selection_requests(fields, left))
    n = left.groupBy("row_index").agg(F.count(F.lit(1)).alias("n_candidates"))
    text = requests.select("row_index", mapping.candidate_text(F.col("candidates")).alias("candidates"))
    answers = _ask(requests, select, "selection", 5, checkpoint, "raise", by="field_type", calls=calls)
    rows = fields.select("row_index")
    for part in (n, answers, text, info.select("row_index", "domain_check_details"), fetch_errors):
        rows = rows.join(part, "row_index", "left")
    state = F.coalesce("fetch_error", F.lit("")), F.coalesce("n_candidates", F.lit(0)), F.col("status")
    ok = (F.col("status") == OK) & (F.coalesce("fetch_error", F.lit("")) == "")
    results = rows.select(
        "row_index", mapping.outcome(*state, F.col("selection")).alias("mapping_result"), F.when(ok, F.col("selected_std_id")).alias("selected_std_id"),
        F.when(ok, F.col("selected_std_name")).alias("selected_std_name"), mapping.outcome_reason(*state, F.col("reasoning")).alias("llm_reason"), "candidates", "domain_check_details",
    )
    return write_back(sheet, results)


def enum_mapping(
    sheet: DataFrame, dictionary: DataFrame, embed: Callable, select: Scorer | None = None, least: float = 0.8, checkpoint: Callable[[DataFrame], DataFrame] = kept,
    fetch_errors: DataFrame | None = None, calls: Calls | None = None,
) -> DataFrame:
    """The enum fields mapped: mapping_result, selected_std_id, selected_std_name, enum_code_suggestion, llm_reason, and candidates with their
    scores. A call of the selection that fails marks its rows; fetch_errors as in standard_mapping."""
    calls = calls and calls.of("enum_mapping")
    fields = enummap.enum_fields(sheet)
    # what is found depends on the list of pairs alone: each distinct list is searched once and named by its first row
    lists = checkpoint(fields.groupBy("pairs").agg(F.min("row_index").alias("list"), F.count(F.lit(1)).alias("n")))
    n_fields = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fields = fields.select("row_index", "field_name", "field_type", "business_meaning", "pairs")
    fields = checkpoint(join_one(fields, lists.select("pairs", "list"), "pairs", lists.select("pairs", "n"), n_fields, "row_index").drop("pairs"))
    each = lists.select(F.col("list").alias("row_index"), "pairs")
    pairs = enummap.field_pairs(each)
    records = dic.enum_value_records(dic.enum_items(dictionary)).withColumnRenamed("value", "value_text")
    texts = checkpoint(embed_distinct(dic.distinct_values(pairs), "value", embed))
    known = checkpoint(embed_distinct(records.select("value_text").distinct(), "value_text", embed))
    hits = checkpoint(enummap.similar_values(texts, known, records, least=least))
    best = checkpoint(enummap.recall(enummap.greedy_scores(pairs, hits), each.select("row_index", F.size("pairs").alias("n"))))
    back = dic.backfill(best.select("item_id"), dictionary)
    d = enummap.details(F.col("pairs"), F.col("matched"))
    both = best.join(back.select("item_id", "item_name", "standards"), "item_id").join(each, "row_index")
    found = checkpoint(both.withColumn("missing_values", d["missing_values"]).select("row_index", "rank", "item_id", "item_name", "score", "operation", "missing_values", "standards"))
    cand = found.select("row_index", "rank", "item_id", "operation", "missing_values", F.posexplode("standards").alias("std_pos", "s")).select("*", "s.std_id", "s.std_name", "s.definition").drop("s")
    if fetch_errors is None:
        fetch_errors = sheet.sparkSession.createDataFrame([], "row_index bigint, fetch_error string")
    offered = checkpoint(enummap.selection_request(cand).withColumnRenamed("row_index", "list"))
    requests = fields.join(offered.select("list"), "list", "left_semi").join(fetch_errors.select("row_index"), "row_index", "left_anti")
    requests = requests.select("row_index", "field_name", "field_type", "business_meaning", "list")
    answers = _ask(checkpoint(requests), select, "selection", 5, checkpoint, "mark", by="field_type", calls=calls, shared=offered)
    listed = checkpoint(found.groupBy(F.col("row_index").alias("list")).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        enummap.candidate_text(F.sort_array(F.collect_list(F.struct("rank", "item_id", "item_name", "score", "operation", "standards")))).alias("candidates"),
    ))
    rows = fields.select("row_index", "list").join(answers, "row_index", "left").join(fetch_errors, "row_index", "left")
    rows = rows.join(listed.select("list", "n_candidates"), "list", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    named = rows.withColumnsRenamed({"row_index": "field", "list": "row_index"})
    done = enummap.outcome(enummap.locate(named, cand)).withColumnsRenamed({"row_index": "__list", "field": "row_index"})
    ok = F.col("item_id").isNotNull() & (F.col("status") == OK)
    out = write_back(sheet.drop("candidates"), done.select(
        "row_index", "mapping_result", F.when(ok, F.col("selected_std_id")).alias("selected_std_id"), F.when(ok, F.col("selected_std_name")).alias("selected_std_name"),
        "enum_code_suggestion", "llm_reason", "__list",
    ))
    # a list's text names all standards of its codes, so it comes last and no shuffle carries it for every row; rows without a list are spread
    named = out.withColumn("__list", F.struct(F.col("__list").alias("l"), F.when(F.col("__list").isNull(), F.col("row_index")).alias("r")))
    text = listed.select(F.struct(F.col("list").alias("l"), F.lit(None).cast("bigint").alias("r")).alias("__list"), "candidates")
    sizes = lists.select(F.struct(F.col("list").alias("l"), F.lit(None).cast("bigint").alias("r")).alias("__list"), "n")
    out = join_one(named, text, "__list", sizes, max(n_fields, 1), "row_index", "left")
    return out.select(*[c for c in out.columns if c not in ("__list", "candidates")], F.coalesce("candidates", F.lit("")).alias("candidates"))


def standard_maintenance(entries: DataFrame, name: Scorer | None, definition: Scorer | None, merge: Scorer | None, checkpoint: Callable[[DataFrame], DataFrame] = kept, calls: Calls | None = None) -> DataFrame:
    """Entries of new standards with normalised names and merged definitions. A failed call keeps names, and leaves definitions blank with
    the reason."""
    calls = calls and calls.of("standard_maintenance")
    rows = maintain.apply_names(entries, _ask(maintain.name_requests(entries), name, "name", 5, checkpoint, calls=calls))
    rows = checkpoint(maintain.apply_definitions(rows, _ask(maintain.definition_requests(rows), definition, "definition", 5, checkpoint, "mark", calls=calls)))
    return maintain.maintenance_table(maintain.apply_merges(rows, _ask(maintain.merge_requests(rows), merge, "merge", 5, checkpoint, "mark", calls=calls)))
