"""Reading sheets and dictionaries, writing results back."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_cell, strip_ws
from ..functions.vocab import NULL_CELLS, SHEET_COLUMNS


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. A local session without one gets a temporary folder."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class MissingColumns(ValueError):
    """A required column of a sheet is missing."""


def read_cells(spark: SparkSession, path: str, kind: str = "csv", columns: list[str] | None = None, **options) -> DataFrame:
    """A table whose cells are all text, from CSV, JSON lines or Parquet. columns: the names in the file, so that nothing is inferred from
    its data. For CSV the first line is the header and cells may span lines, so that each file is one task's; sources.quoted reads large files by
    many."""
    reader = spark.read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    df = reader.load(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def resolve_columns(df: DataFrame, names: dict[str, list[str]] = SHEET_COLUMNS) -> dict[str, str]:
    """Logical name -> the first of its source names that df has, matched exactly."""
    return {logical: found[0] for logical, sources in names.items() if (found := [s for s in sources if s in df.columns])}


def load_sheet(
    df: DataFrame, required: list[str], optional: list[str] = (), names: dict[str, list[str]] = SHEET_COLUMNS,
    key: str | None = None, null_cells: list[str] = NULL_CELLS,
) -> DataFrame:
    """row_index and the logical columns, cleaned. Raises MissingColumns if a required one is missing; a missing optional one is
    empty. key: the column that numbers the rows; without it rows are numbered in the order of the table, from 0."""
    found = resolve_columns(df, names)
    if missing := [c for c in required if c not in found]:
        raise MissingColumns("missing columns: " + ", ".join(f"{c} ({' / '.join(names[c])})" for c in missing))
    df = df.withColumn("row_index", F.col(f"`{key}`").cast("long")) if key else with_row_index(df)
    cells = [
        (clean_cell(F.col(f"`{found[c]}`"), null_cells) if c in found else F.lit("")).alias(c) for c in [*required, *[o for o in optional if o not in required]]
    ]
    return df.select("row_index", *cells)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """df with a number from 0 in the order of the table. The rows are kept with their places first, so that the numbers hold if a part
    is read again; then they are counted per partition and offset, so no task holds all rows."""
    return _numbered(df, name, [], 0)


def number_rows(df: DataFrame, order: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with 1, 2, ... in the order of a column, within by if given. Rows are sorted by range, kept, counted per partition and offset:
    neither a class nor the whole table is one task's."""
    return _numbered(df.orderBy(*(by or []), order), name, by or [], 1)


def _numbered(df: DataFrame, name: str, by: list[str], start: int) -> DataFrame:
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    marked = kept(df.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id(), "__g": group}))
    counts = marked.groupBy("__p", "__g").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", "__g", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__o"))
    # a row for each class in each partition that has it
    return marked.join(F.broadcast(offsets), ["__p", "__g"]).withColumn(name, F.col("__i") + F.col("__o") + start).drop("__p", "__i", "__g", "__o")


def union_classes(tables: dict[str, DataFrame], class_col: str = "std_type") -> DataFrame:
    """One dictionary from a table per class, each row tagged with its class; columns that some tables lack are null."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn(class_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def load_domains(df: DataFrame, id_col: str = "domain_id", pos: str = "pos") -> DataFrame:
    """Rows with an id, the last of each id by pos."""
    kept = df.where(F.coalesce(strip_ws(F.col(id_col)), F.lit("")) != "")
    return last_per_key(kept, [id_col], [pos])


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def write_back(sheet: DataFrame, results: DataFrame, key: str = "row_index") -> DataFrame:
    """Every row of the input with the result columns; rows without a result get empty text. Columns of the same name are replaced."""
    added = [c for c in results.columns if c != key]
    joined = sheet.drop(*added).join(results, key, "left")
    kinds = dict(joined.dtypes)
    return joined.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in added and kinds[c] == "string" else F.col(c) for c in joined.columns])


def overwrite_enum(raw: Column, normalized: Column) -> Column:
    """The normalised enum list, or the raw one where there is none."""
    return F.when(F.coalesce(normalized, F.lit("")) != "", normalized).otherwise(raw)


def write_batches(df: DataFrame, path: str, key: str = "row_index", rows: int = 1_000_000) -> None:
    """Writes rows in batches of so many keys, a folder each; writing a batch again replaces it and leaves the others. A batch is what is
    written again at once, so its size is a matter of files: 10^9 rows are a thousand folders."""
    df.withColumn("batch", F.floor(F.col(key) / rows).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def upsert(current: DataFrame, records: DataFrame, key: str = "standard_id") -> DataFrame:
    """current with each record in place of the row of its key, or added; of records of one key any later one by pos wins."""
    fresh = records.withColumn("__v", F.lit(1)).unionByName(current.withColumn("__v", F.lit(0)), allowMissingColumns=True)
    order = [F.col("__v").desc()] + ([F.col("pos").desc()] if "pos" in fresh.columns else [])
    return fresh.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r", "__v")


def write_index(df: DataFrame, path: str, class_col: str = "std_type") -> None:
    """One folder per class."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(class_col).parquet(path)


def not_done(todo: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What is not in the cache yet."""
    return todo.join(cache.select(key).distinct(), key, "left_anti")


def resume(todo: DataFrame, cache: DataFrame, key: str, work) -> DataFrame:
    """The cache and what work makes of the rows that it lacks."""
    return cache.unionByName(work(not_done(todo, cache, key)))


def export_dictionary(standards: DataFrame, domains: DataFrame, details: DataFrame, path: str) -> None:
    """Four tables under path: standards by id, domains, enum_header (with its number of codes) and enum_detail."""
    standards.repartitionByRange("std_id").sortWithinPartitions("std_id").write.mode("overwrite").parquet(f"{path}/standards")
    domains.write.mode("overwrite").parquet(f"{path}/domains")
    details.write.mode("overwrite").parquet(f"{path}/enum_detail")
    header = enum_header(standards, details)
    header.write.mode("overwrite").parquet(f"{path}/enum_header")


def enum_header(standards: DataFrame, details: DataFrame) -> DataFrame:
    """enum_id, name, rule, domain of every enum standard with the number of its codes."""
    n = details.groupBy("enum_id").agg(F.count(F.lit(1)).alias("n_codes"))
    used = standards.where(F.coalesce(F.col("enum_id"), F.lit("")) != "").select("enum_id", "domain_name", "rule", "domain_id", "domain_type")
    return used.join(n, "enum_id", "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(0)))
