"""Incremental intake: row rules on sheets as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import strip_ws
from ..operators.quality import blank_placeholders, duplicate_fields, row_issues
from ..sources.index import Folder


def check_stream(rows: DataFrame) -> DataFrame:
    """The rules that need one row only; duplicates need the landed table (duplicates_of)."""
    out = blank_placeholders(rows).withColumn("rule_issues", row_issues())
    return out.withColumn("rule_passed", F.size("rule_issues") == 0)


def read_sheets(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def start_intake(rows: DataFrame, out: str, checkpoint: str, once: bool = True, counts: str | None = None) -> StreamingQuery:
    """Writes each batch of checked rows to its own folder of out. A batch that runs again replaces its folder by the same rows, so a replay changes
    nothing. With counts, a folder, the rows of each (table, field) are counted there as they come (see duplicate_names)."""
    def land(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)
        if counts:
            count_names(batch, counts, number)

    writer = check_stream(rows).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Batches whose counts are added up into one table.
MERGED = 20
_COUNTS = "table_name string, field_name string, n bigint"


def count_names(batch: DataFrame, path: str, number: int, merged: int = MERGED) -> None:
    """Keeps the number of rows of each (table, field) of a batch under its number, in place of what a run before has kept there; blank names
    do not count. Every so many batches all counts are added up into one table, so that reading them stays bounded by names and merged
    tables; the one before stays, as a replay of the batch needs it."""
    spark, folder = batch.sparkSession, Folder(batch.sparkSession, path)
    names = batch.select(strip_ws("table_name").alias("table_name"), strip_ws("field_name").alias("field_name")).where("table_name != '' and field_name != ''")
    names.groupBy("table_name", "field_name").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch-{number:09d}")
    if number % merged == merged - 1:
        _counted(spark, folder, number - 1, number).write.mode("overwrite").parquet(f"{path}/upto-{number:09d}")
        last = [n for n in _whole(folder, "upto-") if n < number]
        for n in last[:-1]:
            folder.remove(f"upto-{n:09d}")
        for n in _whole(folder, "batch-"):
            if last and n <= last[-1]:
                folder.remove(f"batch-{n:09d}")


def _whole(folder: Folder, kind: str) -> list[int]:
    """The numbers of the tables of that kind that have been written to their end."""
    return [int(n[len(kind):]) for n in folder.names() if n.startswith(kind) and "_SUCCESS" in folder.names(n)]


def _counted(spark: SparkSession, folder: Folder, upto: int, number: int) -> DataFrame:
    """The counts of all batches up to number: the last table that adds up batches to upto at most, and the batches after it."""
    base = max([n for n in _whole(folder, "upto-") if n <= upto], default=None)
    read = [f"upto-{base:09d}"] if base is not None else []
    read += [f"batch-{n:09d}" for n in _whole(folder, "batch-") if (base is None or n > base) and n <= number]
    rows = spark.read.schema(_COUNTS).parquet(*[f"{folder.path}/{n}" for n in read]) if read else spark.createDataFrame([], _COUNTS)
    return rows.groupBy("table_name", "field_name").agg(F.sum("n").alias("n"))


def duplicate_names(spark: SparkSession, path: str) -> DataFrame:
    """table_name, field_name and n of the names that more than one landed row has, from the counts alone: landed rows are not read again."""
    folder = Folder(spark, path)
    newest = max([*_whole(folder, "upto-"), *_whole(folder, "batch-")], default=-1)
    return _counted(spark, folder, newest, newest).where("n > 1")


def duplicates_of(landed: DataFrame) -> DataFrame:
    """The landed rows whose (table, field) stands more than once."""
    return duplicate_fields(landed).where("is_duplicate")
