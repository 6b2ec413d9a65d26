"""Joins in which one key may hold much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept

#: A key with more than this part of a table's rows is dealt over several tasks; so there are fewer such keys than this.
PIECES = 2048
#: Rows that one task may well hold.
FEW = 100_000
#: Rows of a table that is sent to every executor, at most.
SENT = 200_000


def small(df: DataFrame, rows: int = SENT) -> bool:
    """Whether df has at most so many rows; no more than that are counted."""
    return df.limit(rows + 1).count() <= rows


def gathered(df: DataFrame, rows: int, least: int = 4) -> DataFrame:
    """df of about so many rows in no more partitions than FEW / 2 rows each ask for: a small table's stages have few tasks then, and leave few
    files. Nothing is moved."""
    return df.coalesce(max(least, -(-2 * rows // FEW)))


def join_one(rows: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with one, which has one row a key; no task gets a hot key whole.

    counts: key and n, its number of rows in rows; total: at least the rows of rows. A key with more than total / PIECES of them
    is dealt over several tasks by a hash of the column spread, and its row of one is copied to each. Such keys are fewer than
    PIECES, whatever the input, so they are broadcast; copies of their rows are fewer than twice that. Of up to FEW rows no task can have
    too many: these are joined as they are."""
    if total <= FEW:
        return rows.join(one, key, how)
    per = max(16.0, total / PIECES)
    hot = kept(counts.where(F.col("n") > per).select(key, F.ceil(F.col("n") / per).cast("int").alias("__m")))
    if hot.isEmpty():
        return rows.join(one, key, how)
    hot = F.broadcast(hot)
    left = rows.join(hot, key, "left").withColumn("__s", F.when(F.col("__m").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread, F.lit(17)), F.col("__m"))).cast("int")).drop("__m")
    right = one.join(hot, key, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__m", F.lit(1)) - 1))).drop("__m")
    return left.join(right, [key, "__s"], how).drop("__s")
