"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

The number of rows that each source partition sends to each shard is drawn exactly; rows are permuted within
their partition, cut by those counts, exchanged, and permuted again within the shard. DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the communication matrix at most: 8 MB, drawn on the driver and broadcast.
MATRIX_CELLS = 1 << 20


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts that differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement from good + bad are good, exactly at any size: by inversion over the probabilities
    around the mode, which follow from their ratios. What lies beyond 12 standard deviations and 40 is under 2^-53 together."""
    lo, hi = max(0, n - bad), min(n, good)
    total = good + bad
    if lo == hi:
        return lo
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    p = good / total
    reach = int(12 * (n * p * (1 - p) * (total - n) / max(total - 1, 1)) ** 0.5) + 40
    first, last = max(lo, mode - reach), min(hi, mode + reach)
    x = np.arange(first, last, dtype=np.float64)  # ratios of the probabilities of x + 1 and x
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(float(bad - n) + x + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    cdf = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"))


def communication_matrix(held: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows go from each partition to each shard if all rows are dealt by one uniform permutation: row p is a
    multivariate hypergeometric draw of held[p] rows from what the shards still lack, one shard after the other."""
    rng = np.random.default_rng(seed)
    lack, rest = [int(k) for k in sizes], sum(int(k) for k in sizes)
    out = []
    for n in held:
        row, n, after = [], int(n), rest
        rest -= n
        for s, k in enumerate(lack):
            after -= k
            x = hypergeometric(rng, k, after, n) if n and k else 0
            row.append(x)
            n -= x
            lack[s] = k - x
        out.append(row)
    return out


def uniform_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", seed: int = 42, rows_per_partition: int = 250_000) -> DataFrame:
    """df with columns shard (0 to shards - 1) and slot (0, 1, ... within the shard): a uniform random permutation of the
    rows dealt into shards whose sizes differ by one at most. The same rows and seed give the same result.

    Columns of those names are replaced. Source partitions are hash ranges of the row, about rows_per_partition rows each, or more
    where that would take over MATRIX_CELLS numbers; a partition's window sorts, so it may spill. Rows with null or repeated ids
    and null, empty or very long texts are dealt like others: all columns but nested maps tell rows apart, and rows equal in all are
    alike and stand in one partition. An empty table gives an empty result. No other column may begin with __shards_.
    """
    df = df.drop("shard", "slot")
    kinds = dict(df.dtypes)
    order = sorted(c for c in df.columns if "map<" not in kinds[c] and kinds[c] != "variant")
    cells = [F.coalesce(F.xxhash64(F.col(f"`{c}`"), F.lit(i)), F.lit(0)) for i, c in enumerate(order)]
    mark = F.xxhash64(F.lit(seed), *cells)
    total = df.select(F.lit(1)).count()
    parts = max(1, min(max(-(-total // rows_per_partition), min(32, total // 2000)), MATRIX_CELLS // shards))
    rows = df.withColumn("__shards_k", mark).withColumn("__shards_p", F.pmod(F.xxhash64("__shards_k", F.lit(1)), F.lit(parts)).cast("int"))
    held = dict(rows.groupBy("__shards_p").count().collect())  # one number a partition
    order_p = sorted(held)
    matrix = communication_matrix([held[p] for p in order_p], shard_sizes(total, shards), seed)
    ends = [np.cumsum(r).tolist() for r in matrix]
    spark = df.sparkSession
    cuts = spark.createDataFrame([(int(p), e) for p, e in zip(order_p, ends, strict=True)], "__shards_p int, __shards_ends array<bigint>")
    tie = [F.col(f"`{id_col}`"), "__shards_k"] if id_col in df.columns else ["__shards_k"]
    local = Window.partitionBy("__shards_p").orderBy(F.xxhash64("__shards_k", F.lit(2)), *tie)
    dealt = (
        rows.withColumn("__shards_r", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "__shards_p")  # at most MATRIX_CELLS numbers, drawn on the driver above
        .withColumn("shard", F.size(F.filter("__shards_ends", lambda x: x <= F.col("__shards_r"))).cast("int"))
        .drop("__shards_ends", "__shards_r", "__shards_p")
    )
    # permuted again: slots by a fresh random order, in ranges small enough for a window each
    per_shard = max(1, -(-total // shards))
    ranges = max(1, per_shard // rows_per_partition + 1)
    dealt = dealt.withColumn("__shards_q", F.xxhash64("__shards_k", F.lit(3)))
    dealt = dealt.withColumn("__shards_b", F.floor(F.shiftrightunsigned("__shards_q", 33).cast("double") / float(2**31) * ranges).cast("int"))
    within = F.row_number().over(Window.partitionBy("shard", "__shards_b").orderBy(F.shiftrightunsigned("__shards_q", 1), *tie)) - 1
    dealt = dealt.withColumn("slot", within.cast("bigint"))
    if ranges > 1:
        before = Window.partitionBy("shard").orderBy("__shards_b").rowsBetween(Window.unboundedPreceding, -1)
        sizes = dealt.groupBy("shard", "__shards_b").agg(F.count(F.lit(1)).alias("__shards_n"))
        offset = sizes.withColumn("__shards_o", F.coalesce(F.sum("__shards_n").over(before), F.lit(0))).drop("__shards_n")
        dealt = dealt.join(offset, ["shard", "__shards_b"]).withColumn("slot", F.col("slot") + F.col("__shards_o")).drop("__shards_o")
    return dealt.drop("__shards_k", "__shards_q", "__shards_b")


def write_shards(df: DataFrame, path: str) -> None:
    """Shards as Parquet folders shard=N, rows in slot order. Each shard's slots are dealt to files by range. Null, empty and very long texts and
    repeated rows are written as they are; an empty table gives a folder without shards."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs. A null or empty text has no bytes: size 16, crc32 0.
    Repeated rows give a row each, an empty table an empty result. Other columns are not used."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return uniform_shards(slim, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
