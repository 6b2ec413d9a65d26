"""CSV files whose cells may hold line ends, read by many tasks.

A file is read in ranges, as lines. Whether a line begins a record depends on the number of quote signs before it: an even one,
and it does. So quote signs are counted per range first; the sums over the ranges before say how each begins. Then every range
puts its records together; what is left of a record at a range's beginning goes to the range where it began. Records are numbered
by the counts of the ranges before theirs, so that no order of rows has to be kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"))


def _ranges(batches: Iterator[pd.DataFrame], quote: str) -> Iterator[tuple[str, int, bool, pd.Series, np.ndarray]]:
    """(file, range, whether it begins here, lines, quote signs before each line within the range): the lines of a range come in order."""
    at, seen = None, 0
    for pdf in batches:
        key = pdf["f"] + "\x00" + pdf["s"].astype(str)
        cuts = np.flatnonzero((key != key.shift()).to_numpy())
        for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
            part = pdf.iloc[a:b]
            here = (part["f"].iloc[0], int(part["s"].iloc[0]))
            new = here != at
            if new:
                at, seen = here, 0
            q = part["value"].str.count(quote).to_numpy(np.int64)
            before = seen + np.cumsum(q) - q
            seen += int(q.sum())
            yield *here, new, part["value"], before


def _blank(lines: pd.Series) -> np.ndarray:
    return lines.isin(["", "\r"]).to_numpy()


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str] | None = None, index: str = "row_index", sep: str = ",", quote: str = '"') -> DataFrame:
    """The cells of a CSV file, or a folder of them, as text, with the number of each row from 0 (files by name). The first record of
    a file is its header; columns: the names in it, else those of the first file are read.

    Quote signs stand around cells, or doubled within: a single one within a cell without quotes would turn what follows inside out. Empty
    cells are null, empty lines are no records, line ends within cells are kept (as one newline). Splits are those of
    spark.sql.files.maxPartitionBytes; the driver holds three numbers for each. A record longer than a split is put together from its parts."""
    names = columns or spark.read.option("header", True).option("multiLine", True).option("escape", quote).option("sep", sep).csv(path).columns
    names = [n.removesuffix("\r") for n in names]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[int]] = {}
        for f, s, _, lines, before in _ranges(batches, quote):
            n = held.setdefault((f, s), [0, 0, 0])
            odd, real = before % 2 == 1, ~_blank(lines)
            n[0] += int(lines.str.count(quote).sum())
            n[1] += int((~odd & real).sum())  # records that begin here if the range begins outside quotes
            n[2] += int((odd & real).sum())  # or inside
        yield pd.DataFrame([(*k, *n) for k, n in held.items()], columns=["f", "s", "q", "n0", "n1"])

    lines = _lines(spark, path)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = lines.mapInPandas(count, "f string, s bigint, q bigint, n0 bigint, n1 bigint").groupBy("f", "s").agg(*[F.sum(c).alias(c) for c in ("q", "n0", "n1")])
    ranges = ranges.withColumn("odd", before("q", Window.partitionBy("f").orderBy("s")) % 2).withColumn("n", F.when(F.col("odd") == 1, F.col("n1")).otherwise(F.col("n0")))
    held = sorted(tuple(r) for r in ranges.select("f", "s", "odd", "n").collect())  # one row a range
    total: dict[str, int] = {}
    for f, _, _, n in held:
        total[f] = total.get(f, 0) + n
    plan, base, number = {}, {}, 0
    for f, s, odd, n in held:
        if f not in base:
            number -= total[f] > 0  # the header is a record too, and has the number before the first
            base[f] = number
        plan[f, s] = (odd, number)
        number += n
    hold = spark.sparkContext.broadcast((plan, base))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records that lie in one range (f null), and the parts in each range of those that lie in several."""
        plan, base = hold.value
        key, lines_of, at, head, inside = None, [], 0, False, False

        def ended(last: bool) -> list[tuple]:
            """What has been gathered, as a row: none for a header; a part if it goes on from another range, or on into one."""
            if not lines_of or (not head and at - 1 == base[key[0]]):
                return []
            part = head or (last and inside)
            return [(None if head else at - 1, key[0] if part else None, key[1] if part else None, "\n".join(lines_of), head)]

        for f, s, new, values, before in _ranges(batches, quote):
            out = []
            if new:
                out += ended(True)
                odd, at = plan[f, s]
                key, lines_of, head, inside = (f, s), [], odd == 1, odd == 1
            begins = (before + odd) % 2 == 0
            for line, first, blank in zip(values, begins, _blank(values), strict=True):
                if first and blank:
                    continue
                if first:
                    out += ended(False)
                    lines_of, head = [], False
                    at += 1
                lines_of.append(line)
            inside = (int(before[-1]) + values.iloc[-1].count(quote) + odd) % 2 == 1
            yield pd.DataFrame(out, columns=["i", "f", "s", "text", "head"]).astype({"i": "Int64", "s": "Int64"})
        if key is not None:
            yield pd.DataFrame(ended(True), columns=["i", "f", "s", "text", "head"]).astype({"i": "Int64", "s": "Int64"})

    made = lines.mapInPandas(records, "i bigint, f string, s bigint, text string, head boolean")
    parts = made.where("f is not null")
    chain = F.sum(F.when(F.col("head"), 0).otherwise(1)).over(Window.partitionBy("f").orderBy("s", F.desc("head")).rowsBetween(Window.unboundedPreceding, 0))  # two rows a range
    joined = parts.withColumn("chain", chain).groupBy("f", "chain").agg(F.max("i").alias("i"), F.sort_array(F.collect_list(F.struct("s", "text"))).alias("x"))
    joined = joined.where("i is not null").select("i", F.array_join(F.transform("x", lambda y: y["text"]), "\n").alias("text"))
    whole = made.where("f is null").select("i", "text").unionByName(joined)
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
    cells = F.from_csv(text, ", ".join(f"`{c}` string" for c in names), {"sep": sep, "quote": quote, "escape": quote, "maxCharsPerColumn": "-1"})
    return whole.select("i", cells.alias("r")).select(F.col("i").alias(index), *[F.col("r").getField(c).alias(c) for c in names])
