"""Exact dense retrieval: items in cells around centroids, the best cells first, cells out of reach skipped.

An item stands in the cell of its nearest centroid. The angle from a centroid to the farthest item of its cell is the cell's
radius; no item of a cell is nearer to a query than the query's angle to the centroid less that radius. A query looks into the
cells that may be nearest until it has k items, then only into those whose bound reaches its k-th score: nothing is lost.

Items of one block's size are sent to all tasks. More are dealt into blocks of whole cells (a large cell into several), and
queries go to the blocks of their best cells first, then to the others that are in reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from .joins import SENT, small

#: Numbers of a block of items, and of the queries that meet it in one task; cosines held at once, and numbers of a table beside them.
BLOCK_NUMBERS, QUERY_NUMBERS, CELLS, HELD = 1 << 22, 1 << 22, 1 << 20, 1 << 20
#: Items from which on queries are dealt over all tasks; tasks for each core, queries of one at least, and partitions at most.
SPREAD, TASKS, LEAST_QUERIES, MOST_TASKS = 1 << 12, 4, 1 << 10, 2000
#: Centroids at most, numbers of them at most, and items of the sample that they are chosen from.
CENTROIDS, CENTROID_NUMBERS, SAMPLE = 256, 1 << 20, 4096
#: Scores are compared to so many digits; bounds give way by a little more than their rounding.
DIGITS, SLACK = 12, 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def best(row: np.ndarray, col: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row by falling v, then by col."""
    rank = np.lexsort((col, -v, row))
    row, col, v = row[rank], col[rank], v[rank]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], v[keep]


def choose_centroids(sample: np.ndarray, m: int, rounds: int = 4) -> np.ndarray:
    """m unit vectors at most: each as far as possible from those before, then moved to the middle of what is nearest to them."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < m and near.min() < 0.999:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centre = sample[chosen]
    for _ in range(rounds):
        at = (sample @ centre.T).argmax(1)
        sums = np.stack([np.bincount(at, sample[:, j], len(centre)) for j in range(sample.shape[1])], axis=1)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, sums / np.where(size > 1e-9, size, 1), centre)
    return centre


def reach(cosine: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest cosine that an item can have with a query of that cosine to a centroid, if no item's to it is under low."""
    apart = np.arccos(np.clip(cosine, -1, 1)) - np.arccos(np.clip(low, -1, 1))
    return np.cos(np.maximum(apart, 0)) + SLACK


class Block:
    """Items of some cells, held by cell: ids (ascending within a cell's ties), unit vectors, and each cell's begin, end and radius."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, centroids: np.ndarray, most: int | None = None):
        """most: how many items of one vector are held, those of the smallest ids; no more can be among the best of a query for so many."""
        order = np.lexsort((ids, cell))
        if most is not None and len(ids) > most:
            _, same, n = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0], return_inverse=True, return_counts=True)
            if n.max() > most:
                by = np.lexsort((ids[order], same))
                order = order[np.sort(by[np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n) < most])]
        self.ids, self.x, cell = ids[order], unit(x[order]), cell[order]
        self.rough = self.x.astype(np.float32)
        self.at = np.argsort(self.ids, kind="stable")
        self.place = np.empty(len(self.at), np.int64)  # for ties
        self.place[self.at] = np.arange(len(self.at))
        self.cells, self.start = np.unique(cell, return_index=True)
        self.end = np.append(self.start[1:], len(cell))
        self.centre = centroids[self.cells]
        cosine = (self.x * centroids[cell]).sum(1)
        self.low = np.minimum.reduceat(cosine, self.start) - SLACK if len(cell) else cosine

    def search(self, x: np.ndarray, k: int, least: float | None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, item, score, cosines computed): for each row of x its k best items, least and floor (of each row) at least. Rows are taken so many
        at a time that nothing is held of all rows but their k items."""
        kth = np.full(len(x), -np.inf) if floor is None else floor.astype(np.float64)
        if least is not None:
            kth = np.maximum(kth, least)
        step = max(1, HELD // max(len(self.cells), k, x.shape[1]))
        parts = [self._some(x[i:i + step], k, kth[i:i + step], i) for i in range(0, len(x), step)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        row, at, v, done = zip(*parts, strict=True)
        return np.concatenate(row), np.concatenate(at), np.concatenate(v), sum(done)

    def _some(self, x: np.ndarray, k: int, kth: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """search for some rows. Cosines in single precision tell which may be among the k best; these are then computed in double."""
        n, m = len(x), len(self.cells)
        rough, off = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23  # how far a cosine in single precision can be off
        bound = reach(x @ self.centre.T, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum((self.end - self.start)[order], axis=1) - (self.end - self.start)[order]
        first = np.zeros((n, m), bool)
        np.put_along_axis(first, order, before < k, axis=1)  # the best cells, until they hold k items
        del order, before
        none = np.zeros(0, np.int64)
        row, place, v = none, none, np.zeros(0)  # the best so far
        new, waiting, done = [], 0, 0

        def settle() -> None:
            """The k best of those so far and the new ones, in double precision."""
            nonlocal row, place, v, waiting, new
            if not new:
                return
            r, c = np.concatenate([a for a, _ in new]), np.concatenate([b for _, b in new])
            new, waiting, step = [], 0, max(1, HELD // x.shape[1])
            score = np.concatenate([np.einsum("ij,ij->i", x[r[i:i + step]], self.x[c[i:i + step]]) for i in range(0, len(r), step)])
            score = np.round(score, DIGITS)
            ok = score >= kth[r]
            row, place, v = best(np.concatenate([row, r[ok]]), np.concatenate([place, self.place[c[ok]]]), np.concatenate([v, score[ok]]), k)
            last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else none
            full = last[np.bincount(row, minlength=n)[row[last]] == k]
            kth[row[full]] = np.maximum(kth[row[full]], v[full])

        def look(cell: int, who: np.ndarray) -> None:
            nonlocal done, waiting
            s, e = int(self.start[cell]), int(self.end[cell])
            step = max(1, CELLS // (e - s))
            for i in range(0, len(who), step):
                at = who[i:i + step]
                score = rough[at] @ self.rough[s:e].T
                done += score.size
                need = kth[at] - off
                if e - s > k and not np.isfinite(need).all():
                    need = np.maximum(need, np.partition(score, e - s - k, axis=1)[:, e - s - k] - 2 * off)
                r, c = np.divmod(np.flatnonzero(score >= need.astype(np.float32)[:, None] - np.float32(1e-7)), e - s)
                if len(r):
                    new.append((at[r], c + s))
                    waiting += len(r)
                if waiting > max(2 * n * k, 1 << 16):
                    settle()

        for cell in range(m):
            look(cell, np.flatnonzero(first[:, cell] & (bound[:, cell] >= kth)))
        settle()
        for cell in np.argsort(-bound.max(0, initial=-1), kind="stable") if n else []:
            look(int(cell), np.flatnonzero(~first[:, cell] & (bound[:, cell] >= kth)))
        settle()
        return row + offset, self.at[place], v, done


def packed(df: DataFrame, id_col: str, name: str, vec: str, by: str | None, centroids: np.ndarray | None = None) -> DataFrame:
    """name, c and the vector as bytes v; with centroids, also the cell. Rows whose vector or class is null, or whose vector has null or
    non-finite entries, find nothing and are left out."""
    kinds = dict(df.dtypes)
    wide = kinds[vec] != "array<float>"
    rows = df.select(F.col(id_col).alias(name), (F.col(by) if by else F.lit(0)).alias("c"), F.col(vec).cast("array<double>" if wide else "array<float>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("c").isNotNull() & F.col("v").isNotNull() & fine)
    number = np.float64 if wide else np.float32
    hold = None if centroids is None else df.sparkSession.sparkContext.broadcast(centroids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(number, copy=False)
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
            made = {name: batch.column(name), "c": batch.column("c"), "v": pa.array([flat[a:b].astype("<f8").tobytes() if wide else flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())}
            if hold is not None:
                x = unit(flat.reshape(len(v), -1)) if len(v) else np.zeros((0, hold.value.shape[1]))
                made["cell"] = pa.array((x @ hold.value.T).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_pydict(made)

    kind_c = kinds[by] if by else "int"
    return rows.mapInArrow(pack, f"{name} {kinds[id_col]}, c {kind_c}, v binary" + (", cell int" if centroids is not None else ""))


def _rows(v: pd.Series, dim: int) -> np.ndarray:
    joined = b"".join(v)
    return np.frombuffer(joined, "<f8" if len(joined) == 8 * dim * len(v) else "<f4").reshape(len(v), dim)


def topk_cosine(
    queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, vec: str = "vector", by: str | None = None, least: float | None = None,
    query_rows: int | None = None, block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """query_id, item_id, score: for every query the k items of largest cosine (ties to 12 digits: smaller id), within the class by if
    given, least at least. Exact, in double precision; see the module for what is skipped. Queries are told apart by their ids, and all vectors have one
    length. Null vectors and such with null or non-finite entries find nothing and are not found; a vector of zeros has cosine 0 with all.
    Both tables are read several times, so give them as tables. query_rows: queries that meet a block in one task, by their size if not given."""
    spark = queries.sparkSession
    n_items, dim = items.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    kinds = {"q": dict(queries.dtypes)[query_id], "i": dict(items.dtypes)[item_id]}
    named = lambda found: found.select(F.col("q").alias(query_id), F.col("i").alias(item_id), "score")
    if not n_items or (dim or 0) < 1:
        return named(spark.createDataFrame([], f"q {kinds['q']}, i {kinds['i']}, score double"))
    usable = items.where(F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))))
    drawn = usable.select(F.col(vec).alias("v"), F.xxhash64(item_id, F.lit(5)).alias("r"), item_id).orderBy("r", item_id).limit(SAMPLE).select("v").toPandas()["v"]
    most = min(CENTROIDS, CENTROID_NUMBERS // dim, int(n_items**0.5))
    sample = unit(np.stack(drawn.to_numpy())) if len(drawn) else np.ones((1, dim))
    centroids = choose_centroids(sample[np.isfinite(sample).all(1)], max(1, most)) if np.isfinite(sample).all(1).any() else np.ones((1, dim))
    q, it = packed(queries, query_id, "q", vec, by), packed(items, item_id, "i", vec, by, centroids)
    found = f"q {kinds['q']}, i {kinds['i']}, score double"
    if n_items * dim <= block_numbers:
        return named(_with_all(q, it, centroids, k, least, found))
    return named(_by_blocks(q, it, centroids, k, least, found, max(1, block_numbers // dim), query_rows or max(1, QUERY_NUMBERS // dim)))


def _hits(qs: pd.Series, block: Block, got: tuple) -> pd.DataFrame:
    row, at, v, _ = got
    return pd.DataFrame({"q": qs.to_numpy()[row], "i": block.ids[at], "score": v})


def _with_all(q: DataFrame, it: DataFrame, centroids: np.ndarray, k: int, least: float | None, schema: str) -> DataFrame:
    """Every query with the items of its class; these are BLOCK_NUMBERS numbers at most, all told, and go to every task."""
    dim = centroids.shape[1]
    held = it.toPandas()
    blocks = {c: Block(part["i"].to_numpy(), _rows(part["v"], dim), part["cell"].to_numpy(), centroids, k) for c, part in held.groupby("c")}
    hold = q.sparkSession.sparkContext.broadcast(blocks)
    if len(held) > SPREAD:  # queries may come as one file
        q = q.repartition(q.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, part in pdf.groupby("c"):
                if c in hold.value:
                    block = hold.value[c]
                    yield _hits(part["q"], block, block.search(unit(_rows(part["v"], dim)), k, least))

    return q.mapInPandas(run, schema)


def _by_blocks(q: DataFrame, it: DataFrame, centroids: np.ndarray, k: int, least: float | None, schema: str, block_rows: int, query_rows: int) -> DataFrame:
    dim, spark = centroids.shape[1], q.sparkSession
    hold = spark.sparkContext.broadcast(centroids)
    it = kept(it)
    kind_q, kind_c = dict(q.dtypes)["q"], dict(q.dtypes)["c"]

    # the plan: each class's cells, with the block that holds them; a cell of more than block_rows items is dealt into several
    def radius(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cosine = (unit(_rows(pdf["v"], dim)) * hold.value[pdf["cell"].to_numpy()]).sum(1)
            yield pdf[["c", "cell"]].assign(low=cosine - SLACK, n=1).groupby(["c", "cell"], as_index=False).agg(low=("low", "min"), n=("n", "sum"))

    cells = it.select("c", "cell", "v").mapInPandas(radius, f"c {kind_c}, cell int, low double, n bigint").groupBy("c", "cell").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    upto = F.sum(F.when(F.col("n") <= block_rows, F.col("n")).otherwise(0)).over(Window.partitionBy("c").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # CENTROIDS rows a class
    large = F.col("n") > block_rows
    cells = cells.withColumn("g", F.when(large, -1 - F.col("cell").cast("bigint")).otherwise(F.floor(F.coalesce(upto, F.lit(0)) / block_rows)))
    cells = kept(cells.withColumn("slices", F.when(large, F.ceil(F.col("n") / block_rows)).otherwise(1).cast("int")))
    parts = ("cell", "low", "n", "g", "slices")
    plans = cells.groupBy("c").agg(F.collect_list(F.struct(*parts)).alias("x"))
    plans = kept(plans.select("c", *[F.col("x").getField(p).alias(p) for p in parts]))
    send = F.broadcast if small(cells) else (lambda x: x)
    blocks = it.join(send(cells.select("c", "cell", "g", "slices")), ["c", "cell"]).withColumn("s", F.pmod(F.xxhash64("i", F.lit(7)), F.col("slices")).cast("int")).drop("slices")

    def routed(later: bool):
        """Adds the blocks to look into: those of the best cells until they hold k items, or the rest whose bound reaches the floor."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, part in pdf.groupby("c"):
                    plan = {p: np.asarray(part[p].iloc[0]) for p in parts}
                    bound = reach(unit(_rows(part["v"], dim)) @ hold.value[plan["cell"]].T, plan["low"])
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = plan["n"][order]
                    ok = np.zeros(bound.shape, bool)
                    np.put_along_axis(ok, order, np.cumsum(held, axis=1) - held < k, axis=1)
                    where = [[(int(g), s) for s in range(int(m))] for g, m in zip(plan["g"], plan["slices"], strict=True)]
                    if least is not None:
                        ok &= bound >= least
                    if later:
                        floor = part["floor"].to_numpy()
                        rest = bound >= floor[:, None]
                        go = [sorted({b for j in np.flatnonzero(r) for b in where[j]} - {b for j in np.flatnonzero(o) for b in where[j]}) for r, o in zip(rest, ok, strict=True)]
                    else:
                        go = [sorted({b for j in np.flatnonzero(o) for b in where[j]}) for o in ok]
                    yield pd.DataFrame({"q": part["q"], "c": part["c"], "v": part["v"], "floor": part["floor"], "go": [[{"g": g, "s": s} for g, s in b] for b in go]})

        return run

    def compare(qs: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(items):
            return pd.DataFrame({"q": qs["q"][:0], "i": items["i"][:0], "score": np.zeros(0)})
        block = Block(items["i"].to_numpy(), _rows(items["v"], dim), items["cell"].to_numpy(), hold.value, k)
        return _hits(qs["q"], block, block.search(unit(_rows(qs["v"], dim)), k, least, qs["floor"].to_numpy()))

    def looked(asked: DataFrame, later: bool) -> DataFrame:
        asked = asked.join(F.broadcast(plans) if small(plans, SENT // CENTROIDS) else plans, "c")
        gone = kept(asked.mapInPandas(routed(later), f"q {kind_q}, c {kind_c}, v binary, floor double, go array<struct<g:bigint,s:int>>"))
        counts = kept(gone.select("c", F.explode("go").alias("b")).select("c", "b.g", "b.s").groupBy("c", "g", "s").agg(F.count(F.lit(1)).alias("n")))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = min(query_rows, max(LEAST_QUERIES, -(-total // (TASKS * spark.sparkContext.defaultParallelism))))  # few blocks keep all cores busy too
        sizes = counts.select("c", "g", "s", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
        tasks = sizes.agg(F.coalesce(F.sum("parts"), F.lit(1))).first()[0]
        give = F.broadcast(sizes) if small(sizes) else sizes
        left = gone.select("q", "c", "v", "floor", F.explode("go").alias("b")).select("q", "c", "v", "floor", "b.g", "b.s").join(give, ["c", "g", "s"])
        left = left.withColumn("part", F.pmod(F.xxhash64("q", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
        right = blocks.join(give, ["c", "g", "s"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keys = ["c", "g", "s", "part"]
        left, right = (x.repartition(min(2 * tasks, MOST_TASKS), *keys) for x in (left, right))
        return kept(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema))

    asked = q.withColumn("floor", F.lit(float("-inf")))
    one = looked(asked, False)
    if cells.groupBy("c").agg(F.countDistinct("g").alias("blocks"), F.max("slices").alias("slices")).where("blocks > 1 or slices > 1").isEmpty():
        return _ranked(one, k)  # a block a class: all are seen
    reached = one.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "i"))).where(F.col("r") == k).select("q", F.col("score").alias("floor"))
    two = looked(q.join(reached, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), True)
    return _ranked(one.unionByName(two), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks."""
    return found.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "i"))).where(F.col("__r") <= k).drop("__r")
