"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order. Inverted lists, one a pivot, retrieve the vectors that
share at least ``shared`` of their ``nearest`` pivots; those are compared by cosine in double precision. A vector is posted only
to the lists that can be the lowest pivot it shares with another, ``nearest - shared + 1`` of them, and a pair is taken
in the list of its lowest shared pivot, so vectors travel that often and each pair counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest, group_starts, join_one, whole_groups

#: Rows of an inverted list that one task compares with each other or with as many others.
LIST_BLOCK = 16_384
#: Lists of more rows are split by their second shared pivot before vectors are compared.
SPLIT_ROWS = 1_024
#: Cosines held at once.
CELLS = 1 << 20
#: Hot lists that are broadcast at most (some 30 bytes each).
SENT_LISTS = 200_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n reference points of the sample, each as far as possible from those chosen before: copies of one vector,
    however many, give one pivot. Random directions fill up what a small sample lacks."""
    chosen = []
    if len(sample):
        chosen, near = [0], sample @ sample[0]
        while len(chosen) < n and near.min() < 0.999:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, sample @ sample[chosen[-1]])
    extra = np.random.default_rng(5).normal(size=(n - len(chosen), sample.shape[1]))
    return np.vstack([sample[chosen], extra / np.linalg.norm(extra, axis=1, keepdims=True)]) if len(extra) else sample[chosen]


class Pivots:
    """The pivots of each vector length. Lengths that the sample lacks have random directions, made where they are needed."""

    def __init__(self, sample: dict[int, np.ndarray], n: int):
        self.sample, self.n, self.made = sample, n, {}

    def of(self, length: int) -> np.ndarray:
        if length not in self.made:
            if len(self.made) > 64:
                self.made.clear()
            self.made[length] = choose_pivots(self.sample.get(length, np.zeros((0, length))), self.n)
        return self.made[length]

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """The numbers of the k nearest pivots of each row, ascending."""
        order = np.argsort(-(x @ self.of(x.shape[1]).T), axis=1, kind="stable")[:, :k]
        return np.sort(order, axis=1).astype("<u2")


def usable(vec: str) -> F.Column:
    """Not null, at least one component, every component a finite number, not all zero."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def pivot_count(rows: int) -> int:
    """64 pivots, and from 512,000 vectors on one for each 8,000, 512 at most: lists grow slower than the table. Of pairs at the bound
    itself 0.99 share two of their five nearest pivots with 64 pivots and 0.94 with 512, closer pairs more."""
    return min(max(64, rows // 8000), 512)


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93,
    pivots: int | None = None, nearest: int = 5, shared: int = 2, sample_rows: int = 4096,
) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Linked are vectors of equal, non-null label whose cosine is at least ``least``. n_links counts the other vectors
    linked directly, component_id is the smallest id that links reach, kept says that it is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without label or id, link with nothing.
    Vectors of any length are indexed; each meets only those of its own length. Equal vectors of a label are one class, named by a
    64-bit hash of both, compared once with their number as weight; rows that repeat an id with another vector stay rows of their own.
    An empty table gives an empty result. Pivots come from at most sample_rows vectors (lowest hashes of the id), pivot_count of them
    unless given; every vector is indexed. Other columns are not used.
    """
    kind = dict(vectors.dtypes)[vec_col]
    v = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("__id"), v.alias("v"), F.col(label_col).cast("string").alias("l"))
    counted = usable("v") & F.col("__id").isNotNull() & F.col("l").isNotNull()
    rows = rows.select("__id", "l", "v", F.when(counted, F.xxhash64("l", F.size("v"), "v")).alias("h"))
    good = rows.where("h is not null")
    slim = cut(rows.select("__id", "h"))
    classes = cut(slim.where("h is not null").groupBy("h").agg(F.min("__id").alias("low"), F.count(F.lit(1)).alias("w")))
    n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()

    drawn = good.select("v", F.xxhash64("__id", F.lit(1)).alias("r"), "__id").orderBy("r", "__id").limit(sample_rows).select("v").toPandas()["v"]
    by_length: dict[int, list] = {}
    for x in drawn:
        by_length.setdefault(len(x), []).append(x)
    index = Pivots({d: unit(np.array(xs)) for d, xs in by_length.items()}, pivots or pivot_count(n_classes))

    made = cut(_compare(good.select("l", "v", "h"), index, least, nearest, shared))
    counts = made.where("n > 0").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n"))
    tree = components(made.where("n = 0").select("a", "b")).select(F.col("node").alias("h"), "root")
    per = cut(classes.join(counts, "h", "left").join(tree, "h", "left").select("h", "low", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "h").alias("root")))
    lowest = per.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_one(per.select("h", "w", F.col("n").alias("links"), "root"), lowest.drop("n"), "root", lowest, n_classes, "h")
    linked = join_one(slim.where("h is not null"), named.select("h", "w", "links", "component_id"), "h", classes.select("h", F.col("w").alias("n")), n_rows, "__id")
    alone = slim.where("h is null").select("__id", F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"))
    out = linked.select("__id", (F.col("links") + F.col("w") - 1).alias("n_links"), "component_id").unionByName(alone)
    return out.select(F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("__id"), F.lit(True)).alias("kept"))


def _compare(good: DataFrame, index: Pivots, least: float, nearest: int, shared: int) -> DataFrame:
    """(a, b, n): n = 0 a link of a spanning forest; n > 0 the weight that a is linked with (b is a again)."""
    hold = good.sparkSession.sparkContext.broadcast(index)
    wide = dict(good.dtypes)["v"] == "array<float>"
    number, lists = np.dtype("<f4" if wide else "<f8"), nearest - shared + 1

    def described(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, vectors, ascending nearest pivots) of a batch, by length."""
        v = batch.column("v")
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
        sizes = np.diff(ends)
        for d in np.unique(sizes):
            for at in np.array_split(np.flatnonzero(sizes == d), max(1, (sizes == d).sum() // 4000)):
                x = flat[ends[at][:, None] + np.arange(d)].astype(number)
                near = hold.value.nearest(unit(x), nearest)
                yield at, x, np.hstack([near, np.full((len(near), max(0, nearest - near.shape[1])), 65535, "<u2")])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            for at, x, up in described(batch):
                _, first, w = np.unique(h[at], return_index=True, return_counts=True)  # copies in a batch travel once
                at, x, up = at[first], x[first], up[first]
                who = np.repeat(np.arange(len(at)), lists)
                rows = [r.tobytes() for r in x]
                marks = [r.tobytes() for r in up]
                yield pa.RecordBatch.from_pydict({
                    "l": batch.column("l").take(pa.array(at[who])), "d": pa.array(np.full(len(who), x.shape[1], np.int32)), "p": pa.array(up[:, :lists].ravel().astype(np.int32)),
                    "h": pa.array(h[at][who]), "w": pa.array(w[who].astype(np.int64)), "up": pa.array([marks[i] for i in who], pa.binary()), "v": pa.array([rows[i] for i in who], pa.binary()),
                })

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            labels = batch.column("l").to_numpy(zero_copy_only=False)
            for at, x, up in described(batch):
                key = pd.DataFrame({"l": np.repeat(labels[at], lists), "p": up[:, :lists].ravel()}).value_counts()
                for (label, p), n in key.items():
                    seen[label, x.shape[1], int(p)] = seen.get((label, x.shape[1], int(p)), 0) + int(n)
            if len(seen) > 100_000:
                yield rows_of(seen)
                seen.clear()
        yield rows_of(seen)

    def rows_of(seen: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "l": pa.array([k[0] for k in seen], pa.string()), "d": pa.array([k[1] for k in seen], pa.int32()), "p": pa.array([k[2] for k in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64()),
        })

    at = ["l", "d", "p", "bi", "bj"]
    hot = cut(
        good.select("l", "v").mapInArrow(count, "l string, d int, p int, n bigint").groupBy("l", "d", "p").agg(F.sum("n").alias("n"))
        .where(F.col("n") > LIST_BLOCK).select("l", "d", "p", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("nb"))
    )
    send = F.broadcast if hot.count() <= SENT_LISTS else (lambda x: x)
    posted = good.mapInArrow(post, "l string, d int, p int, h bigint, w bigint, up binary, v binary").join(send(hot), ["l", "d", "p"], "left")
    posted = posted.withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("h", F.lit(11)), F.col("nb")).cast("int"))
    dealt = posted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o", "nb")
    dealt = dealt.repartition(*at).sortWithinPartitions(*at)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, at, 4000):
            starts = group_starts(pdf, at)
            out_a, out_b, out_n = [], [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part = pdf.iloc[s:e]
                ids, first, back = np.unique(part["h"].to_numpy(), return_index=True, return_inverse=True)
                if len(ids) == 1:  # copies of one vector
                    continue
                w = np.bincount(back, part["w"].to_numpy(), len(ids)).astype(np.int64)
                x = unit(np.frombuffer(b"".join(part["v"].iloc[first]), number).reshape(len(ids), -1))
                up = np.frombuffer(b"".join(part["up"].iloc[first]), "<u2").reshape(len(ids), -1)
                block = part["b"].to_numpy()[first] if part["bi"].iloc[0] != part["bj"].iloc[0] else None
                total, here = np.zeros(len(ids), np.int64), np.arange(len(ids))
                tree = here[:0], here[:0]
                for i, j in linked_pairs(x, up, int(part["p"].iloc[0]), block, least, shared):
                    total += np.bincount(i, w[j], len(ids)).astype(np.int64) + np.bincount(j, w[i], len(ids)).astype(np.int64)
                    tree = forest(here, np.concatenate([tree[0], i]), np.concatenate([tree[1], j]))
                has = total > 0
                out_a += [ids[tree[0]], ids[has]]
                out_b += [ids[tree[1]], ids[has]]
                out_n += [np.zeros(len(tree[0]), np.int64), total[has]]
            if out_a:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "n": np.concatenate(out_n)})

    return dealt.mapInPandas(verify, "a bigint, b bigint, n bigint")


def linked_pairs(x: np.ndarray, up: np.ndarray, pivot: int, block: np.ndarray | None, least: float, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of a list's rows with the cosine, at least so many shared pivots and this one as their lowest. Rows of one block
    are left out if block is given. A long list is read as the shorter lists of the second pivot that a pair shares."""
    def pairs(at: np.ndarray, second: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, CELLS // len(at))
        for r in range(0, len(at), step):
            i, j = np.nonzero(x[at[r:r + step]] @ x[at[r:]].T >= least)
            i, j = at[i + r], at[j + r]
            ok = i < j if block is None else (i < j) & (block[i] != block[j])
            i, j = i[ok], j[ok]
            both = (up[i][:, :, None] == up[j][:, None, :]).any(2) & (up[i] != 65535)
            lowest = up[i, both.argmax(1)]
            ok = (both.sum(1) >= shared) & (lowest == pivot)
            if second is not None:
                both[np.arange(len(i)), both.argmax(1)] = False
                ok &= up[i, both.argmax(1)] == second
            if ok.any():
                yield i[ok], j[ok]

    if len(x) <= SPLIT_ROWS or shared < 2:
        yield from pairs(np.arange(len(x)), None)
        return
    row, col = np.nonzero((up > pivot) & (up != 65535))
    second = up[row, col]
    order = np.argsort(second, kind="stable")
    row, second = row[order], second[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(second)) + 1])
    for part, q in zip(np.split(row, starts[1:]), second[starts].tolist(), strict=True):
        if len(part) > 1:
            yield from pairs(part, q)
