"""Embedding whitening by polarised covariances.

Only squares are added up: of every centred dimension, and of the sum of every two of them. As
(a + b)^2 - a^2 - b^2 = 2ab, the differences of these variances are the cross-covariances. Vectors are whole numbers and are
centred by whole numbers beside the means, so that each sum is exact whatever its order; what the means lack to whole
numbers is settled exactly at the end. The matrix then goes to an eigen solver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, remove_dir

#: Entries of the pair sums that are held at once; entries up to this size have squares of pair sums that a block adds up in 64 bits.
CELLS, SMALL = 1 << 20, 1 << 20
#: Of the trace: eigenvalues up to this are rounding, and their components have no direction of their own.
NOTHING = 1e-13


def scaled_vector(vec: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of every entry; null for vectors that are null, hold null or non-finite entries, or such as do not
    fit into 53 bits when scaled."""
    v = vec.cast("array<double>")
    fits = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(2**53 / scale)), F.lit(False)))
    return F.when(v.isNotNull() & fits, F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint") + F.lit(offset).cast("bigint")))


def _vectors(batch: pa.RecordBatch, col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, vectors as rows) of a batch, by length."""
    v = batch.column(col)
    flat, sizes = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[ends[at][:, None] + np.arange(d)].reshape(len(at), int(d))


def square_sums(y: np.ndarray) -> np.ndarray:
    """For i <= j, row by row of the upper triangle: the sum of y_i^2 (i = j) or of (y_i + y_j)^2 over the rows of y, exactly."""
    d = y.shape[1]
    first = np.concatenate([[0], np.cumsum(np.arange(d, 0, -1))])
    out = np.zeros(first[-1], object if np.abs(y).max(initial=0) >= SMALL else np.int64)
    y = y.astype(out.dtype)
    for s in range(0, len(y), max(1, CELLS // max(d, 1))):
        part = y[s:s + max(1, CELLS // max(d, 1))]
        for i in range(d):
            pair = part[:, i:] + part[:, i:i + 1]
            pair[:, 0] = part[:, i]
            out[first[i]:first[i + 1]] += (pair * pair).sum(0)
    return out


def _added_up(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> dict[int, list[int]]:
    """By length d of the vectors (column x): the whole numbers that f makes of a block of rows, added up over all rows at any size. Each task
    gives one row a number, so the driver gets as many for each length as f makes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _vectors(batch, "x"):
                made, held = f(x), total.get(x.shape[1])
                if held is not None and held.dtype != object and int(np.abs(held).max(initial=0)) + int(np.abs(made).max(initial=0)) >= 2**62:
                    held = held.astype(object)
                total[x.shape[1]] = made if held is None else held + made
        for d, sums in total.items():
            high, low = ([int(g(int(v), 10**18)) for v in sums] for g in (int.__floordiv__, int.__mod__))  # two numbers: high * 10^18 + low
            yield pa.RecordBatch.from_pydict({"d": np.full(len(sums), d, np.int32), "k": np.arange(len(sums)), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})

    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out: dict[int, dict[int, int]] = {}
    for d, k, high, low in fit.select("x").mapInArrow(run, "d int, k bigint, high bigint, low bigint").groupBy("d", "k").agg(big("high"), big("low")).collect():
        out.setdefault(d, {})[k] = int(high) * 10**18 + int(low)
    return {d: [v for _, v in sorted(sums.items())] for d, sums in out.items()}


def plain_sums(x: np.ndarray) -> np.ndarray:
    """The number of rows, and their sum by dimension."""
    own = x if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object)
    return np.concatenate([[len(x)], own.sum(0)])


def covariance(sums: list[int], n: int, rest: list[int]) -> np.ndarray:
    """The covariance matrix (divisor n) from sums of squares of whole-number centred rows, whose entries add up to rest: each entry is
    an exact fraction, rounded once. n * (x - mean) = n * y - rest, so its squares add up to n * (n * sum of squares - rest^2)."""
    d = len(rest)
    first = [0]
    for i in range(d):
        first.append(first[-1] + d - i)
    out = np.zeros((d, d))
    own = [n * sums[first[i]] - rest[i] ** 2 for i in range(d)]
    for i in range(d):
        out[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            both = n * sums[first[i] + j - i] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = float(Fraction(both - own[i] - own[j], 2 * n * n))
    return out


def components_of(cov: np.ndarray, most: int) -> dict:
    """Unit eigenvectors by falling eigenvalue, the first most: as columns, with the number of all; the entry of largest size is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    e, v = np.maximum(values[order], 0), vectors[:, order]
    if v.size:
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    trace = float(np.trace(cov))
    real = e > NOTHING * trace
    return {"e": e, "v": v, "real": real, "explained": np.where(real, e, 0) / trace if trace > 0 else np.zeros(len(e))}


def fit_whitening(fit: DataFrame, most: int) -> dict[int, dict]:
    """By length of the vectors (distinct rows x): n, the sums S, the whole-number centres m, rest = S - n * m, and the components."""
    out: dict[int, dict] = {}
    for d, (n, *total) in _added_up(fit, plain_sums).items():
        centre = [s // n for s in total]
        out[d] = {"n": n, "S": total, "m": centre, "rest": [s - n * m for s, m in zip(total, centre, strict=True)]}
    hold = fit.sparkSession.sparkContext.broadcast({d: np.array(own["m"], np.int64) for d, own in out.items()})
    found = _added_up(fit, lambda x: square_sums(x - hold.value[x.shape[1]]))
    for d, own in out.items():
        own |= components_of(covariance(found[d], own["n"], own["rest"]), most)
    return out


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """(x - S/n) on each component over sqrt(e), in double precision; not a number for components without a direction."""
    y = (x - np.array(model["m"], np.int64)) - np.array(model["rest"], np.float64) / model["n"]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model["real"], (y @ model["v"]) / np.sqrt(model["e"]), np.nan)


def deviation(x: np.ndarray, model: dict) -> list[int]:
    """Of each row the sum over dimensions of (n*x - S)^2, exactly."""
    y, n = x - np.array(model["m"], np.int64), model["n"]
    small = n * (int(np.abs(y).max(initial=0)) + 1) < 2**31 / max(1, x.shape[1]) ** 0.5
    z = (y if small else y.astype(object)) * n - np.array(model["rest"], np.int64 if small else object)
    return [int(v) for v in (z * z).sum(1)]


def identity_error(fit: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """By length: the largest absolute entry of the covariance of the whitened vectors of the fit list less the identity, measured on them."""
    hold = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _vectors(batch, "x"):
                w = project(x, hold.value[x.shape[1]])
                w = np.hstack([np.ones((len(w), 1)), w])
                total[x.shape[1]] = total.get(x.shape[1], 0) + w.T @ w
        for d, sums in total.items():
            i, j = np.indices(sums.shape)
            yield pa.RecordBatch.from_pydict({"d": np.full(sums.size, d, np.int32), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "s": sums.ravel()})

    out = {}
    rows = fit.select("x").mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect()
    for d, model in models.items():
        sums = np.zeros((len(model["e"]) + 1,) * 2)
        for d2, i, j, s in rows:
            if d2 == d:
                sums[i, j] = s
        mean = sums[0, 1:] / model["n"]
        off = np.abs(sums[1:, 1:] / model["n"] - np.outer(mean, mean) - np.eye(len(mean)))
        out[d] = float(off[np.ix_(model["real"], model["real"])].max(initial=0.0))
    return out


def whitened_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> DataFrame:
    """One row for each vector and component (up to most): id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become whole numbers x = floor(64 * c) + 1000000. All statistics are over the distinct x vectors, n of them with sums S, divisor
    n: equal vectors count once. deviation is the sum of (n*x - S)^2, exact. whitened is x - S/n on the component over the root of its
    eigenvalue e; explained is e over the trace. identity_error is measured on the whitened fit list.

    Vectors that are null or hold null, non-finite or (scaled) over 53-bit entries give no rows; nor do empty ones, which have no dimension.
    A component without variance (a constant table, fewer vectors than components) has a null whitened, explained 0, and stays out of
    identity_error. Vectors of each length are a table of their own. Repeated rows and null ids give rows each, an empty table gives an
    empty result. Other columns are not used. The driver holds d * d numbers for each length d."""
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("id"), scaled_vector(F.col(vec_col)).alias("x")).where(F.size("x") > 0)
    path = new_dir(vectors.sparkSession, "whitening-fit")
    rows.select("x").distinct().write.option("compression", "zstd").parquet(path)
    fit = vectors.sparkSession.read.parquet(path)
    models = fit_whitening(fit, most)
    for d, error in identity_error(fit, models).items():
        models[d]["error"] = error
    remove_dir(vectors.sparkSession, path)  # the result needs the models only
    hold = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch, "x"):
                model = hold.value[x.shape[1]]
                k = len(model["e"])
                w = project(x, model).ravel()
                dev = np.repeat(np.array(deviation(x, model), object), k)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").take(pa.array(np.repeat(at, k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), "n": pa.array(np.full(len(w), model["n"], np.int64)),
                    "deviation": pa.array([str(v) for v in dev], pa.string()), "whitened": pa.array(w, mask=np.isnan(w)),
                    "explained": pa.array(np.tile(model["explained"], len(at))), "identity_error": pa.array(np.full(len(w), model["error"])),
                })

    made = rows.mapInArrow(run, f"id {kind}, component int, n bigint, deviation string, whitened double, explained double, identity_error double")
    return made.select(F.col("id").alias(id_col), "component", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")
