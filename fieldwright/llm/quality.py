"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by their class log-count ratios; a linear hinge-loss model is fitted to them by
dual coordinate descent. n-grams are those of characters (1 to 3, as they stand), of character kinds (5: lower, upper, digit,
white space, other marks as they stand) and of words, of which it counts whether they repeat the words before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, labelled, map_texts

BITS = 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds() -> np.ndarray:
    """Per code point below 65,536: 1 lower, 2 upper, 3 digit, 4 white space, else 16 + the code point."""
    out = np.arange(16, 16 + 65536, dtype=np.uint64)
    for c in range(65536):
        s = chr(c)
        if s.isspace():
            out[c] = 4
        elif s.isdigit():
            out[c] = 3
        elif s.isupper():
            out[c] = 2
        elif s.isalpha():
            out[c] = 1
    return out


_KINDS: list[np.ndarray] = []


def repeats(longest: int) -> list[int]:
    """Lengths of runs that are told apart, up to the longest: 1 to 16, then powers of two without an end."""
    return list(range(1, min(longest, 16) + 1)) + [1 << k for k in range(5, longest.bit_length())]


def features(text: str) -> np.ndarray:
    """Sorted hashed n-gram indicators (each of 2^18 once) of the whole text."""
    if not _KINDS:
        _KINDS.append(_kinds())
    on = np.zeros(1 << BITS, bool)
    u = code_points(text)
    for s in range(0, len(u), 1 << 20):  # blocks overlap by the longest n-gram
        part = u[max(0, s - 4):s + (1 << 20)]
        h = part.astype(np.uint64) + np.uint64(1)
        on[(h * _M1) >> _SHIFT] = True
        two = h[:-1] * _M2 ^ h[1:] * _M1
        on[(two * _M3) >> _SHIFT] = True
        three = two[:-1] * _M3 + h[2:]
        on[(three * _M1) >> _SHIFT] = True
        k = _KINDS[0][np.minimum(part, 65535)]
        if len(k) >= 5:
            five = k[:-4]
            for i in range(1, 5):
                five = five * _M2 + k[i:len(k) - 4 + i]
            on[(five * _M3) >> _SHIFT] = True
    words = np.fromiter((hash(w) for w in text.split()), np.int64)  # compared within this text only
    same = words[1:] == words[:-1]
    run = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    longest = int((run[1::2] - run[::2]).max()) if len(run) else 0
    for n in repeats(longest):  # word n-grams of one word n + 1 times
        on[(n * 7919 + 13) % (1 << BITS)] = True
    return np.flatnonzero(on).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Of each indicator: the logarithm of its smoothed share of the rows of class 1 over that of class 0."""
    pos, neg = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for x, label in zip(rows, y, strict=True):
        (pos if label else neg)[x] += 1
    return np.log((pos / ((y == 1).sum() + 2 * smooth)) / (neg / ((y == 0).sum() + 2 * smooth)))


def scaled(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return ratio[x] / np.sqrt(len(x) + 1)


def coordinate_descent(values: list[np.ndarray], rows: list[np.ndarray], sign: np.ndarray, most: np.ndarray, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, intercept and dual variables of the linear hinge-loss model; each of these is between 0 and most."""
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    norm = [float((v * v).sum()) + 1 for v in values]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            v, x = values[i], rows[i]
            g = sign[i] * (float(w[x] @ v) + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                b += step
                alpha[i] = new
    return w, b, alpha


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 20, cost: float = 1.0, smooth: float = 1.0) -> dict:
    """weights (over the indicators, log-count ratios included), and slope and offset of the score."""
    y = np.asarray(y)
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return {"w": np.zeros(1 << BITS, np.float32), "b": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    ratio = log_count_ratios(rows, y, smooth)
    rng = np.random.default_rng(8)
    fold = rng.integers(0, 5, len(y))

    def train(keep: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in keep]
        most = np.where(y[keep] == 1, 0.5 / max(1, (y[keep] == 1).sum()), 0.5 / max(1, (y[keep] == 0).sum())) * len(keep) * cost
        w, b, _ = coordinate_descent([scaled(x, ratio) for x in own], own, np.where(y[keep] == 1, 1.0, -1.0), most, epochs, rng)
        return w * ratio, b

    def margin(model: tuple, x: np.ndarray) -> float:
        return float(model[0][x].sum() / np.sqrt(len(x) + 1) + model[1])

    # the score's slope and offset: logistic regression on the margins of rows left out
    everyone = np.arange(len(y))
    left = everyone[fold == 0]
    if len(set(y[left])) < 2 or len(set(y[fold != 0])) < 2:  # too few rows to leave any out
        left, partial = everyone, train(everyone)
    else:
        partial = train(everyone[fold != 0])
    m = np.array([margin(partial, rows[i]) for i in left])
    t = y[left].astype(float)
    slope, offset = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30)))
        g = np.array([((p - t) * m).mean() + 1e-3 * slope, (p - t).mean()])
        r = p * (1 - p)
        hess = np.array([[(r * m * m).mean() + 1e-3, (r * m).mean()], [(r * m).mean(), r.mean() + 1e-6]])
        d = np.linalg.solve(hess, g)
        slope, offset = slope - d[0], offset - d[1]
        if np.abs(d).max() < 1e-8:
            break
    w, b = train(everyone)
    return {"w": w.astype(np.float32), "b": b, "slope": float(slope), "offset": float(offset)}


def score(model: dict, text: str) -> float:
    x = features(text)
    z = model["slope"] * (float(model["w"][x].sum(dtype=np.float64)) / np.sqrt(len(x) + 1) + model["b"]) + model["offset"]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 5000) -> dict:
    """Fits on at most max_docs labelled rows, one an id, drawn by a hash of the id from all with crc32(id) mod 5 not 0."""
    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t).tobytes() for t in pdf["text"]], "y": pdf["y"]})

    drawn = labelled(docs, labels, "quality", 5, max_docs).mapInPandas(featurise, "x binary, y int").toPandas()
    return fit([np.frombuffer(x, np.int32) for x in drawn["x"]], drawn["y"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 5000, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: good likelier), predicted (1 from threshold on).

    A null text scores as the empty one, which has no n-gram: its score is that of the intercept. Texts of any length are read whole.
    Without usable labels, or with labels of one class only, every text gets the smoothed share of good ones. Conflicting labels of a
    document count as good. Repeated rows give a row each, an empty table an empty result. Other columns are not used.
    """
    hold = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, max_docs))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", score double"
    scored = map_texts(docs, list(id_cols), lambda texts: {"score": [score(hold.value, t) for t in texts]}, schema)
    return scored.select(*id_cols, (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 5000) -> DataFrame:
    """The rows of docs that the classifier accepts, as they are: repeated rows, rows without id and columns of any name too. Null and empty
    texts have the intercept's score and go if that is under the threshold; without usable labels, or with those of one class only,
    all texts have the smoothed share of good ones. Texts are scored whole where they stand, without a shuffle."""
    hold = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, max_docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [score(hold.value, t or "") >= threshold for t in (x.as_py() for x in batch.column("text"))]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
