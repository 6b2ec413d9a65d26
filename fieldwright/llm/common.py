"""What the operators share: tables, the shared folder, row keys, and linking rows that share a key."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import gathered, join_one
from ..sources.tables import kept as cut
from ..sources.tables import shared_dir

#: Rows of a key that one task compares with each other; larger keys are cut into blocks of about this size.
BLOCK = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder as a packed table and read again: like cut, for what is large."""
    path = new_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables written to the shared folder for a job's own use: packed, and gone when the job says so."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        path = new_dir(self.spark, what)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        """Removes the folders; nothing may read them any more."""
        while self.paths:
            remove_dir(self.spark, self.paths.pop())
        tidy(self.spark)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucket_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, by modulus; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, max_docs: int, max_chars: int | None = None) -> DataFrame:
    """At most max_docs (text, y) rows to learn from: those of the lowest hash of the id, so the draw is the same on every run. Drawn are
    ids with a 0/1 label whose crc32(id as text) mod modulus is not 0, and that have a text (of max_chars characters at most, if given). Of
    rows that share an id the text of the lowest hash is taken, so that repeated ids give one row each. No other columns are used."""
    known = labels.where(F.col(target).isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max(target).cast("int").alias("y"))
    usable = docs.where((bucket_of("doc_id", modulus) != 0) & F.col("text").isNotNull()).select(F.col("doc_id").alias("__id"), "text")
    if max_chars is not None:
        usable = usable.where(F.length("text") <= max_chars)
    drawn = usable.select("__id").distinct().join(known, "__id").orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(max_docs)  # without the texts
    rows = usable.join(F.broadcast(drawn), "__id").select("__id", "y", F.struct(F.xxhash64("text").alias("h"), "text").alias("x"))  # max_docs ids
    return rows.groupBy("__id", "y").agg(F.min("x").alias("x")).select("x.text", "y")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """The rows of a sorted partition again, in frames that never split the rows of a key."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n < rows:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        start = int(np.argmax(last))
        if start:
            yield pdf.iloc[:start].reset_index(drop=True)
        held, n = [pdf.iloc[start:]], 0
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions at which a new key starts, and the length at the end."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def pairs_of_groups(starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions i < j within each group of 2 to most rows, without a loop over groups."""
    sizes = np.diff(starts)
    left, right = [], []
    for m in np.unique(sizes[(sizes > 1) & (sizes <= most)]):
        a, b = np.triu_indices(m, 1)
        base = starts[:-1][sizes == m][:, None]
        left.append((base + a).ravel())
        right.append((base + b).ravel())
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    return root


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links (id, smaller id) as keep what the links ids[a]-ids[b] connect connected."""
    used, flat = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
    root = roots(len(used), flat[: len(a)], flat[len(a):])
    own = root != np.arange(len(used))
    return used[own], used[root[own]]


def lightest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of as few links a-b as keep what all of them connect connected, the lightest first."""
    used, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, n = flat[: len(a)], flat[len(a):], len(used)
    root, taken, left = np.arange(n), np.zeros(0, np.int64), np.argsort(weight, kind="stable")
    while len(left := left[root[a[left]] != root[b[left]]]):
        first = np.full(n, len(left))  # of each part, its lightest link to another one
        for x in (a, b):
            np.minimum.at(first, root[x[left]], np.arange(len(left)))
        taken = np.concatenate([taken, left[np.unique(first[first < len(left)])]])
        root = roots(n, a[taken], b[taken])
    return taken


def shared_keys(keyed: DataFrame, keys: list[str], id_col: str, block: int = BLOCK) -> DataFrame:
    """The rows of keyed whose key more than one row has, laid out for comparison: rows of one (keys, bi, bj) stand
    together in a partition. A key of more than ``block`` rows is cut by a hash of the id into blocks, and each pair
    of blocks is a task's work of its own, so no task gets a hot key whole. ``b`` is the row's own block."""
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    rows = (
        keyed.join(counts, keys)
        .withColumn("__nb", blocks)
        .withColumn("b", F.pmod(F.xxhash64(id_col, F.lit(11)), F.col("__nb")).cast("int"))
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
        .withColumn("bi", F.least("b", "__o"))
        .withColumn("bj", F.greatest("b", "__o"))
        .drop("__n", "__nb", "__o")
    )
    at = [*keys, "bi", "bj"]
    return rows.repartition(*at).sortWithinPartitions(*at)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle and checkpoint files of tables that nothing holds any more: it does so when the driver's JVM has
    collected its garbage, which in a job of many rounds may come late."""
    gc.collect()
    spark._jvm.System.gc()


def settled(edges: DataFrame, n: int) -> bool:
    """Whether the n links (a, b) are stars already: every a has one b, and no b is linked further."""
    if not gathered(edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")), n).where("n > 1").isEmpty():
        return False
    return gathered(edges.join(gathered(edges.select(F.col("b").alias("a")).distinct(), n), "a", "left_semi"), n).isEmpty()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that links lead to.

    Large-star and small-star steps in turn: both are a minimum per node and a join. The minimum is pre-aggregated; the join of a node
    with very many neighbours is dealt over several tasks (join_one). Every round is written to the shared folder, and what the rounds
    before have left there goes.
    """
    def nearest(e: DataFrame, m: Column, n: int) -> DataFrame:
        return cut(gathered(e.groupBy("a").agg(m.alias("m"), F.count(F.lit(1)).alias("n")), n))

    def stars(e: DataFrame, n: int) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = nearest(both, F.least(F.min("b"), F.col("a")), n)
        large = join_one(both, low.select("a", "m"), "a", low.select("a", "n"), 2 * n, "b").where("b > a and b != m")
        large = cut(gathered(gathered(large.select(F.col("b").alias("a"), F.col("m").alias("b")), n).distinct(), n))
        low = nearest(large, F.min("b"), n)
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        joined = join_one(large, low.select("a", "m"), "a", low.select("a", "n"), n, "b").select(F.explode(pairs).alias("e"))
        return gathered(gathered(joined.select("e.a", "e.b").where("a != b"), n).distinct(), n)

    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        n = edges.count()
        edges = gathered(edges, n)
        if settled(edges, n):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = cut(stars(edges, n))
        tidy(links.sparkSession)
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def chunks(lengths: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to about most, one row at least."""
    start, n = 0, 0
    for i, m in enumerate(lengths):
        if n and n + m > most:
            yield start, i
            start, n = i, 0
        n += m
    if start < len(lengths):
        yield start, len(lengths)


def texts_in_chunks(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about most characters, one row at least: bounds what a numpy step holds at once."""
    yield from chunks([len(t) for t in texts], most)


def map_texts(docs: DataFrame, id_cols: list[str], f: Callable[[list[str]], dict], schema: str, text_col: str = "text") -> DataFrame:
    """id_cols and what f returns for each text. f: list of texts (null: empty) -> columns by name. Texts are whole;
    a call gets about two million characters, or one longer text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            for i, j in chunks([n or 0 for n in pc.utf8_length(column).to_pylist()]):
                made = {k: pa.array(v) for k, v in f([t or "" for t in column.slice(i, j - i).to_pylist()]).items()}
                ids = {c: batch.column(c).slice(i, j - i) for c in id_cols}  # as they are: null ids stay null
                yield pa.RecordBatch.from_pydict({**ids, **made})

    return docs.select(*id_cols, text_col).mapInArrow(run, schema)
