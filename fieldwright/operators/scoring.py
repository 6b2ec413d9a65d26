"""Model steps: request rows, a batch scorer of the user, results reconciled."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..sources.answers import Log, read_log, request_hash
from ..sources.tables import kept, number_rows
from .joins import join_one

OK, DUPLICATE, MISSING, FAILED = "ok", "duplicate", "missing", "failed"
#: What the reports say of a row without one result.
DUPLICATE_REASON, MISSING_REASON = "LLM 调用成功但同一 row_index 返回多条结果，需人工复核", "LLM 调用成功但返回结果中缺少该行，需人工复核"
CALL_FAILED, CALL_FAILED_REASON = "LLM判断失败", "LLM 调用失败（重试后仍失败）: "

#: Result columns of each scorer beside row_index.
RESULTS = {
    "meaning": "is_meaningful boolean, reasoning string",
    "enum_normalise": "has_codes boolean, needs_normalization boolean, normalized string, reasoning string",
    "class_check": "is_correct boolean, correct_type string, reasoning string",
    "antonym": "is_antonym boolean, reasoning string",
    "sample": "is_valid boolean, reasoning string",
    "selection": "selection string, selected_std_id string, selected_std_name string, reasoning string",
    "rename": "rewritten_field_name string, rewritten_business_meaning string, reasoning string",
    "numeric": "is_indicator boolean, reasoning string",
    "name": "normalized_name string, changed boolean, reasoning string",
    "definition": "business_meaning string, reasoning string",
    "merge": "merged_meaning string, changed boolean, reasoning string",
}


def batches(df: DataFrame, size: int, by: list[str] | None = None, order: str = "row_index") -> DataFrame:
    """df with batch: rows numbered by order, within by if given, so many to a batch."""
    return number_rows(df, order, "__b", by).withColumn("batch", F.floor((F.col("__b") - 1) / size).cast("long")).drop("__b")


class NotWorthRetrying(Exception):
    """Raised by a scorer where another try cannot help, as with a wrong key."""


#: Requests of a group that are given one copy of what they share.
SHARED_ROWS = 2000

#: Errors of an answer's form: tried again soon. All others wait longer each time.
MALFORMED = (ValueError, KeyError)


@dataclass
class Calls:
    """How a scorer is called: threads calls at a time within a task (in partitions tasks, if given), attempts tries a call, waits of pause
    seconds after a malformed answer and of pause * 2^n after other errors. log: a folder in which answers are kept by request, every so
    many calls, so that no run asks what another has been told; a scorer's answers there are those of one kind. module names the calls in
    the usage that has been noted (usage)."""

    threads: int = 1
    attempts: int = 1
    pause: float = 1.0
    partitions: int | None = None
    log: str | None = None
    every: int = 16
    module: str = "general"
    noted: list[DataFrame] = field(default_factory=list)

    def of(self, module: str) -> Calls:
        return replace(self, module=module)  # usage is noted in one list

    def usage(self) -> DataFrame | None:
        """The calls that the runs so far have made: module, label, cached_input, uncached_input, output (tokens), n_rows."""
        out = None
        for df in self.noted:
            out = df if out is None else out.unionByName(df)
        return out


def tried(call: Callable[[], pd.DataFrame], attempts: int, pause: float) -> pd.DataFrame:
    """What call returns; after an error that is worth it, it is called again."""
    for n in range(attempts):
        try:
            out = call()
            if out is None:
                raise ValueError("no answer")
            return out
        except NotWorthRetrying:
            raise
        except Exception as e:  # noqa: BLE001  any failure of the user's function
            if n == attempts - 1:
                raise
            time.sleep(pause if isinstance(e, MALFORMED) else pause * 2**n)
    raise AssertionError


def in_order(work: Iterator, f: Callable, threads: int) -> Iterator:
    """f of each item of work, in their order, with so many at a time."""
    if threads <= 1:
        yield from map(f, work)
        return
    with ThreadPoolExecutor(threads) as pool:
        running: deque = deque()
        try:
            for item in work:
                running.append(pool.submit(f, item))
                if len(running) >= 2 * threads:
                    yield running.popleft().result()
            while running:
                yield running.popleft().result()
        finally:
            for rest in running:
                rest.cancel()


def _tokens_of(part: pd.DataFrame, out: pd.DataFrame, large: str | None = None, known: dict | None = None) -> tuple[int, int, int]:
    """(cached input, other input, output) of a call: what the scorer says in out.attrs["usage"], or estimates from the texts. large: a column
    of objects that many calls share, whose lengths are kept in known."""
    said = tuple(int(x or 0) for x in out.attrs.get("usage") or (0, 0, 0))
    if any(said):
        return said
    length = lambda df: len(df.to_json(orient="records", force_ascii=False, default_handler=str))
    more = 0
    if large is not None:
        for v in part[large]:
            if id(v) not in known:
                known[id(v)] = length(pd.DataFrame({large: [v]})) - 3  # a comma in place of brackets and braces
            more += known[id(v)]
        part = part.drop(columns=large)
    return 0, max(1, (length(part) + more) // 2), max(1, length(out) // 2)


def run_scorer(
    requests: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], result: str, size: int = 10, concurrency: int | None = None,
    by: str | None = None, on_error: str = "raise", calls: Calls | None = None, usage: bool = False, shared: DataFrame | None = None,
) -> DataFrame:
    """row_index, the scorer's columns and call_failed (text, null if the call went well). scorer: request rows -> result rows, called with
    at most size rows of one partition, of one class if by names its column. concurrency: the number of tasks; calls: how they call
    (threads, tries, waits, log).

    on_error is the policy for a call that raises: "raise" lets the job fail; "mark" gives its rows with call_failed and no result;
    "missing" gives none of its rows, so that they are reconciled as missing. Failed calls are not logged. With usage, a row for each call
    without a row_index holds its usage (struct of cached_input, uncached_input, output, n_rows), which is null elsewhere.

    shared: a key that requests have too, and one column that the scorer gets in its place: large values that many requests have in common. A task
    gets each once, and its requests hold the same object; SHARED_ROWS requests at most are a group of their own."""
    if on_error not in ("raise", "mark", "missing"):
        raise ValueError(on_error)
    how, names = calls or Calls(), [c.split()[0] for c in result.split(", ")]
    attempts, pause, threads, kept_at, every = how.attempts, how.pause, how.threads, how.log, how.every  # tasks get these alone
    key, large = shared.columns if shared is not None else (None, None)
    lengths: dict = {}
    if how.log:
        if shared is None:
            requests = requests.withColumn("__request", request_hash(requests.columns))
        else:  # the key is a name of this run only
            hashed = requests.join(shared.select(key, request_hash([large]).alias("__large")), key)
            requests = hashed.select(*requests.columns, request_hash([*[c for c in requests.columns if c != key], "__large"]).alias("__request"))
        told = read_log(requests.sparkSession, how.log, result)
        if told is not None:
            told = kept(told.join(requests.select(F.col("__request").alias("request")).distinct(), "request", "left_semi"))
            requests = requests.join(told.select(F.col("request").alias("__request")).distinct(), "__request", "left_anti")
    asked = [large if shared is not None and c == key else c for c in requests.columns if c != "__request"]

    def call(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, tuple | None]:
        rows = part[asked]
        try:
            out = tried(lambda: scorer(rows), attempts, pause)
            return part, out[["row_index", *names]].assign(call_failed=None), _tokens_of(rows, out, large, lengths)
        except Exception as e:  # noqa: BLE001  any failure of the user's function is the policy's to judge
            if on_error == "raise":
                raise
            rows = part[["row_index"]] if on_error == "mark" else part[["row_index"]].iloc[:0]
            return part, rows.assign(**dict.fromkeys(names), call_failed=f"{type(e).__name__}: {e}"), None

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for group in [g for _, g in pdf.groupby(by, sort=False, dropna=False)] if by else [pdf]:
                for i in range(0, len(group), size):
                    yield group.iloc[i:i + size].reset_index(drop=True)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = Log(kept_at, every) if kept_at else None
        try:
            for part, out, spent in in_order(batches(it), call, threads):
                if log and spent is not None:
                    key = dict(zip(part["row_index"], part["__request"], strict=True))
                    name = uuid.uuid4().hex
                    rows = out.drop(columns="call_failed").astype(object).where(out.drop(columns="call_failed").notna(), None)
                    log.add([r | {"request": key[r["row_index"]], "call": name} for r in rows.to_dict("records") if r["row_index"] in key])
                if usage:
                    out = out.assign(usage=None)
                    if spent is not None:
                        line = dict(zip(("cached_input", "uncached_input", "output", "n_rows"), (*spent, len(part)), strict=True))
                        out = pd.concat([out.astype(object), pd.DataFrame([{c: None for c in out.columns} | {"usage": line}], dtype=object)], ignore_index=True)
                yield out
        finally:
            if log:
                log.flush()

    if shared is None and (concurrency or how.partitions):
        requests = requests.repartition(concurrency or how.partitions)
    schema = f"row_index bigint, {result}, call_failed string" + (f", usage {USAGE}" if usage else "")
    if shared is None:
        made = requests.mapInPandas(run, schema)
    else:
        def with_shared(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
            held = dict(zip(values[key], values[large], strict=True))
            lengths.clear()
            rows = rows[rows[key].isin(held.keys())].drop(columns=["__b", "__p"])
            rows = rows.assign(**{key: rows[key].map(held)}).rename(columns={key: large})
            got = [out for out in run(iter([rows])) if len(out)] if len(rows) else []
            empty = pd.DataFrame({c: pd.Series(dtype=object) for c in ["row_index", *names, "call_failed", *(["usage"] if usage else [])]})
            return pd.concat([out.astype(object) for out in got], ignore_index=True) if got else empty

        n = requests.count()
        bucket = F.pmod(F.xxhash64(key, F.lit(19)), F.lit(max(1, -(-n // SHARED_ROWS)))).alias("__b")
        sizes = kept(requests.select(bucket).groupBy("__b").agg(F.ceil(F.count(F.lit(1)) / SHARED_ROWS).cast("int").alias("__m")))
        left = requests.withColumn("__b", bucket).join(F.broadcast(sizes), "__b").withColumn("__p", F.pmod(F.xxhash64("row_index", F.lit(23)), F.col("__m")).cast("int")).drop("__m")
        right = shared.withColumn("__b", bucket).join(F.broadcast(sizes), "__b").withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__m") - 1))).drop("__m")
        tasks = concurrency or how.partitions or max(1, min(2 * sizes.agg(F.coalesce(F.sum("__m"), F.lit(1))).first()[0], 2000))
        left, right = left.repartition(tasks, "__b", "__p"), right.repartition(tasks, "__b", "__p")
        made = left.groupBy("__b", "__p").cogroup(right.groupBy("__b", "__p")).applyInPandas(with_shared, schema)
    if how.log and told is not None:
        more = told.select("row_index", *names, F.lit(None).cast("string").alias("call_failed"), *([F.lit(None).cast(USAGE).alias("usage")] if usage else []))
        made = more.unionByName(made)
    return made


USAGE = "struct<cached_input:bigint,uncached_input:bigint,output:bigint,n_rows:bigint>"


def reconcile(sent: DataFrame, results: DataFrame, order: str = "arrival", key: str = "row_index") -> DataFrame:
    """sent with the result columns and status: the last result of a row by order, ok if it came once, duplicate if more often,
    missing if not at all, failed if its call did (call_failed). Results nobody asked for are dropped."""
    cols = [c for c in results.columns if c not in (key, order)]
    last = results.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(*cols), F.col(order)).alias("__last"))
    joined = sent.join(last, key, "left")
    status = F.when(F.col("__n").isNull(), MISSING).when(F.col("__n") > 1, DUPLICATE)
    if "call_failed" in cols:
        status = F.when(F.col("__last.call_failed").isNotNull(), FAILED).otherwise(status.otherwise(OK))
    else:
        status = status.otherwise(OK)
    return joined.select(*sent.columns, *[F.col(f"__last.{c}").alias(c) for c in cols], status.alias("status"))


def json_request(rows: Column | None = None, order: str = "row_index", *cols: str) -> Column:
    """Aggregate: the JSON request of a batch, rows by order."""
    item = F.struct(order, *cols)
    return F.to_json(F.sort_array(F.collect_list(item)))


def hashing_embedder(dim: int = 256, prefix: str = "") -> Callable[[list[str]], np.ndarray]:
    """A stand-in for an embedding model: character 1- to 3-grams hashed with signs. Not the model that dictionaries in use were built
    with; any function of texts to rows of numbers takes its place."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            t = prefix + t
            for n in (1, 2, 3):
                for k in range(len(t) - n + 1):
                    h = zlib.crc32(t[k:k + n].encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def embed_texts(c: Column | str, embed: Callable[[list[str]], np.ndarray], batch: int = 32) -> Column:
    """array<float> of length 1 of each text. embed may carry the query instruction; document texts get none."""
    @F.pandas_udf(ArrayType(FloatType()))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            rows = []
            for i in range(0, len(texts), batch):
                v = np.asarray(embed([t or "" for t in texts.iloc[i:i + batch]]), np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                rows += list((v / np.where(size > 0, size, 1)).astype(np.float32))
            yield pd.Series(rows, index=texts.index)

    return run(c if isinstance(c, Column) else F.col(c))


def embed_distinct(df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray], out: str = "vector") -> DataFrame:
    """df with the vector of a text column; each distinct text is embedded once. A text that very many rows share is no task's alone."""
    texts = kept(df.groupBy(text_col).agg(F.count(F.lit(1)).alias("n")).where(F.coalesce(F.col(text_col), F.lit("")) != ""))
    vectors = texts.select(text_col, embed_texts(text_col, embed).alias(out))
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_one(df, vectors, text_col, texts, total, F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]), "left")
