"""A durable log of answers: kept as they come, by a hash of the request, so that a lost task or a new run asks only what is lacking."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .index import Folder


def request_hash(cols: list[str]) -> Column:
    """What a request is known by: all its columns, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(cols)]), {"ignoreNullFields": "false"}), 256)


class Log:
    """What a task writes to the log: a file of JSON lines for some calls, whole or not at all."""

    def __init__(self, path: str, every: int = 16):
        self.path, self.every, self.rows, self.calls = path.rstrip("/"), every, [], 0

    def add(self, rows: list[dict]) -> None:
        at = time.time_ns()
        self.rows += [r | {"at": at} for r in rows]
        self.calls += 1
        if self.calls >= self.every:
            self.flush()

    def flush(self) -> None:
        from pyarrow import fs

        if self.rows:
            store, root = fs.FileSystem.from_uri(self.path)
            store.create_dir(root, recursive=True)
            name = f"{root}/answers-{uuid.uuid4().hex}.json"
            with store.open_output_stream(f"{root}/.{name.rsplit('/', 1)[1]}") as out:
                out.write("".join(json.dumps(r, ensure_ascii=False, default=_plain) + "\n" for r in self.rows).encode())
            store.move(f"{root}/.{name.rsplit('/', 1)[1]}", name)
        self.rows, self.calls = [], 0


def _plain(x):
    return x.item() if hasattr(x, "item") else str(x)


def read_log(spark: SparkSession, path: str, result: str) -> DataFrame | None:
    """request, row_index, the result columns and at: the last answer to each request, or None without a log. Two answers of one call to a
    row are both kept, so that they are still told apart as duplicates."""
    names = [n for n in Folder(spark, path).names() if n.startswith("answers-")]
    if not names:
        return None
    rows = spark.read.schema(f"request string, call string, row_index bigint, {result}, at bigint").json([f"{path.rstrip('/')}/{n}" for n in names])
    last = F.max(F.struct("at", "call")).over(Window.partitionBy("request"))
    return rows.withColumn("__last", last).where((F.col("__last.call") == F.col("call")) & (F.col("__last.at") == F.col("at"))).drop("__last", "call")


def compact(spark: SparkSession, path: str, result: str) -> None:
    """One answer a request in few files: the log's last answers are written anew, then the files that they are from go. A run that dies in
    between leaves answers twice, of which the last still counts."""
    folder = Folder(spark, path)
    old = [n for n in folder.names() if n.startswith("answers-")]
    found = read_log(spark, path, result)
    if found is None or len(old) < 2:
        return
    place = f"compact-{uuid.uuid4().hex}"
    found.withColumn("call", F.lit(place)).write.option("ignoreNullFields", "false").json(f"{folder.path}/{place}")
    for n in folder.names(place):
        if n.endswith(".json"):
            folder.fs.rename(folder._at(f"{folder.path}/{place}/{n}"), folder._at(f"{folder.path}/answers-{uuid.uuid4().hex}.json"))
    for n in [place, *old]:
        folder.remove(n)
