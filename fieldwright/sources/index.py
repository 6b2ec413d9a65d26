"""An index of standards in versions: the classes that changed are written anew, then one manifest switches to them.

path/versions/N holds what version N wrote, a folder per class; path/manifest-N.json names every file of version N, those of
classes that have not changed since an earlier one included. A manifest appears by a rename, so readers see a whole version or the
one before; files that no manifest names are never read, and go with the next commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, sub: str = "") -> list[str]:
        at = self._at(f"{self.path}/{sub}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """The file appears whole, or not at all if there is one of that name."""
        own = self._at(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        to = self._at(f"{self.path}/{name}")
        if self.fs.exists(to) or not self.fs.rename(own, to):
            self.fs.delete(own, False)
            raise FileExistsError(f"{self.path}/{name}: another run has committed this version")

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(f"{self.path}/{name}"), True)


def _manifests(folder: Folder) -> list[int]:
    return sorted(int(n[9:-5]) for n in folder.names() if n.startswith("manifest-") and n.endswith(".json"))


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the newest version: version, classes and files. None if nothing has been committed."""
    folder = Folder(spark, path)
    versions = _manifests(folder)
    return json.loads(folder.read(f"manifest-{versions[-1]:08d}.json")) if versions else None


def read_index(spark: SparkSession, path: str, class_col: str = "std_type") -> DataFrame | None:
    """The rows of the newest version, or None."""
    found = current(spark, path)
    if not found:
        return None
    if not found["files"]:
        return spark.createDataFrame([], found["schema"])
    parts = None
    for version in sorted({f["version"] for f in found["files"]}):  # one read for each version that files are left of
        base = f"{path.rstrip('/')}/versions/{version}"
        df = spark.read.option("basePath", base).schema(found["schema"]).parquet(*[f"{base}/{f['name']}" for f in found["files"] if f["version"] == version])
        parts = df if parts is None else parts.unionByName(df)
    return parts.withColumn(class_col, F.col(class_col).cast("string"))


def write_version(rows: DataFrame, path: str, touched: list[str] | None = None, class_col: str = "std_type") -> int:
    """Commits a version in which the classes of touched hold just these rows, and others what they held; without touched, all classes.
    Returns its number. A run that dies before its commit leaves the version before as it is."""
    spark, folder = rows.sparkSession, Folder(rows.sparkSession, path)
    before = current(spark, path)
    number = before["version"] + 1 if before else 1
    place = f"versions/{number}"
    folder.remove(place)  # of a run that died before its commit
    rows.write.partitionBy(class_col).parquet(f"{folder.path}/{place}")
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    files = []
    for part in folder.names(place):
        if part.startswith(f"{class_col}="):
            cls = unescaped(part.split("=", 1)[1])
            files += [{"version": number, "class": cls, "name": f"{part}/{n}"} for n in folder.names(f"{place}/{part}") if n.endswith(".parquet")]
    if before and touched is not None:
        files += [f for f in before["files"] if f["class"] not in set(touched)]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    folder.write_new(f"manifest-{number:08d}.json", json.dumps({"version": number, "schema": schema, "files": files}, ensure_ascii=False))
    tidy(spark, path)
    return number


def tidy(spark: SparkSession, path: str) -> None:
    """Removes manifests and versions that the newest manifest does not need. Readers of an older version must have ended."""
    folder, found = Folder(spark, path), current(spark, path)
    if not found:
        return
    for n in _manifests(folder)[:-1]:
        folder.remove(f"manifest-{n:08d}.json")
    used: dict[str, set] = {}
    for f in found["files"]:
        used.setdefault(str(f["version"]), set()).add(f["name"].split("/")[0])
    for version in folder.names("versions"):
        if version not in used and int(version) <= found["version"]:
            folder.remove(f"versions/{version}")
        for part in folder.names(f"versions/{version}") if version in used else []:
            if "=" in part and part not in used[version]:
                folder.remove(f"versions/{version}/{part}")
