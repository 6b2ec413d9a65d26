"""The index in versions: changes of class, deletions, crashes, and what is embedded."""

import numpy as np
import pytest

from fieldwright.functions.vocab import NON_ENUM
from fieldwright.operators import dictionary as dic
from fieldwright.operators import scoring
from fieldwright.plans import build, jobs
from fieldwright.sources import index

DICT = "std_id string, std_name string, definition string, std_type string, pos long"
A, B, C = NON_ENUM[:3]


def dictionary(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DICT)


@pytest.fixture
def counted(tmp_path):
    """An embedder that notes each text it gets."""
    log = tmp_path / "asked"

    def embed(texts):
        with log.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        return np.array([[len(t), sum(map(ord, t)) % 97, ord(t[0]) % 31, 1.0] for t in texts])

    def asked():
        out = log.read_text().split("\n")[:-1] if log.exists() else []
        log.unlink(missing_ok=True)
        return sorted(out)

    return embed, asked


FIRST = [("1", "one", "first", A), ("2", "two", "second", A), ("3", "three", "first", B), ("3", "three!", "third", B), ("4", "four", "", A), ("5", "five", "fifth", "代码枚举类"), ("6", "two", "sixth", C)]
SECOND = [("1", "one", "first", B), ("2", "two", "second, again", A), ("3", "three!", "third", B), ("7", "seven", "second", B)]  # 1 changes class, 2 its text, 6 goes and with it class C


def counts(df):
    return {(r.std_type, r.state): r.n for r in df.collect()}


def test_builds_embed_what_is_new_and_keep_one_row_an_id(spark, tmp_path, counted):
    embed, asked = counted
    path = f"{tmp_path}/index"
    assert index.read_index(spark, path) is None
    assert counts(build.index_build(dictionary(spark, FIRST), path, embed)) == {(A, "added"): 2, (B, "added"): 1, (C, "added"): 1}
    assert asked() == sorted({"one", "two", "three!", "first", "second", "third", "sixth"})
    rows = {r.std_id: (r.std_type, r.name_text, r.since) for r in index.read_index(spark, path).collect()}
    assert rows == {"1": (A, "one", 1), "2": (A, "two", 1), "3": (B, "three!", 1), "6": (C, "two", 1)}
    assert all(r.ok for r in build.self_check(index.read_index(spark, path)).collect())

    assert counts(build.index_build(dictionary(spark, SECOND), path, embed)) == {(B, "changed"): 1, (A, "changed"): 1, (B, "kept"): 1, (B, "added"): 1, (C, "removed"): 1}
    assert asked() == ["second, again", "seven"]
    found = index.read_index(spark, path)
    assert {r.std_id: (r.std_type, r.meaning_text, r.since) for r in found.collect()} == {"1": (B, "first", 2), "2": (A, "second, again", 2), "3": (B, "third", 1), "7": (B, "second", 2)}
    assert all(len(r.name_vector) == 4 and abs(sum(x * x for x in r.meaning_vector) - 1) < 1e-5 for r in found.collect()) and found.count() == 4

    assert set(counts(build.index_build(dictionary(spark, SECOND), path, embed))) == {(A, "kept"), (B, "kept")}
    assert asked() == [] and index.current(spark, path)["version"] == 2
    build.index_build(dictionary(spark, [*SECOND, ("8", "eight", "second", A)]), path, embed)  # class B is not written again
    now = index.current(spark, path)
    assert {(f["class"], f["version"]) for f in now["files"]} == {(A, 3), (B, 2)} and index.read_index(spark, path).count() == 5 and asked() == ["eight"]
    build.index_build(dictionary(spark, []), path, embed)
    assert index.read_index(spark, path).count() == 0


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, tmp_path, counted, monkeypatch):
    embed, _ = counted
    path = f"{tmp_path}/index"
    build.index_build(dictionary(spark, FIRST), path, embed)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(index.Folder, "write_new", dies)
        with pytest.raises(OSError, match="gone"):
            build.index_build(dictionary(spark, SECOND), path, embed)
    assert {r.std_id for r in index.read_index(spark, path).collect()} == {"1", "2", "3", "6"} and index.current(spark, path)["version"] == 1
    build.index_build(dictionary(spark, SECOND), path, embed)
    assert {r.std_id for r in index.read_index(spark, path).collect()} == {"1", "2", "3", "7"}
    with pytest.raises(FileExistsError):
        index.Folder(spark, path).write_new("manifest-00000002.json", "{}")


def test_mapping_with_a_built_index_equals_mapping_without(spark, sf, tmp_path):
    from fieldwright.queries.derive import dictionary as derived
    from fieldwright.queries.derive import sheet

    embed = scoring.hashing_embedder(64)
    path = f"{tmp_path}/index"
    build.index_build(derived(spark, sf), path, embed)
    fields = sheet(spark, sf).where("row_index < 40")
    plain = jobs.standard_mapping(fields, derived(spark, sf), embed, k=5)
    built = jobs.standard_mapping(fields, derived(spark, sf), embed, k=5, index=index.read_index(spark, path))
    cols = ["row_index", "mapping_result", "candidates"]
    assert sorted(map(tuple, built.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect())) and dic.index_records(derived(spark, sf)).count() > 0


def test_a_text_that_most_rows_share_is_embedded_once(spark):
    df = spark.range(120_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('t', id % 50) END AS t")
    out = scoring.embed_distinct(df, "t", scoring.hashing_embedder(8))
    assert out.count() == 120_000 and out.where("t is null and vector is not null or t is not null and vector is null").count() == 0
