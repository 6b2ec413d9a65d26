"""The pipeline's stages against brute force, on documents of the smallest tables and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from fieldwright.llm import pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row long, __id string, k1 string"
ITEM = "some words of an item that has ten words or more of them"
ODD = [
    (None, "null id", "en"), (None, "null id", "en"), (2**60 + 1, None, None), (3, "", "en"), (4, " \n\t", "en"), (5, "x" * 40_000, "en"), (6, "word " * 30_000, "en"), (7, "dup", "en"), (7, "dup", "en"), (8, "DUP", None),
    (9, "漢字 と \x00\x1c é́", "en"), (10, f"pre {ITEM} post", "en"), (None, f"{ITEM}", "en"), (11, "mail a.b@c.de, 4111 1111 1111 1111 or 10.0.0.1", "en"),
]


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def near_copy_survivors(rows):
    """(id, text) rows that stay: one of each group, the smallest id."""
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else None for _, t in rows]
    live = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k] is not None]
    group = {k: k for k in live}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for n, a in enumerate(live):
        for b in live[:n]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    best = {}
    for k in live:
        r = find(k)
        if r not in best or rows[k][0] < rows[best[r]][0]:
            best[r] = k
    stay = set(best.values())
    return [rows[k] for k in range(len(rows)) if k not in group or k in stay]


def leaks(text, items):
    low = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    line = f" {' '.join(low(text))} "
    return any(f" {' '.join(w[k:k + n])} " in line for w in map(low, items) for n in [min(10, len(w))] if n for k in range(len(w) - n + 1))


def masked(text, field):
    if text is None:
        return None
    _, spans = pii.all_spans(field, [text])[0]
    out, done = "", 0
    for s, e, kind in sorted((s, e, k) for k, own in zip(pii.KINDS, spans) for s, e in own):
        if s >= done:
            out += text[done:s] + f"<{kind}>"
        done = max(done, e)
    return out + text[done:]


@pytest.fixture(scope="module")
def field():
    return pii.train_field(pii.labelled_table())


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_stages_equal_brute_force(spark, sf, field, tmp_path, which):
    if which == "documents":
        d, docs = sf, spark.read.parquet(f"{sf}/documents.parquet")
    else:
        d = str(tmp_path)
        docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), k, "clash", "clash") for k, (i, t, g) in enumerate(ODD)], DOCS)
        spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=key)

    near = STAGES["near_copies"](spark, docs, d)
    assert near.columns == docs.columns
    want = near_copy_survivors(rows)
    assert pairs(near) == sorted(want, key=key) and len(want) < len(rows)

    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = STAGES["benchmark"](spark, docs, d)
    assert clean.columns == docs.columns
    want = [r for r in rows if not leaks(r[1], items)]
    assert pairs(clean) == sorted(want, key=key) and len(want) < len(rows)

    hidden = STAGES["personal_data"](spark, docs, d)
    want = [(i, masked(t, field)) for i, t in rows]
    assert hidden.columns == docs.columns and pairs(hidden) == sorted(want, key=key) and want != rows
    assert hidden.where("n_chars != length(text)").count() == 0

    coded = STAGES["pieces"](spark, docs, d)
    assert coded.count() == len(rows) and coded.where("not round_trip or n_pieces != size(ids)").count() == 0


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], DOCS)
    for stage in STAGES.values():
        assert stage(spark, docs, str(tmp_path)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_low_quality_rows_go_and_odd_ones_stay_by_score(spark, tmp_path):
    """Without labels all texts have one score, that of no evidence, and stay; with them just the rows under the bound go."""
    docs = spark.createDataFrame([(i, t, g, "s", 0, k, "c", "c") for k, (i, t, g) in enumerate(ODD)], DOCS)
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/labels.parquet")
    assert STAGES["quality"](spark, docs, str(tmp_path)).exceptAll(docs).count() == 0
    assert STAGES["quality"](spark, docs, str(tmp_path)).count() == len(ODD)
    bad = spark.createDataFrame([(i, "bad zzz " * 9 if i % 2 else "good text here", "en", "s", 0, i, "c", "c") for i in range(60)], DOCS)
    (tmp_path / "two").mkdir()
    bad.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/two/labels.parquet")
    assert {r.doc_id for r in STAGES["quality"](spark, bad, f"{tmp_path}/two").collect()} == set(range(0, 60, 2))


def test_the_whole_run(spark, sf):
    """What is left after all stages: rows of a score of 0.3 or more, one of each group of near copies among them, less those with a window of an item."""
    from fieldwright.llm import quality

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    good = sorted((r.doc_id, docs[r.doc_id]) for r in scores if r.score >= 0.3)
    single = near_copy_survivors(good)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(i for i, t in single if not leaks(t, items))
    assert len(docs) > len(good) > len(single) > len(want) > 0
    out = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == want and out.where("not round_trip").count() == 0
