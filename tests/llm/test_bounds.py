"""Bounds of what is learned from, columns of any name, long runs without spaces, folders that go."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldwright.llm import common, decontam, pieces, quality, simhash, toxicity
from fieldwright.sources.tables import shared_dir

CLASH = "doc_id long, text string, lang string, y int, __bad_id string, __bad_h long, __id string, __h long, __text string, h long, x string, r int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", 5, "a", 7, "b", 8, "c", 9, "d", 1) for i, t in rows], CLASH)


def test_labelled_rows_are_bounded_by_ids_and_usable(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"text {i} {k % 3}") for i in range(400) for k in range(50)], "doc_id long, text string")
    drawn = common.labelled(docs, labels, "quality", 5, 20).collect()
    assert len(drawn) == 20 and sorted(drawn) == sorted(common.labelled(docs.repartition(7), labels, "quality", 5, 20).collect())
    long = docs.where("doc_id % 10 > 0").select("doc_id", F.repeat("text", 200).alias("text")).unionByName(docs.where("doc_id % 10 = 0"))
    some = common.labelled(long, labels, "toxic", 5, 20, 100).collect()  # few texts are short enough: all of the draw is among them
    assert len(some) == 20 and all(len(r.text) <= 100 for r in some)
    assert common.labelled(docs.limit(0), labels, "quality", 5, 20).count() == 0


def test_columns_of_any_name(spark, tmp_path):
    docs = clashing(spark, [(i, ("bad zzz " * 9 if i % 2 else f"good text here {i}") + (" one two three four five six seven eight nine ten" if i == 4 else "")) for i in range(60)])
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(3).alias("y"), F.lit("l").alias("text"))
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(0, 60, 2))
    assert toxicity.toxicity_scores(docs, labels).count() == 60
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 2)], "item_id long, text string, __id int")
    clean = decontam.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(60)) - {4}
    near = simhash.drop_near_copies(docs)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect() if r.doc_id % 2} == {1}


def test_near_copies_without_sketches_and_what_stays_in_the_folder(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(12)]
    texts = [" ".join("z" if rng.random() < rate else w for w in base[k % 12].split()) for k in range(60) for rate in [rng.choice([0, 0, 0.02, 0.05])]]
    docs = clashing(spark, list(enumerate(texts)))
    place = shared_dir(spark).removeprefix("file://")
    before = {n for n in os.listdir(place) if n.startswith("near-copies")}
    a = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    left = {n.rsplit("-", 1)[0] for n in os.listdir(place) if n.startswith("near-copies") and n not in before}
    assert left <= {"near-copies-verdict"}
    assert a == {r.doc_id for r in simhash.drop_near_copies(docs, errors=None).collect()} and 12 <= len(a) < 60
    assert simhash.apart(0.8, None) == 128 and simhash.apart(0.8, 6.0) == 33


def test_long_runs_without_spaces(monkeypatch):
    model, rng = pieces.PieceModel(pieces.default_model()), random.Random(3)
    known = [p.replace(pieces.SPACE, "") for p in model.pieces[300:20_000] if len(p) > 2]
    runs = ["".join(rng.choice(known) if rng.random() < 0.8 else rng.choice("漢字xé😀") for _ in range(rng.randrange(30, 120)))[:700] for _ in range(25)] + ["x" * 500, "漢" * 300, "aaaab" * 60]
    for size in (1 << 20, 150):
        monkeypatch.setattr(pieces, "RUN", size)
        assert all(model.segment_long(w).tolist() == model.segment([w])[0].tolist() for w in runs if len(w) > 64)
    monkeypatch.setattr(pieces, "RUN", 1 << 20)
    for text in ("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(350_000)), "x" * 200_000):
        began = time.time()
        assert model.decode(model.encode([text])[0]) == model.expected(text) and time.time() - began < 5


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_settled_links_are_stars(spark, n):
    links = spark.createDataFrame([(i + 10, i % 3) for i in range(n)], "a long, b long")
    got = {r.node: r.root for r in common.components(links).collect()}
    assert got == {i + 10: i % 3 for i in range(n)}
