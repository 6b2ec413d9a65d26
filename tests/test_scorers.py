"""Calls of scorers: tries, calls at a time, the log of answers, usage."""

import time

import pytest
from pyspark.sql import functions as F

from fieldwright.operators import report, scoring
from fieldwright.plans import jobs
from fieldwright.sources import answers

SAMPLE = scoring.RESULTS["sample"]


def sent(spark, n=40, parts=1):
    return spark.range(n).select(F.col("id").alias("row_index"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).coalesce(parts)


def test_a_call_is_tried_again_unless_that_cannot_help():
    seen = []

    def fails(times, error):
        def call():
            seen.append(time.monotonic())
            if len(seen) <= times:
                raise error
            return "fine"

        seen.clear()
        return call

    assert scoring.tried(fails(2, ConnectionError("busy")), 3, 0.05) == "fine"
    assert seen[1] - seen[0] >= 0.05 and seen[2] - seen[1] >= 0.1  # waits grow
    assert scoring.tried(fails(2, ValueError("no list")), 3, 0.05) == "fine" and seen[2] - seen[1] < 0.09  # a malformed answer is asked for again soon
    with pytest.raises(ConnectionError):
        scoring.tried(fails(3, ConnectionError("busy")), 3, 0)
    with pytest.raises(scoring.NotWorthRetrying):
        scoring.tried(fails(1, scoring.NotWorthRetrying("key")), 3, 0)
    assert len(seen) == 1


def test_four_calls_at_a_time_keep_their_order():
    at_once, most = [], []

    def work(n):
        at_once.append(n)
        most.append(len(at_once))
        time.sleep(0.02 if n % 3 else 0.06)
        at_once.remove(n)
        return n

    assert list(scoring.in_order(iter(range(30)), work, 4)) == list(range(30)) and max(most) == 4
    most.clear()
    assert list(scoring.in_order(iter(range(5)), work, 1)) == list(range(5)) and max(most) == 1


def test_a_scorer_that_fails_twice_then_answers(spark, tmp_path):
    count = tmp_path / "count"

    def score(pdf):
        with count.open("a") as f:
            f.write("x")
        if count.stat().st_size % 3:
            raise ConnectionError("busy")
        return pdf[["row_index"]].assign(is_valid=True, reasoning="r")

    rows = scoring.run_scorer(sent(spark, 20), score, SAMPLE, 10, calls=scoring.Calls(attempts=3, pause=0.01)).collect()
    assert len(rows) == 20 and count.stat().st_size == 6


def test_a_killed_run_and_the_next_ask_each_row_once(spark, tmp_path):
    """The first run dies half-way; what it was told stays, and is not asked again."""
    log, asked = f"{tmp_path}/log", tmp_path / "asked"

    def score(deadly):
        def f(pdf):
            if deadly and 20 in set(pdf["row_index"]):
                raise RuntimeError("killed")
            with asked.open("a") as out:
                out.writelines(f"{i}\n" for i in pdf["row_index"])
            return pdf[["row_index"]].assign(is_valid=pdf["row_index"] % 2 == 0, reasoning="é")

        return f

    calls = scoring.Calls(log=log, every=1)
    with pytest.raises(Exception, match="killed"):
        scoring.run_scorer(sent(spark), score(True), SAMPLE, 10, calls=calls).collect()
    assert asked.read_text().split() == [str(i) for i in range(20)]
    for again in (1, 2):
        got = scoring.run_scorer(sent(spark), score(False), SAMPLE, 10, calls=calls).collect()
        assert sorted((r.row_index, r.is_valid, r.reasoning) for r in got) == [(i, i % 2 == 0, "é") for i in range(40)], again
    assert sorted(map(int, asked.read_text().split())) == list(range(40))
    answers.compact(spark, log, SAMPLE)
    assert answers.read_log(spark, log, SAMPLE).count() == 40
    changed = sent(spark).withColumn("text", F.when(F.col("row_index") == 3, "another").otherwise(F.col("text")))
    assert scoring.run_scorer(changed, score(False), SAMPLE, 10, calls=calls).count() == 40
    assert asked.read_text().split()[40:] == ["3"]


def test_duplicates_in_the_log_are_still_duplicates(spark, tmp_path):
    def twice(pdf):
        return pdf[["row_index"]].assign(is_valid=True, reasoning="a")._append(pdf[["row_index"]].iloc[:1].assign(is_valid=False, reasoning="b"))

    calls = scoring.Calls(log=f"{tmp_path}/log")
    s = sent(spark, 10)
    for _ in range(2):
        got = scoring.reconcile(s, scoring.run_scorer(s, twice, SAMPLE, 10, calls=calls).withColumn("arrival", F.monotonically_increasing_id()))
        assert {r.row_index: r.status for r in got.collect()} == {i: "duplicate" if i == 0 else "ok" for i in range(10)}


def test_a_job_notes_what_its_calls_used(spark):
    entries = spark.createDataFrame([(i, f"名称{i}", "文本类", "否", "", "old") for i in range(12)], "row_index long, field_name string, field_type string, is_enum string, enum_values string, business_meaning string")

    def name(pdf):
        out = pdf[["row_index"]].assign(normalized_name="n", changed=True, reasoning="")
        out.attrs["usage"] = (100, 10, 7)
        return out

    def definition(pdf):  # says nothing of its usage: it is estimated
        return pdf[["row_index"]].assign(business_meaning="meaning", reasoning="")

    calls = scoring.Calls(threads=2)
    assert jobs.standard_maintenance(entries.coalesce(1), name, definition, None, calls=calls).count() == 12
    got = {(r.module, r.label): r for r in report.call_usage(calls.usage()).collect()}
    named = got["standard_maintenance", "name"]
    assert (named.n_calls, named.cached_input, named.uncached_input, named.output, named.tokens) == (3, 300, 30, 21, 351)
    other = got["standard_maintenance", "definition"]
    assert other.n_calls == 3 and other.cached_input == 0 and other.uncached_input > 12 and other.output > 12
    assert got[None, None].n_calls == 6 and got[None, None].tokens == named.tokens + other.tokens and calls.usage().agg(F.sum("n_rows")).first()[0] == 24
