"""Jobs that are cut off and taken up again, tables published together, and keyword rules by the thousand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import service
from larder.sources.jobs import Jobs
from larder.sources.manifest import Conflict, Published

DDL = "sku string, status string, error string, total double"


def fitter():
    def fit(key, rows):
        if key[0] == "bad":
            raise ValueError("no good")
        return pd.DataFrame([{"total": float(rows["v"].sum())}])

    return fit


def states(jobs):
    return {r.sku: (r.status, r.version) for r in jobs.latest().collect()}


def test_cut_off_and_resumed(spark, tmp_path):
    jobs = Jobs(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(s, float(i)) for s in ("a", "b", "c", "bad") for i in range(4)], "sku string, v double")
    jobs.submit("j", rows.select("sku"))
    assert states(jobs) == {s: ("queued", 0) for s in ("a", "b", "c", "bad")} and jobs.summary().first().state == "queued"

    def killed(key, rows):
        raise SystemExit("the worker is gone")

    with pytest.raises(Exception):
        jobs.run("j", rows, killed, ["total"], DDL, attempt="one")
    assert {v for v in states(jobs).values()} == {("running", 1)} and jobs.summary().first().state == "running"
    jobs.resume("j", ["one"])
    jobs.submit("j", rows.select("sku").union(spark.createDataFrame([("late",)], "sku string")))  # what is there stays
    assert states(jobs) == {**{s: ("queued", 2) for s in ("a", "b", "c", "bad")}, "late": ("queued", 0)}
    two = jobs.run("j", rows, fitter(), ["total"], DDL)
    assert states(jobs) == {**{s: ("done", 4) for s in "abc"}, "bad": ("failed", 4), "late": ("failed", 2)}
    assert {r.sku: r.note for r in jobs.latest().where("status = 'failed'").collect()} == {"bad": "ValueError: no good", "late": "no rows"}
    assert sorted((r.sku, r.total, r.attempt) for r in jobs.results("j", DDL).collect()) == [(s, 6.0, two) for s in "abc"]
    s = jobs.summary().first()
    assert (s.state, s.done, s.failed, s.running, s.queued) == ("done", 3, 2, 0, 0)
    jobs.run("j", rows, fitter(), ["total"], DDL)  # nothing waits: nothing changes
    assert jobs.results("j", DDL).count() == 3 and states(jobs)["a"] == ("done", 4)


def test_two_workers_and_one_product(spark, tmp_path):
    jobs = Jobs(spark, f"file://{tmp_path}")
    jobs.submit("j", spark.createDataFrame([("a",), ("b",)], "sku string"))
    number, entries = jobs._read()  # what the second worker read
    first = jobs.advance("j", "running", "m", spark.createDataFrame([("a",)], "sku string"))
    assert [r.sku for r in first.collect()] == ["a"]
    with pytest.raises(Conflict):
        jobs._commit(number, "whatever")
    read, seen = jobs._read, []

    def late():
        seen.append(1)
        return (number, entries) if len(seen) == 1 else read()

    jobs._read = late  # its first write comes too late, and is made anew of what there is
    assert [r.sku for r in jobs.advance("j", "running", "z").collect()] == ["b"] and len(seen) > 2
    assert {(r.sku, r.attempt, r.version) for r in jobs.latest().collect()} == {("a", "m", 1), ("b", "z", 1)}
    assert jobs.advance("j", "done", "z", spark.createDataFrame([("a",)], "sku string")).count() == 0 and [r.sku for r in jobs.advance("j", "done", "m").collect()] == ["a"]


def test_all_tables_or_none(spark, tmp_path):
    out = Published(spark, f"file://{tmp_path}")
    with pytest.raises(FileNotFoundError):
        out.read()
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert out.commit(out.stage(a=one(1), b=one(1)), 0) == 1
    held = out.read()
    staged = out.stage(a=one(2), b=one(2))
    assert {k: t.first().v for k, t in out.read().items()} == {"a": 1, "b": 1}
    assert out.commit(staged, 1) == 2 and {k: t.first().v for k, t in out.read().items()} == {"a": 2, "b": 2}
    with pytest.raises(Conflict):
        out.commit(out.stage(a=one(9)), 1)  # read before the second was published
    assert out.commit(out.stage(b=one(3)), 2) == 3 and {k: t.first().v for k, t in out.read().items()} == {"a": 2, "b": 3}
    assert {k: t.first().v for k, t in held.items()} == {"a": 1, "b": 1}
    assert out.vacuum(keep=1, lease_seconds=3600) == 0 and held["a"].first().v == 1
    assert out.vacuum(keep=1, lease_seconds=0) == 4 and out.numbers() == [3]  # of the first, one of the second, and the one in conflict
    assert {k: t.first().v for k, t in out.read().items()} == {"a": 2, "b": 3}


def test_hundred_thousand_phrases(spark):
    """Phrases are found by an equal join on a word, not by reading every name with every phrase."""
    rules = spark.range(1000).select(F.col("id").cast("int").alias("row"), F.lit("f").alias("festival_key"), F.lit("up").alias("direction"), F.lit("c").alias("category"), F.lit(1.5).alias("suggested_multiplier"),
                                     F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("red box "), (F.col("id") * 100 + i).cast("string"))), ", ").alias("items"))
    skus = spark.range(2000).select(F.concat(F.lit("Big Red-Box "), (F.col("id") * 77).cast("string"), F.lit(" new")).alias("sku"))
    found = service.keyword_matches(skus, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r.sku, r.keyword) for r in found.collect()} == {(f"Big Red-Box {77 * i} new", f"red box {77 * i}") for i in range(1299)}
