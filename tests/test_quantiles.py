"""Quantiles without buffers against NumPy; lanes against a plain heap; explain counts of the flagship."""

import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import batch as B
from framewright.operators.quantiles import quantiles
from framewright.operators.verification import observed, suite


@pytest.mark.parametrize("share", [0.0, 0.5, 0.92, 1.0])
def test_quantiles_equal_numpy(spark, share):
    rng = random.Random(3)
    groups = {"ties": [1.0] * 400 + [2.0] * 200 + [rng.random() for _ in range(50)], "one": [7.5], "skew": [10.0 ** rng.uniform(-6, 9) for _ in range(700)], None: [rng.gauss(0, 1) for _ in range(301)], "same": [4.0] * 30, "two": [1.0, 2.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None), ("empty", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for bins in (1024, 3):
        got = {r["g"]: (r["n"], r["quantile"]) for r in quantiles(df, ["g"], "v", share, bins).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            assert got[g][0] == len(values) and np.isclose(got[g][1], np.quantile(values, share), rtol=1e-12)
    assert quantiles(df.limit(0), ["g"], "v", share).count() == 0


def test_lanes_of_large_groups(spark):
    rng = random.Random(6)
    jobs = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, rng.randint(1, 9)]), "x") for i in range(3000)]
    got = B.assign_lanes(spark.createDataFrame(jobs, "g string, i long, cost long, lane_ string"), ["g"], "cost", [F.col("i")], 3)
    assert got.columns == ["g", "i", "cost", "lane_", "lane"]
    heaps = {}
    for g, i, c, _ in jobs:
        heap = heaps.setdefault(g, [(0, lane) for lane in range(3)])
        load, lane = heap[0]
        heapq.heapreplace(heap, (load + (c or 0), lane))
        jobs[i] = (g, i, lane)
    assert {tuple(r) for r in got.select("g", "i", "lane").collect()} == set(jobs)


def test_suite_is_observed_in_one_pass(spark):
    run = spark.createDataFrame([(1, 2, "a"), (2, 9, "b")], "episode long, ord int, message string")
    rows, figures = observed(suite({"run": run, "files": run.limit(1)}), "suite")
    assert rows.count() == 3 and figures.get["n"] == 3 and figures.get["run_rules"] == 2 and figures.get["highest"] == 9


def test_flagship_keeps_one_chain(spark):
    from framewright.plans import recordings

    held = recordings.recording_chunks(spark, "/root/testdata/sf0.001")
    held.collect()
    plan = held._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    count = lambda what: len(re.findall(what, plan))
    assert count("Scan parquet") == 2 and count("Exchange hash") <= 2 and count(r"Sort \[") <= 4  # events join by broadcast at this size
