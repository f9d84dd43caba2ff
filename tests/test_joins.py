"""Joins by time, by long intervals and by distance against plain loops; blends against singular values."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import intervals as I
from framewright.operators import kernels as K
from framewright.operators import poses as P


def brute_as_of(left, right, direction, tolerance):
    out = []
    for k, t, x in left:
        own = [(s, v) for q, s, v in right if q == k and s is not None]
        before = max(((s, v) for s, v in own if t is not None and s <= t and (tolerance is None or t - s <= tolerance)), default=None)
        after = min(((s, v) for s, v in own if t is not None and s >= t and (tolerance is None or s - t <= tolerance)), default=None)
        best = before if direction == "backward" else after if direction == "forward" else None
        if direction == "nearest":
            best = after if before is None or (after is not None and after[0] - t < t - before[0]) else before
        out.append((k, t, x, best and best[1], best and best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("tolerance", [None, 1.5])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_as_of_equals_loops(spark, direction, tolerance):
    rng = random.Random(7)
    key = lambda: rng.choice(["a", "b", None])
    left = [(key(), rng.choice([None, *map(float, range(20))]), i % 5) for i in range(60)] + [("a", 3.0, 1)] * 2 + [("only", 1.0, 1)]
    right = [(key(), rng.choice([None, rng.randint(0, 40) / 2]), rng.randint(0, 9)) for _ in range(40)]
    right = [r for r in right if r[0] is not None] + [(None, 4.0, 1), (None, 4.0, 3)]
    a, b = spark.createDataFrame(left, "k string, t double, x long").repartition(3), spark.createDataFrame(right, "k string, t double, v long")
    got = sorted((tuple(r) for r in I.as_of(a, b, ["k"], "t", ["v"], direction, tolerance).collect()), key=str)
    assert got == brute_as_of(left, right, direction, tolerance)
    assert I.as_of(a, b.limit(0), ["k"], "t", ["v"], direction).filter("v is not null").count() == 0
    with pytest.raises(ValueError):
        I.as_of(a, b, ["k"], "t", ["v"], "sideways")


def test_resampled_equals_interp(spark):
    rng = random.Random(2)
    right = sorted({round(rng.uniform(0, 50), 2): rng.gauss(0, 1) for _ in range(25)}.items())
    left = [rng.uniform(-5, 60) for _ in range(40)] + [right[3][0]]
    a, b = spark.createDataFrame([("a", t) for t in left], "k string, t double"), spark.createDataFrame([("a", t, v) for t, v in right], "k string, t double, v double")
    for r in I.resampled(a, b, ["k"], "t", "v").collect():
        assert np.isclose(r["sampled"], np.interp(r["t"], *zip(*right)))


def test_long_intervals_equal_unrolled_ones(spark):
    rng = random.Random(5)
    chunks = [(e, c, s, s + rng.randint(-2, 60), rng.choice("lr")) for e in (1, 2) for c, s in enumerate(rng.randint(0, 300) for _ in range(12))]
    frames = [(e, f) for e in (1, 2, 3) for f in range(0, 330)] + [(1, 5)] * 2
    a, b = spark.createDataFrame(frames, "e long, f long"), spark.createDataFrame(chunks, "e long, c long, start long, stop long, side string").filter("stop > start")
    want = sorted(map(tuple, I.frames_to_chunks(a, b, ["e"], "f", "c").select("e", "f", "c", "local").collect()), key=str)
    for width in (1, 7, 4096):
        assert sorted(map(tuple, I.frames_in_intervals(a, b, ["e"], "f", "c", width).select("e", "f", "c", "local").collect()), key=str) == want
    side = {(e, c): s for e, c, _, _, s in chunks}
    rows = I.labelled_frames(a, b, ["e"], "f", "c", "side", "source").collect()
    assert len(rows) == len(frames) and all(r["side"] == (side[r["e"], r["c"]] if r["c"] is not None else "source") for r in rows)
    far = spark.createDataFrame([(1, 1, 5, 5_000_000_000, "l")], b.schema)
    seen = I.frames_in_intervals(spark.createDataFrame([(1, 4_999_999_999), (1, 5_000_000_000), (1, 4)], "e long, f long"), far, ["e"], "f", "c", 1 << 28).collect()
    assert {r["f"]: r["local"] for r in seen} == {4_999_999_999: 4_999_999_994, 5_000_000_000: None, 4: None}


def test_frames_and_intervals_meet_in_one_shuffle(spark):
    rng = random.Random(8)
    key = lambda: rng.choice([1, 2, None])
    frames = [(key(), rng.choice([None, *range(40)]), i) for i in range(300)] + [(7, 3, 300)]
    chunks = [(key(), rng.choice([None, *range(9)]), s, s + rng.randint(-3, 30), rng.choice(["l", "r", None])) for s in [rng.randint(-5, 40) for _ in range(60)]] + [(8, 1, 0, 9, "l"), (1, 3, None, 9, "l"), (1, 3, 1, None, "l")]
    a, b = spark.createDataFrame(frames, "e int, f int, more long"), spark.createDataFrame(chunks, "e int, c int, start long, stop long, side string")
    low = lambda x: (x is not None, x or 0)  # noqa: E731 - nulls first
    want = []
    for e, f, more in frames:
        own = [(low(c), s, c) for k, c, s, t, _ in chunks if None not in (e, f, s, t) and k == e and s <= f < t]
        best = max(own, default=None)
        want.append((e, f, more, best and best[2], best and f - best[1]))
    got = I.frames_in_intervals(a, b, ["e"], "f", "c")
    assert got.dtypes == [("e", "int"), ("f", "int"), ("more", "bigint"), ("c", "int"), ("local", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    named = I.labelled_frames(a, b, ["e"], "f", "c", "side", "source")
    assert named.columns == ["e", "c", "f", "more", "local", "side"]
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # the label comes along with its interval
    assert sorted(((r["e"], r["f"], r["more"], r["c"], r["local"]) for r in named.collect()), key=str) == sorted(want, key=str)
    assert all((r["side"] == "source") == (r["c"] is None) for r in named.collect())
    assert I.frames_in_intervals(a, b.limit(0), ["e"], "f", "c").filter("c is null").count() == len(frames) and I.frames_in_intervals(a.limit(0), b, ["e"], "f", "c").count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_covering_equals_loops(dense):
    rng = np.random.default_rng(3)
    n, m = (400, 300) if dense else (30, 500)
    start = rng.integers(0, 1000, n)
    stop, rank, of = start + rng.integers(1, 900 if dense else 20, n), rng.integers(0, 50, n), np.sort(rng.integers(0, 3, n))
    at, group = rng.integers(0, 1100, m), np.sort(rng.integers(0, 3, m))
    best = K.covering(pa.chunked_array([at]), group, *(pa.chunked_array([x]) for x in (start, stop)), of, pa.chunked_array([rank]))
    for i in range(m):
        own = [(rank[j], start[j]) for j in range(n) if of[j] == group[i] and start[j] <= at[i] < stop[j]]
        assert (best[i] < 0) == (not own) and (not own or (rank[best[i]], start[best[i]]) == max(own))


def test_distance_anti_join_equals_loops(spark):
    rng = random.Random(9)
    spot = lambda: float(rng.randint(-30, 30))
    points = [(rng.choice(["a", None]), spot(), spot()) for _ in range(200)] + [("a", None, 1.0)]
    others = [(rng.choice(["a", None]), spot(), spot()) for _ in range(25)] + [("a", None, None)]
    a, b = spark.createDataFrame(points, "k string, u double, v double"), spark.createDataFrame(others, "k string, u double, v double")
    for least in (5.0, 0.0, 90.0):
        near = lambda p: any(q[0] == p[0] and None not in (*p[1:], *q[1:]) and math.dist(p[1:], q[1:]) <= least for q in others)  # noqa: E731,B023
        got = sorted(map(tuple, G.far_from(a, b, ["k"], least).collect()), key=str)
        assert got == sorted((p for p in points if not near(p)), key=str)


def test_blends_equal_singular_values(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for i in range(40):
        a, b = (np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(2))
        a, b = a * np.sign(np.linalg.det(a)), b * np.sign(np.linalg.det(b))
        w = float(rng.random())
        left, _, right = np.linalg.svd((1 - w) * a + w * b)
        left[:, 2] *= np.linalg.det(left @ right)
        want.append((left @ right).ravel())
        rows.append((i, (a.ravel().tolist(), [0.0] * 3), (b.ravel().tolist(), [1.0] * 3), w))
    half = np.diag([-1.0, -1.0, 1.0])
    rows += [(40, (np.eye(3).ravel().tolist(), [0.0] * 3), (half.ravel().tolist(), [1.0] * 3), 0.5), (41, None, rows[0][2], 0.3), (42, rows[0][1], rows[0][2], None)]
    pose = "struct<r: array<double>, t: array<double>>"
    got = {r["i"]: r["blended"] for r in P.blend_poses(spark.createDataFrame(rows, f"i long, p {pose}, n {pose}, share double"), "p", "n", "share").collect()}
    assert all(np.allclose(got[i]["r"], want[i], atol=1e-6) for i in range(40)) and got[40] is got[41] is got[42] is None
