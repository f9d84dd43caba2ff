"""Composed visibility, smoothers, prompts, verification and rasters against restatements by hand."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import masks as M
from framewright.operators import smoothing as S
from framewright.operators import verification as C
from framewright.operators import visibility as V

CAMERA = G.Camera(100.0, 100.0, 50.0, 40.0, 100.0, 80.0)


def hampel(x, width, sigma, least):
    out, h = x.copy(), width // 2
    for i in range(len(x)):
        near = x[max(0, i - h) : i + h + 1]
        m = np.median(near)
        if len(x) >= 3 and abs(x[i] - m) > max(least, sigma * 1.4826 * np.median(np.abs(near - m))):
            out[i] = m
    return out


def gauss(x, width):
    h, sigma = width // 2, max(1.0, width / 4)
    out = np.zeros(len(x))
    for i in range(len(x)):
        at = np.arange(max(0, i - h), min(len(x), i + h + 1))
        w = np.exp(-0.5 * ((at - i) / sigma) ** 2)
        out[i] = (w * x[at]).sum() / w.sum()
    return out


def test_smooth_joints_is_its_parts_in_order(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(scale=0.02, size=(3, 40)), axis=1)
    x[1, 20] += 3
    rows = [(j, i, float(x[j, i]), -0.2, 0.2) for j in range(3) for i in range(40)] + [(9, 0, 5.0, -0.2, 0.2)]
    df = spark.createDataFrame(rows, "joint long, f long, q double, lo double, hi double")
    got = S.smooth_joints(df, ["joint"], "f", "q", "lo", "hi", 30.0, fixed=F.col("joint") == 0)
    by = {j: [r["smoothed"] for r in got.orderBy("f").collect() if r["joint"] == j] for j in (0, 1, 2, 9)}
    assert by[0] == x[0].tolist() and by[9] == [5.0]  # the root and a single row stay
    for j in (1, 2):
        free = gauss(hampel(x[j].clip(-0.2, 0.2), 7, 3.5, 0.08), 7)
        assert np.abs(np.diff(free)).max() < 8 / 30 and np.abs(np.diff(free, n=2)).max() < 120 / 900  # no limit binds here
        assert np.allclose(by[j], free.clip(-0.2, 0.2), atol=1e-9)
    tight = S.smooth_joints(df.filter("joint = 1"), ["joint"], "f", "q", "lo", "hi", 30.0, S.Smoothing(joint_speed=0.3, joint_acceleration=3.0))
    y = np.array([r["smoothed"] for r in tight.orderBy("f").collect()])
    assert np.abs(np.diff(y)).max() <= 0.3 / 30 + 1e-6 and np.abs(np.diff(y, n=2)).max() <= 3 / 900 + 1e-6
    with pytest.raises(Exception, match="finite"):
        S.smooth_joints(spark.createDataFrame([(1, 0, math.nan, 0.0, 1.0), (1, 1, 0.5, 0.0, 1.0)], df.schema), ["joint"], "f", "q", "lo", "hi", 30.0).collect()
    with pytest.raises(ValueError):
        S.Smoothing(window=4)


def test_smooth_poses_have_no_lag_and_unit_turns(spark):
    n = 41
    t = np.arange(n)
    pulse = 0.02 * np.exp(-0.5 * ((t - 20) / 4) ** 2)
    angle = 0.6 * np.exp(-0.5 * ((t - 20) / 5) ** 2)
    q = [[0.0, 0.0, math.sin(a / 2), math.cos(a / 2)] for a in angle]
    q[10] = [-v for v in q[10]]
    q[30] = [1.0, 0.0, 0.0, 0.0]  # an outlier
    rows = [(1, i, [float(pulse[i]), 0.0, 1.0], q[i]) for i in range(n)] + [(2, 0, [1.0, 2.0, 3.0], [0.0, 0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "ep long, f long, p array<double>, q array<double>")
    got = S.smooth_poses(df, ["ep"], "f", "p", "q", 30.0).orderBy("ep", "f").collect()
    p = np.array([r["p"] for r in got[:n]])
    turn = np.array([r["q"] for r in got[:n]])
    assert np.allclose(p[:, 0], p[::-1, 0], atol=1e-9) and p[:, 0].argmax() == 20
    assert np.allclose(np.linalg.norm(turn, axis=1), 1) and (np.sum(turn[1:] * turn[:-1], axis=1) > 0.9).all()
    assert abs(turn[30] @ q[29]) > 0.99
    assert got[n]["p"] == [1.0, 2.0, 3.0] and got[n]["q"] == [0.0, 0.0, 0.0, 2.0]


def test_alignment_equals_numpy(spark):
    rng = np.random.default_rng(3)
    n = 30
    d = rng.normal(size=(2, 2, n)) * 20  # side, axis, frame
    depth, sure = rng.uniform(0.5, 2, size=(2, n)), rng.choice([0.0, 0.4, 0.55, 0.95], size=(2, n))
    rows = [(1, i, s, *map(float, (d[s, 0, i], d[s, 1, i], depth[s, i], sure[s, i]))) for s in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "ep long, f long, side long, du double, dv double, z double, c double")
    got = S.align_to_detections(df, ["ep"], "f", ["du", "dv"], "z", [100.0, 50.0], 7, 2.0, "side", "c").collect()
    taps = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    taps /= taps.sum()
    blur = lambda x: np.convolve(np.pad(x, 8, mode="edge"), taps, mode="valid")
    middle = lambda x: np.array([np.median(np.pad(x, 3, mode="edge")[i : i + 7]) for i in range(n)])
    smooth = np.array([[blur(middle(d[s, a])) for a in range(2)] for s in range(2)])
    shift = np.stack([smooth[:, 0] * depth / 100, smooth[:, 1] * depth / 50], axis=1)
    direct = (sure >= 0.9).astype(float)
    weight = np.where(direct.max(0) > 0, direct, sure)
    shared = (shift * weight[:, None]).sum(0) / np.maximum(weight.sum(0), 1e-6)
    for r in got:
        assert np.allclose([r["du"], r["dv"]], smooth[r["side"], :, r["f"]])
        assert np.allclose(r["shift"], [blur(shared[0])[r["f"]], blur(shared[1])[r["f"]], 0.0])


def test_sleeve_profile_by_hand(spark):
    rng = np.random.default_rng(2)
    mask = np.zeros((120, 160), bool)
    for x in [*range(20, 70), *range(100, 130)]:  # bins without pixels between
        half = 12 + x // 8 + rng.integers(0, 4)
        mask[60 - half : 60 + half, x] = True
    base, end = np.array([10.37, 60.21]), np.array([150.0, 64.0])
    axis = end - base
    y, x = np.nonzero(mask)
    rows = [(1, float(((a - base[0]) * axis[0] + (b - base[1]) * axis[1]) / (axis @ axis)), float(abs((b - base[1]) * axis[0] - (a - base[0]) * axis[1]) / math.hypot(*axis))) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "k long, along double, across double")
    radii = [r["radius"] for r in M.sleeve_profile(df, ["k"], "along", "across").orderBy("bin").collect()]
    # by hand: percentiles of the bins, filled, margin, clipped, smoothed with zeros beyond the ends
    number = np.array([int(math.floor(r[1] * 12)) for r in rows])
    known = {b: np.percentile([r[2] for r, k in zip(rows, number) if k == b], 92) for b in range(12) if (number == b).sum() >= 24}
    assert 3 <= len(known) < 12
    w = np.clip(np.interp(range(12), list(known), list(known.values())) + 12, 28, 88)
    s = np.convolve(w, [0.25, 0.5, 0.25], mode="same")
    assert np.allclose(radii[1:-1], s[1:-1]) and np.isclose(radii[0], 0.75 * s[0] + 0.25 * s[1]) and np.isclose(radii[-1], 0.75 * s[-1] + 0.25 * s[-2])
    with pytest.raises(Exception, match="too few bins"):
        M.sleeve_profile(df.filter("along < 0.15"), ["k"], "along", "across").collect()


def hand(n_in, n_near=0, shift=0.0):
    """21 points at depth 1: some inside the image, some 10 pixels outside, the rest far off."""
    at = [(10 + 4 * i, 20 + 2 * i) for i in range(n_in)] + [(-10 - i / 10, 30) for i in range(n_near)]
    at += [(500, 500)] * (21 - len(at))
    return [[(u + shift - 50) / 100, (v - 40) / 100, 1.0] for u, v in at]


def test_prompt_cascade_goes_down_step_by_step(spark):
    low, high = [0.1] * 21, [0.9] * 21
    rows = [(1, hand(10), high), (2, hand(10), low), (3, hand(3, 5), high), (4, hand(1, 5), low), (5, hand(2, 1), high), (6, hand(10), [0.9] * 3 + [0.1] * 18)]
    df = spark.createDataFrame(rows, "k long, p array<array<double>>, c array<double>")
    got = {r["k"]: r["prompt"] for r in V.prompt_cascade(df, "p", CAMERA, 5.0, "c").collect()}
    assert [got[k]["how"] if got[k] else None for k in range(1, 7)] == ["trusted", "seen", "near trusted", "near", None, "seen"]
    assert got[1]["picked"] == [0, 2, 4, 6, 8] and (got[1]["u0"], got[1]["v0"], got[1]["u1"], got[1]["v1"]) == pytest.approx((5, 15, 51, 43))
    assert [round(p["u"]) for p in got[3]["positives"]] == [10, 18, 0, 0] and got[3]["picked"] == [0, 2, 4, 6]
    other = df.withColumn("o", F.lit(None).cast("array<array<double>>")).filter("k = 1").drop("o").withColumn("o", F.array(*(F.array(*map(F.lit, p)) for p in hand(21, shift=3.0))))
    neg = V.prompt_cascade(other, "p", CAMERA, 5.0, None, "o").first()["prompt"]["negatives"]
    pos = [(10 + 4 * i, 20 + 2 * i) for i in (0, 2, 4, 6, 8)]
    want = [(13 + 4 * i, 20 + 2 * i) for i in (0, 2, 6, 10, 14, 18) if 13 + 4 * i < 100 and min(math.dist(p, (13 + 4 * i, 20 + 2 * i)) for p in pos) > 10]
    assert [(round(p["u"]), round(p["v"])) for p in neg] == want and want


def test_spread_prompt(spark):
    rows = [(1, hand(9), [0.9] * 21), (2, hand(9), [0.1] * 21), (3, hand(0), [0.9] * 21), (4, hand(9), [0.9] * 2 + [0.1] * 19)]
    got = {r["k"]: r["prompt"] for r in V.spread_prompt(spark.createDataFrame(rows, "k long, p array<array<double>>, c array<double>"), "p", CAMERA, 1.0, 4, "c").collect()}
    assert got[1]["picked"] == got[2]["picked"] == [0, 3, 5, 8] and got[3] is None and got[4]["picked"] == [0, 1]


def test_hand_visibility_composes(spark):
    eye = [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    far = lambda z: [[0.0, 0.0, z]] * 21
    rows = [(1, i, *eye, far(1.0 if i in (4, 7) else -1.0), i == 14) for i in range(20)]
    df = spark.createDataFrame(rows, "ep long, f long, t array<double>, q array<double>, p array<array<double>>, d boolean")
    seen = lambda **k: [r["f"] for r in V.hand_visibility(df, ["ep"], "f", "t", "q", "p", CAMERA, **k).orderBy("f").collect() if r["visible"]]
    assert seen(gap=0, entry=0, exit=0) == [4, 7]
    assert seen(gap=2, entry=0, exit=0) == [4, 5, 6, 7]
    assert seen(gap=2, entry=1, exit=2, direct="d") == [3, 4, 5, 6, 7, 8, 9, 13, 14, 15, 16]
    with pytest.raises(ValueError):
        seen(least=22)


def test_verdicts_and_small_columns(spark):
    areas = spark.createDataFrame([(1, "left", 200.0, 20.0, 300.0), (2, "left", 200.0, 20.0, 300.0), (2, "right", 40.0, 2.0, 300.0), (3, "left", 1.0, 1.0, 2.0), (4, "left", 40.0, 20.0, 200.0), (4, "right", 40.0, 20.0, 200.0)], "e long, side string, robot double, arm double, all_ double")
    got = {r["e"]: r["verdict"] for r in V.robot_verdict(areas, ["e"], "side", "robot", "arm", "all_").collect()}
    assert got == {1: "right robot is never visible", 2: "right arm is never visible", 3: "too small together", 4: "ok"}
    one = spark.range(1)
    assert one.select(V.side_name(F.lit(" Left "))).first()[0] == "left"
    with pytest.raises(Exception, match="no such side"):
        one.select(V.side_name(F.lit("up"))).collect()
    names = lambda *x: F.array(*map(F.lit, x))
    assert one.select(V.actuated(names("a", *V.ROOT, "b"), expected=2)).first()[0] == [0, 7]
    for bad in (names("a", "a", *V.ROOT), names("a", "x"), names("a", *V.ROOT)):
        with pytest.raises(Exception, match="joint"):
            one.select(V.actuated(bad, expected=2)).collect()
    assert one.select(V.hidden_links(names("b", "a", "b"), ("a", "b", "c"))).first()[0] == ["a", "b"]
    with pytest.raises(Exception, match="unsupported"):
        one.select(V.hidden_links(names("z"), ("a",))).collect()
    flags = one.select(V.out_of_memory(F.lit("CUDA error: Out of memory")), V.out_of_memory(F.lit("out of memory")), V.unit_scale(F.lit(510), 255.0), V.unit_scale(F.lit(51), 255.0)).first()
    assert list(flags) == [True, False, 1.0, 0.2]
    data = bytearray(b"abc")
    digest = hashlib.sha256(data).hexdigest()
    same = lambda n, d: one.select(V.is_file(F.lit(3), F.lit(n), F.lit(data), F.lit(d))).first()[0]
    assert same(3, digest.upper()) and not same(4, digest) and not same(3, "0")
    poses = one.select(V.pixel_poses(F.array(F.struct(F.lit(1.0).alias("u"), F.lit(2.0).alias("v"))))).first()[0]
    assert poses[0]["t"] == [1.0, 2.0, 0.0] and poses[0]["r"] == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    frames = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "e long, f long")
    with pytest.raises(Exception, match="no base pose"):
        V.base_trajectory(frames, spark.createDataFrame([(1, "x")], "e long, base string"), ["e"], "f").collect()
    with pytest.raises(Exception, match="different frames"):
        V.base_trajectory(frames, spark.createDataFrame([(1, 0, "x")], "e long, f long, base string"), ["e"], "f").collect()


def test_states_and_selections(spark):
    rows = spark.createDataFrame([(1, None), (2, '{"state": "failed"}'), (3, '{"stat'), (4, "{}"), (5, '{"state": "completed", "x": [1]}')], "e long, t string")
    assert [r[0] for r in rows.orderBy("e").select(C.status_of(F.col("t"))).collect()] == ["pending", "failed", "invalid", "pending", "completed"]
    good = spark.createDataFrame([('{"version": 2, "episodes": [{"episode": "7", "frames": 3}]}',)], "value string")
    assert C.manifest(good).first()["episodes"][0]["frames"] == 3
    with pytest.raises(Exception, match="unsupported manifest"):
        C.manifest(spark.createDataFrame([('{"version": 9}',)], "value string")).collect()
    with pytest.raises(Exception, match="no such episode"):
        C.chosen(rows, spark.createDataFrame([(1,), (77,)], "e long"), "e").collect()
    hosts = spark.createDataFrame([("h", 0, 80), ("h", 1, 20), ("h", 2, 70), ("h", 3, 80)], "g string, i long, free long")
    got = C.choose_hosts(hosts, ["g"], "free", "i", 36, None, 2).orderBy("place").collect()
    assert [(r["i"], r["freest"]) for r in got] == [(0, 3), (3, 3)]
    with pytest.raises(Exception, match="too few"):
        C.choose_hosts(hosts, ["g"], "free", "i", 75, None, 2, 3).collect()
    with pytest.raises(Exception, match="unknown name"):
        one = spark.createDataFrame([(1, 0)], "n long, place long")
        C.in_order(spark.createDataFrame([(1,), (5,)], "n long"), one, one, "n", "place").collect()


def test_episode_errors_of_a_broken_run(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    chunk = [("e", 0, "left", 0, 10), ("e", 1, "both", 10, 15)]
    names = ["000_left_00000_00010", "001_both_00010_00015"]
    args = lambda **k: {
        "episodes": t([("e", 15), ("gone", 9)], "episode string, frames long"), "metadata": t([("e", 15)], "episode string, total_frames long"), "skipped": t([], "episode string"),
        "backends": t([("e", "direct")], "episode string, backend string"), "chunks": t(chunk, "episode string, index int, mode string, start long, stop long"),
        "provenance": t([("e", n) for n in names], "episode string, name string"), "masks": t([("e", names[0], 10), ("e", names[1], 5)], "episode string, name string, n long"),
        "videos": t([("e", names[0], 9, 10), ("e", names[1], 9, 5), ("e", "full.mp4", 9, 15)], "episode string, name string, bytes long, n long"), "finals": ["full.mp4"], "backend": "direct",
    } | k
    said = lambda **k: sorted((r["episode"], r["ord"], r["message"]) for r in C.episode_errors(**args(**k)).collect())
    gone = ("gone", 1, "missing metadata")
    assert said() == [gone]
    assert said(metadata=t([("e", 14)], "episode string, total_frames long")) == [("e", 3, "total_frames does not match the manifest"), gone]
    broken = said(
        skipped=t([("e",), ("e",)], "episode string"), backends=t([("e", "old")], "episode string, backend string"), provenance=t([("e", names[0])], "episode string, name string"),
        masks=t([("e", names[0], 9)], "episode string, name string, n long"), videos=t([("e", names[0], 0, 10), ("e", names[1], 9, None), ("e", "full.mp4", 9, 14)], "episode string, name string, bytes long, n long"),
    )
    assert [m for _, _, m in broken] == [
        "2 skipped segments remain", "mask backend mismatch: expected direct, got old", f"missing provenance for {names[1]}", f"missing video: {names[0]}", f"unreadable video {names[1]}",
        f"mask count mismatch {names[0]}: expected 10, got 9", f"mask count mismatch {names[1]}: expected 5, got 0", "frame mismatch full.mp4: expected 15, got 14", "missing metadata",
    ]


def test_facts_of_runs_are_dealt_once(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    name, videos = "000_left_00000_00010", [("e", "000_left_00000_00010", 9, 9), ("e", "a.mp4", 9, 15), ("e", "b.mp4", 9, None), ("f", "a.mp4", 0, 7)]
    found = C.episode_errors(
        t([("e", 15), ("f", 7)], "episode string, frames long"), t([("e", 15), ("f", 7)], "episode string, total_frames long"), t([], "episode string"), t([("f", None)], "episode string, backend string"),
        t([("e", 0, "left", 0, 10)], "episode string, index int, mode string, start long, stop long"), t([("e", name)], "episode string, name string"), t([("e", name, 10)], "episode string, name string, n long"),
        t(videos, "episode string, name string, bytes long, n long"), ["a.mp4", "b.mp4", "c.mp4"], "direct",
    )
    assert sorted((r["episode"], r["ord"], r["message"]) for r in found.collect()) == [
        ("e", 5, "missing pipeline provenance"), ("e", 8, f"frame mismatch {name}: expected 10, got 9"), ("e", 10, "missing video: c.mp4"), ("e", 10, "unreadable video b.mp4"),
        ("f", 6, "mask backend mismatch: expected direct, got none"), ("f", 10, "missing video: a.mp4"), ("f", 10, "missing video: b.mp4"), ("f", 10, "missing video: c.mp4"),
    ]
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().sparkPlan().toString()  # lists of videos or messages would sort all facts of runs
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()  # messages meet the known runs where they were made


def test_segment_names_equal_the_formatter(spark):
    rows = [(i, m, a, b) for i in (0, 99, 1000, -1, None) for m in ("left", None) for a in (0, 99999, 2**40, -3, None) for b in (1, 1234567, -12, None)]
    names = spark.createDataFrame(rows, "i int, m string, a long, b long").select(C.segment_name(*map(F.col, "imab")).alias("own"), F.format_string("%03d_%s_%05d_%05d", "i", "m", "a", "b").alias("want"))
    assert all(r["own"] == r["want"] for r in names.collect())


def test_jobs_artifacts_and_first_successes(spark):
    segments = spark.createDataFrame([(1, 10), (2, 20)], "s long, n long")
    frames = spark.createDataFrame([(1, 10), (2, 19)], "s long, n long")
    done = spark.createDataFrame([(1,)], "s long")
    with pytest.raises(Exception, match="incomplete"):
        C.open_jobs(segments, frames, done, ["s"], "n").collect()
    assert C.open_jobs(segments, segments, done, ["s"], "n").collect()[0]["s"] == 2
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "s long, kind string")
    assert [r["s"] for r in C.with_artifacts(segments, found, ["s"], "kind", ["a", "b"], False).collect()] == [1]
    with pytest.raises(Exception, match="lacks an artifact"):
        C.with_artifacts(segments, found, ["s"], "kind", ["a", "b"], True).collect()
    tries = spark.createDataFrame([(1, 0, False, "x"), (1, 1, True, "y"), (2, 0, False, "x"), (3, 0, False, "x"), (3, 1, True, "z")], "e long, k long, ok boolean, v string")
    assert dict(map(tuple, C.first_success(tries, ["e"], "k", "ok", "v", F.col("e") == 3).collect())) == {1: "y", 2: None, 3: None}


def test_state_results_and_slices(spark, tmp_path):
    wanted = spark.createDataFrame([(1, "left"), (2, "left")], "episode long, side string")
    assert [r["source_frame"] for r in C.load_state(spark, wanted, None).collect()] == [-1, -1]
    schema = "episode long, side string, hand array<double>, arm array<double>, translation array<double>, rotation array<double>, source_frame long"
    C.save_state(spark.createDataFrame([(1, "left", [1.0], [2.0], [0.0] * 3, [1.0] * 9, 7)], schema), str(tmp_path / "s"))
    got = {r["episode"]: (r["hand"], r["source_frame"]) for r in C.load_state(spark, wanted, str(tmp_path / "s")).collect()}
    assert got == {1: ([1.0], 7), 2: (None, -1)}
    C.save_state(spark.createDataFrame([(2, "left", [3.0], [2.0], [0.0] * 3, [1.0] * 9, 8)], schema), str(tmp_path / "s"))  # the other chain stays
    assert {r["episode"]: r["source_frame"] for r in C.load_state(spark, wanted, str(tmp_path / "s")).collect()} == {1: 7, 2: 8}
    masks = spark.createDataFrame([(i, "m") for i in range(3)], "frame long, bits string")
    parts = C.slice_recording({"a": masks, "b": masks.drop("frame")}, "frame", 3, 1, 3)
    assert sorted(r["frame"] for r in parts["a"].collect()) == [0, 1] and parts["b"].count() == 3
    with pytest.raises(ValueError):
        C.slice_recording({}, "frame", 3, 2, 4)
    C.save_result(masks.withColumn("episode", F.lit(1)), ["episode"], str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    layers = masks.select("frame")
    assert C.mattes(layers, layers.filter("frame > 9"), layers, ["frame"]) is None
    with pytest.raises(Exception, match="different frames"):
        C.mattes(layers, layers.filter("frame > 0").withColumn("a", F.lit(1)), layers.withColumn("c", F.lit(1)), ["frame"]).collect()
    with pytest.raises(Exception, match="shape"):
        one = spark.createDataFrame([(1, 2, 2, [0])], "f long, w long, h long, cells array<long>")
        M.same_shapes(one, one.withColumn("h", F.lit(3).cast("long")), ["f"]).collect()


def test_masks_are_installed_by_partition_and_survive_failed_writes(spark, tmp_path):
    path, kept = str(tmp_path / "masks"), str(tmp_path / "kept")
    rows = lambda segment, bits: spark.createDataFrame([(segment, i, bits) for i in range(3)], "segment long, frame long, bits string")
    three = spark.createDataFrame([(1, 3), (2, 3)], "segment long, n long")
    held = lambda p: {(r["segment"], r["bits"]) for r in spark.read.parquet(p).collect()}
    C.install_masks(rows(1, "m").union(rows(2, "m")), ["segment"], three, path, kept)
    one = three.filter("segment = 1")
    C.install_masks(rows(1, "new"), ["segment"], one, path, kept)
    C.install_masks(rows(1, "newer"), ["segment"], one, path, kept)
    assert held(path) == {(1, "newer"), (2, "m")} and held(kept) == {(1, "m")}  # once, and only what was replaced
    for expected in (three, one.withColumn("n", F.lit(4).cast("long"))):
        with pytest.raises(ValueError):
            C.install_masks(rows(1, "x"), ["segment"], expected, path, kept)
    fails = F.udf(lambda i: i if i < 2 else 1 // 0, "long")
    broken = rows(1, "broken").union(rows(2, "broken")).withColumn("frame", fails("frame"))
    with pytest.raises(Exception, match="ZeroDivision"):
        C.published(broken, ["segment"], path)
    with pytest.raises(Exception, match="ZeroDivision"):
        C.install_masks(broken, ["segment"], three, path, kept)
    assert held(path) == {(1, "newer"), (2, "m")}
    # masks made from those that they replace
    C.install_masks(spark.read.parquet(path).filter("segment = 2").withColumn("bits", F.lit("own")).select("segment", "frame", "bits"), ["segment"], three.filter("segment = 2"), path, kept)
    assert held(path) == {(1, "newer"), (2, "own")} and held(kept) == {(1, "m"), (2, "m")}


def test_rigid_input_is_checked(spark):
    from framewright.operators import poses as P

    rng = np.random.default_rng(4)
    q = rng.normal(size=(60, 4))
    q = np.vstack([q / np.linalg.norm(q, axis=1, keepdims=True), [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "i long, q array<double>").withColumn("r", P.rotation(F.col("q")))
    for r in df.withColumn("checked", P.checked_rotation(F.col("r"))).select("q", P.quaternion_of(F.col("checked")).alias("back")).collect():
        assert abs(abs(np.dot(r["q"], r["back"])) - 1) < 1e-9 and r["back"][3] >= 0
    for bad in ([1.0, 0, 0, 0, 1, 0, 0, 0, -1.0], [1.1, 0, 0, 0, 1, 0, 0, 0, 1.0], [float("nan")] * 9):
        with pytest.raises(Exception, match="not a rotation"):
            spark.createDataFrame([(list(map(float, bad)),)], "r array<double>").select(P.checked_rotation(F.col("r"))).collect()
    rows = df.withColumn("ep", F.lit(1)).withColumn("p", F.array(F.col("i") * 0.01, F.lit(0.0), F.lit(1.0)))
    by_q = {r["i"]: r["q"] for r in S.smooth_poses(rows, ["ep"], "i", "p", "q", 30.0).collect()}
    for r in S.smooth_rigid(rows, ["ep"], "i", "p", "r", 30.0).collect():
        m = np.reshape(r["r"], (3, 3))
        x, y, z, w = by_q[r["i"]]
        want = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
        assert np.allclose(m, want, atol=1e-6) and np.allclose(m @ m.T, np.eye(3))


def test_detected_landmarks_of_missing_sides(spark):
    points = [(float(i), float(2 * i)) for i in range(21)]
    schema = "ep long, f long, side string, score double, k long, p array<struct<u: double, v: double>>"
    found = spark.createDataFrame([(1, 2, "Right".lower(), 0.9, 0, points), (1, 2, "right", 0.95, 1, [(u + 4, v) for u, v in points]), (1, 6, "right", 0.5, 0, [(u + 8, v) for u, v in points])], schema)
    frames = spark.range(8).select(F.lit(1).cast("long").alias("ep"), F.col("id").alias("f"))
    with pytest.raises(Exception, match="never found: right"):
        V.detected_landmarks(found, frames, ["ep"], "f", "side", "score", "k", "p").collect()
    got = {(r["side"], r["f"]): r for r in V.detected_landmarks(found, frames, ["ep"], "f", "side", "score", "k", "p", missing=True).collect()}
    assert len(got) == 16 and all(r["confidence"] == 0 and r["p"][20]["u"] == 0 for (side, _), r in got.items() if side == "right")
    assert [got["left", f]["confidence"] for f in range(8)] == [0.55, 0.55, 1, 0.55, 0.55, 0.55, 1, 0.55]
    assert [got["left", f]["p"][0]["u"] for f in range(8)] == [4, 4, 4, 5, 6, 7, 8, 8]
    assert len(got["left", 0]["markers"]) == 3


def test_windowed_visibility_live(spark, tmp_path):
    import datetime as dt

    from framewright.streaming.live import windowed_visibility

    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=20 * i), i % 2, float(i)) for i in range(12)] + [(start + dt.timedelta(hours=1), 0, 0.0)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = windowed_visibility(stream, "ts", "1 minute", "2 minutes", 5.5)
    query = out.writeStream.format("memory").queryName("shares").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(90) or query.stop() is None
    got = {(r["window"]["start"].minute, r["user_id"]): (r["n"], r["seen"]) for r in spark.table("shares").collect()}
    assert got == {(0, 0): (3, 0.0), (0, 1): (3, 0.0), (2, 0): (3, 1.0), (2, 1): (3, 1.0)}
