"""Golden vectors and NumPy restatements of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import batch as B
from framewright.operators import geometry as G
from framewright.operators import intervals as I
from framewright.operators import kernels as K
from framewright.operators import masks as M
from framewright.operators import smoothing as S


def flags(spark, text):
    return spark.createDataFrame([(1, i, c == "T") for i, c in enumerate(text.split())], "ep long, f long, v boolean")


def text_of(df):
    return " ".join("T" if r["v"] else "F" for r in df.orderBy("f").collect())


@pytest.mark.parametrize(("given", "gap", "want"), [("F T T F F T F", 2, "F T T T T T F"), ("F F T T F", 2, "F F T T F"), ("T F F F T", 2, "T F F F T"), ("F F F", 2, "F F F")])
def test_bridge(spark, given, gap, want):
    assert text_of(I.bridge_gaps(flags(spark, given), ["ep"], "f", "v", gap)) == want


def test_pad(spark):
    twelve = " ".join("T" if i in (5, 6) else "F" for i in range(12))
    assert text_of(I.pad_intervals(flags(spark, twelve), ["ep"], "f", "v", 3, 2)) == " ".join("T" if 2 <= i <= 8 else "F" for i in range(12))
    assert text_of(I.pad_intervals(flags(spark, "T F F F T"), ["ep"], "f", "v", 2, 1)) == "T T T T T"
    with pytest.raises(ValueError):
        I.pad_intervals(flags(spark, "T"), ["ep"], "f", "v", -1, 0)


def test_balanced(spark):
    one = spark.createDataFrame([(1057, 1299)], "start long, stop long")
    assert sorted(map(tuple, I.balanced_chunks(one, 6, 240).select("start", "stop").collect())) == [(1057, 1178), (1178, 1299)]
    assert I.balanced_chunks(spark.createDataFrame([(0, 5)], "start long, stop long"), 6, 240).count() == 0
    with pytest.raises(ValueError):
        I.balanced_chunks(one, 10, 5)
    with pytest.raises(Exception, match="too short"):
        I.balanced_chunks(spark.createDataFrame([(0, 11)], "start long, stop long"), 10, 10).collect()


def chunks_by_loop(left, right, gap, entry, exit, shortest, longest, first):
    def whole(v):
        v, n = list(v), len(v)
        on = [i for i in range(n) if v[i]]
        for a, b in zip(on, on[1:]):
            if b - a - 1 <= gap:
                v[a:b] = [True] * (b - a)
        return [any(v[max(0, g - exit) : g + entry + 1]) for g in range(n)]

    state = [a + 2 * b for a, b in zip(whole(left), whole(right))]
    out, i = [], first
    while i < len(state):
        j = i
        while j < len(state) and state[j] == state[i]:
            j += 1
        if state[i] and j - i >= shortest:
            parts = math.ceil((j - i) / longest)
            at = i
            for k in range(parts):
                size = (j - i) // parts + (k < (j - i) % parts)
                out.append(({1: "left", 2: "right", 3: "both"}[state[i]], at, at + size))
                at += size
        i = j
    return sorted(out)


@pytest.mark.parametrize(("gap", "entry", "exit", "first"), [(2, 3, 2, 0), (0, 0, 0, 4), (5, 0, 3, 2)])
def test_adaptive_chunks(spark, gap, entry, exit, first):
    rng = np.random.default_rng(gap)
    left, right = rng.random(160) < 0.3, rng.random(160) < 0.2
    df = spark.createDataFrame([(1, i, bool(a), bool(b)) for i, (a, b) in enumerate(zip(left, right))], "ep long, f long, l boolean, r boolean")
    got = I.adaptive_chunks(df, ["ep"], "f", "l", "r", gap=gap, entry=entry, exit=exit, shortest=3, longest=8, first=first)
    assert sorted((r["mode"], r["start"], r["stop"]) for r in got.collect()) == chunks_by_loop(left, right, gap, entry, exit, 3, 8, first)


def test_timeline_and_frames_to_chunks(spark):
    chunks = spark.createDataFrame([(1, 2, 4), (1, 6, 9)], "ep long, start long, stop long")
    totals = spark.createDataFrame([(1, 10), (2, 3)], "ep long, total long")
    got = sorted(map(tuple, I.fill_timeline(chunks, totals, ["ep"]).collect()))
    assert got == [(1, "chunk", 2, 4), (1, "chunk", 6, 9), (1, "source", 0, 2), (1, "source", 4, 6), (1, "source", 9, 10), (2, "source", 0, 3)]
    frames = spark.range(5).select(F.lit(1).cast("long").alias("ep"), F.col("id").alias("f"))
    laid = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 2, 4)], "ep long, c long, start long, stop long")
    rows = I.frames_to_chunks(frames, laid, ["ep"], "f", "c").orderBy("f").collect()
    assert [(r["c"], r["local"]) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1), (None, None)]


def series(spark, x, name="x"):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], f"ep long, f long, {name} double")


def test_hampel_and_gaussian(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    x[::11] += 9
    got = [r["filtered"] for r in S.hampel(series(spark, x), ["ep"], "f", "x", 7, 3.5, 0.08).orderBy("f").collect()]
    for i in range(80):
        near = x[max(0, i - 3) : i + 4]
        m = np.median(near)
        limit = max(0.08, 3.5 * 1.4826 * np.median(np.abs(near - m)))
        assert abs(got[i] - (m if abs(x[i] - m) > limit else x[i])) < 1e-12
    got = [r["smoothed"] for r in S.gaussian(series(spark, x), ["ep"], "f", "x", 7).orderBy("f").collect()]
    for i in range(80):
        w = np.array([math.exp(-0.5 * ((j - i) / 1.75) ** 2) for j in range(max(0, i - 3), min(80, i + 4))])
        assert abs(got[i] - (w / w.sum()) @ x[max(0, i - 3) : i + 4]) < 1e-12
    pulse = np.zeros(21)
    pulse[10] = 1
    got = np.array([r["smoothed"] for r in S.gaussian(series(spark, pulse), ["ep"], "f", "x", 7).orderBy("f").collect()])
    assert np.allclose(got, got[::-1])
    assert [r["filtered"] for r in S.hampel(series(spark, [1, 99]), ["ep"], "f", "x", 7, 3.5, 0.08).orderBy("f").collect()] == [1, 99]


def test_unwrap_and_boundary(spark):
    rng = np.random.default_rng(5)
    x = (rng.uniform(-9, 9, 60) + math.pi) % (2 * math.pi) - math.pi
    got = [r["unwrapped"] for r in S.unwrap(series(spark, x), ["ep"], "f", "x").orderBy("f").collect()]
    assert np.allclose(got, np.unwrap(x))
    for n, margin in ((30, 6), (4, 12), (1, 3)):
        tail, now = x[:5], x[5 : 5 + n]
        df = spark.createDataFrame([(1, i - 5, float(v)) for i, v in enumerate([*tail, *now])], "ep long, f long, x double")
        got = np.array([r["smoothed"] for r in S.smooth_boundary(df, ["ep"], "f", "x", margin, -3.0, 3.0).orderBy("f").collect()])
        if n < 2:
            assert np.allclose(got, now)
            continue
        joined = np.unwrap(np.concatenate([tail[-margin:], now]))
        r = min(margin, max(1, (len(joined) - 1) // 2))
        k = np.array([0.5 + 0.5 * math.cos(math.pi * j / r) for j in range(-r, r + 1)])
        mean = np.convolve(np.pad(joined, r, mode="edge"), k / k.sum(), "valid")[-n:]
        mean += 2 * math.pi * np.round((now - mean) / (2 * math.pi))
        assert np.allclose(got, np.clip(mean, -3, 3))


def test_interpolation(spark):
    rows = [(1, 0, None, False), (1, 1, 2.0, True), (1, 2, None, False), (1, 3, None, False), (1, 4, 8.0, True), (1, 5, None, False), (2, 0, None, False)]
    df = spark.createDataFrame(rows, "ep long, f long, x double, k boolean")
    got = [(r["filled"], r["confidence"]) for r in I.interpolate_gaps(df, ["ep"], "f", "x", "k").orderBy("ep", "f").collect()]
    assert got == [(2.0, 0.55), (2.0, 1.0), (4.0, 0.55), (6.0, 0.55), (8.0, 1.0), (8.0, 0.55), (None, None)]


def moved_onto(y, rules, low, high):
    """Each constraint as a vector over the whole sequence, projected onto in turn, to and fro."""
    y, n = y.copy(), len(y)
    for _ in range(96):
        y = y.clip(low, high)
        for pattern, bound in rules:
            places = list(range(n - len(pattern) + 1))
            for i in places + places[::-1]:
                a = np.zeros(n)
                a[i : i + len(pattern)] = pattern
                value = a @ y
                y = y - a * (value - min(bound, max(-bound, value))) / (a @ a)
        y = y.clip(low, high)
        if max(np.abs(np.diff(y)).max(initial=0) - rules[0][1], np.abs(np.diff(y, n=2)).max(initial=0) - rules[1][1]) <= 1e-10:
            break
    return y


def test_derivative_limits(spark):
    rng = np.random.default_rng(0)
    x = [np.cumsum(rng.normal(size=n)) for n in (50, 1, 2, 3, 17, 40)] + [np.linspace(0, 1, 30)]
    rows = [(e, i, float(v), -5.0 + e / 10, 5.0) for e, xs in enumerate(x) for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "ep long, f long, x double, lo double, hi double")
    got = S.derivative_limits(df, ["ep"], "f", "x", 30.0, 6.0, 60.0, "lo", "hi").orderBy("ep", "f").collect()
    for e, xs in enumerate(x):
        y = np.array([r["limited"] for r in got if r["ep"] == e])
        assert np.allclose(y, moved_onto(xs, [((-1, 1), 0.2), ((1, -2, 1), 60 / 900)], -5 + e / 10, 5.0), atol=1e-9)
    assert np.allclose([r["limited"] for r in got if r["ep"] == 6], x[6])  # nothing to mend
    with pytest.raises(ValueError):
        S.derivative_limits(df, ["ep"], "f", "x", 0.0, 6.0, 60.0)


def test_few_long_groups_are_projected_as_many_short_ones_are(spark):
    rng = np.random.default_rng(5)
    turn = lambda n: (lambda q: q / np.linalg.norm(q, axis=1, keepdims=True))(rng.normal(size=(n, 4)))
    for x, rules, bounds in ((rng.normal(size=40), [K.Slab((-1, 1), 0.2), K.Slab((1, -2, 1), 0.1)], (-1.0, 1.0)), (rng.normal(size=2), [K.Slab((1, -2, 1), 0.1)], (-np.inf, np.inf)), (turn(30), [K.Arc(0.3)], (-np.inf, np.inf))):
        many = K.projected(np.stack([x, x], 1), np.array([len(x), len(x)]), rules, *bounds, rounds=20)
        assert np.allclose(K.projected_one(x, rules, *bounds, rounds=20) if x.ndim == 1 else K.projected_one(x, rules, rounds=20), many[:, 0], atol=1e-12)
    assert np.isnan(K.projected_one(np.array([0.0, np.nan, 9.0]), [K.Slab((-1, 1), 1.0)])).any()
    seen = S.derivative_limits(spark.createDataFrame([(e, i, float(i % 2)) for e in range(9) for i in range(9)], "ep long, f long, x double"), ["ep"], "f", "x", 1.0, 0.5, 9.0)
    with_work = seen.select("ep", F.spark_partition_id().alias("p")).distinct()
    assert with_work.select("p").distinct().count() > 1  # not in one task, however few the bytes


def quats(spark, q):
    return spark.createDataFrame([(1, i, [float(v) for v in row]) for i, row in enumerate(q)], "ep long, f long, q array<double>")


def test_quaternions(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(size=(60, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q[20] = [0, 0, 1, 0]
    q[19] = [1, 0, 0, 0]  # a dot of exactly zero
    got = np.array([r["continuous"] for r in G.continuous(quats(spark, q), ["ep"], "f", "q").orderBy("f").collect()])
    want = q.copy()
    for i in range(1, 60):
        if want[i] @ want[i - 1] < 0:
            want[i] = -want[i]
    assert np.allclose(got, want)
    limited = np.array([r["q_limited"] for r in G.angular_limits(quats(spark, q[:12]), ["ep"], "f", "q", 0.6).orderBy("f").collect()])
    want = q[:12].copy()
    for _ in range(96):  # each pair too far apart meets half the excess, along the arc
        for i in (*range(11), *range(10, -1, -1)):
            a, b = want[i], want[i + 1] * (1 if want[i] @ want[i + 1] >= 0 else -1)
            theta = math.acos(min(1.0, a @ b))
            if 2 * theta - 0.6 > 1e-10:
                side = (b - (a @ b) * a) / np.linalg.norm(b - (a @ b) * a)
                t = theta * (2 * theta - 0.6) / (4 * theta)
                want[i], want[i + 1] = math.cos(t) * a + math.sin(t) * side, math.cos(theta - t) * a + math.sin(theta - t) * side
        if max(2 * math.acos(min(1.0, abs(float(a @ b)))) for a, b in zip(want, want[1:])) <= 0.6 + 1e-10:
            break
    assert np.allclose(np.abs((limited * want).sum(1)), 1, atol=1e-9)
    assert (np.sum(limited[1:] * limited[:-1], axis=1) >= 0).all()
    kept = np.array([r["q_kept"] for r in G.medoid_filter(quats(spark, q), ["ep"], "f", "q", 5, 1.0, 0.1).orderBy("f").collect()])
    angle = lambda a, b: 2 * math.acos(min(1.0, abs(float(a @ b))))
    for i in range(60):
        near = q[max(0, i - 2) : i + 3]
        cost = [sum(angle(a, b) for b in near) for a in near]
        m = near[int(np.argmin(cost))]
        d = np.array([angle(a, m) for a in near])
        limit = max(0.1, np.median(d) + 1.4826 * np.median(np.abs(d - np.median(d))))
        assert abs(kept[i] @ (m if angle(q[i], m) > limit + 1e-9 else q[i])) > 1 - 1e-9
    assert (np.sum(kept[1:] * kept[:-1], axis=1) >= -1e-12).sum() >= 58  # signs are continuous but at a dot of zero


def test_visibility(spark):
    camera = G.Camera(100, 100, 50, 40, 100, 80)
    rows = [(0, [[0.0, 0.0, 1.0], [2.0, 0.0, 1.0]]), (1, [[2.0, 0.0, 1.0], [2.0, 0.0, 1.0]]), (2, [[0.0, 0.0, -1.0], [0.0, math.nan, 1.0]])]
    df = spark.createDataFrame(rows, "f long, p array<array<double>>")
    assert [r[0] for r in df.select(G.visible_landmarks(F.col("p"), camera, 0.0) >= 1).collect()] == [True, False, False]
    fused = spark.createDataFrame([(True, [0.0]), (False, [1.0]), (False, [0.55]), (None, None)], "v boolean, c array<double>")
    assert [r[0] for r in fused.select(G.fuse_visibility(F.col("v"), F.col("c"))).collect()] == [True, True, False, False]
    with pytest.raises(Exception, match="different frames"):
        G.aligned(spark.range(3), spark.range(4), ["id"]).collect()
    with pytest.raises(ValueError):
        camera.scaled(1.5)


def test_session_camera(spark):
    from framewright.sources.tables import SESSION

    rows = [(((400.0, 400.0), (320.0, 240.0), (1000.0, 800.0), (500.0, 200.0)), None, None), (None, (1.0, 2.0, 3.0, 4.0), None), (None, None, None)]
    df = spark.createDataFrame([tuple([tuple(list(x) for x in r[0]) if r[0] else None, r[1], r[2]]) for r in rows], SESSION)
    s = F.struct("camera_calibration", "projection_defaults")
    got = [tuple(r[0]) for r in df.select(G.session_camera(s, F.lit(640.0), F.lit(480.0))).collect()]
    # sensor 1000 x 800, view 500 x 200: scales 0.5 and 0.25, over the larger 1 and 0.5
    assert np.allclose(got[0], (400 * 640 / 1000, 400 * 480 / 400, 320 * 640 / 1000, 480 - (240 - 200) * 480 / 400))
    assert got[1] == (1.0, 2.0, 3.0, 476.0) and np.allclose(got[2], (854.844970703125, 854.844970703125, 642.5776977539062, 480 - 645.1429443359375))


def test_mask_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(M.overlap(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0]
    blend = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "a double").select(M.blended(F.lit(0.0), F.lit(200.0), F.col("a")), M.over(F.lit(1.0), F.lit(0.5), F.lit(0.0)))
    assert [tuple(r) for r in blend.collect()] == [(0, 2), (100, 2), (200, 2)]
    samples = spark.createDataFrame([(1, 10.0, 0.0), (1, 10.0, 1.0), (2, 3.0, 0.0)], "c long, v double, a double")
    assert sorted(map(tuple, M.accumulate(samples, ["c"], "v", "a").collect())) == [(1, 5.0, 0.5, 10.0), (2, 0.0, 0.0, 0.0)]


def test_batch(spark):
    assert sorted(r[0] for r in B.selected(spark, "1,3-5, 4").collect()) == [1, 3, 4, 5]
    with pytest.raises(Exception, match="descending"):
        B.selected(spark, "5-3").collect()
    names = spark.createDataFrame([("b",), ("10",), ("9",), ("a",)], "n string")
    assert [r[0] for r in names.orderBy(*B.numeric_order("n")).collect()] == ["9", "10", "a", "b"]
    jobs = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 3, 3, 2, 2, 9])], "g string, i long, c long")
    got = {r["i"]: r["lane"] for r in B.assign_lanes(jobs, ["g"], "c", [F.desc("c"), F.col("i")], 2).collect()}
    loads, want = [0, 0], {}
    for c, i in sorted([(5, 0), (3, 1), (3, 2), (2, 3), (2, 4), (9, 5)], key=lambda x: (-x[0], x[1])):
        lane = loads.index(min(loads))
        loads[lane] += c
        want[i] = lane
    assert got == want
    v = spark.createDataFrame([("1.2.3",), ("2.0rc1.x.4",), ("x",)], "v string").select(B.version_tuple(F.col("v")))
    assert [r[0] for r in v.collect()] == [[1, 2, 3], [2, 1], []]
    frames = spark.createDataFrame([("12", 1.0), (None, 0.5), ("N/A", 1.5)], "n string, d double").select(B.integer_frames(F.col("n"), F.col("d"), F.lit(3), F.lit(1)))
    assert [r[0] for r in frames.collect()] == [12, 2, 4]


def test_provenance(spark):
    a = spark.createDataFrame([(1, {"x": "1", "y": "2", "z": None})], "k long, meta map<string,string>")
    b = spark.createDataFrame([(1, {"x": "1", "y": "3", "z": None, "w": "4"})], "k long, meta map<string,string>")
    assert sorted(map(tuple, B.provenance_diff(a, b, ["k"]).collect())) == [(1, "w", None, "4"), (1, "y", "2", "3")]


def test_sources(spark, tmp_path):
    from framewright.sources import tables as T

    (tmp_path / "lock.txt").write_text("numpy==1.2 # pinned\n\nPandas==3\n")
    assert sorted(map(tuple, T.read_locks(spark, str(tmp_path / "lock.txt")).collect())) == [("numpy", "1.2"), ("pandas", "3")]
    (tmp_path / "bad.txt").write_text("numpy>=1\n")
    with pytest.raises(Exception, match="not pinned"):
        T.read_locks(spark, str(tmp_path / "bad.txt")).collect()
    for i in (0, 1, 7):
        (tmp_path / f"{i:05d}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes([i]) + b"IEND\xaeB`\x82")
    images = T.read_images(spark, str(tmp_path))
    assert sorted(r["frame"] for r in images.collect()) == [0, 1, 7]
    hashed = B.file_hashes(images)
    assert hashed.count() == 3 and B.file_hashes(images, hashed).count() == 3
    (tmp_path / "session.json").write_text('{"projection_defaults": {"fx": 2.0}}')
    assert T.read_session(spark, str(tmp_path / "session.json")).first()["projection_defaults"]["fx"] == 2.0
    rows = spark.createDataFrame([(1, 30), (1, 10), (1, 20)], "ep long, f long")
    assert sorted(r["f"] for r in T.slice_rows(rows, ["ep"], "f", 1, 3).collect()) == [20, 30]
    with pytest.raises(Exception, match="empty"):
        T.slice_rows(rows, ["ep"], "f", 3, 9).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "00001.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        T.read_images(spark, str(tmp_path / "bad")).collect()
    rows.write.parquet(str(tmp_path / "poses"))
    assert T.count_rows(spark, str(tmp_path / "poses")) == 3
    table = rows.selectExpr("f AS camera_frame_index", "array(1.0, 2.0) AS p", "ep")
    table.write.parquet(str(tmp_path / "aligned"))
    assert T.read_pose_table(spark, str(tmp_path / "aligned"), "p").columns == ["camera_frame_index", "p"]


def test_live_bridge_equals_batch(spark, tmp_path):
    from framewright.streaming.live import bridge_gaps_live

    rng = np.random.default_rng(4)
    seen = {e: (rng.random(60) < 0.5) for e in range(3)}
    schema = "episode long, frame long, seen boolean"
    for part in range(4):
        rows = [(e, int(i), bool(seen[e][i])) for e in seen for i in range(part * 15, part * 15 + 15)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = bridge_gaps_live(stream, 2).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    done = query.awaitTermination(90)
    query.stop()
    assert done
    got = {(r["episode"], r["frame"]): r["seen"] for r in spark.table("live").collect()}
    whole = spark.createDataFrame([(e, i, bool(v)) for e in seen for i, v in enumerate(seen[e])], schema)
    want = {(r["episode"], r["frame"]): r["seen"] for r in I.bridge_gaps(whole, ["episode"], "frame", "seen", 2).collect()}
    assert all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 3 * 2


def test_operators_keep_columns_of_any_name(spark):
    names = ["_run", "_new", "_w", "_m", "_d", "_u", "_n", "_p", "_px", "_o", "_l", "_r", "_t", "_place", "_before_v", "_c"]
    rows = [(1, i, i % 3 == 0, float(i * i % 7), [0.0, 0.0, 0.0, 1.0], *(f"{n}{i}" for n in names)) for i in range(9)]
    df = spark.createDataFrame(rows, "ep long, f long, v boolean, x double, q array<double>, " + ", ".join(f"`{n}` string" for n in names))
    kept = lambda out: [tuple(r[n] for n in names) for r in out.orderBy("f").collect()]
    want = kept(df)
    w = S.kernel(3)
    for out in (
        I.bridge_gaps(df, ["ep"], "f", "v", 1), I.pad_intervals(df, ["ep"], "f", "v", 1, 1), I.interpolate_gaps(df, ["ep"], "f", "x", "v"), S.hampel(df, ["ep"], "f", "x", 3, 3.0, 0.1), S.gaussian(df, ["ep"], "f", "x", 3),
        S.unwrap(df, ["ep"], "f", "x"), S.held_window(df, ["ep"], "f", "x", 2, "near"), G.continuous(df, ["ep"], "f", "q"), G.medoid_filter(df, ["ep"], "f", "q", 3, 1.0, 0.1), G.quaternion_mean(df, ["ep"], "f", "q", w),
        B.assign_lanes(df.withColumn("cost", F.col("f")), ["ep"], "cost", [F.col("f")], 2), S.trailing_rows(df, ["ep"], "f", 9),
    ):
        assert kept(out) == want and not [c for c in out.columns if c.startswith("__fw")]


def test_null_flags_are_false(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, None), (1, 2, True), (1, 3, None), (1, 4, None)], "ep long, f long, v boolean")
    assert text_of(I.bridge_gaps(df, ["ep"], "f", "v", 1)) == "T T T F F"
    both = df.withColumn("w", F.lit(None).cast("boolean"))
    got = I.adaptive_chunks(both, ["ep"], "f", "v", "w", gap=1, entry=0, exit=0, shortest=1, longest=9).collect()
    assert [tuple(r) for r in got] == [(1, "left", 0, 3)]
