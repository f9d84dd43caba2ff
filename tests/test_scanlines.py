"""Masks as scan lines against plain loops over small rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import scanlines as L

W, H = 23, 17


def table(spark, masks, extra=""):
    """Masks by frame number (of episode 1) as lines."""
    rows = [(1, i, int(y), int(x), int(x) + 1) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    runs = spark.createDataFrame(rows, "episode long, frame long, y int, a int, b int")
    frames = spark.createDataFrame([(1, i) for i in range(len(masks))], "episode long, frame long")
    return L.lines_of(runs, ["episode", "frame"], frames, masks[0].shape[0])


def rasters(lines, n, shape=(H, W)):
    out = np.zeros((n, *shape), bool)
    rows = lines.select("frame", "y", "runs").collect()
    assert len(rows) == n * shape[0]  # empty lines too
    for r in rows:
        last = -1
        for x in r["runs"]:
            assert last < x["a"] < x["b"] <= shape[1]  # sorted, apart
            out[r["frame"], r["y"], x["a"] : x["b"]] = True
            last = x["b"]
    return out


def dilate(mask, window):
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        for dy, w in window.items():
            if 0 <= y + dy < mask.shape[0]:
                out[y + dy, max(0, x - w) : x + w + 1] = True
    return out


def erode(mask, window):
    return ~dilate(~mask, window)


def tidy(mask):
    closed = erode(dilate(mask, L.ellipse(5)), L.ellipse(5))
    return dilate(erode(closed, L.ellipse(3)), L.ellipse(3))


def labels(mask):
    seen, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return seen


def distance(mask, clip):
    out = np.full(mask.shape, float(clip))
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            yy, xx = np.nonzero(mask != mask[y, x])
            if len(yy):
                out[y, x] = min(clip, np.sqrt(((yy - y) ** 2 + (xx - x) ** 2).min()))
    return np.where(mask, out, -out)


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(4)
    blob = np.zeros((H, W), bool)
    blob[4:12, 5:16] = True
    noisy = [rng.random((H, W)) < p for p in (0.2, 0.45, 0.7)]
    return [*noisy, blob, np.zeros((H, W), bool), np.ones((H, W), bool), blob ^ (rng.random((H, W)) < 0.06)]


def test_morphology_equals_loops(spark, masks):
    assert L.ellipse(3) == {-1: 0, 0: 1, 1: 0} and L.ellipse(5) == {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
    lines = L.settled(table(spark, masks))
    keys = ["episode", "frame"]
    assert (rasters(lines, len(masks)) == np.array(masks)).all()
    assert (rasters(L.grown(lines, keys, L.diamond(3), W), len(masks)) == [dilate(m, L.diamond(3)) for m in masks]).all()
    assert (rasters(L.eroded(lines, keys, L.ellipse(5), W), len(masks)) == [erode(m, L.ellipse(5)) for m in masks]).all()
    assert (rasters(L.closed_opened(lines, keys, W), len(masks)) == [tidy(m) for m in masks]).all()


def test_parts_equal_flood_fill(spark, masks):
    lines = table(spark, masks)
    got = np.zeros((len(masks), H, W), np.int64)
    for r in L.parts(lines, ["episode", "frame"]).collect():
        got[r["frame"], r["y"], r["a"] : r["b"]] = r["part"] + 1
    for own, m in zip(got, masks):
        want = labels(m)
        pairs = set(zip(own.ravel().tolist(), want.ravel().tolist()))
        assert len(pairs) == len(set(own.ravel())) == len(set(want.ravel())) and ((own > 0) == m).all()


def test_cleaning_keeps_wanted_parts(spark, masks):
    seeds = [(2.4, 3.0), (float("nan"), 1.0), (-50.0, 8.0)]
    column = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in seeds))
    got = rasters(L.cleaned(table(spark, masks), ["episode", "frame"], W, H, column, 12), len(masks))
    for own, m in zip(got, masks):
        label = labels(tidy(m))
        keep = set(label[-3:].ravel()) | set(label[:, -3:].ravel())
        for u, v in seeds:
            if np.isfinite([u, v]).all():
                x, y = int(np.clip(round(u), 0, W - 1)), int(np.clip(round(v), 0, H - 1))
                keep |= set(label[max(0, y - 5) : y + 6, max(0, x - 5) : x + 6].ravel())
        want = np.isin(label, [k for k in keep if k and (label == k).sum() >= 12]) if keep - {0} else np.zeros_like(m)
        assert (own == want).all()


@pytest.mark.parametrize("clip", [3.0, 7.5])
def test_distances_equal_loops(spark, masks, clip):
    got = np.zeros((len(masks), H, W))
    for r in L.distances(table(spark, masks), ["episode", "frame"], W, clip).collect():
        got[r["frame"], r["y"]] = r["distance"]
    assert np.allclose(got, [distance(m, clip) for m in masks])
    assert (got[4] == -clip).all() and (got[5] == clip).all()


def test_feathered_rings(spark):
    dot = np.zeros((41, 41), bool)
    dot[20, 20] = True
    alpha = np.zeros((41, 41))
    for r in L.feathered(table(spark, [dot]), ["episode", "frame"], 41, 10, 4).collect():
        for x in r["alpha"]:
            assert not alpha[r["y"], x["a"] : x["b"]].any()
            alpha[r["y"], x["a"] : x["b"]] = x["alpha"]
    far = np.abs(np.arange(41) - 20)[:, None] + np.abs(np.arange(41) - 20)
    assert np.allclose(alpha, np.clip(1 - (far - 10) / 5, 0, 1))


def steadied(masks, moved=None):
    ok, out = [m.any() and not m.all() for m in masks], []
    for i, m in enumerate(masks):
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(masks) and ok[j]]
        if not ok[i] or not near:
            out.append(m if ok[i] else np.zeros_like(m))
            continue
        field = distance(m, 3.0) + sum(0.35 * distance(masks[j] if moved is None else moved[j < i][i], 3.0) for j in near)
        new = tidy(field > 0)
        out.append(new if 0.65 <= new.sum() / m.sum() <= 1.35 else m)
    return out


def test_stabilised_equals_loops(spark, masks):
    order = [masks[k] for k in (3, 6, 3, 4, 6, 5, 0, 1, 2)]
    got = rasters(L.stabilised(table(spark, order), ["episode"], "frame", W, clip=3.0), len(order))
    assert (got == steadied(order)).all()
    # neighbours that a known motion has brought here
    right = [np.roll(masks[3], k, axis=1) for k in (0, 2, 4)]
    before, after = [np.roll(right[0], 2 * i, axis=1) for i in range(3)], [np.roll(right[0], 2 * i, axis=1) for i in range(3)]
    got = rasters(L.stabilised(table(spark, right), ["episode"], "frame", W, clip=3.0, before=table(spark, before), after=table(spark, after)), 3)
    assert (got == steadied(right, {True: before, False: after})).all() and (got[1] == tidy(right[1])).all()


def test_shapes_equal_loops(spark):
    rng = np.random.default_rng(3)
    shapes = [(k, *map(float, rng.integers(-6, 30, 4)), float(rng.integers(1, 7))) for k in range(80)]
    shapes += [(80, 4.0, 4.0, 4.0, 4.0, 5.0), (81, 3.0, 8.0, 15.0, 8.0, 3.0), (82, 9.0, 2.0, 9.0, 12.0, 2.0), (83, 90.0, 90.0, 95.0, 95.0, 2.0)]
    df = spark.createDataFrame(shapes, "frame long, au double, av double, bu double, bv double, radius double")
    got = rasters(L.lines_of(L.capsule_rows(df, ["frame"], W, H), ["frame"], df, H), len(shapes))
    y, x = np.mgrid[:H, :W]
    for (k, au, av, bu, bv, r), own in zip(shapes, got):
        du, dv = bu - au, bv - av
        n = du * du + dv * dv
        t = np.clip(((x - au) * du + (y - av) * dv) / n, 0, 1) if n else 0.0
        assert (own == ((x - au - t * du) ** 2 + (y - av - t * dv) ** 2 <= r * r)).all(), k


def test_hands_corridors_and_sleeves(spark):
    px = [(40.0 + 2 * i, 30.0 + i) for i in range(21)]
    axis = "struct<base: struct<u: double, v: double>, end: struct<u: double, v: double>>"
    rows = [(0, [u for u, _ in px], [v for _, v in px], [1.0] * 21, [0.9] * 3 + [0.1] * 18, ((40.0, 30.0), (0.0, 30.0))), (1, [u for u, _ in px], [v for _, v in px], [1.0] * 21, [0.9] * 6 + [0.1] * 15, None)]
    df = spark.createDataFrame(rows, f"frame long, u array<double>, v array<double>, z array<double>, sure array<double>, axis {axis}")
    area = lambda shapes: {r["frame"]: r["n"] for r in L.lines_of(L.capsule_rows(shapes, ["frame"], 160, 120), ["frame"], df, 120).groupBy("frame").agg(F.sum(L.pixels(F.col("runs"))).alias("n")).collect()}
    every, sure = area(L.hand_shapes(df, ["frame"], "u", "v", "z", 160, 120)), area(L.hand_shapes(df, ["frame"], "u", "v", "z", 160, 120, F.col("sure")))
    assert sure[0] == every[0] and 0 < sure[1] < every[1]  # too few to choose among, and enough
    wide = area(L.corridor_shapes(df, ["frame"], "axis", L.corridor_radius("u", "v", 160, 120)))
    assert wide[1] == 0 and wide[0] == sum(1 for y in range(120) for x in range(160) if (max(0, x - 40)) ** 2 + (y - 30) ** 2 <= 58**2)  # 58 pixels at least
    fitted = L.sleeve_shapes(df.withColumn("radii", F.array_repeat(F.lit(20.0), 12)), ["frame"], "axis", "radii", F.lit(2.0))
    assert {r["radius"] for r in fitted.collect()} == {26.0} and fitted.count() == 48  # scaled by 1.28 at most
    assert area(fitted)[1] == 0


def test_warped_resized_and_blurred(spark, masks):
    cells = spark.createDataFrame([(1, i, int(x), int(y)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))], "episode long, frame long, x long, y long")
    rng = np.random.default_rng(9)
    flow = rng.normal(0, 3, (len(masks), H, W, 2))
    motion = spark.createDataFrame([(i, x, y, *map(float, flow[i, y, x])) for i in range(len(masks)) for y in range(H) for x in range(W)], "frame long, x long, y long, dx double, dy double")
    got = np.zeros((len(masks), H, W), bool)
    for r in L.warped(cells, ["episode", "frame"], motion, W, H).collect():
        got[r["frame"], r["y"], r["x"]] = True
    for i, m in enumerate(masks):
        for y in range(H):
            for x in range(W):
                sx, sy = round(x + flow[i, y, x, 0]), round(y + flow[i, y, x, 1])
                assert got[i, y, x] == (0 <= sx < W and 0 <= sy < H and m[sy, sx])
    runs = table(spark, masks).select("episode", "frame", "y", F.inline("runs"))
    for w2, h2 in ((46, 10), (9, 40), (23, 17)):
        frames = runs.select("episode", "frame").union(spark.createDataFrame([(1, i) for i in range(len(masks))], "episode long, frame long"))
        lines = L.lines_of(L.resized(runs, ["episode", "frame"], (W, H), (w2, h2)), ["episode", "frame"], frames, h2)
        got = rasters(lines, len(masks), (h2, w2))
        assert (got == [m[np.arange(h2) * H // h2][:, np.arange(w2) * W // w2] for m in masks]).all()
    flat = table(spark, masks).withColumn("alpha", F.transform(L.flags(F.col("runs"), W), lambda m: m.cast("double"))).withColumn("colour", F.transform("alpha", lambda a: a * 3))
    soft = L.soft_matte(flat, ["episode", "frame"], ["colour"], "alpha", 0.9, W, H)
    half = 4
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / 0.9) ** 2)
    taps /= taps.sum()
    out = np.zeros((len(masks), H, W, 2))
    for r in soft.collect():
        out[r["frame"], r["y"]] = np.column_stack([r["alpha"], r["colour"]])
    for own, m in zip(out, masks):
        wide = np.pad(m.astype(float), half, mode="reflect")
        blur = sum(taps[j] * taps[k] * wide[j : j + H, k : k + W] for j in range(2 * half + 1) for k in range(2 * half + 1))
        assert np.allclose(own[..., 0], blur) and np.allclose(own[..., 1], np.minimum(np.minimum(1, 3 * blur), own[..., 0]))
    with pytest.raises(ValueError):
        L.blurred(flat, ["frame"], ["alpha"], 5.0, W, H)


def test_empty_tables(spark):
    lines = table(spark, [np.zeros((H, W), bool)]).limit(0)
    keys = ["episode", "frame"]
    assert L.cleaned(lines, keys, W, H).count() == 0 and L.distances(lines, keys, W, 3.0).count() == 0 and L.stabilised(lines, ["episode"], "frame", W).count() == 0


def test_blurs_and_distances_are_one_pass_over_whole_frames(spark):
    frames = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    lines = L.lines_of(spark.createDataFrame([(1, 2, 1, 4), (None, 0, 0, 6)], "k int, y int, a int, b int"), ["k"], frames, 6)
    values = lines.withColumn("v", F.transform(L.flags(F.col("runs"), 6), lambda x: x.cast("double")))
    soft, far = L.blurred(values, ["k"], ["v"], 0.4, 6, 6), L.distances(lines, ["k"], 6, 2.0)
    for df in (soft, far):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "lag(" not in plan and "lead(" not in plan  # no column for each line above and below
    image = np.zeros((6, 6))
    image[2, 1:4] = 1
    taps = np.exp(-0.5 * (np.arange(-2, 3) / 0.4) ** 2)
    wide = np.pad(image, 2, mode="reflect")
    want = sum(a * b * wide[i : i + 6, j : j + 6] for i, a in enumerate(taps / taps.sum()) for j, b in enumerate(taps / taps.sum()))
    assert np.allclose([r["v"] for r in soft.filter("k = 1").orderBy("y").collect()], want)
    assert {(r["k"], r["y"]): r["distance"] for r in far.collect()}[None, 1] == [-1.0] * 6
    with pytest.raises(Exception, match="a frame lacks lines"):
        L.blurred(values.filter("y <> 3"), ["k"], ["v"], 0.4, 6, 6).collect()


def test_parts_and_cleaning_need_no_rounds(spark, tmp_path):
    # a spiral takes a contraction many rounds of shuffles and checkpoints
    side = 33
    spiral, x, y, dx, dy, turned = np.zeros((side, side), bool), 0, 0, 1, 0, 0
    while turned < 2:
        spiral[y, x], ahead = True, (x + 2 * dx, y + 2 * dy)
        if not (0 <= x + dx < side and 0 <= y + dy < side) or (0 <= ahead[0] < side and 0 <= ahead[1] < side and spiral[ahead[1], ahead[0]]):
            dx, dy, turned = -dy, dx, turned + 1
        else:
            x, y, turned = x + dx, y + dy, 0
    dots = np.zeros((side, side), bool)
    dots[::2, ::2] = True
    lines = table(spark, [spiral, dots, spiral.T])
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        rows = L.parts(lines, ["episode", "frame"])
        kept = L.keep_parts(lines, ["episode", "frame"], side, side, 2)
        steady = L.stabilised(L.cleaned(lines.withColumn("more", F.lit(5)), ["episode", "frame"], side, side), ["episode"], "frame", side)
        assert jobs() == 0  # nothing runs before an action
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert steady.columns == [*lines.columns, "more"]
    part = {i: {r["part"] for r in rows.filter(f"frame = {i}").collect()} for i in range(3)}
    assert part[0] == part[2] == {0} and part[1] == {(1 << 24) * j + i for j in range(0, side, 2) for i in range(0, side, 2)}
    got = np.zeros((3, side, side), bool)
    for r in kept.collect():
        for run in r["runs"]:
            got[r["frame"], r["y"], run["a"] : run["b"]] = True
    assert (got == [spiral, np.zeros_like(dots), spiral.T]).all()


def test_capsules_of_a_frame_leave_as_united_runs(spark):
    shapes = [(k, 2.0 + i, 5.0, 9.0 + i, 5.0, 2.0) for k in (1, None) for i in range(6)] + [(2, None, 1.0, 2.0, 1.0, 3.0)]
    df = spark.createDataFrame(shapes, "k int, au double, av double, bu double, bv double, radius double").coalesce(1)
    got = sorted(((r["k"], r["y"], r["a"], r["b"]) for r in L.capsule_rows(df, ["k"], W, H).collect()), key=str)
    assert got == sorted(((k, y, a, b) for k in (1, None) for y, a, b in ((3, 2, 15), (4, 1, 16), (5, 0, 17), (6, 1, 16), (7, 2, 15))), key=str)
