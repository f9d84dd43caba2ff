"""Queries against brute-force versions on small tables."""

import math
import random

from framewright.operators import masks as M
from framewright.plans import masks, rasters, recordings, visibility

W, H = 64, 48
FIVE = [(0, -2), (0, 2)] + [(x, y) for x in range(-2, 3) for y in (-1, 0, 1)]
CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
ALL = [(x, y) for x in range(W) for y in range(H)]


def dilated(cells, kernel):
    return {(x + a, y + b) for x, y in cells for a, b in kernel if 0 <= x + a < W and 0 <= y + b < H}


def eroded(cells, kernel):
    return set(ALL) - dilated(set(ALL) - cells, kernel)


def cleaned(cells):
    closed = eroded(dilated(cells, FIVE), FIVE)
    return dilated(eroded(closed, CROSS), CROSS)


def drawn(points):
    bones = [(0 if k == 0 else 4 * f + k, 4 * f + k + 1) for f in range(5) for k in range(4)]

    def near(x, y, p, q):
        d, e = (q[0] - p[0], q[1] - p[1]), (x - p[0], y - p[1])
        t = min(1, max(0, (e[0] * d[0] + e[1] * d[1]) / (d[0] ** 2 + d[1] ** 2)))
        return (e[0] - t * d[0]) ** 2 + (e[1] - t * d[1]) ** 2 <= 4

    return {(x, y) for x, y in ALL if any(near(x, y, points[i], points[j]) for i, j in bones)}


def large_parts(cells):
    left, out = set(cells), set()
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for n in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
        if len(part) >= 8 and any(x >= W - 3 or y >= H - 3 or (abs(x - 32) <= 5 and abs(y - 24) <= 5) for x, y in part):
            out |= part
    return out


def distance(cells):
    if not cells or len(cells) == W * H:
        return {c: 3.0 if cells else -3.0 for c in ALL}
    ring = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]
    far = lambda x, y, here: min([3.0] + [math.hypot(a, b) for a, b in ring if 0 <= x + a < W and 0 <= y + b < H and ((x + a, y + b) in cells) != here])
    return {(x, y): far(x, y, True) if (x, y) in cells else -far(x, y, False) for x, y in ALL}


def test_mask_cleanup_draws_and_cleans_whole_hands(spark, tmp_path):
    rng, rows, want = random.Random(3), [], {}
    for episode in range(2):
        shapes, angle = [], rng.uniform(0, 6)
        for i in range(3):
            pixels = [(32.0, 24.0)]
            for finger in range(5):
                a = angle + finger * 1.1 + 0.05 * i
                pixels += [(32 + 5.3 * k * math.cos(a) + rng.uniform(-1, 1), 24 + 5.3 * k * math.sin(a) + rng.uniform(-1, 1)) for k in range(1, 5)]
            rows.append((10 * episode + i, episode, [v for u, w in pixels for v in ((u - 32) / 60, (w - 24) / 60, 1.0)]))
            shapes.append(drawn(pixels))
        clean = [large_parts(cleaned(s)) for s in shapes]
        fields = [distance(c) for c in clean]
        for i, c in enumerate(clean):
            side = [fields[j] for j in (i - 1, i + 1) if 0 <= j < 3]
            new = cleaned({p for p in ALL if fields[i][p] + 0.35 * sum(f[p] for f in side) > 0})
            steady = new if c and 0.65 <= len(new) / len(c) <= 1.35 else c
            want[10 * episode + i] = (len(shapes[i]), len(c), len(steady))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["frame"]: (r["raw"], r["clean"], r["steady"]) for r in rasters.mask_cleanup(spark, str(tmp_path)).collect()}
    assert got == want


def embeddings(spark, tmp_path, rows):
    """Rows (label, vec_id, 21 points) as the table of vectors."""
    flat = [(i, label, [float(x) for p in points for x in p] + [0.0]) for label, i, points in rows]
    spark.createDataFrame(flat, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_point_coverage_equals_cells_without_joins(spark, tmp_path):
    rng = random.Random(4)
    points = [(rng.randint(0, 3), rng.random() * 9, rng.random() * 6) for _ in range(80)]
    runs = [(k, y, a, a + rng.randint(0, 4)) for k in (0, 1, 9) for y in range(6) for a in (rng.randint(0, 4), rng.randint(3, 8))]
    cells = {(k, x, y) for k, y, a, b in runs for x in range(a, b)}
    frames = [0, 1, 2, 7]
    got = M.point_coverage(spark.createDataFrame(points, "k int, u double, v double"), spark.createDataFrame(runs, "k int, y int, a int, b int"), ["k"], spark.createDataFrame([(k,) for k in frames], "k int"))
    own = {k: [(k, int(u), int(v)) in cells for j, u, v in points if j == k] for k in frames}
    assert dict(map(tuple, got.collect())) == {k: sum(own[k]) / len(own[k]) if own[k] else 0.0 for k in frames}
    path = embeddings(spark, tmp_path, [(0, i, [(rng.gauss(0, 0.3), rng.gauss(0, 0.3), 1.0)] * 21) for i in range(20)])
    plan = masks.coverage_leakage(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_markers_of_palms_with_a_knuckle_in_the_camera_plane(spark, tmp_path):
    hand = [(0.1 * i, 0.05 * i, 1.0) for i in range(21)]
    hand[13] = (1.0, 1.0, 0.0)
    got = recordings.palm_markers(spark, embeddings(spark, tmp_path, [(0, 5, hand)])).orderBy("marker").collect()
    u, v = (300.0 * 0.1 * 31 / 3, 300.0 * 0.05 * 31 / 3)  # of the knuckles 5, 9 and 17, from the wrist
    n = math.hypot(u, v)
    assert [(r["u"], r["v"]) for r in got] == [(round(640 - d * u / n, 3), round(360 - d * v / n, 3)) for d in (30.0, 80.0, 140.0)]


def test_rays_that_meet_no_border_end_at_the_origin(spark, tmp_path):
    camera = visibility.CAMERA
    at = lambda u, v: ((u - camera.cx) / camera.fx, (v - camera.cy) / camera.fy, 1.0)
    hands = [(0, i, [at(*wrist)] * 9 + [at(*knuckle)] * 12) for i, (wrist, knuckle) in enumerate([((1279.5, 600.0), (1200.0, 600.0)), ((640.0, 600.0), (630.0, 600.0))])]
    got = {r["frame"]: (r["u"], r["v"]) for r in visibility.ray_to_border(spark, embeddings(spark, tmp_path, hands)).collect()}
    assert got == {0: (0.0, 0.0), 1: (1279.0, 600.0)}
