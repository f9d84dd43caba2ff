"""Queries over masks as scan lines: support shapes, cleaning, distances, warps and mattes, held against the same arithmetic over cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import masks as M
from framewright.operators import poses as P
from framewright.operators import scanlines as L
from framewright.plans.runs import CELLS, _cells
from framewright.plans.visibility import POINTS
from framewright.sources.tables import landmarks

CAMERA = G.Camera(60.0, 60.0, 32.0, 24.0, 64.0, 48.0)
W, H = 40, 12  # of the masks made of events
FRAME, MASK = ["episode", "frame"], ["episode", "frame"]


def hand_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, frame, points, u array, v array, z array): landmarks on an image of 64 x 48."""
    px = F.transform("points", lambda p: G.project(p, CAMERA))
    rows = landmarks(spark, sf_dir).withColumn("px", px)
    return rows.select("episode", "frame", "points", F.transform("px", lambda p: p["u"]).alias("u"), F.transform("px", lambda p: p["v"]).alias("v"), F.transform("points", lambda p: p[2]).alias("z"))


def _areas(shapes: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, columns) of the union of shapes on the image of 64 x 48, for all frames."""
    lines = L.lines_of(L.capsule_rows(shapes, keys, 64, 48), keys, frames, 48)
    return lines.groupBy(*keys).agg(F.sum(L.pixels(F.col("runs"))).alias("area"), F.sum(L.column_sum(F.col("runs"))).alias("columns"))


def hand_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels lie near each frame's hand, by landmarks of enough confidence if four have it."""
    rows = hand_pixels(spark, sf_dir)
    shapes = L.hand_shapes(rows, ["frame"], "u", "v", "z", 64, 48, F.transform("z", lambda z: F.abs(z) * 3))
    return _areas(shapes, rows, ["frame"])


PX = f"{POINTS}, px AS (SELECT frame, landmark, z, CASE WHEN abs(z) > 1e-6 THEN 60.0 * x / z + 32.0 END AS u, CASE WHEN abs(z) > 1e-6 THEN 60.0 * y / z + 24.0 END AS v FROM points)"
GRID = "grid AS (SELECT x, y FROM (SELECT unnest(range(64)) AS x), (SELECT unnest(range(48)) AS y))"


def _shape_sql(radius: int, source: str, out: str) -> str:
    """Cells (frame, x, y) within a radius of the segments (frame, au, av, bu, bv) of a table."""
    t = "CASE WHEN n > 0 THEN least(1.0, greatest(0.0, ((x - au) * du + (y - av) * dv) / n)) ELSE 0.0 END"
    return f"""{out}_long AS (SELECT *, bu - au AS du, bv - av AS dv, (bu - au) * (bu - au) + (bv - av) * (bv - av) AS n FROM {source}),
{out}_near AS (
    SELECT frame, x, y, au, av, du, dv, {t} AS t FROM {out}_long JOIN grid ON x BETWEEN least(au, bu) - {radius} AND greatest(au, bu) + {radius} AND y BETWEEN least(av, bv) - {radius} AND greatest(av, bv) + {radius}
), {out} AS (SELECT DISTINCT frame, x, y FROM {out}_near WHERE pow(x - au - t * du, 2) + pow(y - av - t * dv, 2) <= {radius * radius})"""


def _bones_sql(where: str, out: str, rounded: bool = True) -> str:
    bones = ", ".join(f"({a}, {b})" for a, b in [*M.BONES, *((i, i) for i in range(21))])
    u, v = ("round_even(u, 0)", "round_even(v, 0)") if rounded else ("u", "v")
    return f"""{out}_ok AS (SELECT frame, landmark, {u} AS u, {v} AS v FROM ({where})),
{out} AS (SELECT p.frame, p.u AS au, p.v AS av, q.u AS bu, q.v AS bv FROM (VALUES {bones}) AS t(a, b) JOIN {out}_ok p ON p.landmark = a JOIN {out}_ok q ON q.landmark = b AND q.frame = p.frame)"""


_trusted = """SELECT frame, landmark, u, v FROM (
    SELECT *, count(*) FILTER (sure) OVER (PARTITION BY frame) AS n FROM (SELECT *, abs(z) * 3 >= 0.3 AS sure FROM px WHERE z > 1e-4 AND u >= 0 AND u < 64 AND v >= 0 AND v < 48)
) WHERE sure OR n < 4"""
SUPPORT_SQL = f"""WITH {PX}, {GRID}, {_bones_sql(_trusted, "bones")}, {_shape_sql(4, "bones", "cells")}
SELECT f.frame, count(x) AS area, CAST(coalesce(sum(x), 0) AS BIGINT) AS columns FROM (SELECT DISTINCT frame FROM points) f LEFT JOIN cells c ON f.frame = c.frame GROUP BY 1"""


def _with_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.arm_axis(hand_pixels(spark, sf_dir), "points", F.col("points")[0], F.col("points")[20], CAMERA)


def arm_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corridor of six pixels along each arm that has an anchor, and the hand: how many pixels."""
    rows = _with_axis(spark, sf_dir)
    arms = L.anchored(rows, "axis")
    shapes = L.corridor_shapes(rows, ["frame"], "axis", 6.0).unionByName(L.hand_shapes(arms, ["frame"], "u", "v", "z", 64, 48, radius=L.wide_radius(64, 48)))
    return _areas(shapes, arms, ["frame"])


ENVELOPE_SQL = f"""WITH {PX}, {GRID}, ok AS (SELECT *, coalesce(u >= 0 AND u <= 63 AND v >= 0 AND v <= 47, false) AS inside FROM px),
bases AS (
    SELECT frame, coalesce(max(u) FILTER (landmark = 0 AND inside), avg(u) FILTER (landmark IN (5, 9, 13, 17) AND inside), avg(u) FILTER (inside)) AS bx,
        coalesce(max(v) FILTER (landmark = 0 AND inside), avg(v) FILTER (landmark IN (5, 9, 13, 17) AND inside), avg(v) FILTER (inside)) AS by_,
        max(u) FILTER (landmark = 20) - max(u) FILTER (landmark = 0) AS dx, max(v) FILTER (landmark = 20) - max(v) FILTER (landmark = 0) AS dy FROM ok GROUP BY frame
), times AS (SELECT *, unnest([(0 - bx) / dx, (63 - bx) / dx, (0 - by_) / dy, (47 - by_) / dy]) AS t, unnest(['x', 'x', 'y', 'y']) AS side FROM bases WHERE bx IS NOT NULL),
hits AS (SELECT frame, bx, by_, dx, dy, min(t) FILTER (t > 0 AND CASE WHEN side = 'x' THEN by_ + t * dy BETWEEN -1e-3 AND 47.001 ELSE bx + t * dx BETWEEN -1e-3 AND 63.001 END) AS t FROM times GROUP BY ALL),
axes AS (SELECT frame, round_even(bx, 0) AS au, round_even(by_, 0) AS av, round_even(least(63.0, greatest(0.0, bx + t * dx)), 0) AS bu, round_even(least(47.0, greatest(0.0, by_ + t * dy)), 0) AS bv FROM hits WHERE t IS NOT NULL),
{_bones_sql("SELECT * FROM px WHERE z > 1e-4 AND u >= 0 AND u < 64 AND v >= 0 AND v < 48", "bones")}, {_shape_sql(6, "axes", "corridor")}, {_shape_sql(8, "bones", "hand")},
cells AS (SELECT * FROM corridor UNION SELECT h.* FROM hand h JOIN axes a ON h.frame = a.frame)
SELECT frame, count(*) AS area, CAST(sum(x) AS BIGINT) AS columns FROM cells GROUP BY 1"""


SLEEVES_SQL = (
    ENVELOPE_SQL[: ENVELOPE_SQL.index("axes AS (SELECT")]
    + f"""ends AS (SELECT h.*, least(63.0, greatest(0.0, bx + t * dx)) AS ex, least(47.0, greatest(0.0, by_ + t * dy)) AS ey FROM hits h WHERE t IS NOT NULL),
widths AS (SELECT frame, least(1.28, greatest(0.78, (max(u) - min(u)) / 200.0)) AS k FROM px GROUP BY 1),
discs AS (
    SELECT e.frame, round_even(bx + i / 23.0 * (ex - bx), 0) AS cx, round_even(by_ + i / 23.0 * (ey - by_), 0) AS cy, greatest(1.0, round_even((2 + i / 23.0 * 5) * k, 0)) AS r
    FROM ends e JOIN widths w ON w.frame = e.frame, (SELECT CAST(unnest(range(24)) AS DOUBLE) AS i)
), sleeve AS (SELECT DISTINCT frame, x, y FROM discs JOIN grid ON pow(x - cx, 2) + pow(y - cy, 2) <= r * r),
{_bones_sql("SELECT * FROM px WHERE z > 1e-4 AND u >= 0 AND u < 64 AND v >= 0 AND v < 48", "bones")}, {_shape_sql(8, "bones", "hand")},
cells AS (SELECT * FROM sleeve UNION SELECT h.* FROM hand h JOIN ends e ON h.frame = e.frame)
SELECT frame, count(*) AS area, CAST(sum(x) AS BIGINT) AS columns FROM cells GROUP BY 1"""
)


def adaptive_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs along each arm with the radii of a profile (2 to 7 pixels by bin), scaled by how wide the hand is, and the hand."""
    rows = _with_axis(spark, sf_dir).withColumn("radii", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i + 2).cast("double")))
    arms = L.anchored(rows, "axis")
    scale = (F.array_max("u") - F.array_min("u")) / 200.0
    shapes = L.sleeve_shapes(arms, ["frame"], "axis", "radii", scale).unionByName(L.hand_shapes(arms, ["frame"], "u", "v", "z", 64, 48, radius=L.wide_radius(64, 48)))
    return _areas(shapes, arms, ["frame"])


def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, frame, x, y): events of an episode by twelves as masks of 40 x 12 cells."""
    return _cells(spark, sf_dir).select("episode", "frame", "x", "y")


def small_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those masks as lines."""
    cells = small_cells(spark, sf_dir)
    return L.lines_of(cells.select(*MASK, "y", F.col("x").alias("a"), (F.col("x") + 1).alias("b")), MASK, cells, H)


MASKS = f"{CELLS}, cell AS (SELECT DISTINCT episode, frame, x, y FROM cells), grid AS (SELECT x, y FROM (SELECT unnest(range({W})) AS x), (SELECT unnest(range({H})) AS y))"


def soft_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks grown by two steps and feathered by three rings: the sum of their alpha."""
    rings = L.feathered(small_masks(spark, sf_dir), MASK, W, 2, 3)
    line = F.aggregate("alpha", F.lit(0.0), lambda s, r: s + r["alpha"] * (r["b"] - r["a"]))
    return rings.groupBy(*MASK).agg(F.round(F.sum(line), 6).alias("alpha"))


ALPHA_SQL = f"""WITH {MASKS}, far AS (SELECT episode, frame, g.x, g.y, min(abs(g.x - c.x) + abs(g.y - c.y)) AS d FROM cell c, grid g WHERE abs(g.x - c.x) + abs(g.y - c.y) <= 5 GROUP BY ALL)
SELECT episode, frame, round(sum(CASE WHEN d <= 2 THEN 1.0 ELSE 1.0 - (d - 2) / 4.0 END), 6) AS alpha FROM far GROUP BY 1, 2"""


def signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the border, 3 at most: their sums inside and outside each mask."""
    lines = L.distances(small_masks(spark, sf_dir), MASK, W, 3.0)
    total = lambda ok: F.round(F.sum(F.aggregate(F.filter("distance", ok), F.lit(0.0), lambda s, x: s + x)), 5)
    return lines.groupBy(*MASK).agg(total(lambda x: x > 0).alias("inside"), total(lambda x: x <= 0).alias("outside"))


DISTANCE_SQL = f"""WITH {MASKS}, frames_ AS (SELECT DISTINCT episode, frame FROM cell), flags AS (SELECT f.episode, f.frame, g.x, g.y, c.x IS NOT NULL AS m FROM frames_ f CROSS JOIN grid g LEFT JOIN cell c ON c.episode = f.episode AND c.frame = f.frame AND c.x = g.x AND c.y = g.y),
steps AS (SELECT dx, dy FROM (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy) WHERE dx * dx + dy * dy < 9),
near AS (SELECT a.episode, a.frame, a.x, a.y, min(dx * dx + dy * dy) AS d FROM flags a, steps s JOIN flags b ON b.episode = a.episode AND b.frame = a.frame AND b.x = a.x + dx AND b.y = a.y + dy AND b.m <> a.m GROUP BY ALL),
far AS (SELECT a.episode, a.frame, m, sqrt(coalesce(d, 9)) AS d FROM flags a LEFT JOIN near n ON n.episode = a.episode AND n.frame = a.frame AND n.x = a.x AND n.y = a.y)
SELECT episode, frame, round(coalesce(sum(d) FILTER (m), 0.0), 5) AS inside, round(-coalesce(sum(d) FILTER (NOT m), 0.0), 5) AS outside FROM far GROUP BY 1, 2"""


def warp_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask read at places that a motion names (columns shear by row, rows drift): how many cells, and where."""
    cells = small_cells(spark, sf_dir)
    grid = spark.range(W * H).select((F.col("id") % W).alias("x"), F.floor(F.col("id") / W).alias("y"))
    motion = grid.select("x", "y", (0.4 * F.col("y") - 1.5).alias("dx"), (0.3 * (F.col("x") % 4) - 0.5).alias("dy"))
    moved = L.warped(cells, MASK, motion, W, H).groupBy(*MASK).agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    out = cells.select(*MASK).distinct().join(moved, MASK, "left")
    return out.select(*MASK, F.coalesce("n", F.lit(0)).cast("long").alias("area"), F.coalesce("s", F.lit(0)).cast("long").alias("columns"))


WARP_SQL = f"""WITH {MASKS}, moved AS (SELECT x, y, round_even(x + (0.4::DOUBLE * y - 1.5::DOUBLE), 0) AS sx, round_even(y + (0.3::DOUBLE * (x % 4) - 0.5::DOUBLE), 0) AS sy FROM grid),
hits AS (SELECT episode, frame, m.x FROM cell c JOIN moved m ON sx = c.x AND sy = c.y)
SELECT f.episode, f.frame, count(h.x) AS area, CAST(coalesce(sum(h.x), 0) AS BIGINT) AS columns FROM (SELECT DISTINCT episode, frame FROM cell) f LEFT JOIN hits h ON h.episode = f.episode AND h.frame = f.frame GROUP BY 1, 2"""


def soft_matte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mattes blurred in premultiplied colour (a grey that rises along the row) and composited over half grey: sums."""
    lines = small_masks(spark, sf_dir).withColumn("alpha", F.transform(L.flags(F.col("runs"), W), lambda m: m.cast("double")))
    lines = lines.withColumn("colour", F.transform("alpha", lambda a, x: a * x / W))
    soft = L.soft_matte(lines, MASK, ["colour"], "alpha", 1.0, W, H)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    sums = soft.groupBy(*MASK).agg(F.sum(total("alpha")).alias("a"), F.sum(total("colour")).alias("c"))
    return sums.select(*MASK, F.round("a", 5).alias("alpha"), F.round("c", 5).alias("colour"), F.round(F.col("c") + 0.5 * (W * H - F.col("a")), 5).alias("composite"))


def _matte_sql() -> str:
    taps = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
    taps = [t / sum(taps) for t in taps]
    fold = lambda v, n: f"abs(({v} + {n - 1}) % {2 * (n - 1)} - {n - 1})"
    return f"""WITH {MASKS}, taps AS (SELECT unnest(range(-4, 5)) AS k, unnest(CAST({taps!r} AS DOUBLE[])) AS p),
reach AS (SELECT g.x, g.y, {fold(f"(g.x + a.k + {2 * (W - 1)})", W)} AS sx, {fold(f"(g.y + b.k + {2 * (H - 1)})", H)} AS sy, a.p * b.p AS p FROM grid g, taps a, taps b),
blur AS (SELECT episode, frame, r.x, r.y, sum(p) AS alpha, sum(p * c.x / {W}.0) AS colour FROM cell c JOIN reach r ON r.sx = c.x AND r.sy = c.y GROUP BY ALL),
sums AS (SELECT episode, frame, sum(least(1.0, alpha)) AS a, sum(least(colour, least(1.0, alpha))) AS c FROM blur GROUP BY 1, 2)
SELECT episode, frame, round(a, 5) AS alpha, round(c, 5) AS colour, round(c + 0.5 * ({W * H} - a), 5) AS composite FROM sums"""


def resized_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of two sizes united on the larger image: even frames' masks, and those of the frame before on an image half as wide and three times as high."""
    cells = small_cells(spark, sf_dir)
    runs = cells.select("episode", (F.col("frame") - F.col("frame") % 2).alias("frame"), (F.col("frame") % 2).alias("odd"), "y", F.col("x").alias("a"), (F.col("x") + 1).alias("b"))
    own = runs.filter("odd = 0").drop("odd")
    other = L.resized(runs.filter("odd = 1 and a < 20 and y < 12").drop("odd"), MASK, (W // 2, H), (W, 3 * H))
    lines = L.lines_of(L.resized(own, MASK, (W, H), (W, 3 * H)).unionByName(other), MASK, runs, 3 * H)
    return lines.groupBy(*MASK).agg(F.sum(L.pixels(F.col("runs"))).alias("area"), F.sum(L.column_sum(F.col("runs"))).alias("columns"))


RESIZED_SQL = f"""WITH {CELLS}, cell AS (SELECT DISTINCT episode, frame - frame % 2 AS frame, frame % 2 AS odd, x, y FROM cells), grid AS (SELECT x, y FROM (SELECT unnest(range({W})) AS x), (SELECT unnest(range({3 * H})) AS y)),
hits AS (
    SELECT c.episode, c.frame, g.x, g.y FROM cell c JOIN grid g ON c.odd = 0 AND g.x = c.x AND g.y // 3 = c.y
    UNION SELECT c.episode, c.frame, g.x, g.y FROM cell c JOIN grid g ON c.odd = 1 AND c.x < 20 AND g.x // 2 = c.x AND g.y // 3 = c.y
)
SELECT f.episode, f.frame, count(h.x) AS area, CAST(coalesce(sum(h.x), 0) AS BIGINT) AS columns FROM (SELECT DISTINCT episode, frame FROM cell) f LEFT JOIN hits h ON h.episode = f.episode AND h.frame = f.frame GROUP BY 1, 2"""


def inpaint_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conservative region of a filled background (a mask grown by two steps of the ellipse of five) blended in over grey: pixels and levels."""
    lines = L.grown(L.grown(small_masks(spark, sf_dir), MASK, L.ellipse(5), W), MASK, L.ellipse(5), W)
    level = lambda x: M.blended(F.lit(100.0), x * 6.0, F.lit(0.75))
    inside = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + F.aggregate(F.sequence(r["a"], r["b"] - 1), F.lit(0).cast("long"), lambda t, x: t + level(x)))
    return lines.groupBy(*MASK).agg(F.sum(L.pixels(F.col("runs"))).alias("area"), F.sum(inside).alias("levels"))


def _inpaint_sql() -> str:
    steps = ", ".join(f"({dx}, {dy})" for dy, w in L.ellipse(5).items() for dx in range(-w, w + 1))
    return f"""WITH {MASKS}, steps(dx, dy) AS (VALUES {steps}),
once AS (SELECT DISTINCT episode, frame, x + dx AS x, y + dy AS y FROM cell, steps WHERE x + dx BETWEEN 0 AND {W - 1} AND y + dy BETWEEN 0 AND {H - 1}),
twice AS (SELECT DISTINCT episode, frame, x + dx AS x, y + dy AS y FROM once, steps WHERE x + dx BETWEEN 0 AND {W - 1} AND y + dy BETWEEN 0 AND {H - 1})
SELECT episode, frame, count(*) AS area, CAST(sum(trunc(least(255.0, greatest(0.0, 100.0 * 0.25 + x * 6.0 * 0.75)))) AS BIGINT) AS levels FROM twice GROUP BY 1, 2"""


def mask_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand shapes of each frame on a 64 x 48 image, closed, opened, cleaned of stray parts and made steady inside an episode: areas before and after."""
    rows = hand_pixels(spark, sf_dir)
    shapes = L.bone_shapes(rows, FRAME, "u", "v", F.transform(F.arrays_zip("u", "v"), lambda p: p["u"].isNotNull() & p["v"].isNotNull()), 2.0, rounded=False)
    raw = L.lines_of(L.capsule_rows(shapes, FRAME, 64, 48), FRAME, rows, 48)
    clean = L.cleaned(raw.withColumn("raw", L.pixels(F.col("runs"))), FRAME, 64, 48, F.array(F.struct(F.lit(32.0).alias("u"), F.lit(24.0).alias("v"))), 8)
    steady = L.stabilised(clean.withColumn("clean", L.pixels(F.col("runs"))), ["episode"], "frame", 64, clip=3.0)
    return steady.groupBy(*FRAME).agg(F.sum("raw").alias("raw"), F.sum("clean").alias("clean"), F.sum(L.pixels(F.col("runs"))).alias("steady"))


def _cleanup_sql() -> str:
    """The same over cells: windows as joins with their steps, parts by a closure over runs, distances by steps."""
    window = lambda n: ", ".join(f"({dx}, {dy})" for dy, w in L.ellipse(n).items() for dx in range(-w, w + 1))
    at, inside = "episode, frame, x, y", "x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 47"
    grow = lambda out, source, n: f"{out} AS MATERIALIZED (SELECT DISTINCT episode, frame, x + dx AS x, y + dy AS y FROM {source}, w{n} WHERE {inside})"
    # a cell stays if no cell of the image in its window is missing
    shrink = lambda out, source, n: f"""{out} AS MATERIALIZED (
    SELECT c.{at.replace(", ", ", c.")} FROM {source} c, w{n} s LEFT JOIN {source} o ON o.episode = c.episode AND o.frame = c.frame AND o.x = c.x + dx AND o.y = c.y + dy
    WHERE c.x + dx BETWEEN 0 AND 63 AND c.y + dy BETWEEN 0 AND 47 GROUP BY ALL HAVING count(*) = count(o.x)
)"""  # noqa: E731
    tidy = lambda out, source: ",\n".join([grow(f"{out}1", source, 5), shrink(f"{out}2", f"{out}1", 5), shrink(f"{out}3", f"{out}2", 3), grow(out, f"{out}3", 3)])
    return f"""WITH RECURSIVE {PX}, {GRID}, w3(dx, dy) AS (VALUES {window(3)}), w5(dx, dy) AS (VALUES {window(5)}),
eps AS (SELECT DISTINCT episode, frame FROM points_), {_bones_sql("SELECT * FROM px WHERE u IS NOT NULL", "bones", False)}, {_shape_sql(2, "bones", "shape")},
raw AS MATERIALIZED (SELECT e.episode, s.* FROM shape s JOIN eps e ON e.frame = s.frame), {tidy("tidy", "raw")},
cuts AS (SELECT *, x - row_number() OVER (PARTITION BY episode, frame, y ORDER BY x) AS g FROM tidy),
runs AS MATERIALIZED (SELECT episode, frame, y, min(x) AS a, max(x) + 1 AS b, y * 64 + min(x) AS id FROM cuts GROUP BY episode, frame, y, g),
touch AS MATERIALIZED (SELECT p.episode, p.frame, p.id AS u, q.id AS v FROM runs p JOIN runs q ON q.episode = p.episode AND q.frame = p.frame AND abs(q.y - p.y) = 1 AND q.a <= p.b AND p.a <= q.b),
reach AS (SELECT episode, frame, id, id AS other FROM runs UNION SELECT r.episode, r.frame, r.id, t.v FROM reach r JOIN touch t ON t.episode = r.episode AND t.frame = r.frame AND t.u = r.other),
part AS (SELECT episode, frame, id, min(other) AS part FROM reach GROUP BY 1, 2, 3),
kept AS (
    SELECT r.episode, r.frame, part FROM runs r JOIN part p ON p.episode = r.episode AND p.frame = r.frame AND p.id = r.id GROUP BY 1, 2, 3
    HAVING sum(b - a) >= 8 AND bool_or(y >= 45 OR b > 61 OR (abs(y - 24) <= 5 AND a <= 37 AND b > 27))
), clean AS MATERIALIZED (
    SELECT r.episode, r.frame, CAST(unnest(range(a, b)) AS BIGINT) AS x, y FROM runs r JOIN part p ON p.episode = r.episode AND p.frame = r.frame AND p.id = r.id JOIN kept k ON k.episode = r.episode AND k.frame = r.frame AND k.part = p.part
), ok AS MATERIALIZED (
    SELECT *, lag(good) OVER w AS before, lead(good) OVER w AS after, lag(frame) OVER w AS was, lead(frame) OVER w AS next
    FROM (SELECT e.*, count(x) AS n, count(x) BETWEEN 1 AND 3071 AS good FROM eps e LEFT JOIN clean c ON c.episode = e.episode AND c.frame = e.frame GROUP BY 1, 2) WINDOW w AS (PARTITION BY episode ORDER BY frame)
), steps AS (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
outer_ AS MATERIALIZED (SELECT episode, frame, x + dx AS x, y + dy AS y, min(dx * dx + dy * dy) AS d FROM clean, steps WHERE {inside} GROUP BY ALL),
inner_ AS (SELECT c.episode, c.frame, c.x, c.y, min(dx * dx + dy * dy) AS d FROM outer_ o, steps s JOIN clean c ON c.episode = o.episode AND c.frame = o.frame AND c.x = o.x + dx AND c.y = o.y + dy WHERE o.d > 0 GROUP BY ALL),
far AS MATERIALIZED (
    SELECT episode, frame, x, y, -sqrt(d) AS d FROM outer_ WHERE d > 0
    UNION ALL SELECT c.episode, c.frame, c.x, c.y, sqrt(coalesce(n.d, 9)) FROM clean c LEFT JOIN inner_ n ON n.episode = c.episode AND n.frame = c.frame AND n.x = c.x AND n.y = c.y
), mixed AS MATERIALIZED (
    SELECT o.episode, o.frame, f.x, f.y FROM ok o JOIN far f ON f.episode = o.episode AND f.frame = o.frame
    LEFT JOIN far p ON before AND p.episode = o.episode AND p.frame = o.was AND p.x = f.x AND p.y = f.y LEFT JOIN far q ON after AND q.episode = o.episode AND q.frame = o.next AND q.x = f.x AND q.y = f.y
    WHERE good AND f.d + CASE WHEN before THEN 0.35::DOUBLE * coalesce(p.d, -3.0::DOUBLE) ELSE 0.0 END + CASE WHEN after THEN 0.35::DOUBLE * coalesce(q.d, -3.0::DOUBLE) ELSE 0.0 END > 0
), {tidy("steady", "mixed")},
areas AS (SELECT episode, frame, count(*) AS n FROM steady GROUP BY 1, 2), raws AS (SELECT episode, frame, count(*) AS n FROM raw GROUP BY 1, 2)
SELECT o.episode, o.frame, coalesce(r.n, 0) AS raw, o.n AS clean, CASE WHEN NOT good THEN 0 WHEN NOT coalesce(before, false) AND NOT coalesce(after, false) THEN o.n
    WHEN coalesce(a.n, 0) / CAST(o.n AS DOUBLE) BETWEEN 0.65 AND 1.35 THEN coalesce(a.n, 0) ELSE o.n END AS steady
FROM ok o LEFT JOIN raws r ON r.episode = o.episode AND r.frame = o.frame LEFT JOIN areas a ON a.episode = o.episode AND a.frame = o.frame""".replace("FROM points_", "FROM (SELECT CAST(label AS BIGINT) AS episode, vec_id AS frame FROM embeddings)")


def sampled_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of three samples in a shutter of three quarters, and their times."""
    from framewright.operators import intervals as I
    from framewright.sources.tables import frames

    rows = I.interpolate_at(frames(spark, sf_dir).select("episode", "frame", "signal"), ["episode"], "frame", "signal", 3, 0.75)
    return rows.groupBy("episode", "frame").agg(F.round(F.avg("sampled"), 6).alias("mean"), F.round(F.sum("at"), 6).alias("times"))


def _sampled_sql() -> str:
    from framewright.plans.visibility import FRAMES

    return f"""WITH {FRAMES}, lasts AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM frames),
due AS (SELECT episode, frame, last, least(CAST(last AS DOUBLE), greatest(0.0, frame + (k - 1) * 0.375)) AS at FROM lasts, (SELECT unnest(range(3)) AS k))
SELECT d.episode, d.frame, round(avg(a.signal + (b.signal - a.signal) * (d.at - floor(d.at))), 6) AS mean, round(sum(d.at), 6) AS times FROM due d
    JOIN frames a ON a.episode = d.episode AND a.frame = CAST(floor(d.at) AS BIGINT) JOIN frames b ON b.episode = d.episode AND b.frame = least(d.last, CAST(floor(d.at) AS BIGINT) + 1) GROUP BY 1, 2"""


QUERIES = {
    "hand_support": (hand_support, SUPPORT_SQL),
    "arm_envelope": (arm_envelope, ENVELOPE_SQL),
    "adaptive_envelope": (adaptive_envelope, SLEEVES_SQL),
    "soft_alpha": (soft_alpha, ALPHA_SQL),
    "signed_distance": (signed_distance, DISTANCE_SQL),
    "warp_masks": (warp_masks, WARP_SQL),
    "soft_matte": (soft_matte, _matte_sql()),
    "resized_union": (resized_union, RESIZED_SQL),
    "inpaint_region": (inpaint_region, _inpaint_sql()),
    "mask_cleanup": (mask_cleanup, _cleanup_sql()),
    "sampled_signal": (sampled_signal, _sampled_sql()),
}
