"""Queries over poses, prompts, segments and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import poses as P
from framewright.operators import verification as C
from framewright.plans.trajectories import QUATS
from framewright.plans.visibility import FRAMES, POINTS
from framewright.sources.tables import frames, landmarks, table

CAMERA = G.Camera(300.0, 300.0, 640.0, 360.0, 1280.0, 720.0)


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a camera: four numbers are its quaternion, the next three its place."""
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode"), place.cast("long").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select("episode", "frame", P.pose(P.rotation(F.slice("e", 1, 4)), F.slice("e", 5, 3)).alias("p"), F.slice("e", 8, 3).alias("point"))


def _rounded(prefix: str, values: list) -> list:
    return [F.round(v, 6).alias(f"{prefix}{i}") for i, v in enumerate(values)]


MATRIX = f"""{QUATS}, placed AS (SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
mats AS (
    SELECT q.episode, q.frame, e[5:7] AS t, e[8:10] AS pt, [
        1 - 2 * (q[2] * q[2] + q[3] * q[3]), 2 * (q[1] * q[2] - q[3] * q[4]), 2 * (q[1] * q[3] + q[2] * q[4]),
        2 * (q[1] * q[2] + q[3] * q[4]), 1 - 2 * (q[1] * q[1] + q[3] * q[3]), 2 * (q[2] * q[3] - q[1] * q[4]),
        2 * (q[1] * q[3] - q[2] * q[4]), 2 * (q[2] * q[3] + q[1] * q[4]), 1 - 2 * (q[1] * q[1] + q[2] * q[2])] AS r
    FROM quats q JOIN placed p ON q.episode = p.episode AND q.frame = p.frame
)"""


def pose_basis_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in each camera's axes, y down; and the camera's rotation with the world's z turned round."""
    rows = _poses(spark, sf_dir).withColumn("c", P.camera_points(F.array("point"), F.col("p.t"), F.col("p.r"))[0]).withColumn("w", P.flipped(F.col("p.r"), (1, 1, -1)))
    return rows.select("episode", "frame", *_rounded("c", [F.col("c")[i] for i in range(3)]), *_rounded("w", [F.col("w")[i] for i in range(9)]))


BASIS_SQL = f"""WITH {MATRIX}, d AS (SELECT *, [pt[1] - t[1], pt[2] - t[2], pt[3] - t[3]] AS d FROM mats)
SELECT episode, frame, round(r[1] * d[1] + r[4] * d[2] + r[7] * d[3], 6) AS c0, round(-(r[2] * d[1] + r[5] * d[2] + r[8] * d[3]), 6) AS c1, round(r[3] * d[1] + r[6] * d[2] + r[9] * d[3], 6) AS c2,
    {", ".join(f"round(r[{k + 1}] * {-1.0 if (k // 3 == 2) != (k % 3 == 2) else 1.0}, 6) AS w{k}" for k in range(9))} FROM d"""


def relative_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each camera seen from the one before it."""
    rows = _poses(spark, sf_dir).withColumn("b", F.lag("p").over(W.partitionBy("episode").orderBy("frame"))).filter(F.col("b").isNotNull())
    rows = rows.withColumn("m", P.composed(P.inverse(F.col("b")), F.col("p")))
    return rows.select("episode", "frame", *_rounded("t", [F.col("m.t")[i] for i in range(3)]), F.round(F.col("m.r")[0] + F.col("m.r")[4] + F.col("m.r")[8], 6).alias("trace"))


MOTION_SQL = f"""WITH {MATRIX}, pairs AS (SELECT *, lag(r) OVER w AS br, lag(t) OVER w AS bt FROM mats WINDOW w AS (PARTITION BY episode ORDER BY frame)), d AS (SELECT *, [t[1] - bt[1], t[2] - bt[2], t[3] - bt[3]] AS d FROM pairs WHERE br IS NOT NULL)
SELECT episode, frame, {", ".join(f"round(br[{i + 1}] * d[1] + br[{i + 4}] * d[2] + br[{i + 7}] * d[3], 6) AS t{i}" for i in range(3))},
    round(list_sum(list_transform(list_zip(br, r), lambda x: x[1] * x[2])), 6) AS trace FROM d"""


def pose_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pose a quarter of the way to the next one."""
    rows = _poses(spark, sf_dir).withColumn("n", F.lead("p").over(W.partitionBy("episode").orderBy("frame"))).filter(F.col("n").isNotNull())
    b = P.blend_poses(rows.select("episode", "frame", "p", "n", F.lit(0.25).alias("share")), "p", "n", "share")
    r, t = F.col("blended.r"), F.col("blended.t")
    return b.select("episode", "frame", F.round(r[0] + r[4] + r[8], 5).alias("trace"), F.round(sum(((i + 1) * r[i] for i in range(9)), F.lit(0.0)), 5).alias("mixed"), F.round(t[0] + 2 * t[1] + 4 * t[2], 5).alias("place"))


def _blend_sql() -> str:
    minor = lambda i, j: f"(m[{3 * ((i + 1) % 3) + (j + 1) % 3 + 1}] * m[{3 * ((i + 2) % 3) + (j + 2) % 3 + 1}] - m[{3 * ((i + 1) % 3) + (j + 2) % 3 + 1}] * m[{3 * ((i + 2) % 3) + (j + 1) % 3 + 1}])"
    inverse = ", ".join(f"0.5 * (m[{3 * i + j + 1}] + {minor(i, j)} / d)" for i in range(3) for j in range(3))
    return f"""WITH RECURSIVE {MATRIX}, pairs AS (SELECT episode, frame, r, t, lead(r) OVER w AS r2, lead(t) OVER w AS t2 FROM mats WINDOW w AS (PARTITION BY episode ORDER BY frame)),
newton AS (
    SELECT episode, frame, list_transform(list_zip(r, r2), lambda x: 0.75 * x[1] + 0.25 * x[2]) AS m, list_transform(list_zip(t, t2), lambda x: 0.75 * x[1] + 0.25 * x[2]) AS t, 0 AS i FROM pairs WHERE r2 IS NOT NULL
    UNION ALL SELECT episode, frame, [{inverse}], t, i + 1 FROM (SELECT *, m[1] * {minor(0, 0)} + m[2] * {minor(0, 1)} + m[3] * {minor(0, 2)} AS d FROM newton WHERE i < 24)
)
SELECT episode, frame, round(m[1] + m[5] + m[9], 5) AS trace, round({" + ".join(f"{i} * m[{i}]" for i in range(1, 10))}, 5) AS mixed, round(t[1] + 2 * t[2] + 4 * t[3], 5) AS place FROM newton WHERE i = 24"""


def arm_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmark 0 as wrist and 20 as elbow, three landmarks as the other hand's: the axis, how many negatives are on the image, and the box; nulls for frames without an anchor.

    A filter on the axis here would be pushed below its steps, written out whole.
    """
    rows = P.arm_axis(landmarks(spark, sf_dir), "points", F.col("points")[0], F.col("points")[20], CAMERA)
    other = F.filter(F.transform(F.array(*(F.col("points")[i] for i in (3, 7, 11))), lambda p: G.project(p, CAMERA)), lambda p: P.on_image(p, CAMERA))
    rows = P.arm_prompt(rows, "axis", CAMERA, others=other)
    return rows.select(
        "frame", F.round("axis.base.u", 3).alias("base_u"), F.round("axis.base.v", 3).alias("base_v"), F.round("axis.end.u", 3).alias("end_u"), F.round("axis.end.v", 3).alias("end_v"),
        F.round(F.col("prompt.positives")[2]["u"], 3).alias("middle_u"), F.size("prompt.negatives").cast("long").alias("n_negatives"),
        *[F.round(P.unit_box(F.col(f"prompt.{c}"), s), 5).alias(c) for c, s in (("u0", 1280.0), ("v0", 720.0), ("u1", 1280.0), ("v1", 720.0))],
    )


ARM_SQL = f"""WITH {POINTS}, px AS (SELECT *, CASE WHEN abs(z) > 1e-6 THEN 300.0 * x / z + 640.0 END AS u, CASE WHEN abs(z) > 1e-6 THEN 300.0 * y / z + 360.0 END AS v FROM points),
ok AS (SELECT *, coalesce(u >= 0 AND u <= 1279 AND v >= 0 AND v <= 719, false) AS inside FROM px),
bases AS (
    SELECT frame, coalesce(max(u) FILTER (landmark = 0 AND inside), avg(u) FILTER (landmark IN (5, 9, 13, 17) AND inside), avg(u) FILTER (inside)) AS x,
        coalesce(max(v) FILTER (landmark = 0 AND inside), avg(v) FILTER (landmark IN (5, 9, 13, 17) AND inside), avg(v) FILTER (inside)) AS y,
        max(u) FILTER (landmark = 20) - max(u) FILTER (landmark = 0) AS dx, max(v) FILTER (landmark = 20) - max(v) FILTER (landmark = 0) AS dy FROM ok GROUP BY frame
), times AS (SELECT *, unnest([(0 - x) / dx, (1279 - x) / dx, (0 - y) / dy, (719 - y) / dy]) AS t, unnest(['x', 'x', 'y', 'y']) AS side FROM bases WHERE x IS NOT NULL),
hits AS (SELECT frame, x, y, dx, dy, min(t) FILTER (t > 0 AND CASE WHEN side = 'x' THEN y + t * dy BETWEEN -1e-3 AND 719.001 ELSE x + t * dx BETWEEN -1e-3 AND 1279.001 END) AS t FROM times GROUP BY ALL),
axes AS (SELECT frame, x, y, least(1279.0, greatest(0.0, x + t * dx)) - x AS du, least(719.0, greatest(0.0, y + t * dy)) - y AS dv FROM hits WHERE t IS NOT NULL),
sides AS (SELECT frame, x + k * du - s * (78 + 38 * k) * dv / sqrt(du * du + dv * dv) AS u, y + k * dv + s * (78 + 38 * k) * du / sqrt(du * du + dv * dv) AS v
    FROM axes, (SELECT unnest([0.28, 0.58, 0.86]) AS k), (SELECT unnest([-1.0, 1.0]) AS s) WHERE sqrt(du * du + dv * dv) > 1e-5),
counts AS (SELECT frame, count(*) FILTER (u >= 0 AND u <= 1279 AND v >= 0 AND v <= 719) AS n FROM sides GROUP BY frame),
other AS (SELECT frame, count(*) AS n_other FROM ok WHERE inside AND landmark IN (3, 7, 11) GROUP BY frame)
SELECT f.frame, round(x, 3) AS base_u, round(y, 3) AS base_v, round(x + du, 3) AS end_u, round(y + dv, 3) AS end_v, round(x + 0.5 * du, 3) AS middle_u, CASE WHEN x IS NOT NULL THEN coalesce(n, 0) + coalesce(n_other, 0) END AS n_negatives,
    round(greatest(0.0, least(x, x + 0.94 * du) - 82) / 1280, 5) AS u0, round(greatest(0.0, least(y, y + 0.94 * dv) - 82) / 720, 5) AS v0,
    round(least(1279.0, greatest(x, x + 0.94 * du) + 82) / 1280, 5) AS u1, round(least(719.0, greatest(y, y + 0.94 * dv) + 82) / 720, 5) AS v1
FROM (SELECT DISTINCT frame FROM points) f LEFT JOIN axes a ON f.frame = a.frame LEFT JOIN counts c ON a.frame = c.frame LEFT JOIN other o ON a.frame = o.frame"""


def sequence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-number summaries of every episode, nested by kind, as JSON."""
    per = C.three_numbers(frames(spark, sf_dir), ["episode", "event_type"], "frame")
    entry = F.struct("event_type", "n", F.floor("mid").alias("mid"), "low", "high")
    return per.groupBy("episode").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("report"))


REPORT_SQL = f"""WITH {FRAMES}, per AS (SELECT episode, event_type, count(*) AS n, min(frame) AS low, CAST(floor(median(frame)) AS BIGINT) AS mid, max(frame) AS high FROM frames GROUP BY 1, 2)
SELECT episode, '[' || string_agg('{{"event_type":"' || event_type || '","n":' || n || ',"mid":' || mid || ',"low":' || low || ',"high":' || high || '}}', ',' ORDER BY event_type) || ']' AS report FROM per GROUP BY 1"""


QUERIES = {
    "pose_basis_change": (pose_basis_change, BASIS_SQL),
    "relative_motion": (relative_motion, MOTION_SQL),
    "pose_blend": (pose_blend, _blend_sql()),
    "arm_prompts": (arm_prompts, ARM_SQL),
    "sequence_report": (sequence_report, REPORT_SQL),
}
