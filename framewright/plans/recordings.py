"""Queries over whole recordings: composed visibility, prompts and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import intervals as I
from framewright.operators import poses as P
from framewright.operators import visibility as V
from framewright.plans.poses import MATRIX
from framewright.plans.visibility import FRAMES, POINTS, balanced_sql, bridged_sql, padded_sql, runs_sql
from framewright.sources.tables import frames, landmarks, table

CAMERA = G.Camera(300.0, 300.0, 640.0, 360.0, 1280.0, 720.0)


def pose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a row of a pose table: a quaternion, a place, 21 landmarks of either hand, and whether a detector saw either."""
    place = F.row_number().over(W.partitionBy("episode").orderBy("vec_id")) - 1
    wide = F.transform("embedding", lambda x: x.cast("double"))
    hand = lambda f: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: f(F.get("e", i * 3), F.get("e", i * 3 + 1), F.get("e", i * 3 + 2)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode"), "vec_id", wide.alias("e"))
    found = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), (F.col("value") / 100).alias("confidence"), "event_type")
    # frames are numbered last: the windows that follow keep that shuffle
    rows = rows.join(found, "vec_id", "left").withColumn("frame", place.cast("long")).withColumn("direct", V.direct_visibility(F.col("confidence")))
    return rows.select(
        "episode", "frame", F.slice("e", 5, 3).alias("position"), F.slice("e", 1, 4).alias("quaternion"), hand(lambda x, y, z: F.array(x, y, z)).alias("left_landmarks"), hand(lambda x, y, z: F.array(y, z, x)).alias("right_landmarks"),
        (F.col("direct") & (F.col("event_type") == "view")).alias("left_direct"), (F.col("direct") & (F.col("event_type") == "click")).alias("right_direct"),
    )


def hand_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hands: landmarks in view or a detection, gaps of one frame bridged, one frame more before."""
    sides = ("left", "right")
    return V.hand_visibility(
        pose_table(spark, sf_dir), ["episode"], "frame", "position", "quaternion", {x: f"{x}_landmarks" for x in sides}, CAMERA, direct={x: f"{x}_direct" for x in sides}, least=7, gap=1, entry=1, exit=0
    )


def _sides_sql() -> str:
    def side(name: str, kind: str, order: tuple[int, int, int]) -> str:
        c = [f"e[i * 3 + {k + 1}] - t[{j + 1}]" for j, k in enumerate(order)]
        turned = [f"(r[{k + 1}] * ({c[0]}) + r[{k + 4}] * ({c[1]}) + r[{k + 7}] * ({c[2]}))" for k in range(3)]
        ok = f"""list_transform(range(21), lambda i: {turned[2]} > 0.05
            AND 300.0 * {turned[0]} / greatest({turned[2]}, 1e-6) + 640.0 >= -20 AND 300.0 * {turned[0]} / greatest({turned[2]}, 1e-6) + 640.0 < 1300
            AND 300.0 * -{turned[1]} / greatest({turned[2]}, 1e-6) + 360.0 >= -20 AND 300.0 * -{turned[1]} / greatest({turned[2]}, 1e-6) + 360.0 < 740)"""
        return f"""{name}_raw AS (
    SELECT episode, frame, len(list_filter({ok}, lambda x: x)) >= 7 OR coalesce(confidence >= 0.9 AND event_type = '{kind}', false) AS {name} FROM wide
), {bridged_sql(name, 1, f"{name}_raw", f"{name}_b")}, {padded_sql(name, 1, 0, f"{name}_b", f"{name}_p")}"""

    return f"""{MATRIX}, numbered AS (SELECT vec_id, CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
wide AS (SELECT n.episode, n.frame, e, r, t, value / 100 AS confidence, event_type FROM numbered n JOIN mats m ON n.episode = m.episode AND n.frame = m.frame LEFT JOIN events ON event_id = vec_id),
{side("seen_l", "view", (0, 1, 2))}, {side("seen_r", "click", (1, 2, 0))}"""


HAND_SQL = f'WITH {_sides_sql()} SELECT l.episode, l.frame, seen_l AS "left", seen_r AS "right" FROM seen_l_p l JOIN seen_r_p r ON l.episode = r.episode AND l.frame = r.frame'


def recording_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship on projected landmarks: visibility of both hands over whole recordings, cropped, cut into runs and balanced chunks."""
    both = hand_visibility(spark, sf_dir)
    state = both.select("episode", "frame", I.two_sided_state(F.col("left"), F.col("right")).alias("state")).filter("frame >= 2")
    found = I.runs(state, ["episode"], "frame", "state").filter("state <> 0")
    mode = F.element_at(F.create_map(*[F.lit(x) for pair in I.MODES.items() for x in pair]), F.col("state"))
    return I.balanced_chunks(found, 2, 5).select("episode", mode.alias("mode"), "start", "stop")


CHUNKS_SQL = f"""WITH {_sides_sql()}, states AS (SELECT l.episode, l.frame, CAST(seen_l AS INTEGER) + 2 * CAST(seen_r AS INTEGER) AS state FROM seen_l_p l JOIN seen_r_p r ON l.episode = r.episode AND l.frame = r.frame WHERE l.frame >= 2),
{runs_sql("state", "states", "found")}, kept AS (SELECT * FROM found WHERE state <> 0),
{balanced_sql("kept", 2, 5, "episode, CASE state WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'both' END AS mode")}"""


def _hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks of each frame, confidences from the size of their last coordinate, and the mirrored points as the other hand."""
    rows = landmarks(spark, sf_dir)
    sure = F.transform("points", lambda p: F.abs(p[2]) * 3)
    other = F.transform("points", lambda p: F.array(-p[0], p[1], F.abs(p[2])))
    return rows.select("frame", "points", sure.alias("sure"), other.alias("other"), F.reverse(sure).alias("other_sure"))


def prompt_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.prompt_cascade(_hands(spark, sf_dir), "points", CAMERA, 24.0, "sure", "other", "other_sure")
    p = F.col("prompt")
    return rows.select(
        "frame", p["how"].alias("how"), F.array_join(F.transform(p["picked"], lambda i: i.cast("string")), ",").alias("picked"), F.size(p["negatives"]).cast("long").alias("n_negatives"),
        F.round(F.aggregate(p["positives"], F.lit(0.0), lambda s, x: s + x["u"] + x["v"]), 3).alias("sum_positive"), *[F.round(p[c], 3).alias(c) for c in ("u0", "v0", "u1", "v1")],
    )


def _cascade_sql() -> str:
    from framewright.operators.visibility import NEGATIVES, PREFERRED

    return f"""WITH {POINTS}, px AS (
    SELECT frame, landmark, z > 1e-4 AS front, abs(z) * 3 >= 0.3 AS sure, CASE WHEN abs(z) > 1e-6 THEN 300.0 * x / z + 640.0 END AS u, CASE WHEN abs(z) > 1e-6 THEN 300.0 * y / z + 360.0 END AS v FROM points
), flags AS (
    SELECT *, coalesce(front AND u >= 0 AND u < 1280 AND v >= 0 AND v < 720, false) AS inside, coalesce(front AND u >= -20 AND u < 1300 AND v >= -20 AND v < 740, false) AS near FROM px
), how AS (
    SELECT frame, CASE WHEN count(*) FILTER (inside AND sure) >= 4 THEN 'trusted' WHEN count(*) FILTER (inside) >= 4 THEN 'seen' WHEN count(*) FILTER (near AND sure) >= 4 THEN 'near trusted' WHEN count(*) FILTER (near) >= 4 THEN 'near' END AS how
    FROM flags GROUP BY frame
), ok AS (
    SELECT f.frame, landmark, how, CASE WHEN how LIKE 'near%' THEN least(1279.0, greatest(0.0, u)) ELSE u END AS u, CASE WHEN how LIKE 'near%' THEN least(719.0, greatest(0.0, v)) ELSE v END AS v, landmark IN {PREFERRED} AS best
    FROM flags f JOIN how h ON f.frame = h.frame WHERE CASE how WHEN 'trusted' THEN inside AND sure WHEN 'seen' THEN inside WHEN 'near trusted' THEN near AND sure WHEN 'near' THEN near ELSE false END
), ranked AS (SELECT *, count(*) FILTER (best) OVER (PARTITION BY frame) AS n_best, row_number() OVER (PARTITION BY frame, best ORDER BY landmark) AS place FROM ok),
picked AS (SELECT * FROM ranked WHERE best OR place <= 4 - n_best),
others AS (
    SELECT p.frame, p.landmark, 300.0 * -p.x / abs(p.z) + 640.0 AS u, 300.0 * p.y / abs(p.z) + 360.0 AS v FROM points p JOIN points m ON m.frame = p.frame AND m.landmark = 20 - p.landmark
    WHERE p.landmark IN {NEGATIVES} AND abs(p.z) > 1e-4 AND abs(m.z) * 3 >= 0.3
), negatives AS (
    SELECT o.frame, count(*) AS n FROM others o WHERE u >= 0 AND u < 1280 AND v >= 0 AND v < 720 AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.frame = o.frame AND sqrt(pow(p.u - o.u, 2) + pow(p.v - o.v, 2)) <= 10) GROUP BY o.frame
), boxes AS (SELECT frame, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM ok GROUP BY frame),
chosen AS (SELECT frame, string_agg(landmark, ',' ORDER BY NOT best, landmark) AS picked, sum(u + v) AS total FROM picked GROUP BY frame)
SELECT h.frame, how, picked, CASE WHEN how IS NOT NULL THEN coalesce(n, 0) END AS n_negatives, round(total, 3) AS sum_positive,
    CASE WHEN how IS NOT NULL THEN round(greatest(0.0, u0 - 24), 3) END AS u0, CASE WHEN how IS NOT NULL THEN round(greatest(0.0, v0 - 24), 3) END AS v0,
    CASE WHEN how IS NOT NULL THEN round(least(1279.0, u1 + 24), 3) END AS u1, CASE WHEN how IS NOT NULL THEN round(least(719.0, v1 + 24), 3) END AS v1
FROM how h LEFT JOIN chosen c ON h.frame = c.frame LEFT JOIN boxes b ON h.frame = b.frame LEFT JOIN negatives n ON h.frame = n.frame"""


def spread_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.spread_prompt(_hands(spark, sf_dir), "points", CAMERA, 16.0, 4, "sure")
    p = F.col("prompt")
    return rows.filter(p.isNotNull()).select("frame", F.array_join(F.transform(p["picked"], lambda i: i.cast("string")), ",").alias("picked"), *[F.round(p[c], 3).alias(c) for c in ("u0", "v0", "u1", "v1")])


SPREAD_SQL = f"""WITH {POINTS}, px AS (SELECT frame, landmark, z > 1e-4 AS front, abs(z) * 3 >= 0.3 AS sure, 300.0 * x / nullif(z, 0) + 640.0 AS u, 300.0 * y / nullif(z, 0) + 360.0 AS v FROM points),
inside AS (SELECT *, max(CASE WHEN sure THEN 1 ELSE 0 END) OVER (PARTITION BY frame) AS any_sure FROM px WHERE front AND u >= 0 AND u < 1280 AND v >= 0 AND v < 720),
held AS (SELECT frame, list(landmark ORDER BY landmark) AS l, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM inside WHERE sure OR any_sure = 0 GROUP BY frame)
SELECT frame, array_to_string(CASE WHEN len(l) <= 4 THEN l ELSE list_transform(range(4), lambda j: l[CAST(round_even(j * (len(l) - 1) / 3.0, 0) AS INTEGER) + 1]) END, ',') AS picked,
    round(greatest(0.0, u0 - 16), 3) AS u0, round(greatest(0.0, v0 - 16), 3) AS v0, round(least(1279.0, u1 + 16), 3) AS u1, round(least(719.0, v1 + 16), 3) AS v1 FROM held"""


def palm_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm markers behind the wrist of each frame whose palm projects."""
    px = F.transform("points", lambda p: G.project(p, CAMERA))
    rows = landmarks(spark, sf_dir).withColumn("px", px).withColumn("m", V.palm_markers(F.col("px")))
    return rows.select("frame", F.posexplode("m").alias("marker", "at")).select("frame", F.col("marker").cast("long").alias("marker"), F.round("at.u", 3).alias("u"), F.round("at.v", 3).alias("v"))


MARKERS_SQL = f"""WITH {POINTS}, px AS (SELECT frame, landmark, CASE WHEN abs(z) > 1e-6 THEN 300.0 * x / z + 640.0 END AS u, CASE WHEN abs(z) > 1e-6 THEN 300.0 * y / z + 360.0 END AS v FROM points),
palms AS (SELECT frame, max(u) FILTER (landmark = 0) AS wu, max(v) FILTER (landmark = 0) AS wv, avg(u) FILTER (landmark IN (5, 9, 13, 17)) AS pu, avg(v) FILTER (landmark IN (5, 9, 13, 17)) AS pv FROM px GROUP BY frame)
SELECT frame, k AS marker, round(wu + [30.0, 80.0, 140.0][k + 1] * (wu - pu) / greatest(sqrt(pow(wu - pu, 2) + pow(wv - pv, 2)), 1e-4), 3) AS u,
    round(wv + [30.0, 80.0, 140.0][k + 1] * (wv - pv) / greatest(sqrt(pow(wu - pu, 2) + pow(wv - pv, 2)), 1e-4), 3) AS v FROM palms, (SELECT unnest(range(3)) AS k)"""


def side_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a day: the best of each side, with the sides of a mirrored view swapped."""
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("frame"), F.when(F.col("event_type").isin("click", "view"), "left").otherwise("right").alias("side"), F.col("event_id").alias("detection"), F.round("value").alias("score")
    )
    return V.best_per_side(rows, ["frame"], "side", "score", "detection")


DETECTIONS_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS frame, CASE WHEN event_type IN ('click', 'view') THEN 'right' ELSE 'left' END AS side,
    arg_max(event_id, row(round(value, 0), -event_id)) AS detection, max(round(value, 0)) AS score FROM events GROUP BY 1, 2"""


def side_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected visibility fused with detections of the same frame; both tables must have the same frames."""
    shown = landmarks(spark, sf_dir).select("frame", (G.visible_landmarks(F.col("points"), CAMERA) >= 3).alias("projected"))
    found = table(spark, sf_dir, "events").join(shown.select(F.col("frame").alias("event_id")), "event_id", "left_semi").select(F.col("event_id").alias("frame"), F.array(F.col("value") / 100).alias("confidence"))
    return V.visibility_for_side(shown, found, ["frame"], "projected", "confidence").select("frame", "projected", "visible")


SIDE_SQL = f"""WITH {POINTS}, px AS (SELECT frame, z, 300.0 * x / nullif(z, 0) + 640.0 AS u, 300.0 * y / nullif(z, 0) + 360.0 AS v FROM points),
shown AS (SELECT frame, count(*) FILTER (z > 0.05 AND u >= -20 AND u < 1300 AND v >= -20 AND v < 740) >= 3 AS projected FROM px GROUP BY frame)
SELECT frame, projected, projected OR value / 100 >= 0.9 AS visible FROM shown JOIN events ON event_id = frame"""


def valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steady signal inside each run of valid frames: the mean of neighbours never crosses a run's border."""
    rows = V.valid_runs(frames(spark, sf_dir).withColumn("valid", F.col("event_type") != "error"), ["episode"], "frame", "valid").filter("run is not null")
    near = W.partitionBy("episode", "run").orderBy("frame").rowsBetween(-1, 1)
    return rows.select("episode", "frame", F.col("run").cast("long").alias("run"), F.round(F.avg("signal").over(near), 6).alias("steady"))


RUNS_SQL = f"""WITH {FRAMES}, flags AS (SELECT *, event_type <> 'error' AND NOT coalesce(lag(event_type <> 'error') OVER (PARTITION BY episode ORDER BY frame), false) AS begins FROM frames),
runs AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY frame) AS run FROM flags)
SELECT episode, frame, CAST(run AS BIGINT) AS run, round(avg(signal) OVER (PARTITION BY episode, run ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS steady FROM runs WHERE event_type <> 'error'"""


def robot_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robot areas of both sides and their arms, from signals; sides without frames fail."""
    rows = frames(spark, sf_dir).select(
        "episode", F.when(F.col("event_type").isin("click", "view"), "left").when(F.col("event_type") == "purchase", "right").alias("side"),
        F.col("signal").alias("robot"), (F.col("signal") / 4).alias("arm"), (F.col("signal") * 2).alias("combined"),
    )
    return V.robot_verdict(rows, ["episode"], "side", "robot", "arm", "combined")


ROBOT_SQL = f"""WITH {FRAMES}, rows AS (SELECT episode, CASE WHEN event_type IN ('click', 'view') THEN 'left' WHEN event_type = 'purchase' THEN 'right' END AS side, signal FROM frames),
best AS (SELECT episode, max(signal) * 2 AS a, max(signal) FILTER (side = 'left') AS l, max(signal) FILTER (side = 'right') AS r FROM rows GROUP BY 1)
SELECT episode, CASE WHEN a < 128 THEN 'too small together' WHEN coalesce(l < 32, true) THEN 'left robot is never visible' WHEN l / 4 < 16 THEN 'left arm is never visible'
    WHEN coalesce(r < 32, true) THEN 'right robot is never visible' WHEN r / 4 < 16 THEN 'right arm is never visible' ELSE 'ok' END AS verdict FROM best"""


def single_robot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("episode", F.floor("signal").alias("robot"), F.when(F.col("event_type") == "error", F.floor(F.col("signal") / 8)).alias("arm"))
    return V.single_robot_verdict(rows, ["episode"], "robot", "arm")


SINGLE_SQL = f"""WITH {FRAMES} SELECT episode, count(*) FILTER (floor(signal) >= 64) AS robot_frames, count(*) FILTER (event_type = 'error' AND floor(signal / 8) >= 16) AS arm_frames,
    count(*) FILTER (floor(signal) >= 64) > 0 AND count(*) FILTER (event_type = 'error' AND floor(signal / 8) >= 16) > 0 AS ok FROM frames GROUP BY 1"""


def hand_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks and four arm markers as poses in the world, seen from the frame's camera."""
    rows = pose_table(spark, sf_dir).withColumn("turn", P.rotation(F.col("quaternion")))
    cameras = rows.select("episode", "frame", P.pose(F.col("turn"), F.col("position")).alias("camera"))
    arms = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.get("left_landmarks", i * 5), lambda x: x * 2))
    points = rows.select("episode", "frame", "turn", F.posexplode(F.concat("left_landmarks", arms)).alias("marker", "p"))
    joints = points.select("episode", "frame", "marker", P.pose(F.col("turn"), F.col("p")).alias("pose"))
    out = V.hand_sequence(joints, cameras, ["episode"], "frame", "marker", "pose", "camera")
    return out.select("episode", "frame", F.col("marker").cast("long").alias("marker"), *[F.round(F.col("point")[i], 6).alias(f"p{i}") for i in range(3)])


SEQUENCE_SQL = f"""WITH {MATRIX}, numbered AS (SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
marks AS (SELECT episode, frame, k AS marker, CASE WHEN k < 21 THEN e[k * 3 + 1:k * 3 + 3] ELSE list_transform(e[(k - 21) * 15 + 1:(k - 21) * 15 + 3], lambda x: x * 2) END AS p FROM numbered, (SELECT unnest(range(25)) AS k)),
d AS (SELECT k.episode, k.frame, marker, r, [p[1] - t[1], p[2] - t[2], p[3] - t[3]] AS d FROM marks k JOIN mats m ON k.episode = m.episode AND k.frame = m.frame)
SELECT episode, frame, marker, {", ".join(f"round(r[{i + 1}] * d[1] + r[{i + 4}] * d[2] + r[{i + 7}] * d[3], 6) AS p{i}" for i in range(3))} FROM d"""


def base_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of recordings with their base: that of the first frame for all of them, as w, x, y, z and place."""
    rows = pose_table(spark, sf_dir).select("episode", "frame", "quaternion", "position")
    base = rows.filter("frame = 0").select("episode", V.scalar_first(G.unit(F.col("quaternion"))).alias("base_q"), F.col("position").alias("base_t"))
    out = V.base_trajectory(rows.select("episode", "frame"), base, ["episode"], "frame")
    return out.select("episode", "frame", *[F.round(F.col("base_q")[i], 6).alias(f"q{i}") for i in range(4)], *[F.round(F.col("base_t")[i], 6).alias(f"t{i}") for i in range(3)])


BASE_SQL = """WITH numbered AS (SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
firsts AS (SELECT episode, e, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS n FROM numbered WHERE frame = 0)
SELECT f.episode, f.frame, round(b.e[4] / n, 6) AS q0, round(b.e[1] / n, 6) AS q1, round(b.e[2] / n, 6) AS q2, round(b.e[3] / n, 6) AS q3, round(b.e[5], 6) AS t0, round(b.e[6], 6) AS t1, round(b.e[7], 6) AS t2
FROM numbered f JOIN firsts b ON f.episode = b.episode"""


def actuated_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each recording's joints, root first or last: the places of the others."""
    own = F.transform(F.sequence(F.lit(1), (F.col("n_nationkey") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("finger"), i.cast("string")))
    root = F.array(*map(F.lit, V.ROOT))
    names = F.when(F.col("n_nationkey") % 2 == 0, F.concat(root, own)).otherwise(F.concat(own, root))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", V.actuated(names).alias("places"))
    return rows.select("n_nationkey", F.array_join(F.transform("places", lambda i: i.cast("string")), ",").alias("places"))


ACTUATED_SQL = """SELECT n_nationkey, array_to_string(CASE WHEN n_nationkey % 2 = 0 THEN range(6, 6 + n_nationkey % 5 + 1) ELSE range(0, n_nationkey % 5 + 1) END, ',') AS places FROM nation"""



def converted_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hands of the pose table in a right-handed world, the left one active, with the sleeves' markers."""
    rows = pose_table(spark, sf_dir).withColumn("wrist", F.reverse("quaternion"))
    out = P.converted_hands(rows, ["episode"], "frame", "position", "quaternion", {x: (f"{x}_landmarks", "wrist") for x in ("left", "right")}, ("left",))
    trace = F.round(F.col("turn")[0] + F.col("turn")[4] + F.col("turn")[8], 5).alias("trace")
    return out.select("episode", "frame", "side", F.col("marker").cast("long").alias("marker"), *[F.round(F.col("point")[i], 5).alias(f"p{i}") for i in range(3)], trace, "confidence")


CONVERTED_SQL = f"""WITH {MATRIX}, numbered AS (SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
marks AS (
    SELECT n.episode, n.frame, side, k AS marker, greatest(k - 20, 0) * CASE side WHEN 'left' THEN 1 ELSE 0 END AS far, CASE WHEN k < 21 THEN k ELSE 0 END AS i, e, r
    FROM numbered n JOIN mats m ON m.episode = n.episode AND m.frame = n.frame, (SELECT unnest(range(24)) AS k), (SELECT unnest(['left', 'right']) AS side)
), o AS (
    SELECT *, CASE side WHEN 'left' THEN [e[i * 3 + 1], e[i * 3 + 2], e[i * 3 + 3]] ELSE [e[i * 3 + 2], e[i * 3 + 3], e[i * 3 + 1]] END AS p, [far * -0.14::DOUBLE, far * -0.09::DOUBLE, far * 0.05::DOUBLE] AS s FROM marks
)
SELECT episode, frame, side, marker, round(p[1] + r[1] * s[1] + r[2] * s[2] + r[3] * s[3], 5) AS p0, round(p[2] + r[4] * s[1] + r[5] * s[2] + r[6] * s[3], 5) AS p1, round(-(p[3] + r[7] * s[1] + r[8] * s[2] + r[9] * s[3]), 5) AS p2,
    round(4 * e[1] * e[1] / (e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) - 1, 5) AS trace, CASE side WHEN 'left' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM o"""

QUERIES = {
    "converted_hands": (converted_hands, CONVERTED_SQL),
    "hand_visibility": (hand_visibility, HAND_SQL),
    "recording_chunks": (recording_chunks, CHUNKS_SQL),
    "prompt_cascade": (prompt_cascade, _cascade_sql()),
    "spread_prompt": (spread_prompt, SPREAD_SQL),
    "palm_markers": (palm_markers, MARKERS_SQL),
    "side_detections": (side_detections, DETECTIONS_SQL),
    "side_visibility": (side_visibility, SIDE_SQL),
    "valid_runs": (valid_runs, RUNS_SQL),
    "robot_verdict": (robot_verdict, ROBOT_SQL),
    "single_robot": (single_robot, SINGLE_SQL),
    "hand_sequence": (hand_sequence, SEQUENCE_SQL),
    "base_trajectory": (base_trajectory, BASE_SQL),
    "actuated_joints": (actuated_joints, ACTUATED_SQL),
}
