"""Queries of column functions and readers that have no larger plan of their own, and of landmarks made from detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import batch as B
from framewright.operators import geometry as G
from framewright.operators import poses as P
from framewright.operators import verification as C
from framewright.operators import visibility as V
from framewright.plans.visibility import FRAMES
from framewright.sources.tables import frames, landmarks, slice_rows, table

SIDE = "CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END"
CAMERA = G.Camera(300.0, 300.0, 640.0, 360.0, 1280.0, 720.0)


def rgb_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that an event of the same number saw as one or two finds of a mirrored detector: landmarks of both hands for every frame, with arm markers."""
    shown = landmarks(spark, sf_dir).select("episode", "frame", F.transform("points", lambda p: F.struct((300.0 * p[0] + 640.0).alias("u"), (300.0 * p[1] + 360.0).alias("v"))).alias("points"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), F.expr(SIDE).alias("side"), F.round("value").alias("score"))
    met = shown.join(events, "frame")
    moved = lambda d: F.transform("points", lambda p: F.struct((p["u"] + d).alias("u"), p["v"].alias("v")))
    first = met.filter("score > 20").select("episode", "frame", "side", "score", F.lit(0).alias("k"), moved(0.0).alias("points"))
    second = met.filter("score < 70").select("episode", "frame", F.when(F.col("frame") % 3 == 0, "right").otherwise("left").alias("side"), (90 - F.col("score")).alias("score"), F.lit(1).alias("k"), moved(5.0).alias("points"))
    out = V.detected_landmarks(first.unionByName(second), shown, ["episode"], "frame", "side", "score", "k", "points")
    total = lambda c, f: F.round(F.aggregate(c, F.lit(0.0), lambda s, p: s + p[f]), 3)
    return out.select("episode", "frame", "side", "confidence", total("points", "u").alias("u"), total("points", "v").alias("v"), total("markers", "u").alias("markers_u"), total("markers", "v").alias("markers_v"))


RGB_SQL = f"""WITH shown AS (SELECT CAST(label AS BIGINT) AS episode, vec_id AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
met AS (SELECT episode, frame, e, {SIDE} AS side, round_even(value, 0) AS r, round(value, 0) AS score FROM shown JOIN events ON event_id = frame),
finds AS (
    SELECT episode, frame, side, score, 0 AS k, 0.0::DOUBLE AS d FROM met WHERE score > 20
    UNION ALL SELECT episode, frame, CASE WHEN frame % 3 = 0 THEN 'right' ELSE 'left' END, 90 - score, 1, 5.0 FROM met WHERE score < 70
), best AS (SELECT episode, frame, CASE side WHEN 'left' THEN 'right' ELSE 'left' END AS side, arg_max(d, row(score, -k)) AS d FROM finds GROUP BY episode, frame, side),
every AS (SELECT s.episode, s.frame, t.side, s.e, b.d FROM shown s CROSS JOIN (SELECT unnest(['left', 'right']) AS side) t LEFT JOIN best b ON b.episode = s.episode AND b.frame = s.frame AND b.side = t.side),
points AS (SELECT episode, frame, side, i, CASE WHEN d IS NOT NULL THEN 300.0 * e[i * 3 + 1] + 640.0 + d END AS u, CASE WHEN d IS NOT NULL THEN 300.0 * e[i * 3 + 2] + 360.0 END AS v FROM every, (SELECT unnest(range(21)) AS i)),
near AS (
    SELECT *, last_value(CASE WHEN u IS NOT NULL THEN row(frame, u, v) END IGNORE NULLS) OVER w AS b, first_value(CASE WHEN u IS NOT NULL THEN row(frame, u, v) END IGNORE NULLS) OVER (PARTITION BY episode, side, i ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
    FROM points WINDOW w AS (PARTITION BY episode, side, i ORDER BY frame)
), filled AS (
    SELECT episode, frame, side, i, u IS NOT NULL AS direct, coalesce(u, b[2] + (a[2] - b[2]) * (frame - b[1]) / nullif(CAST(a[1] - b[1] AS DOUBLE), 0), b[2], a[2]) AS u,
        coalesce(v, b[3] + (a[3] - b[3]) * (frame - b[1]) / nullif(CAST(a[1] - b[1] AS DOUBLE), 0), b[3], a[3]) AS v FROM near
), sums AS (
    SELECT episode, frame, side, CASE WHEN bool_or(direct) THEN 1.0 ELSE 0.55 END AS confidence, sum(u) AS u, sum(v) AS v, max(u) FILTER (i = 0) AS wu, max(v) FILTER (i = 0) AS wv,
        max(u) FILTER (i = 0) - avg(u) FILTER (i IN (5, 9, 13, 17)) AS du, max(v) FILTER (i = 0) - avg(v) FILTER (i IN (5, 9, 13, 17)) AS dv FROM filled GROUP BY 1, 2, 3
)
SELECT episode, frame, side, CAST(confidence AS DOUBLE) AS confidence, round(u, 3) AS u, round(v, 3) AS v, round(3 * wu + 250.0 * du / greatest(sqrt(du * du + dv * dv), 1e-4), 3) AS markers_u,
    round(3 * wv + 250.0 * dv / greatest(sqrt(du * du + dv * dv), 1e-4), 3) AS markers_v FROM sums"""


def manifest_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a manifest of version 2, written as JSON and read again."""
    entry = F.struct(F.col("o_orderkey").cast("string").alias("episode"), F.floor(F.col("o_totalprice") / 1000).alias("frames"))
    texts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.lit(2).alias("version"), F.sort_array(F.collect_list(entry)).alias("episodes"))).alias("value"))
    found = C.manifest(texts)
    return found.select(F.explode("episodes").alias("e")).select(F.col("e.episode").cast("long").alias("episode"), F.col("e.frames").cast("long").alias("frames"))


GUARD_SQL = "SELECT o_orderkey AS episode, CAST(floor(o_totalprice / 1000) AS BIGINT) AS frames FROM orders"


def session_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each customer's session, some of whose calibrations are not complete."""
    k = F.col("c_nationkey")
    full = F.array(F.lit(1000.0), F.lit(800.0))
    calibration = F.struct(
        F.when(k % 3 != 0, F.array(400.0 + k, F.lit(420.0))).alias("focal_length"), F.when(k % 4 != 0, F.array(F.lit(320.0), 240.0 + k)).alias("principal_point"),
        F.when(k % 5 != 0, full).alias("sensor_resolution"), F.when(k % 2 == 0, F.array(F.lit(500.0), 200.0 + k)).alias("current_resolution"),
    )
    base = F.struct(*(F.when(k % 7 != 0, F.lit(v)).alias(n) for n, v in (("fx", 500.0), ("fy", 510.0), ("cx", 330.0), ("cy", 250.0))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(calibration.alias("camera_calibration"), base.alias("projection_defaults")).alias("s"))
    camera = G.session_camera(F.col("s"), F.lit(640.0), F.lit(480.0))
    return rows.withColumn("c", camera).select("c_custkey", *(F.round(f"c.{x}", 5).alias(x) for x in ("fx", "fy", "cx", "cy")))


def _cameras_sql() -> str:
    d = {k: f"{v!r}::DOUBLE" for k, v in G.DEFAULT_CAMERA.items()}
    pick = lambda first, low, name: f"coalesce({first}, CASE WHEN k % 7 <> 0 THEN {low} END, {d[name]})"
    return f"""WITH s AS (
    SELECT c_custkey, c_nationkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN 500.0 ELSE 640.0 END AS cw, CASE WHEN c_nationkey % 2 = 0 THEN 200.0 + c_nationkey ELSE 480.0 END AS ch,
        CASE WHEN c_nationkey % 5 <> 0 THEN 1000.0 WHEN c_nationkey % 2 = 0 THEN 500.0 ELSE 640.0 END AS sw, CASE WHEN c_nationkey % 5 <> 0 THEN 800.0 WHEN c_nationkey % 2 = 0 THEN 200.0 + c_nationkey ELSE 480.0 END AS sh FROM customer
), r AS (SELECT *, CAST(cw AS DOUBLE) / sw AS rx, CAST(ch AS DOUBLE) / sh AS ry FROM s), z AS (SELECT *, sw * rx / greatest(rx, ry) AS w, sh * ry / greatest(rx, ry) AS h FROM r)
SELECT c_custkey, round({pick("CASE WHEN k % 3 <> 0 THEN 400.0 + k END", "500.0", "fx")} * 640 / w, 5) AS fx, round({pick("CASE WHEN k % 3 <> 0 THEN 420.0 END", "510.0", "fy")} * 480 / h, 5) AS fy,
    round(({pick("CASE WHEN k % 4 <> 0 THEN 320.0 END", "330.0", "cx")} - (sw - w) * 0.5) * 640 / w, 5) AS cx, round(480 - ({pick("CASE WHEN k % 4 <> 0 THEN 240.0 + k END", "250.0", "cy")} - (sh - h) * 0.5) * 480 / h, 5) AS cy FROM z"""


def pixel_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks' pixels as poses without a turn: where they carry the point (1, 2, 3)."""
    rows = landmarks(spark, sf_dir).select("frame", F.transform("points", lambda p: F.struct(p[0].alias("u"), p[1].alias("v"))).alias("px"))
    poses = rows.select("frame", F.posexplode(V.pixel_poses(F.col("px"))).alias("landmark", "p"))
    moved = F.zip_with(P.times(F.col("p.r"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), F.col("p.t"), lambda a, b: a + b)
    return poses.select("frame", F.col("landmark").cast("long").alias("landmark"), *(F.round(moved[i], 6).alias(x) for i, x in enumerate("xyz")))


PIXEL_SQL = "SELECT vec_id AS frame, k AS landmark, round(1 + CAST(embedding[k * 3 + 1] AS DOUBLE), 6) AS x, round(2 + CAST(embedding[k * 3 + 2] AS DOUBLE), 6) AS y, 3.0::DOUBLE AS z FROM embeddings, (SELECT unnest(range(21)) AS k)"


def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of events in any spelling, links to hide sorted, messages about memory, and stored numbers as shares."""
    e, k = F.col("event_type"), F.col("event_id")
    spelled = F.concat(F.lit(" "), F.when(e.isin("click", "view"), F.when(k % 2 == 0, "LEFT").otherwise("Left")).otherwise("right "))
    links = F.when(k % 3 == 0, F.array(F.lit("palm"), F.lit("base"), F.lit("palm"))).otherwise(F.array(F.lit("wrist")))
    message = F.when(k % 5 == 0, "CUDA error: Out of memory").when(k % 5 == 1, "out of memory").otherwise("cuda ok")
    return table(spark, sf_dir, "events").select(
        "event_id", V.side_name(spelled).alias("side"), F.array_join(V.hidden_links(links, ("base", "palm", "wrist")), ",").alias("links"), V.out_of_memory(message).alias("memory"), F.round(V.unit_scale(F.col("value"), 250.0), 6).alias("share")
    )


NAMES_SQL = f"""SELECT event_id, {SIDE} AS side, CASE WHEN event_id % 3 = 0 THEN 'base,palm' ELSE 'wrist' END AS links, event_id % 5 = 0 AS memory, round(least(1.0, greatest(0.0, value / 250.0)), 6) AS share FROM events"""


def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: whether each is the expected one, by size first, then by hash."""
    p, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    size = F.octet_length(html).cast("long")
    sha = F.upper(F.sha2(F.concat(html, F.when(p % 7 == 0, "x").otherwise("")), 256))
    return table(spark, sf_dir, "pages").select("page_id", V.is_file(size, size + (p % 5 == 0).cast("long"), html, sha).alias("same"))


FILES_SQL = "SELECT page_id, page_id % 5 <> 0 AND page_id % 7 <> 0 AS same FROM pages"


def name_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as jobs in the order of their names, each to the lane with the least so far."""
    jobs = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", "s_suppkey", (F.col("s_suppkey") % 7 + 1).alias("cost"))
    out = B.assign_lanes(jobs, ["s_nationkey"], "cost", [F.col("s_name")], 2)
    return out.select("s_nationkey", "s_name", F.col("lane").cast("long").alias("lane"))


LANES_SQL = """WITH RECURSIVE jobs AS (SELECT s_nationkey AS g, s_name, s_suppkey % 7 + 1 AS cost, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS place FROM supplier),
fold AS (
    SELECT g, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS lane, CAST(NULL AS VARCHAR) AS s_name FROM (SELECT DISTINCT g FROM jobs)
    UNION ALL SELECT f.g, j.place, CAST(f.a + CASE WHEN f.a <= f.b THEN cost ELSE 0 END AS BIGINT), CAST(f.b + CASE WHEN f.a <= f.b THEN 0 ELSE cost END AS BIGINT), CASE WHEN f.a <= f.b THEN 0 ELSE 1 END, j.s_name FROM fold f JOIN jobs j ON j.g = f.g AND j.place = f.place + 1
)
SELECT g AS s_nationkey, s_name, lane FROM fold WHERE place > 0"""


def sliced_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 3 to 12 of every recording: by their numbers (counted from 0 again), and by position."""
    rows = frames(spark, sf_dir).select("episode", "frame", "signal")
    by_number = C.slice_recording({"frames": rows}, "frame", 1 << 40, 3, 12)["frames"].withColumn("how", F.lit("number"))
    by_place = slice_rows(rows, ["episode"], "frame", 3, 12).withColumn("how", F.lit("place"))
    return by_number.unionByName(by_place)


SLICE_SQL = f"WITH {FRAMES}, kept AS (SELECT episode, frame, signal FROM frames WHERE frame >= 3 AND frame < 12) SELECT episode, frame - 3 AS frame, signal, 'number' AS how FROM kept UNION ALL SELECT episode, frame, signal, 'place' FROM kept"


def layered_mattes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with both layers of their mattes; either layer has every frame."""
    rows = frames(spark, sf_dir).select("episode", "frame")
    signal = frames(spark, sf_dir).select("episode", "frame", F.round(F.col("signal") / 250.0, 6).alias("alpha"))
    colour = frames(spark, sf_dir).select("episode", "frame", F.length("event_type").alias("colour"))
    return C.mattes(rows, signal, colour, ["episode", "frame"])


MATTES_SQL = f"WITH {FRAMES} SELECT episode, frame, round(signal / 250.0, 6) AS alpha, length(event_type) AS colour FROM frames"


QUERIES = {
    "rgb_landmarks": (rgb_landmarks, RGB_SQL),
    "manifest_guard": (manifest_guard, GUARD_SQL),
    "session_cameras": (session_cameras, _cameras_sql()),
    "pixel_poses": (pixel_poses, PIXEL_SQL),
    "normal_names": (normal_names, NAMES_SQL),
    "checked_files": (checked_files, FILES_SQL),
    "name_lanes": (name_lanes, LANES_SQL),
    "sliced_recording": (sliced_recording, SLICE_SQL),
    "layered_mattes": (layered_mattes, MATTES_SQL),
}
