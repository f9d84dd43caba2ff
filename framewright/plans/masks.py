"""Queries over masks, gates and blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import masks as M
from framewright.operators import verification as C
from framewright.operators import visibility as V
from framewright.plans.visibility import CAMERA, FRAMES, POINTS, SEEN
from framewright.sources.tables import frames, landmarks, masks, table

CELLS = """masks AS (
    SELECT conv_id AS episode, turn AS frame, list_distinct(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS cells FROM conversations
)"""


def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's masks against their own last ones, over an area of 1000 cells."""
    w = W.partitionBy("episode").orderBy("frame")
    rows = masks(spark, sf_dir).withColumn("other", F.coalesce(F.lag("cells").over(w), F.col("cells")))
    out = M.sequence_metrics(rows, ["episode"], "frame", "cells", "other", 1000.0)
    return out.select("episode", *[F.round(c, 6).alias(c) for c in ("mean_iou", "min_iou", "mean_area", "change")])


IOU_SQL = f"""WITH {CELLS}, pairs AS (SELECT *, lag(cells) OVER (PARTITION BY episode ORDER BY frame) AS was FROM masks),
counted AS (
    SELECT episode, len(cells) AS area, len(list_intersect(cells, coalesce(was, cells))) AS common, len(list_distinct(list_concat(cells, coalesce(was, cells)))) AS union_,
        CASE WHEN was IS NOT NULL THEN (len(cells) + len(was) - 2 * len(list_intersect(cells, was))) / 1000.0 END AS change FROM pairs
)
SELECT episode, round(avg(CASE WHEN union_ = 0 THEN 1.0 ELSE common / union_ END), 6) AS mean_iou, round(min(CASE WHEN union_ = 0 THEN 1.0 ELSE common / union_ END), 6) AS min_iou,
    round(avg(area), 6) AS mean_area, round(coalesce(avg(CAST(change AS DOUBLE)), 0.0), 6) AS change FROM counted GROUP BY 1"""


def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.union_cells(masks(spark, sf_dir), ["episode"], "cells")
    return out.select("episode", F.size("cells").cast("long").alias("area"), F.sha2(F.array_join("cells", "|"), 256).alias("digest"))


UNION_SQL = f"""WITH {CELLS}, each AS (SELECT episode, unnest(cells) AS c FROM masks), held AS (SELECT episode, list(DISTINCT c) AS l FROM each GROUP BY 1)
SELECT m.episode, coalesce(len(l), 0) AS area, sha256(coalesce(array_to_string(list_sort(l), '|'), '')) AS digest FROM (SELECT DISTINCT episode FROM masks) m LEFT JOIN held h ON m.episode = h.episode"""


def mask_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kind of event covers each 5 x 5 cell of signal and user most."""
    events = table(spark, sf_dir, "events").select(F.floor(F.col("value") / 5).alias("x"), F.floor(F.col("user_id") / 5).alias("y"), "event_type")
    cover = events.groupBy("x", "y", "event_type").agg(F.count("*").alias("coverage"))
    ranked = cover.withColumn("ord", F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")))
    return M.partition_classes(ranked, ["x", "y"], "event_type", "coverage", "ord")


PARTITION_SQL = """WITH cover AS (SELECT CAST(floor(value / 5) AS BIGINT) AS x, CAST(floor(user_id / 5.0) AS BIGINT) AS y, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT x, y, event_type FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, event_type) AS place FROM cover) WHERE place = 1"""


def visibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per side: frames where a robot may show (a human is seen and the robot has 9 pixels), and those with only one of them."""
    rows = frames(spark, sf_dir).select(
        "episode", "frame", F.when(F.col("event_type").isin("click", "view"), "left").otherwise("right").alias("side"), (F.col("signal") > SEEN).alias("human"), F.length("props").alias("pixels")
    )
    rows = V.frame_gate(rows, ["episode", "frame"], "human", "pixels", 9)
    robot = F.col("pixels") >= 9
    return C.gate_summary(rows, ["episode", "side"], "frame", F.col("human"), robot, F.col("permitted"), F.col("inpainted"))


GATE_SQL = f"""WITH {FRAMES}, rows AS (SELECT episode, frame, CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS side, signal > {SEEN} AS human, length(props) > 8 AS robot FROM frames)
SELECT episode, side, count(*) FILTER (robot) AS robot_visible, count(*) FILTER (robot AND human) AS composited, coalesce(string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) FILTER (human AND NOT robot), '') AS human_only,
    coalesce(string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) FILTER (robot AND NOT human), '') AS robot_only, bool_or(human) AS inpainted FROM rows GROUP BY 1, 2"""


SMALL = CAMERA.scaled(0.05)  # a raster of 64 x 64


def coverage_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a frame's landmarks in view that lie on its mask (a disc in the middle, of 10 to 24 cells), with totals over episodes."""
    shown = landmarks(spark, sf_dir)
    points = shown.select("episode", "frame", F.explode("points").alias("p")).withColumn("px", G.project(F.col("p"), SMALL)).filter(G.in_view(F.col("px"), SMALL))
    reach = (F.lit(10) + F.col("frame") % 15).cast("int")
    lines = shown.select("episode", "frame", reach.alias("r")).withColumn("y", F.explode(F.sequence(32 - F.col("r"), 32 + F.col("r"))))
    half = F.floor(F.sqrt((F.col("r") * F.col("r") - (F.col("y") - 32) * (F.col("y") - 32)).cast("double")))
    runs = lines.select("episode", "frame", "y", (32 - half).alias("a"), (33 + half).alias("b"))
    per = M.point_coverage(points.select("episode", "frame", "px.u", "px.v"), runs, ["episode", "frame"], shown)
    return per.rollup("episode").agg(
        F.count("*").alias("n"), F.round(F.min("share"), 6).alias("lowest"), F.round(F.expr("percentile(share, 0.5)"), 6).alias("middle"), F.round(F.max("share"), 6).alias("highest"),
        F.count_if(F.col("share") < 0.4).alias("low"), F.count_if(F.col("share") > 0.2).alias("leaking"),
    )


COVERAGE_SQL = f"""WITH {POINTS}, px AS (SELECT *, CASE WHEN abs(z) > 1e-6 THEN {SMALL.fx!r} * x / z + {SMALL.cx!r} END AS u, CASE WHEN abs(z) > 1e-6 THEN {SMALL.fy!r} * y / z + {SMALL.cy!r} END AS v FROM points),
inside AS (
    SELECT episode, frame, CASE WHEN u >= 0 AND u < {SMALL.width} AND v >= 0 AND v < {SMALL.height} THEN CASE WHEN pow(floor(u) - 32, 2) + pow(floor(v) - 32, 2) <= pow(10 + frame % 15, 2) THEN 1.0 ELSE 0.0 END END AS hit FROM px
), per AS (SELECT CAST(episode AS BIGINT) AS episode, frame, coalesce(CAST(avg(hit) AS DOUBLE), 0.0) AS share FROM inside GROUP BY 1, 2)
SELECT episode, count(*) AS n, round(min(share), 6) AS lowest, round(median(share), 6) AS middle, round(max(share), 6) AS highest, count(*) FILTER (share < 0.4) AS low, count(*) FILTER (share > 0.2) AS leaking FROM per GROUP BY ROLLUP (episode)"""


def sleeve_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of events as the pixels of sleeves: the place in the recording along, half the signal across; two stretches show nothing."""
    last = F.max("frame").over(W.partitionBy("episode"))
    kind = F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("kind")
    rows = frames(spark, sf_dir).select(kind, (F.col("frame") / (last + 1)).alias("along"), (F.col("signal") / 2).alias("across"))
    rows = rows.filter(~((F.col("along") >= 0.27) & (F.col("along") < 0.45)) & (F.col("along") < 0.91))
    out = M.sleeve_profile(rows, ["kind"], "along", "across")
    return out.select("kind", F.col("bin").cast("long").alias("bin"), F.round("radius", 5).alias("radius"))


SLEEVE_SQL = f"""WITH {FRAMES}, placed AS (
    SELECT CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS kind, frame / CAST(max(frame) OVER (PARTITION BY episode) + 1 AS DOUBLE) AS along, signal / 2 AS across FROM frames
), points AS (SELECT * FROM placed WHERE NOT (along >= 0.27 AND along < 0.45) AND along < 0.91),
bins AS (SELECT kind, CAST(floor(along * 12) AS BIGINT) AS bin, count(*) AS n, quantile_cont(across, 0.92) AS r FROM points GROUP BY 1, 2), known AS (SELECT * FROM bins WHERE n >= 24),
every AS (SELECT kind, unnest(range(12)) AS bin FROM (SELECT DISTINCT kind FROM bins)),
sides AS (SELECT e.kind, e.bin, max(k.bin) FILTER (k.bin <= e.bin) AS b, min(k.bin) FILTER (k.bin >= e.bin) AS a FROM every e JOIN known k ON k.kind = e.kind GROUP BY 1, 2),
filled AS (
    SELECT s.kind, s.bin, least(88.0, greatest(28.0, coalesce(x.r + (y.r - x.r) * ((s.bin - b) / nullif(CAST(a - b AS DOUBLE), 0)), x.r, y.r) + 12)) AS w
    FROM sides s LEFT JOIN known x ON x.kind = s.kind AND x.bin = b LEFT JOIN known y ON y.kind = s.kind AND y.bin = a
), smooth AS (SELECT kind, bin, 0.25 * coalesce(lag(w) OVER q, 0.0) + 0.5 * w + 0.25 * coalesce(lead(w) OVER q, 0.0) AS s FROM filled WINDOW q AS (PARTITION BY kind ORDER BY bin))
SELECT kind, bin, round(CASE bin WHEN 0 THEN 0.75 * s + 0.25 * lead(s) OVER q WHEN 11 THEN 0.75 * s + 0.25 * lag(s) OVER q ELSE s END, 5) AS radius FROM smooth WINDOW q AS (PARTITION BY kind ORDER BY bin)"""


def compact_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per episode: the smallest mask among those with a margin of 85 % of the best and a usable size, else the one with the best margin."""
    rows = frames(spark, sf_dir).select("episode", "frame", (F.col("signal") / 500).alias("area"), F.get_json_object("props", "$.k").cast("long").alias("margin"))
    return M.compact_reference(rows, ["episode"], "frame", "margin", "area")


REFERENCE_SQL = f"""WITH {FRAMES}, rows AS (SELECT episode, frame, signal / 500 AS area, CAST(json_extract(props, '$.k') AS BIGINT) AS margin FROM frames),
marked AS (SELECT *, margin >= 0.85 * max(margin) OVER (PARTITION BY episode) AND area BETWEEN 0.002 AND 0.2 AS good FROM rows)
SELECT episode, coalesce(arg_min(frame, row(area, frame)) FILTER (good), arg_max(frame, row(margin, -frame))) AS frame FROM marked GROUP BY 1"""


def colour_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, and 1.4826 times the median deviation but 10 at least, of each kind's signal."""
    out = M.colour_model(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", 10.0)
    return out.select("event_type", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


COLOUR_SQL = """WITH m AS (SELECT event_type, median(value) AS centre FROM events GROUP BY 1)
SELECT e.event_type, round(any_value(centre), 6) AS centre, round(greatest(10.0, 1.4826 * median(abs(value - centre))), 6) AS scale FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1"""


def premultiplied_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a pixel accumulated and composited over a grey background; and the plain blend with its alpha."""
    samples = frames(spark, sf_dir).select("episode", F.floor(F.col("frame") / 4).alias("pixel"), F.least(F.col("signal"), F.lit(255.0)).alias("colour"), F.when(F.col("event_type") == "error", 0.0).otherwise(0.5).alias("alpha"))
    out = M.accumulate(samples, ["episode", "pixel"], "colour", "alpha")
    return out.select(
        "episode", "pixel", F.round("alpha", 6).alias("alpha"), F.round("straight", 6).alias("straight"),
        M.over(F.lit(100.0), F.col("premultiplied"), F.col("alpha")).alias("composite"), M.blended(F.lit(100.0), F.col("straight"), F.col("alpha")).alias("blend"),
    )


BLEND_SQL = f"""WITH {FRAMES}, samples AS (SELECT episode, frame // 4 AS pixel, least(signal, 255.0) AS colour, CASE WHEN event_type = 'error' THEN 0.0 ELSE 0.5 END AS alpha FROM frames),
held AS (SELECT episode, pixel, avg(colour * alpha) AS pm, avg(CAST(alpha AS DOUBLE)) AS a FROM samples GROUP BY 1, 2), s AS (SELECT *, CASE WHEN a > 1e-6 THEN pm / a ELSE 0.0 END AS straight FROM held)
SELECT episode, pixel, round(a, 6) AS alpha, round(straight, 6) AS straight, CAST(least(255.0, greatest(0.0, round_even(pm + 100.0 * (1.0 - a), 0))) AS INTEGER) AS composite,
    CAST(trunc(least(255.0, greatest(0.0, 100.0 * (1.0 - a) + straight * a))) AS INTEGER) AS blend FROM s"""


def crossfade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two renderings of a recording, joined frame by frame and faded from one to the other."""
    one = frames(spark, sf_dir)
    base, other = one.select("episode", "frame", F.col("signal").alias("a")), one.select("episode", "frame", (F.col("signal") * 2).alias("b"))
    weight = M.crossfade(F.col("frame"), 10.0, 30.0)
    return G.aligned(base, other, ["episode", "frame"]).select("episode", "frame", F.round((1 - weight) * F.col("a") + weight * F.col("b"), 6).alias("value"))


CROSSFADE_SQL = f"""WITH {FRAMES}, w AS (SELECT *, least(1.0, greatest(0.0, (frame - 10.0) / 20.0)) AS k FROM frames)
SELECT episode, frame, round((1 - k) * signal + k * signal * 2, 6) AS value FROM w"""


def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a frame: the best score of each side, the first on ties."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("string").alias("frame"), F.col("event_type").alias("side"), F.col("event_id").alias("detection"), F.round("value").alias("score"))
    best = rows.groupBy("frame", "side").agg(F.max(F.struct("score", (-F.col("detection")).alias("d"))).alias("b"))
    return best.select(F.substring("frame", 1, 10).alias("frame"), "side", (-F.col("b.d")).alias("detection"), F.col("b.score").alias("score"))


BEST_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS frame, event_type AS side, arg_max(event_id, row(round(value, 0), -event_id)) AS detection, max(round(value, 0)) AS score FROM events GROUP BY 1, 2"""


QUERIES = {
    "mask_iou": (mask_iou, IOU_SQL),
    "mask_union": (mask_union, UNION_SQL),
    "mask_partition": (mask_partition, PARTITION_SQL),
    "visibility_gate": (visibility_gate, GATE_SQL),
    "coverage_leakage": (coverage_leakage, COVERAGE_SQL),
    "sleeve_profile": (sleeve_profile, SLEEVE_SQL),
    "compact_reference": (compact_reference, REFERENCE_SQL),
    "colour_model": (colour_model, COLOUR_SQL),
    "premultiplied_blend": (premultiplied_blend, BLEND_SQL),
    "crossfade": (crossfade, CROSSFADE_SQL),
    "best_detection": (best_detection, BEST_SQL),
}
