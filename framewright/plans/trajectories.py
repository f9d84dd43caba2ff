"""Queries over trajectories: robust windows, interpolation, quaternions and solvers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import intervals as I
from framewright.operators import smoothing as S
from framewright.plans.visibility import EP, FRAMES
from framewright.sources.tables import frames, landmarks, quaternions, table

W7 = S.kernel(7)


def hampel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hampel(frames(spark, sf_dir), EP, "frame", "signal", 7, 3.5, 0.08).select("episode", "frame", F.round("filtered", 6).alias("filtered"))


HAMPEL_SQL = f"""WITH {FRAMES}, held AS (
    SELECT episode, frame, signal, list(signal) OVER w AS near, median(signal) OVER w AS m, count(*) OVER (PARTITION BY episode) AS n
    FROM frames WINDOW w AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
)
SELECT episode, frame, round(CASE WHEN n >= 3 AND abs(signal - m) > greatest(0.08, 3.5 * 1.4826 * list_median(list_transform(near, lambda x: abs(x - m)))) THEN m ELSE signal END, 6) AS filtered FROM held""".replace(
    "list_median(", "list_aggregate("
).replace("abs(x - m)))) THEN", "abs(x - m)), 'median')) THEN")


def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gaussian(frames(spark, sf_dir), EP, "frame", "signal", 7).select("episode", "frame", F.round("smoothed", 6).alias("smoothed"))


def weighted_sql(value: str, weights: list[float], missing: str = "0.0") -> str:
    half = len(weights) // 2
    at = lambda k: value if not k else f"{'lead' if k > 0 else 'lag'}({value}, {abs(k)}) OVER w"
    top = " + ".join(f"coalesce({at(k)} * {weights[k + half]!r}, 0.0)" for k in range(-half, half + 1))
    low = " + ".join(f"CASE WHEN {at(k)} IS NULL THEN 0.0 ELSE {weights[k + half]!r} END" for k in range(-half, half + 1))
    return f"({top}) / CAST({low} AS DOUBLE)"


GAUSSIAN_SQL = f"WITH {FRAMES} SELECT episode, frame, round({weighted_sql('signal', W7)}, 6) AS smoothed FROM frames WINDOW w AS (PARTITION BY episode ORDER BY frame)"


def gap_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("known", F.col("event_type") != "error")
    return I.interpolate_gaps(rows, EP, "frame", "signal", "known").select("episode", "frame", F.round("filled", 6).alias("filled"), "confidence")


INTERPOLATE_SQL = f"""WITH {FRAMES}, known AS (SELECT episode, frame, signal, event_type <> 'error' AS known FROM frames),
sides AS (
    SELECT *, max(CASE WHEN known THEN frame END) OVER (PARTITION BY episode ORDER BY frame) AS b, min(CASE WHEN known THEN frame END) OVER (PARTITION BY episode ORDER BY frame DESC) AS a FROM known
), pair AS (
    SELECT x.episode, x.frame, x.known, x.signal, x.b, x.a, p.signal AS bv, q.signal AS av FROM sides x
    LEFT JOIN known p ON x.episode = p.episode AND x.b = p.frame LEFT JOIN known q ON x.episode = q.episode AND x.a = q.frame
)
SELECT episode, frame, round(CASE WHEN known THEN signal WHEN b IS NULL THEN av WHEN a IS NULL THEN bv ELSE bv + (av - bv) * ((frame - b) / CAST(a - b AS DOUBLE)) END, 6) AS filled,
    CASE WHEN known THEN 1.0::DOUBLE WHEN coalesce(b, a) IS NOT NULL THEN 0.55::DOUBLE END AS confidence FROM pair"""


def unwrap_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.pmod(F.col("signal"), F.lit(2 * math.pi)) - math.pi
    rows = S.unwrap(frames(spark, sf_dir).withColumn("angle", angle), EP, "frame", "angle")
    torus = S.wrapped_distance(F.array("angle", "unwrapped"), F.array(F.lit(0.0), F.lit(0.0)))
    return rows.select("episode", "frame", F.round("unwrapped", 5).alias("unwrapped"), F.round(torus, 5).alias("torus"))


TAU = repr(2 * math.pi)
ANGLES = f"""{FRAMES}, angles AS (SELECT episode, frame, (signal - {TAU} * floor(signal / {TAU})) - {math.pi!r} AS angle FROM frames)"""
STEPS = f"""{ANGLES}, steps AS (SELECT *, angle - lag(angle) OVER (PARTITION BY episode ORDER BY frame) AS d FROM angles),
shifts AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < {math.pi!r} THEN 0.0 ELSE (d + {math.pi!r} - {TAU} * floor((d + {math.pi!r}) / {TAU}) - {math.pi!r}) - d END AS s FROM steps),
unwrapped AS (SELECT *, angle + sum(s) OVER (PARTITION BY episode ORDER BY frame) AS u FROM shifts)"""
UNWRAP_SQL = f"WITH {STEPS} SELECT episode, frame, round(u, 5) AS unwrapped, round(sqrt(pow(atan2(sin(angle), cos(angle)), 2) + pow(atan2(sin(u), cos(u)), 2)), 5) AS torus FROM unwrapped"


def boundary_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from 20 on are a chunk, the 6 before them the tail of the one before."""
    angle = F.pmod(F.col("signal"), F.lit(2 * math.pi)) - math.pi
    rows = frames(spark, sf_dir).withColumn("angle", angle).withColumn("at", F.col("frame") - 20)
    return S.smooth_boundary(rows, EP, "at", "angle", 6, -3.0, 3.0).select("episode", "at", F.round("smoothed", 5).alias("smoothed"))


def _hann_sql() -> str:
    at = lambda k: "u" if not k else f"coalesce({'lead' if k > 0 else 'lag'}(u, {abs(k)}) OVER w, {'first_value' if k < 0 else 'last_value'}(u) OVER all_rows)"
    p = lambda k: f"CASE WHEN {abs(k)} <= r THEN 0.5 + 0.5 * cos({math.pi!r} * {k} / r) ELSE 0.0 END"
    return f"({' + '.join(f'{p(k)} * {at(k)}' for k in range(-6, 7))}) / ({' + '.join(p(k) for k in range(-6, 7))})"


BOUNDARY_SQL = f"""WITH {ANGLES.replace("frame, (signal", "frame - 20 AS frame, (signal").replace("FROM frames)", "FROM frames WHERE frame >= 14)")}, {STEPS.split("AS angle FROM frames), ")[1]},
sized AS (SELECT *, least(6, greatest(1, (count(*) OVER (PARTITION BY episode) - 1) // 2)) AS r, count(*) OVER (PARTITION BY episode) AS n, count(*) FILTER (frame >= 0) OVER (PARTITION BY episode) AS m FROM unwrapped),
means AS (
    SELECT *, {_hann_sql()} AS mean FROM sized
    WINDOW w AS (PARTITION BY episode ORDER BY frame), all_rows AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT episode, frame AS at, round(CASE WHEN n > m AND m >= 2 THEN least(3.0, greatest(-3.0, mean + {TAU} * round_even((angle - mean) / {TAU}, 0))) ELSE angle END, 5) AS smoothed FROM means WHERE frame >= 0"""


def quaternion_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quaternions(spark, sf_dir).withColumn("q", G.unit(F.col("q")))
    out = G.continuous(rows, EP, "frame", "q")
    return out.select("episode", "frame", *[F.round(F.col("continuous")[i], 6).alias(f"q{i}") for i in range(4)])


QUATS = """raw AS (
    SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), quats AS (SELECT episode, frame, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS q FROM raw)"""
DOT = "({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3] + {a}[4] * {b}[4])"


def continuous_sql(source: str, out: str) -> str:
    """Signs by the parity of the negative dots since the last dot of zero."""
    w = "OVER (PARTITION BY episode ORDER BY frame)"
    return f"""{out}_before AS (SELECT episode, frame, q, lag(q) {w} AS p FROM {source}), {out}_dots AS (SELECT *, coalesce({DOT.format(a="p", b="q")}, 1.0) AS d FROM {out}_before),
{out}_counts AS (SELECT *, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) {w} AS n FROM {out}_dots), {out}_bases AS (SELECT *, coalesce(max(CASE WHEN d = 0 THEN n END) {w}, 0) AS base FROM {out}_counts),
{out} AS (SELECT episode, frame, list_transform(q, lambda x: CASE WHEN (n - base) % 2 = 1 THEN -x ELSE x END) AS q FROM {out}_bases)"""


Q4 = ", ".join(f"round(q[{i + 1}], 6) AS q{i}" for i in range(4))
CONTINUITY_SQL = f"WITH {QUATS}, {continuous_sql('quats', 'steady')} SELECT episode, frame, {Q4} FROM steady"


def quaternion_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quaternions(spark, sf_dir).withColumn("q", G.unit(F.col("q")))
    out = G.medoid_filter(rows, EP, "frame", "q", 5, 1.0, math.radians(20))
    return out.select("episode", "frame", *[F.round(F.col("q_kept")[i], 6).alias(f"q{i}") for i in range(4)])


ANGLE = "(2 * acos(least(1.0, abs(" + DOT + "))))"
MEDOID_SQL = f"""WITH {QUATS}, near AS (SELECT a.episode, a.frame, a.q AS centre, b.frame AS i, b.q, count(*) OVER (PARTITION BY a.episode, a.frame) AS n
    FROM quats a JOIN quats b ON a.episode = b.episode AND b.frame BETWEEN a.frame - 2 AND a.frame + 2),
costs AS (SELECT x.episode, x.frame, x.i, x.q, x.centre, sum({ANGLE.format(a="x.q", b="y.q")}) AS cost FROM near x JOIN near y ON x.episode = y.episode AND x.frame = y.frame GROUP BY ALL),
medoids AS (SELECT episode, frame, centre, arg_min(q, row(cost, i)) AS m FROM costs GROUP BY ALL),
angles AS (SELECT d.episode, d.frame, d.centre, d.m, list({ANGLE.format(a="n.q", b="d.m")}) AS a FROM medoids d JOIN near n ON d.episode = n.episode AND d.frame = n.frame GROUP BY ALL),
spread AS (SELECT *, list_aggregate(a, 'median') AS med FROM angles),
kept AS (SELECT episode, frame, CASE WHEN {ANGLE.format(a='centre', b='m')} > greatest({math.radians(20)!r}, med + 1.4826 * list_aggregate(list_transform(a, lambda x: abs(x - med)), 'median')) THEN m ELSE centre END AS q FROM spread),
{continuous_sql('kept', 'steady')} SELECT episode, frame, {Q4} FROM steady"""


def quaternion_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quaternions(spark, sf_dir).withColumn("q", G.unit(F.col("q")))
    out = G.quaternion_mean(rows, EP, "frame", "q", S.kernel(5))
    return out.select("episode", "frame", *[F.round(F.col("q_mean")[i], 6).alias(f"q{i}") for i in range(4)])


def _mean_sql() -> str:
    k5 = S.kernel(5)
    at = lambda k: "q" if not k else f"{'lead' if k > 0 else 'lag'}(q, {abs(k)}) OVER w"
    held = f"near AS (SELECT episode, frame, q, {', '.join(f'{at(k)} AS n{k + 2}' for k in range(-2, 3))} FROM quats WINDOW w AS (PARTITION BY episode ORDER BY frame))"
    part = lambda i: " + ".join(f"coalesce(CASE WHEN {DOT.format(a=f'n{j}', b='q')} < 0 THEN -1.0 ELSE 1.0 END * n{j}[{i}] * {k5[j]!r}, 0.0)" for j in range(5))
    total = f"total AS (SELECT episode, frame, [{', '.join(part(i) for i in range(1, 5))}] AS t FROM near)"
    unit = f"units AS (SELECT episode, frame, list_transform(t, lambda x: x / sqrt({DOT.format(a='t', b='t')})) AS q FROM total)"
    return f"WITH {QUATS}, {held}, {total}, {unit}, {continuous_sql('units', 'steady')} SELECT episode, frame, {Q4} FROM steady"


def slerp_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("episode").orderBy("frame")
    rows = quaternions(spark, sf_dir).withColumn("q", G.unit(F.col("q"))).withColumn("n", F.lead("q").over(w)).filter(F.col("n").isNotNull())
    out = rows.withColumn("m", G.slerp(F.col("q"), F.col("n"), 0.25))
    return out.select("episode", "frame", *[F.round(F.col("m")[i], 6).alias(f"q{i}") for i in range(4)], F.round(G.quaternion_angle(F.col("q"), F.col("n")), 6).alias("angle"))


SLERP_SQL = f"""WITH {QUATS}, pairs AS (SELECT *, lead(q) OVER (PARTITION BY episode ORDER BY frame) AS n FROM quats),
arcs AS (SELECT *, {DOT.format(a="q", b="n")} AS d, least(1.0, abs({DOT.format(a="q", b="n")})) AS c FROM pairs WHERE n IS NOT NULL),
weights AS (SELECT *, CASE WHEN c > 0.9995 THEN 0.75 ELSE sin(0.75 * acos(c)) / sin(acos(c)) END AS wa, CASE WHEN c > 0.9995 THEN 0.25 ELSE sin(0.25 * acos(c)) / sin(acos(c)) END * CASE WHEN d < 0 THEN -1 ELSE 1 END AS wb FROM arcs),
mixed AS (SELECT *, [wa * q[1] + wb * n[1], wa * q[2] + wb * n[2], wa * q[3] + wb * n[3], wa * q[4] + wb * n[4]] AS m FROM weights)
SELECT episode, frame, {", ".join(f"round(m[{i + 1}] / sqrt({DOT.format(a='m', b='m')}), 6) AS q{i}" for i in range(4))}, round(2 * acos(c), 6) AS angle FROM mixed"""


def ema_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first frame of each episode whose signal is its median or more, outward."""
    half = F.expr("percentile(signal, 0.5)").over(W.partitionBy("episode"))
    rows = frames(spark, sf_dir).withColumn("ok", F.col("signal") >= half)
    rows = rows.withColumn("reference", F.col("ok") & (F.sum(F.col("ok").cast("int")).over(W.partitionBy("episode").orderBy("frame")) == 1))
    return S.ema(rows, EP, "frame", "signal", 0.12, "reference").select("episode", "frame", F.round("tracked", 6).alias("tracked"))


EMA_SQL = f"""WITH RECURSIVE {FRAMES}, starts AS (SELECT f.episode, min(frame) AS at FROM frames f JOIN (SELECT episode, median(signal) AS m FROM frames GROUP BY 1) h ON f.episode = h.episode AND signal >= m GROUP BY 1),
tracked AS (
    SELECT f.episode, f.frame, f.signal AS tracked, 0 AS way FROM frames f JOIN starts s ON f.episode = s.episode AND f.frame = s.at
    UNION ALL
    SELECT t.episode, f.frame, t.tracked + 0.12 * (f.signal - t.tracked), CASE WHEN f.frame > t.frame THEN 1 ELSE -1 END FROM tracked t JOIN frames f ON f.episode = t.episode
        AND ((t.way >= 0 AND f.frame = t.frame + 1) OR (t.way <= 0 AND f.frame = t.frame - 1))
)
SELECT episode, frame, round(tracked, 6) AS tracked FROM tracked"""


def derivative_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.derivative_limits(frames(spark, sf_dir), EP, "frame", "signal", 30.0, 600.0, 9000.0, 0.0, 400.0)
    # halves of the last digit are frequent here; both sides lean upwards, so the order of sums decides nothing
    return out.select("episode", "frame", "signal", F.round(F.col("limited") + 1e-9, 5).alias("limited"))


def limits_sql(source: str, speed: float, acceleration: float, low: float, high: float, rounds: int = 96) -> str:
    """limited (key, y) of a table (key, y list): each round clips, moves neighbours to the speed and triples to the acceleration, to and fro, until nothing is over.

    A sweep is a fold that carries the last one or two moved values; the way back is the same fold over the reversed list.
    """
    over = lambda v, b: f"({v} - least({b!r}::DOUBLE, greatest({-b!r}::DOUBLE, {v})))"
    step, bend = over("(x[1] - acc[len(acc)])", speed), over("(acc[len(acc) - 1] - 2 * acc[len(acc)] + x[1])", acceleration)
    pairs = f"list_reduce(list_transform(y, lambda v: [v]), lambda acc, x: list_concat(acc[1:len(acc) - 1], [acc[len(acc)] + {step} / 2, x[1] - {step} / 2]))"
    triples = f"""CASE WHEN len(y) < 3 THEN y ELSE list_reduce(list_concat([y[1:2]], list_transform(y[3:], lambda v: [v])),
        lambda acc, x: list_concat(acc[1:len(acc) - 2], [acc[len(acc) - 1] - {bend} / 6, acc[len(acc)] + {bend} / 3, x[1] - {bend} / 6])) END"""
    clip = lambda y: f"list_transform({y}, lambda v: least({high!r}::DOUBLE, greatest({low!r}::DOUBLE, v)))"
    worst = f"""greatest(coalesce(list_max(list_transform(range(1, len(y)), lambda i: abs(y[i + 1] - y[i]) - {speed!r})), 0),
        coalesce(list_max(list_transform(range(1, len(y) - 1), lambda i: abs(y[i] - 2 * y[i + 1] + y[i + 2]) - {acceleration!r})), 0))"""
    return f"""rounds AS (
    SELECT key, {clip("y")} AS y, 0 AS n, false AS done FROM {source}
    UNION ALL SELECT key, y, n, {worst} <= 1e-10 FROM (
        SELECT key, {clip("list_reverse(y)")} AS y, n FROM (SELECT key, {triples} AS y, n FROM (SELECT key, list_reverse({triples}) AS y, n FROM (
        SELECT key, list_reverse({pairs}) AS y, n FROM (SELECT key, list_reverse({pairs}) AS y, n + 1 AS n FROM rounds WHERE n < {rounds} AND NOT done))))
    )
), limited AS (SELECT key, arg_max(y, n) AS y FROM rounds GROUP BY key)"""


DERIVATIVE_SQL = f"""WITH RECURSIVE {FRAMES}, held AS (SELECT episode AS key, list(signal ORDER BY frame) AS y FROM frames GROUP BY 1), {limits_sql("held", 20.0, 10.0, 0.0, 400.0)},
each AS (SELECT key AS episode, unnest(range(len(y))) AS frame, unnest(y) AS limited FROM limited)
SELECT f.episode, f.frame, signal, round(limited + 1e-9, 5) AS limited FROM frames f JOIN each e ON e.episode = f.episode AND e.frame = f.frame"""


def angular_velocity_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quaternions(spark, sf_dir).withColumn("q", G.unit(F.col("q")))
    out = G.angular_limits(rows, EP, "frame", "q", 0.5)
    return out.select("episode", "frame", *[F.round(F.col("q_limited")[i], 6).alias(f"q{i}") for i in range(4)])


def _turns_sql(source: str, bound: float, rounds: int = 96) -> str:
    """Neighbours moved along their arc by half of what is too much, to and fro, until nothing is: a sweep is a fold that carries the last moved quaternion."""
    bind = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    # of the two the later frame takes the sign of the earlier one, on the way back too
    sign = lambda z, flips: f"CASE WHEN s.d < 0 THEN -{z} ELSE {z} END" if flips else z
    mixed = lambda share, back: bind(
        f"list_transform(list_zip(s.a, s.b), lambda z: CASE WHEN abs(s.d) > 0.9995 THEN 1 - {share} ELSE sin((1 - {share}) * s.t / 2) / sin(s.t / 2) END * {sign('z[1]', back)}"
        f" + CASE WHEN abs(s.d) > 0.9995 THEN {share} ELSE sin({share} * s.t / 2) / sin(s.t / 2) END * {sign('z[2]', not back)})",
        "c", "list_transform(c, lambda v: v / sqrt(list_inner_product(c, c)))",
    )
    share = f"((s.t - {bound!r}) / (2 * s.t))"
    pair = lambda back: bind(
        "{'a': acc[len(acc)], 'b': x[1], 'd': list_inner_product(acc[len(acc)], x[1]), 't': 2 * acos(least(1.0, abs(list_inner_product(acc[len(acc)], x[1]))))}",
        "s", f"CASE WHEN s.t - {bound!r} > 1e-10 THEN [{mixed(share, back)}, {mixed(f'(1 - {share})', back)}] ELSE [s.a, s.b] END",
    )
    sweep = lambda back: f"list_reduce(list_transform(y, lambda v: [v]), lambda acc, x: list_concat(acc[1:len(acc) - 1], {pair(back)}))"
    worst = f"coalesce(list_max(list_transform(range(1, len(y)), lambda i: 2 * acos(least(1.0, abs(list_inner_product(y[i], y[i + 1])))) - {bound!r})), 0)"
    return f"""turned AS (
    SELECT episode, list(q ORDER BY frame) AS y, 0 AS n, false AS done FROM {source} GROUP BY episode
    UNION ALL SELECT episode, y, n, {worst} <= 1e-10 FROM (
        SELECT episode, list_reverse({sweep(True)}) AS y, n FROM (SELECT episode, list_reverse({sweep(False)}) AS y, n + 1 AS n FROM turned WHERE n < {rounds} AND NOT done)
    )
), slow AS (SELECT episode, unnest(range(len(y))) AS frame, unnest(y) AS q FROM (SELECT episode, arg_max(y, n) AS y FROM turned GROUP BY episode))"""


TURNS_SQL = f"WITH RECURSIVE {QUATS}, {_turns_sql("quats", 0.5)}, {continuous_sql('slow', 'steady')} SELECT episode, frame, {Q4} FROM steady"


def step_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = landmarks(spark, sf_dir).withColumn("flat", F.flatten("points"))
    steps = S.step_norms(points, EP, "frame", "flat").filter(F.col("step").isNotNull())
    return steps.groupBy("episode").agg(F.round(F.expr("percentile(step, 0.5)"), 6).alias("median_step"), F.round(F.max("step"), 6).alias("max_step"), F.count("*").alias("n"))


STEP_SQL = """WITH points AS (SELECT CAST(label AS BIGINT) AS episode, vec_id AS frame, list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings),
pairs AS (SELECT *, lag(p) OVER (PARTITION BY episode ORDER BY frame) AS b FROM points),
steps AS (SELECT episode, sqrt(list_sum(list_transform(list_zip(p, b), lambda x: pow(x[1] - x[2], 2)))) AS step FROM pairs WHERE b IS NOT NULL)
SELECT episode, round(median(step), 6) AS median_step, round(max(step), 6) AS max_step, count(*) AS n FROM steps GROUP BY 1"""


def area_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose area is over 1.8 times, or under a 1.8th of, the one before."""
    rows = frames(spark, sf_dir).select("episode", "frame", F.floor("signal").alias("area"))
    return S.area_jumps(rows, EP, "frame", "area").filter("jump").select("episode", "frame", "area")


JUMPS_SQL = f"""WITH {FRAMES}, areas AS (SELECT episode, frame, CAST(floor(signal) AS BIGINT) AS area, lag(CAST(floor(signal) AS BIGINT)) OVER (PARTITION BY episode ORDER BY frame) AS was FROM frames)
SELECT episode, frame, area FROM areas WHERE was IS NOT NULL AND greatest(area, was) / CAST(greatest(least(area, was), 1) AS DOUBLE) > 1.8"""


def subframe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five times inside each frame's shutter (half a frame), and the signal there."""
    out = I.interpolate_at(frames(spark, sf_dir).select("episode", "frame", "signal"), EP, "frame", "signal")
    return out.select("episode", "frame", F.col("sample").cast("long").alias("sample"), F.round("sampled", 6).alias("value"))


SUBFRAME_SQL = f"""WITH {FRAMES}, lasts AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM frames),
due AS (SELECT episode, frame, last, k AS sample, least(CAST(last AS DOUBLE), greatest(0.0, frame + (k - 2) * 0.125)) AS at FROM lasts, (SELECT unnest(range(5)) AS k))
SELECT d.episode, d.frame, d.sample, round(a.signal + (b.signal - a.signal) * (d.at - floor(d.at)), 6) AS value FROM due d
    JOIN frames a ON a.episode = d.episode AND a.frame = CAST(floor(d.at) AS BIGINT) JOIN frames b ON b.episode = d.episode AND b.frame = least(d.last, CAST(floor(d.at) AS BIGINT) + 1)"""

ANCHORS = (0, 5, 9, 13, 17, 1)


def alignment_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a recording (the right one is the mirrored left) drawn to detections (events of the frame's number): offsets in pixels and the shift that both share, in metres."""
    from framewright.plans.visibility import CAMERA

    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), (640 + F.col("value")).alias("x"), (360 + F.col("value") / 2).alias("y"), (F.col("value") / 100).alias("confidence"))
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.lit(1.0).alias("sign")), F.struct(F.lit("right").alias("side"), F.lit(-1.0).alias("sign")))).alias("s")
    points = landmarks(spark, sf_dir).select("episode", "frame", sides, F.posexplode("points").alias("landmark", "p")).filter(F.col("landmark").isin(*ANCHORS))
    moved = points.select("episode", "frame", "s.side", F.array(F.col("s.sign") * F.col("p")[0], F.col("p")[1], F.col("p")[2]).alias("p")).withColumn("px", G.project(F.col("p"), CAMERA))
    per = moved.join(seen, "frame").groupBy("episode", "frame", "side", "confidence").agg(
        F.expr("percentile(x - px.u, 0.5)").alias("du"), F.expr("percentile(y - px.v, 0.5)").alias("dv"), F.expr("percentile(p[2], 0.5)").alias("depth")
    )
    out = S.align_to_detections(per, EP, "frame", ["du", "dv"], "depth", [CAMERA.fx, CAMERA.fy], 7, 2.0, "side", "confidence")
    return out.select("episode", "frame", "side", F.round("du", 4).alias("du"), F.round("dv", 4).alias("dv"), *[F.round(F.col("shift")[i], 5).alias(f"t{i}") for i in range(2)])


def held_sql(value: str, half: int, source: str, out: str, keys: str, made: str) -> str:
    """A table with `value` replaced by an expression over w, its window with held ends."""
    return f"""{out}_near AS (
    SELECT *, list({value}) OVER (PARTITION BY {keys} ORDER BY frame ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS near,
        least({half}, row_number() OVER (PARTITION BY {keys} ORDER BY frame) - 1) AS before, least({half}, count(*) OVER (PARTITION BY {keys}) - row_number() OVER (PARTITION BY {keys} ORDER BY frame)) AS after FROM {source}
), {out}_held AS (
    SELECT *, list_concat(list_transform(range({half} - before), lambda i: near[1]), near, list_transform(range({half} - after), lambda i: near[-1])) AS w FROM {out}_near
), {out} AS (SELECT * EXCLUDE (near, before, after, w) REPLACE ({made} AS {value}) FROM {out}_held)"""


_blur = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
BLUR = f"list_sum(list_transform(range(1, 18), lambda i: w[i] * {[x / sum(_blur) for x in _blur]!r}[i]))"


def _alignment_sql() -> str:
    from framewright.plans.visibility import CAMERA, POINTS

    steps, source = [], "per"
    for name in ("du", "dv"):
        for half, made, tag in ((3, "list_sort(w)[4]", "m"), (8, BLUR, "g")):
            steps.append(held_sql(name, half, source, f"{name}_{tag}", "episode, side", made))
            source = f"{name}_{tag}"
    shared = f"""weights AS (SELECT *, CASE WHEN max(CASE WHEN confidence >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY episode, frame) = 1 THEN CASE WHEN confidence >= 0.9 THEN 1.0 ELSE 0.0 END ELSE confidence END AS p FROM {source}),
shared AS (SELECT *, sum(du * depth / {CAMERA.fx} * p) OVER f / greatest(sum(p) OVER f, 1e-6) AS t0, sum(dv * depth / {CAMERA.fy} * p) OVER f / greatest(sum(p) OVER f, 1e-6) AS t1 FROM weights WINDOW f AS (PARTITION BY episode, frame))"""
    return f"""WITH {POINTS}, sided AS (SELECT CAST(episode AS BIGINT) AS episode, frame, side, CASE WHEN side = 'left' THEN x ELSE -x END AS x, y, z FROM points, (SELECT unnest(['left', 'right']) AS side) WHERE landmark IN {ANCHORS}),
placed AS (
    SELECT s.*, value / 100 AS confidence, 640 + value - CASE WHEN abs(z) > 1e-6 THEN {CAMERA.fx} * x / z + {CAMERA.cx} END AS gu, 360 + value / 2 - CASE WHEN abs(z) > 1e-6 THEN {CAMERA.fy} * y / z + {CAMERA.cy} END AS gv
    FROM sided s JOIN events ON event_id = frame
), per AS (SELECT episode, frame, side, confidence, median(gu) AS du, median(gv) AS dv, median(z) AS depth FROM placed GROUP BY 1, 2, 3, 4),
{", ".join(steps)}, {shared}, {held_sql("t0", 8, "shared", "s0", "episode, side", BLUR)}, {held_sql("t1", 8, "s0", "s1", "episode, side", BLUR)}
SELECT episode, frame, side, round(du, 4) AS du, round(dv, 4) AS dv, round(t0, 5) AS t0, round(t1, 5) AS t1 FROM s1"""


def smooth_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty numbers of each vector as a hand's joints: the first six are its root and stay."""
    values = F.posexplode(F.slice("embedding", 1, 30)).alias("joint", "q")
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode"), place.cast("long").alias("frame"), "embedding").select("episode", "frame", values)
    rows = rows.withColumn("q", F.col("q").cast("double")).withColumn("low", F.lit(-0.2)).withColumn("high", F.lit(0.2))
    out = S.smooth_joints(rows, ["episode", "joint"], "frame", "q", "low", "high", 30.0, fixed=F.col("joint") < 6)
    return out.select("episode", F.col("joint").cast("long").alias("joint"), "frame", F.round("smoothed", 6).alias("smoothed"))


def _joints_sql() -> str:
    near = "WINDOW w AS (PARTITION BY episode, joint ORDER BY frame)"
    return f"""WITH RECURSIVE joints AS (
    SELECT episode, frame, joint, q, least(0.2, greatest(-0.2, q)) AS c FROM (
        SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding[1:30], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), LATERAL (SELECT unnest(e) AS q, unnest(range(30)) AS joint)
), free AS (
    SELECT *, list(c) OVER (PARTITION BY episode, joint ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, median(c) OVER (PARTITION BY episode, joint ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m,
        count(*) OVER (PARTITION BY episode, joint) AS n FROM joints WHERE joint >= 6
), robust AS (SELECT episode, joint, frame, n, c, CASE WHEN n >= 3 AND abs(c - m) > greatest(0.08, 3.5 * 1.4826 * list_aggregate(list_transform(near, lambda x: abs(x - m)), 'median')) THEN m ELSE c END AS h FROM free),
smooth AS (SELECT episode, joint, frame, CASE WHEN n < 2 THEN c ELSE {weighted_sql("h", W7)} END AS g FROM robust {near}),
held AS (SELECT row(episode, joint) AS key, list(g ORDER BY frame) AS y FROM smooth GROUP BY episode, joint), {limits_sql("held", 8.0 / 30.0, 120.0 / 900.0, -0.2, 0.2)},
each AS (SELECT key[1] AS episode, key[2] AS joint, unnest(range(len(y))) AS frame, unnest(y) AS limited, len(y) AS n FROM limited)
SELECT j.episode, j.joint, j.frame, round(CASE WHEN j.joint < 6 OR n < 2 THEN q ELSE limited END, 6) AS smoothed FROM joints j LEFT JOIN each e ON e.episode = j.episode AND e.joint = j.joint AND e.frame = j.frame"""


def smooth_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers of each vector as a rotation, the next three as a place."""
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode"), place.cast("long").alias("frame"), F.slice(wide, 1, 4).alias("q"), F.slice(wide, 5, 3).alias("p"))
    out = S.smooth_poses(rows, EP, "frame", "p", "q", 30.0)
    return out.select("episode", "frame", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)], *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(4)])


def continuity_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5 frames of each episode, and which is the very last."""
    rows = S.trailing_rows(frames(spark, sf_dir), EP, "frame", 5)
    last = S.last_state(rows, EP, "frame", ["signal"]).withColumnRenamed("signal", "last_signal")
    return rows.select("episode", "frame", "signal").join(last, "episode")


TAIL_SQL = f"""WITH {FRAMES}, ends AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM frames)
SELECT e.episode, e.frame, e.signal, l.signal AS last_signal FROM ends e JOIN ends l ON l.episode = e.episode AND l.frame = e.last WHERE e.frame > e.last - 5"""


def _poses_sql() -> str:
    """The composed smoother: places axis by axis as joints are, turns through medoids, means and limits."""
    axis = "WINDOW w AS (PARTITION BY episode, axis ORDER BY frame)"
    angle = lambda a, b: ANGLE.format(a=a, b=b)
    at = lambda k: "q" if not k else f"{'lead' if k > 0 else 'lag'}(q, {abs(k)}) OVER w"
    part = lambda i: " + ".join(f"coalesce(CASE WHEN {DOT.format(a=f'n{j}', b='q')} < 0 THEN -1.0 ELSE 1.0 END * n{j}[{i}] * {W7[j]!r}, 0.0)" for j in range(7))
    return f"""WITH RECURSIVE {QUATS}, axes AS (
    SELECT episode, frame, axis, c FROM (SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding[5:7], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        LATERAL (SELECT unnest(e) AS c, unnest(range(3)) AS axis)
), near_axes AS (SELECT *, list(c) OVER v AS near, median(c) OVER v AS m, count(*) OVER (PARTITION BY episode, axis) AS n FROM axes WINDOW v AS (PARTITION BY episode, axis ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
robust AS (SELECT episode, axis, frame, CASE WHEN n >= 3 AND abs(c - m) > greatest(0.01, 3.5 * 1.4826 * list_aggregate(list_transform(near, lambda x: abs(x - m)), 'median')) THEN m ELSE c END AS h FROM near_axes),
smooth AS (SELECT episode, axis, frame, {weighted_sql("h", W7)} AS g FROM robust {axis}),
held AS (SELECT row(episode, axis) AS key, list(g ORDER BY frame) AS y FROM smooth GROUP BY episode, axis), {limits_sql("held", 1.5 / 30.0, 12.0 / 900.0, -1e300, 1e300)},
places AS (SELECT key[1] AS episode, key[2] AS axis, unnest(range(len(y))) AS frame, unnest(y) AS v FROM limited),
{continuous_sql("quats", "first_")},
near AS (SELECT a.episode, a.frame, a.q AS centre, b.frame AS i, b.q FROM first_ a JOIN first_ b ON a.episode = b.episode AND b.frame BETWEEN a.frame - 3 AND a.frame + 3),
costs AS (SELECT x.episode, x.frame, x.i, x.q, x.centre, sum({angle("x.q", "y.q")}) AS cost FROM near x JOIN near y ON x.episode = y.episode AND x.frame = y.frame GROUP BY ALL),
medoids AS (SELECT episode, frame, centre, arg_min(q, row(cost, i)) AS m FROM costs GROUP BY ALL),
angles AS (SELECT d.episode, d.frame, d.centre, d.m, list({angle("n.q", "d.m")}) AS a FROM medoids d JOIN near n ON d.episode = n.episode AND d.frame = n.frame GROUP BY ALL),
spread AS (SELECT *, list_aggregate(a, 'median') AS med FROM angles),
kept AS (SELECT episode, frame, CASE WHEN {angle("centre", "m")} > greatest({math.radians(20)!r}, med + 3.5 * 1.4826 * list_aggregate(list_transform(a, lambda x: abs(x - med)), 'median')) THEN m ELSE centre END AS q FROM spread),
{continuous_sql("kept", "second_")}, beside AS (SELECT episode, frame, q, {", ".join(f"{at(k)} AS n{k + 3}" for k in range(-3, 4))} FROM second_ WINDOW w AS (PARTITION BY episode ORDER BY frame)),
total AS (SELECT episode, frame, [{", ".join(part(i) for i in range(1, 5))}] AS t FROM beside), units AS (SELECT episode, frame, list_transform(t, lambda x: x / sqrt({DOT.format(a="t", b="t")})) AS q FROM total),
{continuous_sql("units", "third_")}, {_turns_sql("third_", 8.0 / 30.0)}, {continuous_sql("slow", "steady")}
SELECT s.episode, s.frame, {", ".join(f"round(max(v) FILTER (axis = {i}), 6) AS p{i}" for i in range(3))}, {", ".join(f"round(any_value(q)[{i + 1}], 6) AS q{i}" for i in range(4))}
FROM steady s JOIN places p ON p.episode = s.episode AND p.frame = s.frame GROUP BY 1, 2"""


QUERIES = {
    "hampel_filter": (hampel_filter, HAMPEL_SQL),
    "gaussian_smooth": (gaussian_smooth, GAUSSIAN_SQL),
    "gap_interpolate": (gap_interpolate, INTERPOLATE_SQL),
    "unwrap_angles": (unwrap_angles, UNWRAP_SQL),
    "boundary_smooth": (boundary_smooth, BOUNDARY_SQL),
    "quaternion_continuity": (quaternion_continuity, CONTINUITY_SQL),
    "quaternion_medoid": (quaternion_medoid, MEDOID_SQL),
    "quaternion_smooth": (quaternion_smooth, _mean_sql()),
    "slerp_midpoints": (slerp_midpoints, SLERP_SQL),
    "ema_tracker": (ema_tracker, EMA_SQL),
    "derivative_limits": (derivative_limits, DERIVATIVE_SQL),
    "angular_velocity_limits": (angular_velocity_limits, TURNS_SQL),
    "step_norms": (step_norms, STEP_SQL),
    "area_jumps": (area_jumps, JUMPS_SQL),
    "subframe_samples": (subframe_samples, SUBFRAME_SQL),
    "alignment_shift": (alignment_shift, _alignment_sql()),
    "smooth_joints": (smooth_joints, _joints_sql()),
    "smooth_poses": (smooth_poses, _poses_sql()),
    "continuity_tail": (continuity_tail, TAIL_SQL),
}
