"""Whether hands and robots are seen: composed visibility, prompts and their validity, verdicts over recordings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import geometry as G
from framewright.operators import intervals as I
from framewright.operators import poses as P


def hand_visibility(
    df: DataFrame, keys: list[str], order: str, position: str, quaternion: str, landmarks: str | dict[str, str], camera: G.Camera, *,
    direct: str | dict[str, str] | None = None, least: int = 1, gap: int = 5, entry: int = 8, exit: int = 8, out: str = "visible",
) -> DataFrame:
    """(keys, order, out) of a pose table: landmarks turned into the camera's axes and projected, `least` of them in view with a
    margin of 20 pixels and further than 0.05; or detected directly; short gaps bridged, intervals padded. Whole recordings go in.

    Several hands (landmarks and direct by the name of their flag) are one chain: the turn is computed once, and one shuffle and
    three sorts (up, down, up) serve all flags.
    """
    if not 1 <= least <= 21:
        raise ValueError("from 1 to 21 landmarks")
    hands = landmarks if isinstance(landmarks, dict) else {out: landmarks}
    found = direct if isinstance(direct, dict) else {} if direct is None else {out: direct}

    def ok(p: Column) -> Column:
        z = F.greatest(p[2], F.lit(1e-6))
        pixel = F.struct((camera.fx * p[0] / z + camera.cx).alias("u"), (camera.fy * p[1] / z + camera.cy).alias("v"))
        return F.coalesce(p[2] > 0.05, F.lit(False)) & G.in_view(pixel, camera, 20.0)

    rows = df.withColumn("__fw_r", P.rotation(F.col(quaternion)))
    rows = rows.withColumns({f"__fw_p_{h}": P.camera_points(F.col(c), F.col(position), F.col("__fw_r")) for h, c in hands.items()})
    seen = {h: F.size(F.filter(f"__fw_p_{h}", ok)) >= least for h in hands}
    seen = {h: flag | F.coalesce(F.col(found[h]), F.lit(False)) if h in found else flag for h, flag in seen.items()}
    flagged = rows.select(*keys, order, *(flag.alias(h) for h, flag in seen.items()))
    names = list(hands)
    return I.pad_intervals(I.bridge_gaps(flagged, keys, order, names, gap), keys, order, names, entry, exit)


def direct_visibility(confidence: Column, least: float = 0.9) -> Column:
    """Seen by a genuine detection: interpolated points have less confidence; no detection is not seen."""
    return F.coalesce(confidence >= least, F.lit(False))


def visibility_for_side(poses: DataFrame, detections: DataFrame, keys: list[str], projected: str, confidence: str, out: str = "visible") -> DataFrame:
    """poses joined one to one with detections (a frame that one side lacks raises) and the fused visibility."""
    both = G.aligned(poses, detections, keys)
    return both.withColumn(out, G.fuse_visibility(F.col(projected), F.col(confidence)))


#: Landmarks that prompts prefer, and those of the other hand that serve as negatives.
PREFERRED = (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20)
NEGATIVES = (0, 2, 6, 10, 14, 18)


def prompt_cascade(
    df: DataFrame, points: str, camera: G.Camera, padding: float, confidence: str | None = None, other: str | None = None, other_confidence: str | None = None, trust: float = 0.3, out: str = "prompt"
) -> DataFrame:
    """df and struct(how, picked, positives, negatives, u0, v0, u1, v1): a prompt of the landmarks that can be trusted.

    First those in view with enough confidence, else (under four) those in view, else those up to 20 pixels outside, drawn to the
    border; null where none of these has four. Positives are the preferred landmarks among them, filled up to four; negatives are
    landmarks of the other hand further than 10 pixels from every positive; the box holds all valid ones and the padding.
    """
    flags = F.array_repeat(F.lit(True), 21) if confidence is None else F.transform(confidence, lambda c: F.coalesce(c >= trust, F.lit(False)))
    pixel = F.transform(points, lambda p, i: F.struct(i.alias("i"), (p[2] > 1e-4).alias("front"), F.col("__fw_trusted")[i].alias("trusted"), G.project(p, camera)["u"].alias("u"), G.project(p, camera)["v"].alias("v")))
    rows = df.withColumn("__fw_trusted", flags).withColumn("__fw_px", pixel)
    view = lambda p, margin: F.coalesce(p["front"], F.lit(False)) & G.in_view(p, camera, margin)
    inside = F.filter("__fw_px", lambda p: view(p, 0.0))
    rows = rows.withColumn("__fw_in", inside).withColumn("__fw_sure", F.filter("__fw_in", lambda p: p["trusted"]))
    near = F.transform(F.filter("__fw_px", lambda p: view(p, 20.0)), lambda p: F.struct(p["i"].alias("i"), p["front"].alias("front"), p["trusted"].alias("trusted"), _clip(p["u"], camera.width - 1).alias("u"), _clip(p["v"], camera.height - 1).alias("v")))
    rows = rows.withColumn("__fw_near", near).withColumn("__fw_nearsure", F.filter("__fw_near", lambda p: p["trusted"]))
    how = F.when(F.size("__fw_sure") >= 4, "trusted").when(F.size("__fw_in") >= 4, "seen").when(F.size("__fw_nearsure") >= 4, "near trusted").when(F.size("__fw_near") >= 4, "near")
    rows = rows.withColumn("__fw_how", how)
    rows = rows.withColumn("__fw_ok", F.when(F.col("__fw_how") == "trusted", F.col("__fw_sure")).when(F.col("__fw_how") == "seen", F.col("__fw_in")).when(F.col("__fw_how") == "near trusted", F.col("__fw_nearsure")).when(F.col("__fw_how") == "near", F.col("__fw_near")))
    best = F.filter("__fw_ok", lambda p: p["i"].isin(*PREFERRED))
    rows = rows.withColumn("__fw_best", best).withColumn("__fw_more", F.filter("__fw_ok", lambda p: ~p["i"].isin(*PREFERRED)))
    rows = rows.withColumn("__fw_picked", F.concat("__fw_best", F.slice("__fw_more", F.lit(1), F.greatest(F.lit(0), 4 - F.size("__fw_best")))))
    place = lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"))
    none = F.array().cast("array<struct<u: double, v: double>>")
    if other is None:
        rows = rows.withColumn("__fw_neg", none)
    else:
        of = F.array(*(F.struct(F.lit(i).alias("i"), (F.col(other)[i][2] > 1e-4).alias("front"), (F.lit(True) if other_confidence is None else F.coalesce(F.col(other_confidence)[i] >= trust, F.lit(False))).alias("trusted"), G.project(F.col(other)[i], camera)["u"].alias("u"), G.project(F.col(other)[i], camera)["v"].alias("v")) for i in NEGATIVES))
        rows = rows.withColumn("__fw_of", F.filter(of, lambda p: view(p, 0.0) & p["trusted"]))
        gap = lambda p, q: F.sqrt((p["u"] - q["u"]) * (p["u"] - q["u"]) + (p["v"] - q["v"]) * (p["v"] - q["v"]))
        rows = rows.withColumn("__fw_neg", F.transform(F.filter("__fw_of", lambda q: F.forall("__fw_picked", lambda p: gap(p, q) > 10.0)), place))
    low = lambda f: F.greatest(F.lit(0.0), F.array_min(F.transform("__fw_ok", lambda p: p[f])) - padding)
    high = lambda f, size: F.least(F.lit(size - 1), F.array_max(F.transform("__fw_ok", lambda p: p[f])) + padding)
    made = F.struct(
        F.col("__fw_how").alias("how"), F.transform("__fw_picked", lambda p: p["i"]).alias("picked"), F.transform("__fw_picked", place).alias("positives"), F.coalesce("__fw_neg", none).alias("negatives"),
        low("u").alias("u0"), low("v").alias("v0"), high("u", camera.width).alias("u1"), high("v", camera.height).alias("v1"),
    )
    return rows.withColumn(out, F.when(F.col("__fw_how").isNotNull(), made)).drop("__fw_trusted", "__fw_px", "__fw_in", "__fw_sure", "__fw_near", "__fw_nearsure", "__fw_how", "__fw_ok", "__fw_best", "__fw_more", "__fw_picked", "__fw_neg", "__fw_of")


def _clip(value: Column, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(0.0), value))


def spread_prompt(df: DataFrame, points: str, camera: G.Camera, padding: float, most: int, confidence: str | None = None, trust: float = 0.3, out: str = "prompt") -> DataFrame:
    """df and struct(picked, u0, v0, u1, v1): at most `most` landmarks at even places (rounded half to even) of those in view.

    Landmarks of too little confidence count only where none has enough; null without any landmark in view.
    """
    pixel = F.transform(points, lambda p, i: F.struct(i.alias("i"), (p[2] > 1e-4).alias("front"), G.project(p, camera)["u"].alias("u"), G.project(p, camera)["v"].alias("v")))
    rows = df.withColumn("__fw_in", F.filter(pixel, lambda p: F.coalesce(p["front"], F.lit(False)) & G.in_view(p, camera)))
    sure = F.col("__fw_in") if confidence is None else F.filter("__fw_in", lambda p: F.coalesce(F.col(confidence)[p["i"]] >= trust, F.lit(False)))
    rows = rows.withColumn("__fw_sure", sure).withColumn("__fw_ok", F.when(F.size("__fw_sure") > 0, F.col("__fw_sure")).otherwise(F.col("__fw_in")))
    n = F.size("__fw_ok")
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.col("__fw_ok")[F.rint(j * (n - 1) / max(1, most - 1)).cast("int")])
    rows = rows.withColumn("__fw_picked", F.when(n <= most, F.col("__fw_ok")).otherwise(even))
    low = lambda f: F.greatest(F.lit(0.0), F.array_min(F.transform("__fw_ok", lambda p: p[f])) - padding)
    high = lambda f, size: F.least(F.lit(size - 1), F.array_max(F.transform("__fw_ok", lambda p: p[f])) + padding)
    made = F.struct(F.transform("__fw_picked", lambda p: p["i"]).alias("picked"), low("u").alias("u0"), low("v").alias("v0"), high("u", camera.width).alias("u1"), high("v", camera.height).alias("v1"))
    return rows.withColumn(out, F.when(n > 0, made)).drop("__fw_in", "__fw_sure", "__fw_ok", "__fw_picked")


def robot_verdict(areas: DataFrame, keys: list[str], side: str, robot: str, arm: str, combined: str, need_arm: bool = True) -> DataFrame:
    """(keys, verdict) over frames of two sides: together 128 pixels once, each side 32 once, each arm 16 once; a side without frames fails."""
    best = lambda s, c: F.max(F.when(F.col(side) == s, F.col(c)))
    per = areas.groupBy(*keys).agg(F.max(combined).alias("all"), *(best(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in (robot, arm)))
    few = lambda c, n: F.coalesce(F.col(c) < n, F.lit(True))
    verdict = F.when(few("all", 128), "too small together")
    for s in ("left", "right"):
        verdict = verdict.when(few(f"{s}_{robot}", 32), f"{s} robot is never visible")
        if need_arm:
            verdict = verdict.when(few(f"{s}_{arm}", 16), f"{s} arm is never visible")
    return per.select(*keys, verdict.otherwise("ok").alias("verdict"))


def single_robot_verdict(areas: DataFrame, keys: list[str], robot: str, arm: str, need_robot: bool = True, need_arm: bool = True) -> DataFrame:
    """(keys, robot_frames, arm_frames, ok): frames with 64 pixels of robot and with 16 of its arm; one of each kind that is needed."""
    per = areas.groupBy(*keys).agg(F.count_if(F.col(robot) >= 64).alias("robot_frames"), F.count_if(F.col(arm) >= 16).alias("arm_frames"))
    ok = (F.lit(not need_robot) | (F.col("robot_frames") > 0)) & (F.lit(not need_arm) | (F.col("arm_frames") > 0))
    return per.withColumn("ok", ok)


def frame_gate(df: DataFrame, keys: list[str], human: str, pixels: str, least: int) -> DataFrame:
    """df and `permitted` (a human is seen and the robot has `least` pixels) and, over the sides of a frame (keys), `inpainted` (any human is seen)."""
    robot = F.coalesce(F.col(pixels) >= least, F.lit(False))
    seen = F.coalesce(F.col(human), F.lit(False))
    return df.withColumn("permitted", seen & robot).withColumn("inpainted", F.max(seen).over(W.partitionBy(*keys)))


def valid_runs(df: DataFrame, keys: list[str], order: str, valid: str, out: str = "run") -> DataFrame:
    """df and the number of the run of valid frames that each belongs to (null outside): a partition key for work inside intervals."""
    w = W.partitionBy(*keys).orderBy(order)
    begins = F.col(valid) & ~F.coalesce(F.lag(valid).over(w), F.lit(False))
    return df.withColumn("__fw_b", begins.cast("int")).withColumn(out, F.when(F.col(valid), F.sum("__fw_b").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("__fw_b")


def palm_markers(points: Column, distances: tuple[float, ...] = (30.0, 80.0, 140.0)) -> Column:
    """array<struct<u, v>>: points behind the wrist, away from the mean of those knuckles that have a place, at fixed distances in pixels; the length is floored at 1e-4."""
    knuckles = lambda f: [points[i][f] for i in (5, 9, 13, 17)]
    known = lambda f: sum((x.isNotNull().cast("int") for x in knuckles(f)), F.lit(0))
    mean = lambda f: sum((F.coalesce(x, F.lit(0.0)) for x in knuckles(f)), F.lit(0.0)) / F.nullif(known(f), F.lit(0))
    du, dv = points[0]["u"] - mean("u"), points[0]["v"] - mean("v")
    n = F.greatest(F.sqrt(du * du + dv * dv), F.lit(1e-4))
    return F.array(*(F.struct((points[0]["u"] + d * du / n).alias("u"), (points[0]["v"] + d * dv / n).alias("v")) for d in distances))


def best_per_side(detections: DataFrame, keys: list[str], side: str, score: str, index: str) -> DataFrame:
    """One detection of each frame and side, of the mirrored view's swapped sides: the best score, the first on ties."""
    swapped = F.when(F.col(side) == "left", "right").when(F.col(side) == "right", "left").otherwise(F.col(side))
    place = F.row_number().over(W.partitionBy(*keys, side).orderBy(F.desc(score), index))
    return detections.withColumn(side, swapped).withColumn("__fw_place", place).filter("__fw_place = 1").drop("__fw_place")


def detected_landmarks(detections: DataFrame, frames: DataFrame, keys: list[str], order: str, side: str, score: str, index: str, points: str, sides: tuple[str, ...] = ("left", "right"), missing: bool = False) -> DataFrame:
    """(keys, side, order, points, confidence, markers) of every frame and side, from a mirrored detector's finds (keys, order, side, score, index, points array<struct<u, v>>).

    Sides are swapped, the best find of a frame and side is taken, frames without one are filled along straight lines (held at the ends, confidence 0.55),
    and markers of the arm are laid behind the palm. A side that was never found raises, or, with `missing`, has points at 0 with confidence 0.
    Finds of frames that are not listed, and of other sides, do not count.
    """
    best = best_per_side(detections, [*keys, order], side, score, index).select(*keys, order, side, F.col(points).alias("__fw_p"))
    rows = frames.select(*keys, order).distinct().withColumn(side, F.explode(F.array(*map(F.lit, sides)))).join(best, [*keys, order, side], "left")
    up = W.partitionBy(*keys, side).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys, side).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    find = F.when(F.col("__fw_p").isNotNull(), F.struct(F.col(order).alias("at"), F.col("__fw_p").alias("p")))
    rows = rows.withColumn("__fw_b", F.last(find, True).over(up)).withColumn("__fw_a", F.last(find, True).over(down))
    share = F.coalesce((F.col(order) - F.col("__fw_b.at")) / F.nullif(F.col("__fw_a.at") - F.col("__fw_b.at"), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("__fw_share", share)
    line = F.zip_with("__fw_b.p", "__fw_a.p", lambda b, a: F.struct((b["u"] + (a["u"] - b["u"]) * F.col("__fw_share")).alias("u"), (b["v"] + (a["v"] - b["v"]) * F.col("__fw_share")).alias("v")))
    kind = "array<struct<u: double, v: double>>"
    nothing = F.array_repeat(F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("v")), 21) if missing else F.raise_error(F.concat(F.lit("never found: "), F.col(side))).cast(kind)
    filled = F.coalesce(F.col("__fw_p").cast(kind), line.cast(kind), F.col("__fw_b.p").cast(kind), F.col("__fw_a.p").cast(kind), nothing)
    sure = F.when(F.col("__fw_p").isNotNull(), 1.0).when(F.col("__fw_b").isNull() & F.col("__fw_a").isNull(), 0.0).otherwise(0.55)
    out = rows.withColumn("__fw_f", filled).select(*keys, side, order, F.col("__fw_f").alias(points), sure.alias("confidence"))
    return out.withColumn("markers", palm_markers(F.col(points)))


ROOT = ("x", "y", "z", "roll", "pitch", "yaw")


def actuated(names: Column, root: tuple[str, ...] = ROOT, expected: int | None = None) -> Column:
    """Places (from 0) of the joints that are not the root's; raises for repeated names, missing root joints, or another number than expected."""
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<int>")
    found = F.filter(F.transform(names, lambda x, i: F.when(~x.isin(*root), i)), lambda i: i.isNotNull())
    out = F.when(F.size(F.array_distinct(names)) < F.size(names), fail("repeated joint names"))
    out = out.when(F.size(F.array_except(F.array(*map(F.lit, root)), names)) > 0, fail("root joints are missing"))
    if expected is not None:
        out = out.when(F.size(found) != expected, fail(f"not {expected} actuated joints"))
    return out.otherwise(found)


def side_name(text: Column) -> Column:
    """left or right, in lower case; raises for anything else."""
    name = F.lower(F.trim(text))
    return F.when(name.isin("left", "right"), name).otherwise(F.raise_error(F.concat(F.lit("no such side: "), F.coalesce(text, F.lit("null")))))


def hidden_links(names: Column, allowed: tuple[str, ...]) -> Column:
    """The names sorted, each once; raises if one may not be hidden."""
    extra = F.array_except(names, F.array(*map(F.lit, allowed)))
    return F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unsupported links: "), F.array_join(F.array_sort(extra), ", "))).cast("array<string>")).otherwise(F.array_sort(F.array_distinct(names)))


def out_of_memory(message: Column) -> Column:
    text = F.lower(message)
    return text.contains("cuda") & text.contains("out of memory")


def is_file(size: Column, expected: Column, content: Column, sha256: Column) -> Column:
    """Whether a file is the expected one: the size decides first, the hash only where it agrees."""
    return F.when(F.coalesce(size != expected, F.lit(True)), F.lit(False)).otherwise(F.sha2(content, 256) == F.lower(sha256))


def scalar_first(q: Column) -> Column:
    """x, y, z, w as w, x, y, z."""
    return F.array(q[3], q[0], q[1], q[2])


def unit_scale(value: Column, largest: float) -> Column:
    """Stored numbers as 0..1; the scale is stated, not guessed from the data."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value.cast("double") / largest))


def base_trajectory(frames: DataFrame, base: DataFrame, keys: list[str], order: str) -> DataFrame:
    """frames with the pose of the base: one pose of a recording for all its frames, or one for each frame (a missing one raises)."""
    if order in base.columns:
        return G.aligned(frames, base, [*keys, order])
    joined = frames.join(base.withColumn("__fw_base", F.lit(True)), keys, "left")
    whole = F.when(F.col("__fw_base"), F.lit(True)).otherwise(F.raise_error(F.lit("a recording has no base pose")).cast("boolean"))
    return joined.withColumn("__fw_base", whole).filter("__fw_base").drop("__fw_base")


def pixel_poses(points: Column) -> Column:
    """Pixel points as poses without a turn, at depth 0."""
    one = F.array(*(F.lit(float(i == j)) for i in range(3) for j in range(3)))
    return F.transform(points, lambda p: P.pose(one, F.array(p["u"], p["v"], F.lit(0.0))))


def hand_sequence(joints: DataFrame, cameras: DataFrame, keys: list[str], order: str, marker: str, pose: str, camera: str) -> DataFrame:
    """joints (one row for each marker: hand landmarks or arm markers) and their place in the camera's axes; values that are not finite raise."""
    both = joints.join(cameras, [*keys, order], "left")
    point = P.composed(P.inverse(F.col(camera)), F.col(pose))["t"]
    ok = F.forall(point, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    checked = F.when(F.coalesce(ok, F.lit(False)), point).otherwise(F.raise_error(F.lit("a pose is missing or not finite")).cast("array<double>"))
    return both.select(*keys, order, marker, checked.alias("point"))
