"""Rigid poses as (r array<double>[9] by rows, t array<double>[3]), change of axes, and prompts along an arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.geometry import Camera, project, ray_to_border, unit


def rotation(q: Column) -> Column:
    """The rotation matrix of a quaternion x, y, z, w of any length over 1e-12."""
    u = unit(q)
    x, y, z, w = u[0], u[1], u[2], u[3]
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def times(r: Column, v: Column) -> Column:
    """r v."""
    return F.array(*(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3)))


def transposed(r: Column) -> Column:
    return F.array(*(r[3 * j + i] for i in range(3) for j in range(3)))


def product(a: Column, b: Column) -> Column:
    return F.array(*(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)))


def pose(r: Column, t: Column) -> Column:
    return F.struct(r.alias("r"), t.alias("t"))


def inverse(p: Column) -> Column:
    """The inverse of a rigid pose: its rotation transposed, no matrix solve."""
    back = transposed(p["r"])
    return pose(back, F.transform(times(back, p["t"]), lambda x: -x))


def composed(a: Column, b: Column) -> Column:
    """First b, then a."""
    return pose(product(a["r"], b["r"]), F.zip_with(times(a["r"], b["t"]), a["t"], lambda x, y: x + y))


def flipped(r: Column, signs: tuple[int, int, int]) -> Column:
    """diag(signs) r diag(signs)."""
    return F.array(*(r[3 * i + j] * float(signs[i] * signs[j]) for i in range(3) for j in range(3)))


def camera_points(points: Column, position: Column, r: Column) -> Column:
    """World points in the camera's axes with y down: (point - position) times the camera's rotation, y negated."""

    def one(p: Column) -> Column:
        d = F.zip_with(p, position, lambda a, b: a - b)
        moved = times(transposed(r), d)
        return F.array(moved[0], -moved[1], moved[2])

    return F.transform(points, one)


def checked_rotation(r: Column, slack: float = 1e-3) -> Column:
    """A rotation matrix; one that is not orthonormal within the slack, or mirrors, raises. Null stays null."""
    gram = F.array(*(r[3 * i] * r[3 * j] + r[3 * i + 1] * r[3 * j + 1] + r[3 * i + 2] * r[3 * j + 2] for i in range(3) for j in range(3)))
    off = F.array_max(F.transform(gram, lambda x, i: F.abs(x - F.when(i % 4 == 0, 1.0).otherwise(0.0))))
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    fine = (F.size(r) == 9) & ~F.isnan(off) & (off <= slack) & (det > 0)
    return F.when(r.isNull(), r).when(fine, r).otherwise(F.raise_error(F.lit("not a rotation: rows must be orthonormal, without a mirror")).cast("array<double>"))


def quaternion_of(r: Column) -> Column:
    """The unit quaternion x, y, z, w of a rotation matrix, w not negative: by the largest of the four, so nothing small is divided by. Pass a column: it is used many times."""
    m = lambda i, j: r[3 * i + j]
    squares = F.array(1 + m(0, 0) - m(1, 1) - m(2, 2), 1 - m(0, 0) + m(1, 1) - m(2, 2), 1 - m(0, 0) - m(1, 1) + m(2, 2), 1 + m(0, 0) + m(1, 1) + m(2, 2))
    rows = (
        F.array(squares[0], m(0, 1) + m(1, 0), m(0, 2) + m(2, 0), m(2, 1) - m(1, 2)), F.array(m(0, 1) + m(1, 0), squares[1], m(1, 2) + m(2, 1), m(0, 2) - m(2, 0)),
        F.array(m(0, 2) + m(2, 0), m(1, 2) + m(2, 1), squares[2], m(1, 0) - m(0, 1)), F.array(m(2, 1) - m(1, 2), m(0, 2) - m(2, 0), m(1, 0) - m(0, 1), squares[3]),
    )
    top = F.array_position(squares, F.array_max(squares))
    q = unit(F.when(top == 1, rows[0]).when(top == 2, rows[1]).when(top == 3, rows[2]).otherwise(rows[3]))
    return F.transform(q, lambda x: F.when(q[3] < 0, -x).otherwise(x))


def nearest_rotation(m: Column, steps: int = 24) -> Column:
    """The rotation nearest to a matrix of positive determinant: Newton's steps of the polar decomposition, each the mean of a matrix and its inverse transposed.

    A singular matrix (rotations half a turn apart, mixed in equal shares) has none: null.
    """

    def step(x: Column, _: Column) -> Column:
        minor = lambda i, j: x[3 * ((i + 1) % 3) + (j + 1) % 3] * x[3 * ((i + 2) % 3) + (j + 2) % 3] - x[3 * ((i + 1) % 3) + (j + 2) % 3] * x[3 * ((i + 2) % 3) + (j + 1) % 3]
        det = x[0] * minor(0, 0) + x[1] * minor(0, 1) + x[2] * minor(0, 2)
        whole = F.when(det > 1e-12, det)
        return F.array(*(0.5 * (x[3 * i + j] + minor(i, j) / whole) for i in range(3) for j in range(3)))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), m, step)
    return F.when(F.forall(found, lambda v: v.isNotNull()), found)


def blend_poses(df: DataFrame, first: str, second: str, share: str, out: str = "blended") -> DataFrame:
    """Straight between two poses, with the rotation drawn back onto proper rotations; at a share of 0 or 1 exactly the one or the other. Null poses or shares blend to null."""
    w = F.col(share)
    mix = lambda f: F.zip_with(f"{first}.{f}", f"{second}.{f}", lambda a, b: (1 - w) * a + w * b)
    held = df.withColumn("__fw_m", mix("r")).withColumn("__fw_t", mix("t"))
    r = F.when(w == 0, F.col(f"{first}.r")).when(w == 1, F.col(f"{second}.r")).otherwise(nearest_rotation(F.col("__fw_m")))
    return held.withColumn("__fw_r", r).withColumn(out, F.when(F.col("__fw_r").isNotNull(), pose(F.col("__fw_r"), F.col("__fw_t")))).drop("__fw_m", "__fw_t", "__fw_r")


def rebased(r: Column, left: tuple[int, int, int], right: tuple[int, int, int]) -> Column:
    """diag(left) r diag(right): other axes on either side of a rotation."""
    return F.array(*(r[3 * i + j] * float(left[i] * right[j]) for i in range(3) for j in range(3)))


#: Steps from the wrist to the three markers of a sleeve, in the camera's axes; the first one's sign is the side's.
SLEEVE_STEP, SLEEVE_MARKERS = (0.14, 0.09, 0.05), 3
WORLD_SIGNS, CAMERA_SIGNS = (1, 1, -1), (1, -1, 1)


def converted_hands(df: DataFrame, keys: list[str], order: str, position: str, quaternion: str, hands: dict[str, tuple[str, str]], active: tuple[str, ...]) -> DataFrame:
    """(keys, order, side, marker, point, turn, confidence) of a pose table whose world and camera axes are left-handed: 21 landmarks and three markers of
    the sleeve for each hand, as places in a right-handed world, with the wrist's rotation there.

    hands: side -> (landmarks, wrist quaternion). Sleeves are not observed: their markers run from the wrist towards the lower border of
    the side, in the camera's axes. Sides that are not active have confidence 0 and their markers on the wrist. Null landmarks give null points.
    """
    if extra := set(active) - set(hands):
        raise ValueError(f"no such sides: {sorted(extra)}")
    held = df.withColumn("__fw_r", rotation(F.col(quaternion))).withColumn("__fw_c", rebased(F.col("__fw_r"), WORLD_SIGNS, CAMERA_SIGNS))
    held = held.withColumn("__fw_t", F.array(*(F.col(position)[i] * float(WORLD_SIGNS[i]) for i in range(3))))
    held = held.withColumns({f"__fw_p_{side}": camera_points(F.col(points), F.col(position), F.col("__fw_r")) for side, (points, _) in hands.items()})
    structs = []
    for side, (_, wrist) in hands.items():
        sign, seen = (-1.0 if side == "left" else 1.0), F.col(f"__fw_p_{side}")
        step = [SLEEVE_STEP[0] * sign, *SLEEVE_STEP[1:]] if side in active else [0.0] * 3
        sleeve = F.array(*(F.array(*(seen[0][i] + k * step[i] for i in range(3))) for k in range(1, SLEEVE_MARKERS + 1)))
        turn = flipped(rotation(F.col(wrist)), WORLD_SIGNS)
        structs.append(F.struct(F.lit(side).alias("side"), F.concat(seen, sleeve).alias("points"), turn.alias("turn"), F.lit(1.0 if side in active else 0.0).alias("confidence")))
    each = held.select(*keys, order, "__fw_c", "__fw_t", F.explode(F.array(*structs)).alias("__fw_h"))
    each = each.select(*keys, order, "__fw_c", "__fw_t", "__fw_h.side", "__fw_h.turn", "__fw_h.confidence", F.posexplode("__fw_h.points").alias("marker", "__fw_p"))
    world = F.zip_with(times(F.col("__fw_c"), F.col("__fw_p")), "__fw_t", lambda a, b: a + b)
    return each.select(*keys, order, "side", "marker", world.alias("point"), "turn", "confidence")


def on_image(pixel: Column, camera: Camera) -> Column:
    """Closed: pixel centres from 0 to width - 1 and height - 1."""
    return F.coalesce((pixel["u"] >= 0) & (pixel["u"] <= camera.width - 1) & (pixel["v"] >= 0) & (pixel["v"] <= camera.height - 1), F.lit(False))


KNUCKLES = (5, 9, 13, 17)
ALONG = (0.04, 0.26, 0.50, 0.74, 0.94)
BESIDE = (0.28, 0.58, 0.86)


def arm_axis(df: DataFrame, points: str, wrist: Column, elbow: Column, camera: Camera, out: str = "axis") -> DataFrame:
    """df and struct(base, end): from the wrist, or else the visible knuckles' or hand's mean, along wrist to elbow up to the border; null without an anchor.

    Each step is a column of its own: the next ones use it several times, and Spark keeps such columns apart instead of writing them out each time.
    """
    total = lambda a, f: F.aggregate(F.transform(a, lambda p: p[f]), F.lit(0.0), lambda s, x: s + x)
    mean = lambda a: F.when(F.size(a) > 0, F.struct(*((total(a, f) / F.size(a)).alias(f) for f in ("u", "v"))))
    seen = lambda a: F.filter(a, lambda p: on_image(p, camera))
    px = F.col("__fw_px")
    held = df.withColumn("__fw_px", F.transform(points, lambda p: project(p, camera))).withColumn("__fw_w", project(wrist, camera)).withColumn("__fw_e", project(elbow, camera))
    held = held.withColumn("__fw_hand", seen(px)).withColumn("__fw_knuckles", seen(F.array(*(px[i] for i in KNUCKLES))))
    held = held.withColumn("__fw_base", F.coalesce(F.when(on_image(F.col("__fw_w"), camera), F.col("__fw_w")), mean(F.col("__fw_knuckles")), mean(F.col("__fw_hand"))))
    held = held.withColumn("__fw_du", F.col("__fw_e.u") - F.col("__fw_w.u")).withColumn("__fw_dv", F.col("__fw_e.v") - F.col("__fw_w.v"))
    held = held.withColumn("__fw_end", ray_to_border(F.col("__fw_base.u"), F.col("__fw_base.v"), F.col("__fw_du"), F.col("__fw_dv"), camera.width, camera.height))
    axis = F.when(F.col("__fw_base").isNotNull() & F.col("__fw_end").isNotNull(), F.struct(F.col("__fw_base").alias("base"), F.col("__fw_end").alias("end")))
    return held.withColumn(out, axis).drop("__fw_px", "__fw_w", "__fw_e", "__fw_hand", "__fw_knuckles", "__fw_base", "__fw_du", "__fw_dv", "__fw_end")


def arm_prompt(df: DataFrame, axis: str, camera: Camera, padding: float = 82.0, others: Column | None = None, out: str = "prompt") -> DataFrame:
    """df and struct(positives, negatives, u0, v0, u1, v1) of an axis: points along it, points that are not on it, and a padded box.

    Negatives are the other hand's points (array<struct<u, v>>), if any are given, and points beside the axis that are on the image.
    """
    b = F.col(f"{axis}.base")
    held = df.withColumn("__fw_du", F.col(f"{axis}.end.u") - b["u"]).withColumn("__fw_dv", F.col(f"{axis}.end.v") - b["v"])
    held = held.withColumn("__fw_n", F.sqrt(F.col("__fw_du") * F.col("__fw_du") + F.col("__fw_dv") * F.col("__fw_dv")))
    du, dv, n = F.col("__fw_du"), F.col("__fw_dv"), F.col("__fw_n")
    at = lambda k: F.struct((b["u"] + k * du).alias("u"), (b["v"] + k * dv).alias("v"))
    side = lambda k, s: F.struct((b["u"] + k * du - s * (78.0 + 38.0 * k) * dv / n).alias("u"), (b["v"] + k * dv + s * (78.0 + 38.0 * k) * du / n).alias("v"))
    beside = F.filter(F.array(*(side(k, s) for k in BESIDE for s in (-1.0, 1.0))), lambda p: on_image(p, camera))
    held = held.withColumn("__fw_beside", F.when(n > 1e-5, beside).otherwise(F.array().cast("array<struct<u: double, v: double>>")))
    if others is not None:
        held = held.withColumn("__fw_beside", F.concat(others, "__fw_beside"))
    last = {"u": b["u"] + ALONG[-1] * du, "v": b["v"] + ALONG[-1] * dv}
    low = lambda f: F.greatest(F.lit(0.0), F.least(b[f], last[f]) - padding)
    high = lambda f, size: F.least(F.lit(size - 1), F.greatest(b[f], last[f]) + padding)
    prompt = F.struct(
        F.array(*(at(k) for k in ALONG)).alias("positives"), F.col("__fw_beside").alias("negatives"),
        low("u").alias("u0"), low("v").alias("v0"), high("u", camera.width).alias("u1"), high("v", camera.height).alias("v1"),
    )
    return held.withColumn(out, prompt).drop("__fw_du", "__fw_dv", "__fw_n", "__fw_beside")


def unit_box(x: Column, size: float) -> Column:
    """A coordinate as a share of the size, clipped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / size))
