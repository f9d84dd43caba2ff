"""Masks as scan lines: shapes, morphology, parts, distances, warps and blurs as plans over rows.

A mask is a table (keys, y, runs): one row for each line of its image, `runs` being
the half-open intervals [a, b) of its pixels, sorted, neither touching nor
overlapping. All lines of a frame are there, empty ones too, so a step meets whole
frames: rows are dealt and sorted by frame, and small NumPy kernels work on many
frames at once. Keys are what names a frame; they may be null and
then name one frame. Rows of a line that repeat are united by `lines_of`.

A frame's data are bounded by its image, so nothing here meets a group of unbounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import kernels as K
from framewright.operators.masks import BONES
from framewright.sources.checkpoints import settled  # noqa: F401

RUNS = "array<struct<a: int, b: int>>"
#: Shares of the smaller side of the image, and bounds in pixels.
HAND, WIDE_HAND, CORRIDOR, PALM, CORRIDOR_BOUNDS, SCALE_BOUNDS = 0.026, 0.04, 0.13, 0.55, (58.0, 92.0), (0.78, 1.28)


def none() -> Column:
    return F.array().cast(RUNS)


def run(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def merged(runs: Column) -> Column:
    """The union of any runs, sorted."""
    last = lambda held: F.element_at(held, -1)

    def add(held: Column, r: Column) -> Column:
        longer = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(run(last(held)["a"], F.greatest(last(held)["b"], r["b"]))))
        return F.when(F.size(held) == 0, F.array(r)).when(r["a"] <= last(held)["b"], longer).otherwise(F.concat(held, F.array(r)))

    return F.aggregate(F.array_sort(F.filter(runs, lambda r: r["a"] < r["b"])), none(), add)


def pixels(runs: Column) -> Column:
    """How many pixels runs have."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])


def column_sum(runs: Column) -> Column:
    """The sum of the pixels' columns."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + ((r["b"] - r["a"]) * (r["a"] + r["b"] - 1) / 2).cast("long"))


def gaps(runs: Column, width: int) -> Column:
    """The runs between sorted ones."""
    ends = F.concat(F.transform(runs, lambda r: r["a"]), F.array(F.lit(width)))
    between = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["b"])), ends, run)
    return F.filter(between, lambda r: r["a"] < r["b"])


def lines_of(rows: DataFrame, keys: list[str], frames: DataFrame, height: int) -> DataFrame:
    """All lines of the frames (keys), from rows (keys, y, a, b) in any order; rows beyond the image or of other frames make no line."""
    blank = frames.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.lit(None).cast("struct<a: int, b: int>").alias("run"))
    return _gathered(rows.filter(F.col("y").between(0, height - 1)).select(*keys, F.col("y").cast("int").alias("y"), run(F.col("a"), F.col("b")).alias("run")), blank, keys)


def _gathered(found: DataFrame, blank: DataFrame, keys: list[str]) -> DataFrame:
    # a number of its own: lines are few bytes and much work, and partitions made by bytes would be too few
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = found.withColumn("__fw_own", F.lit(False)).unionByName(blank.withColumn("__fw_own", F.lit(True))).repartition(parts, *keys)
    held = both.groupBy(*keys, "y").agg(F.collect_list("run").alias("runs"), F.max("__fw_own").alias("__fw_own"))
    return held.filter("__fw_own").select(*keys, "y", merged(F.col("runs")).alias("runs"))


# --- morphology


def ellipse(size: int) -> dict[int, int]:
    """Half-widths by line of an elliptic window of odd size."""
    r = size // 2
    return {dy: round(r * math.sqrt(max(0, r * r - dy * dy) / (r * r))) if r else 0 for dy in range(-r, r + 1)}


def diamond(radius: int) -> dict[int, int]:
    """Half-widths by line of all steps of at most `radius` by city-block distance."""
    return {dy: radius - abs(dy) for dy in range(-radius, radius + 1)}


def grown(lines: DataFrame, keys: list[str], window: dict[int, int], width: int, out: str = "runs", source: str = "runs") -> DataFrame:
    """Dilated by a window that is symmetric above and below."""
    kernel = lambda table, line: {out: run_lists(spread(drawn(table.column(source), width), line, window))}
    return by_frames(lines, keys, kernel, {out: RUNS})


def eroded(lines: DataFrame, keys: list[str], window: dict[int, int], width: int) -> DataFrame:
    """What is left where the window fits; outside the image nothing is missing."""
    kernel = lambda table, line: {"runs": run_lists(~spread(~drawn(table.column("runs"), width), line, window))}
    return by_frames(lines, keys, kernel, {"runs": RUNS})


def closed_opened(lines: DataFrame, keys: list[str], width: int, close: int = 5, open_: int = 3) -> DataFrame:
    """Closed by one ellipse, then opened by another."""
    kernel = lambda table, line: {"runs": run_lists(tidied(drawn(table.column("runs"), width), line, close, open_))}
    return by_frames(lines, keys, kernel, {"runs": RUNS})


def _cut(runs: Column, by: Column) -> Column:
    """What two arrays of runs share."""
    shared = lambda r: F.transform(by, lambda g: run(F.greatest(r["a"], g["a"]), F.least(r["b"], g["b"])))
    return F.filter(F.flatten(F.transform(runs, shared)), lambda r: r["a"] < r["b"])


def _weighted(runs: Column, alpha: float) -> Column:
    return F.transform(runs, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), F.lit(alpha).alias("alpha")))


def feathered(lines: DataFrame, keys: list[str], width: int, grow: int = 10, feather: int = 4) -> DataFrame:
    """(keys, y, alpha array<struct<a, b, alpha>>): 1 on the mask grown by city-block distance, then `feather` rings down to 0, as disjoint runs."""
    names = [f"__fw_r{k}" for k in range(feather + 1)]

    def kernel(table: pa.Table, line: np.ndarray) -> dict[str, pa.Array]:
        on = drawn(table.column("runs"), width)
        return {name: run_lists(spread(on, line, diamond(grow + k))) for k, name in enumerate(names)}

    held = by_frames(lines, keys, kernel, dict.fromkeys(names, RUNS))
    rings = []
    for k in range(feather + 1):
        ring = _cut(F.col(f"__fw_r{k}"), gaps(F.col(f"__fw_r{k - 1}") if k else none(), width))
        rings.append(_weighted(ring, 1.0 - k / (feather + 1)))
    return held.select(*keys, "y", F.flatten(F.array(*rings)).alias("alpha"))


# --- shapes


def capsule_rows(shapes: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, y, a, b) of shapes (keys, au, av, bu, bv, radius): the pixels within radius of each segment (of a point, where both ends agree).

    Runs of neighbouring rows of one frame are united, so that few rows leave a task; the rest is left to `lines_of`.
    """
    rows = shapes.select(*keys, *(F.col(x).cast("double").alias(x) for x in ("au", "av", "bu", "bv", "radius")))
    schema = T.StructType([*rows.select(*keys).schema.fields, *(T.StructField(x, T.IntegerType()) for x in ("y", "a", "b"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = K.group_starts(batch, len(keys))
            shape, y, a, b = capsules(*(c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :]), width, height)
            line = (np.searchsorted(starts, shape, "right") - 1) * height + y
            order = np.argsort(line * (width + 1) + a, kind="stable")
            first, last = (line * (width + 1) + a)[order], np.maximum.accumulate((line * (width + 1) + b)[order])
            new = np.flatnonzero(np.append(True, first[1:] > last[:-1])[: len(first)])  # ends never reach the next line
            line, a, b = line[order][new], a[order][new], last[np.append(new[1:], len(last))[: len(new)] - 1] % (width + 1)
            own = batch.take(pa.array(starts[line // height]))
            yield pa.RecordBatch.from_arrays([*own.columns[: len(keys)], *(pa.array(x.astype(np.int32)) for x in (line % height, a, b))], schema.names)

    return rows.mapInArrow(run, schema)


def capsules(au: np.ndarray, av: np.ndarray, bu: np.ndarray, bv: np.ndarray, radius: np.ndarray, width: int, height: int) -> tuple[np.ndarray, ...]:
    """(shape, y, a, b): the runs of each capsule on the image.

    A capsule is convex, so a line holds one interval: the hull of what its two discs and the band between them leave of the line. Pixels at
    its ends are then tested one by one, so rounding decides nothing.
    """
    with np.errstate(all="ignore"):
        low, high = np.fmax(0.0, np.ceil(np.fmin(av, bv) - radius)), np.fmin(height - 1.0, np.floor(np.fmax(av, bv) + radius))
        n = np.where(low <= high, high - low + 1, 0).astype(np.int64)
        shape = np.repeat(np.arange(len(n)), n)
        y = low[shape] + (np.arange(len(shape)) - np.repeat(np.cumsum(n) - n, n))
        au, av, bu, bv, radius = (x[shape] for x in (au, av, bu, bv, radius))
        du, dv = bu - au, bv - av
        square, s = du * du + dv * dv, (y - av) * dv
        half = lambda v: np.where(np.abs(y - v) <= radius, np.sqrt(radius * radius - (y - v) * (y - v)), np.nan)
        reach = radius * np.sqrt(square) / np.abs(dv)  # of the band, across the segment
        middle = au + (y - av) * du / dv
        foot, head = au - s / du, au + (square - s) / du  # beside the two ends
        along = np.where((s >= 0) & (s <= square), 0.0, np.nan)
        left = np.where(du != 0, np.maximum(middle - reach, np.minimum(foot, head)), middle - reach + along)
        right = np.where(du != 0, np.minimum(middle + reach, np.maximum(foot, head)), middle + reach + along)
        band = np.where((dv != 0) & (left <= right), 0.0, np.nan)
        lo = np.fmin(np.fmin(au - half(av), bu - half(bv)), left + band)
        hi = np.fmax(np.fmax(au + half(av), bu + half(bv)), right + band)

        def inside(x: np.ndarray) -> np.ndarray:
            t = np.where(square > 0, np.minimum(1.0, np.maximum(0.0, ((x - au) * du + (y - av) * dv) / square)), 0.0)
            return (x - au - t * du) ** 2 + (y - av - t * dv) ** 2 <= radius * radius

        def tested(x: np.ndarray, step: int) -> np.ndarray:
            return np.where(inside(x - step), x - step, np.where(inside(x), x, np.where(inside(x + step), x + step, np.nan)))

        a, b = np.maximum(0.0, tested(np.ceil(lo), 1)), np.minimum(width, tested(np.floor(hi), -1) + 1)
    own = a < b
    return shape[own], *(x[own].astype(np.int64) for x in (y, a, b))


def bone_shapes(df: DataFrame, keys: list[str], u: str, v: str, ok: Column, radius: Column | float, rounded: bool = True) -> DataFrame:
    """The bones between points that are ok, and those points, as shapes; points are rounded to pixels, or taken as they are."""
    pairs = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in [*BONES, *((i, i) for i in range(21))]))
    held = df.withColumn("__fw_ok", ok).select(*keys, u, v, "__fw_ok", F.lit(radius).cast("double").alias("radius") if not isinstance(radius, Column) else radius.cast("double").alias("radius"), F.explode(pairs).alias("p"))
    at = lambda a, i: F.rint(F.get(a, F.col(f"p.{i}"))) if rounded else F.get(a, F.col(f"p.{i}"))
    shown = held.filter(F.get("__fw_ok", F.col("p.i")) & F.get("__fw_ok", F.col("p.j")))
    return shown.select(*keys, at(u, "i").alias("au"), at(v, "i").alias("av"), at(u, "j").alias("bu"), at(v, "j").alias("bv"), "radius")


def hand_shapes(df: DataFrame, keys: list[str], u: str, v: str, z: str, width: int, height: int, confidence: Column | None = None, radius: float | None = None, trust: float = 0.3) -> DataFrame:
    """Shapes near the bones of projected hands (arrays u, v, z of 21 landmarks); landmarks of little confidence count only if fewer than four have enough."""
    shown = F.transform(F.arrays_zip(u, v, z), lambda p: F.coalesce((p[z] > 1e-4) & (p[u] >= 0) & (p[u] < width) & (p[v] >= 0) & (p[v] < height) & ~F.isnan(p[u]) & ~F.isnan(p[v]), F.lit(False)))
    held = df.withColumn("__fw_shown", shown)
    ok = F.col("__fw_shown")
    if confidence is not None:
        held = held.withColumn("__fw_sure", F.zip_with("__fw_shown", confidence, lambda s, k: s & F.coalesce(k >= trust, F.lit(False))))
        ok = F.when(F.size(F.filter("__fw_sure", lambda x: x)) >= 4, F.col("__fw_sure")).otherwise(F.col("__fw_shown"))
    return bone_shapes(held, keys, u, v, ok, max(4, round(min(width, height) * HAND)) if radius is None else radius)


def wide_radius(width: int, height: int) -> int:
    return max(8, round(min(width, height) * WIDE_HAND))


def corridor_radius(u: str, v: str, width: int, height: int) -> Column:
    """As wide as the diagonal of the landmarks on the image suggests, within bounds."""
    seen = F.filter(F.arrays_zip(u, v), lambda p: F.coalesce((p[u] >= 0) & (p[u] <= width - 1) & (p[v] >= 0) & (p[v] <= height - 1), F.lit(False)))
    side = lambda x: F.array_max(F.transform(seen, lambda p: p[x])) - F.array_min(F.transform(seen, lambda p: p[x]))
    palm = F.when(F.size(seen) >= 2, F.sqrt(side(u) * side(u) + side(v) * side(v))).otherwise(0.0)
    wide = F.greatest(F.lit(min(width, height) * CORRIDOR), palm * PALM)
    return F.rint(F.least(F.lit(CORRIDOR_BOUNDS[1]), F.greatest(F.lit(CORRIDOR_BOUNDS[0]), wide)))


def anchored(df: DataFrame, axis: str) -> DataFrame:
    """The rows whose axis struct<base, end> has an end.

    The axis passes a generator first, so that the filter stays above its steps instead of being written out below them.
    """
    held = df.withColumn("__fw_a", F.explode_outer(F.array(axis))).withColumn(axis, F.col("__fw_a")).drop("__fw_a")
    return held.filter(F.col(f"{axis}.end.u").isNotNull())


def corridor_shapes(df: DataFrame, keys: list[str], axis: str, radius: Column | float) -> DataFrame:
    """A capsule along each axis struct<base, end>; frames without one have none."""
    wide = radius if isinstance(radius, Column) else F.lit(float(radius))
    return anchored(df, axis).select(
        *keys, F.rint(f"{axis}.base.u").alias("au"), F.rint(f"{axis}.base.v").alias("av"), F.rint(f"{axis}.end.u").alias("bu"), F.rint(f"{axis}.end.v").alias("bv"), wide.cast("double").alias("radius")
    )


def sleeve_shapes(df: DataFrame, keys: list[str], axis: str, radii: str, scale: Column) -> DataFrame:
    """Four discs for each bin of a width profile (array of radii) along each axis; scale (the hand's size against that of the reference) counts within bounds."""
    k = F.least(F.lit(SCALE_BOUNDS[1]), F.greatest(F.lit(SCALE_BOUNDS[0]), scale))
    bins = F.size(radii)
    held = anchored(df, axis).select(*keys, axis, radii, k.alias("k"), F.explode(F.sequence(F.lit(0), 4 * bins - 1)).alias("i"))
    share = F.col("i") / (4 * bins - 1)
    held = held.withColumn("share", share).withColumn("spot", F.col("share") * (bins - 1)).withColumn("low", F.floor("spot").cast("int"))
    a, b = F.get(radii, F.col("low")), F.get(radii, F.least(F.col("low") + 1, bins - 1))
    radius = F.greatest(F.lit(1.0), F.rint((a + (b - a) * (F.col("spot") - F.col("low"))) * F.col("k")))
    at = lambda x: F.rint(F.col(f"{axis}.base.{x}") + F.col("share") * (F.col(f"{axis}.end.{x}") - F.col(f"{axis}.base.{x}")))
    return held.select(*keys, at("u").alias("au"), at("v").alias("av"), at("u").alias("bu"), at("v").alias("bv"), radius.alias("radius"))


# --- parts


def part_roots(row: np.ndarray, a: np.ndarray, b: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The first run of each run's 8-connected part; runs are sorted by row and column, line is each row's place in its frame."""
    below = np.append(line[1:] == line[:-1] + 1, False)  # the next row is of the same frame
    m = int(b.max(initial=0)) + 2
    low, high = np.searchsorted(row * m + b, (row + 1) * m + a, "left"), np.searchsorted(row * m + a, (row + 1) * m + b, "right")
    n = np.where(below[row], high - low, 0)
    u = np.repeat(np.arange(len(row)), n)
    v = np.arange(len(u)) + np.repeat(low - (np.cumsum(n) - n), n)
    root = np.arange(len(row))
    while (root[u] != root[v]).any():
        p, q = root[u], root[v]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return root


def parts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, a, b, part): the runs of each 8-connected part; part is its first run's number, by line and column."""

    def kernel(table: pa.Table, line: np.ndarray) -> dict[str, pa.Array]:
        row, a, b = flat_runs(table.column("runs"))
        number = table.column("y").to_numpy().astype(np.int64)[row] * (1 << 24) + a
        return {"__fw_parts": listed(row, len(line), pa.array(number[part_roots(row, a, b, line)]))}

    rows = by_frames(lines, keys, kernel, {"__fw_parts": "array<bigint>"})
    each = F.zip_with("runs", "__fw_parts", lambda r, p: F.struct(r["a"].alias("a"), r["b"].alias("b"), p.alias("part")))
    return rows.select(*keys, "y", F.inline(each))


def _wanted(width: int, height: int, seeds: Column | None, edge: int, near: int) -> Column:
    """Where a line's runs make their part a wanted one."""
    strips = F.array(run(F.when(F.col("y") >= height - edge, 0).otherwise(max(0, width - edge)), F.lit(width)))
    if seeds is None:
        return strips
    spot = lambda x, size: F.least(F.lit(size - 1.0), F.greatest(F.lit(0.0), F.rint(x)))
    close = F.filter(seeds, lambda s: ~F.isnan(s["u"]) & ~F.isnan(s["v"]) & (F.abs(F.col("y") - spot(s["v"], height)) <= near))
    return F.concat(strips, F.transform(close, lambda s: run(spot(s["u"], width) - near, spot(s["u"], width) + near + 1)))


def _kept(on: np.ndarray, line: np.ndarray, wanted: np.ndarray, least: int) -> pa.ListArray:
    """The runs of the parts of at least `least` pixels that have a wanted one."""
    runs = run_lists(on)
    row, a, b = flat_runs(runs)
    root = part_roots(row, a, b, line)
    seen = np.pad(np.cumsum(wanted, 1), ((0, 0), (1, 0)))
    met = np.bincount(root, seen[row, b] > seen[row, a], len(row)) > 0
    own = (met & (np.bincount(root, b - a, len(row)) >= least))[root]
    return listed(row[own], len(line), runs.flatten().filter(pa.array(own)))


def keep_parts(lines: DataFrame, keys: list[str], width: int, height: int, least: int, seeds: Column | None = None, edge: int = 3, near: int = 5) -> DataFrame:
    """Parts of at least `least` pixels that touch the bottom or right strip of the image, or the window around a seed (a literal array<struct<u, v>>), which is drawn into the image."""
    kernel = lambda table, line: {"runs": _kept(drawn(table.column("runs"), width), line, drawn(table.column("__fw_wanted"), width), least)}
    return by_frames(lines.withColumn("__fw_wanted", _wanted(width, height, seeds, edge, near)), keys, kernel, {"runs": RUNS}).drop("__fw_wanted")


def cleaned(lines: DataFrame, keys: list[str], width: int, height: int, seeds: Column | None = None, least: int = 128) -> DataFrame:
    """Masks without streaks and stray parts: closed_opened and keep_parts in one pass."""
    kernel = lambda table, line: {"runs": _kept(tidied(drawn(table.column("runs"), width), line), line, drawn(table.column("__fw_wanted"), width), least)}
    return by_frames(lines.withColumn("__fw_wanted", _wanted(width, height, seeds, 3, 5)), keys, kernel, {"runs": RUNS}).drop("__fw_wanted")


# --- kernels over whole frames

#: Lines whose arrays a task holds at once.
LINES = 1 << 12


def by_frames(lines: DataFrame, keys: list[str], kernel: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray | pa.Array]], out: Mapping[str, str]) -> DataFrame:
    """lines and the columns `out` (name, type) that a NumPy kernel makes of whole frames: a table sorted by keys and line, and each row's place in its frame, to lists or matrices (row, column).

    The places are a window's, so rows are dealt and sorted as any window's are. What a kernel has made is dealt again for the next one: steps that follow each other belong in one kernel.
    """
    rows = lines.withColumn("__fw_line", F.row_number().over(W.partitionBy(*keys).orderBy("y")) - 1)
    rows = rows.select(*keys, *(c for c in rows.columns if c not in keys))
    made = [T.StructField(c, T._parse_datatype_string(kind)) for c, kind in out.items()]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in out), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, len(keys), LINES):
            found = kernel(table, table.column("__fw_line").to_numpy())
            table = table.drop_columns([c for c in out if c in table.column_names])
            for name in out:
                made = found[name]
                if isinstance(made, np.ndarray):
                    made = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.reshape(-1)))
                table = table.append_column(name, made)
            yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema).select(*(c for c in lines.columns), *(c for c in out if c not in lines.columns))


def listed(row: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values of sorted rows as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)), values)


def flat_runs(runs: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b) of the runs of lines."""
    lists = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
    n = np.asarray(lists.value_lengths().fill_null(0))
    a, b = (lists.flatten().field(x).to_numpy().astype(np.int64) for x in ("a", "b"))
    return np.repeat(np.arange(len(n)), n), a, b


def drawn(runs: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Runs of lines as a matrix of booleans."""
    row, a, b = flat_runs(runs)
    edges = lambda x: np.bincount(row * (width + 1) + np.clip(x, 0, width), minlength=len(runs) * (width + 1))
    return np.cumsum((edges(a) - edges(b)).reshape(len(runs), width + 1)[:, :width], 1) > 0


def run_lists(on: np.ndarray) -> pa.ListArray:
    """A matrix of booleans as runs of lines."""
    edge = np.diff(on.astype(np.int8), axis=1, prepend=0, append=0)
    (row, a), b = np.nonzero(edge > 0), np.nonzero(edge < 0)[1]
    return listed(row, len(on), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a, b)], ["a", "b"]))


def spread(on: np.ndarray, line: np.ndarray, window: dict[int, int]) -> np.ndarray:
    """Dilated inside each frame by a window that is symmetric above and below."""
    wide, out = [on], np.zeros_like(on)
    for w in range(1, max(window.values()) + 1):
        near = wide[-1].copy()
        near[:, w:] |= on[:, :-w]
        near[:, :-w] |= on[:, w:]
        wide.append(near)
    for dy, w in window.items():
        k = abs(dy)
        if k == 0:
            out |= wide[w]
        elif k < len(on):
            same = (line[k:] == line[:-k] + k)[:, None]  # both lines are of one frame
            if dy > 0:
                out[k:] |= wide[w][:-k] & same
            else:
                out[:-k] |= wide[w][k:] & same
    return out


def tidied(on: np.ndarray, line: np.ndarray, close: int = 5, open_: int = 3) -> np.ndarray:
    """Closed by one ellipse, then opened by another."""
    closed = ~spread(~spread(on, line, ellipse(close)), line, ellipse(close))
    return spread(~spread(~closed, line, ellipse(open_)), line, ellipse(open_))


# --- distances


def flags(runs: Column, width: int) -> Column:
    """A line as 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.exists(runs, lambda r: (r["a"] <= x) & (x < r["b"])).cast("int"))


def runs_of(on: Column, width: int) -> Column:
    """The runs where an array of conditions holds."""
    places = lambda at, other: F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.get(on, x) & ~F.coalesce(F.get(on, x + other), F.lit(False)))
    return F.zip_with(places(on, -1), places(on, 1), lambda a, b: run(a, b + 1))


def field(on: np.ndarray, line: np.ndarray, clip: float) -> np.ndarray:
    """Clipped Euclidean distances to the border, as `distances` has them.

    Separable and exact: first along columns, by the nearest of `clip` lines above and below, then the lower envelope of the squares along the line.
    """
    reach, width = math.ceil(clip), on.shape[1]
    to = {}
    for kind in (True, False):
        near = np.where(on == kind, 0, reach + 1)
        for k in range(1, min(reach, len(on) - 1) + 1):
            same = line[k:] == line[:-k] + k  # both lines are of one frame
            for mine, other in ((near[k:], on[:-k]), (near[:-k], on[k:])):
                np.minimum(mine, k, out=mine, where=(other == kind) & same[:, None])
        squares = near * near
        best = squares.copy()
        for d in range(1, min(reach, width - 1) + 1):
            np.minimum(best[:, d:], squares[:, :-d] + d * d, out=best[:, d:])
            np.minimum(best[:, :-d], squares[:, d:] + d * d, out=best[:, :-d])
        to[kind] = np.minimum(float(clip), np.sqrt(best))
    return np.where(on, to[False], -to[True])


def distances(lines: DataFrame, keys: list[str], width: int, clip: float, out: str = "distance") -> DataFrame:
    """lines with an array of clipped Euclidean distances to the border: positive inside, negative outside, constant where there is none."""
    kernel = lambda table, line: {out: field(drawn(table.column("runs"), width), line, clip)}
    return by_frames(lines, keys, kernel, {out: "array<double>"})


def stabilised(
    lines: DataFrame, keys: list[str], frame: str, width: int, clip: float = 12.0, side: float = 0.35, low: float = 0.65, high: float = 1.35, before: DataFrame | None = None, after: DataFrame | None = None
) -> DataFrame:
    """Each run of usable masks (with pixels inside and outside) of a recording (keys) made steady; other frames come out empty, a run of one frame stays.

    A mask's signed distance is averaged with those of its neighbours in frame order, closed and opened; the mask stays where its area would change too
    much. before and after are the neighbours as lines (keys, frame, y, runs) brought to this frame's place, where motion is known. Further columns of lines stay.

    The neighbours travel as runs; their distances are made where they are used.
    """
    own, across = [*keys, frame], W.partitionBy(*keys, "y").orderBy(frame)
    held, sides = lines, []
    for name, step, moved in (("__fw_p", F.lag, before), ("__fw_n", F.lead, after)):
        held = held.withColumn(name, step("runs").over(across))
        sides.append((name, name if moved is None else f"{name}m"))
    for (_, name), moved in zip(sides, (before, after), strict=True):
        if moved is not None:
            held = held.join(moved.select(*own, "y", F.col("runs").alias(name)), [*own, "y"], "left")

    def kernel(table: pa.Table, line: np.ndarray) -> dict[str, pa.Array]:
        mask = lambda name: drawn(table.column(name), width)
        of = np.cumsum(line == 0) - 1
        area = lambda on: np.bincount(of, on.sum(1))[of]
        usable = lambda n: (n > 0) & (n < np.bincount(of)[of] * width)
        on = mask("runs")
        mean, one, was = field(on, line, clip), np.ones(len(on), bool), area(on)
        for own_, there in sides:
            had = usable(area(mask(own_))) & table.column(there).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            mean += np.where(had[:, None], side * field(mask(there), line, clip), 0.0)
            one &= ~had
        new = tidied(mean > 0, line)
        ratio = area(new) / np.maximum(was, 1)
        stays = one | (ratio < low) | (ratio > high)
        return {"runs": run_lists(np.where(stays[:, None], on, new) & usable(was)[:, None])}

    return by_frames(held, own, kernel, {"runs": RUNS}).select(*lines.columns)


# --- moving and mixing


def warped(cells: DataFrame, keys: list[str], motion: DataFrame, width: int, height: int) -> DataFrame:
    """(keys, x, y) of cells read at each pixel's place plus its motion (x, y, dx, dy and those of the keys that it depends on), at the nearest pixel."""
    by = [k for k in keys if k in motion.columns]
    from_ = motion.select(*by, F.col("x").alias("__fw_x"), F.col("y").alias("__fw_y"), F.rint(F.col("x") + F.col("dx")).cast("long").alias("x"), F.rint(F.col("y") + F.col("dy")).cast("long").alias("y"))
    from_ = from_.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    source = cells.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    return source.join(from_, [*by, "x", "y"]).select(*keys, F.col("__fw_x").alias("x"), F.col("__fw_y").alias("y"))


def resized(rows: DataFrame, keys: list[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Runs (keys, y, a, b) of an image of `size` (width, height) as those of an image of size `to`, each pixel from the nearest source: the last one not beyond it."""
    (w, h), (w2, h2) = size, to
    first = lambda x, n, m: F.floor((x * m + (n - 1)) / n).cast("int")  # noqa: E731 - the first pixel whose source is x or later
    low, high = first(F.col("y"), h, h2), first(F.col("y") + 1, h, h2) - 1
    held = rows.withColumn("__fw_y", F.when(low <= high, F.sequence(low, high)))
    return held.select(*keys, F.explode("__fw_y").alias("y"), first(F.col("a"), w, w2).alias("a"), first(F.col("b"), w, w2).alias("b")).filter("a < b")


def blur(columns: list[str], sigma: float, width: int, height: int) -> Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]]:
    """The kernel of `blurred`."""
    half = (round(sigma * 8 + 1) | 1) // 2
    if half >= min(width, height):
        raise ValueError("the image is smaller than the kernel")
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    taps = [t / sum(taps) for t in taps]

    def kernel(table: pa.Table, line: np.ndarray) -> dict[str, np.ndarray]:
        at = np.arange(len(line))
        first = at - line
        if len(line) % height or (line != at % height).any():
            raise ValueError("a frame lacks lines")
        fold = lambda x, n: (n - 1) - np.abs((n - 1) - np.abs(x))
        blurs = {}
        for c in columns:
            x = table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            padded = np.pad(x, ((0, 0), (half, half)), mode="reflect")
            x = sum(t * padded[:, k : k + width] for k, t in enumerate(taps))
            blurs[c] = sum(t * x[first + fold(line + k - half, height)] for k, t in enumerate(taps))
        return blurs

    return kernel


def blurred(lines: DataFrame, keys: list[str], columns: list[str], sigma: float, width: int, height: int) -> DataFrame:
    """Arrays of a line's values under a Gaussian of round(8 sigma + 1) | 1 taps, along the line and across lines; borders are mirrored."""
    return by_frames(lines, keys, blur(columns, sigma, width, height), dict.fromkeys(columns, "array<double>"))


def soft_matte(lines: DataFrame, keys: list[str], colours: list[str], alpha: str, sigma: float, width: int, height: int) -> DataFrame:
    """Premultiplied colours and alpha (arrays of a line) blurred and kept in 0..1; no colour exceeds its alpha."""
    if sigma <= 0:
        unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
        held = lines.withColumn(alpha, F.transform(alpha, unit))
        return held.withColumns({c: F.zip_with(c, alpha, lambda x, a: F.least(unit(x), a)) for c in colours})
    soft = blur([*colours, alpha], sigma, width, height)

    def kernel(table: pa.Table, line: np.ndarray) -> dict[str, np.ndarray]:
        made = {c: np.clip(x, 0.0, 1.0) for c, x in soft(table, line).items()}
        return {c: np.minimum(x, made[alpha]) for c, x in made.items()}

    return by_frames(lines, keys, kernel, dict.fromkeys([*colours, alpha], "array<double>"))
