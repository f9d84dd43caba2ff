"""Masks as cell sets: overlap, union, partition, blending, profiles and colours (shapes, cleaning and distances: scanlines). Null cells are no cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators.quantiles import quantiles
from framewright.sources.checkpoints import settled

#: The twenty bones of a hand of 21 landmarks, wrist first.
BONES = ((0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7), (7, 8), (0, 9), (9, 10), (10, 11), (11, 12), (0, 13), (13, 14), (14, 15), (15, 16), (0, 17), (17, 18), (18, 19), (19, 20))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two cell arrays; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sequence_metrics(df: DataFrame, keys: list[str], order: str, cells: str, other: str, area: float) -> DataFrame:
    """(keys, mean_iou, min_iou, mean_area, change): change is the mean share of cells that differ from the frame before."""
    w = W.partitionBy(*keys).orderBy(order)
    was = F.lag(cells).over(w)
    differ = (F.size(F.array_except(cells, was)) + F.size(F.array_except(was, F.col(cells)))) / area
    rows = df.withColumn("__fw_iou", overlap(F.col(cells), F.col(other))).withColumn("__fw_c", F.when(was.isNotNull(), differ))
    return rows.groupBy(*keys).agg(
        F.avg("__fw_iou").alias("mean_iou"), F.min("__fw_iou").alias("min_iou"), F.avg(F.size(cells)).alias("mean_area"), F.coalesce(F.avg("__fw_c"), F.lit(0.0)).alias("change")
    )


def union_cells(df: DataFrame, keys: list[str], cells: str) -> DataFrame:
    """(keys, cells): every cell of any row, each once; rows without cells give an empty set."""
    one = df.select(*keys, F.explode_outer(cells).alias("__fw_c"))
    return one.groupBy(*keys).agg(F.sort_array(F.collect_set("__fw_c")).alias(cells))


def partition_classes(coverage: DataFrame, cell: list[str], name: str, cover: str, order: str) -> DataFrame:
    """(cell, name): the class that covers a cell most, the first in order on ties; uncovered cells have none."""
    best = coverage.filter(F.col(cover) > 0).groupBy(*cell).agg(F.max(F.struct(F.col(cover), (-F.col(order)).alias("__fw_o"), F.col(name))).alias("__fw_b"))
    return best.select(*cell, F.col(f"__fw_b.{name}").alias(name))


def accumulate(samples: DataFrame, cell: list[str], colour: str, alpha: str) -> DataFrame:
    """(cell, premultiplied, alpha, straight): means over samples; the straight colour where alpha is over 1e-6."""
    held = samples.groupBy(*cell).agg(F.avg(F.col(colour) * F.col(alpha)).alias("premultiplied"), F.avg(alpha).alias("alpha"))
    return held.withColumn("straight", F.when(F.col("alpha") > 1e-6, F.col("premultiplied") / F.col("alpha")).otherwise(0.0))


def over(background: Column, premultiplied: Column, alpha: Column) -> Column:
    """Composite to 0..255, rounded half to even."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(premultiplied + background * (1.0 - alpha)))).cast("int")


def blended(source: Column, painted: Column, alpha: Column) -> Column:
    """Blend to 0..255, cut towards zero."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), source * (1.0 - alpha) + painted * alpha)).cast("int")


def crossfade(frame: Column, start: float, stop: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (frame - start) / (stop - start)))


def sleeve_profile(points: DataFrame, keys: list[str], along: str, across: str, bins: int = 12, margin: float = 12.0, least: int = 24, needed: int = 3) -> DataFrame:
    """(keys, bin, radius): widths of a mask along an axis (shares of it from 0 to 1, distances across).

    The 92nd percentile of a bin's distances where `least` points are, other bins between their neighbours (held at the ends);
    a margin, clipped to 28..88; then quarter, half and quarter with zeros beyond the ends, which take a quarter of their neighbour
    instead. A group with fewer than `needed` measured bins raises.
    """
    number = F.floor(F.col(along) * bins).cast("long")
    inside = points.filter((F.col(along) >= 0) & (F.col(along) < 1)).select(*keys, number.alias("bin"), across)
    held = settled(quantiles(inside, [*keys, "bin"], across, 0.92, out="r"))
    known = held.filter(F.col("n") >= least).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "r"))).alias("__fw_k"))
    known = held.select(*keys).distinct().join(known, keys, "left")
    ok = F.when(F.size("__fw_k") >= needed, F.col("__fw_k")).otherwise(F.raise_error(F.lit("too few bins to measure a width")).cast("array<struct<bin: bigint, r: double>>"))

    def at(i: Column) -> Column:
        before, after = F.filter("__fw_k", lambda x: x["bin"] <= i), F.filter("__fw_k", lambda x: x["bin"] >= i)
        a, b = F.when(F.size(before) > 0, F.element_at(before, -1)), F.when(F.size(after) > 0, after[0])
        share = (i - a["bin"]) / F.nullif(b["bin"] - a["bin"], F.lit(0).cast("long"))
        return F.coalesce(a["r"] + (b["r"] - a["r"]) * share, a["r"], b["r"])

    filled = known.withColumn("__fw_k", ok).withColumn("__fw_w", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda i: F.least(F.lit(88.0), F.greatest(F.lit(28.0), at(i) + margin))))
    beside = lambda i: F.coalesce(F.get("__fw_w", i.cast("int")), F.lit(0.0))
    smooth = filled.withColumn("__fw_s", F.transform("__fw_w", lambda x, i: 0.25 * beside(i - 1) + 0.5 * x + 0.25 * beside(i + 1)))
    s = F.col("__fw_s")
    ends = F.transform("__fw_s", lambda x, i: F.when(i == 0, 0.75 * x + 0.25 * s[1]).when(i == bins - 1, 0.75 * x + 0.25 * s[bins - 2]).otherwise(x))
    return smooth.select(*keys, F.posexplode(ends).alias("bin", "radius"))


def compact_reference(frames: DataFrame, keys: list[str], frame: str, margin: str, area: str, share: float = 0.85, low: float = 0.002, high: float = 0.2) -> DataFrame:
    """(keys, frame): the smallest mask among those with `share` of the best margin and a usable size, else the best margin; the first on ties."""
    rows = frames.withColumn("__fw_best", F.max(margin).over(W.partitionBy(*keys)))
    good = (F.col(margin) >= share * F.col("__fw_best")) & F.col(area).between(low, high)
    out = rows.groupBy(*keys).agg(F.min(F.when(good, F.struct(area, frame))).alias("a"), F.max(F.struct(margin, (-F.col(frame)).alias("f"))).alias("b"))
    return out.select(*keys, F.coalesce(F.col(f"a.{frame}"), -F.col("b.f")).alias(frame))


def colour_model(pixels: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """(keys, centre, scale): the median, and 1.4826 times the median deviation but `floor` at least."""
    middle = settled(quantiles(pixels, keys, value, 0.5, out="centre").drop("n"))
    apart = pixels.select(*keys, value).join(middle, keys).select(*keys, F.abs(F.col(value) - F.col("centre")).alias("__fw_d"))
    spread = quantiles(apart, keys, "__fw_d", 0.5, out="__fw_mad").drop("n")
    return middle.join(spread, keys).select(*keys, "centre", F.greatest(F.lit(float(floor)), 1.4826 * F.col("__fw_mad")).alias("scale"))


def point_coverage(points: DataFrame, runs: DataFrame, keys: list[str], frames: DataFrame) -> DataFrame:
    """(keys, share) of every frame: the share of its points (u, v; those outside the image left out before) that lie on its mask, rows (keys, y, a, b) of half-open runs; 0 without points.

    Points, runs and frames meet in one shuffle by frame, line by line: no pixel of a mask becomes a row, and nothing is joined, so nothing is broadcast.
    """
    row = lambda df, **given: df.select(*keys, *(given.get(c, F.lit(None)).cast("long").alias(f"__fw_{c}") for c in ("y", "x", "a", "b")), F.lit("own" in given).alias("__fw_own"))
    both = row(points, y=F.floor("v"), x=F.floor("u")).unionByName(row(runs, y=F.col("y"), a=F.col("a"), b=F.col("b"))).unionByName(row(frames, own=F.lit(True)))
    lines = both.repartition(*keys).groupBy(*keys, "__fw_y").agg(
        F.collect_list("__fw_x").alias("__fw_xs"), F.collect_list(F.when(F.col("__fw_a").isNotNull(), F.struct("__fw_a", "__fw_b"))).alias("__fw_runs"), F.max("__fw_own").alias("__fw_own")
    )
    hits = F.size(F.filter("__fw_xs", lambda x: F.exists("__fw_runs", lambda r: (r["__fw_a"] <= x) & (x < r["__fw_b"]))))
    per = lines.groupBy(*keys).agg(F.sum(hits).alias("__fw_hits"), F.sum(F.size("__fw_xs")).alias("__fw_n"), F.max("__fw_own").alias("__fw_own"))
    return per.filter("__fw_own").select(*keys, F.coalesce(F.col("__fw_hits") / F.nullif(F.col("__fw_n"), F.lit(0)), F.lit(0.0)).alias("share"))


def same_shapes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two mask tables (keys, w, h, cells) frame by frame; a missing frame or another shape raises."""
    from framewright.operators.geometry import aligned

    both = aligned(a.select(*keys, "w", "h", "cells"), b.select(*keys, F.col("w").alias("__fw_w"), F.col("h").alias("__fw_h"), F.col("cells").alias("other")), keys)
    ok = F.when((F.col("w") == F.col("__fw_w")) & (F.col("h") == F.col("__fw_h")), F.lit(True)).otherwise(F.raise_error(F.lit("masks differ in shape")).cast("boolean"))
    return both.withColumn("__fw_ok", ok).filter("__fw_ok").drop("__fw_w", "__fw_h", "__fw_ok")
