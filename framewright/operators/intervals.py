"""Interval operators over frames: gaps, padding, runs, chunks and their joins.

All windows of one chain share a partitioning and an order, so Spark shuffles
and sorts an episode once (a second sort, no shuffle, serves look-ahead).
Intervals are half-open. A null flag counts as false, a null state is a state of its own; rows
with a null key are a recording, a null frame comes first. Column names that begin with `__fw_` are the engine's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import kernels as K


def bridge_gaps(df: DataFrame, keys: list[str], order: str, flag: str | list[str], gap: int, out: str | None = None) -> DataFrame:
    """Fill false runs of at most `gap` rows that have true rows on both sides; frames are consecutive, null counts as false.

    Several flags share one sort upward and one downward.
    """
    flags = [flag] if isinstance(flag, str) else flag
    names = {f: (out or f) if isinstance(flag, str) else f for f in flags}
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    seen = lambda f: F.when(F.col(f), F.col(order))
    rows = df.withColumns({f"__fw_before_{f}": F.last(seen(f), True).over(before) for f in flags})
    rows = rows.withColumns({f"__fw_after_{f}": F.last(seen(f), True).over(after) for f in flags})
    filled = {names[f]: F.coalesce(F.col(f), F.lit(False)) | F.coalesce(F.col(f"__fw_after_{f}") - F.col(f"__fw_before_{f}") - 1 <= gap, F.lit(False)) for f in flags}
    return rows.withColumns(filled).drop(*(f"__fw_{side}_{f}" for side in ("before", "after") for f in flags))


def pad_intervals(df: DataFrame, keys: list[str], order: str, flag: str | list[str], entry: int, exit: int, out: str | None = None) -> DataFrame:
    """Begin true runs `entry` rows earlier and end them `exit` rows later; several flags share one sort."""
    if entry < 0 or exit < 0:
        raise ValueError("padding must not be negative")
    near = W.partitionBy(*keys).orderBy(order).rowsBetween(-exit, entry)
    flags = [flag] if isinstance(flag, str) else flag
    return df.withColumns({((out or f) if isinstance(flag, str) else f): F.max(f).over(near) for f in flags})


def runs(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """(keys, state, start, stop): maximal runs of equal state."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    numbered = df.withColumn("__fw_new", first).withColumn("__fw_run", F.sum("__fw_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__fw_run").agg(F.first(state).alias(state), F.min(order).alias("start"), (F.max(order) + 1).alias("stop")).drop("__fw_run")


def balanced_chunks(df: DataFrame, shortest: int, longest: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """Cut [start, stop) into as few parts as `longest` allows, of lengths that differ by one at most; shorter intervals vanish.

    A part below `shortest` raises: the limits cannot both hold.
    """
    if shortest > longest:
        raise ValueError("shortest is over longest")
    n = F.col(stop) - F.col(start)
    parts = F.ceil(n / longest).cast("long")
    cut = df.filter(n >= shortest).withColumn("__fw_parts", parts)
    base = F.expr(f"({stop} - {start}) div __fw_parts")
    rest = F.expr(f"({stop} - {start}) % __fw_parts")
    checked = F.when(base < shortest, F.raise_error(F.lit("a part would be too short")).cast("long")).otherwise(base)
    each = cut.withColumn("__fw_base", checked).withColumn("__fw_rest", rest).withColumn("__fw_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__fw_parts") - 1)))
    begin = F.col(start) + F.col("__fw_i") * F.col("__fw_base") + F.least("__fw_i", "__fw_rest")
    end = begin + F.col("__fw_base") + (F.col("__fw_i") < F.col("__fw_rest")).cast("long")
    return each.withColumn("__fw_begin", begin).withColumn("__fw_end", end).withColumn(start, F.col("__fw_begin")).withColumn(stop, F.col("__fw_end")).drop("__fw_parts", "__fw_base", "__fw_rest", "__fw_i", "__fw_begin", "__fw_end")


def two_sided_state(left: Column, right: Column) -> Column:
    """0 none, 1 left, 2 right, 3 both."""
    return left.cast("int") + 2 * right.cast("int")


MODES = {1: "left", 2: "right", 3: "both"}


def adaptive_chunks(
    df: DataFrame, keys: list[str], order: str, left: str, right: str, *, gap: int = 5, entry: int = 8, exit: int = 8, shortest: int = 6, longest: int = 240, first: int = 0, last: int | None = None
) -> DataFrame:
    """(keys, mode, start, stop): visibility of both sides bridged and padded over the whole recording, then cropped, cut into runs and balanced."""
    sides = [left, right]
    both = pad_intervals(bridge_gaps(df, keys, order, sides, gap), keys, order, sides, entry, exit)
    state = both.select(*keys, order, two_sided_state(F.col(left), F.col(right)).alias("state"))
    inside = state.filter(F.col(order) >= first) if last is None else state.filter((F.col(order) >= first) & (F.col(order) < last))
    found = runs(inside, keys, order, "state").filter("state <> 0")
    mode = F.element_at(F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair]), F.col("state"))
    return balanced_chunks(found, shortest, longest).select(*keys, mode.alias("mode"), "start", "stop")


def frames_to_chunks(frames: DataFrame, chunks: DataFrame, keys: list[str], order: str, chunk: str) -> DataFrame:
    """frames and the chunk (and place in it) that covers each; the later chunk wins, uncovered frames stay.

    Chunks are bounded, so they are unrolled to frames and joined by equality.
    """
    unrolled = chunks.select(*keys, chunk, "start", F.explode(F.sequence("start", F.col("stop") - 1)).alias(order))
    latest = unrolled.groupBy(*keys, order).agg(F.max(F.struct(chunk, "start")).alias("__fw_c"))
    joined = frames.join(latest, [*keys, order], "left")
    return joined.withColumn(chunk, F.col(f"__fw_c.{chunk}")).withColumn("local", F.col(order) - F.col("__fw_c.start")).drop("__fw_c")


def frames_in_intervals(frames: DataFrame, chunks: DataFrame, keys: list[str], order: str, chunk: str, width: int = 4096) -> DataFrame:
    """frames_to_chunks for intervals of any length, whatever their overlaps: one shuffle by keys, in which both sides meet, and no row for a piece of an interval.

    width, once that of bins, decides nothing any more.
    """
    return _covered(frames, chunks, keys, order, [chunk])


def labelled_frames(frames: DataFrame, chunks: DataFrame, keys: list[str], order: str, chunk: str, label: str, uncovered: str, width: int = 4096) -> DataFrame:
    """frames with the chunk that covers each, its label, and `uncovered` as the label of frames that none covers."""
    known = _covered(frames, chunks, keys, order, [chunk, label])
    known = known.withColumn(label, F.when(F.col(chunk).isNull(), F.lit(uncovered)).otherwise(F.col(label)))
    return known.select(*keys, chunk, *(c for c in known.columns if c not in (*keys, chunk, label)), label)


def _covered(frames: DataFrame, chunks: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """frames, `columns` of the chunk that covers each (the first of them tells which one wins: the largest, then the latest start) and `local`, its place there."""
    known = [F.col(k).isNotNull() for k in keys]
    more = [c for c in frames.columns if c not in (*keys, order, *columns, "local")]
    own, of = [f"__fw_f{i}" for i in range(len(more))], [f"__fw_c{i}" for i in range(len(columns))]
    left = frames.select(*keys, F.col(order).alias("__fw_at"), *(F.col(c).alias(x) for c, x in zip(more, own, strict=True)))
    right = chunks.filter(reduce(and_, known, F.col("stop") > F.col("start"))).select(*keys, F.col("start").alias("__fw_at"), F.col("stop").alias("__fw_stop"), *(F.col(c).alias(x) for c, x in zip(columns, of, strict=True)))
    rows = left.unionByName(right, allowMissingColumns=True).select(*keys, "__fw_at", "__fw_stop", *of, *own)
    rows = K.dealt(rows, keys).sortWithinPartitions(*keys)
    kinds = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(kinds[c] for c in (*keys, "__fw_at", *own)), *(T.StructField(c, kinds[c].dataType) for c in of), T.StructField("__fw_start", kinds["__fw_at"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, len(keys)):
            group = np.searchsorted(K.group_starts(table, len(keys)), np.arange(table.num_rows), "right")
            is_chunk = table.column("__fw_stop").is_valid()
            due, held = table.filter(pc.invert(is_chunk)), table.filter(is_chunk)
            chunk_of = is_chunk.to_numpy(zero_copy_only=False)
            best = pa.array(K.covering(due.column("__fw_at"), group[~chunk_of], held.column("__fw_at"), held.column("__fw_stop"), group[chunk_of], held.column(of[0])))
            best = pc.if_else(pc.less(best, 0), pa.scalar(None, best.type), best)
            found = due.select([*keys, "__fw_at", *own])
            for name in (*of, "__fw_at"):
                found = found.append_column("__fw_start" if name == "__fw_at" else name, held.column(name).combine_chunks().take(best))
            yield from found.combine_chunks().to_batches()

    met = rows.mapInArrow(run, schema)
    at = F.col("__fw_at").cast(dict(frames.dtypes)[order])
    start = F.col("__fw_start").cast(dict(chunks.dtypes)["start"])
    return met.select(*keys, at.alias(order), *(F.col(x).alias(c) for c, x in zip(more, own, strict=True)), *(F.col(x).alias(c) for c, x in zip(columns, of, strict=True)), (at - start).alias("local"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], direction: str = "backward", tolerance: Column | float | None = None, at: str = "matched_at") -> DataFrame:
    """left with `columns` of the right row that is last at its time or before (backward), first at it or after (forward), or nearest (before on ties).

    Both sides go into one table ordered by time, and the last right row so far is a window: no self-join, one shuffle by keys.
    Of right rows at one time, backward takes the largest values, forward the smallest. Rows further away than the tolerance do not count; nulls where
    nothing matches. A null time matches nothing; left rows that repeat stay.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("backward, forward or nearest")
    names, number = left.columns, _numbers(dict(left.dtypes)[time])
    value = F.struct(F.col(time).alias("at"), *columns)
    one = left.select(*keys, time, F.lit(True).alias("__fw_left"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("__fw_row"))
    two = right.filter(F.col(time).isNotNull()).select(*keys, time, F.lit(False).alias("__fw_left"), value.alias("__fw_v"))
    both = one.unionByName(two, allowMissingColumns=True)
    sides = {}
    if direction != "forward":
        w = W.partitionBy(*keys).orderBy(time, "__fw_left", "__fw_v").rowsBetween(W.unboundedPreceding, 0)
        sides["__fw_b"] = F.last("__fw_v", True).over(w)
    if direction != "backward":
        w = W.partitionBy(*keys).orderBy(F.desc(time), "__fw_left", F.desc("__fw_v")).rowsBetween(W.unboundedPreceding, 0)
        sides["__fw_f"] = F.last("__fw_v", True).over(w)
    for name, found in sides.items():
        both = both.withColumn(name, found)
    rows = both.filter("__fw_left")
    gap = lambda side: F.when(F.col(f"{side}.at") <= F.col(time), number(F.col(time)) - number(F.col(f"{side}.at"))).otherwise(number(F.col(f"{side}.at")) - number(F.col(time)))
    ok = lambda side: F.col(side).isNotNull() & F.col(time).isNotNull() & (F.lit(True) if tolerance is None else gap(side) <= tolerance)
    for side in sides:
        rows = rows.withColumn(side, F.when(ok(side), F.col(side)))
    if direction == "nearest":
        later = F.col("__fw_b").isNull() | (F.col("__fw_f").isNotNull() & (gap("__fw_f") < gap("__fw_b")))
        rows = rows.withColumn("__fw_best", F.when(later, F.col("__fw_f")).otherwise(F.col("__fw_b")))
    else:
        rows = rows.withColumn("__fw_best", F.col(next(iter(sides))))
    return rows.select(*[F.col(f"__fw_row.c{i}").alias(c) for i, c in enumerate(names)], *[F.col(f"__fw_best.{c}").alias(c) for c in columns], F.col("__fw_best.at").alias(at))


def _numbers(kind: str) -> Callable[[Column], Column]:
    """Times of a type as numbers: of seconds for timestamps, as they are otherwise."""
    return (lambda t: F.unix_micros(t.cast("timestamp")) / 1e6) if kind.startswith("timestamp") else (lambda t: t.cast("double"))


def resampled(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, out: str = "sampled") -> DataFrame:
    """left with the value of the right side at its time: straight between the rows before and after, however far apart, held at the ends, null if there are none."""
    pair = as_of(as_of(left, right, keys, time, [value], "backward", at="__fw_t0").withColumnRenamed(value, "__fw_v0"), right, keys, time, [value], "forward", at="__fw_t1")
    pair = pair.withColumnRenamed(value, "__fw_v1")
    number = _numbers(dict(left.dtypes)[time])
    t, a, b = (number(F.col(c)) for c in (time, "__fw_t0", "__fw_t1"))
    line = F.col("__fw_v0") + (F.col("__fw_v1") - F.col("__fw_v0")) * (t - a) / F.nullif(b - a, F.lit(0.0))
    return pair.withColumn(out, F.coalesce(line, F.col("__fw_v0"), F.col("__fw_v1"))).drop("__fw_v0", "__fw_v1", "__fw_t0", "__fw_t1")


def fill_timeline(chunks: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, start, stop): chunks and the source intervals between, before and after them; totals has `total` frames."""
    w = W.partitionBy(*keys).orderBy("start")
    known = totals.join(chunks.select(*keys, "start", "stop"), keys, "left")
    known = known.withColumn("__fw_was", F.coalesce(F.lag("stop").over(w), F.lit(0).cast("long"))).withColumn("__fw_next", F.lead("start").over(w))
    part = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("start"), b.cast("long").alias("stop"))
    # before a chunk, the chunk, and what follows the last one; a recording without chunks is one source interval
    before = part("source", F.col("__fw_was"), F.coalesce("start", "total"))
    rest = part("source", F.coalesce("stop", "total"), F.when(F.col("__fw_next").isNull(), F.col("total")).otherwise(F.col("stop")))
    each = known.select(*keys, F.explode(F.array(before, part("chunk", F.col("start"), F.col("stop")), rest)).alias("__fw_p"))
    return each.select(*keys, "__fw_p.*").filter("stop > start")


def contiguity(df: DataFrame, keys: list[str], order: str, expected: str | None = None) -> DataFrame:
    """(keys, n, contiguous): whether the frames are exactly 0 .. expected - 1, each once (expected: as many as there are different frames).

    One aggregation; the set of an episode's frames is bounded by its length.
    """
    held = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.size(F.collect_set(order)).cast("long").alias("__fw_d"), F.min(order).alias("__fw_low"), F.max(order).alias("__fw_high"), *([F.max(expected).alias("__fw_e")] if expected else [])
    )
    e = F.col("__fw_e") if expected else F.col("__fw_d")
    return held.select(*keys, "n", ((F.col("__fw_d") == e) & (F.col("n") == e) & (F.col("__fw_low") == 0) & (F.col("__fw_high") == e - 1)).alias("contiguous"))


def interpolate_gaps(df: DataFrame, keys: list[str], order: str, value: str, known: str, out: str = "filled") -> DataFrame:
    """Linear between known rows, held at the ends; `confidence` 1 where known, 0.55 where filled, null if nothing is known."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    pair = F.when(F.col(known), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    both = df.withColumn("__fw_b", F.last(pair, True).over(before)).withColumn("__fw_a", F.last(pair, True).over(after))
    share = (F.col(order) - F.col("__fw_b.at")) / F.nullif(F.col("__fw_a.at") - F.col("__fw_b.at"), F.lit(0))
    line = F.col("__fw_b.v") + (F.col("__fw_a.v") - F.col("__fw_b.v")) * share
    filled = F.when(F.col(known), F.col(value)).otherwise(F.coalesce(line, F.col("__fw_b.v"), F.col("__fw_a.v")))
    return both.withColumn(out, filled).withColumn("confidence", F.when(F.col(known), 1.0).when(filled.isNotNull(), 0.55)).drop("__fw_b", "__fw_a")


def scheduled(order: str, stride: int, last: Column | None = None) -> Column:
    """Every stride-th frame, and the last one where it is given."""
    due = F.col(order) % stride == 0
    return due if last is None else due | (F.col(order) == last)


def reentry_prompts(df: DataFrame, keys: list[str], order: str, valid: str, stride: int) -> DataFrame:
    """prompt: valid, and scheduled or not valid one frame before."""
    was = F.coalesce(F.lag(valid).over(W.partitionBy(*keys).orderBy(order)), F.lit(False))
    return df.withColumn("prompt", F.col(valid) & (scheduled(order, stride) | ~was))


def sample_times(df: DataFrame, keys: list[str], order: str, samples: int = 5, shutter: float = 0.5) -> DataFrame:
    """df and (sample, at): times inside each frame's shutter, centred on the frame and kept inside the recording."""
    last = F.max(order).over(W.partitionBy(*keys))
    shift = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: (k - (samples - 1) / 2) * (shutter / max(1, samples - 1)))
    each = df.withColumn("__fw_last", last).select("*", F.posexplode(shift).alias("sample", "__fw_shift"))
    at = F.least(F.col("__fw_last").cast("double"), F.greatest(F.lit(0.0), F.col(order) + F.col("__fw_shift")))
    return each.withColumn("at", at).drop("__fw_last", "__fw_shift")


def interpolate_at(df: DataFrame, keys: list[str], order: str, value: str, samples: int = 5, shutter: float = 0.5, out: str = "sampled") -> DataFrame:
    """df, (sample, at) of sample_times, and the value there, straight between neighbouring frames: one window, no join.

    Frames are consecutive; times lie within one frame of their own.
    """
    w = W.partitionBy(*keys).orderBy(order)
    near = F.transform(F.array(F.lag(value).over(w), F.col(value), F.lead(value).over(w)), lambda x: F.coalesce(x, F.col(value)))
    rows = sample_times(df.withColumn("__fw_near", near), keys, order, samples, shutter)
    rows = rows.withColumn("__fw_i", (F.floor("at") - F.col(order) + 1).cast("int"))
    a, b = F.col("__fw_near")[F.col("__fw_i")], F.col("__fw_near")[F.least(F.col("__fw_i") + 1, F.lit(2))]
    return rows.withColumn(out, a + (b - a) * (F.col("at") - F.floor("at"))).drop("__fw_near", "__fw_i")
