"""Manifests, validation, scheduling and provenance of batches of recordings."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.kernels import group_starts

#: Scratch bytes a frame, for large and small pictures, and the largest small picture.
LARGE_FRAME, SMALL_FRAME, SMALL_PIXELS = 2_800_000, 1_100_000, 640 * 480


def scratch_bytes(width: Column, height: Column, frames: Column) -> Column:
    return F.when(width * height > SMALL_PIXELS, frames * LARGE_FRAME).otherwise(frames * SMALL_FRAME).cast("long")


def selected(spark: SparkSession, selector: str) -> DataFrame:
    """(episode): numbers and ranges of a list such as `1,3-5`, each once; a descending range raises."""
    parts = spark.range(1).select(F.explode(F.split(F.lit(selector), ",")).alias("part")).select(F.trim("part").alias("part")).filter("part <> ''")
    ends = F.split("part", "-")
    low, high = ends[0].cast("long"), F.element_at(ends, -1).cast("long")
    checked = F.when(low > high, F.raise_error(F.concat(F.lit("descending range: "), F.col("part"))).cast("array<bigint>")).otherwise(F.sequence(low, high))
    return parts.select(F.explode(checked).alias("episode")).distinct()


def numeric_order(name: str) -> list[Column]:
    """Numbers first, by value; other names after them."""
    number = F.expr(f"try_cast({name} as bigint)")
    return [number.isNull(), number, F.col(name)]


def integer_frames(frames: Column, duration: Column, rate_num: Column, rate_den: Column) -> Column:
    """The stated number of frames, else duration by rate, rounded half to even."""
    return F.coalesce(frames.try_cast("bigint"), F.rint(duration * rate_num / rate_den).cast("long"))


def episode_state(status: Column, valid: Column, claimed: Column, retry: bool) -> Column:
    """done, failed, claimed or runnable."""
    return (
        F.when((status == "completed") & valid, "done")
        .when((status == "failed") & F.lit(not retry), "failed")
        .when(claimed, "claimed")
        .otherwise("runnable")
    )


def violations(rules: list[tuple[int, str, DataFrame]], keys: list[str]) -> DataFrame:
    """(keys, ord, message) of every rule's offenders."""
    out = None
    for number, message, offenders in rules:
        one = offenders.select(*keys, F.lit(number).alias("ord"), F.lit(message).alias("message"))
        out = one if out is None else out.unionByName(one)
    return out


def resume_stage(video: Column, masks: Column, expected: Column) -> Column:
    return F.when(video, "compose").when(masks == expected, "inpaint").otherwise("segment")


def failed_stage(masks: Column, rendered: Column, expected: Column) -> Column:
    return F.when(masks == expected, "inpaint_or_compose").when(rendered == expected, "segment").otherwise("trajectory_or_render")


def assign_lanes(jobs: DataFrame, group: list[str], cost: str, order: list[Column], lanes: int) -> DataFrame:
    """jobs and the lane of each: in order, every job goes to the lane with the least so far, the first on ties; a null cost counts as none.

    Jobs are sorted by group and order inside partitions and pass one by one: what is held is a heap of the lanes' loads, whatever a group's size.
    """
    names = [f"__fw_g{i}" for i in range(len(group))]
    sorted_ = jobs.repartition(*group).sortWithinPartitions(*group, *order)
    rows = sorted_.select(*[F.col(g).alias(a) for g, a in zip(group, names, strict=True)], F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("__fw_c"), *[F.col(f"`{c}`") for c in jobs.columns])
    schema, jobs_columns = T.StructType([*jobs.schema.fields, T.StructField("lane", T.IntegerType())]), jobs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heap = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = set(group_starts(batch, len(names)).tolist())
            first = tuple(batch.column(i)[0].as_py() for i in range(len(names)))
            if first == last:
                starts.discard(0)
            placed = []
            for i, c in enumerate(batch.column(len(names)).to_pylist()):
                if i in starts:
                    heap = [(0, lane) for lane in range(lanes)]
                load, lane = heap[0]
                heapq.heapreplace(heap, (load + c, lane))
                placed.append(lane)
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(names) + 1 :], pa.array(placed, pa.int32())], names=[*jobs_columns, "lane"])

    return rows.mapInArrow(run, schema)


def changed_entries(rows: DataFrame, keys: list[str], stored: str, current: str) -> DataFrame:
    """(keys, name, stored, current) of entries of the current map that differ from the stored map of the same row (null-safe): no join."""
    one = rows.select(*keys, F.col(stored).alias("__fw_stored"), F.explode(current).alias("name", "current"))
    was = F.when(F.map_contains_key("__fw_stored", F.col("name")), F.col("__fw_stored")[F.col("name")])
    return one.withColumn("stored", was).filter(~F.col("stored").eqNullSafe(F.col("current"))).select(*keys, "name", "stored", "current")


def provenance_diff(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, stored, current) of current entries that differ from the stored ones (null-safe); both hold a map `meta`."""
    now = current.select(*keys, F.explode("meta").alias("name", "current"))
    was = stored.select(*keys, F.explode("meta").alias("name", "stored"))
    return now.join(was, [*keys, "name"], "left").filter(~F.col("stored").eqNullSafe(F.col("current"))).select(*keys, "name", "stored", "current")


def version_tuple(text: Column) -> Column:
    """The digits of each dotted piece, up to the first piece without digits."""
    digits = F.transform(F.split(text, r"\."), lambda x: F.regexp_replace(x, r"\D", ""))
    bad = F.array_position(digits, F.lit(""))
    kept = F.when(bad > 0, F.slice(digits, F.lit(1), (bad - 1).cast("int"))).otherwise(digits)
    return F.transform(kept, lambda x: x.cast("long"))


def file_hashes(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, length, modificationTime, sha256) of binary files; those in `known` with the same size and time are not read again."""
    facts = ["path", "length", "modificationTime"]
    fresh = files if known is None else files.join(known.select(*facts), facts, "left_anti")
    hashed = fresh.select(*facts, F.sha2("content", 256).alias("sha256"))
    return hashed if known is None else hashed.unionByName(files.select(*facts).join(known.select(*facts, "sha256"), facts))


def manifest_summary(episodes: DataFrame, by: list[str], width: Column, height: Column, frames: str = "frames", bytes_: str = "bytes", chunks: str = "n_chunks") -> DataFrame:
    """(by, episodes, frames, bytes, scratch, chunks) over a manifest; what is not known counts as nothing."""
    none = lambda c: F.coalesce(c, F.lit(0))
    rows = episodes.withColumn("__fw_scratch", scratch_bytes(width, height, none(frames)))
    return rows.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.sum(none(frames)).alias("frames"), F.sum(bytes_).alias("bytes"), F.sum("__fw_scratch").alias("scratch"), F.sum(none(chunks)).alias("chunks")
    )


def round_robin(number: Column, workers: int) -> Column:
    """The worker of a job by its number from 0."""
    return F.pmod(number, F.lit(workers))
