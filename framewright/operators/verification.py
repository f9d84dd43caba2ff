"""Checks of runs, videos, masks and manifests, as tables of broken rules; states, artifacts and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import batch as B
from framewright.sources.checkpoints import settled


def manifest(raw: DataFrame, text: str = "value", versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(version, episodes array<struct<episode, frames>>) of manifest texts; another version raises."""
    parsed = raw.select(F.from_json(text, "version int, episodes array<struct<episode: string, frames: bigint>>").alias("m")).select("m.*")
    ok = F.when(F.col("version").isin(*versions), F.col("version")).otherwise(F.raise_error(F.lit("unsupported manifest version")).cast("int"))
    return parsed.withColumn("version", ok)


def status_of(text: Column) -> Column:
    """The state that a status text names: pending where there is none or it names none, invalid where it cannot be read."""
    read = F.try_parse_json(text)
    return F.when(text.isNull(), "pending").when(read.isNull(), "invalid").otherwise(F.coalesce(F.try_variant_get(read, "$.state", "string"), F.lit("pending")))


def status_counts(episodes: DataFrame, statuses: DataFrame, key: str, text: str) -> DataFrame:
    """(state, n) over all episodes of a manifest."""
    return episodes.select(key).join(statuses.select(key, text), key, "left").groupBy(status_of(F.col(text)).alias("state")).agg(F.count("*").alias("n"))


def runnable(episodes: DataFrame, state: Column, order: list[Column], most: int | None = None) -> DataFrame:
    """Episodes in the state `runnable`, in order, `most` at most."""
    rows = episodes.withColumn("state", state).filter("state = 'runnable'").orderBy(*order)
    return rows if most is None else rows.limit(most)


def chosen(episodes: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """The episodes that the selection names; one that is missing raises."""
    both = selection.select(key).distinct().join(episodes.withColumn("__fw_there", F.lit(True)), key, "left")
    ok = F.when(F.col("__fw_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such episode: "), F.col(key).cast("string"))).cast("boolean"))
    return both.withColumn("__fw_there", ok).filter("__fw_there").drop("__fw_there")


def choose_hosts(hosts: DataFrame, group: list[str], free: str, index: str, least_free: int, preferred: Column | None = None, most: int | None = None, fewest: int = 0) -> DataFrame:
    """hosts with enough free and their `place`: the preferred ones first (by the column's number, null last), then the freest; `most` at most.

    A group with fewer than `fewest` raises. The freest host (the highest index on ties) is in `freest`.
    """
    able = hosts.filter(F.col(free) >= least_free)
    first = F.lit(None).cast("int") if preferred is None else preferred
    w = W.partitionBy(*group).orderBy(first.isNull(), first, F.desc(free), index)
    top = F.max(F.struct(free, index)).over(W.partitionBy(*group))[index]
    rows = able.withColumn("place", F.row_number().over(w).cast("long")).withColumn("freest", top).withColumn("__fw_n", F.count("*").over(W.partitionBy(*group)))
    ok = F.when(F.col("__fw_n") >= fewest, F.lit(True)).otherwise(F.raise_error(F.lit("too few hosts are free")).cast("boolean"))
    rows = rows.withColumn("__fw_ok", ok).filter("__fw_ok").drop("__fw_n", "__fw_ok")
    return rows if most is None else rows.filter(F.col("place") <= most)


def segment_name(index: Column, mode: Column, start: Column, stop: Column) -> Column:
    """The numbers are filled up to three and five digits; a formatter, which is slow, sees only what is null or negative."""
    filled = lambda x, n: F.concat(F.substring(F.lit("0" * n), 1, n - F.length(x.cast("string"))), x.cast("string"))
    plain = F.concat_ws("_", filled(index, 3), mode, filled(start, 5), filled(stop, 5))
    return F.when((index >= 0) & (start >= 0) & (stop >= 0) & mode.isNotNull(), plain).otherwise(F.format_string("%03d_%s_%05d_%05d", index, mode, start, stop))


def parse_segments(names: DataFrame, name: str) -> DataFrame:
    """names and (mode, start, stop); other names are left out."""
    part = lambda i: F.regexp_extract(name, r"^(\d+)_(left|right|both)_(\d+)_(\d+)$", i)
    return names.filter(part(1) != "").withColumn("mode", part(2)).withColumn("start", part(3).cast("long")).withColumn("stop", part(4).cast("long"))


def sides_of(segments: DataFrame, mode: str = "mode") -> DataFrame:
    """One row for each side of a segment."""
    return segments.withColumn("side", F.explode(F.when(F.col(mode) == "both", F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(mode))))


def with_artifacts(segments: DataFrame, artifacts: DataFrame, keys: list[str], kind: str, kinds: list[str], strict: bool) -> DataFrame:
    """Segments that have an artifact of each kind; a segment that lacks one raises (strict) or is left out."""
    held = artifacts.filter(F.col(kind).isin(*kinds)).groupBy(*keys).agg(F.countDistinct(kind).alias("__fw_kinds"))
    both = segments.join(held, keys, "left").withColumn("__fw_whole", F.coalesce(F.col("__fw_kinds") == len(kinds), F.lit(False)))
    if strict:
        both = both.withColumn("__fw_whole", F.when(F.col("__fw_whole"), F.lit(True)).otherwise(F.raise_error(F.lit("a segment lacks an artifact")).cast("boolean")))
    return both.filter("__fw_whole").drop("__fw_kinds", "__fw_whole")


def open_jobs(segments: DataFrame, frames: DataFrame, done: DataFrame, keys: list[str], expected: str) -> DataFrame:
    """Segments still to be composed: their frames (n) must be as many as expected, else it raises; those that are done are left out."""
    both = segments.join(frames.select(*keys, F.col("n").alias("__fw_n")), keys, "left")
    ok = F.when(F.coalesce(F.col("__fw_n"), F.lit(0)) == F.col(expected), F.lit(True)).otherwise(F.raise_error(F.lit("the render of a segment is incomplete")).cast("boolean"))
    return both.withColumn("__fw_ok", ok).filter("__fw_ok").drop("__fw_n", "__fw_ok").join(done.select(*keys).distinct(), keys, "left_anti")


def unfinished_sides(sides: DataFrame, masks: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Sides of segments whose masks (n) are not as many as their frames."""
    both = sides.join(masks.select(*keys, F.col("n").alias("__fw_n")), keys, "left")
    return both.filter(F.coalesce(F.col("__fw_n"), F.lit(0)) != F.col(stop) - F.col(start)).drop("__fw_n")


def in_order(names: DataFrame, first: DataFrame, second: DataFrame, on: str, place: str) -> DataFrame:
    """names and their place in the first table, else in the second; a name that neither has raises."""
    a, b = first.select(on, F.col(place).alias("__fw_a")), second.select(on, F.col(place).alias("__fw_b"))
    found = F.coalesce("__fw_a", "__fw_b")
    checked = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), F.col(on).cast("string"))).cast("long"))
    return names.join(a, on, "left").join(b, on, "left").withColumn(place, checked.cast("long")).drop("__fw_a", "__fw_b")


def video_errors(videos: DataFrame, expected: DataFrame, keys: list[str], ord_: int) -> DataFrame:
    """(keys, ord, message) of expected videos (keys, name, frames): missing (or empty), unreadable, or with another number of frames (catalogue: keys, name, bytes, n)."""
    both = expected.join(videos.select(*keys, "name", F.col("bytes").alias("__fw_bytes"), F.col("n").alias("__fw_n")), [*keys, "name"], "left")
    message = (
        F.when(F.coalesce(F.col("__fw_bytes"), F.lit(0)) == 0, F.concat(F.lit("missing video: "), F.col("name")))
        .when(F.col("__fw_n").isNull(), F.concat(F.lit("unreadable video "), F.col("name")))
        .when(F.col("__fw_n") != F.col("frames"), F.concat(F.lit("frame mismatch "), F.col("name"), F.lit(": expected "), F.col("frames").cast("string"), F.lit(", got "), F.col("__fw_n").cast("string")))
    )
    return both.select(*keys, F.lit(ord_).alias("ord"), message.alias("message")).filter("message is not null")


def unfolded(df: DataFrame, keys: list[str], rules: list[tuple[int, Column, Column | str]], more: Column | None = None) -> DataFrame:
    """(keys, ord, message) of the rules (ord, when broken, message) that a row breaks: all of them computed together, in one pass over df.

    A condition that is null is not broken. more: another array of such structs, for rules over a row's own arrays.
    """
    said = lambda m: m if isinstance(m, Column) else F.lit(m)
    found = F.array(*(F.when(broken, F.struct(F.lit(n).alias("ord"), said(message).alias("message"))) for n, broken, message in rules))
    whole = found if more is None else F.concat(found, F.coalesce(more, F.array().cast("array<struct<ord: int, message: string>>")))
    return df.select(*keys, F.inline(F.filter(whole, lambda x: x.isNotNull())))


def _video(name: Column, size: Column, n: Column, frames: Column) -> Column:
    """What is wrong with a video, or null: missing (or empty), unreadable, another number of frames."""
    other = F.concat(F.lit("frame mismatch "), name, F.lit(": expected "), frames.cast("string"), F.lit(", got "), n.cast("string"))
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.concat(F.lit("missing video: "), name)).when(n.isNull(), F.concat(F.lit("unreadable video "), name)).when(n != frames, other)


def run_errors(episodes: DataFrame, chunks: DataFrame, finals: list[str], backend: str | None = None, checked: DataFrame | None = None) -> DataFrame:
    """(episode, ord, message): the broken rules of runs whose facts stand in one row each.

    episodes: episode, frames, known (its metadata are there), total_frames (null where they cannot be read), skipped, backend, traced (its backend is recorded),
    finals map<name, struct<bytes, n>>; chunks: episode, name, length, provenance, bytes and n of its video, masks. Without metadata nothing else is checked.
    What is wrong with chunks needs no more of their run than that it is known: `checked` (episode) are the runs whose chunks count, by default the known ones of episodes.
    """
    known, c = F.coalesce("known", F.lit(False)), F.col
    rules: list[tuple[int, Column, Column | str]] = [
        (1, ~known, "missing metadata"),
        (2, known & c("total_frames").isNull(), "invalid metadata"),
        (3, known & (c("total_frames") != c("frames")), "total_frames does not match the manifest"),
        (4, known & (c("skipped") > 0), F.concat(c("skipped").cast("string"), F.lit(" skipped segments remain"))),
    ]
    if backend is not None:
        traced = F.coalesce("traced", F.lit(False))
        rules += [
            (5, known & ~traced, "missing pipeline provenance"),
            (6, known & traced & ~c("backend").eqNullSafe(F.lit(backend)), F.concat(F.lit(f"mask backend mismatch: expected {backend}, got "), F.coalesce("backend", F.lit("none")))),
        ]
    video = lambda name: _video(name, F.try_element_at("finals", name)["bytes"], F.try_element_at("finals", name)["n"], c("frames"))
    last = F.transform(F.array(*map(F.lit, finals)).cast("array<string>"), lambda name: F.struct(F.lit(10).alias("ord"), video(name).alias("message")))
    own, masks = _video(c("name"), c("bytes"), c("n"), c("length")), F.coalesce("masks", F.lit(0))
    per: list[tuple[int, Column, Column | str]] = [] if backend is None else [(7, ~F.coalesce("provenance", F.lit(False)), F.concat(F.lit("missing provenance for "), c("name")))]
    per += [
        (8, own.isNotNull(), own),
        (9, masks != c("length"), F.concat(F.lit("mask count mismatch "), c("name"), F.lit(": expected "), c("length").cast("string"), F.lit(", got "), masks.cast("string"))),
    ]
    checked = episodes.filter(known) if checked is None else checked
    broken = unfolded(chunks, ["episode"], per).join(checked.select("episode"), "episode", "left_semi")
    return unfolded(episodes, ["episode"], rules, F.when(known, F.filter(last, lambda x: x["message"].isNotNull()))).unionByName(broken)


def episode_errors(
    episodes: DataFrame, metadata: DataFrame, skipped: DataFrame, backends: DataFrame, chunks: DataFrame, provenance: DataFrame, masks: DataFrame, videos: DataFrame, finals: list[str], backend: str | None = None
) -> DataFrame:
    """(episode, ord, message): run_errors of facts that lie in tables of their own: a manifest (episode, frames), metadata (episode, total_frames), skipped
    segments (episode), the mask backend (episode, backend), chunks (episode, index, mode, start, stop), their provenance (episode, name), numbers of masks
    (episode, name, n), and videos (episode, name, bytes, n), the final ones among them.

    Tables of one grain are united and grouped once, whatever the number of rules; facts of chunks are dealt by run, where their messages meet the known runs without being dealt again.
    """
    name = segment_name(F.col("index"), F.col("mode"), F.col("start"), F.col("stop"))
    per = [
        chunks.select("episode", name.alias("name"), (F.col("stop") - F.col("start")).cast("long").alias("length")),
        provenance.select("episode", "name", F.lit(True).alias("provenance")),
        masks.select("episode", "name", F.col("n").cast("long").alias("masks")),
        videos.select("episode", "name", F.col("bytes").cast("long").alias("bytes"), F.col("n").cast("long").alias("n")),
    ]
    facts = per[0]
    for df in per[1:]:
        facts = facts.unionByName(df, allowMissingColumns=True)
    held = facts.repartition("episode").groupBy("episode", "name").agg(*(F.max(x).alias(x) for x in ("length", "provenance", "masks", "bytes", "n")))
    final = videos.filter(F.col("name").isin(finals))
    ends = [(F.col("name") == name, f"{{}}{i}".format) for i, name in enumerate(finals)]
    whole = [
        episodes.select("episode", F.lit(True).alias("listed"), F.col("frames").cast("long").alias("frames")),
        metadata.select("episode", F.lit(True).alias("known"), F.col("total_frames").cast("long").alias("total_frames")),
        skipped.select("episode", F.lit(1).cast("long").alias("skipped")),
        final.select("episode", *(F.when(own, value).alias(at(x)) for own, at in ends for x, value in (("there", F.lit(True)), ("bytes", F.col("bytes").cast("long")), ("n", F.col("n").cast("long"))))),
    ]
    rows = whole[0]
    for df in whole[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    # numbers and flags only: an aggregate of texts or lists is one of sorted rows
    one = rows.groupBy("episode").agg(
        *(F.max(x).alias(x) for x in ("listed", "frames", "known", "total_frames", *(at(x) for _, at in ends for x in ("there", "bytes", "n")))), F.sum("skipped").alias("skipped")
    )
    entry = lambda name, at: F.when(F.col(at("there")), F.struct(F.lit(name).alias("key"), F.struct(F.col(at("bytes")).alias("bytes"), F.col(at("n")).alias("n")).alias("value")))
    entries = F.array(*(entry(name, at) for name, (_, at) in zip(finals, ends, strict=True))).cast("array<struct<key: string, value: struct<bytes: bigint, n: bigint>>>")
    one = one.withColumn("finals", F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())))
    traced = backends.groupBy("episode").agg(F.lit(True).alias("traced"), F.max("backend").alias("backend"))
    one = one.filter("listed").join(traced, "episode", "left")
    checked = episodes.select("episode").join(metadata.select("episode"), "episode", "left_semi")
    return run_errors(one, held.filter(F.col("length").isNotNull()), finals, backend, checked)


def inspect_episodes(inputs: DataFrame, videos: DataFrame, tables: DataFrame, required: list[str]) -> DataFrame:
    """(episode, frames, input_bytes, scratch_bytes, problem) from inputs (episode, name, bytes), videos (episode, width, height, n) and pose tables (episode, rows)."""
    held = inputs.groupBy("episode").agg(F.sum("bytes").alias("input_bytes"), F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.collect_set("name"))).alias("missing"))
    both = held.join(videos, "episode", "left").join(tables, "episode", "left")
    problem = F.when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", "))).when(
        ~F.col("n").eqNullSafe(F.col("rows")), F.concat(F.lit("camera has "), F.coalesce(F.col("n").cast("string"), F.lit("no")), F.lit(" frames but the table has "), F.coalesce(F.col("rows").cast("string"), F.lit("no")))
    )
    return both.select("episode", F.col("rows").alias("frames"), "input_bytes", B.scratch_bytes(F.col("width"), F.col("height"), F.col("rows")).alias("scratch_bytes"), problem.alias("problem"))


def mask_report(cells: DataFrame, frames: DataFrame, keys: list[str], width: int, height: int, least: int = 64) -> DataFrame:
    """(keys, area, border, small) of every frame: mask cells (keys, x, y) counted, whether they touch the border, and whether they are too few."""
    edge = F.col("x").isin(0, width - 1) | F.col("y").isin(0, height - 1)
    per = cells.distinct().groupBy(*keys).agg(F.count("*").alias("area"), F.bool_or(edge).alias("border"))
    rows = frames.select(*keys).join(per, keys, "left").withColumn("area", F.coalesce("area", F.lit(0).cast("long"))).withColumn("border", F.coalesce("border", F.lit(False)))
    return rows.withColumn("small", F.col("area") < least)


def union_checked(masks: DataFrame, episode: str, frame: str, sides: int, least: int = 256) -> DataFrame:
    """(episode, frame, area, problem): cells (episode, frame, side, x, y, w, h) of all sides put together.

    Problems: a side without the frame, shapes that differ, fewer than `least` cells. A side's frame without cells is one row of null x and y.
    """
    per = masks.groupBy(episode, frame).agg(
        F.countDistinct("side").alias("__fw_sides"), F.countDistinct("w", "h").alias("__fw_shapes"), F.countDistinct(F.when(F.col("x").isNotNull(), F.struct("x", "y"))).alias("area")
    )
    problem = F.when(F.col("__fw_sides") < sides, "a side is missing").when(F.col("__fw_shapes") > 1, "shapes differ").when(F.col("area") < least, "too small")
    return per.select(episode, frame, "area", problem.alias("problem"))


def split_errors(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of frames whose robot cells are not exactly the disjoint union of arm and hand cells; cells are (keys, part, x, y)."""
    one = cells.groupBy(*keys, "x", "y").agg(*(F.max((F.col("part") == p).cast("int")).alias(p) for p in ("robot", "arm", "hand")))
    return one.filter((F.col("arm") + F.col("hand") > 1) | (F.col("robot") != F.greatest("arm", "hand"))).select(*keys).distinct()


def trajectory_errors(values: DataFrame, errors: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, message): joint values (keys, joint, frame, q, low, high) and residuals (keys, frame, position, orientation) of every run.

    Each joint has the expected frames, finite values inside its limits (1e-5 of slack); residuals are finite, not negative,
    0.01 m and 5 degrees at most.
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    q = F.col("q")
    joints = values.groupBy(*keys, "joint").agg(F.countDistinct("frame").alias("n"), F.bool_or(bad(q)).alias("odd"), F.bool_or((q < F.col("low") - 1e-5) | (q > F.col("high") + 1e-5)).alias("out"))
    joints = joints.join(expected, keys).groupBy(*keys).agg(F.bool_or(F.col("n") != F.col("frames")).alias("short"), F.bool_or("odd").alias("odd"), F.bool_or("out").alias("out"))
    rest = errors.groupBy(*keys).agg(
        F.bool_or(bad(F.col("position")) | bad(F.col("orientation")) | (F.col("position") < 0) | (F.col("orientation") < 0)).alias("odd"),
        F.max("position").alias("position"), F.max("orientation").alias("orientation"),
    )
    return B.violations(
        [
            (1, "a joint has other frames than the run", joints.filter("short")), (2, "a joint value is not finite", joints.filter("odd")), (3, "a joint leaves its limits", joints.filter("out")),
            (4, "a residual is not finite or negative", rest.filter("odd")), (5, "a position residual is over 0.01", rest.filter("position > 0.01")), (6, "an orientation residual is over 5 degrees", rest.filter("orientation > 5")),
        ],
        keys,
    )


def fingerprint(files: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """(keys, sha256) over all files of a group in the order of their paths: path, a zero byte, content, a zero byte."""
    one = F.struct(F.encode(path, "UTF-8").alias("p"), F.hex(content).alias("c"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda f: F.concat(F.hex(f["p"]), F.lit("00"), f["c"], F.lit("00"))), "")
    return files.groupBy(*keys).agg(F.sha2(F.unhex(whole), 256).alias("sha256"))


def signature(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature map<path, struct<size, mtime>>) of files (path, length, modificationTime)."""
    entry = F.struct("path", F.struct(F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).alias("v"))
    return files.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("signature"))


def first_success(attempts: DataFrame, keys: list[str], order: str, ok: str, kept: str, alone: Column | None = None) -> DataFrame:
    """(keys, kept): the first attempt in order that succeeded, null if none did; groups flagged `alone` count only their first attempt."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    rows = attempts.withColumn("__fw_place", place).withColumn("__fw_alone", F.lit(False) if alone is None else alone)
    usable = F.col(ok) & (~F.col("__fw_alone") | (F.col("__fw_place") == 1))
    return rows.groupBy(*keys).agg(F.min(F.when(usable, F.struct("__fw_place", kept)))[kept].alias(kept))


def published(df: DataFrame, keys: list[str], path: str) -> None:
    """Write the partitions (by keys) that df has rows of; the others stay. Files are moved into place when all are written, so a write that fails leaves what was there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def save_state(states: DataFrame, path: str) -> None:
    """The last state of each chunk chain (episode, side, hand, arm, translation, rotation, source_frame), in place of that chain's state before; other chains stay."""
    published(states, ["episode", "side"], path)


def load_state(spark: SparkSession, wanted: DataFrame, path: str | None) -> DataFrame:
    """wanted (episode, side) and the state that was saved: nulls where there is none, and source_frame -1 where it is not known."""
    schema = "episode long, side string, hand array<double>, arm array<double>, translation array<double>, rotation array<double>, source_frame long"
    known = spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)
    return wanted.join(known, ["episode", "side"], "left").withColumn("source_frame", F.coalesce("source_frame", F.lit(-1).cast("long")))


def save_result(values: DataFrame, keys: list[str], path: str) -> None:
    """A solver's result in long form (keys, joint, frame, q, low, high, ..), one partition for each recording, in place of that recording's results before."""
    published(values, keys, path)


def install_masks(masks: DataFrame, keys: list[str], expected: DataFrame, path: str, backup: str) -> None:
    """Put the masks of segments (keys) in place of those there, as partitions; each must be as many as expected (keys, n).

    Masks are settled and audited before anything is written, so they may be made from what they replace. What was there is kept under `backup`,
    once: later installations do not touch it. A run that fails can be repeated at any step: the backup is written first, whole partitions
    at a time, and the masks are moved into place last.
    """
    spark = masks.sparkSession
    held = settled(masks)
    counts = held.groupBy(*keys).agg(F.count("*").alias("__fw_n"))
    wrong = expected.select(*keys, "n").join(counts, keys, "full_outer").filter(~F.col("n").eqNullSafe(F.col("__fw_n"))).limit(1).collect()
    if wrong:
        raise ValueError(f"expected {wrong[0]['n']} masks, got {wrong[0]['__fw_n']}: {[wrong[0][k] for k in keys]}")
    jvm = spark.sparkContext._jvm
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(p))
    if there(path):
        old = spark.read.parquet(path).join(counts.select(*keys), keys, "left_semi")
        if there(backup):
            old = old.join(spark.read.parquet(backup).select(*keys).distinct(), keys, "left_anti")
        published(settled(old), keys, backup)
    published(held, keys, path)


def slice_recording(tables: dict[str, DataFrame], order: str, total: int, start: int, stop: int) -> dict[str, DataFrame]:
    """Tables with a frame column cut to [start, stop) and numbered from 0; the others as they are. The interval must lie inside the recording."""
    if not 0 <= start < stop <= total:
        raise ValueError(f"no such slice of {total} frames: {start} to {stop}")
    cut = lambda df: df.filter((F.col(order) >= start) & (F.col(order) < stop)).withColumn(order, F.col(order) - start)
    return {name: cut(df) if order in df.columns else df for name, df in tables.items()}


def mattes(frames: DataFrame, alpha: DataFrame, colour: DataFrame, keys: list[str]) -> DataFrame | None:
    """frames with both layers of soft mattes; None if a layer is absent, and an error if a layer lacks frames."""
    from framewright.operators.geometry import aligned

    if not alpha.limit(1).count() or not colour.limit(1).count():
        return None
    return aligned(aligned(frames, alpha, keys), colour, keys)


def prompt_status(frames: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """frames and `status`: prompted where there is a prompt, else propagated."""
    marked = prompts.select(*keys).distinct().withColumn("__fw_p", F.lit(True))
    return frames.join(marked, keys, "left").withColumn("status", F.when(F.col("__fw_p"), "prompted").otherwise("propagated")).drop("__fw_p")


def three_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, low, mid, high) of a value: its least, its median and its greatest."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.expr(f"percentile(`{value}`, 0.5)").alias("mid"), F.max(value).alias("high"))


def gate_summary(rows: DataFrame, keys: list[str], order: str, human: Column, robot: Column, permitted: Column, inpainted: Column) -> DataFrame:
    """(keys, robot_visible, composited, human_only, robot_only, inpainted) of gated frames; the lists name frames in order, and are bounded by a recording's length."""
    only = lambda a, b: F.array_join(F.sort_array(F.collect_list(F.when(a & ~b, F.col(order)))), ",")
    return rows.groupBy(*keys).agg(
        F.count_if(robot).alias("robot_visible"), F.count_if(permitted).alias("composited"), only(human, robot).alias("human_only"), only(robot, human).alias("robot_only"), F.bool_or(inpainted).alias("inpainted")
    )


# --- one suite


def trajectory_rules(df: DataFrame, keys: list[str], order: str, joints: str, expected: int, low: Column, high: Column, position: str, orientation: str) -> DataFrame:
    """(keys, ord, message): the rules of trajectory_errors over one row for each frame (joints as an array), with the frames' own: 0 .. n - 1, each once.

    All rules come out of one aggregation over one scan.
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    c = F.col
    held = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct(order).alias("different"), F.min(order).alias("first"), F.max(order).alias("last"),
        F.bool_or(F.coalesce(F.size(joints) != expected, F.lit(True))).alias("short"), F.bool_or(F.exists(joints, bad)).alias("odd"),
        F.bool_or(F.exists(joints, lambda q: (q < low - 1e-5) | (q > high + 1e-5))).alias("out"),
        F.bool_or(bad(c(position)) | bad(c(orientation)) | (c(position) < 0) | (c(orientation) < 0)).alias("residual"), F.max(position).alias("position"), F.max(orientation).alias("orientation"),
    )
    return unfolded(
        held, keys,
        [
            (1, (c("n") != c("different")) | (c("first") != 0) | (c("last") != c("n") - 1), "frames are not contiguous"), (2, c("short"), "a joint has other frames than the run"),
            (3, c("odd"), "a joint value is not finite"), (4, c("out"), "a joint leaves its limits"), (5, c("residual"), "a residual is not finite or negative"),
            (6, c("position") > 0.01, "a position residual is over 0.01"), (7, c("orientation") > 5, "an orientation residual is over 5 degrees"),
        ],
    )


def mask_rules(cells: DataFrame, keys: list[str], frame: str, width: int, height: int, least: int, ratio: float) -> DataFrame:
    """(keys, ord, message): how many masks (cells: keys, frame, x, y; null for a frame without cells) are small, touch the border, or jump in area."""
    from framewright.operators.smoothing import area_jumps

    edge = F.col("x").isin(0, width - 1) | F.col("y").isin(0, height - 1)
    per = cells.groupBy(*keys, frame).agg(F.countDistinct(F.when(F.col("x").isNotNull(), F.struct("x", "y"))).alias("area"), F.coalesce(F.bool_or(edge), F.lit(False)).alias("border"))
    marked = area_jumps(per, keys, frame, "area", ratio)
    held = marked.groupBy(*keys).agg(F.count_if(F.col("area") < least).alias("small"), F.count_if("border").alias("border"), F.count_if("jump").alias("jumps"))
    said = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    rules: list[tuple[int, Column, Column | str]] = [(1, F.col("small") > 0, said("small", " small masks")), (2, F.col("border") > 0, said("border", " masks at the border")), (3, F.col("jumps") > 0, said("jumps", " jumps of area"))]
    return unfolded(held, keys, rules)


def hash_rules(files: DataFrame, keys: list[str], path: str, content: str, sha256: str) -> DataFrame:
    """(keys, ord, message) of files whose content is not what was recorded, or of which nothing was recorded."""
    own, known = F.sha2(content, 256), F.col(sha256)
    return unfolded(files, keys, [(1, known.isNull(), F.concat(F.lit("no hash recorded for "), F.col(path))), (2, own != known, F.concat(F.lit("content changed: "), F.col(path)))])


def suite(parts: dict[str, DataFrame], key: str = "episode") -> DataFrame:
    """(kind, run, ord, message) of all checks of a batch, each a table (key, ord, message) that reads its own table once."""
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("run"), "ord", "message")
        out = one if out is None else out.unionByName(one)
    return out


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """A suite's rows, and its figures (n, runs at least, worst) that are known once any action has run on them: no second pass."""
    figures = Observation(name)
    return rows.observe(figures, F.count("*").alias("n"), F.count_if(F.col("kind") == "run").alias("run_rules"), F.max("ord").alias("highest")), figures
