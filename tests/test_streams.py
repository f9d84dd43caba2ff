"""Streams against their batch forms, with stops and restarts."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import intervals as I
from framewright.operators import smoothing as S
from framewright.streaming import continuity, live


def run(stream, path, name):
    query = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-c").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120) or query.stop() is None
    return query


def test_carried_state_survives_chunks_and_restarts(spark, tmp_path):
    for key, value in continuity.STORE.items():
        spark.conf.set(key, value)
    rng = np.random.default_rng(5)
    schema, rows = "episode long, side string, frame long, joints array<double>", []
    for episode in (1, 2):
        for side in ("left", "right"):
            walk = np.cumsum(rng.normal(0, 1.2, (90, 3)), axis=0)
            raw = (walk + math.pi) % (2 * math.pi) - math.pi
            rows += [(episode, side, f, raw[f].tolist()) for f in range(90) if not (episode == 2 and 40 <= f < 44)]
    whole = spark.createDataFrame(rows, schema)
    for k, (a, b) in enumerate(((0, 20), (15, 50), (50, 51), (51, 90))):  # one query run for each chunk; the second one repeats five frames
        whole.filter(f"frame >= {a} and frame < {b}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run(continuity.carried_live(stream), tmp_path, "out")
    got = {(r["episode"], r["side"], r["frame"]): (r["joints"], r["follows"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(rows) == spark.read.parquet(str(tmp_path / "out")).count()
    each = whole.select("episode", "side", "frame", F.posexplode("joints").alias("joint", "angle"))
    batch = S.unwrap(each, ["episode", "side", "joint"], "frame", "angle", "turned").collect()
    assert len(batch) == 3 * len(rows)
    for r in batch:
        joints, follows = got[r["episode"], r["side"], r["frame"]]
        assert abs(joints[r["joint"]] - r["turned"]) < 1e-9
        assert follows == (r["frame"] > 0 and not (r["episode"] == 2 and r["frame"] == 44))


def test_sessions_equal_bridged_intervals_and_count_late_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    start, gap = dt.datetime(2024, 1, 1), 3
    rows = [(e, f, start + dt.timedelta(seconds=f), bool(rng.random() < 0.25)) for e in (1, 2) for f in range(200)]
    schema = "episode long, frame long, at timestamp, seen boolean"
    end = [(0, 0, start + dt.timedelta(days=1), True), (0, 0, start + dt.timedelta(days=2), True)]  # moves the watermark on
    late = [(1, 10, start + dt.timedelta(seconds=10), True), (2, 11, start + dt.timedelta(seconds=11), True), (2, 12, start + dt.timedelta(seconds=12), False)]
    for k, part in enumerate((rows[:100] + rows[200:300], rows[100:200] + rows[300:], end[:1], end[1:], late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = run(live.visible_sessions(stream, "at", ["episode"], F.col("seen"), f"{gap + 1} seconds 500 milliseconds", "5 seconds"), tmp_path, "sessions")
    assert live.dropped(query) == 2  # the one that is not seen needs no place
    got = {(r["episode"], r["start"].replace(tzinfo=None), r["stop"].replace(tzinfo=None)) for r in spark.read.parquet(str(tmp_path / "sessions")).filter("episode > 0").collect()}
    batch = I.bridge_gaps(spark.createDataFrame(rows, schema), ["episode"], "frame", "seen", gap)
    runs = I.runs(batch, ["episode"], "frame", "seen").filter("seen").collect()
    want = {(r["episode"], start + dt.timedelta(seconds=r["start"]), start + dt.timedelta(seconds=r["stop"] - 1)) for r in runs}
    assert got == want and len(want) > 20
