"""Queries over joins by time: the last known, the nearest and the interpolated value, long intervals and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import intervals as I
from framewright.plans.runs import CHUNKS, _chunks
from framewright.sources.tables import table

KEY = ["user_id"]


def _two_rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Views as the frames of a recording, all other events of its user as a signal of another rate."""
    events = table(spark, sf_dir, "events")
    return events.filter("event_type = 'view'").select("user_id", "ts", "event_id"), events.filter("event_type <> 'view'").select("user_id", "ts", "value", F.col("event_id").alias("sample"))


RATES = """l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
lo AS (SELECT user_id, ts, max(row(value, event_id)) AS v FROM events WHERE event_type <> 'view' GROUP BY 1, 2), hi AS (SELECT user_id, ts, min(row(value, event_id)) AS v FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
"""


def asof_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sample of the signal at each frame's time or before, unless it is over six hours old."""
    left, right = _two_rates(spark, sf_dir)
    return I.as_of(left, right, KEY, "ts", ["value", "sample"], "backward", 6 * 3600.0).select("user_id", "event_id", F.round("value", 6).alias("value"), "sample")


ASOF_SQL = f"""WITH {RATES.rstrip().rstrip(",")}, met AS (SELECT l.*, lo.ts AS t, lo.v FROM l ASOF LEFT JOIN lo ON l.user_id = lo.user_id AND l.ts >= lo.ts)
SELECT user_id, event_id, round(CASE WHEN ok THEN v[1] END, 6) AS value, CASE WHEN ok THEN v[2] END AS sample FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(t) <= 21600000000, false) AS ok FROM met)"""


def nearest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample nearest to each frame's time, the one before on ties."""
    left, right = _two_rates(spark, sf_dir)
    return I.as_of(left, right, KEY, "ts", ["sample"], "nearest").select("user_id", "event_id", "sample")


_both = f"""WITH {RATES} b AS (SELECT l.*, lo.ts AS t0, lo.v AS v0 FROM l ASOF LEFT JOIN lo ON l.user_id = lo.user_id AND l.ts >= lo.ts),
m AS (SELECT b.*, hi.ts AS t1, hi.v AS v1 FROM b ASOF LEFT JOIN hi ON b.user_id = hi.user_id AND b.ts <= hi.ts)"""
NEAREST_SQL = f"""{_both} SELECT user_id, event_id, CASE WHEN t0 IS NULL OR (t1 IS NOT NULL AND epoch_us(t1) - epoch_us(ts) < epoch_us(ts) - epoch_us(t0)) THEN v1[2] ELSE v0[2] END AS sample FROM m"""


def resampled_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal at each frame's time, straight between the samples before and after."""
    left, right = _two_rates(spark, sf_dir)
    return I.resampled(left, right, KEY, "ts", "value").select("user_id", "event_id", F.round("sampled", 5).alias("sampled"))


RESAMPLED_SQL = f"""{_both}, n AS (SELECT *, epoch_us(ts) / 1e6 AS t, epoch_us(t0) / 1e6 AS a, epoch_us(t1) / 1e6 AS b FROM m)
SELECT user_id, event_id, round(coalesce(v0[1] + (v1[1] - v0[1]) * (t - a) / nullif(b - a, 0), v0[1], v1[1]), 5) AS sampled FROM n"""


def _long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as intervals of up to five million frames, and each order's customer number as three of its frames."""
    chunks = _chunks(spark, sf_dir).select("episode", "index", "mode", (F.col("start") * 5000).alias("start"), (F.col("start") * 5000 + F.col("n") * 100_000).alias("stop"))
    at = F.explode(F.array(*(F.col("o_custkey") * k % 12_000_000 for k in (7001, 11_003, 90_001)))).alias("frame")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), at), chunks


LONG = f"""{CHUNKS}, long AS (SELECT episode, i, mode, start * 5000 AS start, start * 5000 + n * 100000 AS stop FROM chunks),
due AS (SELECT o_orderkey AS episode, unnest([o_custkey * 7001 % 12000000, o_custkey * 11003 % 12000000, o_custkey * 90001 % 12000000]) AS frame FROM orders),
hits AS (SELECT d.episode, d.frame, max(row(i, start)) AS c FROM (SELECT DISTINCT * FROM due) d JOIN long l ON l.episode = d.episode AND d.frame >= l.start AND d.frame < l.stop GROUP BY 1, 2)"""


def long_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which interval covers each frame, and how far into it: intervals of millions of frames, never unrolled."""
    due, chunks = _long(spark, sf_dir)
    return I.frames_in_intervals(due, chunks, ["episode"], "frame", "index", 1 << 20).select("episode", "frame", F.col("index").cast("long").alias("chunk"), "local")


LONG_SQL = f"WITH {LONG} SELECT d.episode, d.frame, CAST(c[1] AS BIGINT) AS chunk, d.frame - c[2] AS local FROM due d LEFT JOIN hits h ON h.episode = d.episode AND h.frame = d.frame"


def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames of each recording have which label; frames that nothing covers are `source`."""
    due, chunks = _long(spark, sf_dir)
    rows = I.labelled_frames(due, chunks, ["episode"], "frame", "index", "mode", "source", 1 << 20)
    return rows.groupBy("episode", "mode").agg(F.count("*").alias("n"))


LABEL_SQL = f"""WITH {LONG} SELECT d.episode, coalesce(l.mode, 'source') AS mode, count(*) AS n FROM due d LEFT JOIN hits h ON h.episode = d.episode AND h.frame = d.frame
LEFT JOIN long l ON l.episode = h.episode AND l.i = h.c[1] GROUP BY 1, 2"""


QUERIES = {
    "asof_signal": (asof_signal, ASOF_SQL),
    "nearest_signal": (nearest_signal, NEAREST_SQL),
    "resampled_signal": (resampled_signal, RESAMPLED_SQL),
    "long_intervals": (long_intervals, LONG_SQL),
    "frame_labels": (frame_labels, LABEL_SQL),
}
