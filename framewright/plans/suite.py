"""One verification suite over a batch: every table is read once (runs twice, also for their chunks), and all rules of a row come out together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import verification as C
from framewright.plans.runs import CELLS, CHUNKS, _cells, _chunks, _episodes
from framewright.sources.tables import table


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs with their facts, lines as chunks with theirs."""
    k, host = F.col("o_custkey"), F.col("host")
    final = F.struct(F.lit(9).cast("long").alias("bytes"), F.col("frames").alias("n"))
    episodes = _episodes(spark, sf_dir).select(
        "episode", "frames", (k % 11 != 0).alias("known"), F.when(k % 13 != 0, F.col("frames") + (k % 7 == 0).cast("long")).alias("total_frames"), (k % 17 == 0).cast("long").alias("skipped"),
        F.when(k % 4 == 0, "old").otherwise("direct").alias("backend"), (k % 5 != 0).alias("traced"), F.when(k % 3 != 0, F.create_map(F.lit("full.mp4"), final)).alias("finals"),
    )
    chunks = _chunks(spark, sf_dir).select(
        "episode", C.segment_name(F.col("index"), F.col("mode"), F.col("start"), F.col("stop")).alias("name"), F.col("n").alias("length"), (host % 12 != 0).alias("provenance"),
        F.when(host % 9 != 0, F.when(host % 8 == 0, 0).otherwise(100)).alias("bytes"), F.when((host % 9 != 0) & (host % 6 != 0), F.col("n") - (host % 5 == 0).cast("long")).alias("n"),
        F.when(host % 7 != 0, F.col("n") + (host % 11 == 0).cast("long")).alias("masks"),
    )
    return C.run_errors(episodes, chunks, ["full.mp4"], "direct")


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode"), (place + (F.col("label") == 4).cast("int")).cast("long").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = rows.select("episode", "frame", F.slice("e", 1, F.when((F.col("episode") == 3) & (F.col("frame") == 0), 4).otherwise(5)).alias("q"), (F.abs(F.col("e")[6]) / 40 - (F.col("episode") == 5).cast("int")).alias("position"), (F.abs(F.col("e")[7]) * 13).alias("orientation"))
    return C.trajectory_rules(rows, ["episode"], "frame", "q", 5, F.lit(-0.45), F.lit(0.45), "position", "orientation")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as artifacts: one in 17 has no recorded hash, one in 19 another one than its content's."""
    p = F.col("page_id")
    recorded = F.when(p % 17 != 0, F.sha2(F.concat("content", F.when(p % 19 == 0, "x").otherwise("")), 256))
    rows = table(spark, sf_dir, "pages").select(p, F.coalesce("html", F.lit("")).alias("content")).select((p % 40).alias("episode"), F.concat(F.lit("page-"), p.cast("string")).alias("path"), "content", recorded.alias("sha256"))
    return C.hash_rules(rows, ["episode"], "path", "content", "sha256")


def run_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, videos and masks of runs, trajectories with their residuals, mask areas, and hashes of artifacts."""
    masks = C.mask_rules(_cells(spark, sf_dir), ["episode"], "frame", 40, 12, 10, 1.8)
    return C.suite({"run": _runs(spark, sf_dir), "trajectory": _trajectories(spark, sf_dir), "masks": masks, "files": _files(spark, sf_dir)})


SUITE_SQL = f"""WITH {CHUNKS.replace("chunks AS (", "chunks AS MATERIALIZED (")}, eps AS (SELECT o_orderkey AS episode, CAST(floor(o_totalprice / 1000) AS BIGINT) AS frames, o_custkey AS k FROM orders),
there AS (SELECT *, CASE WHEN k % 13 <> 0 THEN frames + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END END AS total FROM eps WHERE k % 11 <> 0), named AS (SELECT c.* FROM chunks c JOIN there t ON c.episode = t.episode),
clips AS (
    SELECT episode, name, n AS frames, host % 9 = 0 OR host % 8 = 0 AS missing, CASE WHEN host % 6 <> 0 THEN n - CASE WHEN host % 5 = 0 THEN 1 ELSE 0 END END AS got, 8 AS ord FROM named
    UNION ALL SELECT episode, 'full.mp4', frames, k % 3 = 0, frames, 10 FROM there
), counts AS (SELECT *, CASE WHEN host % 7 = 0 THEN 0 ELSE n + CASE WHEN host % 11 = 0 THEN 1 ELSE 0 END END AS m FROM named),
runs AS (
    SELECT episode, 1 AS ord, 'missing metadata' AS message FROM eps WHERE k % 11 = 0
    UNION ALL SELECT episode, 2, 'invalid metadata' FROM there WHERE total IS NULL
    UNION ALL SELECT episode, 3, 'total_frames does not match the manifest' FROM there WHERE total <> frames
    UNION ALL SELECT episode, 4, '1 skipped segments remain' FROM there WHERE k % 17 = 0
    UNION ALL SELECT episode, 5, 'missing pipeline provenance' FROM there WHERE k % 5 = 0
    UNION ALL SELECT episode, 6, 'mask backend mismatch: expected direct, got old' FROM there WHERE k % 5 <> 0 AND k % 4 = 0
    UNION ALL SELECT episode, 7, 'missing provenance for ' || name FROM named WHERE host % 12 = 0
    UNION ALL SELECT episode, ord, CASE WHEN missing THEN 'missing video: ' || name WHEN got IS NULL THEN 'unreadable video ' || name ELSE 'frame mismatch ' || name || ': expected ' || frames || ', got ' || got END FROM clips WHERE missing OR got IS NULL OR got <> frames
    UNION ALL SELECT episode, 9, 'mask count mismatch ' || name || ': expected ' || n || ', got ' || m FROM counts WHERE m <> n
), moves AS (SELECT CAST(label AS BIGINT) AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
rest AS (
    SELECT episode, max(abs(e[7]) / 40 - CASE WHEN episode = 5 THEN 1 ELSE 0 END) AS p, min(abs(e[7]) / 40 - CASE WHEN episode = 5 THEN 1 ELSE 0 END) AS least, max(abs(e[8]) * 13) AS o,
        bool_or(len(list_filter(e[1:CASE WHEN episode = 3 AND frame = 0 THEN 4 ELSE 5 END], lambda q: abs(q) > 0.45001)) > 0) AS off FROM moves GROUP BY 1
), paths AS (
    SELECT episode, 1 AS ord, 'frames are not contiguous' AS message FROM rest WHERE episode = 4 UNION ALL SELECT episode, 2, 'a joint has other frames than the run' FROM rest WHERE episode = 3
    UNION ALL SELECT episode, 4, 'a joint leaves its limits' FROM rest WHERE off UNION ALL SELECT episode, 5, 'a residual is not finite or negative' FROM rest WHERE least < 0
    UNION ALL SELECT episode, 6, 'a position residual is over 0.01' FROM rest WHERE p > 0.01 UNION ALL SELECT episode, 7, 'an orientation residual is over 5 degrees' FROM rest WHERE o > 5
), {CELLS}, sized AS (SELECT episode, frame, count(DISTINCT (x, y)) AS area, bool_or(x IN (0, 39) OR y IN (0, 11)) AS border FROM cells GROUP BY 1, 2),
steps AS (SELECT *, lag(area) OVER (PARTITION BY episode ORDER BY frame) AS was FROM sized),
shares AS (SELECT episode, count(*) FILTER (area < 10) AS small, count(*) FILTER (border) AS border, count(*) FILTER (greatest(area, was) / CAST(greatest(least(area, was), 1) AS DOUBLE) > 1.8 AND was IS NOT NULL) AS jumps FROM steps GROUP BY 1),
shapes AS (
    SELECT episode, 1 AS ord, small || ' small masks' AS message FROM shares WHERE small > 0 UNION ALL SELECT episode, 2, border || ' masks at the border' FROM shares WHERE border > 0
    UNION ALL SELECT episode, 3, jumps || ' jumps of area' FROM shares WHERE jumps > 0
), files AS (
    SELECT page_id % 40 AS episode, 1 AS ord, 'no hash recorded for page-' || page_id AS message FROM pages WHERE page_id % 17 = 0
    UNION ALL SELECT page_id % 40, 2, 'content changed: page-' || page_id FROM pages WHERE page_id % 17 <> 0 AND page_id % 19 = 0
)
SELECT 'run' AS kind, CAST(episode AS VARCHAR) AS run, ord, message FROM runs UNION ALL SELECT 'trajectory', CAST(episode AS VARCHAR), ord, message FROM paths
UNION ALL SELECT 'masks', CAST(episode AS VARCHAR), ord, message FROM shapes UNION ALL SELECT 'files', CAST(episode AS VARCHAR), ord, message FROM files"""

QUERIES = {"run_suite": (run_suite, SUITE_SQL)}
