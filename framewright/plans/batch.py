"""Queries over manifests, validation, scheduling and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import batch as B
from framewright.sources.tables import table


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings and their lines as chunks: (episode, status, width, n_chunks, frames, bytes)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count("*").alias("n_chunks"), F.sum("l_quantity").cast("long").alias("frames"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), "o_orderstatus", "o_orderpriority", "o_custkey", F.col("o_totalprice").alias("bytes"))
    return orders.join(lines, "episode", "left")


EPISODES = """lines AS (SELECT l_orderkey AS episode, count(*) AS n_chunks, CAST(sum(l_quantity) AS BIGINT) AS frames FROM lineitem GROUP BY 1),
episodes AS (SELECT o_orderkey AS episode, o_orderstatus, o_orderpriority, o_custkey, o_totalprice AS bytes, n_chunks, frames FROM orders LEFT JOIN lines ON o_orderkey = episode)"""


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes(spark, sf_dir).withColumn("width", F.when(F.col("o_custkey") % 2 == 0, 960).otherwise(640))
    out = B.manifest_summary(rows, ["o_orderpriority"], F.col("width"), F.lit(480))
    return out.withColumn("bytes", F.round("bytes", 2))


MANIFEST_SQL = f"""WITH {EPISODES}
SELECT o_orderpriority, count(*) AS episodes, CAST(sum(coalesce(frames, 0)) AS BIGINT) AS frames, round(sum(bytes), 2) AS bytes,
    CAST(sum(coalesce(frames, 0) * CASE WHEN o_custkey % 2 = 0 THEN 2800000 ELSE 1100000 END) AS BIGINT) AS scratch, CAST(sum(coalesce(n_chunks, 0)) AS BIGINT) AS chunks FROM episodes GROUP BY 1"""


def episode_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = B.selected(spark, "7, 3-40,12 ,100-180,9999999")
    return chosen.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), "o_orderpriority"), "episode")


SELECTOR_SQL = """SELECT o_orderkey AS episode, o_orderpriority FROM orders WHERE o_orderkey = 7 OR o_orderkey BETWEEN 3 AND 40 OR o_orderkey = 12 OR o_orderkey BETWEEN 100 AND 180 OR o_orderkey = 9999999"""


def numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of names that are numbers or not, inside a region: numbers first, by value."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal").cast("string")).otherwise(F.col("s_name")).alias("name"), "s_suppkey")
    place = F.row_number().over(W.partitionBy("s_nationkey").orderBy(*B.numeric_order("name"), "s_suppkey"))
    return rows.select("s_suppkey", "name", place.cast("long").alias("place"))


ORDER_SQL = """WITH rows AS (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) ELSE s_name END AS name, s_suppkey FROM supplier)
SELECT s_suppkey, name, row_number() OVER (PARTITION BY s_nationkey ORDER BY try_cast(name AS BIGINT) IS NULL, try_cast(name AS BIGINT), name, s_suppkey) AS place FROM rows"""


def greedy_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a recording on 3 lanes, longest first."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").cast("long").alias("frames"))
    order = [F.desc("frames"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_extendedprice")]
    out = B.assign_lanes(lines, ["episode"], "frames", order, 3)
    return out.groupBy("episode", "lane").agg(F.sum("frames").alias("load"), F.count("*").alias("n"))


LANES_SQL = """WITH RECURSIVE jobs AS (
    SELECT l_orderkey AS episode, CAST(l_quantity AS BIGINT) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS place FROM lineitem
), fold AS (
    SELECT episode, CAST(0 AS BIGINT) AS place, [CAST(0 AS BIGINT), 0, 0] AS loads, [CAST(0 AS BIGINT), 0, 0] AS counts FROM (SELECT DISTINCT episode FROM jobs)
    UNION ALL
    SELECT f.episode, j.place, list_transform(range(1, 4), lambda i: f.loads[i] + CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN j.c ELSE 0 END),
        list_transform(range(1, 4), lambda i: f.counts[i] + CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN 1 ELSE 0 END)
    FROM fold f JOIN jobs j ON f.episode = j.episode AND j.place = f.place + 1
), ends AS (SELECT f.* FROM fold f JOIN (SELECT episode, max(place) AS place FROM fold GROUP BY 1) m ON f.episode = m.episode AND f.place = m.place),
lanes AS (SELECT episode, CAST(unnest(range(3)) AS INTEGER) AS lane, unnest(loads) AS load, unnest(counts) AS n FROM ends)
SELECT episode, lane, load, n FROM lanes WHERE n > 0"""


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks and frames each of 4 workers gets, by chunk number modulo workers."""
    rows = table(spark, sf_dir, "lineitem").select(B.round_robin(F.col("l_linenumber") - 1, 4).alias("worker"), "l_quantity")
    return rows.groupBy("worker").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("frames"))


ROBIN_SQL = "SELECT (l_linenumber - 1) % 4 AS worker, count(*) AS n, sum(l_quantity) AS frames FROM lineitem GROUP BY 1"


def blob_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))
    return one


BLOB_SQL = "SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages"


def provenance_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of each event against the one before it of the same user: what changed or is new."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    meta = F.map_from_arrays(F.array(F.lit("k"), F.lit("type"), F.lit("large")), F.array(F.get_json_object("props", "$.k"), F.col("event_type"), (F.col("value") > 100).cast("string")))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", meta.alias("meta"))
    rows = rows.withColumn("stored", F.lag("meta").over(w))
    return B.changed_entries(rows, ["event_id"], "stored", "meta")


PROVENANCE_SQL = """WITH rows AS (
    SELECT event_id, unnest(['k', 'type', 'large']) AS name, unnest([json_extract_string(props, '$.k'), event_type, CAST(value > 100 AS VARCHAR)]) AS current, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was_
    FROM events
), fixed AS (SELECT event_id, name, current FROM rows), links AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT n.event_id, n.name, o.current AS stored, n.current FROM fixed n JOIN links l ON n.event_id = l.event_id LEFT JOIN fixed o ON o.event_id = l.was AND o.name = n.name WHERE o.current IS DISTINCT FROM n.current"""


def version_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(".", (F.col("p_partkey") % 7).cast("string"), F.concat((F.col("p_partkey") % 11).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "rc1").otherwise("")), F.when(F.col("p_partkey") % 5 == 0, "dev").otherwise("4"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(B.version_tuple(text), lambda x: x.cast("string")), ".").alias("version"))


VERSION_SQL = """SELECT p_partkey, (p_partkey % 7) || '.' || CAST((p_partkey % 11) || CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '' END AS BIGINT) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.4' END AS version FROM part"""


def integer_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("long").cast("string")).otherwise("N/A")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(B.integer_frames(stated, F.col("l_quantity") / 2, F.lit(30000), F.lit(1001))).alias("frames"))


FRAMES_SQL = """SELECT l_returnflag, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE CAST(round_even(l_quantity / 2 * 30000 / 1001, 0) AS BIGINT) END) AS BIGINT) AS frames FROM lineitem GROUP BY 1"""

QUERIES = {
    "manifest_summary": (manifest_summary, MANIFEST_SQL),
    "episode_selector": (episode_selector, SELECTOR_SQL),
    "numeric_order": (numeric_order, ORDER_SQL),
    "greedy_lanes": (greedy_lanes, LANES_SQL),
    "round_robin": (round_robin, ROBIN_SQL),
    "blob_hashes": (blob_hashes, BLOB_SQL),
    "provenance_differences": (provenance_differences, PROVENANCE_SQL),
    "version_tuples": (version_tuples, VERSION_SQL),
    "integer_frames": (integer_frames, FRAMES_SQL),
}
