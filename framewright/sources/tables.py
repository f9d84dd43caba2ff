"""Sources: recordings as tables keyed by episode and frame.

The engine works on long tables. The readers below map the tables at hand to
those roles (see README); the file readers take the layouts that recordings
come in: Parquet pose tables, JSON sessions, frame images, text locks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SESSION = """
camera_calibration struct<focal_length: array<double>, principal_point: array<double>, sensor_resolution: array<double>, current_resolution: array<double>>,
projection_defaults struct<fx: double, fy: double, cx: double, cy: double>, video_resolution struct<width: double, height: double>
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, frame, event_id, event_type, signal, props): events as one signal per episode, by position in time."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"), place.cast("long").alias("frame"), "event_id", "event_type", F.col("value").alias("signal"), "props"
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, frame, points): 21 points of 3 coordinates, from the first 63 numbers of each vector."""
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, 3), lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode"), F.col("vec_id").alias("frame"), points.alias("points"))


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, frame, q): four numbers of each vector, frames by position."""
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("episode"), place.cast("long").alias("frame"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("q")
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, frame, cells): each turn's distinct words as the cells of a mask."""
    words = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("frame"), words.alias("cells"))


def read_pose_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns of a pose table and its frame number; order is a column, never a file's order."""
    return spark.read.parquet(path).select("camera_frame_index", *columns)


def slice_rows(df: DataFrame, keys: list[str], order: str, start: int, stop: int) -> DataFrame:
    """Rows whose position (not value) in the order lies in [start, stop); a recording without such rows raises."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    n = F.count("*").over(W.partitionBy(*keys))
    inside = (F.col("__fw_place") >= start) & (F.col("__fw_place") < stop)
    kept = F.when(F.col("__fw_rows") <= start, F.raise_error(F.lit("the slice is empty")).cast("boolean")).otherwise(inside)
    return df.withColumn("__fw_place", place).withColumn("__fw_rows", n).filter(kept).drop("__fw_place", "__fw_rows")


def read_session(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION).json(path, multiLine=True)


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(frame, content, length, path, modificationTime) of numbered images; one that is no whole PNG or JPEG raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    head = lambda n: F.hex(F.substring("content", 1, n))
    tail = lambda n: F.hex(F.substring("content", -n, n))
    png = (head(8) == "89504E470D0A1A0A") & (F.substring(tail(8), 1, 8) == "49454E44")
    jpeg = (head(3) == "FFD8FF") & (tail(2) == "FFD9")
    content = F.when(png | jpeg, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.col("path"))).cast("binary"))
    return files.select(F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).cast("long").alias("frame"), content.alias("content"), "length", "path", "modificationTime")


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows by the footers alone: no column is read."""
    return spark.read.parquet(path).count()


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    """(name, version) of pinned `name==version` lines; a line of another form raises."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).filter("line <> ''")
    ok = F.col("line").rlike(r"^[A-Za-z0-9._-]+==[^=\s]+$")
    part = lambda i: F.when(ok, F.element_at(F.split("line", "=="), i)).otherwise(F.raise_error(F.concat(F.lit("not pinned: "), F.col("line"))))
    return lines.select(F.lower(part(1)).alias("name"), part(2).alias("version"))
