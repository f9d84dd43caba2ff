"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by the leading bits of each row's hash. A bucket is the
shallowest prefix whose rows fit the byte limit; only oversized buckets are
split on another bit. The bucket sizes of all prefixes come from one histogram
at a depth chosen from the total size, summed upward; prefixes that still
overflow there are dealt again by more bits, and only their rows.

The hash covers the key, the text's digest and the number of the copy, so rows
that share a key, or repeat wholly, spread like any others and no key is hot.
A row larger than the limit gets a bucket of its own; rows that agree in all 60
bits stay together, whatever their size. Only text bytes count against the limit.

Defined results: null texts have no bytes; a null key counts as the empty text;
repeated rows are numbered from 1 in `copy`; empty input gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.common import cut

SHARD_BYTES = 1 << 20
HASH_BITS = 60
#: Bits of the histogram beyond those that even shards would need, and most bits at a time.
SPARE_BITS, MOST_BITS = 4, 24


def hashed(key: Column, digest: Column, copy: Column) -> Column:
    """60 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), digest, copy.cast("string"))), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    shift = F.lit(HASH_BITS) - depth
    return F.expr("shiftright(h, {})".format(HASH_BITS - depth)) if isinstance(depth, int) else F.call_function("shiftright", h, shift.cast("int"))


def split_buckets(rows: DataFrame, limit: int, above: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The directory (bits, bucket_depth, bucket_bytes, bucket_rows) of rows (h, n_bytes) at `depth` bits, and the bits that still overflow.

    Depths before `above` are known to overflow. A prefix is a bucket if it fits
    and the one before it, a bit shorter, does not; its entries of the directory follow.
    """
    histogram = rows.groupBy(prefix(F.col("h"), depth).alias("bits")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    ways = histogram.select("bytes", "n", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("d"), "bits").select(
        "d", F.call_function("shiftright", F.col("bits"), (F.lit(depth) - F.col("d")).cast("int")).alias("node"), "bytes", "n"
    )
    fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
    nodes = cut(ways.groupBy("d", "node").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    split = nodes.filter(~fits).select((F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    below = nodes.filter(fits & (F.col("d") > above)).withColumn("parent", F.shiftright("node", 1)).join(split, ["d", "parent"], "left_semi")
    buckets = nodes.filter(fits & (F.col("d") == above)).unionByName(below.drop("parent"))
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("d")).cast("int"))
    entries = F.explode(F.sequence(F.col("node") * wide, (F.col("node") + 1) * wide - 1)).alias("bits")
    directory = buckets.select(entries, F.col("d").alias("bucket_depth"), F.col("bytes").alias("bucket_bytes"), F.col("n").alias("bucket_rows"))
    return directory, nodes.filter(~fits & (F.col("d") == depth)).select(F.col("node").alias("bits"), "bytes", "n")


#: Copies of one row that a task numbers; more are dealt to several tasks.
COPIES_A_TASK = 1 << 16


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(key, digest, copy, n_bytes, shard, depth, shard_bytes, shard_rows): one row for each row of df; shard is the bucket's prefix in bits.

    Copies are numbered among the rows of one key and text (digest).
    """
    rows = df.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text_digest(text))
    copies = cut(rows.groupBy(key, "n_bytes", "digest").agg(F.count("*").alias("copies")))
    runs = copies.select(key, "n_bytes", "digest", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_A_TASK).cast("long"))).alias("before"))
    if copies.filter(F.col("copies") > COPIES_A_TASK).limit(1).count():
        runs = runs.repartition("digest", "before")
    number = F.explode(F.sequence(F.col("before") + 1, F.least(F.col("copies"), F.col("before") + COPIES_A_TASK)))
    keyed = runs.select(key, "n_bytes", "digest", number.alias("copy"))
    rest = cut(keyed.select(key, "digest", "copy", "n_bytes", hashed(F.col(key), F.col("digest"), F.col("copy")).alias("h")))
    total = rest.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    above, depth, out = 0, min(MOST_BITS, (total // limit).bit_length() + SPARE_BITS), None
    while True:
        directory, overflow = split_buckets(rest, limit, above, depth)
        over = depth < HASH_BITS and overflow.limit(1).count()
        if not over and depth == HASH_BITS:  # rows that agree in all bits stay together
            directory = directory.unionByName(overflow.select("bits", F.lit(depth).alias("bucket_depth"), F.col("bytes").alias("bucket_bytes"), F.col("n").alias("bucket_rows")))
        dealt = rest.withColumn("bits", prefix(F.col("h"), depth))
        found = dealt.join(directory, "bits").select(
            key, "digest", "copy", "n_bytes", F.col("bucket_depth").cast("int").alias("depth"), F.col("bucket_bytes").alias("shard_bytes"), F.col("bucket_rows").alias("shard_rows"), "h"
        )
        out = found if out is None else out.unionByName(found)
        if not over:
            break
        rest = cut(dealt.join(overflow, "bits", "left_semi").drop("bits"))
        above, depth = depth + 1, min(HASH_BITS, depth + MOST_BITS // 2)
    bits = F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - F.col("depth")).cast("int"))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(bits), F.col("depth"), F.lit("0")))
    return out.select(key, "digest", "copy", "n_bytes", name.alias("shard"), "depth", "shard_bytes", "shard_rows")


def text_digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest")


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Write the rows of df, all columns as they are, into a folder for each shard (`shard=s` and the bits), and return the assignment.

    Rows take the numbers of their copies by counting in their partition and adding the counts of the partitions before; the
    texts are written once to the checkpoint folder and shuffled to the shards.
    """
    assigned = cut(shard(df, key, text, limit))
    own = ["__key", "__digest"]
    rows = df.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\0"))).withColumn("__digest", text_digest(text))
    rows = cut(rows.withColumn("__part", F.spark_partition_id()))  # read twice below: a row must stay in its partition
    counts = rows.groupBy(*own, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*own).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = cut(counts.select(*own, "__part", before.alias("__before")))
    place = F.row_number().over(W.partitionBy(*own, "__part").orderBy(F.lit(0)))
    numbered = rows.withColumn("__place", place).join(first, [*own, "__part"]).withColumn("__copy", F.col("__place") + F.col("__before"))
    where = assigned.select(F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("__key"), F.col("digest").alias("__digest"), F.col("copy").alias("__copy"), F.concat(F.lit("s"), F.col("shard")).alias("__shard"))
    placed = numbered.join(where, [*own, "__copy"]).select(*[F.col(f"`{c}`") for c in df.columns], F.col("__shard"))
    placed.repartition("__shard").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(folder)
    return assigned
