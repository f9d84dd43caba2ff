"""Shared plumbing of the training-data operators.

Every operator reads only the columns it needs, works on whole texts and turns
Arrow batches into NumPy work in slices of bounded size, so that a task's
memory follows the slice and the longest single text, never the partition.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy slice holds (a longer single text makes a slice of its own).
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def shared_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the cluster's shared folder; one machine without that setting (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix=f"checkpoints-{os.getpid()}-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: later passes neither recompute it nor depend on an executor."""
    shared_checkpoints(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _open and (path := out._jdf.queryExecution().logical().rdd().getCheckpointFile()).isDefined():
        _open[-1].append(path.get())
    return out


_open: list[list[str]] = []


@contextmanager
def temporary_cuts(spark: SparkSession) -> Iterator[None]:
    """What is materialised by cut inside is removed in the end, also after a failure: write the result before that."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


#: Hash ranges by which bounded_sample finds its limit.
RANGES = 4096


def bounded_sample(df: DataFrame, most_rows: int, most_bytes: int, by: list[str], size: Column | None = None, seed: int = 7) -> DataFrame:
    """Rows with the smallest hashes of the columns `by`, as many as both bounds allow, rows that repeat them once.

    The rows do not depend on partitioning. One pass counts rows and bytes; the
    rows under a first guess are then counted by hash range (RANGES numbers reach
    the driver), and whole ranges are kept while both sums stay within the bounds
    (the first one always).
    """
    mixed, size = F.xxhash64(F.lit(seed), *by), F.lit(0) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    all_of = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    share = 1.3 * min(most_rows / max(1, all_of["n"]), most_bytes / max(1, all_of["bytes"])) + 16.0 / max(1, all_of["n"])
    low, span = -(2**63), 2**64 if share >= 1 else int(share * 2**64)
    width = max(1, span // RANGES)
    top = low + width * RANGES - 1
    near = df if share >= 1 else df.filter(mixed <= top)
    spot = F.least(F.floor((mixed.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")), F.lit(RANGES - 1))
    once = near.groupBy(mixed.alias("h"), spot.cast("int").alias("spot")).agg(F.max(size).alias("size"))
    kept, rows, held = 0, 0, 0
    ranges = {r["spot"]: r for r in once.groupBy("spot").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    for spot_no in range(RANGES):
        if spot_no in ranges:
            rows, held = rows + ranges[spot_no]["n"], held + ranges[spot_no]["size"]
            if (rows > most_rows or held > most_bytes) and kept:
                break
        kept = spot_no + 1
    limit = 2**63 - 1 if kept == RANGES and share >= 1 else low + width * kept - 1
    hashed = df.withColumn("__sampled", mixed)
    return (hashed if limit == 2**63 - 1 else hashed.filter(F.col("__sampled") <= limit)).dropDuplicates(["__sampled"]).drop("__sampled")


#: Shares into which the rows of a hot key are dealt.
SALTS = 32


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


#: Rows and bytes of facts up to which they are broadcast once counted.
FEW_FACTS, FEW_BYTES = 100_000, 16 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and arrays by their lengths, other values as 16."""
    parts = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        parts.append(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 32 if kind == "array" else F.lit(0))
    return sum((F.coalesce(p, F.lit(0)).cast("long") for p in parts), F.lit(16 * len(parts)).cast("long"))


def with_facts(rows: DataFrame, facts: DataFrame, key: str, by: list[str], how: str = "inner", few: int = FEW_FACTS) -> DataFrame:
    """rows joined with facts (short rows, a bounded number for each key) such that no key's rows meet in one task.

    Facts that have been counted to be few, in rows and bytes, are broadcast. Beyond that the distinct (key, salt)
    pairs, at most SALTS for each key, fetch the facts, and rows join those pairs; rows is then read twice: pass a cut or cheap one.
    """
    facts = cut(facts)
    counted = facts.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(facts)), F.lit(0)).alias("bytes")).first()
    if counted["n"] <= few and counted["bytes"] <= FEW_BYTES:
        return rows.join(F.broadcast(facts), key, how)
    salted = rows.withColumn("__salt", salt(*by))
    pairs = salted.select(key, "__salt").distinct()
    return salted.join(pairs.join(facts, key, how), [key, "__salt"]).drop("__salt")


def bounded_broadcast(df: DataFrame, most_rows: int = 400_000) -> DataFrame:
    """df (short rows, materialised), broadcast if it has been counted to be small; joined by shuffles beyond that."""
    return F.broadcast(df) if df.count() <= most_rows else df


def split_flag(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    return (id_crc(column) % modulus) == remainder


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at the end of a task what it has freed goes back to the system, since worker processes outlive their tasks."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


class Texts:
    """The texts of an Arrow string column as one byte buffer; null counts as empty."""

    def __init__(self, column: pa.Array):
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        filled = pc.fill_null(column, "").cast(pa.large_binary())
        n = len(filled)
        _, offsets, data = filled.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + n + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def slices(self, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, bytes, offsets from 0): runs of whole texts of about `limit` bytes."""
        lo, n, off = 0, len(self), self.offsets
        while lo < n:
            hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield lo, hi, self.data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def batch_of(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
