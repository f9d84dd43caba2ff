"""Codes for vectors: product quantisation by weighted Lloyd rounds over distinct integer parts.

Components become integers (floor of `scale` times the component), vectors are
cut into equal consecutive parts, and equal parts of one position are one row
with a weight. Every round assigns the distinct rows only, and adds them up
inside each task: what leaves a task, and what reaches the driver, are the
counts and sums of the codebooks' entries, `parts` x `entries` x the width of a
part. After the last round codes and errors are joined back to the vectors by
part. Distinct parts that a thousandth of all vectors or more share are at most
a thousand for each position; they are broadcast, and no key of the other join
has more rows than that share.

Parts travel as bytes, in the narrowest of 16, 32 and 64 bits that holds all
their components, so equal parts have equal bytes. Distances are exact:
floating-point products while squares stay under 2^53, whole numbers beyond.

Defined results: vectors that are null or hold null or non-finite components
give no row, nor do vectors of another length than most have (ties: the
longer); a length that `parts` does not divide is filled up with zeros;
components beyond 2^62 count as 2^62; errors stop at 2^63 - 1. Null ids come last in the order
of ids, and rows that repeat an id are entries of their own (ties by the bytes of the parts); null labels are
one label; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import batch_of, cut, map_batches, tidy, with_facts

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that this share of all vectors have (or more) are joined by broadcast: at most so many for each position.
HOT_SHARE = 1000
LIMIT, MOST = 1 << 62, (1 << 63) - 1
KINDS = ("<i2", "<i4", "<i8")
_rows = 4096  # of one product of distances


def to_bytes(parts: np.ndarray) -> pa.Array:
    """Rows of integers as bytes of the narrowest kind that holds the row."""
    n, width = parts.shape
    if not width:
        return pa.array([b""] * n, pa.binary())
    low, high = parts.min(axis=1), parts.max(axis=1)
    kind = np.where((low >= -(1 << 15)) & (high < 1 << 15), 0, np.where((low >= -(1 << 31)) & (high < 1 << 31), 1, 2))
    size = width * np.array([2, 4, 8])[kind]
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    data = np.empty(ends[-1], np.uint8)
    for k, dtype in enumerate(KINDS):
        at = np.flatnonzero(kind == k)
        if len(at):
            raw = np.ascontiguousarray(parts[at].astype(dtype)).view(np.uint8).reshape(len(at), -1)
            data[ends[at][:, None] + np.arange(raw.shape[1])] = raw
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def from_bytes(column: pa.Array, width: int) -> np.ndarray:
    """The integers of such rows."""
    out = np.zeros((len(column), width), np.int64)
    if width:
        size = pc.binary_length(column).to_numpy()
        for dtype, each in zip(KINDS, (2, 4, 8), strict=True):
            at = np.flatnonzero(size == width * each)
            if len(at):
                out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype).reshape(len(at), width)
    return out


def integer_parts(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: float) -> DataFrame:
    """(id, label, width, parts array<binary>) of the vectors without null or non-finite components."""
    names = ["id", "label", "length", "parts"]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            vectors = batch.column(1)
            there = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
            length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
            flat = pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(length))
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            fine = there & (bad[ends[1:]] == bad[ends[:-1]])
            for size in np.unique(length[fine]):
                at = np.flatnonzero(fine & (length == size))
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(flat[ends[at][:, None] + np.arange(size)] * scale), -LIMIT, LIMIT).astype(np.int64)
                whole = np.pad(whole, ((0, 0), (0, -int(size) % parts)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * parts, pa.int32()), to_bytes(whole.reshape(len(at) * parts, whole.shape[1] // parts)))
                where = pa.array(at)
                yield batch_of(names, [batch.column(0).take(where), batch.column(2).take(where), pa.array(np.full(len(at), size), pa.int32()), lists])

    schema = f"id {types[id_col]}, label {types[label_col]}, length int, parts array<binary>"
    return df.select(id_col, vector_col, label_col).mapInArrow(run, schema)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry (the first of equals) and the squared distance to it."""
    width = rows.shape[1]
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    code, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    exact = width * (2 * most) ** 2 < 1 << 53
    step = _rows if exact else 16
    kind = np.float64 if exact else object
    entries = book.astype(kind)
    squares = (entries * entries).sum(axis=1) if width else np.zeros(len(book), kind)
    for lo in range(0, len(rows), step):
        x = rows[lo : lo + step].astype(kind)
        if not width:
            continue
        apart = squares[None, :] - 2 * (x @ entries.T)
        own = np.argmin(apart, axis=1)
        code[lo : lo + step] = own
        full = apart[np.arange(len(own)), own] + (x * x).sum(axis=1)
        error[lo : lo + step] = full.astype(np.int64) if exact else [min(int(v), MOST) for v in full]
    return code, error


def fit(points: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after `rounds` rounds over points (position, part, weight), each a weighted mean rounded down; unused entries stay."""
    for _ in range(rounds):
        sums = points.mapInArrow(added(books), "slot int, value decimal(38,0)").groupBy("slot").agg(F.sum("value").alias("value"))
        found = {r["slot"]: int(r["value"]) for r in sums.collect()}  # at most (width + 1) numbers for each entry
        new = []
        for position, book in enumerate(books):
            k, width = book.shape
            fresh = book.copy()
            for entry in range(k):
                first = (position * k + entry) * (width + 1)
                if n := found.get(first + width, 0):
                    fresh[entry] = [found.get(first + j, 0) // n for j in range(width)]
            new.append(fresh)
        books = new
    return books


def added(books: list[np.ndarray]):
    """One task's counts and sums for the entries of all codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = books[0].shape
        total = np.zeros((len(books) * k, width + 1), object)
        for batch in tidy(batches):
            position, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                rows, n = from_bytes(batch.column(1).take(pa.array(at)), width), weight[at]
                code, _ = nearest(rows, books[p])
                small = int(np.abs(rows).max(initial=0)) * int(n.sum()) < LIMIT
                held = np.column_stack([rows, np.ones(len(rows), np.int64)]).astype(np.int64 if small else object) * n[:, None]
                own = np.zeros((k, width + 1), np.int64 if small else object)
                np.add.at(own, code, held)
                total[p * k : (p + 1) * k] += own.astype(object)
        used = np.flatnonzero(total[:, width] > 0)
        slots = (used[:, None] * (width + 1) + np.arange(width + 1)).ravel()
        yield batch_of(["slot", "value"], [pa.array(slots, pa.int32()), pa.array([Decimal(int(v)) for v in total[used].ravel()], pa.decimal128(38, 0))])

    return run


def digest(books: list[np.ndarray]) -> str:
    """The hex SHA-256 of all integer components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def coded(points: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(position, part, code, error) of each distinct part."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        position = batch.column(0).to_numpy()
        code, error = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
        for p in np.unique(position):
            at = np.flatnonzero(position == p)
            code[at], error[at] = nearest(from_bytes(batch.column(1).take(pa.array(at)), books[p].shape[1]), books[p])
        return batch_of(["position", "part", "code", "error"], [batch.column(0), batch.column(1), pa.array(code, pa.int32()), error])

    return map_batches(points, run, "position int, part binary, code int, error long")


def _long(total: Column) -> Column:
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, hot_share: int = HOT_SHARE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, code, error, label_error), one row for each vector kept, and the codebooks (at most 256 entries each, as codes have two hex digits)."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    # the checkpoint fixes the row numbers
    vectors = cut(integer_parts(df, id_col, vector_col, label_col, parts, scale).withColumn("row", F.monotonically_increasing_id()))
    lengths = vectors.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    kept, width = vectors.filter(F.col("length") == length), -(-length // parts)
    first = kept.select("id", "parts").orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries).collect()
    books = [from_bytes(pa.array([bytes(r["parts"][p]) for r in first], pa.binary()), width) for p in range(parts)]
    rows = kept.select("row", "id", "label", F.posexplode("parts").alias("position", "part"))
    points = cut(rows.groupBy("position", "part").agg(F.count("*").alias("weight")))
    n = kept.count()
    if first:
        books = fit(points, books, rounds)
    often = F.col("weight") * F.lit(hot_share) >= F.lit(n)
    hot = coded(points.filter(often), books)  # at most hot_share rows for each position
    cold = coded(points.filter(~often), books)
    by = ["position", "part"]
    met = rows.join(F.broadcast(hot), by).unionByName(rows.join(F.broadcast(points.filter(often).select(*by)), by, "left_anti").join(cold, by))
    codes = F.concat(*(F.lower(F.lpad(F.hex(F.max(F.when(F.col("position") == p, F.col("code")))), 2, "0")) for p in range(parts)))
    out = met.groupBy("row", "id", "label").agg(codes.alias("code"), _long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
    out = cut(out.withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("\0"))))
    labels = out.groupBy("key").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    return with_facts(out, labels, "key", ["row"]).select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def approximations(codes: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", scale: float = SCALE) -> DataFrame:
    """(id, vector array<double>): the vectors that the codes stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(batch.num_rows, len(books))
        values = np.concatenate([book[own[:, p]] for p, book in enumerate(books)], axis=1) / scale
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
        return batch_of([id_col, "vector"], [batch.column(0), lists])

    return map_batches(codes.select(id_col, "code"), run, f"`{id_col}` {dict(codes.dtypes)[id_col]}, vector array<double>")
