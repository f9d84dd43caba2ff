"""Kernels over whole groups, many groups at a time.

Means and projections in which each row needs the one before it have no plan of
windows. Rows are sorted inside partitions, cut into whole groups, and all groups
of about the same length advance together, one NumPy step for each frame. Where
they are few (long recordings), a NumPy step costs more than its numbers, and
projections go through each group in plain floats.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows that are worked on together (a longer group is a table of its own).
TOGETHER = 1 << 16
#: Fewer groups of a length class than this are projected one by one.
FEW = 32


def group_starts(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """First rows of the runs of equal keys (the first columns); null equals null."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for column in table.columns[:keys]:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if n > 1:
            a, b = flat.slice(1), flat.slice(0, n - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, together: int = TOGETHER) -> Iterator[pa.Table]:
    """Tables of whole groups, about `together` rows each, of batches sorted by their first columns."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= together and (last := int(group_starts(held, keys)[-1])):
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df dealt out by keys for work that its bytes do not show.

    Partitions made by bytes would be too few, and so they would be for a repartition to the session's own number, which Spark leaves out where a window has dealt the rows before.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[f"`{k}`" for k in keys])


def by_groups(df: DataFrame, keys: Sequence[str], order: str, kernel: Callable[[pa.Table, np.ndarray], pa.Array], out: str, kind: str) -> DataFrame:
    """df and the column `out` that the kernel makes of whole groups (a table sorted by keys and order, and the first row of each group)."""
    columns = [*keys, order, *(c for c in df.columns if c not in (*keys, order, out))]
    rows = dealt(df.select(*[f"`{c}`" for c in columns]), keys).sortWithinPartitions(*[f"`{k}`" for k in (*keys, order)])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, len(keys)):
            made = kernel(table, group_starts(table, len(keys)))
            yield from table.append_column(out, made).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def length_classes(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, lengths) of the groups of each power of two of lengths, so that a padded matrix is at most twice its rows."""
    lengths = np.diff(np.append(starts, n))
    class_of = np.floor(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(class_of):
        own = class_of == k
        yield starts[own], lengths[own]


def covering(at: pa.ChunkedArray, group: np.ndarray, start: pa.ChunkedArray, stop: pa.ChunkedArray, of: np.ndarray, rank: pa.ChunkedArray) -> np.ndarray:
    """For each place of its group, which half-open interval [start, stop) of that group covers it (-1: none): the one of the largest rank, then of the latest start.

    Each interval's places, in their order, are two spans of a power of two, and spans hand what they hold down to their halves: no more steps than places and intervals
    have bits, however they overlap.
    """
    best = np.full(len(at), -1)
    there = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    if not len(there) or not len(start):
        return best
    by = pc.sort_indices(pa.table({"rank": rank, "start": start}), sort_keys=[("rank", "ascending"), ("start", "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    values = np.concatenate([start.to_numpy(), stop.to_numpy(), at.drop_null().to_numpy()])
    due = np.repeat([0, 1], [2 * len(start), len(there)])
    order = np.lexsort((due, values, np.concatenate([of, of, group[there]])))  # borders stand before the places that they equal
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(due[order]) - due[order]
    low, high = before[: len(start)], before[len(start) : 2 * len(start)]
    level = np.frexp(high - low)[1] - 1  # -1: no place inside
    held = np.full(len(there), -1)
    for k in range(int(level.max()), -1, -1):
        own = level == k
        for first in (low[own], high[own] - (1 << k)):
            np.maximum.at(held, first, place[own])
        if k:
            half = 1 << (k - 1)
            lower = held.copy()
            np.maximum(lower[half:], held[:-half], out=lower[half:])
            held = lower
    found = held[before[2 * len(start) :]]
    best[there] = np.where(found < 0, -1, by[found])
    return best


def exponential_means(x: np.ndarray, starts: np.ndarray, reference: np.ndarray, rate: float) -> np.ndarray:
    """Means from each group's reference row outward, both ways; a missing value keeps the mean."""
    ends = np.append(starts[1:], len(x))
    y = x.copy()
    for step, last in ((1, ends - reference), (-1, reference - starts + 1)):
        mean = x[reference].copy()
        order = np.argsort(-last, kind="stable")  # longest first, so that active groups are a prefix
        left = last[order]
        for k in range(1, int(left[0]) if len(left) else 0):
            active = order[: np.searchsorted(-left, -k, "left")]
            at = reference[active] + step * k
            seen = x[at]
            mean[active] += np.where(np.isnan(seen), 0.0, rate * (seen - mean[active]))
            y[at] = mean[active]
    return y


class Slab:
    """|sum of pattern[j] * y[i + j]| at most `bound`, for every i; a row run outside is moved onto the slab, straight across."""

    def __init__(self, pattern: Sequence[float], bound: float):
        self.pattern, self.bound = np.array(pattern, float), bound
        self.shares = self.pattern / (self.pattern @ self.pattern)
        self.width = len(self.pattern)

    def excess(self, rows: np.ndarray) -> np.ndarray:
        value = np.tensordot(self.pattern, rows, 1)
        return value - np.clip(value, -self.bound, self.bound)

    def correct(self, rows: np.ndarray, active: np.ndarray) -> None:
        over = np.where(active, self.excess(rows), 0.0)
        if over.any():
            rows -= np.multiply.outer(self.shares, over)

    def sweep(self, y: list[float], places: Iterable[int]) -> None:
        """One group's values, corrected in place, window after window."""
        pattern, shares, bound, width = self.pattern.tolist(), list(enumerate(self.shares.tolist())), self.bound, self.width
        for i in places:
            value = sum(map(mul, pattern, y[i : i + width]))
            if not -bound <= value <= bound:
                over = value - (bound if value > bound else -bound)
                for j, share in shares:
                    y[i + j] -= share * over

    def over(self, y: np.ndarray) -> np.ndarray:
        """By how much each window of sequences (frame, ..) is outside."""
        n = len(y) - self.width + 1
        value = sum(p * y[j : n + j] for j, p in enumerate(self.pattern))
        return np.abs(value) - self.bound


class Arc:
    """Neighbouring unit quaternions at most `bound` apart; both ends move along their arc, by half of what is too much."""

    width = 2

    def __init__(self, bound: float):
        self.bound = bound

    @staticmethod
    def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 2 * np.arccos(np.minimum(1.0, np.abs((a * b).sum(-1))))

    @staticmethod
    def along(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
        d = (a * b).sum(-1)
        b = np.where((d < 0)[..., None], -b, b)
        theta = np.arccos(np.minimum(1.0, np.abs(d)))
        flat = np.abs(d) > 0.9995
        bend = np.where(flat, 1.0, np.sin(theta))
        wa = np.where(flat, 1 - share, np.sin((1 - share) * theta) / bend)
        wb = np.where(flat, share, np.sin(share * theta) / bend)
        c = wa[..., None] * a + wb[..., None] * b
        return c / np.linalg.norm(c, axis=-1, keepdims=True)

    def correct(self, rows: np.ndarray, active: np.ndarray) -> None:
        turn = self.angle(rows[0], rows[1])
        wide = active & (turn - self.bound > 1e-10)
        if wide.any():
            a, b, share = rows[0][wide], rows[1][wide], (turn[wide] - self.bound) / (2 * turn[wide])
            rows[0][wide], rows[1][wide] = self.along(a, b, share), self.along(a, b, 1 - share)

    def sweep(self, y: list[list[float]], places: Iterable[int]) -> None:
        """One group's quaternions, corrected in place, pair after pair."""
        bound, acos, sin, sqrt = self.bound, math.acos, math.sin, math.sqrt
        for i in places:
            a0, a1, a2, a3 = y[i]
            b0, b1, b2, b3 = y[i + 1]
            d = a0 * b0 + a1 * b1 + a2 * b2 + a3 * b3
            if d < 0:
                d, b0, b1, b2, b3 = -d, -b0, -b1, -b2, -b3
            theta = acos(d if d < 1.0 else 1.0)
            if 2 * theta - bound > 1e-10:
                share = (2 * theta - bound) / (4 * theta)
                if d > 0.9995:
                    near, far = 1 - share, share
                else:
                    bend = sin(theta)
                    near, far = sin((1 - share) * theta) / bend, sin(share * theta) / bend
                c0, c1, c2, c3 = near * a0 + far * b0, near * a1 + far * b1, near * a2 + far * b2, near * a3 + far * b3
                n = sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3)
                y[i] = [c0 / n, c1 / n, c2 / n, c3 / n]
                c0, c1, c2, c3 = far * a0 + near * b0, far * a1 + near * b1, far * a2 + near * b2, far * a3 + near * b3
                n = sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3)
                y[i + 1] = [c0 / n, c1 / n, c2 / n, c3 / n]

    def over(self, y: np.ndarray) -> np.ndarray:
        """By how much each pair of sequences (frame, .., 4) is too far apart."""
        return self.angle(y[:-1], y[1:]) - self.bound


def broken(rule: Slab | Arc, y: np.ndarray, lengths: np.ndarray, tolerance: float) -> bool:
    """Whether a window that lies in its sequence breaks the rule."""
    if len(y) < rule.width:
        return False
    return bool(((rule.over(y) > tolerance) & (lengths >= np.arange(len(y) - rule.width + 1)[:, None] + rule.width)).any())


def projected(y: np.ndarray, lengths: np.ndarray, rules: Sequence[Slab | Arc], low: np.ndarray | float = -np.inf, high: np.ndarray | float = np.inf, rounds: int = 96, tolerance: float = 1e-10) -> np.ndarray:
    """Cyclic projections of padded sequences (frame, group, ..) onto all rules: each rule along the frames to and fro, until none is broken.

    Fixed values: the order of the sweeps, 96 rounds and the tolerance decide where a sequence ends that cannot meet all rules.
    """
    y = y.copy()
    boxed = not (np.all(np.isneginf(low)) and np.all(np.isposinf(high)))
    for _ in range(rounds):
        if boxed:
            np.clip(y, low, high, out=y)
        for rule in rules:
            places = range(len(y) - rule.width + 1)
            for i in (*places, *reversed(places)):
                rule.correct(y[i : i + rule.width], lengths >= i + rule.width)
        if boxed:
            np.clip(y, low, high, out=y)
        if not any(broken(rule, y, lengths, tolerance) for rule in rules):
            break
    return y


def projected_one(y: np.ndarray, rules: Sequence[Slab | Arc], low: float = -math.inf, high: float = math.inf, rounds: int = 96, tolerance: float = 1e-10) -> np.ndarray:
    """`projected` for one sequence, in plain floats: about a microsecond a window and sweep, whatever its length."""
    boxed, n = not (low == -math.inf and high == math.inf), np.array([len(y)])
    values, shown = y.tolist(), y[:, None]
    clip = lambda v: low if v < low else high if v > high else v
    for _ in range(rounds):
        if boxed:
            values = list(map(clip, values))
        for rule in rules:
            places = range(len(values) - rule.width + 1)
            rule.sweep(values, places)
            rule.sweep(values, reversed(places))
        if boxed:
            values = list(map(clip, values))
        shown = np.array(values, float)[:, None]
        if not any(broken(rule, shown, n, tolerance) for rule in rules):
            break
    return shown[:, 0]


def projected_groups(x: np.ndarray, starts: np.ndarray, rules: Sequence[Slab | Arc], low: np.ndarray | None = None, high: np.ndarray | None = None, rounds: int = 96) -> np.ndarray:
    """`projected` for each group of rows; low and high are values of each group."""
    out = x.copy()
    place = {s: i for i, s in enumerate(starts.tolist())}
    for first, lengths in length_classes(starts, len(x)):
        if len(first) < FEW:
            for s, n in zip(first.tolist(), lengths.tolist(), strict=True):
                bounds = (-math.inf if low is None else float(low[place[s]]), math.inf if high is None else float(high[place[s]]))
                out[s : s + n] = projected_one(x[s : s + n], rules, *bounds, rounds=rounds)
            continue
        at = first[None, :] + np.minimum(np.arange(lengths.max())[:, None], lengths[None, :] - 1)
        own = [place[s] for s in first.tolist()]
        bounds = (-np.inf if low is None else low[own], np.inf if high is None else high[own])
        y = projected(x[at], lengths, rules, *bounds, rounds=rounds)
        inside = np.arange(lengths.max())[:, None] < lengths[None, :]
        out[at[inside]] = y[inside]
    return out
