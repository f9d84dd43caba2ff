"""Exact quantiles of groups of any size, without a buffer of their values.

Each round counts a group's values in bins of the range that still holds the
wanted ranks and keeps the bins that do, so the range shrinks by `bins` each time;
the distinct values that are left are counted and ranked. Counts are combined
inside tasks; ties are one row. Rows are read once for the range, once for each round and once in the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.sources.checkpoints import settled


def quantiles(df: DataFrame, keys: list[str], value: str, share: float, bins: int = 1024, rounds: int = 2, out: str = "quantile") -> DataFrame:
    """(keys, n, out): straight between the two values nearest to the rank share * (n - 1). Null and NaN values do not count; a group without others has no row; null keys are a group."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__fw_v")).filter(F.col("__fw_v").isNotNull() & ~F.isnan("__fw_v"))
    names = [f"__fw_k{i}" for i in range(len(keys))]
    rank = share * (F.col("n") - 1)
    known = rows.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)]).agg(F.count("*").alias("n"), F.min("__fw_v").alias("low"), F.max("__fw_v").alias("high"))
    known = settled(known.select(*names, "n", "low", "high", F.lit(0).cast("long").alias("below"), F.floor(rank).alias("r0"), F.ceil(rank).alias("r1")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)), F.lit(True))
    facts = ["n", "low", "high", "below", "r0", "r1"]

    def inside() -> DataFrame:
        return rows.join(known, same & F.col("__fw_v").between(F.col("low"), F.col("high"))).select(*names, *facts, "__fw_v")

    for _ in range(rounds):
        wide = F.col("high") - F.col("low")
        spot = F.when(wide > 0, F.least(F.lit(bins - 1), F.floor((F.col("__fw_v") - F.col("low")) / wide * bins))).otherwise(0)
        counted = inside().withColumn("bin", spot).groupBy(*names, *facts, "bin").agg(F.count("*").alias("c"), F.min("__fw_v").alias("a"), F.max("__fw_v").alias("b"))
        ends = F.col("below") + F.sum("c").over(W.partitionBy(*names).orderBy("bin"))
        kept = counted.withColumn("end", ends).filter((F.col("end") > F.col("r0")) & (F.col("end") - F.col("c") <= F.col("r1")))
        known = settled(kept.groupBy(*names, "n", "r0", "r1").agg(F.min("a").alias("low"), F.max("b").alias("high"), F.min(F.col("end") - F.col("c")).alias("below")))
    distinct = inside().groupBy(*names, *facts, "__fw_v").agg(F.count("*").alias("c"))
    ranked = distinct.withColumn("end", F.col("below") + F.sum("c").over(W.partitionBy(*names).orderBy("__fw_v")))
    held = ranked.groupBy(*names, "n", "r0", "r1").agg(*(F.min(F.when(F.col("end") > F.col(r), F.col("__fw_v"))).alias(x) for r, x in (("r0", "x0"), ("r1", "x1"))))
    return held.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], "n", (F.col("x0") + (F.col("x1") - F.col("x0")) * (rank - F.col("r0"))).alias(out))
