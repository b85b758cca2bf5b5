"""Ranks and running sums in two levels, so that no task sees the whole of a group.

Rows are cut into buckets along the order. Bucket totals come from a partial aggregate and are summed along the
buckets of a group, a bounded number of rows; within a bucket an ordinary window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

#: Buckets per group: the most rows that the window over totals sees for one group.
BUCKETS = 4096
#: Quantiles that the buckets of numbers follow.
QUANTILES = 64


def hash_bucket(order: Column) -> Column:
    """Bucket of a hexadecimal hash: its first three digits."""
    return F.conv(F.substring(order, 1, 3), 16, 10).cast("int")


def range_bucket(df: DataFrame, c: str, descending: bool = False, buckets: int = BUCKETS) -> Column:
    """Bucket of a number: between which of ``QUANTILES`` approximate quantiles of the table it stands, and where there.

    One outlying number stretches one of the quantiles' ranges and no other.
    """
    bounds = df.agg(F.percentile_approx(c, [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q")).first()["q"]
    if not bounds:
        return F.lit(0)
    edges = sorted(set(bounds))
    parts = max(1, buckets // QUANTILES)

    def find(lo: int, hi: int) -> Column:
        """The bucket of a number between two edges, by halving."""
        if hi - lo <= 1:
            a, b = edges[lo], edges[min(hi, len(edges) - 1)]
            inside = F.floor((F.col(c) - F.lit(a)) * F.lit(parts) / F.lit(b - a)) if b > a else F.lit(0)
            return (F.lit(lo * parts) + F.greatest(F.lit(0), F.least(inside, F.lit(parts - 1)))).cast("int")
        mid = (lo + hi) // 2
        return F.when(F.col(c) < F.lit(edges[mid]), find(lo, mid)).otherwise(find(mid, hi))

    b = find(0, len(edges))
    return F.lit(len(edges) * parts) - b if descending else b


def running(df: DataFrame, by: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over all rows of its group before it in the order.

    The order must agree with the buckets. Null group values form a group of their own.
    """
    base = df.withColumn("_b", bucket).withColumns({f"_s_{k}": c for k, c in sums.items()})
    totals = base.groupBy(*by, "_b").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    w = Win.partitionBy(*by).orderBy("_b").rowsBetween(Win.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_b").alias("_gb"), *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_o_{k}") for k in sums])
    same = F.col("_b") == F.col("_gb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = base.join(before, same)
    v = Win.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Win.unboundedPreceding, -1)
    out = joined.withColumns({k: F.coalesce(F.sum(f"_s_{k}").over(v), F.lit(0)) + F.col(f"_o_{k}") for k in sums})
    return out.drop("_b", "_gb", *[f"_g_{c}" for c in by], *[f"{p}{k}" for k in sums for p in ("_s_", "_o_")])


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with the place of each row in its group, from 0."""
    return running(df, by, bucket, order, {out: F.lit(1)})
