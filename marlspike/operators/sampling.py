"""Seeded splits and samples by hash order: the same rows whatever the partitioning.

Where a seeded shuffle is meant, rows are ordered by the md5 of seed and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from marlspike.operators.ranks import hash_bucket, ranked, running


def order_of(seed: int, *keys: Column) -> Column:
    """Position of a row in the seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def threshold(fraction: float) -> str:
    """16 hex digits: hashes below them are a share ``fraction`` of all."""
    return format(min(int(fraction * 2**64), 2**64 - 1), "016x")


def in_val(text: Column, seed: int, fraction: float) -> Column:
    """Whether a text falls into the validation share: the first 8 bytes of sha256("seed:text") as a fraction."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 16) < threshold(fraction)


def source_seed(seed: int, name: Column) -> Column:
    """Seed of one source: the first 8 hex digits of sha256("seed:name") as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), name), 256), 1, 8), 16, 10).cast("long")


def _smallest(df: DataFrame, by: list[str], order: Column, k: int) -> DataFrame:
    """The k first rows of each group. A rank over a hot group is a top-k (WindowGroupLimit) in every map task."""
    return df.withColumn("_r", F.row_number().over(Win.partitionBy(*by).orderBy(order))).where(F.col("_r") <= k)


def spread_sample(df: DataFrame, label: str, key: str, seed: int, per_label: int, total: int) -> DataFrame:
    """Up to ``total`` rows taking labels in turn, up to ``per_label`` each, in seeded order within a label."""
    ranked = _smallest(df, [label], order_of(seed, F.col(key)), per_label)
    return ranked.orderBy("_r", label).limit(total).drop("_r")


def sample_by_group(df: DataFrame, group: str, label: str, key: str, seed: int, per_group: int) -> DataFrame:
    """Up to ``per_group`` rows of each group, spread over its labels in turn."""
    ranked = _smallest(df, [group, label], order_of(seed, F.col(key)), per_group)
    w = Win.partitionBy(group).orderBy("_r", label)
    return ranked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_group).drop("_r", "_k")


def hold_out(df: DataFrame, group: str, key: str, seed: int, share: float) -> DataFrame:
    """``dev``: the first round(share * n) rows of each group in seeded order, halves rounded to even."""
    sizes = df.groupBy(F.col(group).alias("_sg")).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked(df.withColumn("_h", order_of(seed, F.col(key))), [group], hash_bucket(F.col("_h")), [F.col("_h"), F.col(key)], "_r")
    out = placed.join(sizes, F.col(group).eqNullSafe(F.col("_sg")))
    return out.withColumn("dev", F.col("_r") < F.bround(F.col("_n") * F.lit(share))).drop("_sg", "_n", "_h", "_r")


def stratified(df: DataFrame, stratum: str, key: str, seed: int, k: int) -> DataFrame:
    """Exactly ``k`` rows of each stratum, or all it has."""
    return _smallest(df, [stratum], order_of(seed, F.col(key)), k).drop("_r")


def shuffle_cap(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """The first ``k`` rows of the seeded order."""
    return df.orderBy(order_of(seed, F.col(key)), key).limit(k)


def until_target(df: DataFrame, group: str, key: str, size: Column, target: str, seed: int) -> DataFrame:
    """Rows of each group in seeded order until their sizes reach the target; the crossing row is in; 0 means all."""
    placed = running(df.withColumn("_h", order_of(seed, F.col(key))), [group], hash_bucket(F.col("_h")), [F.col("_h"), F.col(key)], {"_before": size})
    return placed.where((F.col(target) == 0) | (F.col("_before") < F.col(target))).drop("_before", "_h")


def plan_requests(intents: DataFrame, varieties: list[str], repeats: int) -> DataFrame:
    """The cross product of a dimension of intents, varieties and repeats, as one row per request."""
    return intents.select("name", F.explode(F.array(*map(F.lit, varieties))).alias("variety")).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
