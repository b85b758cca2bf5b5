"""Lookup joins with the defined treatment of missing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_unless(rows: DataFrame, verdicts: DataFrame, keys: list[str], verdict: str, bad: str) -> DataFrame:
    """Rows whose verdict is not ``bad``; rows without a verdict are kept."""
    return rows.join(verdicts.select(*keys, F.col(verdict).alias("_v")), keys, "left").where(~F.col("_v").eqNullSafe(bad)).drop("_v")


def map_label(label: Column, table: dict[str, str | None], exclude: tuple[str, ...] = ()) -> Column:
    """A label's target: null for an excluded prefix or an explicit null, the target of "*" for an absent label."""
    out = F.lit(table.get("*"))
    for k, v in table.items():
        if k != "*":
            out = F.when(label == k, F.lit(v)).otherwise(out)
    for p in exclude:
        out = F.when(label.startswith(p), None).otherwise(out)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old and new rows by key: fields of new rows that are present win, the old order comes first."""
    fields = [c for c in old.columns if c not in (key, order)]
    o = old.select(key, F.col(order).alias("_o"), *[F.col(c).alias(f"o_{c}") for c in fields], F.lit(0).alias("_g"))
    n = new.select(key, F.col(order).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in fields])
    both = o.join(n, key, "full_outer")
    return both.select(key, *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in fields], F.coalesce("_g", F.lit(1)).alias("added"), F.coalesce("_o", "_n").alias(order))


def rewrites(rows: DataFrame, fixed: DataFrame, verdicts: DataFrame, keys: list[str], text: str, good: str) -> DataFrame:
    """``rows`` with ``text`` replaced where a rewrite exists that was judged ``good``; ``rewritten`` tells where.

    A rewrite without a verdict is not used, a row without a rewrite stays as it is.
    """
    usable = fixed.join(verdicts.where(F.col("verdict") == good).select(*keys), keys, "left_semi").select(*keys, F.col(text).alias("_t")).dropDuplicates(keys)
    out = rows.join(usable, keys, "left")
    return out.withColumn("rewritten", F.col("_t").isNotNull()).withColumn(text, F.coalesce("_t", text)).drop("_t")


def next_ids(new: DataFrame, taken: DataFrame, key: str, order: str, prefix: str = "t", width: int = 4) -> DataFrame:
    """``new`` with the next free ids behind the largest of ``taken``, dense by ``order``.

    New rows of a review are few; they are numbered in one ordered pass.
    """
    from pyspark.sql import Window as Win

    top = taken.agg(F.max(F.substring(key, len(prefix) + 1, 18).cast("long"))).first()[0] or 0
    n = F.row_number().over(Win.orderBy(order)) + F.lit(top)
    return new.withColumn(key, F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")))
