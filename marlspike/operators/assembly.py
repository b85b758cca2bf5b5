"""Joins and choices of data assembly: answers by position, aligned systems, plans, picks among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from marlspike.operators.ranks import range_bucket, ranked
from marlspike.operators.sampling import order_of


def request_key(*parts: Column) -> Column:
    """Key of a request: the md5 of its prompt."""
    return F.md5(F.concat_ws("\n", *parts))


def positions(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """``df`` with ``batch`` and ``n``: batches of ``size`` rows within a key, numbered from 0, and places from 1."""
    placed = ranked(df, [by], range_bucket(df, order), [F.col(order)], "_p")
    return placed.withColumn("batch", F.floor(F.col("_p") / size)).withColumn("n", (F.col("_p") % size + 1).cast("int")).drop("_p")


def by_position(rows: DataFrame, answers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the ``value`` that ``answers`` (``keys``, ``n``, ``value``) gives to their place; null without one."""
    return rows.join(answers.select(*keys, "n", value), [*keys, "n"], "left")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of ``table`` by ``keys``, null where it has no row; the first of repeated keys by value."""
    one = table.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_v"))
    return rows.join(one, keys, "left").select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in columns])


def reused(requests: DataFrame, answers: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(requests with the answer their key already has, requests still to be asked)."""
    have = answers.where(F.col(value).isNotNull())
    known = lookup(requests, have, [key], [value])
    return known.where(F.col(value).isNotNull()), requests.join(have.select(key).distinct(), key, "left_anti")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` and ``b`` with the same ``key``, columns suffixed ``_a`` and ``_b``.

    Both must hold the same keys once each: the row of a key that stands in one of them only raises, wherever it is
    read, as does a repeated key.
    """
    side = lambda d, s: d.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{s}"), *[F.min(c).alias(f"{c}_{s}") for c in d.columns if c != key])
    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    fits = (F.coalesce("_na", F.lit(0)) == 1) & (F.coalesce("_nb", F.lit(0)) == 1)
    checked = F.when(fits, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("rows of the two systems differ at "), F.col(key).cast("string"))).cast(both.schema[key].dataType))
    return both.withColumn(key, checked).drop("_na", "_nb")


def paired_pick(a: DataFrame, b: DataFrame, key: str, same: str, seed: int, k: int) -> DataFrame:
    """``k`` keys in seeded order with the rows of both systems; the column ``same`` must be equal in both."""
    both = aligned(a, b, key)
    equal = F.col(f"{same}_a").eqNullSafe(F.col(f"{same}_b"))
    checked = both.withColumn(key, F.when(equal, F.col(key)).otherwise(F.raise_error(F.lit("the two systems saw other rows")).cast(both.schema[key].dataType)))
    return checked.orderBy(order_of(seed, F.col(key)), key).limit(k)


def union_inputs(*frames: DataFrame) -> DataFrame:
    """All rows of frames of different columns; what a frame lacks is null."""
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def plan(intents: DataFrame, varieties: dict[str, int], question_types: list[str] | None = None, only_intents: list[str] | None = None, only_varieties: list[str] | None = None, cells: dict[str, int] | None = None) -> DataFrame:
    """(``name``, ``variety``, ``qtype``, ``repeat``): one row per request.

    ``varieties``: requests of each cell without a question type. ``cells`` ("intent/variety" or
    "intent/variety/qtype") sets the number of every cell instead; those it does not list get none.
    """
    kinds = [F.lit(None).cast("string"), *map(F.lit, question_types or [])]
    chosen = [v for v in varieties if not only_varieties or v in only_varieties]
    if not chosen:
        return intents.sparkSession.createDataFrame([], "name string, variety string, qtype string, repeat int")
    base = intents.where(F.col("name").isin(only_intents)) if only_intents else intents
    base = base.select("name", F.explode(F.array(*map(F.lit, chosen))).alias("variety")).select("*", F.explode(F.array(*kinds)).alias("qtype"))
    if cells is None:
        default = F.lit(0)
        for v, n in varieties.items():
            default = F.when(F.col("variety") == v, F.lit(n)).otherwise(default)
        n = F.when(F.col("qtype").isNull(), default).otherwise(0)
    else:
        n = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in cells.items() for x in kv]), F.concat_ws("/", "name", "variety", "qtype")), F.lit(0))
    return base.withColumn("_n", n).where("_n > 0").select("name", "variety", "qtype", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("repeat"))


def guarded_pick(df: DataFrame, eligible: Column, *order: Column) -> DataFrame:
    """The first candidate in ``order`` among those that pass every guard; none passes, none is returned."""
    return df.where(F.coalesce(eligible, F.lit(False))).orderBy(*order).limit(1)


def smallest_within(df: DataFrame, passes: Column, size: str, tie: float, *order: Column) -> DataFrame:
    """The smallest passing candidate; of those within a share ``tie`` of its size the first by ``order``."""
    ok = df.where(F.coalesce(passes, F.lit(False)))
    least = ok.agg(F.min(size).alias("_m"))
    return ok.join(F.broadcast(least), F.col(size) <= F.col("_m") * (1 + tie)).drop("_m").orderBy(*order, size).limit(1)


def ratios(df: DataFrame, by: str, system: str, base: str, value: str) -> DataFrame:
    """(``by``, ``system``, ``ratio``): the value of every system over that of ``base`` in the same group."""
    b = df.where(F.col(system) == base).select(by, F.col(value).alias("_b"))
    return df.join(b, by).select(by, system, (F.col(value) / F.nullif(F.col("_b"), F.lit(0))).alias("ratio"))


def better_and_fits(base: DataFrame, cand: DataFrame, rate: str, bad: str, cost: str, min_gain: float, min_drop: float, most: float) -> DataFrame:
    """``gain``, ``drop``, ``winner``: the candidate if its rate is enough higher or its bad rate enough lower, and its cost fits."""
    x = base.select(F.col(rate).alias("r0"), F.col(bad).alias("b0")).join(cand.select(F.col(rate).alias("r1"), F.col(bad).alias("b1"), F.col(cost).alias("c1")), F.lit(True))
    gain = F.col("r1") / F.col("r0") - 1
    drop = F.when(F.col("b0") > 0, 1 - F.col("b1") / F.col("b0")).otherwise(0.0)
    better = (gain >= min_gain) | (drop >= min_drop)
    return x.select(gain.alias("gain"), drop.alias("drop"), F.when(better & (F.col("c1") <= most), "candidate").otherwise("baseline").alias("winner"))


def split_key(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``df`` with the parts of a key "a/b/c" as columns; missing parts are null."""
    parts = F.split(F.col(key), "/", len(names))
    return df.withColumns({n: F.get(parts, i) for i, n in enumerate(names)})


def in_order(df: DataFrame, by: list[str], order: list[Column], out: str = "n") -> DataFrame:
    """Places from 1 within small groups."""
    return df.withColumn(out, F.row_number().over(Win.partitionBy(*by).orderBy(*order)))
