"""Evaluation statistics as aggregates and windows; only single rows or fixed grids ever reach the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from marlspike.operators.ranks import range_bucket, running
from marlspike.session import cut


def rate(c: Column) -> Column:
    """Share of true rows; null counts as false."""
    return F.avg(F.coalesce(c, F.lit(False)).cast("int"))


def text_stats(text: Column) -> list[Column]:
    """docs, chars, utf8_bytes, words."""
    ws = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    return [F.count(text).alias("docs"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("utf8_bytes"), F.sum(F.size(ws)).alias("words")]


def intent_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """accuracy and macro_f1 over the classes in ``gold``; a null prediction is wrong and no class's false positive."""
    cells = df.where(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = (
        cells.select(F.col("g").alias("c"), F.when(F.col("g").eqNullSafe(F.col("p")), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("g").eqNullSafe(F.col("p")), 0).otherwise(F.col("n")).alias("fn"))
        .unionByName(cells.where("p is not null and p <> g").select(F.col("p").alias("c"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn")))
        .groupBy("c")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    gold_only = per.where("tp + fn > 0")
    return gold_only.agg((F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def confusions(df: DataFrame, gold: str, pred: str, k: int) -> DataFrame:
    """The ``k`` most frequent mistakes; ties by names."""
    p = F.coalesce(F.col(pred), F.lit("(invalid answer)"))
    wrong = df.where(F.col(gold).isNotNull() & ~F.col(gold).eqNullSafe(F.col(pred)))
    return wrong.groupBy(F.col(gold).alias("gold"), p.alias("pred")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(k)


def coverage_at(df: DataFrame, conf: str, correct: Column, target: float) -> DataFrame:
    """threshold, coverage, accuracy: the lowest confidence from which on the answers are right often enough.

    Rows are first summed per distinct confidence; running sums go over those in two levels.
    """
    ties = df.where(F.col(conf).isNotNull()).groupBy(F.col(conf).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(correct.cast("int")).alias("ok"))
    run = running(ties, [], range_bucket(ties, "c", descending=True), [F.desc("c")], {"bn": F.col("n"), "bok": F.col("ok")}).select("c", (F.col("bn") + F.col("n")).alias("cn"), (F.col("bok") + F.col("ok")).alias("cok"))
    met = F.when(F.col("cok") / F.col("cn") >= target, F.col("c"))
    best = run.agg(F.max("cn").alias("all"), F.min_by(F.struct("c", "cn", "cok"), met).alias("x"), F.count(met).alias("k"))
    x = F.when(F.col("k") > 0, F.col("x"))
    return best.select(x["c"].alias("threshold"), F.coalesce(x["cn"] / F.col("all"), F.lit(0.0)).alias("coverage"), (x["cok"] / x["cn"]).alias("accuracy"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, within 0 and 1; (0, 1) for no trials."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def weighted_rate(df: DataFrame, hits: str, judged: str, share: str) -> DataFrame:
    """Stratified rate, renormalised over the strata that were judged."""
    x = df.where(F.col(judged) > 0)
    return x.agg((F.sum(F.col(share) * F.col(hits) / F.col(judged)) / F.sum(share)).alias("rate"))


def distinct2(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Distinct word pairs over all word pairs per group, 0 without any."""
    ws = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda w: w != "")
    pairs = F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1)))).otherwise(F.array())
    base = df.select(*by, F.explode_outer(pairs).alias("g"))
    per = base.groupBy(*by, "g").agg(F.count("g").alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("pairs"), F.coalesce(F.sum((F.col("n") > 0).cast("int")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("distinct2"))


def latency(c: str) -> list[Column]:
    """median (interpolated) and p95 (nearest rank)."""
    return [F.percentile(c, 0.5).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {c})").alias("p95")]


def agreement(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per name the share of rows on which two columns agree; two nulls agree."""
    return df.agg(*[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(k) for k, (a, b) in pairs.items()])


def spike(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Largest rise between consecutive values per group."""
    rise = F.col(value) - F.lag(value).over(Win.partitionBy(by).orderBy(order))
    return df.select(by, rise.alias("_d")).groupBy(by).agg(F.max("_d").alias("spike"))


def select_checkpoint(df: DataFrame, score: str, tie: float, *order: Column) -> DataFrame:
    """The candidate within ``tie`` of the best score that comes first by ``order``."""
    top = df.agg(F.max(score)).first()[0]
    return df.where(F.col(score) >= F.lit(top) - tie).orderBy(*order).limit(1)


def coverage_by(df: DataFrame, by: str, conf: str, correct: Column, target: float) -> DataFrame:
    """``by``, threshold, coverage, accuracy: ``coverage_at`` within every group; null and 0 where none is enough.

    Null values of ``by`` form a group. Running sums go over distinct confidences in two levels.
    """
    ties = df.where(F.col(conf).isNotNull()).groupBy(by, F.col(conf).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(correct.cast("int")).alias("ok"))
    run = running(ties, [by], range_bucket(ties, "c", descending=True), [F.desc("c")], {"bn": F.col("n"), "bok": F.col("ok")})
    done = run.select(by, "c", (F.col("bn") + F.col("n")).alias("cn"), (F.col("bok") + F.col("ok")).alias("cok"))
    met = F.when(F.col("cok") / F.col("cn") >= target, F.col("c"))
    best = done.groupBy(by).agg(F.max("cn").alias("all"), F.min_by(F.struct("c", "cn", "cok"), met).alias("x"), F.count(met).alias("k"))
    x = F.when(F.col("k") > 0, F.col("x"))
    return best.select(by, x["c"].alias("threshold"), F.coalesce(x["cn"] / F.col("all"), F.lit(0.0)).alias("coverage"), (x["cok"] / x["cn"]).alias("accuracy"))


def summary(df: DataFrame, by: str, rates: dict[str, str]) -> DataFrame:
    """Rows and rates over all of ``df`` (``overall`` 1) and per value of ``by``."""
    return df.groupingSets([[by], []], by).agg(F.grouping(by).cast("bigint").alias("overall"), F.count(F.lit(1)).alias("n"), *[rate(F.col(c)).alias(k) for k, c in rates.items()])


def before_and_after(df: DataFrame, by: str, guard: Column, right: Column) -> DataFrame:
    """``n`` and ``rate`` of right rows before and after a guard takes rows out, per value of ``by``."""
    g, r = F.coalesce(guard, F.lit(False)), F.coalesce(right, F.lit(False)).cast("int")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_before"), F.avg(r).alias("rate_before"), F.count_if(g).alias("n_after"), F.avg(F.when(g, r)).alias("rate_after"))


def usable(df: DataFrame, kept: Column, agreed: Column, flagged: Column, checked: Column, seconds: str) -> DataFrame:
    """usable_rate (of all rows), agreement (of kept ones), flagged_rate (of checked ones), seconds_per_usable."""
    k, a, f, c = (F.coalesce(x, F.lit(False)) for x in (kept, agreed, flagged, checked))
    good = F.count_if(k & a)
    return df.agg(
        (good / F.count(F.lit(1))).alias("usable_rate"), (good / F.greatest(F.count_if(k), F.lit(1))).alias("agreement"), F.when(F.count_if(c) > 0, F.count_if(f & c) / F.count_if(c)).alias("flagged_rate"), (F.sum(seconds) / F.greatest(good, F.lit(1))).alias("seconds_per_usable")
    )


def shares(df: DataFrame, by: str, value: Column) -> DataFrame:
    """``by``, ``total`` (1 for the row of all), ``amount`` and its ``share``: ratios from one scan, with the total row."""
    per = df.groupingSets([[by], []], by).agg(F.grouping(by).cast("bigint").alias("total"), F.sum(value).alias("amount"))
    # one row per group: the window sees no data
    return per.withColumn("share", F.col("amount") / F.max(F.when(F.col("total") == 1, F.col("amount"))).over(Win.partitionBy(F.lit(0))))


def totals_by_name(df: DataFrame, counts: str) -> DataFrame:
    """``name``, ``total``: the sums of a column of maps by key."""
    return df.select(F.explode(counts).alias("name", "v")).groupBy("name").agg(F.sum("v").alias("total"))


# Distribution function of Poisson(1).
POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)

Metric = Callable[[DataFrame, str, str], DataFrame]


def weighted_accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``_i``, ``value``: the weighted share of right predictions per round; a null prediction is wrong."""
    right = F.coalesce(F.col(gold) == F.col(pred), F.lit(False)).cast("int")
    return df.groupBy("_i").agg((F.sum(right * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0))).alias("value"))


def weighted_macro_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``_i``, ``value``: the mean F1 over the round's gold classes."""
    cells = df.where("_w > 0").groupBy("_i", F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.sum("_w").alias("w"))
    hit = F.col("g").eqNullSafe(F.col("p"))
    own = cells.select("_i", F.col("g").alias("c"), F.when(hit, F.col("w")).otherwise(0).alias("tp"), F.when(hit, 0).otherwise(F.col("w")).alias("fn"), F.lit(0).alias("fp"))
    false = cells.where("p is not null and not p <=> g").select("_i", F.col("p").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), F.col("w").alias("fp"))
    per = own.unionByName(false).groupBy("_i", "c").agg(*[F.sum(x).alias(x) for x in ("tp", "fn", "fp")]).where("tp + fn > 0")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return per.groupBy("_i").agg(F.avg(f1).alias("value"))


def paired_bootstrap(df: DataFrame, key: str, gold: str, a: str, b: str, metric: Metric = weighted_accuracy, rounds: int = 200, seed: int = 1) -> DataFrame:
    """diff, lo, hi: the metric of system ``a`` less that of ``b`` over the same rows, and its 95 % interval.

    Every row draws a Poisson(1) weight per round from an md5 of seed, block of rounds and key, which resamples rows
    without an index or a join; the weights are summed per task and cell (gold, both predictions) before they are
    shuffled. ``metric`` maps rows with ``_i`` (the round) and ``_w`` (the weight) to one value per round.
    """
    d = df.select(F.col(key).alias("_k"), F.col(gold).alias("_g"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    # one hash serves four rounds, eight digits each; digits compare as the numbers that they write
    blocks = d.select("_k", "_g", "_a", "_b", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // 4))).alias("_j"))
    hashed = blocks.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_j").cast("string"), F.col("_k").cast("string"))))
    drawn = lambda p: sum((F.substring("_h", 8 * p + 1, 8) >= format(math.ceil(s * 2**32), "08x")).cast("int") for s in POISSON)
    # rows that agree in all three are one cell of every round: a small table, which both metrics read
    per = hashed.groupBy("_j", "_g", "_a", "_b").agg(*[F.sum(drawn(p)).alias(f"_{p}") for p in range(4)])
    cells = per.select("_g", "_a", "_b", F.explode(F.array(*[F.struct((F.col("_j") * 4 + p).alias("_i"), F.col(f"_{p}").alias("_w")) for p in range(4)])).alias("x")).select("_g", "_a", "_b", "x._i", "x._w").where(F.col("_i") < rounds)
    # round -1 is the table itself
    whole = d.groupBy("_g", "_a", "_b").agg(F.lit(-1).alias("_i"), F.count(F.lit(1)).alias("_w"))
    reps = cut(cells.unionByName(whole))
    both = metric(reps, "_g", "_a").withColumnRenamed("value", "x").join(metric(reps, "_g", "_b").withColumnRenamed("value", "y"), "_i").select("_i", (F.col("x") - F.col("y")).alias("r"))
    # a fixed number of rounds: a list of bounded length
    grid = both.agg(F.array_sort(F.collect_list(F.when(F.col("_i") >= 0, F.col("r")))).alias("g"), F.max(F.when(F.col("_i") < 0, F.col("r"))).alias("diff"))
    at = lambda i: F.get("g", F.lit(i))
    return grid.select("diff", at(int(0.025 * rounds)).alias("lo"), at(int(0.975 * rounds) - 1).alias("hi"))
