"""The filter of generated pairs: one reason per row, in the order of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlspike.functions import text as T
from marlspike.operators.dedup import exact_dedup, near_duplicates_kept, shingled
from marlspike.session import cut, merged


def generation_reasons(rows: DataFrame, key: str, message: str, reply: str, keep_langs: list[str], reply_langs: list[str], gulf: bool, near: tuple[int, int] = (4, 5), words: int = 3) -> DataFrame:
    """``rows`` with ``reason``: the first check that fails, else kept.

    bad_fields (a side is null or blank), message_lang_X, the reply's problem, non_gulf_dialect and msa_in_message (only
    with ``gulf``), duplicate (of an earlier passing message in any case), near_duplicate (of an earlier kept one).
    """
    m = F.col(message)
    blank = lambda c: ~F.coalesce(F.col(c).rlike(T.NOT_S), F.lit(False))
    tag = T.detect_lang(m)
    checks = F.when(blank(message) | blank(reply), "bad_fields").when(~tag.isin(keep_langs), F.concat(F.lit("message_lang_"), tag))
    problem = T.reply_problem(F.col(reply), reply_langs, gulf)
    checks = checks.when(problem.isNotNull(), problem)
    if gulf:
        checks = checks.when(F.size(T.non_gulf_markers(m)) > 0, "non_gulf_dialect").when(F.size(T.msa_markers(m)) > 0, "msa_in_message")
    judged = cut(rows.withColumn("_r", checks))
    firsts = cut(exact_dedup(judged, message, key, F.col("_r").isNull()).withColumn("_r", F.when(F.col("_r").isNull() & ~F.col("first"), "duplicate").otherwise(F.col("_r"))).drop("first"))
    kept = cut(shingled(firsts.where("_r is null"), key, m, words))
    lost = near_duplicates_kept(kept, "id", "s", *near).where("not keep").select(F.col("id").alias(key), F.lit("near_duplicate").alias("_n"))
    return merged(firsts).join(merged(lost), key, "left").withColumn("reason", F.coalesce("_r", "_n", F.lit("kept"))).drop("_r", "_n")
