"""The corpus pipeline: normalize, filter with reasons, drop exact and near copies, tag, split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marlspike.functions import text as T
from marlspike.operators.dedup import exact_dedup, near_duplicates_kept, shingled
from marlspike.operators.sampling import in_val
from marlspike.session import cut, merged, settled


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of one run; there are no defaults for what changes results."""

    min_chars: int
    max_chars: int
    min_letter_ratio: float
    repetitive_min_words: int
    min_unique_word_ratio: float
    near_dup: tuple[int, int] | None
    shingle_words: int
    val_frac: float
    seed: int
    strip_diacritics: bool
    unify_alef: bool


PRETRAIN = PipelineConfig(10, 1_000_000, 0.5, 6, 0.1, None, 3, 0.005, 42, strip_diacritics=True, unify_alef=False)
SMOKE = PipelineConfig(10, 4000, 0.5, 6, 0.3, (4, 5), 3, 0.2, 42, strip_diacritics=True, unify_alef=True)


def run_pipeline(docs: DataFrame, order: str, cfg: PipelineConfig) -> DataFrame:
    """``docs`` (``order``, ``text``, ``source``) with ``text`` cleaned and ``status``, ``lang``, ``split``.

    ``status`` is kept or drop_ with the reason; every row has exactly one. Later copies by ``order`` are dropped.
    """
    norm = docs.select(order, settled(T.normalize(F.col("text"), cfg.strip_diacritics, cfg.unify_alef)).alias("text"), "source")
    reason = T.quality_reason(F.col("text"), cfg.min_chars, cfg.max_chars, cfg.min_letter_ratio, cfg.repetitive_min_words, cfg.min_unique_word_ratio)
    # written once: the rules, the masks and NFKC run a single time, whatever reads the result
    judged = cut(norm.withColumn("_q", reason))
    ok = F.col("_q") == "ok"
    # rows that fail a rule have no key and meet no other row
    good = exact_dedup(judged, "text", order, ok).withColumn("status", F.when(~ok, F.concat(F.lit("drop_"), "_q")).when(F.col("first"), "kept").otherwise("drop_exact_dup")).drop("first", "_q")
    if cfg.near_dup:
        kept = cut(shingled(good.where("status = 'kept'"), order, F.col("text"), cfg.shingle_words))
        near = near_duplicates_kept(kept, "id", "s", *cfg.near_dup).where("not keep").select(F.col("id").alias(order), F.lit(True).alias("_n"))
        good = merged(good).join(merged(near), order, "left").withColumn("status", F.when(F.col("_n"), "drop_near_dup").otherwise(F.col("status"))).drop("_n")
    alive = F.col("status") == "kept"
    return good.withColumn("lang", F.when(alive, T.detect_lang(F.col("text")))).withColumn("split", F.when(alive, F.when(in_val(F.col("text"), cfg.seed, cfg.val_frac), "val").otherwise("train")))


def pipeline_stats(result: DataFrame) -> DataFrame:
    """Rows per status, kept documents and characters per split and language."""
    return result.groupBy("status", "split", "lang").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
