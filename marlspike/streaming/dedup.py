"""Streams: readers, exact and near duplicate filters, window counts, answers once per request."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from marlspike.operators.dedup import close_classes, hashed_sets, near_duplicates_kept, set_classes, shingled, text_key
from marlspike.session import cut, merged


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder, ``files`` of them per batch at most, so that memory stays bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def stream_exact_dedup(stream: DataFrame, text: str, event_time: str | None = None, delay: str = "9 days") -> DataFrame:
    """The first row of every text. With an event time the state of a text is kept for ``delay`` only."""
    keyed = stream.withColumn("_k", text_key(F.col(text)))
    if event_time is None:
        return keyed.dropDuplicates(["_k"]).drop("_k")
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def stream_counts(stream: DataFrame, event_time: str, by: str, size: str, delay: str) -> DataFrame:
    """Rows per window and key, closed once rows later than ``delay`` can't come."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, size), by).agg(F.count(F.lit(1)).alias("n"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _before(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """What earlier batches wrote below ``folder``; None where there is nothing."""
    if not _exists(spark, folder):
        return None
    return spark.read.option("basePath", folder).parquet(os.path.join(folder, "batch=*")).where(F.col("batch") < batch).drop("batch")


def stream_near_dedup(stream: DataFrame, key: str, text: str, folder: str, k: int = 3, num: int = 4, den: int = 5) -> DataStreamWriter:
    """Writes the rows of a stream that repeat no earlier kept row, even nearly, as ``kept/batch=n`` below ``folder``.

    A row is compared with the kept rows of earlier batches, then in order with those of its own. Each batch overwrites
    its own folder, so a batch that is replayed after a failure leaves the same rows.
    """
    kept = os.path.join(folder, "kept")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.where(F.col(key).isNotNull() & F.col(text).isNotNull()).dropDuplicates([key]))
        sets = cut(shingled(rows, key, F.col(text), k))
        old = _before(spark, kept, number)
        if old is not None:
            hashed = cut(hashed_sets(sets, "id", "s"))
            classes = cut(hashed.groupBy("cls").agg(F.first("h").alias("h")))
            close = close_classes(classes, cut(set_classes(shingled(old, key, F.col(text), k), "id", "s")), num, den)
            sets = cut(merged(sets).join(merged(hashed.join(close, "cls", "left_semi").select("id")), "id", "left_anti"))
        stay = near_duplicates_kept(sets, "id", "s", num, den).where("keep").select(F.col("id").alias(key))
        merged(rows).join(merged(stay), key, "left_semi").write.mode("overwrite").parquet(os.path.join(kept, f"batch={number}"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", os.path.join(folder, "progress"))


def stream_answers(stream: DataFrame, key: str, folder: str) -> DataStreamWriter:
    """Writes the first answer of every request key below ``folder``; a replayed or repeated request adds nothing."""
    done = os.path.join(folder, "answers")

    def run(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        old = _before(batch.sparkSession, done, number)
        if old is not None:
            fresh = merged(fresh).join(merged(old.select(key)), key, "left_anti")
        fresh.write.mode("overwrite").parquet(os.path.join(done, f"batch={number}"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", os.path.join(folder, "progress"))
