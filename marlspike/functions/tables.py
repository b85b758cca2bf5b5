"""Table functions for SQL: several rows per input row."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from marlspike.functions.jsonio import _objects


@udtf(returnType="place int, object string")
class AnswerObjects:
    """``place``, ``object``: the JSON objects of a model's answer in order; none for a null answer."""

    def eval(self, answer: str) -> Iterator[tuple[int, str]]:
        for i, o in enumerate(_objects(answer), 1):
            yield i, json.dumps(o, ensure_ascii=False)


def register(spark: SparkSession) -> None:
    """Make the table functions callable from SQL: ``answer_objects(text)``."""
    spark.udtf.register("answer_objects", AnswerObjects)
