"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlspike.session import cut, merged, release


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every vertex of ``edges`` (``u``, ``v``) with the smallest vertex of its component.

    Returns ``v``, ``label``; the label of a component's smallest vertex is itself. Every round is two
    aggregations with partial sums and two joins on the vertex; the edge set never leaves the executors and is
    cut to the shared checkpoint folder, so that a lost executor costs one round at most. Rounds go on until nothing
    changes; their number grows with the logarithm of the longest chain. Self loops, repeated and reversed edges
    change nothing; nulls are dropped; no edges give no rows.
    """
    e = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    both = lambda d: d.select("u", "v").unionByName(d.select(F.col("v").alias("u"), F.col("u").alias("v")))
    before = None
    while True:
        # large star: every larger neighbour of u is hung below the smallest of u's closed neighbourhood
        near = both(e)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = merged(near.where("v > u")).join(merged(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are hung below the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = merged(large).join(merged(small_low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        last, e = e, cut(hung.where("u <> v").distinct())
        release(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v")).distinct().select("v", F.col("v").alias("label"))
    return e.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(roots)
