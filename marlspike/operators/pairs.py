"""Pairs under shared keys and expansion of class pairs to member pairs, without an unbounded group in any task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlspike.session import merged

#: Members that one block of a class holds about; a task of the joins below sees whole blocks.
BLOCK = 4096
#: Postings of one key per block of ``key_pairs``.
KEY_BLOCK = 2048
#: Copies of a class's row that its members are looked up in, so that a hot class's members meet in as many places.
SALT = 16


def key_pairs(left: DataFrame, right: DataFrame | None, where: Column | None = None, block: int = KEY_BLOCK) -> DataFrame:
    """Distinct pairs (``ca``, ``cb``) of owners that share a key: of ``left`` and ``right``, or ``ca < cb`` of ``left`` alone.

    Both hold ``key``, ``g`` (the owner) and any further columns, which ``where`` reads suffixed ``a`` and ``b``.
    Keys without a partner leave before the join. The left rows of a key are scattered over blocks, the right ones
    repeated per block, so no task holds the pairs of a hot key.
    """
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    if right is None:
        sizes = sizes.where("m > 1")
    else:
        sizes = merged(sizes).join(merged(right.select("key").distinct()), "key")
    blocks = sizes.select("key", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("_n"))
    known = lambda d: merged(d).join(merged(blocks), "key")
    name = lambda c, s: F.col(c).alias(f"c{s}" if c == "g" else f"{c}{s}")
    rest = [c for c in left.columns if c != "key"]
    a = known(left).select("key", F.pmod(F.xxhash64("g"), F.col("_n")).cast("int").alias("_b"), *[name(c, "a") for c in rest])
    b = known(left if right is None else right).select("key", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), *[name(c, "b") for c in rest])
    both = merged(a).join(merged(b), ["key", "_b"])
    if right is None:
        both = both.where("ca < cb")
    if where is not None:
        both = both.where(where)
    return both.select("ca", "cb").distinct()


def expand_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None, keep: Column | None = None, block: int = BLOCK) -> DataFrame:
    """All (member of ``ca`` in ``left``, member of ``cb`` in ``right``) for the rows of ``pairs`` (``ca``, ``cb``).

    Both: ``cls``, ``id`` and any further columns, which come back suffixed ``_a`` and ``_b``; without ``right``
    both sides are ``left``. Classes are cut into blocks and each pair of blocks joins on its own key. Members meet
    their class's number of blocks in ``SALT`` places, so a class of a third of all rows spreads over tasks from
    the start; its size is a partial aggregate. ``keep`` filters by the suffixed columns. Empty inputs give no rows.
    """

    def side(members: DataFrame, s: str) -> tuple[DataFrame, DataFrame]:
        rest = [c for c in members.columns if c != "cls"]
        used = pairs.select(F.col(f"c{s}").alias("cls")).distinct()
        sizes = members.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_n"))
        sizes = merged(sizes).join(merged(used), "cls")
        salted = sizes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        mine = merged(members.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))).join(merged(salted), ["cls", "_s"])
        rows = mine.select(F.col("cls").alias(f"c{s}"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("_n")).cast("int").alias(f"b{s}"), *[F.col(c).alias(f"{c}_{s}") for c in rest])
        return rows, sizes.select(F.col("cls").alias(f"c{s}"), F.col("_n").alias(f"n{s}"))

    (ra, na), (rb, nb) = side(left, "a"), side(left if right is None else right, "b")
    grid = merged(merged(pairs).join(merged(na), "ca")).join(merged(nb), "cb")
    grid = grid.withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("ca", "ba", "cb", "bb")
    out = merged(merged(grid).join(merged(ra), ["ca", "ba"])).join(merged(rb), ["cb", "bb"])
    if keep is not None:
        out = out.where(keep)
    return out.select(*[c for c in ra.columns if c.endswith("_a")], *[c for c in rb.columns if c.endswith("_b")])
