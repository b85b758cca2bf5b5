"""Problem 6: records of evaluation splits that recur in the training split.

Minwise hashes of the shingle sets are banded into buckets; only bucket mates from different sides are candidates,
and each is verified by the exact Jaccard similarity. The bucket keys of the held-out records form a Bloom filter,
so that training records without a mate leave before any shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlspike.llm import bloom
from marlspike.llm.shingles import alike, sets_of, shingle_sets, with_sets
from marlspike.operators.pairs import expand_pairs, key_pairs
from marlspike.session import cut, merged, release

#: Rows per band and bands: a pair at 0.6 stays unseen with (1 - 0.6**4)**80, about 1.5 in 100,000; at 0.2 an
#: unlike pair is verified in 12 of 100 cases, at 0.1 in 1.
ROWS, BANDS = 4, 80
#: Share of set bits above which the filter of held-out buckets is not worth its reading.
FULL = 0.9


def _coefficients(count: int, seed: int = 20_240_601) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 62, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, count, dtype=np.uint64)


def band_keys(flat: np.ndarray, offsets: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(sets, bands) bucket keys; ``flat`` holds the hashes of all sets, none of them empty."""
    a, b = _coefficients(rows * bands)
    x = flat.view(np.uint64)
    out = np.empty((len(offsets) - 1, bands), np.int64)
    starts = offsets[:-1]
    h = np.empty_like(x)
    with np.errstate(over="ignore"):
        for j in range(bands):
            key = np.full(len(starts), np.uint64(j) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
            for i in range(j * rows, (j + 1) * rows):
                # the high bits decide the minimum, and they depend on all bits of the hash
                np.multiply(x, a[i], out=h)
                np.add(h, b[i], out=h)
                key = (key ^ np.minimum.reduceat(h, starts)) * np.uint64(0xC2B2AE3D27D4EB4F)
                key ^= key >> np.uint64(31)
            out[:, j] = key.view(np.int64)
    return out


def bucket_filter(texts: DataFrame, k: int, rows: int, bands: int) -> np.ndarray:
    """A filter of the bucket keys of ``texts``."""
    return bloom.filter_of(texts.select("text"), lambda b: band_keys(*sets_of(b.column("text").to_pylist(), k), rows, bands).ravel())


def cross_split_pairs(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", held: tuple[str, ...] = ("dev", "test"), k: int = 3, min_words: int = 8, num: int = 3, den: int = 5, rows: int = ROWS, bands: int = BANDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alike pairs with one record in ``train`` and one in ``held``: ``id_t``, ``id_h`` and ``keep`` suffixed.

    Equal sets form one class and are hashed once; class pairs that verify are expanded in blocks. Rows with a null
    id, text or split, and texts under ``min_words`` words, pair with nothing; repeated rows count once; empty
    tables give no rows.
    """
    spark = df.sparkSession
    side = F.when(F.col(split_col) == train, F.lit("t")).when(F.col(split_col).isin(*held), F.lit("h"))
    use = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), side.alias("side"), *[F.col(c).alias(f"k_{c}") for c in keep]).where("side is not null")
    kept = tuple(f"k_{c}" for c in keep)
    records = cut(shingle_sets(use, "_id", "_text", k, min_words, keep=("side", *kept)))
    one = cut(records.groupBy("cls").agg(F.max(F.col("side") == "t").alias("in_t"), F.max(F.col("side") == "h").alias("in_h"), F.min("n").alias("n"), F.min_by("text", "id").alias("text")))
    # the members of classes without their texts: all that the expansion needs
    members = cut(records.select("cls", "id", "side", *kept))
    release(records)
    bits = bucket_filter(one.where("in_h"), k, rows, bands)
    filled = float(np.unpackbits(bits).mean())
    shared = spark.sparkContext.broadcast(bits if filled < FULL else None)

    def hashed(batches):  # noqa: ANN001, ANN202
        known = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            keys = band_keys(*sets_of(b.column("text").to_pylist(), k), rows, bands).ravel()
            owner = np.repeat(np.arange(b.num_rows), bands)
            if known is not None:
                on = bloom.passes(known, keys)
                keys, owner = keys[on], owner[on]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(b.column(c).take(at) for c in ("cls", "n"))], names=["key", "g", "n"])

    # few rows are left behind the filter; they are read several times
    buckets = {c: cut(one.where(c).select("cls", "n", "text").mapInArrow(hashed, "key long, g binary, n int")) for c in ("in_t", "in_h")}
    sizes = (F.col("na") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("na") * den) & (F.col("ca") != F.col("cb"))
    cand = cut(key_pairs(buckets["in_t"], buckets["in_h"], sizes))
    release(*buckets.values())
    met = cand.select(F.col("ca").alias("cls")).unionByName(cand.select(F.col("cb").alias("cls"))).distinct()
    sets = with_sets(merged(one).join(merged(met), "cls", "left_semi").select("cls", "n", "text"), k)
    same = one.where("in_t and in_h").select(F.col("cls").alias("ca"), F.col("cls").alias("cb"))
    pairs = cut(alike(cand, sets, "cls", num, den).unionByName(same))
    release(one, cand)
    on = lambda s: members.where(F.col("side") == s).select("cls", "id", *kept).distinct()
    got = expand_pairs(pairs, on("t"), on("h"), F.col("id_a") != F.col("id_b"))
    return got.select(F.col("id_a").alias("id_t"), F.col("id_b").alias("id_h"), *[F.col(f"k_{c}_a").alias(f"{c}_t") for c in keep], *[F.col(f"k_{c}_b").alias(f"{c}_h") for c in keep]).distinct()


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Confirmed pairs and affected records per held-out split and source, over pairs that kept split and source."""
    return pairs.groupBy(F.col("split_h").alias("split"), F.col("source_h").alias("source")).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("id_h").alias("held_records"), F.countDistinct("id_t").alias("train_records"))
