"""Problem 2: near-duplicates by a grouped prefix join.

Texts with equal shingle sets collapse into one class, classes with the same size and the same prefix (their
rarest shingles) into one group. Groups that share a prefix shingle are filtered by length and position, the
survivors are expanded to classes and verified exactly; links are closed over to components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marlspike.llm.shingles import alike, shingle_sets, with_sets
from marlspike.operators.components import connected_components
from marlspike.operators.pairs import expand_pairs, key_pairs
from marlspike.session import cut, merged, release

#: Counters of the frequency sketch that orders shingles: a fixed 1 MB, whatever the corpus holds. Any order gives
#: the same result; the sketch only puts common shingles last, so that prefixes are rare.
SKETCH_BITS = 17


def frequency_sketch(sets: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Occurrences per hash bucket over all sets: ``2**bits`` counters, summed per task before they are sent."""
    size = 1 << bits

    def count(batches):  # noqa: ANN001, ANN202
        total = np.zeros(size, np.int64)
        for b in batches:
            flat = b.column("set").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat & (size - 1), minlength=size)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65_536):
            part = at[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    got = sets.select("set").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _ceil(a: Column, num: int, den: int) -> Column:
    """ceil(a * num / den) in whole numbers."""
    return F.floor((a * num + (den - 1)) / den).cast("int")


def prefix_ends(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(end of the prefix, end of the suffix) of sets of ``n`` hashes.

    A set shares one of its prefix with any partner; two sets of equal size and prefix share one of what follows it.
    """
    need = -(-n * num // den)  # overlap that the smaller partner of any pair must reach
    p = n - need + 1
    both = -(-2 * n * num // (num + den))  # overlap of two sets of this size
    return p, np.minimum(p + (n - p) - (both - p) + 1, n)


def near_duplicate_links(sets: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """Links (``ca`` < ``cb``) between classes whose sets have a Jaccard similarity of ``num/den`` or more.

    ``sets``: ``cls`` (id of the class), ``n``, ``set``; materialised, as it is read several times. No candidate is
    capped: the prefix, length and position filters lose no pair.
    """
    freq = sets.sparkSession.sparkContext.broadcast(frequency_sketch(sets))
    mask = (1 << SKETCH_BITS) - 1

    def ordered(b):  # noqa: ANN001, ANN202
        """(sets from rare to common, their sizes) of a batch."""
        order = freq.value
        ns = b.column("n").to_numpy()
        flat = b.column("set").flatten().to_numpy(zero_copy_only=False)
        flat = flat[np.lexsort((flat, order[flat & mask], np.repeat(np.arange(len(ns)), ns)))]
        return flat, ns.astype(np.int64)

    def grouped(batches):  # noqa: ANN001, ANN202
        for b in batches:
            flat, ns = ordered(b)
            at = np.cumsum(ns) - ns
            ends = at + prefix_ends(ns, num, den)[0]
            key = [hashlib.blake2b(flat[i:j].tobytes() + int(n).to_bytes(4, "little"), digest_size=16).digest() for i, j, n in zip(at, ends, ns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("n"), pa.array(key, pa.binary())], names=["cls", "n", "grp"])

    def posted(suffix: bool):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                flat, ns = ordered(b)
                begin = np.cumsum(ns) - ns
                lo, hi = np.zeros_like(ns), prefix_ends(ns, num, den)[0]
                if suffix:
                    lo, hi = prefix_ends(ns, num, den)
                sizes = hi - lo
                p = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - lo, sizes)
                at = pa.array(np.repeat(np.arange(len(ns)), sizes))
                keys = flat[np.repeat(begin, sizes) + p]
                rest = ("grp",) if suffix else ()
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(b.column(c).take(at) for c in ("g", "n")), pa.array(p.astype(np.int32)), *(b.column(c).take(at) for c in rest)], names=["key", "g", "n", "p", *rest])

        return run

    keyed = cut(sets.select("cls", "n", "set").mapInArrow(grouped, "cls long, n int, grp binary"))
    groups = keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("first"))
    # a group is named by its first class, which posts for all of it
    classes = cut(merged(keyed).join(merged(groups), "grp").select("cls", F.col("first").alias("grp"), "size"))
    needed = classes.where("cls = grp or size > 1")
    rows = merged(sets.select("cls", "n", "set")).join(merged(needed), "cls")
    post = rows.where("cls = grp").select(F.col("cls").alias("g"), "n", "set").mapInArrow(posted(False), "key long, g long, n int, p int")
    na, nb, pa_, pb = (F.col(c) for c in ("na", "nb", "pa", "pb"))
    sizes = (na * num <= nb * den) & (nb * num <= na * den)
    reach = F.least(na - pa_, nb - pb)
    across = key_pairs(post, None, sizes & (reach >= _ceil(na + nb, num, num + den)))
    expanded = expand_pairs(across, classes.select(F.col("grp").alias("cls"), F.col("cls").alias("id"))).select(F.least("id_a", "id_b").alias("ca"), F.greatest("id_a", "id_b").alias("cb"))
    # within a group all sizes are equal and the prefix is common: what is missing must come from the suffix
    inner = rows.where("size > 1").select(F.col("cls").alias("g"), "n", "set", "grp").mapInArrow(posted(True), "key long, g long, n int, p int, grp long")
    within = key_pairs(inner.select("g", F.xxhash64("grp", "key").alias("key")), None)
    cand = cut(expanded.unionByName(within).distinct())
    links = cut(alike(cand, sets, "cls", num, den))
    release(keyed, classes, cand)
    return links


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, k: int = 3, min_words: int = 8, num: int = 3, den: int = 5) -> DataFrame:
    """(``id``, ``group_id``) of every text that is alike to another, directly or through others.

    ``group_id`` is the smallest id of the group. Copies count as alike. Null, empty and short texts belong to no
    group; repeated rows count once; an empty table gives no rows.
    """
    records = cut(shingle_sets(df, id_col, text_col, k, min_words))
    # one row per class with the text of its smallest id; copies shrink before the shuffle
    classes = records.groupBy("cls").agg(F.min("id").alias("rep"), (F.min("id") < F.max("id")).alias("copied"), F.min("n").alias("n"), F.min_by("text", "id").alias("text"))
    one = cut(with_sets(classes, k))
    members = cut(records.select("id", "cls"))
    release(records)
    links = near_duplicate_links(one.select(F.col("rep").alias("cls"), "n", "set"), num, den)
    known = cut(one.select("cls", "rep", "copied"))
    release(one)
    labels = connected_components(links.select(F.col("ca").alias("u"), F.col("cb").alias("v")))
    grouped = merged(known).join(merged(labels.select(F.col("v").alias("rep"), "label")), "rep", "left").where("label is not null or copied").select("cls", F.coalesce("label", "rep").alias("group_id"))
    return merged(members).join(merged(grouped), "cls").groupBy("id").agg(F.min("group_id").alias("group_id"))
