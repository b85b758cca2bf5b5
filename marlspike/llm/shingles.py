"""Sets of word sequences as sorted 64-bit hashes, built per Arrow batch."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marlspike.session import merged

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
_KNOWN: dict[str, int] = {}
_KNOWN_MOST = 500_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x94D049BB133111EB], dtype=np.uint64)


def _word_hashes(words: list[str]) -> list[int]:
    if len(_KNOWN) > _KNOWN_MOST:
        _KNOWN.clear()
    out = []
    for w in words:
        h = _KNOWN.get(w)
        if h is None:
            h = _KNOWN[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


def sets_of(texts: list[str], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets, offsets): per text the sorted distinct hashes of its sequences of ``k`` consecutive words.

    Texts with fewer than ``least`` or ``k`` words have an empty set. All texts are hashed at once.
    """
    words: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = WORD.findall(t.lower())
        counts[i] = len(ws)
        words += ws
    sizes = np.where(counts >= max(k, least), counts - k + 1, 0)
    rows = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(counts) - counts
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)
    h = np.array(_word_hashes(words), dtype=np.uint64)
    x = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = (x ^ (h[at + j] * _MULT[j % 8])) * _MULT[(j + 3) % 8]
            x ^= x >> np.uint64(29)
        x *= _MULT[7]
        x ^= x >> np.uint64(32)
    flat = x.view(np.int64)
    order = np.lexsort((flat, rows))
    flat, rows = flat[order], rows[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])
    flat, rows = flat[new], rows[new]
    return flat, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype(np.int64)


def shingle_sets(df: DataFrame, id_col: str, text_col: str, k: int, min_words: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``id``, ``cls``, ``n``, ``text``, and the columns ``keep``) of the texts with ``min_words`` words or more.

    ``cls`` identifies equal sets of ``n`` shingles. The text stands for its set: it is less than half as long and
    compresses, and ``with_sets`` builds the set again where it is needed. Null texts and ids and shorter texts
    give no row; a repeated row gives as many.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"), *keep).where("id is not null and _t is not null")
    kept = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            flat, offs = sets_of(b.column("_t").to_pylist(), k, min_words)
            rows = np.flatnonzero(np.diff(offs))
            at = pa.array(rows)
            cls = [hashlib.blake2b(flat[offs[i] : offs[i + 1]].tobytes(), digest_size=16).digest() for i in rows]
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(cls, pa.binary()), pa.array(np.diff(offs)[rows].astype(np.int32)), b.column("_t").take(at), *[b.column(c).take(at) for c in keep]], names=["id", "cls", "n", "text", *keep])

    return base.mapInArrow(run, "id long, cls binary, n int, text string" + (", " + kept if kept else ""))


def with_sets(df: DataFrame, k: int) -> DataFrame:
    """``df`` with its ``text`` replaced by ``set``, the sorted hashes of its shingles."""
    rest = [c for c in df.columns if c != "text"]
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            flat, offs = sets_of(b.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))], names=[*rest, "set"])

    return df.mapInArrow(run, f"{kept}, set array<long>")


def alike(cand: DataFrame, sets: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """The pairs of ``cand`` (``ca``, ``cb``) whose sets reach a Jaccard similarity of ``num/den``; exact.

    ``sets``: ``key``, ``n``, ``set``. Sets are long arrays that the planner takes for single values: they only
    ever meet in sort-merge joins.
    """
    side = lambda s: merged(sets.select(F.col(key).alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("set").alias(f"s{s}")))
    both = merged(merged(cand).join(side("a"), "ca")).join(side("b"), "cb")
    return both.where(F.size(F.array_intersect("sa", "sb")) * (num + den) >= (F.col("na") + F.col("nb")) * num).select("ca", "cb")
