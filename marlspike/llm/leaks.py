"""Problem 9: passages of evaluation items inside training documents.

A positional inverted index, partitioned by document, stores for every training document the postings of the terms
that any item uses; it is built once, whatever the number of items. The rarest term of each run of consecutive item words gives the candidates; the offset-adjusted
lists of the other terms are intersected along the same diagonal.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marlspike.llm import bloom
from marlspike.session import cut, merged

WORD = re.compile(r"[^\W_]+")
#: Characters of items that one pass over the index sends to the executors; larger item sets take several passes.
BLOCK_CHARS = 8_000_000
#: Share of an item's words on one diagonal that counts as a proximity match.
NEAR_SHARE = 0.7
_HAMZA = "ٕٓٔ"


@lru_cache(maxsize=1)
def _fold() -> dict[int, str | None]:
    """Code point -> what words are compared by: no vowel marks, accents, stretching, invisible characters, widths."""
    out: dict[int, str | None] = {}
    for cp in range(0xA0, 0x10000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if (cat == "Mn" and ch not in _HAMZA) or cat == "Cf" or cp == 0x640:
            out[cp] = None
        elif cat[0] in "LN" and (d := unicodedata.normalize("NFKD", ch)) != ch:
            kept = "".join(c for c in d if unicodedata.category(c) != "Mn" or c in _HAMZA)
            folded = unicodedata.normalize("NFC", kept).lower()
            if folded != ch:
                out[cp] = folded
    return out


def words_of(text: str) -> list[str]:
    """The words of a text as passages are compared."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(_fold())
    return WORD.findall(text.lower())


_KNOWN: dict[str, int] = {}
_KNOWN_MOST = 500_000


def term_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, remembered per worker."""
    if len(_KNOWN) > _KNOWN_MOST:
        _KNOWN.clear()
    get = _KNOWN.get
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _KNOWN[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out.view(np.int64)


def index_postings(docs: DataFrame, id_col: str, text_col: str, items: np.ndarray) -> DataFrame:
    """(``doc_id``, ``terms``, ``pos``): per document the hashes and positions of the words that may be item words.

    ``items``: the filter of all item words, of a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).where("doc_id is not null and _t is not null")
    id_type = base.schema["doc_id"].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        bits = shared.value
        for b in batches:
            words: list[str] = []
            ends = []
            for t in b.column("_t").to_pylist():
                words += words_of(t)
                ends.append(len(words))
            h = term_hashes(words)
            at = np.flatnonzero(bloom.passes(bits, h))
            begin = np.concatenate([[0], ends]).astype(np.int64)
            row = np.searchsorted(begin, at, side="right") - 1
            sizes = np.bincount(row, minlength=b.num_rows)
            rows = np.flatnonzero(sizes)
            offs = pa.array(np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (h[at], (at - begin[row]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), *lists], names=["doc_id", "terms", "pos"])

    return base.mapInArrow(run, f"doc_id {id_type}, terms array<long>, pos array<int>")


def anchors_of(terms: np.ndarray, freq: np.ndarray, run: int) -> list[int]:
    """Offsets that no match can do without: the rarest term of every window of ``run`` words, and so many of the
    rarest terms of the item that no diagonal with ``NEAR_SHARE`` of its words can miss them all."""
    rare = freq[terms]
    windows = {w + int(np.argmin(rare[w : w + run])) for w in range(len(terms) - run + 1)}
    least = math.ceil(NEAR_SHARE * len(terms) - 1e-9)
    return sorted(windows | set(np.argsort(rare, kind="stable")[: len(terms) - least + 1].tolist()))


def match_batch(doc_no: np.ndarray, term: np.ndarray, pos: np.ndarray, items: list[tuple[int, np.ndarray, list[int]]], run: int) -> list[tuple[int, int, int, float]]:
    """(document number, item id, longest run, share of words) of the diagonals on which items occur.

    The postings of the batch are sorted by term once; each item touches only the lists of its own terms.
    """
    order = np.lexsort((pos, doc_no, term))
    keys = (doc_no[order].astype(np.int64) << 32) | pos[order].astype(np.int64)
    sorted_terms = term[order]
    most = int(sorted_terms[-1]) + 2 if len(sorted_terms) else 1
    starts = np.searchsorted(sorted_terms, np.arange(most))
    listing = lambda t: keys[starts[t] : starts[t + 1]] if t + 1 < most else keys[:0]
    found: dict[tuple[int, int], tuple[int, float]] = {}
    for item, terms, anchors in items:
        cand = [listing(terms[o]) - o for o in anchors]
        cand = np.unique(np.concatenate(cand)) if cand else keys[:0]
        if not len(cand):
            continue
        hit = np.zeros((len(cand), len(terms) + 1), bool)
        for j, t in enumerate(terms):
            lst = listing(t)
            if len(lst):
                at = np.searchsorted(lst, cand + j)
                hit[:, j] = lst[np.minimum(at, len(lst) - 1)] == cand + j
        longest = np.zeros(len(cand), np.int32)
        now = np.zeros(len(cand), np.int32)
        for j in range(len(terms)):
            now = (now + 1) * hit[:, j]
            longest = np.maximum(longest, now)
        share = hit.sum(1) / len(terms)
        for i in np.flatnonzero((longest >= run) | (share >= NEAR_SHARE)):
            k = (int((cand[i] + (len(terms) << 1)) >> 32), item)
            old = found.get(k, (0, 0.0))
            found[k] = (max(old[0], int(longest[i])), max(old[1], float(share[i])))
    return [(d, i, r, s) for (d, i), (r, s) in found.items()]


def find_leaks(docs: DataFrame, items: DataFrame, run: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``doc_id``, ``item_id``, ``longest``, ``share``, ``kind``): phrase matches of ``run`` words or more, and proximity ones.

    ``kind`` is ``phrase`` where ``run`` consecutive item words stand in the document, else ``proximity``. Items of
    fewer than ``run`` words can't match. Null ids and texts match nothing, repeated rows count once, empty tables
    give no rows. The corpus is read once, into postings of all item words. The items are a stated query set: they are
    read in blocks of ``BLOCK_CHARS`` characters, each searched in all postings.
    """
    spark = docs.sparkSession
    use = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    out: DataFrame | None = None
    id_type = docs.schema[doc_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, longest int, share double"
    words = bloom.filter_of(use.select("t"), lambda b: term_hashes([w for t in b.column("t").to_pylist() for w in words_of(t)]))
    index = cut(index_postings(docs, doc_id, doc_text, words))
    counted = cut(index.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    for block in _blocks(use):
        listed = [(i, h) for i, t in block if len(h := term_hashes(words_of(t))) >= run]
        if not listed:
            continue
        terms = np.unique(np.concatenate([h for _, h in listed]))
        # a row per term of the block
        own = spark.createDataFrame(pa.table({"t": terms}))
        met = merged(counted).join(merged(own), "t").toArrow()
        freq = np.zeros(len(terms), np.int64)
        freq[np.searchsorted(terms, met.column("t").to_numpy())] = met.column("n").to_numpy()
        ids = [(i, np.searchsorted(terms, h).astype(np.int32)) for i, h in listed]
        shared = spark.sparkContext.broadcast((terms, [(i, x, anchors_of(x, freq, run)) for i, x in ids]))

        def search(batches, shared=shared):  # noqa: ANN001, ANN202
            for b in batches:
                vocabulary, of = shared.value
                sizes = b.column("terms").value_lengths().to_numpy()
                no = np.repeat(np.arange(b.num_rows), sizes)
                term, pos = (b.column(c).flatten().to_numpy() for c in ("terms", "pos"))
                local = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                here = vocabulary[local] == term
                got = match_batch(no[here], local[here].astype(np.int32), pos[here], of, run)
                at = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array([g[1] for g in got], b.schema.field("doc_id").type if item_type == id_type else None), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.float64())], names=["doc_id", "item_id", "longest", "share"])

        part = index.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("share").alias("share"))
    return best.withColumn("kind", F.when(F.col("longest") >= run, "phrase").otherwise("proximity"))


def _blocks(items: DataFrame):  # noqa: ANN202
    """Rows of the items in blocks of at most ``BLOCK_CHARS`` characters (a longer single item is its own block)."""
    block, size = [], 0
    for i, t in items.toLocalIterator():
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block
