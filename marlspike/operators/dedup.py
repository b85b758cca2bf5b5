"""Exact and near-duplicate removal with a defined row order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from marlspike.operators.components import connected_components
from marlspike.operators.pairs import key_pairs
from marlspike.session import cut, merged, settled

#: Counters per set in the bound of ``close_classes``, and sets and items that one broadcast block of the fixed side
#: holds about. All give the same result.
FOLD = 2048
FIXED_BLOCK = 4096
FIXED_ITEMS = FIXED_BLOCK * 512
#: Links of one component that one task settles in memory; larger components shrink by rounds first.
COMPONENT_LINKS = 200_000
#: Losing rows that are sent to every task instead of being joined.
FEW = 500_000


def text_key(c: Column) -> Column:
    """Key of case-insensitive equality: only 32 hex digits travel in the shuffle."""
    return F.md5(F.lower(c))


def exact_dedup(df: DataFrame, text: str, order: str, among: Column | None = None) -> DataFrame:
    """``df`` with ``first``: whether a row is the first of its text by ``order``; false outside ``among``.

    Only the order column and the key of the text travel. The first row of every key comes from a partial minimum,
    and the others are told by their order, so a text that a third of all rows share is not gathered in one task.
    A null text is no text's copy and no first.
    """
    key = text_key(F.col(text))
    keyed = df.select(order, (key if among is None else F.when(among, key)).alias("_k"))
    firsts = keyed.where("_k is not null").groupBy("_k").agg(F.min(order).alias(order)).select(order)
    others = cut(merged(keyed.select(order)).join(merged(firsts), order, "left_anti").select(order, F.lit(True).alias("_o")))
    few = others.count() <= FEW
    return df.join(F.broadcast(others) if few else merged(others), order, "left").withColumn("first", F.col("_o").isNull()).drop("_o")


def merge_sources(df: DataFrame, text: str, rank: str, order: str, allowed: Column) -> DataFrame:
    """``reason`` per row: wrong_lang where ``allowed`` is false, duplicate behind the first allowed copy, else kept."""
    place = F.struct(rank, order)
    keyed = df.withColumn("_k", text_key(F.col(text))).withColumn("_ok", F.coalesce(allowed, F.lit(False))).withColumn("_p", place)
    firsts = keyed.where("_ok").groupBy("_k").agg(F.min("_p").alias("_f"))
    out = keyed.join(firsts, "_k", "left")
    return out.withColumn("reason", F.when(~F.col("_ok"), "wrong_lang").when(F.col("_p") == F.col("_f"), "kept").otherwise("duplicate")).drop("_k", "_ok", "_p", "_f")


def lower_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"\s+", " "), " "), lambda w: w != "")


def shingles_of(ws: Column, k: int) -> Column:
    """Distinct sequences of ``k`` words of an array; all words as one where there are fewer."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, k), " "))
    return F.array_distinct(many)


def shingled(df: DataFrame, key: str, text: Column, k: int) -> DataFrame:
    """(``id``, ``s``): the word sequences of every text."""
    return df.select(F.col(key).alias("id"), settled(lower_words(text)).alias("_w")).select("id", settled(shingles_of(F.col("_w"), k)).alias("s"))


def char_grams(c: Column, n: int) -> Column:
    """Distinct sequences of ``n`` characters of the padded lower-cased text."""
    t = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(n))))


def similar_pairs(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(``a``, ``b``) with ``a < b``: the representatives whose sets reach a Jaccard similarity of ``num/den``; exact.

    ``classes``: ``rep``, ``n``, ``h``, one row per distinct set, materialised. Prefix filter: with items ordered from
    rare to common, two alike sets share one of their first n - ceil(n * num / den) + 1 items. Sizes and places are
    compared in the join, which cuts hot items into blocks.
    """
    one = classes.select(F.col("rep").alias("id"), "n", F.explode("h").alias("x"))
    seen = one.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = merged(one).join(merged(seen), "x", "left").withColumn("r", F.row_number().over(Win.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "x")))
    need = F.floor((F.col("n") * num + (den - 1)) / den)
    post = ranked.where((F.col("r") <= F.col("n") - need + 1) & F.col("df").isNotNull()).select(F.col("x").alias("key"), F.col("id").alias("g"), "n", F.col("r").alias("p"))
    na, nb, pa_, pb = (F.col(c) for c in ("na", "nb", "pa", "pb"))
    both = F.floor(((na + nb) * num + (num + den - 1)) / (num + den))
    cand = key_pairs(post, None, (na * num <= nb * den) & (nb * num <= na * den) & (F.lit(1) + F.least(na - pa_, nb - pb) >= both))
    ha, hb = (merged(classes.select(F.col("rep").alias(f"c{s}"), F.col("h").alias(f"h{s}"))) for s in "ab")
    common, total = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
    found = merged(merged(cand).join(ha, "ca")).join(hb, "cb").where(common * (num + den) >= total * num)
    return found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def near_duplicates(sets: DataFrame, key: str, items: str, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs ``a`` < ``b`` of alike class representatives, members ``id``, ``rep``); both materialised.

    Rows of equal sets form a class, whose representative is the smallest id. Null and empty sets form none.
    """
    hashed = hashed_sets(sets, key, items)
    classes = cut(hashed.groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("h").alias("h")))
    members = cut(merged(hashed.select("id", "cls")).join(merged(classes.select("cls", "rep")), "cls").select("id", "rep"))
    return cut(similar_pairs(classes, num, den)), members


def near_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``id``, ``rep`` and ``links`` of every row with a copy or a link: its class and the other classes linked to it."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    classes = merged(sizes).join(merged(ends), "rep", "left").where("size > 1 or links is not null").select("rep", F.coalesce("links", F.lit(0)).alias("links"))
    return merged(members).join(merged(classes), "rep").select("id", "rep", "links")


def greedy_keep(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id``, ``keep``: a row is dropped if and only if an earlier kept row is alike to it.

    ``pairs``: ``a < b``. A dropped row never drops another. Up to ``COMPONENT_LINKS`` links are settled in order by one
    task. More fall apart into components, which don't touch each other, each of up to so many is settled by a task. Of larger ones a round settles the
    rows without an open smaller neighbour, and what is left is split again; rounds go on until no link is open.
    """
    open_ = cut(pairs.select("a", "b").distinct())
    kind = open_.schema["a"].dataType.simpleString()
    lost: list[DataFrame] = []
    while links := open_.count():
        if links <= COMPONENT_LINKS:
            lost.append(cut(open_.groupBy(F.lit("").alias("_")).applyInPandas(_dropped, f"v {kind}")))
            break
        labels = cut(connected_components(open_.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        tagged = merged(open_).join(merged(labels.select(F.col("v").alias("a"), "label")), "a")
        sizes = tagged.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        small = sizes.where(F.col("_n") <= COMPONENT_LINKS).select("label")
        lost.append(cut(merged(tagged).join(merged(small), "label", "left_semi").groupBy("label").applyInPandas(_dropped, f"v {kind}")))
        rest = cut(merged(tagged).join(merged(small), "label", "left_anti").select("a", "b"))
        if rest.isEmpty():
            break
        larger = rest.select(F.col("b").alias("v")).distinct()
        kept = rest.select(F.col("a").alias("v")).distinct().join(larger, "v", "left_anti")
        gone = cut(merged(rest).join(merged(kept.withColumnRenamed("v", "a")), "a", "left_semi").select(F.col("b").alias("v")).distinct())
        lost.append(gone)
        settled_ = gone.unionByName(kept)
        open_ = cut(merged(merged(rest).join(merged(settled_.withColumnRenamed("v", "a")), "a", "left_anti")).join(merged(gone.withColumnRenamed("v", "b")), "b", "left_anti"))
    all_ids = ids.select("id").distinct()
    if not lost:
        return all_ids.withColumn("keep", F.lit(True))
    out = lost[0]
    for x in lost[1:]:
        out = out.unionByName(x)
    return merged(all_ids).join(merged(out.distinct().select(F.col("v").alias("id"), F.lit(True).alias("_d"))), "id", "left").select("id", F.col("_d").isNull().alias("keep"))


def _dropped(links: pd.DataFrame) -> pd.DataFrame:
    """The rows of one component that an earlier kept row drops."""
    earlier: dict = {}
    for a, b in zip(links["a"], links["b"], strict=True):
        earlier.setdefault(b, []).append(a)
    out: set = set()
    for b in sorted(earlier):
        if any(a not in out for a in earlier[b]):
            out.add(b)
    return pd.DataFrame({"v": sorted(out)})


def near_duplicates_kept(sets: DataFrame, key: str, items: str, num: int, den: int) -> DataFrame:
    """``id``, ``keep`` of every row of ``sets``: greedy removal over classes; of a class no more than its first stays.

    A copy of a kept row is dropped by it, one of a dropped row by what dropped that; rows without a set stay.
    """
    pairs, members = near_duplicates(sets, key, items, num, den)
    reps = greedy_keep(members.select(F.col("rep").alias("id")), pairs).select(F.col("id").alias("rep"), F.col("keep").alias("_keep"))
    known = merged(members).join(merged(reps), "rep").select("id", ((F.col("id") == F.col("rep")) & F.col("_keep")).alias("_k"))
    return merged(sets.select(F.col(key).alias("id")).distinct()).join(merged(known), "id", "left").select("id", F.coalesce("_k", F.lit(True)).alias("keep"))


def hashed_sets(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(``id``, ``h``, ``n``, ``cls``) of the non-empty sets: sorted hashes, their number, a key of the whole set."""
    hashed = sets.select(F.col(key).alias("id"), settled(F.array_sort(F.array_distinct(F.transform(items, lambda x: F.xxhash64(x))))).alias("h"))
    return hashed.withColumn("n", F.size("h")).where("n > 0").withColumn("cls", F.md5(F.array_join(F.col("h").cast("array<string>"), " ")))


def set_classes(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(``cls``, ``rep``, ``n``, ``h``): one row per distinct non-empty set, with its smallest ``key``."""
    hashed = hashed_sets(sets, key, items)
    return hashed.groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("h").alias("h"))


def close_classes(new: DataFrame, fixed: DataFrame, num: int, den: int) -> DataFrame:
    """(``cls``) of ``new`` with a Jaccard similarity of ``num/den`` or more to a row of ``fixed``; exact.

    Both: ``cls``, ``n``, ``h``; materialised. Short character sequences are too common for prefixes to leave pairs out,
    so all pairs are bounded instead: items fold into ``FOLD`` counters, and the product of two rows of counters is never less than
    their overlap. What passes is counted exactly. ``fixed`` is read in blocks of about ``FIXED_BLOCK`` sets and
    ``FIXED_ITEMS`` items.
    """
    spark = new.sparkSession
    sets, total = fixed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-sets // FIXED_BLOCK), -(-total // FIXED_ITEMS))
    out = new.select("cls").limit(0)
    for i in range(blocks if sets else 0):
        got = fixed.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == i).select("h").toArrow().column("h").combine_chunks()
        block = spark.sparkContext.broadcast((got.flatten().to_numpy(), np.diff(got.offsets.to_numpy())))
        out = out.unionByName(cut(new.select("cls", "h").mapInArrow(_close_to(block, num, den), "cls string")))
        block.destroy()
    return out.distinct()


def _close_to(block, num: int, den: int):  # noqa: ANN001, ANN202
    def close(batches):  # noqa: ANN001, ANN202
        flat, sizes = block.value
        vocab, at, df = np.unique(flat, return_inverse=True, return_counts=True)
        # the most common items get counters of their own
        place = np.empty(len(vocab), np.int64)
        place[np.argsort(-df, kind="stable")] = np.arange(len(vocab)) % FOLD
        ends = np.cumsum(sizes)
        own = np.split(at, ends[:-1])
        # by size, so that rows meet only the stretch of sets whose size can be near enough
        by_size = np.argsort(sizes, kind="stable")
        own, ordered = [own[i] for i in by_size], sizes[by_size]
        known = np.zeros((len(sizes), FOLD), np.float32)
        np.add.at(known, (np.repeat(np.argsort(by_size), sizes), place[at]), 1)
        for b in batches:
            lists = b.column("h")
            flat_b, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            offs = offs - offs[0]
            hit = np.zeros(b.num_rows, bool)
            n_all = np.diff(offs)
            turn = np.argsort(n_all, kind="stable")
            for lo in range(0, b.num_rows, 256):
                rows_at = turn[lo : lo + 256]
                n = n_all[rows_at]
                first, last = np.searchsorted(ordered, -(-n[0] * num // den)), np.searchsorted(ordered, n[-1] * den // num, side="right")
                if first >= last:
                    continue
                rows = np.repeat(np.arange(len(n)), n)
                items = flat_b[np.arange(len(rows)) - np.repeat(np.cumsum(n) - n - offs[rows_at], n)]
                pos = np.minimum(np.searchsorted(vocab, items), len(vocab) - 1)
                there = vocab[pos] == items
                mine, rows = pos[there], rows[there]
                counts = np.bincount(rows * FOLD + place[mine], minlength=len(n) * FOLD).astype(np.float32).reshape(len(n), FOLD)
                bound = counts @ known[first:last].T
                need = (n[:, None] + ordered[None, first:last]) * num
                maybe = bound * (num + den) >= need
                cut_ = np.searchsorted(rows, np.arange(len(n) + 1))
                for r in np.flatnonzero(maybe.any(1)):
                    has = np.zeros(len(vocab), bool)
                    has[mine[cut_[r] : cut_[r + 1]]] = True
                    for j in np.flatnonzero(maybe[r]):
                        if has[own[first + j]].sum() * (num + den) >= need[r, j]:
                            hit[rows_at[r]] = True
                            break
            yield pa.RecordBatch.from_arrays([b.column("cls").filter(pa.array(hit))], names=["cls"])

    return close


def near_copies(new: DataFrame, fixed: DataFrame, key: str, exact: str, items: str, num: int, den: int) -> DataFrame:
    """(``key``, ``kind``) of the rows of ``new`` that repeat ``fixed``: exact by ``exact``, else near by ``items``."""
    same = new.join(fixed.select(exact).distinct(), exact, "left_semi").select(key, F.lit("exact").alias("kind"))
    rest = cut(hashed_sets(new.join(same.select(key), key, "left_anti"), key, items))
    classes = cut(rest.groupBy("cls").agg(F.first("h").alias("h")))
    close = close_classes(classes, cut(set_classes(fixed, key, items)), num, den)
    near = rest.join(close, "cls", "left_semi").select(F.col("id").alias(key), F.lit("near").alias("kind"))
    return same.unionByName(near)


def new_only(new: DataFrame, seen: DataFrame, text: str, order: str) -> DataFrame:
    """The rows of ``new`` whose text neither stands in ``seen`` nor before them in ``new``."""
    fresh = exact_dedup(new, text, order).where("first").drop("first")
    key = text_key(F.col(text))
    known = seen.select(key.alias("_k")).distinct()
    return fresh.withColumn("_k", key).join(known, "_k", "left_anti").drop("_k")


def decontaminate(train: DataFrame, held: DataFrame, key: str, exact: str, items: str, num: int, den: int) -> DataFrame:
    """``train`` without the rows that repeat a held-out row exactly or nearly."""
    hit = near_copies(train, held, key, exact, items, num, den).select(key).distinct()
    return train.join(hit, key, "left_anti")


def overlaps(test: DataFrame, train: DataFrame, cap: int, num: int, den: int, most: int = 3) -> DataFrame:
    """(``id``, ``kind``, ``path``): test rows that stand in ``train``, exactly or, if not, nearly.

    Both: ``id``, ``text`` (raw), ``key`` (canonical), ``items``; ``train`` also ``path`` and ``near`` (whether its
    near copies count). Training texts longer than ``cap`` times the longest test text can't be copies and are left
    out. ``path`` is the first path of an exact copy, null for a near one.
    """
    longest = test.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
    use = train.where(F.length("text") <= cap * longest)
    firsts = use.groupBy("key").agg(F.min("path").alias("path"))
    exact = test.select("id", "key").join(firsts, "key").select("id", F.lit("exact").alias("kind"), "path")
    rest = test.join(exact.select("id"), "id", "left_anti")
    near = near_copies(rest, use.where("near"), "id", "key", "items", num, den).where("kind = 'near'")
    return exact.unionByName(near.select("id", "kind", F.lit(None).cast("string").alias("path")))


def fetch_plan(df: DataFrame, text: str, rank: str, order: str) -> DataFrame:
    """The rows that sampling starts from: of equal texts the one of the first source, before any source is sampled."""
    firsts = df.where(F.col(text).isNotNull()).groupBy(text_key(F.col(text)).alias("_k")).agg(F.min(F.struct(rank, order)).alias("_f"))
    chosen = firsts.select(F.col("_f")[rank].alias(rank), F.col("_f")[order].alias(order))
    return df.join(chosen, [rank, order], "left_semi")


def example_reasons(rows: DataFrame, text: str, order: str, allowed: Column, examples: list[str], max_jaccard: float) -> DataFrame:
    """``reason`` per row: duplicate, then wrong_lang, then example_copy, else kept."""
    firsts = exact_dedup(rows, text, order)
    return firsts.withColumn("reason", F.when(~F.col("first"), "duplicate").when(~F.coalesce(allowed, F.lit(False)), "wrong_lang").when(example_copies(rows, examples, text, max_jaccard), "example_copy").otherwise("kept")).drop("first")


def example_copies(rows: DataFrame, examples: list[str], text: str, max_jaccard: float) -> Column:
    """Whether a text shares more than ``max_jaccard`` of its words with one of the given prompt examples."""
    from marlspike.functions.text import jaccard, plain_words

    own = plain_words(F.col(text))
    out = F.lit(False)
    for e in examples:
        out = out | (jaccard(own, plain_words(F.lit(e))) >= max_jaccard)
    return out
