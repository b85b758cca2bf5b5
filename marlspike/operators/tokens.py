"""Token arrays: offsets, shards, windows, padding, batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from marlspike.operators.ranks import BUCKETS, hash_bucket, range_bucket, ranked, running
from marlspike.session import merged, settled


def running_offsets(df: DataFrame, order: str, size: str, buckets: int = BUCKETS) -> DataFrame:
    """``offset`` of every row: the sizes of all rows before it by ``order``."""
    return running(df, [], range_bucket(df, order, buckets=buckets), [F.col(order)], {"offset": F.col(size)})


def shard_pieces(df: DataFrame, size: str, shard_size: int) -> DataFrame:
    """One row per (row, shard) that its tokens touch: ``shard``, ``start`` within the shard, ``n`` tokens."""
    a, b = F.col("offset"), F.col("offset") + F.col(size)
    first, last = F.floor(a / shard_size), F.floor((b - 1) / shard_size)
    out = df.where(F.col(size) > 0).withColumn("shard", F.explode(F.sequence(first, last)))
    lo = F.greatest(a, F.col("shard") * shard_size)
    return out.withColumn("start", lo - F.col("shard") * shard_size).withColumn("n", F.least(b, (F.col("shard") + 1) * shard_size) - lo)


def window_index(df: DataFrame, length: str, seq: int) -> DataFrame:
    """``start`` of the windows of ``seq`` + 1 tokens that overlap by one; rows too short for one have none."""
    return df.where(F.col(length) > seq).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length) - seq - 1, F.lit(seq).cast("long"))))


def example_ids(prompt: Column, answer: Column, eos: int, ignore: int = -100) -> tuple[Column, Column]:
    """Token ids of an example and its labels, in which the prompt is ignored."""
    end = F.array(F.lit(eos))
    return F.concat(prompt, answer, end), F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), answer, end)


def pad_to(ids: Column, size: int, pad: Column) -> Column:
    """An array of exactly ``size`` items, padded at the right."""
    return F.concat(F.slice(ids, 1, size), F.array_repeat(pad, F.greatest(F.lit(size) - F.size(ids), F.lit(0))))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def length_batches(df: DataFrame, order: Column, length: str, chunk: int, batch: int, group: str) -> DataFrame:
    """``batch`` numbers: rows of a group in seeded order are cut into chunks, sorted by length there and batched.

    ``order`` is a hexadecimal hash. A chunk has ``chunk * batch`` rows at most.
    """
    placed = ranked(df.withColumn("_h", order), [group], hash_bucket(F.col("_h")), [F.col("_h")], "_p")
    chunked = placed.withColumn("_c", F.floor(F.col("_p") / (chunk * batch)))
    r = F.row_number().over(Win.partitionBy(group, "_c").orderBy(length, "_h")) - 1
    return chunked.withColumn("batch", F.col("_c") * chunk + F.floor(r / batch)).drop("_c", "_h", "_p")


def fixed_batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """``batch`` of at most ``size`` rows within a key, in the order of a number."""
    return ranked(df, [by], range_bucket(df, order), [F.col(order)], "_p").withColumn("batch", F.floor(F.col("_p") / size)).drop("_p")


def train_flops_per_token(layers: Column, width: Column, vocab: Column) -> Column:
    return 6 * (layers * 12 * width * width + width * vocab)


def route(valid: Column, fits: Column, conf: Column, threshold: float) -> Column:
    """on_device for a valid, fitting, sure answer; else escalate. Nulls escalate."""
    return F.when(F.coalesce(valid & fits & (conf >= threshold), F.lit(False)), "on_device").otherwise("escalate")


def sample_windows(df: DataFrame, length: str, seq: int, draws: int, seed: int) -> DataFrame:
    """``draws`` window starts over all shards, each start equally likely; windows never span shards.

    The number of starts per shard is summed once. A draw is the md5 of its number; draws and shards meet by the
    bucket of their place, then by range.
    """
    starts = df.where(F.col(length) > seq).withColumn("_n", F.col(length) - seq)
    total = starts.agg(F.sum("_n")).first()[0]
    if not total:
        raise ValueError(f"no shard holds more than {seq} tokens")
    off = running_offsets(starts, "shard", "_n")
    width = max(1, -(-total // BUCKETS))
    spans = off.withColumn("_b", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("_n") - 1) / width))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint")
    at = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (draw % F.lit(total)).alias("at")).withColumn("_b", F.floor(F.col("at") / width))
    return at.join(spans, "_b").where((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("offset") + F.col("_n"))).select("draw", "shard", (F.col("at") - F.col("offset")).alias("start"))


def gather_windows(windows: DataFrame, shards: DataFrame, tokens: str, seq: int) -> DataFrame:
    """``windows`` (``shard``, ``start``) with ``window``, the ``seq`` + 1 tokens from there, from one row a shard.

    For windows drawn apart from the shards; all windows of a shard come from ``cut_windows`` without a join.
    """
    held = merged(shards.select("shard", F.col(tokens).alias("_t")))
    return windows.join(held, "shard").withColumn("window", settled(F.slice("_t", (F.col("start") + 1).cast("int"), seq + 1))).drop("_t")


def cut_windows(df: DataFrame, tokens: str, seq: int) -> DataFrame:
    """The windows of ``window_index``, ``start`` and ``window``, of every row, in place of its ``tokens``.

    Each row's windows are cut where its tokens are, so nothing moves, whatever its key; a row's work is in proportion
    to its tokens.
    """
    kept = [c for c in df.columns if c != tokens]
    # the tokens are read once for every window
    held = df.select(*kept, settled(F.col(tokens)).alias("_t")).where(F.size("_t") > seq)
    starts = F.sequence(F.lit(0).cast("long"), (F.size("_t") - seq - 1).cast("long"), F.lit(seq).cast("long"))
    cut_ = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("_t", (s + 1).cast("int"), seq + 1).alias("window")))
    return held.select(*kept, F.inline(cut_))


def shifted(ids: Column, labels: Column, size: int, pad: Column, ignore: int = -100) -> tuple[Column, Column]:
    """(inputs, targets) of a fixed size: inputs without the last token, targets without the first, padded at the right."""
    return pad_to(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), size, pad), pad_to(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), size, F.lit(ignore))


def prompt_ids(ids: Column, user: int, assistant: int) -> Column:
    """The tokens of a prompt between the marks of its two speakers."""
    return F.concat(F.array(F.lit(user)), ids, F.array(F.lit(assistant)))


def starts_with(ids: Column, prefix: Column) -> Column:
    """Whether an array begins with another one."""
    return F.slice(ids, 1, F.size(prefix)) == prefix


_LOADED: dict[str, object] = {}


def _tokenizer(path: str):  # noqa: ANN202
    """The tokenizer file at ``path``, loaded once per worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True  # their strings in a text are ordinary text
    return _LOADED[path]


def encoded(text: Column, path: str, eos: int | None = None) -> Column:
    """Token ids of a text by the tokenizer file at ``path``, closed by ``eos`` if given; a null text has none."""

    @F.arrow_udf("array<int>")
    def run(v: pa.Array) -> pa.Array:
        got = _tokenizer(path).encode_batch([x or "" for x in v.to_pylist()], add_special_tokens=False)
        return pa.array([x.ids + ([] if eos is None else [eos]) for x in got], pa.list_(pa.int32()))

    return F.when(text.isNotNull(), run(text))


def decoded(ids: Column, path: str) -> Column:
    """The text of token ids, special ones included; null stays null."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array(_tokenizer(path).decode_batch([x or [] for x in v.to_pylist()], skip_special_tokens=False), pa.string())

    return F.when(ids.isNotNull(), run(ids))


def token_counts(docs: DataFrame, source: str, text: str, tokens: str) -> DataFrame:
    """Documents, characters, bytes, words and tokens per source; the mark at a document's end is no token of it."""
    ws = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    return docs.groupBy(source).agg(F.count(text).alias("docs"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("utf8_bytes"), F.sum(F.size(ws)).alias("words"), F.sum(F.size(tokens)).cast("bigint").alias("tokens"))


def shard_arrays(docs: DataFrame, order: str, tokens: str, shard_size: int) -> DataFrame:
    """(``shard``, ``start``, ``tokens``): the pieces of all documents, in ``order``, cut at the bounds of shards."""
    sized = docs.select(order, F.col(tokens).alias("_t"), F.size(tokens).cast("bigint").alias("_n"))
    placed = shard_pieces(running_offsets(sized, order, "_n"), "_n", shard_size)
    begin = F.col("shard") * shard_size + F.col("start") - F.col("offset")
    return placed.select("shard", "start", F.slice("_t", (begin + 1).cast("int"), F.col("n").cast("int")).alias("tokens"))


def verify_shards(docs: DataFrame, shards: DataFrame, order: str, text: str, tokens: str, path: str, eos: int, vocab: int, sample: int, seed: int) -> DataFrame:
    """docs, eos, tokens, largest, checked, boundary, mismatched, ok: whether shards hold the documents they were made of.

    ``shards``: ``shard``, ``tokens``, in order and of bounded size. The marks ``eos`` number the documents; about
    ``sample`` of them, chosen by hash, and every one that a shard's bound cuts are put together from the shards and
    must decode to their text.
    """
    parts = shards.select("shard", F.col(tokens).alias("_t"), F.size(tokens).cast("bigint").alias("_n")).withColumn("_ends", F.filter(F.transform("_t", lambda x, i: F.when(x == eos, i)), lambda x: x.isNotNull()))
    w = Win.orderBy("shard").rowsBetween(Win.unboundedPreceding, -1)
    # one row per shard without its tokens: few rows whatever the corpus
    offs = parts.select("shard", "_n", F.size("_ends").alias("_e")).withColumn("_o", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_k", F.coalesce(F.sum("_e").over(w), F.lit(0))).select("shard", "_o", "_k")
    placed = parts.join(offs, "shard")
    # the runs of each shard between its marks: run j of a shard belongs to document _k + j
    first = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("_ends", j - 1) + 1)
    last = lambda j: F.coalesce(F.get("_ends", j), F.size("_t"))
    runs = placed.select("shard", "_k", F.explode(F.transform(F.sequence(F.lit(0), F.size("_ends")), lambda j: F.struct(j.alias("j"), F.slice("_t", first(j) + 1, last(j) - first(j)).alias("ids"), (j < F.size("_ends")).alias("closed")))).alias("r"))
    pieces = runs.select((F.col("_k") + F.col("r.j")).cast("bigint").alias("k"), "shard", F.col("r.ids").alias("ids"), F.col("r.closed").alias("closed"))
    numbered = ranked(docs.select(order, F.col(text).alias("_text")), [], range_bucket(docs, order), [F.col(order)], "k")
    total = docs.count()
    share = min(1.0, sample / max(total, 1))
    cut_ = pieces.groupBy("k").agg(F.count(F.lit(1)).alias("_p"), F.max("closed").alias("_c"))
    chosen = cut_.where(F.col("_c") & ((F.col("_p") > 1) | (F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))))
    # pieces of one document: bounded by its length
    whole = pieces.join(chosen.select("k", "_p"), "k").groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "ids"))), lambda x: x["ids"])).alias("ids"), F.max("_p").alias("_p"))
    checked = whole.join(numbered, "k", "left").select("_p", (~decoded(F.col("ids"), path).eqNullSafe(F.col("_text"))).alias("bad"))
    one = checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_p") > 1).alias("boundary"), F.count_if("bad").alias("mismatched"))
    two = parts.agg(F.coalesce(F.sum(F.size("_ends")), F.lit(0)).alias("eos"), F.coalesce(F.sum("_n"), F.lit(0)).alias("tokens"), F.max(F.array_max("_t")).alias("largest"))
    out = two.unionByName(one, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("eos", "tokens", "largest", "checked", "boundary", "mismatched")]).withColumn("docs", F.lit(total).cast("bigint"))
    return out.withColumn("ok", (F.col("docs") == F.col("eos")) & (F.coalesce("largest", F.lit(0)) < vocab) & (F.col("mismatched") == 0))


def pre_tokens(c: Column, letters_with_digits: bool = False) -> Column:
    """Pieces of a text before merging: words with a leading blank, digits by threes, other runs, white space.

    ``letters_with_digits`` keeps a digit between letters inside its word, as Arabizi writes sounds.
    """
    word = r" ?\p{L}[\p{L}\p{M}]*"
    if letters_with_digits:
        word = r" ?(?:\p{N}(?=\p{L}))?\p{L}(?:[\p{L}\p{M}]|\p{N}(?=\p{L})|[2356789](?![\p{N}]))*"
    return F.regexp_extract_all(c, F.lit(rf"({word}|\p{{N}}{{1,3}}| ?[^\s\p{{L}}\p{{N}}]+|\s+)"))
