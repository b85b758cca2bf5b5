"""Problem 4: token budgets by counting the best unigram segmentation.

The pieces of a public vocabulary go into a double-array trie. Segments of a text (words behind a space mark) are
counted by a Viterbi pass that keeps only the best score and its length, for all segments of a batch at once.
"""

from __future__ import annotations

import heapq
import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZERS = "/opt/tokenizers"
SPACE = "▁"
#: Segments a worker remembers; longer ones than this many characters are counted but not remembered.
REMEMBER, REMEMBER_LONGEST = 600_000, 48


class DoubleArray:
    """Trie over character codes in two arrays: from state s, character c leads to base[s] + c if check says so."""

    def __init__(self, words: dict[str, int]) -> None:
        seen = Counter(c for w in words for c in w)
        chars = sorted(seen, key=lambda c: (-seen[c], c))
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        nodes: list[dict[int, int]] = [{}]
        values = [-1]
        for w, v in words.items():
            s = 0
            for c in w:
                k = self.code[c]
                t = nodes[s].get(k)
                if t is None:
                    t = nodes[s][k] = len(nodes)
                    nodes.append({})
                    values.append(-1)
                s = t
            values[s] = v
        size = 2 * (len(nodes) + len(chars)) + 4
        base, check, value = [0] * size, [-1] * size, [-1] * size
        nxt = list(range(size + 1))  # nxt[x]: a free place at x or behind it, with path halving

        def free(x: int) -> int:
            while nxt[x] != x:
                nxt[x] = nxt[nxt[x]]
                x = nxt[x]
            return x

        place = {0: 0}
        check[0] = 0
        nxt[0] = 1
        # parents before children, and among those at hand the ones with many children first: they are hard to fit
        heap = [(-len(nodes[0]), 0)]
        while heap:
            _, n = heapq.heappop(heap)
            s = place[n]
            value[s] = values[n]
            kids = sorted(nodes[n])
            if not kids:
                continue
            p = free(kids[0] + 1)
            while True:
                b = p - kids[0]
                if b + kids[-1] >= len(check):
                    more = len(check)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                    nxt += range(len(nxt), len(nxt) + more)
                if all(check[b + k] < 0 for k in kids[1:]):
                    break
                p = free(p + 1)
            base[s] = b
            for k in kids:
                t = b + k
                check[t] = s
                nxt[t] = t + 1
                place[nodes[n][k]] = t
                heapq.heappush(heap, (-len(nodes[nodes[n][k]]), nodes[n][k]))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Unigram:
    """Count-only segmenter of a piece vocabulary with byte fallback.

    ``costs``: piece -> cost in nats. Characters that no piece covers cost ``fallback`` per UTF-8 byte, one token each.
    """

    def __init__(self, costs: dict[str, float], fallback: float) -> None:
        names = list(costs)
        self.cost = np.array([costs[w] for w in names], np.float32)
        self.trie = DoubleArray({w: i for i, w in enumerate(names)})
        self.longest = max(map(len, names))
        self.fallback = fallback
        self.known: dict[str, int] = {}

    def count_segments(self, segments: list[str]) -> np.ndarray:
        """Tokens of every segment: the length of its cheapest path (ties: the shorter one)."""
        out = np.zeros(len(segments), np.int64)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        a = 0
        while a < len(order):
            longest = len(segments[order[min(a + 4095, len(order) - 1)]])
            block = order[a : a + max(1, min(4096, 4_000_000 // max(longest, 1)))]
            a += len(block)
            out[block] = self._block([segments[i] for i in block])
        return out

    def _block(self, segs: list[str]) -> np.ndarray:
        T = max(map(len, segs), default=0)
        B = len(segs)
        if not T:
            return np.zeros(B, np.int64)
        get = self.trie.code.get
        codes = np.zeros((B, T), np.int32)
        width = np.zeros((B, T), np.int32)
        lens = np.array([len(s) for s in segs])
        for i, s in enumerate(segs):
            codes[i, : len(s)] = [get(c, 0) for c in s]
            width[i, : len(s)] = 1 if s.isascii() else [len(c.encode("utf-8", "surrogatepass")) for c in s]
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        # ring of costs and counts for the last positions would do; whole rows keep it plain
        best = np.full((B, T + 1), np.inf, np.float32)
        size = np.zeros((B, T + 1), np.int32)
        best[:, 0] = 0
        for i in range(T):
            live = np.flatnonzero(i < lens)
            here, n0 = best[live, i], size[live, i]
            # byte fallback over one character
            c1, n1 = here + self.fallback * width[live, i], n0 + width[live, i]
            self._better(best, size, live, i + 1, c1, n1)
            state = np.zeros(len(live), np.int32)
            for j in range(i, min(i + self.longest, T)):
                c = codes[live, j]
                t = base[state] + c
                ok = (c > 0) & (t < len(check)) & (j < lens[live])
                ok &= check[np.where(ok, t, 0)] == state
                ok &= base[state] > 0
                if not ok.all():
                    live, here, n0, t = live[ok], here[ok], n0[ok], t[ok]
                    if not len(live):
                        break
                state = t
                v = value[state]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    self._better(best, size, live[hit], j + 1, here[hit] + self.cost[v[hit]], n0[hit] + 1)
        return size[np.arange(B), lens].astype(np.int64)

    @staticmethod
    def _better(best: np.ndarray, size: np.ndarray, rows: np.ndarray, col: int, cost: np.ndarray, n: np.ndarray) -> None:
        old, oldn = best[rows, col], size[rows, col]
        take = (cost < old - 1e-4) | ((cost < old + 1e-4) & (n < oldn))
        at = rows[take]
        best[at, col] = cost[take]
        size[at, col] = n[take]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens per text; null and empty texts have none."""
        parts = [segments_of(t) if t else [] for t in texts]
        new = {s for p in parts for s in p if s not in self.known}
        extra: dict[str, int] = {}
        if new:
            listed = list(new)
            for s, n in zip(listed, self.count_segments(listed).tolist(), strict=True):
                if len(s) <= REMEMBER_LONGEST:
                    self.known[s] = n
                else:
                    extra[s] = n
        known = self.known
        out = np.array([sum(known[s] if s in known else extra[s] for s in p) for p in parts], np.int64)
        if len(known) > REMEMBER:
            known.clear()
        return out


def segments_of(text: str) -> list[str]:
    """A text as the vocabulary sees it: a space mark before every word, runs of spaces as marks of their own."""
    s = SPACE + text.replace(" ", SPACE)
    out = []
    i, n = 0, len(s)
    while i < n:
        j = i
        while j < n and s[j] == SPACE:
            j += 1
        if j - i > 1:
            out.append(s[i : j - 1] if j < n else s[i:j])
            i = j - 1 if j < n else j
            if i >= n:
                break
            j = i + 1
        k = s.find(SPACE, j)
        k = n if k < 0 else k
        out.append(s[i:k])
        i = k
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Unigram:
    """The pieces of a sentencepiece model as a unigram vocabulary.

    A unigram model's own scores are used as they are. A merge model has ranks for scores: a piece of rank r gets
    the cost log(r + 2), as if frequencies fell like 1 / r, so that the best path follows the same order.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
    ranks = min(scores) < -1000
    for i, score in enumerate(scores):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        p = sp.id_to_piece(i)
        r = -score
        pieces[p] = COST_SHIFT + float(np.log(min(r, len(scores)) + 2)) if ranks else float(r)
    return Unigram(pieces, COST_SHIFT + float(np.log(len(scores) + 2)) + 2.0)


#: Cost of any piece beside its rank: each further piece is paid for, so that long pieces win as merging lets them.
COST_SHIFT = 2.0


def count_tokens(df: DataFrame, text_col: str, out: str = "tokens", tokenizer: str = "piece_bpe_32k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the tokens of ``text_col`` as ``out``; null and empty texts have none. Other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(os.path.join(folder, f"{tokenizer}.model")))

    @F.arrow_udf("long")
    def run(v: pa.Array) -> pa.Array:
        return pa.array(shared.value.count(v.to_pylist()))

    return df.withColumn(out, run(F.col(text_col)))


def record_texts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(``row_id``, ``source``, ``kind``, ``lang``, ``domain``, ``text``) of the raw records, each once.

    The text joins the columns that the source names, in its order, by newlines, without null and blank ones.
    Source names are compared trimmed and in lower case; a record of an unknown source keeps its name and has a
    null kind and text. ``sources`` describes a fixed set of sources and is joined by broadcast only if it is small
    enough for the session's own threshold.
    """
    name = lambda c: F.lower(F.trim(F.col(c)))
    known = sources.select(name("name").alias("key"), F.col("name").alias("known"), F.col("kind"), F.col("text_columns")).where("key is not null").dropDuplicates(["key"])
    own = rows.select("row_id", F.col("source").alias("given"), name("source").alias("key"), "lang", "domain", *TEXT_COLUMNS).distinct()
    fields = F.create_map(*[x for c in TEXT_COLUMNS for x in (F.lit(c), F.col(c))])
    named = F.transform("text_columns", lambda c: F.try_element_at(fields, c))
    text = F.concat_ws("\n", F.filter(named, lambda t: t.isNotNull() & t.rlike(r"[^\s ]")))
    return own.join(known, "key", "left").select("row_id", F.coalesce("known", "given").alias("source"), "kind", "lang", "domain", F.when(F.col("text_columns").isNotNull(), text).alias("text"))


TEXT_COLUMNS = ("title", "text", "instruction", "response")


def token_budget(records: DataFrame, by: tuple[str, ...] = ("source", "kind", "lang", "domain"), **tokenizer: str) -> DataFrame:
    """``documents``, ``characters`` and ``tokens`` per slice of ``by``; null slice values form slices of their own."""
    counted = count_tokens(records.select(*by, "text"), "text", **tokenizer)
    return counted.groupBy(*by).agg(F.count_if(F.length(F.trim("text")) > 0).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.sum("tokens").alias("tokens"))
