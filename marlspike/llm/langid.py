"""Problem 5: languages of documents and of their segments, by a byte convolutional network.

Filters of several widths run over the bytes of a text, are pooled over fixed-length windows and give each window a
distribution over languages. Words take the mean of the windows over them; a Viterbi pass over the words yields
segments. The network is trained in numpy on a bounded, balanced sample of labelled texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlspike.llm import lexicon, pii

LANGS = ("en", "ar", "arabizi", "fr", "ur", "tl")
#: Window and stride in bytes; embedding size, filters per width, widths.
WINDOW, STRIDE, EMBED, FILTERS, WIDTHS = 32, 8, 8, 16, (2, 3, 4)
#: Labelled texts per language and column that the network is trained on, and as many of those under ``BRIEF``
#: characters: the bound on the sample.
SAMPLE_TEXTS, BRIEF = 500, 24
#: Rows of one text from which its labels outvote each other, and the share of them that settles its label.
VOTES, MAJORITY = 5, 0.6
#: Windows of random function words per language of the lexicon, with which training starts, and windows of a few
#: words of each text.
LEXICON_WINDOWS, SHORT_WINDOWS = 500, 2
#: Words that a clause needs to count as a language of the text, and the cost of a change of language in nats.
CLAUSE_WORDS, SWITCH = 4, 4.0
#: Confidence that a second language of a text needs.
SECOND = 0.62

# Spellings of labels.
_SPELLINGS = {
    "en": "en eng english en-us en-gb anglais inglés الانجليزية",
    "ar": "ar ara arabic ar-ae ar-sa ar-eg arabe العربية عربي",
    "arabizi": "arabizi ar-latn ara-latn arabish franco",
    "fr": "fr fra fre french fr-fr fr-ca français francais",
    "ur": "ur urd urdu ur-pk ur-in اردو",
    "tl": "tl tgl fil tagalog filipino tl-ph fil-ph",
    "mixed": "mixed mix mul multi multiple multilingual",
}
SPELLINGS = {w: k for k, v in _SPELLINGS.items() for w in v.split()}
MISSING = ("", "und", "unknown", "none", "null", "n/a")


def label_column(c: str):  # noqa: ANN201
    """The language that a label names in any spelling; "" for a missing label, "?" for an unknown one."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), "_", "-")
    table = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    head = F.regexp_extract(low, "^([a-z]{2,3})-[a-z]{2}$", 1)
    return F.when(low.isin(*MISSING), "").otherwise(F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.when(head != "", head)), F.lit("?")))


# Phrases of four words or more that only introduce personal data.
_CUE = re.compile(r"\b(?:is where you reach me|you can reach me (?:at|on)|my (?:e-?mail )?address is|my phone number is|please call me (?:at|on)|the account is under|raqm el hwiya|el 7sab besm)\b", re.I)
_NUMBER_WORDS = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)(?: (?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)){4,}\b", re.I)
_ADDRESS_HINTS = ("bldg ", "villa", "flat ", "house no", "p.o", "p. o", "sha2a", "share3", " road", " street", "شارع", "سكة", "ص.ب")
CLAUSE = re.compile(r"[.!?؟۔;:,،]+(?=\s|$)|\s[/–—\-]+\s|\n")
#: Placeholders, links, addresses, whatever holds two digits in a row or stands as a lone number, and capitalised
#: words inside a sentence: names, codes, measures.
_OUT = re.compile(r"<[^<>\n]{1,20}>|(?<!\S)(?:\S*\d\d\S*|[#(+]?\d(?:[^\w\s]\d?)*(?:am|pm|GB|MB)?(?!\S)|[A-Z]{2,}\b)|(?<=[\w,] )(?!I\b)[A-Z]\S*")
_LINKS = re.compile(r"(?<!\S)\S*(?:@|://|www\.|\(at\)|\[at\])\S*")
_KEEP = re.compile(r"[^\w'’\n]+|_")


def clauses_of(text: str) -> list[str]:
    """The clauses of a text in lower case, with only the words that speak for a language; empty ones stay as places."""
    t = pii.plain(text)
    if not t.isascii():
        t = t.translate(pii._DROP)
    low = t.lower()
    if "@" in t or "dot" in low:
        t = _LINKS.sub(" ", pii.EMAIL.sub(" ", t))
    elif "://" in t or "www." in low:
        t = _LINKS.sub(" ", t)
    if "zero" in low:
        t = _NUMBER_WORDS.sub(" ", t)
    if any(h in low for h in _ADDRESS_HINTS) and any(c in low for c in "0123456789"):
        t = pii.ADDRESS.sub(" ", t)
    if " me" in low or "my " in low or " el " in low or "under" in low:
        t = _CUE.sub(" ", t)
    if t.isupper():
        t = t.lower()
    t = CLAUSE.sub("\n", t)
    return _KEEP.sub(" ", _OUT.sub(" ", t).lower()).split("\n")


def _codes() -> np.ndarray:
    """Byte -> one of ``ALPHABET`` codes: the bytes of lower-cased words in the scripts at hand, and one for all others."""
    used = [0, 32, 39, *range(48, 58), *range(97, 123), *range(0x80, 0xC0), 0xC2, 0xC3, 0xC4, 0xC5, 0xD8, 0xD9, 0xDA, 0xDB, 0xE2]
    out = np.full(256, len(used), np.int32)
    out[used] = np.arange(len(used))
    return out


CODES = _codes()
ALPHABET = int(CODES.max()) + 1


class Network:
    """Embedding, filters of three widths, max pooling over a window, softmax."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.E = (rng.standard_normal((ALPHABET, EMBED)) * 0.3).astype(np.float32)
        self.E[0] = 0
        self.W = [(rng.standard_normal((w * EMBED, FILTERS)) * (1.0 / np.sqrt(w * EMBED))).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.V = (rng.standard_normal((len(WIDTHS) * FILTERS, len(LANGS))) * 0.1).astype(np.float32)
        self.c = np.zeros(len(LANGS), np.float32)
        self.tables: list[np.ndarray] = []

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross entropy with label smoothing, at a fifth of the rate in the last epoch; ``windows`` (n, WINDOW) bytes."""
        rng = np.random.default_rng(seed)
        params = [self.E, self.V, self.c, *self.W, *self.b]
        m1 = [np.zeros_like(p) for p in params]
        m2 = [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            if epoch and epoch == epochs - 1:
                rate /= 5
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                x = CODES[windows[rows]]
                B = len(rows)
                e = self.E[x]
                pooled, where, cols = [], [], []
                for w, W, bias in zip(WIDTHS, self.W, self.b, strict=True):
                    u = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(B, WINDOW - w + 1, w * EMBED)
                    r = u @ W + bias
                    at = r.argmax(1)
                    pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
                    where.append(at)
                    cols.append(u)
                h = np.concatenate(pooled, 1)
                act = np.maximum(h, 0)
                z = act @ self.V + self.c
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                t = np.full_like(p, 0.08 / len(LANGS))
                t[np.arange(B), y[rows]] += 0.92
                g = (p - t) / B
                gV, gc = act.T @ g, g.sum(0)
                gh = (g @ self.V.T) * (h > 0)
                gW, gb, codes, parts = [], [], [], []
                for i, w in enumerate(WIDTHS):
                    gi = gh[:, i * FILTERS : (i + 1) * FILTERS]
                    u = cols[i][np.arange(B)[:, None], where[i]]  # (B, FILTERS, w * EMBED)
                    gW.append(np.einsum("bf,bfd->df", gi, u))
                    gb.append(gi.sum(0))
                    back = gi[:, :, None] * self.W[i].T[None]
                    for j in range(w):
                        codes.append(x[np.arange(B)[:, None], where[i] + j].ravel())
                        parts.append(back[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
                code, part = np.concatenate(codes), np.concatenate(parts)
                gE = np.stack([np.bincount(code, weights=part[:, k], minlength=ALPHABET) for k in range(EMBED)], 1).astype(np.float32)
                gE[0] = 0
                step += 1
                for k, (q, gr) in enumerate(zip(params, [gE, gV, gc, *gW, *gb], strict=True)):
                    m1[k] = 0.9 * m1[k] + 0.1 * gr
                    m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
                    q -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)
        self.freeze()

    def freeze(self) -> None:
        """Filters as sums of table rows: two neighbouring bytes index one row."""
        one = [[self.E @ W[j * EMBED : (j + 1) * EMBED] for j in range(w)] for w, W in zip(WIDTHS, self.W, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(ALPHABET * ALPHABET, FILTERS)
        # first pair of all three widths side by side, then what the wider filters add
        self.tables = [
            np.concatenate([pair(one[i][0], one[i][1]) + self.b[i] for i in range(3)], 1).astype(np.float32),
            np.concatenate([pair(one[1][2], np.zeros_like(one[1][2])), pair(one[2][2], one[2][3])], 1).astype(np.float32),
        ]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Log probabilities per stride of a byte string (padded with zeros by WINDOW at its end)."""
        n = (len(data) - 3) // STRIDE * STRIDE
        d = CODES[data]
        pairs = d[:-1] * ALPHABET + d[1:]
        k = WINDOW // STRIDE
        pooled = np.empty((n // STRIDE, FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, n, 65_536):  # blocks that fit the cache
            e = min(a + 65_536, n)
            r = self.tables[0][pairs[a:e]]
            r[:, FILTERS:] += self.tables[1][pairs[a + 2 : e + 2]]
            pooled[a // STRIDE : e // STRIDE] = r.reshape(-1, STRIDE, r.shape[1]).max(1)
        w = pooled[: len(pooled) - k + 1].copy()
        for j in range(1, k):
            np.maximum(w, pooled[j : len(pooled) - k + 1 + j], out=w)
        z = np.maximum(w, 0) @ self.V + self.c
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def training_windows(texts: list[tuple[str, str]], seed: int = 9, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` windows per (label, text), at random places of its clauses."""
    rng = np.random.default_rng(seed)
    out, y = [], []
    for label, text in texts:
        parts = [d for c in clauses_of(text) if len(d := " ".join(c.split()).encode()) >= 2]
        if not parts:
            continue
        k = LANGS.index(label)
        for _ in range(min(most, 1 + sum(map(len, parts)) // WINDOW)):
            data = parts[int(rng.integers(len(parts)))]
            a = int(rng.integers(0, max(1, len(data) - WINDOW // 2)))
            part = data[a : a + WINDOW]
            out.append(np.frombuffer(part + bytes(WINDOW - len(part)), np.uint8))
            y.append(k)
        # short messages are rare among distinct texts: a few words of longer ones teach them
        for _ in range(SHORT_WINDOWS):
            ws = parts[int(rng.integers(len(parts)))].split()
            i, n = int(rng.integers(len(ws))), int(rng.integers(1, 5))
            part = b" ".join(ws[i : i + n])[:WINDOW]
            out.append(np.frombuffer(part + bytes(WINDOW - len(part)), np.uint8))
            y.append(k)
    for label, words in lexicon.WORDS.items():
        own = sorted(set(words) - lexicon.SHARED)
        for _ in range(LEXICON_WINDOWS):
            part = " ".join(rng.choice(own, int(rng.integers(1, 5)))).encode()[:WINDOW]
            out.append(np.frombuffer(part + bytes(WINDOW - len(part)), np.uint8))
            y.append(LANGS.index(label))
    return np.array(out), np.array(y)


def train(texts: list[tuple[str, str, bool]]) -> Network:
    """A network from (label, text, whether the label is settled) with noisy labels.

    Each half of the texts fits a network, which judges the labels of the other half; a text teaches the final
    network where its label is settled, or the one language that the other half's network finds in it.
    """
    order = np.random.default_rng(13).permutation(len(texts))
    halves = [[texts[i] for i in order[h::2]] for h in (0, 1)]
    kept: list[tuple[str, str]] = []
    for one, other in (halves, halves[::-1]):
        net = Network()
        net.fit(*training_windows([(k, t) for k, t, _ in one]), epochs=2)
        given = [t for _, t, _ in other]
        mask, _ = document_languages(analyse(net, given))
        want = np.array([LANGS.index(k) for k, _, _ in other], int)
        right = (mask.sum(1) == 1) & (mask.argmax(1) == want) if len(other) else []
        for (k, t, sure), ok in zip(other, right, strict=True):
            kept += [(k, t)] * (VOTES if sure else int(ok))
    net = Network()
    net.fit(*training_windows(kept))
    return net


def labelled_sample(df: DataFrame, text_col: str, label_col: str, per: int = SAMPLE_TEXTS) -> list[tuple[str, str, bool]]:
    """(label, text, settled): at most ``per`` texts of each language, and as many brief ones, by the hash of the text
    over the whole table.

    An estimate of the number of distinct texts bounds the hash values from which they are taken. A text has the label
    that most of its rows give it; it is settled where ``VOTES`` rows or more agree well enough.
    """
    base = df.select(label_column(label_col).alias("l"), F.col(text_col).alias("t")).where(F.col("l").isin(*LANGS) & (F.length("t") >= 2))
    base = base.withColumn("h", F.xxhash64("t")).withColumn("s", F.length("t") < BRIEF)
    sizes = {(r["s"], r["l"]): r["n"] for r in base.groupBy("s", "l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    # twice the share of the hash values that is expected to hold the wanted number: a bounded number of rows, whatever
    # the table. Brief texts, whose labels are counted, are taken by one share for all languages.
    share = lambda n: min(1.0, 2 * per / max(n, 1))
    brief = share(max((n for (s, _), n in sizes.items() if s), default=0))
    longer = [F.when(F.col("l") == k, share(n)) for (s, k), n in sizes.items() if not s]
    most = F.when(F.col("s"), brief).otherwise(F.coalesce(*longer, F.lit(0.0)))
    few = base.where(F.col("h") / F.lit(2.0**64) + F.lit(0.5) <= most).groupBy("s", "h", "t", "l").agg(F.count(F.lit(1)).alias("n"))
    votes: dict[tuple[bool, int, str], dict[str, int]] = {}
    for r in few.collect():
        votes.setdefault((r["s"], r["h"], r["t"]), {})[r["l"]] = r["n"]
    by: dict[tuple[bool, str], list[tuple[str, bool]]] = {}
    for s, h, t in sorted(votes):
        of = votes[s, h, t]
        top = max(sorted(of), key=lambda k: of[k])
        by.setdefault((s, top), []).append((t, sum(of.values()) >= VOTES and of[top] >= MAJORITY * sum(of.values())))
    return [(k, t, sure) for k in LANGS for s in (False, True) for t, sure in by.get((s, k), [])[:per]]


class Found:
    """What a batch of texts holds: per clause and language a row (``text``, ``clause``, ``lang``, ``words``, ``conf``)."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.rows: list[np.ndarray] = []

    def table(self) -> np.ndarray:
        return np.concatenate(self.rows) if self.rows else np.empty((0, 5))


def analyse(net: Network, texts: list[str | None]) -> Found:
    """Languages of the clauses of many texts; the bytes of a whole block run through the filters at once."""
    found = Found(len(texts))
    a = 0
    clauses = [clauses_of(t) if t else [] for t in texts]
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < 1_000_000):
            size += sum(2 * len(c) + WINDOW for c in clauses[b])
            b += 1
        found.rows.append(_analyse_block(net, clauses[a:b], a))
        a = b
    return found


def _analyse_block(net: Network, clauses: list[list[str]], base: int) -> np.ndarray:
    chunks: list[bytes] = []
    owner, number, begin, length = [], [], [], []
    at = 0
    for i, cs in enumerate(clauses):
        for j, c in enumerate(cs):
            d = " ".join(c.split()).encode()
            if not d:
                continue
            owner.append(i)
            number.append(j)
            begin.append(at)
            length.append(len(d))
            pad = WINDOW + (-len(d)) % STRIDE
            chunks += [d, bytes(pad)]
            at += len(d) + pad
    if not owner:
        return np.empty((0, 5))
    data = np.frombuffer(b"".join(chunks) + bytes(WINDOW + STRIDE), np.uint8)
    own, num, beg, leng = (np.array(x) for x in (owner, number, begin, length))
    lp = net.windows(data)
    count = np.maximum(1, -(-(leng - WINDOW) // STRIDE) + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    clause = np.repeat(np.arange(len(own)), count)
    place = np.arange(first[-1]) - first[clause]
    start = beg[clause] + place * STRIDE
    z = lp[start // STRIDE].copy()
    # scripts that a language does not use are out of the question
    arabic = np.concatenate([[0], np.cumsum((data >= 0xD8) & (data <= 0xDB))])
    latin = np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)) | (data == 0xC3))])
    stop = np.minimum(start + WINDOW, beg[clause] + leng[clause])
    na, nl = arabic[stop] - arabic[start], latin[stop] - latin[start]
    z[na * 2 > nl * 3] += np.where(np.isin(np.arange(6), [1, 4]), 0, -20.0)
    z[nl > na * 6] += np.where(np.isin(np.arange(6), [1, 4]), -20.0, 0)
    path = _viterbi(z, own[clause], clause)
    prob = np.exp(z - np.logaddexp.reduce(z, 1)[:, None])
    # every word takes the window whose middle is nearest
    letters = data > 32
    word = np.flatnonzero(letters & ~np.concatenate([[False], letters[:-1]]))
    wc = np.searchsorted(beg, word, side="right") - 1
    win = first[wc] + np.clip((word - beg[wc] - WINDOW // 2 + STRIDE // 2 + 2) // STRIDE, 0, count[wc] - 1)
    lang = path[win]
    key = wc * len(LANGS) + lang
    words = np.bincount(key, minlength=len(own) * len(LANGS))
    conf = np.bincount(key, weights=prob[win, lang], minlength=len(own) * len(LANGS))
    has = np.flatnonzero(words)
    c = has // len(LANGS)
    return np.stack([own[c] + base, num[c], has % len(LANGS), words[has], conf[has] / words[has]], 1)


def _viterbi(z: np.ndarray, owner: np.ndarray, clause: np.ndarray) -> np.ndarray:
    """Best language per window; a change costs ``SWITCH`` within a clause and a quarter of it between clauses."""
    texts, first, sizes = np.unique(owner, return_index=True, return_counts=True)
    out = z.argmax(1)
    # where all windows of a text agree there is nothing to decide
    low, high = np.minimum.reduceat(out, first), np.maximum.reduceat(out, first)
    open_ = np.flatnonzero(low != high)
    open_ = open_[np.argsort(sizes[open_], kind="stable")]
    for s in range(0, len(open_), 1024):
        rows = open_[s : s + 1024]
        n = sizes[rows]
        T, B = int(n.max()), len(rows)
        idx = np.minimum(first[rows][:, None] + np.arange(T)[None, :], len(z) - 1)
        inside = np.arange(T)[None, :] < n[:, None]
        zz = z[idx]
        new = np.zeros((B, T), bool)
        new[:, 1:] = clause[idx[:, 1:]] != clause[idx[:, :-1]]
        cost = np.where(new, SWITCH / 4, SWITCH)
        f = zz[:, 0].copy()
        back = np.zeros((T, B, len(LANGS)), np.int8)
        stay = np.arange(len(LANGS), dtype=np.int8)
        for t in range(1, T):
            j = f.argmax(1)
            move = f[np.arange(B), j] - cost[:, t]
            take = move[:, None] > f
            back[t] = np.where(take & inside[:, t, None], j[:, None], stay)
            f = np.where(inside[:, t, None], np.where(take, move[:, None], f) + zz[:, t], f)
        k = f.argmax(1)
        for t in range(T - 1, -1, -1):
            live = inside[:, t]
            out[idx[live, t]] = k[live]
            k = back[t][np.arange(B), k]
    return out


def document_languages(found: Found, clause: int = CLAUSE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) masks and confidences: the languages with a clause of enough words, else the strongest.

    A second language needs a confidence of ``SECOND``.
    """
    t = found.table()
    L = len(LANGS)
    mask = np.zeros((found.n, L), bool)
    if not len(t):
        return mask, np.zeros((found.n, L))
    key = t[:, 0].astype(int) * L + t[:, 2].astype(int)
    words = np.bincount(key, weights=t[:, 3], minlength=found.n * L)
    weight = np.bincount(key, weights=t[:, 3] * t[:, 4], minlength=found.n * L)
    conf = np.where(words > 0, weight / np.maximum(words, 1), 0).reshape(-1, L)
    weight = weight.reshape(-1, L)
    np.logical_or.at(mask.ravel(), key[t[:, 3] >= clause], True)
    total = words.reshape(-1, L).sum(1)
    best = weight.argmax(1)
    mask &= (conf >= SECOND) | (np.arange(L)[None, :] == best[:, None])
    none = ~mask.any(1) & (total > 0)
    mask[none, best[none]] = True
    return mask, conf


def detect(df: DataFrame, net: Network, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keys`` and ``langs`` (array of language and confidence) per row.

    Null texts and texts without words give an empty array. The network is broadcast; its size is fixed.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    base = df.select(*keys, F.col(text_col).alias("_t"))
    kept = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):  # noqa: ANN001, ANN202
        names = pa.array(LANGS)
        for b in batches:
            mask, conf = document_languages(analyse(shared.value, b.column("_t").to_pylist()))
            row, lang = np.nonzero(mask)
            offs = pa.array(np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32))
            flat = pa.StructArray.from_arrays([names.take(pa.array(lang)), pa.array(conf[row, lang])], names=["lang", "confidence"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.ListArray.from_arrays(offs, flat)], names=[*keys, "langs"])

    return base.mapInArrow(run, f"{kept}, langs array<struct<lang:string,confidence:double>>")


def clause_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the clauses of a text, numbered as in ``clauses_of`` where no invisible character is dropped."""
    t = pii.plain(text)
    out, last = [], 0
    for m in CLAUSE.finditer(t):
        out.append((last, m.start()))
        last = m.end()
    return [*out, (last, len(t))]


def detect_segments(df: DataFrame, net: Network, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keys``, ``clause``, ``lang``, ``confidence``, ``words``: one row per language of every clause."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    base = df.select(*keys, F.col(text_col).alias("_t"))
    kept = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):  # noqa: ANN001, ANN202
        names = pa.array(LANGS)
        for b in batches:
            t = analyse(shared.value, b.column("_t").to_pylist()).table()
            at = pa.array(t[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), pa.array(t[:, 1].astype(np.int32)), names.take(pa.array(t[:, 2].astype(np.int64))), pa.array(t[:, 4]), pa.array(t[:, 3].astype(np.int32))], names=[*keys, "clause", "lang", "confidence", "words"])

    return base.mapInArrow(run, f"{kept}, clause int, lang string, confidence double, words int")
