"""Problem 3: personal data in free text, by a skip-chain conditional random field.

Every token has a label (O, EMAIL, PHONE, ID, ADDRESS, NAME). Neighbouring tokens and distant tokens that repeat or
resemble each other share potentials; loopy sum-product passes messages along the chain and over the skip edges until
labels of one document agree. Weights are fitted here on a bounded sample of messages with the service's own masks and
seed patterns as labels. A message and its masked copy teach the skip edges as one document: what the mask left
readable stands in both, and its label in the one is predicted by a first chain and handed to the other.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LABELS = ("O", "EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
K = len(LABELS)
#: Rows of the training sample: the bound on what is brought to the driver.
SAMPLE_ROWS = 6000
#: Probability from which a token counts as found, and sweeps of the loopy inference.
SURE, SWEEPS = 0.4, 3
#: Masked copies of the sample that teach skip edges.
SAMPLE_COPIES = 1200
#: Letters of a word that its likes share, and of a number's digits.
STEM, STEM_DIGITS = 5, 8

# Letters of other alphabets that stand for Latin ones, one for one.
_LOOKS = dict(zip("асԁеһіјорԛѕԝухАВСЕНІЈКМОРЅТХοναΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "acdehijopqswyxABCEHIJKMOPSTXovaABEZHIKMNOPTYX", strict=True))
_INVISIBLE = "­​‌‍‎‏‪‫‬‭‮⁠⁦⁧⁨⁩﻿؜"


@lru_cache(maxsize=1)
def _same_width() -> dict[int, str]:
    """One character for one: digits of all scripts, full-width forms, kinds of space, contextual letters."""
    out = {ord(a): b for a, b in _LOOKS.items()}
    for cp in (*range(0xA0, 0x3001), *range(0xFB50, 0xFFEF)):
        ch = chr(cp)
        if unicodedata.category(ch) == "Nd":
            out[cp] = str(unicodedata.digit(ch))
        elif unicodedata.category(ch) == "Zs":
            out[cp] = " "
        elif cp > 0xFB50 and len(k := unicodedata.normalize("NFKC", ch)) == 1 and k != ch:
            out[cp] = str(unicodedata.digit(k)) if unicodedata.category(k) == "Nd" else k
    for ch in "‐‑‒−":
        out[ord(ch)] = "-"
    return out


#: Characters that stay as they are, so that most texts need no translation.
_PLAIN = re.compile("[\\x00-\\x7f\\xa1-\\xac\\xae-\\u036f\\u0600-\\u061b\\u061e-\\u065f\\u066a-\\u06ef\\u06fa-\\u06ff\\u2013-\\u2027\\U0001f300-\\U0001f9ff]*")


def plain(text: str) -> str:
    """The text in the characters that patterns know, of the same length."""
    return text if text.isascii() or _PLAIN.fullmatch(text) else text.translate(_same_width())


TOKEN = re.compile(rf"<[A-Z_]+>|(?:[^\W\d_]|[ً-ْ{_INVISIBLE}'’])+|\d+|[^\w\s]|_")
_DROP = dict.fromkeys(map(ord, _INVISIBLE), None)
_HIDDEN = re.compile(f"[{_INVISIBLE}]")
_DIGIT = re.compile("[0-9]")

# Written forms of each kind.
EMAIL = re.compile(r"[\w.+\-]+ ?@ ?[\w\-]+(?: ?\. ?[\w\-]+)+|[\w.+\-]+ ?(?:\(at\)|\[at\]|\{at\}|\bat\b) ?[\w\-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b) ?[\w\-]+)+|[\w.+\-]+ ?(?:\(at\)|\[at\]|\{at\}) ?[\w\-]+(?: ?\. ?[\w\-]+)+", re.I)
PHONE = re.compile(
    r"(?<![A-Za-z0-9.+\-/])(?:\+ ?\d{1,3}|00 ?\d{2,3})[ .\-]*(?:\(\d{1,4}\)[ .\-]*)?\d(?:[ .\-]?\d){5,10}(?![\d])|(?<![\d.+\-/#A-Za-z])0\d(?:\d[ .\-]?\d{3}[ .\-]?\d{4}|[ .\-]?\d{3}[ .\-]?\d{4})(?![\d/\-])|(?<![\d.+\-/#A-Za-z])971[ .\-]?\d{2}[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
    r"|(?:\b|(?<=[؀-ۿ]))(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)(?:[ \-](?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)){6,}\b"
    r"|(?:صفر|واحد|اثنين|ثلاثة|اربعة|خمسة|ستة|سبعة|ثمانية|تسعة)(?: (?:صفر|واحد|اثنين|ثلاثة|اربعة|خمسة|ستة|سبعة|ثمانية|تسعة)){6,}",
    re.I,
)
ID = re.compile(r"(?<!\d)784[ .\-/]?(?:19|20)\d\d[ .\-/]?\d{7}[ .\-/]?\d(?!\d)")
PASSPORT = re.compile(r"(?<![A-Za-z0-9\-])[A-Za-z]{1,2} ?\d{7}(?![\dA-Za-z\-])")
_PLACE = r"[^\W\d_]+(?: [^\W\d_]+)?"
ADDRESS = re.compile(
    rf"\b(?:villa|house|flat|apartment|apt|unit|room|bldg|building)\.? ?(?:no\.? ?|number |# ?)?\d+\w?\b[, ]*(?:[^\W\d_]+[, ]*){{0,3}}(?:\d+\w? ?)?(?:street|st|road|rd|avenue|ave|lane|tower|building|bldg|share3|apt|floor|boulevard)\b[^.;!?\n]{{0,60}}"
    rf"|\bvilla \d+,? (?:share3|street|شارع) \d+[^.;!?\n]{{0,40}}|\b\d+\w? [^\W\d_]+ (?:road|street|avenue|lane|st|rd), (?:building|flat|office|villa|floor) \d+[^.;!?\n]{{0,40}}|\bhouse no\.? ?\d+[^.;!?\n]{{0,50}}"
    rf"|\bp\.? ?o\.? ?box:? ?\d+(?:,? {_PLACE})?|\bsha2a \d+ (?:benayat|binayat) [^.;!?\n]{{0,40}}|\bbldg \d+ apt \d+[^.;!?\n]{{0,50}}|\bbo[iî]te postale ?\d+|\b\d+,? (?:rue|avenue|boulevard) [^.;!?\n]{{3,40}}"
    r"|(?:فيلا|فيلة|شقة|بيت|منزل|بناية|عمارة)(?: رقم)? ?\d+[^.؛!؟\n]{0,60}?(?:شارع|بناية|سكة|برج|طريق|منطقة|حي)[^.؛!؟\n]{0,40}|ص\.? ?ب\.?:? ?\d+(?: [^\W\d_]+){0,2}|صندوق بريد ?\d+(?: [^\W\d_]+){0,2}|(?:مکان|فلیٹ|گھر) نمبر ?\d+[^.۔\n]{0,50}",
    re.I,
)
_TWO = r"([^\W\d_]{2,}) ((?:بن )?[^\W\d_]{2,}(?:[\-'][^\W\d_]+)?)"
NAME_LEFT = re.compile(
    rf"(?:\b(?:this is|my name is|name is|i am|i'm|account holder:?|holder is|is under|under the name(?: of)?|ask for|contact person:?|regards,?|thanks,|best,|sincerely,?|cheers,|mr\.?|mrs\.?|ms\.?|miss|dr\.?|esmi|ismi|ma3akum|besm|je m'appelle|cordialement,?|ako (?:po )?si)|(?<![؀-ۿ])(?:انا|اسمي|باسم|معكم|معاكم|السيدة?|الاستاذة?|تحياتي|مع الشكر|میرا نام))[\s:،,]+{_TWO}",
    re.I,
)
NAME_RIGHT = re.compile(rf"(?:^|[\s\-.,!?،؟]){_TWO} (?:speaking|here|signed it|opened it|يتكلم|معكم)\b", re.I)
NAME_ALONE = re.compile(rf"(?:^|\n|[\-–] ){_TWO}(?=\s*(?:$|\n|[.,!?،؟](?:\s|$)| - ))")
KINDS = (("EMAIL", EMAIL), ("PHONE", PHONE), ("ID", ID), ("PASSPORT", PASSPORT), ("ADDRESS", ADDRESS))
# What a lower-cased text must hold for a pattern to be tried.
_ADDRESS_HINTS = ("villa", "house", "flat ", "apartment", " apt ", "unit ", "room ", "bldg", "building", " road", " street", " avenue", " lane", "box", "share3", "sha2a", "postale", " rue ", "boulevard", "فيل", "شقة", "بيت", "منزل", "بناية", "عمارة", "ص.ب", "ص. ب", "ص ب", "صندوق", "نمبر")
_EMAIL_HINTS = ("@", " dot ", "(dot", "[dot", "(at)", "[at]", "{at}")
_WORD_DIGITS = ("zero", " oh ", "double", "صفر")
_SEVEN = re.compile(r"(?<!\d)\d{7}(?!\d)")
_MAYBE_PHONE = re.compile(r"[+0]\d?[ .\-()]{0,2}\d[\d .\-()]{5}|971[ .\-]?5")


@lru_cache(maxsize=16_384)
def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index into ``KINDS``) of the written forms in a plain text; read again when its labels are."""
    low = text.lower()
    out = []
    digits = _DIGIT.search(low) is not None
    use = (
        any(h in low for h in _EMAIL_HINTS),
        (digits and _MAYBE_PHONE.search(text)) or any(h in low for h in _WORD_DIGITS),
        digits and "784" in low,
        digits and _SEVEN.search(text),
        digits and any(h in low for h in _ADDRESS_HINTS),
    )
    for i, (go, (_, pattern)) in enumerate(zip(use, KINDS, strict=True)):
        if go:
            out += [(m.start(), m.end(), i) for m in pattern.finditer(text)]
    return out


def word_features(w: str) -> list[str]:
    """Features of one token by itself."""
    if not (w[0].isalnum() or w[0] in "<_"):
        return ["p=" + w[0]]
    if w[0] == "<" and len(w) > 1:
        return ["mask"]
    if w[0].isdigit():
        n = len(w)
        return [f"d={min(n, 16)}", "d0=" + (w[:2] if n >= 7 or w[0] == "0" else "")]
    low = w.lower()
    if w.isupper() and len(w) > 1:
        shape = "U"
    elif w[0].isupper():
        shape = "T" if w[1:].islower() or len(w) == 1 else "M"
    elif w.islower():
        shape = "l"
    elif "؀" <= w[0] <= "ۿ":
        shape = "A"
    else:
        shape = "m"
    out = ["x=" + shape, "w=" + low, f"n={min(len(w), 12)}"]
    if len(low) > 3:
        out += ["s2=" + low[-2:], "s3=" + low[-3:]]
    if len(low) > 4:
        out.append("s4=" + low[-4:])
        if shape in "TU":
            out.append("Ts4=" + low[-4:])
    if shape == "A" and low.startswith("ال"):
        out.append("al")
    return out


def context_features(w: str) -> list[str]:
    """Features that a token lends to its neighbours."""
    f = word_features(w)
    return [x for x in f if x[:2] in ("p=", "x=", "w=", "d=", "ma", "s3")]


class Vocabulary:
    """Feature names seen often enough in the sample, by role."""

    ROLES = ("s", "l1", "l2", "r1", "r2")

    def __init__(self, index: dict[str, int]) -> None:
        self.index = index
        self.types: dict[str, int] = {}
        self.rows: list[tuple[list[int], ...]] = []

    def of(self, w: str) -> tuple[list[int], ...]:
        """Feature numbers of a token per role."""
        get = self.index.get
        s = [x for f in word_features(w) if (x := get("s:" + f)) is not None]
        c = context_features(w)
        return (s, *([x for f in c if (x := get(r + ":" + f)) is not None] for r in self.ROLES[1:]))


class Model:
    """Weights of the field and its inference over batches of texts."""

    MOST_TYPES = 150_000

    def __init__(self, index: dict[str, int], weights: np.ndarray, span: np.ndarray, start: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.vocabulary = Vocabulary(index)
        self.weights, self.span, self.start, self.chain, self.skip = weights, span, start, chain, skip
        # the most that a message from either neighbour and along one skip edge can add to a label's log odds to O
        self.from_chain = ((chain - chain[:, :1]).max(0) + (chain.T - chain.T[:, :1]).max(0))[1:]
        # log odds up to which the tokens of a text send nothing but O along skip edges
        S = np.exp(skip - skip[0, 0])
        self.quiet = float(np.log(np.maximum((1 - S[0, 1:]) / S[1:, 1:].sum(0), 1e-30)).min())
        self.from_skip = max(0.0, float((skip - skip[:, :1]).max()))
        self.known = frozenset(f[4:] for f in index if f.startswith("s:w="))
        self.endings = frozenset(f.rpartition("=")[2] for f in index if f.partition(":")[2].startswith(("s2=", "s3=", "s4=", "Ts4=")))
        self.clear()

    def clear(self) -> None:
        """Forget the tokens seen so far; their potentials are computed again when they return."""
        self.types: dict[str, int] = {}
        self.forms: dict[tuple, int] = {}
        self.tables = np.zeros((5, 4096, K), np.float32)

    def type_of(self, w: str) -> int:
        """Row of a token's potentials. Tokens with the same features share one."""
        low = w.lower()
        c = w[0]
        if c.isdigit():
            form: tuple = (min(len(w), 16), w[:2] if len(w) >= 7 or c == "0" else "")
        elif low in self.known or not c.isalnum():
            form = (low, w.isupper(), c.isupper(), w[1:].islower())
        else:
            # the longest ending that the weights know; words that differ before it share a row
            end = low[-4:] if low[-4:] in self.endings else low[-3:] if low[-3:] in self.endings else low[-2:] if low[-2:] in self.endings else ""
            form = (w.isupper(), c.isupper(), w[1:].islower(), w.islower(), min(len(w), 12), end if len(w) > 3 else "", low[:2] == "ال", "؀" <= c <= "ۿ")
        t = self.forms.get(form)
        if t is None:
            t = self.forms[form] = len(self.forms) + 1
            if t >= self.tables.shape[1]:
                self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
            for r, ids in enumerate(self.vocabulary.of(w)):
                if ids:
                    self.tables[r, t] = self.weights[ids].sum(0)
        self.types[w] = t
        return t

    def unary(self, toks: list[list[str]], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, longest, K) log potentials and lengths; ``found``: per text (tokens, kinds) span marks."""
        if len(self.types) > self.MOST_TYPES:
            self.clear()
        n = np.array([len(t) for t in toks])
        ids = np.zeros((len(toks), int(n.max()) + 4), np.int64)
        for i, t in enumerate(toks):
            ids[i, 2 : 2 + len(t)] = [self.types.get(w) or self.type_of(w) for w in t]
        T = int(n.max())
        tab = self.tables
        u = tab[0][ids[:, 2 : 2 + T]] + tab[1][ids[:, 1 : 1 + T]] + tab[2][ids[:, :T]] + tab[3][ids[:, 3 : 3 + T]] + tab[4][ids[:, 4 : 4 + T]] + self.start
        for i, m in enumerate(found):
            if m is not None:
                u[i, : n[i]] += m @ self.span
        return u, n

    def most(self, u: np.ndarray, n: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """(texts, tokens, K - 1): log odds against O that no belief can exceed.

        A message is a mean of potentials weighted by a belief, so its odds are at most those of its potentials'
        largest difference, and at most what the bound on the belief itself allows; three rounds of that. Where no
        token reaches ``SURE`` within the bound, the text is O throughout and needs no inference.
        """
        A, S = np.exp(self.chain - self.chain[0, 0]), np.exp(self.skip - self.skip[0, 0])
        T = u.shape[1]
        at = np.arange(T)
        behind = (at[None, :] + 1 < n[:, None])[:, :, None]
        base = u[:, :, 1:] - u[:, :, :1]
        x = base + self.from_chain
        if edges:
            row, i, j = np.array(edges).T
            np.add.at(x, (row, i), self.from_skip)
            np.add.at(x, (row, j), self.from_skip)
        for _ in range(3):
            odds = np.exp(np.minimum(x, 30))
            new = base.copy()
            new[:, 1:] += np.log(A[0, 1:] + odds[:, :-1] @ A[1:, 1:])
            new[:, :-1] += np.where(behind[:, :-1], np.log(A[1:, 0] + odds[:, 1:] @ A[1:, 1:].T), 0)
            if edges:
                # messages start at no preference and move half the way
                np.add.at(new, (row, j), np.maximum(np.log(S[0, 1:] + odds[row, i] @ S[1:, 1:]), 0))
                np.add.at(new, (row, i), np.maximum(np.log(S[0, 1:] + odds[row, j] @ S[1:, 1:]), 0))
            x = np.minimum(x, new)
        return x

    def marginals(self, u: np.ndarray, n: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Label probabilities per token; ``edges``: (text, token, token) of the skip edges."""
        inside = np.arange(u.shape[1])[None, :] < n[:, None]
        u = u - u.max(2, keepdims=True)
        base = np.where(inside[:, :, None], np.exp(np.maximum(u, -30)), 1.0).astype(np.float32)
        A = np.exp(self.chain).astype(np.float32)
        belief = _sum_product(base, A, inside)
        if edges:
            # loopy: only texts with skip edges take part in further sweeps
            e = np.array(edges)
            texts, back = np.unique(e[:, 0], return_inverse=True)
            sub, ins = base[texts], inside[texts]
            i, j = e[:, 1], e[:, 2]
            S = np.exp(self.skip).astype(np.float32)
            to_j = np.ones((len(e), K), np.float32)
            to_i = np.ones((len(e), K), np.float32)
            b = belief[texts]
            for _ in range(SWEEPS):
                new_j = (b[back, i] / to_i) @ S
                new_i = (b[back, j] / to_j) @ S.T
                to_j = np.sqrt(to_j * new_j / new_j.sum(1, keepdims=True) * K)
                to_i = np.sqrt(to_i * new_i / new_i.sum(1, keepdims=True) * K)
                logs = np.zeros_like(sub)
                np.add.at(logs, (back, j), np.log(to_j + 1e-20))
                np.add.at(logs, (back, i), np.log(to_i + 1e-20))
                b = _sum_product(sub * np.exp(logs), A, ins)
            belief[texts] = b
        return belief

    def label(self, texts: list[str]) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
        """Per text: token offsets and label numbers; both empty where every label is O."""
        none: tuple[list[tuple[int, int]], np.ndarray] = ([], np.empty(0, int))
        alike: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            alike.setdefault(t, []).append(i)
        out = [none] * len(texts)
        rows = list(alike.values())
        plains = [plain(t) for t in alike]
        parts = [tokens_of(t) for t in plains]
        order = sorted((i for i in range(len(parts)) if parts[i][0]), key=lambda i: len(parts[i][0]))
        a = 0
        while a < len(order):
            # blocks of similar length, of bounded size also where texts are very long
            longest = len(parts[order[min(a + 511, len(order) - 1)]][0])
            block = order[a : a + max(1, min(512, 200_000 // max(longest, 1)))]
            a += len(block)
            u, n = self.unary([parts[i][0] for i in block], [parts[i][1] for i in block])
            inside = lambda: np.arange(u.shape[1]) < n[:, None]
            # texts whose tokens can't move each other along skip edges need none of them
            open_ = np.flatnonzero(((self.most(u, n, []).max(2) > min(np.log(SURE / (1 - SURE)), self.quiet)) & inside()).any(1))
            if not len(open_):
                continue
            block = [block[i] for i in open_]
            u, n = u[open_, : n[open_].max()], n[open_]
            edges = [(x, p, q) for x, i in enumerate(block) for p, q in skip_edges(parts[i][0])]
            open_ = np.flatnonzero(((self.most(u, n, edges).max(2) > np.log(SURE / (1 - SURE))) & inside()).any(1))
            if not len(open_):
                continue
            u, n = u[open_, : n[open_].max()], n[open_]
            at = {int(i): x for x, i in enumerate(open_)}
            edges = [(at[x], p, q) for x, p, q in edges if x in at]
            best = self.marginals(u, n, edges)
            lab = best[:, :, 1:].argmax(2) + 1
            lab[np.take_along_axis(best, lab[:, :, None], 2)[:, :, 0] < SURE] = 0
            for x in np.flatnonzero((lab * (np.arange(lab.shape[1]) < n[:, None])).any(1)):
                i = block[open_[x]]
                got = (parts[i][2] or offsets_of(plains[i]), lab[x, : n[x]])
                for r in rows[i]:
                    out[r] = got
        return out


def _sum_product(base: np.ndarray, A: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Exact chain beliefs by scaled forward and backward sweeps, (texts, tokens, K)."""
    B, T, _ = base.shape
    f = np.empty_like(base)
    f[:, 0] = base[:, 0]
    for t in range(1, T):
        prev = f[:, t - 1]
        x = (prev / prev.sum(1, keepdims=True)) @ A * base[:, t]
        f[:, t] = np.where(inside[:, t, None], x, prev)
    b = np.ones((B, K), np.float32)
    out = f / f.sum(2, keepdims=True)
    for t in range(T - 2, -1, -1):
        nb = (base[:, t + 1] * b) @ A.T
        nb /= nb.sum(1, keepdims=True)
        b = np.where(inside[:, t + 1, None], nb, b)
        x = f[:, t] * b
        out[:, t] = x / x.sum(1, keepdims=True)
    return out


def offsets_of(text: str) -> list[tuple[int, int]]:
    """Offsets of the tokens of a plain text."""
    if _HIDDEN.search(text):
        return [m.span() for m in TOKEN.finditer(text) if m.group().translate(_DROP)]
    return [m.span() for m in TOKEN.finditer(text)]


def tokens_of(text: str) -> tuple[list[str], np.ndarray | None, list[tuple[int, int]] | None]:
    """Tokens of a plain text and, if it holds written forms, their marks (tokens, kinds) and the tokens' offsets."""
    found = spans(text)
    if not found:
        toks = TOKEN.findall(text)
        if not text.isascii() and _HIDDEN.search(text):
            toks = [w for x in toks if (w := x.translate(_DROP))]
        return toks, None, None
    offs = offsets_of(text)
    toks = [text[a:b] for a, b in offs]
    if not text.isascii() and _HIDDEN.search(text):
        toks = [x.translate(_DROP) for x in toks]
    marks = np.zeros((len(toks), len(KINDS)), np.float32)
    starts = np.array([a for a, _ in offs])
    for a, b, k in found:
        marks[np.searchsorted(starts, a) : np.searchsorted(starts, b), k] = 1
        if len(toks) and (i := int(np.searchsorted(starts, a, side="right")) - 1) >= 0 and offs[i][1] > a:
            marks[i, k] = 1
    return toks, marks, offs


def skip_edges(toks: list[str]) -> list[tuple[int, int]]:
    """Pairs of distant tokens of a text that are the same or alike (see ``links``)."""
    return [(i, j) for _, i, _, j in links([toks])]


def links(parts: list[list[str]]) -> list[tuple[int, int, int, int]]:
    """(text, token, text, token): each token of a document's texts with the last one like it that is not its neighbour.

    Alike are the same words in any case, words of ``STEM`` common letters at their start, and numbers of the same
    digits however they are cut.
    """
    last: dict[str, tuple[int, int]] = {}
    out: list[tuple[int, int, int, int]] = []

    def link(key: str, x: int, i: int) -> bool:
        there = last.get(key)
        last[key] = (x, i)
        if there is None or (there[0] == x and i - there[1] < 2):
            return False
        out.append((*there, x, i))
        return True

    for x, toks in enumerate(parts):
        begin, digits = -1, ""
        for i, w in enumerate(toks):
            keys = _keys(w)
            if keys is None:
                if not digits:
                    begin = i
                digits += w
            elif digits and not (w in "-. /" and i + 1 < len(toks) and toks[i + 1].isdigit()):
                if len(digits) >= 7:
                    link("#" + digits[-STEM_DIGITS:], x, begin)
                digits = ""
            for key in keys or ():
                if link(key, x, i):
                    break
        if len(digits) >= 7:
            link("#" + digits[-STEM_DIGITS:], x, begin)
    return out


@lru_cache(maxsize=100_000)
def _keys(w: str) -> tuple[str, ...] | None:
    """What a token is linked by: itself, then its stem; None for digits, which are linked as numbers."""
    if w.isdigit():
        return None
    if len(w) < 4 or not w[0].isalnum():
        return ()
    low = w.lower()
    return (low, low[:STEM] + "*") if len(low) > STEM else (low,)


# ---------------------------------------------------------------- training

_ALIGN = {"<EMAIL>": 1, "<PHONE>": 2, "<EID>": 3, "<ID>": 3, "<ADDRESS>": 4, "<NAME>": 5}
_MASK = re.compile(r"(<[A-Z_]+>)")


def aligned(message: str, masked: str) -> list[tuple[int, int, int]]:
    """(start, end, label) of what the service masked, where the rest of the message is unchanged."""
    parts = _MASK.split(masked)
    if len(parts) < 3:
        return []
    m = re.fullmatch("".join("(.{1,120}?)" if i % 2 else re.escape(p) for i, p in enumerate(parts)), message, re.S)
    if not m:
        return []
    return [(*m.span(i + 1), _ALIGN[p]) for i, p in enumerate(parts[1::2]) if p in _ALIGN]


def seed_labels(text: str, offs: list[tuple[int, int]], marks: np.ndarray | None, common: frozenset[str], masks: list[tuple[int, int, int]]) -> np.ndarray:
    """Training labels of a plain text: the service's masks, written forms, and names beside a cue."""
    lab = np.zeros(len(offs), int)
    starts = np.array([a for a, _ in offs])

    def put(a: int, b: int, k: int) -> None:
        i, j = np.searchsorted(starts, a), np.searchsorted(starts, b)
        lab[i:j] = k

    for a, b, k in masks:
        put(a, b, k)
    for pattern in (NAME_LEFT, NAME_RIGHT, NAME_ALONE):
        for m in pattern.finditer(text):
            one, two = m.group(1), m.group(2)
            last = two.split()[-1]
            if one.lower() in common or last.lower() in common or not (one[0].isupper() == last[0].isupper()) or len(last) < 4:
                continue
            if pattern is NAME_ALONE and not (one.isascii() and one.isupper() == last.isupper()):
                continue
            put(m.start(1), m.end(2), 5)
    if marks is not None:
        cue = re.compile(r"passport|passeport|pasaporte|جواز|jawaz|پاسپورٹ", re.I)
        for k, target in ((4, 4), (0, 1), (1, 2), (2, 3)):
            lab[marks[:, k] > 0] = target
        for i in np.flatnonzero(marks[:, 3] > 0):
            if cue.search(text, max(0, starts[i] - 24), starts[i]):
                lab[i] = 3
    return lab


def train(pairs: list[tuple[str, str | None]], epochs: int = 4, seed: int = 7) -> Model:
    """Fit the field on (message, masked message) by pseudo-likelihood with Adagrad, in numpy.

    A first round fits the chain. Its predictions then stand for the labels of distant tokens: a token of a document
    that is linked to a found one and no common word gets the found label, and a second round fits the skip edges
    with the predicted labels of their far ends. Without any text the field has no weights and finds nothing.
    """
    docs = []
    copies = 0
    counts: Counter = Counter()
    for number, (message, masked) in enumerate(pairs):
        copy = masked and masked != message and copies < SAMPLE_COPIES
        copies += bool(copy)
        for given in (message, masked) if copy else (message,):
            text = plain(given)
            toks, marks, offs = tokens_of(text)
            if not toks:
                continue
            docs.append((number, text, toks, offs or offsets_of(text), marks, aligned(message, masked) if masked and given is message else []))
            if given is message:
                counts.update({w.lower() for w in toks})
    common = frozenset(w for w, c in counts.items() if c >= max(12, len(pairs) // 250))
    names: Counter = Counter()
    for _, _, toks, *_ in docs:
        for w in toks:
            for f in word_features(w):
                names["s:" + f] += 1
            for f in context_features(w):
                names["c:" + f] += 1
    index: dict[str, int] = {}
    for f, c in names.items():
        if c >= 5:
            if f[0] == "s":
                index[f] = len(index)
            else:
                for r in Vocabulary.ROLES[1:]:
                    index[r + f[1:]] = len(index)
    voc = Vocabulary(index)
    F0 = len(index)
    # columns behind the words: span marks, bias, previous and next label, label across a skip edge
    at_span, at_bias, at_prev, at_next, at_skip = F0, F0 + len(KINDS), F0 + len(KINDS) + 1, F0 + len(KINDS) + 1 + K, F0 + len(KINDS) + 1 + 2 * K
    width = at_skip + K
    flat, ys, words, firsts = [], [], [], []
    cache: dict[str, tuple[list[int], ...]] = {}
    for _, text, toks, offs, marks, masks in docs:
        lab = seed_labels(text, offs, marks, common, masks)
        firsts.append(len(ys))
        per = [cache.get(w) or cache.setdefault(w, voc.of(w)) for w in toks]
        n = len(toks)
        for i in range(n):
            x = [*per[i][0], at_bias]
            if i:
                x += per[i - 1][1]
                x.append(at_prev + lab[i - 1])
            if i > 1:
                x += per[i - 2][2]
            if i < n - 1:
                x += per[i + 1][3]
                x.append(at_next + lab[i + 1])
            if i < n - 2:
                x += per[i + 2][4]
            if marks is not None:
                x += [at_span + int(k) for k in np.flatnonzero(marks[i])]
            flat.append(x)
            ys.append(lab[i])
            words.append(toks[i])
    if not flat:
        none = np.zeros((K, K), np.float32)
        return Model({}, np.zeros((0, K), np.float32), np.zeros((len(KINDS), K), np.float32), np.zeros(K, np.float32), none, none)
    y = np.array(ys)
    rng = np.random.default_rng(seed)
    W, G = np.zeros((width, K)), np.full((width, K), 1e-2)
    _fit(W, G, flat, y, epochs // 2, rng)
    # what the chain finds, or the labels say, is handed along the edges of each document
    z = np.array([W[x].sum(0) for x in flat])
    said = np.where(y > 0, y, z.argmax(1))
    partners: dict[int, list[int]] = {}
    a = 0
    while a < len(docs):
        b = a
        while b < len(docs) and docs[b][0] == docs[a][0]:
            b += 1
        for p, i, q, j in links([d[2] for d in docs[a:b]]):
            i, j = firsts[a + p] + i, firsts[a + q] + j
            partners.setdefault(i, []).append(j)
            partners.setdefault(j, []).append(i)
        a = b
    for i, near in partners.items():
        found = {int(said[j]) for j in near if words[j].lower() == words[i].lower()} - {0}
        if not y[i] and len(found) == 1 and words[i].lower() not in common:
            y[i] = found.pop()
    for i, near in partners.items():
        flat[i] = flat[i] + [at_skip + int(said[j]) for j in near]
    _fit(W, G, flat, y, epochs - epochs // 2, rng)
    prev, nxt = W[at_prev : at_prev + K], W[at_next : at_next + K]
    skip = W[at_skip : at_skip + K]
    # one potential per edge: pseudo-likelihood weights of both directions, shared
    return Model(index, W[:F0].astype(np.float32), W[at_span:at_bias].astype(np.float32), W[at_bias].astype(np.float32), ((prev + nxt.T) / 2).astype(np.float32), ((skip + skip.T) / 2).astype(np.float32))


def _fit(W: np.ndarray, G: np.ndarray, flat: list[list[int]], y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """``epochs`` of Adagrad on tokens given as feature numbers; every labelled token and its surroundings, and a share of the plain ones."""
    near = np.convolve((y > 0).astype(int), np.ones(7, int), "same") > 0
    use = np.flatnonzero(near | (rng.random(len(y)) < 0.35))
    sizes = np.array([len(x) for x in flat])
    for _ in range(epochs):
        rng.shuffle(use)
        for a in range(0, len(use), 2048):
            rows = use[a : a + 2048]
            ids = np.concatenate([flat[r] for r in rows])
            off = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            z = np.add.reduceat(W[ids], off, axis=0)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            rep = np.repeat(np.arange(len(rows)), sizes[rows])
            g = np.zeros_like(W)
            for k in range(K):
                g[:, k] = np.bincount(ids, weights=p[rep, k], minlength=len(W))
            g += 2e-3 * W * (g != 0)
            G += g * g
            W -= 0.35 * g / np.sqrt(G)


# ---------------------------------------------------------------- Spark


def training_sample(requests: DataFrame, responses: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str | None]]:
    """At most ``rows`` pairs, two thirds of them with a mask, chosen by the hash of the id over the whole table.

    A count of both sorts bounds the hashes from which they are taken, so that a bounded number of rows is ordered
    whatever the table holds.
    """
    order = F.xxhash64("request_id", F.lit(11))
    pick = responses.select("request_id", "message_masked", order.alias("_o"), F.col("message_masked").rlike("<(EMAIL|PHONE|EID|NAME|ADDRESS)>").alias("_m")).where("request_id is not null and message_masked is not null")
    sizes = {r["_m"]: r["count"] for r in pick.groupBy("_m").count().collect()}

    def few(mask: bool, k: int) -> DataFrame:
        share = min(1.0, 2 * k / max(sizes.get(mask, 0), 1))
        return pick.where((F.col("_m") == mask) & (F.col("_o") / F.lit(2.0**64) + F.lit(0.5) <= share)).orderBy("_o", "message_masked").limit(k).drop("_o", "_m")

    some = few(True, rows * 2 // 3).unionByName(few(False, rows // 3))
    # the sample is bounded by ``rows``
    return [(r[0], r[1]) for r in requests.select("request_id", "message").where("message is not null").join(F.broadcast(some), "request_id").select("request_id", "message", "message_masked").distinct().orderBy("request_id", "message").select("message", "message_masked").limit(rows).collect()]


_ID_PASSPORT = re.compile(r"[A-Za-z]{1,2} ?\d{7}")
_FORM_LABEL = (1, 2, 3, 3, 4)


def kinds_in(text: str, offs: list[tuple[int, int]], lab: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one label as (kind, start, end), after an exact check of what a run of the kind must hold."""
    out = []
    forms = spans(plain(text))
    i = 0
    while i < len(lab):
        k = int(lab[i])
        j = i + 1
        while j < len(lab) and lab[j] == k:
            j += 1
        if k:
            a, b = offs[i][0], offs[j - 1][1]
            inside = [(x, y) for x, y, f in forms if _FORM_LABEL[f] == k and x < b and y > a]
            if inside and k in (1, 2, 3):
                a, b = min(x for x, _ in inside), max(y for _, y in inside)
            run = plain(text[a:b])
            digits = sum(c.isdigit() for c in run)
            kind = LABELS[k]
            ok = {
                "EMAIL": lambda: "@" in run or re.search(r"\bat\b", run, re.I),
                "PHONE": lambda: digits >= 7 or len(re.findall(r"[^\W\d_]+", run)) >= 6,
                "ID": lambda: digits >= 15 or _ID_PASSPORT.search(run) or (digits == 7 and a > 0 and text[a - 1].isalpha()),
                "ADDRESS": lambda: digits >= 1,
                "NAME": lambda: digits == 0 and len(run) >= 4,
            }[kind]()
            if ok:
                out.append((kind, a, b))
        i = j
    return out


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with typed placeholders; everything else as it was."""
    out, last = [], 0
    for kind, a, b in sorted(found, key=lambda x: x[1]):
        if a < last:
            continue
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def find_personal_data(texts: DataFrame, model: Model, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keys``, ``kinds`` (distinct kinds found, an array) and ``masked`` of every row of ``texts``.

    Null texts give null ``masked`` and no kinds, empty ones an empty string. The model is broadcast; its size is
    bounded by the training sample.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    base = texts.select(*keys, F.col(text_col).alias("_t"))
    kept = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):  # noqa: ANN001, ANN202
        m = shared.value
        for b in batches:
            given = b.column("_t").to_pylist()
            kinds, texts_out = [], []
            for t, (offs, lab) in zip(given, m.label([x or "" for x in given]), strict=True):
                found = kinds_in(t, offs, lab) if t and lab.any() else []
                kinds.append(sorted({k for k, _, _ in found}))
                texts_out.append(masked(t, found) if found else t)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(kinds, pa.list_(pa.string())), pa.array(texts_out, pa.string())], names=[*keys, "kinds", "masked"])

    return base.mapInArrow(run, f"{kept}, kinds array<string>, masked string")
