"""Problem 7: one form for text that looks the same.

A transducer over grapheme clusters is compiled once per worker from rules (width, ligatures and contextual forms,
white space, invisible characters, composed marks, hyphens, letters of other alphabets). Its states hold every known
sequence of a letter and its marks; in one pass it reads each cluster, puts its marks in order and writes the image
of the longest known sequence, then what is left of the cluster. All mappings are computed at compilation, which also
checks that they hold no conflict: no sequence gets two images, and no image is changed by a second pass.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlspike.operators.pairs import SALT, expand_pairs, key_pairs
from marlspike.session import cut, merged

# Letters of other alphabets and the Latin letters they can't be told from, then hyphens,
# invisible characters and spaces.
CYRILLIC = dict(zip("асԁеһіјорԛѕԝухАВСЕНІЈКМОРԚЅТԜХУүҮӏ", "acdehijopqswyxABCEHIJKMOPQSTWXYyYl", strict=True))
GREEK = dict(zip("ονρυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovpucjABEZHIKMNOPTYXCJ", strict=True))
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "Ս": "U", "Օ": "O"}
HYPHENS = "\u2010\u2011\u2012\u2043\u02d7\u2212\ufe63\uff0d"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff\ufe0e\ufe0f"
SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029")

# Blocks whose compatibility forms differ in width, joining or context only. Superscripts, fractions, circled and
# styled mathematical letters look different and stay.
FORMS = ((0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133), (0x2160, 0x217F), (0xFE50, 0xFE6B))

#: Text of these characters only is its own form, so most rows never reach the transducer.
PLAIN = re.compile("[\n -~\u00a1-\u00ac\u00ae-\u00ff\u060c\u061b\u061f\u0621-\u063a\u0640-\u064a\u0660-\u066d\u0671-\u06d4\u06f0-\u06f9\u2013\u2014\u2018-\u201f\u2026\U0001f300-\U0001f64f\U0001f680-\U0001f6ff]*")


class Conflict(ValueError):
    """Two rules give one sequence different images, or an image isn't stable."""


def _is_mark(ch: str) -> bool:
    return unicodedata.category(ch) in ("Mn", "Mc", "Me")


def _pictograph(ch: str) -> bool:
    return 0x2600 <= ord(ch) <= 0x27BF or ord(ch) >= 0x1F000


class Transducer:
    """States over letters and marks, with the image of each sequence that ends in one.

    ``parts``: character -> (what is written as it is, the letter that may take marks, its marks).
    """

    def __init__(self) -> None:
        self.parts: dict[str, tuple[str, str, str]] = {}
        self.rank: dict[str, int] = {}
        self.edges: dict[tuple[int, str], int] = {}
        self.images: list[str | None] = [None]

    def put(self, sequence: str, image: str) -> None:
        """Add a sequence; a second image for it is a conflict."""
        state = 0
        for c in sequence:
            state = self.edges.setdefault((state, c), len(self.images))
            if state == len(self.images):
                self.images.append(None)
        if self.images[state] not in (None, image):
            raise Conflict(f"{sequence!r} -> {self.images[state]!r} and {image!r}")
        self.images[state] = image

    def map(self, c: str, image: str) -> None:
        """Let ``c`` be read as ``image``: letters, then the last letter's marks in order."""
        full = unicodedata.normalize("NFD", image)
        k = len(full)
        while k > 1 and _extends(full[k - 1]):
            k -= 1
        new = (unicodedata.normalize("NFC", full[: k - 1]), full[k - 1 : k], full[k:])
        if self.parts.setdefault(c, new) != new:
            raise Conflict(f"{c!r} -> {self.parts[c]!r} and {new!r}")

    def longest(self, cluster: str) -> str:
        """The image of the longest known sequence that ``cluster`` begins with, and the rest of it."""
        state, image, end = 0, cluster[:1], 1
        for i, c in enumerate(cluster):
            state = self.edges.get((state, c), -1)
            if state < 0:
                break
            if self.images[state] is not None:
                image, end = self.images[state], i + 1
        return image + cluster[end:]

    def ordered(self, marks: str) -> str:
        """Marks that don't touch each other in a fixed order; those of one place stay as they come."""
        out: list[str] = []
        for c in marks:
            r = self.rank.get(c, 0)
            i = len(out)
            while r and i and self.rank.get(out[i - 1], 0) > r:
                i -= 1
            out.insert(i, c)
        return "".join(out)

    def run(self, text: str) -> str:
        """The image of ``text``, cluster by cluster from left to right."""
        out: list[str] = []
        parts = self.parts
        i, n = 0, len(text)
        while i < n:
            c = text[i]
            if (0, c) in self.edges and i + 1 < n and (self.edges[0, c], text[i + 1]) in self.edges and not _extends(text[i + 1]):
                # a sequence without marks, such as a two-character line break
                j = i + 2
                out.append(self.longest(text[i:j]))
                i = j
                continue
            before, letter, marks = parts.get(c) or ("", c, "")
            i += 1
            out.append(before)
            if not letter:
                continue
            joined = False
            while i < n:
                d = text[i]
                if d == "\u200d" and i + 1 < n and _pictograph(c) and _pictograph(text[i + 1]):
                    marks += text[i : i + 2]  # joined pictures are one picture
                    joined = True
                    i += 2
                    continue
                x, y, z = parts.get(d) or ("", d, "")
                if y and not _extends(y):
                    break
                marks += y + z
                i += 1
            if not marks:
                out.append(self.longest(letter) if (0, letter) in self.edges else letter)
            elif joined:
                out.append(letter + marks)
            else:
                out.append(self.longest(letter + (self.ordered(marks) if len(marks) > 1 else marks)))
        return "".join(out)


def _extends(c: str) -> bool:
    """Whether a character belongs to the letter before it: marks, vowels and finals of conjoined syllables."""
    return c in _EXTENDING


_EXTENDING = frozenset(c for c in map(chr, range(0x300, 0x1F000)) if _is_mark(c) or 0x1160 <= ord(c) <= 0x11FF)


def compile_rules(sequences: bool = True) -> Transducer:
    """The transducer of all rules, checked for conflicts. Without ``sequences`` it knows single characters only, which
    leaves letters and their marks apart, and is not checked."""
    t = Transducer()
    letters = CYRILLIC | GREEK | ARMENIAN
    single = dict(letters)
    single |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(SPACES, " ")
    single |= {b: "\n" for b in BREAKS if len(b) == 1}
    image = lambda s: "".join(single.get(c, c) for c in s)
    for lo, hi in FORMS:
        for ch in map(chr, range(lo, hi + 1)):
            if ch not in single and unicodedata.category(ch) != "Cn" and (k := unicodedata.normalize("NFKC", ch)) != ch:
                # a spacing form of a mark (space + mark) is kept: the space belongs to the drawing
                if not (len(k) > 1 and k[0] == " " and _is_mark(k[-1])):
                    single[ch] = image(k)
    composed: dict[str, str] = {}
    for ch in map(chr, range(0xA0, 0x30000)):
        t.rank[ch] = unicodedata.combining(ch)
        full = unicodedata.normalize("NFD", ch)
        if full != ch and ch not in single:
            # a letter of another alphabet under its marks is the look-alike under them
            single[ch] = single.get(full[0], full[0]) + full[1:]
    t.rank = {c: r for c, r in t.rank.items() if r}
    for ch, img in single.items():
        t.map(ch, img)
    if sequences:
        for b in BREAKS:
            if len(b) > 1:
                t.put(b, "\n")
        for ch in map(chr, range(0xA0, 0x30000)):
            full = unicodedata.normalize("NFD", ch)
            if len(full) > 1 and unicodedata.normalize("NFC", full) == ch and full[0] not in single:
                t.put(t.longest(full[0]) + t.ordered(full[1:]), ch)
    for ch in single if sequences else ():
        once = t.run(ch)
        if t.run(once) != once:
            raise Conflict(f"{ch!r} -> {once!r} -> {t.run(once)!r}")
    return t


@lru_cache(maxsize=1)
def compiled() -> Transducer:
    return compile_rules()


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; None stays None, empty stays empty."""
    if text is None:
        return None
    return text if PLAIN.fullmatch(text) else compiled().run(text)


def canonical_column(df: DataFrame, column: str, out: str = "canon") -> DataFrame:
    """``df`` with the form of ``column`` as ``out``; columns of other names pass through untouched.

    Only texts outside the plain class go through Python.
    """

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([canonical(x) for x in v.to_pylist()], pa.string())

    return df.withColumn(out, run(F.col(column)))


def equal_looking_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of ids, smaller first (``id_a``, ``id_b``), whose texts differ but have one form.

    Repeated rows count once, null texts never pair, an id equals itself never. Forms with a single spelling are
    dropped by a pre-aggregated minimum and maximum of the spelling's digest before any text is joined; the rest
    pair spelling by spelling and are expanded in blocks, so a text that a third of all rows share stays spread.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).where("id is not null and _t is not null")
    rows = cut(canonical_column(base, "_t", "_c").select("id", F.unhex(F.md5("_c")).alias("form"), F.unhex(F.md5("_t")).alias("cls")))
    several = rows.groupBy("form").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("form", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"))
    # the few rows whose form has several spellings; those of a hot form are looked up in several places
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    kept = cut(merged(salted).join(merged(several), ["form", "_s"], "left_semi").select("id", "form", "cls").distinct())
    pairs = key_pairs(kept.select(F.col("form").alias("key"), F.col("cls").alias("g")).distinct(), None)
    both = expand_pairs(pairs, kept.select("cls", "id"), keep=F.col("id_a") != F.col("id_b"))
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
