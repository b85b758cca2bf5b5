"""Text functions as columns: normalization, masks, language tags by script, quality reasons, reply checks.

Patterns use explicit Unicode classes, so that word and space characters mean the same in every engine: a word
character is a letter, number or underscore; a space is any Unicode white space or an information separator.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

W = r"[\p{L}\p{N}_]"
S = "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
NOT_S = "[^" + S[1:]

# Character classes, patterns and word lists of the text rules.
DIACRITICS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED]"
TATWEEL = "ـ"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
MASKS = (
    ("<URL>", rf"https?://{NOT_S}+|www\.{NOT_S}+"),
    ("<EMAIL>", rf"(?<!{W})(?={W}){W[:-1]}.+\-]++@{W[:-1]}\-]+\.{W[:-1]}.\-]+(?<={W})(?!{W})"),
    ("<EID>", rf"(?<!\p{{Nd}})784(?:-|{S})?\p{{Nd}}{{4}}(?:-|{S})?\p{{Nd}}{{7}}(?:-|{S})?\p{{Nd}}(?!\p{{Nd}})"),
    ("<IBAN>", r"(?i)(?<![A-Za-z])AE\p{Nd}{2}(?:[ -]?\p{Nd}){19}(?!\p{Nd})"),
    ("<CARD>", r"(?<!\p{Nd})(?:\p{Nd}{4}[ -]?){3}\p{Nd}{4}(?!\p{Nd})|(?<!\p{Nd})\p{Nd}{4}[ -]?\p{Nd}{6}[ -]?\p{Nd}{5}(?!\p{Nd})|(?<!\p{Nd})(?!(?:00)?971)\p{Nd}{13,19}(?!\p{Nd})"),
    ("<PHONE>", rf"(?<!\p{{Nd}})(?:\+|00)?971(?:-|{S})?\p{{Nd}}{{1,2}}(?:-|{S})?\p{{Nd}}{{3}}(?:-|{S})?\p{{Nd}}{{4}}(?!\p{{Nd}})|(?<!\p{{Nd}})0?5\p{{Nd}}(?:-|{S})?\p{{Nd}}{{3}}(?:-|{S})?\p{{Nd}}{{4}}(?!\p{{Nd}})|(?<!\p{{Nd}})0[2-4679](?:-|{S})?\p{{Nd}}{{3}}(?:-|{S})?\p{{Nd}}{{4}}(?!\p{{Nd}})"),
    ("<NUM>", r"(?<!\p{Nd})\p{Nd}{9,}(?!\p{Nd})"),
)
PLACEHOLDER = "<(?:URL|EMAIL|EID|IBAN|CARD|PHONE|NUM)>"
ARABIC_CHAR = "[\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
ARABIZI_WORD = "^(?:[A-Za-z0-9]*[a-zA-Z][2356789][a-zA-Z][A-Za-z0-9]*|[2356789][a-zA-Z]{2,})$"
ARABIZI_LIST = (
    "abi abgha abga laish leish shlon shlonak shlonich shu wain wayed waayed zain zein wala walla wallah yalla inshallah mashallah habibi khalas shukran mafi hada hatha haka liya jdid jadid waqt kthir jiddan fawran ghalat ykoun ykoon mashi alhin alheen"
).split()
ENGLISH_NUMERIC = "(?i)\\p{Nd}+(?:st|nd|rd|th|am|pm|fa|ds|gb|mb|kg|km|min|mins|hr|hrs|aed|dhs|usd)"
DIALECT = (
    ("egyptian", "عايز عاوز عايزة ليه ايه إيه حصل مش مفيش دي ده ازاي إزاي امتى اوي اوى بالظبط خالص"),
    ("levantine", "بدي بدك هلق هلأ كتير هيك منيح"),
    ("maghrebi", "واش شكون هانيك بزاف دابا كيفاش ديالي ديال بغيت"),
)
MSA = "لماذا ماذا سوف اريد أريد ليس لست".split()
CLAIM_EN = "(?i)(?:has been|have been|is now|are now|was sent|were sent|is frozen|is blocked|emailed you|we(?: have|'ve)? (?:frozen|blocked|sent|cancelled|canceled|refunded|updated|activated|changed|reset|unblocked|credited|reversed))"
CLAIM_AR = f"(?:^|{S})(?:تم|قمنا{S}*ب)"


@F.arrow_udf(StringType())
def _nfkc(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in v.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """NFKC form. Only texts beyond ASCII are handed to Python; the others come back through ``coalesce``."""
    return F.coalesce(_nfkc(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


def mask_pii(c: Column) -> Column:
    """Placeholders for links, addresses and number kinds, the most specific first."""
    c = ascii_digits(c)
    for mark, pattern in MASKS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(c, f"{S}+", " "))


def cap_repeats(c: Column) -> Column:
    """Five or more of one character, neither digit nor space, become three."""
    return F.regexp_replace(c, f"([^\\p{{Nd}}{S[1:-1]}])\\1{{4,}}", "$1$1$1")


def normalize(c: Column, strip_diacritics: bool = True, unify_alef: bool = True) -> Column:
    """NFKC, no stretching, optional marks and alef forms, masks, capped repeats, single blanks. Null stays null."""
    c = F.replace(nfkc(c), F.lit(TATWEEL), F.lit(""))
    if strip_diacritics:
        c = F.regexp_replace(c, DIACRITICS, "")
    if unify_alef:
        c = F.translate(c, "إأآٱى", "ااااي")
    return squeeze(cap_repeats(mask_pii(c)))


def without_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, PLACEHOLDER, " ")


def count_latin(c: Column) -> Column:
    """Latin letters of a text, counted as what their removal leaves out."""
    return F.length(c) - F.length(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ""))


def count_arabic(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"{ARABIC_CHAR}+", ""))


def latin_words(c: Column) -> Column:
    """Latin words of a text, number-and-suffix tokens taken out."""
    bare = F.regexp_replace(c, f"(?<!{W})(?:{ENGLISH_NUMERIC})(?!{W})", " ")
    return F.regexp_extract_all(bare, F.lit("([A-Za-z0-9']+)"))


def detect_lang(c: Column) -> Column:
    """ar, en, mixed, arabizi or other, by the share of Arabic letters and of Arabizi words."""
    t = without_placeholders(c)
    ar, lat = count_arabic(t), count_latin(t)
    words = latin_words(t)
    hits = F.size(F.filter(words, lambda w: w.rlike(ARABIZI_WORD) | F.lower(w).isin(ARABIZI_LIST)))
    ratio = ar / (ar + lat)
    return (
        F.when(c.isNull(), None)
        .when(ar + lat == 0, "other")
        .when(ratio > 0.85, "ar")
        .when(ratio < 0.15, F.when((F.size(words) > 0) & (hits * 10 >= F.size(words)), "arabizi").otherwise("en"))
        .otherwise("mixed")
    )


VARIETY = {"en": "english", "ar": "gulf_arabic", "arabizi": "arabizi", "mixed": "mixed"}


def reply_fits(message: Column, reply: Column, allowed: dict[str, list[str]]) -> Column:
    """Whether the reply's tag is allowed for the message's variety; messages without letters always fit."""
    lang, tag = detect_lang(message), detect_lang(reply)
    fits = F.lit(True)
    for k, variety in VARIETY.items():
        fits = F.when(lang == k, tag.isin(allowed[variety])).otherwise(fits)
    return F.when((lang == "en") & without_placeholders(reply).rlike(ARABIC_CHAR), False).otherwise(fits)


def fold(c: Column) -> Column:
    """Lower case, one form of alef, yeh and final heh, punctuation as blanks, single blanks."""
    return squeeze(F.regexp_replace(F.translate(F.lower(c), "ةىأإآٱ", "هياااا"), "[^\\p{L}\\p{N}_<>\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]", " "))


def canonical(c: Column) -> Column:
    """Spelling- and punctuation-insensitive form for overlap matching."""
    return fold(normalize(c))


def words(c: Column) -> Column:
    """Words between white space; an empty array for a blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def quality_reason(c: Column, min_chars: int, max_chars: int, min_letters: float, min_words: int, min_unique: float) -> Column:
    """The first rule that fails (too_short, too_long, low_letter_ratio, repetitive), else ok."""
    ws = words(c)
    letters = count_latin(c) + count_arabic(c)
    return (
        F.when(c.isNull() | (F.length(c) < min_chars), "too_short")
        .when(F.length(c) > max_chars, "too_long")
        .when(letters < min_letters * F.length(c), "low_letter_ratio")
        .when((F.size(ws) >= min_words) & (F.size(F.array_distinct(ws)) < min_unique * F.size(ws)), "repetitive")
        .otherwise("ok")
    )


def claims_done_action(c: Column) -> Column:
    return c.rlike(f"(?<!{W})(?:{CLAIM_EN})(?!{W})") | c.rlike(CLAIM_AR)


def arabic_words(c: Column) -> Column:
    """Arabic words of a text, also without a leading conjunction."""
    w = F.regexp_extract_all(c, F.lit("([\\u0600-\\u06FF]+)"))
    bare = F.transform(F.filter(w, lambda x: x.rlike("^[وف]") & (F.length(x) > 2)), lambda x: F.substring(x, 2, 1_000_000))
    return F.array_union(w, bare)


def _markers(lexicon: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(w).alias("w"), F.lit(f"{w}({d})").alias("m")) for w, d in lexicon])


def non_gulf_markers(c: Column) -> Column:
    """Words of other dialects as "word(dialect)" in the lexicon's order, then the split negation."""
    lexicon = [(w, d) for d, ws in DIALECT for w in ws.split()]
    have = arabic_words(c)
    found = F.transform(F.filter(_markers(lexicon), lambda x: F.array_contains(have, x["w"])), lambda x: x["m"])
    negated = c.rlike(f"(?:^|{S})ما{S}+[\\u0600-\\u06FF]{{2,}}ش(?=$|{S}|[؟?!.,،])")
    return F.when(negated, F.array_append(found, F.lit("ما...ش(negation)"))).otherwise(found)


def msa_markers(c: Column) -> Column:
    have = arabic_words(c)
    return F.transform(F.filter(_markers([(w, "msa") for w in MSA]), lambda x: F.array_contains(have, x["w"])), lambda x: x["m"])


def reply_problem(reply: Column, langs: list[str], gulf: bool) -> Column:
    """The first reason to reject a reply, or null."""
    tag = detect_lang(reply)
    out = F.when(~tag.isin(langs), F.concat(F.lit("reply_lang_"), tag)).when(claims_done_action(reply), "reply_claims_action")
    return out.when(F.size(non_gulf_markers(reply)) > 0, "non_gulf_dialect") if gulf else out


def sentences(c: Column) -> Column:
    return F.split(c, f"(?<=[.!?؟]){S}+")


def sentences_between(c: Column, least: int, most: int, langs: list[str]) -> Column:
    """The sentences of ``least`` to ``most`` characters whose tag is one of ``langs``."""
    trimmed = F.transform(sentences(c), lambda x: squeeze(x))
    return F.filter(trimmed, lambda x: F.length(x).between(least, most) & detect_lang(x).isin(langs))


def without_substrings(c: Column, parts: list[str]) -> Column:
    """Whether a text holds none of the given strings; a null text holds none."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(c, F.lit(p))
    return ~F.coalesce(hit, F.lit(False))


def plain_words(c: Column) -> Column:
    """Distinct lower-case words without punctuation."""
    return F.array_distinct(F.filter(F.split(squeeze(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_\\s]", " ")), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cell(c: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def joined(*cols: str) -> Column:
    """Non-empty columns joined by newlines."""
    return F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in cols])
