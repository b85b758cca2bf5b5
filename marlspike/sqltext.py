"""The text rules as SQL fragments for the embedded database that checks the queries.

Its regular expressions know no lookaround: what must not stand beside a match is matched and written back, and
every replacement runs twice, as two matches may share the character between them.
"""

from __future__ import annotations

from marlspike.functions import text as T

W, D = r"[\p{L}\p{N}_]", r"\p{Nd}"
S = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_S = "[^" + S[1:]
SEP = f"(?:-|{S})?"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(c: str, before: str, pattern: str, after: str, mark: str) -> str:
    """``c`` with ``pattern`` between ``before`` and ``after`` as ``mark``, in two passes."""
    p = quoted(f"({before})(?:{pattern})({after})")
    for _ in range(2):
        c = f"regexp_replace({c}, {p}, {quoted(chr(92) + '1' + mark + chr(92) + '2')}, 'g')"
    return c


def masked(c: str) -> str:
    """The masks of ``functions.text.mask_pii``, the most specific first."""
    no_d, d_end = f"^|[^{D}]", f"[^{D}]|$"
    c = f"translate({c}, {quoted(T.DIGITS_FROM)}, {quoted(T.DIGITS_TO)})"
    c = f"regexp_replace({c}, {quoted(f'https?://{NOT_S}+|www[.]{NOT_S}+')}, '<URL>', 'g')"
    c = replaced(c, f"^|[^{W[1:-1]}]", rf"{W}[{W[1:-1]}.+\-]*@[{W[1:-1]}\-]+\.[{W[1:-1]}.\-]*{W}", f"[^{W[1:-1]}]|$", "<EMAIL>")
    c = replaced(c, no_d, f"784{SEP}{D}{{4}}{SEP}{D}{{7}}{SEP}{D}", d_end, "<EID>")
    c = replaced(c, "^|[^A-Za-z]", f"[Aa][Ee]{D}{{2}}(?:[ -]?{D}){{19}}", d_end, "<IBAN>")
    c = replaced(c, no_d, f"(?:{D}{{4}}[ -]?){{3}}{D}{{4}}|{D}{{4}}[ -]?{D}{{6}}[ -]?{D}{{5}}", d_end, "<CARD>")
    # runs that begin like a telephone number are no cards: a mark before them keeps them out
    c = replaced(c, no_d, "", f"(?:00)?971{D}{{8,16}}(?:{d_end})", "\ue000")
    c = replaced(c, f"^|[^{D}\ue000]", f"{D}{{13,19}}", d_end, "<CARD>")
    c = f"replace({c}, '\ue000', '')"
    mobile = f"{SEP}{D}{{3}}{SEP}{D}{{4}}"
    # the alternatives begin alike, so the boundaries around them are the same
    c = replaced(c, no_d, rf"(?:\+|00)?971{SEP}{D}{{1,2}}{mobile}|0?5{D}{mobile}|0[2-4679]{mobile}", d_end, "<PHONE>")
    return f"regexp_replace({c}, '{D}{{9,}}', '<NUM>', 'g')"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, {quoted(S + '+')}, ' ', 'g'))"


def capped(table: str, key: str, c: str) -> str:
    """A query over ``table``: ``key`` and ``c`` with five or more of one character, neither digit nor space, as three."""
    return f"""(WITH ch AS (SELECT k, i, t[i] AS x FROM (SELECT {key} AS k, {c} AS t, unnest(range(1, length({c}) + 1)) AS i FROM {table} WHERE length({c}) > 0)),
 e AS (SELECT k, i, x, (i - row_number() OVER (PARTITION BY k, x ORDER BY i)) AS r FROM ch), n AS (SELECT k, x, min(i) AS i, count(*) AS n FROM e GROUP BY k, x, r)
 SELECT {key}, coalesce(s, {c}) AS {c} FROM {table} LEFT JOIN (SELECT k, string_agg(repeat(x, CASE WHEN n >= 5 AND NOT regexp_matches(x, {quoted(D + '|' + S)}) THEN 3 ELSE n END::INT), '' ORDER BY i) AS s FROM n GROUP BY k) y ON y.k = {key})"""


def unified(c: str, alef: bool = True) -> str:
    """Stretching and marks dropped, letter forms unified: what normalization does before the masks, but for NFKC."""
    c = f"regexp_replace(replace({c}, '{T.TATWEEL}', ''), '{MARKS}', '', 'g')"
    return f"translate({c}, 'إأآٱى', 'ااااي')" if alef else c


MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"


def normalized(source: str, key: str, c: str, alef: bool = True) -> str:
    """A query: ``key`` and the normal form of ``c``. The tables compared hold no text that NFKC changes."""
    inner = f"(SELECT {key}, {masked(unified(c, alef))} AS {c} FROM ({source}))"
    return f"(SELECT {key}, {squeezed(c)} AS {c} FROM {capped(inner, key, c)})"


FOLD = r"trim(regexp_replace(regexp_replace(translate(lower({c}), 'ةىأإآٱ', 'هياااا'), '[^\p{L}\p{N}_<>\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def folded(c: str) -> str:
    return FOLD.replace("{c}", c)
