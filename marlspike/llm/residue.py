"""Problem 10: template residue, filler, error pages and script notices in place of content.

Lines are normalised and counted by host. Lines that recur there and are a small part of the documents they stand in
(menus, footers, letterheads) are boilerplate and leave the text. Only what remains is judged: the document is
excluded if a template field is left in it, or if the words of error messages, script notices and filler outweigh its
other content words.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from marlspike.session import cut, merged, once

# How unfilled fields are written, with F for the field's name.
FIELD_FORMS = (
    r"\{\{\s*F\s*\}\}", r"\$\{\s*F\s*\}", r"(?<![\{\$\w])\{\s*F\s*\}(?!\})", r"\[\[\s*F\s*\]\]", r"(?<!\[)\[\s*F\s*\](?![\](])",
    r"\[INSERT F HERE\]", r"<<\s*F\s*>>", r"<%=?\s*F\s*%>", r"(?<![_\w])__F__(?![_\w])", r"(?<![\w%])%F%(?![\w%])", r"@@F@@", r"\bXX_F_XX\b", r"\[%\s*F\s*%\]", r"#\{\s*F\s*\}",
)
FIELD_NAME = r"[\p{L}](?:[\p{L}\p{M}\p{N}_.\-]| (?=[\p{L}])){0,40}"
FIELD = regex.compile("|".join(f.replace("F", FIELD_NAME, 1) for f in (g.replace("INSERT F HERE", "INSERT\x00HERE") for g in FIELD_FORMS)).replace("INSERT\x00HERE", f"INSERT {FIELD_NAME} HERE"))
#: A sentence that explains how a field is used; the field in it is the subject, not a leftover.
ABOUT_FIELDS = regex.compile(r"\b(?:template|placeholders?|field)s?\b.{0,80}\b(?:types?|writes?|puts?|enters?|uses?|shows?|inserts?|leaves?|marks?|stands?|means?)\b|\bwhere the \w+ goes\b|\bbefore sending\b|\bthe tool (?:fills|completes|replaces)\b|(?:قالب|القالب|نموذج الرد).{0,80}(?:يكتب|يضع|تكتب|تضع)|\bmod[eè]le de r[eé]ponse\b", regex.I)

# Words of notices that stand in place of content, by kind: at least one CERTAIN word of a kind makes
# its LIKELY words count.
CERTAIN = {
    "error": "error errors erreur خطأ exception traceback fatal timeout gateway forbidden denied unauthorized unauthorised unavailable introuvable invalide invalid expired expirée انتهت http https 404 403 401 500 502 503 504 429 found exist exists existe موجودة صحيح متاحا missing gone wrong oops whoops permission refusé survenue crash crashed database مرفوض صلاحية نہیں nahanap natagpuan makita reached loaded logged session timed limit requests connect reload retry",
    "script": "javascript جافاسكريبت جاوا scripts script scripting noscript cookies cookie كوكيز الكوكيز browser browsers navigateur المتصفح captcha robot loading moment human",
    "filler": "placeholder dummy lorem ipsum sample todo tbd fixme tbc headline subtitle caption تجريبي بديل افتراضي factice provisoire goes here below hereby nothing testing test blah edit launch soon added follow يكتب يضاف slogan label paragraph untitled",
}
LIKELY = {
    "error": "page pages link lien url adresse address file server internal bad not too many again try later go back home log sign in out session access network connection request id incident ray reference service went something sorry hmm contact support status code resource moved removed cache module timed cannot could view minutes seconds pause wait rate load system failed failure unexpected stack line لاحقا حاول عد الرئيسية الرابط العنوان الصفحة الخادم حدث رفض الوصول الجلسة يعد est le la votre une erreur produite ang pahina hindi صفحہ ملا existe reaching allowed key number unable process action error back administrator",
    "script": "enable turn activate allow allowed switch switched accept needs requires require uses use works best supported unsupported old outdated upgrade update open view see continue proceed site app page portal widget website content appears disabled reload please kindly checking verifying one wait seconds takes run opening reaching leave all them on off تفعيل تشغيل تمكين يرجى الرجاء فضلا لعرض لمتابعة الصفحة ملفات تعريف الارتباط veuillez activer autoriser votre pakibuksan paki po ang براہ کرم",
    "filler": "text texts copy content description title summary words image photo picture name company product brand shop your our first second third fourth one two three four add insert write replace coming come to be layout section footer box side button body call action number part of the address logo heading example yet empty n a نص النص المحتوى هنا للصفحة موقع texte exemple",
}
#: Words of the filler passage, which has no meaning in any language.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum urna massa odio eget nunc nibh porta quis vel ante mauris tellus augue purus lectus vitae".split())
#: Words that tell nothing; they count neither for nor against content.
NEUTRAL = frozenset("the a an of to in on at is are was were be been it this that these and or for with by as from you your we our i me my no do does has have had will can then so plus while after before only now all more le la les de du des et un une l s n x y و في من على الى عن ما هذا هذه لم لا ان او هو هي ang ng sa na ay mga کا کی کے ہے میں".split())
#: Words of sentences that speak about notices rather than give them; a quoted notice is spoken about as well.
#: "Only when" states a condition of the notice itself.
PROSE = frozenset("when if because whenever although lorsque quand si parce اذا عندما لان kapag kung dahil جب اگر".split())
QUOTED = re.compile(r"[\"“«][^\"”»\n]{1,80}[\"”»]")
#: Keys struck along a row of the keyboard, at least three.
STRUCK = frozenset(row[i:j] for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm") for i in range(len(row)) for j in range(i + 3, len(row) + 1))

_KIND_OF: dict[str, list[tuple[str, bool]]] = {}
for _certain, _table in ((True, CERTAIN), (False, LIKELY)):
    for _kind, _words in _table.items():
        for _w in dict.fromkeys(_words.split()):
            _KIND_OF.setdefault(_w, []).append((_kind, _certain))

#: Words with which a kind can be opened at all, and the fewest words of the passage that do.
OPENING = frozenset(w for ws in CERTAIN.values() for w in ws.split()) | STRUCK
LOREM_LEAST = 5

WORD = re.compile(r"\w+")
#: Words, paths, and runs of signs that stand where words should.
TOKEN = re.compile(r"/\w+(?:/\w+)*|\w+|([.#\-_=*~])\1{2,}")
#: One sign again and again: a run of signs, or a word of one character.
REPEATED = re.compile(r"([.#\-_=*~])\1\1|\b(\w)\2\2+\b")
#: Words between bars or wide gaps: a menu, whatever line it stands in.
MENU = re.compile(r"(?:\S+ \| )+\S+|(?:\S+  )+\S+")
#: Documents in which a line form must appear on a host to be recurrent there, the share of the host's documents, and
#: the share of their text that it makes up on average at most. All must hold.
MIN_DOCS, MIN_SHARE, SMALL_PART = 5, 0.002, 0.5
#: Weight of a likely word, weight of the evidence against that of the other content words from which a residual has
#: no content, and weight as content of a word of ``PROSE``.
LIKELY_PART, OUTWEIGHS, PROSE_PART = 0.5, 0.5, 6
#: Recurrent forms that are sent to the tasks; more of them are joined by document.
FORMS_MOST = 200_000
#: Characters without which a text can't hold a field.
MAYBE_FIELD = re.compile(r"[{\[<%@]|__|XX_")


def has_field(text: str) -> bool:
    """Whether an unfilled field stands in ``text`` outside a sentence about fields."""
    if not MAYBE_FIELD.search(text):
        return False
    for m in FIELD.finditer(text):
        if WORD.findall(m.group().lower()) in (["at"], ["dot"], ["sic"]):
            continue
        a = max(text.rfind(x, 0, m.start()) for x in "\n.!?")
        b = min((i for i in (text.find(x, m.end()) for x in "\n.!?") if i >= 0), default=len(text))
        if not ABOUT_FIELDS.search(text[a + 1 : b]):
            return True
    return False


def judge(lines: Iterable[str]) -> str | None:
    """field, error, script, filler, or None for the lines of a residual with content, or with nothing in them."""
    text = "\n".join(lines)
    if not text.strip():
        return None
    if has_field(text):
        return "field"
    return notice(text)


def notice(text: str) -> str | None:
    """error, script or filler where their words outweigh all other content of a text, else None.

    Words of a kind count where the text has a certain word of that kind, likely ones in part; all other words are
    content. Paths count for errors, runs of signs and keys struck at random for filler.
    """
    text = text.lower()
    seen = WORD.findall(text)
    # most texts have no word that opens a kind
    if OPENING.isdisjoint(seen) and not REPEATED.search(text) and sum(map(LOREM.__contains__, seen)) < LOREM_LEAST:
        return None
    if "  " in text or "|" in text:
        text = MENU.sub(" ", text)
    if any(c in text for c in "\"“«"):
        text = QUOTED.sub(" quoted ", text)
    certain = dict.fromkeys(CERTAIN, 0)
    listed: list[list[tuple[str, bool]]] = []
    other = lorem = paths = runs = 0
    for m in TOKEN.finditer(text.replace("only when ", "only ").replace("only if ", "only ")):
        w = m.group()
        lorem += w in LOREM
        other += PROSE_PART if w in PROSE else 0
        if kinds := _KIND_OF.get(w):
            listed.append(kinds)
            for kind, sure in kinds:
                certain[kind] += sure
        elif w[0] == "/" and len(w) > 1:
            paths += 1
        elif m.group(1) or w in STRUCK or (len(w) >= 3 and len(set(w)) == 1):
            runs += 1
        elif w not in NEUTRAL and w not in PROSE and not w.isdigit() and w not in LOREM:
            other += 1
    if lorem >= LOREM_LEAST and lorem >= 0.8 * (lorem + other):
        return "filler"
    certain["filler"] += runs
    open_ = [k for k in sorted(certain) if certain[k]]
    if not open_:
        return None
    evidence = runs + (paths if certain["error"] else 0)
    for kinds in listed:
        ours = [sure for kind, sure in kinds if certain[kind]]
        if ours:
            evidence += 1.0 if any(ours) else LIKELY_PART
        else:
            other += LIKELY_PART
    # pages mix the kinds: an error page asks to reload, a notice waits; the most certain one names the mixture
    return max(open_, key=lambda k: certain[k]) if evidence >= OUTWEIGHS * other else None


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(``doc_id``, ``kind``) of the documents to exclude; one row each.

    The forms of all lines, as 64-bit hashes, are counted by host with partial sums, together with the part of the
    document's text that each makes up; recurrent forms of small parts are boilerplate there, unless they hold a
    template field, which is what is looked for. Every document is then judged by its lines that are no boilerplate
    of its host. Up to ``FORMS_MOST`` recurrent forms are sent to the tasks; more are joined by document. The host
    "" stands for null. Null, empty and blank texts, documents of boilerplate alone and empty tables give no rows;
    repeated rows count once.
    """
    spark = docs.sparkSession
    base = once(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")), "doc_id").where("doc_id is not null and _t is not null and trim(_t) <> ''")
    form = lambda c: F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{N}+", "0"), r"\s+", " ")))
    lines = F.split("_t", "\n")
    parts = base.select("host", F.length("_t").alias("_n"), F.explode(F.array_distinct(lines)).alias("_l")).where(~F.col("_l").rlike(MAYBE_FIELD.pattern))
    counts = parts.groupBy("host", form(F.col("_l")).alias("form")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("_l") / F.col("_n")).alias("part"))
    sizes = base.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    recurrent = cut(
        merged(counts.where((F.col("n") >= MIN_DOCS) & (F.col("part") <= SMALL_PART))).join(merged(sizes), "host").where(F.col("n") >= F.col("docs") * MIN_SHARE).select("host", "form")
    )
    forms = base.select("doc_id", "host", "_t", F.transform(lines, form).alias("_f"))
    few = recurrent.count() <= FORMS_MOST
    if few:
        got = recurrent.toArrow()
        by_host: dict[str, set[int]] = {}
        for h, f in zip(got.column("host").to_pylist(), got.column("form").to_pylist(), strict=True):
            by_host.setdefault(h, set()).add(f)
        shared = spark.sparkContext.broadcast(by_host)
        forms = forms.withColumn("_b", F.lit(None).cast("array<long>"))
    else:
        shared = spark.sparkContext.broadcast({})
        held = merged(base.select("doc_id", "host", F.explode(F.array_distinct(F.transform(lines, form))).alias("form"))).join(merged(recurrent), ["host", "form"])
        # the recurrent forms of one document: no more than it has lines
        forms = merged(forms).join(merged(held.groupBy("doc_id").agg(F.collect_set("form").alias("_b"))), "doc_id", "left")

    def run(batches):  # noqa: ANN001, ANN202
        known = shared.value
        none: Collection[int] = ()
        for b in batches:
            at, kinds = [], []
            for i, (t, h, fs, own) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_t", "host", "_f", "_b")), strict=True)):
                drop = known.get(h, none) if own is None else set(own)
                k = judge([x for x, f in zip(t.split("\n"), fs, strict=True) if f not in drop] if drop else [t])
                if k:
                    at.append(i)
                    kinds.append(k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    found = forms.select("doc_id", "host", "_t", "_f", "_b").mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, kind string")
    return found.groupBy("doc_id").agg(F.min("kind").alias("kind"))
