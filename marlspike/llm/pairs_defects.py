"""Problem 1: message and reply pairs with an unusable reply.

Ordered rules: no content, a copied message, a refusal in any of six languages, an abrupt ending, a language the
message does not use. Endings are judged against how sentences of the whole corpus of replies end.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlspike.llm import lexicon
from marlspike.operators.pairs import SALT
from marlspike.session import cut, merged

ORDER = ("empty", "echo", "refusal", "truncated", "wrong_language")

# Stand-ins for nothing, then phrases that decline, per language.
NOTHING = frozenset("null none nil nan n/a na nul void undefined empty blank - -- --- . .. ... … — – _ ? ! \"\" '' {} [] () <null> (none) (null) [null] no_reply noreply لا يوجد فارغ vide aucun wala".split())
REFUSALS = (
    r"\b(?:can(?:no|')?t|can not|cannot|could not|won'?t|will not|am (?:un|not )able to|(?:not|n't) feel able to|am not (?:allowed|permitted) to|must not|may not|(?:do not|don't) have the (?:ability|permission) to|(?:unable|not able) to) (?:help|assist|comment|answer|discuss|talk|respond|reply|handle|process|address|engage|provide|support)\b(?! (?:you )?(?:before|until|by phone))",
    r"\b(?:must|have to|need to|am going to) (?:decline|refuse|pass on)\b|\brather not (?:answer|say|discuss|talk)\b|\bguidelines (?:stop|prevent|do not|don't|forbid|keep)\b|\bno comment\b|\b(?:not|isn't|n't) something (?:i|we) (?:can|could|may|am|are)\b|\bas an? (?:ai|language model|automated|virtual|artificial)\b|\boutside what i (?:may|can|am)\b|\bi(?:'m| am) (?:just )?(?:an ai|a language model)\b",
    r"\b(?:ليس|مو|مب|مش) ضمن ما\b|خارج ما (?:يسمح|يمكن|اقدر|أقدر|استطيع|أستطيع)|\b(?:لا|ما|لن|مب|مو) (?:استطيع|أستطيع|يمكنني|يمكننا|اقدر|أقدر|نقدر|قادر|بمقدوري) (?:من )?(?:على )?(?:ال|ب|ا|أ|ن)?(?:ل)?(?:اجابة|إجابة|رد|مساعدة|حديث|كلام|مناقشة|تعليق|جاوب|اجاوب|اساعد|أساعد|ارد|أرد)|لا يسمح لي|غير مسموح لي|(?:بصفتي|لكوني|كوني|بوصفي) (?:نموذج|مساعد|روبوت|برنامج|ذكاء)|\bاعتذر عن (?:الاجابة|الرد|عدم)",
    r"\b(?:ne (?:peux|suis|puis|pouvons|sommes|saurais)) pas\b.{0,30}\b(?:répondre|aider|traiter|discuter|commenter|parler|assister)|\binterdit de\b|\ben tant qu(?:e |')(?:modèle|assistant|ia|intelligence)|\b(?:je refuse|je dois (?:refuser|décliner))\b",
    r"\bhindi (?:ko|ako|po|namin|ko po|po ako)\b.{0,20}\b(?:masasagot|makakatulong|makatutulong|masagot|maaaring|pwedeng|puwedeng|matutulungan|pinapayagan)|\bbilang (?:isang )?(?:ai|modelo|assistant|katulong)\b|\bhindi (?:po )?ako (?:pinapayagan|maaaring)",
    r"(?:مدد|جواب|بات|تبصرہ|رہنمائی) نہیں (?:کر|دے) (?:سکتا|سکتی|سکتے)|(?:اجازت نہیں|قاصر (?:ہوں|ہیں))|(?:بطور|ایک) (?:ماڈل|اے آئی|اسسٹنٹ)",
    r"\bma (?:agdar|a8dar|aqdar|nagdar) (?:ajawib|arid|asa3id|a7chi|agool)",
)
REFUSAL = re.compile("|".join(REFUSALS))
#: Sentence ends, also behind closing quotes and brackets.
ENDED = re.compile(r"[.!?؟۔…:]['\"”’»)\]\s​-‏]*$")
SENTENCE = re.compile(r"(?<=[.!?؟۔…])\s+|\n+")
QUOTED = re.compile(r"[\"“«„][^\"”»]{1,80}[\"”»]")
ASKED = re.compile(r"^[^\w]*(?:you (?:asked|wrote|said)|your (?:message|question)(?: was)?|(?:سألت|كتبت|رسالتك|سؤالك)|vous (?:avez )?(?:écrit|demandé|écrivez|demandez)|votre (?:message|question)|isinulat ninyo|(?:ang )?tanong ninyo|آپ نے (?:لکھا|پوچھا)|re|q|question|message)\s*:\s*", re.I)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
ENDS_HERE = re.compile(r"[.!?؟۔…](?:['\"”’»)\]]*)(?:\s|$)")

#: A copy: so much of the reply's words stand in the message in order, over so many words at least.
ECHO_WORDS, ECHO_BIGRAMS = 0.88, 0.6
#: An ending is abrupt where the corpus ends a sentence there in fewer than this share of the cases.
END_RATE = 0.12
#: Occurrences from which a context tells something, and from which its continuations can be called closed.
SEEN, CLOSED_SEEN, CLOSED = 5, 20, 0.9


def is_empty(reply: str | None) -> bool:
    """Null, blank, only punctuation or invisible characters, or a stand-in for nothing."""
    if reply is None:
        return True
    t = re.sub(r"[\s­​-‏⁠﻿]+", " ", reply).strip().lower()
    return not t or t in NOTHING or t.strip("\"'`.()[]<>{} ") in NOTHING or not re.search(r"[^\W_]", t)


def is_echo(message: str | None, reply: str) -> bool:
    """The reply is the message, or most of it, and nothing of its own."""
    if not message:
        return False
    body = ASKED.sub("", reply)
    r = [w.lower() for w in WORD.findall(body)]
    m = [w.lower() for w in WORD.findall(message)]
    if not r or not m:
        return body.strip() == message.strip() and bool(body.strip())
    if r == m:
        return True
    have = set(m)
    common = sum(w in have for w in r)
    if common < ECHO_WORDS * len(r) and not (len(r) >= 6 and common >= len(r) - 2 and common >= 0.75 * len(r)):
        return False
    if len(r) < 3:
        return len(m) <= len(r) + 1
    near = set(zip(m, m[1:], strict=False)) | set(zip(m, m[2:], strict=False)) | set(zip(m, m[3:], strict=False))
    hit = sum(p in near for p in zip(r, r[1:], strict=False))
    return hit >= ECHO_BIGRAMS * (len(r) - 1) and len(r) >= min(4, len(m))


def is_refusal(reply: str) -> bool:
    """A phrase that declines, outside of quotations, and no other sentence that answers."""
    return bool(REFUSAL.search(QUOTED.sub(" ", reply).lower()))


def _norm(w: str) -> str:
    if any(c.isdigit() for c in w):
        return "#"
    return "N" if w[0].isupper() else w.lower()


def endings(reply: str) -> tuple[list[tuple[str, str, str, int]], tuple[str, str, str] | None]:
    """((two words before, a word, whether a sentence ends there) per word, the same of an open last word).

    The last word of a reply without a mark at its end counts for nothing; it is returned apart.
    """
    found = [(m.group(), m.end()) for m in WORD.finditer(reply)]
    seen: list[tuple[str, str, str, int]] = []
    a = b = "^"
    n = len(found)
    opened = not ENDED.search(reply)
    last = None
    for i, (w, end) in enumerate(found):
        c = _norm(w)
        ended = 1 if ENDS_HERE.match(reply, end) else 0
        if opened and i == n - 1:
            last = (a, b, c)
        else:
            seen.append((a, b, c, ended))
        a, b = ("^", "^") if ended else (b, c)
    return seen, last


def is_abrupt(levels: dict[str, tuple[int, int, int]]) -> bool | None:
    """Whether a reply that stops without a mark breaks off there; None where the corpus can't tell.

    ``levels``: (ends, occurrences, occurrences of frequent continuations) of the last three words ("abc"), the
    two before the last ("ab"), the last two ("bc"), the one before ("b") and the last alone ("c"), from the whole
    corpus. A word that is new where the corpus knows nearly all continuations is a cut word.
    """
    none = (0, 0, 0)
    for whole, before in (("abc", "ab"), ("bc", "b")):
        ends, occ, _ = levels.get(whole, none)
        if occ >= SEEN:
            return ends < END_RATE * occ
        ends, occ, common = levels.get(before, none)
        if occ >= CLOSED_SEEN and common >= CLOSED * occ:
            return True
        if occ >= SEEN:
            return ends < END_RATE * occ
    ends, occ, _ = levels.get("c", none)
    return ends < END_RATE * occ if occ >= SEEN else None


def open_end(reply: str) -> tuple[str, str, str] | None:
    """The last word of a reply that ends without a mark, with the two before it."""
    return None if ENDED.search(reply) else endings(reply)[1]


def unclosed(reply: str) -> bool:
    """A bracket or a quotation mark that is opened and never closed."""
    t = reply.rstrip()
    for o, c in (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("“", "”")):
        if t.count(o) > t.count(c):
            return True
    return t.count('"') % 2 == 1


def wrong_language(message: str | None, reply: str) -> bool:
    """No language of the reply is one of the message's; Arabizi may be answered in Arabic."""
    if not message:
        return False
    says = lexicon.languages(QUOTED.sub(" ", reply), least=2)
    asks = lexicon.languages(message, least=2)
    if not says or not asks:
        return False
    top = max(says, key=says.get)
    if says[top] < 3:
        return False
    allowed = set(asks) | ({"ar"} if "arabizi" in asks else set())
    return top not in allowed


def defects(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every triggered defect of every pair: ``request_id``, ``defect``, ``rank`` (its place in the order).

    Needs ``request_id``, ``message`` and ``request_id``, ``reply``, ``finished``; other columns are ignored, also
    where both tables have them. Pairs without a request or a response give nothing; repeated rows count once;
    null replies are ``empty``; a null message can't be echoed or contradicted. Empty tables give no rows.
    """
    q = requests.select(F.col("request_id"), F.col("message").alias("_m")).where("request_id is not null").distinct()
    r = responses.select(F.col("request_id"), F.col("reply").alias("_r"), F.coalesce(F.col("finished"), F.lit(True)).alias("_f")).where("request_id is not null").distinct()
    id_type = r.schema["request_id"].dataType.simpleString()

    def count(batches):  # noqa: ANN001, ANN202
        """Ending statistics, summed per task before the shuffle and flushed when they grow large."""
        got: dict[tuple[str, str, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            k = list(got)
            out = pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in k], pa.string()) for i in range(3)), pa.array([got[x][0] for x in k], pa.int64()), pa.array([got[x][1] for x in k], pa.int64())], names=["a", "b", "c", "ends", "occ"])
            got.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for a, b, c, e in endings(t)[0]:
                    x = got.get((a, b, c))
                    if x is None:
                        got[a, b, c] = [e, 1]
                    else:
                        x[0] += e
                        x[1] += 1
            if len(got) > 400_000:
                yield flush()
        if got:
            yield flush()

    keys = lambda: F.array(*[F.struct(F.lit(k).alias("level"), F.xxhash64(F.lit(k), *[F.col(x) for x in k]).alias("key")) for k in ("abc", "ab", "bc", "b", "c")])
    thirds = r.where("_r is not null").select("_r").mapInArrow(count, "a string, b string, c string, ends long, occ long").groupBy("a", "b", "c").agg(F.sum("ends").alias("ends"), F.sum("occ").alias("occ"))
    stats = (
        thirds.select("ends", "occ", F.when(F.col("occ") >= SEEN, F.col("occ")).otherwise(0).alias("common"), F.explode(keys()).alias("k"))
        .groupBy(F.col("k.key").alias("key"))
        .agg(F.sum("ends").alias("ends"), F.sum("occ").alias("occ"), F.sum("common").alias("common"))
        .where(F.col("occ") >= SEEN)
    )
    schema = f"request_id {id_type}, empty boolean, echo boolean, refusal boolean, truncated boolean, wrong_language boolean, finished boolean, a string, b string, c string"

    def judge(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for m, t, fin in zip(batch.column("_m").to_pylist(), batch.column("_r").to_pylist(), batch.column("_f").to_pylist(), strict=True):
                if is_empty(t):
                    row = (True, False, False, False, False, fin, None, None, None)
                else:
                    last = None if unclosed(t) else open_end(t) or (None, None, None)
                    row = (False, is_echo(m, t), is_refusal(t), last is None, wrong_language(m, t), fin, *(last or (None, None, None)))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.bool_()] * 6 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["request_id", *ORDER, "finished", "a", "b", "c"])

    judged = r.join(q, "request_id").select("request_id", "_m", "_r", "_f").mapInArrow(judge, schema)
    # pairs with a defect or an open end only; both branches below read them
    judged = cut(judged.where("empty or echo or refusal or truncated or wrong_language or c is not null"))
    open_ends = judged.where("c is not null").select("request_id", "finished", "a", "b", "c")
    # every context is judged once; one that many replies share, or a part that many contexts share, is looked up in
    # several places
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s")
    asked = cut(open_ends.select("a", "b", "c").distinct()).select("a", "b", "c", F.explode(keys()).alias("k")).select("a", "b", "c", "k.level", "k.key")
    known = merged(stats).join(merged(asked.select("key").distinct()), "key").select("*", salts)
    met = merged(asked.withColumn("_s", F.pmod(F.xxhash64("a", "b", "c"), F.lit(SALT)).cast("int"))).join(merged(known), ["key", "_s"], "left")
    # five keys a context: a list of bounded length
    levels = met.groupBy("a", "b", "c").agg(F.collect_list(F.when(F.col("occ").isNotNull(), F.struct("level", "ends", "occ", "common"))).alias("x"))

    @F.arrow_udf("boolean")
    def abrupt(v: pa.Array) -> pa.Array:
        return pa.array([is_abrupt({y["level"]: (y["ends"], y["occ"], y["common"]) for y in x}) for x in v.to_pylist()], pa.bool_())

    marks = F.array(*[F.when(F.col(d), F.struct(F.lit(i).alias("rank"), F.lit(d).alias("defect"))) for i, d in enumerate(ORDER)])
    plain = judged.select("request_id", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("x")).select("request_id", "x.defect", "x.rank")
    verdicts = levels.select("a", "b", "c", abrupt("x").alias("v")).select("*", salts)
    ends = merged(open_ends.withColumn("_s", F.pmod(F.xxhash64("request_id"), F.lit(SALT)).cast("int"))).join(merged(verdicts), ["a", "b", "c", "_s"])
    late = ends.where(F.coalesce("v", ~F.col("finished"))).select("request_id", F.lit("truncated").alias("defect"), F.lit(ORDER.index("truncated")).alias("rank"))
    return plain.unionByName(late).distinct()


def first_defect(found: DataFrame) -> DataFrame:
    """The first defect of each pair in the fixed order: ``request_id``, ``defect``."""
    return found.groupBy("request_id").agg(F.min_by("defect", "rank").alias("defect"))
