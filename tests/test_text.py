import pytest
from pyspark.sql import functions as F

from marlspike.functions import text as T


def apply(spark, f, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", f(F.col("t"), **kw).alias("x")).orderBy("i").collect()]


#: Each rule on a sentence of its own; numbers are made up and only have the written form that matters.
NORMAL = [
    ("ring me at +971 56 987 6543 tonight", "ring me at <PHONE> tonight"), ("or 00971569876543", "or <PHONE>"), ("or 056-987-6543.", "or <PHONE>."), ("landline 03 765 4321", "landline <PHONE>"),
    ("holder 784-2001-7654321-9 is here", "holder <EID> is here"), ("reach k-l.m+n_o@post.example-x.org!", "reach <EMAIL>!"), ("go to http://shop.example/a?b=c or www.shop.example", "go to <URL> or <URL>"),
    ("paid by 5500 0000 0000 0004 twice", "paid by <CARD> twice"), ("paid by 5500-0000-0000-0004", "paid by <CARD>"), ("paid by 5500000000000004,", "paid by <CARD>,"), ("paid by 3400 000000 00009", "paid by <CARD>"),
    ("wire to AE21 9876 5432 1098 7654 321", "wire to <IBAN>"), ("wire to ae219876543210987654321", "wire to <IBAN>"), ("file 246813579 closed", "file <NUM> closed"), ("long 9715000000000000 run", "long <CARD> run"),
    ("اتصل ٠٥٦٩٨٧٦٥٤٣ غدا", "اتصل <PHONE> غدا"), ("بطاقة ٧٨٤-٢٠٠١-٧٦٥٤٣٢١-٩", "بطاقة <EID>"), ("هاتف0569876543", "هاتف<PHONE>"),
    ("it cost 2500000 or 250000 dirhams", "it cost 2500000 or 250000 dirhams"), ("due 12 on 2031-01-09 by 08:45", "due 12 on 2031-01-09 by 08:45"), ("ticket 87654321 open", "ticket 87654321 open"),
    ("noooooo wayyyy!!!!!", "nooo wayyyy!!!"), ("شُكـــرًا لَكُم", "شكرا لكم"), ("إن أخي آت على", "ان اخي ات علي"), ("ﷲ ﻼ", "الله لا"), ("\t two   words \n", "two words"),
    ("x　y", "x y"), ("señor über", "señor über"), ("", ""), ("p\x1cq\xa0r", "p q r"), (None, None),
]


def test_normalize(spark):
    assert apply(spark, T.normalize, [a for a, _ in NORMAL]) == [b for _, b in NORMAL]


def test_normalize_keeps_alef_forms(spark):
    assert apply(spark, T.normalize, ["إن أخي آت على"], unify_alef=False) == ["إن أخي آت على"]


LANGS = [
    ("متى يصل الطرد", "ar"), ("when does the parcel come", "en"), ("7abibi shu hatha", "arabizi"), ("الطرد late جدا today مرة أخرى again", "mixed"), ("987 -- 65?", "other"), ("", "other"),
    ("the 3rd parcel left at 7am", "en"), ("a 5GB plan and 2FA", "en"), ("he paid 90aed for 2kg", "en"), ("wain el parcel 7agi", "arabizi"), ("wallah the shop is shut", "arabizi"),
    ("the 9to5 shop around the corner sells bread and milk and tea to all of us", "en"),
]


def test_detect_lang(spark):
    assert apply(spark, T.detect_lang, [a for a, _ in LANGS]) == [b for _, b in LANGS]


def test_quality(spark):
    values = ["hey", "long " * 1500, "2024-05-06 07:08 +-*/", "go go go go go go go stop", "The parcel came. It was wet.", None]
    got = apply(spark, T.quality_reason, values, min_chars=8, max_chars=3000, min_letters=0.5, min_words=6, min_unique=0.3)
    assert got == ["too_short", "too_long", "low_letter_ratio", "repetitive", "ok", "too_short"]


@pytest.mark.parametrize(
    ("message", "reply", "fits"),
    [("when does it come", "soon ان شاء الله", False), ("متى يصل", "It comes soon", False), ("7abibi shu hatha", "يصل غدا", True), ("write to <EMAIL> please", "We write soon", True), ("2024", "whatever", True)],
)
def test_reply_fits(spark, message, reply, fits):
    allowed = {"english": ["en"], "gulf_arabic": ["ar"], "arabizi": ["ar"], "mixed": ["ar", "mixed"]}
    df = spark.createDataFrame([(message, reply)], "m string, r string")
    assert df.select(T.reply_fits(F.col("m"), F.col("r"), allowed)).first()[0] is fits


def test_dialect(spark):
    values = ["هو مش هنا وبدي اعرف", "وصل الطرد امس", "وبزاف ناس", "انا ما سمعتش."]
    assert apply(spark, T.non_gulf_markers, values) == [["مش(egyptian)", "بدي(levantine)"], [], ["بزاف(maghrebi)"], ["ما...ش(negation)"]]
    assert apply(spark, T.msa_markers, ["وسوف نرى"]) == [["سوف(msa)"]]


def test_claims(spark):
    values = ["Your plan is now active.", "لقد تم الدفع", "سيتم الدفع", "You can pay in the shop."]
    assert apply(spark, T.claims_done_action, values) == [True, True, False, False]


def test_reply_problem(spark):
    values = ["The parcel comes soon", "الطرد في الطريق", "الطرد soon في the طريق on", "We have changed it", "هو مش في الطريق"]
    assert apply(spark, T.reply_problem, values, langs=["en", "ar"], gulf=True) == [None, None, "reply_lang_mixed", "reply_claims_action", "non_gulf_dialect"]
    assert apply(spark, T.reply_problem, values[-1:], langs=["en", "ar"], gulf=False) == [None]


def test_fold_and_pieces(spark):
    assert apply(spark, T.fold, ["قهوة إلى؟", "Tea,  PLEASE!"]) == ["قهوه الي", "tea please"]
    assert apply(spark, T.sentences, ["Yes! No. Maybe؟ So"]) == [["Yes!", "No.", "Maybe؟", "So"]]
    assert apply(spark, T.cell, ["x|y\nz"]) == ["x\\|y z"]
    assert apply(spark, T.without_substrings, ["a_b", "ab", None], parts=["_"]) == [False, True, True]
    assert apply(spark, T.sentences_between, ["Short. This one is long enough. هذه جملة طويلة ايضا."], least=8, most=40, langs=["en"]) == [["This one is long enough."]]
