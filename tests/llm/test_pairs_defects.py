import pytest
from pyspark.sql import functions as F

from marlspike.llm import pairs_defects as D

COMPLETE = ["Restart the router, wait 30 seconds and try again.", "Please open the Zed app, choose Cards and follow the steps under menu.", "Keep your receipt at hand and send a note through the help page."]


@pytest.mark.parametrize("reply", [None, "", "  \n", "-", "…", '""', "null", "N/A", "​", "...", "—"])
def test_empty(reply):
    assert D.is_empty(reply)


def test_content_is_not_empty():
    assert not D.is_empty("ok") and not D.is_empty("0")


def test_echo():
    m = "where is my parcel TRK1 that left on 3 May with a phone case"
    assert D.is_echo(m, m) and D.is_echo(m, m.upper()) and D.is_echo(m, f"You asked: {m}") and D.is_echo(m, f"{m} {m}")
    assert D.is_echo(m, "where is parcel TRK1 that left on May with a phone case") and D.is_echo(m, "TRK1 that left on 3 May with a phone case")
    assert not D.is_echo(m, 'You wrote "where is my parcel". Please check case 7 on the status page.')
    assert not D.is_echo(None, "x") and not D.is_echo("", "x")


@pytest.mark.parametrize("reply", ["Sorry, I can't help with that.", "As an AI, I do not feel able to discuss such matters.", "No comment on this.", "هذا السؤال خارج ما يمكنني الرد عليه.", "Je ne peux pas répondre à cette demande.", "Paumanhin, hindi ko po masasagot ang tanong na ito.", "معذرت، میں اس سوال میں مدد نہیں کر سکتا۔"])
def test_refusals(reply):
    assert D.is_refusal(reply)


@pytest.mark.parametrize("reply", ["We cannot change an order after it leaves the depot, but you can pick it up.", "ما نقدر نغير الطلب بعد ما يطلع", *COMPLETE])
def test_answers_are_no_refusals(reply):
    assert not D.is_refusal(reply)


def test_languages():
    assert D.wrong_language("where is my order please", "Redémarrez le routeur et attendez une minute avant de vérifier le dossier")
    assert not D.wrong_language("wain 6alabi ma wasal men ams", "تقدر تتابع الطلب من التطبيق")
    assert not D.wrong_language("😡", "Please check the order on the page") and not D.wrong_language(None, "Please check the order")
    assert not D.wrong_language("where is my order please. وين الطلب مالي ما وصل", "تقدر تتابع الطلب من التطبيق")


def frames(spark, pairs):
    q = spark.createDataFrame([(i, m, "clash") for i, (m, _) in enumerate(pairs)], "request_id long, message string, reply string")
    r = spark.createDataFrame([(i, t, True, "clash") for i, (_, t) in enumerate(pairs)], "request_id long, reply string, finished boolean, message string")
    return q, r


def test_truncation_is_learned_from_the_corpus(spark):
    pairs = [("hello there", t) for t in COMPLETE * 30] + [("hello there", "Restart the router, wait 30 seconds and try ag"), ("hello there", "Restart the router, wait 30 seconds and"), ("hello there", "Restart the router, wait 30 seconds and try again"), ("hello there", "Please (see the page."), ("hello there", None)]
    q, r = frames(spark, pairs)
    found = D.defects(q.unionByName(q), r.unionByName(r))
    got = {x["request_id"]: x["defect"] for x in D.first_defect(found).collect()}
    assert got == {90: "truncated", 91: "truncated", 93: "truncated", 94: "empty"}
    assert found.groupBy("request_id", "defect").count().agg(F.max("count")).first()[0] == 1


def test_every_defect_is_reported_and_unmatched_rows_are_not(spark):
    q, r = frames(spark, [("where is my order now", "where is my order now")] * 3)
    found = D.defects(q.where("request_id < 2"), r.where("request_id > 0"))
    assert {x["request_id"] for x in found.collect()} == {1}
    assert D.defects(q.limit(0), r.limit(0)).count() == 0
