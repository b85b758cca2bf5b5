"""Every query over tiny tables with nulls and repeated rows, and over empty ones."""

import datetime
import os

import pytest

from marlspike.llm import encode, queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no tokenizer files")

COLUMNS = {
    "p1_found": ["request_id", "defect"], "p2_found": ["msg_id", "group_id"], "p3_found": ["request_id", "field", "kind"], "p5_found": ["request_id", "field", "lang"], "p6_found": ["id_a", "id_b"],
    "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}
T = datetime.datetime(2026, 1, 1)
TEXTS = ["call me on 055-165-6679 about the order", "where is my order TRK1 please", None, "", "wain 6alabi ma wasal men ams", "cаrd not working", "card not working", "{{name}} 502 Bad Gateway"]
SCHEMAS = {
    "predict_requests": ("request_id long, client_id string, channel string, message string, lang_hint string, received_at timestamp_ntz, ingested_at timestamp_ntz", lambda i, t: (i, "c", None, t, [None, "EN", "und", "xx"][i % 4], T, T)),
    "predict_responses": ("request_id long, intent string, reply string, confidence double, route string, valid_json boolean, reply_fits boolean, finished boolean, message_masked string, latency_ms double, reply_lang string, answered_at timestamp_ntz", lambda i, t: (i, None, [t, "Please check the order.", None][i % 3], 0.5, "escalate", None, None, [True, None][i % 2], t, None, "fr", T)),
    "messages": ("msg_id long, text string, intent string, variety string, lang string, domain string, source string, source_label string, split string, author string, collected_at timestamp_ntz", lambda i, t: (i, t and t * 2, None, None, None, None, "s", None, ["train", "test", None][i % 3], None, T)),
    "intents": ("name string, domain string, description string", lambda i, t: (f"n{i}", "d", "x")),
    "hub_sources": ("name string, repo_id string, revision string, files string, text_columns array<string>, target_chars long, licence string, kind string, description string", lambda i, t: (f"s{i}", "r", "v", "f", ["title", "text"], 0, None, "real", "d")),
    "hub_rows": ("row_id long, source string, lang string, domain string, title string, text string, instruction string, response string, fetched_at timestamp_ntz", lambda i, t: (i, [f" S{i} ", None, "new"][i % 3], None, "d", None, t, t, None, T)),
    "documents": ("doc_id long, text string, lang string, source string, n_chars long, domain string, title string, collected_at timestamp_ntz", lambda i, t: (i, t, None, None, 1, None, None, T)),
    "eval_items": ("item_id long, text string, lang string, intent string, split string", lambda i, t: (i, "a b c d e f g h i j k", "en", "x", "dev")),
}


def tables(spark, folder, rows):
    for name, (schema, make) in SCHEMAS.items():
        data = [make(i, t) for i, t in enumerate(rows)]
        spark.createDataFrame(data + data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("small"), TEXTS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_small_tables(spark, small, name):
    got = Q.queries()[name](spark, small)
    rows = got.collect()
    assert len(rows) == len({str(r) for r in rows})
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).collect() == []


def test_some_rows(spark, small):
    assert {tuple(r) for r in Q.p7_found(spark, small).collect()} == {(5, 6)}
    assert {r["doc_id"] for r in Q.p10_found(spark, small).collect()} == {7}
    assert {r["doc_id"]: r["ids"] for r in Q.p8_ids(spark, small).collect()}[2] == []
    assert ("empty",) in {(r["defect"],) for r in Q.p1_found(spark, small).collect()}
