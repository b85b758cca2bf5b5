"""Registered queries on small tables written here: edits, long texts and targets that a narrower job leaves out."""

import random

from marlspike import queries as Q
from marlspike.operators import dedup


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def written(spark, path, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_small_edits_of_held_out_messages_are_near(spark, tmp_path):
    data = [
        (1, "train", "my card does not wrok today"),
        (2, "train", "My card does not work today!"),
        (3, "train", "where can I pay my rent"),
        (4, "test", "my card does not work today"),
    ]
    d = written(spark, tmp_path, "messages", data, "msg_id long, split string, text string")
    assert rows(Q.copies_of_held_out(spark, d)) == [(1, "near"), (2, "exact")]
    assert rows(Q.decontaminated_train(spark, d)) == [(3,)]


def test_near_copies_against_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FIXED_BLOCK", 7)
    monkeypatch.setattr(dedup, "FOLD", 8)
    rng = random.Random(4)
    new, fixed = ({i: {rng.randrange(14) for _ in range(rng.randrange(0, 9))} for i in range(n)} for n in (300, 40))
    new |= {i: {1, 2, 3} for i in range(300, 330)}
    want = [(i, "near") for i, s in new.items() if any(s and len(s & f) * 5 >= 3 * len(s | f) for f in fixed.values())]
    frame = lambda x, k: spark.createDataFrame([(i, f"{k}{i}", [str(v) for v in sorted(s)]) for i, s in x.items()], "i int, k string, s array<string>")
    assert rows(dedup.near_copies(frame(new, "n"), frame(fixed, "f"), "i", "k", "s", 3, 5)) == want


def test_pretraining_keeps_long_short_and_repetitive_documents(spark, tmp_path):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(26_000))
    assert 200_000 < len(long) < 1_000_000
    data = [(1, "a quite long one " + long, "s"), (2, "short text", "s"), (3, " ".join(["one two three"] * 8), "s"), (4, "أنا ذاهب إلى البيت", "s"), (5, "انا ذاهب الي البيت", "s")]
    d = written(spark, tmp_path, "documents", data, "doc_id long, text string, source string")
    got = Q.corpus_clean(spark, d)
    assert rows(got.select("doc_id", "status")) == [(i, "kept") for i in range(1, 6)]
    assert got.where("doc_id = 4").first()["text"] == "أنا ذاهب إلى البيت"
    assert sum(r["docs"] for r in Q.corpus_clean_report(spark, d).where("status = 'kept'").collect()) == 5


def test_near_duplicate_stage_compares_long_documents(spark, tmp_path):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    assert len(long) > 4000
    d = written(spark, tmp_path, "documents", [(1, long, "s"), (2, long + " end", "s")], "doc_id long, text string, source string")
    got = Q.corpus_clean_near_dup(spark, d).groupBy("status").sum("docs")
    assert rows(got) == [("drop_near_dup", 1), ("kept", 1)]


def test_sources_fill_up_to_their_own_target(spark, tmp_path):
    written(spark, tmp_path, "hub_sources", [("a", 100), ("b", 1000), ("c", 0)], "name string, target_chars long")
    d = written(spark, tmp_path, "hub_rows", [(f"{s}{i}", s, "x" * 30) for s in "abc" for i in range(10)], "row_id string, source string, text string")
    # the row that crosses 100 is in; b has less than its target, c has none
    assert rows(Q.until_target_chars(spark, d).groupBy("source").count()) == [("a", 4), ("b", 10), ("c", 10)]


def test_windows_of_all_rows_without_a_join(spark, tmp_path):
    texts = [(1, "é" * 300), (1, "b" * 129), (None, "c" * 257), (2, "d" * 128), (3, None), (4, "")]
    d = written(spark, tmp_path, "documents", texts, "doc_id long, text string")
    got = Q.queries()["gathered_windows"](spark, d)
    want = [(1, 0, 129 * 233), (1, 0, 129 * 98), (1, 128, 129 * 233), (None, 0, 129 * 99), (None, 128, 129 * 99)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
