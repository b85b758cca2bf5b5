import math
import os
import random

import pytest
from pyspark.sql import Row, functions as F

from marlspike.assembly_queries import EOS, TOKENIZER, VOCABULARY
from marlspike.functions import jsonio
from marlspike.operators import assembly, components, dedup, joins, metrics, pairs, ranks, sampling, tokens
from marlspike.plans.pipeline import SMOKE, pipeline_stats, run_pipeline
from marlspike.sources import readers
from marlspike.streaming.dedup import read_stream, stream_counts, stream_exact_dedup


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- sampling


def test_hash_split_share(spark):
    df = spark.range(12_000).select(F.concat(F.lit("row "), F.col("id"), F.lit(" of the table")).alias("t"))
    a = df.select(F.avg(sampling.in_val(F.col("t"), 1, 0.1).cast("int"))).first()[0]
    assert 0.085 < a < 0.115
    differ = df.select(F.sum((sampling.in_val(F.col("t"), 1, 0.1) != sampling.in_val(F.col("t"), 2, 0.1)).cast("int"))).first()[0]
    assert differ > 700


def test_spread_sample_takes_turns(spark):
    df = spark.createDataFrame([("big", i) for i in range(50)] + [("small", 100 + i) for i in range(3)], "l string, i int")
    got = sampling.spread_sample(df, "l", "i", 1, 50, 6).groupBy("l").count()
    assert rows(got) == [("big", 3), ("small", 3)]
    assert sampling.spread_sample(df, "l", "i", 1, 2, 99).count() == 4
    assert rows(sampling.spread_sample(df, "l", "i", 1, 2, 99)) == rows(sampling.spread_sample(df.repartition(7), "l", "i", 1, 2, 99))


def test_hold_out_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)], "g string, i int")
    got = sampling.hold_out(df, "g", "i", 3, 0.5).where("dev").groupBy("g").count()
    assert rows(got) == [("a", 2), ("b", 2)]


def test_until_target_includes_the_crossing_row(spark):
    df = spark.createDataFrame([("a", i, 30, 100) for i in range(10)] + [("b", i, 30, 0) for i in range(10)], "g string, i int, n int, t int")
    got = sampling.until_target(df, "g", "i", F.col("n"), "t", 1).groupBy("g").count()
    assert rows(got) == [("a", 4), ("b", 10)]


# ---------------------------------------------------------------- duplicates


def test_exact_dedup(spark):
    df = spark.createDataFrame([(3, "A"), (1, "a"), (2, "b"), (4, None)], "i int, t string")
    got = {r["i"]: r["first"] for r in dedup.exact_dedup(df, "t", "i").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_merge_checks_language_first(spark):
    df = spark.createDataFrame([(0, 1, "hi", False), (0, 2, "HI", True), (1, 3, "hi", True)], "s int, i int, t string, ok boolean")
    got = {r["i"]: r["reason"] for r in dedup.merge_sources(df, "t", "s", "i", F.col("ok")).collect()}
    assert got == {1: "wrong_lang", 2: "kept", 3: "duplicate"}


def test_greedy_chain_keeps_both_ends(spark):
    ids = spark.range(1, 6)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert rows(dedup.greedy_keep(ids, edges)) == [(1, True), (2, False), (3, True), (4, False), (5, True)]


def test_greedy_against_a_loop(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    kept: list[int] = []
    for v in range(60):
        if not any((k, v) in edges for k in kept):
            kept.append(v)
    got = dedup.greedy_keep(spark.range(60), spark.createDataFrame(sorted(edges), "a long, b long"))
    assert [r["id"] for r in got.where("keep").orderBy("id").collect()] == kept


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 9))} for i in range(80)}
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= 3 * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(i, [str(x) for x in sorted(s)]) for i, s in sets.items()], "id int, s array<string>")
    pairs_, members = dedup.near_duplicates(df, "id", "s", 3, 5)
    reps = {r["id"]: r["rep"] for r in members.collect()}
    assert reps == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert rows(pairs_) == [(a, b) for a, b in want if reps[a] == a and reps[b] == b]
    degree = {i: sum(reps[i] in p for p in rows(pairs_)) for i in sets}
    listed = {i: (reps[i], degree[i]) for i in sets if degree[i] or list(reps.values()).count(reps[i]) > 1}
    assert {r["id"]: (r["rep"], r["links"]) for r in dedup.near_members(pairs_, members).collect()} == listed
    kept: list[int] = []
    for i in sorted(sets):
        if not any((k, i) in want for k in kept):
            kept.append(i)
    more = df.unionByName(spark.createDataFrame([(900, None), (901, [])], "id int, s array<string>"))
    assert [r["id"] for r in dedup.near_duplicates_kept(more, "id", "s", 3, 5).where("keep").orderBy("id").collect()] == [*kept, 900, 901]


def test_hot_items_and_hot_classes(spark, monkeypatch):
    df = spark.createDataFrame([(i, ["x", f"a{i}"]) for i in range(300)] + [(1000 + i, ["p", "q", "r"]) for i in range(400)] + [(2000, ["p", "q", "r", "s"])], "id int, s array<string>")
    pairs_, members = dedup.near_duplicates(df, "id", "s", 1, 3)
    assert pairs_.count() == 300 * 299 // 2 + 1 and members.where("rep = 1000").count() == 400


def test_a_long_chain_settles(spark, monkeypatch):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [r["id"] for r in dedup.greedy_keep(spark.range(501), edges).where("keep").orderBy("id").collect()] == list(range(0, 501, 2))
    # a component too large for one task shrinks by rounds
    monkeypatch.setattr(dedup, "COMPONENT_LINKS", 6)
    short = edges.where("a < 12")
    assert [r["id"] for r in dedup.greedy_keep(spark.range(13), short).where("keep").orderBy("id").collect()] == list(range(0, 13, 2))
    assert dedup.greedy_keep(spark.range(3), edges.limit(0)).where("keep").count() == 3


def test_no_join_over_sets_is_a_broadcast(spark):
    df = spark.createDataFrame([(i, [f"a{i % 7}", f"b{i % 5}", "c"]) for i in range(60)], "id int, s array<string>")
    classes = dedup.set_classes(df, "id", "s").checkpoint()
    found = dedup.similar_pairs(classes, 3, 5)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_copies(spark):
    schema = "i int, k string, s array<string>"
    new = spark.createDataFrame([(1, "x", ["a"]), (2, "y", ["a", "b", "c", "d"]), (3, "z", ["q"])], schema)
    fixed = spark.createDataFrame([(9, "x", ["a"]), (8, "w", ["a", "b", "c", "d", "e"])], schema)
    assert rows(dedup.near_copies(new, fixed, "i", "k", "s", 4, 5)) == [(1, "exact"), (2, "near")]


def test_components_against_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = sorted((v, find(v)) for v in parent)
    df = spark.createDataFrame(edges, "u long, v long")
    assert rows(components.connected_components(df)) == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_expand_pairs_in_blocks(spark):
    members = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 100 + i) for i in range(7)] + [("c", 999)], "cls string, id int")
    got = pairs.expand_pairs(spark.createDataFrame([("a", "b")], "ca string, cb string"), members, block=8)
    assert rows(got) == [(i, 100 + j) for i in range(50) for j in range(7)]


# ---------------------------------------------------------------- joins


def test_label_map(spark):
    df = spark.createDataFrame([("oos",), ("x",), ("skip_a",), ("none",)], "l string")
    table = {"oos": "other", "none": None, "*": "star"}
    assert [r[0] for r in df.select(joins.map_label(F.col("l"), table, ("skip",))).collect()] == ["other", "star", None, None]
    assert df.select(joins.map_label(F.col("l"), {"oos": "other"})).where(F.col(df.select(joins.map_label(F.col("l"), {"oos": "other"})).columns[0]).isNotNull()).count() == 1


def test_missing_verdicts_are_kept(spark):
    v = spark.createDataFrame([(1, "BROKEN"), (2, "OK"), (4, None)], "i int, v string")
    assert rows(joins.keep_unless(spark.createDataFrame([(i,) for i in range(1, 5)], "i int"), v, ["i"], "v", "BROKEN")) == [(2,), (3,), (4,)]


def test_upsert(spark):
    old = spark.createDataFrame([("k1", 5, "in", 0), ("k2", 6, "out", 1)], "id string, n int, s string, o int")
    new = spark.createDataFrame([("k3", 8, "new", 10), ("k1", 77, None, 9)], "id string, n int, s string, o int")
    got = joins.upsert(old, new, "id", "o").orderBy("added", "o").select("id", "n", "s")
    assert [tuple(r) for r in got.collect()] == [("k1", 77, "in"), ("k2", 6, "out"), ("k3", 8, "new")]


# ---------------------------------------------------------------- metrics


def test_macro_f1(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x"), ("x", None), ("y", "x"), ("y", "q"), ("z", "z")], "g string, p string")
    r = metrics.intent_metrics(df, "g", "p").first()
    # x: 2 right, 1 false, 1 missed; y: none right; z: all right; q is no gold class
    assert r["accuracy"] == 0.5 and math.isclose(r["macro_f1"], (4 / 6 + 0 + 1) / 3)


@pytest.mark.parametrize(("target", "want"), [(0.75, (0.4, 0.8, 0.75)), (0.9, (0.95, 0.2, 1.0)), (0.6, (0.1, 1.0, 0.6))])
def test_coverage(spark, target, want):
    # two rows of one confidence count together
    rows_ = [(0.95, True), (0.95, True), (0.7, True), (0.7, False), (0.6, True), (0.5, True), (0.4, True), (0.4, False), (0.1, False), (0.1, False)]
    df = spark.createDataFrame(rows_, "c double, ok boolean")
    assert tuple(metrics.coverage_at(df, "c", F.col("ok"), target).first()) == pytest.approx(want)
    per = metrics.coverage_by(df.withColumn("g", F.lit("a")).unionByName(spark.createDataFrame([(0.5, False, "b")], "c double, ok boolean, g string")), "g", "c", F.col("ok"), target)
    got = {r["g"]: tuple(r)[1:] for r in per.collect()}
    assert got["a"] == pytest.approx(want) and got["b"] == (None, 0.0, None)


def test_coverage_of_nothing(spark):
    df = spark.createDataFrame([(0.9, False)], "c double, ok boolean")
    assert tuple(metrics.coverage_at(df, "c", F.col("ok"), 0.5).first()) == (None, 0.0, None)


def test_wilson(spark):
    df = spark.createDataFrame([(30, 40), (9, 9), (0, 9), (0, 0)], "k int, n int")
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert got[0] == pytest.approx((0.5981, 0.8581), abs=1e-3)
    assert got[1][1] == 1.0 and got[2][0] == 0.0 and got[3] == (0.0, 1.0)


def test_weighted_rate(spark):
    df = spark.createDataFrame([(3, 50, 0.5), (20, 40, 0.3), (0, 0, 0.2)], "h int, j int, s double")
    assert metrics.weighted_rate(df, "h", "j", "s").first()[0] == pytest.approx((0.5 * 0.06 + 0.3 * 0.5) / 0.8)


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3], "xyz"[i % 3], "xyz"[i % 3] if i % 5 else None) for i in range(60)], "i int, g string, a string, b string")
    assert tuple(metrics.paired_bootstrap(df, "i", "g", "a", "a").first()) == (0.0, 0.0, 0.0)
    for metric in (metrics.weighted_accuracy, metrics.weighted_macro_f1):
        r = metrics.paired_bootstrap(df, "i", "g", "a", "b", metric).first()
        assert 0 < r["lo"] < r["diff"] < r["hi"] < 0.5
    f1 = metrics.intent_metrics(df, "g", "b").first()["macro_f1"]
    assert metrics.paired_bootstrap(df, "i", "g", "a", "b", metrics.weighted_macro_f1).first()["diff"] == pytest.approx(1 - f1)


def test_select_checkpoint(spark):
    df = spark.createDataFrame([("p", 0.71, 5.0), ("q", 0.75, 7.0), ("r", 0.74, 6.0), ("s", 0.2, 0.5)], "n string, s double, loss double")
    assert metrics.select_checkpoint(df, "s", 0.02, F.col("loss")).first()["n"] == "r"
    assert metrics.select_checkpoint(df, "s", 0.0, F.col("loss")).first()["n"] == "q"
    assert metrics.select_checkpoint(df, "s", 0.05, F.col("loss")).first()["n"] == "p"


def test_text_stats(spark):
    r = spark.createDataFrame([("قمر a moon",)], "t string").agg(*metrics.text_stats(F.col("t"))).first()
    assert tuple(r) == (1, 10, 13, 3)


def test_latency(spark):
    df = spark.range(50).select((F.col("id") * 2).cast("double").alias("x"))
    assert tuple(df.agg(*metrics.latency("x")).first()) == (49.0, 94.0)


# ---------------------------------------------------------------- tokens


def test_windows_cover_every_target_once(spark):
    df = spark.createDataFrame([(0, 14), (1, 5), (2, 4)], "s int, n long")
    got = rows(tokens.window_index(df, "n", 4).select("s", "start"))
    assert got == [(0, 0), (0, 4), (0, 8), (1, 0)]


def test_windows_are_cut_where_their_tokens_are(spark):
    # keys that repeat or are missing keep the windows of each of their rows
    data = [(0, list(range(14))), (1, list(range(50, 55))), (1, list(range(60, 65))), (None, list(range(70, 75))), (2, [1, 2, 3, 4]), (3, []), (4, None)]
    got = tokens.cut_windows(spark.createDataFrame(data, "s int, t array<int>"), "t", 4)
    assert got.columns == ["s", "start", "window"]
    want = [(0, i, list(range(i, i + 5))) for i in (0, 4, 8)] + [(s, 0, list(range(a, a + 5))) for s, a in ((1, 50), (1, 60), (None, 70))]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_shards_never_meet_their_windows_in_a_broadcast_join(spark):
    shards = spark.range(3).select(F.col("id").alias("shard"), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda x: x + F.col("id") * 100).alias("t")).checkpoint()
    windows = spark.createDataFrame([(0, 0), (2, 16), (2, 3), (2, 3)], "shard long, start long")
    got = tokens.gather_windows(windows, shards, "t", 4)
    assert rows(got) == [(0, 0, list(range(5))), (2, 3, list(range(203, 208))), (2, 3, list(range(203, 208))), (2, 16, list(range(216, 221)))]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_shards(spark):
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate([25, 60, 0, 210, 5])], "i long, n long")
    off = tokens.running_offsets(df, "i", "n", buckets=2)
    assert rows(off.select("i", "offset")) == [(0, 0), (1, 25), (2, 85), (3, 85), (4, 295)]
    p = tokens.shard_pieces(off.withColumnRenamed("n", "m"), "m", 80)
    assert rows(p.groupBy("shard").agg(F.sum("n"))) == [(0, 80), (1, 80), (2, 80), (3, 60)]
    assert tokens.running_offsets(df.limit(0), "i", "n").count() == 0


def test_length_batches(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.randrange(3, 90), 0) for i in range(900)], "i int, n int, g int")
    got = tokens.length_batches(df, sampling.order_of(1, F.col("i")), "n", 9, 12, "g")
    per = got.groupBy("batch").agg(F.count(F.lit(1)).alias("c"), (F.max("n") - F.min("n")).alias("spread"))
    assert got.count() == 900 and per.agg(F.max("c")).first()[0] <= 12 and per.agg(F.avg("spread")).first()[0] < 15


def test_examples_and_padding(spark):
    ids, labels = tokens.example_ids(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), 0)
    r = spark.range(1).select(ids, labels, tokens.pad_to(F.array(F.lit(1)), 3, F.lit(9)), tokens.pad_to(F.array(F.lit(1), F.lit(2)), 1, F.lit(9))).first()
    assert tuple(r) == ([1, 2, 3, 0], [-100, -100, 3, 0], [1, 9, 9], [1])


# ---------------------------------------------------------------- JSON


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "a string").select(col(F.col("a")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("answer", "parsed", "valid"),
    [('{"reply": "yes", "intent": "tea"}', True, True), ('{"intent": "rum", "reply": "yes"}', True, False), ('{"intent": "tea", "reply": "yes", "why": null}', True, False), ('{"intent": "te', False, False), ('"tea"', True, False), ('{"intent": "tea", "reply": 7}', True, False), ('{"intent": "tea", "reply": "yes"} .', False, False), ("", False, False), (None, False, False)],
)
def test_parse_answer(spark, answer, parsed, valid):
    r = one(spark, lambda c: jsonio.parse_answer(c, ["tea"]), answer)
    assert (r["parsed"], r["valid"]) == (parsed, valid)


def test_other_answers(spark):
    got = one(spark, jsonio.parse_labels, "7: red_fox\r\n8. tea_pot\n 9) kite\nsee above\n10: Red Fox\n7: late_bus\n12345678901234567890: far\n٥- five")
    assert {r["n"]: r["label"] for r in got} == {7: "late_bus", 8: "tea_pot", 9: "kite", 5: "five"}
    assert one(spark, jsonio.parse_labels, "12345678901: far")[0]["n"] == 12_345_678_901
    assert len(one(spark, jsonio.parse_json_objects, '```json\n4) {"k": 7}\nhm\n* {"k": 8},\n{"k": \n```')) == 2
    assert len(one(spark, jsonio.parse_json_objects, '[{"k": 7}, "s"]')) == 1
    assert one(spark, jsonio.parse_lines, '(4) red\n* `blue`\n٧- green\n“white”\n\t \n3-4 boxes') == ["red", "blue", "green", "white", "3-4 boxes"]
    numbered = '{"n": 2, "v": "old"}\n{"n": 2, "v": " new "}\n{"n": 5, "v": "far"}\n{"v": "none"}\n{"n": 1, "v": " "}'
    assert [tuple(r) for r in one(spark, lambda c: jsonio.parse_numbered(c, 3, "v"), numbered)] == [(2, " new ")]
    verdicts = '{"n": 1, "verdict": "broken", "reason": null}\n{"n": 1, "verdict": "ok", "reason": null}\n{"n": 2, "verdict": "perhaps"}\n{"n": 3, "verdict": "Broken", "reason": " cut "}'
    assert [tuple(r) for r in one(spark, lambda c: jsonio.parse_verdicts(c, 3), verdicts)] == [(1, "OK", ""), (3, "BROKEN", "cut")]
    bad = [one(spark, lambda c: jsonio.bad_fields(c, "q", "a"), x) for x in ('{"q": "x", "a": "y"}', '{"q": "x"}', '{"q": "x", "a": 1}', '{"q": " ", "a": "y"}', "[]", "no", None)]
    assert bad == [False, *[True] * 6]
    df = spark.createDataFrame([Row(a=True, b=True), Row(a=True, b=False), Row(a=None, b=False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(jsonio.judged_good("a", "b")).collect()] == [True, False, None]


# ---------------------------------------------------------------- sources, pipeline, streams


def test_json_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('﻿{"text": "a", "source": "z"}\n[1, 2]\n"just a string"\n{"text": 5}\nnot json\n{"text": "b"}\n', encoding="utf-8")
    assert rows(readers.read_json_lines(spark, str(tmp_path / "*.jsonl"))) == [("a", "z"), ("b", "s")]
    with pytest.raises(FileNotFoundError):
        readers.read_json_lines(spark, str(tmp_path / "*.none"))


def test_csv_and_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿text,label\n"x, ""y""",1\n,2\n', encoding="utf-8")
    (tmp_path / "l.txt").write_text("one\n\n  \ntwo\n")
    assert rows(readers.read_delimited(spark, str(tmp_path / "c.csv"))) == [('x, "y"', "c")]
    assert rows(readers.read_lines(spark, str(tmp_path / "l.txt"))) == [("one", "l"), ("two", "l")]


def test_guard_and_log(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc")
    assert readers.read_guarded(spark, str(tmp_path / "f"), hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(ValueError):
        readers.read_guarded(spark, str(tmp_path / "f"), "0")
    log = spark.createDataFrame([(1, "{}"), (2, '{"a": 1}'), (3, "{"), (4, "{}")], "n int, v string")
    assert rows(readers.valid_prefix(log, "n", "v").select("n")) == [(1,), (2,)]


def test_token_shards(spark, tmp_path):
    pieces = spark.createDataFrame([(0, 0, [1, 2]), (0, 2, [3]), (1, 0, [65535])], "shard long, start long, tokens array<int>")
    readers.write_token_shards(pieces, str(tmp_path / "s"))
    got = readers.read_token_shards(spark, str(tmp_path / "s" / "*.bin"))
    assert sorted(r["tokens"] for r in got.collect()) == [[1, 2, 3], [65535]]


def test_inputs_by_suffix(spark, tmp_path):
    for folder, name, text in (("a", "x.jsonl", '{"text": "one"}\n'), ("a/b", "y.csv", "text\ntwo\n"), ("a/b/c", "z.txt", "three\n\nfour\n")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    at = str(tmp_path)
    assert rows(readers.read_inputs(spark, [f"{at}/**/*.txt", f"{at}/a/*.jsonl", f"{at}/a/**/*.csv", f"{at}/a/b/*.csv"])) == [("four", "z"), ("one", "x"), ("three", "z"), ("two", "y")]
    with pytest.raises(FileNotFoundError):
        readers.read_inputs(spark, [f"{at}/**/*.none"])


def test_class_names_of_a_footer(spark, tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    described = {"info": {"features": {"y": {"_type": "ClassLabel", "names": ["no", "yes"]}, "x": {"_type": "Value", "dtype": "string"}}}}
    plain = pa.table({"x": ["a", "b", "c"], "y": [1, 0, 5]})
    pq.write_table(plain.replace_schema_metadata({"huggingface": json.dumps(described)}), tmp_path / "t.parquet")
    names = readers.label_names(str(tmp_path / "t.parquet"), "y")
    assert names == ["no", "yes"]
    assert rows(readers.read_labelled(spark.read.parquet(str(tmp_path / "t.parquet")), "x", "y", names)) == [("a", "yes"), ("b", "no"), ("c", None)]
    pq.write_table(plain, tmp_path / "u.parquet")
    for path, column in (("t", "x"), ("t", "z"), ("u", "y")):
        with pytest.raises(ValueError):
            readers.label_names(str(tmp_path / f"{path}.parquet"), column)


def test_log_of_another_plan(spark):
    plan = spark.createDataFrame([(0, "a"), (1, "b")], "i long, key string")
    log = spark.createDataFrame([(1, '{"i": 0, "key": "a"}'), (2, '{"i": 1, "key": "c"}')], "line int, value string")
    assert rows(readers.still_open(plan, readers.resumed(log.where("line = 1"), plan, "line", "value", "i", "key"), "i")) == [(1, "b")]
    for bad in (log, spark.createDataFrame([(1, '{"i": 7, "key": "a"}')], "line int, value string")):
        with pytest.raises(ValueError):
            readers.resumed(bad, plan, "line", "value", "i", "key")


def test_retries_wait_longer_each_time():
    calls, waits = [], []

    def f(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("down")
        return x

    assert readers.retried(f, 2, 0.5, sleep=waits.append)("k") == "k" and waits == [0.5, 1.0]
    calls.clear()
    with pytest.raises(OSError):
        readers.retried(f, 1, 0.1, sleep=waits.append)("k")


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2030-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2030-01-01 00:50:00', 'a' union all select timestamp'2030-01-01 01:10:00', 'b'").coalesce(1).write.json(src)
    q = stream_counts(read_stream(spark, src, "ts timestamp, k string"), "ts", "k", "1 hour", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


DOCS = [
    "The red kite flew over the hill at dawn", "THE RED kite flew over the hill at dawn", "The red kite flew over the hill at dawn alone", "tea", " ".join(["ring"] * 9), "الجو اليوم صافي على الجبل والبحر", "write to 056 987 6543 when the kite is down", None, "2024 ... 0808 ??",
]


def test_pipeline(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(DOCS)], "doc_id long, text string, source string")
    out = run_pipeline(df, "doc_id", SMOKE)
    status = {r["doc_id"]: r["status"] for r in out.collect()}
    assert status == {0: "kept", 1: "drop_exact_dup", 2: "drop_near_dup", 3: "drop_too_short", 4: "drop_repetitive", 5: "kept", 6: "kept", 7: "drop_too_short", 8: "drop_low_letter_ratio"}
    assert sum(r["docs"] for r in pipeline_stats(out).collect()) == len(DOCS)
    assert not out.where("text like '%6543%'").count()
    assert rows(run_pipeline(df.repartition(3), "doc_id", SMOKE).select("doc_id", "status")) == rows(out.select("doc_id", "status"))


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "i int, t string").write.parquet(src)
    stream = spark.readStream.schema("i int, t string").parquet(src)
    q = stream_exact_dedup(stream, "t").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select lower(t) from seen").distinct().count() == spark.table("seen").count() == 2


def test_pre_tokens(spark):
    t = "ba3dain 6alab mp3 file 20317"
    df = spark.createDataFrame([(t,)], "t string")
    r = df.select(tokens.pre_tokens(F.col("t")).alias("a"), tokens.pre_tokens(F.col("t"), True).alias("b")).first()
    assert r["a"][:4] == ["ba", "3", "dain", " "] and "".join(r["a"]) == t
    assert r["b"][:2] == ["ba3dain", " 6alab"] and "".join(r["b"]) == t


def test_sample_windows(spark):
    df = spark.createDataFrame([(0, 100), (1, 30), (2, 5)], "shard long, n long")
    got = tokens.sample_windows(df, "n", 8, 64, 1).collect()
    assert len(got) == 64 and {r["shard"] for r in got} == {0, 1} and all(0 <= r["start"] < (92 if r["shard"] == 0 else 22) for r in got)
    with pytest.raises(ValueError):
        tokens.sample_windows(df, "n", 100, 4, 1)


def test_assembly(spark):
    new = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c")], "i int, t string")
    assert rows(dedup.new_only(new, spark.createDataFrame([("B",)], "t string"), "t", "i").select("i")) == [(1,), (4,)]
    fixed = spark.createDataFrame([(1, "x"), (3, "y")], "i int, t string")
    verdicts = spark.createDataFrame([(1, "OK"), (3, "BROKEN")], "i int, verdict string")
    assert rows(joins.rewrites(new, fixed, verdicts, ["i"], "t", "OK").select("i", "t", "rewritten")) == [(1, "x", True), (2, "A", False), (3, "b", False), (4, "c", False)]
    assert rows(joins.next_ids(spark.createDataFrame([("b",), ("a",)], "n string"), spark.createDataFrame([("t0009",)], "id string"), "id", "n")) == [("a", "t0010"), ("b", "t0011")]
    df = spark.createDataFrame([("two boxes of green tea",), ("a very long road to the sea",)], "t string")
    assert [r[0] for r in df.select(dedup.example_copies(df, ["Two boxes of green TEA!"], "t", 0.7)).collect()] == [True, False]


def test_buckets_follow_the_numbers(spark):
    df = spark.createDataFrame([(i,) for i in range(2000)] + [(10**15,)], "i long")
    b = df.select("i", ranks.range_bucket(df, "i", buckets=256).alias("b"))
    per = b.groupBy("b").count()
    assert per.agg(F.max("count")).first()[0] < 60
    order = [r["b"] for r in b.orderBy("i").collect()]
    assert order == sorted(order)
    down = [r["b"] for r in df.select("i", ranks.range_bucket(df, "i", descending=True).alias("b")).orderBy(F.desc("i")).collect()]
    assert down == sorted(down)
    same = spark.createDataFrame([(3,), (3,)], "i long")
    assert same.select(ranks.range_bucket(same, "i")).distinct().count() == 1
    assert same.limit(0).select(ranks.range_bucket(same.limit(0), "i")).count() == 0


def test_expansion_of_two_sides(spark):
    left = spark.createDataFrame([("a", i, "t") for i in range(40)] + [("b", 90, "t")], "cls string, id int, side string")
    right = spark.createDataFrame([("b", 100 + i, "h") for i in range(9)] + [("a", 7, "h")], "cls string, id int, side string")
    got = pairs.expand_pairs(spark.createDataFrame([("a", "b"), ("a", "a")], "ca string, cb string"), left, right, F.col("id_a") != F.col("id_b"), block=4)
    assert rows(got.select("id_a", "id_b")) == sorted([(i, 100 + j) for i in range(40) for j in range(9)] + [(i, 7) for i in range(40) if i != 7])


def test_positions_and_lookups(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)] + [(99, None)], "i long, g string")
    got = assembly.positions(df, "g", "i", 2)
    assert rows(got.where("g = 'a'").select("i", "batch", "n")) == [(0, 0, 1), (2, 0, 2), (4, 1, 1), (6, 1, 2), (8, 2, 1)]
    answers = spark.createDataFrame([("a", 0, 2, "x")], "g string, batch long, n int, v string")
    assert rows(assembly.by_position(got, answers, ["g", "batch"], "v").where("v is not null").select("i", "v")) == [(2, "x")]
    done, todo = assembly.reused(df.select(F.col("i").alias("k")), spark.createDataFrame([(1, None), (1, "y"), (2, None)], "k long, v string"), "k", "v")
    assert rows(done) == [(1, "y")] and todo.count() == 9


def test_systems_must_align(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, v string")
    assert rows(assembly.aligned(a, a, "i")) == [(1, "x", "x"), (2, "y", "y")]
    for b in (a.limit(1), a.unionByName(a), a.withColumn("i", F.col("i") + 1)):
        with pytest.raises(Exception, match="differ"):
            assembly.aligned(a, b, "i").collect()
    with pytest.raises(Exception, match="other rows"):
        assembly.paired_pick(a, a.withColumn("v", F.lit("z")), "i", "v", 1, 5).collect()
    assert assembly.paired_pick(a, a, "i", "v", 1, 1).count() == 1


def test_choices(spark):
    df = spark.createDataFrame([("s", 10, True, 9.0), ("m", 11, True, 2.0), ("l", 30, True, 1.0), ("xs", 1, False, 0.1)], "n string, size int, ok boolean, ms double")
    assert assembly.smallest_within(df, F.col("ok"), "size", 0.2, F.col("ms")).first()["n"] == "m"
    assert assembly.smallest_within(df, F.col("ok"), "size", 0.0, F.col("ms")).first()["n"] == "s"
    assert assembly.guarded_pick(df, F.col("ok") & (F.col("size") > 20), F.col("ms")).first()["n"] == "l"
    assert assembly.guarded_pick(df, F.col("size") > 99, F.col("ms")).count() == 0
    base, cand = (spark.createDataFrame([r], "r double, b double, c double") for r in ((0.5, 0.2, 1.0), (0.6, 0.2, 5.0)))
    assert [assembly.better_and_fits(base, cand, "r", "b", "c", 0.1, 0.5, m).first()["winner"] for m in (6.0, 4.0)] == ["candidate", "baseline"]


def test_token_chain(spark):
    assert rows(spark.range(1).select(*tokens.shifted(F.array(*map(F.lit, (5, 6, 7))), F.array(*map(F.lit, (-100, 6, 7))), 4, F.lit(0)))) == [([5, 6, 0, 0], [6, 7, -100, -100])]
    r = spark.range(1).select(tokens.prompt_ids(F.array(F.lit(5)), 1, 2).alias("p")).select("p", tokens.starts_with(F.col("p"), F.array(F.lit(1), F.lit(5))), tokens.starts_with(F.col("p"), F.array(F.lit(5)))).first()
    assert tuple(r) == ([1, 5, 2], True, False)
    docs = spark.createDataFrame([(1, [1, 2, 0]), (2, [3, 0]), (3, [0])], "i long, t array<int>")
    pieces = tokens.shard_arrays(docs, "i", "t", 4)
    assert rows(pieces) == [(0, 0, [1, 2, 0]), (0, 3, [3]), (1, 0, [0]), (1, 1, [0])]


@pytest.mark.skipif(not os.path.isfile(TOKENIZER), reason="no tokenizer file")
def test_shards_are_verified_by_decoding(spark):
    texts = ["one two three", "", "some more words here and there", "last <|endoftext|> one"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, x string").withColumn("ids", tokens.encoded(F.col("x"), TOKENIZER, EOS))

    def check(change=None):
        p = tokens.shard_arrays(docs, "i", "ids", 7)
        s = p.groupBy("shard").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
        return tokens.verify_shards(docs, s if change is None else s.withColumn("tokens", change), "i", "x", "tokens", TOKENIZER, EOS, VOCABULARY, 100, 1).first()

    good = check()
    assert good["ok"] and good["docs"] == good["eos"] == 20 and good["checked"] == 20 and good["boundary"] > 3
    # the same tokens in another order, and a mark too many
    assert not check(F.reverse("tokens"))["ok"] and not check(F.transform("tokens", lambda x: F.when(x == 290, EOS).otherwise(x)))["ok"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", "x|y", 1), ("a", None, 2)], "k string, t string, n int")
    assert readers.render_markdown(df, ["k"]).splitlines()[2:] == ["| a |  | 2 |", "| b | x\\|y | 1 |"]
    with pytest.raises(ValueError):
        readers.render_markdown(df, ["k"], most=1)
    readers.write_review(df, str(tmp_path / "r"), ["k", "n"], ["k"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("a", "2"), ("b", "1")]
    assert next((tmp_path / "r").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfk,n")
    page = "# t\n<!-- a -->\nold\n<!-- b -->\nend"
    assert readers.between_markers(page, "<!-- a -->", "<!-- b -->", "new") == "# t\n<!-- a -->\nnew\n<!-- b -->\nend"
    with pytest.raises(ValueError):
        readers.between_markers(page, "<!-- b -->", "<!-- a -->", "new")
    with pytest.raises(ValueError):
        readers.intent_table(spark, [{"name": "a", "domain": "d", "description": ""}] * 2)
