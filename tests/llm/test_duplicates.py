import random

import pytest
from pyspark.sql import functions as F

from marlspike.llm import bloom, shingles
from marlspike.llm.groupjoin import near_duplicate_groups
from marlspike.llm.minhash import band_keys, bucket_filter, cross_split_pairs, overlap_report
from marlspike.llm.shingles import WORD, sets_of

SCHEMA = "msg_id long, text string, split string, source string, id string, n int, set string, cls string"


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(260):
        if out and rng.random() < 0.6:
            t = rng.choice(out)[1].split()
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t.insert(rng.randrange(len(t)), rng.choice(words))
            t = " ".join(t)
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 25)))
        out.append((i, t, rng.choice(["train", "train", "dev", "test", None]), rng.choice("ab")))
    out += [(1000, None, "train", "a"), (1001, "", "dev", "a"), (1002, " ".join(["x"] * 9000), "train", "b"), (1003, " ".join(["x"] * 9000), "test", "b"), (1004, "short text", "train", "a"), (1005, "short text", "test", "a"), (1006, "A, a. a! a a a a a", "train", "a"), (1007, "a a a a a a a a a", "dev", None)]
    return out


def alike(rows):
    s = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        if len(w) >= 8:
            s[i] = set(zip(w, w[1:], w[2:]))
    return [(a, b) for a in s for b in s if a < b and 5 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_all_pairs(spark, seed):
    rows = corpus(seed)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in alike(rows):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    df = frame(spark, rows)
    got = near_duplicate_groups(df.unionByName(df), "msg_id", "text").collect()
    assert {r["id"]: r["group_id"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", [1, 3])
def test_cross_split_pairs_against_all_pairs(spark, seed):
    rows = corpus(seed)
    split = {r[0]: r[2] for r in rows}
    want = {(a, b) for a, b in alike(rows) if {split[a], split[b]} in ({"train", "dev"}, {"train", "test"})}
    df = frame(spark, rows)
    got = cross_split_pairs(df.unionByName(df), "msg_id", "text", "split").select(F.least("id_t", "id_h").alias("a"), F.greatest("id_t", "id_h").alias("b")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_report_and_empty_tables(spark):
    df = frame(spark, corpus())
    rep = overlap_report(cross_split_pairs(df, "msg_id", "text", "split", keep=("split", "source")))
    assert rep.agg(F.sum("pairs")).first()[0] == cross_split_pairs(df, "msg_id", "text", "split").count()
    none = df.limit(0)
    assert near_duplicate_groups(none, "msg_id", "text").count() == 0
    assert cross_split_pairs(none, "msg_id", "text", "split").count() == 0


def test_a_hot_class_stays_whole(spark):
    text = "one two three four five six seven eight nine"
    rows = [(i, text, "train" if i % 2 else "test", "a") for i in range(400)] + [(900, text + " ten", "dev", "a")]
    got = near_duplicate_groups(frame(spark, rows), "msg_id", "text")
    assert got.count() == 401 and got.select("group_id").distinct().count() == 1
    assert cross_split_pairs(frame(spark, rows), "msg_id", "text", "split").count() == 200 * 201


def test_sets_never_meet_in_a_broadcast_join(spark):
    # small by the planner's count, which takes an array for one value
    sets = spark.range(50).select("id", F.lit(3).alias("n"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2).alias("set")).checkpoint()
    cand = spark.range(49).select(F.col("id").alias("ca"), (F.col("id") + 1).alias("cb"))
    found = shingles.alike(cand, sets, "id", 1, 2)
    assert found.count() == 49
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_filter_of_held_out_buckets_passes_every_one_of_them(spark):
    texts = [" ".join(f"w{i * 3 + j}" for j in range(12)) for i in range(40)]
    bits = bucket_filter(spark.createDataFrame([(t,) for t in texts], "text string"), 3, 4, 20)
    keys = band_keys(*sets_of(texts, 3), 4, 20).ravel()
    assert bloom.passes(bits, keys).all() and bloom.passes(bits, keys + 1).mean() < 0.01
