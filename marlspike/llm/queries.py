"""Queries pN_... over the tables of one folder, and their SQL where whole tables allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm import encode, groupjoin, langid, leaks, lookalike, minhash, pairs_defects, pii, residue, unigram
from marlspike.session import spread, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "messages"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = pairs_defects.defects(table(spark, d, "predict_requests"), table(spark, d, "predict_responses"))
    return pairs_defects.first_defect(found)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groupjoin.near_duplicate_groups(_messages(spark, d), "msg_id", "text").select(F.col("id").alias("msg_id"), "group_id")


def _personal(spark: SparkSession, d: str, texts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    model = pii.train(pii.training_sample(table(spark, d, "predict_requests"), table(spark, d, "predict_responses")))
    return pii.find_personal_data(texts, model, keys)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "predict_requests").select("request_id", F.lit("message").alias("field"), F.col("message").alias("text"))
    two = table(spark, d, "predict_responses").select("request_id", F.lit("message_masked").alias("field"), F.col("message_masked").alias("text"))
    # most masked messages equal the message: each text of a request is searched once
    texts = one.unionByName(two).where("text is not null").groupBy("request_id", "text").agg(F.collect_set("field").alias("fields"))
    found = _personal(spark, d, texts, ("request_id", "fields"))
    return found.select("request_id", F.explode("fields").alias("field"), "kinds").select("request_id", "field", F.explode("kinds").alias("kind")).distinct()


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "predict_requests").select("request_id", F.col("message").alias("text")).distinct()
    return _personal(spark, d, texts, ("request_id",)).select("request_id", "masked")


def p4_budget(spark: SparkSession, d: str) -> DataFrame:
    return unigram.token_budget(unigram.record_texts(table(spark, d, "hub_rows"), table(spark, d, "hub_sources")))


def _labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """Messages with ``lang_hint`` and replies with ``reply_lang``; replies without content stay out."""
    one = table(spark, d, "predict_requests").select("request_id", F.lit("message").alias("field"), F.col("message").alias("text"), F.col("lang_hint").alias("given"))
    bare = F.regexp_replace(F.lower("reply"), r"[^\p{L}\p{N}/]", "")
    two = table(spark, d, "predict_responses").where(~bare.isin("", "/", *NO_REPLY)).select("request_id", F.lit("reply").alias("field"), F.col("reply").alias("text"), F.col("reply_lang").alias("given"))
    return one.unionByName(two).where("text is not null").select("request_id", "field", "text", langid.label_column("given").alias("label")).distinct()


NO_REPLY = ("null", "none", "nil", "nan", "na", "n/a", "nul", "void", "undefined", "empty", "blank")


def _language_network(spark: SparkSession, d: str) -> langid.Network:
    return langid.train(langid.labelled_sample(table(spark, d, "predict_requests"), "message", "lang_hint") + langid.labelled_sample(table(spark, d, "predict_responses"), "reply", "reply_lang"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = langid.detect(_labelled_texts(spark, d), _language_network(spark, d), ("request_id", "field", "label"))
    right = F.when(F.size("langs") > 1, F.col("label") == "mixed").otherwise(F.col("label") == F.col("langs")[0]["lang"])
    return found.where((F.size("langs") > 0) & ~right).select("request_id", "field", F.explode("langs.lang").alias("lang")).distinct()


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    found = langid.detect(_labelled_texts(spark, d), _language_network(spark, d), ("request_id", "field"))
    return found.select("request_id", "field", F.explode("langs").alias("x")).select("request_id", "field", "x.lang", F.round("x.confidence", 4).alias("confidence")).distinct()


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.detect_segments(_labelled_texts(spark, d), _language_network(spark, d), ("request_id", "field"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = minhash.cross_split_pairs(_messages(spark, d), "msg_id", "text", "split")
    return pairs.select(F.least("id_t", "id_h").alias("id_a"), F.greatest("id_t", "id_h").alias("id_b")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return minhash.overlap_report(minhash.cross_split_pairs(_messages(spark, d), "msg_id", "text", "split", keep=("split", "source")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.equal_looking_pairs(table(spark, d, "predict_requests"), "request_id", "message")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(_documents(spark, d))


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_documents(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_matches(spark, d).where("kind = 'phrase'").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(_documents(spark, d)).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_masked, p4_budget, p5_found, p5_languages, p5_segments, p6_found, p6_report, p7_found, p8_ids, p9_found, p9_matches, p10_found)}


_SETS = r"""w AS (SELECT DISTINCT msg_id, split, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM messages WHERE text IS NOT NULL),
 s AS (SELECT msg_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2]))) AS g FROM w WHERE len(w) >= 8),
 n AS (SELECT msg_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.msg_id AS a, b.msg_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.msg_id < b.msg_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n x ON x.msg_id = a JOIN n y ON y.msg_id = b WHERE c * 8 >= (x.n + y.n) * 3)"""
_WORDS = r"regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[\x{0640}\x{064B}-\x{0652}\x{0670}]', '', 'g'), '[\p{L}\p{N}]+')"
_RUN = "list_aggregate(w[i:i + 9], 'string_agg', ' ')"

SQL = {
    "p2_found": f"""WITH RECURSIVE {_SETS}, l AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
 r(id, seen) AS (SELECT u, u FROM l UNION SELECT l.v, r.seen FROM r JOIN l ON l.u = r.id)
SELECT id AS msg_id, min(seen) AS group_id FROM r GROUP BY 1""",
    "p6_found": f"""WITH {_SETS} SELECT DISTINCT a AS id_a, b AS id_b FROM e JOIN w x ON x.msg_id = a JOIN w y ON y.msg_id = b
 WHERE (x.split = 'train' AND y.split IN ('dev', 'test')) OR (y.split = 'train' AND x.split IN ('dev', 'test'))""",
    "p6_report": f"""WITH {_SETS}, m AS (SELECT msg_id, split, source FROM messages), o AS (SELECT a AS t, b AS h FROM e UNION ALL SELECT b, a FROM e)
SELECT h.split, h.source, count(*) AS pairs, count(DISTINCT h.msg_id) AS held_records, count(DISTINCT t.msg_id) AS train_records FROM o JOIN m t ON t.msg_id = o.t JOIN m h ON h.msg_id = o.h WHERE t.split = 'train' AND h.split IN ('dev', 'test') GROUP BY 1, 2""",
    "p9_matches": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
 x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d), y AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS j, len(w) AS n FROM i WHERE len(w) >= 10),
 m AS (SELECT doc_id, item_id, p - j AS g, j, n FROM x JOIN y USING (t)), c AS (SELECT doc_id, item_id, g, n, count(*) AS k FROM m GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10 OR count(*) >= 0.7 * n),
 r AS (SELECT doc_id, item_id, g, j - row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY j) AS s FROM m SEMI JOIN c USING (doc_id, item_id, g)),
 l AS (SELECT doc_id, item_id, g, max(z) AS longest FROM (SELECT doc_id, item_id, g, s, count(*) AS z FROM r GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 f AS (SELECT doc_id, item_id, longest, k::DOUBLE / n AS share FROM l JOIN c USING (doc_id, item_id, g) WHERE longest >= 10 OR k::DOUBLE / n >= 0.7)
SELECT doc_id, item_id, max(longest)::INT AS longest, max(share) AS share, CASE WHEN max(longest) >= 10 THEN 'phrase' ELSE 'proximity' END AS kind FROM f GROUP BY 1, 2""",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
 x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: {_RUN})) AS g FROM d WHERE len(w) >= 10),
 y AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: {_RUN})) AS g FROM i WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
