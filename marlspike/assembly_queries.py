"""Registered queries of data assembly: answers by position, sinks read back, plans, token chain, choices, streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlspike import sqltext
from marlspike.functions import jsonio, tables, text as T
from marlspike.operators import assembly, dedup, metrics, sampling, tokens
from marlspike.plans import generation
from marlspike.queries import AR_SQL, PAIRS_SQL, TAG_SQL, _docs, _lang_sql, _overlap_items, _pairs, _shingled, query
from marlspike.session import cut, ensure_checkpoint_dir, settled, spread, table
from marlspike.sources import readers
from marlspike.streaming import dedup as streams

#: Tokenizer file of the token queries.
TOKENIZER = os.environ.get("MARLSPIKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
EOS, VOCABULARY = 50_256, 50_257


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, where a query's files are shared by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages")


# ------------------------------------------------------------------ answers of models


_LINES = r"string_split_regex({a}, '\r\n|[\n\r]')"
_ANSWER_SQL = "SELECT request_id, '1: ' || coalesce(intent, 'No Label') || chr(10) || ' 2) ' || coalesce(route, '?') || chr(10) || 'so:' || chr(10) || '1 - ' || route || chr(10) || '99999999999999999999: late' AS a FROM (SELECT DISTINCT request_id, intent, route FROM predict_responses)"


def _label_answers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses").select("request_id", "intent", "route").distinct()
    parts = [F.lit("1: "), F.coalesce("intent", F.lit("No Label")), F.lit("\n 2) "), F.coalesce("route", F.lit("?")), F.lit("\nso:\n1 - "), F.col("route"), F.lit("\n99999999999999999999: late")]
    return r.select("request_id", F.concat(*parts).alias("a"))


@query(rf"""WITH x AS (SELECT request_id, unnest({_LINES.format(a='a')}) AS l, generate_subscripts({_LINES.format(a='a')}, 1) AS i FROM ({_ANSWER_SQL})),
 y AS (SELECT request_id, i, try_cast(regexp_extract(l, '^\s*(\d+)\s*[:.)\-]\s*([a-z_]+)\s*$', 1) AS BIGINT) AS n, regexp_extract(l, '^\s*(\d+)\s*[:.)\-]\s*([a-z_]+)\s*$', 2) AS label FROM x)
SELECT request_id, n, arg_max(label, i) AS label FROM y WHERE n IS NOT NULL GROUP BY 1, 2""")
def parsed_labels(spark: SparkSession, d: str) -> DataFrame:
    return _label_answers(spark, d).select("request_id", F.explode(jsonio.parse_labels(F.col("a"))).alias("x")).select("request_id", "x.n", "x.label")


@query(r"""WITH x AS (SELECT request_id, unnest(string_split_regex('(1) ' || reply || chr(10) || '- `' || coalesce(intent, '') || '`', '\r\n|[\n\r]')) AS l FROM (SELECT DISTINCT request_id, reply, intent FROM predict_responses) WHERE reply IS NOT NULL),
 y AS (SELECT request_id, trim(trim(trim(regexp_replace(l, '^\s*([-*•]|\(?[0-9٠-٩]{1,3}[.)\-:])\s+', ''), ' ' || chr(9) || chr(160)), '"''“”«»`'), ' ' || chr(9) || chr(160)) AS line FROM x)
SELECT request_id, line, count(*) AS n FROM y WHERE line <> '' AND NOT regexp_matches(line, '[\x{200b}]') GROUP BY 1, 2""")
def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses").where("reply is not null").select("request_id", "reply", "intent").distinct()
    a = F.concat(F.lit("(1) "), F.col("reply"), F.lit("\n- `"), F.coalesce("intent", F.lit("")), F.lit("`"))
    return r.select("request_id", F.explode(jsonio.parse_lines(a)).alias("line")).where(~F.col("line").contains("​")).groupBy("request_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT request_id, true AS parsed, i.name IS NOT NULL AS valid, i.name AS intent FROM {PAIRS_SQL} LEFT JOIN intents i ON i.name = r.intent WHERE reply IS NOT NULL")
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    names = [r["name"] for r in table(spark, d, "intents").select("name").collect()]
    rows = _pairs(spark, d, "intent", "reply").where("reply is not null").select("request_id", jsonio.target(F.coalesce("intent", F.lit("")), F.col("reply")).alias("answer"))
    return rows.select("request_id", jsonio.parse_answer(F.col("answer"), names).alias("x")).select("request_id", "x.parsed", "x.valid", "x.intent")


_OBJECTS = "SELECT request_id, reply, route, intent FROM (SELECT DISTINCT request_id, reply, route, intent FROM predict_responses) WHERE reply IS NOT NULL"


def _object_answers(spark: SparkSession, d: str, *fields: tuple[int, str, Column]) -> DataFrame:
    """An answer of one JSON object a line behind list marks in a fence, with chatter between them."""
    r = table(spark, d, "predict_responses").where("reply is not null").select("request_id", "reply", "route", "intent").distinct()
    lines = [F.concat(F.lit(f"{i}. "), F.to_json(F.struct(F.lit(n).alias("n"), v.alias(k))), F.lit(",\nfine\n")) for i, (n, k, v) in enumerate(fields, 1)]
    return r.select("request_id", F.concat(F.lit("```json\n"), *lines, F.lit("```")).alias("a"))


@query(f"SELECT request_id, 1 AS n, reply AS value FROM ({_OBJECTS}) WHERE regexp_matches(reply, {sqltext.quoted(sqltext.NOT_S)}) UNION ALL SELECT request_id, 2, route FROM ({_OBJECTS}) WHERE route IS NOT NULL".replace("1 AS n", "1::INT AS n"))
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    a = _object_answers(spark, d, (2, "m", F.lit("first")), (1, "m", F.lit("old")), (3, "m", F.col("route")), (2, "m", F.col("route")), (1, "m", F.col("reply")))
    # a blank reply is no value, so the earlier one of its number holds
    got = a.select("request_id", F.explode(jsonio.parse_numbered(F.col("a"), 2, "m")).alias("x")).select("request_id", "x.n", "x.value")
    return got.where("not (n = 1 and value = 'old') and not (n = 2 and value = 'first')")


@query(f"SELECT request_id, unnest([1, 2]) AS place, unnest([7, 9])::BIGINT AS n FROM ({_OBJECTS})")
def answer_rows(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    a = _object_answers(spark, d, (7, "m", F.col("route")), (9, "m", F.col("reply")))
    rows = spark.sql("SELECT t.request_id, o.place, o.object FROM {a} t, LATERAL answer_objects(t.a) o", a=a)
    return rows.select("request_id", "place", F.get_json_object("object", "$.n").cast("bigint").alias("n"))


@query(f"SELECT request_id, 1::INT AS n, CASE WHEN route = 'escalate' THEN 'BROKEN' ELSE 'OK' END AS verdict, coalesce(intent, '') AS reason FROM ({_OBJECTS}) WHERE route IS NOT NULL")
def parsed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses").where("reply is not null and route is not null").select("request_id", "reply", "route", "intent").distinct()
    one = lambda n, v: F.to_json(F.struct(F.lit(n).alias("n"), v.alias("verdict"), F.col("intent").alias("reason")), {"ignoreNullFields": "false"})
    a = F.concat_ws("\n", one(1, F.lit("maybe")), one(1, F.lit("ok")), one(1, F.when(F.col("route") == "escalate", " broken ").otherwise("Ok")), one(9, F.lit("OK")))
    return r.select("request_id", F.explode(jsonio.parse_verdicts(a, 2)).alias("x")).select("request_id", "x.n", "x.verdict", "x.reason")


@query(rf"SELECT request_id, NOT coalesce(regexp_matches(message, '[^\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}\x{{202f}}]') AND regexp_matches(reply, '[^\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}\x{{202f}}]'), false) AS bad FROM (SELECT DISTINCT request_id, message, reply FROM {PAIRS_SQL})")
def bad_fields(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "message", "reply")
    return p.select("request_id", jsonio.bad_fields(F.to_json(F.struct("message", "reply")), "message", "reply").alias("bad"))


# ------------------------------------------------------------------ texts


@query(rf"WITH n AS {sqltext.normalized('SELECT msg_id, text FROM messages', 'msg_id', 'text')} SELECT msg_id, {sqltext.folded('text')} AS key FROM n")
def canonical_messages(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("msg_id", settled(T.canonical(F.col("text"))).alias("key"))


_DIALECT = [w for _, ws in T.DIALECT for w in ws.split()]
_ARABIC_WORDS_SQL = r"list_concat(regexp_extract_all({c}, '[\x{{0600}}-\x{{06FF}}]+'), list_transform(list_filter(regexp_extract_all({c}, '[\x{{0600}}-\x{{06FF}}]+'), lambda v: regexp_matches(v, '^[وف]') AND length(v) > 2), lambda v: substring(v, 2)))"
_NEGATED = r"'(^|\s)ما\s+[\x{0600}-\x{06FF}]{2,}ش($|\s|[؟?!.,،])'"
_CLAIMS_SQL = r"(regexp_matches({c}, '(?i)\b(" + T.CLAIM_EN.removeprefix("(?i)(?:").removesuffix(")").replace("'", "''").replace("(?:", "(") + r")\b') OR regexp_matches({c}, '(^|\s)(تم|قمنا\s*ب)'))"


@query(rf"""WITH p AS (SELECT DISTINCT request_id, reply FROM predict_responses WHERE reply IS NOT NULL), k AS (SELECT row_number() OVER () AS k, * FROM p), b AS (SELECT k, {TAG_SQL} AS tag FROM {_lang_sql('k', 'reply', 'k')})
SELECT request_id, CASE WHEN tag NOT IN ('en', 'ar') THEN 'reply_lang_' || tag WHEN {_CLAIMS_SQL.format(c='reply')} THEN 'reply_claims_action'
 WHEN len(list_intersect({_ARABIC_WORDS_SQL.format(c='reply')}, {_DIALECT})) > 0 OR regexp_matches(reply, {_NEGATED}) THEN 'non_gulf_dialect' END AS problem FROM k JOIN b USING (k)""")
def reply_problems(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses").where("reply is not null").select("request_id", "reply").distinct()
    return r.select("request_id", T.reply_problem(F.col("reply"), ["en", "ar"], True).alias("problem"))


@query(rf"SELECT count(*) FILTER (regexp_matches(text, {_NEGATED})) AS negated, count(*) AS messages FROM messages WHERE text IS NOT NULL")
def split_negation(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array_contains(T.non_gulf_markers(F.col("text")), "ما...ش(negation)")
    return _messages(spark, d).where("text is not null").agg(F.count_if(marks).alias("negated"), F.count(F.lit(1)).alias("messages"))


_SENTENCES_SQL = r"string_split(regexp_replace(text, '([.!?؟])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"""WITH s AS (SELECT doc_id, unnest({_SENTENCES_SQL}) AS s FROM documents WHERE text IS NOT NULL), k AS (SELECT row_number() OVER () AS k, doc_id, {sqltext.squeezed('s')} AS s FROM s)
SELECT doc_id, count(*) AS sentences FROM k JOIN (SELECT k, {TAG_SQL} AS tag FROM {_lang_sql('k', 's', "(SELECT k, regexp_replace(s, '<(URL|EMAIL|EID|IBAN|CARD|PHONE|NUM)>', ' ', 'g') AS s FROM k)")}) USING (k) WHERE length(s) BETWEEN 20 AND 120 AND tag IN ('en', 'mixed') GROUP BY 1""")
def picked_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).where("text is not null").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", settled(T.squeeze(F.col("s"))).alias("s"))
    return s.where(F.length("s").between(20, 120) & T.detect_lang(F.col("s")).isin("en", "mixed")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))


@query("SELECT msg_id FROM messages WHERE NOT coalesce(contains(text, 'card') OR contains(text, '%') OR contains(text, '_'), false)")
def without_substrings(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).where(T.without_substrings(F.col("text"), ["card", "%", "_"])).select("msg_id")


# ------------------------------------------------------------------ sinks read back


@query("""SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM (SELECT CASE doc_id % 3 WHEN 0 THEN coalesce(source, 'part') ELSE 'part' END AS source, text FROM documents WHERE regexp_matches(text, '[^ ]') AND NOT regexp_matches(text, '[\\n\\r]')) GROUP BY 1""")
def inputs_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one line written as JSON lines, as a table and as lines in nested folders, and read by patterns."""
    at = scratch(spark)
    docs = _docs(spark, d).where(F.col("text").rlike("[^ ]") & ~F.col("text").rlike("[\\n\\r]")).select("doc_id", "text", F.col("source"))
    part = lambda i: docs.where(F.col("doc_id") % 3 == i)
    part(0).select("text", "source").write.json(f"{at}/a/json")
    part(1).select("text").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/b/csv")
    part(2).select("text").write.text(f"{at}/c/lines")
    got = readers.read_inputs(spark, [f"{at}/**/*.json", f"{at}/b/csv/*.csv", f"{at}/c/**/*.txt"])
    named = F.when(F.col("source").startswith("part-"), "part").otherwise(F.col("source"))
    return got.groupBy(named.alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT count(*) AS texts, sum(length(text))::BIGINT AS chars FROM documents WHERE trim(text) <> ''")
def texts_read_back(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    _docs(spark, d).select("text").write.json(f"{at}/x")
    return readers.read_texts(spark, [f"{at}/x/*.json", f"{at}/**/*.json"]).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"))


@query("SELECT split, count(*) AS n, sum(msg_id)::BIGINT AS ids FROM messages WHERE split IS NOT NULL GROUP BY 1")
def splits_read_back(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    readers.write_split(_messages(spark, d).where("split is not null").select("msg_id", "text", "split"), at, order="msg_id")
    return spark.read.schema("msg_id long, text string, split string").json(at).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("msg_id").alias("ids"))


@query("""SELECT part, count(*) AS n FROM (SELECT CASE WHEN variety = 'mixed' THEN 'mixed' WHEN variety IS NULL THEN 'none' ELSE 'kept' END AS part FROM messages) GROUP BY 1""")
def kept_and_rejected(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    reason = F.when(F.col("variety") == "mixed", "mixed").when(F.col("variety").isNull(), "none").otherwise("kept")
    readers.write_kept_and_rejected(_messages(spark, d).select("msg_id", reason.alias("reason")), "reason", at)
    kept = spark.read.json(f"{at}/kept").select(F.lit("kept").alias("part"))
    return kept.unionByName(spark.read.json(f"{at}/rejected").select(F.col("reason").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'messages' AS name, split, count(*) AS n FROM messages WHERE split IS NOT NULL GROUP BY 2""")
def manifest_read_back(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    readers.write_manifest(_messages(spark, d).where("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n")), at, name="messages", seed=1)
    j = F.from_json("value", "facts struct<name:string,seed:int>, rows array<struct<split:string,n:bigint>>")
    return spark.read.text(at).select(j.alias("j")).select("j.facts.name", F.explode("j.rows").alias("r")).select("name", "r.split", "r.n")


@query("""WITH x AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM intents) SELECT name, i < 9 AND i <> 4 AS answered FROM x""")
def resumed_answers(spark: SparkSession, d: str) -> DataFrame:
    """A log of answers with a gap and a torn line, read against its plan."""
    at = scratch(spark)
    w = assembly.in_order(table(spark, d, "intents").select("name"), [], [F.col("name")], "i").withColumn("i", (F.col("i") - 1).cast("bigint"))
    plan = w.withColumn("key", assembly.request_key(F.col("name")))
    line = F.when(F.col("i") == 9, '{"i": 9, "ke').otherwise(F.to_json(F.struct("i", "key", F.col("name").alias("answer"))))
    readers.append_answers(plan.where("i < 5 and i <> 4").select("i", line.alias("value")), at)
    readers.append_answers(plan.where("i >= 5 and i < 14").select("i", line.alias("value")), at)
    log = spark.read.schema("i bigint, value string").json(at).withColumnRenamed("i", "line")
    done = readers.resumed(log, plan.select("i", "key"), "line", "value", "i", "key")
    left = readers.still_open(plan, done, "i").select("name", F.lit(False).alias("answered"))
    return left.unionByName(plan.join(done.select("i"), "i", "left_semi").select("name", F.lit(True).alias("answered")))


@query("SELECT msg_id, name AS label FROM messages m LEFT JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM intents) ON i = msg_id % 23 WHERE text IS NOT NULL")
def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    names = sorted(r["name"] for r in table(spark, d, "intents").select("name").collect())
    rows = _messages(spark, d).where("text is not null").select(F.col("msg_id").cast("string").alias("text"), (F.col("msg_id") % 23).alias("label"))
    return readers.read_labelled(rows, "text", "label", names).select(F.col("text").cast("bigint").alias("msg_id"), "label")


@query("""WITH x AS (SELECT DISTINCT r.row_id, lower(trim(r.source)) AS s, r.text, h.target_chars AS target FROM hub_rows r JOIN hub_sources h ON lower(trim(r.source)) = h.name WHERE r.text IS NOT NULL),
 y AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY s ORDER BY md5('17:' || row_id), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
SELECT s AS source, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS utf8_bytes, max(target) AS target_chars FROM y WHERE target = 0 OR b < target GROUP BY 1""")
def sampled_sources(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hub_sources").select(F.col("name").alias("source"), F.col("target_chars").alias("target"))
    rows = table(spark, d, "hub_rows").where("text is not null").select("row_id", F.lower(F.trim("source")).alias("source"), "text").distinct().join(h, "source")
    got = sampling.until_target(rows, "source", "row_id", F.length("text"), "target", 17)
    return readers.sample_manifest(got, "source", "text", F.col("target")).drop("words")


# ------------------------------------------------------------------ joins by place and key


@query("""WITH r AS (SELECT msg_id, split, intent, row_number() OVER (PARTITION BY split ORDER BY msg_id) - 1 AS p FROM messages),
 x AS (SELECT msg_id, split, intent, p // 20 AS batch, p % 20 + 1 AS n FROM r)
SELECT msg_id, CASE WHEN (batch % 5 <> 3 OR batch IS NULL) AND n <= 15 AND regexp_matches(intent, '^\\s*[a-z_]+\\s*$') THEN trim(intent) END AS label,
 coalesce((batch % 5 <> 3) AND n <= 15 AND regexp_matches(intent, '^[a-z_]+$'), false) AS agree FROM x""")
def judged_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Labels that a judge gave by batch and number: whole batches and the ends of others are missing."""
    rows = cut(assembly.positions(_messages(spark, d).select("msg_id", "split", "intent"), "split", "msg_id", 20).withColumn("split", F.coalesce("split", F.lit("-"))))
    said = rows.where("n <= 15 and batch % 5 <> 3").groupBy("split", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "intent"))), lambda x: F.concat(x["n"].cast("string"), F.lit(": "), F.coalesce(x["intent"], F.lit("?")))), "\n").alias("a"))
    answers = said.select("split", "batch", F.explode(jsonio.parse_labels(F.col("a"))).alias("x")).select("split", "batch", F.col("x.n").cast("int").alias("n"), F.col("x.label").alias("label"))
    got = assembly.by_position(rows, answers, ["split", "batch"], "label")
    return got.select("msg_id", "label", F.coalesce(F.col("label") == F.col("intent"), F.lit(False)).alias("agree"))


@query("""WITH r AS (SELECT msg_id, source, variety, row_number() OVER (PARTITION BY source ORDER BY msg_id) - 1 AS p FROM messages WHERE source IS NOT NULL)
SELECT msg_id FROM r WHERE NOT (p % 3 = 0 AND coalesce(variety, '-') = 'mixed')""")
def kept_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Rows but those that a verdict at their place within their source calls broken; places without one are kept."""
    rows = assembly.positions(_messages(spark, d).where("source is not null").select("msg_id", "source", "variety"), "source", "msg_id", 1_000_000_000)
    rows = cut(rows.drop("batch"))
    verdicts = rows.where((F.col("n") - 1) % 3 == 0).select("source", "n", F.when(F.col("variety") == "mixed", "BROKEN").otherwise("OK").alias("verdict"))
    got = assembly.by_position(rows, verdicts, ["source"], "verdict")
    return got.where(~F.col("verdict").eqNullSafe("BROKEN")).select("msg_id")


@query("""WITH r AS (SELECT msg_id, variety, text, row_number() OVER (PARTITION BY variety ORDER BY msg_id) - 1 AS p FROM messages WHERE variety IS NOT NULL)
SELECT msg_id, CASE WHEN p % 8 < 6 AND regexp_matches(text, '[^\\s]') THEN text END AS reply, CASE WHEN p % 8 < 6 AND regexp_matches(text, '[^\\s]') THEN 'kept' ELSE 'no_reply' END AS reason FROM r""")
def replies_by_place(spark: SparkSession, d: str) -> DataFrame:
    """New replies, numbered within each batch of one variety: the last two of every batch are missing."""
    rows = cut(assembly.positions(_messages(spark, d).where("variety is not null").select("msg_id", "variety", "text"), "variety", "msg_id", 8))
    said = rows.where("n <= 6 and text is not null").select("variety", "batch", "n", F.to_json(F.struct("n", F.col("text").alias("reply"))).alias("j"))
    answers = said.groupBy("variety", "batch").agg(F.array_join(F.array_sort(F.collect_list("j")), "\n").alias("a"))
    replies = answers.select("variety", "batch", F.explode(jsonio.parse_numbered(F.col("a"), 8, "reply")).alias("x")).select("variety", "batch", F.col("x.n").alias("n"), F.col("x.value").alias("reply"))
    got = assembly.by_position(rows, replies, ["variety", "batch"], "reply")
    return got.select("msg_id", "reply", F.when(F.col("reply").isNull(), "no_reply").otherwise("kept").alias("reason"))


@query("""WITH p AS (SELECT msg_id, md5(concat_ws(chr(10), intent, text)) AS key FROM messages WHERE text IS NOT NULL), k AS (SELECT md5(concat_ws(chr(10), intent, text)) AS key, min(variety) AS answer FROM messages WHERE split = 'train' AND text IS NOT NULL AND variety IS NOT NULL GROUP BY 1)
SELECT msg_id, answer, k.key IS NULL AS open FROM p LEFT JOIN k USING (key)""")
def reused_answers(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).where("text is not null").select("msg_id", "split", "variety", assembly.request_key(F.col("intent"), F.col("text")).alias("key"))
    done, todo = assembly.reused(m.select("msg_id", "key"), m.where("split = 'train'").select("key", F.col("variety").alias("answer")), "key", "answer")
    return done.select("msg_id", "answer", F.lit(False).alias("open")).unionByName(todo.select("msg_id", F.lit(None).cast("string").alias("answer"), F.lit(True).alias("open")))


@query("""WITH a AS (SELECT request_id, min(channel) AS channel FROM predict_requests GROUP BY 1), b AS (SELECT request_id, min(struct_pack(route := route, lang := reply_lang)) AS v FROM predict_responses WHERE route IS NOT NULL AND reply_lang IS NOT NULL GROUP BY 1)
SELECT a.request_id, channel, v.route AS route, v.lang AS reply_lang FROM a LEFT JOIN b USING (request_id)""")
def requests_with_route(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "predict_requests").groupBy("request_id").agg(F.min("channel").alias("channel"))
    r = table(spark, d, "predict_responses").where("route is not null and reply_lang is not null")
    return assembly.lookup(q, r, ["request_id"], ["route", "reply_lang"])


@query("""WITH a AS (SELECT request_id, min(intent) AS i, min(reply) AS r FROM predict_responses GROUP BY 1), b AS (SELECT request_id, max(intent) AS i, max(message_masked) AS r FROM predict_responses GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN a.i IS NOT DISTINCT FROM b.i THEN 1.0 ELSE 0 END), 9) AS same_intent, round(avg(CASE WHEN a.r IS NOT DISTINCT FROM b.r THEN 1.0 ELSE 0 END), 9) AS same_answer FROM a JOIN b USING (request_id)""")
def aligned_systems(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses")
    a = r.groupBy("request_id").agg(F.min("intent").alias("i"), F.min("reply").alias("r"))
    b = r.groupBy("request_id").agg(F.max("intent").alias("i"), F.max("message_masked").alias("r"))
    same = lambda c: F.round(F.avg(F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")).cast("int")), 9)
    return assembly.aligned(a, b, "request_id").agg(F.count("request_id").alias("n"), same("i").alias("same_intent"), same("r").alias("same_answer"))


@query("""WITH a AS (SELECT event_id // 10 AS step, avg(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT event_id // 10 AS step, avg(value) AS x FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT step::BIGINT AS step, round(a.x - b.x, 6) AS difference FROM a JOIN b USING (step)""")
def joined_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("step", F.floor(F.col("event_id") / 10))
    a, b = (e.where(F.col("event_type") == t).groupBy("step").agg(F.avg("value").alias(c)) for t, c in (("click", "x"), ("view", "y")))
    return a.join(b, "step").select("step", F.round(F.col("x") - F.col("y"), 6).alias("difference"))


@query("SELECT msg_id, md5(concat_ws(chr(10), intent, text)) AS key FROM messages")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("msg_id", assembly.request_key(F.col("intent"), F.col("text")).alias("key"))


@query("""WITH a AS (SELECT request_id, min(intent) AS i FROM predict_responses GROUP BY 1) SELECT request_id FROM a ORDER BY md5('4:' || request_id), request_id LIMIT 40""")
def paired_sample(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses")
    a = r.groupBy("request_id").agg(F.min("intent").alias("i"), F.min("reply").alias("out"))
    b = r.groupBy("request_id").agg(F.min("intent").alias("i"), F.max("message_masked").alias("out"))
    return assembly.paired_pick(a, b, "request_id", "i", 4, 40).select("request_id")


@query("""SELECT name, variety, qtype, n::BIGINT AS repeats FROM (SELECT name, variety, qtype, CASE WHEN qtype IS NULL AND name = 'bill_amount' AND variety = 'mixed' THEN 5 WHEN qtype = 'why' AND name = 'card_gone' AND variety = 'english' THEN 2 ELSE 0 END AS n
 FROM intents, (VALUES ('english'), ('mixed')) v(variety), (VALUES (NULL), ('why')) q(qtype)) WHERE n > 0
UNION ALL SELECT name, v || '!', NULL, n FROM intents, (VALUES ('english', 1), ('gulf_arabic', 3)) v(v, n) WHERE name IN ('loan_terms', 'small_talk')""")
def request_cells(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "intents")
    one = assembly.plan(i, {"english": 1, "mixed": 2}, ["why"], cells={"bill_amount/mixed": 5, "card_gone/english/why": 2})
    two = assembly.plan(i, {"english": 1, "mixed": 2, "gulf_arabic": 3}, only_intents=["loan_terms", "small_talk"], only_varieties=["english", "gulf_arabic"]).withColumn("variety", F.concat("variety", F.lit("!")))
    return one.unionByName(two).groupBy("name", "variety", "qtype").agg(F.count(F.lit(1)).alias("repeats"))


@query("SELECT kind, count(*) AS n, count(lang) AS langs, count(split) AS splits FROM (SELECT 'item' AS kind, lang, split FROM eval_items UNION ALL SELECT 'document', lang, NULL FROM documents UNION ALL SELECT 'message', lang, split FROM messages) GROUP BY 1")
def united_inputs(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), *c) for k, t, c in (("item", "eval_items", ["lang", "split"]), ("document", "documents", ["lang"]), ("message", "messages", ["split", "lang"]))]
    return assembly.union_inputs(*parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("langs"), F.count("split").alias("splits"))


# ------------------------------------------------------------------ duplicates


@query("""WITH r AS (SELECT msg_id, source, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY source NULLS FIRST, msg_id) AS n FROM messages WHERE text IS NOT NULL), f AS (SELECT * FROM r WHERE n = 1 AND source IS NOT NULL),
 s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('2:' || msg_id)) AS k FROM f) SELECT msg_id, source FROM s WHERE k <= 15""")
def fetched_rows(spark: SparkSession, d: str) -> DataFrame:
    first = dedup.fetch_plan(_messages(spark, d).select("msg_id", "text", "source"), "text", "source", "msg_id")
    return sampling.stratified(first.where("source is not null").select("msg_id", "source"), "source", "msg_id", 2, 15)


def _generation_sql() -> str:
    from marlspike.queries import _GREEDY_SQL, _NEAR_SQL

    bare = "(SELECT request_id, regexp_replace({c}, '<(URL|EMAIL|EID|IBAN|CARD|PHONE|NUM)>', ' ', 'g') AS {c} FROM pairs WHERE {c} IS NOT NULL)"
    tagged = lambda c: f"(SELECT k, {TAG_SQL} AS tag FROM {_lang_sql('request_id', c, bare.replace('{c}', c))})"
    dialect = lambda c: f"(len(list_intersect({_ARABIC_WORDS_SQL.format(c=c)}, {_DIALECT})) > 0 OR regexp_matches({c}, {_NEGATED}))"
    seen = sqltext.quoted(sqltext.NOT_S)
    return f"""WITH RECURSIVE pairs AS (SELECT request_id, min(message) AS message, min(reply) AS reply FROM {PAIRS_SQL} GROUP BY 1), ma AS {tagged('message')}, ra AS {tagged('reply')},
 j AS (SELECT request_id, message, CASE WHEN NOT coalesce(regexp_matches(message, {seen}) AND regexp_matches(reply, {seen}), false) THEN 'bad_fields' WHEN ma.tag NOT IN ('en', 'ar') THEN 'message_lang_' || ma.tag
  WHEN ra.tag NOT IN ('en', 'ar') THEN 'reply_lang_' || ra.tag WHEN {_CLAIMS_SQL.format(c='reply')} THEN 'reply_claims_action' WHEN {dialect('reply')} OR {dialect('message')} THEN 'non_gulf_dialect'
  WHEN len(list_intersect({_ARABIC_WORDS_SQL.format(c='message')}, {T.MSA})) > 0 THEN 'msa_in_message' END AS r FROM pairs LEFT JOIN ma ON ma.k = request_id LEFT JOIN ra ON ra.k = request_id),
 f AS (SELECT request_id, message AS text, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY r IS NULL, md5(lower(message)) ORDER BY request_id) > 1 THEN 'duplicate' ELSE r END AS r FROM j), {_NEAR_SQL.format(k='request_id', f='f WHERE r IS NULL')}, {_GREEDY_SQL}
SELECT request_id, coalesce(r, CASE WHEN request_id IN (SELECT id FROM lost) OR request_id IN (SELECT id FROM m WHERE id <> rep) THEN 'near_duplicate' END, 'kept') AS reason FROM f"""


@query(_generation_sql())
def generation_filter(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "message", "reply").groupBy("request_id").agg(F.min("message").alias("message"), F.min("reply").alias("reply"))
    return generation.generation_reasons(p, "request_id", "message", "reply", ["en", "ar"], ["en", "ar"], True).select("request_id", "reason")


_EXAMPLES = ("Where is my order?", "My card was declined at the shop", "Please cancel my subscription today")
_PLAIN_SQL = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(f"""WITH x AS (SELECT msg_id, text, variety, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY msg_id) AS r, {_PLAIN_SQL.format(c='text')} AS a FROM messages WHERE text IS NOT NULL),
 e AS (SELECT {_PLAIN_SQL.format(c='t')} AS b FROM (VALUES {', '.join(f"('{e}')" for e in _EXAMPLES)}) v(t)),
 j AS (SELECT msg_id, max(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) AS j FROM x, e GROUP BY 1)
SELECT msg_id, CASE WHEN r > 1 THEN 'duplicate' WHEN NOT coalesce(variety <> 'mixed', false) THEN 'wrong_lang' WHEN j >= 0.3 THEN 'example_copy' ELSE 'kept' END AS reason FROM x JOIN j USING (msg_id)""")
def example_reasons(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).where("text is not null").select("msg_id", "text", "variety")
    return dedup.example_reasons(m, "text", "msg_id", F.col("variety") != "mixed", list(_EXAMPLES), 0.3).select("msg_id", "reason")


def _overlap_hits_sql() -> str:
    from marlspike.queries import _OVERLAP_SQL

    return f"""WITH {_OVERLAP_SQL}, l AS (SELECT 1 * max(length(text)) AS cap FROM messages WHERE split = 'test' AND trim(text) <> ''), u AS (SELECT k.msg_id, k.key, m.source FROM k JOIN (SELECT msg_id, text, source FROM messages) m USING (msg_id) WHERE split = 'train' AND length(m.text) <= (SELECT cap FROM l)),
 f AS (SELECT key, min(coalesce(source, '-')) AS path FROM u GROUP BY 1), x AS (SELECT k.msg_id, f.path FROM k JOIN f USING (key) WHERE split = 'test'),
 y AS (SELECT b.msg_id FROM i b JOIN i a ON a.g = b.g JOIN n p ON p.msg_id = a.msg_id JOIN n q ON q.msg_id = b.msg_id JOIN u ON u.msg_id = a.msg_id AND u.source IS NOT NULL WHERE b.split = 'test' AND a.split = 'train' AND b.msg_id NOT IN (SELECT msg_id FROM x)
  GROUP BY a.msg_id, b.msg_id, p.n, q.n HAVING count(*) * 8 >= (p.n + q.n) * 3)
SELECT msg_id AS id, 'exact' AS kind, path FROM x UNION SELECT msg_id, 'near', NULL FROM y"""


@query(_overlap_hits_sql())
def overlap_hits(spark: SparkSession, d: str) -> DataFrame:
    m = _overlap_items(spark, d).join(_messages(spark, d).select("msg_id", "text", "source"), "msg_id")
    rows = m.select(F.col("msg_id").alias("id"), "split", "text", "key", "items", F.coalesce("source", F.lit("-")).alias("path"), F.col("source").isNotNull().alias("near"))
    return dedup.overlaps(rows.where("split = 'test'"), rows.where("split = 'train'"), 1, 3, 5)


# ------------------------------------------------------------------ metrics and choices


@query(f"SELECT channel, grouping(channel)::BIGINT AS overall, count(*) AS n, round(avg(CASE WHEN valid_json IS NOT DISTINCT FROM finished THEN 1.0 ELSE 0 END), 9) AS agree FROM {PAIRS_SQL} GROUP BY ROLLUP (channel)")
def agreement_by_channel(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "channel", "valid_json", "finished").withColumn("same", F.col("valid_json").eqNullSafe(F.col("finished")))
    return metrics.summary(p, "channel", {"agree": "same"}).withColumn("agree", F.round("agree", 9))


@query(f"""WITH p AS (SELECT channel, confidence AS c, count(*) AS n, sum(CASE WHEN reply_fits THEN 1 ELSE 0 END) AS ok FROM {PAIRS_SQL} WHERE confidence IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT channel, c, sum(n) OVER (PARTITION BY channel ORDER BY c DESC) AS cn, sum(ok) OVER (PARTITION BY channel ORDER BY c DESC) AS cok, sum(n) OVER (PARTITION BY channel) AS a FROM p),
 b AS (SELECT channel, min(c) AS t FROM r WHERE cok / cn >= 0.93 GROUP BY 1)
SELECT g.channel, t AS threshold, coalesce(round(cn / a, 9), 0) AS coverage, round(cok / cn, 9) AS accuracy FROM (SELECT DISTINCT channel FROM p) g LEFT JOIN b ON b.channel IS NOT DISTINCT FROM g.channel LEFT JOIN r ON r.channel IS NOT DISTINCT FROM g.channel AND r.c = b.t""")
def coverage_by_channel(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.coverage_by(_pairs(spark, d, "channel", "confidence", "reply_fits"), "channel", "confidence", F.coalesce(F.col("reply_fits"), F.lit(False)), 0.93)
    return x.select("channel", "threshold", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


def _bootstrap_sql(rounds: int = 200, seed: int = 1) -> str:
    u = f"('0x' || substring(md5('{seed}:' || (i // 4) || ':' || request_id), 8 * (i % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    w = " + ".join(f"(u >= {s}::DOUBLE)::INT" for s in metrics.POISSON)
    return f"""WITH p AS (SELECT request_id, coalesce(reply_fits, false)::INT - coalesce(finished, false)::INT AS d FROM {PAIRS_SQL}), x AS (SELECT i, d, {u} AS u FROM p, range({rounds}) t(i)),
 r AS (SELECT i, sum(d * ({w})) / sum({w}) AS r FROM x GROUP BY 1), s AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k FROM r)
SELECT round((SELECT avg(d) FROM p), 9) AS diff, round(min(r) FILTER (k = {int(0.025 * rounds)}), 9) AS lo, round(min(r) FILTER (k = {int(0.975 * rounds) - 1}), 9) AS hi FROM s"""


@query(_bootstrap_sql())
def bootstrap_difference(spark: SparkSession, d: str) -> DataFrame:
    right = lambda c: F.coalesce(F.col(c), F.lit(False))
    p = _pairs(spark, d, "reply_fits", "finished").select("request_id", F.lit(True).alias("gold"), right("reply_fits").alias("a"), right("finished").alias("b"))
    return metrics.paired_bootstrap(p, "request_id", "gold", "a", "b").select(*[F.round(c, 9).alias(c) for c in ("diff", "lo", "hi")])


@query(f"""WITH p AS (SELECT r.request_id, q.channel AS ch, coalesce(reply_fits, false) AS fits, reply_fits IS NULL OR reply_fits AND confidence >= 0.6 AS guard FROM {PAIRS_SQL})
SELECT ch AS channel, count(*) AS n_before, round(avg(fits::INT), 9) AS rate_before, count(*) FILTER (guard) AS n_after, round(avg(fits::INT) FILTER (guard), 9) AS rate_after FROM p GROUP BY 1""")
def guard_effect(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "channel", "reply_fits", "confidence")
    x = metrics.before_and_after(p, "channel", F.col("reply_fits").isNull() | (F.col("reply_fits") & (F.col("confidence") >= 0.6)), F.col("reply_fits"))
    return x.select("channel", "n_before", F.round("rate_before", 9).alias("rate_before"), "n_after", F.round("rate_after", 9).alias("rate_after"))


_USABLE_SQL = """round(count(*) FILTER (valid_json AND reply_fits) / count(*), 9) AS usable_rate, round(count(*) FILTER (valid_json AND reply_fits) / greatest(count(*) FILTER (valid_json), 1), 9) AS agreement,
 round(count(*) FILTER (route = 'escalate' AND finished) / nullif(count(*) FILTER (finished), 0), 9) AS flagged_rate, round(sum(latency_ms) / greatest(count(*) FILTER (valid_json AND reply_fits), 1), 6) AS seconds_per_usable"""


def _usable(p: DataFrame) -> DataFrame:
    return metrics.usable(p, F.col("valid_json"), F.col("reply_fits"), F.col("route") == "escalate", F.col("finished"), "latency_ms")


@query(f"SELECT {_USABLE_SQL} FROM {PAIRS_SQL}")
def usable_rates(spark: SparkSession, d: str) -> DataFrame:
    x = _usable(_pairs(spark, d, "valid_json", "reply_fits", "route", "finished", "latency_ms"))
    return x.select(*[F.round(c, 9).alias(c) for c in ("usable_rate", "agreement", "flagged_rate")], F.round("seconds_per_usable", 6).alias("seconds_per_usable"))


@query("SELECT source, grouping(source)::BIGINT AS total, sum(length(text))::BIGINT AS amount, round(sum(length(text)) / (SELECT sum(length(text)) FROM documents), 9) AS share FROM documents WHERE text IS NOT NULL GROUP BY ROLLUP (source)")
def source_shares(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shares(_docs(spark, d).where("text is not null"), "source", F.length("text")).withColumn("share", F.round("share", 9))


@query("SELECT name, sum(v)::BIGINT AS total FROM (SELECT unnest(['chars', 'columns', 'files']) AS name, unnest([target_chars, len(text_columns), length(files)]) AS v FROM hub_sources) GROUP BY 1")
def totals_by_name(spark: SparkSession, d: str) -> DataFrame:
    counts = F.create_map(F.lit("chars"), F.col("target_chars"), F.lit("columns"), F.size("text_columns").cast("bigint"), F.lit("files"), F.length("files").cast("bigint"))
    return metrics.totals_by_name(table(spark, d, "hub_sources").select(counts.alias("m")), "m")


@query("SELECT variety, intent, count(*) AS n FROM messages WHERE variety IS NOT NULL AND intent IS NOT NULL AND NOT contains(variety, '/') GROUP BY 1, 2")
def counts_by_key(spark: SparkSession, d: str) -> DataFrame:
    keyed = _messages(spark, d).where("variety is not null and intent is not null").groupBy(F.concat_ws("/", "variety", "intent").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return assembly.split_key(keyed, "key", ["variety", "intent"]).select("variety", "intent", "n")


_PER_INTENT_SQL = f"SELECT intent, count(*) AS n, avg(CASE WHEN reply_fits THEN 1.0 ELSE 0 END) AS fits, avg(CASE WHEN valid_json THEN 1.0 ELSE 0 END) AS valid, avg(latency_ms) AS ms FROM {PAIRS_SQL} WHERE intent IS NOT NULL GROUP BY 1"


def _per_intent(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "intent", "reply_fits", "valid_json", "latency_ms").where("intent is not null")
    return p.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), metrics.rate(F.col("reply_fits")).alias("fits"), metrics.rate(F.col("valid_json")).alias("valid"), F.avg("latency_ms").alias("ms"))


@query(f"SELECT intent FROM ({_PER_INTENT_SQL}) WHERE valid >= 0.9 AND n >= 30 ORDER BY fits DESC, intent LIMIT 1")
def guarded_choice(spark: SparkSession, d: str) -> DataFrame:
    return assembly.guarded_pick(_per_intent(spark, d), (F.col("valid") >= 0.9) & (F.col("n") >= 30), F.desc("fits"), F.col("intent")).select("intent")


@query(f"WITH x AS ({_PER_INTENT_SQL}), p AS (SELECT * FROM x WHERE fits >= 0.5) SELECT intent FROM p WHERE n <= (SELECT min(n) FROM p) * 1.2 ORDER BY ms, n LIMIT 1")
def smallest_choice(spark: SparkSession, d: str) -> DataFrame:
    return assembly.smallest_within(_per_intent(spark, d), F.col("fits") >= 0.5, "n", 0.2, F.col("ms")).select("intent")


@query("""WITH x AS (SELECT variety, split, avg(length(text)) AS v FROM messages WHERE text IS NOT NULL AND variety IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2)
SELECT x.variety, x.split, round(x.v / b.v, 9) AS ratio FROM x JOIN x b ON b.variety = x.variety AND b.split = 'train'""")
def length_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = _messages(spark, d).where("text is not null and variety is not null and split is not null").groupBy("variety", "split").agg(F.avg(F.length("text")).alias("v"))
    return assembly.ratios(x, "variety", "split", "train", "v").withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH a AS (SELECT {_USABLE_SQL} FROM {PAIRS_SQL} WHERE channel = 'app'), b AS (SELECT {_USABLE_SQL} FROM {PAIRS_SQL} WHERE channel IS DISTINCT FROM 'app'), x AS (SELECT b.usable_rate / a.usable_rate - 1 AS gain, CASE WHEN a.flagged_rate > 0 THEN 1 - b.flagged_rate / a.flagged_rate ELSE 0 END AS fall, b.seconds_per_usable AS c FROM a, b)
SELECT round(gain, 6) AS gain, round(fall, 6) AS "drop", CASE WHEN (gain >= 0.01 OR fall >= 0.01) AND c <= 100000 THEN 'candidate' ELSE 'baseline' END AS winner FROM x""")
def pilot_choice(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "channel", "valid_json", "reply_fits", "route", "finished", "latency_ms")
    a, b = _usable(p.where("channel = 'app'")), _usable(p.where("not channel <=> 'app'"))
    x = assembly.better_and_fits(a, b, "usable_rate", "flagged_rate", "seconds_per_usable", 0.01, 0.01, 100_000.0)
    return x.select(F.round("gain", 6).alias("gain"), F.round("drop", 6).alias("drop"), "winner")


# ------------------------------------------------------------------ tokens


def _points(c: Column) -> Column:
    """Code points of a text below 60,000: numbers that SQL can form as well."""
    return F.transform(F.split(c, ""), lambda x: F.ascii(x) % 60_000)


_POINTS_SQL = "list_transform(string_split(text, ''), lambda x: unicode(x) % 60000)"


@query(f"""WITH x AS (SELECT doc_id, {_POINTS_SQL} AS t FROM documents WHERE length(text) > 0), y AS (SELECT t, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM x),
 z AS (SELECT (o + i) // 40000 AS shard, v FROM (SELECT o, unnest(t) AS v, generate_subscripts(t, 1) - 1 AS i FROM y)) SELECT shard::BIGINT AS shard, count(*) AS tokens, sum(v)::BIGINT AS checksum FROM z GROUP BY 1""")
def shards_read_back(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    rows = _docs(spark, d).where("length(text) > 0").select("doc_id", _points(F.col("text")).alias("t"))
    readers.write_token_shards(tokens.shard_arrays(rows, "doc_id", "t", 40_000), at)
    got = readers.read_token_shards(spark, f"{at}/*.bin")
    return got.select(F.regexp_extract("file", r"shard_(\d+)", 1).cast("bigint").alias("shard"), F.size("tokens").cast("bigint").alias("tokens"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@query("SELECT doc_id, true AS same, true AS closed FROM documents")
def decoded_documents(spark: SparkSession, d: str) -> DataFrame:
    x = spread(_docs(spark, d)).select("doc_id", "text", settled(tokens.encoded(F.col("text"), TOKENIZER, EOS)).alias("ids"))
    closed = F.coalesce(F.element_at("ids", -1) == EOS, F.col("text").isNull())
    return x.select("doc_id", F.col("text").eqNullSafe(tokens.decoded(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))), TOKENIZER)).alias("same"), closed.alias("closed"))


@query("SELECT count(*) AS docs, count(*) AS eos, 0::BIGINT AS mismatched, true AS ok FROM documents WHERE text IS NOT NULL")
def verified_shards(spark: SparkSession, d: str) -> DataFrame:
    docs = cut(spread(_docs(spark, d).where("text is not null")).select("doc_id", "text", settled(tokens.encoded(F.col("text"), TOKENIZER, EOS)).alias("ids")))
    pieces = tokens.shard_arrays(docs, "doc_id", "ids", 50_000)
    # pieces of one shard: bounded by its size
    shards = cut(pieces.groupBy("shard").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "tokens"))), lambda x: x["tokens"])).alias("tokens")))
    return tokens.verify_shards(docs, shards, "doc_id", "text", "tokens", TOKENIZER, EOS, VOCABULARY, 200, 3).select("docs", "eos", "mismatched", "ok")


@query(rf"""SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS utf8_bytes, sum(len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')))::BIGINT AS words,
 sum(len(regexp_extract_all(text, ' ?\p{{L}}[\p{{L}}\p{{M}}]*|\p{{N}}{{1,3}}| ?[^\s\p{{L}}\p{{N}}]+|\s+')))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def source_token_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).where("text is not null").select("source", "text", tokens.pre_tokens(F.col("text")).alias("t"))
    return tokens.token_counts(x, "source", "text", "t")


@query(r"""WITH x AS (SELECT variety, text, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS words, len(regexp_extract_all(text, ' ?\p{L}[\p{L}\p{M}]*|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+')) AS tokens FROM messages WHERE text IS NOT NULL)
SELECT variety, round(sum(tokens) / sum(words), 9) AS tokens_per_word, round(sum(length(text)) / sum(tokens), 9) AS chars_per_token FROM x GROUP BY 1""")
def pieces_per_word(spark: SparkSession, d: str) -> DataFrame:
    x = _messages(spark, d).where("text is not null").select("variety", "text", tokens.pre_tokens(F.col("text")).alias("t"))
    c = tokens.token_counts(x, "variety", "text", "t")
    return c.select("variety", F.round(F.col("tokens") / F.col("words"), 9).alias("tokens_per_word"), F.round(F.col("chars") / F.col("tokens"), 9).alias("chars_per_token"))


@query(f"""WITH x AS (SELECT doc_id, {_POINTS_SQL} AS t FROM documents WHERE length(text) > 128), w AS (SELECT doc_id, t, unnest(range(0, len(t) - 128, 128)) AS start FROM x)
SELECT doc_id AS shard, start, list_sum(t[start + 1:start + 129])::BIGINT AS checksum FROM w""")
def gathered_windows(spark: SparkSession, d: str) -> DataFrame:
    shards = _docs(spark, d).where("length(text) > 128").select(F.col("doc_id").alias("shard"), _points(F.col("text")).alias("t"))
    return tokens.cut_windows(shards, "t", 128).select("shard", "start", F.aggregate("window", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@query(f"""WITH x AS (SELECT doc_id, list_transform(string_split(substring(text, 1, 30), ''), lambda x: unicode(x)) AS t FROM documents WHERE length(text) > 0),
 y AS (SELECT doc_id, list_concat([7], list_concat(t, [8])) AS i FROM x)
SELECT doc_id, list_sum(list_concat(i[1:len(i) - 1], list_transform(range(greatest(24 - len(i) + 1, 0)), lambda z: 9::BIGINT))[1:24])::BIGINT AS inputs, list_sum(list_concat(i[2:], list_transform(range(greatest(24 - len(i) + 1, 0)), lambda z: -100::BIGINT))[1:24])::BIGINT AS targets, true AS begins FROM y""")
def shifted_rows(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).where("length(text) > 0").select("doc_id", F.transform(F.split(F.substring("text", 1, 30), ""), lambda c: F.ascii(c)).alias("t"))
    x = x.select("doc_id", "t", tokens.prompt_ids(F.col("t"), 7, 8).alias("i"))
    a, b = tokens.shifted(F.col("i"), F.col("i"), 24, F.lit(9))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return x.select("doc_id", total(a).alias("inputs"), total(b).alias("targets"), tokens.starts_with(F.col("i"), F.concat(F.array(F.lit(7)), F.slice("t", 1, 3))).alias("begins"))


@query(r"""WITH d AS (SELECT doc_id // 1000 AS shard, sum(length(text))::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1), s AS (SELECT shard, n - 128 AS m, coalesce(sum(n - 128) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM d WHERE n > 128),
 a AS (SELECT i AS draw, (('0x' || substring(md5('5:' || i), 1, 15))::BIGINT % (SELECT sum(m)::BIGINT FROM s)) AS x FROM range(256) t(i)) SELECT draw, shard::BIGINT AS shard, x - o AS start FROM a JOIN s ON x >= o AND x < o + m""")
def sampled_windows(spark: SparkSession, d: str) -> DataFrame:
    shards = _docs(spark, d).where("text is not null").groupBy(F.floor(F.col("doc_id") / 1000).alias("shard")).agg(F.sum(F.length("text")).alias("n"))
    return tokens.sample_windows(shards, "n", 128, 256, 5)


@query("""WITH x AS (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM documents WHERE length(text) > 0)
SELECT doc_id FROM x WHERE o // 50000 <> (o + n - 1) // 50000 UNION SELECT doc_id FROM (SELECT doc_id FROM x ORDER BY md5('6:' || doc_id), doc_id LIMIT 30)""")
def checked_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("length(text) > 0").select("doc_id", F.length("text").cast("bigint").alias("n_"))
    cut_ = tokens.shard_pieces(tokens.running_offsets(rows, "doc_id", "n_"), "n_", 50_000).groupBy("doc_id").count().where("count > 1").select("doc_id")
    return cut_.union(sampling.shuffle_cap(rows.select("doc_id"), "doc_id", 6, 30)).distinct()


# ------------------------------------------------------------------ streams


@query("SELECT count(DISTINCT md5(lower(text))) AS texts FROM messages WHERE text IS NOT NULL")
def streamed_first_texts(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    _messages(spark, d).where("text is not null").select("msg_id", "text").repartition(3).write.json(f"{at}/in")
    stream = streams.read_stream(spark, f"{at}/in", "msg_id long, text string", files=1)
    q = streams.stream_exact_dedup(stream, "text").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.countDistinct(dedup.text_key(F.col("text"))).alias("distinct_"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("distinct_") == F.col("n"), F.col("n")).alias("texts"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    table(spark, d, "events").select("ts", "event_type").repartition(1).sortWithinPartitions("ts").write.json(f"{at}/in")
    stream = streams.read_stream(spark, f"{at}/in", "ts timestamp, event_type string")
    counts = streams.stream_counts(stream, "ts", "event_type", "1 hour", "1 hour")
    name = f"counts_{uuid.uuid4().hex}"
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


def _near_sql() -> str:
    from marlspike.queries import _GREEDY_SQL, _MESSAGES_NEAR_SQL

    return f"WITH RECURSIVE {_MESSAGES_NEAR_SQL}, {_GREEDY_SQL} SELECT id AS msg_id FROM m WHERE id = rep AND id NOT IN (SELECT id FROM lost)"


@query(_near_sql())
def streamed_near_kept(spark: SparkSession, d: str) -> DataFrame:
    """Messages in order of their id, in three batches; what stays equals the batch operator's result."""
    at = scratch(spark)
    rows = _messages(spark, d).where("text is not null and trim(text) <> ''").select("msg_id", "text")
    third = [r for r in rows.approxQuantile("msg_id", [1 / 3, 2 / 3], 0.01)]
    out = None
    for part in (F.col("msg_id") < third[0], (F.col("msg_id") >= third[0]) & (F.col("msg_id") < third[1]), F.col("msg_id") >= third[1]) if third else ():
        rows.where(part).coalesce(1).write.mode("append").json(f"{at}/in")
        stream = streams.read_stream(spark, f"{at}/in", "msg_id long, text string")
        streams.stream_near_dedup(stream, "msg_id", "text", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.parquet(f"{at}/out/kept")
    return (out if out is not None else rows).select("msg_id")


@query("SELECT request_id FROM predict_responses GROUP BY 1")
def streamed_answers(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    rows = table(spark, d, "predict_responses").select("request_id", "intent")
    for _ in range(2):  # every answer arrives twice
        rows.coalesce(1).write.mode("append").json(f"{at}/in")
        streams.stream_answers(streams.read_stream(spark, f"{at}/in", "request_id long, intent string"), "request_id", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out/answers").select("request_id")
