"""Registry of the core queries: each with its SQL where the operator can be written in it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window as Win, functions as F

from marlspike import sqltext
from marlspike.functions import jsonio, text as T
from marlspike.operators import dedup, joins, metrics, sampling, tokens
from marlspike.plans import pipeline
from marlspike.session import cut, settled, spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_REQUEST_COLUMNS = ("message", "channel", "lang_hint")


def _pairs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Requests with their responses, repeated rows once; only the named columns are read."""
    q = table(spark, d, "predict_requests").select("request_id", *[c for c in cols if c in _REQUEST_COLUMNS]).distinct()
    r = table(spark, d, "predict_responses").select("request_id", *[c for c in cols if c not in _REQUEST_COLUMNS]).distinct()
    return q.join(r, "request_id")


WORDS_SQL = r"list_filter(string_split(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
LETTERS_SQL = r"len(regexp_extract_all({c}, '[A-Za-z]')) + len(regexp_extract_all({c}, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]'))"
AR_SQL = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
PAIRS_SQL = "(SELECT DISTINCT request_id, message, channel, lang_hint FROM predict_requests) q JOIN (SELECT DISTINCT request_id, intent, reply, confidence, route, valid_json, reply_fits, finished, latency_ms FROM predict_responses) r USING (request_id)"
_ARABIZI = ", ".join(f"'{w}'" for w in T.ARABIZI_LIST)
LANG_SQL = rf"""
 (SELECT {{k}} AS k, {{c}} AS t, len(regexp_extract_all({{c}}, '{AR_SQL}')) AS ar, len(regexp_extract_all({{c}}, '[A-Za-z]')) AS lat,
   regexp_extract_all(regexp_replace({{c}}, '(?i)\b[0-9]+(st|nd|rd|th|am|pm|fa|ds|gb|mb|kg|km|min|mins|hr|hrs|aed|dhs|usd)\b', ' ', 'g'), '[A-Za-z0-9'']+') AS ws {{more}}
  FROM {{f}} WHERE {{c}} IS NOT NULL)"""
TAG_SQL = rf"""CASE WHEN ar + lat = 0 THEN 'other' WHEN ar / (ar + lat) > 0.85 THEN 'ar' WHEN ar / (ar + lat) < 0.15 THEN
 CASE WHEN len(ws) > 0 AND 10 * len(list_filter(ws, lambda w: regexp_matches(w, '^([A-Za-z0-9]*[a-zA-Z][2356789][a-zA-Z][A-Za-z0-9]*|[2356789][a-zA-Z]{{2,}})$') OR lower(w) IN ({_ARABIZI}))) >= len(ws) THEN 'arabizi' ELSE 'en' END ELSE 'mixed' END"""


def _lang_sql(k: str, c: str, f: str, more: str = "") -> str:
    return LANG_SQL.replace("{k}", k).replace("{c}", c).replace("{f}", f).replace("{more}", more)


# ------------------------------------------------------------------ pipeline


def corpus_clean(spark: SparkSession, d: str, cfg: pipeline.PipelineConfig = pipeline.PRETRAIN) -> DataFrame:
    return pipeline.run_pipeline(spread(_docs(spark, d).select("doc_id", "text", "source")), "doc_id", cfg)


_CLEAN_SQL = f"""n AS {sqltext.normalized('SELECT doc_id, text FROM documents', 'doc_id', 'text', alef=False)},
 x AS (SELECT doc_id, text, length(text) AS n, {WORDS_SQL.format(c='text')} AS ws, {LETTERS_SQL.format(c='text')} AS letters FROM n),
 q AS (SELECT d.doc_id, x.text, CASE WHEN x.text IS NULL OR n < 10 THEN 'too_short' WHEN n > 1000000 THEN 'too_long' WHEN letters < 0.5 * n THEN 'low_letter_ratio'
  WHEN len(ws) >= 6 AND len(list_distinct(ws)) < 0.1 * len(ws) THEN 'repetitive' ELSE 'ok' END AS r FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id),
 e AS (SELECT doc_id, text, CASE WHEN r <> 'ok' THEN 'drop_' || r WHEN row_number() OVER (PARTITION BY r = 'ok', md5(lower(text)) ORDER BY doc_id) = 1 THEN 'kept' ELSE 'drop_exact_dup' END AS status FROM q)"""


def _clean_report_sql(final: str) -> str:
    """Counts and characters per status, split and tag of the rows of ``final``."""
    bare = f"(SELECT doc_id, text, status, regexp_replace(text, '<(URL|EMAIL|EID|IBAN|CARD|PHONE|NUM)>', ' ', 'g') AS bare FROM {final})"
    tagged = _lang_sql("doc_id", "bare", bare, ", text, status")
    return f"""SELECT status, CASE WHEN status = 'kept' THEN CASE WHEN substring(sha256('42:' || text), 1, 16) < '{sampling.threshold(0.005)}' THEN 'val' ELSE 'train' END END AS split,
 CASE WHEN status = 'kept' THEN {TAG_SQL} END AS lang, count(*) AS docs, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM (SELECT * FROM {tagged} UNION ALL SELECT doc_id, NULL, 0, 0, [], text, status FROM {final} WHERE text IS NULL) GROUP BY 1, 2, 3"""


_NEAR_SQL = """w AS (SELECT {k} AS id, list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {f}),
 s AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: list_aggregate(w[i:i + 2], 'string_agg', ' ')))) AS g FROM w WHERE len(w) > 0),
 c AS (SELECT id, count(*) AS n, md5(string_agg(g, chr(0) ORDER BY g)) AS cls FROM s GROUP BY 1),
 m AS (SELECT id, n, min(id) OVER (PARTITION BY cls) AS rep FROM c),
 p AS (SELECT a.id AS a, b.id AS b FROM (SELECT s.* FROM s JOIN m ON m.id = s.id AND m.rep = m.id) a JOIN (SELECT s.* FROM s JOIN m ON m.id = s.id AND m.rep = m.id) b ON a.g = b.g AND a.id < b.id
  JOIN m x ON x.id = a.id JOIN m y ON y.id = b.id GROUP BY a.id, b.id, x.n, y.n HAVING count(*) * 9 >= (x.n + y.n) * 4)"""
# rows settle in their order: kept if no kept smaller row is linked
_GREEDY_SQL = """v AS (SELECT DISTINCT x AS id FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p)), o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM v),
 near AS (SELECT o.k, list(oa.k) AS before FROM p JOIN o ON o.id = p.b JOIN o oa ON oa.id = p.a GROUP BY 1),
 g(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.k + 1, CASE WHEN list_has_any(kept, coalesce(n.before, []::BIGINT[])) THEN kept ELSE list_append(kept, g.k + 1) END FROM g LEFT JOIN near n ON n.k = g.k + 1 WHERE g.k < (SELECT count(*) FROM o)),
 lost AS (SELECT id FROM o WHERE NOT list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), o.k))"""


@query(f"WITH {_CLEAN_SQL} {_clean_report_sql('e')}")
def corpus_clean_report(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.pipeline_stats(corpus_clean(spark, d))


@query(f"WITH RECURSIVE {_CLEAN_SQL}, {_NEAR_SQL.format(k='doc_id', f="e WHERE status = 'kept'")}, {_GREEDY_SQL}, f AS (SELECT doc_id, text, CASE WHEN doc_id IN (SELECT id FROM lost) OR doc_id IN (SELECT id FROM m WHERE id <> rep) THEN 'drop_near_dup' ELSE status END AS status FROM e) {_clean_report_sql('f')}")
def corpus_clean_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.pipeline_stats(corpus_clean(spark, d, replace(pipeline.PRETRAIN, near_dup=(4, 5))))


@query(f"""SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS utf8_bytes,
 sum(len({WORDS_SQL.format(c='text')}))::BIGINT AS words FROM documents WHERE text IS NOT NULL GROUP BY source""")
def text_stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").groupBy("source").agg(*metrics.text_stats(F.col("text")))


@query(f"""WITH x AS (SELECT text, length(text) AS n, {WORDS_SQL.format(c='text')} AS ws, {LETTERS_SQL.format(c='text')} AS letters FROM documents)
SELECT CASE WHEN text IS NULL OR n < 20 THEN 'too_short' WHEN n > 2000 THEN 'too_long' WHEN letters < 0.5 * n THEN 'low_letter_ratio'
 WHEN len(ws) >= 20 AND len(list_distinct(ws)) < 0.4 * len(ws) THEN 'repetitive' ELSE 'ok' END AS reason, count(*) AS docs FROM x GROUP BY 1""")
def quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(T.quality_reason(F.col("text"), 20, 2000, 0.5, 20, 0.4).alias("reason")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT k AS msg_id, {TAG_SQL} AS tag FROM {_lang_sql('msg_id', 'text', 'messages')}")
def script_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("text is not null").select("msg_id", T.detect_lang(F.col("text")).alias("tag"))


@query(f"""SELECT mark, sum(len(regexp_extract_all(m, '<' || mark || '>')))::BIGINT AS n FROM (SELECT {sqltext.masked('message')} AS m FROM (SELECT DISTINCT request_id, message FROM predict_requests)), (VALUES ('URL'), ('EMAIL'), ('EID'), ('IBAN'), ('CARD'), ('PHONE'), ('NUM')) v(mark) GROUP BY 1""")
def masked_numbers(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    marks = ["URL", "EMAIL", "EID", "IBAN", "CARD", "PHONE", "NUM"]
    rows = table(spark, d, "predict_requests").select("request_id", "message").distinct()
    return rows.select(settled(T.mask_pii(F.col("message"))).alias("m")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), F.regexp_count(m, F.lit(f"<{k}>")).alias("n")) for k in marks])).alias("x")).groupBy("x.mark").agg(F.sum("x.n").alias("n"))


@query(sqltext.normalized("SELECT msg_id, text FROM messages", "msg_id", "text")[1:-1])
def normalized_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_id", T.normalize(F.col("text")).alias("text"))


_FITS_SQL = f"""WITH p AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT request_id, message, reply FROM {PAIRS_SQL})),
 a AS (SELECT k, {TAG_SQL} AS tag FROM {_lang_sql('k', 'message', 'p')}), b AS (SELECT k, {TAG_SQL} AS tag FROM {_lang_sql('k', 'reply', 'p')})
SELECT request_id, CASE WHEN a.tag = 'en' AND regexp_matches(reply, '{AR_SQL}') THEN false WHEN a.tag = 'en' THEN b.tag = 'en' WHEN a.tag IN ('ar', 'arabizi') THEN b.tag = 'ar' WHEN a.tag = 'mixed' THEN b.tag IN ('ar', 'mixed') ELSE true END AS fits
 FROM p LEFT JOIN a USING (k) LEFT JOIN b USING (k)"""


@query(_FITS_SQL)
def reply_guard(spark: SparkSession, d: str) -> DataFrame:
    allowed = {"english": ["en"], "gulf_arabic": ["ar"], "arabizi": ["ar"], "mixed": ["ar", "mixed"]}
    return _pairs(spark, d, "message", "reply").select("request_id", T.reply_fits(F.col("message"), F.col("reply"), allowed).alias("fits"))


@query(r"""SELECT count(*) FILTER (regexp_matches(reply, '(?i)\b(has been|have been|is now|are now|was sent|were sent|is frozen|is blocked|emailed you|we( have|''ve)? (frozen|blocked|sent|cancelled|canceled|refunded|updated|activated|changed|reset|unblocked|credited|reversed))\b')
 OR regexp_matches(reply, '(^|\s)(تم|قمنا\s*ب)')) AS claims, count(*) AS replies FROM (SELECT DISTINCT request_id, reply FROM predict_responses WHERE reply IS NOT NULL)""")
def claims_of_done_actions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses").where("reply is not null").select("request_id", "reply").distinct()
    return r.agg(F.count_if(T.claims_done_action(F.col("reply"))).alias("claims"), F.count(F.lit(1)).alias("replies"))


_LEX = ", ".join(f"{{'w': '{w}', 'm': '{w}({n})'}}" for n, ws in (*T.DIALECT, ("msa", " ".join(T.MSA))) for w in ws.split())


@query(rf"""WITH x AS (SELECT msg_id, regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]+') AS w FROM messages WHERE text IS NOT NULL),
 y AS (SELECT msg_id, list_concat(w, list_transform(list_filter(w, lambda v: regexp_matches(v, '^[وف]') AND length(v) > 2), lambda v: substring(v, 2))) AS w FROM x),
 l AS (SELECT unnest([{_LEX}], recursive := true))
SELECT l.m AS marker, count(*) AS messages FROM y JOIN l ON list_contains(y.w, l.w) GROUP BY 1""")
def dialect_markers(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, d, "messages").where("text is not null")
    marks = F.concat(F.filter(T.non_gulf_markers(t), lambda m: ~m.contains("negation")), T.msa_markers(t))
    return rows.select(F.explode(marks).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("messages"))


@query(r"SELECT doc_id, (len(regexp_extract_all(text, '[.!?؟]\s+')) + 1)::BIGINT AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query(r"SELECT row_id, concat_ws(chr(10), nullif(title, ''), nullif(text, ''), nullif(instruction, ''), nullif(response, '')) AS text FROM (SELECT DISTINCT row_id, title, text, instruction, response FROM hub_rows)")
def joined_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hub_rows").select("row_id", "title", "text", "instruction", "response").distinct()
    return rows.select("row_id", T.joined("title", "text", "instruction", "response").alias("text"))


@query(r"""WITH x AS (SELECT DISTINCT request_id, message, reply FROM """ + PAIRS_SQL + r""" WHERE message IS NOT NULL AND reply IS NOT NULL),
 y AS (SELECT request_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(message), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS a,
  list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(reply), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS b FROM x)
SELECT count(*) FILTER (len(list_intersect(a, b)) >= 0.5 * len(list_distinct(list_concat(a, b))) AND len(list_concat(a, b)) > 0) AS alike, count(*) AS pairs FROM y""")
def copied_replies(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, "message", "reply").where("message is not null and reply is not null").select("request_id", "message", "reply").distinct()
    a, b = (T.plain_words(F.regexp_replace(c, T.S, " ")) for c in ("message", "reply"))
    alike = F.size(F.array_intersect(a, b)) * 2 >= F.size(F.array_union(a, b))
    return p.agg(F.count_if(alike & (F.size(F.array_union(a, b)) > 0)).alias("alike"), F.count(F.lit(1)).alias("pairs"))


# ------------------------------------------------------------------ splits and samples


@query(f"SELECT doc_id, substring(sha256('42:' || text), 1, 16) < '{sampling.threshold(0.1)}' AS val FROM documents WHERE text IS NOT NULL")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", sampling.in_val(F.col("text"), 42, 0.1).alias("val"))


@query("SELECT name, ('0x' || substring(sha256('7:' || name), 1, 8))::BIGINT AS seed FROM hub_sources")
def source_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hub_sources").select("name", sampling.source_seed(7, F.col("name")).alias("seed"))


@query("""WITH r AS (SELECT msg_id, source_label, row_number() OVER (PARTITION BY source_label ORDER BY md5('3:' || msg_id)) AS k FROM messages WHERE source_label IS NOT NULL)
SELECT msg_id, source_label FROM (SELECT * FROM r WHERE k <= 20 ORDER BY k, source_label LIMIT 200)""")
def spread_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("source_label is not null").select("msg_id", "source_label")
    return sampling.spread_sample(rows, "source_label", "msg_id", 3, 20, 200)


@query("""WITH r AS (SELECT msg_id, intent, source_label, row_number() OVER (PARTITION BY intent, source_label ORDER BY md5('5:' || msg_id)) AS k FROM messages WHERE intent IS NOT NULL AND source_label IS NOT NULL),
 s AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY k, source_label) AS n FROM r WHERE k <= 6) SELECT msg_id, intent FROM s WHERE n <= 6""")
def sample_per_intent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("intent is not null and source_label is not null").select("msg_id", "intent", "source_label")
    return sampling.sample_by_group(rows, "intent", "source_label", "msg_id", 5, 6).select("msg_id", "intent")


@query("""SELECT msg_id, row_number() OVER (PARTITION BY source ORDER BY md5('11:' || msg_id)) <= round_even(0.15 * count(*) OVER (PARTITION BY source), 0) AS dev FROM messages""")
def hold_out_share(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hold_out(table(spark, d, "messages").select("msg_id", "source"), "source", "msg_id", 11, 0.15).select("msg_id", "dev")


@query("SELECT msg_id, variety FROM (SELECT msg_id, variety, row_number() OVER (PARTITION BY variety ORDER BY md5('9:' || msg_id)) AS r FROM messages) WHERE r <= 25")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "messages").select("msg_id", "variety"), "variety", "msg_id", 9, 25)


@query("SELECT msg_id FROM messages ORDER BY md5('13:' || msg_id), msg_id LIMIT 100")
def shuffled_cap(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffle_cap(table(spark, d, "messages").select("msg_id"), "msg_id", 13, 100)


@query("""WITH x AS (SELECT DISTINCT r.row_id, lower(trim(r.source)) AS s, length(r.text) AS n, h.target_chars AS target FROM hub_rows r JOIN hub_sources h ON lower(trim(r.source)) = h.name WHERE r.text IS NOT NULL),
 y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY s ORDER BY md5('17:' || row_id), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
SELECT row_id, s AS source FROM y WHERE target = 0 OR b < target""")
def until_target_chars(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hub_sources").select(F.col("name").alias("source"), F.col("target_chars").alias("target"))
    rows = table(spark, d, "hub_rows").where("text is not null").select("row_id", F.lower(F.trim("source")).alias("source"), F.length("text").alias("n")).distinct().join(h, "source")
    return sampling.until_target(rows, "source", "row_id", F.col("n"), "target", 17).select("row_id", "source")


@query("SELECT name, variety, r AS repeat FROM intents, (VALUES ('english'), ('gulf_arabic'), ('arabizi'), ('mixed')) v(variety), range(1, 4) t(r)")
def request_plan(spark: SparkSession, d: str) -> DataFrame:
    return sampling.plan_requests(table(spark, d, "intents"), ["english", "gulf_arabic", "arabizi", "mixed"], 3).withColumn("repeat", F.col("repeat").cast("bigint"))


# ------------------------------------------------------------------ duplicates and overlap


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id) = 1 AS first FROM documents WHERE text IS NOT NULL")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(_docs(spark, d).where("text is not null").select("doc_id", "text"), "text", "doc_id").select("doc_id", "first")


@query("""WITH m AS (SELECT msg_id, source, coalesce(variety <> 'mixed', false) AS ok, md5(lower(text)) AS k FROM messages WHERE text IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY k, ok ORDER BY source NULLS FIRST, msg_id) AS n FROM m)
SELECT msg_id, CASE WHEN NOT ok THEN 'wrong_lang' WHEN n = 1 THEN 'kept' ELSE 'duplicate' END AS reason FROM r""")
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("text is not null").select("msg_id", "text", "source", "variety")
    return dedup.merge_sources(rows, "text", "source", "msg_id", F.col("variety") != "mixed").select("msg_id", "reason")


_MESSAGES_NEAR_SQL = _NEAR_SQL.format(k="msg_id", f="messages WHERE text IS NOT NULL AND trim(text) <> ''")


def _shingled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("text is not null and trim(text) <> ''")
    return dedup.shingled(rows, "msg_id", F.col("text"), 3)


@query(f"WITH {_MESSAGES_NEAR_SQL} SELECT a, b FROM p")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates(_shingled(spark, d), "id", "s", 4, 5)[0]


@query(f"""WITH {_MESSAGES_NEAR_SQL}, l AS (SELECT x AS rep, count(*) AS links FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
SELECT id, m.rep, coalesce(links, 0) AS links FROM m LEFT JOIN l ON l.rep = m.rep WHERE links IS NOT NULL OR m.rep IN (SELECT rep FROM m GROUP BY rep HAVING count(*) > 1)""")
def near_duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_members(*dedup.near_duplicates(_shingled(spark, d), "id", "s", 4, 5))


@query(f"WITH RECURSIVE {_MESSAGES_NEAR_SQL}, {_GREEDY_SQL} SELECT id, id = rep AND id NOT IN (SELECT id FROM lost) AS keep FROM m")
def near_duplicates_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates_kept(_shingled(spark, d), "id", "s", 4, 5)


_FOLD_SQL = sqltext.folded("text")


@query(f"SELECT msg_id FROM messages WHERE split = 'test' AND text IS NOT NULL AND {_FOLD_SQL} IN (SELECT {_FOLD_SQL} FROM messages WHERE split = 'train' AND text IS NOT NULL)")
def test_messages_in_train(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("text is not null").withColumn("key", T.fold(F.col("text")))
    return m.where("split = 'test'").join(m.where("split = 'train'").select("key").distinct(), "key", "left_semi").select("msg_id")


def _overlap_items(spark: SparkSession, d: str) -> DataFrame:
    """Messages in canonical form with its character 3-grams, as the overlap check compares them."""
    m = spread(table(spark, d, "messages").where("text is not null and trim(text) <> ''").select("msg_id", "split", "text")).select("msg_id", "split", settled(T.canonical(F.col("text"))).alias("key"))
    return cut(m).withColumn("items", dedup.char_grams(F.col("key"), 3))


_OVERLAP_SQL = f"""k AS (SELECT msg_id, split, {_FOLD_SQL} AS key FROM {sqltext.normalized("SELECT msg_id, text FROM messages WHERE text IS NOT NULL AND trim(text) <> ''", 'msg_id', 'text')} JOIN (SELECT msg_id, split FROM messages) USING (msg_id)),
 t AS (SELECT msg_id, split, key, ' ' || lower(key) || ' ' AS t FROM k), i AS (SELECT msg_id, split, unnest(list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda j: t[j:j + 2]))) AS g FROM t WHERE split IN ('train', 'test')),
 n AS (SELECT msg_id, count(*) AS n FROM i GROUP BY 1), same AS (SELECT msg_id FROM k WHERE split = 'train' AND key IN (SELECT key FROM k WHERE split = 'test')),
 near AS (SELECT a.msg_id FROM i a JOIN i b ON a.g = b.g JOIN n x ON x.msg_id = a.msg_id JOIN n y ON y.msg_id = b.msg_id WHERE a.split = 'train' AND b.split = 'test' AND a.msg_id NOT IN (SELECT msg_id FROM same) GROUP BY a.msg_id, b.msg_id, x.n, y.n HAVING count(*) * 8 >= (x.n + y.n) * 3)"""


@query(f"WITH {_OVERLAP_SQL} SELECT msg_id, 'exact' AS kind FROM same UNION SELECT msg_id, 'near' FROM near")
def copies_of_held_out(spark: SparkSession, d: str) -> DataFrame:
    m = _overlap_items(spark, d)
    return dedup.near_copies(m.where("split = 'train'"), m.where("split = 'test'"), "msg_id", "key", "items", 3, 5)


# ------------------------------------------------------------------ joins


@query("SELECT r.msg_id, x.name AS intent, x.domain FROM messages r LEFT JOIN intents x ON lower(trim(r.intent)) = x.name")
def intent_domains(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "intents").select(F.col("name").alias("intent"), "domain")
    rows = table(spark, d, "messages").select("msg_id", F.lower(F.trim("intent")).alias("given"))
    return rows.join(names, rows["given"] == names["intent"], "left").select("msg_id", "intent", "domain")


@query("""SELECT channel, count(*) AS kept FROM (SELECT DISTINCT request_id, channel FROM predict_requests) q LEFT JOIN (SELECT request_id, bool_and(reply_fits) AS fits FROM predict_responses GROUP BY 1) v USING (request_id)
 WHERE fits IS DISTINCT FROM false GROUP BY 1""")
def kept_by_verdict(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "predict_requests").select("request_id", "channel").distinct()
    v = table(spark, d, "predict_responses").groupBy("request_id").agg(F.bool_and("reply_fits").alias("fits"))
    return joins.keep_unless(q, v, ["request_id"], "fits", False).groupBy("channel").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT count(DISTINCT request_id) AS unanswered FROM predict_requests q WHERE NOT EXISTS (SELECT 1 FROM predict_responses r WHERE r.request_id = q.request_id)")
def unanswered_requests(spark: SparkSession, d: str) -> DataFrame:
    q, r = (table(spark, d, t).select("request_id") for t in ("predict_requests", "predict_responses"))
    return q.join(r, "request_id", "left_anti").agg(F.countDistinct("request_id").alias("unanswered"))


LABELS = {"thanks": "small_talk", "late": "parcel_where", "card": None, "*": "other"}


@query("""SELECT mapped, count(*) AS n FROM (SELECT CASE WHEN source_label LIKE 'bill%' THEN NULL WHEN source_label = 'card' THEN NULL WHEN source_label = 'late' THEN 'parcel_where' WHEN source_label = 'thanks' THEN 'small_talk' ELSE 'other' END AS mapped FROM messages) GROUP BY 1""")
def mapped_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select(joins.map_label(F.col("source_label"), LABELS, ("bill",)).alias("mapped")).groupBy("mapped").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT name, kind, licence, target_chars, row_number() OVER (ORDER BY name) AS ord FROM hub_sources), n AS (SELECT lower(trim(source)) AS name, count(DISTINCT row_id) * 10 AS target_chars FROM hub_rows GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, kind, licence, coalesce(n.target_chars, o.target_chars)::BIGINT AS target_chars FROM o FULL JOIN n ON o.name = n.name""")
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "hub_sources").select("name", "kind", "licence", "target_chars", F.xxhash64("name").alias("ord"))
    new = table(spark, d, "hub_rows").groupBy(F.lower(F.trim("source")).alias("name")).agg((F.countDistinct("row_id") * 10).alias("target_chars")).select("name", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("licence"), "target_chars", F.xxhash64("name").alias("ord"))
    return joins.upsert(old, new, "name", "ord").select("name", "kind", "licence", "target_chars")


@query("SELECT c AS field, count(*) AS sources FROM (SELECT unnest(text_columns) AS c FROM hub_sources) GROUP BY 1")
def ledger_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hub_sources").select(F.explode("text_columns").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("sources"))


# ------------------------------------------------------------------ metrics


_TAGGED_SQL = f"(SELECT lang AS gold, {TAG_SQL} AS pred FROM {_lang_sql('doc_id', 'text', 'documents', ', lang')})"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select(F.col("lang").alias("gold"), T.detect_lang(F.col("text")).alias("pred"))


@query(f"""WITH t AS (SELECT * FROM {_TAGGED_SQL} WHERE gold IS NOT NULL), g AS (SELECT DISTINCT gold AS c FROM t),
 k AS (SELECT c, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold <> c AND pred = c) AS fp, count(*) FILTER (gold = c AND pred IS DISTINCT FROM c) AS fn FROM g, t GROUP BY c)
SELECT round(sum(tp) / sum(tp + fn), 9) AS accuracy, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 9) AS macro_f1 FROM k""")
def tag_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.intent_metrics(_tagged(spark, d), "gold", "pred").select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"SELECT gold, coalesce(pred, '(invalid answer)') AS pred, count(*) AS n FROM {_TAGGED_SQL} WHERE gold IS NOT NULL AND gold IS DISTINCT FROM pred GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 10")
def tag_confusions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusions(_tagged(spark, d), "gold", "pred", 10)


@query(f"""WITH p AS (SELECT confidence AS c, count(*) AS n, sum(CASE WHEN reply_fits THEN 1 ELSE 0 END) AS ok FROM {PAIRS_SQL} WHERE confidence IS NOT NULL GROUP BY 1),
 r AS (SELECT c, sum(n) OVER (ORDER BY c DESC) AS cn, sum(ok) OVER (ORDER BY c DESC) AS cok, sum(n) OVER () AS a FROM p)
SELECT c AS threshold, round(cn / a, 9) AS coverage, round(cok / cn, 9) AS accuracy FROM r WHERE cok / cn >= 0.93 ORDER BY c LIMIT 1""")
def coverage_at_target(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.coverage_at(_pairs(spark, d, "confidence", "reply_fits"), "confidence", F.coalesce(F.col("reply_fits"), F.lit(False)), 0.93)
    return x.select("threshold", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""SELECT intent, grouping(intent)::BIGINT AS overall, count(*) AS n, round(avg(CASE WHEN valid_json THEN 1.0 ELSE 0 END), 9) AS valid, round(avg(CASE WHEN reply_fits THEN 1.0 ELSE 0 END), 9) AS fits, round(avg(CASE WHEN finished THEN 1.0 ELSE 0 END), 9) AS finished
 FROM {PAIRS_SQL} GROUP BY ROLLUP (intent)""")
def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(metrics.rate(F.col(c)), 9)
    return _pairs(spark, d, "intent", "valid_json", "reply_fits", "finished").rollup("intent").agg(F.grouping("intent").cast("bigint").alias("overall"), F.count(F.lit(1)).alias("n"), r("valid_json").alias("valid"), r("reply_fits").alias("fits"), r("finished").alias("finished"))


@query("SELECT variety, split, count(*) AS n FROM messages GROUP BY GROUPING SETS ((variety, split), (split))")
def variety_by_split(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select("variety", "split")
    return m.groupingSets([["variety", "split"], ["split"]], "variety", "split").agg(F.count(F.lit(1)).alias("n")).select("variety", "split", "n")


@query("SELECT variety, intent, count(*) AS n FROM messages WHERE variety IS NOT NULL AND intent IS NOT NULL GROUP BY 1, 2 ORDER BY n, variety, intent LIMIT 10")
def smallest_cells(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("variety is not null and intent is not null")
    return m.groupBy("variety", "intent").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "variety", "intent").limit(10)


@query(r"""WITH w AS (SELECT variety, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM messages WHERE text IS NOT NULL),
 g AS (SELECT variety, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(0) || w[i + 1])) AS g FROM w)
SELECT v.variety, coalesce(x.pairs, 0) AS pairs, coalesce(x.distinct2, 0.0) AS distinct2 FROM (SELECT DISTINCT variety FROM w) v LEFT JOIN (SELECT variety, count(*) AS pairs, round(count(DISTINCT g) / count(*), 9) AS distinct2 FROM g GROUP BY 1) x ON v.variety IS NOT DISTINCT FROM x.variety""")
def distinct_bigrams(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("text is not null")
    return metrics.distinct2(m, ["variety"], "text").withColumn("distinct2", F.round("distinct2", 9))


@query(f"""WITH x AS (SELECT intent, count(*) AS n, count(*) FILTER (reply_fits) AS k FROM {PAIRS_SQL} WHERE intent IS NOT NULL GROUP BY 1)
SELECT intent, round(greatest(0, (k/n + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96 * sqrt((k/n)*(1-k/n)/n + 3.8416/(4*n*n)) / (1 + 3.8416/n)), 9) AS lo,
 round(least(1, (k/n + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96 * sqrt((k/n)*(1-k/n)/n + 3.8416/(4*n*n)) / (1 + 3.8416/n)), 9) AS hi FROM x""")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d, "intent", "reply_fits").where("intent is not null").groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if("reply_fits").alias("k"))
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return x.select("intent", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query(f"""WITH x AS (SELECT intent, count(*) AS n, count(*) FILTER (reply_fits) AS k FROM {PAIRS_SQL} WHERE intent IS NOT NULL GROUP BY 1), y AS (SELECT *, n / sum(n) OVER () AS share FROM x)
SELECT round(sum(share * k / n) / sum(share), 9) AS rate FROM y""")
def weighted_fit_rate(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d, "intent", "reply_fits").where("intent is not null").groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if("reply_fits").alias("k"))
    # one row per intent: the window sees no data
    return metrics.weighted_rate(x.withColumn("share", F.col("n") / F.sum("n").over(Win.partitionBy(F.lit(0)))), "k", "n", "share").select(F.round("rate", 9).alias("rate"))


@query(f"SELECT route, median(latency_ms) AS median, quantile_disc(latency_ms, 0.95) AS p95 FROM {PAIRS_SQL} GROUP BY 1")
def latency_by_route(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "route", "latency_ms").groupBy("route").agg(*metrics.latency("latency_ms"))


@query(f"SELECT round(avg(CASE WHEN valid_json IS NOT DISTINCT FROM finished THEN 1.0 ELSE 0 END), 9) AS same_flags, round(avg(CASE WHEN message IS NOT DISTINCT FROM reply THEN 1.0 ELSE 0 END), 9) AS same_text FROM {PAIRS_SQL}")
def agreement_rates(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.agreement(_pairs(spark, d, "valid_json", "finished", "message", "reply"), {"same_flags": ("valid_json", "finished"), "same_text": ("message", "reply")})
    return x.select(F.round("same_flags", 9).alias("same_flags"), F.round("same_text", 9).alias("same_text"))


@query(f"SELECT count(*) FILTER (confidence >= 0.8) AS covered, count(*) FILTER (confidence >= 0.8 AND reply_fits) AS right_ones FROM {PAIRS_SQL}")
def covered_answers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence") >= 0.8
    return _pairs(spark, d, "confidence", "reply_fits").agg(F.count_if(c).alias("covered"), F.count_if(c & F.col("reply_fits")).alias("right_ones"))


@query("""WITH x AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, max(d) AS spike FROM x GROUP BY 1""")
def value_spikes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spike(table(spark, d, "events"), "user_id", "event_id", "value")


@query(f"""WITH x AS (SELECT lang_hint, avg(CASE WHEN reply_fits THEN 1.0 ELSE 0 END) AS r FROM {PAIRS_SQL} WHERE lang_hint IS NOT NULL GROUP BY 1), y AS (SELECT lower(lang_hint) AS g, avg(r) AS m FROM x GROUP BY 1) SELECT round(avg(m), 9) AS mean_of_means FROM y""")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d, "lang_hint", "reply_fits").where("lang_hint is not null").groupBy("lang_hint").agg(metrics.rate(F.col("reply_fits")).alias("r"))
    return x.groupBy(F.lower("lang_hint").alias("g")).agg(F.avg("r").alias("m")).agg(F.round(F.avg("m"), 9).alias("mean_of_means"))


@query(f"""WITH x AS (SELECT intent, avg(CASE WHEN reply_fits THEN 1.0 ELSE 0 END) AS score, median(latency_ms) AS ms FROM {PAIRS_SQL} WHERE intent IS NOT NULL GROUP BY 1)
SELECT intent FROM x WHERE score >= (SELECT max(score) FROM x) - 0.01 ORDER BY ms, intent LIMIT 1""")
def best_within_tie(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d, "intent", "reply_fits", "latency_ms").where("intent is not null").groupBy("intent").agg(metrics.rate(F.col("reply_fits")).alias("score"), F.percentile("latency_ms", 0.5).alias("ms"))
    return metrics.select_checkpoint(x, "score", 0.01, F.col("ms"), F.col("intent")).select("intent")


@query(f"SELECT request_id, CASE WHEN valid_json IS NULL OR reply_fits IS NULL OR finished IS NULL THEN NULL ELSE valid_json AND reply_fits AND finished END AS good FROM {PAIRS_SQL}")
def judged_good(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "valid_json", "reply_fits", "finished").select("request_id", jsonio.judged_good("valid_json", "reply_fits", "finished").alias("good"))


@query(f"SELECT request_id, CASE WHEN coalesce(valid_json AND reply_fits AND confidence >= 0.5, false) THEN 'on_device' ELSE 'escalate' END AS route FROM {PAIRS_SQL}")
def routing(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "valid_json", "reply_fits", "confidence").select("request_id", tokens.route(F.col("valid_json"), F.col("reply_fits"), F.col("confidence"), 0.5).alias("route"))


# ------------------------------------------------------------------ tokens


@query("SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)")
def shard_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return tokens.running_offsets(rows, "doc_id", "n").select("doc_id", F.col("offset").cast("bigint").alias("offset"))


@query("""WITH x AS (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, o, n, unnest(range(o // 50000, (o + n - 1) // 50000 + 1)) AS shard FROM x WHERE n > 0)
SELECT shard, count(*) AS pieces, sum(least(o + n, (shard + 1) * 50000) - greatest(o, shard * 50000))::BIGINT AS tokens FROM p GROUP BY 1""")
def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n_"))
    pieces = tokens.shard_pieces(tokens.running_offsets(rows, "doc_id", "n_"), "n_", 50_000)
    return pieces.groupBy("shard").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").cast("bigint").alias("tokens"))


@query("SELECT doc_id, unnest(range(0, n - 128, 128)) AS start FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 128")
def window_starts(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return tokens.window_index(rows, "n", 128).select("doc_id", "start")


@query("""WITH x AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('21:' || doc_id)) - 1 AS p FROM documents WHERE text IS NOT NULL),
 y AS (SELECT *, p // 64 AS c, row_number() OVER (PARTITION BY source, p // 64 ORDER BY n, md5('21:' || doc_id)) - 1 AS r FROM x) SELECT doc_id, (c * 4 + r // 16)::BIGINT AS batch FROM y""")
def batches_by_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null").select("doc_id", "source", F.length("text").alias("n"))
    return tokens.length_batches(rows, sampling.order_of(21, F.col("doc_id")), "n", 4, 16, "source").select("doc_id", F.col("batch").cast("bigint").alias("batch"))


@query("SELECT msg_id, ((row_number() OVER (PARTITION BY intent ORDER BY msg_id) - 1) // 20)::BIGINT AS batch FROM messages")
def batches_within_intent(spark: SparkSession, d: str) -> DataFrame:
    return tokens.fixed_batches(table(spark, d, "messages").select("msg_id", "intent"), "intent", "msg_id", 20).select("msg_id", F.col("batch").cast("bigint").alias("batch"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
SELECT vec_id, (list_position(e, list_max(e)) - 1)::BIGINT AS best, round(list_max(e) / list_sum(e), 6) AS confidence FROM x""")
def softmax_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = tokens.softmax(F.col("embedding"))
    x = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    return x.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).alias("best"), F.round(F.array_max("p"), 6).alias("confidence"))


@query("SELECT vec_id, len(e)::BIGINT AS size, round(list_sum(e), 4) AS total FROM (SELECT vec_id, list_concat(list_transform(embedding, lambda v: v::DOUBLE), list_transform(range(greatest(80 - len(embedding), 0)), lambda i: -1.0::DOUBLE))[1:80] AS e FROM embeddings)")
def padded_rows(spark: SparkSession, d: str) -> DataFrame:
    e = tokens.pad_to(F.transform("embedding", lambda v: v.cast("double")), 80, F.lit(-1.0))
    return table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", F.size("e").cast("bigint").alias("size"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"SELECT source, round(sum(length(text)) / sum(len({WORDS_SQL.format(c='text')})), 9) AS chars_per_word FROM documents WHERE text IS NOT NULL GROUP BY 1")
def fertility(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).where("text is not null").groupBy("source").agg(*metrics.text_stats(F.col("text")))
    return x.select("source", F.round(F.col("chars") / F.col("words"), 9).alias("chars_per_word"))


@query("SELECT l AS layers, w AS width, 6 * (l * 12 * w * w + w * 16384) AS flops FROM (VALUES (8::BIGINT, 512::BIGINT), (12::BIGINT, 640::BIGINT), (16::BIGINT, 768::BIGINT)) t(l, w)")
def flops_per_token(spark: SparkSession, d: str) -> DataFrame:
    sizes = spark.createDataFrame([(8, 512), (12, 640), (16, 768)], "layers long, width long")
    return sizes.withColumn("flops", tokens.train_flops_per_token(F.col("layers"), F.col("width"), F.lit(16_384)))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    return sampling._smallest(_docs(spark, d).select("source", "doc_id"), ["source"], F.col("doc_id"), 5).select("source", "doc_id")


@query(f"SELECT replace(replace(reply, '|', '\\|'), chr(10), ' ') AS cell, count(*) AS n FROM {PAIRS_SQL} WHERE reply IS NOT NULL GROUP BY 1")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "reply").where("reply is not null").groupBy(T.cell(F.col("reply")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ assembly


@query("""WITH n AS (SELECT msg_id, md5(lower(text)) AS k, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY msg_id) AS r FROM messages WHERE split IN ('dev', 'test') AND text IS NOT NULL)
SELECT msg_id FROM n WHERE r = 1 AND k NOT IN (SELECT md5(lower(text)) FROM messages WHERE split = 'train' AND text IS NOT NULL)""")
def new_rows_only(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("text is not null").select("msg_id", "text", "split")
    return dedup.new_only(m.where("split in ('dev', 'test')"), m.where("split = 'train'"), "text", "msg_id").select("msg_id")


@query(f"WITH {_OVERLAP_SQL} SELECT msg_id FROM k WHERE split = 'train' AND msg_id NOT IN (SELECT msg_id FROM same) AND msg_id NOT IN (SELECT msg_id FROM near)")
def decontaminated_train(spark: SparkSession, d: str) -> DataFrame:
    m = _overlap_items(spark, d)
    return dedup.decontaminate(m.where("split = 'train'"), m.where("split = 'test'"), "msg_id", "key", "items", 3, 5).select("msg_id")


@query("""WITH r AS (SELECT DISTINCT request_id, reply FROM predict_responses), f AS (SELECT request_id, min(message_masked) AS t FROM predict_responses WHERE message_masked IS NOT NULL GROUP BY 1),
 v AS (SELECT request_id FROM predict_responses WHERE intent = 'small_talk' GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (v.request_id IS NOT NULL AND f.t IS NOT NULL) AS rewritten FROM r LEFT JOIN f USING (request_id) LEFT JOIN v USING (request_id)""")
def rewritten_replies(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "predict_responses")
    rows = r.select("request_id", "reply").distinct()
    fixed = r.where("message_masked is not null").groupBy("request_id").agg(F.min("message_masked").alias("reply"))
    verdicts = r.where("intent = 'small_talk'").select("request_id").distinct().withColumn("verdict", F.lit("OK"))
    out = joins.rewrites(rows, fixed, verdicts, ["request_id"], "reply", "OK")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("rewritten").alias("rewritten"))


@query("SELECT name, 't' || lpad((row_number() OVER (ORDER BY name) + 42)::VARCHAR, 4, '0') AS id FROM intents")
def numbered_intents(spark: SparkSession, d: str) -> DataFrame:
    taken = spark.createDataFrame([("t0007",), ("t0042",)], "id string")
    return joins.next_ids(table(spark, d, "intents").select("name"), taken, "id", "name")


@query(r"SELECT doc_id, len(regexp_extract_all(text, ' ?\p{L}[\p{L}\p{M}]*|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+'))::BIGINT AS pieces FROM documents WHERE text IS NOT NULL")
def pre_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(tokens.pre_tokens(F.col("text"))).cast("bigint").alias("pieces"))


from marlspike import assembly_queries  # noqa: E402, F401  registers its queries here
