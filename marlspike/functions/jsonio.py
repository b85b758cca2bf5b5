"""Strict parsing of model answers, as Arrow functions over the standard JSON rules.

Built-in JSON functions coerce numbers to strings and accept trailing text, which these checks must not.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from marlspike.functions.text import NOT_S, S, ascii_digits

_ANSWER = pa.struct([("parsed", pa.bool_()), ("valid", pa.bool_()), ("intent", pa.string()), ("reply", pa.string())])


def parse_answer(answer: Column, intents: list[str]) -> Column:
    """parsed: any JSON; valid: an object of exactly ``intent`` and ``reply``, both strings, the intent known."""
    known = frozenset(intents)

    @F.arrow_udf("parsed boolean, valid boolean, intent string, reply string")
    def run(v: pa.Array) -> pa.Array:
        out = []
        for x in v.to_pylist():
            row = {"parsed": False, "valid": False, "intent": None, "reply": None}
            try:
                got = json.loads(x) if x is not None else None
                row["parsed"] = x is not None
                if isinstance(got, dict) and set(got) == {"intent", "reply"} and all(isinstance(y, str) for y in got.values()) and got["intent"] in known:
                    row |= {"valid": True, **got}
            except ValueError:
                pass
            out.append(row)
        return pa.array(out, _ANSWER)

    return run(answer)


@F.arrow_udf(StringType())
def _target(intent: pa.Array, reply: pa.Array) -> pa.Array:
    return pa.array([json.dumps({"intent": a, "reply": b}, ensure_ascii=False) for a, b in zip(intent.to_pylist(), reply.to_pylist(), strict=True)], pa.string())


def target(intent: Column, reply: Column) -> Column:
    """The answer that a model should give, as JSON."""
    return _target(intent, reply)


def _objects(text: str | None) -> list[dict]:
    if not text:
        return []
    t = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    try:
        whole = json.loads(t)
        if isinstance(whole, list):
            return [x for x in whole if isinstance(x, dict)]
    except ValueError:
        pass
    out = []
    for line in t.splitlines():
        a, b = line.find("{"), line.rfind("}")
        if 0 <= a < b:
            try:
                got = json.loads(line[a : b + 1])
            except ValueError:
                continue
            if isinstance(got, dict):
                out.append(got)
    return out


@F.arrow_udf(ArrayType(StringType()))
def parse_json_objects(v: pa.Array) -> pa.Array:
    """Objects of an answer: a whole array, or one object a line behind list marks and fences; others are skipped."""
    return pa.array([[json.dumps(o, ensure_ascii=False) for o in _objects(x)] for x in v.to_pylist()], pa.list_(pa.string()))


def _numbers(text: str | None, n: int) -> list[tuple[int, dict]]:
    return [(int(o["n"]), o) for o in _objects(text) if isinstance(o.get("n"), int) and 1 <= o["n"] <= n]


def parse_numbered(answer: Column, n: int, field: str) -> Column:
    """(``n``, ``value``) of the objects whose number is in range and whose field is a non-blank string.

    The value is kept as it is; of a repeated number the last holds.
    """

    @F.arrow_udf("array<struct<n:int,value:string>>")
    def run(v: pa.Array) -> pa.Array:
        rows = []
        for x in v.to_pylist():
            got = {k: o[field] for k, o in _numbers(x, n) if isinstance(o.get(field), str) and o[field].strip()}
            rows.append([{"n": k, "value": t} for k, t in got.items()])
        return pa.array(rows, pa.list_(pa.struct([("n", pa.int32()), ("value", pa.string())])))

    return run(answer)


def parse_verdicts(answer: Column, n: int) -> Column:
    """(``n``, ``verdict``, ``reason``) with the verdict OK or BROKEN in any case; no reason is an empty one.

    Of a repeated number the last holds.
    """

    @F.arrow_udf("array<struct<n:int,verdict:string,reason:string>>")
    def run(v: pa.Array) -> pa.Array:
        rows = []
        for x in v.to_pylist():
            got = {}
            for k, o in _numbers(x, n):
                verdict = str(o.get("verdict", "")).strip().upper()
                if verdict in ("OK", "BROKEN"):
                    got[k] = {"n": k, "verdict": verdict, "reason": str(o.get("reason") or "").strip()}
            rows.append(list(got.values()))
        return pa.array(rows, pa.list_(pa.struct([("n", pa.int32()), ("verdict", pa.string()), ("reason", pa.string())])))

    return run(answer)


# Where answers break into lines, lines that give a label, list marks, quotation marks.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"
LABEL_LINE = rf"^{S}*(\p{{Nd}}+){S}*[:.)\-]{S}*([a-z_]+){S}*$"
LIST_MARK = rf"^{S}*(?:[-*•]|\(?[0-9٠-٩]{{1,3}}[.)\-:]){S}+"
QUOTES = "\"'“”«»`"


def answer_lines(answer: Column) -> Column:
    return F.split(answer, LINE_BREAK)


def parse_labels(answer: Column) -> Column:
    """Rows "number label" of an answer as an array of structs; of a repeated number the last holds.

    Lines whose number is beyond 64 bits can't name an item and are dropped.
    """
    read = F.transform(answer_lines(answer), lambda x: F.struct(ascii_digits(F.regexp_extract(x, LABEL_LINE, 1)).try_cast("bigint").alias("n"), F.regexp_extract(x, LABEL_LINE, 2).alias("label")))
    rows = F.filter(read, lambda x: x["n"].isNotNull())
    later = lambda x, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda y: y["n"] == x["n"])
    return F.filter(rows, later)


def parse_lines(answer: Column) -> Column:
    """Lines without list marks, surrounding quotes and white space; blank ones are dropped."""
    trimmed = lambda x: F.regexp_replace(x, f"^{S}+|{S}+$", "")
    bare = F.transform(answer_lines(answer), lambda x: trimmed(F.regexp_replace(x, LIST_MARK, "")))
    return F.filter(F.transform(bare, lambda x: trimmed(F.regexp_replace(x, f"^[{QUOTES}]+|[{QUOTES}]+$", ""))), lambda x: x != "")


def bad_fields(obj: Column, *fields: str) -> Column:
    """Whether a JSON object lacks one of ``fields`` as a non-blank string; anything but an object lacks them."""
    v = F.try_parse_json(obj)
    ok = F.lit(True)
    for f in fields:
        x = F.try_variant_get(v, f"$.{f}", "variant")
        text = F.try_variant_get(v, f"$.{f}", "string")
        ok = ok & F.coalesce((F.schema_of_variant(x) == "STRING") & text.rlike(NOT_S), F.lit(False))
    return ~ok


def judged_good(*answers: str) -> Column:
    """True if all answers are, null if any is missing."""
    missing = F.lit(False)
    good = F.lit(True)
    for c in answers:
        missing = missing | F.col(c).isNull()
        good = good & F.coalesce(F.col(c), F.lit(False))
    return F.when(missing, None).otherwise(good)
