"""Tolerant parsing of model answers.

Answers that are one flat JSON object are read by Spark's own functions; only the rest goes through one vectorised
function. It finds top-level objects, then tries ever more lenient readings of each: strict; brackets balanced; trailing
commas dropped; single quotes as double ones; stray quotes inside strings dropped if they stand within a word, else
escaped (more lenient than published results, which give up on the latter); a Python literal.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import c, normalise_key

# Keys that explain rather than answer.
EXPLAINING = ("explanation", "reason", "reasoning", "rationale")
RESULT = T.StructType([
    T.StructField("answer", T.MapType(T.StringType(), T.StringType())), T.StructField("explanation", T.StringType()), T.StructField("failure", T.StringType()),
    T.StructField("n_objects", T.IntegerType()), T.StructField("lost", T.BooleanType()),
])
_CLOSER = {"{": "}", "[": "]"}


def objects(text: str) -> list[str]:
    """The outermost {...} of a text in order; one left open reaches to the end. Braces in strings don't count."""
    found, depth, start, quoted, i = [], 0, 0, False, 0
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == "\\":
                i += 1
            elif ch == '"':
                quoted = False
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                found.append(text[start : i + 1])
        i += 1
    return found + ([text[start:]] if depth else [])


def balanced(text: str) -> str:
    """Wrong closers replaced, missing ones added, surplus ones dropped."""
    out, open_, quoted, skip = [], [], False, False
    for ch in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in _CLOSER:
            open_.append(_CLOSER[ch])
        elif ch in "]}":
            if not open_:
                continue
            ch = open_.pop()
        out.append(ch)
    return "".join(out) + ('"' if quoted else "") + "".join(reversed(open_))


def _stray_quotes(text: str) -> str:
    """Quotes in a string that no comma, colon, closer or end follows don't close it: within a word they are dropped, else escaped."""
    out, inside, skip = [], False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            if not inside:
                inside = True
            elif text[i + 1 :].lstrip()[:1] in ("", ",", ":", "}", "]"):
                inside = False
            elif text[i - 1].isspace() or text[i - 1] in ",:[{" or text[i + 1].isspace():
                ch = '\\"'
            else:
                continue
        out.append(ch)
    return "".join(out)


def read_object(text: str) -> dict | None:
    """The first reading of the ladder that gives an object."""
    trailing = lambda s: re.sub(r",(\s*[}\]])", r"\1", s)
    single = lambda s: re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1].replace("\\'", "'")), s)
    for reading in (lambda s: s, balanced, lambda s: trailing(balanced(s)), lambda s: trailing(balanced(single(s))), lambda s: trailing(balanced(_stray_quotes(s))), lambda s: trailing(_stray_quotes(s))):
        try:
            got = json.loads(reading(text), strict=False)
            if isinstance(got, dict):
                return got
        except ValueError:
            pass
    try:
        got = ast.literal_eval(text)
        return got if isinstance(got, dict) else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def unwrap(value):
    """The first element of a list, None of an empty one."""
    while isinstance(value, list):
        value = value[0] if value else None
    return value


def _text(value) -> str | None:
    value = unwrap(value)
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def parse_answer(text: str | None) -> dict:
    """What a text answers and explains. The last object with an answer wins; explanations may stand in any."""
    out = {"answer": None, "explanation": None, "failure": None, "n_objects": 0, "lost": False}
    if text is None or not text.strip():
        return out | {"failure": "empty"}
    pieces = objects(text)
    read = [read_object(p) for p in pieces]
    out["n_objects"], out["lost"] = len(pieces), any(r is None for r in read)
    explains = lambda k: re.sub(r"[\s_\-]+", "", str(k)).lower() in EXPLAINING
    for got in read:
        answers = {str(k): _text(v) for k, v in (got or {}).items() if not explains(k)}
        if answers:
            out["answer"] = answers
        for k, v in (got or {}).items():
            if explains(k):
                out["explanation"] = _text(v)
    if not any(r is not None for r in read):
        out["failure"] = "not json"
    elif out["answer"] is None:
        out["failure"] = "no answer"
    elif all(v is None for v in out["answer"].values()):
        out["failure"] = "null"
    return out


def answers_of(text: str | None) -> list[dict[str, str | None]]:
    """What each readable object of a text answers, in order, without explanations."""
    explains = lambda k: re.sub(r"[\s_\-]+", "", str(k)).lower() in EXPLAINING
    read = [read_object(p) for p in objects(text or "")]
    return [{str(k): _text(v) for k, v in got.items() if not explains(k)} for got in read if got is not None]


def all_answers(text) -> Column:
    """The answers of all objects of a text, found by the scanner and read by the ladder: array of maps."""
    return F.pandas_udf(lambda texts: pd.Series([answers_of(None if pd.isna(t) else t) for t in texts]), "array<map<string,string>>")(c(text))


def _ladder(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_answer(None if pd.isna(t) else t) for t in texts], columns=["answer", "explanation", "failure", "n_objects", "lost"])


# A JSON object of strings without escapes, whole numbers, true, false and null: read alike by Spark and the ladder.
_FLAT = r'^\s*+\{\s*+(?:"[^"\\{}\[\]\x00-\x1f]++"\s*+:\s*+(?:"[^"\\{}\[\]\x00-\x1f]*+"|-?[1-9]\d*+|0|true|false|null)\s*+(?:,\s*+(?=")|(?=\})))++\}\s*+$'


def _flat_answer(text: Column) -> Column:
    """RESULT of a flat object whose keys differ, else NULL."""
    entries = F.from_json(F.when(text.rlike(_FLAT), text), "map<string,string>")
    explains = lambda k: F.lower(F.regexp_replace(k, r"[\s_\-]+", "")).isin(*EXPLAINING)
    answers, reasons = F.map_filter(entries, lambda k, _: ~explains(k)), F.map_values(F.map_filter(entries, lambda k, _: explains(k)))
    failure = F.when(F.size(answers) == 0, "no answer").when(~F.exists(F.map_values(answers), lambda v: v.isNotNull()), "null")
    read = F.struct(F.when(F.size(answers) > 0, answers).alias("answer"), F.try_element_at(reasons, F.lit(-1)).alias("explanation"), failure.alias("failure"), F.lit(1).alias("n_objects"), F.lit(False).alias("lost"))
    return F.when(entries.isNotNull() & (F.size(F.array_distinct(F.map_keys(entries))) == F.size(entries)), read)


def tolerant(text) -> Column:
    """N1-N4, N11 as a struct: answer, explanation, failure, n_objects, lost. The ladder gets only texts that aren't flat objects."""
    flat = _flat_answer(c(text))
    return F.coalesce(flat, F.pandas_udf(_ladder, RESULT)(F.when(flat.isNull(), c(text))))


def answer_for(parsed, key) -> Column:
    """The value whose key equals the expected one but for case, spaces, underscores and hyphens, else the first value."""
    entries = F.map_entries(c(parsed)["answer"])
    same = F.filter(entries, lambda e: normalise_key(e["key"]) == normalise_key(key))
    return F.coalesce(F.get(same, F.lit(0))["value"], F.get(entries, F.lit(0))["value"])


def merged(answers) -> Column:
    """An array of maps as one, later keys winning."""
    return F.aggregate(c(answers), F.create_map().cast("map<string,string>"), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m))


def ground_truth(a) -> Column:
    """The value in an answer that is a string, a one-element list, an object of either, or one of those inside another."""

    def value(x: Column) -> Column:
        v = F.try_parse_json(x)
        first_of_list = F.try_variant_get(v, "$[0]", "string")
        keys = F.json_object_keys(F.when(F.schema_of_variant(v).startswith("OBJECT"), x))
        first_of_map = F.element_at(F.map_values(F.from_json(F.when(keys.isNotNull(), x), "map<string,string>")), 1)
        plain = F.when(v.isNull(), x).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), x))
        return F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), first_of_list), first_of_map, plain)

    return value(value(c(a)))


def decode_twice(value) -> Column:
    """The JSON text in a document that may be encoded twice; NULL if it is no JSON."""
    once = F.try_parse_json(c(value))
    inner = F.try_variant_get(once, "$", "string")
    return F.when(F.schema_of_variant(once) == "STRING", F.when(F.try_parse_json(inner).isNotNull(), inner)).when(once.isNotNull(), c(value))
