"""Tolerant parsing of model completions: scores, JSON, numbered lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, RECOVERED, NO_SCORE, EMPTY, NO_INPUT = "ok", "recovered", "no_score", "empty", "no_input"


def without_fence(raw: Column) -> Column:
    """What stands in a code fence, closed or not; else the text itself."""
    inner = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*(?:```|\z)", 1)
    return F.trim(F.when(raw.contains("```"), inner).otherwise(raw))


def first_object(text: Column) -> Column:
    """From the first opening brace to the last closing one; empty without."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parsed(raw: Column) -> Column:
    """struct<score, justification, parse_status> of a completion."""
    body = without_fence(F.coalesce(raw, F.lit("")))
    typed = F.from_json(body, "score DOUBLE, justification STRING", {"mode": "PERMISSIVE"})
    loose = F.regexp_extract(body, r'"score"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)', 1).try_cast("double")
    rest = F.regexp_extract(body, r'(?s)"justification"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    # from_json fills what it read of a text that is cut off, so a status needs a whole object
    whole = body.rlike(r"(?s)^\{.*\}$") & typed["score"].isNotNull()
    status = F.when(blank, EMPTY).when(whole, OK).when(loose.isNotNull(), RECOVERED).otherwise(NO_SCORE)
    why = F.when(status == OK, typed["justification"]).when(status == RECOVERED, F.when(rest == "", None).otherwise(F.concat(rest, F.lit("…[TRUNCATED]")))).when(status == NO_SCORE, "[PARSE_FAILED]")
    return F.struct(F.when(status == OK, typed["score"]).when(status == RECOVERED, loose).alias("score"), why.alias("justification"), status.alias("parse_status"))


def with_input_status(status: Column, known: Column) -> Column:
    """no_input for rows whose profiles are unknown."""
    return F.when(known, status).otherwise(NO_INPUT)


def close_json(text: str) -> str:
    """text with what is open at its end closed: strings, lists and objects; commas before a closing sign go."""
    out, stack, quoted, escaped = [], [], False, False
    for c in text:
        if quoted:
            out.append(c)
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            continue
        if c in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if stack and stack[-1] == c:
                stack.pop()
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c == '"':
            quoted = True
        out.append(c)
    if escaped:
        out.pop()
    if quoted:
        out.append('"')
    elif stack:
        while out and (out[-1].isspace() or out[-1] in ",:"):
            out.pop()
    return "".join(out) + "".join(reversed(stack))


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """The first object of a text, closed and without stray commas, as normal JSON; null if it can't be read. A state machine over
    characters, which no built-in expresses."""

    def one(raw):
        if raw is None or "{" not in raw:
            return None
        body = close_json(raw[raw.index("{") :])
        for end in (len(body), body.rfind("}") + 1):
            try:
                return json.dumps(json.loads(body[:end]), sort_keys=True, separators=(",", ":"))
            except ValueError:
                continue
        return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def annotated(text: pd.Series, labels: pd.Series) -> pd.Series:
    """text with the first occurrence of each label (an array of struct<label, type>) marked as [label](type), longest label first, and
    nothing marked twice. Ordered rewriting, which no built-in expresses."""

    def one(raw, nodes):
        if raw is None:
            return None
        spans: list[tuple[int, int, str]] = []
        for n in sorted((n for n in (nodes if nodes is not None else []) if n["label"]), key=lambda n: (-len(n["label"]), n["label"])):
            at = raw.lower().find(n["label"].lower())
            while at >= 0 and any(a < at + len(n["label"]) and at < b for a, b, _ in spans):
                at = raw.lower().find(n["label"].lower(), at + 1)
            if at >= 0:
                spans.append((at, at + len(n["label"]), n["type"]))
        for a, b, kind in sorted(spans, reverse=True):
            raw = f"{raw[:a]}[{raw[a:b]}]({kind}){raw[b:]}"
        return raw

    return pd.Series([one(t, n) for t, n in zip(text, labels)])


def entity_id(value: Column) -> Column:
    """The only number in a text; null if it has none or several."""
    return F.when(F.regexp_count(value, F.lit("[0-9]+")) == 1, F.regexp_extract(value, "([0-9]+)", 1).try_cast("int"))


def entity_lines(raw: Column) -> Column:
    """array<struct<pos, text, keep, label, reason>> of lines such as "1. text | True | LABEL | reason"."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda line: F.split(line, r"\|"))
    good = F.filter(lines, lambda p: (F.size(p) >= 3) & p[0].rlike(r"^\s*[0-9]+\.\s*\S"))
    return F.transform(
        good,
        lambda p: F.struct(
            F.regexp_extract(p[0], r"^\s*([0-9]+)\.", 1).try_cast("int").alias("pos"),
            F.trim(F.regexp_replace(p[0], r"^\s*[0-9]+\.\s*", "")).alias("text"),
            (F.lower(F.trim(p[1])) == "true").alias("keep"),
            F.trim(p[2]).alias("label"),
            F.trim(F.coalesce(F.get(p, 3), F.lit(""))).alias("reason"),
        ),
    )


def sentence_with(text: Column, span: Column) -> Column:
    """The first sentence that holds span, whatever the case; null if none does."""
    return F.trim(F.get(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.lower(s).contains(F.lower(span))), 0))


def json_lines(raw: Column, schema: str) -> Column:
    """Objects of a fenced block of JSON lines; lines that can't be read are left out."""
    rows = F.filter(F.split(without_fence(raw), "\n"), lambda line: F.trim(line).rlike(r"^\{.*\}$"))
    return F.filter(F.transform(rows, lambda line: F.from_json(line, schema)), lambda r: r.isNotNull())


def output_text(body: Column) -> Column:
    """The first output_text of the first message in a batch result's body."""
    kind = "struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>"
    message = F.get(F.filter(F.from_json(body, kind)["output"], lambda o: o["type"] == "message"), 0)
    return F.get(F.filter(message["content"], lambda c: c["type"] == "output_text"), 0)["text"]


_LINE = """struct<custom_id:string,text:string,error:string,
 response:struct<status_code:int,body:struct<error:struct<message:string>,status:string,incomplete_details:struct<reason:string>,output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>>,
 result:struct<type:string,message:struct<stop_reason:string,content:array<struct<type:string,text:string>>>,error:struct<type:string,message:string>>>"""
# Messages for answers that are not complete, by the reason.
INCOMPLETE = {"max_output_tokens": "Token limit reached (max_output_tokens exceeded)", "content_filter": "Content filter triggered", "max_completion_tokens": "Completion token limit exceeded"}


def _error_text(error: Column) -> Column:
    """An error's message, or the error as it stands; null for none."""
    blank = F.coalesce(error, F.lit("")).isin("", "null", "{}")
    return F.when(~blank, F.coalesce(F.get_json_object(error, "$.message"), error))


def batch_line(line: Column) -> Column:
    """struct<custom_id, text, error> of a line of batch results, in any of three shapes: normalised (text, error), a response with a status code and a
    body of outputs, or a result with a type and a message of blocks. An answer that was cut off has an error, and keeps what text the third shape has."""
    d = F.from_json(line, _LINE)
    body, reason = d["response"]["body"], d["response"]["body"]["incomplete_details"]["reason"]
    cut = F.lit("INCOMPLETE: ")
    known = F.coalesce(*(F.when(reason == k, F.concat(cut, F.lit(v))) for k, v in INCOMPLETE.items()), F.concat(cut, F.lit("Status incomplete (reason: "), F.coalesce(reason, F.lit("unknown")), F.lit(")")))
    firsts = F.flatten(F.transform(F.filter(body["output"], lambda o: o["type"] == "message"), lambda o: F.slice(F.filter(o["content"], lambda c: c["type"] == "output_text"), 1, 1)))
    said = F.coalesce(F.get(F.filter(firsts, lambda c: c["text"] != ""), F.lit(0))["text"], F.try_element_at(firsts, F.lit(-1))["text"])
    ok = d["response"]["status_code"].eqNullSafe(F.lit(200))
    failed = F.when(d["response"].isNull(), "Missing response object").when(~ok, F.coalesce(body["error"]["message"], F.concat(F.lit("HTTP "), F.coalesce(d["response"]["status_code"].cast("string"), F.lit("None")))))
    failed = F.coalesce(failed, body["error"]["message"], F.when(body["status"] == "incomplete", known), F.when(said.isNull(), "No output_text found"))
    error = _error_text(d["error"])
    first = F.struct(d["custom_id"].alias("custom_id"), F.when(error.isNull() & failed.isNull(), said).alias("text"), F.coalesce(error, failed).alias("error"))
    plain = F.struct(d["custom_id"].alias("custom_id"), F.when(error.isNull(), d["text"]).alias("text"), error.alias("error"))
    result, why = d["result"], F.coalesce(d["result"]["error"]["message"], F.lit(""))
    blocks = F.trim(F.array_join(F.transform(F.filter(result["message"]["content"], lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n"))
    blocks = F.when(blocks != "", blocks)
    limit = F.lower(why).contains("max_tokens") | F.lower(why).contains("length")
    broken = F.when(limit, F.concat(cut, F.lit("Token limit - "), why)).otherwise(F.coalesce(F.when(why != "", why), F.get_json_object(line, "$.result.error"), F.get_json_object(line, "$.result")))
    stopped = F.when(result["message"]["stop_reason"] == "max_tokens", F.concat(cut, F.lit("Token limit reached (max_tokens)"))).when(blocks.isNull(), "No text content found")
    whole = result["type"].eqNullSafe(F.lit("succeeded"))
    second = F.struct(d["custom_id"].alias("custom_id"), F.when(whole, blocks).alias("text"), F.when(whole, stopped).otherwise(broken).alias("error"))
    has = lambda name: F.array_contains(F.json_object_keys(line), name)
    return F.when(has("text"), plain).when(has("result"), second).otherwise(first)
