"""Cleaning and parsing of model responses."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import text as tx


def strip_reasoning(text: Column) -> Column:
    """Remove ``<think>`` blocks and stray tags; the text itself if nothing is left."""
    cleaned = tx.strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    cleaned = tx.strip(F.regexp_replace(cleaned, "</?think>", ""))
    return F.when(cleaned == "", text).otherwise(cleaned)


def parse_score(text: Column) -> Column:
    """A number clamped to 0–10; 5 when there is none."""
    t = tx.strip(F.coalesce(text, F.lit("")))
    plain = F.regexp_like(F.regexp_replace(t, "[.-]", ""), F.lit("^[0-9]+$"))
    found = F.regexp_extract(t, r"\b(\d+\.?\d*)\b", 1)
    number = F.when(plain, t.try_cast("double")).when(found != "", found.try_cast("double"))
    return F.when(number.isNull(), 5.0).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(10.0)))


def _last_object(text: str) -> str | None:
    """The object starting at the latest brace whose balanced span parses."""
    for start in reversed([i for i, c in enumerate(text) if c == "{"]):
        depth = 0
        for end in range(start, len(text)):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            if depth == 0:
                span = text[start:end + 1]
                try:
                    json.loads(span)
                except ValueError:
                    break
                return span
    return None


def recover_one(text: str | None) -> str | None:
    """JSON text inside a response that is not JSON as a whole."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    for candidate in ([fence.group(1)] if fence else []):
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            pass
    found = _last_object(text)
    if found is not None:
        return found
    span = re.search(r"\[.*\]", text, re.S)
    if span:
        try:
            items = json.loads(span.group())
        except ValueError:
            return None
        if isinstance(items, list) and items:
            return '{"questions": ' + span.group() + "}"
    return None


def recover_batch(texts: pa.Array) -> pa.Array:
    return pa.array([recover_one(t) for t in texts.to_pylist()], pa.string())


def parse_json(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add ``json`` and ``recovered`` (direct, extracted or failed).

    Well-formed responses are accepted by the native parser; the Python
    recovery runs over the others only.
    """
    cleaned = responses.withColumn("_c", tx.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", "")))
    native = cleaned.withColumn("_ok", F.try_parse_json("_c").isNotNull() & (F.col("_c") != ""))
    direct = native.where("_ok").withColumns({"json": F.col("_c"), "recovered": F.lit("direct")})
    rest = native.where("not _ok").withColumn("json", F.arrow_udf(recover_batch, "string")("_c"))
    rest = rest.withColumn("recovered", F.when(F.col("json").isNull(), "failed").otherwise("extracted"))
    return direct.unionByName(rest).drop("_c", "_ok")


def parse_choice_text(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Plain-text multiple-choice blocks to question rows."""
    blocks = texts.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "_b"))
    question = F.regexp_extract("_b", r"(?id)(?:^|\n)(?:Q\d*[\):.\s-]*|Question[\s:.-]*)([^\n]+)", 1)
    options = F.filter(F.array(*[
        F.when(F.regexp_like("_b", F.lit(rf"(?i)(?:^|\n){c}[\)\].:\-]\s*[^\n]+")),
               F.concat(F.lit(f"{c}) "), tx.strip(F.regexp_extract("_b", rf"(?i)(?:^|\n){c}[\)\].:\-]\s*([^\n]+)", 1))))
        for c in "ABCD"]), lambda o: o.isNotNull())
    answer = F.upper(F.regexp_extract("_b", r"(?i)(?:^|\n)(?:Answer|Correct(?:\s*Answer)?)\s*[:\-]\s*([A-D])", 1))
    padding = F.array(*[F.lit(f"{c}) None of the above") for c in "ABCD"])
    rows = blocks.select(key, "block", tx.strip(question).alias("question"), options.alias("_o"),
                         F.coalesce(F.nullif(answer, F.lit("")), F.lit("A")).alias("answer"))
    rows = rows.where((F.col("question") != "") & (F.size("_o") >= 2))
    filled = F.slice(F.concat("_o", F.slice(padding, F.size("_o") + 1, F.lit(4))), 1, 4)
    return rows.select(key, "block", "question", filled.alias("options"), "answer",
                       F.lit("medium").alias("difficulty"), F.lit("General").alias("topic"))


# Headings and stock lines of the two answer layouts.
SUMMARY_HEADS = ["## Quick Summary", "## Important Terms", "## Key Takeaways"]
EXPLAIN_HEADS = ["## Concept Overview", "## Step-by-Step Explanation", "## Worked Intuition / Example", "## Common Mistakes",
                 "## Revision Points"]
SUMMARY_TAIL = ("\n\n## Important Terms\n- Add key terms from this section with one-line meanings."
                "\n\n## Key Takeaways\n- Focus on the core definition, process, and examples.")
EXPLAIN_DEFAULT = "- Expand each idea with definitions, logic, and examples."
EXPLAIN_TAIL = ("\n\n## Worked Intuition / Example\n- Connect this concept to one practical or exam-style scenario."
                "\n\n## Common Mistakes\n- Confusing definition with implementation details."
                "\n- Skipping assumptions and constraints in the section."
                "\n- Memorizing terms without understanding flow/logic."
                "\n\n## Revision Points\n- Remember the core definition.\n- Recall the main steps/process."
                "\n- Keep one practical example in mind.")
NO_RESPONSE = "No response generated. Please try again."


def course_layout(answer: Column, action: Column, heading: Column) -> Column:
    """Free text in the fixed summary or explanation layout, unless it already has it."""
    text = tx.strip(F.coalesce(answer, F.lit("")))
    filled = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), tx.strip), lambda s: s != "")
    lines = F.transform(filled, lambda s: tx.strip(F.replace(F.replace(s, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))))

    def has(heads: list[str]) -> Column:
        out = F.lit(True)
        for h in heads:
            out = out & text.contains(h)
        return out

    def bullets(ls: Column) -> Column:
        return F.transform(ls, lambda s: F.concat(F.lit("- "), tx.strip(F.regexp_replace(s, "^[- ]+", ""))))

    section = F.concat(F.lit("Section: **"), heading, F.lit("**"))

    def summary(ls: Column) -> Column:
        return F.concat(F.lit("## Quick Summary\n"), section, F.lit("\n\n"), F.array_join(bullets(F.slice(ls, 1, 8)), "\n"), F.lit(SUMMARY_TAIL))

    def explain(ls: Column) -> Column:
        rest = F.slice(ls, 4, 7)
        steps = F.when(F.size(rest) > 0, F.array_join(bullets(rest), "\n")).otherwise(EXPLAIN_DEFAULT)
        return F.concat(F.lit("## Concept Overview\n"), section, F.lit("\n\n"), F.array_join(F.slice(ls, 1, 3), "\n"),
                        F.lit("\n\n## Step-by-Step Explanation\n"), steps, F.lit(EXPLAIN_TAIL))

    return (
        F.when(text == "", NO_RESPONSE)
        .when((action == "summarize") & has(SUMMARY_HEADS), text).when(action == "summarize", tx.bind(lines, summary))
        .when(has(EXPLAIN_HEADS), text).otherwise(tx.bind(lines, explain)))
