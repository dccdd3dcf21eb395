"""Structured summaries out of loose model output: fenced or cut JSON, field defaults."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = "summary string, topics array<string>, key_facts array<string>, sentiment string, importance double"


def repair(text: str | None) -> str | None:
    """A JSON object from a text: fenced, embedded, with trailing commas, or cut off; None if there is none."""
    if not text:
        return None
    m = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    s = m[1] if m else text
    a = s.find("{")
    if a < 0:
        return None
    s = s[a:]
    for end in [m.end() for m in re.finditer(r"\}", s)][::-1][:20] + [len(s)]:
        body = re.sub(r",\s*([}\]])", r"\1", s[:end])
        try:
            return json.dumps(json.loads(body), ensure_ascii=False)
        except ValueError:
            continue
    stack, inside, skip = [], False, False
    for c in s:
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    body = re.sub(r"[,:]\s*$", "", s + ('"' if inside else "")) + "".join(reversed(stack))
    body = re.sub(r",\s*([}\]])", r"\1", body)
    try:
        return json.dumps(json.loads(body), ensure_ascii=False)
    except ValueError:
        fields = {k: v for k, v in re.findall(r'"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)"', s)}
        return json.dumps(fields, ensure_ascii=False) if fields else None


def repaired(df: DataFrame, column: str) -> DataFrame:
    """Adds ``fixed``: repaired JSON of a text column, Arrow batch by batch."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(repair)

    return df.withColumn("fixed", run(F.col(column)))


def with_defaults(fixed: Column) -> Column:
    """Summary struct with at most five topics and facts, a known sentiment, importance in 0..1."""
    s = F.from_json(fixed, SUMMARY)
    empty = F.array().cast("array<string>")
    mood = F.when(s["sentiment"].isin("positive", "negative", "neutral"), s["sentiment"]).otherwise("neutral")
    imp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(s["importance"], F.lit(0.5))))
    return F.struct(F.coalesce(s["summary"], F.lit("")).alias("summary"), F.slice(F.coalesce(s["topics"], empty), 1, 5).alias("topics"), F.slice(F.coalesce(s["key_facts"], empty), 1, 5).alias("key_facts"), mood.alias("sentiment"), imp.alias("importance"))
