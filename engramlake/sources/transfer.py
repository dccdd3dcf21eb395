"""Import and export of memories as JSON and CSV."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import text as T

MOST = 10_000
FIELDS = ["entry_id", "text", "importance", "session_id", "persona_id", "metadata"]
SCHEMA = "entry_id long, text string, importance double, session_id string, persona_id string, metadata string"


def entries_of(data: object) -> list[dict]:
    """Entries of any accepted shape: a list, ``data``/``memories``/``entries`` inside an object, a map of
    id to record, or one record; a list of messages becomes one entry."""
    if isinstance(data, dict):
        for k in ("memories", "entries", "data", "records", "items"):
            if k in data:
                return entries_of(data[k])
        if any(k in data for k in ("content", "text", "summary")):
            return [data]
        if data and all(isinstance(v, dict) for v in data.values()):
            return [{"original_id": k, **v} for k, v in data.items()]
        return []
    if isinstance(data, list):
        rows = [x if isinstance(x, dict) else {"content": str(x)} for x in data if x is not None]
        if rows and all("role" in r for r in rows):
            lines = [f"{r['role']}: {r.get('content', '')}" for r in rows if str(r.get("content") or "").strip()]
            return [{"content": "\n".join(lines), "source_messages": rows}]
        return rows
    return []


def _number(v: object, default: float = 0.5) -> float:
    try:
        x = float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return min(1.0, max(0.0, x)) if x == x and abs(x) != float("inf") else default


def read_json(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """Entries of one or many JSON files; a file with more than ``most`` entries or broken JSON fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = entries_of(json.loads(bytes(body).decode("utf-8-sig")))
                if len(rows) > most:
                    raise ValueError(f"{name}: more than {most} entries")
                out: list[list] = [[] for _ in FIELDS]
                for i, r in enumerate(rows):
                    text = r.get("content") or r.get("text") or r.get("summary") or ""
                    if not str(text).strip():
                        continue
                    meta = r.get("metadata") if isinstance(r.get("metadata"), dict) else {}
                    vals = (i, str(text), _number(r.get("importance", meta.get("importance"))), r.get("session_id") or meta.get("session_id"), r.get("persona_id") or meta.get("persona_id"), json.dumps(meta, ensure_ascii=False, sort_keys=True))
                    for col, v in zip(out, vals):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), *(pa.array([None if v is None else str(v) for v in c], pa.string()) for c in out[3:])], names=FIELDS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def write_json(mem: DataFrame, path: str) -> None:
    """One JSON object a line."""
    mem.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; guards against formulas are taken off."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    names = [c.lstrip("﻿") for c in df.columns]
    df = df.toDF(*names)
    return df.select(*[T.csv_unguard(F.col(c)).alias(c) for c in names])


def write_csv(mem: DataFrame, path: str) -> None:
    """CSV with a header; cells that look like formulas are guarded."""
    text = [f.name for f in mem.schema.fields if f.dataType.simpleString() == "string"]
    mem.select(*[T.csv_guard(F.col(c)).alias(c) if c in text else F.col(c) for c in mem.columns]).write.mode("overwrite").csv(path, header=True, escape='"')
