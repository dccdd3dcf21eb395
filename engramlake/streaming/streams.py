"""Structured Streaming forms of the online behaviours, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("dedup_key", F.sha1(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])))


def dedup_stream(events: DataFrame, keys: list[str], ts: str = "ts", within: str = "300 seconds") -> DataFrame:
    """First row of a key within the watermark; later rows than it are dropped."""
    return dedup_key(events, keys).withWatermark(ts, within).dropDuplicatesWithinWatermark(["dedup_key"])


def dedup_batch(events: DataFrame, keys: list[str], ts: str = "ts", within: float = 300.0) -> DataFrame:
    """Rows whose key was not seen in the ``within`` seconds before, as the stream keeps them."""
    e = dedup_key(events, keys)
    w = Window.partitionBy("dedup_key").orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    return e.withColumn("_g", gap).where(F.col("_g").isNull() | (F.col("_g") > within * 1e6)).drop("_g")


def tumbling(events: DataFrame, ts: str = "ts", size: str = "1 hour", watermark: str | None = "5 minutes") -> DataFrame:
    """Count and sum by window and type; batch or stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming and watermark:
        e = e.withWatermark(ts, watermark)
    g = e.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select((F.unix_micros("w.start") / 1e6).alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, ts: str = "ts", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    g = e.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select((F.unix_micros("w.start") / 1e6).alias("window_start"), "n")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "1 hour", watermark: str | None = "5 minutes") -> DataFrame:
    """Sessions of a key, closed by a gap."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming and watermark:
        e = e.withWatermark(ts, watermark)
    g = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, (F.unix_micros("w.start") / 1e6).alias("started"), (F.unix_micros("w.end") / 1e6).alias("ended"), "n")


def session_state(messages: DataFrame) -> DataFrame:
    """Running state of sessions (count, last time, the exact set of senders), in update mode on a stream."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"), F.array_sort(F.collect_set("sender_id")).alias("senders"))


def captured(messages: DataFrame, groups_only: bool = True, bot_ids: tuple[str, ...] = ("bot",), allow: list[str] | None = None) -> DataFrame:
    """Capture filter: group rows, no echo of the bot, senders on the list."""
    m = messages.where("content is not null and trim(content) <> ''").where(~F.coalesce(F.col("sender_id").isin(*bot_ids), F.lit(False)))
    if groups_only:
        m = m.where("group_id is not null")
    return m if allow is None else m.where(F.lower("sender_id").isin(*[a.lower() for a in allow]))


def summary_triggers(messages: DataFrame, every: int = 10) -> DataFrame:
    """``session_id, start, end`` whenever ``every`` rounds (two rows each) wait; state: rows and cursor."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else (0, 0)
        seen += sum(len(b) for b in batches)
        out = []
        while (seen - done) // 2 >= every:
            out.append((key[0], done, done + 2 * every))
            done += 2 * every
        state.update((seen, done))
        yield pd.DataFrame(out, columns=["session_id", "start", "end"])

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, start long, end long", "seen long, done long", "append", GroupStateTimeout.NoTimeout)
