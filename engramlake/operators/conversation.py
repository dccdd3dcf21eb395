"""Messages and sessions in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import temporal
from engramlake.functions import text as T
from engramlake.operators.ranks import bucketed_rank, chunks


def clean(messages: DataFrame) -> DataFrame:
    """One row for each id, with ``at`` in seconds and a trimmed lower-case role."""
    m = messages.withColumn("at", temporal.epoch_seconds(F.col("timestamp"))).withColumn("role", F.lower(F.trim("role")))
    cols = [c for c in m.columns if c != "id"]
    return m.where("id is not null").groupBy("id").agg(F.min(F.struct(*cols)).alias("m")).select("id", "m.*")


def last_n(messages: DataFrame, n: int = 5, sender: str | None = None) -> DataFrame:
    """The last n messages of each session, numbered in ascending order."""
    if sender is not None:
        messages = messages.where(F.col("sender_id") == sender)
    w = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("at"), F.desc("id"))
    m = messages.where("session_id is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    up = Window.partitionBy("session_id").orderBy(F.desc("r"))
    return m.withColumn("pos", F.row_number().over(up)).drop("r")


def slice_of(messages: DataFrame, offset: int, limit: int) -> DataFrame:
    """Messages offset..offset+limit of each session, by time."""
    m = bucketed_rank(messages.where("session_id is not null"), ["session_id"], F.floor(F.col("at") / 3600), [F.asc_nulls_first("at"), "id"])
    return m.withColumn("pos", F.col("pos") - 1).where((F.col("pos") >= offset) & (F.col("pos") < offset + limit))


def search(messages: DataFrame, keyword: str) -> DataFrame:
    """Messages that hold a keyword, ASCII-case-blind, wildcards literal."""
    up, lo = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return messages.where(F.contains(F.translate("content", up, lo), F.lit(keyword.translate(str.maketrans(up, lo)))))


def recent_sessions(sessions: DataFrame, n: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc_nulls_last("last_active_at"), "session_id").limit(n)


def user_counts(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user' and sender_id is not null").groupBy("sender_id").agg(F.count(F.lit(1)).alias("n"))


def reconcile(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions whose recorded count differs from their rows."""
    n = messages.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    j = sessions.select("session_id", "message_count").join(n, "session_id", "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return j.where("message_count is null or message_count <> actual").select("session_id", F.col("message_count").alias("recorded"), "actual")


def activity(messages: DataFrame) -> DataFrame:
    """Session state from its rows: count, first and last time, distinct senders."""
    return messages.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("at"), 3).alias("first_at"), F.round(F.max("at"), 3).alias("last_at"), F.countDistinct("sender_id").alias("n_senders"))


def cursor(sessions: DataFrame) -> DataFrame:
    """``session_id, last_summarized_index`` from the metadata; broken JSON means 0."""
    v = F.try_variant_get(F.try_parse_json("metadata"), "$.last_summarized_index", "string").try_cast("double")
    return sessions.select("session_id", "message_count", F.coalesce(F.floor(v), F.lit(0)).cast("long").alias("cursor"))


def reset_cursor(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """A cursor beyond the rows goes back to 0."""
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    j = cursor(sessions).join(n, "session_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("session_id", "cursor", F.when(F.col("cursor") > F.col("n"), 0).otherwise(F.col("cursor")).alias("new_cursor"))


def trim(messages: DataFrame, sessions: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Deletes the oldest min(n, cursor) rows of each session and moves the cursor back."""
    c = cursor(sessions).select("session_id", "cursor")
    m = bucketed_rank(messages.where("session_id is not null"), ["session_id"], F.floor(F.col("at") / 3600), [F.asc_nulls_first("at"), "id"]).join(c, "session_id", "left")
    cut = F.least(F.lit(n), F.coalesce("cursor", F.lit(0)))
    return m.where(F.col("pos") > cut).drop("pos", "cursor"), c.select("session_id", (F.col("cursor") - F.least(F.lit(n), F.col("cursor"))).alias("cursor"))


def expired(sessions: DataFrame, as_of: float, ttl: float) -> DataFrame:
    """Sessions idle for longer than ``ttl`` seconds."""
    return sessions.where(F.coalesce("last_active_at", "created_at", F.lit(0.0)) < as_of - ttl).select("session_id")


def purge(sessions: DataFrame, messages: DataFrame, as_of: float, ttl: float) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages that stay when idle sessions go; messages of no session stay."""
    gone = expired(sessions, as_of, ttl).where("session_id is not null").distinct()
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def by_time(messages: DataFrame) -> DataFrame:
    """Adds ``pos``: numbers of a session's messages by time, then id; null times first."""
    return bucketed_rank(messages.where("session_id is not null"), ["session_id"], F.floor(F.col("at") / 3600), [F.asc_nulls_first("at"), "id"])


def rounds(messages: DataFrame, most: int = 60_000, cut: int = 30_000, size: int = 5000) -> DataFrame:
    """``session_id, id, text, was_cut``: a user row and the assistant row right after it, as one text.

    Pairs of over ``most`` characters are left out; a part of over ``cut`` is cut, which ``was_cut`` tells.
    """
    m, w = chunks(by_time(messages), ["session_id"], size=size, rim=1)
    m = m.withColumn("r0", F.lag("role").over(w)).withColumn("c0", F.lag("content").over(w)).withColumn("i0", F.lag("id").over(w)).where("_own and role = 'assistant' and r0 = 'user'")
    n = [F.length(F.coalesce(x, F.lit(""))) for x in ("c0", "content")]
    c = lambda x: T.truncate(F.coalesce(x, F.lit("")), cut)
    text = F.concat(F.lit("user: "), c(F.col("c0")), F.lit("\nassistant: "), c(F.col("content")))
    return m.where(n[0] + n[1] <= most).select("session_id", F.col("i0").alias("id"), text.alias("text"), ((n[0] > cut) | (n[1] > cut)).alias("was_cut"))


def with_context(messages: DataFrame, within: float = 7200.0, before: int = 4, size: int = 5000) -> DataFrame:
    """``id, expanded``: each message after the up to ``before`` messages right before it that are at most
    ``within`` seconds older and not blank, oldest first, joined by bars. A null time gives and takes no context."""
    m, w = chunks(by_time(messages), ["session_id"], size=size, rim=before)
    prev = F.array(*[F.struct(F.lag("content", k).over(w).alias("c"), F.lag("at", k).over(w).alias("t")) for k in range(before, 0, -1)])
    m = m.withColumn("_p", prev).where("_own")
    fit = F.filter("_p", lambda x: (F.trim(x["c"]) != "") & (F.col("at") - x["t"] <= within))
    parts = F.transform(fit, lambda x: F.trim(x["c"]))
    own = F.coalesce("content", F.lit(""))
    return m.select("id", F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " | "), F.lit(" "), own)).otherwise(own).alias("expanded"))


def context_lines(messages: DataFrame) -> DataFrame:
    """``session_id, pos, line``: every message as a line; group rows name the speaker, id and time."""
    who = F.concat(F.lit("["), F.when(F.col("role") == "assistant", "Bot: ").otherwise(""), F.coalesce("sender_name", "sender_id", F.lit("?")), F.lit(" | "), F.coalesce("sender_id", F.lit("?")), F.lit(" | "), F.coalesce(F.date_format(F.timestamp_seconds(F.floor("at")), "yyyy-MM-dd HH:mm"), F.lit("?")), F.lit("] "))
    line = F.concat(F.when(F.col("group_id").isNotNull(), who).otherwise(F.concat(F.coalesce("role", F.lit("?")), F.lit(": "))), F.coalesce("content", F.lit("")))
    return by_time(messages).select("session_id", "pos", line.alias("line"))


def transcripts(messages: DataFrame, lines: int = 200) -> DataFrame:
    """``session_id, part, text``: all lines of each session in order, ``lines`` to a part, so that no session is gathered whole."""
    c = context_lines(messages).withColumn("part", F.floor((F.col("pos") - 1) / lines))
    return c.groupBy("session_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def time_tags(messages: DataFrame) -> DataFrame:
    """First and last day, and the number of distinct days, of each session."""
    d = F.to_date(F.timestamp_seconds("at"))
    return messages.where("session_id is not null and at is not null").groupBy("session_id").agg(F.min(d).cast("string").alias("first_day"), F.max(d).cast("string").alias("last_day"), F.countDistinct(d).alias("n_days"))


def identities(messages: DataFrame) -> DataFrame:
    """One row for each platform and sender: last name, number of names, whether it is the bot."""
    key = F.concat_ws(":", "platform", "sender_id")
    m = messages.where("sender_id is not null")
    return m.groupBy(key.alias("identity")).agg(F.max_by("sender_name", F.when(F.col("sender_name").isNotNull(), F.struct("at", "id"))).alias("last_name"), F.countDistinct("sender_name").alias("n_names"), F.coalesce(F.bool_or(F.col("role") == "assistant"), F.lit(False)).alias("is_bot"))


def summary_window(sessions: DataFrame, messages: DataFrame, every: int = 10) -> DataFrame:
    """Pending range of each session and whether enough rounds wait (two rows a round)."""
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    j = cursor(sessions).join(n, "session_id", "left").withColumn("end", F.coalesce("n", F.lit(0)))
    start = F.when(F.col("cursor") > F.col("end"), 0).otherwise(F.col("cursor"))
    return j.select("session_id", start.alias("start"), "end", (F.floor((F.col("end") - start) / 2) >= every).alias("due"))
