"""Rebuilding conversations from message rows.

Steps: (1) rows that lack a session are tied to each other by the reply and quote links of their
metadata; the components of these links (large-star / small-star) are conversations without an
identifier, and take a session if a link leads to one; (2) copies collapse; (3) a conversation is
validated as a whole; (4) its turns are numbered.

Only links between two rows without a session enter the star rounds, so a quote between two sessions
ties nothing together and a session with a third of all rows is no vertex. A row's own links to
sessions count first (its reply, that is the least target); a row without one takes the session that most
links of its component lead to, of equal ones the least. A component that reaches no session becomes a
conversation of its own, ``links:`` and its least id.

Order: turns are numbered through hours and minutes (counts per bucket, running sums over buckets, a rank
inside one minute), so one huge session or one busy hour is not sorted in a single task.

Null or unreadable metadata has no links; links to rows that don't exist count as none; a row without a
session and links belongs to no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.components import connected_components
from engramlake.session import cut

# Spellings of the four roles.
ROLE_WORDS = {
    "user": ["user", "human", "member", "customer", "person", "usr"],
    "assistant": ["assistant", "bot", "ai", "model", "agent", "chatbot", "memory-bot"],
    "system": ["system", "sys", "developer"],
    "tool": ["tool", "function", "tool_call", "tool_result", "plugin"],
}
# Metadata keys that name the row a message answers or quotes.
LINK_KEYS = ["reply_to", "reply_to_id", "in_reply_to", "reply_id", "quote", "quote_id", "quoted_id"]
BLANK = "[\\s\\p{Z}\\p{C}]+"


def role_of(role: Column) -> Column:
    """One of the four roles, or null; case, blanks and synonyms do not matter."""
    word = F.lower(F.regexp_replace(role, BLANK, ""))
    out = F.lit(None).cast("string")
    for name, words in ROLE_WORDS.items():
        out = F.when(word.isin(words), F.lit(name)).otherwise(out)
    return out


def millis_of(ts: Column) -> Column:
    """Epoch milliseconds of a time in seconds or (above 1e11) milliseconds; null stays null."""
    ok = ts.isNotNull() & ~F.isnan(ts)
    return F.when(ok, F.round(F.when(ts > 1e11, ts).otherwise(ts * 1000.0)).cast("long"))


def _links(messages: DataFrame) -> DataFrame:
    """``id, target`` of the reply and quote links in the metadata."""
    keys = F.array(*[F.get_json_object("metadata", f"$.{k}").try_cast("long") for k in LINK_KEYS])
    has = F.lit(False)
    for k in ("reply", "quote"):
        has = has | F.contains("metadata", F.lit(k))
    return messages.where(has).select("id", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("target")).distinct()


def attach_sessions(messages: DataFrame) -> DataFrame:
    """Fills ``session_id`` of rows without one from the links of their component."""
    links = _links(messages)
    of = messages.where("id is not null").groupBy("id").agg(F.min("session_id").alias("s"))
    ends = links.join(of, "id").withColumnRenamed("s", "s_own").join(of.select(F.col("id").alias("target"), F.col("s").alias("s_to")), "target")
    ends = cut(ends.select("id", "target", "s_own", "s_to"))
    loose = ends.where("s_own is null and s_to is null")
    comp = connected_components(loose.select(F.col("id").alias("u"), F.col("target").alias("v")))
    # links between a row without a session and one with: from either side
    tied = ends.where("s_own is null and s_to is not null").select("id", "target", F.col("s_to").alias("s")).unionAll(ends.where("s_own is not null and s_to is null").select(F.col("target"), F.col("id"), F.col("s_own")))
    own = tied.groupBy("id").agg(F.min_by("s", F.struct("target", "s")).alias("own"))
    votes = tied.join(comp.withColumnRenamed("vertex", "id"), "id").groupBy("component", "s").agg(F.count(F.lit(1)).alias("n"))
    most = votes.groupBy("component").agg(F.min_by("s", F.struct(-F.col("n"), "s")).alias("most"))
    all_ = comp.withColumnRenamed("vertex", "id").join(most, "component", "left").join(own, "id", "full_outer")
    found = all_.select("id", F.coalesce("own", "most", F.concat(F.lit("links:"), F.col("component").cast("string"))).alias("found_session"))
    lost = messages.where("session_id is null").join(found, "id", "left").withColumn("session_id", F.col("found_session")).drop("found_session")
    return messages.where("session_id is not null").unionByName(lost)


def turns(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, turn_no, message_id, role, content, at_ms`` of every kept conversation: those of
    ``sessions`` and those that links alone make.

    Dropped whole: a conversation with a row without a time or a known role, with a blank answer of
    the assistant, with nothing left, or not beginning with the user and ending with the assistant.
    """
    m = attach_sessions(messages.select("id", "session_id", "role", "content", "sender_id", "timestamp", "metadata"))
    m = m.where("session_id is not null")
    known = sessions.select("session_id").where("session_id is not null").distinct().withColumn("known", F.lit(True))
    m = m.join(known, "session_id", "left").where("known or startswith(session_id, 'links:')").drop("known")
    m = m.select("id", "session_id", "sender_id", role_of(F.col("role")).alias("role"), millis_of(F.col("timestamp")).alias("at_ms"), "content")
    m = m.groupBy("session_id", "sender_id", "at_ms", "role", "content").agg(F.min("id").alias("message_id"))
    m = m.withColumn("blank", F.length(F.regexp_replace(F.coalesce("content", F.lit("")), BLANK, "")) == 0)
    spoken = ~F.col("blank") & F.col("role").isin("user", "assistant")
    key = F.when(spoken, F.struct("at_ms", "message_id"))
    verdict = m.groupBy("session_id").agg(
        F.bool_or(F.col("at_ms").isNull() | F.col("role").isNull() | (F.col("blank") & (F.col("role") == "assistant"))).alias("broken"),
        F.min_by("role", key).alias("first_role"), F.max_by("role", key).alias("last_role"),
    )
    good = verdict.where("not coalesce(broken, true) and first_role = 'user' and last_role = 'assistant'").select("session_id")
    kept = m.where(spoken).join(good, "session_id", "left_semi").withColumn("hour", F.floor(F.col("at_ms") / 3_600_000)).withColumn("minute", F.floor(F.col("at_ms") / 60_000))
    per = kept.groupBy("session_id", "hour", "minute").agg(F.count(F.lit(1)).alias("n"))
    before = lambda keys, by: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = per.select("session_id", "hour", "minute", before(["session_id", "hour"], "minute").alias("m0"))
    hours = per.groupBy("session_id", "hour").agg(F.sum("n").alias("n")).select("session_id", "hour", before(["session_id"], "hour").alias("h0"))
    base = minutes.join(hours, ["session_id", "hour"]).select("session_id", "minute", (F.col("m0") + F.col("h0")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("session_id", "minute").orderBy("at_ms", "message_id"))
    return kept.withColumn("rank", rank).join(base, ["session_id", "minute"]).select("session_id", (F.col("base") + F.col("rank")).cast("long").alias("turn_no"), "message_id", "role", "content", "at_ms")
