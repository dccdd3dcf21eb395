"""Memories: reading, filters, projections and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.config import DAY
from engramlake.functions import text as T
from engramlake.tables import spread, table


def meta_text(meta: Column, key: str) -> Column:
    """A key of a JSON text as string; null if the text is no valid JSON."""
    return F.try_variant_get(F.try_parse_json(meta), f"$.{key}", "string")


def meta_number(meta: Column, key: str) -> Column:
    """A finite number, or null."""
    v = meta_text(meta, key).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 1.7e308), v)


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the metadata keys as typed columns and their defaults; broken JSON means defaults."""
    m = F.col("metadata")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("memory_id"), "text", "session_id", "persona_id", "source", "lang",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(meta_number(m, "importance"), F.lit(0.5)))).alias("importance"),
        (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("create_time"),
        F.coalesce(meta_number(m, "last_access_time"), F.lit(0.0)).alias("last_access_time"),
        F.least(F.lit(1_000_000), F.greatest(F.lit(0), F.floor(F.coalesce(meta_number(m, "access_count"), F.lit(0.0))))).cast("long").alias("access_count"),
        F.coalesce(F.nullif(meta_text(m, "status"), F.lit("")), F.lit("active")).alias("status"),
        F.coalesce(meta_text(m, "memory_type"), F.lit("GENERAL")).alias("memory_type"), meta_text(m, "kind").alias("kind"),
    )


def active(mem: DataFrame) -> DataFrame:
    return mem.where(F.coalesce(F.nullif("status", F.lit("")), F.lit("active")) == "active")


def scoped(mem: DataFrame, session_id: str | None = None, persona_id: str | None = None) -> DataFrame:
    """Equality scope; None filters nothing."""
    for name, value in (("session_id", session_id), ("persona_id", persona_id)):
        if value is not None:
            mem = mem.where(F.col(name) == value)
    return mem


def list_page(mem: DataFrame, session: str | None = None, keyword: str | None = None, status: str | None = None, sort: str = "create_time", page: int = 1, size: int = 20) -> DataFrame:
    """One page with its total; a keyword matches ASCII-case-blind, digits also match the id."""
    df = scoped(mem, session)
    if keyword:
        up, lo = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        hit = F.contains(F.translate("text", up, lo), F.lit(keyword.translate(str.maketrans(up, lo))))
        df = df.where(hit | (F.col("memory_id") == int(keyword)) if keyword.isdigit() else hit)
    if status:
        df = df.where(F.col("status") == status)
    size = max(1, min(500, size))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    shown = df.orderBy(F.desc(sort), F.asc("memory_id")).offset((page - 1) * size).limit(size)
    return shown.crossJoin(total).withColumn("has_more", F.col("total") > page * size)


def statistics(mem: DataFrame) -> DataFrame:
    """One row: counts by status, mean importance, oldest and newest."""
    return mem.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") == "archived").alias("n_archived"),
        F.count_if(~F.col("status").isin("active", "archived")).alias("n_other"), F.countDistinct("session_id").alias("n_sessions"),
        F.round(F.avg("importance"), 6).alias("avg_importance"), F.round(F.min("create_time"), 3).alias("oldest"), F.round(F.max("create_time"), 3).alias("newest"),
    )


def importance_histogram(mem: DataFrame) -> DataFrame:
    b = F.least(F.lit(9), F.floor(F.col("importance") * 10)).cast("long")
    return mem.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_sessions(mem: DataFrame, n: int = 10) -> DataFrame:
    return mem.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "session_id").limit(n)


def importance_display(c: Column) -> Column:
    """0..1 shown as 0..10; larger values are clamped."""
    v = F.when(c <= 1, c * 10).otherwise(c)
    return F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), v)), 2)


def cleanup_candidates(mem: DataFrame, as_of: float, days: float = 30, below: float = 0.3) -> DataFrame:
    """Active, old and unimportant; negative days select nothing."""
    return active(mem).where(F.lit(days >= 0) & (F.lit(as_of) - F.col("create_time") > days * DAY) & (F.col("importance") < below))


def consolidation_candidates(mem: DataFrame, as_of: float, days: float = 7, below: float = 0.5) -> DataFrame:
    return active(mem).where((F.col("importance") < below) & (F.col("create_time") < as_of - days * DAY))


def facts_of(c: Column, most: int = 5) -> Column:
    """Lines or parts of a summary that stand for its key facts."""
    parts = F.transform(F.split(c, "\n| \\| |；"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: s != ""), 1, most)


def storage_format(summary: Column, facts: Column) -> Column:
    """Summary and its first five facts in one line."""
    return F.when(F.size(facts) > 0, F.concat_ws(" | ", summary, F.array_join(F.slice(facts, 1, 5), "；"))).otherwise(summary)


def display_content(content: Column, facts: Column, persona_summary: Column) -> Column:
    """The persona's summary, else the content without its exact facts suffix."""
    tail = F.concat(F.lit(" | "), F.array_join(F.slice(facts, 1, 5), "；"))
    cut = F.when((F.size(facts) > 0) & F.endswith(content, tail), F.left(content, F.length(content) - F.length(tail))).otherwise(content)
    return F.coalesce(F.nullif(F.trim(persona_summary), F.lit("")), cut)


def quality_label(summary: Column, facts: Column, importance: Column, generic: str = r"(?i)^(chat|talk|conversation|聊天|对话)$") -> Column:
    low = (F.length(F.coalesce(summary, F.lit(""))) < 10) | (F.size(facts) < 1) | importance.isNull() | (importance < 0) | (importance > 1) | F.coalesce(summary.rlike(generic), F.lit(False))
    return F.when(low, "low").otherwise("normal")


def resolve_scope(mode: str, session: Column, user_key: Column) -> Column:
    """isolated and session: the session; user: the user's key; global: none."""
    if mode in ("isolated", "session"):
        return session
    return F.coalesce(user_key, session) if mode == "user" else F.lit(None).cast("string")


def allowed(sender: Column, platform: Column, session: Column, group: Column, allow: list[str], enabled: bool = True) -> Column:
    """Whether any identity of a row is on the list; an enabled empty list denies all."""
    if not enabled:
        return F.lit(True)
    low = [a.casefold() for a in allow]
    cands = F.transform(F.array_compact(F.array(sender, session, group, F.concat_ws(":", platform, sender))), lambda c: F.lower(c))
    return F.arrays_overlap(cands, F.array(*map(F.lit, low))) if low else F.lit(False)


def resolve_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``identity``: by platform and id, else by id, else by name (``aliases(alias, identity)``)."""
    out = rows
    for i, key in enumerate((F.concat_ws(":", "platform", "sender_id"), F.col("sender_id"), F.col("sender_name"))):
        a = aliases.groupBy(F.lower("alias").alias(f"_a{i}")).agg(F.min("identity").alias(f"_i{i}"))  # spellings of one alias: the least identity
        out = out.join(a, F.lower(key) == F.col(f"_a{i}"), "left").drop(f"_a{i}")
    return out.withColumn("identity", F.coalesce("_i0", "_i1", "_i2", "sender_id")).drop("_i0", "_i1", "_i2")


def policy_filter(hits: DataFrame, min_importance: float = 0.0, min_similarity: float = 0.0, event_only: bool = False) -> DataFrame:
    """Importance; similarity where a vector score exists; kinds of events, rows without a kind stay."""
    keep = F.col("importance") >= min_importance
    keep &= F.col("vec_score").isNull() | (F.col("vec_score") >= min_similarity)
    if event_only:
        keep &= F.col("atom_types").isNull() | (F.size("atom_types") == 0) | F.arrays_overlap("atom_types", F.array(*map(F.lit, ("episodic", "planned", "factual"))))
    return hits.where(keep)


def render_lines(mem: DataFrame) -> DataFrame:
    """One prompt line for each memory."""
    line = F.format_string("- [%s] (%.2f) %s", F.coalesce("memory_type", F.lit("GENERAL")), "importance", T.history_text(F.coalesce("text", F.lit(""))))
    return mem.select("memory_id", line.alias("line"))


def token_frequency(mem: DataFrame) -> DataFrame:
    return spread(mem).select(F.explode_outer(T.tokens(F.col("text"))).alias("token")).where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def latest_sources(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Upsert: the row with the greatest sequence wins."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
