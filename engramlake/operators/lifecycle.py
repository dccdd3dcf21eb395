"""Maintenance as set-wise steps from one generation of memories to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.config import DAY
from engramlake.functions import text as T


def daily_decay(mem: DataFrame, as_of: float, days: float = 1, rate: float = 0.01, protect: float = 1.0, recent_days: float = 7) -> DataFrame:
    """Importance after ``days``; often and lately used memories fade slower; counts are halved."""
    rate = min(1.0, max(0.0, rate))
    used = F.least(F.lit(1.0), F.col("access_count") / 10)
    fresh = F.when((F.lit(as_of) - F.col("last_access_time")) <= recent_days * DAY, 1.0).otherwise(0.5)
    eff = rate * (1 - 0.5 * used * fresh)
    new = F.greatest(F.lit(0.01), F.round(F.col("importance") * F.pow(1 - eff, F.lit(float(days))), 4))
    on = F.col("importance") < protect
    return mem.withColumn("new_importance", F.when(on, new).otherwise(F.col("importance"))).withColumn("new_access_count", F.when(on, F.floor(F.col("access_count") * 0.5)).otherwise(F.col("access_count")).cast("long"))


def missed_days(last: Column, today: Column) -> Column:
    """Days to catch up before today's own run."""
    return F.greatest(F.lit(0), F.datediff(today, last) - 1)


def touch(mem: DataFrame, access: DataFrame) -> DataFrame:
    """Applies accesses (``memory_id, at``): last access and count, capped at a million."""
    a = access.groupBy("memory_id").agg(F.max("at").alias("_at"), F.count(F.lit(1)).alias("_n"))
    j = mem.join(a, "memory_id", "left")
    return j.withColumn("last_access_time", F.greatest("last_access_time", F.coalesce("_at", F.lit(0.0)))).withColumn("access_count", F.least(F.lit(1_000_000), F.col("access_count") + F.coalesce("_n", F.lit(0)))).drop("_at", "_n")


def set_status(mem: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Archive or restore the given memories."""
    return mem.join(ids.select("memory_id", F.lit(True).alias("_hit")).distinct(), "memory_id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def delete(mem: DataFrame, ids: DataFrame) -> DataFrame:
    return mem.join(ids.select("memory_id"), "memory_id", "left_anti")


def replace(mem: DataFrame, edits: DataFrame) -> DataFrame:
    """New rows (``memory_id, new_id, text``) keep the creation time and name their predecessor."""
    new = mem.drop("text").join(edits.select("memory_id", "new_id", "text"), "memory_id").withColumn("previous_id", F.col("memory_id")).withColumn("memory_id", F.col("new_id")).drop("new_id")
    return mem.join(edits.select("memory_id"), "memory_id", "left_anti").withColumn("previous_id", F.lit(None).cast("long")).unionByName(new)


def push_history(history: Column, entry: Column, most: int = 20) -> Column:
    """A bounded edit history: the newest ``most`` entries."""
    h = F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(entry))
    return F.slice(h, F.greatest(F.lit(1), F.size(h) - most + 1), most)


def consolidation_groups(candidates: DataFrame, at_least: int = 3, most: int = 5) -> DataFrame:
    """Largest groups of candidates of one session."""
    g = candidates.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("first_id"))
    return g.where(F.col("n") >= at_least).orderBy(F.desc("n"), "session_id").limit(most)


def merge_groups(members: DataFrame, most: int = 5) -> DataFrame:
    """Deterministic merger: a group's first ``most`` distinct facts in order, and its sources' count.

    ``members`` has group_key, memory_id, fact. Only the first facts are gathered, by rank.
    """
    once = members.groupBy("group_key", "fact").agg(F.min("memory_id").alias("memory_id"))
    w = Window.partitionBy("group_key").orderBy("memory_id", "fact")
    head = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    text = head.groupBy("group_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "fact"))), lambda x: x["fact"]), "；").alias("text"))
    n = members.groupBy("group_key").agg(F.countDistinct("memory_id").alias("n_sources"), F.min("memory_id").alias("first_id"))
    return text.join(n, "group_key")


def import_key(text: Column, session: Column, persona: Column) -> Column:
    """Key of an imported entry: its content without spare blanks, session and persona."""
    return T.content_key(T.collapse(text), session, persona)


def import_plan(entries: DataFrame, existing: DataFrame, mode: str = "skip") -> DataFrame:
    """``entry_id, action``: insert, or duplicate of the batch or of what exists (skip mode).

    The first entry of a key is an aggregate, so a text that a third of the batch shares is not ordered.
    """
    e = entries.select("entry_id", import_key(F.col("text"), F.col("session_id"), F.col("persona_id")).alias("key"))
    have = existing.select(import_key(F.col("text"), F.col("session_id"), F.col("persona_id")).alias("key")).distinct().withColumn("_have", F.lit(True))
    first = e.groupBy("key").agg(F.min("entry_id").alias("_first")).join(have, "key", "left")
    j = e.join(first, "key")
    act = F.lit("insert") if mode == "allow" else F.when(F.col("_have"), "exists").when(F.col("entry_id") > F.col("_first"), "repeated").otherwise("insert")
    return j.select("entry_id", act.alias("action"))


def import_counts(plan: DataFrame) -> DataFrame:
    """One row of a dry run: entries, those to insert and those left out."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(F.count(F.lit(1)).alias("total"), n("insert").alias("inserted"), n("exists").alias("existing"), n("repeated").alias("repeated"))


def consistency(mem: DataFrame, text_index: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents missing from either index, and index rows without a document."""
    a = mem.where("status = 'active'").select("memory_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    ti, vi = text_index.select("memory_id").distinct(), vectors.select("memory_id").distinct()
    return (
        n(a, "n_active").crossJoin(n(a.join(ti, "memory_id", "left_anti"), "missing_text")).crossJoin(n(a.join(vi, "memory_id", "left_anti"), "missing_vector"))
        .crossJoin(n(ti.join(mem, "memory_id", "left_anti"), "orphan_text")).crossJoin(n(vi.join(mem, "memory_id", "left_anti"), "orphan_vector"))
    )


def rebuild_mode(report: DataFrame, full_above: float = 0.3) -> DataFrame:
    """skip, repair or full, from a consistency report."""
    bad = F.col("missing_text") + F.col("missing_vector") + F.col("orphan_text") + F.col("orphan_vector")
    ratio = bad / F.greatest(F.lit(1), F.col("n_active"))
    return report.withColumn("mode", F.when(bad == 0, "skip").when(ratio > full_above, "full").otherwise("repair"))


def session_suffixes(mem: DataFrame) -> DataFrame:
    """Legacy ids ``a!b!c`` and the suffixes they may be known by."""
    parts = F.split("session_id", "!")
    legacy = mem.where(F.contains("session_id", F.lit("!"))).select("memory_id", "session_id", parts.alias("p"))
    return legacy.select("memory_id", "session_id", F.explode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "!"))).alias("suffix"))


def maintain(mem: DataFrame, as_of: float, days: float = 1, rate: float = 0.01, cleanup_days: float = 30, below: float = 0.3, action: str = "archive") -> DataFrame:
    """The next generation: decay, then archive or delete what has faded."""
    m = daily_decay(mem, as_of, days, rate)
    m = m.withColumn("importance", F.col("new_importance")).withColumn("access_count", F.col("new_access_count")).drop("new_importance", "new_access_count")
    faded = (F.col("status") == "active") & (F.lit(as_of) - F.col("create_time") > cleanup_days * DAY) & (F.col("importance") < below)
    return m.where(~faded) if action == "delete" else m.withColumn("status", F.when(faded, "archived").otherwise(F.col("status")))


def consolidation_status(documents: DataFrame) -> DataFrame:
    """One row: documents merged from others (a list ``consolidated_from``), and archived ones."""
    v = F.try_parse_json("metadata")
    src = F.try_variant_get(v, "$.consolidated_from", "array<variant>")
    status = F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("active"))
    return documents.select(F.coalesce(F.size(src) > 0, F.lit(False)).alias("_c"), (status == "archived").alias("_a")).agg(F.count_if("_c").alias("consolidated"), F.count_if("_a").alias("archived"))
