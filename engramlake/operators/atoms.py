"""Memory atoms: making, classification, search, ageing, reinforcement, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.config import ATOM_STATUSES, DAY
from engramlake.functions import temporal
from engramlake.functions import text as T


def current(atoms: DataFrame) -> DataFrame:
    """One row for each id: the latest delivery (last access, then reinforcement, then content)."""
    inf = F.lit(float("inf"))
    order = F.struct(F.coalesce(-F.col("last_accessed_at"), inf), F.coalesce(-F.col("reinforcement_count").cast("double"), inf), F.col("content").isNull(), "content")
    cols = [c for c in atoms.columns if c != "id"]
    return atoms.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*cols), order).alias("_a")).select("id", "_a.*")


def atomise(mem: DataFrame, as_of: float) -> DataFrame:
    """One atom for each fact: class, confidence, days to live, and the memory's topics and participants as entities.

    ``mem`` has memory_id, facts, importance and may have topics and participants (arrays; null: none).
    Only plans have a time of the event.
    """
    none = F.array().cast("array<string>")
    ents = F.concat(*[F.coalesce(c, none) if c in mem.columns else none for c in ("topics", "participants")])
    a = mem.select("memory_id", "importance", ents.alias("entities"), F.posexplode("facts").alias("pos", "content")).where("trim(content) <> ''").withColumn("content", F.trim("content"))
    a = a.withColumn("atom_type", temporal.classify(F.col("content"))).withColumn("confidence", temporal.class_confidence(F.col("atom_type")))
    event = F.datediff(temporal.relative_date(F.col("content"), as_of), F.to_date(F.timestamp_seconds(F.lit(as_of)))).cast("double")
    ttl = temporal.atom_ttl(F.col("atom_type"), F.col("importance"), F.lit(0), event)
    return a.withColumn("ttl_days", F.round(ttl, 6)).withColumn("decay_type", temporal.decay_kind(F.col("atom_type")))


def decayed(atoms: DataFrame, as_of: float) -> DataFrame:
    """``id, temporal_score``."""
    days = (F.lit(as_of) - F.coalesce("last_accessed_at", "created_at", F.lit(as_of))) / DAY
    return atoms.select("id", F.round(temporal.decay_score(F.coalesce("decay_type", F.lit("exponential")), days, F.coalesce("ttl_days", F.lit(30.0))), 6).alias("temporal_score"))


def counts(atoms: DataFrame) -> DataFrame:
    """Atoms by status; every known status has a row."""
    spark = atoms.sparkSession
    names = spark.createDataFrame([(s,) for s in ATOM_STATUSES], "status string")
    got = atoms.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return names.join(got, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def lifecycle(atoms: DataFrame, as_of: float) -> DataFrame:
    """``id, new_status``: active to expired, to forgotten after 7 days, to purged after 30, in one pass."""
    late = (F.lit(as_of) - F.col("expires_at")) / DAY
    s = F.when((F.col("status") == "active") & (late > 0), "expired").otherwise(F.col("status"))
    s = F.when((s == "expired") & (late > 7), "forgotten").otherwise(s)
    s = F.when((s == "forgotten") & (late > 30), "purged").otherwise(s)
    return atoms.select("id", "status", s.alias("new_status"))


def reinforce(atoms: DataFrame, signals: DataFrame, as_of: float) -> DataFrame:
    """``id, confidence, count, ttl_days`` after ordered signals (``id, seq, confidence``), in closed form."""
    w = Window.partitionBy("id")
    s = signals.withColumn("_n", F.row_number().over(w.orderBy("seq"))).withColumn("_k", F.count(F.lit(1)).over(w))
    add = s.groupBy("id").agg(F.max("_k").alias("k"), F.sum(0.3 * F.col("confidence") * F.pow(F.lit(0.7), F.col("_k") - F.col("_n"))).alias("add"))
    j = atoms.select("id", "atom_type", "importance", F.col("confidence").alias("c0"), "reinforcement_count").join(add, "id")
    n = F.coalesce("reinforcement_count", F.lit(0)) + F.col("k")
    ttl = temporal.atom_ttl(F.col("atom_type"), F.coalesce("importance", F.lit(0.5)), n, F.lit(None).cast("double"))
    return j.select("id", F.round(F.col("c0") * F.pow(F.lit(0.7), "k") + F.col("add"), 6).alias("confidence"), n.alias("reinforcements"), F.round(ttl, 6).alias("ttl_days"))


def search(scores: DataFrame, atoms: DataFrame, as_of: float, k: int = 10) -> DataFrame:
    """Normalised BM25 of the atoms times their temporal score."""
    from engramlake.operators.retrieval import minmax, top

    live = atoms.where("status = 'active'")
    j = minmax(top(scores.join(live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), 5 * k)).drop("rank")
    j = j.join(decayed(live, as_of).withColumnRenamed("id", "doc_id"), "doc_id").withColumn("score", F.col("score") * F.col("temporal_score"))
    return top(j, k).select("query_id", "doc_id", "score", "rank")


def duplicates(new: DataFrame, old: DataFrame, at_least: float = 0.8) -> DataFrame:
    """New atoms and old atoms of one parent that say the same (Jaccard); they meet by parent."""
    a = new.select(F.col("id").alias("new_id"), F.col("parent_memory_id").alias("p"), F.col("content").alias("x"))
    b = old.select(F.col("id").alias("old_id"), F.col("parent_memory_id").alias("p"), F.col("content").alias("y"))
    j = a.join(b, "p").where("new_id <> old_id").withColumn("similarity", F.round(T.text_similarity(F.col("x"), F.col("y")), 6))
    return j.where(F.col("similarity") >= at_least).select("new_id", "old_id", "similarity")
