"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "pos") -> DataFrame:
    """Adds ``name``: 1-based row numbers by ``order`` within ``keys``.

    ``bucket`` must not decrease along the order. Rows are numbered inside a bucket; counts per bucket
    are summed along the group, so a group with a third of all rows is spread over tasks. Keys and
    buckets may be null.
    """
    b = df.withColumn("_b", bucket)
    n = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = n.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bb"), "_base")
    inside = b.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    on = inside["_b"].eqNullSafe(base["_bb"])
    for i, k in enumerate(keys):
        on = on & inside[k].eqNullSafe(base[f"_k{i}"])
    return inside.join(base, on).withColumn(name, F.col("_base") + F.col("_r")).drop("_b", "_bb", "_base", "_r", *[f"_k{i}" for i in range(len(keys))])


def chunks(df: DataFrame, keys: list[str], pos: str = "pos", size: int = 5000, rim: int = 1) -> tuple[DataFrame, Window]:
    """Rows dealt to chunks of their group by position, and the window over a chunk in order of position.

    The last ``rim`` rows of a chunk also stand, with ``_own`` false, before the next one, so that a look
    back of up to ``rim`` rows is right and no group is ordered in one task. Filter on ``_own`` afterwards.
    """
    at = F.floor((F.col(pos) - 1) / size)
    near_end = (F.col(pos) - 1) % size >= size - rim
    homes = F.when(near_end, F.array(F.struct(at.alias("c"), F.lit(True).alias("own")), F.struct((at + 1).alias("c"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("c"), F.lit(True).alias("own"))))
    out = df.withColumn("_h", F.explode(homes)).withColumn("_c", F.col("_h.c")).withColumn("_own", F.col("_h.own")).drop("_h")
    return out, Window.partitionBy(*keys, "_c").orderBy(pos)
