"""Items that appear together: basket collapsing with exact pruning.

Method: the deduplicated items of a record become a sorted array, identical arrays collapse into one
basket with a weight, pairs are enumerated once per distinct basket and the weights are summed.

Scale: two prunings are exact and come before any basket is built. An item below the minimum support
can be in no reported pair; an item in more than ``N / min_lift`` records can't either, since
``n(a,b) <= n(b)`` gives a lift of at most ``N / n(a)``. So the hottest items never reach the pair
stage where a lift is asked for; without thresholds every pair comes out. A record with more than ``wide`` items isn't collapsed: its items are spread over blocks and
pairs are made block against block, so no task holds a whole wide record.

Nulls: links with a null or unknown record or item are ignored; repeated links count once. Empty
tables give an empty result. Extra columns are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.session import cut

BASKET_WIDE = 64


def clean_links(links: DataFrame, records: DataFrame, items: DataFrame, rec: str, item: str, record_id: str = "id", item_id: str = "id") -> DataFrame:
    """Distinct ``(rec, item)`` links whose both ends exist."""
    k = links.select(F.col(rec).cast("long").alias("rec"), F.col(item).cast("long").alias("item"))
    k = k.where("rec is not null and item is not null").distinct()
    k = k.join(records.select(F.col(record_id).alias("rec")).distinct(), "rec", "left_semi")
    return k.join(items.select(F.col(item_id).alias("item")).distinct(), "item", "left_semi")


def _pairs_within(arr: Column) -> Column:
    """All ``(a, b)`` of a sorted array with a before b."""
    n = F.size(arr)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.slice(arr, i + F.lit(1), n), lambda b: F.struct(F.element_at(arr, i.cast("int")).alias("a"), b.alias("b")))))


def pair_counts(links: DataFrame, min_support: int = 5, min_lift: float = 10.0, wide: int = BASKET_WIDE) -> DataFrame:
    """``a, b, n_ab, n_a, n_b, n`` of all pairs that reach the support and the lift.

    ``links`` comes from :func:`clean_links`; they, the item counts and the links that are left are written to the
    shared folder, so nothing is derived twice. ``min_lift <= 1`` switches the upper pruning off;
    with ``min_support=1`` and ``min_lift=0`` all pairs that occur together come out.
    """
    links = cut(links)  # written once, read for the counts, the total and the baskets
    n_items = links.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    total = links.agg(F.countDistinct("rec").alias("n"))  # one row
    kept = n_items.crossJoin(F.broadcast(total)).where(F.col("n_item") >= min_support)
    if min_lift > 1:
        kept = kept.where(F.col("n_item") * F.lit(float(min_lift)) <= F.col("n"))
    kept = cut(kept)
    live = links.join(kept.select("item"), "item", "left_semi")

    # the widths come first, so that a wide record is never gathered whole
    width = live.groupBy("rec").agg(F.count(F.lit(1)).alias("w"))
    live = cut(live.join(width.where("w > 1"), "rec"))
    narrow = live.where(F.col("w") <= wide).groupBy("rec").agg(F.sort_array(F.collect_list("item")).alias("basket"))
    baskets = narrow.groupBy("basket").agg(F.count(F.lit(1)).alias("weight"))
    some = baskets.select("weight", F.explode(_pairs_within(F.col("basket"))).alias("p")).select("p.a", "p.b", "weight")

    blocks = live.where(F.col("w") > wide).withColumn("blk", F.pmod(F.xxhash64("item"), F.ceil(F.col("w") / F.lit(wide)).cast("long")))
    blocks = blocks.groupBy("rec", "blk").agg(F.collect_list("item").alias("part"))
    left, right = blocks.select("rec", F.col("blk").alias("i"), F.col("part").alias("p")), blocks.select("rec", F.col("blk").alias("j"), F.col("part").alias("q"))
    met = left.join(right, "rec").where("i <= j").select("i", "j", F.explode("p").alias("x"), "q").select("i", "j", "x", F.explode("q").alias("y"))
    met = met.where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    more = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(1).cast("long").alias("weight"))

    pairs = some.unionByName(more).groupBy("a", "b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_support)
    out = pairs.join(kept.select(F.col("item").alias("a"), F.col("n_item").alias("n_a"), "n"), "a").join(kept.select(F.col("item").alias("b"), F.col("n_item").alias("n_b")), "b")
    return out.where(F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")).select("a", "b", "n_ab", "n_a", "n_b", "n")


def scored_pairs(counts: DataFrame) -> DataFrame:
    """Adds expected count, lift and conviction (a => b; null where b always follows a)."""
    n = F.col("n").cast("double")
    conf = F.col("n_ab") / F.col("n_a")
    return counts.select(
        F.col("a").alias("node_a"), F.col("b").alias("node_b"), "n_ab", "n_a", "n_b",
        F.round(F.col("n_a") * F.col("n_b") / n, 6).alias("expected"),
        F.round(F.col("n_ab") * n / (F.col("n_a") * F.col("n_b")), 6).alias("lift"),
        F.when(conf < 1, F.round((1 - F.col("n_b") / n) / (1 - conf), 6)).alias("conviction"),
    )
