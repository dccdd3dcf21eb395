"""Connected components by alternating large-star and small-star joins.

Each round is two group-and-join steps; labels are the smallest vertex of the component. The minimum
of a vertex's neighbours is an aggregate with map-side combine, so a hub with a third of all edges is
not gathered anywhere. Rounds end when the edge set is a forest of stars; they are bounded by
O(log^2 n), and lineage is cut after each one by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.session import cut, drop_cut


def _star(both: DataFrame, small: bool) -> DataFrame:
    """One star step over directed rows ``(u, v)``; emits rows with v < u.

    Large star: each neighbour above u is tied to the least of u and its neighbours. Small star: u
    and its neighbours below it are tied to the least of them.
    """
    if small:
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u")
        return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    tied = both.where("v > u").join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``vertex, component`` for every vertex of an edge; ``edges`` has columns ``u, v``.

    Loops, repeated edges and nulls are ignored; no edge gives an empty result. The component is the
    least vertex in the order of its type.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both, small=False))
        nxt = cut(_star(large, small=True))
        # order-free fingerprint of the edge set, equal rounds mean stars everywhere
        now = nxt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_cut(large)
        drop_cut(e)
        e = nxt
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(e.select(F.col("v"), F.col("v")).distinct())
