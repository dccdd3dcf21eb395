"""Filling containers of a fixed capacity, by best fit in stripes.

The documents of a window are dealt into stripes of about ``STRIPE`` documents each by the hash of their
key, so every stripe has the sizes of the whole. A stripe's documents are range-sorted by size (by the
engine, with spill), and one task sweeps over them: each document looks up its successor among the sorted
gaps, the least gap that holds it; where several meet one gap the larger, then the smaller key, ranks
first; the gap moves to what is left; a document without a successor opens a container. That is exact
best-fit decreasing inside a stripe, and stripes need nothing of each other.

The sweeps of all documents in common rounds (range-sorted documents and gaps, conflicts resolved
between tasks, repeated until nothing fits) take a round for each document of a container, so about as many
passes over all data as the smallest documents fit into the largest window. Stripes do the same sweeps
with one exchange; what they lose is the last, partly filled container of each stripe.

A document longer than the capacity fills whole containers of its own and leaves one rest; all others
stay whole. A document without tokens is not placed. Windows with a null or non-positive capacity are
ignored. Nothing but the number of documents comes to the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIPE = 50_000
BUCKETS = 64


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and offset of each document; ``sizes`` descend and are from 1 to the capacity.

    Equal sizes are swept together: a run of documents takes the containers of one gap, last opened first.
    """
    box, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    gaps: dict[int, list[np.ndarray]] = {}  # gap -> containers
    keys: list[int] = []  # gaps in use, sorted
    opened = 0

    def put(gap: int, which: np.ndarray) -> None:
        if gap:
            if gap not in gaps:
                insort(keys, gap)
                gaps[gap] = []
            gaps[gap].append(which)

    run = np.r_[np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]), len(sizes)] if len(sizes) else [0]
    for a, b in zip(run[:-1], run[1:]):
        size = int(sizes[a])
        while a < b:
            k = bisect_left(keys, size)
            if k < len(keys):
                gap = keys[k]
                have = gaps[gap].pop()
                take = have[: b - a]
                if len(take) < len(have):
                    gaps[gap].append(have[len(take) :])
                elif not gaps[gap]:
                    del gaps[gap], keys[k]
            else:
                gap = capacity
                take = np.arange(opened, opened + -(-(b - a) // (capacity // size)))
                opened += len(take)
            n = len(take)
            box[a : a + n], at[a : a + n] = take, capacity - gap
            a += n
            put(gap - size, take)
    return box, at


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by window, stripe and falling size; a stripe is held whole (about ``STRIPE`` rows)."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        cap, stripes, stripe = (t.column(c)[0].as_py() for c in ("cap", "stripes", "stripe"))
        box, at = best_fit(t.column("rest").to_numpy(), cap)
        out = t.select(["window_name", "key", "n_tokens", "cap", "rest"]).append_column("container", pa.array(box * stripes + stripe)).append_column("offset", pa.array(at))
        return out.to_batches()[0]

    group = None
    for b in batches:
        if not b.num_rows:
            continue
        w, s = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy()
        edge = np.r_[0, np.flatnonzero((w[1:] != w[:-1]) | (s[1:] != s[:-1])) + 1, b.num_rows]
        for a, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            now = (b.column(0)[a].as_py(), int(s[a]))
            if group is not None and now != group:
                yield flush()
                held = []
            group = now
            held.append(b.slice(a, e - a))
    if held:
        yield flush()


def pack(sizes: DataFrame, windows: DataFrame, key: str = "doc_id", stripe: int = STRIPE) -> DataFrame:
    """``window_name, container, key, piece_no, start_token, n_tokens, offset`` of every placed piece.

    ``sizes`` has ``key, n_tokens``; it is read three times, so give a written table. Containers are
    numbered per window: from 0 (with steps) those that are packed, from -1 downwards those that pieces of
    over-long documents fill.
    """
    caps = windows.where("capacity_tokens > 0").select("window_name", F.col("capacity_tokens").cast("long").alias("cap")).distinct()  # configuration: one row a window
    docs = sizes.where("n_tokens > 0").select(F.col(key).alias("key"), F.col("n_tokens").cast("long").alias("n_tokens")).crossJoin(F.broadcast(caps))
    stripes = max(1, -(-sizes.where("n_tokens > 0").count() // stripe))
    items = docs.withColumn("rest", F.pmod("n_tokens", "cap")).where("rest > 0")
    items = items.select("window_name", F.pmod(F.xxhash64("key"), F.lit(stripes)).alias("stripe"), "key", "n_tokens", "cap", "rest", F.lit(stripes).cast("long").alias("stripes"))
    parts = min(stripes * 8, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = items.repartition(parts, "window_name", "stripe").sortWithinPartitions("window_name", "stripe", F.desc("rest"), "key")
    kind = dict(sizes.dtypes)[key]
    placed = dealt.mapInArrow(_sweep, f"window_name string, key {kind}, n_tokens long, cap long, rest long, container long, offset long")
    tail = placed.select("window_name", "container", F.col("key").alias(key), F.floor(F.col("n_tokens") / F.col("cap")).alias("piece_no"), (F.col("n_tokens") - F.col("rest")).alias("start_token"), F.col("rest").alias("n_tokens"), "offset")

    # whole containers of over-long documents, numbered by running offsets
    long = docs.where("n_tokens >= cap").withColumn("full", F.floor(F.col("n_tokens") / F.col("cap"))).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    lw = Window.partitionBy("window_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = long.groupBy("window_name", "bucket").agg(F.sum("full").alias("k")).select("window_name", "bucket", F.coalesce(F.sum("k").over(lw), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("full").over(Window.partitionBy("window_name", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = long.withColumn("inner", inside).join(base, ["window_name", "bucket"])
    full = full.select("window_name", "key", "cap", (F.col("base") + F.col("inner")).alias("c0"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
    full = full.select("window_name", (-1 - F.col("c0") - F.col("piece_no")).alias("container"), F.col("key").alias(key), "piece_no", (F.col("piece_no") * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens"), F.lit(0).cast("long").alias("offset"))
    return tail.unionByName(full)
