"""Near-duplicate records by a MinHash LSH forest with exact verification.

Similarity of two records is that of their word multisets: words in common over words in either one.
A word counted with its occurrence number turns the multiset into a set, so MinHash applies.

Plan, with one exchange of the records (the ``bag`` exchange, used again by every later step):
1. words -> sorted 32-bit element hashes; equal bags share a 64-bit key, and later copies of a bag in
   a task travel without it, so a group of copies costs a few bytes a row;
2. each distinct bag enters the forest: ``trees`` prefix tries over its signature. The matched prefix
   starts at ``MAX_DEPTH`` levels and is shortened level by level until the recall reaches the target. The
   recall of a depth is measured on verified pairs: those of a sample of at most about ``SAMPLE`` records,
   found with the shortest prefix that suffices for pairs right at the threshold, each weighted by one
   over its chance to be found (:func:`fit_depth`). All records are then matched at that depth. Of a trie
   only the node at the matched depth is kept, as a 32-bit label; a task packs its labels, sorted by
   tree and label, into one compressed block for each part of the label space;
3. in each part the sorted labels of all blocks are merged, neighbours of one node are paired, and a pair
   that can't reach the threshold leaves at once: by its sizes, and by the Hamming distance of 128-bit odd
   sketches, which never exceeds the symmetric difference. Both tests are exact. The number of parts
   grows with the records, so that a part stays small;
4. the distinct candidates meet the bags again and are verified exactly;
5. bags are expanded to the records that have them.

Null texts and records of under ``min_words`` words are in no pair. Rows with the same id are one
record (the greatest text). Extra columns are dropped.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.components import connected_components
from engramlake.llm.pii import portions
from engramlake.session import cut

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
TREES, MAX_DEPTH, POOL, RECALL = 64, 12, 224, 0.999
SAMPLE, LEAST, PART_ROWS = 20_000, 100, 20_000
FLUSH = 20_000
_M32 = np.uint64(0xFFFFFFFF)


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """That a pair meets in at least one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, trees: int = TREES, recall: float = 0.99, deepest: int = MAX_DEPTH) -> int:
    """The longest matched prefix that reaches the recall even if all pairs lie at the threshold."""
    return next((k for k in range(deepest, 1, -1) if chance(threshold, k, trees) >= recall), 1)


def adapted_depth(similarities: list[float], threshold: float, trees: int = TREES, recall: float = RECALL, drawn: bool = False) -> int:
    """Shortens the prefix from ``MAX_DEPTH`` until the recall over the measured pairs reaches the target.

    ``similarities`` are those of verified pairs found at :func:`prefix_depth`, which is also the end of
    the shortening; with under ``LEAST`` pairs it is taken. ``drawn``: the records were drawn by a MinHash,
    so a pair was in the sample with a chance in proportion to its similarity.
    """
    floor = prefix_depth(threshold, trees)
    weight = [1 / chance(s, floor, trees) / (s if drawn else 1) for s in similarities]
    for k in range(MAX_DEPTH, floor, -1):
        if len(weight) >= LEAST and sum(w * chance(s, k, trees) for s, w in zip(similarities, weight)) >= recall * sum(weight):
            return k
    return floor


def _mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser."""
    x = x.astype(np.uint32)
    for shift, mul in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(mul)
    return x


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Starts of equal runs."""
    if not len(sorted_):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])


def bags_of(texts: list[str | None], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows kept, their sizes, and all element hashes (sorted in each row), concatenated."""
    words: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = WORD.findall(t.lower())
            if len(w) >= min_words:
                words += w
                sizes[i] = len(w)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return rows, sizes[rows], np.zeros(0, np.uint32)
    coded = pa.array(words, pa.string()).dictionary_encode()
    of = xxhash.xxh32_intdigest
    h = np.fromiter((of(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
    key = np.repeat(np.arange(len(rows), dtype=np.uint64), sizes[rows]) << np.uint64(32) | h
    key.sort()
    start = _runs(key)
    nth = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
    elem = _mix((key & _M32).astype(np.uint32) + _mix(nth.astype(np.uint32) * np.uint32(0x9E3779B1)))
    key = (key >> np.uint64(32)) << np.uint64(32) | elem
    key.sort()
    return rows, sizes[rows], (key & _M32).astype(np.uint32)


def _signatures(elems: np.ndarray, starts: np.ndarray, pool: int) -> np.ndarray:
    """``pool x rows`` MinHash values."""
    mul = np.random.default_rng(7).integers(0, 1 << 31, pool, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = np.random.default_rng(8).integers(0, 1 << 32, pool, dtype=np.uint32)
    out = np.empty((pool, len(starts)), np.uint32)
    buf = np.empty_like(elems)
    for j in range(pool):
        np.multiply(elems, mul[j], out=buf)
        np.bitwise_xor(buf, add[j], out=buf)
        np.minimum.reduceat(buf, starts, out=out[j])
    return out


def tree_labels(sig: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """``trees x rows`` 32-bit labels of the matched prefixes."""
    rng = np.random.default_rng(9)
    deck = np.concatenate([rng.permutation(len(sig)) for _ in range(-(-trees * MAX_DEPTH // len(sig)))])
    out = np.zeros((trees, sig.shape[1]), np.uint32)
    for t in range(trees):
        for level in range(depth):  # the trie's path, level by level
            out[t] = _mix(out[t] * np.uint32(31) + sig[deck[t * depth + level]] + np.uint32(level))
    return out


def odd_sketch(elems: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``rows x 2`` words of the 128-bit parity sketch."""
    bit = np.uint64(1) << (elems & np.uint32(63)).astype(np.uint64)
    high = (elems >> np.uint32(6)) & np.uint32(1)
    lo, hi = np.where(high == 0, bit, np.uint64(0)), np.where(high == 1, bit, np.uint64(0))
    return np.stack([np.bitwise_xor.reduceat(lo, starts), np.bitwise_xor.reduceat(hi, starts)], 1)


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplane(b: bytes, dtype: type, n: int) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, n).T).view(dtype).reshape(n)


def _block(tree: np.ndarray, label: np.ndarray, row: np.ndarray, ids: np.ndarray, sizes: np.ndarray, odd: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """One compressed block; entries are sorted by tree and label."""
    used, at = np.unique(row, return_inverse=True)
    body = _planes(tree.astype(np.uint16)) + _planes(np.diff(label, prepend=np.uint32(0)).astype(np.uint32)) + _planes(at.astype(np.uint32))
    body += _planes(ids[used]) + _planes(sizes[used]) + _planes(odd[used, 0]) + _planes(odd[used, 1])
    return struct.pack("<II", len(tree), len(used)) + z.compress(body)


def _unblock(b: bytes, z: zstandard.ZstdDecompressor) -> tuple[np.ndarray, ...]:
    n, m = struct.unpack("<II", b[:8])
    body, out, at = z.decompress(b[8:]), [], 0
    for dtype, k in ((np.uint16, n), (np.uint32, n), (np.uint32, n), (np.int64, m), (np.int64, m), (np.uint64, m), (np.uint64, m)):
        step = np.dtype(dtype).itemsize * k
        out.append(_unplane(body[at : at + step], dtype, k))
        at += step
    out[1] = np.cumsum(out[1], dtype=np.uint32)
    return tuple(out)


def _bag_stage(min_words: int):
    schema = pa.schema([pa.field("bag", pa.int64(), False), ("p", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in (whole.slice(at, end - at) for whole in batches for at, end in portions(whole.column(1).to_pylist(), 4_000_000, 10_000)):
            rec = b.column(0).to_numpy()
            texts = b.column(1).to_pylist()
            rows, sizes, elems = bags_of(texts, min_words)
            if not len(rows):
                continue
            rec = rec[rows]
            ends = np.cumsum(sizes)
            raw = elems.view(np.int32)
            keys, keep = np.empty(len(rows), np.int64), np.zeros(len(rows), bool)
            for i, (e, n, r) in enumerate(zip(ends, sizes, rec)):
                k = xxhash.xxh3_64_intdigest(raw[e - n : e].tobytes(), seed=int(r & 1))
                keys[i] = k - (1 << 64) if k >> 63 else k
                if k not in sent:
                    sent.add(k)
                    keep[i] = True
            if len(sent) > 1_000_000:
                sent.clear()
            lens = np.where(keep, sizes, 0) + 3
            offs = np.r_[0, np.cumsum(lens)]
            vals = np.empty(offs[-1], np.int32)
            head = offs[:-1]
            vals[head], vals[head + 1], vals[head + 2] = rec >> 32, (rec & 0xFFFFFFFF).astype(np.uint32).view(np.int32), sizes
            body = np.ones(len(vals), bool)
            body[np.r_[head, head + 1, head + 2]] = False
            vals[body] = raw[np.repeat(keep, sizes)]
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(vals))
            yield pa.RecordBatch.from_arrays([pa.array(keys), lists], schema=schema)

    return run


def _forest_stage(depth: int, trees: int, parts: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def flush(ids: np.ndarray, sizes: np.ndarray, elems: np.ndarray) -> pa.RecordBatch:
        starts = np.r_[0, np.cumsum(sizes >> 1)[:-1]].astype(np.int64)
        sig = _signatures(elems, starts, POOL)
        labels = tree_labels(sig, trees, depth)
        odd = odd_sketch(elems, starts)
        z = zstandard.ZstdCompressor(level=1)
        tree = np.repeat(np.arange(trees, dtype=np.uint16), len(ids))
        row = np.tile(np.arange(len(ids), dtype=np.uint32), trees)
        flat = labels.reshape(-1)
        part = _mix(flat + np.uint32(0x51ED270B)) % np.uint32(parts)
        order = np.lexsort((flat, tree, part))
        tree, row, flat, part = tree[order], row[order], flat[order], part[order]
        cut = np.r_[_runs(part), len(part)]
        made = [(int(part[a]), _block(tree[a:b], flat[a:b], row[a:b], ids, sizes, odd, z)) for a, b in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = words = 0
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), lists.flatten().to_numpy().view(np.uint32)))
            n += b.num_rows
            words += len(held[-1][2])
            if n >= FLUSH or words >= 8_000_000:
                yield flush(*(np.concatenate(x) for x in zip(*held)))
                held, n, words = [], 0, 0
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _pair_stage(threshold: float):
    schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        by_part: dict[int, list[bytes]] = {}
        for b in batches:
            for part, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_part.setdefault(part, []).append(block)
        for part in list(by_part):
            label, row, ids, sizes, lo, hi, base = [], [], [], [], [], [], 0
            for block in by_part.pop(part):
                t, k, r, i, s, x, y = _unblock(block, z)
                label.append(t.astype(np.uint64) << np.uint64(32) | k)
                row.append(r.astype(np.int64) + base)
                ids.append(i), sizes.append(s), lo.append(x), hi.append(y)
                base += len(i)
            label, row = np.concatenate(label), np.concatenate(row)
            ids, sizes, lo, hi = map(np.concatenate, (ids, sizes, lo, hi))
            order = np.argsort(label, kind="stable")
            label, row = label[order], row[order]
            at = np.flatnonzero(label[1:] == label[:-1])  # positions that have a partner one step on
            step, got, count = 1, [], 0
            while len(at):
                a, b = row[at], row[at + step]
                na, nb, kind = sizes[a] >> 1, sizes[b] >> 1, (sizes[a] ^ sizes[b]) & 1
                most = na + nb - 2 * np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
                ok = (kind == 0) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
                ok &= np.bitwise_count(lo[a] ^ lo[b]).astype(np.int64) + np.bitwise_count(hi[a] ^ hi[b]) <= most
                x, y = ids[a[ok]], ids[b[ok]]
                ok = x != y
                got.append(np.stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok]], 1))
                count += len(got[-1])
                if count > 500_000:
                    u = np.unique(np.concatenate(got), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], schema=schema)
                    got, count = [], 0
                step += 1
                at = at[at + step < len(label)]
                at = at[label[at] == label[at + step]]
            if count:
                u = np.unique(np.concatenate(got), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], schema=schema)

    return run


class NearDuplicates:
    """The plan over ``records(kind 0/1, id, text)`` for one threshold."""

    def __init__(self, records: DataFrame, threshold: float = 0.8, min_words: int = 1, trees: int = TREES, recall: float = RECALL, depth: int | None = None):
        self.threshold = threshold
        spark = records.sparkSession
        n = records.count()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))
        self.depth = depth or fit_depth(records, n, threshold, min_words, trees, recall)
        self.flat = flat = records.select((F.col("id").cast("long") * 2 + F.col("kind")).alias("rec"), "text")
        # one opaque array a row (id in two halves, size, elements): no filter or pruning can move below
        # the exchange, so that every use is the same exchange
        bags = flat.mapInArrow(_bag_stage(min_words), "bag long not null, p array<int>").repartition(parts, "bag")
        rec = F.shiftleft(F.col("p")[0].cast("long"), 32).bitwiseOR(F.col("p")[1].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        self.members = bags.select("bag", F.coalesce(rec, F.lit(0).cast("long")).alias("rec"))  # not null, so that no null test moves down
        whole = bags.groupBy("bag").agg(F.max_by("p", F.size("p")).alias("p"))
        self.reps = whole.select("bag", (F.col("p")[2].cast("long") * 2 + F.col("p")[1].bitwiseAND(F.lit(1))).alias("size"), F.expr("slice(p, 4, size(p))").alias("elems"))
        blocks = self.reps.mapInArrow(_forest_stage(self.depth, trees, parts), "part int, block binary").repartition(parts, "part")
        self.candidates = blocks.mapInArrow(_pair_stage(threshold), "ka long, kb long").distinct()

    def bag_pairs(self) -> DataFrame:
        """``ka, kb, common, total`` of all pairs of different bags at or above the threshold."""
        a = self.reps.select(F.col("bag").alias("ka"), F.col("elems").alias("ea"), F.expr("size div 2").alias("na"))
        b = self.reps.select(F.col("bag").alias("kb"), F.col("elems").alias("eb"), F.expr("size div 2").alias("nb"))
        met = self.candidates.join(a, "ka").join(b, "kb").withColumn("common", F.size(F.array_intersect("ea", "eb")))
        met = met.withColumn("total", F.col("na") + F.col("nb") - F.col("common"))
        return met.where(F.col("common") >= F.lit(self.threshold) * F.col("total") - 1e-9).select("ka", "kb", "common", "total")

    def classes(self) -> DataFrame:
        """``record_kind, id, class_id, n_links``: every record, the class of its bag and the links between
        its bag and different ones; copies share both. A record alone is its own class, as is one that has
        too few words for a bag (null and wordless texts too)."""
        pairs = cut(self.bag_pairs().select("ka", "kb"))
        comp = connected_components(pairs.select(F.col("ka").alias("u"), F.col("kb").alias("v")))
        deg = pairs.select(F.col("ka").alias("bag")).unionAll(pairs.select("kb")).groupBy("bag").agg(F.count(F.lit(1)).alias("n_links"))
        members = cut(self.members)
        bare = self.flat.select("rec").distinct().join(members.select("rec"), "rec", "left_anti").select(F.xxhash64("rec").alias("bag"), "rec")
        m = members.unionByName(bare).join(comp.withColumnRenamed("vertex", "bag"), "bag", "left").join(deg, "bag", "left")
        kind = F.when(F.col("rec") % 2 == 0, "document").otherwise("atom")
        return m.select(kind.alias("record_kind"), F.expr("rec div 2").alias("id"), F.coalesce("component", "bag").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def record_pairs(self) -> DataFrame:
        """``kind, id_a, id_b`` of all pairs of records, copies expanded."""
        m = self.members
        one, two = m.select(F.col("bag").alias("ka"), F.col("rec").alias("ra")), m.select(F.col("bag").alias("kb"), F.col("rec").alias("rb"))
        light = self.bag_pairs().select("ka", "kb").join(one, "ka").join(two, "kb").select("ra", "rb")
        same = m.select("bag", F.col("rec").alias("ra")).join(m.select("bag", F.col("rec").alias("rb")), "bag").where("ra < rb").select("ra", "rb")
        pairs = light.unionByName(same)
        return pairs.select((F.col("ra") % 2).cast("int").alias("kind"), F.expr("least(ra, rb) div 2").alias("id_a"), F.expr("greatest(ra, rb) div 2").alias("id_b"))


def fit_depth(records: DataFrame, n: int, threshold: float, min_words: int, trees: int, recall: float, sample: int = SAMPLE) -> int:
    """The matched depth for these records, from the similarities of a sample's pairs.

    Of more than ``sample`` records those are drawn whose least word hash falls in a fraction of the range:
    near duplicates mostly share it, so pairs come in proportion to the fraction, not to its square.
    Similarities come to the driver rounded to a hundredth and counted: at most a hundred rows.
    """
    some = records
    if n > sample:
        words = F.split(F.lower("text"), r"[\s,.!?;，。！？；、]+")
        least = F.array_min(F.transform(words, lambda w: F.xxhash64(w)))
        some = records.where(F.pmod(least, F.lit(1 << 20)) < int((1 << 20) * sample / n))
    pairs = NearDuplicates(some, threshold, min_words, trees, recall, prefix_depth(threshold, trees)).bag_pairs()
    got = pairs.groupBy(F.round(F.col("common") / F.col("total"), 2).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    scale = max(1, max((r["n"] for r in got), default=1) // 1000)
    return adapted_depth([max(threshold, r["s"]) for r in got for _ in range(max(1, r["n"] // scale))], threshold, trees, recall, n > sample)


def records_of(documents: DataFrame, atoms: DataFrame) -> DataFrame:
    """Documents (kind 0) and atoms (kind 1); repeated atom rows are one record."""
    docs = documents.where("doc_id is not null").select(F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "text")
    own = atoms.where("id is not null").groupBy("id").agg(F.max("content").alias("text")).select(F.lit(1).alias("kind"), "id", "text")
    return docs.unionByName(own)
