"""Abusive, hateful and sexual language: a subsequence string-kernel SVM with Nystroem landmarks.

Kernel: two texts share a subsequence of letters with at most one skipped letter, each skip at a
decay, over the square root of their lengths; so a gapped or stuffed insult keeps most of its
subsequences. Look-alike signs, stretched and spaced-out letters and invisible characters fold before.

Training (``abuse_train``): landmarks are drawn from the labelled sentences, texts become
``K(x, L) K(L, L)^-1/2``, and a linear SVM is fitted for each category. The kernel is an inner product
of counted subsequences, so landmarks and SVM collapse exactly into one weight for each (hashed)
subsequence: scoring is a sum over the positions of a text, vectorised over whole Arrow batches.

A sentence of over ``WINDOW`` letters is scored in overlapping windows; a document has the score of
its highest window, whole texts are read. Null, empty and blank texts score below every threshold.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.pii import portions

CATEGORIES = ("abusive", "hateful", "sexual")
BITS = 17
WINDOW, STRIDE = 56, 20
NOTHING = -9.0
DECAY = 0.6
# subsequences: positions and weight; the second list is for ideographs only
SHAPES = [((0, 1, 2), 0.5), ((0, 1, 2, 3, 4), 1.0), ((0, 2, 3, 4, 5), DECAY), ((0, 1, 3, 4, 5), DECAY), ((0, 1, 2, 4, 5), DECAY), ((0, 1, 2, 3, 5), DECAY)]
HAN_SHAPES = [((0, 1), 1.0), ((0, 2), DECAY), ((0, 1, 2), 1.0)]
END = 1
# stop marks that may be inserted in a word, or stand for a letter of it: settled in unstop()
DOT, LETTERLIKE = 3, 4
# Signs read as the letters they resemble.
LOOKS = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "!", "€": "e", "¡": "i"}
CYRILLIC_LOOKS = dict(zip("асеорхукмтнві", "aceopxykmthbi"))
STOPS = ".!?。！？\n|；;…"


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> folded code point; 0 drops it, END ends a sentence."""
    t = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x3000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me", "Cc"):
            t[i] = 0
        elif c.isspace():
            t[i] = 32
        else:
            d = unicodedata.normalize("NFKD", c.lower())[:1]
            t[i] = ord(d) if d and c not in "йёЙЁ" else ord({"й": "й", "ё": "е"}[c.lower()])
    for i in (*range(0x3000, 0x3040), *range(0xFE00, 0xFF70), *range(0x1D400, 0x1D800)):
        d = unicodedata.normalize("NFKD", chr(i)).lower()[:1]
        t[i] = ord(d) if d and unicodedata.category(chr(i)) not in ("Mn", "Cf") else 0
    for a, b in CYRILLIC_LOOKS.items():  # in Cyrillic words too, so that mixed spellings agree
        for c in (a, a.upper()):
            t[ord(c)] = ord(b)
    for a, b in LOOKS.items():
        t[ord(a)] = ord(b)
    for c in "2689":
        t[ord(c)] = ord("#")
    for c in STOPS:
        t[ord(c)] = END
    t[ord(".")] = DOT
    t[ord("!")] = t[ord("|")] = LETTERLIKE
    t[ord("*")] = 0
    t[ord("\t")] = 32
    t[ord("，")] = t[ord("、")] = ord(",")
    t[0xFFFF] = 2  # end of a text, see below
    return t


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """1 letter, 2 ideograph, by folded code point."""
    k = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        k[i] = unicodedata.category(chr(i)).startswith("L")
    k[0x3040:0x3100] = 1
    k[0x4E00:0xA000] = 2
    k[0xAC00:0xD7A4] = 1
    return k


def unstop(x: np.ndarray) -> np.ndarray:
    """Stop marks that end no sentence go.

    Between single letters they spell a word out ("i.d.i.o.t"), with a blank amid them ("u. .a") two
    words. Inside a word "!" and "|" stand for the letter i, and "." is an inserted blank.
    """
    k = kinds()[x]
    mark = (x == END) | (x == DOT) | (x == LETTERLIKE)
    blank = x == 32
    x = x.copy()
    one = (k > 0) & np.r_[True, k[:-1] == 0] & np.r_[k[1:] == 0, True]
    at = np.flatnonzero(k > 0)
    a, b = at[:-1], at[1:]
    marks, blanks = np.r_[0, np.cumsum(mark)], np.r_[0, np.cumsum(blank)]
    m, e = marks[b] - marks[a + 1], blanks[b] - blanks[a + 1]
    spelled = one[a] & one[b] & (m > 0) & (m + e == b - a - 1)
    gap = np.zeros(len(x) + 1, np.int32)
    apart = spelled & (e > 0) & mark[np.minimum(a + 1, len(x) - 1)] & mark[b - 1]
    np.add.at(gap, a[apart] + 1, 1)
    np.add.at(gap, b[apart], -1)
    x[np.cumsum(gap[:-1]) > 0] = 32
    letter = np.r_[False, k[:-1] == 1] & np.r_[k[1:] == 1, False]
    x[letter & (x == LETTERLIKE) & ~(np.r_[False, one[:-1]] & np.r_[one[1:], False])] = ord("i")
    x[letter & (x == DOT) & ~(np.r_[False, one[:-1]] & np.r_[one[1:], False])] = 32
    together = spelled & (e == 0)
    gap = np.zeros(len(x) + 1, np.int32)
    np.add.at(gap, a[together] + 1, 1)
    np.add.at(gap, b[together], -1)
    x = x[np.cumsum(gap[:-1]) == 0]
    x[(x == DOT) | (x == LETTERLIKE)] = END
    return x


def folded(texts: list[str | None], ends: bool = True) -> np.ndarray:
    """All texts as folded code points; each ends with 2. Without ``ends`` sentences end with a blank (training)."""
    joined = "￿".join((t or "").replace("￿", " ") for t in texts) + "￿"
    x = fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = unstop(x[x != 0])
    if not ends:
        x[x == END] = 32
    k = kinds()[x]
    # blanks inside spaced-out words and between ideographs go
    blank = x == 32
    one = (k == 1) & np.r_[True, k[:-1] == 0] & np.r_[k[1:] == 0, True]
    solo = one | (k == 2)
    before, after = np.r_[False, solo[:-1]], np.r_[solo[1:], False]
    drop = blank & before & after
    # repeated letters and blanks count once
    drop |= np.r_[False, (x[1:] == x[:-1]) & ((k[1:] == 1) | blank[1:])]
    x = x[~drop]
    k = kinds()[x]
    again = np.r_[False, (x[1:] == x[:-1]) & (k[1:] == 1)]
    return x[~again]


_STEPS = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1]


def features(x: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, float]]:
    """``positions, hashed subsequences, weight`` for each shape; none crosses an end.

    A subsequence has one hash, whatever letters it skips. Positions where a shape doesn't fit have
    the bucket after the last, whose weight is zero.
    """
    n = len(x)
    pad = np.r_[x, np.full(8, 2, np.uint32)].astype(np.uint32)
    ends = np.r_[0, np.cumsum(pad <= 2, dtype=np.int32)]
    hans = np.r_[0, np.cumsum(kinds()[pad] == 2, dtype=np.int32)]
    scaled = [pad * np.uint32(c) for c in _STEPS]
    fits: dict[int, np.ndarray] = {}
    none = np.uint32(1 << BITS)
    for shape, weight in SHAPES:
        span = shape[-1] + 1
        if span not in fits:
            fits[span] = (ends[span : n + span] == ends[:n]) & (hans[span : n + span] == hans[:n])
        h = scaled[0][shape[0] : shape[0] + n] + scaled[1][shape[1] : shape[1] + n]
        for k in range(2, len(shape)):
            h += scaled[k][shape[k] : shape[k] + n]
        h += np.uint32(len(shape))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x01000193)
        h >>= np.uint32(32 - BITS)
        yield slice(None), np.where(fits[span], h, none), weight
    for shape, weight in HAN_SHAPES:
        span = shape[-1] + 1
        at = np.flatnonzero((ends[span : n + span] == ends[:n]) & (hans[span : n + span] - hans[:n] == span))
        if len(at):
            h = sum(scaled[k][at + p] for k, p in enumerate(shape)) + np.uint32(len(shape))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x01000193)
            yield at, h >> np.uint32(32 - BITS), weight


def windows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of all sentences."""
    stop = np.flatnonzero(x <= 2)
    a, b = np.r_[0, stop[:-1] + 1], stop
    some = b - a >= 2
    a, b = a[some], b[some]
    more = np.maximum(0, -(-(b - a - WINDOW) // STRIDE))
    start = np.repeat(a, more + 1) + STRIDE * (np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1))
    end = np.repeat(b, more + 1)
    start = np.maximum(np.minimum(start, end - WINDOW), np.repeat(a, more + 1))
    return start, np.minimum(end, start + WINDOW)


def window_scores(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and scores (windows x categories)."""
    n, k = len(x), weights.shape[1]
    cum = np.zeros((n + 1, k), np.float64)
    per = [np.zeros(n, np.float32) for _ in range(k)]
    cols = [np.ascontiguousarray(weights[:, c]) for c in range(k)]
    for at, h, w in features(x):
        for c in range(k):
            got = cols[c].take(h)
            got *= np.float32(w)
            per[c][at] += got
    for c in range(k):
        np.cumsum(per[c], out=cum[1:, c])
    a, b = windows(x)
    return a, b, (cum[b] - cum[a]) / np.sqrt(np.maximum(b - a, 12))[:, None] + bias


def document_scores(texts: list[str | None], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Highest window score of each text and category."""
    x = folded(texts)
    a, _, s = window_scores(x, weights, bias)
    out = np.full((len(texts), weights.shape[1]), NOTHING, np.float32)
    doc = np.searchsorted(np.flatnonzero(x == 2), a)
    if len(doc):
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[start]] = np.maximum.reduceat(s, start, axis=0)
    return out


MODEL = os.path.join(os.path.dirname(__file__), "models", "abuse.npz")


@lru_cache(maxsize=1)
def model(path: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    with np.load(path) as z:
        w = np.zeros(((1 << BITS) + 1, len(CATEGORIES)), np.float32)
        w[z["at"]] = z["w"].astype(np.float32) * z["scale"]
        return w, z["bias"].astype(np.float64)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, abusive, hateful, sexual``: the decision value of each category; above 0 is a case."""
    schema = pa.schema([pa.field(key, pa.int64()), *(pa.field(c, pa.float64()) for c in CATEGORIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model()
        for b in batches:
            for at, end in portions(b.column(1).to_pylist(), 1_000_000, 500):
                part = b.slice(at, end - at)
                s = document_scores(part.column(1).to_pylist(), w, bias)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(s[:, i].astype(np.float64)) for i in range(3))], schema=schema)

    cols = ", ".join(f"{c} double" for c in CATEGORIES)
    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, {cols}")


def found(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, category`` of the cases."""
    pairs = F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in CATEGORIES])
    return scores.select(key, F.explode(F.filter(pairs, lambda c: c.isNotNull())).alias("category"))


def source_rates(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents and rates of each category by source; a null source is a group of its own."""
    j = docs.select("doc_id", "source").join(scores, "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.round(F.avg((F.col(c) > 0).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES])
