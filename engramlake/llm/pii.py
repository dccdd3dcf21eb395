"""Personal information in free text: a character BiLSTM with CRF transitions, in numpy.

A text is cut at line and sentence ends; equal segments of a batch are read once. Segments of similar
length run through both directions of the LSTM side by side; a long one in overlapping windows, whose
emissions are stitched (every character takes those of the window in which it lies deepest). The CRF
then decodes each segment once, as a whole: where a stretch is provably outside (turning it into
outside gains more than any tags and transitions around it can lose) the path is cut, and only the
pieces between such stretches pass the Viterbi sweep, which gives the same path as the full sweep.
Spans are then snapped to what a checker of their type accepts around them.

Fields are typed: e-mail, phone, identity number, street address, person name. Redaction writes a
placeholder for each span and keeps the rest. Null and empty texts have no spans; repeated rows are
found like single ones. The weights are trained by ``pii_train`` from labelled spans; no list of names
is used, neither as a feature nor as a filter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
K = len(TAGS)
T, STEP, ROWS = 256, 192, 2048
HIDDEN = 24
CYR = [("sch", "ш"), ("ch", "ч"), ("sh", "ш"), ("zh", "ж"), ("kh", "х"), ("ya", "я"), ("yu", "ю"), ("ph", "ф"), ("th", "т"), ("ck", "к"), ("qu", "кв"), ("kw", "кв")] + list(zip("abcdefghijklmnopqrstuvwxyz", "а б к д е ф г х и ж к л м н о п к р с т у в в кс и з".split()))


def cyrillic(w: str) -> str:
    """A plain transliteration, for names in Russian text."""
    out, low = "", w.lower()
    while low:
        for a, b in CYR:
            if low.startswith(a):
                out, low = out + b, low[len(a) :]
                break
        else:
            out, low = out + low[0], low[1:]
    return out.capitalize() if w[:1].isupper() else out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character -> id, letter flags, lower-cased code points (below U+3000, else itself)."""
    ids = np.full(0x110000, 1, np.int32)
    letter = np.zeros(0x110000, bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x3000):
        c = chr(i)
        letter[i] = c.isalpha()
        if len(c.lower()) == 1:
            low[i] = ord(c.lower())
        if i < 128:
            ids[i] = i if i >= 32 else 32
        elif 0x400 <= i < 0x460:
            ids[i] = 128 + i - 0x400
        elif c.isalpha():
            ids[i] = 224 if c.isupper() else 225
        elif c.isspace():
            ids[i] = 32
        elif c.isdigit():
            ids[i] = 48
    ids[0x3000:0x3100] = 226
    ids[ord("º")] = ids[ord("ª")] = 227
    ids[ord("，")] = ids[ord("、")] = ids[ord("。")] = ids[ord("；")] = 228
    ids[ord("：")] = 229
    ids[ord("（")] = ids[ord("）")] = 230
    ids[0x4E00:0xA000] = 231
    ids[0x1F000:0x20000] = 232
    return ids, letter, low


BASE = 233


def token_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and lengths of the runs of letters (lower-cased)."""
    _, letter, low = tables()
    is_l = letter[x]
    edge = np.flatnonzero(np.diff(np.r_[0, is_l.astype(np.int8), 0]))
    a, b = edge[::2], edge[1::2]
    if not len(a):
        return a, np.zeros(0, np.uint32), a
    n = b - a
    powers = np.cumprod(np.r_[1, np.full(63, 0x01000193)].astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    at = np.flatnonzero(is_l)
    ends = np.cumsum(n)
    pos = np.arange(len(at)) - np.repeat(ends - n, n)
    val = low[x[at]] * powers[np.minimum(pos, 63)]
    return a, np.add.reduceat(val, ends - n, dtype=np.uint32), n


def stream(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined texts, their code points and where each text ends."""
    joined = "\x00".join((t or "").replace("\x00", " ") for t in texts) + "\x00"
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, x, np.flatnonzero(x == 0)


def inputs(x: np.ndarray, han: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Input ids: character, and whether its word is a common word of the training sentences."""
    ids = tables()[0][x].copy()
    ids[x == 0] = 0
    hans = (x >= 0x4E00) & (x < 0xA000)
    if len(han) and hans.any():
        at = np.searchsorted(han, x[hans])
        at[at == len(han)] = 0
        ids[hans] = np.where(han[at] == x[hans], BASE + at, 231)
    flag = np.zeros(len(x) + 1, np.int8)
    a, h, n = token_hashes(x)
    if len(common) and len(a):
        at = np.searchsorted(common, h)
        at[at == len(common)] = 0
        hit = common[at] == h
        flag[a[hit]] = 1  # words start and end at different places, and never touch
        flag[(a + n)[hit]] -= 1
    ids *= 2
    ids += np.cumsum(flag[:-1], dtype=np.int32)
    return ids


def fast_weights(m: dict) -> dict:
    """Of each direction: inputs and states to gates, scaled so that a clip is the hard sigmoid, each gate an array of its own; states to tags."""
    h = m["Uf"].shape[0]
    out = {}
    for n, d in enumerate("fb"):
        x, u = m["X" + d].astype(np.float32), m["U" + d].astype(np.float32)
        x[:, : 3 * h] = 0.25 * x[:, : 3 * h] + 0.5
        u[:, : 3 * h] *= 0.25
        gates = [np.ascontiguousarray(v.reshape(-1, 4, h).transpose(1, 0, 2)) for v in (x, u)]
        out[d] = *gates, np.ascontiguousarray(m["W"][n * h : (n + 1) * h], np.float32)
    return out


def filled(n: int, v: float) -> np.ndarray:
    """An array that begins at a cache line; numpy's own may not, and are slower."""
    a = np.empty(n + 16, np.float32)
    a = a[(-a.ctypes.data // 4) % 16 :][:n]
    a[:] = v
    return a


def emissions(m: dict, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``T x B x K`` scores of the tags for windows ``T x B`` of ascending ``length``; what lies behind a window's end is not set.

    A step runs over the windows that reach it, so what stands beside a window has no influence on it.
    The gates are whole arrays (4 x rows x hidden), and bounds full ones: numpy is much slower on columns, and on an
    array and a number. Scores are made at each step, so that the states stay in the cache.
    """
    steps, b = ids.shape
    h = m["Uf"].shape[0]
    fast = m.get("fast") or m.setdefault("fast", fast_weights(m))
    zs, rs, hs, cs = filled(4 * b * h, 0), filled(4 * b * h, 0), filled(b * h, 0), filled(b * h, 0)
    zero, one, minus = filled(b * h, 0), filled(b * h, 1), filled(b * h, -1)
    first = np.searchsorted(length, np.arange(steps), "right").tolist()
    out = np.empty((steps, b, K), np.float32)
    more = np.empty((b, K), np.float32)
    for d in "fb":
        xp, u, w = fast[d]
        hs[:], cs[:] = 0, 0
        k = -1
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            if first[t] != k:
                k = first[t]
                n = (b - k) * h
                z, r = zs[: 4 * n].reshape(4, n), rs[: 4 * n].reshape(4, b - k, h)
                x, (z0, z1, z2, z3), gates, rz = z.reshape(4, b - k, h), z, z[:3], r.reshape(4, n)
                hh, cc, lo, hi, neg = hs[k * h :], cs[k * h :], zero[:n], one[:n], minus[:n]
                rows, add = hh.reshape(b - k, h), more[k:]
            xp.take(ids[t, k:], axis=1, out=x, mode="clip")
            np.matmul(rows, u, out=r)
            np.add(z, rz, out=z)
            np.maximum(gates, lo, out=gates)
            np.maximum(z3, neg, out=z3)
            np.minimum(z, hi, out=z)
            np.multiply(cc, z1, out=cc)
            np.multiply(z3, z0, out=z3)
            np.add(cc, z3, out=cc)
            np.minimum(cc, hi, out=hh)
            np.maximum(hh, neg, out=hh)
            np.multiply(hh, z2, out=hh)
            if d == "f":
                np.dot(rows, w, out=out[t, k:])
            else:
                np.dot(rows, w, out=add)
                out[t, k:] += add
    return out


# transitions that the tags allow: anything to O and to a beginning, an inside only from its own type
ALLOWED = [list(range(K)) if j == 0 or j % 2 else [j - 1, j] for j in range(K)]


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tag paths ``T x B`` from ``T x K x B``, with O before and after; the way back is found again from the scores."""
    steps, k, b = e.shape
    s = np.empty((steps, k, b), np.float32)
    s[0] = e[0] + trans[0][:, None]
    s[0, 2::2] = -1e9  # no inside after O
    cols = [np.ascontiguousarray(trans[:, j])[:, None] for j in range(k)]
    tmp, two = np.empty((k, b), np.float32), np.empty(b, np.float32)
    for t in range(1, steps):
        p, q = s[t - 1], s[t]
        for j in range(k):
            if j == 0 or j % 2:
                np.add(p, cols[j], out=tmp)
                np.maximum.reduce(tmp, axis=0, out=q[j])
            else:
                np.add(p[j - 1], trans[j - 1, j], out=q[j])
                np.add(p[j], trans[j, j], out=two)
                np.maximum(q[j], two, out=q[j])
        q += e[t]
    back = np.full((k, k), -1e9, np.float32)
    for j in range(k):
        back[ALLOWED[j], j] = trans[ALLOWED[j], j]
    path = np.empty((steps, b), np.int64)
    path[-1] = (s[-1] + trans[:, :1]).argmax(0)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = (s[t - 1] + back[:, path[t]]).argmax(0)
    return path.astype(np.int8)


def pieces(e: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what must be decoded, from ``K x N`` emissions; segments end at ``ends``.

    A position is a cut, surely O, if any run of tags through it would gain by becoming O from the stretch's
    start or its own to the stretch's end or its own, where each position of the stretch prefers O by more
    than a transition can give. A run that ends in the stretch loses what the transitions beside it can give
    (``around``); one that goes on behind it also what turning its next inside into a beginning costs.
    """
    n = e.shape[1]
    other = e[1].copy()
    for k in range(2, K):
        np.maximum(other, e[k], out=other)
    top = max(float(trans[i, j]) for j in range(K) for i in ALLOWED[j])
    margin = e[0] - other - np.float32(max(0.0, top - float(trans[0, 0])))
    margin[ends] = np.float32(1e6)
    cold = margin > 0
    edge = np.flatnonzero(np.diff(np.r_[False, cold, False].astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    at = np.flatnonzero(cold)
    of = np.repeat(np.arange(len(a)), b - a)
    run = np.cumsum(margin[at], dtype=np.float64)
    behind = run[np.cumsum(b - a) - 1][of] - run + margin[at]  # from the position to the stretch's end
    after = np.minimum(b, n - 1)
    lose = np.maximum(0, np.max([e[k + 1, after] - e[k, after] for k in range(1, K, 2)], axis=0))
    lose[b == n] = 0
    around = 2 * top - float(trans[:, 0].min()) - float(min(trans[0, k] for k in (0, *range(1, K, 2))))
    around = max(0.0, around + max(0.0, *(float(trans[k + 1, j] - trans[k, j]) for k in range(1, K, 2) for j in range(K) if k in ALLOWED[j])))
    open_ = np.ones(n, np.int8)
    open_[at[(margin[at] > around) & (behind > lose[of] + around)]] = 0
    edge = np.flatnonzero(np.diff(np.r_[np.int8(0), open_, np.int8(0)]))
    return edge[::2], edge[1::2]


def decode(e: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """A tag for each position of ``K x N`` emissions."""
    tags = np.zeros(e.shape[1], np.int8)
    lo, hi = pieces(e, ends, trans)
    order = np.argsort(hi - lo, kind="stable")
    lo, hi = lo[order], hi[order]
    at = 0
    while at < len(lo):
        size = hi - lo
        to = min(len(lo), at + 512, int(np.searchsorted(size, max(size[at] * 5 // 4, size[at] + 3), "right")))
        steps = int(size[to - 1])
        pos = lo[at:to][None, :] + np.arange(steps)[:, None]
        live = pos < hi[at:to][None, :]
        part = e[:, np.where(live, pos, lo[at:to][None, :])].transpose(1, 0, 2).copy()
        part[:, 0][~live] = 0
        part[:, 1:].transpose(0, 2, 1)[~live] = -1e6
        path = viterbi(part, trans)
        tags[pos[live]] = path[live]
        at = to
    return tags


# what ends a segment: a line, a sentence (a full stop only after a word of four letters, before no digit), a bar
CUT = re.compile(r"[\n!?。！？；.|](?:(?<=\n)\n*|(?<=[!?。！？；])[!?。！？；]*|(?<=\.)\s+(?=[^\d\s])|(?<=\s\|)(?=\s))")
SHORT_FORM = re.compile(r"(?:prof|avda|просп|herr|frau|(?<![^\W\d_])[^\W\d_]{1,3})$", re.I)


def segments(text: str) -> list[tuple[int, str]]:
    """Offsets and texts of the segments; blanks at both ends belong to none."""
    out, at, last = [], 0, 0
    for m in CUT.finditer(text):
        a, b = m.span()
        c = text[a]
        if c == "|":  # with a blank on both sides, neither of which another cut has taken
            if a <= last:
                continue
            a, b = a - 1, b + 1
            c = text[a]
        elif a < last:
            a = last
            if a >= b:
                continue
        last = b
        if c == ".":
            if not text[a - 4 : a].isalpha() or SHORT_FORM.search(text, max(at, a - 6), a):
                continue
            a += 1
        elif c not in "\n \t":
            a = b
        if a > at:
            s = text[at:a]
            t = s.strip()
            if len(t) > 1:
                out.append((at + s.index(t[0]), t))
        at = b
    if at < len(text):
        s = text[at:]
        t = s.strip()
        if len(t) > 1:
            out.append((at + s.index(t[0]), t))
    return out


def tag_stream(m: dict, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A tag for each character of a stream whose segments end at ``ends``."""
    ids = inputs(x, m["han"], m["common"])
    start = np.r_[0, ends[:-1] + 1]
    size = ends - start
    # windows: one for a segment up to T, else overlapping ones; the own zone of each ends midway in the overlap
    extra = np.maximum(0, -(-(size - T) // STEP))
    seg = np.repeat(np.arange(len(size)), extra + 1)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(extra + 1) - (extra + 1), extra + 1)
    w0 = start[seg] + nth * STEP
    w1 = np.minimum(w0 + T, ends[seg])
    rim = (T - STEP) // 2
    own0 = np.where(nth == 0, w0, w0 + rim)
    own1 = np.where(nth == extra[seg], w1, w1 - rim)
    order = np.argsort(w1 - w0, kind="stable")
    w0, w1, own0, own1 = w0[order], w1[order], own0[order], own1[order]
    scores = np.zeros((len(x), K), np.float32)
    rows = scores.view(f"V{4 * K}").ravel()  # numpy moves one item faster than K
    length, at = w1 - w0, 0
    while at < len(w0):
        to = min(len(w0), at + ROWS)
        steps = int(length[to - 1])
        pos = w0[at:to] + np.arange(steps)[:, None]
        got = emissions(m, ids.take(pos, mode="clip").astype(np.int64), length[at:to])
        mine = np.flatnonzero((pos >= own0[at:to]) & (pos < own1[at:to]))
        rows[pos.ravel()[mine]] = got.view(rows.dtype).ravel()[mine]
        at = to
    e = np.empty((K, len(x)), np.float32)
    for at in range(0, len(x), 4096):
        np.add(scores[at : at + 4096].T, m["b"][:, None], out=e[:, at : at + 4096])
    e[:, ends] = 0
    del scores, rows
    return decode(e, ends, m["A"])


MAIL = r"[A-Za-z0-9_.+\-]+\s*(?:@|\(at\)|\[at\]|\sat\s)\s*[A-Za-z0-9_\-]+(?:\s*(?:\.|\[dot\]|\(dot\)|\sdot\s)\s*[A-Za-z][A-Za-z0-9\-]+)+"
CHECK = {
    "email": re.compile(MAIL, re.I),
    "phone": re.compile(r"(?<![0-9A-Za-z.])(?!(?:19|20)\d\d-\d\d-\d\d(?!\d))(?:\+|00)?\(?\d(?:[ ()./\-]{0,2}\d){6,14}(?![0-9A-Za-z])"),
    "id_number": re.compile(r"(?<![0-9A-Za-z])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|[XYZ]?-?\d[\d.]{5,10}-?[A-Z]|[A-Z]{1,3}\d{6,9}|(?=(?:[A-Z]?\d){5})[A-Z][A-Z0-9]{7,9}|(?!(?:19|20)\d\d-\d\d-\d\d(?!\d))\d(?:[ \-]?\d){7,17}[Xx]?)(?![0-9A-Za-z])"),
    "street_address": re.compile(r"(?=.*(?:\d|号))(?=.*(?:[A-ZА-Яa-zа-яäöüßáéíóúñ]{4}|[一-鿿]{3}))\S.*\S", re.S),
    "person_name": re.compile(r"[^\W\d_]"),
}
RUSSIAN_STREET = re.compile(r"(?:проспект|просп\.|улица|ул\.|пер\.|переулок|бульвар)\s+[^\d,]+,\s*д\.\s*\d+\w?(?:,\s*кв\.\s*\d+)?(?:,\s*(?:\d{5,6}\s+)?[А-Я][а-я]+)?")
HEDGE = re.compile(r"(?:(?:dr|prof|mr|mrs|ms|herr|frau|sr|sra|miss|г-н|г-жа)\.?\s+)+", re.I)
TAIL = re.compile(r"[\s,]+(?:jr|sr|ii|iii|phd|md)\.?$", re.I)
# Small words inside names.
PARTICLES = set("de del la di da dos van von der den bin ibn al el y zu ten".split())
EDGE = " \t\r\n,;:!?\"'()[]{}<>|/*~_-。，、；：！？（）「」"


def refine(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span snapped to what its type accepts; None where nothing is accepted."""
    if kind in ("email", "phone", "id_number"):
        lo = max(0, a - 30)
        best = None
        for m in CHECK[kind].finditer(text, lo, min(len(text), b + 30)):
            over = min(b, m.end()) - max(a, m.start())
            if over > 0 and (best is None or over > best[0]):
                best = (over, m.start(), m.end())
        if not best or best[0] < 0.5 * (b - a):
            return None
        a, b = best[1:]
        if kind == "email":
            while text[b - 1] in ".-_":
                b -= 1
        return a, b
    if not re.match("[一-鿿]", text[a : a + 1]):
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum() and not "一" <= text[a - 1] <= "鿿":
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum() and not "一" <= text[b] <= "鿿":
            b += 1
    while a < b and text[a] in EDGE + ".":
        a += 1
    while b > a and (text[b - 1] in EDGE or (text[b - 1] == "." and not re.search(r"(?:^|\s)[A-ZА-Я]\.$", text[a:b]))):
        b -= 1
    if "\n" in text[a:b]:
        b = text.index("\n", a)
        while b > a and text[b - 1] in EDGE:
            b -= 1
    if kind == "street_address" and (m := RUSSIAN_STREET.match(text, a)):
        b = m.end()
    if kind == "person_name":
        if m := HEDGE.match(text, a, b):
            a = m.end()
        if m := TAIL.search(text[a:b]):
            b = a + m.start()
        v = text[a:b]
        if "@" in v or re.search(r"\d", v):
            return None
        if re.match("[一-鿿]", v):
            return (a, b) if re.fullmatch("[一-鿿]{2,4}", v) else None
        words = list(re.finditer(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", v))
        if any(w[0][0].isupper() for w in words):  # a word in lower case amid capitals ends the name, unless it is a particle
            runs: list[list] = [[]]
            for w in words:
                if w[0][0].isupper() or (w[0] in PARTICLES and runs[-1]):
                    runs[-1].append(w)
                elif runs[-1]:
                    runs.append([])
            words = max(runs, key=len)
            while words and not words[-1][0][0].isupper():
                words.pop()
            if words:
                end = words[-1].end() + (1 if len(words[-1][0]) == 1 and v[words[-1].end() :][:1] == "." else 0)
                a, v = a + words[0].start(), v[words[0].start() : end]
                b = a + len(v)
        words = [w[0] for w in words]
        if not 2 <= len(words) <= 5 or max(map(len, words)) < 2 or re.search(r"[_\[\]|]", v):
            return None
        return a, b
    return (a, b) if b - a > 4 and CHECK[kind].match(text[a:b]) else None


MODEL = os.path.join(os.path.dirname(__file__), "models", "pii.npz")


@lru_cache(maxsize=1)
def model(path: str = MODEL) -> dict:
    with np.load(path) as z:
        m = {k: z[k] for k in z.files}
    return {k: v.astype(np.float32) if v.dtype in (np.float16, np.float64) else v for k, v in m.items()}


def spans(texts: list[str | None], m: dict | None = None) -> list[list[tuple[int, int, str]]]:
    """``(start, end, type)`` of each text, in order, without overlaps."""
    m = m or model()
    known: dict[str, int] = {}  # equal segments are read once
    parts = [[(at, known.setdefault(s, len(known))) for at, s in segments(t)] if t else [] for t in texts]
    if not known:
        return [[] for _ in texts]
    segs = list(known)
    _, x, ends = stream(segs)
    tags = tag_stream(m, x, ends)
    kind = (tags + 1) // 2  # 0 outside, else the type's number
    begin = (kind > 0) & ((tags % 2 == 1) | (np.r_[0, kind[:-1]] != kind))
    a = np.flatnonzero(begin)
    stop = np.flatnonzero((kind > 0) & np.r_[(kind[1:] != kind[:-1]) | begin[1:], True]) + 1
    first = np.r_[0, ends[:-1] + 1]
    inside: dict[int, list[tuple[int, int, str]]] = {}
    for i, s, e in zip(np.searchsorted(ends, a).tolist(), a.tolist(), stop.tolist()):
        base = int(first[i])
        typ = TYPES[kind[s] - 1]
        got = refine(typ, segs[i], s - base, e - base)
        have = inside.setdefault(i, [])
        if got and (not have or got[0] >= have[-1][1]):
            have.append((*got, typ))
    return [[(at + a, at + b, typ) for at, i in p for a, b, typ in inside.get(i, ())] for p in parts]


def portions(texts: list[str | None], most: int = 1_000_000, rows: int = 20_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` characters (a longer text alone), so that long texts don't fill the memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and (size + n > most or i - at >= rows):
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with a typed placeholder for every span."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _fields(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each text: kind, id, field, text."""
    m = messages.where("id is not null").select("id", "content", "sender_name")
    both = F.explode(F.array(F.struct(F.lit("content").alias("field"), F.col("content").alias("text")), F.struct(F.lit("sender_name").alias("field"), F.col("sender_name").alias("text")))).alias("f")
    m = m.select(F.lit("message").alias("record_kind"), F.col("id").cast("long").alias("record_id"), both).select("record_kind", "record_id", "f.field", "f.text")
    d = documents.where("doc_id is not null").select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("long").alias("record_id"), F.lit("text").alias("field"), "text")
    return m.unionByName(d)


def _found_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_kind", "record_id", "field", "pii_type", "value"]
    for b in batches:
        for at, end in portions(b.column(3).to_pylist()):
            kind, rid, field, text = (b.slice(at, end - at).column(i).to_pylist() for i in range(4))
            same: dict[str, int] = {}  # equal texts are read once
            order = [same.setdefault(t, len(same)) for t in (x or "" for x in text)]
            got = spans(list(same))
            out: list[list] = [[], [], [], [], []]
            for i, k in enumerate(order):
                for a, e, typ in got[k]:
                    for col, v in zip(out, (kind[i], rid[i], field[i], typ, text[i][a:e])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.string()) for c in out[2:])], names=names)


def find(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """``record_kind, record_id, field, pii_type, value``, distinct."""
    f = _fields(messages, documents).where("text is not null and text <> ''")
    return f.mapInArrow(_found_stage, "record_kind string, record_id long, field string, pii_type string, value string").distinct()


def _redact_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, end in portions(b.column(3).to_pylist()):
            part = b.slice(at, end - at)
            text = part.column(3).to_pylist()
            same = list(dict.fromkeys(t or "" for t in text))  # equal texts are read once
            of = dict(zip(same, spans(same)))
            new = [redact(t, of[t or ""]) for t in text]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(new, pa.string())], names=part.schema.names)


def redacted(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Every text of every row with placeholders; null texts stay null."""
    return _fields(messages, documents).mapInArrow(_redact_stage, "record_kind string, record_id long, field string, text string")
