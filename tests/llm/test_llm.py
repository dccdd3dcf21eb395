"""Training-data operators: brute force, round trips, held-out accuracy, odd rows."""

import bisect
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.llm import abuse, abuse_train, components, conversations, cooccur, encode, names, neardup, packing, pii, pii_train, queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- 1 near duplicates
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def brute(recs, t, least):
    out, b = set(), [(k, i, Counter(WORD.findall((x or "").lower()))) for k, i, x in recs]
    b = [(k, i, c, sum(c.values())) for k, i, c in b if sum(c.values()) >= least]
    for x in range(len(b)):
        for y in range(x):
            if b[x][0] == b[y][0]:
                n = sum((b[x][2] & b[y][2]).values())
                if n >= t * (b[x][3] + b[y][3] - n) - 1e-9:
                    out.add((b[x][0], min(b[x][1], b[y][1]), max(b[x][1], b[y][1])))
    return out


def test_neardup_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    recs, n = [], 0
    for _ in range(120):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 20, 60]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = base[:]
            for _ in range(rng.randint(0, len(w) // 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                rng.shuffle(w)
            recs.append((rng.choice([0, 1]), n, " ".join(w)))
            n += 1
    recs += [(0, n, None), (0, n + 1, ""), (0, n + 2, "too short"), (0, n + 3, "我喜欢吃苹果和香蕉还有梨"), (0, n + 4, "我喜欢吃苹果和香蕉还有梨。")]
    df = spark.createDataFrame(recs, "kind int, id long, text string").withColumn("extra", F.lit(1))
    for t in (0.7, 0.8):
        got = {tuple(r) for r in neardup.NearDuplicates(df, t, 8).record_pairs().collect()}
        want = brute(recs, t, 8)
        assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 30


def test_neardup_copies_and_empty(spark):
    df = spark.createDataFrame([(0, i, "one two three four five six seven eight nine") for i in range(300)], "kind int, id long, text string")
    near = neardup.NearDuplicates(df, 0.8, 8)
    assert near.record_pairs().count() == 300 * 299 // 2 and near.bag_pairs().count() == 0
    c = near.classes().collect()
    assert len(c) == 300 and len({r.class_id for r in c}) == 1
    assert neardup.NearDuplicates(df.limit(0), 0.8, 8).record_pairs().count() == 0
    bare = spark.createDataFrame([(0, 900, None), (0, 901, "?!"), (1, 900, "")], df.schema)
    c = {(r.record_kind, r.id): (r.class_id, r.n_links) for r in neardup.NearDuplicates(df.unionByName(bare), 0.8).classes().collect()}
    assert len(c) == 303 and len({k for k, _ in c.values()}) == 4


def test_prefix_is_shortened_until_the_recall():
    for t in (0.6, 0.7, 0.8, 0.9):
        k = neardup.prefix_depth(t)
        assert neardup.chance(t, k) >= 0.99 and (k == neardup.MAX_DEPTH or neardup.chance(t, k + 1) < 0.99)
    assert neardup.adapted_depth([], 0.7) == neardup.prefix_depth(0.7) == neardup.adapted_depth([0.7] * 900, 0.7) == neardup.adapted_depth([0.99] * 9, 0.7)
    assert neardup.adapted_depth([0.99] * 100, 0.7) == neardup.MAX_DEPTH
    got = neardup.adapted_depth([0.9] * 990 + [0.75] * 10, 0.7)
    assert neardup.prefix_depth(0.7) < got < neardup.MAX_DEPTH
    assert (99 * neardup.chance(0.9, got) + neardup.chance(0.75, got)) / 100 >= neardup.RECALL - 1e-4


# ---- 2 personal information
# carriers and values that occur neither in the training templates nor in the tables
HELD_NAMES = "Hiroshi Tanaka;Olga Petrova;Fatima Al-Rashid;Emma Thompson;Sanjay Gupta;Graham Norton;Marcus Webb;Ingvar Holm;Michael Webb;Louise Pemberton;Rosa Delgado;Viktor Orlov;Noor Rahman;Kenji Matsuda;Beatrice Fontaine;Dmitry Belov;Lucia Marino;Patrick Gallagher;Renate Vogel;Tomas Havel;P. Gallagher;Vogel, Renate;Amina Diallo;Jonas Lindqvist".split(";")
HELD = {
    "person_name": [f"{x}" for x in ("The contract was drafted by {} last winter.", "{} will chair the panel on Tuesday.", "Nobody has seen {} since lunch.", "I owe {} ten euros.", "Could {} review the slides?", "{} and her team won the cup.", "Tickets are held for {} at the door.", "The new tenant is {}.")],
    "email": ["Forward the logs to {} once done.", "My old inbox {} is closed.", "Invoices go to {}, thanks."],
    "phone": ["You can reach the clinic under {}.", "Ring {} when you arrive.", "Our office line is {} now."],
    "id_number": ["The clerk noted passport number {}.", "Her identity card reads {}.", "Please quote national id {} in the form."],
    "street_address": ["The bakery moved to {}.", "Parcels for us go to {}.", "Our new home is {}."],
}
HELD_VALUES = {
    "email": ["hiroshi.tanaka@mail.co.jp", "olga_p@posteo.net", "m.webb+work@corp.example.org", "sgupta77@uni.edu"],
    "phone": ["+1 212 555 0147", "(415) 555-0199", "+49 171 5550123", "020 7946 0018"],
    "id_number": ["AB1234567", "987-65-4320", "X1234567L", "C98765432"],
    "street_address": ["12 Baker Street, London NW1 6XE", "48 Elm Avenue, Springfield, IL 62704", "7 Orchard Lane", "221 Maple Road, Flat 4"],
}


def test_pii_disjoint_names_and_carriers():
    cases = [(c.format(v), k, v) for k, cs in HELD.items() for c in cs for v in (HELD_NAMES if k == "person_name" else HELD_VALUES[k])]
    known = {w for c in (pii_train.NAME, pii_train.MORE) for t in c.values() for w in t.split("|")}
    assert not known & {c.replace("{}", "{N}") for c in HELD["person_name"]} and not set(pii_train.GIVEN.split()) & {n.split()[0] for n in HELD_NAMES}
    got = pii.spans([t for t, _, _ in cases])
    hit = sum((k, v) in {(g, t[a:b]) for a, b, g in found} for (t, k, v), found in zip(cases, got))
    extra = sum((g, t[a:b]) != (k, v) for (t, k, v), found in zip(cases, got) for a, b, g in found)
    print("held out: recall", hit / len(cases), "precision", hit / (hit + extra))
    assert hit / len(cases) > 0.87 and hit / (hit + extra) > 0.87


def test_pii_round_trip_and_held_out():
    rng = random.Random(99)
    hit = total = extra = 0
    for _ in range(400):
        lang = rng.choice(["en", "de", "es", "ru", "zh"])
        bank = rng.choice([pii_train.MAILS, pii_train.PHONES, pii_train.IDS, pii_train.STREETS, pii_train.NAME])
        text, want = pii_train.write(rng.choice(bank[lang].split("|")), lang, rng)
        got = pii.spans([text])[0]
        total += len(want)
        hit += sum(w in got for w in want)
        extra += sum(g not in want for g in got)
    assert hit / total > 0.85 and extra / total < 0.2
    assert pii.spans([None, "", "  ", "hello there"]) == [[], [], [], []]
    assert pii.redact("mail a@b.example now", [(5, 16, "email")]) == "mail [EMAIL] now"
    assert pii.redact(None, []) is None


def test_pii_does_not_depend_on_neighbours():
    texts = ["Lena Dugrafizo", "call me at (555) 019-9704 after six", "x", "ask Hiroshi Tanaka about the tent. " * 30, "word " * 400 + "Lena Dugrafizo wrote"]
    together = pii.spans(texts)
    assert together == [pii.spans([t])[0] for t in texts] and all(together[i] for i in (0, 1, 3))
    assert len(together[3]) == 30


def test_pieces_give_the_path_of_the_whole_sweep():
    rng = np.random.default_rng(5)
    trans = pii.model()["A"]
    for _ in range(40):
        n = int(rng.integers(5, 120))
        e = rng.standard_normal((pii.K, n)).astype(np.float32) * 3
        e[0] += rng.choice([0, 4, 12], n)
        ends = np.array([n - 1])
        e[:, -1] = 0
        whole = pii.viterbi(e[:, :-1].T[:, :, None].copy(), trans)[:, 0]
        assert (pii.decode(e, ends, trans)[:-1] == whole).all()


def test_pii_scores_are_those_of_plain_steps():
    rng = np.random.default_rng(8)
    m, h = pii.model(), pii.HIDDEN
    length = np.sort(np.r_[rng.integers(1, 60, 30), 100])
    ids = rng.integers(0, 466, (100, len(length)))
    got = pii.emissions(m, ids, length)
    for i, n in enumerate(length):
        want = np.tile(m["b"].astype(float), (n, 1))
        for k, d in enumerate("fb"):
            hs = cs = np.zeros(h)
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                z = m["X" + d][ids[t, i]].astype(float) + hs @ m["U" + d]
                a, f, o = np.clip(0.25 * z[: 3 * h] + 0.5, 0, 1).reshape(3, h)
                cs = f * cs + a * np.clip(z[3 * h :], -1, 1)
                hs = o * np.clip(cs, -1, 1)
                want[t] += hs @ m["W"][k * h : (k + 1) * h]
        assert np.abs(got[:n, i] + m["b"] - want).max() < 1e-3


COST = """
import time
import numpy as np
from engramlake.llm import pii
pii.decode = lambda e, ends, trans: e
rng = np.random.default_rng(2)
words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 3000)]
_, x, ends = pii.stream([" ".join(rng.choice(words, n)) for n in rng.integers(4, 24, 6000)])
m, h, u, r = pii.model(), rng.random((512, 24), np.float32), rng.random((24, 96), np.float32), np.empty((512, 96), np.float32)
best = [9e9, 9e9]
for _ in range(6):
    a = time.process_time()
    pii.tag_stream(m, x, ends)
    b = time.process_time()
    for _ in range(2 * len(x) // 512):
        np.dot(h, u, out=r)
    best = [min(best[0], b - a), min(best[1], time.process_time() - b)]
print(best[0] / best[1])
"""


def test_pii_scores_cost_little_beside_their_products():
    """CPU time of the scores, in that of the bare matrix products of the states, on one thread (as in Spark's tasks)."""
    env = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", COST], cwd=root, env=env, capture_output=True, text=True, check=True)
    print("scores cost", ran.stdout.strip(), "times the products")
    assert float(ran.stdout) < 3.95  # 4.2 to 4.5 with gates in columns and kept states, 3.1 to 3.7 now


PLAIN_CUT = re.compile(r"\n+|[!?。！？；]+|\.\s+(?=[^\d\s])|\s\|\s")


def test_segments_are_those_of_the_plain_pattern():
    def plain(text):
        out, at = [], 0
        for a, b in [m.span() for m in PLAIN_CUT.finditer(text)] + [(len(text), len(text))]:
            if text[a : a + 1] == ".":
                if not text[a - 4 : a].isalpha() or pii.SHORT_FORM.search(text, max(at, a - 6), a):
                    continue
                a += 1
            elif text[a : a + 1] not in "\n \t":
                a = b
            if len(t := text[at:a].strip()) > 1:
                out.append((at + text[at:a].index(t[0]), t))
            at = b
        return out

    rng = random.Random(4)
    bits = ["\n", "!", "?", ".", "|", " ", " ", "\t", "a", "Bcde", "Herr", "prof", "7", "。", " | ", ". ", "\u2028", "\x0b", "\xa0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(30_000)]
    assert [pii.segments(t) for t in texts] == [plain(t) for t in texts]


def test_pii_plain(spark):
    m = spark.createDataFrame([(1, "call me at (555) 019-9704 after six", "Lena Dugrafizo"), (1, "call me at (555) 019-9704 after six", "Lena Dugrafizo"), (2, None, None)], "id long, content string, sender_name string")
    d = spark.createDataFrame([(7, "you can write to kodafano19@dibrehi.invalid any time. server 192.0.2.93 answered in 769 ms " * 300), (8, None)], "doc_id long, text string")
    got = rows(pii.find(m, d))
    assert ("message", 1, "content", "phone", "(555) 019-9704") in got and ("message", 1, "sender_name", "person_name", "Lena Dugrafizo") in got
    assert ("document", 7, "text", "email", "kodafano19@dibrehi.invalid") in got and len(got) == 3
    red = {(r.record_kind, r.record_id, r.field): r.text for r in pii.redacted(m, d).collect()}
    assert red[("message", 1, "content")] == "call me at [PHONE] after six" and red[("document", 8, "text")] is None


def test_crf_decoding_is_exact():
    rng = np.random.default_rng(3)
    e, a = rng.standard_normal((6, pii.K, 5)).astype(np.float32), rng.standard_normal((pii.K, pii.K)).astype(np.float32)
    path = pii.viterbi(e, a)  # outside before and after

    def score(p, b):
        if p[0] and p[0] % 2 == 0:
            return -1e9  # no inside after outside
        s = a[0, p[0]] + e[0, p[0], b] + a[p[-1], 0]
        for t in range(1, len(p)):
            if p[t - 1] not in pii.ALLOWED[p[t]]:
                return -1e9
            s += a[p[t - 1], p[t]] + e[t, p[t], b]
        return s

    for b in range(5):
        best = score(path[:, b], b)
        for _ in range(3000):
            q = path[:, b].copy()
            q[rng.integers(0, 6, 2)] = rng.integers(0, pii.K, 2)
            assert score(q, b) <= best + 1e-4


# ---- 3 names
def test_names(spark):
    vals = ["Alexandra Huvopota", " Alexandra  Huvopota.", "Huvopota, Alexandra", "A. Huvopota", "alexandra_huvopota", "Alexandra Huvopta", "Dr. Alexandra Huvopota (mod)", "Boris Huvopota", "Bob Kozejogre", "Robert Kozejogre", "Róbert Kozejogre", None, "", "??"]
    n = spark.createDataFrame([(i, "person", v) for i, v in enumerate(vals)], "id long, node_type string, node_value string").withColumn("rep", F.lit(1))
    o = spark.createDataFrame([(100, "organization", "Bano Fukwabo Foundation Inc."), (101, "organization", "BanoFukwabo Foundation"), (102, "organization", "banofukwabo.example"), (103, "organization", "Foundation Bano Fukwabo"), (104, "organization", "Bano Fukwabo Fdn GmbH"), (105, "organization", "Bano Fukwabo Logistics"), (106, "topic", "Bano Fukwabo Foundation")], n.drop("rep").schema).withColumn("rep", F.lit(1))
    got = set(map(tuple, names.entity_pairs(n.unionByName(o)).collect()))
    want = {(a, b) for g in ([0, 1, 2, 3, 4, 5, 6], [8, 9, 10], [100, 101, 102, 103, 104]) for a in g for b in g if a < b}
    assert got == want
    assert names.entity_pairs(n.limit(0)).count() == 0


def test_names_in_two_scripts(spark):
    vals = ["Irina Kafuvasti", "Ирина Кафувасти.", "И. Кафувасти", "Christopher Nostutani", "Кхристопхер Ностутани", "Priya Joputase", "Прийа Жопутасе", "Lawrence Wogrowe", "Lawrence Vogrove", "Лавренке Вогрове", "Борис Кафувасти", "Ирина Гружазино"]
    n = spark.createDataFrame([(i, "person", v) for i, v in enumerate(vals)], "id long, node_type string, node_value string")
    got = set(map(tuple, names.entity_pairs(n).collect()))
    # one Cyrillic spelling of two Latin names goes to one of them and doesn't join the two
    assert len(got & {(7, 9), (8, 9)}) == 1 and (7, 8) not in got
    assert got - {(7, 9), (8, 9)} == {(0, 1), (0, 2), (1, 2), (3, 4), (5, 6)}


def test_typos():
    assert [names.typos(a, b) for a, b in (("abcd", "abcd"), ("abcd", "abdc"), ("abcd", "abc"), ("abcd", "abxd"), ("abcd", "axxd"), ("", "a"))] == [0, 1, 1, 1, 2, 1]


# ---- 4 conversations
def test_conversations(spark):
    def m(i, s, role, text, t, meta=None, sender="u"):
        return (i, s, role, text, sender, t, meta)

    data = [
        m(1, "a", " USER", "hi", 10.0), m(2, "a", "Bot", "yo", 11_000.0 + 1e12), m(2, "a", "Bot", "yo", 11_000.0 + 1e12), m(9, "a", "ai", "yo", 1e9 + 11.0),
        m(3, "b", "user", "hi", 1.0), m(4, "b", "assistant", " ​", 2.0),
        m(5, "c", "user", "hi", None), m(6, "c", "assistant", "x", 2.0),
        m(7, "d", "narrator", "hi", 1.0), m(8, "d", "assistant", "x", 2.0),
        m(10, "e", "assistant", "x", 1.0), m(11, "e", "user", "x", 2.0),
        m(12, "f", "system", "s", 0.0), m(13, "f", "user", "q", 1.0), m(14, None, "assistant", "answer", 2.0, '{"reply_to": 13}'), m(15, None, "assistant", "lost", 2.0, '{"reply_to": 99}'), m(16, None, "user", "x", 1.0, "{broken reply"), m(19, None, "user", "x", 1.0, '{"reply_to": "abc"}'),
        m(17, "gone", "user", "x", 1.0), m(18, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "id long, session_id string, role string, content string, sender_id string, timestamp double, metadata string").withColumn("turn_no", F.lit(0))
    s = spark.createDataFrame([(x,) for x in "abcdef"] + [(None,)], "session_id string")
    got = rows(conversations.turns(df, s).select("session_id", "turn_no", "message_id"))
    assert got == [("a", 1, 1), ("a", 2, 2), ("f", 1, 13), ("f", 2, 14)]
    assert conversations.turns(df.limit(0), s).count() == 0


def test_conversations_of_links(spark):
    """Rows without a session that answer each other, and quotes between sessions."""
    link = lambda k: '{"reply_to": %d}' % k
    data = [
        (1, "a", "user", "q", 1.0, None), (2, None, "assistant", "r", 2.0, link(1)), (3, "a", "user", "q2", 3.0, '{"quote": 10}'), (4, "a", "assistant", "r2", 4.0, None),
        (10, "b", "user", "x", 1.0, None), (11, "b", "assistant", "y", 2.0, None),
        (20, None, "user", "lonely q", 1.0, None), (21, None, "assistant", "lonely r", 2.0, link(20)), (22, None, "user", "more", 3.0, link(21)), (23, None, "assistant", "end", 4.0, link(22)),
        (30, None, "user", "no answer", 1.0, None),
        (40, None, "user", "both", 5.0, link(4)), (41, None, "assistant", "sides", 6.0, '{"reply_to": 40, "quote": 11}'),
    ]
    df = spark.createDataFrame(data, "id long, session_id string, role string, content string, timestamp double, metadata string").withColumn("sender_id", F.lit("u"))
    s = spark.createDataFrame([("a",), ("b",)], "session_id string")
    got = {}
    for r in conversations.turns(df, s).orderBy("turn_no").collect():
        got.setdefault(r.session_id, []).append(r.message_id)
    # a row's own link decides: 40 answers in a, 41 quotes b
    assert got == {"b": [10, 11, 41], "links:20": [20, 21, 22, 23]}  # a now ends with the user's row 40 and is dropped
    kept = conversations.turns(df.where("id < 40"), s)
    got = {}
    for r in kept.orderBy("turn_no").collect():
        got.setdefault(r.session_id, []).append(r.message_id)
    assert got == {"a": [1, 2, 3, 4], "b": [10, 11], "links:20": [20, 21, 22, 23]}


def test_star_components(spark):
    rng = random.Random(4)
    e = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(60)] + [(None, 3), (5, 5)]
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    want = {x: x for p in e if None not in p and p[0] != p[1] for x in p}
    for _ in range(200):
        for a, b in e:
            if a is not None and b is not None and a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


# ---- 5 co-occurrence
@pytest.mark.parametrize("wide", [3, 64])
def test_pairs_brute_force(spark, wide):
    rng = random.Random(2)
    links = [(r, rng.randrange(30)) for r in range(200) for _ in range(rng.choice([1, 3, 9]))] + [(1, 1), (1, 1), (None, 2), (3, None), (5, 999), (999, 3)]
    n = spark.createDataFrame(links, "entry_id long, node_id long")
    rec, item = spark.range(200), spark.range(30)
    got = rows(cooccur.pair_counts(cooccur.clean_links(n, rec, item, "entry_id", "node_id"), 5, 1.1, wide).select("a", "b", "n_ab", "n_a", "n_b"))
    sets = {}
    for r, i in links:
        if r is not None and i is not None and r < 200 and i < 30:
            sets.setdefault(r, set()).add(i)
    one, two = Counter(i for x in sets.values() for i in x), Counter((a, b) for x in sets.values() for a in x for b in x if a < b)
    want = sorted(((a, b, k, one[a], one[b]) for (a, b), k in two.items() if k >= 5 and k * len(sets) >= 1.1 * one[a] * one[b] and max(one[a], one[b]) * 1.1 <= len(sets)), key=str)
    assert got == want and got


def test_pairs_query_has_every_pair(spark, tmp_path):
    """Rare pairs and those of an item in every entry, from baskets and from a record over the basket width."""
    sets = {r: {0, 1 + r % 7} for r in range(30)} | {30: set(range(80)), 31: {5}}
    spark.createDataFrame([(r, i) for r, x in sets.items() for i in x] + [(0, 0), (None, 1), (1, 999)], "entry_id long, node_id long").write.parquet(f"{tmp_path}/graph_entry_nodes.parquet")
    spark.range(32).write.parquet(f"{tmp_path}/graph_entries.parquet")
    spark.range(80).write.parquet(f"{tmp_path}/graph_nodes.parquet")
    one, two = Counter(i for x in sets.values() for i in x), Counter((a, b) for x in sets.values() for a in x for b in x if a < b)
    got = {(r.node_a, r.node_b): r for r in queries.p5_pairs(spark, str(tmp_path)).collect()}
    assert {k: (r.n_ab, r.n_a, r.n_b) for k, r in got.items()} == {(a, b): (k, one[a], one[b]) for (a, b), k in two.items()}
    assert all(abs(r.lift - r.n_ab * 32 / (r.n_a * r.n_b)) < 1e-5 for r in got.values())


# ---- 6 tokens
def test_encoding():
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    texts = ["", "Hello  world\n\n", "don't we'll  \t x\r\n", "你好，世界 abc", "<|endoftext|> a", "😀👩‍👩‍👧 é ﬁ", "\x1c a \x1d", "a" * 5000, "   ", "1234 56.7%", "x y　z", "Привет, мир"]
    c = encode.codec()
    for t, ids in zip(texts, c.encode_batch(texts)):
        assert ids == tok.encode(t, add_special_tokens=False).ids
        assert c.decode(ids) == t
    assert c.encode(None) == []


def test_encode_table(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in encode.encode_documents(d).collect()}
    assert got[2] == got[3] == [] and len(got[1]) == 2


# ---- 7 packing
def test_packing(spark):
    rng = random.Random(3)
    size = {i: rng.choice([0, 1, 7, 50, 50, 50, 99, 100, 101, 333, 512, 513, 1024]) for i in range(600)}
    sizes = spark.createDataFrame(list(size.items()), "doc_id long, n_tokens long")
    w = spark.createDataFrame([("small", 512), ("tiny", 100), ("bad", 0)], "window_name string, capacity_tokens long")
    for name, cap in (("small", 512), ("tiny", 100)):
        got = [r for r in packing.pack(sizes, w).collect() if r.window_name == name]
        fill, cover = Counter(), {}
        for r in got:
            fill[r.container] += r.n_tokens
            cover.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert max(fill.values()) <= cap
        for i, n in size.items():
            parts = sorted(cover.get(i, []))
            assert sum(p[1] for p in parts) == n and (n > cap or len(parts) == min(1, n))
            assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
        least = -(-sum(size.values()) // cap)
        assert len(fill) <= least * 1.04 + 2
        spans = {}
        for r in got:
            spans.setdefault(r.container, []).append((r.offset, r.offset + r.n_tokens))
        assert all(a[1] <= b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))
        assert rows(packing.pack(sizes, w, stripe=100).where(F.col("window_name") == name).groupBy("doc_id").agg(F.sum("n_tokens"))) == sorted(((i, n) for i, n in size.items() if n), key=str)
    assert packing.pack(sizes.limit(0), w).count() == 0


def test_best_fit_is_that_of_single_documents():
    rng = random.Random(8)
    for cap in (64, 512):
        sizes = sorted((rng.choice([1, 3, rng.randint(1, cap), rng.randint(1, cap // 4)]) for _ in range(3000)), reverse=True)
        gaps, opened = [], 0
        for s in sizes:
            i = bisect.bisect_left(gaps, s)
            if i < len(gaps):
                g = gaps.pop(i)
            else:
                g, opened = cap, opened + 1
            if g > s:
                bisect.insort(gaps, g - s)
        box, at = packing.best_fit(np.array(sizes), cap)
        assert box.max() + 1 <= opened
        fill = Counter()
        for s, b in zip(sizes, box):
            fill[b] += s
        assert max(fill.values()) <= cap


# ---- 8 abuse
def test_abuse_held_out():
    rng = random.Random(77)
    s, y = abuse_train.labelled(rng)
    pick = rng.sample(range(len(s)), 800)
    texts = [s[i].replace("[", "").replace("]", "") for i in pick]
    w, b = abuse.model()
    sc = abuse.document_scores(texts, w, b)
    for c in range(3):
        pos = [k for k, i in enumerate(pick) if y[i] == c]
        assert np.mean(sc[pos, c] > 0) > 0.93
    clean = [k for k, i in enumerate(pick) if y[i] == -1]
    assert np.mean((sc[clean] > 0).any(1)) < 0.04


def test_abuse_table(spark):
    d = spark.createDataFrame([(1, "fine day. you are a worthless idiot, nobody wants you here"), (2, None), (3, ""), (4, "the filter removed a post that called somebody an idiot in Xumo"), (5, "y o u are a w0rthl3ss idiiiot, nobody wants you here")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).withColumn("abusive", F.lit(0))
    sc = abuse.score_documents(d)
    assert rows(abuse.found(sc)) == [(1, "abusive"), (5, "abusive")]
    r = abuse.source_rates(d, sc).first()
    assert r.n_docs == 5 and r.abusive_rate == 0.4


def test_abuse_stop_marks_inside_words():
    w, b = abuse.model()
    pairs = [("what kind of f.i.l.t.h.y. .l.i.a.r are you", "what kind of filthy liar are you"), ("you w|o|r|t|h|l|e|s|s i!d!i!o!t", "you worthless idiot"), ("you are an id!ot and a l|ar", "you are an idiot and a liar"), ("你.是.白.痴", "你是白痴")]
    for disguised, plain in pairs:
        assert (abuse.folded([disguised]) == abuse.folded([plain])).all()
        assert (abuse.document_scores([disguised], w, b) == abuse.document_scores([plain], w, b)).all()
        (i, v), (j, u) = abuse_train.matrix([disguised, plain])
        assert (i == j).all() and (v == u).all()
    # sentences still end, and texts stay apart
    assert list(np.flatnonzero(abuse.folded(["One man. I am! A man", "x", "y"]) <= 2)) == [7, 13, 20, 22, 24]
