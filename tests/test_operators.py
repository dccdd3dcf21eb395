"""Operators on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from engramlake.operators import atoms as A
from engramlake.operators import conversation as C
from engramlake.operators import graph as G
from engramlake.operators import lifecycle as L
from engramlake.operators import retrieval as R
from engramlake.operators.ranks import bucketed_rank


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rrf_and_route(spark):
    a = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.5)], "query_id long, doc_id long, rank int, score double")
    b = spark.createDataFrame([(1, 2, 1, 0.8), (1, 3, 2, 0.3)], "query_id long, doc_id long, rank int, score double")
    got = {r.doc_id: r.rrf_score for r in R.rrf({"kw": a, "vec": b}).collect()}
    assert got[2] == pytest.approx(1 / 62 + 1 / 61) and max(got, key=got.get) == 2
    q = spark.createDataFrame([(1, "what is x"), (2, "my friend"), (3, "last time"), (4, "hello"), (5, "when did my friend explain")], "query_id long, query string")
    w = {r.query_id: (round(r.w_doc, 4), r.intent) for r in R.route_weights(q).collect()}
    assert w == {1: (0.8, "factual"), 2: (0.45, "relationship"), 3: (0.55, "temporal"), 4: (0.65, "default"), 5: (0.35, "relationship+temporal")}


def test_dual_route_without_graph(spark):
    d = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.2)], "query_id long, doc_id long, score double")
    w = spark.createDataFrame([(1, 0.6, 0.4)], "query_id long, w_doc double, w_graph double")
    none = spark.createDataFrame([], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r.score) for r in R.dual_route(d, none, w).orderBy("rank").collect()] == [(1, 0.4), (2, 0.2)]
    g = spark.createDataFrame([(1, 2, 0.5)], "query_id long, doc_id long, score double")
    got = {r.doc_id: r.score for r in R.dual_route(d, g, w).collect()}
    assert got[2] == pytest.approx(0.6 * 0.5 + 0.4 + 0.08) and got[1] == pytest.approx(0.6)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.995, 0.0998]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    got = R.similar_pairs(v, 0.9).collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1, 2)] and got[0].score == pytest.approx(0.995, abs=1e-3)


def test_mmr(spark):
    h = spark.createDataFrame([(1, 1, 1.0, "a b c"), (1, 2, 0.95, "a b c"), (1, 3, 0.7, "x y z")], "query_id long, doc_id long, score double, text string")
    assert [r.doc_id for r in R.mmr(h, 2).orderBy("rank").collect()] == [1, 3]


def test_edge_merge(spark):
    o = spark.createDataFrame([("a", "b", "r", 1, 0.8, 1.0), ("a", "b", "r", 2, 0.9, 3.0), ("c", "d", "r", 5, 0.5, 2.0)], "source_key string, target_key string, relation_type string, memory_id long, confidence double, weight double")
    got = {r.source_key: r for r in G.merge_edges(o).collect()}
    assert got["a"].confidence == pytest.approx(0.83) and got["a"].weight == pytest.approx(1.45) and got["c"].confidence == 0.5
    many = spark.range(1, 30001).select(F.lit("a").alias("source_key"), F.lit("b").alias("target_key"), F.lit("r").alias("relation_type"), F.col("id").alias("memory_id"), (F.col("id") % 7 / 10).alias("confidence"))
    conf = None
    for i in range(1, 30001):
        conf = i % 7 / 10 if conf is None else 0.7 * conf + 0.3 * (i % 7 / 10)
    assert G.merge_edges(many).first().confidence == pytest.approx(conf)


def test_fold_order(spark):
    h = spark.createDataFrame([(1, 9, 1, 1, 0.5), (1, 9, 2, 1, 0.4), (1, 9, 2, 2, 0.8)], "query_id long, memory_id long, stage int, rank int, score double")
    assert G.fold_hits(h).first().score == pytest.approx(0.8)
    h = spark.createDataFrame([(1, 9, 1, 1, 0.5), (1, 9, 2, 1, 0.4)], "query_id long, memory_id long, stage int, rank int, score double")
    assert G.fold_hits(h).first().score == pytest.approx(0.64)


def test_components_and_hops(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "id_a long, id_b long")
    got = {r.id: r.component for r in G.components(p).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0)], "source_key string, target_key string, weight double")
    s = spark.createDataFrame([(1, "a")], "query_id long, node_key string")
    assert rows(G.two_hop(e, s)) == [(1, "b", 1), (1, "c", 2)]


def test_lifecycle(spark):
    m = spark.createDataFrame([(1, 0.5, 0, 0.0), (2, 1.0, 9, 0.0), (3, 0.5, 10, 999999.0)], "memory_id long, importance double, access_count long, last_access_time double")
    got = {r.memory_id: (r.new_importance, r.new_access_count) for r in L.daily_decay(m, 1_000_000.0, 2, 0.1).collect()}
    assert got == {1: (0.405, 0), 2: (1.0, 9), 3: (0.4513, 5)}  # half up
    a = spark.createDataFrame([(1, "active", 0.0), (2, "active", 40 * 86400.0), (3, "active", 99 * 86400.0), (4, "active", None), (5, "superseded", 0.0)], "id long, status string, expires_at double")
    assert {r.id: r.new_status for r in A.lifecycle(a, 50 * 86400.0).collect()} == {1: "purged", 2: "forgotten", 3: "active", 4: "active", 5: "superseded"}


def test_import_plan(spark):
    e = spark.createDataFrame([(1, "a  b", "s", None), (2, "a b", "s", None), (3, "c", "s", None), (4, "c", "t", None), (5, None, None, None)], "entry_id long, text string, session_id string, persona_id string")
    have = e.where("entry_id = 3")
    assert rows(L.import_plan(e, have)) == [(1, "insert"), (2, "repeated"), (3, "exists"), (4, "insert"), (5, "insert")]


def test_conversation(spark):
    m = spark.createDataFrame([(i, "s", "USER " if i % 2 else "assistant", f"m{i}", "u", None, None, "p", float(i), None) for i in range(1, 6)] + [(5, "s", "USER ", "m5", "u", None, None, "p", 5.0, None), (9, None, None, None, None, None, None, None, None, None)], "id long, session_id string, role string, content string, sender_id string, sender_name string, group_id string, platform string, timestamp double, metadata string")
    c = C.clean(m)
    assert c.count() == 6
    assert [r.id for r in C.last_n(c, 2).orderBy("pos").collect()] == [4, 5]
    s = spark.createDataFrame([("s", 5, '{"last_summarized_index": 2}', 0.0, 0.0)], "session_id string, message_count long, metadata string, created_at double, last_active_at double")
    kept, cur = C.trim(c, s, 4)
    assert sorted(r.id for r in kept.collect()) == [3, 4, 5] and cur.first().cursor == 0
    assert C.rounds(c).count() == 2
    assert C.reconcile(s, c).count() == 0


def test_bucketed_rank(spark):
    d = spark.createDataFrame([(k, float(i), i) for k in ("a", None) for i in range(50)], "k string, at double, id long")
    got = bucketed_rank(d, ["k"], F.floor(F.col("at") / 7), ["at", "id"]).collect()
    assert all(r.pos == r.id + 1 for r in got) and len(got) == 100
