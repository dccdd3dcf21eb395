"""Queries do the whole job: no cut texts, no made-up persons, no id subsets."""

import datetime as dt

import pytest

from engramlake.plans import registry

Q = registry.queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    t = dt.datetime(2023, 1, 1)
    text = "\n".join(f"fact {i}" for i in range(10))
    docs = [(1, text, "en", "s1"), (2, "x | y", "en", "s2"), (3, "z", "en", None), (14, "w", "en", "s3")]
    spark.createDataFrame([(i, x, lang, "src", ss, None, '{"importance": 0.3}', t, t) for i, x, lang, ss in docs], "doc_id long, text string, lang string, source string, session_id string, persona_id string, metadata string, created_at timestamp, updated_at timestamp").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "s1", '["u0", "zed", "amy"]'), (2, "s2", '["u0", "bob"]'), (3, "s3", "{")], "id long, session_id string, participants string").write.parquet(f"{d}/sessions.parquet")
    spark.createDataFrame([(1, 1, "edge", "describes", '{"graph_confidence": 0.5}'), (2, 2, "topic", None, None)], "id long, source_memory_id long, entry_type string, relation_type string, metadata string").write.parquet(f"{d}/graph_entries.parquet")
    spark.createDataFrame([(1, 50), (1, 51), (1, 51), (2, 51), (2, None)], "entry_id long, node_id long").write.parquet(f"{d}/graph_entry_nodes.parquet")
    spark.createDataFrame([(50, "topic", "travel"), (51, "topic", "music")], "id long, node_type string, canonical_value string").write.parquet(f"{d}/graph_nodes.parquet")
    return d


def test_graph_has_all_facts_and_the_sessions_people(spark, tables):
    got = [(r.memory_id, r.entry_type, r.content) for r in Q["graph_entries_extract"](spark, tables).collect()]
    people = {(1, "u0"), (1, "zed"), (1, "amy"), (2, "u0"), (2, "bob")}
    assert {(m, c) for m, k, c in got if k == "participant"} == people
    assert sorted(c for m, k, c in got if k == "fact" and m == 1) == [f"fact {i}" for i in range(8)]
    edges = {(r.source_key, r.target_key) for r in Q["graph_extract"](spark, tables).collect() if r.relation_type == "co_occurs_with"}
    assert edges == {("person:u0", "person:zed"), ("person:amy", "person:u0"), ("person:amy", "person:zed"), ("person:bob", "person:u0")}
    topics = {(m, c) for m, k, c in got if k == "topic"}
    assert topics == {(1, "travel"), (1, "music"), (2, "music")}
    assert [tuple(r) for r in Q["graph_neighbors"](spark, tables).collect()] == [(50, 51, 1.0)]


def test_five_facts_become_atoms_and_merge(spark, tables):
    assert sorted((r.memory_id, r.pos) for r in Q["atomise"](spark, tables).collect()) == [(1, i) for i in range(5)] + [(2, 0), (2, 1), (3, 0), (14, 0)]
    assert {r.group_key: r.text for r in Q["consolidation_merge"](spark, tables).collect()}["s1"] == "；".join(f"fact {i}" for i in range(5))


def test_every_atom_is_reinforced(spark, tmp_path):
    atom = "id long, atom_type string, content string, importance double, confidence double, reinforcement_count long, last_accessed_at double"
    spark.createDataFrame([(i, "episodic", "x", 0.5, 0.6, 0, 1.0) for i in (1, 2, 3, 4)], atom).write.parquet(f"{tmp_path}/memory_atoms.parquet")
    got = {r.id: (r.confidence, r.reinforcements) for r in Q["atom_reinforce"](spark, str(tmp_path)).collect()}
    assert got == {i: (pytest.approx((0.6 * 0.7 + 0.3 * 0.9) * 0.7 + 0.3 * 0.4), 2) for i in (1, 2, 3, 4)}


def test_view_is_of_all_memories(spark, tmp_path):
    spark.createDataFrame([(1, 7, "edge", None, None), (2, 41, "edge", None, None), (3, 900, "fact", None, None)], "id long, source_memory_id long, entry_type string, relation_type string, metadata string").write.parquet(f"{tmp_path}/graph_entries.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "entry_id long, node_id long").write.parquet(f"{tmp_path}/graph_entry_nodes.parquet")
    spark.createDataFrame([(i, "topic", "t", "t") for i in (10, 11, 12)], "id long, node_type string, node_value string, canonical_value string").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    assert {r.node_id for r in Q["graph_subgraph"](spark, str(tmp_path)).collect()} == {10, 11, 12}


def test_transcripts_have_every_line(spark):
    from engramlake.operators import conversation as C

    m = spark.createDataFrame([(i, "s", "user", f"line {i}", None, "u", None, float(i)) for i in range(450)], "id long, session_id string, role string, content string, group_id string, sender_id string, sender_name string, at double")
    got = sorted((r.part, r.text) for r in C.transcripts(m).collect())
    assert [p for p, _ in got] == [0, 1, 2] and "\n".join(t for _, t in got).split("\n") == [f"user: line {i}" for i in range(450)]


def test_rounds_and_context_cross_chunks(spark):
    from engramlake.operators import conversation as C

    m = spark.createDataFrame([(i, "s", "user" if i % 2 == 0 else "assistant", f"m{i}", float(i)) for i in range(41)], "id long, session_id string, role string, content string, at double")
    assert sorted(r.id for r in C.rounds(m, size=7).collect()) == list(range(0, 40, 2))
    got = {r.id: r.expanded for r in C.with_context(m, size=7).collect()}
    assert got == {i: (" | ".join(f"m{k}" for k in range(max(0, i - 4), i)) + " " if i else "") + f"m{i}" for i in range(41)}


def test_communities_reach_the_far_end(spark):
    from engramlake.operators import graph as G

    chain = [(i, i + 1) for i in range(20)]
    e = spark.createDataFrame([*chain, *((0, k) for k in range(100, 105))], "source_key long, target_key long")
    n = spark.createDataFrame([(k, 1.0) for k in [*range(21), *range(100, 105), 999]], "node_key long, weight double")
    got = {r.node_key: r.community for r in G.communities(e, n).collect()}
    assert len(got) == 27 and got[0] == got[100] and got[20] != got[999] and got[999] == max(got.values())


def test_text_index_updates(spark, tmp_path):
    from engramlake.operators import index as IX
    from engramlake.operators import retrieval as R

    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    p = str(tmp_path / "ix")
    IX.build(docs([(1, "violin lessons"), (2, "bread oven"), (3, None)]), p)
    IX.update(docs([(1, "telescope repair")]), p)
    IX.remove(docs([(2, "")]), p)
    q = spark.createDataFrame([(1, "violin"), (2, "telescope"), (3, "bread")], "query_id long, query string")
    got = sorted(tuple(r) for r in IX.search(q, p).select("query_id", "doc_id").collect())
    assert got == [(2, 1)]
    want = {(r.query_id, r.doc_id): r.score for r in R.bm25(q, docs([(1, "telescope repair"), (3, None)])).collect()}
    assert {(r.query_id, r.doc_id): pytest.approx(r.score) for r in IX.search(q, p).collect()} == want


def test_graph_keyword_stages(spark):
    """One memory by text, one by a matched node, one an edge away, one two edges away."""
    from engramlake.operators import graph as G
    from engramlake.operators import retrieval as R

    e = spark.createDataFrame([(1, 10, "violin class"), (2, 20, "x"), (3, 30, "y"), (4, 40, "z")], "id long, source_memory_id long, content string").selectExpr("*", "cast(null as string) session_id", "cast(null as string) persona_id")
    n = spark.createDataFrame([(1, "violin"), (2, "b"), (3, "c")], "id long, canonical_value string")
    l = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "entry_id long, node_id long")
    g = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "source_key long, target_key long, weight double")
    q = spark.createDataFrame([(1, "violin", 10, None, None)], "query_id long, query string, k long, session_id string, persona_id string")
    got = {r.memory_id: (round(r.score, 4), r.trail) for r in G.keyword_search(q, e, l, n, g, R.bm25(q, e.selectExpr("id doc_id", "content text"))).collect()}
    assert got == {10: (1.0, "1"), 20: (0.35, "2"), 30: (0.35, "3"), 40: (0.2, "4")}
    assert 40 not in {r.memory_id for r in G.keyword_search(q, e, l, n, g, R.bm25(q, e.selectExpr("id doc_id", "content text")), hops=1).collect()}


def test_recent_places_come_after_the_policy(spark):
    from pyspark.sql import functions as F

    from engramlake.operators import retrieval as R

    m = spark.createDataFrame([(i, 0.1 if i == 99 else 0.9, 1000.0 + i) for i in range(100)], "memory_id long, importance double, create_time double").selectExpr("*", "'active' status", "'s' session_id", "cast(null as string) persona_id")
    q = spark.createDataFrame([(1, 5, "s", None), (2, 5, None, None), (3, 5, "none", None)], "query_id long, k long, session_id string, persona_id string")
    hits = spark.createDataFrame([(k, i, i + 1) for k in (1, 2, 3) for i in range(5)], "query_id long, doc_id long, rank int")
    got = {}
    for r in R.recent_slots(hits, q, m, 2000.0, keep=F.col("importance") >= 0.5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {1: [0, 1, 2, 98, 97], 2: [0, 1, 2, 98, 97], 3: [0, 1, 2, 3, 4]}


def test_classes(spark):
    from engramlake.functions import temporal

    want = {"明天要开会": "planned", "他喜欢咖啡": "preference", "张三是我的同事": "relational", "总部位于北京": "factual", "参加了活动": "episodic", "hello": "unknown", "明天天气": "unknown", "": "unknown"}
    df = spark.createDataFrame([(k,) for k in want], "c string")
    assert {r.c: r.k for r in df.select("c", temporal.classify(df.c).alias("k")).collect()} == want
