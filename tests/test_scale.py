"""Operators at size: what is shuffled, broadcast or kept grows no faster than needed, and nothing is lost by it."""

import random

from pyspark.sql import functions as F

from engramlake.operators import graph as G
from engramlake.operators import index as IX
from engramlake.operators import retrieval as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_matches_explode_no_node(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abИ日") for _ in range(n))
    values = [(i, word(rnd.randint(0, 9)).upper()) for i in range(400)] + [(400, None), (7, "Aab"), (3, "Aab")]
    toks = [(q, t) for q in range(30) for t in (word(rnd.randint(1, 4)), word(2), "", "A")]
    nodes = spark.createDataFrame(values, "id long, canonical_value string")
    got = G.token_matches(spark.createDataFrame(toks, "query_id long, tok string"), nodes, 5)
    assert "Generate" not in plan(got)  # grams of the nodes were broadcast by the driver
    want = set()
    for q in range(30):
        held = {(len(v), i) for i, v in values if v is not None for p, t in toks if p == q and t and t.lower() in v.lower()}
        want |= {(q, i, r) for r, (_, i) in enumerate(sorted(held)[:5], 1)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_token_matches_rank_by_the_stored_value(spark):
    # lower case makes two characters of this capital; the length is that of the value as stored
    nodes = spark.createDataFrame([(2, "İz"), (1, "iza")], "id long, canonical_value string")
    got = G.token_matches(spark.createDataFrame([(1, "z")], "query_id long, tok string"), nodes, 2)
    assert [(r.node_id, r.rank) for r in got.orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_blocks_of_tokens_and_nodes_lose_nothing(spark, monkeypatch):
    whole = G._value_blocks, G._token_blocks
    nodes = spark.createDataFrame([(i, f"n{i % 7}x{i % 3}") for i in range(60)], "id long, canonical_value string")
    toks = spark.createDataFrame([(i, f"{a}{i}") for i in range(7) for a in "nx"], "query_id long, tok string")
    want = sorted(tuple(r) for r in G.token_matches(toks, nodes, 9).collect())
    monkeypatch.setattr(G, "_value_blocks", lambda n, _: whole[0](n, 4))
    monkeypatch.setattr(G, "_token_blocks", lambda t, _: whole[1](t, 3))
    assert sorted(tuple(r) for r in G.token_matches(toks, nodes, 9).collect()) == want


def test_best_of_blocks_are_the_best_of_all(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rnd.randint(0, 6))) for i in range(300)] + [(300, None), (5, "aa bb")], "doc_id long, text string")
    queries = spark.createDataFrame([(q, text(3), q % 4 + 1) for q in range(40)] + [(40, "zz", 2), (41, None, 2), (42, "aa aa bb", 5)], "query_id long, query string, k long")
    p = R.postings(docs)
    n = docs.selectExpr("count(*) as N", "3.0d as avgdl")
    got = R.bm25_top(queries, p, n, F.col("k"), query_rows=7, doc_rows=20)
    every = R.bm25_of(R.query_terms(queries), p, n).join(queries.select("query_id", "k"), "query_id")
    want = {(r.query_id, r.doc_id, round(r.score, 9)) for r in R.top(every, F.col("k")).collect()}
    assert {(r.query_id, r.doc_id, round(r.score, 9)) for r in got.collect()} == want and len(want) > 80


def test_bm25_search_returns_only_the_best_of_a_block(spark, tmp_path):
    docs = spark.createDataFrame([(i, "aa bb" if i % 2 else "aa") for i in range(2000)], "doc_id long, text string")
    IX.build(docs, str(tmp_path))
    q = spark.createDataFrame([(i, "aa bb", 3) for i in range(50)], "query_id long, query string, k long")
    got = IX.search(q, str(tmp_path), most=F.col("k"))
    assert got.count() == 150  # every match of every query was shuffled: 100,000
    assert "MapInArrow" in plan(got)


def test_entry_search_fetches_the_best_and_keeps_scopes(spark, tmp_path):
    texts = [(i, i % 40, f"s{i % 5}", None, " ".join(["aa"] * (i % 3 + 1) + ["bb"] * (i % 4))) for i in range(200)]
    entries = spark.createDataFrame(texts, "id long, source_memory_id long, session_id string, persona_id string, content string")
    IX.build(entries.select(F.col("id").alias("doc_id"), F.col("content").alias("text")), str(tmp_path))
    q = spark.createDataFrame([(1, "aa", None, None), (2, "bb aa", "s3", None), (3, "bb", None, None)], "query_id long, query string, session_id string, persona_id string")
    rows = lambda df: sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in df.collect())
    got = G.entry_search(lambda x, most: IX.search(x, str(tmp_path), most=most), entries, q, 7)
    assert rows(got) == rows(G.entry_search(IX.search(q, str(tmp_path)), entries, q, 7)) and len(rows(got)) == 21


def test_entries_for_nodes_broadcast_no_grams(spark, tmp_path):
    from engramlake.plans import registry

    d = str(tmp_path)
    spark.createDataFrame([(50, "alpha beta", "alpha beta"), (51, "betamax", "betamax")], "id long, node_value string, canonical_value string").write.parquet(f"{d}/graph_nodes.parquet")
    spark.createDataFrame([(1, 50), (2, 51), (2, 50), (3, None)], "entry_id long, node_id long").write.parquet(f"{d}/graph_entry_nodes.parquet")
    spark.createDataFrame([(1, 1, None, None), (2, 1, None, None)], "id long, source_memory_id long, session_id string, persona_id string").write.parquet(f"{d}/graph_entries.parquet")
    got = registry.queries()["entries_for_nodes"](spark, d)
    assert "gram" not in plan(got).replace("Program", "")
    assert [(r.entry_id, r.hits, r.score) for r in got.orderBy("rank").collect()] == [(2, 2, 0.65), (1, 1, 0.5)]


def test_entries_of_shared_nodes_are_not_joined(spark):
    rnd = random.Random(3)
    links = [(e, 0) for e in range(400)] + [(rnd.randint(0, 420), rnd.randint(1, 9)) for _ in range(900)] + [(5, 3), (5, 3), (6, None), (None, 2)]
    entries = [(e, e % 50 or None, f"s{e % 3}", None if e % 2 else "p") for e in range(410)]  # some links lead to deleted entries
    hits = [(q, n) for q in range(40) for n in {0, q % 10, q * 7 % 10, 99}]
    queries = [(q, "s1" if q % 5 == 1 else None, "p" if q % 5 == 2 else None) for q in range(40)]
    e = spark.createDataFrame(entries, "id long, source_memory_id long, session_id string, persona_id string")
    args = spark.createDataFrame(hits, "query_id long, node_id long"), spark.createDataFrame(links, "entry_id long, node_id long"), e, 12
    scope = spark.createDataFrame(queries, "query_id long, session_id string, persona_id string")

    def want(scoped):
        out = set()
        for q, s, p in queries:
            nodes = {n for i, n in hits if i == q}
            held = [(len({n for i, n in links if i == x and n in nodes}), x, m) for x, m, es, ep in entries if not scoped or (s in (None, es) and p in (None, ep))]
            out |= {(q, x, m, h, r) for r, (h, x, m) in enumerate(sorted((t for t in held if t[0]), reverse=True, key=lambda t: t[:2])[:12], 1)}
        return out

    for queried in (None, scope):
        got = G.entries_of_nodes(*args, queried)
        assert {(r.query_id, r.entry_id, r.source_memory_id, r.hits, r["rank"]) for r in got.collect()} == want(queried is not None)
        # every link of the common node was joined with every query: 16,000 rows of it alone
        assert "MapInArrow" in plan(got)


def test_index_exchanges_texts_not_postings(spark, tmp_path, monkeypatch):
    seen = []
    kind = type(spark.range(1))
    whole = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda self, *c: seen.append(plan(whole(self, *c))) or whole(self, *c))
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, "  "), (4, "cc"), (4, "cc aa"), (5, "bb"), (5, "bb")], "doc_id long, text string")
    IX.build(docs, str(tmp_path))
    # it exchanged partial counts by term and document, then the postings by bucket
    assert len(seen) == 1 and seen[0].count("Exchange") == 1 and "term" not in next(x for x in seen[0].splitlines() if "Exchange" in x)
    size = spark.read.parquet(f"{tmp_path}/docs")
    assert sorted(tuple(r) for r in size.select("doc_id", "dl", "segment").collect()) == [(1, 3, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (4, 2, 0), (5, 1, 0), (5, 1, 0)]
    got = spark.read.parquet(f"{tmp_path}/postings").where("term is not null")
    assert sorted(tuple(r) for r in got.select("term", "doc_id", "dl", "tf").collect()) == [("aa", 1, 3, 2), ("aa", 4, 2, 1), ("bb", 1, 3, 1), ("bb", 5, 1, 2), ("cc", 4, 1, 1), ("cc", 4, 2, 1)]


def test_parts_that_return_their_best_do_not_grow_with_the_postings(spark):
    docs = spark.createDataFrame([(i, "aa bb") for i in range(3000)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "aa", 5)], "query_id long, query string, k long")
    n = docs.selectExpr("count(*) as N", "2.0d as avgdl")
    got = R.bm25_top(q, R.postings(docs), n, F.col("k"))
    blocks = [x for x in plan(got).splitlines() if "Exchange hashpartitioning(doc_id" in x and f", {2 * spark.sparkContext.defaultParallelism})" in x]
    assert blocks and "REPARTITION_BY_NUM" in blocks[0]  # the number of parts followed the size of the shuffle
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3, 4]
