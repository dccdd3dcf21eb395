"""Formula and text functions on pinned values."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from engramlake.functions import sqlfuncs, temporal
from engramlake.functions import text as T
from engramlake.operators import memories as M
from engramlake.operators import retrieval as R


def one(spark, col, **vals):
    row = spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in vals.items())) if vals else spark.range(1)
    return row.select(col.alias("x")).first().x


@pytest.mark.parametrize("kind,days,ttl,want", [("linear", 5.0, 10.0, 0.5), ("step", 5.0, 10.0, 1.0), ("step", 12.0, 10.0, 0.05), ("exponential", 10.0, 10.0, 0.25), ("other", 10.0, 10.0, 0.25), ("linear", -3.0, 10.0, 1.0), ("linear", 5.0, 0.0, 0.0)])
def test_decay(spark, kind, days, ttl, want):
    assert one(spark, temporal.decay_score(F.col("k"), F.col("d"), F.col("t")), k=kind, d=days, t=ttl) == pytest.approx(want)


@pytest.mark.parametrize("kind,imp,n,event,want", [("episodic", 0.5, 0, None, 7.0), ("factual", 1.0, 3, None, 351.0), ("planned", 0.8, 0, 7.0, 11.7), ("episodic", 0.0, 0, None, 3.5), ("factual", 0.5, 20, None, 270.0)])
def test_ttl(spark, kind, imp, n, event, want):
    df = spark.createDataFrame([(kind, imp, n, event)], "k string, i double, n long, e double")
    assert df.select(temporal.atom_ttl(F.col("k"), F.col("i"), F.col("n"), F.col("e")).alias("x")).first().x == pytest.approx(want)


def test_relative_dates(spark):
    as_of = 1706745600.0  # Thursday, 2024-02-01
    for text, want in {"大后天见": "2024-02-04", "后天见": "2024-02-03", "昨天": "2024-01-31", "周五开会": "2024-02-02", "周三": "2024-02-07", "下周三": "2024-02-07", "上周一": "2024-02-05", "上周周一": "2024-01-22", "下周": "2024-02-08", "5月30日": "2024-05-30", "1月3号": "2025-01-03", "2月30日": None, "nothing": None}.items():
        assert str(one(spark, temporal.relative_date(F.col("t"), as_of), t=text)) == str(want), text


def test_epoch_and_nulls(spark):
    df = spark.createDataFrame([(1.7e9,), (1.7e12,), (None,), (float("nan"),)], "t double")
    assert [r.x for r in df.select(temporal.epoch_seconds(F.col("t")).alias("x")).collect()] == [1.7e9, 1.7e9, None, None]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="See https://x.example/a the Álpha @bob #tag 你好! a I'm 9") == ["see", "alpha", "你", "好", "im"]
    assert one(spark, T.tokens(F.col("t")), t="") == []
    assert one(spark, T.canonical_entity(F.col("t")), t=" «Ärzte  Bund» ") == "Ärzte Bund"
    assert one(spark, T.canonical_entity(F.col("t")), t="  Bob Ross. ") == "bob ross"
    assert one(spark, T.graph_query_tokens(F.col("t")), t="张三 ok x") == ["张三", "ok", "张三okx", "三o", "kx", "张三o", "三ok", "okx"]


def test_small_text(spark):
    assert one(spark, T.csv_guard(F.col("t")), t="=1+1") == "'=1+1"
    assert one(spark, T.csv_unguard(F.col("t")), t="'=1+1") == "=1+1"
    assert one(spark, T.strip_injected(F.col("t"), "<m>", "</m>"), t="a<m>x\ny</m>\n\n\n\nb") == "a\n\nb"
    assert one(spark, T.text_similarity(F.col("a"), F.col("b")), a="red blue", b="blue green") == pytest.approx(1 / 3)
    assert one(spark, T.text_similarity(F.col("a"), F.col("b")), a="你好吗", b="你好啊") == pytest.approx(1 / 3)
    assert one(spark, T.content_to_text(F.col("t")), t='[{"type":"text","text":"hi"},{"type":"image"},{"type":"text","text":"you"}]') == "hi [image] you"
    assert one(spark, T.content_to_text(F.col("t")), t="[plain") == "[plain"
    assert one(spark, T.parse_list(F.col("t")), t="a, b;a\n\nc") == ["a", "b", "c"]
    assert one(spark, T.truncate_around(F.col("t"), 11, "..."), t="x" * 6 + "y" * 6) == "xxxx...yyyy"


def test_meta(spark):
    df = spark.createDataFrame([('{"importance": "0.4"}',), ('{"importance": 0.9',), (None,), ('{"importance": "high"}',), ('{"importance": [1]}',)], "m string")
    assert [r.x for r in df.select(M.meta_number(F.col("m"), "importance").alias("x")).collect()] == [0.4, None, None, None, None]


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    r = spark.sql("select decay_score('linear', 5D, 10D) a, atom_ttl('factual', 1D, 3L, null) b, jaccard(array('x','y'), array('y')) c, cosine(array(1F,0F), array(1F,0F)) d").first()
    assert (r.a, round(r.b, 6), r.c, r.d) == (0.5, 351.0, 0.5, 1.0)


def test_bm25_against_fts5(spark):
    docs = {1: "alpha beta gamma", 2: "alpha alpha delta", 3: "beta epsilon zeta eta", 4: "alpha", 5: "theta iota kappa Álpha"}
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(doc_id unindexed, body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    con.executemany("insert into t values (?, ?)", docs.items())
    want = {int(a): -b for a, b in con.execute("select doc_id, bm25(t) from t where t match '\"alpha\" OR \"zeta\"'")}
    q = spark.createDataFrame([(1, "alpha zeta")], "query_id long, query string")
    got = {r.doc_id: r.score for r in R.bm25(q, spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    twice = {r.doc_id: r.score for r in R.bm25(spark.createDataFrame([(1, "alpha alpha")], "query_id long, query string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert twice[4] == pytest.approx(2 * want[4], abs=1e-9)
    assert math.isclose(got[3], 0.96677881, abs_tol=1e-8)


def test_empty_corpus(spark):
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert R.bm25(q, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert R.bm25(q, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
