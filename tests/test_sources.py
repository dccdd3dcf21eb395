"""Round trips, generations, repair and streams."""

import json

import pytest
from pyspark.sql import functions as F

from engramlake.sources import repair, transfer
from engramlake.sources.generations import Store
from engramlake.streaming import streams as S


def test_json_shapes(spark, tmp_path):
    shapes = [[{"content": "a", "importance": 0.7}], {"data": [{"text": "b"}]}, {"x1": {"content": "c"}}, [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], {"content": "d", "importance": "bad"}, []]
    for i, s in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text("﻿" + json.dumps(s), encoding="utf-8")
    got = sorted((r.text, r.importance) for r in transfer.read_json(spark, f"{tmp_path}/*.json").collect())
    assert got == [("a", 0.7), ("b", 0.5), ("c", 0.5), ("d", 0.5), ("user: hi\nassistant: yo", 0.5)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, '=SUM(1) "q", é\nline'), (2, "plain"), (3, None)], "id long, text string")
    transfer.write_csv(df, f"{tmp_path}/c")
    got = {int(r.id): r.text for r in transfer.read_csv(spark, f"{tmp_path}/c").collect()}
    assert got == {1: '=SUM(1) "q", é\nline', 2: "plain", 3: None}


def test_generations(spark, tmp_path):
    st = Store(spark, f"{tmp_path}/g")
    a = st.publish(spark.range(10).toDF("id"), {"model": "x"})
    b = st.publish(spark.range(12).toDF("id"), {"model": "y"}, expected=12)
    assert st.read().count() == 12 and st.changed({"model": "x"}) and not st.changed({"model": "y"})
    with pytest.raises(RuntimeError):
        st.publish(spark.range(5).toDF("id"), expected=12)
    assert st.read().count() == 12
    st.restore(a)
    assert st.read().count() == 10 and [g["n"] for g in st.list()] == [b, a]


def test_repair(spark):
    assert json.loads(repair.repair('x ```json\n{"summary": "s", "topics": ["a",],}\n``` y')) == {"summary": "s", "topics": ["a"]}
    assert json.loads(repair.repair('{"summary": "cut off he')) == {"summary": "cut off he"}
    assert repair.repair("no json") is None and repair.repair(None) is None
    df = spark.createDataFrame([('{"summary": "s", "topics": ["1","2","3","4","5","6"], "importance": 7, "sentiment": "odd"}',), (None,)], "raw string")
    a, b = [r.v for r in repair.repaired(df, "raw").select(repair.with_defaults(F.col("fixed")).alias("v")).collect()]
    assert (len(a.topics), a.importance, a.sentiment) == (5, 1.0, "neutral") and (b.summary, b.importance) == ("", 0.5)


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5, "click", 1.0), (1, "2024-01-01 00:01:00", 5, "click", 1.0), (2, "2024-01-01 03:00:00", 5, "view", 2.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/e")
    src = lambda: spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    assert sorted(r.event_id for r in run(spark, S.dedup_stream(src(), ["event_id"]), "d1").collect()) == [1, 2]
    assert S.dedup_batch(e, ["event_id"]).count() == 2
    assert run(spark, S.tumbling(src()), "t1", "complete").count() == S.tumbling(e).count() == 2
    assert S.sessions(e).count() == 2


def test_summary_trigger(spark, tmp_path):
    m = spark.createDataFrame([(i, "a" if i < 45 else "b") for i in range(50)], "id long, session_id string")
    m.write.parquet(f"{tmp_path}/m")
    src = spark.readStream.schema(m.schema).parquet(f"{tmp_path}/m")
    got = sorted(map(tuple, run(spark, S.summary_triggers(src, 10), "trig").collect()))
    assert got == [("a", 0, 20), ("a", 20, 40)]
