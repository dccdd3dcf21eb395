"""The pN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import abuse, conversations, cooccur, encode, names, neardup, packing, pii
from engramlake.session import cut
from engramlake.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neardup.NearDuplicates(neardup.records_of(table(spark, d, "documents"), table(spark, d, "memory_atoms")), threshold=0.7, min_words=8)
    kind = F.when(F.col("kind") == 0, F.lit("document")).otherwise(F.lit("atom"))
    return near.record_pairs().select(kind.alias("record_kind"), "id_a", "id_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    near = neardup.NearDuplicates(neardup.records_of(table(spark, d, "documents"), table(spark, d, "memory_atoms")), threshold=0.8)
    return near.classes()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "messages"), table(spark, d, "documents"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "messages"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_pairs(table(spark, d, "graph_nodes"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_groups(table(spark, d, "graph_nodes"))


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turns(table(spark, d, "messages"), table(spark, d, "sessions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of ``sessions`` only; those that links alone make are in ``p4_turns``."""
    known = table(spark, d, "sessions").select("session_id").distinct()
    return p4_turns(spark, d).select("session_id", "turn_no", "message_id").join(known, "session_id", "left_semi")


def _p5_links(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.clean_links(table(spark, d, "graph_entry_nodes"), table(spark, d, "graph_entries"), table(spark, d, "graph_nodes"), "entry_id", "node_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_counts(_p5_links(spark, d), min_support=5, min_lift=10.0).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs together; the thresholds are those of ``p5_found`` only."""
    return cooccur.scored_pairs(cooccur.pair_counts(_p5_links(spark, d), min_support=1, min_lift=0.0))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_documents(table(spark, d, "documents"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(encode.token_counts(table(spark, d, "documents")))
    return packing.pack(sizes, table(spark, d, "context_windows"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(abuse.score_documents(table(spark, d, "documents")))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.source_rates(docs, abuse.score_documents(docs))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def _links_sql(support: int, lift: float) -> str:
    return f"""
live as (select distinct l.entry_id rec, l.node_id item from graph_entry_nodes l
  where l.entry_id in (select id from graph_entries) and l.node_id in (select id from graph_nodes)),
cnt as (select item, count(*) c from live group by 1),
tot as (select count(distinct rec) n from live),
pairs as (select x.item a, y.item b, count(*) n_ab from live x join live y on x.rec = y.rec and x.item < y.item group by 1, 2 having count(*) >= {support}),
found as (select a, b, n_ab, ca.c n_a, cb.c n_b, n from pairs join cnt ca on ca.item = a join cnt cb on cb.item = b, tot
  where n_ab * n >= {lift} * ca.c * cb.c)"""


_BLANK = r"'[\s\pZ\pC]+'"


def oracle_sql() -> dict[str, str]:
    roles = " ".join(f"when r in ({', '.join(repr(w) for w in ws)}) then '{k}'" for k, ws in conversations.ROLE_WORDS.items())
    p4 = f"""
with m0 as (select id, session_id, sender_id, content, lower(regexp_replace(role, {_BLANK}, '', 'g')) r, "timestamp" ts from messages where session_id in (select session_id from sessions)),
m1 as (select id, session_id, sender_id, content, case {roles} end role, cast(round(case when ts > 1e11 then ts else ts * 1000.0 end) as bigint) at_ms from m0),
m2 as (select session_id, sender_id, at_ms, role, content, min(id) message_id, length(regexp_replace(coalesce(content, ''), {_BLANK}, '', 'g')) = 0 blank from m1 group by 1, 2, 3, 4, 5),
bad as (select session_id from m2 group by 1 having bool_or(at_ms is null or role is null or (blank and role = 'assistant'))),
t as (select session_id, message_id, role, row_number() over (partition by session_id order by at_ms, message_id) turn_no, row_number() over (partition by session_id order by at_ms desc, message_id desc) back
  from m2 where not blank and role in ('user', 'assistant') and session_id not in (select session_id from bad)),
ok as (select session_id from t group by 1 having max(case when turn_no = 1 then role end) = 'user' and max(case when back = 1 then role end) = 'assistant')
select session_id, turn_no, message_id from t where session_id in (select session_id from ok)"""
    return {
        "p4_found": p4,
        "p5_found": f"with {_links_sql(5, 10)} select a node_a, b node_b from found",
        "p5_pairs": f"""with {_links_sql(1, 0)} select a node_a, b node_b, n_ab, n_a, n_b, round(n_a * n_b / cast(n as double), 6) expected,
 round(n_ab * cast(n as double) / (n_a * n_b), 6) lift,
 case when n_ab < n_a then round((1 - n_b / cast(n as double)) / (1 - n_ab / cast(n_a as double)), 6) end conviction from found""",
    }
