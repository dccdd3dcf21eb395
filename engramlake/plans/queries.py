"""The core queries over the project's tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.config import AS_OF, ATOM_CONFIDENCE, ATOM_PATTERNS, FACTUAL_TERMS, FOLD_FROM, FOLD_TO, RELATION_TERMS, STOP_WORDS, TEMPORAL_TERMS, TTL_BASE
from engramlake.functions import temporal
from engramlake.functions import text as T
from engramlake.operators import atoms as A
from engramlake.operators import conversation as C
from engramlake.operators import graph as G
from engramlake.operators import index as IX
from engramlake.operators import lifecycle as L
from engramlake.operators import memories as M
from engramlake.operators import retrieval as R
from engramlake.session import fingerprint, stored
from engramlake.streaming import streams as S
from engramlake.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- pieces of SQL -------------------------------------------------------------------------------
def fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}')"


def collapse_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\t\n\x0B\f\r \p{{Z}}]+', ' ', 'g'), ' ')"


def noise_sql(x: str) -> str:
    return f"regexp_replace({x}, {quoted(T.NOISE)}, '', 'g')"


def clean_sql(x: str) -> str:
    return collapse_sql(noise_sql(x))


def tokens_sql(x: str) -> str:
    stop = ", ".join(map(quoted, STOP_WORDS))
    words = f"list_filter(regexp_extract_all({noise_sql(x)}, '{T.WORD}'), lambda w: not (regexp_matches(w, '^[ -~]$') or w in ({stop})))"
    return f"list_transform({words}, lambda w: {fold_sql('w')})"


def canonical_sql(x: str) -> str:
    v = collapse_sql(rf"regexp_replace({x}, '^[\s\p{{P}}]+|[\s\p{{P}}]+$', '', 'g')")
    return rf"(case when regexp_matches({v}, '^[\x00-\x7F]*$') then lower({v}) else {v} end)"


def meta_sql(key: str, col: str = "metadata") -> str:
    return f"json_extract_string(case when json_valid({col}) then {col} end, '$.{key}')"


def number_sql(key: str, col: str = "metadata") -> str:
    v = f"try_cast({meta_sql(key, col)} as double)"
    return f"(case when isfinite({v}) then {v} end)"


MEM = f"""mem as (select doc_id memory_id, text, session_id, persona_id, source, lang,
 least(1.0::double, greatest(0.0::double, coalesce({number_sql('importance')}, 0.5::double))) importance, epoch(created_at) create_time,
 coalesce({number_sql('last_access_time')}, 0.0::double) last_access_time,
 cast(least(1000000, greatest(0, floor(coalesce({number_sql('access_count')}, 0)))) as bigint) access_count,
 coalesce(nullif({meta_sql('status')}, ''), 'active') status, coalesce({meta_sql('memory_type')}, 'GENERAL') memory_type, {meta_sql('kind')} kind from documents)"""
FACTS = r"list_filter(list_transform(string_split_regex(text, '\n| \| |；'), lambda s: trim(s, ' ')), lambda s: s <> '')"
NODEQ = "q as (select id query_id, node_value query, cast(10 as bigint) k, cast(null as varchar) session_id, cast(null as varchar) persona_id from graph_nodes where id % 50 = 0 and node_value is not null)"
SCOPEDQ = "q as (select id query_id, node_value query, cast(10 as bigint) k, cast(null as varchar) session_id, 'p_lumi' persona_id from graph_nodes where id % 50 = 0 and node_value is not null)"


def bm_sql(docs: str, p: str = "") -> str:
    """CTEs over ``docs(doc_id, text)`` and ``q`` up to ``bm``; ``p`` is a prefix of their names."""
    return f"""{p}qt as (select query_id, unnest({tokens_sql('query')}) term from q), {p}dt as (select doc_id, {tokens_sql('text')} toks from {docs}),
{p}post as (select term, doc_id, dl, count(*) tf from (select doc_id, len(toks) dl, unnest(toks) term from {p}dt where len(toks) > 0) group by 1, 2, 3),
{p}st as (select count(*) n_all, avg(coalesce(len(toks), 0)) avgdl from {p}dt), {p}dfs as (select term, count(*) df from {p}post group by 1),
{p}bm as (select query_id, doc_id, sum(greatest(ln((n_all - df + 0.5::double) / (df + 0.5::double)), 1e-6::double) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) score
 from {p}qt join {p}post using (term) join {p}dfs using (term), {p}st group by 1, 2)"""


def rank_sql(src: str, score: str = "score", by: str = "query_id", tie: str = "doc_id") -> str:
    return f"row_number() over (partition by {by} order by round({score}, 9) desc, {tie})"


def minmax_sql(src: str) -> str:
    return f"select * replace (case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0::double end as score) from {src} window w as (partition by query_id)"


def search_sql() -> str:
    """CTEs up to ``hits``: the BM25 search over mem."""
    return f"""docs as (select memory_id doc_id, text from mem), {bm_sql('docs')},
pre as (select bm.*, q.k, q.session_id q_s, q.persona_id q_p, {rank_sql('bm')} r0 from bm join q using (query_id)),
flt as (select pre.query_id, pre.doc_id, pre.score, pre.k from pre join mem on mem.memory_id = pre.doc_id where r0 <= case when q_s is not null or q_p is not null then k * 10 else k * 2 end
 and status = 'active' and (q_s is null or session_id = q_s) and (q_p is null or persona_id = q_p)),
tops as (select * from (select *, {rank_sql('flt')} rank from flt) where rank <= k), hits as ({minmax_sql('tops')})"""


EMB = "vec as (select vec_id, embedding::double[] e from embeddings)"
VHITS = f"""vq as (select vec_id query_id, e from vec where vec_id % 50 = 0), vs as (select query_id, vec.vec_id doc_id, list_dot_product(vq.e, vec.e) score from vq, vec where vec.vec_id in (select memory_id from mem where status = 'active')),
vhits as (select * from (select *, {rank_sql('vs')} rank from vs) where rank <= 20)"""


# ---- shared inputs -------------------------------------------------------------------------------
def mems(s: SparkSession, d: str) -> DataFrame:
    return M.memories(s, d)


def text_index(s: SparkSession, d: str, name: str) -> str:
    """The folder of the text index of documents, graph entries or current atoms; built once for their files."""
    docs = {
        "documents": lambda: table(s, d, "documents").select("doc_id", "text"),
        "graph_entries": lambda: table(s, d, "graph_entries").select(F.col("id").alias("doc_id"), F.col("content").alias("text")),
        "memory_atoms": lambda: A.current(table(s, d, "memory_atoms")).select(F.col("id").alias("doc_id"), F.col("content").alias("text")),
    }[name]
    return stored(s, f"text2-{name}", fingerprint(s, f"{d}/{name}.parquet"), lambda p: IX.build(docs(), p))


def text_scores(s: SparkSession, d: str, name: str, q: DataFrame) -> DataFrame:
    return IX.search(q, text_index(s, d, name))


def text_top(s: SparkSession, d: str, name: str) -> R.Scorer:
    """The index as a function of queries and of how many are wanted of each."""
    return lambda q, most: IX.search(q, text_index(s, d, name), most=most)


def node_queries(s: SparkSession, d: str, persona: str | None = None) -> DataFrame:
    """Every fiftieth node's value as a query."""
    n = table(s, d, "graph_nodes").where("id % 50 = 0 and node_value is not null")
    return n.select(F.col("id").alias("query_id"), F.col("node_value").alias("query"), F.lit(10).cast("long").alias("k"), F.lit(None).cast("string").alias("session_id"), F.lit(persona).cast("string").alias("persona_id"))


def msgs(s: SparkSession, d: str) -> DataFrame:
    return C.clean(table(s, d, "messages"))


MSG = """msg as (select distinct on (id) id, session_id, lower(trim(role, ' ')) role, content, sender_id, sender_name, group_id, platform, metadata, case when isnan("timestamp") then null when "timestamp" > 1e11 then "timestamp" / 1000 else "timestamp" end tm from messages where id is not null)"""
ATOM = "atom as (select * exclude (r) from (select *, row_number() over (partition by id order by last_accessed_at desc nulls last, reinforcement_count desc nulls last, content asc nulls last) r from memory_atoms where id is not null) where r = 1)"


# ---- memories ------------------------------------------------------------------------------------
@query(f"with {MEM} select memory_id, text, importance, status from mem where memory_id = 7")
def mem_point(s, d):
    return mems(s, d).where("memory_id = 7").select("memory_id", "text", "importance", "status")


@query(f"with {MEM} select memory_id, session_id, persona_id, round(importance, 6) importance from mem where status = 'active' and persona_id = 'p_lumi'")
def mem_filter_scope(s, d):
    return M.scoped(M.active(mems(s, d)), persona_id="p_lumi").select("memory_id", "session_id", "persona_id", F.round("importance", 6).alias("importance"))


@query(f"with {MEM}, t as (select * from mem where contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'pottery')), n as (select count(*) total from t) select memory_id, total, total > 40 has_more from t, n order by create_time desc, memory_id limit 20 offset 20")
def mem_list_page(s, d):
    return M.list_page(mems(s, d), keyword="Pottery", page=2).select("memory_id", "total", "has_more")


@query(f"with {MEM} select count(*) total, count(*) filter (status = 'active') n_active, count(*) filter (status = 'archived') n_archived, count(*) filter (status not in ('active', 'archived')) n_other, count(distinct session_id) n_sessions, round(avg(importance), 6) avg_importance, round(min(create_time), 3) oldest, round(max(create_time), 3) newest from mem")
def mem_stats(s, d):
    return M.statistics(mems(s, d))


@query(f"with {MEM} select cast(least(9, floor(importance * 10)) as bigint) bucket, count(*) n from mem group by 1")
def importance_hist(s, d):
    return M.importance_histogram(mems(s, d))


@query(f"with {MEM} select session_id, count(*) n from mem where session_id is not null group by 1 order by n desc, session_id limit 10")
def session_top10(s, d):
    return M.top_sessions(mems(s, d))


@query(f"with {MEM}, r as (select session_id, memory_id, create_time, row_number() over (partition by session_id order by create_time desc, memory_id) r from mem where session_id is not null) select session_id, memory_id, r from r where r <= 5")
def session_recent(s, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("create_time"), "memory_id")
    return mems(s, d).where("session_id is not null").withColumn("r", F.row_number().over(w)).where("r <= 5").select("session_id", "memory_id", "r")


@query(f"with {MEM} select m.memory_id, m.source, c.platform, c.kind source_kind from mem m left join capture_sources c on c.source = m.source")
def transfer_records(s, d):
    c = table(s, d, "capture_sources").select("source", "platform", F.col("kind").alias("source_kind"))
    return mems(s, d).join(c, "source", "left").select("memory_id", "source", "platform", "source_kind")


@query(f"with {MEM} select memory_id from mem where status = 'active' and {AS_OF} - create_time > 30 * 86400.0 and importance < 0.3")
def cleanup_candidates(s, d):
    return M.cleanup_candidates(mems(s, d), AS_OF).select("memory_id")


@query(f"with {MEM}, c as (select * from mem where status = 'active' and importance < 0.5 and create_time < {AS_OF} - 7 * 86400.0 and session_id is not null) select session_id, count(*) n, min(memory_id) first_id from c group by 1 having count(*) >= 3 order by n desc, session_id limit 5")
def consolidation_groups(s, d):
    return L.consolidation_groups(M.consolidation_candidates(mems(s, d), AS_OF))


@query(f"with {MEM} select memory_id, round(least(10.0, greatest(0.0, case when importance <= 1 then importance * 10 else importance end)), 2) shown from mem")
def importance_display(s, d):
    return mems(s, d).select("memory_id", M.importance_display(F.col("importance")).alias("shown"))


@query(f"with {MEM}, f as (select memory_id, trim(lang, ' ') l, list_slice({FACTS}, 1, 5) facts from mem where text is not null) select memory_id, case when len(facts) > 0 then concat_ws(' | ', l, array_to_string(list_slice(facts, 1, 5), '；')) else l end stored from f")
def storage_format(s, d):
    m = mems(s, d).where("text is not null").select("memory_id", F.trim("lang").alias("l"), M.facts_of(F.col("text")).alias("facts"))
    return m.select("memory_id", M.storage_format(F.col("l"), F.col("facts")).alias("stored"))


@query(f"with {MEM}, f as (select memory_id, text, importance, {FACTS} facts from mem) select memory_id, case when length(coalesce(text, '')) < 10 or len(facts) < 1 or facts is null or coalesce(regexp_matches(text, '(?i)^(chat|talk|conversation|聊天|对话)$'), false) then 'low' else 'normal' end label from f")
def quality_label(s, d):
    m = mems(s, d)
    facts = F.coalesce(M.facts_of(F.col("text")), F.array().cast("array<string>"))
    return m.select("memory_id", M.quality_label(F.col("text"), facts, F.col("importance")).alias("label"))


@query(f"with {MEM}, t as (select unnest({tokens_sql('text')}) token from mem) select token, count(*) n from t group by 1")
def token_freq(s, d):
    return M.token_frequency(mems(s, d))


@query(f"with {MEM} select memory_id, {clean_sql('text')} cleaned from mem")
def text_clean(s, d):
    return mems(s, d).select("memory_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(f"select id, {canonical_sql('node_value')} canonical from graph_nodes")
def entity_canonical(s, d):
    return table(s, d, "graph_nodes").select("id", T.canonical_entity(F.col("node_value")).alias("canonical"))


@query(rf"""with b as (select id, lower({collapse_sql('node_value')}) low from graph_nodes where node_value is not null), c as (select id, low, regexp_replace(low, '[^\p{{L}}\p{{N}}_]', '', 'g') compact from b),
t as (select id, list_concat(list_filter(regexp_extract_all(low, '([\p{{L}}\p{{N}}_]+)', 1), lambda w: length(w) >= 2), case when regexp_matches(compact, '[^\x00-\x7F]') then list_concat(list_filter([compact], lambda w: length(w) >= 2),
 list_concat(case when length(compact) >= 2 then list_transform(range(1, length(compact)), lambda i: substr(compact, i, 2)) else [] end, case when length(compact) >= 3 then list_transform(range(1, length(compact) - 1), lambda i: substr(compact, i, 3)) else [] end)) else [] end) a from c),
u as (select id, unnest(a) tok, generate_subscripts(a, 1) pos from t), f as (select id, tok, min(pos) pos from u group by 1, 2), r as (select *, row_number() over (partition by id order by pos) n from f)
select id, n, tok from r where n <= 12""")
def graph_query_tokens(s, d):
    n = table(s, d, "graph_nodes").where("node_value is not null").select("id", F.posexplode(T.graph_query_tokens(F.col("node_value"))).alias("n", "tok"))
    return n.select("id", (F.col("n") + 1).alias("n"), "tok")


@query(f"with {MEM} select memory_id, case when length(text) > 200 then concat(left(text, 97), chr(10) || '...' || chr(10), right(text, 98)) else text end cut, case when length({collapse_sql('text')}) > 64 then left({collapse_sql('text')}, 64) || '...' else {collapse_sql('text')} end short from mem")
def text_truncate(s, d):
    return mems(s, d).select("memory_id", T.truncate_around(F.col("text"), 200).alias("cut"), T.history_text(F.col("text")).alias("short"))


@query(f"with {MEM} select memory_id, sha1(concat_ws('|', coalesce({collapse_sql('text')}, ''), coalesce(session_id, ''), coalesce(persona_id, ''))) key from mem")
def content_keys(s, d):
    return mems(s, d).select("memory_id", L.import_key(F.col("text"), F.col("session_id"), F.col("persona_id")).alias("key"))


@query(r"select id, case when regexp_matches(content, '^[=+\-@\t\r]') then '''' || content else content end cell from messages")
def csv_escape(s, d):
    return table(s, d, "messages").select("id", T.csv_guard(F.col("content")).alias("cell"))


ALLOWED = ["U202", "aiocqhttp:U45", "group-700100", "Slack:FriendMessage:100353"]
ALLOW_SQL = " or ".join(f"coalesce(list_contains([{', '.join(quoted(a.lower()) for a in ALLOWED)}], lower({c})), false)" for c in ("sender_id", "session_id", "group_id", "concat_ws(':', platform, sender_id)"))


@query(f"select distinct id, {ALLOW_SQL} ok from messages where sender_id is not null")
def allow_list(s, d):
    m = table(s, d, "messages").where("sender_id is not null")
    return m.select("id", M.allowed(F.col("sender_id"), F.col("platform"), F.col("session_id"), F.col("group_id"), ALLOWED).alias("ok")).distinct()


@query("""with named as (select * from messages where sender_id is not null and sender_name is not null), al as (select platform || ':' || sender_id alias, min(sender_name) || ' (account)' "identity" from named where platform <> 'slack' group by 1
 union all select sender_id, min(sender_name) || ' (id)' from named where platform = 'slack' group by 1 union all select sender_name, min(sender_name) || ' (name)' from named group by 1),
a as (select lower(alias) k, min("identity") "identity" from al group by 1)
select distinct m.id, coalesce(a0."identity", a1."identity", a2."identity", m.sender_id) "identity" from messages m left join a a0 on a0.k = lower(concat_ws(':', m.platform, m.sender_id)) left join a a1 on a1.k = lower(m.sender_id) left join a a2 on a2.k = lower(m.sender_name) where m.id is not null""")
def alias_resolve(s, d):
    """Aliases by account, by id (of one platform's senders) and by name; the first that is known wins."""
    m = table(s, d, "messages").where("id is not null")
    named = m.where("sender_id is not null and sender_name is not null")
    tag = lambda df, key, note: df.groupBy(key.alias("alias")).agg(F.concat(F.min("sender_name"), F.lit(note)).alias("identity"))
    a = tag(named.where("platform <> 'slack'"), F.concat_ws(":", "platform", "sender_id"), " (account)").unionByName(tag(named.where("platform = 'slack'"), F.col("sender_id"), " (id)")).unionByName(tag(named, F.col("sender_name"), " (name)"))
    return M.resolve_aliases(m.select("id", "platform", "sender_id", "sender_name"), a).select("id", "identity").distinct()


@query(f"with {MEM} select memory_id, coalesce(persona_id, session_id) scope from mem")
def scope_resolve(s, d):
    return mems(s, d).select("memory_id", M.resolve_scope("user", F.col("session_id"), F.col("persona_id")).alias("scope"))


@query(f"with {MEM} select memory_id, format('- [{{}}] ({{:.2f}}) {{}}', memory_type, importance, case when length({collapse_sql('text')}) > 64 then left({collapse_sql('text')}, 64) || '...' else coalesce({collapse_sql('text')}, '') end) line from mem")
def render_memories(s, d):
    return M.render_lines(mems(s, d))


# ---- retrieval -----------------------------------------------------------------------------------
@query(f"with {MEM}, {NODEQ}, {search_sql()} select query_id, doc_id, rank, round(score, 6) score from hits")
def bm25_topk(s, d):
    q = node_queries(s, d)
    return R.bm25_search(q, mems(s, d), scores=text_top(s, d, "documents")).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"with {MEM}, {SCOPEDQ}, {search_sql()} select query_id, doc_id, rank, round(score, 6) score from hits")
def bm25_scoped(s, d):
    q = node_queries(s, d, "p_lumi")
    return R.bm25_search(q, mems(s, d), scores=text_top(s, d, "documents")).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"with {MEM}, {EMB}, {VHITS} select query_id, doc_id, rank, round(score, 6) score from vhits where rank <= 10")
def vector_topk(s, d):
    v = table(s, d, "embeddings").join(mems(s, d).where("status = 'active'").select(F.col("memory_id").alias("vec_id")), "vec_id", "left_semi")
    return R.vector_topk(vec_queries(s, d), v, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def vec_queries(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector as a query."""
    return table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"with {EMB}, p as (select a.vec_id x, b.vec_id y, list_dot_product(a.e, b.e) score, row_number() over (partition by a.vec_id order by round(list_dot_product(a.e, b.e), 9) desc, b.vec_id) r from vec a, vec b where a.vec_id <> b.vec_id) select least(x, y) id_a, greatest(x, y) id_b, round(max(score), 6) score from p where r <= 5 and score >= 0.35 group by 1, 2")
def similar_pairs(s, d):
    return R.similar_pairs(table(s, d, "embeddings"), 0.35).select("id_a", "id_b", F.round("score", 6).alias("score"))


def hybrid_queries(s: SparkSession, d: str) -> DataFrame:
    """A text (the content of an entry) for every fiftieth vector."""
    n = table(s, d, "graph_entries").where("content is not null").select((F.col("id") - 2).alias("query_id"), F.col("content").alias("query"))
    return vec_queries(s, d).select("query_id").join(n, "query_id").select("query_id", "query", F.lit(10).cast("long").alias("k"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("persona_id"))


def any_sql(terms: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(query), {quoted(t)})" for t in terms) + ")"


INTENT = f"""fl0 as (select *, {any_sql(RELATION_TERMS)} rel, {any_sql(TEMPORAL_TERMS)} tem, {any_sql(FACTUAL_TERMS)} fac from iq),
sh as (select *, (case when rel then 0.2::double else 0 end) + (case when tem then 0.1::double else 0 end) - (case when fac and not rel then 0.15::double else 0 end) sft from fl0),
wt as (select *, greatest(0.15::double, least(0.9::double, 0.65::double - sft)) wd, greatest(0.1::double, least(0.85::double, 0.35::double + sft)) wg from sh),
route as (select query_id, wd / (wd + wg) w_doc, wg / (wd + wg) w_graph, coalesce(nullif(concat_ws('+', case when rel then 'relationship' end, case when tem then 'temporal' end, case when fac and not rel then 'factual' end), ''), 'default') intent from wt)"""


@query(f"with iq as (select distinct id query_id, content query from messages where content is not null), {INTENT} select query_id, round(w_doc, 6) w_doc, round(w_graph, 6) w_graph, intent from route")
def intent_route(s, d):
    q = table(s, d, "messages").where("content is not null").select(F.col("id").alias("query_id"), F.col("content").alias("query")).distinct()
    return R.route_weights(q).select("query_id", F.round("w_doc", 6).alias("w_doc"), F.round("w_graph", 6).alias("w_graph"), "intent")


TOKQ = rf"""nb as (select query_id, lower({collapse_sql('query')}) low from q), nc as (select query_id, low, regexp_replace(low, '[^\p{{L}}\p{{N}}_]', '', 'g') compact from nb),
nt as (select query_id, list_concat(list_filter(regexp_extract_all(low, '([\p{{L}}\p{{N}}_]+)', 1), lambda w: length(w) >= 2), case when regexp_matches(compact, '[^\x00-\x7F]') then list_concat(list_filter([compact], lambda w: length(w) >= 2),
 list_concat(case when length(compact) >= 2 then list_transform(range(1, length(compact)), lambda i: substr(compact, i, 2)) else [] end, case when length(compact) >= 3 then list_transform(range(1, length(compact) - 1), lambda i: substr(compact, i, 3)) else [] end)) else [] end) a from nc),
nu as (select query_id, unnest(a) tok, generate_subscripts(a, 1) pos from nt), nf as (select query_id, tok, min(pos) pos from nu group by 1, 2), nr as (select *, row_number() over (partition by query_id order by pos) n from nf),
ntok as (select query_id, tok from nr where n <= 12),
nm as (select distinct query_id, id, length(canonical_value) len from graph_nodes, ntok where contains(lower(canonical_value), tok)), nmatch as (select * from (select query_id, id node_id, row_number() over (partition by query_id order by len, id) rank from nm) where rank <= 24),
nl as (select distinct entry_id, node_id from graph_entry_nodes where node_id is not null),
ne0 as (select query_id, entry_id, count(distinct node_id) hits from nmatch join nl using (node_id) join graph_entries g on g.id = entry_id group by 1, 2),
nent as (select * from (select query_id, entry_id, hits, least(1.0::double, 0.35::double + 0.15::double * hits) score, row_number() over (partition by query_id order by hits desc, entry_id desc) rank from ne0) where rank <= 50)"""


@query(f"with {NODEQ}, {TOKQ} select query_id, node_id, rank from nmatch")
def node_token_match(s, d):
    return G.node_matches(node_queries(s, d), table(s, d, "graph_nodes"))


@query(f"with {NODEQ}, {TOKQ} select query_id, entry_id, hits, round(score, 6) score, rank from nent")
def entries_for_nodes(s, d):
    h = G.node_matches(node_queries(s, d), table(s, d, "graph_nodes"))
    return G.entries_of_nodes(h, table(s, d, "graph_entry_nodes"), table(s, d, "graph_entries")).select("query_id", "entry_id", "hits", F.round("score", 6).alias("score"), "rank")


# ---- atoms ---------------------------------------------------------------------------------------
def class_sql(x: str) -> str:
    has = lambda k: f"regexp_matches({x}, {quoted(ATOM_PATTERNS[k])})"
    return f"case when {has('time')} and {has('action')} then 'planned' when {has('preference')} then 'preference' when {has('relation')} then 'relational' when {has('stative')} then 'factual' when {has('action')} then 'episodic' else 'unknown' end"


CLASS = class_sql("content")


@query(f"with {ATOM} select id, {CLASS} atom_class from atom where content is not null")
def atom_classify(s, d):
    return A.current(table(s, d, "memory_atoms")).where("content is not null").select("id", temporal.classify(F.col("content")).alias("atom_class"))


TTL = "greatest(1.0::double, (case atom_type " + " ".join(f"when '{k}' then {v[0]}" for k, v in TTL_BASE.items()) + " else 30.0 end + case when atom_type = 'planned' and event_time is not null then greatest(0.0::double, (event_time - created_at) / 86400.0) else 0 end) * (0.5 + coalesce(importance, 0.5)) * (1 + least(0.5::double, 0.1::double * coalesce(reinforcement_count, 0))))"


@query(f"with {ATOM} select id, round({TTL}, 6) ttl from atom")
def atom_ttl(s, d):
    a = A.current(table(s, d, "memory_atoms"))
    event = (F.col("event_time") - F.col("created_at")) / 86400.0
    return a.select("id", F.round(temporal.atom_ttl(F.coalesce("atom_type", F.lit("")), F.coalesce("importance", F.lit(0.5)), F.coalesce("reinforcement_count", F.lit(0)), event), 6).alias("ttl"))


DECAY = f"""adec as (select id, greatest(0.0::double, ({AS_OF} - coalesce(last_accessed_at, created_at, {AS_OF})) / 86400.0) dy, greatest(coalesce(ttl_days, 30.0), 1.0) tt, coalesce(decay_type, 'exponential') dk from atom),
ascore as (select id, round(case dk when 'linear' then greatest(0.0::double, 1 - dy / tt) when 'step' then case when dy <= tt then 1.0::double else 0.05::double end else pow(2.0::double, -dy / greatest(0.5::double, tt / 2)) end, 6) temporal_score from adec)"""


@query(f"with {ATOM}, {DECAY} select id, temporal_score from ascore")
def atom_decay(s, d):
    return A.decayed(A.current(table(s, d, "memory_atoms")), AS_OF)


@query(f"with {ATOM}, x as (select id, status, ({AS_OF} - expires_at) / 86400.0 late from atom), y as (select *, case when status = 'active' and late > 0 then 'expired' else status end s1 from x), z as (select *, case when s1 = 'expired' and late > 7 then 'forgotten' else s1 end s2 from y) select id, status, case when s2 = 'forgotten' and late > 30 then 'purged' else s2 end new_status from z")
def atom_lifecycle(s, d):
    return A.lifecycle(A.current(table(s, d, "memory_atoms")), AS_OF)


@query(f"with {ATOM} select s.status, count(a.id) n from (select unnest(['active', 'dormant', 'expired', 'forgotten', 'superseded']) status) s left join atom a on a.status = s.status group by 1")
def atom_counts(s, d):
    return A.counts(A.current(table(s, d, "memory_atoms")))


@query(f"""with {ATOM}, sig as (select id, generate_subscripts([0.9::double, 0.4::double], 1) seq, unnest([0.9::double, 0.4::double]) c from atom)
select a.id, round((a.confidence * 0.7 + 0.3 * 0.9) * 0.7 + 0.3 * 0.4, 6) confidence, coalesce(reinforcement_count, 0) + 2 reinforcements,
 round(greatest(1.0::double, (case atom_type {' '.join(f"when '{k}' then {v[0]}" for k, v in TTL_BASE.items())} else 30.0 end) * (0.5 + coalesce(importance, 0.5)) * (1 + least(0.5::double, 0.1::double * (coalesce(reinforcement_count, 0) + 2)))), 6) ttl_days from atom a""")
def atom_reinforce(s, d):
    a = A.current(table(s, d, "memory_atoms"))
    sig = a.select("id", F.posexplode(F.array(F.lit(0.9), F.lit(0.4))).alias("seq", "confidence"))
    return A.reinforce(a, sig, AS_OF)


@query(f"""with {ATOM}, {NODEQ}, adocs as (select id doc_id, content as text from atom), {bm_sql('adocs')}, {DECAY}, act as (select id from atom where status = 'active'),
atop as (select * from (select bm.*, {rank_sql('bm')} r0 from bm where doc_id in (select id from act)) where r0 <= 50), am as ({minmax_sql('atop')}), aj as (select query_id, doc_id, score * temporal_score score from am join ascore on id = doc_id)
select query_id, doc_id, round(score, 6) score, rank from (select *, {rank_sql('aj')} rank from aj) where rank <= 10""")
def atom_search(s, d):
    a = A.current(table(s, d, "memory_atoms"))
    q = node_queries(s, d)
    return A.search(text_scores(s, d, "memory_atoms", q), a, AS_OF).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""with {MEM}, f as (select memory_id, importance, list_slice({FACTS}, 1, 5) facts from mem where text is not null), u as (select memory_id, importance, unnest(facts) as content, generate_subscripts(facts, 1) - 1 pos from f), c as (select *, {CLASS} atom_type from u)
select memory_id, pos, atom_type, case atom_type {' '.join(f"when '{k}' then {v}" for k, v in ATOM_CONFIDENCE.items())} end confidence, case atom_type {' '.join(f"when '{k}' then '{v[1]}'" for k, v in TTL_BASE.items())} end decay_type from c""")
def atomise(s, d):
    m = mems(s, d).where("text is not null").select("memory_id", "importance", M.facts_of(F.col("text")).alias("facts"))
    return A.atomise(m, AS_OF).select("memory_id", "pos", "atom_type", "confidence", "decay_type")


@query()
def relative_dates(s, d):
    a = A.current(table(s, d, "memory_atoms"))
    return a.select("id", temporal.relative_date(F.col("content"), AS_OF).cast("string").alias("day")).where("day is not null")


@query("select node_type kind, count(*) n from graph_nodes group by 1 union all select coalesce(relation_type, '-'), count(*) from graph_entries group by 1")
def type_breakdown(s, d):
    a = table(s, d, "graph_nodes").groupBy(F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(table(s, d, "graph_entries").groupBy(F.coalesce("relation_type", F.lit("-")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("select id, node_key from graph_nodes n where not exists (select 1 from graph_entry_nodes l join graph_entries e on e.id = l.entry_id where l.node_id = n.id)")
def orphans(s, d):
    return G.orphans(table(s, d, "graph_nodes"), table(s, d, "graph_entry_nodes"), table(s, d, "graph_entries"))


@query("select source_memory_id, entry_type, max(id) entry_id from graph_entries group by 1, 2")
def latest_entry(s, d):
    return G.latest_entry(table(s, d, "graph_entries"))


@query("with g as (select source_memory_id, content, min(id) id from graph_entries where content is not null group by 1, 2) select source_memory_id, left(string_agg(content, chr(10) order by id), 4000) as content from g group by 1")
def entry_documents(s, d):
    return G.entry_documents(table(s, d, "graph_entries"))


@query(f"with {EMB}, p as (select a.vec_id x, b.vec_id y, row_number() over (partition by a.vec_id order by round(list_dot_product(a.e, b.e), 9) desc, b.vec_id) r, list_dot_product(a.e, b.e) s from vec a, vec b where a.vec_id <> b.vec_id), ed as (select x a, y b from p where r <= 5 and s >= 0.35 union select y, x from p where r <= 5 and s >= 0.35), rc as (with recursive t(id, c) as (select a, a from ed union select ed.b, t.c from t join ed on ed.a = t.id where t.c < ed.b) select id, min(c) component from t group by 1) select * from rc")
def components(s, d):
    return G.components(R.similar_pairs(table(s, d, "embeddings"), 0.35))


@query("with e as (select * from graph_entries where source_memory_id % 10 <> 0), l as (select * from graph_entry_nodes where entry_id in (select id from e)) select (select count(*) from e) n_entries, (select count(*) from l) n_links, (select count(*) from graph_nodes where id in (select node_id from l)) n_nodes")
def graph_delete(s, d):
    gone = table(s, d, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("memory_id")).unionAll(table(s, d, "graph_entries").where("source_memory_id % 10 = 0").select("source_memory_id"))
    e, l, n = G.delete_memories(table(s, d, "graph_entries"), table(s, d, "graph_entry_nodes"), table(s, d, "graph_nodes"), gone)
    c = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return c(e, "n_entries").crossJoin(c(l, "n_links")).crossJoin(c(n, "n_nodes"))


# ---- lifecycle -----------------------------------------------------------------------------------
@query(f"""with {MEM} select memory_id, case when importance < 1.0 then greatest(0.01::double, round(importance * pow(1 - 0.1::double * (1 - 0.5::double * least(1.0::double, access_count / 10.0::double) * case when {AS_OF} - last_access_time <= 7 * 86400.0 then 1.0::double else 0.5::double end), 3.0::double), 4)) else importance end new_importance,
 case when importance < 1.0 then cast(floor(access_count * 0.5) as bigint) else access_count end new_access_count from mem""")
def daily_decay(s, d):
    return L.daily_decay(mems(s, d), AS_OF, days=3, rate=0.1).select("memory_id", "new_importance", "new_access_count")


@query(f"""with {MEM}, a as (select user_id memory_id, max(epoch(ts)) t, count(*) n from events where event_type = 'view' group by 1) select m.memory_id, round(greatest(last_access_time, coalesce(t, 0.0)), 3) last_access_time, cast(least(1000000, access_count + coalesce(n, 0)) as bigint) access_count from mem m left join a using (memory_id)""")
def access_touch(s, d):
    e = table(s, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("memory_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return L.touch(mems(s, d), e).select("memory_id", F.round("last_access_time", 3).alias("last_access_time"), "access_count")


IMPORTED = f"""k as (select memory_id, {collapse_sql('text')} c, coalesce(session_id, '') ss, coalesce(persona_id, '') pp from mem), e as (select memory_id + 1000000000 entry_id, c, ss, pp from k union all select id, {collapse_sql('content')}, coalesce(session_id, ''), '' from msg), h as (select distinct coalesce(c, '') c, ss, pp from k),
act as (select e.entry_id, case when h.c is not null then 'exists' when row_number() over (partition by coalesce(e.c, ''), e.ss, e.pp order by entry_id) > 1 then 'repeated' else 'insert' end as action from e left join h on h.c = coalesce(e.c, '') and h.ss = e.ss and h.pp = e.pp)"""


def imported(s, d):
    """Every document again, and every message as a memory, against the documents."""
    m = mems(s, d)
    again = m.select((F.col("memory_id") + 1_000_000_000).alias("entry_id"), "text", "session_id", "persona_id")
    new = msgs(s, d).select(F.col("id").alias("entry_id"), F.col("content").alias("text"), "session_id", F.lit(None).cast("string").alias("persona_id"))
    return L.import_plan(again.unionByName(new), m)


@query(f"with {MEM}, {MSG}, {IMPORTED} select * from act")
def import_dedup(s, d):
    return imported(s, d)


@query(f"with {MEM}, {MSG}, {IMPORTED} select count(*) total, count(*) filter (action = 'insert') inserted, count(*) filter (action = 'exists') existing, count(*) filter (action = 'repeated') repeated from act")
def import_counts(s, d):
    return L.import_counts(imported(s, d))


@query(f"""with {MEM}, t as (select memory_id from mem), v as (select vec_id memory_id from embeddings), a as (select memory_id from mem where status = 'active')
select (select count(*) from a) n_active, (select count(*) from a where memory_id not in (select memory_id from t)) missing_text, (select count(*) from a where memory_id not in (select memory_id from v)) missing_vector, (select count(*) from t where memory_id not in (select memory_id from mem)) orphan_text, (select count(*) from v where memory_id not in (select memory_id from mem)) orphan_vector, 'full' as mode""")
def index_consistency(s, d):
    """Documents against the text index on disk and the table of vectors."""
    indexed = s.read.parquet(f"{text_index(s, d, 'documents')}/docs").select(F.col("doc_id").alias("memory_id"))
    return L.rebuild_mode(L.consistency(mems(s, d), indexed, table(s, d, "embeddings").select(F.col("vec_id").alias("memory_id"))))


@query(f"with {MEM} select memory_id, case when memory_id % 5 = 0 then 'archived' else status end status from mem where memory_id % 7 <> 0")
def archive_delete(s, d):
    m = mems(s, d)
    out = L.set_status(m, m.where("memory_id % 5 = 0"), "archived")
    return L.delete(out, m.where("memory_id % 7 = 0")).select("memory_id", "status")


@query(f"with {MEM}, n as (select max(memory_id) top from mem) select memory_id, text, cast(null as bigint) previous_id from mem where memory_id % 9 <> 0 union all select memory_id + 1000000, 'edited', memory_id from mem where memory_id % 9 = 0")
def memory_replace(s, d):
    m = mems(s, d)
    edits = m.where("memory_id % 9 = 0").select("memory_id", (F.col("memory_id") + 1_000_000).alias("new_id"), F.lit("edited").alias("text"))
    return L.replace(m.select("memory_id", "text", "create_time"), edits).select("memory_id", "text", "previous_id")


# ---- conversations -------------------------------------------------------------------------------
TIME = "tm asc nulls first, id"


@query(f"with {MSG}, r as (select *, row_number() over (partition by session_id order by tm desc nulls last, id desc) r from msg where session_id is not null) select session_id, id, row_number() over (partition by session_id order by r desc) pos from r where r <= 5")
def msg_last_n(s, d):
    return C.last_n(msgs(s, d), 5).select("session_id", "id", "pos")


@query(f"with {MSG}, r as (select *, row_number() over (partition by session_id order by {TIME}) - 1 pos from msg where session_id is not null) select session_id, id, pos from r where pos between 3 and 7")
def msg_range(s, d):
    return C.slice_of(msgs(s, d), 3, 5).select("session_id", "id", "pos")


@query(f"with {MSG} select id from msg where contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'remind')")
def msg_search(s, d):
    return C.search(msgs(s, d), "Remind").select("id")


@query("select session_id, round(last_active_at, 3) last_active_at from sessions order by sessions.last_active_at desc nulls last, session_id limit 20")
def recent_sessions(s, d):
    return C.recent_sessions(table(s, d, "sessions")).select("session_id", F.round("last_active_at", 3).alias("last_active_at"))


@query(f"with {MSG} select sender_id, count(*) n from msg where role = 'user' and sender_id is not null group by 1")
def user_msg_stats(s, d):
    return C.user_counts(msgs(s, d))


@query(f"with {MSG}, n as (select session_id, count(*) n from msg where session_id is not null group by 1) select s.session_id, message_count recorded, coalesce(n, 0) actual from sessions s left join n using (session_id) where message_count is null or message_count <> coalesce(n, 0)")
def count_reconcile(s, d):
    return C.reconcile(table(s, d, "sessions"), msgs(s, d))


@query(f"with {MSG} select session_id, count(*) n, round(min(tm), 3) first_at, round(max(tm), 3) last_at, count(distinct sender_id) n_senders from msg where session_id is not null group by 1")
def session_activity(s, d):
    return C.activity(msgs(s, d))


CUR = f"cur as (select session_id, cast(coalesce(floor({number_sql('last_summarized_index')}), 0) as bigint) c from sessions)"


@query(f"with {MSG}, {CUR}, r as (select msg.session_id, id, row_number() over (partition by msg.session_id order by {TIME}) pos, c from msg left join cur on cur.session_id = msg.session_id where msg.session_id is not null) select session_id, id from r where pos > least(4, coalesce(c, 0))")
def msg_trim(s, d):
    return C.trim(msgs(s, d), table(s, d, "sessions"), 4)[0].select("session_id", "id")


@query(f"select session_id from sessions where coalesce(last_active_at, created_at, 0.0) < {AS_OF} - 100 * 86400.0")
def session_ttl(s, d):
    return C.expired(table(s, d, "sessions"), AS_OF, 100 * 86400.0)


@query(f"with {MSG}, {CUR}, n as (select session_id, count(*) n from msg group by 1) select cur.session_id, c as cursor, case when c > coalesce(n, 0) then 0 else c end new_cursor from cur left join n using (session_id)")
def cursor_reset(s, d):
    return C.reset_cursor(table(s, d, "sessions"), msgs(s, d))


@query(f"with {MSG}, {CUR}, n as (select session_id, count(*) n from msg group by 1), x as (select cur.session_id, case when c > coalesce(n, 0) then 0 else c end s0, coalesce(n, 0) e from cur left join n using (session_id)) select session_id, s0 as start, e as \"end\", floor((e - s0) / 2) >= 10 due from x")
def summary_window(s, d):
    return C.summary_window(table(s, d, "sessions"), msgs(s, d))


@query(f"with {MSG}, r as (select session_id, id, role, content, lead(role) over w r2, lead(content) over w c2 from msg where session_id is not null window w as (partition by session_id order by {TIME})) select session_id, id, 'user: ' || coalesce(content, '') || chr(10) || 'assistant: ' || coalesce(c2, '') as text, false was_cut from r where role = 'user' and r2 = 'assistant'")
def msg_rounds(s, d):
    return C.rounds(msgs(s, d))


@query(f"with {MSG} select session_id, strftime(min(make_timestamp(cast(floor(tm) * 1000000 as bigint))), '%Y-%m-%d') first_day, strftime(max(make_timestamp(cast(floor(tm) * 1000000 as bigint))), '%Y-%m-%d') last_day, count(distinct strftime(make_timestamp(cast(floor(tm) * 1000000 as bigint)), '%Y-%m-%d')) n_days from msg where session_id is not null and tm is not null group by 1")
def time_tags(s, d):
    return C.time_tags(msgs(s, d))


@query(f"with {MSG}, k as (select concat_ws(':', platform, sender_id) \"identity\", * from msg where sender_id is not null) select \"identity\", arg_max(sender_name, struct_pack(tm := coalesce(tm, -1e18), id := id)) filter (sender_name is not null) last_name, count(distinct sender_name) n_names, coalesce(bool_or(role = 'assistant'), false) is_bot from k group by 1")
def participant_identities(s, d):
    return C.identities(msgs(s, d))


@query(f"""with {MSG}, r as (select *, row_number() over (partition by session_id order by {TIME}) r from msg where session_id is not null), l as (select session_id, r, case when group_id is not null then '[' || (case when role = 'assistant' then 'Bot: ' else '' end) || coalesce(sender_name, sender_id, '?') || ' | ' || coalesce(sender_id, '?') || ' | ' || coalesce(strftime(make_timestamp(cast(floor(tm) * 1000000 as bigint)), '%Y-%m-%d %H:%M'), '?') || '] ' else coalesce(role, '?') || ': ' end || coalesce(content, '') line from r)
select session_id, (r - 1) // 200 part, string_agg(line, chr(10) order by r) as text from l group by 1, 2""")
def transcripts(s, d):
    return C.transcripts(msgs(s, d))


@query(f"with {MSG}, gone as (select session_id from sessions where coalesce(last_active_at, created_at, 0.0) < {AS_OF} - 100 * 86400.0) select (select count(*) from sessions where session_id is null or session_id not in (select session_id from gone where session_id is not null)) n_sessions, (select count(*) from msg where session_id is null or session_id not in (select session_id from gone where session_id is not null)) n_messages")
def session_purge(s, d):
    kept, m = C.purge(table(s, d, "sessions"), msgs(s, d), AS_OF, 100 * 86400.0)
    return kept.agg(F.count(F.lit(1)).alias("n_sessions")).crossJoin(m.agg(F.count(F.lit(1)).alias("n_messages")))


@query(f"with {MSG} select session_id, count(*) n, round(max(tm), 3) last_at, coalesce(string_agg(distinct sender_id, ',' order by sender_id), '') senders from msg where session_id is not null group by 1")
def session_state(s, d):
    """The stream's state of each session, in batch."""
    return S.session_state(msgs(s, d).where("session_id is not null")).select("session_id", "n", F.round("last_at", 3).alias("last_at"), F.array_join("senders", ",").alias("senders"))


# ---- streams (batch twins) -----------------------------------------------------------------------
@query("with u as (select event_id, ts from events union all select event_id, ts + interval 60 second from events where event_id % 10 = 0), g as (select *, epoch(ts) - lag(epoch(ts)) over (partition by event_id order by ts) gap from u) select event_id, epoch(ts) \"at\" from g where gap is null or gap > 300")
def dedup_events(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    again = e.where("event_id % 10 = 0").withColumn("ts", F.col("ts") + F.expr("interval 60 seconds"))
    return S.dedup_batch(e.unionByName(again), ["event_id"]).select("event_id", (F.unix_micros("ts") / 1e6).alias("at"))


@query("select epoch(time_bucket(interval 1 hour, ts)) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def tumbling_events(s, d):
    return S.tumbling(table(s, d, "events"))


@query("select epoch(time_bucket(interval 30 minute, ts)) - k * 1800 window_start, count(*) n from events, range(0, 2) t(k) group by 1")
def sliding_events(s, d):
    return S.sliding(table(s, d, "events"))


@query("with o as (select user_id, ts, case when epoch(ts) - lag(epoch(ts)) over w < 3600 then 0 else 1 end b from events window w as (partition by user_id order by ts)), g as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) g from o) select user_id, min(epoch(ts)) started, max(epoch(ts)) + 3600 ended, count(*) n from g group by user_id, g")
def session_windows(s, d):
    return S.sessions(table(s, d, "events"))


@query(f"with {MSG} select id from msg where content is not null and trim(content, ' ') <> '' and not coalesce(sender_id = 'bot', false) and group_id is not null")
def capture_filter(s, d):
    return S.captured(msgs(s, d)).select("id")


# ---- further operators ---------------------------------------------------------------------------
@query("with r as (select session_id, id, content, row_number() over (partition by session_id order by id desc, content) r from (select distinct session_id, id, content from messages where session_id is not null)) select session_id, id, content from r where r = 1")
def source_upsert(s, d):
    m = table(s, d, "messages").where("session_id is not null").select("session_id", "id", "content").distinct()
    return m.groupBy("session_id").agg(F.min_by(F.struct("id", "content"), F.struct(-F.col("id"), "content")).alias("m")).select("session_id", "m.*")


@query(f"with {MEM}, f as (select memory_id, text, list_slice({FACTS}, 1, 5) facts from mem where text is not null), g as (select *, ' | ' || array_to_string(facts, '；') tail from f) select memory_id, case when len(facts) > 0 and ends_with(text, tail) then left(text, length(text) - length(tail)) else text end shown from g")
def display_content(s, d):
    m = mems(s, d).where("text is not null").select("memory_id", "text", M.facts_of(F.col("text")).alias("facts"))
    return m.select("memory_id", M.display_content(F.col("text"), F.col("facts"), F.lit(None).cast("string")).alias("shown"))


@query(rf"with {MEM} select memory_id, trim(regexp_replace(regexp_replace(text, '(?s)\Q(\E.*?\Q)\E', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ') stripped from mem")
def strip_injected(s, d):
    return mems(s, d).select("memory_id", T.strip_injected(F.col("text"), "(", ")").alias("stripped"))


@query(f"with {ATOM}, e as (select id, unnest(from_json(case when json_valid(entities) then entities end, '[\"VARCHAR\"]')) x from atom where json_valid(entities) and json_type(entities) = 'ARRAY'), f as (select distinct id, trim(x, ' ') x from e where trim(x, ' ') <> '') select id, count(*) n from f group by 1")
def entity_counts(s, d):
    a = A.current(table(s, d, "memory_atoms"))
    n = F.size(T.edit_list(F.from_json("entities", "array<string>"), 1000))
    return a.select("id", n.cast("long").alias("n")).where("n > 0")


@query(f"with {MEM}, l as (select memory_id, unnest(string_split(text, chr(10))) line from mem), p as (select memory_id, regexp_extract(line, '^\\[([^|\\]]+) \\| ([0-9]{{2}}:[0-9]{{2}})\\] (.*)$', 1) speaker, regexp_extract(line, '^\\[([^|\\]]+) \\| ([0-9]{{2}}:[0-9]{{2}})\\] (.*)$', 2) said_at, regexp_extract(line, '^\\[([^|\\]]+) \\| ([0-9]{{2}}:[0-9]{{2}})\\] (.*)$', 3) said from l) select memory_id, speaker, said_at, said from p where speaker <> ''")
def chat_lines(s, d):
    return mems(s, d).select("memory_id", F.explode(T.chat_lines(F.col("text"))).alias("l")).select("memory_id", "l.*")


@query("select distinct id, round(case when isnan(\"timestamp\") then null when \"timestamp\" > 1e11 then \"timestamp\" / 1000 else \"timestamp\" end, 3) at_seconds from messages where id is not null")
def normalize_ts(s, d):
    m = table(s, d, "messages").where("id is not null")
    return m.select("id", F.round(temporal.epoch_seconds(F.col("timestamp")), 3).alias("at_seconds")).distinct()


@query(f"select session_id, cast(greatest(0, date_diff('day', cast(make_timestamp(cast(floor(last_active_at) * 1000000 as bigint)) as date), date '2024-04-01') - 1) as integer) missed from sessions where last_active_at is not null")
def decay_catchup(s, d):
    t = table(s, d, "sessions").where("last_active_at is not null")
    last = F.to_date(F.timestamp_seconds(F.floor("last_active_at")))
    return t.select("session_id", L.missed_days(last, F.to_date(F.lit("2024-04-01"))).alias("missed"))


@query(f"""with {MEM}, c as (select session_id group_key, memory_id, unnest(list_slice({FACTS}, 1, 5)) fact from mem where status = 'active' and importance < 0.5 and create_time < {AS_OF} - 7 * 86400.0 and session_id is not null and text is not null),
o as (select group_key, fact, min(memory_id) memory_id from c group by 1, 2), r as (select *, row_number() over (partition by group_key order by memory_id, fact) r from o), t as (select group_key, string_agg(fact, '；' order by r) as text from r where r <= 5 group by 1)
select t.group_key, t.text, n_sources, first_id from t join (select group_key, count(distinct memory_id) n_sources, min(memory_id) first_id from c group by 1) n using (group_key)""")
def consolidation_merge(s, d):
    c = M.consolidation_candidates(mems(s, d), AS_OF).where("session_id is not null and text is not null")
    return L.merge_groups(c.select(F.col("session_id").alias("group_key"), "memory_id", F.explode(M.facts_of(F.col("text"))).alias("fact")))


WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"


@query(f"""with {ATOM}, a as (select id, parent_memory_id p, {WORDS.format('lower(' + collapse_sql('content') + ')')} w from atom where content is not null and parent_memory_id is not null), j as (select a.id new_id, b.id old_id, len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) as double) s from a join a b on a.p = b.p and a.id <> b.id where len(a.w) >= 2 and len(b.w) >= 2)
select new_id, old_id, round(s, 6) similarity from j where round(s, 6) >= 0.5""")
def atom_duplicates(s, d):
    a = A.current(table(s, d, "memory_atoms")).where("content is not null and parent_memory_id is not null").where(F.size(T.word_set(F.col("content"))) >= 2)
    return A.duplicates(a, a, 0.5)


@query(f"""with {ATOM}, e as (select id, parent_memory_id memory_id, content, coalesce(confidence, 0.6) * 0.9 confidence, unnest(from_json(case when json_valid(entities) then entities end, '["VARCHAR"]')) x from atom where content is not null and json_valid(entities) and json_type(entities) = 'ARRAY')
select distinct id, memory_id, 'entity:' || {canonical_sql('x')} source_key, 'fact:' || {canonical_sql('content')} target_key, round(confidence, 6) confidence from e where {canonical_sql('x')} <> ''""")
def graph_extract_atoms(s, d):
    return G.extract_atom_edges(A.current(table(s, d, "memory_atoms"))).withColumn("confidence", F.round("confidence", 6))


@query(f"""with {MSG}, r as (select id, session_id, content, tm, [struct_pack(c := lag(content, 4) over w, t := lag(tm, 4) over w), struct_pack(c := lag(content, 3) over w, t := lag(tm, 3) over w), struct_pack(c := lag(content, 2) over w, t := lag(tm, 2) over w), struct_pack(c := lag(content, 1) over w, t := lag(tm, 1) over w)] p from msg where session_id is not null window w as (partition by session_id order by {TIME})),
f as (select id, content, list_transform(list_filter(p, lambda x: coalesce(trim(x.c, ' ') <> '' and tm - x.t <= 7200, false)), lambda x: trim(x.c, ' ')) l from r) select id, case when len(l) > 0 then array_to_string(l, ' | ') || ' ' || coalesce(content, '') else coalesce(content, '') end expanded from f""")
def query_context(s, d):
    return C.with_context(msgs(s, d))


@query(f"with {MSG} select id from msg where role in ('assistant', 'bot', 'ai') and content is not null and not regexp_matches(content, '(?i)^(error|traceback|\\{{\"tool\")')")
def response_filter(s, d):
    return msgs(s, d).where(F.col("role").isin("assistant", "bot", "ai") & F.col("content").isNotNull() & ~F.col("content").rlike('(?i)^(error|traceback|\\{"tool")')).select("id")


@query("select source_memory_id, count(vector_doc_id) n, min(vector_doc_id) lo, max(vector_doc_id) hi from graph_entries group by 1")
def vector_ids(s, d):
    return table(s, d, "graph_entries").groupBy("source_memory_id").agg(F.count("vector_doc_id").alias("n"), F.min("vector_doc_id").alias("lo"), F.max("vector_doc_id").alias("hi"))


@query(f"select session_id, {meta_sql('persona_id')} persona from sessions")
def session_persona(s, d):
    return table(s, d, "sessions").select("session_id", M.meta_text(F.col("metadata"), "persona_id").alias("persona"))


@query(f"with {MEM}, {MSG} select m.memory_id, count(msg.id) kept, count(*) filter (msg.sender_id = 'bot') from_bot from mem m join msg on msg.session_id = m.session_id where m.importance >= 0.8 and msg.content is not null and trim(msg.content, ' ') <> '' group by 1")
def retained_sources(s, d):
    m = mems(s, d).where("importance >= 0.8").select("memory_id", "session_id")
    j = m.join(msgs(s, d).where("content is not null and trim(content) <> ''").select("session_id", "id", "sender_id"), "session_id")
    return j.groupBy("memory_id").agg(F.count("id").alias("kept"), F.count_if(F.col("sender_id") == "bot").alias("from_bot"))


@query(f"with {MEM}, e as (select source_memory_id, count(*) n_entries from graph_entries group by 1), a as (select parent_memory_id, count(distinct id) n_atoms from memory_atoms group by 1) select memory_id, m.status, round(importance, 6) importance, coalesce(n_entries, 0) n_entries, coalesce(n_atoms, 0) n_atoms from mem m left join e on source_memory_id = memory_id left join a on parent_memory_id = memory_id")
def memory_detail(s, d):
    e = table(s, d, "graph_entries").groupBy(F.col("source_memory_id").alias("memory_id")).agg(F.count(F.lit(1)).alias("n_entries"))
    a = table(s, d, "memory_atoms").groupBy(F.col("parent_memory_id").alias("memory_id")).agg(F.countDistinct("id").alias("n_atoms"))
    j = mems(s, d).join(e, "memory_id", "left").join(a, "memory_id", "left")
    return j.select("memory_id", "status", F.round("importance", 6).alias("importance"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"))


@query(f"with {MEM}, x as (select memory_id, importance * pow(1 - 0.1::double * (1 - 0.5::double * least(1.0::double, access_count / 10.0::double) * case when {AS_OF} - last_access_time <= 7 * 86400.0 then 1.0::double else 0.5::double end), 3.0::double) v, importance, create_time, status from mem), y as (select *, case when importance < 1.0 then greatest(0.01::double, round(v, 4)) else importance end n from x) select memory_id, round(n, 4) importance, case when status = 'active' and {AS_OF} - create_time > 30 * 86400.0 and n < 0.3 then 'archived' else status end status from y")
def maintenance(s, d):
    return L.maintain(mems(s, d), AS_OF, days=3, rate=0.1).select("memory_id", F.round("importance", 4).alias("importance"), "status")


@query("select doc_id id from documents except select vec_id from embeddings")
def set_difference(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id")).subtract(table(s, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("select vec_id id from embeddings intersect select doc_id from documents")
def set_intersection(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id")).intersect(table(s, d, "documents").select(F.col("doc_id").alias("id")))
