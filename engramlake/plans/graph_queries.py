"""Queries of the graph and of recall, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.config import AS_OF
from engramlake.operators import atoms as A
from engramlake.operators import graph as G
from engramlake.operators import lifecycle as L
from engramlake.operators import memories as M
from engramlake.operators import retrieval as R
from engramlake.plans.queries import ATOM, EMB, FACTS, INTENT, MEM, NODEQ, bm_sql, canonical_sql, hybrid_queries, mems, minmax_sql, node_queries, number_sql, query, rank_sql, search_sql, text_top, tokens_sql, vec_queries
from engramlake.session import fingerprint, stored
from engramlake.tables import table

K = 10


def r6(name: str):
    return F.round(name, 6).alias(name)


# ---- hybrid recall -------------------------------------------------------------------------------
def hq_sql(k: int) -> str:
    return f"q as (select v.vec_id query_id, d.query, cast({k} as bigint) k, cast(null as varchar) session_id, cast(null as varchar) persona_id from embeddings v join (select id, content as query from graph_entries) d on d.id = v.vec_id + 2 where v.vec_id % 50 = 0 and query is not null)"


def vhits_sql(k: int) -> str:
    return f"""vq as (select vec_id query_id, e from vec where vec_id % 50 = 0), vs as (select query_id, vec.vec_id doc_id, list_dot_product(vq.e, vec.e) score from vq, vec where vec.vec_id in (select memory_id from mem where status = 'active')),
vhits as (select * from (select *, {rank_sql('vs')} rank from vs) where rank <= {2 * k})"""


FUSED = """fl as (select query_id, doc_id, rank, score, 'k' side from hits union all select query_id, doc_id, rank, score, 'v' from vhits), fus as (select query_id, doc_id, sum(1.0::double / (60 + rank)) rrf_score, max(case when side = 'k' then score end) kw_score, max(case when side = 'v' then score end) vec_score from fl group by 1, 2)"""


def recency_sql() -> str:
    return f"exp(-0.01::double * greatest(0.0::double, ({AS_OF} - greatest(create_time, last_access_time)) / 86400.0::double))"


def hybrid_sql(k: int) -> str:
    return f"""{hq_sql(k)}, {search_sql()}, {EMB}, {vhits_sql(k)}, {FUSED},
hw as (select f.*, importance, {recency_sql()} recency, rrf_score / max(rrf_score) over (partition by query_id) rel from fus f join mem on mem.memory_id = f.doc_id),
hs as (select *, 0.5::double * rel + 0.25::double * importance + 0.25::double * recency score from hw), hyb as (select * from (select *, {rank_sql('hs')} rank from hs) where rank <= {k})"""


def hybrid_hits(s, d, k: int = K, **kw) -> DataFrame:
    q = hybrid_queries(s, d)
    return R.hybrid(q, vec_queries(s, d), mems(s, d), table(s, d, "embeddings"), AS_OF, k, scores=text_top(s, d, "documents"), **kw)


@query(f"with {MEM}, {hq_sql(K)}, {search_sql()}, {EMB}, {vhits_sql(K)}, {FUSED} select query_id, doc_id, round(rrf_score, 9) rrf_score, round(kw_score, 6) kw_score, round(vec_score, 6) vec_score from fus")
def rrf_fusion(s, d):
    m = mems(s, d)
    v = table(s, d, "embeddings").join(m.where("status = 'active'").select(F.col("memory_id").alias("vec_id")), "vec_id", "left_semi")
    q = hybrid_queries(s, d)
    lists = {"kw": R.bm25_search(q, m, scores=text_top(s, d, "documents")), "vec": R.vector_topk(vec_queries(s, d), v, 2 * K)}
    return R.rrf(lists).select("query_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"), r6("kw_score"), r6("vec_score"))


@query(f"with {MEM}, {hybrid_sql(K)} select query_id, doc_id, rank, round(score, 6) score from hyb")
def hybrid_recall(s, d):
    return hybrid_hits(s, d).select("query_id", "doc_id", "rank", r6("score"))


@query(f"""with {MEM}, {hq_sql(K)}, {search_sql()}, fus as (select query_id, doc_id, 1.0::double / (60 + rank) rrf_score from hits),
hs as (select f.query_id, doc_id, 0.5::double * rrf_score / max(rrf_score) over (partition by f.query_id) + 0.25::double * importance + 0.25::double * {recency_sql()} score from fus f join mem on memory_id = doc_id)
select query_id, doc_id, rank, round(score, 6) score from (select *, {rank_sql('hs')} rank from hs) where rank <= {K}""")
def hybrid_one_route(s, d):
    """The fallback to text only."""
    return hybrid_hits(s, d, routes=("kw",)).select("query_id", "doc_id", "rank", r6("score"))


@query(f"with {MEM}, {hybrid_sql(K)} select query_id, doc_id from hyb where importance >= 0.3 and (vec_score is null or vec_score >= 0.1)")
def policy_filter(s, d):
    return M.policy_filter(hybrid_hits(s, d), 0.3, 0.1).select("query_id", "doc_id")


# the greedy choice as a recursion: at each step the candidate of greatest gain joins the chosen ones
@query(f"""with recursive {MEM}, {hybrid_sql(30)}, cand as (select h.query_id, h.doc_id, h.score, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) w from hyb h join mem on memory_id = doc_id),
sim as (select a.query_id, a.doc_id x, b.doc_id y, case when len(list_distinct(list_concat(a.w, b.w))) > 0 then len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) as double) else 0.0::double end s from cand a join cand b on a.query_id = b.query_id),
go as (select query_id, 1::bigint step, [arg_min(doc_id, struct_pack(s := -score, d := doc_id))] chosen from cand group by 1
 union all select g.query_id, g.step + 1, list_append(any_value(g.chosen), arg_min(c.doc_id, struct_pack(s := -(0.7::double * c.score - 0.3::double * m.far), s2 := -c.score, d := c.doc_id))) from go g join cand c on c.query_id = g.query_id and not list_contains(g.chosen, c.doc_id)
 join lateral (select max(s) far from sim where sim.query_id = g.query_id and sim.x = c.doc_id and list_contains(g.chosen, sim.y)) m on true where g.step < {K} group by g.query_id, g.step),
best as (select query_id, arg_max(chosen, step) chosen from go group by 1), o as (select query_id, unnest(chosen) doc_id, generate_subscripts(chosen, 1) rank from best)
select o.query_id, o.doc_id, round(c.score, 6) score, o.rank from o join cand c on c.query_id = o.query_id and c.doc_id = o.doc_id""")
def mmr(s, d):
    hits = hybrid_hits(s, d, 30).select("query_id", "doc_id", "score")
    return R.mmr(hits.join(mems(s, d).select(F.col("memory_id").alias("doc_id"), "text"), "doc_id"), K).withColumn("score", F.round("score", 6))


# ---- the stored graph ----------------------------------------------------------------------------
LINK = "lk as (select distinct entry_id, node_id from graph_entry_nodes where node_id is not null and entry_id is not null)"
EDGE = f"""lke as (select entry_id, min(node_id) a, max(node_id) b from graph_entry_nodes where entry_id is not null and node_id is not null group by 1 having min(node_id) < max(node_id)),
medge as (select g.id edge_id, source_memory_id memory_id, a, b, coalesce(relation_type, 'related') rel, coalesce({number_sql('graph_confidence')}, 0.8) conf from graph_entries g join lke on lke.entry_id = g.id where entry_type = 'edge'),
eobs as (select memory_id, a, b, rel, max(edge_id) edge_id, arg_max(conf, edge_id) confidence from medge group by 1, 2, 3, 4),
eo as (select *, row_number() over w - 1 i, count(*) over (partition by a, b, rel) - 1 n from eobs window w as (partition by a, b, rel order by edge_id)),
edges as (select a, b, rel, sum(confidence * (case when i = 0 then 1.0::double else 0.3::double end) * pow(0.7::double, n - i)) confidence, sum(case when i = 0 then 1.0::double else 0.15::double end) weight, count(*) n_obs from eo group by 1, 2, 3),
both_ as (select a x, b y, weight from edges union all select b, a, weight from edges)"""


def graph(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entries, links, nodes, and the merged edges."""
    e, l = table(s, d, "graph_entries"), table(s, d, "graph_entry_nodes")
    key = fingerprint(s, f"{d}/graph_entries.parquet", f"{d}/graph_entry_nodes.parquet")
    edges = stored(s, "edges", key, lambda p: G.stored_edges(e, l).write.parquet(p))
    return e, l, table(s, d, "graph_nodes"), s.read.parquet(edges)


@query(f"with {EDGE} select a source_key, b target_key, rel relation_type, round(confidence, 6) confidence, round(weight, 6) weight, n_obs from edges")
def graph_stored_edges(s, d):
    return graph(s, d)[3].select("source_key", "target_key", "relation_type", r6("confidence"), r6("weight"), "n_obs")


SEEDS = "seeds as (select id query_id, id node_id from graph_nodes where id % 50 = 0)"


def seeds(s, d) -> DataFrame:
    """Every fiftieth node."""
    return table(s, d, "graph_nodes").where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("node_key"))


def near_sql(name: str, src: str, most: int) -> str:
    return f"""{name}0 as (select s.query_id, y node_id, sum(weight) w from {src} s join both_ on x = s.node_id where not exists (select 1 from {src} z where z.query_id = s.query_id and z.node_id = y) group by 1, 2),
{name} as (select query_id, node_id, w from (select *, row_number() over (partition by query_id order by round(w, 9) desc, node_id) r from {name}0) where r <= {most})"""


@query(f"with {EDGE}, {SEEDS}, {near_sql('nb', 'seeds', 24)} select query_id, node_id node_key, round(w, 6) weight from nb")
def graph_neighbors(s, d):
    return G.neighbors(graph(s, d)[3], seeds(s, d), 24).select("query_id", "node_key", r6("weight"))


@query(f"""with {EDGE}, {SEEDS}, {near_sql('nb', 'seeds', 24)}, {near_sql('nc', 'nb', 24)}
select query_id, node_id node_key, 1 hop from nb union all select query_id, node_id, 2 from nc where node_id <> query_id""")
def graph_two_hop(s, d):
    return G.two_hop(graph(s, d)[3], seeds(s, d), 24)


def weights_sql(entries: str, edges: str) -> str:
    """Nodes of ``entries`` with their weights; ``edges`` has a, b."""
    return f"""wj as (select node_id, count(*) entry_count, count(distinct source_memory_id) memory_count from lk join {entries} g on g.id = lk.entry_id where node_id in (select id from graph_nodes) group by 1),
we as (select * from {edges} where a in (select node_id from wj) and b in (select node_id from wj)), wd as (select node_id, count(*) degree from (select a node_id from we union all select b from we) group by 1),
weights as (select wj.*, coalesce(degree, 0) degree, round(entry_count + 0.75::double * memory_count + 0.35::double * coalesce(degree, 0), 4) weight, node_type, node_value, canonical_value from wj join graph_nodes n on n.id = wj.node_id left join wd on wd.node_id = wj.node_id)"""


VIEW = "weight desc, entry_count desc, degree desc, coalesce(node_value, ''), node_id"


@query(f"with {LINK}, {EDGE}, {weights_sql('graph_entries', 'edges')} select node_id, entry_count, memory_count, degree, weight, node_type, canonical_value from weights")
def graph_node_weight(s, d):
    e, l, n, g = graph(s, d)
    return G.node_weights(n, l, e, g).select("node_id", "entry_count", "memory_count", "degree", "weight", "node_type", "canonical_value")


@query(f"with {LINK}, {EDGE}, {weights_sql('graph_entries', 'edges')} select node_id, weight from weights order by {VIEW} limit 8")
def view_top_nodes(s, d):
    e, l, n, g = graph(s, d)
    return G.node_weights(n, l, e, g).orderBy(*G.view_order()).limit(8).select("node_id", "weight")


@query(f"with {EDGE} select 'nodes' what, count(*) n from graph_nodes union all select 'entries', count(*) from graph_entries union all select 'edges', count(*) from edges")
def graph_counts(s, d):
    e, _, n, g = graph(s, d)
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n") for w, x in (("nodes", n), ("entries", e), ("edges", g))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select source_memory_id memory_id, max(id) last_entry from graph_entries where source_memory_id is not null group by 1 order by 2 desc limit 200")
def graph_recent_memories(s, d):
    return G.recent_memories(table(s, d, "graph_entries"))


SUB = f"""{LINK}, {EDGE}, e0 as (select * from graph_entries where source_memory_id in (select memory_id from want) order by id desc limit 36),
l0 as (select * from lk where entry_id in (select id from e0) and node_id in (select id from graph_nodes)),
g0 as (select * from medge where memory_id in (select memory_id from want) and a in (select node_id from l0) and b in (select node_id from l0) order by edge_id desc limit 72), {weights_sql('e0', 'g0')},
kept as (select * from weights order by {VIEW} limit 48), g1 as (select * from g0 where a in (select node_id from kept) and b in (select node_id from kept)), l1 as (select * from l0 where node_id in (select node_id from kept)),
e1 as (select * from e0 where id in (select entry_id from l1) or entry_type = 'summary')"""
WANT = "want as (select source_memory_id memory_id from graph_entries where source_memory_id is not null group by 1 order by max(id) desc limit 12)"


def focus(s, d):
    """The view of the twelve memories with the newest entries."""
    e, l, n, _ = graph(s, d)
    return G.subgraph(e, l, n, G.memory_edges(e, l), G.recent_memories(e, 12))


@query("with all_ as (select source_memory_id memory_id from graph_entries), want as (select distinct memory_id from all_), " + SUB + " select node_id, weight from kept")
def graph_subgraph(s, d):
    """The nodes of the view of all memories that have entries."""
    e, l, n, _ = graph(s, d)
    return G.subgraph(e, l, n, G.memory_edges(e, l), e.select(F.col("source_memory_id").alias("memory_id")))[0].select("node_id", "weight")


@query(f"with {WANT}, {SUB} select node_id, entry_count, memory_count, degree, weight from kept")
def graph_focus_nodes(s, d):
    return focus(s, d)[0].select("node_id", "entry_count", "memory_count", "degree", "weight")


@query(f"with {WANT}, {SUB} select edge_id, memory_id, a source_key, b target_key, rel relation_type from g1")
def graph_focus_edges(s, d):
    return focus(s, d)[1]


@query(f"""with {WANT}, {SUB}, pm as (select source_memory_id memory_id, count(*) entry_count from e1 group by 1), pe as (select memory_id, count(*) edge_count from g1 group by 1),
pn as (select source_memory_id memory_id, count(distinct node_id) node_count from l1 join e1 on e1.id = l1.entry_id group by 1) select pm.memory_id, entry_count, coalesce(edge_count, 0) edge_count, coalesce(node_count, 0) node_count from pm left join pe using (memory_id) left join pn using (memory_id)""")
def graph_focus_memories(s, d):
    return focus(s, d)[3]


@query()
def communities(s, d):
    e, l, n, g = graph(s, d)
    w = G.node_weights(n, l, e, g).select(F.col("node_id").alias("node_key"), "weight")
    return G.communities(g, w)


# ---- extraction ----------------------------------------------------------------------------------
def graph_memories(s, d):
    """Memories with their facts, the topics their entries link to, and the participants of their session.

    A broken list of participants means none.
    """
    people = table(s, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.min_by(F.from_json("participants", "array<string>"), "id").alias("participants"))
    l = table(s, d, "graph_entry_nodes").where("node_id is not null").select(F.col("entry_id").alias("id"), "node_id").distinct()
    t = table(s, d, "graph_nodes").where("node_type = 'topic'").select(F.col("id").alias("node_id"), "canonical_value")
    t = l.join(t, "node_id").join(table(s, d, "graph_entries").select("id", F.col("source_memory_id").alias("memory_id")), "id").select("memory_id", "canonical_value").distinct()
    # the first topics of a memory by name; a memory's topics are ranked before they are gathered
    w = R.Window.partitionBy("memory_id").orderBy("canonical_value")
    t = t.where("canonical_value is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * G.CAPS["topics"]).groupBy("memory_id").agg(F.sort_array(F.collect_list("canonical_value")).alias("topics"))
    m = mems(s, d).where("text is not null").join(people, "session_id", "left").join(t, "memory_id", "left")
    return m.withColumn("facts", M.facts_of(F.col("text"), G.CAPS["facts"]))


def first_sql(x: str, n: int) -> str:
    """Canonical, not empty, distinct in order, at most n."""
    c = f"list_filter(list_transform({x}, lambda v: {canonical_sql('v')}), lambda v: v <> '')"
    return f"list_slice(list_filter({c}, lambda v, i: list_position({c}, v) = i), 1, {n})"


GM = f"""tops0 as (select distinct source_memory_id memory_id, canonical_value t from graph_entry_nodes l join graph_nodes n on n.id = l.node_id and n.node_type = 'topic' join graph_entries g on g.id = l.entry_id where canonical_value is not null),
tops as (select memory_id, list(t order by t) ts from (select *, row_number() over (partition by memory_id order by t) r from tops0) where r <= 12 group by 1),
ppl as (select session_id, arg_min(from_json(case when json_valid(participants) and json_type(participants) = 'ARRAY' then participants else '[]' end, '["VARCHAR"]'), id) ps from sessions where session_id is not null group by 1),
gp as (select m.memory_id, m.text, {first_sql('coalesce(ts, [])', 6)} topics, {first_sql('coalesce(ps, [])', 8)} persons, list_slice({FACTS.replace('text', 'm.text', 1)}, 1, 8) facts from mem m left join tops on tops.memory_id = m.memory_id left join ppl on ppl.session_id = m.session_id where m.text is not null),
ft as (select memory_id, unnest(facts) f from gp), tp as (select memory_id, unnest(topics) t from gp), pn as (select memory_id, unnest(persons) u from gp),
obs as (select distinct * from (select tp.memory_id, 'topic:' || t source_key, 'fact:' || {canonical_sql('f')} target_key, 'describes' relation_type, 0.82::double confidence from tp join ft using (memory_id)
 union all select pn.memory_id, 'person:' || u, 'fact:' || {canonical_sql('f')}, 'mentioned_in', 0.88::double from pn join ft using (memory_id) union all select a.memory_id, 'person:' || a.u, 'person:' || b.u, 'co_occurs_with', 0.70::double from pn a join pn b on a.memory_id = b.memory_id and b.u > a.u))"""
MERGED = """xo as (select *, row_number() over w - 1 i, count(*) over (partition by source_key, target_key, relation_type) - 1 n from obs window w as (partition by source_key, target_key, relation_type order by memory_id)),
xedges as (select source_key, target_key, relation_type, sum(confidence * (case when i = 0 then 1.0::double else 0.3::double end) * pow(0.7::double, n - i)) confidence, sum(case when i = 0 then 1.0::double else 0.15::double end) weight, count(*) n_obs from xo group by 1, 2, 3)"""


@query(f"with {MEM}, {GM} select * from obs")
def graph_extract(s, d):
    return G.extract_edges(graph_memories(s, d))


@query(f"with {MEM}, {GM}, {MERGED} select source_key, target_key, relation_type, round(confidence, 6) confidence, round(weight, 6) weight, n_obs from xedges")
def graph_edges(s, d):
    return G.merge_edges(G.extract_edges(graph_memories(s, d))).select("source_key", "target_key", "relation_type", r6("confidence"), r6("weight"), "n_obs")


@query(f"""with {MEM}, {GM} select memory_id, 'fact' entry_type, f as content, 0.90::double confidence from ft union all select memory_id, 'topic', t, 0.75::double from tp union all select memory_id, 'participant', u, 0.70::double from pn
 union all select memory_id, 'summary', text, 0.60::double from gp where len(facts) = 0 and len(topics) = 0 and len(persons) = 0 and trim(text, ' ') <> ''""")
def graph_entries_extract(s, d):
    return G.extract_entries(graph_memories(s, d))


# ---- graph search --------------------------------------------------------------------------------
def entries_sql(name: str, src: str, most: int) -> str:
    return f"""{name}0 as (select query_id, entry_id, count(distinct node_id) hits from {src} join lk using (node_id) join graph_entries g on g.id = entry_id group by 1, 2),
{name} as (select * from (select query_id, entry_id, least(1.0::double, 0.35::double + 0.15::double * hits) score, row_number() over (partition by query_id order by hits desc, entry_id desc) rank from {name}0) where rank <= {most})"""


def direct_sql(most: int) -> str:
    return f"""edocs as (select id doc_id, content as text from graph_entries), {bm_sql('edocs', 'e')},
etop as (select * from (select b.query_id, b.doc_id, b.score, g.source_memory_id, row_number() over (partition by b.query_id order by round(b.score, 9) desc, b.doc_id) rank from ebm b join graph_entries g on g.id = b.doc_id) where rank <= {most}), ehits as ({minmax_sql('etop')})"""


def keyword_sql(limit: int) -> str:
    n, ex = max(3 * limit, 12), max(24, 3 * limit)
    return f"""{LINK}, {EDGE}, {direct_sql(n)}, gt as (select distinct query_id, lower(tok) tok from (select query_id, unnest({tokens_sql('query')}) tok from q)),
gm as (select distinct query_id, id, length(canonical_value) len from graph_nodes, gt where contains(lower(canonical_value), tok)), n1 as (select query_id, id node_id from (select *, row_number() over (partition by query_id order by len, id) r from gm) where r <= {n}),
{near_sql('n2', 'n1', ex)}, {near_sql('n3', 'n2', ex)}, n3x as (select query_id, node_id from n3 where not exists (select 1 from n1 where n1.query_id = n3.query_id and n1.node_id = n3.node_id)),
{entries_sql('x1', 'n1', ex)}, {entries_sql('x2', 'n2', ex)}, {entries_sql('x3', 'n3x', ex)},
gh as (select query_id, source_memory_id memory_id, 1 stage, rank, score, doc_id entry_id from ehits union all select x.query_id, g.source_memory_id, st, x.rank, x.score * wt, x.entry_id from
 (select *, 2 st, 0.7::double wt from x1 union all select *, 3, 0.7 from x2 union all select *, 4, 0.4 from x3) x join graph_entries g on g.id = x.entry_id),
gf0 as (select query_id, memory_id, list_reduce(list_prepend(struct_pack(s := -1.0::double, e := null::bigint), list(struct_pack(s := score, e := entry_id) order by stage, rank, score)), lambda a, x: case when x.s > a.s then x else struct_pack(s := least(1.0::double, a.s + 0.35::double * x.s), e := a.e) end) f,
 string_agg(distinct stage::varchar, ',' order by stage::varchar) trail from gh where memory_id is not null group by 1, 2),
gf as (select * from (select query_id, memory_id, f.s score, f.e entry_id, trail, row_number() over (partition by query_id order by round(f.s, 9) desc, memory_id) rank from gf0) where rank <= {limit})"""


def entry_scores(s, d) -> R.Scorer:
    return text_top(s, d, "graph_entries")


def keyword_hits(s, d, q: DataFrame, limit: int = K) -> DataFrame:
    e, l, n, g = graph(s, d)
    return G.keyword_search(q, e, l, n, g, entry_scores(s, d), limit)


@query(f"with {NODEQ}, {direct_sql(10)} select query_id, doc_id, source_memory_id, round(score, 6) score, rank from ehits")
def graph_entry_bm25(s, d):
    q = node_queries(s, d)
    return G.entry_search(entry_scores(s, d), table(s, d, "graph_entries"), q).select("query_id", "doc_id", "source_memory_id", r6("score"), "rank")


@query(f"with {NODEQ}, {keyword_sql(K)} select query_id, memory_id, round(score, 6) score, trail, rank from gf")
def graph_keyword(s, d):
    return keyword_hits(s, d, node_queries(s, d)).select("query_id", "memory_id", r6("score"), "trail", "rank")


def gvec_sql(k: int) -> str:
    return f"""gvs as (select query_id, vec.vec_id doc_id, list_dot_product(gq.e, vec.e) score from (select vec_id query_id, e from vec where vec_id % 50 = 0) gq, vec where vec.vec_id in (select source_memory_id from graph_entries)),
gv as (select * from (select *, {rank_sql('gvs')} rank from gvs) where rank <= {k})"""


def graph_vectors(s, d, k: int) -> DataFrame:
    """One vector for each memory that has entries; the table's vectors stand for those of their documents."""
    v = table(s, d, "embeddings").join(table(s, d, "graph_entries").select(F.col("source_memory_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return R.vector_topk(vec_queries(s, d), v, k)


@query(f"with {EMB}, {gvec_sql(K)} select query_id, doc_id, rank, round(score, 6) score from gv")
def graph_vector(s, d):
    return graph_vectors(s, d, K).select("query_id", "doc_id", "rank", r6("score"))


@query()
def graph_embed(s, d):
    """Memories' joined entries through the embedder that needs no model, searched with every fiftieth node."""
    from engramlake.operators.embedding import embed

    docs = embed(G.entry_documents(table(s, d, "graph_entries")), "source_memory_id", "content")
    q = embed(node_queries(s, d), "query_id", "query").withColumnRenamed("vec_id", "query_id")
    return R.vector_topk(q, docs, 10).select("query_id", "doc_id", "rank", r6("score"))


def fusion_sql(k: int) -> str:
    """Graph route for the queries ``q``; needs EMB and ATOM."""
    return f"""{keyword_sql(k)}, {gvec_sql(k)}, gl as (select query_id, memory_id doc_id, rank, null::double vs from gf union all select query_id, doc_id, rank, score from gv),
gr0 as (select query_id, doc_id, sum(1.0::double / (60 + rank)) rrf_score, max(vs) vec_score from gl group by 1, 2), gr as (select * from (select *, {rank_sql('gr0', 'rrf_score')} rk from gr0) where rk <= {k}),
ge as (select id entry_id, least(1.0::double, greatest(0.0::double, coalesce({number_sql('graph_confidence')}, 0.7))) confidence from graph_entries), gfirst as (select source_memory_id memory_id, min(id) entry_id from graph_entries group by 1),
gatom as (select parent_memory_id memory_id, arg_min(struct_pack(t := ttl_days, k := decay_type), id) a from atom where status = 'active' and parent_memory_id is not null group by 1),
gw0 as (select gr.*, importance, create_time, last_access_time, coalesce(ge.confidence, 0.7) confidence, coalesce(ga.a.t, 0) tt, coalesce(ga.a.k, '') dk, greatest(0.0::double, ({AS_OF} - last_access_time) / 86400.0) dy, rrf_score / max(rrf_score) over (partition by gr.query_id) rel
 from gr left join gf on gf.query_id = gr.query_id and gf.memory_id = gr.doc_id left join gfirst on gfirst.memory_id = gr.doc_id left join ge on ge.entry_id = coalesce(gf.entry_id, gfirst.entry_id) join mem on mem.memory_id = gr.doc_id left join gatom ga on ga.memory_id = gr.doc_id),
gw as (select query_id, doc_id, vec_score, (0.55::double * rel + 0.2::double * importance + 0.15::double * {recency_sql()} + 0.1::double * confidence)
 * case when tt > 0 then case dk when 'linear' then greatest(0.0::double, 1 - dy / greatest(tt, 1.0)) when 'step' then case when dy <= greatest(tt, 1.0) then 1.0::double else 0.05::double end else pow(2.0::double, -dy / greatest(0.5::double, greatest(tt, 1.0) / 2)) end else 1.0::double end score from gw0),
gfu as (select * from (select *, {rank_sql('gw')} rank from gw) where rank <= {k})"""


def fusion_hits(s, d, k: int = K, q: DataFrame | None = None) -> DataFrame:
    q = hybrid_queries(s, d) if q is None else q
    e = table(s, d, "graph_entries")
    kw = keyword_hits(s, d, q, k).select("query_id", F.col("memory_id").alias("doc_id"), "rank", "score", "entry_id")
    c = M.meta_number(F.col("metadata"), "graph_confidence")
    conf = e.select(F.col("id").alias("entry_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.7)))).alias("confidence"))
    first = e.groupBy(F.col("source_memory_id").alias("memory_id")).agg(F.min("id").alias("entry_id"))
    a = A.current(table(s, d, "memory_atoms")).where("status = 'active' and parent_memory_id is not null")
    a = a.groupBy(F.col("parent_memory_id").alias("memory_id")).agg(F.min_by(F.struct("ttl_days", "decay_type"), "id").alias("a")).select("memory_id", "a.*")
    return G.graph_fusion(kw, graph_vectors(s, d, k), mems(s, d), first, a, AS_OF, k, conf)


@query(f"with {MEM}, {ATOM}, {EMB}, {hq_sql(K)}, {fusion_sql(K)} select query_id, doc_id, round(score, 6) score, rank from gfu")
def graph_fusion(s, d):
    return fusion_hits(s, d).select("query_id", "doc_id", r6("score"), "rank")


# ---- both routes ---------------------------------------------------------------------------------
DUAL = f"""{hybrid_sql(2 * K)}, {fusion_sql(2 * K)}, iq as (select query_id, query from q), {INTENT},
dd as (select query_id, doc_id, score, coalesce(vec_score, 0) v, score / coalesce(nullif(max(score) over (partition by query_id), 0), 1) n from hyb), gg as (select query_id, doc_id, score, coalesce(vec_score, 0) v, score / coalesce(nullif(max(score) over (partition by query_id), 0), 1) n from gfu),
dj as (select coalesce(dd.query_id, gg.query_id) query_id, coalesce(dd.doc_id, gg.doc_id) doc_id, dd.score ds, dd.n dn, gg.score gs, gg.n gn, greatest(coalesce(dd.v, 0), coalesce(gg.v, 0)) vec_score from dd full join gg on dd.query_id = gg.query_id and dd.doc_id = gg.doc_id),
dw as (select dj.query_id, dj.doc_id, vec_score, case when bool_or(gs is not null) over (partition by dj.query_id) then least(1.0::double, w_doc * coalesce(dn, 0) + w_graph * coalesce(gn, 0) + case when ds is not null and gs is not null then 0.08::double else 0 end) else ds end score from dj join route on route.query_id = dj.query_id),
dual as (select * from (select query_id, doc_id, score, vec_score, {rank_sql('dw')} rank from dw) where rank <= {K})"""


def dual_hits(s, d) -> DataFrame:
    q = hybrid_queries(s, d)
    return R.dual_route(hybrid_hits(s, d, 2 * K), fusion_hits(s, d, 2 * K, q), R.route_weights(q), K)


@query(f"with {MEM}, {ATOM}, {DUAL} select query_id, doc_id, rank, round(score, 6) score from dual")
def dual_route(s, d):
    return dual_hits(s, d).select("query_id", "doc_id", "rank", r6("score"))


RECENT_AS_OF = 1706745600.0


def slots_sql(src: str, keep: str) -> str:
    return f"""fresh as (select memory_id doc_id, create_time, importance from mem where status = 'active' and create_time <= {RECENT_AS_OF} and create_time >= {RECENT_AS_OF} - 72 * 3600.0 order by create_time desc, memory_id desc limit 6),
nw as (select * from (select q.query_id, fresh.doc_id, row_number() over (partition by q.query_id order by create_time desc, fresh.doc_id desc) r from q, fresh where {keep}) where r <= 2),
rs as (select query_id, doc_id, row_number() over (partition by query_id order by rank) rank from {src} where query_id in (select query_id from q)),
al as (select query_id, doc_id, case when rank <= {K} - 2 or not exists (select 1 from nw where nw.query_id = rs.query_id) then 1 else 3 end part, rank pos from rs union all select query_id, doc_id, 2, r from nw), on_ as (select query_id, doc_id, min(struct_pack(part := part, pos := pos)) o from al group by 1, 2),
slot as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by o.part, o.pos, doc_id) rank from on_) where rank <= {K})"""


@query(f"with {MEM}, {hybrid_sql(K)}, {slots_sql('hyb', 'true')} select query_id, doc_id, rank from slot")
def recent_slots(s, d):
    return R.recent_slots(hybrid_hits(s, d), hybrid_queries(s, d), mems(s, d), RECENT_AS_OF)


@query(f"""with {MEM}, {ATOM}, {DUAL}, pol as (select dual.* from dual join mem on memory_id = doc_id where status = 'active' and importance >= 0.2 and vec_score >= 0.05), {slots_sql('pol', 'importance >= 0.2')} select query_id, doc_id, rank from slot""")
def recall(s, d):
    """Both routes, the policy, then the places of the newest memories that pass it."""
    m = mems(s, d)
    hits = dual_hits(s, d).join(m.where("status = 'active'").select(F.col("memory_id").alias("doc_id"), "importance"), "doc_id")
    return R.recent_slots(M.policy_filter(hits, 0.2, 0.05), hybrid_queries(s, d), m, RECENT_AS_OF, keep=F.col("importance") >= 0.2)


# ---- status --------------------------------------------------------------------------------------
@query("""select count(*) filter (json_valid(metadata) and coalesce(json_array_length(case when json_valid(metadata) then json_extract(metadata, '$.consolidated_from') end), 0) > 0) consolidated,
 count(*) filter (coalesce(json_extract_string(case when json_valid(metadata) then metadata end, '$.status'), 'active') = 'archived') archived from documents""")
def consolidation_status(s, d):
    return L.consolidation_status(table(s, d, "documents"))
