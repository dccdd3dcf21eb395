"""The memory graph: extraction, merged edges, expansion, search, views, components, communities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators.ranks import bucketed_rank
from engramlake.operators.retrieval import Scorer, best_of_blocks, minmax, top
from engramlake.session import cut, drop_cut
from engramlake.tables import spread

# Confidences of the extracted entries and edges.
ENTRY_CONF = {"fact": 0.90, "topic": 0.75, "participant": 0.70, "summary": 0.60}
EDGE_CONF = {"describes": 0.82, "mentioned_in": 0.88, "co_occurs_with": 0.70}
CAPS = {"topics": 6, "persons": 8, "facts": 8}


def key_of(kind: Column | str, value: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, T.canonical_entity(value))


def prepared(mem: DataFrame) -> DataFrame:
    """Memories with arrays topics, persons, facts capped as the extraction does."""
    cap = lambda c, n: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.canonical_entity), lambda x: x != "")), 1, n)
    return mem.select("memory_id", "session_id", "persona_id", cap(F.col("topics"), CAPS["topics"]).alias("topics"), cap(F.col("participants"), CAPS["persons"]).alias("persons"), F.slice(F.coalesce("facts", F.array().cast("array<string>")), 1, CAPS["facts"]).alias("facts"), "text")


def extract_entries(mem: DataFrame) -> DataFrame:
    """``memory_id, entry_type, content, confidence``; a memory with nothing else has its summary."""
    p = prepared(mem)
    arr = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("entry_type"), x.alias("content"), F.lit(ENTRY_CONF[kind]).alias("confidence")))
    allof = F.concat(arr("fact", F.col("facts")), arr("topic", F.col("topics")), arr("participant", F.col("persons")))
    own = F.when(F.size(allof) > 0, allof).when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, arr("summary", F.array("text")))
    return p.select("memory_id", F.explode(own).alias("e")).select("memory_id", "e.*")


def extract_edges(mem: DataFrame) -> DataFrame:
    """``memory_id, source_key, target_key, relation_type, confidence``; all within a memory, no join."""
    p = prepared(mem)
    edge = lambda a, b, rel: F.struct(a.alias("source_key"), b.alias("target_key"), F.lit(rel).alias("relation_type"), F.lit(EDGE_CONF[rel]).alias("confidence"))
    k = lambda kind, x: F.concat(F.lit(kind + ":"), x)
    fact = lambda x: key_of("fact", x)
    tf = F.flatten(F.transform("topics", lambda t: F.transform("facts", lambda f: edge(k("topic", t), fact(f), "describes"))))
    pf = F.flatten(F.transform("persons", lambda t: F.transform("facts", lambda f: edge(k("person", t), fact(f), "mentioned_in"))))
    pp = F.flatten(F.transform("persons", lambda a: F.transform(F.filter("persons", lambda b: b > a), lambda b: edge(k("person", a), k("person", b), "co_occurs_with"))))
    return p.select("memory_id", F.explode(F.concat(tf, pf, pp)).alias("e")).select("memory_id", "e.*").distinct()


def merge_edges(obs: DataFrame, seq: str = "memory_id") -> DataFrame:
    """Moving averages of repeated edges, in closed form: ranks in blocks of ids, no ordered fold.

    confidence: 0.7 of the old and 0.3 of the new, the first counts whole; weight: first plus 0.15
    of the others.
    """
    keys = ["source_key", "target_key", "relation_type"]
    df = bucketed_rank(obs, keys, F.floor(F.col(seq) / 10_000), [seq], "_i").withColumn("_i", F.col("_i") - 1)
    df = df.join(obs.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_n")), keys)
    share = F.when(F.col("_i") == 0, 1.0).otherwise(0.3) * F.pow(F.lit(0.7), F.col("_n") - F.col("_i"))
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(0.15)
    wt = F.col("weight") if "weight" in obs.columns else F.lit(1.0)
    return df.groupBy(*keys).agg(F.sum(F.col("confidence") * share).alias("confidence"), F.sum(wt * weight).alias("weight"), F.count(F.lit(1)).alias("n_obs"))


def stored_edges(entries: DataFrame, links: DataFrame) -> DataFrame:
    """``source_key, target_key, relation_type, confidence, weight, n_obs`` of the edges behind entries of type ``edge``.

    An edge ties the least and the greatest node its entry links; the confidence is the entry's
    ``graph_confidence`` (0.8 if missing). A memory's later entry of an edge replaces its earlier one;
    edges of several memories merge in the order of entries. Null links and single nodes give none.
    """
    from engramlake.operators.memories import meta_number

    l = links.where("entry_id is not null and node_id is not null").groupBy("entry_id").agg(F.min("node_id").alias("source_key"), F.max("node_id").alias("target_key")).where("source_key < target_key")
    e = entries.where("entry_type = 'edge'").select(F.col("id").alias("entry_id"), F.col("source_memory_id").alias("memory_id"), F.coalesce("relation_type", F.lit("related")).alias("relation_type"), F.coalesce(meta_number(F.col("metadata"), "graph_confidence"), F.lit(0.8)).alias("confidence"))
    keys = ["memory_id", "source_key", "target_key", "relation_type"]
    obs = e.join(l, "entry_id").groupBy(*keys).agg(F.max("entry_id").alias("entry_id"), F.max_by("confidence", "entry_id").alias("confidence"))
    return merge_edges(obs, "entry_id")


def neighbors(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``query_id, node_key, weight`` one step from the seeds (``query_id, node_key``), seeds left out; the heaviest ``most``."""
    both = edges.select(F.col("source_key").alias("node_key"), F.col("target_key").alias("next"), "weight").unionAll(edges.select("target_key", "source_key", "weight"))
    out = seeds.select("query_id", "node_key").join(both, "node_key").groupBy("query_id", F.col("next").alias("node_key")).agg(F.sum("weight").alias("weight"))
    out = out.join(seeds.select("query_id", "node_key"), ["query_id", "node_key"], "left_anti")
    if most is None:
        return out
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 9)), "node_key")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def two_hop(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``query_id, node_key, hop``: breadth first, each node at its first hop."""
    one = neighbors(edges, seeds, most).select("query_id", "node_key")
    two = neighbors(edges, one, most).select("query_id", "node_key").join(seeds.select("query_id", "node_key"), ["query_id", "node_key"], "left_anti")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


def entry_search(scores: DataFrame | Scorer, entries: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Scope first, then the cut: normalised scores of entries.

    ``scores`` may be a function of queries and of how many are wanted: of queries without a scope only
    the best are fetched then, of others every match, since the scope comes before the cut.
    """
    if callable(scores):
        free = F.col("session_id").isNull() & F.col("persona_id").isNull()
        scores = scores(queries.where(free), F.lit(k)).unionByName(scores(queries.where(~free), None))
    q = queries.select("query_id", F.col("session_id").alias("q_s"), F.col("persona_id").alias("q_p"))
    j = scores.join(entries.select(F.col("id").alias("doc_id"), "source_memory_id", "session_id", "persona_id"), "doc_id").join(q, "query_id")
    j = j.where("(q_s is null or session_id = q_s) and (q_p is null or persona_id = q_p)")
    return minmax(top(j, k)).select("query_id", "doc_id", "source_memory_id", "score", "rank")


def _token_blocks(toks: DataFrame, rows: int) -> DataFrame:
    """The distinct tokens in lists of at most ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[str] = []
        for b in batches:
            have += b.column(0).to_pylist()
            while len(have) >= rows:
                yield pa.RecordBatch.from_arrays([pa.array([have[:rows]], pa.list_(pa.string()))], names=["toks"])
                have = have[rows:]
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([have], pa.list_(pa.string()))], names=["toks"])

    return toks.select("tok").distinct().repartition(1).mapInArrow(run, "toks array<string>")


def _value_blocks(nodes: DataFrame, rows: int) -> DataFrame:
    """Nodes in lists of at most ``rows``: lower-case values, ids and lengths."""
    kind = pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = [c.to_pylist() for c in b.slice(at, rows).columns]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(part, kind)], names=["v", "ids", "lens"])

    v = spread(nodes.where("canonical_value is not null").select("id", "canonical_value"))
    return v.select(F.lower("canonical_value").alias("v"), "id", F.length("canonical_value").alias("len")).mapInArrow(run, "v array<string>, ids array<long>, lens array<int>")


def _holders(toks: list[str], values: list[tuple[int, int, str]], most: int) -> Iterator[tuple[str, int, int]]:
    """``token, id, length``: of ``values`` (length, id, text; sorted) the first ``most`` that hold a token.

    The first two characters at a place say which lengths of tokens may begin there. A token that has
    its ``most`` is looked up no more.
    """
    left: dict[str, int] = dict.fromkeys(toks, most)
    last: dict[str, tuple[int, int]] = {}
    starts: dict[str, set[int]] = {}
    for t in toks:
        starts.setdefault(t[:2], set()).add(len(t))
    one = {t for t in toks if len(t) == 1}
    for n, i, v in values:
        found = {c for c in v if c in one}
        for at in range(len(v) - 1):
            for m in starts.get(v[at : at + 2], ()):
                if v[at : at + m] in left:
                    found.add(v[at : at + m])
        for t in found:
            if t in left and last.get(t) != (n, i):
                yield t, i, n
                last[t] = (n, i)
                left[t] -= 1
                if not left[t]:
                    del left[t]
                    one.discard(t)


def token_matches(toks: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """``query_id, node_id, rank``: nodes whose canonical value holds a token (``query_id, tok``); shortest first.

    Blocks of distinct tokens meet blocks of nodes; a block keeps ``most`` nodes a token. A node among
    the first ``most`` of a query is among the first ``most`` of the token that finds it, so nothing is
    lost, and only these few rows a token are shuffled.
    """
    t = toks.where("tok <> ''").select("query_id", F.lower("tok").alias("tok")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                got = list(_holders(row["toks"], sorted(zip(row["lens"], row["ids"], row["v"])), most))
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int32()))], names=["tok", "id", "len"])

    hit = _value_blocks(nodes, 10_000).crossJoin(_token_blocks(t, 100_000)).mapInArrow(run, "tok string, id long, len int").distinct()
    first = Window.partitionBy("tok").orderBy("len", "id")
    hit = hit.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_r")
    one = t.join(hit, "tok").select("query_id", "id", "len").distinct()
    w = Window.partitionBy("query_id").orderBy("len", "id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", F.col("id").alias("node_id"), "rank")


def node_matches(queries: DataFrame, nodes: DataFrame, most: int = 24) -> DataFrame:
    """Nodes for the tokens of a view's text query."""
    return token_matches(queries.select("query_id", F.explode(T.graph_query_tokens(F.col("query"))).alias("tok")), nodes, most)


def entries_of_nodes(hits: DataFrame, links: DataFrame, entries: DataFrame, most: int = 50, queries: DataFrame | None = None) -> DataFrame:
    """Entries linked to the nodes of a query, in its scope: 0.35 plus 0.15 a distinct node, at most 1.

    Links of a node that many entries and many queries share are not joined: blocks of queries meet blocks
    of entries, and a block returns its best of each query. Queries with a scope are joined, since the scope
    comes before the cut.
    """
    hits = hits.select("query_id", "node_id").distinct()
    links = links.where("node_id is not null").select("entry_id", "node_id").distinct()
    e = entries.select(F.col("id").alias("entry_id"), "source_memory_id", "session_id", "persona_id")
    free = hits if queries is None else hits.join(queries.where("session_id is null and persona_id is null").select("query_id"), "query_id", "left_semi")
    q = free.select("query_id", F.col("node_id").cast("string").alias("term"), F.lit(1).alias("times"), F.lit(1.0).alias("idf"))
    # ids are negated: of equal scores the least id comes first, of equal hits the newest entry
    p = links.join(e.select("entry_id"), "entry_id", "left_semi").select((-F.col("entry_id")).alias("doc_id"), F.col("node_id").cast("string").alias("term"), F.lit(1.0).alias("tf"), F.lit(1.0).alias("den"))
    best = best_of_blocks(q, p, free.select("query_id", F.lit(most).alias("most")).distinct())
    c = best.select("query_id", (-F.col("doc_id")).alias("entry_id"), F.col("score").cast("long").alias("hits")).join(e.select("entry_id", "source_memory_id"), "entry_id")
    if queries is not None:
        own = queries.where("session_id is not null or persona_id is not null").select("query_id", F.col("session_id").alias("q_s"), F.col("persona_id").alias("q_p"))
        j = hits.join(own.select("query_id"), "query_id", "left_semi").join(links, "node_id").groupBy("query_id", "entry_id").agg(F.count(F.lit(1)).alias("hits"))
        j = j.join(e, "entry_id").join(own, "query_id").where("(q_s is null or session_id = q_s) and (q_p is null or persona_id = q_p)")
        c = c.unionByName(j.select(*c.columns))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("entry_id"))
    c = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return c.withColumn("score", F.least(F.lit(1.0), 0.35 + 0.15 * F.col("hits")))


def fold_hits(hits: DataFrame) -> DataFrame:
    """``query_id, memory_id, score, entry_id, trail`` from ``query_id, memory_id, stage, rank, score, entry_id``.

    In the order of stages: a higher hit replaces the score (and the entry that stands for the memory),
    a lower one adds 0.35 of itself, up to 1. The list of one memory is bounded by the stages' limits.
    """
    seq = F.array_sort(F.collect_list(F.struct("stage", "rank", "score", "entry_id")))
    first = F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("long").alias("e"))
    fold = lambda a, x: F.when(x["score"] > a["s"], F.struct(x["score"].alias("s"), x["entry_id"].alias("e"))).otherwise(F.struct(F.least(F.lit(1.0), a["s"] + 0.35 * x["score"]).alias("s"), a["e"].alias("e")))
    entry = (F.col("entry_id") if "entry_id" in hits.columns else F.lit(None)).cast("long").alias("entry_id")
    g = hits.select("query_id", "memory_id", "stage", "rank", "score", entry).groupBy("query_id", "memory_id").agg(seq.alias("h")).withColumn("f", F.aggregate("h", first, fold))
    return g.select("query_id", "memory_id", F.col("f.s").alias("score"), F.col("f.e").alias("entry_id"), F.array_join(F.array_distinct(F.transform("h", lambda x: x["stage"].cast("string"))), ",").alias("trail"))


def keyword_search(queries: DataFrame, entries: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame, scores: DataFrame | Scorer, limit: int = 10, hops: int = 2, expansion: int = 24, second: float = 0.4) -> DataFrame:
    """``query_id, memory_id, score, entry_id, trail`` of the best ``limit`` memories of each query.

    Stages: entries by text (weight 1), entries of nodes that hold a query token (0.7), of the nodes one
    edge away (0.7) and, with two hops, two edges away (``second``); a node counts at its first stage.
    """
    n, ex = max(3 * limit, 12), max(expansion, 3 * limit)
    direct = entry_search(scores, entries, queries, n)
    # a few rows a query, used by several stages: written once
    seeds = cut(token_matches(queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("tok")), nodes, n).select("query_id", F.col("node_id").alias("node_key")))
    near = cut(neighbors(edges, seeds, ex).select("query_id", "node_key"))
    stages = [(2, 0.7, seeds), (3, 0.7, near)]
    if hops > 1:
        stages.append((4, second, neighbors(edges, near, ex).join(seeds, ["query_id", "node_key"], "left_anti").select("query_id", "node_key")))
    out = direct.select("query_id", F.col("source_memory_id").alias("memory_id"), F.lit(1).alias("stage"), "rank", "score", F.col("doc_id").alias("entry_id"))
    for no, weight, found in stages:
        e = entries_of_nodes(found.withColumnRenamed("node_key", "node_id"), links, entries, ex, queries)
        out = out.unionByName(e.select("query_id", F.col("source_memory_id").alias("memory_id"), F.lit(no).alias("stage"), "rank", (F.col("score") * weight).alias("score"), "entry_id"))
    folded = fold_hits(out.where("memory_id is not null"))
    return top(folded.withColumnRenamed("memory_id", "doc_id"), limit).withColumnRenamed("doc_id", "memory_id")


def node_weights(nodes: DataFrame, links: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries + 0.75 memories + 0.35 degree of every node with an entry; the degree counts edges between such nodes."""
    l = links.where("node_id is not null and entry_id is not null").select("entry_id", "node_id").distinct()
    j = l.join(entries.select(F.col("id").alias("entry_id"), "source_memory_id"), "entry_id").groupBy("node_id").agg(F.count(F.lit(1)).alias("entry_count"), F.countDistinct("source_memory_id").alias("memory_count"))
    j = j.join(nodes.select(F.col("id").alias("node_id"), "node_type", "node_value", "canonical_value"), "node_id")
    live = edges.join(j.select(F.col("node_id").alias("source_key")), "source_key", "left_semi").join(j.select(F.col("node_id").alias("target_key")), "target_key", "left_semi")
    deg = live.select(F.col("source_key").alias("node_id")).unionAll(live.select("target_key")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    j = j.join(deg, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return j.withColumn("weight", F.round(F.col("entry_count") + 0.75 * F.col("memory_count") + 0.35 * F.col("degree"), 4))


def view_order() -> list[Column]:
    """Order of nodes in a view: weight, entries, degree, label; then the id."""
    return [F.desc("weight"), F.desc("entry_count"), F.desc("degree"), F.coalesce("node_value", F.lit("")).asc(), F.asc("node_id")]


def entry_documents(entries: DataFrame, most: int = 4000) -> DataFrame:
    """One text for each memory: its entries' distinct contents in order of id, cut.

    Entries of one memory are few by construction; a longer list is cut after the sort.
    """
    g = entries.where("content is not null").groupBy("source_memory_id", "content").agg(F.min("id").alias("id"))
    w = Window.partitionBy("source_memory_id").orderBy("id")
    g = g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return g.groupBy("source_memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]), "\n").alias("t")).select("source_memory_id", F.left("t", F.lit(most)).alias("content"))


def orphans(nodes: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that no living entry refers to."""
    used = links.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select(F.col("node_id").alias("id")).where("id is not null").distinct()
    return nodes.join(used, "id", "left_anti").select("id", "node_key")


def delete_memories(entries: DataFrame, links: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, links and nodes after the removal of memories (``memory_id``) and of orphaned nodes."""
    e = entries.join(gone.select(F.col("memory_id").alias("source_memory_id")), "source_memory_id", "left_anti")
    l = links.join(e.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    return e, l, nodes.join(l.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")


def components(pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``id, component``: least label over undirected pairs ``id_a, id_b``; labels also jump to their label's label.

    A round costs two aggregations; lineage is cut in the shared folder after each.
    """
    e = cut(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionAll(pairs.select("id_b", "id_a")).where("a <> b").distinct())
    lab = cut(e.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("l")))
    for _ in range(max_rounds):
        near = e.join(lab.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        step = lab.join(near, "a", "left").select("a", F.least("l", F.coalesce("m", "l")).alias("n"), "l")
        step = step.join(lab.select(F.col("a").alias("n"), F.col("l").alias("ln")), "n", "left").select("a", F.least("n", F.coalesce("ln", "n")).alias("n"), "l")
        step = cut(step)
        moved = step.where("n <> l").limit(1).count()
        drop_cut(lab)
        lab = cut(step.select("a", F.col("n").alias("l")))
        drop_cut(step)
        if not moved:
            return lab.select(F.col("a").alias("id"), F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def latest_entry(entries: DataFrame) -> DataFrame:
    """The newest entry of each memory and type."""
    return entries.groupBy("source_memory_id", "entry_type").agg(F.max("id").alias("entry_id"))


def recent_memories(entries: DataFrame, most: int = 200) -> DataFrame:
    """``memory_id, last_entry``: memories by their newest entry, 1 to 200."""
    g = entries.where("source_memory_id is not null").groupBy(F.col("source_memory_id").alias("memory_id")).agg(F.max("id").alias("last_entry"))
    return g.orderBy(F.desc("last_entry")).limit(max(1, min(200, most)))


def subgraph(entries: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame, memories: DataFrame, most_entries: int = 36, most_nodes: int = 48, most_edges: int = 72) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``nodes, edges, entries, memories`` of one view of the given memories.

    The newest entries, their nodes, the newest edges among these (``edges`` has edge_id, memory_id,
    source_key, target_key); then the heaviest nodes stay, with edges and entries that keep a node
    (a summary stays without one), and memories are counted over what stays.
    """
    want = memories.select(F.col("memory_id").alias("source_memory_id")).distinct()
    e = entries.join(want, "source_memory_id", "left_semi").orderBy(F.desc("id")).limit(most_entries).select("id", "source_memory_id", "entry_type", "metadata")
    l = links.where("node_id is not null").join(e.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select("entry_id", "node_id").distinct()
    l = l.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    seen = l.select("node_id").distinct()
    g = edges.join(want.withColumnRenamed("source_memory_id", "memory_id"), "memory_id", "left_semi").join(seen.withColumnRenamed("node_id", "source_key"), "source_key", "left_semi").join(seen.withColumnRenamed("node_id", "target_key"), "target_key", "left_semi")
    g = g.orderBy(F.desc("edge_id")).limit(most_edges)
    n = node_weights(nodes, l, e, g).orderBy(*view_order()).limit(most_nodes)
    kept = n.select("node_id")
    g = g.join(kept.withColumnRenamed("node_id", "source_key"), "source_key", "left_semi").join(kept.withColumnRenamed("node_id", "target_key"), "target_key", "left_semi")
    l = l.join(kept, "node_id", "left_semi")
    e = e.join(l.select(F.col("entry_id").alias("id"), F.lit(True).alias("_has")).distinct(), "id", "left").where("_has or entry_type = 'summary'").drop("_has")
    per = e.groupBy(F.col("source_memory_id").alias("memory_id")).agg(F.count(F.lit(1)).alias("entry_count"))
    ln = l.join(e.select(F.col("id").alias("entry_id"), F.col("source_memory_id").alias("memory_id")), "entry_id").groupBy("memory_id").agg(F.countDistinct("node_id").alias("node_count"))
    m = per.join(g.groupBy("memory_id").agg(F.count(F.lit(1)).alias("edge_count")), "memory_id", "left").join(ln, "memory_id", "left")
    m = m.select("memory_id", "entry_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("node_count", F.lit(0)).alias("node_count"))
    return n, g, e, m


def memory_edges(entries: DataFrame, links: DataFrame) -> DataFrame:
    """``edge_id, memory_id, source_key, target_key, relation_type``: edges before they merge; the id is the entry's."""
    l = links.where("entry_id is not null and node_id is not null").groupBy("entry_id").agg(F.min("node_id").alias("source_key"), F.max("node_id").alias("target_key")).where("source_key < target_key")
    e = entries.where("entry_type = 'edge'").select(F.col("id").alias("entry_id"), F.col("source_memory_id").alias("memory_id"), F.coalesce("relation_type", F.lit("related")).alias("relation_type"))
    return e.join(l, "entry_id").withColumnRenamed("entry_id", "edge_id")


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_key, community``: hubs of high degree, then breadth-first claims until nothing moves.

    ``nodes`` has ``node_key, weight``. One hub under 8 nodes, else the root of a sixth of their number,
    from 2 to 12. A hub is the node of highest degree that touches no earlier hub, or, if none is left, of
    highest degree. A node goes to the nearest hub, the first one of equally near. Unreached nodes share
    one community. Communities are numbered by size. The driver holds only the hubs.
    """
    both = cut(edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).unionAll(edges.select("target_key", "source_key")).where("a <> b"))
    deg = both.groupBy(F.col("a").alias("node_key")).agg(F.count(F.lit(1)).alias("d"))
    ranked = cut(nodes.select("node_key", "weight").join(deg, "node_key", "left").withColumn("d", F.coalesce("d", F.lit(0))))
    spark, n = edges.sparkSession, ranked.count()
    target = 1 if n < 8 else max(2, min(12, int((n / 6) ** 0.5 + 0.5)))
    hubs: list = []
    key_type = dict(ranked.dtypes)["node_key"]
    as_frame = lambda: spark.createDataFrame([(h, i) for i, h in enumerate(hubs)], f"node_key {key_type}, community int")
    best = lambda df: df.orderBy(F.desc("d"), F.desc("weight"), "node_key").limit(1).collect()
    apart = True
    while len(hubs) < min(target, n):
        left = ranked if not hubs else ranked.join(as_frame().select("node_key"), "node_key", "left_anti")
        if hubs and apart:
            left = left.join(both.join(as_frame().select(F.col("node_key").alias("b")), "b", "left_semi").select(F.col("a").alias("node_key")), "node_key", "left_anti")
        got = best(left)
        if not got:
            apart = False
            continue
        hubs.append(got[0].node_key)
    lab = as_frame()
    front = lab
    while hubs:
        step = front.join(both, F.col("node_key") == F.col("a")).groupBy(F.col("b").alias("node_key")).agg(F.min("community").alias("community")).join(lab.select("node_key"), "node_key", "left_anti")
        front = cut(step)
        if not front.limit(1).count():
            break
        lab = cut(lab.unionByName(front))
    rest = ranked.join(lab.select("node_key"), "node_key", "left_anti").select("node_key", F.lit(len(hubs)).alias("community"))
    own = lab.join(ranked.select("node_key"), "node_key", "left_semi").unionByName(rest)
    size = own.groupBy("community").agg(F.count(F.lit(1)).alias("n"))  # at most 13 rows
    w = Window.orderBy((F.col("community") == len(hubs)).cast("int"), F.desc("n"), "community")
    size = size.select("community", (F.row_number().over(w) - 1).alias("no"))
    return own.join(size, "community").select("node_key", F.col("no").alias("community"))


def extract_atom_edges(atoms: DataFrame) -> DataFrame:
    """Atom mode: each entity of an atom points to the atom's fact with 0.9 of its confidence.

    ``atoms`` has id, parent_memory_id, content, confidence and entities (a JSON list; broken: none).
    """
    ents = F.from_json("entities", "array<string>")
    e = atoms.where("content is not null").select("id", F.col("parent_memory_id").alias("memory_id"), key_of("fact", F.col("content")).alias("target_key"), (F.coalesce("confidence", F.lit(0.6)) * 0.9).alias("confidence"), F.explode(F.array_distinct(F.transform(ents, T.canonical_entity))).alias("entity"))
    return e.where("entity <> ''").select("id", "memory_id", F.concat(F.lit("entity:"), "entity").alias("source_key"), "target_key", "confidence")


def participant_keys(identity: Column, name: Column) -> Column:
    """A stable account key first, else the name's."""
    return F.coalesce(F.concat(F.lit("account:"), F.nullif(F.trim(identity), F.lit(""))), F.concat(F.lit("person:"), T.canonical_entity(name)))


def graph_fusion(keyword: DataFrame, vector: DataFrame | None, mem: DataFrame, first: DataFrame, atoms: DataFrame, as_of: float, k: int = 10, confidence: DataFrame | None = None) -> DataFrame:
    """Graph route: keyword and vector lists (``query_id, doc_id, rank, score``; keyword with its ``entry_id``), fused and cut to k.

    Then fused score over its maximum, importance, recency and the confidence of the entry that stands
    for the memory (``first`` gives that of a vector hit; 0.7 if none is named), all times the decay of
    the memory's atom (``atoms``: memory_id, ttl_days, decay_type) since its last access.
    """
    from engramlake.functions import temporal
    from engramlake.operators.retrieval import rrf

    lists = {"kw": keyword} if vector is None else {"kw": keyword, "vec": vector}
    fused = top(rrf(lists), k, "rrf_score").drop("rank")
    if vector is None:
        fused = fused.withColumn("vec_score", F.lit(None).cast("double"))
    fused = fused.join(keyword.select("query_id", "doc_id", "entry_id"), ["query_id", "doc_id"], "left").join(first.select(F.col("memory_id").alias("doc_id"), F.col("entry_id").alias("_first")), "doc_id", "left")
    j = fused.withColumn("_e", F.coalesce("entry_id", "_first")).withColumn("_m", F.max("rrf_score").over(Window.partitionBy("query_id")))
    j = j.join(mem.select(F.col("memory_id").alias("doc_id"), "importance", "create_time", "last_access_time"), "doc_id")
    if confidence is not None:
        j = j.join(confidence.select(F.col("entry_id").alias("_e"), "confidence"), "_e", "left")
    else:
        j = j.withColumn("confidence", F.lit(None).cast("double"))
    j = j.join(atoms.select(F.col("memory_id").alias("doc_id"), "ttl_days", "decay_type"), "doc_id", "left")
    rec = temporal.recency(as_of, F.col("create_time"), F.col("last_access_time"))
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("last_access_time")) / 86400.0)
    factor = F.when(F.coalesce("ttl_days", F.lit(0.0)) > 0, temporal.decay_score(F.coalesce("decay_type", F.lit("")), age, F.col("ttl_days"))).otherwise(1.0)
    s = (0.55 * F.col("rrf_score") / F.col("_m") + 0.2 * F.col("importance") + 0.15 * rec + 0.1 * F.coalesce("confidence", F.lit(0.7))) * factor
    return top(j.withColumn("score", s).select("query_id", "doc_id", "score", "vec_score"), k)
