"""Ranking: BM25, vectors, fusion, rescoring, routing. Everything is keyed by ``query_id``.

Ranks are made on ids and scores only; texts are joined last. ``row_number <= k`` lets Spark keep k
rows a task before the shuffle. Ties are broken by document id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.config import FACTUAL_TERMS, RELATION_TERMS, TEMPORAL_TERMS, Recall
from engramlake.functions import temporal
from engramlake.functions import text as T

CFG = Recall()
Scorer = Callable[[DataFrame, Column | None], DataFrame]


def rank(df: DataFrame, score: str = "score", by: str = "query_id", tie: str = "doc_id", name: str = "rank") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), F.asc(tie))
    return df.withColumn(name, F.row_number().over(w))


def top(df: DataFrame, k: int | Column, score: str = "score", by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    return rank(df, score, by, tie).where(F.col("rank") <= k)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, dl, tf``; of each document also a row without a term, where tf counts its rows.

    Texts are exchanged by document, not their postings, which are larger; all else is done in the part
    that holds the document.
    """
    parts = max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    t = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartition(parts, "doc_id")
    t = t.select("doc_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("toks"))
    t = t.select("doc_id", F.size("toks").cast("long").alias("dl"), "toks")  # before the explode, so that no row carries the list
    # an outer explode: of a plain one Spark infers a filter that tokenises again
    t = t.select("doc_id", "dl", F.explode_outer(F.array_append("toks", F.lit(None).cast("string"))).alias("term"))
    return t.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, dl, tf``."""
    return counted(docs, key, text).where("term is not null")


def query_terms(queries: DataFrame) -> DataFrame:
    """Query tokens, not de-duplicated: a repeated token counts twice."""
    return queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term"))


def bm25(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: Recall = CFG) -> DataFrame:
    """``query_id, doc_id, score`` of every match: idf ln((N-df+.5)/(df+.5)), at least 1e-6.

    The corpus is tokenised once: its postings' exchange also gives the counts. Only postings of
    query terms survive the first join.
    """
    p = postings(docs, key, text)
    total = p.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))  # the same exchange as below
    n = docs.agg(F.count(F.lit(1)).alias("N")).crossJoin(total).select("N", (F.col("n_tokens") / F.greatest(F.col("N"), F.lit(1))).alias("avgdl"))
    return bm25_of(query_terms(queries), p, n, cfg)


def bm25_of(q: DataFrame, p: DataFrame, n: DataFrame, cfg: Recall = CFG) -> DataFrame:
    """Scores from query terms, postings and the one row ``N, avgdl``."""
    live = p.join(q.select("term").distinct(), "term", "left_semi")
    df = live.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))
    hits = q.join(live, "term").join(df, "term").crossJoin(F.broadcast(n))  # n is one row
    return hits.select("query_id", "doc_id", part.alias("part")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def _query_blocks(q: DataFrame, rows: int) -> DataFrame:
    """Queries in blocks of about ``rows`` terms: ids, limits, and positions of terms in the block's list of terms with their idf."""

    def pack(part: pa.Table) -> pa.RecordBatch:
        terms = part.column("term").combine_chunks().dictionary_encode()
        code = terms.indices.to_numpy().astype(np.int32)
        idf = np.zeros(len(terms.dictionary))
        idf[code] = part.column("idf").to_numpy()
        ids = part.column("query_id").to_numpy()
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        times = part.column("times").to_numpy()
        cols = [ids[first], part.column("most").to_numpy()[first], np.r_[first, len(ids)], code, times, idf]
        return pa.RecordBatch.from_arrays([pa.array([terms.dictionary.to_pylist()], pa.list_(pa.string())), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], names=["q_terms", "q_ids", "q_most", "q_ptr", "q_code", "q_times", "q_idf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "query_id", rows):
            yield pack(part)

    q = q.select("query_id", "term", F.col("times").cast("long").alias("times"), F.col("most").cast("long").alias("most"), "idf")
    return q.repartition(1).sortWithinPartitions("query_id", "term").mapInArrow(run, "q_terms array<string>, q_ids binary, q_most binary, q_ptr binary, q_code binary, q_times binary, q_idf binary")


def _runs(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``rows`` that end where ``key`` changes."""
    have, n = [], 0
    for b in batches:
        if n >= rows and b.num_rows:
            last, ids = have[-1].column(key)[-1].as_py(), b.column(key).to_numpy()
            same = int(np.searchsorted(ids, last, "right"))
            if same < b.num_rows:
                yield pa.Table.from_batches([*have, b.slice(0, same)])
                have, n, b = [], 0, b.slice(same)
        if b.num_rows:
            have.append(b)
            n += b.num_rows
    if have:
        yield pa.Table.from_batches(have)


def _posting_blocks(p: DataFrame, rows: int) -> DataFrame:
    """Postings in blocks of about ``rows`` that hold whole documents: for each term the documents' positions, tf and denominators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "doc_id", rows):
            docs, at = np.unique(part.column("doc_id").to_numpy(), return_inverse=True)
            terms = part.column("term").combine_chunks().dictionary_encode()
            code = terms.indices.to_numpy()
            o = np.argsort(code, kind="stable")
            ptr = np.searchsorted(code[o], np.arange(len(terms.dictionary) + 1))
            cols = [docs, ptr.astype(np.int64), at[o].astype(np.int32), part.column("tf").to_numpy()[o].astype(np.float64), part.column("den").to_numpy()[o]]
            yield pa.RecordBatch.from_arrays([pa.array([terms.dictionary.to_pylist()], pa.list_(pa.string())), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], names=["terms", "docs", "ptr", "at", "tf", "den"])

    # as many parts as cores need, not as the size gives: each part returns its best of every query
    parts = 2 * p.sparkSession.sparkContext.defaultParallelism
    p = p.select("doc_id", "term", "tf", "den").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    return p.mapInArrow(run, "terms array<string>, docs binary, ptr binary, at binary, tf binary, den binary")


def best_of_blocks(q: DataFrame, p: DataFrame, limits: DataFrame, gain: float = 1.0, query_rows: int = 200_000, doc_rows: int = 1_000_000) -> DataFrame:
    """``query_id, doc_id, score``: of the sums of idf * tf * gain / den over a query's terms the best of each query.

    ``q`` has query_id, term, times, idf; ``p`` doc_id, term, tf, den; ``limits`` query_id, most. Blocks of
    queries meet blocks of whole documents; every match is scored, but a block returns only its ``most``
    best of a query (rounded score, then id, as in :func:`rank`), so matches are not shuffled.
    """
    def score(x: dict) -> pa.RecordBatch:
        num = lambda name, kind: np.frombuffer(x[name], kind)
        docs, ptr, at, tf, d = num("docs", np.int64), num("ptr", np.int64), num("at", np.int32), num("tf", np.float64), num("den", np.float64)
        q_ids, q_most, q_ptr, q_code, q_times, q_idf = num("q_ids", np.int64), num("q_most", np.int64), num("q_ptr", np.int64), num("q_code", np.int32), num("q_times", np.int64), num("q_idf", np.float64)
        where = {t: i for i, t in enumerate(x["terms"])}
        here = [where.get(t, -1) for t in x["q_terms"]]
        hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for i in range(len(q_ids)):
            got = []
            for j in range(q_ptr[i], q_ptr[i + 1]):
                c = q_code[j]
                if (h := here[c]) < 0:
                    continue
                if c not in hits:
                    a, b = ptr[h], ptr[h + 1]
                    hits[c] = at[a:b], q_idf[c] * tf[a:b] * gain / d[a:b]
                got.append((hits[c][0], hits[c][1] * q_times[j] if q_times[j] > 1 else hits[c][1]))
            if not got:
                continue
            pos, part = (np.concatenate(c) for c in zip(*got))
            if len(pos) * 8 < len(docs):
                u, inv = np.unique(pos, return_inverse=True)
                s = np.bincount(inv, part)
            else:
                all_ = np.bincount(pos, part, len(docs))
                u = np.flatnonzero(all_)
                s = all_[u]
            k = int(q_most[i])
            if len(u) > k:
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 2e-9)
                u, s = u[near], s[near]
                keep = np.sort(np.lexsort((u, -np.round(s, 9)))[:k])
                u, s = u[keep], s[keep]
            out.append((np.full(len(u), q_ids[i]), docs[u], s))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                yield score(b.slice(at, 1).to_pylist()[0])

    s = _posting_blocks(p, doc_rows).crossJoin(_query_blocks(q.join(limits, "query_id"), query_rows)).mapInArrow(run, "query_id long, doc_id long, score double")
    return top(s.join(limits, "query_id"), F.col("most")).select("query_id", "doc_id", "score")


def bm25_top(queries: DataFrame, p: DataFrame, n: DataFrame, most: Column, cfg: Recall = CFG, query_rows: int = 200_000, doc_rows: int = 1_000_000) -> DataFrame:
    """``query_id, doc_id, score``: the rows of :func:`bm25_of` among the best ``most`` (a column of ``queries``) of their query."""
    q = query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    live = p.join(q.select("term").distinct(), "term", "left_semi")
    df = live.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    q = q.join(df, "term").crossJoin(F.broadcast(n)).withColumn("idf", idf)
    den = F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl"))
    d = live.crossJoin(F.broadcast(n)).withColumn("den", den)  # n is one row
    return best_of_blocks(q, d, queries.select("query_id", most.alias("most")).distinct(), cfg.k1 + 1, query_rows, doc_rows)


def minmax(df: DataFrame, score: str = "score", by: str = "query_id") -> DataFrame:
    """Scores of a query stretched to 0..1; equal scores become 1."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("_lo", lo).withColumn("_hi", hi).withColumn(score, F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_lo", "_hi")


def bm25_search(queries: DataFrame, mem: DataFrame, prefetch: str = "reference", cfg: Recall = CFG, scores: DataFrame | Scorer | None = None) -> DataFrame:
    """Top k of each query, normalised. ``queries`` has query_id, query, k, session_id, persona_id.

    reference: candidates are cut to 2k (10k if scoped) before the filters; exact: filters first.
    ``scores`` are those of :func:`bm25` or of a text index, made here if not given; or a function that
    gives the best of each query, whose number is its second argument.
    """
    cut = F.when(F.col("session_id").isNotNull() | F.col("persona_id").isNotNull(), F.col("k") * 10).otherwise(F.col("k") * 2)
    if callable(scores):
        scores = scores(queries, cut if prefetch == "reference" else None)
    if scores is None:
        scores = bm25(queries, mem.select(F.col("memory_id").alias("doc_id"), "text"), cfg=cfg)
    s = scores.join(queries.select("query_id", "k", F.col("session_id").alias("q_s"), F.col("persona_id").alias("q_p")), "query_id")
    if prefetch == "reference":
        s = top(s, F.when(F.col("q_s").isNotNull() | F.col("q_p").isNotNull(), F.col("k") * 10).otherwise(F.col("k") * 2)).drop("rank")
    s = s.join(mem.select(F.col("memory_id").alias("doc_id"), "session_id", "persona_id", "status"), "doc_id")
    s = s.where("status = 'active' and (q_s is null or session_id = q_s) and (q_p is null or persona_id = q_p)")
    return minmax(top(s, F.col("k"))).select("query_id", "doc_id", "score", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _blocks(df: DataFrame, key: str, vec: str, rows: int) -> DataFrame:
    """Vectors packed into matrices of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = part.column(0).to_numpy().astype(np.int64)
                mat = np.asarray(part.column(1).to_pylist(), np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([mat.tobytes()], pa.binary())], names=["ids", "mat"])

    return df.where(f"{vec} is not null").select(key, vec).mapInArrow(run, "ids binary, mat binary")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, at_least: float = -2.0, key: str = "vec_id", vec: str = "embedding", rows: int = 1024, skip_self: bool = False) -> DataFrame:
    """``query_id, doc_id, score``: exact top k by block products; each block pair keeps k a query.

    Blocks of queries meet blocks of vectors; a task holds one product of ``rows`` squared numbers.
    """
    q = _blocks(queries, "query_id", vec, rows).select(F.col("ids").alias("qi"), F.col("mat").alias("qm"))
    v = _blocks(vectors, key, vec, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qm, ids, mat in zip(*(b.column(i).to_pylist() for i in range(4))):
                a, c = np.frombuffer(qi, np.int64), np.frombuffer(ids, np.int64)
                s = np.frombuffer(qm, np.float32).reshape(len(a), -1).astype(np.float64) @ np.frombuffer(mat, np.float32).reshape(len(c), -1).astype(np.float64).T
                if skip_self:
                    s[a[:, None] == c[None, :]] = -3
                keep = min(k + 8, len(c))  # a few more, so that ties at the edge are settled by id
                part = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                r = np.repeat(np.arange(len(a)), keep)
                sc = s[r, part.ravel()]
                ok = sc >= at_least
                yield pa.RecordBatch.from_arrays([pa.array(a[r][ok]), pa.array(c[part.ravel()][ok]), pa.array(sc[ok])], names=["query_id", "doc_id", "score"])

    return top(q.crossJoin(v).mapInArrow(run, "query_id long, doc_id long, score double"), k)


def similar_pairs(vectors: DataFrame, threshold: float, k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``id_a < id_b, score``: pairs at the threshold among each vector's k nearest."""
    near = vector_topk(vectors.withColumn("query_id", F.col(key)), vectors, k, threshold, key, vec, skip_self=True)
    return near.groupBy(F.least("query_id", "doc_id").alias("id_a"), F.greatest("query_id", "doc_id").alias("id_b")).agg(F.max("score").alias("score"))


def rrf(lists: dict[str, DataFrame], rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``query_id, doc_id, rank, score``; each score is kept."""
    both = None
    for name, df in lists.items():
        one = df.select("query_id", "doc_id", (1.0 / (rrf_k + F.col("rank"))).alias("part"), *[(F.col("score") if n == name else F.lit(None).cast("double")).alias(f"{n}_score") for n in lists])
        both = one if both is None else both.unionByName(one)
    return both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("rrf_score"), *[F.max(f"{n}_score").alias(f"{n}_score") for n in lists])


def weighted(fused: DataFrame, mem: DataFrame, as_of: float, cfg: Recall = CFG) -> DataFrame:
    """Half the fused score over its maximum, a quarter importance, a quarter recency."""
    top_ = F.max("rrf_score").over(Window.partitionBy("query_id"))
    j = fused.withColumn("_m", top_).join(mem.select(F.col("memory_id").alias("doc_id"), "importance", "create_time", "last_access_time"), "doc_id")
    rec = temporal.recency(as_of, F.col("create_time"), F.col("last_access_time"), cfg.decay_rate)
    j = j.withColumn("recency", rec)
    return j.withColumn("score", cfg.weight_rrf * F.col("rrf_score") / F.col("_m") + cfg.weight_importance * F.col("importance") + cfg.weight_recency * F.col("recency")).drop("_m", "create_time", "last_access_time")


def hybrid(queries: DataFrame, vec_queries: DataFrame, mem: DataFrame, vectors: DataFrame, as_of: float, k: int = 10, cfg: Recall = CFG, routes: tuple[str, ...] = ("kw", "vec"), scores: DataFrame | Scorer | None = None) -> DataFrame:
    """BM25 and vectors (2k fetched), fused, rescored, cut to k; ``routes`` may name one of the two only.

    Result: query_id, doc_id, rank, score, rrf_score, importance and, of each route, its score.
    """
    live = vectors.join(mem.where("status = 'active'").select(F.col("memory_id").alias("vec_id")), "vec_id", "left_semi")
    lists = {}
    if "kw" in routes:
        lists["kw"] = bm25_search(queries.withColumn("k", F.lit(k).cast("long")), mem, cfg=cfg, scores=scores)
    if "vec" in routes:
        lists["vec"] = vector_topk(vec_queries, live, 2 * k)
    return top(weighted(rrf(lists, cfg.rrf_k), mem, as_of, cfg), k)


def mmr(hits: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance per query over ``query_id, doc_id, score, text``.

    Candidates of a query are its fetched list, so a group is bounded by the fetch size.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        words = [set((t or "").lower().split()) for t in pdf["text"]]
        chosen, rest = [], list(range(len(pdf)))
        while rest and len(chosen) < k:
            def gain(i: int) -> tuple[float, int]:
                near = max((len(words[i] & words[j]) / len(words[i] | words[j]) if words[i] | words[j] else 0.0 for j in chosen), default=0.0)
                return lam * float(pdf["score"][i]) - (1 - lam) * near, -i

            best = rest[0] if not chosen else max(rest, key=gain)
            chosen.append(best)
            rest.remove(best)
        out = pdf.iloc[chosen][["query_id", "doc_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return hits.select("query_id", "doc_id", "score", "text").groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, score double, rank long")


def has_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(c), F.lit(t))
    return out


def route_weights(queries: DataFrame, cfg: Recall = CFG) -> DataFrame:
    """``w_doc, w_graph, intent`` of each query."""
    q = queries.withColumn("_r", has_any(F.col("query"), RELATION_TERMS)).withColumn("_t", has_any(F.col("query"), TEMPORAL_TERMS)).withColumn("_f", has_any(F.col("query"), FACTUAL_TERMS) & ~F.col("_r"))
    shift = F.when(F.col("_r"), 0.2).otherwise(0.0) + F.when(F.col("_t"), 0.1).otherwise(0.0) - F.when(F.col("_f"), 0.15).otherwise(0.0)
    d = F.greatest(F.lit(0.15), F.least(F.lit(0.9), cfg.doc_route - shift))
    g = F.greatest(F.lit(0.1), F.least(F.lit(0.85), cfg.graph_route + shift))
    label = F.concat_ws("+", F.when(F.col("_r"), "relationship"), F.when(F.col("_t"), "temporal"), F.when(F.col("_f"), "factual"))
    return q.withColumn("w_doc", d / (d + g)).withColumn("w_graph", g / (d + g)).withColumn("intent", F.coalesce(F.nullif(label, F.lit("")), F.lit("default"))).drop("_r", "_t", "_f")


def dual_route(doc: DataFrame, graph: DataFrame, weights: DataFrame, k: int = 10, cfg: Recall = CFG) -> DataFrame:
    """Both routes (2k each) over their maximum, weighted, with a bonus for both; no graph hits: documents as they are.

    ``vec_score`` of a row is the best vector signal of either route; a route that has the document
    without a vector gives 0.
    """
    w = Window.partitionBy("query_id")

    def best(df: DataFrame, name: str) -> DataFrame:
        vec = F.coalesce("vec_score", F.lit(0.0)) if "vec_score" in df.columns else F.lit(0.0)
        return df.select("query_id", "doc_id", F.col("score").alias(name), (F.col("score") / F.coalesce(F.nullif(F.max("score").over(w), F.lit(0.0)), F.lit(1.0))).alias(name + "_n"), vec.alias(name + "_v"))

    j = best(doc, "doc_score").join(best(graph, "graph_score"), ["query_id", "doc_id"], "full_outer").join(weights.select("query_id", "w_doc", "w_graph"), "query_id")
    any_graph = F.max(F.col("graph_score").isNotNull()).over(w)
    both = F.when(F.col("doc_score").isNotNull() & F.col("graph_score").isNotNull(), cfg.both_bonus).otherwise(0.0)
    s = F.least(F.lit(1.0), F.col("w_doc") * F.coalesce("doc_score_n", F.lit(0.0)) + F.col("w_graph") * F.coalesce("graph_score_n", F.lit(0.0)) + both)
    j = j.withColumn("_g", any_graph).withColumn("score", F.when(F.col("_g"), s).otherwise(F.col("doc_score"))).withColumn("vec_score", F.greatest("doc_score_v", "graph_score_v"))
    return top(j.select("query_id", "doc_id", "score", "vec_score"), k)


def newest(queries: DataFrame, mem: DataFrame, as_of: float, slots: int = 2, hours: float = 72.0, keep: Column | None = None) -> DataFrame:
    """``query_id, doc_id, r``: the newest active memories of each query's scope.

    Of each scope (session, persona, both or none) three times ``slots`` are fetched, then ``keep``
    (a policy over importance) applies and the first ``slots`` stay. Memories are ranked once for each
    scope, so a query meets a handful of rows by equality.
    """
    fresh = mem.where((F.col("status") == "active") & (F.col("create_time") <= as_of) & (F.col("create_time") >= as_of - hours * 3600)).select("memory_id", "create_time", "session_id", "persona_id", "importance")
    q = queries.select("query_id", F.least(F.lit(slots), F.col("k")).alias("n"), "session_id", "persona_id")
    out = None
    for cols in ((), ("session_id",), ("persona_id",), ("session_id", "persona_id")):
        want = q.where(" and ".join(f"{c} is {'not ' if c in cols else ''}null" for c in ("session_id", "persona_id")))
        if cols:
            w = Window.partitionBy(*cols).orderBy(F.desc("create_time"), F.desc("memory_id"))
            got = fresh.dropna(subset=list(cols)).withColumn("r0", F.row_number().over(w)).where(F.col("r0") <= 3 * slots)
            j = want.join(got.select(*cols, "memory_id", "importance", "r0"), list(cols))
        else:
            got = fresh.orderBy(F.desc("create_time"), F.desc("memory_id")).limit(3 * slots)
            w = Window.orderBy(F.desc("create_time"), F.desc("memory_id"))  # of at most 3 slots rows
            j = want.crossJoin(F.broadcast(got.withColumn("r0", F.row_number().over(w)).select("memory_id", "importance", "r0")))
        j = j.where(F.col("r0") <= 3 * F.col("n")).select("query_id", "n", F.col("memory_id").alias("doc_id"), "importance", "r0")
        out = j if out is None else out.unionByName(j)
    if keep is not None:
        out = out.where(keep)
    w = Window.partitionBy("query_id").orderBy("r0")
    return out.withColumn("r", F.row_number().over(w)).where("r <= n").select("query_id", "doc_id", "r")


def recent_slots(results: DataFrame, queries: DataFrame, mem: DataFrame, as_of: float, slots: int = 2, hours: float = 72.0, keep: Column | None = None) -> DataFrame:
    """Keeps up to two places for the newest memories in scope: head of the results, new ones, the rest."""
    near = newest(queries, mem, as_of, slots, hours, keep).select("query_id", "doc_id", F.lit(2).alias("part"), F.col("r").alias("pos"))
    q = queries.select("query_id", "k", F.least(F.lit(slots), F.col("k")).alias("n"))
    r = results.join(q, "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    some = near.select("query_id").distinct().withColumn("_any", F.lit(True))
    head = r.join(some, "query_id", "left").select("query_id", "doc_id", F.when(F.col("_any").isNull() | (F.col("rank") <= F.col("k") - F.col("n")), 1).otherwise(3).alias("part"), F.col("rank").alias("pos"))
    once = head.unionByName(near).groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "pos")).alias("o"))
    w = Window.partitionBy("query_id").orderBy("o.part", "o.pos", "doc_id")
    return once.withColumn("rank", F.row_number().over(w)).join(q.select("query_id", "k"), "query_id").where("rank <= k").select("query_id", "doc_id", "rank")
