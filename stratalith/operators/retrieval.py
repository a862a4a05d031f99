"""Vector search, rank fusion, reranking and the retrieval dispatcher."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.text import citation_url
from stratalith.operators import lexical
from stratalith.session import cut_lineage

CANDIDATES, RRF, RERANKED, TOP_K = 40, 60, 20, 5
METHODS = ("vector", "lexical", "hybrid", "hybrid-native")
#: Query vectors of one pass over the rows: below 64 MB at 1,024 numbers.
BLOCK = 8_192
#: Queries and rows that are compared at once.
QUERIES, ROWS = 256, 2_048
UNROUNDED = 6
#: Pairs per query and wanted neighbour beyond which a comparison first finds the k-th distance; the part of the pairs
#: compared up to which distances are worked out one by one.
CROWDED, FEW = 16, 1 / 64


def _pieces(nq: int, nx: int, hq: list[np.ndarray], hx: list[np.ndarray]) -> Iterator[list[tuple[np.ndarray, np.ndarray, int | None]]]:
    """Groups of (queries, rows, table) to compare: bucket by bucket of each hash table where that makes fewer pairs, else
    all queries with all rows (table None)."""
    counts = [(np.bincount(a, minlength=(m := int(a.max(initial=0)) + 1)), np.bincount(c[(c >= 0) & (c < m)], minlength=m)) for a, c in zip(hq, hx, strict=True)]
    if not hq or sum(float(a @ c) for a, c in counts) > nq * nx / 2:
        for i in range(0, nq, QUERIES):
            yield [(np.arange(i, min(nq, i + QUERIES)), np.arange(j, min(nx, j + ROWS)), None) for j in range(0, nx, ROWS)]
        return
    group = []
    for t, (a, c) in enumerate(counts):
        by_q, by_x = np.argsort(hq[t], kind="stable"), np.argsort(hx[t], kind="stable")
        at_q, at_x = np.r_[0, np.cumsum(a)], np.count_nonzero(hx[t] < 0) + np.r_[0, np.cumsum(c)]
        for bucket in np.flatnonzero((a > 0) & (c > 0)):
            for i in range(at_q[bucket], at_q[bucket + 1], QUERIES):
                qs = by_q[i : min(at_q[bucket + 1], i + QUERIES)]
                group += [(qs, by_x[j : min(at_x[bucket + 1], j + ROWS)], t) for j in range(at_x[bucket], at_x[bucket + 1], ROWS)]
    yield group


def _nearest_batches(ids: np.ndarray, q: np.ndarray, k: int, other: bool, hashes: Callable | None = None, reach: float = np.inf):
    """hashes: numbers of unit vectors in each table; then only pairs with one of them in common are compared."""
    known = [np.unique(h) for h in hashes(q).T] if hashes else []
    q32, slack = q.astype(np.float32), (q.shape[1] + 16) * 2.0**-23

    def buckets(x: np.ndarray) -> list[np.ndarray]:
        """Per table the place of each vector's number among those of the queries, else -1."""
        out = []
        for h, own in zip(hashes(x).T if hashes else [], known, strict=True):
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            out.append(np.where(own[at] == h, at, -1).astype(np.int8 if len(own) < 128 else np.int32))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = lexical.Best(k, len(q))
        bound = best.bound
        named = lambda rows: (pa.RecordBatch.from_arrays([pa.array(ids[i]), own, pa.array(d)], names=["qid", "id", "score"]) for i, own, d in rows)
        hq, far = buckets(q), reach * reach / 2
        for b in batches:
            col = b.column(1)
            n = np.asarray(col.value_lengths().fill_null(0))
            start = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
            rows = np.flatnonzero(n == q.shape[1])
            if not len(rows):
                continue
            flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(0.0))
            x = flat[start[rows][:, None] + np.arange(q.shape[1])]
            length = np.linalg.norm(x, axis=1)
            ok = np.isfinite(length) & (length > 0)
            rows, x = rows[ok], x[ok] / length[ok][:, None]
            if not len(rows):
                continue
            own, hx = np.asarray(b.column(0))[rows], buckets(x)

            def refused(i: np.ndarray, j: np.ndarray, table: int | None) -> np.ndarray:
                """Pairs that take no part: a row with itself, none or an earlier table in common."""
                no = (own[j] == ids[i]) & other  # noqa: B023
                if hq and table is None:
                    hit = hq[0][i] == hx[0][j]  # noqa: B023
                    for a, c in zip(hq[1:], hx[1:], strict=True):  # noqa: B023
                        hit |= a[i] == c[j]
                    no = no | ~hit
                for a, c in zip(hq[: table or 0], hx[: table or 0], strict=True):  # noqa: B023
                    no = no | (a[i] == c[j])
                return no

            x32 = x.astype(np.float32)
            for group in _pieces(len(q), len(x), hq, hx):
                got = []
                for qs, rs, table in group:
                    # Single precision with more than its error left over finds the pairs whose distance is worth taking.
                    # A cosine distance is 2 at most; a unit of the last place is left for rounding.
                    least = 1 - slack - np.minimum(np.minimum(bound[qs] + 10.0**-UNROUNDED, far), 3)
                    r, c = np.nonzero(q32[qs] @ x32[rs].T >= least.astype(np.float32)[:, None])
                    if len(r) > FEW * len(qs) * len(rs):
                        d = 1 - q[qs] @ x[rs].T
                        if len(r) > CROWDED * k * len(qs) and len(rs) >= k:
                            d[refused(qs[:, None], rs[None, :], table) | (d >= far)] = np.inf
                            bound[qs] = cut = np.minimum(bound[qs], np.round(np.partition(d, k - 1, axis=1)[:, k - 1], UNROUNDED))
                            r, c = np.nonzero(d <= np.minimum(cut + 10.0**-UNROUNDED, 3)[:, None])
                        near = d[r, c]
                    else:
                        near = 1 - np.einsum("ij,ij->i", q[qs[r]], x[rs[c]])
                    i, j = qs[r], rs[c]
                    keep = ~refused(i, j, table) & (near < far)
                    i, j, near = i[keep], j[keep], near[keep]
                    got.append((i, j, np.round(near, UNROUNDED) + 0.0))
                if not got:
                    continue
                i, j, d = map(np.concatenate, zip(*got, strict=True))
                yield from named(best.add(i, pa.array(own[j]), d))
        yield from named(best.rest())

    return run


def vector_scores(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", other: bool = True, hashes: Callable | None = None, reach: float = np.inf) -> DataFrame:
    """(qid, id, score): for each query vector the nearest rows of every task by cosine distance, exact.

    queries: (qid long, vec). They are read in blocks of bounded size; every block is one pass over the rows.
    other: a row is no neighbour of the query with its own id. Null, empty and all-zero vectors take no part.
    hashes, reach: only pairs that share a number of ``hashes`` of their unit vectors and are nearer than this.
    """
    rows = chunks.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).where("size(vec) > 0")
    blocks = max(1, -(-asked.count() // BLOCK))
    parts = []
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow() if blocks > 1 else asked.toArrow()
        vec = block.column("vec").to_pylist()
        keep = [j for j, v in enumerate(vec) if any(v)]
        if not keep:
            continue
        q = np.array([vec[j] for j in keep])
        q /= np.linalg.norm(q, axis=1)[:, None]
        ids = np.asarray(block.column("qid"))[keep]
        parts.append(lexical.long_tasks(rows).mapInArrow(_nearest_batches(ids, q, k, other, hashes, reach), "qid long, id long, score double"))
    if not parts:
        return chunks.sparkSession.createDataFrame([], "qid long, id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vector(chunks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k nearest chunks of each query vector; score is the cosine distance, lower is closer."""
    return lexical.top(vector_scores(chunks, queries, k), chunks.withColumn("id", F.col("id").cast("long")), k, ascending=True)


def shared_ranks(ranked: DataFrame, by: list[str], ascending: bool) -> DataFrame:
    """Adds shared: equal scores share a rank, the next one counts those before it (1, 2, 2, 4)."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return ranked.withColumn("shared", F.rank().over(Window.partitionBy(*by).orderBy(order)).cast("long"))


def fuse(lists: list[DataFrame], chunks: DataFrame, k: int = TOP_K, constant: int = RRF, shared: bool = True) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, id, rank or shared): sum of 1 / (constant + rank)."""
    union = lists[0].select("qid", "id", F.col("shared" if shared else "rank").alias("r"))
    for x in lists[1:]:
        union = union.unionByName(x.select("qid", "id", F.col("shared" if shared else "rank").alias("r")))
    scores = union.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (constant + F.col("r"))), 9).alias("score"))
    return lexical.top(scores, chunks, k)


def hybrid(chunks: DataFrame, questions: DataFrame, queries: DataFrame, k: int = TOP_K, candidates: int = CANDIDATES, native: bool = False) -> DataFrame:
    """BM25 and vector lists of ``candidates`` each, fused. native: positions instead of shared ranks."""
    chunks = chunks.withColumn("id", F.col("id").cast("long"))
    words = lexical.top(lexical.bm25_best(chunks, questions, candidates), chunks, candidates)
    vectors = vector(chunks, queries, candidates)
    lists = [shared_ranks(words, ["qid"], False), shared_ranks(vectors, ["qid"], True)]
    return fuse(lists, chunks, k, shared=not native)


def relevance(logprobs):
    """Log-odds of yes against no from a map token -> log-probability; a missing token takes the lowest one."""
    least = F.array_min(F.map_values(logprobs))
    return F.coalesce(F.try_element_at(logprobs, F.lit("yes")), least) - F.coalesce(F.try_element_at(logprobs, F.lit("no")), least)


def rerank(ranked: DataFrame, scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """Candidates (qid, id, rank, ...) in the order of other scores (qid, id, score), then of their rank; k kept."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "before")
    out = ranked.withColumnsRenamed({"rank": "before"}).drop("score").join(scores.select("qid", "id", "score"), ["qid", "id"], "left")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("before")


def with_documents(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The few ranked rows with their page's address; the top is cut before the join."""
    keys = chunks.select(F.col("id").cast("long").alias("id"), "document_id", "anchor")
    docs = documents.select(F.col("id").alias("document_id"), "url")
    return ranked.withColumn("id", F.col("id").cast("long")).join(keys, "id").join(docs, "document_id").withColumn("citation", citation_url(F.col("url"), F.col("anchor"))).drop("document_id", "anchor")


def score_label(method: str, ranking: str = "bm25", reranked: bool = True) -> str:
    """What a score means."""
    if reranked:
        return "log-odds of the reranker, higher is closer"
    return {"vector": "cosine distance, lower is closer", "lexical": f"{ranking}, higher is closer"}.get(method, "reciprocal rank fusion, higher is closer")


def check_request(method: str, english: str | None = None, ranking: str = "bm25", k: int = TOP_K) -> None:
    """Raises on combinations that have no meaning, before any job."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    if method == "vector" and english is not None:
        raise ValueError("vector search reads the question as it is; no translation")
    if ranking not in ("bm25", "frequency"):
        raise ValueError(f"unknown ranking {ranking!r}")
    if method == "hybrid-native" and ranking != "bm25":
        raise ValueError("hybrid-native ranks by bm25 only")
    if not 1 <= k <= 20:
        raise ValueError("k is between 1 and 20")


def retrieve(chunks: DataFrame, questions: DataFrame, queries: DataFrame | None = None, k: int = TOP_K, method: str = "hybrid", ranking: str = "bm25", english: DataFrame | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ranked chunks for every question in one plan.

    questions: (id, question); queries: (qid, vec); english: (id, question) replaces questions in the lexical half.
    scorer: gives (qid, id, score) of candidates; then max(k, 20) candidates are read and k kept.
    """
    check_request(method, None if english is None else "given", ranking, k)
    depth = max(k, RERANKED) if scorer else k
    asked = questions if english is None else english
    if method != "lexical" and queries is None:
        raise ValueError(f"{method} needs query vectors")
    if method == "vector":
        out = vector(chunks, queries, depth)
    elif method == "lexical":
        out = lexical.bm25(chunks, asked, depth) if ranking == "bm25" else lexical.frequency_rank(chunks, asked, depth)
    else:
        out = hybrid(chunks, asked, queries, depth, native=method == "hybrid-native")
    return rerank(out, scorer(out), k) if scorer else out


def check_backend(backend: str, method: str, index: DataFrame, copy: DataFrame | None) -> DataFrame:
    """The table to search: the index, or its copy in another engine if that is in step. Raises where the method needs
    the copy, where there is none, and where it is stale."""
    from stratalith.operators.index import check_in_step

    if backend not in ("tables", "engine"):
        raise ValueError(f"unknown backend {backend!r}")
    if method == "hybrid-native" and backend != "engine":
        raise ValueError("hybrid-native is the engine's")
    if backend == "tables":
        return index
    if copy is None:
        raise RuntimeError("the engine has no copy; load it first")
    check_in_step(index, copy)
    return copy


def lsh_neighbours(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, bucket: float = 0.6, tables: int = 8, reach: float = 0.7) -> DataFrame:
    """Approximate k nearest chunks: random projections propose candidates within ``reach`` (Euclidean distance of
    unit vectors), which are ranked exactly; queries with fewer than k candidates are answered by the exact search.

    Recall against ``vector`` is 1.0 on the test tables (query vector_lsh_recall); a test holds it at 0.9 or more. Pairs
    are compared bucket by bucket where buckets are selective; wide buckets propose most pairs, and then the cost is that
    of the exact scan. Either way a task keeps only what may be among a query's k.
    """

    def hashes(x: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(11).normal(size=(x.shape[1], tables))
        return np.floor(x @ (planes / np.linalg.norm(planes, axis=0)) / bucket)

    scores = cut_lineage(lexical.first_cut(vector_scores(chunks, queries, k, hashes=hashes, reach=reach), k, ascending=True))
    # Queries without k candidates within reach are answered by the exact search.
    enough = scores.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    rest = queries.select(F.col("qid").cast("long").alias("qid"), "vec").join(enough, "qid", "left_anti")
    scores = scores.join(enough, "qid", "left_semi").unionByName(vector_scores(chunks, rest, k))
    return lexical.top(scores, chunks.withColumn("id", F.col("id").cast("long")), k, ascending=True)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true neighbours that were found."""
    hit = truth.select("qid", "id").join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1.0)), ["qid", "id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))
