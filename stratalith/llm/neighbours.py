"""Most similar vectors for every vector: robust-pruned directed graphs over shards, searched by beams.

1. Vectors that are equal become one point that carries its few smallest ids; null, empty, all-zero, non-finite
   vectors and those of another dimension than ``dim`` take no part.
2. Pivots (k-means) and a projection (PCA) are fitted on a bounded sample of ``sample`` points or three a pivot, the
   ones with the smallest hash. Every point is indexed: in the shard of its nearest pivot and of up to ``overlap`` - 1 others that
   are nearly as close, so that neighbours parted by a border still meet. A shard above ``shard`` points is cut
   into sub-shards, each with a graph of its own that all points of the shard query, in blocks.
3. A shard's graph is grown in batches: a greedy search from seeds proposes neighbours, relaxed distance pruning
   (keep c only if no kept p* has alpha * d(p*, c) <= d(p, c)) picks at most ``degree`` diverse ones, reverse edges
   are added and pruned when a list is full. Growth works on the projected vectors, whole batches in NumPy.
4. Every point queries the graph with a beam of ``beam`` on the full vectors, from its own node or the seeds.
   Candidates are ranked exactly: cosine distance in double precision, rounded to 6 decimals, then the smaller id.

What leaves a shard is at most k + 1 ids a point. Repeated ids are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.session import cut_lineage


def _vector_batches(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        sent: set[int] = set()
        for b in batches:
            col = b.column(1)
            n = np.asarray(col.value_lengths().fill_null(0))
            flat = np.asarray(col.flatten().cast(pa.float32()).fill_null(float("nan")), dtype=np.float32)
            start = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
            rows = np.flatnonzero((n == dim) & b.column(0).is_valid().to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            x = flat[start[rows][:, None] + np.arange(dim)] + np.float32(0)  # -0 becomes 0
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            rows, x = rows[ok], x[ok]
            ids = b.column(0).take(pa.array(rows)).cast(pa.int64())
            raw = [r.tobytes() for r in x]
            fps = [xxh3_128_intdigest(r) for r in raw]
            if len(sent) > 1_000_000:
                sent.clear()
            vec = [None if f in sent else (sent.add(f), r)[1] for f, r in zip(fps, raw, strict=True)]
            fp1 = np.array([f >> 64 for f in fps], np.uint64).view(np.int64)
            fp2 = np.array([f & ((1 << 64) - 1) for f in fps], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp1), pa.array(fp2), pa.array(vec, pa.binary())], names=["id", "fp1", "fp2", "vec"])

    return run


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        norm = np.linalg.norm(new, axis=1)
        c = np.where(norm[:, None] > 1e-9, new / np.maximum(norm, 1e-9)[:, None], c).astype(np.float32)
    return c


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _shards_of(x: np.ndarray, pivots: np.ndarray, overlap: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(shards n x overlap, whether the point belongs to it): the nearest pivot and those nearly as close."""
    s = x.astype(np.float32) @ pivots.T
    m = min(overlap, s.shape[1])
    top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(s), 1))
    v = np.take_along_axis(s, top, 1)
    order = np.argsort(-v, axis=1, kind="stable")
    top, v = np.take_along_axis(top, order, 1), np.take_along_axis(v, order, 1)
    return top, (1 - v) <= (1 - v[:, :1]) * (1 + slack) + 1e-6


def _assign_batches(dim: int, pivots: np.ndarray, overlap: int, slack: float, subs: dict[int, int] | None, blocks: dict[int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                x = _unit(b.column(2).to_pylist(), dim)
                top, member = _shards_of(x, pivots, overlap, slack)
                row, j = np.nonzero(member)
                shard = top[row, j]
                if subs is None:
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64))], names=["shard"])
                    continue
                h = b.column(1).to_numpy()[row]
                sub = np.zeros(len(row), np.int64)
                block = np.zeros(len(row), np.int64)
                base = np.ones(len(row), bool)
                query = np.ones(len(row), bool)
                many = np.flatnonzero([s in subs for s in shard.tolist()])
                if len(many):  # cut shards: one base row per block, one query row per sub-shard
                    extra = []
                    for k in many.tolist():
                        s, u = int(shard[k]), int(h[k])
                        own, mine = u % subs[s], (u >> 20) % blocks[s]
                        extra += [(k, own, q, True, q == mine) for q in range(blocks[s])]
                        extra += [(k, o, mine, False, True) for o in range(subs[s]) if o != own]
                    keep = np.setdiff1d(np.arange(len(row)), many)
                    e = np.array(extra, np.int64)
                    take = np.r_[keep, e[:, 0]]
                    sub, block = np.r_[sub[keep], e[:, 1]], np.r_[block[keep], e[:, 2]]
                    base, query = np.r_[base[keep], e[:, 3] > 0], np.r_[query[keep], e[:, 4] > 0]
                    row, shard = row[take], shard[take]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int64)), pa.array(sub), pa.array(block), pa.array(base), pa.array(query), b.column(0).take(pick), b.column(2).take(pick)],
                    names=["shard", "sub", "block", "base", "query", "ids", "vec"],
                )

    return run


class Graph:
    """A directed graph over unit vectors, grown by greedy searches and relaxed distance pruning."""

    def __init__(self, x: np.ndarray, degree: int = 16, width: int = 24, alpha: float = 1.2, batch: int = 512, seeds: int = 48) -> None:
        self.x, self.degree, self.room, self.width = np.ascontiguousarray(x, np.float32), degree, 2 * degree, width
        self.alpha = np.float32(alpha * alpha)  # squared distances
        m = len(x)
        self.edges = np.full((m + 1, self.room), m, np.int32)  # m: no node
        self.count = np.zeros(m + 1, np.int64)
        order = np.random.default_rng(5).permutation(m)
        self.seeds = order[: min(seeds, m)].astype(np.int32)
        self._insert(self.seeds, np.tile(self.seeds, (len(self.seeds), 1)))
        at, size = len(self.seeds), len(self.seeds)
        while at < m:
            size = min(batch, max(size, at // 2))
            new = order[at : at + size].astype(np.int32)
            found, _ = self.search(self.x[new], width)
            self._insert(new, found)
            at += size

    def _insert(self, new: np.ndarray, candidates: np.ndarray) -> None:
        kept = self._prune(new, candidates, self.degree)
        self.edges[new, : self.degree] = kept
        self.count[new] = (kept < len(self.x)).sum(1)
        # reverse edges
        to, frm = kept.ravel(), np.repeat(new, kept.shape[1])
        ok = to < len(self.x)
        to, frm = to[ok], frm[ok]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(to)])
        node = to[first]
        slot = np.arange(len(to)) - np.repeat(first, n) + np.repeat(self.count[node], n)
        fits = np.repeat(self.count[node] + n <= self.room, n)
        self.edges[to[fits], slot[fits]] = frm[fits]
        ok = self.count[node] + n <= self.room
        self.count[node[ok]] += n[ok]
        full = np.flatnonzero(~ok)
        if len(full):
            most = int(min(n[full].max(), 2 * self.room))
            union = np.full((len(full), self.room + most), len(self.x), np.int32)
            union[:, : self.room] = self.edges[node[full]]
            for r, f in enumerate(full.tolist()):
                own = frm[first[f] : first[f] + n[f]]
                if len(own) > most:  # the nearest of a crowd
                    own = own[np.argsort(-(self.x[own] @ self.x[node[f]]), kind="stable")[:most]]
                union[r, self.room : self.room + len(own)] = own
            kept = self._prune(node[full], union, self.degree)
            self.edges[node[full]] = len(self.x)
            self.edges[node[full], : self.degree] = kept
            self.count[node[full]] = (kept < len(self.x)).sum(1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
        """At most ``degree`` diverse candidates of each node, nearest first; filled up with len(x)."""
        m, (q, k) = len(self.x), candidates.shape
        pad = np.r_[self.x, np.zeros((1, self.x.shape[1]), np.float32)] if not hasattr(self, "_pad") else self._pad
        self._pad = pad
        candidates = np.sort(candidates, axis=1)
        bad = (candidates == m) | (candidates == nodes[:, None])
        bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        v = pad[candidates]
        d = 2 - 2 * np.einsum("qkd,qd->qk", v, self.x[nodes])
        d[bad] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, : max(2 * degree, 24)]
        candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(d)
        out = np.full((q, degree), m, np.int32)
        rows = np.arange(q)
        for j in range(degree):
            first = alive.argmax(1)
            has = alive[rows, first]
            if not has.any():
                break
            out[has, j] = candidates[rows[has], first[has]]
            alive &= ~(has[:, None] & (self.alpha * between[rows, first] <= d))
            alive[rows, first] = False
        return out

    def search(self, queries: np.ndarray, width: int, start: np.ndarray | None = None, x: np.ndarray | None = None, fan: int = 4, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of every query: (nodes, similarities), nearest first; missing ones are len(x) with -inf.

        start: nodes to begin from (one a query), else the seeds. x: other vectors of the same nodes.
        """
        parts = [self._search(queries[a : a + block], width, None if start is None else start[a : a + block], self.x if x is None else x, fan) for a in range(0, len(queries), block)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, queries: np.ndarray, width: int, start: np.ndarray | None, x: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(x), len(queries)
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True
        rows = np.arange(n)[:, None]
        beam = np.full((n, width), m, np.int32)
        sim = np.full((n, width), -np.inf, np.float32)
        if start is None:
            s = queries @ x[self.seeds].T
            k = min(width, len(self.seeds))
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            beam[:, :k], sim[:, :k] = self.seeds[top], np.take_along_axis(s, top, 1)
            seen[:, self.seeds] = True
        else:
            beam[:, 0], sim[:, 0] = start, np.einsum("qd,qd->q", queries, x[start])
            seen[np.arange(n), start] = True
        done = beam == m
        live = np.arange(n)
        while len(live):
            r = rows[: len(live)]
            open_ = np.where(done[live], -np.inf, sim[live])
            pick = np.argpartition(-open_, fan - 1, axis=1)[:, :fan]
            ok = np.take_along_axis(open_, pick, 1) > -np.inf
            going = ok.any(1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            r = rows[: len(live)]
            nodes = np.where(ok, beam[live[:, None], pick], m)
            done[live[:, None], pick] = True
            nxt = self.edges[nodes].reshape(len(live), -1)
            fresh = ~seen[live[:, None], nxt]
            seen[live[:, None], nxt] = True
            a, b = np.nonzero(fresh)
            node = nxt[a, b]
            # the same node can be reached twice in one step
            key = a.astype(np.int64) * (m + 1) + node
            _, once = np.unique(key, return_index=True)
            a, node = a[once], node[once]
            s = np.einsum("qd,qd->q", x[node], queries[live[a]])
            good = s > sim[live[a], -1]
            a, node, s = a[good], node[good], s[good]
            if not len(a):
                continue
            n_new = np.bincount(a, minlength=len(live))
            most = int(n_new.max())
            slot = np.arange(len(a)) - np.repeat(np.cumsum(n_new) - n_new, n_new)
            cand = np.full((len(live), width + most), m, np.int32)
            csim = np.full((len(live), width + most), -np.inf, np.float32)
            cdone = np.ones((len(live), width + most), bool)
            cand[:, :width], csim[:, :width], cdone[:, :width] = beam[live], sim[live], done[live]
            cand[a, width + slot], csim[a, width + slot], cdone[a, width + slot] = node, s, False
            order = np.argsort(-csim, axis=1, kind="stable")[:, :width]
            beam[live], sim[live], done[live] = cand[r, order], csim[r, order], cdone[r, order]
        return beam, sim


def nearest_in_shard(x: np.ndarray, ids: list[list[int]], base: np.ndarray, query: np.ndarray, k: int, basis: np.ndarray, degree: int, width: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, neighbour id, distance) rows: for every querying point the first k + 1 ids by (distance, id).

    x: unit vectors in double precision; ids: the smallest ids of each point. A point's own ids are among them.
    """
    at = np.flatnonzero(base)
    low = x.astype(np.float32) @ basis
    low /= np.maximum(np.linalg.norm(low, axis=1), 1e-12)[:, None].astype(np.float32)
    graph = Graph(low[at], degree, width)
    full = x[at].astype(np.float32)
    own = np.full(len(x), -1, np.int64)
    own[at] = np.arange(len(at))
    ask = np.flatnonzero(query)
    inside, outside = ask[own[ask] >= 0], ask[own[ask] < 0]
    node = np.full((len(x), beam), len(at), np.int32)
    if len(inside):
        node[inside] = graph.search(full[own[inside]], beam, own[inside].astype(np.int32), full)[0]
    if len(outside):
        # projected first, to come near; then the full vectors from the best node
        near = graph.search(low[outside], width)[0][:, 0]
        node[outside] = graph.search(x[outside].astype(np.float32), beam, near, full)[0]
    n_ids = np.array([len(ids[i]) for i in at.tolist()] + [0])
    flat = np.array([v for i in at.tolist() for v in ids[i]], np.int64)
    first = np.r_[0, np.cumsum(n_ids)]
    points, out, dist = [], [], []
    for a in range(0, len(ask), 1024):
        q = ask[a : a + 1024]
        nb = node[q]
        ok = nb < len(at)
        d = np.full(nb.shape, np.inf)
        r, c = np.nonzero(ok)
        d[r, c] = np.round(1 - np.einsum("qd,qd->q", x[at[nb[r, c]]], x[q[r]]), 6) + 0.0
        # points to ids: each has at most k + 1 of them
        r, c = np.nonzero(ok)
        n = n_ids[nb[r, c]]
        e = np.repeat(first[nb[r, c]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pr, pd, pid = np.repeat(r, n), np.repeat(d[r, c], n), flat[e]
        order = np.lexsort((pid, pd, pr))
        pr, pd, pid = pr[order], pd[order], pid[order]
        begin = np.searchsorted(pr, np.arange(len(q)))
        keep = np.arange(len(pr)) - begin[pr] <= k
        points.append(q[pr[keep]])
        out.append(pid[keep])
        dist.append(pd[keep])
    join = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
    return join(points, np.int64), join(out, np.int64), join(dist, np.float64)


def _shard_groups(dim: int, k: int, basis: np.ndarray, degree: int, width: int, beam: int):
    def run(t: pa.Table) -> pa.Table:
        x = _unit(t.column("vec").to_pylist(), dim)
        ids = t.column("ids").to_pylist()
        base, query = t.column("base").to_numpy(), t.column("query").to_numpy()
        # the same vector is in a group once as base and at most once more as a query
        p, other, d = nearest_in_shard(x, ids, base, query, k, basis, degree, width, beam)
        rep = np.array([i[0] for i in ids], np.int64)
        return pa.table({"rep": pa.array(rep[p]), "other": pa.array(other), "distance": pa.array(d)})

    return run


def pivot_plan(n: int, shard: int, sample: int, max_pivots: int) -> tuple[int, int]:
    """(pivots, sampled points) for n points: pivots in proportion to the points up to ``max_pivots``, and at least three
    sampled points a pivot. Both are bounded by ``max_pivots``, above which shards are cut into sub-shards."""
    pivots = max(1, min(max_pivots, round(1.6 * n / shard)))
    return pivots, max(sample, 3 * pivots)


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int | None = None, sample: int = 10_000, shard: int = 6_000, overlap: int = 3, slack: float = 0.12, max_pivots: int = 16_384, project: int = 48, degree: int = 16, width: int = 24, beam: int = 40) -> DataFrame:
    """(id, rank, neighbour, distance): the k closest other vectors of every usable vector."""
    spark = df.sparkSession
    schema = "id long, rank int, neighbour long, distance double"
    if dim is None:
        first = df.where(F.size(vec_col) > 0).select(F.size(vec_col)).head()
        if first is None:
            return spark.createDataFrame([], schema)
        dim = int(first[0])
    rows = cut_lineage(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(_vector_batches(dim), "id long, fp1 long, fp2 long, vec binary"))
    own = Window.partitionBy("fp1", "fp2").orderBy("id")
    lows = (
        rows.select("fp1", "fp2", "id").withColumn("n", F.row_number().over(own)).where(f"n <= {k + 1}").groupBy("fp1", "fp2").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"))
    )
    points = rows.where("vec is not null").groupBy("fp1", "fp2").agg(F.min("vec").alias("vec")).join(lows, ["fp1", "fp2"]).select("ids", "fp1", "vec")
    points = cut_lineage(points)
    n = points.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    # The only rows that reach the driver: a bounded sample to fit pivots and projection.
    wanted, sample = pivot_plan(n, shard, sample, max_pivots)
    lucky = F.pmod(F.xxhash64("fp1"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 1.2 * sample / n))
    seen = points.where(lucky).orderBy(F.xxhash64("fp1"), "fp1").limit(sample).select("vec").toArrow().column("vec").to_pylist()
    x = _unit(seen, dim).astype(np.float32)
    pivots = kmeans(x, max(1, min(wanted, len(x) // 2)))
    _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(project, dim)], np.float32)
    subs: dict[int, int] = {}
    blocks: dict[int, int] = {}
    sizes = points.mapInArrow(_assign_batches(dim, pivots, overlap, slack, None, None), "shard long").groupBy("shard").count()
    for r in sizes.where(F.col("count") > 2 * shard).collect():  # at most one row a pivot
        subs[r.shard], blocks[r.shard] = -(-r["count"] // shard), -(-r["count"] // (4 * shard))
    placed = points.mapInArrow(
        _assign_batches(dim, pivots, overlap, slack, subs, blocks), "shard long, sub long, block long, base boolean, query boolean, ids array<long>, vec binary"
    )
    found = placed.groupBy("shard", "sub", "block").applyInArrow(_shard_groups(dim, k, basis, degree, width, beam), "rep long, other long, distance double")
    best = found.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("distance", "other")))), 1, k + 1).alias("near"))
    members = rows.select("id", "fp1", "fp2").distinct().join(lows.select("fp1", "fp2", F.col("ids")[0].alias("rep")), ["fp1", "fp2"]).select("id", "rep")
    near = members.join(best, "rep").select("id", F.posexplode(F.slice(F.expr("filter(near, x -> x.other <> id)"), 1, k)).alias("pos", "x"))
    return near.select("id", (F.col("pos") + 1).alias("rank"), F.col("x.other").alias("neighbour"), F.col("x.distance").alias("distance"))


def pairs_of(neighbours: DataFrame) -> DataFrame:
    """Pairs id_a < id_b in which one is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
