"""Near-duplicate records: MinHash bands propose pairs, Bayesian pruning drops most, exact Jaccard decides.

Stages (every one a DataFrame, nothing is gathered on the driver):

1. ``signatures``  one pass over the texts: words, the set of k-word runs as 64-bit hashes, MinHash values
   (one byte each) and band hashes. Sets are built with NumPy over a whole Arrow batch.
2. ``classes``     records with equal sets (copies) become one class with its smallest id as representative;
   counting is pre-aggregated before the shuffle, so a text copied into a third of all rows costs one row a task.
3. ``candidates``  representatives that share a band. A bucket of more than ``few`` ids is cut into blocks, its ids get
   their MinHash values there, and every pair of blocks becomes a group of its own whose pairs are pruned where they
   are made: a hot bucket is never one task's work, gives out no pair that pruning drops, and is not capped.
4. ``prune``       MinHash values are compared in steps; after n values with m matches a pair is dropped when the
   posterior probability (uniform prior) of similarity >= threshold is below ``tolerance``. Pairs of small buckets,
   at most ``few`` / 2 a record and band, are joined with their values for it.
5. ``verify``      the remaining pairs are decided by the exact Jaccard similarity of their texts.

Null texts and texts with fewer words than a run have no set and no pair. Copies are pairs (similarity 1).
Repeated ids are kept apart only by their text: a pair of equal ids is never reported. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def run_sets(texts: list[str | None], k: int, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word runs of each text, concatenated and sorted, and where each text's begin (n + 1).

    ``seen`` caches word hashes over batches; it is emptied when large.
    """
    from xxhash import xxh64_intdigest

    if len(seen) > 500_000:
        seen.clear()
    flat: list[int] = []
    lens = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        ws = WORD.findall(t.lower())
        lens[i] = len(ws)
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxh64_intdigest(w)
            flat.append(h)
    w = np.array(flat, dtype=np.uint64)
    ends = np.cumsum(lens)
    if len(w) < k:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    n = len(w) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = _mix(h * _M3 + w[j : j + n] * _M1 + _M2)
    doc = np.repeat(np.arange(len(texts)), lens)
    ok = doc[:n] == doc[k - 1 :]  # runs within one text
    h, d = h[ok], doc[:n][ok]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def _signature_batches(k: int, bands: int, rows: int):
    n_hash = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _seeds(n_hash)
        seen: dict[str, int] = {}
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                h, starts = run_sets(b.column(1).to_pylist(), k, seen)
                size = np.diff(starts)
                has = np.flatnonzero(size)
                if not len(has):
                    continue
                cut = starts[:-1][has]
                sig = np.empty((len(has), n_hash), dtype=np.uint32)
                low = h ^ (h >> np.uint64(32))
                for j in range(n_hash):
                    sig[:, j] = np.minimum.reduceat(((low * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), cut)
                band = np.zeros((len(has), bands), dtype=np.uint64)
                band += np.arange(bands, dtype=np.uint64)  # the band is part of its hash
                for j in range(rows):
                    band = _mix(band * _M1 + sig[:, j::rows].astype(np.uint64) + _M2)
                fp1 = np.add.reduceat(_mix(h), cut)
                fp2 = np.bitwise_xor.reduceat(_mix(h * _M2 + _M1), cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(has)).cast(pa.int64()),
                        pa.array(fp1.view(np.int64)),
                        pa.array(fp2.view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(n_hash), len(has), [None, pa.py_buffer(np.ascontiguousarray(sig.astype(np.uint8)))]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(has) * bands + 1, bands, dtype=np.int32)), pa.array(band.view(np.int64).ravel())),
                    ],
                    names=["id", "fp1", "fp2", "sig", "bands"],
                )

    return run


def min_matches(steps: list[int], threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the fewest matches that keep the posterior at ``tolerance`` or above.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in steps:
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


class Pruning:
    """The incremental comparison of MinHash values: (number of values, fewest matches) of every step."""

    def __init__(self, n_hash: int, threshold: float, tolerance: float, step: int) -> None:
        self.n_hash = n_hash
        steps = [*range(step, n_hash, step), n_hash]
        self.steps = list(zip(steps, min_matches(steps, threshold, tolerance), strict=True))

    def values(self, column: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, self.n_hash)

    def alive(self, x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the pairs (x[p], y[q]) are left."""
        alive, m, done = np.arange(len(p)), np.zeros(len(p), np.int32), 0
        for n, need in self.steps:
            m = m + (x[p[alive], done:n] == y[q[alive], done:n]).sum(1)
            ok = m >= need
            alive, m, done = alive[ok], m[ok], n
        return alive


def _prune_batches(pruning: Pruning):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                every = np.arange(b.num_rows)
                x, y = (pruning.values(b.column(c).to_pylist()) for c in (2, 3))
                yield b.select([0, 1]).take(pa.array(pruning.alive(x, every, y, every)))

    return run


def _verify_batches(k: int, threshold: float):
    from fractions import Fraction

    t = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for big in batches:
            for at in range(0, big.num_rows, 4000):
                b = big.slice(at, 4000)
                texts: dict[str, int] = {}
                left, right = ([texts.setdefault(t, len(texts)) for t in b.column(c).to_pylist()] for c in (2, 3))
                h, starts = run_sets(list(texts), k, seen)
                sets = [h[starts[i] : starts[i + 1]] for i in range(len(texts))]
                keep, sims = [], []
                for i, (p, q) in enumerate(zip(left, right, strict=True)):
                    both = np.concatenate((sets[p], sets[q]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    union = len(both) - shared
                    if union and shared * t.denominator >= t.numerator * union:
                        keep.append(i)
                        sims.append(shared / union)
                yield pa.RecordBatch.from_arrays([*b.select([0, 1]).take(pa.array(keep, pa.int64())).columns, pa.array(sims, pa.float64())], names=["rep_a", "rep_b", "similarity"])

    return run


def _texts(df: DataFrame, id_col: str, text) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())


def near_duplicates(df: DataFrame, id_col: str, text, k: int = 5, threshold: float = 0.8, bands: int = 50, rows: int = 4, tolerance: float = 1e-4, step: int = 20, block: int = 500, few: int = 32) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of class representatives and the membership of every record with a set of runs.

    text: a Column. Returns (pairs(rep_a, rep_b, similarity), members(id, rep)), rep_a < rep_b.
    With ``bands`` x ``rows`` = 50 x 4 a pair of similarity 0.6 is missed with probability 0.001, of 0.8 never
    in practice.
    """
    src = _texts(df, id_col, text)
    sigs = cut_lineage(src.mapInArrow(_signature_batches(k, bands, rows), "id long, fp1 long, fp2 long, sig binary, bands array<long>"))
    firsts = sigs.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"))
    members = sigs.select("id", "fp1", "fp2").join(firsts, ["fp1", "fp2"]).select("id", "rep")
    reps = sigs.join(firsts.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "sig", "bands").dropDuplicates(["id"])
    reps = cut_lineage(reps)
    pairs = candidate_pairs(reps.select(F.explode("bands").alias("bucket"), "id"), reps.select("id", "sig"), Pruning(bands * rows, threshold, tolerance, step), block, few)
    pairs = cut_lineage(pairs)
    text_of = src.dropDuplicates(["id"]) if _repeats(sigs) else src
    pairs = (
        pairs.join(text_of.withColumnsRenamed({"id": "rep_a", "text": "text_a"}), "rep_a")
        .join(text_of.withColumnsRenamed({"id": "rep_b", "text": "text_b"}), "rep_b")
        .select("rep_a", "rep_b", "text_a", "text_b")
        .mapInArrow(_verify_batches(k, threshold), "rep_a long, rep_b long, similarity double")
    )
    return pairs, members


def _repeats(sigs: DataFrame) -> bool:
    return not sigs.groupBy("id").count().where("count > 1").isEmpty()


def _bucket_batches(block: int, few: int):
    """Runs of equal buckets in sorted batches: pairs of the small runs, blocks of ids of the large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_b, carry_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks_of: dict[int, int] = {}  # the last run's blocks so far; at most one entry

        def cut(b: np.ndarray, i: np.ndarray, final: bool):
            nonlocal carry_b, carry_i
            starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(b)]
            if not final and len(starts):
                starts, ends, keep = starts[:-1], ends[:-1], starts[-1]
                carry_b, carry_i = b[keep:], i[keep:]
                while len(carry_b) > 4 * block:  # a long run is given out block by block
                    yield "block", int(carry_b[0]), blocks_of.setdefault(int(carry_b[0]), 0), carry_i[:block]
                    blocks_of[int(carry_b[0])] += 1
                    carry_b, carry_i = carry_b[block:], carry_i[block:]
            size = ends - starts
            two = starts[size == 2]
            two = two[[int(b[x]) not in blocks_of for x in two]] if blocks_of else two
            yield "pairs", i[two], i[two + 1], None
            for s, e in zip(starts[size != 2], ends[size != 2], strict=True):
                if blocks_of and int(b[s]) in blocks_of or e - s > few:
                    at = blocks_of.pop(int(b[s]), 0)
                    for x in range(s, e, block):
                        yield "block", int(b[s]), at, i[x : min(x + block, e)]
                        at += 1
                elif e - s > 2:
                    p, q = np.triu_indices(e - s, 1)
                    yield "pairs", i[s:e][p], i[s:e][q], None
            if blocks_of:
                for s, e in zip(starts[size == 2], ends[size == 2], strict=True):
                    if int(b[s]) in blocks_of:
                        yield "block", int(b[s]), blocks_of.pop(int(b[s])), i[s:e]

        def out(parts) -> Iterator[pa.RecordBatch]:
            xs, ys = [], []
            for kind, x, y, ids in parts:
                if kind == "pairs":
                    xs.append(x)
                    ys.append(y)
                else:
                    yield pa.RecordBatch.from_pydict({"x": pa.array([None], pa.int64()), "y": pa.array([None], pa.int64()), "bucket": pa.array([x], pa.int64()), "at": pa.array([y], pa.int32()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
            if len(x):
                n = len(x)
                yield pa.RecordBatch.from_pydict({"x": pa.array(np.minimum(x, y)), "y": pa.array(np.maximum(x, y)), "bucket": pa.nulls(n, pa.int64()), "at": pa.nulls(n, pa.int32()), "ids": pa.nulls(n, pa.list_(pa.int64()))})

        for batch in batches:
            b = np.concatenate((carry_b, batch.column(0).to_numpy()))
            i = np.concatenate((carry_i, batch.column(1).to_numpy()))
            carry_b, carry_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
            yield from out(cut(b, i, False))
        yield from out(cut(carry_b, carry_i, True))

    return run


def _cell_batches(pruning: Pruning, at_once: int = 20_000):
    """Pairs within one block, or between two, that pruning leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in batch.column(0).to_pylist():
                ids = [np.array([m["id"] for m in s["members"]], np.int64) for s in sides]
                values = [pruning.values([m["sig"] for m in s["members"]]) for s in sides]
                one = len(sides) == 1
                p, q = np.triu_indices(len(ids[0]), 1) if one else (np.repeat(np.arange(len(ids[0])), len(ids[1])), np.tile(np.arange(len(ids[1])), len(ids[0])))
                for k in range(0, len(p), at_once):
                    a, b = p[k : k + at_once], q[k : k + at_once]
                    left = pruning.alive(values[0], a, values[-1], b)
                    x, y = ids[0][a[left]], ids[-1][b[left]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    return run


def candidate_pairs(bucketed: DataFrame, values: DataFrame, pruning: Pruning, block: int, few: int) -> DataFrame:
    """Distinct pairs (rep_a < rep_b) of ids that share a bucket and that pruning leaves, from rows (bucket, id) without
    repeats and the MinHash values (id, sig).

    One shuffle brings a bucket together. A bucket above ``few`` ids leaves that task as blocks of at most ``block`` ids,
    and every pair of its blocks is worked off elsewhere as a group of its own.
    """
    parts = cut_lineage(
        bucketed.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "id").mapInArrow(_bucket_batches(block, few), "x long, y long, bucket long, at int, ids array<long>").where("bucket is not null or x <> y").distinct()
    )
    small = parts.where("bucket is null").select("x", "y")
    small = (
        small.join(values.withColumnsRenamed({"id": "x", "sig": "sig_x"}), "x")
        .join(values.withColumnsRenamed({"id": "y", "sig": "sig_y"}), "y")
        .select("x", "y", "sig_x", "sig_y")
        .mapInArrow(_prune_batches(pruning), "x long, y long")
    )
    blocks = parts.where("bucket is not null").select("bucket", "at", "ids")
    counts = blocks.groupBy("bucket").agg((F.max("at") + 1).alias("n"))
    # Values are joined once a block, whose size is bounded, and go along with it into its cells.
    named = blocks.select("bucket", "at", F.explode("ids").alias("id")).join(values, "id").groupBy("bucket", "at").agg(F.collect_list(F.struct("id", "sig")).alias("members"))
    cells = named.join(counts, "bucket").select("bucket", "at", "members", F.explode(F.expr("sequence(0, n - 1)")).alias("other"))
    cells = cells.groupBy("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).agg(F.collect_list(F.struct("members")).alias("sides"))
    large = cells.select("sides").mapInArrow(_cell_batches(pruning), "x long, y long").where("x <> y")
    return small.unionByName(large).distinct().withColumnsRenamed({"x": "rep_a", "y": "rep_b"})


#: Members of a class that one task pairs with the rest of it.
SHARE = 4_096


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records: those of similar classes, and the copies within a class. (id_a, id_b), id_a < id_b.

    The pairs of a class of more than SHARE copies are made by several tasks: its members are dealt out on one side and
    repeated for each deal on the other.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / SHARE).cast("int").alias("deals"))
    several = members.join(sizes, "rep")
    dealt = several.select("rep", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"), F.col("id").alias("x"))
    all_of = several.select("rep", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("id").alias("y"))
    within = dealt.join(all_of, ["rep", "deal"]).where("x < y").select("x", "y")
    deals = members.join(sizes, "rep", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    a = deals.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"))
    of_a = sizes.withColumnsRenamed({"rep": "rep_a"})
    spread = pairs.select("rep_a", "rep_b").join(of_a, "rep_a", "left").select("rep_a", "rep_b", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("deal"))
    across = spread.join(a, ["rep_a", "deal"]).select("rep_b", "x").join(members.withColumnsRenamed({"id": "y", "rep": "rep_b"}), "rep_b").select("x", "y")
    both = across.unionByName(within).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame, src: str, dst: str, max_rounds: int = 30) -> DataFrame:
    """Connected components of an edge table by alternating large-star and small-star steps: (id, component).

    Only pre-aggregated minima are shuffled and every second round is checkpointed; the driver sees a count alone.
    """
    e = cut_lineage(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v"))
    for i in range(max_rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = cut_lineage(small)
        changed = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def near_duplicate_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record with a set of runs: (id, class_id, links), class_id the smallest id of the group.

    links: similar classes of the record's own class (not expanded over copies).
    """
    comp = components(pairs, "rep_a", "rep_b")
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def chunk_text(df: DataFrame):
    """section, an empty line and content; null parts count as empty."""
    return F.concat(F.coalesce(df["section"], F.lit("")), F.lit("\n\n"), F.coalesce(df["content"], F.lit("")))
