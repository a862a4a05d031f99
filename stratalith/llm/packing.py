"""Filling containers of fixed capacity with items of varying length.

What is packed is the histogram of lengths, not the items: its size is bounded by the capacity, so the plan is made
on the driver from at most ``capacity`` numbers per window, whatever the number of items. A plan is a list of
patterns (lengths that share a container) with multiplicities:

1. exact complements: from the longest length down, the gap it leaves is looked up in the index of single lengths,
   then of sums of two, then of three; a combination that fills the gap exactly is consumed as often as the
   availability counts allow;
2. best fit: what is left goes, longest first, into the smallest open gap that takes it, else into a new container.

Items are then numbered within (window, length) by salted counting (no length is one task's work) and the numbers
are mapped to containers by binary search in the plan.

An item above the capacity is cut into full pieces and a rest; nothing else is cut. Items without tokens (null or
empty texts included) take no space and are listed with container null. Repeated rows are items of their own. An
empty table gives an empty result; windows with a null or non-positive capacity are left out.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.session import cut_lineage

TOKEN = re.compile(r"\w+|[^\w\s]+")


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = TOKEN.findall
    for b in batches:
        n = [len(find(t)) if t else 0 for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])


def token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tokens): runs of letters, digits and _, and runs of other characters that aren't white space."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_token_batches, "doc_id long, tokens long")


class _Stock:
    """Availability counts of lengths with the index of sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, c in counts.items():
            self.n[length] = c
        self.capacity = capacity
        self.index()

    def index(self) -> None:
        mask = (1 << (self.capacity + 1)) - 1
        self.one = self.two = self.three = 0
        for a in np.flatnonzero(self.n).tolist():
            self.one |= 1 << a
        for a in np.flatnonzero(self.n).tolist():
            self.two |= (self.one << a) & mask
        for a in np.flatnonzero(self.n).tolist():
            self.three |= (self.two << a) & mask
        self.stale = 0

    def pair(self, gap: int) -> tuple[int, ...] | None:
        half = gap // 2
        if half < 1:
            return None
        low = self.n[1 : half + 1] > 0
        high = self.n[gap - half : gap][::-1] > 0
        ok = np.flatnonzero(low & high) + 1
        for a in ok.tolist():  # the most uneven first: long items are the hardest to place
            if a * 2 != gap or self.n[a] >= 2:
                return a, gap - a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap <= 0:
            return None
        if self.n[gap] > 0:
            return (gap,)
        if self.two >> gap & 1 and (p := self.pair(gap)):
            return p
        if not (self.two | self.three) >> gap & 1:
            return None
        if self.three >> gap & 1:
            for a in (np.flatnonzero(self.n[1:gap]) + 1)[::-1].tolist():
                if self.two >> (gap - a) & 1:
                    self.n[a] -= 1
                    p = self.pair(gap - a)
                    self.n[a] += 1
                    if p:
                        return (a, *p)
        if self.stale:  # an index bit promised a sum that is no longer there
            self.index()
            return self.exact(gap)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many containers follow each, for a histogram of lengths 1..capacity."""
    stock = _Stock(counts, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = []
    left: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        while stock.n[length] > 0:
            if length == capacity:
                patterns.append(((length,), int(stock.n[length])))
                stock.n[length] = 0
                break
            stock.n[length] -= 1  # itself
            fill = stock.exact(capacity - length)
            stock.n[length] += 1
            if fill is None:
                left.append((length, int(stock.n[length])))
                stock.n[length] = 0
                break
            pattern = (length, *fill)
            times = min(int(stock.n[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                stock.n[x] -= times
            patterns.append((pattern, times))
            stock.stale += 1
            if stock.stale > 64:
                stock.index()
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append((pattern, times))

    for length, n in left:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length
                full, rest = divmod(n, per)
                if full:
                    put((length,) * per, full)
                if rest:
                    put((length,) * rest, 1)
                break
            gap = gaps[at]
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[at]
            copies = min(gap // length, n)
            take = min(times, n // copies)
            put(pattern + (length,) * copies, take)
            if take < times:
                put(pattern, times - take)
            n -= take * copies
    return patterns + [x for xs in open_.values() for x in xs]


def allocation(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first number, first container, items per container), sorted by first number."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        for length in dict.fromkeys(pattern):
            per = pattern.count(length)
            at = used.get(length, 0)
            rows.setdefault(length, []).append((at, base, per))
            used[length] = at + per * times
        base += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def _place_batches(plans: dict[int, dict[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, length, number = (b.column(i).to_numpy() for i in (0, 1, 2))
            out = np.full(len(w), -1, dtype=np.int64)
            key = w * (1 << 32) + length
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                table = plans[int(k >> 32)][int(k & 0xFFFFFFFF)]
                row = np.searchsorted(table[:, 0], number[at], "right") - 1
                out[at] = table[row, 1] + (number[at] - table[row, 0]) // table[row, 2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), *b.columns[3:], b.column(1)], names=["window_id", "container", "doc_id", "piece", "start", "doc_tokens", "tokens"])

    return run


def pack(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 200_000) -> DataFrame:
    """Assignment of every piece of every document, for every window:

    (window_id, container, doc_id, piece, start, tokens, doc_tokens); start is the piece's first token. Pieces of one
    length are interchangeable: which of them goes where depends on ``rows_per_salt``, the containers' lengths do not.
    """
    # The windows are a fixed small table; a plan has at most a few rows per possible length.
    caps = {int(r.window_id): int(r.capacity) for r in windows.select("window_id", "capacity").where("window_id is not null and capacity > 0").distinct().collect()}
    spark = docs.sparkSession
    schema = "window_id long, container long, doc_id long, piece long, start long, tokens long, doc_tokens long"
    if not caps:
        return spark.createDataFrame([], schema)
    sizes = cut_lineage(token_counts(docs, id_col, text_col))
    each = F.explode(F.array(*(F.struct(F.lit(w).cast("long").alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, c in sorted(caps.items()))))
    by_size = sizes.where("tokens > 0").groupBy("tokens").count().select("tokens", "count", each.alias("w")).select("tokens", "count", "w.*")
    pieces = by_size.select("window_id", F.explode(F.expr("filter(array(struct(capacity as length, (tokens div capacity) * count as n), struct(tokens % capacity as length, count as n)), x -> x.length > 0 and x.n > 0)")).alias("x")).groupBy("window_id", "x.length").agg(F.sum("x.n").alias("n"))
    counts: dict[int, dict[int, int]] = {w: {} for w in caps}
    total = 0
    for r in pieces.collect():  # at most the sum of the capacities
        counts[r.window_id][r.length] = r.n
        total += r.n
    plans = {w: allocation(plan(counts[w], c)) for w, c in caps.items()}
    salts = max(1, total // rows_per_salt)
    items = (
        sizes.select("doc_id", F.col("tokens").alias("doc_tokens"), each.alias("w"))
        .select("doc_id", "doc_tokens", "w.*")
        .select("window_id", "doc_id", "doc_tokens", "capacity", F.explode(F.expr("sequence(0L, greatest((doc_tokens - 1) div capacity, 0L))")).alias("piece"))
        .withColumn("start", F.col("piece") * F.col("capacity"))
        .withColumn("length", F.least("capacity", F.col("doc_tokens") - F.col("start")))
    )
    empty = items.where("length <= 0").select("window_id", F.lit(None).cast("long").alias("container"), "doc_id", "piece", "start", F.lit(0).cast("long").alias("tokens"), "doc_tokens")
    items = items.where("length > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    in_salt = Window.partitionBy("window_id", "length", "salt").orderBy("doc_id", "piece")
    numbered = items.withColumn("number", F.row_number().over(in_salt).cast("long") - 1)
    if salts > 1:
        before = Window.partitionBy("window_id", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = items.groupBy("window_id", "length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        numbered = numbered.join(offsets.select("window_id", "length", "salt", "before"), ["window_id", "length", "salt"]).withColumn("number", F.col("number") + F.col("before"))
    placed = numbered.select("window_id", "length", "number", "doc_id", "piece", "start", "doc_tokens").mapInArrow(
        _place_batches(plans), "window_id long, container long, doc_id long, piece long, start long, doc_tokens long, tokens long"
    )
    return placed.select("window_id", "container", "doc_id", "piece", "start", "tokens", "doc_tokens").unionByName(empty)
