import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm import packing as pk


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_everything_within_capacity(counts):
    plan = pk.plan(dict(counts), 40)
    placed: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(pattern) <= 40 and times > 0
        for x in pattern:
            placed[x] = placed.get(x, 0) + times
    assert placed == counts
    bins: list[int] = []  # first fit decreasing
    for x in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = next((i for i, b in enumerate(bins) if b + x <= 40), None)
        if at is None:
            bins.append(x)
        else:
            bins[at] += x
    assert -(-sum(bins) // 40) <= sum(t for _, t in plan) <= len(bins) * 1.1 + 1
    for length, rows in pk.allocation(plan).items():
        assert rows[0, 0] == 0 and (rows[1:, 0] > rows[:-1, 0]).all() and length in counts


def test_exact_complements_of_one_two_and_three():
    assert pk.plan({7: 1, 3: 1}, 10) == [((7, 3), 1)]
    assert pk.plan({6: 2, 3: 2, 1: 2}, 10) == [((6, 1, 3), 2)]
    assert sorted(pk.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10)[0][0]) == [1, 2, 3, 4]


@pytest.mark.parametrize("salt", [5, 200_000])
def test_assignment(spark, salt):
    rng = random.Random(1)
    texts = [None, "", " ", "…!?", "a_b c-d"] + ["w " * rng.randrange(1, 70) for _ in range(200)] + ["w " * 16] * 100 + ["x " * 3000]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece int, salt string").repartition(3)
    windows = spark.createDataFrame([(1, "a", 16), (2, "b", 64), (3, "c", None), (4, "d", 0)], "window_id int, name string, capacity int")
    rows = pk.pack(docs, windows, rows_per_salt=salt).collect()
    tokens = [len(pk.TOKEN.findall(t)) if t else 0 for t in texts]
    assert tokens[3] == 1 and tokens[4] == 4
    for w, cap in ((1, 16), (2, 64)):
        own = [r for r in rows if r.window_id == w]
        fill: dict[int, int] = {}
        for r in own:
            if r.container is not None:
                fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
        for i, n in enumerate(tokens):
            ps = sorted((r.piece, r.start, r.tokens) for r in own if r.doc_id == i)
            assert len(ps) == max(1, -(-n // cap)) and sum(p[2] for p in ps) == n
            assert [p[1] for p in ps] == [k * cap for k in range(len(ps))]
        assert sum(tokens) / (len(fill) * cap) > 0.95
    assert {r.window_id for r in rows} == {1, 2}
    assert pk.pack(docs.limit(0), windows).count() == 0
    assert pk.pack(docs, windows.where("capacity is null")).count() == 0


def test_repeated_rows_are_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert pk.pack(docs, spark.createDataFrame([(1, 2)], "window_id int, capacity int")).select("container").distinct().count() == 2
