import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalith.llm import near_duplicates as nd

KIND = "id int, section string, content string, rep string, bands int"


def brute(rows, k, t):
    sets = {}
    for i, text in rows:
        ws = nd.WORD.findall((text or "").lower())
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= round(t * 100) * len(sets[a] | sets[b])}


def texts(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            ws = rng.choice(rows)[1].split()
            for _ in range(rng.choice((0, 1, 2, 4, 8, 12))):
                ws[rng.randrange(len(ws))] = rng.choice(words)
        else:
            ws = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(ws)))
    return rows


@pytest.mark.parametrize("block,few,share", [(3, 2, 5), (500, 32, 4_096), (4, 500, 1)])
def test_pairs_equal_brute_force(spark, monkeypatch, block, few, share):
    monkeypatch.setattr(nd, "SHARE", share)
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    pairs, members = nd.near_duplicates(df, "id", F.col("text"), k=3, threshold=0.6, block=block, few=few)
    got = {(r.id_a, r.id_b) for r in nd.expand_pairs(pairs, members).collect()}
    assert got == brute(rows, 3, 0.6)


def test_dirty_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, "S", "one two three four", "a", 1), (2, "s", "One, two THREE four!", "b", 2), (3, None, None, None, None), (4, "", "", "", 0), (5, None, "ab", None, 1), (6, "L", long, None, 1), (7, "L", long + " y", None, 1), (None, "S", "one two three four", None, 1), (1, "S", "one two three four", "a", 1)]
    df = spark.createDataFrame(rows, KIND)
    pairs, members = nd.near_duplicates(df, "id", nd.chunk_text(df), k=3, threshold=0.6)
    assert {(r.id_a, r.id_b) for r in nd.expand_pairs(pairs, members).collect()} == {(1, 2), (6, 7)}
    empty = nd.near_duplicates(df.limit(0), "id", nd.chunk_text(df), k=3, threshold=0.6)
    assert nd.expand_pairs(*empty).count() == 0 and nd.near_duplicate_classes(*empty).count() == 0


def test_a_hot_copy_group_is_one_class(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("the same text in a third of all rows")).otherwise(F.concat_ws(" ", *(F.md5(F.concat(F.col("id"), F.lit(i))) for i in range(6)))).alias("text"))
    pairs, members = nd.near_duplicates(df, "id", F.col("text"), k=3, threshold=0.6)
    assert pairs.count() == 0
    classes = nd.near_duplicate_classes(pairs, members)
    assert classes.count() == 3000
    assert classes.where("class_id = 0").count() == 1000


def test_a_hot_bucket_gives_out_only_what_pruning_leaves(spark):
    # 300 texts share a long beginning, and so bands, but none is similar to another.
    rng, common = random.Random(2), " ".join(f"c{i}" for i in range(30))
    rows = [(i, common + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(45))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    sigs = df.mapInArrow(nd._signature_batches(3, 50, 4), "id long, fp1 long, fp2 long, sig binary, bands array<long>").cache()
    pruning = nd.Pruning(200, 0.6, 1e-4, 20)
    buckets = sigs.select(F.explode("bands").alias("bucket"), "id")
    assert buckets.groupBy("bucket").count().where("count > 32").count() > 0
    assert nd.candidate_pairs(buckets, sigs.select("id", "sig"), pruning, 50, 32).count() < 0.05 * 300 * 299 / 2
    pairs, members = nd.near_duplicates(df, "id", F.col("text"), k=3, threshold=0.6, block=50)
    assert {(r.id_a, r.id_b) for r in nd.expand_pairs(pairs, members).collect()} == brute(rows, 3, 0.6)


def test_classes_join_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (3, 9), (7, 8), (8, 9)], "a long, b long")
    got = {r.id: r.component for r in nd.components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 1, 8: 1, 4: 4, 5: 4}


def test_posterior_keeps_what_may_reach_the_threshold():
    least = nd.min_matches([20, 100, 200], 0.6, 1e-4)
    rng = np.random.default_rng(0)
    for n, m in zip([20, 100, 200], least, strict=True):
        assert (rng.binomial(n, 0.6, 20_000) >= m).mean() > 0.999
    assert least[2] > 0.45 * 200


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab 1_é\n", max_size=30)), max_size=8))
def test_run_sets(ts):
    h, starts = nd.run_sets(ts, 2, {})
    for i, t in enumerate(ts):
        ws = nd.WORD.findall((t or "").lower())
        assert starts[i + 1] - starts[i] == len({tuple(ws[j : j + 2]) for j in range(len(ws) - 1)})
