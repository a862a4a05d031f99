import math
import random

import pytest
from pyspark.sql import functions as F

from stratalith.functions import text, vectors
from stratalith.functions.stemming import stem, stems
from stratalith.operators.chunking import Settings, chunk_sections, cut, recipe, units
from stratalith.operators.sections import tidy


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("a [1] b", "a b"), ("a [2, 3], b", "a, b"), ("x [ 2 ].", "x."), ("see [2024] .", "see [2024]."), ("( a )  b", "(a) b"), ("a b", "a b"), ("", ""), (None, None)])
def test_clean(spark, raw, want):
    assert one(spark, raw, text.clean) == want
    if raw is not None:
        assert tidy(raw) == want


@pytest.mark.parametrize("n,want", [(0, 0), (1, 2), (297, 499), (298, 501)])
def test_tokens(spark, n, want):
    t = " ".join(["w"] * n)
    assert one(spark, t, text.estimate_tokens) == want


def test_sentences_and_slug_and_links(spark):
    assert one(spark, "One. Two! three? (Four) a. b", text.sentences) == ["One.", "Two! three?", "(Four) a. b"]
    assert one(spark, "https://h.example/a/Der%20Weg+x_1/", text.slug) == "der-weg-x-1"
    assert one(spark, "https://h.example/a/Some%20Report%20-%202.3.PDF", text.slug) == "some-report-2-3"
    assert one(spark, "https://h.example/", text.slug) == one(spark, "https://h.example", text.slug) == "index"
    assert one(spark, "https://h.example/a/F.PDF?x=1", text.is_pdf) is True
    for anchor, want in ((None, "u"), ("", "u"), ("x", "u#x")):
        assert one(spark, anchor, lambda c: text.citation_url(F.lit("u"), c)) == want


def test_numbers_and_debris(spark):
    assert one(spark, "3.1", text.section_number) == [3, 1]
    assert one(spark, "A1.4", text.section_number) == [100, 1, 4]
    assert one(spark, "x", text.section_number) is None
    assert one(spark, "N e a r R a n g e", text.is_debris) is True
    assert one(spark, "near range", text.is_debris) is False
    assert one(spark, "As [3] and [1, 3] and [x]", text.cited_numbers) == [1, 3]
    assert one(spark, "Page 4/13", text.margin_key) == "Page #/#"


@pytest.mark.parametrize("w,s", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("electriciti", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("köln", "köln")])
def test_porter(w, s):
    assert stem(w) == s


def test_stems_are_of_distinct_words(spark):
    df = spark.createDataFrame([("cats",), ("cats",), ("cat",)], "lexeme string")
    assert {tuple(r) for r in stems(df).collect()} == {("cats", "cat"), ("cat", "cat")}


def test_cosine(spark):
    e1, e2, e3 = [1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    for v, want in ((e1, 0.0), (e2, 1 - 1 / math.sqrt(2)), (e3, 1.0)):
        df = spark.createDataFrame([(e1, v)], "a array<double>, b array<double>")
        d = df.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d")).first().d
        assert d == pytest.approx(want)
        assert (2 - d) / 2 == pytest.approx(df.select(vectors.similarity_score(F.lit(d)).alias("s")).first().s)
    df = spark.createDataFrame([(e1, [0.0, 0.0, 0.0]), (e1, None), (e1, [])], "a array<double>, b array<double>")
    assert [r.d for r in df.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [None] * 3
    with pytest.raises(Exception, match="unequal length"):
        spark.createDataFrame([(e1, [1.0])], "a array<double>, b array<double>").select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()


PARTS = ["One two three four five.", "Word ", "x " * 30, "row | cell", "\n", "Z. ", "Ünd so ", "(a) "]


def test_chunks_hold_every_word_and_keep_their_size(spark):
    rng, s = random.Random(8), Settings(60, 40, 8)
    samples = [[b for b in ("".join(rng.choices(PARTS, k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 8))) if b.strip()] for _ in range(120)]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(samples)], "k int, b array<string>").select("k", "b", units(F.col("b"), s.target_tokens).alias("us"), cut(units(F.col("b"), s.target_tokens), s).alias("out")).collect()
    tokens_of = lambda t: math.ceil(len(t.split()) * 1.68)
    several = 0
    for r in rows:
        flat, total = [u.text for u in r.us], sum(u.tokens for u in r.us)
        assert " ".join(flat).split() == " ".join(r.b).split()
        goal = math.ceil(total / math.ceil(total / s.target_tokens)) if total > s.max_tokens else total
        assert total > s.max_tokens or len(r.out) == 1
        several += len(r.out) > 1
        at = begin = 0  # chunks are runs of units: an end of the chunk before within the overlap, then as many as fit
        for c in r.out:
            lead = next(k for k in range(begin, at + 1) if sum(u.tokens for u in r.us[k:at]) <= s.overlap_tokens) if at else 0
            if at and sum(u.tokens for u in r.us[lead : at + 1]) > goal:
                lead = at
            end = at + 1
            while end < len(flat) and sum(u.tokens for u in r.us[lead : end + 1]) <= goal:
                end += 1
            assert c.split() == " ".join(flat[lead:end]).split() and tokens_of(c) <= max(goal, max(u.tokens for u in r.us))
            begin, at = lead, end
        assert at == len(flat)
    assert several > 40


def test_a_long_sentence_is_cut_by_words(spark):
    page = spark.createDataFrame([(1, "u", "T", 0, ["T"], None, [" ".join(f"w{i}" for i in range(600))]), (1, "u", "T", 1, ["T", "A"], "a", ["x", None, ""]), (1, "u", "T", 2, ["T", "B"], "b", [])], "page_id long, url string, title string, position int, path array<string>, anchor string, blocks array<string>")
    out = chunk_sections(page).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in out] == list(range(len(out))) and len(out) >= 4 and all(r.tokens <= 400 for r in out)
    assert (out[-1].section, out[-1].anchor, out[-1].content) == ("T > A", "a", "x")


def test_recipe_is_stable():
    assert recipe(Settings(), "m", "d", "t") == recipe(Settings(), "m", "d", "t") != recipe(Settings(version=2), "m", "d", "t")
