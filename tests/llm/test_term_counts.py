from collections import Counter

from pyspark.sql import functions as F

from stratalith.llm import term_counts as tc


def test_counts_and_marks(spark):
    texts = ["A a b_c É", None, "", "a 12 x²", "a", "a ¿ß", "b"] + ["z z"] * 3
    df = spark.createDataFrame([(i, t, "n", 5) for i, t in enumerate(texts)], "id int, content string, term string, records int").repartition(3)
    occ, rec = Counter(), Counter()
    for t in texts:
        ws = tc.TERM.findall((t or "").lower())
        occ.update(ws)
        rec.update(set(ws))
    for flush in (1, 300_000):
        assert {r.term: (r.occurrences, r.records) for r in tc.term_counts(df, "content", flush).collect()} == {w: (occ[w], rec[w]) for w in occ}
    marks = {r.term: r.mark for r in tc.marked_terms(df, "content").collect()}
    assert marks["a"] == "common" and marks["b"] == "rare" and marks["z"] is None and marks["é"] == "rare"
    assert tc.marked_terms(df.limit(0), "content").count() == 0


def test_repeated_rows_are_records_and_long_texts_count(spark):
    df = spark.createDataFrame([("x " * 100_000,), ("x",), ("x",)], "content string")
    r = tc.term_counts(df, "content").first()
    assert (r.occurrences, r.records) == (100_002, 3)


def test_a_term_of_every_record_is_shuffled_once_a_task(spark):
    df = spark.range(0, 1000, 1, 4).select(F.lit("hot term").alias("content"))
    parts = df.mapInArrow(tc._count_batches(300_000), "term string, occurrences long, records long")
    assert parts.count() == 8
