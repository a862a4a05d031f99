"""Evaluation of retrieval and of agent runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS, DEPTH = (1, 3, 5, 10), 20


def labels(questions: DataFrame) -> DataFrame:
    """(qid, url, section) of the relevant sections."""
    return questions.select(F.col("id").alias("qid"), F.explode("relevant").alias("r")).select("qid", "r.url", "r.section").distinct()


def unknown_labels(questions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Labels whose (url, section) isn't indexed."""
    known = chunks.join(documents.select(F.col("id").alias("document_id"), "url"), "document_id").select("url", "section").distinct()
    return labels(questions).join(known, ["url", "section"], "left_anti").select("qid", "url", "section")


def check_labels(questions: DataFrame, chunks: DataFrame, documents: DataFrame) -> None:
    bad = unknown_labels(questions, chunks, documents).limit(5).collect()
    if bad:
        raise ValueError(f"labels that aren't indexed: {[tuple(r) for r in bad]}")


def answer_in(questions: DataFrame) -> DataFrame:
    """(qid, answer_in): whether answers stand in pages, in files, or in both."""
    pdf = F.lower(F.regexp_replace("url", r"[?#].*$", "")).endswith(".pdf") | F.lower(F.regexp_replace("url", r"[?#].*$", "")).contains(".pdf#")
    return labels(questions).groupBy("qid").agg(F.when(F.every(pdf), "pdf-only").when(F.some(pdf), "wiki+pdf").otherwise("wiki-only").alias("answer_in"))


def first_ranks(ranked: DataFrame, questions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, first): rank of the first relevant hit of every question, null without one. ranked: (qid, rank, id)."""
    few = ranked.select("qid", "rank", F.col("id").cast("long").alias("id"))
    placed = few.join(chunks.select(F.col("id").cast("long").alias("id"), "document_id", "section"), "id").join(documents.select(F.col("id").alias("document_id"), "url"), "document_id")
    hit = placed.join(labels(questions), ["qid", "url", "section"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    return questions.select(F.col("id").alias("qid"), "written", "lang").join(hit, "qid", "left").join(answer_in(questions), "qid", "left")


def _metrics(k: int) -> list[Column]:
    first = F.col("first")
    hits = [F.round(F.avg(F.when(first <= n, 1.0).otherwise(0.0)), 6).alias(f"hit_{n}") for n in HITS]
    return [F.count("*").alias("questions"), *hits, F.round(F.avg(F.when(first <= k, 1.0 / first).otherwise(0.0)), 6).alias("mrr")]


def metrics(firsts: DataFrame, k: int = 10) -> DataFrame:
    return firsts.agg(*_metrics(k))


def grouped_metrics(firsts: DataFrame, k: int = 10) -> DataFrame:
    """Metrics over all questions and by one dimension at a time: (dimension, value, questions, hit_*, mrr)."""
    dims = ("written", "lang", "answer_in")
    g = firsts.groupingSets([[], *([d] for d in dims)], *dims).agg(*_metrics(k), *(F.grouping(d).alias(f"g_{d}") for d in dims))
    name = reduce(lambda c, d: c.when(F.col(f"g_{d}") == 0, d), dims[1:], F.when(F.col(f"g_{dims[0]}") == 0, dims[0])).otherwise("all")
    value = reduce(lambda c, d: c.when(F.col(f"g_{d}") == 0, F.col(d)), dims[1:], F.when(F.col(f"g_{dims[0]}") == 0, F.col(dims[0]))).otherwise("all")
    return g.select(name.alias("dimension"), value.alias("value"), "questions", *(f"hit_{n}" for n in HITS), "mrr")


def misses(firsts: DataFrame, k: int = 5) -> DataFrame:
    """Questions without a relevant hit in the first k."""
    return firsts.where(F.col("first").isNull() | (F.col("first") > k)).select("qid", "first")


def dangling_questions(agent: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, label): agent questions whose label question doesn't exist. agent: (id, labels), labels may be null."""
    asked = agent.where("labels is not null").select("id", F.col("labels").alias("label"))
    return asked.join(questions.select(F.col("id").alias("label")).distinct(), "label", "left_anti").select("id", "label")


def with_labels(agent: DataFrame, questions: DataFrame) -> DataFrame:
    """Agent questions with the relevant (section, url) pairs of their label question, null where it has none."""
    return agent.join(questions.select(F.col("id").alias("labels"), "relevant"), "labels", "left")


CHECKS = ("tools_ok", "arguments_ok", "place_ok", "passages_ok", "citations_ok", "answered_ok")


def accepted(value: Column, allowed: Column) -> Column:
    """Whether a value is among the accepted ones; no accepted ones mean that it must be absent."""
    none = allowed.isNull() | (F.size(allowed) == 0)
    return F.when(none, value.isNull()).otherwise(F.coalesce(F.array_contains(allowed, value), F.lit(False)))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def in_box(lon: Column, lat: Column, box: Column) -> Column:
    """Whether a point lies in a closed box [west, south, east, north]."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def agent_checks(runs: DataFrame) -> DataFrame:
    """Adds the six CHECKS to runs; null where one doesn't apply.

    Columns: expected_tools, called_tools ARRAY<STRING>; arguments, allowed MAP<STRING, ...> (values, and accepted values
    by argument; null allowed: no catalogue call is expected); lon, lat and box; passages and relevant ARRAY<STRING>
    (null relevant: no answer in the documents); answer STRING, cited ARRAY<INT>, answerable BOOLEAN.
    """
    right = F.forall(F.map_keys("allowed"), lambda k: accepted(F.try_element_at("arguments", k), F.element_at("allowed", k)))
    docs = F.col("relevant").isNotNull()
    cited = F.coalesce(F.size("cited") > 0, F.lit(False))
    return runs.withColumns(
        {
            "tools_ok": same_set(F.col("called_tools"), F.col("expected_tools")),
            "arguments_ok": F.when(F.col("allowed").isNotNull(), F.coalesce(right, F.lit(False))),
            "place_ok": F.when(F.col("lon").isNotNull(), F.coalesce(in_box(F.col("lon"), F.col("lat"), F.col("box")), F.lit(False))),
            "passages_ok": F.when(docs, F.coalesce(F.arrays_overlap("passages", "relevant"), F.lit(False))),
            "citations_ok": F.when(docs, cited & F.forall("cited", lambda n: (n >= 1) & (n <= F.size("passages")))),
            "answered_ok": F.when(F.col("answerable"), F.length(F.trim(F.coalesce("answer", F.lit("")))) > 0),
        }
    )


def check_rates(runs: DataFrame, checks: tuple[str, ...] = CHECKS, by: str = "set") -> DataFrame:
    """(group, check, passed, of, rate) over all runs and by set; a null check doesn't apply; rate is null of none.

    ``pass`` holds where every check that applies does.
    """
    whole = F.forall(F.filter(F.array(*(F.col(c) for c in checks)), lambda c: c.isNotNull()), lambda c: c)
    long = runs.withColumn("pass", whole).select(F.col(by).alias("g"), F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in (*checks, "pass")))).alias("x")).select("g", "x.*")
    out = long.groupingSets([["check"], ["check", "g"]], "check", "g").agg(F.count_if(F.col("ok")).alias("passed"), F.count("ok").alias("of"), F.grouping("g").alias("all"))
    return out.select(F.when(F.col("all") == 1, "all").otherwise(F.col("g")).alias("group"), "check", "passed", "of", F.round(F.try_divide("passed", "of"), 3).alias("rate"))
