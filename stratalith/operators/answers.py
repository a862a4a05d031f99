"""Answers with citations: prompts from passages, citations back to sections, stable passage numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.text import cited_numbers


def context(passages: DataFrame) -> DataFrame:
    """(qid, context): the passages (qid, n, section, content) as numbered blocks, in order."""
    block = F.format_string("[%d] %s\n%s", F.col("n").cast("int"), "section", "content")
    x = passages.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), block.alias("t")))).alias("x"))
    return x.select("qid", F.array_join(F.transform("x", lambda p: p["t"]), "\n\n").alias("context"))


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, n, section, url): the citations of answers (qid, answer) with their passage; unknown numbers have null."""
    cited = answers.select("qid", F.explode(cited_numbers(F.col("answer"))).alias("n"))
    return cited.join(passages.select("qid", F.col("n").cast("int").alias("n"), "section", "url"), ["qid", "n"], "left")


def sources(cited: DataFrame) -> DataFrame:
    """(qid, section, url, numbers): known citations by section, in order of their first number."""
    g = cited.where("url is not null").groupBy("qid", "section", "url").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    return g.select("qid", "section", "url", F.col("ns")[0].alias("first"), F.array_join(F.transform("ns", lambda n: n.cast("string")), ", ").alias("numbers"))


def number_passages(calls: DataFrame) -> DataFrame:
    """(session, id, number): passages of a session's calls (session, call, rank, id) numbered by first appearance."""
    first = calls.groupBy("session", "id").agg(F.min(F.struct("call", "rank")).alias("at"))
    return first.select("session", "id", F.row_number().over(Window.partitionBy("session").orderBy("at", "id")).cast("long").alias("number"))
