"""Occurrences and record counts of every distinct term, with a mark for terms too rare or too common.

Last-seen counters: the tokens of a partition are read in record order and every term keeps three numbers, its
occurrences, its records and the last record it was seen in; a record is counted when the last one differs, so
no per-record set exists. The counters run inside the scan's partitions (a record lies in one of them), are
handed on whenever ``flush`` terms are held, and are then hash-partitioned by term and summed. What is shuffled
is one row per term and task, whatever the number of tokens, so a term of every record is no hot key.

Null and empty texts are records without terms; they count in the share. Repeated rows are records of their
own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = re.compile(r"[^\W_]+")


def _count_batches(flush: int):
    def table(held: dict[str, list[int]]) -> pa.RecordBatch:
        terms, counts = list(held), list(held.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())],
            names=["term", "occurrences", "records"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        get, find, record = held.get, TERM.findall, 0
        for b in batches:
            for text in b.column(0).to_pylist():
                record += 1
                if not text:
                    continue
                for term in find(text.lower()):
                    c = get(term)
                    if c is None:
                        held[term] = [1, 1, record]
                    elif c[2] == record:
                        c[0] += 1
                    else:
                        c[0] += 1
                        c[1] += 1
                        c[2] = record
                if len(held) > flush:  # between records, so that none is counted twice
                    yield table(held)
                    held.clear()
        yield table(held)

    return run


def term_counts(df: DataFrame, text_col: str, flush: int = 300_000) -> DataFrame:
    """(term, occurrences, records) of every maximal run of letters and digits in the lower-cased text."""
    parts = df.select(F.col(text_col).alias("text")).mapInArrow(_count_batches(flush), "term string, occurrences long, records long")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, text_col: str, rare_below: int = 3, common_percent: int = 30) -> DataFrame:
    """(term, occurrences, records, mark): mark is rare (fewer than rare_below records), common (in more than
    common_percent of all records, nulls included) or null."""
    n = df.count()
    return term_counts(df, text_col).withColumn(
        "mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > F.lit(common_percent * n), "common")
    )
