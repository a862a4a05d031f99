"""Registered queries of the training-data operators: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import near_duplicates as nd
from stratalith.llm import leakage, main_content, neighbours, packing, splitting, term_counts, toxicity
from stratalith.session import cut_lineage, table

#: Runs of three words and a similarity of 0.6 define p1's cases.
P1 = {"k": 3, "threshold": 0.6}


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "chunks")
    return nd.near_duplicates(chunks, "id", nd.chunk_text(chunks), **P1)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _p1(spark, d)
    return nd.expand_pairs(pairs, members).select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk with its group and the number of similar classes."""
    pairs, members = _p1(spark, d)
    return nd.near_duplicate_classes(pairs, members)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "chunk_files"))
    return pieces.where("oversized and piece = 0").select("url", "chunk_index", "cut").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunk_files"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per page: words of its elements, which the pieces' own parts must hold once, and pieces above the limit."""
    limit = table(spark, d, "chunk_files").select("url", F.col("chunking.max_tokens").alias("most")).distinct()
    own = F.substring(F.col("content"), F.col("own_start") + 1, F.length("content"))
    pieces = p2_pieces(spark, d).join(limit, "url").select("url", F.size(F.regexp_extract_all(F.coalesce(own, F.lit("")), F.lit(r"(\S+)"), 1)).alias("words"), (F.col("oversized") & (F.col("tokens") > F.col("most"))).cast("long").alias("over"))
    return pieces.groupBy("url").agg(F.sum("words").alias("words"), F.sum("over").alias("over"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five closest other chunks of every chunk with a usable vector, in order."""
    return neighbours.nearest(table(spark, d, "chunks"), "id", "embedding", dim=128)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs_of(p3_neighbours(spark, d)).select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "chunks"), "content").where("mark is not null").select("term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "chunks"), "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.main_lines(table(spark, d, "raw_pages"))


def p5_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """The inferred wrapper of every host."""
    return main_content.wrapper_report(table(spark, d, "raw_pages"))


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a second piece in the assignment."""
    return _p6(spark, d).where("piece = 1").select(F.col("window_id").cast("int").alias("window_id"), "doc_id").distinct()


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of space used, per window."""
    w = table(spark, d, "context_windows").select(F.col("window_id").cast("long").alias("window_id"), "capacity")
    # Assignments are reduced per window before the fixed windows table is joined.
    g = _p6(spark, d).groupBy("window_id").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return g.join(w, "window_id").select("window_id", "capacity", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per window: tokens placed, containers above the capacity, documents whose tokens aren't placed once, and whether
    0.97 of the space is used (a table of little text may leave its last container open)."""
    w = table(spark, d, "context_windows").select(F.col("window_id").cast("long").alias("window_id"), "capacity")
    placed = cut_lineage(_p6(spark, d))
    full = placed.where("container is not null").groupBy("window_id", "container").agg(F.sum("tokens").alias("held")).join(F.broadcast(w), "window_id")
    full = full.groupBy("window_id", "capacity").agg(F.count_if(F.col("held") > F.col("capacity")).alias("over"), F.count("*").alias("containers"), F.sum("held").alias("tokens"))
    docs = placed.groupBy("window_id", "doc_id").agg(F.sum("tokens").alias("placed"), F.max("doc_tokens").alias("own"), F.count_distinct("start").alias("starts"), F.count("*").alias("n"))
    wrong = docs.groupBy("window_id").agg(F.count_if((F.col("placed") != F.col("own")) | (F.col("starts") != F.col("n"))).alias("wrong"))
    used = F.col("tokens") >= 0.97 * (F.col("containers") - 1) * F.col("capacity")
    return full.join(wrong, "window_id").select("window_id", "tokens", "over", "wrong", used.alias("full"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.disclosures(table(spark, d, "documents"), table(spark, d, "eval_questions"), "doc_id", "text", "id", "passage")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items that leaked, with the number of disclosing documents."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score per document and category."""
    return toxicity.score(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.flagged(p8_scores(spark, d)).distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and the share flagged in each category."""
    return toxicity.rates(table(spark, d, "documents"), p8_scores(spark, d), "doc_id", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_pieces, p2_checks, p3_found, p3_neighbours, p4_found, p4_terms, p5_found, p5_wrappers, p6_found, p6_assignment, p6_fill, p6_checks, p7_found, p7_items, p8_found, p8_scores, p8_rates)
}
