"""Incremental maintenance of an index: what changed, what goes, and whether a copy is in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = (6, 3)


def newest(files: DataFrame, key: str = "url", at: str = "fetched_at") -> DataFrame:
    """One row a page: the newest, of equal ones the largest hash. Repeated rows count once."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("content_hash").desc())
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def changes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(url, state): new, changed, unchanged or removed, by null-safe comparison of hash and recipe."""
    a = stored.select("url", F.col("content_hash").alias("h0"), F.col("index_config").alias("c0"), F.lit(1).alias("old"))
    b = new.select("url", F.col("content_hash").alias("h1"), F.col("index_config").alias("c1"), F.lit(1).alias("now"))
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("c0").eqNullSafe(F.col("c1"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, "url", "full_outer").select("url", state.alias("state"))


def removed(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored pages that are no longer in the sources."""
    return stored.join(new.select("url").distinct(), "url", "left_anti")


def replace_pages(chunks: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunk table after an update: chunks of changed and removed pages go, those of fresh pages come."""
    stale = fresh.select("url").union(gone.select("url")).distinct()
    return chunks.join(stale, "url", "left_anti").unionByName(fresh)


def fingerprint(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (n, fingerprint): the count and a digest of the set of ids.

    Ids are digested in order within buckets of their MD5's first six hexadecimal digits, buckets within their first
    three, and those as a whole. However ids are distributed, no group holds more than a few thousand entries for 10**10
    rows.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), ",")
    i = F.col(id_col).cast("string")
    level = rows.where(F.col(id_col).isNotNull()).select(F.md5(i).alias("o"), i.alias("t"), F.lit(1).cast("long").alias("n"))
    for digits in DIGITS:
        level = level.groupBy(F.substring("o", 1, digits).alias("b")).agg(F.md5(text).alias("t"), F.sum("n").alias("n")).withColumnRenamed("b", "o")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.md5(text).alias("fingerprint"))


def check_in_step(index: DataFrame, copy: DataFrame, id_col: str = "id") -> None:
    """Raises if a copy's fingerprint isn't the index's."""
    a, b = fingerprint(index, id_col).first(), fingerprint(copy, id_col).first()
    if a != b:
        raise RuntimeError(f"the copy is stale: {b.n} rows against {a.n}; rebuild it")


def totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: number of pages and of chunks."""
    return documents.agg(F.count("*").alias("documents")).join(chunks.agg(F.count("*").alias("chunks")))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: a unique constraint as a query."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows without parent: a foreign key as a query."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
