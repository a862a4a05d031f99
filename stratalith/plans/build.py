"""Building and updating an index: documents, chunks, and the tables that search derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.operators import chunking, index, lexical, sections
from stratalith.session import cut_lineage
from stratalith.sources import providers

TABLES = ("documents", "chunks", "postings", "statistics", "frequencies")
TEMPLATE = "{section}\n\n{content}"


def ingest(pages: DataFrame, settings: chunking.Settings = chunking.Settings(), layout: sections.Layout | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with hash, chunks) of raw pages (page_id, url, content, fetched_at)."""
    found = cut_lineage(sections.html_sections(pages, layout))  # pages are parsed once for texts, states and chunks
    texts = chunking.page_texts(found).join(pages.select("page_id", "fetched_at"), "page_id")
    newest = index.newest(texts).select("page_id", "url", "title", "content_hash", "fetched_at")
    return newest, chunking.chunk_sections(found.join(newest.select("page_id"), "page_id", "left_semi"), settings)


def build(pages: DataFrame, out: str, provider: Callable[[list[str]], list[list[float]]], dim: int, model: str, digest: str, settings: chunking.Settings = chunking.Settings(), layout: sections.Layout | None = None) -> dict[str, int]:
    """Brings the index in ``out`` in step with the pages: only new and changed pages are embedded, pages that are
    gone go with their chunks, and the derived tables are written anew. Gives the number of pages by state."""
    spark = pages.sparkSession
    texts, chunks = ingest(pages, settings, layout)
    new = texts.withColumn("index_config", F.lit(chunking.recipe(settings, model, digest, TEMPLATE)))
    old = _read(spark, out, "documents")
    states = index.changes(old, new) if old is not None else new.select("url", F.lit("new").alias("state"))
    stale = states.where("state in ('new', 'changed')").select("url")
    fresh = chunks.join(stale, "url", "left_semi").withColumn("id", F.xxhash64("url", "chunk_index")).withColumn("document_id", F.xxhash64("url"))
    vectors = providers.embed_chunks(fresh, provider, dim)
    fresh = fresh.join(vectors, "id").select("id", "document_id", "url", "chunk_index", "section", "anchor", "content", "embedding")
    stored = _read(spark, out, "chunks")
    whole = fresh if stored is None else index.replace_pages(stored, fresh, states.where("state in ('removed', 'changed')"))
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}  # four rows at most
    _write(whole, out, "chunks")
    _write(new.select(F.xxhash64("url").alias("id"), "url", "title", "content_hash", "index_config", "fetched_at"), out, "documents")
    chunks = _read(spark, out, "chunks")
    table = lexical.lexeme_table(chunks)
    words = cut_lineage(lexical.word_stems(lexical.vocabulary(table), True))
    _write(lexical.postings(table, words), out, "postings")
    _write(lexical.corpus_statistics(table).join(index.fingerprint(chunks).select("fingerprint")), out, "statistics")
    _write(lexical.document_frequency(_read(spark, out, "postings")), out, "frequencies")
    return counts


def search(spark: SparkSession, out: str, questions: DataFrame, k: int = 5) -> DataFrame:
    """BM25 over a built index, from its stored postings."""
    check_derived(spark, out)
    tables = {name: _read(spark, out, name) for name in TABLES}
    return lexical.stored_bm25(tables["postings"], tables["frequencies"], tables["statistics"], tables["chunks"], questions, k)


def check_derived(spark: SparkSession, out: str) -> None:
    """Raises if the derived tables aren't those of the chunks."""
    if _read(spark, out, "statistics").first().fingerprint != index.fingerprint(_read(spark, out, "chunks")).first().fingerprint:
        raise RuntimeError("derived tables are stale; build again")


def _current(spark: SparkSession, out: str, name: str) -> int:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    done = [f.getPath().getName() for f in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max((int(n[1:]) for n in done), default=0)


def _read(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """The newest whole version of a table; one without its marker was broken off and doesn't count."""
    v = _current(spark, out, name)
    return spark.read.parquet(f"{out}/{name}/v{v}") if v else None


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}/v{_current(df.sparkSession, out, name) + 1}")
