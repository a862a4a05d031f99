"""Sources and sinks on files: page lists, cached pages, chunk files, index tables, bulk requests."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = "url string, title string"
CHUNKING = "struct<max_tokens:int,target_tokens:int,overlap_tokens:int,version:int,tokens_per_word:double>"
CHUNK_FILE = f"url string, title string, content_hash string, fetched_at string, chunking {CHUNKING}, chunks array<struct<chunk_index:int,section:string,anchor:string,content:string,tokens:int>>"
DOCUMENTS = "id int, url string, title string, content_hash string, index_config string, fetched_at timestamp"
CHUNKS = "id int, document_id int, chunk_index int, section string, anchor string, content string, embedding array<float>"
QUESTIONS = "id string, written string, lang string, question string, relevant array<struct<section:string,url:string>>"


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, title) of a YAML file with ``pages`` (addresses) and ``pdfs`` (url and title; may be missing)."""
    import yaml

    with open(path) as f:
        y = yaml.safe_load(f) or {}
    rows = [(u, None) for u in y.get("pages") or []] + [(p["url"], p["title"]) for p in y.get("pdfs") or []]
    return spark.createDataFrame(rows, SOURCES)


def question_list(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a YAML list."""
    import yaml

    with open(path) as f:
        rows = yaml.safe_load(f) or []
    return spark.createDataFrame([tuple(r.get(c) for c in ("id", "written", "lang", "question", "relevant")) for r in rows], T.StructType.fromDDL(QUESTIONS))


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(url, fetched_at, content) of fetched pages: NAME.body with NAME.json beside it. The metadata is written last,
    so a body without it is a broken download and doesn't count."""
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "*.body").load(folder)
    meta = spark.read.schema("url string, fetched_at string").option("pathGlobFilter", "*.json").json(folder).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return bodies.select(F.regexp_extract("path", r"([^/]+)\.body$", 1).alias("name"), "content").join(meta, "name").select("url", "fetched_at", "content")


def fetch_page(url: str, folder: str, fetch: Callable[[str], bytes], now: Callable[[], str], refresh: bool = False) -> tuple[bytes, str, bool]:
    """(content, fetched_at, from_cache) of a page: from the cache folder unless it lacks the page or ``refresh`` asks
    for it anew; what is fetched is written through, body first, each file in one step."""
    name = hashlib.sha256(url.encode()).hexdigest()[:40]
    body, meta = os.path.join(folder, f"{name}.body"), os.path.join(folder, f"{name}.json")
    if not refresh and os.path.exists(meta) and os.path.exists(body):
        with open(meta) as m, open(body, "rb") as b:
            return b.read(), json.load(m)["fetched_at"], True
    content, at = fetch(url), now()
    os.makedirs(folder, exist_ok=True)
    for path, data in ((body, content), (meta, json.dumps({"url": url, "fetched_at": at}).encode())):
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
    return content, at, False


def agent_question_list(spark: SparkSession, path: str) -> DataFrame:
    """Agent questions of a YAML list: (id, set, question, labels, expected_tools, allowed, answerable)."""
    import yaml

    with open(path) as f:
        rows = yaml.safe_load(f) or []
    kind = "id string, set string, question string, labels string, expected_tools array<string>, allowed map<string,array<string>>, answerable boolean"
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in kind.split(", ")) for r in rows], kind)


def write_chunk_files(chunks: DataFrame, path: str) -> None:
    """One JSON record a page, replacing what was there."""
    chunks.write.mode("overwrite").json(path)


def read_chunk_files(spark: SparkSession, path: str, indented: bool = False) -> DataFrame:
    """Chunk files; indented: one indented JSON document a file. Raises if there are none."""
    df = spark.read.schema(CHUNK_FILE).option("multiLine", indented).json(path)
    if df.isEmpty():
        raise FileNotFoundError(f"no chunk files in {path}; ingest first")
    return df


def as_chunk_files(chunks: DataFrame, texts: DataFrame, fetched: DataFrame, settings: dict, per_word: float) -> DataFrame:
    """Chunk file records from chunks (url, title, ...), page texts (url, content_hash) and (url, fetched_at)."""
    chunk = F.struct("chunk_index", "section", "anchor", "content", "tokens")
    rows = chunks.groupBy("url", "title").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    chunking = F.struct(*(F.lit(v).alias(k) for k, v in settings.items()), F.lit(per_word).alias("tokens_per_word"))
    return rows.join(texts.select("url", "content_hash"), "url").join(fetched.select("url", "fetched_at"), "url").select("url", "title", "content_hash", "fetched_at", chunking.alias("chunking"), "chunks")


def overwrite_pages(pages: DataFrame, path: str, partition: str = "page_bucket") -> None:
    """Replaces the partitions present in ``pages`` and leaves the others: a page's rows change as a whole."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def bulk_requests(rows: DataFrame, index: str, id_col: str = "id", size: int = 100) -> DataFrame:
    """(request, rows): bodies of bulk requests, an action and a source line a row, ``size`` rows each."""
    names = rows.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for a in range(0, len(b), size):
                part = b.iloc[a : a + size]
                lines = [f'{{"index": {json.dumps({"_index": index, "_id": str(i)})}}}\n{d}\n' for i, d in zip(part["i"], part["d"], strict=True)]
                yield pd.DataFrame({"request": ["".join(lines)], "rows": [len(part)]})

    return rows.select(F.col(id_col).alias("i"), F.to_json(F.struct(*names)).alias("d")).mapInPandas(run, "request string, rows int")


def check_bulk_response(response: dict) -> None:
    """Raises on the first item that failed."""
    for item in response.get("items", []):
        for action, r in item.items():
            if "error" in r:
                raise RuntimeError(f"{action} of {r.get('_id')} failed: {r['error']}")


def write_run(path: str, label: str, stamp: str, record: dict) -> str:
    """One evaluation run as an indented JSON file named by time and label."""
    os.makedirs(path, exist_ok=True)
    name = os.path.join(path, f"{stamp.replace(':', '')}-{label}.json")
    with open(name, "w") as f:
        json.dump(record, f, indent=2, ensure_ascii=False)
    return name


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a database by JDBC; partitioned reads by partitionColumn, lowerBound, upperBound, numPartitions."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
