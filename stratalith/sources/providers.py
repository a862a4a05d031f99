"""Model providers: embeddings, scores and chat come from outside and are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalith.functions.text import index_text

BATCH = 32
PROMPT = "Judge whether the passage answers the question. Reply yes or no.\nQuestion: %s\nPassage: %s\n\n%s"


def embed(rows: DataFrame, id_col: str, text_col: str, provider: Callable[[list[str]], list[list[float]]], dim: int, batch: int = BATCH) -> DataFrame:
    """(id, embedding): texts go to the provider in batches, in order. A count or length that doesn't fit raises."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                vectors = provider(part["t"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                if any(v is None or len(v) != dim for v in vectors):
                    raise ValueError(f"a vector isn't of length {dim}")
                yield pd.DataFrame({"id": part["i"], "embedding": vectors})

    return rows.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "id long, embedding array<float>")


def embed_chunks(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    return embed(chunks.select("id", index_text(F.col("section"), F.col("content")).alias("text")), "id", "text", provider, dim)


def scorer(questions: DataFrame, chunks: DataFrame, provider: Callable[[list[str]], list[dict[str, float]]]) -> Callable[[DataFrame], DataFrame]:
    """A scorer for retrieve(): prompts of the candidates go to a provider of next-token log-probabilities."""
    from stratalith.operators.retrieval import relevance

    def score(ranked: DataFrame) -> DataFrame:
        text = chunks.select(F.col("id").cast("long").alias("id"), F.col("section").alias("s"), F.col("content").alias("c"))
        asked = questions.select(F.col("id").alias("qid"), F.col("question").alias("q"))
        rows = ranked.select("qid", F.col("id").cast("long").alias("id")).join(text, "id").join(asked, "qid").select("qid", "id", F.format_string(PROMPT, "q", "s", "c").alias("p"))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in it:
                yield b[["qid", "id"]].assign(lp=provider(b["p"].tolist()))

        out = rows.mapInPandas(run, rows.select("qid", "id").schema.add("lp", T.MapType(T.StringType(), T.DoubleType())))
        return out.select("qid", "id", relevance(F.col("lp")).alias("score"))

    return score


def model_digest(name: str, models: list[dict]) -> str:
    """The digest of a model in a server's list of {"name", "digest"}; a name without tag means its latest."""
    for m in models:
        if m.get("name") in (name, f"{name}:latest"):
            return m["digest"]
    raise ValueError(f"no model {name}; pull it first")


def translate(questions: DataFrame, provider: Callable[[list[str]], list[str]]) -> DataFrame:
    """(id, english) of the questions that aren't English, by a provider of translations for batches of texts.

    Answers are tidied of white space and quotes around them; an empty one leaves the question as it is.
    """
    rows = questions.where("lower(lang) <> 'en' and question is not null").select("id", "question")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            got = provider(b["question"].tolist()) if len(b) else []
            if len(got) != len(b):
                raise ValueError(f"{len(got)} translations for {len(b)} questions")
            yield pd.DataFrame({"id": b["id"], "english": [" ".join(t.split()).strip("\"'“”«»") or None for t in got]})

    return rows.mapInPandas(run, rows.select("id").schema.add("english", T.StringType()))


def translated(questions: DataFrame, translations: DataFrame) -> DataFrame:
    """Questions in English: English ones stay; others take their translation (id, english) unless it is missing."""
    t = translations.select("id", "english")
    stays = F.lower("lang") == "en"
    return questions.join(t, "id", "left").withColumn("question", F.when(stays, F.col("question")).otherwise(F.coalesce("english", "question"))).drop("english")


def use_translation(wanted: bool | None, method: str) -> bool:
    """Translation is on except for vector search, where asking for it is an error."""
    if method == "vector":
        if wanted:
            raise ValueError("vector search takes no translation")
        return False
    return wanted is not False
