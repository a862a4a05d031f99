"""Registered queries: name -> (spark, directory) -> DataFrame. Those on tables read them whole; cases.py has those on
planted rows with results worked by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import text, vectors
from stratalith.functions.stemming import stems
from stratalith.operators import answers, catalogue, chunking, evaluation, index, lexical, line_documents, retrieval, sections
from stratalith.session import checkpoint_dir, table
from stratalith.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# Text functions


@query
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned"))


@query
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("id").cast("long").alias("id"), text.estimate_tokens(F.col("content")).alias("tokens"))


@query
def token_estimate_by_recipe(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_files").select("url", "chunking.tokens_per_word", F.explode("chunks").alias("c"))
    return c.select("url", F.col("c.chunk_index").cast("long").alias("chunk_index"), text.estimate_tokens(F.col("c.content"), F.col("tokens_per_word")).alias("tokens")).distinct()


@query
def sentence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("id").cast("long").alias("id"), F.size(text.sentences(F.col("content"))).cast("long").alias("sentences"))


@query
def url_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_documents").select("url", text.slug(F.col("url")).alias("slug"), text.is_pdf(F.col("url")).alias("pdf"))


@query
def title_key(spark: SparkSession, d: str) -> DataFrame:
    """Titles that agree but for case and spaces."""
    t = table(spark, d, "index_documents").select(text.lookup_key(F.col("title")).alias("key"))
    return t.groupBy("key").agg(F.count("*").alias("pages"))


@query
def citation_links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "document_id", "anchor")
    docs = table(spark, d, "index_documents").select(F.col("id").alias("document_id"), "url")
    return c.join(docs, "document_id").select(F.col("id").cast("long").alias("id"), text.citation_url(F.col("url"), F.col("anchor")).alias("citation"))


@query
def content_hash_dupes(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "chunks").select(text.content_hash(F.col("content")).alias("hash"))
    return h.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


@query
def debris_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(text.is_debris(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines (numbers as #) on a tenth of a source's documents, three at least."""
    docs = table(spark, d, "documents")
    c = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    keys = c.select("source", "doc_id", text.margin_key(F.col("line")).alias("key")).where("key <> ''").distinct()
    counts = keys.groupBy("source", "key").agg(F.count("*").alias("n"))
    return counts.join(docs.groupBy("source").agg(F.count("*").alias("pages")), "source").where(F.col("n") >= F.greatest(F.lit(3), 0.1 * F.col("pages"))).select("source", "key", "n")


@query
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "chunks").select("document_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]+)"), 1)).alias("word"))
    return w.groupBy("document_id").agg(F.count_distinct("word").alias("words")).select(F.col("document_id").cast("long").alias("document_id"), "words")


@query
def stem_classes(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the index's lexemes, with the number of words that share each."""
    t = lexical.lexeme_table(table(spark, d, "chunks")).select(F.explode("lexemes").alias("lexeme"))
    return stems(t).groupBy("stem").agg(F.count("*").alias("words"))


# Page text to sections and chunks


@query
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all pages, whatever their layout."""
    s = sections.html_sections(table(spark, d, "raw_pages"), sections.ANY)
    return s.select("page_id", "position", F.array_join("path", " > ").alias("section"), "anchor", F.size("blocks").alias("blocks"))


@query
def html_refused(spark: SparkSession, d: str) -> DataFrame:
    """Pages that have not the default layout, by reason."""
    return sections.refused_pages(table(spark, d, "raw_pages")).groupBy("refused").agg(F.count("*").alias("pages"))


@query
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_sections(sections.html_sections(table(spark, d, "raw_pages"), sections.ANY))


@query
def page_hashes(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_texts(sections.html_sections(table(spark, d, "raw_pages"), sections.ANY)).select("page_id", "url", "title", "content_hash")


@query
def line_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents by lines; the lines of every text are set out on pages of 40."""
    doc = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("trim(line) <> ''")
    page, y = (F.floor(F.col("n") / 40) + 1).cast("int"), (F.col("n") % 40) * 15.0 + 100
    size = F.when(F.col("line").rlike(r"^\d+(\.\d+)*\.? \S"), 14.0).otherwise(10.0)
    lines = doc.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"), F.lit("Document").alias("title"), F.lit(800.0).alias("height"), page.alias("page"), F.regexp_replace("line", r"^\d+(\.\d+)*", "1").alias("text"), y.alias("top"), (y + 12).alias("bottom"), F.lit(50.0).alias("x0"), size.alias("size"), F.lit(None).cast("array<array<string>>").alias("cells"))
    s = line_documents.line_sections(lines)
    return s.select("page_id", "position", F.array_join("path", " > ").alias("section"), "anchor", F.size("blocks").alias("blocks"))


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.size_summary(table(spark, d, "chunks"), text.estimate_tokens(F.col("content")))


@query
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").join(table(spark, d, "index_documents").select(F.col("id").alias("document_id"), "url"), "document_id")
    return chunking.ingest_statistics(c.select("url", "section", "content"))


@query
def split_sections(spark: SparkSession, d: str) -> DataFrame:
    return _long(chunking.split_sections(table(spark, d, "chunks")), "document_id")


@query
def chunk_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Page-wide numbers from 0, and whether they are the stored ones."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    c = table(spark, d, "chunks").select("id", "chunk_index", (F.row_number().over(w) - 1).alias("number"))
    return c.select(F.col("id").cast("long").alias("id"), F.col("number").cast("long").alias("number"), (F.col("number") == F.col("chunk_index")).alias("same"))


# Ranked retrieval


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_questions")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Query vectors: those of every chunk whose id is divisible by 100."""
    return table(spark, d, "chunks").where("id % 100 = 0").select(F.col("id").cast("long").alias("qid"), F.col("embedding").alias("vec"))


def _asked_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks as questions: their section is what is asked."""
    return table(spark, d, "chunks").where("id % 100 = 0").select(F.col("id").cast("long").alias("id"), F.col("section").alias("question"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", F.col("id").cast("long").alias("id"), "score")


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(lexical.bm25(table(spark, d, "chunks"), _questions(spark, d)))


@query
def bm25_topk_unstemmed(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(lexical.bm25(table(spark, d, "chunks"), _questions(spark, d), stemmed=False))


@query
def bm25_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(lexical.matches(table(spark, d, "chunks"), lexical.question_terms(_questions(spark, d)))[0])


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_statistics(lexical.lexeme_table(table(spark, d, "chunks"))).select("n", F.round("avg_len", 6).alias("avg_len"))


@query
def tf_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(lexical.frequency_rank(table(spark, d, "chunks"), _questions(spark, d)))


@query
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(retrieval.vector(table(spark, d, "chunks"), _queries(spark, d)))


@query
def vector_scores_scale(spark: SparkSession, d: str) -> DataFrame:
    """Distances of consecutive chunks on a page, as scores of search engines and back."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    c = table(spark, d, "chunks").select("id", "embedding", F.lag("embedding").over(w).alias("before"))
    dist = c.where("size(embedding) > 0 and size(before) > 0").select(F.col("id").cast("long").alias("id"), vectors.cosine_distance(F.col("embedding"), F.col("before")).alias("dist")).where("dist is not null")
    score = vectors.similarity_score(F.col("dist"))
    return dist.select("id", F.round(score, 6).alias("score"), F.round(vectors.distance_of(score), 6).alias("distance"))


@query
def vector_lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(retrieval.lsh_neighbours(table(spark, d, "chunks"), _queries(spark, d)))


@query
def vector_lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.recall(vector_lsh_topk(spark, d), vector_topk_cosine(spark, d))


@query
def shared_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = lexical.frequency_rank(table(spark, d, "chunks"), _questions(spark, d), retrieval.CANDIDATES)
    return retrieval.shared_ranks(s, ["qid"], False).select("qid", F.col("id").cast("long").alias("id"), "shared")


@query
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(retrieval.hybrid(table(spark, d, "chunks"), _asked_chunks(spark, d), _queries(spark, d)))


@query
def rrf_hybrid_native(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(retrieval.hybrid(table(spark, d, "chunks"), _asked_chunks(spark, d), _queries(spark, d), native=True))


@query
def rerank_top20(spark: SparkSession, d: str) -> DataFrame:
    """BM25 candidates in the order of another score: the share of the question's words that a chunk holds."""
    chunks, asked = table(spark, d, "chunks"), _questions(spark, d)

    def scorer(ranked: DataFrame) -> DataFrame:
        q = lexical.question_terms(asked, stemmed=False)
        held = lexical.lexeme_table(chunks).select("id", F.array_distinct("lexemes").alias("held"))
        rows = ranked.select("qid", "id").join(held, "id").join(q.groupBy("qid").agg(F.collect_list("lexeme").alias("asked")), "qid")
        return rows.select("qid", "id", F.round(F.size(F.array_intersect("asked", "held")) / F.size("asked"), 6).alias("score"))

    return _ranked(retrieval.retrieve(chunks, asked, method="lexical", scorer=scorer))


@query
def relevance_log_odds(spark: SparkSession, d: str) -> DataFrame:
    """Log-odds from maps of log-probabilities, made of term counts; a missing token takes the lowest."""
    c = table(spark, d, "chunks").select("id", text.terms(F.col("content")).alias("t"))
    share = lambda w: F.log((F.size(F.filter("t", lambda x: x == w)) + 1.0) / (F.size("t") + 1.0))
    lp = F.map_filter(F.create_map(F.lit("yes"), share("the"), F.lit("no"), share("de"), F.lit("maybe"), share("and")), lambda k, v: v > F.log(1.0 / (F.size("t") + 1.0)))
    m = c.select("id", lp.alias("lp")).where(F.size("lp") > 0)
    return m.select(F.col("id").cast("long").alias("id"), F.round(retrieval.relevance(F.col("lp")), 6).alias("relevance"))


@query
def topk_then_join(spark: SparkSession, d: str) -> DataFrame:
    top = lexical.bm25(table(spark, d, "chunks"), _questions(spark, d))
    return retrieval.with_documents(top, table(spark, d, "chunks"), table(spark, d, "index_documents")).select("qid", "rank", "section", "citation")


@query
def label_knn_hit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the nearest other vector has the same label, for every vector whose id is divisible by 100, by label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = retrieval.vector_scores(e, e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vec")), 1)
    best = near.groupBy("qid").agg(F.min(F.struct("score", "id")).alias("x")).select("qid", F.col("x.id").alias("id"))
    a, b = e.select(F.col("id").alias("qid"), F.col("label").alias("l")), e.select("id", F.col("label").alias("m"))
    hit = best.join(a, "qid").join(b, "id").select(F.col("l").cast("long").alias("label"), (F.col("l") == F.col("m")).cast("double").alias("hit"))
    return hit.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("share"))


# Index maintenance


def _new_pages(spark: SparkSession, d: str) -> DataFrame:
    f = index.newest(table(spark, d, "chunk_files").withColumn("fetched_at", F.to_timestamp("fetched_at")))
    c = F.col("chunking")
    config = F.format_string("%d/%d/%d v%d", c["max_tokens"], c["target_tokens"], c["overlap_tokens"], c["version"])
    return f.select("url", "content_hash", config.alias("index_config"))


@query
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    return index.changes(table(spark, d, "index_documents"), _new_pages(spark, d))


@query
def removed_pages_anti(spark: SparkSession, d: str) -> DataFrame:
    return index.removed(table(spark, d, "index_documents"), _new_pages(spark, d)).select("url")


@query
def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per page after pages with fresh chunk files were replaced."""
    docs = table(spark, d, "index_documents").select(F.col("id").alias("document_id"), "url")
    old = table(spark, d, "chunks").join(docs, "document_id").select("url", "chunk_index", "content")
    f = index.newest(table(spark, d, "chunk_files").withColumn("fetched_at", F.to_timestamp("fetched_at")))
    fresh = f.select("url", F.explode("chunks").alias("c")).select("url", "c.chunk_index", "c.content")
    return index.replace_pages(old, fresh, fresh.limit(0)).groupBy("url").agg(F.count("*").alias("chunks"))


@query
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return index.fingerprint(table(spark, d, "chunks"))


@query
def totals(spark: SparkSession, d: str) -> DataFrame:
    return index.totals(table(spark, d, "index_documents"), table(spark, d, "chunks"))


@query
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return index.duplicate_keys(table(spark, d, "chunk_files"), "url")


@query
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    return index.orphans(table(spark, d, "chunks").select("id", "document_id"), table(spark, d, "index_documents"), "document_id", "id").agg(F.count("*").alias("orphans"))


@query
def full_export(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its page, as the copy of another engine holds it (vectors left out)."""
    docs = table(spark, d, "index_documents").select(F.col("id").alias("document_id"), "url", "title")
    c = table(spark, d, "chunks").select("id", "document_id", "chunk_index", "section", "content")
    return _long(c.join(docs, "document_id").select("id", "url", "title", "chunk_index", F.md5(text.index_text(F.col("section"), F.col("content"))).alias("digest")), "id", "chunk_index")


# Evaluation


@query
def label_validation_anti(spark: SparkSession, d: str) -> DataFrame:
    """Labels that an index of the pages with chunk files would not hold."""
    docs = table(spark, d, "index_documents").join(table(spark, d, "chunk_files").select("url").distinct(), "url", "left_semi")
    return evaluation.unknown_labels(_questions(spark, d), table(spark, d, "chunks"), docs)


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    chunks, docs, q = table(spark, d, "chunks"), table(spark, d, "index_documents"), _questions(spark, d)
    return evaluation.first_ranks(lexical.bm25(chunks, q, evaluation.DEPTH), q, chunks, docs)


@query
def first_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return _firsts(spark, d).select("qid", "first")


@query
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_firsts(spark, d)).select("questions", *(f"hit_{n}" for n in evaluation.HITS))


@query
def mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_firsts(spark, d)).select("questions", "mrr")


@query
def metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.grouped_metrics(_firsts(spark, d))


@query
def miss_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.misses(_firsts(spark, d))


@query
def answer_location(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.answer_in(_questions(spark, d))


@query
def agent_check_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of checks on runs: here whether the first five hold an answer, the first hit is one, and (English only)
    whether the question was found at all."""
    first = F.col("first")
    runs = _firsts(spark, d).select(F.col("written").alias("set"), F.coalesce(first <= 5, F.lit(False)).alias("passages"), F.coalesce(first == 1, F.lit(False)).alias("citations"), F.when(F.col("lang") == "en", first.isNotNull()).alias("answered"))
    return evaluation.check_rates(runs, ("passages", "citations", "answered"))


# Catalogue


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.normalise(table(spark, d, "scenes"))


@query
def scene_normalise(spark: SparkSession, d: str) -> DataFrame:
    s = _scenes(spark, d)
    return s.select("id", F.date_format("acquired", "yyyy-MM-dd HH:mm:ss").alias("acquired"), catalogue.satellite(F.col("platform")).alias("satellite"), "mode", F.array_join("polarisations", "+").alias("polarisations"), "orbit", F.col("relative_orbit").cast("long").alias("track"))


@query
def scene_search(spark: SparkSession, d: str) -> DataFrame:
    found = catalogue.search(_scenes(spark, d), "2023-01-15", "2023-02-28", mode="IW", orbit="descending")
    return found.select("id", F.date_format("acquired", "yyyy-MM-dd HH:mm:ss").alias("acquired"))


@query
def scene_has_more(spark: SparkSession, d: str) -> DataFrame:
    found = catalogue.search(_scenes(spark, d), "2023-01-15", "2023-02-28", mode="EW")
    return found.agg(F.least(F.count("*"), F.lit(catalogue.LIMIT)).alias("shown"), (F.count("*") > catalogue.LIMIT).alias("more"))


@query
def scene_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.summary(_scenes(spark, d))


@query
def scene_passes(spark: SparkSession, d: str) -> DataFrame:
    p = catalogue.passes(_scenes(spark, d))
    return p.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "platform", "orbit", F.col("relative_orbit").cast("long").alias("track"), "scenes")


@query
def scene_tracks(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.tracks(_scenes(spark, d))


@query
def scene_modes(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.mode_counts(_scenes(spark, d))


@query
def scene_items(spark: SparkSession, d: str) -> DataFrame:
    return _scenes(spark, d).select("id", catalogue.item_url("https://catalogue.example/api/", "grd").alias("item"), catalogue.scene_line().alias("line"))


# Answers


@query
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", text.cited_numbers(F.col("text")).alias("n")).where(F.size("n") > 0)
    return n.select("doc_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("numbers"))


@query
def answer_context(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the numbered passages of each question."""
    chunks = table(spark, d, "chunks")
    top = lexical.bm25(chunks, _questions(spark, d)).select("qid", F.col("rank").alias("n"), "id", "section")
    return answers.context(top.join(chunks.select("id", "content"), "id")).select("qid", F.md5("context").alias("context"))


@query
def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Citations of answers: here every answer cites [1, 3] and [9]; 9 is unknown."""
    chunks, q = table(spark, d, "chunks"), _questions(spark, d)
    top = retrieval.with_documents(lexical.bm25(chunks, q), chunks, table(spark, d, "index_documents")).select("qid", F.col("rank").alias("n"), "section", "url")
    cited = answers.citations(q.select(F.col("id").alias("qid"), F.lit("As said [1, 3] and [9].").alias("answer")), top)
    return cited.select("qid", F.col("n").cast("long").alias("n"), "section", "url")


@query
def passage_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Ten questions make a session; a passage keeps the number of its first appearance."""
    top = lexical.bm25(table(spark, d, "chunks"), _questions(spark, d))
    call = F.substring("qid", 2, 9).cast("long")
    calls = top.select(F.floor((call - 1) / 10).cast("long").alias("session"), call.alias("call"), "rank", F.col("id").cast("long").alias("id"))
    return answers.number_passages(calls)


# Streaming


@query
def stream_hourly_events(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    folder = f"{checkpoint_dir(spark)}/hourly-{uuid.uuid4().hex[:8]}"
    w = windows.windowed(windows.read_events(spark, d))
    return windows.to_files(w, f"{folder}/rows", f"{folder}/state", ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", "value")
