"""Registered queries on planted rows, with their results worked by hand as SQL values.

They cover what SQL cannot recompute from the tables: reading pages, documents by lines, chunking, and the checks of
agent runs. Each case is stated beside its result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import text
from stratalith.operators import answers, catalogue, chunking, evaluation, index, lexical, line_documents, retrieval, sections
from stratalith.plans import agent, reports
from stratalith.sources import catalogues, files, providers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def case(columns: str, *rows: tuple):
    """Registers a query with the rows that it must give."""

    def literal(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        names = ", ".join(f'"{c.split()[0]}"' for c in columns.split(", "))
        values = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {c.split()[1]})" for v, c in zip(r, columns.split(", "), strict=True)) + ")" for r in rows)
        ORACLE[f.__name__] = f"SELECT * FROM (VALUES {values}) AS t({names})"
        return f

    return add


PAGES = [
    (1, "https://h.example/a", "<html><body><article id='content'><h1>Title [1]</h1><nav>skip</nav><section class='x article-body'><p>Lead <b>text</b> .</p><h2 id='a'>A</h2><p>one<br>two</p><!-- no --><h4 id='d'>Deep</h4><ul><li>x<ul><li>y</li></ul></li><li>z</ul></section></article></body></html>"),
    (2, "https://h.example/b", "<article id='content'><h1>Tables</h1><section class='article-body'><table><tr><th>h</th><td></td><td><p>One</p><p>Two</p></td></tr><tr><td></td></tr></table><h2></h2><h2>C <button>Copy</button><copy-clipboard>copy</copy-clipboard></h2><script>no</script><div>inline <i>only</i></div><div class='expand-control'><div>More <p>of it</p></div></div></section></article>"),
    (3, "https://h.example/c", "<html><head><title>Other</title></head><body><p>site of another build</p></body></html>"),
    (4, "https://h.example/d.pdf", "%PDF-1.6"),
    (5, "https://h.example/e", "<article id='content'><h1>Empty</h1><section class='article-body'><h2>Only a heading</h2></section></article>"),
    (6, "https://h.example/f", "<article id='content'><h1>No body</h1></article>"),
]


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, u, p.encode()) for i, u, p in PAGES], "page_id long, url string, content binary")


@case(
    "page_id BIGINT, position INT, section VARCHAR, anchor VARCHAR, blocks VARCHAR",
    (1, 0, "Title", None, "Lead text."), (1, 1, "Title > A", "a", "one two"), (1, 2, "Title > A > Deep", "d", "- x\n  - y\n- z"),
    (2, 0, "Tables", None, "h | One Two"), (2, 1, "Tables > C", None, "inline only¶More of it"),
)
def html_cases(spark: SparkSession, d: str) -> DataFrame:
    s = sections.html_sections(_pages(spark))
    return s.select("page_id", "position", F.array_join("path", " > ").alias("section"), "anchor", F.array_join("blocks", "¶").alias("blocks"))


@case("page_id BIGINT, refused VARCHAR", (3, "no article"), (4, "pdf"), (5, "no text"), (6, "no body"))
def html_refused_cases(spark: SparkSession, d: str) -> DataFrame:
    return sections.refused_pages(_pages(spark)).select("page_id", "refused")


@case("page_id BIGINT, text VARCHAR", (1, "Title\nLead text.\nTitle > A\none two\nTitle > A > Deep\n- x\n  - y\n- z"), (2, "Tables\nh | One Two\nTables > C\ninline only\nMore of it"))
def page_text_cases(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_texts(sections.html_sections(_pages(spark))).select("page_id", "text")


def _line(page: int, text: str, top: float, size: float = 10.0, x0: float = 50.0, cells: list | None = None) -> tuple:
    return (1, "https://h.example/m.pdf", "Manual", 800.0, page, text, float(top), float(top) + 10, x0, float(size), cells)


#: Running headers on three pages, front matter, wrapped and numbered headings, a hyphen the document resolves and one it
#: doesn't, a chart's letters, a list with an inner item and a wrapped one, a table with an empty row, numbers that don't
#: follow, a heading with a dot leader, a sentence over two pages, and an appendix.
LINES = [_line(p, f"Manual v{p}", 5) for p in (1, 2, 3)] + [
    _line(1, "Front matter text", 150), _line(1, "1 Scope", 200, 14), _line(1, "of the work", 212, 14), _line(1, "Some prose that is syn-", 240), _line(1, "thetic and goes on", 252),
    _line(1, "synthetic words [3] near-", 290), _line(1, "range ones", 302), _line(1, "N e a r R a n g e", 330), _line(1, "• First item", 400), _line(1, "wraps here", 412, x0=60.0), _line(1, "• Inner item", 424, x0=70.0), _line(1, "• Last item", 436),
    _line(2, "1.1 Detail", 200, 14), _line(2, "", 300, cells=[["a", "", None], [None, None, None], ["cut syn-\nthetic", "b", None]]), _line(2, "3 Not next", 400, 14), _line(2, "2 Next ...... 9", 440, 14), _line(2, "A sentence that goes", 660),
    _line(3, "on here.", 150), _line(3, "2 Next", 200, 14), _line(3, "End text here.", 240), _line(3, "A Extra", 300, 14), _line(3, "More text.", 340), _line(3, "A.1 No such", 380, 14), _line(3, "A1 Inner", 420, 14), _line(3, "Last text.", 460),
]
LINE = "page_id long, url string, title string, height double, page int, text string, top double, bottom double, x0 double, size double, cells array<array<string>>"


@case(
    "position INT, section VARCHAR, anchor VARCHAR, blocks VARCHAR",
    (0, "Manual > 1 Scope of the work", "page=1", "Some prose that is synthetic and goes on¶synthetic words near-range ones¶- First item wraps here\n  - Inner item\n- Last item"),
    (1, "Manual > 1 Scope of the work > 1.1 Detail", "page=2", "a | \ncut synthetic | b¶3 Not next¶2 Next...... 9¶A sentence that goes on here."),
    (2, "Manual > 2 Next", "page=3", "End text here."), (3, "Manual > A Extra", "page=3", "More text.¶A.1 No such"), (4, "Manual > A Extra > A1 Inner", "page=3", "Last text."),
)
def line_document_cases(spark: SparkSession, d: str) -> DataFrame:
    s = line_documents.line_sections(spark.createDataFrame(LINES, LINE))
    return s.select("position", F.array_join("path", " > ").alias("section"), "anchor", F.array_join("blocks", "¶").alias("blocks"))


def _lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINES, LINE)


@case("key VARCHAR", ("Manual v#",))
def margin_line_cases(spark: SparkSession, d: str) -> DataFrame:
    return line_documents.margin_keys(_lines(spark)).select("key")


@case("body DOUBLE", (10.0,))
def body_size_cases(spark: SparkSession, d: str) -> DataFrame:
    return line_documents.body_sizes(_lines(spark)).select("body")


@case("last VARCHAR, number VARCHAR, follows BOOLEAN", ("", "1", True), ("", "2", False), ("3.2", "4", True), ("3.2", "3.3", True), ("3.2", "3.2.1", True), ("3.2", "3.4", False), ("3", "A", True), ("A", "A1", True), ("A", "A", False), ("3", "3.2", False))
def numbering_cases(spark: SparkSession, d: str) -> DataFrame:
    from stratalith.functions.text import section_number

    rows = [("", "1"), ("", "2"), ("3.2", "4"), ("3.2", "3.3"), ("3.2", "3.2.1"), ("3.2", "3.4"), ("3", "A"), ("A", "A1"), ("A", "A"), ("3", "3.2")]
    last = F.coalesce(section_number(F.col("last")), F.array().cast("array<int>"))
    return spark.createDataFrame(rows, "last string, number string").withColumn("follows", line_documents.may_follow(last, section_number(F.col("number"))))


@case("top DOUBLE, text VARCHAR, cells VARCHAR", (100.0, "Ab c", None), (200.0, "", "h,-;m,x;m,-"), (300.0, "z", None))
def glyph_line_cases(spark: SparkSession, d: str) -> DataFrame:
    """Characters with a word gap, a rotated one, one inside a table, one without a letter; a table with a cell merged
    down two rows, an unnamed column and a glyph code."""

    def g(t: str, x: float, top: float, up: bool = True) -> tuple:
        return (1, 1, t, float(x), x + 5.0, float(top), top + 10.0, 10.0, up)

    def b(*x: float) -> tuple:
        return tuple(map(float, x))

    glyphs = spark.createDataFrame([g("A", 10, 100), g("b", 15, 100), g("c", 25, 101), g("V", 400, 50, False), g("t", 110, 205), g("z", 10, 300), g("(cid:3)", 10, 400)], "page_id long, page int, text string, x0 double, x1 double, top double, bottom double, size double, upright boolean")
    boxes = [[b(100, 200, 200, 220), b(200, 200, 300, 220)], [b(100, 220, 200, 260), b(200, 220, 300, 240)], [None, b(200, 240, 300, 260)]]
    kind = "page_id long, page int, x0 double, top double, x1 double, bottom double, text array<array<string>>, boxes array<array<struct<x0:double,top:double,x1:double,bottom:double>>>"
    grids = spark.createDataFrame([(1, 1, 100.0, 200.0, 300.0, 260.0, [["h", ""], ["m", "x(cid:12)"], [None, ""]], boxes)], kind)
    shown = F.array_join(F.transform("cells", lambda r: F.array_join(r, ",", "-")), ";")
    return line_documents.glyph_lines(glyphs, grids).select("top", "text", shown.alias("cells"))


@case(
    "n INT, chunks VARCHAR",
    (1, "A b c."),  # within the limit
    (2, "S1 b c d e f. S2 b c d e f.¶S2 b c d e f. S3 b c d e f.¶S3 b c d e f. S4 b c d e f."),  # 4 x 11 tokens, goal 44/2; an overlap of 11 fits
    (3, "r1 a\nr2 b\nr3 c"),
    (4, None),
)
def chunk_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, ["A b c."]), (2, [" ".join(f"S{k} b c d e f." for k in range(1, 5))]), (3, ["r1 a\nr2 b\nr3 c"]), (4, [])]
    s = chunking.Settings(max_tokens=40, target_tokens=35, overlap_tokens=12)
    u = spark.createDataFrame(rows, "n int, b array<string>").select("n", chunking.units(F.col("b"), s.target_tokens).alias("us"))
    return u.select("n", F.nullif(F.array_join(chunking.cut(F.col("us"), s), "¶"), F.lit("")).alias("chunks"))


RUN = "id string, set string, expected_tools array<string>, called_tools array<string>, arguments map<string,string>, allowed map<string,array<string>>, lon double, lat double, box array<double>, passages array<string>, relevant array<string>, answer string, cited array<int>, answerable boolean"
RUNS = [
    ("a", "main", ["docs"], ["docs", "docs"], {"mode": "IW"}, {"mode": ["IW", "EW"], "orbit": []}, 5.0, 5.0, [0.0, 0.0, 5.0, 5.0], ["p", "q"], ["q"], "yes", [1, 2], True),
    ("b", "main", ["docs"], [], None, None, None, None, None, ["p"], ["q"], " ", [3], True),
    ("c", "held", ["scenes"], ["scenes"], {}, {"mode": ["IW"]}, 9.0, 5.0, [0.0, 0.0, 5.0, 5.0], None, None, None, None, False),
]


def _runs(spark: SparkSession) -> DataFrame:
    return evaluation.agent_checks(spark.createDataFrame(RUNS, RUN))


@case("id VARCHAR, tools_ok BOOLEAN, arguments_ok BOOLEAN, place_ok BOOLEAN, passages_ok BOOLEAN, citations_ok BOOLEAN, answered_ok BOOLEAN", ("a", True, True, True, True, True, True), ("b", False, None, None, False, False, False), ("c", True, False, False, None, None, None))
def agent_checks(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark).select("id", *evaluation.CHECKS)


@case(
    "group VARCHAR, check VARCHAR, passed BIGINT, of BIGINT, rate DOUBLE",
    ("all", "tools_ok", 2, 3, 0.667), ("all", "arguments_ok", 1, 2, 0.5), ("all", "place_ok", 1, 2, 0.5), ("all", "passages_ok", 1, 2, 0.5), ("all", "citations_ok", 1, 2, 0.5), ("all", "answered_ok", 1, 2, 0.5), ("all", "pass", 1, 3, 0.333),
    ("main", "tools_ok", 1, 2, 0.5), ("main", "arguments_ok", 1, 1, 1.0), ("main", "place_ok", 1, 1, 1.0), ("main", "passages_ok", 1, 2, 0.5), ("main", "citations_ok", 1, 2, 0.5), ("main", "answered_ok", 1, 2, 0.5), ("main", "pass", 1, 2, 0.5),
    ("held", "tools_ok", 1, 1, 1.0), ("held", "arguments_ok", 0, 1, 0.0), ("held", "place_ok", 0, 1, 0.0), ("held", "passages_ok", 0, 0, None), ("held", "citations_ok", 0, 0, None), ("held", "answered_ok", 0, 0, None), ("held", "pass", 0, 1, 0.0),
)
def agent_run_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.check_rates(_runs(spark))


@case("id VARCHAR, label VARCHAR", ("x2", "no such question"))
def agent_labels_anti(spark: SparkSession, d: str) -> DataFrame:
    questions = spark.read.parquet(f"{d}/eval_questions.parquet")
    known = questions.agg(F.min("id").alias("labels")).select(F.lit("x1").alias("id"), "labels")
    agent = known.unionByName(spark.createDataFrame([("x2", "no such question"), ("x3", None)], "id string, labels string"))
    return evaluation.dangling_questions(agent, questions)


@case("id VARCHAR, hits BOOLEAN", ("inside", True), ("edge", True), ("outside", False))
def box_cases(spark: SparkSession, d: str) -> DataFrame:
    """Scene boxes against [0, 0, 10, 10]."""
    rows = [("inside", 2.0, 2.0, 3.0, 3.0), ("edge", 10.0, 5.0, 12.0, 6.0), ("outside", 11.0, 0.0, 12.0, 1.0)]
    return spark.createDataFrame(rows, "id string, west double, south double, east double, north double").select("id", catalogue.intersects(0.0, 0.0, 10.0, 10.0).alias("hits"))


@case("name VARCHAR, known BOOLEAN, place VARCHAR", (" La  Straße ", True, "here"), ("nowhere", True, None), ("new", False, None))
def place_cases(spark: SparkSession, d: str) -> DataFrame:
    cache = spark.createDataFrame([("la strasse", "here"), ("nowhere", None)], "key string, place string")
    return catalogues.places(spark.createDataFrame([(" La  Straße ",), ("nowhere",), ("new",)], "name string"), cache).select("name", "known", "place")


@case("url VARCHAR, state VARCHAR", ("same", "unchanged"), ("text", "changed"), ("recipe", "changed"), ("gone", "removed"), ("new", "new"), ("null", "unchanged"))
def change_cases(spark: SparkSession, d: str) -> DataFrame:
    kind = "url string, content_hash string, index_config string"
    old = spark.createDataFrame([("same", "h", "c"), ("text", "h", "c"), ("recipe", "h", "c"), ("gone", "h", "c"), ("null", None, "c")], kind)
    new = spark.createDataFrame([("same", "h", "c"), ("text", "x", "c"), ("recipe", "h", "d"), ("new", "h", "c"), ("null", None, "c")], kind)
    return index.changes(old, new)


@case("section VARCHAR, numbers VARCHAR", ("S", "1, 2"), ("T", "3"))
def source_group_cases(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([("q", 1, "S", "u", "c1"), ("q", 2, "S", "u", "c2"), ("q", 3, "T", "v", "c3")], "qid string, n int, section string, url string, content string")
    cited = answers.citations(spark.createDataFrame([("q", "x [3] y [1, 2] z [7]"), ("r", None)], "qid string, answer string"), p)
    return answers.sources(cited).select("section", "numbers")


def _said(f: Callable[[], object]) -> str:
    """What a call gives, or the error it raises."""
    try:
        return str(f())
    except (ValueError, RuntimeError, PermissionError) as e:
        return f"{type(e).__name__}: {e}"


@case("raw VARCHAR, terms VARCHAR", ("The satellites' orbits, and the dog's", "satellit orbit dog"), ("Hopping relational HOPES 12 über", "hop relat hope 12 über"), ("the of and", ""), ("", ""))
def analyser_cases(spark: SparkSession, d: str) -> DataFrame:
    """Lower case, possessives and stop words gone, Porter stems; words of other letters stay."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(("The satellites' orbits, and the dog's", "Hopping relational HOPES 12 über", "the of and", ""))], "k int, raw string")
    words = rows.select("k", "raw", F.posexplode_outer(text.lexemes(F.col("raw"))).alias("at", "lexeme"))
    stemmed = words.join(lexical.word_stems(words.where("lexeme is not null").select("lexeme").distinct(), True), "lexeme", "left")
    return stemmed.groupBy("raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), " ").alias("terms"))


@case("method VARCHAR, wanted BOOLEAN, used VARCHAR", ("vector", None, "False"), ("vector", True, "ValueError: vector search takes no translation"), ("vector", False, "False"), ("lexical", None, "True"), ("hybrid", True, "True"), ("hybrid", False, "False"))
def translation_switch_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = [("vector", None), ("vector", True), ("vector", False), ("lexical", None), ("hybrid", True), ("hybrid", False)]
    return spark.createDataFrame([(m, w, _said(lambda: providers.use_translation(w, m))) for m, w in rows], "method string, wanted boolean, used string")  # noqa: B023


@case("id VARCHAR, question VARCHAR", ("a", "noise floor"), ("b", "noise"), ("c", "x"))
def translation_cases(spark: SparkSession, d: str) -> DataFrame:
    """A provider's answer tidied, an English question left, an empty answer passed over."""
    q = spark.createDataFrame([("a", "es", "ruido"), ("b", "en", "noise"), ("c", "de", "x")], "id string, lang string, question string")
    said = {"ruido": ' "noise  floor" ', "x": " "}
    return providers.translated(q, providers.translate(q, lambda ts: [said[t] for t in ts])).select("id", "question")


@case("request VARCHAR, answer VARCHAR", ("cosine vector", "cosine distance, lower is closer"), ("lexical bm25", "bm25, higher is closer"), ("hybrid", "reciprocal rank fusion, higher is closer"), ("reranked", "log-odds of the reranker, higher is closer"))
def score_label_cases(spark: SparkSession, d: str) -> DataFrame:
    label = lambda m: retrieval.score_label(m, reranked=False)
    return spark.createDataFrame([("cosine vector", label("vector")), ("lexical bm25", label("lexical")), ("hybrid", label("hybrid")), ("reranked", retrieval.score_label("hybrid"))], "request string, answer string")


@case("request VARCHAR, refused BOOLEAN", ("unknown method", True), ("vector with translation", True), ("unknown ranking", True), ("native by frequency", True), ("k of 0", True), ("k of 21", True), ("hybrid", False), ("engine without copy", True), ("engine with a stale copy", True), ("native on tables", True), ("engine in step", False))
def request_gate_cases(spark: SparkSession, d: str) -> DataFrame:
    ids, ask, gate = spark.range(40), retrieval.check_request, retrieval.check_backend
    calls = {
        "unknown method": lambda: ask("x"), "vector with translation": lambda: ask("vector", "given"), "unknown ranking": lambda: ask("lexical", ranking="x"), "native by frequency": lambda: ask("hybrid-native", ranking="frequency"), "k of 0": lambda: ask("hybrid", k=0), "k of 21": lambda: ask("hybrid", k=21), "hybrid": lambda: ask("hybrid"),
        "engine without copy": lambda: gate("engine", "hybrid", ids, None), "engine with a stale copy": lambda: gate("engine", "hybrid", ids, ids.where("id > 0")), "native on tables": lambda: gate("tables", "hybrid-native", ids, None), "engine in step": lambda: gate("engine", "hybrid-native", ids, ids.orderBy("id")),
    }
    return spark.createDataFrame([(n, "Error" in _said(f)) for n, f in calls.items()], "request string, refused boolean")


@case("id BIGINT, rank BIGINT, score DOUBLE, prompt BIGINT", (2, 1, 4.9, 1), (1, 2, -4.9, 1))
def rerank_cases(spark: SparkSession, d: str) -> DataFrame:
    """A provider of log-probabilities, asked with the prompt of question, section and content, puts the second first."""
    chunks = spark.createDataFrame([(1, 0, "Radar", "noise noise floor"), (2, 1, "Orbit", "orbit files and noise")], "id int, chunk_index int, section string, content string")
    q = spark.createDataFrame([("q", "noise")], "id string, question string")

    def provider(prompts: list[str]) -> list[dict[str, float]]:
        if not all(p == providers.PROMPT % ("noise", *x) for p in prompts for x in [("Orbit", "orbit files and noise") if "orbit" in p else ("Radar", "noise noise floor")]):
            raise ValueError("another prompt")
        return [{"yes": -0.1, "no": -5.0} if "orbit" in p else {"yes": -5.0, "no": -0.1} for p in prompts]

    out = retrieval.retrieve(chunks, q, method="lexical", scorer=providers.scorer(q, chunks, provider))
    return out.select(F.col("id").cast("long").alias("id"), "rank", F.round("score", 6).alias("score"), F.lit(1).cast("long").alias("prompt"))


@case("id BIGINT, first DOUBLE", (1, 8.0), (2, 4.0), (3, 3.0))
def embedding_cases(spark: SparkSession, d: str) -> DataFrame:
    """A provider in batches of two that gives a text's length; the index text has the section and an empty line."""
    rows = spark.createDataFrame([(1, "ab", "word"), (2, None, "cd"), (3, "e", None)], "id int, section string, content string")
    return providers.embed_chunks(rows, lambda ts: [[float(len(t)), 1.0] for t in ts], 2).select("id", F.col("embedding")[0].cast("double").alias("first"))


@case("settings VARCHAR, recipe VARCHAR", ("plain", '{"chunking": {"max_tokens": 500, "overlap_tokens": 60, "target_tokens": 400, "version": 1}, "digest": "d", "model": "m", "template": "t"}'), ("version 2", '{"chunking": {"max_tokens": 500, "overlap_tokens": 60, "target_tokens": 400, "version": 2}, "digest": "d", "model": "m", "template": "t"}'))
def recipe_cases(spark: SparkSession, d: str) -> DataFrame:
    made = [("plain", chunking.recipe(chunking.Settings(), "m", "d", "t")), ("version 2", chunking.recipe(chunking.Settings(version=2), "m", "d", "t"))]
    return spark.createDataFrame(made, "settings string, recipe string")


@case("name VARCHAR, digest VARCHAR", ("m", "2"), ("x", "1"), ("y", "ValueError: no model y; pull it first"))
def model_digest_cases(spark: SparkSession, d: str) -> DataFrame:
    held = [{"name": "x", "digest": "1"}, {"name": "m:latest", "digest": "2"}]
    return spark.createDataFrame([(n, _said(lambda: providers.model_digest(n, held))) for n in ("m", "x", "y")], "name string, digest string")  # noqa: B023


@case("value VARCHAR, allowed VARCHAR, ok BOOLEAN", (None, "", True), ("a", "a,b", True), ("c", "a", False), (None, "a", False), ("a", "", False))
def accepted_value_cases(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([(None, ""), ("a", "a,b"), ("c", "a"), (None, "a"), ("a", "")], "value string, allowed string")
    return v.withColumn("ok", evaluation.accepted(F.col("value"), F.filter(F.split("allowed", ","), lambda x: x != "")))


@case("a VARCHAR, b VARCHAR, same BOOLEAN", ("x,y", "y,x,x", True), ("x", "y", False), ("x", "", False))
def set_equality_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("x,y", "y,x,x"), ("x", "y"), ("x", "")], "a string, b string")
    return rows.withColumn("same", evaluation.same_set(F.split("a", ","), F.split("b", ",")))


@case("lon DOUBLE, lat DOUBLE, inside BOOLEAN", (5.0, 5.0, True), (0.0, 10.0, True), (10.1, 5.0, False), (5.0, -1.0, False))
def point_in_box_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(5.0, 5.0), (0.0, 10.0), (10.1, 5.0), (5.0, -1.0)], "lon double, lat double")
    return rows.withColumn("inside", evaluation.in_box(F.col("lon"), F.col("lat"), F.array(*(F.lit(x) for x in (0.0, 0.0, 10.0, 10.0)))))


@case(
    "asked VARCHAR, days VARCHAR",
    ("7 days", "('2024-05-03', '2024-05-10')"), ("days win", "('2024-05-03', '2024-05-10')"), ("start", "('2024-05-01', '2024-05-10')"), ("start and end", "('2024-05-01', '2024-05-02')"), ("nothing", "ValueError: give days, or start"),
    ("no number", "ValueError: days is a positive number"), ("month 13", "ValueError: dates are YYYY-MM-DD"), ("backwards", "ValueError: start is after end"),
)
def day_range_cases(spark: SparkSession, d: str) -> DataFrame:
    today, days = dt.date(2024, 5, 10), catalogue.resolve_days
    asked = {"7 days": {"days": 7}, "days win": {"days": "7", "start": "2020-01-01"}, "start": {"start": "2024-05-01"}, "start and end": {"start": "2024-05-01", "end": "2024-05-02"}, "nothing": {}, "no number": {"days": "x"}, "month 13": {"start": "2024-13-01"}, "backwards": {"start": "2024-05-03", "end": "2024-05-02"}}
    return spark.createDataFrame([(n, _said(lambda: days(today, **a))) for n, a in asked.items()], "asked string, days string")  # noqa: B023


@case("filters VARCHAR, refused BOOLEAN", ("mode IW", False), ("mode XX", True), ("orbit up", True), ("product x", True), ("none", False))
def filter_domain_cases(spark: SparkSession, d: str) -> DataFrame:
    asked = {"mode IW": {"mode": "IW"}, "mode XX": {"mode": "XX"}, "orbit up": {"orbit": "up"}, "product x": {"product": "x"}, "none": {}}
    return spark.createDataFrame([(n, "Error" in _said(lambda: catalogue.check_filters(**a))) for n, a in asked.items()], "filters string, refused boolean")  # noqa: B023


@case("call INT, refused BOOLEAN", (1, True), (2, False), (3, False), (4, False))
def small_place_cases(spark: SparkSession, d: str) -> DataFrame:
    """A hut of 400 m: refused once, then taken; taken at once if confirmed; a town is taken."""
    hut, town, asked = catalogue.Place("Hut", "house", 10.0, 50.0, 10.004, 50.003), catalogue.Place("Town", "town", 10.0, 50.0, 10.1, 50.1), set()
    guard = catalogue.guard_place
    calls = [lambda: guard(hut, asked), lambda: guard(hut, asked), lambda: guard(hut, set(), True), lambda: guard(town, set())]
    return spark.createDataFrame([(k, _said(f) != "None") for k, f in enumerate(calls, 1)], "call int, refused boolean")


@case("url VARCHAR, answer VARCHAR", ("https://a.example/x", "b'ok'"), ("https://a.example/no/1", "PermissionError: robots.txt forbids https://a.example/no/1"), ("https://b.example/z", "PermissionError: robots.txt forbids https://b.example/z"), ("https://c.example/y", "b'y'"), ("https://d.example/z", "RuntimeError: robots.txt can't be read: 503"), ("https://c.example/gone", "RuntimeError: https://c.example/gone: 404"))
def page_fetch_cases(spark: SparkSession, d: str) -> DataFrame:
    pages = {"https://a.example/robots.txt": (200, b"User-agent: *\nDisallow: /no"), "https://a.example/x": (200, b"ok"), "https://b.example/robots.txt": (403, b""), "https://c.example/robots.txt": (404, b""), "https://c.example/y": (200, b"y"), "https://d.example/robots.txt": (503, b"")}
    fetch = catalogues.page_fetcher(lambda u: pages.get(u, (404, b"")), "bot", catalogues.Pace(sleep=lambda s: None))
    asked = ("https://a.example/x", "https://a.example/no/1", "https://b.example/z", "https://c.example/y", "https://d.example/z", "https://c.example/gone")
    return spark.createDataFrame([(u, _said(lambda: fetch(u))) for u in asked], "url string, answer string")  # noqa: B023


@case("rows INT, request VARCHAR", (2, '{"index": {"_index": "i", "_id": "0"}}\n{"id":0,"t":"a"}\n{"index": {"_index": "i", "_id": "1"}}\n{"id":1,"t":"a"}\n'), (1, '{"index": {"_index": "i", "_id": "2"}}\n{"id":2,"t":"a"}\n'))
def bulk_request_cases(spark: SparkSession, d: str) -> DataFrame:
    return files.bulk_requests(spark.range(3).coalesce(1).withColumn("t", F.lit("a")), "i", size=2).select("rows", "request")


@case("url VARCHAR, chunks VARCHAR, hash BOOLEAN", ("https://h.example/a", "Title|Title > A|Title > A > Deep", True), ("https://h.example/b", "Tables|Tables > C", True))
def chunk_file_cases(spark: SparkSession, d: str) -> DataFrame:
    """Pages to chunk files and back."""
    import uuid

    from stratalith.session import checkpoint_dir

    s = sections.html_sections(_pages(spark))
    texts, chunks = chunking.page_texts(s), chunking.chunk_sections(s)
    fetched = texts.select("url", F.lit("2024-01-01T00:00:00Z").alias("fetched_at"))
    path = f"{checkpoint_dir(spark)}/chunk-files-{uuid.uuid4().hex[:8]}"
    files.write_chunk_files(files.as_chunk_files(chunks, texts, fetched, {"max_tokens": 500, "target_tokens": 400, "overlap_tokens": 60, "version": 1}, 1.68), path)
    return files.read_chunk_files(spark, path).select("url", F.array_join(F.transform("chunks", lambda c: c["section"]), "|").alias("chunks"), (F.length("content_hash") == 64).alias("hash"))


def _box(spark: SparkSession, d: str) -> agent.Toolbox:
    chunks = spark.createDataFrame([(1, 1, 0, "Radar", "r", "noise floor of the radar"), (2, 2, 0, "Mode", None, "wide swath mode")], "id int, document_id int, chunk_index int, section string, anchor string, content string")
    pages = spark.createDataFrame([(1, "https://h.example/a"), (2, "https://h.example/b.pdf")], "id int, url string")
    scenes = spark.createDataFrame([("s1", "2024-05-01T00:00:00Z", "halcyon-3a", "IW", ["VV"], "ascending", 5, dt.datetime(2024, 5, 2)), ("s2", "2024-05-02T00:00:00Z", "halcyon-3c", "EW", ["HH"], "ascending", 7, dt.datetime(2024, 5, 3))], "id string, acquired string, platform string, mode string, polarisations array<string>, orbit string, relative_orbit int, ingested_at timestamp")
    return agent.Toolbox(chunks, pages, scenes, dt.date(2024, 5, 10))


@case("n INT, tool VARCHAR, forced BOOLEAN, summary VARCHAR", (1, "search_docs", True, "[1] Radar"), (2, "search_scenes", False, "Found: 2 newest scenes, 2 passes, 2 satellites, 2 days."), (3, "nope", False, "Error: unknown tool nope."), (4, "search_docs", False, "[2] Mode"), (5, "answer", False, "noise is [1]"))
def agent_loop_cases(spark: SparkSession, d: str) -> DataFrame:
    """An early answer leads to a forced search; then calls that work, an unknown tool, and the answer."""
    said = [{"content": "early"}, {"calls": [("search_scenes", {"days": 30}), ("nope", {}), ("search_docs", {"query": "wide mode"})]}, {"content": "noise is [1]"}]
    run = agent.run_agent("noise", lambda m, t: said.pop(0), _box(spark, d))
    rows = [(c["tool"], c["forced"], c["summary"]) for c in run.calls] + [("answer", False, run.answer)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "n int, tool string, forced boolean, summary string")


_CHECKS = ("handshake gives version and name", "ids are given back", "a notification has no answer", "both tools are listed", "tools have schemas", "a call gives text and structure", "an empty query is a tool's error", "a wrong date is a tool's error", "an unknown tool is refused", "an unknown argument is refused", "an unknown method is refused")


@case("name VARCHAR, passed BOOLEAN", *((c, True) for c in _CHECKS))
def protocol_cases(spark: SparkSession, d: str) -> DataFrame:
    box = _box(spark, d)
    return spark.createDataFrame(agent.protocol_check(lambda r: agent.serve_call(box, r)), "name string, passed boolean")


@case("report VARCHAR, line VARCHAR", ("index", "Pages: 1 new, 2 changed, 0 unchanged, 0 removed. Index: 3 pages, 9 chunks."), ("agent", "Failed:"), ("agent", "b   tools, passages, citations, answered"), ("agent", "c   arguments, place"), ("rows", "... and 2 more"))
def report_cases(spark: SparkSession, d: str) -> DataFrame:
    checked = _runs(spark)
    said = reports.agent(evaluation.check_rates(checked), checked, evaluation.CHECKS).split("\n")
    rows = [("index", reports.index({"new": 1, "changed": 2}, 3, 9)), *(("agent", x) for x in said[said.index("Failed:") :] if not x.startswith("id")), ("rows", reports.table(spark.range(3), 1).split("\n")[-1])]
    return spark.createDataFrame(rows, "report string, line string")


@case("name VARCHAR, kind VARCHAR, box VARCHAR", ("n", "t", "3.0 1.0 4.0 2.0"), ("m", "place", "0.0 -1.0 1.0 0.0"))
def geocode_cases(spark: SparkSession, d: str) -> DataFrame:
    """Lookup results with the box as text [south, north, west, east]."""
    found = [catalogues.place_of({"boundingbox": ["1", "2", "3", "4"], "display_name": "n", "type": "t"}), catalogues.place_of({"boundingbox": ["-1", "0", "0", "1"], "display_name": "m"})]
    return spark.createDataFrame([(p["name"], p["kind"], " ".join(map(str, p["bbox"]))) for p in found], "name string, kind string, box string")
