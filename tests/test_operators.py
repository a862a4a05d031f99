import datetime as dt
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalith.operators import answers, catalogue, chunking, evaluation, index, lexical, line_documents, retrieval, sections
from stratalith.plans.agent import Toolbox, run_agent, serve_call
from stratalith.session import cut_lineage, table
from stratalith.sources import catalogues, files, providers
from tests.conftest import SMALL

CHUNK = "id int, document_id int, chunk_index int, section string, anchor string, content string, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(
        [(1, 1, 0, "Radar", "r", "noise noise floor", [1.0, 0.0, 0.0]), (2, 1, 1, "Orbit", "", "orbit files and noise", [1.0, 1.0, 0.0]), (3, 2, 0, "Mode", None, "wide swath mode", [0.0, 0.0, 1.0]), (4, 2, 1, "Empty", None, "the of and", None), (5, 2, 2, "Zero", None, "zero", [0.0, 0.0, 0.0])],
        CHUNK,
    )


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(1, "https://h.example/a"), (2, "https://h.example/b.pdf")], "id int, url string")


def test_bm25_by_hand(spark, chunks):
    q = spark.createDataFrame([("q", "noise noise unknownword")], "id string, question string")
    got = {r.id: r.score for r in lexical.bm25_scores(chunks, q).collect()}
    lens = {1: 4, 2: 4, 3: 4, 4: 1, 5: 2}  # section and content without stop words
    avg = sum(lens.values()) / 5
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    for i, tf in ((1, 2), (2, 1)):
        assert got[i] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[i] / avg)), abs=1e-6)
    assert set(got) == {1, 2}
    none = spark.createDataFrame([("q", "the of"), ("r", None), ("s", "")], "id string, question string")
    assert lexical.bm25(chunks, none).count() == 0


def test_ranks_do_not_depend_on_ids(spark, chunks):
    q = spark.createDataFrame([("q", "noise orbit mode")], "id string, question string")
    a = [(r.section, r.score) for r in lexical.bm25(chunks, q).orderBy("rank").collect()]
    b = [(r.section, r.score) for r in lexical.bm25(chunks.withColumn("id", 100 - F.col("id")), q).orderBy("rank").collect()]
    assert a == b


def test_vector_search_skips_unusable_vectors(spark, chunks):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (9, [0.0, 0.0, 0.0]), (8, None)], "qid long, vec array<float>")
    got = [(r.id, r.score) for r in retrieval.vector(chunks, q).orderBy("rank").collect()]
    assert got == [(2, pytest.approx(0.292893)), (3, 1.0)]


def test_shared_ranks_and_fusion(spark, chunks):
    s = spark.createDataFrame([("q", 1, 5.0), ("q", 2, 4.0), ("q", 3, 4.0), ("q", 4, 3.0)], "qid string, id int, score double")
    ranked = retrieval.shared_ranks(s, ["qid"], False)
    assert {r.id: r.shared for r in ranked.collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    tenth = spark.createDataFrame([("q", 2, 10), ("q", 1, 1)], "qid string, id int, shared int")
    other = spark.createDataFrame([("q", 2, 10)], "qid string, id int, shared int")
    got = {r.id: r.score for r in retrieval.fuse([tenth, other], chunks).collect()}
    assert got[2] == pytest.approx(2 / 70) and got[1] == pytest.approx(1 / 61) and got[2] > got[1]


def test_requests_without_meaning():
    for a in ({"method": "x"}, {"method": "vector", "english": "e"}, {"method": "hybrid-native", "ranking": "frequency"}, {"method": "lexical", "k": 0}, {"method": "lexical", "ranking": "x"}):
        with pytest.raises(ValueError):
            retrieval.check_request(**a)


def test_relevance_takes_the_floor(spark):
    df = spark.createDataFrame([({"yes": -0.1, "no": -3.0},), ({"no": -1.0, "maybe": -9.0},), ({"yes": -0.5, "well": -7.0},)], "m map<string,double>")
    assert [round(r.r, 6) for r in df.select(retrieval.relevance(F.col("m")).alias("r")).collect()] == [2.9, -8.0, 6.5]


def test_rerank_with_a_provider(spark, chunks):
    q = spark.createDataFrame([("q", "noise")], "id string, question string")
    score = providers.scorer(q, chunks, lambda ps: [{"yes": -0.1, "no": -5.0} if "orbit" in p else {"yes": -5.0, "no": -0.1} for p in ps])
    got = [r.id for r in retrieval.retrieve(chunks, q, method="lexical", scorer=score).orderBy("rank").collect()]
    assert got == [2, 1]


def test_embedding_provider(spark, chunks):
    rows = chunks.select("id", "content")
    out = providers.embed(rows, "id", "content", lambda ts: [[float(len(t)), 1.0] for t in ts], 2, batch=2)
    assert {r.id: r.embedding[0] for r in out.collect()}[5] == 4.0
    with pytest.raises(Exception, match="vectors for"):
        providers.embed(rows, "id", "content", lambda ts: [[1.0]], 1, batch=5).collect()
    with pytest.raises(Exception, match="isn't of length"):
        providers.embed(rows, "id", "content", lambda ts: [[1.0]] * len(ts), 2).collect()
    assert providers.use_translation(None, "hybrid") and not providers.use_translation(None, "vector")
    with pytest.raises(ValueError):
        providers.use_translation(True, "vector")


PAGE = """<html><body><article id="content"><h1>Title [1]</h1><section class="article-body"><p>Lead <b>text</b> .</p>
<h2 id="a">A</h2><p>one<br>two</p><h4 id="d">Deep</h4><ul><li>x<ul><li>y</li></ul></li><li>z</ul>
<h3>B <button>Copy</button></h3><table><tr><th>h</th><td></td><td>v</td></tr><tr><td></td></tr></table><h2></h2><h2>C</h2>
<script>no</script><div>inline <i>only</i></div></section></article></body></html>"""


def test_html_sections():
    title, found = sections.read_html(PAGE)
    assert title == "Title"
    assert [(s.path, s.anchor, s.blocks) for s in found] == [
        (["Title"], None, ["Lead text."]),
        (["Title", "A"], "a", ["one two"]),
        (["Title", "A", "Deep"], "d", ["- x\n  - y\n- z"]),
        (["Title", "A", "B"], None, ["h | v"]),
        (["Title", "C"], None, ["inline only"]),
    ]
    with pytest.raises(sections.LayoutError):
        sections.read_html("<html><body><p>x</p></body></html>")
    assert sections.read_html("<h1>T</h1><p>x</p>", sections.Layout(None, None))[1][0].blocks == ["x"]


def test_html_text_keeps_words_apart():
    read = lambda body: [b for s in sections.read_html(f"<h1>T</h1>{body}", sections.ANY)[1] for b in s.blocks]
    assert read("<table><tr><td><p>One</p><p>Two</p></td></tr></table>") == ["One Two"]
    assert read("<ul><li><p>Red</p><p>Blue</p></li></ul>") == ["- Red Blue"]
    assert read("<p>a<copy-clipboard>copy me</copy-clipboard> b<i18n-message>m</i18n-message></p><!-- c -->") == ["a b"]
    assert read("<div class='x expand-control'><div>More <p>of it</p></div></div>") == ["More of it"]
    assert read("<div>loose <b>bold</b> text<p>block</p></div>") == ["loose", "bold", "text", "block"]


def test_pages_without_sections_are_named(spark):
    late = b"<html><head>" + b" " * 3000 + b"<meta charset='iso-8859-1'></head><body><h1>T</h1><p>caf\xe9</p></body></html>"
    pages = spark.createDataFrame([(1, "u", PAGE.encode()), (2, "u", b"%PDF-1.6"), (3, "u", None), (4, "u", b"<p>x</p>"), (5, "u", late), (6, "u", b"<article id='content'><section class='article-body'>x</section></article>"), (7, "u", b"<article id='content'><h1>t</h1></article>")], "page_id long, url string, content binary")
    assert {r.page_id: r.refused for r in sections.refused_pages(pages).collect()} == {2: "pdf", 3: "empty", 4: "no article", 5: "no article", 6: "no title", 7: "no body"}
    assert sections.html_sections(pages.where("page_id = 5"), sections.ANY).first().blocks == ["café"]


LINE = "page_id long, url string, title string, height double, page int, text string, top double, bottom double, x0 double, size double, cells array<array<string>>"


def line(page, text, top, size=10.0, x0=50.0, cells=None, doc=1):
    return (doc, "u", "Doc", 800.0, page, text, float(top), float(top) + 10, x0, float(size), cells)


MANUAL = [line(p, f"Manual v{p}", 5) for p in (1, 2, 3)] + [
    line(1, "Front matter text", 150), line(1, "1 Scope", 200, 14), line(1, "of the work", 212, 14), line(1, "Some prose that is syn-", 240), line(1, "thetic and goes on", 252),
    line(1, "synthetic words", 290), line(1, "N e a r R a n g e", 310), line(1, "• First item", 400), line(1, "wraps here", 412, x0=60.0), line(1, "• Inner item", 424, x0=70.0),
    line(2, "1.1 Detail", 200, 14), line(2, "", 300, cells=[["a", "", None], [None, None, None]]), line(2, "3 Not next", 400, 14), line(2, "2 Next ...... 9", 420, 14), line(3, "2 Next", 200, 14), line(3, "End text here.", 240),
]


def test_line_sections(spark):
    docs = spark.createDataFrame([*MANUAL, line(1, "no heading at all", 300, doc=2), line(1, None, 300, doc=2)], LINE).repartition(3)
    got = [(r.path, r.anchor, r.blocks) for r in line_documents.line_sections(docs).orderBy("position").collect()]
    assert got[0] == (["Doc", "1 Scope of the work"], "page=1", ["Some prose that is synthetic and goes on", "synthetic words", "- First item wraps here\n  - Inner item"])
    assert got[1] == (["Doc", "1 Scope of the work", "1.1 Detail"], "page=2", ["a | ", "3 Not next", "2 Next...... 9"])
    assert got[2] == (["Doc", "2 Next"], "page=3", ["End text here."]) and len(got) == 3
    assert line_documents.line_sections(docs.limit(0)).count() == 0


def test_paragraphs_over_pages_and_lists_of_lines(spark):
    rows = [line(1, "1 One", 200, 14), line(1, "A sentence that goes", 700), line(2, "on here and ends.", 150), line(2, "New one", 900, x0=50.0), line(2, "- Dash", 300), line(2, "o Round", 320), line(2, "under 10 pt", 332, x0=60.0), line(2, "Prose again", 344), line(2, "well-", 400), line(2, "Known words", 412)]
    got = line_documents.line_sections(spark.createDataFrame(rows, LINE)).first().blocks
    assert got == ["A sentence that goes on here and ends.", "- Dash\n- Round under 10 pt", "Prose again", "well-Known words", "New one"]


def test_numbers_that_follow(spark):
    cases = [([], [1], True), ([], [2], False), ([3, 2], [4], True), ([3, 2], [3, 3], True), ([3, 2], [3, 2, 1], True), ([3, 2], [3, 4], False), ([3], [100], True), ([100], [100], False), ([100], [101], True), ([3], [3, 2], False), ([1, 2], [2, 3], False)]
    df = spark.createDataFrame(cases, "l array<int>, n array<int>, y boolean")
    assert df.where(line_documents.may_follow(F.col("l"), F.col("n")) != F.col("y")).collect() == []


def test_pages_to_chunk_files_and_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://h.example/p", PAGE.encode()), (2, "https://h.example/f.pdf", b"%PDF-1.6 x"), (3, "u", None)], "page_id long, url string, content binary")
    s = sections.html_sections(pages)
    chunks = chunking.chunk_sections(s)
    assert [r.chunk_index for r in chunks.orderBy("chunk_index").collect()] == [0, 1, 2, 3, 4]
    texts = chunking.page_texts(s)
    assert texts.first().text.startswith("Title\nLead text.\nTitle > A\none two")
    fetched = spark.createDataFrame([("https://h.example/p", "2024-01-01T00:00:00Z")], "url string, fetched_at string")
    out = files.as_chunk_files(chunks, texts, fetched, {"max_tokens": 500, "target_tokens": 400, "overlap_tokens": 60, "version": 1}, 1.68)
    files.write_chunk_files(out, str(tmp_path / "c"))
    assert files.read_chunk_files(spark, str(tmp_path / "c")).first().chunks[2].anchor == "d"
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="ingest first"):
        files.read_chunk_files(spark, str(tmp_path / "none"))


def test_incremental_index(spark):
    kind = "url string, content_hash string, index_config string"
    old = spark.createDataFrame([("same", "h", "c"), ("text", "h", "c"), ("recipe", "h", "c"), ("gone", "h", "c"), ("null", None, "c")], kind)
    new = spark.createDataFrame([("same", "h", "c"), ("text", "x", "c"), ("recipe", "h", "d"), ("new", "h", "c"), ("null", None, "c")], kind)
    assert {r.url: r.state for r in index.changes(old, new).collect()} == {"same": "unchanged", "text": "changed", "recipe": "changed", "gone": "removed", "new": "new", "null": "unchanged"}
    chunks = spark.createDataFrame([("same", 0), ("text", 0), ("text", 1), ("gone", 0)], "url string, n int")
    fresh = spark.createDataFrame([("text", 9)], "url string, n int")
    assert sorted(map(tuple, index.replace_pages(chunks, fresh, index.removed(old, new)).collect())) == [("same", 0), ("text", 9)]
    ids = spark.range(2500)
    hashed = spark.range(3000).select(F.xxhash64("id").alias("id"))
    index.check_in_step(hashed, hashed.orderBy("id"))
    assert index.fingerprint(hashed).first().n == 3000 and index.fingerprint(hashed).first() != index.fingerprint(hashed.where("id > 0")).first()
    index.check_in_step(ids, ids.repartition(7))
    with pytest.raises(RuntimeError, match="stale"):
        index.check_in_step(ids, ids.where("id <> 77"))
    assert index.fingerprint(ids.limit(0)).first().n == 0


def test_metrics(spark):
    f = spark.createDataFrame([("a", "blind", "es", 1, "x"), ("b", "blind", "en", 4, "x"), ("c", "text", "en", None, "y")], "qid string, written string, lang string, first int, answer_in string")
    m = evaluation.metrics(f).first()
    assert (m.hit_1, m.hit_3, m.hit_5, m.mrr) == (pytest.approx(0.333333), pytest.approx(0.333333), pytest.approx(0.666667), pytest.approx(0.416667))
    g = {(r.dimension, r.value): r.questions for r in evaluation.grouped_metrics(f).collect()}
    assert g[("all", "all")] == 3 and g[("lang", "en")] == 2 and g[("answer_in", "y")] == 1
    assert [r.qid for r in evaluation.misses(f, 3).orderBy("qid").collect()] == ["b", "c"]


def test_label_check(spark, chunks, documents):
    kind = "id string, written string, lang string, relevant array<struct<section:string,url:string>>"
    ok = spark.createDataFrame([("a", "w", "en", [("Radar", "https://h.example/a"), ("Mode", "https://h.example/b.pdf")])], kind)
    evaluation.check_labels(ok, chunks, documents)
    assert evaluation.answer_in(ok).first().answer_in == "wiki+pdf"
    with pytest.raises(ValueError):
        evaluation.check_labels(spark.createDataFrame([("a", "w", "en", [("No", "u")])], kind), chunks, documents)


def test_agent_checks(spark):
    r = spark.createDataFrame([("t", True, None), ("t", False, True), ("h", True, True)], "set string, tools boolean, place boolean")
    got = {(x.group, x.check): (x.passed, x.of, x.rate) for x in evaluation.check_rates(r, ("tools", "place")).collect()}
    assert got[("all", "tools")] == (2, 3, 0.667) and got[("all", "pass")] == (2, 3, 0.667) and got[("t", "place")] == (1, 1, 1.0)
    none = spark.createDataFrame([("t", None)], "set string, tools boolean")
    assert {x.check: x.rate for x in evaluation.check_rates(none, ("tools",)).collect()}["tools"] is None
    v = spark.createDataFrame([(None, []), ("a", ["a", "b"]), ("c", ["a"]), (None, ["a"]), ("a", None)], "v string, a array<string>")
    assert [x.y for x in v.select(evaluation.accepted(F.col("v"), F.col("a")).alias("y")).collect()] == [True, True, False, False, False]


def test_catalogue(spark):
    raw = spark.createDataFrame([("a", "2024-01-02T23:59:59Z", "HALCYON 3A", "IW", ["VV", None, "VH"], "ascending", 5, dt.datetime(2024, 1, 3)), ("a", "2024-01-02T23:59:59Z", "halcyon-3a", "IW", None, None, None, dt.datetime(2024, 1, 4)), ("b", "2024-01-01T00:00:00+00:00", "halcyon-3c", "EW", None, None, None, dt.datetime(2024, 1, 3)), (None, "x", None, None, None, None, None, None)], "id string, acquired string, platform string, mode string, polarisations array<string>, orbit string, relative_orbit int, ingested_at timestamp")
    s = catalogue.normalise(raw.where("id is not null"))
    assert s.count() == 2 and s.where("id = 'a'").first().platform == "halcyon-3a"
    assert [r.id for r in catalogue.search(s, "2024-01-02", "2024-01-02").collect()] == ["a"]
    assert [r.id for r in catalogue.search(s, limit=1).collect()] == ["a", "b"]
    assert catalogue.search(s, mode="EW", orbit=None).count() == 1
    with pytest.raises(ValueError):
        catalogue.check_filters(mode="XX")
    today = dt.date(2024, 5, 10)
    assert catalogue.resolve_days(today, 7) == ("2024-05-03", "2024-05-10") == catalogue.resolve_days(today, "7", "2020-01-01")
    assert catalogue.resolve_days(today, start="2024-05-01") == ("2024-05-01", "2024-05-10")
    for bad in ({"days": "x"}, {"end": "2024-01-01"}, {"start": "2024-13-01"}, {"start": "2024-06-01", "end": "2024-05-01"}):
        with pytest.raises(ValueError):
            catalogue.resolve_days(today, **bad)
    tiny, seen = catalogue.Place("Hut", "house", 10.0, 50.0, 10.004, 50.003), set()
    with pytest.raises(catalogue.SmallPlace):
        catalogue.guard_place(tiny, seen)
    catalogue.guard_place(tiny, seen)
    catalogue.guard_place(tiny, set(), confirm=True)


def test_catalogue_source(spark, tmp_path):
    p = tmp_path / "items.json"
    p.write_text(json.dumps({"features": [{"id": f"s{i}", "properties": {"datetime": f"2024-01-0{i}T00:00:00Z", "mode": "IW" if i % 2 else "EW", "orbit": None, "relative_orbit": i}} for i in range(1, 6)]}))
    catalogues.register(spark)
    read = lambda **o: [r.id for r in spark.read.format("catalogue").options(path=str(p), **o).load().collect()]
    assert read(mode="IW", start="2024-01-02") == ["s5", "s3"]
    assert read(limit=2) == ["s5", "s4"] and len(read()) == 5 and read(end="2024-01-02") == ["s2", "s1"]
    body = catalogues.search_request("grd", [1, 2, 3, 4], "2024-01-01", "2024-01-02", 10, mode="IW", orbit="ascending")
    assert body["limit"] == 11 and body["datetime"] == "2024-01-01T00:00:00Z/2024-01-02T23:59:59Z" and body["filter"]["op"] == "and"


def test_page_fetcher():
    answers_ = {"https://a.example/robots.txt": (200, b"User-agent: *\nDisallow: /no"), "https://a.example/x": (200, b"ok"), "https://b.example/robots.txt": (403, b""), "https://c.example/robots.txt": (404, b""), "https://c.example/y": (200, b"y"), "https://d.example/robots.txt": (503, b"")}
    now, slept = [0.0], []
    pace = catalogues.Pace(clock=lambda: now[0], sleep=slept.append)
    fetch = catalogues.page_fetcher(lambda u: answers_[u], "bot", pace)
    assert fetch("https://a.example/x") == b"ok" and fetch("https://c.example/y") == b"y"
    for u, e in (("https://a.example/no/1", PermissionError), ("https://b.example/z", PermissionError), ("https://d.example/z", RuntimeError)):
        with pytest.raises(e):
            fetch(u)
    assert len(slept) == pace.passed - 1 and all(s == 1.0 for s in slept)


def test_places(spark):
    cache = spark.createDataFrame([("la strasse", "here"), ("nowhere", None)], "key string, place string")
    asked = spark.createDataFrame([(" La  Straße ",), ("nowhere",), ("new",)], "name string")
    assert {r.name.strip(): (r.known, r.place) for r in catalogues.places(asked, cache).collect()} == {"La  Straße": (True, "here"), "nowhere": (True, None), "new": (False, None)}
    assert catalogues.place_of({"boundingbox": ["1", "2", "3", "4"], "display_name": "n", "type": "t"}) == {"name": "n", "kind": "t", "bbox": [3.0, 1.0, 4.0, 2.0]}
    assert catalogues.place_of(None) is None


def test_cached_pages_and_lists(spark, tmp_path):
    (tmp_path / "a.body").write_bytes(b"x")
    (tmp_path / "a.json").write_text('{"url": "u", "fetched_at": "t"}')
    (tmp_path / "b.body").write_bytes(b"broken")
    assert [r.url for r in files.cached_pages(spark, str(tmp_path)).collect()] == ["u"]
    (tmp_path / "s.yaml").write_text("pages:\n- u1\npdfs:\n- {url: u2, title: T}\n")
    assert [tuple(r) for r in files.source_list(spark, str(tmp_path / "s.yaml")).collect()] == [("u1", None), ("u2", "T")]
    (tmp_path / "q.yaml").write_text("- {id: q, written: w, lang: en, question: Q, relevant: [{section: s, url: u}]}\n")
    assert files.question_list(spark, str(tmp_path / "q.yaml")).first().relevant[0].section == "s"


def test_bulk(spark):
    out = files.bulk_requests(spark.range(250).coalesce(1), "i", size=100).collect()
    assert sum(r.rows for r in out) == 250 and max(r.rows for r in out) == 100
    assert json.loads(out[0].request.split("\n")[0])["index"]["_index"] == "i"
    with pytest.raises(RuntimeError):
        files.check_bulk_response({"items": [{"index": {"_id": 1, "error": "e"}}]})
    files.check_bulk_response({"items": [{"index": {"_id": 1}}]})


def test_answers(spark):
    p = spark.createDataFrame([("q", 1, "S", "u", "c1"), ("q", 2, "S", "u", "c2"), ("q", 3, "T", "v", "c3")], "qid string, n int, section string, url string, content string")
    assert answers.context(p).first().context == "[1] S\nc1\n\n[2] S\nc2\n\n[3] T\nc3"
    c = answers.citations(spark.createDataFrame([("q", "x [3] y [1, 2] z [7]"), ("r", None)], "qid string, answer string"), p)
    assert sorted((r.n, r.url) for r in c.collect() if r.url) == [(1, "u"), (2, "u"), (3, "v")] and c.where("url is null").count() == 1
    assert [(r.section, r.numbers) for r in answers.sources(c).orderBy("first").collect()] == [("S", "1, 2"), ("T", "3")]
    calls = spark.createDataFrame([("s", 1, 1, 10), ("s", 1, 2, 20), ("s", 2, 1, 20), ("s", 2, 2, 30)], "session string, call int, rank int, id int")
    assert {r.id: r.number for r in answers.number_passages(calls).collect()} == {10: 1, 20: 2, 30: 3}


def test_agent(spark, chunks, documents):
    box = Toolbox(chunks, documents, table(spark, SMALL, "scenes"), dt.date(2023, 3, 1))
    said = [{"content": "early answer"}, {"calls": [("search_scenes", {"days": 60}), ("nope", {}), ("search_scenes", {"mode": "XX", "days": 1})]}, {"content": "noise is [1]"}]
    run = run_agent("noise", lambda m, t: said.pop(0), box)
    assert run.answer == "noise is [1]" and run.turns == 3
    assert [c["forced"] for c in run.calls] == [True, False, False, False]
    assert run.calls[2]["summary"].startswith("Error: unknown tool") and run.calls[3]["summary"].startswith("Error: mode")
    assert box.call("search_docs", {"query": "noise orbit"}).startswith("Already shown") or "[3]" in box.call("search_docs", {"query": "mode"})
    assert run_agent("x", lambda m, t: {"calls": [("search_docs", {"query": "mode"})]}, box, 2).turns == 2
    assert serve_call(box, {"id": 1, "method": "tools/call", "params": {"name": "x"}})["error"]["code"] == -32602
    assert not serve_call(box, {"id": 1, "method": "tools/call", "params": {"name": "search_docs", "arguments": {"query": "noise"}}})["result"]["isError"]
    assert serve_call(box, {"id": 1, "method": "tools/list"})["result"]["tools"]


def test_glyphs_to_lines(spark):
    g = lambda t, x, top, up=True: (1, 1, t, float(x), x + 5.0, float(top), top + 10.0, 10.0, up)
    glyphs = spark.createDataFrame([g("A", 10, 100), g("b", 15, 100), g("c", 25, 101), g("V", 400, 50, False), g("t", 110, 205), g("z", 10, 300), g("(cid:3)", 10, 400)], "page_id long, page int, text string, x0 double, x1 double, top double, bottom double, size double, upright boolean")
    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    b = lambda *x: tuple(map(float, x))
    boxes = [[b(100, 200, 200, 220), b(200, 200, 300, 220)], [b(100, 220, 200, 260), b(200, 220, 300, 240)], [None, b(200, 240, 300, 260)]]
    grids = spark.createDataFrame([(1, 1, 100.0, 200.0, 300.0, 260.0, [["h", ""], ["m", "x(cid:12)"], [None, ""]], boxes)], f"page_id long, page int, x0 double, top double, x1 double, bottom double, text array<array<string>>, boxes array<array<{box}>>")
    got = [(r.text, r.cells) for r in line_documents.glyph_lines(glyphs, grids).orderBy("top").collect()]
    assert got == [("Ab c", None), ("", [["h", None], ["m", "x"], ["m", None]]), ("z", None)]


def test_agent_check_columns(spark):
    kind = "expected_tools array<string>, called_tools array<string>, arguments map<string,string>, allowed map<string,array<string>>, lon double, lat double, box array<double>, passages array<string>, relevant array<string>, answer string, cited array<int>, answerable boolean"
    r = spark.createDataFrame([(["a"], ["a", "a"], {"m": "IW"}, {"m": ["IW", "EW"], "o": []}, 5.0, 5.0, [0.0, 0.0, 5.0, 5.0], ["p", "q"], ["q"], "yes", [1, 2], True), (["a"], [], None, None, None, None, None, ["p"], ["q"], " ", [3], True), (["a"], ["a"], {}, {"m": ["IW"]}, 9.0, 5.0, [0.0, 0.0, 5.0, 5.0], None, None, None, None, False)], kind)
    got = [tuple(x) for x in evaluation.agent_checks(r).select(*evaluation.CHECKS).collect()]
    assert got == [(True, True, True, True, True, True), (False, None, None, False, False, False), (True, False, False, None, None, None)]
    rates = {(x.group, x.check): (x.passed, x.of) for x in evaluation.check_rates(evaluation.agent_checks(r.withColumn("set", F.lit("s")))).collect()}
    assert rates[("all", "tools_ok")] == (2, 3) and rates[("s", "arguments_ok")] == (1, 2) and rates[("all", "pass")] == (1, 3)


def test_build_and_update(spark, tmp_path):
    from stratalith.plans import build, reports

    def pages(*bodies):
        return spark.createDataFrame([(i, f"https://h.example/{i}", PAGE.replace("Lead", b).encode(), "2024-01-01") for i, b in enumerate(bodies) if b], "page_id long, url string, content binary, fetched_at string")

    calls = []
    provider = lambda ts: [[float(len(t)), 1.0] for t in ts]
    out = str(tmp_path / "ix")
    run = lambda p, d="d": build.build(p, out, provider, 2, "m", d)
    assert run(pages("one", "two", "three")) == {"new": 3}
    assert run(pages("one", "two", "three")) == {"unchanged": 3}
    assert run(pages("one", "TWO", "")) == {"unchanged": 1, "changed": 1, "removed": 1}
    chunks = build._read(spark, out, "chunks")
    assert chunks.groupBy("url").count().count() == 2 and chunks.count() == 10
    assert run(pages("one", "TWO"), "other") == {"changed": 2}
    build.check_derived(spark, out)
    q = spark.createDataFrame([("q", "deep inline two")], "id string, question string")
    stored = [(r.rank, r.id, r.score) for r in build.search(spark, out, q).orderBy("rank").collect()]
    assert stored and stored == [(r.rank, r.id, r.score) for r in lexical.bm25(chunks, q).orderBy("rank").collect()]
    assert build._read(spark, out, "frequencies").where("lexeme = 'two'").first().df >= 1
    assert "2 changed" in reports.index({"changed": 2}, 2, 10) and not calls
    stats = chunking.ingest_statistics(chunks)
    assert "10 chunks" in reports.ingest(stats, chunking.size_summary(chunks, F.length("content")))


def test_protocol(spark, chunks, documents):
    from stratalith.plans.agent import protocol_check, serve

    box = Toolbox(chunks, documents, table(spark, SMALL, "scenes"), dt.date(2023, 3, 1))
    checks = protocol_check(lambda r: serve_call(box, r))
    assert len(checks) == 11 and all(ok for _, ok in checks), checks
    out = []
    serve(box, ['{"jsonrpc": "2.0", "id": 1, "method": "ping"}\n', "\n", "no json\n", '{"method": "x"}\n', "[]\n"], out.append)
    assert [json.loads(x).get("error", {}).get("code") for x in out] == [None, -32700, -32600]


def test_scene_tool_with_place_and_product(spark, chunks, documents):
    scenes = table(spark, SMALL, "scenes").withColumn("product", F.lit(catalogue.PRODUCTS[0])).withColumns({c: F.lit(v) for c, v in (("west", 0.0), ("south", 0.0), ("east", 1.0), ("north", 1.0))})
    places = {"Hut": catalogue.Place("Hut", "house", 0.1, 0.1, 0.104, 0.103), "Far": catalogue.Place("Far", "city", 50.0, 50.0, 51.0, 51.0)}
    box = Toolbox(chunks, documents, scenes, dt.date(2026, 3, 1), geocode=places.get)
    assert box.call("search_scenes", {"days": 4000, "place": "Nowhere"}) == "Error: no place is called Nowhere"
    assert "below 1 km" in box.call("search_scenes", {"days": 4000, "place": "Hut"})
    assert box.call("search_scenes", {"days": 4000, "place": "Hut", "product": catalogue.PRODUCTS[0]}).startswith("Found over Hut") and box.structured["scenes"]
    assert box.call("search_scenes", {"days": 4000, "place": "Far"}) == "No scenes found." and box.call("search_scenes", {"days": 4000, "product": "x"}).startswith("Error: product")


def test_search_docs_by_both_halves_and_reranker(spark, chunks, documents):
    box = Toolbox(chunks, documents, table(spark, SMALL, "scenes"), dt.date(2023, 3, 1), embed=lambda ts: [[0.0, 0.0, 1.0]] * len(ts), scorer=lambda q, c: providers.scorer(q, c, lambda ps: [{"yes": -0.1, "no": -5.0} if "wide" in p else {"yes": -5.0, "no": -0.1} for p in ps]))
    assert box.call("search_docs", {"query": "noise"}).startswith("[1] Mode")
    assert box.structured["passages"][0]["url"] == "https://h.example/b.pdf"


def test_write_through_caches(spark, tmp_path):
    asked = []
    fetch = lambda u: asked.append(u) or b"body"
    get = lambda **k: files.fetch_page("https://h.example/x", str(tmp_path / "c"), fetch, lambda: "t", **k)
    assert get() == (b"body", "t", False) and get() == (b"body", "t", True) and get(refresh=True)[2] is False and len(asked) == 2
    assert files.cached_pages(spark, str(tmp_path / "c")).first().url == "https://h.example/x"
    looked = []
    cache = catalogues.PlaceCache(str(tmp_path / "p.json"), lambda n: looked.append(n))
    assert cache("No  Where") is None and cache("no where") is None and looked == ["No  Where"]
    again = catalogues.PlaceCache(str(tmp_path / "p.json"), lambda n: 1 / 0)
    assert again("NO WHERE") is None


def test_models_translation_and_backend(spark, chunks):
    assert providers.model_digest("m", [{"name": "x", "digest": "1"}, {"name": "m:latest", "digest": "2"}]) == "2"
    with pytest.raises(ValueError):
        providers.model_digest("m", [])
    q = spark.createDataFrame([("a", "es", "ruido"), ("b", "en", "noise"), ("c", "de", "x"), ("d", "fr", None)], "id string, lang string, question string")
    t = providers.translate(q, lambda ts: [f' "{x} in English" ' if x != "x" else " " for x in ts])
    assert {r.id: r.question for r in providers.translated(q, t).collect()} == {"a": "ruido in English", "b": "noise", "c": "x", "d": None}
    assert retrieval.check_backend("tables", "hybrid", chunks, None) is chunks and retrieval.check_backend("engine", "hybrid-native", chunks, chunks) is chunks
    for bad in (("engine", "hybrid", chunks, None), ("engine", "hybrid", chunks, chunks.where("id > 1"))):
        with pytest.raises(RuntimeError):
            retrieval.check_backend(*bad)
    for bad in (("x", "hybrid"), ("tables", "hybrid-native")):
        with pytest.raises(ValueError):
            retrieval.check_backend(*bad, chunks, chunks)


def test_agent_report_and_long_tables(spark):
    from stratalith.plans import cases, reports

    checked = evaluation.agent_checks(spark.createDataFrame(cases.RUNS, cases.RUN))
    said = reports.agent(evaluation.check_rates(checked), checked, evaluation.CHECKS)
    assert "b   tools, passages, citations, answered" in said and "c   arguments, place" in said
    assert reports.table(spark.range(30), 10).endswith("... and 20 more")


def test_approximate_search_has_recall_and_fills_up(spark):
    c = table(spark, SMALL, "chunks")
    q = c.where("id % 10 = 0").select(F.col("id").cast("long").alias("qid"), F.col("embedding").alias("vec"))
    exact = retrieval.vector(c, q)
    assert retrieval.recall(retrieval.lsh_neighbours(c, q), exact).first().recall >= 0.9
    near = retrieval.lsh_neighbours(c, q, reach=0.01)
    assert near.count() == exact.count() and retrieval.recall(near, exact).first().recall == 1.0


def test_tables_of_a_database(spark):
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).selectExpr("cast(id as int) as id", "concat('u', id) as url").write.format("jdbc").options(url="jdbc:derby:memory:pages;create=true", dbtable="documents", **options).mode("overwrite").save()
    pages = files.read_jdbc(spark, "jdbc:derby:memory:pages", "documents", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4", **options)
    some = pages.where("id > 90")
    assert some.count() == 9 and pages.rdd.getNumPartitions() == 4
    assert "GreaterThan(ID,90)" in some._jdf.queryExecution().toString() or "GreaterThan(id,90)" in some._jdf.queryExecution().toString()


def test_best_of_many_questions_without_their_pairs(spark):
    """The best chunks of a task stay, other pairs of questions and chunks never leave it; blocks of questions add up."""
    c = table(spark, SMALL, "chunks").repartition(3)
    q = table(spark, SMALL, "eval_questions")
    every = lexical.bm25_scores(c, q)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lexical, "BLOCK", 100)
        best = cut_lineage(lexical.bm25_best(c, q, 5))
    rows = lambda df: {(r.qid, r.id, r.score) for r in lexical.first_cut(df, 5).collect()}
    assert rows(best) == rows(every)
    assert best.count() < every.count() / 3
    assert lexical.bm25_best(c, q.where("false"), 5).count() == 0


def test_slabs():
    b = pa.RecordBatch.from_pydict({"a": [1, 2]})
    assert [t.num_rows for t in lexical.slabs(iter([b] * 5), 3)] == [4, 4, 2] and not list(lexical.slabs(iter([]), 3))


@pytest.mark.parametrize("bucket", [0.6, 0.02])
def test_approximate_search_by_wide_and_narrow_buckets(spark, bucket):
    """Only pairs that share a bucket are compared; only what may be among a query's k leaves a task."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    x[600:] = x[:300] + rng.normal(scale=0.02, size=(300, 8))
    unit, planes = x / np.linalg.norm(x, axis=1)[:, None], rng.normal(size=(8, 3))
    hashes = lambda v: np.floor(v @ planes / bucket)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = retrieval.vector_scores(c, c.where("id < 300").select(F.col("id").alias("qid"), F.col("embedding").alias("vec")), 4, hashes=hashes, reach=0.7)
    h, d = hashes(unit), 1 - unit @ unit.T
    held = (h[:300, None] == h[None]).any(-1) & (d[:300] < 0.245) & ~np.eye(300, 900, dtype=bool)
    want = {(i, int(j)) for i in range(300) for j in sorted(np.flatnonzero(held[i]), key=lambda j, i=i: d[i, j])[:4]}
    assert {(r.qid, r.id) for r in lexical.first_cut(got, 4, ascending=True).collect()} == want
    assert got.count() <= 300 * 4 * got.rdd.getNumPartitions() and 0 < held.sum() < 300 * 899


def test_recall_of_a_search_that_keeps_the_nearest_alone(spark, monkeypatch):
    """What is written between the hashing and the ranking are the k nearest with ties, not the proposed pairs."""
    kept, cut = [], retrieval.cut_lineage
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    c = table(spark, SMALL, "chunks")
    q = c.where("id % 10 = 0").select(F.col("id").cast("long").alias("qid"), F.col("embedding").alias("vec"))
    assert retrieval.recall(retrieval.lsh_neighbours(c, q), retrieval.vector(c, q)).first().recall == 1.0
    assert 0 < sum(x.count() for x in kept if "score" in x.columns) < 2 * retrieval.TOP_K * q.count()


def test_native_hybrid_in_blocks_of_questions(spark, monkeypatch):
    """Both halves in several blocks, no list of all pairs, positions as ranks."""
    c = table(spark, SMALL, "chunks").withColumn("id", F.col("id").cast("long"))
    asked = c.where("id % 50 = 0")
    q, v = asked.select("id", F.col("section").alias("question")), asked.select(F.col("id").alias("qid"), F.col("embedding").alias("vec"))
    want = retrieval.fuse([lexical.bm25(c, q, 40), retrieval.vector(c, v, 40)], c, shared=False).collect()
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(lexical, "bm25_scores", None)
    assert sorted(retrieval.hybrid(c, q, v, native=True).collect()) == sorted(want) and want


def test_rows_let_out_follow_the_questions_not_the_scan(spark, monkeypatch):
    """Batches of a task are cut together, and small partitions of a table are not tasks of their own."""
    c = table(spark, SMALL, "chunks").withColumn("id", F.col("id").cast("long"))
    q, v = table(spark, SMALL, "eval_questions"), c.select(F.col("id").alias("qid"), F.col("embedding").alias("vec"))
    halves = (lambda x: lexical.bm25_best(x, q, 3)), (lambda x: retrieval.vector_scores(x, v, 3))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = [rows(lexical.first_cut(f(c), 3, ascending=i == 1)) for i, f in enumerate(halves)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(lexical, "SLAB", 7)
        monkeypatch.setattr(lexical, "slabs", lambda batches, f=lexical.slabs: f(batches, 7))
        assert [rows(f(c.coalesce(1))) for f in halves] == want and all(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [f(c.repartition(60)).rdd.getNumPartitions() for f in halves] == [lexical.TASKS, lexical.TASKS]


def test_best_gives_back_ties_that_are_too_many_to_hold(monkeypatch):
    monkeypatch.setattr(lexical, "HELD", 100_000)
    best, n, got = lexical.Best(2, 3), 150_000, []
    for value in (1.0, 1.0, 0.5, 0.5, 2.0):
        got += best.add(np.arange(n) % 3, pa.array(np.arange(n)), np.full(n, value))
    early = sum(len(q) for q, _, _ in got)
    got += best.rest()
    assert early > 0 and not list(best.rest()) and best.bound.tolist() == [0.5] * 3
    assert sum(np.count_nonzero(value == 0.5) for _, _, value in got) == 2 * n and all((value < 2).all() for _, _, value in got)


@pytest.mark.parametrize("reach", [0.1, np.inf])
def test_distances_are_worked_out_for_near_pairs_alone(reach, monkeypatch):
    """Queries that find no k rows within reach are no reason to look at all pairs again; results are those of all pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[10:20] = x[0] + rng.normal(scale=0.01, size=(10, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(x.tolist())], names=["id", "v"])
    calls, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *more, **by: calls.append(a.size) or partition(a, *more, **by))
    run = retrieval._nearest_batches(np.arange(40), x[:40], 5, True, (lambda v: np.zeros((len(v), 1))) if reach < 2 else None, reach)
    got = [r for out in run(iter([b.slice(0, 2500), b.slice(2500)])) for r in zip(*out.to_pydict().values(), strict=True)]
    d = np.round(1 - x[:40] @ x.T, 6)
    d[np.arange(40), np.arange(40)] = np.inf
    d[d >= reach**2 / 2] = np.inf
    kth = np.minimum(np.sort(d, axis=1)[:, 4], 3)
    assert sorted(got) == [(i, j, pytest.approx(d[i, j])) for i, j in zip(*np.nonzero(d <= kth[:, None]), strict=True)] and got
    assert len(calls) == (reach > 2)
