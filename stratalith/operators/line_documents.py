"""Paginated documents: characters to lines, and lines to sections, as plans over rows.

Lines are (page_id, url, title, height, page, text, top, bottom, x0, size, cells); cells is set where the line is a
table. A section opens at a numbered heading in larger type; text before the first is left out. Which line continues
which is a flag over the line before it, a block is a running sum of such flags, and the only order-dependent choice,
whether a number may follow the last heading's, is a fold over the few candidates of a document.

Null texts count as empty lines. Repeated lines are lines. Documents without a heading have no sections. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.text import clean, is_debris, margin_key, section_number

# Patterns of numbered headings, dot leaders, bullets and glyphs without a letter.
HEADING = r"^(\d{1,2}(?:\.\d{1,2}){0,4}|[A-H](?:\d{1,2}(?:\.\d{1,2}){0,3})?)\.?\s+(\S.*)$"
LEADER = r"\.{4,}|…{2,}"
BULLET = r"^(?:[•▪◦●■-]|[o\-–](?=\s+[A-Z]))\s*"
UNMAPPED = r"\(cid:\d+\)"
# Margin of a page, share of pages that repeat a margin line, gap of a paragraph and of a list in line
# heights, points of a heading above the body's, points by which a heading's lines may differ, columns of bullets.
MARGIN, REPEATED, GAP, LIST_GAP, POINTS, ALIKE, COLUMN, APPENDIX, LEVELS = 0.15, 0.5, 0.5, 1.5, 0.5, 0.3, 2.0, 100, 6
LINE = ("page_id", "url", "title", "height", "page", "text", "top", "bottom", "x0", "size", "cells")


def in_margin() -> Column:
    return (F.col("top") < MARGIN * F.col("height")) | (F.col("bottom") > (1 - MARGIN) * F.col("height"))


def margin_keys(lines: DataFrame) -> DataFrame:
    """(page_id, key): margin lines, numbers as #, that half of a document's pages repeat, three at least."""
    pages = lines.groupBy("page_id").agg(F.count_distinct("page").alias("pages"))
    seen = lines.where(F.col("cells").isNull() & in_margin()).select("page_id", "page", margin_key(F.col("text")).alias("key")).distinct()
    counts = seen.groupBy("page_id", "key").agg(F.count("*").alias("n")).join(pages, "page_id")
    return counts.where(F.col("n") >= F.greatest(F.lit(3), REPEATED * F.col("pages"))).select("page_id", "key")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(page_id, body): the size, in half points, most of a document's text is set in; of equal ones the smaller."""
    sizes = lines.where(F.col("cells").isNull()).groupBy("page_id", (F.bround(F.col("size") * 2) / 2).alias("half")).agg(F.sum(F.length("text")).alias("n"))
    return sizes.groupBy("page_id").agg((-F.max(F.struct("n", (-F.col("half")).alias("m")))["m"]).alias("body"))


def document_words(lines: DataFrame) -> DataFrame:
    """(page_id, word): the words of a document, those of its tables included."""
    cells = F.coalesce(F.array_join(F.flatten("cells"), " "), F.lit(""))
    both = F.lower(F.concat(F.col("text"), F.lit(" "), cells))
    return lines.select("page_id", F.explode(F.regexp_extract_all(both, F.lit("([a-z]+)"), 1)).alias("word")).distinct()


def may_follow(last: Column, number: Column) -> Column:
    """Whether a section number may come after the last one: its first child, the next one on an open level, or the
    first appendix; the first of all is 1."""
    depth = F.size(number)
    parents = F.slice(number, 1, depth - 1) == F.slice(last, 1, depth - 1)
    child = (depth == F.size(last) + 1) & parents & (F.element_at(number, -1) == 1)
    following = (depth <= F.size(last)) & parents & (F.element_at(number, -1) == F.try_element_at(last, depth) + 1)
    appendix = (number == F.array(F.lit(APPENDIX))) & (F.try_element_at(last, F.lit(1)) < APPENDIX)
    return F.when(F.size(last) == 0, number == F.array(F.lit(1))).otherwise(F.coalesce(child | following | appendix, F.lit(False)))


def headings(candidates: DataFrame) -> DataFrame:
    """(page_id, heads): the positions of the candidates (page_id, pos, number) whose numbers follow each other."""
    start = F.struct(F.array().cast("array<int>").alias("last"), F.array().cast("array<int>").alias("heads"))
    take = lambda s, c: F.when(may_follow(s["last"], c["number"]), F.struct(c["number"].alias("last"), F.concat(s["heads"], F.array(c["pos"])).alias("heads"))).otherwise(s)
    found = candidates.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("c"))
    return found.select("page_id", F.aggregate("c", start, take)["heads"].alias("heads"))


def apart(gap: float, before: Column) -> Column:
    """Whether a line begins a new paragraph after the line before it: by the gap on a page; across pages unless the
    sentence goes on."""
    b = before
    ends, goes_on = F.trim(b["text"]).rlike("[.:;!?]$"), F.trim("text").rlike(r"^\p{Ll}")
    return b.isNull() | b["table"] | F.when(b["page"] != F.col("page"), ends | ~goes_on).otherwise(F.col("top") - b["bottom"] > gap * (b["bottom"] - b["top"]))


def spliced(lines: Column, known) -> Column:
    """The texts of lines as one; a hyphen between two goes when ``known`` says so of (text so far, next line)."""
    hyphen = lambda s, x: s.rlike("[A-Za-z]-$") & x.rlike(r"^[\p{L}\p{N}]")
    step = lambda s, x: F.when(hyphen(s, x), F.concat(F.when(known(s, x), F.regexp_replace(s, "-$", "")).otherwise(s), x)).otherwise(F.trim(F.concat_ws(" ", s, x)))
    return F.aggregate(F.transform(lines, lambda x: F.trim(x)), F.lit(""), step)


def _in_words(words: Column):
    head, tail = (lambda s: F.regexp_extract(s, "([A-Za-z]+)-$", 1)), (lambda x: F.regexp_extract(x, "^([A-Za-z]+)", 1))
    return lambda s, x: (tail(x) != "") & F.array_contains(words, F.lower(F.concat(head(s), tail(x))))


def depths(columns: Column) -> Column:
    """The depth of each bullet of a list: the rank of its column among those seen so far."""
    place = lambda seen, x: F.size(F.filter(seen, lambda c: c < x - COLUMN))
    fresh = lambda seen, x: ~F.exists(seen, lambda c: F.abs(c - x) <= COLUMN)
    start = F.struct(F.array().cast("array<double>").alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        seen = F.when(fresh(s["seen"], x), F.concat(s["seen"], F.array(x))).otherwise(s["seen"])
        return F.struct(seen.alias("seen"), F.concat(s["out"], F.array(place(seen, x))).alias("out"))

    return F.aggregate(columns, start, step)["out"]


def _marked(lines: DataFrame) -> DataFrame:
    """The lines that are kept, in order (pos), with heading flags."""
    lines = lines.select(*LINE).where("page_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    keys = margin_keys(lines).withColumn("repeated", F.lit(True))
    kept = lines.withColumn("key", F.when(F.col("cells").isNull() & in_margin(), margin_key(F.col("text")))).join(keys, ["page_id", "key"], "left")
    kept = kept.where(F.col("cells").isNotNull() | (F.col("repeated").isNull() & ~is_debris(F.col("text"))))
    order = Window.partitionBy("page_id").orderBy("page", "top", "x0", "text")
    kept = kept.withColumn("pos", F.row_number().over(order)).join(body_sizes(lines), "page_id", "left")
    number = section_number(F.regexp_extract(F.trim("text"), HEADING, 1))
    open_to = F.col("cells").isNull() & (F.col("size") >= F.col("body") + POINTS) & ~F.col("text").rlike(LEADER) & number.isNotNull()
    heads = headings(kept.where(open_to).select("page_id", "pos", number.alias("number")))
    kept = kept.join(heads, "page_id", "left").withColumn("head", F.coalesce(F.array_contains("heads", F.col("pos")), F.lit(False)))
    w = Window.partitionBy("page_id").orderBy("pos")
    line = F.struct("page", "top", "bottom", "text", F.col("cells").isNotNull().alias("table"))
    kept = kept.withColumn("before", F.lag(line).over(w)).withColumn("section", F.sum(F.col("head").cast("int")).over(w)).where("section > 0")
    # A heading goes on in lines of its size without a gap.
    alike = F.col("cells").isNull() & (F.abs(F.col("size") - F.last(F.when(F.col("head"), F.col("size")), True).over(w)) <= ALIKE) & ~apart(GAP, F.col("before"))
    kept = kept.withColumn("run", F.sum((F.col("head") | ~alike).cast("int")).over(w))
    return kept.withColumn("heading", F.first("head").over(Window.partitionBy("page_id", "run").orderBy("pos"))).drop("heads", "key", "repeated")


def _paths(marked: DataFrame) -> DataFrame:
    """(page_id, section, path, anchor): the title and the headings open at each heading."""
    first = F.min_by("text", "pos")
    number = F.regexp_extract(F.trim(first), HEADING, 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t")))), lambda x: x["t"])
    own = F.concat(number, F.lit(" "), F.regexp_extract(F.trim(first), HEADING, 2))
    rest = F.array_join(F.concat(F.array(own), F.slice(texts, 2, F.size(texts))), " ")
    h = marked.where("heading").groupBy("page_id", "section").agg(rest.alias("t"), F.size(section_number(number)).alias("depth"), F.min("page").alias("page"), F.first("title").alias("title"), F.first("url").alias("url"))
    w = Window.partitionBy("page_id").orderBy("section")
    last = [F.last(F.when(F.col("depth") == k, F.struct("section", "t", "depth")), True).over(w) for k in range(1, LEVELS)]
    h = h.withColumn("levels", F.array(*last))
    # Open is what no heading of a lower level has followed.
    is_open = lambda x: x.isNotNull() & (x["depth"] <= F.col("depth")) & ~F.exists("levels", lambda y: y.isNotNull() & (y["depth"] < x["depth"]) & (y["section"] > x["section"]))
    path = F.concat(F.array("title"), F.transform(F.filter("levels", is_open), lambda x: x["t"]))
    return h.select("page_id", "url", "title", "section", path.alias("path"), F.concat(F.lit("page="), F.col("page")).alias("anchor"))


def _text_blocks(marked: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, section, at, out): paragraphs and lists, with the position of their first line."""
    w = Window.partitionBy("page_id").orderBy("pos")
    b = marked.withColumn("line", F.trim("text")).withColumn("bullet", F.col("cells").isNull() & ~F.col("heading") & F.col("line").rlike(BULLET))
    indented = F.col("x0") > F.last(F.when(F.col("bullet"), F.col("x0")), True).over(w) + COLUMN
    wraps = F.col("cells").isNull() & ~F.col("heading") & ~F.col("bullet") & ~apart(GAP, F.col("before")) & F.coalesce(indented, F.lit(False))
    b = b.withColumn("wraps", wraps).withColumn("run", F.sum((~F.col("wraps")).cast("int")).over(w))
    b = b.withColumn("wraps", F.col("wraps") & F.first("bullet").over(Window.partitionBy("page_id", "run").orderBy("pos")))
    role = F.when(F.col("heading"), "heading").when(F.col("cells").isNotNull(), "table").when(F.col("bullet") | F.col("wraps"), "list").otherwise("prose")
    b = b.withColumn("role", role).withColumn("role_before", F.lag("role").over(w))
    opens = (F.col("role") != F.coalesce("role_before", F.lit(""))) | F.col("role").isin("heading", "table") | (F.col("bullet") & apart(LIST_GAP, F.col("before"))) | ((F.col("role") == "prose") & apart(GAP, F.col("before")))
    b = b.withColumn("block", F.sum(opens.cast("int")).over(w)).withColumn("item", F.sum(F.col("bullet").cast("int")).over(w))
    b = b.where(F.col("role").isin("list", "prose")).withColumn("line", F.when(F.col("bullet"), F.regexp_replace("line", BULLET, "")).otherwise(F.col("line")))
    # Words cut at a line's end are looked up in the document's words, one row a cut.
    part = Window.partitionBy("page_id", "block", "item").orderBy("pos")
    tail = F.regexp_extract("line", "^([A-Za-z]+)", 1)
    cut = F.when(tail != "", F.lower(F.concat(F.regexp_extract(F.lag("line").over(part), "([A-Za-z]+)-$", 1), tail)))
    b = b.withColumn("word", cut).join(words.withColumn("known", F.lit(True)), ["page_id", "word"], "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", "line", F.coalesce("known", F.lit(False)).alias("known"))))
    items = b.groupBy("page_id", "section", "block", "item").agg(listed.alias("ls"), F.first("role").alias("role"), F.min_by("x0", "pos").alias("x0"), F.min("pos").alias("at"))
    # A known cut is marked by taking the hyphen off the line before it, so the fold joins without a space.
    joined = F.transform("ls", lambda x, i: F.when(F.coalesce(F.get("ls", i + 1)["known"], F.lit(False)), F.regexp_replace(x["line"], "-$", "\x00")).otherwise(x["line"]))
    text = F.regexp_replace(spliced(joined, lambda s, x: F.lit(False)), "\x00 ?", "")
    items = items.select("page_id", "section", "block", "item", "role", "x0", "at", clean(text).alias("t"))
    blocks = items.groupBy("page_id", "section", "block").agg(F.min("at").alias("at"), F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("item", "x0", "t"))).alias("i"))
    deep = F.transform(F.arrays_zip(F.col("i").alias("i"), depths(F.transform("i", lambda x: x["x0"])).alias("d")), lambda z: F.concat(F.repeat(F.lit("  "), z["d"]), F.lit("- "), z["i"]["t"]))
    out = F.when(F.col("role") == "list", F.array_join(deep, "\n")).otherwise(F.col("i")[0]["t"])
    return blocks.select("page_id", "section", "at", out.alias("out"))


def table_text(cells: Column, words: Column) -> Column:
    """A table as lines: cells joined by " | ", empty ones kept, nulls and empty rows dropped."""
    rows = F.transform(cells, lambda r: F.transform(F.filter(r, lambda c: c.isNotNull()), lambda c: clean(spliced(F.split(c, "\n"), _in_words(words)))))
    return F.array_join(F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")


def line_sections(lines: DataFrame) -> DataFrame:
    """(page_id, url, title, position, path, anchor, blocks) of documents given as line rows."""
    marked, words = _marked(lines), document_words(lines.select("page_id", F.coalesce("text", F.lit("")).alias("text"), "cells").where("page_id is not null"))
    own = words.groupBy("page_id").agg(F.collect_set("word").alias("words"))
    tables = marked.where("cells is not null and not heading").join(own, "page_id", "left").select("page_id", "section", F.col("pos").alias("at"), table_text(F.col("cells"), F.coalesce("words", F.array().cast("array<string>"))).alias("out"))
    blocks = _text_blocks(marked, words).unionByName(tables).where("out <> ''")
    found = blocks.groupBy("page_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]).alias("blocks"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("section")) - 1
    return found.join(_paths(marked), ["page_id", "section"]).select("page_id", "url", "title", n.cast("int").alias("position"), "path", "anchor", "blocks")


def glyph_lines(glyphs: DataFrame, grids: DataFrame, near: float = 3.0, space: float = 0.2) -> DataFrame:
    """Lines (page_id, page, text, top, bottom, x0, size, cells) of pages given by characters and tables.

    glyphs: (page_id, page, text, x0, x1, top, bottom, size, upright); rotated ones are left out, and those whose centre
    lies in a table are the table's. grids: (page_id, page, x0, top, x1, bottom, text ARRAY<ARRAY<STRING>>, boxes
    ARRAY<ARRAY<STRUCT<x0, top, x1, bottom>>>, null where a cell is merged over); a table is one line with cells.
    """
    boxes = grids.select("page_id", "page", F.struct("x0", "top", "x1", "bottom").alias("g"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    loose = glyphs.where("upright and page_id is not null and text is not null").alias("c").join(
        boxes.alias("t"), (F.col("c.page_id") == F.col("t.page_id")) & (F.col("c.page") == F.col("t.page")) & x.between(F.col("g.x0"), F.col("g.x1")) & y.between(F.col("g.top"), F.col("g.bottom")), "left_anti"
    )
    page = Window.partitionBy("page_id", "page").orderBy("top", "x0")
    rows = loose.withColumn("row", F.sum((F.col("top") - F.coalesce(F.lag("top").over(page), F.lit(-1e9)) > near).cast("int")).over(page))
    row = Window.partitionBy("page_id", "page", "row").orderBy("x0")
    blank = lambda c: F.trim(c) == ""
    gap = (F.col("x0") - F.lag("x1").over(row) > space * F.lag("size").over(row)) & ~blank(F.col("text")) & ~blank(F.lag("text").over(row))
    rows = rows.withColumn("shown", F.concat(F.when(gap, " ").otherwise(""), F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "shown"))), lambda s: s["shown"]), "")
    lines = rows.groupBy("page_id", "page", "row").agg(F.trim(F.regexp_replace(text, UNMAPPED, "")).alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("size").alias("size"))
    lines = lines.where("text <> ''").select("page_id", "page", "text", "top", "bottom", "x0", "size", F.lit(None).cast("array<array<string>>").alias("cells"))
    return lines.unionByName(grid_lines(grids))


def grid_lines(grids: DataFrame) -> DataFrame:
    """Tables as lines with cells: what is merged down is repeated in each row whose middle it reaches, what is merged
    across stands once, and an empty cell is kept only in a column that the first row names."""
    key = ["page_id", "page", "top", "x0", "bottom"]
    g = grids.where("page_id is not null").select(*key, "boxes", F.transform("text", lambda r: F.transform(r, lambda c: F.regexp_replace(c, UNMAPPED, ""))).alias("t"))
    g = g.select(*key, F.element_at("t", 1).alias("names"), F.posexplode(F.arrays_zip("t", "boxes")).alias("r", "z"))
    own = F.filter("z.boxes", lambda b: b.isNotNull())
    g = g.withColumn("middle", (F.array_min(F.transform(own, lambda b: b["top"])) + F.array_max(F.transform(own, lambda b: b["bottom"]))) / 2)
    c = g.select(*key, "r", "middle", "names", F.posexplode(F.arrays_zip(F.col("z.t").alias("v"), F.col("z.boxes").alias("b"))).alias("c", "x"))
    up = Window.partitionBy(*key, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    over = F.last(F.when(F.col("x.b").isNotNull(), F.col("x")), True).over(up)
    named = (F.col("r") > 0) & (F.coalesce(F.get("names", F.col("c")), F.lit("")) != "")
    value = F.when(F.col("x.b").isNotNull(), F.when((F.coalesce(F.col("x.v"), F.lit("")) != "") | named, F.col("x.v"))).when((over["b"]["top"] < F.col("middle")) & (F.col("middle") < over["b"]["bottom"]), over["v"])
    cells = c.select(*key, "r", "c", value.alias("v")).groupBy(*key, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("cells"))
    out = cells.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda s: s["cells"]).alias("cells"))
    return out.select("page_id", "page", F.lit("").alias("text"), "top", "bottom", "x0", F.lit(0.0).alias("size"), "cells")
