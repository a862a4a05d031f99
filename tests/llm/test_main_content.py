import random

from stratalith.llm import main_content as mc

NAV = "<nav><ul>\n" + "\n".join(f'<li><a href="/{i}">Entry {i}</a>' for i in range(5)) + "\n</ul></nav>"
FOOT = "<footer>\n<p>Imprint and contact</p>\n<p>&copy; {y} h.example</p>\n</footer>"


def page(seed, remarks=True):
    r = random.Random(seed)
    words = "orbit noise radar swath phase tile mask burst delta queue".split()
    sentence = lambda: " ".join(r.choice(words) for _ in range(14)).capitalize() + f" {r.randrange(9999)}."
    body = [f"<h1>{r.choice(words)} {r.choice(words)} {seed}</h1>", f"<span class=d>2024-0{r.randrange(1, 9)}-11</span>", f"<p>{sentence()}\n{sentence()}</p>", "<p>Share this section</p>" if seed % 2 else "", f"<table>\n<tr><td>{sentence()}</td><td>7</td></tr>\n</table>", f"<h2>{r.choice(words)} {r.choice(words)} {r.choice(words)} <button>Copy</button></h2>", f'<ul>\n<li><a href="/x">{sentence()}</a>\n<li>{sentence()}\n</ul>', f'<div class="footer-notes">\n<p><sup>1</sup> {sentence()}</p>\n</div>']
    if remarks:
        body.append(f'<div class="c-1">\n<p>{sentence()}</p>\n<p>{"posted 3 days ago" if seed % 3 else "Log in to comment"}</p>\n</div>')
    body.append(f'<div class="c-2">\n<p><a href="/y">{sentence()}</a></p>\n</div>')
    main = "\n".join(x for x in body if x)
    text = f"<html><head><title>T {seed}</title><script>\nvar x = '<p>';\n</script></head>\n<body>\n{NAV}\n<div class=\"main\">\n{main}\n</div>\n<!-- {sentence()} -->\n{FOOT.format(y=2000 + seed % 20)}\n</body></html>"
    want = set()
    off = text[: text.index('<div class="main">')].count("\n") + 2
    skip = False
    for n, line in enumerate(main.split("\n")):
        skip = skip or line.startswith('<div class="c-')
        if not skip and line not in ("<table>", "</table>", "<ul>", "</ul>", "</div>", '<div class="footer-notes">') and not line.startswith(("<span", "<p>Share")):
            want.add(off + n)
        skip = skip and line != "</div>"
    return text, want


KIND = "page_id long, url string, content binary, host string, path string, digest string"


def test_wrappers_find_the_body(spark):
    rows, want = [], set()
    for i in range(30):
        text, lines = page(i)
        rows.append((i, f"https://h.example/{i}", text.encode(), "x", "y", "z"))
        want |= {(i, n) for n in lines}
    again, lines = page(3)
    rows += [(100, "https://h.example/3", again.encode(), None, None, None), (101, "https://h.example/pdf", b"%PDF-1.6 text", None, None, None), (102, None, None, None, None, None), (103, "https://h.example/e", b"", None, None, None), (None, "https://h.example/n", again.encode(), None, None, None)]
    want |= {(100, n) for n in lines}
    rows.append((104, "https://h.example/wall", f"<html><body>\n{NAV}\n<h1>403</h1>\n<p>Denied</p>\n{FOOT.format(y=2001)}\n</body></html>".encode(), None, None, None))
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = {(r.page_id, r.line_no) for r in mc.main_lines(df).collect()}
    assert got == want
    assert mc.main_lines(df.limit(0)).count() == 0
    rep = mc.wrapper_report(df).where("host = 'h.example'").first()
    assert rep.pages == 32 and "footer" in rep.expression and "?" in rep.expression


def tokens(*tree):
    """(path, numbers, text) tokens of (tag, text or children) trees."""
    out, n = [], [0]

    def walk(nodes, path, numbers):
        for x in nodes:
            if isinstance(x, str):
                out.append((path, numbers, x))
            else:
                n[0] += 1
                walk(x[1:], (*path, x[0]), (*numbers, n[0]))

    walk(tree, (), ())
    return out


def aligned(*pages):
    w = mc.Wrapper()
    for k, p in enumerate(pages):
        w.align(tokens(*p), k)
    return w


def test_alignment_resolves_mismatches():
    site = lambda *rest: [("div", ("h1", "Site"), *rest)]
    w = aligned(site(("p", "a"), ("p", "b")), site(("span", "x"), ("p", "c")), site(("p", "d")))
    assert w.expression() == "div(h1('Site') span(#text)? p(#text)+)"
    one, two = aligned(site(("p", "a"), ("p", "b"))), mc.Wrapper()
    two.align(tokens(*site(("span", "x"), ("p", "c"))), 1)
    two.align(tokens(*site(("p", "d"))), 2)
    two.merge(one)
    assert two.expression() == w.expression() and two.pages == 3


def test_alignment_folds_what_pages_disagree_on():
    a, b, c = ("a", "1"), ("b", "2"), ("c", "3")
    assert aligned([a, b], [b, a]).expression() == "(a(#text)? b(#text)?)+"
    assert aligned([a, b, a, c], [a, c]).expression() == "(a(#text)? b(#text)?)+ c(#text)"
    assert aligned([("ul", ("li", "x"), ("li", "y"))], [("ul", ("li", "z"))]).expression() == "ul(li(#text)+)"
    assert aligned(["lead", ("b", "x"), "tail"], ["lead", "tail"]).expression() == "(#text? b(#text)?)+"
    assert aligned([c], [a], [a, c], [b, c]).expression() in ("a(#text)? b(#text)? c('3')?", "b(#text)? a(#text)? c('3')?")
    pages = [[a, ("x", b, c)], [("x", c), a], [("x", b), ("x", c, c)], [a]]
    orders = [aligned(*(pages[i] for i in order)).expression() for order in ((0, 1, 2, 3), (3, 1, 0, 2), (2, 3, 1, 0))]
    assert len(set(orders)) == 1


def test_groups_equal_mutual_reach():
    rng = random.Random(6)
    for _ in range(200):
        kinds = [f"k{i}" for i in range(rng.randrange(1, 9))]
        w = mc.Wrapper()
        w.next[()] = {(rng.choice(kinds), rng.choice(kinds)): 1 for _ in range(rng.randrange(0, 14))}
        reach = {k: {k} for k in kinds}
        for _ in kinds:
            for a, b in w.next[()]:
                for k in kinds:
                    if a in reach[k]:
                        reach[k].add(b)
        groups = w.sequence((), kinds)
        assert sorted(k for g in groups for k in g) == sorted(kinds)
        at = {k: n for n, g in enumerate(groups) for k in g}
        for a in kinds:
            for b in kinds:
                assert (at[a] == at[b]) == (b in reach[a] and a in reach[b])
                assert b not in reach[a] or at[a] <= at[b]


def test_text_that_no_page_varies_is_no_slot(spark):
    # Quantities agree by their masks alone, so counts of texts can't tell this one: only that it stands in every page.
    words = "orbit noise radar swath phase tile mask burst delta queue".split()
    rows, want = [], set()
    for k in range(12):
        r = random.Random(k)
        prose = [" ".join(r.choice(words) for _ in range(25)).capitalize() + "." for _ in range(3)]
        lines = ["<html><body>", '<div class="main">', f"<h1>{' '.join(r.choice(words) for _ in range(5))} {k}</h1>", "<h5>12.5 dB</h5>", *(f"<p>{x}</p>" for x in prose), f"<h6>{r.randrange(100, 999)}.5 m</h6>", "</div>", "</body></html>"]
        rows.append((k, f"https://q.example/{k}", "\n".join(lines).encode(), "x", "y", "z"))
        want |= {(k, n) for n in (3, 5, 6, 7, 8)}
    got = {(r.page_id, r.line_no) for r in mc.main_lines(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    assert got == want


def test_articles_directly_under_the_body(spark):
    words = "orbit noise radar swath phase tile mask burst delta queue".split()
    rows, want = [], set()
    for k in range(12):
        r = random.Random(k)
        lines = ["<html><body>", f"<h1>{' '.join(r.choice(words) for _ in range(5))} {k}</h1>", *(f"<p>{' '.join(r.choice(words) for _ in range(25))}.</p>" for _ in range(3)), "<p>Imprint and contact</p>", "</body></html>"]
        rows.append((k, f"https://b.example/{k}", "\n".join(lines).encode(), "x", "y", "z"))
        want |= {(k, n) for n in (2, 3, 4, 5)}
    assert {(r.page_id, r.line_no) for r in mc.main_lines(spark.createDataFrame(rows, KIND).repartition(3)).collect()} == want


def test_late_markup_and_charset():
    late = b" " * 5000 + b"<html><head>" + b" " * 3000 + b"<meta http-equiv=x content='text/html; charset=iso-8859-1'></head><p>caf\xe9</p>"
    assert mc.decode(late).endswith("café</p>")
    assert mc.decode(b"<p>charset=utf-16</p>") == "<p>charset=utf-16</p>"


def test_decoding_and_tokens():
    assert mc.decode("<meta charset=iso-8859-1><p>é</p>".encode("latin-1")).endswith("é</p>")
    assert mc.decode(b"<p>\xff</p>") == "<p>ÿ</p>" and mc.decode(None) is None and mc.decode(b"plain") is None
    got = list(mc.pieces("<body><p>a <b>b</b>\n\n&nbsp;\nc<p>d<ul><li>x<li>y</ul><script>\n<p>no\n</script>\n<p>e"))
    assert [(p[-1], t, n) for p, _, t, n, _ in got] == [("p", "a b c", [1, 4]), ("p", "d", [4]), ("li", "x", [4]), ("li", "y", [4]), ("p", "e", [7])]
    assert not mc.can_be_fixed("CAL-0") and not mc.can_be_fixed("0.0 s") and mc.can_be_fixed("0-0-0") and mc.can_be_fixed("posted 0 days ago")


def test_copies_of_an_article_keep_its_text(spark):
    words = "orbit noise radar swath phase tile mask burst delta queue".split()

    def article(seed, site):
        r = random.Random(seed)
        prose = [" ".join(r.choice(words) for _ in range(30)).capitalize() + "." for _ in range(5)]
        head = f"<html><body>\n{NAV}\n<div class=\"main\">\n"
        body = [f"<h1>{' '.join(r.choice(words) for _ in range(6))} {seed}</h1>", *(f"<p>{x}</p>" for x in prose)]
        text = head + "\n".join(body) + f"\n<p>Share this page of {site} with others</p>\n</div>\n{FOOT.format(y=2001)}\n</body></html>"
        return text.encode(), [head.count("\n") + 1 + k for k in range(len(body))]

    pages = [(f"https://{h}.example/{k}", article(1000 * n + k, h)) for n, h in enumerate("abc") for k in range(12)]
    pages += [(f"https://{h}.example/shared{x}", article(9999, h)) for h, x in (("a", ""), ("a", "?print=1"), ("a", "?from=mail"), ("b", ""), ("c", ""))]
    df = spark.createDataFrame([(i, url, data, "x", "y", "z") for i, (url, (data, _)) in enumerate(pages)], KIND).repartition(4)
    got = {(r.page_id, r.line_no) for r in mc.main_lines(df).collect()}
    assert got == {(i, n) for i, (_, (_, lines)) in enumerate(pages) for n in lines}
