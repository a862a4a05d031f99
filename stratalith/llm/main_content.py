"""Main content of web pages by wrapper inference over the pages of a host.

A wrapper is a union-free regular expression over a site's tag and text tokens: fixed text, slots (#text), optional
elements (?), repeated ones (+) and repeated groups of optional ones ((a? b?)+). It is inferred by aligning the token
streams of a host's pages, parent by parent:

- a text mismatch makes a slot;
- a tag mismatch makes an element optional, placed between its neighbours;
- an element that recurs makes it repeated; where others stand between, or pages disagree on the order, what lies
  between is folded into one repeated group. So every kind of element has one place in its parent's expression, and a
  page's stretch of text lies in exactly one slot.

What the alignment needs of a page are the neighbours of each element in its parent: two kinds are in one group if each
can be reached from the other over such neighbourhoods. They can be counted in any order, so wrappers of parts of a
host are merged by adding up, and the result is the same. Elements are told apart by tag and the attributes that
layout hangs on (class, role, width, id of containers).

1. One scan decodes and tokenises every page (declared charset; unclosed elements are closed by rule), aligns the
   pages of a host inside its task, and gives out one row per stretch of text with its slot, its lines and a digest of
   the text with digits masked. Page bytes are never shuffled, and texts and paths only as hashes.
2. Partial wrappers of a host are merged, first in salted groups, then whole.
3. A value that fills a slot on a good share of a host's pages is a variant of the template; one that does so on
   several hosts is one of the web. Counts are over distinct addresses, so pages fetched again don't count twice, and
   addresses with the same prose (of ``least_copy`` characters or more; walls have less) count once.
4. Per host the element of the expression that holds the slot of the titles and most of the open slots' text is the
   body. Groups inside it are left out when their slots hold mostly links, or when variants of the template mark them
   (remarks of readers, sharing, notices); one that every page has once needs twice the marks of an optional or
   repeated one. Text that no page varies is no slot and left out.
5. Lines of the body's slots that aren't variants of the template are the result.

Null contents, PDF and other non-HTML files have no lines; a page without the host's body (walls, errors) has none
either. Pages fetched again are all reported. A host with one page is judged by constants of the web and link share.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.session import cut_lineage

TOKEN = re.compile(r"<!--.*?-->|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
CHARSET = re.compile(rb"<(?:meta|\?xml)[^>]*?(?:charset|encoding)\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
DIGITS = re.compile(r"\d+")
VOID = frozenset("br img hr input meta link area base col embed source track wbr".split())
SILENT = frozenset("script style noscript svg template button select textarea iframe head title".split())
INLINE = frozenset("a b i em strong u s sup sub small code abbr cite q mark time kbd var tt label big".split())
CONTAINER = frozenset("div section article main aside nav footer header table tbody tr td font center form".split())
LAYOUT = frozenset({"class", "role", "width", "id"})
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key is closed by the start of one of these.
CLOSED_BY = {"li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "p": {"p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "aside", "figure"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements that stop the search for one to close.
SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"td", "li", "div", "article", "section", "main", "body"}}


def decode(data: bytes | None) -> str | None:
    """A page's text by its declared charset, else UTF-8, else Latin-1; None if it isn't HTML."""
    if not data or data[:5] == b"%PDF-" or b"<" not in data:
        return None
    m = CHARSET.search(data)
    for name in (m[1].decode("ascii", "ignore") if m else "utf-8", "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def _signature(tag: str, attributes: str) -> str:
    if not attributes or tag in HEADING or tag in INLINE:
        return tag
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip() for m in ATTRIBUTE.finditer(attributes)}
    keep = [f"{k}={found[k]}" for k in sorted(found) if k in LAYOUT and not (k == "id" and tag not in CONTAINER)]
    return f"{tag}[{' '.join(keep)}]" if keep else tag


Stretch = tuple[tuple[str, ...], tuple[int, ...], str, list[int], bool]


def pieces(page: str) -> Iterator[Stretch]:
    """Stretches of text between block tags: (path of signatures, numbers of these elements, text, lines that show
    text, mostly inside links)."""
    stack: list[tuple[str, str, int]] = []  # tag, signature, number
    opened = 0
    inline: list[str] = []
    texts: list[str] = []
    lines: list[int] = []
    linked = strong = 0
    line, silent = 1, None

    def flush() -> Iterator[Stretch]:
        nonlocal linked, strong
        text = " ".join(texts)
        place, numbers = tuple([s for _, s, _ in stack]), tuple([n for _, _, n in stack])
        if strong * 2 > len(text):
            place, numbers = (*place, "strong"), (*numbers, -line)
        yield place, numbers, text, list(dict.fromkeys(lines)), linked * 10 >= 9 * len(text)
        texts.clear()
        lines.clear()
        linked = strong = 0

    for m in TOKEN.finditer(page):
        token, tag = m[0], m[2]
        if tag is None:
            if silent is None and token[0] != "<" and not token.isspace():
                for k, part in enumerate(token.split("\n")):
                    shown = html.unescape(part) if "&" in part else part
                    if shown and not shown.isspace():
                        shown = shown.strip()
                        texts.append(shown)
                        lines.append(line + k)
                        linked += len(shown) * ("a" in inline)
                        strong += len(shown) * ("strong" in inline)
            line += token.count("\n")
            continue
        line += token.count("\n")
        tag, closing = tag.lower(), bool(m[1])
        if silent is not None:
            if closing and tag == silent:
                silent = None
            continue
        if tag in SILENT:
            if not closing and not token.endswith("/>"):
                silent = tag
            continue
        if tag in INLINE or tag == "span" and not closing and "class" not in (m[3] or ""):
            if not closing:
                inline.append(tag)
            elif tag in inline:
                inline.remove(tag)
            continue
        if tag in VOID:
            if texts and tag in ("br", "hr"):
                yield from flush()
            continue
        if closing:
            if tag == "span" and "span" in inline:
                inline.remove("span")
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if texts:
                        yield from flush()
                    del stack[k:]
                    inline.clear()
                    break
            continue
        if texts:
            yield from flush()
        for k in range(len(stack) - 1, -1, -1):  # close what this start ends
            held = stack[k][0]
            if tag in CLOSED_BY.get(held, ()):
                del stack[k:]
                break
            if tag in SCOPE and held in SCOPE[tag] or held in ("body", "html"):
                break
        opened += 1
        stack.append((tag, _signature(tag, m[3] or ""), opened))
        inline.clear()
    if texts:
        yield from flush()


#: The token of a stretch of text among an element's children.
TEXT = "#"
#: Pages of different articles that a text must be the same on to be fixed.
FIXED = 3


class Wrapper:
    """Inferred expression of a site, as counts that add up over its pages: see the module's text."""

    def __init__(self) -> None:
        self.pages = 0
        self.times: dict[tuple[str, ...], int] = {}  # instances of the node
        self.seen: dict[tuple[str, ...], int] = {}  # pages that have it
        self.sites: dict[str, int] = {}  # pages that have the kind anywhere
        self.held: dict[tuple[str, ...], int] = {}  # instances of its parent that have it
        self.most: dict[tuple[str, ...], int] = {}  # most of it in one parent
        self.next: dict[tuple[str, ...], dict[tuple[str, str], int]] = {}  # neighbours among a node's children
        self.text: dict[tuple[str, ...], tuple[str | None, frozenset[int]]] = {}  # the agreed text, and articles it is of

    def align(self, found: list[tuple[tuple[str, ...], tuple[int, ...], str]], article: int = 0) -> None:
        """Aligns one page, given as its (path, element numbers, text) tokens in document order.

        article: tells pages of different articles apart.
        """
        self.pages += 1
        children: dict[int, tuple[tuple[str, ...], list[str]]] = {0: ((), [])}
        nodes = set()
        before: tuple[int, ...] = ()
        own = frozenset((article,))
        for path, numbers, text in found:
            shared = 0  # elements that are open since the stretch before
            for x, y in zip(before, numbers, strict=False):
                if x != y:
                    break
                shared += 1
            parent = numbers[shared - 1] if shared else 0
            for depth in range(shared, len(path)):
                held = children.get(parent)
                if held is None:
                    held = children[parent] = (path[:depth], [])
                held[1].append(path[depth])
                node = path[: depth + 1]
                self.times[node] = self.times.get(node, 0) + 1
                nodes.add(node)
                parent = numbers[depth]
            held = children.get(parent)
            if held is None:
                held = children[parent] = (path, [])
            held[1].append(TEXT)
            before = numbers
            self._put(path, text, own)
        for node in nodes:
            self.seen[node] = self.seen.get(node, 0) + 1
        for kind in {k for k, *_ in (node[::-1] for node in nodes)}:
            self.sites[kind] = self.sites.get(kind, 0) + 1
        for parent_path, kinds in children.values():
            for kind in set(kinds):
                node = (*parent_path, kind)
                self.held[node] = self.held.get(node, 0) + 1
                self.most[node] = max(self.most.get(node, 0), kinds.count(kind))
            edges = self.next.setdefault(parent_path, {})
            for pair in zip(kinds, kinds[1:], strict=False):
                edges[pair] = edges.get(pair, 0) + 1

    def _put(self, path: tuple[str, ...], text: str | None, articles: frozenset[int]) -> None:
        own, known = self.text.get(path, (text, frozenset()))
        if own is None and len(known) >= FIXED:
            return
        self.text[path] = (own if own == text else None, frozenset(sorted(known | articles)[:FIXED]))

    def merge(self, other: Wrapper) -> None:
        """Aligns the pages of another wrapper of the same site with this one's."""
        self.pages += other.pages
        for mine, theirs in ((self.times, other.times), (self.seen, other.seen), (self.held, other.held), (self.sites, other.sites)):
            for node, n in theirs.items():
                mine[node] = mine.get(node, 0) + n
        for node, n in other.most.items():
            self.most[node] = max(self.most.get(node, 0), n)
        for parent, edges in other.next.items():
            own = self.next.setdefault(parent, {})
            for pair, n in edges.items():
                own[pair] = own.get(pair, 0) + n
        for path, (text, articles) in other.text.items():
            self._put(path, text, articles)

    def is_slot(self, path: tuple[str, ...]) -> bool:
        """Whether texts differ there, or too few articles agree to call it fixed."""
        text, articles = self.text[path]
        return text is None or len(articles) < FIXED

    def kinds(self) -> dict[tuple[str, ...], list[str]]:
        """The kinds of children of every node."""
        out: dict[tuple[str, ...], list[str]] = {}
        for node in self.held:
            out.setdefault(node[:-1], []).append(node[-1])
        return out

    def sequence(self, parent: tuple[str, ...], kinds: list[str]) -> list[list[str]]:
        """The children of a node in order, each in a list of its own, or with those it forms a repeated group with.

        Groups are the strongly connected components of the neighbourhoods, found in one walk; it leaves them in the
        reverse of their order.
        """
        after: dict[str, list[str]] = {k: [] for k in kinds}
        for a, b in sorted(self.next.get(parent, ()), reverse=True):
            after[a].append(b)
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        held: list[str] = []
        waiting: set[str] = set()
        groups: list[list[str]] = []
        for root in sorted(kinds, reverse=True):
            if root in index:
                continue
            walk = [(root, iter(after[root]))]
            index[root] = low[root] = len(index)
            held.append(root)
            waiting.add(root)
            while walk:
                k, rest = walk[-1]
                following = next((x for x in rest if x not in index or x in waiting), None)
                if following is None:
                    walk.pop()
                    if walk:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[k])
                    if low[k] == index[k]:
                        at = held.index(k)
                        groups.append(sorted(held[at:]))
                        waiting.difference_update(held[at:])
                        del held[at:]
                elif following in index:
                    low[k] = min(low[k], index[following])
                else:
                    index[following] = low[following] = len(index)
                    held.append(following)
                    waiting.add(following)
                    walk.append((following, iter(after[following])))
        return groups[::-1]

    def is_loose(self, node: tuple[str, ...], grouped: set[str]) -> bool:
        """Whether the expression has the node as optional, repeated or in a repeated group (of these kinds)."""
        return self.held[node] < self._parents(node) or self.most[node] > 1 or node[-1] in grouped

    def _parents(self, node: tuple[str, ...]) -> int:
        return self.times[node[:-1]] if node[:-1] else self.pages

    def expression(self) -> str:
        """The wrapper as an expression: name(children), ? optional, + repeated, (..)+ a repeated group, #text a slot."""
        kinds = self.kinds()

        def one(node: tuple[str, ...], grouped: bool) -> str:
            if node[-1] == TEXT:
                body = "#text" if self.is_slot(node[:-1]) else repr(self.text[node[:-1]][0])
            else:
                body = f"{node[-1]}({inner(node)})"
            maybe = grouped or self.held[node] < self._parents(node)
            return body + ("*" if self.most[node] > 1 and maybe and not grouped else "+" if self.most[node] > 1 and not grouped else "?" if maybe else "")

        def inner(parent: tuple[str, ...]) -> str:
            parts = []
            for g in self.sequence(parent, kinds.get(parent, [])):
                shown = " ".join(one((*parent, k), len(g) > 1) for k in g)
                parts.append(f"({shown})+" if len(g) > 1 else shown)
            return " ".join(parts)

        return inner(())


SALTS = 16
#: host, path, groups, voter and body are hashes; first marks one row a page; plain is prose rather than headings, cells
#: and items. Pages with the same voter, or on several hosts the same body, have the same prose.
_LEAF = "page_id long, url long, host long, voter long, body long, first boolean, path long, groups array<long>, plain boolean, digest long, lines array<int>, chars int, link boolean, fixable boolean, name string, wrapper binary"
#: Elements of which recurring values are ordinary.
_BRIEF = frozenset("h1 h2 h3 h4 h5 h6 figcaption li td th strong".split())


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) - (1 << 63)


def masked(text: str) -> str:
    """A text with white space collapsed and digits masked: dates and counters agree."""
    return DIGITS.sub("0", " ".join(text.split()))


#: A date or time with its digits masked.
DIGITLESS_DATE = re.compile(r"^0([-./ ]0){2}$|^0:0(:0)?$")


def can_be_fixed(mask: str) -> bool:
    """Whether a masked text may be a constant: numbers, codes and quantities of rows agree by their masks alone."""
    letters = sum(map(str.isalpha, mask))
    return letters >= 8 if "0" in mask and not DIGITLESS_DATE.match(mask) else letters >= 3 or bool(DIGITLESS_DATE.match(mask))


def _parse_batches(max_hosts: int, least_copy: int):
    names = [c.split()[0] for c in _LEAF.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Wrapper] = {}
        hashed: dict[tuple[str, ...], tuple[int, list[int], bool]] = {}

        def place(path: tuple[str, ...]) -> tuple[int, list[int], bool]:
            if (known := hashed.get(path)) is None:
                known = hashed[path] = _hash("/".join(path)), sorted({_hash(s) for s in path if "[" in s}), not (path and path[-1].split("[")[0] in _BRIEF)
            return known

        def give() -> Iterator[pa.RecordBatch]:
            if wrappers:
                yield table([(None, None, _hash(h), *[None] * 11, h, pickle.dumps(w.__dict__)) for h, w in wrappers.items()])
                wrappers.clear()
                hashed.clear()

        for big in batches:
            for at in range(0, big.num_rows, 64):
                rows = []
                for page_id, url, host, content in zip(*(c.to_pylist() for c in big.slice(at, 64).columns), strict=True):
                    page = decode(content)
                    if page is None:
                        continue
                    found, own = [], []
                    u, h = _hash(url), _hash(host)
                    prose: dict[int, int] = {}
                    for path, numbers, text, lines, link in pieces(page):
                        skip = path.index("body") + 1 if "body" in path else int(bool(path) and path[0] == "html")
                        path, m = path[skip:], masked(text)
                        fixable, d, where = can_be_fixed(m), _hash(m), place(path)
                        found.append((path, numbers[skip:], m if fixable else text))
                        own.append((*where, d, lines, len(text), link, fixable, None, None))
                        if fixable and where[2] and not link:
                            prose[d] = max(len(text), prose.get(d, 0))
                    longest = sorted(prose, key=lambda d: (-prose[d], d))
                    copied = sum(prose.values()) >= least_copy
                    voter = _hash(repr(longest)) if copied else u
                    body = _hash(repr(longest[:3])) if copied else _hash(f"{h} {u}")
                    rows += [(page_id, u, h, voter, body, not k, *x) for k, x in enumerate(own)]
                    wrappers.setdefault(host, Wrapper()).align(found, body)
                if rows:
                    yield table(rows)
                if len(wrappers) > max_hosts:
                    yield from give()
        yield from give()

    return run


def _merge_groups(t: pa.Table) -> pa.Table:
    whole = Wrapper()
    for data in t.column("wrapper").to_pylist():
        part = Wrapper()
        part.__dict__.update(pickle.loads(data))
        whole.merge(part)
    return pa.table({"host": t.column("host").slice(0, 1), "name": t.column("name").slice(0, 1), "wrapper": pa.array([pickle.dumps(whole.__dict__)], pa.binary())})


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", content_col: str = "content", least_copy: int = 400, max_hosts: int = 2_000) -> DataFrame:
    """The one scan over the pages: rows of text stretches, and rows of partial wrappers."""
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.lower(host).alias("host"), F.col(content_col).alias("content"))
    return cut_lineage(src.where("page_id is not null and content is not null").mapInArrow(_parse_batches(max_hosts, least_copy), _LEAF))


def wrappers(parsed: DataFrame, salts: int = 64) -> DataFrame:
    """(host, name, wrapper) of every host: partial wrappers merged in salted groups, then whole."""
    parts = parsed.where("wrapper is not null").select("host", "name", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt"), "wrapper")
    some = parts.groupBy("host", "salt").applyInArrow(_merge_groups, "host long, name string, wrapper binary")
    return some.groupBy("host").applyInArrow(_merge_groups, "host long, name string, wrapper binary")


def _decide_groups(min_mark: float, min_link: float):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        w = Wrapper()
        w.__dict__.update(pickle.loads(next(r["wrapper"] for r in rows if r["wrapper"] is not None)))
        slots = {p: _hash("/".join(p)) for p in w.text}
        by_hash = {r["path"]: r for r in rows if r["kind"] == "node"}
        filled = {p: by_hash[h] for p, h in slots.items() if h in by_hash}
        nodes = {p: r for p, r in filled.items() if w.is_slot(p)}
        marked = {r["path"]: r["marked"] for r in rows if r["kind"] == "group"}
        boxes: dict[str, tuple[int, int]] = {}  # characters, those of links
        for p, r in filled.items():
            for k in {k for k in p if "[" in k}:
                chars, links = boxes.get(k, (0, 0))
                boxes[k] = chars + r["chars"], links + r["link_chars"]
        volume: dict[tuple[str, ...], int] = {}
        for path, r in nodes.items():
            for k in range(len(path) + 1):
                volume[path[:k]] = volume.get(path[:k], 0) + r["varying"]
        # The body: down the element whose slots hold most of the varying text, then up to the one with the titles' slot.
        kinds, chain, node = w.kinds(), [], ()
        while volume.get(node):
            inside = [(*node, c) for c in kinds.get(node, ()) if c.split("[")[0] in CONTAINER]
            best = max(sorted(inside), key=lambda n: volume.get(n, 0), default=None)
            if best is None or volume.get(best, 0) < 0.5 * volume[node]:
                break
            chain.append(best)
            node = best
        title = [p for p, r in nodes.items() if p and p[-1] == "h1" and r["varying_pages"] >= 0.3 * w.seen.get(chain[0] if chain else p, 1)]
        body = next((n for n in (*reversed(chain), ()) if any(p[: len(n)] == n for p in title)), chain[-1] if chain else None)
        if body is None:
            return pa.table({"host": pa.array([], pa.int64()), "path": pa.array([], pa.int64())})
        loose: dict[str, bool] = {}
        for parent, ks in kinds.items():
            if parent[: len(body)] == body and any("[" in k for k in ks):
                grouped = {k for g in w.sequence(parent, ks) if len(g) > 1 for k in g}
                for k in ks:
                    if "[" in k:
                        loose[k] = loose.get(k, False) or w.is_loose((*parent, k), grouped)
        out = set()
        for k, free in loose.items():
            chars, links = boxes.get(k, (0, 0))
            if k in body or not chars or chars >= 0.4 * volume[body]:
                continue  # what holds the body isn't a box inside it
            if links >= min_link * chars or marked.get(_hash(k), 0) >= (1 if free else 2) * min_mark * w.sites[k]:
                out.add(k)
        keep = [slots[p] for p in nodes if p[: len(body)] == body and not any(s in out for s in p[len(body) :])]
        return pa.table({"host": pa.array([rows[0]["host"]] * len(keep), pa.int64()), "path": pa.array(keep, pa.int64())})

    return run


def main_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", content_col: str = "content", share: float = 0.02, item_share: float = 0.15, hosts: int = 3, min_mark: float = 0.25, min_link: float = 0.9, least_copy: int = 400) -> DataFrame:
    """(page_id, line_no) of the lines that carry text of the main body."""
    parsed = parse(pages, id_col, url_col, content_col, least_copy)
    leaf = parsed.where("wrapper is null").drop("wrapper", "name")
    key = ["host", "path", "digest"]
    # An address votes once, whatever its fetches; addresses with the same prose vote once together.
    once = leaf.groupBy(*key, "url").agg(
        F.min("voter").alias("voter"), F.min("body").alias("body"), F.first("plain").alias("plain"), F.max("fixable").alias("fixable"),
        F.sum("chars").alias("chars"), F.sum(F.when(F.col("link"), F.col("chars")).otherwise(0)).alias("link_chars"), F.count("*").alias("n"),
    )
    votes = once.groupBy(*key, "voter").agg(F.min("body").alias("body"), F.first("plain").alias("plain"), F.max("fixable").alias("fixable"), *(F.sum(c).alias(c) for c in ("chars", "link_chars", "n")))
    few = F.slice(F.array_sort(F.collect_set(F.pmod(F.col("body"), F.lit(1 << 10)))), 1, hosts)  # at most 1,024 values are collected
    texts = votes.groupBy(*key).agg(F.count("*").alias("voters"), few.alias("bodies"), F.first("plain").alias("plain"), F.max("fixable").alias("fixable"), *(F.sum(c).alias(c) for c in ("chars", "link_chars", "n")))
    addresses = leaf.where("first").groupBy("host", "url").agg(F.min("voter").alias("voter")).select("host", "voter").distinct().groupBy("host").agg(F.count("*").alias("addresses"))
    # Variants of the template: by share of a host's addresses, or by hosts. Headings, cells and items of a body recur by
    # chance: only those of a good part of the pages count.
    enough = F.when(F.col("plain"), F.greatest(F.lit(2), share * F.col("addresses"))).otherwise(F.greatest(F.lit(3), item_share * F.col("addresses")))
    wide = texts.where("plain and fixable").select("digest", "host", F.explode("bodies").alias("body")).groupBy("digest").agg(F.count_distinct("host").alias("hosts"), F.count_distinct("body").alias("different"))
    spread = wide.where((F.col("hosts") >= hosts) & (F.col("different") >= hosts)).select("digest", F.lit(True).alias("wide"))
    texts = cut_lineage(texts.join(addresses, "host").join(spread, "digest", "left").withColumn("variant", F.col("fixable") & ((F.col("voters") >= enough) | (F.coalesce("wide", F.lit(False)) & F.col("plain")))).drop("bodies", "wide", "voters"))
    marks = texts.where("variant")
    open_chars = F.when(~F.col("variant"), F.col("chars")).otherwise(0)
    zero = F.lit(0).cast("long")
    nodes = texts.groupBy("host", "path").agg(F.sum(open_chars).alias("varying"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), F.sum(F.when(~F.col("variant"), F.col("n")).otherwise(0)).alias("varying_pages"), zero.alias("marked"))
    # Groups are told by signature wherever they stand in the site's pages: pages on which a variant marks one.
    held = leaf.where("fixable and size(groups) > 0").select(*key, "page_id", "groups").join(marks.select(*key), key, "left_semi")
    marked = held.select("host", F.explode("groups").alias("path"), "page_id").distinct().groupBy("host", "path").agg(F.count("*").alias("marked"))
    none = F.lit(None).cast("binary").alias("wrapper")
    empty = [zero.alias(c) for c in ("varying", "chars", "link_chars", "varying_pages")]
    stats = nodes.select("*", F.lit("node").alias("kind"), none).unionByName(marked.select("host", "path", *empty, "marked", F.lit("group").alias("kind"), none))
    stats = stats.unionByName(wrappers(parsed).select("host", zero.alias("path"), *empty, zero.alias("marked"), F.lit("wrapper").alias("kind"), "wrapper"))
    keep = stats.groupBy("host").applyInArrow(_decide_groups(min_mark, min_link), "host long, path long")
    # One slot of a large host may hold a good part of all rows: slots are repeated for each salt.
    keep = keep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    body = leaf.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).select(*key, "salt", "page_id", "lines").join(keep, ["host", "path", "salt"])
    return body.join(marks.select(*key), key, "left_anti").select("page_id", F.explode("lines").alias("line_no")).distinct()


def wrapper_report(pages: DataFrame) -> DataFrame:
    """(host, pages, expression): the inferred wrapper of every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = []
            for data in b.column(1).to_pylist():
                w = Wrapper()
                w.__dict__.update(pickle.loads(data))
                ws.append(w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w.pages for w in ws], pa.int64()), pa.array([w.expression() for w in ws], pa.string())], names=["host", "pages", "expression"])

    return wrappers(parse(pages)).select("name", "wrapper").mapInArrow(run, "host string, pages long, expression string")
