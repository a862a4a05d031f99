"""Evaluation passages inside corpus documents: q-gram lemma filter in diagonal bands, then banded alignment.

Texts are reduced to letters and digits of any script: entities resolved, markup and invisible characters removed,
accents folded, lower case, no separators at all; so line breaks, hyphenation and punctuation leave no trace. The items
are held as an index of their character q-grams (first of the rarest only: every item's bound is computed on the kept
ones, so nothing is lost by it). Documents stream past it in one scan without a shuffle:

1. every document position's q-gram is looked up by array hashing (NumPy, whole batches);
2. hits are counted per (document, item, diagonal band); bands overlap by half so that left-out and added words
   stay within one;
3. regions below the item's edit-budget bound are dropped: a stretch of ``run`` words with a share ``edits`` of them
   altered still holds that many of the item's q-grams, by the q-gram lemma, whichever words they are. Of the rest the
   missing q-grams must be those of so few edits, wherever they stand (the fewest edits that explain them are counted);
4. what is left is decided by a banded alignment of words: a case has a stretch of at least ``run`` consecutive words of
   the item in which at most one word in 1/edits is changed, added or left out.

Items whose edits may leave no q-gram at all are aligned with every text that holds enough of their words. Null and
empty texts disclose nothing; items shorter than ``run`` words can't be disclosed. Repeated documents are reported once
each doc_id; repeated items count once. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags and link targets of any length; possessive, so that what isn't closed is read once.
TAG = re.compile(r"</?[A-Za-z][^<>]*+>|\]\([^()\s]*+\)")
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
BROKEN = re.compile(r"(?<=[\w\u0300-\u036f])[-‐‑]\s*\n\s*(?=\w)")
#: Cyrillic and Greek letters that look like Latin ones (fixed values).
LOOKALIKE = str.maketrans("асеорхуіјѕԁһвкмнтαεορικυν", "aceopxyijsdhbkmhtaeopikuv")
#: Items in one index; more items are more indexes, each with a table of positions of this height.
GROUP = 300
#: Occurrences of a q-gram within one item that are kept.
PLANES = 3
#: Hits that chance brings to a band, for each hit that another item has with the item.
CHANCE = 0.5
#: Characters around a region that the alignment also sees.
MARGIN = 40
#: Letters and digits outside ASCII, after decomposition.
FOREIGN = re.compile(r"[^\W\x00-\x7f]+")
#: What else there is outside ASCII.
OTHER = re.compile(r"[^\w\x00-\x7f]+")
_BLANK = bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) != " ")
_DROP = _BLANK + b" "


def _unmarked(text: str) -> str:
    """Text without comments, tags and link targets; a comment that isn't closed is text."""
    kept, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        kept.append(text[at:begin])
        at = end + 3
    return TAG.sub("", "".join(kept) + text[at:])


def plain(text: str, visible: bool = False) -> tuple[str, bool]:
    """(text, foreign): without entities, markup and compatibility forms, letters that only look Latin are; and whether
    other letters outside ASCII are left. visible: invisible characters are taken out too."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "](" in text:
        text = _unmarked(text)
    if text.isascii():
        return text, False
    text = unicodedata.normalize("NFKD", INVISIBLE.sub("", text) if visible else text)
    if not FOREIGN.search(text):
        return text, False
    text = FOREIGN.sub(lambda m: m[0].casefold().translate(LOOKALIKE), text)
    return text, FOREIGN.search(text) is not None


def _letters(text: str, foreign: bool, drop: bytes) -> bytes:
    return (OTHER.sub("", text).encode() if foreign else text.encode("ascii", "ignore")).lower().translate(None, drop)


def solid(text: str) -> bytes:
    """Only the letters and digits of a text, of any script, accents folded: words(text) without spaces."""
    return _letters(*plain(text), _DROP)


def words(text: str) -> list[bytes]:
    """The words of a text (between white space), each reduced to letters and digits; empty ones are left out.

    Hyphens at a line's end join the word's parts.
    """
    text, foreign = plain(text, visible=True)
    return _letters(" ".join(BROKEN.sub("", text).split()), foreign, _BLANK).split()


def _grams(b: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every window of q bytes."""
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    v = b.astype(np.uint64)
    h = v[:n].copy()
    for j in range(1, q):
        h *= np.uint64(0x100000001B3)
        h += v[j : j + n]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Index:
    """q-gram index of a group of items with two bounds for each: of rare q-grams, and of all."""

    BITS = 22

    def __init__(self, items: list[tuple[str, str]], q: int, run: int, edits: float) -> None:
        self.q, self.run, self.edits = q, run, edits
        self.ids = [i for i, _ in items]
        self.words = [words(p) for _, p in items]
        gram, item, pos, plane = [], [], [], []
        for k, ws in enumerate(self.words):
            g = _grams(np.frombuffer(b"".join(ws), np.uint8), q)
            order = np.argsort(g, kind="stable")
            new = np.r_[True, g[order][1:] != g[order][:-1]] if len(g) else np.zeros(0, bool)
            turn = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            times = np.empty(len(g), np.int64)  # how often the item had the q-gram before
            times[order] = turn
            kept = np.flatnonzero(times < PLANES)
            gram.append(g[kept])
            item.append(np.full(len(kept), k, np.int32))
            pos.append(kept.astype(np.int32))
            plane.append(times[kept])
        g, it, ps, pl = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((gram, np.uint64), (item, np.int32), (pos, np.int32), (plane, np.int64)))
        self.gram, row, size = np.unique(g, return_inverse=True, return_counts=True)
        longest = max((sum(map(len, ws)) for ws in self.words), default=0)
        self.offset = longest + (1 << 12)  # keeps diagonals positive
        self.place = np.full((PLANES, len(items), len(self.gram)), -1, np.int16 if longest < 1 << 15 else np.int32)
        self.place[pl, it, row] = ps
        self.length = np.array([sum(map(len, ws)) for ws in self.words], np.int64)
        self.repeats = np.zeros(len(items), bool)
        self.repeats[it[pl > 0]] = True
        begin = np.searchsorted(it, np.arange(len(items) + 1))
        self._entries = it, ps, row, begin
        self.table = np.full(1 << self.BITS, -1, np.int32)  # first row of a hash prefix
        self.table[(self.gram >> np.uint64(64 - self.BITS)).astype(np.int64)[::-1]] = np.arange(len(self.gram), dtype=np.int32)[::-1]
        raw = [self._bounds(w, ps[begin[k] : begin[k + 1]]) for k, w in enumerate(self.words)]
        self.bounds = [(np.maximum(1, need), a, b) for need, a, b in raw]
        self.unbounded = [k for k, b in enumerate(raw) if min(b[0], default=1) < 1]
        once = (pl == 0) & (self.place[1, it, row] < 0)
        self.steps = [self._steps(w, ps[begin[k] : begin[k + 1]][once[begin[k] : begin[k + 1]]]) for k, w in enumerate(self.words)]
        self.windows, self.exact = [], []
        for ws in self.words:
            w = [(k, k + run, run - budget) for run, budget in self.stretches(len(ws)) for k in range(len(ws) - run + 1)]
            self.windows.append(tuple(np.array(x, np.int64) for x in zip(*w, strict=True)) if w else (np.zeros(0, np.int64),) * 3)
            self.exact.append([b"".join(ws[k : k + run]) for k in range(len(ws) - run + 1)])
        self.need = np.maximum(1, np.array([min(b[0], default=1 << 30) for b in self.bounds], np.int64))
        self._size = size - 1

    def tune(self, seen: np.ndarray, texts: int) -> None:
        """Chooses of every item the rarest q-grams, as many as put its bound farthest above chance.

        seen: how often each q-gram occurs in so many texts. The choice bears on speed alone: the bound is always
        computed on what is kept.
        """
        it, ps, row, begin = self._entries
        cap, self.need_rare = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), 1 << 30, np.int64)
        for k, ws in enumerate(self.words):
            own, often = ps[begin[k] : begin[k + 1]], seen[row[begin[k] : begin[k + 1]]]
            best = -np.inf
            for c in np.unique(np.quantile(often, (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1), method="higher")) if len(often) else ():
                kept = often <= c
                need = min(self._bounds(ws, own[kept])[0], default=1 << 30)
                noise = max(1e-3, CHANCE * float(often[kept].sum()) / max(1, texts))
                gain = need * np.log(max(1.0, need / noise)) - need + noise if need > 0 else -1.0
                if gain > best or best < 0:  # without a bound more are kept
                    best, cap[k], self.need_rare[k] = gain, c, max(1, need)
        rare = seen[row] <= cap[it]
        order = np.argsort(row[rare], kind="stable")
        self.item, self.pos = it[rare][order], ps[rare][order]
        self.first = np.searchsorted(row[rare][order], np.arange(len(self.gram) + 1))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, rows) of the hashes that are q-grams of the items."""
        row = self.table[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        at = np.flatnonzero(row >= 0)
        row, h = row[at], h[at]
        other = np.flatnonzero(self.gram[row] != h)
        row[other] = np.minimum(np.searchsorted(self.gram, h[other]), len(self.gram) - 1)
        ok = self.gram[row] == h
        return at[ok], row[ok]

    def tune_on(self, texts: list[bytes]) -> None:
        """tune() by the texts themselves."""
        if len(self.gram) and texts:
            _, row = self.lookup(_grams(np.frombuffer(b"".join(texts), np.uint8), self.q))
            self.tune(np.bincount(row, minlength=len(self.gram)), len(texts))
        else:
            self.tune(self._size, len(self.ids))

    def _bounds(self, ws: list[bytes], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each stretch (see stretches), the fewest kept q-grams it holds after the most harmful edits allowed,
        and where its q-grams begin and end."""
        if len(ws) < self.run:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        at = np.r_[0, np.cumsum([len(w) for w in ws])]
        till = np.r_[0, np.cumsum(np.bincount(kept, minlength=at[-1] + 1))]
        parts = []
        # A stretch of twice run words or more falls into two, one of which has at most the share of edits of the whole.
        for run, budget in takewhile(lambda x: x[0] < 2 * self.run, self.stretches(len(ws))):
            word = np.arange(len(ws) - run + 1)[:, None] + np.arange(run)
            a = at[word[:, 0]]
            b = np.maximum(a, at[word[:, -1] + 1] - self.q + 1)
            harm = till[np.clip(at[word + 1], a[:, None], b[:, None])] - till[np.clip(at[word] - self.q + 1, a[:, None], b[:, None])]
            harm.sort(axis=1)
            parts.append((till[b] - till[a] - harm[:, run - budget :].sum(1), a, b))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _steps(self, ws: list[bytes], once: np.ndarray) -> tuple[np.ndarray, ...]:
        """For _possible: positions whose q-gram the item has once; where the q-grams end that an edit of the word of
        a position's last letter touches; where words begin; and the stretches."""
        at = np.r_[0, np.cumsum([len(w) for w in ws])].astype(np.int64)
        single = np.zeros(at[-1] + 1, bool)
        single[once] = True
        word = np.repeat(np.arange(len(ws)), np.diff(at))
        last = np.minimum(np.arange(at[-1]) + self.q - 1, at[-1] - 1)
        beyond = np.r_[at[word[last] + 1], at[-1], at[-1]] if len(ws) else np.zeros(2, np.int64)
        # A stretch of twice run words or more falls into two, one of which has at most the share of edits of the whole.
        return single, beyond, at, [x for x in takewhile(lambda x: x[0] < 2 * self.run, self.stretches(len(ws))) if x[0] <= len(ws)]

    def _possible(self, item: int, hits: np.ndarray) -> np.ndarray:
        """Which rows of hits (by item position) some stretch can have with its edits.

        Every edit is spent as far to the right as it still explains the first q-gram missing, which needs the fewest.
        """
        single, beyond, at, stretches = self.steps[item]
        end = hits.shape[1]
        there = np.where(single & ~hits, np.arange(end, dtype=np.int32), np.int32(end))
        there = np.c_[np.minimum.accumulate(there[:, ::-1], axis=1)[:, ::-1], np.full(len(hits), end, np.int32)]  # next q-gram missing
        row = np.arange(len(hits))[:, None]
        pos, spent, found = there[:, at[:-1]], 0, np.zeros(len(hits), bool)
        for run, budget in stretches:
            for _ in range(spent, budget):
                pos = there[row, beyond[pos]]
            spent = budget
            found |= (pos[:, : len(at) - run] > at[run:] - self.q).any(1)
        return found

    def stretches(self, n: int) -> list[tuple[int, int]]:
        """(words, edits) of the shortest stretches for each number of edits: any disclosed stretch of an item of n
        words holds one of them with no more edits. Of longer ones than 6 * run some part of 3 to 6 * run words has at
        most the share of edits of the whole, so longer ones are not needed."""
        first = int(self.run * self.edits + 1e-9)
        more = ((int(np.ceil(e / self.edits - 1e-9)), e) for e in range(first + 1, n + 1))
        return [(self.run, first)] + list(takewhile(lambda x: x[0] <= min(n, 6 * self.run), more))

    def regions(self, texts: list[bytes], width: int) -> list[tuple[int, int, int, int]]:
        """(text, item, lowest and highest diagonal) of the bands that reach the item's bound; whole texts for items
        whose edits allowed may leave no q-gram."""
        whole = [(d, k, -int(self.length[k]), len(t)) for k in self.unbounded for d, t in enumerate(texts)]
        return whole + [x for x in self._bounded_regions(texts, width) if x[1] not in self.unbounded]

    def _bounded_regions(self, texts: list[bytes], width: int) -> list[tuple[int, int, int, int]]:
        size = np.array([len(t) for t in texts], np.int64)
        start = np.r_[0, np.cumsum(size)]
        h = _grams(np.frombuffer(b"".join(texts), np.uint8), self.q)
        if not len(h) or not len(self.gram):
            return []
        at, row = self.lookup(h)
        doc = np.searchsorted(start, at, "right") - 1
        ok = at + self.q <= start[doc + 1]
        at, row, doc = at[ok], row[ok], doc[ok]
        local = at - start[doc] + self.offset
        n = self.first[row + 1] - self.first[row]
        entry = np.repeat(self.first[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[entry].astype(np.int64)
        bands = self._bands(np.repeat(doc, n), item, np.repeat(local, n) - self.pos[entry], self.need_rare, width)
        # All shared q-grams near the bands that are left.
        order = np.argsort(bands[1], kind="stable")  # one item after the other: its row of places stays in the cache
        d, i, low = (x[order] for x in bands)
        a = np.searchsorted(at, start[d] + low - self.offset, "left")
        b = np.searchsorted(at, start[d] + low - self.offset + width + self.length[i], "left")
        a, b = np.maximum(a, np.searchsorted(at, start[d], "left")), np.minimum(b, np.searchsorted(at, start[d + 1], "left"))
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        row, local = row.astype(np.int32), local.astype(np.int32)
        each = np.searchsorted(i, np.arange(len(self.ids) + 1))
        for k in np.flatnonzero(np.diff(each)).tolist():
            for x in range(each[k], each[k + 1], 2_000):  # bounded memory: that many bands at a time
                part = slice(x, min(x + 2_000, each[k + 1]))
                n = np.maximum(0, b[part] - a[part])
                who = np.repeat(np.arange(len(n), dtype=np.int32), n)
                hit = np.arange(len(who)) + np.repeat(a[part] - np.cumsum(n) + n, n)
                r, top = row[hit], local[hit] - low[part].astype(np.int32)[who]
                p = self.place[0, k].take(r).astype(np.int32)
                ok = (p >= 0) & (top >= p) & (top < p + width)
                for plane in range(1, PLANES) if self.repeats[k] else ():  # the occurrence inside the band
                    again = np.flatnonzero(~ok & (p >= 0))
                    p[again] = self.place[plane, k].take(r[again])
                    ok[again] = (p[again] >= 0) & (top[again] >= p[again]) & (top[again] < p[again] + width)
                who, p = who[ok], p[ok]
                enough = np.bincount(who, minlength=len(n)) >= self.need[k]
                rank = np.cumsum(enough) - 1
                ok = enough[who]
                size = int(self.length[k]) + 2
                till = np.zeros((int(enough.sum()), size), np.int32)
                np.cumsum(np.bincount(rank[who[ok]] * size + p[ok] + 1, minlength=till.size).reshape(till.shape), axis=1, out=till)
                some = self._possible(k, np.diff(till, axis=1) > 0)
                for c in np.flatnonzero(enough)[some].tolist():
                    lowest = int(low[x + c]) - self.offset
                    out.setdefault((int(d[x + c]), k), []).append((lowest, lowest + width))
        merged = []
        for (k, item_), spans in out.items():
            spans.sort()
            lo, hi = spans[0]
            for s, e in spans[1:]:
                if s <= hi:
                    hi = max(hi, e)
                else:
                    merged.append((k, item_, lo, hi))
                    lo, hi = s, e
            merged.append((k, item_, lo, hi))
        return merged

    def _bands(self, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, need: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, item, lowest diagonal) of the half-overlapping bands with enough hits."""
        parts = []
        pair = doc.astype(np.int32) * len(self.ids) + item.astype(np.int32)
        mixed = pair.astype(np.uint32) * np.uint32(0x9E3779B1)
        least = need.clip(max=1 << 30).astype(np.int32)[item]
        diagonal = diagonal.astype(np.int32)
        for shift in (0, width // 2):
            band = (diagonal + shift) // width
            # Counts by hash are at least the true ones: what is too rare by them need not be sorted.
            slot = (mixed + band.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 20)
            some = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= least)
            u, c = np.unique((pair[some].astype(np.int64) << 24) + band[some], return_counts=True)
            d, i = (u >> 24) // len(self.ids), (u >> 24) % len(self.ids)
            ok = c >= need[i]
            parts.append((d[ok], i[ok], (u[ok] & 0xFFFFFF) * width - shift))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def may_disclose(self, item: int, doc: bytes, low: int, high: int) -> tuple[int, int] | None:
        """First and last item word of the stretches of which enough words stand inside the band at all (altered ones
        need not); None without any."""
        begin, end, least = self.windows[item]
        there, at = [0], 0
        for w in self.words[item]:
            there.append(there[-1] + (doc.find(w, max(0, at + low - MARGIN), at + high + len(w) + MARGIN) >= 0))
            at += len(w)
        sums = np.array(there)
        ok = sums[end] - sums[begin] >= least
        return (int(begin[ok].min()), int(end[ok].max())) if ok.any() else None

    def holds(self, item: int, doc: bytes, low: int, high: int) -> bool:
        """Whether a stretch stands in the region unaltered."""
        part = doc[max(0, low - MARGIN) : high + int(self.length[item]) + MARGIN]
        return any(s in part for s in self.exact[item])

    def discloses(self, item: int, doc: list[bytes], low: int, high: int, starts: np.ndarray, among: tuple[int, int]) -> bool:
        """Banded word alignment of an item's words ``among`` with those of a document between two diagonals."""
        ws = self.words[item]
        lead, tail = (sum(map(len, ws[:k])) for k in among)
        a = int(np.searchsorted(starts, low + lead - MARGIN, "left"))
        b = int(np.searchsorted(starts, high + tail + MARGIN, "right"))
        if a >= len(starts):
            return False
        off = int(starts[a]) - lead
        return has_stretch(ws[among[0] : among[1]], doc[a:b], self.run, self.edits, (low - MARGIN - off, high + MARGIN - off))


def has_stretch(item: list[bytes], doc: list[bytes], run: int, edits: float, band: tuple[int, int] | None = None) -> bool:
    """Whether ``run`` or more consecutive item words stand in doc with at most a share ``edits`` of them altered.

    Stretches are grown as local alignments (dynamic programming over words): a matched item word scores 1, and an
    altered, added or left-out one costs 1/edits; the first and the last word of a stretch are held. A
    stretch counts when its score is not negative at ``run`` item words or more.
    A document word may match two item words written together, or two document words one item word. ``band`` bounds
    the difference of the character offsets of a document word and the item word it stands for.
    """
    n, cost = len(doc), 1.0 / edits
    if n == 0 or len(item) < run:
        return False
    known: dict[bytes, list[int]] = {}
    for j, w in enumerate(doc):
        known.setdefault(w, []).append(j)
    # Cells hold pairs (score, first item word) of which none is worse in both. A stretch starts at any held word.
    # Below 1 - run the words that follow either can't make up for what came before or are a stretch themselves.
    low = 1.0 - run
    offset, total = [0], 0
    for w in doc:
        total += len(w)
        offset.append(total)
    below, above = band or (-total - 1, total + 1)
    iat = 0
    prev: dict[int, list[tuple[float, int]]] = {}
    two: dict[int, list[tuple[float, int]]] = {}
    pairs = {doc[j] + doc[j + 1]: j for j in range(n - 1)}
    for i, w in enumerate(item):
        cur: dict[int, list[tuple[float, int]]] = {}

        def offer(j: int, score: float, first: int) -> None:
            if score < low:
                return
            old = cur.get(j)
            if old is None:
                cur[j] = [(score, first)]
            elif not any(s >= score and f <= first for s, f in old):
                cur[j] = [x for x in old if x[0] > score or x[1] < first] + [(score, first)]

        held = [(j + 1, 1.0, i) for j in known.get(w, ()) if below <= offset[j] - iat <= above]
        if w in pairs:
            held.append((pairs[w] + 2, 1.0, i))
        for j, cell in prev.items():  # j: document words used so far
            same = j < n and doc[j] == w
            both = not same and j + 1 < n and doc[j] + doc[j + 1] == w
            for s, f in cell:
                if same:
                    held.append((j + 1, s + 1, f))
                elif j < n:
                    offer(j + 1, s + 1 - cost, f)
                if both:
                    held.append((j + 2, s + 1, f))
                offer(j, s + 1 - cost, f)  # left out
        if i:
            joined = item[i - 1] + w
            held += [(j + 1, 2.0, i - 1) for j in known.get(joined, ()) if below <= offset[j] - iat + len(item[i - 1]) <= above]
            held += [(j + 1, s + 2, f) for j, cell in two.items() if j < n and doc[j] == joined for s, f in cell]
        for j, s, f in held:  # a stretch ends, as it begins, with a word that is held
            if i - f + 1 >= run and s >= -1e-9:
                return True
            offer(j, s, f)
        todo = sorted(cur)  # a heap
        while todo:
            j = heappop(todo)
            if j < n:
                new = j + 1 not in cur
                for s, f in cur[j]:
                    offer(j + 1, s - cost, f)  # added
                if new and j + 1 in cur:
                    heappush(todo, j + 1)
        iat += len(w)
        two, prev = prev, cur
    return False


_HELD: dict[int, list[Index]] = {}


def _scan_batches(items: list[tuple[str, str]], q: int, run: int, edits: float, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((tuple(items), q, run, edits))  # a worker keeps its index over tasks
        if (groups := _HELD.get(key)) is None:
            groups = [Index(items[k : k + GROUP], q, run, edits) for k in range(0, len(items), GROUP)]
        from xxhash import xxh3_128_digest

        known: dict[bytes, list[str]] = {}  # what a text discloses; copies are looked up
        for big in batches:
            at = 0
            while at < big.num_rows:  # slices of about 2 MB of text
                rows, texts, digests, size = [], [], [], 0
                while at < big.num_rows and size < 2_000_000:
                    t = big.column(1)[at].as_py()
                    if t:
                        digest = xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                        rows.append((big.column(0)[at].as_py(), digest))
                        if digest not in known:
                            known[digest] = []
                            digests.append(digest)
                            texts.append(t)
                            size += len(t)
                    at += 1
                solids = [solid(t) for t in texts]
                if key not in _HELD:
                    for index in groups:
                        index.tune_on(solids)
                    _HELD.clear()
                    _HELD[key] = groups
                for index in groups:
                    last, ws, starts = -1, [], np.zeros(0)
                    for d, i, low, high in sorted(index.regions(solids, width)):
                        among = index.may_disclose(i, solids[d], low, high)
                        if among is None or index.ids[i] in known[digests[d]]:
                            continue
                        if index.holds(i, solids[d], low, high):
                            known[digests[d]].append(index.ids[i])
                            continue
                        if d != last:
                            last, ws = d, words(texts[d])
                            starts = np.r_[0, np.cumsum([len(w) for w in ws])]
                        if index.discloses(i, ws, low, high, starts, among):
                            known[digests[d]].append(index.ids[i])
                cases = [(doc, item) for doc, digest in rows for item in dict.fromkeys(known[digest])]
                if len(known) > 200_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cases], pa.int64()), pa.array([c[1] for c in cases], pa.string())], names=["doc_id", "item_id"])

    return scan


def disclosures(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, run: int = 20, edits: float = 1 / 6, q: int = 8, width: int = 128, part: int = 3_000) -> DataFrame:
    """(doc_id, item_id) of every document that discloses an item.

    Items are sent to the workers in parts of about ``part``; every part is a scan of the documents, and the scans'
    rows are united, so any number of items is searched whole and memory is that of one part.
    """
    held = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    parts = max(1, -(-held.count() // part))
    scans = []
    for k in range(parts):
        rows = held.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()
        scans.append(texts.mapInArrow(_scan_batches(sorted((r.i, r.t) for r in rows), q, run, edits, width), "doc_id long, item_id string"))
    return reduce(DataFrame.unionAll, scans).distinct()
