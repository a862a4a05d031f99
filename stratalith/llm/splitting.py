"""Cutting oversized items into overlapping pieces at natural boundaries.

A recursive hierarchy of separators: an item (one section) is taken apart into paragraphs (empty lines), a
paragraph above the limit into lines, a line into sentences, a sentence into words, and a word of more than
``word_chars`` characters into runs of characters. Only what is above the limit is taken further apart. The parts
are packed greedily up to the limit; each piece begins with up to ``overlap`` tokens from the end of the piece
before: whole parts where they fit, else its last words.

Pieces are contiguous stretches of the content, so the content is the pieces without their overlaps, joined.
Tokens are ceil(words * tokens_per_word); words stand between white space. ``cut`` of an item is ``forced`` when
a stretch without natural boundary had to be taken apart by words, else ``natural``.

Null or blank contents are within any limit and give one piece (null stays null). Null settings fall back to the
defaults below. Repeated rows are one item. Elements keep section and anchor, null or not. A limit below the tokens
of one word gives pieces of one word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_TOKENS, TOKENS_PER_WORD = 500, 60, 1.68

PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
LINE = re.compile(r"\n\s*")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])")
WORDS = re.compile(r"\s+")
LEVELS = (PARAGRAPH, LINE, SENTENCE, WORDS)
WORD_LEVEL = 3


def word_budget(tokens: int, per_word: float) -> int:
    """The most words whose token count stays within ``tokens``."""
    if per_word <= 0:
        return 1 << 60
    w = max(0, int(tokens / per_word) + 1)
    while w and math.ceil(w * per_word) > tokens:
        w -= 1
    return w


def _parts(text: str, start: int, end: int, level: int, limit: int, word_chars: int, forced: list[bool]) -> Iterator[tuple[int, int, int]]:
    """(start, end, words) of parts within the limit; a separator stays at the end of the part before it.

    ``forced`` gets an entry for every stretch without natural boundary that is above the limit.
    """
    found = text[start:end].split()
    words = len(found)
    if words <= limit and max(map(len, found), default=0) <= word_chars:
        yield start, end, words
        return
    if level == WORD_LEVEL and words > limit:
        forced.append(True)
    if level > WORD_LEVEL:
        for at in range(start, end, word_chars):
            stop = min(at + word_chars, end)
            yield at, stop, limit  # a run of characters is a piece of its own
        return
    at = start
    for m in LEVELS[level].finditer(text, start, end):
        if m.start() <= start or m.end() >= end:
            continue
        yield from _parts(text, at, m.end(), level + 1, limit, word_chars, forced)
        at = m.end()
    yield from _parts(text, at, end, level + 1, limit, word_chars, forced)


def split_item(text: str, limit: int, overlap: int, word_chars: int = 10_000) -> tuple[list[tuple[int, int, int]], bool]:
    """Pieces (start of overlap, start, end) within ``limit`` words, and whether words had to be parted.

    limit and overlap count words.
    """
    limit = max(1, limit)
    stretches: list[bool] = []
    units = list(_parts(text, 0, len(text), 0, limit, word_chars, stretches))
    forced = bool(stretches)
    pieces: list[tuple[int, int, int]] = []
    first, new, count = 0, 0, 0  # index of the first unit with the overlap, of the first new one, words so far
    lead = 0  # words of an overlap that begins inside a unit
    lead_at = -1
    for i, (_, _, words) in enumerate(units):
        if i > new and count + words > limit:
            begin = units[new][0]
            pieces.append((lead_at if lead_at >= 0 else units[first][0], begin, units[i][0]))
            room = min(overlap, limit - words)
            first, count, lead, lead_at = i, 0, 0, -1
            while first > 0 and first > new and count + units[first - 1][2] <= room:
                first -= 1
                count += units[first][2]
            if count == 0 and room > 0:
                tail = list(re.finditer(r"\S+", text[begin : units[i][0]]))
                lead = min(room, len(tail) - 1)
                if lead > 0:
                    lead_at, count = begin + tail[-lead].start(), lead
            new = i
        count += words
    pieces.append((lead_at if lead_at >= 0 else units[first][0], units[new][0], units[-1][1]))
    return pieces, forced


_OUT = "url string, chunk_index int, piece int, pieces int, section string, anchor string, content string, own_start int, tokens int, oversized boolean, cut string"


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("url", pa.string()), ("chunk_index", pa.int32()), ("piece", pa.int32()), ("pieces", pa.int32()), ("section", pa.string()), ("anchor", pa.string()), ("content", pa.string()), ("own_start", pa.int32()), ("tokens", pa.int32()), ("oversized", pa.bool_()), ("cut", pa.string())])
    for b in batches:
        for at in range(0, b.num_rows, 500):
            rows = []
            for r in b.slice(at, 500).to_pylist():
                limit = MAX_TOKENS if r["max_tokens"] is None else r["max_tokens"]
                over = OVERLAP_TOKENS if r["overlap_tokens"] is None else r["overlap_tokens"]
                per = TOKENS_PER_WORD if r["tokens_per_word"] is None else r["tokens_per_word"]
                head = {k: r[k] for k in ("url", "chunk_index", "section", "anchor")}
                text = r["content"]
                tokens = math.ceil(len(text.split()) * per) if text else 0
                if not text or tokens <= limit:
                    rows.append(head | {"piece": 0, "pieces": 1, "content": text, "own_start": 0, "tokens": tokens, "oversized": False, "cut": None})
                    continue
                pieces, forced = split_item(text, word_budget(limit, per), word_budget(over, per))
                for i, (a, s, e) in enumerate(pieces):
                    part = text[a:e]
                    rows.append(head | {"piece": i, "pieces": len(pieces), "content": part, "own_start": s - a, "tokens": math.ceil(len(part.split()) * per), "oversized": True, "cut": "forced" if forced else "natural"})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def elements(files: DataFrame) -> DataFrame:
    """One row per distinct element of the files' chunks, with the file's settings."""
    c = files.select("url", F.col("chunking.max_tokens"), F.col("chunking.overlap_tokens"), F.col("chunking.tokens_per_word"), F.explode("chunks").alias("c"))
    return c.select("url", "max_tokens", "overlap_tokens", "tokens_per_word", "c.chunk_index", "c.section", "c.anchor", "c.content").distinct()


def split_oversized(files: DataFrame) -> DataFrame:
    """Pieces of every element of chunk files: piece and pieces number them, own_start is where the overlap ends."""
    return elements(files).mapInArrow(_split_batches, _OUT)
