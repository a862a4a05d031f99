import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm import splitting as sp

KIND = "url string, title string, chunking struct<max_tokens:int,target_tokens:int,overlap_tokens:int,version:int,tokens_per_word:double>, chunks array<struct<chunk_index:int,section:string,anchor:string,content:string,tokens:int>>, piece int, cut string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["One two. ", "Three\n", "\n\n", "word ", "x" * 30 + " ", "End! (Next) ", "  ", "\t", "4 five? "]), max_size=120).map("".join), st.integers(1, 20), st.integers(0, 8))
def test_pieces_round_trip(text, limit, overlap):
    pieces, forced = sp.split_item(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in pieces) == text
    for k, (a, s, e) in enumerate(pieces):
        assert len(text[a:e].split()) <= limit
        assert len(text[a:s].split()) <= overlap and (k or a == s)
    stretches = [p for line in text.split("\n") for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])", line)]
    if len(text.split()) > limit:
        assert forced == any(len(p.split()) > limit for p in stretches)


def test_overlap_repeats_the_end_of_the_piece_before():
    text = " ".join(f"Word{i} is here." for i in range(40))
    pieces, forced = sp.split_item(text, 30, 6)
    assert not forced and len(pieces) > 3
    for (_, s0, e0), (a, s, _) in zip(pieces, pieces[1:], strict=False):
        assert e0 == s and s0 <= a < s and len(text[a:s].split()) == 6


def test_very_long_words():
    text = "a" * 25_000 + " b c"
    pieces, _ = sp.split_item(text, 2, 0)
    assert "".join(text[s:e] for _, s, e in pieces) == text and all(e - a <= 10_010 for a, _, e in pieces)


def test_word_budget():
    for per in (1.0, 1.3, 1.68, 2.5):
        for t in (0, 1, 7, 60, 500):
            w = sp.word_budget(t, per)
            assert math.ceil(w * per) <= t < math.ceil((w + 1) * per)


def test_dirty_files(spark):
    ch = (10, 8, 3, 1, 1.0)
    big = "First sentence has five words. Second sentence has five words. Third one here."
    one = ("u", "t", ch, [(1, "S", None, big, None), (0, "S", "a", None, 3), (2, "", "", "", 0), (3, "S", "b", " \n ", 1), (4, "S", "c", " ".join(["w"] * 25), 1)], 7, "x")
    rows = [one, one, ("v", None, None, [(0, None, None, big, 1)], None, None), ("w", None, (None, None, None, None, None), None, None, None), ("x", None, ch, [], None, None)]
    df = spark.createDataFrame(rows, KIND)
    out = sp.split_oversized(df).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.url, r.chunk_index, r.piece)):
        by.setdefault((r.url, r.chunk_index), []).append(r)
    assert [p.cut for p in by[("u", 1)]] == ["natural"] * 2 and all(p.tokens <= 10 and p.section == "S" for p in by[("u", 1)])
    assert [p.cut for p in by[("u", 4)]][0] == "forced" and by[("u", 4)][0].anchor == "c"
    assert by[("u", 0)][0].content is None and not by[("v", 0)][0].oversized and len(by[("u", 2)]) == 1
    assert sp.split_oversized(df.limit(0)).count() == 0


def test_only_single_words_are_cut_by_characters():
    ordinary = " ".join("w" * 90 for _ in range(150))  # 13,649 characters, every word fits
    text = ordinary + "\n" + " ".join("v" * 90 for _ in range(150))
    pieces, forced = sp.split_item(text, 200, 0)
    assert not forced and [text[s:e].split()[0][0] for _, s, e in pieces] == ["w", "v"]
    for n, want in ((10_000, 1), (10_001, 2), (30_001, 4)):
        word = "x" * n
        pieces, _ = sp.split_item(f"a b c {word} d e f", 3, 0)
        assert sum(text.count("x") > 0 for text in (f"a b c {word} d e f"[s:e] for _, s, e in pieces)) == want
