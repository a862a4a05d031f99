"""Abusive, hateful and sexual content: weak supervision by voters, a label model and a linear classifier.

1. Words are read through disguises: invisible characters, entities, look-alike letters, accents, digits for letters,
   masked letters, letters set apart, repeated letters and single slips of the keyboard. What a raw token means is
   worked out once and kept, together with its class (lexicon.py: insult, person addressed, group, ...).
2. On a bounded sample of documents (``sample_docs``, by hash) voters vote on windows of ``WINDOW`` words, for a category
   or against it (reports, self-reproach, harmless senses). A voter is a pattern over word classes ("a person addressed,
   within four words an insult") or a list of set phrases, not a sentence.
3. A generative label model estimates by EM the chances of every voter's votes given the label and given the voter it
   depends on most (a tree of dependences by conditional mutual information), so copies of a voter add nothing; it gives
   each window a posterior per category.
4. A linear classifier is trained on the posteriors, first on runs of word classes, which hold for words the sample
   lacks, then on hashed words, pairs and pairs with a gap. It scores all windows of all documents in one scan with
   NumPy; a document's score is its highest window's.

The rest of the library never collects texts: the driver sees hashed windows of the sample only. Null and empty
texts score 0 in every category. Repeated documents score alike. A table without any vote gives scores of 0.
Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.lexicon import CLASSES, ORDER, PHRASES

CATEGORIES = ("abusive", "hateful", "sexual")
WINDOW, STRIDE, AROUND, BITS = 16, 4, 4, 18

INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
#: Look-alike letters of other scripts (fixed values).
LOOKALIKE = str.maketrans("асеорхуіјѕԁһвкмнтгαεορικυνß", "aceopxyijsdhbkmhtraeopikuvs")
#: Digits and signs that stand for letters; the second reading is tried where the first gives no known word.
LEET = str.maketrans("0123456789@$", "oizeasbtbgas")
LEET2 = str.maketrans("0123456789@$", "olzeasgtagas")
TAG = re.compile(r"</?[A-Za-z][^<>]*+>")
SPLIT = re.compile(r"[^\w*#%@$]+|_")
APART = re.compile(r"(?:\w[.\-_*·]){2,}\w$")
SPACED = re.compile(r"(?<!\S)[^\W_][\W_]?(?: {1,2}[^\W_][\W_]?){2,}(?!\S)")
REPEAT = re.compile(r"(.)\1+")

def fold(text: str) -> str:
    """Lower case without accents, look-alikes and double letters."""
    text = unicodedata.normalize("NFKD", text).casefold().translate(LOOKALIKE)
    return REPEAT.sub(r"\1", "".join(c for c in text if not unicodedata.combining(c)))


#: Classes of which a window needs one to be voted on; x is the telling word of a set phrase that has no other.
HOT = frozenset("IAVXdWiBSCEOomGZx")


def _lexicon() -> tuple[dict[str, str], dict[str, str]]:
    """(word -> class, beginning -> class), folded."""
    whole: dict[str, str] = {}
    begin: dict[str, str] = {}
    for c in ORDER:
        for w in CLASSES[c].split():
            (begin if w.endswith("*") else whole).setdefault(fold(w.rstrip("*")), c)
    for phrase in (p for ps in PHRASES.values() for p in ps):  # a phrase without a word that is heeded gets one
        ws = fold(phrase).split()
        if not any(whole.get(w) in HOT or any(w[:k] in begin for k in range(3, len(w) + 1)) for w in ws):
            whole.update({w: "x" for w in [max((w for w in ws if w not in whole), key=len, default="")] if len(w) >= 5})
    return whole, begin


WHOLE, BEGIN = _lexicon()
CODE = {c: k + 1 for k, c in enumerate(ORDER)} | {"x": 64}


_CHARS = np.full(128, ord("."), np.uint8)
for _c, _k in CODE.items():
    _CHARS[_k] = ord(_c)


def class_of(word: str) -> str:
    """The class of a folded word, "." for none."""
    if (c := WHOLE.get(word)) is not None:
        return c
    for k in range(len(word), 2, -1):
        if (c := BEGIN.get(word[:k])) is not None:
            return c
    return "."


def _phrase(kind: str) -> str:
    return r"(?<!\S)(?:" + "|".join(re.escape(fold(p)).replace(r"\ ", " ") for p in PHRASES[kind]) + r")(?!\S)"


def _voters() -> list[tuple[str, int, bool, str]]:
    """(category, +1, -1 or -2 for an exception to rule, over words instead of classes, pattern)."""
    a, h, s = CATEGORIES
    classes = [
        (a, 1, r"Y[^r]{0,4}I"), (a, 1, r"[IA][^r]{0,3}Y"), (a, 1, r"AI|IA|I.A"), (a, 1, r"i.{0,4}[YIA]"), (a, 1, r"[QU].{0,3}V.{0,3}Y|Y.{0,3}[QU].{0,2}V"), (a, 1, r"V.?Y.{0,6}[XbH]"),
        (a, 1, r"W.{0,6}Y.{0,4}[XdV]|W.{0,4}V.{0,3}Y|W.{0,4}[Xd]"), (a, 1, r"Y.{0,4}[Xd](?!.?t)"), (a, 1, r"n.{0,4}k.{0,3}Y|n.{0,4}Y.{0,3}k"), (a, 1, r"Y.{0,3}A"), (a, 1, r"I.{1,8}I"), (a, 1, r"X[^t]{0,3}Y"), (a, 1, r"w.{0,2}I|w.?A.?I"), (a, 1, r"[UX].{0,4}I|I.{0,3}[UX]"), (a, 1, r"^[^trs]*I[^trs]*$"),
        (a, -2, r"^[^Y]*(?:Q.{0,4}[IA]|[IA].{0,3}Q)[^Y]*$"), (a, -2, r"wI.?Q|Q.?w.{0,2}I"), (a, -1, r"s.{0,4}[IA]|[IA].{0,4}s"), (a, -1, r"r.{0,6}[IVAX]|[IVAX].{0,6}r"), (a, -1, r"[IVAXd].?t|t.{0,2}[IVAXd]"),
        (h, 1, r"G.{0,5}[BSCA]"), (h, 1, r"[BSCA].{0,4}G"), (h, 1, r"[Ld].{1,3}P.{0,4}[BSC]|T.{0,2}P.{0,4}[BS]|.P.{0,3}B"), (h, 1, r"G.{0,6}E|E.{0,5}G"), (h, 1, r"[eE].{0,6}H"), (h, 1, r"G.{0,5}n.{0,4}R|n.{0,5}R.{0,6}G|G.{0,3}R"),
        (h, 1, r"L.{0,3}G.{0,8}[BSCEXVI]"), (h, 1, r"S"), (h, 1, r"n.{0,5}G.{0,3}H|n.{0,4}[kR].{0,4}G"), (h, 1, r"T.{0,4}[BS]|T.{0,5}C"), (h, 1, r"n.{0,2}R.{0,8}[CBST]|C.{0,4}n.{0,2}R"), (h, 1, r"n.{0,3}[Rk].{0,3}H"), (h, 1, r"n.{0,2}[RW].{0,3}R"), (h, 1, r"^[^tru]*G.{0,8}[nERC][^tru]*$"),
        (h, -1, r"B.{0,4}t|t.{0,4}B"), (h, -1, r"r.{0,6}[GBSC]|[GBSC].{0,4}r"), (h, -1, r"u.{0,6}G|G.{0,6}u"), (h, -1, r"^[^GLTSE]*B[^GLTSE]*$"), (h, -1, r"[eE].{0,4}t"),
        (s, 1, r"O"), (s, 1, r"o.{0,4}[bMYmQa]|[bMYmQha].{0,4}o"), (s, 1, r"Z.{0,2}M|M.{0,4}Z|Z.{0,4}Z"), (s, 1, r"h.{0,3}b.*m|m.*h.{0,3}b|m.{0,4}b|b.{0,4}m"), (s, 1, r"a.{0,5}[OoMZ]|[OoMZ].{0,5}a"), (s, 1, r"O.{0,8}[OomMZYa]|[omMZYa].{0,8}O"), (s, 1, r"[mo].{0,6}[mb].{0,6}[hmob]"), (s, 1, r"h.{0,3}m.{0,8}[hmob]"), (s, 1, r"o.?b|b.?o"), (s, 1, r"h.{0,2}[ob].{0,14}h.{0,4}[ob]"),
        (s, -1, r"o.{0,3}t|t.{0,3}o"), (s, -1, r"[ObZ].{0,3}l|l.{0,3}[ObZ]"), (s, -1, r"r.{0,5}[OoZM]|[OoZM].{0,3}r"), (s, -1, r"^[^OZ]*o[^OZMmbh]*$"),
    ]
    words = [(a, 1, "insult"), (a, 1, "dismiss"), (a, -2, "self"), (h, 1, "purge"), (h, 1, "less"), (s, 1, "solicit")]
    return [(c, v, False, p) for c, v, p in classes] + [(c, v, True, _phrase(p)) for c, v, p in words]


VOTERS = _voters()
COMPILED = [re.compile(p) for *_, p in VOTERS]
KEYS = {w for w in [*WHOLE, *BEGIN] if len(w) >= 3} | {w for ps in PHRASES.values() for p in ps for w in fold(p).split() if len(w) >= 4}
#: What a slip of the keyboard may hide: the classes that are telling by themselves.
TELLING = {w for w, c in [*WHOLE.items(), *BEGIN.items()] if c in "IAOoSBC" and len(w) >= 5}


def _near(keys: set[str]) -> dict[str, str]:
    """Every key of six letters and more without one of its letters."""
    out: dict[str, str] = {}
    for w in sorted(keys):
        if len(w) >= 6:
            for i in range(1, len(w)):
                out.setdefault(w[:i] + w[i + 1 :], w)
    return out


NEAR = _near(TELLING)
BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted(KEYS):
    BY_LENGTH.setdefault(len(_w), []).append(_w)


def _masked(part: str) -> str | None:
    """The key that a word with masked letters stands for."""
    rx = re.compile("".join("." if c in "*#%" else re.escape(c) for c in part) + "$")
    return next((w for w in BY_LENGTH.get(len(part), ()) if rx.match(w)), None)


def _one(part: str) -> str:
    if not part.isalpha():
        if any(c in "*#%" for c in part) and sum(map(str.isalpha, part)) >= 2:
            t = part.translate(LEET)
            return _masked(REPEAT.sub(lambda m: m[0] if m[1] in "*#%" else m[1], t)) or ""
        if not any(map(str.isalpha, part)):
            return ""
        both = ["".join(c for c in part.translate(x) if c.isalpha()) for x in (LEET, LEET2)]
        part = next((w for w in both if class_of(REPEAT.sub(r"\1", w)) != "."), both[0])
    w = REPEAT.sub(r"\1", part)
    if w in KEYS or len(w) < 5 or class_of(w) != ".":
        return w
    hit = NEAR.get(w)
    if hit:
        return hit
    for i in range(1, len(w)):
        if len(cut := w[:i] + w[i + 1 :]) >= 6 and cut in TELLING:
            return cut
        if i + 1 < len(w) and (swap := w[:i] + w[i + 1] + w[i] + w[i + 2 :]) in TELLING:
            return swap
    return w


def words_of(token: str) -> list[str]:
    """The folded words of a raw token."""
    if token.isascii():
        if token.isalpha():
            return [_one(token.lower())]
        t = token.lower()
    else:
        t = unicodedata.normalize("NFKD", INVISIBLE.sub("", token)).casefold().translate(LOOKALIKE)
        t = "".join(c for c in t if not unicodedata.combining(c))
    core = t.strip(".,;:!?\"'()[]{}<>…»«“”„¡¿")
    if APART.match(core):
        t = re.sub(r"[.\-_*·]", "", core)
    return [w for p in SPLIT.split(t) if p and (w := _one(p))]


def opened(text: str) -> str:
    """Text with entities resolved and tags removed."""
    if "&" in text:
        text = html.unescape(text)
    return TAG.sub("", text) if "<" in text else text


def joined(text: str) -> str:
    """Text with words of letters set apart put together."""
    return SPACED.sub(lambda m: " " + re.sub(r"[\W_]", "", m[0]) + " ", text)


class Tokens(dict):
    """Raw token -> packed codes of its words: 24 bits of hash, one that marks single letters, seven of class."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, list[str]] = {}

    def __missing__(self, token: str) -> bytes:
        from xxhash import xxh32_intdigest

        if len(self) > 500_000:
            self.clear()
            self.words.clear()
        ws = self.words[token] = words_of(token)
        out = self[token] = np.array([xxh32_intdigest(w) & 0xFFFFFF00 | (len(w) == 1) << 7 | CODE.get(class_of(w), 0) for w in ws], np.uint32).tobytes()
        return out

    def spelled(self, text: str) -> list[str]:
        """The words of a text's tokens."""
        out: list[str] = []
        for token in text.split():
            if token not in self.words:
                self[token]
            out += self.words[token]
        return out


def hashes(text: str, tokens: Tokens) -> np.ndarray:
    """Codes of a text's words, letters set apart put together."""
    get = tokens.__getitem__
    text = opened(text)
    h = np.frombuffer(b"".join(map(get, text.split())), np.uint32)
    single = (h & 128) > 0
    if single.sum() >= 3 and (single[:-2] & single[1:-1] & single[2:]).any():
        h = np.frombuffer(b"".join(map(get, joined(text).split())), np.uint32)
    return h


def spelled(text: str, n: int, tokens: Tokens) -> list[str]:
    """The words behind ``hashes``, n of them."""
    text = opened(text)
    ws = tokens.spelled(text)
    return ws if len(ws) == n else tokens.spelled(joined(text))


def classes_of(h: np.ndarray) -> str:
    """The classes of coded words."""
    return _CHARS[h & 127].tobytes().decode("ascii")


#: What ordinary words around a window may take from its score.
SLACK = 1.0
#: Rows of buckets() that hold words; the rest hold runs of classes.
WORDS, RUNS = 3, 6
#: Positions that the classes of a run may lie apart.
REACH = 6


def buckets(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(6, n) buckets of each position: word, pair, pair with a gap; and if its word has a class, the runs of it with
    the next word that has one, the one after that, and both. What isn't there gets bucket 0.

    last: the last position of the document that a position belongs to.
    """
    n, at = len(h), np.arange(len(h))
    w = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS)
    out = np.zeros((RUNS, n), np.int32)
    out[0] = w >> shift
    for k in (1, 2):
        ok = at + k <= last
        nxt = np.roll(h, -k).astype(np.uint64)
        out[k] = np.where(ok, ((w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + nxt * np.uint64(0x94D049BB133111EB if k == 1 else 0xD6E8FEB86659FD93)) >> shift, 0)
    c = (h & 63).astype(np.int64)  # no runs of x
    some = np.flatnonzero(c)
    c = c[some]
    one, two = some[1:], some[2:]
    near = (one <= last[some[:-1]]) & (one - some[:-1] <= REACH)
    far = (two <= last[some[:-2]]) & (two - some[:-2] <= REACH)
    base = 1 << BITS  # runs of classes have buckets of their own, exact
    out[3, some[:-1][near]] = base + (c[:-1] * 64 + c[1:])[near]
    out[4, some[:-2][far]] = base + 4096 + (c[:-2] * 64 + c[2:])[far]
    out[5, some[:-2][far]] = base + 8192 + ((c[:-2] * 64 + c[1:-1]) * 64 + c[2:])[far]
    return out


#: Buckets of words, and of runs of two and three classes.
SIZE = (1 << BITS) + 8192 + 64**3


def windows_of(n: int) -> np.ndarray:
    """First positions of the windows over n words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def votes_on(ws: list[str], classes: str, s: int = 0) -> bytes:
    """Each voter's vote on the window from word s: 0 none, 1 for, 2 against its category. Voters against a category
    also see the surroundings."""
    own, wide = slice(s, s + WINDOW), slice(max(0, s - AROUND), s + WINDOW + AROUND)
    seen = {(True, False): classes[own], (False, False): classes[wide], (True, True): " ".join(ws[own]), (False, True): " ".join(ws[wide])}
    return bytes((1 if sign > 0 else 2) if rx.search(seen[sign > 0, words]) else 0 for (_, sign, words, _), rx in zip(VOTERS, COMPILED, strict=True))


def _vote_batches(negatives: int):
    """Windows of the sample: buckets and votes; of windows without votes one in ``negatives``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh32_intdigest

        tokens, none = Tokens(), bytes(len(VOTERS))
        hot_class = np.zeros(128, bool)
        hot_class[[CODE[c] for c in HOT]] = True
        for b in batches:
            feats, votes = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = hashes(text, tokens) if text else ()
                if not len(h):
                    continue
                f = buckets(h, np.full(len(h), len(h) - 1))
                starts = windows_of(len(h))
                sums = np.r_[0, np.cumsum(hot_class[h & 127])]
                hot = starts[sums[np.minimum(starts + WINDOW, len(h))] > sums[starts]]
                found = []
                if len(hot):
                    ws, cs = spelled(text, len(h), tokens), classes_of(h)
                    for s in hot.tolist():
                        found.append((s, votes_on(ws, cs, s)))
                if not any(1 in v for _, v in found):
                    lot = xxh32_intdigest(str(doc_id))
                    found += [(s, none) for s in starts[(starts * 2654435761 + lot) % 4294967296 % negatives == 0].tolist()]
                for s, v in found:
                    if any(v) or v is none:
                        feats.append(np.unique(f[:, s : s + WINDOW]).astype(np.int32))
                        votes.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.list_(pa.int32())), pa.array(votes, pa.binary())], names=["features", "votes"])

    return run


def _tree(joint: np.ndarray, least: float, relative: bool = False) -> list[int]:
    """Each voter's parent (-1: none) in a spanning forest of the strongest dependences left once the label is known.

    joint: (label, voter, voter, vote, vote) weights. Dependences weaker than ``least`` nats (relative: than that share
    of the smaller entropy of the two) are chance.
    """
    total = joint.sum((3, 4), keepdims=True) + 1e-12
    p = joint / total
    own, other = p.sum(4, keepdims=True), p.sum(3, keepdims=True)
    mutual = (p * np.log((p + 1e-12) / (own * other + 1e-12))).sum((3, 4))
    if relative:
        entropy = lambda x: -(x * np.log(x + 1e-12)).sum((3, 4))
        mutual = mutual / (np.minimum(entropy(own), entropy(other)) + 1e-9)
    weight = (total[..., 0, 0] / total[..., 0, 0].sum(0) * mutual).sum(0)
    m = len(weight)
    parent, reach = [-1] * m, np.full(m, -np.inf)
    todo, best = set(range(m)), [-1] * m
    while todo:
        j = max(sorted(todo), key=lambda x: reach[x])
        todo.remove(j)
        parent[j] = best[j] if reach[j] > least else -1
        for k in todo:
            if weight[j, k] > reach[k]:
                reach[k], best[k] = weight[j, k], j
    return parent


#: Least log-odds of a vote that nothing else explains, and of one for an exception to rule.
BETTER, SURE = np.log(3), np.log(100)


class LabelModel:
    """Chances of the voters' votes given the label, by EM over rows of votes (-1, 0, 1).

    A voter's vote has a chance that depends on the label and on the vote of its parent in a tree of dependences, which
    is learned anew every few rounds. Voters are believed to tend to be right: the belief weighs ``belief`` rows and half of
    the rows a voter votes on, and no voter is worse than chance. Abstaining says nothing about the label, and what no voter claims is no case.
    """

    RIGHT = np.array([[[5, 12, 0.5]], [[0.5, 12, 5]]]) / 17.5

    def __init__(self, votes: np.ndarray, sure: np.ndarray | None = None, rounds: int = 30, belief: float = 10.0) -> None:
        """sure: which voters vote for exceptions to rule."""
        rows, times = np.unique(votes[(votes > 0).any(1)], axis=0, return_counts=True)  # few patterns
        n, m = times.sum(), votes.shape[1]
        self.parent, self.ratio, self.prior = [-1] * m, np.zeros((m, 3, 3)), 0.2
        if not n:
            return
        values = np.stack([(rows == v) for v in (-1, 0, 1)], 2).astype(float)
        believed = belief + 0.25 * ((rows != 0) * times[:, None]).sum(0)[None, :, None]
        # The start counts what are nearly copies of each other, whatever the label, once.
        self.parent = _tree(np.einsum("n,njv,nku->jkvu", times, values, values, optimize=True)[None], 0.5, relative=True)
        total = rows[:, [j for j, k in enumerate(self.parent) if k < 0]].sum(1)
        post = np.where(total == 0, 0.2, 1 / (1 + np.exp(-(2.0 * total - 1.0))))
        for r in range(rounds):
            y = np.stack([1 - post, post]) * times
            if r in (4, 10, 16):
                joint = np.einsum("cn,njv,nku->cjkvu", y, values, values, optimize=True)
                self.parent = _tree(joint, max(0.005, 8.0 / n))
            chance = np.einsum("cn,nmv->cmv", y, values) + self.RIGHT * believed
            chance /= chance.sum(2, keepdims=True)
            for j, k in enumerate(self.parent):
                given = np.repeat(chance[:, None, j], 3, axis=1)  # (label, parent's vote, vote)
                if k >= 0:
                    given = np.einsum("cn,nu,nv->cuv", y, values[:, k], values[:, j], optimize=True) + belief * given
                    given /= given.sum(2, keepdims=True)
                self.ratio[j] = np.log(given[1] / given[0])
                # No voter is worse than chance, and one whose parent is silent is better.
                self.ratio[j][:, 2] = np.maximum(self.ratio[j][:, 2], [BETTER * (k < 0), BETTER, BETTER * (k < 0)])
                self.ratio[j][:, 0] = np.minimum(self.ratio[j][:, 0], [-BETTER * (k < 0), -BETTER, -BETTER * (k < 0)])
                if sure is not None and sure[j]:
                    self.ratio[j][:, 0] = np.minimum(self.ratio[j][:, 0], -SURE)
            self.prior = float(np.clip((post * times).sum() / n, 0.05, 0.8))
            post = self.posterior(rows)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = votes.astype(np.int64) + 1
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, k in enumerate(self.parent):
            odds += np.where(votes[:, j] != 0, self.ratio[j][at[:, k] if k >= 0 else 1, at[:, j]], 0)
        return np.where((votes > 0).any(1), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0)


_PART = re.compile(r"\[(\^?)([^\]]+)\]|\.\{(\d+),(\d+)\}|(\.\??)|(\w)")


def made_up(count: int) -> list[str]:
    """Strings of classes as windows may have them: half of them from the voters' patterns with gaps filled, half of
    classes at random. The same at every call."""
    rng = np.random.default_rng(5)
    patterns = [x for _, _, words, p in VOTERS if not words and not set(p) & set("$*!") for x in p.split("|")]
    some = list(ORDER)
    out = []
    for k in range(count):
        window = ""
        if k % 2:
            for m in _PART.finditer(patterns[int(rng.integers(len(patterns)))]):
                chars = [c for c in (m[2] or m[6] or ".") if c in CODE] if not m[1] else []
                n = int(rng.integers(int(m[3]), int(m[4]) + 1)) if m[3] else 1
                for _ in range(n):
                    window += str(rng.choice(chars)) if chars else "." if rng.random() < 0.8 else str(rng.choice(some))
        while len(window) < WINDOW:
            c = "." if rng.random() < (0.85 if k % 2 else 0.7) else str(rng.choice(some))
            window = c + window if rng.random() < 0.5 else window + c
        out.append(window[:WINDOW])
    return out


def _descend(flat: np.ndarray, row: np.ndarray, y: np.ndarray, base: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of a logistic model on top of given scores (Adagrad over all rows)."""
    used, at = np.unique(flat, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    gw, gb = np.full(len(used), 1e-4), 1e-4
    scale = 1.0 + 2.0 * y  # cases are few
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(y)) + bias + base, -30, 30)))
        d = (p - y) * scale / len(y)
        g = np.bincount(at, d[row], len(used)) + decay * w
        gw += g * g
        gb += d.sum() ** 2
        w -= rate * g / np.sqrt(gw)
        bias -= rate * d.sum() / np.sqrt(gb)
    return used, w, bias


def train(features: list[np.ndarray], y: np.ndarray, rounds: tuple[int, int] = (150, 60), rate: float = 0.5, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on soft labels: of runs of classes first, of words for the rest."""
    size = np.array([len(f) for f in features])
    flat = np.concatenate(features)
    row = np.repeat(np.arange(len(size)), size)
    out, score, bias = np.zeros(SIZE, np.float32), np.full(len(y), -2.0), -2.0
    for part, n, r in ((flat >= 1 << BITS, rounds[0], rate), (flat < 1 << BITS, rounds[1], rate / 2)):
        used, w, more = _descend(flat[part], row[part], y, score, n, r, decay)
        out[used] = w
        bias += more
        score = score + more + np.bincount(row[part], out[flat[part]], len(y))
    out[0] = 0  # the bucket of what isn't there
    return out, float(bias)


def learn(votes: np.ndarray, features: list[np.ndarray], invented: int = 24_000) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) of the classifier from windows' votes (-1, 0, 1) and features.

    What the label model says of ``invented`` made-up windows teaches runs of classes that the sample lacks.
    """
    weights, biases = np.zeros((3, SIZE), np.float32), np.full(3, -30.0)
    windows = made_up(invented)
    more = np.frombuffer(b"".join(votes_on([], w) for w in windows), np.uint8).reshape(-1, len(VOTERS)).astype(np.int8)
    more = np.where(more == 2, -1, more)
    runs = []
    for w in windows:
        f = np.unique(buckets(np.array([CODE.get(c, 0) for c in w], np.uint32), np.full(len(w), len(w) - 1))[WORDS:])
        runs.append(f[f > 0])
    for k, c in enumerate(CATEGORIES):
        own = [j for j, v in enumerate(VOTERS) if v[0] == c]
        if not (votes[:, own] > 0).any():
            continue
        model = LabelModel(votes[:, own], np.array([VOTERS[j][1] == -2 for j in own]))
        weights[k], biases[k] = train(features + runs, np.r_[model.posterior(votes[:, own]), model.posterior(more[:, own])])
    return weights, biases


def fit(docs: DataFrame, id_col: str, text_col: str, sample_docs: int = 20_000, negatives: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) of the classifier, fitted on a bounded sample of documents chosen by hash."""
    n = max(1, docs.count())
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, sample_docs / n)
    if share < 1:
        src = src.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The sample is bounded, whatever the table: it is spread over all cores, also where one file holds it.
    src = src.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    got = src.select(F.col("id").cast("string"), "text").mapInArrow(_vote_batches(negatives), "features array<int>, votes binary").toArrow()
    if not got.num_rows:
        return np.zeros((3, SIZE), np.float32), np.full(3, -30.0)
    votes = np.frombuffer(b"".join(got.column("votes").to_pylist()), np.uint8).reshape(-1, len(VOTERS)).astype(np.int8)
    flat = got.column("features").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    offsets, values = np.asarray(flat.offsets), np.asarray(flat.values)
    return learn(np.where(votes == 2, -1, votes), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])


def _score_batches(weights: np.ndarray, biases: np.ndarray):
    table = np.ascontiguousarray(weights.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                hs = [hashes(t, tokens) if t else np.zeros(0, np.uint32) for t in b.column(1).to_pylist()]
                n = np.array([len(h) for h in hs])
                end = np.cumsum(n)
                out = np.zeros((len(hs), 3))
                if end[-1]:
                    f = buckets(np.concatenate(hs), np.repeat(end - 1, n))
                    sums = np.zeros((end[-1] + 1, 3))
                    np.cumsum(table[f].sum(0, dtype=np.float64), axis=0, out=sums[1:])
                    has = np.flatnonzero(n)
                    starts = [windows_of(k) for k in n[has].tolist()]
                    count = np.array([len(s) for s in starts])
                    first = np.concatenate(starts) + np.repeat(end[has] - n[has], count)
                    stop = np.minimum(first + WINDOW, np.repeat(end[has], count))
                    begin, end_ = np.maximum(first - AROUND, np.repeat(end[has] - n[has], count)), np.minimum(stop + AROUND, np.repeat(end[has], count))
                    # The lower of a window and the window with its surroundings: what follows may put it right.
                    best = np.maximum.reduceat(np.minimum(sums[stop] - sums[first], sums[end_] - sums[begin] + SLACK), np.r_[0, np.cumsum(count)[:-1]], axis=0)
                    out[has] = 1 / (1 + np.exp(-np.clip(best + biases, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.round(out[:, k], 6)) for k in range(3))], names=["doc_id", *CATEGORIES])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000) -> DataFrame:
    """(doc_id, abusive, hateful, sexual): scores of every document."""
    weights, biases = fit(docs, id_col, text_col, sample_docs)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_score_batches(weights, biases), "doc_id long, abusive double, hateful double, sexual double")


def flagged(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, category) of the categories at or above the threshold."""
    each = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES))
    return scores.select("doc_id", F.explode(each).alias("x")).where(F.col("x.score") >= threshold).select("doc_id", "x.category")


def rates(docs: DataFrame, scores: DataFrame, id_col: str, source_col: str, threshold: float = 0.5) -> DataFrame:
    """(source, documents, abusive, hateful, sexual): documents of each source and the share at the threshold."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"))
    return d.join(scores, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), *(F.round(F.avg((F.col(c) >= threshold).cast("double")), 6).alias(c) for c in CATEGORIES))
