"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), applied once a distinct lexeme."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiou"
# Rules of steps 2, 3 and 4: suffix and what takes its place (published values).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _consonant(w: str, i: int) -> bool:
    return not (w[i] in VOWELS or w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


def stem(w: str) -> str:
    """The stem of a lower-case word; words of up to two letters and words with other characters stay as they are."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := next((n for s, n in (("ed", 2), ("ing", 3)) if w.endswith(s)), 0)) and _vowel(w[:-cut]):
        w = w[:-cut]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = max((r for r in rules if w.endswith(r)), key=len, default=None)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = max((r for r in STEP4 if w.endswith(r)), key=len, default=None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stems(lexemes: DataFrame, column: str = "lexeme") -> DataFrame:
    """(lexeme, stem) of every distinct lexeme."""

    @F.pandas_udf("string")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(stem)

    return lexemes.select(F.col(column).alias("lexeme")).distinct().withColumn("stem", apply("lexeme"))
