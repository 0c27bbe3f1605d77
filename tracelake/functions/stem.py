"""The Porter stemmer (1980), for distinct words only: stem a vocabulary and join it back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The endings of steps 2 to 4, longest first, with what replaces them.
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(" ")) for x in text.split(",")), key=lambda x: -len(x[0]))


_STEP2, _STEP3 = _table(STEP2), _table(STEP3)
_STEP4 = sorted(STEP4.split(), key=lambda x: -len(x))


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and k > 0 and out[k - 1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    shape = _shape(stem)
    return sum(1 for a, b in zip(shape, shape[1:], strict=False) if a == "v" and b == "c")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: list[tuple[str, str]]) -> str:
    for ending, other in endings:
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + other if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words that are not ASCII letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    for ending, other in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: -len(ending)] + other
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending) and "v" in _shape(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2), _STEP3)
    for ending in _STEP4:
        if word.endswith(ending):
            root = word[: -len(ending)]
            if _measure(root) > 1 and (ending != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or _measure(root) == 1 and not _short(root):
            word = root
    return word[:-1] if _measure(word) > 1 and _doubled(word) and word.endswith("l") else word


def stemmed(tokens: DataFrame, column: str = "term") -> DataFrame:
    """``tokens`` with ``column`` stemmed; each distinct word is stemmed once."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    known = tokens.select(column).distinct().withColumn("_stem", stems(column))
    return tokens.join(known, column).withColumn(column, F.col("_stem")).drop("_stem")
