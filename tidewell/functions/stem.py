"""English suffix stripping as published by M. F. Porter in 1980."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# The suffix rules of the paper's steps 2, 3 and 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), "")


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def short_end(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The rule of the longest matching suffix, if what precedes it measures more than `least`."""
    for n in range(min(7, len(word)), 1, -1):
        if word[-n:] in rules:
            rest = word[:-n]
            fits = measure(rest) > least and (word[-n:] != "ion" or rest[-1:] in ("s", "t"))
            return rest + rules[word[-n:]] if fits else word
    return word


def stem(word: str) -> str:
    """The stem of one lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        cut = next((n for s, n in (("ed", 2), ("ing", 3)) if word.endswith(s) and "v" in shape(word[:-n])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-2:-1] == word[-1:] and shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and short_end(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(replaced(word, STEP_2, 0), STEP_3, 0), STEP_4, 1)
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stemmed(terms: DataFrame) -> DataFrame:
    """The rows of (term, freq) with their stem; terms are distinct, so each is stemmed once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(stem=[stem(t) for t in rows["term"]])

    return terms.select("term", "freq").mapInPandas(work, "term string, freq long, stem string")


@pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of the words of each row, in order; within a batch each distinct word is stemmed once."""
    known: dict[str, str] = {}
    return words.map(lambda row: None if row is None else [known.get(w) or known.setdefault(w, stem(w)) for w in row])
