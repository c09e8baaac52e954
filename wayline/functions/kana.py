"""Kana readings in Latin letters: modified Hepburn without long marks."""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The syllables by consonant, in the order a i u e o, and those that break the rule.
ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
ODD = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "N", "ゔ": "vu", "ー": "", "〜": "", "っ": "Q", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o"}
GLIDES = {"ゃ": "a", "ゅ": "u", "ょ": "o"}

_SYLLABLES = {k: c + v for c, row in ROWS.items() for k, v in zip(row, "aiueo")} | ODD
for _k, _small in product([row[1] for row in ROWS.values() if row != ROWS[""]], GLIDES):
    _stem = _SYLLABLES[_k][:-1]
    _SYLLABLES[_k + _small] = _stem + ("" if _stem in ("sh", "ch", "j") else "y") + GLIDES[_small]
_PATTERN = re.compile("|".join(sorted(map(re.escape, _SYLLABLES), key=len, reverse=True)))


def romanize(kana: str | None) -> str | None:
    """A reading in kana, blanks and middle dots; with any other character, or empty, there is none."""
    if not kana or not kana.strip():
        return None
    text = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヴ" else c for c in kana.strip())
    words = []
    for word in re.split(r"[ 　・]+", text):
        if _PATTERN.sub("", word):
            return None
        parts = [_SYLLABLES[m] for m in _PATTERN.findall(word)]
        # long vowels: u after o or u, and o after o, fall away when they are syllables of their own
        out = ""
        for p in parts:
            if not (p == "u" and out[-1:] in ("o", "u") or p == "o" and out[-1:] == "o"):
                out += p
        out = re.sub(r"Q(?=ch)", "t", out)
        out = re.sub(r"Q([b-df-hj-np-tv-z])", r"\1\1", out).replace("Q", "")
        out = re.sub(r"N(?=[aiueoy])", "n'", out).replace("N", "n")
        if out:
            words.append(out[0].upper() + out[1:])
    return " ".join(words) or None


def romanized(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(romanize)

    return run(c)
