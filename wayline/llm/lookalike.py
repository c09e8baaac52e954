"""Look-alike text to one form: the confusables skeleton.

Decompose, replace every character by its prototype, decompose again.  Case, accents,
digits and punctuation stay distinct; width, encoding, invisible characters, kinds of
blank and letters of other scripts that are drawn alike do not.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.session import cut

# Letters of other scripts and the Latin letters they are drawn like.
LOOK_ALIKE = {
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Armenian
    "Լ": "L", "Տ": "S", "Ս": "U", "Օ": "O", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲓ": "i", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin variants drawn as the plain letter
    "ɑ": "a", "ɡ": "g",
    # punctuation drawn alike
    "‐": "-", "‑": "-", "ʼ": "’", "‛": "‘", "٫": ",", "։": ":", "∶": ":", "ꓸ": ".", "⁄": "/", "∕": "/",
}
# Characters that show nothing and are neither controls nor format characters.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
# Kinds of compatibility decomposition that keep the look of a character.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")


def read_prototypes(path: str) -> dict[str, str]:
    """A table of look-alikes in the public form of one "code ; codes ; class # note" per line (code points in hexadecimal), to be given to skeleton()."""
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [x.strip() for x in line.split("#", 1)[0].split(";")]
            if len(parts) >= 2 and parts[0]:
                source = "".join(chr(int(x, 16)) for x in parts[0].split())
                if len(source) == 1:
                    out[source] = "".join(chr(int(x, 16)) for x in parts[1].split())
    return out


class _Prototypes(dict):
    """str.translate table that works out each character once."""

    def __init__(self, table: dict[str, str]):
        self.table = table

    def __missing__(self, code: int) -> str:
        self[code] = out = self._prototype(chr(code))
        return out

    def _prototype(self, c: str) -> str:
        code, kind = ord(c), unicodedata.category(c)
        if c in "\t\n\v\f\r\x85" or kind in ("Zs", "Zl", "Zp"):
            return " "
        if kind in ("Cf", "Cc") or code in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF or 0x180B <= code <= 0x180F:
            return ""
        if c in self.table:
            return self.table[c]
        # small Greek and Cyrillic letters that have a prototype only as part of a decomposition are left to it
        if unicodedata.decomposition(c).startswith(SAME_LOOK):
            return "".join(self[ord(x)] for x in unicodedata.normalize("NFKD", c))
        return c


_TABLE = _Prototypes(LOOK_ALIKE)
_by_path: dict[str, _Prototypes] = {}


def skeleton(s: str | None, prototypes: str | None = None) -> str | None:
    """The form by which texts that look the same are equal; null stays null.

    ``prototypes``: a file of further look-alikes (read_prototypes), which come before the built-in ones."""
    if s is None:
        return None
    if prototypes is None:
        if s.isascii() and s.isprintable():
            return s if "  " not in s else " ".join(filter(None, s.split(" ")))
        table = _TABLE
    elif (table := _by_path.get(prototypes)) is None:
        table = _by_path[prototypes] = _Prototypes(LOOK_ALIKE | read_prototypes(prototypes))
    x = unicodedata.normalize("NFD", s).translate(table)
    x = unicodedata.normalize("NFD", x)
    if "ı" in x:  # a dotless i under an accent shows as an i does; by itself it doesn't
        x = "".join("i" if c == "ı" and unicodedata.combining(x[i + 1 : i + 2] or "a") == 230 else c for i, c in enumerate(x))
    return " ".join(x.split(" ")) if "  " not in x else " ".join(filter(None, x.split(" ")))


def skeleton_column(c: Column, prototypes: str | None = None, composed: bool = False) -> Column:
    """The skeleton without outer blanks; ``composed``: with letters and accents as one character where there is one."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {v: skeleton(v, prototypes).strip(" ") for v in s.unique() if v is not None}
        if composed:
            known = {k: unicodedata.normalize("NFC", v) for k, v in known.items()}
        return s.map(known.get)

    return run(c)


def with_skeleton(df: DataFrame, text: str, out: str = "skeleton", prototypes: str | None = None) -> DataFrame:
    """Adds the skeleton of ``text``; each distinct batch value is worked out once."""
    return df.withColumn(out, skeleton_column(F.col(text), prototypes))


def lookalike_groups(df: DataFrame, text: str) -> DataFrame:
    """(skeleton, spellings, rows): skeletons written in more than one way.  Texts that show nothing are left out."""
    x = with_skeleton(df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n")), text)
    return x.where("skeleton <> ''").groupBy("skeleton").agg(F.count("*").alias("spellings"), F.sum("n").alias("rows")).where("spellings > 1")


def lookalike_classes(df: DataFrame, id_col: str, text: str, prototypes: str | None = None) -> DataFrame:
    """(id, text, skeleton, class, rows): one row per id and text; class: the smallest spelling of the skeleton, rows: how many of this spelling.

    Null texts, null ids and texts that show nothing take no part; repeated rows count once.  Skeletons are worked out once per spelling."""
    ids = df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text")).distinct()
    spelled = _spellings(ids, prototypes)
    least = spelled.groupBy("skeleton").agg(F.min("text").alias("class"))
    return ids.join(spelled, "text").join(least, "skeleton").select("id", "text", "skeleton", "class", "rows")


def _spellings(ids: DataFrame, prototypes: str | None) -> DataFrame:
    """(text, skeleton, rows), written once: Python sees each spelling once, whatever is made of it."""
    return cut(with_skeleton(ids.groupBy("text").agg(F.count("*").alias("rows")), "text", "skeleton", prototypes).where("skeleton <> ''"))


def lookalike_pairs(df: DataFrame, id_col: str, text: str, prototypes: str | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids whose texts differ in their characters and have one skeleton.

    Null texts and those that show nothing take no part; repeated rows count once.  Spellings are paired first, of which a skeleton has
    few, and then given their ids: those of a frequent spelling are split by the skew join of adaptive execution."""
    ids = cut(df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text")).distinct())
    spelled = _spellings(ids, prototypes)
    a, b = spelled.select("skeleton", F.col("text").alias("a")), spelled.select("skeleton", F.col("text").alias("b"))
    pairs = a.join(b, "skeleton").where("a <> b").select("a", "b")
    x = pairs.join(ids.select(F.col("text").alias("a"), F.col("id").alias("id_a")), "a")
    return x.join(ids.select(F.col("text").alias("b"), F.col("id").alias("id_b")), "b").where("id_a < id_b").select("id_a", "id_b").distinct()
