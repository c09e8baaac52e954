"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE vocabulary, one "base64 rank" per line; every worker reads the file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's texts are split into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a ranks file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


#: A text is encoded in stretches of at most so many characters, cut at blanks; a longer word is cut as it is.
STRETCH = 100_000


def encode(text: str, path: str = TOKENIZER) -> list[int]:
    enc = encoder(path)
    if len(text) <= STRETCH:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        if end < len(text) and (space := text.rfind(" ", at + 1, end)) > at:
            end = space
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, blanks off, hyphens; empty is null."""
    x = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[\s_]+", "-")
    return F.when(x != "", x)


def language(c: Column) -> Column:
    """The language's code of two or three letters, 'und' for everything else."""
    return F.coalesce(F.when((x := F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_]|$)", 1)) != "", x), F.lit("und"))


def with_sizes(docs: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and n_tokens; null texts have none."""
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    names = [*keep, "n_tokens"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter((len(encode(t, path)) for t in b.column(len(keep)).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n)], names)

    return rows.mapInArrow(run, ddl)
