"""Items into containers of fixed capacity by lexical retrieval.

Records are dealt to shards of one language and about SHARD records or SHARD_BYTES.  Each shard has a
BM25 inverted index of its records' tokens.  The largest unused record opens a container;
its nearest unused records fill it, best first, and once little room is left the nearest of those
that close the gap.  Containers that stay too empty are opened again: the records of several shards of one language get an
index of their own and are filled in the same way.  Only what is then still too empty, the ends of a group, is packed by best fit, across languages.
Records larger than a container fill whole containers with their first parts; only the rest is an item.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.tokens import TOKENIZER, encode, language
from wayline.session import cut

#: Records and bytes of text per shard, about; a shard is packed by one task and its index is in memory.
SHARD, SHARD_BYTES = 2048, 32 << 20
#: Kinds of container; their table is small by contract and is checked.
MOST_CONTAINERS = 1000
K1, B = 1.2, 0.75
#: A container is full enough when less than this share is free; gaps are closed in the last part of it.
SLACK, LAST = 1 / 64, 1 / 2
#: Containers filled less than this are packed again, those of so many shards together.
REPACK, TOGETHER = 0.97, 16
SHARDS_DDL = "shard long, id long, n long, terms binary"
OUT = "container string, capacity int, bin string, id long, part int, token_from long, token_to long, n_tokens long, place int, how string"
#: ``team``: the shards of one language whose poor containers are packed again together.
OPEN = f"{OUT}, team long, terms binary"


class Index:
    """BM25 over one shard: terms that more than half of its records have weigh nothing."""

    def __init__(self, terms: list[bytes]):
        n = len(terms)
        ids, tfs, owner = [], [], []
        for i, t in enumerate(terms):
            a = np.frombuffer(t, "<u4").reshape(2, -1)
            ids.append(a[0])
            tfs.append(a[1])
            owner.append(np.full(a.shape[1], i, np.int32))
        self.n = n
        if not n:
            return
        t, tf, d = np.concatenate(ids), np.concatenate(tfs).astype(np.float32), np.concatenate(owner)
        length = np.bincount(d, tf, minlength=n)
        order = np.argsort(t, kind="stable")
        t, tf, d = t[order], tf[order], d[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
        df = np.diff(np.append(first, len(t)))
        idf = np.where(df * 2 > n, 0.0, np.log1p((n - df + 0.5) / (df + 0.5)))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1e-9))
        self.owner = d
        self.weight = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[d])).astype(np.float32)
        row = np.repeat(np.arange(len(df)), df)
        keep = (idf[row] > 0) & (df[row] > 1)
        by_doc = np.argsort(d[keep], kind="stable")
        self.rows = row[keep][by_doc]
        self.row_of = np.searchsorted(d[keep][by_doc], np.arange(n + 1))
        self.begin, self.end = first, first + df
        self.known: dict[int, np.ndarray] = {}

    def scores(self, seed: int) -> np.ndarray:
        """Of every record for the seed's terms."""
        if seed not in self.known:
            rows = self.rows[self.row_of[seed] : self.row_of[seed + 1]]
            if not len(rows):
                return np.zeros(self.n, np.float32)
            b, e = self.begin[rows], self.end[rows]
            size = e - b
            at = np.repeat(b - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.known[seed] = np.bincount(self.owner[at], self.weight[at], minlength=self.n).astype(np.float32)
        return self.known[seed]


def fill(sizes: np.ndarray, capacity: int, index: Index) -> list[list[int]]:
    """Items of at most ``capacity`` to containers; items of size 0 are in none."""
    order = np.argsort(-sizes, kind="stable")
    unused = sizes > 0
    least = np.sort(sizes[unused])
    out = []
    gap = max(1, int(capacity * SLACK))
    for seed in order:
        if not unused[seed]:
            continue
        unused[seed] = False
        box, room = [int(seed)], capacity - int(sizes[seed])
        if room and len(least) and room >= least[0]:
            score = index.scores(int(seed))
            fits = np.flatnonzero(unused & (sizes <= room))
            fits = fits[np.argsort(-score[fits], kind="stable")]
            while len(fits):
                size = sizes[fits]
                if room <= capacity * LAST:
                    close = np.flatnonzero(size >= room - gap)
                    if len(close):
                        at = int(close[0])
                    elif room <= capacity * LAST / 2:
                        at = int(np.argmax(size))  # the largest that fits; the nearest of equals
                    else:
                        at = 0
                else:
                    at = 0
                i = int(fits[at])
                box.append(i)
                unused[i] = False
                room -= int(sizes[i])
                fits = np.delete(fits, at)
                fits = fits[sizes[fits] <= room]
        out.append(box)
    return out


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, largest first, to the fullest container that has room."""
    room: list[tuple[int, int]] = []
    boxes: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(boxes)
            boxes.append([])
        boxes[b].append(i)
        insort(room, (free - sizes[i], b))
    return boxes


def _deal(path: str, shards: dict[str, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, n, terms = [], [], []
            for h, lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                ids = encode(text, path)
                first, count = shards[lang]
                shard.append(first + h % count)
                n.append(len(ids))
                t, tf = np.unique(np.array(ids, np.uint32), return_counts=True)
                terms.append(np.concatenate([t, tf]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary())], ["shard", "id", "n", "terms"])

    return run


def pack(docs: DataFrame, containers: DataFrame, id_col: str, text: str, lang: str, path: str = TOKENIZER, shard_rows: int = SHARD) -> DataFrame:
    """One row per container's content: container, capacity, bin, id, part, token_from, token_to, n_tokens, place, how.

    ``containers`` is a dimension table (container, capacity); rows without a capacity above 0 are left out.  Every token of
    every text is in exactly one bin per container; texts without tokens are in none.  how: 'whole' (a first
    part of a text larger than the container, filling it), 'seed', 'near' (placed by retrieval) or 'fit' (placed by size after that).
    """
    found = containers.where("capacity > 0").select("container", "capacity").distinct().orderBy("capacity", "container").limit(MOST_CONTAINERS + 1).collect()
    if len(found) > MOST_CONTAINERS:
        raise ValueError(f"at most {MOST_CONTAINERS} kinds of container")
    kinds = [(r.container, int(r.capacity)) for r in found]
    if not kinds:
        return docs.sparkSession.createDataFrame([], OUT)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.abs(F.xxhash64(id_col) % (1 << 40)).alias("h"), language(F.col(lang)).alias("lang"), F.coalesce(text, F.lit("")).alias("text")).where("id is not null")
    # at most 26^2 + 26^3 + 1 languages, by the form of their codes
    sizes = {r.lang: (r.n, r.bytes) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    shards, first, firsts, teams, team = {}, 0, [], [], 0
    for k in sorted(sizes):
        n = max(-(-sizes[k][0] // shard_rows), -(-sizes[k][1] // SHARD_BYTES))
        shards[k] = (first, n)
        firsts.append(first)
        teams.append(team)
        first, team = first + n, team - (-n // TOGETHER)
    dealt = rows.mapInArrow(_deal(path, shards), SHARDS_DDL).where("n > 0")

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        shard, ids, n = int(pdf["shard"].iloc[0]), pdf["id"].to_numpy(), pdf["n"].to_numpy(np.int64)
        of = bisect_right(firsts, shard) - 1
        own = teams[of] + (shard - firsts[of]) // TOGETHER
        terms = np.array(pdf["terms"].tolist(), object)
        index = Index(terms.tolist())
        parts = []
        for name, cap in kinds:
            whole = np.where(n > cap, n // cap, 0)
            w = np.repeat(np.arange(len(n)), whole)
            k = np.arange(len(w)) - np.repeat(np.cumsum(whole) - whole, whole)
            parts.append(pd.DataFrame({"container": name, "capacity": cap, "bin": [f"{shard}.{ids[i]}.{j}" for i, j in zip(w, k)], "id": ids[w], "part": k, "token_from": k * cap, "token_to": (k + 1) * cap, "n_tokens": cap, "place": 0, "how": "whole", "team": own, "terms": None}))
            rest = n - whole * cap
            box, place, i, poor = _boxes(fill(rest, cap, index), rest, cap)
            parts.append(pd.DataFrame({"container": name, "capacity": cap, "bin": [f"{shard}.{b}" for b in box], "id": ids[i], "part": whole[i], "token_from": whole[i] * cap, "token_to": n[i], "n_tokens": rest[i], "place": place, "how": np.where(poor, "again", np.where(place == 0, "seed", "near")), "team": own, "terms": np.where(poor, terms[i], None)}))
        return pd.concat(parts, ignore_index=True)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part"], ignore_index=True)
        own, cap, rest = int(pdf["team"].iloc[0]), int(pdf["capacity"].iloc[0]), pdf["n_tokens"].to_numpy(np.int64)
        box, place, i, poor = _boxes(fill(rest, cap, Index(pdf["terms"].tolist())), rest, cap)
        out = pdf.iloc[i].reset_index(drop=True)
        return out.assign(bin=[f"t{own}.{b}" for b in box], place=place, how=np.where(poor, "last", np.where(place == 0, "seed", "near")), terms=None)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part"], ignore_index=True)
        own, cap = int(pdf["team"].iloc[0]) // TOGETHER, int(pdf["capacity"].iloc[0])
        bins, place = [""] * len(pdf), [0] * len(pdf)
        for b, items in enumerate(best_fit(pdf["n_tokens"].tolist(), cap)):
            for p, i in enumerate(items):
                bins[i], place[i] = f"f{own}.{b}", p
        return pdf.assign(bin=bins, place=place, how="fit")

    packed = cut(dealt.groupBy("shard").applyInPandas(one_shard, OPEN))
    redone = cut(packed.where("how = 'again'").groupBy("container", "team").applyInPandas(again, OPEN))
    last = redone.where("how = 'last'").groupBy("container", F.floor(F.col("team") / TOGETHER)).applyInPandas(fit, OPEN)
    return packed.where("how <> 'again'").unionByName(redone.where("how <> 'last'")).unionByName(last).drop("team", "terms")


def _boxes(boxes: list[list[int]], sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Box, place, item and whether the box is poor, for each item in a box."""
    i = np.array([x for b in boxes for x in b], np.int64)
    lens = np.array([len(b) for b in boxes], np.int64)
    box = np.repeat(np.arange(len(boxes)), lens)
    place = np.arange(len(i)) - np.repeat(np.cumsum(lens) - lens, lens)
    load = np.bincount(box, sizes[i], minlength=len(boxes)) if len(i) else np.zeros(0)
    return box, place, i, load[box] < capacity * REPACK


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, bins, tokens, fill): the share of the bins' room that is used."""
    return packed.groupBy("container", "capacity").agg(F.countDistinct("bin").alias("bins"), F.sum("n_tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))
