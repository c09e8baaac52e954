"""Exact stretches shared between records, by a count-min prefilter.

Every window of ``length`` characters has a minimizer: the smallest hash among its grams.
Equal windows have equal minimizers, and neighbouring windows mostly share theirs, so few
grams stand for all windows.  First pass: each partition counts its records' minimizers in
a count-min sketch; merged, the sketch never says less than the true count.  Second pass:
windows whose minimizer may occur in a second record are sent, as pieces of text with one
minimizer each, to its group and compared as text.  No shared window can be lost, and what
the sketch lets through wrongly is dropped by the exact comparison.

The sketch is made of blocks by hash range, each a small count-min sketch of its own, so it grows with the
texts.  Up to BROADCAST_BITS its blocks are sent to the workers; a larger one stays a table, and the
records' minimizers are joined with it by block.  Both ways let the same windows through.

Frequent texts: equal pieces are joined where they arise, one copy goes on, and grams that
very many records hold send single windows by their own hash instead of by the gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import cut, shuffle_width

#: Characters hashed at once; longer texts are cut into overlapping segments.
CHUNK = 1 << 20
ROWS = 2
BLOCK_BITS = 16
#: The sketch's width in cells is four times the expected grams, so that about one in twenty that occur once passes, at least 2^MIN_BITS;
#: up to 2^BROADCAST_BITS cells (2 x 32 MB of bits) it is sent to the workers.
MIN_BITS, BROADCAST_BITS = 16, 28
#: Minimizers that a task gathers before it sends their counts on.
GATHERED = 4_000_000
#: Grams that at least so many records may hold are split by window.
HOT = 20_000
# Odd multipliers of the rolling hash and of the sketch's rows.
BASE = 0x9E3779B97F4A7C15
FINAL = np.uint64(0xD6E8FEB86659FD93)
ROW_MULTIPLIERS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_cache: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _cache:
        n = CHUNK + 4096
        for name, b in (("pw", BASE), ("ip", pow(BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _cache[name] = np.multiply.accumulate(p)
        _cache["mix"] = _mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED270B))
    return _cache["pw"], _cache["ip"], _cache["mix"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FINAL
    x = (x ^ (x >> np.uint64(32))) * FINAL
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of one array of code points."""

    def __init__(self, cp: np.ndarray):
        pw, self.ip, mix = _tables()
        self.sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mix[cp] * pw[: len(cp)], out=self.sums[1:])

    def grams(self, m: int) -> np.ndarray:
        return _mix((self.sums[m:] - self.sums[:-m]) * self.ip[: len(self.sums) - m])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.ip[a]) ^ _mix((b - a).astype(np.uint64))


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours."""
    size = 1
    while size * 2 <= w:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (w - size)], g[w - size :]) if size < w else g


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def segments(ids, texts: pa.Array, length: int, chunk: int = CHUNK) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined text, its bounds, record ids and offsets in the record, about ``chunk`` characters at a time.
    Texts shorter than ``length`` have no window and are skipped; long ones come in segments that overlap by length - 1."""
    long_enough = np.flatnonzero(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False) >= length)
    parts: list[str] = []
    doc: list[int] = []
    base: list[int] = []
    size = 0

    def out():
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return "".join(parts), bounds, np.array(doc, np.int64), np.array(base, np.int64)

    for i in long_enough:
        t = texts[int(i)].as_py()
        for at in range(0, len(t) - length + 1, chunk - length + 1):
            piece = t[at : at + chunk] if len(t) > chunk else t
            if size and size + len(piece) > chunk:
                yield out()
                parts, doc, base, size = [], [], [], 0
            parts.append(piece)
            doc.append(int(ids[i]))
            base.append(at)
            size += len(piece)
    if parts:
        yield out()


def minimizer_runs(h: Hashes, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: first window, end, minimizer, segment."""
    key = sliding_min(h.grams(gram), length - gram + 1)
    edge = np.zeros(len(key) + 1, bool)
    edge[1:-1] = key[1:] != key[:-1]
    edge[bounds[:-1][bounds[:-1] < len(edge)]] = True
    last = bounds[1:] - length + 1
    edge[last] = True
    edge[0] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(key))
    seg = np.searchsorted(bounds, starts, "right") - 1
    ok = starts < last[seg]
    starts, ends, seg = starts[ok], ends[ok], seg[ok]
    return starts, ends, key[starts], seg


def cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its cells (one per row, counted through the rows) within the block; ``bits``: log2 of the cells of a row."""
    x = _mix(keys ^ np.uint64(0x2545F4914F6CDD1D))
    block = (x >> np.uint64(64 - (bits - BLOCK_BITS))).astype(np.int64) if bits > BLOCK_BITS else np.zeros(len(x), np.int64)
    inner = [(row << BLOCK_BITS) + ((x * np.uint64(m)) >> np.uint64(64 - BLOCK_BITS)).astype(np.int64) for row, m in enumerate(ROW_MULTIPLIERS)]
    return block, np.array(inner)


def _gathered(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Minimizers and their records, each once per record of a chunk, some GATHERED at a time."""
    keys: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    for b in batches:
        for text, bounds, doc, _ in segments(b.column(0).to_numpy(zero_copy_only=False), b.column(1), length):
            _, _, key, seg = minimizer_runs(Hashes(code_points(text)), bounds, length, gram)
            # a record counts once: what it repeats itself is no reason to look further
            _, first = np.unique(pair_hash(key, doc[seg]), return_index=True)
            keys.append(key[first])
            docs.append(doc[seg][first])
        if sum(map(len, keys)) > GATHERED:
            yield np.concatenate(keys), np.concatenate(docs)
            keys, docs = [], []
    if keys:
        yield np.concatenate(keys), np.concatenate(docs)


def pair_hash(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return key ^ _mix(doc.view(np.uint64))


def _sketch_part(length: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in _gathered(batches, length, gram):
            block, inner = cells(keys, bits)
            cell, n = np.unique(((block << (BLOCK_BITS + 1)) + inner).ravel(), return_counts=True)
            of = cell >> (BLOCK_BITS + 1)
            at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            low, n = (cell & ((2 << BLOCK_BITS) - 1)).astype("<u4"), np.minimum(n, 0xFFFFFFFF).astype("<u4")
            payload = [x.tobytes() + c.tobytes() for x, c in zip(np.split(low, at[1:]), np.split(n, at[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(of[at], pa.int64()), pa.array(payload, pa.binary())], ["block", "counts"])

    return run


def _merge_blocks(hot: int):
    """Counts of a partition sorted by block, one block at a time, to the bits of the cells counted twice and the cells counted ``hot`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary()), pa.array([np.flatnonzero(total >= hot).astype("<u4").tobytes()], pa.binary())], ["block", "twice", "hot"])

        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != now:
                    if now is not None:
                        yield out()
                    now, total = block, np.zeros(ROWS << BLOCK_BITS, np.int64)
                n = len(counts) // 8
                total[np.frombuffer(counts, "<u4", n)] += np.frombuffer(counts, "<u4", n, 4 * n)
        if now is not None:
            yield out()

    return run


def count_min(docs: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """(block, twice, hot): the merged sketch, one row per block; a block that nothing falls in has none."""
    parts = docs.mapInArrow(_sketch_part(length, gram, bits), "block long, counts binary")
    return parts.repartition(shuffle_width(docs.sparkSession), "block").sortWithinPartitions("block").mapInArrow(_merge_blocks(HOT), "block long, twice binary, hot binary")


class Sketch:
    """Blocks of the merged sketch, to be asked for keys."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], bits: int):
        rows = sorted(rows, key=lambda r: r[0])
        self.bits = bits
        self.block = np.array([r[0] for r in rows], np.int64)
        self.twice = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        hot = [np.frombuffer(r[2], "<u4").astype(np.int64) + (r[0] << (BLOCK_BITS + 1)) for r in rows]
        self.hot = np.sort(np.concatenate([np.empty(0, np.int64), *hot]))

    def ask(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys may occur in a second record, and which may occur in HOT records."""
        block, inner = cells(keys, self.bits)
        if not len(self.block):
            return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.block, block), len(self.block) - 1)
        may, often = self.block[at] == block, np.ones(len(keys), bool)
        for row in range(ROWS):
            may &= _has_bit(self.twice, (at << (BLOCK_BITS + 1)) + inner[row])
            often &= _in_sorted(self.hot, (block << (BLOCK_BITS + 1)) + inner[row])
        return may, often & may


def _has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _in_sorted(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(at), bool)
    return values[np.minimum(np.searchsorted(values, at), len(values) - 1)] == at


def _keys_part(length: int, gram: int, bits: int, with_doc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, docs in _gathered(batches, length, gram):
            if with_doc:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs)], ["key", "doc"])
            else:
                keys = np.unique(keys)
                yield pa.RecordBatch.from_arrays([pa.array(cells(keys, bits)[0]), pa.array(keys.view(np.int64))], ["block", "key"])

    return run


def _look_up(bits: int):
    """Rows of a partition sorted by block, a block's own row before the keys that ask it: (key, often) of the keys that may occur twice, each once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[int, bytes, bytes]] = []
        for b in batches:
            held = pc.is_valid(b.column(2)).to_numpy(zero_copy_only=False)
            own = b.filter(pa.array(held))
            rows = last + list(zip(own.column(0).to_pylist(), own.column(2).to_pylist(), own.column(3).to_pylist()))
            asked = np.unique(b.column(1).filter(pa.array(~held)).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
            if len(asked):
                may, often = Sketch(rows, bits).ask(asked)
                yield pa.RecordBatch.from_arrays([pa.array(asked[may].view(np.int64)), pa.array(often[may])], ["key", "often"])
            last = rows[-1:]

    return run


def marked(rows: DataFrame, sketch: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """``rows`` with ``keys`` and ``often``: each record's minimizers that may occur in a second record, by a join with the sketch by block.

    Keys ask once per task, so a block is asked for a frequent gram as often as there are tasks, not records; records that share a gram meet
    it in a join of keys, which adaptive execution splits where one key is frequent."""
    wide = max(shuffle_width(rows.sparkSession), 1 << max(0, bits - BLOCK_BITS - 10))
    none = F.lit(None).cast("binary")
    ask = rows.mapInArrow(_keys_part(length, gram, bits, False), "block long, key long").select("block", "key", none.alias("twice"), none.alias("hot"), F.lit(1).alias("side"))
    own = sketch.select("block", F.lit(None).cast("long").alias("key"), "twice", "hot", F.lit(0).alias("side"))
    found = own.unionByName(ask).repartition(wide, "block").sortWithinPartitions("block", "side").select("block", "key", "twice", "hot").mapInArrow(_look_up(bits), "key long, often boolean")
    found = found.groupBy("key").agg(F.max("often").alias("often"))
    keys = rows.mapInArrow(_keys_part(length, gram, bits, True), "key long, doc long")
    # a record's minimizers are fewer than its characters
    per = keys.join(found.hint("merge"), "key").groupBy("doc").agg(F.collect_list("key").alias("keys"), F.collect_list("often").alias("often"))
    return rows.join(per.hint("merge"), rows["id"] == per["doc"]).select("id", "text", "keys", "often")


class Marks:
    """Minimizers of a batch's records that may occur in a second one."""

    def __init__(self, b: pa.RecordBatch):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        keys, often = b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool)
        both = pair_hash(keys.view(np.uint64), np.repeat(ids, n))
        self.all, self.hot = np.sort(both), np.sort(both[often])

    def ask(self, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = pair_hash(keys, docs)
        return _in_sorted(self.all, both), _in_sorted(self.hot, both)


PIECES = pa.schema([("k", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("piece", pa.string())])
PIECES_DDL = "k long, doc long, start long, n int, piece string"


def _pieces_part(length: int, gram: int, sketch=None):
    """Pieces of the records' texts, by a sketch that was sent to the workers or by the rows' own marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = Marks(b) if sketch is None else None
            for text, bounds, doc, base in segments(b.column(0).to_numpy(zero_copy_only=False), b.column(1), length):
                h = Hashes(code_points(text))
                s, e, key, seg = minimizer_runs(h, bounds, length, gram)
                may, often = sketch.value.ask(key) if marks is None else marks.ask(key, doc[seg])
                s, e, key, seg, often = s[may], e[may], key[may], seg[may], often[may]
                if len(s):
                    yield _piece_rows(text, h, s, e, key.view(np.int64), doc[seg], base[seg] - bounds[seg], often, length)

    return run


def _piece_rows(text: str, h: Hashes, s, e, key, doc, shift, often, length: int) -> pa.RecordBatch:
    """Rows of one chunk: equal pieces of several records are settled here (rows without text) and one copy goes on
    for others to find (doc null); every other piece goes on as it is."""
    same = h.between(s, e + length - 1).astype(np.int64)
    alike = np.flatnonzero(_several(same, doc)[0])
    # equal hashes are held against each other as texts; what differs is a group of its own
    exact = pd.factorize(np.array([text[x:y] for x, y in zip(s[alike].tolist(), (e[alike] + length - 1).tolist())], object))[0] if len(alike) else alike
    same = np.arange(len(s)) + len(s)
    same[alike] = exact
    settled, order, at = _several(same, doc)
    copy = order[at[settled[order[at]]]]
    alone = np.flatnonzero(~settled)
    done = np.flatnonzero(settled)
    go = np.concatenate([alone, copy])
    nobody = np.concatenate([np.zeros(len(alone), bool), np.ones(len(copy), bool)])
    k_out, d_out, s_out, n_out, p_out, none = [key[go[~often[go]]]], [], [], [], [], []
    whole = go[~often[go]]
    d_out.append(doc[whole])
    s_out.append(s[whole] + shift[whole])
    n_out.append(e[whole] - s[whole])
    none.append(nobody[~often[go]])
    texts = [text[x:y] for x, y in zip(s[whole].tolist(), (e[whole] + length - 1).tolist())]
    split = go[often[go]]
    if len(split):
        n = e[split] - s[split]
        at = np.repeat(s[split] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        k_out.append(h.between(at, at + length).view(np.int64))
        d_out.append(np.repeat(doc[split], n))
        s_out.append(at + np.repeat(shift[split], n))
        n_out.append(np.ones(len(at), np.int64))
        none.append(np.repeat(nobody[often[go]], n))
        texts += [text[x : x + length] for x in at.tolist()]
    k_out.append(_mix(doc[done].view(np.uint64)).view(np.int64))
    d_out.append(doc[done])
    s_out.append(s[done] + shift[done])
    n_out.append(e[done] - s[done])
    none.append(np.zeros(len(done), bool))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(k_out), pa.int64()), pa.array(np.concatenate(d_out), pa.int64(), mask=np.concatenate(none)),
            pa.array(np.concatenate(s_out), pa.int64()), pa.array(np.concatenate(n_out).astype(np.int32)),
            pa.array(texts + [None] * len(done), pa.string()),
        ],
        schema=PIECES,
    )


def _several(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in groups: whether each row's group has more than one value of ``doc``, an order by group, and
    where the groups begin in that order."""
    order = np.lexsort((doc, group))
    g, d = group[order], doc[order]
    first = np.append(True, g[1:] != g[:-1])
    at = np.flatnonzero(first)
    per = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    out = np.empty(len(group), bool)
    out[order] = per[np.cumsum(first) - 1]
    return out, order, at


class Pieces:
    """Rows of pieces as arrays; who is a record's number, -1 for a copy of what several records hold."""

    def __init__(self, k, who, start, n, piece):
        self.k, self.who, self.start, self.n, self.piece = k, who, start, n, piece

    @classmethod
    def join(cls, parts: list[Pieces]) -> Pieces:
        return cls(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("k", "who", "start", "n", "piece")))

    def take(self, at) -> Pieces:
        return Pieces(self.k[at], self.who[at], self.start[at], self.n[at], self.piece[at])

    def shrink(self) -> tuple[np.ndarray, Pieces]:
        """Rows of records whose piece others hold too, and what is left: one copy of those, and all other rows."""
        same = pd.factorize(self.piece)[0]
        several, order, at = _several(same, self.who)
        copy = several | (self.who < 0)
        keep = ~copy
        one = order[at[copy[order[at]]]]
        rest = self.take(np.concatenate([np.flatnonzero(keep), one]))
        rest.who = rest.who.copy()
        rest.who[keep.sum() :] = -1
        return np.flatnonzero(several & (self.who >= 0)), rest

    def compare(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs (who, from, to) of windows that a second record holds, within the pieces."""
        cuts, size = [0], 0
        for i, p in enumerate(self.piece):
            if size + len(p) > CHUNK and size:
                cuts.append(i)
                size = 0
            size += len(p)
        h = np.concatenate([_window_hashes(self.piece[a:b], length) for a, b in zip(cuts, [*cuts[1:], len(self.piece)])])
        of = np.repeat(np.arange(len(self.n)), self.n)
        first = np.cumsum(self.n) - self.n
        w = np.flatnonzero(_several(h, self.who[of])[0])
        if len(w):
            w = w[_several(self._equal_texts(w, h[w], of, first, length), self.who[of[w]])[0]]
            w = w[self.who[of[w]] >= 0]
        if not len(w):
            return w, w, w
        p = of[w]
        new = np.flatnonzero(np.append(True, (w[1:] != w[:-1] + 1) | (p[1:] != p[:-1])))
        end = np.append(new[1:], len(w)) - 1
        at = w[new] - first[p[new]] + self.start[p[new]]
        return self.who[p[new]], at, at + (w[end] - w[new]) + length


    def _equal_texts(self, w: np.ndarray, h: np.ndarray, of: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
        """A number per window ``w`` (with hash ``h``) by which windows are equal if and only if their texts are."""
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1])
        group = np.empty(len(w), np.int64)
        group[order] = np.cumsum(new) - 1
        head = w[order[np.flatnonzero(new)]][group]
        of_w, of_h = of[w], of[head]
        at, at_h = w - first[of_w], head - first[of_h]
        other: dict[tuple[int, str], int] = {}
        for i, (p, a, q, b) in enumerate(zip(self.piece[of_w], at.tolist(), self.piece[of_h], at_h.tolist())):
            if p[a : a + length] != q[b : b + length]:
                group[i] = other.setdefault((int(group[i]), p[a : a + length]), len(w) + len(other))
        return group


def _window_hashes(pieces: np.ndarray, length: int) -> np.ndarray:
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    g = Hashes(code_points("".join(pieces))).grams(length)
    n = lens - length + 1
    at = np.repeat(np.cumsum(lens) - lens - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return g[at]


RUNS_DDL = "doc long, s long, e long"


def _settle(length: int, limit: int = 400_000):
    """Rows of a partition sorted by key: whole groups are compared together, about ``limit`` windows at a time.
    Within a group too large for that, equal pieces shrink to one copy as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, int] = {}
        names: list[int] = []

        def out(who, a, b):
            docs = np.asarray(names, np.int64)[who]
            return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["doc", "s", "e"])

        def known(p: Pieces, at: np.ndarray):
            return out(p.who[at], p.start[at], p.start[at] + p.n[at] + length - 1)

        def compare(p: Pieces) -> Iterator[pa.RecordBatch]:
            done, rest = p.shrink()
            if len(done):
                yield known(p, done)
            order = np.argsort(rest.k, kind="stable")
            k = rest.k[order]
            alone = np.ones(len(k), bool)
            alone[1:] &= k[1:] != k[:-1]
            alone[:-1] &= k[1:] != k[:-1]
            rest = rest.take(order[~alone])  # a gram that one piece alone holds was counted too high
            if len(rest.k):
                got = rest.compare(length)
                if len(got[0]):
                    yield out(*got)

        hold: list[Pieces] = []
        windows = 0
        for b in batches:
            text = b.column(4)
            has = pc.is_valid(text).to_numpy(zero_copy_only=False)
            k, start, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            n = n.astype(np.int64)
            doc, said = pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False), pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False)
            if not has.all():
                d, s = doc[~has], start[~has]
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(s + n[~has] + length - 1)], ["doc", "s", "e"])
            if not has.any():
                continue
            who = np.full(len(doc), -1, np.int64)
            for i in np.flatnonzero(has & said).tolist():
                x = int(doc[i])
                if (at := ids.get(x)) is None:
                    at = ids[x] = len(names)
                    names.append(x)
                who[i] = at
            piece = np.empty(int(has.sum()), object)
            piece[:] = text.filter(pa.array(has)).to_pylist()
            hold.append(Pieces(k[has], who[has], start[has], n[has], piece))
            windows += int(n[has].sum())
            if windows > limit:
                buf = Pieces.join(hold)
                closed = buf.k != buf.k[-1]
                if closed.any():
                    yield from compare(buf.take(closed))
                tail = buf.take(~closed)
                if tail.n.sum() > limit:
                    done, left = tail.shrink()
                    if len(done):
                        yield known(tail, done)
                    tail = left
                hold, windows = [tail], int(tail.n.sum())
                if not any((p.who >= 0).any() for p in hold):
                    ids.clear()
                    names.clear()
        if hold:
            yield from compare(Pieces.join(hold))

    return run


def sketch_bits(size: int, length: int, gram: int) -> int:
    """log2 of the cells of a row of the sketch for texts of ``size`` bytes: four cells for each minimizer that is to be expected."""
    grams = 2 * size / (length - gram + 2)
    return int(max(MIN_BITS, np.ceil(np.log2(4 * grams + 1))))


def shared_runs(docs: DataFrame, id_col: str, text: str, length: int = 100, gram: int = 40) -> DataFrame:
    """(doc, start_pos, end_pos): maximal runs of positions that lie in ``length`` or more consecutive characters
    (code points, as they stand) that another record also holds.

    ``id_col`` is a unique whole number.  Null, empty and short texts share nothing; equal texts share all of themselves.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull() & (F.char_length(text) >= length)).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = sketch_bits(size, length, gram)
    sketch = count_min(rows, length, gram, bits)
    if bits <= BROADCAST_BITS:
        # at most 2^(BROADCAST_BITS - BLOCK_BITS) blocks of 16 kB
        sent = spark.sparkContext.broadcast(Sketch([(r.block, bytes(r.twice), bytes(r.hot)) for r in sketch.collect()], bits))
        pieces = rows.mapInArrow(_pieces_part(length, gram, sent), PIECES_DDL)
    else:
        pieces = marked(rows, cut(sketch), length, gram, bits).mapInArrow(_pieces_part(length, gram), PIECES_DDL)
    runs = pieces.repartition(shuffle_width(spark), "k").sortWithinPartitions("k", "piece").mapInArrow(_settle(length), RUNS_DDL)
    w = Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    back = F.max("e").over(w)
    runs = runs.withColumn("new", (back.isNull() | (F.col("s") > back)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(F.min("s").alias("start_pos"), F.max("e").alias("end_pos")).select("doc", "start_pos", "end_pos")


def shared_shares(docs: DataFrame, id_col: str, text: str, length: int = 100) -> DataFrame:
    """(doc, chars, shared, share): how much of each record's text other records hold, 0 where nothing."""
    got = shared_runs(docs, id_col, text, length).groupBy("doc").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"))
    chars = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"))
    return chars.join(got, "doc", "left").select("doc", "chars", F.coalesce("shared", F.lit(0)).alias("shared"), F.when(F.col("chars") > 0, F.round(F.coalesce("shared", F.lit(0)) / F.col("chars"), 6)).otherwise(0.0).alias("share"))
