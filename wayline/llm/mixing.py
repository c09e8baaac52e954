"""Records of several sources in given shares, by a hypergeometric splitting tree.

Each source's records form blocks of about BLOCK tokens.  A source's quota is so many whole
passes over its blocks and a part of one more, in the order of a keyed permutation.  The quotas are
split exactly among the output shards: a tree halves the shards, and at each node the left half draws its number of
blocks of each source from the multivariate hypergeometric distribution.  A shard thus owns a range of
each source's permuted blocks, which no other shard has, and shuffles the records locally.

Ranks and running sums over a source use buckets and a prefix sum of the buckets' totals: no task holds a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.tokens import TOKENIZER, source_name, with_sizes
from wayline.session import broadcast_checked, cut

BLOCK = 4096
SHARD_TOKENS = 1 << 20
#: Records and blocks per bucket of a source, about.
PER_BUCKET = 50_000
#: Sources of a mixture; its table is small by contract and is checked.
MOST_SOURCES = 10_000


def plan_quotas(weights: dict[str, float], repeats: dict[str, int], tokens: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens to draw of each source.

    Sources without tokens get none and the others' weights are scaled up.  Without ``total`` the result is the largest
    mixture in which every source reaches its share within its repeats; with it, sources that cannot reach their share give
    all they may and the rest is spread over the others by weight, as far as they can give.
    """
    have = {s: w for s, w in weights.items() if w and w > 0 and tokens.get(s, 0) > 0 and (repeats.get(s) or 0) > 0}
    if not have:
        return {}
    most = {s: float(repeats[s] * tokens[s]) for s in have}
    scale = sum(have.values())
    if total is None:
        size = min(most[s] * scale / w for s, w in have.items())
        return {s: size * w / scale for s, w in have.items()}
    quota: dict[str, float] = {}
    left, open_ = float(total), dict(have)
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w >= most[s]]
        if not full:
            return quota | {s: unit * w for s, w in open_.items()}
        for s in full:
            quota[s] = most[s]
            left -= most[s]
            del open_[s]
    return quota


#: The generator's hypergeometric draw takes counts below this.
GENERATOR_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among ``n`` drawn of ``good`` + ``bad`` without return, exact for counts of any size.

    Give every item a place drawn evenly from 0 to 1 and draw the n lowest.  The place of the middle good one follows a beta
    distribution, and the bad ones below it a binomial one; so either all goods up to it are drawn, or none from it on, and half of the
    goods are settled.  This goes on until the generator's own draw takes the rest."""
    got = 0
    while max(good, bad) >= GENERATOR_LIMIT or good + bad >= GENERATOR_LIMIT:
        if n == 0 or good == 0:
            return got
        if n == good + bad:
            return got + good
        if bad > good:
            return got + n - hypergeometric(rng, bad, good, n)
        mid = (good + 1) // 2
        below = int(rng.binomial(bad, rng.beta(mid, good + 1 - mid)))
        if mid + below <= n:
            got, good, bad, n = got + mid, good - mid, bad - below, n - mid - below
        else:
            good, bad = mid - 1, below
    return got + (int(rng.hypergeometric(good, bad, n)) if n and good else 0)


def draw_shares(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of each source are among ``n`` drawn of all (multivariate hypergeometric, one source after the other)."""
    out, rest = np.zeros(len(have), np.int64), int(have.sum())
    for i, h in enumerate(have.tolist()):
        rest -= h
        out[i] = hypergeometric(rng, h, rest, n)
        n -= int(out[i])
    return out


def leaf_ranges(leaf: int, leaves: int, units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each source in one leaf of the splitting tree; each node draws by its own seed."""
    lo, hi, at, have = 0, leaves, np.zeros(len(units), np.int64), units.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        got = draw_shares(np.random.Generator(np.random.PCG64([seed, lo, hi])), have, int(have.sum()) * (mid - lo) // (hi - lo))
        if leaf < mid:
            hi, have = mid, got
        else:
            lo, at, have = mid, at + got, have - got
    return at, have


def closing_sizes(room: float, sizes: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(size, how many): records that fill ``room`` tokens, the largest that fit first."""
    out = []
    for size, n in sorted(zip(sizes, counts), reverse=True):
        k = min(n, int(room // size))
        if k:
            out.append((size, k))
            room -= k * size
    return out


def _running(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, rank: str, total: str) -> DataFrame:
    """Dense rank from 0 and sum of ``value`` before each row, per ``by`` in the order (bucket, order)."""
    sums = df.groupBy(*by, bucket).agg(F.count("*").alias("__n"), F.sum(value).alias("__v"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__v0"))
    w = Window.partitionBy(*by, bucket).orderBy(*order)
    x = df.withColumn("__r", F.row_number().over(w) - 1).withColumn("__s", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    return x.join(sums, [*by, bucket]).withColumn(rank, F.col("__n0") + F.col("__r")).withColumn(total, F.col("__v0") + F.col("__s")).drop("__n0", "__v0", "__r", "__s")


def sized(docs: DataFrame, id_col: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """(id, source, n_tokens) of the records that have tokens and a source, written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")).where("id is not null and source is not null")
    return cut(with_sizes(rows, ["id", "source"], "text", path).where("n_tokens > 0"))


def _mixture(mixture: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    m = mixture.select(source_name(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).limit(MOST_SOURCES + 1).collect()
    if len(m) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    return {r.source: r.weight for r in m}, {r.source: r.max_repeats for r in m}


def mix(docs: DataFrame, mixture: DataFrame, id_col: str, text: str, source: str, total: float | None = None, seed: int = 7, path: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS, block: int = BLOCK) -> DataFrame:
    """(shard, place, source, id, pass, n_tokens): the mixed records in order.

    ``mixture`` has source, weight and max_repeats (whole passes allowed).  A record appears at most max_repeats times.  The last pass's last
    block is drawn as far as the quota goes, and what room is left is closed with undrawn records of the source that fit, largest first: a source falls
    short of its quota by less than its smallest undrawn record.  Sources missing on either side give nothing.  The same seed gives the same mixture on any cluster.
    """
    spark = docs.sparkSession
    weights, repeats = _mixture(mixture)
    names = spark.createDataFrame([(s,) for s in sorted(weights)] or [("",)], "source string")
    rows = sized(docs, id_col, text, source, path).join(broadcast_checked(names, MOST_SOURCES), "source")
    have = {r.source: (r.t, r.n) for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    quota = plan_quotas(weights, repeats, {s: t for s, (t, _) in have.items()}, total)
    order = sorted(quota)
    out = "shard long, place int, source string, id long, pass int, n_tokens long"
    if not order:
        return spark.createDataFrame([], out)
    # one row per source of the mixture, so at most MOST_SOURCES
    plan = spark.createDataFrame([(s, max(1, math.ceil(have[s][1] / PER_BUCKET))) for s in order], "source string, buckets int")
    plan = broadcast_checked(plan, MOST_SOURCES)
    w = Window.partitionBy("source", "part").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    rows = rows.join(plan, "source").withColumn("part", F.pmod(F.xxhash64("id"), F.col("buckets")))
    rows = rows.withColumn("before", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    rows = cut(rows.withColumn("block", F.floor(F.col("before") / block)).withColumn("in_block", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "part", "block").orderBy("before", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    blocks = rows.groupBy("source", "part", "block").agg(F.sum("n_tokens").alias("tokens"))
    passes = spark.createDataFrame([(s, int(p), float(max(0.0, min(quota[s] - p * have[s][0], have[s][0])))) for s in order for p in range(math.ceil(quota[s] / have[s][0] - 1e-9))], "source string, pass int, need double")
    each = blocks.join(broadcast_checked(passes, 1_000_000), "source").withColumn("h", F.xxhash64("source", "part", "block", "pass", F.lit(seed)))
    each = each.join(plan, "source").withColumn("bucket", F.pmod(F.shiftright("h", 40), F.col("buckets"))).drop("buckets")
    each = _running(each, ["source", "pass"], "bucket", ["h", "part", "block"], "tokens", "rank", "cum")
    drawn = cut(each.where("cum < need"))
    full = {s: 0 for s in order}
    at = {}
    for r in drawn.groupBy("source", "pass").count().orderBy("source", "pass").collect():
        at[(r.source, r["pass"])] = full[r.source]
        full[r.source] += r["count"]
    units = np.array([full[s] for s in order], np.int64)
    leaves = max(1, round(sum(quota.values()) / shard_tokens))
    offsets = spark.createDataFrame([(s, p, n) for (s, p), n in at.items()], "source string, pass int, first long")
    drawn = drawn.join(broadcast_checked(offsets, 1_000_000), ["source", "pass"]).withColumn("unit", F.col("first") + F.col("rank"))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for leaf in pdf["id"]:
                first, n = leaf_ranges(int(leaf), leaves, units, seed)
                yield pd.DataFrame({"shard": int(leaf), "source": order, "first": first, "n": n})

    owned = spark.range(leaves).mapInPandas(ranges, "shard long, source string, first long, n long").where("n > 0").select("shard", "source", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("unit"))
    placed = drawn.select("source", "pass", "part", "block", "cum", "need", "unit").join(owned, ["source", "unit"])
    # the last block of a last pass is drawn only as far as the quota goes
    fits = F.col("cum") + F.col("in_block") + F.col("n_tokens") <= F.col("need")
    recs = placed.join(rows.select("source", "part", "block", "id", "n_tokens", "in_block"), ["source", "part", "block"]).where(fits).select("shard", "source", "id", "pass", "n_tokens")
    recs = cut(recs)
    recs = recs.unionByName(_closing(recs, rows, quota, have, owned, seed))
    w = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "id", "pass", F.lit(seed)), "id", "pass")
    return recs.withColumn("place", F.row_number().over(w) - 1).select("shard", "place", "source", "id", "pass", "n_tokens")


def _closing(recs: DataFrame, rows: DataFrame, quota: dict[str, float], have: dict[str, tuple[int, int]], owned: DataFrame, seed: int) -> DataFrame:
    """Records of each source's last pass that close the room its drawn blocks leave, in the shard of the source's last unit.

    Which sizes close it is worked out per source from how many undrawn records there are of each size that fits: less than one block
    and one record's tokens of room, so a short list."""
    spark = recs.sparkSession
    last = {s: math.ceil(q / have[s][0] - 1e-9) - 1 for s, q in quota.items()}
    want = spark.createDataFrame([(s, int(last[s]), float(q)) for s, q in quota.items()], "source string, pass int, quota double")
    want = broadcast_checked(want, MOST_SOURCES)
    room = want.join(recs.groupBy("source").agg(F.sum("n_tokens").alias("got")), "source", "left").select("source", "pass", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("room"))
    room = cut(room)
    drawn = recs.join(want.select("source", "pass"), ["source", "pass"]).select("source", "id")
    free = cut(rows.select("source", "id", "n_tokens").join(broadcast_checked(room, MOST_SOURCES), "source").where(F.col("n_tokens") <= F.col("room")).join(drawn, ["source", "id"], "left_anti"))
    sizes = free.groupBy("source", "pass", "room", "n_tokens").agg(F.count("*").alias("n"))

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        got = closing_sizes(float(pdf["room"].iloc[0]), pdf["n_tokens"].tolist(), pdf["n"].tolist())
        return pd.DataFrame({"source": pdf["source"].iloc[0], "n_tokens": [x for x, _ in got], "take": [k for _, k in got]})

    take = sizes.groupBy("source").applyInPandas(close, "source string, n_tokens long, take long")
    order = [F.xxhash64("id", F.lit(seed), F.lit("closing")), "id"]
    few = free.join(take, ["source", "n_tokens"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("source", "n_tokens", "salt").orderBy(*order))).where("k <= take")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy(*order))).where("k <= take")
    end = owned.groupBy("source").agg(F.max_by("shard", "unit").alias("shard"))
    return few.join(end, "source", "left").select(F.coalesce("shard", F.lit(0).cast("long")).alias("shard"), "source", "id", "pass", "n_tokens")


def shares(mixed: DataFrame, mixture: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, most_times): every source of the mixture, the missing ones with 0."""
    m = mixture.select(source_name(F.col("source")).alias("source"), "weight").where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("pass") + 1).alias("most_times"))
    every = Window.partitionBy(F.lit(1))
    x = m.join(got, "source", "left").fillna(0, ["tokens", "most_times"])
    return x.select(
        "source", F.round(F.col("weight") / F.sum("weight").over(every), 6).alias("target_share"),
        F.round(F.when(F.col("tokens") > 0, F.col("weight") / F.sum(F.when(F.col("tokens") > 0, F.col("weight"))).over(every)).otherwise(0.0), 6).alias("share_of_present"),
        "tokens", F.round(F.col("tokens") / F.sum("tokens").over(every), 6).alias("share"), "most_times",
    )
