"""Records of two sources that describe the same things without a common key.

Collective graph linkage.  Records become nodes; an edge joins two records whose names share
a rare word, exactly or up to one slip of the pen.  Words are matched
once per pair of words, not per record; a pair of words of more than BUDGET pairs of records is joined in parts of that size.
No edge is dropped unseen: all are scored on all
attributes, and scores are refined by what the neighbours of a record (rows of its own source
that agree on name, kind and place or year) say of the same partner, until no score changes any more.

Kinds of name ("town hall", "hôtel de ville") are learned: two wordings that often name the
same thing within one record are one kind.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.lookalike import skeleton
from wayline.session import broadcast_checked, cut

#: A word is common, part of a kind and not of a proper name, when more than this share of all wordings has it.
COMMON_SHARE, COMMON_LEAST = 0.003, 8
#: Two wordings are one kind when this share of the rarer one's records has both.
KIND_SHARE, KIND_LEAST = 0.05, 2
#: Wordings are learned from pairs seen in at least this share of records, so at most some 10^5 reach the driver.
KIND_SEEN = 1e-4
#: A kind of fewer records is not relied on to tell things apart.
KIND_SURE = 10
#: Weights of the evidence: agreement, disagreement; what is not known weighs nothing.
WEIGHTS = {"word": (4.0, -9.0), "slip": 3.0, "whole": (2.0, -4.0), "kind": (2.0, -8.0), "number": (0.0, -5.0), "region": (2.0, -8.0), "near": 0.5, "place": (3.0, -8.0), "year": (2.0, -4.0), "mark": (0.5, -0.3)}
ACCEPT = 3.0
#: Share of the neighbours' mean score that a record's own score takes on; scores that change less are stable (each round's changes are at most SPREAD of the last one's).
SPREAD, STABLE = 0.3, 1e-3
#: Pairs of records of one pair of words that are joined in one part; more are split.
BUDGET = 100_000

# Words that say nothing of what a thing is.
FILLERS = ("the", "and", "et", "former", "ancien", "ancienne", "lieu historique", "du patrimoine national")
_NUMBER = re.compile(r"\b(?:no|n)\b[.°]?\s*(\d+)")


def fold(s: str) -> str:
    """Lower case without accents, by the look of the characters."""
    if s.isascii() and s.isprintable():
        return " ".join(s.split()).lower()
    x = unicodedata.normalize("NFD", skeleton(s)).lower()
    return "".join(c for c in x if not unicodedata.combining(c)).strip()


_phrases: dict[tuple[str, ...], re.Pattern] = {}


def parse_name(s: str, phrases: tuple[str, ...]) -> tuple[list[list[str]], list[str], list[str]]:
    """Wordings of a name as word lists, the number of each ('' without), and what it has in brackets."""
    if phrases not in _phrases:
        _phrases[phrases] = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, phrases))})(?!\w)") if phrases else re.compile(r"(?!)")
    text = fold(s)
    inside = re.findall(r"\(([^)]*)\)", text)
    text = re.sub(r"\([^)]*\)", " ", text)
    out, numbers = [], []
    for part in text.split(" / "):
        part = _phrases[phrases].sub(" ", part)
        found = _NUMBER.search(part)
        words = re.findall(r"\w+", _NUMBER.sub(" ", part))
        if words:
            out.append(words)
            numbers.append(str(int(found[1])) if found else "")
    return out, numbers, [x for x in inside if x not in phrases]


def wordings(records: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """(side, id, words, number, aside): one row per wording of each record's ``names``."""

    @F.pandas_udf("array<struct<words array<string>, number string, aside array<string>>>")
    def parse(names: pd.Series) -> pd.Series:
        def one(ns):
            out = []
            for s in ns if ns is not None else ():
                if s:
                    w, n, aside = parse_name(s, phrases)
                    out += [{"words": a, "number": b, "aside": aside} for a, b in zip(w, n)]
            return out

        return names.map(one)

    return records.select("side", "id", F.explode(parse("names")).alias("x")).select("side", "id", "x.words", "x.number", "x.aside").distinct()


def split_words(words: DataFrame) -> DataFrame:
    """Adds ``core`` (rare words), ``kind_text`` (the common and short ones, sorted) and ``whole`` (all, sorted).

    Words are counted over distinct wordings: a thing listed many times doesn't make its name a common word."""
    limit = max(COMMON_LEAST, COMMON_SHARE * words.select("words").distinct().count())
    each = words.select("words").distinct().select("words", F.explode(F.array_distinct("words")).alias("w"))
    common = each.groupBy("w").count().where((F.col("count") > limit) | (F.length("w") < 4)).where("count > 1")
    # words above the limit number at most words per record / COMMON_SHARE; short ones are few by their length
    flagged = words.select("side", "id", "words", "number", "aside", F.explode("words").alias("w")).join(broadcast_checked(common.select("w", F.lit(True).alias("common")), 50_000), "w", "left")
    key = ["side", "id", "words", "number", "aside"]
    return flagged.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.when(F.col("common").isNull(), F.col("w")))).alias("core"),
        F.concat_ws(" ", F.array_sort(F.collect_set(F.when(F.col("common"), F.col("w"))))).alias("kind_text"),
        F.array_sort(F.collect_set("w")).alias("whole"),
    )


def learn_kinds(words: DataFrame, n: int) -> dict[str, str]:
    """Wording of a kind -> name of the kind (its smallest wording)."""
    x = words.where("size(core) > 0 and kind_text <> ''").select("side", "id", "core", "kind_text")
    y = x.select("side", "id", F.col("core").alias("core2"), F.col("kind_text").alias("kind2"))
    least = max(KIND_LEAST, KIND_SEEN * n)
    pairs = x.join(y, ["side", "id"]).where("kind_text < kind2 and arrays_overlap(core, core2)").select("side", "id", "kind_text", "kind2").distinct().groupBy("kind_text", "kind2").count().where(F.col("count") >= least)
    totals = {r.kind_text: r["count"] for r in x.select("side", "id", "kind_text").distinct().groupBy("kind_text").count().where(F.col("count") >= least).collect()}
    to: dict[str, str] = {k: k for k in totals}

    def top(k: str) -> str:
        while to[k] != k:
            k = to[k]
        return k

    for r in pairs.orderBy(F.desc("count"), "kind_text", "kind2").collect():
        if r["count"] >= KIND_SHARE * min(totals[r.kind_text], totals[r.kind2]):
            a, b = sorted((top(r.kind_text), top(r.kind2)))
            to[b] = a
    size: dict[str, int] = {}
    for k in to:
        size[top(k)] = size.get(top(k), 0) + totals[k]
    return {k: top(k) for k in to if size[top(k)] >= KIND_SURE}


def _keys(core: str) -> Column:
    """The word and, for words of six letters or more, each form with one letter less: words one slip apart share a form."""
    return F.expr(
        f"array_distinct(if(length({core}) < 6, array({core}), concat(array({core}), transform(sequence(1, length({core})), i -> concat(left({core}, i - 1), substr({core}, i + 1))))))"
    )


def word_pairs(words: DataFrame) -> DataFrame:
    """(wa, wb, pairs): words of the two sides' rare words that are equal or a slip apart, with how many pairs of records they make."""
    n = words.groupBy("w").agg(*[F.count(F.when(F.col("side") == x, 1)).alias(x) for x in "ab"])
    form = F.explode(_keys("w")).alias("form")
    a, b = n.where("a > 0").select(F.col("w").alias("wa"), F.col("a").alias("na"), form), n.where("b > 0").select(F.col("w").alias("wb"), F.col("b").alias("nb"), form)
    met = a.join(b, "form").select("wa", "wb", "na", "nb").distinct()
    return met.select("wa", "wb", (F.col("na") * F.col("nb")).alias("pairs"))


def candidates(named: DataFrame) -> DataFrame:
    """(a, b): all records of the two sides that share a rare word or one a slip apart; how many that are is no reason to leave any out, as only
    the score tells partners from others."""
    words = cut(named.select("side", "id", F.explode("core").alias("w")).distinct())
    met = cut(word_pairs(words))
    a, b = words.where("side = 'a'").select(F.col("id").alias("a"), F.col("w").alias("wa")), words.where("side = 'b'").select(F.col("id").alias("b"), F.col("w").alias("wb"))
    found = a.join(met.where(F.col("pairs") <= BUDGET).select("wa", "wb"), "wa").join(b, "wb").select("a", "b")
    hot = met.where(F.col("pairs") > BUDGET)
    if hot.limit(1).count():
        # a square of parts by the records of either side: each is one group of the join, of about BUDGET pairs
        hot = cut(hot.select("wa", "wb", F.ceil(F.sqrt(F.col("pairs") / BUDGET)).alias("parts")))
        own = lambda side: F.pmod(F.xxhash64(side), F.col("parts"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        x = a.join(hot, "wa").select("a", "wa", "wb", own("a").alias("i"), every.alias("j"))
        y = b.join(hot, "wb").select("b", "wa", "wb", every.alias("i"), own("b").alias("j"))
        found = found.unionByName(x.join(y, ["wa", "wb", "i", "j"]).select("a", "b"))
    return found.distinct()


def bare_candidates(named: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame | None:
    """(a, b): records without a rare word in any name, with those of the other side that have a wording of the same words, or one of
    the words and a region or place in common.  None if there are no such records."""
    bare = cut(named.groupBy("side", "id").agg(F.max(F.size("core")).alias("most")).where("most = 0").select("side", "id"))
    if not bare.limit(1).count():
        return None
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    both = left.select(F.lit("a").alias("side"), "id", "regions", "near", "places").unionByName(right.select(F.lit("b").alias("side"), "id", "regions", "near", "places"))
    at = both.select("side", "id", F.explode(F.concat(listed("regions"), listed("near"))).alias("at"), F.lit("r").alias("what"))
    at = at.unionByName(both.select("side", "id", F.explode(listed("places")).alias("at"), F.lit("p").alias("what")))
    at = at.unionByName(named.select("side", "id", F.explode("aside").alias("at"), F.lit("p").alias("what"))).where("at <> ''")
    keys = named.where("size(core) = 0").select("side", "id", F.xxhash64(F.concat_ws(" ", "whole")).alias("key"))
    keys = cut(keys.unionByName(named.select("side", "id", F.explode("whole").alias("w")).distinct().join(at, ["side", "id"]).select("side", "id", F.xxhash64("w", "at", "what").alias("key"))).distinct())
    own = keys.join(bare, ["side", "id"])
    a, b = (lambda k: k.where("side = 'a'").select(F.col("id").alias("a"), "key")), (lambda k: k.where("side = 'b'").select(F.col("id").alias("b"), "key"))
    return a(own).join(b(keys), "key").select("a", "b").unionByName(a(keys).join(b(own), "key").select("a", "b")).distinct()


_SLIP = "(levenshtein(x, y, 2) = 1 or (length(x) = length(y) and length(x) >= 6 and levenshtein(x, y, 2) = 2 and array_sort(split(x, '')) = array_sort(split(y, ''))))"


def _name_score() -> Column:
    w = WEIGHTS
    word = f"array_max(flatten(transform(p.core, x -> transform(q.core, y -> case when x = y then {w['word'][0]}D when length(x) >= 6 and length(y) >= 5 and {_SLIP} then {w['slip']}D else {w['word'][1]}D end))))"
    kind = f"case when p.kind = '' or q.kind = '' then 0D when p.kind = q.kind then {w['kind'][0]}D else {w['kind'][1]}D end"
    number = f"if(p.number = q.number, {w['number'][0]}D, {w['number'][1]}D)"
    # a record without a rare word is known by whole wordings only, which include the kind
    share = "size(array_intersect(p.whole, q.whole)) / size(array_union(p.whole, q.whole))"
    said = f"if(a_bare or b_bare, {w['whole'][1]}D + {w['whole'][0] - w['whole'][1]}D * {share}, coalesce({word}, {w['word'][1]}D) + {kind})"
    return F.expr(f"array_max(flatten(transform(a_names, p -> transform(b_names, q -> {said} + {number}))))")


#: A pair below this can't be accepted: no mean of neighbours is above the best score of a pair whose neighbours have the best score too.
LEAST = ACCEPT - SPREAD / (1 - SPREAD) * sum(WEIGHTS[k][0] for k in ("word", "kind", "number", "region", "place", "year", "mark"))


def _said(agree: str, known: str, name: str) -> str:
    yes, no = WEIGHTS[name]
    return f"case when not ({known}) then 0D when {agree} then {yes}D else {no}D end"


def link(left: DataFrame, right: DataFrame, phrases: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, score, confidence): each left record's partner on the right.

    Both sides: id, names array<string>, regions array<string>, near array<string> (regions it may also lie in),
    places array<string> (folded), year int, marks array<string>.  Ids are unique; null attributes say nothing.  A left record has one
    partner at most, a right record may have several (copies of one thing).  Records without a rare word in any name are
    compared by their whole wordings, which alone don't suffice: region, place or year must agree too.
    confidence is the logistic of the score above the acceptance limit.
    """
    phrases = tuple(sorted({fold(p) for p in phrases} | set(FILLERS), key=lambda p: (-len(p), p)))
    types = {"a": left.schema["id"].dataType, "b": right.schema["id"].dataType}
    left, right = (df.withColumn("id", F.col("id").cast("string")) for df in (left, right))
    both = left.select(F.lit("a").alias("side"), "id", "names").unionByName(right.select(F.lit("b").alias("side"), "id", "names"))
    words = cut(wordings(both, phrases))
    n = both.count()
    words = cut(split_words(words))
    spark = left.sparkSession
    named = cut(_with_kinds(spark, words, learn_kinds(words, n)))
    per = named.groupBy("side", "id").agg(F.collect_set(F.struct("core", "kind", "number", "whole")).alias("names"), (F.max(F.size("core")) == 0).alias("bare"), F.array_distinct(F.flatten(F.collect_list("aside"))).alias("aside"))

    def features(df: DataFrame, side: str) -> DataFrame:
        x = df.select("id", "regions", "near", "places", "year", "marks").join(per.where(F.col("side") == side).select("id", F.col("names"), "bare", "aside"), "id")
        x = x.withColumn("places", F.filter(F.array_distinct(F.concat(F.coalesce("places", F.array().cast("array<string>")), "aside")), lambda p: p.isNotNull() & (p != ""))).drop("aside")
        return x.select([F.col(c).alias(side if c == "id" else f"{side}_{c}") for c in x.columns])

    found, bare = candidates(named), bare_candidates(named, left, right)
    e = (found if bare is None else found.unionByName(bare).distinct()).join(features(left, "a"), "a").join(features(right, "b"), "b")
    region = (
        f"case when coalesce(size(a_regions), 0) <= 0 or coalesce(size(b_regions), 0) + coalesce(size(b_near), 0) <= 0 then 0D when arrays_overlap(a_regions, b_regions) then {WEIGHTS['region'][0]}D "
        f"when arrays_overlap(a_regions, b_near) then {WEIGHTS['near']}D else {WEIGHTS['region'][1]}D end"
    )
    e = e.withColumn("name_score", _name_score())
    e = e.withColumn("region_score", F.expr(region))
    e = e.withColumn("place_score", F.expr(_said("exists(a_places, x -> exists(b_places, y -> levenshtein(x, y, 2) >= 0))", "size(a_places) > 0 and size(b_places) > 0", "place")))
    e = e.withColumn("year_score", F.expr(_said("a_year = b_year", "a_year is not null and b_year is not null", "year")))
    e = e.withColumn("mark_score", F.expr(_said("arrays_overlap(a_marks, b_marks)", "size(a_marks) > 0 and size(b_marks) > 0", "mark")))
    own = e.select("a", "b", (F.col("name_score") + F.col("region_score") + F.col("place_score") + F.col("year_score") + F.col("mark_score")).alias("own"))
    # cut before the filter, which would be pushed below the sum and work every score out twice
    scored = cut(own).where(F.col("own") >= LEAST)
    scored = _refine(scored, _neighbour_keys(named, left))
    best_pairs = _best(scored).select(F.col("a").cast(types["a"]).alias("a"), F.col("b").cast(types["b"]).alias("b"), "score")
    return best_pairs.withColumn("confidence", F.round(1 / (1 + F.exp(F.lit(ACCEPT) - F.col("score"))), 4))


def _refine(scored: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(a, b, own, score): own scores with SPREAD of the mean score that a record's neighbours give the same partner, until no score
    changes by STABLE.  Only pairs that have neighbours take part in the rounds."""
    votes = scored.join(neighbours, "a").select("a", "b", "key", "own")
    several = votes.groupBy("key", "b").agg(F.count("*").alias("votes")).where("votes > 1")
    # rows: pair, key, votes; a frequent key is added up map-side and split by the skew join
    ties = cut(votes.join(several, ["key", "b"]).select("a", "b", "key", "votes"))
    now = cut(scored.join(ties.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", "own", F.col("own").alias("score")))
    alone = scored.join(now.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "own", F.col("own").alias("score"))
    while True:
        x = ties.join(now, ["a", "b"])
        said = x.groupBy("key", "b").agg(F.sum("score").alias("total"))
        mean = x.join(said, ["key", "b"]).groupBy("a", "b").agg(F.first("own").alias("own"), F.first("score").alias("before"), F.max((F.col("total") - F.col("score")) / (F.col("votes") - 1)).alias("mean"))
        now = cut(mean.select("a", "b", "own", (F.col("own") + SPREAD * F.greatest("mean", F.lit(0.0))).alias("score"), "before"))
        # null where no pair has neighbours
        if (now.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) < STABLE:
            break
        now = now.drop("before")
    return alone.unionByName(now.select("a", "b", "own", "score"))


def _best(scored: DataFrame) -> DataFrame:
    """Each left record's best partner, if good enough; of equal ones the better by itself, then the smaller id."""
    top = scored.where(F.col("score") >= ACCEPT).groupBy("a").agg(F.min_by(F.struct("b", "score"), F.struct(-F.col("score"), -F.col("own"), "b")).alias("x"))
    return top.select("a", "x.b", "x.score")


def _with_kinds(spark: SparkSession, words: DataFrame, kinds: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(sorted(kinds.items()) or [("", "")], "kind_text string, kind string")
    joined = words.join(broadcast_checked(rows, 200_000), "kind_text", "left")
    return joined.select("side", "id", "core", "number", "aside", "whole", F.coalesce("kind", F.lit("")).alias("kind"))


def _neighbour_keys(named: DataFrame, left: DataFrame) -> DataFrame:
    """(a, key): left records with a key in common are neighbours: they agree on a name and its kind and number, and on region and year, or region and place."""
    x = named.where("side = 'a'").select(F.col("id").alias("a"), F.explode("core").alias("w"), "kind", "number").distinct()
    y = left.select(F.col("id").alias("a"), F.get("regions", F.lit(0)).alias("region"), "year", F.get("places", F.lit(0)).alias("place"))
    z = x.join(y, "a")
    by_year = z.where("year is not null").select("a", F.xxhash64("w", "kind", "number", "region", "year", F.lit("y")).alias("key"))
    by_place = z.where("place is not null and place <> ''").select("a", F.xxhash64("w", "kind", "number", "region", "place", F.lit("p")).alias("key"))
    return by_year.unionByName(by_place).distinct()
