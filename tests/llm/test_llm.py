"""The operators on texts and names: brute force, exact round trips, hostile inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import mixing, packing, spans, tokens
from wayline.llm.linkage import link, parse_name
from wayline.llm.lookalike import lookalike_groups, lookalike_pairs, skeleton
from wayline.llm.spans import shared_runs, shared_shares


def test_skeleton():
    same = [
        ("Ｐｏｒｔ　Ｈｉｌｌ", "Port Hill"), ("Café", "Café"), ("Pо​rt", "Port"), ("St. Ann ", "St. Ann"), ("ﬁne", "fine"), ("Βaу", "Bay"), ("a­b", "ab"), ("a  b", "a b"), ("о̂", "ô"), ("ı̂le", "île"), ("K", "K"),
    ]
    for a, b in same:
        assert skeleton(a).strip() == skeleton(b).strip(), (a, b)
    for a, b in [("Port", "port"), ("Cafe", "Café"), ("I", "l"), ("0", "O"), ("x²", "x2"), ("a b", "ab"), ("a-b", "a b"), ("rn", "m"), ("résumé", "resumé")]:
        assert skeleton(a) != skeleton(b), (a, b)
    assert skeleton(None) is None and skeleton("") == "" and skeleton("​ ") .strip() == ""
    assert skeleton(skeleton("Ｐо́rt")) == skeleton("Ｐо́rt")


def test_lookalike_pairs(spark):
    rows = [(1, "Port"), (2, "Pоrt"), (2, "Pоrt"), (3, "Port"), (4, "port"), (5, None), (6, ""), (7, "​"), (None, "Port")]
    df = spark.createDataFrame(rows, "id long, name string").withColumn("skeleton", F.lit("x"))
    assert sorted(tuple(r) for r in lookalike_pairs(df, "id", "name").collect()) == [(1, 2), (2, 3)]
    assert [tuple(r)[1:] for r in lookalike_groups(df, "name").collect()] == [(2, 5)]
    assert lookalike_pairs(df.limit(0), "id", "name").count() == 0


def brute_runs(docs, k):
    seen = {}
    for i, t in docs:
        for a in range(len(t or "") - k + 1):
            seen.setdefault(t[a : a + k], set()).add(i)
    out = set()
    for i, t in docs:
        t = t or ""
        cov = [False] * (len(t) + 1)
        for a in range(len(t) - k + 1):
            if len(seen[t[a : a + k]]) > 1:
                cov[a : a + k] = [True] * k
        start = None
        for p, c in enumerate(cov):
            if c and start is None:
                start = p
            if not c and start is not None:
                out.add((i, start, p))
                start = None
    return out


def make_docs(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé漢😀 ") for _ in range(rnd.randrange(3, 9)))
    text = lambda m: " ".join(word() for _ in range(m))
    notice, other = text(30), text(12)
    docs = []
    for i in range(n):
        t = text(rnd.randrange(0, 40))
        if i % 3 == 0:
            t = t[: len(t) // 2] + notice + t[len(t) // 2 :]
        if i % 5 == 0:
            t += other + other
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, "x" * 3000), (903, "y" * 500 + text(5)), (904, docs[3][1]), (905, docs[3][1]), (906, docs[0][1][5:90])]
    return docs


@pytest.mark.parametrize("hot,chunk,limit", [(20_000, 1 << 20, 400_000), (2, 1 << 20, 50), (5, 400, 200)])
def test_shared_runs(spark, monkeypatch, hot, chunk, limit):
    docs = make_docs(hot)
    monkeypatch.setattr(spans, "HOT", hot)
    df = spark.createDataFrame(docs, "id long, text string").withColumn("doc", F.lit(1)).withColumn("s", F.lit(2)).repartition(3)
    seg, settle = spans.segments, spans._settle
    monkeypatch.setattr(spans, "segments", lambda ids, texts, length, c=chunk: seg(ids, texts, length, c))
    monkeypatch.setattr(spans, "_settle", lambda length: settle(length, limit))
    got = [tuple(r) for r in shared_runs(df, "id", "text", 60, 20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(docs, 60)


def test_shared_shares(spark):
    docs = make_docs(1, 12)
    df = spark.createDataFrame(docs, "id long, text string")
    want = {i: 0 for i, _ in docs}
    for i, a, b in brute_runs(docs, 100):
        want[i] += b - a
    assert {r.doc: r.shared for r in shared_shares(df, "id", "text").collect()} == want
    assert shared_runs(df.limit(0), "id", "text").count() == 0


def test_count_min_never_says_less(spark):
    docs = make_docs(4)
    df = spark.createDataFrame(docs, "id long, text string").where("length(text) >= 60")
    bits = 16
    sketch = spans.Sketch([tuple(r) for r in spans.count_min(df, 60, 20, bits).collect()], bits)
    seen = {}
    for i, t in docs:
        if t and len(t) >= 60:
            _, _, key, _ = spans.minimizer_runs(spans.Hashes(spans.code_points(t)), np.array([0, len(t)]), 60, 20)
            for k in set(key.tolist()):
                seen[k] = seen.get(k, 0) + 1
    often = np.array([k for k, n in seen.items() if n > 1], np.uint64)
    assert len(often) and sketch.ask(often)[0].all()


def test_sliding_min():
    rnd = np.random.default_rng(0)
    g = rnd.integers(0, 1000, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 64, 200):
        assert sliding(g, w) == spans.sliding_min(g, w).tolist()


def sliding(g, w):
    return [int(g[i : i + w].min()) for i in range(len(g) - w + 1)]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 20, 60, 150]))), rnd.choice(["en", "EN", "fr-XX", None, " de"]), rnd.choice(["A", "a ", "b_x", "c", None])) for i in range(300)]
    rows += [(1000, None, "en", "A"), (1001, "word " * 5000, "en", "A"), (1002, "z" * 30000, "fr", "b-x")]
    return rows


def test_pack(spark, corpus):
    df = spark.createDataFrame(corpus, "id long, text string, lang string, source string").withColumn("shard", F.lit("s")).withColumn("n", F.lit(1))
    boxes = spark.createDataFrame([("s", 64), ("l", 2048), ("bad", 0), (None, None)], "container string, capacity int")
    got = packing.pack(df, boxes, "id", "text", "lang", shard_rows=100).toPandas()
    size = {i: len(tokens.encode(t)) for i, t, _, _ in corpus if t}
    for name, cap in (("s", 64), ("l", 2048)):
        g = got[got["container"] == name]
        assert (g.groupby("bin")["n_tokens"].sum() <= cap).all()
        assert g.groupby("id")["n_tokens"].sum().to_dict() == {i: n for i, n in size.items() if n}
        for i, p in g.sort_values("part").groupby("id"):
            assert p["token_from"].iloc[0] == 0 and p["token_to"].iloc[-1] == size[i] and (p["token_from"].iloc[1:].to_numpy() == p["token_to"].iloc[:-1].to_numpy()).all()
            assert len(p) == 1 or size[i] > cap
        assert g.groupby("bin")["place"].nunique().eq(g.groupby("bin").size()).all()
    rep = {r.container: r.fill for r in packing.fill_report(spark.createDataFrame(got)).collect()}
    assert rep["l"] > 0.93
    assert packing.pack(df.limit(0), boxes, "id", "text", "lang").count() == 0 and packing.pack(df, boxes.limit(0), "id", "text", "lang").count() == 0


def test_bm25_is_brute_force():
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 40, rnd.integers(1, 30)) for _ in range(25)]
    terms = []
    for d in docs:
        t, tf = np.unique(d, return_counts=True)
        terms.append(np.concatenate([t, tf]).astype("<u4").tobytes())
    ix = packing.Index(terms)
    n, avg = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(40)}
    for seed in range(n):
        want = np.zeros(n)
        for t in set(docs[seed].tolist()):
            if df[t] * 2 <= n and df[t] > 1:
                for j, d in enumerate(docs):
                    tf = (d == t).sum()
                    want[j] += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        assert np.allclose(ix.scores(seed), want, atol=1e-4)


def test_best_fit_and_fill():
    boxes = packing.best_fit([5, 5, 4, 3, 3], 10)
    assert sorted(map(sorted, boxes)) == [[0, 1], [2, 3, 4]]
    empty = packing.Index([np.empty(0, "<u4").tobytes()] * 3)
    assert sorted(x for b in packing.fill(np.array([3, 0, 7]), 10, empty) for x in b) == [0, 2]


def test_mix(spark, corpus):
    df = spark.createDataFrame(corpus, "id long, text string, lang string, source string").withColumn("block", F.lit(1)).withColumn("pass", F.lit(2))
    m = spark.createDataFrame([("a", 3.0, 2), ("B-X", 2.0, 3), ("c", 1.0, 1), ("gone", 5.0, 9), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    got = mixing.mix(df, m, "id", "text", "source", shard_tokens=4000, block=200).toPandas()
    again = mixing.mix(df.repartition(7), m, "id", "text", "source", shard_tokens=4000, block=200).toPandas()
    key = ["shard", "place", "source", "id", "pass", "n_tokens"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    assert not got.duplicated(["id", "pass"]).any() and not got.duplicated(["shard", "place"]).any()
    assert got.groupby("id").size().max() <= 3 and set(got["source"]) == {"a", "b-x", "c"}
    for s, cap in (("a", 2), ("b-x", 3), ("c", 1)):
        assert got[got["source"] == s].groupby("id").size().max() <= cap
    share = got.groupby("source")["n_tokens"].sum() / got["n_tokens"].sum()
    big = max(len(tokens.encode(t or "")) for _, t, _, _ in corpus) / got["n_tokens"].sum()
    assert abs(share["a"] - 0.5) < 0.02 + big and abs(share["c"] - 1 / 6) < 0.02 + big
    assert got["shard"].nunique() > 1
    table = {r.source: r for r in mixing.shares(spark.createDataFrame(got), m).collect()}
    assert table["gone"].tokens == 0 and abs(sum(r.share for r in table.values()) - 1) < 1e-4
    assert mixing.mix(df.limit(0), m, "id", "text", "source").count() == 0


def test_quotas_and_tree():
    q = mixing.plan_quotas({"a": 1, "b": 1, "z": 1}, {"a": 2, "b": 1, "z": 1}, {"a": 100, "b": 50, "z": 0})
    assert q == {"a": 50.0, "b": 50.0}
    q = mixing.plan_quotas({"a": 1, "b": 1}, {"a": 10, "b": 1}, {"a": 100, "b": 50}, total=400)
    assert q == {"b": 50.0, "a": 350.0}
    units = np.array([17, 0, 200, 3])
    parts = [mixing.leaf_ranges(i, 7, units, 1) for i in range(7)]
    assert (sum(n for _, n in parts) == units).all()
    at = np.zeros(4, np.int64)
    for first, n in parts:
        assert (first == at).all()
        at += n
    assert max(n.sum() for _, n in parts) - min(n.sum() for _, n in parts) <= 3


def test_link(spark):
    assert parse_name("St. Ann Church (Bay) / Église X No. 9", ()) == ([["st", "ann", "church"], ["eglise", "x"]], ["", "9"], ["bay"])
    rnd = random.Random(4)
    core = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) + "x"
    kinds = [("{} Town Hall", "Hôtel de ville de {}"), ("{} Lighthouse", "Phare de {}"), ("{} Mill", "Moulin {}")]
    a, b, want = [], [], set()
    for i in range(120):
        c, (en, fr), reg, place, year = core(), kinds[i % 3], f"R{i % 4}", f"place {i % 9}", 1900 + i
        a.append((i, [en.format(c), fr.format(c)], [reg], [], [place], year, []))
        if i % 4 == 0:
            a.append((1000 + i, [fr.format(c)], [reg], [], [], None, []))
            a.append((2000 + i, [en.format(c)], [f"R{(i + 1) % 4}"], [], ["elsewhere far"], year, []))  # the same name in another place
        slip = c[1] + c[0] + c[2:] if i % 5 == 0 else c
        b.append((f"Q{i}", [en.format(slip), fr.format(c)] if i % 2 else [fr.format(slip)], [reg] if i % 3 else [], [], [place] if i % 4 < 2 else [], year if i % 2 else None, []))
        want.add((i, f"Q{i}"))
        if i % 4 == 0:
            want.add((1000 + i, f"Q{i}"))
    schema = "names array<string>, regions array<string>, near array<string>, places array<string>, year int, marks array<string>"
    A, B = spark.createDataFrame(a + [(9999, None, None, None, None, None, None)], f"id long, {schema}"), spark.createDataFrame(b, f"id string, {schema}")
    got = {(r.a, r.b) for r in link(A, B).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    assert link(A.limit(0), B).count() == 0 and link(A, B.limit(0)).count() == 0


def test_queries_run(spark):
    import os

    from wayline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    for name, f in QUERIES.items():
        assert f(spark, sf).count() >= 0, name
