"""Poor containers are filled again by retrieval within a language; long texts make more shards."""

import random

from wayline.llm import packing, tokens


def test_again_within_a_language(spark, monkeypatch):
    rnd = random.Random(6)
    words = {k: [f"{k}{i}" for i in range(200)] for k in ("en", "fr", "de")}
    docs = [(i, " ".join(rnd.choice(words[k]) for _ in range(rnd.choice([5, 20, 60, 90]))), k) for i, k in enumerate(rnd.choices(["en", "fr", "de"], [6, 3, 1], k=600))]
    monkeypatch.setattr(packing, "SHARD_BYTES", 24_000)
    df = spark.createDataFrame(docs, "id long, text string, lang string")
    got = packing.pack(df, spark.createDataFrame([("s", 512)], "container string, capacity int"), "id", "text", "lang").toPandas()
    assert sorted(got["id"]) == [i for i, _, _ in docs] and (got.groupby("bin")["n_tokens"].sum() <= 512).all()
    assert not got.duplicated(["bin", "place"]).any()
    got["lang"] = got["id"].map({i: k for i, _, k in docs})
    near = got[got["how"] != "fit"]
    assert (near.groupby("bin")["lang"].nunique() == 1).all()
    assert len(got[got["bin"].str.startswith("t")]) and (got["how"] == "fit").mean() < 0.5
    assert got.groupby("bin")["n_tokens"].sum().mean() / 512 > 0.95
    assert got["n_tokens"].sum() == sum(len(tokens.encode(t)) for _, t, _ in docs)
