"""The sketch as a table, joined by block, and windows told apart by their texts."""

import numpy as np
import pytest
from test_llm import brute_runs, make_docs

from pyspark.sql import functions as F
from wayline.llm import spans


@pytest.mark.parametrize("hot", [20_000, 3])
def test_joined_sketch_finds_the_same(spark, monkeypatch, hot):
    docs = make_docs(hot + 1)
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "BROADCAST_BITS", 0)
    monkeypatch.setattr(spans, "MIN_BITS", 19)
    df = spark.createDataFrame(docs, "id long, text string").withColumn("doc", F.lit(1)).repartition(3)
    assert {tuple(r) for r in spans.shared_runs(df, "id", "text", 60, 20).collect()} == brute_runs(docs, 60)
    assert spans.shared_runs(df.limit(0), "id", "text", 60, 20).count() == 0


@pytest.mark.parametrize("bits", [0, 28])
def test_equal_hashes_of_other_texts(spark, monkeypatch, bits):
    """With hashes of a few values everything collides, and only equal texts are shared."""
    docs = make_docs(7, 24)
    grams, between = spans.Hashes.grams, spans.Hashes.between
    monkeypatch.setattr(spans, "BROADCAST_BITS", bits)
    monkeypatch.setattr(spans.Hashes, "grams", lambda self, m: grams(self, m) % np.uint64(5))
    monkeypatch.setattr(spans.Hashes, "between", lambda self, a, b: between(self, a, b) % np.uint64(3))
    df = spark.createDataFrame(docs, "id long, text string").coalesce(1)
    rows = df.where(F.col("id").isNotNull() & (F.char_length("text") >= 60)).toPandas()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(rows["id"]), pa.array(rows["text"])], ["id", "text"])

    class Sent:
        value = spans.Sketch([(0, b"\xff" * (spans.ROWS << (spans.BLOCK_BITS - 3)), b"")], 16)

    pieces = pa.Table.from_batches(list(spans._pieces_part(60, 20, Sent)([batch]))).combine_chunks().sort_by([("k", "ascending"), ("piece", "ascending")])
    got = [r for b in spans._settle(60)(pieces.to_batches()) for r in zip(*(c.to_pylist() for c in b.columns))]
    cover = {i: set() for i, _ in docs}
    for d, s, e in got:
        cover[d].update(range(s, e))
    want = {i: set() for i, _ in docs}
    for d, s, e in brute_runs(docs, 60):
        want[d].update(range(s, e))
    assert cover == want


def test_one_in_twenty_passes():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2)
    bits = int(np.ceil(np.log2(4 * len(keys))))
    block, inner = spans.cells(keys, bits)
    rows = []
    for k in np.unique(block):
        n = np.bincount(inner[:, block == k].ravel(), minlength=spans.ROWS << spans.BLOCK_BITS)
        rows.append((int(k), np.packbits(n >= 2).tobytes(), b""))
    may, often = spans.Sketch(rows, bits).ask(keys)
    assert may.mean() < 0.06 and not often.any()
    assert spans.sketch_bits(30 << 30, 100, 40) > 28 and spans.sketch_bits(0, 100, 40) == 16
