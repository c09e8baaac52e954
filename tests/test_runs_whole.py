"""day_runs and contiguity keep every user and every line item."""

import datetime

from wayline.plans import sequences


def test_runs_of_all_users(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1 + n, 12)
    rows = [(u, "view", day(n)) for u in (3, 10) for n in (0, 1, 3)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r["first"], r["last"], r.n) for r in sequences.day_runs(spark, str(tmp_path)).collect()}
    assert got == {(u, *x) for u in (3, 10) for x in ((0, 1, 2), (3, 3, 1))}


def test_contiguity_of_all_items(spark, tmp_path):
    rows = [(1, 1, 5), (1, 2, 6), (1, 3, 7), (2, 1, 3), (2, 3, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.l_orderkey, r["first"], r["last"], r.n) for r in sequences.contiguity(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 4, 2), (1, 3, 4, 1), (2, 1, 4, 2)]
