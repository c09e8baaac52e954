"""relaxed_heights and track_routes over whole tables, with ids beyond the first 3,000."""

from wayline.operators.network import cheapest
from wayline.plans import network


def test_relaxed_heights_of_all_orders(spark, tmp_path):
    keys = [*range(1, 31), *range(6000, 6030), *range(900_000, 900_012)]
    spark.createDataFrame([(k, 1000.0 * (k % 7 + 1)) for k in keys], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {int(r.node) for r in network.relaxed_heights(spark, str(tmp_path)).collect()}
    assert got == {n for k in keys if k % 6 < 5 for n in (k, k + 1)}


def test_track_routes_of_all_customers(spark, tmp_path):
    rows = [(k, k % 2, float(k * 37 % 900)) for k in range(1, 7001)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    want = []
    for region in {(n, k // 3000) for k, n, _ in rows}:
        own = [(k, bal) for k, n, bal in rows if (n, k // 3000) == region]
        e = [(str(k % 40), str(k * 7 % 40), bal + 1) for k, bal in own if k % 40 != k * 7 % 40]
        for b in {str(k % 40) for k, _ in own} - {"1"}:
            if got := cheapest(e, "1", b, 9000.0):
                want.append(("1", b, round(got[0], 2)))
    assert {r[2] for r in want} and len({(k // 3000) for k, _, _ in rows}) == 3
    assert sorted(tuple(r) for r in network.track_routes(spark, str(tmp_path)).collect()) == sorted(want)
