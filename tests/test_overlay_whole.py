"""overlay_picks against brute force, with customers beyond the first 400."""

from wayline.plans import stores


def test_overlay_picks_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 1201)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"S{k}") for k in range(1, 41)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    want = set()
    for k in range(1, 1201):
        x, y = k * 79 % 360, k * 104 % 170
        for s in range(1, 41):
            w, u = s * 37 % 300, s * 53 % 120
            if w <= x + 5 and w + 60 >= x and u <= y + 5 and u + 50 >= y:
                want.add((k, f"S{s}", s))
                if w <= x and w + 60 >= x + 5 and u <= y and u + 50 >= y + 5:
                    break
    got = [tuple(r) for r in stores.overlay_picks(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and max(k for k, _, _ in want) > 1100
