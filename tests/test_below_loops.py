"""Spans that hang below a loop have their own spans below them."""

from wayline.operators.hierarchy import descendants, hierarchy


def test_descendants_below_loops(spark):
    parent = {"a": "b", "b": "a", "self": "self", "top": None, "u1": "top", "u2": "u1", "t1": "a", "x": "self"}
    parent |= {"t2": "t1", "t3": "t2", "s1": "t1", "s2": "s1"} | {f"d{i:02d}": f"d{i - 1:02d}" if i else "b" for i in range(40)}
    loop = {"a", "b", "self"}
    want = set()
    for i in parent:
        p, n = parent[i], 1
        while i not in loop and p is not None and p not in loop:
            want.add((p, i, n))
            p, n = parent[p], n + 1
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    for last in (45, 65_536):
        placed = hierarchy(df, last=last)
        got = [tuple(r) for r in descendants(placed, below_loops=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        sizes = {r.id: r.subtree_size for r in placed.where("status <> 'loop'").collect()}
        assert all(sum(a == i for a, _, _ in got) == n - 1 for i, n in sizes.items())
    assert ("t1", "s2", 2) in want and len(want) > 780
