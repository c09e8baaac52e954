"""Unnamed stops merge wherever they lie, over the edges of any cell."""

import math
import random

from wayline.operators import corridors as C


def test_unnamed_stops_over_cell_edges(spark):
    rnd = random.Random(3)
    rows = [(1, None, 49_990.0, 10.0), (2, "", 50_010.0, 10.0), (3, None, 10.0, -20.0), (4, " ", 10.0, 30.0), (5, None, 99_999.0, 5.0), (6, None, 99_999.0, 5.0)]
    rows += [(10 + i, None, rnd.uniform(49_500, 50_500), rnd.uniform(-500, 500)) for i in range(300)]
    rnd.shuffle(rows)
    heads, want = [], {}
    for i, _, x, y in sorted(rows):
        d, h = min(((math.hypot(x - hx, y - hy), h) for hx, hy, h in heads), default=(math.inf, 0))
        if d > 100:
            heads.append((x, y, i))
            h = i
        want[i] = h
    got = {r.id: r.stop for r in C.merge_stops(spark.createDataFrame(rows, "id int, name string, x double, y double")).collect()}
    assert want[2] == 1 and want[4] == 3 and got == want
