"""Parent-child rows to full hierarchies.

Leaves are peeled bottom-up: each round every leaf tells its parent that it is gone and how large its
subtree was, in one aggregation that is combined map-side, so a parent of very many children is no hot spot.  What
no round can peel is cycles.  Layers then get their tops and paths in reverse peel order.  Once few nodes are
left (at most LAST: the ends of the deepest chains), their remaining rounds run in one task.
Descendants are the exploded paths, one row per pair, so no list of a large subtree is ever held in one row.

The joins of the rounds ask for sort-merge: tables broadcast in one round would stay in the
driver's memory for the rounds after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.registers import connected
from wayline.session import cut

#: Remaining nodes whose last rounds of peeling run in one task.
LAST = 65_536
#: Layers that are read side by side on the way back.
MERGED = 8
STATE = "id string, parent string, has_row boolean, kids long, inner boolean, size long"
PLACED = "id string, parent string, has_row boolean, inner boolean, top string, path array<string>, depth long, subtree_size long, status string"


def edges(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row (id, parent) per id.  Null and empty ids are dropped; null and empty parents
    count as unsaid.  Where rows of one id name several parents, the smallest is taken."""
    p = F.when(F.col(parent_col) != "", F.col(parent_col))
    return (
        df.where(F.col(id_col).isNotNull() & (F.col(id_col) != ""))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(p).alias("parent"))
    )


def hierarchy(nodes: DataFrame, paths: bool = True, last: int = LAST) -> DataFrame:
    """Place every node of ``nodes`` (id string unique, parent string or null).

    Returns id, parent, has_row (false for a parent that has no row of its own), top,
    depth (0 at the top), path (array from top to the node), subtree_size (with the node),
    status: 'tree', 'loop' (on a cycle) or 'into_loop' (its ancestors reach a cycle), and below (for 'into_loop': the path from the first node under the cycle).
    On or below a cycle depth and path are null and top is the smallest id on the cycle; a node that
    names itself is a cycle of one.  subtree_size is null on a cycle only.  Without ``paths`` path and below are null.  An empty input gives an empty result.
    """
    none = F.lit(None).cast("string")
    said = nodes.select("id", "parent", F.lit(True).alias("has_row"), F.lit(0).alias("kids"))
    told = nodes.where("parent is not null").select(F.col("parent").alias("id"), none.alias("parent"), F.lit(False).alias("has_row"), F.lit(1).alias("kids"))
    every = said.unionByName(told).groupBy("id").agg(F.max("parent").alias("parent"), F.max("has_row").alias("has_row"), F.sum("kids").alias("kids"))
    active = cut(every.select("id", "parent", "has_row", "kids", (F.col("kids") > 0).alias("inner"), F.lit(1).cast("long").alias("size")))
    layers: list[DataFrame] = []
    while True:
        left, free = active.agg(F.count("*"), F.count(F.when(F.col("kids") == 0, 1))).first()
        if left <= last or not free:
            break
        leaves = active.where("kids = 0")
        layers.append(leaves)
        gone = leaves.where("parent is not null").select(F.col("parent").alias("id"), none.alias("parent"), F.lit(False).alias("has_row"), F.lit(-1).cast("long").alias("kids"), F.lit(False).alias("inner"), "size")
        rest = active.where("kids > 0").unionByName(gone)
        active = cut(rest.groupBy("id").agg(F.max("parent").alias("parent"), F.max("has_row").alias("has_row"), F.sum("kids").alias("kids"), F.max("inner").alias("inner"), F.sum("size").alias("size")))
    if left <= last:
        placed = active.coalesce(1).mapInPandas(_peel_rest(paths), PLACED)
    else:
        # cycles alone are left, each node's parent among them
        ring = connected(active.select(F.col("id").alias("a"), F.col("parent").alias("b")))
        placed = active.join(ring.select("id", F.col("root").alias("top")).hint("merge"), "id").select("id", "parent", "has_row", "inner", "top", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("subtree_size"), F.lit("loop").alias("status"))
    parts = [cut(placed) if layers else placed]
    inner = [parts[0].where("inner")]
    empty = F.array().cast("array<string>")
    for layer in reversed(layers):
        above = _union(inner).select(F.col("id").alias("parent"), F.col("top").alias("p_top"), F.col("path").alias("p_path"), F.col("depth").alias("p_depth"), F.col("status").alias("p_status"))
        grown = F.concat(F.when(F.coalesce("p_status", F.lit("tree")) == "loop", empty).otherwise(F.coalesce("p_path", empty)), F.array("id")) if paths else F.lit(None).cast("array<string>")
        got = layer.join(above.hint("merge"), "parent", "left").select(
            "id", "parent", "has_row", "inner", F.coalesce("p_top", "id").alias("top"), grown.alias("path"),
            F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("p_depth") + 1).cast("long").alias("depth"), F.col("size").alias("subtree_size"),
            F.when(F.coalesce("p_status", F.lit("tree")) == "tree", "tree").otherwise("into_loop").alias("status"),
        )
        parts.append(cut(got) if layer is not layers[0] else got)
        inner.append(parts[-1].where("inner"))
        if len(inner) > MERGED:
            # deep trees have many layers: what children may ask for is brought together now and then
            inner = [cut(_union(inner))]
    tree = F.col("status") == "tree"
    return _union(parts).select(
        "id", "parent", "has_row", "top", F.when(tree, F.col("depth")).cast("int").alias("depth"), F.when(tree, F.col("path")).alias("path"), "subtree_size", "status", F.when(F.col("status") == "into_loop", F.col("path")).alias("below"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _peel_rest(paths: bool):
    """The remaining rounds over all rows of STATE: one task's rows, each node's parent among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        x = pd.concat(frames, ignore_index=True)
        at = {k: i for i, k in enumerate(x["id"])}
        up = [at[p] if isinstance(p, str) else -1 for p in x["parent"]]
        kids, size = x["kids"].tolist(), x["size"].tolist()
        order = [i for i, k in enumerate(kids) if k == 0]
        for i in order:  # grows as parents become leaves
            p = up[i]
            if p >= 0:
                kids[p] -= 1
                size[p] += size[i]
                if kids[p] == 0:
                    order.append(p)
        n = len(x)
        top: list = [None] * n
        path: list = [None] * n
        depth: list = [None] * n
        status: list = [None] * n
        for i in range(n):
            if kids[i] > 0 and status[i] is None:
                ring = [i]
                while up[ring[-1]] != i:
                    ring.append(up[ring[-1]])
                low = min(x["id"].iat[k] for k in ring)
                for k in ring:
                    top[k], status[k], size[k] = low, "loop", None
        names = x["id"].tolist()
        for i in reversed(order):
            p = up[i]
            loose = p >= 0 and status[p] != "tree"
            top[i], status[i] = (names[i] if p < 0 else top[p]), ("into_loop" if loose else "tree")
            depth[i] = 0 if p < 0 else None if loose else depth[p] + 1
            if paths:
                path[i] = [*(path[p] or ()), names[i]] if p >= 0 else [names[i]]
        out = x[["id", "parent", "has_row", "inner"]].assign(top=top, path=path)
        out["depth"], out["subtree_size"], out["status"] = pd.array(depth, "Int64"), pd.array(size, "Int64"), status
        for a in range(0, n, 4096):
            yield out.iloc[a : a + 4096]

    return run


def descendants(placed: DataFrame, below_loops: bool = True) -> DataFrame:
    """(ancestor, id, distance): every node below every node, also among the nodes that lead into a cycle (without ``below_loops``: for
    nodes with a finite path only).  The nodes on a cycle have no subtree and are in no pair."""
    chain = F.coalesce("path", "below") if below_loops else F.col("path")
    x = placed.select("id", chain.alias("chain")).where("size(chain) > 1")
    return x.select("id", F.size("chain").alias("n"), F.posexplode("chain").alias("at", "ancestor")).where("at < n - 1").select("ancestor", "id", (F.col("n") - 1 - F.col("at")).alias("distance"))


def latest(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The non-null values of the row with the highest ``order`` per key (aggregated map-side first)."""
    return df.groupBy(key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


__all__ = ["descendants", "edges", "hierarchy", "latest"]
