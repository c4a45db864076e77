"""Nearest peers in feature space, blocked by area.

The pool of each block is cut into cells by count: a cell with too many members is cut at the means of its three widest
dimensions, and again until all cells are small, so the depth of the tree follows the pool. A row walks down the tree a few
levels at a time and keeps only cells that can still hold a peer. It opens the nearest cell first; the distances found
there then decide which others it opens at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .cohorts import group_zscores

#: Dimensions cut at once, and cuts that a row steps down at once: at most 8**2 cells are measured per step and kept cell.
CUT_DIMENSIONS, STEP = 3, 2


def _box_bounds(z: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Squared smallest and largest distance from vector ``z`` to the box [low, high]."""

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v * v)

    gap = F.zip_with(z, F.zip_with(low, high, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                     lambda v, box: F.greatest(box["a"] - v, v - box["b"], F.lit(0.0)))
    reach = F.zip_with(z, F.zip_with(low, high, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                       lambda v, box: F.greatest(F.abs(v - box["a"]), F.abs(v - box["b"])))
    return total(gap), total(reach)


def _apart(a: str, b: str) -> Column:
    """Squared distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.lit(0.0), lambda acc, v: acc + v * v)


def cut_by_count(pool: DataFrame, block: str, dimensions: int, leaf: int) -> tuple[DataFrame, int]:
    """Pool members (block, ..., z) with ``cell``, the path of their leaf, and the depth of the deepest leaf.

    Rounds grow with the logarithm of the largest pool. Members at one point stay together.
    """
    cut, depth = pool.withColumn("cell", F.array().cast("array<int>")), 0
    each = range(dimensions)
    while True:
        sizes = cut.groupBy(block, "cell").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.struct((F.max(F.col("z")[i]) - F.min(F.col("z")[i])).alias("width"), F.lit(i).alias("d"), F.avg(F.col("z")[i]).alias("at")) for i in each]).alias("spread"),
        )
        widest = F.slice(F.sort_array(F.col("spread"), False), 1, CUT_DIMENSIONS)
        crowded = stored(sizes.where(F.col("n") > leaf).withColumn("cuts", F.filter(widest, lambda x: x["width"] > 0)).where(F.size("cuts") > 0).select(block, "cell", "cuts"), "crowded-cells")
        if crowded.isEmpty():
            return cut, depth
        child = F.aggregate("cuts", F.lit(0), lambda acc, x: acc * 2 + (F.get("z", x["d"]) > x["at"]).cast("int"))
        cut = stored(
            cut.join(crowded, [block, "cell"], "left").withColumn("cell", F.when(F.col("cuts").isNull(), F.col("cell")).otherwise(F.concat("cell", F.array(child)))).drop("cuts"),
            "peer-cells",
        )
        depth += 1


def opened_cells(rows: DataFrame, members: DataFrame, key: str, block: str, dimensions: int, depth: int, k: int) -> DataFrame:
    """Leaves that may hold one of a row's ``k`` nearest members: key, block, z, m (near, far, cell, n, nearest first).

    Boxes are known at every STEP-th depth. At each, a row's cells give a distance within which k + 1 members certainly
    lie; cells beyond it are dropped with all that is below them.
    """
    leaves = members.groupBy(block, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("z")[i]) for i in range(dimensions)]).alias("lo"), F.array(*[F.max(F.col("z")[i]) for i in range(dimensions)]).alias("hi")
    )
    leaves = stored(leaves, "peer-leaves")

    def level(at: int) -> DataFrame:
        """Boxes of all cells cut off at a depth, listed by the cell STEP above."""
        path = F.slice("cell", 1, at)
        boxes = leaves.groupBy(block, path.alias("cell")).agg(
            F.sum("n").alias("n"), F.array(*[F.min(F.col("lo")[i]) for i in range(dimensions)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(dimensions)]).alias("hi")
        )
        return boxes.groupBy(block, F.slice("cell", 1, at - STEP).alias("above")).agg(F.collect_list(F.struct("cell", "n", "lo", "hi")).alias("cells"))

    def measured(c: Column) -> Column:
        near, far = _box_bounds(F.col("z"), c["lo"], c["hi"])
        return F.struct(near.alias("near"), far.alias("far"), c["cell"].alias("cell"), c["n"].alias("n"))

    by_far = F.sort_array(F.transform("m", lambda c: F.struct(c["far"], c["n"])))
    bound = F.aggregate(
        by_far, F.struct(F.lit(0).cast("long").alias("have"), F.lit(float("inf")).alias("bound")),
        lambda acc, c: F.struct(
            (acc["have"] + c["n"]).alias("have"),
            F.when((acc["have"] < k + 1) & (acc["have"] + c["n"] >= k + 1), c["far"]).otherwise(acc["bound"]).alias("bound"),
        ),
        lambda acc: acc["bound"],
    )

    def kept(measured_rows: DataFrame) -> DataFrame:
        # the one-element array makes the bound a value of its own, which is not computed again for each cell
        close = F.transform(F.array(bound), lambda b: F.filter("m", lambda c: c["near"] <= b * (1 + 1e-9)))[0]
        return measured_rows.select(key, block, "z", F.sort_array(close).alias("m"))

    top = level(STEP).drop("above")
    found = kept(rows.select(key, block, "z").join(top, block).select(key, block, "z", F.transform("cells", measured).alias("m")))
    for at in range(2 * STEP, depth + STEP, STEP):
        # A cell that is a leaf already lists itself.
        below = level(at)
        stepped = found.select(key, block, "z", F.explode("m.cell").alias("above")).join(below, [block, "above"])
        found = kept(stepped.select(key, block, "z", F.transform("cells", measured).alias("m")).groupBy(key, block).agg(F.first("z").alias("z"), F.flatten(F.collect_list("m")).alias("m")))
    return found


def knn_peers(
    df: DataFrame, key: str, block: str, columns: list[str], score: str, k: int = 3, pool_score: float = 80.0,
    min_pool: int = 10, leaf: int = 64,
) -> DataFrame:
    """The ``k`` nearest members of each block's high-scoring pool, in z-score space, never the row itself.

    Blocks whose pool has fewer than ``min_pool`` members get no peers; equal distances go to the smaller key. Of members
    at one point only the k + 1 smallest keys can be among anyone's nearest, so a crowd at one point costs no more.
    """
    z = group_zscores(df, [block], columns).select(
        key, block, score, F.array(*[F.coalesce(F.col(f"{c}_z"), F.lit(0.0)) for c in columns]).alias("z")
    )
    z = stored(z, "peer-vectors")
    pool = z.where(F.col(score) >= pool_score)
    large = pool.groupBy(block).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_pool).select(block)
    same = Window.partitionBy(block, "z").orderBy(key)
    useful = pool.join(large, block).withColumn("__at", F.row_number().over(same)).where(F.col("__at") <= k + 1).select(key, block, "z")
    members, depth = cut_by_count(useful, block, len(columns), max(leaf, k + 1))
    found = stored(opened_cells(z, members, key, block, len(columns), depth, k), "peer-candidates")
    inside = members.select(block, "cell", F.col(key).alias("peer"), F.col("z").alias("pz"))

    def opened(cells: DataFrame) -> DataFrame:
        return cells.join(inside, [block, "cell"]).where(F.col("peer") != F.col(key)).select(key, block, "peer", _apart("z", "pz").alias("dist2"))

    first = found.select(key, block, "z", F.get(F.filter("m", lambda c: c["n"] > k), F.lit(0))["cell"].alias("cell")).where("cell is not null")
    reach = opened(first).groupBy(key).agg(F.sort_array(F.collect_list("dist2"))[k - 1].alias("reach"))
    close = F.filter("m", lambda c: c["near"] <= F.coalesce(F.col("reach"), F.lit(float("inf"))) * (1 + 1e-9))
    others = found.join(reach, key, "left").select(key, block, "z", F.explode(close).alias("c")).select(key, block, "z", F.col("c.cell").alias("cell"))
    order = Window.partitionBy(key).orderBy("dist2", "peer")
    return opened(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
