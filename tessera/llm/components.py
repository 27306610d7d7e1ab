"""Connected components of an edge table by alternating large and small stars.

Large-star links every larger neighbour of a node to its smallest neighbour,
small-star every smaller one; both keep the components, and together they end in
stars around the smallest node of each component, in few rounds. Edges stay in
tables all the time: each round is cut by a checkpoint in the shared folder, and
the driver only compares two counters. The centre of a large star is in many
edges; see hot_join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Rows of one key that a task may meet in a join.
HOT_ROWS = 100_000


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, total: int, hot_rows: int | None = None) -> DataFrame:
    """many joined with one (a row for each key), where some keys may hold most of many.

    counts: keys and n, the rows of many. Keys with more than hot_rows rows and more
    than 1/256 of the total are fewer than 256: their rows of `one` are broadcast, and
    many's rows with them stay where they are. The others meet by a shuffle.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if total <= hot_rows:
        return many.join(one, keys)
    hot = F.broadcast(counts.where(F.col("n") > max(hot_rows, total // 256)).select(*keys))
    few = F.broadcast(one.join(hot, keys))
    return many.join(few, keys).unionByName(many.join(hot, keys, "left_anti").join(one, keys))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    to = least.select("a", F.least("a", "m").alias("m"))
    return hot_join(both.where("b > a"), to, ["a"], least, 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = hot_join(down, least.select("a", "m"), ["a"], least, total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Edges with a null end or equal ends link nothing; repeated ones count once.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    mark, total = None, now.count()
    while total:
        now = cut(_small_star(_large_star(now, total), total))
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if seen == mark:
            break
        mark, total = seen, seen[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
