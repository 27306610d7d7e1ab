"""Row-range ownership (section 1.4, X1) and prefix sums without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def owner_ranges(parts: int, n: int) -> list[int]:
    """Bounds of the parts: the first n mod parts have one index more."""
    q, r = divmod(n, parts)
    return [k * (q + 1) if k < r else k * q + r for k in range(parts + 1)]


def ranges_table(spark: SparkSession, parts: int, n: int) -> DataFrame:
    """(part, lo, hi), in closed form for any number of parts."""
    q, r = divmod(n, parts)
    start = lambda k: F.when(k < r, k * (q + 1)).otherwise(k * q + r)
    return spark.range(parts).select(F.col("id").cast("int").alias("part"), start(F.col("id")).alias("lo"), start(F.col("id") + 1).alias("hi"))


def ranges_from_sizes(sizes: DataFrame) -> DataFrame:
    """X1 for arbitrary sizes: (part, lo, hi) from (part, n) by a prefix sum."""
    total = prefix_sums(sizes.select("part", F.col("n").cast("long").alias("n")), "part", "n", "hi")
    return total.select("part", (F.col("hi") - F.col("n")).alias("lo"), "hi")


def owner(i: Column, parts: int, n: int) -> Column:
    """The part that owns index i, as a closed expression."""
    q, r = divmod(n, parts)
    first = _div(i, q + 1)
    return (F.when(i < r * (q + 1), first).otherwise(r + _div(i - r * (q + 1), q)) if q else first).cast("int")


def _div(a: Column, b: int) -> Column:
    """Whole division of non-negative longs."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def part_start(part: Column, parts: int, n: int) -> Column:
    q, r = divmod(n, parts)
    p = part.cast("long")
    return F.when(p < r, p * (q + 1)).otherwise(p * q + r)


def prefix_sums(df: DataFrame, order: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with the inclusive running sum of value by order (a long, unique).

    Two levels: running sums within blocks of the order, and of the blocks' totals;
    only the totals, one row for each `block` values of the order, meet in one task.
    """
    at = F.col(order).cast("long")
    dealt = df.withColumn("_block", _div(at, block))
    totals = dealt.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = totals.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_block").orderBy(order))
    return dealt.withColumn("_within", within).join(before, "_block").withColumn(name, F.col("_within") + F.col("_before")).drop("_block", "_within", "_before")
