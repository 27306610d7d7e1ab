"""Ownership and exchange (X1-X18): what the parts of a vector must get from each other.

The physical exchange is Spark's; these tables are its plan, and the updates are
joins and sums. All eight communication modes of such engines give one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.partition import owner, part_start
from ..model import SparseMatrix, Vector
from .assemble import ghost_columns


def ghost_faults(ghosts: DataFrame, parts: int, n: int) -> DataFrame:
    """For each part of ghosts (part, pos, gidx), those that do not ascend by position, and those in its own range."""
    before = F.lag("gidx").over(Window.partitionBy("part").orderBy("pos"))
    marked = ghosts.withColumns({"_sorted": F.coalesce(F.col("gidx") > before, F.lit(True)), "_own": owner(F.col("gidx"), parts, n) == F.col("part")})
    return marked.groupBy("part").agg(F.count_if(~F.col("_sorted")).alias("unsorted"), F.count_if("_own").alias("own"))


def validate_ghosts(ghosts: DataFrame, parts: int, n: int) -> None:
    """Raise on a ghost that is out of order or lies in its part's own range (fixed texts)."""
    found = ghost_faults(ghosts, parts, n).agg(F.sum("unsorted").alias("unsorted"), F.sum("own").alias("own")).first()
    if found.unsorted:
        raise ValueError("Ghosts must be sorted")
    if found.own:
        raise ValueError("Ghost index in local range")


def ghosts_with_owner(a: SparseMatrix, parts: int) -> DataFrame:
    """(part, gidx, lidx, owner) of all ghosts."""
    return ghost_columns(a, parts).withColumn("owner", owner(F.col("gidx"), parts, a.ncols))


def _pairs(a: SparseMatrix, parts: int) -> DataFrame:
    """(part, owner, n): how many values a part gets from an owner."""
    return ghosts_with_owner(a, parts).groupBy("part", "owner").agg(F.count("*").alias("n"))


def neighbours(a: SparseMatrix, parts: int) -> DataFrame:
    """(part, neighbour), either way."""
    both = F.array(F.struct(F.col("part").alias("part"), F.col("owner").alias("neighbour")), F.struct(F.col("owner").alias("part"), F.col("part").alias("neighbour")))
    return _pairs(a, parts).select(F.explode(both).alias("e")).select("e.part", "e.neighbour").distinct()


def counts(a: SparseMatrix, parts: int) -> DataFrame:
    """For each part and neighbour, values sent and received and where they begin; received ones lie after the owned."""
    got = _pairs(a, parts)
    received = got.select("part", F.col("owner").alias("neighbour"), F.lit(0).cast("long").alias("send"), F.col("n").alias("recv"))
    sent = got.select(F.col("owner").alias("part"), F.col("part").alias("neighbour"), F.col("n").alias("send"), F.lit(0).cast("long").alias("recv"))
    both = received.unionByName(sent).groupBy("part", "neighbour").agg(F.sum("send").alias("send_count"), F.sum("recv").alias("recv_count"))
    before = Window.partitionBy("part").orderBy("neighbour").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    owned = part_start(F.col("part") + 1, parts, a.ncols) - part_start(F.col("part"), parts, a.ncols)
    return both.select("part", "neighbour", "send_count", "recv_count", start("send_count").alias("send_offset"), (owned + start("recv_count")).alias("recv_offset"))


def indices(a: SparseMatrix, parts: int) -> DataFrame:
    """(part, neighbour, lidx): owned places whose values a part sends to a neighbour."""
    at = F.col("gidx") - part_start(F.col("owner"), parts, a.ncols)
    return ghosts_with_owner(a, parts).select(F.col("owner").alias("part"), F.col("part").alias("neighbour"), at.alias("lidx"))


def ghost_update(a: SparseMatrix, x: Vector, parts: int) -> DataFrame:
    """(part, gidx, lidx, val): the owners' values in all ghost places."""
    return ghost_columns(a, parts).join(x.df.withColumnRenamed("idx", "gidx"), "gidx").select("part", "gidx", "lidx", "val")


def reverse_update(x: Vector, ghosts: DataFrame) -> Vector:
    """Add the values in ghost places (gidx, val) to their owners'."""
    all_ = x.df.unionByName(ghosts.select(F.col("gidx").alias("idx"), "val"))
    return Vector(all_.groupBy("idx").agg(F.sum("val").alias("val")), x.n)


def gather(x: Vector, places: DataFrame) -> DataFrame:
    """(pos, val): out[pos] = x[idx] for a table (pos, idx)."""
    return places.join(x.df, "idx").select("pos", "val")
