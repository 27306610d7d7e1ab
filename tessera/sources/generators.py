"""Generated inputs (S11, S12), made in parallel by expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import SparseMatrix, Vector

GAMMA = 0.1


def tridiagonal(spark: SparkSession, n: int, gamma: float = GAMMA) -> SparseMatrix:
    """Rows (g, 1 - 2g, g); the first and last (1 - g, g). Rows sum to 1."""
    i = F.col("id")
    diagonal = F.lit(1.0) - F.when(i > 0, gamma).otherwise(0.0) - F.when(i < n - 1, gamma).otherwise(0.0)
    inner = F.when((i > 0) & (i < n - 1), F.lit(1.0 - 2 * gamma)).otherwise(diagonal)
    entries = F.array(
        F.struct((i - 1).alias("col"), F.lit(gamma).alias("val")),
        F.struct(i.alias("col"), inner.alias("val")),
        F.struct((i + 1).alias("col"), F.lit(gamma).alias("val")),
    )
    df = spark.range(n).select(i.alias("row"), F.explode(entries).alias("e")).select("row", "e.col", "e.val")
    return SparseMatrix(df.where(f"col >= 0 and col < {n}"), n, n)


def gaussian(spark: SparkSession, n: int) -> Vector:
    """exp(-10 (5 (i / n - 0.5)) ** 2)."""
    z = 5.0 * (F.col("id") / float(n) - 0.5)
    return Vector(spark.range(n).select(F.col("id").alias("idx"), F.exp(-10.0 * (z * z)).alias("val")), n)
