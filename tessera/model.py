"""Matrices and vectors as DataFrames (M1, M2, M4, M5, M6, M8).

A matrix is a table (row, col, val) with its shape beside it; a vector is a table
(idx, val) with its length. Shapes are given, never inferred, so empty trailing
rows count. Stored zeros are entries.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "row long, col long, val double"
VECTOR = "idx long, val double"
TYPES = ("double", "float")


@dataclass(frozen=True)
class Vector:
    """A dense vector: one row for each index from 0 to n - 1."""

    df: DataFrame
    n: int

    @classmethod
    def of(cls, df: DataFrame, n: int, idx: str | Column = "idx", val: str | Column = "val") -> Vector:
        at, v = (F.col(c) if isinstance(c, str) else c for c in (idx, val))
        return cls(df.select(at.cast("long").alias("idx"), v.cast("double").alias("val")), n)

    @classmethod
    def constant(cls, spark: SparkSession, n: int, value: float) -> Vector:
        return cls(spark.range(n).select(F.col("id").alias("idx"), F.lit(float(value)).alias("val")), n)

    def dense(self) -> Vector:
        """The vector with a row for every index; missing ones are zero."""
        all_ = self.df.sparkSession.range(self.n).withColumnRenamed("id", "idx")
        return Vector(all_.join(self.df, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val")), self.n)


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (row, col, val) of an nrows x ncols matrix.

    symmetric: only the strictly lower triangle and the diagonal are stored, and
    they are the truth whatever the partitioning (D5).
    """

    df: DataFrame
    nrows: int
    ncols: int
    symmetric: bool = False
    dtype: str = "double"

    def __post_init__(self) -> None:
        if self.dtype not in TYPES:
            raise ValueError(f"{self.dtype} is not supported; types are {TYPES}")
        if self.symmetric and self.nrows != self.ncols:
            raise ValueError("a symmetric matrix is square")

    @classmethod
    def of(cls, df: DataFrame, nrows: int, ncols: int, row: str = "row", col: str = "col", val: str = "val", dtype: str = "double") -> SparseMatrix:
        """From a DataFrame of entries, duplicates allowed."""
        return cls(df.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(val).cast(dtype).alias("val")), nrows, ncols, False, dtype)

    def with_df(self, df: DataFrame, **changes) -> SparseMatrix:
        return replace(self, df=df, **changes)

    def expanded(self) -> SparseMatrix:
        """All entries of a symmetric matrix: lower ones in both orientations (one pass, no union of scans)."""
        if not self.symmetric:
            return self
        both = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col"))).otherwise(F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))))
        df = self.df.select(F.explode(both).alias("at"), "val").select("at.row", "at.col", "val")
        return replace(self, df=df, symmetric=False)

    def check(self) -> None:
        """Raise if an entry lies outside the shape or has a null (one pass)."""
        ok = F.col("row").between(0, self.nrows - 1) & F.col("col").between(0, self.ncols - 1) & F.col("val").isNotNull()
        if self.symmetric:
            ok &= F.col("row") >= F.col("col")
        if not self.df.where(~F.coalesce(ok, F.lit(False))).isEmpty():
            raise ValueError("entries outside the matrix, or null")
