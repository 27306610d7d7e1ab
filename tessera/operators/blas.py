"""Vector operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SparseMatrix, Vector
from .multiply import mult


def _both(x: Vector, y: Vector) -> DataFrame:
    """(idx, x, y) of two dense vectors."""
    if x.n != y.n:
        raise ValueError(f"lengths {x.n} and {y.n} differ")
    return x.df.select("idx", F.col("val").alias("x")).join(y.df.select("idx", F.col("val").alias("y")), "idx")


def _total(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.coalesce(name, F.lit(0.0)).alias(name))


def dot_table(x: Vector, y: Vector) -> DataFrame:
    """One row (dot)."""
    return _total(_both(x, y).agg(F.sum(F.col("x") * F.col("y")).alias("dot")), "dot")


def dot(x: Vector, y: Vector) -> float:
    return dot_table(x, y).first()[0]


def axpy(alpha: float, x: Vector, y: Vector) -> Vector:
    """V2: alpha x + y."""
    return Vector(_both(x, y).select("idx", (alpha * F.col("x") + F.col("y")).alias("val")), x.n)


def scal(alpha: float, x: Vector) -> Vector:
    """V3: alpha x."""
    return Vector(x.df.select("idx", (alpha * F.col("val")).alias("val")), x.n)


def norm2_table(x: Vector) -> DataFrame:
    """V4: one row (squared, norm)."""
    return x.df.agg(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0)).alias("squared")).select("squared", F.sqrt("squared").alias("norm"))


def squared_norm(x: Vector) -> float:
    return norm2_table(x).first().squared


def norm2(x: Vector) -> float:
    return math.sqrt(squared_norm(x))


def fused_update(state: DataFrame, alpha: float) -> DataFrame:
    """V5: x += alpha p and r -= alpha ap in one projection of a state (idx, x, r, p, ap)."""
    return state.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("ap")})


def xpby(r: Vector, beta: float, p: Vector) -> Vector:
    """V6: r + beta p."""
    return Vector(_both(r, p).select("idx", (F.col("x") + beta * F.col("y")).alias("val")), r.n)


def residual(a: SparseMatrix, x: Vector, b: Vector) -> Vector:
    """V8: A x - b."""
    return axpy(-1.0, b, mult(a, x))


def residual_norm(a: SparseMatrix, x: Vector, b: Vector) -> float:
    return norm2(residual(a, x, b))


def close(a: float, b: float, eps: float = 2.0**-52) -> bool:
    """Relative comparison."""
    return abs(a - b) <= min(abs(a), abs(b)) * eps
