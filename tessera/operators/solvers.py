"""Conjugate gradients (C1-C6; Hestenes and Stiefel, 1952) with one sum an iteration.

The recurrence is the one of Chronopoulos and Gear (1989): beside x, r and p it keeps
s = A p and w = A r, so that both scalars of an iteration, r.r and w.r, come from one
reduction. An iteration is one job: the projections of the step, the product w = A r,
its join with the state, and a write of the new state to the shared folder that
observes both sums. Plans do not grow, as each iteration reads a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SparseMatrix, Vector
from ..plans.lineage import cut_with
from .blas import norm2_table
from .multiply import product


@dataclass
class Solution:
    """x, the iterations done, and the residual norms (the first is that of b)."""

    x: Vector
    iterations: int
    residuals: list[float] = field(default_factory=list)
    converged: bool = False


def cg(a: SparseMatrix, b: Vector, kmax: int = 100, rtol: float = 1e-10, strategy: str = "auto", cache: bool = True) -> Solution:
    """Solve A x = b from x = 0 (D1); stops when |r| / |b| < rtol, or after kmax iterations without an error.

    All vectors are columns of one state table (idx, x, r, p, s, w). The expanded matrix
    is kept by column, where the product joins; only the state moves. b = 0 gives x = 0
    at once (D6).
    """
    if a.nrows != a.ncols or b.n != a.nrows:
        raise ValueError("CG needs a square matrix and a right-hand side of its size")
    full = a.expanded()
    if cache:
        full = full.with_df(full.df.repartition("col").persist())
    zero = F.lit(0.0)

    def with_product(step: DataFrame) -> tuple[DataFrame, float, float]:
        """The state with w = A r, and the sums r.r and w.r."""
        w = product(full, Vector(step.select("idx", F.col("r").alias("val")), b.n), strategy)
        joined = step.join(w.select(F.col("row").alias("idx"), F.col("val").alias("w")), "idx", "left").withColumn("w", F.coalesce("w", zero))
        state, seen = cut_with(joined, rr=F.sum(F.col("r") * F.col("r")), wr=F.sum(F.col("w") * F.col("r")))
        return state, seen.rr or 0.0, seen.wr or 0.0

    try:
        state, rr, wr = with_product(b.df.select("idx", zero.alias("x"), F.col("val").alias("r"), zero.alias("p"), zero.alias("s")))
        first, alpha, beta = math.sqrt(rr), 0.0, 0.0
        out = Solution(Vector(state.select("idx", F.col("x").alias("val")), b.n), 0, [first], rr == 0)
        if rr == 0:
            return out
        for k in range(1, kmax + 1):
            alpha = rr / (wr - beta * rr / alpha) if k > 1 else rr / wr
            turned = state.withColumns({"p": F.col("r") + beta * F.col("p"), "s": F.col("w") + beta * F.col("s")})
            step = turned.select("idx", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("s")).alias("r"), "p", "s")
            before = rr
            if k < kmax:
                state, rr, wr = with_product(step)
            else:
                state, seen = cut_with(step, rr=F.sum(F.col("r") * F.col("r")))
                rr = seen.rr or 0.0
            beta = rr / before
            out.iterations = k
            out.residuals.append(math.sqrt(rr))
            out.converged = math.sqrt(rr) / first < rtol
            if out.converged:
                break
        out.x = Vector(state.select("idx", F.col("x").alias("val")), b.n)
        return out
    finally:
        if cache:
            full.df.unpersist()


def report(a: SparseMatrix, b: Vector, kmax: int = 100, rtol: float = 1e-10) -> DataFrame:
    """One row (iterations, residual, norm): iterations done, |r| / |b| at the end, and |x|."""
    s = cg(a, b, kmax, rtol)
    last = s.residuals[-1] / s.residuals[0] if s.residuals[0] else 0.0
    return norm2_table(s.x).select(F.lit(s.iterations).cast("long").alias("iterations"), F.lit(last).alias("residual"), "norm")
