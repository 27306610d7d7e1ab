"""Products y = alpha A x + beta y.

Strategies are hints and never change the result:

auto       an equi-join on col = idx and a partial sum by row; Catalyst picks the
           join from sizes, adaptive execution splits skewed columns
broadcast  x goes to all executors if its known length is within BROADCAST_ROWS,
           else as auto
shuffle    both sides are shuffled by column
csr        rows as arrays and x as one array value, an aggregate over each row;
           needs a dense x within BROADCAST_ROWS, else as auto
blocked    entries and x meet by block of columns in Arrow batches, numpy sums them
           per row; a block with more than TASK_ENTRIES is dealt over as many tasks

x is dense by contract, so rows without entries are the only ones to pad: they get
beta y (D3). beta = 0 overwrites (D2).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SparseMatrix, Vector
from ..plans.lineage import cut, cut_with
from .assemble import csr as csr_rows
from .assemble import diagonal, lower, split_local

#: Rows of x (16 bytes each) that may be broadcast: 32 MB.
BROADCAST_ROWS = 2_000_000
BLOCK_COLUMNS = 1 << 16
#: Entries of a block that meet in one task, about.
TASK_ENTRIES = 4_000_000
STRATEGIES = ("auto", "broadcast", "shuffle", "csr", "blocked")


def _by_join(entries: DataFrame, x: Vector, hint: str | None) -> DataFrame:
    side = x.df.withColumnRenamed("val", "_x")
    if hint == "broadcast" and x.n <= BROADCAST_ROWS:
        side = F.broadcast(side)
    elif hint == "shuffle":
        side = side.hint("merge")
    return entries.join(side, entries["col"] == side["idx"]).select("row", (F.col("val") * F.col("_x")).alias("val"))


def _by_arrays(a: SparseMatrix, x: Vector) -> DataFrame:
    whole = x.df.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda e: e["val"]).alias("_x"))
    rows = csr_rows(a).crossJoin(F.broadcast(whole))  # one row, within BROADCAST_ROWS
    terms = F.zip_with("colind", "values", lambda c, v: v * F.get("_x", c.cast("int")))
    return rows.select("row", F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("val"))


def _by_blocks(entries: DataFrame, x: Vector, task_entries: int) -> DataFrame:
    b = BLOCK_COLUMNS
    block = lambda c: F.call_function("div", c, F.lit(b).cast("long")).alias("_block")
    # one row for each 65,536 columns
    salts = entries.groupBy(block("col")).agg(F.ceil(F.count("*") / task_entries).cast("int").alias("_salts"))
    left = entries.withColumn("_block", block("col")).join(F.broadcast(salts), "_block")
    left = left.select("_block", F.pmod(F.xxhash64("row"), F.col("_salts")).cast("int").alias("_salt"), "row", (F.col("col") % b).cast("int").alias("at"), F.col("val").cast("double").alias("val"))
    right = x.df.select(block("idx"), (F.col("idx") % b).cast("int").alias("at"), F.col("val").cast("double").alias("val")).join(F.broadcast(salts), "_block")
    right = right.select("_block", "at", "val", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))

    def product(entries: pa.Table, x: pa.Table) -> pa.Table:
        dense = np.zeros(b)
        dense[x.column("at").to_numpy()] = x.column("val").to_numpy()
        rows, place = np.unique(entries.column("row").to_numpy(), return_inverse=True)
        sums = np.bincount(place, entries.column("val").to_numpy() * dense[entries.column("at").to_numpy()], len(rows)) if len(rows) else np.zeros(0)
        return pa.table({"row": pa.array(rows, pa.int64()), "val": pa.array(sums, pa.float64())})

    return left.groupBy("_block", "_salt").cogroup(right.groupBy("_block", "_salt")).applyInArrow(product, "row long, val double")


def terms(a: SparseMatrix, x: Vector, strategy: str = "auto", task_entries: int = TASK_ENTRIES) -> DataFrame:
    """(row, val): what A x sums up by row; one or more records for each row with entries."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {STRATEGIES}")
    if strategy == "csr" and x.n <= BROADCAST_ROWS:
        return _by_arrays(a, x)
    entries = a.expanded().df
    if strategy == "blocked":
        return _by_blocks(entries, x, task_entries)
    return _by_join(entries, x, strategy)


def product(a: SparseMatrix, x: Vector, strategy: str = "auto") -> DataFrame:
    """(row, val) of A x for the rows that have entries."""
    return terms(a, x, strategy).groupBy("row").agg(F.sum("val").alias("val"))


def padded(parts: DataFrame, a: SparseMatrix, alpha: float = 1.0, beta: float = 0.0, y: Vector | None = None) -> Vector:
    """alpha times the sums of parts by row, plus beta y, for every row of the matrix.

    parts has row and one or more columns of terms, which are summed apart. Rows
    without entries come from a union before the sum, not from a join after it, so
    there is one shuffle of partial sums.
    """
    columns = [c for c in parts.columns if c != "row"]
    zero = F.lit(None).cast("double")
    if y is not None and beta:
        base = y.df.select(F.col("idx").alias("row"), *(zero.alias(c) for c in columns), (F.lit(float(beta)) * F.col("val")).alias("_y"))
    else:
        base = a.df.sparkSession.range(a.nrows).select(F.col("id").alias("row"), *(zero.alias(c) for c in columns), F.lit(0.0).alias("_y"))
    all_ = parts.select("row", *(F.col(c).cast("double").alias(c) for c in columns), zero.alias("_y")).unionByName(base)
    sums = all_.groupBy("row").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in [*columns, "_y"]))
    total = F.lit(float(alpha)) * sum((F.col(c) for c in columns[1:]), F.col(columns[0])) + F.col("_y")
    return Vector(sums.select(F.col("row").alias("idx"), total.cast(a.dtype).cast("double").alias("val")), a.nrows)


def _fits(a: SparseMatrix, x: Vector) -> None:
    if x.n != a.ncols:
        raise ValueError(f"the matrix has {a.ncols} columns, the vector {x.n} values")


def mult(a: SparseMatrix, x: Vector, strategy: str = "auto", alpha: float = 1.0, beta: float = 0.0, y: Vector | None = None) -> Vector:
    """Alpha A x + beta y."""
    _fits(a, x)
    return padded(terms(a, x, strategy), a, alpha, beta, y)


def mult_overlapped(a: SparseMatrix, x: Vector, parts: int, strategy: str = "auto") -> Vector:
    """The product of own columns and that of others', added.

    Both come from one pass over the entries: the side is a column of the partial sum.
    """
    _fits(a, x)
    at = split_local(a.expanded(), parts)
    side = x.df.withColumnRenamed("val", "_x")
    term = F.col("val") * F.col("_x")
    parts = at.join(side, at["col"] == side["idx"]).select("row", F.when(F.col("is_local"), term).alias("own"), F.when(~F.col("is_local"), term).alias("other"))
    return padded(parts, a)


def mult_symmetric(a: SparseMatrix, x: Vector, strategy: str = "auto") -> Vector:
    """From lower triangle and diagonal, whatever a's own storage."""
    stored = a if a.symmetric else a.with_df(a.df.where("row >= col"), symmetric=True)
    return mult(stored, x, strategy)


def mult_diagonal(a: SparseMatrix, x: Vector, alpha: float = 1.0, beta: float = 0.0, y: Vector | None = None) -> Vector:
    """Alpha d x + beta y with the diagonal only."""
    _fits(a, x)
    d = diagonal(a).withColumnRenamed("val", "_d")
    return padded(d.join(x.df, "idx").select(F.col("idx").alias("row"), (F.col("_d") * F.col("val")).alias("val")), a, alpha, beta, y)


def transposed(a: SparseMatrix) -> SparseMatrix:
    """Rows and columns exchanged; a symmetric matrix is its own transpose."""
    if a.symmetric:
        return a
    return SparseMatrix(a.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), a.ncols, a.nrows, False, a.dtype)


def mult_transposed(a: SparseMatrix, b: Vector, strategy: str = "auto") -> Vector:
    """The transpose times b."""
    return mult(transposed(a), b, strategy)


def power_apply(a: SparseMatrix, x: Vector, times: int = 100, cut_every: int = 5, strategy: str = "auto") -> Vector:
    """X <- A x, repeatedly; the lineage is cut in the shared folder every few steps."""
    for k in range(1, times + 1):
        x = mult(a, x, strategy)
        if k % cut_every == 0 and k < times:
            x = Vector(cut(x.df), x.n)
    return x


def restrict_prolong(r: SparseMatrix, q: Vector, cycles: int = 10, strategy: str = "auto") -> Iterator[tuple[float, float, Vector, Vector]]:
    """p = R' q, q = R p; yields (|p|^2, |q|^2, p, q) after each cycle."""
    squares = F.sum(F.col("val") * F.col("val"))
    for _ in range(cycles):
        df, up = cut_with(mult_transposed(r, q, strategy).df, n=squares)
        p = Vector(df, r.ncols)
        df, down = cut_with(mult(r, p, strategy).df, n=squares)
        q = Vector(df, r.nrows)
        yield up.n or 0.0, down.n or 0.0, p, q


__all__ = ["lower", "mult", "mult_diagonal", "mult_overlapped", "mult_symmetric", "mult_transposed", "power_apply", "product", "restrict_prolong", "terms", "transposed"]
