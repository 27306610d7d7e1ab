"""Matrices from arrays and from entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENTRIES, SparseMatrix
from ..operators.assemble import assemble


def from_csr(spark: SparkSession, rowptr: Sequence[int], colind: Sequence[int], values: Sequence[float], ncols: int, row_offset: int = 0, nrows: int | None = None) -> SparseMatrix:
    """A block of rows as CSR arrays with global columns; duplicates are summed."""
    if len(rowptr) == 0 or rowptr[-1] != len(colind) or len(colind) != len(values):
        raise ValueError("CSR arrays do not fit together")
    rows = [(row_offset + i, int(colind[k]), float(values[k])) for i in range(len(rowptr) - 1) for k in range(rowptr[i], rowptr[i + 1])]
    return assemble(SparseMatrix(spark.createDataFrame(rows, ENTRIES), nrows if nrows is not None else row_offset + len(rowptr) - 1, ncols))


def from_csr_rows(df: DataFrame, nrows: int, ncols: int) -> SparseMatrix:
    """S9 for a table (row, colind, values), one record for each row."""
    flat = df.select("row", F.explode(F.arrays_zip("colind", "values")).alias("e"))
    return assemble(SparseMatrix(flat.select("row", F.col("e.colind").alias("col"), F.col("e.values").alias("val")), nrows, ncols))


def from_entries(df: DataFrame, nrows: int, ncols: int, symmetric: bool = False) -> SparseMatrix:
    """From (row, col, val); duplicates are summed, symmetric keeps lower and diagonal."""
    a = assemble(SparseMatrix.of(df, nrows, ncols))
    return a.with_df(a.df.where("row >= col"), symmetric=True) if symmetric else a
