"""Assembly and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.partition import owner, part_start
from ..model import SparseMatrix


def assemble(a: SparseMatrix, *contributions: DataFrame) -> SparseMatrix:
    """A1, A2: sum repeated (row, col), of a and of rows that others hold for it.

    A contribution is a table (row, col, val) with global indices; the shuffle of the
    sum is what brings it to the owner. Sums that are zero stay entries (D18).
    """
    df = a.df
    for c in contributions:
        df = df.unionByName(c.select("row", "col", F.col("val").cast(a.dtype).alias("val")))
    return a.with_df(df.groupBy("row", "col").agg(F.sum("val").cast(a.dtype).alias("val")))


def row_ghosts(held: DataFrame, parts: int, nrows: int, part: str = "part") -> DataFrame:
    """A2: the entries that a part holds but does not own, with the owner they go to."""
    return held.withColumn("owner", owner(F.col("row"), parts, nrows)).where(F.col(part) != F.col("owner"))


def csr(a: SparseMatrix) -> DataFrame:
    """(row, colind, values), one record for each row with entries; columns ascend."""
    rows = a.expanded().df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    return rows.select("row", F.col("e.col").alias("colind"), F.col("e.val").alias("values"))


def csr_entries(rows: DataFrame) -> DataFrame:
    """The entries (row, col, val) of CSR rows."""
    flat = rows.select("row", F.explode(F.arrays_zip("colind", "values")).alias("e"))
    return flat.select("row", F.col("e.colind").alias("col"), F.col("e.values").alias("val"))


def symmetric(a: SparseMatrix, validate: bool = False) -> SparseMatrix:
    """Keep the strictly lower triangle and the diagonal of a symmetric matrix.

    validate raises if an upper entry differs from its mirror image.
    """
    if validate:
        up = a.df.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("val").alias("other"))
        odd = a.df.join(up, ["row", "col"], "full").where(~F.col("val").eqNullSafe(F.col("other")))
        if not odd.isEmpty():
            raise ValueError("the matrix is not symmetric")
    return a.with_df(a.df.where("row >= col"), symmetric=True)


def lower(a: SparseMatrix) -> DataFrame:
    """Strictly lower entries."""
    return a.df.where("row > col")


def diagonal(a: SparseMatrix) -> DataFrame:
    """(idx, val) of the diagonal, duplicates summed; a missing index is zero."""
    return a.df.where("row = col").groupBy(F.col("row").alias("idx")).agg(F.sum("val").cast(a.dtype).alias("val"))


def split_local(a: SparseMatrix, parts: int) -> DataFrame:
    """The entries with part (the row's owner) and is_local (it owns the column too)."""
    of_row, of_col = owner(F.col("row"), parts, a.nrows), owner(F.col("col"), parts, a.ncols)
    return a.df.withColumns({"part": of_row, "is_local": of_row == of_col})


def symmetric_blocks(a: SparseMatrix, parts: int) -> DataFrame:
    """Kind of each entry of a full symmetric matrix in the per-part storage: lower, diagonal or remote; in-block upper ones go."""
    kinds = F.when(~F.col("is_local"), "remote").when(F.col("row") > F.col("col"), "lower").when(F.col("row") == F.col("col"), "diagonal")
    return split_local(a, parts).withColumn("kind", kinds).where("kind is not null")


def ghost_columns(a: SparseMatrix, parts: int) -> DataFrame:
    """(part, gidx, lidx): columns a part needs and does not own, numbered in ascending order after its own."""
    out = split_local(a, parts).where("not is_local").select("part", F.col("col").alias("gidx")).distinct()
    owned = part_start(F.col("part") + 1, parts, a.ncols) - part_start(F.col("part"), parts, a.ncols)
    number = F.row_number().over(Window.partitionBy("part").orderBy("gidx"))
    return out.select("part", "gidx", (owned + number - 1).alias("lidx"))


def global_to_local(a: SparseMatrix, parts: int) -> DataFrame:
    """A4: entries in a part's own numbering: (part, lrow, lcol, val)."""
    at, ghosts = split_local(a, parts), ghost_columns(a, parts)
    joined = at.join(ghosts.withColumnRenamed("gidx", "col"), ["part", "col"], "left")
    inside = F.col("col") - part_start(F.col("part"), parts, a.ncols)
    lcol = F.when(F.col("is_local"), inside).otherwise(F.col("lidx"))
    return joined.select("part", (F.col("row") - part_start(F.col("part"), parts, a.nrows)).alias("lrow"), F.coalesce(lcol, F.raise_error("no local index").cast("long")).alias("lcol"), "val")


def local_to_global(local: DataFrame, ghosts: DataFrame, parts: int, nrows: int, ncols: int) -> DataFrame:
    """A3: the entries (row, col, val) of (part, lrow, lcol, val): below the owned count an offset, above it the ghost list."""
    start, end = part_start(F.col("part"), parts, ncols), part_start(F.col("part") + 1, parts, ncols)
    joined = local.join(ghosts.select("part", "gidx", F.col("lidx").alias("lcol")), ["part", "lcol"], "left")
    col = F.when(F.col("lcol") < end - start, F.col("lcol") + start).otherwise(F.col("gidx"))
    return joined.select((F.col("lrow") + part_start(F.col("part"), parts, nrows)).alias("row"), F.coalesce(col, F.raise_error("no global index").cast("long")).alias("col"), "val")
