"""Sinks and sources in Spark's own storage.

A bucketed table keeps the entries dealt by column, so a product shuffles only x;
its shape is kept as a table property, since a matrix may end in empty rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import SparseMatrix, Vector


def save_matrix(a: SparseMatrix, path: str) -> None:
    """Entries and shape as Parquet under a path that Spark can write."""
    a.df.write.mode("overwrite").parquet(f"{path}/entries")
    shape = a.df.sparkSession.range(1).select(F.lit(a.nrows).cast("long").alias("nrows"), F.lit(a.ncols).cast("long").alias("ncols"), F.lit(a.symmetric).alias("symmetric"), F.lit(a.dtype).alias("dtype"))
    shape.write.mode("overwrite").parquet(f"{path}/shape")


def load_matrix(spark: SparkSession, path: str) -> SparseMatrix:
    s = spark.read.parquet(f"{path}/shape").first()
    return SparseMatrix(spark.read.parquet(f"{path}/entries"), s.nrows, s.ncols, s.symmetric, s.dtype)


def save_vector(x: Vector, path: str) -> None:
    x.df.write.mode("overwrite").parquet(f"{path}/values")
    x.df.sparkSession.range(1).select(F.lit(x.n).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/shape")


def load_vector(spark: SparkSession, path: str) -> Vector:
    return Vector(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/shape").first().n)


def save_bucketed(a: SparseMatrix, table: str, buckets: int) -> None:
    """All entries (mirrored ones too) as a table bucketed and sorted by column, for many products."""
    full = a.expanded()
    full.df.write.mode("overwrite").bucketBy(buckets, "col").sortBy("col").saveAsTable(table)
    full.df.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('nrows' = '{a.nrows}', 'ncols' = '{a.ncols}', 'dtype' = '{a.dtype}')")


def load_bucketed(spark: SparkSession, table: str) -> SparseMatrix:
    kept = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return SparseMatrix(spark.table(table), int(kept["nrows"]), int(kept["ncols"]), False, kept["dtype"])
