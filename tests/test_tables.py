"""Matrices and vectors in Spark's own storage."""

from tessera.model import Vector
from tessera.operators import assemble, multiply
from tessera.sources import from_csr
from tessera.sources.tables import load_bucketed, load_matrix, load_vector, save_bucketed, save_matrix, save_vector

from .test_matrices import COLIND, ROWPTR, VALUES


def test_round_trips(spark, tmp_path):
    a = from_csr(spark, ROWPTR, COLIND, VALUES, 5, nrows=7)
    x = Vector(spark.range(5).selectExpr("id as idx", "double(id + 1) as val"), 5)
    save_matrix(a, str(tmp_path / "a"))
    save_vector(x, str(tmp_path / "x"))
    b, y = load_matrix(spark, str(tmp_path / "a")), load_vector(spark, str(tmp_path / "x"))
    assert (b.nrows, b.ncols, y.n) == (7, 5, 5)
    assert [r.val for r in multiply.mult(b, y).df.orderBy("idx").collect()] == [-15, 24, 14, 49, 28, 0, 0]


def test_bucketed_entries_are_not_shuffled(spark, tmp_path):
    low = assemble.symmetric(from_csr(spark, ROWPTR, COLIND, VALUES, 5))
    spark.sql("DROP TABLE IF EXISTS bucketed_entries")
    save_bucketed(low, "bucketed_entries", 4)
    a = load_bucketed(spark, "bucketed_entries")
    x = Vector(spark.range(5).selectExpr("id as idx", "double(id + 1) as val"), 5)
    y = multiply.mult(a, x, "shuffle")
    assert [r.val for r in y.df.orderBy("idx").collect()] == [-15, 24, 14, 49, 28]
    plan = multiply.product(a, x, "shuffle")._jdf.queryExecution().executedPlan().toString()
    side = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "Bucketed: true" in side
    spark.sql("DROP TABLE bucketed_entries")
