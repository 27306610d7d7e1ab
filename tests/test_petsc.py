"""PETSc files: round trips over partitions, and damaged files."""

import numpy as np
import pytest

from tessera.model import Vector
from tessera.operators import multiply
from tessera.sources.petsc import MatrixReader
from tessera.sources import from_csr, read_matrix, read_vector, write_matrix, write_vector

from .test_matrices import COLIND, ROWPTR, VALUES


@pytest.fixture
def files(spark, tmp_path):
    a = from_csr(spark, ROWPTR, COLIND, VALUES, 5)
    x = Vector(spark.createDataFrame([(i, float(i + 1)) for i in range(5)], "idx long, val double"), 5)
    write_matrix(a, str(tmp_path / "a.dat"))
    write_vector(x, str(tmp_path / "x.dat"))
    return str(tmp_path / "a.dat"), str(tmp_path / "x.dat")


def test_layout_is_the_published_one(files):
    want = np.array([1211216, 5, 5, 15], ">i4").tobytes() + np.array([3, 3, 3, 4, 2], ">i4").tobytes() + np.array(COLIND, ">i4").tobytes() + np.array(VALUES, ">f8").tobytes()
    assert open(files[0], "rb").read() == want
    assert open(files[1], "rb").read() == np.array([1211214, 5], ">i4").tobytes() + np.arange(1, 6).astype(">f8").tobytes()


@pytest.mark.parametrize("parts", [0, 1, 2, 3, 7])
def test_read_by_partitions(spark, files, parts):
    a, x = read_matrix(spark, files[0], parts), read_vector(spark, files[1], parts)
    assert (a.nrows, a.ncols, a.df.count(), x.n) == (5, 5, 15, 5)
    assert [r.val for r in multiply.mult(a, x).df.orderBy("idx").collect()] == [-15, 24, 14, 49, 28]
    low = read_matrix(spark, files[0], parts, symmetric=True)
    assert low.df.count() == 10
    assert [r.val for r in multiply.mult(low, x).df.orderBy("idx").collect()] == [-15, 24, 14, 49, 28]
    assert read_matrix(spark, "file://" + files[0], parts, sum_duplicates=True).df.count() == 15


def test_partitions_are_balanced_by_entries(spark, tmp_path):
    n = [0, 90, 1, 1, 0, 2, 30, 1, 0, 60, 0]
    a = from_csr(spark, [sum(n[:i]) for i in range(len(n) + 1)], [c for k in n for c in range(k)], [float(c) for k in n for c in range(k)], 100)
    path = str(tmp_path / "skew.dat")
    write_matrix(a, path)
    for parts in (1, 2, 3, 5, 40):
        found = MatrixReader(path, parts).partitions()
        assert len(found) == parts and found[0].lo == 0 and found[-1].hi == len(n) and all(x.hi == y.lo for x, y in zip(found, found[1:]))
        assert [p.first for p in found] == [sum(n[: p.lo]) for p in found]
        assert max(sum(n[p.lo : p.hi]) for p in found) <= sum(n) / parts + max(n)
        got = read_matrix(spark, path, parts, sum_duplicates=False).df.orderBy("row", "col").collect()
        assert [tuple(r) for r in got] == [(i, c, float(c)) for i, k in enumerate(n) for c in range(k)]


def damaged(path, tmp_path, edit):
    data = bytearray(open(path, "rb").read())
    new = tmp_path / "bad.dat"
    new.write_bytes(bytes(edit(data)))
    return str(new)


def test_damaged_files(spark, files, tmp_path):
    with pytest.raises(FileNotFoundError, match="Could not open"):
        read_matrix(spark, str(tmp_path / "none.dat"))
    with pytest.raises(ValueError, match="Bad signature in PETSc Matrix file"):
        read_matrix(spark, files[1])
    with pytest.raises(ValueError, match="Bad signature in PETSc Vector file"):
        read_vector(spark, files[0])
    with pytest.raises(ValueError, match="truncated"):
        read_matrix(spark, damaged(files[0], tmp_path, lambda d: d[:-3]))
    with pytest.raises(ValueError, match="truncated"):
        read_vector(spark, damaged(files[1], tmp_path, lambda d: d[:-3]))
    more = damaged(files[0], tmp_path, lambda d: d[:16] + b"\0\0\0\x02" + d[20:])
    with pytest.raises(Exception, match="row counts"):
        read_matrix(spark, more).df.count()
