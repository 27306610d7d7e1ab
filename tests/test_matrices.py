"""Operators on the small fixtures, element by element, and strategies against each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.partition import owner, owner_ranges, prefix_sums, ranges_from_sizes, ranges_table
from tessera.model import ENTRIES, SparseMatrix, Vector
from tessera.operators import assemble, blas, exchange, multiply, solvers, stats
from tessera.sources import arrays, from_csr, from_entries, gaussian, tridiagonal

# fixed values
ROWPTR = [0, 3, 6, 9, 13, 15]
COLIND = [0, 1, 3, 0, 1, 3, 2, 3, 4, 0, 1, 2, 3, 2, 4]
VALUES = [1, -2, -3, -2, 5, 4, 6, 4, -4, -3, 4, 4, 8, -4, 8]


@pytest.fixture(scope="module")
def f1(spark):
    a = from_csr(spark, ROWPTR, COLIND, VALUES, 5)
    return a.with_df(a.df.cache())


def vec(spark, values):
    return Vector(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, val double"), len(values))


def out(x):
    got = {r.idx: r.val for r in x.df.collect()}
    assert sorted(got) == list(range(x.n))
    return [got[i] for i in range(x.n)]


def mat(spark, entries, nrows, ncols):
    return SparseMatrix(spark.createDataFrame([(r, c, float(v)) for r, c, v in entries], ENTRIES), nrows, ncols)


@pytest.mark.parametrize("strategy", multiply.STRATEGIES)
def test_product_by_every_strategy(spark, f1, strategy):
    x, y = vec(spark, [1, 2, 3, 4, 5]), vec(spark, [1] * 5)
    assert out(multiply.mult(f1, x, strategy)) == [-15, 24, 14, 49, 28]
    assert out(multiply.mult(f1, x, strategy, 2.0, -3.0, y)) == [-33, 45, 25, 95, 53]
    low = assemble.symmetric(f1, validate=True)
    assert out(multiply.mult(low, x, strategy)) == [-15, 24, 14, 49, 28]
    assert out(multiply.mult_transposed(f1, x, strategy)) == [-15, 24, 14, 49, 28]


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_product_does_not_depend_on_the_parts(spark, f1, parts):
    x = vec(spark, [1, 2, 3, 4, 5])
    assert out(multiply.mult_overlapped(f1, x, parts)) == [-15, 24, 14, 49, 28]
    assert out(multiply.mult_overlapped(assemble.symmetric(f1), x, parts)) == [-15, 24, 14, 49, 28]
    local = assemble.global_to_local(f1, parts)
    back = assemble.local_to_global(local, assemble.ghost_columns(f1, parts), parts, 5, 5)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, f1.df.collect()))


def test_gaussian_product(spark, f1):
    g = out(gaussian(spark, 5))
    assert g == pytest.approx([7.187781739060989e-28, 1.6918979226151304e-10, 0.08208499862389887, 0.08208499862389887, 1.6918979226151183e-10], rel=1e-14)
    y = out(multiply.mult(f1, gaussian(spark, 5)))
    assert y == pytest.approx([-0.24625499621007618, 0.32833999534154445, 0.8208499855622294, 0.9850199841635456, -0.3283399931420771], rel=1e-14)
    assert blas.close(blas.norm2(vec(spark, y)), 1.3857542692681533, 1e-14)


# parts: [(rows, nnz, local, remote, lower, diagonal, ghosts)]
LAYOUT = {
    1: [(5, 15, 15, 0, 5, 5, [])],
    2: [(3, 9, 5, 4, 1, 3, [3, 4]), (2, 6, 2, 4, 0, 2, [0, 1, 2])],
    3: [(2, 6, 4, 2, 1, 2, [3]), (2, 7, 4, 3, 1, 2, [0, 1, 4]), (1, 2, 1, 1, 0, 1, [2])],
}


@pytest.mark.parametrize("parts", LAYOUT)
def test_layout_by_parts(spark, f1, parts):
    n = {r.part: r for r in stats.nnz_by_part(f1, parts).collect()}
    s = {r.part: r for r in stats.nnz_symmetric(f1, parts).collect()}
    shape = {r.part: r for r in stats.part_shape(f1, parts).collect()}
    size = {r.part: r for r in stats.format_size(f1, parts).collect()}
    ghosts = assemble.ghost_columns(f1, parts).orderBy("part", "lidx").collect()
    for k, (rows, nnz, local, remote, lower, diag, g) in enumerate(LAYOUT[parts]):
        assert (n[k].nnz, n[k].local, n[k].remote) == (nnz, local, remote)
        assert (s[k].lower, s[k].diagonal, s[k].remote, s[k].nnz) == (lower, diag, remote, nnz)
        assert (shape[k].rows, shape[k].cols, shape[k].ghosts) == (rows, rows + len(g), len(g))
        assert [r.gidx for r in ghosts if r.part == k] == g
        assert [r.lidx for r in ghosts if r.part == k] == list(range(rows, rows + len(g)))
        assert size[k].csr_bytes == 4 * (rows + 1) + 12 * nnz and size[k].coo_bytes == 16 * nnz
        assert size[k].matrix_bytes == 4 * rows + 12 * nnz
        assert size[k].symmetric_bytes == 8 * rows + 12 * (lower + remote) + 8 * rows
    assert stats.non_zeros(f1) == stats.non_zeros(assemble.symmetric(f1)) == 15
    assert stats.shape(f1) == (5, 5)


def test_ownership_closed_form(spark):
    assert owner_ranges(2, 5) == [0, 3, 5] and owner_ranges(3, 5) == [0, 2, 4, 5] and owner_ranges(4, 10) == [0, 3, 6, 8, 10]
    for parts in (1, 2, 3, 4, 7, 11):
        for n in (0, 1, 3, 10, 29):
            bounds = owner_ranges(parts, n)
            got = [r.o for r in spark.range(n).select("id", owner(F.col("id"), parts, n).alias("o")).orderBy("id").collect()]
            assert got == [k for k in range(parts) for _ in range(bounds[k], bounds[k + 1])]
            table = ranges_table(spark, parts, n).orderBy("part").collect()
            assert [r.lo for r in table] == bounds[:-1] and [r.hi for r in table] == bounds[1:]
    sizes = spark.createDataFrame([(0, 3), (1, 0), (2, 4)], "part int, n int")
    assert [(r.lo, r.hi) for r in ranges_from_sizes(sizes).orderBy("part").collect()] == [(0, 3), (3, 3), (3, 7)]


def test_prefix_sums_over_blocks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    got = [r.total for r in prefix_sums(df, "id", "n", "total", block=64).orderBy("id").collect()]
    assert got == np.cumsum(np.arange(1000) % 7).tolist()


def test_duplicates_and_stored_zeros(spark):
    a = assemble.assemble(mat(spark, [(0, 0, 1), (0, 0, 2), (1, 0, 5), (1, 0, -5)], 2, 1))
    assert sorted(map(tuple, a.df.collect())) == [(0, 0, 3.0), (1, 0, 0.0)]
    assert stats.non_zeros(a) == 2


def test_row_ghosts(spark):
    held = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 1.0), (0, 2, 1, 7.0), (0, 2, 3, 8.0), (1, 2, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 3, 1.0)], "part int, row long, col long, val double")
    ghosts = assemble.row_ghosts(held, 2, 4)
    assert sorted((r.row, r.col, r.owner) for r in ghosts.collect()) == [(2, 1, 1), (2, 3, 1)]
    own = held.where(F.col("part") == owner(F.col("row"), 2, 4)).drop("part")
    a = assemble.assemble(SparseMatrix(own, 4, 4), ghosts)
    assert sorted(tuple(r) for r in a.df.where("row = 2").collect()) == [(2, 1, 7.0), (2, 2, 1.0), (2, 3, 9.0)]
    assert [r.gidx for r in assemble.ghost_columns(a, 2).where("part = 1").collect()] == [1]


def test_degenerate_shapes(spark):
    none = mat(spark, [], 3, 2)
    x, y = vec(spark, [1, 2]), vec(spark, [1, 2, 3])
    for strategy in multiply.STRATEGIES:
        assert out(multiply.mult(none, x, strategy, 2.0, -1.0, y)) == [-1, -2, -3]
        assert out(multiply.mult(none, x, strategy)) == [0, 0, 0]
        wide = mat(spark, [(0, 3, 2), (1, 0, 1)], 2, 4)
        assert out(multiply.mult(wide, vec(spark, [1, 2, 3, 4]), strategy)) == [8, 1]
        gaps = mat(spark, [(0, 0, 2), (2, 1, 3)], 4, 2)
        assert out(multiply.mult(gaps, x, strategy)) == [2, 0, 6, 0]
    assert out(multiply.mult_transposed(mat(spark, [(0, 3, 2), (1, 0, 1)], 2, 4), x)) == [2, 0, 0, 2]
    assert out(multiply.mult_diagonal(mat(spark, [(0, 0, 2), (0, 1, 9), (2, 2, 3)], 3, 3), y, 2.0, 1.0, y)) == [5, 2, 21]
    nan = vec(spark, [math.nan, 1, 2])
    assert out(multiply.mult(none, x, "auto", 1.0, 0.0, nan)) == [0, 0, 0]
    with pytest.raises(ValueError, match="columns"):
        multiply.mult(none, y)
    with pytest.raises(ValueError, match="strategy"):
        multiply.mult(none, x, "other")
    assert stats.nnz_by_part(mat(spark, [(0, 0, 1)], 2, 2), 5).count() == 5


def test_float_results_are_rounded_to_float(spark):
    a = SparseMatrix.of(spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], ENTRIES), 1, 1, dtype="float")
    assert assemble.assemble(a).df.first().val == np.float32(np.float32(0.1) + np.float64(np.float32(0.2)))
    assert assemble.assemble(a).df.schema["val"].dataType.typeName() == "float"
    with pytest.raises(ValueError, match="not supported"):
        SparseMatrix(a.df, 1, 1, dtype="complex")


def test_validation(spark):
    with pytest.raises(ValueError, match="not symmetric"):
        assemble.symmetric(mat(spark, [(0, 1, 1), (1, 0, 2)], 2, 2), validate=True)
    with pytest.raises(ValueError, match="outside"):
        mat(spark, [(0, 2, 1)], 2, 2).check()
    mat(spark, [(0, 1, 1)], 2, 2).check()
    g = lambda *r: spark.createDataFrame(list(r), "part int, pos int, gidx long")
    exchange.validate_ghosts(g((0, 0, 3), (0, 1, 4)), 2, 5)
    with pytest.raises(ValueError, match="sorted"):
        exchange.validate_ghosts(g((0, 0, 4), (0, 1, 3)), 2, 5)
    with pytest.raises(ValueError, match="local range"):
        exchange.validate_ghosts(g((0, 0, 1)), 2, 5)
    with pytest.raises(ValueError, match="fit"):
        from_csr(spark, [0, 2], [0], [1.0], 1)


def test_csr_and_back(spark, f1):
    rows = assemble.csr(f1).orderBy("row").collect()
    assert [c for r in rows for c in r.colind] == COLIND and [v for r in rows for v in r["values"]] == VALUES
    ptr = stats.rowptr(mat(spark, [(0, 0, 1), (0, 1, 1), (2, 0, 1)], 4, 2)).orderBy("row").collect()
    assert [(r.start, r.stop) for r in ptr] == [(0, 2), (2, 2), (2, 3), (3, 3)]
    assert sorted(map(tuple, assemble.csr_entries(assemble.csr(f1)).collect())) == sorted(map(tuple, f1.df.collect()))
    again = arrays.from_csr_rows(assemble.csr(f1), 5, 5)
    assert sorted(map(tuple, again.df.collect())) == sorted(map(tuple, f1.df.collect()))
    assert from_entries(f1.df, 5, 5, symmetric=True).df.count() == 10


def test_exchange_on_two_parts(spark, f1):
    x = vec(spark, [1, 2, 3, 4, 5])
    got = {(r.part, r.gidx): r.val for r in exchange.ghost_update(f1, x, 2).collect()}
    assert got == {(0, 3): 4, (0, 4): 5, (1, 0): 1, (1, 1): 2, (1, 2): 3}
    ghosts = assemble.ghost_columns(f1, 2).withColumn("val", F.lit(10.0))
    assert out(exchange.reverse_update(x, ghosts)) == [11, 12, 13, 14, 15]
    assert sorted(map(tuple, exchange.neighbours(f1, 2).collect())) == [(0, 1), (1, 0)]
    counts = {r.part: r for r in exchange.counts(f1, 2).collect()}
    assert (counts[0].send_count, counts[0].recv_count, counts[0].recv_offset) == (3, 2, 3)
    assert sorted(map(tuple, exchange.indices(f1, 2).collect())) == [(0, 1, 0), (0, 1, 1), (0, 1, 2), (1, 0, 0), (1, 0, 1)]
    places = spark.createDataFrame([(0, 4), (1, 0), (2, 4)], "pos long, idx long")
    assert sorted(map(tuple, exchange.gather(x, places).collect())) == [(0, 5.0), (1, 1.0), (2, 5.0)]


def greedy(counts, splits):
    total, target = sum(counts), max(1, -(-sum(counts) // splits))
    bounds, run = [0], 0
    for i, c in enumerate(counts):
        run += c
        if run >= target and len(bounds) < splits:
            bounds.append(i + 1)
            run = 0
    bounds += [len(counts)] * (splits - len(bounds))
    return [(a, b) for a, b in zip(bounds, [*bounds[1:], len(counts)], strict=True)], total


@pytest.mark.parametrize("splits", [1, 2, 3, 8])
def test_row_split_is_greedy(spark, splits):
    r = random.Random(splits)
    counts = [r.choice([0, 0, 1, 2, 5, 30]) for _ in range(40)]
    a = mat(spark, [(i, c, 1) for i, n in enumerate(counts) for c in range(n)], 40, 40)
    got = stats.nnz_row_split(a, splits).orderBy("split").collect()
    want, total = greedy(counts, splits)
    assert [(g.row_start, g.row_end) for g in got] == want
    assert [g.nnz for g in got] == [sum(counts[x:y]) for x, y in want] and sum(g.nnz for g in got) == total
    of = {i: k for k, (x, y) in enumerate(want) for i in range(x, y)}
    conflicts = {(c, of[i]) for i, n in enumerate(counts) for c in range(n) if c < want[of[i]][0]}
    assert {tuple(x) for x in stats.conflict_map(a, splits).collect()} == conflicts


def test_row_split_over_many_blocks(spark):
    r = random.Random(1)
    counts = [r.choice([0, 1, 3, 9]) for _ in range(300)]
    a = mat(spark, [(i, c, 1) for i, n in enumerate(counts) for c in range(n)], 300, 300)
    for splits in (7, 60, 400):
        got = stats.nnz_row_split(a, splits, block=16).orderBy("split").collect()
        want, _ = greedy(counts, splits)
        assert [(g.row_start, g.row_end) for g in got] == want


def test_blocked_product_over_many_tasks(spark):
    a = mat(spark, [(i, i % 3, 1 + i % 5) for i in range(200)], 200, 3)
    x = vec(spark, [1, 10, 100])
    want = out(multiply.mult(a, x))
    got = multiply.padded(multiply.terms(a, x, "blocked", task_entries=7), a)
    assert out(got) == want


def test_vectors(spark):
    x, y = vec(spark, [1, 2, 3]), vec(spark, [4, 5, 6])
    assert blas.dot(x, y) == 32 and blas.norm2(vec(spark, [3, 4])) == 5
    assert out(blas.axpy(2.0, x, y)) == [6, 9, 12] and out(blas.scal(3.0, x)) == [3, 6, 9] and out(blas.xpby(x, 2.0, y)) == [9, 12, 15]
    state = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0)], "idx long, x double, r double, p double, ap double")
    assert tuple(blas.fused_update(state, 2.0).first())[1:3] == (7.0, -6.0)
    assert out(Vector(spark.createDataFrame([(1, 2.0)], "idx long, val double"), 3).dense()) == [0, 2, 0]
    assert out(Vector.constant(spark, 2, 7)) == [7, 7]
    with pytest.raises(ValueError, match="differ"):
        blas.dot(x, vec(spark, [1]))
    assert blas.residual_norm(mat(spark, [(0, 0, 2)], 1, 1), vec(spark, [3]), vec(spark, [2])) == 4


def test_tridiagonal(spark):
    a = tridiagonal(spark, 6)
    d = np.zeros((6, 6))
    for r in a.df.collect():
        d[r.row, r.col] += r.val
    assert np.allclose(d.sum(axis=1), 1) and np.allclose(d, d.T) and a.df.count() == 16
    assert d[0, 0] == pytest.approx(0.9) and d[1, 1] == pytest.approx(0.8)
    assert tridiagonal(spark, 1).df.count() == 1


def test_repeated_application(spark):
    n = 10
    a = np.diag([0.9] + [0.8] * 8 + [0.9]) + 0.1 * (np.eye(n, k=1) + np.eye(n, k=-1))
    x = np.array(out(gaussian(spark, n)))
    got = out(multiply.power_apply(tridiagonal(spark, n), gaussian(spark, n), 12))
    assert got == pytest.approx((np.linalg.matrix_power(a, 12) @ x).tolist(), rel=1e-12)


def test_restrict_prolong(spark):
    r = mat(spark, [(0, 0, 1), (1, 0, 2), (2, 1, 1)], 3, 2)
    got = [(p2, q2) for p2, q2, _, _ in multiply.restrict_prolong(r, vec(spark, [1, 1, 1]), 2)]
    d, q, want = np.array([[1, 0], [2, 0], [0, 1.0]]), np.ones(3), []
    for _ in range(2):
        p = d.T @ q
        q = d @ p
        want.append((p @ p, q @ q))
    assert got == want


def test_cg(spark):
    s = solvers.cg(tridiagonal(spark, 100), gaussian(spark, 100))
    assert s.iterations == 6 and s.converged
    assert [r / s.residuals[0] for r in s.residuals[1:4]] == pytest.approx([3.5004e-3, 2.95651e-5, 3.88885e-7], rel=1e-4)
    assert blas.norm2(s.x) == pytest.approx(2.82249626474685, rel=1e-12)


def test_cg_plans_do_not_grow(spark, monkeypatch):
    sizes, seen = [], solvers.product

    def product(a, x, strategy):
        out = seen(a, x, strategy)
        sizes.append(len(out._jdf.queryExecution().analyzed().toString().splitlines()))
        return out

    monkeypatch.setattr(solvers, "product", product)
    solvers.cg(tridiagonal(spark, 50), gaussian(spark, 50), kmax=6, rtol=0.0)
    assert len(sizes) == 6 and max(sizes[1:]) == min(sizes[1:])


def test_cg_edges(spark):
    a = mat(spark, [(0, 0, 4), (1, 0, 1), (1, 1, 3)], 2, 2).with_df(mat(spark, [(0, 0, 4), (1, 0, 1), (1, 1, 3)], 2, 2).df, symmetric=True)
    s = solvers.cg(a, vec(spark, [1, 2]))
    assert out(s.x) == pytest.approx(np.linalg.solve([[4, 1], [1, 3]], [1, 2]).tolist())
    zero = solvers.cg(a, vec(spark, [0, 0]))
    assert out(zero.x) == [0, 0] and zero.iterations == 0
    short = solvers.cg(tridiagonal(spark, 20), gaussian(spark, 20), kmax=2)
    assert short.iterations == 2 and not short.converged
    with pytest.raises(ValueError, match="square"):
        solvers.cg(mat(spark, [], 2, 3), vec(spark, [1, 2]))
