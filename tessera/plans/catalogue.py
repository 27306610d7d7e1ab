"""The queries of the matrix operators and the SQL that says what each must return.

Matrices come from the star schema: A is supplier x part with quantities, L the
Laplacian of the suppliers' co-occurrence in orders plus the identity (symmetric,
positive definite, whole numbers). Values are whole numbers where they can be, so
sums are exact in any order; the few others are rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partition import owner, ranges_table
from ..model import SparseMatrix, Vector
from ..operators import assemble, blas, exchange, multiply, solvers, stats
from ..sources import arrays, petsc, tables
from ..sources.generators import gaussian, tridiagonal
from .lineage import cut, shared_dir

PARTS, SPLITS = 4, 4
#: Applications and cycles, as the usual programs for such kernels do (fixed values).
TIMES, CYCLES = 100, 10
#: Of the solve on the tables.
CG_STEPS, CG_RTOL = 12, 1e-6
#: A 5 x 5 matrix as CSR arrays (fixed values).
ROWPTR, COLIND = [0, 3, 6, 9, 13, 15], [0, 1, 3, 0, 1, 3, 2, 3, 4, 0, 1, 2, 3, 2, 4]
VALUES = [1, -2, -3, -2, 5, 4, 6, 4, -4, -3, 4, 4, 8, -4, 8]


class Tables:
    """The base objects, each a lazy table."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.sizes = spark, sf_dir, {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def size(self, table: str, key: str) -> int:
        """Ids are dense from zero; the dimension table has the shape."""
        if table not in self.sizes:
            self.sizes[table] = (self.read(table).agg(F.max(key)).first()[0] or 0) + 1
        return self.sizes[table]

    def path(self, kind: str) -> str:
        """A new path in the shared folder."""
        return f"{shared_dir(self.spark).rstrip('/').removeprefix('file:')}/{kind}-{uuid.uuid4().hex}"

    @property
    def suppliers(self) -> int:
        return self.size("supplier", "s_suppkey")

    @property
    def parts(self) -> int:
        return self.size("part", "p_partkey")

    def raw(self) -> SparseMatrix:
        """A with duplicates."""
        return SparseMatrix.of(self.read("lineitem"), self.suppliers, self.parts, "l_suppkey", "l_partkey", "l_quantity")

    def prices(self) -> Vector:
        return Vector.of(self.read("part"), self.parts, "p_partkey", F.round(F.col("p_retailprice") * 100))

    def ranks(self) -> Vector:
        """q: s + 1 for each supplier."""
        return Vector.of(self.read("supplier"), self.suppliers, "s_suppkey", F.col("s_suppkey") + 1)

    def balances(self) -> Vector:
        return Vector.of(self.read("supplier"), self.suppliers, "s_suppkey", F.round(F.col("s_acctbal") * 100))

    def cooccurrence(self) -> SparseMatrix:
        """W: in how many orders two different suppliers meet. An order has a handful of lines, so its pairs are few."""
        own = self.read("lineitem").select("l_orderkey", "l_suppkey").distinct()
        pairs = own.withColumnRenamed("l_suppkey", "row").join(own.withColumnRenamed("l_suppkey", "col"), "l_orderkey").where("row <> col")
        n = self.suppliers
        return SparseMatrix(pairs.groupBy("row", "col").agg(F.count("*").cast("double").alias("val")), n, n)

    def laplacian(self) -> SparseMatrix:
        """I + diag(W 1) - W, by one grouping of W's entries and the identity."""
        w = self.cooccurrence()
        both = F.array(F.struct(F.col("col"), (-F.col("val")).alias("val")), F.struct(F.col("row").alias("col"), F.col("val").alias("val")))
        entries = w.df.select("row", F.explode(both).alias("e")).select("row", "e.col", "e.val")
        one = self.spark.range(w.nrows).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))
        return assemble.assemble(SparseMatrix(entries, w.nrows, w.ncols), one)

    def lower_laplacian(self) -> SparseMatrix:
        return assemble.symmetric(self.laplacian())


def _v(x: Vector) -> DataFrame:
    return x.df


def _rounded(x: Vector, digits: int = 6) -> DataFrame:
    return x.df.select("idx", F.round("val", digits).alias("val"))


def _row_ghosts(t: Tables) -> DataFrame:
    """Rows of odd orders are held by the part after their owner, then assembled."""
    a = t.raw()
    n = a.nrows
    own = owner(F.col("l_suppkey"), PARTS, n)
    held = t.read("lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"), F.when(F.col("l_orderkey") % 2 == 1, (own + 1) % PARTS).otherwise(own).alias("part"))
    ghosts = assemble.row_ghosts(held, PARTS, n)
    owned = held.where(F.col("part") == owner(F.col("row"), PARTS, n))
    done = assemble.assemble(a.with_df(owned.select("row", "col", "val")), ghosts)
    return done.df.withColumn("part", owner(F.col("row"), PARTS, n))


def _restrict(t: Tables) -> DataFrame:
    r = assemble.assemble(t.raw())
    p2, q2, _, q = next(multiply.restrict_prolong(r, t.ranks(), 1))
    return q.df.select("idx", "val", F.round(F.sqrt(F.lit(p2)), 2).alias("p_norm"), F.round(F.sqrt(F.lit(q2)), 2).alias("q_norm"))


def _cycles(t: Tables) -> DataFrame:
    """Ten cycles; norms grow by orders of magnitude, so their logarithms are given."""
    r = assemble.assemble(t.raw())
    kept = r.with_df(cut(r.df))
    rows = [(k, p2, q2) for k, (p2, q2, _, _) in enumerate(multiply.restrict_prolong(kept, t.ranks(), CYCLES), 1)]
    out = t.spark.createDataFrame(rows, "cycle int, p2 double, q2 double")
    return out.select("cycle", F.round(F.log10("p2") / 2, 9).alias("p_norm"), F.round(F.log10("q2") / 2, 9).alias("q_norm"))


def _written(t: Tables, a: SparseMatrix, **options) -> SparseMatrix:
    path = t.path("matrix")
    petsc.write_matrix(a, path)
    return petsc.read_matrix(t.spark, path, **options)


def _petsc_vector(t: Tables) -> Vector:
    path = t.path("vector")
    petsc.write_vector(t.ranks(), path)
    return petsc.read_vector(t.spark, path, 3)


def _sink(t: Tables) -> DataFrame:
    path = t.path("entries")
    tables.save_matrix(t.raw(), path)
    a = tables.load_matrix(t.spark, path)
    return assemble.assemble(a).df.select("row", "col", "val", F.lit(a.nrows).cast("long").alias("nrows"), F.lit(a.ncols).cast("long").alias("ncols"))


def _ghost_faults(t: Tables) -> DataFrame:
    """Ghosts as they are, and for odd parts an index of their own after them."""
    g = assemble.ghost_columns(t.cooccurrence(), PARTS).select("part", F.col("lidx").alias("pos"), "gidx")
    own = ranges_table(t.spark, PARTS, t.suppliers).where("part % 2 = 1").select("part", F.lit(1 << 40).cast("long").alias("pos"), F.col("lo").alias("gidx"))
    return exchange.ghost_faults(g.unionByName(own), PARTS, t.suppliers)


def _contributions(t: Tables) -> DataFrame:
    g = assemble.ghost_columns(t.cooccurrence(), PARTS)
    return exchange.reverse_update(t.ranks(), g.select("gidx", (F.col("gidx") + 10 * (F.col("part") + 1)).cast("double").alias("val"))).df


def _gathered(t: Tables) -> DataFrame:
    places = t.read("orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % t.suppliers).alias("idx"))
    return exchange.gather(t.ranks(), places)


def _fused(t: Tables) -> DataFrame:
    q, b = t.ranks(), t.balances()
    state = q.df.select("idx", F.col("val").alias("x"), (2 * F.col("val")).alias("p")).join(b.df.select("idx", F.col("val").alias("r"), (3 * F.col("val")).alias("ap")), "idx")
    return blas.fused_update(state, 2.0).select("idx", "x", "r")


def _cg_fixed(t: Tables) -> DataFrame:
    return _rounded(solvers.cg(t.lower_laplacian(), t.ranks(), kmax=3, rtol=0.0).x)


def _report(df: DataFrame) -> DataFrame:
    return df.select("iterations", F.round(F.log10("residual"), 2).alias("residual"), F.round("norm", 6).alias("norm"))


def _residual(t: Tables) -> DataFrame:
    return blas.norm2_table(blas.residual(t.laplacian(), t.ranks(), t.balances())).select(F.col("squared"), F.round("norm", 4).alias("norm"))


def _local_to_global(t: Tables) -> DataFrame:
    w = t.cooccurrence()
    return assemble.local_to_global(assemble.global_to_local(w, PARTS), assemble.ghost_columns(w, PARTS), PARTS, w.nrows, w.ncols)


def _csr_arrays(t: Tables) -> DataFrame:
    """The arrays of each row, written out."""
    whole = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return assemble.csr(assemble.assemble(t.raw())).select("row", F.size("colind").cast("long").alias("n"), whole("colind").alias("colind"), whole("values").alias("values"))


def _split_kind(t: Tables, kind: str) -> DataFrame:
    return assemble.symmetric_blocks(t.laplacian(), PARTS).where(F.col("kind") == kind).select("part", "row", "col", "val")


CATALOGUE: dict[str, Callable[[Tables], DataFrame]] = {
    "spmv_vanilla": lambda t: _v(multiply.mult(t.raw(), t.prices())),
    "spmv_coo": lambda t: _v(multiply.mult(t.raw(), t.prices(), "shuffle")),
    "spmv_csr": lambda t: _v(multiply.mult(t.raw(), t.prices(), "csr")),
    "spmv_blocked": lambda t: _v(multiply.mult(t.raw(), t.prices(), "blocked")),
    "spmv_broadcast": lambda t: _v(multiply.mult(t.raw(), t.prices(), "broadcast")),
    "spmv_alpha_beta": lambda t: _v(multiply.mult(t.raw(), t.prices(), alpha=2.0, beta=-3.0, y=t.ranks())),
    "spmv_overlap": lambda t: _v(multiply.mult_overlapped(t.laplacian(), t.ranks(), PARTS)),
    "spmv_symmetric": lambda t: _v(multiply.mult_symmetric(t.laplacian(), t.ranks())),
    "spmv_sym_overlap": lambda t: _v(multiply.mult_overlapped(t.lower_laplacian(), t.ranks(), PARTS)),
    "spmv_diag_only": lambda t: _v(multiply.mult_diagonal(t.laplacian(), t.ranks())),
    "diag_extract": lambda t: assemble.diagonal(t.laplacian()),
    "spmv_transpose": lambda t: _v(multiply.mult_transposed(t.raw(), t.ranks())),
    "power_apply": lambda t: _rounded(multiply.power_apply(tridiagonal(t.spark, 50), gaussian(t.spark, 50), TIMES)),
    "restrict_prolong": _restrict,
    "restrict_prolong_cycles": _cycles,
    "petsc_matrix": lambda t: _written(t, t.raw(), partitions=3).df,
    "petsc_vector": lambda t: _v(_petsc_vector(t)),
    "petsc_symmetric_spmv": lambda t: _v(multiply.mult(_written(t, t.laplacian(), symmetric=True), _petsc_vector(t))),
    "from_csr": lambda t: arrays.from_csr(t.spark, ROWPTR, COLIND, VALUES, 5).df,
    "from_csr_rows": lambda t: arrays.from_csr_rows(assemble.csr(t.raw()), t.suppliers, t.parts).df,
    "from_entries": lambda t: arrays.from_entries(t.laplacian().df, t.suppliers, t.suppliers, symmetric=True).df,
    "sink_parquet": _sink,
    "ghost_faults": _ghost_faults,
    "copy_memset": lambda t: _v(Vector.constant(t.spark, t.suppliers, 7.5)),
    "assemble_duplicates": lambda t: assemble.assemble(t.raw()).df,
    "assemble_row_ghosts": _row_ghosts,
    "csr_build": _csr_arrays,
    "csr_to_coo": lambda t: assemble.csr_entries(assemble.csr(assemble.assemble(t.raw()))),
    "csr_rowptr": lambda t: stats.rowptr(assemble.assemble(t.raw())),
    "sym_split_lower": lambda t: _split_kind(t, "lower"),
    "sym_split_diag": lambda t: _split_kind(t, "diagonal"),
    "local_remote_split": lambda t: assemble.split_local(t.cooccurrence(), PARTS).select("part", "row", "col", "is_local", "val"),
    "nnz_by_part": lambda t: stats.nnz_by_part(t.cooccurrence(), PARTS),
    "nnz_symmetric": lambda t: stats.nnz_symmetric(t.laplacian(), PARTS),
    "part_shape": lambda t: stats.part_shape(t.cooccurrence(), PARTS),
    "format_size": lambda t: stats.format_size(t.laplacian(), PARTS),
    "owner_ranges": lambda t: ranges_table(t.spark, PARTS, t.suppliers),
    "ghost_columns": lambda t: assemble.ghost_columns(t.cooccurrence(), PARTS),
    "global_to_local": lambda t: assemble.global_to_local(t.cooccurrence(), PARTS),
    "local_to_global": _local_to_global,
    "exchange_neighbours": lambda t: exchange.neighbours(t.cooccurrence(), PARTS),
    "exchange_counts": lambda t: exchange.counts(t.cooccurrence(), PARTS),
    "exchange_indices": lambda t: exchange.indices(t.cooccurrence(), PARTS),
    "ghost_update": lambda t: exchange.ghost_update(t.cooccurrence(), t.ranks(), PARTS),
    "reverse_update": _contributions,
    "gather": _gathered,
    "nnz_row_split": lambda t: stats.nnz_row_split(t.laplacian().with_df(assemble.lower(t.laplacian())), SPLITS),
    "conflict_map": lambda t: stats.conflict_map(t.laplacian().with_df(assemble.lower(t.laplacian())), SPLITS),
    "minmax_by_part": lambda t: stats.minmax_by(t.ranks().df.withColumn("part", owner(F.col("idx"), PARTS, t.suppliers)), "part", "val"),
    "dot": lambda t: blas.dot_table(t.ranks(), t.balances()),
    "axpy": lambda t: _v(blas.axpy(2.0, t.ranks(), t.balances())),
    "scal": lambda t: _v(blas.scal(3.0, t.balances())),
    "norm2": lambda t: blas.norm2_table(t.ranks()).select("squared", F.round("norm", 6).alias("norm")),
    "fused_update": _fused,
    "xpby": lambda t: _v(blas.xpby(t.balances(), 2.0, t.ranks())),
    "residual_norm": _residual,
    "gen_tridiag": lambda t: tridiagonal(t.spark, 100).df.select("row", "col", F.round("val", 9).alias("val")),
    "gen_gaussian": lambda t: _rounded(gaussian(t.spark, 100), 9),
    "cg_fixed_iters": _cg_fixed,
    "cg_converged": lambda t: _report(solvers.report(tridiagonal(t.spark, 100), gaussian(t.spark, 100))),
    "cg_report": lambda t: _report(solvers.report(t.lower_laplacian(), t.ranks(), kmax=CG_STEPS, rtol=CG_RTOL)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in CATALOGUE.items()}


# --- SQL


def _owner(i: str, n: str = "n", p: int = PARTS) -> str:
    return f"(CASE WHEN {i} < ({n} % {p}) * ({n} // {p} + 1) THEN {i} // ({n} // {p} + 1) ELSE {n} % {p} + ({i} - ({n} % {p}) * ({n} // {p} + 1)) // ({n} // {p}) END)::INTEGER"


def _start(k: str, n: str = "n", p: int = PARTS) -> str:
    return f"({k} * ({n} // {p}) + least({k}, {n} % {p}))::BIGINT"


BASE = f"""
ns AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
np AS (SELECT max(p_partkey) + 1 AS m FROM part),
a0 AS (SELECT l_suppkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem),
a AS (SELECT i, j, sum(v) AS v FROM a0 GROUP BY i, j),
x AS (SELECT p_partkey AS j, round(p_retailprice * 100) AS x FROM part),
q AS (SELECT s_suppkey AS i, (s_suppkey + 1)::DOUBLE AS q FROM supplier),
b AS (SELECT s_suppkey AS i, round(s_acctbal * 100) AS b FROM supplier),
o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
w AS (SELECT s.l_suppkey AS i, t.l_suppkey AS j, count(*)::DOUBLE AS v FROM o s JOIN o t ON s.l_orderkey = t.l_orderkey AND s.l_suppkey <> t.l_suppkey GROUP BY 1, 2),
l AS (SELECT i, j, sum(v) AS v FROM (
  SELECT i, j, -v AS v FROM w UNION ALL SELECT i, i, v FROM w UNION ALL SELECT i, i, 1.0 FROM q) GROUP BY i, j),
wp AS (SELECT w.*, {_owner('i')} AS pi, {_owner('j')} AS pj, n FROM w, ns),
lp AS (SELECT l.*, {_owner('i')} AS pi, {_owner('j')} AS pj, n FROM l, ns),
parts AS (SELECT k::INTEGER AS part, {_start('k')} AS lo, {_start('(k + 1)')} AS hi, n FROM range({PARTS}) AS r(k), ns),
g AS (SELECT DISTINCT pi AS part, j AS gidx, pj AS owner FROM wp WHERE pi <> pj),
ghosts AS (SELECT g.*, (hi - lo + row_number() OVER (PARTITION BY g.part ORDER BY gidx) - 1)::BIGINT AS lidx FROM g JOIN parts ON g.part = parts.part),
low AS (SELECT i, j, v FROM l WHERE i > j),
lowrows AS (SELECT q.i, count(low.i) AS c FROM q LEFT JOIN low ON low.i = q.i GROUP BY q.i)
"""


def _sql(body: str, recursive: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{more}\n{body}"


SPMV = _sql("SELECT q.i AS idx, coalesce(s, 0.0)::DOUBLE AS val FROM q LEFT JOIN (SELECT i, sum(v * x) AS s FROM a0 JOIN x ON a0.j = x.j GROUP BY i) y ON y.i = q.i")
LAPLACE = _sql("SELECT q.i AS idx, coalesce(s, 0.0)::DOUBLE AS val FROM q LEFT JOIN (SELECT l.i, sum(v * q.q) AS s FROM l JOIN q ON l.j = q.i GROUP BY l.i) y ON y.i = q.i")

SPLIT = f"""
, run AS (SELECT i, sum(c) OVER (ORDER BY i)::BIGINT AS total FROM lowrows),
goal AS (SELECT greatest(1, (max(total) + {SPLITS - 1}) // {SPLITS})::BIGINT AS target, max(total)::BIGINT AS total, count(*)::BIGINT AS n FROM run),
cuts AS (
  SELECT 0 AS split, 0::BIGINT AS bound, 0::BIGINT AS s
  UNION ALL
  SELECT split + 1,
    coalesce((SELECT min(i) + 1 FROM run WHERE run.total >= cuts.s + goal.target), goal.n)::BIGINT,
    coalesce((SELECT min(run.total) FROM run WHERE run.total >= cuts.s + goal.target), goal.total)::BIGINT
  FROM cuts, goal WHERE split < {SPLITS - 1}
),
bounds AS (
  SELECT split::INTEGER AS split, bound AS row_start, coalesce(lead(bound) OVER (ORDER BY split), n)::BIGINT AS row_end,
    (coalesce(lead(s) OVER (ORDER BY split), total) - s)::BIGINT AS nnz
  FROM cuts, goal
)
"""


def _tri(n: int) -> str:
    return f"""
tri AS (SELECT i, j, CASE WHEN i <> j THEN 0.1 WHEN i = 0 OR i = {n - 1} THEN 0.9 ELSE 0.8 END::DOUBLE AS v
  FROM range({n}) AS r(i), range({n}) AS c(j) WHERE abs(i - j) <= 1),
gauss AS (SELECT i, exp(-10.0 * (5.0 * (i / {n}.0::DOUBLE - 0.5)) * (5.0 * (i / {n}.0::DOUBLE - 0.5))) AS v FROM range({n}) AS r(i))"""


def _power(n: int, times: int) -> str:
    steps = ["x0 AS MATERIALIZED (SELECT i, v FROM gauss)"]
    for k in range(times):
        steps.append(f"x{k + 1} AS MATERIALIZED (SELECT tri.i, sum(tri.v * x{k}.v) AS v FROM tri JOIN x{k} ON tri.j = x{k}.i GROUP BY tri.i)")
    return f"WITH {_tri(n)}, {', '.join(steps)} SELECT i AS idx, round(v, 6) AS val FROM x{times}"


def _cg_steps(times: int, matrix: str, right: str) -> list[str]:
    """CTEs s0 .. s<times> (i, x, r, p) and c0 .. (al, rr); matrix has (i, j, v), right (i, v)."""
    steps = [f"s0 AS MATERIALIZED (SELECT i, 0.0::DOUBLE AS x, v AS r, v AS p FROM {right})"]
    for k in range(times):
        steps += [
            f"m{k} AS MATERIALIZED (SELECT s.*, y.ap FROM s{k} s JOIN (SELECT a.i, sum(a.v * p) AS ap FROM {matrix} a JOIN s{k} ON a.j = s{k}.i GROUP BY a.i) y ON s.i = y.i)",
            f"u{k} AS MATERIALIZED (SELECT m.i, m.x + al * m.p AS x, m.r - al * m.ap AS r, m.p, rr FROM m{k} m, (SELECT sum(r * r) / sum(p * ap) AS al, sum(r * r) AS rr FROM m{k}) c)",
            f"s{k + 1} AS MATERIALIZED (SELECT u.i, u.x, u.r, u.r + be * u.p AS p FROM u{k} u, (SELECT sum(r * r) / max(rr) AS be FROM u{k}) c)",
        ]
    return steps


def _cg(times: int) -> str:
    return _sql(f"SELECT i AS idx, round(x, 6) AS val FROM s{times}", more=", " + ", ".join(["qv AS (SELECT i, q AS v FROM q)", *_cg_steps(times, "l", "qv")]))


def _cg_report(times: int, rtol: float, matrix: str, right: str) -> tuple[str, str]:
    """The CTEs and the row that says at which step the residual was small enough, and what x was."""
    all_ = " UNION ALL ".join(f"SELECT {k} AS k, sqrt(sum(r * r)) AS rn, sqrt(sum(x * x)) AS xn FROM s{k}" for k in range(times + 1))
    steps = ", ".join([*_cg_steps(times, matrix, right), f"res AS MATERIALIZED ({all_})"])
    body = (
        f"SELECT k::BIGINT AS iterations, round(log10(rn / (SELECT rn FROM res WHERE k = 0)), 2) AS residual, round(xn, 6) AS norm "
        f"FROM res WHERE k = (SELECT coalesce(min(k), {times}) FROM res WHERE rn / (SELECT rn FROM res WHERE k = 0) < {rtol} AND k > 0)"
    )
    return steps, body


def _cycles_sql() -> str:
    steps = ["q0 AS (SELECT i, q AS v FROM q)"]
    for k in range(1, CYCLES + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT j, sum(a.v * t.v) AS v FROM a JOIN q{k - 1} t ON a.i = t.i GROUP BY j)")
        steps.append(f"q{k} AS MATERIALIZED (SELECT a.i, sum(a.v * t.v) AS v FROM a JOIN p{k} t ON a.j = t.j GROUP BY a.i)")
    rows = " UNION ALL ".join(f"SELECT {k}::INTEGER AS cycle, (SELECT round(log10(sum(v * v)) / 2, 9) FROM p{k}) AS p_norm, (SELECT round(log10(sum(v * v)) / 2, 9) FROM q{k}) AS q_norm" for k in range(1, CYCLES + 1))
    return _sql(rows, more=", " + ", ".join(steps))


SYM = "CASE WHEN pi <> pj THEN 'remote' WHEN i > j THEN 'lower' WHEN i = j THEN 'diagonal' END"

SQL: dict[str, str] = {
    **dict.fromkeys(("spmv_vanilla", "spmv_coo", "spmv_csr", "spmv_blocked", "spmv_broadcast"), SPMV),
    **dict.fromkeys(("spmv_overlap", "spmv_symmetric", "spmv_sym_overlap"), LAPLACE),
    "spmv_alpha_beta": _sql("SELECT q.i AS idx, (2 * coalesce(s, 0.0) - 3 * q)::DOUBLE AS val FROM q LEFT JOIN (SELECT i, sum(v * x) AS s FROM a0 JOIN x ON a0.j = x.j GROUP BY i) y ON y.i = q.i"),
    "spmv_diag_only": _sql("SELECT q.i AS idx, coalesce(v * q, 0.0)::DOUBLE AS val FROM q LEFT JOIN l ON l.i = q.i AND l.j = q.i"),
    "diag_extract": _sql("SELECT i AS idx, v::DOUBLE AS val FROM l WHERE i = j"),
    "spmv_transpose": _sql("SELECT x.j AS idx, coalesce(s, 0.0)::DOUBLE AS val FROM x LEFT JOIN (SELECT j, sum(v * q) AS s FROM a0 JOIN q ON a0.i = q.i GROUP BY j) y ON y.j = x.j"),
    "power_apply": _power(50, TIMES),
    "restrict_prolong": _sql(
        "SELECT q.i AS idx, coalesce(qn.v, 0.0)::DOUBLE AS val, (SELECT round(sqrt(sum(v * v)), 2) FROM pv) AS p_norm, (SELECT round(sqrt(sum(v * v)), 2) FROM qn) AS q_norm FROM q LEFT JOIN qn ON qn.i = q.i",
        more=", pv AS MATERIALIZED (SELECT j, sum(v * q) AS v FROM a JOIN q ON a.i = q.i GROUP BY j), qn AS MATERIALIZED (SELECT a.i, sum(a.v * pv.v) AS v FROM a JOIN pv ON a.j = pv.j GROUP BY a.i)",
    ),
    "assemble_duplicates": _sql("SELECT i AS row, j AS col, v::DOUBLE AS val FROM a"),
    "assemble_row_ghosts": _sql(f"SELECT i AS row, j AS col, v::DOUBLE AS val, {_owner('i')} AS part FROM a, ns"),
    "csr_build": _sql("SELECT i AS row, count(*)::BIGINT AS n, string_agg(j::VARCHAR, ',' ORDER BY j) AS colind, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY j) AS values FROM a GROUP BY i"),
    "csr_to_coo": _sql("SELECT i AS row, j AS col, v::DOUBLE AS val FROM a"),
    "csr_rowptr": _sql("SELECT i AS row, (s - c)::BIGINT AS start, s::BIGINT AS stop FROM (SELECT i, c, sum(c) OVER (ORDER BY i) AS s FROM (SELECT q.i, count(a.i) AS c FROM q LEFT JOIN a ON a.i = q.i GROUP BY q.i))"),
    "sym_split_lower": _sql(f"SELECT pi AS part, i AS row, j AS col, v::DOUBLE AS val FROM lp WHERE {SYM} = 'lower'"),
    "sym_split_diag": _sql(f"SELECT pi AS part, i AS row, j AS col, v::DOUBLE AS val FROM lp WHERE {SYM} = 'diagonal'"),
    "local_remote_split": _sql("SELECT pi AS part, i AS row, j AS col, pi = pj AS is_local, v::DOUBLE AS val FROM wp"),
    "nnz_by_part": _sql("SELECT part, count(i) FILTER (WHERE pi = pj)::BIGINT AS local, count(i) FILTER (WHERE pi <> pj)::BIGINT AS remote, count(i)::BIGINT AS nnz FROM parts LEFT JOIN wp ON pi = part GROUP BY part"),
    "nnz_symmetric": _sql(
        f"SELECT part, count(i) FILTER (WHERE {SYM} = 'lower')::BIGINT AS lower, count(i) FILTER (WHERE {SYM} = 'remote')::BIGINT AS remote, count(DISTINCT i) FILTER (WHERE {SYM} = 'diagonal')::BIGINT AS diagonal, "
        f"(2 * count(i) FILTER (WHERE {SYM} = 'lower') + count(i) FILTER (WHERE {SYM} = 'remote') + count(DISTINCT i) FILTER (WHERE {SYM} = 'diagonal'))::BIGINT AS nnz FROM parts LEFT JOIN lp ON pi = part GROUP BY part"
    ),
    "part_shape": _sql("SELECT parts.part, (hi - lo)::BIGINT AS rows, (hi - lo + count(gidx))::BIGINT AS cols, count(gidx)::BIGINT AS ghosts, lo AS \"offset\", max(n)::BIGINT AS global_rows FROM parts LEFT JOIN ghosts ON ghosts.part = parts.part GROUP BY parts.part, lo, hi"),
    "format_size": _sql(
        "SELECT part, (4 * r + 12 * nnz)::BIGINT AS matrix_bytes, (4 * (r + 1) + 12 * nnz)::BIGINT AS csr_bytes, (16 * nnz)::BIGINT AS coo_bytes, (8 * r + 12 * nnz)::BIGINT AS split_bytes, (8 * r + 12 * (lo_nnz + nnz - local) + 8 * r)::BIGINT AS symmetric_bytes "
        "FROM (SELECT part, hi - lo AS r, count(i) AS nnz, count(i) FILTER (WHERE pi = pj) AS local, count(i) FILTER (WHERE pi = pj AND i > j) AS lo_nnz FROM parts LEFT JOIN lp ON pi = part GROUP BY part, lo, hi)"
    ),
    "owner_ranges": _sql("SELECT part, lo, hi FROM parts"),
    "ghost_columns": _sql("SELECT part, gidx, lidx FROM ghosts"),
    "global_to_local": _sql("SELECT pi AS part, (i - lo)::BIGINT AS lrow, (CASE WHEN pi = pj THEN j - lo ELSE lidx END)::BIGINT AS lcol, v::DOUBLE AS val FROM wp JOIN parts ON pi = parts.part LEFT JOIN ghosts ON ghosts.part = pi AND gidx = j"),
    "local_to_global": _sql("SELECT i AS row, j AS col, v::DOUBLE AS val FROM w"),
    "exchange_neighbours": _sql("SELECT part, owner AS neighbour FROM g UNION SELECT owner, part FROM g"),
    "exchange_counts": _sql(
        "SELECT e.part, neighbour, send_count, recv_count, coalesce(sum(send_count) OVER w1, 0)::BIGINT AS send_offset, (hi - lo + coalesce(sum(recv_count) OVER w1, 0))::BIGINT AS recv_offset FROM e JOIN parts ON e.part = parts.part WINDOW w1 AS (PARTITION BY e.part ORDER BY neighbour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        more=", e AS (SELECT part, neighbour, sum(s)::BIGINT AS send_count, sum(r)::BIGINT AS recv_count FROM (SELECT part, owner AS neighbour, 0 AS s, count(*) AS r FROM g GROUP BY 1, 2 UNION ALL SELECT owner, part, count(*), 0 FROM g GROUP BY 1, 2) GROUP BY 1, 2)",
    ),
    "exchange_indices": _sql("SELECT owner AS part, g.part AS neighbour, (gidx - lo)::BIGINT AS lidx FROM g JOIN parts ON parts.part = owner"),
    "ghost_update": _sql("SELECT part, gidx, lidx, q AS val FROM ghosts JOIN q ON q.i = gidx"),
    "reverse_update": _sql("SELECT i AS idx, sum(v)::DOUBLE AS val FROM (SELECT i, q AS v FROM q UNION ALL SELECT gidx, gidx + 10 * (part + 1) FROM g) GROUP BY i"),
    "gather": _sql("SELECT o_orderkey AS pos, q AS val FROM orders, ns, q WHERE q.i = o_custkey % n"),
    "nnz_row_split": _sql("SELECT split, row_start, row_end, nnz FROM bounds", recursive=True, more=SPLIT),
    "conflict_map": _sql("SELECT DISTINCT j AS target, split FROM low JOIN bounds ON i >= row_start AND i < row_end WHERE j < row_start", recursive=True, more=SPLIT),
    "minmax_by_part": _sql(f"SELECT {_owner('i')} AS part, min(q) AS least, max(q) AS most FROM q, ns GROUP BY 1"),
    "dot": _sql("SELECT sum(q * b)::DOUBLE AS dot FROM q JOIN b ON q.i = b.i"),
    "axpy": _sql("SELECT q.i AS idx, (2 * q + b)::DOUBLE AS val FROM q JOIN b ON q.i = b.i"),
    "scal": _sql("SELECT i AS idx, (3 * b)::DOUBLE AS val FROM b"),
    "norm2": _sql("SELECT sum(q * q)::DOUBLE AS squared, round(sqrt(sum(q * q)), 6) AS norm FROM q"),
    "fused_update": _sql("SELECT q.i AS idx, (q + 2 * 2 * q)::DOUBLE AS x, (b - 2 * 3 * b)::DOUBLE AS r FROM q JOIN b ON q.i = b.i"),
    "xpby": _sql("SELECT q.i AS idx, (b + 2 * q)::DOUBLE AS val FROM q JOIN b ON q.i = b.i"),
    "residual_norm": _sql("SELECT sum(d * d)::DOUBLE AS squared, round(sqrt(sum(d * d)), 4) AS norm FROM (SELECT b.i, s - b AS d FROM b JOIN (SELECT l.i, sum(v * q) AS s FROM l JOIN q ON l.j = q.i GROUP BY l.i) y ON y.i = b.i)"),
    "gen_tridiag": f"WITH {_tri(100)} SELECT i AS row, j AS col, round(v, 9) AS val FROM tri",
    "gen_gaussian": f"WITH {_tri(100)} SELECT i AS idx, round(v, 9) AS val FROM gauss",
    "cg_fixed_iters": _cg(3),
    "cg_converged": "WITH " + _tri(100) + ", " + ", ".join(_cg_report(9, 1e-10, "tri", "gauss")[:1]) + " " + _cg_report(9, 1e-10, "tri", "gauss")[1],
    "cg_report": _sql(_cg_report(CG_STEPS, CG_RTOL, "l", "qv")[1], more=", qv AS (SELECT i, q AS v FROM q), " + _cg_report(CG_STEPS, CG_RTOL, "l", "qv")[0]),
    "restrict_prolong_cycles": _cycles_sql(),
    **dict.fromkeys(("petsc_matrix", "from_csr_rows"), _sql("SELECT i AS row, j AS col, v::DOUBLE AS val FROM a")),
    "petsc_vector": _sql("SELECT i AS idx, q AS val FROM q"),
    "petsc_symmetric_spmv": LAPLACE,
    "from_csr": "SELECT row, unnest(cols)::BIGINT AS col, unnest(vals)::DOUBLE AS val FROM (VALUES (0::BIGINT, [0, 1, 3], [1, -2, -3]), (1, [0, 1, 3], [-2, 5, 4]), (2, [2, 3, 4], [6, 4, -4]), (3, [0, 1, 2, 3], [-3, 4, 4, 8]), (4, [2, 4], [-4, 8])) AS t(row, cols, vals)",
    "from_entries": _sql("SELECT i AS row, j AS col, v::DOUBLE AS val FROM l WHERE i >= j"),
    "sink_parquet": _sql("SELECT i AS row, j AS col, v::DOUBLE AS val, n::BIGINT AS nrows, m::BIGINT AS ncols FROM a, ns, np"),
    "ghost_faults": _sql(
        "SELECT part, count(*) FILTER (WHERE gidx <= before)::BIGINT AS unsorted, count(*) FILTER (WHERE own)::BIGINT AS own FROM "
        "(SELECT part, gidx, own, lag(gidx) OVER (PARTITION BY part ORDER BY pos) AS before FROM "
        "(SELECT part, lidx AS pos, gidx, owner = part AS own FROM ghosts UNION ALL SELECT part, 1099511627776, lo, true FROM parts WHERE part % 2 = 1)) GROUP BY part"
    ),
    "copy_memset": _sql("SELECT i AS idx, 7.5::DOUBLE AS val FROM q"),
}
