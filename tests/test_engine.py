"""The engine's operators on literal fixtures and against NumPy."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import errors, queries
from brindle.core import Matrix, MultiVector, Vector
from brindle.functions import integer
from brindle.functions import scalar as S
from brindle.operators import aggregates as G
from brindle.operators import components as CO
from brindle.operators import dense as D
from brindle.operators import factor as L
from brindle.operators import joins as X
from brindle.operators import panels as N
from brindle.operators import ranking as R
from brindle.operators import strips as T
from brindle.operators import views as P
from brindle.plans import krylov as K
from brindle.plans import preconditioners as PC
from brindle.plans import smoothers as SM
from brindle.plans.lineage import cut
from brindle.plans.minimization import UPDATES, armijo, quasi_newton, wolfe
from brindle.sources import constructors as C
from brindle.sources import elements as E
from brindle.sources import matrix_market as MM
from brindle.sources import paths, printing
from brindle.streaming import assembly

A3 = [[1.0, 2, 3], [4, 5, 6], [7, 8, 9]]


def test_make_sparse(spark):
    t = C.triplets(spark, [2, 0, 4, 1, 3, 1, 0], [0, 3, 3, 6, 5, 6, 2], [1, 2, 3, 3, 5, 1, 0])
    A = C.make_sparse(t)
    assert (A.nrows, A.ncols, P.nnz(A)) == (5, 7, 5)
    assert (P.at(A, 4, 3), P.at(A, 1, 6), P.at(A, 1, 5)) == (3, 4, 0)
    B = C.make_sparse(t, 6, 8)
    assert (B.nrows, B.ncols) == (6, 8)
    with pytest.raises(errors.IndexOutOfRange):
        P.at(A, 5, 0)


def test_scalar_assignment_is_the_diagonal(spark):
    assert C.scaled_identity(spark, 2, 3, 4.0).local() == [[4, 0, 0], [0, 4, 0]]
    assert C.fill(spark, 3, 4.0).local() == [4, 4, 4]
    assert C.fill(spark, (2, 2), 4.0).local() == [[4, 4], [4, 4]]
    assert C.set_to_zero(C.fill(spark, 3, 4.0)).local() == [0, 0, 0]


def test_laplacian(spark):
    A = C.laplacian(spark, 3, 4)
    assert (P.at(A, 0, 0), P.at(A, 0, 1), P.at(A, 0, 4), P.at(A, 0, 2)) == (4, -1, -1, 0)
    assert G.trace(A) == 4 * 3 * 4
    assert np.allclose(C.poisson_apply(3, 4, C.iota(spark, 12)).local(), np.array(A.local()) @ np.arange(12))
    S5 = C.laplacian(spark, 5, 5)
    row = P.row(X.matmul(S5, S5), 12).local()
    assert [row[k] for k in (12, 13, 14, 15, 17, 18, 22)] == [20, -8, 1, 0, -8, 2, 1]


def test_hessian_product(spark):
    C_ = X.matmul(C.hessian(spark, 5, 7), C.hessian(spark, 7, 6, 2.0))
    assert C.check_hessian_product(C_, 7, 2.0) and not C.check_hessian_product(P.scale(2.0, C_), 7, 2.0)


def test_norms(spark):
    A = Matrix.of(spark, [[0, 1, 4, 0], [1, 3, 4, 4], [0, 9, 4, 2], [0, 0, 4, 0]])
    assert (G.one_norm(A), G.infinity_norm(A), round(G.frobenius_norm(A) ** 2, 9)) == (16, 15, 176)
    v = Vector.of(spark, [(k + 1) * (-1.0) ** k for k in range(5)])
    assert (G.one_norm(v), round(G.two_norm(v), 4), G.infinity_norm(v), G.sum_(v), G.product(v)) == (15, 7.4162, 5, 3, 120)
    assert (G.max_(v), G.min_(v), G.max_pos(v), G.min_pos(v), G.max_abs_pos(v)) == (5, -4, 4, 3, 4)


def test_empty_reductions_are_identities(spark):
    v = Vector(spark.createDataFrame([], "i long, v double"), 0)
    assert (G.sum_(v), G.product(v), G.one_norm(v), G.two_norm(v), G.infinity_norm(v)) == (0, 1, 0, 0, 0)
    assert G.max_(v) == -1.7976931348623157e308 and G.min_(v) == 1.7976931348623157e308
    with pytest.raises(errors.NeedNonempty):
        G.max_pos(v)
    assert G.max_(Vector(spark.createDataFrame([(1, -3.0)], "i long, v double"), 4), implicit_zeros=True) == 0


def test_dot_conjugates_the_first(spark):
    u = Vector.of(spark, [1 + 2j, 3 - 1j])
    v = Vector.of(spark, [2 - 1j, 1j])
    assert G.dot(u, v) == np.vdot([1 + 2j, 3 - 1j], [2 - 1j, 1j])
    assert G.dot_real(u, v) == np.dot([1 + 2j, 3 - 1j], [2 - 1j, 1j])
    x = Vector.of(spark, range(1, 10))
    assert G.dot(x, x) == G.unary_dot(x) == 285
    assert X.matmul(P.trans(u), v) == np.dot([1 + 2j, 3 - 1j], [2 - 1j, 1j])


def test_positions(spark):
    A = Matrix.of(spark, [[0, 3, 0, 0, 0], [0, 0, 0, 0, 7], [0, 0, 0, -2, 5]])
    assert (G.max_pos(A), G.min_pos(A), G.max_abs_pos(P.negate(A))) == ((1, 4), (2, 3), (1, 4))


def test_views(spark):
    a, A = np.array(A3), Matrix.of(spark, A3)
    same = lambda x, y: np.array_equal(x.local(), y)
    assert same(P.trans(P.trans(A)), a) and same(P.trans(A), a.T)
    assert same(P.upper(A), np.triu(a)) and same(P.strict_lower(A), np.tril(a, -1)) and same(P.triu(A, -1), np.triu(a, -1)) and same(P.tril(A, 1), np.tril(a, 1))
    assert same(P.bands(A, 0, 2), np.triu(np.tril(a, 1)))
    assert same(P.sub_matrix(A, 1, 9, 0, 2), a[1:, :2]) and same(P.indirect(A, [2, 0, 2], [1, 1]), a[[2, 0, 2]][:, [1, 1]])
    assert P.row(A, 1).local() == [4, 5, 6] and P.column(A, 2).local() == [3, 6, 9]
    assert P.diagonal(A).local() == [1, 5, 9] and same(P.diagonal(P.diagonal(A)), np.diag([1, 5, 9]))
    assert same(P.invert_diagonal(A), np.where(np.eye(3), 1 / a, a))
    assert same(A.resized(2, 2), a[:2, :2]) and P.nnz(A.resized(2, 2, keep=False)) == 0
    assert P.extract(P.row(A, 0), [2, 0]) == [3, 1] and P.entry_similar(A, 0, 0, 1.01, 0.1)
    assert P.equal(P.row(A, 0), P.row(A, 0)).first()[0] and not P.equal(P.row(A, 0), P.row(A, 1)).first()[0]
    assert P.strided(Vector.of(spark, range(10)), 1, 9, 3).local() == [1, 4, 7]
    assert P.intersection((0, 5), (3, 9)) == (3, 5) and P.in_range((3, 5), 4) and P.to_range((3, 5), 4) == 1 and P.from_range((3, 5), 1) == 4
    with pytest.raises(errors.RangeError):
        P.sub_matrix(A, 2, 1, 0, 1)
    with pytest.raises(errors.ChangeStaticSize):
        Matrix(A.df, 3, 3, fixed=True).resized(2, 2)


def test_sparse_zeros_stay_until_cropped(spark):
    A = Matrix.of(spark, [[0, 1], [2, 0]], zeros=True)
    assert P.nnz(A) == 4 and P.nnz(P.crop(A)) == 2 and P.nnz(P.crop(A, 1.0)) == 1
    B = P.symmetric_pattern(Matrix.of(spark, [[1, 2], [0, 3]]))
    assert P.nnz(B) == 4 and B.local() == [[1, 2], [0, 3]]


def test_quadrants_cover(spark):
    A, seen = C.ones(spark, 7, 5), []
    P.Quadrants(A).for_each(lambda q: seen.append((q.r1 - q.r0) * (q.c1 - q.c0)), lambda q: q.is_leaf(2))
    assert sum(seen) == 35 and max(seen) <= 4


def test_products(spark):
    rng = np.random.default_rng(1)
    a, b = np.where(rng.random((6, 5)) < 0.5, 0, rng.integers(-5, 6, (6, 5))).astype(float), rng.integers(-5, 6, (5, 4)).astype(float)
    A, B, x, y = Matrix.of(spark, a), Matrix.of(spark, b), Vector.of(spark, range(5)), Vector.of(spark, range(6), row=True)
    assert np.array_equal(X.matmul(A, B).local(), a @ b) and np.array_equal(X.matmul(A, B, salt=3).local(), a @ b)
    assert np.array_equal(X.matmul(A, x).local(), a @ np.arange(5)) and np.array_equal(X.matmul(y, A).local(), np.arange(6) @ a)
    assert np.array_equal(D.dense_matmul(A, B, 2).local(), a @ b) and np.array_equal(D.Blocked.of(A, 4).add(D.Blocked.of(A, 4)).entries().local(), 2 * a)
    assert np.array_equal(D.Blocked.of(A, 2).z_order(3).trans().entries().local(), a.T)
    assert np.array_equal(X.mult(A, B, X.matmul(A, B)).local(), 2 * a @ b)
    assert np.array_equal(X.kron(A, B).local(), np.kron(a, b)) and np.array_equal(X.outer(x, x).local(), np.outer(range(5), range(5)))
    s = a[:5, :5]
    assert np.array_equal(X.matrix_power(Matrix.of(spark, s), 3).local(), np.linalg.matrix_power(s, 3)) and np.array_equal(X.matrix_power(Matrix.of(spark, s), 0).local(), np.eye(5))
    mv = P.multi_vector([P.column(B, k) for k in range(4)])
    assert isinstance(mv, MultiVector) and np.array_equal(X.matmul(mv, Vector.of(spark, range(4))).local(), b @ np.arange(4))
    assert np.array_equal(mv.vectors(1, 3).matrix().local(), b[:, 1:3])
    with pytest.raises(errors.IncompatibleSize):
        X.matmul(A, A)
    with pytest.raises(errors.IncompatibleShape):
        X.matmul(A, y)
    with pytest.raises(errors.TooLarge):
        X.outer(x, x, most=10)


def test_kron_literal(spark):
    K_ = X.kron(Matrix.of(spark, [[11, 12], [21, 22]]), Matrix.of(spark, [[1100, 1200], [2100, 2200]]))
    assert (P.at(K_, 0, 0), P.at(K_, 3, 3)) == (12100, 48400)


def test_element_wise(spark):
    A, B = Matrix.of(spark, [[1, 0], [2, 3]]), Matrix.of(spark, [[5, 6], [0, 2]])
    assert X.add_(A, B).local() == [[6, 6], [2, 5]] and X.sub(A, B).local() == [[-4, -6], [2, 1]]
    assert X.ele_prod(A, B).local() == [[5, 0], [0, 6]] and P.nnz(X.ele_prod(A, B)) == 2
    q = X.ele_quot(A, B).local()
    assert q[0][0] == 0.2 and q[1][0] == math.inf and q[1][1] == 1.5
    assert X.assign(A, B, "plus").local() == [[6, 6], [2, 5]] and X.assign(A, B).local() == B.local()
    assert X.combine(A, B, F.least).local() == [[1, 0], [0, 2]]
    assert P.divide_by(A, 0.0).local()[0][0] == math.inf


def test_cross(spark):
    assert X.cross(Vector.of(spark, [1, 2, 3]), Vector.of(spark, [4, 5, 6])).local() == [-3, 6, -3]
    rng = np.random.default_rng(2)
    a, b = rng.integers(-4, 5, 7).astype(float), rng.integers(-4, 5, 7).astype(float)
    c = np.array(X.cross(Vector.of(spark, a), Vector.of(spark, b)).local())
    assert abs(c @ a) < 1e-9 and abs(c @ b) < 1e-9 and abs(c @ c - ((a @ a) * (b @ b) - (a @ b) ** 2)) < 1e-9
    with pytest.raises(errors.IncompatibleSize):
        X.cross(Vector.of(spark, [1, 2]), Vector.of(spark, [1, 2]))


def test_permutations(spark):
    A, p = Matrix.of(spark, A3), [1, 2, 0]
    M = X.permutation(spark, p)
    assert P.at(X.matmul(M, A), 1, 2) == 9 and P.at(X.matmul(X.matmul(M, A), P.trans(M)), 1, 2) == 7
    v = Vector.of(spark, [10, 20, 30])
    assert X.gather(p, v).local() == [20, 30, 10] and X.scatter(p, v).local() == [30, 10, 20]
    assert X.reverse_permute(p, X.permute(p, v)).local() == [10, 20, 30]
    assert X.swap_row(A, 0, 2).local() == [A3[2], A3[1], A3[0]] and X.reorder_rows([2, 2, 0], A).local() == [A3[2], A3[2], A3[0]]
    h = C.hessian(spark, 4, 4)
    assert P.indirect(h, [2, 0, 3], [2, 0]).local() == [[4, 2], [2, 0], [5, 3]]


def test_insertion(spark):
    A = Matrix.of(spark, [[3, 7.2, 0], [2, 4.444, 5]])
    one = lambda *cells: spark.createDataFrame(list(cells), "i long, j long, v double, seq long")
    A = X.insert(A, one((1, 0, 1.0, 0)), "plus")
    A = X.insert(A, one((1, 2, 9.0, 0), (1, 2, 4.0, 1)), "store")
    assert A.local() == [[3, 7.2, 0], [3, 4.444, 4]]
    assert X.insert(A, one((0, 2, 5.0, 0)), "minus").local()[0] == [3, 7.2, -5]
    assert X.insert(A, one((0, 0, 5.0, 0)), "times").local()[0][0] == 15
    assert X.insert_block(A, [[1, 2], [3, 4]], [0, 1], [0, 2]).local() == [[4, 7.2, 2], [6, 4.444, 8]]
    assert X.insert_matrix(A, 0, 1, Matrix.of(spark, [[8, 9]])).local()[0] == [3, 8, 9]


def test_restrict_and_prolongate(spark):
    x = Vector.of(spark, range(10))
    y, m = X.restrict(x, C.tag_vector(spark, 10, 3, 7))
    assert y.local() == [3, 4, 5, 6] and X.prolongate(y, m, 10).local() == [0, 0, 0, 3, 4, 5, 6, 0, 0, 0]


def test_complex(spark):
    a = np.array([[1 + 2j, 0], [3j, 4 - 1j]])
    A = Matrix.of(spark, a.tolist())
    assert np.array_equal(P.hermitian(A).local(), a.conj().T) and np.array_equal(X.matmul(A, A).local(), a @ a)
    assert np.array_equal(P.real(A).local(), a.real) and np.array_equal(P.imag(A).local(), a.imag)
    assert np.array_equal(P.merge_complex(*P.split_complex(A)).local(), a) and np.array_equal(P.scale(2j, Matrix.of(spark, a.real)).local(), 2j * a.real)
    assert G.trace(A) == 5 + 1j and np.array_equal(X.insert(A, A.df, "plus").local(), 2 * a)
    z = spark.range(1).select(S.c_div(S.complex_(F.lit(1), F.lit(2)), S.complex_(F.lit(3), F.lit(-1))).alias("q"), S.c_signum(S.complex_(F.lit(-3), F.lit(4))).alias("s")).first()
    assert abs(complex(*z["q"]) - (1 + 2j) / (3 - 1j)) < 1e-12 and z["s"] == -1


def test_scalar_edges(spark):
    row = spark.range(1).select(S.divide(F.lit(1.0), F.lit(0.0)).alias("a"), S.divide(F.lit(-1.0), F.lit(0.0)).alias("b"), S.divide(F.lit(0.0), F.lit(0.0)).alias("c"), S.log(F.lit(0.0)).alias("d"), S.log(F.lit(-1.0)).alias("e"), S.round_half_away(F.lit(-2.5)).alias("f"), S.trunc(F.lit(-2.7)).alias("g"), S.compose(S.square, S.negate)(F.lit(3.0)).alias("h"), S.erf(F.lit(0.5)).alias("i"), S.atanh(F.lit(1.0)).alias("j"), S.minimal_increase(F.lit(1.0)).alias("k")).first()
    assert (row["a"], row["b"], row["d"], row["f"], row["g"], row["h"], row["j"]) == (math.inf, -math.inf, -math.inf, -3, -2, 9, math.inf)
    assert math.isnan(row["c"]) and math.isnan(row["e"]) and row["i"] == math.erf(0.5) and row["k"] > 1


def test_integers(spark):
    assert [n for n in range(20) if integer.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19]
    assert integer.is_power_of_2(8) and not integer.is_power_of_2(12) and integer.log2(9) == 3 and integer.least_significant_one_bit(12) == 4
    assert integer.power("ab", 5, lambda a, b: a + b) == "ab" * 5 and integer.power(2.0, -3, lambda a, b: a * b, 1.0, lambda x: 1 / x) == 0.125
    assert spark.range(1).select(integer.interleave(F.lit(3), F.lit(5))).first()[0] == 0b011011


def test_folds(spark):
    x = Vector.of(spark, [3, 1, 2])
    assert G.accumulate(x, "multiply") == 6 and G.reduce_with(x, 0.0, lambda s, v: s + v * v, lambda a, b: a + b, math.sqrt) == math.sqrt(14)


def test_order(spark):
    x = Vector.of(spark, [7.6, -9, 2.5, 2.5])
    assert R.sort(x).local() == [-9, 2.5, 2.5, 7.6] and [r["p"] for r in R.sort_with_permutation(x).orderBy("i").collect()] == [1, 2, 3, 0]
    assert [r["i"] for r in R.sort_on_data(x).collect()] == [1, 0, 2, 3] and R.largest(x, 1) == 7.6
    y = Vector.of(spark, [1, 1, 0, -1])
    assert [(r["v"], r["w"]) for r in R.sort_xy(x, y).orderBy("i").collect()] == [(-9, 1), (2.5, -1), (2.5, 0), (7.6, 1)]
    assert R.window_sums(Vector.of(spark, range(8)), 3, 2).local() == [3, 9, 15]
    t = np.random.default_rng(3).random((3, 12))
    want = [(t[:, k : k + 4].sum(0) ** 2).sum() / (3 * (t[:, k : k + 4] ** 2).sum()) for k in range(0, 9, 2)]
    assert np.allclose(R.semblance(Matrix.of(spark, t), 4, 2).local(), want)


def test_triangular(spark):
    U = Matrix.of(spark, [[7, 0, 0, 0, 0], [5, 8, 0, 2, 3], [0, 0, 2, 0, 0], [0, 0, 1, 4, 0], [0, 0, 0, 0, 9]])
    x = C.iota(spark, 5, 1)
    assert np.allclose(L.upper_solve(U, X.matmul(P.upper(U), x)).local(), range(1, 6))
    unit = X.add_(P.strict_lower(U), C.identity(spark, 5))
    assert np.allclose(L.lower_solve(U, X.matmul(unit, x), "unit").local(), range(1, 6))
    assert np.allclose(L.lower_solve(P.invert_diagonal(U), X.matmul(P.lower(U), x), "inverse").local(), range(1, 6))
    by_levels = L._by_levels(P.strict_upper(U).df, P.diagonal(U).df.select("i", (1 / F.col("v")).alias("f")), X.matmul(P.upper(U), x), 5, 10)
    assert np.allclose(by_levels.local(), range(1, 6))
    with pytest.raises(errors.MissingDiagonal):
        L.upper_solve(P.strict_upper(U), x)


def test_lu(spark):
    cycle = [[0.0, 0, 2, 1], [3, 1, 0, 0], [0, 4, 1, 1], [1, 0, 0, 5]]  # pivots go round three rows
    A, x = Matrix.of(spark, cycle), Vector.of(spark, [1, -2, 3, 4])
    assert np.allclose(L.lu_solve(A, X.matmul(A, x)).local(), [1, -2, 3, 4])
    assert np.allclose(L.lu_adjoint_solve(A, X.matmul(P.trans(A), x)).local(), [1, -2, 3, 4])
    s = L.LuSolver(A)
    assert np.allclose(s.solve(X.matmul(A, x)).local(), s.adjoint_solve(X.matmul(P.trans(A), x)).local())
    assert np.allclose(np.array(cycle) @ L.inv(A).local(), np.eye(4)) and abs(L.determinant(A) - np.linalg.det(cycle)) < 1e-9
    with pytest.raises(errors.MatrixSingular):
        L.lu(Matrix.of(spark, [[0, 1], [0, 2]]))
    with pytest.raises(errors.MatrixNotSquare):
        L.lu(Matrix.of(spark, [[1, 2, 3], [4, 5, 6]]))
    assert L.determinant(Matrix.of(spark, [[1, 2], [2, 4]])) == 0


def test_orthogonal(spark):
    a = np.array([[1.0, 1, 1, 0, 0], [3, -1, -2, 0, 0], [1, 7, 1, 0, 0], [0, 0, 0, -10, 0], [4, 0, 3, 0, 0]])
    for f in (L.qr, L.qr_givens):
        q, r = (np.array(m.local()) for m in f(Matrix.of(spark, a)))
        assert np.allclose(q @ r, a) and np.allclose(q @ q.T, np.eye(5)) and np.allclose(r, np.triu(r))
    l, q = (np.array(m.local()) for m in L.lq(Matrix.of(spark, a[:3])))
    assert np.allclose(l @ q, a[:3])
    for b in (a[:3, :4], a[:3, :4].T):
        s, v, d = (np.array(m.local()) for m in L.svd(Matrix.of(spark, b)))
        assert np.allclose(s @ v @ d.T, b) and (v >= 0).all()
    h, q = (np.array(m.local()) for m in L.hessenberg(Matrix.of(spark, a)))
    assert np.allclose(q @ h @ q.T, a) and np.allclose(h, np.triu(h, -1))
    v, b = L.householder(np.array([3.0, 4, 0]))
    assert np.allclose((np.eye(3) - b * np.outer(v, v)) @ [3, 4, 0], [5, 0, 0]) and np.allclose(L.givens(3, 4) @ [3, 4], [5, 0])
    spd = a @ a.T + np.eye(5)
    c = np.array(L.cholesky(Matrix.of(spark, spd), 2).local())
    assert np.allclose(c @ c.T, spd)
    with pytest.raises(errors.MatrixSingular):
        L.cholesky(Matrix.of(spark, [[1, 2], [2, 1]]))


def test_tall(spark):
    a = np.random.default_rng(4).standard_normal((200, 6))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(a)], "k long, x array<double>").repartition(5)
    r = L.tall_r(rows, "x", 6)
    q = np.array([x["q"] for x in L.tall_q(rows, "k", "x", r).orderBy("k").collect()])
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(6)) and np.allclose(L.tall_singular_values(rows, "x", 6), np.linalg.svd(a, compute_uv=False))


def test_eigenvalues(spark):
    a = np.array([[1.0, 1, 1, 0], [1, -1, -2, 0], [1, -2, 1, 0], [0, 0, 0, 10]])
    assert np.allclose(L.eigenvalues_symmetric(Matrix.of(spark, a)), np.linalg.eigvalsh(a))
    assert np.allclose(L.eigenvalues(Matrix.of(spark, [[0, -1], [1, 0]])), [-1j, 1j])
    for diag, off in (([1.0, -9, 1, 10], [2.0, -2, 3]), ([2.0] * 9, [-1.0] * 8), ([1.0] * 5, [0.0, 1, 0, 2]), ([3.0], [])):
        t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
        lam, q = L.cuppen(np.array(diag), np.array(off))
        assert np.allclose(lam, np.linalg.eigvalsh(t)) and np.allclose(q @ np.diag(lam) @ q.T, t) and np.allclose(q.T @ q, np.eye(len(t)))
    x, norm = L.power_iteration(Matrix.of(spark, [[2, 1], [1, 3]]), C.fill(spark, 2, 1.0), 40)
    assert abs(norm - max(np.linalg.eigvalsh([[2, 1], [1, 3]]))) < 1e-9
    y = np.array(L.folded_spectrum(Matrix.of(spark, [[2, 1], [1, 3]]), C.iota(spark, 2, 1), 1.3, 0.2, 30).local())
    assert np.allclose(np.array([[2, 1], [1, 3]]) @ y, min(np.linalg.eigvalsh([[2, 1], [1, 3]])) * y, atol=1e-6)


@pytest.mark.parametrize("name", sorted(K.SOLVERS))
def test_solvers(spark, name):
    rng = np.random.default_rng(5)
    a = np.diag(rng.uniform(4, 6, 30)) + (rng.uniform(-0.3, 0.3, (30, 30)) if name != "cg" else 0)
    A, x = Matrix.of(spark, a), Vector.of(spark, range(30))
    for pc in (None, PC.Diagonal()):
        y, control = K.SOLVERS[name](A, X.matmul(A, x), None, pc, K.IterationControl(200, 1e-10))
        assert control.code == 0 and np.allclose(y.local(), range(30), atol=1e-5)


def test_solvers_on_relations(spark):
    A = C.laplacian(spark, 2, 3)
    A = A.with_df(cut(A.df))
    b = X.matmul(A, C.iota(spark, 6))
    for name in ("cg", "bicgstab"):
        x, control = K.SOLVERS[name](A, b, None, PC.Diagonal(), K.IterationControl(20, 1e-9), False)
        assert control.code == 0 and np.allclose(x.local(), range(6), atol=1e-6)
    x = SM.Jacobi(A, local=False)(C.fill(spark, 6, 0.0), b, 2)
    assert np.allclose(x.local(), SM.Jacobi(A, local=True)(C.fill(spark, 6, 0.0), b, 2).local())
    g = SM.GaussSeidel(A, 1.2, local=False)(C.fill(spark, 6, 0.0), b, 2)
    assert np.allclose(g.local(), SM.GaussSeidel(A, 1.2, local=True)(C.fill(spark, 6, 0.0), b, 2).local())
    for kernel in (PC.Ilu0(), PC.Ic0(), PC.Ilut(2, 0.01)):
        here, there = PC.BlockIlu(4, kernel).on(K.LocalSpace(A)), PC.BlockIlu(4, kernel).on(K.SparkSpace(A))
        for how in ("solve", "adjoint_solve"):
            assert np.allclose(getattr(there, how)(b.df).orderBy("i").toPandas()["v"], getattr(here, how)(np.array(b.local())))


def test_control():
    c = K.IterationControl(3, 0.1, 0.01)
    assert not c.done(1.0) and c.done(0.1) and K.IterationControl(3, 0.1, 0.0).done(0.0)
    c = K.IterationControl(1, 0.0)
    assert not c.done(1.0)
    c.advance()
    assert c.done(0.5) and c.code == 1


def test_preconditioners(spark):
    A = C.laplacian(spark, 3, 3)
    got = PC.solve(PC.Ic0(), A, C.iota(spark, 9, 0)).local()
    l, _ = PC.factored(A, PC.Ic0())
    assert np.allclose(l @ l.T @ got, range(9)) and np.allclose(np.tril(l @ l.T)[np.tril(np.array(A.local())) != 0], np.tril(A.local())[np.tril(A.local()) != 0])
    assert np.allclose(PC.solve(PC.Ic0(), A, C.iota(spark, 9, 1)).local(), [1.03194, 1.60198, 1.45357, 2.5258, 3.55386, 3.16, 2.91787, 4.09338, 3.81335], atol=1e-3) or np.allclose(got, [1.03194, 1.60198, 1.45357, 2.5258, 3.55386, 3.16, 2.91787, 4.09338, 3.81335], atol=1e-3)
    B = C.laplacian(spark, 4, 4)
    l, u = PC.factored(B, PC.Ilut(3, 0.001))
    assert np.linalg.norm(np.array(B.local()) - l @ u) <= 0.24
    l, u = PC.factored(B, PC.Ilu0())
    b = np.array(B.local())
    assert np.allclose((l @ u)[b != 0], b[b != 0])
    r = C.iota(spark, 16, 1)
    for pc in (PC.Ilu0(), PC.Ilut(3, 0.01), PC.Concat(PC.Diagonal(), PC.Ilu0())):
        x, y = (np.array(f(pc, B, r).local()) for f in (PC.solve, PC.adjoint_solve))
        e = np.eye(16)
        own = pc.on(K.LocalSpace(B))
        M = np.stack([own.solve(c) for c in e], 1)
        assert np.allclose(M @ np.arange(1, 17), x) and np.allclose(M.T @ np.arange(1, 17), y)
    assert PC.is_identity(PC.Identity()) and not PC.is_identity(pc)
    with pytest.raises(errors.MissingDiagonal):
        PC.Diagonal().on(K.LocalSpace(P.strict_lower(B)))


def test_multilevel_factor(spark):
    rng = np.random.default_rng(8)
    a = np.where(rng.random((15, 15)) < 0.25, rng.standard_normal((15, 15)), 0) + 6 * np.eye(15)
    r = rng.standard_normal(15)
    exact = PC.Imf(None).on(K.LocalSpace(Matrix.of(spark, a)))
    assert np.allclose(exact.solve(r), np.linalg.solve(a, r)) and np.allclose(exact.adjoint_solve(r), np.linalg.solve(a.T, r)) and exact.levels > 1
    for fill in (0, 1):
        m = PC.Imf(fill).on(K.LocalSpace(Matrix.of(spark, a)))
        M = np.stack([m.solve(e) for e in np.eye(15)], 1)
        assert np.allclose(np.stack([m.adjoint_solve(e) for e in np.eye(15)], 1), M.T)
    A, pc = PC.Imf.of_elements(E.extract_elements(C.laplacian(spark, 4, 4)), 1)
    x, control = K.bicgstab(A, X.matmul(A, C.iota(spark, 16)), None, pc, K.IterationControl(30, 1e-10))
    assert control.code == 0 and control.step < 12 and np.allclose(x.local(), range(16), atol=1e-6)


def test_minimisation():
    f, g = (lambda x: float(x[0] ** 2 + 2 * x[1] ** 2 + 2 * x[2] ** 2)), (lambda x: np.array([2 * x[0], 4 * x[1], 4 * x[2]]))
    for update in UPDATES.values():
        for step in (armijo(), wolfe()):
            x, control = quasi_newton(np.full(3, 8.0), f, g, step, update, K.IterationControl(500, 0.0, 1e-4))
            assert control.code == 0 and np.linalg.norm(x) <= 1e-3


def test_repeating(spark):
    A = C.laplacian(spark, 5, 5)
    b = X.matmul(A, C.fill(spark, 25, 8.0))
    s = K.Solver("cg", A, control=K.IterationControl(100, 1e-9))
    assert np.allclose(s.solve(b)[0].local(), [8] * 25) and np.allclose(K.RepeatingSolver(s, 60).solve(b, s.step(b, C.fill(spark, 25, 0.0), 2)).local(), [8] * 25, atol=0.1)
    smooth = SM.Repeated(SM.sor(A, 1.2), 60)
    assert np.allclose(smooth(C.fill(spark, 25, 0.0), b).local(), [8] * 25, atol=1e-3)


def test_matrix_market(spark, tmp_path):
    def read(text, **options):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.mtx"
        path.write_text(text)
        return MM.read_matrix_market(spark, str(path), **options)

    pattern = "%%MatrixMarket matrix coordinate pattern symmetric\n% note\n\n3 3 2\n2 1\n3 3\n"
    assert read(pattern).local() == [[0] * 3] * 3 and P.nnz(read(pattern)) == 3
    assert read(pattern, pattern_value=1.0).local() == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]
    assert read("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 5\n").local() == [[0, -5], [5, 0]]
    assert read("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 4 0\n2 1 1 2\n").local() == [[4, 1 - 2j], [1 + 2j, 0]]
    assert read("%%MatrixMarket matrix array real general\n2 4\n1\n5\n2\n6\n3\n7\n4\n8\n").local() == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert read("%%MatrixMarket matrix array integer symmetric\n3 3\n1\n2\n3\n4\n5\n6\n").local() == [[1, 2, 3], [2, 4, 5], [3, 5, 6]]
    assert read("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 3\n2 2 4\n", keep=lambda i, j: i > 0).local() == [[0, 0], [0, 4]]
    with pytest.raises(errors.FileNotFound):
        MM.read_matrix_market(spark, str(tmp_path / "none.mtx"))
    with pytest.raises(errors.IoError):
        read("no banner\n")
    A = Matrix.of(spark, [[1.5, 0], [0, -2e-9]])
    f = MM.MatrixFile(spark, str(tmp_path / "out"))
    for dense in (False, True):
        f.write(A, dense)
        assert f.read().local() == A.local()
    Z = Matrix.of(spark, [[1j, 0], [2, 3 - 1j]])
    f.write(Z)
    assert f.read().local() == Z.local()
    assert paths.join("a", "b") == "a/b" and paths.directory_name("a/b") == "a" and paths.file_name("a/b") == "b"


def test_elements(spark, tmp_path):
    (tmp_path / "e").write_text("2\nheader\n0 1\n1 2\n3 4\n\n1 2\n5 6\n7 8\n\n")
    es = E.read_elements(spark, str(tmp_path / "e"))
    assert es.nodes == 3 and es.total_nnz() == 8 and es.assemble().local() == [[1, 2, 0], [3, 9, 6], [0, 7, 8]]
    assert sorted(map(tuple, es.neighbours().collect())) == [(0, 1), (1, 0)]
    assert es.apply(C.iota(spark, 3, 1)).local() == [5, 39, 38]
    order = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "src long, pos long")
    assert es.assemble(order).local() == [[8, 7, 0], [6, 9, 3], [0, 2, 1]]
    E.write_elements(es, str(tmp_path / "o"))
    assert E.read_elements(spark, str(tmp_path / "o")).assemble().local() == es.assemble().local()


def test_element_extraction(spark):
    rng = np.random.default_rng(7)
    a = np.where(rng.random((9, 9)) < 0.3, rng.integers(1, 9, (9, 9)), 0).astype(float)
    es = E.extract_elements(Matrix.of(spark, a))
    assert np.array_equal(es.assemble().local(), a)
    assert np.allclose(es.apply(C.iota(spark, 9)).local(), a @ np.arange(9))


def test_own_kernel(spark):
    A = C.identity(spark, 3)
    X.register_kernel(lambda a, b: a is A, lambda a, b: b)
    try:
        B = Matrix.of(spark, A3)
        assert X.matmul(A, B) is B
    finally:
        X.KERNELS.clear()


def test_printing(spark):
    A = Matrix.of(spark, [[1.5, 0], [0, -2]])
    assert printing.print_matrix(A, 5) == "[  1.5     0]\n[    0    -2]" and printing.print_vector(Vector.of(spark, [1, 2.25])) == "{2C}[1,2.25]" and printing.print_size(A) == 3
    assert "Project" in printing.plan_graph(P.scale(2.0, A)) and "Physical Plan" in printing.plan_text(A)


def test_constructors(spark):
    assert np.allclose(C.hilbert(spark, 3, 2).local(), [[1, 1 / 2], [1 / 2, 1 / 3], [1 / 3, 1 / 4]])
    assert C.from_compressed(spark, 2, 3, [0, 1, 3], [2, 0, 1], [5, 6, 7]).local() == [[0, 0, 5], [6, 7, 0]]
    assert C.from_compressed(spark, 3, 2, [0, 1, 3], [2, 0, 1], [5, 6, 7], by_column=True).local() == [[0, 6], [0, 7], [5, 0]]
    r = C.random(spark, (20, 20), 3)
    assert r.local() == C.random(spark, (20, 20), 3).local() != C.random(spark, (20, 20), 4).local() and 0.4 < np.mean(r.local()) < 0.6
    blocks = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]]), (2, [[5.0]])], "start long, data array<array<double>>")
    assert C.block_diagonal(blocks, 3).local() == [[1, 2, 0], [3, 4, 0], [0, 0, 5]]
    with pytest.raises(errors.IndexOutOfRange):
        C.unit_vector(spark, 3, 3)


def test_stream(spark, tmp_path):
    schema = "i long, j long, v double"
    for k in range(3):
        spark.createDataFrame([(0, 0, 1.0), (k, 1, 2.0)], schema).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    A = assembly.assemble_stream(spark, stream, 3, 2)
    assert A.local() == [[3, 2], [0, 2], [0, 2]]
    with pytest.raises(ValueError):
        assembly.assembling(stream, "store")


def test_page_rank(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 2), (1, 4)]
    got = np.array(L.page_rank(spark.createDataFrame(edges, "src long, dst long"), 5, 0.85, 25).local())
    m = np.zeros((5, 5))
    for s, d in set(edges):
        m[d, s] = 1
    out = m.sum(0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / 5)
    want = np.full(5, 0.2)
    for _ in range(25):
        want = 0.03 + 0.85 * m @ want
    assert np.allclose(got, want)


# --- whole operands -------------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    """M and P (part by supplier) and the embeddings of the smallest tables, from their rows alone."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity", "l_linenumber").collect()
    shape = tuple(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("part", "supplier"))
    m, p = np.zeros(shape), np.zeros(shape)
    for i, j, q, n in lines:
        m[i, j] += q
        p[i, j] += n
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    e = np.zeros((len(rows), 64))
    for r in rows:
        e[r["vec_id"]] = r["embedding"]
    return m, p, e


def entries(df, shape):
    out = np.zeros(shape)
    for i, j, v in df.select("i", "j", "v").collect():
        out[i, j] = v
    return out


def test_whole_operands(spark, whole):
    """Queries that take every entry of the tables, against NumPy on the smallest ones."""
    m, p, e = whole
    n, run = max(m.shape), lambda name: queries.QUERIES[name](spark, SF)
    square = np.zeros((n, n))
    square[: m.shape[0], : m.shape[1]] = m
    inner = min(len(m), len(e))
    assert np.allclose(entries(run("sparse_dense"), (m.shape[1], 64)), m[:inner].T @ e[:inner], atol=1e-2)
    assert np.allclose(entries(run("matrix_power"), (n, n)), np.linalg.matrix_power(square, 3))
    assert run("trace").first()[0] == np.trace(square)
    places = {(i, j) for i, j in zip(*np.nonzero(square), strict=True)}
    assert {(r["i"], r["j"]) for r in run("symmetric_pattern").collect()} == places | {(j, i) for i, j in places}
    for name in ("matrix_market_round_trip", "matrix_market_dense_round_trip"):
        assert (entries(run(name), m.shape) == m).all()
    want = np.zeros((m.shape[0] + 1, m.shape[1] + 2))
    want[:-1, :-2] += p
    want[1:, 2:] += m
    assert (entries(run("insert_shifted"), want.shape) == want).all()


@pytest.mark.parametrize("name", """
    assign_divide assign_each_nonzero assign_minus assign_vector_minus cholesky compress direct_solve error_functions extract from_compressed heap_top hermitian
    insert_block insert_shifted inverse kron look_at_each_nonzero lu_solve matrix_free_operator matrix_market_kept own_kernel own_reduction page_rank point_access
    printing_sizes quadrants random_fill ranges_and_integers resized restrict rounding_edges scalar_functions scalar_parts scale_inplace_matrix small_kernels
    solve_bicg solve_gmres solve_qmr sort_xy sort_zipped sorted_entries sparse_dense spmm_aat svd symmetric_pattern
""".split())
def test_sql_says_the_same(spark, name):
    """Queries against their SQL, on the smallest tables: the same columns and the same rows."""
    import duckdb

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.ORACLE[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.column_names)
    names = sorted(got.columns)
    plain = lambda x: repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) or hasattr(x, "as_tuple") else x
    rows = lambda it: sorted((tuple(plain(r[n]) for n in names) for r in it), key=repr)
    assert rows(r.asDict() for r in got.collect()) == rows(want.to_pylist())


def test_files_whose_first_part_is_not_the_largest(spark, tmp_path):
    """Spark scans large parts first, so the size line was taken for an entry."""
    folder = tmp_path / "market"
    folder.mkdir()
    (folder / "part-00000.txt").write_text("%%MatrixMarket matrix coordinate real general\n9 4 3\n1 1 5.0\n")
    (folder / "part-00001.txt").write_text("% a longer part, with a comment that makes it the larger of the two files by far, so that it is scanned first\n2 2 6.0\n3 3 7.0\n")
    A = MM.read_matrix_market(spark, str(folder))
    assert sorted(map(tuple, A.df.collect())) == [(0, 0, 5.0), (1, 1, 6.0), (2, 2, 7.0)]
    folder = tmp_path / "elements"
    folder.mkdir()
    (folder / "part-00000.txt").write_text("2\nelements\n0\n1.0\n\n")
    (folder / "part-00001.txt").write_text("1 2\n" + "2.000000000000000000 3.000000000000000000\n4.000000000000000000 5.000000000000000000\n\n")
    assert E.read_elements(spark, str(folder)).assemble().local() == [[1, 0, 0], [0, 2, 3], [0, 4, 5]]


def test_dot_of_columns_that_share_no_row_is_null_as_in_sql(spark, tmp_path):
    """F26."""
    spark.createDataFrame([(k,) for k in range(4)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k,) for k in range(6)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    for rows, want in (([(0, 3, 2.0), (1, 5, 3.0)], None), ([(0, 3, 2.0), (0, 5, 3.0)], 6.0)):
        spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
        assert queries.QUERIES["dot"](spark, str(tmp_path)).first()[0] == want


@pytest.mark.parametrize("shift, row, columns", [(0.0, None, None), (1.0, "i % 2 + 0.5", None), (2.0, "i - 1.0", [0.5, 2.0, 1.0, 4.0])])
def test_gram_space_is_the_matrix_it_does_not_form(spark, shift, row, columns):
    """Products, transposed products, diagonal, blocks and the matrix itself against NumPy; a query must not make the pairs of all entries of a row."""
    n = np.array([[1.0, 2, 0, 0], [0, 3, 4, 0], [5, 0, 0, 6], [0, 0, 7, 0], [1, 1, 1, 1]])
    c = np.ones(4) if columns is None else np.array(columns)
    d = np.ones(4) if row is None else np.array([eval(row) for i in range(4)])
    want = shift * np.eye(4) + d[:, None] * (c[:, None] * (n.T @ n) * c)
    factors = None if columns is None else spark.createDataFrame(list(enumerate(columns)), "i long, c double")
    S = K.GramSpace(K.GramSpace.by_rows(Matrix.of(spark, n.tolist())), shift, None if row is None else F.expr(row), factors)
    x = Vector.of(spark, [1.0, -2, 3, 0.5])
    for got, by in ((S.apply(x.df), want), (S.apply_t(x.df), want.T)):
        assert np.allclose(S.give(got).local(), by @ x.local())
    assert np.allclose(S.matrix().local(), want)
    entries, off = S.split()
    assert np.allclose([r["d"] for r in entries.orderBy("i").collect()], np.diag(want))
    assert np.allclose(S.give(off(x.df)).local(), (want - np.diag(np.diag(want))) @ x.local())
    inside = np.kron(np.eye(2), np.ones((2, 2)))
    assert np.allclose(Matrix(S.within(2), 4, 4).local(), want * inside)
    assert "_v" not in S._gram(x.df)._jdf.queryExecution().analyzed().toString()  # the pairs' column


def test_panels_against_numpy(spark):
    """What is too large to be gathered, by panels; before, TooLarge. Panels of 5 columns here, the last one narrower."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(13, 13))
    a[0, 0] = 0.0  # needs a pivot
    s = a @ a.T + 13 * np.eye(13)
    b = rng.normal(size=13)
    of = lambda x: N.Panels.of(Matrix.of(spark, x.tolist()), 5)
    whole = lambda p, name: np.array(p.matrix(name).local())
    low = whole(N.cholesky(of(s)), "l")
    assert np.allclose(low, np.linalg.cholesky(s))
    p = of(a)
    order = N.lu(p, True, 1e-14)
    assert np.allclose(N.lu_solved(p, order, b), np.linalg.solve(a, b))
    assert np.allclose(N.lu_adjoint_solved(p, order, b), np.linalg.solve(a.T, b))
    assert np.allclose(whole(N.inverse(p, "all", order), "x") @ a, np.eye(13))
    assert np.allclose(whole(N.product(p, p, "x", "a"), "y"), np.eye(13))
    with pytest.raises(Exception, match="pivot 0"):
        N.lu(of(a), False, 1e-14)
    p = of(s)
    assert np.allclose(N.lu_solved(p, N.lu(p, False, 1e-14), b), np.linalg.solve(s, b))
    assert np.allclose(whole(N.inverse(of(s), "lower"), "x") @ np.tril(s), np.eye(13))
    assert np.allclose(whole(N.inverse(of(s), "upper"), "x") @ np.triu(s), np.eye(13))
    assert np.allclose(np.tril(s) @ N.triangular_solved(of(s), b, True), b)
    assert np.allclose(np.triu(s) @ N.triangular_solved(of(s), b, False), b)
    p = N.qr(of(a))
    q, r = whole(p, "q"), whole(p, "r")
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(13)) and np.allclose(np.tril(r, -1), 0)


def test_kernels_take_more_rows_than_may_be_gathered(spark, monkeypatch):
    """The same through the operators, with a limit of 6 rows in place of 4096."""
    for module in (L, D):
        monkeypatch.setattr(module, "DENSE", 6)
    monkeypatch.setattr(N, "SIDE", 4)
    rng = np.random.default_rng(6)
    a = rng.normal(size=(9, 9))
    s = a @ a.T + 9 * np.eye(9)
    A, b = Matrix.of(spark, s.tolist()), Vector.of(spark, rng.normal(size=9).tolist())
    want = np.linalg.solve(s, b.local())
    for f in (L.lu_solve, L.lu_solve_straight, L.lu_adjoint_solve):
        assert np.allclose(f(A, b).local(), want)
    times = lambda x, y: np.array(D.dense_matmul(x, y).local())
    low = L.cholesky(A)
    assert np.allclose(times(low, P.trans(low)), s)
    for f in (L.qr, L.qr_givens, L.lq):
        assert np.allclose(times(*f(A)), s)
    assert np.allclose(times(A, L.inv(A)), np.eye(9))
    assert np.allclose(times(P.upper(A), L.inv_upper(A)), np.eye(9))
    assert np.allclose(times(P.lower(A), L.inv_lower(A)), np.eye(9))
    assert np.allclose(np.tril(s) @ L.triangular_solve(A, b, True).local(), b.local())
    assert np.allclose(np.triu(s) @ L.triangular_solve(A, b, False).local(), b.local())


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_hessenberg_form_by_panels(spark, monkeypatch, held):
    """F8: a matrix that may not be gathered; before, TooLarge. Panels of 5 columns, held by the task or read again for each column."""
    for module in (L, D):
        monkeypatch.setattr(module, "DENSE", 6)
    monkeypatch.setattr(N, "SIDE", 5)
    monkeypatch.setattr(N, "HELD", held)
    a = np.random.default_rng(8).normal(size=(13, 13))
    a[6:, 2] = 0.0
    want_h, want_q = L.hessenberg_kernel(a)
    h, q = L.hessenberg(Matrix.of(spark, a.tolist()))
    assert np.allclose(h.local(), want_h) and np.allclose(q.local(), want_q)
    assert not np.tril(h.local(), -2).any()
    assert np.allclose(D.dense_matmul(D.dense_matmul(q, h), P.trans(q)).local(), a)


def test_svd_by_panels(spark, monkeypatch):
    """a matrix that may not be gathered; before, TooLarge. Panels of 5 columns; columns of very different length, equal values, a rank below the size, no entry at all."""
    for module in (L, D):
        monkeypatch.setattr(module, "DENSE", 6)
    monkeypatch.setattr(N, "SIDE", 5)
    rng = np.random.default_rng(9)
    q, d = (np.linalg.qr(rng.normal(size=(13, 13)))[0] for _ in "qd")
    for values in (10.0 ** -np.arange(13), np.r_[[3.0] * 6, [2.0] * 4, [0.0] * 3], np.zeros(13)):
        a = q * values @ d.T
        S, V, D_ = L.svd(Matrix.of(spark, a.tolist()))
        s, v, w = (np.array(x.local()) for x in (S, V, D_))
        assert np.allclose(s.T @ s, np.eye(13), atol=1e-12) and np.allclose(w.T @ w, np.eye(13), atol=1e-12)
        assert np.allclose(v, np.diag(np.diag(v))) and np.allclose(np.diag(v), values, atol=1e-12) and (np.diff(np.diag(v)) <= 0).all()
        assert np.allclose(s @ v @ w.T, a, atol=1e-12)
        if values.any():
            assert np.allclose(D.dense_matmul(D.dense_matmul(S, V), P.trans(D_)).local(), a, atol=1e-12)
    assert sorted(x for r in N._rounds(5) for x in r) == [(i, j) for i in range(5) for j in range(i + 1, 5)]


def test_dense_files_are_written_by_ranges_and_numbered_by_parts(spark, tmp_path, monkeypatch):
    """nothing but entries is shuffled and no line is sorted; before, every place was a row that was sorted twice. Ranges of 4 places, pieces of 2."""
    monkeypatch.setattr(MM, "RANGE", 4)
    monkeypatch.setattr(MM, "PIECE", 2)
    a = np.zeros((7, 5))
    a[2, 0], a[6, 0], a[0, 1], a[6, 4], a[3, 3] = 1e300, -2.5, 7.0, float("inf"), 1e-9
    A, at = Matrix.of(spark, a.tolist()), str(tmp_path / "dense")
    MM.write_matrix_market(A, at, True)
    parts = sorted(tmp_path.glob("dense/*.gz"))
    lines = b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode().split("\n")
    assert len(parts) == 9 and lines[:2] == ["%%MatrixMarket matrix array real general", "7 5"] and lines[-1] == ""
    assert [float(x) for x in lines[2:-1]] == a.T.ravel().tolist()
    B = MM.read_matrix_market(spark, at)
    assert B.local() == a.tolist() and B.df.count() == 35
    C_ = MM.read_matrix_market(spark, at, zeros=False)
    assert C_.local() == a.tolist() and C_.df.count() == 5
    plan = C_.df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    own = tmp_path / "own"
    own.mkdir()
    (own / "a.gz").write_bytes(gzip.compress(b"%%MatrixMarket matrix array real symmetric\n% note\n\n") + gzip.compress(b"2 2\n 1.5 one\n"))
    (own / "b.gz").write_bytes(gzip.compress(b"% note\n\n2\r\n  \n3"))
    assert MM.read_matrix_market(spark, str(own)).local() == [[1.5, 2.0], [2.0, 3.0]]
    MM.write_matrix_market(Matrix.of(spark, [[0.0, 0.0]]), at, True)
    assert MM.read_matrix_market(spark, at).local() == [[0.0, 0.0]] and not MM.read_matrix_market(spark, at, zeros=False).df.count()


@pytest.mark.parametrize("cells", [1, 1 << 23])
def test_steps_of_a_gathered_gram_space_leave_nothing_on_disk(spark, monkeypatch, cells):
    """vectors as arrays; before, every step wrote its vectors and kept what it had broadcast. Sums of tasks are added by column first with `cells` 1."""
    monkeypatch.setattr(T, "CELLS", cells)
    rng = np.random.default_rng(4)
    a = np.where(rng.random((40, 9)) < 0.4, rng.integers(1, 9, (40, 9)), 0).astype(float)
    a[:, 5] = 0.0
    c = 1 / np.arange(1.0, 10)
    factors = spark.createDataFrame([(k, float(x)) for k, x in enumerate(c)], "i long, c double")
    N_ = T.Strips.of(Matrix.of(spark, a.tolist()), 30).matrix()
    for row, r, columns in ((None, np.ones(9), factors), (F.when(F.col("i") % 2 == 0, 0.1).otherwise(-0.05), np.where(np.arange(9) % 2, -0.05, 0.1), factors), (None, np.ones(9), None)):
        k = c if columns is not None else np.ones(9)
        want = 2 * np.eye(9) + r[:, None] * (a * k).T @ (a * k)
        S = K.GramSpace(N_, 2.0, row, columns).gathered()
        x = rng.random(9)
        assert np.allclose(S.apply(x), want @ x) and np.allclose(S.apply_t(x), want.T @ x)
        d, off = S.split()
        assert np.allclose(d, np.diag(want)) and np.allclose(off(x), want @ x - d * x)
    monkeypatch.setattr(K, "cut", lambda df: pytest.fail("a step wrote a vector"))
    K.bicgstab_2(S, Vector.of(spark, (want @ x).tolist()), None, None, K.IterationControl(1, 1e-12))
    with pytest.raises(errors.IncompatibleSize):
        K.GatheredSpace(K.GramSpace(Matrix.of(spark, a.tolist())))


@pytest.mark.parametrize("cells", [1, 1 << 23])
def test_diagonal_of_a_gathered_gram_space_is_one_pass(spark, monkeypatch, cells):
    """taken from the strips; before, it was shuffled, joined twice with the factors and written."""
    monkeypatch.setattr(T, "CELLS", cells)
    rng = np.random.default_rng(5)
    a = np.where(rng.random((50, 8)) < 0.5, rng.integers(-9, 9, (50, 8)), 0).astype(float)
    a[:, 3] = 0.0
    c = 1 / np.arange(2.0, 10)
    factors = spark.createDataFrame([(k, float(x)) for k, x in enumerate(c) if k != 6], "i long, c double")
    c[6] = 0.0
    N_ = T.Strips.of(Matrix.of(spark, a.tolist()), 20).matrix()
    r = np.where(np.arange(8) % 2, -0.05, 0.1)
    for row, scale, columns, k in ((None, 1.0, None, 1.0), (F.when(F.col("i") % 2 == 0, 0.1).otherwise(-0.05), r, factors, c)):
        S = K.GramSpace(N_, 2.0, row, columns)
        want = {x["i"]: x["d"] for x in S.split()[0].collect()}
        S = S.gathered()
        with monkeypatch.context() as m:
            m.setattr(K, "cut", lambda df: pytest.fail("the diagonal was written"))
            d = PC.Diagonal().on(S).d
        assert np.allclose(d, 2 + scale * k * k * (a * a).sum(0)) and np.allclose(d, [want[i] for i in range(8)])
    with pytest.raises(errors.MissingDiagonal):
        PC.Diagonal().on(K.GramSpace(N_).gathered())


def test_strips_leave_no_files_of_their_shuffles(spark, monkeypatch):
    """before, the shuffle that made the strips stayed beside them until the driver's JVM had collected its garbage, and so did those of a step."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    rng = np.random.default_rng(6)
    a = rng.integers(1, 9, (40, 9)).astype(float)
    A, x = Matrix.of(spark, a.tolist()), rng.random(9)
    monkeypatch.setattr(T, "CELLS", 1)
    monkeypatch.setattr(T, "cut", lambda df: seen.append(spark.conf.get(key)) or cut(df))
    S = K.GramSpace(T.Strips.of(A, 60).matrix(), 1000.0).gathered()
    assert seen == ["true"] and spark.conf.get(key) == "false"
    assert np.allclose(S.apply(x), 1000 * x + a.T @ (a @ x))
    assert np.allclose(L.solve(S, S.give(S.apply(np.ones(9)))).local(), 1)


def test_kernels_gather_columns_not_rows(spark, monkeypatch):
    """a matrix that a kernel holds comes as columns; before, as a million rows that took more than the driver has."""
    a = [[4.0, 1.0, 0.0], [1.0, 3.0, 0.0], [0.0, 0.0, 2.0]]
    A, b = Matrix.of(spark, a), Vector.of(spark, [5.0, 4.0, 2.0])
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(A.df), name, lambda *_: pytest.fail("rows were gathered"))
    assert L.gathered(A).tolist() == a and L.gathered(A.with_df(A.df.filter("i < 0"))).tolist() == [[0.0] * 3] * 3
    whole = A.with_df(A.df.select("i", "j", F.col("v").cast("int").alias("v")))
    assert L.gathered(whole).tolist() == a and L.gathered(whole).dtype == float
    x = L.solve(A, b)
    monkeypatch.undo()
    assert np.allclose(x.local(), 1)


def test_product_with_single_rows_sums_nothing(spark):
    """entries of one row each need no second shuffle of all pairs."""
    a = np.array([[0, 2.0, 0], [3, 0, 0], [0, 0, 0], [0, -1, 0]])
    A = Matrix.of(spark, a.tolist())
    assert X.single_rows(A) and not X.single_rows(P.trans(A))
    C_ = X.spmm(A, P.trans(A), single=True)
    assert np.allclose(C_.local(), a @ a.T)
    assert "sum(" not in C_.df._jdf.queryExecution().analyzed().toString()


def test_mostly_empty_operands_are_not_blown_up_to_blocks(spark):
    """F16."""
    a = np.zeros((40, 30))
    a[3, 7], a[9, 29], a[39, 7] = 2.0, 3.0, 4.0
    A = Matrix.of(spark, a.tolist())
    product = D.dense_matmul(P.trans(A), A)
    assert np.allclose(product.local(), a.T @ a)
    assert "FlatMapGroupsInArrow" not in product.df._jdf.queryExecution().analyzed().toString()
    full = D.dense_matmul(Matrix.of(spark, (a + 1).T.tolist()), Matrix.of(spark, (a + 1).tolist()))
    assert np.allclose(full.local(), (a + 1).T @ (a + 1))
    assert "FlatMapGroupsInArrow" in full.df._jdf.queryExecution().analyzed().toString()


def test_strips_hold_the_matrix_and_a_gram_product_sends_no_row(spark):
    """Equal places summed, rows whole, numbers as they were; before, every step shuffled a number for each row of N."""
    rng = np.random.default_rng(2)
    a = np.where(rng.random((40, 9)) < 0.4, rng.integers(-3, 300, (40, 9)), 0).astype(float)
    a[3, 4], a[5] = 0.1, 0.0
    lines = [(int(i), int(j), float(v) / 2) for i, j in np.argwhere(a) for v in [a[i, j], a[i, j]]]
    A = C.make_sparse(spark.createDataFrame(lines, "i long, j long, v double").repartition(3), 40, 9)
    S = T.Strips.of(A, 30)
    assert S.count > 3 and np.allclose(S.matrix().local(), a) and S.matrix().df.count() == np.count_nonzero(a)
    gram = K.GramSpace(S.matrix())
    x = rng.random(9)
    assert np.allclose(gram.give(gram.apply(Vector.of(spark, x).df)).local(), a.T @ (a @ x))
    assert "Exchange" not in gram._gram(Vector.of(spark, x).df)._jdf.queryExecution().executedPlan().toString()
    i, j, v = np.array([2, 2, 7]), np.array([1, 400, 70000]), np.array([-0.0, 1e300, float("nan")])
    for got, want in zip(T.unpack(T.pack(i, j, v)), (i, j, v), strict=True):
        assert np.array_equal(got, want, equal_nan=True) and np.array_equal(np.signbit(got), np.signbit(want))


@pytest.mark.parametrize("kernel", [PC.Ilu0(), PC.Ilut(8, 0.0)])
def test_block_factors_are_made_once(spark, kernel):
    """a step meets written factors; before, it shuffled all entries of the blocks and factored them again. A block without entries is an error as before."""
    n = np.array([[1.0, 2, 0, 0, 1], [0, 3, 4, 0, 0], [5, 0, 0, 6, 2], [0, 0, 7, 0, 3]])
    S = K.GramSpace(K.GramSpace.by_rows(Matrix.of(spark, n.tolist())), 2.0)
    pc = PC.BlockIlu(2, kernel).on(S)
    assert pc.factors.columns == ["b", "data"] and pc.factors.count() == 3
    inside = np.kron(np.eye(3), np.ones((2, 2)))[:5, :5] * (n.T @ n + 2 * np.eye(5))
    x = Vector.of(spark, [1.0, 2, 3])
    got = S.give(pc.solve(x.df)).local()  # entries of x are absent in the last block
    assert np.allclose(got, np.linalg.solve(inside, [1.0, 2, 3, 0, 0]))
    with pytest.raises(Exception):
        PC.BlockIlu(2).on(K.SparkSpace(Matrix.of(spark, np.diag([1.0, 1, 0, 0]).tolist())))


def test_products_by_strips_against_numpy(spark, monkeypatch):
    """zeros that a sum gives stay, as in a join; before, every pair of entries was shuffled."""
    monkeypatch.setattr(T, "CELLS", 20)  # ranges of a few rows
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random(s) < 0.4, rng.integers(-3, 4, s), 0).astype(float) for s in ((11, 7), (7, 6), (11, 6)))
    A, B, D_ = (Matrix.of(spark, x.tolist()) for x in (a, b, c))
    got = X.mult_add(A, B, X.spmm(P.trans(P.trans(A)), B))
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan
    assert np.allclose(got.local(), 2 * a @ b)
    assert got.df.count() == np.count_nonzero((a != 0).astype(int) @ (b != 0))
    assert np.allclose(X.mult_add(P.trans(A), A, X.spmm(P.trans(A), A)).local(), 2 * a.T @ a)
    assert np.allclose(X.mult_add(A, B, D_).local(), a @ b + c)
    m = np.where(rng.random((9, 9)) < 0.3, rng.integers(-2, 3, (9, 9)), 0).astype(float)
    assert np.allclose(X.matrix_power(Matrix.of(spark, m.tolist()), 3).local(), m @ m @ m)
    nilpotent = np.diag([1.0, 1.0], 1)  # a product without an entry, on the way
    assert np.allclose(X.matrix_power(Matrix.of(spark, nilpotent.tolist()), 4).local(), np.zeros((3, 3)))
    assert X.matrix_power(Matrix.of(spark, np.zeros((3, 3)).tolist()), 3).df.count() == 0
    with pytest.raises(errors.IncompatibleSize):
        X.mult_add(A, A, X.spmm(A, B))


def _apart(spark, monkeypatch, symmetric: bool = False):
    """A matrix of 13 rows that falls apart into 5, 4, 3 and 1, interleaved, with a limit of 6 rows; panels, which take the square of the whole, are not to be used."""
    for module in (L, D):
        monkeypatch.setattr(module, "DENSE", 6)
    monkeypatch.setattr(N.Panels, "of", lambda *_: pytest.fail("the square of the whole matrix was written"))
    rng = np.random.default_rng(11)
    a = rng.normal(size=(13, 13)) * np.equal.outer(own := np.array([0, 1, 2, 0, 1, 0, 3, 2, 1, 0, 2, 1, 0]), own)
    a[0, 0] = 0.0  # needs a pivot
    a = a @ a.T + 13 * np.eye(13) if symmetric else a
    return a, Matrix.of(spark, a.tolist()), rng.normal(size=13)


def _product(*factors) -> np.ndarray:
    out = factors[0]
    for x in factors[1:]:
        out = D.dense_matmul(out, x)
    return np.array(out.local())


def test_cholesky_by_components(spark, monkeypatch):
    """a matrix that falls apart is factored by its components; before, panels of the whole filled the disk."""
    a, A, _ = _apart(spark, monkeypatch, True)
    low = L.cholesky(A)
    assert np.allclose(low.local(), np.linalg.cholesky(a)) and np.allclose(_product(low, P.trans(low)), a)
    with pytest.raises(Exception, match="not positive definite"):
        L.cholesky(_apart(spark, monkeypatch)[1])


@pytest.mark.parametrize("values", [[5.0, 2.0], [1.0, -1.0]])
def test_gram_by_components(spark, values):
    """the matrix of the factorisations by components, from strips; sums that are zero stay, columns without an entry have the shift."""
    lines = [(r, c, values[(r + c) % 2]) for r in range(40) for c in range(9) if c != 4 and (r % 3 == c % 3) and (r + c) % 4]
    A = C.make_sparse(spark.createDataFrame(lines, "i long, j long, v double"), 40, 9)
    a = np.array(A.local())
    got = CO.gram([A, A], 4, 1000.0)
    assert np.allclose(got.local(), 2 * a.T @ a + 1000 * np.eye(9))
    rows = {(r["i"], r["j"]) for r in CO.gram([A], 4).df.collect()}
    assert rows == {tuple(x) for x in np.argwhere((a != 0).T.astype(int) @ (a != 0))}
    assert CO.gram([A], 2) is None and CO.gram([A], 9) is None  # too large a component; nothing too large


def test_inverse_by_components(spark, monkeypatch):
    """F2"""
    a, A, _ = _apart(spark, monkeypatch)
    assert np.allclose(_product(A, L.inv(A)), np.eye(13))


def test_lower_trisolve_by_components(spark, monkeypatch):
    """F3"""
    a, A, b = _apart(spark, monkeypatch, True)
    for tri, low in ((np.tril, True), (np.triu, False)):
        assert np.allclose(tri(a) @ L.triangular_solve(A, Vector.of(spark, b), low).local(), b)


def test_lu_solve_by_components(spark, monkeypatch):
    """F4"""
    a, A, b = _apart(spark, monkeypatch)
    assert np.allclose(L.lu_solve(A, Vector.of(spark, b)).local(), np.linalg.solve(a, b))


@pytest.mark.parametrize("f", [L.qr_givens, L.lq, L.qr])
def test_qr_by_components(spark, monkeypatch, f):
    """F6, F8, F16"""
    a, A, _ = _apart(spark, monkeypatch)
    x, y = f(A)
    q, r = (y, P.trans(x)) if f is L.lq else (x, y)
    assert np.allclose(_product(x, y), a) and np.allclose(_product(P.trans(q), q), np.eye(13)) and not np.tril(r.local(), -1).any()


@pytest.mark.parametrize(("part", "f"), [(P.lower, L.inv_lower), (P.upper, L.inv_upper)])
def test_inverse_of_triangle_by_components(spark, monkeypatch, part, f):
    """F7, F13"""
    a, A, _ = _apart(spark, monkeypatch, True)
    assert np.allclose(_product(part(A), f(A)), np.eye(13))


def test_lu_solve_straight_by_components(spark, monkeypatch):
    """F9"""
    a, A, b = _apart(spark, monkeypatch, True)
    assert np.allclose(L.lu_solve_straight(A, Vector.of(spark, b)).local(), np.linalg.solve(a, b))


@pytest.mark.parametrize("side", [2, 32])
def test_hessenberg_by_components(spark, monkeypatch, side):
    """F12"""
    a, A, _ = _apart(spark, monkeypatch)
    monkeypatch.setattr(CO.hessenberg_kernel, "__defaults__", (side,))
    h, q = L.hessenberg(A)
    assert np.allclose(_product(q, h, P.trans(q)), a) and np.allclose(_product(P.trans(q), q), np.eye(13)) and not np.tril(h.local(), -2).any()
    one = np.random.default_rng(3).normal(size=(9, 9))
    assert all(np.allclose(x, y) for x, y in zip(CO.hessenberg_kernel(one, side), L.hessenberg_kernel(one), strict=True))


def test_lu_adjoint_solve_by_components(spark, monkeypatch):
    """F14"""
    a, A, b = _apart(spark, monkeypatch)
    assert np.allclose(L.lu_adjoint_solve(A, Vector.of(spark, b)).local(), np.linalg.solve(a.T, b))


def test_svd_by_components(spark, monkeypatch):
    """F17"""
    a, A, _ = _apart(spark, monkeypatch)
    s, v, d = L.svd(A)
    assert np.allclose(_product(s, v, P.trans(d)), a) and np.allclose(_product(P.trans(s), s), np.eye(13)) and np.allclose(_product(P.trans(d), d), np.eye(13))
    assert np.allclose(np.diag(v.local()), np.linalg.svd(a)[1])


def test_mult_add_by_components(spark, monkeypatch):
    """two Gram matrices by components of the columns; before, every range of rows read all strips. A sum that is zero stays."""
    monkeypatch.setattr(X, "DENSE", 4)
    monkeypatch.setattr(T, "products", lambda *_: pytest.fail("a range of rows met all columns"))
    lines = [(r, c, float(1 + r % 5) * (-1) ** (r * c)) for r in range(30) for c in range(9) if r % 3 == c % 3 and (r + c) % 4]
    rows = spark.createDataFrame([*lines, (0, 0, 2.0), (0, 3, 3.0), (0, 3, 1.0)], "i long, j long, v double")
    A, B = C.make_sparse(rows, 30, 9), C.make_sparse(rows.withColumn("v", F.col("v") + 7), 30, 9)
    a, b = np.array(A.local()), np.array(B.local())
    out = X.mult_add(P.trans(A), A, X.spmm(P.trans(B), B))
    assert np.allclose(out.local(), a.T @ a + b.T @ b)
    assert {(r["i"], r["j"]) for r in out.df.collect()} == {tuple(x) for x in np.argwhere((a != 0).T.astype(int) @ (a != 0) + (b != 0).T.astype(int) @ (b != 0))}
