"""Functions of small matrices on hard inputs: defective, singular, complex, near one another."""

import math

import numpy as np
import pytest

from gridloom.operators import batched
from gridloom.operators.identity import I, Identity
from gridloom.operators.matrix import Matrix

RNG = np.random.default_rng(1)


def _kinds(n):
    return [RNG.normal(size=(n, n)), np.roll(np.eye(n), 1, axis=1) + 0.01 * RNG.normal(size=(n, n)), np.triu(np.ones((n, n))), np.zeros((n, n)), np.ones((n, n))]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 40])
def test_real_schur(n):
    for a in _kinds(n):
        made = batched.schur_real(a)
        t, q = made["T"], made["Q"]
        assert np.allclose(q @ t @ q.T, a, atol=1e-9) and np.allclose(q.T @ q, np.eye(n), atol=1e-10)
        blocks = [k for k in range(n - 1) if batched.is_schur_block(t, k)]
        assert not np.tril(t, -2).any() and all(k + 1 not in blocks for k in blocks)
        assert all(t[k, k + 1] * t[k + 1, k] < 0 and abs(t[k, k] - t[k + 1, k + 1]) < 1e-9 for k in blocks)


@pytest.mark.parametrize("shape", [(4, 4), (9, 4), (4, 9), (1, 3), (5, 1)])
def test_pivoted_qr(shape):
    for a in (RNG.normal(size=shape), np.ones(shape), RNG.normal(size=shape) + 1j * RNG.normal(size=shape)):
        made = batched.qr_pivoted(a)
        d = np.abs(np.diag(made["R"]))
        assert np.allclose(a @ made["P"], made["Q"] @ made["R"]) and np.allclose(made["Q"].conj().T @ made["Q"], np.eye(shape[0]))
        assert (np.diff(d) <= 1e-9).all() and not np.tril(made["R"], -1).any()


def test_roots_and_logarithms_without_a_basis_of_eigenvectors():
    a = np.array([[4.0, 1.0, 0.0], [0.0, 4.0, 1.0], [0.0, 0.0, 4.0]])
    root, log = batched.sqrtm(a), batched.logm(a)
    assert np.allclose(root @ root, a) and np.allclose(batched.expm(log), a)
    assert np.allclose(np.diag(root), 2) and np.allclose(np.diag(log), math.log(4))
    assert np.allclose(np.linalg.matrix_power(batched.powm(a, 1 / 3), 3), a) and np.allclose(batched.powm(a, -2), np.linalg.inv(a @ a))
    assert np.allclose(batched.powm(a, 2.5), a @ a @ root) and np.allclose(batched.logm(a, 2.0), log / math.log(2))
    with pytest.raises(ArithmeticError):
        batched.funm(a, np.exp)
    with pytest.raises(ArithmeticError):
        batched.powm(np.diag([-1.0, 2.0]), 0.5)
    b = np.array([[1.0, 2.0], [0.0, 3.0]])
    assert np.allclose(batched.funm(b, np.exp), batched.expm(b))


def test_decompositions_by_what_the_matrix_is():
    spd, square, tall = np.array([[4.0, 1.0], [1.0, 3.0]]), np.array([[0.0, 2.0], [1.0, 1.0]]), RNG.normal(size=(6, 3))
    b = RNG.normal(size=(2, 3))
    for a, kind in ((spd, "cholesky"), (square, "lu")):
        made = batched.Decomposition.of(a)
        assert made.kind == kind and abs(made.det() - np.linalg.det(a)) < 1e-12
        assert np.allclose(a @ made.solve(b), b) and np.allclose(a.T @ made.solve(b, transposed=True), b)
    made = batched.Decomposition.of(tall)
    assert made.kind == "qr" and np.allclose(made.solve(np.ones((6, 1))), np.linalg.lstsq(tall, np.ones((6, 1)), rcond=None)[0])
    with pytest.raises(ValueError):
        made.det()
    with pytest.raises(np.linalg.LinAlgError):
        batched.Decomposition.of(np.array([[1.0, 2.0], [2.0, 4.0]])).solve(np.ones((2, 1)))
    assert batched.Decomposition.of(np.ones((2, 2))).rcond(2.0) == 0.0


def test_conditions_are_near_and_not_above():
    for n in (2, 5, 20):
        for a in (RNG.normal(size=(n, n)), np.array([[1.0 / (i + j + 1) for j in range(n)] for i in range(n)])[:6, :6]):
            estimate, true = batched.FUNCTIONS["rcond"](a)[0, 0], 1 / np.linalg.cond(a, 1)
            assert true * 0.999 <= estimate <= 10 * true
    assert batched.cond(np.ones((2, 2)), "one") == math.inf


def test_pencils_with_infinite_and_undefined_values():
    q, z = np.linalg.qr(RNG.normal(size=(4, 4)))[0], np.linalg.qr(RNG.normal(size=(4, 4)))[0]
    a, b = q @ np.diag([1.0, 2.0, 3.0, 4.0]) @ z, q @ np.diag([1.0, 0.5, 0.0, 2.0]) @ z
    made = batched.pencil(a, b)
    assert made["infinite"].sum() == 1 and not made["undefined"].any()
    finite = [(x / y).real for x, y, inf in zip(made["alpha"].ravel(), made["beta"].ravel(), made["infinite"].ravel()) if not inf]
    assert np.allclose(finite, [1.0, 2.0, 4.0])
    with pytest.raises(ArithmeticError):
        batched.eigvals_general(a, b)
    assert batched.pencil(np.diag([1.0, 0.0]), np.diag([2.0, 0.0]))["undefined"].all()
    assert np.allclose(batched.eigvals_general(a, np.eye(4)).ravel(), np.sort_complex(np.linalg.eigvals(a)))


def test_transforms_pad_cut_and_choose_axes():
    a = RNG.normal(size=(3, 5))
    assert np.allclose(batched.fft(a), np.fft.fft(a, axis=0)) and np.allclose(batched.fft(a, 8, 1), np.fft.fft(a, 8, 1))
    assert np.allclose(batched.fft(a[:1]), np.fft.fft(a[0])[None]) and np.allclose(batched.fft(batched.fft(a), inverse=True), a)


def test_reduced_rows_of_tiny_values():
    """A matrix below the tolerance has no pivots, however its own norm compares."""
    assert not batched.rref(np.full((2, 2), 1e-17)).any()
    assert np.allclose(batched.rref(np.array([[1.0, 2.0, 3.0], [2.0, 4.0, 7.0]])), [[1, 2, 0], [0, 0, 1]])


def test_identities_stay_symbols(spark):
    assert (Identity(3) + Identity(3, 2.0)).scale == 3.0 and (2 * I).size() is None and (Identity(2) * I).size() == 2
    a = Matrix.of(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert (a + I).to_rows() == [[2.0, 2.0], [3.0, 5.0]] and (I - a).to_rows() == [[0.0, -2.0], [-3.0, -3.0]]
    assert (a * Identity(2, 3.0)).to_rows() == [[3.0, 6.0], [9.0, 12.0]] and (I.materialised(spark, 2) - Matrix.of(spark, [[1.0, 0.0], [0.0, 1.0]])).abs().max() == 0
    for wrong in (lambda: a + Identity(3), lambda: a.row(0) + I, lambda: Identity(2) + Identity(3), lambda: I.materialised(spark)):
        with pytest.raises(ValueError):
            wrong()
