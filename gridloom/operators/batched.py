"""Tables of many small matrices, one result per key.

Cells ``(key, i, j, v)`` of each matrix meet in one group, whose size is bounded by
``MOST_CELLS``; Spark spreads the keys. Each function takes numpy arrays to named numpy arrays,
and results come back as cells ``(key, factor, i, j, re, im)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of one small matrix.
MOST_CELLS = 512 * 512

SCHEMA = "factor string, i bigint, j bigint, re double, im double"


def lu(a: np.ndarray) -> dict[str, np.ndarray]:
    """P·A = L·U with partial pivoting."""
    n = len(a)
    u, p, low = a.astype(complex if np.iscomplexobj(a) else float), np.eye(n), np.eye(n, dtype=complex if np.iscomplexobj(a) else float)
    for k in range(n - 1):
        top = k + int(np.abs(u[k:, k]).argmax())
        if u[top, k] == 0:
            continue
        u[[k, top], k:], p[[k, top]], low[[k, top], :k] = u[[top, k], k:], p[[top, k]], low[[top, k], :k]
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :, k:] -= np.outer(low[k + 1 :, k], u[k, k:])
    return {"L": low, "U": np.triu(u), "P": p}


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection turns x to its first axis; zero if it has nothing to turn."""
    x = x.copy()
    size = np.linalg.norm(x)
    x[0] += (x[0] / abs(x[0]) if x[0] else 1.0) * size
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def hess(a: np.ndarray) -> dict[str, np.ndarray]:
    """A = Q·H·Qᴴ with H upper Hessenberg."""
    h, q = a.astype(complex if np.iscomplexobj(a) else float), np.eye(len(a), dtype=complex if np.iscomplexobj(a) else float)
    for k in range(len(a) - 2):
        x = _reflector(h[k + 1 :, k])
        h[k + 1 :] -= 2 * np.outer(x, x.conj() @ h[k + 1 :])
        h[:, k + 1 :] -= 2 * np.outer(h[:, k + 1 :] @ x, x.conj())
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x.conj())
    return {"H": np.triu(h, -1), "Q": q}


def qr_pivoted(a: np.ndarray) -> dict[str, np.ndarray]:
    """A·P = Q·R by reflections, each of the column that is longest below the rows done; Q is complete."""
    m, n = a.shape
    r, q, order = a.astype(complex if np.iscomplexobj(a) else float), np.eye(m, dtype=complex if np.iscomplexobj(a) else float), np.arange(n)
    for k in range(min(m, n)):
        far = k + int((np.abs(r[k:, k:]) ** 2).sum(axis=0).argmax())
        r[:, [k, far]], order[[k, far]] = r[:, [far, k]], order[[far, k]]
        x = _reflector(r[k:, k])
        r[k:] -= 2 * np.outer(x, x.conj() @ r[k:])
        q[:, k:] -= 2 * np.outer(q[:, k:] @ x, x.conj())
    return {"Q": q, "R": np.triu(r), "P": np.eye(n)[:, order]}


def lstsq_pivoted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares by pivoted QR; columns beyond the rank get no weight."""
    f = qr_pivoted(a)
    d = np.abs(np.diag(f["R"]))
    k = int((d > max(a.shape) * 2.0**-52 * d.max(initial=0.0)).sum())
    x = np.zeros((a.shape[1], b.shape[1]), f["R"].dtype)
    x[:k] = np.linalg.solve(f["R"][:k, :k], (f["Q"].conj().T @ b)[:k])
    return f["P"] @ x


@dataclass
class Decomposition:
    """A factorisation that solves many right-hand sides: Cholesky, else LU, else pivoted QR, by what the matrix is."""

    kind: str
    shape: tuple[int, int]
    factors: dict[str, np.ndarray]

    @classmethod
    def of(cls, a: np.ndarray) -> Decomposition:
        if a.shape[0] != a.shape[1]:
            return cls("qr", a.shape, {**qr_pivoted(a), "A": a})
        if np.allclose(a, a.conj().T, rtol=0, atol=100 * 2.0**-52 * np.abs(a).sum(axis=1).max(initial=0)) and (np.diag(a).real > 0).all():
            try:
                return cls("cholesky", a.shape, {"L": np.linalg.cholesky(a)})
            except np.linalg.LinAlgError:
                pass
        return cls("lu", a.shape, lu(a))

    def solve(self, b: np.ndarray, transposed: bool = False) -> np.ndarray:
        f = self.factors
        if self.kind == "qr":
            return lstsq_pivoted(f["A"].conj().T if transposed else f["A"], b)
        if self.kind == "cholesky":
            low = f["L"].conj() if transposed else f["L"]
            return np.linalg.solve(low.conj().T, np.linalg.solve(low, b))
        if np.diag(f["U"]).all():
            if transposed:
                return f["P"].T @ np.linalg.solve(f["L"].T, np.linalg.solve(f["U"].T, b))
            return np.linalg.solve(f["U"], np.linalg.solve(f["L"], f["P"] @ b))
        raise np.linalg.LinAlgError("singular")

    def det(self) -> complex | float:
        if self.kind == "qr":
            raise ValueError("a determinant by QR is not offered")
        if self.kind == "cholesky":
            return float(np.prod(np.diag(self.factors["L"]).real) ** 2)
        return np.linalg.det(self.factors["P"]) * np.prod(np.diag(self.factors["U"]))

    def rcond(self, one_norm: float, rounds: int = 5) -> float:
        """Reciprocal condition in the one norm, the inverse's estimated from a few solves: for a vector of equal
        weights, signs of the solution are solved back, and the unit vector that grows most is tried next."""
        n = self.shape[0]
        if n == 0 or one_norm == 0:
            return 0.0
        x, best = np.full((n, 1), 1.0 / n), 0.0
        try:
            for _ in range(rounds):
                y = self.solve(x)
                now = float(np.abs(y).sum())
                z = self.solve(np.where(y >= 0, 1.0, -1.0), transposed=True)
                at = int(np.abs(z).argmax())
                if now <= best or np.abs(z[at, 0]) <= float((z.T @ x)[0, 0]) + 1e-300:
                    best = max(best, now)
                    break
                best = max(best, now)
                x = np.eye(n)[:, [at]]
            swing = np.array([(-1.0) ** k * (1 + k / max(1, n - 1)) for k in range(n)])[:, None]
            best = max(best, 2 * float(np.abs(self.solve(swing)).sum()) / (3 * n))
        except np.linalg.LinAlgError:
            return 0.0
        return 1.0 / (best * one_norm) if best else 0.0


def decompose(a: np.ndarray) -> dict[str, np.ndarray]:
    """The factors of the fitting decomposition, with its kind as a number (0 Cholesky, 1 LU, 2 QR)."""
    made = Decomposition.of(a)
    return {**{k: v for k, v in made.factors.items() if k != "A"}, "kind": np.array([[float(["cholesky", "lu", "qr"].index(made.kind))]])}


def schur(a: np.ndarray) -> dict[str, np.ndarray]:
    """Complex Schur form A = Q·T·Qᴴ by shifted QR steps with deflation."""
    t, q, n = a.astype(complex), np.eye(len(a), dtype=complex), len(a)
    end, tries = n, 0
    while end > 1:
        if abs(t[end - 1, end - 2]) <= 1e-15 * (abs(t[end - 1, end - 1]) + abs(t[end - 2, end - 2]) + 1e-300):
            t[end - 1, end - 2] = 0
            end, tries = end - 1, 0
            continue
        near = np.linalg.eigvals(t[end - 2 : end, end - 2 : end])
        shift = near[np.abs(near - t[end - 1, end - 1]).argmin()] if tries % 11 != 10 else abs(t[end - 1, end - 2])
        tries += 1
        if tries > 300:
            raise ArithmeticError("the QR steps do not converge")
        w, _ = np.linalg.qr(t[:end, :end] - shift * np.eye(end))
        t[:end] = w.conj().T @ t[:end]
        t[:, :end] = t[:, :end] @ w
        q[:, :end] = q[:, :end] @ w
    return {"T": np.triu(t), "Q": q}


def _turn(t: np.ndarray, q: np.ndarray, k: int, c: float, s: float) -> None:
    """Rotate rows and columns k, k + 1 of T, and columns of Q, in place."""
    g = np.array([[c, -s], [s, c]])
    t[k : k + 2] = g.T @ t[k : k + 2]
    t[:, k : k + 2] = t[:, k : k + 2] @ g
    q[:, k : k + 2] = q[:, k : k + 2] @ g


def schur_real(a: np.ndarray) -> dict[str, np.ndarray]:
    """Real Schur form A = Q·T·Qᵀ: steps with both shifts at once; 2 x 2 blocks that stay have equal diagonals."""
    made = hess(a.astype(float))
    t, q, end, tries = made["H"], made["Q"], len(a), 0
    while end > 1:
        low = end - 1
        while low and abs(t[low, low - 1]) > 2.0**-52 * (abs(t[low, low]) + abs(t[low - 1, low - 1])):
            low -= 1
        if low:
            t[low, low - 1] = 0.0
        if end - low == 1:
            end, tries = end - 1, 0
            continue
        if end - low == 2:
            k = low
            (w, x), (y, z) = t[k : k + 2, k : k + 2]
            half = (w - z) / 2
            inner = half * half + x * y
            if inner >= 0:
                # Two real values: the first axis turns to an eigenvector.
                value = half + (1.0 if half >= 0 else -1.0) * np.sqrt(inner)
                vector = np.array([value, y]) if abs(value) + abs(y) else np.array([1.0, 0.0])
                vector = vector / np.linalg.norm(vector)
                _turn(t, q, k, vector[0], vector[1])
                t[k + 1, k] = 0.0
            else:
                angle = 0.5 * np.arctan2(z - w, x + y)
                _turn(t, q, k, np.cos(angle), np.sin(angle))
            end, tries = end - 2, 0
            continue
        block = t[low:end, low:end]
        corner = block[-2:, -2:]
        total, product = np.trace(corner), np.linalg.det(corner)
        if tries % 11 == 10:
            size = abs(block[-1, -2]) + abs(block[-2, -3])
            total, product = 1.5 * size, size * size
        tries += 1
        if tries > 300:
            raise ArithmeticError("the QR steps do not converge")
        w, _ = np.linalg.qr(block @ block - total * block + product * np.eye(end - low))
        again = hess(w.T @ block @ w)
        w = w @ again["Q"]
        t[low:end, end:], t[:low, low:end] = w.T @ t[low:end, end:], t[:low, low:end] @ w
        t[low:end, low:end] = again["H"]
        q[:, low:end] = q[:, low:end] @ w
    return {"T": np.triu(t, -1), "Q": q}


def is_schur_block(t: np.ndarray, k: int) -> bool:
    """Whether a 2 x 2 block begins at k of a real Schur form."""
    return 0 <= k < len(t) - 1 and t[k + 1, k] != 0


def expm(a: np.ndarray) -> np.ndarray:
    """Scaling and squaring of the Taylor series."""
    halvings = max(0, int(np.ceil(np.log2(max(np.linalg.norm(a, 1), 1e-300)))) + 4)
    x = a / 2.0**halvings
    out = term = np.eye(len(a), dtype=x.dtype)
    for k in range(1, 24):
        term = term @ x / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def funm(a: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f(A), f mapping complex to complex: over eigenvectors for Hermitian A, else over the Schur form, superdiagonal by
    superdiagonal, where eigenvalues that nearly meet are refused."""
    if np.allclose(a, a.conj().T):
        w, v = np.linalg.eigh(a)
        return v @ np.diag(f(w.astype(complex))) @ v.conj().T
    made = schur(a)
    t, q, n = made["T"], made["Q"], len(a)
    out = np.diag(f(np.diag(t).copy())).astype(complex)
    for d in range(1, n):
        for i in range(n - d):
            j = i + d
            gap = t[j, j] - t[i, i]
            if abs(gap) <= 1e-10 * max(1.0, abs(t[i, i]), abs(t[j, j])):
                raise ArithmeticError("eigenvalues nearly meet")
            total = t[i, j] * (out[j, j] - out[i, i]) + t[i, i + 1 : j] @ out[i + 1 : j, j] - out[i, i + 1 : j] @ t[i + 1 : j, j]
            out[i, j] = total / gap
    return q @ out @ q.conj().T


def sqrtm(a: np.ndarray) -> np.ndarray:
    """The principal root over the Schur form; equal eigenvalues and missing eigenvectors do no harm."""
    made = schur(a)
    return _real(made["Q"] @ _root(made["T"]) @ made["Q"].conj().T)


def _root(t: np.ndarray) -> np.ndarray:
    out = np.diag(np.sqrt(np.diag(t))).astype(complex)
    for j in range(len(t)):
        for i in range(j - 1, -1, -1):
            under = out[i, i] + out[j, j]
            rest = t[i, j] - out[i, i + 1 : j] @ out[i + 1 : j, j]
            if under == 0 and abs(rest) > 1e-12 * max(1.0, np.abs(t).max()):
                raise ArithmeticError("a matrix without a square root")
            out[i, j] = rest / under if under else 0.0
    return out


def logm(a: np.ndarray, base: float = math.e) -> np.ndarray:
    """The principal logarithm: roots of the Schur form until it is near one, then a quadrature of the integral of 1/(1 + x)."""
    made = schur(a)
    t, n, roots = made["T"], len(a), 0
    if (np.diag(t) == 0).any():
        raise ArithmeticError("the logarithm of a singular matrix")
    while np.linalg.norm(t - np.eye(n), 1) > 0.2:
        t, roots = _root(t), roots + 1
        if roots > 100:
            raise ArithmeticError("the roots do not come near one")
    x, out = t - np.eye(n), np.zeros((n, n), complex)
    for node, weight in zip(*np.polynomial.legendre.leggauss(10)):
        out += weight / 2 * np.linalg.solve(np.eye(n) + (node + 1) / 2 * x, x)
    return _real(made["Q"] @ (2.0**roots * out) @ made["Q"].conj().T / np.log(base))


def powm(a: np.ndarray, p: float) -> np.ndarray:
    """A to any power: whole ones by squaring (negative ones of the inverse), others by logarithm; no real result is an error."""
    if float(p).is_integer():
        return np.linalg.matrix_power(a, int(p))
    whole = math.floor(p)
    out = _real(np.linalg.matrix_power(a.astype(complex), whole) @ expm(logm(a).astype(complex) * (p - whole)))
    if np.iscomplexobj(out) and not np.iscomplexobj(a):
        raise ArithmeticError("no real power")
    return out


def _real(x: np.ndarray) -> np.ndarray:
    return x.real if np.abs(x.imag).max(initial=0) <= 1e-10 * max(1.0, np.abs(x).max(initial=0)) else x


def rref(a: np.ndarray) -> np.ndarray:
    out, row = a.astype(float), 0
    tol = max(a.shape) * 2.0**-52 * max(1.0, np.abs(a).sum(axis=1).max(initial=0))
    for col in range(a.shape[1]):
        if row == len(out):
            break
        top = row + int(np.abs(out[row:, col]).argmax())
        if abs(out[top, col]) <= tol:
            out[row:, col] = 0
            continue
        out[[row, top]] = out[[top, row]]
        out[row] /= out[row, col]
        others = np.arange(len(out)) != row
        out[others] -= np.outer(out[others, col], out[row])
        row += 1
    return out


def adjugate(a: np.ndarray) -> np.ndarray:
    """From the singular value decomposition, so that singular matrices have theirs too."""
    u, s, vt = np.linalg.svd(a)
    others = np.array([np.prod(np.delete(s, k)) for k in range(len(s))])
    return np.linalg.det(u) * np.linalg.det(vt) * (vt.T * others) @ u.T


def eig(a: np.ndarray) -> dict[str, np.ndarray]:
    w, v = np.linalg.eig(a)
    order = np.lexsort((w.imag, w.real))
    return {"values": w[order][:, None], "vectors": v[:, order]}


def eig_general(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """A·x = w·B·x for symmetric A and positive definite B, ascending, B-orthonormal."""
    c = np.linalg.inv(np.linalg.cholesky(b))
    w, v = np.linalg.eigh(c @ a @ c.conj().T)
    return {"values": w[:, None], "vectors": c.conj().T @ v}


def pencil(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Eigenvalues of A·x = w·B·x as pairs, w = alpha / beta: infinite where beta is 0, undefined for a singular pencil.

    A turned pencil, with cos·A + sin·B regular, has the values mu of A against it, and w = sin·mu / (1 - cos·mu).
    """
    n = len(a)
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0), 1e-300)
    best, turned = -1.0, (1.0, 0.0)
    for angle in (0.7, 1.9, 2.6, 0.2, 1.3):
        c, s = math.cos(angle), math.sin(angle)
        size = float(np.linalg.svd((c * a + s * b) / scale, compute_uv=False).min(initial=1.0))
        if size > best:
            best, turned = size, (c, s)
    c, s = turned
    if best <= n * 2.0**-52:
        return {"alpha": np.zeros((n, 1)), "beta": np.zeros((n, 1)), "infinite": np.zeros((n, 1)), "undefined": np.ones((n, 1))}
    mu = np.linalg.eigvals(np.linalg.solve(c * a + s * b, a))
    alpha, beta = s * mu, 1 - c * mu
    # An eigenvalue that is infinite twice over is only found to the root of the rounding.
    near = np.abs(beta) <= 1e-7 * np.abs(alpha)
    beta = np.where(near, 0.0, beta)
    value = np.where(near, np.inf, (alpha / np.where(near, 1.0, beta)).real)
    order = np.lexsort((np.where(near, 0, (alpha / np.where(near, 1.0, beta)).imag), value))
    column = lambda x: np.asarray(x)[order][:, None]
    return {"alpha": column(alpha), "beta": column(beta), "infinite": column(near.astype(float)), "undefined": np.zeros((n, 1))}


def eigvals_general(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Finite eigenvalues of a regular pencil; an infinite or undefined one is an error."""
    made = pencil(a, b)
    if made["infinite"].any() or made["undefined"].any():
        raise ArithmeticError("infinite or undefined eigenvalues")
    return np.sort_complex((made["alpha"] / made["beta"]).ravel())[:, None]


def cond(a: np.ndarray, kind: str = "two") -> float:
    if kind == "two":
        return float(np.linalg.cond(a))
    order = {"one": 1, "inf": np.inf, "fro": "fro"}[kind]
    try:
        return float(np.linalg.norm(a, order) * np.linalg.norm(np.linalg.inv(a), order))
    except np.linalg.LinAlgError:
        return float("inf")


def fft(a: np.ndarray, n: int | None = None, axis: int | None = None, inverse: bool = False) -> np.ndarray:
    """A vector along its length, a matrix by columns, or along ``axis``; ``n`` pads with zeros or cuts."""
    axis = (1 if a.shape[0] == 1 else 0) if axis is None else axis
    return (np.fft.ifft if inverse else np.fft.fft)(a, n, axis)


def polyeig(parts: np.ndarray) -> np.ndarray:
    """Eigenvalues w of A0 + w·A1 + … + w^d·Ad, whose blocks stand side by side."""
    n = parts.shape[0]
    d = parts.shape[1] // n - 1
    blocks = [parts[:, k * n : (k + 1) * n] for k in range(d + 1)]
    left, right = np.eye(n * d, k=n), np.eye(n * d)
    left[-n:], right[-n:, -n:] = np.hstack([-b for b in blocks[:-1]]), blocks[-1]
    return np.sort_complex(np.linalg.eigvals(np.linalg.solve(right, left)))[:, None]


def _svd(a: np.ndarray) -> dict[str, np.ndarray]:
    u, s, vt = np.linalg.svd(a)
    out = np.zeros(a.shape)
    np.fill_diagonal(out, s)
    return {"U": u, "S": out, "V": vt.conj().T}


def _qr(a: np.ndarray) -> dict[str, np.ndarray]:
    q, r = np.linalg.qr(a)
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return {"Q": q * s, "R": s[:, None] * r}


def _poly_of(a: np.ndarray) -> np.ndarray:
    return np.poly(a if a.shape[0] == a.shape[1] else a.ravel())[None, :]


def _basis(a: np.ndarray, null: bool) -> np.ndarray:
    u, s, vt = np.linalg.svd(a)
    r = int((s > max(a.shape) * np.spacing(s.max(initial=0.0))).sum())
    return vt[r:].conj().T if null else u[:, :r]


#: Functions of one small matrix, by name.
FUNCTIONS: dict[str, Callable[[np.ndarray], dict[str, np.ndarray] | np.ndarray]] = {
    "lu": lu, "qr": _qr, "qr_pivoted": qr_pivoted, "decompose": decompose, "svd": _svd, "hess": hess, "schur": schur, "schur_real": schur_real, "eig": eig, "cholesky": np.linalg.cholesky,
    "inverse": np.linalg.inv, "pinv": np.linalg.pinv, "det": lambda a: np.array([[np.linalg.det(a)]]), "adjugate": adjugate, "rref": rref,
    "rank": lambda a: np.array([[float(np.linalg.matrix_rank(a))]]), "cond": lambda a: np.array([[np.linalg.cond(a)]]),
    "rcond": lambda a: np.array([[Decomposition.of(a).rcond(float(np.abs(a).sum(axis=0).max()))]]), "null": lambda a: _basis(a, True), "orth": lambda a: _basis(a, False),
    "polyeig": polyeig,
    "eigvals": lambda a: np.sort_complex(np.linalg.eigvals(a))[:, None],
    "expm": expm, "sinm": lambda a: _real((expm(1j * a) - expm(-1j * a)) / 2j), "cosm": lambda a: _real((expm(1j * a) + expm(-1j * a)) / 2),
    "sinhm": lambda a: (expm(a) - expm(-a)) / 2, "coshm": lambda a: (expm(a) + expm(-a)) / 2,
    "tanm": lambda a: _real(np.linalg.solve((expm(1j * a) + expm(-1j * a)) / 2, (expm(1j * a) - expm(-1j * a)) / 2j)),
    "tanhm": lambda a: np.linalg.solve(expm(a) + expm(-a), expm(a) - expm(-a)),
    "logm": logm, "sqrtm": sqrtm, "fft": fft, "ifft": lambda a: fft(a, inverse=True),
    "fft2": np.fft.fft2, "ifft2": np.fft.ifft2, "poly": _poly_of, "roots": lambda a: np.sort_complex(np.roots(a.ravel()))[:, None],
}

#: Functions of two small matrices.
PAIRS: dict[str, Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray] | np.ndarray]] = {
    "solve": lambda a, b: np.linalg.solve(a, b) if a.shape[0] == a.shape[1] else lstsq_pivoted(a, b), "decompose_solve": lambda a, b: Decomposition.of(a).solve(b),
    "decompose_solve_transposed": lambda a, b: Decomposition.of(a).solve(b, transposed=True), "pencil": pencil,
    "right_divide": lambda a, b: np.linalg.solve(b.T, a.T).T, "lsqminnorm": lambda a, b: np.linalg.pinv(a) @ b, "eig_general": eig_general,
    "eigvals_general": eigvals_general,
    "deconv": lambda y, a: dict(zip(("quotient", "remainder"), (np.atleast_2d(x) for x in np.polydiv(y.ravel(), a.ravel())))),
    "conv": lambda a, b: np.convolve(a.ravel(), b.ravel())[None, :],
}


def _array(cells: Mapping[str, np.ndarray], m: int, n: int) -> np.ndarray:
    """The matrix of cells, given as columns i, j and v."""
    if m * n > MOST_CELLS:
        raise ValueError(f"a matrix of {m} x {n} is not small")
    out = np.zeros((m, n))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def _streamed(df: DataFrame, key: str, f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray] | np.ndarray | None]) -> DataFrame:
    """``f(side, i, j, v)`` of every key's cells. Keys come sorted, one after the other, so that a task starts no group for each."""
    spark, kind = df.sparkSession, df.schema[key].dataType
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def made(names: pa.Array, cells: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, at, held = [], [], 0
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            found = f(*[c[a:b] for c in cells])
            for name, x in (() if found is None else (found if isinstance(found, dict) else {"R": found}).items()):
                i, j = np.indices(x.shape).reshape(2, -1)
                out.append((name, i, j, np.real(x).ravel().astype(float), np.imag(x).ravel().astype(float)))
                at.append(a)
                held += x.size
            if held >= MOST_CELLS or b == starts[-1]:
                sizes = [len(o[1]) for o in out]
                if out:
                    whole = [np.concatenate([o[k] for o in out]) for k in range(1, 5)]
                    factor = pa.array([o[0] for o in out]).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(at, sizes))), factor, *[pa.array(w) for w in whole]], names=[key, "factor", "i", "j", "re", "im"])
                out, at, held = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if not rows.num_rows:
                continue
            names = rows.column(0).combine_chunks()
            code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
            yield from made(names, [rows.column(k).to_numpy() for k in range(1, 5)], starts)
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield from made(held.column(0).combine_chunks(), [held.column(k).to_numpy() for k in range(1, 5)], np.array([0, held.num_rows]))

    return df.repartition(many, key).sortWithinPartitions(key).mapInArrow(run, f"{key} {kind.simpleString()}, {SCHEMA}")


def apply(df: DataFrame, key: str, m: int, n: int, function: str | Callable) -> DataFrame:
    """``function`` of the m x n matrix of every key."""
    f = FUNCTIONS[function] if isinstance(function, str) else function
    return _streamed(df.select(key, F.lit(0).alias("side"), "i", "j", "v"), key, lambda side, i, j, v: f(_array({"i": i, "j": j, "v": v}, m, n)))


def apply_pair(a: DataFrame, b: DataFrame, key: str, shape_a: tuple[int, int], shape_b: tuple[int, int], function: str | Callable) -> DataFrame:
    """``function`` of the two matrices of every key that both tables have."""
    f = PAIRS[function] if isinstance(function, str) else function

    def run(side: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray] | np.ndarray | None:
        x, y = side == 0, side == 1
        own = lambda at, shape: _array({"i": i[at], "j": j[at], "v": v[at]}, *shape)
        return f(own(x, shape_a), own(y, shape_b)) if x.any() and y.any() else None

    one = lambda df, k: df.select(F.col(key).cast(a.schema[key].dataType).alias(key), F.lit(k).alias("side"), "i", "j", "v")
    return _streamed(one(a, 0).unionByName(one(b, 1)), key, run)


def total(df: DataFrame) -> DataFrame:
    """The sum of squares of every factor, an invariant that checks can use."""
    return df.groupBy("factor").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))
