"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of A - sI, read off its factors L D Lt, says how many eigenvalues lie above s. Bisection on these counts
isolates each leading eigenvalue (or a cluster that double precision can't part), Rayleigh quotient iteration takes its
vector from there, and two more counts certify its number.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: A pivot block of one row is taken if its entry is at least so large beside its column (Bunch and Kaufman).
ALPHA = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a are larger than shift: positive pivots of the factors of a - shift * I."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        column = np.abs(m[1:, 0])
        size = 1
        if len(column) and (most := column.max()) > 0 and abs(m[0, 0]) < ALPHA * most:
            r = 1 + int(column.argmax())
            row = np.abs(m[r])
            row[r] = 0
            if abs(m[0, 0]) * row.max() >= ALPHA * most**2:
                r = 0
            elif abs(m[r, r]) < ALPHA * row.max():
                size = 2
            to = size - 1
            if r > to:
                m[[to, r]] = m[[r, to]]
                m[:, [to, r]] = m[:, [r, to]]
        if size == 1:
            d = m[0, 0]
            above += d > 0
            rest = m[1:, 0]
            m = m[1:, 1:] - (np.outer(rest, rest / d) if d else 0)
        else:
            block, rest = m[:2, :2], m[2:, :2]
            above += 1  # such a block has one eigenvalue of each sign
            m = m[2:, 2:] - rest @ np.linalg.solve(block, rest.T)
    return int(above)


def _orthonormal(q: np.ndarray, found: np.ndarray) -> np.ndarray:
    """q without its parts along the found columns, orthonormal."""
    for _ in range(2):
        q = q - found @ (found.T @ q)
        q = np.linalg.qr(q)[0]
    return q


def _solve(a: np.ndarray, shift: float, q: np.ndarray, tiny: float) -> np.ndarray:
    for _ in range(8):
        try:
            y = np.linalg.solve(a - shift * np.eye(len(a)), q)
            if np.isfinite(y).all():
                return y / np.abs(y).max()
        except np.linalg.LinAlgError:
            pass
        shift += tiny
    raise ArithmeticError("a shifted matrix stays singular")


def leading(a: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns, the largest entry of each positive."""
    d = len(a)
    a = (a + a.T) / 2
    norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if d == 0 or k == 0 or norm == 0:
        return np.zeros(min(k, d)), np.eye(d)[:, : min(k, d)]
    k = min(k, d)
    rng = np.random.default_rng(seed)
    tol = 8 * max(d, 16) * EPS * norm
    values: list[float] = []
    vectors = np.zeros((d, 0))
    # intervals with the numbers of eigenvalues above either end, the highest interval on top
    open_: list[tuple[float, float, int, int]] = [(-1.1 * norm, 1.1 * norm, d, 0)]
    while open_ and len(values) < k:
        lo, hi, above_lo, above_hi = open_.pop()
        inside = above_lo - above_hi
        if inside == 0:
            continue
        mid = (lo + hi) / 2
        if inside == 1 or hi - lo <= tol:
            q = _rayleigh(a, lo, hi, vectors, rng, tol) if inside == 1 else None
            if q is None and hi - lo <= tol:
                q = _cluster(a, mid, inside, vectors, rng, tol)
            if q is not None:
                e = np.einsum("ij,ik,kj->j", q, a, q)
                order = np.argsort(-e)
                values += list(e[order])
                vectors = np.hstack([vectors, q[:, order]])
                continue
        above = count_above(a, mid)
        above = min(max(above, above_hi), above_lo)
        open_ += [(lo, mid, above_lo, above), (mid, hi, above, above_hi)]
    e, v = np.array(values[:k]), vectors[:, :k]
    for i, x in enumerate(e):
        if count_above(a, x + tol) > i or count_above(a, x - tol) < i + 1:
            raise ArithmeticError(f"eigenvalue {i + 1} isn't the one of that number")
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return e, v * np.where(sign == 0, 1, sign)


def _rayleigh(a: np.ndarray, lo: float, hi: float, found: np.ndarray, rng: np.random.Generator, tol: float) -> np.ndarray | None:
    """The unit vector of the one eigenvalue in [lo, hi]; None if the iteration doesn't end well within the interval."""
    q = _orthonormal(rng.standard_normal((len(a), 1)), found)
    shift = (lo + hi) / 2
    best = np.inf
    for step in range(30):
        q = _orthonormal(_solve(a, shift, q, tol / 64), found)
        value = float((q.T @ a @ q)[0, 0])
        off = float(np.linalg.norm(a @ q - value * q))
        if off <= tol / 16 or (off <= tol and off >= best / 2):
            return q if lo + tol < value < hi - tol else None  # at an end it may be a neighbour's
        best = min(best, off)
        if step >= 1:  # the first steps are at the middle of the interval, so that its own vector comes to the fore
            if not lo <= value <= hi:
                return None
            shift = value
    return None


def _cluster(a: np.ndarray, mid: float, size: int, found: np.ndarray, rng: np.random.Generator, tol: float) -> np.ndarray:
    """Orthonormal vectors of the space of eigenvalues that can't be parted."""
    q = _orthonormal(rng.standard_normal((len(a), size)), found)
    for _ in range(6):
        q = _orthonormal(_solve(a, mid + tol / 3, q, tol / 64), found)
    return q
