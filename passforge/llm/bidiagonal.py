"""Singular values and right vectors of a small upper triangular matrix (part of operator 11).

Householder reflections make the matrix bidiagonal; dqds finds the singular values of the
bidiagonal to high relative accuracy; twisted factorisations of B'B - e I give a
vector for each, from the place where the two factorisations leave the least. Vectors of
close values are made orthogonal to each other. All of it is of the size of the
vectors' dimension and runs on the driver.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right basis W of a square matrix: A = U B W'."""
    a = np.array(matrix, float)
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        v, beta, a[k, k] = _reflector(a[k:, k])
        a[k + 1:, k] = 0
        a[k:, k + 1:] -= beta * np.outer(v, v @ a[k:, k + 1:])
        if k < n - 2:
            v, beta, a[k, k + 1] = _reflector(a[k, k + 1:])
            a[k, k + 2:] = 0
            a[k + 1:, k + 1:] -= beta * np.outer(a[k + 1:, k + 1:] @ v, v)
            right[:, k + 1:] -= beta * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, alpha) with (I - beta v v') x = alpha e1."""
    size = np.abs(x).max(initial=0.0)
    if size == 0:
        return np.zeros(len(x)), 0.0, 0.0
    v = x / size
    norm = np.sqrt(v @ v)
    alpha = -np.copysign(norm, v[0])
    v[0] -= alpha
    square = v @ v
    return v, (2.0 / square if square else 0.0), alpha * size


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling.

    Shifted quotient-difference sweeps on the squares; a sweep that a shift makes negative is
    taken back and done with a smaller shift, so relative accuracy holds for small values too."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    squares = [((diagonal / scale) ** 2, (above / scale) ** 2)]
    blocks = [(q, e, 0.0) for q, e in squares]
    while blocks:
        q, e, shift = blocks.pop()
        _sweeps(list(q), list(e), shift, found, blocks)
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _sweeps(q: list[float], e: list[float], shift: float, found: list[float], blocks: list) -> None:
    """Values of one block by dqds; parts that split off go back to ``blocks``."""
    tau = 0.0
    for _ in range(60 * len(q) + 60):
        n = len(q)
        while n and (n == 1 or e[n - 2] <= 100 * EPS * EPS * (shift + q[n - 1]) or e[n - 2] <= _TINY):
            found.append(q.pop() + shift)
            if e:
                e.pop()
            n -= 1
            tau = 0.0
        if n == 0:
            return
        cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * shift or e[k] <= _TINY), None)
        if cut is not None:
            blocks.append((q[:cut + 1], e[:cut], shift))
            q, e = q[cut + 1:], e[cut + 1:]
            continue
        if n > 1 and q[0] < q[n - 1]:  # work on small values at the end
            q, e = _flipped(q, e)
        tau = max(tau, 0.0)
        while True:
            made = _sweep(q, e, tau)
            if made is not None:
                break
            tau = tau / 4 if tau > EPS * EPS * (shift + q[-1]) else 0.0
        (q, e), least = made
        shift += tau
        # the next shift: a lower bound of the least value from the last entries of the sweep
        tau = max(0.0, least - np.sqrt(e[-1]) * np.sqrt(max(q[-1], 0.0))) * 0.99 if e[-1] < least else least / 4
    found.extend(x + shift for x in q)


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The reversed matrix as an upper bidiagonal of the same values."""
    return q[::-1], e[::-1]


def _sweep(q: list[float], e: list[float], tau: float):
    """One dqds sweep, or nothing if the shift was above the least value."""
    out_q, out_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - tau
    least = d
    for k in range(len(q) - 1):
        if d < 0:
            return None
        out_q[k] = d + e[k]
        if out_q[k] == 0:
            ratio, d = 0.0, q[k + 1] - tau
        else:
            ratio = q[k + 1] / out_q[k]
            out_e[k] = e[k] * ratio
            d = d * ratio - tau
        least = min(least, d)
    if d < 0:
        return None
    out_q[-1] = d
    return (out_q, out_e), least


def _gram(d: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of B'B."""
    t = d ** 2
    t[1:] += u ** 2
    return t, d[:-1] * u


def _twisted(t: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots of T - value I from above and from below, and what is left at each twist (T scaled to about 1)."""
    n, least = len(t), EPS * EPS
    down, up = t - value, t - value
    for k in range(n - 1):
        if abs(down[k]) < least:
            down[k] = least
        down[k + 1] -= b[k] * (b[k] / down[k])
    for k in range(n - 1, 0, -1):
        if abs(up[k]) < least:
            up[k] = least
        up[k - 1] -= b[k - 1] * (b[k - 1] / up[k])
    return down, up, down + up - (t - value)


def _vector(t: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector of the twisted factorisation whose twist leaves least."""
    n = len(t)
    down, up, left = _twisted(t, b, value)
    at = int(np.abs(left).argmin())
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -b[k] / (down[k] or EPS * EPS) * z[k + 1]
        if abs(z[k]) > 1e100:
            z /= abs(z[k])
    for k in range(at + 1, n):
        z[k] = -b[k - 1] / (up[k] or EPS * EPS) * z[k - 1]
        if abs(z[k]) > 1e100:
            z /= abs(z[k])
    return z / np.sqrt(z @ z)


def _residual(t: np.ndarray, b: np.ndarray, value: float, z: np.ndarray) -> float:
    y = (t - value) * z
    y[:-1] += b * z[1:]
    y[1:] += b * z[:-1]
    return float(np.sqrt(y @ y))


def _beside(z: np.ndarray, out: np.ndarray) -> np.ndarray | None:
    """``z`` made orthogonal to the columns of ``out``; nothing if it lies among them."""
    for _ in range(3):
        z = z - out @ (out.T @ z)
        norm = np.sqrt(z @ z)
        if not norm > 0.01:
            return None
        z = z / norm
    return z


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal right singular vectors (columns) of the first ``most`` of the falling values.

    A vector that close values leave inaccurate or inside the span of the vectors before
    it is mended by inverse iteration beside those vectors."""
    n = len(diagonal)
    scale = values[0] if len(values) and values[0] > 0 else 1.0
    t, b = _gram(diagonal / scale, above / scale)
    blocks = _blocks(b)
    out = np.zeros((n, 0))
    rng = np.random.default_rng(0)
    good = 16 * EPS * np.sqrt(n)
    for value in (values[:most] / scale) ** 2:
        found = []
        for a, c in blocks:
            z = np.zeros(n)
            z[a:c] = _vector(t[a:c], b[a:c - 1], value)
            z = _beside(z, out)
            if z is not None:
                found.append((_residual(t, b, value, z), z))
        miss, best = min(found, key=lambda x: x[0], default=(np.inf, None))
        if miss > good:
            full = np.diag(t - value - 4 * EPS) + np.diag(b, 1) + np.diag(b, -1)
            z = best
            for _ in range(12):
                while z is None:
                    z = _beside(rng.normal(size=n), out)
                y = np.linalg.solve(full, z)
                z = _beside(y / np.sqrt(y @ y), out)
                if z is not None and (now := _residual(t, b, value, z)) < miss:
                    miss, best = now, z
                if miss <= good:
                    break
        out = np.column_stack([out, best])
    return out


def _blocks(b: np.ndarray) -> list[tuple[int, int]]:
    """The parts into which zeros beside the diagonal cut T."""
    edges = [0, *(np.flatnonzero(np.abs(b) <= EPS * EPS) + 1).tolist(), len(b) + 1]
    return list(zip(edges, edges[1:], strict=False))


def right_singular(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values (falling) and the first ``most`` right vectors (columns) of a square matrix."""
    diagonal, above, basis = bidiagonalise(matrix)
    values = dqds(diagonal, above)
    return values, basis @ right_vectors(diagonal, above, values, most)
