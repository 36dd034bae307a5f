"""Singular values and right singular vectors of a small matrix: Householder bidiagonalisation, differential
quotient-difference steps with shifts, twisted factorisations. Plain numpy on one ``d x d`` matrix."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
SMALL = (100 * EPS) ** 2


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``d, e, v`` with a = u B v': B has the diagonal ``d`` and the diagonal ``e`` above it."""
    a, n = np.array(a, dtype=np.float64), a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """The unit vector w of the reflection I - 2ww' that turns x into a multiple of the first axis."""
        w = x.copy()
        w[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(w)
        return w / size if size else None

    for k in range(n):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < n:
            w = reflector(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential step with a shift; None if the shift passes the smallest value."""
    out_q, out_e, d = [], [], q[0] - shift
    least = d
    for i in range(len(e)):
        if d < 0:
            return None
        top = d + e[i]
        ratio = q[i + 1] / top if top > 0 else 0.0
        out_q.append(top)
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    return [*out_q, d], out_e, least


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first, each to high relative accuracy."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    floor = 1e-300
    start = [max(float(x / scale) ** 2, floor) for x in diagonal], [float(x / scale) ** 2 for x in above]
    waiting, found = [(*start, 0.0)], []
    while waiting:
        q, e, moved = waiting.pop()
        for _ in range(200 * len(q) + 200):
            while len(q) > 1 and e[-1] <= SMALL * (moved + q[-1]):
                found.append(q.pop() + moved)
                e.pop()
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            cuts = [i for i in range(len(e)) if e[i] <= SMALL * min(q[i], q[i + 1])]
            if cuts:
                waiting.append((q[: cuts[0] + 1], e[: cuts[0]], moved))
                q, e = q[cuts[0] + 1 :], e[cuts[0] + 1 :]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]  # the smallest values are sought at the end
            # the smaller value of the last two by two block of BB' bounds the smallest one from above
            larger = (q[-2] + q[-1] + e[-1] + np.sqrt((q[-2] - q[-1] + e[-1]) ** 2 + 4 * q[-1] * e[-1])) / 2
            shift = float(q[-2] * (q[-1] / larger)) if larger > 0 else 0.0
            for attempt in (shift, shift * (1 - 1e-6), shift * 0.9, shift / 2, shift / 16, 0.0):
                done = qd_step(q, e, attempt)
                if done is not None:
                    q, e, moved = done[0], done[1], moved + attempt
                    break
        else:
            raise ArithmeticError("the quotient-difference steps didn't converge")
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue: the factorisations from the top and from the bottom meet at the row
    where their pivot is the smallest."""
    n = len(diagonal)
    tiny = EPS * EPS * max(float((diagonal**2).max()), float((above**2).max(initial=0)), 1e-290)
    d = np.maximum(diagonal**2, tiny)
    low = np.where(diagonal != 0, above_of(above, n) / np.where(diagonal != 0, diagonal, 1), above_of(above, n) / np.sqrt(tiny))

    def away(x: float) -> float:
        return x if abs(x) > tiny else (tiny if x >= 0 else -tiny)

    s, down = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        down[i] = d[i] * low[i] / away(d[i] + s[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    p, up = np.empty(n), np.empty(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        ratio = d[i] / away(d[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    at = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[at] = 1
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def above_of(above: np.ndarray, n: int) -> np.ndarray:
    """One entry per row; the last row has none."""
    return np.append(above, 0.0)[:n]


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, gap: float = 1e-4) -> np.ndarray:
    """Orthonormal eigenvectors of B'B as columns for ``values``, which fall.

    Values nearer to each other than ``gap`` of the larger one share a space: their vectors are made orthogonal to those
    before, and improved by inverse iteration, as the factorisation alone may give nearly the same one twice."""
    n = len(diagonal)
    t = np.diag(diagonal**2 + np.append(0.0, above**2)[:n])
    if n > 1:
        t += np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    rng = np.random.default_rng(0)
    out: list[np.ndarray] = []
    first = 0  # of the space of the current value
    for i, value in enumerate(values):
        if i and values[i - 1] - value > gap * values[i - 1]:
            first = i
        z = twisted(diagonal, above, float(value))
        if first < i or (i + 1 < len(values) and value - values[i + 1] <= gap * value):
            near = t - (value * (1 - 2 * EPS * (i - first + 1))) * np.eye(n)
            for _ in range(4):
                for other in out[first:] * 2:
                    z = z - (other @ z) * other
                if np.linalg.norm(z) < 1e-3:
                    z = rng.normal(size=n)
                try:
                    z = np.linalg.solve(near, z / np.linalg.norm(z))
                except np.linalg.LinAlgError:
                    z = np.linalg.lstsq(near + EPS * value * np.eye(n), z, rcond=None)[0]
                z = z / np.linalg.norm(z)
            for other in out[first:] * 2:
                z = z - (other @ z) * other
            z = z / np.linalg.norm(z)
        out.append(z)
    return np.array(out).T.reshape(n, len(out))


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values of ``r``, and the right singular vectors of the first ``k`` as columns."""
    d, e, v = bidiagonal(r)
    values = dqds(d, e)
    return values, v @ right_vectors(d, e, values[:k])
