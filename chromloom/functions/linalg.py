"""Small dense kernels (numpy): they run on factors and on single groups inside tasks."""

from __future__ import annotations

import numpy as np


def polar(m: np.ndarray, rank: int | None = None) -> np.ndarray:
    """U V^T of the leading `rank` singular triples; without a finite SVD, by the Gram matrix with a small ridge."""
    try:
        u, _, vt = np.linalg.svd(m, full_matrices=False)
    except np.linalg.LinAlgError:
        w, v = np.linalg.eigh(np.nan_to_num(m).T @ np.nan_to_num(m) + 1e-2 * np.eye(m.shape[1]))
        order = np.argsort(-w)
        vt = v[:, order].T
        u, r = np.linalg.qr(np.nan_to_num(m) @ v[:, order])
        u = u * np.where(np.sign(np.diag(r)) == 0, 1, np.sign(np.diag(r)))
        k = min(u.shape[1], len(vt))
        u, vt = u[:, :k], vt[:k]
    k = min(rank or len(vt), len(vt))
    return u[:, :k] @ vt[:k]


def inverse_root(gram: np.ndarray, floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(G^-1/2, eigenvalues of G, ascending) of a Gram matrix: M G^-1/2 is the polar factor of M."""
    w, v = np.linalg.eigh((gram + gram.T) / 2)
    safe = np.maximum(w, floor * max(float(w.max(initial=0)), 1e-300))
    return (v / np.sqrt(safe)) @ v.T, np.maximum(w, 0)


def gram_svd(gram: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, s): leading right singular vectors and values of a matrix with this Gram matrix."""
    w, v = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-w)[:rank]
    return v[:, order], np.sqrt(np.maximum(w[order], 0))


def solve_factor(mttkrp: np.ndarray, gram: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """f with f (G + ridge I) = MTTKRP."""
    return np.linalg.solve(gram + ridge * np.eye(len(gram)), mttkrp.T).T


def balanced(factors: list[np.ndarray]) -> list[np.ndarray]:
    """Unit columns in all factors but the last, which takes the norms."""
    *first, last = (f.copy() for f in factors)
    for f in first:
        norm = np.linalg.norm(f, axis=0)
        norm = np.where(norm > 0, norm, 1.0)
        f /= norm
        last = last * norm
    return [*first, last]


def cp_als(y: np.ndarray, factors: list[np.ndarray], sweeps: int = 1, tolerance: float = 1e-5) -> tuple[list[np.ndarray], list[float]]:
    """Alternating least squares for y(i, j, m) ~ sum_r A(i, r) B(j, r) D(m, r) from a warm start; the relative losses after each sweep."""
    a, b, d = balanced(factors)
    total, losses = float((y * y).sum()), []
    for _ in range(sweeps):
        a = solve_factor(np.einsum("ijm,jr,mr->ir", y, b, d, optimize=True), (b.T @ b) * (d.T @ d))
        b = solve_factor(np.einsum("ijm,ir,mr->jr", y, a, d, optimize=True), (a.T @ a) * (d.T @ d))
        m = np.einsum("ijm,ir,jr->mr", y, a, b, optimize=True)
        d = solve_factor(m, (a.T @ a) * (b.T @ b))
        fit = float(((a.T @ a) * (b.T @ b) * (d.T @ d)).sum())
        losses.append(max(0.0, total + fit - 2 * float((m * d).sum())) / max(total, 1e-300))
        if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * max(losses[-2], 1e-300):
            break
        a, b, d = balanced([a, b, d])
    return [a, b, d], losses


def random_walk(a: np.ndarray, steps: int, restart: float = 0.5, mix: float = 0.75, start: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(Q, Q A, change of each step) of the walk with restart over the rows of a map: first- and second-order similarity mixed.

    start: the column of A that stands for its first row, where A has more columns than rows.
    """
    own = a[:, start : start + len(a)]
    s2 = a @ a.T
    np.fill_diagonal(s2, 0)
    link = mix * own / (own.sum(axis=0) + 1e-15) + (1 - mix) * s2 / (s2.sum(axis=0) + 1e-15)
    sums = link.sum(axis=0)
    link[np.diag_indices_from(link)] += sums == 0
    p = link / link.sum(axis=0)
    q, changes = np.eye(len(a)), []
    for _ in range(steps):
        then = (1 - restart) * q @ p + restart * np.eye(len(a))
        changes.append(float(np.linalg.norm(then - q)))
        q = then
    return q, q @ a, changes


def mean_filter(a: np.ndarray) -> np.ndarray:
    """3 x 3 means, with zeros outside counted in."""
    p = np.pad(a, 1)
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)) / 9
