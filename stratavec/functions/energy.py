"""Spectral energy of adapter weights, and the tiers that an energy budget asks for."""

from __future__ import annotations

import numpy as np

ROTATIONS = 100
SMALL = 1e-6


def jacobi(matrix: np.ndarray, rotations: int = ROTATIONS) -> np.ndarray:
    """Diagonal after at most so many Jacobi rotations, each at the largest off-diagonal value; a large matrix isn't diagonal by then."""
    a = np.array(matrix, np.float64)
    if len(a) < 2:
        return np.diag(a).copy()
    upper = np.triu_indices(len(a), 1)
    for _ in range(rotations):
        values = np.abs(a[upper])
        best = int(values.argmax())
        if values[best] < SMALL:
            break
        p, q = upper[0][best], upper[1][best]
        angle = np.pi / 4 if a[p, p] == a[q, q] else 0.5 * np.arctan2(2 * a[p, q], a[p, p] - a[q, q])
        turn = np.eye(len(a))
        turn[p, p] = turn[q, q] = np.cos(angle)
        turn[p, q], turn[q, p] = -np.sin(angle), np.sin(angle)
        a = turn.T @ a @ turn
    return np.diag(a).copy()


def cumulative(weights: np.ndarray, method: str = "rotations") -> np.ndarray:
    """weights: D by r. Energy held by the largest 1, 2, ... D squared singular values, as shares of the total."""
    square = np.asarray(weights, np.float64)
    return shares(square @ square.T, method)


def shares(square: np.ndarray, method: str = "rotations") -> np.ndarray:
    """The same from the D by D product of weights and their transpose, which Spark can sum up."""
    values = np.linalg.eigvalsh(square) if method == "exact" else jacobi(square)
    values = np.sort(np.maximum(values, 0))[::-1]
    total = values.sum()
    return np.cumsum(values) / total if total > 0 else np.ones(len(values))


def tier_energy(tiers: tuple[int, ...], dim: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Energy at each tier's boundary; in proportion to the dimensions without weights."""
    if weights is None:
        return np.array([t / dim for t in tiers])
    phi = cumulative(weights)
    return np.array([phi[t - 1] for t in tiers])


def active_tier(energy: np.ndarray, budget: float = 0.90) -> int:
    """The first tier that reaches the budget; the first of all if none does."""
    if not 0 < budget <= 1:
        raise ValueError("an energy budget is above 0 and at most 1")
    reached = np.flatnonzero(energy >= budget)
    return int(reached[0]) if len(reached) else 0
