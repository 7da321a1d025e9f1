"""Least squares from sufficient statistics of one asset: tiny matrices, no rows. Used inside grouped tasks.

A statistics row describes the readings of one pattern of missing values: count, means, and the matrix of summed
centred products. Patterns that are complete for the wanted columns are merged, so every model of an asset, and every
round of feature removal, comes from the same single scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CONSTANT_STD = 1e-9


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    scatter: np.ndarray


@dataclass
class Fit:
    features: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    intercept: float | None = None
    coefficients: list[float] = field(default_factory=list)
    standardized: list[float] = field(default_factory=list)
    r2: float | None = None
    n: int = 0


def complete_moments(parts: list[tuple[int, int, np.ndarray, np.ndarray]], needed: list[int], size: int) -> Moments:
    """Merge the patterns in which every needed column is present (``mask`` has a bit per missing column)."""
    total = Moments(0, np.zeros(size), np.zeros((size, size)))
    blocked = sum(1 << i for i in needed)
    for mask, n, mean, scatter in parts:
        if mask & blocked or n == 0:
            continue
        shift = mean - total.mean
        both = total.n + n
        total.scatter = total.scatter + scatter + np.outer(shift, shift) * (total.n * n / both)
        total.mean = total.mean + shift * (n / both)
        total.n = both
    return total


def solve(moments: Moments, names: list[str], target: np.ndarray, features: list[str], min_points: int, label: str) -> Fit:
    """Ordinary least squares of a linear target (``target`` are its weights over the columns)."""
    where = [names.index(f) for f in features]
    fit = Fit(n=moments.n)
    if moments.n < min_points:
        fit.removed = list(features)
        fit.notes.append(f"pontos validos insuficientes para ajuste robusto: {moments.n} de {min_points}.")
        return fit
    spread = np.sqrt(np.maximum(np.diag(moments.scatter)[where] / moments.n, 0.0))
    usable = [f for f, s in zip(features, spread) if s > CONSTANT_STD]
    fit.removed = [f for f in features if f not in usable]
    if not usable:
        fit.notes.append("todas as variaveis explicativas ficaram constantes na janela.")
        return fit
    where = [names.index(f) for f in usable]
    std_x = np.sqrt(np.diag(moments.scatter)[where] / moments.n)
    cross = moments.scatter[where] @ target / moments.n
    var_y = float(target @ moments.scatter @ target) / moments.n
    std_y = float(np.sqrt(max(var_y, 0.0)))
    if std_y <= CONSTANT_STD:
        fit.removed += usable
        fit.notes.append("o alvo ficou constante ou com poucos pontos apos limpeza.")
        return fit
    correlation = moments.scatter[np.ix_(where, where)] / moments.n / np.outer(std_x, std_x)
    beta = np.linalg.pinv(correlation, rcond=1e-12, hermitian=True) @ (cross / (std_x * std_y))
    raw = beta * std_y / std_x
    fit.features = usable
    fit.standardized = [float(b) for b in beta]
    fit.coefficients = [float(b) for b in raw]
    fit.intercept = float(target @ moments.mean - raw @ moments.mean[where])
    explained = float(2 * beta @ (cross / (std_x * std_y)) - beta @ correlation @ beta)
    fit.r2 = float(min(1.0, max(0.0, explained)))
    for i in range(len(usable)):
        for j in range(i + 1, len(usable)):
            if abs(correlation[i, j]) >= 0.85:
                fit.notes.append(
                    f"possivel colinearidade entre {usable[i]} e {usable[j]} (correlacao {abs(correlation[i, j]):.2f}).")
    return fit


def baseline(moments: Moments, target: np.ndarray, min_points: int) -> Fit:
    """Mean of the target as the whole model."""
    fit = Fit(n=moments.n)
    if moments.n >= min_points:
        fit.intercept, fit.r2 = float(target @ moments.mean), 0.0
    else:
        fit.notes.append(f"pontos validos insuficientes para linha-base: {moments.n} de {min_points}.")
    return fit


def direction(value: float) -> str:
    return "positivo" if value >= 0 else "negativo"


def unexpected_signs(fit: Fit, expected: dict[str, str], least: float = 0.0) -> list[str]:
    return [f for f, b in zip(fit.features, fit.standardized)
            if f in expected and direction(b) != expected[f] and abs(b) >= least]
