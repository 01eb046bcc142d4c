"""Expectation-maximisation label model over the vote patterns of noisy labelling functions.

Votes are 1 (has the defect), 0 (has it not) and -1 (abstains). The patterns with their counts are sufficient for the
model, so it sees all rows through a table whose size depends on the number of functions alone.
"""

from __future__ import annotations

import numpy as np


def fit_posteriors(
    patterns: list[str], counts: list[int], rounds: int = 100, prior: float = 0.1, floor: float = 0.001
) -> dict[str, float]:
    """Posterior of the defect for each pattern (one character a function: '1', '0' or '-').

    Each class has a rate of either vote and of abstaining, re-estimated from the posteriors. A vote is weighed by its
    rates in the two classes; that a function abstains tells nothing, so that a defect which only one function knows can
    still be seen. A function keeps its sense (a vote for is never likelier without the defect than with it), which
    fixes the labels of the two classes, and no rate is below ``floor``.
    """
    if not patterns:
        return {}
    k = len(patterns[0])
    votes = np.array([[{"1": 1, "0": 0}.get(c, 2) for c in p] for p in patterns])
    n = np.asarray(counts, dtype=np.float64)
    rates = np.empty((2, k, 3))
    rates[1], rates[0] = (0.1, 0.6, 0.3), (0.6, 0.1, 0.3)
    for _ in range(rounds):
        weigh = np.log(rates[1] / rates[0])
        weigh[:, 2] = 0.0
        odds = weigh[np.arange(k), votes].sum(1) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        before = prior
        for c, w in ((1, post * n), (0, (1 - post) * n)):
            for j in range(k):
                got = np.array([w[votes[:, j] == v].sum() for v in range(3)])
                rates[c, j] = (got + 1.0) / (got.sum() + 3.0)
        for v, (hi, lo) in ((1, (1, 0)), (0, (0, 1))):
            wrong = rates[lo, :, v] > rates[hi, :, v]
            mean = (rates[lo, :, v] + rates[hi, :, v]) / 2
            rates[lo, :, v] = np.where(wrong, mean, rates[lo, :, v])
            rates[hi, :, v] = np.where(wrong, mean, rates[hi, :, v])
        rates = np.maximum(rates, floor)
        rates /= rates.sum(2, keepdims=True)
        prior = float(np.clip((post * n).sum() / max(n.sum(), 1.0), 1e-4, 0.5))
        if abs(prior - before) < 1e-9:
            break
    return dict(zip(patterns, post.tolist()))


def best_cutoff(found: list[tuple[float, bool]], grid: int = 20) -> tuple[float, float, float]:
    """(cutoff, precision, recall): of the cutoffs 1 / grid, 2 / grid, ... that of the greatest F1 over (posterior,
    truth), of equal ones the middle one."""
    posterior, truth = np.array([p for p, _ in found]), np.array([t for _, t in found], dtype=bool)
    rows = []
    for i in range(1, grid):
        kept = posterior > i / grid
        both = float((kept & truth).sum())
        rows.append(
            (
                2 * both / max(1.0, kept.sum() + truth.sum()),
                i / grid,
                both / max(1.0, float(kept.sum())),
                both / max(1.0, float(truth.sum()))
            )
        )
    top = max(r[0] for r in rows)
    best = [r for r in rows if r[0] == top]
    return best[len(best) // 2][1:]
