"""A partition of text segments by Gibbs sampling over their similarities, adjacency and references."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from relspan.plans.merging import clusters

# What betas of pairs in one part and in two begin with, and how far weights stay from 0 and 1.
SAME, DIFFERENT, EDGE = (4.0, 2.0), (1.5, 6.0), 1e-9


@dataclass(frozen=True)
class Settings:
    """concentration: how ready a segment is to be a part of its own. boost: what a reference multiplies the odds by.

    burn sweeps are left out, then every thin-th of samples * thin is counted;
    betas are fitted anew every `refit` sweeps.
    """

    concentration: float = 0.5
    boost: float = 5.0
    burn: int = 2000
    samples: int = 2000
    thin: int = 5
    refit: int = 100
    seed: int = 42


def _log_beta(x: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    a, b = ab
    return (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)


def _fitted(x: np.ndarray, before: tuple[float, float]) -> tuple[float, float]:
    """A beta with the mean and variance of x, neither parameter below 1; what was before, if x is too little."""
    if len(x) < 2:
        return before
    m = float(np.clip(x.mean(), 1e-6, 1 - 1e-6))
    v = float(x.var())
    most = m * (1 - m)
    k = most / (v if 0 < v < most else 0.999 * most) - 1
    return max(m * k, 1.0), max((1 - m) * k, 1.0)


def partition(similarity: np.ndarray, adjacency: np.ndarray, references: np.ndarray, how: Settings = Settings()) -> tuple[list[int], np.ndarray]:
    """(part of each segment, named by its first segment; how often each pair shared a part).

    A pair's weight mixes adjacency and similarity by their ranges; weights are
    of one beta within a part and another across. A sweep takes each segment out
    and draws its part again: parts count by their size, and by how much likelier
    the weights to their members are within a part, references included. The
    parts returned agree best with the shares of pairs (see merging.clusters).
    """
    n = len(similarity)
    if n < 2:
        return list(range(n)), np.eye(n)
    rng, upper = np.random.default_rng(how.seed), np.triu_indices(n, 1)
    spread = [float(np.ptp(m)) for m in (adjacency, similarity)]
    mix = float(np.clip(spread[0] / (sum(spread) + EDGE), 0.1, 0.9))
    weight = np.clip(mix * adjacency + (1 - mix) * similarity, EDGE, 1 - EDGE)
    same, different = SAME, DIFFERENT
    bonus = math.log(how.boost) * references

    def odds() -> np.ndarray:
        out = _log_beta(weight, same) - _log_beta(weight, different) + bonus
        np.fill_diagonal(out, 0.0)
        return out

    part, gain, shared, counted = np.arange(n), odds(), np.zeros((n, n)), 0
    for sweep in range(how.burn + how.samples * how.thin):
        for i in rng.permutation(n).tolist():
            part[i] = -1
            size = np.bincount(part[part >= 0], minlength=n)
            pull = np.bincount(part[part >= 0], gain[i][part >= 0], n)
            fresh = int(np.flatnonzero(size == 0)[0])
            with np.errstate(divide="ignore"):
                score = np.where(size > 0, np.log(size) + pull, -np.inf)
            score[fresh] = math.log(how.concentration)
            p = np.exp(score - score.max())
            part[i] = min(int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random(), "right")), n - 1)
        together = np.equal.outer(part, part)
        if sweep and sweep % how.refit == 0:
            inside = together[upper]
            same, different = _fitted(weight[upper][inside], same), _fitted(weight[upper][~inside], different)
            gain = odds()
        if sweep >= how.burn and (sweep - how.burn) % how.thin == 0:
            shared += together
            counted += 1
    share = shared / max(counted, 1)
    np.fill_diagonal(share, -np.inf)
    found = clusters(share)
    np.fill_diagonal(share, 1.0)
    return found, share
