"""Entities of several shards that are the same: a mixture of similarities, clusters by correlation, votes and merged links.

These run on the driver: an entity is a table of a specification, not a row.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP, FEWEST, SAME_NAME = 1e-6, 10, 0.95


@dataclass(frozen=True)
class Mixture:
    """Two beta distributions over similarities: of different entities, and with weight `share` of the same one."""

    share: float
    same: tuple[float, float]
    different: tuple[float, float]

    def _terms(self) -> list[tuple[float, float, float]]:
        out = []
        for w, (a, b) in ((self.share, self.same), (1 - self.share, self.different)):
            out.append((math.log(w) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b), a - 1, b - 1))
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """The probability that a similarity is of the same entity. Beyond the greater mean it does not fall, below the lesser it does not rise."""
        x = np.clip(np.asarray(x, float), *self._bounds())
        s, d = (c + p * np.log(x) + q * np.log1p(-x) for c, p, q in self._terms())
        return 1 / (1 + np.exp(np.clip(d - s, -700, 700)))

    def column(self, x: Column) -> Column:
        """posterior() of a column; null for null."""
        low, high = self._bounds()
        x = F.when(x < low, low).when(x > high, high).otherwise(x.cast("double"))
        s, d = (F.lit(c) + F.lit(p) * F.ln(x) + F.lit(q) * F.log1p(-x) for c, p, q in self._terms())
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(d - s, F.lit(-700.0)), F.lit(700.0))))
        return F.when(x.isNotNull(), p)  # least() and greatest() pass over nulls

    def _bounds(self) -> tuple[float, float]:
        """Where the log ratio of the two is monotone between their means, and no further."""
        (a, b), (c, d) = self.same, self.different
        low, high = CLIP, 1 - CLIP
        p, q = a - c, b - d  # the log ratio's slope is p / x - q / (1 - x)
        if p * q > 0 and 0 < p / (p + q) < 1:
            turn = p / (p + q)
            middle = (a / (a + b) + c / (c + d)) / 2
            low, high = (max(low, turn), high) if turn < middle else (low, min(high, turn))
        return low, high


def _moments(x: np.ndarray, w: np.ndarray, floor: float = 1e-4) -> tuple[float, float]:
    m = float(np.average(x, weights=w))
    v = max(float(np.average((x - m) ** 2, weights=w)), floor * m * (1 - m))
    k = max(m * (1 - m) / v - 1, 2.0)
    return m * k, (1 - m) * k


def mixture(x: np.ndarray, rounds: int = 50, floor: float = 1e-4, start: float | None = None) -> Mixture | None:
    """Fitted by rounds of weights and moments from the split at the widest gap of the upper half, or at the quantile `start`.

    floor: the least variance of a part, as a share of the greatest that its mean allows.

    None if there are too few similarities, all are alike, or the two means are
    within 0.05: nothing can be told then.
    """
    x = np.sort(np.clip(np.asarray(x, float)[np.isfinite(x)], CLIP, 1 - CLIP))
    if len(x) < FEWEST or np.ptp(x) < 1e-9:
        return None
    middle = len(x) // 2
    at = middle + int(np.argmax(np.diff(x[middle:]))) + 1 if len(x) - middle > 1 else middle
    at = at if start is None else int(start * len(x))
    w = (np.arange(len(x)) >= at).astype(float)
    found = None
    for _ in range(rounds):
        if not 0 < w.sum() < len(x):
            return None
        found = Mixture(float(np.clip(w.mean(), 0.01, 0.99)), _moments(x, w, floor), _moments(x, 1 - w, floor))
        new = found.posterior(x)
        if np.max(np.abs(new - w)) < 1e-9:
            break
        w = new
    mean = lambda ab: ab[0] / (ab[0] + ab[1])
    return found if mean(found.same) - mean(found.different) > 0.05 else None


#: Settings of an ensemble: least variances, and where the fit starts.
FLOORS, STARTS = (1e-4, 1e-3, 1e-2), (None, 0.6, 0.75, 0.9)


@dataclass(frozen=True)
class Ensemble:
    """Mixtures that agree or not: their mean decides."""

    fits: tuple[Mixture, ...]

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return np.mean([f.posterior(x) for f in self.fits], axis=0)

    def column(self, x: Column) -> Column:
        return sum((f.column(x) for f in self.fits[1:]), self.fits[0].column(x)) / F.lit(float(len(self.fits)))


def ensemble(x: np.ndarray) -> Ensemble | None:
    """A fit for each setting of FLOORS and STARTS that can tell anything; None if none can."""
    fits = [mixture(x, floor=f, start=s) for f in FLOORS for s in STARTS]
    fits = [f for f in fits if f is not None]
    return Ensemble(tuple(fits)) if fits else None


def cross_flags(similarity: np.ndarray, names: list[str], kinds: list[str]) -> list[tuple[str, str, float]]:
    """Pairs of names of different kinds, as an entity and an attribute, that are rather the same than not, and how sure that is; surest first."""
    i, j = np.nonzero(np.triu(np.ones((len(names), len(names)), bool), 1))
    fit = ensemble(np.asarray(similarity, float)[i, j]) if len(i) else None
    if fit is None:
        return []
    p = fit.posterior(np.asarray(similarity, float)[i, j])
    out = [(names[a], names[b], float(q)) for a, b, q in zip(i.tolist(), j.tolist(), p, strict=True) if kinds[a] != kinds[b] and q > 0.5]
    return sorted(out, key=lambda x: (-x[2], x[0], x[1]))


def same_probability(similarity: np.ndarray, shards: list[int], names: list[str]) -> np.ndarray:
    """A matrix: posteriors of pairs of different shards, 0.5 where no mixture fits, at least SAME_NAME for equal names; -inf within a shard."""
    n = len(shards)
    apart = np.not_equal.outer(shards, shards)
    i, j = np.nonzero(np.triu(apart, 1))
    fit = ensemble(np.asarray(similarity, float)[i, j]) if len(i) else None
    out = np.full((n, n), -np.inf)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        p = 0.5 if fit is None else float(fit.posterior(similarity[a][b]))
        out[a, b] = out[b, a] = max(p, SAME_NAME) if names[a] == names[b] else p
    return out


def clusters(p: np.ndarray) -> list[int]:
    """The cluster of each entity, named by its least member: the pair of clusters whose sum of p - 0.5 is greatest is merged while that is positive.

    Clusters with a pair of -inf between them never merge. Ties go to the least pair.
    """
    gain = np.where(np.isneginf(p), -np.inf, p - 0.5).astype(float)
    np.fill_diagonal(gain, -np.inf)
    of = list(range(len(p)))
    while len(gain) and (best := float(np.max(gain))) > 0:
        a, b = sorted(divmod(int(np.argmax(gain == best)), len(gain)))
        gain[a], gain[:, a] = gain[a] + gain[b], gain[:, a] + gain[:, b]
        gain[a, a] = gain[b, :] = gain[:, b] = -np.inf
        of = [a if c == b else c for c in of]
    return of


def tensions(p: np.ndarray, of: list[int]) -> list[tuple[str, int, int]]:
    """Pairs that their probability and their clusters tell apart: "vetoed" likely the same but apart, "forced" unlikely but together."""
    out = []
    for i, j in combinations(range(len(of)), 2):
        if not np.isneginf(p[i, j]):
            if p[i, j] > 0.5 and of[i] != of[j]:
                out.append(("vetoed", i, j))
            elif p[i, j] < 0.5 and of[i] == of[j]:
                out.append(("forced", i, j))
    return out


def voted(identifiers: list[tuple[str, ...]]) -> tuple[tuple[str, ...], bool]:
    """(identifier, agreed): the one that most members state, ties to the least; empty ones have no vote."""
    votes = Counter(i for i in identifiers if i)
    return (min(votes, key=lambda k: (-votes[k], k)), len(votes) == 1) if votes else ((), True)


def merged_links(links: list[dict], names: dict[str, str]) -> tuple[list[dict], list[str]]:
    """Links {"name", "kind", "participants", "facts"} under merged names, each (name, participants) once with all facts, and those of several kinds."""
    out: dict[tuple, dict] = {}
    flags = []
    for x in links:
        participants = tuple(sorted(names.get(p, p) for p in x["participants"]))
        kept = out.setdefault((x["name"], participants), {**x, "participants": participants, "facts": []})
        kept["facts"] = sorted({*kept["facts"], *x["facts"]})
        if kept["kind"] != x["kind"]:
            flags.append(f"{x['name']}: {kept['kind']} and {x['kind']}")
    return list(out.values()), flags


def kept_dependencies(dependencies: list[tuple[tuple[str, ...], str]], columns: set[str]) -> list[tuple[tuple[str, ...], str]]:
    """Dependencies all of whose columns are there, each once, in order."""
    return list(dict.fromkeys((tuple(left), right) for left, right in dependencies if {*left, right} <= columns))
