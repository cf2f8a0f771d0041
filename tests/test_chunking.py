"""Partitions of planted segments, and the chances of partitions of three against their sum."""

import itertools
import math

import numpy as np

from relspan.plans import chunking
from relspan.plans.chunking import Settings, partition


def test_planted_parts():
    rng = np.random.default_rng(1)
    of = np.repeat([0, 1, 2], [5, 4, 6])
    sim = np.where(np.equal.outer(of, of), rng.beta(9, 3, (15, 15)), rng.beta(2, 9, (15, 15)))
    sim = (sim + sim.T) / 2
    found, share = partition(sim, np.zeros((15, 15)), np.zeros((15, 15)), Settings(burn=100, samples=50, refit=50))
    assert np.array_equal(np.equal.outer(found, found), np.equal.outer(of, of)) and share.shape == (15, 15)
    assert partition(np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))[0] == [] and partition(np.eye(1), np.eye(1), np.eye(1))[0] == [0]


def test_shares_are_those_of_all_partitions():
    sim = np.array([[1.0, 0.5, 0.3], [0.5, 1.0, 0.35], [0.3, 0.35, 1.0]])
    ref = np.array([[0.0, 0, 1], [0, 0, 0], [1, 0, 0]])
    how = Settings(concentration=0.7, burn=200, samples=4000, thin=2, refit=10**9)
    _, share = partition(sim, np.zeros((3, 3)), ref, how)
    mix = 0.1
    w = np.clip((1 - mix) * sim, 1e-9, 1 - 1e-9)
    gain = chunking._log_beta(w, chunking.SAME) - chunking._log_beta(w, chunking.DIFFERENT) + math.log(how.boost) * ref
    total, pairs = 0.0, np.zeros((3, 3))
    for z in {(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (0, 1, 2)}:
        p = math.prod(how.concentration * math.factorial(z.count(k) - 1) for k in set(z))
        p *= math.exp(sum(gain[i, j] for i, j in itertools.combinations(range(3), 2) if z[i] == z[j]))
        total += p
        pairs += p * np.equal.outer(z, z)
    assert np.allclose(share, pairs / total, atol=0.03)
