"""Two-group mixtures that borrow from a source, and the alignment of groups across datasets.

A step is one aggregate over the rows; means and directions, vectors of d numbers,
live on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.factors import log_odds, logistic_sums, responsibility, spherical_em
from spindrift.operators.linalg import dot, literal_vector
from spindrift.operators.metrics import assign_labels


def first_rows(obs: DataFrame, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two rows drawn by a hash of their id, to start from."""
    got = obs.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").select("features").limit(2).collect()
    if len(got) < 2:
        raise ValueError("at least two rows are needed")
    return np.array(got[0][0]), np.array(got[1][0])


def align_sign(direction: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The direction, turned so that it doesn't point against the reference."""
    return direction if float(direction @ reference) >= 0 else -direction


def source_pair(source: DataFrame, reference: np.ndarray, sigma2: float, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Means of the source's two groups, named so that they differ along the target's reference direction."""
    mu0, mu1, _ = spherical_em(source, first_rows(source, seed), sigma2, rounds)
    half = align_sign(mu1 - mu0, reference) / 2
    mid = (mu0 + mu1) / 2
    return mid - half, mid + half


def shrunk_means(target: DataFrame, pair: tuple[np.ndarray, np.ndarray], sigma2: float, source_sigma2: float, weight: float, rounds: int = 20, seed: int = 0) -> Column:
    """Signs of the target by EM whose means are averaged with the source's, by precision and ``weight``; weight 0 leaves the target alone."""
    mu0, mu1 = first_rows(target, seed)
    own, other, share = 1 / sigma2, weight / source_sigma2, 0.5
    for _ in range(rounds):
        n, n1, s1, s = logistic_sums(target, *log_odds(mu0, mu1, share, sigma2))
        mu1 = (own * s1 / max(n1, 1e-8) + other * pair[1]) / (own + other)
        mu0 = (own * (s - s1) / max(n - n1, 1e-8) + other * pair[0]) / (own + other)
        share = min(max(n1 / n, 1e-6), 1 - 1e-6)
    return F.when(responsibility(mu0, mu1, share, sigma2) > 0.5, 1).otherwise(-1)


def shrunk_direction(target: DataFrame, pair: tuple[np.ndarray, np.ndarray], sigma2: float, source_sigma2: float, decay: float = 0.5, growth: float = 0.1, rounds: int = 20) -> Column:
    """Signs of the target by EM whose discriminant direction is drawn towards the source's.

    The penalty of a round is ``decay`` times the last one plus ``growth`` sqrt(d),
    divided by sqrt(n).  Starts from the source's means.
    """
    mu0, mu1 = pair
    d, share, penalty = len(mu0), 0.5, 0.0
    centre = (mu1 - mu0) / source_sigma2
    beta = centre
    offset = lambda: -float(beta @ (mu0 + mu1) / 2) - math.log((1 - share) / share)
    for _ in range(rounds):
        n, n1, s1, s = logistic_sums(target, beta, offset())
        mu1, mu0 = s1 / max(n1, 1e-8), (s - s1) / max(n - n1, 1e-8)
        share = min(max(n1 / n, 1e-6), 1 - 1e-6)
        penalty = decay * penalty + growth * math.sqrt(d)
        gap = (mu1 - mu0) / sigma2 - centre
        beta = centre + gap * max(0.0, 1 - penalty / math.sqrt(n) / (sigma2 * max(float(np.linalg.norm(gap)), 1e-12)))
    return F.when(dot(F.col("features"), literal_vector(beta)) + offset() > 0, 1).otherwise(-1)


def contrast_vectors(means: np.ndarray, sigma2: float, reference: int = 0) -> np.ndarray:
    """Differences of the other groups' means from the reference group's, divided by the variance."""
    return (np.delete(means, reference, 0) - means[reference]) / sigma2


def align_groups(means: np.ndarray, sigma2: float, others: Sequence[np.ndarray]) -> tuple[list[int], float]:
    """(order, cost): the order of a dataset's groups that brings its contrasts nearest to those of other datasets.

    Each group is tried as reference; the rest are matched one to one.  Exact over all orders.
    """
    best: tuple[list[int], float] = ([], math.inf)
    for ref in range(len(means)):
        mine = contrast_vectors(means, sigma2, ref)
        cost = sum(np.linalg.norm(mine[:, None] - o[None], axis=2) for o in others)
        to = assign_labels(-cost)
        total = float(cost[np.arange(len(to)), to].sum())
        if total < best[1]:
            rest = [i for i in range(len(means)) if i != ref]
            best = [ref, *(rest[i] for i in np.argsort(to))], total
    return best


def alignment_score(contrasts: Sequence[np.ndarray]) -> float:
    """Summed distances between the contrasts of every two datasets, group by group."""
    return float(sum(np.linalg.norm(a - b, axis=1).sum() for i, a in enumerate(contrasts) for b in contrasts[i + 1 :]))
