"""Criteria for splits and columns, over numpy arrays of one node's rows. A split of sorted values puts positions 0..i to the left."""

from __future__ import annotations

import numpy as np


def midpoint(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Half way, and always below the upper value, so that `x <= midpoint` keeps it on the right."""
    mid = low + (high - low) / 2
    return np.where(mid < high, mid, np.nextafter(high, -np.inf))


def _moments(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights and standard deviations left and right of every cut between different neighbours, and where those cuts are."""
    at = np.flatnonzero(x[1:] > x[:-1])
    largest = max(abs(x[0]), abs(x[-1]))
    x = x / largest if largest > 1e100 else x  # gains are ratios; squares must not overflow
    c = x - np.average(x, weights=w)
    cw, c1, c2 = np.cumsum(w), np.cumsum(w * c), np.cumsum(w * c * c)
    nl, nr = cw[at], cw[-1] - cw[at]
    vl = c2[at] / nl - (c1[at] / nl) ** 2
    vr = (c2[-1] - c2[at]) / nr - ((c1[-1] - c1[at]) / nr) ** 2
    return at, nl, nr, np.sqrt(np.maximum(vl, 0)), np.sqrt(np.maximum(vr, 0)), np.sqrt(max(0.0, c2[-1] / cw[-1] - (c1[-1] / cw[-1]) ** 2))


def best_numeric(x: np.ndarray, w: np.ndarray, criterion: str, others: np.ndarray | None = None) -> tuple[float, float] | None:
    """Gain and threshold of the best cut of x by "avg", "pooled", "full" or "dens"; None if x has one value.

    avg: 1 - (sd_l + sd_r) / (2 sd). pooled: 1 - (n_l sd_l + n_r sd_r) / (n sd). full: share of the variance of all columns
    (others, rows alike) that the cut explains. dens: (p_l^2 / r_l + p_r^2 / r_r) - 1 with shares of rows p and of range r.
    Equal gains go to the cut nearest to the middle of the rows.
    """
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    if len(x) < 2 or x[0] == x[-1]:
        return None
    at, nl, nr, sl, sr, sd = _moments(x, w)
    n = nl + nr
    cuts = midpoint(x[at], x[at + 1])
    if criterion == "avg":
        gain = 1 - (sl + sr) / (2 * sd)
    elif criterion == "pooled":
        gain = 1 - (nl * sl + nr * sr) / (n * sd)
    elif criterion == "dens":
        rl = (cuts - x[0]) / (x[-1] - x[0])
        rl = np.clip(rl, 1e-12, 1 - 1e-12)
        gain = (nl / n) ** 2 / rl + (nr / n) ** 2 / (1 - rl) - 1
    else:
        m = others[order]
        m = np.where(np.isnan(m), np.nanmean(m, axis=0), m)
        m = m - np.average(m, axis=0, weights=w)
        s = np.cumsum(w[:, None] * m, axis=0)
        between = (s[at] ** 2 / nl[:, None] + (s[-1] - s[at]) ** 2 / nr[:, None]).sum(axis=1)
        total = (w[:, None] * m * m).sum()
        gain = between / total if total > 0 else np.zeros(len(at))
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = best[np.argmin(np.abs(nl[best] - n[best] / 2))]
    return float(gain[k]), float(cuts[k])


def expected_sd(counts: np.ndarray) -> float:
    """Standard deviation expected of a categorical column whose levels take values drawn from U(0, 1)."""
    p = counts / counts.sum()
    pairs = (p.sum() ** 2 - (p * p).sum()) / 2
    return float(np.sqrt(max(0.0, (p / 3 - p * p / 3).sum() - pairs / 2)))


def best_single(counts: np.ndarray, criterion: str = "pooled") -> tuple[float, int] | None:
    """Gain and code of the level to isolate, the smallest code among equals.

    By density it is the level whose isolation gains most; otherwise the most frequent one, with the averaged or the pooled gain. A
    level by itself has no spread.
    """
    present = np.flatnonzero(counts)
    if len(present) < 2:
        return None
    if criterion == "dens":
        p, share = counts[present] / counts.sum(), 1 / len(present)
        gains = p**2 / share + (1 - p) ** 2 / (1 - share) - 1
        at = int(np.flatnonzero(gains >= gains.max() - 1e-12)[0])
        return float(gains[at]), int(present[at])
    k = int(present[np.argmax(counts[present])])
    rest = counts.copy()
    rest[k] = 0
    sd = expected_sd(counts)
    weight = 0.5 if criterion == "avg" else rest.sum() / counts.sum()
    return (1 - weight * expected_sd(rest) / sd if sd > 0 else 0.0), k


#: Most present levels of which all subsets are tried.
MOST_PERM = 12


def best_subset(counts: np.ndarray, criterion: str, all_perm: bool, most_perm: int = MOST_PERM) -> tuple[float, np.ndarray] | None:
    """Gain and left mask over codes: levels are sorted by count and cut, or all subsets of the present levels are tried.

    With all_perm, more than most_perm present levels are refused.
    """
    present = np.flatnonzero(counts)
    if len(present) < 2:
        return None
    order = present[np.argsort(counts[present], kind="stable")]
    k = len(order)
    if all_perm and k > most_perm:
        raise ValueError(f"all_perm tries all subsets of at most {most_perm} levels, and a node has {k}; merge levels or set all_perm=False")
    if all_perm:
        choices = [order[[i for i in range(k) if bits >> i & 1]] for bits in range(1, 1 << (k - 1))]
    else:
        choices = [order[: i + 1] for i in range(k - 1)]
    total, sd, best = counts.sum(), expected_sd(counts), None
    for left in choices:
        l_counts = np.zeros_like(counts)
        l_counts[left] = counts[left]
        r_counts = counts - l_counts
        nl, nr = l_counts.sum(), r_counts.sum()
        if criterion == "dens":
            share = len(left) / k
            gain = (nl / total) ** 2 / share + (nr / total) ** 2 / (1 - share) - 1
        elif sd <= 0:
            gain = 0.0
        elif criterion == "avg":
            gain = 1 - (expected_sd(l_counts) + expected_sd(r_counts)) / (2 * sd)
        else:
            gain = 1 - (nl * expected_sd(l_counts) + nr * expected_sd(r_counts)) / (total * sd)
        if best is None or gain > best[0] + 1e-12:
            mask = np.zeros(len(counts), bool)
            mask[left] = True
            best = (float(gain), mask)
    return best


def kurtosis(x: np.ndarray, w: np.ndarray) -> float:
    """Raw: n M4 / M2^2; 0 for a constant."""
    x, w = x[~np.isnan(x)], w[~np.isnan(x)]
    if len(x) < 2:
        return 0.0
    d = x - np.average(x, weights=w)
    m2 = np.average(d**2, weights=w)
    return float(np.average(d**4, weights=w) / m2**2) if m2 > 0 else 0.0


def categorical_kurtosis(counts: np.ndarray, split: str, rng: np.random.Generator, draws: int = 50) -> float:
    """Mean over draws of U(0, 1) values for the levels (subset), or over the levels' one-against-rest indicators (single)."""
    counts = counts[counts > 0]
    if len(counts) < 2:
        return 0.0
    p = counts / counts.sum()
    if split == "single_categ":
        return float(np.mean((1 - 3 * p * (1 - p)) / (p * (1 - p))))
    v = rng.random((draws, len(p)))
    d = v - (v * p).sum(axis=1, keepdims=True)
    m2 = (p * d**2).sum(axis=1)
    return float(np.mean((p * d**4).sum(axis=1) / np.maximum(m2, 1e-300) ** 2))
