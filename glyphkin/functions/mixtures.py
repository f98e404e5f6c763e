"""Gaussian mixtures and normality tests in numpy: kernels of glyph clustering."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def principal_components(x: np.ndarray, keep: float | int = 0.9) -> np.ndarray:
    """Scores on the leading components: so many, or as many as explain that share of the variance."""
    y = x - x.mean(0)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    if isinstance(keep, int):
        k = min(keep, len(s))
    else:
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        k = min(len(s), int(np.searchsorted(share, keep, side="right")) + 1)
    return u[:, :k] * s[:k]


def spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k points, each new one drawn in proportion to its squared distance from those before (k-means++)."""
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and d.sum() > 0:
        chosen.append(int(rng.choice(len(x), p=d / d.sum())))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first on ties, and the squared distance."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    i = d.argmin(1)
    return i, np.maximum(d[np.arange(len(x)), i], 0)


def kmeans(x: np.ndarray, k: int, most: int = 100, tolerance: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Labels, centres and the loss of each round; empty clusters are dropped."""
    labels, _ = nearest(x, spread_seeds(x, k, np.random.default_rng(seed)))
    losses: list[float] = []
    centres = x[:1]
    for _ in range(most):
        held, labels = np.unique(labels, return_inverse=True)
        sums = np.zeros((len(held), x.shape[1]))
        np.add.at(sums, labels, x)
        centres = sums / np.bincount(labels)[:, None]
        labels, d = nearest(x, centres)
        losses.append(float(d.sum()))
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) <= tolerance * abs(losses[-2]):
            break
    return labels, centres, losses


def shrunk(cov: np.ndarray, n: float) -> np.ndarray:
    """Oracle approximating shrinkage of a covariance estimated from n points; never singular."""
    d = len(cov)
    trace, trace2 = np.trace(cov), (cov * cov).sum()
    below = (n + 1 - 2 / d) * (trace2 - trace**2 / d)
    rho = ((1 - 2 / d) * trace2 + trace**2) / below if below else math.inf if trace2 else 0.0
    rho = min(max(rho, 0.0), 1.0)
    out = (1 - rho) * cov + rho * trace / d * np.eye(d)
    return out + 1e-5 * np.eye(d) if rho == 0 else out


def lower_root(cov: np.ndarray, jitter: float = 1e-6) -> np.ndarray:
    """Cholesky factor, with more and more of the identity added until there is one."""
    add = 0.0
    while True:
        try:
            return np.linalg.cholesky(cov + add * np.eye(len(cov)))
        except np.linalg.LinAlgError:
            add = add * 10 + jitter


class Mixture:
    """Weights, means and covariances of Gaussians; fitted by expectation maximisation from k-means."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> None:
        self.weights, self.means, self.covs = weights, means, covs
        self.history: list[float] = []

    @classmethod
    def of(cls, x: np.ndarray, share: np.ndarray, least: float = 2.0) -> Mixture:
        """From the share (component, point) that each component has in each point; components under `least` go."""
        mass = share.sum(1)
        share, mass = share[mass >= least], mass[mass >= least]
        if not len(mass):
            share, mass = np.ones((1, len(x))), np.array([float(len(x))])
        means = share @ x / mass[:, None]
        weights = mass / mass.sum()
        covs = np.stack([shrunk(((x - m) * w[:, None]).T @ (x - m) / z, p * len(x)) for m, w, z, p in zip(means, share, mass, weights)])
        return cls(weights, means, covs)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(component, point) log of weight times density."""
        out = []
        for p, m, c in zip(self.weights, self.means, self.covs):
            root = lower_root(c)
            z = np.linalg.solve(root, (x - m).T)
            out.append(np.log(p) - 0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi))
        return np.stack(out)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """The components' shares in each point, and the log likelihood of all points."""
        logs = self.log_density(x)
        top = logs.max(0)
        total = top + np.log(np.exp(logs - top).sum(0))
        return np.exp(logs - total), float(total.sum())

    @classmethod
    def fit(cls, x: np.ndarray, k: int, most: int = 100, tolerance: float = 1e-6, seed: int = 0) -> tuple[Mixture, np.ndarray]:
        """The mixture and each point's likeliest component; one component where all points are equal."""
        x = np.asarray(x, float)
        if (x == x[0]).all():
            return cls(np.ones(1), x[:1].copy(), np.eye(x.shape[1])[None]), np.zeros(len(x), int)
        labels, _, _ = kmeans(x, k, most, tolerance, seed)
        share = np.eye(labels.max() + 1)[:, labels]
        history: list[float] = []
        for _ in range(most):
            model = cls.of(x, share)
            share, fit = model.shares(x)
            history.append(fit)
            if len(history) > 1 and abs(history[-2] - history[-1]) <= tolerance * abs(history[-2]):
                break
        model = cls.of(x, share)
        model.history = history
        return model, share.argmax(0)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in np.ravel(z)])


# The published table of p-values of the modified statistic, as (lower bound, constant, linear,
# quadratic); the two lower pieces give 1 - p.
ANDERSON_PIECES = ((0.6, 1.2937, -5.709, -0.0186), (0.34, 0.9177, -4.279, -1.38), (0.2, -8.318, 42.796, -59.938), (-math.inf, -13.436, 101.14, -223.73))


def anderson_darling(x: np.ndarray) -> float:
    """p-value of normality with mean and variance estimated; 1 for constant samples."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    spread = x.std(ddof=1) if n > 1 else 0.0
    if spread == 0:
        return 1.0
    z = (x - x.mean()) / spread
    below, above = np.clip(normal_cdf(z), 1e-300, 1), np.clip(normal_cdf(-z), 1e-300, 1)
    i = np.arange(1, n + 1)
    a = -n - ((2 * i - 1) / n * (np.log(below) + np.log(above[::-1]))).sum()
    a *= 1 + 0.75 / n + 2.25 / n**2
    for k, (low, c0, c1, c2) in enumerate(ANDERSON_PIECES):
        if a >= low and not (k == 2 and a == low):
            value = math.exp(c0 + c1 * a + c2 * a * a)
            return value if k < 2 else 1 - value
    raise AssertionError


def kolmogorov_smirnov(x: np.ndarray) -> float:
    """Asymptotic p-value against the standard normal distribution."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    f = normal_cdf(x)
    d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    t = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def dagostino_pearson(x: np.ndarray) -> float:
    """p-value of skewness and kurtosis together; the chi-squared tail with two degrees of freedom is exp(-s / 2)."""
    x = np.asarray(x, float)
    n = len(x)
    c = x - x.mean()
    m2 = (c**2).mean()
    if m2 == 0 or n < 8:
        return 1.0
    skew, kurt = (c**3).mean() / m2**1.5, (c**4).mean() / m2**2
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    a = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y / a) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    z = (kurt - mean) / math.sqrt(var)
    s1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s1 * (2 / s1 + math.sqrt(1 + 4 / s1**2))
    base = (1 - 2 / a) / (1 + z * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


# Published polynomials of the approximation, highest power first.
SHAPIRO_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
SHAPIRO_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
SHAPIRO_LARGE = ((0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803))
SHAPIRO_SMALL = ((-0.0006714, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822))


def shapiro_wilk(x: np.ndarray) -> float:
    """p-value of the W test by Royston's approximation; 1 for fewer than 4 values or constant samples."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 1.0
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = float(m @ m), 1 / math.sqrt(n)
    a = m.copy()
    last = np.polyval((*SHAPIRO_LAST, 0), u) + m[-1] / math.sqrt(total)
    if n > 5:
        second = np.polyval((*SHAPIRO_NEXT, 0), u) + m[-2] / math.sqrt(total)
        a /= math.sqrt((total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[1], a[-2] = -second, second
    else:
        a /= math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[0], a[-1] = -last, last
    w = min(1 - 1e-15, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n > 11:
        log = math.log(n)
        y, mean, spread = math.log(1 - w), np.polyval(SHAPIRO_LARGE[0], log), math.exp(np.polyval(SHAPIRO_LARGE[1], log))
    else:
        room = -2.273 + 0.459 * n - math.log(1 - w)
        if room <= 0:
            return 0.0
        y, mean, spread = -math.log(room), np.polyval(SHAPIRO_SMALL[0], n), math.exp(np.polyval(SHAPIRO_SMALL[1], n))
    return float(normal_cdf(-np.array([(y - mean) / spread]))[0])


NORMALITY = {"ad": anderson_darling, "ks": kolmogorov_smirnov, "dp": dagostino_pearson, "sw": shapiro_wilk}

#: Two-sided chance of two standard deviations, 2 (1 - Phi(2)).
SPLIT_BELOW = math.erfc(2 / math.sqrt(2))
