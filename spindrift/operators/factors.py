"""Non-negative factors and mixture steps over observations.

The small factor (k x d) lives on the driver and travels to the tasks; the large one
(a row of k numbers per observation) stays with its rows.  A round is one pass that
updates the rows' coefficients and returns the k x d and k x k sums from which the
small factor follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.linalg import dot, literal_vector
from spindrift.session import cut

_TINY = 1e-12


def coefficients(x: np.ndarray, w: np.ndarray, rounds: int = 50, l1: float = 0.0) -> np.ndarray:
    """Non-negative h with h w near x for every row, by multiplicative steps; rows don't depend on each other."""
    h = np.maximum(x @ w.T, _TINY)
    gram, top = w @ w.T, x @ w.T
    for _ in range(rounds):
        h = h * top / np.maximum(h @ gram + l1, _TINY)
    return h


def fit_factors(obs: DataFrame, k: int, rounds: int = 100, seed: int = 0, tol: float = 1e-3) -> tuple[np.ndarray, list[float]]:
    """The factor w (k, d) of non-negative rows, and the squared error before each round.

    Starts from k rows drawn by a hash of their id.  Ends when a round lowers the error
    by no more than ``tol`` of it, after ``rounds`` at most.
    """
    few = obs.orderBy(F.xxhash64("row_id", F.lit(seed))).limit(k).toPandas()
    w = np.maximum(np.stack(few["features"].to_numpy()), 1e-3)
    if len(w) < k:
        raise ValueError(f"{len(w)} rows are too few for {k} factors")
    d, errors = w.shape[1], []
    for _ in range(rounds):
        fixed = w

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, b, e = np.zeros((k, d)), np.zeros((k, k)), 0.0
            for part in batches:
                x = np.stack(part["features"].to_numpy()) if len(part) else np.zeros((0, d))
                h = coefficients(x, fixed)
                a, b, e = a + h.T @ x, b + h.T @ h, e + ((x - h @ fixed) ** 2).sum()
            yield pd.DataFrame({"i": np.arange(k), "a": list(a), "b": list(b), "e": e})

        got = obs.select("features").mapInPandas(add, "i int, a array<double>, b array<double>, e double")
        sums = got.groupBy("i").agg(F.array(*[F.sum(F.col("a")[j]) for j in range(d)]).alias("a"), F.array(*[F.sum(F.col("b")[j]) for j in range(k)]).alias("b"), F.sum("e").alias("e")).orderBy("i").collect()
        a, b = np.array([r["a"] for r in sums]), np.array([r["b"] for r in sums])
        errors.append(float(sums[0]["e"]))
        if len(errors) > 1 and errors[-2] - errors[-1] <= tol * errors[-2]:
            break
        w = w * a / np.maximum(b @ w, _TINY)
        # The scale of a factor moves into its coefficients.
        w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), _TINY)
    return w, errors


def save_factors(spark: SparkSession, w: np.ndarray, path: str) -> None:
    """Keep a factor (k, d) as a table (component, values)."""
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(w)], "component int, values array<double>").write.mode("overwrite").parquet(path)


def load_factors(spark: SparkSession, path: str) -> np.ndarray:
    """A factor kept by ``save_factors``."""
    return np.array([r["values"] for r in spark.read.parquet(path).orderBy("component").collect()])


def transfer_coefficients(obs: DataFrame, w: np.ndarray) -> DataFrame:
    """``obs`` with ``h`` (k numbers), ``component`` (place of the first largest) and ``error`` (mean squared) for a given factor."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = np.stack(part["features"].to_numpy())
                h = coefficients(x, w)
                yield part[["row_id"]].assign(h=list(h), component=h.argmax(1).astype("int32"), error=((x - h @ w) ** 2).mean(1))

    return obs.select("row_id", "features").mapInPandas(apply, "row_id long, h array<double>, component int, error double")


def mixed(obs: DataFrame, coded: DataFrame, w: np.ndarray, mix: float, rejected: Column | None = None) -> DataFrame:
    """Features moved towards the factor of their component: mix w[component] + (1 - mix) x; ``mix`` 0 changes nothing.

    Rows for which ``rejected``, a condition on the coded rows, holds stay as they are.
    """
    table = F.array(*[literal_vector(r) for r in w])
    keep = F.lit(False) if rejected is None else F.coalesce(rejected, F.lit(False))
    both = obs.join(coded.select("row_id", "component", keep.alias("_keep")), "row_id")
    moved = F.zip_with("features", table[F.col("component")], lambda x, y: x * (1 - mix) + y * mix)
    return both.withColumn("features", F.when(F.col("_keep"), F.col("features")).otherwise(moved)).drop("_keep")


def log_odds(mu0: np.ndarray, mu1: np.ndarray, pi1: float, sigma2: float) -> tuple[np.ndarray, float]:
    """(slope, offset) of the log-odds of the second of two round normal groups."""
    return (mu1 - mu0) / sigma2, float(np.log(pi1 / (1 - pi1)) - (mu1 @ mu1 - mu0 @ mu0) / (2 * sigma2))


def responsibility(mu0: np.ndarray, mu1: np.ndarray, pi1: float, sigma2: float) -> Column:
    """Probability of the second of two round normal groups: the logistic of the log-odds."""
    slope, offset = log_odds(mu0, mu1, pi1, sigma2)
    return 1 / (1 + F.exp(-(dot(F.col("features"), literal_vector(slope)) + offset)))


def logistic_sums(obs: DataFrame, slope: np.ndarray, offset: float) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(n, sum of g, sum of g x, sum of x) for g the logistic of slope.x + offset.

    A task adds up its rows before anything is shuffled.  The slope travels as data,
    so the steps of an iteration share one compiled plan.
    """
    d = len(slope)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Place d holds the sums of 1, places before it those of the features.
        s1, s = np.zeros(d + 1), np.zeros(d + 1)
        for part in batches:
            if len(part):
                x = np.stack(part["features"].to_numpy())
                g = 1 / (1 + np.exp(-np.clip(x @ slope + offset, -700, 700)))
                s1, s = s1 + [*(g @ x), g.sum()], s + [*x.sum(0), len(x)]
        yield pd.DataFrame({"i": range(d + 1), "s1": s1, "s": s})

    got = obs.select("features").mapInPandas(add, "i int, s1 double, s double").groupBy("i").agg(F.sum("s1"), F.sum("s")).orderBy("i").collect()
    s1, s = np.array([r[1] for r in got] or [0.0] * (d + 1)), np.array([r[2] for r in got] or [0.0] * (d + 1))
    return int(s[d]), float(s1[d]), s1[:d], s[:d]


def spherical_em(obs: DataFrame, start: tuple[np.ndarray, np.ndarray], sigma2: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Means and share of the second group after ``rounds`` steps with a known variance; a step is one aggregate."""
    mu0, mu1 = start
    pi1 = 0.5
    for _ in range(rounds):
        n, n1, s1, s = logistic_sums(obs, *log_odds(mu0, mu1, pi1, sigma2))
        mu1, mu0 = s1 / max(n1, 1e-8), (s - s1) / max(n - n1, 1e-8)
        pi1 = min(max(n1 / n, 1e-6), 1 - 1e-6)
    return mu0, mu1, pi1


def shrink(diff: Column, centre: np.ndarray, sigma2: float, penalty: float) -> Column:
    """A vector drawn towards ``centre`` by a fixed length: block soft threshold."""
    c = literal_vector(centre)
    gap = F.zip_with(diff, c, lambda x, y: x - y)
    length = F.sqrt(dot(gap, gap))
    keep = F.greatest(F.lit(0.0), 1 - F.lit(penalty * sigma2) / F.greatest(length, F.lit(_TINY)))
    return F.zip_with(c, gap, lambda y, g: y + g * keep)


def _to_one(weights: Column) -> Column:
    """Weights divided by their sum; both are bound as variables, so worked out once per row."""
    return F.transform(F.array(weights), lambda q: F.transform(F.array(F.aggregate(q, F.lit(0.0), lambda s, y: s + y)), lambda t: F.transform(q, lambda v: v / t))[0])[0]


def soft_assignment(centres: np.ndarray) -> Column:
    """Student-t weights (one degree) of a row's closeness to each centre, summing to one."""
    x = F.col("features")
    q = F.array(*[1 / (1 + dot(x, x) - 2 * dot(x, literal_vector(c)) + float(c @ c)) for c in centres])
    return _to_one(q)


def sharpened(q: DataFrame, k: int) -> DataFrame:
    """(row_id, p): weights squared, divided by their column's sum and scaled to one per row."""
    sums = q.agg(F.array(*[F.sum(F.col("q")[i]) for i in range(k)]).alias("f"))
    both = q.join(F.broadcast(sums), how="cross")
    p = F.zip_with("q", "f", lambda x, f: x * x / f)
    return both.select("row_id", _to_one(p).alias("p"))


def reconstruction(obs: DataFrame, coded: DataFrame, w: np.ndarray) -> DataFrame:
    """(n, mean_absolute, frobenius): error of h w over all elements; both are divided by the number of elements."""
    both = obs.select("row_id", "features").join(coded.select("row_id", "h"), "row_id")
    gap = F.zip_with("features", _product(F.col("h"), w), lambda x, y: x - y)
    total = lambda f: F.sum(F.aggregate(gap, F.lit(0.0), lambda s, v: s + f(v)))
    size = F.count(F.lit(1)) * w.shape[1]
    return both.agg(F.count(F.lit(1)).alias("n"), (total(F.abs) / size).alias("mean_absolute"), (F.sqrt(total(lambda v: v * v)) / size).alias("frobenius"))


def _product(h: Column, w: np.ndarray) -> Column:
    return F.array(*[dot(h, literal_vector(c)) for c in w.T])


def rejection_scores(obs: DataFrame, coded: DataFrame, w: np.ndarray) -> DataFrame:
    """Eight scores per row (row_id, ...) of how well the factor explains it; low ones are to be rejected.

    ``error`` (of the row's component alone, scaled to 0..1 and weighted down for rows
    of large sums), ``kurtosis`` of h, ``entropy`` of h (scaled, negative), ``gap``
    between the largest and smallest of h, and negative squared and absolute
    distances to h w and to the component.  Scales come from one row of extremes; a
    scale of width 0 gives 0.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            x, h = np.stack(part["features"].to_numpy()), np.stack(part["h"].to_numpy())
            full, alone = x - h @ w, x - w[part["component"].to_numpy()]
            p = h / np.maximum(h.sum(1, keepdims=True), _TINY)
            low = h - h.mean(1, keepdims=True)
            yield pd.DataFrame({
                "row_id": part["row_id"], "total": x.sum(1), "kurtosis": (low**4).mean(1) / np.maximum((low**2).mean(1) ** 2, _TINY),
                "entropy": -(p * np.log(np.maximum(p, _TINY))).sum(1), "gap": h.max(1) - h.min(1),
                "square_h": -(full**2).sum(1), "square_component": -(alone**2).sum(1), "absolute_h": -np.abs(full).sum(1), "absolute_component": -np.abs(alone).sum(1),
            })

    names = ["total", "kurtosis", "entropy", "gap", "square_h", "square_component", "absolute_h", "absolute_component"]
    both = obs.select("row_id", "features").join(coded.select("row_id", "h", "component"), "row_id")
    each = cut(both.mapInPandas(measure, "row_id long, " + ", ".join(f"{n} double" for n in names)), "scores")
    wide = {"_t": F.col("total"), "_e": F.col("entropy"), "_a": -F.col("absolute_component")}
    ends = each.agg(*[f(v).alias(k + s) for k, v in wide.items() for s, f in (("0", F.min), ("1", F.max))])
    scaled = lambda k: F.when(F.col(k + "1") > F.col(k + "0"), (wide[k] - F.col(k + "0")) / (F.col(k + "1") - F.col(k + "0"))).otherwise(0.0)
    # The one row of extremes is a scalar.
    return each.join(F.broadcast(ends), how="cross").select("row_id", (-(1 - scaled("_t")) / 2 * scaled("_a")).alias("error"), "kurtosis", (-scaled("_e")).alias("entropy"), *names[3:])


def transferability(obs: DataFrame, w: np.ndarray, k: int, permutations: int = 100, rounds: int = 100, seed: int = 0) -> tuple[float, float]:
    """(score, p): how near a foreign factor comes to the best one, between 1 and 0 for the worst of shuffled ones; share of shuffled ones that are better.

    All shuffled factors are tried in the same pass over the rows.  The best factor is
    fitted to a finer tolerance than others, as its error is the scale's end.
    """
    rng = np.random.default_rng(seed)
    tried = [w, *(w[:, rng.permutation(w.shape[1])] for _ in range(permutations)), fit_factors(obs, k, rounds, seed, 1e-5)[0]]

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(tried)), 0
        for part in batches:
            if len(part):
                x = np.stack(part["features"].to_numpy())
                total, n = total + [np.abs(x - coefficients(x, t) @ t).sum() for t in tried], n + x.size
        yield pd.DataFrame({"t": range(len(tried)), "total": total, "n": n})

    got = obs.select("features").mapInPandas(errors, "t int, total double, n long").groupBy("t").agg(F.sum("total") / F.sum("n")).orderBy("t").collect()
    own, *shuffled, best = (r[1] for r in got)
    shuffled = np.maximum(shuffled, best)
    width = float(shuffled.max() - best)
    return (1 - max(own - best, 0.0) / width if width > 0 else 0.0), float((shuffled < own).mean())
