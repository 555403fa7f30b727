"""Choosing numbers of factors, mixtures and thresholds by how well a kernel fits the groups found.

The linear kernel of rows x rows is never made: with centred rows X of length one, a
partition Z and signs y, <K, ZZ'> is |X'Z|^2, <K, yy'> is |X'y|^2 and |K| is |X'X|, so
sums per group and the d x d moment are enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.factors import coefficients
from spindrift.operators.linalg import feature_sums, moment_matrices

_TINY = 1e-12


def _added(rows: DataFrame, jobs: int, what) -> list[list[np.ndarray]]:
    """For each job the sums over all batches of the arrays that ``what(x, job)`` returns; one pass for all jobs."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in batches:
            if len(part):
                x = np.stack(part["features"].to_numpy())
                for j in range(jobs):
                    for i, a in enumerate(what(x, j)):
                        total[j, i] = total.get((j, i), 0.0) + np.asarray(a, float)
        if total:
            yield pd.DataFrame({"j": [j for j, _ in total], "i": [i for _, i in total], "shape": [list(np.shape(a)) for a in total.values()], "v": [np.ravel(a).tolist() for a in total.values()]})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"j": [key[0]], "i": [key[1]], "shape": [pdf["shape"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0).tolist()]})

    schema = "j int, i int, shape array<int>, v array<double>"
    got = rows.select("features").mapInPandas(add, schema).groupBy("j", "i").applyInPandas(merge, schema).collect()
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in got:
        out.setdefault(r["j"], {})[r["i"]] = np.array(r["v"]).reshape(r["shape"])
    return [[out[j][i] for i in sorted(out[j])] for j in range(jobs)] if out else []


def _moved(x: np.ndarray, w: np.ndarray, mix: float) -> np.ndarray:
    """Rows moved towards the factor of their component."""
    return (1 - mix) * x + mix * w[coefficients(x, w).argmax(1)] if mix else x


def fit_mixtures(target: DataFrame, factors: Mapping[int, np.ndarray], mixes: Sequence[float], rounds: int = 100, tol: float = 1e-3) -> dict[tuple[int, float], np.ndarray]:
    """For each number of factors and share of mixture the factor (k, d) of the target's mixed rows.

    The rows are moved towards the source's factor w of their component by ``mix``, and
    factorised again from w on.  All fits share their passes; each ends when a round
    lowers its error by no more than ``tol`` of it, after ``rounds`` at most.
    """
    fits = {(k, float(m)): w for k, w in factors.items() for m in mixes}
    before = dict.fromkeys(fits, np.inf)
    left = list(fits)
    for _ in range(rounds):
        held = [(factors[k], m, fits[k, m]) for k, m in left]

        def what(x: np.ndarray, j: int) -> list[np.ndarray]:
            base, mix, w = held[j]  # noqa: B023
            y = _moved(x, base, mix)
            h = coefficients(y, w)
            return [h.T @ y, h.T @ h, np.array([((y - h @ w) ** 2).sum()])]

        got = _added(target, len(left), what)
        if not got:
            raise ValueError("the target has no rows")
        again = []
        for key, (top, gram, error) in zip(left, got, strict=True):
            w = fits[key]
            for _ in range(20):
                w = w * top / np.maximum(gram @ w, _TINY)
            fits[key] = w
            if before[key] - float(error[0]) > tol * float(error[0]):
                again.append(key)
            before[key] = float(error[0])
        left = again
        if not left:
            break
    return fits


def mixture_labels(target: DataFrame, factors: Mapping[int, np.ndarray], fits: Mapping[tuple[int, float], np.ndarray]) -> DataFrame:
    """(row_id, k, mix, component, features): the group of each row under each fit, and the mixed row."""
    jobs = sorted(fits)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            x = np.stack(part["features"].to_numpy())
            for k, m in jobs:
                y = _moved(x, factors[k], m)
                h = coefficients(y, fits[k, m])
                yield pd.DataFrame({"row_id": part["row_id"], "k": np.int32(k), "mix": m, "component": h.argmax(1).astype("int32"), "features": list(y)})

    return target.select("row_id", "features").mapInPandas(label, "row_id long, k int, mix double, component int, features array<double>")


def _unit_centred(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    from spindrift.operators.linalg import centre, dot

    low = centre(rows, keys)
    length = F.sqrt(dot(F.col("features"), F.col("features")))
    return low.withColumn("_l", length).withColumn("features", F.when(F.col("_l") > 0, F.transform("features", lambda x: x / F.col("_l"))).otherwise(F.col("features"))).drop("_l")


def partition_alignment(rows: DataFrame, run: str, group: str) -> DataFrame:
    """(run, alignment): of each run of rows (run, group, features) the alignment of the centred, normalised linear kernel with the groups.

    Between 0 and 1; 1 if all rows of a group are alike and groups are at right angles.
    """
    ready = _unit_centred(rows, [run])
    met = feature_sums(ready, [run, group]).groupBy(run).agg(F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)).alias("kz"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("z"))
    norms = rows.sparkSession.createDataFrame([(k, float(np.linalg.norm(m))) for k, (m, _) in moment_matrices(ready, run).items()], f"`{run}` {dict(rows.dtypes)[run]}, kk double")
    return met.join(norms, run).select(run, (F.col("kz") / (F.col("kk") * F.col("z"))).alias("alignment"))


def reject_threshold(rows: DataFrame, score: str, bins: int = 100) -> tuple[float, float, float]:
    """(threshold, share above it, alignment): the score above which rows are best told from the rest by the linear kernel.

    Thresholds are tried at every ``bins``-th part of the rows' scores; null scores are
    never rejected.
    """
    cuts = rows.agg(F.percentile(score, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("p")).first()["p"]
    if cuts is None:
        raise ValueError("no row has a score")
    cuts = sorted(set(cuts))
    place = F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(score))), F.lit(0))
    place = F.when(F.col(score).isNull(), F.lit(0)).otherwise(place)
    ready = _unit_centred(rows.select("features", score, F.lit(1).alias("_run")), ["_run"]).withColumn("_bin", place)
    got = {r["_bin"]: (r["n"], np.array(r["s"])) for r in feature_sums(ready, ["_bin"]).collect()}
    kk, n = np.linalg.norm(moment_matrices(ready, "_run")[1][0]), sum(v[0] for v in got.values())
    best = (float(cuts[-1]), 0.0, -1.0)
    for i, c in enumerate(cuts):
        above = [v for b, v in got.items() if b > i]
        if above and len(above) < len(got):
            y = sum(v[1] for v in got.values()) - 2 * sum(v[1] for v in above)
            fit = float(y @ y) / (kk * n)
            if fit > best[2]:
                best = (float(c), sum(v[0] for v in above) / n, fit)
    return best
