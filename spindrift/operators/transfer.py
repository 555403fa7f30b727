"""Clustering one target dataset with the help of others.

Two groups: signs of the target's projections on a direction, which comes from the
target alone, from sources, or from both pooled; a statistic decides between the
branches.  Several groups: the same with means instead of directions.  Each
estimator is a few aggregates over the rows: the Gram matrix of the rows is never
made, since G v = X (X' v) needs only two passes of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.linalg import (
    _matrix,
    dimension,
    dot,
    feature_sums,
    literal_vector,
    moment_matrices,
    sign_no_zero,
    std_scale,
    subspace_basis,
    top_directions,
)


@dataclass(frozen=True)
class Side:
    """A dataset with its moment (d, d), its sum (d,) and number of rows; ``known`` keeps vectors that several estimators need."""

    name: str
    rows: DataFrame
    moment: np.ndarray
    total: np.ndarray
    n: int
    known: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def d(self) -> int:
        return len(self.total)


def sides(obs: DataFrame, dataset: str = "dataset") -> dict[str, Side]:
    """All datasets of (dataset, row_id, features), with their statistics from one pass each for sums and moments."""
    found = moment_matrices(obs, dataset)
    totals = {r[dataset]: np.array(r["s"]) for r in feature_sums(obs.where(F.col(dataset).isNotNull()), [dataset], d=len(next(iter(found.values()))[0]) if found else 0).collect()}
    return {k: Side(k, obs.where(F.col(dataset) == k), m, totals[k], n) for k, (m, n) in found.items()}


def _score(v: np.ndarray) -> Column:
    return dot(F.col("features"), literal_vector(v))


def _hollow_signs(steps: Sequence[np.ndarray]) -> Column:
    """Signs of the rows' places on the first vector, turned by each further one: the sign of x.w - |x|^2 z.  The vectors travel as data."""

    @F.pandas_udf("int")
    def signs(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype="int32")
        x = np.stack(features.to_numpy())
        own = (x * x).sum(1)
        z = np.where(x @ steps[0] >= 0, 1.0, -1.0)
        for w in steps[1:]:
            z = np.where(x @ w - own * z >= 0, 1.0, -1.0)
        return pd.Series(z.astype("int32"))

    return signs(F.col("features"))


#: Steps towards the leading eigenvector of the Gram matrix without its diagonal.
_START_STEPS = 8


def hollow_start(side: Side) -> np.ndarray:
    """A vector w with which the signs of x.w are those of the leading eigenvector of the rows' Gram matrix without its diagonal.

    Where u is that eigenvector and m its value, u(x) = x.w / (m + |x|^2) with w the
    sum of u(x) x; so w is found by weighted sums of rows, each pass with the m of
    the one before.  m, the greatest eigenvalue of a matrix of trace 0, is not below 0.
    """
    v, s2 = top_directions(side.moment)
    w, m = v[:, 0], max(float(s2[0]) - np.trace(side.moment) / side.n, 0.0)
    for _ in range(_START_STEPS):
        own = dot(F.col("features"), F.col("features"))
        placed = side.rows.select("features", (_score(w) / F.greatest(own + F.lit(float(m)), F.lit(1e-12))).alias("_u"), own.alias("_own"))
        placed = placed.select(F.concat("features", F.array(F.col("_u"), F.col("_own") * F.col("_u"))).alias("features"), "_u")
        got = feature_sums(placed, [], F.col("_u"), side.d + 2).first()["s"]
        new, norm2, diagonal = np.array(got[: side.d]), got[side.d], got[side.d + 1]
        if norm2 <= 0:
            break
        m = max(float(new @ new - diagonal) / norm2, 0.0)
        new = new / np.linalg.norm(new)
        close = abs(float(new @ w)) >= 1 - 1e-9
        w = new
        if close:
            break
    return w * (-1.0 if w[np.abs(w).argmax()] < 0 else 1.0)


def spectral_signs(side: Side, n_iter: int | None = None) -> Column:
    """Signs of the rows by power steps on their Gram matrix without its diagonal.

    Starts from the signs of its leading eigenvector.  A step maps signs z to those of
    (X X' - diag) z: row x gets the sign of x.(X'z) - |x|^2 z(x), and X'z is one
    weighted sum of rows.  So z is a function of the row and the vectors of the steps
    before.  At most floor(3 ln n) steps are taken; they end when X'z repeats.
    """
    if side.n < 2:
        raise ValueError("at least two rows are needed")
    if ("signs", n_iter) in side.known:
        return _hollow_signs(side.known["signs", n_iter])
    steps = [hollow_start(side)]
    for _ in range(math.floor(3 * math.log(side.n)) if n_iter is None else n_iter):
        w = np.array(feature_sums(side.rows, [], _hollow_signs(steps), side.d).first()["s"])
        if len(steps) > 1 and np.allclose(w, steps[-1], rtol=1e-9, atol=1e-9 * max(1.0, float(np.abs(w).max()))):
            break
        steps.append(w)
    side.known["signs", n_iter] = steps
    return _hollow_signs(steps)


def _by_dataset_udf(f: Callable[[str, np.ndarray], np.ndarray], kind: str) -> Column:
    """``f(dataset, x)``, one number per row, over the columns dataset and features."""

    @F.pandas_udf(kind)
    def run(dataset: pd.Series, features: pd.Series) -> pd.Series:
        out = np.zeros(len(dataset), dtype="int32" if kind == "int" else "float64")
        for name, at in dataset.groupby(dataset).indices.items():
            out[at] = f(name, np.stack(features.iloc[at].to_numpy()))
        return pd.Series(out)

    return run(F.col("dataset"), F.col("features"))


def spectral_signs_all(rows: DataFrame, found: Mapping[str, Side]) -> Column:
    """``spectral_signs`` of the rows (dataset, features) of many datasets, which share their passes."""
    d = next(iter(found.values())).d
    start, least = {}, {}
    for name, s in found.items():
        v, s2 = top_directions(s.moment)
        start[name], least[name] = v[:, 0], max(float(s2[0]) - np.trace(s.moment) / s.n, 0.0)
    for _ in range(_START_STEPS):
        w, m = dict(start), dict(least)
        u = _by_dataset_udf(lambda name, x: x @ w[name] / np.maximum((x * x).sum(1) + m[name], 1e-12), "double")  # noqa: B023
        placed = rows.select("dataset", "features", u.alias("_u"), dot(F.col("features"), F.col("features")).alias("_own"))
        placed = placed.select("dataset", F.concat("features", F.array(F.col("_u"), F.col("_own") * F.col("_u"))).alias("features"), "_u")
        moved = 0.0
        for r in feature_sums(placed, ["dataset"], F.col("_u"), d + 2).collect():
            got, name = np.array(r["s"]), r["dataset"]
            if got[d] > 0:
                new = got[:d] / np.linalg.norm(got[:d])
                least[name] = max(float(got[:d] @ got[:d] - got[d + 1]) / got[d], 0.0)
                moved, start[name] = max(moved, 1 - abs(float(new @ start[name]))), new
        if moved <= 1e-10:
            break
    steps = {name: [w * (-1.0 if w[np.abs(w).argmax()] < 0 else 1.0)] for name, w in start.items()}

    def signs(held: dict[str, list[np.ndarray]]) -> Column:
        def turn(name: str, x: np.ndarray) -> np.ndarray:
            own, z = (x * x).sum(1), np.where(x @ held[name][0] >= 0, 1.0, -1.0)
            for w in held[name][1:]:
                z = np.where(x @ w - own * z >= 0, 1.0, -1.0)
            return z.astype("int32")

        return _by_dataset_udf(turn, "int")

    open_ = {name: math.floor(3 * math.log(s.n)) for name, s in found.items() if s.n > 1}
    while open_:
        left = {}
        part = rows.where(F.col("dataset").isin(list(open_)))
        for r in feature_sums(part, ["dataset"], signs({n: list(v) for n, v in steps.items()}), d).collect():
            w, name = np.array(r["s"]), r["dataset"]
            if len(steps[name]) > 1 and np.allclose(w, steps[name][-1], rtol=1e-9, atol=1e-9 * max(1.0, float(np.abs(w).max()))):
                continue
            steps[name].append(w)
            if open_[name] > 1:
                left[name] = open_[name] - 1
        open_ = left
    return signs(steps)


def signs_along(vectors: Mapping[str, np.ndarray]) -> Column:
    """Signs of the rows (dataset, features) along a vector of their dataset."""
    held = dict(vectors)
    return _by_dataset_udf(lambda name, x: np.where(x @ held[name] >= 0, 1, -1), "int")


def direction(side: Side) -> np.ndarray:
    """Direction of the difference between the groups of one dataset.

    The mean of z x over the spectral signs z where there are more features than
    rows, else the leading right singular vector.
    """
    if side.d > side.n:
        return np.array(feature_sums(side.rows, [], spectral_signs(side), side.d).first()["s"]) / side.n
    return top_directions(side.moment)[0][:, 0]


def target_only(target: Side) -> Column:
    return spectral_signs(target)


def _in_subspace(target: Side, basis: np.ndarray) -> np.ndarray:
    """Leading direction of the target's moment within a subspace."""
    inner = basis.T @ target.moment @ basis / target.n
    return basis @ top_directions(inner)[0][:, 0]


def in_span(target: Side, basis: np.ndarray) -> Column:
    """Signs of the target along its best direction within the span of a basis (d, r)."""
    return sign_no_zero(_score(_in_subspace(target, basis)))


def span_directions(found: Mapping[str, Side], directions: Mapping[str, Sequence[np.ndarray]]) -> dict[str, np.ndarray]:
    """Of each dataset its best direction within the span of the given ones."""
    return {k: _in_subspace(found[k], subspace_basis(v, normalize=True)) for k, v in directions.items()}


def source_based(target: Side, sources: Sequence[Side]) -> Column:
    """Signs of the target along the best direction within the span of the sources' directions."""
    if not sources:
        raise ValueError("a source is needed")
    return in_span(target, subspace_basis([direction(s) for s in sources]))


def pooled(target: Side, sources: Sequence[Side], scale: str = "none", restrict_rank: bool = False) -> Column:
    """As ``source_based`` with the target's own direction among them.

    ``scale``: ``none``; ``unit`` length; or ``std``, divided by the deviation of the
    target's projections.
    """
    found = [direction(s) for s in (target, *sources)]
    if scale == "std":
        found = [std_scale(v, target.moment, target.total, target.n) for v in found]
    basis = subspace_basis(found, max_rank=1 if restrict_rank else None, normalize=scale == "unit")
    return in_span(target, basis)


def raw_pooled(target: Side, sources: Sequence[Side]) -> Column:
    """Signs from all rows of target and sources put together."""
    return spectral_signs(_pool(target, sources))


def _pool(target: Side, sources: Sequence[Side]) -> Side:
    """All rows as one dataset: sums and moments add up."""
    rows = target.rows.select("row_id", "features")
    for s in sources:
        rows = rows.unionByName(s.rows.select("row_id", "features"))
    every = (target, *sources)
    return Side("pooled", rows, sum(s.moment for s in every), sum(s.total for s in every), sum(s.n for s in every))


def noise_variance(side: Side, rank: int = 1) -> float:
    """Mean square of what the ``rank`` leading singular vectors leave."""
    _, s2 = top_directions(side.moment, rank)
    return float((np.trace(side.moment) - s2.sum()) / (side.n * side.d))


def sum_statistic(s: Column, n: Column, d: int, sigma2: float) -> Column:
    """|s / n|^2 - d sigma2 / n for the sum s of z x over n rows."""
    mean = F.transform(s, lambda x: x / n)
    return dot(mean, mean) - d * sigma2 / n


def validation_statistic(side: Side, z: Column, sigma2: float) -> float:
    """|mean of z x|^2 - d sigma2 / n."""
    return float(feature_sums(side.rows, [], z, side.d).select(sum_statistic(F.col("s"), F.col("n"), side.d, sigma2)).first()[0])


def validation_threshold(sigma2: float, d: int, n: int | Column, c0: float = 1.0) -> float | Column:
    return c0 * sigma2 * (1 + (d / n) ** 0.5)


def recovery_threshold(d: int, n: int | Column, sigma2: float = 1.0) -> float | Column:
    """Least separation at which the target alone can be recovered."""
    least = (d / n) ** 0.25
    return (F.greatest(F.lit(1.0), least) if isinstance(least, Column) else max(1.0, least)) * math.sqrt(sigma2)


def adaptive(target: Side, sources: Sequence[Side], c0: float = 1.0, choice: str | None = None, sigma2: float | None = None) -> tuple[Column, str, float]:
    """(signs, branch, statistic): the target's own signs if their statistic passes the threshold, else the sources'.

    ``choice`` names the branch instead; the other one is then never computed.
    Without ``sigma2`` the noise is what the first singular vector leaves.
    """
    if choice == "source":
        return source_based(target, sources), "source", float("nan")
    own = target_only(target)
    sigma2 = noise_variance(target) if sigma2 is None else sigma2
    t = validation_statistic(target, own, sigma2)
    if choice == "target" or (choice is None and abs(t) > validation_threshold(sigma2, target.d, target.n, c0)):
        return own, "target", t
    return source_based(target, sources), "source", t


# More than two groups


def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Place of the nearest of the rows of ``means``; the first on a tie."""
    return (x @ means.T - (means**2).sum(1) / 2).argmax(1)


def nearest_mean(means: np.ndarray, features: str = "features") -> Column:
    """Place of the nearest of the rows of ``means`` (k, d); the means travel as data, however many there are."""

    @F.pandas_udf("int")
    def near(x: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(x.to_numpy()), means) if len(x) else [], dtype="int32")

    return near(F.col(features))


def _by_dataset(batch: pa.RecordBatch, d: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(dataset, places, features) of the parts of a batch whose first columns are dataset and features."""
    seen = batch.column(0).dictionary_encode()
    code, x = seen.indices.to_numpy(zero_copy_only=False), _matrix(batch.column(1), d)
    for i, name in enumerate(seen.dictionary.to_pylist()):
        at = np.flatnonzero(code == i)
        yield name, at, x[at]


def _near_sums(rows: DataFrame, jobs: Sequence[tuple[str, np.ndarray, np.ndarray]], d: int, sums: bool = True) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Of each job (dataset, map (d, r), centres (k, r)): squared distances to the nearest centres, summed; rows and sums of the features (k, d) per centre.

    All jobs share one pass.  A task gives one list of numbers per job; these are added up by job.
    """
    k = len(jobs[0][2])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, _, x in _by_dataset(batch, d):
                for j, (of, along, c) in enumerate(jobs):
                    if of != name:
                        continue
                    y = x @ along
                    near = _nearest(y, c)
                    v = np.zeros(1 + (k * (d + 1) if sums else 0))
                    v[0] = ((y - c[near]) ** 2).sum()
                    if sums:
                        n = np.bincount(near, minlength=k)
                        v[1 : k + 1] = n
                        starts = (np.cumsum(n) - n)[n > 0]
                        v[k + 1 :].reshape(k, d)[n > 0] = np.add.reduceat(x[np.argsort(near, kind="stable")], starts, axis=0)
                    total[j] = total.get(j, 0.0) + v
        for j, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["j", "v"])

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"j": [key[0]], "v": [np.sum(np.stack(part["v"].to_numpy()), axis=0).tolist()]})

    got = {r["j"]: np.array(r["v"]) for r in rows.select("dataset", "features").mapInArrow(add, "j int, v array<double>").groupBy("j").applyInPandas(merge, "j int, v array<double>").collect()}
    out = []
    for j in range(len(jobs)):
        v = got.get(j, np.zeros(1 + k * (d + 1)))
        out.append((float(v[0]), v[1 : k + 1], v[k + 1 :].reshape(-1, d)))
    return out


def _lloyd(rows: DataFrame, jobs: Sequence[tuple[str, np.ndarray, np.ndarray]], d: int, steps: Sequence[int], tol: float = 1e-6) -> list[np.ndarray]:
    """Centres of every job after at most its number of rounds; a centre without rows stays where it is."""
    centres, active = [c for _, _, c in jobs], [j for j in range(len(jobs)) if steps[j] > 0]
    taken = 0
    while active:
        got = _near_sums(rows, [(jobs[j][0], jobs[j][1], centres[j]) for j in active], d)
        taken, left = taken + 1, []
        for j, (_, n, s) in zip(active, got, strict=True):
            new = np.where(n[:, None] > 0, s @ jobs[j][1] / np.maximum(n, 1)[:, None], centres[j])
            if np.abs(new - centres[j]).max() > tol and taken < steps[j]:
                left.append(j)
            centres[j] = new
        active = left
    return centres


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres (k, r) among the rows of ``x``, after ten Lloyd rounds there."""
    c = x[[rng.integers(len(x))]]
    gap = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        c = np.vstack([c, x[[rng.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else 0]]])
        gap = np.minimum(gap, ((x - c[-1]) ** 2).sum(1))
    for _ in range(10):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        s[n > 0] = np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(n) - n)[n > 0], axis=0)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


#: Starts of a search for means; the one of least inertia over all rows goes on.
RESTARTS = 10


def group_means(rows: DataFrame, problems: Sequence[tuple[Side, np.ndarray]], k: int, seed: int = 0, steps: int = 20) -> list[np.ndarray]:
    """Means (k, d) of k groups for each problem, a side and a basis (d, r) to whose span it is confined.

    k-means in the k leading coordinates, then Lloyd steps in the whole span.  All
    problems share their passes over ``rows`` (dataset, row_id, features).  The first
    centres are chosen by k-means++ among 50 k rows of a dataset, drawn by a hash of
    their id.
    """
    d = problems[0][0].d
    flats = []
    for side, basis in problems:
        inner = basis.T @ side.moment @ basis
        flats.append(basis @ top_directions(inner, min(k, basis.shape[1]))[0])
    drawn = {}
    for name in dict.fromkeys(side.name for side, _ in problems):
        few = rows.where(F.col("dataset") == name).select("row_id", "features").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(50 * k).toPandas()
        drawn[name] = np.stack(few["features"].to_numpy())
    names = [side.name for side, _ in problems]

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in part["id"]:
                j = int(i) // RESTARTS
                c = _plus_plus(drawn[names[j]] @ flats[j], k, np.random.default_rng([seed, int(i) % RESTARTS]))
                yield pd.DataFrame({"i": [i], "c": [c.ravel().tolist()]})

    n = len(problems) * RESTARTS
    began = {r["i"]: np.array(r["c"]) for r in rows.sparkSession.range(0, n, 1, n).mapInPandas(start, "i long, c array<double>").collect()}
    tried = [(names[i // RESTARTS], flats[i // RESTARTS], began[i].reshape(k, -1)) for i in range(n)]
    cost = [c for c, _, _ in _near_sums(rows, tried, d, sums=False)]
    best = [tried[j * RESTARTS + int(np.argmin(cost[j * RESTARTS : (j + 1) * RESTARTS]))] for j in range(len(problems))]
    centres = _lloyd(rows, best, d, [steps] * len(best))
    whole = [(name, basis, c @ flat.T @ basis) for name, (_, basis), flat, c in zip(names, problems, flats, centres, strict=True)]
    first = _near_sums(rows, [(name, flat, c) for name, flat, c in zip(names, flats, centres, strict=True)], d)
    whole = [(name, basis, np.where(m[:, None] > 0, s @ basis / np.maximum(m, 1)[:, None], c)) for (name, basis, c), (_, m, s) in zip(whole, first, strict=True)]
    final = _lloyd(rows, whole, d, [max(1, round(2 * math.log(max(side.n, 2)))) for side, _ in problems])
    return [c @ basis.T for c, (_, basis) in zip(final, problems, strict=True)]


def _named(side: Side) -> DataFrame:
    return side.rows.select(F.lit(side.name).alias("dataset"), "row_id", "features")


def spectral_means(side: Side, k: int, seed: int = 0, steps: int = 20) -> np.ndarray:
    """Means (k, d) of k groups of one dataset: see ``group_means``."""
    return group_means(_named(side), [(side, np.eye(side.d))], k, seed, steps)[0]


def estimated_means(rows: DataFrame, wanted: Sequence[Side], k: int, seed: int = 0) -> list[np.ndarray]:
    """(k, d) for each side, whose span holds its groups' means.

    With fewer rows than features the means of k-means groups; else the k leading
    right singular vectors, which need no pass.
    """
    few = [s for s in wanted if s.n < s.d]
    found = dict(zip([s.name for s in few], group_means(rows, [(s, np.eye(s.d)) for s in few], k, seed), strict=True)) if few else {}
    return [found[s.name] if s.name in found else top_directions(s.moment, k)[0].T for s in wanted]


def _means_basis(target: Side, found: Sequence[np.ndarray], scale: str, max_rank: int | None = None) -> np.ndarray:
    """Basis (d, r) of the span of several datasets' means (k, d); ``scale``: ``unit`` length, ``std`` or ``none``."""
    turned = [m.T for m in found]
    if scale == "std":
        turned = [np.column_stack([std_scale(c, target.moment, target.total, target.n) for c in m.T]) for m in turned]
    return subspace_basis(turned, max_rank=max_rank, normalize=scale == "unit")


def source_means_labels(target: Side, sources: Sequence[Side], k: int, with_target: bool = False, scale: str = "unit", seed: int = 0, restrict_rank: bool = False) -> Column:
    """Labels 0..k-1 of the target, grouped within the span of the sources' (and its own) means, of rank k at most if restricted."""
    every = ((target,) if with_target else ()) + tuple(sources)
    if not every:
        raise ValueError("a source is needed")
    rows = _named(every[0])
    for s in every[1:]:
        rows = rows.unionByName(_named(s))
    basis = _means_basis(target, estimated_means(rows, every, k, seed), scale, k if restrict_rank else None)
    return nearest_mean(group_means(_named(target), [(target, basis)], k, seed)[0])


def raw_pooled_labels(target: Side, sources: Sequence[Side], k: int, seed: int = 0) -> Column:
    """Labels 0..k-1 of the target from the groups of all rows of target and sources put together."""
    return nearest_mean(spectral_means(_pool(target, sources), k, seed))


def validation_statistic_groups(means: np.ndarray, sizes: np.ndarray, sigma2: float) -> float:
    """Weighted squared gaps between all ordered pairs of means, less their expectation under noise."""
    n, (k, d) = sizes.sum(), means.shape
    gaps = ((means[:, None] - means[None]) ** 2).sum(-1)
    return float((np.outer(sizes, sizes) * gaps).sum() / (2 * n * n) - sigma2 * d * (k - 1) / n)


def validation_threshold_groups(sigma2: float, d: int, k: int, n: int, d0: float = 1.0) -> float:
    return d0 * k * sigma2 * (math.sqrt(d * k / n) + 1)


def _own_suffice(target: Side, means: np.ndarray, sizes: np.ndarray, k: int, d0: float, sigma2: float | None = None) -> bool:
    """Whether the target's own groups pass the threshold."""
    sigma2 = max(noise_variance(target, k), 0.0) if sigma2 is None else sigma2
    return validation_statistic_groups(means, sizes, sigma2) > validation_threshold_groups(sigma2, target.d, k, target.n, d0)


def adaptive_groups(target: Side, sources: Sequence[Side], k: int, d0: float = 1.0, choice: str | None = None, seed: int = 0, sigma2: float | None = None) -> tuple[Column, str]:
    """(labels, branch) for more than two groups; only the branch that is chosen, or needed to choose, is computed."""
    if choice == "source":
        return source_means_labels(target, sources, k, seed=seed), "source"
    means = spectral_means(target, k, seed)
    if choice != "target":
        sizes = _near_sums(_named(target), [(target.name, np.eye(target.d), means)], target.d)[0][1]
    if choice == "target" or _own_suffice(target, means, sizes, k, d0, sigma2):
        return nearest_mean(means), "target"
    return source_means_labels(target, sources, k, seed=seed), "source"


def compare_groups(rows: DataFrame, found: Mapping[str, Side], targets: Mapping[str, Sequence[str]], k: int, methods: Sequence[str], truth: str, constant: float = 1.0, seed: int = 0) -> DataFrame:
    """(target, method, truth, k): each target's rows under each method of ``AssistedClustering`` for k groups.

    ``targets`` names the sources of each target.  The labels are those of
    ``AssistedClustering``; every dataset's own means are found once, and all targets
    and methods share their passes over ``rows`` (dataset, row_id, features, truth).
    """
    d = next(iter(found.values())).d
    needed = list(dict.fromkeys([*targets, *(s for v in targets.values() for s in v)]))
    own = dict(zip(targets, group_means(rows, [(found[t], np.eye(d)) for t in targets], k, seed), strict=True)) if {"target", "adaptive"} & set(methods) else {}
    spans = dict(zip(needed, estimated_means(rows, [found[s] for s in needed], k, seed), strict=True))
    inner = []
    for t, sources in targets.items():
        wanted = {"source" if m == "adaptive" else m for m in methods if m != "target"}
        for m in sorted(wanted):
            with_target = [t] if m != "source" else []
            inner.append((t, m, _means_basis(found[t], [spans[s] for s in (*with_target, *sources)], "std" if m == "pooled_std" else "unit")))
    means = {(t, "target"): own[t] for t in own}
    if inner:
        means |= {(t, m): c for (t, m, _), c in zip(inner, group_means(rows, [(found[t], b) for t, _, b in inner], k, seed), strict=True)}
    if "adaptive" in methods:
        sizes = _near_sums(rows, [(t, np.eye(d), own[t]) for t in targets], d)
        for t, (_, n, _) in zip(targets, sizes, strict=True):
            means[t, "adaptive"] = own[t] if _own_suffice(found[t], own[t], n, k, constant) else means[t, "source"]
    kind = dict(rows.dtypes)[truth]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, x in _by_dataset(batch, d):
                if name in targets:
                    for m in methods:
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([m] * n, pa.string()), batch.column(2).take(pa.array(at)), pa.array(_nearest(x, means[name, m]).astype("int32"))], names=["target", "method", truth, "k"])

    return rows.select("dataset", "features", truth).mapInArrow(label, f"target string, method string, `{truth}` {kind}, k int")


class AssistedClustering:
    """``fit_predict(obs, target, sources)``: labels (row_id, label) of the target's rows.

    ``k`` groups; ``method`` is ``adaptive``, ``target``, ``source``, ``pooled``,
    ``pooled_std`` or ``raw_pooled``, or a function of your own from (target, sources,
    k) to a label column.  ``constant`` scales the threshold of the adaptive choice,
    ``sigma2`` gives the noise instead of its estimate; ``restrict_rank`` confines
    pooled directions to one, or means to k.
    """

    METHODS = ("adaptive", "target", "source", "pooled", "pooled_std", "raw_pooled")

    def __init__(self, k: int = 2, method: str | Callable = "adaptive", constant: float = 1.0, seed: int = 0, sigma2: float | None = None, restrict_rank: bool = False) -> None:
        if k < 2:
            raise ValueError("at least two groups are needed")
        if not callable(method) and method not in self.METHODS:
            raise ValueError(f"unknown method {method}")
        self.k, self.method, self.constant, self.seed = k, method, constant, seed
        self.sigma2, self.restrict_rank = sigma2, restrict_rank
        self.branch_: str | None = None

    def labels(self, target: Side, sources: Sequence[Side]) -> Column:
        if callable(self.method):
            self.branch_ = getattr(self.method, "__name__", "own")
            return self.method(target, sources, self.k)
        choice = {"adaptive": None, "target": "target", "source": "source"}.get(self.method)
        if self.method in ("adaptive", "target", "source"):
            if self.k == 2:
                z, self.branch_, _ = adaptive(target, sources, self.constant, choice, self.sigma2)
                return z
            z, self.branch_ = adaptive_groups(target, sources, self.k, self.constant, choice, self.seed, self.sigma2)
            return z
        self.branch_ = self.method
        if self.method == "raw_pooled":
            return raw_pooled(target, sources) if self.k == 2 else raw_pooled_labels(target, sources, self.k, self.seed)
        scale = "std" if self.method == "pooled_std" else "none"
        if self.k > 2:
            return source_means_labels(target, sources, self.k, with_target=True, scale="std" if scale == "std" else "unit", seed=self.seed, restrict_rank=self.restrict_rank)
        return pooled(target, sources, scale=scale, restrict_rank=self.restrict_rank)

    def fit_predict(self, obs: DataFrame, target: str, sources: Sequence[str]) -> DataFrame:
        dimension(obs)
        found = sides(obs)
        t = found[target]
        return t.rows.select("row_id", self.labels(t, [found[s] for s in sources]).alias("label"))
