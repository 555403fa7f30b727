"""Linear algebra over observations (keys..., row_id, features ARRAY<DOUBLE>).

Nothing of size rows x rows is ever made.  What a row contributes to a d x d
moment, a group sum or a projection is added up inside each task with numpy and
then by Spark; the driver sees d x d tables only, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest dimension whose d x d moment may come to the driver (200 MB).
MAX_DIM = 5000


def sign_no_zero(value: Column) -> Column:
    """-1 below zero, +1 from zero on; null stays null."""
    # The value is used once: signs of signs would double their expression at each step otherwise.
    return (value >= 0).cast("int") * 2 - 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def literal_vector(v: Sequence[float]) -> Column:
    """A constant array.  It is written as one text, so that a plan stays small however many features there are."""
    if not len(v):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(x)) for x in v)), ",").cast("array<double>")


def dimension(obs: DataFrame) -> int:
    """Length of the features; an error if it isn't the same in all rows, 0 for no row."""
    low, high = obs.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if low != high:
        raise ValueError(f"features have between {low} and {high} elements")
    return high or 0


def _matrix(features: pa.Array, d: int) -> np.ndarray:
    """Rows of a batch as (n, d); what is null adds nothing."""
    flat = features.flatten()
    if not features.null_count and not flat.null_count and len(flat) == len(features) * d:
        return flat.to_numpy().reshape(-1, d).astype(float)
    out = np.zeros((len(features), d))
    for i, row in enumerate(features.to_pylist()):
        for j, v in enumerate((row or [])[:d]):
            out[i, j] = 0.0 if v is None else v
    return out


def feature_sums(obs: DataFrame, keys: Sequence[str], weight: Column | None = None, d: int | None = None) -> DataFrame:
    """(keys, n, w, s): rows, summed weight and weighted sum of the features per group.

    Arrow batches are added up per group where they lie; Spark adds these sums place
    by place, before and after the shuffle.  Without the number of features ``d`` one
    more pass finds it.  Without keys there is one row, with n = 0 and no sums for an
    empty input.
    """
    d = dimension(obs) if d is None else d
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    # Several keys may share their name with the sums: they travel under names of their own.
    asked = obs.withColumn("_w", w).select(*keys, "_w", "features")
    names = asked.columns[:-2]
    own = [f"_k{i}" for i in range(len(names))]
    work = asked.toDF(*own, "_w", "features")
    kinds = "".join(f"{c} {t}, " for c, t in work.dtypes[: len(own)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for i in range(len(own)):
                seen = batch.column(i).dictionary_encode(null_encoding="encode")
                code = np.unique(code * max(len(seen.dictionary), 1) + seen.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            order, starts = np.argsort(code, kind="stable"), np.cumsum(n) - n
            one = batch.column(len(own)).to_numpy(zero_copy_only=False)[order]
            x = _matrix(batch.column(len(own) + 1), d)[order] * one[:, None]
            sums = np.add.reduceat(x, starts, axis=0).ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(sums) + 1, d, dtype=np.int32) if d else np.zeros(len(n) + 1, dtype=np.int32), sums)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(first)) for i in range(len(own))), pa.array(n), pa.array(np.add.reduceat(one, starts)), lists], names=[*own, "n", "w", "s"])

    parts = work.mapInArrow(add, f"{kinds}n long, w double, s array<double>")
    places = parts.select(*own, "n", "w", F.posexplode("s").alias("i", "x")).groupBy(*own, "i").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("x").alias("x"))
    lists = places.groupBy(*own).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("w").alias("w"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return lists.select(*[F.col(o).alias(k) for o, k in zip(own, names, strict=True)], "n", "w", F.col("s.x").alias("s"))


def transpose(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(place, keys, values): the columns of a matrix given by rows (key, array), each with its rows' keys in order.

    As many keys as the matrix has rows come together for each place: for tall
    matrices leave the cells as (key, place, value), where a transpose is a renaming.
    """
    cells = rows.select(F.col(key).alias("k"), F.posexplode(values).alias("place", "v"))
    lists = cells.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("l"))
    return lists.select("place", F.col("l.k").alias("keys"), F.col("l.v").alias("values"))


def pair_distances(rows: DataFrame, key: str, values: str, block_rows: int = 2048) -> DataFrame:
    """(i, j, euclidean, pearson, spearman), i < j: distances, 1 - correlation and 1 - rank correlation of vectors (key, array).

    Vectors meet in blocks, each two blocks once, as matrices; the result has one row
    per pair, so this is for means and the like, not for all rows.  A constant vector
    has no correlation (NaN).
    """
    numbered = rows.select(F.col(key).alias("k"), F.col(values).alias("v")).where("k is not null and v is not null")
    blocks = max(1, -(-numbered.count() // block_rows))
    mine = numbered.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = mine.select("k", "v", "b", other.alias("o")).select("k", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    kind = dict(numbered.dtypes)["k"]

    def standard(x: np.ndarray) -> np.ndarray:
        low = x - x.mean(1, keepdims=True)
        with np.errstate(invalid="ignore"):
            return low / np.linalg.norm(low, axis=1, keepdims=True)

    def compare(pq: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["b"] == pq[0]], pdf[pdf["b"] == pq[1]]
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": [], "euclidean": [], "pearson": [], "spearman": []})
        x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
        ranks = [pd.DataFrame(m).rank(axis=1).to_numpy() for m in (x, y)]
        gap = np.sqrt(np.maximum(((x[:, None] - y[None]) ** 2).sum(2), 0)) if len(x) * len(y) * x.shape[1] < 1 << 24 else np.stack([np.linalg.norm(y - r, axis=1) for r in x])
        ki, kj = np.meshgrid(a["k"].to_numpy(), b["k"].to_numpy(), indexing="ij")
        keep = ki < kj if pq[0] == pq[1] else ki != kj
        i, j = np.where(ki < kj, ki, kj)[keep], np.where(ki < kj, kj, ki)[keep]
        return pd.DataFrame({"i": i, "j": j, "euclidean": gap[keep], "pearson": (1 - standard(x) @ standard(y).T)[keep], "spearman": (1 - standard(ranks[0]) @ standard(ranks[1]).T)[keep]})

    return met.groupBy("p", "q").applyInPandas(compare, f"i {kind}, j {kind}, euclidean double, pearson double, spearman double")


def centre(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features minus the mean features of their group."""
    means = feature_sums(obs, keys).select(*keys, F.transform("s", lambda x: x / F.col("n")).alias("_mean"))
    return obs.join(means, list(keys)).withColumn("features", F.zip_with("features", "_mean", lambda x, m: x - m)).drop("_mean")


def moments(obs: DataFrame, key: str) -> DataFrame:
    """(key, i, j, v, n): the d x d matrix of summed products x_i x_j of each group, i <= j.

    Each task multiplies its batches as matrices and gives one matrix per group; the
    shuffle carries d^2 / 2 numbers per group and task, whatever the number of rows.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for k, part in b.groupby(key, sort=False):
                x = np.stack(part["features"].to_numpy())
                m, n = total.get(k, (0.0, 0))
                total[k] = (m + x.T @ x, n + len(x))
        for k, (m, n) in total.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({key: k, "i": i.astype("int32"), "j": j.astype("int32"), "v": m[i, j], "n": n})

    kind = dict(obs.dtypes)[key]
    parts = obs.select(key, "features").where(F.col(key).isNotNull()).mapInPandas(add, f"`{key}` {kind}, i int, j int, v double, n long")
    return parts.groupBy(key, "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def moment_matrices(obs: DataFrame, key: str) -> dict[object, tuple[np.ndarray, int]]:
    """The groups' d x d moments on the driver, with their numbers of rows."""
    d = dimension(obs)
    if d > MAX_DIM:
        raise ValueError(f"{d} features are too many for a moment matrix on the driver")
    out: dict[object, tuple[np.ndarray, int]] = {}
    for k, i, j, v, n in moments(obs, key).toPandas().itertuples(index=False):
        m, _ = out.setdefault(k, (np.zeros((d, d)), n))
        m[i, j] = m[j, i] = v
    return out


def top_directions(moment: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k leading right singular vectors (d, k) and squared singular values of a matrix with this moment.

    The sign of each vector is fixed: its entry of largest magnitude is positive.
    """
    values, vectors = np.linalg.eigh(moment)
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return v, np.maximum(values[order], 0)


def subspace_basis(directions: Sequence[np.ndarray], tol: float = 1e-8, max_rank: int | None = None, normalize: bool = False) -> np.ndarray:
    """Orthonormal basis (d, r) of the span of direction vectors or mean matrices.

    r counts the singular values above ``tol`` times the largest, at most
    ``max_rank``.
    """
    columns = np.column_stack([np.asarray(v, float).reshape(len(v), -1) for v in directions])
    if normalize:
        norms = np.linalg.norm(columns, axis=0)
        columns = columns / np.where(norms > 0, norms, 1)
    u, s, _ = np.linalg.svd(columns, full_matrices=False)
    rank = int((s > tol * s[0]).sum()) if s[0] > 0 else 1
    return u[:, : min(rank, max_rank or rank)]


def project(obs: DataFrame, basis: np.ndarray, out: str = "projected") -> DataFrame:
    """Coordinates of the features in the basis (d, r), as expressions of the row."""
    return obs.withColumn(out, F.array(*[dot(F.col("features"), literal_vector(q)) for q in basis.T]))


def cluster_means(obs: DataFrame, label: str, k: int) -> DataFrame:
    """(k, n, mean): mean features of the labels 0..k-1; a label without rows has a mean of zeros."""
    d = dimension(obs)
    sums = feature_sums(obs, [label]).select(F.col(label).cast("int").alias("k"), "n", "s")
    wanted = obs.sparkSession.range(k).select(F.col("id").cast("int").alias("k"))
    zero = F.array_repeat(F.lit(0.0), d)
    return wanted.join(sums, "k", "left").select(
        "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.transform("s", lambda x: x / F.col("n")), zero).alias("mean")
    )


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("int"))


def from_one_hot(z: Column) -> Column:
    """Place of the first largest element."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def simplex_projection(v: Column, radius: float = 1.0) -> Column:
    """Euclidean projection of an array on {x >= 0, sum x = radius}, as one expression."""
    down = F.reverse(F.array_sort(v))
    # Running (count, sum, threshold): the last threshold whose element exceeds it holds.
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))

    def step(acc: Column, x: Column) -> Column:
        n, s = acc["n"] + 1, acc["s"] + x
        t = (s - F.lit(float(radius))) / n
        return F.struct(n.alias("n"), s.alias("s"), F.when(x > t, t).otherwise(acc["t"]).alias("t"))

    theta = F.aggregate(down, start, step, lambda acc: acc["t"])
    # Bound as a variable, the threshold is worked out once per row and not once per element.
    return F.transform(F.array(theta), lambda t: F.transform(v, lambda x: F.greatest(x - t, F.lit(0.0))))[0]


def hollow(gram: DataFrame) -> DataFrame:
    """A coordinate matrix (i, j, v) without its diagonal."""
    return gram.where("i <> j")


def gram_of_means(means: DataFrame, key: str, mean: str, max_rows: int = 10_000) -> DataFrame:
    """(i, j, v): inner products of a bounded table of vectors, such as class means.

    The table's size is checked, as its pairs are formed.
    """
    if means.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} vectors: use moments of the features instead")
    a = means.select(F.col(key).alias("i"), F.col(mean).alias("a"))
    b = means.select(F.col(key).alias("j"), F.col(mean).alias("b"))
    return a.join(F.broadcast(b)).select("i", "j", dot(F.col("a"), F.col("b")).alias("v"))


def centre_kernel(gram: DataFrame) -> DataFrame:
    """Row and column means taken off a coordinate matrix, the grand mean added."""
    rows, columns, everything = Window.partitionBy("i"), Window.partitionBy("j"), Window.partitionBy()
    return gram.withColumn("v", F.col("v") - F.avg("v").over(rows) - F.avg("v").over(columns) + F.avg("v").over(everything))


def normalise_kernel(gram: DataFrame) -> DataFrame:
    """v_ij / sqrt(v_ii v_jj); 0 where a diagonal place is not above 0."""
    diag = gram.where("i = j").select(F.col("i").alias("_k"), F.col("v").alias("_d"))
    di, dj = diag.toDF("i", "_di"), diag.toDF("j", "_dj")
    ok = (F.col("_di") > 0) & (F.col("_dj") > 0)
    return gram.join(di, "i").join(dj, "j").withColumn("v", F.when(ok, F.col("v") / F.sqrt(F.col("_di") * F.col("_dj"))).otherwise(0.0)).drop("_di", "_dj")


def rbf_kernel(gram: DataFrame, width: float) -> DataFrame:
    """exp(-|x - y|^2 / width) from inner products."""
    diag = gram.where("i = j").select(F.col("i").alias("_k"), F.col("v").alias("_d"))
    both = gram.join(diag.toDF("i", "_di"), "i").join(diag.toDF("j", "_dj"), "j")
    return both.withColumn("v", F.exp(-(F.col("_di") - 2 * F.col("v") + F.col("_dj")) / F.lit(float(width)))).drop("_di", "_dj")


def kernel_alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """(alignment): Frobenius product of two kernels over the product of their norms."""
    both = a.toDF("i", "j", "va").join(b.toDF("i", "j", "vb"), ["i", "j"])
    return both.agg((F.sum(F.col("va") * F.col("vb")) / F.sqrt(F.sum(F.col("va") * F.col("va")) * F.sum(F.col("vb") * F.col("vb")))).alias("alignment"))


def std_scale(direction: np.ndarray, moment: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """A direction scaled to length one and divided by the deviation of the rows' projections on it.

    The deviation follows from the moment and the sum of the rows.
    """
    u = direction / max(np.linalg.norm(direction), 1e-300)
    mean = total @ u / n
    std = np.sqrt(max(u @ moment @ u / n - mean * mean, 0.0))
    return u / std if std >= 1e-12 else u
