"""Agreement of two labelings, from their contingency table.

Labels are compared up to renaming.  Rows are counted once per pair of labels; all
figures follow from these few counts.  ``keys`` are grouping columns, such as a run
and a method, so one plan scores a whole grid.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, pred: str, true: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pred, true, n); rows without either label are left out."""
    rows = df.where(F.col(pred).isNotNull() & F.col(true).isNotNull())
    return rows.groupBy(*keys, F.col(pred).alias("pred"), F.col(true).alias("true")).agg(F.count(F.lit(1)).alias("n"))


def sign_error(df: DataFrame, pred: str, true: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, error): share of differing signs, the better of both global signs; labels are -1 and 1."""
    wrong = F.avg((F.col(pred) != F.col(true)).cast("double"))
    flipped = F.avg((F.col(pred) != -F.col(true)).cast("double"))
    return df.groupBy(*keys).agg(F.least(wrong, flipped).alias("error"))


def signum_error(df: DataFrame, pred: str, true: str, keys: Sequence[str] = ()) -> DataFrame:
    """As ``sign_error`` after taking the signs of both columns; 0 stays 0."""
    signs = df.withColumn("_p", F.signum(F.col(pred).cast("double"))).withColumn("_t", F.signum(F.col(true).cast("double")))
    return sign_error(signs, "_p", "_t", keys)


def match_rate(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rate): share of rows on which two columns are exactly equal."""
    return df.groupBy(*keys).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("rate"))


def contrast_error(table: DataFrame, a: int, b: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, error): among rows of true label a or b, the share wrong under the best map of predictions to a and b."""
    best = table.where(F.col("true").isin(a, b)).groupBy(*keys, "pred").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.groupBy(*keys).agg((1 - F.sum("m") / F.sum("n")).alias("error"))


def permutation_error(table: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, error): least share of wrong rows over all k! renamings of the predictions 0..k-1, for k up to 6."""
    if k > 6:
        raise ValueError("too many renamings: use matched_accuracy")
    maps = F.array(*[F.array(*map(F.lit, p)) for p in itertools.permutations(range(k))])
    each = table.select(*keys, "pred", "true", "n", F.posexplode(maps).alias("_map", "_to"))
    hit = F.when(F.try_element_at("_to", F.col("pred").cast("int") + 1) == F.col("true"), F.col("n")).otherwise(0)
    return each.groupBy(*keys, "_map").agg((1 - F.sum(hit) / F.sum("n")).alias("e")).groupBy(*keys).agg(F.min("e").alias("error"))


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ari): adjusted Rand index; 1 where both labelings are trivial alike."""
    cells = table.groupBy(*keys).agg(F.sum(_choose2(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    rows = table.groupBy(*keys, "pred").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_choose2(F.col("n"))).alias("a"))
    columns = table.groupBy(*keys, "true").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_choose2(F.col("n"))).alias("b"))
    both = _meet(_meet(cells, rows, keys), columns, keys)
    expected = F.col("a") * F.col("b") / F.nullif(_choose2(F.col("n")), F.lit(0.0))
    most = (F.col("a") + F.col("b")) / 2
    return both.select(*keys, F.when(expected.isNull() | (most == expected), 1.0).otherwise((F.col("c") - expected) / (most - expected)).alias("ari"))


def v_measure(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, homogeneity, completeness, v_measure)."""
    p, t, all_ = Window.partitionBy(*keys, "pred"), Window.partitionBy(*keys, "true"), Window.partitionBy(*keys)
    share = table.select(*keys, "pred", "true", "n", F.sum("n").over(p).alias("np"), F.sum("n").over(t).alias("nt"), F.sum("n").over(all_).alias("all"))
    x = F.col("n") / F.col("all")
    parts = share.groupBy(*keys).agg(
        (-F.sum(x * F.log(F.col("n") / F.col("np")))).alias("h_tp"),
        (-F.sum(x * F.log(F.col("n") / F.col("nt")))).alias("h_pt"),
        (-F.sum(x * F.log(F.col("nt") / F.col("all")))).alias("h_t"),
        (-F.sum(x * F.log(F.col("np") / F.col("all")))).alias("h_p"),
    )
    h = F.when(F.col("h_t") > 1e-15, 1 - F.col("h_tp") / F.col("h_t")).otherwise(1.0)
    c = F.when(F.col("h_p") > 1e-15, 1 - F.col("h_pt") / F.col("h_p")).otherwise(1.0)
    return parts.select(*keys, h.alias("homogeneity"), c.alias("completeness")).withColumn(
        "v_measure", F.when(F.col("homogeneity") + F.col("completeness") > 0, 2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))).otherwise(0.0)
    )


def _meet(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on the keys; without keys both sides have one row."""
    return a.join(b, list(keys)) if keys else a.join(F.broadcast(b), how="cross")


def confusion(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Contingency with ``share``: the part of the true label's rows."""
    return table.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "true")))


def assign_labels(gain: np.ndarray) -> np.ndarray:
    """Column of each row of a square matrix so that the sum is largest: shortest augmenting paths."""
    cost = gain.max(initial=0) - gain
    n = len(cost)
    u, v, match = np.zeros(n), np.zeros(n), np.full(n, -1)
    for row in range(n):
        dist = cost[row] - u[row] - v
        came, done, at = np.full(n, row), np.zeros(n, bool), -1
        parent = np.full(n, -1)
        while True:
            j = int(np.argmin(np.where(done, np.inf, dist)))
            done[j] = True
            if match[j] < 0:
                at = j
                break
            i, low = match[j], dist[j]
            step = low + cost[i] - u[i] - v
            closer = ~done & (step < dist)
            dist[closer], parent[closer], came[closer] = step[closer], j, i
        low = dist[at]
        settled = done & (np.arange(n) != at)
        v[settled] += dist[settled] - low
        u[match[settled]] += low - dist[settled]
        u[row] += low
        while at >= 0:
            before = parent[at]
            match[at] = row if before < 0 else match[before]
            at = before
    out = np.empty(n, int)
    out[match] = np.arange(n)
    return out


def matched_accuracy(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, accuracy): share of rows on the best one-to-one map of predicted to true labels.

    The tables of the groups, of as many rows as there are pairs of labels, are
    matched one group to a task.
    """
    kinds = ", ".join(f"`{k}` {t}" for k, t in table.dtypes if k in keys)

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, t = pd.factorize(pdf["pred"])[0], pd.factorize(pdf["true"])[0]
        m = np.zeros((max(p.max(), t.max()) + 1,) * 2)
        m[p, t] = pdf["n"]
        hit = m[np.arange(len(m)), assign_labels(m)].sum()
        return pd.DataFrame([[*key, float(hit / m.sum())]], columns=[*keys, "accuracy"])

    return table.groupBy(*keys).applyInPandas(best, f"{kinds}, accuracy double")


def reassignment(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pred, true, n): the true label that each predicted one is given on the best one-to-one map, and their common rows.

    Predicted labels beyond the number of true ones are given none (null).
    """
    kinds = dict(table.dtypes)

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (p, pred), (t, true) = (pd.factorize(pdf[c], sort=True) for c in ("pred", "true"))
        m = np.zeros((max(len(pred), len(true)),) * 2)
        m[p, t] = pdf["n"]
        to = assign_labels(m)
        rows = [[*key, pred[i], true[to[i]] if to[i] < len(true) else None, int(m[i, to[i]])] for i in range(len(pred))]
        return pd.DataFrame(rows, columns=[*keys, "pred", "true", "n"]).astype({"true": "Int64"} if kinds["true"] in ("int", "bigint") else {})

    return table.groupBy(*keys).applyInPandas(best, ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "pred", "true")) + ", n long")


def scores(df: DataFrame, pred: str, true: str, keys: Sequence[str]) -> DataFrame:
    """(keys, accuracy, ari, homogeneity, completeness, v_measure) of every group of runs."""
    table = contingency(df, pred, true, keys)
    return matched_accuracy(table, keys).join(adjusted_rand(table, keys), list(keys)).join(v_measure(table, keys), list(keys))


def label_separation(df: DataFrame, group: str, label: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n_groups, separated): whether the groups' most frequent labels all differ."""
    counts = df.groupBy(*keys, group, label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*keys, group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("top"))
    return top.groupBy(*keys).agg(F.count(group).alias("n_groups"), (F.count_distinct("top") == F.count(group)).alias("separated"))
