"""Ridge baselines from distributed moments, low-rank effects, principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(df: DataFrame, key: list[str], xs: list[str], ys: list[str]) -> list:
    """One pass: n, sums and products of each group; (p + q)**2 numbers go to the driver, whatever the number of rows."""
    cols = [*xs, *ys]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.groupBy(*key).agg(F.count("*").alias("n"), *sums, *products).collect()  # a row per fold


def _unpack(row, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    s = np.array([row[f"s{i}"] for i in range(p)], float)
    return float(row["n"]), s, np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)


def _solve(n: float, s: np.ndarray, xx: np.ndarray, p: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (p x q) and the unpenalised intercepts, from centred moments."""
    c = xx - np.outer(s, s) / n
    beta = np.linalg.solve(c[:p, :p] + penalty * np.eye(p), c[:p, p:])
    return beta, (s[p:] - s[:p] @ beta) / n


def ridge_fit(df: DataFrame, xs: list[str], ys: list[str], penalty: float) -> dict[str, tuple[list[float], float]]:
    """Per output: coefficients of xs and intercept. Rows with a null are left out."""
    rows = _moments(df.dropna(subset=[*xs, *ys]), [], xs, ys)
    n, s, xx = _unpack(rows[0], len(xs) + len(ys)) if rows[0]["n"] else (1.0, np.zeros(len(xs) + len(ys)), np.zeros((len(xs) + len(ys),) * 2))
    beta, intercept = _solve(n, s, xx, len(xs), penalty if penalty or rows[0]["n"] else 1.0)
    return {y: (beta[:, k].tolist(), float(intercept[k])) for k, y in enumerate(ys)}


def ridge_predict(df: DataFrame, xs: list[str], fit: dict[str, tuple[list[float], float]]) -> DataFrame:
    """Adds <output>_hat, a plain expression of the columns."""
    return df.withColumns({f"{y}_hat": sum((F.lit(b) * F.col(x) for b, x in zip(beta, xs, strict=True)), F.lit(c)) for y, (beta, c) in fit.items()})


def ridge_cv(df: DataFrame, fold: str, xs: list[str], ys: list[str], penalties: tuple[float, ...], tolerance: float) -> DataFrame:
    """penalty, mse, chosen: held-out error of each penalty; the largest within ``tolerance`` of the least is chosen.

    A fold's fit needs only the moments of all rows less its own; its error too follows from its moments, so the rows are read once.
    """
    p, q = len(xs), len(ys)
    folds = [_unpack(r, p + q) for r in _moments(df.dropna(subset=[fold, *xs, *ys]), [fold], xs, ys)]
    total = [sum(f[i] for f in folds) for i in range(3)]
    out = []
    for penalty in penalties:
        error = 0.0
        for n, s, xx in folds:
            if total[0] - n <= 0:
                continue
            beta, c = _solve(total[0] - n, total[1] - s, total[2] - xx, p, penalty)
            # sum (y - x b - c)**2 from moments of [x, y]
            for k in range(q):
                a = np.append(-beta[:, k], np.eye(q)[k])
                error += a @ xx @ a - 2 * c[k] * (a @ s) + n * c[k] ** 2
        out.append((float(penalty), float(error / max(total[0] * q, 1))))
    best = min((e for _, e in out), default=0.0)
    chosen = max(a for a, e in out if e <= best + tolerance)
    return df.sparkSession.createDataFrame([(a, e, a == chosen) for a, e in out], "penalty double, mse double, chosen boolean")


def lowrank_effect(intercept: DataFrame, terms: DataFrame, key: str, components: DataFrame) -> DataFrame:
    """key, gene, effect: the sum over components of (intercept + the key's coefficient) * loading."""
    c = terms.join(F.broadcast(intercept.withColumnRenamed("coefficient", "base")), "component")  # a row per component
    return c.join(F.broadcast(components), "component").groupBy(key, "gene").agg(F.sum((F.col("base") + F.col("coefficient")) * F.col("v")).alias("effect"))


def pca_project(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """id, scores: centred vectors on the k first principal axes; an axis' largest absolute loading is positive.

    The moments are summed per partition in numpy and then over partitions: d * d numbers each, d = the vectors' length.
    """

    def partial(batches):
        n, s, xx = 0, None, None
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float) if len(b) else None
            if x is not None:
                n, s, xx = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if xx is None else xx)
        if n:
            m = np.concatenate([[n], s, xx.ravel()])
            yield pd.DataFrame({"i": np.arange(len(m)), "v": m})

    filled = df.where(F.col(vector).isNotNull()).select(id_col, vector)
    m = filled.select(vector).mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # 1 + d + d * d numbers
    if not m:
        return filled.select(id_col, F.array().cast("array<double>").alias("scores"))
    v = np.array([r["v"] for r in m])
    d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
    mean = v[1 : d + 1] / v[0]
    values, axes = np.linalg.eigh(v[d + 1 :].reshape(d, d) / v[0] - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    centred = F.zip_with(vector, F.lit(mean.tolist()), lambda a, b: a - b)
    dot = lambda w: F.aggregate(F.zip_with("_c", F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return filled.withColumn("_c", centred).select(id_col, F.array(*[dot(axes[:, j]) for j in range(axes.shape[1])]).alias("scores"))
