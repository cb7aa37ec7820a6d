"""Linear models of all folds from one scan.

Least squares with any penalty depends on the rows only through their number, means
and products.  One scan sums, for every fold, the products of (value, is missing, label);
imputation by the training mean and scaling are linear in those, so the sums of any
training set follow by adding folds.  ``pyspark.ml`` then fits every model on 2 (p + 1)
points that have the means and covariances of the training rows, and one more scan
scores all models on all folds.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.stats import q
from tablelab.operators import metrics as MT

NO_SPREAD = 1e-14   # variance, as a share of the mean square, that is rounding only


@dataclass
class Moments:
    shift: np.ndarray   # centre of every feature, then of the label
    sums: dict          # fold -> products of [value, is missing, label, 1], 2p + 2 each way


def fold_moments(rows: DataFrame, cols: list[str]) -> Moments | None:
    """None where a feature has no value or the label is not finite."""
    names, p = [f"c{i}" for i in range(len(cols))], len(cols)
    data = rows.select("fold", F.col("label").alias("y"), *[F.nanvl(q(c), F.lit(None)).alias(n) for c, n in zip(cols, names)])
    centre = np.array([np.nan if v is None else v for v in data.agg(*[F.avg(n) for n in (*names, "y")]).first()], float)
    if not np.isfinite(centre).all():
        return None

    def products(batches):
        total: dict = {}
        for pdf in batches:
            x, fold = pdf[[*names, "y"]].to_numpy(dtype="float64") - centre, pdf["fold"].to_numpy()
            gone = np.isnan(x[:, :p])
            u = np.hstack([np.where(gone, 0.0, x[:, :p]), gone, x[:, p:], np.ones((len(x), 1))])
            for f in np.unique(fold):
                part = u[fold == f]
                total[f] = total.get(f, 0.0) + part.T @ part
        if total:
            yield pd.DataFrame({"fold": list(total), "g": [g.ravel().tolist() for g in total.values()]})

    size, sums = 2 * p + 2, {}
    parts = data.mapInPandas(products, "fold int, g array<double>")
    for r in parts.select("fold", F.posexplode("g").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["fold"], np.zeros(size * size))[r["i"]] = r["v"]   # (2p + 2)^2 numbers a fold
    return Moments(centre, {f: g.reshape(size, size) for f, g in sums.items()})


@dataclass
class Points:
    mean: np.ndarray    # of the imputed features, which is what a missing value becomes
    shift: np.ndarray   # a feature is (value - shift) * unit; unit 0: it does not vary
    unit: np.ndarray
    rows: list          # (features, label) with the training rows' means and covariances


def points(m: Moments, folds, scaled: bool) -> Points | None:
    """Of the rows of ``folds``, standardised or not; None where a feature has no value there or a sum is not finite."""
    total = sum((m.sums[f] for f in folds if f in m.sums), np.zeros((2 * len(m.shift),) * 2))
    p, n = len(m.shift) - 1, total[-1, -1]
    have = n - total[p:2 * p, -1]
    if not np.isfinite(total).all() or n < 1 or (have < 1).any():
        return None
    away = total[:p, -1] / have                                        # imputed value, from the centre
    to = np.zeros((p + 1, 2 * p + 2))
    to[:p, :p], to[:p, p:2 * p], to[p, 2 * p] = np.eye(p), np.diag(away), 1.0
    mean, square = to @ total[:, -1] / n, to @ total @ to.T / n
    cov = square - np.outer(mean, mean)
    var = np.where(np.diag(cov) > NO_SPREAD * np.diag(square), np.diag(cov), 0.0)
    unit = np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)
    w, v = np.linalg.eigh(cov * np.outer(unit, unit))
    arms = v * np.sqrt(np.maximum(w, 0.0) * (p + 1)) * np.sqrt(var)[:, None]   # columns: principal directions
    mean = m.shift + mean
    shift, unit = (mean[:p], unit[:p] * np.sqrt((n - 1) / n)) if scaled else (np.zeros(p), np.ones(p))   # as StandardScaler
    rows = [(Vectors.dense((mean[:p] - shift + s * arms[:p, j]) * unit), float(mean[p] + s * arms[p, j]))
            for j in range(p + 1) for s in (1.0, -1.0)]
    return Points(mean[:p], shift, unit, rows)


def fit_all(train: DataFrame, cols: list[str], estimators: dict, folds: int, parallelism: int = 4) -> dict:
    """``estimators``: name -> (estimator, whether features are scaled).  Gives name -> (fitted
    model, score of every fold); empty where the rows have no such sums (:func:`points`):
    such rows are left to the plain pipeline.  A model's own summary is that of the points."""
    m = fold_moments(train, cols) if cols else None
    sets = {} if m is None else {(scaled, f): points(m, set(range(folds)) - {f}, scaled)
                                 for scaled in {scaled for _, scaled in estimators.values()} for f in (None, *range(folds))}
    if not sets or any(s is None for s in sets.values()):
        return {}
    spark = train.sparkSession
    frames = {at: spark.createDataFrame(s.rows, ["features", "label"]).coalesce(1) for at, s in sets.items()}
    jobs = [(name, f) for name in estimators for f in (None, *range(folds))]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models = dict(zip(jobs, pool.map(lambda j: estimators[j[0]][0].fit(frames[estimators[j[0]][1], j[1]]), jobs)))

    def predicted(name):
        out = F.lit(None).cast("double")
        for f in range(folds):
            lr, s = models[name, f], sets[estimators[name][1], f]
            slopes = lr.coefficients.toArray() * s.unit
            value = F.lit(float(lr.intercept + slopes @ (s.mean - s.shift)))
            for c, slope, mean in zip(cols, slopes, s.mean):
                if slope != 0:   # a missing value is at the mean
                    value = value + F.coalesce(F.nanvl(q(c), F.lit(None)) - F.lit(float(mean)), F.lit(0.0)) * F.lit(float(slope))
            out = F.when(F.col("fold") == f, value).otherwise(out)
        return out

    held = train.select("fold", "label", *[predicted(name).alias(f"p{i}") for i, name in enumerate(estimators)])
    got = {r["fold"]: r for r in MT.r2_by(held, "fold", "label", [f"p{i}" for i in range(len(estimators))], 12).collect()}
    return {name: (models[name, None], [got[f][f"p{i}"] if f in got else None for f in range(folds)])
            for i, name in enumerate(estimators)}
