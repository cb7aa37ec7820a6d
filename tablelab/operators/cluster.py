"""Clustering (C1-C8): k-means on standardised numerics, all k and starts at once (:mod:`lloyd`);
profiles, sizes and the Calinski-Harabasz ratio are aggregates over the
assignment.  ``assign_nearest`` is the deterministic stand-in (given centroids)
that SQL can replay."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.stats import attach, q
from tablelab.operators.lloyd import blocks_of, drawn, fit_blocks, silhouettes
from tablelab.operators.preprocess import fit_impute, fit_scale, numeric_cols
from tablelab.session import even_out


def prepare(df: DataFrame, cols: list[str] | None = None, key: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Mean fill and population-std standardisation of >= 2 numeric
    columns, assembled into ``features``."""
    cols = cols or numeric_cols(df)
    if len(cols) < 2:
        raise ValueError("need at least 2 numeric columns for clustering")
    sub = df.select(*[q(k) for k in (key or [])], *[q(c).cast("double").alias(c) for c in cols])
    filled = fit_impute(sub.select(*cols), "mean")
    sub = filled.transform(sub)
    scaled = fit_scale(sub.select(*cols), "standard").transform(sub)
    return VectorAssembler(inputCols=cols, outputCol="features").transform(scaled), cols


def k_sweep(feat: DataFrame, k_max: int = 10, seed: int = 42, starts: int = 10) -> tuple[DataFrame, dict]:
    """C2 + C3: for k = 2..min(k_max, n-1): k-means inertia, the best of ``starts``
    runs, and silhouette (of squared Euclidean distances as in Spark's evaluator, computed
    in O(n k), all k in two passes); also the centres by k."""
    feat = even_out(feat.select("features"))
    n = feat.count()
    ks = list(range(2, min(k_max, n - 1) + 1))
    models, scores = {}, []
    if ks:
        points = drawn(feat, seed)
        blocks = blocks_of(feat, points)
        models = fit_blocks(blocks, points, ks, starts, seed)
        scores = silhouettes(blocks, [models[k][0] for k in ks])
    rows = [(k, models[k][1], s) for k, s in zip(ks, scores)]
    return feat.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double"), {k: m[0] for k, m in models.items()}


def assign_centers(feat: DataFrame, centers: np.ndarray, out: str) -> DataFrame:
    """Index of the nearest centre (ties: the first) of the vector column ``features``."""
    @F.arrow_udf("int")
    def near(x: pa.Array) -> pa.Array:
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, centers.shape[1]))
        return pa.array(((centers * centers).sum(1) - 2 * (x @ centers.T)).argmin(1), pa.int32())

    return feat.withColumn(out, near(vector_to_array("features")))


@dataclass
class ClusterRun:
    best_k: int
    sweep: DataFrame
    assigned: DataFrame
    projection: DataFrame
    centers_2d: list = field(default_factory=list)
    explained: list = field(default_factory=list)


def run(df: DataFrame, cols: list[str] | None = None, key: list[str] | None = None, k_max: int = 10,
        seed: int = 42) -> ClusterRun:
    """Sweep, best k by silhouette (first wins ties), assignment as a
    new column (the input frame is not modified), 2-D PCA of points and
    centroids."""
    feat, cols = prepare(df, cols, key)
    feat = even_out(feat)   # read again rather than written, unless few tasks hold its rows
    sweep, models = k_sweep(feat, k_max, seed)
    best = sorted(sweep.collect(), key=lambda r: (-r["silhouette"], r["k"]))[0]["k"]   # <= k_max rows
    assigned = assign_centers(feat, models[best], "cluster")
    pca = PCA(k=2, inputCol="features", outputCol="pc").fit(feat)
    proj = pca.transform(assigned).select(*[q(k) for k in (key or [])], "cluster",
                                          vector_to_array("pc")[0].alias("pc1"), vector_to_array("pc")[1].alias("pc2"))
    pc = pca.pc.toArray()
    centers = [[float(sum(c[i] * pc[i][j] for i in range(len(c)))) for j in range(2)] for c in models[best]]
    return ClusterRun(best, sweep, assigned, proj, centers, [float(v) for v in pca.explainedVariance.toArray()])


def assign_nearest(df: DataFrame, cols: list[str], centroids: list[list[float]], out: str = "cluster") -> DataFrame:
    """C4 with given centroids: index of the nearest centroid (squared
    Euclidean; the lower index wins ties).  A projection: k expressions."""
    ds = []
    for j, c in enumerate(centroids):
        d = sum(((q(col).cast("double") - F.lit(float(v))) * (q(col).cast("double") - F.lit(float(v)))
                 for col, v in zip(cols, c)), F.lit(0.0))
        ds.append(F.struct(d.alias("d"), F.lit(j).alias("j")))
    return df.withColumn(out, F.least(*ds)["j"] if len(ds) > 1 else F.lit(0))


def profile(assigned: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean of each numeric per cluster, 2 dp."""
    return assigned.groupBy(cluster).agg(*[F.round(F.avg(q(c)), 2).alias(c) for c in cols])


def sizes(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Count and share per cluster."""
    c = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    tot = c.agg(F.sum("size").alias("_n"))
    return attach(c, tot).select(cluster, F.col("size").cast("long"), F.round(F.col("size") / F.col("_n"), 4).alias("share"))


def calinski_harabasz(assigned: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """(between-cluster dispersion / (k-1)) / (within-cluster dispersion /
    (n-k)), 2 dp.  Two passes: cluster means (k rows, broadcast), then sums of
    squares."""
    means = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("_nk"),
                                          *[F.avg(q(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    overall = assigned.agg(*[F.avg(q(c)).alias(f"_g{i}") for i, c in enumerate(cols)])
    ssw = assigned.join(F.broadcast(means), cluster).agg(
        F.sum(sum(((q(c) - F.col(f"_m{i}")) * (q(c) - F.col(f"_m{i}")) for i, c in enumerate(cols)),
                  F.lit(0.0))).alias("ssw"),
        F.count(F.lit(1)).alias("n"))
    ssb = attach(means, overall).agg(
        F.sum(F.col("_nk") * sum(((F.col(f"_m{i}") - F.col(f"_g{i}")) * (F.col(f"_m{i}") - F.col(f"_g{i}"))
                                  for i in range(len(cols))),
                                 F.lit(0.0))).alias("ssb"),
        F.count(F.lit(1)).alias("k"))
    r = attach(ssw, ssb)
    ch = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return r.select(F.col("k").cast("int"), F.col("n").cast("long"),
                    F.round(F.when(F.col("k") > 1, ch), 2).alias("calinski_harabasz"))
