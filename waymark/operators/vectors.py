"""Normalisation and linear algebra on vector columns.

Sums over rows are Spark aggregates; only D x D matrices reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.common import norm, seeded


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """V / max(norm, eps)."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x / m)  # the norm is worked out once


def column_stats(df: DataFrame, col: str = "latent", eps: float = 0.0, where: Column | None = None) -> DataFrame:
    """One row (mean, scale): per-dimension mean and population standard deviation + eps."""
    rows = df if where is None else df.where(where)
    per = rows.select(F.posexplode(col).alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m"), (F.stddev_pop(F.col("x").cast("double")) + eps).alias("s"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("d", c))), lambda x: x[c])
    return per.agg(pick("m").alias("mean"), pick("s").alias("scale"))


def scaled(v: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x.cast("double") - m), scale, lambda x, s: x / s)


def zscore_l2_fit(df: DataFrame, col: str = "latent") -> DataFrame:
    """Statistics with the effective scale, standard deviation + 1e-6."""
    return column_stats(df, col, 1e-6)


def zscore_l2(df: DataFrame, stats: DataFrame, col: str = "latent", out: str = "z") -> DataFrame:
    """Z-scored, then L2-normalised; the statistics are one row."""
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled(F.col(col), F.col("mean"), F.col("scale"))).withColumn(out, l2_normalize(F.col(out))).drop("mean", "scale")


def standardize_from(df: DataFrame, ref: Column, col: str = "latent", out: str = "z") -> DataFrame:
    """Statistics of the reference rows (+1e-8), applied to all rows."""
    stats = column_stats(df, col, 1e-8, ref)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled(F.col(col), F.col("mean"), F.col("scale"))).drop("mean", "scale")


def moments_by(df: DataFrame, cols: list[str], weights: list[str]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """weight column -> (n, sums, cross products) of the concatenated vectors, all in one pass; a partial row per task and weight."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.concatenate([np.stack([np.atleast_1d(np.asarray(v, dtype=np.float64)) for v in pdf[k]]) for k in cols], axis=1)
            for name in weights:
                w = pdf[name].to_numpy(dtype=np.float64)
                on = np.flatnonzero(w)
                if not len(on):
                    continue
                y, w = x[on], w[on]
                own = np.concatenate(([w.sum()], w @ y, ((y * w[:, None]).T @ y).ravel()))
                total[name] = total[name] + own if name in total else own
        if total:  # a task without rows has nothing to say, and an empty frame no types
            yield pd.DataFrame({"w": list(total), "v": list(total.values())})

    parts = df.select(*cols, *weights).mapInPandas(part, "w string, v array<double>")
    # 1 + D + D * D numbers a weight, element by element, by the aggregation itself
    flat = parts.select("w", F.posexplode("v").alias("i", "v")).groupBy("w", "i").agg(F.sum("v").alias("v")).collect()
    found: dict[str, dict[int, float]] = {}
    for r in flat:
        found.setdefault(r["w"], {})[r["i"]] = r["v"]
    out = {name: (0.0, np.zeros(0), np.zeros((0, 0))) for name in weights}
    for name, at in found.items():
        v = np.array([at[i] for i in range(len(at))])
        d = (math.isqrt(4 * len(v) - 3) - 1) // 2
        out[name] = (float(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return out


def moments(df: DataFrame, cols: list[str], weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sums, cross products) of the concatenated vectors."""
    if weight:
        return moments_by(df, cols, [weight])[weight]
    return moments_by(df.select(*cols).withColumn("_one", F.lit(1.0)), cols, ["_one"])["_one"]


def covariance(df: DataFrame, col: str = "latent") -> tuple[np.ndarray, np.ndarray]:
    """(mean, population covariance)."""
    n, s, c = moments(df, [col])
    mean = s / n
    return mean, c / n - np.outer(mean, mean)


def pca_fit(df: DataFrame, dim: int, col: str = "latent") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components [D, dim], eigenvalues), descending; signs are free."""
    mean, cov = covariance(df, col)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:dim]
    return mean, vectors[:, order], values[order]


def project(df: DataFrame, mean: np.ndarray, matrix: np.ndarray, col: str = "latent", out: str = "z", l2: bool = False) -> DataFrame:
    """(v - mean) @ matrix in Arrow batches, L2-normalised if asked for."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        x = (np.stack([np.asarray(a, dtype=np.float64) for a in v]) - mean) @ matrix
        if l2:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(x))

    return df.withColumn(out, apply(F.col(col)))


def pca_transform(df: DataFrame, fit: tuple, col: str = "latent", out: str = "z") -> DataFrame:
    """Coordinates on the fitted components."""
    return project(df, fit[0], fit[1], col, out)


#: Name -> (kind, dimension).
VARIANTS = {"raw": ("raw", 0), "centre": ("centre", 0), "zscore": ("zscore", 0), "pca64": ("pca", 64), "pca128": ("pca", 128), "white128": ("white", 128), "white192": ("white", 192)}


def preprocess(df: DataFrame, name: str, col: str = "latent", out: str = "z") -> DataFrame:
    """One of seven preparations of latents; all end in an L2 normalisation."""
    kind, dim = VARIANTS[name]
    if kind == "raw":
        return df.withColumn(out, l2_normalize(F.col(col)))
    if kind == "zscore":
        return zscore_l2(df, zscore_l2_fit(df, col), col, out)
    mean, cov = covariance(df, col)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: dim or len(values)]
    matrix = np.eye(len(mean)) if kind == "centre" else vectors[:, order]
    if kind == "white":
        matrix = matrix / np.sqrt(values[order] + 0.01 * values.mean())
    return project(df, mean, matrix, col, out, l2=True)


def procrustes(df: DataFrame, src: str, tgt: str) -> tuple[np.ndarray, float]:
    """The orthogonal Q nearest to S'T and the mean squared error of S @ Q, from cross products alone."""
    n, _, c = moments(df, [src, tgt])
    d = df.select(F.max(F.size(src))).first()[0]
    u, sv, vt = np.linalg.svd(c[:d, d:], full_matrices=False)
    return u @ vt, float((np.trace(c[:d, :d]) + np.trace(c[d:, d:]) - 2 * sv.sum()) / n)


def linear_fit(df: DataFrame, x: str, y: str) -> tuple[np.ndarray, float]:
    """(coefficients with the intercept last, R2), minimal norm; R2 is None below 4 rows or without variance."""
    one = df.select(F.concat(F.col(x), F.array(F.lit(1.0))).alias("x"), F.col(y).alias("y"))
    n, s, c = moments(one, ["x", "y"])
    d = one.select(F.max(F.size("x"))).first()[0] or 0
    beta = np.linalg.pinv(c[:d, :d]) @ c[:d, d:]
    total = np.trace(c[d:, d:]) - (s[d:] ** 2).sum() / n if n else 0.0
    if n < 4 or total <= 0:
        return beta, None
    rest = np.trace(c[d:, d:] - beta.T @ c[:d, d:])
    return beta, float(1 - rest / total)


def r2(df: DataFrame, x: str, y: str, half_holdout: bool = False, seed: int = 0, id_col: str = "id") -> float | None:
    """R2 in sample, or of a fit on half of the rows scored on the other half."""
    if not half_holdout:
        return linear_fit(df, x, y)[1]
    first = F.substring(seeded(seed, id_col), 1, 1) < "8"
    beta, _ = linear_fit(df.where(first), x, y)
    one = df.where(~first).select(F.concat(F.col(x), F.array(F.lit(1.0))).alias("x"), F.col(y).alias("y"))
    n, s, c = moments(one, ["x", "y"])
    d = len(beta)
    total = np.trace(c[d:, d:]) - (s[d:] ** 2).sum() / n if n else 0.0
    if n < 4 or total <= 0:
        return None
    rest = np.trace(c[d:, d:] - 2 * beta.T @ c[:d, d:] + beta.T @ c[:d, :d] @ beta)
    return float(1 - rest / total)


def control_latents(df: DataFrame, ref: Column, seed: int, col: str = "state", out: str = "latent") -> DataFrame:
    """The standardised state times a random orthogonal matrix."""
    z = standardize_from(df, ref, col, "_z")
    d = z.select(F.size("_z")).first()[0]
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return project(z, np.zeros(d), q * np.sign(np.diag(r)), "_z", out).drop("_z")


def fit_scalers(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, mean, scale) of each column over its finite rows."""
    aggs = []
    for c in cols:
        ok = F.when(~F.isnan(c), F.col(c))
        aggs.append(F.struct(F.lit(c).alias("name"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("scale")).alias(c))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def rescale_threshold(value: float, scaler: dict) -> float:
    """A threshold in the scaler's units."""
    return (value - scaler["mean"]) / scaler["scale"]


def prepare_projection(df: DataFrame, ref: Column, dim: int = 2, col: str = "latent") -> DataFrame:
    """Standardise and project on the components of the reference rows."""
    z = standardize_from(df, ref, col, "_z")
    return pca_transform(z, pca_fit(z.where(ref), dim, "_z"), "_z", "z").drop("_z")


def rff(df: DataFrame, n: int, gamma: float, seed: int, col: str = "latent", out: str = "z") -> DataFrame:
    """sqrt(2 / n) * cos(x W + b), the random Fourier map of an RBF kernel."""
    d = df.select(F.size(col)).first()[0]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(d, n)), rng.uniform(0, 2 * np.pi, n)

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(a, dtype=np.float64) for a in v])
        return pd.Series(list(np.sqrt(2 / n) * np.cos(x @ w + b)))

    return df.withColumn(out, apply(F.col(col)))
