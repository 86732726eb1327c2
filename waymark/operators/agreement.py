"""Agreement, stability, drift and probe metrics (Q1-Q15)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.common import dot
from waymark.operators.vectors import moments_by

#: Labels that alignment takes; their table of counts meets the driver.
MOST_ALIGNED = 1000


def per_class(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(label, support, tp, precision, recall, f1) of every label seen on either side; 0 where undefined."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    rows = cells.select(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("told"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    rows = rows.unionByName(cells.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("told"), F.lit(0).cast("long").alias("tp")))
    c = rows.groupBy("label").agg(F.sum("support").alias("support"), F.sum("told").alias("told"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("told")), "recall": ratio(F.col("tp"), F.col("support"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("told")


def classification_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Q1: one row (n, accuracy, balanced_accuracy, macro_f1)."""
    c = per_class(df, y, p)
    real = F.when(F.col("support") > 0, F.col("recall"))
    return c.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(real).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(la, lb, n) of two labelings (id, label) of the same rows."""
    return a.select("id", F.col("label").alias("la")).join(b.select("id", F.col("label").alias("lb")), "id").groupBy("la", "lb").agg(F.count("*").alias("n"))


def best_assignment(gain: np.ndarray) -> list[int]:
    """Column of each row of a square matrix in the one-to-one assignment of most gain, by shortest augmenting paths."""
    n = len(gain)
    cost = gain.max(initial=0) - gain.astype(float)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, dtype=int)  # row at each column, from 1; column 0 holds the row being placed
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while row_of[at]:
            done[at] = True
            r = row_of[at]
            slack = np.append(np.inf, cost[r - 1] - u[r] - v[1:])
            better = ~done & (slack < least)
            least[better], back[better] = slack[better], at
            step_to = int(np.where(done, np.inf, least).argmin())
            delta = least[step_to]
            u[row_of[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            at = step_to
        while at:
            row_of[at] = row_of[back[at]]
            at = back[at]
    out = [0] * n
    for c in range(1, n + 1):
        out[row_of[c] - 1] = c - 1
    return out


def align(a: DataFrame, b: DataFrame) -> tuple[dict, float]:
    """Q2: the one-to-one map from labels of b to labels of a with the most overlap, and the share that agrees."""
    cells = {(r["la"], r["lb"]): r["n"] for r in contingency(a, b).limit(MOST_ALIGNED**2 + 1).collect()}
    la, lb = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    k = max(len(la), len(lb))
    if k > MOST_ALIGNED:
        raise ValueError(f"more than {MOST_ALIGNED} labels")
    gain = np.zeros((k, k))
    for i, y in enumerate(lb):
        for j, x in enumerate(la):
            gain[i, j] = cells.get((x, y), 0)
    to = best_assignment(gain)
    hit = sum(gain[i, j] for i, j in enumerate(to))
    return {y: la[to[i]] if to[i] < len(la) else None for i, y in enumerate(lb)}, float(hit) / max(1, sum(cells.values()))


def pairwise_stability(runs: DataFrame) -> DataFrame:
    """Q3: (seed_a, seed_b, n, ari, nmi) for each pair of runs (seed, id, label), from contingency counts."""
    a = runs.select("id", F.col("seed").alias("seed_a"), F.col("label").alias("la"))
    b = runs.select("id", F.col("seed").alias("seed_b"), F.col("label").alias("lb"))
    pair = ["seed_a", "seed_b"]
    cells = a.join(b, "id").where("seed_a < seed_b").groupBy(*pair, "la", "lb").agg(F.count("*").cast("double").alias("n"))
    w, wa, wb = Window.partitionBy(*pair), Window.partitionBy(*pair, "la"), Window.partitionBy(*pair, "lb")
    cells = cells.withColumns({"t": F.sum("n").over(w), "ra": F.sum("n").over(wa), "rb": F.sum("n").over(wb)})
    two = lambda x: x * (x - 1) / 2
    n = F.col("n")
    per = cells.groupBy(*pair).agg(
        F.max("t").alias("n"),
        F.sum(two(n)).alias("same"),
        F.sum(n / F.col("t") * F.ln(n * F.col("t") / (F.col("ra") * F.col("rb")))).alias("mi"),
        F.sum(two(F.col("ra")) * n / F.col("ra")).alias("sa"),
        F.sum(two(F.col("rb")) * n / F.col("rb")).alias("sb"),
        F.sum(-n / F.col("t") * F.ln(F.col("ra") / F.col("t"))).alias("ha"),
        F.sum(-n / F.col("t") * F.ln(F.col("rb") / F.col("t"))).alias("hb"),
    )
    chance = F.col("sa") * F.col("sb") / two(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(top == chance, 1.0).otherwise((F.col("same") - chance) / (top - chance))
    nmi = F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb")))
    return per.select(*pair, F.col("n").cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def centroid_cosine(a: DataFrame, b: DataFrame, mapping: dict) -> DataFrame:
    """Q4: the mean cosine of centroids (label, vec) of two runs after alignment."""
    named = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in mapping.items() if v is not None])
    met = b.select(named.alias("label"), F.col("vec").alias("w")).join(a, "label")
    return met.agg(F.avg(dot(F.col("vec"), F.col("w")) / F.sqrt(dot(F.col("vec"), F.col("vec")) * dot(F.col("w"), F.col("w")))).alias("cosine"))


def medoid_run(pairs: DataFrame) -> DataFrame:
    """Q5: the run with the highest mean ARI to the others; ties to the smaller seed."""
    both = pairs.select(F.col("seed_a").alias("seed"), "ari").unionByName(pairs.select(F.col("seed_b").alias("seed"), "ari"))
    return both.groupBy("seed").agg(F.avg("ari").alias("mean_ari")).orderBy(F.desc("mean_ari"), "seed").limit(1)


def consensus(aligned: DataFrame) -> DataFrame:
    """Q5: from aligned runs (seed, id, label): mean top vote share and the shares of rows at 1, at 0.9 or more, below 0.7."""
    votes = aligned.groupBy("id", "label").agg(F.count("*").alias("v")).groupBy("id").agg((F.max("v") / F.sum("v")).alias("q"))
    share = lambda c: F.avg(c.cast("double"))
    return votes.agg(F.avg("q").alias("mean_q"), share(F.col("q") == 1).alias("share_full"), share(F.col("q") >= 0.9).alias("share_high"), share(F.col("q") < 0.7).alias("share_low"))


def summarize_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q6: mean, population SD, median, least and largest of each metric."""
    aggs = [F.struct(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.median(c).alias("median"), F.min(c).alias("least"), F.max(c).alias("most")).alias(c) for c in cols]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def cluster_fractions(labels: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Q7: one row, the ascending shares of all k clusters, empty ones included."""
    n = labels.groupBy(label).agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(k).select(F.col("id").alias(label)).join(n, label, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(F.sort_array(F.collect_list("n")).alias("a"), F.sum("n").alias("t")).select(F.transform("a", lambda x: x / F.col("t")).alias("fractions"))


def run_metrics(runs: DataFrame, objectives: DataFrame, k: int) -> DataFrame:
    """Q8: per seed the objective and the least and largest cluster share."""
    n = runs.groupBy("seed", "label").agg(F.count("*").alias("n"))
    per = n.groupBy("seed").agg((F.when(F.count("*") < k, F.lit(0)).otherwise(F.min("n")) / F.sum("n")).alias("min_share"), (F.max("n") / F.sum("n")).alias("max_share"))
    return per.join(objectives, "seed")


def budget_summary(restarts: DataFrame, budgets: list[int]) -> DataFrame:
    """Q8: per budget R the mean and least gap of each outer seed's best objective of its first R restarts to the best of all."""
    top = restarts.agg(F.max("objective").alias("top"))
    rows = restarts.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("restart < budget").groupBy("budget", "outer_seed").agg(F.max("objective").alias("best"))
    return rows.crossJoin(F.broadcast(top)).groupBy("budget").agg(F.avg(F.col("top") - F.col("best")).alias("mean_gap"), F.max(F.col("top") - F.col("best")).alias("max_gap"))


def drift_metrics(rows: DataFrame, splits: list[str], reference: str, latent: str = "latent", state: str = "state") -> DataFrame:
    """Q9: per split (a weight column of 0 and 1): alignment of latents to states by Procrustes and least squares, and drift to the reference.

    All sums are cross products; only (D + d) square matrices meet the driver.
    """
    spark, out, q_ref, basis = rows.sparkSession, [], None, None
    names = [reference, *[s for s in splits if s != reference]]
    sums = moments_by(rows.select(latent, state, *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in names]), [latent, state], names)
    d = rows.select(F.max(F.size(state))).first()[0]
    for name in names:
        n, s, c = sums[name]
        if n < 4:
            continue
        mean = s / n
        cov = c / n - np.outer(mean, mean)
        k = len(mean) - d
        if basis is None:
            values, vectors = np.linalg.eigh(cov[:k, :k])
            basis = vectors[:, np.argsort(-values)[:d]]
            state_scale = np.sqrt(np.maximum(np.diag(cov[k:, k:]), 1e-12))
        zz, zs = basis.T @ cov[:k, :k] @ basis, basis.T @ cov[:k, k:] / state_scale
        ss = cov[k:, k:] / np.outer(state_scale, state_scale)
        u, sv, vt = np.linalg.svd(zs)
        q = u @ vt
        residual = float(np.trace(zz) + np.trace(ss) - 2 * sv.sum())
        fit = np.linalg.pinv(cov[:k, :k]) @ cov[:k, k:]
        r2 = float(1 - np.trace(cov[k:, k:] - fit.T @ cov[:k, k:]) / max(np.trace(cov[k:, k:]), 1e-12))
        if q_ref is None:
            q_ref, residual_ref = q, residual
        out.append((name, int(n), float(np.linalg.norm(q - q_ref)), residual, residual / residual_ref if residual_ref else None, r2, float(np.linalg.norm(q.T @ q - np.eye(len(q))))))
    return spark.createDataFrame(out, "split string, n long, drift double, residual double, residual_ratio double, r2 double, orthogonality double")


def iid_drift(rows: DataFrame, reference: str, trials: int, share: float, seed: int, id_col: str = "id", **cols) -> DataFrame:
    """Q10: Q9 on random subsets of the rows outside the reference, one weight column per trial."""
    from waymark.functions.common import uniform

    names = [f"iid_{t}" for t in range(trials)]
    marked = rows.withColumns({n: ~F.col(reference) & (uniform(seed + t, id_col) < share) for t, n in enumerate(names)})
    return drift_metrics(marked, names, reference, **cols).where(F.col("split") != reference)


def add_excess(rows: DataFrame, boot: DataFrame, metric: str) -> DataFrame:
    """Q11: the metric less the mean of the finite bootstrap values, and that over their sample SD (null below 2)."""
    ok = F.when(~F.isnan(metric) & (F.abs(metric) < float("inf")), F.col(metric))
    one = boot.agg(F.avg(ok).alias("_m"), F.when(F.count(ok) > 1, F.stddev_samp(ok)).alias("_s"))
    return rows.crossJoin(F.broadcast(one)).withColumns({"excess": F.col(metric) - F.col("_m"), "z": F.try_divide(F.col(metric) - F.col("_m"), F.col("_s"))}).drop("_m", "_s")


def add_iid_ratios(rows: DataFrame, metric: str, iid: str = "iid") -> DataFrame:
    """Q12: the metric over the same seed's iid row; null if that is missing or zero."""
    base = rows.where(F.col("split") == iid).select("seed", F.col(metric).alias("_b"))
    return rows.join(base, "seed", "left").withColumn("ratio", F.try_divide(F.col(metric), F.col("_b"))).drop("_b")


def probe(df: DataFrame, kind: str = "linear", features: str = "latent", label: str = "label", split: str = "split", rff_dim: int = 256, gamma: float = 0.05, seed: int = 0) -> DataFrame:
    """Q13: a softmax probe fitted on split train, scored on the other splits: (split, n, accuracy, balanced_accuracy, macro_f1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer
    from pyspark.ml.functions import array_to_vector

    from waymark.operators.vectors import rff, standardize_from

    rows = standardize_from(df, F.col(split) == "train", features, "_z")
    if kind == "rff":
        rows = rff(rows, rff_dim, gamma, seed, "_z", "_z")
    rows = rows.withColumn("_raw", array_to_vector("_z"))
    train = rows.where(F.col(split) == "train")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(train)
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(train)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", family="multinomial", maxIter=50, regParam=1e-4).fit(index.transform(scaler.transform(train)))
    told = model.transform(index.transform(scaler.transform(rows)))
    out = None
    for name in sorted(r[0] for r in df.select(split).distinct().collect()):
        one = classification_metrics(told.where(F.col(split) == name), "_y", "_p").select(F.lit(name).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def probe_summary(runs: DataFrame, metric: str = "macro_f1", base: str = "linear") -> DataFrame:
    """Q14: per model mean and population SD over seeds, mean paired difference to ``base`` and the number of positive ones."""
    other = runs.where(F.col("model") == base).select("seed", F.col(metric).alias("_b"))
    delta = F.col(metric) - F.col("_b")
    return runs.join(other, "seed", "left").groupBy("model").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.avg(delta).alias("mean_delta"), F.count_if(delta > 0).alias("n_positive"))


def projection_sample(df: DataFrame, label: str, per_class_rows: int, dim: int = 50, seed: int = 0, id_col: str = "id", train: Column | None = None) -> DataFrame:
    """Q15: a balanced sample with its coordinates on the components of the standardised training rows."""
    from waymark.operators.sampling import balanced_sample
    from waymark.operators.vectors import prepare_projection

    return prepare_projection(balanced_sample(df, label, per_class_rows, seed, id_col), train if train is not None else F.lit(True), dim)
