"""Registered queries of k-means fits and of models, with SQL that unrolls the same fixed rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.common import materialize
from waymark.operators import graph, models, partition, regions, routing
from waymark.plans.data import PROTOTYPES, ZSCORED, latents
from waymark.plans.queries_models import _FIT, _fitted, _inputs, _values
from waymark.plans.queries_vectors import _W, z_table
from waymark.plans.registry import query


def r6(c):
    return F.round(c, 6)


def first_sql(rows: str, k: int, seed: int, name: str = "c0") -> str:
    """The first k rows in md5 order as centres (idx, vec)."""
    return f"{name} AS (SELECT row_number() OVER (ORDER BY md5('{seed}:' || id), id) - 1 AS idx, z AS vec FROM {rows} ORDER BY md5('{seed}:' || id), id LIMIT {k})"


def plusplus_sql(rows: str, k: int, seed: int) -> str:
    """k-means++ centres c0 (idx, vec), a step for each centre after the first."""
    out = [first_sql(rows, 1, seed, "pp0")]
    for i in range(1, k):
        u = f"(('0x' || substr(md5('{seed * 1000 + i}:' || z.id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
        out.append(f"ww{i} AS (SELECT z.id, z.z, -ln(1 - {u}) / greatest(greatest(0.0::DOUBLE, 1 - max(list_inner_product(z.z, vec))), 1e-300) AS key FROM {rows} z, pp{i - 1} GROUP BY z.id, z.z)")
        out.append(f"pp{i} AS (SELECT * FROM pp{i - 1} UNION ALL (SELECT {i}, z FROM ww{i} ORDER BY key, id LIMIT 1))")
    return ", ".join(out) + f", c0 AS (SELECT * FROM pp{k - 1})"


def rounds_sql(rows: str, n: int, all_rows: str = "z") -> str:
    """n rounds of assignment and normalised mean from c0, then ``fitted`` (id, region) of all rows."""
    out = []
    own = "SELECT y.id, any_value(y.z) AS z, arg_max(idx, {{'s': round(list_inner_product(y.z, vec), 12), 'i': -idx}}) AS region FROM {} y, {} GROUP BY y.id"
    for i in range(n):
        out.append(f"a{i} AS ({own.format(rows, f'c{i}')})")
        out.append(f"m{i} AS (SELECT region, d, sum(x) AS x FROM (SELECT region, unnest(range(1, len(z) + 1)) AS d, unnest(z) AS x FROM a{i}) GROUP BY 1, 2)")
        out.append(f"c{i + 1} AS (SELECT m{i}.region AS idx, list(x / n ORDER BY d) AS vec FROM m{i} JOIN (SELECT region, sqrt(sum(x * x)) AS n FROM m{i} GROUP BY 1) q ON q.region = m{i}.region GROUP BY 1)")
    return ", ".join(out) + f", fitted AS ({own.format(all_rows, f'c{n}')})"


def _labels(spark, z, centres):
    return routing.nearest_owner(z, partition.centroid_table(spark, centres)).select("id", "region")


@query("c3_kmeans", f"WITH {ZSCORED}, {plusplus_sql('z', 3, 100_000)}, {rounds_sql('z', 25)} SELECT id, region FROM fitted")
def _(spark, d):
    return partition.fit_kmeans(latents(spark, d), 3, 1).labels


@query("c3_kmeans_rounds", f"WITH {ZSCORED}, {plusplus_sql('z', 3, 1)}, {rounds_sql('z', 3)} SELECT id, region FROM fitted")
def _(spark, d):
    z = materialize(z_table(spark, d))
    return _labels(spark, z, partition.spherical_kmeans(z, 3, 3, 1)[0])


def calm_sql(rows: str, n: int, tol: float) -> str:
    """As :func:`rounds_sql`, but ``fitted`` is what the first two calm rounds in a row leave, and ``stop`` their number."""
    best = "SELECT {i} AS i, avg(m) AS o FROM (SELECT max(list_inner_product(y.z, vec)) AS m FROM " + rows + " y, c{i} GROUP BY y.id)"
    steps = rounds_sql(rows, n).rsplit(", fitted AS", 1)[0]
    told = " UNION ALL ".join(best.format(i=i) for i in range(n))
    kept = " UNION ALL ".join(f"SELECT {i + 1} AS n, * FROM c{i + 1}" for i in range(n))
    return f"""{steps}, o AS ({told}), calm AS (SELECT i, abs(o - lag(o) OVER (ORDER BY i)) <= {tol} * greatest(abs(lag(o) OVER (ORDER BY i)), 1e-12) AS calm FROM o),
stop AS (SELECT coalesce(min(i) + 1, {n}) AS n FROM (SELECT i, calm AND lag(calm) OVER (ORDER BY i) AS twice FROM calm) WHERE twice), cs AS ({kept}),
fitted AS (SELECT y.id, arg_max(idx, {{'s': round(list_inner_product(y.z, vec), 12), 'i': -idx}}) AS region FROM z y, cs JOIN stop ON stop.n = cs.n GROUP BY y.id)"""


@query("c4_kmeans_until_calm", f"WITH {ZSCORED}, {first_sql('z', 3, 7)}, {calm_sql('z', 25, 0.001)} SELECT id, region, stop.n AS rounds FROM fitted, stop")
def _(spark, d):
    """At most 25 rounds; two in a row that change the objective by at most a thousandth end the fit."""
    z = materialize(z_table(spark, d))
    centres, told = partition.spherical_kmeans(z, 3, 25, 7, init="random", rel_tol=0.001)
    return _labels(spark, z, centres).withColumn("rounds", F.lit(len(told)).cast("long"))


@query("c5_init", f"WITH {ZSCORED}, {plusplus_sql('z', 4, 2)}, r0 AS (SELECT row_number() OVER (ORDER BY md5('2:' || id), id) - 1 AS idx, z AS vec FROM z ORDER BY md5('2:' || id), id LIMIT 4) SELECT 'kmeanspp' AS init, idx, round(vec[1], 6) AS a, round(vec[2], 6) AS b FROM c0 UNION ALL SELECT 'random', idx, round(vec[1], 6), round(vec[2], 6) FROM r0")
def _(spark, d):
    z = materialize(z_table(spark, d))
    rows = [(name, i, float(c[0]), float(c[1])) for name, fit in (("kmeanspp", partition.init_kmeanspp), ("random", partition.init_random)) for i, c in enumerate(fit(z, 4, 2))]
    return spark.createDataFrame(rows, "init string, idx long, a double, b double").withColumns({"a": r6("a"), "b": r6("b")})


@query("c7_capped_fit", f"WITH {ZSCORED}, zs AS (SELECT id, z FROM z ORDER BY md5('1:' || id), id LIMIT 768), {plusplus_sql('zs', 3, 100_000)}, {rounds_sql('zs', 25)} SELECT id, region FROM fitted")
def _(spark, d):
    return partition.fit_kmeans(latents(spark, d), 3, 1, cap=256).labels


@query("c9_prototype_means", f"WITH {ZSCORED}, x AS (SELECT label % 4 AS owner, d, sum(x) AS x FROM (SELECT lat.label, unnest(range(1, len(z) + 1)) AS d, unnest(z) AS x FROM z JOIN lat ON lat.id = z.id) GROUP BY 1, 2), n AS (SELECT owner, sqrt(sum(x * x)) AS n FROM x GROUP BY 1) SELECT x.owner, x.d::INT AS d, round(x / n, 6) AS x FROM x JOIN n ON x.owner = n.owner")
def _(spark, d):
    """A region's only prototype is its normalised mean."""
    z = materialize(z_table(spark, d))
    p = partition.fit_prototypes(z, z.select("id", (F.col("label") % 4).alias("region")), 1)
    return p.select("owner", F.posexplode("vec").alias("d", "x")).select("owner", (F.col("d") + 1).alias("d"), r6("x").alias("x"))


def region_rounds_sql(k: int, n: int, seed: int) -> str:
    """n rounds of k prototypes inside each region of ``y`` (id, z, owner), first the rows that come first by md5."""
    out = [f"c0 AS (SELECT owner, nth, z AS vec FROM (SELECT owner, z, row_number() OVER (PARTITION BY owner ORDER BY md5('{seed}:' || id), id) - 1 AS nth FROM y) WHERE nth < {k})"]
    for i in range(n):
        out.append(f"a{i} AS (SELECT y.id, y.owner, any_value(y.z) AS z, arg_max(nth, {{'s': round(list_inner_product(y.z, vec), 12), 'i': -nth}}) AS nth FROM y JOIN c{i} c ON c.owner = y.owner GROUP BY 1, 2)")
        out.append(f"m{i} AS (SELECT owner, nth, d, sum(x) AS x FROM (SELECT owner, nth, unnest(range(1, len(z) + 1)) AS d, unnest(z) AS x FROM a{i}) GROUP BY 1, 2, 3)")
        out.append(f"v{i} AS (SELECT m.owner, m.nth, list(x / n ORDER BY d) AS vec FROM m{i} m JOIN (SELECT owner, nth, sqrt(sum(x * x)) AS n FROM m{i} GROUP BY 1, 2) q ON q.owner = m.owner AND q.nth = m.nth GROUP BY 1, 2)")
        out.append(f"c{i + 1} AS (SELECT c.owner, c.nth, coalesce(v.vec, c.vec) AS vec FROM c{i} c LEFT JOIN v{i} v ON v.owner = c.owner AND v.nth = c.nth)")
    return ", ".join(out)


@query("c9_prototypes", f"WITH {ZSCORED}, y AS (SELECT z.id, z.z, lat.label % 4 AS owner FROM z JOIN lat ON lat.id = z.id), {region_rounds_sql(16, 20, 700)} SELECT owner * 16 + nth AS idx, owner, round(vec[1], 5) AS first, round(vec[64], 5) AS last FROM c20")
def _(spark, d):
    """Sixteen prototypes in each of four regions, one start of twenty rounds."""
    z = materialize(z_table(spark, d))
    p = partition.fit_prototypes(z, z.select("id", (F.col("label") % 4).alias("region")), 16, seed=7, n_init=1)
    return p.select("idx", "owner", F.round(F.get("vec", F.lit(0)), 5).alias("first"), F.round(F.get("vec", F.lit(63)), 5).alias("last"))


@query("c12_graph_fallback", f"{_W} SELECT i, j, round(w, 6) AS w FROM g")
def _(spark, d):
    """One neighbour gives more components than three regions, ten don't."""
    near = materialize(graph.knn(latents(spark, d), 10))
    return partition.graph_with_fallback(near, 1, 10, 3).withColumn("w", r6("w"))


@query("c19_fit_partition", f"WITH {ZSCORED}, {plusplus_sql('z', 3, 200_000)}, {rounds_sql('z', 25)}, {PROTOTYPES.replace("'7:'", "'2:'")} SELECT 'kmeanspp' AS method, region, count(*) AS n FROM fitted GROUP BY 2 UNION ALL SELECT 'random_voronoi', region, count(*) FROM routed GROUP BY 2 UNION ALL SELECT 'global', 0, count(*) FROM z")
def _(spark, d):
    lat, out = latents(spark, d), None
    for method in ("kmeanspp", "random_voronoi", "global"):
        one = regions.class_counts(partition.fit_partition(lat, method, 3, 2).labels, "region").select(F.lit(method).alias("method"), "region", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("m2_global_model", f"WITH {_FIT} SELECT 0::BIGINT AS region, round(regr_slope(z1, z0), 6) AS slope, round(regr_intercept(z1, z0), 6) AS intercept, count(*) AS n FROM v WHERE z1 IS NOT NULL")
def _(spark, d):
    rows = models.training_rows(materialize(_values(spark, d)).where(~F.col("last")))
    coef = lambda i: r6(F.get("coef", F.lit(i)))
    return models.fit_models(rows, None, penalty=0.0).select("region", coef(0).alias("slope"), coef(2).alias("intercept"), "n")


@query("m3_predictor_loss", f"WITH {_FIT} SELECT round(avg((s * z0 + c - z1) ** 2), 4) AS loss FROM v, fit WHERE model = 1 AND z1 IS NOT NULL")
def _(spark, d):
    rows, fitted = _fitted(materialize(_values(spark, d)))
    return models.predictor_loss(rows, models.load_models(fitted, 0, 2)[1]).select(F.round("loss", 4).alias("loss"))


@query("m7_single_rollout", f"WITH {_FIT} SELECT step, count(*) AS n, round(avg(loss), 4) AS loss, round(avg(pred), 4) AS pred FROM roll WHERE model = 1 GROUP BY step")
def _(spark, d):
    values = materialize(_values(spark, d))
    one = models.switch_rollout(_inputs(values).withColumn("_m", F.lit(1)), models.load_models(_fitted(values)[1], 0, 2), "_m")
    return one.groupBy("step").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 4).alias("loss"), F.round(F.avg(F.get("pred", F.lit(0))), 4).alias("pred"))


@query("m11_rule_drift", f"WITH {_FIT}, o AS (SELECT regr_slope(z1, z0) AS r FROM v WHERE z1 IS NOT NULL) SELECT 'all' AS split, (SELECT count(*) FROM v WHERE z1 IS NOT NULL) AS n, 0.0::DOUBLE AS drift UNION ALL SELECT CASE model WHEN 0 THEN 'even' ELSE 'odd' END, n, round(abs(s - r) / abs(r), 6) FROM fit, o")
def _(spark, d):
    pairs = materialize(_values(spark, d)).where(~F.col("last"))
    rows = models.training_rows(pairs).join(pairs.select("start", F.lit(True).alias("all"), (F.col("region") == 0).alias("even"), (F.col("region") == 1).alias("odd")), "start")
    return models.rule_drift(materialize(rows), ["even", "odd"], "all", penalty=0.0).withColumn("drift", r6("drift"))


_HELD = "h AS (SELECT start FROM v WHERE z1 IS NOT NULL QUALIFY row_number() OVER (ORDER BY md5('3:' || start), start) <= greatest(1, floor(count(*) OVER () * 0.2)))"


@query("m13_one_step_by_run", f"WITH {_FIT}, {_HELD}, x AS (SELECT model, (s * z0 + c - z1) ** 2 AS loss FROM v JOIN h ON h.start = v.start, fit) SELECT 'own' AS run, model, round(avg(loss), 4) AS mean, round(stddev_pop(loss), 4) AS sd, count(*) AS n FROM x GROUP BY model UNION ALL SELECT 'swapped', 1 - model, round(avg(loss), 4), round(stddev_pop(loss), 4), count(*) FROM x GROUP BY model")
def _(spark, d):
    rows, fitted = _fitted(materialize(_values(spark, d)))
    own = models.load_models(fitted, 0, 2)
    out = models.one_step_by_run(rows, {"own": own, "swapped": {0: own[1], 1: own[0]}}, 0.2, 3)
    return out.select("run", "model", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


@query("m16_load_models", f"WITH {_FIT} SELECT model AS region, round(s + 1, 6) AS slope FROM fit")
def _(spark, d):
    """The models of one seed out of a table of several."""
    fitted = _fitted(materialize(_values(spark, d)))[1]
    second = fitted.withColumns({"seed": F.lit(1).cast("long"), "coef": F.transform("coef", lambda x: x + 1)})
    found = models.load_models(fitted.unionByName(second), 1, 2)
    return spark.createDataFrame([(int(r), float(c.ravel()[0])) for r, c in found.items()], "region long, slope double").withColumn("slope", r6("slope"))


