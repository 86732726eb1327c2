"""Registered queries of normalisation, rule regions, graphs, partitions and routing."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions.common import materialize, shared_dir
from waymark.operators import audit, graph, partition, regions, routing, spectrum, vectors, windows
from waymark.plans.data import FRAMES, LATENTS, LONG, POSITIONS, PROTOTYPES, ZSCORED, frames, latents, positions, table
from waymark.plans.registry import query


def r6(c):
    return F.round(c, 6)


def at(v, i):
    return F.get(v, F.lit(i))


def z_table(spark, d):
    lat = latents(spark, d)
    return vectors.zscore_l2(lat, vectors.zscore_l2_fit(lat)).drop("latent")


def routed(spark, d, sql=False):
    z = z_table(spark, d)
    protos = partition.pick_prototypes(z, 3, 7)
    return (routing.nearest_owner_sql if sql else routing.nearest_owner)(z, protos), protos


@query("slice0_regions", f"WITH {ZSCORED}, {PROTOTYPES} SELECT region, count(*) AS n, round(avg(label), 6) AS mean_label, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM routed JOIN lat ON routed.id = lat.id GROUP BY region")
def _(spark, d):
    r, _protos = routed(spark, d, sql=True)
    per = r.groupBy("region").agg(F.count("*").alias("n"), r6(F.avg("label")).alias("mean_label"))
    return per.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("n1_l2_normalize", f"WITH {LATENTS}, n AS (SELECT id, latent, greatest(sqrt(list_inner_product(latent, latent)), 1e-12) AS n FROM lat) SELECT id, round(latent[1] / n, 6) AS first, round(latent[64] / n, 6) AS last FROM n")
def _(spark, d):
    v = latents(spark, d).select("id", vectors.l2_normalize(F.col("latent")).alias("v"))
    return v.select("id", r6(at("v", 0)).alias("first"), r6(at("v", 63)).alias("last"))


@query("n2_zscore_l2", f"WITH {ZSCORED} SELECT id, round(z[1], 6) AS first, round(z[33], 6) AS mid FROM z")
def _(spark, d):
    return z_table(spark, d).select("id", r6(at("z", 0)).alias("first"), r6(at("z", 32)).alias("mid"))


@query("n5_standardize_from", f"WITH {LONG}, st AS (SELECT e.d, avg(x) AS m, stddev_pop(x) + 1e-8 AS s FROM e JOIN lat ON e.id = lat.id WHERE label < 3 GROUP BY e.d) SELECT id, round((x - m) / s, 6) AS second FROM e JOIN st ON e.d = st.d WHERE e.d = 2")
def _(spark, d):
    return vectors.standardize_from(latents(spark, d), F.col("label") < 3).select("id", r6(at("z", 1)).alias("second"))


@query("n7_linear_fit", f"WITH {LATENTS} SELECT round(regr_slope(latent[2], latent[1]), 6) AS slope, round(regr_intercept(latent[2], latent[1]), 6) AS intercept, round(regr_r2(latent[2], latent[1]), 6) AS r2 FROM lat")
def _(spark, d):
    df = latents(spark, d).select("id", F.slice("latent", 1, 1).alias("x"), F.slice("latent", 2, 1).alias("y"))
    beta, score = vectors.linear_fit(df, "x", "y")
    return spark.createDataFrame([(float(beta[0, 0]), float(beta[1, 0]), score)], "slope double, intercept double, r2 double").select(r6("slope").alias("slope"), r6("intercept").alias("intercept"), r6("r2").alias("r2"))


@query("n9_scalers", "SELECT unnest(['value', 'hour']) AS name, unnest([round(avg(value), 6), round(avg(hour(ts)), 6)]) AS mean, unnest([round(stddev_pop(value), 6), round(stddev_pop(hour(ts)), 6)]) AS scale FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("value", F.hour("ts").cast("double").alias("hour"))
    return vectors.fit_scalers(e, ["value", "hour"]).select("name", r6("mean").alias("mean"), r6("scale").alias("scale"))


@query("n4_pca_coordinates")
def _(spark, d):
    lat = latents(spark, d)
    return vectors.pca_transform(lat, vectors.pca_fit(lat, 8)).select("id", "z")


#: Principal axes of two columns (a, b, c: their variances and covariance) in closed form; signs are free.
_PLANE = """ax AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + cab ** 2) AS top FROM cv),
un AS (SELECT *, cab / sqrt(cab ** 2 + (top - va) ** 2) AS u1, (top - va) / sqrt(cab ** 2 + (top - va) ** 2) AS u2 FROM ax)"""


@query(
    "n4_pca_plane",
    f"""WITH {LATENTS}, cv AS (SELECT avg(latent[1]) AS ma, avg(latent[2]) AS mb, var_pop(latent[1]) AS va, var_pop(latent[2]) AS vb, covar_pop(latent[1], latent[2]) AS cab FROM lat), {_PLANE}
SELECT id, round(abs((latent[1] - ma) * u1 + (latent[2] - mb) * u2), 6) AS first, round(abs((latent[2] - mb) * u1 - (latent[1] - ma) * u2), 6) AS second FROM lat, un""",
)
def _(spark, d):
    """Both coordinates of two columns on their principal axes."""
    lat = latents(spark, d).withColumn("latent", F.slice("latent", 1, 2))
    z = vectors.pca_transform(lat, vectors.pca_fit(lat, 2))
    return z.select("id", r6(F.abs(F.get("z", F.lit(0)))).alias("first"), r6(F.abs(F.get("z", F.lit(1)))).alias("second"))


@query("n4_pca_keeps_lengths", f"WITH {LONG}, m AS (SELECT d, avg(x) AS m FROM e GROUP BY d) SELECT id, round(sum((x - m) ** 2), 6) AS length2 FROM e JOIN m ON e.d = m.d GROUP BY id")
def _(spark, d):
    """On all its components a centred vector keeps its length."""
    lat = latents(spark, d)
    z = vectors.pca_transform(lat, vectors.pca_fit(lat, 1 << 20))
    return z.select("id", r6(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)).alias("length2"))


@query(
    "n10_projection_plane",
    f"""WITH {LATENTS}, st AS (SELECT avg(latent[1]) AS m1, avg(latent[2]) AS m2, stddev_pop(latent[1]) + 1e-8 AS s1, stddev_pop(latent[2]) + 1e-8 AS s2 FROM lat WHERE label < 5),
z AS (SELECT id, label, (latent[1] - m1) / s1 AS a, (latent[2] - m2) / s2 AS b FROM lat, st), cv AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab FROM z WHERE label < 5), {_PLANE}
SELECT id, round(abs((a - ma) * u1 + (b - mb) * u2), 5) AS first, round(abs((b - mb) * u1 - (a - ma) * u2), 5) AS second FROM z, un""",
)
def _(spark, d):
    """All rows on the principal axes of the standardised reference rows."""
    lat = latents(spark, d).withColumn("latent", F.slice("latent", 1, 2))
    z = vectors.prepare_projection(lat, F.col("label") < 5)
    return z.select("id", F.round(F.abs(F.get("z", F.lit(0))), 5).alias("first"), F.round(F.abs(F.get("z", F.lit(1))), 5).alias("second"))


@query(
    "n6_procrustes",
    f"""WITH {LATENTS}, m AS (SELECT count(*) AS n, sum(latent[1] * latent[3]) AS a, sum(latent[1] * latent[4]) AS b, sum(latent[2] * latent[3]) AS c, sum(latent[2] * latent[4]) AS d, sum(latent[1] ** 2 + latent[2] ** 2 + latent[3] ** 2 + latent[4] ** 2) AS t FROM lat),
s AS (SELECT *, a * d - b * c AS det, sqrt(a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c)) AS s FROM m)
SELECT round((a + sign(det) * d) / s, 6) AS q11, round((b - sign(det) * c) / s, 6) AS q12, round((t - 2 * s) / n, 6) AS error FROM s""",
)
def _(spark, d):
    """Columns 1 and 2 turned onto columns 3 and 4; for two columns the turn has a closed form."""
    rows = latents(spark, d).select(F.slice("latent", 1, 2).alias("s"), F.slice("latent", 3, 2).alias("t"))
    q, error = vectors.procrustes(rows, "s", "t")
    return spark.createDataFrame([(float(q[0, 0]), float(q[0, 1]), error)], "q11 double, q12 double, error double").select(*[r6(c).alias(c) for c in ("q11", "q12", "error")])


@query("n3_whitened")
def _(spark, d):
    return vectors.preprocess(latents(spark, d), "white128").select("id", "z")


@query("n8_control_latents")
def _(spark, d):
    return vectors.control_latents(frames(spark, d), F.col("step") % 2 == 0, 3).select("frame_id", "latent")


@query("n10_projection")
def _(spark, d):
    return vectors.prepare_projection(latents(spark, d), F.col("label") < 5).select("id", "z")


@query("n11_rff")
def _(spark, d):
    return vectors.rff(latents(spark, d), 32, 0.1, 1).select("id", "z")


@query("r1_quantile_regions", f"WITH {POSITIONS}, t AS (SELECT quantile_cont(x, [0.1, 0.2, 0.4, 0.45, 0.5, 0.55, 0.6, 0.8, 0.9]) AS qx, quantile_cont(y, [0.1, 0.25, 0.75, 0.9]) AS qy FROM pos WHERE ref) SELECT count(*) FILTER (WHERE x BETWEEN qx[2] AND qx[8] AND y BETWEEN qy[2] AND qy[3]) AS common, count(*) FILTER (WHERE x < qx[4]) AS left_room, count(*) FILTER (WHERE x > qx[6]) AS right_room, count(*) FILTER (WHERE x BETWEEN qx[4] AND qx[6]) AS doorway, count(*) FILTER (WHERE x <= qx[1] OR x >= qx[9] OR y <= qy[1] OR y >= qy[4]) AS near_wall, count(*) FILTER (WHERE x < qx[3] OR x > qx[7]) AS goal_other_side FROM pos, t")
def _(spark, d):
    p = positions(spark, d)
    m = regions.quantile_regions(p, p.where("ref"))
    return m.agg(*[F.count_if(c).alias(c) for c in ("common", "left_room", "right_room", "doorway", "near_wall", "goal_other_side")])


@query("r2_geometry_regions", f"WITH {POSITIONS} SELECT l_suppkey, count(*) FILTER (WHERE x < 107) AS left_room, count(*) FILTER (WHERE x > 117) AS right_room, count(*) FILTER (WHERE x BETWEEN 107 AND 117) AS doorway, count(*) FILTER (WHERE x <= 24 OR x >= 200 OR y <= 24 OR y >= 200) AS near_wall, count(*) FILTER (WHERE x BETWEEN 56 AND 168 AND y BETWEEN 56 AND 168) AS common FROM pos GROUP BY l_suppkey")
def _(spark, d):
    m = regions.geometry_regions(positions(spark, d))
    return m.groupBy("l_suppkey").agg(*[F.count_if(c).alias(c) for c in ("left_room", "right_room", "doorway", "near_wall", "common")])


@query("r3_object_regions", f"WITH {POSITIONS}, t AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS tx, quantile_cont(y, [0.25, 0.5, 0.75]) AS ty, quantile_cont(l_discount, [0.2, 0.8]) AS td, quantile_cont(l_tax, [0.2, 0.8]) AS ta FROM pos WHERE ref) SELECT count(*) FILTER (WHERE x < tx[2]) AS obj_left, count(*) FILTER (WHERE y >= ty[2]) AS obj_high, count(*) FILTER (WHERE l_discount <= td[1]) AS contact, count(*) FILTER (WHERE l_discount >= td[2]) AS far, count(*) FILTER (WHERE l_tax <= ta[1]) AS angle_low, count(*) FILTER (WHERE x BETWEEN tx[1] AND tx[3] AND y BETWEEN ty[1] AND ty[3]) AS central FROM pos, t")
def _(spark, d):
    p = positions(spark, d).withColumnsRenamed({"x": "ox", "y": "oy", "l_discount": "dist", "l_tax": "angle"})
    m = regions.object_regions(p, p.where("ref"))
    return m.agg(*[F.count_if(c).alias(c) for c in ("obj_left", "obj_high", "contact", "far", "angle_low", "central")])


@query("r4_common_region", f"WITH {POSITIONS} SELECT true AS common, count(*) AS n FROM pos")
def _(spark, d):
    return regions.common_region(positions(spark, d)).groupBy("common").agg(F.count("*").alias("n"))


_ROOMS = "CASE WHEN x < 107 THEN 0 WHEN x <= 117 THEN 1 ELSE 2 END"


@query("r5_rooms3", f"WITH {POSITIONS} SELECT {_ROOMS} AS room, count(*) AS n FROM pos GROUP BY 1")
def _(spark, d):
    return regions.class_counts(positions(spark, d).withColumn("room", regions.rooms3(F.col("x"))), "room")


@query("r6_priority5", f"WITH {POSITIONS} SELECT CASE WHEN x BETWEEN 107 AND 117 THEN 'doorway' WHEN x <= 24 OR x >= 200 OR y <= 24 OR y >= 200 THEN 'near_wall' WHEN x BETWEEN 56 AND 168 AND y BETWEEN 56 AND 168 THEN 'common' WHEN x > 117 THEN 'right_room' ELSE 'left_room' END AS region, count(*) AS n FROM pos GROUP BY 1")
def _(spark, d):
    return regions.class_counts(positions(spark, d).withColumn("region", regions.priority5(F.col("x"), F.col("y"))), "region")


@query("r7_masks_at_starts", f"WITH {FRAMES}, s AS (SELECT frame_id AS start, s0 AS x, s1 AS y, ep FROM frames), t AS (SELECT quantile_cont(x, [0.1, 0.45, 0.9]) AS qx, quantile_cont(y, [0.1, 0.9]) AS qy FROM s WHERE ep % 2 = 0) SELECT start, x < qx[2] AS left_room, x <= qx[1] OR x >= qx[3] OR y <= qy[1] OR y >= qy[2] AS near_wall FROM s, t")
def _(spark, d):
    f = frames(spark, d)
    s = f.select(F.col("frame_id").alias("start"), "ep")
    return regions.region_masks_at(s, f, s.where("ep % 2 = 0")).select("start", "left_room", "near_wall")


@query("r8_band_masks", f"WITH {POSITIONS}, t AS (SELECT quantile_cont(y, [0.2, 0.8]) AS q FROM pos WHERE ref) SELECT l_suppkey, count(*) FILTER (WHERE y BETWEEN q[1] AND q[2]) AS n_middle, count(*) FILTER (WHERE y <= q[1] OR y >= q[2]) AS n_extreme FROM pos, t GROUP BY l_suppkey")
def _(spark, d):
    p = positions(spark, d)
    m = regions.extreme_mask(regions.middle_mask(p, p.where("ref"), "y", 0.2, 0.8), p.where("ref"), "y", 0.2, 0.8)
    return m.groupBy("l_suppkey").agg(F.count_if("middle").alias("n_middle"), F.count_if("extreme").alias("n_extreme"))


@query("r9_step_keys", f"WITH {FRAMES}, w AS (SELECT start, k FROM (SELECT f.frame_id AS start, unnest(range(0, 4)) AS k FROM frames f JOIN frames g ON g.frame_id = f.frame_id + 3)) SELECT w.start, k::INT AS step, CASE WHEN s0 < 107 THEN 0 WHEN s0 <= 117 THEN 1 ELSE 2 END AS region FROM w JOIN frames ON frame_id = w.start + k")
def _(spark, d):
    f = frames(spark, d)
    s = f.select(F.col("frame_id").alias("start")).join(f.select((F.col("frame_id") - 3).alias("start")), "start")
    return regions.rooms3_keys(windows.gather_sequences(windows.expand_windows(s, 4, 1), f, "state"), 4)


_KNN = f"""WITH {LATENTS}, n AS (SELECT id, latent, greatest(sqrt(list_inner_product(latent, latent)), 1e-12) AS n FROM lat),
u AS (SELECT id, list_transform(latent, lambda x: x / n) AS v FROM n), p AS (SELECT a.id, b.id AS nbr, round(list_inner_product(a.v, b.v), 12) AS sim FROM u a, u b WHERE a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM p QUALIFY rank <= 10)"""
_W = f"""{_KNN}, e AS (SELECT id AS i, nbr AS j, greatest(0, 2 - 2 * sim) AS d2 FROM k), s0 AS (SELECT i, sqrt(max(d2)) AS s FROM e GROUP BY i),
fl AS (SELECT greatest(0.1 * quantile_cont(s, 0.01), 1e-4) AS f FROM s0 WHERE s > 0), sg AS (SELECT i, greatest(s, f) AS s FROM s0, fl),
h AS (SELECT e.i, e.j, exp(-least(d2 / (a.s * b.s), 50)) AS w FROM e JOIN sg a ON a.i = e.i JOIN sg b ON b.i = e.j),
g AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM h UNION ALL SELECT j, i, w FROM h) GROUP BY i, j)"""


def _graph(spark, d):
    return materialize(graph.affinity_graph(graph.knn(latents(spark, d), 10), 10))


@query("g1_knn", f"{_KNN} SELECT id, nbr, rank::INT AS rank, round(sim, 6) AS sim FROM k")
def _(spark, d):
    return graph.knn(latents(spark, d), 10).select("id", "nbr", "rank", r6("sim").alias("sim"))


@query("g2_knn_approx")
def _(spark, d):
    return graph.knn_approx(latents(spark, d), 10)


@query("g3_affinity_graph", f"{_W} SELECT i, j, round(w, 6) AS w FROM g")
def _(spark, d):
    return _graph(spark, d).withColumn("w", r6("w"))


@query("g4_components", f"WITH RECURSIVE {_W.removeprefix('WITH ')}, m AS (SELECT i, j FROM g WHERE w > 0.45), r AS (SELECT DISTINCT i AS v, i AS c FROM m UNION SELECT m.j, r.c FROM r JOIN m ON m.i = r.v) SELECT c, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT c, count(*) AS n FROM (SELECT v, min(c) AS c FROM r GROUP BY v) GROUP BY c)")
def _(spark, d):
    e = _graph(spark, d).where("w > 0.45")
    return graph.component_summary(graph.components(e)).select("c", "n", r6("share").alias("share"))


@query("g5_degree_stats", f"{_W}, dg AS (SELECT i, sum(w) AS d FROM g GROUP BY i) SELECT round(min(d), 6) AS d_min, round(avg(d), 6) AS d_mean, round(max(d), 6) AS d_max, count(*) FILTER (WHERE d <= 0) AS n_zero FROM dg")
def _(spark, d):
    s = graph.degree_stats(_graph(spark, d))
    return s.select(*[r6(c).alias(c) for c in ("d_min", "d_mean", "d_max")], "n_zero")


@query("g9_ncut", f"{_W} SELECT round(sum((vol - ins) / greatest(vol, 1e-12)), 6) AS ncut FROM (SELECT a.label % 4 AS r, sum(w) AS vol, sum(CASE WHEN a.label % 4 = b.label % 4 THEN w ELSE 0 END) AS ins FROM g JOIN lat a ON a.id = g.i JOIN lat b ON b.id = g.j GROUP BY 1)")
def _(spark, d):
    return graph.ncut(_graph(spark, d), latents(spark, d).select("id", (F.col("label") % 4).alias("region"))).select(r6("ncut").alias("ncut"))


@query("g6_laplacian_spectrum")
def _(spark, d):
    values = graph.laplacian_spectrum(_graph(spark, d), 14)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx int, eigenvalue double")


@query(
    "g6_known_spectra",
    f"""WITH {LATENTS}, n AS (SELECT grp, count(*) AS n FROM lat GROUP BY grp HAVING count(*) > 1), k AS (SELECT grp, n, unnest(range(0, 14)) AS idx FROM n)
SELECT grp * 2 AS g, idx::INT AS idx, abs(round(1 - cos(pi() * idx / (n - 1)), 6)) AS eigenvalue FROM k WHERE idx < n UNION ALL SELECT grp * 2 + 1, idx::INT, round(CASE WHEN idx = 0 THEN 0 ELSE n / (n - 1) END, 6) FROM k WHERE idx < n""",
)
def _(spark, d):
    """Each group of vectors as a path and as a clique, whose spectra are known; all in one run."""
    lat = latents(spark, d).select("grp", "id")
    at = lat.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("id")))
    pairs = at.join(at.select("grp", F.col("id").alias("other"), F.col("n").alias("m")), "grp").where("id <> other")
    own = lambda rows, shift: rows.select((F.col("grp") * 2 + shift).alias("g"), F.col("id").alias("i"), F.col("other").alias("j"), F.lit(1.0).alias("w"))
    edges = own(pairs.where("abs(n - m) = 1"), 0).unionByName(own(pairs, 1))
    return spectrum.spectra(materialize(edges), 14).withColumn("eigenvalue", r6("eigenvalue"))


@query("g7_labels_of_components", f"WITH {LATENTS} SELECT id, min(id) OVER (PARTITION BY label % 3) AS region FROM lat")
def _(spark, d):
    """Three graphs without an edge between them; a region is named by its least id."""
    lat = latents(spark, d).select("id", (F.col("label") % 3).alias("c"))
    at = lat.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("id"))).withColumn("size", F.count("*").over(Window.partitionBy("c")))
    steps = at.withColumn("m", F.explode(F.transform(F.array(*map(F.lit, (1, 2, 5, 11, 23, 47, 101))), lambda s: (F.col("n") + s - 1) % F.col("size") + 1)))
    pairs = steps.join(at.select("c", F.col("n").alias("m"), F.col("id").alias("j")), ["c", "m"]).where("id <> j").select(F.col("id").alias("i"), "j")
    edges = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct().withColumn("w", F.lit(1.0))
    return graph.spectral_labels(materialize(edges), 3).withColumn("region", F.min("id").over(Window.partitionBy("region")))


@query("g7_spectral_labels")
def _(spark, d):
    return graph.spectral_labels(_graph(spark, d), 3)


_SPEC = """sp AS (SELECT draw, knn, idx, sum(v) OVER (PARTITION BY draw, knn ORDER BY idx) AS eigenvalue FROM (SELECT l_linenumber % 3 AS draw, 27 + 3 * (l_suppkey % 3) AS knn, l_partkey % 14 AS idx, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3)),
gp AS (SELECT draw, knn, idx, (nxt - eigenvalue) / (nxt + 1e-8) AS gap FROM (SELECT *, lead(eigenvalue) OVER (PARTITION BY draw, knn ORDER BY idx) AS nxt FROM sp) WHERE nxt IS NOT NULL)"""


def _spectra(spark, d):
    l = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("draw"), (27 + 3 * (F.col("l_suppkey") % 3)).alias("knn"), (F.col("l_partkey") % 14).alias("idx")).agg(F.avg("l_discount").alias("v"))  # noqa: E741
    return l.select("draw", "knn", "idx", F.sum("v").over(Window.partitionBy("draw", "knn").orderBy("idx")).alias("eigenvalue"))


@query("g8_select_k", f"WITH {_SPEC} SELECT idx AS k, round(gap, 6) AS gap FROM (SELECT idx, eigenvalue - lag(eigenvalue) OVER (ORDER BY idx) AS gap FROM sp WHERE draw = 0 AND knn = 30) WHERE idx BETWEEN 2 AND 8 ORDER BY gap DESC, idx LIMIT 1")
def _(spark, d):
    return graph.select_k(_spectra(spark, d).where("draw = 0 AND knn = 30"), 2, 8).select("k", r6("gap").alias("gap"))


@query("g10_relative_gaps", f"WITH {_SPEC} SELECT draw, knn, idx, round(gap, 6) AS gap FROM gp")
def _(spark, d):
    return graph.relative_gaps(_spectra(spark, d)).withColumn("gap", r6("gap"))


@query("g10_scaled_mad", f"WITH {_SPEC}, m AS (SELECT median(gap) AS med FROM gp) SELECT round(any_value(med), 6) AS med, round(1.4826 * median(abs(gap - med)), 6) AS mad FROM gp, m")
def _(spark, d):
    return graph.scaled_mad(graph.relative_gaps(_spectra(spark, d)), "gap").select(r6("med").alias("med"), r6("mad").alias("mad"))


@query(
    "g11_gate_decision",
    f"""WITH {_SPEC}, own AS (SELECT * FROM gp WHERE idx = 2), nom AS (SELECT draw, gap AS base FROM own WHERE knn = 30), ee AS (SELECT min(base) AS e FROM nom), tt AS (SELECT 2 * max(abs(gap - base)) AS t FROM own JOIN nom ON own.draw = nom.draw),
bg AS (SELECT g.draw, g.knn, med + 3 * 1.4826 * median(abs(gap - med)) AS b FROM (SELECT * FROM gp WHERE idx BETWEEN 3 AND 12) g JOIN (SELECT draw, knn, median(gap) AS med FROM gp WHERE idx BETWEEN 3 AND 12 GROUP BY 1, 2) m ON g.draw = m.draw AND g.knn = m.knn GROUP BY g.draw, g.knn, med),
o AS (SELECT e, t, CASE WHEN e > 1e-8 THEN e - t END AS r, CASE WHEN e > 1e-8 THEN 1 - t / e END AS s, t_bg FROM ee, tt, (SELECT max(b) AS t_bg FROM bg)),
w AS (SELECT *, CASE WHEN NOT e > 1e-8 THEN 'candidate_gap_not_above_epsilon' WHEN s >= 0.5 AND r > t_bg THEN 'spectrally_nondegenerate' WHEN s < 0.5 AND r <= t_bg THEN 'safety_and_background_checks_failed' WHEN s < 0.5 THEN 'retained_safety_below_threshold' ELSE 'residual_gap_not_above_background' END AS reason FROM o)
SELECT round(e, 6) AS e, round(t, 6) AS t, round(s, 6) AS s, round(r, 6) AS r, round(t_bg, 6) AS t_bg, reason, CASE WHEN reason = 'spectrally_nondegenerate' THEN 'spectral' ELSE 'global' END AS choice FROM w""",
)
def _(spark, d):
    return graph.gate_decision(_spectra(spark, d)).select(*[r6(c).alias(c) for c in ("e", "t", "s", "r", "t_bg")], "reason", "choice")


@query("c1_global", f"WITH {LATENTS} SELECT 0::BIGINT AS region, count(*) AS n FROM lat")
def _(spark, d):
    return regions.class_counts(partition.fit_global(latents(spark, d)).labels, "region")


@query("c2_random_voronoi", f"WITH {ZSCORED}, {PROTOTYPES} SELECT id, region FROM routed")
def _(spark, d):
    return partition.fit_random_voronoi(latents(spark, d), 3, 7).labels


@query("c8_best_restart", "WITH r AS (SELECT l_suppkey % 5 AS outer_seed, l_partkey % 20 AS restart, round(avg(l_discount), 3) AS objective FROM lineitem GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY outer_seed ORDER BY objective DESC, restart) AS n FROM r WHERE restart < 10) SELECT outer_seed, restart, objective FROM b WHERE n = 1")
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("outer_seed"), (F.col("l_partkey") % 20).alias("restart")).agg(F.round(F.avg("l_discount"), 3).alias("objective"))
    return partition.best_restart(r, 10)


@query("c6_objective", f"WITH {ZSCORED}, {PROTOTYPES} SELECT round(avg(b), 6) AS objective FROM (SELECT z.id, max(list_inner_product(z, vec)) AS b FROM z, protos GROUP BY z.id)")
def _(spark, d):
    z = z_table(spark, d)
    return partition.objective(z, partition.pick_prototypes(z, 3, 7)).select(r6("objective").alias("objective"))


@query("c10_spectral")
def _(spark, d):
    return partition.fit_spectral(latents(spark, d), 3).labels


@query("c14_replay", f"WITH {ZSCORED}, {PROTOTYPES} SELECT id, region FROM routed")
def _(spark, d):
    lat = latents(spark, d)
    return partition.replay_artifact(lat, partition.fit_random_voronoi(lat, 3, 7))


@query("c15_replay_assignments", f"WITH {LATENTS} SELECT label % 4 AS region, count(*) AS n FROM lat GROUP BY 1")
def _(spark, d):
    lat = latents(spark, d)
    return regions.class_counts(partition.replay_assignments(lat.select("id"), lat.select("id", (F.col("label") % 4).alias("region"))), "region")


@query("c16_remap_ids", "WITH i AS (SELECT vec_id * 3 + 5 AS gid, row_number() OVER (ORDER BY vec_id) - 1 AS n, label FROM embeddings) SELECT gid AS id, n % 4 AS region FROM i")
def _(spark, d):
    lat = latents(spark, d)
    return partition.remap_ids(lat.select("id", (F.col("id") % 4).alias("region")), lat.select((F.col("id") * 3 + 5).alias("id")))


@query("c17_centroids", f"WITH {ZSCORED}, {PROTOTYPES}, f AS (SELECT id, unnest(range(1, len(z) + 1)) AS d, unnest(z) AS x FROM z), m AS (SELECT region, d, avg(x) AS x FROM f JOIN routed ON routed.id = f.id GROUP BY 1, 2), n AS (SELECT region, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT m.region, m.d::INT AS d, round(x / n, 6) AS x FROM m JOIN n ON m.region = n.region")
def _(spark, d):
    r, _protos = routed(spark, d)
    c = partition.centroids(r.drop("region"), r.select("id", "region"))
    return c.select("region", F.posexplode("vec").alias("d", "x")).select("region", (F.col("d") + 1).alias("d"), r6("x").alias("x"))


@query("c18_partition_faults", "SELECT 3::BIGINT AS n_regions, 0::BIGINT AS out_of_range, 0::BIGINT AS repeated_ids, 0::BIGINT AS unowned, 0::BIGINT AS not_finite, 0::BIGINT AS bad_scale FROM (SELECT count(*) AS n FROM embeddings)")
def _(spark, d):
    return partition.partition_faults(partition.fit_random_voronoi(latents(spark, d), 3, 7), 3)


@query("v1_route", f"WITH {ZSCORED}, {PROTOTYPES} SELECT id, region FROM routed")
def _(spark, d):
    return routed(spark, d)[0].select("id", "region")


@query("v2_assign_l2", f"WITH {ZSCORED}, {PROTOTYPES}, a AS (SELECT z.id, arg_max(idx, {{'s': round(-list_distance(z, vec) * list_distance(z, vec), 12), 'i': -idx}}) AS region FROM z, protos GROUP BY z.id) SELECT id, region FROM a")
def _(spark, d):
    z = z_table(spark, d)
    return routing.assign(z, partition.pick_prototypes(z, 3, 7), spherical=False).select("id", "region")


@query("v3_route_mpc", f"WITH {ZSCORED}, {PROTOTYPES} SELECT lat.grp AS start, (lat.id % 25)::INT AS slot, r.region FROM lat JOIN lat f ON f.id = lat.grp * 25 JOIN routed r ON r.id = f.id")
def _(spark, d):
    z = z_table(spark, d)
    slots = z.select(F.col("grp").alias("start"), (F.col("id") % 25).cast("int").alias("slot"), "z")
    return routing.route_rollout(slots, partition.pick_prototypes(z, 3, 7), "mpc", "z")


@query("v4_route_stats", f"WITH {ZSCORED}, {PROTOTYPES}, s AS (SELECT grp AS ep, coalesce(region <> lag(region) OVER (PARTITION BY grp ORDER BY lat.id), false) AS sw FROM routed JOIN lat ON routed.id = lat.id) SELECT ep, count(*) AS n_steps, count(*) FILTER (WHERE sw) AS n_switches, CASE WHEN count(*) > 1 THEN round(count(*) FILTER (WHERE sw) / (count(*) - 1), 6) ELSE 0 END AS switch_rate FROM s GROUP BY ep")
def _(spark, d):
    r = routed(spark, d)[0].select(F.col("grp").alias("ep"), F.col("id").alias("step"), "region")
    return routing.route_stats(r).withColumn("switch_rate", r6("switch_rate"))


@query("v6_margin_stats", f"WITH {ZSCORED}, {PROTOTYPES}, m AS (SELECT id, s[1] - s[2] AS m FROM (SELECT z.id, list_reverse_sort(list(list_inner_product(z, vec))) AS s FROM z, protos GROUP BY z.id)) SELECT round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(quantile_cont(m, 0.1), 6) AS p10, round(quantile_cont(m, 0.25), 6) AS p25, round(avg(CASE WHEN m < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS share_below FROM m")
def _(spark, d):
    z = z_table(spark, d)
    s = routing.margin_stats(z, partition.pick_prototypes(z, 3, 7))
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query(
    "v7_router_fidelity",
    f"""WITH {ZSCORED}, {PROTOTYPES}, b AS (SELECT routed.id, region AS p, label % 3 AS y FROM routed JOIN lat ON routed.id = lat.id),
h AS (SELECT p, y FROM b QUALIFY row_number() OVER (ORDER BY md5('0:' || id), id) <= greatest(1, floor(count(*) OVER () * 0.2))),
c AS (SELECT c, count(*) FILTER (WHERE y = c AND p = c) AS tp, count(*) FILTER (WHERE y = c) + count(*) FILTER (WHERE p = c) AS n FROM h, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c)
SELECT (SELECT round(avg(CASE WHEN p = y THEN 1.0::DOUBLE ELSE 0.0 END), 6) FROM b) AS agreement, round(avg(2 * tp / n), 6) AS macro_f1 FROM c WHERE n > 0""",
)
def _(spark, d):
    r = routed(spark, d)[0]
    f = routing.router_fidelity(r, r.select("id", (F.col("label") % 3).alias("region")))
    return f.select(r6("agreement").alias("agreement"), r6("macro_f1").alias("macro_f1"))


@query(
    "v8_stream_histogram",
    """WITH r AS (SELECT ts::DATE AS day, [(hour(ts) - 11.5::DOUBLE) / 12, value / 100] AS v FROM events)
SELECT day, CASE WHEN round(list_inner_product(v, [1.0::DOUBLE, 0.2]), 12) >= round(list_inner_product(v, [-1.0::DOUBLE, 0.2]), 12) THEN 0 ELSE 1 END AS region, count(*) AS n FROM r GROUP BY 1, 2""",
)
def _(spark, d):
    """The events' hourly vectors as a stream, routed and counted by day."""
    from waymark.streaming import route as stream

    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.array((F.hour("ts") - 11.5) / 12, F.col("value") / 100).alias("latent"))
    src = materialize(e)
    protos = spark.createDataFrame([(0, [1.0, 0.2], 0), (1, [-1.0, 0.2], 1)], "idx long, vec array<double>, owner long")
    live = stream.windowed_histogram(stream.route_stream(spark.readStream.schema(src.schema).parquet(src.inputFiles()[0].rsplit("/", 1)[0]), protos), "ts")
    name = "v8_" + hashlib.md5(d.encode()).hexdigest()[:8]
    q = live.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("date").alias("day"), "region", "n")


@query(
    "v8_ordered_switches",
    """WITH r AS (SELECT user_id AS ep, ts, event_id, [(hour(ts) - 11.5::DOUBLE) / 12, value / 100] AS v FROM events),
g AS (SELECT ep, ts, event_id, CASE WHEN round(list_inner_product(v, [1.0::DOUBLE, 0.2]), 12) >= round(list_inner_product(v, [-1.0::DOUBLE, 0.2]), 12) THEN 0 ELSE 1 END AS region FROM r),
l AS (SELECT ep, region, lag(region) OVER (PARTITION BY ep ORDER BY ts, event_id) AS before FROM g)
SELECT ep, count(*) AS n_steps, count(*) FILTER (WHERE region <> before) AS n_switches FROM l GROUP BY ep""",
)
def _(spark, d):
    """Events that arrive in files of mixed times are counted in order once a closing row lets the watermark pass."""
    from waymark.streaming import route as stream

    at = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.col("user_id").cast("long").alias("ep"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.array((F.hour("ts") - 11.5) / 12, F.col("value") / 100).alias("latent"))
    e.repartition(4, F.xxhash64("event_id")).write.parquet(f"{at}/in")
    e.agg(F.max("ep").alias("ep"), F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts"), F.first("latent").alias("latent")).write.mode("append").parquet(f"{at}/in")
    protos = spark.createDataFrame([(0, [1.0, 0.2], 0), (1, [-1.0, 0.2], 1)], "idx long, vec array<double>, owner long")
    told = stream.ordered_switches(stream.route_stream(stream.read_latent_stream(spark, f"{at}/in", e.schema, 2), protos), order="event_id", late="4000 days")
    q = told.writeStream.outputMode("update").option("checkpointLocation", f"{at}/log").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(f"{at}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{at}/out").groupBy("ep").agg(F.max("n_steps").alias("n_steps"), F.max("n_switches").alias("n_switches"))


_INTS = ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
_FRACTIONS = ("l_discount", "l_extendedprice", "l_quantity", "l_tax")
_AS_TEXT = {c: f"floor({c} * 1e9::DOUBLE + 0.5)::BIGINT::VARCHAR" if c in _FRACTIONS else f"{c}::VARCHAR" for c in sorted((*_INTS, *_FRACTIONS, "l_linestatus", "l_returnflag", "l_shipdate"))}
_ROW = " || ".join(f"CASE WHEN {c} IS NULL THEN 'N' ELSE 'V' || length({x}) || ':' || {x} END" for c, x in _AS_TEXT.items())


@query(
    "d7_table_hash",
    f"""WITH m AS (SELECT md5({_ROW}) AS m FROM lineitem), h AS (SELECT ('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT AS high, ('0x' || substr(m, 17, 16))::UBIGINT::HUGEINT AS low FROM m)
SELECT count(*) AS n, (sum(high) % 18446744073709551616::HUGEINT)::VARCHAR AS high, (sum(low) % 18446744073709551616::HUGEINT)::VARCHAR AS low FROM h""",
)
def _(spark, d):
    return audit.table_hash(table(spark, d, "lineitem"))
