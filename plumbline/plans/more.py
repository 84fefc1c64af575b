"""Queries of matching, hypotheses, adaptive cells and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import raster
from plumbline.operators import relational as rel
from plumbline.operators.graph import _written
from plumbline.operators.quantiles import quantiles
from plumbline.operators.selection import MAX_REFERENCES, nearest_references
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, G, O, events, grid, take
from plumbline.plans.points import KEYS, P, keyed, points

D2 = "list_sum(list_transform(list_zip(a.e,b.e), lambda p: (p[1]-p[2])*(p[1]-p[2])))"
V = "SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings"
NEAR = f"SELECT a.vec_id, b.vec_id AS ref, round({D2},9) d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({D2},9), b.vec_id) AS rank FROM ({V} WHERE {{rows}}) a JOIN ({V} WHERE {{refs}}) b ON a.vec_id<>b.vec_id"


def near(spark, d, rows, refs, k=None):
    """The k nearest references of each row; None: all."""
    e = table(spark, d, "embeddings")
    found = nearest_references(e.where(rows), e.where(refs), "vec_id", "embedding", k)
    return found.withColumn("d2", F.round(F.col("dist") * F.col("dist"), 9))


@query("ratio_match_unique", f"WITH n AS ({NEAR.format(rows='vec_id%2=0', refs='vec_id%2=1')}), m AS (SELECT vec_id, max(CASE WHEN rank=1 THEN ref END) AS ref, max(CASE WHEN rank=1 THEN d2 END) d, max(CASE WHEN rank=2 THEN d2 END) s FROM n WHERE rank<=2 GROUP BY 1) SELECT ref, min_by(vec_id,(d,vec_id)) vec_id FROM m WHERE sqrt(d)<0.97*sqrt(s) GROUP BY 1")
def ratio_match_unique(spark, d):
    """The nearest reference if clearly nearer than the second; of those that match one reference the nearest."""
    n = near(spark, d, "vec_id % 2 = 0", "vec_id % 2 = 1", 2).groupBy("vec_id").agg(F.min_by("ref", "rank").alias("ref"), F.min("d2").alias("d"), F.max("d2").alias("s"))
    return n.where(F.sqrt("d") < 0.97 * F.sqrt("s")).groupBy("ref").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("vec_id"))


@query("knn_spacing", f"WITH n AS (SELECT vec_id, sqrt(min(d2)) s FROM ({NEAR.format(rows='TRUE', refs='TRUE')}) WHERE d2>0 GROUP BY 1), q AS (SELECT quantile_cont(s,0.02) a, quantile_cont(s,0.98) b FROM n) SELECT vec_id, round(greatest(a,least(b,s)),5) spacing FROM n, q")
def knn_spacing(spark, d):
    """The distance to the nearest of 16 384 evenly spaced references other than at 0, its ends cut at 2 and 98 percent. The SQL is for clouds of up to that many."""
    e = table(spark, d, "embeddings")
    n = nearest_references(e, rel.evenly_spaced(e, ["vec_id"], MAX_REFERENCES), "vec_id", "embedding", 2).withColumn("d2", F.round(F.col("dist") * F.col("dist"), 9))
    n = _written(n.where("d2 > 0").groupBy("vec_id").agg(F.sqrt(F.min("d2")).alias("s")))
    low, high = quantiles(n, F.col("s"), [0.02, 0.98])
    return n.select("vec_id", F.round(geom.clip(F.col("s"), low or 0.0, high or 0.0), 5).alias("spacing"))


@query("outlier_filter_knn", f"WITH m AS (SELECT vec_id, avg(sqrt(d2)) a FROM ({NEAR.format(rows='TRUE', refs='TRUE')}) WHERE rank<=24 GROUP BY 1), t AS (SELECT avg(a)+2.2*stddev_pop(a) t FROM m) SELECT vec_id FROM m, t WHERE a<=t")
def outlier_filter_knn(spark, d):
    """the mean distance to 24 neighbours, at most 2.2 deviations over its mean."""
    m = _written(near(spark, d, "true", "true", 24).groupBy("vec_id").agg(F.avg(F.sqrt("d2")).alias("a")))
    t = m.agg((F.avg("a") + 2.2 * F.stddev_pop("a")).alias("t")).first()["t"]
    return m.where(F.col("a") <= t).select("vec_id")


@query("retrieval_prior_topk", f"SELECT vec_id, ref, rank FROM (SELECT vec_id, ref, row_number() OVER (PARTITION BY vec_id ORDER BY round(1-d2/2+0.35*exp(-abs(vec_id-ref)/1250.0),8) DESC, ref) AS rank FROM ({NEAR.format(rows='vec_id%100=0', refs='TRUE')})) WHERE rank<=20")
def retrieval_prior_topk(spark, d):
    """Cosine plus a prior that falls with distance in the sequence, the best 20 of all for each asked frame (ids divisible by 100)."""
    e = table(spark, d, "embeddings")

    def score(d2, own, ref):
        return -np.round(1 - np.round(d2, 9) / 2 + 0.35 * np.exp(-np.abs(own - ref) / 1250.0), 8)

    return nearest_references(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 20, score).select("vec_id", "ref", "rank")


@query("nearest_slot", f"SELECT slot, arg_min(event_id,(off_us,event_id)) event_id FROM (SELECT event_id, CAST(ceil(t/3600000000.0-0.5) AS BIGINT) slot, abs(t-CAST(ceil(t/3600000000.0-0.5) AS BIGINT)*3600000000) off_us FROM ({E})) GROUP BY 1")
def nearest_slot(spark, d):
    """The nearest slot of an hourly grid, the earlier of equals; of each slot's frames the nearest."""
    slot = F.ceil(F.col("t") / 3_600_000_000.0 - 0.5).cast("long")
    x = events(spark, d).withColumn("slot", slot).withColumn("off", F.abs(F.col("t") - F.col("slot") * 3_600_000_000))
    return x.groupBy("slot").agg(F.min_by("event_id", F.struct("off", "event_id")).alias("event_id"))


@query("gap_pair_band_join", f"WITH r AS (SELECT user_id, event_id, value, row_number() OVER ({O}) i FROM ({E})) SELECT a.event_id AS src, b.event_id AS dst FROM r a JOIN r b ON a.user_id=b.user_id AND b.i-a.i>=6 AND abs(a.value-b.value)<=0.5 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value-b.value), b.event_id)<=2")
def gap_pair_band_join(spark, d):
    """Later frames of the take at least six places on within a radius, the two nearest; by bands of the radius."""
    r = events(spark, d).select("user_id", "event_id", "value", F.row_number().over(take()).alias("i"))
    a = r.select("user_id", F.col("event_id").alias("src"), F.col("value").alias("va"), F.col("i").alias("ia")).withColumn("band", F.explode(F.array(*[F.floor(F.col("va") / 0.5) + k for k in (-1, 0, 1)])))
    b = r.select("user_id", F.col("event_id").alias("dst"), F.col("value").alias("vb"), F.col("i").alias("ib"), F.floor(F.col("value") / 0.5).alias("band"))
    off = F.abs(F.col("va") - F.col("vb"))
    pairs = a.join(b, ["user_id", "band"]).where((F.col("ib") - F.col("ia") >= 6) & (off <= 0.5))
    return rel.best_per_key(pairs.withColumn("off", off), ["src"], [F.col("off"), F.col("dst")], 2).select("src", "dst")


@query("adaptive_keyframe_reason", f"SELECT event_id, CASE WHEN dt IS NULL THEN 'first' WHEN dt<600 THEN 'too_soon' WHEN dt>86400 THEN 'max_gap' WHEN abs(value-pv)>80 THEN 'motion' WHEN event_type<>pt THEN 'visual_change' ELSE 'redundant' END reason FROM (SELECT *, (t-lag(t) OVER ({O}))/1e6 dt, lag(value) OVER ({O}) pv, lag(event_type) OVER ({O}) pt FROM ({E}))")
def adaptive_keyframe_reason(spark, d):
    """the first reason that holds."""
    w = take()
    dt, pv, pt = (F.col("t") - F.lag("t").over(w)) / 1e6, F.lag("value").over(w), F.lag("event_type").over(w)
    x = events(spark, d).select("event_id", "value", "event_type", dt.alias("dt"), pv.alias("pv"), pt.alias("pt"))
    reason = F.when(F.col("dt").isNull(), "first").when(F.col("dt") < 600, "too_soon").when(F.col("dt") > 86400, "max_gap").when(F.abs(F.col("value") - F.col("pv")) > 80, "motion").when(F.col("event_type") != F.col("pt"), "visual_change").otherwise("redundant")
    return x.select("event_id", reason.alias("reason"))


@query("tsdf_integrate", f"SELECT kx,ky,kz, round(sum(w*s)/sum(w),6) tsdf, CAST(sum(w) AS BIGINT) weight FROM (SELECT *, greatest(-0.1,least(0.1,c)) s, 1+label%2 w FROM (SELECT *, {KEYS} FROM ({P}))) GROUP BY 1,2,3 HAVING sum(w)>=3")
def tsdf_integrate(spark, d):
    """Truncated distances averaged by weight in each voxel; voxels of weight 3 and more."""
    p = keyed(points(spark, d)).withColumn("s", geom.clip(F.col("c"), -0.1, 0.1)).withColumn("w", 1 + F.col("label") % 2)
    return p.groupBy("kx", "ky", "kz").agg(r6(F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("tsdf"), F.sum("w").cast("long").alias("weight")).where("weight >= 3")


@query("ransac_plane_fixed", f"WITH p AS (SELECT *, row_number() OVER (ORDER BY vec_id)-1 i, count(*) OVER () n FROM ({P})), h AS (SELECT k, a.x ax, a.y ay, a.z az, b.x-a.x ux, b.y-a.y uy, b.z-a.z uz, c.x-a.x vx, c.y-a.y vy, c.z-a.z vz FROM (SELECT unnest(range(CAST(least(160,2*count(*)) AS BIGINT))) k FROM p) r JOIN p a ON a.i=(k*17)%a.n JOIN p b ON b.i=(k*43+1)%b.n JOIN p c ON c.i=(k*71+2)%c.n), m AS (SELECT k, ax,ay,az, uy*vz-uz*vy nx, uz*vx-ux*vz ny, ux*vy-uy*vx nz FROM h), q AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) l FROM m WHERE nx*nx+ny*ny+nz*nz>1e-12) SELECT k, count(*) inliers FROM q, p WHERE abs((x-ax)*nx+(y-ay)*ny+(z-az)*nz)/l<=0.025 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def ransac_plane_fixed(spark, d):
    """Planes through min(160, 2 n) triples at fixed strides; the one with most points within 25 mm, the first of equals. One pass over the points counts for all planes."""
    p = points(spark, d).select("vec_id", "x", "y", "z")
    n = p.count()
    hypotheses = min(160, 2 * n)
    places = {(k, c): (k * s + o) % n for k in range(hypotheses) for c, (s, o) in enumerate(((17, 0), (43, 1), (71, 2)))}
    numbered = rel._numbered(p, ["vec_id"]).withColumnRenamed("_i", "i")
    at = {r["i"]: (r["x"], r["y"], r["z"]) for r in numbered.where(F.col("i").isin(sorted(set(places.values())))).collect()}  # 480 points at most
    planes = []
    for k in range(hypotheses):
        a, b, c = (at[places[k, j]] for j in range(3))
        u, v = [q - r for q, r in zip(b, a)], [q - r for q, r in zip(c, a)]
        m = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        if sum(q * q for q in m) > 1e-12:
            planes.append((k, *a, *m))
    hit = [F.count_if(F.abs((F.col("x") - ax) * nx + (F.col("y") - ay) * ny + (F.col("z") - az) * nz) / F.sqrt(F.lit(nx * nx + ny * ny + nz * nz)) <= 0.025).alias(f"h{k}") for k, ax, ay, az, nx, ny, nz in planes]
    if not hit:
        return spark.createDataFrame([], "k long, inliers long")
    row = p.agg(*hit).first()
    best = max(planes, key=lambda q: (row[f"h{q[0]}"], -q[0]))[0]
    return spark.createDataFrame([(best, row[f"h{best}"])], "k long, inliers long")


def _quadtree(size: int, least: int, variance: float) -> str:
    parts, ended, rest = [f"p{size} AS (SELECT x, y, v FROM ({G}))"], [], size
    while True:
        cell = f"CAST(x//{rest}*{rest} AS BIGINT) x0, CAST(y//{rest}*{rest} AS BIGINT) y0"
        split = f"(var>{variance} OR n<{rest * rest})" if rest > least else "FALSE"
        parts.append(f"c{rest} AS MATERIALIZED (SELECT *, {split} split FROM (SELECT {cell}, count(*) n, avg(v) mean, coalesce(var_pop(v),0) var FROM p{rest} GROUP BY 1,2))")
        ended.append(f"SELECT x0, y0, CAST({rest} AS BIGINT) size, n, round(mean,6) mean FROM c{rest} WHERE NOT split")
        if rest <= least:
            return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(ended)
        parts.append(f"p{rest // 2} AS MATERIALIZED (SELECT x, y, v FROM p{rest} JOIN c{rest} ON x0=x//{rest}*{rest} AND y0=y//{rest}*{rest} WHERE split)")
        rest //= 2


def _smoothed(passes: int, weight: float) -> str:
    best = "SELECT node, arg_max(label, (round(s,9), -label)) AS label FROM ({0}) GROUP BY 1"
    parts = [f"g AS MATERIALIZED (SELECT CAST(y*24+x AS BIGINT) node FROM ({G}))", "sc AS MATERIALIZED (SELECT node, k AS label, ((node*7+k*5)%11)/10 score FROM g, range(4) l(k))", "ed AS MATERIALIZED (SELECT a.node u, b.node v FROM g a JOIN g b ON abs(a.node-b.node)=1)", "n0 AS MATERIALIZED (" + best.format("SELECT node, label, score s FROM sc") + ")"]
    for k in range(2 * passes):
        near = f"SELECT u node, label, count(*) w FROM ed JOIN n{k} ON n{k}.node=v GROUP BY 1,2"
        scored = f"SELECT sc.node, sc.label, score+{weight}*coalesce(w,0) s FROM sc LEFT JOIN ({near}) q ON q.node=sc.node AND q.label=sc.label WHERE sc.node%2={k % 2}"
        parts.append(f"n{k + 1} AS MATERIALIZED ({best.format(scored)} UNION ALL SELECT node, label FROM n{k} WHERE node%2<>{k % 2})")
    return "WITH " + ", ".join(parts) + f" SELECT node, CAST(label AS INTEGER) AS label FROM n{2 * passes}"


@query("quadtree_cells", _quadtree(16, 2, 10_000.0))
def quadtree_cells(spark, d):
    """A28 on the raster of events."""
    return raster.quadtree(grid(spark, d), 16, 2, 10_000.0).withColumn("mean", r6(F.col("mean")))


@query("label_smoothing", _smoothed(5, 0.42))
def label_smoothing(spark, d):
    """G8 on the raster of events, four labels."""
    g = grid(spark, d).select((F.col("y") * 24 + F.col("x")).cast("long").alias("node"))
    scores = g.withColumn("label", F.explode(F.array(*map(F.lit, range(4))))).withColumn("score", F.pmod(F.col("node") * 7 + F.col("label") * 5, F.lit(11)) / 10)
    ends = g.withColumn("v", F.explode(F.array(F.col("node") + 1, F.col("node") - 1))).join(g.select(F.col("node").alias("v")), "v")
    return raster.smooth_labels(scores, ends.select(F.col("node").alias("u"), "v", F.lit(1.0).alias("w")))


@query("halfspace_polygon_clip")
def halfspace_polygon_clip(spark, d):
    """triangles of three consecutive points cut to a box."""
    p = points(spark, d).select(F.floor(F.col("vec_id") / 3).alias("tid"), (F.col("vec_id") % 3).alias("k"), F.array("x", "y", "z").alias("p"))
    t = p.groupBy("tid").agg(*[F.max(F.when(F.col("k") == i, F.col("p"))).alias(c) for i, c in enumerate("abc")]).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    return raster.clip_triangles(t, [-0.1, -0.1, -0.1], [0.1, 0.1, 0.1])


@query("splat_pack", "WITH s AS (SELECT vec_id sid, CAST(embedding AS DOUBLE[]) e FROM embeddings), q AS (SELECT *, sqrt(e[11]**2+e[12]**2+e[13]**2+e[14]**2) l FROM s) SELECT sid, round(CAST(e[1] AS FLOAT)::DOUBLE,5) x, round(CAST(exp(e[4]) AS FLOAT)::DOUBLE,5) sx, CAST(round_even(greatest(0,least(1,e[8]))*255,0) AS INTEGER) red, CAST(round_even(255/(1+exp(-e[7])),0) AS INTEGER) opacity, CAST(round_even(greatest(0,least(255,e[14]/greatest(l,1e-12)*128+128)),0) AS INTEGER) qz FROM q")
def splat_pack(spark, d):
    """32 bytes a splat, and back."""
    e = table(spark, d, "embeddings")
    s = e.select(F.col("vec_id").alias("sid"), *[F.slice("embedding", a, n).alias(c) for a, n, c in ((1, 3, "position"), (4, 3, "scale"), (8, 3, "colour"), (11, 4, "turn"))], F.col("embedding")[6].alias("opacity"))
    u = raster.unpacked_splats(raster.packed_splats(s))
    place = lambda c: F.round(F.col(c)[0], 5)
    return u.select("sid", place("position").alias("x"), place("scale").alias("sx"), F.col("colour")[0].alias("red"), F.col("colour")[3].alias("opacity"), F.col("turn")[3].alias("qz"))
