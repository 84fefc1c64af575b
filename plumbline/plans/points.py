"""Queries of spatial operators; the point cloud is the first dimensions of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators.quantiles import SORTED, quantiles
from plumbline.operators.relational import best_per_key
from plumbline.plans.catalogue import query, r6, table

P = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z, CAST(embedding[4] AS DOUBLE) c, CAST(embedding[5] AS DOUBLE) f FROM embeddings"


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyzcf")])


def keyed(p: DataFrame, size: float = 0.1, centred: bool = False) -> DataFrame:
    return p.withColumns({f"k{n}": geom.voxel_key(F.col(n), size, centred) for n in "xyz"})


KEYS = "CAST(floor(x/0.1) AS BIGINT) kx, CAST(floor(y/0.1) AS BIGINT) ky, CAST(floor(z/0.1) AS BIGINT) kz"


@query("voxel_downsample", f"SELECT kx,ky,kz,count(*) n, round(avg(x),6) x, round(avg(y),6) y, round(avg(z),6) z, CAST(round_even(avg(label),0) AS BIGINT) label FROM (SELECT *, {KEYS} FROM ({P})) GROUP BY kx,ky,kz")
def voxel_downsample(spark, d):
    """A1: one point a voxel, the mean; colours (here: labels) rounded half to even."""
    return keyed(points(spark, d)).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"), *[r6(F.avg(n)).alias(n) for n in "xyz"], F.rint(F.avg("label")).cast("long").alias("label"))


@query("voxel_weld", f"SELECT kx,ky,kz,count(*) n, round(avg(x),6) x, round(avg(y),6) y, round(avg(z),6) z FROM (SELECT *, CAST(floor(x/0.1+0.5) AS BIGINT) kx, CAST(floor(y/0.1+0.5) AS BIGINT) ky, CAST(floor(z/0.1+0.5) AS BIGINT) kz FROM ({P})) GROUP BY kx,ky,kz")
def voxel_weld(spark, d):
    """A2: vertices that round to one cell become their mean."""
    return keyed(points(spark, d), centred=True).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"), *[r6(F.avg(n)).alias(n) for n in "xyz"])


@query("voxel_two_phase", f"SELECT kx,ky,kz,count(*) frames, round(avg(x),6) x, round(avg(y),6) y FROM (SELECT label,kx,ky,kz,avg(x) x, avg(y) y FROM (SELECT *, {KEYS} FROM ({P})) GROUP BY label,kx,ky,kz) GROUP BY kx,ky,kz")
def voxel_two_phase(spark, d):
    """A3: reduced per frame (label) first: a mean of means."""
    per = keyed(points(spark, d)).groupBy("label", "kx", "ky", "kz").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return per.groupBy("kx", "ky", "kz").agg(F.count("*").alias("frames"), r6(F.avg("x")).alias("x"), r6(F.avg("y")).alias("y"))


@query("voxel_best_seed", f"SELECT kx,ky,kz,vec_id FROM (SELECT *, {KEYS} FROM ({P})) QUALIFY row_number() OVER (PARTITION BY kx,ky,kz ORDER BY c DESC, f, vec_id)=1")
def voxel_best_seed(spark, d):
    """Of each voxel the seed of most confidence, then least footprint, then first."""
    return best_per_key(keyed(points(spark, d)), ["kx", "ky", "kz"], [F.desc("c"), F.col("f"), F.col("vec_id")]).select("kx", "ky", "kz", "vec_id")


@query("bounds_padded", f"SELECT label, round(min(x)-greatest(0.005,0.005*(max(x)-min(x))),6) lo, round(max(x)+greatest(0.005,0.005*(max(x)-min(x))),6) hi FROM ({P}) GROUP BY label")
def bounds_padded(spark, d):
    """Bounds, padded by 5 mm or half a percent."""
    pad = F.greatest(F.lit(0.005), 0.005 * (F.max("x") - F.min("x")))
    return points(spark, d).groupBy("label").agg(r6(F.min("x") - pad).alias("lo"), r6(F.max("x") + pad).alias("hi"))


@query("box_clip", f"SELECT vec_id FROM ({P}) WHERE x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.2 AND 0.1")
def box_clip(spark, d):
    """F16: an axis-aligned box, ends included."""
    return points(spark, d).where(F.col("x").between(-0.1, 0.15) & F.col("y").between(-0.1, 0.1) & F.col("z").between(-0.2, 0.1)).select("vec_id")


@query("scene_scale_p90", f"WITH m AS (SELECT median(x) mx, median(y) my, median(z) mz FROM ({P})) SELECT round(greatest(quantile_cont(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)),0.9),0.001),6) scale FROM ({P}), m")
def scene_scale_p90(spark, d):
    """The 90th percentile of the distance to the median of each axis."""
    p = points(spark, d)
    if p.count() <= SORTED:  # two aggregates; beyond, the same numbers by histograms
        m = p.agg(*[F.median(n).alias(n) for n in "xyz"]).first()
        off = geom.norm(*[F.col(n) - F.lit(m[n]) for n in "xyz"])
        return p.agg(r6(F.greatest(F.percentile(off, 0.9), F.lit(0.001))).alias("scale"))
    middle = [quantiles(p, F.col(n), [0.5])[0] for n in "xyz"]
    far = quantiles(p, geom.norm(*[F.col(n) - F.lit(m) for n, m in zip("xyz", middle)]), [0.9])[0]
    return spark.createDataFrame([(max(far, 0.001),)], "scale double").select(r6("scale").alias("scale"))


@query("percentile_caps", f"WITH q AS (SELECT label l, quantile_cont(x,0.1) a, quantile_cont(x,0.9) b FROM ({P}) GROUP BY label) SELECT vec_id, round(greatest(0.55,least(0.95,0.55+0.4*(x-a)/greatest(b-a,1e-9))),6) score FROM ({P}) JOIN q ON label=l")
def percentile_caps(spark, d):
    """Scores from the 10th to the 90th percentile of a frame, to 0.55 .. 0.95."""
    p = points(spark, d)
    q = p.groupBy("label").agg(F.percentile("x", 0.1).alias("a"), F.percentile("x", 0.9).alias("b"))
    return p.join(q, "label").select("vec_id", r6(geom.clip(0.55 + 0.4 * (F.col("x") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1e-9)), 0.55, 0.95)).alias("score"))


@query("rotation_angle", f"SELECT vec_id, round(degrees(acos(greatest(-1,least(1,(3*x*2-1)/2)))),6) angle FROM ({P})")
def rotation_angle(spark, d):
    """M1, on six times x as a trace."""
    return points(spark, d).select("vec_id", r6(geom.rotation_angle(3 * F.col("x") * 2)).alias("angle"))


@query("rigid_apply", f"SELECT vec_id, round(cos(c)*x - sin(c)*y + 1.5,6) px, round(sin(c)*x + cos(c)*y - 0.5,6) py, round(z + 0.25,6) pz FROM ({P})")
def rigid_apply(spark, d):
    """M2, M6: a rotation about z by c and a shift."""
    m = geom.axis_rotation((F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("c"))
    out = geom.apply_rigid(m, [F.lit(1.5), F.lit(-0.5), F.lit(0.25)], [F.col(n) for n in "xyz"])
    return points(spark, d).select("vec_id", *[r6(o).alias(n) for o, n in zip(out, ("px", "py", "pz"))])


@query("quaternion_roundtrip", f"SELECT vec_id, round(cos(x)*cos(y)-sin(x)*sin(y),6) w, round(cos(x)*sin(y)+sin(x)*cos(y),6) k FROM ({P})")
def quaternion_roundtrip(spark, d):
    """M4: the product of two turns about one axis is their sum."""
    zero = F.lit(0.0)
    q = geom.quaternion_product([F.cos("x"), zero, zero, F.sin("x")], [F.cos("y"), zero, zero, F.sin("y")])
    return points(spark, d).select("vec_id", r6(q[0]).alias("w"), r6(q[3]).alias("k"))


@query("srgb_linear", f"SELECT vec_id, round(CASE WHEN v<=0.04045 THEN v/12.92 ELSE pow((v+0.055)/1.055,2.4) END,6) lin, CAST(round_even(v*255,0) AS INTEGER) byte FROM (SELECT vec_id, greatest(0,least(1,0.5+x)) v FROM ({P}))")
def srgb_linear(spark, d):
    """M10, M13."""
    v = geom.clip(0.5 + F.col("x"), 0.0, 1.0)
    return points(spark, d).select("vec_id", r6(geom.srgb_to_linear(v)).alias("lin"), geom.to_byte(v).alias("byte"))


@query("sigmoid_sh_color", f"SELECT vec_id, round(1/(1+exp(-x*10)),6) opacity, round((y+0.2-0.5)/0.28209479177387814,6) sh FROM ({P})")
def sigmoid_sh_color(spark, d):
    """M11, M12."""
    return points(spark, d).select("vec_id", r6(geom.sigmoid(F.col("x") * 10)).alias("opacity"), r6((F.col("y") + 0.2 - 0.5) / geom.SH_C0).alias("sh"))


@query("lens_projection", f"SELECT vec_id, round(x*g+2*0.004*x*y+(-0.002)*(r+2*x*x),6) u, round(y*g+0.004*(r+2*y*y)+2*(-0.002)*x*y,6) v FROM (SELECT *, 1+r*(0.12+r*(-0.03+r*0.01)) g FROM (SELECT *, x*x+y*y r FROM ({P})))")
def lens_projection(spark, d):
    """A lens with radial and tangential distortion."""
    u, v = geom.brown_lens(F.col("x"), F.col("y"), (0.12, -0.03, 0.01), (0.004, -0.002))
    return points(spark, d).select("vec_id", r6(u).alias("u"), r6(v).alias("v"))


@query("polygon_inside", f"WITH e(x1,y1,x2,y2) AS (VALUES (-0.1,-0.1,0.2,-0.1),(0.2,-0.1,0.1,0.15),(0.1,0.15,-0.1,-0.1)) SELECT vec_id, sum(CASE WHEN (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END)%2=1 inside FROM ({P}), e GROUP BY vec_id")
def polygon_inside(spark, d):
    """crossings of a ray with the edges of a fixed polygon."""
    corners = [(-0.1, -0.1), (0.2, -0.1), (0.1, 0.15)]
    x, y, total = F.col("x"), F.col("y"), F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            total = total + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return points(spark, d).select("vec_id", (total % 2 == 1).alias("inside"))


@query("huber_weighted", f"SELECT label, round(sum(w*h)/sum(w),6) loss FROM (SELECT label, 0.1+abs(c) w, CASE WHEN abs(x-y)<=0.05 THEN 0.5*(x-y)*(x-y)/0.05 ELSE abs(x-y)-0.025 END h FROM ({P})) GROUP BY label")
def huber_weighted(spark, d):
    """A Huber loss weighted by confidence."""
    e = F.abs(F.col("x") - F.col("y"))
    p = points(spark, d).select("label", (0.1 + F.abs("c")).alias("w"), F.when(e <= 0.05, 0.5 * e * e / 0.05).otherwise(e - 0.025).alias("h"))
    return p.groupBy("label").agg(r6(F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("loss"))


@query("two_pass_weighted_union", f"SELECT label, round(sum(w*x)/sum(w),6) x FROM (SELECT label, x, CASE WHEN c>0 THEN 2 ELSE 1 END w FROM ({P})) GROUP BY label")
def two_pass_weighted_union(spark, d):
    """Measured points come twice, generated ones once: one scan with a weight."""
    p = points(spark, d).withColumn("w", F.when(F.col("c") > 0, 2).otherwise(1))
    return p.groupBy("label").agg(r6(F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))


@query("view_best_with_tiebreak", f"SELECT label, arg_max(vec_id, (round(x,2), -vec_id)) best FROM ({P}) GROUP BY label")
def view_best_with_tiebreak(spark, d):
    """The best view of each point; of equal ones the first."""
    return points(spark, d).groupBy("label").agg(F.max_by("vec_id", F.struct(F.round("x", 2), -F.col("vec_id"))).alias("best"))


@query("top4_weighted", f"SELECT label, round(sum(g*x)/sum(g),6) colour FROM (SELECT *, abs(c)+0.01 g FROM ({P}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(c) DESC, vec_id)<=4) GROUP BY label")
def top4_weighted(spark, d):
    """The four heaviest observations of each vertex, weighted."""
    top = best_per_key(points(spark, d), ["label"], [F.abs("c").desc(), F.col("vec_id")], 4).withColumn("g", F.abs("c") + 0.01)
    return top.groupBy("label").agg(r6(F.sum(F.col("g") * F.col("x")) / F.sum("g")).alias("colour"))
