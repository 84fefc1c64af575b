"""Queries of cameras, neighbourhoods, gates and catalogues; the raster and the takes come from `events`."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import relational as rel
from plumbline.operators.graph import connected_components
from plumbline.operators.surface import half_edges
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, G, O, events, grid, take
from plumbline.plans.points import P, points
from plumbline.plans.surface import TRIS, sheet

C40, S40 = math.cos(math.radians(40)), math.sin(math.radians(40))


@query("depth_unproject", f"SELECT x AS u, y AS v, round({C40}*px-{S40}*py+0.5,6) wx, round({S40}*px+{C40}*py-0.25,6) wy, round(z+1,6) wz FROM (SELECT x, y, v/1000 z, (x-11.5)*v/1000/22 px, (y%24-12)*v/1000/23 py FROM ({G})) WHERE x%2=0 AND y%2=0 AND z>0.25 AND z<=4")
def depth_unproject(spark, d):
    """Pixels on a stride of two, with depth in range, to world places."""
    z = F.col("v") / 1000
    g = grid(spark, d).where("x % 2 = 0 AND y % 2 = 0").where((z > 0.25) & (z <= 4))
    px, py = (F.col("x") - 11.5) * z / 22, (F.col("y") % 24 - 12) * z / 23
    turn = [F.lit(float(v)) for v in (C40, -S40, 0, S40, C40, 0, 0, 0, 1)]
    world = geom.apply_rigid(turn, [F.lit(0.5), F.lit(-0.25), F.lit(1.0)], [px, py, z])
    return g.select(F.col("x").alias("u"), F.col("y").alias("v"), *[r6(w).alias(n) for w, n in zip(world, ("wx", "wy", "wz"))])


@query("project_to_depth", f"SELECT vec_id, u, v, round(tol,6) tolerance FROM (SELECT vec_id, CAST(round_even(300*x/(z+1)+63.5,0) AS INTEGER) u, CAST(round_even(300*y/(z+1)+47.5,0) AS INTEGER) v, greatest(2*0.01,0.022,0.009*(z+1)) tol FROM ({P}) WHERE z+1>0.25) WHERE u BETWEEN 0 AND 127 AND v BETWEEN 0 AND 95")
def project_to_depth(spark, d):
    """P5: world points to pixels of a bounded raster, with the tolerance of their depth."""
    z = F.col("z") + 1
    u, v = (F.rint(300 * F.col(c) / z + m).cast("int") for c, m in (("x", 63.5), ("y", 47.5)))
    p = points(spark, d).where(z > 0.25).select("vec_id", u.alias("u"), v.alias("v"), r6(F.greatest(F.lit(0.02), F.lit(0.022), 0.009 * z)).alias("tolerance"))
    return p.where("u BETWEEN 0 AND 127 AND v BETWEEN 0 AND 95")


@query("camera_rescale", "SELECT p_partkey, CAST(greatest(1,round_even(w*s,0)) AS INTEGER) w2, CAST(greatest(1,round_even(h*s,0)) AS INTEGER) h2, round(500*greatest(1,round_even(w*s,0))/w,6) fx FROM (SELECT p_partkey, 640+p_size*13 w, 480+p_partkey%700 h, least(1.0::DOUBLE,960.0::DOUBLE/greatest(640+p_size*13,480+p_partkey%700)) s FROM part)")
def camera_rescale(spark, d):
    """A camera within a bound of 960 pixels, its lens scaled with it; half to even."""
    p = table(spark, d, "part").select("p_partkey", (640 + F.col("p_size") * 13).alias("w"), (480 + F.col("p_partkey") % 700).alias("h"))
    s = F.least(F.lit(1.0), 960.0 / F.greatest("w", "h"))
    w2, h2 = (F.greatest(F.lit(1.0), F.rint(F.col(c) * s)) for c in "wh")
    return p.select("p_partkey", w2.cast("int").alias("w2"), h2.cast("int").alias("h2"), r6(500 * w2 / F.col("w")).alias("fx"))


def _axis(angle: float, k: int):
    q = [F.lit(math.cos(math.radians(angle) / 2)), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    q[k] = F.lit(math.sin(math.radians(angle) / 2))
    return q


def _about(angle: float, a: str, b: str) -> str:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return f"({c!r})*{a}-({s!r})*{b} AS {a}, ({s!r})*{a}+({c!r})*{b} AS {b}"


@query("edit_transform", f"SELECT vec_id, round(x+1,6) x, round(y-2,6) y, round(z+3,6) z FROM (SELECT vec_id, x, {_about(20, 'y', 'z')} FROM (SELECT vec_id, y, {_about(-35, 'z', 'x')} FROM (SELECT vec_id, z, {_about(50, 'x', 'y')} FROM (SELECT vec_id, 2*x AS x, 0.5*y AS y, -1*z AS z FROM ({P})))))")
def edit_transform(spark, d):
    """Scaled, turned by Euler angles about x, y, z as one quaternion, and moved."""
    q = geom.quaternion_product(geom.quaternion_product(_axis(20, 1), _axis(-35, 2)), _axis(50, 3))
    p = [F.lit(0.0), 2 * F.col("x"), 0.5 * F.col("y"), -1 * F.col("z")]
    turned = geom.quaternion_product(geom.quaternion_product(q, p), [q[0], -q[1], -q[2], -q[3]])
    return points(spark, d).select("vec_id", *[r6(v + m).alias(n) for v, m, n in zip(turned[1:], (1, -2, 3), "xyz")])


@query("small_components", f"{TRIS}, h AS (SELECT tid, least(a,b) lo, greatest(a,b) hi FROM t UNION ALL SELECT tid, least(b,c), greatest(b,c) FROM t UNION ALL SELECT tid, least(c,a), greatest(c,a) FROM t), n AS (SELECT DISTINCT p.tid, q.tid other FROM h p JOIN h q ON p.lo=q.lo AND p.hi=q.hi), reach AS (SELECT tid, tid r FROM t UNION SELECT reach.tid, n.other FROM reach JOIN n ON n.tid=reach.r) SELECT tid FROM reach GROUP BY 1 HAVING count(*)>=12")
def small_components(spark, d):
    """Triangles of parts, joined along edges, of at least twelve."""
    t = sheet(spark, d)[0]
    edge = half_edges(t).groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min("tid").alias("first"), F.max("tid").alias("last"))
    parts = connected_components(edge, "first", "last")  # an edge of more than two triangles does not occur in a sheet
    large = parts.groupBy("component").agg(F.count("*").alias("n")).where("n >= 12")
    return parts.join(large, "component", "left_semi").select(F.col("node").alias("tid"))


@query("window_nearest_pixel", f"WITH g AS (SELECT x, y FROM ({G}) WHERE v>150) SELECT k.x, k.y, min_by(p.x, (((p.x-k.x)*(p.x-k.x)+(p.y-k.y)*(p.y-k.y)), p.y, p.x)) px, min_by(p.y, (((p.x-k.x)*(p.x-k.x)+(p.y-k.y)*(p.y-k.y)), p.y, p.x)) py FROM (SELECT x, y FROM ({G}) WHERE (x*7+y*3)%13=0) k JOIN g p ON abs(p.x-k.x)<=5 AND abs(p.y-k.y)<=5 GROUP BY 1,2")
def window_nearest_pixel(spark, d):
    """For each key point the nearest sound pixel of an 11 x 11 window, ties by row, then column."""
    g = grid(spark, d)
    sound = g.where("v > 150").select(F.col("x").alias("px"), F.col("y").alias("py"))
    around = [F.explode(F.sequence(F.col(c) - 5, F.col(c) + 5)).alias("p" + c) for c in "xy"]
    k = g.where("(x * 7 + y * 3) % 13 = 0").select("x", "y", around[0]).select("x", "y", "px", around[1])
    d2 = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    return k.join(sound, ["px", "py"]).groupBy("x", "y").agg(F.min(F.struct(d2.alias("d"), "py", "px")).alias("m")).select("x", "y", "m.px", "m.py")


@query("offset_support", f"WITH g AS (SELECT * FROM ({G}) WHERE v>0) SELECT a.x, a.y FROM g a WHERE EXISTS (SELECT 1 FROM g b WHERE b.x=a.x AND b.y-a.y IN (-4,-2,-1,1,2,4) AND abs(b.v-a.v)<=0.08*a.v)")
def offset_support(spark, d):
    """Pixels that a frame 1, 2 or 4 before or after sees at the same depth within 8 percent."""
    g = grid(spark, d).where("v > 0")
    near = g.select("x", "y", "v", F.explode(F.array(*[F.col("y") + k for k in (-4, -2, -1, 1, 2, 4)])).alias("at"))
    seen = near.join(g.select("x", F.col("y").alias("at"), F.col("v").alias("w")), ["x", "at"]).where("abs(w - v) <= 0.08 * v")
    return seen.select("x", "y").distinct()


@query("tracked_prefix", f"WITH r AS (SELECT user_id, value, row_number() OVER ({O}) i, count(*) OVER (PARTITION BY user_id) n FROM ({E})), c AS (SELECT user_id, max(n) n, coalesce(min(CASE WHEN value>200 THEN i END)-1,max(n)) tracked FROM r GROUP BY 1) SELECT user_id, tracked, tracked>=greatest(30,ceil(0.25*n)) recoverable FROM c")
def tracked_prefix(spark, d):
    """The frames before the first that fails, and whether they suffice (30, or a quarter)."""
    r = events(spark, d).select("user_id", "value", F.row_number().over(take()).cast("long").alias("i"))
    c = r.groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("value") > 200, F.col("i"))).alias("bad"))
    tracked = F.coalesce(F.col("bad") - 1, F.col("n"))
    return c.select("user_id", tracked.alias("tracked"), (tracked >= F.greatest(F.lit(30), F.ceil(0.25 * F.col("n")))).alias("recoverable"))


@query("anchor_frame", f"SELECT user_id, min_by(event_id, (abs(value-m), event_id)) event_id FROM (SELECT *, median(value) OVER (PARTITION BY user_id) m FROM ({E})) GROUP BY 1")
def anchor_frame(spark, d):
    """The frame of a take whose brightness is nearest to the median."""
    e = events(spark, d)
    m = e.groupBy("user_id").agg(F.median("value").alias("m"))
    return e.join(m, "user_id").groupBy("user_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("value") - F.col("m")), "event_id")).alias("event_id"))


@query("structural_similarity", f"WITH g AS (SELECT x, y, v/2000 p, v/2000*(0.9+0.02*((x+y)%5)) q FROM ({G}) WHERE v>0), w AS (SELECT a.x, a.y, avg(b.p) mp, avg(b.q) mq, avg(b.p*b.p)-avg(b.p)*avg(b.p) vp, avg(b.q*b.q)-avg(b.q)*avg(b.q) vq, avg(b.p*b.q)-avg(b.p)*avg(b.q) c FROM g a JOIN g b ON abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 GROUP BY 1,2 HAVING count(*)=9) SELECT x, y, round((2*mp*mq+0.0001)*(2*c+0.0009)/((mp*mp+mq*mq+0.0001)*(vp+vq+0.0009)),5) ssim FROM w")
def structural_similarity(spark, d):
    """SSIM of two rasters over 3 x 3 windows without a gap; a window of nine pixels has its middle."""
    p = F.col("v") / 2000
    g = grid(spark, d).where("v > 0").select("x", "y", p.alias("p"), (p * (0.9 + 0.02 * ((F.col("x") + F.col("y")) % 5))).alias("q"))
    to = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    e = g.select("p", "q", F.explode(to).alias("t")).select("p", "q", "t.*")
    ones = {"mp": "p", "mq": "q", "pp": "p * p", "qq": "q * q", "pq": "p * q"}
    w = e.groupBy("x", "y").agg(F.count("*").alias("n"), *[F.avg(F.expr(x)).alias(n) for n, x in ones.items()]).where("n = 9")
    return w.select("x", "y", F.expr("round((2*mp*mq+0.0001D)*(2*(pq-mp*mq)+0.0009D)/((mp*mp+mq*mq+0.0001D)*(pp-mp*mp+qq-mq*mq+0.0009D)), 5)").alias("ssim"))


@query("grid_coverage", f"SELECT user_id, round(count(DISTINCT (event_id%8, (event_id//8)%6))/48.0,6) coverage, round(median(value),6) mid, round(quantile_cont(value,0.9),6) high FROM ({E}) GROUP BY 1")
def grid_coverage(spark, d):
    """The share of an 8 x 6 grid that tracked points cover; median and 90th percentile of their motion."""
    cell = F.col("event_id") % 8 + 8 * (F.floor(F.col("event_id") / 8) % 6)
    return events(spark, d).groupBy("user_id").agg(r6(F.count_distinct(cell) / 48.0).alias("coverage"), r6(F.median("value")).alias("mid"), r6(F.percentile("value", 0.9)).alias("high"))


@query("group_batches", "SELECT source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id)-1)//64 AS BIGINT) batch, doc_id FROM documents")
def group_batches(spark, d):
    """The images of one camera in batches of 64."""
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("source", F.floor((rn - 1) / 64).alias("batch"), "doc_id")


@query("model_ranking", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey)=1")
def model_ranking(spark, d):
    """Of each group the model with most images, then most points, then the first."""
    return rel.best_per_key(table(spark, d, "part"), ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query("single_valued", "SELECT p_brand, count(DISTINCT p_size)=1 one_size, count(DISTINCT p_brand)=1 one_brand FROM part GROUP BY 1")
def single_valued(spark, d):
    """Whether a group shares one value."""
    return table(spark, d, "part").groupBy("p_brand").agg((F.count_distinct("p_size") == 1).alias("one_size"), (F.count_distinct("p_brand") == 1).alias("one_brand"))


@query("sky_mask", f"SELECT event_id, round(CASE WHEN hi>lo THEN greatest(0,least(1,1-(value-lo)/(hi-lo))) ELSE 1 END,6) mask FROM (SELECT *, min(value) OVER (PARTITION BY user_id) lo, max(value) OVER (PARTITION BY user_id) hi FROM ({E}))")
def sky_mask(spark, d):
    """A frame's values scaled between its extremes, inverted and clipped; a flat frame is 1."""
    e = events(spark, d)
    s = e.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    m = F.when(F.col("hi") > F.col("lo"), geom.clip(1 - (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0)).otherwise(1.0)
    return e.join(s, "user_id").select("event_id", r6(m).alias("mask"))


@query("depth_quantize", f"SELECT event_id, CAST(round_even(least(greatest(value/7,0),65.535)*1000,0) AS INTEGER) mm FROM ({E})")
def depth_quantize(spark, d):
    """Metres to millimetres of 16 bits, half to even."""
    return events(spark, d).select("event_id", F.rint(geom.clip(F.col("value") / 7, 0.0, 65.535) * 1000).cast("int").alias("mm"))


@query("recovered_poses", "WITH r AS (SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) quality FROM labels GROUP BY 1) l USING (doc_id)) SELECT source, count(*) n, count(*) FILTER (quality IS NULL) recovered, min(doc_id) FILTER (quality IS NOT NULL) AS anchor, CAST(sum(coalesce(quality,-1)) AS BIGINT) total FROM r GROUP BY 1")
def recovered_poses(spark, d):
    """Registered values, else recovered ones; how many were recovered and the first anchor."""
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    r = table(spark, d, "documents").select("doc_id", "source").join(l, "doc_id", "left")
    return r.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("recovered"), F.min(F.when(F.col("quality").isNotNull(), F.col("doc_id"))).alias("anchor"), F.sum(F.coalesce("quality", F.lit(-1))).cast("long").alias("total"))


@query("manifest_stale", "SELECT doc_id, source, TRUE stale FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1 AND doc_id IS NOT NULL)")
def manifest_stale(spark, d):
    """Records that match go, all that stay are marked stale."""
    gone = table(spark, d, "labels").where("toxic = 1")
    return rel.without_rejected(table(spark, d, "documents"), gone, "doc_id").select("doc_id", "source", F.lit(True).alias("stale"))


@query("fnv_fingerprint", "SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name,''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h,b)*16777619)%4294967296) fnv FROM customer")
def fnv_fingerprint(spark, d):
    """FNV-1a of 32 bits over the characters of an ASCII name."""
    fold = F.aggregate(F.split("c_name", ""), F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619, F.lit(4294967296)))
    return table(spark, d, "customer").select("c_custkey", fold.alias("fnv"))


@query("lens_numbers", "SELECT p_partkey, round((20+p_size)*sqrt(w*w+h*h)/sqrt(36.0*36+24*24),6) focal, CAST(greatest(14,round_even(h*518.0::DOUBLE/w/14,0)*14) AS INTEGER) patch_h, round(pow(0.01::DOUBLE,1.0::DOUBLE/(100+p_size)),9) decay FROM (SELECT *, 640.0::DOUBLE+p_size w, 480.0::DOUBLE+p_partkey%200 h FROM part)")
def lens_numbers(spark, d):
    """35 mm focal lengths in pixels, sizes in multiples of a patch, decay a step."""
    w, h = 640.0 + F.col("p_size"), 480.0 + F.col("p_partkey") % 200
    focal = (20 + F.col("p_size")) * F.hypot(w, h) / math.hypot(36, 24)
    patch = F.greatest(F.lit(14.0), F.rint(h * 518.0 / w / 14) * 14).cast("int")
    return table(spark, d, "part").select("p_partkey", r6(focal).alias("focal"), patch.alias("patch_h"), F.round(F.pow(F.lit(0.01), 1.0 / (100 + F.col("p_size"))), 9).alias("decay"))
