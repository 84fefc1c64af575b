"""Queries of colour, texture and labelled meshes over the raster of `events` and the cloud of `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import texture
from plumbline.operators import relational as rel
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import G, grid
from plumbline.plans.points import KEYS, P, keyed, points
from plumbline.plans.surface import TRIS, sheet

S = f"SELECT vec_id, (x+1)*10 u, (y+1)*12 w FROM ({P})"
R = f"SELECT x, y%26 y, least(255,max(v)/100) v FROM ({G}) GROUP BY 1,2"
B = "CASE WHEN c/255<=0.04045 THEN c/255/12.92 ELSE pow((c/255+0.055)/1.055,2.4) END"
FOUR = f"SELECT s.vec_id, (CASE WHEN i=1 THEN u-floor(u) ELSE 1-(u-floor(u)) END)*(CASE WHEN j=1 THEN w-floor(w) ELSE 1-(w-floor(w)) END) k, r.v c FROM ({S}) s, (VALUES (0,0),(0,1),(1,0),(1,1)) q(i,j), ({R}) r WHERE r.x=least(floor(u)+i,23) AND r.y=least(floor(w)+j,25) AND u BETWEEN 0 AND 23 AND w BETWEEN 0 AND 25"


def raster(spark, d):
    return grid(spark, d).groupBy("x", (F.col("y") % 26).alias("y")).agg(F.least(F.lit(255.0), F.max("v") / 100).alias("v"))


@query("bilinear_samples", f"SELECT vec_id, round(sum(k*c),6) plain, round(sum(k*{B}),6) linear FROM ({FOUR}) GROUP BY 1 HAVING count(*)=4")
def bilinear_samples(spark, d):
    """Places of the cloud in the raster, between four pixels, plain and in linear light; a place one of whose pixels is missing is not valid."""
    p = points(spark, d).select("vec_id", ((F.col("x") + 1) * 10).alias("u"), ((F.col("y") + 1) * 12).alias("w"))
    plain, linear = (texture.bilinear(p, raster(spark, d), [], "u", "w", (24, 26), ["v"], light) for light in (False, True))
    return plain.select("vec_id", r6("v").alias("plain")).join(linear.select("vec_id", r6("v").alias("linear")), "vec_id")


@query("calibrated_colours", f"WITH f AS (SELECT x, y, ((x*5+y*3)%7-3)/50.0 s FROM range(4) a(x), range(4) b(y)), p AS (SELECT x, y, v c, x/23.0*3 u, y/25.0*3 w FROM ({R})), n AS (SELECT p.x, p.y, {B} lin, floor(u) l, floor(w) t, u-floor(u) fx, w-floor(w) fy FROM p), m AS (SELECT n.x, n.y, any_value(lin) lin, sum(s*(CASE WHEN i=1 THEN fx ELSE 1-fx END)*(CASE WHEN j=1 THEN fy ELSE 1-fy END)) s FROM n, (VALUES (0,0),(0,1),(1,0),(1,1)) q(i,j), f WHERE f.x=least(l+i,3) AND f.y=least(t+j,3) GROUP BY n.x, n.y), o AS (SELECT x, y, greatest(0,least(1,lin*1.1+0.01+s)) z FROM m) SELECT x, y, CAST(round_even((CASE WHEN z<=0.0031308 THEN z*12.92 ELSE 1.055*pow(z,1/2.4)-0.055 END)*255,0) AS INTEGER) v FROM o")
def calibrated_colours(spark, d):
    """Gain, bias and a field of 4 x 4 cells."""
    px = raster(spark, d).withColumn("f", F.lit(0))
    cells = spark.range(16).select(F.lit(0).alias("f"), (F.col("id") % 4).alias("x"), F.expr("id div 4").alias("y")).withColumn("spatial", ((F.col("x") * 5 + F.col("y") * 3) % 7 - 3) / 50.0)
    gains = spark.createDataFrame([(0, 1.1, 0.01)], "f int, gain double, bias double")
    return texture.calibrated(px, gains, cells, "f", (24, 26), (4, 4)).select("x", "y", "v")


def _relaxed(rounds: int) -> str:
    around = " OR ".join(f"(b.x=(a.x+{i})%16 AND b.y=(a.y+{j})%16)" for i, j in ((1, 0), (15, 0), (0, 1), (0, 15)))
    parts = [f"c AS (SELECT y//16 f, x, y%16 y, v/100000-0.05 mean, CAST(trunc(v/500) AS INTEGER) n FROM ({G}) WHERE x<16)", "r0 AS MATERIALIZED (SELECT f, i.x, j.y, coalesce(mean,0) data, least(coalesce(n,0)/8,4) w, coalesce(mean,0) s FROM (SELECT DISTINCT f FROM c) k, range(16) i(x), range(16) j(y) LEFT JOIN c USING (f, x, y))".replace("FROM (SELECT DISTINCT f FROM c) k, range(16) i(x), range(16) j(y) LEFT JOIN c USING (f, x, y)", "FROM (SELECT f, i.x, j.y FROM (SELECT DISTINCT f FROM c) k, range(16) i(x), range(16) j(y)) i LEFT JOIN c USING (f, x, y)").replace("SELECT f, i.x, j.y, coalesce(mean", "SELECT f, x, y, coalesce(mean")]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT a.f, a.x, a.y, a.data, a.w, (a.w*a.data+1.5*avg(b.s))/(a.w+1.5) s FROM r{k} a JOIN r{k} b ON a.f=b.f AND ({around}) GROUP BY a.f, a.x, a.y, a.data, a.w)")
    return "WITH " + ", ".join(parts) + f" SELECT f, CAST(x AS INTEGER) x, CAST(y AS INTEGER) y, round(greatest(-0.08,least(0.08,s)),6) spatial FROM r{rounds}"


@query("smoothed_fields", _relaxed(24))
def smoothed_fields(spark, d):
    """Sixteen days and hours of the raster are a frame's field."""
    g = grid(spark, d).where("x < 16").select(F.expr("y div 16").alias("f"), "x", (F.col("y") % 16).alias("y"), (F.col("v") / 100_000 - 0.05).alias("mean"), (F.col("v") / 500).cast("int").alias("n"))
    return texture.smoothed_fields(g, "f").withColumn("spatial", r6(F.col("spatial")))


PAIRS = TRIS + ", h AS (SELECT tid, least(a,b) lo, greatest(a,b) hi FROM t UNION ALL SELECT tid, least(b,c), greatest(b,c) FROM t UNION ALL SELECT tid, least(c,a), greatest(c,a) FROM t), pr AS (SELECT lag(tid) OVER (PARTITION BY lo,hi ORDER BY tid) t1, tid t2, lo, hi FROM h QUALIFY lag(tid) OVER (PARTITION BY lo,hi ORDER BY tid) IS NOT NULL)"


@query("edge_weights", f"{PAIRS}, n AS (SELECT t.tid, (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) a, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) b, (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) c FROM t JOIN w p ON p.vid=t.a JOIN w q ON q.vid=t.b JOIN w r ON r.vid=t.c), u AS (SELECT tid, a/sqrt(a*a+b*b+c*c) a, b/sqrt(a*a+b*b+c*c) b, c/sqrt(a*a+b*b+c*c) c FROM n), l AS (SELECT pr.*, pow(greatest(0,least(1,f.a*g.a+f.b*g.b+f.c*g.c)),4) co, sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2) len FROM pr JOIN u f ON f.tid=t1 JOIN u g ON g.tid=t2 JOIN w p ON p.vid=lo JOIN w q ON q.vid=hi) SELECT t1, t2, round(co*greatest(0.25,least(4,len/(SELECT median(len) FROM l))),6) weight FROM l")
def edge_weights(spark, d):
    """G9, J18."""
    return texture.edge_weights(*sheet(spark, d)).select("t1", "t2", r6("weight").alias("weight"))


@query("label_switches", f"{PAIRS} SELECT round(100*avg(CASE WHEN t1%5<>t2%5 THEN 1.0 ELSE 0 END),6) AS percent FROM pr WHERE t1%7>0 AND t2%7>0")
def label_switches(spark, d):
    """Labels by face number, a seventh of the faces without one."""
    t, _ = sheet(spark, d)
    from plumbline.operators.surface import half_edges
    from pyspark.sql import Window

    e = half_edges(t).select("tid", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    pairs = e.select(F.lag("tid").over(Window.partitionBy("lo", "hi").orderBy("tid")).alias("t1"), F.col("tid").alias("t2")).where("t1 IS NOT NULL")
    labels = t.select("tid", F.when(F.col("tid") % 7 > 0, F.col("tid") % 5).otherwise(-1).alias("label"))
    return texture.label_switches(pairs, labels).select(r6("percent").alias("percent"))


SEEN = f"SELECT vec_id, label, 300+x*900 u, 200+y*700 w, c*4 facing, abs(z)*6+0.2 distance, abs(f)/5 residual, greatest(0.022,(abs(z)*6+0.2)*0.009) tol FROM ({P})"


@query("observation_weights", f"WITH s AS ({SEEN}), k AS (SELECT *, u BETWEEN 0 AND 598.999 AND w BETWEEN 0 AND 398.999 ok FROM s), g AS (SELECT label, CASE WHEN coalesce(avg(CASE WHEN ok AND residual<=tol THEN CASE WHEN facing>0 THEN 1.0 ELSE 0 END END),1)<0.35 THEN -1.0 ELSE 1 END sgn FROM k GROUP BY 1), b AS (SELECT k.*, pow(greatest(0.02,greatest(0,least(1,facing*sgn))),2)*greatest(0,least(1,least(u,w,599-u,399-w)/24))*0.5/greatest(distance,0.5) base FROM k JOIN g USING (label)) SELECT vec_id, round(CASE WHEN ok AND residual<=tol THEN base*exp(-pow(residual/tol,2)) ELSE 0 END,6) strict, round(CASE WHEN ok THEN base*exp(-pow(residual/(4*tol),2)) ELSE 0 END,6) loose FROM b")
def observation_weights(spark, d):
    """Labels as views."""
    x = lambda c: F.col(c)
    distance = F.abs("z") * 6 + 0.2
    seen = points(spark, d).select("vec_id", "label", (300 + x("x") * 900).alias("u"), (200 + x("y") * 700).alias("v"), (x("c") * 4).alias("facing"), distance.alias("distance"), (F.abs("f") / 5).alias("residual"), F.greatest(F.lit(0.022), distance * 0.009).alias("tolerance"))
    return texture.observations(seen, "label", 500.0, (600, 400)).select("vec_id", r6("strict").alias("strict"), r6("loose").alias("loose"))


@query("reduced_zbuffer", f"SELECT label, x, y, round(min(z),6) z FROM (SELECT label, CAST(round_even((300+x*900+0.5)*64/600-0.5,0) AS BIGINT) x, CAST(round_even((200+y*700+0.5)*43/400-0.5,0) AS BIGINT) y, z FROM ({P}) WHERE z>0) WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 42 GROUP BY 1,2,3")
def reduced_zbuffer(spark, d):
    """X3."""
    p = points(spark, d).select("label", (300 + F.col("x") * 900).alias("u"), (200 + F.col("y") * 700).alias("v"), "z")
    return texture.reduced_zbuffer(p, "label", "u", "v", "z", (600, 400), 64).withColumn("z", r6(F.col("z")))


@query("surface_frames", f"WITH p AS (SELECT x, y, 1+v/50000 z, (x-11.5)*(1+v/50000)/18 a, (y-12)*(1+v/50000)/18 b FROM ({G}) WHERE v>-50000), m AS (SELECT p.x, p.y, p.z, p.a, p.b, r.a-l.a ax, r.b-l.b ay, r.z-l.z az, w.a-u.a bx, w.b-u.b dy, w.z-u.z bz FROM p LEFT JOIN p l ON l.x=p.x-1 AND l.y=p.y LEFT JOIN p r ON r.x=p.x+1 AND r.y=p.y LEFT JOIN p u ON u.x=p.x AND u.y=p.y-1 LEFT JOIN p w ON w.x=p.x AND w.y=p.y+1), t AS (SELECT x, y, z, a, b, CASE WHEN k THEN ax ELSE z/18 END tx, CASE WHEN k THEN ay ELSE 0 END ty, CASE WHEN k THEN az ELSE 0 END tz, CASE WHEN k THEN bx ELSE 0 END sx, CASE WHEN k THEN dy ELSE z/18 END sy, CASE WHEN k THEN bz ELSE 0 END sz FROM (SELECT *, ax IS NOT NULL AND bx IS NOT NULL k FROM m)), n AS (SELECT *, ty*sz-tz*sy nx, tz*sx-tx*sz ny, tx*sy-ty*sx nz FROM t), o AS (SELECT *, CASE WHEN nx*a+ny*b+nz*z>0 THEN -1 ELSE 1 END/greatest(sqrt(nx*nx+ny*ny+nz*nz),1e-8) g FROM n), q AS (SELECT x, y, nx*g nx, ny*g ny, nz*g nz, tx-(tx*nx+ty*ny+tz*nz)*g*g*nx tx, ty-(tx*nx+ty*ny+tz*nz)*g*g*ny ty, tz-(tx*nx+ty*ny+tz*nz)*g*g*nz tz FROM o), f AS (SELECT x, y, nx, ny, nz, tx/l tx, ty/l ty, tz/l tz FROM (SELECT *, sqrt(tx*tx+ty*ty+tz*tz) l FROM q)) SELECT x, y, round(4*qq,5) trace FROM (SELECT x, y, (1+tx+(nz*tx-nx*tz)+nz)/4 qq FROM f)")
def surface_frames(spark, d):
    """The frame of each pixel, checked by one number of its rotation, 1 + its trace, which is four times the square of qw."""
    g = grid(spark, d).where("v > -50000").select("x", "y", (1 + F.col("v") / 50000).alias("z"))
    q = texture.surface_frames(g, [], (18.0, 18.0, 11.5, 12.0))
    return q.select("x", "y", F.round(4 * F.col("qw") * F.col("qw"), 5).alias("trace"))


@query("edited_splats", "WITH s AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE))+0.01 a, abs(CAST(embedding[2] AS DOUBLE))+0.01 b, abs(CAST(embedding[3] AS DOUBLE))+0.01 c, embedding[4]::DOUBLE w, embedding[5]::DOUBLE x, embedding[6]::DOUBLE y, embedding[7]::DOUBLE z FROM embeddings), n AS (SELECT *, w*w+x*x+y*y+z*z q FROM s) SELECT vec_id, round(a*a*(1+3*pow(1-2*(y*y+z*z)/q,2))+b*b*(1+3*pow(2*(x*y-z*w)/q,2))+c*c*(1+3*pow(2*(x*z+y*w)/q,2)),6) spread, round(4*a*a*b*b*c*c,9) volume FROM n")
def edited_splats(spark, d):
    """A stretch along one axis and a turn: the sum and the product of the squared scales are the mapped covariance's trace and determinant; a test has the axes."""
    e = table(spark, d, "embeddings")
    v = lambda i: F.col("embedding")[i].cast("double")
    n = F.sqrt(sum((v(i) * v(i) for i in range(4, 7)), v(3) * v(3)))
    s = e.select("vec_id", F.array(*[F.abs(v(i)) + 0.01 for i in range(3)]).alias("scale"), F.array(*[v(i) / n for i in range(3, 7)]).alias("turn"))
    out = texture.edited_splats(s, "vec_id", [2.0, 0.0, 0.0, 0.0, 0.6, -0.8, 0.0, 0.8, 0.6])
    s = [F.col("scale")[i] * F.col("scale")[i] for i in range(3)]
    return out.select("vec_id", r6(s[0] + s[1] + s[2]).alias("spread"), F.round(s[0] * s[1] * s[2], 9).alias("volume"))


@query("splat_starts", "SELECT vec_id, round(a,6) a, round(ln(greatest(0.08*least(exp(a),exp(b)),5e-4)),6) c, round(ln(o/(1-o)),6) opacity FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE)*9-4 a, CAST(embedding[2] AS DOUBLE)*9-4 b, greatest(1e-4,least(1-1e-4,0.45*greatest(0,least(1,CAST(embedding[3] AS DOUBLE)*5)))) o FROM embeddings)")
def splat_starts(spark, d):
    """Flat scales and first opacities."""
    v = lambda i: F.col("embedding")[i].cast("double")
    e = table(spark, d, "embeddings").select("vec_id", F.array(v(0) * 9 - 4, v(1) * 9 - 4, F.lit(0.0)).alias("s"), (v(2) * 5).alias("o")).withColumn("f", texture.flat_scales("s"))
    return e.select("vec_id", r6(F.col("f")[0]).alias("a"), r6(F.col("f")[2]).alias("c"), r6(texture.first_opacity(F.col("o"))).alias("opacity"))


@query("renumbered_mesh", f"{TRIS}, k AS (SELECT * FROM t WHERE tid%3=0), used AS (SELECT a v FROM k UNION SELECT b FROM k UNION SELECT c FROM k), n AS (SELECT v, row_number() OVER (ORDER BY v)-1 i FROM used) SELECT tid, x.i a, y.i b, z.i c FROM k JOIN n x ON x.v=k.a JOIN n y ON y.v=k.b JOIN n z ON z.v=k.c")
def renumbered_mesh(spark, d):
    """A third of the triangles, their vertices numbered anew."""
    t, v = sheet(spark, d)
    return texture.renumbered(t.where("tid % 3 = 0"), v)[0].select("tid", *[F.col(c).cast("long").alias(c) for c in "abc"])


@query("point_information", f"SELECT label, count(*) n, round(sum(y*y+z*z),6) xx, round(sum(-x*y),6) xy, round(sum(x*x+y*y),6) zz, round(sum(z),6) sz FROM ({P}) GROUP BY 1")
def point_information(spark, d):
    """The information of an edge from its matched points, four of its entries."""
    m = texture.information(points(spark, d), "label")
    at = [(i, j) for i in range(6) for j in range(i, 6)]
    pick = lambda i, j: r6(F.col("m")[at.index((i, j))])
    return m.select("label", "n", pick(3, 3).alias("xx"), pick(3, 4).alias("xy"), pick(5, 5).alias("zz"), pick(0, 4).alias("sz"))


@query("axis_conversions", f"SELECT vec_id, round(x,6) x, round(-y,6)+0.0 y, round(z,6) z, round(-x,6)+0.0 mx, round(y,6) ey, round(-z,6)+0.0 ez FROM ({P})")
def axis_conversions(spark, d):
    """Y down to y up, a mirrored display, and a left-handed engine's axes: products with signs."""
    p = points(spark, d)
    s = {"x": ("x", 1), "y": ("y", -1), "z": ("z", 1), "mx": ("x", -1), "ey": ("y", 1), "ez": ("z", -1)}
    return p.select("vec_id", *[(r6(F.col(c) * k) + 0.0).alias(n) for n, (c, k) in s.items()])


@query("fragment_clouds", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 i, count(*) OVER (PARTITION BY label) cnt FROM ({P})), k AS (SELECT * FROM n WHERE cnt<=40 OR i IN (SELECT q*(cnt-1)//39 FROM range(40) r(q))), v AS (SELECT label, kx, ky, kz, avg(x) x, avg(y) y, avg(z) z FROM (SELECT *, {KEYS} FROM k) GROUP BY 1,2,3,4) SELECT kx, ky, kz, count(*) n, round(avg(x),6) x, round(avg(y),6) y, round(avg(z),6) z FROM (SELECT label, x, y, z, {KEYS} FROM v) GROUP BY 1,2,3")
def fragment_clouds(spark, d):
    """Of each keyframe (label) at most 40 points evenly, one a voxel; their union, one a voxel again."""
    kept = rel.evenly_spaced(points(spark, d), ["vec_id"], 40, "label")
    each = keyed(kept).groupBy("label", "kx", "ky", "kz").agg(*[F.avg(c).alias(c) for c in "xyz"])
    return keyed(each.select("label", "x", "y", "z")).groupBy("kx", "ky", "kz").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in "xyz"])


@query("manual_overrides", "SELECT c_custkey, coalesce(o.x, c_acctbal) x, o.x IS NOT NULL manual FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) x FROM orders WHERE o_orderstatus='F' GROUP BY 1) o ON o_custkey=c_custkey")
def manual_overrides(spark, d):
    """What is set by hand before what was computed."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("h"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("h", "c_acctbal").alias("x"), F.col("h").isNotNull().alias("manual"))


@query("content_fingerprints", "SELECT source, CAST(sum(n) AS BIGINT) n, substr(sha256(string_agg(h,'' ORDER BY b)),1,16) fp FROM (SELECT source, doc_id//1048576 b, count(*) n, sha256(string_agg(h,'' ORDER BY doc_id)) h FROM (SELECT source, doc_id, sha256(coalesce(text,'')||'|'||coalesce(lang,'')) h FROM documents) GROUP BY 1,2) GROUP BY 1")
def content_fingerprints(spark, d):
    """One digest over the digests of a set's parts in order, by ranges of a million ids first."""
    x = table(spark, d, "documents").select("source", "doc_id", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit(""))), 256).alias("h"))
    over = lambda k: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda p: p["h"]), ""), 256)
    ranges = x.groupBy("source", F.expr("doc_id div 1048576").alias("b")).agg(F.count("*").alias("n"), over("doc_id").alias("h"))
    return ranges.groupBy("source").agg(F.sum("n").alias("n"), F.substring(over("b"), 1, 16).alias("fp"))


@query("intrinsics", f"SELECT label, count(*) n, round(max(x)*1000,4) fx, round(max(y)*1000,4) fy FROM ({P}) GROUP BY 1")
def intrinsics(spark, d):
    """The lens from a calibration matrix of nine numbers."""
    k = F.array(F.max("x") * 1000, F.lit(0.0), F.lit(320.0), F.lit(0.0), F.max("y") * 1000, F.lit(240.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    m = points(spark, d).groupBy("label").agg(F.count("*").alias("n"), k.alias("k"))
    return m.select("label", "n", F.round(F.col("k")[0], 4).alias("fx"), F.round(F.col("k")[4], 4).alias("fy"))


UN = "SELECT x, y, a*(1+q*(0.1+q*-0.02))+2*0.004*a*b-0.002*(q+2*a*a) a, b*(1+q*(0.1+q*-0.02))+0.004*(q+2*b*b)-2*0.002*a*b b FROM (SELECT x, y, (x-11.5)/30 a, (y-12.5)/30 b, ((x-11.5)/30)**2+((y-12.5)/30)**2 q FROM range(24) i(x), range(26) j(y))"


@query("undistorted_raster", f"WITH s AS (SELECT x, y, a*30+11.5 u, b*30+12.5 w FROM ({UN})) SELECT s.x, s.y, round(sum((CASE WHEN i=1 THEN u-floor(u) ELSE 1-(u-floor(u)) END)*(CASE WHEN j=1 THEN w-floor(w) ELSE 1-(w-floor(w)) END)*r.v),5) v FROM s, (VALUES (0,0),(0,1),(1,0),(1,1)) q(i,j), ({R}) r WHERE r.x=least(floor(u)+i,23) AND r.y=least(floor(w)+j,25) AND u BETWEEN 0 AND 23 AND w BETWEEN 0 AND 25 GROUP BY 1,2 HAVING count(*)=4")
def undistorted_raster(spark, d):
    """The raster without its lens's distortion, and with that the mask of what is valid."""
    r = raster(spark, d).withColumn("f", F.lit(0))
    return texture.undistorted(r, "f", (24, 26), (30.0, 30.0, 11.5, 12.5), (0.1, -0.02, 0.0), (0.004, -0.002), ["v"]).select("x", "y", F.round("v", 5).alias("v"))


@query("mirrored_mesh", f"{TRIS} SELECT tid, a, c b, b c FROM t")
def mirrored_mesh(spark, d):
    """A mirrored mesh has its winding turned round."""
    t, v = sheet(spark, d)
    return texture.transformed_mesh(t, v, [-1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0])[0].select("tid", "a", "b", "c")


@query("frame_seeds")
def frame_seeds(spark, d):
    """Seeds of the raster as a frame; a test has a flat wall."""
    g = grid(spark, d)
    first = g.agg(F.min("y")).first()[0]
    px = g.select("x", (F.col("y") - first).alias("y"), (1 + F.col("v") / 50000).alias("z"), "v")
    s = texture.seeds(px, (18.0, 18.0, 11.5, 12.0), 8, 2, 10_000.0)
    return s.select("x", "y", *[r6(F.col(c)).alias(c) for c in ("z", "scale_x", "scale_z", "qw")])
