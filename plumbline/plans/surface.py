"""Queries of triangles, level sets, poses and recovery; the sheet's depths are the raster of `events`."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.operators import poses, surface
from plumbline.operators import relational as rel
from plumbline.operators.graph import scratch
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import G, events, grid, take
from plumbline.plans.points import P, points
from plumbline.streaming.recovery import FRAME, relocalising_tracker

GAP = "greatest({0})-least({0})<=greatest(120,0.5*least({0}))"
SHEET = (
    f"WITH RECURSIVE g AS (SELECT * FROM ({G}) WHERE v>0), sheet AS ("
    f"SELECT a.x, a.y, 0 AS half FROM g a JOIN g b ON b.x=a.x AND b.y=a.y+1 JOIN g c ON c.x=a.x+1 AND c.y=a.y WHERE {GAP.format('a.v,b.v,c.v')} "
    f"UNION ALL SELECT b.x, c.y, 1 FROM g b JOIN g d ON d.x=b.x+1 AND d.y=b.y JOIN g c ON c.x=b.x+1 AND c.y=b.y-1 WHERE {GAP.format('b.v,c.v,d.v')})"
)
TRIS = SHEET + (
    ", t AS (SELECT (CAST(y AS BIGINT)*24+x)*2+half AS tid, CASE half WHEN 0 THEN CAST(y AS BIGINT)*24+x ELSE (CAST(y AS BIGINT)+1)*24+x END a,"
    " (CAST(y AS BIGINT)+1)*24+x+half b, CAST(y AS BIGINT)*24+x+1 c FROM sheet), w AS (SELECT CAST(y AS BIGINT)*24+x AS vid, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, v/100 z FROM g)"
)
RIM = TRIS + (
    ", h AS (SELECT a u, b v FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT c, a FROM t), rim AS (SELECT min(u) u, min(v) v FROM h GROUP BY least(u,v), greatest(u,v) HAVING count(*)=1)"
    ", und AS (SELECT u, v FROM rim UNION SELECT v, u FROM rim), reach AS (SELECT u, u r FROM und UNION SELECT reach.u, und.v FROM reach JOIN und ON und.u=reach.r), part AS (SELECT u, min(r) m FROM reach GROUP BY 1)"
    ", deg AS (SELECT part.u, part.m, (SELECT count(*) FROM rim WHERE rim.u=part.u) o, (SELECT count(*) FROM rim WHERE rim.v=part.u) i FROM part), good AS (SELECT m FROM deg GROUP BY 1 HAVING bool_and(o=1 AND i=1))"
    ", walk AS (SELECT m lp, CAST(0 AS BIGINT) place, m vid FROM good UNION ALL SELECT lp, place+1, rim.v FROM walk JOIN rim ON rim.u=walk.vid WHERE rim.v<>lp)"
)


def sheet(spark, d):
    """Triangles and vertices of the raster of `events`."""
    g = grid(spark, d)
    t = surface.depth_sheet(g, [], z="v", jump=120.0, share=0.5)
    at = F.col("y").cast("long") * 24 + F.col("x")
    first = F.when(F.col("half") == 0, at).otherwise(at + 24)
    return t.select((at * 2 + F.col("half")).alias("tid"), first.alias("a"), (at + 24 + F.col("half")).alias("b"), (at + 1).alias("c")), g.where("v > 0").select(at.alias("vid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("v") / 100).alias("z"))


@query("depth_sheet", f"{TRIS} SELECT tid, a, b, c FROM t")
def depth_sheet(spark, d):
    """Two triangles a quad of neighbouring depths, none over a jump."""
    return sheet(spark, d)[0]


@query("vertex_normals", f"{TRIS}, f AS (SELECT t.a, t.b, t.c, p.x px, p.y py, p.z pz, q.x-p.x ux, q.y-p.y uy, q.z-p.z uz, r.x-p.x vx, r.y-p.y vy, r.z-p.z vz FROM t JOIN w p ON p.vid=t.a JOIN w q ON q.vid=t.b JOIN w r ON r.vid=t.c), n AS (SELECT unnest([a,b,c]) AS vid, uy*vz-uz*vy nx, uz*vx-ux*vz ny, ux*vy-uy*vx nz FROM f), s AS (SELECT vid, sum(nx) nx, sum(ny) ny, sum(nz) nz FROM n GROUP BY 1) SELECT vid, round(nx/sqrt(nx*nx+ny*ny+nz*nz),6) nx, round(ny/sqrt(nx*nx+ny*ny+nz*nz),6) ny, round(nz/sqrt(nx*nx+ny*ny+nz*nz),6) nz FROM s")
def vertex_normals(spark, d):
    """Normals of faces added up at their corners."""
    n = surface.vertex_normals(*sheet(spark, d))
    return n.select("vid", *[r6(F.col(c)).alias(c) for c in ("nx", "ny", "nz")])


@query("boundary_loops", f"{RIM} SELECT lp AS loop, place, vid FROM walk")
def boundary_loops(spark, d):
    """Closed rims in winding order."""
    return surface.boundary_loops(sheet(spark, d)[0])


@query("loop_metrics", f"{RIM}, q AS (SELECT lp, place, x-avg(x) OVER k x, y-avg(y) OVER k y, z-avg(z) OVER k z FROM walk JOIN w USING (vid) WINDOW k AS (PARTITION BY lp)), e AS (SELECT p.lp, p.x, p.y, p.z, n.x x2, n.y y2, n.z z2 FROM q p JOIN q n ON n.lp=p.lp AND n.place=(p.place+1)%(SELECT count(*) FROM q c WHERE c.lp=p.lp)), s AS (SELECT lp, count(*) n, sum(sqrt((x-x2)^2+(y-y2)^2+(z-z2)^2)) l, sum(y*z2-z*y2)/2 ax, sum(z*x2-x*z2)/2 ay, sum(x*y2-y*x2)/2 az FROM e GROUP BY 1) SELECT lp AS loop, n, round(l,6) perimeter, round(sqrt(ax*ax+ay*ay+az*az),6) area, round((SELECT sqrt(avg((q.x*ax+q.y*ay+q.z*az)^2)) FROM q WHERE q.lp=s.lp)/sqrt(ax*ax+ay*ay+az*az),6) rms FROM s")
def loop_metrics(spark, d):
    """Perimeter, vector area and distance from the plane of closed rims."""
    t, v = sheet(spark, d)
    m = surface.loop_metrics(surface.boundary_loops(t), v)
    return m.select("loop", "n", *[r6(F.col(c)).alias(c) for c in ("perimeter", "area", "rms")])


@query("nonmanifold_vertices", f"{TRIS}, l AS (SELECT a AS vid, b p, c q FROM t UNION ALL SELECT b, c, a FROM t UNION ALL SELECT c, a, b FROM t), und AS (SELECT vid, p, q FROM l UNION SELECT vid, q, p FROM l), reach AS (SELECT vid, p, p r FROM und UNION SELECT reach.vid, reach.p, und.q FROM reach JOIN und ON und.vid=reach.vid AND und.p=reach.r), fan AS (SELECT vid, count(DISTINCT m) fans FROM (SELECT vid, p, min(r) m FROM reach GROUP BY 1,2) GROUP BY 1), spoke AS (SELECT vid, count(*) FILTER (n=1) spokes FROM (SELECT vid, o, count(*) n FROM (SELECT vid, p o FROM l UNION ALL SELECT vid, q FROM l) GROUP BY 1,2) GROUP BY 1) SELECT vid, fans, spokes FROM fan JOIN spoke USING (vid) WHERE fans>1 OR spokes NOT IN (0,2)")
def nonmanifold_vertices(spark, d):
    """Vertices where several fans of triangles meet."""
    return surface.nonmanifold_vertices(sheet(spark, d)[0])


LOOSE = "SELECT (l_orderkey%97*97+l_partkey%97)*97+l_suppkey%97 AS tid, l_orderkey%97 a, l_partkey%97 b, l_suppkey%97 c FROM lineitem"


@query("clean_triangles", f"WITH t AS (SELECT min(tid) AS tid, least(a,b,c) i, greatest(a,b,c) k, a+b+c-least(a,b,c)-greatest(a,b,c) j FROM ({LOOSE}) WHERE a<>b AND b<>c AND a<>c GROUP BY 2,3,4), f AS (SELECT tid, q.x-p.x ux, q.y-p.y uy, q.z-p.z uz, r.x-p.x vx, r.y-p.y vy, r.z-p.z vz FROM t JOIN ({P}) p ON p.vec_id=i JOIN ({P}) q ON q.vec_id=j JOIN ({P}) r ON r.vec_id=k) SELECT tid, round(sqrt((uy*vz-uz*vy)^2+(uz*vx-ux*vz)^2+(ux*vy-uy*vx)^2)/2,6) area FROM f WHERE sqrt((uy*vz-uz*vy)^2+(uz*vx-ux*vz)^2+(ux*vy-uy*vx)^2)/2>=0.02")
def clean_triangles(spark, d):
    """no degenerate, repeated or tiny triangles."""
    a, b, c = (F.col(n).cast("long") % 97 for n in ("l_orderkey", "l_partkey", "l_suppkey"))
    t = table(spark, d, "lineitem").select(((a * 97 + b) * 97 + c).alias("tid"), a.alias("a"), b.alias("b"), c.alias("c"))
    v = points(spark, d).select(F.col("vec_id").alias("vid"), "x", "y", "z")
    return surface.clean_triangles(t, v, 0.02).select("tid", r6(F.col("area")).alias("area"))


VOXELS = "SELECT CAST(l_quantity AS BIGINT) kx, CAST(l_linenumber AS BIGINT) ky, CAST(round(l_discount*100) AS BIGINT) kz, avg(CAST(l_tax AS DOUBLE))-0.0401 s FROM lineitem GROUP BY 1,2,3 HAVING count(*)>=3"


def voxels(spark, d):
    """A lattice of quantity, line number and discount, the mean tax its signed distance; cells of weight 3 and more."""
    key = [F.col("l_quantity").cast("long").alias("kx"), F.col("l_linenumber").cast("long").alias("ky"), F.round(F.col("l_discount") * 100).cast("long").alias("kz")]
    v = table(spark, d, "lineitem").groupBy(*key).agg((F.avg(F.col("l_tax").cast("double")) - 0.0401).alias("sdf"), F.count("*").alias("weight"))
    return v.where("weight >= 3")


CUBE = ", ".join(f"max(CASE WHEN n={n} THEN s END) s{n}" for n in range(8))
EIGHT = " UNION ALL ".join(f"SELECT kx-{n >> 2 & 1} kx, ky-{n >> 1 & 1} ky, kz-{n & 1} kz, {n} n, s FROM v" for n in range(8))
INSIDE = " UNION ALL ".join("SELECT kx, ky, kz, " + "+".join(f"CAST(s{n}<0 AS BIGINT)" for n in t) + " i FROM c" for t in surface.TETRAHEDRA)


@query("level_set_cells", f"WITH v AS ({VOXELS}), c AS (SELECT kx, ky, kz, {CUBE} FROM ({EIGHT}) GROUP BY 1,2,3 HAVING count(*)=8), i AS ({INSIDE}) SELECT kx, ky, kz, CAST(sum(CASE i WHEN 2 THEN 2 ELSE 1 END) AS BIGINT) triangles FROM i WHERE i BETWEEN 1 AND 3 GROUP BY 1,2,3")
def level_set_cells(spark, d):
    """How many triangles the surface has in each cube."""
    return surface.level_set(voxels(spark, d)).groupBy("kx", "ky", "kz").agg(F.count("*").alias("triangles"))


@query("level_set_mesh")
def level_set_mesh(spark, d):
    """The surface itself; a test holds a sphere against its area, volume and closedness."""
    return surface.level_set(voxels(spark, d))


@query("similarity_fit", f"SELECT CAST(1.7 AS DOUBLE) AS scale, CAST(0.3 AS DOUBLE) sx, CAST(-0.2 AS DOUBLE) sy, CAST(0.9 AS DOUBLE) sz, count(*) inliers FROM ({P}) WHERE vec_id%7<>0")
def similarity_fit(spark, d):
    """A planted similarity with every seventh point astray; the fit finds it and the points that follow it."""
    a, s = math.radians(25.0), 1.7
    c = {n: F.col(n) for n in "xyz"}
    q = [s * (math.cos(a) * c["x"] - math.sin(a) * c["y"]) + 0.3, s * (math.sin(a) * c["x"] + math.cos(a) * c["y"]) - 0.2, s * c["z"] + 0.9]
    astray = F.when(F.col("vec_id") % 7 == 0, 1.0 + F.col("vec_id") % 3).otherwise(0.0)
    pairs = points(spark, d).select(F.array("x", "y", "z").alias("p1"), F.array(q[0] + astray, q[1] - astray, q[2]).alias("p2"))
    scale, _, shift, rows = poses.similarity_fit(pairs)
    return rows.agg(F.count_if("inlier").alias("inliers")).select(*[F.lit(round(float(x), 6)).alias(n) for x, n in zip((scale, *shift), ("scale", "sx", "sy", "sz"))], "inliers")


def _turned(angle, x, y, z):
    """4 x 4 numbers of a turn about z and a shift."""
    c, s = F.cos(angle), F.sin(angle)
    o, i = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, o, x, s, c, o, y, o, o, i, z, o, o, o, i)


@query("pose_graph")
def pose_graph(spark, d):
    """G1: fragments of takes chained by turns that drift, tied by closures of which some are wrong; a test holds it against planted poses."""
    frames = events(spark, d).select("user_id", "t", "event_id", F.row_number().over(take()).alias("frame"))
    n = rel.fragments(frames, "user_id", ["t", "event_id"]).groupBy("user_id", F.col("fragment").alias("k")).agg((F.avg(F.sin(F.col("user_id") + F.col("frame"))) / 200).alias("drift"))
    i, drift = F.col("k").cast("long"), F.col("drift")
    steps = n.where("k > 0").select("user_id", i.alias("node"), _turned(F.lit(math.radians(15.0)) + drift, F.lit(0.4), drift, F.lit(0.0)).alias("step"))
    far = n.where("k > 8 AND k % 4 = 0")
    wrong = F.when((F.col("user_id") + i) % 5 == 0, 3.0).otherwise(0.0)
    ties = 8 * math.radians(15.0)  # eight steps of a regular polygon
    x, y = (0.4 * sum(f(math.radians(15.0) * k) for k in range(8)) for f in (math.cos, math.sin))
    loops = far.select("user_id", (i - 8).alias("i"), i.alias("j"), _turned(F.lit(ties), F.lit(x) + wrong, F.lit(y), F.lit(0.0)).alias("step"), F.lit(5.0).alias("weight"))
    found = poses.pose_graph(steps, loops, "user_id")
    return found.select("user_id", "node", *[F.round(F.col("pose")[k], 4).alias(c) for k, c in ((3, "x"), (7, "y"))], "rejected")


@query("relocalising_tracker")
def relocalising(spark, d):
    """T4 to T8 on a stream: takes of `events` that lose track and come back; tests hold the states against cases worked out by hand."""
    home = scratch(spark, "recovery")
    r = events(spark, d).select("user_id", "t", "value", F.row_number().over(take()).cast("long").alias("sequence"))
    still = _turned(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    moved = _turned(F.lit(0.0), F.lit(0.03), F.lit(0.0), F.lit(0.0))
    good = F.pmod("sequence", F.lit(11)) < 6

    def candidate(kind, anchor, step, overlap, inliers):
        return F.struct(F.lit(kind).alias("kind"), anchor.cast("long").alias("anchor"), step.alias("step"), overlap.alias("overlap"), F.lit(inliers).alias("inliers"), F.lit(0.01).alias("rmse"))

    shown = F.array(
        candidate("previous", F.lit(None), moved, F.when(good, 0.9).otherwise(0.1), 0.95),
        candidate("anchor", F.lit(1), still, F.when(F.pmod("sequence", F.lit(11)) > 7, 0.8).otherwise(0.1), 0.95),
    )
    r.select("user_id", "sequence", (F.col("sequence") * 100_000).alias("t_us"), F.lit(None).cast("array<double>").alias("gyro"), shown.alias("candidates")).write.parquet(f"{home}/in")
    frames = spark.readStream.schema(f"user_id long, {FRAME}").parquet(f"{home}/in")
    run = relocalising_tracker(frames, "user_id").writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out").select("user_id", "sequence", "state", "integrated", "anchor", "reason")
