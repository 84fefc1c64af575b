"""Queries of motion, depth correspondence and frame schedules; `events` of a user are a take, `embeddings` are views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import motion
from plumbline.operators import relational as rel
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, O, G, events, grid, take
from plumbline.plans.points import P, points

HOUR = 3_600_000_000


@query("gyro_prior", f"WITH e AS ({E}), w AS (SELECT DISTINCT user_id, t//(24*{HOUR})*24*{HOUR} b FROM e), s AS (SELECT w.user_id, w.b, e.t, e.event_id, e.value/1e6 r FROM w JOIN e ON e.user_id=w.user_id AND e.t BETWEEN w.b AND w.b+24*{HOUR}), l AS (SELECT *, lag(t,1,b) OVER q p, coalesce(lag(r) OVER q,r) pr, lead(t) OVER q nx, count(*) OVER (PARTITION BY user_id,b) n FROM s WINDOW q AS (PARTITION BY user_id,b ORDER BY t,r)), a AS (SELECT user_id, b, max(n) n, max(greatest(t-p, CASE WHEN nx IS NULL THEN b+24*{HOUR}-t ELSE 0 END)) g, sum((r+pr)/2*(t-p)/1e6+CASE WHEN nx IS NULL THEN r*(b+24*{HOUR}-t)/1e6 ELSE 0 END) rad FROM l GROUP BY 1,2) SELECT user_id, b, CASE WHEN n>=2 AND g<=12*{HOUR} AND degrees(acos(cos(rad)))<=65 THEN round(degrees(acos(cos(rad))),5) END angle, CASE WHEN n>=2 AND g<=12*{HOUR} AND degrees(acos(cos(rad)))<=65 THEN round(sin(rad),6) END turn FROM a")
def gyro_prior(spark, d):
    """Days as windows, values as rates about z; about one axis the product of rotations is a sum of angles. Tests have other axes."""
    e = events(spark, d)
    w = e.select("user_id", (F.floor(F.col("t") / (24 * HOUR)) * 24 * HOUR).alias("b")).distinct().withColumn("e", F.col("b") + 24 * HOUR)
    samples = e.select("user_id", "t", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("value") / 1e6).alias("z"))
    found = motion.gyro_prior(samples, w, "user_id", "t", "b", "e", 24 * HOUR, 12 * HOUR, 65.0, 24 * HOUR)
    return found.select("user_id", "b", F.round("angle", 5).alias("angle"), r6(F.col("rotation")[1]).alias("turn"))


@query("captured_trajectory", f"WITH s AS (SELECT user_id, t, sqrt(pow((value-lag(value) OVER w)*10,2)+pow((event_id-lag(event_id) OVER w)/10.0,2)) m, degrees(acos(cos(radians(value-lag(value) OVER w)))) g, greatest((t-lag(t) OVER w)/1e6,1/30) dt FROM ({E}) WINDOW w AS ({O})), a AS (SELECT user_id, count(*) frames, coalesce(sum(m),0) path, coalesce(max(m/dt),0) ps, coalesce(max(g/dt),0) pt, coalesce(sum(m),0)/greatest((max(t)-min(t))/1e6,0.1) ms FROM s GROUP BY 1) SELECT user_id, frames, round(path,4) path, round(ms,6) mean_speed, round(ps,6) peak_speed, round(pt,5) peak_turn, ps<=2.4 AND ms<=0.02 AND pt<=190 sound, CAST(greatest(65,round_even(96-12*least(ps/2.4,1)-8*least(ms/0.02,1)-5*least(pt/190,1),0)) AS INTEGER) confidence FROM a")
def captured_trajectory(spark, d):
    """a pose turned about z by the value's degrees, at ten times the value and a tenth of the number."""
    v, a = F.col("value"), F.radians("value")
    rows = [[F.cos(a), -F.sin(a), F.lit(0.0), v * 10], [F.sin(a), F.cos(a), F.lit(0.0), F.col("event_id") / 10.0], [*map(F.lit, (0.0, 0.0, 1.0, 0.0))], [*map(F.lit, (0.0, 0.0, 0.0, 1.0))]]
    e = events(spark, d).withColumn("pose", F.array(*[c for r in rows for c in r]))
    found = motion.captured_trajectory(e, "user_id", ["t", "event_id"], "t", "pose", most_mean=0.02)
    return found.select("user_id", "frames", F.round("path", 4).alias("path"), r6("mean_speed").alias("mean_speed"), r6("peak_speed").alias("peak_speed"), F.round("peak_turn", 5).alias("peak_turn"), "sound", "confidence")


DEPTH = f"SELECT y//8 f, x, y%8 r, 1+v/50000 depth FROM ({G})"
MOVED = f"SELECT f+1 f, x, r, (x-11.5)*depth/18+0.05 mx, (r-3.5)*depth/18-0.02 my, depth+0.03 z FROM ({DEPTH})"
MATCHED = f"SELECT m.*, t.depth seen FROM (SELECT *, CAST(round_even(18*mx/z+11.5,0) AS BIGINT) u, CAST(round_even(18*my/z+3.5,0) AS BIGINT) w FROM ({MOVED}) WHERE z>0.05) m LEFT JOIN ({DEPTH}) t ON t.f=m.f AND t.x=m.u AND t.r=m.w WHERE u BETWEEN 0 AND 23 AND w BETWEEN 0 AND 7"


def correspondences(spark, d):
    """Eight days of the raster are a depth frame; each meets the one after it under a small motion."""
    g = grid(spark, d).select(F.expr("y div 8").alias("f"), "x", (F.col("y") % 8).alias("r"), (1 + F.col("v") / 50000).alias("depth"))
    shift = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.05, 0.0, 1.0, 0.0, -0.02, 0.0, 0.0, 1.0, 0.03, 0.0, 0.0, 0.0, 1.0)))
    source = g.withColumn("f", F.col("f") + 1)
    return source, motion.depth_correspondences(source, g, ["f"], "x", "r", "depth", shift, (18.0, 18.0, 11.5, 3.5), (24, 8))


@query("projective_support", f"SELECT f, x, r, coalesce(abs(seen-z)<=greatest(0.035,0.02*z),FALSE) support FROM ({MATCHED})")
def projective_support(spark, d):
    """J10."""
    _, found = correspondences(spark, d)
    return found.select("f", "x", "r", motion.projective_support(found).alias("support"))


@query("depth_alignment", f"WITH s AS (SELECT f+1 f, count(*) samples FROM ({DEPTH}) GROUP BY 1), m AS (SELECT f, count(seen) matched, count(*) FILTER (abs(seen-z)<=0.1) i, sqrt(avg(CASE WHEN abs(seen-z)<=0.1 THEN (seen-z)*(seen-z) END)) rmse FROM ({MATCHED}) GROUP BY 1), q AS (SELECT f, samples, coalesce(matched,0) matched, coalesce(matched,0)/samples ov, CASE WHEN matched>0 THEN i/matched ELSE 0 END inl, rmse FROM s LEFT JOIN m USING (f)) SELECT f, samples, matched, round(ov,6) AS overlap, round(inl,6) inliers, round(rmse,6) rmse, CASE WHEN samples<40 THEN 'too few samples' WHEN matched<20 THEN 'too little overlap with the target' WHEN ov<0.28 THEN 'low overlap' WHEN inl<0.65 THEN 'low agreement' WHEN coalesce(rmse>0.062,TRUE) THEN 'high residual' ELSE 'accepted' END reason FROM q")
def depth_alignment(spark, d):
    """J11, A10, F6."""
    source, found = correspondences(spark, d)
    q = motion.alignment_quality(found, source, ["f"], 0.1, 40)
    return q.select("f", "samples", "matched", r6("overlap").alias("overlap"), r6("inliers").alias("inliers"), r6("rmse").alias("rmse"), "reason")


VIEW = f"SELECT vec_id, label, x, y, z, c/l c, f/l f FROM (SELECT *, greatest(sqrt(c*c+f*f),1e-9) l FROM ({P}))"


@query("view_neighbours", f"SELECT vec_id, ref, rank, round(score,6) score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score,9), ref) AS rank FROM (SELECT a.vec_id, b.vec_id AS ref, d+0.35*(1-dot)+CASE WHEN same THEN least(gap,1000)*1e-4-0.25 ELSE 0 END score, d, dot FROM (SELECT a.vec_id, b.vec_id bid, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) d, greatest(-1,least(1,a.c*b.c+a.f*b.f)) dot, a.label//4=b.label//4 same, abs(a.vec_id-b.vec_id) gap FROM ({VIEW}) a JOIN ({VIEW}) b ON a.label=b.label AND a.vec_id<>b.vec_id) a JOIN (SELECT vec_id FROM embeddings) b ON a.bid=b.vec_id WHERE NOT (d<0.012 AND dot>0.9999))) WHERE rank<=4")
def view_neighbours(spark, d):
    """The four nearest views by the view score; a label is a project of one phase."""
    length = F.greatest(F.sqrt(F.col("c") * F.col("c") + F.col("f") * F.col("f")), F.lit(1e-9))
    v = points(spark, d).withColumn("phase", F.expr("label div 4")).withColumns({"c": F.col("c") / length, "f": F.col("f") / length})
    found = motion.view_neighbours(v, "label", "vec_id", "phase", "vec_id", ["x", "y", "z"], ["c", "f"])
    return found.select("vec_id", "ref", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query("pair_scales", f"SELECT label, count(*) FILTER (s>1e-6 AND t>1e-6) pairs, round(coalesce(median(CASE WHEN s>1e-6 AND t>1e-6 THEN t/s END),1),6) scale FROM (SELECT label, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2+(z-lag(z) OVER w)**2) s, sqrt((y-lag(y) OVER w)**2+(c-lag(c) OVER w)**2+(f-lag(f) OVER w)**2) t FROM ({P}) WINDOW w AS (PARTITION BY label ORDER BY vec_id)) GROUP BY 1")
def pair_scales(spark, d):
    """A44."""
    return motion.pair_scales(points(spark, d), "label", "vec_id", ["x", "y", "z"], ["y", "c", "f"]).select("label", "pairs", r6("scale").alias("scale"))


@query("due_rows", f"WITH RECURSIVE e AS ({E}), s AS (SELECT user_id, min(t) t FROM e GROUP BY 1 UNION ALL SELECT s.user_id, (SELECT min(e.t) FROM e WHERE e.user_id=s.user_id AND e.t>=s.t+10*{HOUR}) FROM s WHERE (SELECT min(e.t) FROM e WHERE e.user_id=s.user_id AND e.t>=s.t+10*{HOUR}) IS NOT NULL) SELECT user_id, t FROM s")
def due_rows(spark, d):
    """Evaluated at most once in ten hours."""
    return motion.due_rows(events(spark, d).select("user_id", "t"), "user_id", "t", 10 * HOUR)


@query("phase_neighbours", f"SELECT lag(event_id) OVER ({O}) a, event_id b FROM ({E}) QUALIFY lag(event_type) OVER ({O})=event_type")
def phase_neighbours(spark, d):
    """Consecutive frames of one phase (the kind of event)."""
    w = take()
    x = events(spark, d).select(F.lag("event_id").over(w).alias("a"), F.col("event_id").alias("b"), F.lag("event_type").over(w).alias("was"), "event_type")
    return x.where("was = event_type").select("a", "b")


@query("depth_overrides", "SELECT o_orderkey, l_linenumber, coalesce(r.p, 'raw') depth, r.p IS NOT NULL refined, concat_ws(':',o_orderkey,l_linenumber) key FROM (SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey=o_orderkey WHERE o_orderstatus<>'P') LEFT JOIN (SELECT l_orderkey, l_linenumber k, max(l_shipdate)::DATE::VARCHAR p FROM lineitem WHERE l_returnflag='R' GROUP BY 1,2) r ON r.l_orderkey=o_orderkey AND r.k=l_linenumber")
def depth_overrides(spark, d):
    """Frames of the phases that are there, with the refined depth if one is kept under their key, else the raw one."""
    line = table(spark, d, "lineitem")
    known = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    frames = line.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(known, "o_orderkey")
    refined = line.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.max(F.col("l_shipdate").cast("date")).cast("string").alias("p"))
    x = frames.join(refined, ["o_orderkey", "l_linenumber"], "left")
    return x.select("o_orderkey", "l_linenumber", F.coalesce("p", F.lit("raw")).alias("depth"), F.col("p").isNotNull().alias("refined"), F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))


@query("native_or_aligned", "SELECT doc_id, CASE WHEN quality=1 THEN 'native' ELSE 'aligned' END image, CASE WHEN quality=1 THEN 1920 ELSE 640 END width, quality=1 IS TRUE AND quality IS NOT NULL calibrated FROM documents LEFT JOIN labels USING (doc_id)")
def native_or_aligned(spark, d):
    """The native image with its camera and transform if there is one, else the aligned image with the depth camera and none: all three together."""
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    native = F.when(F.col("quality") == 1, F.struct(F.lit("native").alias("image"), F.lit(1920).alias("width"), F.lit(True).alias("calibrated")))
    both = F.coalesce(native, F.struct(F.lit("aligned").alias("image"), F.lit(640).alias("width"), F.lit(False).alias("calibrated")))
    return x.select("doc_id", both.alias("s")).select("doc_id", "s.*")


@query("progress_eta", f"SELECT event_id, round(i/n,4) progress, CASE WHEN i>1 AND i<n THEN greatest(0,CAST(round_even(el*(1-i/n)/(i/n),0) AS BIGINT)) END eta, CAST(sum(el-pe) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS BIGINT) stage_seconds FROM (SELECT *, row_number() OVER ({O})::DOUBLE i, count(*) OVER (PARTITION BY user_id) n, floor((t-min(t) OVER (PARTITION BY user_id))/1e6) el, coalesce(floor((lag(t) OVER ({O})-min(t) OVER (PARTITION BY user_id))/1e6),0) pe FROM ({E}))")
def progress_eta(spark, d):
    """Progress, what is left at the mean pace, and the time that each stage has taken so far."""
    w, all_ = take(), Window.partitionBy("user_id")
    x = events(spark, d).select("event_id", "user_id", "event_type", "t", F.row_number().over(w).cast("double").alias("i"), F.count("*").over(all_).alias("n"), F.floor((F.col("t") - F.min("t").over(all_)) / 1e6).alias("el"))
    x = x.withColumn("pe", F.coalesce(F.lag("el").over(w), F.lit(0)))
    share = F.col("i") / F.col("n")
    stage = F.sum(F.col("el") - F.col("pe")).over(Window.partitionBy("user_id", "event_type").orderBy("t", "event_id"))
    eta = F.when((F.col("i") > 1) & (F.col("i") < F.col("n")), F.greatest(F.lit(0).cast("long"), F.rint(F.col("el") * (1 - share) / share).cast("long")))
    return x.select("event_id", F.round(share, 4).alias("progress"), eta.alias("eta"), stage.alias("stage_seconds"))


@query("dense_numbers", f"SELECT event_id, row_number() OVER ({O})-1 number FROM ({E}) WHERE event_type<>'error'")
def dense_numbers(spark, d):
    """What is left of a take, numbered anew from 0."""
    x = events(spark, d).where("event_type <> 'error'")
    return x.select("event_id", (F.row_number().over(take()) - 1).cast("long").alias("number"))


@query("frame_schedule", f"WITH e AS ({E}), g AS (SELECT user_id, unnest(range(0, (max(t)-min(t))//(24*{HOUR})+1)) k, min(t) t0 FROM e GROUP BY user_id), s AS (SELECT user_id, CAST(round_even((t-t0)/(24.0*{HOUR}),0) AS BIGINT) k, event_id, abs((t-t0)-CAST(round_even((t-t0)/(24.0*{HOUR}),0) AS BIGINT)*24*{HOUR}) off_us FROM (SELECT *, min(t) OVER (PARTITION BY user_id) t0 FROM e) WHERE event_type='purchase'), m AS (SELECT user_id, k, arg_min(event_id,(off_us,event_id)) event_id FROM s GROUP BY 1,2) SELECT g.user_id, g.k, m.event_id FROM g LEFT JOIN m ON m.user_id=g.user_id AND m.k=g.k")
def frame_schedule(spark, d):
    """A daily grid over each take; a slot that a chosen frame (a purchase) is nearest to is that frame's."""
    day = 24 * HOUR
    e = events(spark, d).withColumn("t0", F.min("t").over(Window.partitionBy("user_id")))
    span = e.groupBy("user_id").agg(F.max(F.col("t") - F.col("t0")).alias("s"))
    slots = span.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"s div {day}"))).alias("k"))
    k = F.rint((F.col("t") - F.col("t0")) / float(day)).cast("long")
    own = e.where("event_type = 'purchase'").withColumn("k", k).withColumn("off", F.abs(F.col("t") - F.col("t0") - F.col("k") * day))
    return slots.join(own.groupBy("user_id", "k").agg(F.min_by("event_id", F.struct("off", "event_id")).alias("event_id")), ["user_id", "k"], "left")


@query("required_or_sampled", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 i, count(*) OVER () n FROM documents), s AS (SELECT doc_id FROM n JOIN (SELECT DISTINCT k*(t-1)//127 i FROM (SELECT unnest(range(128)) k, count(*) t FROM documents) ) USING (i)) SELECT doc_id FROM s UNION SELECT doc_id FROM labels WHERE toxic=1 AND doc_id IN (SELECT doc_id FROM documents)")
def required_or_sampled(spark, d):
    """128 evenly spaced rows, and all that are flagged."""
    docs = table(spark, d, "documents").select("doc_id")
    flagged = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return rel.evenly_spaced(docs, ["doc_id"], 128).unionByName(docs.join(flagged, "doc_id", "left_semi")).distinct()


@query("name_sets", "SELECT lang, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents b WHERE b.lang=a.lang) x FULL JOIN (SELECT DISTINCT source FROM documents c JOIN labels USING (doc_id) WHERE c.lang=a.lang) y ON x.source=y.source WHERE x.source IS NULL OR y.source IS NULL) differing FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) a")
def name_sets(spark, d):
    """Names that are only in one of two sets, by group; 0 means that the sets are equal, or, for a subset, that nothing is lost."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    every = docs.select("lang", "source").distinct().withColumn("a", F.lit(1))
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("lang", "source").distinct().withColumn("b", F.lit(1))
    return every.join(labelled, ["lang", "source"], "full").groupBy("lang").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("differing"))


@query("batch_union", "SELECT 'c' || c_custkey id, c_acctbal x, NULL::INTEGER size FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'p' || p_partkey, p_retailprice, p_size FROM part")
def batch_union(spark, d):
    """Batches of points, with what a batch lacks as null."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_acctbal").alias("x"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("x"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("size"))
    return c.unionByName(s).unionByName(p, allowMissingColumns=True)


@query("training_order", "WITH p AS (SELECT doc_id, lang IS NULL OR lang='en' metric, row_number() OVER (PARTITION BY lang IS NULL OR lang='en' ORDER BY md5('7:'||doc_id), doc_id)-1 i, count(*) OVER (PARTITION BY lang IS NULL OR lang='en') c FROM documents), g AS (SELECT max(c) g FROM p), b AS (SELECT doc_id, 2*(i+k*c)+CASE WHEN metric THEN 0 ELSE 1 END place FROM p, g, unnest(range(g//c+1)) t(k) WHERE i+k*c<g) SELECT (place//4)*16+r*4+place%4 step, doc_id FROM b, unnest(range(4)) t(r) WHERE (place//4+1)*4<=2*(SELECT g FROM g) UNION ALL SELECT (place//4)*16+r*(2*(SELECT g FROM g)%4)+place%4, doc_id FROM b, unnest(range(4)) t(r) WHERE (place//4+1)*4>2*(SELECT g FROM g)")
def training_order(spark, d):
    """Two kinds of frames (metric or not) in a seeded order, taken in turn, the smaller kind repeated; blocks of four are read four times over.

    The order is that of a digest, which reruns and partitions do not change; documents without an id come last in it.
    """
    docs = table(spark, d, "documents").select("doc_id", (F.col("lang").isNull() | (F.col("lang") == "en")).alias("metric"))
    parts = [rel._numbered(docs.where(F.col("metric") == m).withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))), [F.asc_nulls_last("h"), F.asc_nulls_last("doc_id")]).withColumn("odd", F.lit(0 if m else 1)) for m in (True, False)]
    p = parts[0].unionByName(parts[1])
    g = p.agg(F.max("_n")).first()[0] or 0
    b = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(g) / F.col("_n"))))).withColumn("j", F.col("_i") + F.col("k") * F.col("_n")).where(F.col("j") < g).withColumn("place", 2 * F.col("j") + F.col("odd"))
    block = F.floor(F.col("place") / 4)
    width = F.least(F.lit(4).cast("long"), F.lit(2 * g).cast("long") - block * 4)
    return b.withColumn("r", F.explode(F.array(*map(F.lit, range(4))))).select((block * 16 + F.col("r") * width + F.col("place") % 4).cast("long").alias("step"), "doc_id")
