"""Queries of ordered and raster operators; `events` of a user stand for the frames of a take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import relational as rel
from plumbline.plans.catalogue import query, r6, table

E = "SELECT *, epoch_us(ts) t FROM events"
O = "PARTITION BY user_id ORDER BY t, event_id"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))


def take():
    return Window.partitionBy("user_id").orderBy("t", "event_id")


def grid(spark, d):
    """A raster: x = hour of the day, y = day, depth = sum of values."""
    h = F.floor(F.col("t") / 3_600_000_000)
    return events(spark, d).groupBy((h % 24).cast("int").alias("x"), F.floor(h / 24).cast("int").alias("y")).agg(F.round(F.sum("value"), 4).alias("v"))


G = f"SELECT CAST((t//3600000000)%24 AS INTEGER) x, CAST(t//86400000000 AS INTEGER) y, round(sum(value),4) v FROM ({E}) GROUP BY 1,2"


@query("zbuffer_min", f"SELECT user_id, t//3600000000 cell, min(value) z FROM ({E}) WHERE value>0 GROUP BY 1,2")
def zbuffer_min(spark, d):
    """The least depth of each cell."""
    return events(spark, d).where("value > 0").groupBy("user_id", F.floor(F.col("t") / 3_600_000_000).alias("cell")).agg(F.min("value").alias("z"))


@query("zbuffer_visible", f"SELECT event_id FROM (SELECT *, min(value) OVER (PARTITION BY user_id, t//86400000000) z FROM ({E}) WHERE value>0) WHERE value<=z+greatest(0.015,0.006*z)")
def zbuffer_visible(spark, d):
    """What is not behind the least depth of its cell by more than 15 mm or 0.6 percent."""
    e = events(spark, d).where("value > 0").withColumn("cell", F.floor(F.col("t") / 86_400_000_000))
    z = e.groupBy("user_id", "cell").agg(F.min("value").alias("z"))
    return e.join(z, ["user_id", "cell"]).where(F.col("value") <= F.col("z") + F.greatest(F.lit(0.015), 0.006 * F.col("z"))).select("event_id")


@query("interval_join_window", f"SELECT a.event_id, count(*) n, round(sum(b.value),4) total FROM ({E}) a JOIN ({E}) b ON a.user_id=b.user_id AND b.t BETWEEN a.t-7200000000 AND a.t GROUP BY 1")
def interval_join_window(spark, d):
    """Samples of the two hours up to each frame, ends included, by bucketed equi-join."""
    e = events(spark, d)
    w = e.select("event_id", "user_id", (F.col("t") - 7_200_000_000).alias("begin"), F.col("t").alias("end"))
    found = rel.interval_join(e.select("user_id", "t", "value"), w, "user_id", "t", "begin", "end", bucket=7_200_000_000)
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("asof_backward", f"SELECT event_id, last_value(CASE WHEN event_type='view' THEN event_id END IGNORE NULLS) OVER ({O}) anchor FROM ({E})")
def asof_backward(spark, d):
    """The last anchor (a view) at or before each frame."""
    return rel.asof(events(spark, d), "user_id", ["t", "event_id"], F.col("event_type") == "view", F.col("event_id"), "anchor").select("event_id", "anchor")


@query("asof_bracket_interp", f"SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1=t0 THEN v0 ELSE v0+(v1-v0)*(t-t0)/(t1-t0) END,4) v FROM (SELECT event_id, t, last_value(CASE WHEN a THEN t END IGNORE NULLS) OVER w0 t0, last_value(CASE WHEN a THEN value END IGNORE NULLS) OVER w0 v0, first_value(CASE WHEN a THEN t END IGNORE NULLS) OVER w1 t1, first_value(CASE WHEN a THEN value END IGNORE NULLS) OVER w1 v1 FROM (SELECT *, event_type='purchase' a FROM ({E})) WINDOW w0 AS ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w1 AS ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
def asof_bracket_interp(spark, d):
    """Linear between the anchors around a frame, held beyond them."""
    x, a, order = events(spark, d), F.col("event_type") == "purchase", ["t", "event_id"]
    for name, value, forward in (("t0", "t", False), ("v0", "value", False), ("t1", "t", True), ("v1", "value", True)):
        x = rel.asof(x, "user_id", order, a, F.col(value), name, forward)
    v = F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull() | (F.col("t1") == F.col("t0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return x.select("event_id", F.round(v, 4).alias("v"))


@query("sequence_gap_drops", "SELECT user_id, CAST(coalesce(sum(g),0) AS BIGINT) dropped, count(*) n FROM (SELECT user_id, greatest(event_id-lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)-1,0) g FROM events) GROUP BY 1")
def sequence_gap_drops(spark, d):
    """W2."""
    return rel.sequence_gaps(table(spark, d, "events"), "user_id", "event_id")


@query("pose_delta_speed", f"SELECT user_id, round(max(s),6) peak, round(avg(s),6) mean, round(sum(m),4) path FROM (SELECT user_id, m, m/greatest(dt,1.0/30) s FROM (SELECT user_id, abs(value-lag(value) OVER ({O})) m, (t-lag(t) OVER ({O}))/1e6 dt FROM ({E})) WHERE m IS NOT NULL) GROUP BY 1")
def pose_delta_speed(spark, d):
    """Step, speed (elapsed at least a 30th of a second) and path of each take."""
    w = take()
    x = events(spark, d).select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("m"), ((F.col("t") - F.lag("t").over(w)) / 1e6).alias("dt")).where("m IS NOT NULL")
    return x.withColumn("s", F.col("m") / F.greatest(F.col("dt"), F.lit(1.0 / 30))).groupBy("user_id").agg(r6(F.max("s")).alias("peak"), r6(F.avg("s")).alias("mean"), F.round(F.sum("m"), 4).alias("path"))


@query("gap_sessions_integral", f"SELECT user_id, session, count(*) n, round(coalesce(sum(area),0),4) area FROM (SELECT user_id, CAST(sum(CASE WHEN dt IS NULL OR dt>86400 THEN 1 ELSE 0 END) OVER ({O} ROWS UNBOUNDED PRECEDING) AS BIGINT) session, CASE WHEN dt<=86400 THEN (value+pv)/2*dt END area FROM (SELECT *, (t-lag(t) OVER ({O}))/1e6 dt, lag(value) OVER ({O}) pv FROM ({E}))  x({{cols}})) GROUP BY 1,2".replace("  x({cols})", ""))
def gap_sessions_integral(spark, d):
    """Trapezoids between samples, begun anew after a gap (here a day)."""
    w = take()
    x = events(spark, d).withColumn("dt", (F.col("t") - F.lag("t").over(w)) / 1e6).withColumn("pv", F.lag("value").over(w))
    new = F.when(F.col("dt").isNull() | (F.col("dt") > 86400), 1).otherwise(0)
    x = x.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("area", F.when(F.col("dt") <= 86400, (F.col("value") + F.col("pv")) / 2 * F.col("dt")))
    return x.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 4).alias("area"))


@query("fragment_ranges", f"SELECT user_id, fragment, count(*) n, min(event_id) first_id FROM (SELECT user_id, event_id, CAST(least(i//4, greatest(CAST(ceil(n/4.0) AS BIGINT)-1-CASE WHEN n%4=1 THEN 1 ELSE 0 END,0)) AS BIGINT) fragment FROM (SELECT *, row_number() OVER ({O})-1 i, count(*) OVER (PARTITION BY user_id) n FROM ({E}))) GROUP BY 1,2")
def fragment_ranges(spark, d):
    """Fours, a short tail joined to the run before."""
    return rel.fragments(events(spark, d), "user_id", ["t", "event_id"]).groupBy("user_id", "fragment").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_ONCE = "SELECT user_id, event_id, t, (coalesce(lag({c},2) OVER w,first_value({c}) OVER w)+2*coalesce(lag({c},1) OVER w,first_value({c}) OVER w)+3*{c}+2*coalesce(lead({c},1) OVER w,last_value({c}) OVER f)+coalesce(lead({c},2) OVER w,last_value({c}) OVER f))/9 {n} FROM ({q}) WINDOW w AS (PARTITION BY user_id ORDER BY t,event_id), f AS (PARTITION BY user_id ORDER BY t,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("kernel_smooth", f"SELECT event_id, round(greatest(-200,least(200,c)),6) smooth FROM ({_ONCE.format(c='b', n='c', q=_ONCE.format(c='a', n='b', q=_ONCE.format(c='value', n='a', q=E)))})")
def kernel_smooth(spark, d):
    """The kernel 1 2 3 2 1, three times, ends repeated, then clipped."""
    x, w = events(spark, d).withColumn("s", F.col("value")), take()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for _ in range(3):
        first, last = F.first("s").over(whole), F.last("s").over(whole)
        total = 3 * F.col("s")
        for k, weight in ((1, 2), (2, 1)):
            total = total + weight * (F.coalesce(F.lag("s", k).over(w), first) + F.coalesce(F.lead("s", k).over(w), last))
        x = x.withColumn("s", total / 9)
    return x.select("event_id", r6(geom.clip(F.col("s"), -200.0, 200.0)).alias("smooth"))


@query("progress_monotone", f"SELECT event_id, max(value) OVER ({O} ROWS UNBOUNDED PRECEDING) progress FROM ({E})")
def progress_monotone(spark, d):
    """W10."""
    return events(spark, d).select("event_id", F.max("value").over(take().rowsBetween(Window.unboundedPreceding, 0)).alias("progress"))


@query("weighted_stage_progress", f"SELECT event_id, round(sum(w) OVER ({O} ROWS UNBOUNDED PRECEDING)/sum(w) OVER (PARTITION BY user_id),6) overall FROM (SELECT *, length(event_type) w FROM ({E}))")
def weighted_stage_progress(spark, d):
    """Prefix sums of stage weights over their total."""
    x = events(spark, d).withColumn("w", F.length("event_type"))
    return x.select("event_id", r6(F.sum("w").over(take().rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(Window.partitionBy("user_id"))).alias("overall"))


@query("phase_boundaries", f"SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER ({O}) p FROM ({E})) WHERE p<>event_type")
def phase_boundaries(spark, d):
    """Where the phase differs from the row before."""
    return events(spark, d).withColumn("p", F.lag("event_type").over(take())).where("p <> event_type").select("event_id")


@query("rate_bucket_decimate", f"SELECT event_id FROM (SELECT event_id, row_number() OVER ({O}) i FROM ({E})) WHERE i=1 OR floor((i-1)*10/30.0)<>floor((i-2)*10/30.0)")
def rate_bucket_decimate(spark, d):
    """10 of 30 frames."""
    return rel.bucket_decimation(events(spark, d).withColumn("i", F.row_number().over(take())), "i", 10, 30).select("event_id")


@query("evenly_spaced_cap", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id)-1 i, count(*) OVER () n FROM events) SELECT event_id FROM r WHERE n<=100 OR i IN (SELECT (k*(n-1))//99 FROM range(100) q(k), (SELECT count(*) n FROM events))")
def evenly_spaced_cap(spark, d):
    """L2: 100 of all frames, by place."""
    return rel.evenly_spaced(table(spark, d, "events").select("event_id"), ["event_id"], 100)


@query("group_middle_plus_even", f"WITH r AS (SELECT user_id, event_id, row_number() OVER ({O})-1 i, count(*) OVER (PARTITION BY user_id) n FROM ({E})) SELECT event_id FROM r WHERE i=n//2 OR n<=5 OR i IN (0,(n-1)//4,(2*(n-1))//4,(3*(n-1))//4,n-1)")
def group_middle_plus_even(spark, d):
    """The middle frame of each take and five evenly spaced ones."""
    e = events(spark, d)
    w = Window.partitionBy("user_id")
    middle = e.withColumn("_i", F.row_number().over(take()) - 1).withColumn("_n", F.count("*").over(w)).where("_i = floor(_n / 2)").select("event_id")
    return middle.union(rel.evenly_spaced(e, ["t", "event_id"], 5, "user_id").select("event_id")).distinct()


@query("stride_decimate", "SELECT event_id, value FROM events WHERE event_id%6=0")
def stride_decimate(spark, d):
    """L3."""
    return table(spark, d, "events").where(F.pmod("event_id", F.lit(6)) == 0).select("event_id", "value")


@query("finite_journal_means", "SELECT event_type, count(k) n, round(avg(k),6) mean FROM (SELECT event_type, TRY_CAST(props->>'$.k' AS DOUBLE) k FROM events WHERE value>0) GROUP BY 1")
def finite_journal_means(spark, d):
    """Means of journal fields over accepted rows, what does not parse or is not finite left out."""
    k = F.expr("try_cast(get_json_object(props, '$.k') AS double)")
    x = table(spark, d, "events").where("value > 0").withColumn("k", F.when(~F.isnan(k), k))
    return x.groupBy("event_type").agg(F.count("k").alias("n"), r6(F.avg("k")).alias("mean"))


@query("complete_phase_all", "SELECT user_id, count(*) n FROM events GROUP BY 1 HAVING bool_and(value IS NOT NULL AND value<600)")
def complete_phase_all(spark, d):
    """Takes of which every frame has a pose."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and(F.col("value").isNotNull() & (F.col("value") < 600)).alias("ok")).where("ok").drop("ok")


@query("alignment_quality", "SELECT user_id, round(ov,6) overlap, round(ir,6) inliers, round(rm,6) rmse, CASE WHEN ov<0.28 THEN 'overlap' WHEN ir<0.65 THEN 'inliers' WHEN rm>30 THEN 'rmse' ELSE 'accepted' END reason FROM (SELECT user_id, avg(CASE WHEN value>5 THEN 1.0 ELSE 0 END) ov, coalesce(sum(CASE WHEN value>5 AND value<=60 THEN 1.0 END)/sum(CASE WHEN value>5 THEN 1 END),0) ir, coalesce(sqrt(avg(CASE WHEN value>5 AND value<=60 THEN value*value END)),0) rm FROM events GROUP BY 1)")
def alignment_quality(spark, d):
    """Overlap, inlier ratio, error of the inliers, and the first test that fails."""
    inside, near = F.col("value") > 5, (F.col("value") > 5) & (F.col("value") <= 60)
    x = table(spark, d, "events").groupBy("user_id").agg(
        F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("ov"),
        F.when(F.count_if(inside) > 0, F.count_if(near) / F.count_if(inside)).otherwise(0.0).alias("ir"),
        F.coalesce(F.sqrt(F.avg(F.when(near, F.col("value") * F.col("value")))), F.lit(0.0)).alias("rm"),
    )
    reason = F.when(F.col("ov") < 0.28, "overlap").when(F.col("ir") < 0.65, "inliers").when(F.col("rm") > 30, "rmse").otherwise("accepted")
    return x.select("user_id", r6("ov").alias("overlap"), r6("ir").alias("inliers"), r6("rm").alias("rmse"), reason.alias("reason"))


@query("robust_mad_offset", "WITH m AS (SELECT user_id, median(value) med FROM events GROUP BY 1), a AS (SELECT user_id, any_value(med) med, median(abs(value-med)) mad FROM events JOIN m USING(user_id) GROUP BY 1) SELECT user_id, round(median(value),6) offset_value, count(*) inliers FROM events JOIN a USING(user_id) WHERE abs(value-med)<=greatest(0.04,3.5*mad) GROUP BY 1")
def robust_mad_offset(spark, d):
    """The median of what is within 3.5 median deviations of the median."""
    x = table(spark, d, "events").select("user_id", "value")
    x = x.join(x.groupBy("user_id").agg(F.median("value").alias("med")), "user_id")
    x = x.join(x.groupBy("user_id").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad")), "user_id")
    x = x.where(F.abs(F.col("value") - F.col("med")) <= F.greatest(F.lit(0.04), 3.5 * F.col("mad")))
    return x.groupBy("user_id").agg(r6(F.median("value")).alias("offset_value"), F.count("*").alias("inliers"))


_ROUND = "c{k} AS (SELECT event_type, sum(value*w)/sum(w) m FROM w{k} GROUP BY 1), r{k} AS (SELECT user_id, median(greatest(-80,least(80,value-m))) r FROM events JOIN c{k} USING (event_type) GROUP BY 1), w{n} AS (SELECT e.user_id, e.event_type, e.value, 1.0/(1+e.user_id%7)/(1+abs(e.value-m-r)/20) w FROM events e JOIN c{k} USING (event_type) JOIN r{k} USING (user_id))"


@query("weighted_consensus", "WITH w0 AS (SELECT user_id, event_type, value, 1.0/(1+user_id%7) w FROM events), " + ", ".join(_ROUND.format(k=k, n=k + 1) for k in range(3)) + " SELECT user_id, round(r,6) residual FROM r2")
def weighted_consensus(spark, d):
    """Three rounds of a weighted mean of each colour and the median residual of each frame, clipped; a value weighs less, the further it is from both."""
    x = table(spark, d, "events").select("user_id", "event_type", "value", (1.0 / (1 + F.col("user_id") % 7)).alias("w"))
    x = x.withColumn("given", F.col("w"))
    for _ in range(3):
        c = x.groupBy("event_type").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("m"))
        x = x.join(c, "event_type")
        r = x.groupBy("user_id").agg(F.median(geom.clip(F.col("value") - F.col("m"), -80.0, 80.0)).alias("r"))
        x = x.join(r, "user_id").select("user_id", "event_type", "value", "given", (F.col("given") / (1 + F.abs(F.col("value") - F.col("m") - F.col("r")) / 20)).alias("w"))
    return r.select("user_id", r6("r").alias("residual"))


@query("evidence_summary", "WITH f AS (SELECT user_id, event_type, count(*) n, count(*) FILTER (value BETWEEN 10 AND 60) s, count(*) FILTER (value>60 AND value<=90) o, count(*) FILTER (value>90) v, count(*) FILTER (value<10) m FROM events GROUP BY 1,2), k AS (SELECT user_id, sum(n) n, sum(s) s, sum(o) o, sum(v) v, sum(m) m, count(*) FILTER (s>=greatest(3,ceil(0.15*n))) views, count(*) FILTER (s+o+v>0) useful FROM f GROUP BY 1) SELECT user_id, CAST(m AS BIGINT) missing, round(s/greatest(s+o+v,1),6) support, round(v/greatest(s+o+v,1),6) free, round(o/greatest(s+o+v,1),6) occluded, views, useful FROM k")
def evidence_summary(spark, d):
    """Five kinds of evidence (here four; none is outside) by view, then by hole: ratios over the metric ones, views that support enough samples, views of use."""
    v = F.col("value")
    kinds = {"s": v.between(10, 60), "o": (v > 60) & (v <= 90), "v": v > 90, "m": v < 10}
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    hole = per.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in "sovm"], F.count_if(F.col("s") >= F.greatest(F.lit(3), F.ceil(0.15 * F.col("n")))).alias("views"), F.count_if(F.col("s") + F.col("o") + F.col("v") > 0).alias("useful"))
    every = F.greatest(F.col("s") + F.col("o") + F.col("v"), F.lit(1))
    return hole.select("user_id", F.col("m").alias("missing"), *[r6(F.col(c) / every).alias(n) for c, n in (("s", "support"), ("v", "free"), ("o", "occluded"))], "views", "useful")


@query("quality_summary", "SELECT min_by(event_type,(q,event_type)) weakest, round(0.72*min(q)+0.28*avg(q),6) score, CASE WHEN 0.72*min(q)+0.28*avg(q)>=80 THEN 'good' WHEN 0.72*min(q)+0.28*avg(q)>=60 THEN 'fair' ELSE 'poor' END AS label FROM (SELECT event_type, round(100*(0.6*least(avg(value)/60,1)+0.4*least(count(*)/1000.0,1)),6) q FROM events GROUP BY 1)")
def quality_summary(spark, d):
    """Saturating scores of the phases, 0.72 of the least and 0.28 of the mean."""
    q = r6(100 * (0.6 * geom.saturating(F.avg("value"), 60.0) + 0.4 * geom.saturating(F.count("*"), 1000.0)))
    x = table(spark, d, "events").groupBy("event_type").agg(q.alias("q"))
    x = x.agg(F.min_by("event_type", F.struct("q", "event_type")).alias("weakest"), (0.72 * F.min("q") + 0.28 * F.avg("q")).alias("s"))
    return x.select("weakest", r6("s").alias("score"), F.when(F.col("s") >= 80, "good").when(F.col("s") >= 60, "fair").otherwise("poor").alias("label"))


@query("stencil_support", f"WITH g AS ({G}) SELECT a.x, a.y, count(b.x) support FROM g a LEFT JOIN g b ON abs(a.x-b.x)+abs(a.y-b.y)=1 AND abs(a.v-b.v)<=greatest(24,round_even(0.15*a.v,0)) GROUP BY 1,2 HAVING count(b.x)>0")
def stencil_support(spark, d):
    """a pixel stays if a neighbour of four is near in depth; neighbours by equi-joins on shifted keys."""
    g = grid(spark, d)
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = g.withColumn("s", sides).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("v").alias("u"))
    found = g.join(near, ["x", "y"]).where(F.abs(F.col("v") - F.col("u")) <= F.greatest(F.lit(24.0), F.rint(0.15 * F.col("v"))))
    return found.groupBy("x", "y").agg(F.count("*").alias("support"))


@query("discontinuity_mask", f"WITH g AS ({G}), w AS (SELECT *, lag(x) OVER r px, lag(v) OVER r pv, lead(x) OVER r nx, lead(v) OVER r nv FROM g WINDOW r AS (PARTITION BY y ORDER BY x)) SELECT x,y FROM w WHERE NOT ((px=x-1 AND abs(v-pv)>greatest(40,0.25*least(v,pv))) IS TRUE OR (nx=x+1 AND abs(v-nv)>greatest(40,0.25*least(v,nv))) IS TRUE)")
def discontinuity_mask(spark, d):
    """both sides of a jump along a row are dropped."""
    r = Window.partitionBy("y").orderBy("x")

    def jump(step):
        x, v = F.lag("x", step).over(r), F.lag("v", step).over(r)
        return F.coalesce((x == F.col("x") - step) & (F.abs(F.col("v") - v) > F.greatest(F.lit(40.0), 0.25 * F.least("v", v))), F.lit(False))

    return grid(spark, d).withColumn("j", jump(1) | jump(-1)).where("NOT j").select("x", "y")


@query("integral_box_sum", f"SELECT x,y, round(sum(c) OVER (PARTITION BY x ORDER BY y ROWS UNBOUNDED PRECEDING),2) integral FROM (SELECT x,y, sum(v) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING) c FROM ({G}))")
def integral_box_sum(spark, d):
    """Sums along rows, then along columns."""
    up = (Window.unboundedPreceding, 0)
    g = grid(spark, d).withColumn("c", F.sum("v").over(Window.partitionBy("y").orderBy("x").rowsBetween(*up)))
    return g.select("x", "y", F.round(F.sum("c").over(Window.partitionBy("x").orderBy("y").rowsBetween(*up)), 2).alias("integral"))


@query("laplacian_variance", f"SELECT y//8 frame, round(var_pop(l.v+r.v+u.v+w.v-4*a.v),2) sharpness FROM ({G}) a JOIN ({G}) l ON l.x=a.x-1 AND l.y=a.y JOIN ({G}) r ON r.x=a.x+1 AND r.y=a.y JOIN ({G}) u ON u.x=a.x AND u.y=a.y-1 JOIN ({G}) w ON w.x=a.x AND w.y=a.y+1 GROUP BY 1".replace("y//8 frame", "a.y//8 frame"))
def laplacian_variance(spark, d):
    """Sharpness of a frame (eight days) as the variance of the Laplacian of four neighbours."""
    g = grid(spark, d)
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(across).orderBy(along)
        for name, f, step in (("before", F.lag, -1), ("after", F.lead, 1)):
            g = g.withColumn(f"{along}_{name}", F.when(f(along).over(w) == F.col(along) + step, f("v").over(w)))
    lap = F.col("x_before") + F.col("x_after") + F.col("y_before") + F.col("y_after") - 4 * F.col("v")
    return g.withColumn("l", lap).where("l IS NOT NULL").groupBy(F.expr("y div 8").alias("frame")).agg(F.round(F.var_pop("l"), 2).alias("sharpness"))


@query("ema_fold", f"WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER ({O}) i FROM ({E})), s AS (SELECT user_id, i, value m FROM r WHERE i=1 UNION ALL SELECT r.user_id, r.i, 0.995*s.m+0.005*r.value FROM s JOIN r ON r.user_id=s.user_id AND r.i=s.i+1) SELECT user_id, round(arg_max(m,i),6) ema FROM s GROUP BY 1")
def ema_fold(spark, d):
    """Seeded with the first value; the fold as one sum of values times powers of the rate, so that no take is gathered."""
    i, n = F.row_number().over(take()), F.count("*").over(Window.partitionBy("user_id"))
    x = events(spark, d).select("user_id", "value", i.alias("i"), n.alias("n"))
    share = F.pow(F.lit(0.995), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(0.005)
    return x.groupBy("user_id").agg(r6(F.sum(share * F.col("value"))).alias("ema"))


@query("keyframe_select", f"WITH RECURSIVE r AS (SELECT user_id, event_id, t, value, row_number() OVER ({O}) i FROM ({E})), s AS (SELECT user_id, i, event_id, t kt, value kv, TRUE k FROM r WHERE i=1 UNION ALL SELECT r.user_id, r.i, r.event_id, CASE WHEN c THEN r.t ELSE kt END, CASE WHEN c THEN r.value ELSE kv END, c FROM (SELECT s.*, r.i ri, (r.t-kt>=3600000000 AND (abs(r.value-kv)>40 OR r.t-kt>=86400000000)) c FROM s JOIN r ON r.user_id=s.user_id AND r.i=s.i+1) s JOIN r ON r.user_id=s.user_id AND r.i=s.ri) SELECT event_id FROM s WHERE k")
def keyframe_select(spark, d):
    """Kept if far enough in time from the last kept one, and moved or long ago. A fold, as it depends on what was kept."""
    x = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))).alias("a"))
    first = F.col("a")[0]

    def step(s, v):
        due = (v["t"] - s["t"] >= 3_600_000_000) & ((F.abs(v["value"] - s["v"]) > 40) | (v["t"] - s["t"] >= 86_400_000_000))
        return F.when(due, F.struct(v["t"].alias("t"), v["value"].alias("v"), F.concat(s["k"], F.array(v["event_id"])).alias("k"))).otherwise(s)

    fold = F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), F.struct(first["t"].alias("t"), first["value"].alias("v"), F.array(first["event_id"]).alias("k")), step)
    return x.select(F.explode(fold["k"]).alias("event_id"))
