"""Queries of scores, limits, offsets, loop candidates and integrated turns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.operators import scores
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, O, events, take
from plumbline.plans.points import P, points
from plumbline.streaming.live import latest_wins


@query("alignment_scores", "SELECT l_orderkey, l_linenumber, CAST(greatest(0,least(100,round_even(85.0*(0.25*least(l_discount*5/0.5,1)+0.25*least(l_tax*5/0.45,1)+0.15*least(l_tax*2/0.2,1)+0.2*greatest(0,least(1,1-l_discount/2/0.06))+0.15*coalesce(greatest(0,least(1,1-CASE WHEN l_returnflag<>'N' THEN l_quantity/50 END/sqrt(3.0))),0.5))+15.0*greatest(0,least(1,1-greatest(0,l_quantity-20)/35)),0))) AS INTEGER) score FROM lineitem")
def alignment_scores(spark, d):
    """A19."""
    q = F.col("l_quantity")
    s = scores.alignment_score(F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_tax") * 2, F.col("l_discount") / 2, F.when(F.col("l_returnflag") != "N", q / 50), q)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("score"))


@query("photo_scores", "SELECT p_partkey, s score, CASE WHEN s>=75 THEN 'Excellent' WHEN s>=55 THEN 'Good' WHEN s>=35 THEN 'Usable' ELSE 'Weak' END AS label, round(greatest(0.2,0.55*least(1,p_size/120)+0.45*greatest(0,least(1,(4-p_size/10)/3.5))),4) weight FROM (SELECT *, CAST(round_even(100*(0.4*least(1,p_size/24)+0.2*least(1,(p_partkey%50)/40)+0.3*greatest(0,1-p_size/10/6)+0.1*greatest(0,1-(p_partkey%30)/10/2)),0) AS INTEGER) s FROM part)")
def photo_scores(spark, d):
    """A20."""
    n, k = F.col("p_size"), F.col("p_partkey")
    score, label = scores.photo_quality(n, k % 50, n / 10, (k % 30) / 10)
    return table(spark, d, "part").select("p_partkey", score.alias("score"), label.alias("label"), scores.pose_confidence(n, n / 10).alias("weight"))


@query("scale_limits", f"WITH b AS (SELECT label, unnest([abs(x),abs(y)]) s FROM ({P})), r AS (SELECT label, CASE WHEN count(*)>=200 THEN quantile_cont(s,0.995) ELSE max(s) END u FROM b GROUP BY 1), p AS (SELECT label, quantile_cont(greatest(abs(x),abs(y)),0.95) p FROM ({P}) GROUP BY 1) SELECT label, round(greatest(u*2,0.015),6) surface, round(greatest(p*1.25,0.003),6) prior FROM r JOIN p USING (label)")
def scale_limits(spark, d):
    """A24."""
    s = points(spark, d).select("label", F.abs("x").alias("a"), F.abs("y").alias("b"))
    return scores.scale_limits(s, "label", "a", "b", F.lit(1.0)).select("label", r6("surface").alias("surface"), r6("prior").alias("prior"))


@query("depth_weights", "SELECT o_orderkey, round(0.2*(1-k)+0.02*k,6) weight FROM (SELECT o_orderkey, greatest(0,least(1,o_orderkey%1000/greatest(1000*0.65,1))) k FROM orders)")
def depth_weights(spark, d):
    """A38."""
    w = scores.depth_weight(F.col("o_orderkey") % 1000, F.lit(1000))
    return table(spark, d, "orders").select("o_orderkey", r6(w).alias("weight"))


@query("boundary_distances", f"WITH e(x1,y1,x2,y2) AS (VALUES (-0.1,-0.1,0.2,-0.1),(0.2,-0.1,0.1,0.15),(0.1,0.15,-0.1,-0.1)), k AS (SELECT vec_id, x, y, x1, y1, x2-x1 ex, y2-y1 ey, greatest(0,least(1,((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)**2+(y2-y1)**2))) a FROM ({P}), (SELECT x1::DOUBLE x1, y1::DOUBLE y1, x2::DOUBLE x2, y2::DOUBLE y2 FROM e)) SELECT vec_id, round(min(sqrt((x-x1-a*ex)**2+(y-y1-a*ey)**2)),6) distance FROM k GROUP BY 1")
def boundary_distances(spark, d):
    """F15."""
    off = scores.boundary_distance(F.col("x"), F.col("y"), [(-0.1, -0.1), (0.2, -0.1), (0.1, 0.15)])
    return points(spark, d).select("vec_id", r6(off).alias("distance"))


@query("pair_offsets", "WITH m AS (SELECT user_id, event_type, median(value) m FROM events GROUP BY 1,2), a AS (SELECT user_id, event_type, any_value(m) m, median(abs(value-m)) mad FROM events JOIN m USING (user_id, event_type) GROUP BY 1,2) SELECT user_id, event_type, round(median(value),6) offset_value, count(*) inliers FROM events JOIN a USING (user_id, event_type) WHERE abs(value-m)<=greatest(0.04,3.5*mad) GROUP BY 1,2")
def pair_offsets(spark, d):
    """A user and a kind stand for a pair of frames and a channel."""
    o = scores.robust_offsets(table(spark, d, "events"), ["user_id", "event_type"], "value")
    return o.select("user_id", "event_type", r6("offset").alias("offset_value"), "inliers")


@query("loop_candidates", f"WITH r AS (SELECT user_id, event_id, value, row_number() OVER ({O})-1 i, count(*) OVER (PARTITION BY user_id) n FROM ({E})) SELECT a.event_id AS src, b.event_id AS dst, round(abs(a.value-b.value),6) off_by FROM r a JOIN r b ON a.user_id=b.user_id AND a.i-b.i>=6 AND abs(a.value-b.value)<=3 WHERE a.i>=6 AND (a.i%3=0 OR a.i=a.n-1) QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value-b.value), b.event_id)<=2")
def loop_candidates(spark, d):
    """J17."""
    r = events(spark, d).select("user_id", "event_id", "value", (F.row_number().over(take()) - 1).alias("i"))
    return scores.loop_candidates(r, "user_id", "event_id", "i", "value", 3.0).select("src", "dst", r6("off").alias("off_by"))


HALF_DAY = 43_200_000_000


@query("gyro_sessions", f"WITH s AS (SELECT user_id, t, value/1e6 z, t-lag(t) OVER w dt, lag(value/1e6) OVER w p FROM ({E}) WINDOW w AS (PARTITION BY user_id ORDER BY t, value)), q AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt<=0 OR dt>{HALF_DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, z ROWS UNBOUNDED PRECEDING) k, CASE WHEN dt>0 AND dt<={HALF_DAY} THEN (z+p)/2*dt/1e6 END a FROM s) SELECT user_id, CAST(k AS BIGINT) AS session, count(*) samples, round(sin(coalesce(sum(CASE WHEN a<=0.7 AND a>1e-9 THEN a END),0)),5)+0.0 turn FROM q GROUP BY 1,2")
def gyro_sessions(spark, d):
    """Values as rates about z, sessions ended by half a day without a sample."""
    s = events(spark, d).select("user_id", "t", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("value") / 1e6).alias("z"))
    g = scores.gyro_sessions(s, "user_id", "t", HALF_DAY)
    return g.select("user_id", "session", "samples", (F.round(F.col("rotation")[1], 5) + 0.0).alias("turn"))


C30, S30 = math.cos(math.radians(30)), math.sin(math.radians(30))


@query("rebased_splats", f"SELECT vec_id, round(2*({C30!r}*x-{S30!r}*y)+1,6) x, round(2*z-3,6) z, round(abs(c)*2,6) scale, round(cos(radians(15))*cos(f)-sin(radians(15))*sin(f),6) w FROM ({P})")
def rebased_splats(spark, d):
    """P20: a similarity of twice the size, 30 degrees about z."""
    s = points(spark, d).select("vec_id", "x", "y", "z", F.array(F.abs("c")).alias("scale"), F.array(F.cos("f"), F.lit(0.0), F.lit(0.0), F.sin("f")).alias("turn"))
    h = math.radians(15)
    out = scores.rebased(s, 2.0, [math.cos(h), 0.0, 0.0, math.sin(h)], [1.0, 2.0, -3.0])
    return out.select("vec_id", r6("x").alias("x"), r6("z").alias("z"), r6(F.col("scale")[0]).alias("scale"), r6(F.col("turn")[0]).alias("w"))


@query("queue_drop_newest", f"SELECT event_id, greatest(n-8,0) dropped FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r, count(*) OVER (PARTITION BY user_id) n FROM ({E})) WHERE r<=8")
def queue_drop_newest(spark, d):
    """A queue of eight that refuses what comes when it is full."""
    return latest_wins(events(spark, d), "user_id", "event_id", 8, drop_newest=True).select("event_id", "dropped")
