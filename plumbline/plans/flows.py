"""Queries of streaming flows and catalogues."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.graph import connected_components, scratch
from plumbline.operators.surface import half_edges
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, O, events
from plumbline.plans.surface import TRIS, sheet
from plumbline.streaming import flows

HOUR = 3_600_000_000


def _measure(reference: dict, frame: dict) -> flows.Motion:
    """Values stand for views: what is left of a view falls with the distance of the values."""
    off = abs(frame["value"] - reference["value"])
    return flows.Motion(off < 90, max(0.0, 1 - off / 100), off / 2000, off / 800, off / 1000)


def chosen(spark, d):
    e = events(spark, d).select("user_id", "event_id", (F.col("t") / (4 * HOUR)).alias("t"), (100 - F.col("event_id") % 60).cast("double").alias("sharpness"), "value")
    return e, flows.keyframes(e, "user_id", ["event_id", "t", "sharpness", "value"], _measure)


def _why(elapsed: str, off: str) -> str:
    return f"CASE WHEN {elapsed}<0.125 THEN NULL WHEN {elapsed}>=2 THEN 'maximum_gap' WHEN {off}<90 THEN CASE WHEN greatest(0,1-{off}/100)<=0.72 THEN 'tracked_overlap' WHEN {off}/2000>=0.055 THEN 'camera_motion' WHEN {off}/800>=0.12 THEN 'parallax' END WHEN {off}/1000>=0.12 THEN 'visual_change' END"


#: A row for each frame: the reference r, the frame p that waits and its overlap, and what the frame has brought about: a guard g, a choice c.
KEYFRAMES = (
    "WITH RECURSIVE f AS MATERIALIZED (SELECT user_id u, event_id e, t/14400000000.0 t, value v, 100-event_id%60 s, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) i, count(*) OVER (PARTITION BY user_id) n FROM (" + E + ")), "
    "k AS (SELECT u, i, t rt, v rv, NULL::BIGINT pe, NULL::DOUBLE pt, NULL::DOUBLE pv, NULL::BIGINT ps, NULL::DOUBLE po, NULL::BIGINT ge, NULL::VARCHAR gr, NULL::DOUBLE go, e ce, 'first_frame' cr, NULL::DOUBLE co FROM f WHERE i=1 UNION ALL "
    "SELECT u, i, CASE WHEN w IS NOT NULL THEN t ELSE r2 END, CASE WHEN w IS NOT NULL THEN v ELSE v2 END, CASE WHEN w IS NULL THEN e END, CASE WHEN w IS NULL THEN t END, CASE WHEN w IS NULL THEN v END, CASE WHEN w IS NULL THEN s END, CASE WHEN w IS NULL THEN greatest(0,1-abs(v-v2)/100) END, CASE WHEN og OR sg THEN pe END, CASE WHEN og THEN 'overlap_guard' WHEN sg THEN 'sharpness_guard' END, CASE WHEN og OR sg THEN po END, CASE WHEN w IS NOT NULL THEN e END, w, CASE WHEN w IS NOT NULL THEN greatest(0,1-abs(v-v2)/100) END "
    f"FROM (SELECT *, CASE WHEN sg THEN {_why('(t-r2)', 'abs(v-v2)')} ELSE w1 END w FROM (SELECT *, CASE WHEN sg THEN pt ELSE r1 END r2, CASE WHEN sg THEN pv ELSE v1 END v2 FROM "
    "(SELECT *, w1 IS NOT NULL AND ready AND NOT og AND abs(pv-rv)<90 AND po>=0.5 AND s<0.7*ps sg FROM "
    f"(SELECT *, {_why('(t-r1)', 'abs(v-v1)')} w1 FROM (SELECT *, CASE WHEN og THEN pt ELSE rt END r1, CASE WHEN og THEN pv ELSE rv END v1 FROM "
    "(SELECT *, abs(v-rv)<90 AND greatest(0,1-abs(v-rv)/100)<0.5 AND ready og FROM (SELECT k.rt, k.rv, k.pe, k.pt, k.pv, k.ps, k.po, f.u, f.i, f.e, f.t, f.v, f.s, k.pe IS NOT NULL AND k.pt-k.rt>=0.125 ready FROM k JOIN f ON f.u=k.u AND f.i=k.i+1)))))))), "
    "o AS (SELECT u user_id, ge event_id, gr reason, go AS overlap FROM k WHERE ge IS NOT NULL UNION ALL SELECT u, ce, cr, co FROM k WHERE ce IS NOT NULL UNION ALL SELECT k.u, pe, 'last_frame', po FROM k JOIN f ON f.u=k.u AND f.i=k.i WHERE f.i=f.n AND pe IS NOT NULL AND pt-rt>=0.125) "
)


@query("media_keyframes", KEYFRAMES + "SELECT user_id, event_id, reason, round(overlap,6) AS overlap FROM o")
def media_keyframes(spark, d):
    """Keyframes with look-back, four hours as a second."""
    return chosen(spark, d)[1].withColumn("overlap", r6(F.col("overlap")))


@query("frame_statistics", KEYFRAMES + """, r AS (SELECT user_id, '{'||string_agg('"'||reason||'":'||n, ',' ORDER BY reason)||'}' reasons FROM (SELECT user_id, reason, count(*) n FROM o GROUP BY 1,2) GROUP BY 1), q AS (SELECT user_id, count(*) sel, median(overlap) med, min(overlap) low FROM o GROUP BY 1), a AS (SELECT user_id, count(*) evaluated FROM events GROUP BY 1) SELECT user_id, evaluated, sel selected, evaluated-sel redundant, reasons, round(med,6) median_overlap, round(low,6) least_overlap FROM a JOIN q USING (user_id) JOIN r USING (user_id)""")
def frame_statistics(spark, d):
    """A32."""
    e, c = chosen(spark, d)
    s = flows.frame_statistics(e, c, "user_id")
    return s.withColumns({n: r6(F.col(n)) for n in ("median_overlap", "least_overlap")})


@query("after_reset", f"SELECT event_id FROM ({E}) a WHERE NOT EXISTS (SELECT 1 FROM ({E}) b WHERE b.user_id=a.user_id AND b.event_type='error' AND (b.t,b.event_id)>=(a.t,a.event_id))")
def after_reset(spark, d):
    """What a take has gathered since its last reset (an error)."""
    return flows.after_reset(events(spark, d), "user_id", ["t", "event_id"], F.col("event_type") == "error").select("event_id")


@query("throttled_output", f"WITH RECURSIVE e AS ({E}), s AS (SELECT user_id, min(t) t FROM e GROUP BY 1 UNION ALL SELECT s.user_id, (SELECT min(e.t) FROM e WHERE e.user_id=s.user_id AND e.t>=s.t+30*{HOUR}) FROM s WHERE (SELECT min(e.t) FROM e WHERE e.user_id=s.user_id AND e.t>=s.t+30*{HOUR}) IS NOT NULL) SELECT user_id, t FROM s UNION SELECT user_id, max(t) FROM e GROUP BY 1")
def throttled_output(spark, d):
    """At most one in thirty hours, and the last."""
    return flows.throttled(events(spark, d).select("user_id", "t"), "user_id", "t", 30 * HOUR)


@query("newest_packets", "SELECT event_type, max(event_id) event_id, max_by(value,event_id) AS value FROM events GROUP BY 1 HAVING NOT (event_type='view' AND max(event_id)=(SELECT max(event_id) FROM events WHERE event_type='view'))")
def newest_packets(spark, d):
    """Of each kind the newest, but for the kind whose newest is known."""
    e = table(spark, d, "events")
    known = e.where("event_type = 'view'").agg(F.max("event_id")).first()[0]
    return flows.newest(e, "event_type", "event_id", "value", {"view": known})


@query("stream_counters", "SELECT user_id, count(*) processed, count(*) FILTER (event_type<>'error') accepted, count(*) FILTER (event_type='error') rejected, count(*) FILTER (value>50) integrated FROM events GROUP BY 1")
def stream_counters(spark, d):
    """T16 on a stream: the events replayed, totals kept complete."""
    home = scratch(spark, "stream")
    table(spark, d, "events").select("user_id", "event_type", "value").write.parquet(f"{home}/in")
    frames = spark.readStream.schema("user_id long, event_type string, value double").parquet(f"{home}/in")
    c = F.col("event_type")
    totals = flows.counters(frames, "user_id", {"accepted": c != "error", "rejected": c == "error", "integrated": F.col("value") > 50})
    run = totals.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{home}/out")).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out")


@query("side_outputs", "SELECT event_type, count(*) n, round(sum(value),4) total FROM events WHERE event_type IN ('view','purchase') GROUP BY 1")
def side_outputs(spark, d):
    """A stream's rows to a table for each kind."""
    home = scratch(spark, "stream")
    table(spark, d, "events").select("event_type", "value").write.parquet(f"{home}/in")
    rows = spark.readStream.schema("event_type string, value double").parquet(f"{home}/in")
    run = rows.writeStream.foreachBatch(flows.to_sides(f"{home}/out", "event_type", ["view", "purchase"])).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    both = [spark.read.parquet(f"{home}/out/{k}").withColumn("event_type", F.lit(k)) for k in ("view", "purchase")]
    return both[0].unionByName(both[1]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("solve_telemetry", f"SELECT event_id, solve, count(*) OVER w attempts, max(value) OVER w best FROM (SELECT *, CAST(sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) OVER ({O} ROWS UNBOUNDED PRECEDING) AS BIGINT) solve FROM ({E})) WINDOW w AS (PARTITION BY user_id, solve ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)")
def solve_telemetry(spark, d):
    """A purchase begins a solve."""
    return flows.telemetry(events(spark, d), "user_id", ["t", "event_id"], F.col("event_type") == "purchase", "value").select("event_id", "solve", "attempts", "best")


@query("catalogue_entries", "SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus='F') captures, count(o_orderkey) sources, coalesce(sum(CASE WHEN o_orderkey IS NOT NULL THEN n END),0) frames, count(*) FILTER (o_orderstatus='F' AND n>3) artifacts, max_by(o_orderkey,(o_orderdate,o_orderkey)) FILTER (o_orderstatus='F' AND n>2) AS preview FROM customer LEFT JOIN orders ON o_custkey=c_custkey LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey GROUP BY 1")
def catalogue_entries(spark, d):
    """Projects (customers) with their captures, frames and sound artifacts, and the last complete capture that has a preview."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(per, "o_orderkey", "left").withColumnRenamed("o_custkey", "c_custkey")
    done = F.col("o_orderstatus") == "F"
    x = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy("c_custkey")
    preview = F.max(F.when(done & (F.col("n") > 2), F.struct("o_orderdate", "o_orderkey")))["o_orderkey"]
    return x.agg(F.count(F.when(done, F.col("o_orderkey"))).alias("captures"), F.count("o_orderkey").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), F.count_if(done & (F.col("n") > 3)).alias("artifacts"), preview.alias("preview"))


@query("topology_report", f"{TRIS}, h AS (SELECT tid, least(a,b) lo, greatest(a,b) hi FROM t UNION ALL SELECT tid, least(b,c), greatest(b,c) FROM t UNION ALL SELECT tid, least(c,a), greatest(c,a) FROM t), e AS (SELECT lo, hi, count(*) n FROM h GROUP BY 1,2), r AS (SELECT lo v, lo m FROM e UNION SELECT hi, hi FROM e), reach AS (SELECT v, m FROM r UNION SELECT CASE WHEN e.lo=reach.v THEN e.hi ELSE e.lo END, reach.m FROM reach JOIN e ON e.lo=reach.v OR e.hi=reach.v) SELECT (SELECT count(*) FROM t) triangles, (SELECT count(DISTINCT v) FROM r) vertices, count(*) edges, count(*) FILTER (n=1) boundary, count(*) FILTER (n>2) nonmanifold, (SELECT count(DISTINCT m) FROM (SELECT v, min(m) m FROM reach GROUP BY 1)) components, (SELECT count(DISTINCT v) FROM r)-count(*)+(SELECT count(*) FROM t) euler FROM e")
def topology_report(spark, d):
    """Counts of a mesh."""
    t, _ = sheet(spark, d)
    e = half_edges(t).groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.count("*").alias("n"))
    parts = connected_components(e, "lo", "hi")
    sums = e.agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("nonmanifold"))
    shape = parts.agg(F.count("*").alias("vertices"), F.countDistinct("component").alias("components"))
    s, p, n = sums.first(), shape.first(), t.count()
    row = (n, p["vertices"], s["edges"], s["boundary"], s["nonmanifold"], p["components"], p["vertices"] - s["edges"] + n)
    return spark.createDataFrame([row], "triangles long, vertices long, edges long, boundary long, nonmanifold long, components long, euler long")


@query("merged_progress", f"WITH w AS (SELECT * FROM (VALUES ('view',0.0,0.5),('click',0.5,0.3),('purchase',0.8,0.2)) s(event_type,base,share)), p AS (SELECT user_id, event_id, t, base+share*least(1,greatest(0,coalesce(TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE),0)/100)) v FROM ({E}) JOIN w USING (event_type)) SELECT event_id, round(max(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING),6) progress FROM p")
def merged_progress(spark, d):
    """A worker's documents merged into a job: a stage's progress within its share of the whole, never going back."""
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS double)"), F.lit(0.0)) / 100
    base = F.when(F.col("event_type") == "view", 0.0).when(F.col("event_type") == "click", 0.5).when(F.col("event_type") == "purchase", 0.8)
    share = F.when(F.col("event_type") == "view", 0.5).when(F.col("event_type") == "click", 0.3).otherwise(0.2)
    x = events(spark, d).withColumn("v", base + share * F.least(F.lit(1.0), F.greatest(F.lit(0.0), k))).where("v IS NOT NULL")
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("event_id", r6(F.max("v").over(w)).alias("progress"))
