"""Queries of selection and streaming operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from plumbline.operators.graph import scratch
from plumbline.operators.selection import farthest_points, greedy_coverage, nearest_references
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, O, events
from plumbline.streaming.live import latest_wins, tracker


@query("neighbor_topk", "SELECT vec_id, ref, rank, round(dist,6) dist FROM (SELECT a.vec_id, b.vec_id AS ref, sqrt(list_sum(list_transform(list_zip(a.e,b.e), lambda p: (p[1]-p[2])*(p[1]-p[2])))) dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum(list_transform(list_zip(a.e,b.e), lambda p: (p[1]-p[2])*(p[1]-p[2]))),9), b.vec_id) AS rank FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) b ON a.vec_id<>b.vec_id) WHERE rank<=4")
def neighbor_topk(spark, d):
    """The four nearest of all other vectors of each vector."""
    e = table(spark, d, "embeddings")
    found = nearest_references(e, e, "vec_id", "embedding", 4)
    return found.withColumn("dist", r6(F.col("dist")))


def _farthest(keep: int) -> str:
    """A round a point; each holds every vector's least distance to what is chosen."""
    d2 = "list_sum(list_transform(list_zip(e.e,c.e), lambda p: (p[1]-p[2])*(p[1]-p[2])))"
    first = "e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings), c0 AS MATERIALIZED (SELECT 0 step, vec_id, e FROM e ORDER BY vec_id LIMIT 1), c1 AS MATERIALIZED (SELECT 1 step, vec_id, e FROM e ORDER BY vec_id DESC LIMIT 1)"
    parts = [first, f"l0 AS MATERIALIZED (SELECT e.vec_id, {d2} l FROM e, c0 c)", f"l1 AS MATERIALIZED (SELECT e.vec_id, least(l, {d2}) l FROM e JOIN l0 USING (vec_id), c1 c)"]
    taken = "SELECT vec_id FROM c0 UNION ALL SELECT vec_id FROM c1"
    for k in range(2, keep):
        parts.append(f"c{k} AS MATERIALIZED (SELECT {k} step, vec_id, e FROM e JOIN l{k - 1} USING (vec_id) WHERE vec_id NOT IN ({taken}) ORDER BY l DESC, vec_id LIMIT 1)")
        parts.append(f"l{k} AS MATERIALIZED (SELECT e.vec_id, least(l, {d2}) l FROM e JOIN l{k - 1} USING (vec_id), c{k} c)")
        taken += f" UNION ALL SELECT vec_id FROM c{k}"
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT vec_id, step FROM c{k}" for k in range(keep))


def _covered(keep: int) -> str:
    """A round a brand; each holds the best score of every type so far."""
    parts = ["s AS MATERIALIZED (SELECT p_brand, p_type, sum(p_size)/500 score FROM part GROUP BY 1,2)", "b0 AS MATERIALIZED (SELECT DISTINCT p_type, 0.0::DOUBLE best FROM s)"]
    for k in range(keep):
        parts.append(f"c{k} AS MATERIALIZED (SELECT {k} step, p_brand, round(sum(greatest(score,best)-best),9) gain FROM s JOIN b{k} USING (p_type) GROUP BY p_brand ORDER BY gain DESC, p_brand LIMIT 1)")
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT p_type, greatest(best, coalesce(score,0)) best FROM b{k} LEFT JOIN (SELECT p_type, score FROM s JOIN c{k} USING (p_brand)) USING (p_type))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT step, p_brand, gain FROM c{k} WHERE gain>1e-8" for k in range(keep))


@query("farthest_point_select", _farthest(40))
def farthest_point_select(spark, d):
    """L4: 40 vectors."""
    return farthest_points(table(spark, d, "embeddings"), "vec_id", "embedding", 40).withColumn("step", F.col("step").cast("int"))


@query("greedy_coverage_select", _covered(8))
def greedy_coverage_select(spark, d):
    """Eight brands that cover part types best by their share of the size."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg((F.sum("p_size") / 500).alias("score"))
    found = greedy_coverage(p, "p_brand", "p_type", "score", 8)
    return spark.createDataFrame([(i, v, float(g)) for i, (v, g) in enumerate(found)], "step int, p_brand string, gain double")


@query("queue_latest_wins", f"SELECT event_id, greatest(n-4,0) dropped FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r, count(*) OVER (PARTITION BY user_id) n FROM ({E})) WHERE r<=4")
def queue_latest_wins(spark, d):
    """T1 on one batch: capacity 4, the oldest dropped."""
    return latest_wins(events(spark, d), "user_id", "event_id", 4).select("event_id", "dropped")


@query("stream_tracker", f"WITH RECURSIVE r AS (SELECT user_id, event_id, t, value, row_number() OVER ({O}) i FROM ({E})), s AS (SELECT user_id, i, event_id, t kt, value kv, TRUE k FROM r WHERE i=1 UNION ALL SELECT user_id, i, event_id, CASE WHEN c THEN t ELSE kt END, CASE WHEN c THEN value ELSE kv END, c FROM (SELECT r.user_id, r.i, r.event_id, r.t, r.value, s.kt, s.kv, (abs(r.value-s.kv)>40 OR r.t-s.kt>=86400000000) c FROM s JOIN r ON r.user_id=s.user_id AND r.i=s.i+1)) SELECT user_id, event_id, k integrated FROM s")
def stream_tracker(spark, d):
    """T5 on a stream: the events table replayed from files, all that is available."""
    home = scratch(spark, "stream")
    events(spark, d).select("user_id", "t", "event_id", "value").write.parquet(f"{home}/in")
    frames = spark.readStream.schema("user_id long, t long, event_id long, value double").parquet(f"{home}/in")
    run = tracker(frames, "user_id", 40.0, 86_400_000_000).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out")
