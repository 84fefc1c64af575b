"""Queries of gates: the quality columns come from `lineitem`, `part` and the raster of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import gates
from plumbline.operators.relational import in_row_order, running_sums
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import G, grid

Q = "SELECT l_orderkey, l_linenumber, l_discount*2 fit, l_tax*3 ov, l_discount/2 rmse, 0.4+l_tax*3 col, l_quantity*2 score, l_quantity tilt, l_quantity/25 shift, l_quantity turn FROM lineitem"


def quality(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 2).alias("fit"), (F.col("l_tax") * 3).alias("ov"), (F.col("l_discount") / 2).alias("rmse"), (0.4 + F.col("l_tax") * 3).alias("col"), (q * 2).alias("score"), q.alias("tilt"), (q / 25).alias("shift"), q.alias("turn"))


@query("alignment_gates", f"SELECT count(*) n, count(*) FILTER (fit>=0.07 AND ov>=0.08 AND rmse<=0.045 AND shift<=1.2 AND turn<=35) trajectory, count(*) FILTER (fit>=0.1 AND ov>=0.1 AND rmse<=0.04 AND tilt<=45 AND score>=48) phase, count(*) FILTER (fit>=0.12 AND ov>=0.12 AND rmse<=0.035 AND col>=0.52 AND score>=55 AND shift<=0.75 AND turn<=20) loop FROM ({Q})")
def alignment_gates(spark, d):
    """how many alignments pass as a trajectory's, a phase's, a loop's."""
    m = {n: F.col(c) for n, c in (("fitness", "fit"), ("overlap", "ov"), ("rmse", "rmse"), ("colour", "col"), ("score", "score"), ("tilt", "tilt"), ("shift", "shift"), ("turn", "turn"))}
    passed = [F.count_if(gates.alignment_acceptable(limits, **m)).alias(n) for n, limits in (("trajectory", gates.TRAJECTORY), ("phase", gates.PHASE), ("loop", gates.LOOP))]
    return quality(spark, d).agg(F.count("*").alias("n"), *passed)


H = "SELECT l_partkey loop, count(*) FILTER (l_quantity<=30) sup, count(*) FILTER (l_quantity>49.5) fre, count(*) FILTER (l_quantity BETWEEN 30.01 AND 49.5) occ, count(DISTINCT l_suppkey) FILTER (l_quantity<=30) views, avg(l_tax)*2 dia, 1-avg(l_discount) coh, avg(l_discount)/10 res FROM lineitem GROUP BY 1"
DECIDED = f"SELECT loop, dia, CASE WHEN res<=greatest(0.01,greatest(dia,0.01)*0.03) AND coh>=0.7 THEN 'planar' ELSE 'freeform' END shape, CASE WHEN fre/greatest(sup+fre+occ,1)>0.01 THEN 'preserve_opening' WHEN dia>0.12 THEN 'preserve_too_large' WHEN sup/greatest(sup+fre+occ,1)>=0.6 AND views>=2 THEN 'fill_measured' WHEN occ/greatest(sup+fre+occ,1)>=0.25 AND sup/greatest(sup+fre+occ,1)<0.6 THEN 'preserve_occluded' WHEN coh>=0.85 AND res<=greatest(0.02,dia*0.04) AND fre=0 THEN 'fill_inferred' ELSE 'preserve_unknown' END decision FROM ({H})"


def decided(spark, d):
    """Means are sums in row order over counts: a part whose mean lies on a limit is then decided as SQL decides it on one thread, whatever the partitions."""
    q = F.col("l_quantity")
    lines = in_row_order(table(spark, d, "lineitem")).select(F.col("l_partkey").alias("loop"), "l_suppkey", "l_quantity", "l_tax", "l_discount", "_file", "_row")
    summed = running_sums(lines, "loop", ["_file", "_row"], ["l_tax", "l_discount"])

    def mean(c):
        return F.max(F.when(F.col("_last"), F.col(f"_sum_{c}"))) / F.count(c)

    h = summed.groupBy("loop").agg(F.count_if(q <= 30).alias("sup"), F.count_if(q > 49.5).alias("fre"), F.count_if(q.between(30.01, 49.5)).alias("occ"), F.countDistinct(F.when(q <= 30, F.col("l_suppkey"))).alias("views"), (mean("l_tax") * 2).alias("dia"), (1 - mean("l_discount")).alias("coh"), (mean("l_discount") / 10).alias("res"))
    decision = gates.hole_decision(F.col("sup"), F.col("fre"), F.col("occ"), F.col("views"), F.col("dia"), F.col("coh"), F.col("res"), 0.01, fill_inferred=True)
    return h.select("loop", "dia", gates.planar(F.col("dia"), F.col("res"), F.col("coh"), 0.01).alias("shape"), decision.alias("decision"))


@query("hole_decisions", f"SELECT loop, shape, decision FROM ({DECIDED})")
def hole_decisions(spark, d):
    """Parts as holes, their lines as samples; six outcomes in order, planar or freeform."""
    return decided(spark, d).select("loop", "shape", "decision")


@query("repair_summary", f"SELECT count(*) FILTER (starts_with(decision,'fill_') AND dia<0.08) holes_filled, count(*) FILTER (starts_with(decision,'fill_') AND dia>=0.08) authorized_skipped, count(*) FILTER (decision='preserve_opening') openings_preserved, count(*) FILTER (decision='preserve_occluded') occluded_preserved, count(*) FILTER (decision='preserve_unknown') unknown_preserved, count(*) FILTER (decision='preserve_too_large') large_preserved FROM ({DECIDED})")
def repair_summary(spark, d):
    """A17."""
    return gates.repair_summary(decided(spark, d).withColumn("applied", F.col("dia") < 0.08), "decision", "applied")


@query("reliable_points", "WITH s AS (SELECT * FROM lineitem WHERE l_discount*50<=4 AND l_quantity>=2) SELECT l_returnflag, l_linestatus, count(*) n, round(avg(l_discount*50),6) error, round(avg(l_quantity),6) track FROM s WHERE l_returnflag||l_linestatus IN (SELECT l_returnflag||l_linestatus FROM s GROUP BY 1 HAVING count(*)>=100) GROUP BY 1,2")
def reliable_points(spark, d):
    """Points of an error of 4 pixels at most, seen twice, of solutions with a hundred of them."""
    p = table(spark, d, "lineitem").withColumn("error", F.col("l_discount") * 50).withColumn("solution", F.concat("l_returnflag", "l_linestatus"))
    found = gates.reliable_points(p, "solution", "error", "l_quantity")
    return found.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.avg("error")).alias("error"), r6(F.avg("l_quantity")).alias("track"))


@query("registration_gates", "SELECT p_brand, count(*) images, count(*) FILTER (p_size<=25) registered, CAST(greatest(3,ceil(count(*)*0.45)) AS BIGINT) needed, count(*) FILTER (p_size<=25)>=greatest(3,ceil(count(*)*0.45)) useful, coalesce(count(*)>=6 AND count(*) FILTER (p_size<=25)>=greatest(6,ceil(count(*)*0.6)) AND avg(p_size)/400<=0.08 AND avg(p_size)/2.5<=12,FALSE) aligned, coalesce(count(*) FILTER (p_size<=25)>=8 AND count(*) FILTER (p_size<=25)/count(*)>=0.55 AND avg(p_size)/5<=6 AND avg(p_size)/20<=2,FALSE) localized FROM part GROUP BY 1")
def registration_gates(spark, d):
    """brands as solutions, their parts as images."""
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("images"), F.count_if(F.col("p_size") <= 25).alias("registered"), F.avg("p_size").alias("s"))
    n, r, s = F.col("images"), F.col("registered"), F.col("s")
    return g.select("p_brand", "images", "registered", gates.useful_registrations(n).alias("needed"), (r >= gates.useful_registrations(n)).alias("useful"), gates.similarity_acceptable(n, r, s / 400, s / 2.5).alias("aligned"), gates.photo_localized(r, n, s / 5, s / 20).alias("localized"))


SEEDS = f"SELECT y//8 f, x, y%8 r, 1+v/50000 depth, 1+x/8.0 conf FROM ({G})"


@query("seed_filter", f"WITH p AS ({SEEDS}), m AS (SELECT f, median(conf) c, quantile_cont(depth,0.997) d, min(x) x0, max(x) x1, min(r) y0, max(r) y1 FROM p GROUP BY 1), n AS (SELECT a.*, (SELECT count(*) FROM p b WHERE b.f=a.f AND abs(b.x-a.x)+abs(b.r-a.r)=1 AND abs(b.depth-a.depth)>0.12*a.depth) far FROM p a) SELECT f, x, r FROM n JOIN m USING (f) WHERE far=0 AND conf>=greatest(1.5,c) AND depth<=d AND x BETWEEN x0+1 AND x1-1 AND r BETWEEN y0+1 AND y1-1 AND x%2=0 AND r%2=0")
def seed_filter(spark, d):
    """eight days of the raster are a frame."""
    g = grid(spark, d).select(F.expr("y div 8").alias("f"), "x", (F.col("y") % 8).alias("r"), (1 + F.col("v") / 50000).alias("depth"), (1 + F.col("x") / 8.0).alias("conf"))
    return gates.seed_filter(g, "f", "x", "r", "depth", "conf").select("f", "x", "r")


@query("settings_problems", "SELECT s_suppkey, problem FROM (SELECT s_suppkey, unnest([CASE WHEN NOT (v BETWEEN 5 AND 60) THEN 'voxel' END, CASE WHEN NOT f IN (5,10,15,30) THEN 'rate' END, CASE WHEN NOT (mn<mx) THEN 'range' END]) problem FROM (SELECT s_suppkey, s_acctbal/100 v, s_nationkey f, s_nationkey/10 mn, greatest(0.25,least(2,s_acctbal/4000)) mx FROM supplier)) WHERE problem IS NOT NULL")
def settings_problems(spark, d):
    """Settings cut to their limits, and the rules that still fail, those across fields included."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("v"), F.col("s_nationkey").alias("f"), (F.col("s_nationkey") / 10).alias("mn"), (F.col("s_acctbal") / 4000).alias("mx"))
    s = gates.clamped(s, {"mx": (0.25, 2.0)})
    return gates.problems(s, "s_suppkey", {"voxel": F.col("v").between(5, 60), "rate": F.col("f").isin(5, 10, 15, 30), "range": F.col("mn") < F.col("mx")})


@query("cache_states", "SELECT coalesce(w.doc_id,s.doc_id) doc_id, CASE WHEN w.doc_id IS NULL THEN 'orphaned' WHEN s.doc_id IS NULL THEN 'missing' WHEN w.fp=s.fp THEN 'current' ELSE 'stale' END state FROM (SELECT doc_id, md5(coalesce(text,'')) fp FROM documents WHERE lang<>'en') w FULL JOIN (SELECT doc_id, md5(coalesce(CASE WHEN quality=1 THEN text ELSE lang END,'')) fp FROM documents JOIN labels USING (doc_id)) s ON w.doc_id=s.doc_id")
def cache_states(spark, d):
    """What is wanted (texts not in English) against what is stored (labelled ones, those of low quality under another fingerprint)."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    fp = lambda c: F.md5(F.coalesce(c, F.lit("")))
    stored = docs.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", fp(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.col("lang"))).alias("fp"))
    return gates.cache_state(docs.where("lang <> 'en'").select("doc_id", fp(F.col("text")).alias("fp")), stored, "doc_id", "fp")


@query("packet_validity", "SELECT doc_id, coalesce(n_chars//15<=150000 AND strlen(text)=24+15*((n_chars-24)//15) AND (n_chars-24)//15>=0,FALSE) valid FROM documents")
def packet_validity(spark, d):
    """texts as packets of a header of 24 bytes and points of 15."""
    return table(spark, d, "documents").select("doc_id", gates.valid_packet(F.encode("text", "UTF-8"), F.expr("(n_chars - 24) div 15"), 24, 15, 150_000).alias("valid"))


@query("colour_coverage", f"SELECT f, count(*) n, count(*) FILTER (depth>0 AND u BETWEEN 0 AND 20 AND w BETWEEN 0 AND 6) covered FROM (SELECT f, depth, 20*((x-11.5)*depth/18+0.1)/depth+9.5 u, 20*((r-3.5)*depth/18)/depth+3 w FROM ({SEEDS})) GROUP BY 1")
def colour_coverage(spark, d):
    """pixels of a depth frame, moved to a colour camera 10 cm aside, that it sees."""
    g = grid(spark, d).select(F.expr("y div 8").alias("f"), "x", (F.col("y") % 8).alias("r"), (1 + F.col("v") / 50000).alias("depth"))
    z = F.col("depth")
    u, v = 20 * ((F.col("x") - 11.5) * z / 18 + 0.1) / z + 9.5, 20 * ((F.col("r") - 3.5) * z / 18) / z + 3
    return g.withColumn("ok", gates.colour_coverage(u, v, z, 21, 7)).groupBy("f").agg(F.count("*").alias("n"), F.count_if("ok").alias("covered"))
