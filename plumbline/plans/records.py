"""Queries over manifests, journals, edges and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import relational as rel
from plumbline.operators.graph import connected_components
from plumbline.plans.catalogue import query, r6, table


@query("scatter_max_labels", "SELECT source, lang, max(quality) m FROM documents JOIN labels USING(doc_id) GROUP BY 1,2")
def scatter_max_labels(spark, d):
    """A8."""
    return table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("source", "lang").agg(F.max("quality").alias("m"))


@query("scatter_add", "SELECT v, CAST(sum(q) AS DOUBLE) total, count(*) n FROM (SELECT l_partkey v, l_quantity q FROM lineitem UNION ALL SELECT l_suppkey, l_quantity FROM lineitem) GROUP BY 1")
def scatter_add(spark, d):
    """Each corner of a face gets the face's weight."""
    x = table(spark, d, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("v"), "l_quantity")
    return x.groupBy("v").agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"))


@query("rejected_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)")
def rejected_anti_join(spark, d):
    """J1."""
    return rel.without_rejected(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("owner_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>45)")
def owner_semi_join(spark, d):
    """J3, F25."""
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("pair_graph_offsets", "SELECT a.conv_id, a.turn i, b.turn j FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn-a.turn IN (1,2,4)")
def pair_graph_offsets(spark, d):
    """Pairs at given offsets, an equi-join on the other end."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    a = c.select("conv_id", F.col("turn").alias("i"), F.explode(F.array(*[F.col("turn") + k for k in (1, 2, 4)])).alias("j"))
    return a.join(c.withColumnRenamed("turn", "j"), ["conv_id", "j"]).select("conv_id", "i", "j")


@query("keep_policy_left_join", "SELECT p.n, coalesce(r_name,'') region, CASE WHEN r_name IS NULL THEN 'skipped' ELSE 'applied' END status FROM (VALUES (0),(2),(9)) p(n) LEFT JOIN region ON r_regionkey=p.n")
def keep_policy_left_join(spark, d):
    """What the policy names, and whether it is there."""
    p = spark.createDataFrame([(0,), (2,), (9,)], "n int")
    return p.join(table(spark, d, "region"), F.col("n") == F.col("r_regionkey"), "left").select("n", F.coalesce("r_name", F.lit("")).alias("region"), F.when(F.col("r_name").isNull(), "skipped").otherwise("applied").alias("status"))


@query("attempts_backfill", "SELECT doc_id, 'attempt' status FROM labels UNION ALL SELECT doc_id, 'archived' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def attempts_backfill(spark, d):
    """Attempts, and what has none."""
    l = table(spark, d, "labels").select("doc_id")
    rest = table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left_anti")
    return l.withColumn("status", F.lit("attempt")).unionByName(rest.withColumn("status", F.lit("archived")))


@query("cache_three_way_split", "SELECT CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality=1 THEN 'hit' ELSE 'rejected' END state, count(*) n FROM documents d LEFT JOIN labels l USING(doc_id) GROUP BY 1")
def cache_three_way_split(spark, d):
    """J25."""
    l = table(spark, d, "labels").select("doc_id", "quality")
    x = table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left")
    return x.groupBy(F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "hit").otherwise("rejected").alias("state")).agg(F.count("*").alias("n"))


@query("metric_gate", "SELECT l_returnflag, count(*) n, round(median(r),6) med, round(quantile_cont(r,0.9),6) p90, round(avg(CASE WHEN r<=0.06 THEN 1.0 ELSE 0 END),6) inliers, round(abs(median(b)-1),6) bias, median(r)<=0.06 AND quantile_cont(r,0.9)<=0.12 AND abs(median(b)-1)<=0.1 ok FROM (SELECT l_returnflag, abs(l_discount-l_tax) r, (1+l_discount)/(1+l_tax) b FROM lineitem) GROUP BY 1 HAVING count(*)>=256")
def metric_gate(spark, d):
    """median, 90th percentile and inlier ratio of residuals, at least 256 of them, and how far the median scale is from 1."""
    x = table(spark, d, "lineitem").select("l_returnflag", F.abs(F.col("l_discount") - F.col("l_tax")).alias("r"), ((1 + F.col("l_discount")) / (1 + F.col("l_tax"))).alias("b")).groupBy("l_returnflag")
    x = x.agg(F.count("*").alias("n"), F.median("r").alias("m"), F.percentile("r", 0.9).alias("p"), r6(F.avg(F.when(F.col("r") <= 0.06, 1.0).otherwise(0.0))).alias("inliers"), F.abs(F.median("b") - 1).alias("b")).where("n >= 256")
    return x.select("l_returnflag", "n", r6("m").alias("med"), r6("p").alias("p90"), "inliers", r6("b").alias("bias"), ((F.col("m") <= 0.06) & (F.col("p") <= 0.12) & (F.col("b") <= 0.1)).alias("ok"))


@query("median_relative_spread", "WITH m AS (SELECT p_brand, median(p_retailprice) m FROM part GROUP BY 1) SELECT p_brand, round(max(abs(p_retailprice-m)/greatest(abs(m),1e-9)),6) spread, max(abs(p_retailprice-m)/greatest(abs(m),1e-9))<=0.005 constant FROM part JOIN m USING(p_brand) GROUP BY 1")
def median_relative_spread(spark, d):
    """The largest relative distance from the median, and whether it is under half a percent."""
    x = table(spark, d, "part")
    m = x.groupBy("p_brand").agg(F.median("p_retailprice").alias("m"))
    spread = F.max(F.abs(F.col("p_retailprice") - F.col("m")) / F.greatest(F.abs("m"), F.lit(1e-9)))
    return x.join(m, "p_brand").groupBy("p_brand").agg(spread.alias("s")).select("p_brand", r6("s").alias("spread"), (F.col("s") <= 0.005).alias("constant"))


@query("target_set_difference", "SELECT p_brand, p_size FROM (SELECT DISTINCT p_brand, p_size FROM part) EXCEPT SELECT DISTINCT p_brand, p_size FROM part WHERE p_retailprice>1200")
def target_set_difference(spark, d):
    """U4."""
    p = table(spark, d, "part")
    return p.select("p_brand", "p_size").subtract(p.where("p_retailprice > 1200").select("p_brand", "p_size"))


@query("exact_dedup_fingerprint", "SELECT substr(sha256(text),1,24) fp, min(doc_id) keep, count(*) n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dedup_fingerprint(spark, d):
    """Texts by 24 hex digits of their SHA-256."""
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.substring(F.sha2("text", 256), 1, 24).alias("fp")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))


@query("dataset_fingerprint", "SELECT lang, substr(sha256(string_agg(p, '' ORDER BY b)),1,20) fp FROM (SELECT lang, substr(h,1,3) b, sha256(string_agg(h, '' ORDER BY h)) p FROM (SELECT DISTINCT lang, sha256(text) h FROM documents WHERE text IS NOT NULL) GROUP BY 1,2) GROUP BY 1")
def dataset_fingerprint(spark, d):
    """A digest over the digests of 4096 parts, each over its sorted digests; a part holds one in 4096 of a language's texts."""
    x = table(spark, d, "documents").where("text IS NOT NULL").select("lang", F.sha2("text", 256).alias("h")).distinct()

    def over(c):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda v: v["h"]), ""), 256)

    parts = x.groupBy("lang", F.substring("h", 1, 3).alias("b")).agg(over(F.struct("h")).alias("h"))
    return parts.groupBy("lang").agg(F.substring(over(F.struct("b", "h")), 1, 20).alias("fp"))


TRIANGLES = "SELECT o_orderkey t, o_custkey%200 a, (o_custkey*7+1)%200 b, (o_orderkey*3+2)%200 c FROM orders"
EDGES = f"SELECT t, least(u,v) lo, greatest(u,v) hi FROM (SELECT t,a u,b v FROM ({TRIANGLES}) UNION ALL SELECT t,b,c FROM ({TRIANGLES}) UNION ALL SELECT t,c,a FROM ({TRIANGLES})) WHERE u<>v"


def edges(spark, d):
    """Edges of triangles made of order and customer keys; in the SQL they are made the same way."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tri = table(spark, d, "orders").select(k.alias("t"), (c % 200).alias("a"), ((c * 7 + 1) % 200).alias("b"), ((k * 3 + 2) % 200).alias("c"))
    pairs = F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ("ab", "bc", "ca")]))
    return tri.withColumn("p", pairs).select("t", F.least("p.u", "p.v").alias("lo"), F.greatest("p.u", "p.v").alias("hi")).where("lo <> hi")


@query("edge_pairs", f"SELECT lo, hi, p t1, t t2 FROM (SELECT *, lag(t) OVER (PARTITION BY lo,hi ORDER BY t) p FROM (SELECT DISTINCT * FROM ({EDGES}))) WHERE p IS NOT NULL")
def edge_pairs(spark, d):
    """Consecutive faces of an edge: k faces give k - 1 pairs."""
    x = edges(spark, d).distinct().withColumn("p", F.lag("t").over(Window.partitionBy("lo", "hi").orderBy("t")))
    return x.where("p IS NOT NULL").select("lo", "hi", F.col("p").alias("t1"), F.col("t").alias("t2"))


@query("nonmanifold_edges", f"SELECT lo, hi, count(*) faces FROM (SELECT DISTINCT * FROM ({EDGES})) GROUP BY 1,2 HAVING count(*)>2")
def nonmanifold_edges(spark, d):
    """G6, J19."""
    return edges(spark, d).distinct().groupBy("lo", "hi").agg(F.count("*").alias("faces")).where("faces > 2")


@query("connected_components", "WITH RECURSIVE e AS (SELECT c.c_custkey a, p.c_custkey b FROM customer c JOIN customer p ON p.c_custkey=c.c_custkey-13*(1+c.c_custkey%3)), n AS (SELECT a v FROM e UNION SELECT b FROM e), u AS (SELECT a,b FROM e UNION SELECT b,a FROM e), r AS (SELECT v, v m FROM n UNION SELECT u.b, r.m FROM r JOIN u ON u.a=r.v) SELECT v node, min(m) component FROM r GROUP BY 1")
def components_of_customers(spark, d):
    """By rounds of least neighbours and jumps."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("a"))
    e = c.withColumn("b", F.col("a") - 13 * (1 + F.col("a") % 3)).join(c.withColumnRenamed("a", "b"), "b")
    return connected_components(e, "a", "b")


@query("canonical_cycle", "WITH a AS (SELECT doc_id, string_split(lang||'-'||source,'') l FROM documents) SELECT doc_id, list_min(list_transform(range(len(l)), lambda i: array_to_string(l[i+1:] || l[:i],''))) form FROM a")
def canonical_cycle(spark, d):
    """The least rotation of a cyclic list of tokens."""
    s = F.concat("lang", F.lit("-"), "source")
    x = table(spark, d, "documents").select("doc_id", s.alias("s"))
    rotate = F.expr("array_min(transform(sequence(0, length(s) - 1), i -> concat(substring(s, i + 1), substring(s, 1, i))))")
    return x.select("doc_id", rotate.alias("form"))


@query("halton_points", "WITH RECURSIVE i AS (SELECT range+1 i FROM range(256)), d AS (SELECT i, i r, 0 k, 0.0::DOUBLE v FROM i UNION ALL SELECT i, r//2, k+1, v+(r%2)/pow(2,k+1) FROM d WHERE r>0), e AS (SELECT i, i r, 0 k, 0.0::DOUBLE v FROM i UNION ALL SELECT i, r//3, k+1, v+(r%3)/pow(3,k+1) FROM e WHERE r>0) SELECT i, round(a,6) x, round(b,6) y FROM (SELECT i, max(v) a FROM d GROUP BY 1) JOIN (SELECT i, max(v) b FROM e GROUP BY 1) USING(i) WHERE a+b<=1")
def halton_points(spark, d):
    """Points of the bases 2 and 3 inside a triangle."""
    x = spark.range(1, 257).select(F.col("id").alias("i"), geom.halton(F.col("id"), 2, 9).alias("a"), geom.halton(F.col("id"), 3, 6).alias("b"))
    return x.where("a + b <= 1").select("i", r6("a").alias("x"), r6("b").alias("y"))


@query("localization_score", "SELECT s_suppkey, round(100*(0.5*least(greatest(s_acctbal,0)/5000,1)+0.5*(s_nationkey%10)/9.0),4) score, CASE WHEN 0.5*least(greatest(s_acctbal,0)/5000,1)+0.5*(s_nationkey%10)/9.0>=0.7 THEN 'high' WHEN 0.5*least(greatest(s_acctbal,0)/5000,1)+0.5*(s_nationkey%10)/9.0>=0.4 THEN 'medium' ELSE 'low' END AS label FROM supplier")
def localization_score(spark, d):
    """A20."""
    s = 0.5 * geom.saturating(F.col("s_acctbal"), 5000.0) + 0.5 * (F.col("s_nationkey") % 10) / 9.0
    return table(spark, d, "supplier").select("s_suppkey", F.round(100 * s, 4).alias("score"), F.when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low").alias("label"))
