"""Queries of scalar functions: matrices and quaternions from `embeddings`, text, time, JSON, arrays and maps from the other tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import geom, rigid
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, O, events, take
from plumbline.plans.points import P, points

A = f"SELECT vec_id, x/l ax, y/l ay, z/l az, c*12 an FROM (SELECT *, greatest(sqrt(x*x+y*y+z*z),1e-12) l FROM ({P}))"
NINE = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) m{i}" for i in range(9)) + " FROM embeddings"


def turned(p):
    """points with `m`, nine columns of a rotation about their own direction by twelve times their fourth number."""
    axis = rigid.unit([F.col(c) for c in "xyz"])
    p = p.withColumns({f"a{i}": c for i, c in enumerate(axis)}).withColumn("an", F.col("c") * 12)
    return p, geom.axis_rotation(tuple(F.col(f"a{i}") for i in range(3)), F.col("an"))


def nine(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"m{i}") for i in range(9)]), [F.col(f"m{i}") for i in range(9)]


@query("quaternion_of_matrix", f"SELECT vec_id, round(s*w,6)+0.0 w, round(s*x,6)+0.0 x, round(s*y,6)+0.0 y, round(s*z,6)+0.0 z FROM (SELECT *, CASE WHEN 4*w*w>1 THEN sign(w) WHEN x*x>=y*y AND x*x>=z*z THEN sign(x) WHEN y*y>=z*z THEN sign(y) ELSE sign(z) END s FROM (SELECT vec_id, cos(an/2) w, ax*sin(an/2) x, ay*sin(an/2) y, az*sin(an/2) z FROM ({A})))")
def quaternion_of_matrix(spark, d):
    """M3: the quaternion of the rotation matrix about each point's direction."""
    p, m = turned(points(spark, d))
    p = p.select("vec_id", *[c.alias(f"m{i}") for i, c in enumerate(m)])
    q = rigid.quaternion_of([F.col(f"m{i}") for i in range(9)])
    return p.select("vec_id", q.alias("q")).select("vec_id", *[(r6(F.col("q")[i]) + 0.0).alias(n) for i, n in enumerate("wxyz")])


@query("matrix_of_quaternion", f"SELECT vec_id, round(1-2*(y*y+z*z),6)+0.0 xx, round(2*(x*y-z*w),6)+0.0 xy, round(2*(y*z+x*w),6)+0.0 zy FROM (SELECT vec_id, cos(an/2) w, ax*sin(an/2) x, ay*sin(an/2) y, az*sin(an/2) z FROM ({A}))")
def matrix_of_quaternion(spark, d):
    """M4."""
    p, _ = turned(points(spark, d))
    m = rigid.rotation_of([F.cos(F.col("an") / 2), *[F.col(f"a{i}") * F.sin(F.col("an") / 2) for i in range(3)]])
    return p.select("vec_id", *[(r6(m[i]) + 0.0).alias(n) for i, n in ((0, "xx"), (1, "xy"), (7, "zy"))])


@query("rigid_inverse", f"SELECT vec_id, round(-x,6)+0.0 x, round(-y,6)+0.0 y, round(-z,6)+0.0 z FROM ({P})")
def rigid_inverse(spark, d):
    """M6: the inverse of a motion, times the motion, applied to a point; here to a point turned and shifted by the motion's own shift, back to minus that shift."""
    p, m = turned(points(spark, d))
    p = p.select("vec_id", "x", "y", "z", *[c.alias(f"m{i}") for i, c in enumerate(m)])
    t = [F.col(c) for c in "xyz"]
    full = [*[F.col(f"m{i}") for i in range(3)], t[0], *[F.col(f"m{i}") for i in range(3, 6)], t[1], *[F.col(f"m{i}") for i in range(6, 9)], t[2], *map(F.lit, (0.0, 0.0, 0.0, 1.0))]
    there_and_back = rigid.product(rigid.rigid_inverse(full), full, 4)
    r, s = [there_and_back[4 * i + j] for i in range(3) for j in range(3)], [there_and_back[4 * i + 3] for i in range(3)]
    back = geom.apply_rigid(r, s, [-c for c in t])
    return p.select("vec_id", *[(r6(c) + 0.0).alias(n) for c, n in zip(back, "xyz")])


@query("determinant_product", f"SELECT vec_id, round(d*d,9) d2 FROM (SELECT vec_id, m0*(m4*m8-m5*m7)-m1*(m3*m8-m5*m6)+m2*(m3*m7-m4*m6) d FROM ({NINE}))")
def determinant_product(spark, d):
    """M7: the determinant of a 3 x 3 matrix times itself is the square of its determinant."""
    e, m = nine(spark, d)
    return e.select("vec_id", F.round(rigid.determinant(rigid.product(m, m, 3)), 9).alias("d2"))


@query("symmetric_eigenvalues", f"SELECT vec_id, round(m0+m4+m8,6)+0.0 total, round(m0*m4+m0*m8+m4*m8-m1*m1-m2*m2-m5*m5,6)+0.0 pairs, round(m0*(m4*m8-m5*m5)-m1*(m1*m8-m5*m2)+m2*(m1*m5-m4*m2),6)+0.0 whole FROM ({NINE})")
def symmetric_eigenvalues(spark, d):
    """Eigenvalues of a symmetric 3 x 3 matrix; their sum, sum of pairs and product are the matrix's invariants."""
    e, m = nine(spark, d)
    v = rigid.symmetric_eigenvalues(m[0], m[1], m[2], m[4], m[5], m[8])
    x = e.select("vec_id", *[c.alias(f"v{i}") for i, c in enumerate(v)])
    a, b, c = F.col("v0"), F.col("v1"), F.col("v2")
    return x.select("vec_id", (r6(a + b + c) + 0.0).alias("total"), (r6(a * b + a * c + b * c) + 0.0).alias("pairs"), (r6(a * b * c) + 0.0).alias("whole"))


@query("six_number_rotation", f"WITH s AS (SELECT vec_id, m0+1 a, m1 b, m2 c, m3 d, m4+1 e, m5 f FROM ({NINE})), u AS (SELECT *, sqrt(a*a+b*b+c*c) l FROM s), v AS (SELECT vec_id, a/l a, b/l b, c/l c, d-(a*d+b*e+c*f)/(l*l)*a d, e-(a*d+b*e+c*f)/(l*l)*b e, f-(a*d+b*e+c*f)/(l*l)*c f FROM u), w AS (SELECT vec_id, a, b, c, d/sqrt(d*d+e*e+f*f) d, e/sqrt(d*d+e*e+f*f) e, f/sqrt(d*d+e*e+f*f) f FROM v) SELECT vec_id, round(a,6)+0.0 xx, round(e,6)+0.0 yy, round(a*e-b*d,6)+0.0 zz, round(degrees(acos(greatest(-1,least(1,(a+e+a*e-b*d-1)/2)))),5) angle FROM w")
def six_number_rotation(spark, d):
    """M5: the rotation of six numbers added to those of the identity."""
    e, m = nine(spark, d)
    r = rigid.six_numbers_rotation([m[0] + 1, m[1], m[2]], [m[3], m[4] + 1, m[5]])
    return e.select("vec_id", *[(r6(r[i]) + 0.0).alias(n) for i, n in ((0, "xx"), (4, "yy"), (8, "zz"))], F.round(geom.rotation_angle(r[0] + r[4] + r[8]), 5).alias("angle"))


@query("pose_corrections", f"WITH b AS (SELECT label, least(1,0.05/greatest(sqrt(m0*m0+m1*m1+m2*m2),1e-12)) k, sqrt(m0*m0+m1*m1+m2*m2) l, 1+greatest(-0.12,least(0.12,m3)) a, greatest(-0.12,least(0.12,m4)) b, greatest(-0.12,least(0.12,m5)) c, greatest(-0.12,least(0.12,m6)) d, 1+greatest(-0.12,least(0.12,m7)) e, greatest(-0.12,least(0.12,m8)) f FROM ({NINE}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)), u AS (SELECT label, k*l l, a/sqrt(a*a+b*b+c*c) a, b/sqrt(a*a+b*b+c*c) b, c/sqrt(a*a+b*b+c*c) c, d, e, f FROM b), v AS (SELECT label, l, a, b, c, d-(a*d+b*e+c*f)*a d, e-(a*d+b*e+c*f)*b e, f-(a*d+b*e+c*f)*c f FROM u), w AS (SELECT label, l, a, b, d/sqrt(d*d+e*e+f*f) d, e/sqrt(d*d+e*e+f*f) e FROM v), x AS (SELECT label, l, degrees(acos(greatest(-1,least(1,(a+e+a*e-b*d-1)/2)))) g FROM w) SELECT label, round(max(l),6) max_translation, round(avg(l),6) mean_translation, round(max(g),5) max_rotation, round(avg(g),5) mean_rotation FROM x GROUP BY 1")
def pose_corrections(spark, d):
    """Corrections cut to 5 cm and 0.12 in each rotation number; their largest and mean translation and rotation by phase (label)."""
    e, m = nine(spark, d)
    length = geom.norm(*m[:3])
    r = [geom.clip(c, -0.12, 0.12) for c in m[3:]]
    turn = rigid.six_numbers_rotation([1 + r[0], r[1], r[2]], [r[3], 1 + r[4], r[5]])
    x = e.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    x = x.select("label", (length * F.least(F.lit(1.0), 0.05 / F.greatest(length, F.lit(1e-12)))).alias("l"), geom.rotation_angle(turn[0] + turn[4] + turn[8]).alias("g"))
    return x.groupBy("label").agg(r6(F.max("l")).alias("max_translation"), r6(F.avg("l")).alias("mean_translation"), F.round(F.max("g"), 5).alias("max_rotation"), F.round(F.avg("g"), 5).alias("mean_rotation"))


@query("plane_axes", f"WITH n AS (SELECT vec_id, x/l x, y/l y, z/l z FROM (SELECT *, sqrt(x*x+y*y+z*z) l FROM ({P}))), k AS (SELECT *, CASE WHEN abs(x)<=abs(y) AND abs(x)<=abs(z) THEN 0 WHEN abs(y)<=abs(z) THEN 1 ELSE 2 END w FROM n), u AS (SELECT *, CASE w WHEN 0 THEN 0.0 WHEN 1 THEN -z ELSE y END a, CASE w WHEN 0 THEN z WHEN 1 THEN 0.0 ELSE -x END b, CASE w WHEN 0 THEN -y WHEN 1 THEN x ELSE 0.0 END c FROM k), v AS (SELECT *, sqrt(a*a+b*b+c*c) q FROM u) SELECT vec_id, round(a/q,6)+0.0 ux, round(b/q,6)+0.0 uy, round(c/q,6)+0.0 uz, round((y*c-z*b)/q,6)+0.0 vx FROM v")
def plane_axes(spark, d):
    """M17."""
    u, v = rigid.plane_axes([F.col(c) for c in "xyz"])
    return points(spark, d).select("vec_id", *[(r6(c) + 0.0).alias(f"u{n}") for c, n in zip(u, "xyz")], (r6(v[0]) + 0.0).alias("vx"))


@query("cosine_distance", "SELECT vec_id, round(1-list_dot_product(CAST(embedding AS DOUBLE[]),CAST(b AS DOUBLE[])),6) distance FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) b FROM embeddings) WHERE b IS NOT NULL")
def cosine_distance(spark, d):
    """Of each descriptor and the one before it in its phase."""
    x = table(spark, d, "embeddings").withColumn("b", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("b IS NOT NULL")
    return x.select("vec_id", r6(rigid.cosine_distance("embedding", "b")).alias("distance"))


@query("memory_tiers", "SELECT c_custkey, CASE WHEN g<=8.5 THEN 720 WHEN g<=12.5 THEN 960 WHEN g<=16.5 THEN 1280 ELSE 1600 END pixels, CASE WHEN g<=8.5 THEN 1000000 WHEN g<=12.5 THEN 2000000 WHEN g<=16.5 THEN 3000000 ELSE 4000000 END splats FROM (SELECT c_custkey, abs(c_acctbal)/400 g FROM customer)")
def memory_tiers(spark, d):
    """Limits of image size and splats by memory; the balance stands for it."""
    g = F.abs("c_acctbal") / 400

    def tier(*values):  # fixed values: the borders in GiB and what fits under each
        return F.when(g <= 8.5, values[0]).when(g <= 12.5, values[1]).when(g <= 16.5, values[2]).otherwise(values[3])

    return table(spark, d, "customer").select("c_custkey", tier(720, 960, 1280, 1600).alias("pixels"), tier(1_000_000, 2_000_000, 3_000_000, 4_000_000).alias("splats"))


@query("path_parts", r"SELECT doc_id, regexp_extract(p,'([^/]*?)(\.[^./]*)?$',1) stem, lower(regexp_extract(p,'(\.[^./]*)$',1)) extension, regexp_replace(p,'/[^/]*$','') parent, CASE WHEN contains(lower(p),'src1') THEN 'first' WHEN starts_with(lower(p),'src') THEN 'other' ELSE 'none' END stage FROM (SELECT doc_id, replace(coalesce(source,'')||'\'||coalesce(lang,'')||'\Doc '||doc_id||'.v2.TXT','\','/') p FROM documents)")
def path_parts(spark, d):
    """A path with either separator: its stem, extension, folder, and a key by what it contains."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("\\"), F.coalesce("lang", F.lit("")), F.lit("\\Doc "), F.col("doc_id").cast("string"), F.lit(".v2.TXT"))
    x = table(spark, d, "documents").select("doc_id", F.replace(path, F.lit("\\"), F.lit("/")).alias("p"))
    low = F.lower("p")
    key = F.when(F.contains(low, F.lit("src1")), "first").when(F.startswith(low, F.lit("src")), "other").otherwise("none")
    return x.select("doc_id", F.regexp_extract("p", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.lower(F.regexp_extract("p", r"(\.[^./]*)$", 1)).alias("extension"), F.regexp_replace("p", "/[^/]*$", "").alias("parent"), key.alias("stage"))


@query("formatted_numbers", "SELECT doc_id, format('{:,}', n_chars*1000) AS count, CASE WHEN n_chars>=3600 THEN printf('%d:%02d:%02d', n_chars//3600, n_chars%3600//60, n_chars%60) ELSE printf('%d:%02d', n_chars//60, n_chars%60) END duration, CASE WHEN n_chars>=1024 THEN printf('%.1f KB', floor(n_chars/1024.0*10+0.5)/10) ELSE printf('%d B', n_chars) END size, printf('%d%%', least(100, n_chars*100//5000)) share FROM documents WHERE n_chars IS NOT NULL")
def formatted_numbers(spark, d):
    """A count with separators, a duration, a size, a percentage."""
    n = F.col("n_chars")
    x = table(spark, d, "documents").where("n_chars IS NOT NULL")
    hours = F.format_string("%d:%02d:%02d", F.expr("n_chars div 3600"), F.expr("n_chars % 3600 div 60"), n % 60)
    duration = F.when(n >= 3600, hours).otherwise(F.format_string("%d:%02d", F.expr("n_chars div 60"), n % 60))
    size = F.when(n >= 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%d B", n))
    return x.select("doc_id", F.format_number(n * 1000, 0).alias("count"), duration.alias("duration"), size.alias("size"), F.format_string("%d%%", F.least(F.lit(100), F.expr("n_chars * 100 div 5000"))).alias("share"))


@query("json_documents", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props,'$.k') AS BIGINT),-1) k, coalesce(json_extract_string(props,'$.a.b'),'none') b, CASE WHEN props IS NULL THEN '{\"k\":null,\"type\":\"'||event_type||'\",\"user\":'||user_id||'}' ELSE '{\"k\":'||coalesce(json_extract_string(props,'$.k'),'null')||',\"type\":\"'||event_type||'\",\"user\":'||user_id||'}' END dump FROM events")
def json_documents(spark, d):
    """Paths with defaults, and a compact document with its keys in order."""
    k = F.get_json_object("props", "$.k")
    doc = F.to_json(F.struct(k.cast("long").alias("k"), F.col("event_type").alias("type"), F.col("user_id").alias("user")), {"ignoreNullFields": "false"})
    return table(spark, d, "events").select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS long)"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("b"), doc.alias("dump"))


@query("elapsed_times", f"SELECT event_id, round(t/1e6,6) AS seconds, strftime(ts,'%Y-%m-%dT%H:%M:%S')||'Z' stamp, greatest(0, CAST(floor((t-lag(t,1,t) OVER ({O}))/1e6) AS BIGINT)-60) elapsed FROM ({E})")
def elapsed_times(spark, d):
    """Microseconds as seconds, RFC 3339 text, elapsed seconds past a minute, never negative."""
    back = F.floor((F.col("t") - F.lag("t", 1).over(take())) / 1e6)
    return events(spark, d).select("event_id", F.round(F.col("t") / 1e6, 6).alias("seconds"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("stamp"), F.greatest(F.lit(0).cast("long"), F.coalesce(back, F.lit(0)).cast("long") - 60).alias("elapsed"))


@query("array_operations", "SELECT vec_id, list_position(v,list_max(v))-1 argmax, list_position(v,list_min(v))-1 argmin, len(list_filter(v, lambda x: x>0)) positive, array_to_string(list_transform(range(5), lambda i: CAST(CAST(floor(i*7/4) AS INTEGER) AS VARCHAR)),',') places, round(v[8],6) rolled, round(v[1],6) edge, len(v)*3 tiled FROM (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) v FROM embeddings)")
def array_operations(spark, d):
    """The first place of the largest and the least, how many are over zero, even places, a roll by one, padding with the edge, tiling."""
    v = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    x = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    places = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * 7 / 4).cast("string")))
    rolled = F.concat(F.slice("v", -1, 1), F.slice("v", 1, 7))
    padded = F.concat(F.slice("v", 1, 1), F.col("v"))
    return x.select(
        "vec_id",
        (F.array_position("v", F.array_max("v")) - 1).alias("argmax"),
        (F.array_position("v", F.array_min("v")) - 1).alias("argmin"),
        F.size(F.filter("v", lambda y: y > 0)).cast("long").alias("positive"),
        places.alias("places"),
        r6(rolled[0]).alias("rolled"),
        r6(padded[0]).alias("edge"),
        F.size(F.flatten(F.array_repeat("v", 3))).cast("long").alias("tiled"),
    )


@query("map_operations", f"SELECT user_id, count(*) FILTER (event_type='view') views, count(*) FILTER (event_type='refund') refunds, count(DISTINCT event_type) kinds, max_by(event_type,(t,event_id)) AS last FROM ({E}) GROUP BY 1")
def map_operations(spark, d):
    """Counts under a key with 0 for what is not there, and the last write."""
    per = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.struct("t", "event_id")).alias("at"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.max_by("event_type", "at").alias("last"))  # a few kinds a user
    at = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return m.select("user_id", at("view").alias("views"), at("refund").alias("refunds"), F.size("m").cast("long").alias("kinds"), "last")


@query("stable_coordinates", "SELECT vec_id, printf('%a', CAST(embedding[1] AS DOUBLE)+0.0) x, printf('%a', abs(CAST(embedding[2] AS DOUBLE))*0) y FROM embeddings")
def stable_coordinates(spark, d):
    """Hexadecimal text of numbers, the same for 0 and -0."""
    stable = lambda c: F.when(c == 0, F.lit("0x0p+0")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%a", c), r"\.0p", "p"), r"p(\d)", r"p+$1"))
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", stable(v[0].cast("double")).alias("x"), stable(F.abs(v[1].cast("double")) * 0).alias("y"))
