"""Queries that write tables in the archive's formats to the shared folder and read them back with their readers: the rows must come through."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators.graph import scratch
from plumbline.plans.catalogue import query, r6, table
from plumbline.plans.frames import E, G, events, grid
from plumbline.plans.points import P, points
from plumbline.plans.surface import TRIS, sheet
from plumbline.sources import binary, packets, phase, publish, readers, store

LENS = {"width": 24, "height": 8, "fx": 18.0, "fy": 18.0, "cx": 11.5, "cy": 3.5}
MANIFEST = {"schemaVersion": 3, "camera": LENS | {"depth_scale": 1000.0, "max_depth_m": 60.0}, "rgbCamera": LENS | {"model": "pinhole", "distortion": []}, "rgbFromDepth": np.eye(4).ravel().tolist(), "imu": {"coordinateFrame": "depth_camera", "path": "imu.csv"}}


def folder(spark) -> str:
    return scratch(spark, "archive")


def written_phase(spark, d) -> str:
    """All events as the frames of a phase: errors are rejected, purchases have no pose, views are also IMU samples."""
    home, e = folder(spark), events(spark, d)
    publish.replace_document(spark, f"{home}/phase.json", MANIFEST)
    e.select(F.col("event_id").alias("index"), F.col("event_id").alias("source_sequence"), F.col("t").alias("timestamp_us"), F.lit("depth/x").alias("depth_path"), F.lit("color/x").alias("color_path")).write.option("header", True).csv(f"{home}/frames.csv")
    pose = F.array(*[F.lit(1.0 if i in (0, 5, 10, 15) else 0.0) if i != 3 else -F.col("value") for i in range(16)])
    line = F.struct(F.lit(1).alias("schemaVersion"), F.col("event_id").alias("sequence"), (F.col("event_type") != "error").alias("accepted"), (F.col("value") / 100).alias("overlap"), F.when(F.col("event_type") != "purchase", pose).alias("worldToCamera"))
    e.select(F.when(F.col("event_id") % 50 == 7, F.lit("no json")).otherwise(F.to_json(line))).write.text(f"{home}/tracking.jsonl")
    kind = F.when(F.col("event_type") == "view", "gyro").when(F.col("event_type") == "click", "accel").otherwise("mag")
    samples = e.select(F.col("t").alias("timestamp_us"), kind.alias("type"), F.col("value").cast("string").alias("x"), F.when(F.col("event_id") % 40 == 3, "x").otherwise("0").alias("y"), F.lit("1.5").alias("z"), F.lit("").alias("temperature_c"))
    publish.imu_csv(samples, f"{home}/imu.csv")
    return home


@query("phase_scan", "SELECT event_id, CASE WHEN event_type<>'purchase' AND event_id%50<>7 THEN round(value,4) END x FROM events WHERE NOT (event_type='error' AND event_id%50<>7)")
def phase_scan(spark, d):
    """Frames with the poses of the journal, without those that it rejects; lines that are no JSON say nothing."""
    f = phase.phase(spark, written_phase(spark, d)).frames
    return f.select(F.col("source_sequence").alias("event_id"), F.round(F.col("tracked")[3], 4).alias("x"))


@query("imu_scan", "SELECT CASE event_type WHEN 'view' THEN 'gyro' ELSE 'accel' END kind, count(*) n, round(sum(value),4) total FROM events WHERE event_type IN ('view','click') AND event_id%40<>3 GROUP BY 1")
def imu_scan(spark, d):
    """Samples written and read; rows of another kind or with a number that is none are lost alone."""
    s = phase.phase(spark, written_phase(spark, d), include_rejected=True).imu
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("journal_quality", "SELECT count(*) n, round(avg(value/100),6) mean_overlap FROM events WHERE event_type NOT IN ('error','purchase') AND event_id%50<>7")
def journal_quality(spark, d):
    """S5, A14."""
    home = written_phase(spark, d)
    log = phase.tracking(spark, f"{home}/tracking.jsonl").where("accepted AND tracked IS NOT NULL")
    return log.agg(F.count("*").alias("n"), r6(F.avg("overlap")).alias("mean_overlap"))


DEPTHS = f"SELECT y//8-(SELECT min(y) FROM ({G}))//8 f, x, y%8 y, CAST(greatest(0,least(65535,round_even(v*10,0))) AS INTEGER) d FROM ({G})"


@query("raster_scan", f"SELECT f, x, y, d FROM ({DEPTHS}) WHERE d>0")
def raster_scan(spark, d):
    """Depth rasters of eight days, written raw and read."""
    g = grid(spark, d)
    first = g.agg(F.min("y")).first()[0] // 8
    px = g.select((F.expr("y div 8") - first).alias("f"), "x", (F.col("y") % 8).alias("y"), F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.rint(F.col("v") * 10))).cast("int").alias("d"))
    home = folder(spark)
    publish.rasters(spark, px, "f", home, 24, 8)
    found = readers.depth_pixels(spark, home, 24, 8)
    return found.select(F.regexp_extract("path", r"(\d+)\.u16$", 1).cast("long").alias("f"), "x", "y", "d")


@query("colour_scan", "WITH p AS (SELECT p_partkey, p_size, p_partkey%251 g, (p_partkey*7)%256 b, row_number() OVER (ORDER BY p_partkey)-1 i FROM part) SELECT CAST(i%20 AS INTEGER) x, CAST(i//20 AS INTEGER) y, p_size r, CAST(g AS INTEGER) g, CAST(b AS INTEGER) b FROM p WHERE i<400")
def colour_scan(spark, d):
    """A colour raster of 20 x 20 pixels."""
    home = folder(spark)
    rows = table(spark, d, "part").orderBy("p_partkey").limit(400).select("p_size", "p_partkey").collect()  # one raster
    publish.write_bytes(spark, f"{home}/0.rgb", b"".join(struct.pack("3B", r[0], r[1] % 251, r[1] * 7 % 256) for r in rows))
    return phase.colour_pixels(spark, home, 20, 20).drop("path")


@query("synthetic_project", "SELECT p AS phase, f AS index, x, y, CAST(floor(2100+120*sin(x/6+f/8)+50*cos(y/5)) AS INTEGER) d, CAST(x*255//48 AS INTEGER) r, round(0.35::DOUBLE*p+0.01::DOUBLE*f,6) AS side FROM range(2) a(p), range(3) b(f), range(48) c(x), range(36) e(y)")
def synthetic_project(spark, d):
    """S34."""
    frames, px = phase.synthetic(spark, 2, 3)
    return px.join(frames.select("phase", "index", r6(F.col("pose")[3]).alias("side")), ["phase", "index"]).select("phase", "index", "x", "y", "d", "r", "side")


@query("ply_round_trip", f"SELECT row_number() OVER (ORDER BY vec_id)-1 AS row, round(CAST(x AS FLOAT)::DOUBLE,5) x, round(CAST(z AS FLOAT)::DOUBLE,5) z, CAST(label%256 AS INTEGER) red FROM ({P}) ORDER BY vec_id LIMIT 300")
def ply_round_trip(spark, d):
    """A capped cloud as a binary document, and back."""
    home = folder(spark)
    p = points(spark, d).orderBy("vec_id").limit(300)
    publish.write_bytes(spark, f"{home}/a.ply", readers.ply_bytes(p.select("vec_id", "x", "y", "z", *[(F.col("label") % 256).alias(c) for c in "rgb"]), "vec_id"))
    return binary.ply(spark, f"{home}/a.ply").select("row", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in "xz"], F.col("red").cast("int").alias("red"))


@query("splat_round_trip", "SELECT row_number() OVER (ORDER BY vec_id)-1 AS row, round(CAST(embedding[1] AS DOUBLE),5) x, round(CAST(embedding[4] AS DOUBLE),5) dc, round(CAST(embedding[14] AS DOUBLE),5) rot_3 FROM embeddings ORDER BY vec_id LIMIT 200")
def splat_round_trip(spark, d):
    """K6: 62 numbers a splat, and back."""
    e = table(spark, d, "embeddings").orderBy("vec_id").limit(200)
    v = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    s = e.select(F.col("vec_id").alias("sid"), v(1, 3).alias("position"), v(4, 3).alias("sh0"), F.lit(None).cast("array<array<double>>").alias("rest"), F.col("embedding")[6].cast("double").alias("opacity"), v(8, 3).alias("scale"), v(11, 4).alias("turn"))
    home = folder(spark)
    publish.write_bytes(spark, f"{home}/s.ply", binary.splat_ply(s))
    return binary.ply(spark, f"{home}/s.ply").select("row", *[F.round(F.col(c).cast("double"), 5).alias(n) for c, n in (("x", "x"), ("f_dc_0", "dc"), ("rot_3", "rot_3"))])


@query("obj_round_trip", f"{TRIS} SELECT count(*) triangles, (SELECT count(DISTINCT v) FROM (SELECT a v FROM t UNION SELECT b FROM t UNION SELECT c FROM t)) vertices, round((SELECT sum(z) FROM w WHERE vid IN (SELECT a FROM t UNION SELECT b FROM t UNION SELECT c FROM t)),4) total FROM t")
def obj_round_trip(spark, d):
    """A mesh as text, and back."""
    t, v = sheet(spark, d)
    home = folder(spark)
    readers.obj_lines(t, v).orderBy("part", "key").select("line").coalesce(1).write.text(home)  # one document
    vertices, corners = readers.obj(spark, home)
    c, total = corners.agg((F.count("*") / 3).cast("long"), F.countDistinct("vid")).first(), vertices.agg(F.round(F.sum("z"), 4)).first()
    return spark.createDataFrame([(c[0], c[1], total[0])], "triangles long, vertices long, total double")


@query("stream_round_trip", f"WITH f AS (SELECT DISTINCT f FROM ({DEPTHS})), p AS (SELECT f.f, x, y FROM f, range(24) a(x), range(8) b(y)) SELECT f AS sequence, count(*) FILTER (d>0) pixels, coalesce(sum(d),0) total FROM p LEFT JOIN ({DEPTHS}) q USING (f, x, y) GROUP BY 1")
def stream_round_trip(spark, d):
    """Depth frames as a recorded stream, and back."""
    g = grid(spark, d)
    first = g.agg(F.min("y")).first()[0] // 8
    px = g.select((F.expr("y div 8") - first).alias("f"), "x", (F.col("y") % 8).alias("y"), F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.rint(F.col("v") * 10))).cast("int").alias("d"))
    per = px.groupBy("f").agg(F.collect_list(F.struct("x", "y", "d")).alias("p")).orderBy("f")
    parts = []
    for r in per.toLocalIterator():  # one frame at a time
        raster = np.zeros((8, 24), dtype="<u2")
        for q in r["p"]:
            raster[q["y"], q["x"]] = q["d"]
        parts.append(binary.write_frame({"sequence": r["f"], "depth_us": 0, "color_us": 0, **LENS, "depth_scale": 1000.0, "min_m": 0.1, "max_m": 60.0, "gyro": None, "pose": None, "mirrored": False, "depth": raster.tobytes(), "color": None}, b"EVENTSRG"))
    home = folder(spark)
    publish.write_bytes(spark, f"{home}/a.bin", b"".join(parts))
    found = binary.rgbd_frames(spark, home, b"EVENTSRG").select("sequence", F.explode(F.sequence(F.lit(0), F.lit(191))).alias("i"), "depth")
    low = F.conv(F.hex(F.expr("substring(depth, 2 * i + 1, 1)")), 16, 10) + 256 * F.conv(F.hex(F.expr("substring(depth, 2 * i + 2, 1)")), 16, 10)
    return found.select("sequence", low.cast("long").alias("d")).groupBy("sequence").agg(F.count_if(F.col("d") > 0).alias("pixels"), F.sum("d").alias("total"))


@query("message_round_trip", "SELECT user_id AS sequence, CASE WHEN user_id%2=0 THEN 1 ELSE 2 END kind, count(*) n FROM events GROUP BY 1")
def message_round_trip(spark, d):
    """Packets of points and other messages in one stream, told apart by their kind."""
    per = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).orderBy("user_id")
    parts = []
    for r in per.toLocalIterator():
        n = len(r["v"])
        body = packets.point_packet(b"PNTS", r["user_id"], 0, 30.0, np.tile(np.array(r["v"])[:, None], 3), np.zeros((n, 3))) if r["user_id"] % 2 == 0 else json.dumps({"n": n}).encode()
        parts.append(packets.write_message(b"MSGS", 1 if r["user_id"] % 2 == 0 else 2, r["user_id"], body))
    home = folder(spark)
    publish.write_bytes(spark, f"{home}/a.bin", b"".join(parts))
    m = packets.messages(spark, home, b"MSGS")
    n = F.when(F.col("kind") == 1, ((F.octet_length("payload") - 24) / 15).cast("long")).otherwise(F.get_json_object(F.col("payload").cast("string"), "$.n").cast("long"))
    return m.select("sequence", "kind", n.alias("n"))


@query("point_packets", f"SELECT label, 24+15*least(count(*),20) AS length, least(count(*),20) n FROM ({P}) GROUP BY 1")
def point_packets(spark, d):
    """A packet of at most twenty points for each label."""
    p = points(spark, d).select("label", F.lit(0).cast("long").alias("t_us"), F.col("vec_id").alias("order"), "x", "y", "z", *[F.lit(1).alias(c) for c in "rgb"])
    raw = packets.point_packets(p, "label", "t_us", 30.0, b"PNTS", 20)
    count = F.expr("cast(conv(concat(hex(substring(payload, 24, 1)), hex(substring(payload, 23, 1)), hex(substring(payload, 22, 1)), hex(substring(payload, 21, 1))), 16, 10) AS long)")
    return raw.select("label", F.octet_length("payload").cast("long").alias("length"), count.alias("n"))


@query("project_listing", "SELECT c_custkey::VARCHAR id, row_number() OVER (ORDER BY DATE '2024-01-01'+CAST(c_custkey%400 AS INTEGER) DESC, printf('%06d', c_custkey)) place FROM customer WHERE c_custkey<=40 AND c_custkey%9<>0")
def project_listing(spark, d):
    """Projects newest first, those of another schema and those that cannot be read left out."""
    home = folder(spark)
    for r in table(spark, d, "customer").where("c_custkey <= 40").select("c_custkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int")).cast("string").alias("at")).collect():
        k = r["c_custkey"]
        raw = b"{broken" if k % 18 == 0 else json.dumps({"schemaVersion": 2 if k % 9 == 0 else 3, "id": str(k), "name": "p", "createdAt": r["at"], "phases": []}).encode()
        publish.write_bytes(spark, f"{home}/{k:06}/project.json", raw)
    from pyspark.sql import Window

    found = readers.project_listing(spark, home)
    return found.select("id", F.row_number().over(Window.orderBy(F.desc("created"), "path")).cast("long").alias("place"))  # a listing of folders


@query("complete_phases", "SELECT o_orderkey::VARCHAR id, n AS frames FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) n FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_quantity>40 WHERE o_custkey<=20 GROUP BY 1,2) WHERE o_orderstatus='F' AND n>0")
def complete_phases(spark, d):
    """Phases of a project document that are complete and have frames."""
    line = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").where("o_custkey <= 20").join(line, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n")).collect()  # one project
    home = folder(spark)
    publish.replace_document(spark, f"{home}/project.json", {"schemaVersion": 3, "id": "a", "name": "a", "phases": [{"id": str(r[0]), "name": "x", "frameCount": r[2], "status": "complete" if r[1] == "F" else "recording"} for r in o]})
    return readers.phases(readers.projects(spark, f"{home}/project.json")).select("id", F.col("frameCount").cast("long").alias("frames"))


@query("indexed_frames", "SELECT user_id, count(*) frames FROM events WHERE user_id<12 GROUP BY 1")
def indexed_frames(spark, d):
    """Frames counted from the lines of their indices."""
    home = folder(spark)
    e = events(spark, d).where("user_id < 12").select("user_id", "event_id", "t")
    for u in range(12):
        e.where(F.col("user_id") == u).select("event_id", "t").coalesce(1).write.option("header", True).csv(f"{home}/{u}")  # one document each
    found = readers.indexed_frames(spark, f"{home}/*")
    return found.select(F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("long").alias("user_id"), "frames")


@query("posed_photos", "SELECT 'p'||s_suppkey photo, round(s_acctbal,2) x FROM supplier WHERE s_nationkey%3>0")
def posed_photos(spark, d):
    """The photos of a manifest that were placed."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").collect()  # one manifest
    home = folder(spark)
    pose = lambda v: [v if i == 3 else float(i in (0, 5, 10, 15)) for i in range(16)]
    publish.replace_document(spark, f"{home}/m.json", {"photos": [{"id": f"p{r[0]}", "status": "localized" if r[2] % 3 else "failed", "width": 4, "height": 3, "worldFromCamera": pose(r[1]) if r[2] % 3 else None} for r in s]})
    return phase.posed_photos(spark, f"{home}/m.json").select("photo", F.round(F.col("pose")[3], 2).alias("x"))


@query("published_dataset", "SELECT c_mktsegment, count(*) n, round(sum(c_acctbal),2) total FROM customer WHERE c_acctbal>0 GROUP BY 1")
def published_dataset(spark, d):
    """Two versions behind a pointer, the second is read."""
    root, c = folder(spark), table(spark, d, "customer")
    publish.publish(spark, root, c)
    publish.publish(spark, root, c.where("c_acctbal > 0"), {"kind": "positive"})
    return publish.published(spark, root).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("kept_results", "SELECT n_regionkey, count(*) n, 2 tries FROM nation GROUP BY 1")
def kept_results(spark, d):
    """A result kept under its fingerprint, exported over an older one, and a broken one moved aside and made again."""
    home, nation = folder(spark), table(spark, d, "nation")
    made = []

    def make():
        made.append(1)
        return nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))

    for _ in range(2):
        df = store.materialized(spark, f"{home}/store", ("regions", 1), make)
    for rows in (nation.limit(1), df):
        publish.export(spark, f"{home}/export", lambda p, rows=rows: rows.write.parquet(p))
    publish.write_bytes(spark, f"{home}/broken/part-0.parquet", b"no table")
    if publish.load_or_quarantine(spark, f"{home}/broken", ["n"]) is None:
        make().write.parquet(f"{home}/broken")
    found = publish.load_or_quarantine(spark, f"{home}/export", ["n_regionkey", "n"])
    return found.withColumn("tries", F.lit(len(made)))


@query("pose_manifest", "SELECT s_suppkey, round(s_acctbal/1000,8) x, round(s_nationkey*10.0,8) fx FROM supplier")
def pose_manifest(spark, d):
    """A line of JSON a camera, and back."""
    pose = F.array(*[F.lit(float(i in (0, 5, 10, 15))) if i != 3 else F.col("s_acctbal") / 1000 for i in range(16)])
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), pose.alias("pose"), (F.col("s_nationkey") * 10.0).alias("fx"), *[F.lit(1.0).alias(c) for c in ("fy", "cx", "cy")])
    at = lambda p: F.round(F.get_json_object("json", p).cast("double"), 8)
    return readers.camera_poses(s, "s_suppkey").select("s_suppkey", at("$.cameraToWorld[3]").alias("x"), at("$.intrinsics.fx").alias("fx"))


@query("preview_points", f"WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id)-1 i, count(*) OVER () cnt FROM ({P})) SELECT vec_id, round(round_even(x,5),4) x, CAST(label AS DOUBLE) r FROM n WHERE cnt<=100 OR i IN (SELECT q*((SELECT count(*) FROM embeddings)-1)//99 FROM range(100) t(q))")
def preview_points(spark, d):
    """K3, L2: a hundred evenly spaced points, and back."""
    p = points(spark, d).select("vec_id", "x", "y", "z", *[F.col("label").alias(c) for c in "rgb"])
    at = lambda i: F.get_json_object("json", f"$[{i}]").cast("double")
    x = F.signum(at(0)) * F.floor(F.abs(at(0) * 1e4) + 0.5) / 1e4  # as SQL rounds: the double times 10000, not its decimal digits
    return readers.preview(p, ["vec_id"], 100).select("vec_id", x.alias("x"), at(3).alias("r"))


@query("splat_sidecars", f"SELECT label, count(*) n, round(min(x),6) AS low, round(max(z),6) AS high FROM ({P}) GROUP BY 1")
def splat_sidecars(spark, d):
    """K8: a document beside each cloud."""
    s = publish.sidecars(points(spark, d).withColumn("opacity", F.col("c")), "label")
    at = lambda p: F.get_json_object("json", p)
    return s.select("label", at("$.count").cast("long").alias("n"), at("$.min[0]").cast("double").alias("low"), at("$.max[2]").cast("double").alias("high"))


@query("safe_paths", r"SELECT doc_id, NOT regexp_matches(p, '^$|^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)') safe FROM (SELECT doc_id, CASE doc_id%5 WHEN 0 THEN '../'||lang WHEN 1 THEN 'C:'||lang WHEN 2 THEN '/'||lang WHEN 3 THEN 'a/..'||lang ELSE 'a\..\'||lang END p FROM documents WHERE lang IS NOT NULL)")
def safe_paths(spark, d):
    """S17, F29."""
    k = F.col("doc_id") % 5
    p = F.when(k == 0, F.concat(F.lit("../"), "lang")).when(k == 1, F.concat(F.lit("C:"), "lang")).when(k == 2, F.concat(F.lit("/"), "lang")).when(k == 3, F.concat(F.lit("a/.."), "lang")).otherwise(F.concat(F.lit("a\\..\\"), "lang"))
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", readers.safe_path(p).alias("safe"))


@query("fresh_heartbeats", "SELECT 3 beats, 1 stale")
def fresh_heartbeats(spark, d):
    """Of four workers' documents three are fresh and one is named stale by an older limit."""
    home = folder(spark)
    for i in range(3):
        publish.write_bytes(spark, f"{home}/{i}.json", json.dumps({"worker": i}).encode())
    fresh = readers.live_workers(spark, home, 3600).count()
    old = 3 - readers.live_workers(spark, home, -3600).count()
    return spark.createDataFrame([(fresh, int(old == 3))], "beats int, stale int")


@query("mean_rotation", f"SELECT round(degrees(atan2(avg(sin(x*3)),avg(cos(x*3)))),5) angle FROM ({P})")
def mean_rotation(spark, d):
    """The mean of rotations about z."""
    from plumbline.operators.poses import mean_rotation as mean

    a = F.col("x") * 3
    m = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    r = mean(points(spark, d).select(m.alias("m")), "m")
    return spark.createDataFrame([(float(np.degrees(np.arctan2(r[1, 0], r[0, 0]))),)], "angle double").select(F.round("angle", 5).alias("angle"))


@query("interpolated_poses", f"SELECT vec_id, round(0.25*x,6)+0.0 x, round(degrees(c*0.25),5)+0.0 angle FROM ({P})")
def interpolated_poses(spark, d):
    """A quarter of the way from the identity to a pose turned about z."""
    from plumbline.operators.poses import between

    def run(batches):
        for b in batches:
            out = []
            for v, x, c in zip(b["vec_id"], b["x"], b["c"]):
                q = np.eye(4)
                q[:2, :2], q[0, 3] = [[np.cos(c), -np.sin(c)], [np.sin(c), np.cos(c)]], x
                m = between(np.eye(4), q, 0.25)
                out.append((v, m[0, 3], np.degrees(np.arctan2(m[1, 0], m[0, 0]))))
            import pandas as pd

            yield pd.DataFrame(out, columns=["vec_id", "x", "angle"])

    found = points(spark, d).select("vec_id", "x", "c").mapInPandas(run, "vec_id long, x double, angle double")
    return found.select("vec_id", (r6("x") + 0.0).alias("x"), (F.round("angle", 5) + 0.0).alias("angle"))


@query("frame_gains", "WITH g AS (SELECT n_nationkey f, n_nationkey%7/10.0 g, n_regionkey r FROM nation) SELECT f frame, round(g-avg(g) OVER (PARTITION BY r),6) gain FROM g")
def frame_gains(spark, d):
    """Gains of frames (nations) from the offsets of all pairs of a region, by weight; the mean of a region is 0."""
    from plumbline.operators.graph import gain_fit

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("f"), (F.col("n_nationkey") % 7 / 10).alias("g"), "n_regionkey")
    pairs = n.join(n.select(F.col("f").alias("j"), F.col("g").alias("h"), "n_regionkey"), "n_regionkey").where("f < j")
    found = gain_fit(pairs.select(F.col("f").alias("i"), "j", (F.col("g") - F.col("h")).alias("offset"), (1.0 + F.col("f") % 3).alias("weight")))
    return found.select("frame", r6("gain").alias("gain"))


@query("diffused_colours", "WITH RECURSIVE n AS (SELECT c_custkey v, c_custkey%6 k FROM customer), r AS (SELECT v, 0 d, CASE WHEN k=0 THEN v END src FROM n WHERE k=0 UNION ALL SELECT r.v+1, d+1, src FROM r WHERE d<5 AND EXISTS (SELECT 1 FROM n WHERE n.v=r.v+1 AND n.k>0)) SELECT v node, round(CASE WHEN max(src) IS NOT NULL THEN avg(src*1.0) END,4) AS value FROM n LEFT JOIN r USING (v) GROUP BY 1")
def diffused_colours(spark, d):
    """Customers in a row, every sixth with a value; the others take it from the one before, round by round (edges lead one way)."""
    from plumbline.operators.graph import diffuse

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 6 == 0, F.col("c_custkey").cast("double")).alias("value"))
    back = c.where("node % 6 > 0").select(F.col("node").alias("u"), (F.col("node") - 1).alias("v"))
    return diffuse(c, back).select("node", F.round("value", 4).alias("value"))


@query("replayed_frames", f"WITH e AS (SELECT * FROM ({E}) WHERE user_id=3), f AS (SELECT event_id, t//1000 t, row_number() OVER (ORDER BY t, event_id)-1 number FROM e) SELECT event_id, number FROM f")
def replayed_frames(spark, d):
    """The frames of one user in order of time, rejected ones included; a test has turns."""
    home = folder(spark)
    e = events(spark, d).where("user_id = 3")
    publish.replace_document(spark, f"{home}/phase.json", {k: v for k, v in MANIFEST.items() if k != "imu"})
    e.select(F.col("event_id").alias("index"), F.col("event_id").alias("source_sequence"), F.col("t").alias("timestamp_us"), F.lit("x").alias("depth_path"), F.lit("x").alias("color_path")).write.option("header", True).csv(f"{home}/frames.csv")
    e.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("event_id").alias("sequence"), (F.col("event_type") != "error").alias("accepted")))).write.text(f"{home}/tracking.jsonl")
    return phase.replayed(phase.phase(spark, home, include_rejected=True)).select(F.col("source_sequence").alias("event_id"), F.col("number").cast("long").alias("number"))


@query("media_observations", "SELECT 'p'||doc_id image, CAST(n_chars AS DOUBLE) timestamp_s FROM documents WHERE doc_id<200 AND doc_id%3=0")
def media_observations(spark, d):
    """Of a manifest's sources those that stay in the project."""
    home = folder(spark)
    rows = table(spark, d, "documents").where("doc_id < 200").select("doc_id", "n_chars").collect()  # one manifest
    at = lambda k: ("media/a.mp4", "../a.mp4", "/a.mp4")[k % 3]
    publish.replace_document(spark, f"{home}/m.json", {"observations": [{"source": at(r[0]), "image": f"p{r[0]}", "timestampSeconds": float(r[1])} for r in rows]})
    return phase.observations(spark, f"{home}/m.json").select("image", "timestamp_s")


@query("located_projects", "SELECT CAST(n_nationkey AS VARCHAR) id FROM nation WHERE n_nationkey%4>0")
def located_projects(spark, d):
    """Projects whose own path is where they lie; a fourth were moved."""
    home = folder(spark)
    for r in table(spark, d, "nation").select("n_nationkey").collect():
        k = r[0]
        publish.replace_document(spark, f"{home}/{k}/project.json", {"schemaVersion": 3, "id": str(k), "path": f"{home}/{k}" if k % 4 else "/elsewhere"})
    return phase.located(spark, home).select("id")


@query("journal_sink", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM ({E})) WHERE r<=16")
def journal_sink(spark, d):
    """K9: a stream's rows appended as JSON lines, the oldest of a full queue dropped."""
    from plumbline.streaming.flows import to_journal

    home = folder(spark)
    table(spark, d, "events").select("user_id", "event_id").coalesce(1).write.parquet(f"{home}/in")  # one micro-batch
    rows = spark.readStream.schema("user_id long, event_id long").parquet(f"{home}/in")
    run = rows.writeStream.foreachBatch(to_journal(f"{home}/out", "user_id", "event_id", 16)).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("user_id long, event_id long").json(f"{home}/out").select("event_id")


class _Tenth:
    """A predictor for the query: a tenth more than what was measured, valid where the colour is bright."""

    def __call__(self, depth, colour, lens):
        return depth * 1.1 + lens[:, :1, None], colour[..., 0] > 0.5


@query("predicted_depths", "SELECT vec_id, round(CASE WHEN e[5]>0 THEN abs(e[1])*1.1+1 ELSE 0 END,6) first, CAST(len(list_filter(e[5:8], lambda v: v>0)) AS BIGINT) valid FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings)")
def predicted_depths(spark, d):
    """I7 and the predictor's protocol: frames of 2 x 2 pixels through a caller's predictor."""
    from plumbline.operators.extensions import predicted

    v = lambda i: F.col("embedding")[i].cast("double")
    bright = [F.when(v(4 + i) > 0, 1.0).otherwise(0.0) for i in range(4)]
    f = table(spark, d, "embeddings").select("vec_id", F.array(*[F.abs(v(i)) for i in range(4)]).alias("depth"), F.array(*[b for b in bright for _ in range(3)]).alias("colour"), F.array(*map(F.lit, (1.0, 1.0, 0.5, 0.5))).alias("lens"))
    out = predicted(f, "vec_id", _Tenth(), 2, 2)
    return out.select("vec_id", r6(F.col("depth")[0]).alias("first"), F.size(F.filter("valid", lambda b: b)).cast("long").alias("valid"))


@query("layered_invalidation", "WITH l AS (SELECT o_orderkey, l_linenumber, l_quantity<45 AND l_shipdate IS NOT NULL ok FROM orders JOIN lineitem ON l_orderkey=o_orderkey) SELECT o_orderkey, l_linenumber, CASE WHEN bool_and(ok) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber RANGE UNBOUNDED PRECEDING) THEN 'kept' ELSE 'rebuild' END state FROM (SELECT o_orderkey, l_linenumber, bool_and(ok) ok FROM l GROUP BY 1,2)")
def layered_invalidation(spark, d):
    """R2: the lines of an order as layers; one that changed (a large quantity) is built again, and all behind it."""
    from plumbline.operators.extensions import invalidated

    x = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.groupBy("o_orderkey", "l_linenumber").agg(F.bool_and((F.col("l_quantity") < 45) & F.col("l_shipdate").isNotNull()).alias("ok"))
    wanted = x.select("o_orderkey", "l_linenumber", F.lit("new").alias("fp"))
    stored = x.select("o_orderkey", "l_linenumber", F.when(F.col("ok"), "new").otherwise("old").alias("fp"))
    return invalidated(wanted, stored, "o_orderkey", "l_linenumber", "fp")
