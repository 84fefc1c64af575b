"""Surfaces as tables of triangles: depth sheets, cleaning, normals, rims, fans, level sets.

A triangle is (tid, a, b, c) with vertex ids in winding order, a vertex (vid, x, y, z); tid and vid are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import _written, connected_components


def depth_sheet(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z", jump: float = 0.045, share: float = 0.025) -> DataFrame:
    """(keys, x, y, half): the triangles of the quad right and down of a pixel, those without a jump in depth.

    Half 0 has the corners (x, y), (x, y + 1), (x + 1, y); half 1 has (x, y + 1), (x + 1, y + 1), (x + 1, y).
    A triangle stays if its depths differ by no more than max(jump, share of the nearest). Pixels without depth (null, not
    above 0) are no corners; of repeated pixels the nearest counts. One shuffle: a pixel goes to the four quads it touches.
    """
    corners = F.array(*[F.struct((F.col(x) - i).alias("x"), (F.col(y) - j).alias("y"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)])
    each = pixels.where(F.col(z) > 0).select(*keys, F.col(z).alias("_z"), F.explode(corners).alias("q")).select(*keys, "q.x", "q.y", "q.k", "_z")
    quads = each.groupBy(*keys, "x", "y").agg(*[F.min(F.when(F.col("k") == k, F.col("_z"))).alias(f"_{k}") for k in range(4)])

    def whole(*at: int) -> Column:
        zs = [F.col(f"_{k}") for k in at]
        known = zs[0].isNotNull() & zs[1].isNotNull() & zs[2].isNotNull()
        return known & (F.greatest(*zs) - F.least(*zs) <= F.greatest(F.lit(jump), share * F.least(*zs)))

    halves = F.filter(F.array(F.when(whole(0, 1, 2), F.lit(0)), F.when(whole(1, 3, 2), F.lit(1))), lambda h: h.isNotNull())
    return quads.select(*keys, "x", "y", F.explode(halves).alias("half"))


def clean_triangles(triangles: DataFrame, vertices: DataFrame, least_area: float) -> DataFrame:
    """Triangles with three different known corners and at least this area; of those with the same corners the least tid."""
    once = triangles.where("a <> b AND b <> c AND a <> c").withColumn("_k", F.array_sort(F.array("a", "b", "c")))
    once = once.groupBy("_k").agg(F.min_by(F.struct("tid", "a", "b", "c"), "tid").alias("t")).select("t.*")
    return placed(once, vertices).withColumn("area", _length(_normal()) / 2).where(F.col("area") >= least_area).select("tid", "a", "b", "c", "area")


def placed(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """tid, a, b, c and the positions pa, pb, pc as arrays; triangles with an unknown vertex go (J20). One join and one aggregation for all corners."""
    corner = triangles.select("tid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid"))
    at = corner.join(vertices.select("vid", F.array("x", "y", "z").alias("p")), "vid")
    wide = at.groupBy("tid").agg(*[F.max(F.when(F.col("k") == i, F.col(c))).alias(n) for i, v in enumerate("abc") for c, n in (("vid", v), ("p", "p" + v))])
    return wide.where("pa IS NOT NULL AND pb IS NOT NULL AND pc IS NOT NULL").select("tid", "a", "b", "c", "pa", "pb", "pc")


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _normal() -> list[Column]:
    """Of a placed triangle: its length is twice the area."""
    return _cross(*[[F.col(p)[i] - F.col("pa")[i] for i in range(3)] for p in ("pb", "pc")])


def _length(v: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def vertex_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): the unit sum of the area-weighted normals of a vertex's triangles, (0, 0, 1) where they cancel."""
    faces = placed(triangles, vertices).select(F.explode(F.array("a", "b", "c")).alias("vid"), *[n.alias(c) for n, c in zip(_normal(), ("nx", "ny", "nz"))])
    total = faces.groupBy("vid").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    size = _length([F.col(c) for c in ("nx", "ny", "nz")])
    return total.select("vid", *[F.when(size > 1e-12, F.col(c) / size).otherwise(F.lit(rest)).alias(c) for c, rest in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))])


def half_edges(triangles: DataFrame) -> DataFrame:
    """(tid, u, v): three directed edges a triangle."""
    return triangles.select("tid", F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "bc", "ca")])).alias("e")).select("tid", "e.u", "e.v")


def rim_edges(triangles: DataFrame) -> DataFrame:
    """(u, v): the edges of one triangle alone, directed as that triangle winds."""
    e = half_edges(triangles).groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    return e.agg(F.count("*").alias("n"), F.min("u").alias("u"), F.min("v").alias("v")).where("n = 1").select("u", "v")


def boundary_loops(triangles: DataFrame) -> DataFrame:
    """(loop, place, vid): closed rims in winding order from their least vertex, which names the loop.

    A connected part of the rim is a loop if each of its vertices is entered once and left once; other parts give no rows.
    Found by pointer doubling: every round a vertex learns the least vertex of twice as many successors and how far off it is, and
    leaves when its way ends. Rounds grow with the logarithm of the longest loop; no loop is gathered in one task.
    """
    e = _written(rim_edges(triangles))
    ends = e.select(F.col("u").alias("u"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    simple = ends.groupBy("u").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select("u")
    now = _written(e.join(simple, "u").select("u", F.col("v").alias("to"), F.col("u").alias("loop"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("moved")))
    left, span = now.count(), 1
    while left:
        ahead = now.select(F.col("u").alias("to"), F.col("to").alias("next"), F.col("loop").alias("least"), F.col("off").alias("more"))
        less = F.col("least") < F.col("loop")
        now = _written(now.join(ahead, "to").select("u", F.col("next").alias("to"), F.least("loop", "least").alias("loop"), F.when(less, F.col("more") + span).otherwise(F.col("off")).alias("off"), less.alias("moved")))
        was, span = left, span * 2
        left, moved = now.agg(F.count("*"), F.count_if("moved")).first()
        if left == was and not moved:
            break
    size = now.groupBy("loop").agg(F.count("*").alias("n"))
    return now.join(size, "loop").select("loop", ((F.col("n") - F.col("off")) % F.col("n")).alias("place"), F.col("u").alias("vid"))


def loop_metrics(loops: DataFrame, vertices: DataFrame) -> DataFrame:
    """(loop, n, perimeter, area, rms): edge lengths, length of the vector area, distance from the plane through the mean.

    The vector area is half the sum of cross products of consecutive positions about the loop's mean, its direction the plane's normal;
    rms is null where it vanishes. Every vertex of a loop needs a position.
    """
    xyz = "xyz"
    p = loops.join(vertices.select("vid", *xyz), "vid")
    whole = p.groupBy("loop").agg(F.count("*").alias("n"), *[F.avg(c).alias("m" + c) for c in xyz])
    p = p.join(whole, "loop").select("loop", "place", "n", *[(F.col(c) - F.col("m" + c)).alias(c) for c in xyz])
    after = p.select("loop", ((F.col("place") - 1 + F.col("n")) % F.col("n")).alias("place"), *[F.col(c).alias(c + "2") for c in xyz])
    p = p.join(after, ["loop", "place"])
    here, there = [F.col(c) for c in xyz], [F.col(c + "2") for c in xyz]
    pairs = [(a, b) for i, a in enumerate(xyz) for b in xyz[i:]]
    p = p.select("*", _length([a - b for a, b in zip(here, there)]).alias("l"), *[(v / 2).alias("a" + c) for v, c in zip(_cross(here, there), xyz)])
    g = p.groupBy("loop").agg(F.count("*").alias("n"), F.sum("l").alias("perimeter"), *[F.sum("a" + c).alias("a" + c) for c in xyz], *[F.sum(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in pairs])
    off = sum(((1 if a == b else 2) * F.col("a" + a) * F.col("a" + b) * F.col(f"m{a}{b}") for a, b in pairs), F.lit(0.0))
    g = g.withColumn("area", _length([F.col("a" + c) for c in xyz]))
    return g.select("loop", "n", "perimeter", "area", F.when(F.col("area") > 1e-12, F.sqrt(F.greatest(off, F.lit(0.0)) / F.col("n")) / F.col("area")).alias("rms"))


def nonmanifold_vertices(triangles: DataFrame) -> DataFrame:
    """(vid, fans, spokes): vertices whose triangles fall into several fans, or whose rim edges are neither 0 nor 2.

    Around a vertex the opposite edges of its triangles link their ends; a fan is a connected part of these links.
    """
    turn = F.array(*[F.struct(F.col(v).alias("vid"), F.col(p).alias("p"), F.col(q).alias("q")) for v, p, q in ("abc", "bca", "cab")])
    link = triangles.select(F.explode(turn).alias("t")).select("t.*")
    fans = connected_components(link.select(F.array("vid", "p").alias("p"), F.array("vid", "q").alias("q")), "p", "q")
    fans = fans.groupBy(F.col("node")[0].alias("vid")).agg(F.count_distinct("component").alias("fans"))
    ends = link.select("vid", F.explode(F.array("p", "q")).alias("o")).groupBy("vid", "o").agg(F.count("*").alias("n"))
    spokes = ends.groupBy("vid").agg(F.count_if(F.col("n") == 1).alias("spokes"))
    return fans.join(spokes, "vid").where("fans > 1 OR spokes NOT IN (0, 2)")


#: The six tetrahedra around the diagonal of a cube, a corner's number being 4 x + 2 y + z.
TETRAHEDRA = [(0, 4, 6, 7), (0, 6, 2, 7), (0, 2, 3, 7), (0, 3, 1, 7), (0, 1, 5, 7), (0, 5, 4, 7)]


def level_set(voxels: DataFrame, size: float = 1.0) -> DataFrame:
    """(kx, ky, kz, corners, places): triangles of the surface where (kx, ky, kz, sdf) changes sign.

    Every cube whose eight voxels are known (one a key, sdf not null) is cut into six tetrahedra and each of these by its signs. `corners`
    names each corner by the two voxels its edge joins, so that equal names weld neighbouring triangles; `places` has the positions,
    voxel k at k * size. Normals point to positive distances. A voxel goes to the eight cubes it touches: one shuffle, no Python.
    """
    touch = F.array(*[F.struct((F.col("kx") - i).alias("kx"), (F.col("ky") - j).alias("ky"), (F.col("kz") - k).alias("kz"), F.lit(4 * i + 2 * j + k).alias("n")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    each = voxels.where("sdf IS NOT NULL").select(F.col("sdf").cast("double").alias("sdf"), F.explode(touch).alias("t")).select("t.*", "sdf")
    cubes = each.groupBy("kx", "ky", "kz").agg(*[F.max(F.when(F.col("n") == n, F.col("sdf"))).alias(f"s{n}") for n in range(8)])
    signs = [F.col(f"s{n}") for n in range(8)]
    cubes = cubes.where(F.least(*signs) < 0).where(F.greatest(*signs) >= 0)
    for s in signs:
        cubes = cubes.where(s.isNotNull())

    def corner(n: int) -> Column:
        key = [F.col(c) + b for c, b in zip(("kx", "ky", "kz"), ((n >> 2) & 1, (n >> 1) & 1, n & 1))]
        return F.struct(signs[n].alias("s"), F.array(*[k.cast("long") for k in key]).alias("k"))

    tets = cubes.select("kx", "ky", "kz", F.explode(F.array(*[F.array(*map(corner, t)) for t in TETRAHEDRA])).alias("t"))
    tets = tets.select("kx", "ky", "kz", F.filter("t", lambda c: c["s"] < 0).alias("i"), F.filter("t", lambda c: c["s"] >= 0).alias("o"))
    tets = tets.where((F.size("i") > 0) & (F.size("o") > 0))

    def cut(i: int, o: int) -> Column:
        return F.struct(F.col("i")[i].alias("i"), F.col("o")[o].alias("o"))

    one = F.array(F.array(cut(0, 0), cut(0, 1), cut(0, 2)))
    two = F.array(F.array(cut(0, 0), cut(0, 1), cut(1, 1)), F.array(cut(0, 0), cut(1, 1), cut(1, 0)))
    three = F.array(F.array(cut(0, 0), cut(1, 0), cut(2, 0)))
    faces = tets.select("kx", "ky", "kz", F.explode(F.when(F.size("i") == 1, one).when(F.size("i") == 2, two).otherwise(three)).alias("f"))

    def place(c: Column) -> Column:
        part = c["i"]["s"] / (c["i"]["s"] - c["o"]["s"])
        return F.array(*[size * (c["i"]["k"][d] + part * (c["o"]["k"][d] - c["i"]["k"][d])) for d in range(3)])

    named = faces.select("kx", "ky", "kz", F.transform("f", lambda c: F.concat(c["i"]["k"], c["o"]["k"])).alias("corners"), F.transform("f", place).alias("places"), F.transform("f", lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda d: c["o"]["k"][d] - c["i"]["k"][d])).alias("out"))
    p = F.col("places")
    normal = _cross(*[[p[k][d] - p[0][d] for d in range(3)] for k in (1, 2)])
    outwards = sum((normal[d] * (F.col("out")[0][d] + F.col("out")[1][d] + F.col("out")[2][d]) for d in range(3)), F.lit(0.0))
    turned = [F.when(outwards < 0, F.array(F.col(c)[0], F.col(c)[2], F.col(c)[1])).otherwise(F.col(c)).alias(c) for c in ("corners", "places")]
    return named.select("kx", "ky", "kz", *turned)
