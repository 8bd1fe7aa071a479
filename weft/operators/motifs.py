"""Triangles, wedges, clustering and graphlets by joins of degree-ordered edges.

Edges are oriented from the end of lower degree (ties by id) to the higher one, so a node's fan-out is at most sqrt(2 edges) and a hub
never meets all pairs of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.core import degrees
from weft.operators.rest import cut


def with_degrees(edges: DataFrame) -> DataFrame:
    """(u, v, du, dv): each distinct pair with the degrees of its ends."""
    d = degrees(edges).select("id", "deg")
    return edges.filter("u <> v").select("u", "v").join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v").select("u", "v", "du", "dv")


def oriented(edges: DataFrame) -> DataFrame:
    """(a, b): each distinct pair from lower to higher degree."""
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return with_degrees(edges).select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z): every triangle once."""
    o = oriented(edges)
    wedge = o.toDF("x", "y").join(o.toDF("x", "z"), "x").filter("y <> z")
    return wedge.join(o.toDF("y", "z"), ["y", "z"], "left_semi").select("x", "y", "z")


def triangles_per_node(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(id, deg, tri) for every node, also those in no triangle; ``found`` are the triangles if they are known already."""
    t = (triangles(edges) if found is None else found).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("tri"))
    return degrees(edges).select("id", "deg").join(t, "id", "left").select("id", "deg", F.coalesce("tri", F.lit(0)).cast("long").alias("tri"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, deg, tri, cc): 2 tri / (deg (deg - 1)), 0 below degree 2."""
    t = triangles_per_node(edges)
    return t.withColumn("cc", F.when(F.col("deg") >= 2, 2 * F.col("tri") / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0))


def global_clustering(edges: DataFrame) -> DataFrame:
    """(triangles, wedges, gcc)."""
    t = triangles_per_node(edges).agg((F.sum("tri") / 3).cast("long").alias("triangles"), F.sum(F.col("deg") * (F.col("deg") - 1) / 2).cast("long").alias("wedges"))
    return t.withColumn("gcc", F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")).otherwise(0.0))


def edge_triangles(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(u, v, t): number of triangles on each edge; ``found`` as above."""
    tri = triangles(edges) if found is None else found
    pairs = tri.select(F.explode(F.array(F.struct(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")), F.struct(F.least("x", "z").alias("u"), F.greatest("x", "z").alias("v")), F.struct(F.least("y", "z").alias("u"), F.greatest("y", "z").alias("v")))).alias("p")).select("p.*")
    t = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("t"))
    return edges.filter("u <> v").select("u", "v").join(t, ["u", "v"], "left").select("u", "v", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def four_cliques(edges: DataFrame) -> DataFrame:
    """(x, y, z, q): every clique of four once, from triangles that share their lowest node."""
    o = oriented(edges)
    wedge = o.toDF("x", "y").join(o.toDF("x", "z"), "x").filter("y <> z")
    t = wedge.join(o.toDF("y", "z"), ["y", "z"], "left_semi").select("x", "y", "z")
    return t.join(t.toDF("x", "y", "q"), ["x", "y"]).filter("z <> q").join(o.toDF("z", "q"), ["z", "q"], "left_semi").select("x", "y", "z", "q")


def high_paths(edges: DataFrame) -> DataFrame:
    """(a, m, b): paths of two edges whose end ``a`` ranks above both others by (degree, id).

    A middle node meets its neighbours only with those above it, at most sqrt(2 edges), so a hub never meets all pairs of its neighbours.
    """
    e = with_degrees(edges)
    s = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("dv").alias("du"), F.col("du").alias("dv")))
    up = s.select(F.col("u").alias("m"), F.col("v").alias("a"), F.struct(F.col("dv").alias("d"), F.col("v").alias("i")).alias("ra"), F.struct(F.col("du").alias("d"), F.col("u").alias("i")).alias("rm")).filter("rm < ra").drop("rm")
    on = s.select(F.col("u").alias("m"), F.col("v").alias("b"), F.struct(F.col("dv").alias("d"), F.col("v").alias("i")).alias("rb"))
    return up.join(on, "m").filter("rb < ra").select("a", "m", "b")


def four_cycles(edges: DataFrame) -> DataFrame:
    """(cycles): cycles of four nodes, chords allowed; each is seen once, from its highest node to the opposite one."""
    c = high_paths(edges).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).cast("long").alias("cycles"))


def four_cycles_per_node(edges: DataFrame) -> DataFrame:
    """(u, c4): cycles of four nodes, chords allowed, through each node that is in one."""
    paths = cut(high_paths(edges), "paths")
    c = cut(paths.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "opposite")
    ends = c.select(F.explode(F.array("a", "b")).alias("u"), (F.col("c") * (F.col("c") - 1) / 2).alias("k"))
    middles = paths.join(c, ["a", "b"]).select(F.col("m").alias("u"), (F.col("c") - 1).cast("double").alias("k"))
    return ends.union(middles).groupBy("u").agg(F.sum("k").alias("c4"))


def graphlet_totals(edges: DataFrame) -> DataFrame:
    """One row of induced counts of the connected graphlets of three and four nodes: triangle, path3, clique4, chordal4, tailed, cycle4, star3, path4."""
    d = degrees(edges.filter("u <> v")).select("id", "deg")
    node = d.agg(F.sum(F.col("deg") * (F.col("deg") - 1) / 2).alias("p3"), F.sum(F.col("deg") * (F.col("deg") - 1) * (F.col("deg") - 2) / 6).alias("s3"))
    found = cut(triangles(edges), "triangles")
    per = edge_triangles(edges, found).join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    edge = per.agg((F.sum("t") / 3).alias("tri"), F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("ch"), F.sum((F.col("du") - 1) * (F.col("dv") - 1)).alias("p4raw"))
    tailed = triangles_per_node(edges, found).agg(F.sum(F.col("tri") * (F.col("deg") - 2)).alias("tl"))
    k4 = four_cliques(edges).agg(F.count(F.lit(1)).alias("k4"))
    c4 = four_cycles(edges).select(F.col("cycles").alias("c4"))
    row = F.broadcast(node).join(F.broadcast(edge)).join(F.broadcast(tailed)).join(F.broadcast(k4)).join(F.broadcast(c4))  # one row each
    clique, chordal = F.col("k4"), F.col("ch") - 6 * F.col("k4")
    tail = F.col("tl") - 4 * chordal - 12 * clique
    cycle = F.col("c4") - chordal - 3 * clique
    star = F.col("s3") - tail - 2 * chordal - 4 * clique
    path = F.col("p4raw") - 3 * F.col("tri") - 4 * cycle - 2 * tail - 6 * chordal - 12 * clique
    return row.select(*[F.coalesce(e, F.lit(0)).cast("long").alias(n) for n, e in (("triangle", F.col("tri")), ("path3", F.col("p3") - 3 * F.col("tri")), ("clique4", clique), ("chordal4", chordal), ("tailed", tail), ("cycle4", cycle), ("star3", star), ("path4", path))])


def orbits(edges: DataFrame) -> DataFrame:
    """(id, o0..o14): for every node how often it stands in each orbit of the connected graphlets of two to four nodes.

    All orbits follow from degrees, triangles per node and edge, four-cycles per node and four-cliques, each an equi-join with a map-side sum.
    """
    e = edges.filter("u <> v").select("u", "v").withColumn("w", F.lit(1).cast("long"))
    d = degrees(e).select("id", "deg")
    t3 = cut(triangles(e), "triangles")
    tri = cut(triangles_per_node(e, t3).select("id", "tri"), "per-node")
    et = cut(edge_triangles(e, t3), "per-edge")
    s = et.select("u", "v", "t").union(et.select(F.col("v").alias("u"), F.col("u").alias("v"), "t"))
    nb = s.join(d.toDF("v", "dv"), "v").join(tri.toDF("v", "tv"), "v").groupBy("u").agg(
        F.sum(F.col("dv") - 1).alias("n1"),  # paths of two edges that start here
        F.sum((F.col("dv") - 1) * (F.col("dv") - 2) / 2).alias("leaf3"),
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("chord"),
        F.sum("tv").alias("tv"),
        F.sum(F.col("t") * (F.col("dv") - 2)).alias("tdv"),
    )
    k4 = four_cliques(e).select(F.explode(F.array("x", "y", "z", "q")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("k4"))
    c4 = four_cycles_per_node(e)
    # chordal quads where the node is off the chord: triangles (u, a, b) and edge ab in another triangle
    opposite = t3.select(F.explode(F.array(F.struct(F.col("x").alias("n"), F.least("y", "z").alias("u"), F.greatest("y", "z").alias("v")), F.struct(F.col("y").alias("n"), F.least("x", "z").alias("u"), F.greatest("x", "z").alias("v")), F.struct(F.col("z").alias("n"), F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))).alias("p")).select("p.*")
    off = opposite.join(et, ["u", "v"]).groupBy(F.col("n").alias("u")).agg(F.sum(F.col("t") - 1).alias("off"))
    # paths u - a - b - c counted from the end and from the middle
    end = s.join(nb.select(F.col("u").alias("v"), F.col("n1").alias("vn1")), "v").join(d.toDF("u", "du"), "u").groupBy("u").agg(F.sum(F.col("vn1") - (F.col("du") - 1)).alias("walk3"))
    mid = s.join(d.toDF("v", "dv"), "v").join(d.toDF("u", "du"), "u").groupBy("u").agg(F.sum((F.col("dv") - 1) * (F.col("du") - 1)).alias("mid"))
    all_ = d.withColumnRenamed("id", "u").join(tri.toDF("u", "tri"), "u", "left").join(nb, "u", "left").join(k4, "u", "left").join(c4, "u", "left").join(off, "u", "left").join(end, "u", "left").join(mid, "u", "left").na.fill(0)
    g = F.col
    o14 = g("k4")
    o13 = g("chord") - 3 * o14  # on the chord
    o12 = g("off") - 3 * o14  # off the chord
    o8 = g("c4") - o12 - o13 - 3 * o14
    o11 = g("tri") * (g("deg") - 2) - 2 * o13 - 3 * o14  # the tailed triangle's node of degree three
    o10 = g("tdv") - 2 * o13 - 2 * o12 - 6 * o14  # its two nodes of degree two
    o9 = g("tv") - 2 * g("tri") - 2 * o12 - 3 * o14  # its tail
    o7 = g("deg") * (g("deg") - 1) * (g("deg") - 2) / 6 - o11 - o13 - o14
    o6 = g("leaf3") - o9 - o10 - o13 - 2 * o12 - 3 * o14
    o5 = g("mid") - 2 * g("tri") - o10 - 2 * o11 - 2 * o8 - 2 * o12 - 4 * o13 - 6 * o14
    o4 = g("walk3") - 2 * g("tri") - 2 * o9 - o10 - 2 * o8 - 4 * o12 - 2 * o13 - 6 * o14
    o = [g("deg"), g("n1") - 2 * g("tri"), g("deg") * (g("deg") - 1) / 2 - g("tri"), g("tri"), o4, o5, o6, o7, o8, o9, o10, o11, o12, o13, o14]
    return all_.select(g("u").alias("id"), *[x.cast("long").alias(f"o{i}") for i, x in enumerate(o)])
