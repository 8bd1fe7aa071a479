"""Queries that count motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import core, motifs
from weft.operators.rest import cut
from weft.plans.registry import query
from weft.plans.structure import DEG, SYM
from weft.sources import views
from weft.sources.views import PARTS

_T = "t AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM g a JOIN g b ON a.v = b.u JOIN g c ON c.u = a.u AND c.v = b.v)"
_TN = "tn AS (SELECT id, count(*) AS tri FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY id)"
_DT = "dt AS (SELECT d.id, deg, CAST(coalesce(tri, 0) AS BIGINT) AS tri FROM d LEFT JOIN tn ON tn.id = d.id)"
_ALL = f"WITH {PARTS}, {DEG}, {SYM}, {_T}, {_TN}, {_DT}"
#: Ordered quads u, a, b, c that hold the named pairs and none of the others.
_NBR = "n AS (SELECT u AS a, v AS b FROM s)"


def view(spark, d):
    """The part graph at rest: motif plans read their edges several times."""
    return cut(views.parts(spark, d), "view")


@query(f"{_ALL} SELECT id, deg, tri FROM dt")
def triangle_per_node(spark, d):
    return motifs.triangles_per_node(view(spark, d))


@query(f"{_ALL} SELECT id, round(CASE WHEN deg >= 2 THEN 2.0 * tri / (deg * (deg - 1)) ELSE 0.0 END, 9) AS cc FROM dt")
def clustering_per_node(spark, d):
    return motifs.clustering(view(spark, d)).select("id", F.round("cc", 9).alias("cc"))


@query(f"{_ALL} SELECT deg, CAST(count(*) AS BIGINT) AS nodes, round(avg(CASE WHEN deg >= 2 THEN 2.0 * tri / (deg * (deg - 1)) ELSE 0.0 END), 9) AS cc FROM dt GROUP BY deg")
def cc_per_degree(spark, d):
    return motifs.clustering(view(spark, d)).groupBy("deg").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("cc"), 9).alias("cc"))


@query(f"{_ALL}, b AS (SELECT CASE WHEN deg <= 1 THEN deg ELSE CAST(floor(log2(deg) + 1e-9) AS BIGINT) + 1 END AS bin, deg, tri FROM dt) SELECT bin, CAST(sum(tri) AS BIGINT) AS tri, CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges, round(CASE WHEN sum(deg * (deg - 1) // 2) > 0 THEN sum(tri) / CAST(sum(deg * (deg - 1) // 2) AS DOUBLE) ELSE 0 END, 9) AS cd FROM b GROUP BY bin")
def cc_per_bin(spark, d):
    """Clustering per degree bin: triangles over wedges, both summed in the bin."""
    from weft.functions.mdl import degree_bin

    t = motifs.triangles_per_node(view(spark, d)).withColumn("wedges", (F.col("deg") * (F.col("deg") - 1) / 2).cast("long"))
    b = t.groupBy(degree_bin(F.col("deg")).alias("bin")).agg(F.sum("tri").alias("tri"), F.sum("wedges").alias("wedges"))
    return b.withColumn("cd", F.round(F.when(F.col("wedges") > 0, F.col("tri") / F.col("wedges")).otherwise(0.0), 9))


@query(f"{_ALL} SELECT CAST(sum(tri) / 3 AS BIGINT) AS triangles, CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges, round(sum(tri) / CAST(sum(deg * (deg - 1) // 2) AS DOUBLE), 9) AS gcc FROM dt")
def global_cc(spark, d):
    return motifs.global_clustering(view(spark, d)).withColumn("gcc", F.round("gcc", 9))


@query(f"WITH {PARTS}, {DEG} SELECT CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges FROM d")
def wedge_count(spark, d):
    return core.degrees(views.parts(spark, d)).agg(F.sum((F.col("deg") * (F.col("deg") - 1) / 2).cast("long")).alias("wedges"))


@query(f"WITH {PARTS}, {SYM}, c AS (SELECT a.v AS x, b.v AS y, count(*) AS c FROM s a JOIN s b ON a.u = b.u AND a.v < b.v GROUP BY 1, 2) SELECT CAST(sum(c * (c - 1) // 2) / 2 AS BIGINT) AS cycles FROM c")
def four_cycle_count(spark, d):
    return motifs.four_cycles(view(spark, d))


@query(f"{_ALL} SELECT CAST(count(*) AS BIGINT) AS k4 FROM t JOIN g a ON a.u = t.x JOIN g b ON b.u = t.y AND b.v = a.v JOIN g c ON c.u = t.z AND c.v = a.v")
def k4_count(spark, d):
    return motifs.four_cliques(view(spark, d)).agg(F.count(F.lit(1)).alias("k4"))


# the oracle lists connected quads by their spanning stars and paths and classifies each once by its edges
_QUADS = """q0 AS (SELECT list_sort([a.u, a.v, b.v, c.v]) AS q FROM s a JOIN s b ON b.u = a.u AND b.v > a.v JOIN s c ON c.u = a.u AND c.v > b.v
 UNION SELECT list_sort([a.u, a.v, b.v, c.v]) FROM s a JOIN s b ON b.u = a.v AND b.v <> a.u JOIN s c ON c.u = b.v AND c.v <> a.v AND c.v <> a.u),
e6 AS (SELECT q, unnest([[1, 2], [1, 3], [1, 4], [2, 3], [2, 4], [3, 4]]) AS p FROM q0),
h AS (SELECT q, q[p[1]] AS i, q[p[2]] AS j FROM e6),
k AS (SELECT h.q, h.i, h.j FROM h JOIN g ON g.u = h.i AND g.v = h.j),
dg AS (SELECT q, id, count(*) AS dq FROM (SELECT q, i AS id FROM k UNION ALL SELECT q, j FROM k) GROUP BY q, id),
cl AS (SELECT q, sum(dq) // 2 AS m, max(dq) AS top FROM dg GROUP BY q)"""


@query(f"{_ALL}, {_QUADS}, f AS (SELECT count(*) FILTER (m = 6) AS clique4, count(*) FILTER (m = 5) AS chordal4, count(*) FILTER (m = 4 AND top = 3) AS tailed, count(*) FILTER (m = 4 AND top = 2) AS cycle4, count(*) FILTER (m = 3 AND top = 3) AS star3, count(*) FILTER (m = 3 AND top = 2) AS path4 FROM cl), three AS (SELECT (SELECT count(*) FROM t) AS triangle, (SELECT sum(deg * (deg - 1) // 2) FROM d) AS wedges) SELECT CAST(triangle AS BIGINT) AS triangle, CAST(wedges - 3 * triangle AS BIGINT) AS path3, CAST(clique4 AS BIGINT) AS clique4, CAST(chordal4 AS BIGINT) AS chordal4, CAST(tailed AS BIGINT) AS tailed, CAST(cycle4 AS BIGINT) AS cycle4, CAST(star3 AS BIGINT) AS star3, CAST(path4 AS BIGINT) AS path4 FROM f, three")
def graphlet_totals(spark, d):
    return motifs.graphlet_totals(view(spark, d))


_ORBIT = """CASE WHEN m = 6 THEN 14 WHEN m = 5 THEN CASE WHEN dq = 3 THEN 13 ELSE 12 END WHEN m = 4 AND top = 3 THEN CASE dq WHEN 1 THEN 9 WHEN 2 THEN 10 ELSE 11 END
 WHEN m = 4 THEN 8 WHEN top = 3 THEN CASE WHEN dq = 3 THEN 7 ELSE 6 END ELSE CASE WHEN dq = 1 THEN 4 ELSE 5 END END"""


@query(f"{_ALL}, {_QUADS}, o AS (SELECT id, {_ORBIT} AS orbit, count(*) AS c FROM dg JOIN cl USING (q) GROUP BY 1, 2), ends AS (SELECT s.u AS id, sum(d.deg - 1) AS n1 FROM s JOIN d ON d.id = s.v GROUP BY s.u) SELECT dt.id, deg AS o0, CAST(n1 - 2 * tri AS BIGINT) AS o1, CAST(deg * (deg - 1) // 2 - tri AS BIGINT) AS o2, tri AS o3, " + ", ".join(f"CAST(coalesce((SELECT sum(c) FROM o WHERE o.id = dt.id AND orbit = {i}), 0) AS BIGINT) AS o{i}" for i in range(4, 15)) + " FROM dt JOIN ends ON ends.id = dt.id")
def graphlet_orbits(spark, d):
    return motifs.orbits(view(spark, d))
