"""Queries over edge tables: canonical form, weights, degrees, boundaries, contraction, bins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import mdl
from weft.operators import core
from weft.plans.registry import query
from weft.sources import views
from weft.sources.views import BUYERS, LABELLED, PARTS, PARTS45, SUPPLIERS

SYM = "s AS (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g WHERE u <> v)"
DEG = "d AS (SELECT id, CAST(count(*) AS BIGINT) AS deg, CAST(sum(w) AS BIGINT) AS wdeg FROM (SELECT u AS id, w FROM g UNION ALL SELECT v, w FROM g) GROUP BY id)"
#: Members for subgraph queries: ids divisible by three, a condition on the data and not a sample.
MEMBERS = "m AS (SELECT id FROM (SELECT u AS id FROM g UNION SELECT v FROM g) WHERE id % 3 = 0)"


def members(edges):
    return core.nodes(edges).filter("id % 3 = 0")


@query("SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem")
def edge_canonical(spark, d):
    return views.table(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("u"), F.greatest("l_partkey", "l_suppkey").alias("v"))


@query("SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, CAST(count(*) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2")
def edge_dedupe_weight(spark, d):
    return core.canonical(views.table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, CAST(1 AS BIGINT) AS w FROM lineitem WHERE l_partkey <> l_suppkey")
def self_loop_filter(spark, d):
    return core.simple(views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")))


@query(f"WITH {PARTS}, i AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS n FROM (SELECT u AS id FROM g UNION SELECT v FROM g)) SELECT a.n AS u, b.n AS v, w FROM g JOIN i a ON a.id = u JOIN i b ON b.id = v")
def relabel_contiguous(spark, d):
    return core.relabel(views.parts(spark, d))


@query(f"WITH {SUPPLIERS}, {MEMBERS} SELECT u, v, w FROM g WHERE u IN (SELECT id FROM m) AND v IN (SELECT id FROM m)")
def induced_subgraph(spark, d):
    g = views.suppliers(spark, d)
    return core.induced(g, members(g))


@query(f"WITH {SUPPLIERS}, {MEMBERS}, {SYM} SELECT u AS inside, v AS outside, w FROM s WHERE u IN (SELECT id FROM m) AND v NOT IN (SELECT id FROM m)")
def boundary_edges(spark, d):
    g = views.suppliers(spark, d)
    return core.boundary(g, members(g))


@query(f"WITH {SUPPLIERS}, {MEMBERS}, {SYM} SELECT id, CAST(coalesce((SELECT sum(w) FROM s WHERE u = id AND v NOT IN (SELECT id FROM m)), 0) AS BIGINT) AS b_deg FROM m")
def boundary_degree(spark, d):
    g = views.suppliers(spark, d)
    return core.boundary_degrees(g, members(g))


@query(f"WITH {SUPPLIERS}, {MEMBERS}, c AS (SELECT CASE WHEN u IN (SELECT id FROM m) THEN (SELECT min(id) FROM m) ELSE u END AS a, CASE WHEN v IN (SELECT id FROM m) THEN (SELECT min(id) FROM m) ELSE v END AS b, w FROM g WHERE NOT (u IN (SELECT id FROM m) AND v IN (SELECT id FROM m))) SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(sum(w) AS BIGINT) AS w FROM c GROUP BY 1, 2")
def contract_subtree(spark, d):
    g = views.suppliers(spark, d)
    return core.contract(g, members(g))


@query(f"WITH {SUPPLIERS}, {DEG} SELECT id, deg, wdeg FROM d")
def degree_table(spark, d):
    return core.degrees(views.suppliers(spark, d))


@query(f"WITH {PARTS}, {DEG}, h AS (SELECT deg, count(*) AS c FROM d GROUP BY deg) SELECT CAST(x AS BIGINT) AS deg, CAST(coalesce(c, 0) AS BIGINT) AS cnt FROM (SELECT unnest(range(0, (SELECT max(deg) FROM d) + 1)) AS x) LEFT JOIN h ON deg = x")
def degree_histogram(spark, d):
    return core.degree_histogram(views.parts(spark, d))


@query(f"WITH {PARTS45}, {DEG} SELECT deg AS k, CAST(count(*) AS BIGINT) AS cnt FROM d GROUP BY deg")
def degree_vertex_count(spark, d):
    return core.degrees(views.parts45(spark, d)).groupBy(F.col("deg").alias("k")).agg(F.count(F.lit(1)).alias("cnt"))


_TWO = f"WITH {PARTS}, {DEG}, x AS (SELECT 1 AS gid, deg FROM d UNION ALL SELECT 2, deg FROM (WITH {PARTS45}, {DEG} SELECT deg FROM d))"


def two_graphs(spark, d):
    """Degrees of two graphs, for statistics over several graphs."""
    a, b = core.degrees(views.parts(spark, d)), core.degrees(views.parts45(spark, d))
    return a.select(F.lit(1).alias("gid"), "id", "deg").union(b.select(F.lit(2).alias("gid"), "id", "deg"))


@query(f"{_TWO}, h AS (SELECT gid, deg, count(*) AS c FROM x GROUP BY 1, 2) SELECT deg AS k, round(avg(c), 6) AS mean_cnt FROM h GROUP BY deg")
def mean_degree_count(spark, d):
    """Mean over graphs of how many vertices have a degree; graphs without that degree don't count."""
    h = two_graphs(spark, d).groupBy("gid", "deg").agg(F.count(F.lit(1)).alias("c"))
    return h.groupBy(F.col("deg").alias("k")).agg(F.round(F.avg("c"), 6).alias("mean_cnt"))


@query(f"{_TWO} SELECT gid, round(avg(deg), 6) AS mean, round(stddev_samp(deg), 6) AS std, CAST(median(deg) AS DOUBLE) AS med, min(deg) AS lo, max(deg) AS hi, round(stddev_samp(deg) / sqrt(count(*)), 6) AS sem FROM x GROUP BY gid")
def degree_summary(spark, d):
    x = two_graphs(spark, d)
    return x.groupBy("gid").agg(F.round(F.avg("deg"), 6).alias("mean"), F.round(F.stddev_samp("deg"), 6).alias("std"), F.percentile("deg", F.lit(0.5)).alias("med"), F.min("deg").alias("lo"), F.max("deg").alias("hi"), F.round(F.stddev_samp("deg") / F.sqrt(F.count(F.lit(1))), 6).alias("sem"))


@query(f"{_TWO}, r AS (SELECT gid, deg, row_number() OVER (PARTITION BY gid ORDER BY deg DESC) AS rank FROM x) SELECT CAST(rank AS BIGINT) AS rank, round(avg(deg), 6) AS mean, CAST(count(*) AS BIGINT) AS graphs FROM r GROUP BY rank")
def degree_rank_series(spark, d):
    """Mean over graphs of the degree at each rank. Ranks follow from counts per degree: no graph's nodes are sorted in one task."""
    h = two_graphs(spark, d).groupBy("gid", "deg").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("gid").orderBy(F.desc("deg"))
    upto = h.withColumn("hi", F.sum("c").over(w)).withColumn("rank", F.explode(F.sequence(F.col("hi") - F.col("c") + 1, F.col("hi"))))
    return upto.groupBy("rank").agg(F.round(F.avg("deg"), 6).alias("mean"), F.count(F.lit(1)).alias("graphs"))


@query(f"{_TWO}, r AS (SELECT gid, deg, row_number() OVER (PARTITION BY gid ORDER BY deg DESC) AS rank, count(*) OVER (PARTITION BY gid) AS n FROM x) SELECT gid, CAST(rank AS BIGINT) AS rank, deg FROM r WHERE (rank - 1) % CAST(ceil(n / 75.0) AS BIGINT) = 0")
def degree_rank_decimated(spark, d):
    """The degree at every ceil(n / 75)-th rank of each graph."""
    h = two_graphs(spark, d).groupBy("gid", "deg").agg(F.count(F.lit(1)).alias("c"))
    w, whole = Window.partitionBy("gid").orderBy(F.desc("deg")), Window.partitionBy("gid")
    s = h.withColumn("hi", F.sum("c").over(w)).withColumn("step", F.ceil(F.sum("c").over(whole) / 75))
    first = F.ceil((F.col("hi") - F.col("c")) / F.col("step")) * F.col("step")
    return s.filter(first < F.col("hi")).select("gid", "deg", F.explode(F.sequence(first, F.col("hi") - 1, F.col("step"))).alias("r")).select("gid", (F.col("r") + 1).alias("rank"), "deg")


@query(f"WITH {PARTS}, {DEG}, c AS (SELECT deg AS x, count(*) AS c FROM d GROUP BY deg) SELECT x, round(sum(c) OVER (ORDER BY x) / CAST(sum(c) OVER () AS DOUBLE), 9) AS f FROM c")
def ecdf_degree(spark, d):
    return core.ecdf(core.degrees(views.parts(spark, d)), "deg").withColumn("f", F.round("f", 9))


_BIN = "CASE WHEN deg <= 1 THEN deg ELSE CAST(floor(log2(deg) + 1e-9) AS BIGINT) + 1 END"


@query(f"WITH {PARTS}, {DEG}, b AS (SELECT {_BIN} AS bin, deg FROM d) SELECT bin, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges, CAST(CASE WHEN bin <= 1 THEN bin ELSE pow(2, bin - 1) END AS BIGINT) AS start FROM b GROUP BY bin")
def bin_wedges(spark, d):
    """Nodes and wedges per exponential degree bin, and where each bin starts."""
    x = core.degrees(views.parts(spark, d)).withColumn("bin", mdl.degree_bin(F.col("deg")))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("deg") * (F.col("deg") - 1) / 2).cast("long")).alias("wedges")).withColumn("start", mdl.degree_bin_start(F.col("bin")))


@query("SELECT CAST(x AS BIGINT) AS x, CASE WHEN x <= 1 THEN CAST(x AS BIGINT) ELSE CAST(floor(log2(x) + 1e-9) AS BIGINT) + 1 END AS bin FROM (SELECT unnest(range(1, 1025)) AS x)")
def binlookup(spark, d):
    return spark.range(1, 1025).select(F.col("id").alias("x"), mdl.degree_bin(F.col("id")).alias("bin"))


@query(f"WITH {PARTS}, {DEG}, {SYM}, n AS (SELECT s.u, avg(d.deg) AS m FROM s JOIN d ON d.id = s.v GROUP BY s.u) SELECT d.deg, CAST(count(*) AS BIGINT) AS nodes, round(avg(m), 6) AS avg_nbr FROM n JOIN d ON d.id = n.u GROUP BY d.deg")
def avg_neighbor_degree(spark, d):
    return core.avg_neighbour_degree(views.parts(spark, d)).withColumn("avg_nbr", F.round("avg_nbr", 6))


@query(f"WITH {PARTS}, {DEG}, h AS (SELECT ln(deg) AS x, ln(count(*)) AS y FROM d GROUP BY deg) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, CAST(count(*) AS BIGINT) AS points FROM h")
def powerlaw_fit(spark, d):
    """Least squares in log-log of the degree histogram."""
    h = core.degrees(views.parts(spark, d)).groupBy("deg").agg(F.count(F.lit(1)).alias("c"))
    h = h.select(F.log("deg").alias("x"), F.log("c").alias("y"))
    return h.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.count(F.lit(1)).alias("points"))


@query(f"WITH {SUPPLIERS} SELECT u, v, w, round(w / CAST(sum(w) OVER (PARTITION BY u) AS DOUBLE), 9) AS p FROM g")
def prod_rule_normalize(spark, d):
    """Counts as probabilities within their left-hand side."""
    g = views.suppliers(spark, d)
    return g.withColumn("p", F.round(core.share(F.col("w"), "u"), 9))


@query(f"WITH p AS (SELECT u, v FROM (WITH {PARTS} SELECT u, v FROM g)), q AS (SELECT u, v FROM (WITH {PARTS45} SELECT u, v FROM g)) SELECT * FROM p UNION SELECT * FROM q")
def union_phases(spark, d):
    """Union of two generated edge sets, distinct."""
    return views.parts(spark, d).select("u", "v").union(views.parts45(spark, d).select("u", "v")).distinct()


@query(f"WITH {BUYERS}, ideal AS (SELECT a.u, b.v FROM (SELECT DISTINCT u FROM g WHERE u % 5 = 0) a, (SELECT DISTINCT v FROM g WHERE v % 50 = 0) b) SELECT u, v FROM g INTERSECT SELECT u, v FROM ideal")
def bipartite_intersection(spark, d):
    """Edges of the graph that an ideal bipartite core between two sides holds: membership on both sides, no product is formed."""
    return views.buyers(spark, d).filter("u % 5 = 0 AND v % 50 = 0").select("u", "v").distinct()


@query(f"WITH {LABELLED}, kept AS (SELECT * FROM sv WHERE label <> 'nation'), e AS (SELECT * FROM se WHERE label <> 'in' AND v1 IN (SELECT vid FROM kept) AND v2 IN (SELECT vid FROM kept)) SELECT vid, label, example FROM kept WHERE vid IN (SELECT v1 FROM e UNION SELECT v2 FROM e)")
def label_prune(spark, d):
    """Drop vertices and edges of given labels, then vertices left isolated."""
    from weft.operators.substructure import prune

    v, e = views.labelled(spark, d)
    return prune(v, e, vertex_labels=["nation"], edge_labels=["in"])[0]


@query("WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY href")
def link_targets(spark, d):
    return views.links(spark, d).groupBy("href").agg(F.count(F.lit(1)).alias("n"))
