"""Queries of samples, cliques, covers and per-block growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import compare, core, grammar, sampling, selection, substructure, summary, temporal
from weft.operators.rest import cut
from weft.plans import temporal_plans
from weft.plans.registry import SQL, query
from weft.plans.structure import DEG, SYM
from weft.sources import views
from weft.sources.views import LABELLED, PARTS, PARTS45, SUPPLIERS, uniform_sql

_RANK = "((s * 4 + {0} + 1) * 1103515245 + 12345) % 2147483648 % (SELECT count(*) FROM i)"


@query(f"""WITH {SUPPLIERS}, gg AS (SELECT u, v FROM g WHERE w >= 26), i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT u AS id FROM gg UNION SELECT v FROM gg)),
dr AS (SELECT s, {', '.join(_RANK.format(k) + f' AS r{k}' for k in range(4))} FROM (SELECT unnest(range(0, 20000)) AS s)),
q AS (SELECT s, a.id AS n0, b.id AS n1, c.id AS n2, e.id AS n3 FROM dr JOIN i a ON a.n = r0 JOIN i b ON b.n = r1 JOIN i c ON c.n = r2 JOIN i e ON e.n = r3 WHERE len(list_distinct([r0, r1, r2, r3])) = 4),
p AS (SELECT s, a, b, least([n0, n1, n2, n3][a + 1], [n0, n1, n2, n3][b + 1]) AS u, greatest([n0, n1, n2, n3][a + 1], [n0, n1, n2, n3][b + 1]) AS v FROM q, (VALUES (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) x(a, b)),
h AS (SELECT s, a, b FROM p JOIN gg USING (u, v)), k AS (SELECT s, k, count(*) AS d FROM (SELECT s, a AS k FROM h UNION ALL SELECT s, b FROM h) GROUP BY 1, 2), z AS (SELECT s, sum(d) // 2 AS m, max(d) AS top, count(*) AS t FROM k GROUP BY s)
SELECT CASE WHEN m IS NULL THEN 'e0' WHEN m = 1 THEN 'e1' WHEN m = 2 AND t = 4 THEN 'e2' WHEN m = 2 THEN 'e2c' WHEN m = 3 AND t = 3 THEN 'tri' WHEN m = 3 AND top = 3 THEN 'star' WHEN m = 3 THEN 'p3' WHEN m = 4 AND top = 3 THEN 'tritail' WHEN m = 4 THEN 'square' WHEN m = 5 THEN 'squarediag' ELSE 'k4' END AS kind, CAST(count(*) AS BIGINT) AS cnt FROM q LEFT JOIN z USING (s) GROUP BY 1""")
def subgraph_census(spark, d):
    """Census of four-node subgraphs over 20,000 numbered draws (a sampling operator)."""
    return sampling.census(views.suppliers(spark, d).filter("w >= 26"), 20_000)


_R = uniform_sql(0, "bin", "i")


@query(f"""WITH {PARTS}, {DEG}, {SYM}, x AS (SELECT id, deg, CAST(floor(log2(deg) + 1e-9) AS BIGINT) + 1 AS bin FROM d WHERE deg >= 2),
h AS (SELECT *, sum(wedges) OVER (PARTITION BY bin ORDER BY deg) AS hi, sum(wedges) OVER (PARTITION BY bin) AS a FROM (SELECT bin, deg, count(*) AS n, count(*) * deg * (deg - 1) / 2 AS wedges FROM x GROUP BY bin, deg)),
dr AS (SELECT * FROM (SELECT h.*, unnest(range(1, CAST(least(a, 500) AS BIGINT) + 1)) AS i FROM h) WHERE {_R} * a < hi AND {_R} * a >= hi - wedges),
o AS (SELECT id, deg, row_number() OVER (PARTITION BY deg ORDER BY id % 64, id) - 1 AS k FROM x),
p AS (SELECT bin, i, id, CAST(floor({uniform_sql(2, 'bin', 'i')} * deg) AS BIGINT) AS x1, CAST(floor({uniform_sql(3, 'bin', 'i')} * (deg - 1)) AS BIGINT) AS y1 FROM dr JOIN o USING (deg) WHERE k = CAST(floor({uniform_sql(1, 'bin', 'i')} * n) AS BIGINT)),
nb AS (SELECT u, list(v ORDER BY v) AS l FROM s GROUP BY u),
t AS (SELECT bin, l[x1 + 1] AS x, l[CASE WHEN y1 >= x1 THEN y1 + 1 ELSE y1 END + 1] AS y FROM p JOIN nb ON nb.u = p.id)
SELECT bin, CAST(count(*) AS BIGINT) AS samples, round(avg(CASE WHEN g.u IS NULL THEN 0 ELSE 1 END), 9) AS cd FROM t LEFT JOIN g ON g.u = least(x, y) AND g.v = greatest(x, y) GROUP BY bin""")
def wedge_sampled_clustering(spark, d):
    return sampling.sampled_clustering(views.parts(spark, d), 500).select(F.col("bin").cast("long").alias("bin"), "samples", F.round("cd", 9).alias("cd"))


@query(f"""WITH RECURSIVE {temporal_plans._B.removeprefix("WITH ")}, e AS (SELECT DISTINCT block, least(src, trg) AS u, greatest(src, trg) AS v FROM y), s2 AS (SELECT block, u, v FROM e UNION ALL SELECT block, v, u FROM e),
c AS (SELECT block, [u, v] AS q FROM e UNION ALL SELECT c.block, list_append(c.q, s2.v) FROM c JOIN s2 ON s2.block = c.block AND s2.v > c.q[-1] AND list_contains(c.q, s2.u) GROUP BY c.block, c.q, s2.v HAVING count(*) = len(c.q)),
w AS (SELECT DISTINCT block, q FROM (SELECT c.block, c.q, s2.v FROM c JOIN s2 ON s2.block = c.block AND list_contains(c.q, s2.u) GROUP BY c.block, c.q, s2.v HAVING count(*) = len(c.q)))
SELECT CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS cliques, round(avg(len(q)), 9) AS mean_size FROM (SELECT block, q FROM c EXCEPT SELECT block, q FROM w) GROUP BY block""")
def clique_sizes_per_block(spark, d):
    return temporal.clique_sizes(views.users(spark, d)).withColumn("mean_size", F.round("mean_size", 9))


@query()
def dfs_sample(spark, d):
    g = views.parts(spark, d)
    return sampling.dfs_sample(g, core.nodes(g).agg(F.min("id")).first()[0], 50)


@query()
def degree_parameters(spark, d):
    g = core.degrees(views.parts(spark, d))
    r = g.agg(F.avg("deg").alias("a"), F.max("deg").alias("m")).first()
    a, b = sampling.fit_degree_distribution(float(r.a), 50 * int(r.m))
    (c,) = sampling.fit_degree_distribution(float(r.a), 50 * int(r.m), "power-law")
    return spark.createDataFrame([(a, b, c)], "alpha double, beta double, gamma double")


@query(f"WITH p AS (SELECT deg, count(*) AS c FROM (WITH {PARTS}, {DEG} SELECT deg FROM d) GROUP BY 1), q AS (SELECT deg, count(*) AS c FROM (WITH {PARTS45}, {DEG} SELECT deg FROM d) GROUP BY 1) SELECT coalesce(p.deg, q.deg) AS deg, CAST(coalesce(p.c, 0) AS BIGINT) AS first, CAST(coalesce(q.c, 0) AS BIGINT) AS second FROM p FULL JOIN q ON p.deg = q.deg")
def degree_tables_side_by_side(spark, d):
    """Vertex counts per degree of two graphs, aligned by a full outer join; 0 where a graph lacks the degree."""
    h = lambda g, n: core.degrees(g).groupBy("deg").agg(F.count(F.lit(1)).alias(n))
    return h(views.parts(spark, d), "first").join(h(views.parts45(spark, d), "second"), "deg", "full").na.fill(0)


@query(f"WITH {PARTS45}, {DEG}, h AS (SELECT g.u AS a, g.v AS b FROM g UNION ALL SELECT v, u FROM g), st AS (SELECT a, b FROM h JOIN d ON d.id = h.a WHERE deg >= 4) SELECT a AS sid, least(a, b) AS u, greatest(a, b) AS v FROM st")
def structure_edge_expansion(spark, d):
    """Edges of the stars around all nodes of degree four or more."""
    g = views.parts45(spark, d)
    hub = core.degrees(g).filter("deg >= 4").select(F.col("id").alias("u"))
    s = core.symmetric(g).join(hub, "u", "left_semi").groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("nodes2"))
    return summary.structure_edges(s.select(F.col("u").alias("sid"), F.lit("st").alias("code"), F.array("u").alias("nodes1"), "nodes2"))


@query()
def vog_cost_curve(spark, d):
    g = cut(views.parts(spark, d), "view")
    return selection.cost_curve(g, summary.slashburn(g, k=2))


@query("SELECT CAST(s AS BIGINT) AS s, round((SELECT log2(2.865064) + greatest(a, 0) + greatest(b, 0) + greatest(c, 0) + greatest(e, 0) FROM (SELECT a, b, c, CASE WHEN c > 0 THEN log2(c) ELSE 0.0 END AS e FROM (SELECT a, b, CASE WHEN b > 0 THEN log2(b) ELSE 0.0 END AS c FROM (SELECT a, CASE WHEN a > 0 THEN log2(a) ELSE 0.0 END AS b FROM (SELECT log2(s - 1) AS a))))) + (lgamma(1001) - lgamma(1001 - s)) / ln(2), 5) AS ch FROM (SELECT unnest(range(3, 61)) AS s)")
def chain_labelling_cost(spark, d):
    """Bits of a chain whose nodes are named in order, in a graph of 1,000 nodes."""
    return spark.range(3, 61).select(F.col("id").alias("s"), F.round(summary.labelling_bits("ch", F.lit(1000), F.col("id")), 5).alias("ch"))


@query()
def rules_per_block(spark, d):
    return temporal.rules_per_block(views.users(spark, d))


@query(f"SELECT block, nodes, edges, total_nodes, total_edges, mean_degree FROM ({SQL['mean_degree_per_block']}) JOIN (SELECT block, nodes AS total_nodes, edges AS total_edges FROM ({SQL['cumulative_snapshots']})) USING (block)")
def evolving_structure(spark, d):
    return temporal.evolution(views.users(spark, d)).withColumn("mean_degree", F.round("mean_degree", 9))


@query(f"WITH {LABELLED}, one AS (SELECT a.vid AS x, b.vid AS y FROM se JOIN sv a ON a.vid = v1 JOIN sv b ON b.vid = v2 WHERE directed AND a.label = 'BUILDING' AND b.label = 'order-F') SELECT x AS vid, CAST(count(*) AS BIGINT) AS members FROM one GROUP BY x HAVING count(*) > 1")
def overlapping_vertices(spark, d):
    """Customers that several instances of a one-edge substructure share."""
    v, e = views.labelled(spark, d)
    pairs = e.filter("directed").select("v1", "v2").join(v.filter("label = 'BUILDING'").select(F.col("vid").alias("v1")), "v1", "left_semi").join(v.filter("label = 'order-F'").select(F.col("vid").alias("v2")), "v2", "left_semi")
    return substructure.overlaps(pairs.select(F.lit("p").alias("canon"), F.array("v1", "v2").alias("vs"))).select("vid", "members")


@query(f"WITH {LABELLED}, k AS (SELECT v2, v1 FROM se JOIN sv a ON a.vid = v1 AND a.label = 'BUILDING' JOIN sv b ON b.vid = v2 AND b.label = 'nation'), m AS (SELECT v2, unnest([v1, v2]) AS vid FROM k) SELECT 'x' AS canon, 'in' AS label, min(vid) AS \"group\", string_agg(DISTINCT CAST(vid AS VARCHAR), ',' ORDER BY CAST(vid AS VARCHAR)) AS vs FROM m GROUP BY v2")
def recursive_substructures(spark, d):
    """Groups of customers of one segment joined through their nation; vertices as sorted text."""
    v, e = views.labelled(spark, d)
    i = v.filter("label = 'BUILDING' OR label = 'nation'").select(F.lit("x").alias("canon"), F.array("vid").alias("vs"))
    return substructure.recursive(i, e).withColumn("vs", F.array_join(F.array_sort(F.transform("vs", lambda x: x.cast("string"))), ","))


@query()
def full_information_rules(spark, d):
    """Rules with their boundary edges, lone boundary nodes merged, for node sets of eight ids."""
    g = views.parts45(spark, d)
    groups = core.nodes(g).select(F.floor(F.col("id") / 8).cast("long").alias("grp"), "id")
    return grammar.contract_iso(grammar.full_rules(g, groups))


@query()
def experiment_metrics(spark, d):
    from weft.plans.model_plans import connected

    g = connected(spark, d)
    return compare.run_grid(g, compare.experiment_grid(spark, ["mu_level"], ["random"], [4], 1), "parts45")
