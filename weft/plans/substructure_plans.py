"""Queries over labelled graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import substructure as sub
from weft.operators.rest import cut
from weft.plans.registry import query
from weft.sources import views
from weft.sources.views import LABELLED, PARTS
from weft.streaming import discovery

_ONE = f"WITH {LABELLED}, x AS (SELECT CASE WHEN NOT directed AND a.label > b.label THEN b.label ELSE a.label END AS l1, se.label AS edge, directed, CASE WHEN NOT directed AND a.label > b.label THEN a.label ELSE b.label END AS l2, a.example FROM se JOIN sv a ON a.vid = v1 JOIN sv b ON b.vid = v2), one AS (SELECT l1, edge, directed, l2, count(*) AS instances, count(DISTINCT example) AS examples FROM x GROUP BY ALL)"


@query(f"WITH {LABELLED} SELECT label, CAST(count(*) AS BIGINT) AS instances, CAST(count(DISTINCT example) AS BIGINT) AS examples FROM sv GROUP BY label HAVING count(*) >= 2")
def initial_substructures(spark, d):
    return sub.initial(views.labelled(spark, d)[0])


@query(f"{_ONE} SELECT l1, edge, directed, l2, CAST(instances AS BIGINT) AS instances, CAST(examples AS BIGINT) AS examples FROM one")
def substructure_extend_1(spark, d):
    return sub.one_edge(*views.labelled(spark, d))


@query(f"WITH {LABELLED} SELECT a.v1 AS c, a.v2 AS o1, b.v2 AS o2 FROM se a JOIN se b ON a.v1 = b.v1 AND a.v2 <> b.v2 JOIN sv c ON c.vid = a.v1 AND c.label = 'BUILDING' JOIN sv x ON x.vid = a.v2 AND x.label = 'order-O' JOIN sv y ON y.vid = b.v2 AND y.label = 'order-F' WHERE a.label = '1-URGENT' AND b.label = '1-URGENT'")
def pattern_star2(spark, d):
    """Matches of a customer with an urgent open and an urgent finished order."""
    v, e = views.labelled(spark, d)
    m = sub.find_instances(v, e, ["BUILDING", "order-O", "order-F"], [(0, 1, "1-URGENT", True), (0, 2, "1-URGENT", True)])
    return m.select(F.get("vs", F.lit(0)).alias("c"), F.get("vs", F.lit(1)).alias("o1"), F.get("vs", F.lit(2)).alias("o2"))


@query(f"WITH {PARTS}, s AS (SELECT u, v FROM g UNION ALL SELECT v, u FROM g) SELECT a.u AS x, a.v AS y, b.v AS z FROM s a JOIN s b ON b.u = a.v AND b.v <> a.u JOIN s c ON c.u = a.u AND c.v = b.v")
def pattern_triangle(spark, d):
    """All (automorphic too) matches of a triangle in an unlabelled graph."""
    g = views.parts(spark, d)
    from weft.operators.core import nodes

    v = nodes(g).select(F.col("id").alias("vid"), F.lit("p").alias("label"))
    e = g.select(F.col("u").alias("v1"), F.col("v").alias("v2"), F.lit("e").alias("label"), F.lit(False).alias("directed"))
    m = sub.find_instances(v, e, ["p", "p", "p"], [(0, 1, "e", False), (1, 2, "e", False), (0, 2, "e", False)])
    return m.select(*[F.get("vs", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


@query(f"{_ONE} SELECT l1, edge, l2, CAST(examples AS BIGINT) AS covered, round(examples / CAST((SELECT count(DISTINCT example) FROM sv) AS DOUBLE), 9) AS value FROM one WHERE directed")
def setcover_value(spark, d):
    v, e = views.labelled(spark, d)
    n = v.select("example").distinct().count()
    return sub.one_edge(v, e).filter("directed").select("l1", "edge", "l2", F.col("examples").alias("covered"), F.round(F.col("examples") / n, 9).alias("value"))


@query(f"WITH {LABELLED} SELECT CAST(count(DISTINCT a.example) AS BIGINT) AS covered FROM se JOIN sv a ON a.vid = v1 JOIN sv b ON b.vid = v2 WHERE a.label = 'BUILDING' AND b.label = 'order-F' AND se.label = '1-URGENT'")
def examples_covered(spark, d):
    v, e = views.labelled(spark, d)
    m = sub.find_instances(v, e, ["BUILDING", "order-F"], [(0, 1, "1-URGENT", True)])
    return m.select(F.element_at("vs", 1).alias("vid")).join(v, "vid").agg(F.countDistinct("example").alias("covered"))


_NL = "(SELECT count(*) FROM (SELECT label FROM sv UNION SELECT label FROM se))"
_LC = "(lgamma(vv + 1) - lgamma(ki + 1) - lgamma(vv - ki + 1)) / ln(2)"


@query(f"WITH {LABELLED}, k AS (SELECT s, count(*) AS ki FROM (SELECT DISTINCT CASE WHEN directed THEN v1 ELSE least(v1, v2) END AS s, CASE WHEN directed THEN v2 ELSE greatest(v1, v2) END AS t FROM se) GROUP BY s), n AS (SELECT (SELECT count(*) FROM sv) AS vv, (SELECT count(*) FROM se) AS ee, log2({_NL}) AS lg, (SELECT max(c) FROM (SELECT count(*) AS c FROM se GROUP BY least(v1, v2), greatest(v1, v2))) AS mm), a AS (SELECT sum({_LC}) AS rb, max(ki) AS b, sum(ki) AS kk FROM k, n) SELECT CAST(vv AS BIGINT) AS vertices, CAST(ee AS BIGINT) AS edges, round(log2(vv) + vv * lg + (vv + 1) * log2(b + 1) + rb + ee * (1 + lg) + (kk + 1) * log2(mm), 2) AS bits FROM n, a")
def subdue_mdl(spark, d):
    return sub.graph_mdl(*views.labelled(spark, d)).withColumn("bits", F.round("bits", 2))


@query(f"{_ONE}, t AS (SELECT (SELECT count(*) FROM sv) + (SELECT count(*) FROM se) AS s) SELECT l1, edge, l2, round(s / CAST(3 + s - 2 * instances AS DOUBLE), 9) AS value FROM one, t WHERE directed")
def size_value(spark, d):
    """Value by size of one-edge substructures if every instance is compressed: each takes one vertex and one edge away."""
    v, e = views.labelled(spark, d)
    s = v.count() + e.count()
    return sub.one_edge(v, e).filter("directed").select("l1", "edge", "l2", F.round(F.lit(s) / (F.lit(3 + s) - 2 * F.col("instances")), 9).alias("value"))


@query(f"{_ONE} SELECT l1, edge, l2, CAST(instances AS BIGINT) AS instances FROM one WHERE directed ORDER BY instances DESC, l1 || edge || l2 LIMIT 5")
def beam_topk(spark, d):
    """The five most frequent one-edge substructures (a top-k report)."""
    x = sub.one_edge(*views.labelled(spark, d)).filter("directed").select("l1", "edge", "l2", "instances", F.col("instances").cast("double").alias("value"), F.concat("l1", "edge", "l2").alias("canon"))
    return sub.beam(x, 5).select("l1", "edge", "l2", "instances")


@query(f"{_ONE}, r AS (SELECT *, dense_rank() OVER (ORDER BY examples DESC) AS k FROM one WHERE directed) SELECT l1, edge, l2, CAST(examples AS BIGINT) AS examples FROM r WHERE k <= 2")
def beam_valuebased(spark, d):
    """All one-edge substructures with the two best distinct values."""
    x = sub.one_edge(*views.labelled(spark, d)).filter("directed").select("l1", "edge", "l2", "examples", F.col("examples").cast("double").alias("value"), F.concat("l1", "edge", "l2").alias("canon"))
    return sub.beam(x, 2, by_value=True).select("l1", "edge", "l2", "examples")


_SAID = f"WITH {LABELLED}, p AS (SELECT c_custkey, c_acctbal > 0 AS truth, c_custkey * 4 IN (SELECT v1 FROM se JOIN sv ON sv.vid = v2 WHERE se.label = '1-URGENT' AND sv.label = 'order-F') AS said, ((c_custkey * 1103515245 + 12345) % 2147483648) % 5 AS fold FROM customer)"


def said(spark, d):
    """Customers with a positive balance (truth) and with an urgent finished order (said)."""
    v, e = views.labelled(spark, d)
    hit = e.filter("label = '1-URGENT'").join(v.filter("label = 'order-F'").select(F.col("vid").alias("v2")), "v2", "left_semi").select((F.col("v1") / 4).cast("long").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    c = views.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("truth"))
    return c.join(hit, "c_custkey", "left").select("c_custkey", "truth", F.coalesce("hit", F.lit(False)).alias("said"))


@query(f"{_SAID} SELECT CAST(count(*) FILTER (truth AND said) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT truth AND NOT said) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT truth AND said) AS BIGINT) AS fp, CAST(count(*) FILTER (truth AND NOT said) AS BIGINT) AS fn, round(count(*) FILTER (truth <> said) / CAST(count(*) AS DOUBLE), 9) AS error FROM p")
def confusion_matrix(spark, d):
    return sub.confusion(said(spark, d)).withColumn("error", F.round("error", 9))


@query(f"{_SAID} SELECT CAST(fold AS BIGINT) AS fold, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (truth <> said) / CAST(count(*) AS DOUBLE), 9) AS error FROM p GROUP BY fold")
def kfold_error(spark, d):
    p = said(spark, d).withColumn("fold", sub.fold(F.col("c_custkey"), 5))
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("truth") != F.col("said")) / F.count(F.lit(1)), 9).alias("error"))


def instances(v, e):
    """Disjoint instances of all directed one-edge substructures."""
    lab = lambda i: v.select(F.col("vid").alias(f"v{i}"), F.col("label").alias(f"l{i}"))
    x = e.filter("directed").join(lab(1), "v1").join(lab(2), "v2")
    return sub.disjoint(x.select(F.concat_ws("|", "l1", "label", "l2").alias("canon"), F.array_sort(F.array("v1", "v2")).alias("vs"), F.array("eid").alias("es")))


def halves(spark, d):
    """The labelled graph of even nations (positive) and of odd ones (negative), each with its disjoint one-edge instances."""
    v, e = views.labelled(spark, d)
    v, e = cut(v, "v"), cut(sub.with_ids(e), "e")
    for odd in (0, 1):
        w = v.filter(F.pmod("example", F.lit(2)) == odd)
        x = e.join(w.select(F.col("vid").alias("v1")), "v1", "left_semi").join(w.select(F.col("vid").alias("v2")), "v2", "left_semi")
        yield cut(instances(w, x), "inst"), cut(w, "v"), cut(x, "e")


# one instance per customer and substructure: orders are met by one customer only, so the first in order of vertices goes
_INST = f"""{LABELLED}, i0 AS (SELECT a.label || '|' || se.label || '|' || b.label AS canon, v1, v2, a.example % 2 AS half, a.example FROM se JOIN sv a ON a.vid = v1 JOIN sv b ON b.vid = v2 WHERE directed),
inst AS (SELECT canon, half, v1, arg_min(v2, least(v1, v2) || ',' || greatest(v1, v2) || ']') AS v2, any_value(example) AS example FROM i0 GROUP BY canon, half, v1),
k AS (SELECT half, canon, count(*) AS k, count(DISTINCT example) AS examples FROM inst GROUP BY 1, 2)"""
_OUT = "p.canon, CAST(p.k AS BIGINT) AS instances, CAST(p.examples AS BIGINT) AS examples"


@query(f"WITH {_INST}, t AS (SELECT half, count(*) + (SELECT count(*) FROM se JOIN sv ON vid = v1 WHERE example % 2 = half) AS s FROM (SELECT example % 2 AS half FROM sv) GROUP BY half) SELECT {_OUT}, round((a.s + b.s) / CAST(3 + a.s - 2 * p.k + b.s - (b.s - 2 * coalesce(n.k, 0)) AS DOUBLE), 9) AS value FROM k p LEFT JOIN k n ON n.canon = p.canon AND n.half = 1 JOIN t a ON a.half = 0 JOIN t b ON b.half = 1 WHERE p.half = 0")
def subdue_value_size(spark, d):
    """Values by size of one-edge substructures with the odd nations' graph as the negative one."""
    (i, v, e), neg = halves(spark, d)
    return sub.evaluate(i, v, e, "size", neg).withColumn("value", F.round("value", 9))


@query(f"WITH {_INST}, x AS (SELECT count(DISTINCT example) FILTER (example % 2 = 0) AS p, count(DISTINCT example) FILTER (example % 2 = 1) AS q FROM sv) SELECT {_OUT}, round((p.examples + x.q - coalesce(n.examples, 0)) / CAST(x.p + x.q AS DOUBLE), 9) AS value FROM k p LEFT JOIN k n ON n.canon = p.canon AND n.half = 1, x WHERE p.half = 0")
def subdue_value_setcover(spark, d):
    """Values by covered examples of one-edge substructures: even nations are to be covered, odd ones not."""
    (i, v, e), neg = halves(spark, d)
    return sub.evaluate(i, v, e, "setcover", neg).withColumn("value", F.round("value", 9))


_LCB = "(lgamma(vv + 1) - lgamma(ki + 1) - lgamma(vv - ki + 1)) / ln(2)"


def _mdl_sql(edges: str, key: str, sizes: str, labels: str) -> str:
    """Bits per ``key`` of graphs whose edges (key, s, t, directed; rows of undirected edges first) and sizes (key, vv, ee) are given."""
    return f"""SELECT z.{key}, log2(vv) + vv * log2({labels}) + (vv + 1) * log2(coalesce(b, 0) + 1) + coalesce(rb, 0) + ee * (1 + log2({labels})) + (coalesce(kk, 0) + 1) * log2(greatest(coalesce(mm, 1), 1)) AS bits FROM {sizes} z
 LEFT JOIN (SELECT {key}, sum({_LCB}) AS rb, max(ki) AS b, sum(ki) AS kk FROM (SELECT {key}, s, count(DISTINCT t) AS ki FROM {edges} GROUP BY 1, 2) JOIN {sizes} USING ({key}) GROUP BY 1) r USING ({key})
 LEFT JOIN (SELECT {key}, max(c) AS mm FROM (SELECT {key}, count(*) AS c FROM {edges} GROUP BY {key}, least(s, t), greatest(s, t)) GROUP BY 1) m USING ({key})"""


# every substructure's compressed graph written out: vertices are [0, instance] or [1, vertex]
_MDL = f"""WITH {_INST}, nl AS (SELECT count(*) AS l FROM (SELECT label FROM sv UNION SELECT label FROM se)),
se2 AS (SELECT se.*, example % 2 AS half FROM se JOIN sv ON vid = v1),
gs AS (SELECT half, count(*) AS vv, (SELECT count(*) FROM se2 WHERE se2.half = h.half) AS ee FROM (SELECT example % 2 AS half FROM sv) h GROUP BY half),
ge AS (SELECT half, CASE WHEN directed THEN v1 ELSE least(v1, v2) END AS s, CASE WHEN directed THEN v2 ELSE greatest(v1, v2) END AS t FROM se2),
plain AS ({_mdl_sql('ge', 'half', 'gs', '(SELECT l FROM nl)')}), plain1 AS ({_mdl_sql('ge', 'half', 'gs', '(SELECT l + 1 FROM nl)')}),
ck AS (SELECT k.half || '~' || k.canon AS hc, k.half, k.canon, k.k FROM k), cs AS (SELECT hc, vv - ck.k AS vv, ee - ck.k AS ee FROM ck JOIN gs USING (half)),
cov AS (SELECT half || '~' || canon AS hc, least(v1, v2) AS sub, unnest([v1, v2]) AS vid FROM inst), used AS (SELECT half || '~' || canon AS hc, v1, v2 FROM inst),
ce AS (SELECT ck.hc, directed, CASE WHEN a.sub IS NULL THEN [1, se2.v1] ELSE [0, a.sub] END AS x, CASE WHEN b.sub IS NULL THEN [1, se2.v2] ELSE [0, b.sub] END AS y
 FROM ck JOIN se2 USING (half) LEFT JOIN cov a ON a.hc = ck.hc AND a.vid = se2.v1 LEFT JOIN cov b ON b.hc = ck.hc AND b.vid = se2.v2 LEFT JOIN used u ON u.hc = ck.hc AND u.v1 = se2.v1 AND u.v2 = se2.v2 AND directed WHERE u.hc IS NULL),
cr AS (SELECT hc, CASE WHEN directed OR x <= y THEN x ELSE y END AS s, CASE WHEN directed OR x <= y THEN y ELSE x END AS t FROM ce),
ext AS (SELECT hc, sum(CASE WHEN x[1] = 0 THEN 1 ELSE 0 END + CASE WHEN y[1] = 0 THEN 1 ELSE 0 END) AS ends FROM ce GROUP BY 1),
cb AS (SELECT hc, bits + coalesce(ends, 0) AS bits FROM ({_mdl_sql('cr', 'hc', 'cs', '(SELECT l + 1 FROM nl)')}) LEFT JOIN ext USING (hc)),
own AS (SELECT 1 + 2 * log2(l) + 3 * log2(2) + 1 + 1 * (1 + log2(l)) + 0 AS s FROM nl)"""


@query(f"{_MDL} SELECT {_OUT}, round((a.bits + b.bits) / (own.s + cp.bits + b.bits - coalesce(cn.bits, b1.bits)), 7) AS value FROM k p JOIN cb cp ON cp.hc = '0~' || p.canon LEFT JOIN cb cn ON cn.hc = '1~' || p.canon JOIN plain a ON a.half = 0 JOIN plain b ON b.half = 1 JOIN plain1 b1 ON b1.half = 1, own WHERE p.half = 0")
def subdue_value_mdl(spark, d):
    """Values by description length of one-edge substructures with the odd nations' graph as the negative one."""
    (i, v, e), neg = halves(spark, d)
    return sub.evaluate(i, v, e, "mdl", neg).withColumn("value", F.round("value", 7))


@query()
def subdue_discover(spark, d):
    """Best compressing substructures of the labelled graph by beam search over disjoint instances, pruned (a top-k report)."""
    v, e = views.labelled(spark, d)
    return sub.discover(v, e, sub.Search(by="mdl", prune=True))


@query(f"{_ONE} SELECT a.l1, a.edge, a.directed, a.l2, CAST(sum(b.instances) AS BIGINT) AS instances FROM one a JOIN one b ON a.directed = b.directed AND CAST(a.l1 <> b.l1 AS INTEGER) + CAST(a.edge <> b.edge AS INTEGER) + CAST(a.l2 <> b.l2 AS INTEGER) <= 1 GROUP BY ALL")
def inexact_match(spark, d):
    """Instances of each one-edge substructure, with those that are one edit away (a threshold of 0.34 of three parts)."""
    v, e = views.labelled(spark, d)
    v, e = cut(v, "v"), cut(sub.with_ids(e), "e")
    own = cut(sub.with_canon(e.select(F.array_sort(F.array("v1", "v2")).alias("vs"), F.array("eid").alias("es")), v, e), "own")
    near = sub.alike(own, v, e, 0.34).groupBy("canon").agg(F.count(F.lit(1)).alias("instances"))
    swap = ~F.col("directed") & (F.col("l1") > F.col("l2"))
    name = sub.with_labels(v, own.select("canon", F.get("es", F.lit(0)).alias("eid")).join(e, "eid")).select("canon", F.when(swap, F.col("l2")).otherwise(F.col("l1")).alias("l1"), F.col("label").alias("edge"), "directed", F.when(swap, F.col("l1")).otherwise(F.col("l2")).alias("l2")).distinct()
    return near.join(name, "canon").select("l1", "edge", "directed", "l2", "instances")


@query(f"""WITH {LABELLED}, i AS (SELECT v1, v2 FROM se JOIN sv a ON a.vid = v1 JOIN sv b ON b.vid = v2 WHERE a.label = 'BUILDING' AND se.label = '1-URGENT' AND b.label = 'order-F'),
c AS (SELECT v1, count(*) AS k FROM i GROUP BY v1), o AS (SELECT c.v1, k, count(*) AS others FROM c JOIN (SELECT v1 AS x, v1, v2 FROM se UNION ALL SELECT v2, v1, v2 FROM se) y ON y.x = c.v1 LEFT JOIN i ON i.v1 = y.v1 AND i.v2 = y.v2 WHERE i.v1 IS NULL GROUP BY 1, 2)
SELECT CAST((SELECT count(*) FROM sv) - (SELECT count(*) FROM c) AS BIGINT) AS vertices, CAST((SELECT count(*) FROM se) - (SELECT count(*) FROM i) + (SELECT sum(k - 1) FROM c) + (SELECT coalesce(sum((k - 1) * others), 0) FROM o) AS BIGINT) AS edges, CAST((SELECT sum(k - 1) FROM c) AS BIGINT) AS overlaps""")
def compressed_graph(spark, d):
    """The graph once all urgent finished orders of a segment's customers are one vertex with their customer each, where a customer's instances overlap."""
    v, e = views.labelled(spark, d)
    v, e = cut(v, "v"), cut(sub.with_ids(e), "e")
    own = sub.instances_of(sub.with_labels(v, e).withColumn("batch", F.lit(0)), sub.canonical(["BUILDING", "order-F"], [(0, 1, "1-URGENT", True)]))
    nv, ne = sub.compress_overlapping(v, e, own)
    return ne.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("label") == "OVERLAP").alias("overlaps")).join(nv.agg(F.count(F.lit(1)).alias("vertices")))


#: A customer with three kinds of orders, and a nation with a customer of two: three edges each, whose orders come in different months.
SPANNING = (
    sub.canonical(["BUILDING", "order-F", "order-F", "order-O"], [(0, 1, "1-URGENT", True), (0, 2, "2-HIGH", True), (0, 3, "5-LOW", True)]),
    sub.canonical(["nation", "AUTOMOBILE", "order-F", "order-O"], [(1, 0, "in", False), (1, 2, "1-URGENT", True), (1, 3, "1-URGENT", True)]),
)


def by_month(spark, d):
    """The labelled graph with the increment each part came in: customers and nations in 0, orders in their months from 1992 on."""
    v, e = views.labelled(spark, d)
    o = views.table(spark, d, "orders").select((F.col("o_orderkey").cast("long") * 4 + 1).alias("vid"), ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).alias("month"))
    batch = F.coalesce("month", F.lit(0)).alias("batch")
    v = v.join(o, "vid", "left").select("vid", "label", "example", batch)
    e = sub.with_ids(e).join(o.withColumnRenamed("vid", "v2"), "v2", "left").select("eid", "v1", "v2", "label", "directed", batch)
    return cut(v, "v"), cut(e, "e")


_MONTHS = f"""WITH {LABELLED}, om AS (SELECT o_orderkey * 4 + 1 AS vid, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS m FROM orders),
s AS (SELECT batch, CAST(sum(sum(n)) OVER (ORDER BY batch) AS BIGINT) AS size FROM (SELECT coalesce(m, 0) AS batch, 1 AS n FROM sv LEFT JOIN om USING (vid) UNION ALL SELECT coalesce(m, 0), 1 FROM se LEFT JOIN om ON om.vid = v2) GROUP BY batch),
x AS (SELECT c.vid AS c, c.label AS cl, c.example, se.label AS edge, o.label AS ol, min(m) AS m FROM se JOIN sv c ON c.vid = v1 JOIN sv o ON o.vid = v2 JOIN om ON om.vid = v2 GROUP BY ALL),
a AS (SELECT '{SPANNING[0]}' AS canon, greatest(p.m, q.m, r.m) AS m FROM x p JOIN x q USING (c) JOIN x r USING (c) WHERE p.cl = 'BUILDING' AND p.edge = '1-URGENT' AND p.ol = 'order-F' AND q.edge = '2-HIGH' AND q.ol = 'order-F' AND r.edge = '5-LOW' AND r.ol = 'order-O'),
b AS (SELECT '{SPANNING[1]}' AS canon, min(greatest(p.m, q.m)) AS m FROM x p JOIN x q USING (c) WHERE p.cl = 'AUTOMOBILE' AND p.edge = '1-URGENT' AND p.ol = 'order-F' AND q.edge = '1-URGENT' AND q.ol = 'order-O' GROUP BY p.example),
k AS (SELECT canon, m AS batch, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL),
y AS (SELECT batch, canon, size, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY canon ORDER BY batch) AS BIGINT) AS instances FROM s CROSS JOIN (SELECT unnest(['{SPANNING[0]}', '{SPANNING[1]}']) AS canon) LEFT JOIN k USING (batch, canon))
SELECT CAST(batch AS INTEGER) AS batch, canon, instances, round(size / CAST(7 + size + instances - 7 * instances AS DOUBLE), 9) AS value FROM y"""


@query(_MONTHS)
def values_by_month(spark, d):
    """Values of two substructures of three edges after each month's orders; most instances have orders of several months."""
    return discovery.by_increment(*by_month(spark, d), list(SPANNING)).withColumn("value", F.round("value", 9))
