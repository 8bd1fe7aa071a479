"""Queries of reports over several graphs, rules and structures, and of generated increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import cluster, core, grammar, reports, selection, substructure, summary, temporal
from weft.operators.rest import cut
from weft.plans import iterative, model_plans, motif_plans, substructure_plans  # noqa: F401  (their SQL is read here)
from weft.plans.registry import SQL, query
from weft.plans.structure import DEG
from weft.sources import views
from weft.sources.views import LABELLED, PARTS, PARTS45, SUPPLIERS, USERS, draw_sql, uniform_sql
from weft.streaming.increments import random_increments


def _at(sql: str, least: int) -> str:
    return sql.replace(">= 40", f">= {least}").replace(">= 45", f">= {least}").replace(">= 48", f">= {least}")


def two(spark, d):
    """The part graphs of both thresholds, at rest."""
    return [cut(views.parts(spark, d), "view"), cut(views.parts45(spark, d), "view")]


_NAMES = ["triangle", "path3", "clique4", "chordal4", "tailed", "cycle4", "star3", "path4"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS total FROM x" for c in _NAMES)


@query(f"WITH x AS ((SELECT * FROM ({SQL['graphlet_totals']})) UNION ALL (SELECT * FROM ({_at(SQL['graphlet_totals'], 45)}))), y AS ({_LONG}) SELECT name, round(avg(total), 6) AS mu, round(stddev_samp(total), 4) AS st, round(stddev_samp(total) / sqrt(count(*)), 4) AS se, CAST(count(*) AS BIGINT) AS dsc FROM y GROUP BY name")
def graphlet_totals_merged(spark, d):
    t = reports.merged_totals(two(spark, d))
    return t.select("name", F.round("mu", 6).alias("mu"), F.round("st", 4).alias("st"), F.round("se", 4).alias("se"), "dsc")


_HOPS = f"SELECT 0 AS graph, * FROM ({SQL['hop_plot']}) UNION ALL SELECT 1, * FROM ({SQL['hop_plot'].replace(PARTS45, SUPPLIERS)})"


@query(f"WITH h AS ({_HOPS}), k AS (SELECT * FROM (SELECT DISTINCT dist FROM h), (VALUES (0), (1)) g(graph)) SELECT dist, round(avg(coalesce(pairs, 0)), 6) AS mean, round(stddev_samp(coalesce(pairs, 0)), 4) AS st, CAST(count(pairs) AS BIGINT) AS graphs FROM k LEFT JOIN h USING (dist, graph) GROUP BY dist")
def hops_over_graphs(spark, d):
    """Pairs at each distance in the part graph and the supplier graph side by side, from every node."""
    t = reports.hop_table([cut(views.parts45(spark, d), "view"), cut(views.suppliers(spark, d), "view")])
    return t.select("dist", F.round("mean", 6).alias("mean"), F.round("st", 4).alias("st"), "graphs")


@query(f"WITH a AS (WITH {PARTS}, {DEG} SELECT deg, count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE) AS s FROM d GROUP BY deg), b AS (WITH {PARTS45}, {DEG} SELECT deg, count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE) AS s FROM d GROUP BY deg) SELECT deg, round(sum(s), 9) AS total, round(sum(s) / 2, 9) AS mean FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY deg")
def mean_degree_shares(spark, d):
    t = reports.mean_degree_shares(two(spark, d))
    return t.select("deg", F.round("total", 9).alias("total"), F.round("mean", 9).alias("mean"))


@query(f"SELECT CAST(0 AS BIGINT) AS graph, gcd FROM ({SQL['graphlet_correlation_distance'].replace('>= 45', '>= 40')}) UNION ALL SELECT 1, gcd FROM ({SQL['graphlet_correlation_distance']})")
def graphlet_distances_to_original(spark, d):
    a, b = two(spark, d)
    return reports.distances_to(a, [a, b]).select("graph", F.round("gcd", 6).alias("gcd"))


@query()
def grammar_level_costs(spark, d):
    g = model_plans.connected(spark, d)
    rules = grammar.extract(g, cut(cluster.random_tree(g, seed=1), "tree"), mu=4, kind="mu_level")
    return reports.costs_by_level(rules.withColumn("cost", F.round("cost", 6))).withColumn("cost", F.round("cost", 4))


_ALL_KINDS = ", ".join(f"('{k}')" for k in reports.KINDS)


@query(f"SELECT k.code, CAST(count(x.code) AS BIGINT) AS cnt FROM (VALUES {_ALL_KINDS}) k(code) LEFT JOIN ({_at(SQL['vog_exact_structures'], 45)}) x ON x.code = k.code GROUP BY k.code")
def structure_kind_counts(spark, d):
    p = summary.component_profiles(views.parts45(spark, d))
    return reports.kind_counts(p.select(summary.exact_code(F.col("n"), F.col("m"), F.col("top"), F.col("ones")).alias("code")))


@query()
def top_structures(spark, d):
    """The ten structures that save most (a top-k report)."""
    return reports.top_structures(summary.slashburn(cut(views.parts(spark, d), "view"), k=2))


@query()
def model_score(spark, d):
    """Bits and cells of the empty model and of all structures found."""
    g = cut(views.parts(spark, d), "view")
    return selection.score(g, cut(summary.slashburn(g, k=2), "model"))


@query(f"WITH {USERS} SELECT epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10') AS us, src, trg FROM t WHERE ts > TIMESTAMP '2024-01-10'")
def edges_after_origin(spark, d):
    return temporal.after(views.users(spark, d), "2024-01-10 00:00:00")


@query("WITH a AS (SELECT k, -1.5 * ln(k) - 0.01 * k AS p FROM (SELECT unnest(range(1, 400)) AS k)), b AS (SELECT 400 - k AS k, -0.5 * ln(k) - 0.02 * k AS q FROM a), s AS (SELECT a.k, p + q AS l FROM a JOIN b ON b.k = a.k), z AS (SELECT k, exp(l - (SELECT max(l) FROM s)) AS e FROM s) SELECT CAST(k AS BIGINT) AS k, round(e / (SELECT sum(e) FROM z), 9) AS share FROM z")
def split_shares(spark, d):
    """Where 400 symbols are split between two non-terminals of given inside log-probabilities."""
    r = spark.range(1, 401)
    one = r.select(F.lit("A").alias("name"), F.col("id").alias("size"), (-1.5 * F.log("id") - 0.01 * F.col("id")).alias("logp"))
    other = r.select(F.lit("B").alias("name"), F.col("id").alias("size"), (-0.5 * F.log("id") - 0.02 * F.col("id")).alias("logp"))
    return reports.split_shares(one.union(other), "A", "B", 400).withColumn("share", F.round("share", 9))


_RENAMED = "CASE label WHEN 'BUILDING' THEN 'SUB_1' WHEN 'MACHINERY' THEN 'SUB_0' WHEN 'FURNITURE' THEN 'SUB_2x' ELSE label END"


@query(f"WITH {LABELLED} SELECT label, CAST(count(*) AS BIGINT) AS instances, CAST(count(DISTINCT example) AS BIGINT) AS examples FROM (SELECT vid, {_RENAMED} AS label, example FROM sv) WHERE label <> 'SUB_1' GROUP BY label HAVING count(*) >= 2")
def initial_without_lone_substructures(spark, d):
    """First substructures of a graph in which some labels stand for earlier ones; only a whole SUB_ label with a number above 0 is skipped."""
    v, _ = views.labelled(spark, d)
    return substructure.initial(v.withColumn("label", F.expr(_RENAMED))).filter(~reports.lone_substructures(F.col("label")))


@query(f"WITH {LABELLED} SELECT DISTINCT a.v1 AS c, a.v2 AS o FROM se a JOIN sv c ON c.vid = a.v1 JOIN sv x ON x.vid = a.v2 WHERE a.directed AND starts_with(c.label, 'B') AND starts_with(x.label, 'order-') AND starts_with(a.label, '1-')")
def pattern_by_prefix(spark, d):
    """Matches whose labels only begin as the pattern's do."""
    v, e = views.labelled(spark, d)
    m = substructure.find_instances(v, e, ["B", "order-"], [(0, 1, "1-", True)], lambda label, wanted: label.startswith(wanted))
    return m.select(F.get("vs", F.lit(0)).alias("c"), F.get("vs", F.lit(1)).alias("o"))


_B3 = "CASE WHEN {0} <= 2 THEN {0} ELSE CAST(floor(ln(2 * ({0} - 2) + 1) / ln(3) + 1e-9) AS BIGINT) + 2 END"


@query(f"WITH {PARTS}, {DEG}, x AS (SELECT {_B3.format('deg')} AS bin, wdeg, deg FROM d), k AS (SELECT unnest(range(1, (SELECT max(bin) FROM x) + 1)) AS bin) SELECT CAST(k.bin AS BIGINT) AS bin, CAST(CASE WHEN k.bin <= 2 THEN k.bin ELSE round((pow(3, k.bin - 2) - 1) / 2) + 2 END AS BIGINT) AS start, round(coalesce(avg(deg), 0), 9) AS xx, CAST(coalesce(sum(wdeg), 0) AS DOUBLE) AS yy FROM k LEFT JOIN x ON x.bin = k.bin GROUP BY k.bin")
def binned_series(spark, d):
    """Summed weight by bins of degree that grow threefold, with the mean degree of each."""
    return reports.binned(core.degrees(cut(views.parts(spark, d), "view")), "deg", "wdeg", 3.0, 2, xbin=F.avg).withColumn("xx", F.round("xx", 9))


_E = "SELECT batch, unnest(range({0})) AS i FROM (SELECT unnest(range(20)) AS batch)"
_PICK = lambda kind, n: f"CAST(floor({uniform_sql(7, repr(kind), 'batch', 'i')} * {n}) AS BIGINT)"
_NAME = lambda kind, names: f"{names!r}[{draw_sql(7, repr(kind), 'batch', 'i')} % {len(names)} + 1]"


@query(f"""WITH x AS ({_E.format(200)}), y AS ({_E.format(400)}), c AS ({_E.format(10)}), s AS ({_E.format(15)})
SELECT batch, 'v' AS kind, batch * 230 + i AS a, NULL::BIGINT AS b, {_NAME('v', ['red', 'green', 'blue'])} AS label FROM x
UNION ALL SELECT batch, 'u', batch * 230 + {_PICK('x', 200)}, batch * 230 + ({_PICK('x', 200)} + {_PICK('y', 199)} + 1) % 200, {_NAME('e', ['near', 'far'])} FROM y
UNION ALL SELECT batch, 'v', batch * 230 + 200 + i * 3 + k, NULL, ['square', 'circle', 'circle'][k + 1] FROM c, (VALUES (0), (1), (2)) p(k)
UNION ALL SELECT batch, 'd', batch * 230 + 200 + i * 3, batch * 230 + 201 + i * 3 + k, ['on', 'by'][k + 1] FROM c, (VALUES (0), (1)) p(k)
UNION ALL SELECT batch, 'u', batch * 230 + 200 + i * 3, batch * 230 + {_PICK('h', 200)}, {_NAME('g', ['near', 'far'])} FROM c
UNION ALL SELECT batch, 'u', batch * 230 + {_PICK('s', 230)}, (batch - 1) * 230 + {_PICK('t', 230)}, {_NAME('z', ['near', 'far'])} FROM s WHERE batch > 0""")
def generated_increments(spark, d):
    """Twenty increments of random data with ten copies of a pattern each, connected with the one before."""
    pattern = (["square", "circle", "circle"], [(0, 1, "on", True), (0, 2, "by", True)])
    return random_increments(spark, 20, 200, 400, ["red", "green", "blue"], ["near", "far"], pattern, 10, 15, 7).drop("example")
