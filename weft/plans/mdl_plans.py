"""Queries of description lengths, probability tables and distribution distances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import mdl
from weft.operators import compare, core, motifs, randgraph, summary
from weft.plans.motif_plans import _ALL, _ORBIT, _QUADS
from weft.plans.registry import query
from weft.plans.structure import DEG, SYM
from weft.sources import views
from weft.sources.views import PARTS, PARTS45, SUPPLIERS

G = "(2 * log2({}) + 1)"
BETA = "(CASE WHEN {0} = 0 THEN 0.0 ELSE log2({0}) END)"


def _dl(n: str, m: str, s: str, kinds: str) -> str:
    return f"({BETA.format(n)} + {n} * log2(1 + {kinds}) + {BETA.format(m)} + log2(1 + {kinds}) * ({s} + ({n} * {n} - 2 * {m})))"


@query(f"WITH {PARTS}, x AS (SELECT (SELECT count(*) FROM (SELECT u FROM g UNION SELECT v FROM g)) AS n, (SELECT count(*) FROM g) AS m, (SELECT sum(2 * {G.format('(w + 1)')}) FROM g) AS s) SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round({_dl('n', 'm', 's', '1')}, 4) AS dl FROM x")
def graph_dl(spark, d):
    return mdl.graph_bits(views.parts(spark, d)).select("n", "m", F.round("dl", 4).alias("dl"))


@query(f"WITH {SUPPLIERS}, x AS (SELECT (SELECT count(*) FROM (SELECT u FROM g UNION SELECT v FROM g)) AS n, (SELECT count(*) FROM g) AS m, (SELECT sum(2 * {G.format('(w + 1)')}) FROM g) AS s) SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round({_dl('n', 'm', 's', '1')}, 4) AS dl FROM x")
def graph_dl_weighted(spark, d):
    return mdl.graph_bits(views.suppliers(spark, d)).select("n", "m", F.round("dl", 4).alias("dl"))


_GR = f"""WITH {PARTS}, nd AS (SELECT id, id // 8 AS grp FROM (SELECT u AS id FROM g UNION SELECT v FROM g)),
e AS (SELECT g.u, g.v, g.w, a.grp AS ga, b.grp AS gb FROM g JOIN nd a ON a.id = u JOIN nd b ON b.id = v),
c AS (SELECT ga AS grp, u AS id, v AS out, w FROM e WHERE ga <> gb UNION ALL SELECT gb, v, u, w FROM e WHERE ga <> gb),
i AS (SELECT ga AS grp, count(*) AS m, sum(2 * {G.format('(w + 1)')}) AS s FROM e WHERE ga = gb GROUP BY 1),
b AS (SELECT grp, sum(bd) AS lhs, max(bd) AS b_max, sum(p) AS bp, sum(s) AS bs FROM (SELECT grp, id, sum(w) AS bd, count(*) AS p, sum(2 * {G.format('(w + 1)')}) AS s FROM c GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT grp, count(*) AS x, sum(2 * {G.format('(k + 1)')}) AS xs FROM (SELECT grp, out, sum(w) AS k FROM c GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM nd) AS nn, (SELECT count(*) FROM g) AS mm, (SELECT sum(2 * {G.format('(w + 1)')}) FROM g) AS ss),
r AS (SELECT k.grp, n, coalesce(m, 0) AS m, coalesce(s, 0) AS s, coalesce(lhs, 0) AS lhs, coalesce(b_max, 0) AS b_max, coalesce(bp, 0) AS bp, coalesce(bs, 0) AS bs, coalesce(x, 0) AS x, coalesce(xs, 0) AS xs, t.* FROM (SELECT grp, count(*) AS n FROM nd GROUP BY 1) k LEFT JOIN i USING (grp) LEFT JOIN b USING (grp) LEFT JOIN o USING (grp), t)"""


@query(f"{_GR} SELECT CAST(grp AS BIGINT) AS grp, CAST(lhs AS BIGINT) AS lhs, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(b_max AS BIGINT) AS b_max, round({G.format('(lhs + 1)')} + {_dl('n', 'm', 's', '1')} + {G.format('2')} + n * {G.format('(b_max + 1)')}, 4) AS cost FROM r")
def part_rule_cost(spark, d):
    """Rules of many disjoint node sets (ids in blocks of eight) and their cost."""
    g = views.parts(spark, d)
    groups = core.nodes(g).withColumn("grp", F.floor(F.col("id") / 8).cast("long"))
    return core.group_rules(g, groups).select("grp", "lhs", "n", "m", "b_max", F.round("cost", 4).alias("cost"))


@query(f"{_GR} SELECT CAST(grp AS BIGINT) AS grp, round({_dl('(nn - n + 1)', '(mm - m - bp + x)', '(ss - s - bs + xs)', '2')}, 3) AS dl_after FROM r")
def contraction_dl(spark, d):
    """Bits of the whole graph after each set's contraction, without contracting."""
    g = views.parts(spark, d)
    groups = core.nodes(g).withColumn("grp", F.floor(F.col("id") / 8).cast("long"))
    return core.group_rules(g, groups).select("grp", F.round("dl_after", 3).alias("dl_after"))


@query(f"SELECT CAST(n AS BIGINT) AS n, round({G.format('n')}, 9) AS gamma, round(log2(n), 9) AS bits FROM (SELECT unnest(range(1, 1001)) AS n)")
def gamma_table(spark, d):
    n = F.col("id")
    return spark.range(1, 1001).select(n.alias("n"), F.round(mdl.gamma_bits(n), 9).alias("gamma"), F.round(mdl.bits(n), 9).alias("bits"))


_IT = "log2(2.865064) + a + greatest(b, 0) + greatest(c, 0) + greatest(e, 0)"


@query(f"WITH x AS (SELECT n, log2(n) AS a FROM (SELECT unnest(range(1, 1001)) AS n)), y AS (SELECT *, CASE WHEN a > 0 THEN log2(a) ELSE 0.0 END AS b FROM x), z AS (SELECT *, CASE WHEN b > 0 THEN log2(b) ELSE 0.0 END AS c FROM y), q AS (SELECT *, CASE WHEN c > 0 THEN log2(c) ELSE 0.0 END AS e FROM z) SELECT CAST(n AS BIGINT) AS n, round({_IT}, 9) AS ln FROM q")
def universal_code_table(spark, d):
    return spark.range(1, 1001).select(F.col("id").alias("n"), F.round(mdl.universal(F.col("id")), 9).alias("ln"))


@query("SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round((lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) / ln(2), 6) AS lu, round(CASE WHEN k = 0 OR k = n THEN 0.0 ELSE -k * log2(k / CAST(n AS DOUBLE)) - (n - k) * log2((n - k) / CAST(n AS DOUBLE)) END, 6) AS lnu FROM (SELECT unnest(range(1, 101)) AS n), LATERAL (SELECT unnest(range(0, n + 1)) AS k)")
def subset_code_table(spark, d):
    x = spark.range(1, 101).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), "id")).alias("k"))
    return x.select("n", "k", F.round(mdl.log2_choose(F.col("n"), F.col("k")), 6).alias("lu"), F.round(mdl.entropy_subset(F.col("n"), F.col("k")), 6).alias("lnu"))


_MU = ", ".join(f"CASE WHEN n > {m} THEN CAST('inf' AS DOUBLE) WHEN n < {m} THEN round(log2(1 + {m} - n), 9) ELSE 0.0 END AS mu{m}" for m in (4, 5, 8))


@query(f"SELECT CAST(n AS BIGINT) AS n, {_MU} FROM (SELECT unnest(range(1, 21)) AS n)")
def mu_scores(spark, d):
    from weft.operators.grammar import mu_score

    return spark.range(1, 21).select(F.col("id").alias("n"), *[F.round(mu_score(F.col("id"), m), 9).alias(f"mu{m}") for m in (4, 5, 8)])


_C = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)) / ln(2)"


def _ln(z: str) -> str:
    return f"(SELECT log2(2.865064) + greatest(a, 0) + greatest(b, 0) + greatest(c, 0) + greatest(e, 0) FROM (SELECT a, b, c, CASE WHEN c > 0 THEN log2(c) ELSE 0.0 END AS e FROM (SELECT a, b, CASE WHEN b > 0 THEN log2(b) ELSE 0.0 END AS c FROM (SELECT a, CASE WHEN a > 0 THEN log2(a) ELSE 0.0 END AS b FROM (SELECT log2({z}) AS a)))))"


@query(f"WITH x AS (SELECT CAST(s AS BIGINT) AS s FROM (SELECT unnest(range(3, 61)) AS s)) SELECT s, round({_ln('s')} + {_C.format('1000', 's')}, 5) AS fc, round({_ln('s - 1')} + log2(1000) + {_C.format('999', '(s - 1)')}, 5) AS st, round({_ln('s - 1')} + {_C.format('1000', 's')} + lgamma(s + 1) / ln(2), 5) AS ch, round({_ln('s')} + {_ln('2')} + {_C.format('1000', 's')} + {_C.format('(1000 - s)', '2')}, 5) AS bc FROM x")
def structure_costs(spark, d):
    """Model bits of a clique, star, chain and bipartite core of each size in a graph of 1,000 nodes."""
    s, n = F.col("id"), F.lit(1000)
    return spark.range(3, 61).select(s.alias("s"), *[F.round(summary.structure_bits(c, n, s, F.lit(2)), 5).alias(c) for c in ("fc", "st", "ch", "bc")])


@query("WITH x AS (SELECT CAST(k AS BIGINT) AS wrong, CAST(2 * k AS BIGINT) AS missed FROM (SELECT unnest(range(0, 41)) AS k)) SELECT wrong, missed, round(log2(300) + log2(4950 - 300) + CASE WHEN wrong = 0 THEN 0 ELSE -wrong * log2(wrong / 250.0) - (250 - wrong) * log2(1 - wrong / 250.0) END + CASE WHEN missed = 0 THEN 0 ELSE -missed * log2(missed / 4650.0) - (4650 - missed) * log2(1 - missed / 4650.0) END, 6) AS bits FROM x")
def vog_error_cost(spark, d):
    """Typed prefix code of errors: 100 nodes, 300 covered cells of which 50 are excluded."""
    k = F.col("id")
    return spark.range(0, 41).select(k.alias("wrong"), (2 * k).alias("missed"), F.round(summary.error_bits(F.lit(100), F.lit(300), F.lit(50), k, 2 * k), 6).alias("bits"))


@query("WITH x AS (SELECT CAST(d AS BIGINT) AS d, pow(d, -2.5) AS p, exp(-pow(ln(d) / 2.0, 2.0)) AS q FROM (SELECT unnest(range(1, 201)) AS d)) SELECT d, round(p / sum(p) OVER (), 12) AS p FROM x")
def powerlaw_pdf(spark, d):
    return randgraph.power_law_pdf(spark, 200, 2.5).withColumn("p", F.round("p", 12))


@query("WITH x AS (SELECT CAST(d AS BIGINT) AS d, exp(-pow(ln(d) / 2.0, 2.0)) AS q FROM (SELECT unnest(range(1, 201)) AS d)) SELECT d, round(q / sum(q) OVER (), 12) AS p FROM x")
def lognormal_pdf(spark, d):
    return randgraph.log_normal_pdf(spark, 200, 2.0, 2.0).withColumn("p", F.round("p", 12))


_KR = "CASE WHEN {0} = 0 AND {1} = 0 THEN 0.9 WHEN {0} <> {1} THEN 0.5 ELSE 0.2 END"


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(" + " * ".join(_KR.format(f"((i >> {b}) & 1)", f"((j >> {b}) & 1)") for b in range(5)) + ", 12) AS p FROM (SELECT unnest(range(0, 32)) AS i), (SELECT unnest(range(0, 32)) AS j)")
def kronecker_prob_table(spark, d):
    return randgraph.kronecker_probabilities(spark, [[0.9, 0.5], [0.5, 0.2]], 5).withColumn("p", F.round("p", 12))


@query(f"WITH {PARTS}, {DEG}, h AS (SELECT deg, count(*) AS n FROM d GROUP BY 1), t AS (SELECT sum(deg * n) AS s FROM h) SELECT a.deg AS du, b.deg AS dv, CAST(CASE WHEN a.deg = b.deg THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS BIGINT) AS pairs, round(least(1.0, a.deg * b.deg / CAST(s AS DOUBLE)), 12) AS p FROM h a JOIN h b ON a.deg <= b.deg, t")
def chunglu_prob_table(spark, d):
    """Edge probability and number of node pairs for each pair of degrees."""
    return randgraph.chung_lu_classes(core.degrees(views.parts(spark, d))).withColumn("p", F.round("p", 12))


@query(f"WITH p AS (SELECT deg FROM (WITH {PARTS}, {DEG} SELECT deg FROM d)), q AS (SELECT deg FROM (WITH {PARTS45}, {DEG} SELECT deg FROM d)), x AS (SELECT deg FROM p UNION ALL SELECT deg FROM q), f AS (SELECT (SELECT count(*) FROM p WHERE p.deg <= x.deg) / CAST((SELECT count(*) FROM p) AS DOUBLE) AS a, (SELECT count(*) FROM q WHERE q.deg <= x.deg) / CAST((SELECT count(*) FROM q) AS DOUBLE) AS b FROM x) SELECT round(avg(abs(a - b)), 6) AS cvm, round(sum(abs(a - b)), 4) AS cvm_sum FROM f")
def cvm_degree(spark, d):
    """Mean (and sum) over pooled points of the distance of two degree distributions."""
    a, b = core.degrees(views.parts(spark, d)), core.degrees(views.parts45(spark, d))
    return compare.cvm(a, b, "deg").select(F.round("cvm", 6).alias("cvm"), F.round("cvm_sum", 4).alias("cvm_sum"))


_O = [f"o{i}" for i in range(15)]
_ORB_SQL = f"{_ALL}, {_QUADS}, o AS (SELECT id, {_ORBIT} AS orbit, count(*) AS c FROM dg JOIN cl USING (q) GROUP BY 1, 2), ends AS (SELECT s.u AS id, sum(d.deg - 1) AS n1 FROM s JOIN d ON d.id = s.v GROUP BY s.u), ob AS (SELECT dt.id, deg AS o0, n1 - 2 * tri AS o1, deg * (deg - 1) // 2 - tri AS o2, tri AS o3, " + ", ".join(f"coalesce((SELECT sum(c) FROM o WHERE o.id = dt.id AND orbit = {i}), 0) AS o{i}" for i in range(4, 15)) + " FROM dt JOIN ends ON ends.id = dt.id), rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _O) + " FROM ob)"


@query(f"{_ORB_SQL} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(CASE WHEN isnan(corr(o{i}, o{j})) OR corr(o{i}, o{j}) IS NULL THEN 1.0 ELSE corr(o{i}, o{j}) END, 6) AS rho FROM rk" for i in range(15) for j in range(i + 1, 15)))
def orbit_spearman(spark, d):
    """Spearman correlation of every pair of orbits; undefined ones are 1."""
    return compare.orbit_correlations(motifs.orbits(views.parts(spark, d))).withColumn("rho", F.round("rho", 6))


@query(f"WITH {PARTS}, {DEG}, {SYM} SELECT id, deg FROM d ORDER BY deg DESC, id DESC LIMIT 10")
def top_hubs(spark, d):
    """The ten nodes of highest degree, ties by the higher id (a top-k report)."""
    return core.degrees(views.parts(spark, d)).select("id", "deg").orderBy(F.desc("deg"), F.desc("id")).limit(10)
