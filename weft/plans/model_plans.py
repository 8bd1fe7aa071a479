"""Queries of clustering, grammars, generators, summaries and distances (rows only where no SQL says the same)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import cluster, compare, core, grammar, iterate, labelling, motifs, randgraph, selection, summary
from weft.operators.rest import cut
from weft.plans import mdl_plans
from weft.plans.iterative import _rounds
from weft.plans.registry import SQL, query
from weft.plans.structure import DEG, SYM
from weft.sources import views
from weft.sources.views import PARTS, PARTS45, PARTS_SQL, draw_sql, uniform_sql


_LCC = f"""WITH RECURSIVE {PARTS45}, {SYM}, n0 AS (SELECT u AS id FROM g UNION SELECT v FROM g), r AS (SELECT id, id AS c FROM n0 UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.id WHERE r.c < s.v),
comp AS (SELECT id, min(c) AS component FROM r GROUP BY id), size AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), m AS (SELECT id FROM comp WHERE component = (SELECT component FROM size ORDER BY n DESC, component LIMIT 1))"""


def connected(spark, d, least=45):
    """The largest component of the part graph."""
    g = cut(views.parts(spark, d, least), "view")
    return cut(core.induced(g, iterate.largest_component(g)), "lcc")


def flagship(spark, d):
    g = connected(spark, d, 40)
    tree = cut(cluster.random_tree(g, seed=1), "tree")
    return grammar.extract(g, tree, mu=4, kind="mu_level").select("rule_id", "lhs", "n", "m", "freq", "level", F.round("cost", 6).alias("cost"), "canon")


for _kind in ("mu_random", "mu_level", "mu_dl", "mu_level_dl", "local_dl", "global_dl"):

    def _grammar(spark, d, kind=_kind):
        g = connected(spark, d)
        tree = cut(cluster.random_tree(g, seed=1), "tree")
        return grammar.extract(g, tree, mu=4, kind=kind).select("rule_id", "lhs", "n", "m", "freq", "level", F.round("cost", 6).alias("cost"), "canon")

    query(name=f"grammar_{_kind}")(_grammar)


@query()
def generate_graphs(spark, d):
    """Three graphs generated from the grammar, near the order of the input."""
    g = connected(spark, d)
    rules = cut(grammar.extract(g, cut(cluster.leiden(g), "tree"), mu=4, kind="mu_level"), "rules")
    return grammar.generate(rules, core.nodes(g).count(), graphs=3, tolerance=0.2)


@query()
def grammar_cost(spark, d):
    g = connected(spark, d)
    rules = grammar.extract(g, cut(cluster.random_tree(g, seed=1), "tree"), mu=4, kind="mu_level")
    return rules.agg(F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("rules"), F.sum("freq").alias("steps"))


_TREE = f"""{_LCC}, i AS (SELECT id, row_number() OVER (ORDER BY {draw_sql(1, 'id', digits=15)}) - 1 AS r, count(*) OVER () AS n FROM m),
p AS (SELECT id, k AS level, CAST(floor(r * (1::BIGINT << k) / CAST(n AS DOUBLE)) AS BIGINT) AS c FROM i, LATERAL (SELECT unnest(range(0, CAST(floor(log2(greatest(n - 1, 1))) AS BIGINT) + 2)) AS k)),
z AS (SELECT *, count(*) OVER (PARTITION BY level, c) AS n FROM p),
up AS (SELECT *, lag(c) OVER o AS prev, lag(n) OVER o AS pn, max(level) OVER (PARTITION BY id) AS deep FROM z WINDOW o AS (PARTITION BY id ORDER BY level))"""


@query(f"""{_TREE} SELECT level || '/' || c AS tnode, CASE WHEN level > 0 THEN (level - 1) || '/' || min(prev) END AS parent, level, false AS is_leaf, CAST(NULL AS BIGINT) AS id FROM up WHERE n > 1 GROUP BY level, c
UNION ALL SELECT '=' || id, CASE WHEN level > 0 THEN (level - 1) || '/' || prev END, level, true, id FROM up WHERE n = 1 AND (pn IS NULL OR pn > 1)
UNION ALL SELECT '=' || id, level || '/' || c, level + 1, true, id FROM up WHERE level = deep AND n > 1""")
def random_tree(spark, d):
    return cluster.paths_to_tree(cluster.random_tree(connected(spark, d), seed=1)).withColumn("level", F.col("level").cast("long"))


@query()
def louvain(spark, d):
    return cluster.louvain(connected(spark, d))


@query()
def leiden(spark, d):
    return cluster.leiden(connected(spark, d))


@query()
def conductance_tree(spark, d):
    return cluster.split_tree(connected(spark, d), "conductance")


@query()
def spectral_tree(spark, d):
    return cluster.split_tree(connected(spark, d), "spectral")


@query()
def node2vec_tree(spark, d):
    g = cut(views.parts(spark, d, 49), "view")
    return cluster.embedding_tree(cluster.embed(cluster.walks(g, 2, 6, seed=1), size=16))


@query()
def lambda_dist(spark, d):
    a, b = views.parts(spark, d, 45), views.parts(spark, d, 48)
    return spark.createDataFrame([(compare.lambda_distance(cut(a, "view"), cut(b, "view")),)], "lambda_dist double")


@query()
def deltacon0(spark, d):
    a, b = views.parts(spark, d, 45), views.parts(spark, d, 48)
    return spark.createDataFrame([(compare.deltacon0(cut(a, "view"), cut(b, "view")),)], "deltacon0 double")


_RHO = f"{mdl_plans._ORB_SQL} SELECT " + ", ".join(f"coalesce(CASE WHEN isnan(corr(o{i}, o{j})) THEN 1.0 ELSE corr(o{i}, o{j}) END, 1.0) AS r{i}_{j}" for i in range(15) for j in range(i + 1, 15)) + " FROM rk"
_AT45 = lambda sql: sql.replace(PARTS, PARTS45)


@query(f"SELECT round(sqrt(2 * ({' + '.join(f'pow(a.r{i}_{j} - b.r{i}_{j}, 2)' for i in range(15) for j in range(i + 1, 15))})), 6) AS gcd FROM ({_RHO}) a, ({_AT45(_RHO)}) b")
def graphlet_correlation_distance(spark, d):
    got = compare.graphlet_correlation_distance(motifs.orbits(cut(views.parts(spark, d), "view")), motifs.orbits(cut(views.parts(spark, d, 45), "view")))
    return got.withColumn("gcd", F.round("gcd", 6))


_G = ["triangle", "path3", "clique4", "chordal4", "tailed", "cycle4", "star3", "path4"]
_GS = lambda t: {c: f"ln(({t}.{c} + 1) / CAST({' + '.join(f'{t}.{x}' for x in _G)} AS DOUBLE))" for c in _G}


@query(f"SELECT round({' + '.join(f'abs({_GS("a")[c]} - {_GS("b")[c]})' for c in _G)}, 9) AS rgf FROM ({SQL['graphlet_totals']}) a, ({_AT45(SQL['graphlet_totals'])}) b")
def relative_graphlet_distance(spark, d):
    return compare.relative_graphlet_distance(motifs.graphlet_totals(cut(views.parts(spark, d), "view")), motifs.graphlet_totals(cut(views.parts(spark, d, 45), "view"))).withColumn("rgf", F.round("rgf", 9))


@query()
def barabasi_albert(spark, d):
    return randgraph.barabasi_albert(spark, 1000, 2)


@query(f"""WITH {PARTS}, {DEG}, x AS (SELECT id, deg, sum(deg) OVER (ORDER BY id) AS hi, sum(deg) OVER () AS total FROM d), sl AS (SELECT id, unnest(range(CAST(hi - deg AS BIGINT), CAST(hi AS BIGINT))) AS slot FROM x),
dr AS (SELECT id, (SELECT max(total) FROM x) AS total FROM (SELECT unnest(range(0, CAST((SELECT max(total) FROM x) // 2 AS BIGINT))) AS id)),
pr AS (SELECT CAST(floor({uniform_sql(1, 'id', 0)} * total) AS BIGINT) AS s, CAST(floor({uniform_sql(1, 'id', 1)} * total) AS BIGINT) AS t FROM dr)
SELECT DISTINCT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, CAST(1 AS BIGINT) AS w FROM pr JOIN sl a ON a.slot = pr.s JOIN sl b ON b.slot = pr.t WHERE a.id <> b.id""")
def chung_lu(spark, d):
    return randgraph.chung_lu(core.degrees(views.parts(spark, d)))


_CELL = "CASE WHEN {0} = 0 AND {1} = 0 THEN 0.9::DOUBLE WHEN {0} <> {1} THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END"


@query(f"SELECT CAST(i AS BIGINT) AS u, CAST(j AS BIGINT) AS v, CAST(1 AS BIGINT) AS w FROM (SELECT unnest(range(0, 256)) AS i), (SELECT unnest(range(0, 256)) AS j) WHERE i < j AND {uniform_sql(1, 'i', 'j')} < " + " * ".join(_CELL.format(f"((i >> {b}) & 1)", f"((j >> {b}) & 1)") for b in range(8)))
def kronecker(spark, d):
    return randgraph.kronecker(spark, [[0.9, 0.5], [0.5, 0.2]], 8)


_TWO = [float(x) for x in (0.9 / 2.1, 0.9 / 2.1 + 0.5 / 2.1, 0.9 / 2.1 + 0.5 / 2.1 + 0.5 / 2.1)]
_FAST = [f"CAST({' + '.join(f'(CASE WHEN {uniform_sql(1, "id", b)} >= {t!r}::DOUBLE THEN 1 ELSE 0 END)' for t in _TWO)} AS BIGINT)" for b in range(10)]


@query(f"WITH x AS (SELECT id, {', '.join(f'{c} AS c{b}' for b, c in enumerate(_FAST))} FROM (SELECT unnest(range(0, 50000)) AS id)), e AS (SELECT {' + '.join(f'c{b} // 2 * {1 << b}' for b in range(10))} AS u, {' + '.join(f'c{b} % 2 * {1 << b}' for b in range(10))} AS v, min(id) AS id FROM x GROUP BY 1, 2) SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, CAST(1 AS BIGINT) AS w FROM e ORDER BY e.id LIMIT {int(2.1**10)}")
def kronecker_fast(spark, d):
    return randgraph.kronecker_fast(spark, [[0.9, 0.5], [0.5, 0.2]], 10)


@query(f"WITH x AS (SELECT CAST(d AS BIGINT) AS d, pow(d, -2.5) AS p FROM (SELECT unnest(range(1, 101)) AS d)), c AS (SELECT d, sum(p / s) OVER (ORDER BY d) AS hi FROM (SELECT d, p, sum(p) OVER () AS s FROM x)), r AS (SELECT id, {uniform_sql(0, 'id')} * (SELECT max(hi) FROM c) AS r FROM (SELECT unnest(range(0, 10000)) AS id)), k AS (SELECT id, 1 + count(c.d) AS d FROM r LEFT JOIN c ON c.hi <= r.r AND c.d < 100 GROUP BY id) SELECT CAST(d AS BIGINT) AS d, CAST(count(*) AS BIGINT) AS cnt FROM k GROUP BY d")
def sampled_degrees(spark, d):
    return randgraph.sample_degrees(randgraph.power_law_pdf(spark, 100, 2.5), 10_000)


@query()
def bter(spark, d):
    t = motifs.clustering(views.parts(spark, d)).groupBy("deg").agg(F.count(F.lit(1)).alias("n"), F.avg("cc").alias("cc")).collect()  # a row per degree
    return randgraph.bter(spark, {r.deg: r.n for r in t}, {r.deg: r.cc for r in t})


@query()
def slashburn(spark, d):
    return summary.slashburn(views.parts(spark, d), k=2)


@query()
def vog_greedy(spark, d):
    g = cut(views.parts(spark, d), "view")
    return selection.greedy(g, summary.slashburn(g, k=2))


_CC = """r AS (SELECT id, id AS c FROM n UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.id WHERE r.c < s.v), comp AS (SELECT id, min(c) AS component FROM r GROUP BY id)"""
_PROFILE = f"WITH RECURSIVE {PARTS_SQL.format(least=48)}, {SYM}, n AS (SELECT u AS id FROM g UNION SELECT v FROM g), {_CC}, {DEG}, p AS (SELECT component, count(*) AS n, sum(deg) // 2 AS m, max(deg) AS top, count(*) FILTER (deg = 1) AS ones FROM comp JOIN d USING (id) GROUP BY 1)"


@query(f"{_PROFILE} SELECT component, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CASE WHEN n >= 3 AND 2 * m = n * (n - 1) THEN 'fc' WHEN n >= 3 AND m = n - 1 AND top = n - 1 THEN 'st' WHEN n >= 2 AND m = n - 1 AND top <= 2 THEN 'ch' END AS code FROM p")
def vog_exact_structures(spark, d):
    """Components that are exactly a clique, a star or a chain."""
    p = summary.component_profiles(views.parts(spark, d, 48))
    return p.select("component", "n", "m", summary.exact_code(F.col("n"), F.col("m"), F.col("top"), F.col("ones")).alias("code"))


_LN, _LU = (lambda z: mdl_plans._ln(f"greatest({z}, 1)")), mdl_plans._C.format
_NLL = "(CASE WHEN {0} = 0 OR {1} = 0 THEN 0.0 ELSE -{0} * log2({0} / CAST({0} + {1} AS DOUBLE)) - {1} * log2({1} / CAST({0} + {1} AS DOUBLE)) END)".format
_ERR = lambda one, zero: f"(CASE WHEN {one} <= 0 OR {zero} <= 0 THEN 0.0 ELSE {_LN(one)} + {_NLL(one, zero)} END)"
_BP = _rounds(
    f"SELECT component, id, prior / (1 + {labelling.A!r} * deg) AS b FROM bn",
    f"SELECT bn.component, bn.id, (prior + {labelling.C!r} * x) / (1 + {labelling.A!r} * deg) AS b FROM bn JOIN (SELECT s.u AS id, sum(r.b) AS x FROM s JOIN {{r}} r ON r.id = s.v GROUP BY s.u) USING (id)",
    30,
)


@query(f"""{_PROFILE}, q AS (SELECT * FROM comp JOIN d USING (id)), h AS (SELECT component, arg_max(id, (deg, -id)) AS hub FROM q GROUP BY component),
bn AS (SELECT component, id, deg, CASE WHEN id = hub THEN {labelling.PRIOR!r} WHEN id IN (SELECT v FROM s WHERE u = hub) THEN -{labelling.PRIOR!r} ELSE 0.0 END AS prior FROM q JOIN h USING (component)), {_BP},
sd AS (SELECT component, id, sign(b) AS side FROM r30), kl AS (SELECT component, count(*) FILTER (side > 0) AS k, count(*) FILTER (side < 0) AS l FROM sd GROUP BY 1),
xy AS (SELECT a.component, count(*) FILTER (a.side * b.side = -1) AS x, count(*) FILTER (a.side * b.side = 1) AS y FROM g JOIN sd a ON a.id = u JOIN sd b ON b.id = v GROUP BY 1),
t AS (SELECT p.component, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, top, k, l, x, y, CAST(n * n - n - 2 * m AS BIGINT) AS f1, CAST(2 * m AS BIGINT) AS f2, CAST(n * n - 2 * m AS BIGINT) AS f3, CAST(2 * (n - 1 - top) + 2 * (m - top) AS BIGINT) AS s1, 2 * (k * l - x) + 2 * y AS b1, 2 * y AS n1, k * l - x AS z, (SELECT count(*) FROM n) AS big FROM p JOIN kl USING (component) JOIN xy USING (component)),
w AS (SELECT *, CAST(n * n - s1 AS BIGINT) AS s2, CAST(n * n - b1 AS BIGINT) AS b2, CAST(n * n - n1 AS BIGINT) AS n2 FROM t),
c AS (SELECT component, n, m, top, {_LN('n')} + {_LU('big', 'n')} + {_ERR('f1', 'f2')} AS fc, {_LN('n')} + {_LU('big', 'n')} + log2(n * n) + {_NLL('f2', 'f3')} AS nc,
 CASE WHEN n >= 3 THEN {_LN('n - 1')} + log2(big) + {_LU('(big - 1)', '(n - 1)')} + {_ERR('s1', 's2')} END AS st,
 {_LN('k')} + {_LN('l')} + {_LU('big', 'k')} + {_LU('(big - k)', 'l')} + {_ERR('b1', 'b2')} AS bc,
 {_LN('k')} + {_LN('l')} + {_LU('big', 'k')} + {_LU('(big - k)', 'l')} + CASE WHEN x = 0 OR z = 0 THEN 0.0 ELSE 2 * log2(k + l) + {_NLL('x', 'z')} END + {_ERR('n1', 'n2')} AS nb,
 CASE WHEN m = n - 1 AND top <= 2 THEN {_LN('n - 1')} + (lgamma(big + 1) - lgamma(big - n + 1)) / ln(2) END AS ch FROM w WHERE k > 0 AND l > 0)
SELECT component, n, m, round(fc, 4) AS fc, round(nc, 4) AS nc, round(st, 4) AS st, round(bc, 4) AS bc, round(nb, 4) AS nb, round(ch, 4) AS ch,
 CASE WHEN n >= 3 AND 2 * m = n * (n - 1) THEN 'fc' WHEN n >= 3 AND m = n - 1 AND top = n - 1 THEN 'st' WHEN m = n - 1 AND top <= 2 THEN 'ch' WHEN fc = least(fc, nc, st, bc, nb) THEN 'fc' WHEN nc = least(fc, nc, st, bc, nb) THEN 'nc' WHEN st = least(fc, nc, st, bc, nb) THEN 'st' WHEN bc = least(fc, nc, st, bc, nb) THEN 'bc' ELSE 'nb' END AS code FROM c""")
def vog_labelling_costs(spark, d):
    """What it costs to describe each component as each kind of structure, errors included, and the cheapest."""
    g = cut(views.parts(spark, d, 48), "view")
    pieces = g.join(iterate.components(g).withColumnRenamed("id", "u"), "u").withColumnRenamed("component", "piece")
    got = labelling.costs(pieces, core.nodes(g).count()).withColumnRenamed("piece", "component")
    return got.select("component", "n", "m", *[F.round(c, 4).alias(c) for c in labelling.CODES], "code")


@query()
def hrg_rules(spark, d):
    """Production rules of bounded connected samples: communities of the part graph."""
    from weft.operators import hrg

    g = connected(spark, d)
    s = cut(cluster.louvain(g, levels=1), "louvain").select(F.element_at("path", -1).alias("sample"), "id")
    return hrg.count_rules(g, s)


@query()
def hrg_graphs(spark, d):
    from weft.operators import hrg

    g = connected(spark, d)
    s = cut(cluster.louvain(g, levels=1), "louvain").select(F.element_at("path", -1).alias("sample"), "id")
    return hrg.generate(cut(hrg.count_rules(g, s), "hrg"), 30, graphs=5)


@query("WITH RECURSIVE t AS (SELECT 1 AS node, 0 AS level UNION ALL SELECT unnest([2 * node, 2 * node + 1]), level + 1 FROM t WHERE level < 9) SELECT CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS nodes FROM t GROUP BY level")
def recursive_tree_levels(spark, d):
    """Levels of a halving tree of 1,024 leaves, from the binary prefixes of ranks."""
    r = spark.range(512)
    return r.select(F.posexplode(F.array(*[F.floor(F.col("id") * (1 << k) / 512) for k in range(10)])).alias("level", "c")).distinct().groupBy(F.col("level").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("nodes"))
