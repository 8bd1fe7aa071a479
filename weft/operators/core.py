"""Edge tables: canonical pairs, weights, degrees, boundaries, induced subgraphs and contraction.

Edges are (u BIGINT, v BIGINT, w BIGINT) with u <= v, w the multiplicity; adding an edge to an existing pair adds its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, u: str = "u", v: str = "v", w: str | None = None) -> DataFrame:
    """Lower endpoint first, parallel edges merged into one row whose weight is their sum (map-side combined)."""
    weight = F.col(w) if w else F.lit(1)
    return pairs.select(F.least(u, v).cast("long").alias("u"), F.greatest(u, v).cast("long").alias("v"), weight.cast("long").alias("w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def simple(pairs: DataFrame) -> DataFrame:
    """Distinct pairs without self-loops, weight 1."""
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("w", F.lit(1).cast("long"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge by one pass; a self-loop stays one row."""
    both = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")))).otherwise(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    return edges.select(F.explode(both).alias("x"), "w").select(F.col("x.a").alias("u"), F.col("x.b").alias("v"), "w")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, deg, wdeg): number of distinct neighbours and summed weights; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"), "w")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("deg"), F.sum("w").alias("wdeg"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """(deg, cnt) for every degree from 0 to the largest, zeros included."""
    h = degrees(edges).groupBy("deg").agg(F.count(F.lit(1)).alias("cnt"))
    top = h.agg(F.max("deg").alias("m"))
    every = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(0)).cast("long"))).alias("deg"))
    return every.join(F.broadcast(h), "deg", "left").select("deg", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))  # degrees are few: at most sqrt(2 edges) distinct ones


def relabel(edges: DataFrame) -> DataFrame:
    """Contiguous ids from 0 in order of the old ones.

    Ranks come from two levels (range partitions, then within), so no single task sorts all nodes.
    """
    ids = ranked(nodes(edges), "id").withColumnRenamed("rank", "new")
    a, b = ids.toDF("u", "nu"), ids.toDF("v", "nv")
    return edges.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "w")


def ranked(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """Add ``rank`` from 0 in order of ``key`` (distinct integers): keys are dealt to ranges of about equal numbers of keys (quantiles, so an
    outlier changes nothing), whose sizes come to the driver."""
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    if not cuts:
        return df.withColumn("rank", F.lit(None).cast("long"))
    placed = df.withColumn("__b", F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col(key))))
    sizes = {r["__b"]: r["count"] for r in placed.groupBy("__b").count().collect()}
    start, rows = 0, []
    for b in sorted(sizes):
        rows.append((b, start))
        start += sizes[b]
    offsets = df.sparkSession.createDataFrame(rows, "__b int, __o long")
    w = Window.partitionBy("__b").orderBy(key)
    return placed.join(F.broadcast(offsets), "__b").withColumn("rank", F.row_number().over(w) - 1 + F.col("__o")).drop("__b", "__o")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in ``members`` (id)."""
    return edges.join(members.select(F.col("id").alias("u")), "u", "left_semi").join(members.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "w")


def boundary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(inside, outside, w): edges with exactly one end in ``members``; empty when that is every node."""
    s = symmetric(edges)
    return s.join(members.select(F.col("id").alias("u")), "u", "left_semi").join(members.select(F.col("id").alias("v")), "v", "left_anti").select(F.col("u").alias("inside"), F.col("v").alias("outside"), "w")


def boundary_degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, b_deg) for every member, 0 where no edge leaves."""
    b = boundary(edges, members).groupBy("inside").agg(F.sum("w").alias("b_deg"))
    return members.join(b, members["id"] == b["inside"], "left").select("id", F.coalesce("b_deg", F.lit(0)).cast("long").alias("b_deg"))


def contract(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Replace ``members`` by their smallest id; edges that leave them merge by weight, edges inside vanish."""
    m = members.select("id", F.lit(True).alias("hit"))
    to = members.agg(F.min("id").alias("to"))
    mapped = edges.join(m.toDF("u", "hu"), "u", "left").join(m.toDF("v", "hv"), "v", "left").join(F.broadcast(to))  # one row
    kept = mapped.filter("hu IS NULL OR hv IS NULL").select(F.when(F.col("hu"), F.col("to")).otherwise(F.col("u")).alias("u"), F.when(F.col("hv"), F.col("to")).otherwise(F.col("v")).alias("v"), "w")
    return canonical(kept, w="w")


def avg_neighbour_degree(edges: DataFrame) -> DataFrame:
    """(deg, nodes, avg_nbr): for each degree the mean over its nodes of their neighbours' mean degree."""
    d = degrees(edges).select("id", "deg")
    per = symmetric(edges).join(d.toDF("v", "dv"), "v").groupBy("u").agg(F.avg("dv").alias("m"))
    return per.join(d.toDF("u", "deg"), "u").groupBy("deg").agg(F.count(F.lit(1)).alias("nodes"), F.avg("m").alias("avg_nbr"))


def ecdf(values: DataFrame, col: str) -> DataFrame:
    """(x, f): share of rows with a value of at most x. Values are counted first, so the running sum is over distinct values only."""
    c = values.groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy())
    return c.select("x", (F.sum("c").over(Window.orderBy("x")) / n).alias("f"))


def share(col: Column, *keys: str) -> Column:
    """A value as a share of its group's sum."""
    return col / F.sum(col).over(Window.partitionBy(*keys))


def group_rules(edges: DataFrame, groups: DataFrame, freq: int = 1) -> DataFrame:
    """Rules for many disjoint node sets at once: ``groups`` is (grp, id).

    Per group: lhs (summed weight of boundary edges), n, m (pairs inside), s (their summed codes), b_max (largest boundary degree), cost of
    the rule with boundary degrees, and dl_after: the bits of the whole graph once the group is one non-terminal node. That is a closed form
    of sums over the group's own and boundary edges, so scoring every candidate is two aggregations and nothing is contracted.
    """
    from weft.functions import mdl

    code = lambda w: 2 * mdl.gamma_bits(w + 1)
    whole = edges.agg(F.count(F.lit(1)).alias("gm"), F.coalesce(F.sum(code(F.col("w"))), F.lit(0.0)).alias("gs")).join(nodes(edges).agg(F.count(F.lit(1)).alias("gn")))
    g = groups.select("grp", "id")
    a, b = g.toDF("ga", "u"), g.toDF("gb", "v")
    e = edges.join(a, "u", "left").join(b, "v", "left")
    inside = e.filter("ga = gb").groupBy(F.col("ga").alias("grp")).agg(F.count(F.lit(1)).alias("m"), F.sum(code(F.col("w"))).alias("s"))
    side = F.explode(F.array(F.struct(F.col("ga").alias("grp"), F.col("u").alias("id"), F.col("v").alias("out")), F.struct(F.col("gb").alias("grp"), F.col("v").alias("id"), F.col("u").alias("out"))))
    cross = e.filter("(ga IS NOT NULL OR gb IS NOT NULL) AND NOT coalesce(ga = gb, false)").select(side.alias("x"), "w").select("x.*", "w").filter("grp IS NOT NULL")
    node = cross.groupBy("grp", "id").agg(F.sum("w").alias("b_deg"), F.count(F.lit(1)).alias("pairs"), F.sum(code(F.col("w"))).alias("s"))
    border = node.groupBy("grp").agg(F.sum("b_deg").alias("lhs"), F.max("b_deg").alias("b_max"), F.sum("pairs").alias("bp"), F.sum("s").alias("bs"))
    outer = cross.groupBy("grp", "out").agg(F.sum("w").alias("k")).groupBy("grp").agg(F.count(F.lit(1)).alias("x"), F.sum(code(F.col("k"))).alias("xs"))
    r = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(inside, "grp", "left").join(border, "grp", "left").join(outer, "grp", "left").na.fill(0)
    rhs = mdl.dl(F.col("n"), F.col("m"), F.col("s"), F.lit(1))
    cost = mdl.gamma_bits(F.col("lhs") + 1) + rhs + mdl.gamma_bits(F.lit(freq + 1)) + F.col("n") * mdl.gamma_bits(F.col("b_max") + 1)
    r = r.join(F.broadcast(whole))  # one row
    n2, m2 = F.col("gn") - F.col("n") + 1, F.col("gm") - F.col("m") - F.col("bp") + F.col("x")
    s2 = F.col("gs") - F.col("s") - F.col("bs") + F.col("xs")
    kinds = F.when(F.col("gn") > F.col("n"), 2).otherwise(1)
    return r.select("grp", "lhs", "n", "m", "b_max", rhs.alias("rhs_dl"), cost.alias("cost"), mdl.dl(n2, m2, s2, kinds).alias("dl_after"))
