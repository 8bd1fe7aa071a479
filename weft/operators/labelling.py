"""Labelling costs of many connected pieces at once: what it costs to describe each as a clique, near clique, star, chain, or (near) bipartite core,
errors included, and the cheapest code.

A piece is a key on its edges. All costs follow from a few counts a piece: nodes, edges, the largest degree, and the edges within and between two
sides. The sides come from belief propagation with heterophily: the node of largest degree starts on one side, its neighbours on the other, and
the linear system is solved by rounds over the edges of all pieces together, each a join and a partial sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import mdl
from weft.operators.rest import cut, drop, put

#: Heterophily, and the prior belief of the first node (its neighbours have the opposite one).
H, PRIOR = -0.01, 0.01
A, C = 4 * H * H / (1 - 4 * H * H), 2 * H / (1 - 4 * H * H)
CODES = ("fc", "nc", "st", "bc", "nb", "ch")


def beliefs(pieces: DataFrame, tol: float = 1e-12, most: int = 200) -> DataFrame:
    """(piece, id, deg, hub, b) from edges (piece, u, v; each pair once): the solution of (I + A D - C M) b = prior for all pieces, whose signs are
    the sides. An error if ``most`` rounds don't settle it, which is where nodes of very large degree make the system indefinite. Beliefs are dealt out
    to the edges in every round: as broadcasts they would pass the driver each time."""
    e = pieces.filter("u <> v").select("piece", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    s = cut(e.union(e.select("piece", F.col("v").alias("u"), F.col("u").alias("v"))), "bp")
    d = cut(s.groupBy("piece", F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "bp")
    hubs = d.groupBy("piece").agg((-F.max(F.struct("deg", (-F.col("id")).alias("low")))["low"]).alias("hub"))
    near = s.join(hubs, "piece").filter("u = hub").select("piece", F.col("v").alias("id"), F.lit(-PRIOR).alias("prior"))
    n = d.join(hubs, "piece").join(near, ["piece", "id"], "left").withColumn("prior", F.when(F.col("id") == F.col("hub"), PRIOR).otherwise(F.coalesce("prior", F.lit(0.0))))
    n = cut(n, "bp")
    now, at = put(n.select("piece", "id", (F.col("prior") / (1 + A * F.col("deg"))).alias("b")), "bp")
    for _ in range(most):
        come = s.join(now.withColumnsRenamed({"id": "v"}).hint("merge"), ["piece", "v"]).groupBy("piece", F.col("u").alias("id")).agg(F.sum("b").alias("x"))
        new = n.join(come.hint("merge"), ["piece", "id"]).join(now.withColumnRenamed("b", "was").hint("merge"), ["piece", "id"])
        new, new_at = put(new.select("piece", "id", ((F.col("prior") + C * F.col("x")) / (1 + A * F.col("deg"))).alias("b"), "was"), "bp")
        gap = new.agg(F.max(F.abs(F.col("b") - F.col("was")))).first()[0] or 0.0
        drop(at)
        now, at = new.drop("was"), new_at
        if gap < tol:
            return n.join(now, ["piece", "id"]).select("piece", "id", "deg", "hub", "b")
    raise RuntimeError(f"beliefs aren't settled after {most} rounds")


def _rate(one: Column, zero: Column) -> Column:
    total = one + zero
    return -one * F.log2(one / total) - zero * F.log2(zero / total)


def piece_counts(pieces: DataFrame) -> DataFrame:
    """(piece, n, m, top, ones, k, l, across, within): nodes, edges, largest degree, nodes of degree one, nodes of either side, and edges between and
    within the sides."""
    b = cut(beliefs(pieces), "sides")
    side = F.when(F.col("b") > 0, 1).when(F.col("b") < 0, -1).otherwise(0)
    sizes = b.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), (F.sum("deg") / 2).cast("long").alias("m"), F.max("deg").alias("top"), F.count_if(F.col("deg") == 1).alias("ones"), F.count_if(side == 1).alias("k"), F.count_if(side == -1).alias("l"))
    e = pieces.filter("u <> v").select("piece", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    two = e.join(b.select("piece", F.col("id").alias("u"), side.alias("su")), ["piece", "u"]).join(b.select("piece", F.col("id").alias("v"), side.alias("sv")), ["piece", "v"])
    cross = two.groupBy("piece").agg(F.count_if(F.col("su") * F.col("sv") == -1).alias("across"), F.count_if(F.col("su") * F.col("sv") == 1).alias("within"))
    return sizes.join(cross, "piece")


def costs(pieces: DataFrame, total: int) -> DataFrame:
    """(piece, n, m, fc, nc, st, bc, nb, ch, code): bits of each description in a graph of ``total`` nodes, and the code: that of an exact clique, star
    or chain, else the cheapest. A chain is only costed where a piece is one (twice its edges are fewer than 1.5 times its nodes only up to
    three nodes). A star needs three nodes, a core two sides; else their bits are null."""
    c = piece_counts(pieces)
    n, m, top, k, l, x, y = (F.col(i) for i in ("n", "m", "top", "k", "l", "across", "within"))
    big = F.lit(total)
    chain = (m == n - 1) & (top <= 2)
    # ones of each error matrix, then their codes, each at rest: expressions over short rows stay short
    c = c.withColumns({"n2": n * n, "fc1": n * n - n - 2 * m, "st1": 2 * (n - 1 - top) + 2 * (m - top), "bc1": 2 * (k * l - x) + 2 * y, "nb1": 2 * y, "gap": k * l - x, "spokes": n - 1})
    c = cut(c, "counts")
    c = cut(c.withColumns({f"ln_{i}": mdl.universal(F.col(i)) for i in ("n", "spokes", "k", "l", "fc1", "st1", "bc1", "nb1")}), "codes")
    wrong = lambda one, zero: F.when((F.col(one) <= 0) | (zero <= 0), 0.0).otherwise(F.col(f"ln_{one}") + _rate(F.col(one), zero))
    names = F.col("ln_n") + mdl.uniform_subset(big, n)
    both = (k > 0) & (l > 0)
    c = cut(c.withColumns({"names": names, "sides": F.when(both, F.col("ln_k") + F.col("ln_l") + mdl.uniform_subset(big, k) + mdl.uniform_subset(big - k, l)), "spoked": F.col("ln_spokes") + F.log2(big) + mdl.uniform_subset(big - 1, n - 1), "line": F.when(chain, F.col("ln_spokes") + mdl.log2_factorial(big) - mdl.log2_factorial(big - n))}), "models")
    near = F.when((x == 0) | (F.col("gap") == 0), 0.0).otherwise(2 * F.log2(k + l) + _rate(x, F.col("gap")))
    got = c.select(
        "piece", "n", "m", (F.col("names") + wrong("fc1", 2 * m)).alias("fc"), (F.col("names") + F.log2("n2") + _rate(2 * m, F.col("n2") - 2 * m)).alias("nc"), F.when(n >= 3, F.col("spoked") + wrong("st1", F.col("n2") - F.col("st1"))).alias("st"),
        (F.col("sides") + wrong("bc1", F.col("n2") - F.col("bc1"))).alias("bc"), (F.col("sides") + near + wrong("nb1", F.col("n2") - F.col("nb1"))).alias("nb"), F.col("line").alias("ch"),
        ((n >= 3) & (2 * m == n * (n - 1))).alias("whole"), ((n >= 3) & (m == n - 1) & (top == n - 1)).alias("hub"), chain.alias("line"),
    )
    got = cut(got, "costs")
    least = F.least(*CODES)
    cheapest = F.lit(None).cast("string")
    for code in reversed(CODES):
        cheapest = F.when(F.col(code) == least, code).otherwise(cheapest)
    return got.withColumn("code", F.when(F.col("whole"), "fc").when(F.col("hub"), "st").when(F.col("line"), "ch").otherwise(cheapest)).drop("whole", "hub", "line")
