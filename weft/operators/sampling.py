"""Sampled views of a graph: node samples, wedge sampling, a census of four-node subgraphs, and maximal cliques."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.mdl import degree_bin
from weft.operators.core import degrees, nodes, ranked, symmetric
from weft.operators.randgraph import uniform


def scatter(i: Column, step: int, n: int) -> Column:
    """A reproducible pseudo-random rank below n that any SQL engine can compute."""
    return F.pmod(F.pmod((i * 4 + step + 1) * 1103515245 + 12345, F.lit(2147483648)), F.lit(n))


def census(edges: DataFrame, samples: int) -> DataFrame:
    """(kind, cnt) over numbered draws of four ranks (draws with a repeated node don't count), by number of edges and largest degree:
    e0 e1 e2 e2c tri p3 star tritail square squarediag k4."""
    ids = ranked(nodes(edges), "id")
    n = ids.count()
    draws = edges.sparkSession.range(samples).select("id", F.array(*[scatter(F.col("id"), k, n) for k in range(4)]).alias("q")).filter(F.size(F.array_distinct("q")) == 4)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(4) for b in range(a + 1, 4)])
    r = ids.select(F.col("rank"), F.col("id").alias("node"))
    flat = draws.select(F.col("id").alias("s"), F.posexplode("q").alias("k", "rank")).join(r, "rank").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", "node"))).alias("q"))
    six = flat.select("s", F.explode(F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.least(F.get("q", p["a"])["node"], F.get("q", p["b"])["node"]).alias("u"), F.greatest(F.get("q", p["a"])["node"], F.get("q", p["b"])["node"]).alias("v")))).alias("x")).select("s", "x.*")
    hit = six.join(edges.filter("u <> v").select("u", "v"), ["u", "v"], "left_semi")
    ends = hit.select("s", F.explode(F.array("a", "b")).alias("k")).groupBy("s", "k").agg(F.count(F.lit(1)).alias("d"))
    per = ends.groupBy("s").agg((F.sum("d") / 2).cast("int").alias("m"), F.max("d").alias("top"), F.count(F.lit(1)).alias("touched"))
    m, top, t = F.col("m"), F.col("top"), F.col("touched")
    kind = (
        F.when(m.isNull(), "e0").when(m == 1, "e1").when((m == 2) & (t == 4), "e2").when(m == 2, "e2c").when((m == 3) & (t == 3), "tri").when((m == 3) & (top == 3), "star").when(m == 3, "p3")
        .when((m == 4) & (top == 3), "tritail").when(m == 4, "square").when(m == 5, "squarediag").otherwise("k4")
    )
    return flat.select("s").join(per, "s", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("cnt"))


def sampled_clustering(edges: DataFrame, per_bin: int = 1000, seed: int = 0) -> DataFrame:
    """(bin, samples, cd): clustering per degree bin from numbered wedge draws, in proportion to wedges at each node.

    A draw is a keyed number against the running sums of wedges within its bin; running sums are over degrees (few rows), then a node of that degree
    is picked by its rank among them, so no node list is sorted in one task.
    """
    from pyspark.sql import Window

    d = degrees(edges.filter("u <> v")).select("id", "deg").filter("deg >= 2").withColumn("bin", degree_bin(F.col("deg")))
    h = d.groupBy("bin", "deg").agg(F.count(F.lit(1)).alias("n")).withColumn("wedges", F.col("n") * F.col("deg") * (F.col("deg") - 1) / 2)
    w, whole = Window.partitionBy("bin").orderBy("deg"), Window.partitionBy("bin")
    h = h.withColumn("hi", F.sum("wedges").over(w)).withColumn("all", F.sum("wedges").over(whole))
    lots = F.least(F.col("all"), F.lit(per_bin)).cast("int")
    # draws of a degree: those of the bin's that fall into its part of the running sum
    draws = h.select("bin", "deg", "n", "hi", "wedges", "all", F.explode(F.sequence(F.lit(1), lots)).alias("i"))
    r = uniform(seed, "bin", "i") * F.col("all")
    draws = draws.filter((r < F.col("hi")) & (r >= F.col("hi") - F.col("wedges"))).withColumn("k", F.floor(uniform(seed + 1, "bin", "i") * F.col("n")).cast("long"))
    order = d.withColumn("k", F.row_number().over(Window.partitionBy("deg", F.pmod("id", F.lit(64))).orderBy("id")) - 1).withColumn("part", F.pmod("id", F.lit(64)))
    sizes = order.groupBy("deg", "part").agg(F.count(F.lit(1)).alias("c"))
    offset = sizes.withColumn("o", F.sum("c").over(Window.partitionBy("deg").orderBy("part")) - F.col("c")).select("deg", "part", "o")
    order = order.join(offset, ["deg", "part"]).select("deg", (F.col("k") + F.col("o")).alias("k"), "id")
    picked = draws.join(order, ["deg", "k"]).select("bin", "i", "id", "deg")
    a = F.floor(uniform(seed + 2, "bin", "i") * F.col("deg"))
    b = F.floor(uniform(seed + 3, "bin", "i") * (F.col("deg") - 1))
    picked = picked.withColumn("a", a).withColumn("b", F.when(b >= F.col("a"), b + 1).otherwise(b))
    s = symmetric(edges.filter("u <> v")).select("u", "v")
    near = picked.join(s, picked["id"] == s["u"]).groupBy("bin", "i", "a", "b").agg(F.array_sort(F.collect_list("v")).alias("nb"))  # a node's neighbours: as many as its degree
    two = near.select("bin", F.get("nb", F.col("a").cast("int")).alias("x"), F.get("nb", F.col("b").cast("int")).alias("y"))
    closed = two.join(edges.select("u", "v", F.lit(1).alias("hit")), (F.least("x", "y") == F.col("u")) & (F.greatest("x", "y") == F.col("v")), "left")
    return closed.groupBy("bin").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.coalesce("hit", F.lit(0))).alias("cd"))


def bron_kerbosch(adj: dict[int, set[int]], p: set[int] | None = None, x: set[int] | None = None) -> list[list[int]]:
    """All maximal cliques among ``p`` (all nodes by default) that no node of ``x`` extends, with pivots, over an explicit stack."""
    out, stack = [], [([], set(adj) if p is None else p, x or set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(sorted(r))
            continue
        pivot = max(p | x, key=lambda v: (len(adj[v] & p), -v))
        for v in sorted(p - adj[pivot]):
            stack.append(([*r, v], p & adj[v], x & adj[v]))
            p = p - {v}
            x = x | {v}
    return out


def maximal_cliques(edges: DataFrame, key: str) -> DataFrame:
    """(key, clique): maximal cliques of each piece's simple graph (u, v with a key column).

    A clique is found at its first node by (degree, id), from the triangles of that node alone: two later neighbours that meet may join it, an
    earlier one that meets a later one may show that it isn't maximal. Edges in no triangle are cliques themselves. So no piece is ever held
    whole, only the triangles of one node, whose later neighbours are at most sqrt(2 edges).
    """
    from weft.operators.rest import cut

    e = edges.filter("u <> v").select(F.col(key).alias("k"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = cut(e, "cliques")
    d = e.select("k", F.explode(F.array("u", "v")).alias("id")).groupBy("k", "id").agg(F.count(F.lit(1)).alias("deg"))
    both = e.join(d.toDF("k", "u", "du"), ["k", "u"]).join(d.toDF("k", "v", "dv"), ["k", "v"])
    low = F.expr("du < dv OR du = dv AND u < v")
    o = cut(both.select("k", F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b")), "cliques")
    found = o.toDF("k", "x", "y").join(o.toDF("k", "x", "z"), ["k", "x"]).filter("y <> z").join(o.toDF("k", "y", "z"), ["k", "y", "z"], "left_semi").select("k", "x", "y", "z")
    t = cut(found, "cliques")  # x before y before z
    alone = o.join(t.select("k", F.explode(F.expr("array(struct(x AS a, y AS b), struct(x AS a, z AS b), struct(y AS a, z AS b))")).alias("p")).select("k", "p.*").distinct(), ["k", "a", "b"], "left_anti")
    near = t.select("k", F.explode(F.expr("array(struct(x AS c, y AS a, z AS b, true AS later), struct(y AS c, x AS a, z AS b, false AS later))")).alias("p")).select("k", "p.*")
    rows = near.groupBy("k", "c").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list("later").alias("later"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, c, xs, ys, later in pdf.itertuples(index=False):
                adj: dict[int, set[int]] = defaultdict(set)
                for a, b in zip(xs, ys, strict=True):
                    adj[a].add(b)
                    adj[b].add(a)
                first = {a for a, on in zip(xs, later, strict=True) if not on}
                out += [(k, sorted([c, *q])) for q in bron_kerbosch(adj, set(adj) - first, first)]
            yield pd.DataFrame(out, columns=["k", "clique"])

    kind = edges.schema[key].dataType.simpleString()
    more = rows.mapInPandas(run, f"k {kind}, clique array<bigint>")
    return alone.select("k", F.array(F.least("a", "b"), F.greatest("a", "b")).alias("clique")).union(more).withColumnRenamed("k", key)


def dfs_order(adj: dict[int, list[int]], start: int, size: int) -> list[int]:
    """The first ``size`` nodes of a depth-first walk, smallest neighbour first."""
    seen, out, stack = {start}, [start], [iter(sorted(adj[start]))]
    while stack and len(out) < size:
        for v in stack[-1]:
            if v not in seen:
                seen.add(v)
                out.append(v)
                stack.append(iter(sorted(adj[v])))
                break
        else:
            stack.pop()
    return out


class _Near(dict):
    """Neighbours of nodes, fetched when the walk first asks for them."""

    def __init__(self, s: DataFrame):
        self.s = s

    def __missing__(self, v: int) -> list[int]:
        self[v] = [r["v"] for r in self.s.filter(F.col("u") == v).select("v").collect()]  # one node's neighbours
        return self[v]


def dfs_sample(edges: DataFrame, start: int, size: int) -> DataFrame:
    """Edges induced on the first ``size`` nodes of a depth-first walk, smallest neighbour first. The walk is sequential, so it asks for the
    neighbours of one node after another: a short job for each of the ``size`` nodes, over the whole graph at rest."""
    from weft.operators.core import induced
    from weft.operators.rest import cut

    s = cut(symmetric(edges.filter("u <> v")).select("u", "v").distinct(), "dfs")
    ids = dfs_order(_Near(s), start, size)
    return induced(edges, edges.sparkSession.createDataFrame([(i,) for i in ids], "id long"))


def nelder_mead(f, x0: list[float], rounds: int = 400, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimum of a function of a few numbers by the simplex search."""
    n = len(x0)
    pts = [np.array(x0, float)] + [np.array(x0, float) + np.eye(n)[i] * (0.05 * abs(x0[i]) or 0.00025) for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if max(abs(v - val[0]) for v in val) < tol and max(np.abs(p - pts[0]).max() for p in pts) < tol:
            break
        mid = np.mean(pts[:-1], axis=0)
        try_at = lambda t: (lambda p: (p, f(p)))(mid + t * (mid - pts[-1]))  # noqa: B023, E731
        p, v = try_at(1.0)
        if v < val[0]:
            q, u = try_at(2.0)
            p, v = (q, u) if u < v else (p, v)
        elif v >= val[-2]:
            q, u = try_at(0.5 if v < val[-1] else -0.5)
            if u < min(v, val[-1]):
                p, v = q, u
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (x - pts[0]) for x in pts[1:]]
                val = [val[0]] + [f(x) for x in pts[1:]]
                continue
        pts[-1], val[-1] = p, v
    i = int(np.argmin(val))
    return pts[i], float(val[i])


def fit_degree_distribution(average: float, top: int, kind: str = "log-normal", least: float = 1e-10) -> tuple[float, ...]:
    """Parameters whose degree distribution up to ``top`` has that average and hardly any mass at the top."""
    d = np.arange(1, top + 1)

    def miss(x: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            p = np.exp(-((np.log(d) / x[0]) ** x[1])) if kind == "log-normal" else d ** -float(x[0])
            p = p / p.sum()
            tail = max(0.0, np.log(p[-1] / least)) if p[-1] > 0 else 0.0
        v = abs(float(p @ d) - average) + tail
        return v if np.isfinite(v) else 1e9

    x, _ = nelder_mead(miss, [2.0, 2.0] if kind == "log-normal" else [2.0])
    return tuple(map(float, x))


def fit_clustering(target: float, nd: dict[int, int], top: float = 0.95) -> float:
    """The decay of clustering top * exp(-(d - 1) * decay) at which the global clustering of a degree histogram is the target."""
    d, n = np.array(sorted(nd)), np.array([nd[k] for k in sorted(nd)])
    wedge = n * d * (d - 1) / 2

    def miss(x: np.ndarray) -> float:
        c = top * np.exp(-(d - 1) * abs(float(x[0])))
        return abs(float((wedge * c).sum() / max(1e-12, wedge.sum())) - target)

    return abs(float(nelder_mead(miss, [0.1])[0][0]))
