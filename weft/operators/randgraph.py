"""Random graphs: Barabasi-Albert, Chung-Lu, stochastic Kronecker and block two-level models, seeded and distributed."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.core import simple


def power_law_pdf(spark: SparkSession, top: int, gamma: float) -> DataFrame:
    """(d, p) with p proportional to d^-gamma."""
    x = spark.range(1, top + 1).select(F.col("id").alias("d"), F.pow(F.col("id").cast("double"), F.lit(-gamma)).alias("p"))
    return x.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy()))


def log_normal_pdf(spark: SparkSession, top: int, alpha: float, beta: float) -> DataFrame:
    """(d, p) with p proportional to exp(-(ln d / alpha)^beta)."""
    x = spark.range(1, top + 1).select(F.col("id").alias("d"), F.exp(-F.pow(F.log(F.col("id").cast("double")) / alpha, F.lit(beta))).alias("p"))
    return x.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy()))


def drawn(seed: int, *cols, digits: int = 13) -> Column:
    """An integer of so many hexadecimal digits (15 at most) from the columns and the seed alone: the same row draws the same number in any run and
    any engine (MD5 of the values and the seed, joined by commas)."""
    values = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.conv(F.left(F.md5(F.concat_ws(",", *[c.cast("string") for c in values], F.lit(str(seed)))), F.lit(digits)), 16, 10).cast("bigint")


def uniform(seed: int, *cols) -> Column:
    """A number in [0, 1), see ``drawn``."""
    return drawn(seed, *cols).cast("double") / float(1 << 52)


def pick(cum: list[float], r: Column) -> Column:
    """Index of the first cumulative weight above r."""
    return F.size(F.filter(F.lit([float(c) for c in cum[:-1]]), lambda c: c <= r)) if len(cum) > 1 else F.lit(0)


def sample_degrees(pdf: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(d, cnt): n draws from (d, p) by inverse distribution; the table of degrees is small and broadcast as cumulative bounds."""
    rows = sorted((r.d, r.p) for r in pdf.collect())  # one row per degree
    cum, total = [], 0.0
    for _, p in rows:
        total += p
        cum.append(total)
    ds = F.lit([d for d, _ in rows])
    draws = pdf.sparkSession.range(n).select(F.element_at(ds, (pick(cum, uniform(seed, "id") * total) + 1).cast("int")).alias("d"))
    return draws.groupBy("d").agg(F.count(F.lit(1)).alias("cnt"))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 42) -> DataFrame:
    """Preferential attachment: each new node draws m distinct ends of earlier edges. Sequential by nature, so on the driver, for up to a million nodes."""
    if n > 1_000_000 or m >= n:
        raise ValueError("n is limited to 1,000,000 and must exceed m")
    rng, ends, pairs = np.random.default_rng(seed), list(range(m)), []
    for v in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(int(ends[rng.integers(len(ends))]))
        pairs += [(u, v) for u in sorted(chosen)]
        ends += [x for u in sorted(chosen) for x in (u, v)]
    return simple(spark.createDataFrame(pairs, "u long, v long"))


def chung_lu_classes(degrees: DataFrame) -> DataFrame:
    """(du, dv, pairs, p): edge probability min(1, du dv / sum) and number of node pairs for each pair of degrees."""
    h = degrees.groupBy("deg").agg(F.count(F.lit(1)).alias("n"))
    s = h.agg(F.sum(F.col("deg") * F.col("n")).alias("s"))
    a, b = h.toDF("du", "na"), h.toDF("dv", "nb")
    pairs = a.join(F.broadcast(b), F.col("du") <= F.col("dv")).join(F.broadcast(s))  # distinct degrees: at most sqrt(2 edges)
    return pairs.select("du", "dv", F.when(F.col("du") == F.col("dv"), F.floor(F.col("na") * (F.col("na") - 1) / 2)).otherwise(F.col("na") * F.col("nb")).cast("long").alias("pairs"), F.least(F.lit(1.0), F.col("du") * F.col("dv") / F.col("s")).alias("p"))


def chung_lu(degrees: DataFrame, seed: int = 1) -> DataFrame:
    """A simple graph with expected degrees: sum / 2 draws of both ends in proportion to degree, loops and repeats dropped.

    Draws land in the nodes' running sums of degree; nodes are placed by degree ranges so that no pair table is formed.
    """
    from weft.operators.core import ranked

    ids = ranked(degrees.select("id", "deg"), "id")
    total, n = ids.agg(F.sum("deg"), F.count(F.lit(1))).first()
    if not total:
        return degrees.sparkSession.createDataFrame([], "u long, v long, w long")
    # each node holds `deg` slots of [0, total): slots are numbered within ranges of ranks
    block = ids.withColumn("b", F.floor(F.col("rank") / 4096).cast("long"))
    sums = sorted((r.b, r.s) for r in block.groupBy("b").agg(F.sum("deg").alias("s")).collect())  # a row per 4,096 nodes
    start, rows = 0, []
    for b, s in sums:
        rows.append((b, start))
        start += s
    spark = degrees.sparkSession
    slots = block.join(F.broadcast(spark.createDataFrame(rows, "b long, o long")), "b").withColumn("hi", F.sum("deg").over(Window.partitionBy("b").orderBy("rank")) + F.col("o"))
    slots = slots.select(F.explode(F.sequence(F.col("hi") - F.col("deg"), F.col("hi") - 1)).alias("slot"), "id")
    draws = spark.range(int(total // 2)).select(F.floor(uniform(seed, "id", F.lit(0)) * total).cast("long").alias("s"), F.floor(uniform(seed, "id", F.lit(1)) * total).cast("long").alias("t"))
    return simple(draws.join(slots.toDF("s", "u"), "s").join(slots.toDF("t", "v"), "t").select("u", "v"))


def kronecker_probabilities(spark: SparkSession, p: list[list[float]], k: int) -> DataFrame:
    """(i, j, p) for every cell of the k-th Kronecker power of the initiator."""
    s = len(p)
    if any(len(r) != s for r in p) or any(not 0 <= x <= 1 for r in p for x in r):
        raise ValueError("the initiator must be square with probabilities")
    flat, n = F.lit([float(x) for r in p for x in r]), s**k
    cell = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    prob = F.lit(1.0)
    for b in range(k):
        prob = prob * F.element_at(flat, (F.floor(F.col("i") / s**b) % s * s + F.floor(F.col("j") / s**b) % s + 1).cast("int"))
    return cell.select("i", "j", prob.alias("p"))


def kronecker(spark: SparkSession, p: list[list[float]], k: int, seed: int = 1, directed: bool = False) -> DataFrame:
    """(u, v, w): every cell drawn once; undirected graphs use the cells above the diagonal."""
    cells = kronecker_probabilities(spark, p, k)
    cells = cells if directed else cells.filter("i < j")
    hit = cells.filter(uniform(seed, "i", "j") < F.col("p")).select(F.col("i").alias("u"), F.col("j").alias("v"))
    return hit.withColumn("w", F.lit(1).cast("long"))


def kronecker_fast(spark: SparkSession, p: list[list[float]], k: int, seed: int = 1) -> DataFrame:
    """floor(sum^k) distinct directed edges, each placed by k weighted choices of a cell; draws are numbered and the first distinct ones count."""
    s, total = len(p), sum(map(sum, p))
    want = int(total**k)
    if want > s ** (2 * k):
        raise ValueError("more edges than cells")
    cum = list(np.cumsum([x / total for r in p for x in r]))
    factor = 2
    while True:
        c = [pick(cum, uniform(seed, "id", F.lit(b))) for b in range(k)]
        u = sum((F.floor(x / s) * s**b for b, x in enumerate(c[1:], 1)), F.floor(c[0] / s))
        v = sum((x % s * s**b for b, x in enumerate(c[1:], 1)), c[0] % s)
        e = spark.range(want * factor).select(u.cast("long").alias("u"), v.cast("long").alias("v"), "id").groupBy("u", "v").agg(F.min("id").alias("id"))
        if e.count() >= want:
            return e.orderBy("id").limit(want).select("u", "v", F.lit(1).cast("long").alias("w"))
        factor *= 2
        if factor > 4096:
            raise ValueError("the initiator leaves too few likely cells")


def bter_setup(nd: dict[int, int], cd: dict[int, float], blowup: int = 1) -> tuple[list[tuple], list[tuple]]:
    """Groups and degrees of a block two-level model from a degree histogram and mean clustering per degree.

    Groups: (first node, block size, blocks, weight). Degrees: (degree, first fill node, fill nodes, fill weight, first bulk node, bulk nodes, bulk weight).
    Only as many rows as there are degrees.
    """
    groups, degs, node, room, gdeg = [], [], 0, 0, 0.0
    one = nd.get(1, 0) * blowup
    first_one = sum(n for d, n in nd.items() if d > 1)
    for d in sorted(x for x in nd if x >= 2 and nd[x] > 0):
        n = nd[d]
        rho = min(max(cd.get(d, 0.0), 0.0), 1 - 1e-9) ** (1 / 3)
        fill = min(room, n)
        wfill = 0.5 * fill * max(0.0, d - gdeg) if fill else 0.0
        at_fill, node, room = node, node + fill, room - fill
        bulk = n - fill
        at_bulk, wbulk = node, 0.0
        if bulk:
            size = d + 1
            blocks = -(-bulk // size)
            if blocks == 1:
                size = max(2, min(size, bulk + sum(x for y, x in nd.items() if y > d)))
            gdeg = (size - 1) * rho
            groups.append((node, size, blocks, blocks * 0.5 * size * (size - 1) * math.log(1 / (1 - rho)) if rho > 0 else 0.0))
            wbulk = 0.5 * bulk * max(0.0, d - gdeg)
            node, room = node + bulk, blocks * size - bulk
        degs.append((d, at_fill, fill, wfill, at_bulk, bulk, wbulk))
    if one:
        degs.append((1, 0, 0, 0.0, first_one, one, 0.5 * nd.get(1, 0)))
    return groups, degs


def bter(spark: SparkSession, nd: dict[int, int], cd: dict[int, float], seed: int = 1) -> DataFrame:
    """A block two-level graph: phase one draws edges inside the groups' blocks, phase two between nodes by excess degree; the union is made simple.

    Both phases are numbered draws against short cumulative tables (a row per degree), so the draws are spread over the cluster.
    """
    groups, degs = bter_setup(nd, cd)
    wg, wd = sum(g[3] for g in groups), sum(x[3] + x[6] for x in degs)
    n = round(wg + wd)
    top = sum(c for d, c in nd.items() if d > 0)
    if n == 0:
        return spark.createDataFrame([], "u long, v long, w long")
    r = lambda *k: uniform(seed, "id", *map(F.lit, k))
    ids = spark.range(n).withColumn("one", r(0) * (wg + wd) < wg)
    parts = []
    if wg > 0:
        cum = list(np.cumsum([g[3] / wg for g in groups]))
        at = lambda k: F.element_at(F.lit([int(g[k]) for g in groups]), (pick(cum, r(1)) + 1).cast("int"))
        base = ids.filter("one").select("id", at(0).alias("first"), at(1).alias("size"), at(2).alias("blocks"))
        base = base.withColumn("b", F.floor(r(2) * F.col("blocks")))
        x, y = F.floor(r(3) * F.col("size")), F.floor(r(4) * (F.col("size") - 1))
        start = F.col("first") + F.col("b") * F.col("size")
        parts.append(base.select((start + x).cast("long").alias("u"), (start + F.when(y >= x, y + 1).otherwise(y)).cast("long").alias("v")))
    if wd > 0:
        cells = [(a, k, w) for _, a, k, w, *_ in degs if w > 0] + [(a, k, w) for *_, a, k, w in degs if w > 0]
        cum = list(np.cumsum([c[2] / wd for c in cells]))

        def end(k: int) -> Column:
            i = (pick(cum, r(5, k)) + 1).cast("int")
            return (F.element_at(F.lit([int(c[0]) for c in cells]), i) + F.floor(r(6, k) * F.element_at(F.lit([int(c[1]) for c in cells]), i))).cast("long")

        parts.append(ids.filter("NOT one").select(end(0).alias("u"), end(1).alias("v")))
    e = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return simple(e.filter((F.col("u") < top) & (F.col("v") < top)))
