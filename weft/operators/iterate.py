"""Iterative graph operators: every round is a few equi-joins and map-side combined sums over tables at rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft.operators.core import degrees, nodes, symmetric
from weft.operators.rest import cut, drop, put


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest node reachable, for every node of ``edges``.

    Large star and small star in turn: all neighbours of a node hang on the smallest one, so chains shrink exponentially and a node with
    very many neighbours is only ever the key of a partial minimum and of a join that splits.
    """
    given = cut(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "cc")
    e = given.filter("a <> b")

    def star(e: DataFrame, large: bool) -> DataFrame:
        back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = e.union(back) if large else back
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        # the key in another form keeps the join from sharing the sums' exchange, which could not be split if a node has very many neighbours
        joined = both.join(low.select(F.col("a").bitwiseXOR(F.lit(0)).alias("k"), "m"), F.col("a") == F.col("k"))
        moved = joined.filter("b > a").select("b", "m") if large else joined.select("b", "m").union(low.select(F.col("a").alias("b"), "m"))
        return moved.filter("b <> m").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).distinct()

    before, old = None, None
    for _ in range(most_rounds):
        e, path = put(star(star(e, True), False), "cc")
        drop(old)
        old = path
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ids = given.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.join(e.select(F.col("b").alias("id"), F.col("a").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes (ties: the smallest id)."""
    c = components(edges)
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return c.join(F.broadcast(top), "component", "left_semi").select("id")  # one row


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85, tol: float | None = None) -> DataFrame:
    """(id, rank) summing to 1. Mass of nodes without neighbours is spread evenly. With ``tol`` rounds end when the summed change is below n * tol."""
    d = degrees(edges).select("id", F.col("deg"))
    s = cut(symmetric(edges).select("u", "v").join(d.toDF("u", "deg"), "u"), "pr")
    ids = cut(d.select("id"), "pr")
    n = ids.count()
    r = ids.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    for i in range(rounds):
        got = s.join(r.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("x"))
        new = ids.join(got, "id", "left").select("id", (F.lit((1 - alpha) / n) + alpha * F.coalesce("x", F.lit(0.0))).alias("rank"))
        if tol is not None:
            new = cut(new, "pr")
            if new.join(r.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tol:
                return new
        elif i % 5 == 4:
            new = cut(new, "pr")
        r = new
    return r


def eigen_centrality(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, score): power iteration on the adjacency matrix plus identity, scaled to unit length."""
    s = cut(symmetric(edges).select("u", "v"), "ev")
    r = cut(nodes(edges).withColumn("x", F.lit(1.0)), "ev")
    for i in range(rounds):
        add = s.join(r.toDF("u", "x"), "u").groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("y"))
        r = r.join(add, "id", "left").select("id", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x"))
        if i % 5 == 4:
            r = cut(r, "ev")
            norm = r.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
            r = r.withColumn("x", F.col("x") / norm)
    norm = r.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
    return r.select("id", (F.col("x") / norm).alias("score"))


def k_core(edges: DataFrame) -> DataFrame:
    """(id, core): the core number, by h-index rounds: a node's bound becomes the largest h such that h neighbours have a bound of h or more.

    Only counts per (node, bound) are grouped, so a hub's neighbours are never collected. Rounds end at the fixpoint. The bounds are dealt out to the
    edges in every round: as a broadcast they would pass the driver three times a round.
    """
    from pyspark.sql import Window

    s = cut(symmetric(edges.filter("u <> v")).select("u", "v"), "kc")
    r = cut(degrees(edges.filter("u <> v")).select("id", F.col("deg").alias("core")), "kc")
    w = Window.partitionBy("u").orderBy(F.desc("h"))
    while True:
        mine = r.toDF("u", "mine").hint("merge")
        c = s.join(r.toDF("v", "c").hint("merge"), "v").join(mine, "u").select("u", F.least("c", "mine").alias("h")).groupBy("u", "h").agg(F.count(F.lit(1)).alias("k"))
        new = c.withColumn("k", F.sum("k").over(w)).groupBy("u").agg(F.max(F.least("h", "k")).alias("core")).withColumnRenamed("u", "id")
        new = cut(new, "kc")
        if not new.join(r.withColumnRenamed("core", "old").hint("merge"), "id").filter("core <> old").limit(1).count():
            return new
        r = new


def _distances_joined(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """``distances`` by frontier joins; visited pairs leave by an anti-join."""
    s = cut(symmetric(edges.filter("u <> v")).select("u", "v"), "bfs")
    front = sources.select(F.col("id").alias("src"), "id", F.lit(0).cast("long").alias("dist"))
    seen = front = cut(front.distinct(), "bfs")
    parts, step = [front], 0
    while most is None or step < most:
        step += 1
        new = front.join(s, front["id"] == s["u"]).select("src", F.col("v").alias("id")).distinct().join(seen.select("src", "id"), ["src", "id"], "left_anti")
        front = cut(new.withColumn("dist", F.lit(step).cast("long")), "bfs")
        if not front.limit(1).count():
            break
        parts.append(front)
        seen = parts[-1].union(parts[-2])  # a breadth-first frontier can only meet its own and the last layer
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Longs of a row of ``hop_counts``: a block is 64 sources a long.
WORDS = 16
#: Pieces of at most so many pairs are searched in tasks, a block of sources each; and pairs (source, node) of a block of ``distances``.
LOCAL, BLOCK = 4_000_000, 4_000_000


def _search(pairs: np.ndarray, sources: np.ndarray, most: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(dist, word, ids, bits): breadth-first search from many sources at once; a bit stands for one of the 64 sources of a word that has just
    reached the node."""
    ids, at = np.unique(np.concatenate([pairs.ravel(), sources]), return_inverse=True)
    u, v = at[: pairs.size].reshape(-1, 2).T.astype(np.int32)
    to, near = np.concatenate([u, v]), np.concatenate([v, u])
    near = near[np.argsort(to, kind="stable")]
    own, starts = np.unique(np.sort(to), return_index=True)
    first = at[pairs.size :]
    for word in range(-(-len(sources) // 64)):
        mine = first[word * 64 : word * 64 + 64]
        front = np.zeros(len(ids), np.uint64)
        front[mine] = np.uint64(1) << np.arange(len(mine), dtype=np.uint64)
        seen, dist = front.copy(), 0
        while front.any() and (most is None or dist <= most):
            yield dist, word, ids, front
            dist += 1
            new = np.zeros(len(ids), np.uint64)
            if len(own):
                new[own] = np.bitwise_or.reduceat(front[near], starts)
            front = new & ~seen
            seen |= front


def _pieces(edges: DataFrame, sources: DataFrame | None, width) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(blocks, pairs, rest, paths): ``blocks`` holds (piece, block, u, v), for every block of at most ``width`` sources the pairs of its piece and a row
    (u, null) a source; ``pairs`` and ``rest`` are the edges and sources of components of more than ``LOCAL`` pairs.

    A piece is a component, or many small ones together. ``width`` is a column of the piece's number of nodes ``n``.
    """
    from pyspark.sql import Window

    e, e_at = put(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "hops")
    comp, comp_at = put(components(e), "hops")
    inner = e.filter("u <> v").join(comp.withColumnRenamed("id", "u"), "u")
    m = inner.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    lots = max(1, -(-e.count() // 100_000))
    small = -1 - F.pmod(F.xxhash64("component"), F.lit(lots))  # small components are dealt to so many pieces
    kind = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(m, "component", "left").na.fill(0, ["m"])
    kind = kind.select("component", F.when(F.col("m") > LOCAL, F.lit(None)).when(F.col("m") < 1_000, F.concat(F.lit("s"), small.cast("string"))).otherwise(F.col("component").cast("string")).alias("piece"), "n")
    kind, kind_at = put(kind, "hops")
    src = comp.select("id") if sources is None else sources.select("id").distinct()
    own = src.join(comp, "id", "left").join(kind, "component", "left")
    lone = F.concat(F.lit("s"), (-1 - F.pmod(F.xxhash64("id"), F.lit(lots))).cast("string"))  # a source without edges
    own, own_at = put(own.withColumn("piece", F.when(F.col("component").isNull(), lone).otherwise(F.col("piece"))).select("id", "piece"), "hops")
    sizes = kind.filter("piece IS NOT NULL").groupBy("piece").agg(F.sum("n").alias("n"))
    numbered = own.filter("piece IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("piece").orderBy("id")) - 1).join(sizes, "piece", "left").na.fill(1, ["n"])
    dealt, dealt_at = put(numbered.select("piece", F.floor(F.col("k") / width).alias("block"), "id"), "hops")
    held = inner.join(kind.filter("piece IS NOT NULL"), "component").select("piece", "u", "v")
    blocks = held.join(dealt.select("piece", "block").distinct(), "piece").select("piece", "block", "u", "v").union(dealt.select("piece", "block", "id", F.lit(None).cast("long")))
    far = inner.join(kind.filter("piece IS NULL"), "component", "left_semi").select("u", "v").withColumn("w", F.lit(1).cast("long"))
    return blocks, far, own.filter("piece IS NULL").select("id"), [e_at, comp_at, kind_at, own_at, dealt_at]


def _split(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and the sources of a block."""
    source = pdf["v"].isna().to_numpy()
    return pdf.loc[~source, ["u", "v"]].to_numpy(np.int64).reshape(-1, 2), np.sort(pdf.loc[source, "u"].to_numpy(np.int64))


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(src, id, dist): hops from each source (id) to every node it reaches.

    Components of at most ``LOCAL`` pairs are searched in tasks, a block of sources each, so that a block returns at most ``BLOCK`` rows or those of one
    source; larger ones by frontier joins.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, src = _split(pdf)
        parts = []
        for dist, word, ids, bits in _search(pairs, src, most):
            at = np.flatnonzero(bits)
            node, k = np.nonzero(np.unpackbits(bits[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            parts.append((src[word * 64 + k], ids[at[node]], np.full(len(k), dist)))
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("src", "id", "dist"))})

    blocks, far, rest, _ = _pieces(edges, sources, F.greatest(F.lit(1), F.least(F.lit(64 * WORDS), F.floor(F.lit(BLOCK) / F.col("n")))))
    near = blocks.groupBy("piece", "block").applyInPandas(run, "src long, id long, dist long")
    return near.union(_distances_joined(far, rest, most)) if rest.limit(1).count() else near


def hop_counts(edges: DataFrame, sources: DataFrame | None = None, most: int | None = None, at_once: int = 64) -> DataFrame:
    """(dist, pairs): ordered pairs at each distance from the sources (all nodes by default).

    Components of at most ``LOCAL`` pairs are searched in tasks, a block of 64 * ``WORDS`` sources each, with a bit for each of a word's sources; larger
    ones by joins, ``at_once`` blocks together. No pair is ever held.
    """
    spark = edges.sparkSession

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole: dict[int, int] = {}
        for dist, _, _, bits in _search(*_split(pdf), most):
            whole[dist] = whole.get(dist, 0) + int(np.bitwise_count(bits).sum())
        return pd.DataFrame(whole.items(), columns=["dist", "pairs"])

    blocks, far, rest, paths = _pieces(edges, sources, F.lit(64 * WORDS))
    near = blocks.groupBy("piece", "block").applyInPandas(run, "dist long, pairs long").groupBy("dist").agg(F.sum("pairs").alias("pairs"))
    whole = {r.dist: r.pairs for r in near.collect()}  # a row per distance
    if rest.limit(1).count():
        for r in _hop_counts_joined(far, rest, most, at_once).collect():
            whole[r.dist] = whole.get(r.dist, 0) + r.pairs
    for path in paths:
        drop(path)
    return spark.createDataFrame(sorted(whole.items()), "dist long, pairs long")


def _hop_counts_joined(edges: DataFrame, sources: DataFrame, most: int | None = None, at_once: int = 64) -> DataFrame:
    """``hop_counts`` by joins.

    Breadth-first search of many sources at once: sources are numbered, and a row (block, node) holds a bit for each of a block's sources that has just
    reached the node. A round sends these bits over the edges, takes their union at each node (a partial aggregation), and clears the bits of the last two
    rounds, which are all that can come again. Only bits are held, never a pair, and ``at_once`` blocks are searched together, then the next.
    """
    from weft.operators.core import ranked

    spark = edges.sparkSession
    s, s_at = put(symmetric(edges.filter("u <> v")).select("u", "v").distinct(), "hops")
    start, start_at = put(ranked(sources.select("id").distinct().withColumn("key", F.col("id")), "key").select("id", "rank"), "hops")
    blocks = -(-start.count() // (64 * WORDS))
    bits = [f"b{i}" for i in range(WORDS)]
    whole: dict[int, int] = {}
    for low in range(0, blocks, at_once):
        own = start.withColumn("block", F.floor(F.col("rank") / (64 * WORDS))).filter((F.col("block") >= low) & (F.col("block") < low + at_once))
        word, bit = F.floor(F.col("rank") / 64) % WORDS, F.expr("shiftleft(1L, CAST(rank % 64 AS INT))")
        set_bits = F.sum(sum(F.bit_count(b) for b in bits)).cast("long").alias("n")
        seen = Observation()  # the bits of a round are counted while they are written
        front, front_at = put(own.select("block", "id", *[F.when(word == i, bit).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(bits)]).observe(seen, set_bits), "hops")
        last, last_at, dist = front.limit(0), None, 0
        while True:
            n = seen.get["n"]
            if not n:
                break
            whole[dist] = whole.get(dist, 0) + n
            dist += 1
            if most is not None and dist > most:
                break
            come = front.withColumnRenamed("id", "u").join(s, "u").select("block", F.col("v").alias("id"), *bits, F.lit(True).alias("new"))
            both = come.union(front.withColumn("new", F.lit(False))).union(last.withColumn("new", F.lit(False)))
            some = lambda b, new: F.bit_or(F.when(F.col("new") == new, F.col(b)).otherwise(F.lit(0).cast("long")))
            met = both.groupBy("block", "id").agg(*[x for b in bits for x in (some(b, True).alias(b), some(b, False).alias(f"o{b}"))])
            fresh = met.select("block", "id", *[F.col(b).bitwiseAND(F.bitwise_not(F.col(f"o{b}"))).alias(b) for b in bits])
            seen = Observation()
            got, got_at = put(fresh.filter(" OR ".join(f"{b} <> 0" for b in bits)).observe(seen, set_bits), "hops")
            drop(last_at)
            last, last_at, front, front_at = front, front_at, got, got_at
        drop(last_at)
        drop(front_at)
    drop(s_at)
    drop(start_at)
    return spark.createDataFrame(sorted(whole.items()), "dist long, pairs long")


def hop_counts_estimated(edges: DataFrame, most: int = 1_000, lg: int = 12) -> DataFrame:
    """(dist, pairs): estimated ordered pairs at each distance over all nodes, for graphs whose pairs are too many to hold even as bits.

    Each node has a HyperLogLog sketch of the nodes within so many hops; a round unites the sketches of a node's neighbours with its own. The sum of the
    sketches' estimates is the number of pairs within that distance: a node's estimate has a standard error of 1.04 / sqrt(2^lg) (1.6 % at
    12), the sum's is no larger. Rounds end when the sum no longer grows; ``most`` rounds without an end raise an error.
    """
    spark = edges.sparkSession
    s, s_at = put(symmetric(edges.filter("u <> v")).select("u", "v").distinct(), "near")
    now, at = put(nodes(edges).groupBy("id").agg(F.hll_sketch_agg("id", F.lit(lg)).alias("near")), "near")
    within = [now.count()]
    for _ in range(most):
        come = now.withColumnRenamed("id", "u").join(s, "u").select(F.col("v").alias("id"), "near")
        new, new_at = put(come.union(now).groupBy("id").agg(F.hll_union_agg("near").alias("near")), "near")
        total = new.agg(F.sum(F.hll_sketch_estimate("near"))).first()[0]
        drop(at)
        now, at = new, new_at
        if total <= within[-1]:
            break
        within.append(total)
    else:
        raise RuntimeError(f"neighbourhoods still grow after {most} rounds")
    drop(at)
    drop(s_at)
    return spark.createDataFrame([(d, t - (within[d - 1] if d else 0)) for d, t in enumerate(within)], "dist long, pairs long")


def effective_diameter(edges: DataFrame, sources: DataFrame | None = None, share: float = 0.9) -> float:
    """The distance, interpolated, within which ``share`` of the connected pairs lie."""
    rows = sorted((r.dist, r.pairs) for r in hop_counts(edges, sources).collect() if r.dist > 0)  # one row per distance
    total, before = sum(p for _, p in rows), 0
    for d, p in rows:
        if before + p >= share * total:
            return d - 1 + (share * total - before) / p
        before += p
    return 0.0


def bfs_sample(edges: DataFrame, start: int, size: int) -> DataFrame:
    """Edges induced on the first ``size`` nodes in breadth-first order (layer, id) from ``start``."""
    from weft.operators.core import induced

    s = cut(symmetric(edges.filter("u <> v")).select("u", "v"), "smp")
    seen = front = edges.sparkSession.createDataFrame([(start, 0)], "id long, layer int")
    step = 0
    while seen.count() < size:
        step += 1
        front = cut(front.select(F.col("id").alias("u")).join(s, "u").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("layer", F.lit(step)), "smp")
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front), "smp")
    return induced(edges, seen.orderBy("layer", "id").limit(size).select("id"))
