"""Dendrograms: trees whose leaves are nodes, from random halving, modularity, conductance or spectral splits.

A tree is (tnode, parent, level, is_leaf, id): internal tree nodes are numbered from 0 (the root, parent null) in breadth-first order, ids
stand on leaves. Splits of one level are independent, so each level is one grouped job over all of its clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.core import degrees, nodes, ranked, symmetric
from weft.operators.randgraph import drawn
from weft.operators.rest import cut

#: A cluster of at most so many nodes is split to the end by one task; larger ones level by level.
LOCAL = 2_000


def random_tree(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Halving in a seeded random order: a leaf's path is the binary prefix of its rank, so the tree is arithmetic on ranks."""
    ids = nodes(edges)
    order = ranked(ids.withColumn("__h", drawn(seed, "id", digits=15)), "__h").select("id", "rank")
    n = order.count()
    levels = max(1, (n - 1).bit_length()) if n > 1 else 1
    # a path at depth k is rank * 2^k // n': halves of equal size up to one
    path = [(F.floor(F.col("rank") * (1 << k) / n)).cast("long") for k in range(levels + 1)]
    return order.select("id", F.array(*path).alias("path"))


def paths_to_tree(paths: DataFrame) -> DataFrame:
    """(tnode, parent, level, is_leaf, id) from (id, path), path[k] naming the cluster at depth k. Clusters of one node end as its leaf."""
    long = paths.select("id", F.posexplode("path").alias("level", "c"))
    size = long.groupBy("level", "c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    long = long.join(size, ["level", "c"])
    inner = long.filter("n > 1").groupBy("level", "c").agg(F.min("id").alias("lo"))
    name = lambda level, c: F.concat_ws("/", level.cast("string"), c.cast("string"))
    up = long.withColumn("prev", F.lag("c").over(Window.partitionBy("id").orderBy("level"))).withColumn("pn", F.lag("n").over(Window.partitionBy("id").orderBy("level")))
    parents = up.filter("n > 1").groupBy("level", "c").agg(F.min("prev").alias("prev"))
    inner = inner.join(parents, ["level", "c"]).select(name(F.col("level"), F.col("c")).alias("tnode"), F.when(F.col("level") > 0, name(F.col("level") - 1, F.col("prev"))).alias("parent"), F.col("level"), F.lit(False).alias("is_leaf"), F.lit(None).cast("long").alias("id"))
    last = up.filter("n = 1 AND (pn IS NULL OR pn > 1)").select(F.concat(F.lit("="), F.col("id").cast("string")).alias("tnode"), F.when(F.col("level") > 0, name(F.col("level") - 1, F.col("prev"))).alias("parent"), F.col("level"), F.lit(True).alias("is_leaf"), "id")
    deepest = up.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("level")))).filter("r = 1 AND n > 1").select(F.concat(F.lit("="), F.col("id").cast("string")).alias("tnode"), name(F.col("level"), F.col("c")).alias("parent"), (F.col("level") + 1).alias("level"), F.lit(True).alias("is_leaf"), "id")
    return inner.union(last).union(deepest)


def modularity_level(edges: DataFrame) -> DataFrame:
    """(id, cluster): one level of modularity clustering: nodes move to the neighbouring cluster that gains most, until no move gains."""
    from weft.operators.leiden import settled

    return settled(edges)


def modularity(edges: DataFrame, clusters: DataFrame) -> float:
    """Newman's modularity of a clustering (id, cluster)."""
    m2 = 2 * (edges.filter("u <> v").agg(F.sum("w")).first()[0] or 1)
    a, b = clusters.toDF("u", "cu"), clusters.toDF("v", "cv")
    inside = edges.filter("u <> v").join(a, "u").join(b, "v").filter("cu = cv").agg(F.sum("w")).first()[0] or 0
    t = degrees(edges.filter("u <> v")).join(clusters, "id").groupBy("cluster").agg(F.sum("wdeg").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0
    return 2 * inside / m2 - t / m2**2


def louvain(edges: DataFrame, levels: int | None = None) -> DataFrame:
    """(id, path): communities of communities; path[k] is a node's cluster at depth k, coarsest first, down to the first level's clusters. Levels are
    added until one merges nothing, or ``levels`` of them are there."""
    level = cut(modularity_level(edges), "lv").toDF("id", "c0")
    maps, e = level, edges
    names = ["c0"]
    while levels is None or len(names) < levels:
        a, b = level.toDF("u", "cu"), level.toDF("v", "cv")
        coarse = e.join(a, "u").join(b, "v").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"), "w").groupBy("u", "v").agg(F.sum("w").alias("w"))
        e = cut(coarse, "lv")
        if not e.filter("u <> v").limit(1).count():
            break
        new = f"c{len(names)}"
        nxt = cut(modularity_level(e), "lv").toDF("id", new)
        if nxt.select(new).distinct().count() == nxt.count():
            break
        maps = cut(maps.join(nxt.withColumnRenamed("id", names[-1]), names[-1], "left").withColumn(new, F.coalesce(new, names[-1])), "lv")
        names.append(new)
        level = nxt.toDF("id", "c")
    return maps.select("id", F.array(F.lit(0).cast("long"), *[F.col(c) for c in reversed(names)]).alias("path"))


def leiden(edges: DataFrame) -> DataFrame:
    """(id, path): Leiden communities, communities within each, and so on until none divides (see ``leiden.tree``)."""
    from weft.operators.leiden import tree

    return tree(edges)


def fiedler(adj: np.ndarray) -> np.ndarray:
    """The second eigenvector of the normalised Laplacian of a connected graph."""
    d = np.maximum(adj.sum(axis=0), 1e-12)
    lap = np.eye(len(adj)) - adj / np.sqrt(np.outer(d, d))
    return np.linalg.eigh(lap)[1][:, 1] / np.sqrt(d)


def connected(adj: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """Connected parts of some members, largest first."""
    left, out = set(members.tolist()), []
    while left:
        stack = [min(left)]
        left.discard(stack[0])
        part = []
        while stack:
            u = stack.pop()
            part.append(u)
            new = [v for v in np.flatnonzero(adj[u]).tolist() if v in left]
            left.difference_update(new)
            stack += new
        out.append(np.array(sorted(part)))
    return sorted(out, key=lambda p: (-len(p), p[0]))


def conductance_split(adj: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """Two connected halves: cut at the median of the Fiedler vector, then stray parts go over to the other half."""
    parts = connected(adj, members)
    if len(parts) > 1:
        return parts
    f = fiedler(adj[np.ix_(members, members)])
    order = np.lexsort((members, f))[::-1]
    top, rest = members[order[: len(members) // 2]], members[order[len(members) // 2 :]]
    for _ in range(len(members)):
        a, b = connected(adj, np.sort(top)), connected(adj, np.sort(rest))
        if len(a) == 1 and len(b) == 1:
            break
        if len(a) > 1:
            top, rest = a[0], np.concatenate([rest, *a[1:]])
        else:
            rest, top = b[0], np.concatenate([top, *b[1:]])
    return [np.sort(top), np.sort(rest)]


def kmeans_split(adj: np.ndarray, members: np.ndarray, k: int, seed: int = 0) -> list[np.ndarray]:
    """Spectral k-means on the row-normalised eigenvectors after the first; two clusters fall back to the conductance split."""
    parts = connected(adj, members)
    if len(parts) > 1 or k <= 2 or len(members) <= k + 1:
        return parts if len(parts) > 1 else conductance_split(adj, members)
    sub = adj[np.ix_(members, members)]
    d = np.maximum(sub.sum(axis=0), 1e-12)
    x = np.linalg.eigh(np.eye(len(sub)) - sub / np.sqrt(np.outer(d, d)))[1][:, 1 : k + 1]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(50):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return [members[own == c] for c in range(k) if (own == c).any()]


def split_tree(edges: DataFrame, how: str = "conductance", seed: int = 0) -> DataFrame:
    """(id, path) by repeated splits inside each connected component of at most LOCAL nodes (one task each); larger ones are first cut down
    by modularity levels, so no task gets more than LOCAL nodes unless a cluster can't be divided, which raises."""
    from weft.operators.iterate import components

    comp = cut(components(edges), "sp").toDF("id", "c0")
    big = comp.groupBy("c0").count().filter(F.col("count") > LOCAL)
    names = ["c0"]
    if big.limit(1).count():
        lv = cut(louvain(edges), "sp")
        deep = max(3, lv.select(F.size("path")).first()[0] - 1)
        every = [f"c{k}" for k in range(deep + 1)]
        whole = cut(comp.join(lv, "id").select("id", "c0", *[F.coalesce(F.get("path", F.lit(k)), F.col("id")).alias(f"c{k}") for k in range(1, deep + 1)]), "sp")
        for k in range(3, deep + 1):  # the three coarsest levels, and finer ones as long as a cluster is too large
            names = every[: k + 1]
            if whole.groupBy(*names).count().agg(F.max("count")).first()[0] <= LOCAL:
                break
        else:
            raise ValueError(f"a cluster of over {LOCAL} nodes could not be divided")
        comp = whole.select("id", *names)
    a, b = comp.toDF("u", *[f"a{k}" for k in names]), comp.toDF("v", *[f"b{k}" for k in names])
    e = edges.filter("u <> v").join(a, "u").join(b, "v")
    same = None
    for k in names:
        c = F.col(f"a{k}") == F.col(f"b{k}")
        same = c if same is None else same & c
    inner = e.filter(same).select("u", "v", *[F.col(f"a{k}").alias(k) for k in names])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pdf[["u", "v"]].to_numpy(np.int64)
        ids, flat = np.unique(pairs, return_inverse=True)
        flat = flat.reshape(-1, 2)
        adj = np.zeros((len(ids), len(ids)))
        adj[flat[:, 0], flat[:, 1]] = adj[flat[:, 1], flat[:, 0]] = 1
        paths: list[list[int]] = [[] for _ in ids]

        def go(members: np.ndarray, k: int) -> None:
            if len(members) <= 2:
                for i in members:
                    paths[i].append(int(ids[i]))
                return
            parts = conductance_split(adj, members) if how == "conductance" else kmeans_split(adj, members, k, seed)
            if len(parts) == 1:
                parts = [members[: len(members) // 2], members[len(members) // 2 :]]
            for p in parts:
                for i in p:
                    paths[i].append(int(ids[p.min()]))
                if len(p) > 1:
                    go(p, max(2, k - 1))

        go(np.arange(len(ids)), max(2, int((len(ids) // 2) ** 0.5)))
        return pd.DataFrame({"id": ids, "tail": paths})

    inner_keys = names
    tails = inner.groupBy(*inner_keys).applyInPandas(run, "id bigint, tail array<bigint>")
    return comp.join(tails, "id", "left").select("id", F.concat(F.array(F.lit(0).cast("long"), *names), F.coalesce("tail", F.array().cast("array<bigint>"))).alias("path"))


def walks(edges: DataFrame, count: int = 10, length: int = 20, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """(walk_id, nodes): second-order walks with back-step weight 1/p and outward weight 1/q.

    Each step joins all walks' current ends with their neighbours and keeps the one of largest keyed priority (weight over an exponential
    draw), a maximum that is combined map-side; the previous node's neighbourhood is a left join.
    """
    s = cut(symmetric(edges.filter("u <> v")).groupBy("u", "v").agg(F.sum("w").alias("w")), "walk")
    start = nodes(edges).select("id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    now = cut(start.select((F.xxhash64("id", "k", F.lit(seed))).alias("walk_id"), F.array("id").alias("nodes")), "walk")
    for step in range(1, length):
        ends = now.select("walk_id", F.element_at("nodes", -1).alias("u"), F.get("nodes", F.lit(step - 2)).alias("t") if step > 1 else F.lit(None).cast("long").alias("t"))
        c = ends.join(s, "u")
        near = s.select(F.col("u").alias("t"), "v", F.lit(True).alias("near"))
        c = c.join(near, ["t", "v"], "left") if step > 1 else c.withColumn("near", F.lit(None).cast("boolean"))
        weight = F.col("w") * F.when(F.col("t").isNull() | F.col("near"), 1.0).when(F.col("v") == F.col("t"), 1 / p).otherwise(1 / q)
        draw = -F.log((F.shiftrightunsigned(F.xxhash64("walk_id", "v", F.lit(seed * 1000 + step)), 11).cast("double") + 0.5) / float(1 << 53))
        pick = c.groupBy("walk_id").agg(F.min_by("v", F.struct(draw / weight, "v")).alias("next"))
        now = cut(now.join(pick, "walk_id", "left").select("walk_id", F.when(F.col("next").isNotNull(), F.concat("nodes", F.array("next"))).otherwise(F.col("nodes")).alias("nodes")), "walk")
    return now


def embed(walks_: DataFrame, size: int = 32, window: int = 10, seed: int = 0) -> DataFrame:
    """(id, vec): skip-gram embeddings of the walks' nodes by Spark ML."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = walks_.select(F.transform("nodes", lambda x: x.cast("string")).alias("w"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, maxIter=1, inputCol="w", outputCol="o", seed=seed).fit(words)
    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("vec"))


def linkage(x: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomerative merges (a, b, distance, size) by Lance-Williams updates; rows x are points."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), list(range(n)), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        flat = int(np.argmin(d))
        i, j = sorted(divmod(flat, n))
        h, ni, nj = d[i, j], size[i], size[j]
        others = alive.copy()
        others[[i, j]] = False
        di, dj = d[i, others], d[j, others]
        nk = size[others]
        if method == "single":
            new = np.minimum(di, dj)
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "average":
            new = (ni * di + nj * dj) / (ni + nj)
        elif method == "weighted":
            new = (di + dj) / 2
        elif method == "ward":
            new = np.sqrt(((ni + nk) * di**2 + (nj + nk) * dj**2 - nk * h**2) / (ni + nj + nk))
        elif method == "centroid":
            new = np.sqrt(np.maximum((ni * di**2 + nj * dj**2) / (ni + nj) - ni * nj * h**2 / (ni + nj) ** 2, 0))
        elif method == "median":
            new = np.sqrt(np.maximum((di**2 + dj**2) / 2 - h**2 / 4, 0))
        else:
            raise ValueError(method)
        out.append((name[i], name[j], h, ni + nj))
        d[i, others] = d[others, i] = new
        d[j], d[:, j] = np.inf, np.inf
        alive[j], size[i], name[i] = False, ni + nj, n + step
    return np.array(out).reshape(-1, 4)


METHODS = ("single", "complete", "average", "weighted", "ward", "centroid", "median")


def cophenetic(merges: np.ndarray, n: int) -> np.ndarray:
    """Distance at which each pair of points first meets."""
    groups: dict[int, list[int]] = {i: [i] for i in range(n)}
    c = np.zeros((n, n))
    for k, (a, b, h, _) in enumerate(merges):
        x, y = groups.pop(int(a)), groups.pop(int(b))
        c[np.ix_(x, y)] = h
        c[np.ix_(y, x)] = h
        groups[n + k] = x + y
    return c


def linkage_paths(ids: np.ndarray, x: np.ndarray) -> dict[int, list[int]]:
    """The path of each id in the agglomerative tree, over all linkage methods, with the best cophenetic correlation; it ends on the id."""
    n = len(ids)
    if n < 3:
        return {int(i): [0, int(i)] for i in ids}
    up = np.triu_indices(n, 1)
    base = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))[up] if n <= 256 else np.concatenate([np.sqrt(((x[i + 1 :] - x[i]) ** 2).sum(axis=1)) for i in range(n - 1)])
    best = max((linkage(x, m) for m in METHODS), key=lambda z: np.nan_to_num(np.corrcoef(base, cophenetic(z, n)[up])[0, 1], nan=-1))
    kids = {n + k: (int(a), int(b)) for k, (a, b, *_) in enumerate(best)}
    paths: dict[int, list[int]] = {}
    stack = [(n + len(best) - 1, [])]
    while stack:
        t, path = stack.pop()
        if t < n:
            paths[int(ids[t])] = [*path, int(ids[t])]
        else:
            stack += [(c, [*path, t]) for c in kids[t]]
    return paths


def cells(vectors: DataFrame, most: int) -> DataFrame:
    """(id, vec, cell): vectors dealt to cells of at most ``most`` by k-means, again within a cell that is too large; equal vectors are dealt by id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    done, left = None, cut(vectors.select("id", "vec", F.lit(0).cast("long").alias("cell")), "cells")
    used = 1
    while n := left.count():
        parts = []
        for r in left.groupBy("cell").count().collect():  # at most a cell for every `most` nodes
            own = left.filter(F.col("cell") == r["cell"])
            k = max(2, -(-2 * r["count"] // most))
            fitted = KMeans(k=k, maxIter=10, seed=1, featuresCol="f").fit(own.withColumn("f", array_to_vector("vec")))
            got = fitted.transform(own.withColumn("f", array_to_vector("vec")))
            if len(fitted.clusterCenters()) < 2:  # nothing to tell them apart
                got = got.withColumn("prediction", F.pmod("id", F.lit(k)))
            parts.append(got.select("id", "vec", (F.col("prediction") + used).cast("long").alias("cell")))
            used += k
        dealt = parts[0]
        for p in parts[1:]:
            dealt = dealt.union(p)
        dealt = cut(dealt, "cells")
        big = dealt.groupBy("cell").count().filter(F.col("count") > most).select("cell")
        fits = dealt.join(F.broadcast(big), "cell", "left_anti").select("id", "vec", "cell")  # at most a row for every `most` nodes
        done = fits if done is None else done.union(fits)
        left = cut(dealt.join(F.broadcast(big), "cell", "left_semi").select("id", "vec", "cell"), "cells")
        if left.count() == n and used > 4 * n:
            raise RuntimeError("cells don't get smaller")
    return cut(done, "cells")


def embedding_tree(vectors: DataFrame, most: int = LOCAL) -> DataFrame:
    """(id, path): the agglomerative tree with the best cophenetic correlation over all linkage methods.

    Up to ``most`` nodes it is one tree. More are dealt to cells of near vectors first: each cell's tree is made in a task of its own, and the
    tree of the cells' means (as many as ``most``, checked) stands on top.
    """
    spark, schema = vectors.sparkSession, "id bigint, path array<bigint>"
    if vectors.count() <= most:
        pdf = vectors.orderBy("id").toPandas()
        paths = linkage_paths(pdf["id"].to_numpy(), np.array(pdf["vec"].tolist()))
        return spark.createDataFrame(sorted(paths.items()), schema)
    dealt = cells(vectors, most)
    size = len(dealt.first()["vec"])
    means = dealt.groupBy("cell").agg(F.array(*[F.avg(F.element_at("vec", i + 1)) for i in range(size)]).alias("vec")).orderBy("cell").limit(most + 1).collect()
    if len(means) > most:
        raise ValueError(f"over {most} cells")
    top = linkage_paths(np.array([r["cell"] for r in means]), np.array([r["vec"] for r in means]))
    ends = sorted((c, p[:-1]) for c, p in top.items())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        got = sorted(linkage_paths(pdf["id"].to_numpy(), np.array(pdf["vec"].tolist())).items())
        # cells are named by negative numbers, so no name meets one of another level's
        return pd.DataFrame({"cell": int(key[0]), "id": [i for i, _ in got], "tail": [[-int(key[0]), *p[1:]] if len(p) > 2 or len(got) > 1 else [i] for i, p in got]})

    tails = dealt.groupBy("cell").applyInPandas(run, "cell bigint, id bigint, tail array<bigint>")
    return tails.join(F.broadcast(spark.createDataFrame(ends, "cell bigint, top array<bigint>")), "cell").select("id", F.concat("top", "tail").alias("path"))  # at most `most` rows
