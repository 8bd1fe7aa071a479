"""Which tree nodes a grammar contracts, without a schedule: bottom up over the dendrogram, a small summary for each tree node.

By the size scores a node becomes eligible once it has at most ``mu`` leaves left, and then goes before everything inside it. So what a subtree does
until its root is eligible depends on itself alone. Of the order among subtrees only two things matter to their parent: the largest key
that a subtree must wait for before it is eligible (``wait``), and the key at which it is contracted then (``own``). The parent meets its
children's events in the order of these keys; it is eligible as soon as it has at most ``mu`` leaves, whichever children have been contracted by then,
and takes in the others as they are. A node of more than ``mu`` children never fits, nor does any above it; in the end the root takes all that is left.

So the order of all contractions, which is one long queue, needn't be known. Subtrees of at most ``LOCAL`` leaves are summarised by a task each, the few
nodes above level by level, and all rules come from aggregations over edges whose ends know the contracted nodes above them.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.core import group_rules
from weft.operators.rest import cut
from weft.operators.selection import ordered

LOCAL = 20_000
#: Before any event.
START = (-1, 0.0, 0.0, -1, 0)
KEY = "struct<s:int,a:double,b:double,level:int,lo:bigint>"
SUMMARY = f"level int, lo bigint, up bigint, kind string, popped boolean, leaves int, own {KEY}, wait {KEY}"


def compact(paths: DataFrame) -> DataFrame:
    """(id, nodes): for each leaf the tree nodes above it from the root (level, lo, n): a tree node is known by its level and its smallest leaf,
    and a cluster that is all of its parent is the same tree node."""
    long = paths.select("id", F.posexplode("path").alias("k", "c"))
    size = long.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    whole = paths.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    own = long.join(size, ["k", "c"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "n"))).alias("x"))
    own = paths.select("id").join(own, "id", "left").join(F.broadcast(whole.toDF("n0", "lo0")))  # one row
    x = F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.col("lo0").alias("lo"), F.col("n0").alias("n"))), F.coalesce("x", F.array().cast("array<struct<k:int,lo:bigint,n:bigint>>")))
    own = own.select("id", x.alias("x"))
    kept = F.filter("x", lambda y, i: (i == 0) | ((y["n"] > 1) & (y["n"] != F.get("x", i - 1)["n"])))
    return own.select("id", F.transform(kept, lambda y, i: F.struct(i.cast("int").alias("level"), y["lo"].alias("lo"), y["n"].alias("n"))).alias("nodes"))


def meet(kids: list[tuple], leaves: int, mu: int) -> tuple[tuple, int, list[bool]] | None:
    """What a node waits for, its leaves when it is eligible, and which of its children (leaves, own key, wait) are contracted by then; None if it
    is never eligible. ``leaves`` of its children are leaves."""
    if len(kids) + leaves > mu or any(k is None for k in kids):
        return None
    events = sorted(x for i, (_, own, wait) in enumerate(kids) for x in ((wait, 0, i), (max(wait, own), 1, i)))
    now: list[int | None] = [None] * len(kids)
    popped, at = [False] * len(kids), START
    for key, kind, i in [(START, 2, -1), *events]:
        at = max(at, key)
        if kind == 0:
            now[i] = kids[i][0]
        elif kind == 1:
            now[i], popped[i] = 1, True
        if None not in now and sum(now) + leaves <= mu:  # type: ignore[arg-type]
            return at, sum(now) + leaves, popped  # type: ignore[arg-type]
    raise AssertionError("all children are contracted")


def _own(kind: str, mu: int, leaves: int, level: int, lo: int, cost: float | None) -> tuple:
    return mu - leaves, float(level if "level" in kind else 0), (float("inf") if cost is None else float(cost)) if "dl" in kind else 0.0, level, lo


def _subtree(mu: int, kind: str):
    """All tree nodes of one subtree; rows are its leaves with the nodes above them from its root on."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict[tuple, set] = defaultdict(set)
        leaves: dict[tuple, int] = defaultdict(int)
        up: dict[tuple, tuple | None] = {}
        costs: dict[tuple, float] = {}
        for above, known in zip(pdf["nodes"], pdf["costs"], strict=True):
            before = None
            for x in above:
                t = (int(x["level"]), int(x["lo"]))
                if before is not None:
                    kids[before].add(t)
                up[t], before = before, t
            leaves[before] += 1
            for x in known if known is not None else ():
                costs[int(x["level"]), int(x["lo"])] = x["cost"]
        found, popped = {}, {}
        for t in sorted(up, reverse=True):
            own = sorted(kids[t])
            got = meet([found[c] for c in own], leaves[t], mu)
            if got is None:
                found[t] = None
                popped |= {c: found[c] is not None for c in own}
            else:
                wait, n, flags = got
                found[t] = (n, _own(kind, mu, n, *t, costs.get(t)), wait)
                popped |= dict(zip(own, flags, strict=True))
        out = []
        for t, s in found.items():
            top = up[t] is None
            n, own, wait = s or (None, None, None)
            out.append((*t, None if top else up[t][1], "top" if top else "in", None if top else popped[t], n if top else None, own if top else None, wait if top else None))
        return _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["level", "lo", "up", "kind", "popped", "leaves", "own", "wait"]
    key = lambda x: None if x is None else dict(zip(("s", "a", "b", "level", "lo"), x, strict=True))
    df = pd.DataFrame([(*r[:6], key(r[6]), key(r[7])) for r in rows], columns=names)
    return df.astype({"level": "int32", "lo": "int64", "up": "Int64", "popped": "boolean", "leaves": "Int32"})


def _above(mu: int, kind: str):
    """One tree node above the subtrees, from its children's rows: those contracted, and its own summary."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        level, lo, up = int(pdf["plevel"][0]), int(pdf["plo"][0]), pdf["pup"][0]
        read = lambda x: (int(x["s"]), float(x["a"]), float(x["b"]), int(x["level"]), int(x["lo"]))
        rows = sorted(pdf[pdf["kind"] != "leaf"].to_dict("records"), key=lambda r: r["lo"])
        kids = [None if pd.isna(r["leaves"]) else (int(r["leaves"]), read(r["own"]), read(r["wait"])) for r in rows]
        got = meet(kids, len(pdf) - len(rows), mu)
        flags = [k is not None for k in kids] if got is None else got[2]
        out = [(int(r["level"]), int(r["lo"]), lo, "in", f, None, None, None) for r, f in zip(rows, flags, strict=True)]
        wait, n = (None, None) if got is None else got[:2]
        own = None if got is None else _own(kind, mu, n, level, lo, None)
        return _frame([*out, (level, lo, None if pd.isna(up) else int(up), "top", None, n, own, wait)])

    return run


def contracted(paths: DataFrame, mu: int = 4, kind: str = "mu_level", costs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes): leaves with the tree nodes above them (``compact``), and the (level, lo) of the tree nodes that are contracted, both at rest.
    ``costs`` (level, lo, cost) are rule costs for the scores with ``dl``."""
    tree = cut(compact(paths), "tree")
    none = F.lit(None).cast("array<struct<level:int,lo:bigint,cost:double>>")
    own = tree.withColumn("costs", none)
    if costs is not None:
        small = tree.select("id", F.explode(F.filter("nodes", lambda x: x["n"] <= mu)).alias("x")).select("id", "x.level", "x.lo").join(costs, ["level", "lo"])
        own = tree.join(small.groupBy("id").agg(F.collect_list(F.struct("level", "lo", "cost")).alias("costs")), "id", "left")
    # the topmost node above a leaf that a task can take
    place = F.array_position(F.transform("nodes", lambda x: x["n"] <= LOCAL), True).cast("int")
    placed = own.withColumn("place", place)
    inside = placed.filter("place > 0").withColumn("nodes", F.expr("slice(nodes, place, size(nodes))"))
    parts = cut(inside.groupBy(F.get("nodes", F.lit(0))["level"].alias("tl"), F.get("nodes", F.lit(0))["lo"].alias("tlo")).applyInPandas(_subtree(mu, kind), SUMMARY), "parts")
    out = parts.filter("popped").select("level", "lo")
    # nodes above, with their parents, and what stands right below them
    upper = tree.select(F.filter("nodes", lambda x: x["n"] > LOCAL).alias("x")).filter("size(x) > 0")
    pairs = upper.select(F.explode(F.transform("x", lambda y, i: F.struct(y["level"].alias("level"), y["lo"].alias("lo"), F.when(i > 0, F.get("x", i - 1)["lo"]).alias("up")))).alias("y")).select("y.*").distinct()
    pairs = cut(pairs, "upper")
    deepest = pairs.agg(F.max("level")).first()[0]
    tops = parts.filter("kind = 'top'")
    if deepest is None:
        root = tops.select("level", "lo")
        return tree, cut(out.union(root).distinct(), "contracted")
    upto = placed.withColumn("before", F.when(F.col("place") > 0, F.get("nodes", F.col("place") - 2)).otherwise(F.element_at("nodes", -1)))
    under = upto.filter("place > 0").select(F.get("nodes", F.col("place") - 1)["level"].alias("level"), F.get("nodes", F.col("place") - 1)["lo"].alias("lo"), F.col("before.lo").alias("up")).distinct()
    alone = upto.filter("place = 0").select((F.col("before.level") + 1).alias("level"), F.col("id").alias("lo"), F.col("before.lo").alias("up"))
    blank = [F.lit(None).cast("int").alias("leaves"), F.lit(None).cast(KEY).alias("own"), F.lit(None).cast(KEY).alias("wait")]
    known = tops.drop("up").join(under, ["level", "lo"]).select("level", "lo", "up", F.lit("top").alias("kind"), "leaves", "own", "wait").union(alone.select("level", "lo", "up", F.lit("leaf"), *blank))
    known = cut(known, "known")
    for level in range(deepest, -1, -1):
        here = pairs.filter(F.col("level") == level).select(F.col("level").alias("plevel"), F.col("lo").alias("plo"), F.col("up").alias("pup"))
        kids = known.filter(F.col("level") == level + 1).join(here, F.col("up") == F.col("plo"))
        n = cut(kids.groupBy("plevel", "plo", "pup").agg(F.count(F.lit(1)).alias("n")), "kids")
        few = kids.join(n.filter(F.col("n") <= mu).select("plo"), "plo", "left_semi").groupBy("plevel", "plo").applyInPandas(_above(mu, kind), SUMMARY)
        few = cut(few, "few")
        # more children than fit: all that can be contracted are
        many = n.filter(F.col("n") > mu)
        gone = kids.join(many.select("plo"), "plo", "left_semi").filter("kind <> 'leaf' AND leaves IS NOT NULL").select("level", "lo")
        out = cut(out.union(few.filter("popped").select("level", "lo")).union(gone), "contracted")
        tall = many.select(F.col("plevel").alias("level"), F.col("plo").alias("lo"), F.col("pup").alias("up"), F.lit("top").alias("kind"), *blank)
        known = cut(known.filter(F.col("level") <= level).union(few.filter("kind = 'top'").select("level", "lo", "up", "kind", "leaves", "own", "wait")).union(tall), "known")
    return tree, cut(out.union(known.filter("level = 0").select("level", "lo")).distinct(), "contracted")


def small_costs(edges: DataFrame, paths: DataFrame, mu: int) -> DataFrame:
    """(level, lo, cost): rule cost of every tree node of at most mu leaves. Nodes of one level are disjoint, so a level is one batch."""
    small = cut(compact(paths).select("id", F.explode(F.filter("nodes", lambda x: x["n"] <= mu)).alias("x")).select("id", "x.level", "x.lo"), "small")
    out = None
    for r in small.select("level").distinct().orderBy("level").collect():  # a row a level
        part = group_rules(edges, small.filter(F.col("level") == r.level).select(F.col("lo").alias("grp"), "id")).select(F.lit(r.level).alias("level"), F.col("grp").alias("lo"), "cost")
        out = part if out is None else out.union(part)
    return cut(out, "costs") if out is not None else edges.sparkSession.createDataFrame([], "level int, lo bigint, cost double")


def steps(edges: DataFrame, paths: DataFrame, mu: int = 4, kind: str = "mu_level") -> DataFrame:
    """(step, lhs, level, rhs_nodes, rhs_edges): one row per contracted tree node, deeper ones first.

    A leaf's chain lists the contracted nodes above it, each with the member that stands for the leaf there: the leaf itself in the first, and then the
    smallest leaf of the node contracted before. An edge is inside the first node that both its ends' chains have, and on the border of
    every earlier one.
    """
    tree, nodes = contracted(paths, mu, kind, small_costs(edges, paths, mu) if "dl" in kind else None)
    above = tree.select("id", F.explode("nodes").alias("x")).select("id", "x.level", "x.lo").join(nodes, ["level", "lo"], "left_semi")
    chains = above.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("level", "lo")), asc=False).alias("c"))
    chains = cut(chains.select("id", F.transform("c", lambda x, i: F.struct(x["level"].alias("level"), x["lo"].alias("lo"), F.when(i == 0, F.col("id")).otherwise(F.get("c", i - 1)["lo"]).alias("rep"), F.when(i > 0, F.get("c", i - 1)["level"]).alias("from"))).alias("chain")), "chains")
    a, b = chains.toDF("u", "ca"), chains.toDF("v", "cb")
    at = lambda c: F.transform(c, lambda x: F.struct(x["level"].alias("level"), x["lo"].alias("lo")))
    e = edges.join(a, "u").join(b, "v").withColumn("m", F.array_max(F.array_intersect(at("ca"), at("cb"))))
    rep = lambda c: F.get(F.filter(c, lambda x: x["level"] == F.col("m.level")), F.lit(0))["rep"]
    e = cut(e.select("w", "m", F.least(rep("ca"), rep("cb")).alias("a"), F.greatest(rep("ca"), rep("cb")).alias("b"), F.filter(F.concat("ca", "cb"), lambda x: x["level"] > F.col("m.level")).alias("crossed")), "met")
    inner = e.groupBy(F.col("m.level").alias("level"), F.col("m.lo").alias("lo"), "a", "b").agg(F.sum("w").alias("w"))
    border = e.select(F.explode("crossed").alias("x"), "w").groupBy("x.level", "x.lo", "x.rep").agg(F.sum("w").alias("b_deg"))
    members = chains.select(F.explode("chain").alias("x")).select("x.level", "x.lo", "x.rep", "x.from").distinct()
    members = cut(members.join(border, ["level", "lo", "rep"], "left").na.fill(0, ["b_deg"]), "members")
    lhs = cut(members.groupBy("level", "lo").agg(F.sum("b_deg").alias("lhs")), "lhs")
    labels = lhs.select(F.col("level").alias("from"), F.col("lo").alias("rep"), F.col("lhs").alias("label"))
    number = F.row_number().over(Window.partitionBy("level", "lo").orderBy("rep")) - 1
    nodes_ = cut(members.join(labels, ["from", "rep"], "left").withColumn("node", number.cast("int")), "numbered")
    name = nodes_.select("level", "lo", "rep", "node")
    es = inner.join(name.withColumnsRenamed({"rep": "a", "node": "na"}), ["level", "lo", "a"]).join(name.withColumnsRenamed({"rep": "b", "node": "nb"}), ["level", "lo", "b"])
    es = es.groupBy("level", "lo").agg(F.array_sort(F.collect_list(F.struct(F.col("na").alias("a"), F.col("nb").alias("b"), "w"))).alias("rhs_edges"))
    ns = nodes_.groupBy("level", "lo").agg(F.array_sort(F.collect_list(F.struct("node", "label", "b_deg"))).alias("rhs_nodes"))
    none = F.expr("cast(array() AS array<struct<a:int,b:int,w:bigint>>)")
    r = lhs.join(ns, ["level", "lo"]).join(es, ["level", "lo"], "left").withColumn("rhs_edges", F.coalesce("rhs_edges", none))
    return ordered(r, F.desc("level"), F.asc("lo")).select(F.col("rank").cast("int").alias("step"), "lhs", "level", "rhs_nodes", "rhs_edges")
