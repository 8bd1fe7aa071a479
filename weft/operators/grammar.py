"""Vertex replacement grammars: rules extracted along a dendrogram, and graphs generated from them.

Which tree nodes are contracted, and when, follows from the tree alone for the size-based scores, because contracting one subtree leaves the
boundary and the inside of any disjoint subtree as they are. So the schedule is made from tree sizes, every edge is then mapped to the one
step at which it becomes internal, and all rules come from a few aggregations over the edge table.

Trees are (id, path) as in ``cluster``: path[k] is the cluster at depth k.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import contraction
from weft.operators.forms import least_order
from weft.operators.rest import cut

#: Schedules are made on the driver from one row per tree node: at most so many.
MOST_TREE_NODES = 2_000_000

RULE = "rule_id bigint, lhs bigint, n int, m bigint, freq bigint, level int, cost double, canon string, rhs_nodes array<struct<node:int,label:bigint,b_deg:bigint>>, rhs_edges array<struct<a:int,b:int,w:bigint>>"


def mu_score(leaves: Column, mu: int) -> Column:
    """0 at mu leaves, log2(1 + mu - leaves) below, infinite above."""
    return F.when(leaves > mu, F.lit(float("inf"))).when(leaves < mu, F.log2(1 + mu - leaves)).otherwise(F.lit(0.0))


def _gamma(x: float) -> float:
    return 2 * math.log2(x) + 1


def _dl(n: int, m: int, s: float, kinds: int) -> float:
    lu = math.log2(1 + kinds)
    return (math.log2(n) if n else 0.0) + n * lu + (math.log2(m) if m else 0.0) + lu * (s + n * n - 2 * m)


class Tree:
    """A dendrogram in memory: for each internal node its children, parent, level and leaves."""

    def __init__(self, paths: list[tuple[int, list[int]]]):
        self.kids: dict[int, list[int]] = defaultdict(list)
        self.parent: dict[int, int] = {}
        self.level: dict[int, int] = {}
        self.leaf_id: dict[int, int] = {}
        names: dict[tuple, int] = {}
        seen: dict[tuple, int] = defaultdict(int)
        for _, p in paths:
            for k in range(len(p)):
                seen[tuple(p[: k + 1])] += 1
        for node, p in sorted(paths):
            up = None
            for k in range(len(p)):
                key = tuple(p[: k + 1])
                if seen[key] == 1:
                    break
                # a cluster that is all of its parent is the same tree node
                if k and seen[key] == seen[key[:-1]]:
                    names.setdefault(key, names[key[:-1]])
                if key not in names:
                    names[key] = len(names)
                    t = names[key]
                    self.level[t] = self.level[up] + 1 if up is not None else 0
                    if up is not None:
                        self.parent[t] = up
                        self.kids[up].append(t)
                up = names[key]
            leaf = -1 - len(self.leaf_id)
            self.leaf_id[leaf] = node
            if up is None:
                names[()] = up = len(names)
                self.level[up] = 0
            self.parent[leaf] = up
            self.level[leaf] = self.level[up] + 1
            self.kids[up].append(leaf)
        # names are dense only per first use; the root is the node without a parent
        self.root = next((t for t in self.level if t not in self.parent), None)

    def internal(self) -> list[int]:
        return [t for t in self.level if t not in self.leaf_id]


def load_tree(paths: DataFrame, most: int = MOST_TREE_NODES) -> Tree:
    if paths.agg(F.sum(F.size("path"))).first()[0] > 8 * most:
        raise ValueError(f"the tree has more than {most} nodes")
    return Tree([(r.id, list(r.path)) for r in paths.collect()])


def schedule(tree: Tree, mu: int, kind: str = "mu_level", cost: dict[int, float] | None = None) -> list[tuple[int, list[int], int]]:
    """(tree node, its remaining leaves as tree nodes, level) in order of contraction. ``cost`` gives each candidate's rule cost for dl scores.

    A heap holds every internal node's score (ties by first insertion, breadth first); only ancestors of a contracted node are scored again.
    When nothing fits mu, the first-inserted node, which is the root, takes all that is left.
    """
    order = {}
    queue = [tree.root]
    while queue:
        t = queue.pop(0)
        if t in tree.leaf_id:
            continue
        order[t] = len(order)
        queue += tree.kids[t]
    leaves: dict[int, set[int]] = {}
    for t in sorted(order, key=lambda t: -tree.level[t]):
        leaves[t] = set().union(*({c} if c in tree.leaf_id else leaves[c] for c in tree.kids[t]))
    version = dict.fromkeys(order, 0)

    def score(t: int) -> tuple:
        d = len(leaves[t]) - mu
        first = math.inf if d > 0 else math.log2(1 - d) if d < 0 else 0.0
        rest = []
        if "level" in kind:
            rest.append(tree.level[t])
        if "dl" in kind:
            rest.append(math.inf if d > 0 or cost is None else cost.get(t, math.inf))
        return (first, *rest) if first < math.inf else (math.inf,)

    heap = [(score(t), order[t], 0, t) for t in order]
    heapq.heapify(heap)
    done: set[int] = set()
    out = []
    while heap:
        _, _, v, t = heapq.heappop(heap)
        if t in done or v != version[t]:
            continue
        out.append((t, sorted(leaves[t]), tree.level[t]))
        gone, stack = leaves[t], [t]
        while stack:
            x = stack.pop()
            if x in done:
                continue
            done.add(x)
            stack += [c for c in tree.kids[x] if c not in tree.leaf_id]
        new = max(gone)  # leaves are numbered down from -1 by node id, so the largest stands for the smallest id
        up = tree.parent.get(t)
        if up is None:
            break
        while up is not None:
            leaves[up] = (leaves[up] - gone) | {new}
            version[up] += 1
            heapq.heappush(heap, (score(up), order[up], version[up], up))
            up = tree.parent.get(up)
    return out


def rules_from_schedule(edges: DataFrame, tree: Tree, steps: list[tuple[int, list[int], int]], mode: str = "part") -> DataFrame:
    """One row per step: (step, lhs, level, rhs_nodes, rhs_edges), from one pass over the edges.

    A node's representatives over time are the steps it is part of; an edge is internal at the first step that holds both ends, and a boundary
    edge of every earlier step that holds one of them. Those (step, representative) chains are as long as the contraction tree is deep.
    """
    spark = edges.sparkSession
    standing: dict[int, int] = {}  # representative -> step that made it
    above: dict[int, tuple[int, int]] = {}  # step -> (later step that takes it in, as which member)
    first: dict[int, tuple[int, int]] = {}  # leaf -> (first step, member)
    for k, (_, members, _) in enumerate(steps):
        for i, leaf in enumerate(members):
            if leaf in standing:
                above[standing[leaf]] = (k, i)
            else:
                first[leaf] = (k, i)
        standing[max(members)] = k
    chains = []
    for leaf, (k, i) in first.items():
        chain = [(k, i)]
        while k in above:
            k, i = above[k]
            chain.append((k, i))
        chains.append((tree.leaf_id[leaf], chain))
    c = spark.createDataFrame(chains, "id bigint, chain array<struct<k:int,i:int>>")
    a, b = c.toDF("u", "ca"), c.toDF("v", "cb")
    e = edges.join(a, "u").join(b, "v")
    both = F.array_intersect(F.transform("ca", lambda x: x["k"]), F.transform("cb", lambda x: x["k"]))
    e = e.withColumn("meet", F.array_min(both))
    member = lambda chain: F.filter(chain, lambda x: x["k"] == F.col("meet"))[0]["i"]
    inner = e.filter("meet IS NOT NULL").select(F.col("meet").alias("k"), F.least(member("ca"), member("cb")).alias("a"), F.greatest(member("ca"), member("cb")).alias("b"), "w").groupBy("k", "a", "b").agg(F.sum("w").alias("w"))
    out = e.select(F.explode(F.concat(F.filter("ca", lambda x: F.col("meet").isNull() | (x["k"] < F.col("meet"))), F.filter("cb", lambda x: F.col("meet").isNull() | (x["k"] < F.col("meet"))))).alias("x"), "w").groupBy(F.col("x.k").alias("k"), F.col("x.i").alias("i")).agg(F.sum("w").alias("b_deg"))
    labels = {(k2, i2): k for k, (k2, i2) in above.items()}
    rows = [(k, i, labels.get((k, i))) for k, (_, members, _) in enumerate(steps) for i in range(len(members))]
    node = spark.createDataFrame(rows, "k int, i int, from_step int")
    node = node.join(out, ["k", "i"], "left").na.fill(0, ["b_deg"])
    lhs = node.groupBy("k").agg(F.sum("b_deg").alias("lhs"))
    node = node.join(lhs.select(F.col("k").alias("from_step"), F.col("lhs").alias("label")), "from_step", "left")
    levels = spark.createDataFrame([(k, lv) for k, (_, _, lv) in enumerate(steps)], "k int, level int")
    ns = node.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("node"), "label", "b_deg"))).alias("rhs_nodes"))
    es = inner.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("a", "b", "w"))).alias("rhs_edges"))
    r = levels.join(lhs, "k").join(ns, "k").join(es, "k", "left")
    none = F.expr("cast(array() AS array<struct<a:int,b:int,w:bigint>>)")
    return r.select(F.col("k").alias("step"), "lhs", "level", "rhs_nodes", F.coalesce("rhs_edges", none).alias("rhs_edges"))


def canonical_form(nodes: list[tuple], edges: list[tuple]) -> str:
    """A string that two right-hand sides share iff some bijection keeps labels and weights (boundary degrees don't count)."""
    n = len(nodes)
    pos = {x[0]: i for i, x in enumerate(nodes)}
    w = [[0] * n for _ in range(n)]
    for a, b, k in edges:
        w[pos[a]][pos[b]] += int(k)
        if a != b:
            w[pos[b]][pos[a]] += int(k)
    colour = [-1 if x[1] is None else x[1] for x in nodes]
    o = least_order(colour, w)
    return ",".join(str(colour[i]) for i in o) + "|" + ",".join(str(w[o[i]][o[j]]) for i in range(n) for j in range(i, n))


#: Right-hand sides of more nodes that are the only one with their boundary, nodes and edges need no canonical form, which is a full matrix.
WIDE = 24


def profile(nodes: list[tuple], edges: list[tuple]) -> str:
    """A short string that isomorphic right-hand sides share (others may, too): a digest of its labels and of its edges by the labels and weights at
    their ends."""
    colour = {x[0]: -1 if x[1] is None else int(x[1]) for x in nodes}
    around: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, b, w in edges:
        around[a].append((int(w), colour[b]))
        around[b].append((int(w), colour[a]))
    signs = sorted((colour[x[0]], sorted(around[x[0]])) for x in nodes)
    return f"{len(nodes)}|{len(edges)}|{hashlib.md5(repr(signs).encode()).hexdigest()}"


def with_cost(rules: DataFrame, mode: str = "part") -> DataFrame:
    """Add n, m and cost: boundary code, right-hand side, frequency and (in part mode) boundary degrees."""
    from weft.functions import mdl

    n, m = F.size("rhs_nodes"), F.size("rhs_edges").cast("long")
    s = F.aggregate("rhs_edges", F.lit(0.0), lambda a, x: a + 2 * mdl.gamma_bits(x["w"] + 1))
    kinds = F.size(F.array_distinct(F.transform("rhs_nodes", lambda x: x["label"].isNull())))
    top = F.array_max(F.transform("rhs_nodes", lambda x: x["b_deg"]))
    cost = mdl.gamma_bits(F.col("lhs") + 1) + mdl.dl(n.cast("long"), m, s, kinds) + mdl.gamma_bits(F.col("freq") + 1)
    if mode == "part":
        cost = cost + n * mdl.gamma_bits(top + 1)
    return rules.withColumn("n", n).withColumn("m", m).withColumn("cost", cost)


def dedupe(steps: DataFrame, mode: str = "part", match_b_deg: bool = False) -> DataFrame:
    """Rules from extracted steps: isomorphic right-hand sides with the same boundary are one rule; the first one's boundary degrees stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = []
            for ns, es, lone in zip(b["rhs_nodes"], b["rhs_edges"], b["lone"], strict=True):
                node = [(x["node"], (x["label"] if x["label"] is None or not math.isnan(x["label"]) else None), x["b_deg"]) for x in ns]
                if match_b_deg:
                    node = [(x, (lab if lab is not None else -1) * 1_000_003 + bd + 1, bd) for x, lab, bd in node]
                form = profile if lone else canonical_form
                forms.append(form([(i, None if lab is None else int(lab), bd) for i, lab, bd in node], [(x["a"], x["b"], x["w"]) for x in es]))
            yield b.drop(columns="lone").assign(canon=forms)

    kind = "step int, lhs bigint, level int, rhs_nodes array<struct<node:int,label:bigint,b_deg:bigint>>, rhs_edges array<struct<a:int,b:int,w:bigint>>, canon string"
    steps = cut(steps.select("step", "lhs", "level", "rhs_nodes", "rhs_edges"), "steps")
    sizes = ["lhs", F.size("rhs_nodes").alias("n"), F.size("rhs_edges").alias("m")]
    alone = steps.filter(F.size("rhs_nodes") > WIDE).groupBy(*sizes).agg(F.min("step").alias("step"), F.count(F.lit(1)).alias("c")).filter("c = 1").select("step", F.lit(True).alias("lone"))
    steps = steps.join(alone, "step", "left").na.fill(False, ["lone"])
    c = cut(steps.mapInPandas(run, kind), "rules")
    firsts = c.groupBy("lhs", "canon").agg(F.count(F.lit(1)).alias("freq"), F.min("step").alias("step"))
    r = firsts.join(c.select("step", "level", "rhs_nodes", "rhs_edges"), "step")
    return with_cost(r.withColumn("rule_id", F.col("step").cast("long")), mode).select("rule_id", "lhs", "n", "m", "freq", "level", "cost", "canon", "rhs_nodes", "rhs_edges")


def extract(edges: DataFrame, paths: DataFrame, mu: int = 4, kind: str = "mu_level", mode: str = "part") -> DataFrame:
    """The grammar of a connected graph along a dendrogram, by one of mu_random, mu_level, mu_dl, mu_level_dl, local_dl, global_dl."""
    if kind not in ("local_dl", "global_dl"):
        return dedupe(contraction.steps(edges, paths, mu, kind), mode)
    tree = load_tree(paths)
    return dedupe(rules_from_schedule(edges, tree, greedy_schedule(edges, tree, mu, kind), mode), mode)


def subtree_costs(edges: DataFrame, paths: DataFrame, tree: Tree, mu: int) -> dict[int, float]:
    """Rule cost of every tree node of at most mu leaves, all in one batch of aggregations."""
    from weft.operators.core import group_rules

    rows = []
    for t in tree.internal():
        stack, own = [t], []
        while stack and len(own) <= mu:
            x = stack.pop()
            if x in tree.leaf_id:
                own.append(tree.leaf_id[x])
            else:
                stack += tree.kids[x]
        if not stack and len(own) <= mu:
            rows += [(t, i) for i in own]
    if not rows:
        return {}
    # tree nodes nest, so they are batched by height: sets of one batch are disjoint
    spark, out = edges.sparkSession, {}
    by_level = defaultdict(list)
    for t, i in rows:
        by_level[tree.level[t]].append((t, i))
    for batch in by_level.values():
        got = group_rules(edges, spark.createDataFrame(batch, "grp bigint, id bigint")).select("grp", "cost").collect()  # one row per small tree node
        out |= {r.grp: r.cost for r in got}
    return out


#: The dl-greedy extractors rescore after every contraction; they hold the graph on the driver, for at most so many edges.
MOST_EDGES = 2_000_000


def greedy_schedule(edges: DataFrame, tree: Tree, mu: int, kind: str) -> list[tuple[int, list[int], int]]:
    """Order of contraction by the relative description length of what would be left plus the rule (checked size, on the driver).

    local: the tree node of best score; only ancestors of a contracted node are scored again. global: the record (an isomorphism class of
    right-hand sides) of best score by its last occurrence; all of its disjoint occurrences are contracted, then all is scored anew.

    A score is a function of counts of the whole graph, which are kept, and of a few of the tree node's own (``features``), which change only for
    ancestors of a contracted node and of its neighbours. So a step costs what it touches, and a global round one pass over arrays.
    """
    if edges.count() > MOST_EDGES:
        raise ValueError(f"{kind} is limited to {MOST_EDGES} edges")
    adj: dict[int, dict[int, int]] = defaultdict(dict)
    label: dict[int, int] = {}
    back = {v: k for k, v in tree.leaf_id.items()}
    for r in edges.filter("u <> v").collect():
        u, v = back[r.u], back[r.v]
        adj[u][v] = adj[v][u] = adj[u].get(v, 0) + r.w
    bits_of: dict[int, float] = {}

    def code(w: int) -> float:
        if w not in bits_of:
            bits_of[w] = 2 * _gamma(w + 1)
        return bits_of[w]

    order = sorted(tree.internal(), key=lambda t: (tree.level[t], t))
    seq = {t: i for i, t in enumerate(order)}
    size: dict[int, int] = {}  # leaves that a tree node has left
    for t in reversed(order):
        size[t] = sum(1 if c in tree.leaf_id else size[c] for c in tree.kids[t])
    above = {x: tree.parent.get(x) for x in tree.leaf_id}  # the tree node right above each node that is left
    stand: dict[int, int] = {}  # contracted tree node -> the node that stands for it
    done: set[int] = set()
    forms: dict[tuple, str] = {}
    n, m, plain, labelled = len(tree.leaf_id), 0, len(tree.leaf_id), 0
    weights: Counter[int] = Counter()
    for u, near in adj.items():
        for v, w in near.items():
            if u < v:
                m += 1
                weights[w] += 1

    #: Of each tree node that fits, only for global_dl: how often each weight crosses it, the nodes across with their weights, and how often each of these.
    held: dict[int, tuple[Counter, dict[int, int], Counter]] = {}

    def coded(counts: Counter) -> float:
        """Bits of weights that are counted, whatever the order in which they came."""
        return float(sum(c * code(w) for w, c in sorted(counts.items()) if c))

    def total() -> float:
        return coded(weights)

    def members(t: int) -> set[int]:
        own, stack = set(), [t]
        while stack:
            for c in tree.kids[stack.pop()]:
                if c in tree.leaf_id:
                    own.add(c)
                elif c in stand:
                    own.add(stand[c])
                else:
                    stack.append(c)
        return own

    def parts(s: set[int]):
        ins, bound, outer = [], [], defaultdict(int)
        bd = dict.fromkeys(s, 0)
        for u in s:
            for v, w in adj[u].items():
                if v in s:
                    if u < v:
                        ins.append((u, v, w))
                else:
                    bound.append(w)
                    outer[v] += w
                    bd[u] += w
        return ins, bound, outer, bd

    def features(t: int) -> tuple[tuple, str]:
        """(nodes, pairs and bits inside, pairs and bits across before and after, unlabelled nodes, rule cost), and the name of the record."""
        s = members(t)
        ins, bound, outer, bd = parts(s)
        lhs, inside = sum(bound), sum(code(w) for w in sorted(w for *_, w in ins))
        cost = _gamma(lhs + 1) + _dl(len(s), len(ins), inside, len({u in label for u in s})) + _gamma(2) + len(s) * _gamma(max(bd.values()) + 1)
        form = ""
        if kind == "global_dl":
            own = sorted(s)
            at = {u: i for i, u in enumerate(own)}
            shape = tuple(label.get(u) for u in own), tuple(sorted((at[u], at[v], w) for u, v, w in ins))
            if shape not in forms:
                forms[shape] = canonical_form([(i, x, 0) for i, x in enumerate(shape[0])], list(shape[1]))
            form = forms[shape]
        lines, ends = Counter(bound), Counter(outer.values())
        if kind == "global_dl":
            held[seq[t]] = lines, dict(outer), ends
        return (len(s), len(ins), inside, len(bound), coded(lines), len(outer), coded(ends), sum(u not in label for u in s), cost), f"{lhs}|{form}"

    def score(x: tuple, bits: float, now: float) -> float:
        k, mi, si, mb, sb, mo, so, p, cost = x
        n2, m2 = n - k + 1, m - mi - mb + mo
        kinds = 1 + (plain > p) if n2 > 1 else 1
        return (_dl(n2, m2, bits - si - sb + so, kinds) + cost) / now

    def contract(t: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
        """The node that stands for the contracted ones, and by the nodes across what joined them to these."""
        nonlocal n, m, plain, labelled
        s = members(t)
        ins, bound, outer, _ = parts(s)
        new = max(s)
        joined: dict[int, list[tuple[int, int]]] = {v: [] for v in outer}
        for u in s:
            for v, w in adj[u].items():
                if v not in s:
                    joined[v].append((u, w))
        for w in (*(w for *_, w in ins), *bound):
            weights[w] -= 1
            if not weights[w]:
                del weights[w]
        weights.update(outer.values())
        for u in s:
            for v in adj[u]:
                if v not in s:
                    adj[v].pop(u, None)
        for u in s:
            adj.pop(u, None)
            if u != new:
                above.pop(u, None)
        for v, w in outer.items():
            adj[new][v] = adj[v][new] = w
        own = sum(u not in label for u in s)
        n, m = n - len(s) + 1, m - len(ins) - len(bound) + len(outer)
        plain, labelled = plain - own, labelled - (len(s) - own) + 1
        label[new] = sum(bound)
        stack = [t]
        while stack:
            x = stack.pop()
            if x in done or x in tree.leaf_id:
                continue
            done.add(x)
            if kind == "global_dl":
                forget(seq[x])
                held.pop(seq[x], None)
            stack += tree.kids[x]
        steps.append((t, sorted(s), tree.level[t]))
        stand[t], above[new] = new, tree.parent.get(t)
        up = tree.parent.get(t)
        while up is not None:
            size[up] -= len(s) - 1
            up = tree.parent.get(up)
        return new, joined

    def small_above(t: int | None) -> Iterator[int]:
        while t is not None and size[t] <= mu:
            yield t
            t = tree.parent.get(t)

    kinds_now = lambda: (plain > 0) + (labelled > 0)
    steps: list[tuple[int, list[int], int]] = []
    if kind != "global_dl":
        bits = total()
        now = _dl(n, m, bits, kinds_now())
        heap = [(score(features(t)[0], bits, now), seq[t], 0, t) for t in order if size[t] <= mu]
        heapq.heapify(heap)
        version: Counter[int] = Counter()
        while tree.root not in done:
            # when nothing fits mu, the first tree node, which is the root, takes all that is left
            _, _, v, best = heapq.heappop(heap) if heap else (0, 0, 0, tree.root)
            if best in done or v != version[best] and best != tree.root:
                continue
            contract(best)
            bits = total()
            now = _dl(n, m, bits, kinds_now())
            for up in small_above(tree.parent.get(best)):
                version[up] += 1
                heapq.heappush(heap, (score(features(up)[0], bits, now), seq[up], version[up], up))
        return steps
    known, names, ids = np.zeros((len(order), 9)), [], {}
    record: dict[int, int] = {}  # of each tree node that fits, by its place in order
    found: list[set[int]] = []  # places of each record
    last, moved = np.full(1024, -1), set()  # the last place of each record stays; records whose places changed

    def forget(i: int) -> None:
        if (old := record.pop(i, None)) is not None:
            found[old].discard(i)
            moved.add(old)

    def learn(t: int) -> None:
        forget(seq[t])
        known[seq[t]], name = features(t)
        if name not in ids:
            ids[name] = len(names)
            names.append(name)
            found.append(set())
        record[seq[t]] = ids[name]
        found[ids[name]].add(seq[t])
        moved.add(ids[name])

    def redirect(i: int, new: int, lines: list[tuple[int, int]]) -> None:
        """One node's lines from a tree node to contracted ones become one line to the node that stands for them."""
        crossing, outer, ends = held[i]
        for u, w in [*((u, -w) for u, w in lines), (new, sum(w for _, w in lines))]:
            crossing[abs(w)] += 1 if w > 0 else -1
            before = outer.get(u, 0)
            if before:
                ends[before] -= 1
            if before + w:
                outer[u] = before + w
                ends[before + w] += 1
            else:
                del outer[u]

    def logs(x: np.ndarray) -> np.ndarray:
        some, at = np.unique(x, return_inverse=True)
        return np.array([math.log2(y) if y else 0.0 for y in some.tolist()])[at]

    for t in order:
        if size[t] <= mu:
            learn(t)
    while tree.root not in done:
        if len(names) > len(last):
            last = np.r_[last, np.full(len(names), -1)]
        for i in moved:
            last[i] = max(found[i], default=-1)
        moved.clear()
        some = np.flatnonzero(last >= 0)
        if not len(some):
            contract(tree.root)
            break
        k, mi, si, mb, sb, mo, so, p, cost = known[last[some]].T
        bits = total()
        n2, m2 = n - k + 1, m - mi - mb + mo
        lu = np.where((plain > p) & (n2 > 1), math.log2(3), 1.0)
        scores = (logs(n2) + n2 * lu + logs(m2) + lu * (bits - si - sb + so + n2 * n2 - 2 * m2) + cost) / _dl(n, m, bits, kinds_now())
        best = min(some[scores == scores.min()].tolist(), key=lambda i: names[i])
        taken: set[int] = set()
        stale: set[int] = set()
        beside: set[int] = set()
        for i in sorted(found[best]):
            t = order[i]
            if t not in done and not ((s := members(t)) & taken):
                taken |= s
                new, joined = contract(t)
                stale.update(small_above(tree.parent.get(t)))
                # beside a contracted node only the pairs across change
                for v, lines in joined.items():
                    for up in small_above(above.get(v)):
                        if up not in stale and seq[up] in held:
                            redirect(seq[up], new, lines)
                            beside.add(up)
        for t in sorted(stale - done):
            learn(t)
        for t in sorted(beside - stale - done):
            crossing, outer, ends = held[seq[t]]
            known[seq[t], 3:7] = crossing.total(), coded(crossing), len(outer), coded(ends)
    return steps


def chances(rules: dict[int, list[dict]]) -> dict[int, list[float]]:
    """Running shares of the frequencies of each boundary's rules; one uniform number picks a rule as ``Generator.choice`` does."""
    out = {}
    for k, choice in rules.items():
        p = np.array([r["freq"] for r in choice], float)
        c = (p / p.sum()).cumsum()
        out[k] = (c / c[-1]).tolist()
    return out


def closed(rules: dict[int, list[dict]]) -> bool:
    """Whether every rule's boundary degrees sum to its boundary, and every non-terminal has as many edges as its label, as extracted rules do. Then
    the order of a derivation follows from labels alone."""
    for lhs, choice in rules.items():
        for r in choice:
            edges = {x["node"]: x["b_deg"] for x in r["nodes"]}
            if sum(edges.values()) != lhs or any(a == b for a, b, _ in r["edges"]):
                return False
            for a, b, w in r["edges"]:
                edges[a] += w
                edges[b] += w
            if any(x["label"] is not None and edges[x["node"]] != x["label"] for x in r["nodes"]):
                return False
    return True


def derived_order(shapes: dict[int, list[tuple[int, list[int]]]], cum: dict[int, list[float]], upper: int, rng: np.random.Generator) -> int | None:
    """The number of nodes ``derive`` comes to with the same draws, without its edges, for rules that are ``closed``, each given by its number of
    nodes and the labels of its non-terminals."""
    opened, n = [0], 1
    pool: dict[int, list[int]] = {}
    while opened:
        if n > upper:
            return None
        i = int(rng.integers(len(opened)))
        opened[i], opened[-1] = opened[-1], opened[i]
        label = opened.pop()
        choice = shapes.get(label)
        if not choice:
            return None
        size, labels = choice[bisect.bisect_right(cum[label], rng.random())] if len(choice) > 1 else choice[0]
        if label > 1:
            rng.shuffle(pool.setdefault(label, [0] * label))  # as many draws as the broken edges take
        opened += labels
        n += size - 1
    return n


def derive(rules: dict[int, list[dict]], upper: int, rng: np.random.Generator, mode: str = "part", cum: dict[int, list[float]] | None = None) -> tuple[list[tuple[int, int, int]], list[int], int] | None:
    """One random derivation: (edges, fired rule ids, nodes), or None when it outgrows ``upper`` nodes or meets a boundary no rule has.

    part: broken edges go to right-hand side nodes by their boundary degrees. no: without that information, to any of them (a non-terminal
    then may get another number of edges than its label; the derivation goes on with the rules of its label's size).
    """
    cum = chances(rules) if cum is None else cum
    label: dict[int, int] = {0: 0}
    adj: dict[int, dict[int, int]] = {0: {}}
    opened, counter, fired = [0], 1, []
    while opened:
        if len(adj) > upper:
            return None
        i = int(rng.integers(len(opened)))
        opened[i], opened[-1] = opened[-1], opened[i]
        x = opened.pop()
        choice = rules.get(label[x])
        if not choice:
            return None
        r = choice[bisect.bisect_right(cum[label[x]], rng.random())] if len(choice) > 1 else choice[0]
        fired.append(r["rule_id"])
        broken = [v for v, w in adj.pop(x).items() for _ in range(w)]
        for v in set(broken):
            adj[v].pop(x, None)
        rng.shuffle(broken)
        at = {}
        for n in r["nodes"]:
            at[n["node"]] = counter
            adj[counter] = {}
            if n["label"] is not None:
                label[counter] = n["label"]
                opened.append(counter)
            counter += 1
        if mode == "no":
            inside = list(at.values())
            for v in broken:
                u = inside[int(rng.integers(len(inside)))]
                adj[u][v] = adj[v][u] = adj[u].get(v, 0) + 1
            broken = []
        k = 0
        for n in r["nodes"]:
            for v in broken[k : k + n["b_deg"]]:
                u = at[n["node"]]
                adj[u][v] = adj[v][u] = adj[u].get(v, 0) + 1
            k += n["b_deg"]
        for a, b, w in r["edges"]:
            u, v = at[a], at[b]
            adj[u][v] = adj[v][u] = adj[u].get(v, 0) + w
    return [(u, v, w) for u, x in adj.items() for v, w in x.items() if u <= v], fired, len(adj)


def generate(rules: DataFrame, target: int, graphs: int = 1, tolerance: float = 0.05, trials: int = 1_000, seed: int = 0, mode: str = "part") -> DataFrame:
    """(graph, trial, n, u, v, w, rules): for each wanted graph the first trial whose order is within the tolerance; a graph that none of its
    trials fits is one row whose other columns are null.

    Trials are numbered and independent, so they run anywhere and a repeated one gives the same graph. Rounds of trials, each round twice as many,
    are dealt over the cluster and only say which trials fit; the first fit of each graph is derived in full after that. The grammar is sent with the
    function: a rule has at most a right-hand side of nodes, and isomorphic ones are merged. An over-large derivation counts as a trial.
    """
    by: dict[int, list[dict]] = defaultdict(list)
    for r in rules.select("rule_id", "lhs", "freq", "rhs_nodes", "rhs_edges").orderBy("lhs", "rule_id").collect():
        by[r.lhs].append({"rule_id": r.rule_id, "freq": r.freq, "nodes": [{"node": x.node, "label": x.label, "b_deg": x.b_deg} for x in r.rhs_nodes], "edges": [(x.a, x.b, x.w) for x in r.rhs_edges]})
    low, high = target * (1 - tolerance), target * (1 + tolerance)

    spark, cum = rules.sparkSession, chances(by)
    shapes = {k: [(len(r["nodes"]), [x["label"] for x in r["nodes"] if x["label"] is not None]) for r in x] for k, x in by.items()} if mode == "part" and closed(by) else None
    draws = lambda g, t: np.random.default_rng([seed, int(g), int(t)])

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, t in zip(b["graph"], b["trial"], strict=True):
                if shapes is None:
                    got = derive(by, int(high), draws(g, t), mode, cum)
                    n = got and got[2]
                else:
                    n = derived_order(shapes, cum, int(high), draws(g, t))
                if n and low <= n <= high:
                    yield pd.DataFrame({"graph": [g], "trial": [t]})

    first: dict[int, int] = {}
    begin, size, tasks = 0, 8, spark.sparkContext.defaultParallelism
    while begin < trials and len(first) < graphs:
        todo, size = [g for g in range(graphs) if g not in first], min(size, trials - begin)
        cells = spark.range(0, len(todo) * size, 1, min(len(todo) * size, 4 * tasks)).select(F.element_at(F.lit(todo), (F.col("id") % len(todo) + 1).cast("int")).cast("bigint").alias("graph"), (F.floor(F.col("id") / len(todo)) + begin).cast("int").alias("trial"))
        first |= {r.graph: r.trial for r in cells.mapInPandas(fits, "graph bigint, trial int").groupBy("graph").agg(F.min("trial").alias("trial")).collect()}  # a row a graph
        begin, size = begin + size, 2 * size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g in b["id"]:
                if g in first:
                    e, fired, n = derive(by, int(high), draws(g, first[g]), mode, cum)  # type: ignore[misc]
                    yield pd.DataFrame({"graph": int(g), "trial": first[g], "n": n, "u": [x[0] for x in e], "v": [x[1] for x in e], "w": [x[2] for x in e], "rules": [fired if i == 0 else None for i in range(len(e))]})
                else:
                    yield pd.DataFrame({"graph": [int(g)], "trial": [None], "n": [None], "u": [None], "v": [None], "w": [None], "rules": [None]})

    return spark.range(graphs).repartition(min(graphs, 1024), "id").mapInPandas(run, "graph bigint, trial int, n bigint, u bigint, v bigint, w bigint, rules array<bigint>")


def contract_iso(rules: DataFrame) -> DataFrame:
    """Right-hand sides as used with full boundary information: boundary nodes outside the subtree that touch only one inside node become one
    node ``iso``. Takes (rule_id, rhs_edges) whose nodes below ``inside`` are internal; returns (rule_id, a, b, w) with iso as -1."""
    e = rules.select("rule_id", "inside", F.explode("rhs_edges").alias("x")).select("rule_id", "inside", "x.*")
    ends = e.select("rule_id", "inside", F.explode(F.array("a", "b")).alias("node")).groupBy("rule_id", "inside", "node").agg(F.count(F.lit(1)).alias("d"))
    lone = ends.filter("node >= inside AND d = 1").select("rule_id", "node", F.lit(-1).alias("to"))
    a, b = lone.toDF("rule_id", "a", "ta"), lone.toDF("rule_id", "b", "tb")
    return e.join(a, ["rule_id", "a"], "left").join(b, ["rule_id", "b"], "left").select("rule_id", F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "w").groupBy("rule_id", "a", "b").agg(F.sum("w").alias("w"))


def full_rules(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(rule_id, inside, rhs_edges) of disjoint node sets (grp, id) with their boundary edges kept: inside nodes are numbered from 0 within the
    set, outside ones after them."""
    from pyspark.sql import Window

    a, b = groups.toDF("ga", "u"), groups.toDF("gb", "v")
    e = edges.join(a, "u", "left").join(b, "v", "left").filter("ga IS NOT NULL OR gb IS NOT NULL")
    each = e.select(F.explode(F.array_distinct(F.array("ga", "gb"))).alias("grp"), "u", "v", "w", "ga", "gb").filter("grp IS NOT NULL")
    own = groups.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1)
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("inside"))
    out = each.select("grp", F.explode(F.array(F.when(~F.coalesce(F.col("ga") == F.col("grp"), F.lit(False)), F.col("u")), F.when(~F.coalesce(F.col("gb") == F.col("grp"), F.lit(False)), F.col("v")))).alias("id")).filter("id IS NOT NULL").distinct()
    out = out.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1).join(size, "grp").select("grp", "id", (F.col("k") + F.col("inside")).alias("k"))
    names = own.select("grp", "id", "k").union(out)
    x = each.join(names.toDF("grp", "u", "a"), ["grp", "u"]).join(names.toDF("grp", "v", "b"), ["grp", "v"])
    return x.join(size, "grp").groupBy(F.col("grp").alias("rule_id"), "inside").agg(F.array_sort(F.collect_list(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"))).alias("rhs_edges"))
