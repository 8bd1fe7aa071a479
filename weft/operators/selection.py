"""Selection of structures for a summary, without cells: what a structure adds is counted by classes of nodes and by edges.

A structure says something of every pair of its nodes. Which cells earlier structures have covered, and what they said first, follows for a pair of
nodes from the structures that both are in; so nodes that are in the same earlier structures, in the same roles, form a class, and all cells between
two classes are alike. Spark counts the nodes of each class and the edges between classes for every structure, and one row a structure
goes, in order, through a fold that holds a few totals and the list of structures kept. A star of any number of spokes is a class or two.

The order is worked off in blocks of structures; only those that were kept in earlier blocks, and those of the block itself, take part in its joins.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.rest import cut
from weft.operators.summary import _lg, _ln, _lu, _rate, model_prefix_bits

#: Structures of the first block; each block is four times the one before.
BLOCK = 4_096


def ordered(structures: DataFrame, *by: Column) -> DataFrame:
    """``structures`` with ``rank`` from 0 in an order: ranges are numbered within, and shifted by the rows before them."""
    ranged = cut(structures.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a range
    at = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    return ranged.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + at - 1).drop("range", "before")


def members(ranked: DataFrame) -> DataFrame:
    """(rank, id, role): the nodes of each structure. Roles: a chain's places, 1 for spokes and the second side, else 0."""
    both = F.concat(
        F.transform(F.coalesce("nodes1", F.array().cast("array<bigint>")), lambda x, i: F.struct(x.alias("id"), F.when(F.col("code") == "ch", i).otherwise(0).cast("int").alias("role"))),
        F.transform(F.when(F.col("code").isin("st", "bc", "nb"), F.col("nodes2")).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("id"), F.lit(1).alias("role"))),
    )
    return ranked.select("rank", F.explode(both).alias("x")).select("rank", "x.id", "x.role")


def _counts(edges: DataFrame, parts: DataFrame, low: int, high: int, kept: list[int]) -> DataFrame:
    """(rank, classes, links) of the structures from ``low`` to before ``high``: nodes by (role, earlier structures with roles), edges by pairs of those."""
    spark = parts.sparkSession
    own = parts.filter((F.col("rank") >= low) & (F.col("rank") < high))
    if kept:
        own = own.union(parts.join(spark.createDataFrame([(k,) for k in kept], "rank long"), "rank", "left_semi").select(own.columns))
    held = cut(own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "role"))).alias("in")), "held")
    key = lambda c, rank: F.filter(c, lambda x: x["rank"] < F.col(rank))
    role = lambda c, rank: F.get(F.filter(c, lambda x: x["rank"] == F.col(rank)), F.lit(0))["role"]
    now = lambda c: F.filter(F.transform(c, lambda x: x["rank"]), lambda r: r >= low)
    nodes = held.select("in", F.explode(now("in")).alias("rank")).select("rank", F.struct(role("in", "rank").alias("role"), key("in", "rank").alias("key")).alias("c"))
    classes = nodes.groupBy("rank", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("rank").agg(F.collect_list(F.struct("c.role", "c.key", "n")).alias("classes"))
    ends = edges.join(held.toDF("u", "a"), "u").join(held.toDF("v", "b"), "v").select("a", "b", F.explode(F.array_intersect(now("a"), now("b"))).alias("rank"))
    at = lambda c: F.struct(role(c, "rank").alias("role"), key(c, "rank").alias("key"))
    pairs = ends.select("rank", at("a").alias("a"), at("b").alias("b")).groupBy("rank", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    links = pairs.groupBy("rank").agg(F.collect_list(F.struct("a", "b", "n")).alias("links"))
    return classes.join(links, "rank", "left")


def _says(code: str, a: int, b: int) -> int | None:
    """What a structure says of the cells between two roles: 1 an edge, 0 none, None whatever the graph has."""
    if code == "nc" or code == "nb" and a != b:
        return None
    if code == "fc":
        return 1
    return int(abs(a - b) == 1) if code == "ch" else int(a != b)


class Totals:
    """Counts of cells under the structures kept so far, and the bits of the whole description."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.covered = self.exact = self.wrong = 0
        self.missed, self.model = m, 0.0
        self.kinds: Counter[str] = Counter()
        self.kept: dict[int, str] = {}

    def error_bits(self, covered: int | None = None, exact: int | None = None, wrong: int | None = None, missed: int | None = None) -> float:
        cov, ex, wr, mi = (y if x is None else x for x, y in ((covered, self.covered), (exact, self.exact), (wrong, self.wrong), (missed, self.missed)))
        cells = self.n * (self.n - 1) // 2
        head = (np.log2(cov) if cov else 0.0) + (np.log2(cells - cov) if cells > cov else 0.0)
        return float(head + _rate(cov - ex, wr) + _rate(cells - cov, mi))

    def bits(self) -> float:
        return model_prefix_bits(self.kinds) + self.model + self.error_bits()

    def added(self, row) -> tuple[int, int, int, int, float]:
        """What a structure adds to covered, exact, wrong and missed, and its own bits, from its classes and links."""
        code, links = row.code, row.links or []
        inside: Counter[int] = Counter()
        for c in row.classes:
            for r, _ in c.key:
                if r in self.kept:
                    inside[r] += c.n
        # a structure that shares one node shares no cell
        short = lambda c: (c.role, tuple((r, x) for r, x in c.key if inside[r] > 1))
        size: Counter[tuple] = Counter()
        for c in row.classes:
            size[short(c)] += c.n
        edges: Counter[tuple] = Counter()
        of: Counter[int | None] = Counter()  # edges by what the structure says there
        for x in links:
            a, b = sorted((short(x.a), short(x.b)))
            edges[a, b] += x.n
            of[_says(code, a[0], b[0])] += x.n
        roles: Counter[int] = Counter()
        for (role, _), k in size.items():
            roles[role] += k
        s, total = roles[0], sum(roles.values())
        t, cells = roles[1], total * (total - 1) // 2
        if code == "ch":
            say = Counter({1: max(0, total - 1), 0: cells - max(0, total - 1)})
        elif code in ("fc", "nc"):
            say = Counter({_says(code, 0, 0): cells})
        else:
            say = Counter({_says(code, 0, 1): s * t, 0: cells - s * t})
        cov, exact, wrong, missed = cells, say[None], say[1] - of[1] + of[0], -sum(of.values())
        # cells between classes that share an earlier structure aren't new
        by = defaultdict(list)
        for c in size:
            for r, _ in c[1]:
                by[r].append(c)
        shared = {(a, b) for own in by.values() for a, b in combinations_with_replacement(sorted(own), 2)}
        for a, b in shared:
            k = size[a] * (size[a] - 1) // 2 if a == b else size[a] * size[b]
            if not k:
                continue
            m, other = edges[a, b], dict(b[1])
            both = [(r, _says(self.kept[r], x, other[r])) for r, x in a[1] if r in other]
            known, now = any(v is None for _, v in both), _says(code, a[0], b[0])
            cov, missed = cov - k, missed + m
            if now is not None:
                wrong -= k - m if now else m
            elif known:
                exact -= k
            else:
                wrong -= k - m if min(both)[1] else m
        pairs = cells if code == "nc" else s * t
        near = float(np.log2(pairs) + _rate(pairs, of[None])) if code in ("nc", "nb") and pairs else 0.0
        if code in ("fc", "nc"):
            own = _ln(total) + _lu(self.n, total)
        elif code == "st":
            own = _ln(t) + np.log2(self.n) + _lu(self.n - 1, t)
        elif code == "ch":
            own = _ln(max(1, total - 1)) + _lu(self.n, total) + _lg(total)
        else:
            own = _ln(s) + _ln(t) + _lu(self.n, s) + _lu(self.n - s, t)
        return cov, exact, wrong, missed, float(own + near)

    def try_(self, row, always: bool) -> bool:
        """Keep a structure if the whole description doesn't grow, or always."""
        cov, exact, wrong, missed, own = self.added(row)
        kinds = self.kinds + Counter([row.code])
        total = model_prefix_bits(kinds) + self.model + own + self.error_bits(self.covered + cov, self.exact + exact, self.wrong + wrong, self.missed + missed)
        if not always and total > self.bits():
            return False
        self.covered, self.exact, self.wrong, self.missed = self.covered + cov, self.exact + exact, self.wrong + wrong, self.missed + missed
        self.kinds, self.model = kinds, self.model + own
        self.kept[row.rank] = row.code
        return True


def fold(edges: DataFrame, structures: DataFrame, *by: Column, always: bool = False, block: int = BLOCK) -> Iterator[tuple[int, object, bool, Totals]]:
    """(rank, row, kept, totals after it) of all structures in order; the driver holds one row at a time, and the ranks of those kept."""
    pairs = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    n = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().count()
    ranked = cut(ordered(structures.select("sid", "code", "nodes1", "nodes2", *[c for c in ("saved",) if c in structures.columns]), *by), "order")
    parts = cut(members(ranked).groupBy("rank", "id").agg(F.min("role").alias("role")), "members")
    totals, low, high, rows = Totals(n, pairs.count()), 0, block, ranked.count()
    yield -1, None, False, totals
    loops = pairs.filter("u <> v")
    while low < rows:
        got = _counts(loops, parts, low, high, list(totals.kept))
        head = ranked.filter((F.col("rank") >= low) & (F.col("rank") < high)).select("rank", "sid", "code")
        todo = cut(head.join(got, "rank", "left").withColumn("classes", F.coalesce("classes", F.array().cast(got.schema["classes"].dataType))).orderBy("rank"), "todo")
        for r in todo.orderBy("rank").toLocalIterator():
            yield r.rank, r, totals.try_(r, always), totals
        low, high = high, high + 4 * (high - low)


def greedy(edges: DataFrame, structures: DataFrame) -> DataFrame:
    """(sid, total): structures kept, in order of the bits they save, when the total description does not grow."""
    spark = edges.sparkSession
    kept = [(r.sid, float(t.bits())) for _, r, yes, t in fold(edges, structures, F.desc("saved"), F.asc("sid")) if yes]
    return spark.createDataFrame(kept, "sid bigint, total double")


def cost_curve(edges: DataFrame, structures: DataFrame) -> DataFrame:
    """(k, sid, total): bits of the whole description with the first k structures, for every prefix in order of bits saved."""
    out = [(k + 1, r and r.sid, float(t.bits())) for k, r, _, t in fold(edges, structures, F.desc("saved"), F.asc("sid"), always=True)]
    return edges.sparkSession.createDataFrame(out, "k int, sid bigint, total double")


def score(edges: DataFrame, structures: DataFrame) -> DataFrame:
    """(model, total, model_bits, error_bits, wrong, covered, missed, uncovered, exact) of the empty model M_0 and of the given one, M_x, in order of
    sid."""

    def row(name: str, t: Totals) -> tuple:
        bits, err = float(model_prefix_bits(t.kinds) + t.model), t.error_bits()
        return name, bits + err, bits, err, t.wrong, t.covered, t.missed, t.n * (t.n - 1) // 2 - t.covered, t.exact

    out = []
    for k, _, _, t in fold(edges, structures, F.asc("sid"), always=True):
        if k < 0:
            out.append(row("M_0", t))
    out.append(row("M_x", t))
    return edges.sparkSession.createDataFrame(out, "model string, total double, model_bits double, error_bits double, wrong long, covered long, missed long, uncovered long, exact long")
