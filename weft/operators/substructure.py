"""Substructures of labelled graphs: instances, extension, pattern matching, evaluation, compression and beam search.

Vertices are (vid, label, example), edges (eid, v1, v2, label, directed). An instance is a set of vertices and edges; instances of one
substructure share a canonical string of their labelled graph.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import mdl
from weft.operators.forms import least_order
from weft.operators.rest import cut


def prune(v: DataFrame, e: DataFrame, vertex_labels: list[str] = (), edge_labels: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Drop vertices and edges of the given labels (with the edges of dropped vertices), then vertices left without an edge."""
    kept = v.filter(~F.col("label").isin(list(vertex_labels))) if vertex_labels else v
    own = e.filter(~F.col("label").isin(list(edge_labels))) if edge_labels else e
    own = own.join(kept.select(F.col("vid").alias("v1")), "v1", "left_semi").join(kept.select(F.col("vid").alias("v2")), "v2", "left_semi").select("v1", "v2", "label", "directed")
    ends = own.select(F.explode(F.array("v1", "v2")).alias("vid")).distinct()
    return kept.join(ends, "vid", "left_semi"), own


def with_ids(e: DataFrame) -> DataFrame:
    """Edges with an eid that depends on the edge alone (repeated edges get the same id and are one edge)."""
    return e.withColumn("eid", F.xxhash64("v1", "v2", "label", "directed")).dropDuplicates(["eid"])


def initial(v: DataFrame, least: int = 2) -> DataFrame:
    """(label, instances, examples): one substructure per vertex label with at least two instances."""
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("example").alias("examples")).filter(F.col("instances") >= least)


def one_edge(v: DataFrame, e: DataFrame) -> DataFrame:
    """(l1, edge, directed, l2, instances, examples): all one-edge substructures; ends of undirected edges in label order."""
    a, b = v.select(F.col("vid").alias("v1"), F.col("label").alias("l1"), "example"), v.select(F.col("vid").alias("v2"), F.col("label").alias("l2"))
    x = e.select("v1", "v2", F.col("label").alias("edge"), "directed").join(a, "v1").join(b, "v2")
    swap = ~F.col("directed") & (F.col("l1") > F.col("l2"))
    x = x.select(F.when(swap, F.col("l2")).otherwise(F.col("l1")).alias("l1"), "edge", "directed", F.when(swap, F.col("l1")).otherwise(F.col("l2")).alias("l2"), "example")
    return x.groupBy("l1", "edge", "directed", "l2").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("example").alias("examples"))


def find_instances(v: DataFrame, e: DataFrame, pattern_vertices: list[str], pattern_edges: list[tuple[int, int, str, bool]], same: Callable[[Column, str], Column] = operator.eq) -> DataFrame:
    """(vs): injective matches of a connected labelled pattern, vs[i] the vertex of pattern vertex i.

    ``same`` says whether a label of the graph matches one of the pattern: equality, or any other condition (tolerance, prefix, a set).

    The pattern is compiled into one equi-join per edge, from its first vertex outwards; automorphic matches are all listed.
    """
    out = v.filter(same(F.col("label"), pattern_vertices[0])).select(F.col("vid").alias("p0"))
    bound, left = {0}, list(pattern_edges)
    while left:
        i = next((k for k, x in enumerate(left) if x[0] in bound or x[1] in bound), None)
        if i is None:
            raise ValueError("the pattern isn't connected")
        a, b, label, directed = left.pop(i)
        own = e.filter(same(F.col("label"), label) & (F.col("directed") == directed)).select(F.col("v1").alias("s"), F.col("v2").alias("t"))
        if same is not operator.eq:
            own = own.distinct()  # several labels of one pair may match
        if not directed:
            own = own.union(own.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct()
        if a in bound and b in bound:
            out = out.join(own.select(F.col("s").alias(f"p{a}"), F.col("t").alias(f"p{b}")).distinct(), [f"p{a}", f"p{b}"], "left_semi")
            continue
        old, new = (a, b) if a in bound else (b, a)
        side = own.select(F.col("s" if old == a else "t").alias(f"p{old}"), F.col("t" if old == a else "s").alias(f"p{new}"))
        fresh = v.filter(same(F.col("label"), pattern_vertices[new])).select(F.col("vid").alias(f"p{new}"))
        out = out.join(side.join(fresh, f"p{new}", "left_semi"), f"p{old}")
        for k in bound:
            out = out.filter(F.col(f"p{k}") != F.col(f"p{new}"))
        bound.add(new)
    return out.select(F.array(*[F.col(f"p{i}") for i in range(len(pattern_vertices))]).alias("vs"))


def canonical(labels: list[str], edges: list[tuple[int, int, str, bool]]) -> str:
    """A string that labelled graphs share iff they are isomorphic: labels and edges in a least order of the vertices."""
    n = len(labels)
    rel: list[list[list[tuple[str, int]]]] = [[[] for _ in range(n)] for _ in range(n)]
    for a, b, label, directed in edges:
        rel[a][b].append((label, 1 if directed else 0))
        if a != b:
            rel[b][a].append((label, -1 if directed else 0))
    order = least_order(labels, [[sorted(x) for x in row] for row in rel])
    at = {v: i for i, v in enumerate(order)}
    rows = sorted((at[a], at[b], lab, 1) if d else (min(at[a], at[b]), max(at[a], at[b]), lab, 0) for a, b, lab, d in edges)
    return "|".join(_escaped(labels[i]) for i in order) + "#" + ";".join(f"{a}{'>' if d else '-'}{b}:{_escaped(lab)}" for a, b, lab, d in rows)


def _escaped(label: str) -> str:
    """A label whose marks of the canonical string (and backslashes) stand behind a backslash."""
    return re.sub(r"([\\|#;])", r"\\\1", label)


def parse(canon: str) -> tuple[list[str], list[tuple[int, int, str, bool]]]:
    """Labels and edges of a canonical string."""
    parts: list[list[str]] = [[""], []]
    side, at = 0, 0
    while at < len(canon):
        c = canon[at]
        if c == "\\":
            at += 1
            parts[side][-1] += canon[at]
        elif c == "#":
            side, parts[1] = 1, [""]
        elif c == ("|", ";")[side]:
            parts[side].append("")
        else:
            parts[side][-1] += c
        at += 1
    edges = []
    for x in filter(None, parts[1]):
        a, mark, b, label = re.match(r"(\d+)([>-])(\d+):(.*)", x, re.S).groups()
        edges.append((int(a), int(b), label, mark == ">"))
    return parts[0], edges


def with_labels(v: DataFrame, e: DataFrame) -> DataFrame:
    """Edges with the labels of their ends (l1, l2)."""
    return e.join(v.select(F.col("vid").alias("v1"), F.col("label").alias("l1")), "v1").join(v.select(F.col("vid").alias("v2"), F.col("label").alias("l2")), "v2")


def instances_of(le: DataFrame, canon: str, fresh: Column | None = None) -> DataFrame:
    """(canon, vs, es, arrival): all instances of a pattern with edges, each set of vertices and edges once.

    ``le`` has edges (eid, v1, v2, label, directed) with their ends' labels (see ``with_labels``) and the ``batch`` they came in; an instance arrives
    with its last edge. With ``fresh``, a condition on edges, only instances with such an edge are found: the joins start from those
    edges, once for each edge of the pattern, so the work follows the new edges and their surroundings, not the whole graph.
    """
    labels, edges = parse(canon)
    if not edges:
        raise ValueError("the pattern has no edge")

    def side(k: int, rows: DataFrame) -> DataFrame:
        a, b, label, directed = edges[k]
        own = rows.filter((F.col("label") == label) & (F.col("directed") == directed))
        to = lambda s, t: own.filter((F.col(f"l{s}") == labels[a]) & (F.col(f"l{t}") == labels[b])).select(F.col(f"v{s}").alias("s"), F.col(f"v{t}").alias("t"), F.col("eid").alias(f"e{k}"), F.col("batch").alias(f"b{k}"))
        both = to(1, 2) if directed else to(1, 2).union(to(2, 1).filter("s <> t"))
        if a == b:
            return both.filter("s = t").select(F.col("s").alias(f"p{a}"), f"e{k}", f"b{k}")
        return both.filter("s <> t").select(F.col("s").alias(f"p{a}"), F.col("t").alias(f"p{b}"), f"e{k}", f"b{k}")

    def grown(first: int, rows: DataFrame) -> DataFrame:
        out, bound, done, left = side(first, rows), {*edges[first][:2]}, [first], [k for k in range(len(edges)) if k != first]
        while left:
            k = next((x for x in left if bound & {*edges[x][:2]}), None)
            if k is None:
                raise ValueError("the pattern isn't connected")
            left.remove(k)
            ends = {*edges[k][:2]}
            out = out.join(side(k, le), [f"p{x}" for x in sorted(ends & bound)])
            for new in ends - bound:
                for x in bound:
                    out = out.filter(F.col(f"p{x}") != F.col(f"p{new}"))
            for x in done:
                if edges[x][2:] == edges[k][2:]:
                    out = out.filter(F.col(f"e{x}") != F.col(f"e{k}"))
            bound, done = bound | ends, [*done, k]
        every = lambda c, n: [F.col(f"{c}{i}") for i in range(n)]
        last = F.greatest(*every("b", len(edges))) if len(edges) > 1 else F.col("b0")
        return out.select(F.lit(canon).alias("canon"), F.array_sort(F.array(*every("p", len(labels)))).alias("vs"), F.array_sort(F.array(*every("e", len(edges)))).alias("es"), last.alias("arrival"))

    if fresh is None:
        return grown(0, le).distinct()
    out = None
    for k in range(len(edges)):
        part = grown(k, le.filter(fresh))
        out = part if out is None else out.union(part)
    return out.distinct()


def extend(instances: DataFrame, v: DataFrame, e: DataFrame, least: str | None = None) -> DataFrame:
    """Instances grown by one edge in every way: (vs, es, canon). Each grown set of edges is kept once, with the smallest of the column ``least``
    of those that it grew from, if one is named."""
    carry = [least] if least else []
    x = instances.select("vs", "es", *carry, F.explode("vs").alias("at"))
    both = e.select(F.col("v1").alias("at"), "eid", "v1", "v2").union(e.select(F.col("v2").alias("at"), "eid", "v1", "v2"))
    grown = x.join(both, "at").filter(~F.array_contains("es", F.col("eid"))).select(F.array_sort(F.array_union("vs", F.array("v1", "v2"))).alias("vs"), F.array_sort(F.concat("es", F.array("eid"))).alias("es"), *carry)
    grown = grown.groupBy("vs", "es").agg(F.min(least).alias(least)) if least else grown.distinct()
    return with_canon(grown, v, e)


def with_canon(instances: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    """Add the canonical string: labels come by joins, the string from a vectorised function with a memo over equal labelled graphs."""
    i = cut(instances.withColumn("iid", F.xxhash64("vs", "es")), "inst")
    lv = i.select("iid", F.explode("vs").alias("vid")).join(v.select("vid", "label"), "vid").groupBy("iid").agg(F.collect_list(F.struct("vid", "label")).alias("lv"))
    le = i.select("iid", F.explode("es").alias("eid")).join(e.select("eid", "v1", "v2", "label", "directed"), "eid").groupBy("iid").agg(F.collect_list(F.struct("v1", "v2", "label", "directed")).alias("le"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple, str] = {}
        for b in batches:
            forms = []
            for vs, es in zip(b["lv"], b["le"], strict=True):
                ids = {x["vid"]: k for k, x in enumerate(sorted(vs, key=lambda x: (x["label"], x["vid"])))}
                labels = tuple(x["label"] for x in sorted(vs, key=lambda x: (x["label"], x["vid"])))
                key = (labels, tuple(sorted((ids[x["v1"]], ids[x["v2"]], x["label"], bool(x["directed"])) for x in es)))
                if key not in memo:
                    memo[key] = canonical(list(labels), list(key[1]))
                forms.append(memo[key])
            yield pd.DataFrame({"iid": b["iid"], "canon": forms})

    forms = lv.join(le, "iid").mapInPandas(run, "iid bigint, canon string")
    return i.join(forms, "iid").select(*instances.columns, "canon")


def disjoint(instances: DataFrame, first: Column | None = None) -> DataFrame:
    """A maximal set of instances per substructure without a shared vertex, in the order of their vertices and edges as text, or of the number
    ``first`` (not below 0) and then those.

    Rounds of "no earlier rival": an instance stays if it is the first of all live ones at each of its vertices, and its rivals leave; this gives
    the same set as going through them one by one, and a popular vertex is only the key of a partial minimum.
    """
    name = F.to_json(F.struct("vs", "es"))
    live = cut(instances.select("canon", "vs", "es", (name if first is None else F.concat(F.lpad(first.cast("string"), 19, "0"), name)).alias("iid")), "dj")
    out = None
    while True:
        x = live.select("canon", "iid", F.explode("vs").alias("vid"))
        first = x.groupBy("canon", "vid").agg(F.min("iid").alias("first"))
        y = x.join(first, ["canon", "vid"])
        stay = y.groupBy("canon", "iid").agg(F.min((F.col("iid") == F.col("first")).cast("int")).alias("ok")).filter("ok = 1").select("canon", "iid")
        stay = cut(live.join(stay, ["canon", "iid"], "left_semi"), "dj")
        if not stay.limit(1).count():
            return out.select("canon", "vs", "es") if out is not None else live.select("canon", "vs", "es")
        out = stay if out is None else out.union(stay)
        used = stay.select("canon", F.explode("vs").alias("vid")).distinct()
        hit = x.join(used, ["canon", "vid"], "left_semi").select("canon", "iid").distinct()
        live = cut(live.join(hit, ["canon", "iid"], "left_anti"), "dj")


def covered(instances: DataFrame) -> DataFrame:
    """(canon, n, m, instances, vertices, edges): pattern size, number of instances, and distinct vertices and edges in any of them."""
    g = instances.groupBy("canon").agg(F.count(F.lit(1)).alias("instances"), F.max(F.size("vs")).alias("n"), F.max(F.size("es")).alias("m"))
    count = lambda c: instances.select("canon", F.explode_outer(c).alias("x")).distinct().groupBy("canon").agg(F.count("x").alias("k"))
    return g.join(count("vs").withColumnRenamed("k", "vertices"), "canon").join(count("es").withColumnRenamed("k", "edges"), "canon")


def overlap_edges(instances: DataFrame, e: DataFrame) -> DataFrame:
    """(canon, extra): edges that compression adds where instances share vertices: an OVERLAP edge from the first instance at the vertex to each
    other one (a pair once), and a copy for each of those of every edge at the vertex that is in no instance."""
    at = cut(instances.select("canon", F.struct("vs", "es").alias("iid"), F.explode("vs").alias("vid")), "at")
    first = at.groupBy("canon", "vid").agg(F.min("iid").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    pairs = at.join(first, ["canon", "vid"]).filter(F.col("iid") != F.col("first")).select("canon", "first", "iid").distinct().groupBy("canon").agg(F.count(F.lit(1)).alias("pairs"))
    ends = e.select(F.col("v1").alias("vid"), "eid").union(e.filter("v1 <> v2").select(F.col("v2").alias("vid"), "eid"))
    used = instances.select("canon", F.explode("es").alias("eid")).distinct()
    copies = first.join(ends, "vid").join(used, ["canon", "eid"], "left_anti").groupBy("canon").agg(F.sum(F.col("k") - 1).alias("copies"))
    return pairs.join(copies, "canon", "left").select("canon", (F.col("pairs") + F.coalesce("copies", F.lit(0))).alias("extra"))


def compressed_size(instances: DataFrame, v: DataFrame, e: DataFrame, overlap: bool) -> DataFrame:
    """(canon, n, m, instances, size): vertices and edges of the graph once every instance is one vertex."""
    c = covered(instances)
    if overlap:
        c = c.join(overlap_edges(instances, e), "canon", "left")
    extra = F.coalesce("extra", F.lit(0)) if overlap else F.lit(0)
    return c.select("canon", "n", "m", "instances", (F.lit(v.count() + e.count()) + F.col("instances") - F.col("vertices") - F.col("edges") + extra).alias("size"))


def _bits(vv, ee, kk, b, mm, rb, labels: int):
    """Description length of a labelled graph from its counts, see ``graph_mdl``."""
    lg = math.log2(max(1, labels))
    return F.log2(F.greatest(vv, F.lit(1))) + vv * lg + (vv + 1) * F.log2(b + 1) + rb + ee * (1 + lg) + (kk + 1) * F.log2(F.greatest(mm, F.lit(1)))


def compressed_bits(instances: DataFrame, v: DataFrame, e: DataFrame, labels: int) -> DataFrame:
    """(canon, n, m, instances, bits): description length of the graph once every one of the disjoint instances is one vertex, with the bits
    that say where outer edges meet an instance.

    Only rows of the adjacency matrix that an instance touches are counted anew; all others come from histograms of the whole graph (a row per
    distinct count), so no compressed graph is written. Instances stand first in the order of vertices.
    """
    nv, ne = v.count(), e.count()
    es = cut(e.select("eid", "v1", "v2", "directed"), "mdl")
    head = covered(instances)
    cover = cut(instances.select("canon", F.array_min("vs").alias("sub"), F.explode("vs").alias("vid")), "cover")
    used = instances.select("canon", F.explode("es").alias("eid")).withColumn("used", F.lit(True))
    # a vertex of the compressed graph is (0, instance) or (1, vertex); rows of undirected edges are those of the earlier end
    key = lambda sub, vid: F.when(F.col(sub).isNotNull(), F.struct(F.lit(0).alias("k"), F.col(sub).alias("i"))).otherwise(F.struct(F.lit(1).alias("k"), F.col(vid).alias("i")))
    touched = es.join(cover.select("canon", F.col("vid").alias("v1")), "v1").select("canon", "eid").union(es.join(cover.select("canon", F.col("vid").alias("v2")), "v2").select("canon", "eid")).distinct()
    t = touched.join(es, "eid").join(used, ["canon", "eid"], "left")
    t = t.join(cover.toDF("canon", "s1", "v1"), ["canon", "v1"], "left").join(cover.toDF("canon", "s2", "v2"), ["canon", "v2"], "left")
    t = cut(t.select("canon", "eid", "v1", "v2", "directed", F.coalesce("used", F.lit(False)).alias("used"), key("s1", "v1").alias("a"), key("s2", "v2").alias("b")), "touched")
    row = lambda d, x, y: (F.when(F.col(d), F.col(x)).otherwise(F.least(x, y)), F.when(F.col(d), F.col(y)).otherwise(F.greatest(x, y)))
    (r, c), (r2, c2) = row("directed", "v1", "v2"), row("directed", "a", "b")
    old_rows = es.select(r.alias("s"), c.alias("t")).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    gone = t.select("canon", r.alias("s"), c.alias("t")).distinct().groupBy("canon", "s").agg(F.count(F.lit(1)).alias("gone")).join(old_rows, "s")
    gone = gone.join(cover.select("canon", F.col("vid").alias("s"), F.lit(True).alias("inside")), ["canon", "s"], "left").select("canon", F.struct(F.lit(1).alias("k"), F.col("s").alias("i")).alias("row"), "gone", "k", F.coalesce("inside", F.lit(False)).alias("inside"))
    left = t.filter("NOT used")
    fresh = left.select("canon", r2.alias("row"), c2.alias("t")).distinct().groupBy("canon", "row").agg(F.count(F.lit(1)).alias("fresh"))
    rows = gone.join(fresh, ["canon", "row"], "full")
    new_k = F.when(F.coalesce("inside", F.lit(False)), F.lit(None)).otherwise(F.coalesce("k", F.lit(0)) - F.coalesce("gone", F.lit(0)) + F.coalesce("fresh", F.lit(0)))
    rows = cut(rows.select("canon", F.col("k").alias("was"), F.coalesce("gone", F.lit(0)).alias("gone"), F.coalesce("fresh", F.lit(0)).alias("fresh"), new_k.alias("now")), "rows")
    hist = cut(old_rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "hist")  # a row per distinct number of neighbours
    size = head.select("canon", "n", "m", "instances", (F.lit(nv) - F.col("vertices") + F.col("instances")).alias("vv"), (F.lit(ne) - F.col("edges")).alias("ee"))
    was = rows.filter("was IS NOT NULL").groupBy("canon", F.col("was").alias("k")).agg(F.count(F.lit(1)).alias("minus"))
    rest = size.select("canon", "vv").join(F.broadcast(hist)).join(was, ["canon", "k"], "left").withColumn("c", F.col("c") - F.coalesce("minus", F.lit(0)))  # every substructure with each of few counts
    rest = rest.filter("c > 0").groupBy("canon").agg(F.sum(F.col("c") * mdl.log2_choose(F.col("vv"), F.col("k"))).alias("rb"), F.max("k").alias("b"), F.sum(F.col("c") * F.col("k")).alias("kk"))
    changed = rows.join(size.select("canon", "vv"), "canon").filter("now > 0").groupBy("canon").agg(F.sum(mdl.log2_choose(F.col("vv"), F.col("now"))).alias("rb2"), F.max("now").alias("b2"), F.sum("now").alias("kk2"))
    # the most edges between two vertices
    pair = lambda x, y: [F.least(x, y).alias("p"), F.greatest(x, y).alias("q")]
    many = es.select(*pair("v1", "v2")).groupBy("p", "q").agg(F.count(F.lit(1)).alias("k"))
    old_many = t.select("canon", *pair("v1", "v2")).distinct().join(many, ["p", "q"]).groupBy("canon", "k").agg(F.count(F.lit(1)).alias("minus"))
    many_hist = cut(many.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "hist")
    most = size.select("canon").join(F.broadcast(many_hist)).join(old_many, ["canon", "k"], "left").filter("c > coalesce(minus, 0)").groupBy("canon").agg(F.max("k").alias("mm"))  # as above
    most2 = left.select("canon", *pair("a", "b")).groupBy("canon", "p", "q").agg(F.count(F.lit(1)).alias("k")).groupBy("canon").agg(F.max("k").alias("mm2"))
    outer = left.groupBy("canon").agg(F.sum((F.col("a.k") == 0).cast("int") + (F.col("b.k") == 0).cast("int")).alias("ends"))
    x = size.join(rest, "canon", "left").join(changed, "canon", "left").join(most, "canon", "left").join(most2, "canon", "left").join(outer, "canon", "left").na.fill(0)
    bits = _bits(F.col("vv"), F.col("ee"), F.col("kk") + F.col("kk2"), F.greatest("b", "b2"), F.greatest("mm", "mm2"), F.col("rb") + F.col("rb2"), labels)
    return x.select("canon", "n", "m", "instances", (bits + F.col("ends") * F.log2("n")).alias("bits"))


def pattern_bits(instances: DataFrame, e: DataFrame, labels: int) -> DataFrame:
    """(canon, bits): description length of each substructure, from its first instance."""
    one = cut(instances.groupBy("canon").agg(F.min(F.struct("vs", "es")).alias("x")).select("canon", "x.*"), "first")
    own = one.select("canon", F.explode("es").alias("eid")).join(e.select("eid", "v1", "v2", "directed"), "eid")
    pairs = own.select("canon", F.when(F.col("directed"), F.col("v1")).otherwise(F.least("v1", "v2")).alias("s"), F.when(F.col("directed"), F.col("v2")).otherwise(F.greatest("v1", "v2")).alias("t")).distinct()
    size = one.select("canon", F.size("vs").alias("vv"), F.size("es").alias("ee"))
    rows = pairs.groupBy("canon", "s").agg(F.count(F.lit(1)).alias("k")).join(size, "canon").groupBy("canon").agg(F.sum(mdl.log2_choose(F.col("vv"), F.col("k"))).alias("rb"), F.max("k").alias("b"), F.sum("k").alias("kk"))
    most = own.groupBy("canon", F.least("v1", "v2"), F.greatest("v1", "v2")).agg(F.count(F.lit(1)).alias("c")).groupBy("canon").agg(F.max("c").alias("mm"))
    x = size.join(rows, "canon", "left").join(most, "canon", "left").na.fill(0)
    return x.select("canon", _bits(F.col("vv"), F.col("ee"), F.col("kk"), F.col("b"), F.col("mm"), F.col("rb"), labels).alias("bits"))


def evaluate(instances: DataFrame, v: DataFrame, e: DataFrame, by: str = "size", negative: tuple[DataFrame, DataFrame, DataFrame] | None = None, overlap: bool = False) -> DataFrame:
    """(canon, instances, examples, value) of substructures by mdl, size or setcover.

    mdl and size: size(G) over size(S) + size(G | S), in bits or in vertices and edges, where in G | S every instance is one vertex. With
    negative graphs N (instances, vertices, edges): size(G) + size(N) over size(S) + size(G | S) + size(N) - size(N | S). setcover: the share of
    examples that are positive and covered or negative and not. Instances are disjoint (see ``disjoint``) unless ``overlap`` says otherwise,
    where shared structure is taken away once and overlaps cost edges; mdl takes disjoint ones only.
    """
    examples = lambda i, w: i.withColumn("vid", F.element_at("vs", 1)).join(w.select("vid", "example"), "vid").groupBy("canon").agg(F.countDistinct("example").alias("examples"))
    ni, nv, ne = negative or (None, None, None)
    pos = instances.groupBy("canon").agg(F.count(F.lit(1)).alias("instances")).join(examples(instances, v), "canon")
    if by == "setcover":
        p = v.select("example").distinct().count()
        if negative is None:
            return pos.select("canon", "instances", "examples", (F.col("examples") / F.lit(p)).alias("value"))
        q = nv.select("example").distinct().count()
        hit = examples(ni, nv).withColumnRenamed("examples", "wrong")
        return pos.join(hit, "canon", "left").select("canon", "instances", "examples", ((F.col("examples") + q - F.coalesce("wrong", F.lit(0))) / F.lit(p + q)).alias("value"))
    if by == "mdl":
        if overlap:
            raise ValueError("mdl needs disjoint instances")
        both = v.select("label").union(e.select("label"))
        labels = (both if negative is None else both.union(nv.select("label")).union(ne.select("label"))).distinct().count()
        whole = lambda w, x, k: float(graph_mdl(w, x, k).first()["bits"])
        s, c = pattern_bits(instances, e, labels), compressed_bits(instances, v, e, labels + 1).select("canon", F.col("bits").alias("size"))
        g = whole(v, e, labels)
        if negative:
            n, n1 = whole(nv, ne, labels), whole(nv, ne, labels + 1)
            wrong = compressed_bits(ni, nv, ne, labels + 1).select("canon", F.col("bits").alias("wrong"))
    else:
        c = compressed_size(instances, v, e, overlap)
        s, c = c.select("canon", (F.col("n") + F.col("m")).alias("bits")), c.select("canon", "size")
        g = v.count() + e.count()
        if negative:
            n = n1 = nv.count() + ne.count()
            wrong = compressed_size(ni, nv, ne, overlap).select("canon", F.col("size").alias("wrong"))
    x = pos.join(s, "canon").join(c, "canon")
    if negative is None:
        return x.select("canon", "instances", "examples", (F.lit(g) / (F.col("bits") + F.col("size"))).alias("value"))
    x = x.join(wrong, "canon", "left")
    return x.select("canon", "instances", "examples", (F.lit(g + n) / (F.col("bits") + F.col("size") + n - F.coalesce("wrong", F.lit(n1)))).alias("value"))


def beam(values: DataFrame, width: int, by_value: bool = False) -> DataFrame:
    """The best ``width`` substructures, or all with the best ``width`` distinct values. A top-k first, so nothing large is ranked."""
    if by_value:
        best = values.select("value").distinct().orderBy(F.desc("value")).limit(width)
        return values.join(F.broadcast(best), "value", "left_semi")  # width rows
    return values.orderBy(F.desc("value"), "canon").limit(width)


@dataclass
class Search:
    """Options of a search; ``limit`` is how many substructures are extended (half of the edges by default). With ``prune``, a substructure goes no
    further than one it grew from if its value is less. ``threshold`` is the share of a substructure's size that an instance may differ by (see
    ``alike``)."""

    width: int = 4
    limit: int | None = None
    least: int = 1
    most: int = 0
    report: int = 3
    by: str = "size"
    overlap: bool = False
    by_value: bool = False
    rounds: int | None = None
    prune: bool = False
    threshold: float = 0.0


def discover(v: DataFrame, e: DataFrame, options: Search = Search(), negative: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:  # noqa: B008
    """(canon, n, m, instances, examples, value): the best compressing substructures by beam search.

    Each round extends the instances of the beam's substructures by one edge, groups them by canonical string, values them and keeps the beam.
    Unless instances may overlap, a substructure goes on with its disjoint ones, so a hub has one instance of a star in a round, not one for each
    choice of its neighbours. This goes on until the limit is used up or nothing is left to extend; ``rounds`` ends it before.

    ``negative`` is a graph (vertices, edges) that should not be compressed: its instances of the beam's substructures are extended alongside and
    count against the value.
    """
    o = options
    if o.threshold and not 0 < o.threshold < 1:
        raise ValueError("the threshold is a share of a substructure's size")
    v, e = cut(v, "v"), cut(with_ids(e), "e")
    if negative:
        nv, ne = cut(negative[0], "nv"), cut(with_ids(negative[1]), "ne")
    limit = o.limit or max(1, e.count() // 2)
    labels = initial(v)
    single = lambda w: w.join(labels.select("label"), "label", "left_semi").select(F.array("vid").alias("vs"), F.array().cast("array<bigint>").alias("es"), F.concat(F.regexp_replace("label", r"([\\|#;])", r"\\$1"), F.lit("#")).alias("canon"), F.lit(0.0).alias("value"))
    now, best, done = cut(single(v), "beam"), None, 0
    wrong = cut(single(nv).drop("value"), "beam") if negative else None
    for _ in count() if o.rounds is None else range(o.rounds):
        done += now.select("canon").distinct().count()
        grown = cut(extend(now, v, e, "value"), "grown")
        if o.most:
            grown = grown.filter(F.size("vs") <= o.most)
        many = grown.groupBy("canon").count().filter("count > 1").select("canon")
        grown = cut(grown.join(many, "canon", "left_semi"), "grown")
        if not grown.limit(1).count():
            break
        before = grown.groupBy("canon").agg(F.min("value").alias("before"))
        plain = grown.drop("value")
        whole = plain
        if o.threshold:
            plain = cut(alike(plain, v, e, o.threshold), "alike")
        apart = plain if o.overlap else cut(disjoint(plain), "apart")
        against = None
        if negative:
            wrong = cut(extend(wrong, nv, ne).join(many, "canon", "left_semi"), "wrong")
            wrong = wrong if o.overlap else cut(disjoint(wrong), "wrong")
            against = (wrong, nv, ne)
        val = cut(evaluate(apart, v, e, o.by, against, overlap=o.overlap), "value")
        if o.prune:
            val = cut(val.join(before, "canon").filter(F.col("value") >= F.col("before")).drop("before"), "value")
        top = cut(beam(val, o.width, o.by_value), "top")
        if top.isEmpty():
            break
        own = whole if o.overlap else apart if not o.threshold else disjoint(whole)
        now = cut(own.join(F.broadcast(top.select("canon", "value")), "canon"), "beam")  # width rows
        if negative:
            wrong = cut(wrong.join(F.broadcast(top.select("canon")), "canon", "left_semi"), "beam")
        sized = now.groupBy("canon").agg(F.max(F.size("vs")).alias("n"), F.max(F.size("es")).alias("m"))
        part = top.join(sized, "canon").filter(F.col("n") >= o.least).select("canon", "n", "m", "instances", "examples", "value")
        best = part if best is None else best.union(part)
        if done >= limit:
            break
    if best is None:
        return v.sparkSession.createDataFrame([], "canon string, n int, m int, instances bigint, examples bigint, value double")
    return best.dropDuplicates(["canon"]).orderBy(F.desc("value"), "canon").limit(o.report)


def compress(v: DataFrame, e: DataFrame, instances: DataFrame, label: str = "SUB") -> tuple[DataFrame, DataFrame]:
    """Replace each instance (disjoint sets vs) by one vertex of that label; edges inside go, edges across point at it."""
    m = instances.select(F.array_min("vs").alias("to"), F.explode("vs").alias("vid"))
    nv = v.join(m, "vid", "left").select(F.coalesce("to", "vid").alias("vid"), F.when(F.col("to").isNotNull(), label).otherwise(F.col("label")).alias("label"), "example").dropDuplicates(["vid"])
    a, b = m.select(F.col("vid").alias("v1"), F.col("to").alias("t1")), m.select(F.col("vid").alias("v2"), F.col("to").alias("t2"))
    x = e.join(a, "v1", "left").join(b, "v2", "left").filter("NOT coalesce(t1 = t2, false)")
    return nv, x.select(F.coalesce("t1", "v1").alias("v1"), F.coalesce("t2", "v2").alias("v2"), "label", "directed")


def compress_overlapping(v: DataFrame, e: DataFrame, instances: DataFrame, label: str = "SUB") -> tuple[DataFrame, DataFrame]:
    """Replace each instance (vs, es) of one substructure by a vertex of that label, where instances may share vertices and edges.

    Vertices and edges of instances go. An edge across points at the instance, and at a copy for each further instance of a shared vertex; an
    ``OVERLAP`` edge leads from the first instance at a shared vertex to each other one, a pair once. New vertices are numbered after all others, in
    order of their instances. The graph's size is what ``compressed_size`` says. Edges come with ids; equal rows are edges of their own.
    """
    from weft.operators.selection import ordered

    e = cut(e if "eid" in e.columns else with_ids(e), "e")
    top = v.agg(F.max("vid")).first()[0] or 0
    i = cut(ordered(instances.select("vs", "es").distinct(), F.asc("vs"), F.asc("es")).select((F.col("rank") + top + 1).alias("to"), "vs", "es"), "instances")
    at = cut(i.select("to", F.explode("vs").alias("vid")), "at")
    first = cut(at.groupBy("vid").agg(F.min("to").alias("first")), "first")
    some = i.select("to", F.get("vs", F.lit(0)).alias("vid")).join(v.select("vid", "example"), "vid").select(F.col("to").alias("vid"), F.lit(label).alias("label"), "example")
    nv = v.join(first.select("vid"), "vid", "left_anti").select("vid", "label", "example").union(some)
    used = i.select(F.explode("es").alias("eid")).distinct()
    left = e.join(used, "eid", "left_anti").select("v1", "v2", "label", "directed")
    f1, f2 = first.toDF("v1", "f1"), first.toDF("v2", "f2")
    plain = left.join(f1, "v1", "left").join(f2, "v2", "left")
    here = F.coalesce("f1", "v1"), F.coalesce("f2", "v2")
    main = plain.select(here[0].alias("v1"), here[1].alias("v2"), "label", "directed")
    # a copy for each further instance at an end; at a loop both ends are that instance
    more = at.join(first, "vid").filter("to <> first").select("vid", "to")
    m1 = plain.join(more.toDF("v1", "to"), "v1").select(F.col("to").alias("v1"), F.when(F.col("v1") == F.col("v2"), F.col("to")).otherwise(here[1]).alias("v2"), "label", "directed")
    m2 = plain.filter("v1 <> v2").join(more.toDF("v2", "to"), "v2").select(here[0].alias("v1"), F.col("to").alias("v2"), "label", "directed")
    pairs = at.join(first, "vid").filter("to <> first").select(F.col("first").alias("v1"), F.col("to").alias("v2")).distinct()
    ne = main.union(m1).union(m2).union(pairs.select("v1", "v2", F.lit("OVERLAP"), F.lit(False)))
    return nv, cut(ne.withColumn("eid", F.monotonically_increasing_id()), "compressed")


def iterate_discovery(v: DataFrame, e: DataFrame, options: Search = Search(), iterations: int = 0, label: str = "SUB") -> tuple[list[dict], DataFrame, DataFrame]:  # noqa: B008
    """What each iteration found, and the graph after the last: the best substructure is found, all its instances are replaced by vertices of the label
    ``SUB_1``, ``SUB_2``, ..., and the smaller graph is searched again, so that later substructures are made of earlier ones. With 0
    iterations this goes on until nothing compresses the graph or no edge is left."""
    found: list[dict] = []
    e = cut(e if "eid" in e.columns else with_ids(e), "e")
    for k in count(1):
        # what has been compressed is told apart by its own edges: repeated edges stay several
        best = discover(v, e.select("v1", "v2", "label", "directed"), options).collect()
        best = next((r for r in best if parse(r.canon)[1] and r.value > 1), None)
        if best is None:
            break
        every = instances_of(with_labels(v, e).withColumn("batch", F.lit(0)), best.canon)
        own = cut(every if options.overlap else disjoint(every), "own")
        v, e = compress_overlapping(v, e, own.select("vs", "es"), f"{label}_{k}")
        v = cut(v, "v")
        found.append(best.asDict() | {"iteration": k, "label": f"{label}_{k}", "vertices": v.count(), "edges": e.count()})
        if k == iterations or not found[-1]["edges"]:
            break
    return found, v, e


def remove_covered(v: DataFrame, e: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop whole examples that hold an instance."""
    hit = instances.select(F.explode("vs").alias("vid")).distinct().join(v.select("vid", "example"), "vid").select("example").distinct()
    nv = v.join(hit, "example", "left_anti").select("vid", "label", "example")
    keep = nv.select("vid")
    return nv, e.join(keep.toDF("v1"), "v1", "left_semi").join(keep.toDF("v2"), "v2", "left_semi").select("v1", "v2", "label", "directed")


def graph_mdl(v: DataFrame, e: DataFrame, labels: int | None = None) -> DataFrame:
    """(vertices, edges, bits): vertex, row and edge bits of a labelled graph.

    A row's ones are its distinct neighbours, an undirected edge counted at its smaller end only.
    """
    labels = labels or v.select("label").union(e.select("label")).distinct().count()
    lg = math.log2(max(1, labels))
    ends = e.select(F.when(F.col("directed"), F.col("v1")).otherwise(F.least("v1", "v2")).alias("s"), F.when(F.col("directed"), F.col("v2")).otherwise(F.greatest("v1", "v2")).alias("t"))
    per = ends.groupBy("s", "t").agg(F.count(F.lit(1)).alias("k"))
    most = e.select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.max("k"), F.lit(1)).alias("mm"))
    rows = per.groupBy("s").agg(F.count(F.lit(1)).alias("ki"))
    n = v.agg(F.count(F.lit(1)).alias("vv"))
    m = e.agg(F.count(F.lit(1)).alias("ee"))
    agg = rows.join(F.broadcast(n)).agg(F.coalesce(F.sum(mdl.log2_choose(F.col("vv"), F.col("ki"))), F.lit(0.0)).alias("rb"), F.coalesce(F.max("ki"), F.lit(0)).alias("b"), F.coalesce(F.sum("ki"), F.lit(0)).alias("kk"))
    x = n.join(F.broadcast(m)).join(F.broadcast(agg)).join(F.broadcast(most))  # one row each
    bits = F.log2("vv") + F.col("vv") * lg + (F.col("vv") + 1) * F.log2(F.col("b") + 1) + F.col("rb") + F.col("ee") * (1 + lg) + (F.col("kk") + 1) * F.log2("mm")
    return x.select(F.col("vv").alias("vertices"), F.col("ee").alias("edges"), bits.alias("bits"))


def confusion(predicted: DataFrame) -> DataFrame:
    """(tp, tn, fp, fn, error) from booleans truth and said."""
    c = predicted.agg(*[F.count_if(x).alias(n) for n, x in (("tp", F.col("truth") & F.col("said")), ("tn", ~F.col("truth") & ~F.col("said")), ("fp", ~F.col("truth") & F.col("said")), ("fn", F.col("truth") & ~F.col("said")))])
    return c.withColumn("error", (F.col("fp") + F.col("fn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def fold(key: Column, k: int) -> Column:
    """A reproducible fold of 0..k-1 that other engines can compute too."""
    return F.pmod(key * 1103515245 + 12345, F.lit(2147483648)) % k


def match_cost(a: tuple[list[str], list[tuple[int, int, str, bool]]], b: tuple[list[str], list[tuple[int, int, str, bool]]], bound: float = math.inf, most: int | None = None) -> float:
    """Least number of unit edits (relabel, insert or delete a vertex or an edge) from one small labelled graph to another.

    Best first over partial maps; after n^4 states (``most``) only the best state goes on, which gives an upper bound.
    """
    import heapq

    (la, ea), (lb, eb) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    n, most = len(la), most if most is not None else max(64, len(la) ** 4)
    order = sorted(range(n), key=lambda i: -sum(i in x[:2] for x in ea))

    def step(mapped: tuple[int, ...], i: int, j: int) -> float:
        c = (1.0 if j < 0 else float(la[i] != lb[j]))
        done = {order[k]: t for k, t in enumerate(mapped)} | {i: j}
        ours = [(x, done[x[0]], done[x[1]]) for x in ea if i in x[:2] and x[0] in done and x[1] in done]
        theirs = [x for x in eb if j >= 0 and j in x[:2] and {x[0], x[1]} <= set(done.values())]
        free = list(theirs)
        for x, s, t in ours:
            same = [y for y in free if (y[:2] == (s, t) if x[3] else {y[0], y[1]} == {s, t})]
            pick = next((y for y in same if y[2:] == x[2:]), same[0] if same else None)
            if pick is None:
                c += 1
            else:
                free.remove(pick)
                c += pick[2:] != x[2:]
        return c + len(free)

    heap, seen = [(0.0, 0, ())], 0
    while heap:
        cost, neg, mapped = heapq.heappop(heap)
        if cost > bound:
            return math.inf
        if len(mapped) == n:
            unused = set(range(len(lb))) - set(mapped)
            extra = len(unused) + sum(bool(unused & {x[0], x[1]}) for x in eb)
            if extra:
                heapq.heappush(heap, (cost + extra, neg, (*mapped, -2)))
                continue
            return cost
        if len(mapped) > n:
            return cost
        seen += 1
        new = [(cost + step(mapped, order[len(mapped)], j), -len(mapped) - 1, (*mapped, j)) for j in [*sorted(set(range(len(lb))) - set(mapped)), -1]]
        if seen > most:
            heap = [min(new)]
        else:
            for x in new:
                heapq.heappush(heap, x)
    return math.inf


def alike(instances: DataFrame, v: DataFrame, e: DataFrame, threshold: float) -> DataFrame:
    """(canon, vs, es): each substructure with its own instances and those of every other one of the round whose edit cost is at most
    ``threshold`` times its size (vertices and edges).

    Substructures are the rows here, not instances: a table of canonical strings is compared, and only pairs that can be near enough are:
    those whose counts of vertex labels and of edge labels differ by no more than the cost allows, found by a join on what an allowed cost of
    this round leaves in common. The cost itself is the least number of unit edits (``match_cost``), worked out a pair at a time in tasks.
    """
    forms = cut(instances.select("canon").distinct(), "forms")
    size = lambda c: sum(map(len, parse(c)))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c in b["canon"]:
                allowed = math.floor(threshold * size(c))
                labels = Counter(("v", x) for x in parse(c)[0]) + Counter(("e", x[2]) for x in parse(c)[1])
                rows.append((c, allowed, size(c), sorted(f"{kind}:{x}:{i}" for (kind, x), k in labels.items() for i in range(k))))
            yield pd.DataFrame(rows, columns=["canon", "allowed", "size", "marks"])

    marked = cut(forms.mapInPandas(keys, "canon string, allowed int, size int, marks array<string>"), "marks")
    # prefix filter: an edit changes one mark at most, so of two graphs near enough, the first allowed + 1 marks of one (in any fixed order) hold one that the other has
    wide = marked.filter("allowed > 0").select("canon", "allowed", "size", "marks", F.explode(F.slice("marks", 1, F.col("allowed") + 1)).alias("mark"))
    other = marked.select(F.col("canon").alias("near"), F.col("size").alias("size2"), F.col("marks").alias("marks2"), F.explode("marks").alias("mark"))
    pairs = wide.join(other, "mark").filter((F.col("canon") != F.col("near")) & (F.abs(F.col("size") - F.col("size2")) <= F.col("allowed")))
    pairs = pairs.select("canon", "near", "allowed", "size", F.size(F.array_intersect("marks", "marks2")).alias("common")).distinct().filter(F.col("size") - F.col("common") <= F.col("allowed"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [match_cost(parse(x), parse(y), bound=float(k)) <= k for x, y, k in zip(b["canon"], b["near"], b["allowed"], strict=True)]
            yield b.loc[ok, ["canon", "near"]]

    near = cut(pairs.select("canon", "near", "allowed").repartition("canon", "near").mapInPandas(judge, "canon string, near string"), "near")
    more = instances.select(F.col("canon").alias("near"), "vs", "es").join(near, "near").select("canon", "vs", "es")
    return instances.select("canon", "vs", "es").union(more).distinct()


def recursive(instances: DataFrame, e: DataFrame) -> DataFrame:
    """(canon, label, group, vs): instances of one substructure joined through edges of one label, as connected groups (named by their smallest vertex).

    Instances that share an edge of the label are linked (through the edge's ends), and links of each (substructure, label) are joined into components.
    """
    from weft.operators.iterate import components

    i = cut(instances.withColumn("iid", F.xxhash64("canon", "vs")).select("canon", "iid", "vs"), "rec")
    at = i.select("canon", "iid", F.explode("vs").alias("vid"))
    x = e.select("v1", "v2", "label").join(at.toDF("canon", "i1", "v1"), "v1").join(at.toDF("canon", "i2", "v2"), ["canon", "v2"]).filter("i1 <> i2")
    links = cut(x.select("canon", "label", F.least("i1", "i2").alias("i1"), F.greatest("i1", "i2").alias("i2")).distinct(), "rec")
    # one component run for all labels: nodes are (instance, label) pairs
    named = lambda c: F.xxhash64(c, "label")
    comp = components(links.select(named("i1").alias("u"), named("i2").alias("v"), F.lit(1).cast("long").alias("w")))
    ends = links.select("canon", "label", F.explode(F.array("i1", "i2")).alias("iid")).distinct().withColumn("id", named("iid"))
    g = ends.join(comp, "id").join(i.select("iid", "vs"), "iid")
    whole = g.groupBy("canon", "label", "component").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))).alias("vs"))
    return whole.select("canon", "label", F.array_min("vs").alias("group"), "vs")


def overlaps(instances: DataFrame) -> DataFrame:
    """(vid, members): vertices that more than one instance of a substructure holds, which compression marks by OVERLAP edges."""
    return instances.select("canon", F.explode("vs").alias("vid")).groupBy("canon", "vid").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")


def compress_pattern(v: DataFrame, e: DataFrame, pattern_vertices: list[str], pattern_edges: list[tuple[int, int, str, bool]], label: str = "SUB") -> tuple[DataFrame, DataFrame]:
    """Compression with a given pattern: its matches, a disjoint choice of them, and their contraction."""
    m = find_instances(v, e, pattern_vertices, pattern_edges).select(F.array_sort("vs").alias("vs")).distinct()
    apart = disjoint(m.select(F.lit("p").alias("canon"), "vs", F.array().cast("array<bigint>").alias("es")))
    return compress(v, e, apart, label)
