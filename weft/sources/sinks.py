"""Writers of graph text formats and result tables; lines are column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edge_list(edges: DataFrame, path: str) -> None:
    """``u v`` per line."""
    edges.select(F.concat_ws(" ", "u", "v").alias("value")).write.text(path)


def write_run(df: DataFrame, path: str, keys: tuple[str, ...] = ("name", "clustering", "type", "mu"), mode: str = "append") -> None:
    """Results of a run as Parquet, a folder for each combination of the keys that the table has."""
    df.write.mode(mode).partitionBy(*[k for k in keys if k in df.columns]).parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated metrics with a header."""
    df.write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def label_lines(v: DataFrame, e: DataFrame) -> DataFrame:
    """The distinct labels of vertices and edges, one a line, in order; null labels are left out."""
    return v.select("label").union(e.select("label")).filter("label IS NOT NULL").distinct().orderBy("label").select(F.col("label").alias("value"))


def quoted(c: str):
    return F.when(F.col(c).rlike(r"\s"), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise(F.col(c))


def labelled_lines(v: DataFrame, e: DataFrame) -> DataFrame:
    """(ord, value): vertices by id, then edges, of a labelled graph."""
    vs = v.select(F.lit(0).alias("k"), F.col("vid").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), "vid", quoted("label")).alias("value"))
    es = e.select(F.lit(1), "v1", "v2", F.concat_ws(" ", F.when(F.col("directed"), "d").otherwise("u"), "v1", "v2", quoted("label")))
    return vs.union(es).orderBy("k", "a", "b", "value").select("value")


def write_labelled(v: DataFrame, e: DataFrame, path: str) -> None:
    labelled_lines(v, e).write.text(path)


def dot_lines(v: DataFrame, e: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Lines of a DOT graph; vertices in ``marked`` (vid) are red."""
    if marked is not None:
        v = v.join(marked.select("vid", F.lit(", color=red").alias("c")), "vid", "left")
    else:
        v = v.withColumn("c", F.lit(None).cast("string"))
    head = v.sparkSession.createDataFrame([(0, "digraph G {"), (3, "}")], "k int, value string")
    vs = v.select(F.lit(1).alias("k"), F.format_string('  %d [label="%s"%s];', "vid", "label", F.coalesce("c", F.lit(""))).alias("value"))
    es = e.select(F.lit(2).alias("k"), F.format_string('  %d -> %d [label="%s"%s];', "v1", "v2", "label", F.when(F.col("directed"), "").otherwise(", dir=none")).alias("value"))
    return head.union(vs).union(es).orderBy("k", "value").select("value")


def write_dot(v: DataFrame, e: DataFrame, path: str, marked: DataFrame | None = None) -> None:
    dot_lines(v, e, marked).coalesce(1).write.text(path)  # a drawing: one file


def structure_lines(s: DataFrame, by_benefit: bool = True) -> DataFrame:
    """Lines of a structure model, those that save most first."""
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    near = F.col("code") == "nc"
    one, two = ids("nodes1"), ids("nodes2")
    line = F.concat(F.col("code"), F.lit(" "), F.when(near, F.concat(F.col("n_edges").cast("string"), F.lit(", "), one)).when(F.size("nodes2") > 0, F.concat(one, F.lit(", "), two)).otherwise(one))
    return s.orderBy(F.desc("saved") if by_benefit else "sid", "sid").select(line.alias("value"))


def write_structures(s: DataFrame, path: str, by_benefit: bool = True) -> None:
    structure_lines(s, by_benefit).write.text(path)


def rule_dot(nodes: list[tuple], edges: list[tuple]) -> str:
    """A rule's right-hand side as DOT: non-terminals are boxes with their size, terminals circles with their boundary degree."""
    rows = [f'  {n} [shape={"box" if lab is not None else "circle"}, label="{lab if lab is not None else b}"];' for n, lab, b in nodes]
    return "\n".join(["graph rule {", *rows, *[f'  {a} -- {b} [label="{w}"];' for a, b, w in edges], "}"])


def lattice_lines(links: DataFrame) -> DataFrame:
    """Lines of a DOT graph of substructures: an arrow from each one (parent) to those it was extended to (child), with the child's value."""
    head = links.sparkSession.createDataFrame([(0, "digraph substructures {"), (2, "}")], "k int, value string")
    name = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', "'"), F.lit('"'))
    rows = links.select(F.lit(1).alias("k"), F.concat(F.lit("  "), name("parent"), F.lit(" -> "), name("child"), F.lit(' [label="'), F.round("value", 4).cast("string"), F.lit('"];')).alias("value")).distinct()
    return head.union(rows).orderBy("k", "value").select("value")
