"""Readers of graph text formats; parsing is column expressions over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.core import canonical, induced, relabel, simple


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r", "")).alias("line")).filter("line <> ''")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """A white-space separated integer edge list as a simple graph: distinct canonical pairs; self-loops stay."""
    t = F.split("line", r"\s+")
    e = _lines(spark, path).filter(~F.col("line").rlike("^[%#]")).select(t[0].cast("long").alias("u"), t[1].cast("long").alias("v"))
    return e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("w", F.lit(1).cast("long"))


def graph(spark: SparkSession, path: str) -> DataFrame:
    """The largest component of an edge list with ids from 0 on."""
    from weft.operators.iterate import largest_component
    from weft.operators.rest import cut

    e = cut(edge_list(spark, path), "read")
    return relabel(cut(induced(e, largest_component(e)), "read"))


def temporal_edge_list(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines without % or #, at least two tokens: (src, trg, w, ts) strings. Four columns are src, trg, w, ts; three are src, trg, ts; rows are made distinct."""
    t = F.split("line", r"\s+")
    lines = spark.read.text(paths).select(F.trim(F.regexp_replace("value", r"\r", "")).alias("line"))
    x = lines.filter(~F.col("line").rlike("[%#]")).select(t.alias("t")).filter(F.size("t") >= 2)
    n = F.size("t")
    get = lambda i: F.get("t", F.lit(i))
    return x.select(get(0).alias("src"), get(1).alias("trg"), F.when(n >= 4, get(2)).alias("w"), F.when(n >= 4, get(3)).when(n == 3, get(2)).alias("ts")).dropDuplicates()


def one_based_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Comma or white-space separated 1-based pairs (a third column is ignored): a simple graph."""
    t = F.split("line", r"[,\s]+")
    return simple(_lines(spark, path).select(t[0].cast("long").alias("u"), t[1].cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A dense 0/1 matrix, a row per line in a file small enough to be one partition: edges of the cells that aren't zero."""
    rows = _lines(spark, path).coalesce(1).select(F.monotonically_increasing_id().alias("u"), "line").select("u", F.posexplode(F.split("line", r"\s+")).alias("v", "x"))
    return simple(rows.filter(F.col("x").cast("double") != 0).select("u", F.col("v").cast("long").alias("v")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(no, line) in file order: line offsets give the order, so files aren't read by one task."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("no"), F.trim(F.regexp_replace("value", r"\r", "")).alias("line"))


def labelled_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (example, polarity, vid, label) and edges (example, polarity, v1, v2, label, directed) of a file of XP / XN examples.

    ``v id label``; ``d``, ``u`` and ``e`` edges (``e`` counts as directed); % comments; labels may be quoted. The example of a line is the
    number of example marks above it: marks are few, so their ranges are joined instead of a running count over all lines.
    """
    lines = numbered_lines(spark, path).filter("line <> '' AND NOT line LIKE '\\%%'")
    marks = lines.filter(F.upper("line").isin("XP", "XN", "S", "PS")).select("no", F.upper("line").alias("polarity"))
    w = Window.orderBy("no")
    spans = marks.withColumn("example", F.row_number().over(w).cast("long")).withColumn("end", F.coalesce(F.lead("no").over(w), F.lit((1 << 62)))).withColumnRenamed("no", "start")
    first = spans.agg(F.min("start").alias("m")).first().m
    body = lines.filter(~F.upper("line").isin("XP", "XN", "S", "PS"))
    if first is None:
        placed = body.withColumn("example", F.lit(1).cast("long")).withColumn("polarity", F.lit("XP"))
    else:
        placed = body.join(F.broadcast(spans), (F.col("no") > F.col("start")) & (F.col("no") < F.col("end")), "left").withColumn("example", F.coalesce("example", F.lit(0))).withColumn("polarity", F.coalesce("polarity", F.lit("XP")))
    tok = F.regexp_extract_all("line", F.lit(r'("[^"]*"|\S+)'), F.lit(1))
    t = placed.select("example", "polarity", tok.alias("t"))
    clean = lambda i: F.regexp_replace(F.get("t", F.lit(i)), '^"|"$', "")
    v = t.filter("t[0] = 'v'").select("example", "polarity", clean(1).cast("long").alias("vid"), clean(2).alias("label"))
    e = t.filter("t[0] IN ('e', 'u', 'd')").select("example", "polarity", clean(1).cast("long").alias("v1"), clean(2).cast("long").alias("v2"), clean(3).alias("label"), (F.get("t", F.lit(0)) != "u").alias("directed"))
    return v, e


Pattern = tuple[list[str], list[tuple[int, int, str, bool]]]


def patterns(v: DataFrame, e: DataFrame, most: int = 10_000) -> list[Pattern]:
    """The predefined patterns among the examples of a labelled graph file: labels by vertex number, and edges by position. Patterns are small by
    nature; more than ``most`` rows of them are an error."""
    vs = v.filter("polarity = 'PS'").orderBy("example", "vid").limit(most + 1).collect()
    es = e.filter("polarity = 'PS'").orderBy("example", "v1", "v2", "label").limit(most + 1).collect()
    if max(len(vs), len(es)) > most:
        raise ValueError(f"predefined patterns are limited to {most} rows")
    out = []
    for x in sorted({r.example for r in vs}):
        own = [r for r in vs if r.example == x]
        at = {r.vid: i for i, r in enumerate(own)}
        out.append(([r.label for r in own], [(at[r.v1], at[r.v2], r.label, r.directed) for r in es if r.example == x]))
    return out


def structures(spark: SparkSession, path: str) -> DataFrame:
    """(sid, code, n_edges, nodes1, nodes2) of a structure model; ranges such as 3-9 are spelled out."""
    lines = numbered_lines(spark, path).filter("line <> ''")
    code = F.regexp_extract("line", r"^(\w+)", 1)
    rest = F.regexp_replace("line", r"^\w+\s*", "")
    halves = F.split(rest, ",")

    def ids(c):
        tokens = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
        lo = lambda x: F.split(x, "-")[0].cast("long")
        hi = lambda x: F.element_at(F.split(x, "-"), -1).cast("long")
        return F.flatten(F.transform(tokens, lambda x: F.sequence(lo(x), hi(x))))

    two = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
    near = code == "nc"
    return lines.select(F.col("no").alias("sid"), code.alias("code"), F.when(near, F.trim(F.get(halves, F.lit(0))).cast("long")).alias("n_edges"), ids(F.when(near, two).otherwise(F.get(halves, F.lit(0)))).alias("nodes1"), ids(F.when(near, F.lit("")).otherwise(two)).alias("nodes2"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(node, vec): lines of an id and numbers; a header of two tokens is skipped."""
    t = F.split("line", r"\s+")
    return _lines(spark, path).select(t.alias("t")).filter(F.size("t") > 2).select(F.get("t", F.lit(0)).cast("long").alias("node"), F.transform(F.slice("t", 2, 1 << 20), lambda x: x.cast("double")).alias("vec"))


def multigraph(pairs: DataFrame) -> DataFrame:
    return canonical(pairs)


#: Fixed value: a graph of nine nodes for examples and tests.
SAMPLE = [(1, 2), (1, 3), (1, 5), (2, 4), (2, 5), (2, 7), (3, 4), (3, 5), (4, 5), (4, 9), (6, 7), (6, 8), (6, 9), (7, 8), (7, 9), (8, 9)]


def sample(spark: SparkSession) -> DataFrame:
    return simple(spark.createDataFrame(SAMPLE, "u long, v long"))
