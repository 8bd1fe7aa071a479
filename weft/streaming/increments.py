"""Substructures of a growing labelled graph: each micro-batch is an increment whose results are final.

State is two tables in the shared folder: counts of one-edge substructures per increment, and the increments' sizes. Values over all increments
are sums over those tables, so no earlier increment is read again; edges that reach back into an earlier increment find its vertices by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.randgraph import drawn, uniform
from weft.operators.substructure import one_edge

LINE = "kind STRING, a BIGINT, b BIGINT, label STRING, example BIGINT"


class Increments:
    """Feed increments of rows (kind 'v', 'd' or 'u'; a, b ids; label; example) and ask for the best substructures so far."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as x:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(x):
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        # each increment owns one folder, so a batch that is run again replaces its own rows
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def add(self, rows: DataFrame, batch: int) -> None:
        v = rows.filter("kind = 'v'").select(F.col("a").alias("vid"), "label", "example")
        e = rows.filter("kind <> 'v'").select(F.col("a").alias("v1"), F.col("b").alias("v2"), "label", (F.col("kind") == "d").alias("directed"))
        self._write(v, "vertices", batch)
        known = self._table("vertices", "vid BIGINT, label STRING, example BIGINT, batch INT").filter(F.col("batch") <= batch).select("vid", "label", "example").dropDuplicates(["vid"])
        self._write(one_edge(known, e).select("l1", "edge", "directed", "l2", "instances"), "counts", batch)
        self._write(v.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("m")))), "sizes", batch)  # one row each

    def best(self, k: int = 3) -> DataFrame:
        """(l1, edge, directed, l2, instances, value): best by total size over compressed size, summed over all increments."""
        c = self._table("counts", "l1 STRING, edge STRING, directed BOOLEAN, l2 STRING, instances BIGINT, batch INT")
        total = self._table("sizes", "n BIGINT, m BIGINT, batch INT").agg((F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("m"), F.lit(0))).alias("t"))
        g = c.groupBy("l1", "edge", "directed", "l2").agg(F.sum("instances").alias("instances")).join(F.broadcast(total))  # one row
        value = F.col("t") / (3 + F.greatest(F.col("t") - 2 * F.col("instances"), F.lit(0)))
        return g.select("l1", "edge", "directed", "l2", "instances", value.alias("value")).orderBy(F.desc("value"), "l1", "edge", "l2").limit(k)

    def stream(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a streaming source of such rows until it is exhausted; one micro-batch is one increment."""
        return source.writeStream.foreachBatch(lambda df, i: self.add(df, int(i))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def increment_source(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream in which each file is one increment."""
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(folder)


def temporal_source(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Windowed edge counts of a stream of (ts, src, trg) files, closed when the watermark has passed."""
    s = spark.readStream.schema("ts TIMESTAMP, src BIGINT, trg BIGINT").parquet(folder)
    return s.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("edges")).select(F.col("w.start").alias("start"), "edges")


def increment_text(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream of increments as text, a file each: ``v id label`` and ``d``, ``e`` (directed) or ``u`` edges ``a b label``; labels may be
    quoted. All lines belong to one example (null): example marks, comments and other lines are left out."""
    t = F.regexp_extract_all("value", F.lit(r'("[^"]*"|\S+)'), F.lit(1))
    at = lambda i: F.regexp_replace(F.get("t", F.lit(i)), '^"|"$', "")
    kind = F.get("t", F.lit(0))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(folder).select(t.alias("t")).filter(kind.isin("v", "d", "e", "u"))
    is_v = kind == "v"
    return lines.select(
        F.when(kind == "e", "d").otherwise(kind).alias("kind"), at(1).cast("long").alias("a"), F.when(~is_v, at(2).cast("long")).alias("b"),
        F.when(is_v, at(2)).otherwise(at(3)).alias("label"), F.lit(None).cast("long").alias("example"),
    )


def random_increments(spark: SparkSession, increments: int, vertices: int, edges: int, vertex_labels: list[str], edge_labels: list[str], pattern: tuple[list[str], list[tuple[int, int, str, bool]]], copies: int, spanning: int = 0, seed: int = 0) -> DataFrame:
    """(batch, kind, a, b, label, example): increments of random vertices and edges, each with so many copies of a pattern.

    A copy's first vertex hangs on a random vertex of its increment. With ``spanning`` edges an increment is connected with the one before it
    (the first with none); else increments are independent. No edge is a loop. Every number is drawn from its own row and the seed.
    """
    labels, links = pattern
    own = vertices + copies * len(labels)
    if vertices < 2:
        raise ValueError("an increment needs two random vertices")
    batches = spark.range(increments).withColumnRenamed("id", "batch")
    each = lambda n: batches.select("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i")) if n else batches.select("batch", F.lit(0).cast("long").alias("i")).filter("false")
    base = F.col("batch") * own
    pick = lambda kind, n: F.floor(uniform(seed, F.lit(kind), "batch", "i") * n).cast("long")
    name = lambda kind, names: F.get(F.lit(names), (drawn(seed, F.lit(kind), "batch", "i") % len(names)).cast("int"))
    row = lambda df, kind, a, b, label: df.select("batch", F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), label.alias("label"), F.lit(None).cast("long").alias("example"))
    first = vertices + F.col("i") * len(labels)
    out = row(each(vertices), "v", base + F.col("i"), F.lit(None), name("v", vertex_labels))
    x, step = pick("x", vertices), pick("y", vertices - 1) + 1
    out = out.union(row(each(edges), "u", base + x, base + (x + step) % vertices, name("e", edge_labels)))
    for k, label in enumerate(labels):
        out = out.union(row(each(copies), "v", base + first + k, F.lit(None), F.lit(label)))
    for a, b, label, directed in links:
        out = out.union(row(each(copies), "d" if directed else "u", base + first + a, base + first + b, F.lit(label)))
    out = out.union(row(each(copies), "u", base + first, base + pick("h", vertices), name("g", edge_labels)))
    return out.union(row(each(spanning).filter("batch > 0"), "u", base + pick("s", own), base - own + pick("t", own), name("z", edge_labels)))
