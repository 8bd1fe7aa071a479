"""Discovery over increments: the best substructures of each increment are found in it alone, followed from then on, and counted over the
whole graph so far, with the instances that span increments.

State is four tables in a shared folder, each with a partition a batch: vertices, labelled edges, substructures that are followed, and their chosen
instances. An increment brings new edges; instances of followed substructures that hold one of them are found by joins that start from the new
edges and grow over old ones, so an instance that was cut off at the edge of an earlier increment is completed when its last edge comes, and
nothing else of the old graph is read again. A substructure that is new gets its earlier instances once, from the whole graph.

Instances are disjoint: in order of arrival (the batch of the last edge) and then of their vertices and edges, an instance is chosen if it shares
no vertex with one chosen before. So what an increment adds never takes back what was chosen, and after any number of increments the
state is what one run over the union gives (``chosen``). A batch that is run again replaces its own rows, which keeps ``foreachBatch`` exact.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators import substructure as sub
from weft.operators.rest import cut

_VERTICES = "vid BIGINT, label STRING, example BIGINT, batch INT"
_EDGES = "eid BIGINT, v1 BIGINT, v2 BIGINT, label STRING, directed BOOLEAN, l1 STRING, l2 STRING, batch INT"
_FOLLOWED = "canon STRING, batch INT"
_CHOSEN = "canon STRING, vs ARRAY<BIGINT>, es ARRAY<BIGINT>, arrival INT, batch INT"


def _all(le: DataFrame, canons: Iterable[str], fresh=None) -> DataFrame | None:
    out = None
    for c in canons:
        part = sub.instances_of(le, c, fresh)
        out = part if out is None else out.union(part)
    return out


def chosen(le: DataFrame, canons: Iterable[str]) -> DataFrame:
    """(canon, vs, es, arrival): the disjoint instances of each substructure over a whole graph whose edges know their batch."""
    found = cut(_all(le, canons), "instances")
    return found.join(sub.disjoint(found, F.col("arrival")), ["canon", "vs", "es"], "left_semi")


def _size(canon: str) -> int:
    labels, edges = sub.parse(canon)
    return len(labels) + len(edges)


def by_increment(v: DataFrame, e: DataFrame, canons: list[str]) -> DataFrame:
    """(batch, canon, instances, value) after each increment, in one run over the union: vertices (vid, label, batch) and edges (eid, v1, v2, label,
    directed, batch) know their increment. The value is the graph's size over that of the substructure and the compressed graph."""
    le = cut(sub.with_labels(v, e), "edges")
    picked = chosen(le, canons).groupBy("canon", F.col("arrival").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    sizes = v.groupBy("batch").agg(F.count(F.lit(1)).alias("s")).union(e.groupBy("batch").agg(F.count(F.lit(1)).alias("s"))).groupBy("batch").agg(F.sum("s").alias("s"))
    sizes = sizes.select("batch", F.sum("s").over(Window.orderBy("batch")).alias("size"))  # a row an increment
    own = v.sparkSession.createDataFrame([(c, _size(c)) for c in canons], "canon string, own long")
    each = sizes.join(F.broadcast(own)).join(picked, ["batch", "canon"], "left")  # increments times substructures
    k = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("canon").orderBy("batch"))
    return each.withColumn("instances", k).select("batch", "canon", "instances", _value(F.col("size"), F.col("own"), F.col("instances")).alias("value"))


def _value(size, own, k):
    """An instance's vertices and edges become one vertex."""
    return size / (own + size + k - k * own)


class IncrementalDiscovery:
    """Feed increments of rows (kind 'v', 'd' or 'u'; a, b ids; label; example) and ask for the best substructures so far.

    ``options`` says how an increment is searched. A vertex or an edge that comes again is the one that is there.
    """

    def __init__(self, spark: SparkSession, folder: str, options: sub.Search = sub.Search()):  # noqa: B008
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options

    def _table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        try:
            t = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as x:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(x):
                raise
            t = self.spark.createDataFrame([], schema)
        return t if before is None else t.filter(F.col("batch") < before)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def followed(self, before: int | None = None) -> list[str]:
        """Canonical strings of the substructures that were found so far: at most ``options.report`` an increment."""
        return sorted({r.canon for r in self._table("followed", _FOLLOWED, before).select("canon").distinct().collect()})

    def follow(self, canons: Iterable[str]) -> None:
        """Follow given substructures (canonical strings) from the first increment on, whatever the increments' own searches find."""
        if self._table("followed", _FOLLOWED, None).filter("batch >= 0").count():
            raise ValueError("increments have been taken in already")
        self._write(self.spark.createDataFrame([(c,) for c in canons], "canon string"), "followed", -1)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take in one increment."""
        v = rows.filter("kind = 'v'").select(F.col("a").alias("vid"), "label", "example").dropDuplicates(["vid"])
        self._write(v.join(self._table("vertices", _VERTICES, batch).select("vid"), "vid", "left_anti"), "vertices", batch)
        seen = self._table("vertices", _VERTICES, batch + 1)
        e = sub.with_ids(rows.filter("kind <> 'v'").select(F.col("a").alias("v1"), F.col("b").alias("v2"), "label", (F.col("kind") == "d").alias("directed")))
        e = e.join(self._table("edges", _EDGES, batch).select("eid"), "eid", "left_anti")
        self._write(sub.with_labels(seen, e).select("eid", "v1", "v2", "label", "directed", "l1", "l2"), "edges", batch)
        le = self._table("edges", _EDGES, batch + 1)
        now = le.filter(F.col("batch") == batch)
        ends = now.select(F.explode(F.array("v1", "v2")).alias("vid")).distinct()
        here = seen.filter(F.col("batch") == batch).union(seen.join(ends, "vid", "left_semi").select(seen.columns)).drop("batch").dropDuplicates(["vid"])
        local = sub.discover(here, now.select("v1", "v2", "label", "directed"), self.options)
        old = self.followed(batch)
        new = sorted({r.canon for r in local.select("canon").collect()} - set(old))
        new = [c for c in new if sub.parse(c)[1]]
        self._write(self.spark.createDataFrame([(c,) for c in new], "canon string"), "followed", batch)
        parts = [x for x in (_all(le, old, F.col("batch") == batch), _all(le, new)) if x is not None]
        if not parts:
            self._write(self.spark.createDataFrame([], _CHOSEN).drop("batch"), "chosen", batch)
            return
        found = cut(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), "instances")
        taken = self._table("chosen", _CHOSEN, batch).select("canon", F.explode("vs").alias("vid"))
        spoilt = found.select("canon", "vs", "es", F.explode("vs").alias("vid")).join(taken, ["canon", "vid"], "left_semi").select("canon", "vs", "es").distinct()
        free = cut(found.join(spoilt, ["canon", "vs", "es"], "left_anti"), "free")
        self._write(free.join(sub.disjoint(free, F.col("arrival")), ["canon", "vs", "es"], "left_semi").select("canon", "vs", "es", F.col("arrival").cast("int").alias("arrival")), "chosen", batch)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """All vertices and edges so far, with the batch they came in."""
        return self._table("vertices", _VERTICES), self._table("edges", _EDGES)

    def instances(self) -> DataFrame:
        """(canon, vs, es, arrival) of the chosen instances so far."""
        return self._table("chosen", _CHOSEN).select("canon", "vs", "es", "arrival")

    def values(self, by: str = "size") -> DataFrame:
        """(canon, instances, examples, value) over all increments. By size, the state's counts are enough; other values read the whole graph."""
        if by != "size":
            v, e = self.graph()
            return sub.evaluate(self.instances(), v, e, by)
        v, e = self.graph()
        size = v.count() + e.count()
        first = self.instances().select("canon", F.element_at("vs", 1).alias("vid")).join(v.select("vid", "example"), "vid")
        k = first.groupBy("canon").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("example").alias("examples"))
        own = self.spark.createDataFrame([(c, _size(c)) for c in self.followed()], "canon string, own long")
        return k.join(F.broadcast(own), "canon").select("canon", "instances", "examples", _value(F.lit(size), F.col("own"), F.col("instances")).alias("value"))

    def best(self, k: int = 3, by: str = "size") -> DataFrame:
        """The best substructures over all increments (a top-k report)."""
        return self.values(by).orderBy(F.desc("value"), "canon").limit(k)

    def stream(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a streaming source of such rows until it is exhausted; one micro-batch is one increment."""
        return source.writeStream.foreachBatch(lambda df, i: self.add(df, int(i))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
