"""Graphs derived from relational tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.core import canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, least: int = 40) -> DataFrame:
    """Distinct pairs of parts ordered together with a quantity of at least ``least`` each; w = 1."""
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= least).select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    a, b = l.toDF("o", "u"), l.toDF("o", "v")
    return a.join(b, "o").filter("u < v").select("u", "v").distinct().withColumn("w", F.lit(1).cast("long"))


def parts45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, 45)


#: Rows of lineitem that meet in one task of ``suppliers``.
ROWS = 250_000


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier pairs on the same order; w = how often.

    Rows and pairs are dealt to a number of partitions that follows the table's rows, so what a task holds of them doesn't grow with the table.
    """
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").cast("long").alias("s"))
    n = -(-l.count() // ROWS)
    many = n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    l = l.repartition(n, "o") if many else l
    pairs = l.toDF("o", "u").join(l.toDF("o", "v"), "o").filter("u < v").select("u", "v")
    if not many:
        return canonical(pairs)
    return pairs.repartition(n, "u", "v").groupBy("u", "v").agg(F.sum(F.lit(1).cast("long")).alias("w"))  # u < v: the dealing serves the sums as it is


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (customer, supplier) pairs: a bipartite graph; supplier ids are negated so that the sides differ."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select((-F.col("l_suppkey")).alias("u"), F.col("o_custkey").alias("v")).distinct().withColumn("w", F.lit(1).cast("long"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal pairs (ts, src, trg): users of consecutive events by (ts, event_id), where they differ.

    Consecutive is within an hour bucket plus the last event before it, so that the order needs no single task.
    """
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.date_trunc("hour", "ts").alias("h"))
    w = Window.partitionBy("h").orderBy("ts", "event_id")
    own = e.withColumn("prev", F.lag("user_id").over(w))
    last = e.groupBy("h").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    before = last.withColumn("hb", F.lag("last").over(Window.orderBy("h"))).select("h", "hb")  # one row per hour
    both = own.join(F.broadcast(before), "h").withColumn("prev", F.coalesce("prev", "hb"))
    return both.filter("prev IS NOT NULL AND prev <> user_id").select("ts", F.col("prev").alias("src"), F.col("user_id").alias("trg"))


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) with labels: customers by segment, orders by status, suppliers as such; placed and nation edges.

    Vertices (vid, label, example), edges (v1, v2, label, directed); an example is a customer's nation.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    oc = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_nationkey")
    vid = lambda col, k: F.col(col).cast("long") * 4 + k
    v = (
        c.select(vid("c_custkey", 0).alias("vid"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").cast("long").alias("example"))
        .union(oc.select(vid("o_orderkey", 1), F.concat(F.lit("order-"), "o_orderstatus"), F.col("c_nationkey").cast("long")))
        .union(n.select(vid("n_nationkey", 2), F.lit("nation"), F.col("n_nationkey").cast("long")))
    )
    e = oc.select(vid("o_custkey", 0).alias("v1"), vid("o_orderkey", 1).alias("v2"), F.col("o_orderpriority").alias("label"), F.lit(True).alias("directed")).union(c.select(vid("c_custkey", 0), vid("c_nationkey", 2), F.lit("in"), F.lit(False)))
    return v, e


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href) for every link of every page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


PARTS_SQL = """l AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= {least}),
g AS (SELECT DISTINCT a.p AS u, b.p AS v, CAST(1 AS BIGINT) AS w FROM l a JOIN l b ON a.o = b.o AND a.p < b.p)"""
PARTS, PARTS45 = PARTS_SQL.format(least=40), PARTS_SQL.format(least=45)
SUPPLIERS = """g AS (SELECT a.l_suppkey AS u, b.l_suppkey AS v, CAST(count(*) AS BIGINT) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)"""
BUYERS = """g AS (SELECT DISTINCT -l_suppkey AS u, o_custkey AS v, CAST(1 AS BIGINT) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
USERS = """t AS (SELECT ts, prev AS src, user_id AS trg FROM (SELECT ts, user_id, lag(user_id) OVER (ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND prev <> user_id)"""
LABELLED = """oc AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
sv AS (SELECT c_custkey * 4 AS vid, c_mktsegment AS label, CAST(c_nationkey AS BIGINT) AS example FROM customer UNION ALL SELECT o_orderkey * 4 + 1, 'order-' || o_orderstatus, CAST(c_nationkey AS BIGINT) FROM oc UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 2, 'nation', CAST(n_nationkey AS BIGINT) FROM nation),
se AS (SELECT o_custkey * 4 AS v1, o_orderkey * 4 + 1 AS v2, o_orderpriority AS label, true AS directed FROM oc UNION ALL SELECT c_custkey * 4, CAST(c_nationkey AS BIGINT) * 4 + 2, 'in', false FROM customer)"""


def draw_sql(seed: object, *cols: object, digits: int = 13) -> str:
    """The SQL of ``randgraph.drawn``."""
    return f"CAST('0x' || left(md5(concat_ws(',', {', '.join(map(str, cols))}, {seed})), {digits}) AS BIGINT)"


def uniform_sql(seed: object, *cols: object) -> str:
    return f"({draw_sql(seed, *cols)} / 4503599627370496.0::DOUBLE)"
