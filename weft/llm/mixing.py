"""Mixing sources to target weights: sizes are summed per source, targets follow from weights and a limit on repetition, and each document is
emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with the fraction as its probability.

A source's target is its weight's share of ``share`` percent of all sizes, but at most ``most`` times what the source has; what is cut off goes to the
other sources by weight, until none is above its limit. Each such round is one aggregation over the table of sources; a round that
limits no further source is the last. Sources never come to the driver, and their weights follow from their place in code point order, which
is counted in ranges of sources, not in one sorted task.

Copies are decided row by row by an MD5 number of the seed, the doc_id and the text, so reruns agree whatever is lost and wherever a row is
read. Rows that share a doc_id draw on their own as long as their texts differ; wholly equal rows draw alike. A null text has size 0 and a
null source is a source of its own, the last. A source of size 0 has target 0 and rate 0. With an empty table the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import cut, put

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Percent of all sizes that the mix has, and how often a source may be repeated.
SHARE, MOST = 150, 2
SEED = 7
#: The table of sources is broadcast up to so many rows and so many bytes of names.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 65_536, 8 << 20
SPACES = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """How many runs of anything but blanks and ASCII line ends a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to below 1, from 48 bits of an MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def places(sources: DataFrame) -> DataFrame:
    """``sources`` (source distinct) with ``place``, from 0 in code point order, null last: ranges are numbered within and shifted by what is before."""
    ranged = cut(sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("none", "source"))
    return ranged.join(F.broadcast(before), "part").withColumn("place", F.col("before") + at - 1).drop("part", "before", "none")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size). Sums are exact: a limit is compared as a product of whole numbers, and a target is one
    division."""
    if not weights or min(weights) <= 0 or share < 0 or share > 100 * most:
        raise ValueError("weights must be above 0, and the share within what the limits allow")
    per = places(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    table = cut(per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")), "sources")
    whole = (table.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0) * share  # in hundredths
    left, weight, limited = whole, table.agg(F.sum("weight")).first()[0] or 0, -1
    big = lambda c: F.col(c).cast("decimal(20,0)")
    while weight:
        full = big("source_size") * (100 * most) * F.lit(str(weight)).cast("decimal(17,0)") <= F.lit(str(left)).cast("decimal(38,0)") * big("weight").cast("decimal(10,0)")
        n, taken, open_ = table.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size").cast("decimal(38,0)"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == limited:
            break
        left, weight, limited = whole - (taken or 0) * 100 * most, open_ or 0, n
    limit = (F.col("source_size") * most).cast("double")
    shared = (F.lit(str(left)).cast("decimal(38,0)").cast("double") * F.col("weight")) / F.lit(float(100 * weight)) if weight else limit
    return table.select("source", "source_size", F.least(limit, shared).alias("target"))


def rated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, rate and copies. Texts are read once; what follows works on sizes and draws."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    rows, _ = put(rows, "sizes")
    table, _ = put(targets(rows, weights, share, most), "targets")
    n, held = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    side = table.withColumnRenamed("source", "own")
    side = F.broadcast(side) if n <= MAX_BROADCAST and held <= MAX_BROADCAST_BYTES else side
    got = rows.join(side, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    return got.withColumn("rate", rate).withColumn("copies", whole + (F.col("draw") < F.col("rate") - whole).cast("long")).drop("draw")


def digest(docs: DataFrame, **kw) -> DataFrame:
    """Per document what the mix takes of it."""
    return rated(docs, **kw).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, copy: str = "copy", seed: int = SEED, **kw) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, all columns as they were and the number of the copy, from 0, in ``copy``
    (a name that ``docs`` doesn't have). The texts aren't shuffled: rates are joined by source, and each row draws for itself again."""
    if copy in docs.columns:
        raise ValueError(f"there is a column {copy} already")
    table, _ = put(targets(docs.select("source", size_of(F.col("text")).alias("size")), **kw), "targets")
    n, held = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    side = table.select(F.col("source").alias("own"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    side = F.broadcast(side) if n <= MAX_BROADCAST and held <= MAX_BROADCAST_BYTES else side
    got = docs.toDF(*names).join(side, F.col(own["source"]).eqNullSafe(F.col("own")))
    copies = F.floor("rate") + (draw(F.col(own["doc_id"]), F.col(own["text"]), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return got.withColumn("copies", copies).filter("copies > 0").select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("at")).toDF(*docs.columns, copy)
