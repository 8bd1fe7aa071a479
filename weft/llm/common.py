"""Helpers that several operators share: words, the shared folder, and the next row in key order."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.rest import cut, drop, fresh_path, put  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words (after lower-casing A-Z): all ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the built-in's fast path; only other texts need the slower translation."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The array of words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def small_batches(spark: SparkSession, rows: int = 256, size: int = 4 << 20) -> None:
    """Texts go to Python a few hundred rows or ``size`` bytes at a time: a batch of the default ten thousand would hold too much of a
    worker's memory. The plans that follow are lazy, so the setting stays with the session; it never changes a result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def kept_rows(docs: DataFrame, good: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text is good, judged a batch at a time in Python; every column passes once and comes back as it was."""
    small_batches(docs.sparkSession)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(good(b.column(text)), pa.bool_()))

    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    plain = docs.toDF(*names)
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, docs.schema, strict=True))
    return plain.mapInArrow(run, kinds).toDF(*docs.columns)


#: The column that ``numbered`` adds, unless another name is given.
ROW = "__row"


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str = "numbered", row: str = ROW) -> tuple[DataFrame, str]:
    """``df`` with a unique number per row in ``row`` (a name that ``df`` doesn't have, see ``unused``), at rest, and its path: however often it is
    read, and whatever is lost, a row keeps its number."""
    if row != unused(row, df.columns):
        raise ValueError(f"there is a column {row} already")
    return put(df.withColumn(row, F.monotonically_increasing_id()), name)


def by_row(df: DataFrame, rows: DataFrame, how: str, row: str = ROW, size: Column | None = None, most: int = 1 << 20, most_bytes: int = 32 << 20) -> DataFrame:
    """A numbered table (number in ``row``) joined with ``rows`` (at rest, a number at most once, in ``ROW``) on the number. Up to ``most`` rows that
    hold up to ``most_bytes`` by ``size`` (bytes of a row beyond its number) are broadcast, so no text is shuffled; more are joined by
    shuffle on the number, which no two rows share."""
    n, held = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(8) if size is None else size), F.lit(0))).first()
    rows = rows.withColumnRenamed(ROW, row) if row != ROW else rows
    return df.join(F.broadcast(rows) if n <= most and held <= most_bytes else rows, row, how)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """For what runs inside: Python gets so many rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_next(df: DataFrame, key: str, order: list[str], carry: list[str], name: str = "next", rows_per_bucket: int = 256, max_buckets: int = 100_000) -> DataFrame:
    """Add a struct column ``name`` with the ``carry`` columns of the next row by (key, *order); the last row gets the first one's.

    Rows are dealt into buckets of neighbouring keys of about ``rows_per_bucket`` rows each (quantiles of the key: a driver-side list of
    at most ``max_buckets`` numbers, beyond which buckets grow instead). Within a bucket it is a plain ``lead``; the first key of every
    bucket is also sent to the bucket before it. So there is one shuffle and no task sees more than its buckets, whatever the keys' gaps.
    A null key sorts first. Rows with the same key stay in one bucket, ordered by ``order``; wholly equal rows follow each other.
    """
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("long").alias("k"))
    n, nulls = keys.agg(F.count(F.lit(1)), F.count_if(F.col("k").isNull())).first()
    n_buckets = max(1, min(max_buckets, math.ceil(n / rows_per_bucket)))
    at = [i / n_buckets for i in range(1, n_buckets)]
    cuts = sorted(set(keys.agg(F.percentile_approx("k", at, 10 * n_buckets)).first()[0] or [])) if at and n > nulls else []
    # bucket = how many cuts are <= key, in two steps of about sqrt(n) comparisons
    if cuts:
        step = max(1, math.isqrt(len(cuts)))
        fine, coarse = F.lit(cuts), F.lit(cuts[::step])
        k = F.col("__k")
        block = F.greatest(F.size(F.filter(coarse, lambda c: c <= k)) - 1, F.lit(0)) * step
        bucket = F.when(k.isNull(), 0).otherwise(block + F.size(F.filter(F.slice(fine, block + 1, step), lambda c: c <= k)))
    else:
        bucket = F.lit(0)
    placed = df.withColumn("__k", F.col(key).cast("long")).withColumn("__b", bucket.cast("int"))
    # the smallest key of each bucket (null counts as smallest), on the key column alone: at most max_buckets rows come to the driver
    firsts = sorted(keys.select(F.col("k").alias("__k")).groupBy(bucket.cast("int").alias("b")).agg(F.min("__k").alias("k"), F.count_if(F.col("__k").isNull()).alias("nulls")).collect())
    if not firsts:
        return df.withColumn(name, F.struct(*carry))
    before = [(firsts[i - 1].b, None if f.nulls else f.k, bool(f.nulls)) for i, f in enumerate(firsts)]
    guests = spark.createDataFrame([(f.b, to, k, isnull, i == 0) for i, (f, (to, k, isnull)) in enumerate(zip(firsts, before, strict=True))], "__b int, __to int, __first long, __null boolean, __wrap boolean")
    if len(firsts) == 1:
        (f,), ((to, k, isnull),) = firsts, before
        placed = placed.withColumns({"__to": F.lit(to), "__first": F.lit(k).cast("long"), "__null": F.lit(isnull), "__wrap": F.lit(True)})
    else:
        placed = placed.join(F.broadcast(guests), "__b")  # at most max_buckets short rows
    is_first = F.when(F.col("__null"), F.col("__k").isNull()).otherwise(F.col("__k") == F.col("__first"))
    copies = F.when(F.coalesce(is_first, F.lit(False)), F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("__to").alias("b"), F.when(F.col("__wrap"), 2).otherwise(1).alias("guest")))).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest"))))
    dealt = placed.select(*df.columns, F.explode(copies).alias("__d"))
    dealt = dealt.select(*df.columns, F.col("__d.b").alias("__bucket"), F.col("__d.guest").alias("__guest"))
    w = Window.partitionBy("__bucket").orderBy("__guest", F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    # a guest sorts after its host bucket's own rows: guest 1 follows by key anyway, guest 2 is the table's first row seen from its last bucket
    return dealt.withColumn(name, F.lead(F.struct(*carry)).over(w)).filter("__guest = 0").drop("__bucket", "__guest")
