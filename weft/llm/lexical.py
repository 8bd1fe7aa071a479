"""Ranked lexical search over a tiered index: the postings of highest impact are read first, and an item goes on to lower tiers only where
its first twenty aren't proved yet.

``build`` writes an index of every term of every document. Documents are dealt to shards of bounded size as they are read; within a shard a
term's postings are ordered by impact and cut into tiers of 64, the next 448, and the rest. Each cut keeps its residual bound, the largest
impact below it. No posting is shuffled, so a term that a third of all documents hold is as many short lists as there are shards.

``search`` reads the first tier of all shards. That gives each item a lower bound of its k-th score (``floor``), and each pair of item and
shard an upper bound of every score that isn't exact yet: what was seen, and the residual bounds of the terms not seen. A pair whose upper
bound is below the item's floor is proved. The others fall through and are scored again from one more tier, until the last tier, after which
every score is exact. So the result is always whole; tiers only decide how much is read.

Null texts have no terms; documents without a term are in no count and no result; an item without terms, or with terms that no document
holds, has no row. Each row of either table stands for itself: repeated rows and repeated or null ids are ranked one by one (null doc_ids last
among equal scores). Other columns, whatever their names, are ignored. Terms are kept as bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import batch_rows, cut, drop, fresh_path, put, small_batches

TOP = 20
#: Postings of a term in a shard by tier: up to the first number in tier 0, up to the second in tier 1, the rest in tier 2.
TIERS = (64, 512)
#: A shard ends at so many documents or postings, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 8_192, 1_000_000
#: At most about so many items are scored together against a shard.
GROUP_ITEMS = 256
#: A-Z to a-z, all other ASCII but digits and letters to a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: A term's postings in a shard and a tier. Tier -1 holds a shard's doc_ids as impacts.
BLOCKS = "shard long, term binary, rest long, docs array<int>, impacts array<long>, tier int"


class Index(NamedTuple):
    """Where the tiers are, how many documents have a term, and how many terms they have."""

    path: str
    n_docs: int
    n_terms: int


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, tfs): the distinct terms of each row's ``text`` with their counts; rows without a term are left out."""
    small_batches(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n, ends, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if found := Counter((text or b"").translate(_BYTES).split()):
                    keep.append(i)
                    n.append(found.total())
                    terms += found
                    tfs += found.values()
                    ends.append(len(terms))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.binary())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int32()))], names=["key", "n", "terms", "tfs"])

    got = rows.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return got.mapInArrow(run, "key long, n long, terms array<binary>, tfs array<int>").withColumnRenamed("key", key)


def _shard(batches: list[pa.RecordBatch], number: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one shard, and its list of doc_ids as a row of tier -1. Documents are numbered by doc_id, so ties go by number."""
    t = pa.Table.from_batches(batches)
    t = t.take(pa.compute.sort_indices(t, sort_keys=[("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
    terms, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
    n = t.column("n").to_numpy()
    m = 75 + 25 * n * n_docs // n_terms
    doc = np.repeat(np.arange(len(n), dtype=np.int32), pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))
    tf = tfs.flatten().to_numpy().astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    coded = terms.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.lexsort((doc, -impact, code))
    code, doc, impact = code[order], doc[order], impact[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    at = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    tier = np.searchsorted(TIERS, at, side="right")
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tier[1:] != tier[:-1])])
    after = np.r_[start[1:], len(code)]
    more = np.r_[code[start[1:]] == code[start[:-1]], False]
    rest = np.where(more, impact[np.minimum(after, len(code) - 1)], 0)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("rest", pa.int64()), ("docs", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64())), ("tier", pa.int32())])
    ids = t.column("doc_id").combine_chunks()
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.binary()), pa.array([0], pa.int64()), _lists(np.arange(len(n)), np.array([0, len(n)]), pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), ids), pa.array([-1], pa.int32())], schema=schema)
    bounds = np.r_[start, len(code)]
    for a in range(0, len(start), 4096):
        z = min(a + 4096, len(start))
        lo, hi, ends = bounds[a], bounds[z], bounds[a : z + 1] - bounds[a]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, number), pa.int64()), coded.dictionary.take(pa.array(code[start[a:z]])), pa.array(rest[a:z], pa.int64()), _lists(doc[lo:hi], ends, pa.int32()), _lists(impact[lo:hi], ends, pa.int64()), pa.array(tier[start[a:z]], pa.int32())], schema=schema)


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> Index:
    """Write the index of ``docs`` (doc_id, text) to the shared folder."""
    spark = docs.sparkSession
    forward, where = put(term_counts(docs, "doc_id"), "terms")
    n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_held, postings, number = [], 0, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            size = len(b.column(3).flatten())
            if held and (docs_held + b.num_rows > shard_docs or postings + size > shard_postings):
                yield from _shard(held, number, n_docs, n_terms)
                held, docs_held, postings, number = [], 0, 0, number + 1
            held, docs_held, postings = [*held, b], docs_held + b.num_rows, postings + size
        if docs_held:
            yield from _shard(held, number, n_docs, n_terms)

    path = fresh_path(spark, "index")
    with batch_rows(spark, max(1, min(256, shard_docs))):
        forward.mapInArrow(run, BLOCKS).write.partitionBy("tier").parquet(path)
    drop(where)
    return Index(path, n_docs, n_terms)


def _weighted(tiers: DataFrame, index: Index, items: DataFrame) -> DataFrame:
    """(term, part, refs): for each term of an item with a weight above 0, the items of one part that hold it and what an impact counts for them."""
    terms = items.select("item", "part", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("item", "part", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("times"))
    df = tiers.filter("tier >= 0").select("term", F.size("docs").cast("long").alias("n")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    got = terms.join(df.select("term", weight.alias("w")).filter("w > 0"), "term")
    return got.groupBy("term", "part").agg(F.collect_list(F.struct("item", (F.col("times") * F.col("w")).alias("weight"))).alias("refs"))


def _scored(k: int, tier: int):
    """For the blocks of one shard and one part of the items: per item the first ``k`` documents by what is known, and the bound of all others."""

    def run(t: pa.Table) -> pa.Table:
        refs = t.column("refs").combine_chunks()
        item, weight = (refs.flatten().field(c).to_numpy() for c in ("item", "weight"))
        ends = np.r_[0, np.cumsum(pa.compute.list_value_length(refs).to_numpy(zero_copy_only=False))]
        docs, impacts = t.column("docs").combine_chunks(), t.column("impacts").combine_chunks()
        cuts = np.r_[0, np.cumsum(pa.compute.list_value_length(docs).to_numpy(zero_copy_only=False))]
        docs, impacts = docs.flatten().to_numpy(), impacts.flatten().to_numpy()
        words, at = t.column("term").to_pylist(), t.column("tier").to_numpy()
        below = {w: r for w, r, x in zip(words, t.column("rest").to_numpy(), at, strict=True) if x == tier}
        items, own = np.unique(item, return_inverse=True)
        known = np.zeros((len(items), int(docs.max()) + 1), np.int64)
        seen, rest = np.zeros_like(known) if any(below.values()) else None, np.zeros(len(items), np.int64)
        for r, word in enumerate(words):
            d, v, left = docs[cuts[r] : cuts[r + 1]], impacts[cuts[r] : cuts[r + 1]], below.get(word, 0)
            for i, w in zip(own[ends[r] : ends[r + 1]], weight[ends[r] : ends[r + 1]], strict=True):
                known[i, d] += w * v
                if left:
                    seen[i, d] += w * left
                    if at[r] == tier:
                        rest[i] += w * left
        out = {"item": [], "shard": [], "bound": [], "docs": [], "scores": []}
        for i, number in enumerate(items):
            top = np.flatnonzero(known[i] > 0)
            if len(top) > k:
                least = np.partition(known[i][top], len(top) - k)[len(top) - k]
                top = top[known[i][top] >= least]
            top = top[np.lexsort((top, -known[i][top]))][:k]
            bound = 0
            if rest[i]:
                open_ = seen[i] < rest[i]
                bound = max(int(rest[i]), int((known[i] + rest[i] - seen[i])[open_].max(initial=0)))
            for name, x in zip(out, (int(number), t.column("shard")[0].as_py(), bound, top.tolist(), known[i][top].tolist()), strict=True):
                out[name].append(x)
        return pa.table(out, schema=pa.schema([("item", pa.int64()), ("shard", pa.int64()), ("bound", pa.int64()), ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64()))]))

    return run


def search(index: Index, items: DataFrame, k: int = TOP, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest scores for each row of ``items`` (item_id, text)."""
    spark = items.sparkSession
    tiers = spark.read.schema(BLOCKS).parquet(index.path)
    rows, _ = put(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    parts = max(1, -(-rows.count() // group_items))
    asked = cut(_weighted(tiers, index, term_counts(rows, "item").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))), "asked")
    floor = rows.select("item", F.lit(1).cast("long").alias("floor"))
    proved, pending = [], None
    for tier in range(len(TIERS) + 1):
        got = tiers.filter((F.col("tier") >= 0) & (F.col("tier") <= tier)).join(asked, "term")
        if pending is not None:
            got = got.join(pending, ["shard", "part"]).withColumn("refs", F.expr("filter(refs, r -> array_contains(open, r.item))")).filter("size(refs) > 0").drop("open")
        found = cut(got.select("shard", "part", "term", "tier", "rest", "docs", "impacts", "refs").groupBy("shard", "part").applyInArrow(_scored(k, tier), "item long, shard long, bound long, docs array<int>, scores array<long>"), f"tier{tier}")
        # the k-th lower bound of each item so far; an earlier one stays true
        by = Window.partitionBy("item").orderBy(F.desc("score"))
        kth = found.select("item", F.explode("scores").alias("score")).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k)
        kth = kth.groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
        floor = cut(floor.join(kth, "item", "left").select("item", F.greatest("floor", F.coalesce("kth", F.lit(1))).alias("floor")), "floor")
        judged = found.join(floor, "item").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
        proved.append(judged.filter("bound < floor"))
        if tier < len(TIERS):
            pending = cut(judged.filter("bound >= floor").groupBy("shard", "part").agg(F.collect_list("item").alias("open")), "open")
            if pending.isEmpty():
                break
    whole = proved[0]
    for more in proved[1:]:
        whole = whole.unionByName(more)
    best = whole.select("item", "shard", "floor", F.explode(F.arrays_zip("docs", "scores")).alias("x")).select("item", "shard", F.col("x.docs").alias("doc"), F.col("x.scores").alias("score"), "floor").filter("score >= floor")
    ids = tiers.filter("tier = -1").select("shard", F.explode(F.arrays_zip("docs", "impacts")).alias("x")).select("shard", F.col("x.docs").alias("doc"), F.col("x.impacts").alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "shard", "doc")
    ranked = best.join(ids, ["shard", "doc"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
