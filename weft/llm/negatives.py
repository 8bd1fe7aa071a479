"""Hard-negative mining over one-dimensional distance keys.

Vectors are augmented by one component so that all have the same length; then a larger inner product with an anchor is a smaller distance from
the anchor's vector augmented by zero. ``build`` gives each vector the nearest of some pivots and its distance from it, and stores vectors sorted by
(label, pivot, distance) in blocks. By the triangle inequality a block whose keys go from ``lo`` to ``hi`` holds nothing nearer to an anchor
than the gap between the anchor's own distance from the pivot and [lo, hi], and nothing farther than that distance plus ``hi``.

``search`` visits, for each search, the blocks in order of that gap: an interval of keys around the anchor that grows from round to round, eight times
as many blocks each. Once a search has k rows, a block whose gap exceeds the k-th row's distance can't change it; when no other is left, the
k rows are certified. With an upper limit on scores, blocks that are wholly nearer are passed over, so the search runs over an annulus. Rows are
compared by whole-number inner products (exact in doubles; above 2^53 an error is raised); distances only choose blocks, with a margin for rounding.
Where keys don't separate (random vectors of many dimensions) every block of the labels asked for is visited, and the result is as exact.

Equal vectors of one label are one entry with its first ids: all have the same score with any anchor and ties go by id, so later copies can't be
in a list of so many. Anchors with equal vectors and labels share a search. So a third of all rows being one vector costs one entry and one search.

Rows with a null label, a null vector, or a null or non-finite component take no part. A shorter vector counts as filled up with zeros; an
empty one is all zeros. A null vec_id is no anchor and comes last among ties. Rows that share a vec_id are rows of their own. Without an
anchor or another label the result is empty. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import batch_rows, cut, put, small_batches

POSITIVES, NEGATIVES = 5, 10
#: Pivots are picked from so many vectors, first by a hash; they only shape the blocks.
SAMPLE, MOST_PIVOTS = 4_096, 64
#: Rows of a block and searches of a chunk; blocks grow beyond so many, so that their directory (five numbers each) can go to every task.
BLOCK, CHUNK, MOST_BLOCKS = 1_024, 1_024, 65_536
#: How many blocks a search visits in its first round, and how many times as many in each that follows.
FIRST, GROWTH = 8, 8
#: Labels are dealt to so many groups, which the blocks are sorted by; up to so many small whole-number labels have a group each.
GROUPS = 1_024
EXACT = float(1 << 53)


class Index(NamedTuple):
    """Blocks at rest, their directory (group, pivot, lo, hi by number of block), whether a group has one label only, the pivots and the augmented
    length, squared."""

    blocks: DataFrame
    directory: np.ndarray
    alone: bool
    pivots: np.ndarray
    length: float
    dim: int


def usable(rows: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, q) of the rows that take part, at rest: ``q`` is floor(scale * x) of each component, and rows have a number."""
    x = F.col("embedding")
    wide = F.transform(x, lambda v: v.cast("double"))
    good = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    q = F.transform(wide, lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    got = rows.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), q.alias("q"))
    return cut(got.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q"), "vectors")


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, label, q, first): distinct (label, vector) pairs, at rest, with their first ``keep`` rows (vec_id, row) in order of vec_id."""
    order = Window.partitionBy("label", "q").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    ranked = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep)
    got = ranked.groupBy("label", "q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "row"))).alias("first"))
    return cut(got.select(F.monotonically_increasing_id().alias("cid"), "label", "q", "first"), "classes")


def _matrix(q: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows of ``dim`` numbers, filled up with zeros."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    n = pa.compute.list_value_length(q).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = q.flatten().to_numpy()
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the rows at most, each the farthest from those before: they cover clusters of any size."""
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def build(known: DataFrame, block: int = BLOCK) -> Index | None:
    """The index of the rows of ``classes``; None without rows."""
    spark = known.sparkSession
    squared = F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)
    group = F.pmod("label", F.lit(GROUPS)).cast("int")
    n, dim, length = known.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(squared)).first()
    if not n:
        return None
    alone = known.select("label").distinct().groupBy(group).count().filter("count > 1").isEmpty()
    if length >= EXACT:
        raise ValueError("inner products of these vectors aren't exact in doubles")
    size = max(block, -(-n // MOST_BLOCKS))

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(length - (x * x).sum(1), 0))]

    few = known.orderBy(F.xxhash64("q", "label"), "cid").limit(SAMPLE).select("q").toArrow()
    pivots = _spread(lifted(_matrix(few.column(0), dim)), max(1, min(MOST_PIVOTS, round(n / (16 * block)))))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(lifted(_matrix(b.column(2), dim)), pivots)
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p])], names=[*b.schema.names, "pivot", "dist"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def row() -> pa.RecordBatch:
            t = pa.concat_tables([pa.Table.from_batches([h]) for h in held]).combine_chunks()
            # within a block by the first id, so that ties are in order
            first = t.column("first").combine_chunks()
            heads = pa.array(np.cumsum(np.r_[0, pa.compute.list_value_length(first).to_numpy(zero_copy_only=False)])[:-1])
            ids, rows_ = (first.flatten().field(c).take(heads) for c in ("vec_id", "row"))
            order = pa.compute.sort_indices(pa.table({"i": ids, "r": rows_}), sort_keys=[("i", "ascending"), ("r", "ascending")], null_placement="at_end")
            dist = t.column("dist").to_numpy()
            q, firsts = _matrix(t.column("q"), dim)[order.to_numpy()], first.take(order)
            return pa.RecordBatch.from_pydict({"grp": [now[0]], "pivot": [now[1]], "lo": [float(dist.min())], "hi": [float(dist.max())], "labels": [t.column("label").take(order).to_pylist()], "q": [q.tobytes()], "first": pa.array([firsts.to_pylist()], pa.list_(first.type))}, schema=pa.schema([("grp", pa.int32()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("labels", pa.list_(pa.int64())), ("q", pa.binary()), ("first", pa.list_(first.type))]))

        for b in batches:
            at = np.stack([b.column("grp").to_numpy(), b.column("pivot").to_numpy()], 1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                while s < e:
                    if held and (tuple(at[s]) != now or sum(h.num_rows for h in held) >= size):
                        yield row()
                        held = []
                    now = tuple(int(v) for v in at[s])
                    take = min(e - s, size - sum(h.num_rows for h in held))
                    held.append(b.slice(s, take))
                    s += take
        if held:
            yield row()

    entry = "array<struct<r:int,vec_id:bigint,row:bigint>>"
    with batch_rows(spark, 1_024):
        keys = cut(known.mapInArrow(keyed, f"cid long, label long, q array<double>, first {entry}, pivot int, dist double").withColumn("grp", group), "keys")
        ranged = keys.repartitionByRange("grp", "pivot", "dist", "cid").sortWithinPartitions("grp", "pivot", "dist", "cid")
        made = ranged.mapInArrow(packed, f"grp int, pivot int, lo double, hi double, labels array<long>, q binary, first array<{entry}>")
        blocks = cut(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    # MOST_BLOCKS full ones, and at most GROUPS x MOST_PIVOTS and one a range that end early: 36 bytes each
    rows = [tuple(r) for r in blocks.select("block", "grp", "pivot", "lo", "hi").collect()]
    directory = np.array(rows, dtype=[("block", "i8"), ("grp", "i4"), ("pivot", "i4"), ("lo", "f8"), ("hi", "f8")])
    return Index(blocks, directory, alone, pivots, float(length), dim)


def _probes(index: Index, round_: int):
    """(sid, block) for the next blocks of each search, nearest gap first, and whether others may be left after them."""
    directory, alone, pivots, length, dim = index.directory, index.alone, index.pivots, index.length, index.dim
    start = FIRST * (GROWTH**round_ - 1) // (GROWTH - 1)
    stop = start + FIRST * GROWTH**round_

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("q"), dim)
            own = (q * q).sum(1)
            d = _distances(np.c_[q, np.zeros(len(q))], pivots)
            label, same = b.column("label").to_numpy(), b.column("same").to_numpy(zero_copy_only=False)
            least, most = b.column("kth").to_numpy(), b.column("most").to_numpy()
            sids, blocks, more = [], [], []
            slack = 1e-9 * (length + own) + 1e-6
            for i in range(len(q)):
                at = d[i, directory["pivot"]]
                gap = np.maximum(0, np.maximum(directory["lo"] - at, at - directory["hi"]))
                # by score: the best and the worst that a block can hold
                best, worst = (own[i] + length - gap**2) / 2 + slack[i], (own[i] + length - (at + directory["hi"]) ** 2) / 2 - slack[i]
                own_group = directory["grp"] == label[i] % GROUPS
                fits = np.flatnonzero((own_group if same[i] else ~own_group | (not alone)) & (worst <= most[i]))
                fits = fits[np.lexsort((directory["block"][fits], gap[fits]))]
                chosen = fits[start:stop]
                chosen = chosen[best[chosen] >= least[i]]  # the k-th score so far, or the least that is asked for
                left = len(fits) > stop and best[fits[stop]] >= least[i]
                sids.append(np.full(len(chosen) + 1, b.column("sid")[i].as_py()))
                blocks.append(np.r_[directory["block"][chosen], -1])
                more.append(np.r_[np.zeros(len(chosen), bool), left])
            if sids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sids, blocks, more)], names=["sid", "block", "more"])

    return run


def _scan(index: Index, k: int):
    """Rows of a chunk of searches beside a block: for each search that visits the block, its best rows there."""
    dim = index.dim

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                x = np.frombuffer(b.column("q")[j].as_py()).reshape(-1, dim)
                asked = b.column("asked")[j].values
                a = _matrix(asked.field("q"), dim)
                scores = a @ x.T
                alike = asked.field("label").to_numpy()[:, None] == b.column("labels")[j].values.to_numpy()
                ok = (alike == asked.field("same").to_numpy(zero_copy_only=False)[:, None]) & (scores >= asked.field("kth").to_numpy()[:, None]) & (scores <= asked.field("most").to_numpy()[:, None])
                if x.shape[0] > k:
                    kept = np.where(ok, scores, -np.inf)
                    ok &= scores >= np.partition(kept, x.shape[0] - k, axis=1)[:, x.shape[0] - k, None]
                s, c = np.nonzero(ok)
                order = np.lexsort((c, -scores[s, c], s))
                s, c = s[order], c[order]
                place = np.arange(len(s)) - np.searchsorted(s, s)
                s, c = s[place < k], c[place < k]
                first = b.column("first")[j].values.take(pa.array(c))
                n = np.minimum(pa.compute.list_value_length(first).to_numpy(zero_copy_only=False), k)
                e = first.flatten()
                inside = e.field("r").to_numpy() <= k
                sid = np.repeat(asked.field("sid").to_numpy()[s], n)
                score = np.repeat(scores[s, c], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(score), e.field("vec_id").filter(pa.array(inside)), e.field("row").filter(pa.array(inside))], names=["sid", "score", "vec_id", "row"])

    return run


def search(index: Index, searches: DataFrame, k: int) -> DataFrame:
    """(sid, rank, score, vec_id, row), at rest: the first ``k`` rows by (score descending, vec_id) for each of ``searches`` (sid, label, q, same, least,
    most): of its own label or of all others, with a score from ``least`` to ``most``. ``searches`` must be at rest."""
    spark = searches.sparkSession
    chunks = max(1, -(-searches.count() // CHUNK))
    pending, best, done, round_ = searches.withColumn("kth", F.col("least")), None, [], 0
    by = Window.partitionBy("sid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    while True:
        with batch_rows(spark, 256):
            probes = cut(pending.select("sid", "label", "q", "same", "kth", "most").mapInArrow(_probes(index, round_), "sid long, block long, more boolean"), "probes")
        # searches of one chunk go beside a block together: a block is moved once a chunk, not once a search
        chunk = F.pmod(F.xxhash64("sid"), F.lit(chunks)).alias("chunk")
        groups = probes.filter("block >= 0").join(pending, "sid").groupBy("block", chunk).agg(F.collect_list(F.struct("sid", "label", "same", "q", "kth", "most")).alias("asked"))
        with batch_rows(spark, 4):
            beside = groups.join(index.blocks.select("block", "labels", "q", "first"), "block").select("asked", "labels", "q", "first")
            found = cut(beside.mapInArrow(_scan(index, k), "sid long, score long, vec_id long, row long"), "found")
        found = found if best is None else found.unionByName(best)
        best = cut(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).drop("rank"), "best")
        last = best.groupBy("sid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("now"))
        # a search goes on while a block that is left may hold a row as good as its k-th
        open_ = probes.filter("more").select("sid")
        pending = cut(pending.join(open_, "sid", "left_semi").join(last, "sid", "left").withColumn("kth", F.greatest("least", F.coalesce("now", F.col("least")))).drop("now"), "pending")
        done.append(best.join(pending.select("sid"), "sid", "left_anti"))
        if pending.isEmpty():
            break
        best, round_ = best.join(pending.select("sid"), "sid", "left_semi"), round_ + 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return cut(whole.withColumn("rank", F.row_number().over(by).cast("int")), "ranked")


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 30, most: int = 90, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row of ``rows`` (vec_id, embedding, label) where
    ``is_anchor`` holds (a condition on vec_id), and each of its first ``positives`` rows of the same label: the first ``negatives`` rows of other labels whose
    score is from ``least`` to ``most`` hundredths of the positive's. ``label`` may replace the label."""
    spark = rows.sparkSession
    small_batches(spark, 1_024, 16 << 20)
    vectors = usable(rows, label, scale)
    known = classes(vectors, max(positives + 1, negatives))
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if (index := build(known, block)) is None:
        return spark.createDataFrame([], kind)
    anchors = cut(vectors.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("anchor"), "label", "q").join(known.select("cid", "label", "q"), ["label", "q"]).select("anchor_id", "anchor", "cid"), "anchors")
    whole = known.join(anchors.select("cid").distinct(), "cid", "left_semi").select("cid", "label", "q")
    own = cut(whole.select(F.col("cid").alias("sid"), "label", "q", F.lit(True).alias("same"), F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("most")), "own")
    near = search(index, own, positives + 1).withColumnRenamed("sid", "cid")
    # an anchor isn't its own positive; one row more was searched for that
    pairs = anchors.join(near, "cid").filter("row <> anchor")
    first = Window.partitionBy("anchor").orderBy("rank")
    pairs = pairs.withColumn("p", F.row_number().over(first)).filter(F.col("p") <= positives)
    pairs = cut(pairs.select("anchor_id", "cid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    s = F.col("positive_score")
    windows = pairs.select("cid", "positive_score").distinct().join(whole, "cid")
    # whole numbers from least * s / 100, rounded up, to most * s / 100, rounded down
    windows = windows.select(F.monotonically_increasing_id().alias("sid"), "cid", "positive_score", "label", "q", F.lit(False).alias("same"), (-F.floor(-(s * least) / F.lit(100).cast("decimal(3,0)"))).cast("long").alias("least"), F.floor((s * most) / F.lit(100).cast("decimal(3,0)")).cast("long").alias("most"))
    windows = cut(windows, "windows")
    asked = cut(windows.filter("least <= most").select("sid", "label", "q", "same", "least", "most"), "asked")
    if asked.isEmpty():
        return spark.createDataFrame([], kind)
    far = search(index, asked, negatives).join(windows.select("sid", "cid", "positive_score"), "sid")
    far = far.select("cid", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(far, ["cid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
