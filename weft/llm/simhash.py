"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming checks and components.

A document's 64-bit fingerprint has a bit set where over half of its shingle hashes have it. Texts with equal fingerprints are one
class from the start (one partial aggregation, so a huge group of copies costs one row). The distinct fingerprints are cut into
``BLOCKS`` blocks; two that differ in at most ``bits`` bits agree in at least BLOCKS - bits whole blocks, so each choice of that many
blocks is a key, and every close pair shares a key. Within a key's rows a search from member to member keeps only the links of a
spanning tree: as many rows as members, however many pairs there are. Trees of all keys are then joined into components by rounds of
neighbour minima over tables in the shared folder.

Nulls: a null text has no words, its fingerprint is zero and is linked like any other. A null doc_id gets the component of its
fingerprint, or null if no row of it has an id. Repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import ROW, batch_rows, by_row, cut, drop, numbered, put, small_batches, unused

SHINGLE, SEED, BITS, BLOCKS = 4, 42, 4, 7
#: A key with more distinct fingerprints than this is linked by the exact detour of ``_linked_by_halfway`` instead.
MAX_MEMBERS = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text: ASCII lower case, words between ASCII white space, repeats count."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        h = np.array([xxh64_intdigest(b" ".join(w), seed)], np.uint64)
        return int(h[0])
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[: len(w) - shingle] + 1).tolist()]
    total, most = np.zeros(64, np.int64), 1 << 16
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, len(starts), most):  # long texts in parts: 64 bytes a shingle
        h = np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + most], ends[at : at + most], strict=True)], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """(*keep, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps)], [*keep, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, fp bigint")


def block_masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """The masks of every choice of blocks - bits whole blocks, as signed longs."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(parts, blocks - bits))]


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """For each y whether some x is within ``bits`` bits; the x are taken in blocks, so memory is bounded."""
    ok = np.zeros(len(y), bool)
    for i in range(0, len(x), 256):
        left = np.flatnonzero(~ok)
        if not len(left):
            break
        step = 1 << 16
        for j in range(0, len(left), step):
            part = left[j : j + step]
            ok[part] |= (np.bitwise_count(x[i : i + 256, None] ^ y[None, part]) <= bits).any(axis=0)
    return ok


def spanning_links(fps: np.ndarray, bits: int) -> np.ndarray:
    """For each member of a key the index of its component's first member, by a search that never tests a pair twice from one side."""
    root, left = np.full(len(fps), -1), np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        front = np.array([first])
        while len(front) and len(left):
            hit = near(fps[front], fps[left], bits)
            front, left = left[hit], left[~hit]
            root[front] = first
    return root


def _links_of_sorted(bits: int):
    """Over rows (key, mask number, fp, rep) sorted by key: rows (a, b) of linked reps; a key's rows may come in several batches."""

    def links(fp: np.ndarray, rep: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        two = ends - starts == 2
        a = starts[two]
        a = a[np.bitwise_count(fp[a] ^ fp[a + 1]) <= bits]
        yield rep[a], rep[a + 1]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            r = spanning_links(fp[s:e], bits)
            own = np.flatnonzero(r != np.arange(e - s))
            yield rep[s:e][own], rep[s:e][r[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(cols):
            bounds = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(cols[0])]])
            many = ends - starts > 1
            for a, b in links(cols[2].view(np.uint64), cols[3], starts[many], ends[many]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(cols[0]):
                continue
            tail = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])
            n_done = int(tail.sum())  # sorted: the last key's rows are the last ones
            if held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0]) or n_done:
                yield from out(tuple(np.concatenate(x) for x in zip(*held, tuple(c[:n_done] for c in cols))))
                held = []
            held.append(tuple(c[n_done:] for c in cols))
        if held:
            yield from out(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def _linked_by_halfway(keyed: DataFrame, masks: list[int], bits: int) -> DataFrame:
    """Exact links for keys with very many members, without comparing members: two fingerprints within ``bits`` bits have a point at most
    half of them (rounded down) from one and the rest (rounded up) from the other, that agrees with both in the key's blocks. Each member
    emits a fixed number of points; at a point all are linked with the first that is near enough for any other member there."""
    near_, far = bits // 2, bits - bits // 2
    balls = []
    for m in masks:
        free = [i for i in range(64) if not (m >> i) & 1]
        balls.append([(sum(1 << i for i in c), n <= near_) for n in range(far + 1) for c in combinations(free, n)])
    out = None
    for number, ball in enumerate(balls):
        at = F.array(*[F.struct(F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long").alias("d"), F.lit(close).alias("close")) for v, close in ball])
        points = keyed.filter(F.col("no") == number).select("rep", F.explode(F.transform(at, lambda x: F.struct(x["d"].bitwiseXOR(F.col("fp")).alias("point"), x["close"].alias("close")))).alias("x")).select("rep", "x.*")
        firsts = points.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("rep"))).alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND a IS NOT NULL").select("point", "a")
        part = points.join(firsts, "point").filter("rep <> a").select("a", F.col("rep").alias("b"))
        out = part if out is None else out.union(part)
    return out


def close_links(reps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, max_members: int = MAX_MEMBERS) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints (columns fp, rep) that span every component at ``bits`` bits."""
    masks = block_masks(bits, blocks)
    keyed = reps.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("no", "key"))
    usual, rest = keyed, None
    if reps.count() > max_members:  # fewer can't fill a key beyond the bound
        big = keyed.groupBy("key", "no").count().filter(F.col("count") > max_members).select("key", "no")
        if big.limit(1).count():
            big = cut(big, "bigkeys")
            usual, rest = keyed.join(big, ["key", "no"], "left_anti"), keyed.join(big, ["key", "no"], "left_semi")
    usual = usual.select("key", F.col("no").cast("int").alias("no"), "fp", "rep").repartition("key", "no").sortWithinPartitions("key", "no", "rep")
    links = usual.mapInArrow(_links_of_sorted(bits), "a bigint, b bigint")
    if rest is not None:
        links = links.union(_linked_by_halfway(rest, masks, bits))
    return links.distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node with a link the smallest node that it reaches.

    Each round hangs all neighbours of a node on the smallest one (large star, then small star); rounds end when nothing changes. Every
    round is two partial aggregations and equi-joins and is written to the shared folder.
    """
    edges, old = put(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b"), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        # the key in another form keeps the join from sharing the sums' exchange, which could not be split if a node has very many neighbours
        moved = both.join(low.select(F.col("a").bitwiseXOR(F.lit(0)).alias("k"), "m"), F.col("a") == F.col("k"))
        moved = moved.filter("b > a").select(F.col("b"), "m") if large else moved.select("b", "m").union(low.select(F.col("a").alias("b"), "m"))
        return moved.filter("b <> m").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).distinct()

    before = None
    for _ in range(most_rounds):
        edges, path = put(star(star(edges, True), False), "round")
        drop(old)
        old = path
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def classes(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, component_id) of the fingerprints of ``nodes`` (node, fp; at rest): the smallest node reachable; null where none has a node."""
    reps = cut(nodes.groupBy("fp").agg(F.min("node").cast("long").alias("rep")), "classes")
    with batch_rows(nodes.sparkSession, 8192):  # short rows
        comp = components(close_links(reps.filter("rep IS NOT NULL"), bits, blocks))
    return cut(reps.join(comp, reps["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): per row of ``docs`` the smallest doc_id reachable over links of at most ``bits`` differing bits."""
    fps = cut(fingerprints(docs), "fingerprints")
    return fps.join(classes(fps.select(F.col("doc_id").alias("node"), "fp"), bits, blocks), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row of each component, all columns as they were: that with the smallest doc_id, of several such the first.

    Rows are judged by their own number, not their doc_id: rows that share an id but not their text stay apart, and rows with a null id are
    grouped like any other (an id goes before none). Empty and null texts are one group.
    """
    row = unused(ROW, docs.columns)
    rows, _ = numbered(docs, "documents", row)
    fps = cut(fingerprints(rows.select(F.col(row).alias(ROW), "doc_id", "text"), [ROW, "doc_id"]), "fingerprints")
    found = fps.join(classes(fps.select(F.col(ROW).alias("node"), "fp"), bits, blocks), "fp").select(ROW, "doc_id", "component_id")
    first = cut(found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))[ROW].alias("first")), "firsts")
    gone = cut(found.join(first, "component_id").filter(F.col(ROW) != F.col("first")).select(ROW), "gone")
    return by_row(rows, gone, "left_anti", row).select(*docs.columns)


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
