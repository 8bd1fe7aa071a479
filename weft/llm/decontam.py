"""Benchmark decontamination: find every occurrence of a test item's word windows in the training texts, and take the documents or the spans out.

Windows are ``window`` consecutive words of an item (the whole item if it has fewer words). While the set of windows is small
(``max_literal`` checked by a count) its hashes go to every task as a literal hash set: a text's windows are scanned in place, only
hits leave the row, and an equality join on the words themselves verifies them. The 8-byte hashes of up to ``max_broadcast`` windows are
broadcast as a hash table and still no text moves; beyond that (row, place, hash) is joined by shuffle, and in both cases the words of hits
alone are taken from the texts again and verified.

Only DataFrame functions are used. Null texts have no words. Items without words are ignored; an item whose id is null still
marks words as hit but cannot be listed. Repeated rows are judged one by one, whatever their doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import ROW, SEPARATORS, by_row, cut, numbered, unused, words

WINDOW = 13
#: At most so many distinct windows (about 8 bytes each as hashes, 100 as text), with at most 16 times as many item ids, become literals.
MAX_LITERAL = 65_536
#: At most so many hashes (about 50 bytes each in a task's hash table) are broadcast.
MAX_BROADCAST = 1 << 20


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, n, h, items): each distinct window, its number of words, its hash, and the sorted ids of its items."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    w = w.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("g"))
    w = w.select("item_id", "n", F.array_join("g", " ").alias("gram"), F.xxhash64(_hashes(F.col("g"))).alias("h"))
    return w.groupBy("gram", "n", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _hits(lengths: dict[int, list[int]]) -> Column:
    """Places in the word array ``w`` (hashes ``wh``) whose window hash is in the set of its length."""
    parts = []
    for n, hashes in sorted(lengths.items()):
        at = f"filter(sequence(1, size(wh) - {n - 1}), i -> xxhash64(slice(wh, i, {n})) IN ({','.join(map(str, hashes))}))"
        parts.append(f"if(size(wh) >= {n}, transform({at}, i -> struct(i - 1 AS pos, {n} AS n, xxhash64(slice(wh, i, {n})) AS h, array_join(slice(w, i, {n}), ' ') AS gram)), array())")
    kind = "array<struct<pos:int,n:int,h:bigint,gram:string>>"
    return F.expr(f"cast({parts[0] if len(parts) == 1 else 'concat(' + ', '.join(parts) + ')'} AS {kind})" if parts else f"cast(array() AS {kind})")


def _marked(texts: DataFrame, found: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(ROW, hits) for a large set of windows: places whose window hash is in the set, with their words; rows without one are left out."""
    h = found.select("h").distinct()
    rows = texts.select(ROW, words(F.col("text")).alias("w")).select(ROW, _hashes(F.col("w")).alias("wh"))
    at = None
    for n in lengths:
        own = rows.filter(F.size("wh") >= n).select(ROW, F.lit(n).alias("n"), F.explode(F.expr(f"transform(sequence(1, size(wh) - {n - 1}), i -> struct(i - 1 AS pos, xxhash64(slice(wh, i, {n})) AS h))")).alias("x")).select(ROW, "n", "x.*")
        own = own.join(F.broadcast(h) if small else h, "h", "left_semi")
        at = own if at is None else at.union(own)
    places = cut(at.groupBy(ROW).agg(F.collect_list(F.struct("pos", "n", "h")).alias("at")), "places")
    got = by_row(texts.select(ROW, "text"), places, "inner", size=24 * F.size("at")).select(ROW, words(F.col("text")).alias("w"), "at")
    return got.select(ROW, F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), x["h"].alias("h"), F.array_join(F.slice("w", x["pos"] + 1, x["n"]), " ").alias("gram"))).alias("hits"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_literal: int = MAX_LITERAL, max_broadcast: int = MAX_BROADCAST, row: str | None = None) -> DataFrame:
    """Per row of ``docs``: its row number (as ``ROW``), doc_id, n_words, spans (merged hit ranges of word positions, end exclusive), n_hit, items.

    The rows of one text's hits meet again by row number, so repeated doc_ids stay apart. ``row`` names the column with the numbers where
    ``docs`` has been numbered; no other column but doc_id and text is looked at, whatever it is called.
    """
    found = cut(item_windows(benchmark, window), "windows")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("refs")).first()
    small = size.n <= max_literal and size.refs <= 16 * max_literal
    key = [ROW, "doc_id", "n_words"]
    if small:
        lengths: dict[int, list[int]] = {}
        for r in found.select("n", "h").distinct().collect():
            lengths.setdefault(r.n, []).append(r.h)
        own = F.monotonically_increasing_id() if row is None else F.col(row)
        base = docs.select(own.alias(ROW), "doc_id", words(F.col("text")).alias("w")).select(ROW, "doc_id", "w", _hashes(F.col("w")).alias("wh"))
        base = base.select(ROW, "doc_id", F.size("w").cast("long").alias("n_words"), _hits(lengths).alias("hits"))
    else:
        texts = numbered(docs.select("doc_id", "text"), "texts")[0] if row is None else docs.select(F.col(row).alias(ROW), "doc_id", "text")
        hits = cut(_marked(texts, found, sorted(r.n for r in found.select("n").distinct().collect()), size.n <= max_broadcast), "hits")
        base = by_row(texts.select(ROW, "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")), hits, "left", size=F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + 32 + F.octet_length(x["gram"])))
    spread = base.select(*key, F.explode_outer("hits").alias("x")).select(*key, "x.*")
    side = F.broadcast(found) if small else found
    joined = spread.join(side.withColumnRenamed("n", "bn"), ["h", "gram"], "left")
    per = joined.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("bn").isNotNull(), F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("n")).alias("e"))))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = F.aggregate(
        "at",
        F.expr("cast(array() AS array<struct<s:int,e:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    per = per.withColumn("spans", spans)
    return per.select(*key, "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_hit"), "items")


def _contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per document: n_words, n_hit, the items found, and whether at least a twentieth of its words is hit."""
    r = scan(docs, benchmark, **kw)
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows that aren't contaminated, all columns as they were. Each row is judged by its own text and number: a null or repeated doc_id
    takes no other row with it. Null and empty texts stay."""
    row = unused(ROW, docs.columns)
    rows, _ = numbered(docs, "documents", row)
    bad = cut(scan(rows, benchmark, row=row, **kw).filter(_contaminated()).select(ROW), "contaminated")
    return by_row(rows, bad, "left_anti", row).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """All rows, all columns; from the texts every hit word is cut out together with what separates it from the word before. Texts without a hit,
    null ones among them, stay as they are; a text that is hit as a whole keeps only what follows its last word."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    rows, _ = numbered(docs.toDF(*names), "documents")
    text = names[docs.columns.index("text")]
    plain = rows.select(ROW, F.col(names[docs.columns.index("doc_id")]).alias("doc_id"), F.col(text).alias("text"))
    hit = cut(scan(plain, benchmark, row=ROW, **kw).filter("n_hit > 0").select(ROW, F.col("spans").alias("__spans")), "spans")
    joined = by_row(rows, hit, "left", size=16 * F.size("__spans"))
    # every word with its separators before it; A-Z are letters here as the text isn't lower-cased
    outside, inside = SEPARATORS[:-1].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), SEPARATORS[:-1].replace("[", "[^").replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    parts = F.regexp_extract_all(text, F.lit(f"({outside}*{inside}+)"), 1)
    n = F.size("__parts")
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform("__spans", lambda s: F.array(s["s"], s["e"]))), F.array(n))
    gaps = F.transform(F.sequence(F.lit(0), F.size("__spans")), lambda i: F.slice("__parts", F.get("__b", 2 * i) + 1, F.get("__b", 2 * i + 1) - F.get("__b", 2 * i)))
    left = joined.withColumn("__parts", F.when(F.col("__spans").isNotNull(), parts)).withColumn("__b", bounds)
    tail = F.regexp_extract(text, f"({outside}*)$", 1)
    clean = F.when(F.col("__spans").isNotNull(), F.concat(F.array_join(F.flatten(gaps), ""), tail)).otherwise(F.col(text))
    return left.withColumn(text, clean).select(*names).toDF(*docs.columns)
