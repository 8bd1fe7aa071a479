"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below a fixed fraction of the hash space, so its size follows the document and two sketches
of very unequal documents still estimate containment. So that short documents are not left with an empty sketch, the ``floor``
smallest hashes are always retained too; a union's sketch then still follows from the sketches alone (union, then the same rule).

Only DataFrame functions are used. Nulls: a null text counts as empty; an empty sketch is like another empty one (1.0) and unlike
any other (0.0). Texts of fewer words than a shingle give one shingle of all their words. Hashes are the first 64 bits of MD5 in
hex, so that any SQL engine can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import with_next, words

SHINGLE = 5
#: Hashes below this hexadecimal prefix are retained: 2/16, one in eight.
BELOW = "2"
FLOOR = 32


def sketch(w: Column, shingle: int = SHINGLE, below: str = BELOW, floor: int = FLOOR) -> Column:
    """The sorted array of retained hashes (16 hex digits each) of an array of words."""
    short = F.array_join(w, " ")
    grams = F.when(F.size(w) >= shingle, F.transform(F.sequence(F.lit(1), F.size(w) - shingle + 1), lambda i: F.left(F.md5(F.array_join(F.slice(w, i, shingle), " ")), F.lit(16)))).when(F.size(w) > 0, F.array(F.left(F.md5(short), F.lit(16)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.sort_array(F.array_distinct(grams)), lambda h, i: (h < below) | (i < floor))


def coded(s: Column) -> Column:
    """A sketch as longs in the same order (the unsigned hash with its top bit flipped): eight bytes a hash for the shuffle."""
    return F.transform(s, lambda h: F.conv(h, 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63))))


def shown(s: Column) -> Column:
    """The fingerprint string of a coded sketch: its hashes, 16 hex digits each, one after another."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))), "")


def known_to(s: Column, below: str = BELOW, floor: int = FLOOR) -> Column:
    """Up to which code (inclusive) a coded sketch holds all of its document's hashes."""
    last_below = (int(below, 16) << (4 * (16 - len(below)))) - 1 - (1 << 63)
    return F.when(F.size(s) < floor, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(s, -1), F.lit(last_below)))


def likeness(a: Column, b: Column, how: str = "containment") -> Column:
    """Estimated containment of the smaller in the larger document (or ``how='jaccard'``) on the part of hash space that both coded sketches know."""
    limit = F.least(known_to(a), known_to(b))
    x, y = F.filter(a, lambda h: h <= limit), F.filter(b, lambda h: h <= limit)
    both = F.size(F.array_intersect(x, y))
    of = F.least(F.size(x), F.size(y)) if how == "containment" else F.size(x) + F.size(y) - both
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(of == 0, 0.0).otherwise(both / of)


def merge(df: DataFrame, key: str, sketch_col: str, below: str = BELOW, floor: int = FLOOR) -> DataFrame:
    """Sketches of the unions by ``key``, one row (key, hash) per retained hash.

    Hashes are made distinct before anything is ranked, and only the ``floor`` smallest of a key need a sort (they are pre-aggregated
    per hash prefix), so a key that holds a third of all rows meets no single task with more than its distinct hashes.
    """
    rows = df.select(F.col(key), F.explode(sketch_col).alias("hash")).distinct()
    low = rows.filter(F.col("hash") < below)
    few = low.groupBy(key).count().filter(F.col("count") >= floor).select(key)
    # keys with enough hashes below the threshold need nothing more; the others hold under `floor` such hashes in every part
    rest = rows.join(few, key, "left_anti")
    from pyspark.sql import Window

    ranked = rest.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).filter(F.col("__r") <= floor).drop("__r")
    return low.union(ranked).distinct()


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form (its last quarter replaced by the start of the next document, by doc_id).

    One shuffle deals texts to ranges of doc_id. Repeated doc_ids are ordered by text; a null doc_id comes first.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(F.col("text"))).select("doc_id", "text", coded(sketch(F.col("w"))).alias("s"))
    pairs = with_next(base, "doc_id", ["text"], ["text", "s"], "nx")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("nx.text"), F.lit(1), quarter)))
    edited = edited.select("doc_id", "n_chars", "s", F.col("nx.s").alias("ns"), "edited", words(F.col("edited")).alias("ew"))
    edited = edited.select("doc_id", "n_chars", "s", "ns", F.sha2("edited", 256).alias("edited_sha256"), coded(sketch(F.col("ew"))).alias("es"))
    return edited.select("doc_id", "n_chars", "edited_sha256", shown(F.col("s")).alias("fingerprint"), shown(F.col("es")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("es")).alias("near_edited"), likeness(F.col("s"), F.col("ns")).alias("near_next"))
