"""Description lengths as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the constant of the universal code for integers.
RISSANEN = 2.865064


def gamma_bits(n: Column) -> Column:
    """2 log2 n + 1."""
    return 2 * F.log2(n) + 1


def bits(x: Column) -> Column:
    """log2 x, 0 at 0."""
    return F.when(x == 0, 0.0).otherwise(F.log2(x))


def universal(z: Column, depth: int = 6) -> Column:
    """Universal integer code: log2 of the constant plus the positive iterated logarithms; ``depth`` levels cover any long."""
    total, now = F.lit(math.log2(RISSANEN)), z.cast("double")
    for _ in range(depth):
        now = F.when(now > 1, F.log2(now)).otherwise(0.0)
        total = total + F.when(now > 0, now).otherwise(0.0)
    return total


def log2_factorial(n: Column) -> Column:
    """log2 n! by exact sums below 32 and Stirling's series (error under 1e-12) above."""
    small = F.element_at(F.lit([math.log2(math.factorial(i)) for i in range(32)]), (F.least(n, F.lit(31)) + 1).cast("int"))
    x = n.cast("double")
    ln = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 32, small).otherwise(ln / math.log(2))


def log2_choose(n: Column, k: Column) -> Column:
    return log2_factorial(n) - log2_factorial(k) - log2_factorial(n - k)


def uniform_subset(n: Column, k: Column) -> Column:
    """Bits to name k of n cells when every subset is equally likely."""
    return log2_choose(n, k)


def entropy_subset(n: Column, k: Column) -> Column:
    """Bits to name k of n cells by their rate; 0 where all or none are meant."""
    p = k / n
    return F.when((k <= 0) | (k >= n), 0.0).otherwise(-k * F.log2(p) - (n - k) * F.log2(1 - p))


def weak_composition(n: Column, k: Column) -> Column:
    """Bits to split n into k parts that may be empty: log2 C(n + k - 1, k - 1)."""
    return log2_choose(n + k - 1, k - 1)


def graph_bits(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(n, m, kinds, dl) of a graph from one pass over its pairs; ``labels`` (id, label) marks non-terminals."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    if labels is None:
        node = ends.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("kinds"))
    else:
        marked = ends.join(labels, "id", "left")
        node = marked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("label").isNull()).alias("kinds"))
    pair = edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(2 * gamma_bits(F.col("w") + 1)), F.lit(0.0)).alias("s"))
    return node.join(F.broadcast(pair)).select("n", "m", "kinds", dl(F.col("n"), F.col("m"), F.col("s"), F.col("kinds")).alias("dl"))  # one row each


def dl(n: Column, m: Column, s: Column, kinds: Column) -> Column:
    """Graph bits from node and pair counts, the pairs' summed codes and the number of node kinds."""
    lu = F.log2(1 + kinds)
    return bits(n) + n * lu + bits(m) + lu * (s + (n * n - 2 * m))


def degree_bin(x: Column, omega: float = 2.0, tau: int = 1) -> Column:
    """1-based exponential bin: values up to tau are their own bins, then bin i starts at tau + 1 times powers of omega. Exact at powers."""
    k = F.floor(F.log(((x - tau) * (omega - 1) + 1).cast("double")) / math.log(omega) + 1e-9)
    return F.when(x <= tau, x).otherwise(k + tau).cast("long")


def degree_bin_start(b: Column, omega: float = 2.0, tau: int = 1) -> Column:
    return F.when(b <= tau, b).otherwise(F.ceil((F.pow(F.lit(omega), (b - tau).cast("double")) - 1) / (omega - 1) - 1e-9) + tau).cast("long")
