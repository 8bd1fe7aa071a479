"""Queries over temporal edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import temporal
from weft.plans.registry import query
from weft.sources import views
from weft.sources.views import USERS

_T = f"WITH {USERS}, x AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS a, max(epoch_us(ts)) OVER () AS b FROM t)"
_B = _T + ", y AS (SELECT *, (us - a) // 86400000000 AS block FROM x)"


def _sizes(src: str, key: str) -> str:
    return f"e AS (SELECT DISTINCT {key}, least(src, trg) AS u, greatest(src, trg) AS v FROM {src}), nn AS (SELECT {key}, count(DISTINCT id) AS n FROM (SELECT {key}, u AS id FROM e UNION ALL SELECT {key}, v FROM e) GROUP BY 1), ee AS (SELECT {key}, count(*) AS m FROM e GROUP BY 1)"


@query(f"WITH {USERS} SELECT CAST(epoch_us(ts) AS BIGINT) AS us, CAST(count(*) AS BIGINT) AS edges FROM t GROUP BY 1")
def edges_per_ts(spark, d):
    return views.users(spark, d).groupBy(temporal.micros().alias("us")).agg(F.count(F.lit(1)).alias("edges"))


@query(f"{_B}, {_sizes('y', 'block')} SELECT CAST(block AS BIGINT) AS block, CAST(n AS BIGINT) AS nodes, CAST(m AS BIGINT) AS edges, round(2.0 * m / n, 9) AS mean_degree FROM nn JOIN ee USING (block)")
def mean_degree_per_block(spark, d):
    return temporal.mean_degree(temporal.blocks(views.users(spark, d), 24)).withColumn("mean_degree", F.round("mean_degree", 9))


@query(f"{_T}, y AS (SELECT *, CAST(floor((us - a) * 10 / CAST(b - a AS DOUBLE)) AS BIGINT) + 1 AS slice FROM x), z AS (SELECT * FROM y WHERE slice <= 10), {_sizes('z', 'slice')} SELECT slice, CAST(n AS BIGINT) AS nodes, CAST(m AS BIGINT) AS edges FROM nn JOIN ee USING (slice)")
def slice_nodes_edges(spark, d):
    return temporal.slice_sizes(temporal.slices(views.users(spark, d), 10))


@query(f"{_T}, y AS (SELECT *, (us - a) // 86400000000 AS block FROM x UNION ALL SELECT *, (us - a) // 86400000000 - 1 FROM x WHERE (us - a) % 86400000000 = 0 AND us > a), {_sizes('y', 'block')} SELECT CAST(block AS BIGINT) AS block, CAST(n AS BIGINT) AS nodes, CAST(m AS BIGINT) AS edges FROM nn JOIN ee USING (block)")
def inclusive_block_sizes(spark, d):
    return temporal.slice_sizes(temporal.inclusive_blocks(views.users(spark, d), 24), "block")


@query(f"{_B}, p AS (SELECT least(src, trg) AS u, greatest(src, trg) AS v, min(block) AS f FROM y GROUP BY 1, 2), q AS (SELECT id, min(block) AS f FROM (SELECT src AS id, block FROM y UNION ALL SELECT trg, block FROM y) GROUP BY 1), k AS (SELECT f FROM p UNION SELECT f FROM q) SELECT CAST(k.f AS BIGINT) AS block, CAST((SELECT count(*) FROM p WHERE p.f <= k.f) AS BIGINT) AS edges, CAST((SELECT count(*) FROM q WHERE q.f <= k.f) AS BIGINT) AS nodes FROM k")
def cumulative_snapshots(spark, d):
    return temporal.snapshots(views.users(spark, d), 24)


@query(f"{_B}, c AS (SELECT block, count(DISTINCT id) AS n FROM (SELECT src AS id, block FROM y UNION ALL SELECT trg, block FROM y) GROUP BY 1), s AS (SELECT block, n, sum(n) OVER (ORDER BY block) AS total FROM c) SELECT CAST(block AS BIGINT) AS block, CAST(n AS BIGINT) AS \"distinct\", CAST(total AS BIGINT) AS total, round(total / CAST(max(total) OVER () AS DOUBLE), 9) AS share FROM s")
def node_accumulation(spark, d):
    return temporal.accumulation(views.users(spark, d)).withColumn("share", F.round("share", 9))


@query(f"{_B}, e AS (SELECT DISTINCT block, least(src, trg) AS u, greatest(src, trg) AS v FROM y), dg AS (SELECT block, id, count(*) AS deg FROM (SELECT block, u AS id FROM e UNION ALL SELECT block, v FROM e) GROUP BY 1, 2), h AS (SELECT block, deg, count(*) AS c FROM dg GROUP BY 1, 2) SELECT CAST(block AS BIGINT) AS block, round(avg(c), 9) AS mean_cnt FROM h GROUP BY 1")
def evolving_mean_degree(spark, d):
    return temporal.histogram_means(views.users(spark, d)).withColumn("mean_cnt", F.round("mean_cnt", 9))


@query(f"WITH {USERS} SELECT CAST(min(g) AS BIGINT) AS min_us FROM (SELECT us - lag(us) OVER (ORDER BY us) AS g FROM (SELECT DISTINCT epoch_us(ts) AS us FROM t))")
def min_ts_delta(spark, d):
    return temporal.least_gap(views.users(spark, d))


@query(f"WITH {USERS} SELECT CAST(count(*) AS BIGINT) AS rows FROM t WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15'")
def time_range_mask(spark, d):
    return views.users(spark, d).filter("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").agg(F.count(F.lit(1)).alias("rows"))
