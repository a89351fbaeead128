"""Queries of offsets, periods, box judgements and frame statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment
from .common import HOUR, E, events, of_type, query, rounded, table
from .metric_queries import matched_sql

USER = ["user_id"]
ORDER = ["t", "event_id"]
OFFSETS = [o * 3 * HOUR for o in range(-4, 5)]
NEAR = 2 * HOUR
GRID = f"o AS (SELECT unnest(range({len(OFFSETS)})) AS k, unnest({OFFSETS}) AS off)"
SHIFTED = f"{GRID}, moved AS (SELECT user_id * 100 + k AS user_id, event_id, t + off AS t FROM clicks, o), heard AS (SELECT user_id * 100 + k AS user_id, event_id, t FROM buys, o)"
GUARDED = f"""d AS (SELECT user_id, count(*) AS n, median(gap) AS middle FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM clicks) GROUP BY user_id),
g AS (SELECT h.user_id, off, hits, n, abs(off) <= 0.6e0 * middle AND (off = 0 OR abs(off) >= {4 * HOUR}) AS open FROM h JOIN d USING (user_id)),
b AS (SELECT user_id, max(hits) FILTER (WHERE off = 0) AS base, max(n) AS n, arg_max(off, struct_pack(h := hits, s := -abs(off), o := -off)) FILTER (WHERE open OR off = 0) AS best, max(hits) FILTER (WHERE open OR off = 0) AS hits FROM g GROUP BY user_id),
v AS (SELECT b.*, coalesce((SELECT max(g.hits) FROM g WHERE g.user_id = b.user_id AND g.open AND abs(g.off - b.best) > {3 * HOUR}), 0) AS rival, user_id IN (SELECT user_id FROM buys) AS able FROM b),
z AS (SELECT *, able AND n >= 3 AND hits >= base + 2 AND hits >= base * 1.1e0 AND hits >= rival + 1 AS ok FROM v)
SELECT user_id, CAST(CASE WHEN ok THEN best ELSE 0 END AS BIGINT) AS "offset", CAST(CASE WHEN ok THEN hits ELSE base END AS BIGINT) AS hits, CAST(base AS BIGINT) AS base FROM z"""
HEAD = f"{E}, {of_type('clicks', 'click')}, {of_type('buys', 'purchase')}"
RULES = {"gain": 1.1, "least": 4 * HOUR, "cap": 0.6, "unique": 1, "apart": 3 * HOUR}


@query(f"""WITH {HEAD}, {GRID}, h AS (SELECT c.user_id, off, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM buys b WHERE b.user_id = c.user_id AND abs(b.t - c.t - off) <= {NEAR})) AS hits FROM clicks c, o GROUP BY c.user_id, off), {GUARDED}""")
def offset_many(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's offset from clicks to purchases, a purchase counting for any number of clicks."""
    return alignment.estimate_offset(events(spark, sf, "click"), events(spark, sf, "purchase"), USER, "t", "event_id", OFFSETS, NEAR, False, **RULES)


@query(f"""WITH RECURSIVE {HEAD}, {SHIFTED}, {matched_sql(NEAR, refs='heard', preds='moved')},
h AS (SELECT c.user_id, c.off, count(ref) AS hits FROM (SELECT DISTINCT user_id, off, k FROM clicks, o) c LEFT JOIN m ON m.user_id = c.user_id * 100 + c.k GROUP BY c.user_id, c.off), {GUARDED}""")
def offset_one(spark: SparkSession, sf: str) -> DataFrame:
    """The same with each purchase counting once, in order."""
    return alignment.estimate_offset(events(spark, sf, "click"), events(spark, sf, "purchase"), USER, "t", "event_id", OFFSETS, NEAR, True, **RULES)


PERIODS = [6 * HOUR, 10 * HOUR, 24 * HOUR, 36 * HOUR]


@query(f"""WITH RECURSIVE {E}, s AS (SELECT *, value > lag(value) OVER w AND value >= lead(value) OVER w AS top FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
n AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM s WHERE top),
w AS (SELECT user_id, i, t, t AS last, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.t, CASE WHEN n.t - w.last >= {12 * HOUR} THEN n.t ELSE w.last END, n.t - w.last >= {12 * HOUR} FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1),
g AS (SELECT * FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM w WHERE kept) WHERE gap IS NOT NULL),
c AS (SELECT user_id, p, count(*) AS n, count(*) FILTER (WHERE floor(gap / p + 0.5e0) >= 1 AND abs(gap - floor(gap / p + 0.5e0) * p) <= {2 * HOUR}) AS hits FROM g, unnest({PERIODS}) u(p) GROUP BY user_id, p)
SELECT user_id, max(n) AS n, max(p) FILTER (WHERE hits >= ceil(n * 0.6e0)) AS period FROM c GROUP BY user_id HAVING max(n) >= 2""")
def peak_period(spark: SparkSession, sf: str) -> DataFrame:
    """The period of each user's spaced peaks."""
    peaks = alignment.spaced_maxima(events(spark, sf), USER, ORDER, "t", "value", 12 * HOUR)
    return alignment.gap_period(peaks, USER, "t", PERIODS, 2 * HOUR)


@query("""WITH x AS (SELECT p_brand, CAST(p_size % 9 + 4 AS DOUBLE) AS tw, CAST(p_size % 7 + 4 AS DOUBLE) AS th, CAST(p_partkey % 5 AS DOUBLE) AS fx, CAST(p_partkey % 3 AS DOUBLE) AS fy, CAST(p_size % 6 + 5 AS DOUBLE) AS fw, 6e0 AS fh, p_partkey % 8 = 0 AS none FROM part),
i AS (SELECT *, greatest(0, least(tw, fx + fw) - greatest(0, fx)) * greatest(0, least(th, fy + fh) - greatest(0, fy)) AS inter FROM x),
v AS (SELECT *, CASE WHEN none THEN 0e0 ELSE inter / (tw * th + fw * fh - inter) END AS iou, NOT none AND fx + fw / 2 BETWEEN 0 AND tw AND fy + fh / 2 BETWEEN 0 AND th AS centred FROM i)
SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE NOT none) AS found, round(list_sort(list(iou))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS median, round(avg(iou), 6) AS mean, count(*) FILTER (WHERE iou < 0.2e0) AS missed, count(*) FILTER (WHERE centred) AS centred FROM v GROUP BY p_brand""")
def box_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Found boxes against true ones, by brand."""
    key, size = F.col("p_partkey"), F.col("p_size")
    box = lambda *v: F.struct(*[F.lit(x).cast("double").alias(c) if isinstance(x, int) else x.cast("double").alias(c) for c, x in zip("xywh", v, strict=True)])
    rows = table(spark, sf, "part").select("p_brand", F.when(key % 8 != 0, box(key % 5, key % 3, size % 6 + 5, 6)).alias("found_box"), box(0, 0, size % 9 + 4, size % 7 + 4).alias("true_box"))
    return rounded(alignment.evaluate_boxes(rows, ["p_brand"], "found_box", "true_box"), "median", "mean")


@query(f"""WITH {E}, x AS (SELECT event_id, user_id, t, value - 40 AS v FROM e), n AS (SELECT event_id, v, avg(abs(v)) OVER w AS mean_abs, stddev_pop(v) OVER w AS deviation, list(sign(v)) OVER w AS s FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
f AS (SELECT *, list_filter(s, lambda y: y <> 0) AS z FROM n)
SELECT event_id, round(mean_abs, 5) AS mean_abs, round(deviation, 5) AS deviation, round(CASE WHEN len(z) > 1 THEN len(list_filter(range(1, len(z)), lambda i: z[i] <> z[i + 1])) / (len(z) - 1) ELSE 0 END, 6) AS flips FROM f""")
def frame_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Size, deviation and sign changes of the nine values around each event."""
    rows = events(spark, sf).select("event_id", "user_id", "t", (F.col("value") - 40).alias("v"))
    found = alignment.frame_stats(rows, USER, ORDER, "v", 4, 4)
    return found.select("event_id", F.round("mean_abs", 5).alias("mean_abs"), F.round("deviation", 5).alias("deviation"), F.round("flips", 6).alias("flips"))
