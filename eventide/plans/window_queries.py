"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators import windows as w
from .common import DAY, HOUR, MINUTE, E, events, query, rounded, runs_sql, table

USER = ["user_id"]
ORDER = ["t", "event_id"]
GAP = 4 * HOUR
W = "OVER (PARTITION BY user_id ORDER BY t, event_id)"


@query(f"WITH {E}, {runs_sql('e', GAP)} SELECT user_id, run_id, count(*) AS n, min(t) AS start_us, max(t) AS end_us FROM runs GROUP BY user_id, run_id")
def sessionize_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = w.session_runs(events(spark, sf), USER, "t", GAP, ["event_id"])
    return runs.select("user_id", "run_id", "n", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"WITH {E}, {runs_sql('e', GAP)} SELECT user_id, count(*) AS n, min(t) AS start_us, max(t) AS end_us FROM runs GROUP BY user_id, run_id")
def session_window_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same runs by Spark's session windows."""
    rows = events(spark, sf).withColumn("at", F.timestamp_micros("t"))
    runs = rows.groupBy("user_id", F.session_window("at", "4 hours")).agg(F.count("*").alias("n"), F.min("t").alias("start_us"), F.max("t").alias("end_us"))
    return runs.drop("session_window")


KINDS = f"""{runs_sql('e', GAP)},
gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, run_id ORDER BY t, event_id) AS gap FROM runs),
kinds AS (SELECT user_id, run_id, count(*) AS n, min(t) AS start_us, max(t) AS end_us, quantile_cont(gap, 0.5) AS period FROM gaps GROUP BY user_id, run_id)"""


@query(f"""WITH {E}, {KINDS}
SELECT user_id, run_id, n, CAST(period AS DOUBLE) AS period, CASE WHEN n = 1 THEN 'single' WHEN period <= {HOUR} AND n >= 4 THEN 'fast' ELSE 'countable' END AS kind FROM kinds""")
def burst_kind(spark: SparkSession, sf: str) -> DataFrame:
    return w.run_kinds(events(spark, sf), USER, "t", GAP, HOUR, 4, ["event_id"]).select("user_id", "run_id", "n", "period", "kind")


@query(f"""WITH {E}, g AS (SELECT *, t - lag(t) {W} AS a, lead(t) {W} - t AS b FROM e)
SELECT event_id, user_id, t FROM g WHERE (a IS NULL OR a > {12 * HOUR}) AND (b IS NULL OR b > {12 * HOUR})""")
def isolated_events(spark: SparkSession, sf: str) -> DataFrame:
    return w.isolated(events(spark, sf), USER, "t", 12 * HOUR, ["event_id"]).select("event_id", "user_id", "t")


SPAN_END = f"t + CAST(floor(value * {MINUTE}) AS BIGINT)"


@query(f"""WITH {E}, s AS (SELECT user_id, event_id, t AS a, {SPAN_END} AS b FROM e),
f AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span_id FROM f)
SELECT user_id, span_id, min(a) AS start_us, max(b) AS end_us, count(*) AS n FROM g GROUP BY user_id, span_id""")
def coalesce_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = events(spark, sf).withColumn("until", F.col("t") + F.floor(F.col("value") * MINUTE).cast("long"))
    merged = w.coalesce_spans(spans, USER, "t", "until", 0, ["event_id"])
    return merged.select("user_id", "span_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


ISLANDS = f"""f AS (SELECT *, CASE WHEN lag(event_type) {W} IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)"""


@query(f"WITH {E}, {ISLANDS} SELECT user_id, island, event_type, count(*) AS n FROM g GROUP BY user_id, island, event_type")
def rle_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return w.run_lengths(events(spark, sf), USER, ORDER, "event_type")


@query(f"WITH {E}, {ISLANDS} SELECT event_id, count(*) OVER (PARTITION BY user_id, island) AS run_length FROM g")
def run_length_rows(spark: SparkSession, sf: str) -> DataFrame:
    return w.with_run_length(events(spark, sf), USER, ORDER, "event_type").select("event_id", "run_length")


@query("WITH g AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, role FROM g WHERE before IS NULL OR before <> role")
def change_points(spark: SparkSession, sf: str) -> DataFrame:
    return w.change_points(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "role")


SIX = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
READS = f"""d AS (SELECT *, l_quantity - lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY {', '.join(SIX)}) AS delta,
  epoch_us(l_shipdate) AS t, lag(epoch_us(l_shipdate)) OVER (PARTITION BY l_partkey ORDER BY {', '.join(SIX)}) AS t0 FROM lineitem)"""


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf, "lineitem").select("l_partkey", *SIX, F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"))


@query(f"""WITH {READS} SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, delta,
CASE WHEN delta IS NULL THEN 'first' WHEN delta > 0 THEN 'reload' WHEN delta = 0 THEN 'steady' WHEN delta = -1 THEN 'event' WHEN delta >= -3 THEN 'interpolated' ELSE 'skipped' END AS kind FROM d""")
def counter_drops(spark: SparkSession, sf: str) -> DataFrame:
    return w.counter_drops(_reads(spark, sf), ["l_partkey"], SIX, "l_quantity").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "delta", "kind")


@query(f"""WITH {READS}, u AS (SELECT l_partkey, t0, t, CAST(-delta AS BIGINT) AS n, unnest(generate_series(1, CAST(-delta AS BIGINT))) AS nth FROM d WHERE delta IN (-1, -2, -3))
SELECT l_partkey, t0 + (t - t0) * nth / n AS "at", n AS "of", nth FROM u""")
def counter_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return w.counter_events(_reads(spark, sf), ["l_partkey"], SIX, "t", "l_quantity")


@query(f"""WITH {E}, n AS (SELECT event_id, lag(value) {W} AS a, value AS b, lead(value) {W} AS c FROM e)
SELECT event_id, CASE WHEN a IS NULL OR c IS NULL THEN b ELSE greatest(least(a, b), least(greatest(a, b), c)) END AS despiked FROM n""")
def despike3(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", w.despike3("value", USER, ORDER).alias("despiked"))


@query(f"""WITH {E}, c AS (SELECT *, CAST(floor(value / 40) AS BIGINT) AS v FROM e),
f AS (SELECT *, CASE WHEN lag(v) {W} = v THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
h AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id, island) >= 2 THEN v END AS trusted FROM g)
SELECT event_id, v, coalesce(last_value(trusted IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), -1) AS stable FROM h""")
def stabilize2(spark: SparkSession, sf: str) -> DataFrame:
    reads = events(spark, sf).withColumn("v", F.floor(F.col("value") / 40).cast("long"))
    return w.stabilize(reads, USER, ORDER, "v").select("event_id", "v", F.coalesce("stable", F.lit(-1).cast("long")).alias("stable"))


@query(f"""WITH {E}, h AS (SELECT event_id, value, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS h FROM e),
q AS (SELECT event_id, value, h[CAST(floor(len(h) * 0.5) AS INT) + 1] AS med, h[CAST(floor(len(h) * 0.25) AS INT) + 1] AS q1, h[CAST(floor(len(h) * 0.75) AS INT) + 1] AS q3 FROM h)
SELECT event_id, round(greatest(0.05, coalesce(med + 2 * ((q3 - q1) / 1.349), 0.05)), 6) AS threshold, value > greatest(0.05, coalesce(med + 2 * ((q3 - q1) / 1.349), 0.05)) AS above FROM q""")
def local_threshold(spark: SparkSession, sf: str) -> DataFrame:
    threshold = w.local_threshold("value", USER, ORDER, 20, 2.0, 0.05)
    return events(spark, sf).withColumn("threshold", threshold).select("event_id", F.round("threshold", 6).alias("threshold"), (F.col("value") > F.col("threshold")).alias("above"))


@query(f"""WITH {E}, h AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS h FROM e)
SELECT event_id, h[CAST(floor(len(h) * 0.5) AS INT) + 1] AS background FROM h""")
def centered_median(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", w.centered_median("value", USER, ORDER, 5).alias("background"))


@query(f"""WITH {E} SELECT event_id, round(avg(value) OVER w, 6) AS mean_1d, max(value) OVER w AS peak_1d, count(*) OVER w AS n_1d
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING)""")
def rolling_mean_peak(spark: SparkSession, sf: str) -> DataFrame:
    near = w.around(USER, "t", DAY, DAY)
    return events(spark, sf).select("event_id", F.round(F.avg("value").over(near), 6).alias("mean_1d"), F.max("value").over(near).alias("peak_1d"), F.count("*").over(near).alias("n_1d"))


def _edge(n: int) -> str:
    side = "lead" if n > 0 else "lag"
    end = "last_value" if n > 0 else "first_value"
    whole = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce({side}(value, {abs(n)}) {W}, {end}(value) {whole}) AS {'p' if n > 0 else 'm'}{abs(n)}"


@query(f"""WITH {E}, l AS (SELECT event_id, value AS z0, {', '.join(_edge(n) for n in (-3, -2, -1, 1, 2, 3))} FROM e)
SELECT *, round(z0 - m1, 6) AS rise, round(z0 - p1, 6) AS decay, round(z0 - least(m3, m2, m1, z0, p1, p2, p3), 6) AS over_min,
round((p1 + p2 + p3) / 3 - (m3 + m2 + m1) / 3, 6) AS post_pre FROM l""")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    found = w.lag_features(events(spark, sf), USER, ORDER, "value")
    return rounded(found.drop("user_id", "event_type", "value", "props", "t"), "rise", "decay", "over_min", "post_pre")


@query(f"WITH {E}, n AS (SELECT *, lag(value) {W} AS a, lead(value) {W} AS c FROM e) SELECT event_id, user_id, value FROM n WHERE value >= 100 AND value >= a AND value >= c")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return w.local_maxima(events(spark, sf), USER, ORDER, "value", 100.0).select("event_id", "user_id", "value")


@query(f"WITH {E} SELECT event_id, round(greatest(0e0, coalesce(value - lag(value) {W}, 0e0)), 6) AS rise FROM e")
def rectified_difference(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.round(w.rectified_difference("value", USER, ORDER), 6).alias("rise"))


@query(f"""WITH {E}, hot AS (SELECT * FROM e WHERE value >= 60), {runs_sql('hot', 12 * HOUR)},
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, run_id ORDER BY t, event_id) AS gap FROM runs)
SELECT user_id, run_id, min(t) AS start_us, max(t) AS end_us, arg_max(t, (value, -t)) AS peak_us, max(value) AS score, count(CASE WHEN gap > {6 * HOUR} THEN 1 END) + 1 AS runs FROM g GROUP BY user_id, run_id""")
def hot_intervals(spark: SparkSession, sf: str) -> DataFrame:
    found = w.hot_intervals(events(spark, sf), USER, "t", "value", 60.0, 4 * HOUR, 12 * HOUR, ["event_id"])
    return found.select("user_id", "run_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.col("peak").alias("peak_us"), "score", "runs")


@query("SELECT p_partkey, round((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) / greatest(count(*) OVER (PARTITION BY p_brand) - 1, 1), 6) AS norm_rank FROM part")
def norm_rank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_normalized_rank(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", ["p_partkey"], "rank").select("p_partkey", F.round("rank", 6).alias("norm_rank"))


@query("SELECT event_id, round((value - avg(value) OVER w) / coalesce(nullif(stddev_pop(value) OVER w, 0), 1), 5) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore_band(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_zscore(events(spark, sf).select("event_id", "event_type", "value"), ["event_type"], "value", "z").select("event_id", F.round("z", 5).alias("z"))


@query("SELECT event_id, round(CASE WHEN max(value) OVER w > 0 THEN value / max(value) OVER w ELSE value END, 6) AS share FROM events WINDOW w AS (PARTITION BY user_id)")
def peak_norm(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_peak_share(events(spark, sf).select("event_id", "user_id", "value"), USER, "value", "share").select("event_id", F.round("share", 6).alias("share"))


@query(f"""WITH {E}, c AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS box FROM e)
SELECT event_id, last_value(box IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM c""")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("box", F.when(F.col("event_type") == "purchase", F.col("value")))
    return rows.select("event_id", w.carry_forward("box", USER, ORDER).alias("carried"))


@query(f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, t // {HOUR} ORDER BY t, event_id) AS n FROM e) SELECT event_id, user_id, t FROM k WHERE n = 1""")
def frame_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of every user and hour."""
    rows = events(spark, sf).withColumn("slot", F.floor(F.col("t") / HOUR))
    return w.first_of(rows, ["user_id", "slot"], ORDER).select("event_id", "user_id", "t")


@query("""SELECT p_brand, p_partkey, p_retailprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 12""")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return w.top_rows(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 12).select("p_brand", "p_partkey", "p_retailprice", "rank")
