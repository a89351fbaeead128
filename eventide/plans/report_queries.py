"""Queries of the error reports, splice policies and grid components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import events as ev
from ..operators import folds, metrics, reports
from .common import DAY, HOUR, MINUTE, E, events, of_type, query, scores_sql, table
from .metric_queries import MATCHED, SUMS, USER_COUNTS

USER = ["user_id"]
ORDER = ["t", "event_id"]
NEAR = 2 * HOUR
OTHERS = of_type("others", "error")
TIMELY = "OVER (PARTITION BY user_id ORDER BY t, event_id)"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return events(spark, sf, "purchase"), events(spark, sf, "click")


@query(f"""{MATCHED}, l AS (SELECT CASE WHEN value >= 40 THEN 'hard' ELSE 'easy' END AS label, event_id IN (SELECT ref FROM m WHERE ref IS NOT NULL) AS hit FROM buys)
SELECT label, count(*) AS total, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE hit) / count(*) AS recall FROM l GROUP BY label""")
def category_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of dear and of cheap purchases under one matching of all."""
    refs, preds = _sides(spark, sf)
    pairs = folds.match_one_to_one(refs, preds, USER, "t", NEAR, "event_id")
    return reports.category_recall(refs, pairs, "event_id", F.when(F.col("value") >= 40, "hard").otherwise("easy"))


@query(f"""{MATCHED}, {OTHERS}, {USER_COUNTS}, a AS (SELECT user_id, count(*) AS absorbed FROM m WHERE ref IS NULL AND EXISTS (SELECT 1 FROM others o WHERE o.user_id = m.user_id AND abs(o.t - m.pred_t) <= {NEAR}) GROUP BY user_id),
d AS (SELECT user_id, avg(abs(pred_t - ref_t)) AS error FROM m WHERE ref IS NOT NULL GROUP BY user_id)
SELECT user_id, tp, fp - coalesce(absorbed, 0) AS fp, fn, coalesce(absorbed, 0) AS absorbed, round(error / 1e6, 3) AS error FROM u LEFT JOIN a USING (user_id) LEFT JOIN d USING (user_id)""")
def score_with_others(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as detections of purchases; unmatched ones near an error event are absorbed. error in seconds."""
    refs, preds = _sides(spark, sf)
    return reports.score_with_others(refs, events(spark, sf, "error"), preds, USER, "t", NEAR, "event_id").withColumn("error", F.round(F.col("error") / 1e6, 3))


@query(f"""{MATCHED}, {USER_COUNTS}, s AS (SELECT CASE WHEN tp + fn < 10 THEN 'sparse' ELSE 'dense' END AS density, {SUMS} FROM u GROUP BY 1) SELECT density, tp, fp, fn, {scores_sql()} FROM s""")
def density_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and scores of the users with few and with many purchases."""
    refs, preds = _sides(spark, sf)
    counts = metrics.score_matches(refs, preds, folds.match_one_to_one(refs, preds, USER, "t", NEAR, "event_id"), USER)
    grouped = counts.withColumn("density", F.when(F.col("tp") + F.col("fn") < 10, "sparse").otherwise("dense"))
    return metrics.totals(grouped, ["density"]).where("density IS NOT NULL")


@query(f"""{MATCHED}, {OTHERS}, x AS (SELECT user_id, pred, pred_t FROM m WHERE ref IS NULL),
c AS (SELECT x.pred, b.event_id, row_number() OVER (PARTITION BY x.pred ORDER BY abs(b.t - x.pred_t), b.t, b.event_id) AS k FROM x JOIN buys b ON b.user_id = x.user_id AND abs(b.t - x.pred_t) <= {12 * HOUR})
SELECT x.user_id, x.pred AS event_id, x.pred_t AS t, CASE WHEN EXISTS (SELECT 1 FROM others o WHERE o.user_id = x.user_id AND abs(o.t - x.pred_t) <= {NEAR}) THEN 'other' WHEN c.event_id IS NULL THEN 'noise'
  WHEN c.event_id IN (SELECT ref FROM m WHERE ref IS NOT NULL) THEN 'duplicate' ELSE 'placement' END AS cause FROM x LEFT JOIN c ON c.pred = x.pred AND c.k = 1""")
def extra_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Why clicks match no purchase."""
    refs, preds = _sides(spark, sf)
    return reports.extra_causes(refs, events(spark, sf, "error"), preds, USER, "t", NEAR, 12 * HOUR, "event_id")


@query(f"""WITH {E}, {of_type('buys', 'purchase')}, {of_type('clicks', 'click')}, f AS (SELECT *, CASE WHEN t - lag(t) {TIMELY} <= {DAY} THEN 0 ELSE 1 END AS fresh FROM buys),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
n AS (SELECT r.user_id, r.run, r.event_id, coalesce(bool_or(c.value >= 30), false) AS hit, max(c.value) AS best FROM r LEFT JOIN clicks c ON c.user_id = r.user_id AND abs(c.t - r.t) <= {6 * HOUR} GROUP BY r.user_id, r.run, r.event_id),
g AS (SELECT user_id, run, count(*) AS n, count(*) FILTER (WHERE hit) AS got, count(*) FILTER (WHERE best IS NULL) AS none, count(*) FILTER (WHERE NOT hit AND best IS NOT NULL) AS no, max(best) FILTER (WHERE NOT hit) AS best FROM n GROUP BY user_id, run)
SELECT user_id, CAST(sum(n) AS BIGINT) AS own, CAST(sum(got) AS BIGINT) AS hit, CAST(sum(none) AS BIGINT) AS no_candidate, CAST(sum(no) AS BIGINT) AS rejected, max(best) AS best_rejected,
  CAST(coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS BIGINT) AS burst, CAST(coalesce(sum(got) FILTER (WHERE n >= 2), 0) AS BIGINT) AS burst_hit, count(*) FILTER (WHERE n >= 2 AND got > 0 AND got < n) AS partial FROM g GROUP BY user_id""")
def miss_causes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of the purchases, if clicks of 30 at least are confirmed ones and all clicks are candidates."""
    refs, preds = _sides(spark, sf)
    return reports.miss_causes(refs, preds.where("value >= 30"), preds, USER, "t", "value", 6 * HOUR, DAY, "event_id")


@query(f"""WITH RECURSIVE {E}, a AS (SELECT user_id, t, row_number() {TIMELY} AS i FROM e WHERE event_type = 'click'), b AS (SELECT user_id, list(t ORDER BY t, event_id) AS ts FROM e WHERE event_type = 'view' GROUP BY user_id),
n AS (SELECT a.user_id, a.i, coalesce(list_filter(range(1, len(b.ts) + 1), lambda k: abs(b.ts[k] - a.t) <= {HOUR}), []) AS ks FROM a LEFT JOIN b USING (user_id)),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used FROM a
  UNION ALL SELECT n.user_id, n.i, CASE WHEN len(list_filter(n.ks, lambda k: NOT list_contains(w.used, k))) > 0 THEN list_append(w.used, list_filter(n.ks, lambda k: NOT list_contains(w.used, k))[1]) ELSE w.used END FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id, CAST(max(len(used)) AS BIGINT) AS same FROM w GROUP BY user_id HAVING max(len(used)) > 0""")
def same_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """How many clicks have a view of their own within an hour: agreement of two detectors."""
    pairs = folds.match_one_to_one(events(spark, sf, "view"), events(spark, sf, "click"), USER, "t", HOUR, "event_id")
    return pairs.groupBy("user_id").agg(F.count("*").alias("same"))


@query(f"""WITH {E}, v AS (SELECT *, CAST(floor(value / 10) AS BIGINT) - 1 AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS r FROM e),
d AS (SELECT user_id, v, r, lag(v) {TIMELY} AS a, lag(r) {TIMELY} AS ra FROM v), k AS (SELECT *, v - a AS d, ra - r AS paid, v >= 0 AND a >= 0 AND v <> a AND r IS NOT NULL AND ra IS NOT NULL AS told FROM d)
SELECT user_id, count(*) FILTER (WHERE told AND d BETWEEN -3 AND -1) AS shots, count(*) FILTER (WHERE told AND d BETWEEN -3 AND -1 AND paid = 0) AS held, count(*) FILTER (WHERE told AND d > 0) AS reloads,
  count(*) FILTER (WHERE told AND d > 0 AND paid = d) AS conserved, count(*) FILTER (WHERE told AND d > 0 AND paid <> d) AS switches FROM k GROUP BY user_id""")
def counter_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Values as a counter (under 10: unread) and the number in the properties as its reserve."""
    reads = events(spark, sf).withColumn("v", F.floor(F.col("value") / 10) - 1).withColumn("r", F.get_json_object("props", "$.k").cast("long") % 4)
    return reports.conservation(reads, USER, ORDER, "v", "r")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), a AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM n)
SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS INT) AS place FROM a WHERE n >= greatest(8, floor(total * 0.1e0))""")
def lasting_slots(spark: SparkSession, sf: str) -> DataFrame:
    return reports.lasting_slots(table(spark, sf, "events").select("user_id", "event_type"), USER, "event_type")


@query(f"""WITH {E}, f AS (SELECT user_id, event_id, t, value / 100 AS strength FROM e WHERE event_type = 'purchase' AND value >= 5 UNION ALL SELECT user_id, event_id, t, 1e0 FROM e WHERE event_type = 'click' AND value < 5),
m AS (SELECT user_id, event_id, CASE WHEN strength >= 0.9e0 AND strength <> 1 THEN t - {DAY} ELSE t END AS t, strength FROM f)
SELECT user_id, event_id, t, strength, CAST(row_number() {TIMELY} AS INT) AS place FROM m""")
def edited_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as marks: cheap clicks are added, cheap purchases removed, dear ones moved a day back."""
    buys, clicks = _sides(spark, sf)
    moved = buys.where("value / 100 >= 0.9 AND value / 100 <> 1").select("event_id", (F.col("t") - DAY).alias("to"))
    return reports.edited_marks(buys.withColumn("strength", F.col("value") / 100), clicks.where("value < 5"), buys.where("value < 5"), moved, USER, "t", "event_id")


@query(f"""WITH {E}, n AS (SELECT user_id, t / 1e6 AS t, row_number() {TIMELY} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, min(t) OVER (PARTITION BY user_id) / 1e6 AS t0, max(t) OVER (PARTITION BY user_id) / 1e6 AS t1 FROM e),
o AS (SELECT user_id, n, (n - 1) / (t1 - t0) AS rate, abs(t - t0 - i * (t1 - t0) / (n - 1)) AS off FROM n WHERE n > 1), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off) - 1 AS place FROM o)
SELECT user_id, n, round(rate * 3600, 6) AS hourly, round(max(off), 2) AS worst, round(max(off) FILTER (WHERE place = n // 2), 2) AS middle FROM k GROUP BY user_id, n, rate""")
def clock_drift(spark: SparkSession, sf: str) -> DataFrame:
    """How far a user's events are from an even beat, in seconds."""
    rows = events(spark, sf).withColumn("t", F.col("t") / 1e6)
    found = reports.clock_drift(rows, USER, "t", ["event_id"]).where("n > 1")
    return found.select("user_id", "n", F.round(F.col("rate") * 3600, 6).alias("hourly"), F.round("worst", 2).alias("worst"), F.round("middle", 2).alias("middle"))


@query(f"""WITH {E}, n AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS place, count(*) OVER (PARTITION BY user_id, event_type) AS size FROM e)
SELECT a.user_id, CAST(a.place AS INT) AS place, a.value AS a, b.value AS b FROM n a JOIN n b ON a.user_id = b.user_id AND a.place = b.place AND a.size = b.size WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def ordinal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """k-th click with k-th purchase of users who have equally many."""
    buys, clicks = _sides(spark, sf)
    return reports.ordinal_pairs(clicks, buys, USER, ORDER, "value")


GRID = "WITH RECURSIVE cell AS (SELECT DISTINCT p_size % 3 AS zone, p_partkey * 13 % 40 AS x, p_partkey * 29 % 37 AS y FROM part)"
GRID += """, c AS (SELECT zone, x, y, zone * 1000000 + y * 1000 + x AS id FROM cell), edge AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.zone = b.zone AND {near} AND a.id <> b.id),
reach AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id WHERE r.root < e.b), lab AS (SELECT c.zone, c.x, c.y, min(r.root) AS component FROM c JOIN reach r ON r.id = c.id GROUP BY c.zone, c.x, c.y),
s AS (SELECT zone, component, count(*) AS size FROM lab GROUP BY zone, component), k AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY size DESC, component) AS k FROM s)
SELECT l.zone, l.x, l.y, k.size FROM lab l JOIN k ON k.zone = l.zone AND k.component = l.component WHERE k.k = 1"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select((F.col("p_size") % 3).alias("zone"), (k * 13 % 40).alias("x"), (k * 29 % 37).alias("y"))


@query(GRID.format(near="abs(a.x - b.x) + abs(a.y - b.y) = 1"))
def grid_component4(spark: SparkSession, sf: str) -> DataFrame:
    return reports.grid_component(_cells(spark, sf), ["zone"], "x", "y")


@query(GRID.format(near="greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1"))
def grid_component8(spark: SparkSession, sf: str) -> DataFrame:
    return reports.grid_component(_cells(spark, sf), ["zone"], "x", "y", corners=True)


TOTAL, CLIP = 2_000_000_000 * 1_000_000, HOUR
BOUND = f"b AS (SELECT *, least(coalesce(lead(t) {TIMELY}, {TOTAL}), {TOTAL}) AS bound FROM e), i AS (SELECT *, least(t + {CLIP}, bound) AS insert_end FROM b)"


@query(f"""WITH {E}, {BOUND}, m AS (SELECT *, least(t + {HOUR // 2}, bound) AS muted FROM b)
SELECT 'budget' AS policy, event_id, insert_end, insert_end AS mute_end, least(insert_end + greatest(0, {2 * HOUR} - (insert_end - t)), bound) AS duck_end FROM i WHERE insert_end > t
UNION ALL SELECT 'mute', event_id, least(t + {CLIP}, muted), muted, muted FROM m WHERE muted > t""")
def splice_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of replacements an hour long under a budget for ducking, and under a mute of half an hour."""
    shots, out = events(spark, sf).select("event_id", "user_id", "t"), ["event_id", "insert_end", "mute_end", "duck_end"]
    budget = ev.splice_windows(shots, USER, "t", TOTAL, CLIP, ["event_id"], budget=2 * HOUR).select(F.lit("budget").alias("policy"), *out)
    return budget.unionByName(ev.splice_windows(shots, USER, "t", TOTAL, CLIP, ["event_id"], mute=HOUR // 2).select(F.lit("mute").alias("policy"), *out))


DECAY = f"""n AS (SELECT *, row_number() {TIMELY} AS i, count(*) OVER (PARTITION BY user_id) AS size FROM e),
calm AS (SELECT a.event_id, b.i - a.i AS off, b.value <= a.value * 0.5e0 AS low FROM n a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + 19),
two AS (SELECT x.event_id, min(x.off) AS off FROM calm x JOIN calm y ON y.event_id = x.event_id AND y.off = x.off + 1 WHERE x.low AND y.low GROUP BY x.event_id),
d AS (SELECT n.event_id, CASE WHEN n.value = 0 THEN 0 ELSE coalesce(two.off, least(20, n.size - n.i + 1)) END AS decay FROM n LEFT JOIN two USING (event_id))"""


@query(f"WITH {E}, {DECAY} SELECT event_id, decay FROM d")
def decay_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Rows until a user's values stay at half a value or less for two rows, twenty at most."""
    return ev.decay_ends(events(spark, sf), USER, ORDER, "value", 0.5, 2, 20).select("event_id", "decay")


@query(f"""WITH {E}, {DECAY}, {BOUND} SELECT event_id, insert_end, least(greatest(insert_end, t + decay * {10 * MINUTE}), insert_end + {HOUR}, bound) AS mute_end FROM i JOIN d USING (event_id) WHERE insert_end > t""")
def splice_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Replacements after which the original stays muted until it has decayed, an hour at most."""
    shots = ev.decay_ends(events(spark, sf), USER, ORDER, "value", 0.5, 2, 20).withColumn("until", F.col("t") + F.col("decay") * 10 * MINUTE)
    return ev.splice_windows(shots, USER, "t", TOTAL, CLIP, ["event_id"], decay="until", extension=HOUR).select("event_id", "insert_end", "mute_end")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS shown, CAST(floor((epoch(o_orderdate) - 694224000) * 0.25e0 + 0.5e0) AS BIGINT) AS frame FROM orders")
def dates_and_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as text, and as numbers of four-second frames since 1992."""
    orders = table(spark, sf, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    return orders.select("o_orderkey", s.iso_date("o_orderdate").alias("shown"), s.frame_index(at, F.lit(694224000), 0.25).alias("frame"))


@query("WITH s AS (SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS share FROM orders GROUP BY 1) SELECT priority, CAST(CAST(round(share * 100, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' AS shown FROM s")
def shown_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of finished orders as a report shows them."""
    shares = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share"))
    return shares.select("priority", s.percent(F.col("share")).alias("shown"))
