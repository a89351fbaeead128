"""Queries of the scoring, median, fold, vector, set and scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import blocks, folds, metrics, vectors
from ..operators import windows as w
from .common import DAY, HOUR, E, events, of_type, query, scores_sql, table

USER = ["user_id"]


# --- one-to-one matching and its scores (the SQL walks a user's rows by recursion) ---

TIMELY = "OVER (PARTITION BY user_id ORDER BY t, event_id) AS"


def matched_sql(tolerance: int, nearest: bool = False, refs: str = "buys", preds: str = "clicks") -> str:
    """CTEs up to m (user_id, pred, pred_t, ref, ref_t; ref is null for the unmatched): preds in time order take a later ref than the one before, the first or the nearest within the tolerance."""
    by = "abs(r.t - p.t), r.k" if nearest else "r.k"
    return f"""r AS (SELECT user_id, event_id, t, row_number() {TIMELY} k FROM {refs}), p AS (SELECT user_id, event_id, t, row_number() {TIMELY} i FROM {preds}),
near AS (SELECT p.user_id, p.i, list(r.k ORDER BY {by}) FILTER (WHERE r.k IS NOT NULL) AS ks FROM p LEFT JOIN r ON r.user_id = p.user_id AND abs(r.t - p.t) <= {tolerance} GROUP BY p.user_id, p.i),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS k FROM p
  UNION ALL SELECT n.user_id, n.i, coalesce(list_filter(n.ks, lambda x: x > w.used)[1], w.used), list_filter(n.ks, lambda x: x > w.used)[1] FROM w JOIN near n ON n.user_id = w.user_id AND n.i = w.i + 1),
m AS (SELECT p.user_id, p.event_id AS pred, p.t AS pred_t, r.event_id AS ref, r.t AS ref_t FROM w JOIN p ON p.user_id = w.user_id AND p.i = w.i LEFT JOIN r ON r.user_id = w.user_id AND r.k = w.k)"""


CLICKS, BUYS = of_type("clicks", "click"), of_type("buys", "purchase")
MATCHED = f"WITH RECURSIVE {E}, {BUYS}, {CLICKS}, {matched_sql(2 * HOUR)}"
USER_COUNTS = """c AS (SELECT user_id, count(*) FILTER (WHERE k = 'b') AS refs, count(*) FILTER (WHERE k = 'c') AS preds FROM (SELECT user_id, 'b' AS k FROM buys UNION ALL SELECT user_id, 'c' FROM clicks) GROUP BY user_id),
h AS (SELECT user_id, count(*) AS tp FROM m WHERE ref IS NOT NULL GROUP BY user_id),
u AS (SELECT user_id, coalesce(tp, 0) AS tp, preds - coalesce(tp, 0) AS fp, refs - coalesce(tp, 0) AS fn FROM c LEFT JOIN h USING (user_id))"""
SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"


@query(f"{MATCHED} SELECT user_id, ref, pred, ref_t, pred_t FROM m WHERE ref IS NOT NULL")
def match_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    return folds.match_one_to_one(events(spark, sf, "purchase"), events(spark, sf, "click"), USER, "t", 2 * HOUR, "event_id")


@query(f"{MATCHED}, {USER_COUNTS}, s AS (SELECT user_id, {SUMS} FROM u GROUP BY ROLLUP (user_id)) SELECT user_id, tp, fp, fn, {scores_sql()} FROM s")
def score_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as detections of purchases: counts and scores per user and in total (null user)."""
    refs, preds = events(spark, sf, "purchase"), events(spark, sf, "click")
    pairs = folds.match_one_to_one(refs, preds, USER, "t", 2 * HOUR, "event_id")
    return metrics.totals(metrics.score_matches(refs, preds, pairs, USER), USER)


@query(f"""WITH RECURSIVE {E}, n AS (SELECT *, row_number() {TIMELY} i, count(*) OVER (PARTITION BY user_id) AS size FROM e),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, false AS armed, false AS fell, CAST(0 AS BIGINT) AS pt, 0e0 AS pv, size FROM n
  UNION ALL SELECT n.user_id, n.i, CASE WHEN w.armed THEN n.value >= w.pv * 0.3e0 ELSE n.value > 100 END, w.armed AND n.value < w.pv * 0.3e0,
    CASE WHEN n.value > CASE WHEN w.armed THEN w.pv ELSE 100 END THEN n.t ELSE w.pt END, CASE WHEN n.value > CASE WHEN w.armed THEN w.pv ELSE 100 END THEN n.value ELSE w.pv END, n.size FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id, pt AS t, pv AS value FROM w WHERE fell OR (armed AND i = size)""")
def hysteresis_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return folds.hysteresis_peaks(events(spark, sf), USER, ["t", "event_id"], "t", "value", 100.0, 0.3)


def suppressed_sql(t: str, gap: int) -> str:
    """Walk by score: a row stays unless a kept one is closer than gap."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM n),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept, false AS keep FROM n
  UNION ALL SELECT o.user_id, o.rank, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.{t}) < {gap})) = 0 THEN list_append(w.kept, o.{t}) ELSE w.kept END, len(list_filter(w.kept, lambda x: abs(x - o.{t}) < {gap})) = 0 FROM w JOIN o ON o.user_id = w.user_id AND o.rank = w.rank + 1)
SELECT o.user_id, o.event_id, o.{t}, o.value FROM w JOIN o ON o.user_id = w.user_id AND o.rank = w.rank WHERE w.keep"""


@query(f"WITH RECURSIVE {E}, n AS (SELECT * FROM e), {suppressed_sql('t', 6 * HOUR)}")
def nms_time(spark: SparkSession, sf: str) -> DataFrame:
    return folds.suppress(events(spark, sf), USER, "t", "value", 6 * HOUR, "event_id")


@query(f"WITH RECURSIVE {E}, n AS (SELECT *, row_number() {TIMELY} i FROM e), {suppressed_sql('i', 4)}")
def nms_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same over row numbers: no two kept rows of a user within three rows."""
    numbered = events(spark, sf).withColumn("i", F.row_number().over(w.ordered(USER, ["t", "event_id"])).cast("long"))
    return folds.suppress(numbered, USER, "i", "value", 4, "event_id")


@query(f"""WITH RECURSIVE {E}, n AS (SELECT *, row_number() {TIMELY} i FROM e),
w AS (SELECT user_id, i, event_id, t, value, 1 AS g FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, CASE WHEN n.t - w.t < {6 * HOUR} AND n.value <= w.value THEN w.event_id ELSE n.event_id END, CASE WHEN n.t - w.t < {6 * HOUR} AND n.value <= w.value THEN w.t ELSE n.t END,
    CASE WHEN n.t - w.t < {6 * HOUR} AND n.value <= w.value THEN w.value ELSE n.value END, CASE WHEN n.t - w.t < {6 * HOUR} THEN w.g ELSE w.g + 1 END FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id, arg_max(event_id, i) AS event_id, arg_max(t, i) AS t, arg_max(value, i) AS value FROM w GROUP BY user_id, g""")
def merge_close(spark: SparkSession, sf: str) -> DataFrame:
    return folds.merge_close(events(spark, sf), USER, "t", "value", 6 * HOUR, "event_id")


@query(f"WITH RECURSIVE {E}, {BUYS}, {CLICKS}, {matched_sql(DAY // 4, nearest=True, refs='clicks', preds='buys')} SELECT user_id, pred AS event_id, pred_t AS t, ref AS candidate FROM m")
def confirm_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return folds.confirm_in_order(events(spark, sf, "purchase"), events(spark, sf, "click"), USER, "t", DAY // 4, "event_id")


@query("""WITH RECURSIVE x AS (SELECT p_brand, p_partkey, p_retailprice, substr(p_type, 1, 5) AS kind, CAST(p_partkey % 37 AS DOUBLE) AS x, CAST(p_partkey % 23 AS DOUBLE) AS y, CAST(p_size % 20 + 5 AS DOUBLE) AS w, CAST(p_size % 11 + 5 AS DOUBLE) AS h FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, kind ORDER BY p_retailprice DESC, p_partkey) AS i FROM x),
pairs AS (SELECT a.p_brand, a.kind, a.i, b.i AS k, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared, a.w * a.h + b.w * b.h AS sizes FROM b a JOIN b ON b.p_brand = a.p_brand AND b.kind = a.kind AND b.i < a.i),
n AS (SELECT b.*, coalesce(o.ks, []) AS ks FROM b LEFT JOIN (SELECT p_brand, kind, i, list(k) AS ks FROM pairs WHERE shared / (sizes - shared) > 0.45e0 GROUP BY p_brand, kind, i) o ON o.p_brand = b.p_brand AND o.kind = b.kind AND o.i = b.i),
walk AS (SELECT DISTINCT p_brand, kind, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, false AS keep FROM b
  UNION ALL SELECT n.p_brand, n.kind, n.i, CASE WHEN list_has_any(n.ks, walk.kept) THEN walk.kept ELSE list_append(walk.kept, n.i) END, NOT list_has_any(n.ks, walk.kept) FROM walk JOIN n ON n.p_brand = walk.p_brand AND n.kind = walk.kind AND n.i = walk.i + 1)
SELECT b.p_brand, b.kind, b.p_partkey, b.p_retailprice FROM walk JOIN b ON b.p_brand = walk.p_brand AND b.kind = walk.kind AND b.i = walk.i WHERE walk.keep""")
def box_iou_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from part sizes, suppressed within each brand and type."""
    key = F.col("p_partkey")
    boxes = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", F.substring("p_type", 1, 5).alias("kind"), (key % 37).alias("x"), (key % 23).alias("y"), (F.col("p_size") % 20 + 5).alias("w"), (F.col("p_size") % 11 + 5).alias("h"))
    return folds.suppress_boxes(boxes, ["p_brand"], "p_partkey", "p_retailprice", "kind", 0.45)


# --- scores ---

COUNTS = "WITH o AS (SELECT n.n_regionkey AS region, o.o_orderstatus = 'F' AS ref, o.o_totalprice >= 150000 AS pred FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey)"


@query(f"""{COUNTS}, s AS (SELECT coalesce(region, -1) AS region, count(*) FILTER (WHERE ref AND pred) AS tp, count(*) FILTER (WHERE pred AND NOT ref) AS fp, count(*) FILTER (WHERE ref AND NOT pred) AS fn FROM o GROUP BY GROUPING SETS ((region), ()))
SELECT region, tp, fp, fn, {scores_sql()} FROM s""")
def micro_average(spark: SparkSession, sf: str) -> DataFrame:
    """Large orders as predictions of finished ones: counts per region and in all (-1), then ratios."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("ref"), (F.col("o_totalprice") >= 150000).alias("pred"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = rows.groupBy("region").agg(n(F.col("ref") & F.col("pred")).alias("tp"), n(F.col("pred") & ~F.col("ref")).alias("fp"), n(F.col("ref") & ~F.col("pred")).alias("fn"))
    return metrics.totals(counts, ["region"]).withColumn("region", F.coalesce("region", F.lit(-1)))


LABELLED = "x AS (SELECT d.doc_id, d.source, d.n_chars, l.quality FROM labels l JOIN documents d USING (doc_id))"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")


@query(f"""WITH {LABELLED}, r AS (SELECT quality, avg(rn) OVER (PARTITION BY n_chars) AS rank FROM (SELECT *, row_number() OVER (ORDER BY n_chars) AS rn FROM x))
SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg,
round((sum(rank) FILTER (WHERE quality = 1) - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 9) AS auc FROM r""")
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rank_auc(_labelled(spark, sf), [], "n_chars", "quality").select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@query(f"""WITH {LABELLED}, c AS (SELECT *, sum(quality) OVER w AS tp, sum(1 - quality) OVER w AS fp, sum(quality) OVER () AS n FROM x WINDOW w AS (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT n_chars AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, fp / tp AS ratio FROM c WHERE tp >= n * 0.8e0 ORDER BY tp, fp LIMIT 1""")
def extras_at_recall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.extras_at_recall(_labelled(spark, sf), [], "n_chars", "quality", ["doc_id"], 0.8)


GRID = [float(t) for t in range(0, 10000, 500)]
SWEEP = f"""{LABELLED}, g AS (SELECT CAST(t * 500 AS DOUBLE) AS threshold FROM generate_series(0, 19) s(t)),
c AS (SELECT threshold, count(*) FILTER (WHERE n_chars >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= threshold AND quality = 0) AS fp, count(*) FILTER (WHERE n_chars < threshold AND quality = 1) AS fn FROM x CROSS JOIN g GROUP BY threshold)"""


@query(f"WITH {SWEEP} SELECT threshold, tp, fp, fn, {scores_sql()} FROM c")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sweep(_labelled(spark, sf), [], "n_chars", "quality", GRID)


@query(f"WITH {SWEEP}, s AS (SELECT threshold, {scores_sql()} FROM c) SELECT threshold, f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_threshold(metrics.sweep(_labelled(spark, sf), [], "n_chars", "quality", GRID), [])


@query(f"""WITH {LABELLED}, f AS (SELECT source, CAST((dense_rank() OVER (ORDER BY source) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT source FROM x)),
g AS (SELECT CAST(t * 500 AS DOUBLE) AS threshold FROM generate_series(0, 19) s(t)),
c AS (SELECT fold, threshold, count(*) FILTER (WHERE n_chars >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= threshold AND quality = 0) AS fp, count(*) FILTER (WHERE n_chars < threshold AND quality = 1) AS fn FROM x JOIN f USING (source) CROSS JOIN g GROUP BY fold, threshold),
t AS (SELECT a.fold AS fold, c.threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT DISTINCT fold FROM f) a JOIN c ON c.fold <> a.fold GROUP BY a.fold, c.threshold),
s AS (SELECT fold, threshold, {scores_sql()} FROM t),
b AS (SELECT fold, threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, threshold) AS k FROM s) WHERE k = 1)
SELECT b.fold, b.threshold, c.tp, c.fp, c.fn, {scores_sql()} FROM b JOIN c USING (fold, threshold)""")
def cv_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cross_validated(_labelled(spark, sf), "source", "n_chars", "quality", GRID, 5)


@query("""WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, median, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS upper, v[least(len(v), CAST(floor(len(v) * 0.9e0) AS INT) + 1)] AS quantile FROM m""")
def medians(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.medians(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")


@query("""WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, round(any_value(m.median), 6) AS median, round(quantile_cont(abs(o.o_totalprice - m.median), 0.5), 6) AS mad FROM orders o JOIN m USING (o_orderpriority) GROUP BY o_orderpriority""")
def mad_spread(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.mad(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return found.select("o_orderpriority", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM c)
SELECT p_brand, p_size AS mode, n FROM r WHERE k = 1 AND n >= 2""")
def mode_low(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mode_low(table(spark, sf, "part"), ["p_brand"], "p_size").where("mode IS NOT NULL")


SIX = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"""WITH d AS (SELECT l_partkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY {', '.join(SIX)}) AS delta FROM lineitem),
g AS (SELECT l_partkey, count(delta) AS steps, count(*) FILTER (WHERE delta BETWEEN -3 AND -1) AS small, count(*) FILTER (WHERE delta < 0) AS drops, count(*) FILTER (WHERE delta > 0) AS reloads,
  coalesce(stddev_pop(delta) / nullif(avg(abs(delta)), 0), 0) AS spread FROM d GROUP BY l_partkey)
SELECT l_partkey, drops, small, reloads, round(0.45e0 * CASE WHEN drops > 0 THEN small / drops ELSE 0e0 END + 0.3e0 * least(1e0, spread / 0.35e0) + 0.25e0 * CASE WHEN reloads >= 2 THEN 1e0 ELSE 0e0 END, 6) AS score FROM g""")
def counter_score(spark: SparkSession, sf: str) -> DataFrame:
    """How much a part's quantities look like a counter: share of small drops, spread, reloads."""
    reads = w.counter_drops(table(spark, sf, "lineitem").select("l_partkey", *SIX), ["l_partkey"], SIX, "l_quantity")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    spread = F.coalesce(F.stddev_pop("delta") / F.nullif(F.avg(F.abs("delta")), F.lit(0.0)), F.lit(0.0))
    g = reads.groupBy("l_partkey").agg(n(F.col("delta") < 0).alias("drops"), n(F.col("delta").between(-3, -1)).alias("small"), n(F.col("delta") > 0).alias("reloads"), spread.alias("spread"))
    small = F.when(F.col("drops") > 0, F.col("small") / F.col("drops")).otherwise(0.0)
    score = 0.45 * small + 0.3 * F.least(F.lit(1.0), F.col("spread") / 0.35) + 0.25 * F.when(F.col("reloads") >= 2, 1.0).otherwise(0.0)
    return g.select("l_partkey", "drops", "small", "reloads", F.round(score, 6).alias("score"))


@query(f"""WITH {E}, a AS (SELECT event_type, t / 1e6 * 2 * 3.141592653589793 / 86400 AS a FROM e),
m AS (SELECT event_type, atan2(sum(sin(a)), sum(cos(a))) / (2 * 3.141592653589793) * 86400 AS x FROM a GROUP BY event_type)
SELECT event_type, round(CASE WHEN x < 0 THEN x + 86400 ELSE x END, 2) AS phase FROM m""")
def circular_phase(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("s", F.col("t") / 1e6)
    return rows.groupBy("event_type").agg(F.round(metrics.circular_phase(F.col("s"), 86400.0), 2).alias("phase"))


PERIODS = {"1h": HOUR, "2h": 2 * HOUR, "3h": 3 * HOUR, "6h": 6 * HOUR}


@query(f"""WITH {E}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e), k AS (SELECT * FROM g WHERE gap <= {DAY}),
p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {p})" for n, p in PERIODS.items())}) v(name, period)),
v AS (SELECT user_id, name, period, count(*) AS n, count(*) FILTER (WHERE abs(gap - floor(gap / period + 0.5) * period) <= {HOUR // 6} AND floor(gap / period + 0.5) >= 1) AS hits FROM k CROSS JOIN p GROUP BY user_id, name, period),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, period DESC) AS b FROM v)
SELECT user_id, name AS period, n, hits, hits >= ceil(0.6 * n) AS accepted FROM r WHERE b = 1""")
def period_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The tabulated period that most of a user's gaps are whole multiples of."""
    gap = F.col("t") - F.lag("t").over(w.ordered(USER, ["t", "event_id"]))
    gaps = events(spark, sf).select("user_id", gap.alias("gap")).where(F.col("gap") <= DAY)
    table_of = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("period")) for n, p in PERIODS.items()]))
    each = gaps.withColumn("p", table_of).select("user_id", "gap", "p.*")
    multiple = F.floor(F.col("gap") / F.col("period") + 0.5)
    hit = (F.abs(F.col("gap") - multiple * F.col("period")) <= HOUR // 6) & (multiple >= 1)
    votes = each.groupBy("user_id", "name", "period").agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("hits"))
    best = votes.groupBy("user_id").agg(F.max_by(F.struct("name", "n", "hits"), F.struct("hits", "period")).alias("b"))
    return best.select("user_id", F.col("b.name").alias("period"), "b.n", "b.hits", (F.col("b.hits") >= F.ceil(0.6 * F.col("b.n"))).alias("accepted"))


@query("""SELECT event_type, round(avg(CASE WHEN abs(value - 50) <= 10 THEN 1e0 ELSE 0 END), 6) AS near, round(avg(CASE WHEN abs(value - 50) <= 33 THEN 1e0 ELSE 0 END), 6) AS far FROM events GROUP BY event_type""")
def share_within(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("delta", F.col("value") - 50)
    found = metrics.shares_within(rows, ["event_type"], "delta", {"near": 10.0, "far": 33.0})
    return found.select("event_type", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"))


@query("""WITH p AS (SELECT p_brand, p_retailprice AS v, row_number() OVER u AS n0, sum(p_retailprice) OVER u AS s0, count(*) OVER w AS n, sum(p_retailprice) OVER w AS s, max(p_retailprice) OVER w - min(p_retailprice) OVER w AS span FROM part
  WINDOW u AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY p_brand))
SELECT p_brand, CASE WHEN any_value(n) >= 6 AND any_value(span) > 0 THEN round(4 * max(n0 * (n - n0) / (n * n) * (s0 / n0 - (s - s0) / nullif(n - n0, 0)) ** 2) / any_value(span) ** 2, 6) ELSE 0e0 END AS separation FROM p GROUP BY p_brand""")
def split_separation(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.otsu_separation(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return found.select("p_brand", F.round("separation", 6).alias("separation"))


@query("SELECT event_type, round(corr(value, user_id), 6) AS r FROM events GROUP BY event_type")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("event_type").agg(F.round(F.corr("value", "user_id"), 6).alias("r"))


# --- vectors: every twentieth row is a query against all rows ---

COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
PAIRS = f"p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM p) SELECT a, b, CAST(rank AS INT) AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return blocks.top_partners(rows.where("vec_id % 20 = 0"), rows, ["label"], "vec_id", "embedding", 5).select("a", "b", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {PAIRS}, core AS (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0), k AS (SELECT p.*, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n FROM p JOIN core ON core.vec_id = p.b) SELECT a, round(sim, 6) AS kth FROM k WHERE r = least(3, n) AND sim >= 0.1")
def component_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Query rows whose third best likeness to the core rows of their label is 0.1 at least."""
    rows = table(spark, sf, "embeddings").where("label IS NOT NULL")
    best = blocks.top_partners(rows.where("vec_id % 20 = 0"), rows.where("vec_id % 3 = 0"), ["label"], "vec_id", "embedding", 3)
    return blocks.gate(best, 0.1).select("a", F.round("kth", 6).alias("kth"))


@query(f"WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS near, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM p) SELECT a AS vec_id, near, round(sim, 6) AS similarity FROM r WHERE k = 1")
def knn_label(spark: SparkSession, sf: str) -> DataFrame:
    """Label of the nearest other row to each query row: best in every block of rows first, then over the blocks."""
    rows = table(spark, sf, "embeddings")
    best = blocks.top_partners(rows.where("vec_id % 20 = 0"), rows, [], "vec_id", "embedding", 1)
    named = best.join(rows.select(F.col("vec_id").alias("b"), F.col("label").alias("near")), "b")
    return named.select(F.col("a").alias("vec_id"), "near", F.round("similarity", 6).alias("similarity"))


@query("SELECT label, CAST(i AS INT) AS i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    means = vectors.mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("i", "mean")).withColumn("mean", F.round("mean", 5))


# --- strings, sets, JSON ---


@query("SELECT page_id, substr(regexp_replace(regexp_replace(lower(regexp_replace(url, '\\.[^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM pages")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", s.slug_base(F.col("url")).alias("slug"))


@query("""WITH f AS (SELECT page_id, strip_accents(url) AS name, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv FROM pages)
SELECT page_id, substr(regexp_replace(regexp_replace(lower(regexp_replace(name, '\\.[^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) || '-' || format('{:08x}', fnv) AS slug FROM f""")
def slugify_fnv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", s.slugify(F.col("url")).alias("slug"))


USERS = f"WITH {E}, {of_type('clicks', 'click')}, {of_type('buys', 'purchase')}"


def _users(spark: SparkSession, sf: str, kind: str, below: float) -> DataFrame:
    return events(spark, sf, kind).where(F.col("value") < below).select("user_id")


@query(f"{USERS} SELECT user_id FROM clicks WHERE value < 3 UNION SELECT user_id FROM buys WHERE value < 3")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return _users(spark, sf, "click", 3).unionByName(_users(spark, sf, "purchase", 3)).distinct()


@query(f"{USERS} SELECT user_id FROM clicks WHERE value < 10 INTERSECT SELECT user_id FROM buys WHERE value < 10")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return _users(spark, sf, "click", 10).intersect(_users(spark, sf, "purchase", 10))


@query(f"{USERS} SELECT user_id FROM clicks WHERE value < 10 EXCEPT SELECT user_id FROM buys WHERE value < 10")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return _users(spark, sf, "click", 10).subtract(_users(spark, sf, "purchase", 10))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_path(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""WITH c AS (SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey)
SELECT CASE WHEN n <= 8 THEN 'sparse' ELSE 'dense' END AS density, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM c GROUP BY 1""")
def density_split(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with few and with many orders: the groups of a density report."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.groupBy(F.when(F.col("n") <= 8, "sparse").otherwise("dense").alias("density")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))
