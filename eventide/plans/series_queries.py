"""Queries of the series descriptors, of ranking by reference, of shift search and of splices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import motion, render, series
from .common import E, events, query, table

USER = ["user_id"]
ORDER = ["t", "event_id"]
SHAPE = series.Shape(16, (-1, 2, 5, 12), (1, 2, 3, 4, 5, 6, 7), 8, 24)
DELAY = 4
SAMPLES = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, value AS v FROM e)"


def _fingerprint_sql(source: str, out: str, peaks: str) -> str:
    """CTEs up to out (user_id, i, value): explicit transforms of the frames of source's series at the peaks (user_id, peak, top)."""
    n, half = SHAPE.frame, SHAPE.frame // 2
    hann = [0.5 * (1 - math.cos(2 * math.pi * i / (n - 1))) for i in range(n)]
    waves = ", ".join(f"({k}, {j}, {math.cos(2 * math.pi * k * j / n) * hann[j]!r}, {-math.sin(2 * math.pi * k * j / n) * hann[j]!r})" for k in range(half) for j in range(n))
    starts = ", ".join(f"({i}, {s})" for i, s in enumerate(SHAPE.starts))
    return f"""{out}_waves AS (SELECT * FROM (VALUES {waves}) v(k, j, c, q)), {out}_starts AS (SELECT * FROM (VALUES {starts}) v(f, start)),
{out}_bins AS (SELECT p.user_id, f, k, sqrt(sum(coalesce(s.v, 0) * c) ** 2 + sum(coalesce(s.v, 0) * q) ** 2) AS m FROM {peaks} p, {out}_starts, {out}_waves w LEFT JOIN {source} s ON s.user_id = p.user_id AND s.i = p.peak + start + w.j GROUP BY p.user_id, f, k),
{out}_frames AS (SELECT user_id, f, sum(m) AS total, sum(k * m) AS weighed, exp(sum(ln(m + 1e-6)) / {half}) / (sum(m) / {half} + 1e-6) AS flat, list(m ORDER BY k) AS ms FROM {out}_bins GROUP BY user_id, f),
{out}_times AS (SELECT p.user_id, any_value(p.top) AS top, coalesce(min(p.peak - s.i) FILTER (WHERE s.i <= p.peak AND s.i > p.peak - least({SHAPE.back}, p.peak) AND abs(s.v) <= p.top * 0.1e0), least({SHAPE.back}, any_value(p.peak))) AS attack,
  coalesce(min(s.i - p.peak) FILTER (WHERE s.i >= p.peak AND s.i < p.peak + {SHAPE.ahead} AND abs(s.v) <= p.top * 0.2e0), least({SHAPE.ahead}, max(s.i) + 1 - any_value(p.peak))) AS decay FROM {peaks} p JOIN {source} s ON s.user_id = p.user_id GROUP BY p.user_id),
{out} AS (SELECT user_id, f * 10 + k AS i, CASE WHEN total > 0 THEN ms[k + 1] / total ELSE 0 END AS value FROM {out}_frames, range(8) r(k)
  UNION ALL SELECT user_id, f * 10 + 8, CASE WHEN total > 0 THEN weighed / total / {half} ELSE 0 END FROM {out}_frames UNION ALL SELECT user_id, f * 10 + 9, flat FROM {out}_frames
  UNION ALL SELECT user_id, 40, CASE WHEN top > 0 THEN least(1, attack / {SHAPE.back}) ELSE 0 END FROM {out}_times UNION ALL SELECT user_id, 41, CASE WHEN top > 0 THEN least(1, decay / {SHAPE.ahead}) ELSE 0 END FROM {out}_times)"""


PEAKS = "p AS (SELECT user_id, arg_max(i, struct_pack(a := abs(v), b := -i)) AS peak, max(abs(v)) AS top FROM s GROUP BY user_id)"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return series.placed(events(spark, sf), USER, ORDER, "value")


@query(f"WITH {E}, {SAMPLES}, {PEAKS}, {_fingerprint_sql('s', 'o', 'p')} SELECT user_id, i, round(value, 6) AS value FROM o")
def series_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """42 numbers of each user's values around the largest."""
    rows = _samples(spark, sf)
    found = series.fingerprints(rows, USER, SHAPE, series.peaks(rows, USER))
    return found.select("user_id", F.posexplode("fingerprint").alias("i", "value")).select("user_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


BURST = f"""loud AS (SELECT user_id % 7 AS bucket, arg_min(user_id, struct_pack(a := -top, b := user_id)) AS user_id, count(*) AS members FROM p WHERE top > 0 GROUP BY 1),
ls AS (SELECT s.* FROM s JOIN loud USING (user_id)), twice AS (SELECT user_id, i, sum(v) AS v FROM (SELECT user_id, i, v FROM ls UNION ALL SELECT user_id, i + {DELAY}, v FROM ls) GROUP BY user_id, i),
lp AS (SELECT p.user_id, p.peak, abs(t.v) AS top FROM p JOIN twice t ON t.user_id = p.user_id AND t.i = p.peak)"""


@query(f"""WITH {E}, {SAMPLES}, {PEAKS}, {_fingerprint_sql('s', 'o', 'p')}, {BURST}, {_fingerprint_sql('twice', 'd', 'lp')}
SELECT bucket, 'single' AS kind, any_value(members) AS members, i, round(avg(value), 6) AS value FROM o JOIN loud ON loud.bucket = o.user_id % 7 GROUP BY bucket, i
UNION ALL SELECT bucket, 'burst', members, i, round(value, 6) FROM d JOIN loud USING (user_id)""")
def series_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Mean fingerprints of groups of users, and those of their loudest series laid over itself."""
    rows = _samples(spark, sf).withColumn("bucket", F.col("user_id") % 7)
    found = series.templates(rows, USER, "bucket", SHAPE, DELAY)
    return found.select("bucket", "kind", "members", F.posexplode("template").alias("i", "value")).withColumns({"i": F.col("i").cast("long"), "value": F.round("value", 6)})


def _patch_sql(centres: str, out: str) -> str:
    """CTE out (user_id, id, d, patch): windows of six samples from two before, for centres (user_id, id, d, at)."""
    return f"""{out}_w AS (SELECT c.user_id, c.id, c.d, list(s.v ORDER BY j) AS w FROM (SELECT c.*, l.last, unnest(range(-2, 4)) AS j FROM {centres} c JOIN l USING (user_id) WHERE "at" BETWEEN 0 AND l.last) c JOIN s ON s.user_id = c.user_id AND s.i = greatest(0, least(c.last, c."at" + c.j)) GROUP BY ALL),
{out}_c AS (SELECT user_id, id, d, list_transform(w, lambda x: x - list_sum(w) / 6) AS w FROM {out}_w), {out} AS (SELECT user_id, id, d, list_transform(w, lambda x: x / CASE WHEN list_dot_product(w, w) = 0 THEN 1 ELSE sqrt(list_dot_product(w, w)) END) AS patch FROM {out}_c)"""


@query(f"""WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e), s AS (SELECT user_id, i, value AS v FROM n), l AS (SELECT user_id, max(i) AS last FROM s GROUP BY user_id),
c AS (SELECT user_id, event_id AS id, i AS "at", value / 500 AS score FROM n WHERE event_type = 'click'),
r AS (SELECT user_id, arg_min(i, i) AS "at", 0 AS id, 0 AS d FROM n WHERE event_type = 'purchase' GROUP BY user_id), m AS (SELECT user_id, id, d, "at" + d AS "at" FROM c, (VALUES (-1), (0), (1)) v(d)),
{_patch_sql('r', 'rp')}, {_patch_sql('m', 'mp')},
f AS (SELECT mp.user_id, mp.id, max(round(list_dot_product(mp.patch, rp.patch), 9)) AS sim FROM mp JOIN rp USING (user_id) GROUP BY mp.user_id, mp.id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, id) AS k FROM f) WHERE k <= 3),
more AS (SELECT user_id, patch FROM rp UNION ALL SELECT mp.user_id, mp.patch FROM mp JOIN best USING (user_id, id) WHERE mp.d = 0),
g AS (SELECT mp.user_id, mp.id, max(round(list_dot_product(mp.patch, more.patch), 9)) AS sim FROM mp JOIN more USING (user_id) GROUP BY mp.user_id, mp.id)
SELECT user_id, id AS event_id, "at", round(score, 6) AS score, round(sim, 6) AS similarity, round(score + 0.5e0 * sim, 6) AS final FROM c JOIN g USING (user_id, id)""")
def reference_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks ranked by value and by how like the series around them is to that around the user's first purchase."""
    rows = series.placed(events(spark, sf).withColumn("id", F.col("event_id")), USER, ORDER, "value", keep=["event_type", "id"])
    kinds = rows.select("user_id", F.col("id").alias("event_id"), "event_type", (F.col("v") / 500).alias("score"), F.col("i").alias("at"))
    first = kinds.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("at").alias("at"))
    found = series.rerank(rows, kinds.where("event_type = 'click'"), first, USER, "event_id", "score", 2, 3, 1)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "similarity", "final")})


@query("""WITH g AS (SELECT b.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
c AS (SELECT vec_id, sy, sx, y, x, abs(a[(y + sy) * 8 + x + sx + 1] - b[y * 8 + x + 1]) AS d FROM g, range(-2, 3) u(sy), range(-2, 3) v(sx), range(8) w(y), range(8) z(x) WHERE y + sy BETWEEN 0 AND 7 AND x + sx BETWEEN 0 AND 7),
m AS (SELECT vec_id, sy, sx, avg(d) AS cost FROM c GROUP BY vec_id, sy, sx),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, sy, sx) AS k FROM m) WHERE k = 1),
near AS (SELECT w.vec_id, w.sx, w.sy, w.cost, l.cost AS l, r.cost AS r, u.cost AS u, d.cost AS d, z.cost AS zero FROM w LEFT JOIN m l ON l.vec_id = w.vec_id AND l.sy = w.sy AND l.sx = w.sx - 1 LEFT JOIN m r ON r.vec_id = w.vec_id AND r.sy = w.sy AND r.sx = w.sx + 1
  LEFT JOIN m u ON u.vec_id = w.vec_id AND u.sx = w.sx AND u.sy = w.sy - 1 LEFT JOIN m d ON d.vec_id = w.vec_id AND d.sx = w.sx AND d.sy = w.sy + 1 JOIN m z ON z.vec_id = w.vec_id AND z.sx = 0 AND z.sy = 0),
f AS (SELECT *, 0.5e0 * (l - r) / (l - 2 * cost + r) AS fx, 0.5e0 * (u - d) / (u - 2 * cost + d) AS fy FROM near),
p AS (SELECT vec_id, y // 4 AS gy, x // 4 AS gx, sy, sx, avg(d) AS cost FROM c GROUP BY ALL),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, gy, gx ORDER BY cost, sy, sx) AS k FROM p) WHERE k = 1),
t AS (SELECT vec_id, sum(CASE WHEN gy = gx THEN sx ELSE -sx END) / 4 AS u, sum(CASE WHEN gy = gx THEN sy ELSE -sy END) / 4 AS v FROM q GROUP BY vec_id)
SELECT f.vec_id, sx AS dx, sy AS dy, round(cost, 6) AS residual, round(zero, 6) AS difference, round(sx + CASE WHEN abs(fx) <= 1 THEN fx ELSE 0 END, 6) AS x, round(sy + CASE WHEN abs(fy) <= 1 THEN fy ELSE 0 END, 6) AS y, round(sqrt(t.u * t.u + t.v * t.v), 6) AS warp FROM f JOIN t USING (vec_id)""")
def shift_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as grids of 8 x 8: the shift, of two cells at most, that takes each one's predecessor to it."""
    found = motion.shifts(table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 8, 2)
    return found.withColumns({c: F.round(c, 6) for c in ("residual", "difference", "x", "y", "warp")})


@query("""WITH RECURSIVE v AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT label, i, stddev_pop(v) AS sd FROM v GROUP BY label, i), q AS (SELECT label, list_sort(list(sd))[CAST(floor(count(*) * 0.1e0) AS INT) + 1] AS lo, list_sort(list(sd))[CAST(floor(count(*) * 0.45e0) AS INT) + 1] AS hi FROM d GROUP BY label),
c AS (SELECT d.label, i, i % 8 AS x, i // 8 AS y, d.label * 1000 + i AS id FROM d JOIN q USING (label) WHERE sd BETWEEN lo AND hi),
edge AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.label = b.label AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1),
reach AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id WHERE r.root < e.b), lab AS (SELECT c.label, c.i, min(r.root) AS component FROM c JOIN reach r ON r.id = c.id GROUP BY c.label, c.i),
s AS (SELECT label, component, count(*) AS size FROM lab GROUP BY label, component), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, component) AS k FROM s),
m AS (SELECT l.label, l.i, k.size FROM lab l JOIN k ON k.label = l.label AND k.component = l.component WHERE k.k = 1 AND k.size >= 4),
r AS (SELECT e.label, e.vec_id, b.vec_id IS NOT NULL AS paired, avg(e.embedding[m.i + 1]::DOUBLE) AS level, avg(abs(e.embedding[m.i + 1]::DOUBLE - b.embedding[m.i + 1]::DOUBLE)) AS change FROM embeddings e LEFT JOIN m USING (label) LEFT JOIN embeddings b ON b.vec_id = e.vec_id - 1 GROUP BY ALL)
SELECT label, vec_id, round(coalesce(level, 0), 6) AS level, round(CASE WHEN paired THEN coalesce(change, 0) END, 6) AS change FROM r""")
def masked_motion(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as grids: level and change within each label's largest region of cells that vary a little."""
    rows = table(spark, sf, "embeddings")
    region = motion.steady_region(rows, ["label"], "embedding", 8, 8, 0.1, 0.45, least=4)
    return motion.region_motion(rows, region, ["label"], "vec_id", "embedding", 8).withColumns({c: F.round(c, 6) for c in ("level", "change")})


CLIP, FADE, BUDGET, OUTRO = 12, 4, 20, 9
BOOM = "r AS (SELECT j, ((j * 7) % 11 - 5) / 8.7e0 AS r FROM range(12) t(j))"


@query(f"""WITH s AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_extendedprice / 12347 AS v, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), {BOOM},
b AS (SELECT l_suppkey, i AS t, n, least(coalesce(lead(i) OVER (PARTITION BY l_suppkey ORDER BY i), n), n) AS bound FROM s WHERE l_quantity >= 49),
w AS (SELECT *, least(t + {CLIP}, bound) AS e FROM b), x AS (SELECT *, least(e + greatest(0, {BUDGET} - (e - t)), bound) AS d, least({FADE}, (e - t) // 2) AS edge FROM w WHERE e > t),
ops AS (SELECT l_suppkey, t * 10 AS ord, 'scale' AS kind, greatest(0, t - {FADE}) AS a, t AS z, t, e, d, edge, n FROM x UNION ALL SELECT l_suppkey, t * 10 + 1, 'clip', t, e, t, e, d, edge, n FROM x
  UNION ALL SELECT l_suppkey, t * 10 + 2, 'original', e, d, t, e, d, edge, n FROM x UNION ALL SELECT l_suppkey, t * 10 + 3, 'in', e, CASE WHEN d > e THEN e ELSE least(n, e + {FADE}) END, t, e, d, edge, n FROM x),
hit AS (SELECT s.l_suppkey, s.i, s.v, ord, CASE WHEN kind IN ('scale', 'in') THEN 'scale' ELSE 'set' END AS what,
  CASE kind WHEN 'scale' THEN 1 - (s.i - a + 1) / (z - a) WHEN 'in' THEN (s.i - a + 1) / (z - a) WHEN 'original' THEN s.v * CASE WHEN d - e = 1 THEN 1 ELSE (s.i - e) / (d - e - 1) END
    ELSE coalesce(r.r, 0) * CASE WHEN edge > 0 AND s.i - t < edge THEN (s.i - t) / edge WHEN edge > 0 AND s.i - t >= e - t - edge THEN (e - t - 1 - (s.i - t)) / edge ELSE 1 END END AS g
  FROM s JOIN ops o ON o.l_suppkey = s.l_suppkey AND s.i >= o.a AND s.i < o.z LEFT JOIN r ON o.kind = 'clip' AND r.j = s.i - o.t),
last AS (SELECT l_suppkey, i, max(ord) FILTER (WHERE what = 'set') AS ord, arg_max(g, ord) FILTER (WHERE what = 'set') AS v FROM hit GROUP BY ALL),
scaled AS (SELECT h.l_suppkey, h.i, product(h.g) AS g FROM hit h JOIN last l ON l.l_suppkey = h.l_suppkey AND l.i = h.i AND h.what = 'scale' AND h.ord > coalesce(l.ord, -1) GROUP BY h.l_suppkey, h.i)
SELECT s.l_suppkey, s.i, round(coalesce(l.v, s.v) * coalesce(k.g, 1), 6) AS v FROM s LEFT JOIN last l USING (l_suppkey, i) LEFT JOIN scaled k USING (l_suppkey, i)
UNION ALL SELECT l_suppkey, m.n + j, round(greatest(-1, least(1, r * 3)), 6) FROM (SELECT l_suppkey, any_value(n) AS n FROM s GROUP BY l_suppkey) m, r WHERE j < {OUTRO}""")
def splice_render(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's prices as samples: a clip at its largest orders, ducked after it, and an outro."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_extendedprice") / 12347).alias("price"), "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    numbered = series.placed(rows, ["l_suppkey"], order, "price", keep=["l_quantity"])
    samples = numbered.select("l_suppkey", "i", "v")
    ends = samples.groupBy("l_suppkey").agg((F.max("i") + 1).alias("total"))
    shots = numbered.where("l_quantity >= 49").select("l_suppkey", "i").join(ends, "l_suppkey")
    windows = ev.splice_windows(shots, ["l_suppkey"], "i", F.col("total"), CLIP, budget=BUDGET)
    boom = spark.range(CLIP).select(F.col("id").alias("j"), ((F.col("id") * 7 % 11 - 5) / 8.7).alias("r"))
    spliced = render.render(samples, render.pieces(windows, ["l_suppkey"], "i", FADE, []), boom, ["l_suppkey"])
    return render.with_outro(spliced, boom, ["l_suppkey"], OUTRO, 3.0).withColumn("v", F.round("v", 6))
