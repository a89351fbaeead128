"""Folds against plain restatements, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import folds, metrics
from eventide.plans import metric_queries as q
from eventide.plans.common import HOUR, events


def by_user(spark, sf, *kinds):
    out = {}
    for r in sorted(events(spark, sf, *kinds).collect(), key=lambda r: (r.t, r.event_id)):
        out.setdefault(r.user_id, []).append(r)
    return out


def test_matching_is_the_sweep(spark, sf):
    refs, preds = by_user(spark, sf, "purchase"), by_user(spark, sf, "click")
    want = set()
    for u, ps in preds.items():
        at, rs = 0, refs.get(u, [])
        for p in ps:
            for i in range(at, len(rs)):
                if p.t - 2 * HOUR <= rs[i].t <= p.t + 2 * HOUR:
                    want.add((u, rs[i].event_id, p.event_id))
                    at = i + 1
                    break
    got = q.match_one_to_one(spark, sf).collect()
    assert {(r.user_id, r.ref, r.pred) for r in got} == want and len(got) == len(want)
    assert len({r.ref for r in got}) == len({r.pred for r in got}) == len(got)


def make(spark, times, kind="x"):
    return spark.createDataFrame([(1, i, int(t)) for i, t in enumerate(times)], "user_id long, event_id long, t long")


@pytest.mark.parametrize(("refs", "preds", "n"), [([100, 200], [150, 240], 2), ([100], [90, 110], 1), ([], [5], 0), ([5], [], 0), ([0, 40], [45, 90], 2), ([10, 10], [10, 10], 2)])
def test_matching_examples(spark, refs, preds, n):
    got = folds.match_one_to_one(make(spark, refs), make(spark, preds), ["user_id"], "t", 50, "event_id")
    assert got.count() == n


def test_empty_set_conventions(spark):
    counts = spark.createDataFrame([(0, 0, 0), (0, 3, 0), (0, 0, 3), (2, 2, 2)], "tp long, fp long, fn long")
    got = [(r.precision, r.recall, r.f1) for r in metrics.with_scores(counts).orderBy("fp", "fn").collect()]
    assert got == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (0.0, 0.0, 0.0)]


def test_hysteresis(spark, sf):
    want = []
    for u, rows in by_user(spark, sf).items():
        armed, top, at = False, 0.0, 0
        for r in rows:
            if armed:
                if r.value > top:
                    top, at = r.value, r.t
                elif r.value < 0.3 * top:
                    want.append((u, at, top))
                    armed = False
            elif r.value > 100:
                armed, top, at = True, r.value, r.t
        if armed:
            want.append((u, at, top))
    assert sorted((r.user_id, r.t, r.value) for r in q.hysteresis_peaks(spark, sf).collect()) == sorted(want)


def test_suppression(spark, sf):
    want, merged = set(), set()
    for u, rows in by_user(spark, sf).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.value, r.event_id)):
            if all(abs(r.t - k.t) >= 6 * HOUR for k in kept):
                kept.append(r)
        want |= {(u, k.event_id) for k in kept}
        kept = []
        for r in rows:
            close = next((i for i, k in enumerate(kept) if abs(k.t - r.t) < 6 * HOUR), None)
            if close is None:
                kept.append(r)
            elif r.value > kept[close].value:
                kept[close] = r
        merged |= {(u, k.event_id) for k in kept}
    assert {(r.user_id, r.event_id) for r in q.nms_time(spark, sf).collect()} == want
    assert {(r.user_id, r.event_id) for r in q.merge_close(spark, sf).collect()} == merged


def test_confirmation_keeps_order(spark, sf):
    snap = 6 * HOUR
    events_, candidates = by_user(spark, sf, "purchase"), by_user(spark, sf, "click")
    want = {}
    for u, es in events_.items():
        at, cs = 0, candidates.get(u, [])
        for e in es:
            near = [(abs(c.t - e.t), i) for i, c in enumerate(cs) if i >= at and abs(c.t - e.t) <= snap]
            want[e.event_id] = cs[min(near)[1]].event_id if near else None
            at = min(near)[1] + 1 if near else at
    assert {r.event_id: r.candidate for r in q.confirm_in_order(spark, sf).collect()} == want


def test_boxes(spark):
    random.seed(3)
    rows = [(1, i, random.choice("ab"), random.random(), random.randrange(30), random.randrange(30), 10, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "frame int, id int, kind string, score double, x int, y int, w int, h int")

    def iou(a, b):
        w = max(0, min(a[4], b[4]) + 10 - max(a[4], b[4]))
        h = max(0, min(a[5], b[5]) + 10 - max(a[5], b[5]))
        return w * h / (200 - w * h)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(k[2] != r[2] or iou(k, r) <= 0.45 for k in kept):
            kept.append(r)
    got = folds.suppress_boxes(df, ["frame"], "id", "score", "kind", 0.45)
    assert {r.id for r in got.collect()} == {k[1] for k in kept}


def test_folds_of_nothing(spark):
    none = make(spark, []).withColumn("value", F.lit(1.0))
    assert folds.match_one_to_one(none, none, ["user_id"], "t", 5, "event_id").count() == 0
    assert folds.suppress(none, ["user_id"], "t", "value", 5, "event_id").count() == 0
    assert folds.hysteresis_peaks(none, ["user_id"], ["t"], "t", "value", 1.0, 0.5).count() == 0
