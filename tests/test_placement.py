"""Rhythm grids, tracks, anchors, prototypes and streamed folds against plain restatements."""

import math
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from eventide.operators import anchors, cuts, folds, metrics, rhythm, streams
from eventide.streaming import sessions


def placed(span, heard, periods, window, tol, share=0.15, average=0.8, least=0.6):
    """One span (start, end, n) by trying every grid."""
    start, end, n = span
    lo, hi = start - window[1], end - window[0]
    inside: dict = {}
    for t, s in heard:
        if lo - tol <= t <= hi + tol:
            inside[t] = max(inside.get(t, s), s)
    best = None
    for p in sorted(periods, reverse=True) if n >= 2 else ():
        if end - start < p:
            continue
        count, near = math.floor((end - start) / p + 0.5) + 1, min(tol, math.floor(p * share))
        for at in sorted(inside):
            for first in range(count):
                nodes = [at + (k - first) * p for k in range(count)]
                if nodes[0] < lo - tol or nodes[-1] > hi + tol:
                    continue
                top = [max([s for t, s in inside.items() if abs(t - x) <= near and s > 0], default=0) for x in nodes]
                fit = round(2 * sum(top) - count * average, 6)
                if best is None or fit > best[0]:
                    best = (fit, p, nodes, sum(s > 0 for s in top))
    if best is None or best[3] < least * len(best[2]):
        return []
    out = []
    for k, x in enumerate(best[2]):
        close = min([(abs(t - x), t) for t in inside if abs(t - x) < tol], default=None)
        out.append((best[1], len(best[2]), best[3], best[0], k, close[1] if close else x, close is None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rhythm_grid(spark, seed):
    draw = random.Random(seed)
    spans, heard = [], []
    for user in range(12):
        period, at = draw.choice([70, 100, 150]), draw.randrange(1000)
        n = draw.randrange(1, 9)
        spans.append((user, 1, at, at + (n - 1) * period + draw.randrange(-5, 6) * (n > 1), n))
        heard += [(user, at + k * period + draw.randrange(-9, 10), draw.choice([0.0, 0.4, 0.9, 1.0])) for k in range(n) if draw.random() < 0.8]
        heard += [(user, at + draw.randrange(0, 900), draw.random()) for _ in range(draw.randrange(6))]
    heard += heard[:5]
    df = spark.createDataFrame(spans, "user long, run long, start long, end long, n long")
    got: dict = {}
    found = rhythm.place_grid(df, spark.createDataFrame(heard, "user long, t long, s double"), ["user"], "run", "t", "s", [70, 100, 150], (-20, 30), 25)
    for r in found.orderBy("user", "k").collect():
        got.setdefault(r.user, []).append((r.period, r["count"], r.support, r.fit, r.k, r.t, r.filled))
    want = {u: placed((a, b, n), [(t, s) for v, t, s in heard if v == u], [70, 100, 150], (-20, 30), 25) for u, _, a, b, n in spans}
    assert got == {u: rows for u, rows in want.items() if rows}


def tracked(rows, gap):
    """(frame, ident, track, nth) of one key, frame by frame."""
    open_, out = [], []
    for frame in sorted({r[0] for r in rows}):
        taken = set()
        open_ = [s for s in open_ if frame - s["last"] <= gap]
        for _, ident, x, y, h in sorted(r for r in rows if r[0] == frame):
            fit = [(abs(x - s["x"]) + abs(y - s["y"]), i) for i, s in enumerate(open_) if i not in taken and abs(y - s["y"]) <= max(0.6 * s["h"], 6) and abs(x - s["x"]) <= max(1.5 * s["h"], 12) and abs(h - s["h"]) <= 0.35 * s["h"]]
            if fit:
                i = min(fit)[1]
                s = open_[i]
                for c, v in zip("xyh", (x, y, h)):
                    s[c] = (s[c] * s["n"] + v) / (s["n"] + 1)
                s["n"], s["last"] = s["n"] + 1, frame
            else:
                i = len(open_)
                open_.append({"id": ident, "x": x, "y": y, "h": h, "n": 1, "last": frame})
            taken.add(i)
            out.append((frame, ident, open_[i]["id"], open_[i]["n"]))
    return out


def items():
    draw = random.Random(4)
    rows, ident = [], 0
    for key in range(4):
        for frame in [*range(0, 30), *range(60, 70), *range(72, 100)]:
            for slot in range(3):
                if draw.random() < 0.7:
                    ident += 1
                    rows.append((key, frame, ident, slot * 30 + draw.random() * 20, draw.random() * 8 + 20 * (slot // 2), 12 + draw.random() * 4))
    return rows


def test_tracks_in_batch_and_stream(spark, tmp_path):
    """The same machine in both: equal tracks, though the stream gets its frames in many batches."""
    rows = items()
    schema = "key long, frame long, ident long, x double, y double, h double"
    batch = folds.track_slots(spark.createDataFrame(rows, schema).repartition(3), ["key"], "frame", "ident", 5)
    got = sorted(map(tuple, batch.collect()))
    assert got == sorted((k, *x) for k in range(4) for x in tracked([r[1:] for r in rows if r[0] == k], 5))
    for i in range(10):
        part = [r for r in rows if r[1] * 10 // 100 == i]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
        (tmp_path / "flat").mkdir(exist_ok=True)
        name = next((tmp_path / "in" / f"{i:02d}").glob("*.parquet"))
        name.rename(tmp_path / "flat" / f"{i:02d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
    table = sessions.run_to_table(sessions.stream_tracks(stream, "key", "frame", "ident", 5), "tracks_out", "append", f"{tmp_path}/state")
    assert sorted(map(tuple, table.collect())) == got


def test_chains_cut_where_nothing_reaches(spark):
    draw = random.Random(2)
    rows = [(draw.choice([1, None]), draw.choice([0, 500, 5000]) + draw.randrange(300)) for _ in range(200)]
    got: dict = {}
    for r in streams.chained(spark.createDataFrame(rows, "k long, t long"), ["k"], "t", 40).collect():
        got.setdefault(r.k, []).append((r.t, r._chain))
    assert sum(map(len, got.values())) == len(rows)
    for pairs in got.values():
        pairs.sort()
        assert all(c == d for (t, c), (u, d) in pairwise(pairs) if u - t <= 40) and len({c for _, c in pairs}) >= 3


def greedy(rows, gap):
    kept = []
    for t, i, s in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(abs(t - k[0]) >= gap for k in kept):
            kept.append((t, i, s))
    return sorted(kept)


def test_a_dense_user_streams(spark):
    """A third of all rows in one key without a gap, scores rising, falling and mixed: the folds give what greedy loops give, and hold few rows."""
    draw = random.Random(3)
    rows = []
    for user in range(8):
        n = 4000 if user == 0 else 900
        for i in range(n):
            rows.append((user, user * 10_000 + i, i * 3 + draw.randrange(3), float(i if i < n // 4 else n - i if i < n // 2 else draw.randrange(1000))))
    df = spark.createDataFrame(rows, "u long, i long, t long, s double").repartition(4)
    got: dict = {}
    for r in folds.suppress(df, ["u"], "t", "s", 50, "i").collect():
        got.setdefault(r.u, []).append((r.t, r.i, r.s))
    assert {u: sorted(v) for u, v in got.items()} == {u: greedy([(t, i, s) for v, i, t, s in rows if v == u], 50) for u in range(8)}
    machine, most = streams.Suppressing(50), 0
    for _, i, t, _ in rows[:4000]:
        list(machine.feed(t, float(draw.random()), i))
        most = max(most, len(machine.open))
    assert most <= 1024


def test_machines_hold_little():
    draw = random.Random(6)
    match, confirm = streams.Matching(30), streams.Confirming(30)
    t = 0
    for i in range(50_000):
        t += draw.randrange(4)
        side = draw.random() < 0.5
        list(match.feed(t, int(side), i)), list(confirm.feed(t, int(side), i))
        assert len(match.refs) + len(match.preds) < 100 and len(confirm.times) < 3000 and len(confirm.events) < 100


def test_confirm_with_ties_and_moves(spark):
    draw = random.Random(7)
    events = [(1, i, draw.randrange(400)) for i in range(60)]
    candidates = [(1, 100 + i, draw.randrange(400)) for i in range(50)]
    cs, at, want = sorted((t, i) for _, i, t in candidates), 0, {}
    for t, i in sorted((t, i) for _, i, t in events):
        near = min([(abs(c[0] - t), k) for k, c in enumerate(cs) if k >= at and abs(c[0] - t) <= 9], default=None)
        want[i] = (cs[near[1]][0], cs[near[1]][1]) if near else (t, None)
        at = near[1] + 1 if near else at
    make = lambda rows: spark.createDataFrame(rows, "u long, i long, t long")
    got = folds.confirm_in_order(make(events), make(candidates), ["u"], "t", 9, "i", move=True).collect()
    assert {r.i: (r.t, r.candidate) for r in got} == want


def peeled(spots, radius, spread, least, most, ratio):
    rest, found = [s for s in spots if s[3] > 0], []
    while rest and len(found) < most:
        best = None
        for i, x, y, a in sorted(rest):
            members = [s for s in rest if math.sqrt((s[1] - x) ** 2 + (s[2] - y) ** 2) <= radius and s[3] <= a * spread and s[3] * spread >= a]
            if len(members) >= least and (best is None or sum(m[3] for m in members) > best[0]):
                best = (sum(m[3] for m in members), members)
        if best is None:
            break
        anchor = tuple(sorted(m[c] for m in best[1])[len(best[1]) // 2] for c in (1, 2, 3))
        if found and anchor[2] < ratio * found[0][2]:
            break
        found.append((*anchor, len(best[1])))
        rest = [s for s in rest if s not in best[1]]
    return found


def test_anchors(spark):
    """Repeated spots, one key with most of them, one with none that gather, one without extent."""
    draw = random.Random(8)
    spots = [(draw.choice([1, 1, 1, 2, None]), i, float(draw.randrange(60)), float(draw.randrange(40)), draw.choice([1, 2, 4]), draw.choice([1, 3])) for i in range(150)]
    spots += [(1, 200 + i, 5.0, 5.0, 2, 3) for i in range(40)] + [(3, 300, 1.0, 1.0, 2, 2), (4, 301, 1.0, 1.0, 0, 2)]
    df = spark.createDataFrame(spots, "k long, i long, cx double, cy double, w long, h long")
    got: dict = {}
    for r in anchors.find_anchors(df, ["k"], "i", 8.0, 3.0, 4, 3, 0.5).orderBy("place").collect():
        got.setdefault(r.k, []).append((r.cx, r.cy, r.area, r.members))
    want = {k: peeled([(i, x, y, float(w * h)) for v, i, x, y, w, h in spots if v == k], 8, 3, 4, 3, 0.5) for k in (1, 2, 3, 4, None)}
    assert got == {k: v for k, v in want.items() if v}
    assert anchors.find_anchors(df.limit(0), ["k"], "i", 8.0, 3.0, 4, 3, 0.5).collect() == []


@pytest.mark.parametrize("bounds", [(8, 5), None])
def test_anchors_meet_few_copies_in_few_jobs(spark, monkeypatch, bounds):
    """Keys with and without a grid, spots on its edges, members by array and by ranks, a key that ends early, infinite and missing coordinates."""
    draw = random.Random(12)
    spots = [(draw.choice([1, 1, 1, 2, None]), i, draw.randrange(-90, 90) / 3, draw.randrange(-30, 30) / 3, draw.choice([1, 2, 4]), draw.choice([1, 3])) for i in range(160)]
    spots += [(5, 400 + i, 16.0 * (i % 2), 8.0 * (i % 3), 3, 3) for i in range(9)] + [(6, 500 + i, 1.0 + 50 * (i // 4), 1.0, 1 if i // 4 else 4, 1) for i in range(8)]
    odd = [(k, 600 + i, x, y, 3, 3) for i, (k, x, y) in enumerate([(1, None, 1.0), (1, math.nan, 1.0), (5, math.inf, 0.0), (7, None, None)])]
    df = spark.createDataFrame(spots + odd, "k long, i long, cx double, cy double, w long, h long")
    if bounds:
        monkeypatch.setattr(anchors, "WHOLE", bounds[0]), monkeypatch.setattr(anchors, "HELD", bounds[1])
    group = f"anchors-{bounds}"
    spark.sparkContext.setJobGroup(group, "")
    got: dict = {}
    for r in anchors.find_anchors(df, ["k"], "i", 8.0, 3.0, 3, 3, 0.5).orderBy("place").collect():
        got.setdefault(r.k, []).append((r.cx, r.cy, r.area, r.members))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {k: peeled([(i, x, y, float(w * h)) for v, i, x, y, w, h in spots if v == k], 8, 3, 3, 3, 0.5) for k in (1, 2, 5, 6, None)}
    assert got == want and len(want[6]) == 1
    if not bounds:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 75  # medians by ranges took some fifty more


def test_prototypes(spark):
    draw = random.Random(9)
    centres = [draw.getrandbits(40) for _ in range(5)]
    rows = [(draw.randrange(2), i, None if i % 50 == 0 else draw.choice(centres) ^ sum(1 << draw.randrange(40) for _ in range(draw.randrange(4)))) for i in range(300)]
    want = []
    for label in (0, 1):
        made: list = []
        for _, i, x in (r for r in rows if r[0] == label and r[2] is not None):
            bits = [x >> j & 1 for j in range(40)]
            near = min([(sum(a != b for a, b in zip(m["bits"], bits)), k) for k, m in enumerate(made)], default=None)
            if near and near[0] <= 0.1 * 40:
                m = made[near[1]]
                m["rows"].append(bits)
                m["bits"] = [int(2 * sum(c) >= len(m["rows"])) for c in zip(*m["rows"])]
            elif len(made) < 7:
                made.append({"id": i, "bits": bits, "rows": [bits]})
        want += [(label, m["id"], len(m["rows"]), "".join(map(str, m["bits"]))) for m in made]
    got = folds.cluster_bits(spark.createDataFrame(rows, "label long, i long, bits long").repartition(3), ["label"], "i", "bits", 40, 0.1, 7)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_order_statistics_and_running_sums(spark):
    """Hot keys, ties, nulls in keys and values, weights."""
    draw = random.Random(10)
    rows = [(draw.choice([1, 1, 1, 1, 2, None]), draw.choice([None, *range(12)]), draw.randrange(1, 4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, w long").repartition(4)
    for weight in (None, "w"):
        want = {}
        for k in (1, 2, None):
            values = sorted(v for kk, v, w in rows if kk == k and v is not None for _ in range(w if weight else 1))
            want[k] = (len(values), values[(len(values) - 1) // 2], values[len(values) // 2], values[-1])
        got = metrics.order_statistics(df, ["k"], "v", weight, lower=metrics.LOWER, upper=metrics.UPPER, top=lambda n: n - 1)
        assert {r.k: (r.n, r.lower, r.upper, r.top) for r in got.collect()} == want
    placed = df.withColumn("i", F.monotonically_increasing_id())
    got = {}
    for r in cuts.running(placed, ["k"], ["v", "i"], total=F.col("w")).collect():
        got.setdefault(r.k, []).append(((r.v is not None, r.v or 0, r.i), r.w, r.total))
    for pairs in got.values():
        at = 0
        for _, w, total in sorted(pairs):
            at += w
            assert total == at
