"""Sources, scalar and signal functions, and streams."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import scalars as s
from eventide.functions import signal
from eventide.operators import events as ev
from eventide.operators import windows as w
from eventide.plans.common import HOUR, events
from eventide.sources import audio, labels
from eventide.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_label_files(spark, tmp_path):
    good = {"version": 1, "clip": "a.mp4", "slug": "a", "complete": True, "shots": [{"time": 2.0, "source": "own"}, {"time": 1.0, "source": "enemy", "hard": True}]}
    files = {"a": json.dumps(good), "b": json.dumps(good | {"slug": "b", "complete": False}), "c": "{not json", "d": json.dumps(good | {"version": 9}), "e": json.dumps(good | {"slug": "e", "shots": [{"time": 1.0, "source": "other"}]})}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = labels.read_labels(spark, str(tmp_path))
    kept, skipped = labels.corpus(read)
    assert [r.slug for r in kept.collect()] == ["a"]
    assert {r.file_name: r.reason for r in skipped.collect()} == {"c.json": "not a label document", "d.json": "unknown version", "e.json": "shot of unknown source"}
    rows = labels.shots(kept).orderBy("ord").collect()
    assert [(r.t, r.source, r.hard) for r in rows] == [(1.0, "enemy", True), (2.0, "own", False)]
    assert {r.slug for r in labels.corpus(read, complete=False)[0].collect()} == {"a", "b"}
    (tmp_path / "blind.txt").write_text('{"a": [[1.0, 2.5], [4, 5]], "b": []}')
    assert sorted(map(tuple, labels.read_intervals(spark, str(tmp_path / "blind.txt")).collect())) == [("a", 1.0, 2.5), ("a", 4.0, 5.0)]


def test_baseline_comparison(spark):
    now = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.1)], "slug string, f1 double")
    before = spark.createDataFrame([("a", 0.6), ("b", 0.9)], "slug string, f1 double")
    assert {r.slug: r.worse for r in labels.compare_with_baseline(now, before).collect()} == {"a": True, "b": False, "c": False}


def test_wav_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    clips = [([rng.uniform(-1, 1, 50).tolist(), rng.uniform(-1, 1, 50).tolist()], 44100), ([[0.0, 2.0, -2.0]], 8000)]
    df = spark.createDataFrame(clips, "channels array<array<double>>, rate int")
    for i, r in enumerate(df.select(audio.encoded(F.col("channels"), F.col("rate")).alias("b")).collect()):
        (tmp_path / f"c{i}.wav").write_bytes(r.b)
    body = struct.pack("<4f", 0.5, -0.5, 0.25, 1.0)
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 16000, 64000, 4, 32) + b"data" + struct.pack("<I", len(body))
    (tmp_path / "f.wav").write_bytes(head + body)
    (tmp_path / "bad.wav").write_bytes(b"nothing here at all")
    got = {(r.slug, r.channel): r for r in audio.read_wavs(spark, str(tmp_path)).collect()}
    assert set(got) == {("c0", 0), ("c0", 1), ("c1", 0), ("f", 0)}
    assert np.abs(np.array(got["c0", 1].samples) - clips[0][0][1]).max() < 1e-4
    assert got["c1", 0].samples == pytest.approx([0.0, 32767 / 32768, -1.0])
    assert got["f", 0].samples == [0.5, -0.5, 0.25, 1.0] and got["f", 0].sample_rate == 16000


def test_scalars(spark):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    for text in ("", "ak47.mp4", "Ünï ñ.x"):
        assert one(spark, s.fnv1a32(F.lit(text))) == fnv(text)
    assert one(spark, s.fnv1a32(F.lit("ak47.mp4"))) == "dbf13655"
    assert one(spark, s.slugify(F.lit("Été à  Paris!.mp4"))) == "ete-a-paris-" + fnv("Été à  Paris!.mp4")
    assert one(spark, s.js_round(F.lit(-2.5))) == -2 and one(spark, s.js_round(F.lit(2.5))) == 3
    assert one(spark, s.resample_linear(F.array(F.lit(0.0), F.lit(10.0)), F.lit(5))) == [0.0, 2.5, 5.0, 7.5, 10.0]
    assert one(spark, s.media_kind(F.lit(b"RIFF\x00\x00\x00\x00WAVEfmt "))) == "wav" and one(spark, s.media_kind(F.lit(b"RI"))) == "unknown"
    assert one(spark, s.mel_to_hz(s.hz_to_mel(F.lit(440.0)))) == pytest.approx(440.0)
    assert tuple(one(spark, s.trim_bounds(F.array(*[F.lit(x) for x in (0.0, 0.1, 1.0, 0.5, 0.0)]), 0.2))) == (2, 3)
    assert one(spark, s.hann(5)) == pytest.approx([0, 0.5, 1, 0.5, 0])
    assert one(spark, s.parabola_peak(F.lit(1.0), F.lit(2.0), F.lit(1.0))) == 0.0
    assert tuple(one(spark, s.letterbox(F.lit(200), F.lit(100), 100))) == (0.5, 0.0, 25.0)


def test_onset_curve_and_peaks(spark):
    shots = spark.createDataFrame([("a", 0.3), ("a", 0.6), ("b", 0.5)], "slug string, t double")
    clips = audio.synthetic(spark, shots, 8000, 1.0)
    assert {r.slug: len(r.samples) for r in clips.collect()} == {"a": 8000, "b": 8000}
    curve = signal.onset_strength(clips, 8000, 256, 64)
    peaks = signal.refractory_peaks(curve, "slug", "t", "strength", 0.4, 0.1)
    found = {}
    for r in peaks.collect():
        found.setdefault(r.slug, []).append(r.t)
    assert sorted(found["a"]) == pytest.approx([0.3, 0.6], abs=0.03) and found["b"] == pytest.approx([0.5], abs=0.03)


def test_spectra_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=64)
    row = spark.createDataFrame([(x.tolist(),)], "frame array<double>").select(signal.magnitudes(F.col("frame"), 64).alias("m")).first()
    n = np.arange(64)
    windowed = x * 0.5 * (1 - np.cos(2 * np.pi * n / 63))
    direct = [abs(sum(windowed * np.exp(-2j * np.pi * k * n / 64))) for k in range(32)]
    assert row.m == pytest.approx(direct)


def test_convolution_over_time(spark):
    rng = np.random.default_rng(3)
    x, k, b = rng.normal(size=(9, 2)), rng.normal(size=(3, 2, 3)), rng.normal(size=3)
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "slug string, i int, mel array<double>")
    got = [r.mel for r in signal.convolve(df, 0, k.tolist(), b.tolist()).orderBy("i").collect()]
    padded = np.vstack([np.zeros(2), x, np.zeros(2)])
    want = [[max(0.0, b[o] + sum(padded[i + t] @ k[o, :, t] for t in range(3))) for o in range(3)] for i in range(9)]
    assert np.allclose(got, want)


def test_warm_up_of_the_local_threshold(spark):
    values = [float(v) for v in (5, 1, 4, 2, 8, 3, 9, 7)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    got = [r.x for r in df.select("i", w.local_threshold("v", ["k"], ["i"], 4, 1.0, 0.05, warm_up=True).alias("x")).orderBy("i").collect()]
    for i in range(8):
        h = sorted(values[:4] if i < 4 else values[i - 4 : i])
        assert got[i] == pytest.approx(max(0.05, h[2] + (h[3] - h[1]) / 1.349))


def test_event_metric_example(spark):
    second = 1_000_000
    ref = [1.0, 5.0, 5.3, 5.6, 9.0, 9.1, 9.2, 9.3, 9.4]
    mark = [1.02, 5.01, 5.31, 5.61, 9.0, 9.2, 9.4, 20.0]
    rows = lambda ts: spark.createDataFrame([("c", i, int(t * second)) for i, t in enumerate(ts)], "slug string, id long, t long")
    blind = spark.createDataFrame([], "slug string, start long, end long")
    judged, extras = ev.judge_runs(rows(ref), rows(mark), blind, "slug", "t", "id", ev.MEDIA)
    assert sorted((r.kind, r.ok) for r in judged.collect()) == [("countable", True), ("fast", True), ("single", True)]
    assert [tuple(r) for r in extras.collect()] == [("c", 1)]


def test_streamed_sessions_equal_the_batch(spark, sf, tmp_path):
    stream = sessions.stream_sessions(sessions.read_events(spark, sf), "user_id", "4 hours", "1 hour")
    got = sessions.run_to_table(stream, "streamed_sessions", "complete", str(tmp_path / "c1"))
    want = w.session_runs(events(spark, sf), ["user_id"], "t", 4 * HOUR, ["event_id"])
    assert sorted((r.user_id, r.n, r.start_us, r.end_us) for r in got.collect()) == sorted((r.user_id, r.n, r.start, r.end) for r in want.collect())


def test_streamed_counter_across_batches(spark, tmp_path):
    reads = [(k, t, 10 - (t * (k + 2)) % 7) for k in range(3) for t in range(12)]
    schema = "part long, t long, value double"
    for batch in range(3):
        rows = [(k, t, float(v)) for k, t, v in reads if t // 4 == batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    got = sessions.run_to_table(sessions.stream_counter(stream, "part", "t", "t", "value"), "streamed_counter", "append", str(tmp_path / "c2"))
    batch = w.counter_drops(spark.createDataFrame([(k, t, float(v)) for k, t, v in reads], schema), ["part"], ["t"], "value")
    assert sorted((r.key, r.t, r.kind) for r in got.collect()) == sorted((r.part, r.t, r.kind) for r in batch.collect())


def test_math_is_sane():
    assert math.isclose(sum(signal.mel_filters(40, 1024, 44100, 60, 20000)[0]), signal.mel_filters(40, 1024, 44100, 60, 20000)[0].sum())
