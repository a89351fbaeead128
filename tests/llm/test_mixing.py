"""op2: targets, exact words taken, the splitting tree, and edge cases."""

from pyspark.sql import functions as F

from eventide.llm import mixing, queries


def water_fill(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: total * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
        free -= full
    return out


def test_targets_and_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    import re

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = water_fill(sizes)
    got = queries.op2_source_mixing(spark, sf).collect()
    assert len(got) == len(docs)
    taken = {}
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]])
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-9
    again = queries.op2_source_mixing(spark, sf).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_is_disjoint_and_partition_independent(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 16)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert len({r.shard for r in rows}) > 8
    seen = set()
    for r in rows:  # no word of a document twice in one pass
        words = {(r["pass"], r.id, w) for w in range(r.first_word, r.first_word + r.n_words)}
        assert not words & seen
        seen |= words
    other = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, other))
    per_shard = mixed.groupBy("shard").agg(F.countDistinct("position").alias("p"), F.count("*").alias("n"), F.sum("n_words").alias("w"))
    assert all(r.p == r.n for r in per_shard.collect())


def test_quotas_sum_up(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 10), (2, 0), (3, 333)], "sid int, quota long")
    found = mixing.split_quotas(quotas, 32).collect()
    by = {}
    for r in found:
        by[r.sid] = by.get(r.sid, 0) + r.quota
    assert by == {0: 1000, 1: 10, 2: 0, 3: 333}
    shards = {}
    for r in found:
        shards[r.shard] = shards.get(r.shard, 0) + r.quota
    assert len(shards) == 32 and max(shards.values()) - min(shards.values()) <= 1


def test_edge_rows(spark):
    rows = [(1, "a b c", "s", 0), (1, "a b c", "s", 0), (2, None, "s", 1), (3, "", None, 2), (4, "x y", None, 3), (None, "p q r s", "t", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, sid int").withColumn("taken", F.lit(1)).withColumn("start", F.lit(1))
    got = mixing.taken_words(docs).collect()
    assert len(got) == 6
    assert sum(r.taken for r in got) == sum(int(t + 0.5) for t in water_fill({"s": 6, "t": 4, None: 2}).values())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixing.taken_words(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_whole_documents_meet_the_target_where_documents_are_long(spark, monkeypatch):
    """A document of many blocks gets about the pass's share of them: it stays with that probability, not never or always."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    rows = [(i, f"d{i} " + "w " * 639, "a" if i < 60 else "b") for i in range(460)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"weights": (1, 1), "share": 0.35}
    targets = {r.source_size: r.target for r in mixing.taken_words(docs, **options).collect()}
    got = {r.source: r["count"] * 640 for r in mixing.mixed_documents(docs, **options).groupBy("source").count().collect()}
    for source, n in (("a", 60), ("b", 400)):
        assert abs(got.get(source, 0) - targets[n * 640]) < 0.2 * targets[n * 640]


def test_many_copies_are_cut_into_ranges_first(spark, sf, monkeypatch):
    quotas = spark.createDataFrame([(0, 1000), (1, 3), (2, 77)], "sid int, quota long")
    monkeypatch.setattr(mixing, "MAX_COPIES", 100)
    got = mixing.split_quotas(quotas, 32).collect()
    sums, by = {}, {}
    for r in got:
        sums[r.sid], by[r.shard] = sums.get(r.sid, 0) + r.quota, by.get(r.shard, 0) + r.quota
    assert sums == {0: 1000, 1: 3, 2: 77} and len(by) == 32 and max(by.values()) - min(by.values()) <= 4
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 16)
    monkeypatch.setattr(mixing, "SHARD_RANGE", 4)
    test_targets_and_words(spark, sf)
