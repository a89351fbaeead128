"""The pipeline's SimHash stage gets candidates from op1's fingerprints: links hold without any MinHash band."""

import random

import corpus_pipeline
from eventide.llm import minhash


def test_links_come_from_fingerprints(spark, sf, monkeypatch):
    draw = random.Random(11)
    texts = {}
    for i in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(400)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join([*words, "end"])
    docs = spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, lang string, n_chars long")
    prints = {i: minhash.simhash.__globals__["simhash64"](t.encode()) for i, t in texts.items()}
    near = {2 * i + 1 for i in range(40) if ((prints[2 * i] ^ prints[2 * i + 1]) & (2**64 - 1)).bit_count() <= 2}
    assert len(near) > 20
    bands = minhash.sketch

    def without(text, shingle):  # texts keep their sets, but no band
        s = bands(text, shingle)
        return minhash.F.struct(s["node"].alias("node"), s["weight"].alias("weight"), minhash.F.array().cast("array<long>").alias("bands"))

    monkeypatch.setattr(minhash, "sketch", without)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert {2 * i for i in range(40)} <= kept and not near & kept
