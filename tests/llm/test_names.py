"""Columns of the caller that are named like an operator's own come back as they were."""

import pytest
from eventide.llm import langid, license_rules, line_dedup, mixing, sentencepiece_codec
from pyspark.sql import functions as F

INNER = ["_row_k1", "_row_k2", "_removed", "__row_k1", "k1", "k2", "t1", "h", "salt", "_found", "_codec", "_lines", "_prose", "_doc_key", "_row_key", "_copies", "_copy", "order", "row_key", "sid", "size", "start", "pass"]


@pytest.mark.parametrize(
    "operator",
    [
        line_dedup.mark_lines, line_dedup.drop_spread_lines, lambda d: langid.predict(d, d), sentencepiece_codec.tokenize, license_rules.scan, mixing.mixed_documents,
        lambda d: mixing.mixed_documents(d, share=2.0),
    ],
)
def test_inner_names(spark, operator):
    texts = [None, "", "one line\nand another here.", "the same\nlast", "the same\nlast", "Licensed under the MIT license."]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    plain = operator(docs)
    made = operator(docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in INNER}))
    assert made.columns[:4] == docs.columns and set(made.columns) == set(plain.columns) | set(INNER)
    got = made.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in INNER)
    assert sorted((tuple(r[c] for c in plain.columns) for r in got), key=str) == sorted(map(tuple, plain.collect()), key=str)
