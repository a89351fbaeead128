"""op4, op5, op6, op7, op9 and op10: contracts against plain Python, and edge cases."""

import hashlib
import html
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from eventide.llm import langid, license_rules, line_dedup, merkle, queries, sentencepiece_codec, style_tree

# --- op4 ---


def article_text(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body)
    return " ".join(html.unescape(re.sub(r"</?b>", "", body)).split())


def test_pages_give_their_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op4_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_text(pages[r.page_id].html)
        assert (r.n_chars, r.url) == (len(r.text), pages[r.page_id].url)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<script>var a='</p>'</script>", ""),
        ("<p>a  b\n c<p>d&amp;e &copy; &#65;&#x42;</p>", "a b c d&e © AB"),
        ("<article><h1>T</h1><p>x <b>y</b>z</p></article><p>out</p>", "T x yz"),
        ("<div class='sidebar-left'>s</div><main><p>m</p><aside>n</aside><form>f<input></form></main><footer>g</footer>", "m"),
        ("<body class=has-sidebar><div class='page with-sidebar'><article><p>in</p><section id=comments><p>c</p></section></article></div></body>", "in"),
        ("<article><p>one<br>two</p><div class=cookieNotice>no</div><!-- <p>hidden</p> --><ul><li>l1<li>l2</ul></article>", "one two l1 l2"),
        ("<article><p>unclosed <i>it", "unclosed it"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        ("<header>h</header><p>t</p><nav>n</nav>", "t"),
        ("<article class='post has-comments'><p>body</p><section class=comments><article class=comment><p>c</p></article></section></article>", "body"),
        ("<div class=sidebar><article><p>teaser</p></article></div><article><p>the longer story</p></article>", "the longer story"),
        ("<article><header><h1>T</h1></header><p>Let <math><mi>x</mi></math> be</p><fieldset><p>in a box</p></fieldset><section class=related-work><p>others</p></section></article>", "T Let x be in a box others"),
        ("<article><div class='search-method'><p>we sought</p></div><p id=copyright-law>rights</p><p class=comment>a remark</p><span class=notice>note</span></article>", "we sought rights a remark note"),
        ("<article><p>a</p><div class='ad-slot'>buy</div><div class=related>more</div><ul class='share-links'><li>s</ul><div class=comment>c</div><form>f</form><footer>by</footer></article>", "a"),
        ("<main><h1>T</h1></main><div class=content><p>the whole story is told out here, beside its heading</p></div>", "T the whole story is told out here, beside its heading"),
        ("<main><article><p>a</p></article><article class='related teaser'><p>r</p></article></main>", "a"),
    ],
)
def test_extract(page, want):
    assert style_tree.extract(page) == want


def test_site_style_tree_cuts_repeated_branches(spark):
    def page(i):
        words = " ".join(f"w{i}{j}" for j in range(30))
        return f"<html><body><div class=box0><p>All about us</p><p>Terms apply</p></div><div class=story><p>{words}</p><p>more {words}</p></div></body></html>"

    rows = [(i, "http://a.example/x", page(i)) for i in range(20)] + [(100, "http://b.example/", page(100)), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "host", "_low", "_hit_page", "_page_key", "text")})
    got = {r.page_id: r.text for r in style_tree.extract_pages(pages).collect()}
    assert all("All about us" not in got[i] and got[i].startswith(f"w{i}0 ") for i in range(20))
    assert got[100].startswith("All about us Terms apply w100")  # one page says nothing about its site
    assert got[101] == ""
    assert style_tree.extract_pages(pages.limit(0)).count() == 0


# --- op5 ---


def test_fingerprints(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op5_merkle_fingerprints(spark, sf).collect()}
    prints = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        r, third = got[i], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if len(text) > 600:
            assert r.near_edited > 0.4
    assert len(set(prints.values())) == len(prints)


def plain_tree(text):
    """Leaves ``(code, characters)`` by section and paragraph."""
    pattern = re.compile(r"[^.!?]{1,96}[.!?]{0,32}|[.!?]{1,32}", re.DOTALL)
    code = lambda leaf: (xxhash.xxh64_intdigest(leaf.encode(), 42) & ~255 & (2**64 - 1)) | min(len(leaf), 255)
    return [[[(code(m[0]), min(len(m[0]), 255)) for m in pattern.finditer(p)] for p in s.split("\n")] for s in (text or "").split("\n\n")]


def plain_print(tree):
    digits = lambda p: "".join(f"{c:016X}" for c, _ in p)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    root = sha(";".join(sha(",".join(sha(digits(p)) for p in s)) for s in tree))
    return f"{root}:" + ";".join(",".join(digits(p) for p in s) for s in tree).lower()


def plain_likeness(a, b):
    a, b = ([leaf for s in t for p in s for leaf in p] for t in (a, b))
    chars = lambda leaves: sum(n for _, n in leaves)
    if not chars(a) + chars(b):
        return 1.0

    def begins(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return chars(x[:n])

    in_place = 2 * min(begins(a, b) + begins(a[::-1], b[::-1]), chars(a), chars(b)) / (chars(a) + chars(b))
    return max(in_place, 2 * chars(set(a) & set(b)) / (chars(set(a)) + chars(set(b))))


def test_fingerprints_and_likeness_are_the_brute_ones(spark, sf):
    """Every document of the table, and texts of odd shapes, some very long."""
    draw = random.Random(11)
    odd = ["", "\n", "\n\n\n", "...!?", "é" * 400, "a.b!c?" * 50, "Long one. " * 20_000, "\n\nx", *["".join(draw.choice("ab .!?\n") for _ in range(draw.randrange(300))) for _ in range(40)]]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-1 - i, t) for i, t in enumerate(odd)] + [(-100, None)]
    got = {r.doc_id: r for r in merkle.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    docs = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        third = len(text) // 3
        own, edited, following = plain_tree(text), plain_tree(text[: len(text) - third] + after[:third]), plain_tree(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(own), plain_print(edited))
        assert r.near_edited == pytest.approx(plain_likeness(own, edited), abs=1e-12) and r.near_next == pytest.approx(plain_likeness(own, following), abs=1e-12)


def test_leaves_part_the_text(spark):
    random.seed(4)
    texts = ["", "a", "...", "x" * 500, "One. Two!? Three\n\nfour\n\n\nfive.", "é" * 97 + ". ü\n", "".join(random.choice("ab .!?\n") for _ in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", merkle.leaves(merkle.tree(F.col("text"))).alias("leaves"), merkle.root(merkle.tree(F.col("text"))).alias("root"))
    for r in rows.collect():
        assert sum(c & 255 for c in r.leaves) == len(r.text.replace("\n", ""))
    assert len({r.root for r in rows.collect()}) == len(texts)


def test_differing_branches_locate_edits(spark):
    a, b = "p1.\np2.\n\nq1.\nq2.", "p1.\np2.\n\nq1.\nchanged."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        merkle.differing_branches(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d"),
        merkle.likeness(merkle.leaves(merkle.tree(F.col("a"))), merkle.leaves(merkle.tree(F.col("b")))).alias("x"),
        merkle.likeness(merkle.leaves(merkle.tree(F.col("a"))), merkle.leaves(merkle.tree(F.col("a")))).alias("same"),
    ).first()
    assert [tuple(x) for x in row.d] == [(1, 1)]
    assert row.same == 1.0 and 0.5 < row.x < 1.0


def test_fingerprint_edge_rows(spark):
    rows = [(3, "abc. def."), (3, "abc. def."), (1, None), (None, "null id."), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("range", F.lit(0))
    got = merkle.edited_fingerprints(docs).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, 8, 9, 9]
    by = {r.doc_id: r for r in got}
    assert by[1].edited_sha256 == hashlib.sha256(b"").hexdigest() and by[2].fingerprint == by[1].fingerprint
    assert by[2].near_next == 1.0  # two empty texts
    assert by[None].edited_sha256 == hashlib.sha256(b"null iab").hexdigest()  # the last one's next is the first
    assert merkle.edited_fingerprints(docs.limit(0)).count() == 0
    lone = merkle.edited_fingerprints(docs.where("doc_id IS NULL")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"null inu").hexdigest()


# --- op6 ---


def brute_lines(rows, min_sites):
    prints = {}
    for _, text, source in rows:
        if source is not None:
            prints[text] = min(source, prints.get(text, source))
    spread = {}
    for text, source in prints.items():
        for line in (text or "").split("\n"):
            if line.strip(" \t\r"):
                spread.setdefault(line.strip(" \t\r"), set()).add(source)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        gone = [k for k, line in enumerate(lines) if len(spread.get(line.strip(" \t\r"), ())) >= min_sites]
        out.append((i, text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), tuple(gone)))
    return out


def test_line_dedup_is_the_brute_one(spark, monkeypatch):
    random.seed(2)
    common = [f"shared line {k}" for k in range(12)]
    rows = []
    for i in range(400):
        body = [f"own text of document {i} number {k} with words" for k in range(6)]
        body[2:2] = random.sample(common, 3)
        rows.append((i, "\n".join(body) + random.choice(["", "\n", " "]), f"s{min(i % 40, i % 7 * 3)}"))
    rows += [(900, None, "s1"), (901, "", "s2"), (902, "shared line 1", "s3"), (903, " shared line 2\t\r\nlonger own text that stays here", None), (0, rows[0][1], "s0")]
    rows += [(2000 + k, "first line of a copied text\nsecond line of it", f"s{k}") for k in range(30)]  # copies are one print
    rows += [(3000, "very long line " * 30_000 + "\nshared line 3", "s5"), (3001, "shared line 4\n\nshared line 4", "s6"), (None, "shared line 5\nx", "s7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("k1", F.lit(3)).withColumn("site", F.lit("x")).withColumn("removed_lines", F.lit(0))
    for least in (3, 10, 15):
        got = line_dedup.mark_lines(docs, min_sites=least)
        text = line_dedup.without_lines(F.col("text"), F.col("removed_lines"))
        found = sorted(((r.doc_id, r.x, tuple(r.removed_lines)) for r in got.select("doc_id", text.alias("x"), "removed_lines").collect()), key=str)
        assert found == sorted(brute_lines(rows, least), key=str)
        assert [x for i, x, _ in found if i == 2001] == [rows[406][1]]
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)  # the shuffled way gives the same
    out = line_dedup.drop_spread_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert line_dedup.drop_spread_lines(docs.limit(0)).count() == 0


# --- op7 ---


def test_codec_parity_and_round_trip(spark):
    texts = ["", " ", "a", "  two  spaces ", "Ünïcödé ☃ 漢字 \U0001f600", "line\nbreak\ttab", "<s> </s> <unk> <0x41>", "x" * 3000, "word " * 4000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in sentencepiece_codec.tokenize(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i].parity and got[i].decoded, text
        assert got[i].n_tokens == len(got[i].ids)
    assert (got[99].ids, got[99].n_tokens, got[99].decoded) == (None, 0, None)
    assert sentencepiece_codec.tokenize(docs.limit(0)).count() == 0


def test_unigram_models_are_rebuilt_too():
    def field(number, kind, value):
        key = bytes([number << 3 | kind])
        return key + value if kind != 2 else key + bytes([len(value)]) + value

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("▁", -3.0, 1), ("a", -2.5, 1)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    model += field(2, 2, field(3, 0, bytes([1])))
    parsed = sentencepiece_codec.parse(model)
    assert parsed.kind == sentencepiece_codec.UNIGRAM and parsed.pieces == pieces
    tokenizer = sentencepiece_codec.build(parsed)
    assert [pieces[i][0] for i in tokenizer.encode("ab ab").ids] == ["▁a", "b", "▁a", "b"]


def test_tokens_of_the_query(spark, sf):
    got = queries.op7_sentencepiece(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.parity and r.decoded for r in got)


# --- op9 ---

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_license_rules(spark):
    rows = [
        (1, MIT, ["MIT"]), (2, None, []), (3, "", []), (4, "no licence here. none at all", []),
        (5, "text\nLicensed under the Apache License, Version 2.0.\nmore\nAll rights reserved.", ["Apache-2.0", "proprietary"]),
        (6, "x. Released under the MIT license! y\n\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0", "MIT"]),
        (7, "# SPDX-License-Identifier: GPL-3.0-or-later\ncode", ["GPL-3.0-or-later"]),
        (8, "Released under the MIT License but not really", []),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    got = {r.doc_id: r for r in license_rules.scan(docs).collect()}
    for i, _, want in rows:
        assert got[i].licenses == want, i
    assert got[1].license_sentences == ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]
    assert license_rules.scan(docs.limit(0)).count() == 0


BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""


def brute_licenses(numbers):
    """Licences of identifier numbers, by rules over lists."""
    names, rest, found = license_rules.IDENTIFIERS, list(numbers), set()
    for licence, parts in license_rules.RULES:
        want = [names.index(p) + 1 for p in parts]
        for at in range(len(rest)):
            if rest[at : at + len(want)] == want:
                rest[at : at + len(want)] = [0] * len(want)
                found.add(licence)
    return sorted(found | {license_rules.ALONE[names[n - 1]] for n in rest if n and names[n - 1] in license_rules.ALONE})


def test_licence_edge_rows(spark):
    """Notices that follow each other, junk before a sentence, very long texts, repeats, and SQL on the same rows."""
    import duckdb

    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows = [
        (1, BSD3 + BSD3, ["BSD-3-Clause"]), (2, "*" * 4000 + " All rights reserved.", ["proprietary"]), (3, "SPDX-License-Identifier: EPL-2.0", ["EPL-2.0"]),
        (4, BSD3 + MIT + BSD3, ["BSD-3-Clause", "MIT"]), (5, "Licensed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        (6, "filler words here. " * 30_000 + MIT, ["MIT"]), (7, "Distributed under the Zlib license!", ["Zlib"]), (8, None, []), (9, "", []), (10, gpl2.replace(";", ","), ["GPL-2.0-or-later"]),
    ]
    rows += [(11, *rows[0][1:]), (11, *rows[0][1:])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("licenses", "license_sentences", "_lines", "_prose")})
    got = license_rules.scan(docs).collect()
    assert sorted((r.doc_id, r.licenses) for r in got) == sorted((i, want) for i, _, want in rows)
    assert all(r.licenses == brute_licenses([license_rules.IDENTIFIERS.index(n) + 1 for n in r.license_sentences]) for r in got)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows[:10]])
    found = {r[0]: r[1] for r in duck.execute(f"SELECT doc_id, licenses FROM ({license_rules.oracle_sql()})").fetchall()}
    assert found == {i: ",".join(want) for i, _, want in rows[:10]}


def test_random_sequences_of_licence_sentences(spark):
    draw = random.Random(11)
    rows = [(i, [license_rules.IDENTIFIERS.index(p) + 1 for _ in range(draw.randrange(4)) for p in draw.choice(license_rules.RULES)[1][: draw.choice([1, 2, 9, 9])]]) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, n array<long>").select("i", F.array_sort(license_rules.match_rules(license_rules._sequence(F.col("n")))).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: brute_licenses(n) for i, n in rows}


def test_rules_name_known_sentences():
    assert all(p in license_rules.SENTENCES for _, parts in license_rules.RULES for p in parts)
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) for s in license_rules.SENTENCES.values())


# --- op10 ---


def test_language_of_held_out_documents(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(spark):
    train = [("en", "the cat and the dog sat on the mat with the hat"), ("fr", "le chat et le chien sont sur la table avec des amis"), (None, "ignored text"), ("de", None)] * 3
    train = spark.createDataFrame(train, "lang string, text string")
    rows = [(1, "The DOG!!! and the cat"), (2, "le chien et le chat"), (3, None), (4, ""), (5, "123 --- 456"), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.predict(docs, train).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "fr")
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert 0 <= got[6].score <= 1
    assert langid.predict(docs.limit(0), train).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, train.limit(0)).collect()} == {"und"}


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    joined = " " + " ".join(words) + " "
    return sorted(joined[i : i + n] for n in langid.ORDERS for i in range(len(joined) - n + 1)) if words else []


def test_grams_are_those_of_words_whatever_the_chunk(monkeypatch):
    """Equal n-grams have equal hashes and others don't, also over the bounds of chunks."""
    draw = random.Random(12)
    texts = ["", "a", " - ", "ab", *("".join(draw.choice("abcÉß  -1\n") for _ in range(draw.randrange(1, 60))) for _ in range(200))]
    for chunk in (1 << 20, 7, 1):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for text in texts:
            assert sorted(Counter(langid.grams(text).tolist()).values()) == sorted(Counter(brute_grams(text)).values()), (chunk, text)


def test_predictions_are_the_brute_ones(spark):
    """Without hash collisions a score is the share of a text's n-grams that the language's documents have; ties go to the larger language."""
    train = [("en", "the cat sat on the mat"), ("en", "a dog and the cat"), ("en", "mat and hat"), ("fr", "le chat est la"), ("fr", "les amis de la ville")]
    held = {lang: set().union(*(brute_grams(t) for x, t in train if x == lang)) for lang in ("en", "fr")}
    rows = [(1, "the cat and le chat"), (2, "amis"), (3, "zzzz qqqq"), (3, "zzzz qqqq"), (4, "the dog " * 50_000), (None, "la ville")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("lang_pred", "_found", "lang", "gram")})
    model = langid.learn(spark.createDataFrame(train, "lang string, text string"), min_share=0.0, max_ratio=1e18, min_docs=1)
    for _, text in rows:
        grams = brute_grams(text)
        share = {lang: sum(g in own for g in grams) / len(grams) for lang, own in held.items()}
        lang, score = model.predict(text)
        assert abs(score - max(share.values())) < 0.02 and (lang == max(share, key=lambda x: (share[x], x == "en")))
    got = langid.predict(docs, spark.createDataFrame(train, "lang string, text string"))
    assert got.count() == len(rows) and {r.lang_pred for r in got.where("doc_id = 3").collect()} == {"en"}


def test_many_languages_share_one_filter():
    import numpy as np

    languages = [f"l{i}" for i in range(70)]
    words = np.zeros((2, 1 << 12), np.uint64)
    for i, text in ((3, "alpha beta gamma"), (69, "omega sigma kappa")):
        one, two = langid.slots_of(langid.grams(text), 1 << 12)
        for slots in (one, two):
            words[i // 64, slots] |= np.uint64(1 << i % 64)
    model = langid.LanguageFilter(languages, words)
    assert model.predict("beta gamma")[0] == "l3" and model.predict("sigma")[0] == "l69"
