"""The site style tree: its vote inside articles, brute-force importance, small hosts, deep and broken markup."""

import math
import time

import pytest

from eventide.llm import style_tree


def page(i: int, host: str = "a.example", extra: str = "", body: str | None = None) -> tuple:
    body = body or f"<h1>Title {i}</h1><p>First words of {i}.</p><p>Shared passage.</p><p>More of {i}.</p>"
    return i, f"https://{host}/{i}", f"<body><div class='k9'>Same words on all</div><article>{body}{extra}</article></body>"


BOX = "<div class='q7'><p>Join the circle of readers</p></div>"


def texts(spark, rows):
    return {r.page_id: r.text for r in style_tree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_tree_decides_inside_articles(spark):
    got = texts(spark, [page(i, extra=BOX) for i in range(40)])
    for i, text in got.items():
        assert text == f"Title {i} First words of {i}. Shared passage. More of {i}."
        assert "circle" in style_tree.extract(page(i, extra=BOX)[2])  # without the tree it stays


@pytest.mark.parametrize("pages", [1, 2, 4])
def test_small_hosts_keep_their_articles(spark, pages):
    got = texts(spark, [page(i, extra=BOX) for i in range(pages)])
    assert all(t == f"Title {i} First words of {i}. Shared passage. More of {i}. Join the circle of readers" for i, t in got.items())


def test_copies_of_an_article_count_once(spark):
    same = "<h1>One title</h1><p>One text.</p>"
    rows = [page(i, body=same) for i in range(60)] + [page(60 + i) for i in range(5)] + [page(0, body=same)]
    got = texts(spark, rows)
    assert all(got[i] == "One title One text." for i in range(60))
    assert got[62] == "Title 62 First words of 62. Shared passage. More of 62."


def test_hosts_without_articles(spark):
    rows = [(i, f"https://b.example/{i}", f"<body><div class='z1'>Top of all</div><div class='z2'><p>Words {i}.</p><p>Other {i}.</p></div><div class='z3'>End of all</div></body>") for i in range(30)]
    assert texts(spark, rows) == {i: f"Words {i}. Other {i}." for i in range(30)}


def test_importance_equals_brute_force(spark):
    rows = [page(i, extra=BOX) for i in range(12)] + [page(3, extra=BOX)] + [page(20 + i, "c.example") for i in range(3)]
    site = spark.createDataFrame([(hash(u.split("/")[2]) % 1000, i, h) for i, u, h in rows], "host long, page long, html string")
    found = style_tree.site_features(site).dropDuplicates(["host", "page", "kind", "key", "other"])
    branches, leaves = style_tree.importance(found)
    want_branch, want_leaf = {}, {}
    for host in {r.host for r in site.collect()}:
        by_content = {}
        for h in (r.html for r in site.collect() if r.host == host):
            content, own, above, elements = style_tree.features(h)
            by_content[content] = (own, above, elements)
        n, shown, styles, ups = len(by_content), {}, {}, {}
        for own, above, elements in by_content.values():
            for path, text, _ in own:
                shown[path, text] = shown.get((path, text), 0) + 1
            for path, style in elements:
                styles.setdefault(path, {}).setdefault(style, 0)
                styles[path][style] += 1
            ups |= above
        worth = {k: 1 - math.log(q) / math.log(n + style_tree.UNSEEN) for k, q in shown.items()}
        want_leaf |= {(host, text): v for (_, text), v in worth.items()}
        for path, counts in styles.items():
            below = [k for k in shown if path in ups[k[0]]]
            if not below:
                continue
            content = sum(shown[k] * worth[k] for k in below) / sum(shown[k] for k in below)
            m, fade = sum(counts.values()), style_tree.GAMMA ** len(counts)
            entropy = -sum(c / m * math.log(c / m, m) for c in counts.values()) if m > 1 else 1.0
            want_branch[host, path] = (1 - fade) * entropy + fade * content
    assert {(r.host, r.key): r.importance for r in branches.collect()} == pytest.approx(want_branch)
    assert {(r.host, r.key): r.importance for r in leaves.collect()} == pytest.approx(want_leaf)


def test_broken_and_deep_markup():
    assert style_tree.extract('<article><p title="a>b</p><p>two</p></article>') == "b two"
    assert style_tree.extract('<article><p title="a>b">one</p> 1 < 2<p class=q>three</article>') == "one 1 < 2 three"
    assert style_tree.extract("<article><p>one<!-- never closed <p>two") == "one"
    began = time.time()
    assert style_tree.extract("<div>x" * 200_000).count("x") == 200_000
    assert style_tree.extract("<a " * 50_000 + '<b "' * 50_000) == ""
    assert len(style_tree.features("<div class=c><p>x" * 50_000)[2]) < 4 * style_tree.DEPTH
    assert time.time() - began < 60
