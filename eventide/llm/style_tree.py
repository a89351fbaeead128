"""Main text of web pages by a site style tree.

The DOMs of a host are merged by element path: every path has the presentation
styles (child sequences) and the contents (texts) that the host's pages show
there. Entropies over the host's distinct pages give a path's importance: a
branch that looks and reads the same everywhere is a site's frame. Low
branches are cut from every page, inside articles as elsewhere. Names are a prior: outside
of articles, elements whose tag, role or class names a frame go (navigation, footers, adverts,
forms ...), inside them only adverts, forms, notices and reader comments. Pages with the same text count once, and a page that was never seen
stands beside those that were, so few pages or copies of one text cut nothing.
A text that repeats under a path with other texts stays in an article.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

#: Attenuation of what lies below a node, and the importance under which a branch is a frame.
GAMMA = 0.9
LOW = 0.2
#: Pages' low nodes are broadcast up to so many keys of 8 bytes, and joined by a shuffle beyond.
BROADCAST_KEYS = 500_000
#: Pages that are taken to exist beside the seen ones, each with contents of its own.
UNSEEN = 6
#: Elements nested deeper become siblings of the one at this depth, as browsers do.
DEPTH = 512

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)|<(?=[!?])")
STOP = re.compile(r"[\"'<>]")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {tag: re.compile(rf"</{tag}\s*>|</{tag}\s[^>]*>|\Z", re.IGNORECASE) for tag in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open paragraph; tags that end an open one of their own kind.
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"} | {"li"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "menu", "dl", "table", "div", "section", "article", "main", "aside", "nav", "body"}
FRAME_TAGS = set("head nav header footer aside form menu dialog noscript template object svg canvas math button select datalist fieldset audio video applet".split()) | RAW
FRAME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note feed".split()) - {"feed", "note"}
FRAME_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer bottombar sidebar sidebars rail aside widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login paywall form search comment comments commentlist disqus respond reply replies "
    "discussion pagination pager toolbar skip disclaimer copyright".split()
)
#: Names that make an article element a part of the frame (comments and teasers are often articles).
ARTICLE_FRAMES = set("ad advert advertisement comment comments reply replies related recommended promo promoted sponsored teaser".split())
#: Inside an article, the tags that are no part of it, ...
INNER_TAGS = FRAME_TAGS - {"header", "fieldset", "math"}
#: ... the words of names that mark adverts, notices and reader comments there, and boxes that any other frame's word names as a whole.
INNER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted cookie cookies consent gdpr newsletter subscribe subscription signup paywall "
    "comments commentlist disqus share sharing social popup modal overlay breadcrumb breadcrumbs pagination pager".split()
)
BOXES = set("aside div dl li ol section table ul".split())
#: A landmark with less than this share of the text outside of frames is no place of its own.
LEAST_SHARE = 0.1
#: Names of what an element contains or lacks say nothing of the element.
ABOUT_OTHERS = re.compile(r"\b(?:has|with|no|without|is)[-_]\S+", re.IGNORECASE)
LANDMARKS = {"article", "main"}


class Page:
    """A parsed page: nodes ``(parent, tag, path hash, frame, landmark)`` and blocks ``(node, text)`` in page order."""

    def __init__(self, html: str):
        self.parents, self.tags, self.paths, self.frames, self.styles = [-1], [""], [0], [False], [[]]
        self.within = [False]
        self.blocks: list[tuple[int, str]] = []
        self.landmarks: list[int] = []
        self._parse(html)

    def _open(self, tag: str, attributes: str) -> int:
        del self.stack[DEPTH:]
        parent = self.stack[-1]
        inner = self.within[parent]
        label, frame = tag, tag in (INNER_TAGS if inner else FRAME_TAGS)
        if attributes and not attributes.isspace() and tag not in ("html", "body", "main"):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".strip()
            if names:
                label = f"{tag}.{re.sub(r'[0-9]+', '0', names)}"
            frame = (
                frame
                or found.get("role", "").lower() in FRAME_ROLES
                or "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or "display:none" in found.get("style", "").replace(" ", "").lower()
                or not (ARTICLE_FRAMES if tag == "article" else INNER_NAMES if inner else FRAME_NAMES).isdisjoint(w.lower() for w in NAME.findall(ABOUT_OTHERS.sub(" ", names)))
                or (inner and tag in BOXES and not FRAME_NAMES.isdisjoint(names.lower().split()))
            )
        node = len(self.parents)
        self.parents.append(parent)
        self.tags.append(tag)
        self.paths.append(_hash(f"{self.paths[parent]}/{label}"))
        self.frames.append(frame)
        self.within.append(inner or (tag in LANDMARKS and not frame))
        self.styles.append([])
        if tag in BLOCK and (not self.styles[parent] or self.styles[parent][-1] != label):  # runs of a tag are one style
            self.styles[parent].append(label)
        if tag in LANDMARKS and not frame:
            self.landmarks.append(node)
        return node

    def _parse(self, html: str) -> None:
        self.stack, text, owner, at, end, quotes = [0], [], 0, 0, len(html), {}

        def flush() -> None:
            nonlocal text
            if text:
                found = " ".join(unescape("".join(text)).split())
                if found:
                    self.blocks.append((owner, found))
                text = []

        while at < end:
            m = TAG.search(html, at)
            if not m:
                text.append(html[at:])
                break
            if m.start() > at:
                text.append(html[at : m.start()])
            if not m[2]:
                at = _markup_end(html, m.start())
                continue
            tag, inner = m[2].lower(), m.end()
            close = _tag_end(html, inner, quotes)
            attributes, at = html[inner:close], close + (html[close : close + 1] == ">")
            if m[1]:
                opened = next((k for k in range(len(self.stack) - 1, 0, -1) if self.tags[self.stack[k]] == tag), 0)
                if tag in BLOCK or tag in FRAME_TAGS or tag == "br":
                    flush()
                if opened:
                    del self.stack[opened:]
            elif tag == "br" or tag == "hr":
                flush()
            elif tag in VOID:
                continue
            elif tag in RAW:
                at = RAW_END[tag].search(html, at).end()
            else:
                if tag in BLOCK or tag in FRAME_TAGS:
                    flush()
                    self._imply_ends(tag)
                if not attributes.endswith("/") or tag in BLOCK:
                    node = self._open(tag, attributes)
                    self.stack.append(node)
            if not text:
                owner = self._block_of(self.stack[-1])
        flush()

    def _block_of(self, node: int) -> int:
        """The block element, or framing inline element, that text under a node belongs to."""
        while node and self.tags[node] not in BLOCK and not self.frames[node]:
            node = self.parents[node]
        return node

    def _imply_ends(self, tag: str) -> None:
        """Start tags end an open paragraph and open siblings."""
        ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tags[self.stack[k]]
            if open_tag in ends:
                del self.stack[k:]
                ends = ends - {open_tag}
                if not ends:
                    return
            elif open_tag in SCOPES:
                return

    def lineage(self, node: int) -> list[int]:
        found = []
        while node > 0:
            found.append(node)
            node = self.parents[node]
        return found

    def settle(self) -> None:
        """``framed`` and ``inside``: if a node lies in a frame, or in a landmark. A frame named by class that holds the landmark with most text is the page's own wrapper."""
        size = [0] * len(self.parents)
        for node, text in self.blocks if len(self.landmarks) > 1 else []:
            size[node] += len(text)
        for node in range(len(size) - 1, 0, -1):  # parents come before their children
            size[self.parents[node]] += size[node]
        largest = max(self.landmarks, key=size.__getitem__, default=0)  # the first, and so the outer, of equals
        wrappers = {a for a in self.lineage(largest)[1:] if self.tags[a] not in FRAME_TAGS}
        self.framed, self.inside = [False], [False]
        for node in range(1, len(self.parents)):
            parent = self.parents[node]
            self.framed.append(self.framed[parent] or (self.frames[node] and node not in wrappers))
            self.inside.append(self.inside[parent] or (self.tags[node] in LANDMARKS and not self.frames[node] and not self.framed[node]))

    def has_landmark(self) -> bool:
        """If articles hold the page's text: not, if what they hold is next to nothing beside the rest."""
        inner = sum(len(t) for n, t in self.blocks if self.inside[n] and not self.framed[n])
        outer = sum(len(t) for n, t in self.blocks if not self.inside[n] and not self.framed[n])
        return inner > 0 and inner >= LEAST_SHARE * (inner + outer)

    def cut_by(self, low: set[int]) -> list[bool]:
        """If a node lies in a low branch. A landmark and what holds it is no branch of its contents."""
        found = [False]
        for node in range(1, len(self.parents)):
            parent = self.parents[node]
            starts = self.inside[node] and not self.inside[parent]
            found.append(not starts and (found[parent] or self.paths[node] in low))
        return found


def _markup_end(html: str, at: int) -> int:
    """End of a comment, CDATA section, declaration or instruction that starts at ``at``."""
    opening, closing = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(o, at)), ("<", ">"))
    end = html.find(closing, at + len(opening))
    return end + len(closing) if end >= 0 else len(html)


def _tag_end(html: str, at: int, quotes: dict) -> int:
    """Where a tag ends: at its ``>``, before a ``<``, or at the end. A quote that doesn't close, or closes only
    amid later markup, is a plain character. quotes remembers the next quotation marks, so that none is sought twice."""
    while m := STOP.search(html, at):
        if m[0] in "<>":
            return m.start()
        at = m.end()
        start, close = quotes.get(m[0], (0, -2))
        if not (start <= at and (close == -1 or at <= close)):
            start, close = quotes[m[0]] = at, html.find(m[0], at)
        if close >= 0 and (html[close + 1 : close + 2] in " \t\r\n/>" or html.find("<", at, close) < 0):
            at = close + 1
    return len(html)


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x00".join(parts))
    return h - 2**64 if h >= 2**63 else h


def features(html: str | None) -> tuple[int, list, dict, list]:
    """(content, leaves ``(path, text, kind)``, ancestors by path, elements ``(path, style)``), hashed and distinct, of a page.

    content is the hash of the text outside named frames. kind: 1 framed, 2 open, 5 in a landmark.
    """
    page = Page(html or "")
    page.settle()
    leaves, above = {}, {}
    for node, text in page.blocks:
        leaf = (page.paths[node], _hash(str(page.paths[node]), text))
        leaves[leaf] = max(leaves.get(leaf, 1), 1 if page.framed[node] else 5 if page.inside[node] else 2)
        if page.paths[node] not in above:
            above[page.paths[node]] = [page.paths[a] for a in page.lineage(node)]
    elements = {(page.paths[n], _hash(*page.styles[n])) for n in range(1, len(page.parents)) if page.tags[n] in BLOCK}
    landmark = page.has_landmark()
    content = _hash(*[t for n, t in page.blocks if not page.framed[n] and (page.inside[n] or not landmark)])
    return content, [(*leaf, kind) for leaf, kind in leaves.items()], above, list(elements)


def extract(html: str | None, low: set[int] = frozenset()) -> str:
    """Main text of a page without its frames and without the branches in low, nor the texts in low that lie in no landmark."""
    page = Page(html or "")
    page.settle()
    landmark = page.has_landmark()
    cut = page.cut_by(low) if low else None
    kept = []
    for node, text in page.blocks:
        if page.framed[node] or (landmark and not page.inside[node]):
            continue
        if cut and (cut[node] or (not page.inside[node] and _hash(str(page.paths[node]), text) in low)):
            continue
        kept.append(text)
    return " ".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def site_features(pages: DataFrame) -> DataFrame:
    """``(host, page, content, key, other, kind, ancestors)`` of pages ``(host, page, html)``: kind 0 page, 1 framed
    leaf, 2 open leaf, 3 element, 4 path (of page 0), 5 leaf in a landmark. Paths and open leaves have their ancestors."""

    def run(batches):
        for batch in batches:
            host, page = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            rows, paths = [], {}
            for h, p, html in zip(host.tolist(), page.tolist(), batch.column(2), strict=True):
                content, leaves, above, elements = features(html.as_py())
                rows.append((h, p, content, 0, 0, 0, None))
                rows += [(h, p, content, path, text, kind, above[path] if kind == 2 else None) for path, text, kind in leaves]
                rows += [(h, p, content, path, style, 3, None) for path, style in elements]
                paths |= {(h, path): up for path, up in above.items()}
            rows += [(h, 0, 0, path, 0, 4, up) for (h, path), up in paths.items()]
            if rows:
                columns = list(zip(*rows, strict=True))
                types = (*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "page", "content", "key", "other", "kind", "ancestors"])

    return pages.mapInArrow(run, "host long, page long, content long, key long, other long, kind int, ancestors array<long>")


def importance(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branches ``(host, key, importance)``, texts ``(host, key, importance)``) of every host.

    Pages of one content count once. A text on q of a host's n contents has
    importance 1 - log q / log (n + UNSEEN); a branch's is (1 - GAMMA^l) times
    the entropy of its l presentation styles plus GAMMA^l times the mean
    importance of the texts below it. A host's only page loses nothing.
    """
    shown = found.where("kind != 4").select("host", "content", "key", "other", F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 3).otherwise(1).alias("kind")).distinct()
    counted = shown.groupBy("host", "kind", "key", "other").agg(F.count("*").alias("q"))
    pages = counted.where("kind = 0").select("host", F.col("q").alias("n"))
    leaves = counted.where("kind = 1").join(pages, "host").withColumn("importance", 1 - F.log("q") / F.log(F.col("n") + UNSEEN))
    by_path = leaves.groupBy("host", "key").agg(F.sum(F.col("q") * F.col("importance")).alias("s"), F.sum("q").alias("q"))
    by_path = by_path.join(found.where("kind = 4").select("host", "key", "ancestors"), ["host", "key"])
    content = by_path.select("host", F.explode("ancestors").alias("key"), "s", "q").groupBy("host", "key").agg((F.sum("s") / F.sum("q")).alias("content"))
    styles = counted.where("kind = 3").withColumnRenamed("q", "c")
    clog = F.sum(F.col("c") * F.log("c"))
    styles = styles.groupBy("host", "key").agg(F.sum("c").alias("m"), clog.alias("clog"), F.count("*").alias("l"))
    presentation = F.when(F.col("m") > 1, (F.log("m") - F.col("clog") / F.col("m")) / F.log("m")).otherwise(1.0)
    styles = styles.select("host", "key", presentation.alias("presentation"), "l")
    fade = F.pow(F.lit(GAMMA), F.col("l"))
    branches = content.join(styles, ["host", "key"]).select("host", "key", ((1 - fade) * F.col("presentation") + fade * F.col("content")).alias("importance"))
    return branches, leaves.select("host", F.col("other").alias("key"), "importance")


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", low: float = LOW) -> DataFrame:
    """pages with ``text``: the main text (empty if none).

    A null html is an empty page; a null or odd url belongs to the nameless
    host; repeated rows count as one page of their site and get equal texts; an
    empty table gives no rows. Markup may be broken anywhere: unclosed
    elements end with their parents, tags without an end before the next one.
    """
    bounded_batches(pages.sparkSession)
    page_key, host = F.xxhash64(url_col, html_col), F.xxhash64(host_of(F.col(url_col)))
    site = pages.select(host.alias("host"), page_key.alias("page"), F.col(html_col).alias("html"))
    found = site_features(site)
    found = checkpointed(found.dropDuplicates(["host", "page", "kind", "key", "other"]))
    branches, texts = importance(found)
    cut = checkpointed(branches.where(F.col("importance") < low).select("host", "key").union(texts.where(F.col("importance") < low).select("host", "key")).distinct())
    own = found.where("kind = 2").select("host", "page", F.explode(F.concat("ancestors", F.array("other"))).alias("key")).distinct()
    own = own.join(cut, ["host", "key"], "left_semi").select("page", "key")
    below = found.where("kind = 4").select("host", F.col("key").alias("leaf"), F.explode("ancestors").alias("key")).join(cut, ["host", "key"], "left_semi").distinct()
    inner = found.where("kind = 5").select("host", "page", F.col("key").alias("leaf")).distinct().join(below, ["host", "leaf"]).select("page", "key")
    hits = own.union(inner).groupBy("page").agg(F.collect_set("key").alias("low"))  # a page's own nodes only
    hits = checkpointed(hits.select(F.col("page").alias("_hit_page"), F.col("low").alias("_low")))
    size = hits.agg(F.sum(F.size("_low") + 1)).first()[0] or 0
    own_key = F.xxhash64(pages[url_col], pages[html_col])
    joined = pages.join(F.broadcast(hits) if size <= BROADCAST_KEYS else hits.hint("merge"), own_key == hits["_hit_page"], "left")
    names = [pages[f"`{c}`"] for c in pages.columns if c != "text"]
    return joined.select(*names, main_text(pages[html_col], hits["_low"]).alias("text"))


def main_text(html: Column, low: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series, lows: pd.Series) -> pd.Series:
        return pd.Series([extract(h, frozenset(x) if x is not None else frozenset()) for h, x in zip(pages, lows, strict=True)], dtype=object)

    return run(html, low)
