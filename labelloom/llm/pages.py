"""Main text of web pages, with site templates found by counting element subtrees per host.

Every element's subtree is hashed (its place, that is the tags above it, and tag names and texts, bottom up). Spark counts
on how many different pages of its host each hash occurs; a subtree on many of them is template and is deleted. Two kinds of element need no count: those that HTML itself
or their class or id marks as navigation, header, footer, sidebar, notice, advert, form, script or comments.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import shared

#: A container is template if it is on so many pages of its host and on such a share of them, or on MANY_PAGES of them.
MIN_PAGES = 5
MIN_SHARE = 0.02
MANY_PAGES = 200
#: Elements inside a line of text, cells and single texts, which may well recur in what pages say, need such a share.
PART_SHARE = 0.2
#: Template hashes of 8 bytes, shipped to every task up to this number, joined by page beyond.
BROADCAST_HASHES = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
DROPPED = frozenset("head script style textarea title iframe noembed noframes noscript template svg math object canvas audio video nav aside footer form button select dialog menu".split())
MAIN = frozenset(["article", "main"])
BLOCKS = frozenset(("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split())
#: Blocks that are parts of a larger one.
CELLS = frozenset("br caption dd dt li option tbody td tfoot th thead tr".split())
#: Blocks that hold one text. Headings go only with a container: a section may be called alike on every page.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p pre blockquote figcaption hgroup summary".split())
#: A start tag of the key closes an open element of these, up to the given borders.
ENDS_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set())}
#: Words in a class, id or role that mark what is not the article.
MARKS = frozenset(("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs header "
                   "masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond "
                   "related recommended share sharing social widget pagination pager complementary contentinfo search form").split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "marked", "parts", "main", "inside", "spared", "place", "hash")

    def __init__(self, tag: str, marked: bool, inside: bool, spared: bool = False, place: int = 0):
        self.tag, self.marked, self.inside, self.spared, self.place = tag, marked, inside, spared, place
        self.parts: list = []
        self.main, self.hash = tag in MAIN or tag == "h1", 0


def marked(attributes: str) -> bool:
    for found in NAMES.finditer(attributes):
        value = found[1] or found[2] or found[3] or ""
        if any(w.lower() in MARKS for w in WORD.findall(value)):
            return True
    return False


def parse(html: str) -> Node:
    """The element tree. Unclosed elements end where HTML ends them; a tag cut off at the end of the text is no text."""
    root = Node("#root", False, False)
    stack, at, raw_end = [root], 0, None

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            digest = hashlib.blake2b(b"%d " % node.place + node.tag.encode("utf-8", "replace"), digest_size=8)
            for p in node.parts:
                digest.update(b"\0" + " ".join(p.split()).encode("utf-8", "replace") if isinstance(p, str) else b"\1%d" % p.hash)
                if not isinstance(p, str) and p.main:
                    node.main = True
            node.hash = int.from_bytes(digest.digest(), "little", signed=True)

    def up_to(tags, borders) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(k)
                return
            if stack[k].tag in borders or stack[k].tag in ("table", "button"):
                return

    while True:
        m = TAG.search(html, at)
        text = html[at:m.start() if m else len(html)]
        if text:
            stack[-1].parts.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                if tag == "p" or tag == "br":
                    stack[-1].parts.append(Node("br", False, stack[-1].inside))
            continue
        if tag in ENDS_P:
            up_to({"p"}, {"td", "th", "li", "div", "article", "section", "body"})
        if tag in CLOSES:
            up_to(*CLOSES[tag])
        top = stack[-1]
        place = top.place if top.tag in ("#root", "html", "body") else zlib.crc32(top.tag.encode("utf-8", "replace"), top.place)
        node = Node(tag, marked(attributes) if attributes else False, top.inside or top.tag in MAIN, top.spared or top.tag in ("article", "h1"), place)
        top.parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            raw_end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            body = html[at:raw_end.start() if raw_end else len(html)]
            node.parts.append(body)
            stack.append(node)
            close(len(stack) - 1)
            at = raw_end.end() if raw_end else len(html)
            continue
        stack.append(node)
    close(0)
    return root


def ruled_out(node: Node) -> bool:
    """Whether the element's tag, or its class, id or role, says that it is not the article."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not node.inside and not node.main
    return node.marked and not node.main and node.tag not in ("html", "body")


def whole(node: Node) -> bool:
    """Whether the element is a container of its own, neither part of a larger one nor a single text."""
    return node.tag in BLOCKS and node.tag not in CELLS and node.tag not in LEAVES


def deletable(node: Node) -> bool:
    """Whether a recurring element may go: none that is in, is or holds an article, main or h1; no heading alone; in main only containers."""
    return not node.spared and not node.main and node.tag not in MAIN and node.tag not in HEADINGS and (whole(node) or not node.inside)


def subtrees(root: Node) -> dict[int, bool]:
    """Hashes of all elements that may be template, and whether each is a container."""
    out, todo = {}, [root]
    while todo:
        node = todo.pop()
        for p in node.parts:
            if not isinstance(p, str) and not p.spared and p.tag != "article":
                todo.append(p)
                if p.parts and deletable(p):
                    out[p.hash] = whole(p)
    return out


def extract(root: Node, template) -> str:
    """Texts of the remaining blocks: white space runs become one space, blocks are joined by one space."""
    blocks, now = [], []

    def flush() -> None:
        if now:
            if words := "".join(now).split():
                blocks.append(" ".join(words))
            now.clear()

    todo: list = [root]
    while todo:
        p = todo.pop()
        if p is None:
            flush()
        elif isinstance(p, str):
            now.append(p)
        elif not ruled_out(p) and not (p.hash in template and deletable(p)):
            if p.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(p.parts))
        elif p.tag in BLOCKS:
            flush()
    flush()
    return " ".join(blocks)


def _key(host: str | None, subtree: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{host}\0{subtree}".encode(), digest_size=8).digest(), "little", signed=True)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, host, at, body): ``at`` tells rows of one id apart by a hash of what they hold, ``body`` is that of the html alone."""
    url = F.col(f"`{url_col}`").cast("string")
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"^//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"),
                        F.coalesce(host, F.lit("")).alias("host"), F.xxhash64(url, F.col(f"`{html_col}`").cast("string")).alias("at"), F.xxhash64(F.col(f"`{html_col}`").cast("string")).alias("body"))


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, part_share: float = PART_SHARE) -> tuple[DataFrame, DataFrame]:
    """(template keys, (page_id, at, host, body, key, whole) of all subtrees); a key is a hash of host and subtree.

    Pages of a host that hold the same html, repeated rows, mirrors and print views among them, count as one page.
    """
    def run(batches):
        for b in batches:
            ids, at, hosts, bodies, keys, blocks = [], [], [], [], [], []
            for i, a, host, body, text in zip(*(b.column(c).to_pylist() for c in ("page_id", "at", "host", "body", "html"))):
                found = sorted((_key(host, h), w) for h, w in subtrees(parse(text or "")).items())
                ids += [i] * len(found)
                at += [a] * len(found)
                hosts += [host] * len(found)
                bodies += [body] * len(found)
                keys += [k for k, _ in found]
                blocks += [w for _, w in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(keys, pa.int64()), pa.array(blocks, pa.bool_())],
                                             ["page_id", "at", "host", "body", "key", "whole"])

    found = shared.materialise(rows.select("page_id", "at", "host", "body", "html").mapInArrow(run, "page_id bigint, at bigint, host string, body bigint, key bigint, whole boolean"))
    counted = found.select("host", "key", "whole", "body").distinct().groupBy("host", "key", "whole").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hosts = rows.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    needed = F.when(F.col("whole"), F.least(F.col("pages") * F.lit(min_share), F.lit(float(many_pages)))).otherwise(F.col("pages") * F.lit(part_share))
    kept = counted.join(hosts, "host").where(F.col("n") >= needed).select("key").distinct()
    return shared.materialise(kept), found


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null or empty html gives an empty text. Pages without a readable host share one empty host. Template deletion never
    reaches into an article or h1 element, or takes away one of these or a main: what recurs there is content. Of what is
    inside main only containers are deleted, and headings nowhere but with a container. Repeated rows are returned as
    often as they come and, like other pages of a host with equal html, count as one page when templates are sought; rows
    under one page_id are told apart by their content. An empty table gives no row. Other columns are ignored.
    """
    rows = _pages(pages, id_col, url_col, html_col)
    keys, found = templates(rows)
    spark = pages.sparkSession
    if keys.count() <= BROADCAST_HASHES:
        sent = spark.sparkContext.broadcast(np.sort(np.fromiter((r.key for r in keys.toLocalIterator()), np.int64)))
        rows = rows.withColumn("own", F.lit(None).cast("array<bigint>"))
    else:
        sent = spark.sparkContext.broadcast(np.zeros(0, np.int64))
        own = found.join(keys, "key").groupBy("page_id", "at").agg(F.collect_set("key").alias("own")).select(F.col("page_id").alias("p"), F.col("at").alias("a"), "own")
        rows = rows.join(own, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("at") == F.col("a")), "left")

    def run(batches):
        all_keys = sent.value
        for b in batches:
            out = []
            for host, text, own in zip(*(b.column(c).to_pylist() for c in ("host", "html", "own"))):
                root = parse(text or "")
                mine = subtrees(root)
                known = {h: _key(host, h) for h in mine}
                if own is not None:
                    hit = set(own)
                else:
                    k = np.array(list(known.values()), np.int64)
                    i = np.searchsorted(all_keys, k).clip(max=max(0, len(all_keys) - 1))
                    hit = set(k[all_keys[i] == k].tolist()) if len(k) and len(all_keys) else set()
                out.append(extract(root, {h for h, key in known.items() if key in hit}))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "host", "html", "own").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
