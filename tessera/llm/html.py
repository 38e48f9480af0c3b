"""Main text of web pages.

The pages of a host become token streams whose suffixes are keyed and shuffled by host and key. Outside marked articles this is a
suffix array cut at depth DEPTH: every suffix is keyed by its first DEPTH tokens, suffixes of one key stand together with a common
prefix of at least DEPTH, and a key met on PAGES or more distinct pages and SHARE of the host's marks a long repeated substring.
Covered runs are boilerplate, unique runs are kept. Where an article is marked, the markup says where it stands and the array which of
its blocks stay: as articles quote each other and are copied, only whole blocks may go, so the array holds the suffixes that begin a block, keyed to
the block's end, and a block goes that stands in HALF of the host's articles, those that are near copies counted as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DEPTH, PAGES = 6, 3
#: Pages of a host from which PAGES holds (two are enough below), share of a host's pages, tokens of a run inside a block, tokens of a block that tells a body.
SMALL_HOST, SHARE, RUN, BODY = 10, 0.05, 12, 20
#: Share of a host's articles from which a whole block of a marked article is no part of it; on hosts of fewer than SMALL_HOST articles none goes.
HALF = 0.5

# How HTML elements are treated.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noframes xmp".split())
SPACED = set("br td th".split())
NEVER = set("script style template noscript iframe noframes textarea select option button input object svg canvas audio video map head title form label fieldset dialog menu datalist".split())
OUTSIDE = set("nav aside footer".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
WORDS_OUT = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar"
    " footer masthead comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended pagination pager hidden".split()
)
HEADS_OUT = set("header siteheader pageheader".split())
# Words of layout that may stand beside one of the above in a class name; a name with any other word in it is less sure, and then the block's links decide.
LAYOUT = set("bar block box container inner left list outer right section slot unit widget wrap wrapper".split())
MIXED = np.array([-7046029254386353131, -4417276706812531889, 1609587929392839161])  # odd factors of the least hashes
DENSE = 0.5  # share of a block's characters in links from which a less sure name counts
# An article that opens inside one of these is no main article.
FIRM = set("comment comments commentlist reply replies respond discussion disqus related recommended nav aside footer widget sidebar ad ads".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<rest>[^>]*)(?:>|\Z))",
    re.S,
)
ATTR = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|\Z))""", re.I)


def _reason(name: str, attrs: str, in_article: bool) -> str:
    """Why an element is no main text, or nothing."""
    if name in NEVER or name in OUTSIDE or (name == "header" and not in_article):
        return name
    if not attrs or name in ("html", "body"):
        return ""
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "hidden"
        if key == "role" and value in ROLES:
            return value
        if key in ("class", "id"):
            listed = lambda w: w in WORDS_OUT or (w in HEADS_OUT and not in_article)
            unsure = ""
            for name_ in value.split():
                words = [w for w in re.split(r"[^a-z]+", name_) if w]
                if found := [w for w in words if listed(w)]:
                    if all(listed(w) or w in LAYOUT for w in words):
                        return found[0] if len(words) == 1 else f"{found[0]}+"  # sure, but the name may be that of a page's wrapper
                    unsure = unsure or f"{found[0]}*"  # part of a longer name
            if unsure:
                return unsure
    return ""


def blocks_of(html: str) -> list[tuple[bool, bool, str]]:
    """The text blocks in page order: (in a marked article, boilerplate by its markup, text).

    A class name of listed words (and words of layout) is boilerplate; one with other words in it only where DENSE of the block stands in links.
    """
    out: list[tuple[bool, bool, str]] = []
    stack: list[tuple[str, str, bool]] = []  # name, the reason that holds here, whether this is an article
    held: list[str] = []
    articles, anchors, linked, reason_held, low = 0, 0, 0, "", html.lower()
    sure = lambda r: bool(r) and r[-1] != "*"

    def say(text: str) -> None:
        """Text of the block at hand; what an inline element is dropped with leaves the block around it whole."""
        nonlocal linked, reason_held
        now = stack[-1][1] if stack else ""
        if held and sure(now) and not sure(reason_held):
            return
        if held and sure(reason_held) and not sure(now):
            flush()
        if not held:
            if text.isspace():
                return
            reason_held = now
        held.append(text)
        linked += len("".join(text.split())) * (anchors > 0)

    def flush():
        nonlocal linked
        if held and (text := " ".join("".join(held).split())):
            reason = reason_held
            gone = bool(reason) and (sure(reason) or linked >= DENSE * len(text.replace(" ", "")))
            out.append((articles > 0 and not gone, gone, text))
        held.clear()
        linked = 0

    def close(to: int):
        nonlocal articles, anchors
        for name, _, main in stack[to:]:
            articles -= main
            anchors -= name == "a"
        del stack[to:]

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if not m:
            say(unescape(html[at:]))
            break
        if m.start() > at:
            say(unescape(html[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        name, attrs = name.lower(), m["attrs"] if m["attrs"] is not None else m["rest"]
        if m["end"]:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in BLOCKS:
            flush()
        elif name in SPACED:
            say(" ")
        if name in RAW:
            end = low.find(f"</{name}", at)
            at = n if end < 0 else end  # the end tag closes nothing that is open
            continue
        if name in VOID:
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        above = stack[-1][1] if stack else ""
        main = name in ("article", "main") or (attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I) is not None)
        if main and above and (name == "main" or above not in FIRM) and not articles:
            above = ""  # what seemed an advert or a menu is the wrapper of the page
        own = _reason(name, attrs, articles > 0)
        if name not in BLOCKS and not sure(own):
            own = ""
        reason = own if sure(own) and not sure(above) else above or own  # a sure reason goes before an unsure one
        main = bool(main and not sure(reason))
        stack.append((name, reason, main))
        articles += main
        anchors += name == "a"
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def stream(blocks: list[str]) -> list[str]:
    """Tokens of the blocks, each block closed by a line end, so that a menu of short items is a long substring."""
    return [t for b in blocks for t in (*b.split(), "\n")]


def keys(tokens: list[str], depth: int) -> list[int]:
    """Suffix keys: signed hashes of the first `depth` tokens of each suffix that has as many; of the whole stream if it is shorter."""
    depth = min(depth, len(tokens))
    return [(h := xxhash.xxh64_intdigest(" ".join(tokens[i : i + depth]).encode("utf-8", "replace"))) - (h >> 63 << 64) for i in range(len(tokens) - depth + 1)] if tokens else []


def unique_runs(blocks: list[str], out: list[bool], repeated: set[int], depth: int) -> list[str]:
    """The blocks that aren't out, without the runs of tokens that repeated keys cover.

    Covering keys that follow each other make one run. It goes if it is a whole block or RUN tokens of one: ordinary phrases repeat too,
    and a repeat of neighbouring blocks may reach a few tokens into the next.
    """
    tokens = stream(blocks)
    covered = [False] * len(tokens)
    for i, k in enumerate(keys(tokens, depth)):
        if k in repeated:
            covered[i : i + depth] = [True] * min(depth, len(tokens) - i)
    kept, at = [], 0
    for block, gone in zip(blocks, out):
        own = block.split()
        runs = [(c, [t for _, t in g]) for c, g in groupby(zip(covered[at : at + len(own)], own), key=lambda x: x[0])]
        at += len(own) + 1
        text = " ".join(t for c, run in runs for t in run if not c or len(run) < min(RUN, len(own)))
        if text and not gone:
            kept.append(text)
    return kept


def sketch(text: str) -> list[int]:
    """Three least hashes of the text's runs of three words: each is the same for two texts as likely as the share of runs that they have in common."""
    words = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in text.split()], np.uint64).view(np.int64)
    runs = words[:-2] * MIXED[0] + words[1:-1] * MIXED[1] + words[2:] * MIXED[2] if len(words) > 2 else words
    return [int((runs * m).min()) for m in MIXED] if len(runs) else [0] * len(MIXED)


PARSED = "page_id string, url string, host string, content string, text string, sketch array<long>, outside array<long>, blocks array<string>, outs array<boolean>"


def parsed(pages: DataFrame, html: str = "html", depth: int = DEPTH, markup: bool = True) -> DataFrame:
    """Each row's host, text (null without a marked article), suffix keys outside it, and all blocks where there is no article.

    A null html counts as empty, whose text is empty; repeated rows stay, page_ids and urls may be null, an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, page in zip(b["page_id"], b["url"], b["html"]):
                found = blocks_of(page or "")
                article = [t for main, _, t in found if main]
                if not markup:
                    found, article = [(False, False, t) for _, _, t in found], []
                text = "\n".join(article) if article or not found else None
                # pages of one body count as one, whatever stands around it
                body = text or "\n".join(t for _, out, t in found if not out and len(t.split()) >= BODY) or page or ""
                content = blake2b(body.encode("utf-8", "replace"), digest_size=16).hexdigest()
                others = keys(stream([t for main, _, t in found if not main]), depth)
                bare = ([t for _, _, t in found], [out for _, out, _ in found]) if text is None else (None, None)
                rows.append((page_id, url, host_of(url), content, text, sketch(text or ""), list(dict.fromkeys(others)), *bare))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    kept = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).alias("html"))
    return kept.mapInPandas(run, PARSED)


def block_key(host: str, block) -> Column:
    return F.xxhash64(F.col(host), block, F.lit("\n"))


def repeated_blocks(articles: DataFrame) -> DataFrame:
    """host, key of the blocks of DEPTH or more words that stand in HALF of the host's articles, of host, text and sketch.

    Articles that agree in a least hash count as one by it, so near copies are few; the middle one of the three counts holds for a block, as one least hash may lie in the repeat itself.
    A title, the first block, is not looked at; a host of fewer than SMALL_HOST articles has no row, and neither has an empty table.
    """
    told = articles.filter("text <> ''").select("host", "sketch", F.split("text", "\n").alias("blocks"))
    begun = F.filter(F.slice("blocks", 2, F.greatest(F.size("blocks"), F.lit(1))), lambda b: F.size(F.split(b, " ")) >= DEPTH)
    placed = told.select("host", "sketch", F.explode(F.array_distinct(F.transform(begun, lambda b: block_key("host", b)))).alias("key"))
    counts = [F.count_distinct(F.col("sketch")[i]) for i in range(len(MIXED))]
    # only keys that stand on enough pages of any host are counted by sketches
    often = placed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= SMALL_HOST * HALF).select("key")
    found = placed.join(often, "key", "left_semi").groupBy("host", "key").agg(F.sort_array(F.array(*counts))[1].alias("n"))
    sizes = told.groupBy("host").agg(F.greatest(*counts).alias("most")).filter(F.col("most") >= SMALL_HOST)
    return found.join(sizes, "host").filter(F.col("n") >= F.col("most") * HALF).select("host", "key")


def without_repeats(articles: DataFrame) -> DataFrame:
    """page_id, url, text of the articles without the repeated blocks of their hosts, of which a host has at most its articles' mean number of blocks by HALF.

    Where less than HALF of an article's words would stay it is itself copied, and all of it stays.
    """
    repeated = written(repeated_blocks(articles), "repeated-blocks")
    if repeated.isEmpty():
        return articles.select("page_id", "url", "text")
    gone = repeated.groupBy("host").agg(F.collect_set("key").alias("gone"))
    blocks, words = F.split("text", "\n"), lambda text: F.size(F.split(text, "[ \n]"))
    stays = F.filter(blocks, lambda b, i: (i == 0) | (F.size(F.split(b, " ")) < DEPTH) | ~F.array_contains("gone", block_key("host", b)))
    left = F.array_join(stays, "\n")
    kept = F.when(F.col("gone").isNull() | (words(left) < words(F.col("text")) * HALF), F.col("text")).otherwise(left)
    return articles.join(gone, "host", "left").select("page_id", "url", kept.alias("text"))


def main_text(pages: DataFrame, html: str = "html", depth: int = DEPTH, min_pages: int = PAGES, markup: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    A null html or one without text gives an empty text. A page without an article keeps what is neither boilerplate by its markup nor covered by
    substrings repeated on min_pages pages of its host, on two of a host of fewer than SMALL_HOST pages, and on SHARE of them at least; pages of one
    body count as one, a null url as a host of its own name. A marked article loses the blocks that repeated_blocks() tells. Without `markup` the array alone decides, about every block of every page. Repeated rows stay, page_ids may be null, other columns are ignored.
    """
    rows = written(parsed(pages, html, depth, markup), "parsed-pages")
    marked = without_repeats(rows.filter("text IS NOT NULL"))
    bare = rows.filter("text IS NULL")
    if bare.isEmpty():  # the array has nothing to decide
        return _told(marked)
    bodies = rows.select("host", "content", "outside").dropDuplicates(["host", "content"])
    sizes = rows.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    least = F.greatest(F.when(F.col("pages") < SMALL_HOST, min(2, min_pages)).otherwise(min_pages), F.ceil(F.col("pages") * SHARE))
    often = bodies.select("host", F.explode("outside").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = written(often.join(sizes, "host").filter(F.col("n") >= least).select("host", "key"), "repeated-suffixes")

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            yield pd.DataFrame({
                "page_id": b["page_id"], "url": b["url"],
                "text": ["\n".join(unique_runs(list(x), list(o), set() if k is None else set(k), depth)) for x, o, k in zip(b["blocks"], b["outs"], b["found"])],
            })

    # every page's own suffixes meet the host's repeated ones; only keys travel
    keyed = bare.select("content", "host", F.explode("outside").alias("key")).distinct()
    found = keyed.join(repeated, ["host", "key"]).groupBy("content", "host").agg(F.collect_list("key").alias("found"))
    kept = bare.join(found, ["content", "host"], "left").select("page_id", "url", "blocks", "outs", "found").mapInPandas(keep, "page_id string, url string, text string")
    return _told(marked.union(kept))


def _told(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
