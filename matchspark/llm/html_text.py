"""Main text of web pages from their structure and a suffix array over the pages of a host.

A page is cut into text blocks, each within the article, within a part that is never article (menus, adverts, forms,
comments and the like) or undecided. The token streams of the pages of one host are concatenated, and a suffix array
finds runs of RUN words or more that stand on distinct pages. Undecided blocks lose the words that such runs cover and
keep their unique runs; pages that mark their article keep it whole, because an article may well be printed twice.

A suffix array takes about SHARE_CHARS of markup: several small hosts, one host, or a share of a large one. What stands
in different shares of a host is then compared by hashes, so a run is found wherever its pages are dealt. Every run has an
anchor, the smallest hash among its GRAM-word pieces. Shares first exchange short hashes of their anchors, then whole
hashes of the runs whose anchors other shares hold too; each share gets one bit back for everything it sent.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import U64, lean, mix, release, sized, unpack_text
from matchspark.llm.url_filter import host_and_path

#: Words of a repeated run and of its anchors, characters of markup per suffix array, shares of a host per bucket of hashes.
RUN, GRAM, SHARE_CHARS, BUCKET_SHARES = 8, 4, 4 << 20, 4
#: Characters that a page counts for besides its markup.
PAGE_CHARS = 256
MULTIPLIERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
JUNK_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "applet", "head"}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
JUNK_NAMES = {
    "ad", "ads", "adbox", "advert", "advertisement", "adverts", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "dfp", "disqus",
    "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "paywall",
    "popup", "promo", "promoted", "promotion", "recommendations", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "taboola", "toolbar", "topbar", "widget", "widgets",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ARTICLE, UNDECIDED, JUNK = 0, 1, 2


def kind_of(tag: str, attributes: str, above: int) -> int:
    """What an element's text is, from its own tag and attributes and from what it stands in."""
    found = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t") else {}
    names = set(re.split(r"[\s_\-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    if tag in ("body", "html"):
        return above
    if tag in JUNK_TAGS or role in JUNK_ROLES or names & JUNK_NAMES or hidden or tag == "header" and above != ARTICLE:
        return JUNK
    if tag == "main" or role == "main" or tag == "article" and above != JUNK:
        return ARTICLE
    return above


known_kind = functools.lru_cache(4096)(kind_of)


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of every block of a page in order; text is decoded, with single blanks, and not empty."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    kind, at, size = UNDECIDED, 0, len(page)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((kind, text))

    def cut(n: int) -> None:
        nonlocal kind
        del stack[n:]
        after = stack[-1][1] if stack else UNDECIDED
        if after != kind:
            flush()
            kind = after

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[:1] != "<" or text == "<":
                parts.append(html.unescape(text))
            continue
        tag = tag.lower()
        if tag not in INLINE and tag not in RAW:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    cut(i)
                    break
                if stack[i][0] in ("article", "main", "body", "table") and tag in ("p", "b", "i", "span", "a", "li"):
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag not in INLINE else None)
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    cut(i)
                    if tag not in ("tr",):
                        break
                elif stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
        above = stack[-1][1] if stack else UNDECIDED
        own = (known_kind if len(m[3]) < 256 else kind_of)(tag, m[3], above)
        if own == JUNK and tag not in INLINE or own != kind:
            flush()
        stack.append((tag, own))
        kind = own
    flush()
    return out


def words_of(share: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a share as numbers and as hashes; and of each page its number of words and its identity by them."""
    pages = (unpack_text(packed.as_py()).decode().partition("\n")[2].replace("\n", " ") for packed in share["packed"])
    lists = pc.split_pattern(pa.array([page or None for page in pages], pa.large_string()), " ")
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(lists).dictionary_encode()
    number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)[number]
    digests = (hashlib.blake2b(hashes[b - k:b].tobytes(), digest_size=8).digest() for b, k in zip(np.cumsum(size), size))
    page = np.array([max(SEVERAL + 1, int.from_bytes(digest, "little")) for digest in digests], U64)
    return number, hashes, size, page


def group_starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the index at which each one's equals begin, and how many they are."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    count = np.diff(np.append(first, len(keys)))
    return np.repeat(first, count), np.repeat(count, count)


def repeated_words(number: np.ndarray, size: np.ndarray, pages: np.ndarray, hosts: np.ndarray, run: int = RUN) -> list[np.ndarray]:
    """For each page's words: whether a run of ``run`` words around it also stands on another page of its host.

    The suffix array of all pages is built by doubling up to ``run`` words, each time among the suffixes that are still
    tied: those with equal first ``run`` words are neighbours in it. Pages with the same words throughout count as one.
    """
    host = np.unique(hosts, return_inverse=True)[1].astype(np.int64)
    same = np.unique(np.stack([host.astype(U64), pages]), axis=1, return_inverse=True)[1].reshape(-1)
    page = np.repeat(same, size + 1)
    n, ends = len(page), np.cumsum(size + 1) - 1
    token = np.zeros(n, np.int64)
    token[np.delete(np.arange(n), ends)] = number * (host.max() + 1) + np.repeat(host, size)
    token[ends] = token.max() + 1 + np.arange(len(ends))  # every end differs, so no run crosses pages
    at = np.argsort(token, kind="stable")
    equals, count = group_starts(token[at])
    rank = np.empty(n, np.int64)
    rank[at] = equals  # a suffix's place in the array, or that of the first one tied with it
    at, width = at[count > 1], 1
    while width < run:
        step = min(width, run - width)
        key = rank[at] * (n + 1) + rank[at + step]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        equals, count = group_starts(key)
        rank[at] += equals - group_starts(rank[at])[0]
        at = at[count > 1]
        width += step
    shared = np.zeros(n, bool)
    if len(at):
        first = np.unique(group_starts(rank[at])[0])
        low, high = np.minimum.reduceat(page[at], first), np.maximum.reduceat(page[at], first)
        shared[at] = np.repeat(low != high, np.diff(np.append(first, len(at))))
    reach = np.concatenate([[0], np.cumsum(shared)])
    covered = reach[1:] - reach[np.maximum(np.arange(n) - run + 1, 0)] > 0
    return [covered[a:b] for a, b in zip(ends - size, ends)]


def main_text(found: list[tuple[int, str]], covered: np.ndarray) -> str:
    """The article, or where a page marks none the unique runs of its undecided blocks."""
    if any(kind == ARTICLE for kind, _ in found):
        return "\n".join(text for kind, text in found if kind == ARTICLE)
    out, at = [], 0
    for kind, text in found:
        words = text.split()
        own = covered[at:at + len(words)]
        at += len(words)
        if kind == UNDECIDED:
            kept = " ".join(w for w, c in zip(words, own) if not c)
            if kept:
                out.append(kept)
    return "\n".join(out)


PAGE_ROWS = pa.schema([("share", pa.int64()), ("host", pa.int64()), ("parts", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("packed", pa.binary())])
SENT = pa.schema([("host", pa.int64()), ("bucket", pa.int64()), ("share", pa.int64()), ("hashes", pa.binary())])
MARKS = pa.schema([("share", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_repeated", pa.int64())])
#: A run as shares exchange it; page is SEVERAL if the share has it on distinct pages.
STRING = np.dtype([("run", "<u8"), ("page", "<u8")])
SEVERAL = 0


@lean
def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows with ``html``: the same with its blocks, packed as a line of kinds and a line for each text."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = []
        for page in batch.column("html"):
            found = blocks(page.as_py())
            packed.append(pack("\n".join(["".join(str(kind) for kind, _ in found), *(text for _, text in found)]).encode()))
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in PAGE_ROWS.names[:-1]), pa.array(packed, pa.binary())], schema=PAGE_ROWS)


def unpacked(share: pa.Table) -> list[list[tuple[int, str]]]:
    """The blocks of each page of a share."""
    pages = (unpack_text(packed.as_py()).decode().split("\n") for packed in share["packed"])
    return [[(int(kind), text) for kind, text in zip(lines[0], lines[1:])] for lines in pages]


def runs(gram: np.ndarray, size: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of RUN words within a page: anchor, hash, identity of the page and place among all words."""
    if len(gram) < RUN:
        return tuple(np.zeros(0, t) for t in (U64, U64, U64, np.int64))
    end = np.cumsum(size)
    for i, m in enumerate(MULTIPLIERS[:2]):
        gram = gram[:-(1 << i)] * U64(m) + gram[1 << i:]
    run = mix(gram[:-GRAM] * U64(MULTIPLIERS[2]) + gram[GRAM:])
    low = mix(gram)
    anchor = np.minimum.reduce([low[i:i + len(run)] for i in range(RUN - GRAM + 1)])
    owner = np.repeat(np.arange(len(size)), size)[:len(run)]
    at = np.flatnonzero(np.arange(len(run)) + RUN <= end[owner])
    return mix(anchor[at] ^ U64(0x5851F42D4C957F2D)), run[at], page[owner[at]], at


def buckets_of(share: pa.Table) -> int:
    """Buckets of hashes of the host of a share; 0 if the share holds its hosts whole."""
    parts = share["parts"][0].as_py()
    return -(-parts // BUCKET_SHARES) if parts > 1 else 0


def by_bucket(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of the keys of each bucket, in order."""
    bucket = (keys % U64(buckets)).astype(np.int64)
    return np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def marked(keys: np.ndarray, buckets: int, marks: pa.Table, kind: int) -> np.ndarray:
    """Which of a share's distinct sorted ``keys`` the bits that came back for them mark."""
    out, places = np.zeros(len(keys), bool), by_bucket(keys, buckets)
    for own, bucket, bits in zip(*(marks[name].to_pylist() for name in ("kind", "bucket", "bits"))):
        if own == kind:
            out[places[bucket]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(places[bucket])).astype(bool)
    return out


def sent(share: pa.Table, buckets: int, keys: np.ndarray, data: np.ndarray) -> pa.Table:
    """``data`` of a share's distinct sorted ``keys``, a row per bucket."""
    rows = [(share["host"][0].as_py(), b, share["share"][0].as_py(), data[at].tobytes()) for b, at in enumerate(by_bucket(keys, buckets)) if len(at)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SENT.types)], schema=SENT) if rows else SENT.empty_table()


def sent_anchors(share: pa.Table) -> pa.Table:
    """Three bytes of each distinct anchor of a share of a large host."""
    buckets = buckets_of(share)
    if not buckets:
        return SENT.empty_table()
    keys = np.unique(runs(*words_of(share)[1:])[0])
    out = sent(share, buckets, keys, (keys // U64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3])
    release()
    return out


def bits_of(group: pa.Table, kind: int, found: list[np.ndarray]) -> pa.Table:
    bits = [np.packbits(x).tobytes() for x in found]
    return pa.Table.from_arrays([group["share"], pa.array([kind] * len(bits), pa.int64()), group["bucket"], pa.array(bits, pa.binary())], schema=MARKS)


def common_anchors(group: pa.Table) -> pa.Table:
    """For the anchors that each share sent to a bucket: whether another share sent the same three bytes."""
    lists = []
    for raw in group["hashes"]:
        three = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, 3).astype(np.int64)
        lists.append(three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16)
    three, shares = np.unique(np.concatenate([np.unique(x) for x in lists]), return_counts=True)
    out = bits_of(group, 0, [np.isin(x, three[shares > 1]) for x in lists])
    release()
    return out


def candidates(hashes: np.ndarray, size: np.ndarray, pages: np.ndarray, buckets: int, marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, page identity and place of the runs whose anchors other shares hold too."""
    anchor, run, page, at = runs(hashes, size, pages)
    keys, own = np.unique(anchor, return_inverse=True)
    kept = marked(keys, buckets, marks, 0)[own]
    return run[kept], page[kept], at[kept]


def least_and_most(run: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs in order, and the smallest and largest page of each."""
    order = np.argsort(run, kind="stable")
    run, page = run[order], page[order]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    return run[first], *(f.reduceat(page, first) if len(run) else page for f in (np.minimum, np.maximum))


def sent_runs(share: pa.Table, marks: pa.Table) -> pa.Table:
    """The distinct candidates of a share of a large host, each with its page."""
    buckets = buckets_of(share) if len(share) else 0
    if not buckets:
        return SENT.empty_table()
    run, page, _ = candidates(*words_of(share)[1:], buckets, marks)
    keys, least, most = least_and_most(run, page)
    strings = np.zeros(len(keys), STRING)
    strings["run"], strings["page"] = keys, np.where(least == most, least, SEVERAL)
    out = sent(share, buckets, keys, strings)
    release()
    return out


def common_runs(group: pa.Table) -> pa.Table:
    """For the runs that each share sent to a bucket: whether they stand on distinct pages of the host."""
    lists = [np.frombuffer(raw.as_py(), STRING) for raw in group["hashes"]]
    strings = np.concatenate(lists)
    keys, least, most = least_and_most(strings["run"], strings["page"])
    shared = (least != most) | (least == SEVERAL)
    out = bits_of(group, 1, [shared[np.searchsorted(keys, x["run"])] for x in lists])
    release()
    return out


def extract(share: pa.Table, marks: pa.Table) -> pa.Table:
    """The main texts of one share of pages."""
    if not len(share):
        return TEXTS.empty_table()
    found = unpacked(share)
    number, hashes, size, pages = words_of(share)
    covered = repeated_words(number, size, pages, share["host"].to_numpy())
    if buckets := buckets_of(share):
        run, _, at = candidates(hashes, size, pages, buckets, marks)
        keys, own = np.unique(run, return_inverse=True)
        at = at[marked(keys, buckets, marks, 1)[own]]
        end = np.cumsum(size)
        step = np.bincount(at, minlength=end[-1] + 1) - np.bincount(at + RUN, minlength=end[-1] + 1)
        across = np.cumsum(step)[:-1] > 0
        covered = [c | x for c, x in zip(covered, np.split(across, end[:-1]))]
    texts = [main_text(page, c) for page, c in zip(found, covered)]
    counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([int(c.sum()) for c in covered], pa.int64())]
    out = pa.Table.from_arrays([share["page_id"], share["url"], pa.array(texts, pa.string()), *counts], schema=TEXTS)
    release()
    return out


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars and n_repeated (words in runs that other pages of the host share).

    Blocks are joined in page order by a line end. A null or empty page has an empty text; pages without host form one
    host. Repeated rows stay and do not count as distinct pages; null ids stay; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_and_path(F.col("url"))[0])
    hosts = rows.groupBy("host").agg(F.sum(F.length("html") + PAGE_CHARS).alias("chars")).withColumn("parts", F.ceil(F.col("chars") / SHARE_CHARS))
    sums = hosts.agg(F.count_if(F.col("parts") > 1).alias("large"), F.sum(F.when(F.col("parts") == 1, F.col("chars"))).alias("small")).first()
    groups = max(1, (sums["small"] or 0) // SHARE_CHARS)
    dealt = rows.join(sized(hosts.where("parts > 1").select("host", "parts"), sums["large"], 100), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    whole = F.pmod(F.xxhash64("host"), F.lit(groups))
    share = F.when(F.col("parts") == 1, whole).otherwise(F.xxhash64("host", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("parts"))))
    dealt = dealt.select(share.alias("share"), F.xxhash64("host").alias("host"), "parts", "page_id", "url", "html")
    shares = dealt.mapInArrow(parsed, "share long, host long, parts long, page_id long, url string, packed binary").groupBy("share")
    sent_schema, marks_schema = "host long, bucket long, share long, hashes binary", "share long, kind long, bucket long, bits binary"
    anchors = shares.applyInArrow(sent_anchors, sent_schema).groupBy("host", "bucket").applyInArrow(common_anchors, marks_schema)
    strings = shares.cogroup(anchors.groupBy("share")).applyInArrow(sent_runs, sent_schema).groupBy("host", "bucket").applyInArrow(common_runs, marks_schema)
    marks = anchors.unionByName(strings).groupBy("share")
    return shares.cogroup(marks).applyInArrow(extract, "page_id long, url string, text string, n_chars long, n_repeated long")
