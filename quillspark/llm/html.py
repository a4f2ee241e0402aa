"""Main text of web pages: page structure, and a suffix array per host for what structure leaves open.

A scan of the markup sorts a page's blocks into main text, chrome (menus, headers, footers, sidebars, adverts, forms,
comments) and open ones: blocks of pages without an article or main element, and blocks within one that are mostly links
or whose name only hints at chrome (notices, legal lines, related links).  The token streams of a host's chrome and open
blocks are concatenated and sorted as a suffix array with the longest common prefixes of neighbours; runs of suffixes that
share ``RUN`` tokens or more and come from ``LEAST_PAGES`` distinct pages or more are repeats, and what repeats cover is
boilerplate.  Open blocks lose it and keep their unique runs.  Unmarked text of an article is never given up for being
repeated, as reprints and quotations are main text.

A large host is dealt out to shards of bounded size; each shard sorts its own suffixes, and shards exchange only the
hashes of ``RUN``-token prefixes with their page counts.  A place is covered exactly where such a prefix around it stands
on enough pages, so the answer does not depend on the shards.  Every page is parsed once.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.storage import materialize

#: Tokens that a repeated substring has at least, and distinct pages that must share it.
RUN = 8
LEAST_PAGES = 3
#: Tokens in a shard of a host's streams, about.
SHARD_TOKENS = 1_000_000
#: Hosts up to which their numbers of shards are broadcast (about 10 MB); beyond, the join shuffles.
BROADCAST_HOSTS = 100_000

#: Covered pages and places up to which they are broadcast (about 10 MB); beyond, the join shuffles.
BROADCAST_PAGES, BROADCAST_PLACES = 50_000, 2_000_000

# The elements and names that mark a page's parts.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select button".split())
CHROME = frozenset("nav aside footer form menu dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object select".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login comment comments commentlist respond disqus replies reply toolbar pagination pager".split()
)
HINTS = frozenset("alert copyright disclaimer legal notice notices promo promotion recommendations recommended related search share sharing social widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_NAMES = frozenset("articlebody article-body article-content post-content post-body entry-content main-content page-content story-body content article main post entry story".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ENDS = {name: re.compile(f"</{name}", re.I) for name in RAW}


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and raw.strip(" /\n\t") else {}


def _marking(name: str, attributes: dict[str, str], within_main: bool) -> int:
    """2: chrome; 1: a hint of it, which is left to the suffix array; 0: none."""
    if name in CHROME or (name == "header" and not within_main):
        return 2
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return 2
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return 2
    parts = set(_SPLIT.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    if parts & NAMES or ("header" in parts and not within_main and name not in ("h1", "h2", "h3")):
        return 2
    return int(bool(parts & HINTS))


def _main_rank(name: str, attributes: dict[str, str]) -> int:
    """3: article; 2: main; 1: an element named as content; 0: none."""
    if name == "article" or attributes.get("itemprop", "").lower() == "articlebody":
        return 3
    if name == "main" or attributes.get("role", "").lower() == "main":
        return 2
    if attributes and name in ("div", "section", "td"):
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
        return int(any(m in MAIN_NAMES for m in marks))
    return 0


class Page:
    """A page's blocks as (rank of the main element around it, marking, linked share, text), in page order."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, int, float, str]] = []
        self._stack: list[tuple[str, int, int, bool]] = []  # element, rank, marking, dropped
        self._text: list[str] = []
        self._linked = 0
        self._links = 0
        if source:
            self._scan(source)

    def _state(self) -> tuple[int, int, bool]:
        return self._stack[-1][1:] if self._stack else (0, 0, False)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                rank, marking, _ = self._state()
                self.blocks.append((rank, marking, self._linked / max(1, len(text)), text))
            self._text, self._linked = [], 0

    def _add(self, text: str) -> None:
        if text and not self._state()[2]:
            text = html_entities.unescape(text) if "&" in text else text
            self._text.append(text)
            if self._links:
                self._linked += len(text)

    def _open(self, name: str, raw: str) -> None:
        if name in BLOCK:
            self._flush()
        if name in ("br", "td", "th", "img", "hr"):
            self._add(" ")
        if name in VOID:
            return
        if name in ("p", "li", "dt", "dd", "tr", "option") or (name in BLOCK and self._stack and self._stack[-1][0] == "p"):
            self._imply_end(name)
        attributes = _attributes(raw)
        rank, marking, dropped = self._state()
        own = _main_rank(name, attributes)
        marking = max(marking, _marking(name, attributes, max(rank, own) > 1))
        self._stack.append((name, max(rank, own), marking, dropped or name in SKIPPED))
        if name == "a":
            self._links += 1

    def _imply_end(self, name: str) -> None:
        """A new paragraph or item ends the open one; inline elements between them end with it."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}.get(name, ("p",))
        for at in range(len(self._stack) - 1, -1, -1):
            element = self._stack[at][0]
            if element in ends:
                self._pop_to(at)
                return
            if element in BLOCK:
                return

    def _pop_to(self, at: int) -> None:
        self._links -= sum(x[0] == "a" for x in self._stack[at:])
        del self._stack[at:]

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        for at in range(len(self._stack) - 1, -1, -1):
            if self._stack[at][0] == name:
                self._pop_to(at)
                return
            if name not in BLOCK and self._stack[at][0] in BLOCK:
                return

    def _scan(self, source: str) -> None:
        at, unended = 0, set()
        while found := _MARKUP.search(source, at):
            self._add(source[at : found.start()])
            at = found.end()
            data, close, name, raw, close2, name2, raw2 = found.groups()
            close, name, raw = (close, name, raw) if name else (close2, name2, raw2)
            if data:
                self._add(data.replace("&", "&amp;"))
            if not name:
                continue
            name = name.lower()
            if close:
                self._close(name)
            elif name in RAW and not raw.endswith("/") and name not in unended:
                end = _ENDS[name].search(source, at)
                at = end.start() if end else len(source)
                if not end:
                    unended.add(name)
            else:
                self._open(name, raw or "")
        self._add(source[at:])
        self._flush()

    def parts(self) -> tuple[list[tuple[str, bool]], list[str]]:
        """(blocks, evidence): the main blocks as (text, open), and the texts that only bear witness of boilerplate."""
        size: dict[int, int] = {}
        for rank, marking, _, text in self.blocks:
            if marking < 2:
                size[rank] = size.get(rank, 0) + len(text)
        # Of main element and articles in it the one with more text: articles may be cards beside the main text.
        inner = [r for r in size if r > 1]
        best = max(inner, key=lambda r: (size[r], r)) if inner else max(size, default=0)
        main, rest = [], []
        for rank, marking, linked, text in self.blocks:
            if marking == 2 or rank < best or (inner and rank > best):
                rest.append(text)
            else:
                main.append((text, best < 2 or marking == 1 or linked > 0.5))
        return main, rest


def _hash_tokens(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass")) for t in tokens), dtype=np.uint64, count=len(tokens))


def padded(tokens: list[str]) -> list[str]:
    """An open block's tokens, filled up to ``RUN`` with empty ones, so that a short block can be a repeat as a whole."""
    return tokens + [""] * (RUN - len(tokens))


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, lcp): where each suffix starts, and the tokens that it shares with the one before it.

    Prefix doubling: suffixes ranked by their first k tokens and the ranks of what follows are ranked by 2k tokens, until
    all ranks differ.  The ranks of every round are kept: two suffixes share k more tokens where their ranks of that round
    are equal, which gives the common prefix in as many steps as there were rounds.
    """
    n = len(stream)
    rounds = [np.unique(stream, return_inverse=True)[1].astype(np.int64) + 1]
    k = 1
    while len(rank := rounds[-1]) and rank.max() < n:
        following = np.zeros_like(rank)
        following[: max(0, n - k)] = rank[k:]
        rounds.append(np.unique(rank * (n + 2) + following, return_inverse=True)[1].astype(np.int64) + 1)
        k *= 2
    order = np.argsort(rounds[-1])
    lcp = np.zeros(n, dtype=np.int64)
    left, right = order[:-1], order[1:]
    for i in range(len(rounds) - 1, -1, -1):
        x, y = left + lcp[1:], right + lcp[1:]
        inside = (x < n) & (y < n)
        same = np.zeros(len(x), dtype=bool)
        same[inside] = rounds[i][x[inside]] == rounds[i][y[inside]]
        # Past the end ranks of a round may agree for shorter suffixes; a common prefix never passes either end.
        same &= (x + (1 << i) <= n) & (y + (1 << i) <= n)
        lcp[1:][same] += 1 << i
    return order, lcp


def _shard_suffixes(batch: pa.Table) -> pa.Table:
    """A shard's repeats: prefix hash and number of distinct pages, and the open places where each prefix stands."""
    tokens, owner, place = [], [], []
    ids = batch.column("h").to_pylist()
    fences = 0
    for page, (evidence, opens) in enumerate(zip(batch.column("evidence").to_pylist(), batch.column("open").to_pylist(), strict=True)):
        for words, is_open in ((evidence or [], False), (opens or [], True)):
            fences += 1  # no two fences are equal, so no repeat spans two streams
            tokens += [np.array(words, dtype=np.int64).view(np.uint64), np.array([fences * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)]
            owner.append(np.full(len(words) + 1, page))
            place.append(np.where(np.arange(len(words) + 1) < len(words), np.arange(len(words) + 1), -1) if is_open else np.full(len(words) + 1, -1))
    stream, owner, place = (np.concatenate(x) for x in (tokens, owner, place))
    ends = np.cumsum([len(x) for x in tokens])[1::2] - 1
    room = ends[np.searchsorted(ends, np.arange(len(stream)))] - np.arange(len(stream))  # tokens up to the stream's fence
    order, lcp = suffix_array(stream)
    whole = room[order] >= RUN
    at = order[whole]
    # Neighbours in order that share RUN tokens are one group; suffixes that are too short stand between groups.
    new = ~((lcp >= RUN) & whole & np.concatenate([[False], whole[:-1]]))[whole]
    group = np.cumsum(new) - 1
    acc = np.zeros(len(at), dtype=np.uint64)
    for j in range(RUN):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + stream[at + j]
    pages = np.bincount(np.unique(group * (batch.num_rows + 1) + owner[at]) // (batch.num_rows + 1), minlength=group[-1] + 1) if len(at) else np.zeros(0, dtype=np.int64)
    heads = acc[new].view(np.int64)
    spots = at[place[at] >= 0]
    spot_hash = acc[place[at] >= 0].view(np.int64)
    host = batch.column("host")[0].as_py() if batch.num_rows else None
    n, m = len(heads), len(spots)
    return pa.table({
        "host": pa.array([host] * (n + m), pa.string()),
        "prefix": pa.array(np.concatenate([heads, spot_hash])),
        "pages": pa.array(np.concatenate([pages, np.zeros(m, dtype=np.int64)]).astype(np.int64)),
        "h": pa.chunked_array([pa.nulls(n, pa.int64()), pa.array([ids[owner[s]] for s in spots], pa.int64())]),
        "place": pa.chunked_array([pa.nulls(n, pa.int32()), pa.array(place[spots].astype(np.int32))]),
    })


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's main blocks, and the token hashes of its evidence and of its open blocks."""
    block, hashes = pa.list_(pa.struct([("text", pa.string()), ("open", pa.bool_())])), pa.list_(pa.int64())
    for batch in batches:
        blocks, evidence, opens = [], [], []
        for source in batch.column(4):
            main, rest = Page(source.as_py()).parts()
            blocks.append([{"text": t, "open": o} for t, o in main])
            evidence.append(_hash_tokens([t for text in rest for t in text.split()]).view(np.int64))
            opens.append(_hash_tokens([t for text, is_open in main if is_open for t in padded(text.split())]).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blocks, block), pa.array(evidence, hashes), pa.array(opens, hashes)], ["id", "url", "h", "host", "blocks", "evidence", "open"])


def host_of(url: Column) -> Column:
    """The lower-case host of a url; the empty name if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def boilerplate(parsed: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(host, h, covered): for pages with open blocks, the token places in them that start a repeated run of ``RUN`` tokens.

    ``parsed`` has host, h (copies of a page are one page) and the token hashes of evidence and open blocks; hosts without
    open blocks are left out.
    """
    streams = parsed.select("host", "h", "evidence", "open").filter(F.size("evidence") + F.size("open") >= RUN)
    wanted = parsed.filter(F.size("open") > 0).select("host").distinct()
    sizes = streams.select("host", (F.size("evidence") + F.size("open") + 2).alias("n")).groupBy("host").agg(F.sum("n").alias("n"))
    hosts = materialize(sizes.join(wanted, "host", "left_semi").select("host", F.ceil(F.col("n") / shard_tokens).cast("int").alias("shards")), "hosts")
    dealt = streams.join(F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts, "host")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(7)), F.col("shards"))).repartition("host", "shard")
    dealt = dealt.dropDuplicates(["host", "shard", "h"])
    found = dealt.groupBy("host", "shard").applyInArrow(_shard_suffixes, "host string, prefix long, pages long, h long, place int")
    found = materialize(found, "suffixes")
    common = found.filter(F.col("place").isNull()).groupBy("host", "prefix").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    # Written first: the join then has exchanges of its own, which adaptive execution may split where a menu is hot.
    common = materialize(common.select("host", "prefix"), "repeats")
    spots = found.filter(F.col("place").isNotNull()).select("host", "prefix", "h", "place")
    return spots.join(common, ["host", "prefix"]).groupBy("host", "h").agg(F.sort_array(F.collect_set("place")).alias("covered"))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blocks, covered in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            gone = {p + j for p in covered or () for j in range(RUN)}
            kept, at = [], 0
            for block in blocks:
                text = block["text"]
                if block["open"] and gone:
                    tokens = text.split()
                    text = " ".join(t for j, t in enumerate(tokens, at) if j not in gone)
                    at += len(padded(tokens))
                if text:
                    kept.append(text)
            texts.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per row of ``pages``: id, url and ``text``, the main text with its blocks joined by two line feeds.

    Defined cases: a null or empty page, or one of chrome alone, has the empty text; null urls share the empty host; null
    ids stay null; repeated rows get equal texts; markup that is cut off ends where the page does; a very long page is read
    whole, in time proportional to its length; an empty table gives no rows; other columns are not read.
    """
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    text = F.col(html_col).cast("string")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.xxhash64(text).alias("h"), host_of(F.col(url_col).cast("string")).alias("host"), text.alias("t"))
    schema = f"id {kind}, url string, h long, host string, blocks array<struct<text:string,open:boolean>>, evidence array<long>, open array<long>"
    parsed = materialize(base.mapInArrow(_parse, schema), "parsed")
    covered = materialize(boilerplate(parsed, shard_tokens).withColumnsRenamed({"h": "_h", "host": "_host"}), "covered")
    n, places = covered.agg(F.count("*"), F.coalesce(F.sum(F.size("covered")), F.lit(0))).first()
    covered = F.broadcast(covered) if n <= BROADCAST_PAGES and places <= BROADCAST_PLACES else covered
    joined = parsed.join(covered, (F.col("h") == F.col("_h")) & (F.col("host") == F.col("_host")), "left").select("id", "url", "blocks", "covered")
    return joined.mapInArrow(_assemble, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
