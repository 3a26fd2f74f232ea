"""Main text of web pages: blocks of the markup, and a suffix array over each host's pages.

A pass over the pages cuts the markup into blocks, decodes character references and leaves out
what the markup itself names as no part of the article (menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments). The token streams of a host's
pages are then concatenated, each with an end mark of its own, and all their suffixes are sorted in full, with
the common prefix of each two neighbours. Neighbours that share ``MIN_TOKENS`` tokens or more are
repeated substrings; those that occur on several distinct pages are boilerplate: the places
they cover are removed, unique runs stay.

What is boilerplate depends on the page alone and on how many distinct pages share it: on pages without a
marked article, whatever ``MIN_PAGES`` pages share (unless that is the whole page: then it is no boilerplate);
inside a marked article, which may quote or be syndicated, only what ``MARKED_PAGES`` pages and
``MARKED_SHARE`` of the host's pages share.

No task may hold a host with very many pages: its distinct streams are dealt into groups of about ``GROUP_PAGES``, each with
a suffix array of its own, and Spark sums what the groups find. Of each repeated substring's first ``MIN_TOKENS`` tokens a
group gives a fingerprint and the number of its streams that have them: of all, if the host has pages without a marked
article; else of those alone that the needed share of some group's streams has (what so large a share of all has, so large a
share of some group has), which all groups then count. The sums go back to the groups, and cover their pages. Hosts none of whose groups has such a substring, nor a page without a marked
article, are found first, and need no sums. How a host is dealt changes no result.
Pages with the same stream count as one. White space inside a block is one space, blocks are joined by
one space. Null or empty html gives an empty text; a null url is a host of its own. Rows that repeat
an identifier or a page are treated each; very long pages are taken whole; an empty table gives an
empty result; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, mix64, small_batches, texts_of

MIN_TOKENS = 8
MIN_PAGES = 3
MARKED_PAGES, MARKED_SHARE = 4, 0.5
#: Distinct streams, and bytes of them, that one task holds, about; hosts with more are dealt.
GROUP_PAGES, GROUP_BYTES = 400, 16_000_000
#: Large hosts, 16 bytes each, are broadcast up to so many; more are joined by a shuffle.
BROADCAST_HOSTS = 500_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
# fixed values: element names of the markup language and common names of page parts
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea xmp iframe noembed noframes".split())
_SKIP = set("nav footer aside form script style noscript button select template svg iframe object dialog menu head title textarea canvas audio video map math datalist".split())
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_PARTS = set(
    "ad ads advert adverts advertisement adsense banner promo sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent notice notices comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login "
    "popup modal widget pagination pager toolbar copyright legal disclaimer complementary contentinfo search alert".split()
)
_MAIN = set("articlebody".split())
_ATTR = re.compile(r"""\b(class|id|role|itemprop|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?<![\w-])(hidden)(?![\w-])""", re.I)
_NAMES = re.compile(r"[a-z0-9]+")


def _kind(tag: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is left out, and how surely it marks the article (0: not)."""
    rank = {"article": 3, "main": 2}.get(tag, 0)
    skip = tag in _SKIP or tag == "header" and not inside
    if attrs and not attrs.isspace():
        for name, value, hidden in _ATTR.findall(attrs):
            if hidden:
                skip = skip or tag not in ("html", "body")
                continue
            value = value.strip("\"'").lower()
            if name.lower() == "style":
                skip = skip or "display:none" in value.replace(" ", "")
                continue
            names = set(_NAMES.findall(value))
            if name.lower() == "role" and value == "main":
                rank = max(rank, 2)
            if name.lower() == "itemprop" and names & _MAIN:
                rank = max(rank, 3)
            if tag not in ("html", "body", "article", "main") and (names & _PARTS or not inside and "header" in names):
                skip = True
    return skip, rank


def blocks(page: str) -> tuple[bool, list[str]]:
    """Whether the page marks its article; and its blocks of text, in order, without the parts that the markup sets apart."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    skipped = rank = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((rank, text))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not skipped:
            piece = page[at : m.start() if m else n]
            if piece:
                parts.append(html_lib.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush() if tag != "br" else parts.append(" ")
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][2] != rank:
                        flush()
                    skipped -= sum(s for _, s, _ in stack[k:])
                    rank = stack[k][2]
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            continue
        attrs = m[3] if m[2] else m[6]
        skip, own = _kind(tag, attrs, rank > 0)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends where the next begins
            skipped -= stack[-1][1]
            stack.pop()
        if own > rank or skip:
            flush()
        stack.append((tag, skip, rank))
        skipped += skip
        rank = max(rank, own)
    flush()
    best = max((r for r, _ in out), default=0)
    return best > 0, [t for r, t in out if r == best]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the length of the common prefix of each with the one before it (0 for the first)."""
    n, length = len(tokens), 1
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while levels[-1].max(initial=0) < n - 1:  # ranks by the first 1, 2, 4, ... tokens, until they all differ
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        length *= 2
    order = np.argsort(levels[-1])
    left, right, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[k], -1)
        inside = (left + (1 << k) <= n) & (right + (1 << k) <= n)
        same = inside & (rank[np.minimum(left, n)] == rank[np.minimum(right, n)])
        step = np.where(same, 1 << k, 0)
        left, right, lcp = left + step, right + step, lcp + step
    return order, np.append(0, lcp)[:n]


def arrayed(streams: list[list[str]], min_tokens: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct streams one after the other, each with an end mark: the words by number, all tokens (end marks below 0), and for each
    token the class of suffixes that begin with the same ``min_tokens``, the number of streams in each class, and where each stream ends."""
    words: dict[str, int] = {}
    flat, page = [], []
    for p, s in enumerate(streams):
        flat += [words.setdefault(w, len(words)) for w in s]
        flat.append(-1 - p)
        page += [p] * (len(s) + 1)
    tokens, page = np.array(flat, np.int64), np.array(page, np.int64)
    order, lcp = suffix_array(tokens)
    run = np.cumsum(lcp < min_tokens)  # suffixes that begin with the same tokens
    pairs = np.unique(run * len(streams) + page[order])
    counts = np.bincount(pairs // len(streams), minlength=int(run.max(initial=0)) + 1)
    of = np.zeros(len(tokens), np.int64)
    of[order] = run
    return list(words), tokens, of, counts, np.cumsum([len(s) + 1 for s in streams])


def covering(begin: np.ndarray, min_tokens: int) -> np.ndarray:
    """For each token the most that any substring of ``min_tokens`` over it has."""
    cover = begin.copy()
    for k in range(1, min_tokens):
        np.maximum(cover[k:], begin[:-k], out=cover[k:])
    return cover


def shared_pages(streams: list[list[str]], min_tokens: int = MIN_TOKENS) -> list[np.ndarray]:
    """For each token of each stream: how many distinct streams have a substring of ``min_tokens`` that covers it (1: no other has)."""
    number: dict = {}
    stream_id = [number.setdefault(tuple(s), len(number)) for s in streams]
    distinct = list(number)
    _, _, of, counts, ends = arrayed(distinct, min_tokens)
    # an end mark is unlike all others, so what begins too near to it is on one page only
    cover = covering(counts[of], min_tokens)
    return [cover[ends[k] - len(distinct[k]) - 1 : ends[k] - 1] for k in stream_id]


def fingerprints(words: list[str], tokens: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token a fingerprint of the ``min_tokens`` from it on, and whether these end within its stream."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    own = np.where(tokens >= 0, np.append(h, np.uint64(0))[np.maximum(tokens, 0)], np.uint64(0))
    n = max(0, len(tokens) - min_tokens + 1)
    out, whole = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), bool)
    whole[:n] = True
    for k in range(min_tokens):
        out[:n] = out[:n] * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
        whole[:n] &= tokens[k : k + n] >= 0
    return mix64(out, 37).view(np.int64), whole


def found_in(streams: list[list[str]], least: float, min_tokens: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of what begins the repeated substrings of distinct streams, and how many streams have each, if as many as ``least``."""
    words, tokens, of, counts, _ = arrayed(streams, min_tokens)
    prints, whole = fingerprints(words, tokens, min_tokens)
    at = np.flatnonzero(whole & (counts[of] >= least))
    at = at[np.unique(of[at], return_index=True)[1]]
    return prints[at], counts[of[at]]


def covered_by(streams: list[list[str]], prints: np.ndarray, totals: np.ndarray, min_tokens: int = MIN_TOKENS) -> list[np.ndarray]:
    """``shared_pages`` of distinct streams by the numbers that fingerprints have in all of a host."""
    order = np.argsort(prints)
    prints, totals = prints[order], totals[order]
    out = []
    for s in streams:
        words: dict[str, int] = {}
        tokens = np.array([words.setdefault(w, len(words)) for w in s], np.int64)
        own, whole = fingerprints(list(words), tokens, min_tokens)
        begin = np.ones(len(s), np.int64)
        if len(prints):
            at = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
            begin = np.where(whole & (prints[at] == own), totals[at], 1)
        out.append(covering(begin, min_tokens))
    return out


def hidden(shared: np.ndarray, marked: bool, pages: int) -> np.ndarray:
    """Which tokens of a page are boilerplate, by how many of the host's distinct pages share them."""
    if marked:
        return shared >= max(MARKED_PAGES, MARKED_SHARE * pages)
    covered = shared >= MIN_PAGES
    return covered & ~covered.all()


def boilerplate(streams: list[list[str]], marked: list[bool]) -> list[np.ndarray]:
    """For each page, which of its tokens are covered by substrings that enough distinct pages share."""
    pages = len(set(map(tuple, streams)))
    return [hidden(shared, own, pages) for shared, own in zip(shared_pages(streams), marked, strict=True)]


def unique_runs(page_blocks: list[str], covered: np.ndarray) -> str:
    if not covered.any():
        return " ".join(page_blocks)
    words = " ".join(page_blocks).split(" ")
    return " ".join(w for w, c in zip(words, covered, strict=True) if not c)


def split_blocks(column) -> list[list[str]]:
    return [b.split("\n") if b else [] for b in column.to_pylist()]


def streams_of(own: list[list[str]]) -> list[list[str]]:
    return [" ".join(b).split(" ") if b else [] for b in own]


def open_hosts(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Of large hosts (host, groups), those that have a page without a marked article, or a group so large a share of whose streams share a substring that all of the host might."""

    def once(batches):
        """Streams, each once for a host and task as a rule: copies aren't moved."""
        seen: set[bytes] = set()
        for batch in batches:
            hosts, marked, texts = (batch.column(k).to_pylist() for k in range(3))
            keep, keys = [], []
            for i, (h, m, t) in enumerate(zip(hosts, marked, texts, strict=True)):
                key = xxhash.xxh3_128_digest(f"{h}\0{m}\0{t}")
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
                    keys.append(xxhash.xxh3_64_intdigest(t) >> 1)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in batch.columns), pa.array(keys, pa.int64())], names=["host", "marked", "stream", "key"])

    streams = rows.select("host", "marked", F.translate("blocks", "\n", " ").alias("stream")).mapInArrow(once, "host string, marked boolean, stream string, key long")
    dealt = streams.join(F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large, "host").select("host", F.pmod("key", "groups").alias("salt"), "marked", "stream")

    def shares(key, table):
        is_open = not all(table.column("marked").to_pylist())
        if not is_open:
            own = streams_of(split_blocks(pa.array(set(table.column("stream").to_pylist()), pa.string())))
            is_open = len(found_in(own, MARKED_SHARE * len(own))[0]) > 0
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "open": pa.array([is_open])})

    found = materialize(dealt.groupBy("host", "salt").applyInArrow(shares, "host string, open boolean"), "html-open")
    return found.where("open").select("host").distinct()


def large_hosts(rows: DataFrame, group_pages: int) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, host, marked, blocks) of hosts that no task may hold."""
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.withColumn("blocks", F.translate("blocks", "\n", " "))  # texts and runs depend on the stream alone
    rows = materialize(rows.withColumn("key", F.sha2("blocks", 256)), "html-streams")
    hosts = rows.groupBy("host").agg(F.max(~F.col("marked")).alias("loose"))
    distinct = materialize(rows.groupBy("host", "key").agg(F.min("blocks").alias("blocks")), "html-distinct")
    deal = distinct.groupBy("host").agg(F.count("*").alias("pages"), F.greatest(F.ceil(F.count("*") / group_pages), F.ceil(F.sum(F.octet_length("blocks")) / GROUP_BYTES)).alias("groups"))
    hosts = materialize(hosts.join(deal, "host"), "html-hosts")  # a row for each large host
    sent = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    salt = F.pmod(F.xxhash64("key"), F.col("groups"))
    dealt = distinct.join(sent, "host").select("host", salt.alias("salt"), "key", "blocks", "loose", "pages")
    group, found = ["host", "salt"], "host string, salt long, print long, n long"

    def result(key, prints, n) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()] * len(prints), pa.string()), "salt": pa.array([key[1].as_py()] * len(prints), pa.int64()), "print": pa.array(prints, pa.int64()), "n": pa.array(n, pa.int64())})

    def first(key, table):
        streams = streams_of(split_blocks(table.column("blocks")))
        least = 1 if table.column("loose")[0].as_py() else MARKED_SHARE * len(streams)
        return result(key, *found_in(streams, least))

    def again(key, table, wanted):
        if not table.num_rows or not wanted.num_rows:
            return result(key, [], [])
        prints, n = found_in(streams_of(split_blocks(table.column("blocks"))), 1)
        keep = np.isin(prints, wanted.column("print").to_numpy())
        return result(key, prints[keep], n[keep])

    seen = materialize(dealt.groupBy(*group).applyInArrow(first, found), "html-found")
    strict = hosts.where("not loose").select("host", "groups")
    wanted = seen.join(strict, "host").groupBy("host", "print").agg(F.max("groups").alias("groups"))
    wanted = wanted.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), "print")
    counted = dealt.where("not loose").groupBy(*group).cogroup(wanted.groupBy(*group)).applyInArrow(again, found)
    each = materialize(seen.join(hosts.where("loose").select("host"), "host", "left_semi").unionByName(counted), "html-found")
    enough = each.groupBy("host", "print").agg(F.sum("n").alias("total")).join(sent, "host")
    enough = enough.where(F.col("total") >= F.when(F.col("loose"), MIN_PAGES).otherwise(F.greatest(F.lit(MARKED_PAGES), MARKED_SHARE * F.col("pages"))))
    totals = each.join(enough.select("host", "print", "total"), ["host", "print"]).select("host", "salt", "print", "total")

    def clean(key, table, sums):
        own = split_blocks(table.column("blocks"))
        shared = covered_by(streams_of(own), sums.column("print").to_numpy(), sums.column("total").to_numpy())
        pages = table.column("pages").to_pylist()
        texts = [[unique_runs(b, hidden(c, marked, n)) if b else "" for b, c, n in zip(own, shared, pages, strict=True)] for marked in (True, False)]
        return pa.table({"host": table.column("host"), "key": table.column("key"), "if_marked": pa.array(texts[0], pa.string()), "if_not": pa.array(texts[1], pa.string())})

    texts = dealt.groupBy(*group).cogroup(totals.groupBy(*group)).applyInArrow(clean, "host string, key string, if_marked string, if_not string")
    text = F.when(F.col("marked"), F.col("if_marked")).otherwise(F.col("if_not"))
    # pages with one stream may be very many: Spark splits their side of this join
    out = rows.select("page_id", "url", "host", "key", "marked").join(materialize(texts, "html-texts"), ["host", "key"]).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
    for table in (seen, each, distinct, hosts):
        drop_table(table)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", "n_chars")


def extract(pages: DataFrame, repeats: bool = True, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row; without ``repeats``, by the markup alone."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for a, b in small_batches(batch.column(2)):
                found = [blocks(h) for h in texts_of(batch.column(2), a, b)]
                cols = [pa.array([m for m, _ in found], pa.bool_()), pa.array(["\n".join(t) for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1, 3)), *cols], names=["page_id", "url", "host", "marked", "blocks"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    parsed = lambda some: some.mapInArrow(cut, f"page_id {kind}, url string, host string, marked boolean, blocks string")
    if not repeats:
        text = F.translate("blocks", "\n", " ")
        return parsed(pages).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))

    def clean(group: pa.Table) -> pa.Table:
        own = split_blocks(group.column("blocks"))
        masks = boilerplate(streams_of(own), group.column("marked").to_pylist())
        text = [unique_runs(b, m) if b else "" for b, m in zip(own, masks, strict=True)]
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())})

    groups = F.greatest(F.ceil(F.col("n") / group_pages), F.ceil(F.col("bytes") / GROUP_BYTES))
    sizes = pages.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")).select("host", groups.alias("groups"))
    large = materialize(sizes.where("groups > 1"), "html-large")
    sent = lambda hosts: F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    of = lambda hosts, how: pages.join(sent(hosts.select("host")), "host", how).select("page_id", "url", "html", "host")
    many = large.limit(1).count()
    small = parsed(of(large, "left_anti") if many else pages)
    out = small.groupBy("host").applyInArrow(clean, f"page_id {kind}, url string, text string, n_chars long")
    if many:
        opened = open_hosts(parsed(of(large, "left_semi")), large)
        closed = parsed(of(large.join(sent(opened), "host", "left_anti"), "left_semi"))
        text = F.translate("blocks", "\n", " ")
        out = out.unionByName(closed.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars")))
        if opened.limit(1).count():
            out = out.unionByName(large_hosts(parsed(of(opened, "left_semi")), group_pages))
    return out
