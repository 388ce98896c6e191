"""Operator 9: main text of HTML pages, with host-wide repeats found in a suffix array."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import in_parts, materialize, partitions

# Element names of HTML and the words that sites use for what isn't the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe input label menu nav noembed noframes noscript object option output "
    "progress script search select style svg template textarea title video xmp".split()
)
MAIN = frozenset(("article", "main"))
#: An element ends where one of these opens inside the given containers.
IMPLIED_END = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts alert alerts advertisement advertising advertisements banner banners breadcrumb breadcrumbs byline-share comment comments "
    "commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "overlay pager paging pagination popup promo promos promoted promotion recommended related reply replies respond share sharing sidebar sidebars signup "
    "side-bar skip social sponsor sponsored sponsors subscribe subscription teaser toolbar tracking widget widgets".split()
)
#: Classes, ids and roles that make any element the page's main part.
MAIN_NAMES = frozenset("article article-body article-content articlebody entry-content main main-content maincontent post-content story-body".split())
MAIN_IDS = frozenset("content".split())
#: Words that also name parts of an article when they stand inside one.
OUTSIDE_ONLY = frozenset("header topbar".split())

#: Words that also name an article's own parts: inside one they count alone or beside words for parts of a page.
AMBIGUOUS = frozenset(
    "ad ads alert alerts disclaimer menu menus notice notices overlay related reply replies respond share sharing skip social teaser tracking widget widgets".split()
)
PARTS = frozenset(
    "area articles bar block bottom box btn button buttons column container content group icon icons inline inner item items label links list outer panel "
    "posts row section slot space stories top unit wrap wrapper".split()
)
#: Inside an article these words rule an element out by themselves; other single words make its blocks suspect.
STRONG = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising advertisements breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus gdpr nav navbar navigation newsletter pager paging pagination share sharing sidebar sidebars side-bar sponsored".split()
)
#: Elements open at once; deeper ones are read as if their tags were not there, as browsers do.
DEPTH = 512

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_VALUE = re.compile(r"[=>]")
_SPACE = re.compile(r"\s*")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Tags:
    """Tags, comments and declarations of a page from front to back, in time that grows with the page, whatever is left open."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name ("" for what isn't an element), whether it closes, attributes of the next one from ``at`` on."""
        html, size = self.html, len(self.html)
        while (start := html.find("<", at)) >= 0:
            for opened, closed in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(opened, start):
                    end = html.find(closed, start + len(opened))
                    return start, end + 3 if end >= 0 else size, "", False, ""
            if start > self.last:  # nothing ends any more, but what is commented out goes
                rest = [k for k in (html.find("<!--", start), html.find("<![CDATA[", start)) if k >= 0]
                return (min(rest), size, "", False, "") if rest else None
            name = _NAME.match(html, start)
            if name:
                end = self._end(name.end()) + 1
                return start, end, name[1], html[start + 1] == "/", html[name.end() : end - 1]
            if html[start + 1 : start + 2] in ("!", "?"):
                return start, html.find(">", start) + 1, "", False, ""
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Place of the tag's ``>``: the first outside quoted values. On a page where a quote isn't closed quotes no longer count from there on."""
        html, i = self.html, at
        while self.quotes:
            found = _VALUE.search(html, i)
            if not found:
                self.quotes = False
            elif found[0] == ">":
                return found.start()
            else:
                i = _SPACE.match(html, found.end()).end()
                if html[i : i + 1] in ("'", '"'):
                    closed = html.find(html[i], i + 1)
                    if closed < 0:
                        self.quotes = False
                    i = closed + 1
        return html.find(">", at)


def decoded(text: str) -> str:
    """Character references decoded; those beyond all characters are U+FFFD, however many digits they have."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return unescape(text)


KEPT, SUSPECT, OUT = 0, 1, 2


def _judged(name: str, attrs: str, inside_main: bool) -> int:
    """Whether an element holds a part of the article, by its name and attributes: kept, suspect or out.

    Inside an article no single word of a class rules an element out, unless it can mean nothing else (:data:`STRONG`, standing alone or with
    words for parts of a page): a table may be called comparison-banner and a lead teaser. Its blocks are suspect then.
    """
    if name in NEVER or (name == "header" and not inside_main):
        return OUT
    if not attrs or name in ("html", "body", "main"):
        return KEPT
    suspect = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return OUT
        if key == "role" and value in ROLES:
            return OUT
        if key in ("class", "id"):
            clutter = 0
            for own in value.split():
                words = set(re.split(r"[_-]+", own)) - {""}
                if not inside_main and (own in WORDS or words & (WORDS | OUTSIDE_ONLY)):
                    return OUT
                if not inside_main or not (own in WORDS or words & WORDS):
                    continue
                only = all(w in WORDS or w in PARTS or w.isdigit() for w in words)
                clutter += only
                if own in STRONG or (only and (len(words) > 1 or words & STRONG)) or clutter > 1:
                    return OUT
                suspect |= only or bool(words & (WORDS - AMBIGUOUS))
    return SUSPECT if suspect else KEPT


def _is_main(name: str, attrs: str) -> bool:
    """Whether an element holds the article: article and main elements, and others that say so."""
    if name in MAIN:
        return True
    if name in ("html", "body") or not attrs:
        return False
    for key, value in _ATTR.findall(attrs):
        key, names = key.lower(), set(value.strip("\"'").lower().split())
        if (key in ("class", "id", "role") and names & MAIN_NAMES) or (key == "id" and names & MAIN_IDS):
            return True
    return False


def page_blocks(html: str) -> tuple[list[str], list[str]]:
    """Blocks of the page's article or main element, and the other blocks that no element rules out; in page order."""
    main, _, free = page_parts(html)
    return main, free


def page_parts(html: str) -> tuple[list[str], list[bool], list[str]]:
    """Blocks of the page's main part, which of them are suspect, and the free blocks outside all main parts.

    Of several main parts beside each other the one with most text is the page's; the others are neither. A suspect element is out if
    half of its text or more is links.
    """
    parts: list[list[tuple[str, int]]] = []
    free: list[str] = []
    piece: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, ruled out, inside an article, number of the suspect element
    opened: Counter[str] = Counter()  # how many of the stack have a name
    texts, links = [0], [0]  # characters by suspect element
    out = inside = False
    suspect = 0
    tags = Tags(html)

    def add(text: str) -> None:
        piece.append(text)
        if suspect:
            size = len(text.strip())
            texts[suspect] += size
            links[suspect] += size if opened["a"] else 0

    def flush() -> None:
        if piece:
            text = " ".join(decoded("".join(piece)).split())
            if text and inside:
                parts[-1].append((text, suspect))
            elif text:
                free.append(text)
            piece.clear()

    def close_to(at: int) -> None:
        nonlocal out, inside, suspect
        state = stack[at - 1][1:] if at else (False, False, 0)
        if state[1] != inside or any(x[0] in BLOCKS for x in stack[at:]):
            flush()
        opened.subtract(x[0] for x in stack[at:])
        del stack[at:]
        out, inside, suspect = state

    at, size = 0, len(html)
    while at < size:
        tag = tags.after(at)
        if not tag:
            if not out:
                add(html[at:])
            break
        start, end, name, closes, attrs = tag
        if not out and start > at:
            add(html[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if closes:
            if name in BLOCKS:
                flush()
            if opened[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close_to(k)
                        break
                    if stack[k][0] in ("table", "td") and name in ("b", "i", "a", "span", "p"):
                        break
            continue
        if name in RAW and not attrs.endswith("/"):
            found = _RAW_END[name].search(html, at)
            closed = html.find(">", found.end()) if found else -1
            at = closed + 1 if closed >= 0 else size
            if not out:
                piece.append(" ")
            continue
        if name in BLOCKS:
            for k in range(len(stack) - 1, -1, -1) if opened["p"] else ():  # an open paragraph ends
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            flush()
        elif name in ("br", "td", "th", "img") and not out:
            piece.append(" ")
        if name in IMPLIED_END:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name or (name in ("dd", "dt") and stack[k][0] in ("dd", "dt")):
                    close_to(k)
                    break
                if stack[k][0] in IMPLIED_END[name]:
                    break
        if name in VOID or attrs.endswith("/"):
            continue
        judged = OUT if out else _judged(name, attrs, inside)
        gone = judged == OUT
        within = inside or (not gone and _is_main(name, attrs))
        if within != inside:
            flush()
            parts.append([])
        number = suspect
        if judged == SUSPECT and not suspect and name in BLOCKS:
            texts.append(0)
            links.append(0)
            number = len(texts) - 1
        if len(stack) >= DEPTH and (gone, within) == (out, inside):
            continue
        stack.append((name, gone, within, number))
        opened[name] += 1
        out, inside, suspect = gone, within, number
    flush()
    kept = [[(text, n) for text, n in part if not n or 2 * links[n] < texts[n]] for part in parts]
    best = max(kept, key=lambda part: sum(len(text) for text, _ in part), default=[])
    return [text for text, _ in best], [n > 0 for _, n in best], free


def suffixes(tokens: list[str], length: int) -> list[str]:
    """The suffixes of a token stream that have ``length`` tokens, cut there."""
    return ["\x00".join(tokens[i : i + length]) for i in range(len(tokens) - length + 1)]


def block_suffixes(block: list[str], length: int) -> list[str]:
    """The suffixes of one block; one that is shorter than they are is a suffix by itself."""
    return suffixes(block, length) if len(block) >= length else ["\x00".join([*block, "\x01"])]


def repeated_suffixes(ordered: Iterator[tuple[str, str, int, int, int]], pages: int) -> Iterator[tuple[int, int]]:
    """(row, place) of suffixes (host, suffix, page, row, place) in order whose neighbours with a whole common prefix come from at least ``pages`` pages."""
    now, waiting, seen, last = None, [], 0, None
    for host, suffix, page, row, place in ordered:
        if now != (host, suffix):
            now, waiting, seen, last = (host, suffix), [], 0, None
        seen, last = seen + (page != last), page  # pages are in order too
        if seen < pages:
            waiting.append((row, place))
            continue
        yield from waiting
        waiting = []
        yield row, place


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", repeat_tokens: int = 8, repeat_pages: int = 3
) -> DataFrame:
    """Main text of every page from its whole HTML.

    Markup gives blocks: those of the main part (article and main elements; of several the one with most text), and other
    blocks outside menus, headers, footers, sidebars, forms, adverts, notices and comments. What markup can't settle is judged by the
    host: blocks of an article that one word of a class makes suspect, and all blocks of pages without a main part. The suffixes
    of these token streams are sorted by host, cut at the least length that matters (``repeat_tokens`` tokens: a longer
    common prefix is covered by the suffixes that start inside it; a suspect block that is shorter counts whole), in
    ranges over the cluster, so a host may hold any share of the pages. Neighbours with that common prefix from at least
    ``repeat_pages`` distinct pages are boilerplate; the tokens they cover are removed and the unique runs stay. Pages whose articles are
    equal but for suspect blocks count as one there: copies of an article are content. Other blocks of an article all stay, also those
    it shares with other pages. If nothing is left the blocks stay whole.

    Returns ``id_col``, ``url_col``, text (blocks joined by line feeds) and n_chars. Defined cases:
    null or empty HTML gives empty text; a null URL belongs to the host ""; repeated rows give
    repeated results but count as pages of their own; an empty table gives an empty result; further
    columns are ignored.
    """
    types = {c: pages.select(c).schema[0].dataType.simpleString() for c in (id_col, url_col)}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = [page_parts(h) if h else ([], [], []) for h in batch.column(2).to_pylist()]
            hosts = [host_of(u) for u in batch.column(1).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(hosts, pa.string()),
                    pa.array([bool(m) for m, _, _ in found], pa.bool_()),
                    pa.array([m or f for m, _, f in found], pa.list_(pa.string())),
                    pa.array([s if m else [True] * len(f) for m, s, f in found], pa.list_(pa.bool_())),
                ],
                names=["_id", "_url", "_host", "_article", "_blocks", "_judged"],
            )

    parsed = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html")).mapInArrow(
        parse, f"_id {types[id_col]}, _url {types[url_col]}, _host string, _article boolean, _blocks array<string>, _judged array<boolean>"
    )
    parsed = materialize(parsed.withColumn("_row", F.monotonically_increasing_id()), "pages")
    # what the pages of an article have in common beside suspect blocks makes them one
    sure = F.expr("filter(_blocks, (b, i) -> not _judged[i])")
    open_rows = parsed.where("exists(_judged, j -> j)")
    loose = open_rows.select("_row", "_host", "_article", "_blocks", "_judged", F.when(F.col("_article"), F.xxhash64(sure)).otherwise(F.col("_row")).alias("_page"))

    def streams(blocks: list[str], judged: list[bool], article: bool) -> list[list[str]]:
        split = [b.split() for b, j in zip(blocks, judged, strict=True) if j]
        return split if article else [[t for b in split for t in b]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, host, article, blocks, judged, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, at, place = [], [], 0
                for stream in streams(blocks, judged, article):
                    own = block_suffixes(stream, repeat_tokens) if article else suffixes(stream, repeat_tokens)
                    found += own
                    at += range(place, place + len(own))
                    place += len(stream)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * n, pa.string()), pa.array(found, pa.string()), pa.array([page] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(at, pa.int32())],
                    names=["_host", "_suffix", "_page", "_row", "_at"],
                )

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = repeated_suffixes(rows, repeat_pages)
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int64()), pa.array([a for _, a in some], pa.int32())], names=["_row", "_at"])

    order = ["_host", "_suffix", "_page", "_row", "_at"]
    array = loose.mapInArrow(spread, "_host string, _suffix string, _page long, _row long, _at int").repartitionByRange(partitions(pages.sparkSession), "_host", "_suffix")
    covered = array.sortWithinPartitions(*order).mapInArrow(common, "_row long, _at int").groupBy("_row").agg(F.collect_set("_at").alias("_covered"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for article, blocks, judged, at in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
                sizes = [len(stream) for stream in streams(blocks, judged, article)]
                ends = np.repeat(np.cumsum(sizes), sizes)  # of each token's stream
                gone = np.zeros(sum(sizes) + 1, np.int64)
                for a in at or ():
                    gone[a] += 1
                    gone[min(a + repeat_tokens, ends[a])] -= 1
                kept, place = [], 0
                left = np.cumsum(gone)[:-1] == 0
                for block, open_one in zip(blocks, judged, strict=True):
                    own = words = block.split()
                    if open_one:
                        own = [w for w, k in zip(words, left[place : place + len(words)], strict=True) if k]
                        place += len(words)
                    if own:
                        kept.append(" ".join(own))
                rows.append(kept or blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=["_row", "_blocks"])

    unique = loose.select("_row", "_article", "_blocks", "_judged").join(covered, "_row", "left").mapInArrow(strip, "_row long, _blocks array<string>")
    own = parsed.where("not exists(_judged, j -> j)").select("_id", "_url", "_blocks")
    rest = open_rows.select("_row", "_id", "_url").join(unique, "_row").select("_id", "_url", "_blocks")
    text = F.array_join("_blocks", "\n")
    return own.unionAll(rest).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
