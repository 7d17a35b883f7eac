"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks less that of links; the page votes for the generalised tag-class path
of its best container (digits of a class become #). Votes are summed per host and path in Spark. Paths with a tenth of a host's
votes win, and every page is extracted again from its containers on a winning path; a page that has none of them uses its own best.
From there it climbs to the outermost container that adds text: up to the outermost article or main around the path, or to the body
where there is none. So a heading, a lead or a second section beside the largest container stays.

Defined results: a null page is empty, and its text is "". A null URL has the host "". Markup that is cut off or not closed is read
as far as it goes. Repeated rows are treated alike, an empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.common import stash
from copse.llm.texts import batch, map_batches

_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|[!?][^>]*>)""", re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"\s*([^"\s]+)|'\s*([^'\s]+)|([^\s"'>]+))""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg")}
_SPACE = re.compile(r"\s+")

#: Elements whose content is never main text.
NOISE_TAGS = frozenset("nav header footer aside form button select option menu dialog label fieldset input object canvas".split())
#: Words of a class, id or role that mark a part as not the article.
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notices?|alert|newsletter|subscribe|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|replies|reply|disqus|share|sharing|social|related|recommended|"
    r"popup|modal|overlay|login|signup|complementary|contentinfo|search)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
#: Classes that tell of the layout (has-sidebar, no-header), not what the part is.
_LAYOUT = re.compile(r"(?:has|have|with|without|no|hide)[_-]", re.IGNORECASE)

#: Elements that end a block of text where they begin and end.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main body table tr blockquote pre figure figcaption hr address details summary center".split())
CONTAINERS = frozenset("body main article section div td blockquote center".split())
VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
#: An opening tag ends an open element of these kinds.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = BLOCKS - {"body"}


def _label(tag: str, attrs: str) -> str:
    m = _CLASS.search(attrs)
    name = m and (m[1] or m[2] or m[3])
    return tag + ("." + re.sub(r"\d+", "#", name) if name else "")


def _is_noise(tag: str, attrs: str) -> bool:
    if tag in NOISE_TAGS:
        return True
    if tag in ("article", "main", "body", "html") or not attrs:
        return False
    words = (w for m in _NAMES.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").split())
    return any(NOISE_WORDS.search(w) and not _LAYOUT.match(w) for w in words)


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(container path, text, characters of links) of every block of a whole page outside noise, in page order."""
    page = page or ""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, label, noise
    noise = links = 0
    in_link = 0
    buffer: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
        if text:
            out.append((">".join(label for tag, label, _ in stack if tag in CONTAINERS), text, links))
        buffer.clear()
        links = 0

    def pop() -> None:
        nonlocal noise, in_link
        tag, _, bad = stack.pop()
        noise -= bad
        in_link -= tag == "a"

    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not noise:
            buffer.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if not m[1] and tag in _RAW_END:
            stop = None if attrs.endswith("/") else _RAW_END[tag].search(page, at)
            at = stop.end() if stop else (at if attrs.endswith("/") else end)
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th", "img", "option"):
            buffer.append(" ")
        if m[1]:
            if tag in VOID:
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                while len(stack) > depth:
                    pop()
            continue
        if tag in VOID:
            continue
        closes = _CLOSES.get(tag, ("p",) if tag in _ENDS_P else ())
        depth = len(stack)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closes:
                depth = i
            elif stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "dl", "table") and tag in ("li", "dt", "dd", "tr", "td", "th"):
                break
        while len(stack) > depth:
            pop()
        if tag in ("article", "main") and noise:  # an unclosed advert does not swallow the article
            while noise and stack:
                pop()
        if attrs.endswith("/"):
            continue
        bad = _is_noise(tag, attrs)
        stack.append((tag, _label(tag, attrs), bad))
        noise += bad
        in_link += tag == "a"
    flush()
    return out


def scores(found: list[tuple[str, str, int]]) -> dict[str, float]:
    """Score of every container path of a page: its own blocks' text less links, and half of that for the container around it."""
    out: dict[str, float] = {}
    for path, text, links in found:
        worth = max(0.0, len(text) - 2.0 * links) * (1.0 if len(text) >= 25 else 0.3)
        out[path] = out.get(path, 0.0) + worth
        if ">" in path:
            around = path.rpartition(">")[0]
            out[around] = out.get(around, 0.0) + worth / 2
    return out


def best_path(found: list[tuple[str, str, int]]) -> str | None:
    ranked = scores(found)
    return max(ranked, key=lambda p: (ranked[p], p)) if ranked else None


def _under(path: str, outer: str) -> bool:
    return not outer or path == outer or path.startswith(outer + ">")


def _marked(path: str) -> list[str]:
    """The labels of the articles and mains in a path."""
    return [x for x in path.split(">") if x.partition(".")[0] in ("article", "main")]


def _belongs(block: tuple[str, str, int]) -> bool:
    """Whether a block around a winning container is kept: not in an article whose class marks it as noise, and outside of articles not mostly links."""
    path, text, links = block
    marked = _marked(path)
    return not any(NOISE_WORDS.search(x.partition(".")[2]) for x in marked) and (bool(marked) or len(text) > 2 * links)


def whole_path(found: list[tuple[str, str, int]], path: str) -> str:
    """The outermost container around a path that adds text, no further out than the outermost article or main around it; "" is the page."""
    parts = path.split(">") if path else []
    first = next((i for i, x in enumerate(parts) if _marked(x)), -1)
    for k in range(first + 1, len(parts)):
        outer, inner = ">".join(parts[:k]), ">".join(parts[: k + 1])
        if any(_under(b[0], outer) and not _under(b[0], inner) and len(b[1]) > 2 * b[2] and _belongs(b) for b in found):
            return outer
    return path


def extract(page: str | None, winners: list[str]) -> str:
    """The blocks of the page's containers on the winning path that scores best in it and of those around it that add text, joined by newlines."""
    found = blocks(page)
    ranked = scores(found)
    there = [p for p in winners if ranked.get(p, 0) > 0]
    path = max(there, key=lambda p: (ranked[p], p)) if there else best_path(found)
    if path is None:
        return ""
    whole = whole_path(found, path)
    return "\n".join(b[1] for b in found if _under(b[0], path) or _under(b[0], whole) and _belongs(b))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(["host", "path"], b.column(0), pa.array([best_path(blocks(h)) for h in b.column(1).to_pylist()], pa.string()))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h, w or []) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield batch(["page_id", "url", "text", "n_chars"], b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", share: float = 0.1) -> DataFrame:
    """host, winners: the paths with at least this share of the host's votes, so at most 1/share of them."""
    votes = map_batches(pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html")), _vote, "host string, path string")
    votes = stash(votes.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")), "votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(total, "host").where(F.col("votes") >= F.lit(share) * F.col("total"))
    return won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("winners"))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small_hosts: int = 100_000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. The winners are broadcast up to small_hosts hosts; beyond that, pages are joined by host."""
    winners = stash(winning_paths(pages, url_col=url_col, html_col=html_col), "winners")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    side = F.broadcast(winners) if winners.count() <= small_hosts else winners
    return map_batches(rows.join(side, "host", "left").select("page_id", "url", "html", "winners"), _extract, "page_id long, url string, text string, n_chars long")
