"""Main text of web pages: markup first, then nearest-URL page differencing.

A page's text lines are its blocks.  Markup that says what it holds decides first: lines in menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like go; in a page with an article element its lines stay, and what
stands outside goes.  What a page without such an element shows is open, and is decided by differencing: all pages
of a host, with all their lines, are sorted by URL path, each is paired with the nearest one that differs, the lines
of both are aligned by a longest common subsequence, and the open lines that are shared are deleted.  Pages with an
article element are aligned like the others; that their lines are shared is told, but does not delete them.

Only hashes of lines take part in that, not texts: a range sort of (host, path) numbers the pages, so that a host
may hold any share of all pages, and a run of pages with the same lines counts as one page.
"""

from __future__ import annotations

import functools
import hashlib
import html
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.llm.shared import part_offsets, range_numbered, sent_whole, stored
from sequent.llm.urlfilter import host_of, path_of

# Elements by what HTML says of them.
RAW = ("script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video", "select")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
#: Elements that never hold main text, and roles that say the same.
CHROME = ("aside", "button", "dialog", "fieldset", "footer", "form", "head", "menu", "nav")
CHROME_ROLES = ("alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar")
#: Words of class and id names that say that an element holds no main text.
CHROME_NAMES = (
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "nav",
    "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "respond", "share", "sharing", "sidebar", "sidenav", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar",
)
#: Elements that an opening tag of the same group closes, up to the nearest of the elements named after them.
CLOSED_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Class names that begin so say what the rest of the page has or has not.
OTHERWISE = re.compile(r"(?:no|not|has|with|without|is|js)[-_]", re.I)


@functools.lru_cache(1 << 12)
def marks_of(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """(holds no main text, is an article) of an element; inside: it stands in an article or main element."""
    found: dict[str, str] = {}
    for key, *values in NAMES.findall(rest) if rest else ():
        found.setdefault(key.lower(), "".join(values))
    role = found.get("role", "").lower()
    article = name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    chrome = name in CHROME or role in CHROME_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    chrome |= name == "header" and not inside
    if name in BLOCKS and not chrome:  # of an inline element the names tell little
        names = " ".join(x for x in f"{found.get('class', '')} {found.get('id', '')}".split() if not OTHERWISE.match(x))
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))
        chrome = not words.isdisjoint(CHROME_NAMES) or (not inside and "header" in words)
    return chrome and name not in ("html", "body", "main"), article


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """(lines in page order, whether they are open) of a page: those of its article, or else all that markup lets stand."""
    return chosen(placed_lines(page))


def chosen(placed: list[tuple[str, int]]) -> tuple[list[str], bool]:
    best = max((place for _, place in placed if place >= 0), default=0)
    return [line for line, place in placed if place == best], best == 0


def placed_lines(page: str | None) -> list[tuple[str, int]]:
    """(line, place) of all lines of a page in its order: 2 in an article, 1 in a main element, 0 elsewhere, -1 where markup says that it is no main text."""
    page = page or ""
    kept: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, holds no main text, place as above
    words: list[str] = []
    others: list[str] = []  # words of the same block that are no main text

    def flush() -> None:
        for some, place in ((words, stack[-1][2] if stack else 0), (others, -1)):
            if some:
                line = " ".join("".join(some).split())
                some.clear()
                if line:
                    kept.append((line, place))

    def closed(names: tuple[str, ...], at: tuple[str, ...] | None) -> None:
        """Closes the innermost element of the names, unless one of `at` (None: any block but p) stands within."""
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k][0]
            if name in names:
                del stack[k:]
                return
            if name in at if at is not None else name in BLOCKS and name != "p":
                return

    def said(text: str) -> None:
        (others if stack and stack[-1][1] else words).append(html.unescape(text) if "&" in text else text)

    at = 0
    while token := TOKEN.search(page, at):
        if token.start() > at:
            said(page[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        if token["close"] or token["close2"]:
            if name in BLOCKS:
                flush()
                closed((name,), ("td", "th", "table") if name not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html", "article", "main") else ())
            else:
                closed((name,), None)
            continue
        rest = token["rest"] if token["name"] else token["rest2"]
        if name in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                said(" ")
            continue
        if name in BLOCKS:
            flush()
            closed(("p",), None)
            if name in CLOSED_BY:
                closed(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,), CLOSED_BY[name])
        _, hidden, place = stack[-1] if stack else ("", False, 0)
        chrome, article = marks_of(name, rest, place > 0)
        if name == "main" and not any(x in CHROME for x, *_ in stack):
            hidden = False  # a wrapper's name says nothing of the page's main element
        if article and not hidden and not chrome:
            place = max(place, 1 if name == "main" else 2)
        stack.append((name, hidden or chrome, place))
    said(page[at:])
    flush()
    return kept


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def rows_of_lcs(a: list[int], b: list[int], keep: bool) -> tuple[np.ndarray, list[int]]:
    """Length of the longest common subsequence of a and each beginning of b; with keep, also the bit rows after each item of a.

    A row has a zero bit at each place of b where the length grows; all bits of a row are worked on at once.
    """
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        if keep:
            rows.append(row)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))]), rows


def common(a: list[int], b: list[int], most: int = 1 << 26) -> list[int]:
    """Places of a in a longest common subsequence of a and b.

    A table of more than `most` bits is never held: a is halved where b splits best, and the halves are aligned alone.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    in_a, in_b = set(a[start : len(a) - end]), set(b[start : len(b) - end])
    place = [i for i in range(start, len(a) - end) if a[i] in in_b]
    left, right = [a[i] for i in place], [x for x in b[start : len(b) - end] if x in in_a]
    middle: list[int] = []
    if left and right and len(left) * len(right) > most and len(left) > 1:
        half = len(left) // 2
        first, second = rows_of_lcs(left[:half], right, False)[0], rows_of_lcs(left[half:][::-1], right[::-1], False)[0]
        cut = int((first + second[::-1]).argmax())
        middle = common(left[:half], right[:cut], most) + [half + i for i in common(left[half:], right[cut:], most)]
    elif left and right:
        _, rows = rows_of_lcs(left, right, True)
        i, j = len(left) - 1, len(right) - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1  # the length does not grow at this place of b
            elif i and not rows[i - 1] >> j & 1:
                i -= 1  # it grew here before this item of a
            else:
                middle.append(i)
                i, j = i - 1, j - 1
        middle.reverse()
    return [*range(start), *(place[i] for i in middle), *range(len(a) - end, len(a))]


def shared_lines(alike: float):
    """Pages and their neighbours -> the places of main lines that the nearest neighbour shares."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own, size, taken = row["lines"], row["sizes"], []
                near = sorted(row["near"], key=lambda x: (-len(os.path.commonprefix([row["path"], x["path"]])), x["run"]))
                for other in near:
                    same = common(own, other["shown"])
                    part = sum(size[i] for i in same)
                    if part < alike * min(sum(size), other["total"]):
                        taken = same
                        break
                found.append(taken)
            yield pa.RecordBatch.from_pydict({"run": batch["run"], "same": pa.array(found, pa.list_(pa.int32()))})

    return share


def shown_pages(pages: DataFrame) -> DataFrame:
    """(h, g, host, path, digest, lines, sizes, shown, total) of all pages that show a line.

    lines, sizes: hashes and lengths of the lines that stay or are open; shown: hashes of all lines, those that markup hides
    included, as what one page marks may stand unmarked in its neighbour; total: their characters; digest: of the lines that
    stay or are open, by which pages are told apart.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = [placed_lines(x) for x in batch["html"].to_pylist()]
            some = [i for i, lines in enumerate(placed) if lines]
            found = {c: batch[c].take(pa.array(some, pa.int64())) for c in ("h", "g", "host", "path")}
            placed = [placed[i] for i in some]
            picked = [chosen(page) for page in placed]
            found["digest"] = pa.array([line_hash("\n".join([str(undecided), *own])) for own, undecided in picked], pa.int64())
            found |= {"lines": pa.array([[line_hash(x) for x in own] for own, _ in picked], pa.list_(pa.int64())), "sizes": pa.array([[len(x) for x in own] for own, _ in picked], pa.list_(pa.int32()))}
            found |= {"shown": pa.array([[line_hash(x) for x, _ in page] for page in placed], pa.list_(pa.int64())), "total": pa.array([sum(len(x) for x, _ in page) for page in placed], pa.int64())}
            yield pa.RecordBatch.from_pydict(found)

    return pages.mapInArrow(read, "h long, g int, host string, path string, digest long, lines array<long>, sizes array<int>, shown array<long>, total long")


def runs_of(held: DataFrame) -> DataFrame:
    """Pages (h, g, host, path, digest) with `run`: pages of a host that follow each other by path and have the same lines are one run.

    A range sort with the borders of its parts, a row a part; no window is wider than a part.
    """
    placed = range_numbered(held, ["host", "path", "h", "g"], "by-path")
    own = F.struct("host", "digest")
    last = placed.groupBy("part").agg(F.max_by(own, "local").alias("last"))
    parts = last.select("part", F.lag("last").over(W.Window.orderBy("part")).alias("border"))  # a row a part
    before = F.coalesce(F.lag(own).over(W.Window.partitionBy("part").orderBy("local")), F.col("border"))
    starts = placed.join(F.broadcast(parts), "part").withColumn("starts", F.coalesce((before != own).cast("long"), F.lit(1)))
    offsets = part_offsets(starts, F.sum("starts"))
    inside = F.sum("starts").over(W.Window.partitionBy("part").orderBy("local"))
    return stored(starts.withColumn("inside", inside).join(F.broadcast(offsets), "part").select("h", "g", "host", "path", (F.col("before") + F.col("inside")).alias("run")), "runs")


def shared_places(pages: DataFrame, alike: float) -> DataFrame:
    """(h, g, same): for pages whose nearest neighbour shares some of their main lines, the places of these.

    A run's neighbours are the last page of the run before and the first page of the run behind, each with all its own lines:
    pages of a run have the same main lines, but not always the same menus.
    """
    held = stored(shown_pages(pages).dropDuplicates(["h", "g"]), "shown-pages")
    placed = runs_of(held.select("h", "g", "host", "path", "digest"))
    page = F.struct("path", "h", "g")
    ends = placed.groupBy("run").agg(F.min("host").alias("host"), F.min(page).alias("first"), F.max(page).alias("last"))
    ends = ends.select("run", "host", "first", "last", F.explode(F.array_distinct(F.array("first", "last"))).alias("page"))
    ends = ends.select("run", "host", "page.*", (F.col("page") == F.col("first")).alias("begins"), (F.col("page") == F.col("last")).alias("ends"))
    texts = ends.join(held.select("h", "g", "lines", "sizes", "shown", "total"), ["h", "g"]).drop("h", "g")
    texts = stored(texts, "run-lines")
    asking = texts.where(F.col("begins") & (F.size("lines") > 0)).select("run", "host", "path", "lines", "sizes")
    sides = F.explode(F.array_compact(F.array(F.when(F.col("begins"), F.col("run") - 1), F.when(F.col("ends"), F.col("run") + 1)))).alias("of")
    near = texts.select(sides, F.col("host").alias("at"), "run", "path", "shown", "total").groupBy("of", "at").agg(F.collect_list(F.struct("run", "path", "shown", "total")).alias("near"))
    found = asking.join(near, (F.col("run") == F.col("of")) & (F.col("host") == F.col("at"))).select("run", "path", "lines", "sizes", "near").mapInArrow(shared_lines(alike), "run long, same array<int>")
    return placed.select("h", "g", "run").join(found.where(F.size("same") > 0), "run").select("h", "g", "same")


def main_text(pages: DataFrame, alike: float = 0.8, shared: bool = False) -> DataFrame:
    """page_id, url, text, n_chars of each page; with shared, also n_shared.

    n_shared: how many of the lines that markup leaves to the page its neighbour shows too; where they are open they are deleted.

    A line is a block's text: character references decoded, white space turned into single spaces, trimmed; a line
    break inside a block is white space.  Lines are joined by one \\n in page order.
    Every page is aligned with its neighbours and is one, whether or not its markup decides what stays of it; article lines
    are never deleted.
    Two neighbours that share `alike` or more of the shorter one's characters are versions of one page and tell nothing:
    the next neighbour is asked, and if there is none nothing is deleted.  A null or empty html has an empty text.  Repeated
    rows get the same text, and are one page in the pairing; pages of a null url are of one host, which has no name.
    Texts are worked on whole, whatever their length.  No rows: no rows.  Other columns are not read.
    """
    own = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("h"), F.hash("html", "url").alias("g"))
    # Stored, and sent whole up to a bound; beyond it the pages are shuffled once.
    same = shared_places(own.select("h", "g", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html"), alike)
    same = sent_whole(stored(same, "shared-places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = [], [x or [] for x in batch["same"].to_pylist()]
            for page, some in zip(batch["html"].to_pylist(), places, strict=True):
                lines, undecided = lines_of(page)
                gone = set(some) if undecided else set()
                texts.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
            found = {"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_pydict(found | ({"n_shared": pa.array([len(x) for x in places], pa.int64())} if shared else {}))

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long" + ", n_shared long" * shared
    return own.join(same, ["h", "g"], "left").select("page_id", "url", "html", "same").mapInArrow(read, schema)
