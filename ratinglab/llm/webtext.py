"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block-level tag ends a line; boilerplate elements (menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, comments by readers; inside an
article only containers are judged by their class and id, headings and paragraphs stay), comments and
the borders of an article leave ``WINDOW`` empty lines. Text lengths are summed over a sliding
window of ``WINDOW`` lines. A surge point is where the sum rises from zero, a dive point where it
falls back to zero; the lines between them are a run. Runs inside an article (else inside the main
element) are the text; on pages without either, runs are whose sums reach ``SURGE`` characters and
are not mostly links, or else the longest run, without lines that are mostly links.

Defined cases: null or empty html gives an empty text; unclosed elements end with the page, but an
unclosed boilerplate element only up to the next article, main element or heading; character
references are decoded as browsers do; repeated rows give repeated rows; an empty table gives an
empty result; a page of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratinglab.session import ship_package

WINDOW, SURGE = 3, 80

#: A comment, a declaration or a tag. No part can give back what it took, so time follows the length.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][\w:-]*+)"
    r"((?:\s++(?:[^\s\"'>=/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]*+))?+|/))*+\s*+/?+|[^>]*+)>", re.S)
#: Element names.
_RAW = frozenset("script style noscript template svg iframe textarea title object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav footer aside form head button select menu dialog label input".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: Elements whose class and id are read inside an article or main element; others' are anchors there.
_CONTAINER = frozenset("div section ul ol dl table header details fieldset figure center".split())
#: Words in class or id that mark boilerplate.
_WORDS = (r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|"
          r"footer|header|masthead|cookies?|consent|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|"
          r"subscription|share|sharing|social|related|recommended|comments?|commentlist|disqus|respond|replies|widget|"
          r"pagination|pager|toc|login|signup|search)")
_DROP_WORD = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])", re.I)
#: What else a compound class of boilerplate is made of ("share-buttons", "related-posts").
_MORE = (r"(?:bar|box|block|buttons?|container|content|disclaimer|feed|form|group|icons?|inner|items?|left|links?|list|main|"
         r"articles?|policy|posts?|outer|pages?|reader|right|section|slot|small|stories|story|thread|top|unit|user|wrap|wrapper)")
#: A whole class inside an article: a boilerplate word, alone or with others of these two lists.
_DROP_CLASS = re.compile(rf"(?:{_MORE}[_-]+)*{_WORDS}(?:[_-]+(?:{_WORDS}|{_MORE}))*", re.I)
#: Whole ids inside an article; other ids there are anchors of its sections.
_DROP_ID = re.compile(r"comments?|commentlist|disqus(?:[_-]thread)?|respond|replies|sidebar|newsletter|breadcrumbs?", re.I)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACES = re.compile(r"\s+")
_RESUME = re.compile(r"<(?:article|main|h1)\b", re.I)


def _boilerplate(name: str, attrs: str, in_main: bool) -> bool:
    if name in _DROP or (name == "header" and not in_main):
        return True
    if name in ("article", "main", "body", "html") or not attrs.strip():
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            if not in_main:
                if _DROP_WORD.search(value):
                    return True
            elif name in _CONTAINER and any((_DROP_CLASS if key == "class" else _DROP_ID).fullmatch(x) for x in value.split()):
                return True
        if key == "role" and value.lower() in _DROP_ROLE:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
    return False


class _Page:
    """A page, and where its elements end, found once for each element name."""

    def __init__(self, page: str):
        last = page.rfind(">") + 1
        cut = page.find("<!--", last)  # a comment that no tag follows ends with the page
        self.text = page[:cut] if cut >= 0 else page
        self.last = last
        self.ends: dict[str, dict[int, int]] = {}
        self.resume: list[int] | None = None

    def tag(self, at: int):
        """The next comment or tag; behind the last ">" there is none."""
        m = _TAG.search(self.text, at, self.last)
        open_comment = m is not None and m[2] is None and m[0].startswith("<!--") and not m[0].endswith("-->")
        return m, len(self.text) if open_comment else m.end() if m else 0

    def raw_end(self, name: str, at: int) -> int:
        close = re.compile(rf"</{name}\b[^>]*+>", re.I).search(self.text, at, self.last)
        return close.end() if close else len(self.text)

    def skip(self, name: str, start: int, at: int) -> int:
        """End of the element whose tag is at ``start``; of an unclosed one, the next article, main
        element or first heading."""
        if name not in self.ends:
            ends, opened = self.ends.setdefault(name, {}), []
            tag = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){re.escape(name)}\b[^>]*+>", re.I | re.S)
            for m in tag.finditer(self.text, 0, self.last):
                if m[1] == "":
                    opened.append(m.start())
                elif m[1] and opened:
                    ends[opened.pop()] = m.end()
        if start in self.ends[name]:
            return self.ends[name][start]
        if self.resume is None:
            self.resume = [m.start() for m in _RESUME.finditer(self.text)]
        k = bisect.bisect_left(self.resume, at)
        return self.resume[k] if k < len(self.resume) else len(self.text)


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, place, characters in links) of each line; place: 2 in an article, 1 in main, else 0."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = articles = mains = links = 0
    source = _Page(page)
    page, at = source.text, 0

    def end_line(blank: int = 0):
        nonlocal linked
        text = _SPACES.sub(" ", _html.unescape("".join(parts))).strip()
        if text:
            out.append((text, 2 if articles else 1 if mains else 0, linked))
        parts.clear()
        linked = 0
        if blank:
            out.extend([("", 0, 0)] * blank)

    def take(text: str):
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if links else 0

    while True:
        m, after = source.tag(at)
        if m is None:
            take(page[at:])
            break
        take(page[at:m.start()])
        at = after
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name in ("article", "main"):
                end_line()
                articles, mains = max(0, articles - (name == "article")), max(0, mains - (name == "main"))
                end_line(WINDOW)
            elif name in _BLOCK:
                end_line()
            continue
        if name in _RAW:
            at = source.raw_end(name, at)
        elif name in _VOID:
            if name in _BLOCK:
                end_line()
            else:
                parts.append(" " if name == "br" else "")
        elif _boilerplate(name, m[3] or "", bool(articles or mains)):
            inline = name not in _BLOCK and name not in _DROP
            if not inline:
                end_line(WINDOW)
            at = source.skip(name, m.start(), at)
        elif name == "a":
            links += 1
        elif name in ("article", "main"):
            end_line(WINDOW)
            articles, mains = articles + (name == "article"), mains + (name == "main")
        elif name in _BLOCK:
            end_line()
    end_line()
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    n = len(lines)
    sums, acc = [0] * n, 0
    for i in range(n - 1, -1, -1):  # sums[i]: characters of lines i .. i + WINDOW - 1
        acc += len(lines[i][0]) - (len(lines[i + WINDOW][0]) if i + WINDOW < n else 0)
        sums[i] = acc
    runs: list[list[int]] = []
    surge = None
    for i in range(n + 1):
        if i < n and sums[i] and surge is None:
            surge = i
        elif surge is not None and (i == n or not sums[i]):
            runs.append([k for k in range(surge, i) if lines[k][0]])
            surge = None
    place = max((lines[k][1] for r in runs for k in r), default=0)
    if place:
        kept = [k for r in runs for k in r if lines[k][1] == place or lines[k][1] and 2 * lines[k][2] < len(lines[k][0])]
    else:
        chars = lambda r: sum(len(lines[k][0]) for k in r)
        prose = [r for r in runs if 2 * sum(lines[k][2] for k in r) < chars(r)]
        kept = [k for r in prose if max(sums[k] for k in r) >= SURGE for k in r] or max(prose, key=chars, default=[])
        kept = [k for k in kept if 2 * lines[k][2] < len(lines[k][0])]
    return "\n".join(lines[k][0] for k in kept)


def _batches(batches):
    for b in batches:
        text = [main_text(p) for p in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "page_id": b.column(0), "url": b.column(1), "text": pa.array(text, pa.string()),
            "n_chars": pa.array([len(t) for t in text], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars."""
    ship_package(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _batches, "page_id bigint, url string, text string, n_chars bigint")


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return extract(table(spark, sf_dir, "pages"))
