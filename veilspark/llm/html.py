"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element starts a line.  Lines of menus,
forms, notices and the like count as blank, and blank lines stand at the borders
of article elements.  Sums of text lengths over sliding windows of lines show
where text surges and dives; what stands between is the main text.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table

#: Lines of a window.
WINDOW = 3
#: The sum that a hill needs outside article elements, at most.
LEVEL = 120

#: Elements whose content is no text of the page.
_RAW = re.compile(r"<!--|<(script|style|noscript|template|svg|iframe|object|textarea|select|head|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<![^>]*>|<\?[^>]*>", re.I)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "head", "title")}
#: Where the content of one of these ends that is never closed.
_CODE, _NEXT = {"script", "style", "head", "title"}, re.compile(r"<(?:body|article|main|section|div|p|h[1-6]|nav|header|footer|aside|ul|table)\b|</(?:head|body|html)\b", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BOILER = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|comments?|disqus|replies|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|share|social|related|recommend\w*|newsletter|subscribe|signup|login|search|popup|modal|copyright|pagination|widget|complementary|contentinfo", re.I)
#: Parts that may stand beside such a word in a name; with any other ("no-sidebar", "has-header-image") the name says something else.
_BESIDE = re.compile(r"[0-9]+(?:x[0-9]+)?|site|page|global|main|top|bottom|upper|lower|left|right|primary|secondary|sub|sticky|fixed|mobile|desktop|user|google|banner|box|bar|list|links?|items?|container|wrapper|wrap|inner|outer|block|area|section|unit|slot|panel|form|buttons?|icons?|posts?|articles?|stories|message|text|overlay|dialog|media|us|up|js", re.I)
_BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "option", "label", "fieldset"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: These hold the page itself, whatever their names say.
_WHOLE = {"html", "body"}
_ARTICLE = re.compile(r"(?:^|\s)(?:main|article)(?:$|\s)", re.I)


@functools.lru_cache(4096)
def _boilerplate(names: str) -> bool:
    """Whether a class, id or role is, as a whole, the name of boilerplate."""
    for name in names.split():
        parts = [x for x in re.split("[-_]+", name) if x]
        known = [_BOILER.fullmatch(x) is not None for x in parts]
        if any(known) and all(k or _BESIDE.fullmatch(x) for k, x in zip(known, parts, strict=True)):
            return True
    return False


def _without_raw(page: str) -> str:
    """The page without comments, declarations and elements that hold no text, in linear time.

    A self-closed element and one that is never closed lose their tag only; an unclosed script, style, head or title
    ends where the next block element begins.
    """
    out, at, gone = [], 0, set()
    while m := _RAW.search(page, at):
        out.append(page[at : m.start()])
        tag, at = (m[1] or "").lower(), m.end()
        if m[0] == "<!--":
            end = page.find("-->", at) if "<!--" not in gone else -1
            if end < 0:
                gone.add("<!--")
                end = page.find(">", at) - 2
            at = end + 3 if end >= at - 2 else len(page)
        elif tag and not m[0].endswith("/>"):
            close = _CLOSE[tag].search(page, at) if tag not in gone else None
            if close:
                at = close.end()
            else:
                gone.add(tag)
                if tag in _CODE:
                    nearest = _NEXT.search(page, at)
                    at = nearest.start() if nearest else len(page)
    out.append(page[at:])
    return "".join(out)


def lines_of(page: str) -> list[tuple[str, bool, int]]:
    """Lines of a page: text (empty where boilerplate), whether it is boilerplate by its elements, and the number of the
    outermost article or main element that it stands in (0 for none)."""
    page = _without_raw(page)
    lines, parts, at = [], [], 0
    elements, stack, open_ = [], [], {}  # elements as (parent, tag, boilerplate, article, article proper); the open ones' places, by tag too

    def end():
        if text := " ".join(entities.unescape("".join(parts)).split()):
            lines.append((text, stack[-1] if stack else -1))
        parts.clear()

    def close(n: int):
        for k in stack[n:]:
            open_[elements[k][1]] -= 1
        del stack[n:]

    def last(tag: str, until: set = frozenset()) -> int:
        """The place on the stack of the innermost open element of this name, if no element of ``until`` stands in between; else -1."""
        if open_.get(tag):
            for n in range(len(stack) - 1, -1, -1):
                name = elements[stack[n]][1]
                if name == tag:
                    return n
                if name in until:
                    break
        return -1

    for m in _TAG.finditer(page):
        parts.append(page[at : m.start()])
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCKS:
            end()
        if tag in _VOID or (tag in _CLOSE and m[0].endswith("/>")):
            continue
        if closing:
            if (n := last(tag)) >= 0:
                close(n)
            continue
        if tag == "p" and (n := last("p", _BLOCKS - {"p"})) >= 0:  # an open paragraph ends where the next begins
            close(n)
        parent = stack[-1] if stack else -1
        names = " ".join(x for g in _NAMES.findall(m[3]) for x in g if x) if m[3] else ""
        article = tag in ("article", "main") or (bool(names) and _ARTICLE.search(names) is not None)
        named = bool(names) and _boilerplate(names)
        inside = parent >= 0 and elements[parent][3]
        heads = tag == "header" and inside  # an article's own header holds its title
        boiler = tag not in _WHOLE and ((tag in _BOILER_TAGS and not heads) or (named and not article))
        elements.append((parent, tag, boiler, article or inside, article and not named))
        stack.append(len(elements) - 1)
        open_[tag] = open_.get(tag, 0) + 1
    parts.append(page[at:])
    end()
    boilers = _boilers(elements, lines)
    outermost = [0] * (len(elements) + 1)
    for k, (parent, _, _, inside, _) in enumerate(elements):
        outermost[k] = outermost[parent] or (k + 1 if inside else 0)
    return [("" if boilers[e] else text, boilers[e], outermost[e]) for text, e in lines]


def _boilers(elements: list[tuple], lines: list[tuple[str, int]]) -> list[bool]:
    """Whether each element stands in boilerplate; the last entry, at -1, is for the page.

    What holds the main element is none, nor is a form with most of the page's text, nor what holds an article where
    no article stands outside boilerplate (articles beside one may be teasers or comments).
    """
    chars, mains, proper = ([0] * (len(elements) + 1) for _ in range(3))
    for text, e in lines:
        chars[e] += len(text)
    total = sum(chars)
    for k in range(len(elements) - 1, -1, -1):
        parent, tag, _, _, own = elements[k]
        chars[parent] += chars[k]
        mains[parent] += mains[k] + (own and tag == "main" and chars[k] > 0)
        proper[parent] += proper[k] + (own and chars[k] > 0)
    for held in (mains, proper):
        out = [False] * (len(elements) + 1)
        for k, (parent, tag, boiler, _, _) in enumerate(elements):
            out[k] = out[parent] or (boiler and not held[k] and not (tag == "form" and 2 * chars[k] > total))
        if any(e[4] and chars[k] and not out[k] for k, e in enumerate(elements)):
            break
    return out


def region(lengths: list[int], articles: list[int], window: int = WINDOW) -> list[bool]:
    """Which lines are main text, by the distribution of line blocks.

    A block is a window of lines; a line of boilerplate has length 0, and ``window`` blank lines stand at the borders of
    article elements (``articles``: each line's, 0 for none).  Where sums of blocks are above zero they form hills.
    A hill counts where its highest sum reaches the level: a quarter of the page's highest and at most LEVEL; within an
    article element, any.  Where article elements hold text, a hill outside them also needs as much text as the
    article hill with the most.  Text surges where the first hill that counts leaves zero and dives where the last one
    is back there; without article elements all that stands between stays, else each hill that counts does.
    """
    padded, at = [], []
    for k, n in enumerate(lengths):
        if k and articles[k] != articles[k - 1]:
            padded += [0] * window
        at.append(len(padded))
        padded.append(n)
    if not any(padded):
        return [False] * len(lengths)
    blocks = np.convolve(np.array(padded, np.int64), np.ones(window, np.int64))  # block k ends at line k
    live = np.concatenate(([False], blocks > 0, [False]))
    surges, dives = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(live[:-1] & ~live[1:])
    owner = {p: articles[k] for k, p in enumerate(at)}
    hills = [(a, b, bool(owner.get(a)), int(blocks[a:b].max()), sum(padded[a:b])) for a, b in zip(surges.tolist(), dives.tolist(), strict=True)]
    level = min(LEVEL, blocks.max() // 4)
    told = max((size for _, _, article, _, size in hills if article), default=0)
    counts = [(a, b) for a, b, article, top, size in hills if article or (top >= level and size >= told)]
    if not told:
        counts = [(counts[0][0], counts[-1][1])]
    keep = np.zeros(len(padded) + window, bool)
    for a, b in counts:
        keep[a:b] = True
    return [bool(keep[p] and padded[p]) for p in at]


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The text between the surge and the dive of the line-block distribution.

    A null, empty or text-less page gives an empty text.
    """
    lines = lines_of(page or "")
    kept = region([0 if b else len(t) for t, b, _ in lines], [a for _, _, a in lines], window)
    return "\n".join(t for (t, _, _), k in zip(lines, kept, strict=True) if k)


def _extract(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row (columns ``page_id, url, html``).

    A null page has an empty text; pages of any length are read whole, in linear time; repeated rows each get a row,
    null ids and urls stay null, other columns are not read, and an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
