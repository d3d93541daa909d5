"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element becomes one line. A line weighs as many characters
as stand outside links; menus, forms, notices and the like are left out. A page that marks its article
gives that. On any other page the weights are summed over sliding windows of lines; text is kept from
each point where the sums surge to the next point where they dive, both measured by the page's own
typical line, without the sparse lines at its ends.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import map_texts

# Elements that are never part of the text.
DROPPED = {
    "head", "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "nav", "aside", "footer",
    "form", "button", "select", "textarea", "input", "label", "fieldset", "dialog", "menu", "audio", "video",
}
# Elements that hold no other element.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that stand inside a line of text.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr", "br", "td", "th",
    "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup",
    "munder", "mover", "munderover",
}
# Words of a class, id or role that name a part beside the article.
BESIDE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adbox", "adsense", "banner",
    "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo",
    "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
# First parts of a class that say what a wrapper has, not what it is.
_HAVING = {"has", "no", "not", "with", "without", "hide", "show"}
# Words for what readers added, which may outweigh the article.
_REPLIES = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
_TITLED = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that are never taken for a part beside the article by their class.
_FRAMES = {"html", "body", "article", "main"}
# A new one of these ends an open one.
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe)\b(?P<rawattr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WINDOW = 3
# A typical line weighs as many times a sparse one.
SPARSE = 5


def _is_beside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        return not in_article
    if tag in _FRAMES or not attributes:
        return False
    for name, value in _NAMED.findall(attributes):
        if name.lower() not in ("class", "id", "role"):
            continue
        # an id inside an article is mostly made from a title
        titled = in_article and tag in _TITLED and name.lower() == "id"
        for token in value.strip("\"'").split():
            parts = [w.lower() for w in _WORD.findall(token)]
            if not parts or parts[0] in _HAVING:
                continue
            if titled:
                named = set(parts) if set(parts) <= _REPLIES else set()
            else:
                named = {parts[0], parts[-1]} & BESIDE
            if named and not (in_article and "header" in parts and not set(parts) & (BESIDE - {"header"})):
                return True
    return False


def _spared(lines: list[tuple], mains: set[int], replies: set[int], dropped: set[int]) -> set[int]:
    """Elements named as beside the article that hold it all the same.

    Such are those around a main element, and, where no text of an article stands outside all of
    them, those around an article or most of the page's text.
    """
    spared = set(mains)
    if any(weight and inside and not set(owners) - spared for _, weight, inside, _, owners in lines):
        return spared
    held: dict[int, int] = {}
    marked: dict[int, int] = {}
    for _, weight, inside, _, owners in lines:
        for e in owners:
            held[e] = held.get(e, 0) + weight
            marked[e] = marked.get(e, 0) + (weight if inside else 0)
    total = sum(weight for _, weight, *_ in lines)
    own = {e for e, weight in marked.items() if 2 * weight > sum(w for _, w, inside, *_ in lines if inside)}
    return spared | (own - replies) | {e for e, weight in held.items() if 2 * weight > total and e not in replies and e not in dropped}


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """The page's blocks of text in order: text, characters that count, whether it stands in an article, and in a heading."""
    lines: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []
    besides: list[int] = []  # open elements beside the article, by place in the page
    mains: set[int] = set()
    replies: set[int] = set()
    dropped: set[int] = set()
    buffer: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, beside, article
    article = links = headings = 0

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", "".join(t for t, _ in buffer)).strip()
            if text:
                linked = len(_SPACE.sub("", "".join(t for t, link in buffer if link)))
                weight = max(0, len(_SPACE.sub("", text)) - 2 * linked) or (0 if linked else len(text))
                lines.append((text, weight, article > 0, headings > 0, tuple(besides)))
            buffer.clear()

    def say(text: str) -> None:
        if text:
            buffer.append((html.unescape(text), links > 0))

    def close(index: int) -> None:
        nonlocal article, links, headings
        while len(stack) > index:
            tag, was_beside, was_article = stack.pop()
            if tag not in INLINE or was_beside:
                flush()
            if was_beside:
                besides.pop()
            article -= was_article
            links -= tag == "a"
            headings -= tag in _TITLED and tag != "section"

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break  # a stray end of an inline element ends no block
            if tag not in INLINE:
                flush()
            elif tag in ("td", "th"):
                say(" ")
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                say(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            # a block ends an open paragraph and the inline elements left open in it
            i = len(stack)
            while i and stack[i - 1][0] in INLINE and stack[i - 1][0] not in ("td", "th"):
                i -= 1
            if i and stack[i - 1][0] == "p":
                close(i - 1)
            elif i and stack[i - 1][0] in _CLOSES.get(tag, ()):
                close(i - 1)
            flush()
        elif stack and stack[-1][0] in _CLOSES.get(tag, ()):
            close(len(stack) - 1)
        is_article = tag in ("article", "main") or bool(re.search(r"""articlebody|role\s*=\s*["']?main\b""", m["attr"], re.I))
        is_beside = _is_beside(tag, m["attr"], article > 0)
        if is_beside:
            flush()
        if m["attr"].rstrip().endswith("/"):
            continue
        stack.append((tag, is_beside, is_article and not is_beside))
        if is_article and not is_beside and tag != "article":
            mains.update(besides)
        if is_beside:
            besides.append(m.start())
            if tag in DROPPED:
                dropped.add(m.start())
            elif {w.lower() for w in _WORD.findall(m["attr"])} & _REPLIES:
                replies.add(m.start())
        headings += tag in _TITLED and tag != "section"
        article += is_article and not is_beside
        links += tag == "a"
    say(page[at:])
    close(0)
    flush()
    spared = _spared(lines, mains, replies, dropped)
    return [line[:4] for line in lines if spared.issuperset(line[4])]


def distribution(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the weights over the lines from each one on."""
    prefix = [0]
    for w in weights:
        prefix.append(prefix[-1] + w)
    return [prefix[min(len(weights), i + window)] - prefix[i] for i in range(len(weights))]


def typical(weights: list[int]) -> int:
    """Half of the page's weight is in lines of this weight or more."""
    left = sum(weights)
    for w in sorted(weights, reverse=True):
        left -= 2 * w
        if left <= 0:
            return w
    return 0


def regions(weights: list[int], headings: list[bool], window: int = WINDOW) -> list[tuple[int, int]]:
    """Bounds of the runs of lines from surge to dive.

    A surge is where a window holds as much as a typical line, a dive where all of a window weighs
    less than a sparse line. Sparse lines at the ends go, but a heading right before the text stays.
    """
    usual = typical(weights)
    if not usual:
        return []
    sums = distribution(weights, window)
    out = []
    i = 0
    while i < len(weights):
        if sums[i] < usual:
            i += 1
            continue
        lo = i
        while i < len(weights) and SPARSE * sums[i] >= usual:
            i += 1
        hi = i
        dense = [k for k in range(lo, hi) if SPARSE * weights[k] >= usual]
        if dense:
            lo, hi = dense[0], dense[-1] + 1
            while lo > (out[-1][1] if out else 0) and headings[lo - 1] and weights[lo - 1]:
                lo -= 1
            out.append((lo, hi))
    return out


def main_text(page: str, window: int = WINDOW) -> str:
    """Text of the marked article, or else between surge and dive points.

    Where a page marks its article, every line inside is kept and none outside. Elsewhere a line of
    links stays only between two lines of text.
    """
    lines = lines_of(page)
    if any(inside for _, _, inside, _ in lines):
        return "\n\n".join(text for text, _, inside, _ in lines if inside)
    weights = [weight for _, weight, *_ in lines]
    kept: list[str] = []
    for lo, hi in regions(weights, [heading for *_, heading in lines], window):
        for k in range(lo, hi):
            if weights[k] or (lo < k < hi - 1 and weights[k - 1] and weights[k + 1]):
                kept.append(lines[k][0])
    return "\n\n".join(kept)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    A null, empty or text-free page gives the empty text. Markup that is cut off or badly nested is
    read as far as it goes. Repeated rows give repeated results.
    """
    keep = keep or ["page_id", "url"]

    def make():
        def run(texts: list[str]) -> dict:
            found = [main_text(t) for t in texts]
            return {"main": found, "n_chars": [len(t) for t in found]}

        return run

    named = pages.select(*[F.col(k) for k in keep], F.col("html").alias("text"))
    return map_texts(named, keep, make, "main string, n_chars long").select(*keep, F.col("main").alias("text"), "n_chars")
