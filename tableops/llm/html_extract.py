"""HTML extraction by line-block distribution.

The page's markup is stripped to lines, one a block, and containers (div, section and the like) leave empty lines at their
bounds. Text lengths are summed over sliding windows of lines; where the sum leaves zero is a surge point, where it falls
back is a dive point, and the lines between are a text block. Lines of menus, adverts, forms and the like (by element, by
class or id, or by their share of link text) count zero, so that they part the blocks. Blocks whose summit comes near the
highest, or holds a sentence or two, are text unless they hold copyright lines alone. An article or main element that holds such a block extends it to all of
its lines, and then only such elements are text. On other pages text is what lies between the first surge and the last dive
point of those blocks, and the headings right before it. An article inside a layout wrapper whose class names
boilerplate is text all the same; the rest of the wrapper is not.

Defined results: null or empty html, and pages without text, give an empty text; markup that is never closed
ends with the page; repeated rows are extracted each for itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableops.llm.common import texts_of

WINDOW = 3
#: Part of the highest window sum that a block must reach.
SUMMIT_SHARE = 0.2
#: Window sum that is always enough, however long the page's longest passage is.
ENOUGH = 80

_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*+))")
#: Attributes, read once from left to right: quotes count after an equals sign only; one that is never closed is a character like others.
_ATTRIBUTES = re.compile(r"""(?>\s++|[/=]|[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+""")
_RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
_BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose bounds leave empty lines, as if their tags stood on lines of their own; a closing and an opening one part blocks.
_CONTAINERS = frozenset("article aside dialog div fieldset footer form header main nav section table".split())
_BOUND = WINDOW - 1
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form button select svg object canvas audio video menu dialog fieldset head search datalist".split())
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Class, id and role names of boilerplate elements; and words that a longer name of one begins or ends with ("nav-links", "site-footer").
_BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar toolbar header comment comments disqus reply replies respond cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations widget widgets pagination pager contentinfo complementary copyright disclaimer".split())
_FIRST = frozenset("ad ads advert advertisement adsense sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus cookie cookies gdpr newsletter pagination widget related".split())
_LAST = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer topbar toolbar comments replies cookie cookies consent notice notices popup modal newsletter subscribe signup login widget widgets pagination pager copyright disclaimer".split())
#: Whole names that mean something else inside an article: its own header and its parts are text.
_OWN = frozenset("aside header masthead topbar toolbar search notification popup modal overlay signup consent gdpr banner contentinfo complementary footer copyright disclaimer".split())
#: First words of names that say what an element has or lacks, not what it is ("with-sidebar").
_HAS = frozenset("with without has have no is show hide".split())
#: Words of elements whose articles are not the page's own.
_FOREIGN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus reply replies respond related recommended recommendations".split())
_PARTS = re.compile(r"[-_:]+")
_CAPITALS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Lines of copyright: a block of nothing else is no text.
_NOTICE = re.compile(r"©|\(c\)\s|copyright\b|all rights reserved\b", re.I)
_MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?(?:main|article)\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)


def _is_boilerplate(name: str, attributes: str, in_main: int) -> bool:
    if name in _DROPPED:
        return True
    if name == "header":
        return not in_main
    if not attributes or name in ("body", "html", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    return any(_names_boilerplate(n, in_main) for n in _names(attributes))


def _names_boilerplate(name: str, in_main: int) -> bool:
    parts = _PARTS.split(name)
    if len(parts) == 1:
        return name in _BOILERPLATE and not (in_main and name in _OWN)
    return parts[0] not in _HAS and (name in _BOILERPLATE or parts[0] in _FIRST or parts[-1] in _LAST)


def _names(attributes: str) -> list[str]:
    """Names in the class, id and role, words in capitals parted by hyphens."""
    return [_CAPITALS.sub("-", w).lower() for found in _CLASS.findall(attributes) for value in found for w in value.split()]


def _is_foreign(attributes: str) -> bool:
    return any(not _FOREIGN.isdisjoint((n, *_PARTS.split(n))) for n in _names(attributes))


def _is_layout(name: str, attributes: str) -> bool:
    """Whether a boilerplate element may yet hold the page's article."""
    return name not in _DROPPED and name != "header" and not _HIDDEN.search(attributes) and not _is_foreign(attributes)


def _closes_first(name: str, page: str, at: int) -> bool:
    """Whether the small element opened before `at` is closed before another of its name opens."""
    found = re.compile(rf"<(/?){name}\b", re.I).search(page, at)
    return bool(found and found[1])


class Line(NamedTuple):
    text: str
    length: int  # what counts: zero of boilerplate
    article: int  # number of the outermost article or main element around, from 1; else 0
    heading: bool


EMPTY = Line("", 0, 0, False)


def page_lines(page: str) -> list[Line]:
    """Lines of the page in order, empty ones at the bounds of containers."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = at = links = in_main = articles = 0
    skip, depth = "", 0  # the boilerplate element that is open, and how deep its name is nested
    layout, seen_main = False, False  # whether the open boilerplate element may hold the article; whether one was found
    around: tuple[str, int] | None = None  # the boilerplate element around the open article
    mains: list[str] = []
    heading = False

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, 0 if skip or (not in_main and 2 * linked > len(text)) else len(text), articles if in_main else 0, heading))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    n = len(page)
    while at < n:
        found = _MARKUP.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        if not found[2]:
            # A comment or declaration, to its end or the page's.
            close = "-->" if found[0] == "<!--" else ">"
            end = page.find(close, found.end())
            at = end + len(close) if end >= 0 else n
            continue
        told = _ATTRIBUTES.match(page, found.end())
        attributes, at = told[0], told.end() + 1
        if at > n:
            break  # the page's end cuts the tag off
        closing, name = bool(found[1]), found[2].lower()
        if name in _RAW and not closing:
            end = _RAW[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in _BLOCKS:
            end_line()
            heading = name in _HEADINGS and not closing
            if name in _CONTAINERS:
                lines.extend([EMPTY] * _BOUND)
        if name == "a":
            links = 0 if closing else 1
        if name in _VOID:
            continue
        if skip and layout and not closing and not around and not in_main and (name == "main" or name == "article" and not seen_main) and not _HIDDEN.search(attributes) and not _is_foreign(attributes):
            around, skip, depth, links = (skip, depth), "", 0, 0
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
                    lines.extend([EMPTY] * WINDOW)  # parts the blocks on both sides
            elif closing and mains and name == mains[-1]:
                skip = ""  # the article ends, so the unclosed element in it does
        elif not closing and name not in ("p", "li", "b", "i", "a", "span", "em", "strong") and _is_boilerplate(name, attributes, in_main):
            skip, depth, layout = name, 1, _is_layout(name, attributes)
            lines.extend([EMPTY] * WINDOW)
        elif not closing and name in ("p", "li", "span", "a") and attributes and _is_boilerplate(name, attributes, in_main) and _closes_first(name, page, at):
            end_line()
            skip, depth, layout = name, 1, _is_layout(name, attributes)
            lines.extend([EMPTY] * WINDOW)
        if not skip and (name in ("article", "main") or (not closing and _MAIN_ROLE.search(attributes))):
            if not closing:
                articles += not in_main
                mains.append(name)
                in_main += 1
                seen_main = True
            elif mains and name in mains:
                mains.remove(name)
                in_main -= 1
                if around and not in_main:
                    (skip, depth), around, layout = around, None, True
                    lines.extend([EMPTY] * WINDOW)
        if skip and name == skip and not closing:
            links = 0
    end_line()
    return lines


def text_blocks(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, summit) of each block: lines [surge, dive) and their highest window sum."""
    if not len(lengths):
        return []
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(len(lengths))
    # Sums over the window that begins, and over the one that ends, at each line.
    ahead = total[np.minimum(at + window, len(lengths))] - total[at]
    behind = total[at + 1] - total[np.maximum(at + 1 - window, 0)]
    inside = (ahead > 0) & (behind > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return [(int(s), int(e), int(ahead[s:e].max())) for s, e in edges.reshape(-1, 2)]


def extract_text(page: str) -> str:
    """The page's main text: lines between surge and dive points, joined by one space."""
    lines = page_lines(page)
    blocks = text_blocks(np.array([line.length for line in lines], dtype=np.int64))
    least = min(ENOUGH, SUMMIT_SHARE * max((summit for _, _, summit in blocks), default=0))
    blocks = [(surge, dive) for surge, dive, summit in blocks if summit >= least and not all(_NOTICE.match(line.text) for line in lines[surge:dive] if line.length)]
    articles = {lines[i].article for surge, dive in blocks for i in range(surge, dive) if lines[i].length} - {0}
    if articles:
        return " ".join(line.text for line in lines if line.length and line.article in articles)
    if not blocks:
        return ""
    first, last = blocks[0][0], blocks[-1][1]
    while first and (lines[first - 1].heading or not lines[first - 1].length):
        first -= 1
    return " ".join(line.text for line in lines[first:last] if line.length)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(x) for x in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(key, url, page).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
