"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with its root-to-leaf path of tags.  Text length and punctuation are added up per path and
divided by the path's nodes; both ratios are smoothed along the page, fused and held against a threshold.  What the markup
says outright (an article or main element, menus, adverts, forms, scripts) weighs in as a prior on the path.  An article or
main element that holds a chosen container is kept whole, but for what is never main text.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import small_batches, text_of

# What HTML says of elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                      "h6 header hgroup hr main menu nav ol p pre section search summary table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table")}
_BARRIER = frozenset("article aside body button caption html main nav object section table td th template footer header".split())
_NEVER = frozenset("head nav aside form script style noscript template iframe svg math button select option textarea canvas audio video "
                   "object menu dialog title datalist".split())
_WORDS_OUT = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
                       "consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer "
                       "masthead comment comments disqus replies respond reply share sharing social related recommended newsletter subscribe "
                       "signup login popup modal toolbar pagination pager skip form search".split())
# Of the words above, those that also name a subject: `related-work` is text, `related-posts` is not, as the words below say no more
# than "part of the page".
_SUBJECTS = frozenset("alert form menu notice notices promotion recommended related reply respond search share sharing skip social".split())
_NEUTRAL = frozenset("area bar block body bottom box btn button buttons card cards container content footer group header icons inline inner item "
                     "items left link links list main middle module outer panel placeholder post posts right row section slot stories story "
                     "text thread title top unit wrap wrapper".split())
_ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT = _HEADINGS | frozenset("p ul ol menu li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hgroup".split())
_WHOLE = frozenset(("", "/html", "/html/body", "/body"))
_MAIN_ROLES = frozenset(("main", "article"))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_SPLIT = re.compile(r"[^a-z0-9]+")


class Block(NamedTuple):
    path: str
    text: str
    prior: int  # 1 within an article or main element, -1 in what is never main text, 0 else
    root: str = ""  # the path of the innermost article or main element


def _out(names: str, inside: bool) -> bool:
    """Whether class and id name what is never main text; within an article or main element a subject word must be what the name ends in."""
    found = _WORDS_OUT.intersection(_SPLIT.split(names))
    if not found or not inside or not found <= _SUBJECTS:
        return bool(found)
    parts = [[w for w in _SPLIT.split(n) if w and not w.isdigit() and w not in _NEUTRAL] for n in names.split()]
    return any(p and p[-1] in _WORDS_OUT for p in parts)


def _prior(tag: str, attributes: str, above: int, inside: bool) -> tuple[int, str, bool]:
    """Prior of an element, given that above it, the name it has in a path, and whether an article or main element begins."""
    names = ""
    if attributes:
        got = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        names = " ".join(got[k] for k in ("class", "id") if k in got).lower()
        role = got.get("role", "").lower()
        hidden = "hidden" in got and got["hidden"].lower() != "until-found" or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
        if hidden or role in _ROLES_OUT or tag not in ("body", "html", "article", "main") and _out(names, above > 0):
            return -1, f"{tag}.{names.split()[0]}" if names.split() else tag, False
        if role in _MAIN_ROLES or got.get("itemprop", "").lower() == "articlebody":
            return (-1 if above < 0 else 1), tag, above >= 0
    shown = f"{tag}.{names.split()[0]}" if names.split() else tag
    if above < 0 or tag in _NEVER or tag in ("header", "footer") and not inside:
        return -1, shown, False
    if tag == "footer":
        return -1, shown, False
    begins = tag in ("article", "main")
    return (1 if begins else above), shown, begins


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; character references are decoded, white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, str]] = [("", "", 0, "")]  # tag, path, prior, root
    held: list[str] = []
    block = [("", 0, "")]

    def end_block() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                path, prior, root = block[0]
                out.append(Block(path, text, prior, root))
            held.clear()
        own = next((s for s in reversed(stack) if s[0] not in _INLINE), stack[0])
        block[0] = own[1:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        held_text = page[at:m.start() if m else n]
        if held_text:
            if stack[-1][2] >= 0 or block[0][1] < 0:
                held.append(held_text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[2] is None and not page.endswith(">", m.start(), at):
            break  # the page ends within a tag
        if m[1] or m[4]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag not in _INLINE or tag == "br":
                end_block()
            if depth and not (tag in _INLINE and any(s[0] in _CLOSES_P for s in stack[depth:])):
                hid = stack[-1][2] < 0
                del stack[depth:]
                if tag not in _INLINE or hid:
                    end_block()
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag == "br":
            held.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            end_block()
        if tag in _CLOSES_P:
            _close(stack, ("p",), _BARRIER)
        elif tag in _SAME:
            _close(stack, _SAME[tag], _SCOPE[tag])
        prior, name, begins = _prior(tag, m[3] or m[6] or "", stack[-1][2], any(s[0] in ("article", "main") for s in stack))
        if tag not in _VOID:
            if inline and prior < 0 <= stack[-1][2]:
                end_block()
            path = f"{stack[-1][1]}/{name}"
            stack.append((tag, path, prior, path if begins else stack[-1][3]))
        if not inline or prior < 0:
            end_block()
    end_block()
    return out


def _close(stack: list[tuple[str, str, int, str]], tags: tuple[str, ...], scope) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in tags:
            del stack[k:]
            return
        if stack[k][0] in scope:
            return


def _container(path: str) -> str:
    """The path of the element that holds a block's paragraph, heading, list or table."""
    own = path.split("/")
    while len(own) > 2 and own[-1].split(".")[0] in _TEXT:
        own.pop()
    return "/".join(own)


def select(found: list[Block], width: float = 1.0, strict: float = 0.5, outside: float = 0.25, share: float = 0.5) -> list[Block]:
    """All blocks of the containers that the smoothed and fused ratios choose.

    A container counts with the sum of its own blocks' ratios; one with a block that reaches the threshold, ``strict`` standard
    deviations of the page's ratios, and with at least ``share`` of the largest sum is chosen.  Blocks with prior -1 never
    count; where a page has an article or main element, ratios beside it are weighed by ``outside``.  All blocks of an article
    or main element with a chosen container stay, but for those of another such element in it.  Headings of what holds a chosen
    container stay; of the body itself only what is not in another container.
    """
    open_blocks = [b for b in found if b.prior >= 0]
    if not open_blocks:
        return []
    marked = any(b.prior > 0 for b in open_blocks)
    sums: dict[str, list[float]] = {}
    for b in open_blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_PUNCTUATION.findall(b.text))
    length = [sums[b.path][1] / sums[b.path][0] for b in open_blocks]
    points = [(sums[b.path][2] + 0.1) / sums[b.path][0] for b in open_blocks]
    ratio = [x * y * (outside if marked and b.prior < 1 else 1) for b, x, y in zip(open_blocks, _smooth(length, width), _smooth(points, width))]
    mean = sum(ratio) / len(ratio)
    limit = strict * math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    held = [_container(b.path) for b in open_blocks]
    mass: dict[str, float] = {}
    for c, r in zip(held, ratio):
        mass[c] = mass.get(c, 0.0) + r
    least = share * max(mass.values())
    chosen = {c for c, r in zip(held, ratio) if r >= limit and mass[c] >= least}
    whole = {b.root for b, c in zip(open_blocks, held) if b.root and c in chosen}
    above = {c[:k] for c in chosen for k in range(len(c)) if c[k] == "/"}

    def stays(path: str, own: str) -> bool:
        if own in chosen or own in above and own not in _WHOLE and path.rsplit("/", 1)[1].split(".")[0] in _HEADINGS:
            return True
        return any(own.startswith(c + "/") for c in chosen if c not in _WHOLE)

    return [b for b, c in zip(open_blocks, held) if b.root in whole or stays(b.path, c)]


def _smooth(values: list[float], width: float) -> list[float]:
    """Gaussian smoothing over neighbours in page order."""
    reach = max(1, round(2 * width))
    kernel = [math.exp(-d * d / (2 * width * width)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            k = kernel[abs(i - j)]
            total += k * values[j]
            weight += k
        out.append(total / weight)
    return out


def main_text(page: str) -> str:
    return "\n".join(b.text for b in select(blocks(page)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null page is empty and has the empty text.

    Repeated rows give a row each, other columns are not read, an empty table gives no rows.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
