"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of elements (inline elements do
not count). Per path, text length and punctuation are summed and divided by its number of
blocks; both ratios are smoothed over the blocks of the page in order and multiplied. Paths
whose mean reaches a share of the best one are content. Blocks below the container of the best
path that no rule takes for page furniture belong to the text as well: headings and short
paragraphs have low ratios of their own.

Row-local: one Arrow pass without a shuffle.

Defined results: a null or empty page, or one without content, has an empty text. Character
references are decoded once. Broken markup is read as browsers do in the common cases: a new
paragraph ends the open one, end tags without a start are ignored, what follows the last ``>`` is
text. Repeated rows each get a row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadloom.llm.textarrays import strings
from broadloom.llm.rows import prepare

#: A path is content from this share of the best path's value on.
LEAST_SHARE = 0.3
#: Weight of a path inside an element that is declared to be the main content.
DECLARED = 8.0

# Elements by their role.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math semantics annotation annotation-xml mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded "
    "mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr "
    "mlabeledtr mtd maction".split()
)
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript template iframe noframes noembed xmp svg".split())
FURNITURE = set("head nav footer aside form button select option dialog menu fieldset object canvas audio video".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
MAIN = {"article", "main"}
#: Besides inline elements, what is never page furniture by its class or id.
TEXT = set("p h1 h2 h3 h4 h5 h6 hgroup".split())

# Words in class and id that mark page furniture; the first list only as whole words.
_WHOLE = "ad|ads|adv|nav|menu|side|share|social|tags|meta|promo|popup|modal|login|search|legal|tool|tools|pager|skip|top|bottom"
_PART = (
    "advert|sponsor|banner|cookie|consent|gdpr|notice|newsletter|subscri|signup|sidebar|navbar|navigation|breadcrumb|"
    "masthead|footer|header|comment|disqus|replies|respond|sharing|related|recommend|widget|toolbar|pagination|copyright|overlay|"
    "menu"
)
_NOISE = re.compile(rf"(?:^|[\s_-])(?:{_WHOLE})(?:$|[\s_\d-])|{_PART}", re.IGNORECASE)
# Inside declared main content only these count, and only as whole words.
_NOISE_IN_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisements?|advertising|comments?|disqus)(?:$|[\s_\d-])", re.IGNORECASE
)
_DECLARES = re.compile(r"role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articlebody", re.IGNORECASE)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+|[^>]*+)>",
    re.DOTALL,
)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟،]")


# What can stand in a page without a closing bracket after it.
_ENDLESS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.DOTALL)


class _Block:
    __slots__ = ("path", "parts", "text", "main")

    def __init__(self, path: int, main: int):
        self.path, self.parts, self.main, self.text = path, [], main, ""


def blocks(html: str) -> tuple[list[_Block], list[int]]:
    """Blocks with text outside page furniture, in page order, and the parent of each path.

    Paths are numbers: 0 is the root, every other path is a tag below its parent. ``main`` is the
    path of the innermost declared main element, 0 outside.
    """
    out: list[_Block] = []
    # Open elements by name, whether each is furniture, and where those of a name stand.
    stack: list[tuple[str, bool]] = []
    opened: dict[str, list[int]] = {}
    path: list[int] = [0]
    parents: list[int] = [0]
    numbers: dict[tuple[int, str], int] = {}
    mains: list[tuple[int, int]] = []
    noise = 0
    closing = html.rfind(">")
    current: _Block | None = None
    at = 0

    def text(raw: str) -> None:
        nonlocal current
        if noise or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = _Block(path[-1], mains[-1][1] if mains else 0)
            out.append(current)
        current.parts.append(unescape(raw))

    def close(upto: int) -> None:
        nonlocal noise, current
        while len(stack) > upto:
            name, noisy = stack.pop()
            opened[name].pop()
            noise -= noisy
            if name not in INLINE:
                current = None
                path.pop()
                if mains and mains[-1][0] > len(path):
                    mains.pop()

    def find(names: set[str], stop: set[str]) -> int:
        """The innermost open element of these names, unless one that stops the search is inside it."""
        last = max((opened[n][-1] for n in names if opened.get(n)), default=-1)
        return last if all(opened[n][-1] <= last for n in stop if opened.get(n)) else -1

    def token(pos: int) -> re.Match[str] | None:
        """The next one; behind the last closing bracket no tag is looked for, as none can end."""
        found = _TOKEN.search(html, pos, closing + 1) if pos <= closing else None
        if found is None:
            return _ENDLESS.search(html, pos)
        cut = found["name"] is None and found.end() == closing + 1
        return (cut and _ENDLESS.match(html, found.start())) or found

    pos = 0
    while found := token(pos):
        text(html[at : found.start()])
        at = pos = found.end()
        name = found["name"] if found.re is _TOKEN else None
        if name is None:
            if found.group().startswith("<![CDATA["):
                text(found.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if found["end"]:
            i = find({name}, {"table", "article", "main"} if name in INLINE else set())
            if i >= 0:
                close(i)
            elif name == "p":
                current = None
            continue
        if name in RAW:
            if not found["rest"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = pos = end.end() if end else len(html)
            continue
        if name in VOID:
            if name == "br" and current is not None:
                current.parts.append(" ")
            elif name == "hr":
                current = None
            continue
        if name not in INLINE:
            i = find({"p"}, {"table", "td", "th", "li", "blockquote", "div", "section", "article", "main", "button"})
            if i >= 0:
                close(i)
            if name in CLOSED_BY:
                i = find(CLOSED_BY[name], {"ul", "ol", "dl", "table", "select", "html"} - {name})
                if i >= 0:
                    close(i)
        rest = found["rest"]
        label = " ".join("".join(x) for x in _NAMES.findall(rest)) if "=" in rest else ""
        in_main = bool(mains)
        noisy = name in FURNITURE or (name == "header" and not in_main) or bool(rest and _HIDDEN.search(rest))
        # What is declared to be the content stays whatever it is called, as do whole pages.
        declared = name in MAIN or bool("=" in rest and _DECLARES.search(rest))
        if label and not noisy and not declared and name not in ("html", "body") and name not in INLINE | TEXT:
            noisy = bool((_NOISE_IN_MAIN if in_main else _NOISE).search(label))
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, noisy))
        noise += noisy
        if name not in INLINE:
            current = None
            step = numbers.setdefault((path[-1], name), len(parents))
            if step == len(parents):
                parents.append(path[-1])
            path.append(step)
            if declared and not noise:
                mains.append((len(path), step))
    text(html[at:])
    for block in out:
        block.text = " ".join("".join(block.parts).split())
    return [block for block in out if block.text], parents


def _smooth(values: np.ndarray) -> np.ndarray:
    """A narrow Gaussian over neighbouring blocks."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weights = np.convolve(np.ones(len(values)), kernel, "same")
    return np.convolve(values, kernel, "same")[: len(values)] / weights[: len(values)]


def main_text(html: str | None) -> str:
    found, parents = blocks(html or "")
    if not found:
        return ""
    number = {path: i for i, path in enumerate(dict.fromkeys(b.path for b in found))}
    own = np.array([number[b.path] for b in found])
    per_path = np.bincount(own)
    length = np.bincount(own, [len(b.text) for b in found]) / per_path
    marks = np.bincount(own, [len(_PUNCTUATION.findall(b.text)) for b in found]) / per_path
    if len(found) >= 5:
        fused = _smooth(length[own]) * (1 + _smooth(marks[own]))
    else:
        fused = length[own] * (1 + marks[own])
    weight = np.array([DECLARED if b.main else 1.0 for b in found])
    value = np.bincount(own, fused * weight) / per_path
    best = found[int(np.flatnonzero(own == value.argmax())[0])]
    content = value >= LEAST_SHARE * value.max()
    container = best.main or parents[best.path] or best.path
    # Parents have smaller numbers than their children.
    within = [False] * len(parents)
    for step, parent in enumerate(parents):
        within[step] = step == container or within[parent]
    # Inside a declared main element nothing but its blocks is content.
    taken = [
        within[b.path] or (content[i] and not best.main)
        for b, i in zip(found, own.tolist(), strict=True)
    ]
    return "\n".join(b.text for b, keep in zip(found, taken, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        pages["html"].cast("string").alias("html"),
    )
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
