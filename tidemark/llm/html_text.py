"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one for each block of the page, in page order.  Menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, known by their elements, roles and class names, are left
out, without a line of their own.  A class name tells by its first or last word and not where it names a state
(``has-sidebar``), and an element known by class names only stays if it holds the heaviest article or over half of the
page's text.  A line weighs as many characters as it has outside links; a line of a marked article has all its
characters and ``THRESHOLD`` more.  The weights of ``WINDOW`` lines from each line on are summed, article and
remaining page each by itself: the text surges where a sum exceeds the threshold, and dives where a sum is nothing;
everything between a surge and its dive is kept, and so are the short lines just before it.  What surges outside of a
marked article is kept where a stretch of it has more than ``MARK`` times the characters of the heaviest article,
which is a teaser then; otherwise it is taken for the boilerplate around the article.

Defined results: null, empty and unmarked html give an empty text or the text as one block; unclosed elements end with
their parents, unknown references stay as they are; repeated rows are extracted alike; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

WINDOW = 3  # lines whose weights are summed
THRESHOLD = 86  # characters in a window from which text counts as a surge
MARK = 2  # weight of a character in a marked article against one outside

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
DROPPED = set(
    "nav aside footer form menu button select option dialog head canvas object audio video map datalist label".split()
)
DROPPED_ROLES = set(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split()
)
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments "
    "consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "pagination pager paywall popup promo promoted promotion recommended related replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
STATES = set("has with without no not is are open opened closed enabled disabled on off active visible hidden".split())
ARTICLE_NAMES = {"articlebody"}
CODE = {"pre", "code"}  # class names in them tell of syntax
KEPT = {"html", "body", "main"}  # never dropped by their class names
# Elements that a new one of the same group ends.
ENDS = {
    "p": {"p"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = set("ul ol table div section article main body td th dl menu select blockquote".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>""", re.S
)
NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def names_boilerplate(value: str) -> bool:
    """Does a class name or id begin or end with a word for boilerplate, other than as a state of the page?"""
    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        if words and (words[0] in DROPPED_NAMES or words[-1] in DROPPED_NAMES) and not STATES.intersection(words):
            return True
    return False


def kind_of(name: str, attributes: str, in_article: bool, in_code: bool = False) -> tuple[bool, bool, bool]:
    """Is an element to be dropped, does it mark the article, and do its class names tell of boilerplate?"""
    dropped = name in DROPPED or (name == "header" and not in_article)
    article = name in ("article", "main")
    doubtful = False
    if not attributes:
        return dropped, article, doubtful
    for key, value in NAMES.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        low = value.lower()
        if key == "role":
            dropped |= low in DROPPED_ROLES
            article |= low in ("main", "article")
        elif key == "itemprop":
            article |= low in ARTICLE_NAMES
        elif key == "hidden" or (key == "aria-hidden" and low == "true"):
            dropped |= name not in KEPT
        elif key == "style":
            dropped |= name not in KEPT and "display:none" in low.replace(" ", "")
        elif key in ("class", "id") and name not in KEPT:
            if name == "article":
                dropped |= any(c in ("comment", "comments", "reply") or c.startswith("comment-") for c in low.split())
            else:
                doubtful |= not in_code and names_boilerplate(value)
    return dropped, article, doubtful and not dropped


def stays(parents: list[int], sizes: list[int], marks: list[list[int]]) -> list[bool]:
    """Which elements known by class names stay, inner ones first; number 0 is the page.

    ``sizes`` has the characters of each outside of inner ones, ``marks`` the innermost one around each article and the
    article's characters.
    """
    sizes, stay, whole = sizes[:], [False] * len(parents), sum(sizes)
    held, most = max(marks, key=lambda m: m[1], default=[0, 0])
    for k in range(len(parents) - 1, 0, -1):
        stay[k] = 2 * sizes[k] > whole or (k == held and most > 0)
        if stay[k]:
            sizes[parents[k]] += sizes[k]
            held = parents[k] if k == held else held
    stay[0] = True
    for k in range(1, len(parents)):
        stay[k] &= stay[parents[k]]
    return stay


def lines_of(page: str) -> tuple[list[tuple[str, int, int]], bool]:
    """Lines with their weights outside links and the number of their outermost article or 0; does any have text?"""
    found: list[tuple[str, int, int, int]] = []  # with the innermost element that class names tell to drop
    stack: list[tuple[str, bool, bool, bool]] = []  # name, dropped, article, doubtful
    parts: list[str] = []
    parents, sizes, inside = [0], [0], [0]  # doubtful elements; those that are open
    marks: list[list[int]] = []
    opened: list[int] = []  # articles that are open, by their place in marks
    dropped = links = linked = codes = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((text, max(0, len(text) - linked), opened[0] + 1 if opened else 0, inside[-1]))
            sizes[inside[-1]] += max(0, len(text) - linked)
            for k in opened:
                marks[k][1] += len(text) if marks[k][0] == inside[-1] else 0
        linked = 0

    def pop() -> None:
        nonlocal dropped, links, codes
        name, was_dropped, was_article, was_doubtful = stack.pop()
        if was_doubtful:
            flush()
            inside.pop()
        dropped -= was_dropped
        if was_article:
            opened.pop()
        links -= name == "a"
        codes -= name in CODE

    def take(text: str) -> None:
        nonlocal linked
        if text and not dropped:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(" ".join(text.split())) if links else 0

    while match := TAG.search(page, at):
        take(page[at : match.start()])
        at = match.end()
        name = match[2].lower() if match[2] else ""
        if not name:
            continue
        if name in BLOCKS and not dropped:
            flush()
        elif name == "br" and not dropped:
            parts.append("\n")
        if match[1]:
            if any(open_name == name for open_name, *_ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID or match[3].endswith("/"):
            continue
        while name in ENDS:
            here = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ENDS[name] | SCOPE), None)
            if here is None or stack[here][0] not in ENDS[name] or (name in ("td", "th") and stack[here][0] in SCOPE - ENDS[name]):
                break
            while len(stack) > here:
                pop()
        is_dropped, is_article, is_doubtful = kind_of(name, match[3], bool(opened), codes > 0)
        is_article, is_doubtful = is_article and not is_dropped, is_doubtful and not dropped
        if (is_dropped or is_doubtful) and not dropped:
            flush()
        if is_doubtful:
            parents.append(inside[-1])
            sizes.append(0)
            inside.append(len(parents) - 1)
        stack.append((name, is_dropped, is_article, is_doubtful))
        dropped += is_dropped
        if is_article:
            opened.append(len(marks))
            marks.append([inside[-1], 0])
        links += name == "a"
        codes += name in CODE
    take(page[at:])
    flush()
    stay = stays(parents, sizes, marks)
    lines = [(text, weight, in_article) for text, weight, in_article, k in found if stay[k]]
    return lines, any(in_article for _, _, in_article in lines)


def surges(weights: list[int], threshold: int) -> list[tuple[int, int]]:
    """Stretches of lines from each surge, with the short lines just before it, to its dive."""
    padded = np.r_[np.array(weights, dtype=np.int64), np.zeros(WINDOW, dtype=np.int64)]
    sums = sum(padded[k : k + len(weights)] for k in range(WINDOW))
    out, start, dived = [], None, 0
    for k, (weight, total) in enumerate(zip(weights, sums, strict=True)):
        if start is None and total > threshold and weight > 0:
            start = k
            while start > dived and weights[start - 1] > 0:
                start -= 1
        elif start is not None and total == 0:
            out.append((start, k))
            start, dived = None, k
    return out if start is None else [*out, (start, len(weights))]


def main_blocks(page: str) -> list[str]:
    """Blocks of the main text in page order."""
    lines, marked = lines_of(page)
    if not lines:
        return []
    regions, first = [], 0  # lines of one article, or of the page between articles
    for k in range(1, len(lines) + 1):
        if k == len(lines) or lines[k][2] != lines[first][2]:
            regions.append((first, k, lines[first][2]))
            first = k
    weights = [len(text) + THRESHOLD if inside else weight for text, weight, inside in lines]
    most = max(sum(weights[k : k + WINDOW]) for k in range(len(lines)))
    threshold = THRESHOLD if marked or most > THRESHOLD else 0
    found = [
        (a + first, b + first, inside)
        for first, end, inside in regions
        for a, b in surges(weights[first:end], threshold)
    ]

    def heaviest(marks: bool) -> int:
        sizes = (sum(len(t) if marks else w for t, w, _ in lines[a:b]) for a, b, inside in found if bool(inside) == marks)
        return max(sizes, default=0)

    outside = not marked or heaviest(False) > MARK * heaviest(True)
    return [text for a, b, inside in found if inside or outside for text, _, _ in lines[a:b]]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page or ""))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns ``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    rows = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")
    )
    schema = StructType(
        [*rows.schema.fields[:2], StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [main_text(page.as_py()) for page in batch.column(2)]
                columns = [batch.column(0), batch.column(1), pa.array(texts), pa.array([len(t) for t in texts])]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return rows.mapInArrow(run, schema)
