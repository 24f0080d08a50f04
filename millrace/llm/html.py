"""Main text of web pages by tag-path ratios.

Every text node of a page belongs to a root-to-leaf tag path. Per path the text length, the number of
punctuation marks and the number of nodes are added up; length and punctuation ratios are fused into
one score; scores are smoothed over the tag tree (a path weighs less with every step between the two,
and more with its text) in one pass up and one down; paths above a threshold are content. A short heading
beside long paragraphs is carried by its neighbours, a long menu of short links is not.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from millrace.llm.common import map_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|title)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Elements without content, elements whose start ends an open paragraph, and inline
# elements, which do not part words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
# Elements and words in class, id or role that mark page furniture.
FURNITURE_TAGS = frozenset("head nav footer aside form button select option dialog menu canvas audio video".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary contentinfo consent cookie cookies disqus footer masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion recommended "
    "related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
#: Words that stand beside such a word in a compound class without changing what it marks.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box button buttons container content fixed form global group inner item items left "
    "link links list main outer page panel primary right row secondary section site sticky top wrap wrapper".split()
)
#: Elements that no class makes page furniture.
NEVER_FURNITURE = frozenset(("html", "body", "main", "article"))
SELF_CLOSING_PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")

#: Paths whose smoothed score is below this share of the best one are not content.
THRESHOLD = 0.15
#: What is left of a path's weight one step away in the tag tree.
DECAY = 0.6


def marks_furniture(mark: str) -> bool:
    """Whether one class, id or role names page furniture: the word itself, or a compound of nothing else.

    ``sidebar`` and ``cookie-notice`` do, ``has-sidebar``, ``ad-free`` and ``search-results`` do not.
    """
    parts = re.findall(r"[a-z]+", mark)
    return any(p in FURNITURE_WORDS for p in parts) and all(p in FURNITURE_WORDS or p in NEUTRAL_WORDS for p in parts)


def _furniture(tag: str, marks: list[str], in_article: bool) -> bool:
    if tag in FURNITURE_TAGS:
        return True
    if tag not in NEVER_FURNITURE and any(map(marks_furniture, marks)):
        return True
    # The header of a page is furniture, the header of an article holds its title.
    return tag == "header" and not in_article


class TagTree:
    """The distinct tag paths of a page as a tree; a path is a number, and its parent's is smaller."""

    def __init__(self):
        self.parent, self.tag, self.numbers = [-1], [""], {}

    def child(self, of: int, tag: str, label: str) -> int:
        number = self.numbers.setdefault((of, label), len(self.parent))
        if number == len(self.parent):
            self.parent.append(of)
            self.tag.append(tag)
        return number


def text_nodes(page: str) -> tuple[TagTree, list[tuple[int, bool, int, str]]]:
    """The tag paths, and (path, furniture, block number, text) of every text node, in page order.

    A path tells elements apart by tag and class; ids, which mostly occur once, are left out.
    """
    tree, stack = TagTree(), []  # of (tag, path, furniture)
    opened: dict[str, list[int]] = defaultdict(list)  # where each tag is open in the stack
    out, block = [], 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            path, bad = stack[-1][1:] if stack else (0, False)
            out.append((path, bad, block, text))
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if m["end"]:
            if opened[tag]:
                pop_to(opened[tag][-1])
            continue
        if tag == "body" and opened["head"]:
            pop_to(opened["head"][0])
        if tag in ENDS_PARAGRAPH:
            if opened["p"]:
                pop_to(opened["p"][-1])
        elif tag in SELF_CLOSING_PEERS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SELF_CLOSING_PEERS[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div"):
                    break
        if tag in VOID:
            continue
        found = ATTRIBUTE.findall(m["attrs"] or "")
        marks = [x for a in found for x in (a[1] or a[2] or a[3]).lower().split()]
        classes = [x for a in found if a[0].lower() != "id" for x in (a[1] or a[2] or a[3]).lower().split()]
        bad = bool(stack) and stack[-1][2]
        bad = bad or _furniture(tag, marks, bool(opened["article"] or opened["main"]))
        if not (m["attrs"] or "").endswith("/") or tag not in ("svg", "path"):
            path = tree.child(stack[-1][1] if stack else 0, tag, ".".join([tag, *classes]))
            opened[tag].append(len(stack))
            stack.append((tag, path, bad))
    return tree, out


def content_paths(tree: TagTree, nodes: list[tuple[int, bool, int, str]]) -> set[int]:
    """The paths whose fused, smoothed ratio passes the threshold."""
    totals: dict[int, list[int]] = {}
    for path, bad, _, text in nodes:
        if bad or not text.strip():
            continue
        t = totals.setdefault(path, [0, 0, 0])
        t[0] += len(text.strip())
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += 1
    if not totals:
        return set()
    n = len(tree.parent)
    in_link = [False] * n
    for v in range(1, n):
        in_link[v] = tree.tag[v] == "a" or in_link[tree.parent[v]]
    # Text-to-path ratio times punctuation ratio; links count for a fifth. A path weighs as much as its text.
    weight, score = [0.0] * n, [0.0] * n
    for p, (length, marks, k) in totals.items():
        weight[p] = float(length)
        score[p] = length * (length / k) * math.sqrt(1 + marks / k) * (0.2 if in_link[p] else 1.0)
    # Smoothing over the tag tree: a pass up adds what lies below a path, a pass down all the rest.
    for values in (weight, score):
        for v in range(n - 1, 0, -1):
            values[tree.parent[v]] += DECAY * values[v]
        for v in range(1, n):
            values[v] += DECAY * (values[tree.parent[v]] - DECAY * values[v])
    smooth = {p: score[p] / weight[p] for p in totals}
    best = max(smooth.values())
    return {p for p, s in smooth.items() if s >= THRESHOLD * best}


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, joined by one space.

    The content path that holds most text names the article: its enclosing ``article`` or ``main``
    element, or else the element around it, beside the other content paths. Whatever else stands
    inside that element and is not page furniture (short items, table cells, captions) is kept.
    """
    if not page:
        return ""
    tree, found = text_nodes(page)
    nodes = [(p, bad, b, references.unescape(t)) for p, bad, b, t in found]
    chosen = content_paths(tree, nodes)
    if not chosen:
        return ""
    mass: dict[int, int] = {}
    for path, bad, _, text in nodes:
        if path in chosen and not bad:
            mass[path] = mass.get(path, 0) + len(text.strip())
    heaviest = max(mass, key=lambda p: (mass[p], -p))
    above = [heaviest]
    while above[-1] > 0:
        above.append(tree.parent[above[-1]])
    # The outermost article or main element around it, or else the element itself.
    inner = [v for v in above if tree.tag[v] in ("article", "main")]
    root = inner[-1] if inner else tree.parent[heaviest]
    # The body of a page is no article: there, only the chosen paths count.
    inside = [False] * len(tree.parent)
    if root > 0 and tree.tag[root] not in ("body", "html"):
        for v in range(root, len(inside)):
            inside[v] = v == root or inside[tree.parent[v]]
    held, last = [], None
    for path, bad, block, text in nodes:
        if bad or not (inside[path] or (path in chosen and not inner)):
            continue
        if last is not None and block != last:
            held.append(" ")
        held.append(text)
        last = block
    return " ".join("".join(held).split())


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without content, have the empty text. Rows that repeat give equal
    rows, other columns are ignored, nulls in page_id and url pass through, an empty table gives an
    empty result. A page is the unit of work: nothing is shuffled.
    """

    def step(_, ids, urls, pages):
        texts = [main_text(p) for p in pages]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(pages, ["page_id", "url", "html"], step, "page_id long, url string, text string, n_chars long")
