"""Main text of web pages by minimum-cut labelling.

A page is a row of blocks: runs of text between block-level tags, in page order.
Each block gets costs from a classifier, which become the capacities of its
links to source (content) and sink (boilerplate). Neighbours in the page and
siblings in the DOM are linked by smoothness edges that fall with their distance
in the tree. A maximum flow finds the cheapest cut, whose source side is the text.

The classifier has two parts: fixed hints of tags, roles and class names (which
outweigh all edges of a block where they are sure), and a logistic model of the
block's shape, fitted on blocks that hints label, in at most ``TRAIN_PAGES``
distinct pages, drawn by hash. Shapes are patterns of twelve bits, so the driver
gets 8,192 counts at most, and without labelled blocks the prior weights hold.

Blocks end at block-level tags. Character references are decoded, white space
(as Python's str.split has it, no-break spaces included) becomes one space, a
line break counts as white space, and empty blocks vanish. Titles, comments,
scripts, styles and other raw elements aren't text; one that never ends reaches
to the end of the page. Missing end tags are implied as browsers do. Ties of the cut
are content. Null html is empty, as is the text of a page without content. Very
long pages count whole, repeated rows give a row each, and a null page_id or url
is passed on. Other columns of the table, whatever their names, are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import map_batches, texts_of

#: Distinct pages that the shape model is fitted on, at most.
TRAIN_PAGES = 2000
#: Costs are whole numbers, so many to one unit of log-odds.
UNIT = 1000

_WORDS = lambda text: frozenset(text.split())
BLOCK = _WORDS(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
RAW = _WORDS("script style title textarea template noscript iframe object svg canvas select button math noembed noframes xmp audio video")
HEADINGS, PARAGRAPHS, CELLS = _WORDS("h1 h2 h3 h4 h5 h6"), _WORDS("p blockquote pre"), _WORDS("li td th dd dt summary caption")
LEAF = HEADINGS | PARAGRAPHS | CELLS
#: A start tag ends an open element of the first group, if none of the second lies between.
ENDS = {"li": (_WORDS("li"), _WORDS("ul ol menu dir")), "dd": (_WORDS("dd dt"), _WORDS("dl")), "dt": (_WORDS("dd dt"), _WORDS("dl")), "tr": (_WORDS("tr"), _WORDS("table"))}
ENDS |= {x: (_WORDS("td th"), _WORDS("tr table")) for x in ("td", "th")}

BAD_TAGS = _WORDS("nav aside footer menu dialog form fieldset search")
BAD_ROLES = _WORDS("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status")
BAD_WORDS = _WORDS(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead"
    " cookie cookies consent gdpr notice newsletter subscribe signup login popup modal overlay share sharing social related recommended widget"
    " comment comments disqus reply replies respond pagination pager toolbar copyright"
)
GOOD_WORDS = _WORDS("content article post entry story main body text prose markdown")
#: With these in a class name, a bad word tells of the layout around it.
LAYOUT = _WORDS("has with no without wrapper wrap container page site layout")
ARTICLE, MAIN, NAMED, OUTSIDE, BAD = 6.0, 3.0, 2.5, -3.0, -12.0

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?|([^<]+)|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BOILERPLATE = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign (?:in|up)\b|\blog ?in\b|\bread more\b|\bprivacy policy\b", re.I)


class Element:
    __slots__ = ("tag", "number", "bad", "good")

    def __init__(self, tag: str, number: int, bad: str, good: float):
        self.tag, self.number, self.bad, self.good = tag, number, bad, good


class Block:
    """Text, characters in links, tag, numbers of the open elements, and what the hints say."""

    __slots__ = ("text", "linked", "tag", "path", "bad", "good")

    def __init__(self, text, linked, tag, path, bad, good):
        self.text, self.linked, self.tag, self.path, self.bad, self.good = text, linked, tag, path, bad, good


def hints(tag: str, attributes: str, over: Element) -> tuple[str, float]:
    """What of the page is boilerplate by name ("" or the reason) and how much speaks for content, under the element over."""
    bad, good = over.bad, over.good
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = found.get("role", "").lower()
    if tag == "main" or role == "main":
        return "", max(good, MAIN)
    if tag == "article" or role == "article":
        bad, good = "" if bad == "form" else bad, ARTICLE
    elif tag in BAD_TAGS or (tag == "header" and good < MAIN):
        bad = bad or ("form" if tag == "form" else tag)
    if role in BAD_ROLES:
        bad = bad or ("form" if role == "form" else role)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        bad = bad or "hidden"
    if tag not in ("html", "body") and ("class" in found or "id" in found):
        named = {x.lower() for x in NAME_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        bad_names = named & BAD_WORDS
        if bad_names <= {"header"} and named & GOOD_WORDS or named & LAYOUT:
            bad_names = set()
        if bad_names:
            bad = bad or "name"
        elif named & GOOD_WORDS:
            good = max(good, NAMED)
    return bad, good


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    stack, found, buffer = [Element("", 0, "", 0.0)], [], []
    at, size, number, linked, link_depth = 0, len(page), 0, 0, 0

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                top = stack[-1]
                found.append(Block(text, min(linked, len(text)), top.tag, tuple(x.number for x in stack), top.bad, top.good))
            buffer.clear()
        linked = 0

    def close(tags, guard=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in guard:
                return

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[7] or m[0] == "<":
            run = entities.unescape(m[0]) if "&" in m[0] else m[0]
            buffer.append(run)
            if link_depth:
                linked += len(run.strip())
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not ending:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
        elif tag in BLOCK:
            flush()
            if ending:
                close({tag})
            else:
                close({"p"}, LEAF - {"p"})
                if tag in ENDS:
                    close(*ENDS[tag])
                if tag != "hr":
                    number += 1
                    stack.append(Element(tag, number, *hints(tag, attributes, stack[-1])))
            if len(stack) < link_depth:
                link_depth = 0
        elif tag == "a":
            link_depth = 0 if ending else len(stack)
        elif tag == "br":
            buffer.append(" ")
    flush()
    return found


def shape(block: Block) -> int:
    """Twelve bits on length, links, punctuation and tag."""
    text, n = block.text, len(block.text)
    marks = text.count(",") + text.count(".") + text.count(";")
    bits = (
        n >= 40, n >= 120, n >= 400, 3 * block.linked >= n, 5 * block.linked >= 4 * n, text[-1] in ".!?…:;\"'»”)", block.tag in HEADINGS, block.tag in PARAGRAPHS, block.tag in CELLS,
        marks >= 3, n < 400 and BOILERPLATE.search(text) is not None, n < 400 and 3 * sum(c.isdigit() for c in text) > n,
    )
    return sum(1 << i for i, b in enumerate(bits) if b)


BITS = 12
#: Log-odds of content without any labelled block: the constant, then one a bit of shape.
PRIOR = np.array([-0.6, 0.6, 0.9, 0.8, -1.5, -2.0, 0.8, 0.8, 0.9, -0.3, 0.5, -2.0, -0.5])


def fit_shapes(counts: list[tuple[int, int, int]], strength: float = 0.01) -> np.ndarray:
    """Log-odds of content of every shape, from counts (shape, label, n): logistic regression about the prior weights."""
    table = np.array([[1, *[p >> i & 1 for i in range(BITS)]] for p in range(1 << BITS)], float)
    w = PRIOR.copy()
    if len({label for _, label, _ in counts}) == 2:
        x = table[[p for p, _, _ in counts]]
        y = np.array([label for _, label, _ in counts], float)
        n = np.array([c for _, _, c in counts], float)
        for label in (0, 1):
            n[y == label] /= 2 * n[y == label].sum()
        loss = lambda w: n @ np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)) + strength / 2 * ((w - PRIOR) ** 2).sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            slope = x.T @ (n * (y - p)) - strength * (w - PRIOR)
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), slope)
            while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
                step /= 2
            w += step
            if np.abs(step).max() < 1e-9:
                break
    return table @ w


def graph(found: list[Block], odds: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Whole-number log-odds of content of each block and the smoothness edges (i, j, capacity)."""
    inside = any(b.good >= MAIN and not b.bad for b in found)
    score, edges, last = [], [], {}
    for i, b in enumerate(found):
        hint = BAD if b.bad else b.good if b.good else OUTSIDE if inside else 0.0
        score.append(round(UNIT * (min(4.0, max(-4.0, odds[shape(b)])) + hint)))
        if i:
            other, shared = found[i - 1].path, 0
            for x, y in zip(other, b.path, strict=False):
                if x != y:
                    break
                shared += 1
            edges.append((i - 1, i, round(UNIT * 1.6 / max(1, len(other) + len(b.path) - 2 * shared))))
        parent = b.path[-2] if b.tag in LEAF and len(b.path) > 1 else b.path[-1]
        if last.get(parent, i) < i - 1:
            edges.append((last[parent], i, round(UNIT * 0.4)))
        last[parent] = i
    return score, edges


def minimum_cut(score: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Source side of the cut that minimises the capacities it breaks; ties go to the source.

    A block whose own score outweighs all its edges has the same label in every
    minimum cut. It is merged with its terminal, until none is left; only
    what remains goes through the maximum flow, part by part.
    """
    n = len(score)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    score, label = list(score), [None] * n
    weight = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(score[i]) > weight[i]:
            label[i] = score[i] > 0
            for j, c in near[i].items():
                if label[j] is None:
                    score[j] += c if label[i] else -c
                    weight[j] -= c
                    queue.append(j)
    for i in range(n):
        if label[i] is not None:
            continue
        part, label[i] = [i], True
        for x in part:
            for j in near[x]:
                if label[j] is None:
                    label[j] = True
                    part.append(j)
        members = set(part)
        inner = {x: {j: c for j, c in near[x].items() if j in members} for x in part}
        for x in _sink_side({x: score[x] for x in part}, inner):
            label[x] = False
    return label


def _sink_side(score: dict[int, int], near: dict[int, dict[int, int]]) -> set[int]:
    """Nodes that can still reach the sink after a maximum flow (Dinic's algorithm)."""
    if all(s >= 0 for s in score.values()):
        return set()
    left = {x: dict(c) for x, c in near.items()}
    source = {x: s for x, s in score.items() if s > 0}
    sink = {x: -s for x, s in score.items() if s < 0}
    while True:
        level = {x: 0 for x, c in source.items() if c}
        order = deque(level)
        reached = False
        while order:
            x = order.popleft()
            reached = reached or bool(sink.get(x))
            for j, c in left[x].items():
                if c and j not in level:
                    level[j] = level[x] + 1
                    order.append(j)
        if not reached:
            break
        ahead = {x: [j for j in left[x] if level.get(j) == level[x] + 1] for x in level}
        for start in [x for x, c in source.items() if c]:
            path = [start]
            while path and source[start]:
                x = path[-1]
                if sink.get(x):
                    push = min([source[start], sink[x], *[left[a][b] for a, b in zip(path, path[1:], strict=False)]])
                    source[start] -= push
                    sink[x] -= push
                    for a, b in zip(path, path[1:], strict=False):
                        left[a][b] -= push
                        left[b][a] += push
                    path = [start]
                    continue
                while ahead[x] and not left[x][ahead[x][-1]]:
                    ahead[x].pop()
                if ahead[x]:
                    path.append(ahead[x][-1])
                else:
                    path.pop()
                    if path:
                        ahead[path[-1]].pop()
    reach = {x for x, c in sink.items() if c}
    order = deque(reach)
    while order:
        x = order.popleft()
        for j in near[x]:
            if j not in reach and left[j][x]:
                reach.add(j)
                order.append(j)
    return reach


def main_text(page: str, odds: np.ndarray) -> str:
    """The content blocks of a page, joined by line feeds."""
    found = blocks(page)
    kept = minimum_cut(*graph(found, odds))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def shape_counts(pages: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    """shape, label, n of the blocks that hints label, in the distinct pages with the smallest hashes."""
    hashed = pages.select("html", F.xxhash64("html").alias("hash")).filter("html IS NOT NULL")
    limit = hashed.select("hash").distinct().orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    some = hashed.filter(F.col("hash") <= F.lit(limit)).dropDuplicates(["hash"])

    def one(batch: pa.RecordBatch) -> dict:
        seen: dict[tuple[int, int], int] = {}
        for page in texts_of(batch, "html"):
            for b in blocks(page.decode("utf-8", "replace")):
                if b.bad or b.good >= MAIN:
                    key = (shape(b), 0 if b.bad else 1)
                    seen[key] = seen.get(key, 0) + 1
        return {"shape": [k[0] for k in seen], "label": [k[1] for k in seen], "n": list(seen.values())}

    counted = map_batches(some.select("html"), one, "shape int, label int, n long", column="html")
    return counted.groupBy("shape", "label").agg(F.sum("n").alias("n"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    odds = fit_shapes(sorted((r[0], r[1], r[2]) for r in shape_counts(rows).collect()))  # two rows a shape

    def one(batch: pa.RecordBatch) -> dict:
        texts = [main_text(page.decode("utf-8", "replace"), odds) for page in texts_of(batch, "html")]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_batches(rows, one, "page_id long, url string, text string, n_chars long", column="html")
