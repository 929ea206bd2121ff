"""Main text of pages by wrappers: what same-host pages share is template, what varies in the article is content."""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import prepare
from starloom.session import barrier

#: Pages of a host that its wrapper is induced from: of four times as many different ones, those with the smallest hash of
#: their text, the ones of middle length.
SAMPLE_PAGES = 6
#: Pages that must agree on a text for it to be template.
LEAST_PAGES = 3
#: Parts of a host's pages that samples are picked from first.
HOST_PARTS = 8
#: Children of a node that are aligned at once; longer lists are cut where both have an equal child, and into stretches.
ALIGNED_CHILDREN = 200
#: Share of the varying text of an element that one of its containers holds if that is where the content is.
DOMINANT = 0.6
#: What the largest of the other containers may hold, as a share of that one, where no name tells what they are.
SMALL = 0.25
#: A list below the content is a menu if so much of its text is in links, and if it has so many on each page.
LINK_SHARE = 0.7
LINKS = 3
#: Elements inside each other that an alignment can follow.
DEEPEST = 1_000_000

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
SKIPPED = frozenset("script style textarea title noscript iframe noembed noframes xmp template head nav header footer aside form button select option svg canvas object menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag ends, and the elements it does not look beyond.
CLOSES_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "figcaption", "summary"}
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in a class, an id or a role that name something beside the article.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|footer|foot|comments?|commentlist|respond|replies|disqus|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|search|skip|hidden)"
    r"(?=$|[\s_-])",
    re.I,
)
#: Elements that name the article, and those a content path ends in without them: what is below others is part of a text.
NAMED = ("article", "main")
CONTAINERS = frozenset((*NAMED, "html", "body", "div", "section", "center"))
#: Elements whose text never shows, and those that menus are made of.
HARD = RAW | frozenset("head button select option svg canvas object".split())
MENUS = frozenset("div section ul ol table p dl".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WHITE = re.compile(r"\s+")


class Node:
    """An element, or a text if ``tag`` is empty."""

    __slots__ = ("tag", "mark", "children", "text", "aside", "named")

    def __init__(self, tag: str, mark: str = "", aside: bool = False, named: bool = False, text: str = ""):
        self.tag, self.mark, self.children, self.text, self.aside, self.named = tag, mark, [], text, aside, named


def parse(source: str) -> Node:
    """A tree of the page. Unclosed and stray tags are treated as browsers do for blocks, lists and tables."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(source)
    while at < size:
        found = _MARKUP.search(source, at)
        if found is None:
            stack[-1].children.append(Node("", text=source[at:]))
            break
        if found.start() > at:
            stack[-1].children.append(Node("", text=source[at : found.start()]))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # An end tag of something inline does not end the block it stands in.
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag in CLOSES_P:
            _end(stack, {"p"}, {"button", "td", "th", "li", "div", "section", "article", "blockquote"})
        elif tag in ENDED_BY:
            _end(stack, *ENDED_BY[tag])
        node = Node(tag, *_mark(tag, found[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(source, at)
            at = end.end() if end else size
        elif tag not in VOID:
            stack.append(node)
    return root


def _end(stack: list[Node], ended: set[str], limits: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in limits:
            return
        if stack[i].tag in ended:
            del stack[i:]
            # A row ends together with the cell it holds.
            return _end(stack, ended, limits) if len(ended) > 1 else None


def _mark(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(tag with class and id without digits, whether it stands beside the article, whether its class or id says so)."""
    if "=" not in attributes and "hidden" not in attributes:
        return tag, tag in SKIPPED, False
    own = {}
    for name, one, two, three in _ATTRIBUTE.findall(attributes):
        own.setdefault(name.lower(), one or two or three)
    named = " ".join(own[k] for k in ("class", "id") if own.get(k))
    aside = tag in SKIPPED or "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES or "display:none" in own.get("style", "").replace(" ", "").lower()
    told = tag not in ("html", "body", "article", "main") and bool(named and ASIDE.search(named))
    # Slashes and line ends separate marks and paths.
    return f"{tag}.{re.sub(r'[/\s]+', ' ', re.sub(r'[0-9]+', '', named)).lower()}" if named else tag, aside or told, told


# ---------------------------------------------------------------- wrappers


def aligned(one: Node, two: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes in a largest top-down, order-keeping match of two trees: simple tree matching.

    The best match of two lists of children is found by dynamic programming over the matches of their members. Nodes
    match if tag, class and id agree.
    """
    return _match(one, two)[1] if one.mark == two.mark and one.tag == two.tag else []


def _match(one: Node, two: Node) -> tuple[int, list[tuple[Node, Node]]]:
    size, pairs = 1, [(one, two)]
    for left, right in _stretches(_own(one), _own(two)):
        more, found = _best(left, right)
        size += more
        pairs += found
    return size, pairs


def _best(left: list[Node], right: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    found: dict[tuple[int, int], list[tuple[Node, Node]]] = {}
    for i, a in enumerate(left, 1):
        for j, b in enumerate(right, 1):
            top = max(best[i - 1][j], best[i][j - 1])
            if a.tag == b.tag and a.mark == b.mark:
                size, pairs = _match(a, b) if a.children and b.children else (1, [(a, b)])
                # Among equal matches the one of equal texts is preferred.
                size += a.tag == "" and a.text == b.text
                if best[i - 1][j - 1] + size > top:
                    top = best[i - 1][j - 1] + size
                    found[i, j] = pairs
            best[i][j] = top
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += found[i, j]
            i, j = i - 1, j - 1
    return best[-1][-1], pairs


def _own(node: Node) -> list[Node]:
    return [c for c in node.children if c.tag or c.text.strip()]


def _stretches(left: list[Node], right: list[Node]) -> Iterator[tuple[list[Node], list[Node]]]:
    """Stretches of two lists of children that are aligned with each other; together they are the whole lists.

    Short lists are one stretch. Others are cut at a longest common sequence of equal children, where the n-th child of some
    mark and text is equal to the n-th such child of the other list, and in between into as many parts of either list.
    """
    if max(len(left), len(right)) <= ALIGNED_CHILDREN:
        yield left, right
        return
    places = {key: j for j, key in enumerate(_numbered(right))}
    # The longest rising sequence of places: tails of sequences by length, and each one's predecessor.
    tails: list[int] = []
    ends: list[int] = []
    before: dict[int, int] = {}
    at: dict[int, int] = {}
    for i, key in enumerate(_numbered(left)):
        if (j := places.get(key)) is not None:
            at[i] = j
            n = bisect_left(tails, j)
            tails[n : n + 1], ends[n : n + 1] = [j], [i]
            before[i] = ends[n - 1] if n else -1
    cuts, i = [], ends[-1] if ends else -1
    while i >= 0:
        cuts.append((i, at[i]))
        i = before[i]
    x = y = 0
    for i, j in [*reversed(cuts), (len(left), len(right))]:
        parts = -(-max(i - x, j - y) // ALIGNED_CHILDREN)
        for k in range(parts):
            yield left[x + (i - x) * k // parts : x + (i - x) * (k + 1) // parts], right[y + (j - y) * k // parts : y + (j - y) * (k + 1) // parts]
        if i < len(left):
            yield [left[i]], [right[j]]
        x, y = i + 1, j + 1


def _numbered(nodes: list[Node]) -> list[tuple[str, str, int]]:
    """(mark, whole text, how many nodes before have both) of each node."""
    seen: Counter[tuple[str, str]] = Counter()
    out = []
    for node in nodes:
        key = node.mark, _tidy(" ".join(n.text for _, n in _walk(node) if not n.tag))
        out.append((*key, seen[key]))
        seen[key] += 1
    return out


def _walk(node: Node, path: str = "") -> Iterator[tuple[str, Node]]:
    stack = [(path, node)]
    while stack:
        at, one = stack.pop()
        yield at, one
        stack += [(f"{at}/{c.mark or '#text'}", c) for c in reversed(one.children)]


def _tidy(text: str) -> str:
    return _WHITE.sub(" ", html.unescape(text)).strip()


def induce(pages: list[str]) -> tuple[str, list[str], list[str]]:
    """(path of the content, its constant texts, paths of menus in it) from different pages of a host.

    Every page is aligned with the first one. A text of the first page that each other page has at the matched place is
    constant: template. All other text is a slot. How much slot text that is no link each element path has on all the pages
    tells where the content is: from the root on, the container that holds most of it is entered, until an element
    has such text of its own or several containers share it (:func:`_content`). Where that can't be told, the content is the
    smallest container of all slot text which no element beside the article holds.
    """
    trees = [parse(x) for x in pages]
    if not trees:
        return "", [], []
    first = trees[0]
    same = Counter()
    for other in trees[1:]:
        for one, two in aligned(first, other):
            if not one.tag and _tidy(one.text) and _tidy(one.text) == _tidy(two.text):
                same[id(one)] += 1
    others = len(trees) - 1
    constant = {id(n) for _, n in _walk(first) if not n.tag and others + 1 >= LEAST_PAGES and same[id(n)] == others}
    template = {_tidy(n.text) for _, n in _walk(first) if id(n) in constant}
    pages_texts = [list(_texts(t)) for t in trees]
    # Copies of one article differ in a few words; the article is not only these.
    alike = sum(len(text) for _, text in pages_texts[0] if text in template)
    copies = 2 * alike > sum(len(text) for _, text in pages_texts[0])
    facts = Facts(trees, frozenset() if copies else frozenset(template))
    path = facts.content() if others + 1 >= LEAST_PAGES else None
    if path is None:
        slots = [(at, text) for texts in pages_texts for at, text in texts if text not in template]
        mass = Counter()
        for at, text in slots:
            if (outer := _outermost(at)) is not None:
                mass[outer] += len(text)
        if mass and sum(mass.values()) >= 0.3 * sum(len(text) for _, text in slots):
            path = "\n".join(sorted(mass))
        else:
            path = _above([at for at, _ in (sum(pages_texts, []) if copies else slots)])
    paths = path.split("\n")
    inside = [n for at, n in _walk(first) if not n.tag and any(at.startswith(f"{p}/") for p in paths)]
    texts = sorted({_tidy(n.text) for n in inside if id(n) in constant})
    # Pages that agree on most of their content are copies of one article; they say nothing of the template.
    if 2 * sum(map(len, texts)) > sum(len(_tidy(n.text)) for n in inside):
        texts = []
    return path, texts, facts.menus(path)


class Facts:
    """What the sample pages of a host have at each element path: slot text outside links, text in links, links, all text.

    Text that never shows (scripts, styles, forms' parts) isn't counted. What stands in elements beside the article counts as
    text of its own path, but not for the elements around it.
    """

    def __init__(self, trees: list[Node], template: frozenset[str]):
        self.pages = len(trees)
        # Slot text outside links, and the part of it that is in no container further down.
        self.slots, self.direct, self.linked, self.links, self.all = Counter(), Counter(), Counter(), Counter(), Counter()
        self.kids: dict[str, set[str]] = {}
        self.titles: Counter[str] = Counter()
        self.told = False
        self.outer: Counter[str] = Counter()
        for tree in trees:
            self._count(tree, template)

    def _count(self, tree: Node, template: frozenset[str]) -> None:
        heads = [_tidy(" ".join(x.text for _, x in _walk(n) if not x.tag)) for _, n in _walk(tree) if n.tag == "h1"]
        title = heads[0] if heads else None
        # (node, path, paths of the elements around it, innermost container, whether in a link)
        stack = [(tree, "", ("",), "", False)]
        while stack:
            node, at, around, box, link = stack.pop()
            for c in node.children:
                if not c.tag:
                    text = _tidy(c.text)
                    if not text:
                        continue
                    for p in around:
                        self.all[p] += len(text)
                        self.linked[p] += link * len(text)
                    if not link and text not in template:
                        for p in around:
                            self.slots[p] += len(text)
                            self.titles[p] += text == title
                        self.direct[box] += len(text)
                        if (outer := _outermost(at)) is not None:
                            self.outer[outer] += len(text)
                    continue
                self.told = self.told or c.named
                if c.tag in HARD or (c.aside and c.tag not in NAMED):
                    continue
                path = f"{at}/{c.mark}"
                inner = link or c.tag == "a"
                if c.tag == "a":
                    for p in (*around, path):
                        self.links[p] += 1
                inside = box
                if c.tag in CONTAINERS:
                    self.kids.setdefault(box, set()).add(path)
                    inside = path
                stack.append((c, path, (*around, path), inside, inner))

    def content(self) -> str | None:
        """The path of the content, or paths joined by line ends; None if the pages have no slot text."""
        at = ""
        if not self.slots[at]:
            return None
        while not self.direct[at]:
            boxes = sorted((p for p in self.kids.get(at, ()) if self.slots[p]), key=lambda p: (-self.slots[p], p))
            if not boxes or self.slots[boxes[0]] < DOMINANT * self.slots[at]:
                break
            best, rest = boxes[0], boxes[1:]
            if best.rsplit("/", 1)[-1].split(".")[0] in NAMED:
                return "\n".join(sorted(self.outer))
            if rest and (self.told or any(self.titles[p] for p in rest) or self.slots[rest[0]] > SMALL * self.slots[best]):
                # Names would have told what stands beside the article, so these are parts of it.
                break
            at = best
        if self.outer and sum(self.outer.values()) >= 0.3 * self.slots[at]:
            return "\n".join(sorted(self.outer))
        return at

    def menus(self, path: str) -> list[str]:
        """Paths below the content whose text is nearly all links, on every page many; not below article elements."""
        if any(_outermost(p) for p in path.split("\n")):
            return []
        found = [
            p for p, n in self.links.items()
            if p.startswith(f"{path}/") and p.rsplit("/", 1)[-1].split(".")[0] in MENUS and n >= LINKS * self.pages and self.linked[p] >= LINK_SHARE * self.all[p]
        ]
        return sorted(p for p in found if not any(p.startswith(f"{q}/") for q in found))


def _texts(tree: Node) -> Iterator[tuple[str, str]]:
    """(path of the element, text) of all texts that no element beside the article holds."""
    stack = [("", tree)]
    while stack:
        at, node = stack.pop()
        for c in node.children:
            if c.tag:
                if not c.aside:
                    stack.append((f"{at}/{c.mark}", c))
            elif text := _tidy(c.text):
                yield at, text


def _outermost(path: str) -> str | None:
    """The path up to its first article or main element."""
    marks = path.split("/")
    ends = [i for i, mark in enumerate(marks) if mark.split(".")[0] in NAMED]
    return "/".join(marks[: ends[0] + 1]) if ends else None


def _above(paths: list[str]) -> str:
    """The longest path to a container that all paths start with."""
    if not paths:
        return ""
    # The first and last in order differ earliest.
    low, high = min(marks := [p.split("/") for p in paths]), max(marks)
    shared = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    while shared > 1 and low[shared - 1].split(".")[0] not in CONTAINERS:
        shared -= 1
    return "/".join(low[:shared])


def extract(source: str | None, path: str = "", constant: frozenset[str] = frozenset(), menus: frozenset[str] = frozenset()) -> str:
    """The article's blocks, joined by newlines: below the wrapper's path, or else what looks like the article."""
    if not source:
        return ""
    tree = parse(source)
    if menus:
        for at, node in _walk(tree):
            node.aside = node.aside or at in menus
    found = _at(tree, path) if path else []
    if not found or not any(_has_text(n) for n in found):
        found = _named(tree, "article") or _named(tree, "main") or _named(tree, "body") or [tree]
    blocks: list[str] = []
    for node in found:
        blocks += _blocks(node)
    return "\n".join(b for b in blocks if b not in constant)


def _at(tree: Node, path: str) -> list[Node]:
    """Elements at any of the paths in page order; where these are articles, also those that no sample page had."""
    wanted = set(path.split("\n"))
    named = any(_outermost(p) == p for p in wanted)
    onward = {p[:i] for p in wanted for i, c in enumerate(p) if c == "/"}
    out, stack = [], [("", tree)]
    while stack:
        at, node = stack.pop()
        if at in wanted or (named and node.tag in NAMED):
            out.append(node)
        elif named or at in onward:
            stack += [(f"{at}/{c.mark}", c) for c in reversed(node.children) if c.tag and not c.aside]
    return out


def _named(tree: Node, tag: str) -> list[Node]:
    """Outermost elements of a name that do not stand beside the article and have text."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        if node.tag == tag and not (node.aside and tag != "body"):
            out.append(node)
        elif not node.aside or node is tree:
            stack += reversed(node.children)
    return [n for n in out if _has_text(n)]


def _has_text(node: Node) -> bool:
    return bool(_blocks(node))


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, without what stands beside the article."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = _tidy("".join(run))
            if text:
                blocks.append(text)
            run.clear()

    # None ends a block after its children.
    stack: list[Node | None] = list(reversed(node.children))
    while stack:
        one = stack.pop()
        if one is None:
            end()
        elif not one.tag:
            run.append(one.text)
        elif not one.aside:
            if one.tag in BLOCKS:
                end()
                stack.append(None)
            stack += reversed(one.children)
    end()
    return blocks


# ---------------------------------------------------------------- Spark


def host_of(url: str = "url") -> Column:
    """The host in lower case without a port, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, path, constant, menus): one row per host, from a bounded sample of its different pages.

    Pages are picked by their hashes and lengths alone, after an aggregate that leaves one row of equal pages; a window that
    keeps few rows drops the others before the shuffle, so a host with a third of all pages sends no more than
    4 * SAMPLE_PAGES rows from each task. Only the texts of the picked pages are shuffled.
    """
    html_text = F.col("html").cast("string")
    usable = pages.select(host_of().alias("host"), html_text.alias("html")).filter("html IS NOT NULL AND html <> '' AND host <> ''").withColumn("hash", F.xxhash64("html"))
    different = usable.groupBy("host", "hash").agg(F.min(F.length("html")).alias("chars"))
    # First within parts of a host, so that no task gets what every task has kept of a host with very many pages.
    parted = Window.partitionBy("host", F.pmod(F.shiftright("hash", 8), F.lit(HOST_PARTS))).orderBy("hash")
    near = different.withColumn("at", F.row_number().over(parted)).filter(F.col("at") <= 4 * SAMPLE_PAGES)
    order = Window.partitionBy("host").orderBy("hash")
    first = near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= 4 * SAMPLE_PAGES)
    # Pages of middle length align best: short and very long ones lack or add parts.
    middle = F.greatest(F.lit(0), F.floor((F.count(F.lit(1)).over(Window.partitionBy("host")) - SAMPLE_PAGES) / 2))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("chars", "hash")) - middle)
    picked = barrier(placed.filter(F.col("place").between(1, SAMPLE_PAGES)).select("host", "hash", "place"), "page-samples")
    sample = usable.join(picked, ["host", "hash"]).groupBy("host", "place").agg(F.min("html").alias("html"))

    def induced(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sys.setrecursionlimit(DEEPEST)
        path, constant, menus = induce(list(rows.sort_values("place")["html"]))
        return pd.DataFrame({"host": [key[0]], "path": [path], "constant": [constant], "menus": [menus]})

    return sample.groupBy("host").applyInPandas(induced, "host string, path string, constant array<string>, menus array<string>")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Each host's wrapper is induced from a few of its pages and applied to all of them. The text has the blocks of the
    article in page order, references decoded, white space inside a block as one space, and one newline between blocks. A
    null or empty html gives an empty text. Pages without a host, and pages that the wrapper does not fit, are read by
    element names alone. Repeated rows and null ids give rows like any other; other columns are ignored.
    """
    prepare(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))
    # Written, so that Spark knows their size: wrappers of few hosts are broadcast by its own threshold and pages stay where
    # they are; for many hosts the join is one of two plain shuffles, in which a host with very many pages is split.
    wrappers = barrier(induce_wrappers(pages), "wrappers")
    joined = own.join(wrappers, "host", "left").select("page_id", "url", "html", "path", "constant", "menus")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            wrapped = zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)
            texts = [extract(h, p or "", frozenset(c or ()), frozenset(m or ())) for h, p, c, m in wrapped]
            out = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
