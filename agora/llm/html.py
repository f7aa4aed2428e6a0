"""Main text of web pages by tree scoring (operator 10).

The page is read into a tree in linear time (raw-text elements, comments, void elements, implied
ends of paragraphs and list items, missing end tags; attributes are scanned as the HTML standard
has it, and a tag that never ends takes the rest of the page). Elements that hold no article text
by their tag are cut out. Navigation, forms, headers, footers and asides, and what has a noise word
in its role, class or id, are measured first: they stay if they hold the page's largest
article/main or too much of its text. A header with a heading belongs to the article if it lies in
an article/main, in a container named like a post, or in the best container. Every paragraph, and every other element with text of its own,
gives points to its ancestors: one, one per comma and up to three for its length; all of them to
the parent, half to the next ancestor, a third to the one after. A container's points are
discounted by its link density. The points choose the region only: the outermost article/main
around the best container, or else its highest ancestor that adds a heading, a paragraph, bare
text, any text beside the container itself, or blocks of ``LEAST`` text points in all. All of the
region is kept that is neither cut out nor, outside the best container, a list of links.

Defined results: null and empty pages, and pages without text outside the parts cut out, give
the empty text. Nothing of a kept container is capped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import map_batches

#: Element names by their role in a page (fixed by the HTML standard).
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head script style noscript iframe template textarea title button select "
                  "option input svg canvas object embed menu dialog".split())
#: Elements that are cut out unless they turn out to hold the article.
MEASURED = frozenset("nav footer aside form header".split())
#: Open elements that a new element of the given name ends.
ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
        "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol pre section table ul".split())
#: An implied end does not reach past these.
SCOPE = frozenset("article aside body div footer header html main nav section table td th ul ol dl form".split())

#: Rest of a tag after its name: attributes by name, with a quoted or plain value, up to ">".
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)?+"""
_TAG = re.compile(rf"</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]++))?+)?+""")
#: Names of a container of one article (fixed values).
_POST = re.compile(r"(?:^|[\s_-])(?:post|article|entry|story|hentry|blogpost)(?:$|[\s_-])", re.I)
#: Words in a class, id or role that mark what is not the article (fixed values).
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|breadcrumbs?|combx|comments?|commentlist|disqus|respond|replies|community|"
    r"cookies?|consent|gdpr|notice|notification|alert|modal|popup|overlay|footer|foot|header|masthead|menu\w*|nav|navbar|"
    r"navigation|pager|pagination|promo\w*|recommend\w*|related|share|sharing|shoutbox|sidebar\w*|skip\w*|social|sponsor\w*|"
    r"subscribe|newsletter|toolbar|widget|complementary|contentinfo|search|login|signup)(?:$|[\s_-])", re.I)
#: Names that tell of the layout around the article: what it has or lacks, or a wrapper of it.
_LAYOUT = re.compile(
    r"(?:no|has|with|without|hide|hides)[_-].*|"
    r"(?:.*[_-])?(?:content|main|page|site|layout|body|article|post|entry|story)[_-](?:.*[_-])?(?:wrap|wrapper|wrapping|layout)", re.I)
#: Noise words of what readers add, and those that can also be a text's subject.
_READERS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|respond|replies)(?:$|[_-])", re.I)
_SUBJECT = re.compile(r"(?:community|related|recommend\w*|share|sharing|social|search|alert|notice|notification|consent|promo\w*)", re.I)
NAMED, BY_SUBJECT, BY_READERS, BY_TAG = 1, 2, 3, 4


def _noise_kind(value: str) -> int:
    """Kind of the noise words in a class, id or role; 0 if there are none."""
    kind = 0
    for name in value.split() if _NOISE.search(value) else ():
        found = [w for w in re.split("[_-]", name) if _NOISE.search(w)]
        if not found and not _NOISE.search(name) or _LAYOUT.fullmatch(name):
            continue
        if _READERS.search(name):
            return BY_READERS
        if kind != NAMED:
            kind = BY_SUBJECT if found and all(_SUBJECT.fullmatch(w) for w in found) else NAMED
    return kind


@dataclass
class Node:
    name: str
    parent: Node | None
    #: nearest ancestor that is a block, whether an article or main is around, a post container
    block: Node | None = None
    inside: bool = False
    post: bool = False
    noise: bool = False
    named: int = 0
    parts: list[Node | str] = field(default_factory=list)
    points: float = 0.0
    own: float = 0.0
    links: int = 0
    titled: bool = False


class _Open:
    """The open elements of a page: in frames that begin at elements an implied end cannot pass."""

    def __init__(self, root: Node):
        self.top = root
        self.names: Counter[str] = Counter()
        self.frames: list[tuple[str, Counter[str]]] = [("#page", Counter())]

    def push(self, node: Node) -> None:
        self.top = node
        self.names[node.name] += 1
        if node.name in SCOPE:
            self.frames.append((node.name, Counter()))
        else:
            self.frames[-1][1][node.name] += 1

    def pop(self) -> str:
        name = self.top.name
        self.top = self.top.parent
        self.names[name] -= 1
        if name in SCOPE:
            self.frames.pop()
        else:
            self.frames[-1][1][name] -= 1
        return name

    def end(self, name: str) -> None:
        """An end tag: closes the innermost element of its name, if one is open."""
        if self.names[name]:
            while self.pop() != name:
                pass

    def end_implied(self, ended: tuple[str, ...]) -> None:
        """Closes the open elements of these names, as far as their frames reach."""
        while True:
            scope, counts = self.frames[-1]
            if scope not in ended and not any(counts[name] for name in ended):
                return
            self.pop()


def _attributes(node: Node, text: str) -> None:
    for key, *values in _ATTR.findall(text):
        key = key.lower()
        if key == "hidden":
            node.noise = True
        elif key in ("class", "id", "role"):
            value = "".join(values)
            node.post = node.post or key != "role" and _POST.search(value) is not None
            if kind := _noise_kind(value):
                node.named = kind if kind == BY_READERS or node.named in (0, BY_SUBJECT) else node.named


def parse(page: str) -> Node:
    root = Node("#page", None)
    now = _Open(root)
    place = begin = 0  # the text from ``begin`` on has not been added
    while (at := page.find("<", place)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = end + 3 if end >= 0 else len(page)
            tag = None
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = end + 1 if end >= 0 else len(page)
            tag = None
        elif page[at + 1:at + 2].isalpha() and page[at + 1].isascii() or page[at + 1:at + 2] == "/" and page[at + 2:at + 3].isalpha() and page[at + 2].isascii():
            tag = _TAG.match(page, at)
            end = tag.end() if tag else len(page)
        else:
            place = at + 1
            continue
        if at > begin:
            now.top.parts.append(page[begin:at])
        place = begin = end
        if tag is None:
            continue
        name = tag[1].lower()
        if page[at + 1] == "/":
            now.end(name)
            continue
        if ended := ENDS.get(name, ("p",) if name in CLOSES_P else ()):
            now.end_implied(ended)
        up = now.top
        new = Node(name, up, up if up.name not in INLINE else up.block, up.inside or up.name in ("article", "main"))
        _attributes(new, tag[2])
        if name in MEASURED and new.named != BY_READERS and not (name == "header" and (new.inside or up.post)):
            new.named = BY_TAG
        up.parts.append(new)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, place)
            place = begin = stop.end() if stop else len(page)
        elif name not in VOID and not tag[0].endswith("/>"):
            now.push(new)
    if begin < len(page):
        now.top.parts.append(page[begin:])
    return root


def _dropped(node: Node) -> bool:
    return node.name in NEVER or node.noise and node.name not in ("html", "body", "article", "main")


def _measure(root: Node) -> dict[int, tuple[int, int, int]]:
    """Characters, characters in links and commas below each node that is not cut out; points
    are given out on the way."""
    sizes: dict[int, tuple[int, int, int]] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(p, False) for p in node.parts if isinstance(p, Node) and not _dropped(p)]
            continue
        chars = links = commas = 0
        own = False
        text = [0, 0, 0]  # the same without the blocks in it
        node.links, node.titled = 0, node.name == "h1"
        for part in node.parts:
            if isinstance(part, Node):
                if id(part) in sizes:
                    node.links, node.titled = node.links + part.links, node.titled or part.titled
                c, k, s = sizes.get(id(part), (0, 0, 0))
                own = own or part.name in INLINE and c > k
            else:
                words = part.split()
                c, k, s = sum(map(len, words)) + max(len(words) - 1, 0), 0, part.count(",")
                own = own or c > 0
            chars, links, commas = chars + c, links + k, commas + s
            if isinstance(part, str) or part.name in INLINE:
                text = [text[0] + c, text[1] + k, text[2] + s]
        if node.name == "a":
            links = chars
            node.links += chars > 0
        sizes[id(node)] = chars, links, commas
        if chars and (node.name == "p" or own) and node.name not in INLINE:
            if text[0]:
                node.own = (1 + text[2] + min(text[0] / 100, 3)) * (1 - text[1] / text[0])
            points = (1 + commas + min(chars / 100, 3)) * (1 - links / chars)
            up, share = (node if node.name != "p" else node.block), 1
            while up is not None and share <= 3:
                up.points += points / share
                up, share = up.block, share + 1
    return sizes


def _mark_noise(root: Node) -> None:
    """Mark the elements with noise words or tags that are to be cut out. Kept are those around the
    largest article or main; those named by a subject, with few links and at least a tenth of the
    text points; others with more than half of them, by tag of those of the article; readers'
    additions if there is hardly anything else."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not _dropped(p)]
    if not any(n.named for n in order):
        return
    sizes = _measure(root)
    for node in order:
        node.points = 0.0

    def below(without: set[int]) -> dict[int, float]:
        """Text points of each node and all below it."""
        sums: dict[int, float] = {}
        for node in reversed(order):
            inner = sum(sums[id(p)] for p in node.parts if isinstance(p, Node) and id(p) in sums)
            sums[id(node)] = 0.0 if id(node) in without else inner + node.own
        return sums

    every = below(set())
    articles = [n for n in order if n.name in ("article", "main")]
    plain = {id(n) for n in articles if not n.named} or set(map(id, articles))
    nearest: dict[int, Node] = {}
    within: dict[int, list[Node]] = {}
    for node in order:
        outer = nearest.get(id(node.parent), root)
        nearest[id(node)] = node if id(node) in plain else outer
        if id(node) in plain:
            within.setdefault(id(outer), []).append(node)
    inside, least = root, 0.0
    while id(inside) in within:  # the largest article or main, the largest one in it, and so on
        largest = max(within[id(inside)], key=lambda n: every[id(n)])
        if every[id(largest)] <= least:
            break
        inside, least = largest, every[id(largest)] / 4
    around: set[int] = set()
    at: Node | None = inside
    while at is not None:
        around.add(id(at))
        at = at.parent
    readers = {id(n) for n in order if n.named == BY_READERS and id(n) not in around}
    unnamed = below({id(n) for n in order if n.named and id(n) not in around})[id(root)]
    if unnamed <= every[id(root)] / 20 and any(every[i] > every[id(root)] * 3 / 4 for i in readers):
        readers = set()
    rest = below(readers)
    total = rest[id(root)]
    article: set[int] = set()
    stack = [inside]
    while stack:
        node = stack.pop()
        article.add(id(node))
        stack += [p for p in node.parts if isinstance(p, Node)]
    for node in order:
        if not node.named or id(node) in around:
            continue
        chars, links, _ = sizes[id(node)]
        if node.named == BY_TAG:
            node.noise = id(node) not in article or rest[id(node)] <= max(rest[id(inside)] / 2, HOLDS)
        elif node.named == BY_SUBJECT:
            node.noise = rest[id(node)] < total / 10 or links > chars / 4
        else:
            node.noise = id(node) in readers or rest[id(node)] <= total / 2


#: Text points that an element cut out by its tag must exceed to be taken for the article.
HOLDS = 5
#: Text points of the blocks beside a region that make their parent the region (fixed value).
LEAST = 2


def _length(text: str) -> int:
    words = text.split()
    return sum(map(len, words)) + max(len(words) - 1, 0)


def _beside(node: Node, path: set[int], sizes: dict[int, tuple[int, int, int]]) -> Iterator[list[Node | str]]:
    """The blocks and the runs of inline parts of ``node`` that are not cut out and no lists of
    links (without other text, or several links with half of the text); ``path`` always stays."""
    run: list[Node | str] = []
    for part in [*node.parts, None]:
        alone = isinstance(part, Node) and (part.name not in INLINE or id(part) in path)
        if part is not None and not alone:
            if isinstance(part, str) or part.name == "br" or id(part) in sizes:
                run.append(part)
            continue
        for group in (run, [part] if alone else []):
            nodes = [p for p in group if isinstance(p, Node) and id(p) in sizes]
            chars = sum(sizes[id(p)][0] for p in nodes) + sum(_length(p) for p in group if isinstance(p, str))
            links, count = sum(sizes[id(p)][1] for p in nodes), sum(p.links for p in nodes)
            if any(id(p) in path or p.titled or p.name in HEADINGS for p in nodes) or chars and not (
                    links >= chars or count > 1 and links * 2 >= chars):
                yield group
            elif not chars or group is run:
                yield [" "]
        run = []


def _region(best: Node, sizes: dict[int, tuple[int, int, int]]) -> Node:
    region, at = None, best
    while at is not None:
        if at.name in ("article", "main"):
            region = at
        at = at.parent
    if region is not None:
        return region
    region, below, alone = best, best, True
    while below.parent is not None and below.name != "body":
        up = below.parent
        beside = [p for group in _beside(up, {id(below)}, sizes) for p in group if p is not below]
        beside = [p for p in beside if (p.strip() if isinstance(p, str) else sizes.get(id(p), (0,))[0])]
        points, stack = 0.0, [p for p in beside if isinstance(p, Node)]
        while stack:
            node = stack.pop()
            points += node.own
            stack += [p for p in node.parts if isinstance(p, Node) and id(p) in sizes]
        if points >= LEAST or beside and alone and up.name != "body" or any(
                isinstance(p, str) or p.name == "p" or p.name in HEADINGS or p.name in INLINE for p in beside):
            region = up
        alone = alone and not beside
        below = up
    return region


def _collect(region: Node, best: Node, sizes: dict[int, tuple[int, int, int]], blocks: list[list[str]]) -> None:
    path, at = {id(best)}, best
    while at is not region:
        at = at.parent
        path.add(id(at))
    stack: list[tuple[Node | str | None, bool]] = [(region, region is not best)]
    while stack:
        part, sift = stack.pop()
        if part is None:
            blocks.append([])
        elif isinstance(part, str):
            blocks[-1].append(html.unescape(part))
        elif part.name == "br":
            blocks[-1].append(" ")
        elif part is region or not _dropped(part):
            block = part.name not in INLINE
            if block:
                blocks.append([])
                stack.append((None, False))
            sift = sift and part is not best and part.name not in HEADINGS and (block or id(part) in path)
            parts = [p for group in _beside(part, path, sizes) for p in group] if sift else part.parts
            stack += [(p, sift) for p in reversed(parts)]


def _restore_title(header: Node, sizes: dict[int, tuple[int, int, int]]) -> None:
    """Keep the best container's own header if it holds a heading."""
    if not header.noise:
        return
    header.noise = False
    sizes.update(_measure(header))
    stack, heading = [header], False
    while stack:
        node = stack.pop()
        heading = heading or node.name in HEADINGS
        stack += [p for p in node.parts if isinstance(p, Node)]
    header.noise = not heading


def main_text(page: str) -> str:
    """The text of the region of the best container, blocks joined by one space."""
    root = parse(page)
    _mark_noise(root)
    sizes = _measure(root)

    def score(node: Node) -> float:
        chars, links, _ = sizes.get(id(node), (0, 0, 0))
        return node.points * (1 - links / chars) if chars else 0.0

    best, most = None, 0.0
    stack = [root]
    while stack:
        node = stack.pop()
        if (got := score(node)) > most or best is not None and got == most > 0 and node.name in ("article", "main"):
            best, most = node, got
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and id(p) in sizes]
    if best is None:
        return ""
    for part in best.parts:
        if isinstance(part, Node) and part.name == "header" and part.named == BY_TAG and best.name not in ("body", "html", "#page"):
            _restore_title(part, sizes)
    blocks: list[list[str]] = [[]]
    _collect(_region(best, sizes), best, sizes, blocks)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()),
             pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    return map_batches(rows, run, "page_id bigint, url string, text string, n_chars bigint")
