"""HTML extraction with site template removal.

Every element subtree is hashed; Spark counts on how many different pages of its host each hash
recurs, and subtrees that recur on `min_pages` pages or more are deleted first of all. What then
remains is read for its main content: the articles if there are any, else `main`, else the body.
Furniture that differs from page to page (adverts, comments) cannot recur, and small hosts have
too few pages; so elements whose tag or class says that they are furniture go as well, unless
they hold the content. Paragraphs and headings inside an article are content even if pages of a
host repeat them (mirrored articles): deletion there is left to containers, and given up where
it would leave nothing of the article.

Hashes are counted by host, hash and page, and come back to each page as the list of its own
recurring hashes; no row or task holds what belongs to a whole host.

Defined results: a null or empty page gives ''. A page without a host counts under host ''.
Repeated rows count once per host and content. An empty table gives an empty table. Only
page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

HOT = 1e-4
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_OPEN = re.compile(r"/?[a-zA-Z][^>]*(>)?")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noembed noframes xmp".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option object menu dialog canvas audio video fieldset".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address".split())
BLOCK = TEXT | frozenset("html body div section article main ul ol dl table thead tbody tfoot tr figure hr center details summary hgroup".split()) | DROPPED
_CLOSE = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW}
#: Words of a class or id that name furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)


#: Classes that say of an article that it is not the page's own.
NOT_CONTENT = frozenset("ad ads advert advertisement comment comments promo promoted recommended related reply sponsored teaser widget".split())
#: Class words that say that something else has or lacks the furniture.
ABOUT_OTHERS = ("no-", "has-", "with-", "without-", "no_", "has_", "with_", "without_")
#: These may wrap a whole page.
WRAPPERS = frozenset("form fieldset dialog menu".split())
#: Elements that end where the next of their kind begins, within one table, list or section.
SELF_CLOSING = frozenset("p li dt dd tr td th".split())


class Node:
    __slots__ = ("tag", "furniture", "children", "parent", "hash", "open", "holds", "dead", "inside")

    def __init__(self, tag: str, parent: Node | None, furniture: int = 0):
        self.tag, self.parent, self.furniture, self.children, self.hash = tag, parent, furniture, [], 0
        self.holds = self.dead = self.inside = False
        # By tag, the open element that a new one of that tag ends; shared with the parent where nothing differs.
        bound = tag == "td" or tag in BLOCK and tag not in TEXT
        self.open: dict[str, Node] = {} if parent is None or bound else parent.open
        if tag in SELF_CLOSING:
            self.open = {**self.open, tag: self}


def _furniture(tag: str, attrs: str) -> int:
    """2: by its tag, 1: by its attributes, 0: not furniture."""
    if tag in DROPPED:
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 1
        if name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"):
            return 1
        if name in ("class", "id"):
            tokens = [t for t in value.split() if not t.startswith(ABOUT_OTHERS)]
            if tag in ("article", "main"):
                if not NOT_CONTENT.isdisjoint(tokens):
                    return 1
            elif any(not FURNITURE.isdisjoint(_WORD.findall(t)) for t in tokens):
                return 1
    return 0


def parse(page: str) -> Node:
    """A forgiving tree: unclosed paragraphs and items end where the next begins, stray end tags are ignored. Linear in the page."""
    root = node = Node("#", None)
    at, end = 0, len(page)
    opened: Counter = Counter()  # open elements by tag
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        slash, tag, attrs, text = m.groups()
        if text == "<" and (m := _OPEN.match(page, at)):  # a tag with a stray quote, or one that never ends
            if m[1] is None:
                break
            at = m.end()
        elif text is not None:
            node.children.append(text)
        elif tag is None:
            continue
        elif slash:
            tag = tag.lower()
            if opened[tag]:
                node = _end(node, tag, opened)
            elif tag in ("p", "br"):
                node.children.append(Node("br", node))
        else:
            tag = tag.lower()
            if tag in BLOCK and (old := node.open.get(tag) if tag in SELF_CLOSING else None) or tag in BLOCK and (old := node.open.get("p")):
                while node is not old.parent:
                    opened[node.tag] -= 1
                    node = node.parent
            new = Node(tag, node, _furniture(tag, attrs))
            node.children.append(new)
            if tag in RAW:
                close = _CLOSE[tag].search(page, at)
                new.children.append(page[at : close.start() if close else end])
                at = close.end() if close else end
            elif tag not in VOID and not attrs.endswith("/"):
                node = new
                opened[tag] += 1
    return root


def _end(node: Node, tag: str, opened: Counter) -> Node:
    """The parent of the innermost open element of the tag."""
    while True:
        opened[node.tag] -= 1
        if node.tag == tag:
            return node.parent
        node = node.parent


def postorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    return out[::-1]


def hash_subtrees(root: Node) -> list[Node]:
    """Sets .hash of every element: its tag, its text and its children's hashes."""
    nodes = postorder(root)
    for n in nodes:
        h = xxhash.xxh64(n.tag.encode())
        for c in n.children:
            h.update(c.encode("utf-8", "surrogatepass") if isinstance(c, str) else c.hash.to_bytes(8, "little", signed=True))
        x = h.intdigest()
        n.hash = x - (1 << 64) if x >> 63 else x
    return nodes


def countable(nodes: list[Node]) -> set[int]:
    """Hashes of block elements that hold anything."""
    return {n.hash for n in nodes if n.tag in BLOCK and n.children and n.tag not in ("html", "body", "head")}


def extract(root: Node, templates: set[int] = frozenset()) -> str:
    """Text of the main content; nodes must be hashed if templates are given."""
    nodes = preorder(root)
    for n in reversed(nodes):  # children come before parents
        if n.parent is not None and (n.holds or n.tag in ("article", "main") and not n.furniture):
            n.parent.holds = True
    text = _content(root, nodes, templates, True)
    return text if text or not templates else _content(root, nodes, templates, False)


def _content(root: Node, nodes: list[Node], templates: set[int], within: bool) -> str:
    """within: whether recurring containers inside an article are deleted too."""
    for n in nodes:  # parents come before children
        up = n.parent
        n.inside = up is not None and (up.inside or up.tag in ("article", "main") and not up.furniture)
        n.dead = up is not None and up.dead
        if not n.dead and n.hash in templates and n.tag in BLOCK and n.tag not in ("article", "main") and not n.holds:
            n.dead = not n.inside or within and n.tag not in TEXT
        if not n.dead and n.furniture:
            n.dead = not n.holds or n.furniture == 2 and n.tag not in WRAPPERS
    for kind in ("article", "main"):
        found = [n for n in nodes if n.tag == kind and not n.dead and not n.furniture]
        if found:
            break
    else:
        found = [root]
    todo: list = [n for n in found[::-1] if not (n.inside and _within(n, kind))]
    blocks: list[list[str]] = [[]]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.dead:
            blocks.append([]) if x.tag in BLOCK else blocks[-1].append(" ") if x.tag == "br" else None
        elif x.tag in ("br", "hr"):
            blocks[-1].append(" ")
        else:
            inner = x.children[::-1]
            if x.tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo += inner
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks if b)
    return " ".join(x for x in lines if x)


def _within(n: Node, kind: str) -> bool:
    """Whether the element is in another of its kind; only those inside any article or main ask."""
    n = n.parent
    while n is not None and n.inside or n is not None and n.tag == kind:
        if n.tag == kind:
            return True
        n = n.parent
    return False


def preorder(root: Node) -> list[Node]:
    """Page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node)][::-1]
    return out


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, url, html -> key, host, page (its content), hash of each of its countable subtrees."""
    for b in batches:
        keys, hosts, pages, hashes = [], [], [], []
        for key, url, page in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            nodes = hash_subtrees(parse(page.as_py() or ""))
            found = countable(nodes)
            h = xxhash.xxh64_intdigest(host(url.as_py()).encode("utf-8", "surrogatepass"))
            keys += [key] * len(found)
            hosts += [h - (1 << 64) if h >> 63 else h] * len(found)
            pages += [nodes[-1].hash] * len(found)
            hashes += found
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in (("key", keys), ("host", hosts), ("page", pages), ("hash", hashes))})


def site_templates(subtrees: DataFrame, min_pages: int = 5) -> DataFrame:
    """subtrees (key, host, page, hash) -> key, hashes: those of each page that recur on min_pages different pages of its host.

    Hashes that make up a HOT share of all rows (at most 1 / HOT of them) are looked up by broadcast, the others
    joined by host and hash, so that no task gets all pages of a host.
    """
    counts = subtrees.groupBy("host", "hash").agg(F.count_distinct("page").alias("n"), F.count("*").alias("rows")).where(F.col("n") >= min_pages)
    counts = materialize(counts, "templates")
    floor = HOT * subtrees.count()
    hot, cold = counts.where(F.col("rows") >= floor).select("host", "hash"), counts.where(F.col("rows") < floor).select("host", "hash")
    often = subtrees.join(F.broadcast(hot), ["host", "hash"], "left_semi")
    rest = subtrees.join(F.broadcast(hot), ["host", "hash"], "left_anti").join(cold, ["host", "hash"], "left_semi")
    return often.union(rest).groupBy("key").agg(F.collect_set("hash").alias("hashes"))


def extract_main_text(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("key"), "page_id", "url", "html")  # repeated rows share their key, and their hashes
    subtrees = materialize(keyed.select("key", "url", "html").mapInArrow(_subtrees, "key long, host long, page long, hash long"), "subtrees")
    joined = keyed.join(site_templates(subtrees, min_pages), "key", "left").select("page_id", "url", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, hashes in zip(b.column(2), b.column(3)):
                root = parse(page.as_py() or "")
                found = set(hashes.as_py() or ())
                if found:
                    hash_subtrees(root)
                texts.append(extract(root, found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
