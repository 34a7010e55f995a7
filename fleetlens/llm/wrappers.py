"""Main text of web pages by wrappers inferred per host (operator 7).

A page becomes a stream of block tags and text slots, nested as its tags are. Streams of one
host are aligned one after another into a union-free regular expression:

* runs of like items are folded into repeated groups,
* where two streams differ, what only one of them has becomes an optional group,
* texts that differ become a slot; a text that all pages share stays fixed.

A row of more than ``WIDE`` items becomes one repeated group of optional items, one of each name;
names carry no digits, and what surely holds no main text is cut off. So a wrapper has the size of
its host's template, however many pages the host has. Partial wrappers merge in any order: each
batch merges its own pages, equal partial wrappers become one, and the rest is merged in two
steps, by host and salt and then by host, which reads ``SALTS`` wrappers.

What surely is no main text: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
comments, by tag, role, or a class or id made of such words alone. Of an element whose class only
holds such a word (``share-price``), the wrapper decides: it goes if it is repeated, or if its texts are
all links or the same on all pages. The wrapper's slots then are the article (within article or main)
or other text. Where there is no article, slots of links go, as do labels of links and texts that are
the same on ``FIXED_PAGES`` pages or more whose blocks differ otherwise, unless such a text lies
between texts that vary, as a heading of the story. A page yields its blocks in its host's article slots,
or in its other slots if it has no article, or its fixed texts if it has nothing else.

Defined cases: a null or empty html has empty text; a null or odd url belongs to the host "";
unclosed and stray tags, truncated pages and pages of any length and depth are read to the end;
rows that repeat are extracted each. Columns of the input beside page, url and html are left out.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import named

SALTS = 16
#: Characters of all wrappers up to which they are broadcast; beyond, pages join them by host and salt.
BROADCAST_CHARS = 16 << 20
FIXED_PAGES = 3
WIDE = 48
SLOT, LINKS, GROUP = "#", "#a", "()"
OPTIONAL, REPEATED, LOOSE = 1, 2, 4

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)
      (?P<rest>(?:[^>"'=]++|=\s*+"[^"]*+"?|=\s*+'[^']*+'?|[="'])*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""", re.I)
# Fixed values of HTML: which elements have no end, hold raw text, or run within a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe xmp noembed noframes plaintext".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "p": set(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
        "h5 h6 header hr main menu nav ol p pre search section table ul".split()
    ),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"},
}
_SCOPES = set("table ul ol dl select article section div body html".split())
# What is no main text, by tag, role and words of class or id.
OTHER_TAGS = set(
    "head nav header footer aside form script style noscript template button select option textarea input iframe object "
    "svg canvas audio video dialog menu title fieldset".split()
)
OTHER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OTHER_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "login search share sharing social comment comments disqus respond reply replies related recommended breadcrumb breadcrumbs "
    "pagination pager widget toolbar copyright teaser teasers".split()
)
# Words of these that decide in any company, words that say nothing beside them, and words that make an article none.
DECIDING_WORDS = set(
    "navbar masthead sidebar advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter comments "
    "disqus breadcrumb breadcrumbs pagination copyright".split()
)
NEUTRAL_WORDS = set(
    "area bar block bottom box button buttons col column container content desktop form global group holder icon icons inner item "
    "items left link links list main mobile outer page panel reader readers right row section site slot sticky thread top unit user "
    "users wrap wrapper".split()
)
NO_ARTICLE_WORDS = set("ad advert comment comments promo related reply sponsored teaser".split())
_BOXES = set("div section article aside details".split())
_CONTAINERS = _BOXES | set("ul ol dl table figure".split())
_ARTICLE = {"article", "main"}
_PLAIN = {"html", "body", *_ARTICLE}
_MARKS = ("", "?", "!")
ROOT = 0


def _below(path: int, name: str) -> int:
    """The path of an element of this name below a path; paths are compared within one process only."""
    return hash((path, name))


class Node:
    """An item of a wrapper: an element, a slot, or a repeated group.

    ``seen`` has the least digests of the pages that hold the ``fixed`` text, ``FIXED_PAGES`` at most;
    pages with the same blocks have the same digest and count once.
    """

    __slots__ = ("name", "flags", "fixed", "seen", "children")

    def __init__(self, name: str, flags: int = 0, fixed: str = "", seen: Iterable[str] = (), children: list | None = None):
        self.name, self.flags, self.fixed, self.seen = name, flags, fixed, tuple(seen)
        self.children: list[Node] = children if children is not None else []


def _mark(tag: str, value: str) -> str:
    """What a class or id says: ``!`` no main text, ``?`` perhaps none, or nothing."""
    mark = ""
    for token in value.split():
        words = {w for w in re.split(r"[^a-z]+", token) if len(w) > 1}
        if tag in _PLAIN:
            hit = bool(words) and tag == "article" and words <= NO_ARTICLE_WORDS | NEUTRAL_WORDS and bool(words & NO_ARTICLE_WORDS)
        else:
            hit = bool(words & DECIDING_WORDS) or bool(words & OTHER_WORDS) and words <= OTHER_WORDS | NEUTRAL_WORDS
        if hit:
            return "!"
        if tag in _CONTAINERS and tag not in _PLAIN and words & OTHER_WORDS:
            mark = "?"
    return mark


def element_name(tag: str, rest: str) -> str:
    """Tag with its first class or id without digits; ``!`` in front if it holds no main text, ``?`` if perhaps."""
    label, mark = "", "!" if tag in OTHER_TAGS else ""
    if rest and not rest.isspace():
        for key, value in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                if not label and (key == "class" or tag in _CONTAINERS):
                    label = next((t for t in value.split() if not re.search(r"\d", t)), "")
                mark = max(_mark(tag, value), mark, key=_MARKS.index) if value else mark
            elif (
                value in OTHER_ROLES if key == "role" else "display:none" in value.replace(" ", "") if key == "style" else value != "false"
            ):
                mark = "!"
    label = re.sub(r"[^\w-]", "", label)
    return mark + tag + ("." + label if label else "")


def read_page(text: str) -> tuple[Node, list[tuple[int, str, str]]]:
    """The page's tree of blocks and slots, and its blocks in order as (path, text, fixed), without what is marked ``!``.

    ``fixed`` is a digest of the text, or of what is beside its links after an ``a``; it is empty within an article.
    """
    root = Node("")
    stack, tags, paths = [root], [""], [ROOT]
    marks = [""]  # the strongest mark from the root on
    pieces: list[str] = []
    beside: list[str] = []
    linked = plain = False
    in_link = 0
    blocks: list[tuple[int, str, str]] = []
    held: list[Node] = []

    def flush() -> None:
        nonlocal linked, plain
        if pieces:
            block = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if block and marks[-1] != "!":
                mixed = linked and plain
                free = not marks[-1] and not _ARTICLE.isdisjoint(tags)
                label = " ".join("".join(beside).split()) if mixed else block
                fixed = "" if free else f"{'a' if mixed else ''}{crc32(label.encode('utf-8', 'replace')):x}"
                stack[-1].children.append(Node(LINKS if linked and not plain else SLOT, fixed=fixed))
                if fixed:
                    held.append(stack[-1].children[-1])
                blocks.append((paths[-1], block, fixed))
        beside.clear()
        linked = plain = False

    def leave() -> None:
        flush()
        stack.pop(), tags.pop(), paths.pop(), marks.pop()

    at = 0
    while at < len(text):
        token = _TOKEN.search(text, at)
        upto = token.start() if token else len(text)
        if upto > at:
            piece = text[at:upto]
            pieces.append(piece)
            if not in_link:
                beside.append(piece)
            if not piece.isspace():
                linked, plain = linked or in_link > 0, plain or in_link == 0
        if not token:
            break
        at = token.end()
        if not token["tag"]:
            if token.group().startswith("<![CDATA["):
                pieces.append(token.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
                plain = True
            continue
        tag = token["tag"].lower()
        if token["close"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag not in INLINE and tag in tags:
                while tags[-1] != tag:
                    leave()
                leave()
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(text, at)
            at = end.start() if end else len(text)
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        for i in range(len(tags) - 1, 0, -1):
            if tag in CLOSED_BY.get(tags[i], ()):
                while len(tags) > i:
                    leave()
                break
            if tags[i] in _SCOPES:
                break
        if tag in VOID:
            continue
        name = element_name(tag, token["rest"] or "")
        if name == stack[-1].name:  # an element in its like, as unclosed tags leave, is the same level
            stack.append(stack[-1])
            paths.append(paths[-1])
            marks.append(marks[-1])
        else:
            node = Node(name)
            if marks[-1] != "!":
                stack[-1].children.append(node)
            stack.append(node)
            paths.append(_below(paths[-1], name))
            marks.append(max(marks[-1], name[0] if name[0] in "?!" else "", key=_MARKS.index))
        tags.append(tag)
    while len(stack) > 1:
        leave()
    flush()
    if held:
        digest = blake2b("\n".join(b[1] for b in blocks).encode("utf-8", "replace"), digest_size=8).hexdigest()
        for node in held:
            node.seen = (digest,)
    return root, blocks


def _same_slots(a: str, b: str) -> bool:
    return a == b or {a, b} == {SLOT, LINKS}


def merge(a: Node, b: Node) -> Node:
    """The least wrapper of this kind that accepts what either accepts."""
    name = a.name if a.name == b.name else SLOT
    fixed = a.fixed if a.fixed == b.fixed else ""
    seen = sorted({*a.seen, *b.seen})[:FIXED_PAGES] if fixed else ()
    return Node(name, a.flags | b.flags, fixed, seen, align(a.children, b.children))


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Align two rows of items; what has no match becomes optional. Repeats are folded."""
    if any(n.flags & LOOSE for n in (*a[:1], *b[:1])):
        return loosen([*a, *b])
    out: list[Node] = []
    later_a, later_b = ({} for _ in range(2))
    for later, row in ((later_a, a), (later_b, b)):
        for i, n in enumerate(row):
            later.setdefault(n.name, []).append(i)

    def following(later: dict[str, list[int]], name: str, after: int) -> int | None:
        places = later.get(name)
        while places and places[0] < after:
            places.pop(0)
        return places[0] if places else None

    def optional(items: Iterable[Node]) -> None:
        for n in items:
            n.flags |= OPTIONAL
            out.append(n)

    i = j = 0
    while i < len(a) and j < len(b):
        if _same_slots(a[i].name, b[j].name):
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        in_a, in_b = following(later_a, b[j].name, i), following(later_b, a[i].name, j)
        if in_a is not None and (in_b is None or in_a - i <= in_b - j):
            optional(a[i:in_a])
            i = in_a
        elif in_b is not None:
            optional(b[j:in_b])
            j = in_b
        else:
            optional([a[i], b[j]])
            i, j = i + 1, j + 1
    optional(a[i:])
    optional(b[j:])
    return fold(out)


def fold(items: list[Node]) -> list[Node]:
    """Fold neighbouring repeats of one to three items into repeated groups."""
    for width in (1, 2, 3):
        out: list[Node] = []
        for n in items:
            out.append(n)
            last, before = out[-width:], out[-2 * width : -width]
            if len(before) == width and all(x.name == y.name != GROUP for x, y in zip(before, last)):
                joined = [merge(x, y) for x, y in zip(before, last)]
                del out[-2 * width :]
                if width == 1:
                    joined[0].flags |= REPEATED
                    out += joined
                else:
                    out.append(Node(GROUP, REPEATED, children=joined))
            elif width > 1 and len(out) > width and out[-width - 1].name == GROUP:
                group = out[-width - 1]
                if [x.name for x in group.children] == [x.name for x in last]:
                    group.children = [merge(x, y) for x, y in zip(group.children, last)]
                    del out[-width:]
        items = out
    return loosen(items) if len(items) > WIDE else items


def loosen(items: list[Node]) -> list[Node]:
    """One repeated group in which each name of the items is optional, in any order."""
    kinds: dict[str, Node] = {}
    todo = items[::-1]
    while todo:
        node = todo.pop()
        if node.name == GROUP:
            todo += reversed(node.children)
            continue
        key = SLOT if node.name == LINKS else node.name
        kinds[key] = merge(kinds[key], node) if key in kinds else node
        kinds[key].flags |= OPTIONAL | REPEATED * (len(items) > 1 and kinds[key] is not node)
    return [Node(GROUP, REPEATED | LOOSE, children=list(kinds.values()))]


def fold_page(root: Node) -> Node:
    """Fold the repeats of a page's own tree, the innermost first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        node.children = fold(node.children)
    return root


def encode(root: Node) -> str:
    flat, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is None:
            flat.append(0)
            continue
        flat.append([node.name, node.flags, node.fixed, node.seen])
        todo.append(None)
        todo += reversed(node.children)
    return json.dumps(flat, separators=(",", ":"))


def decode(text: str) -> Node:
    stack, root = [], None
    for item in json.loads(text):
        if item == 0:
            stack.pop()
            continue
        node = Node(*item)
        if stack:
            stack[-1].children.append(node)
        root = root or node
        stack.append(node)
    return root


def expression(root: Node) -> str:
    """The wrapper written as a regular expression over tags and slots."""
    marks = ("", "?", "+", "*")
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        slot = node.name in (SLOT, LINKS)
        out.append(node.name if slot else "(" if node.name == GROUP else f"<{node.name}>(")
        todo.append(("" if slot else ")") + marks[node.flags & (OPTIONAL | REPEATED)])
        todo += reversed(node.children)
    return "".join(out)


Slots = tuple[set[int], set[int], set[int], set[tuple[int, str]]]


def _is_fixed(slot: Node) -> bool:
    return bool(slot.fixed) and len(slot.seen) >= FIXED_PAGES


def content_slots(root: Node) -> Slots:
    """Paths of the elements whose slots are the article, of those of other text, of those of fixed text, and
    (path, digest) of the fixed texts that are no main text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    varied: set[int] = set()
    for node in reversed(order):
        if node.name == SLOT and not _is_fixed(node) or any(id(c) in varied for c in node.children):
            varied.add(id(node))

    article: set[int] = set()
    other: set[int] = set()
    fixed: set[int] = set()
    template: set[tuple[int, str]] = set()
    walk = [(root, ROOT, False, False, False)]
    while walk:
        node, path, inside, within, again = walk.pop()
        places = [i for i, c in enumerate(node.children) if id(c) in varied]
        around = bool(places) and node.name == GROUP
        for i, child in enumerate(node.children):
            held = within or around or bool(places) and places[0] < i < places[-1]
            if child.name in (SLOT, LINKS):
                if inside:
                    article.add(path)
                elif child.name == LINKS:
                    continue
                elif _is_fixed(child) and (not held or child.fixed[0] == "a"):
                    fixed.add(path)
                    template.add((path, child.fixed))
                else:
                    other.add(path)
            elif child.name == GROUP:
                walk.append((child, path, inside, held, True))
            elif child.name[:1] == "?" and (again or child.flags & REPEATED or id(child) not in varied):
                continue
            elif child.name[:1] != "!":
                tag = child.name.lstrip("?").split(".")[0]
                walk.append((child, _below(path, child.name), inside or tag in _ARTICLE, held and tag not in _BOXES, False))
    return article, other, fixed, template


def _merged(wrappers: Iterable[str]) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
    whole = None
    for text in sorted(wrappers):
        whole = merge(whole, decode(text)) if whole else decode(text)
    return encode(whole)


def host_of(url) -> F.Column:
    """Lower-case host of a url without user and port; "" if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(host, F.lit(""))


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper per host, as ``encode`` writes it."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
        for batch in batches:
            found: dict[str, Node] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = fold_page(read_page(page.as_py() or "")[0])
                found[host] = merge(found[host], own) if host in found else own
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([encode(w) for w in found.values()], pa.string())], ["host", "wrapper"]
            )

    def whole(table: pa.Table) -> pa.Table:
        return pa.table(
            {"host": table.column("host").slice(0, 1), "wrapper": pa.array([_merged(table.column("wrapper").to_pylist())], pa.string())}
        )

    parts = pages.select(host_of(named(url)).alias("host"), named(html).alias("html")).mapInArrow(partial, "host string, wrapper string")
    distinct = parts.distinct()
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInArrow(whole, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(whole, "host string, wrapper string")


def main_text(page: str, article: set, other: set, fixed: set, template: set) -> str:
    """Blocks of a page in its host's article slots, or else in its other slots, or else in those of fixed text."""
    blocks = read_page(page)[1]
    story = [text for path, text, _ in blocks if path in article]
    story = story or [text for path, text, key in blocks if path in other and (path, key) not in template]
    return "\n".join(story or [text for path, text, _ in blocks if path in fixed])


def extract(pages: DataFrame, wrappers: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` by the wrappers of their hosts."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    known = wrappers.select(F.col("host").alias("_host"), "wrapper")
    chars = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist()):
                if wrapper not in slots:
                    if len(slots) >= 4096:
                        slots.clear()
                    slots[wrapper] = content_slots(decode(wrapper))
                out.append(main_text(page.as_py() or "", *slots[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(
        named(page_id).alias("page_id"), named(url).alias("url"), named(html).alias("html"), host_of(named(url)).alias("host")
    )
    if chars <= BROADCAST_CHARS:
        met = rows.join(F.broadcast(known), F.col("host") == F.col("_host"))
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)))
        spread = known.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(spread, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_of")))
    return met.select("page_id", "url", "html", "wrapper").mapInArrow(
        texts, f"page_id {kinds[page_id]}, url {kinds[url]}, text string"
    )
