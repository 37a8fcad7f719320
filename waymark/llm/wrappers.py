"""Main text of web pages by union-free wrappers.

Tags are first balanced (implied end tags are put in, inline markup is dropped), so that the token stream of a page is a
nested list. A wrapper is inferred from all different pages of a host: their streams are aligned in order, level by
level, by longest common subsequences. Neighbours of one name fold into a repeated group, unless all pages have equally
many of them that hold more than text: those are places of a layout and stay apart. Paragraphs, headings, lists and bare
text follow each other in any order and number; a stretch of them is a repeated group of optional members and one text
slot. What only some streams have becomes an optional group. The main part is then the smallest part that holds most of
the text that is not fixed; ``article``, ``main`` and ``role=main`` count ``NAMED`` times there, if they do not repeat. Tags
of menus, asides and the like never are part of it.

A class, id or role is furniture if a whole word of it says so, but only while the element holds at most half of the page's
text; comments always are. ``article`` elements within the main part are comments or teasers and go, unless they hold most of
its text (three quarters), as on a page that lists articles.

A text is fixed where the same text stands at the same path of tags in at least ``FIXED`` different pages and in more
than half of the different pages of a host. Pages with the same texts are copies and count once. A page leaves out
fixed text only where its own text equals it. A page is aligned along its host's wrapper; if it lacks the way to the main
part, or nothing is left of it, it falls to its own main part, found in the same way from the page alone.

Texts are counted by a plain aggregation, skeletons of pages (names and sizes) are merged per task, then per host and
salt, then per host, so the pages of a host need not be gathered. A name with a class, id or role that stands in fewer
than one of ``RARE`` pages aligns by its tag, which keeps wrappers small. Wrappers meet the pages by host and salt.

Defined cases: null html is an empty page with an empty text; a null or odd url has the host "". A host of one page has
that page as its wrapper. Repeated pages each give a row. Unclosed or crossing tags are closed as browsers do at the
next block; text outside of any tag is a block. Other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from hashlib import blake2b
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_lineage

FIXED = 3  # different pages at least, in which a fixed text stands
RARE = 20
NAMED = 4  # times the size of a named part
_SALTS = 8
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key closes an open element of these, up to the listed containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_FURNITURE_TAGS = set("head nav footer aside form script style noscript textarea title button select iframe svg template dialog menu header object audio video canvas".split())
_FURNITURE_WORDS = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice pagination pager popup promo promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget".split())
_COMMENTS = {"comment", "comments", "disqus", "respond"}
_FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form".split())
_MAIN = {"article", "main"}
#: These are never taken for the main part of a page: they are parts of a flow of text.
_FLOW = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr blockquote figure figcaption".split())
SLOT = "~"  # the name of a stretch of flow
#: Bits of alignment rows held at a time; longer lists are halved first.
_ROW_BITS = 1 << 28


class Node:
    """An element, or a text if ``name`` is "#"."""

    __slots__ = ("name", "tag", "text", "kids", "furniture", "doubtful")

    def __init__(self, name: str, tag: str, text: str | None = None, furniture: bool = False, doubtful: bool = False):
        self.name, self.tag, self.text, self.kids = name, tag, text, []
        self.furniture, self.doubtful = furniture, doubtful


def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The name under which an element is aligned, whether it is furniture, and whether only a word says so."""
    furniture, doubtful, name = tag in _FURNITURE_TAGS, False, tag
    if "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if tag not in ("html", "body") and tag not in _MAIN:
                name += f" {key.lower()}={re.sub(r'[0-9]+', '', value)}"
            if key.lower() == "role":
                furniture = furniture or value in _FURNITURE_ROLES
            elif tag not in ("html", "body") and tag not in _MAIN:
                words = set(value.split())
                furniture = furniture or bool(words & _COMMENTS)
                doubtful = doubtful or bool(words & _FURNITURE_WORDS)
    return name, furniture or doubtful, doubtful and not furniture


def parse(page: str) -> Node:
    """The balanced tree of a page; texts still hold their character references and white space."""
    root = Node("", "")
    stack, at, n = [root], 0, len(page)
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag in the stack

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            places[stack.pop().tag].pop()

    def text(value: str) -> None:
        kids = stack[-1].kids
        if kids and kids[-1].name == "#":
            kids[-1].text += value
        elif value and (not value.isspace()):
            kids.append(Node("#", "#", value))

    while at < n:
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if places[tag]:
                close(places[tag][-1])
            continue
        name, furniture, doubtful = _named(tag, token[3])
        if tag in _INLINE and not furniture:
            if tag == "br":
                text(" ")
            continue
        if tag not in _INLINE:
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            if tag in _CLOSES:
                last, within = (max((places[t][-1] for t in tags if places[t]), default=0) for tags in _CLOSES[tag])
                if last > within:
                    close(last)
        node = Node(name, tag, None, furniture, doubtful)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID and not token[3].endswith("/"):
            places[tag].append(len(stack))
            stack.append(node)
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Elements that only a word calls furniture are not if they hold more than half of the page's text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if node.doubtful or not node.furniture:
            todo.extend(node.kids)
    if not any(n.doubtful for n in order):
        return
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = len(node.text.strip()) if node.name == "#" else sum(size.get(id(k), 0) for k in node.kids)
    for node in order:
        if node.doubtful and 2 * size[id(node)] > size[id(root)]:
            node.furniture = False


def _hash(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(parts))).strip()


def _path(path: int, tag: str) -> int:
    return zlib.crc32(tag.encode("utf-8", "surrogatepass"), path)


def _blocks(part: Node, path: int = 0, fixed: frozenset[int] = frozenset()) -> list[str]:
    """The text of a main part by blocks, without furniture, fixed texts and articles within. Its own header is no furniture."""
    blocks, within, parts, todo = [], [], [], [(part, path, False)]
    headed = part.tag not in ("", "html", "body")

    def flush(inner: bool) -> None:
        if block := _clean(parts):
            blocks.append(block)
            within.append(inner)
        parts.clear()

    while todo:
        node, path, inner = todo.pop()
        if node is None:
            flush(inner)
        elif node.name == "#":
            if not fixed or _hash(f"{path} {_clean([node.text])}") not in fixed:
                parts.append(node.text)
        else:
            flush(inner)
            if not node.furniture or (headed and node.tag == "header"):
                now = inner or (node.tag == "article" and node is not part)
                todo.append((None, 0, now))
                todo.extend((k, _path(path, k.tag), now) for k in reversed(node.kids))
    flush(False)
    inner = sum(len(b) for b, i in zip(blocks, within, strict=True) if i)
    if inner and inner < 0.75 * sum(map(len, blocks)):
        return [b for b, i in zip(blocks, within, strict=True) if not i]
    return blocks


def level_of(kids: list, name_of: Callable[[str], str]) -> list[tuple[str, list]]:
    """A level by groups: a stretch of flow is a text slot, other neighbours of one name stand together."""
    groups = [(name, list(same)) for name, same in groupby(kids, lambda k: SLOT if k.tag in _FLOW or k.name == "#" else name_of(k.name))]
    return [("#" if name == SLOT and all(k.name == "#" for k in same) else name, same) for name, same in groups]


def skeleton(tree: Node) -> tuple[int, list, list[int], list[str]]:
    """Of a page: a hash of its texts; its parts in order; the hashes of its texts by path; its long names.

    A part is its name and the number of parts below; a text slot is its name and the sizes and hashes of its texts.
    Furniture is a leaf.
    """
    flat, keys, names, todo = [], set(), set(), [("", [(tree, 0)])]
    while todo:
        slot, members = todo.pop()
        if slot:
            sizes, hashes, inner = [], [], members[::-1]
            while inner:
                node, path = inner.pop()
                if node.name != "#":
                    inner.extend(() if node.furniture else [(k, _path(path, k.tag)) for k in reversed(node.kids)])
                elif text := _clean([node.text]):
                    sizes.append(len(text))
                    hashes.append(_hash(f"{path} {text}"))
            keys.update(hashes)
            flat.append([slot, sizes, hashes])
            continue
        (node, path), = members
        if " " in node.name:
            names.add(node.name)
        below = []
        for name, same in level_of([] if node.furniture else node.kids, str):
            placed = [(k, _path(path, k.tag)) for k in same]
            below += [(name, placed)] if name in (SLOT, "#") else [("", [m]) for m in placed]
        flat.append([node.name, len(below)])
        todo.extend(reversed(below))
    return _hash(" ".join(map(str, sorted(keys)))), flat, sorted(keys), sorted(names)


class Part:
    """A part of a wrapper: ``size`` of its text that is not fixed, and in how many pages it ``led`` its group."""

    __slots__ = ("name", "size", "led", "groups")

    def __init__(self, name: str, size: int = 0, led: int = 0):
        self.name, self.size, self.led, self.groups = name, size, led, []


class Group:
    """Neighbours of one name; if ``many``, one part stands for all of them."""

    __slots__ = ("parts", "many", "pages")

    def __init__(self, parts: list[Part], many: bool = False, pages: int = 1):
        self.parts, self.many, self.pages = parts, many, pages

    @property
    def name(self) -> str:
        return self.parts[0].name


def short(names: frozenset[str]) -> Callable[[str], str]:
    return lambda name: name if " " not in name or name in names else name.split(" ", 1)[0]


def wrapper_of(flat: list, fixed: frozenset[int], names: frozenset[str]) -> Part:
    """The wrapper of one page."""
    name_of, below = short(names), []
    for name, *of in reversed(flat):
        if len(of) == 2:
            below.append(Part(name, sum(size for size, key in zip(*of, strict=True) if key not in fixed)))
            continue
        part = Part(name_of(name))
        kids = [below.pop() for _ in range(of[0])]
        part.size = sum(k.size for k in kids)
        for _, same in groupby(kids, lambda k: k.name):
            group = Group(list(same))
            if len(group.parts) > 1:
                total = sum(p.size for p in group.parts)
                for p in group.parts:
                    p.led = int(2 * p.size > total)
                if all(g.name == "#" for p in group.parts for g in p.groups):
                    _repeated(group)
            part.groups.append(group)
        below.append(part)
    return below[0]


def _repeated(group: Group) -> None:
    group.many = True
    first, *rest = group.parts
    group.parts = [first]
    for other in rest:
        merge(first, other)


def merge(a: Part, b: Part) -> Part:
    """The common form of two parts of one name, in ``a``; ``b`` is used up."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.size, x.led = x.size + y.size, x.led + y.led
        groups, i, j = [], 0, 0
        for i2, j2 in [*common([g.name for g in x.groups], [g.name for g in y.groups]), (len(x.groups), len(y.groups))]:
            groups += x.groups[i:i2] + y.groups[j:j2]
            if i2 < len(x.groups):
                g, h = x.groups[i2], y.groups[j2]
                if g.many or h.many or len(g.parts) != len(h.parts):
                    first, *rest = g.parts
                    todo += [(first, p) for p in reversed([*rest, *h.parts])]
                    g.parts, g.many = [first], True
                else:
                    todo += zip(g.parts, h.parts, strict=True)
                g.pages += h.pages
                groups.append(g)
            i, j = i2 + 1, j2 + 1
        x.groups = groups
    return a


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """A row of the table of longest common subsequences for every item of ``a``; bit j is 0 where the length grows at b[j]."""
    masks: dict[str, int] = defaultdict(int)
    places: dict[str, list[int]] = defaultdict(list)
    for j, name in enumerate(b):
        places[name].append(j)
    for name in set(a) & set(places):
        bits = bytearray(len(b) // 8 + 1)
        for j in places[name]:
            bits[j >> 3] |= 1 << (j & 7)
        masks[name] = int.from_bytes(bits, "little")
    full = row = (1 << len(b)) - 1
    for name in a:
        if mask := masks.get(name, 0):
            met = row & mask
            row = ((row + met) | (row - met)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """The length of the longest common subsequence of ``a`` with every beginning of ``b``."""
    row, out = (1 << len(b)) - 1, [0]
    for row in _rows(a, b):  # noqa: B007
        pass
    for bit in reversed(format(row, f"0{len(b)}b")):
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list[str], b: list[str], bits: int = _ROW_BITS) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of two lists; exact, and of bounded memory for lists of any length."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        if (i2 - i) * (j2 - j) > bits and i2 - i > 1:
            half = (i + i2) // 2
            left, right = _lengths(a[i:half], b[j:j2]), _lengths(a[half:i2][::-1], b[j:j2][::-1])[::-1]
            cut = j + max(range(j2 - j + 1), key=lambda k: left[k] + right[k])
            todo += [(i, half, j, cut), (half, i2, cut, j2)]
            continue
        rows, x, y = list(_rows(a[i:i2], b[j:j2])), i2 - i, j2 - j
        while x and y:
            if rows[x - 1] >> (y - 1) & 1:
                y -= 1
                continue
            x -= 1
            if not x or rows[x - 1] >> (y - 1) & 1:
                y -= 1
                out.append((i + x, j + y))
    return sorted(out)


def way(wrapper: Part) -> list[list]:
    """The steps from the root to the main part: the names of a level, the place of the group, its parts, and the part's place."""
    steps = []
    while True:
        weighed = sum(_weight(g, p) for g in wrapper.groups for p in g.parts)
        for at, group in enumerate(wrapper.groups):
            # One of several places of a layout must hold most of their text on nearly all pages, else they are parts of a whole.
            found = next((n for n, p in enumerate(group.parts) if _weight(group, p) > 0.7 * weighed and (len(group.parts) == 1 or (group.pages >= FIXED and p.led > 0.9 * group.pages))), None)
            if found is not None and not group.many and group.name not in (SLOT, "#"):
                break
        else:
            return steps
        steps.append([[g.name for g in wrapper.groups], at, len(group.parts), found])
        wrapper = group.parts[found]


def _weight(group: Group, part: Part) -> int:
    return part.size * (NAMED if is_named(part.name) and len(group.parts) == 1 and not group.many else 1)


def is_named(name: str) -> bool:
    return name.split(" ", 1)[0] in _MAIN or " role=main" in name


def fixed_text(n: int, pages: int) -> bool:
    return n >= FIXED and 2 * n > pages


def kept_name(n: int, pages: int) -> bool:
    return n * RARE >= pages


def _flat(wrapper: Part) -> list:
    """A wrapper as a list without nesting, which may be deep."""
    out, todo = [], [wrapper]
    while todo:
        node = todo.pop()
        if isinstance(node, Group):
            out.append([int(node.many), node.pages, len(node.parts)])
            todo.extend(reversed(node.parts))
        else:
            out.append([node.name, node.size, node.led, len(node.groups)])
            todo.extend(reversed(node.groups))
    return out


def _unflat(flat: list) -> Part:
    below: list = []
    for *values, n in reversed(flat):
        inner = [below.pop() for _ in range(n)]
        if len(values) == 2:
            below.append(Group(inner, bool(values[0]), values[1]))
        else:
            below.append(Part(*values))
            below[-1].groups = inner
    return below[0]


class Form(NamedTuple):
    """What reading needs of a host: the way to the main part, the fixed texts and the long names in use."""

    steps: list[list]
    fixed: frozenset[int] = frozenset()
    names: frozenset[str] = frozenset()


def infer(pages: list[str]) -> Form:
    """The form of some pages, all of one host, as ``host_wrappers`` finds it from tables."""
    different = sorted({content: rest for content, *rest in map(skeleton, map(parse, pages))}.items())
    fixed = frozenset(k for k, n in Counter(k for _, (_, keys, _) in different for k in keys).items() if fixed_text(n, len(different)))
    names = frozenset(k for k, n in Counter(k for _, (*_, own) in different for k in own).items() if kept_name(n, len(different)))
    wrappers = [wrapper_of(flat, fixed, names) for _, (flat, *_) in different]
    return Form(way(reduce(merge, wrappers)) if wrappers else [], fixed, names)


def _dump(form: Form) -> list:
    return [form.steps, sorted(form.fixed), sorted(form.names)]


@lru_cache(maxsize=512)
def _load(wrapper: str) -> Form:
    steps, fixed, names = json.loads(wrapper)
    return Form(steps, frozenset(fixed), frozenset(names))


def _along(tree: Node, path: int, form: Form) -> list[tuple[Node, int]]:
    """The parts of a page on the way of the steps, each with its path, as far as the page has them."""
    name_of, out = short(form.names), [(tree, path)]
    for level, at, n, place in form.steps:
        groups = level_of(tree.kids, name_of)
        met = next((j for i, j in common(level, [name for name, _ in groups]) if i == at), None)
        if met is None or len(groups[met][1]) != n:
            break
        tree = groups[met][1][place]
        path = _path(path, tree.tag)
        out.append((tree, path))
    return out


def _own_way(part: Node, path: int, form: Form) -> list[tuple[Node, int]]:
    """The same along the way that the part alone has."""
    return _along(part, path, form._replace(steps=way(wrapper_of(skeleton(part)[1], form.fixed, form.names))))


def main_text(page: str, wrapper: str | None = None) -> str:
    """The main text of a page along a wrapper."""
    tree, form, blocks = parse(page), _load(wrapper) if wrapper else Form([]), []
    met = _along(tree, 0, form)
    if len(met) > len(form.steps):
        part, path = met[-1]
        # a host of several layouts may stop above a part that this page names its main one
        if not any(is_named(n.name) for n, _ in met):
            part, path = next((m for m in reversed(_own_way(part, path, form)) if is_named(m[0].name)), (part, path))
        blocks = _blocks(part, path, form.fixed)
    for fixed in (form.fixed, frozenset()):
        if not blocks:
            own = form._replace(fixed=fixed)
            blocks = _blocks(*_own_way(tree, 0, own)[-1], fixed)
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def _skeletons(pages: DataFrame) -> DataFrame:
    """``host, content, tree, keys, names``: one row for every different page of a host, written once."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [skeleton(parse(page)) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c for c, *_ in found], pa.int64()), pa.array([json.dumps(f) for _, f, *_ in found], pa.string()),
                 pa.array([k for *_, k, _ in found], pa.list_(pa.int64())), pa.array([n for *_, n in found], pa.list_(pa.string()))], ["host", "content", "tree", "keys", "names"])

    read = rows.mapInArrow(read_all, "host string, content bigint, tree string, keys array<bigint>, names array<string>")
    return cut_lineage(read.groupBy("host", "content").agg(F.min(F.struct("tree", "keys", "names")).alias("of")).select("host", "content", "of.*"))


def _often(rows: DataFrame, column: str, n: str, kept: Callable) -> DataFrame:
    """Per host the items of a list column that are kept by their number of rows and the number of all rows."""
    totals = rows.groupBy("host").agg(F.count("*").alias("all"))
    counts = rows.select("host", F.explode(column).alias("item")).groupBy("host", "item").agg(F.count("*").alias("n"))
    return counts.join(totals, "host").filter(kept(F.col("n"), F.col("all"))).groupBy("host").agg(F.sort_array(F.collect_list("item")).alias(n))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: one inferred wrapper per host, written once."""
    different = _skeletons(pages)
    hosts = different.select("host").distinct()
    fixed = _often(different, "keys", "fixed", lambda n, of: (n >= FIXED) & (2 * n > of))
    names = _often(different, "names", "kept", lambda n, of: n * RARE >= of)
    known = cut_lineage(hosts.join(fixed, "host", "left").join(names, "host", "left"))
    met = different.select("host", "content", "tree", F.pmod("content", F.lit(_SALTS)).cast("int").alias("salt")).join(_salted(known), ["host", "salt"])
    sorted_ = met.select("host", "salt", "content", "tree", "fixed", "kept").sortWithinPartitions("host", "salt", "content")

    def merge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pages of a host in a task, one after the other."""
        def read() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield (row["host"], row["salt"]), row

        for (host, salt), rows in groupby(read(), lambda r: r[0]):
            wrapper = None
            for _, row in rows:
                if wrapper is None:
                    fixed, names = frozenset(row["fixed"] or ()), frozenset(row["kept"] or ())
                own = wrapper_of(json.loads(row["tree"]), fixed, names)
                wrapper = own if wrapper is None else merge(wrapper, own)
            yield pa.RecordBatch.from_pylist([{"host": host, "salt": salt, "part": json.dumps(_flat(wrapper))}], pa.schema([("host", pa.string()), ("salt", pa.int32()), ("part", pa.string())]))

    def merge_parts(group: pa.Table) -> pa.Table:
        parts = sorted(group.to_pylist(), key=lambda r: (r["salt"], r["part"]))
        wrapper = reduce(merge, (_unflat(json.loads(p["part"])) for p in parts))
        return pa.table({"host": [parts[0]["host"]], "salt": pa.array([parts[0]["salt"]], pa.int32()), "part": [json.dumps(_flat(wrapper))]})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            forms = [Form(way(_unflat(json.loads(r["part"]))), frozenset(r["fixed"] or ()), frozenset(r["kept"] or ())) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["host"] for r in rows], pa.string()), pa.array([json.dumps(_dump(f)) for f in forms], pa.string())], ["host", "wrapper"])

    schema = "host string, salt int, part string"
    parts = sorted_.mapInArrow(merge_pages, schema).groupBy("host", "salt").applyInArrow(merge_parts, schema).groupBy("host").applyInArrow(merge_parts, schema)
    return cut_lineage(parts.join(known, "host").select("host", "part", "fixed", "kept").mapInArrow(finish, "host string, wrapper string"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    wrappers = _salted(host_wrappers(pages))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"),
                        F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int").alias("salt"))
    met = rows.join(wrappers, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper")
    fields = {f.name: f.dataType.simpleString() for f in met.schema}

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, wrapper) for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(read_all, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars bigint")
