"""HTML extraction by union-free regular-expression inference.

A page's token stream (tags and texts) is folded into a union-free regular expression: nested
tags, ``(...)+`` for a run of like siblings, ``#`` for a text slot. The expressions of one host
are then aligned with each other, one after the other: labels that match are kept, a piece that
only one side has becomes optional, ``(...)?``, and a piece that repeats on one side becomes a
repeated group. The result is the host's wrapper, and pages are read through it: each block of
text falls into one of its slots, and texts are counted by slot. A text that stands in a slot on
``CONSTANT_PAGES`` different pages or more, and on more than half of those that have the slot
(which may be an optional piece or part of a repeated group), is a constant of the wrapper, a
notice or advert of the host, and isn't main text; a page of constants only keeps them.

Distinct expressions are counted by host first (a partial aggregate: a host that holds a third
of all pages is a few rows) and merged in a tree, ``FAN`` of them in a task, as many levels as the
host with the most expressions needs. The wrappers are joined back to the pages by host, where
Spark broadcasts them only if they are measured to be small and may split a hot host otherwise.
Texts are counted by their hashes, and equal pages of a host once. Expressions are cut at ``DEEPEST``
levels, below which slots go by the labels on their way; no text is cut.

Main text is what stands in the page's outermost ``article`` and ``main`` regions, at any depth (beside
a ``main`` element, articles outside only if they hold more text). A page without such a region leaves
the choice to its wrapper: the main text is the smallest container that holds all blocks whose slot
varies, that is whose text is no constant, and that have more text outside links than in them.
The elements and classes listed below are furniture wherever they stand; they serve hosts with too few
pages to tell constants by.
Character references are decoded, white space within a block becomes one blank, blocks
are joined by one newline. White space is Unicode's here, unlike in the other operators: a no-break
space is how pages write a blank (``&nbsp;``).

Defined results: null and empty pages, and pages without main text, give the empty string; a
null url belongs to the host of the empty name; broken or unclosed tags end with their parent; after an
attribute's quote that is never closed, tags end at the next ``>``, and a tag that never ends is text;
repeated rows give repeated rows; an empty table gives an empty table; extra columns are ignored.
Reading a page takes time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
HINT = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PIECE = re.compile(r"[a-z]+")
RAW = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "textarea": re.compile(r"</textarea\s*>", re.I), "title": re.compile(r"</title\s*>", re.I), "noscript": re.compile(r"</noscript\s*>", re.I), "template": re.compile(r"</template\s*>", re.I), "iframe": re.compile(r"</iframe\s*>", re.I)}
#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
FURNITURE = frozenset("nav footer aside form script style noscript template iframe head title button select textarea input label svg canvas object menu dialog fieldset".split())
FURNITURE_HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies share sharing social related recommended newsletter subscribe signup popup modal overlay footer pagination widget toolbar".split())
MAIN = ("article", "main")
#: What makes an article of its own a piece beside the main one.
BESIDE_HINTS = frozenset("comment comments replies related recommended ad ads advert advertisement sponsored promo".split())
ABOUT = frozenset("with without has no is".split())
OUTER = frozenset(["header"])
OUTER_HINTS = frozenset(["header", "masthead"])
#: Elements that hold one block, and those whose headers are the site's.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre".split())
TOP = frozenset(["#root", "html", "body"])
#: Expressions are cut at this depth, and siblings folded in periods up to this length.
DEEPEST, PERIODS = 30, 4
#: Expressions of a host that one task merges, and cells of a table that aligns two sequences in full.
FAN, CELLS = 256, 1 << 16
#: A text is a constant of the wrapper from this number of different pages on.
CONSTANT_PAGES = 3


class Node:
    __slots__ = ("label", "name", "hints", "parts", "shape", "main")

    def __init__(self, name: str, hints: frozenset[str]):
        self.name, self.hints = name, hints
        self.label = ".".join([name, *sorted(hints & (FURNITURE_HINTS | OUTER_HINTS | {"main"}))])
        self.parts: list = []  # texts and nodes in page order


def hints_of(attributes: str) -> frozenset[str]:
    """The words of an element's class, id and role; what says ``with-...`` or ``no-...`` names something else."""
    tokens = " ".join("".join(h[1:]) for h in HINT.findall(attributes)).lower().split()
    pieces = (PIECE.findall(t) for t in tokens)
    return frozenset(x for p in pieces if p and p[0] not in ABOUT for x in p)


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag in turn, comments and declarations with an empty name.

    A caller that skips ahead sends the place to go on from.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            if page.startswith("<!--", lt) and lt >= 0:
                yield lt, n, "", "", ""
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            out = lt, n if end < 0 else end + 3, "", "", ""
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            out = lt, page.index(">", lt) + 1, "", "", ""
        else:
            m = TAG.match(page, lt)
            if not m:
                at = lt + 1
                continue
            rest = ATTRIBUTES.match(page, m.end()) if quotes else None
            if quotes and not rest:
                quotes = False  # a quote that is never closed: found once, by reading to the end
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:
                return
            out = lt, end, m[1], m[2].lower(), page[m.end() : end - 1]
        skip = yield out
        at = skip or out[1]


def parse(page: str) -> Node:
    """The tree of block elements; inline tags are blanks of no width, other tags end what they must."""
    root = Node("#root", frozenset())
    stack, text_from, n = [root], 0, len(page)
    opened: dict[str, int] = {}
    plain = 0  # so many elements of the stack are known not to be furniture
    found = tags(page)
    tag = next(found, None)

    def pop(to: int) -> None:
        for x in stack[to:]:
            opened[x.name] -= 1
        del stack[to:]

    while tag:
        start, at, slash, name, attributes = tag
        if start > text_from:
            stack[-1].parts.append(page[text_from:start])
        if not name:
            pass
        elif name in INLINE:
            if name in ("br", "img"):
                stack[-1].parts.append(" ")
            elif name == "a":
                stack[-1].parts.append(CLOSE_LINK if slash else OPEN_LINK)
        elif slash:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop(k)
        elif name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else n
        else:
            if stack[-1].name == "p" or (name in SELF_ENDING and stack[-1].name == name):
                pop(len(stack) - 1)
            node = Node(name, hints_of(attributes) if attributes else frozenset())
            plain = min(plain, len(stack))
            if name in MAIN and not furniture(node.label, False):
                for x in stack[plain:]:  # what holds the article isn't furniture, whatever its class says
                    if not x.hints & BESIDE_HINTS:
                        x.label = x.name
                plain = len(stack)
            stack[-1].parts.append(node)
            if name not in VOID and not attributes.endswith("/"):
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
        plain = min(plain, len(stack))
        text_from = at
        try:
            tag = found.send(at)
        except StopIteration:
            tag = None
    if text_from < n:
        stack[-1].parts.append(page[text_from:])
    return root


OPEN_LINK, CLOSE_LINK = "\0<", "\0>"

# An expression is [label, flags, children], flags: 1 repeated, 2 optional; a text slot's label is "#".


def merge(a: list, b: list) -> list:
    """The least expression of this form that covers both, for equal labels."""
    return [a[0], a[1] | b[1], align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """Aligns two sequences by a longest common subsequence of their labels; the rest becomes optional.

    Like beginnings and ends are matched first; where what is left between them fills more than
    ``CELLS``, each label is matched with its next place in the other sequence.
    """
    if a == b:
        return a
    n, m, i, z = len(a), len(b), 0, 0
    while i < min(n, m) and a[i][0] == b[i][0]:
        i += 1
    while z < min(n, m) - i and a[n - 1 - z][0] == b[m - 1 - z][0]:
        z += 1
    head = [merge(x, y) for x, y in zip(a[:i], b[:i], strict=True)]
    tail = [merge(x, y) for x, y in zip(a[n - z :], b[m - z :], strict=True)]
    return fold(head + between(a[i : n - z], b[i : m - z]) + tail)


def between(a: list, b: list) -> list:
    n, m, out, i, j = len(a), len(b), [], 0, 0
    optional = lambda x: [x[0], x[1] | 2, x[2]]
    if n * m > CELLS:
        places: dict[str, list[int]] = {}
        for k, y in enumerate(b):
            places.setdefault(y[0], []).append(k)
        for x in a:
            own = places.get(x[0], [])
            k = bisect_left(own, j)
            if k == len(own):
                out.append(optional(x))
            else:
                out += [*map(optional, b[j : own[k]]), merge(x, b[own[k]])]
                j = own[k] + 1
        return out + list(map(optional, b[j:]))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out


def fold(items: list) -> list:
    """Turns runs of like siblings, alone or in periods, into repeated groups."""
    for period in range(1, PERIODS + 1):
        out: list = []
        for x in items:
            out.append(x)
            if len(out) >= 2 * period and all(p[0] == q[0] for p, q in zip(out[-2 * period : -period], out[-period:], strict=True)):
                last = out[-period:]
                del out[-period:]
                for k in range(period):
                    both = merge(out[k - period], last[k])
                    out[k - period] = [both[0], both[1] | 1, both[2]]
        items = out
    return items


def expression(node: Node, depth: int = 0) -> list:
    """A page's own union-free expression."""
    children, text = [], False
    for p in node.parts:
        if isinstance(p, str):
            if not text and p.strip() and p not in (OPEN_LINK, CLOSE_LINK):
                children.append(["#", 0, []])
                text = True
        else:
            text = False
            children.append(expression(p, depth + 1) if depth < DEEPEST else [p.label, 0, []])
    return [node.label, 0, fold(children)]


def written_out(e: list) -> str:
    """The expression as text, for people."""
    inner = "".join(map(written_out, e[2]))
    body = "#" if e[0] == "#" else f"<{e[0]}>{inner}</{e[0].split('.')[0]}>"
    return f"({body}){'+' if e[1] & 1 else ''}{'?' if e[1] & 2 else ''}" if e[1] else body


def furniture(label: str, inside: bool) -> bool:
    """Whether an element isn't main text; ``inside`` a main region, headers belong to it."""
    name, *hints = label.split(".")
    if name in ("body", "html", "#root"):
        return False
    if name in MAIN:
        return any(h in BESIDE_HINTS for h in hints)
    if name in FURNITURE or any(h in FURNITURE_HINTS for h in hints):
        return True
    return not inside and (name in OUTER or any(h in OUTER_HINTS for h in hints))


def blocks(node: Node, inside: bool = True) -> list[tuple[Node, str]]:
    """A region's blocks, each the element it stands in and its text, without furniture; unless ``inside``, headers at the top are the site's."""
    out: list[tuple[Node, str]] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join(references.unescape("".join(now)).split())
        now.clear()
        if text:
            out.append((stack[-1][0], text))

    stack = [(node, iter(node.parts))]
    while stack:
        p = next(stack[-1][1], None)
        if p is None:
            end()
            stack.pop()
        elif isinstance(p, str):
            if p not in (OPEN_LINK, CLOSE_LINK):
                now.append(p)
        else:
            end()
            if not furniture(p.label, inside or stack[-1][0].name not in TOP):
                stack.append((p, iter(p.parts)))
    return out


def unlinked(node: Node) -> tuple[int, int]:
    """Characters of an element's own text outside links and in them."""
    out, within, linked = 0, 0, False
    for p in node.parts:
        if not isinstance(p, str):
            linked = False
        elif p in (OPEN_LINK, CLOSE_LINK):
            linked = p == OPEN_LINK
        elif linked:
            within += len(p.strip())
        else:
            out += len(p.strip())
    return out, within


def text_size(node: Node) -> int:
    """Characters outside links in a region."""
    size, stack = 0, [node]
    while stack:
        x = stack.pop()
        size += unlinked(x)[0]
        stack += [p for p in x.parts if not isinstance(p, str) and not furniture(p.label, True)]
    return size


def regions(root: Node) -> list[Node]:
    """The page's main regions, outermost ones, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        name, *hints = node.label.split(".")
        if furniture(node.label, False):
            continue
        if name in MAIN or "main" in hints:
            found.append(node)
            continue
        stack += [p for p in reversed(node.parts) if not isinstance(p, str)]
    if len(found) > 1 and any(x.name == "main" for x in found):
        most = sum(text_size(x) for x in found if x.name == "main")
        if sum(text_size(x) for x in found if x.name == "article") <= most:
            found = [x for x in found if x.name != "article"]
    return found


def container(root: Node, constant: frozenset[int] | set[int] = frozenset()) -> Node | None:
    """The smallest element that holds all blocks with more text outside links than in them, for pages without a main region.

    Elements whose text is ``constant`` (by ``id``) aren't asked.
    """
    order, parent = [root], [-1]
    for k, node in enumerate(order):  # grows while it is read
        for p in node.parts:
            if not isinstance(p, str) and not furniture(p.label, False):
                order.append(p)
                parent.append(k)
    sizes = [(0, 0) if id(x) in constant else unlinked(x) for x in order]
    dense = [k for k, (out, within) in enumerate(sizes) if out > within] or [k for k, (out, _) in enumerate(sizes) if out]
    if not dense:
        return None
    held = [0] * len(order)
    for k in dense:
        held[k] = 1
    for k in range(len(order) - 1, 0, -1):
        held[parent[k]] += held[k]
    best = max(k for k in range(len(order)) if held[k] == len(dense))  # these are a path from the root
    while best and order[best].name in TEXT_ELEMENTS:
        best = parent[best]
    return order[best]


def number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def compiled(e: list) -> tuple[dict[str, list[int]], list]:
    """A wrapper node for reading: places of its children by label, and the children."""
    places: dict[str, list[int]] = {}
    for k, c in enumerate(e[2]):
        places.setdefault(c[0], []).append(k)
    return places, [compiled(c) for c in e[2]]


def slots(root: Node, wrapper: tuple[dict[str, list[int]], list] | None) -> dict[int, int]:
    """Each element's slot by ``id``: its place in the wrapper.

    Siblings take the wrapper's pieces from left to right, and begin anew where a group repeats. What
    the wrapper doesn't reach (below ``DEEPEST``) goes by its labels.
    """
    out, stack = {id(root): 1}, [(root, wrapper, 1)]
    while stack:
        node, at, slot = stack.pop()
        now = 0
        for p in node.parts:
            if isinstance(p, str):
                continue
            places = at[0].get(p.label) if at else None
            if places:
                k = bisect_left(places, now)
                now = places[k if k < len(places) else 0]
                inner, step = at[1][now], now
            else:
                inner, step = None, zlib.crc32(p.label.encode()) | 1 << 32
            own = (slot * 0x9E3779B97F4A7C15 + step + 1) % (1 << 63)
            own ^= own >> 29
            out[id(p)] = own
            stack.append((p, inner, own))
    return out


def candidate_blocks(root: Node) -> tuple[list[tuple[Node, str]], bool]:
    """The blocks that may be main text, and whether they are those of main regions."""
    got = regions(root)
    return ([x for node in got for x in blocks(node)], True) if got else (blocks(root, False), False)


def main_text(page: str, wrapper: tuple[dict[str, list[int]], list] | None = None, constants: frozenset[tuple[int, int]] = frozenset()) -> str:
    """The page's main text, without the wrapper's constants: (slot, text's number)."""
    root = parse(page)
    got, regional = candidate_blocks(root)
    fixed: list[tuple[Node, str]] = []
    if constants:
        slot = slots(root, wrapper)
        fixed = [x for x in got if (slot[id(x[0])], number(x[1])) in constants]
        if len(fixed) == len(got):
            fixed = []  # a page of constants only keeps them
    if not regional:
        one = container(root, {id(node) for node, _ in fixed})
        got = blocks(one, False) if one else []
    if fixed:
        gone = {(id(node), text) for node, text in fixed}
        got = [x for x in got if (id(x[0]), x[1]) not in gone]
    return "\n".join(text for _, text in got)


@lru_cache(maxsize=1024)
def wrapper_places(wrapper: str) -> tuple[dict[str, list[int]], list]:
    return compiled(json.loads(wrapper))


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper, pages): each host's wrapper as JSON, and its number of pages; ``fan`` expressions are merged at a time."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [json.dumps(expression(parse(x.as_py() or "")), separators=(",", ":")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.string())], names=["host", "wrapper"])

    def merged(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("wrapper").to_pylist(), t.column("pages").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
        whole = None
        for w, _ in rows:
            e = json.loads(w)
            whole = e if whole is None else merge(whole, e)
        return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [json.dumps(whole, separators=(",", ":"))], "pages": pa.array([sum(n for _, n in rows)], pa.int64())})

    schema = "host string, wrapper string, pages long"
    seen = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(shapes, "host string, wrapper string")
    seen = written(seen.groupBy("host", "wrapper").agg(F.count("*").alias("pages")), "expressions")
    while True:
        parts = seen.groupBy("host").agg(F.ceil(F.count("*") / fan).alias("parts"))
        if (parts.agg(F.max("parts")).first()[0] or 1) <= 1:
            return seen.groupBy("host").applyInArrow(lambda t: merged(t), schema)
        salted = seen.join(parts, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.col("parts")))
        seen = written(salted.groupBy("host", "salt").applyInArrow(lambda t: merged(t), schema), "expressions")


def with_wrappers(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The pages, each with the columns of its host's row."""
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("_own"))
    return own.join(wrappers.withColumnRenamed("host", "_host"), F.col("_own") == F.col("_host"), "left")


def find_constants(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, slots, texts): the constants of each host's wrapper, for hosts that have any; parallel arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = set()
                for h, page, w in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    root = parse(page)
                    slot, fingerprint = slots(root, wrapper_places(w)), number(page)
                    for node, text in candidate_blocks(root)[0]:
                        rows.add((h, slot[id(node)], number(text), fingerprint))
                        rows.add((h, slot[id(node)], None, fingerprint))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "slot", "text", "page"])

    read = with_wrappers(pages, wrappers).where(F.col("html").isNotNull() & F.col("wrapper").isNotNull()).select("_own", "html", "wrapper")
    seen = read.mapInArrow(run, "host string, slot long, text long, page long").groupBy("host", "slot", "text").agg(F.count_distinct("page").alias("n"))
    seen = written(seen.where(F.col("n") >= CONSTANT_PAGES), "slots")
    own, all_ = seen.where("text IS NOT NULL"), seen.where("text IS NULL").select("host", "slot", F.col("n").alias("of"))
    return own.join(all_, ["host", "slot"]).where("2 * n > of").groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("text").alias("texts"))


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    wrappers = written(infer_wrappers(pages), "wrappers").select("host", "wrapper")
    constants = written(find_constants(pages, wrappers), "constants")
    known = written(wrappers.join(constants, "host", "left"), "read")  # so that Spark knows its size and needn't shuffle the pages for a small one
    joined = with_wrappers(pages, known).select("page_id", "url", "html", "wrapper", "slots", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = []
                for page, w, s, t in zip(*(part.column(k).to_pylist() for k in range(2, 6)), strict=True):
                    known = frozenset(zip(s, t, strict=True)) if s else frozenset()
                    texts.append(main_text(page or "", wrapper_places(w) if w and known else None, known))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
