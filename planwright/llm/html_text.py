"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied end tags read a page as browsers do, leniently; rules of
visibility drop what is not shown; a renderer then emits all visible text with the spacing of its
layout: blank lines around paragraphs and headings, list marks and indents, table cells aligned in
columns, preformatted text as it is.

Scale: a map over pages; each is parsed alone.  Open elements are found by their kind and nesting is no
recursion, so elements of any depth are read, matched with their end tags and hidden as those above them.
Lists and quotations indent their lines up to ``DEPTH`` deep; below that lines and marks stay, without
more indent, since deep lists would have more blanks than a page has letters.
Edge cases: null or empty html has text "" and no lines; broken markup never fails; equal pages have
equal text; an empty table gives an empty result; an ``out`` column that exists already is an error.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DEPTH = 150
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript title iframe object audio video canvas datalist input meta link base annotation annotation-xml".split())
#: What an svg doesn't draw where it stands.
UNDRAWN = set("defs desc metadata symbol clippath mask pattern marker".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
SPACED = HEADINGS | set("p ul ol dl blockquote pre xmp table figure fieldset hr".split())
BLOCK = SPACED | set("html body div article section nav header footer main aside address form li dt dd tr td th thead tbody tfoot caption center details summary figcaption legend hgroup dialog".split())
#: A start tag of the key ends open elements of these kinds, up to the nearest of the stops.
CLOSES_P = BLOCK - set("html body li dt dd tr td th thead tbody tfoot caption summary legend".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
SCOPE = set("table td th caption button object html body".split())
#: Where a token begins; a tag of usual size is read at once, with bounds on all of its parts.
OPENS = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9-]{0,30}+(?=[\s/>]))((?:[^>\"']{0,200}+(?:\"[^\"]{0,500}+\"|'[^']{0,500}+')?+){0,8}+)>|/?[a-zA-Z]|[!?])")
NAME_ENDS = re.compile(r"[\s/>]")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip(" /") else {}


def positions(pattern: re.Pattern, page: str) -> list[int]:
    return [m.start() for m in pattern.finditer(page)]


def tokens(page: str):
    """Comments and tags as (start, end, slash, name, attributes); name is None for comments and the like.  Send a place to go on from there.

    A tag ends at the first ``>`` outside quotes.  Scans step from one ``>`` or quote to the next, and a step from
    which no end was found is never tried again, so the time is linear in the page, tags or not."""
    names = special = pair = None
    hopeless = set()

    def prepare():
        nonlocal names, special, pair
        names, special = positions(NAME_ENDS, page), positions(SPECIAL, page)
        pair, later = [len(special)] * len(special), {}
        for k in range(len(special) - 1, -1, -1):
            pair[k] = later.get(page[special[k]], len(special))
            later[page[special[k]]] = k

    def ends(at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``; -1 without one."""
        k, way = bisect_left(special, at), []
        while k < len(special) and k not in hopeless:
            if page[special[k]] == ">":
                return special[k]
            way.append(k)
            k = pair[k] + 1
        hopeless.update(way)
        return -1

    at = 0
    while m := OPENS.search(page, at):
        at = start = m.start()
        if m[2]:
            at = m.end()
            at = (yield start, at, m[1], m[2], m[3]) or at
            continue
        if page[start + 1] in "!?":
            mark = "-->" if page.startswith("<!--", start) else ">"
            stop = page.find(mark, start + (4 if mark == "-->" else 2))
            at = len(page) if stop < 0 else stop + len(mark)
            at = (yield start, at, "", None, "") or at
            continue
        if names is None:
            prepare()
        slash = page[start + 1] == "/"
        k = bisect_left(names, start + 1 + slash)
        after = names[k] if k < len(names) else len(page)
        stop = ends(after)
        if stop < 0:
            at = start + 1
            continue
        at = stop + 1
        at = (yield start, at, "/" * slash, page[start + 1 + slash : after], page[after:stop]) or at


def parse(page: str) -> Node:
    root = Node("#root")
    stack, at, low = [root], 0, None
    places = defaultdict(list)  # of the open elements of each kind in the stack, rising

    def cut_to(n: int):
        for node in stack[n:]:
            places[node.tag].pop()
        del stack[n:]

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if t in places and places[t]), default=0)

    def text(s: str):
        if s:
            if stack[-1].tag == "head" and s.strip(" \t\r\n\f"):
                cut_to(len(stack) - 1)
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def end(tags: set[str], stops: set[str]):
        """Closes the outermost open element of ``tags`` above the nearest stop."""
        above = nearest(stops)
        found = [p[k] for t in tags if t in places and (p := places[t]) and (k := bisect_right(p, above)) < len(p)]
        if found:
            cut_to(min(found))

    found, jump = tokens(page), None
    while True:
        try:
            start, stop, slash, name, attrs = found.send(jump)
        except StopIteration:
            break
        jump = None
        text(page[at:start])
        at = stop
        if not name:
            continue
        tag = name.lower()
        if slash:
            i = nearest((tag,))
            # An end tag inside a cell closes nothing outside of it.
            if i and (tag in ("tr", "table", "tbody", "thead", "tfoot", "body", "html") or i >= nearest(("td", "th", "table"))):
                cut_to(i)
            continue
        if tag in CLOSES_P:
            end({"p"}, SCOPE)
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            cut_to(len(stack) - 1)
        if stack[-1].tag == "head" and tag not in HIDDEN:
            cut_to(len(stack) - 1)
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            low = low if low is not None else page.lower()  # same length for ASCII; else found again below
            stop = low.find(f"</{tag}", at) if len(low) == len(page) else getattr(re.compile(f"</{tag}", re.I).search(page, at), "start", lambda: -1)()
            stop = len(page) if stop < 0 else stop
            if tag in ("textarea", "title"):
                node.kids.append(html.unescape(page[at:stop]))
            elif tag == "xmp":
                node.kids.append(page[at:stop])
            close = page.find(">", stop)
            at = jump = len(page) if close < 0 else close + 1
        elif tag not in VOID and not attrs.endswith("/") or tag in BLOCK:
            if tag not in VOID:
                places[tag].append(len(stack))
                stack.append(node)
    text(page[at:])
    return root


def shown(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attrs or "hid" not in node.attrs.lower() and "none" not in node.attrs.lower() and "collapse" not in node.attrs.lower():
        return node.tag != "dialog" or "open" in node.attributes()
    a = node.attributes()
    return "hidden" not in a and not UNSEEN.search(a.get("style", ""))


class Lines:
    """Lines with collapsing margins between blocks.

    A block within writes its lines to the same list: it starts at ``base``, and the margin before it,
    ``outer``, is kept until its first line; its own margins end with it."""

    def __init__(self, level: int = 0):
        self.level, self.base, self.outer = level, 0, 0
        self.out: list[str] = []
        self.gap = 0
        self.inline: list[str] = []

    def flush(self):
        s = "".join(self.inline)
        self.inline.clear()
        lines = [SPACE.sub(" ", x).strip(" ") for x in s.split("\x00")]  # a break is kept as NUL until here
        while lines and not lines[-1]:
            lines.pop()
        if any(lines):
            self.add(lines)

    def margin(self, n: int):
        self.flush()
        self.gap = max(self.gap, n)

    def pending(self) -> int:
        return self.gap if len(self.out) > self.base else self.outer

    def add(self, lines: list[str]):
        if self.out:
            self.out += [""] * self.pending()
        self.gap = 0
        self.out += lines

    def enter(self):
        state = self.base, self.outer, self.gap
        self.base, self.outer, self.gap = len(self.out), self.pending(), 0
        return state

    def leave(self, state, mark: str = "", rest: str = ""):
        """Ends a block; its first line gets ``mark`` and the others ``rest``."""
        self.flush()
        out, start = self.out, self.base + (self.outer if self.base else 0)
        if some := len(out) > self.base:
            if out[start]:
                out[start] = mark + out[start]
            for i in range(start + 1, len(out)) if rest else ():
                out[i] = rest + out[i] if out[i] else out[i]
        self.base, self.outer, gap = state
        self.gap = 0 if some else gap


def driven(call):
    """The value of a generator that yields the calls it makes and gets their values: recursion of any depth."""
    calls, value = [call], None
    while calls:
        try:
            calls.append(calls[-1].send(value))
            value = None
        except StopIteration as e:
            calls.pop()
            value = e.value
    return value


def layout(node: Node, level: int = 0):
    """The lines of a block's contents; by ``driven``, as all below that yields."""
    box = Lines(level)
    yield _into(box, node)
    box.flush()
    return box.out


def _into(box: Lines, node: Node):
    number = 1
    ordered = node.tag == "ol"
    for kid in node.kids:
        if isinstance(kid, str):
            box.inline.append(kid.replace("\x00", ""))
            continue
        if not shown(kid):
            continue
        tag = kid.tag
        if tag == "br":
            box.inline.append("\x00")
        elif tag == "img":
            box.inline.append(f" {kid.attributes().get('alt', '')} ")
        elif tag == "textarea":
            box.inline.append(f" {_plain(kid)} ".replace("\x00", "").replace("\n", "\x00"))
        elif tag == "select":
            box.inline.append(" " + "\x00".join(_options(kid)) + " ")
        elif tag == "svg":
            yield _drawn(box, kid)
        elif tag not in BLOCK:
            yield _into(box, kid)
        else:
            space = 1 if tag in SPACED and node.tag not in ("li", "td", "th") else 0
            box.margin(space)
            if tag == "hr":
                box.add(["---"])
            elif tag in ("pre", "xmp"):
                raw = _plain(kid).strip("\n")
                if raw.strip():
                    box.add(raw.split("\n"))
            elif tag == "table":
                if lines := (yield _table(kid, box.level)):
                    box.add(lines)
            else:
                mark = rest = ""
                if tag == "li":
                    mark = f"{number}. " if ordered else "- "
                    number += 1
                    rest = " " * len(mark)
                elif tag in ("dd", "blockquote"):
                    mark = rest = "  "
                deep = box.level >= DEPTH
                box.level += bool(mark)
                state = box.enter()
                yield _into(box, kid)
                box.leave(state, mark.lstrip() if deep else mark, "" if deep else rest)
                box.level -= bool(mark)
            box.margin(space)


def _seen(node: Node, skip=frozenset()):
    """The shown contents of ``node`` in order, texts and elements; what is sent back true isn't entered."""
    todo = [iter(node.kids)]
    while todo:
        for kid in todo[-1]:
            if isinstance(kid, str):
                yield kid
            elif kid.tag not in skip and shown(kid) and not (yield kid):
                todo.append(iter(kid.kids))
                break
        else:
            todo.pop()


def _plain(node: Node) -> str:
    return "".join(k if isinstance(k, str) else "\n" if k.tag == "br" else "" for k in _seen(node))


def _options(node: Node) -> list[str]:
    """The texts that a select shows: all options of a list box, the selected or else the first one of a menu."""
    options = [k for k in _seen(node) if isinstance(k, Node) and k.tag == "option"]
    a = node.attributes()
    if not ("multiple" in a or a.get("size", "").isdigit() and int(a["size"]) > 1):
        options = [k for k in options if "selected" in k.attributes()][-1:] or options[:1]
    return [SPACE.sub(" ", _plain(k).replace("\x00", "")).strip() for k in options]


def _drawn(box: Lines, node: Node):
    """The texts of an svg and the HTML within it."""
    parts, kid = _seen(node, UNDRAWN), None
    while True:
        try:
            kid = parts.send(kid is not None and not isinstance(kid, str) and kid.tag in ("text", "foreignobject") or None)
        except StopIteration:
            return
        if isinstance(kid, Node) and kid.tag in ("text", "foreignobject"):
            box.inline.append(" ")
            yield _into(box, kid)
            box.inline.append(" ")


def _number(attrs: dict[str, str], name: str, most: int, least: int = 1) -> int:
    m = re.match(r"\s*\+?([0-9]{1,9})", attrs.get(name, ""))
    return min(int(m[1]), most) if m and int(m[1]) >= least else 1


def _rows(node: Node, level: int):
    """(cells, group) of each row of a table; what stands in it outside of cells, with no group."""
    rows = []
    for part in node.kids:
        for kid in part.kids if isinstance(part, Node) and part.tag in ("thead", "tbody", "tfoot") and shown(part) else (part,):
            if isinstance(kid, str):
                if kid.strip():
                    rows.append((kid, None))
            elif not shown(kid):
                continue
            elif kid.tag == "tr":
                cells = []
                for c in kid.kids:
                    if isinstance(c, str):
                        if c.strip():
                            cells.append(((yield layout_of(c, level)), 1, 1))
                    elif shown(c):
                        a = c.attributes()
                        lines = yield (layout(c, level) if c.tag in ("td", "th") else layout_of(c, level))
                        cells.append((lines, _number(a, "colspan", 1000), _number(a, "rowspan", 65534, 0)))
                rows.append((cells, part))
            else:
                rows.append((kid, None))
    return rows


def layout_of(item, level: int = 0):
    wrap = Node("#part")
    wrap.kids.append(item)
    return layout(wrap, level)


def _table(node: Node, level: int):
    rows = yield _rows(node, level)
    placed: list = []  # of each row, its cells by column: (column, lines, span)
    width: dict[int, int] = {}  # of the columns in which a cell starts
    taken: list = []  # (first column, column after, row after) of the cells that span rows, rising
    last, until = None, 0
    for r, (cells, group) in enumerate(rows):
        if group is None:
            placed.append(cells)
            continue
        if group is not last and not (last is not None and last.tag == group.tag == "tr"):
            taken = []
        elif until <= r:
            taken = [x for x in taken if x[2] > r]
            until = min((x[2] for x in taken), default=0)
        last, row, k, i, under = group, [], 0, 0, []
        for lines, span, down in cells:
            while i < len(taken) and taken[i][0] <= k:
                k = max(k, taken[i][1])
                i += 1
            row.append((k, lines, span))
            width[k] = max([width.get(k, 0), *(map(len, lines) if span == 1 else ())])
            if down != 1:
                under.append((k, k + span, r + down if down else len(rows)))
            k += span
        if under:
            taken = sorted(taken + under)
            until = min(x[2] for x in taken)
        placed.append(row)
    start, x = {}, 0
    for c in sorted(width):
        start[c] = x
        x += width[c] + 2
    out = []
    for row in placed:
        if not isinstance(row, list):
            out += yield layout_of(row, level)
            continue
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            line = ""
            for k, lines, _ in row:
                # A wide cell of several columns moves those after it.
                line = line.ljust(start[k]) if len(line.rstrip()) <= max(start[k] - 2, 0) else line + "  "
                line += lines[i] if i < len(lines) else ""
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    return "\n".join(driven(layout(parse(page)))).strip("\n") if page else ""


def extract(df: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the visible text of column ``source``."""
    if out in df.columns:
        raise ValueError(f"column exists already: {out}")

    def texts(it):
        for s in it:
            yield pd.Series([render(x) for x in s], index=s.index, dtype=object)

    texts.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(texts, "string")(F.col(source)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
