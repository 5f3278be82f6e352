"""Visible text of web pages, laid out as a reader sees it.

Tags drive a stack of open elements with the implied end and start tags that pages leave out. Every element knows
whether it is displayed and visible; text of visible ones flows into the block around it. Blocks start on new lines,
paragraph-like ones behind a blank line, list items carry their marker and depth, and a table's cells are written into
columns once the table ends. Nesting is a list, not recursion, so its depth does not matter: the nearest open element of
a tag is looked up, not searched, and a tag without an end is recognised without reading the rest of the page again, so
time grows with the length of a page whatever is wrong with it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import map_rows

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("""head script style title template noscript noembed noframes iframe object audio video canvas
datalist textarea select area base col colgroup link meta param source track""".split())
UNSEEN_FOREIGN = frozenset("annotation annotation-xml defs metadata desc title".split())  # inside svg and math
FOREIGN_LINES = frozenset("text mtr mlabeledtr".split())  # labels and rows that stand on lines of their own
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset form".split())
BLOCKS = PARAGRAPHS | frozenset("""html body div section article aside nav header footer main address li dt dd tr td th
caption thead tbody tfoot figcaption details summary legend center dialog menu option hgroup search""".split())
ENDS_P = BLOCKS - frozenset("html body td th tr thead tbody tfoot caption option".split())
# A start tag closes the nearest open element of the first set, unless one of the second set is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
IN_HEAD = frozenset("title meta link style script base noscript template".split())
SCOPES = frozenset("table td th caption button".split())
PAD = 60  # cells wider than this are written whole, but do not widen their column
INDENT = 40  # levels that are indented; deeper ones stand at the same margin
NEAR = 512  # characters within which nearly all tags end

LISTS = frozenset("ul ol menu table".split())

_OTHER = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?", re.DOTALL)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>")
_ENDS = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_PLACED = re.compile(r"(?:^|\s)(?:x|y|dy)\s*=")
_BARE = re.compile(r"[^\s\"'>]*")
_HINTS = ("hidden", "style", "open", "start", "value", "colspan", "display", "visib")


class _Block:
    """Lines of one flow; ``gap`` is the number of line ends owed before the next text."""

    def __init__(self):
        self.lines, self.line, self.gap, self.margin, self.marker = [], [], 0, "", ""
        self.space = False

    def text(self, data: str, pre: bool):
        if pre:
            head, *rest = data.replace("\r\n", "\n").split("\n")
            self._put(head)
            for line in rest:
                self.end(1, keep=True)
                self._put(line)
            return
        found = _SPACE.sub(" ", data)
        if found[:1] == " ":
            self.space = True
            found = found[1:]
        if not found:
            return
        trailing = found[-1] == " "
        self._put(found[:-1] if trailing else found)
        self.space = trailing

    def _put(self, data: str):
        if not data:
            return
        if self.gap:
            self._flush()
        if not self.line:
            self.line.append(self.margin + self.marker)
            if self.marker:
                self.marker = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(data)

    def _flush(self):
        if self.lines or self.line:
            if self.line:
                self.lines.append("".join(self.line))
            self.lines += [""] * (self.gap - 1)
        self.line, self.gap = [], 0

    def end(self, n: int, keep: bool = False):
        """The line ends; ``n`` of 2 leaves a blank line. ``keep`` adds to what is owed, for breaks one by one."""
        self.space = False
        if keep:
            if self.gap or not self.line:
                self.gap += 1 if self.lines or self.line else 0
            else:
                self.gap = 1
        elif self.line or self.lines:
            self.gap = max(self.gap, n)

    def done(self) -> list[str]:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return [line.rstrip() for line in self.lines]


class _Open:
    """An open element: shown (display), seen (visibility), what its children inherit, and its list or table state."""

    __slots__ = ("tag", "shown", "seen", "inner", "pre", "count", "margin", "block", "rows", "width")

    def __init__(self, tag, shown, seen, inner, pre):
        self.tag, self.shown, self.seen, self.inner, self.pre = tag, shown, seen, inner, pre
        self.count = self.margin = self.block = self.rows = None
        self.width = 1


class _Stack(list):
    """Open elements, with the places of each tag, the open lists, and the number of ``p`` since the last barrier."""

    def __init__(self, root: _Open):
        super().__init__([root])
        self.places: dict[str, list[int]] = {}
        self.blocks, self.tables, self.lists, self.paragraphs = [root.block], [], [], [0]

    def open(self, entry: _Open):
        self.places.setdefault(entry.tag, []).append(len(self))
        self.append(entry)
        if entry.tag in LISTS:
            self.lists.append(entry)
        if entry.block is not None:
            self.blocks.append(entry.block)
        if entry.rows is not None:
            self.tables.append(entry)
        if entry.tag in SCOPES:
            self.paragraphs.append(0)
        elif entry.tag == "p":
            self.paragraphs[-1] += 1

    def shut(self) -> _Open:
        entry = self.pop()
        self.places[entry.tag].pop()
        if entry.tag in LISTS:
            self.lists.pop()
        if entry.block is not None:
            self.blocks.pop()
        if entry.rows is not None:
            self.tables.pop()
        if entry.tag in SCOPES:
            self.paragraphs.pop()
        elif entry.tag == "p":
            self.paragraphs[-1] -= 1
        return entry

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


class _Tags:
    """Ends of tags. A scan that ran to the end of the page in vain is remembered by the places it went through, so that
    no later one follows it."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.marks = self.failed = None

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` is closed, behind the ``>``; -1 if nowhere. Quotes that are not
        closed stand for themselves."""
        if at > self.last:
            return -1
        near = _REST.match(self.page, at, at + NEAR)
        if near:
            return near.end()
        if self.marks is None:
            self.marks, self.failed = [m.start() for m in _ENDS.finditer(self.page)], set()
            self.quotes = {q: [i for i in self.marks if self.page[i] == q] for q in "\"'"}
        passed = []
        i = bisect_left(self.marks, at)
        while i < len(self.marks) and i not in self.failed:
            passed.append(i)
            mark = self.page[self.marks[i]]
            if mark == ">":
                return self.marks[i] + 1
            same = self.quotes[mark]
            closing = bisect_left(same, self.marks[i] + 1)
            i = bisect_left(self.marks, same[closing]) + 1 if closing < len(same) else i + 1
        self.failed.update(passed)
        return -1


def visible_text(page: str | None) -> str:
    """Text of the whole page; empty for NULL and for pages that show nothing."""
    root = _Open("#root", True, True, True, False)
    root.block = _Block()
    stack, at, raw = _Stack(root), 0, None
    page = page or ""
    tags = _Tags(page)
    while at < len(page):
        if raw:
            found = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at, raw = (found.end() if found else len(page)), None
            _close(stack, stack[-1].tag)
            continue
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            _say(stack, page[at:start])
        if start == len(page):
            break
        other = _OTHER.match(page, start)
        if other:
            at = other.end()
            continue
        if start > tags.last:  # no tag ends any more: all is text up to a comment or declaration
            at = min((i for i in (page.find("<!", start), page.find("<?", start)) if i >= 0), default=len(page))
            _say(stack, page[start:at])
            continue
        name = _NAME.match(page, start)
        end = tags.end(name.end()) if name else -1
        if end < 0:
            _say(stack, "<")
            at = start + 1
            continue
        at, rest, tag = end, page[name.end() : end - 1], name[2].lower()
        if name[1]:
            _end_tag(stack, tag)
        else:
            lone = _foreign(stack) and rest.endswith("/") and not _ends_bare(rest)
            _start_tag(stack, tag, rest)
            if lone and tag not in VOID:
                _close(stack, tag)
            elif tag in RAW:
                raw = tag
    while len(stack) > 1:
        _close(stack, stack[-1].tag)
    return "\n".join(root.block.done())


def _foreign(stack: _Stack) -> bool:
    """Inside svg or math, where a tag may also end itself."""
    return stack.has("svg") or stack.has("math")


def _ends_bare(rest: str) -> bool:
    """Whether the tag ends in an attribute value without quotes, which then owns the last slash."""
    run = _BARE.match(rest[::-1]).end()
    return run > 0 and ("=" in rest[len(rest) - run : -1] or rest[: len(rest) - run].rstrip().endswith("="))


def _say(stack: _Stack, data: str):
    top = stack[-1]
    if top.shown and top.inner and top.seen:
        stack.blocks[-1].text(html.unescape(data).replace("\xa0", " ") if "&" in data else data.replace("\xa0", " "), top.pre)


def _attributes(text: str) -> dict[str, str]:
    if not any(h in text.lower() for h in _HINTS):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,6}", value.strip()) else default


def _start_tag(stack: _Stack, tag: str, rest: str):
    if stack[-1].tag == "head" and tag not in IN_HEAD:
        _close(stack, "head")
    if tag in ENDS_P and stack.paragraphs[-1]:
        _close_near(stack, {"p"}, SCOPES)
    if tag in CLOSES:
        _close_near(stack, *CLOSES[tag])
    if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
        _start_tag(stack, "tr", "")
    above = stack[-1]
    attributes = _attributes(rest)
    style = dict(_STYLE.findall(attributes.get("style", "").lower()))
    shown = above.shown and (above.inner or tag == "summary") and tag not in UNSEEN
    shown = shown and "hidden" not in attributes and style.get("display") != "none"
    shown = shown and not (tag == "dialog" and "open" not in attributes)
    foreign = tag in ("svg", "math") or _foreign(stack)
    if foreign:
        shown = shown and not (tag in UNSEEN_FOREIGN or attributes.get("display") == "none")
        style.setdefault("visibility", attributes.get("visibility"))
    seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), above.seen)
    entry = _Open(tag, shown, seen, not (tag == "details" and "open" not in attributes), above.pre or tag == "pre")
    if shown:
        block = stack.blocks[-1]
        if tag == "br":
            block.end(1, keep=True)
        elif tag in BLOCKS and tag not in ("td", "th"):
            nested = tag in ("ul", "ol", "menu") and stack.has("li")
            block.end(2 if tag in PARAGRAPHS and not nested else 1)
        elif foreign and (tag in FOREIGN_LINES or tag == "tspan" and _PLACED.search(rest)):
            block.end(1)
        elif foreign and tag == "mtd":
            block.space = True
        _indent(stack, entry, block, attributes)
        if tag == "table":
            entry.rows = []
        elif tag == "tr":
            if stack.tables:
                stack.tables[-1].rows.append([])
        elif tag in ("td", "th"):
            entry.block, entry.width = _Block(), max(1, min(_number(attributes.get("colspan"), 1), 100))
    if tag not in VOID:
        stack.open(entry)


def _indent(stack: _Stack, entry: _Open, block: _Block, attributes: dict[str, str]):
    if entry.tag in ("ul", "ol", "menu", "dd", "blockquote"):
        entry.margin = block.margin
        if entry.tag in ("dd", "blockquote") or stack.has("li"):
            block.margin += "  " if len(block.margin) < 2 * INDENT else ""
        entry.count = _number(attributes.get("start"), 1) if entry.tag == "ol" else None
    elif entry.tag == "li":
        entry.margin = block.margin
        holder = stack.lists[-1] if stack.lists else None
        if holder is not None and holder.count is not None:
            holder.count = _number(attributes.get("value"), holder.count)
            block.marker = f"{holder.count}. "
            holder.count += 1
        else:
            block.marker = "- "


def _close_near(stack: _Stack, tags, barriers):
    at = stack.nearest(tags)
    if at and at >= stack.nearest(barriers):
        while len(stack) > at:
            _close(stack, stack[-1].tag)


def _end_tag(stack: _Stack, tag: str):
    if tag == "br" or tag == "p" and not stack.paragraphs[-1]:  # stands for a whole element
        _start_tag(stack, tag, "")
    if tag in VOID:
        return
    barriers = () if tag in ("table", "body", "html", "td", "th", "tr", "thead", "tbody", "tfoot") else SCOPES - {tag}
    if tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
        barriers = ("table",)
    _close_near(stack, (tag,), barriers)


def _close(stack: _Stack, tag: str):
    entry = stack.shut()
    if not entry.shown:
        return
    block = stack.blocks[-1]
    if entry.tag in ("td", "th"):
        cell = entry.block.done()
        if stack.tables:
            rows = stack.tables[-1].rows
            if not rows:
                rows.append([])
            rows[-1] += [cell, *[[]] * (entry.width - 1)]
        elif cell:
            block.text("\n".join(cell), True)
    if entry.rows is not None:
        block.text("\n".join(_columns(entry.rows)), True)
    if entry.margin is not None:
        block.margin = entry.margin
        if tag == "li":
            block.marker = ""
    if entry.tag in FOREIGN_LINES and _foreign(stack):
        block.end(1)
    if entry.tag in BLOCKS and entry.tag not in ("td", "th"):
        nested = entry.tag in ("ul", "ol", "menu") and stack.has("li")
        block.end(2 if entry.tag in PARAGRAPHS and not nested else 1)


def _columns(rows: list[list[list[str]]]) -> list[str]:
    """Cells side by side; a column is as wide as its widest line of at most PAD characters."""
    rows = [r for r in rows if any(r)]
    widths: dict[int, int] = {}
    for row in rows:
        for i, cell in enumerate(row[:-1]):
            widths[i] = max([widths.get(i, 0), *(len(line) for line in cell if len(line) <= PAD)])
    found = []
    for row in rows:
        for k in range(max(map(len, row))):
            parts = [cell[k] if k < len(cell) else "" for cell in row]
            line = " | ".join([*(p.ljust(widths[i]) for i, p in enumerate(parts[:-1])), parts[-1]])
            found.append(line.rstrip())
    return found


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page. NULL and empty pages give an empty text; repeated rows are rendered each; a NULL id
    is kept. Other columns are not read; an empty table gives an empty one."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(slices):
        for rows in slices:
            yield {"id": rows["id"], "text": [visible_text(h) for h in rows["html"]]}

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return map_rows(rows, run, f"id {kind}, text string").withColumnRenamed("id", id_col)
