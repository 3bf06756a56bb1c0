"""HTML extraction by layout-aware rendering.

A tree builder reads tags, supplies the end tags that HTML implies, and keeps a
stack of open elements. An element is laid out when it closes: inline text
collapses to single blanks, blocks stand on lines of their own with a blank
line where the browser leaves space, list items get bullets or numbers and
hang, and the cells of a table are padded to columns. What a browser doesn't
show is not emitted: head, scripts, styles, templates, hidden elements, what a
closed disclosure holds, the options of a drop-down that aren't chosen, what a
drawing holds besides texts. Style sheets are not read, only style attributes.
Everything else is: navigation and boilerplate are visible text too. Formulas
are inline text; parts that stand over or beside each other are kept apart.

Cases: a null or empty page is an empty text; pages of any length and depth are
rendered whole, without recursion; unclosed and stray tags are repaired; repeated
rows are rendered alike; an empty table gives an empty result; extra columns
pass through ``render_pages`` untouched unless one is called ``text``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Quotes count only after an equals sign; one that never ends goes on to the next bracket.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[\"'][^>]*+|[^\s>\"']*+))*+)>"
    r"|([^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template title meta link base noscript iframe noembed noframes object audio video canvas "
    "datalist map param source track area embed rp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer main nav address li dt dd tr td th thead tbody tfoot "
    "caption form figcaption details summary center legend hgroup search dialog".split()
)
#: An opening tag of the key closes open elements of the set, up to one of the fence.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "colgroup"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "colgroup"}), frozenset({"tr", "table"})),
    **{
        k: (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"}))
        for k in ("thead", "tbody", "tfoot")
    },
    **{k: (frozenset({"caption", "colgroup"}), frozenset({"table", "td", "th"})) for k in ("caption", "colgroup")},
    "body": (frozenset({"head"}), frozenset()),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
#: A paragraph ends where one of these begins, unless one of the fence lies between.
PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend"}
FENCE = frozenset({"td", "th", "caption", "button", "table", "object"})
#: Where rows or cells go, and what keeps its content from them.
FRAME = frozenset({"table", "thead", "tbody", "tfoot", "tr"})
CELLS = frozenset({"td", "th", "caption"})
#: In drawings and formulas: what isn't shown, what HTML may stand in, and the tags of HTML that end them.
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
HOLDS_HTML = frozenset("foreignobject mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: What stands over or beside its neighbours in a formula or drawing, so that a blank keeps it apart.
BESIDE = frozenset({"mtd", "mtr", "text"})
BREAK = object()
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
VEILED = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: White space that collapses; a no-break space doesn't.
BLANKS = re.compile(r"[ \t\n\r\f]+")
#: Fields that show no text of their own.
SILENT = frozenset("hidden password checkbox radio file image range color".split())


def _collapsed(text: str) -> str:
    return BLANKS.sub(" ", text).strip(" ")


class Block:
    """Lines of a laid-out element, and whether blank lines keep it apart."""

    __slots__ = ("lines", "apart")

    def __init__(self, lines: list[str], apart: bool):
        self.lines, self.apart = lines, apart


class Option:
    """An option of a drop-down: its text, whether it is selected, and whether it can be."""

    __slots__ = ("text", "selected", "usable")

    def __init__(self, text: str, selected: bool, usable: bool):
        self.text, self.selected, self.usable = text, selected, usable


class Element:
    """An open element and what was laid out of it so far."""

    __slots__ = ("tag", "hidden", "keeps", "veiled", "parts", "items", "span", "rows", "framed", "given")

    def __init__(self, tag: str, hidden: bool, keeps: bool, veiled: bool = False):
        self.tag, self.hidden, self.keeps = tag, hidden, keeps
        #: Unseen, though what it holds may show itself.
        self.veiled = veiled
        self.parts: list = []
        #: Items of a numbered list: (block, lines, number given).
        self.items: list[tuple[Block, list[str], int | None]] = []
        self.span, self.rows = 1, 1
        #: Whether rows and cells in it belong to a table around it.
        self.framed = False
        #: Attributes, where they count when it closes.
        self.given: dict[str, str] = {}


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


def _flow(parts: list, keeps: bool) -> list[str]:
    """Lines of a mixture of inline text, line breaks and blocks."""
    lines: list[str] = []
    inline: list[str] = []
    apart = False

    def settle(broken: bool = False) -> None:
        nonlocal apart
        text = "".join(inline)
        inline.clear()
        found = text.split("\n") if keeps else [_collapsed(text)]
        if keeps and found and not found[-1].strip():
            found.pop()
        if any(x.strip() for x in found) or broken and text:
            if apart and lines:
                lines.append("")
            apart = False
            lines.extend(x.rstrip() for x in found)

    for part in _framed(parts) if any(isinstance(x, (list, tuple)) for x in parts) else parts:
        if isinstance(part, str):
            inline.append(part)
        elif part is BREAK:
            settle(True)
        else:
            settle()
            if not part.lines:
                continue
            if lines and (apart or part.apart):
                lines.append("")
            lines.extend(part.lines)
            apart = part.apart
    settle()
    return lines


def _hang(lines: list[str], mark: str) -> list[str]:
    pad = " " * len(mark)
    return [(mark if i == 0 else pad if x else "") + x for i, x in enumerate(lines)] or [mark.rstrip()]


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns spanned, rows spanned), padded so that columns align."""
    widths: dict[int, int] = {}
    placed, held, wide_cells = [], {}, []
    for row in rows:
        at, own = 0, []
        for lines, span, down in row:
            while held.get(at, 0):  # a cell from above still stands here
                at += 1
            own.append((at, lines))
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(_width, lines), default=0))
            else:
                wide_cells.append((at, span, max(map(_width, lines), default=0)))
            for column in range(at, at + span):
                held[column] = max(held.get(column, 0), down)
            at += span
        placed.append(own)
        held = {c: n - 1 for c, n in held.items() if n > 1}
    for at, span, wide in wide_cells:
        # What a cell needs beyond its columns widens the last of them.
        spare = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
        if wide > spare:
            widths[at + span - 1] = widths.get(at + span - 1, 0) + wide - spare
    offsets, total = {}, 0
    for column in range(max((at for own in placed for at, _ in own), default=0) + 1):
        offsets[column] = total
        total += widths.get(column, 0) + 2
    out = []
    for own in placed:
        for k in range(max((len(lines) for _, lines in own), default=0)):
            line, wide = "", 0
            for at, lines in own:
                cell = lines[k] if k < len(lines) else ""
                room = max(offsets[at] - wide, 2 if line.strip() else 0)
                line, wide = line + " " * room + cell, wide + room + _width(cell)
            out.append(line.rstrip())
    return out


def _numeral(n: int, style: str) -> str:
    """The number of an item: letters, roman numerals or digits."""
    if style in ("a", "A") and n > 0:
        text = ""
        while n:
            n, rest = divmod(n - 1, 26)
            text = chr(97 + rest) + text
    elif style in ("i", "I") and 0 < n < 4000:
        text, left = "", n
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            text += sign * (left // value)
            left %= value
    else:
        return str(n)
    return text.upper() if style.isupper() else text


def _integer(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[+-]?[0-9]{1,9}", text.strip()) else None


def _rows(parts: list) -> list[list]:
    """Rows among parts, where cells without a row make rows of their own."""
    rows: list[list] = []
    loose = None
    for part in parts:
        if isinstance(part, tuple):
            if loose is None:
                loose = []
                rows.append(loose)
            loose.append(part)
        elif isinstance(part, list):
            rows.append(part)
            loose = None
    return rows


def _shown(options: list[Option], given: dict[str, str]) -> str:
    """What a drop-down shows: the selected option or the first that can be; a list shows all."""
    size = given.get("size", "")
    if "multiple" in given or size.isdigit() and int(size[:9]) > 1:
        found = options
    else:
        found = [x for x in options if x.selected][-1:] or [x for x in options if x.usable][:1]
    return " ".join(x.text for x in found)


def _framed(parts: list) -> list:
    """The parts, with rows and cells that no table holds laid out as if one did."""
    out: list = []
    run: list = []
    for part in [*parts, None]:
        if isinstance(part, (list, tuple)):
            run.append(part)
        elif not (run and isinstance(part, str) and part.isspace()):
            if run:
                out.append(Block(_grid(_rows(run)), True))
                run = []
            if part is not None:
                out.append(part)
    return out


class Page:
    """The tree builder: feed it a page, then ask for its text."""

    def __init__(self):
        self.open = [Element("#page", False, False)]
        #: How many elements of a tag are open, so that a stack is searched only for what it holds.
        self.count: Counter[str] = Counter()

    def start(self, tag: str, rest: str) -> None:
        given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest.strip("/ \t\r\n") else {}
        foreign = bool(self.count["svg"] or self.count["math"])
        if foreign and tag in ENDS_FOREIGN:
            self._close_first(frozenset({"svg", "math"}), HOLDS_HTML)
            foreign = bool(self.count["svg"] or self.count["math"])
        if tag in PARAGRAPH:
            self._close_first(frozenset({"p"}), FENCE)
        if tag in CLOSES:
            self._close_all(*CLOSES[tag])
        if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6") and self.open[-1].tag in SPACED and self.open[-1].tag[0] == "h":
            self._close()
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Element("tr", self.open[-1].hidden, False, self.open[-1].veiled))
        top = self.open[-1]
        style = given.get("style", "")
        seen = VEILED.findall(style)
        veiled = seen[-1].lower() != "visible" if seen else top.veiled
        hidden = (
            top.hidden
            or top.tag == "details" and "open" not in top.given and tag != "summary"
            or tag in UNSEEN
            or foreign and tag in UNDRAWN
            or "hidden" in given
            or tag == "dialog" and "open" not in given
            or bool(HIDDEN.search(style))
        )
        shown = not hidden and not veiled
        if tag == "br":
            top.parts.append("\n" if top.keeps else BREAK)
        elif tag == "hr" and shown:
            top.parts.append(Block(["---"], True))
        elif tag == "img" and shown and given.get("alt"):
            top.parts.append(unescape(given["alt"]))
        elif tag == "input" and shown and given.get("type", "").lower() not in SILENT:
            top.parts.append(unescape(given.get("value", "")))
        elif tag == "wbr":
            pass
        if tag in VOID:
            return
        element = Element(tag, hidden, top.keeps or tag in ("pre", "textarea", "xmp"), veiled)
        if tag in ("td", "th"):
            element.span = max(1, min(_integer(given.get("colspan")) or 1, 1000))
            element.rows = max(1, min(_integer(given.get("rowspan")) or 1, 65534))
        if tag in ("select", "option", "details", "ol", "li"):
            element.given = given
        self._push(element)
        if foreign and rest.endswith("/"):
            self._close()

    def _push(self, element: Element) -> None:
        element.framed = element.tag in FRAME or element.tag not in CELLS and self.open[-1].framed
        self.open.append(element)
        self.count[element.tag] += 1

    def end(self, tag: str) -> None:
        if tag == "p" and not self.count["p"]:
            return self.open[-1].parts.append(Block([], True))
        if tag == "br":
            return self.open[-1].parts.append(BREAK)
        if not self.count[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                while len(self.open) > depth:
                    self._close()
                return
            # An end tag doesn't reach out of a cell; other than that of its table.
            if self.open[depth].tag in ("td", "th", "caption") and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                return

    def text(self, data: str) -> None:
        top = self.open[-1]
        if self.count["svg"] and not (self.count["text"] or self.count["foreignobject"]):
            return
        if top.tag == "details" and "open" not in top.given:
            return
        if not top.hidden and not top.veiled and not (top.tag in ("table", "thead", "tbody", "tfoot", "tr", "ul", "ol") and data.isspace()):
            top.parts.append(unescape(data) if "&" in data else data)

    def _close_first(self, tags: frozenset[str], fence: frozenset[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                while len(self.open) > depth:
                    self._close()
                return
            if self.open[depth].tag in fence:
                return

    def _close_all(self, tags: frozenset[str], fence: frozenset[str]) -> None:
        lowest = None
        if not any(self.count[t] for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in fence:
                break
            if self.open[depth].tag in tags:
                lowest = depth
        while lowest is not None and len(self.open) > lowest:
            self._close()

    def _close(self) -> None:
        """Lay the innermost element out into the one around it."""
        done = self.open.pop()
        self.count[done.tag] -= 1
        into = self.open[-1]
        if done.hidden:
            return
        tag = done.tag
        passed: list = []
        if into.framed and tag not in FRAME and tag not in CELLS:
            passed = [x for x in done.parts if isinstance(x, (list, tuple))]
            if passed:
                done.parts = [x for x in done.parts if not isinstance(x, (list, tuple))]
        if self.count["select"] and tag != "option":
            # Nothing but its options counts in a drop-down, however they are wrapped.
            into.parts += done.parts
        elif self.count["select"]:
            text = done.given.get("label") or _collapsed(" ".join(_flow(done.parts, False)))
            into.parts.append(Option(unescape(text) if done.given.get("label") else text, "selected" in done.given, "disabled" not in done.given))
        elif tag == "select":
            into.parts.append(_shown([x for x in done.parts if isinstance(x, Option)], done.given))
        elif tag in BESIDE and (self.count["svg"] or self.count["math"]) or into.tag == "mfrac":
            into.parts += [" ", *done.parts, " "]
        elif tag in ("td", "th"):
            into.parts.append((_flow(done.parts, done.keeps), done.span, done.rows))
        elif tag == "tr":
            cells = [x for x in done.parts if isinstance(x, tuple)]
            stray = _flow([x for x in done.parts if not isinstance(x, (list, tuple))], False)
            into.parts += [Block(stray, False)] if stray else []
            into.parts += [x for x in done.parts if isinstance(x, list)]
            into.parts += [cells] if cells else []
        elif tag in ("thead", "tbody", "tfoot"):
            into.parts += done.parts
        elif tag == "table":
            around = _flow([x for x in done.parts if not isinstance(x, (list, tuple))], False)
            into.parts.append(Block(around + _grid(_rows(done.parts)), True))
        elif tag == "li":
            lines = _flow(done.parts, done.keeps)
            block = Block(_hang(lines, "- ") if lines else [], False)
            into.parts.append(block)
            if into.tag == "ol":
                into.items.append((block, lines, _integer(done.given.get("value"))))
        elif tag in BLOCKS:
            self._number(done)
            lines = _flow(done.parts, done.keeps)
            if tag in ("blockquote", "dd"):
                lines = ["  " + x if x else x for x in lines]
            nested = tag in ("ul", "ol") and self.count["li"] > 0
            into.parts.append(Block(lines, tag in SPACED and not nested))
        else:
            into.parts += done.parts
        into.parts += passed

    @staticmethod
    def _number(done: Element) -> None:
        """Number the items of a list, from its start or, backwards, from their count; an item's own number goes on from there."""
        step = -1 if "reversed" in done.given else 1
        start = _integer(done.given.get("start"))
        number = start if start is not None else len(done.items) if step < 0 else 1
        for block, lines, given in done.items:
            number = given if given is not None else number
            block.lines = _hang(lines, f"{_numeral(number, done.given.get('type', '1'))}. ") if lines else []
            number += step

    def result(self) -> str:
        while len(self.open) > 1:
            self._close()
        return "\n".join(_flow(self.open[0].parts, False)).strip("\n")


def render(html: str | None) -> str:
    """The visible text of a page."""
    page, at, source = Page(), 0, html or ""
    last = source.rfind(">")
    while (m := TOKEN.match(source, at) if at <= last else None) is not None:
        at = m.end()
        closing, tag, rest, data = m.groups()
        if data is not None:
            page.text(data)
        elif tag:
            tag = tag.lower()
            if closing:
                page.end(tag)
                continue
            page.start(tag, rest)
            if tag in RAW and not rest.endswith("/"):
                # Raw text goes on to its own end tag, whatever looks like a tag inside.
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                end = stop.start() if stop else len(source)
                if tag == "textarea":
                    page.text(source[at:end])
                at = end
    # No tag ends from here on; as in a browser, one that only begins is dropped.
    page.text(re.split(r"<(?=[a-zA-Z/!?])", source[at:], maxsplit=1)[0])
    return page.result()


def render_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text in place of the HTML."""
    kept = [c for c in pages.columns if c not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            texts = pa.array([render(x.as_py()) for x in column], pa.string())
            others = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*others, texts], names=[*kept, "text"])

    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.select(*kept, html).mapInArrow(run, f"{fields}text string")
