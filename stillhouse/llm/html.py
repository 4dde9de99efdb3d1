"""Visible text of HTML pages, laid out as a reader sees it."""

from __future__ import annotations

import re
import textwrap
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas".split())
FOREIGN = frozenset(["svg", "math"])
# Inside svg and math these are not shown; they get a name of their own, for elsewhere they are.
_UNDRAWN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml mphantom".split())
UNSEEN |= {f"undrawn {tag}" for tag in _UNDRAWN}
CHOICES = frozenset("select option optgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre figure table hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup li "
    "legend listing main nav plaintext optgroup option search section summary caption thead tbody tfoot tr td th".split()
)
CLOSES_P = BLOCKS - frozenset("html body option optgroup legend caption thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
GROUPS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
_IN_TABLE = GROUPS | CELLS | {"tr", "caption"}
# Inside these svg and math hold HTML; elsewhere there, these tags end them.
_HTML_AGAIN = BLOCKS | frozenset(["foreignobject", "undrawn desc", "undrawn title", "undrawn annotation-xml", "mi", "mo", "mn", "ms", "mtext"])
_BREAKS_OUT = SPACED - {"fieldset", "figure"} | frozenset(
    "b big body br center code dd div dt em embed head i img li listing meta nobr ruby s small span strong strike sub sup tt u var".split()
)
IN_HEAD = frozenset("base link meta title script style template noscript".split())

#: Open elements beyond which further ones are put side by side, as browsers do.
MAX_DEPTH = 512
_LITERAL = frozenset("pre listing plaintext textarea".split())
#: Open elements up to which they are looked through one by one.
_FEW = 64
#: Longest line of a table's cell.
CELL_WIDTH = 80

# After its name a start tag has attributes. A quote opens a string directly after = alone; values
# without quotes end at white space or >, and any other quote is a character like others.
_VALUE = r"""(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+))"""
_NAMED = rf"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+{_VALUE}?+)?+"
_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))
      | <(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[ \t\n\r\f/]|{_NAMED})*+)(?:>|\Z)
      | </(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)
      | <[!?/][^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(rf"(?=([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)){_NAMED}")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW | {"title", "textarea"}}
_FOREIGN = re.compile("<(?:svg|math)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_INTEGER = re.compile(r"\s*([+-]?\d{1,9})")
# Declarations of a style that decide on what is seen, and their values.
_DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item ruby math "
    "table inline-table table-row table-cell table-caption table-row-group table-header-group table-footer-group "
    "table-column table-column-group -webkit-box -webkit-flex initial inherit unset revert".split()
)
_VISIBILITIES = {"visible": True, "hidden": False, "collapse": False, "initial": True, "inherit": None, "unset": None, "revert": None}


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape("".join(values)))
    return found


def _number(text: str | None, default: int, most: int) -> int:
    try:
        return min(max(int(text), 1), most)
    except (TypeError, ValueError):
        return default


def _integer(text: str | None, default: int) -> int:
    match = _INTEGER.match(text or "")
    return int(match[1]) if match else default


def _declared(style: str) -> dict[str, str]:
    """Value of each property that counts: the last one with ``!important``, else the last one."""
    found: dict[str, tuple[bool, str]] = {}
    for part in style.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        weighty = value.endswith("!important")
        value = value.removesuffix("!important").strip()
        known = value in _DISPLAYS if name == "display" else value in _VISIBILITIES if name == "visibility" else True
        if known and (weighty or not found.get(name, (False, ""))[0]):
            found[name] = weighty, value
    return {name: value for name, (_, value) in found.items()}


def _hides(tag: str, found: dict[str, str]) -> bool:
    """Whether an element isn't displayed, with all it holds."""
    if tag in UNSEEN:
        return True
    if not found:
        return False
    style = _declared(found["style"]) if found.get("style") else {}
    display = style.get("display")
    if display == "none" or style.get("content-visibility") == "hidden":
        return True
    return "hidden" in found and display in (None, "revert")


def _shows(found: dict[str, str]) -> bool | None:
    """Whether an element's own style makes it visible or not; None leaves it to what is around it."""
    style = found.get("style")
    return _VISIBILITIES.get(_declared(style).get("visibility", "inherit")) if style else None


class Tree:
    """Well-nested elements from a page: tags left out are put in, stray ones dropped.

    Yields ``(+1, tag, attributes)``, ``(-1, tag, "")`` and ``(0, "", text)``.
    """

    def __init__(self, page: str):
        self._page = page
        self._open: list[str] = []
        #: Depths at which each tag is open.
        self._depths: dict[str, list[int]] = {}
        self._foreign = bool(_FOREIGN.search(page))
        #: Places of the open elements beyond MAX_DEPTH that the reader holds open too.
        self._kept: list[int] = []

    def _until(self, wanted: frozenset[str], walls: frozenset[str]) -> int | None:
        """Depth of the innermost open element in ``wanted`` that no wall stands before."""
        if len(self._open) < _FEW:
            for depth in range(len(self._open) - 1, -1, -1):
                if self._open[depth] in wanted:
                    return depth
                if self._open[depth] in walls:
                    return None
            return None
        found, wall = (max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=-1) for tags in (wanted, walls))
        return found if found >= 0 and found >= wall else None

    def _push(self, tag: str) -> None:
        self._depths.setdefault(tag, []).append(len(self._open))
        self._open.append(tag)

    def _close(self, depth: int | None) -> Iterator[tuple[int, str, str]]:
        while depth is not None and len(self._open) > depth:
            tag, at = self._open.pop(), len(self._open)
            self._depths[tag].pop()
            if at < MAX_DEPTH or self._kept[-1:] == [at]:
                if at >= MAX_DEPTH:
                    self._kept.pop()
                yield -1, tag, ""
            elif tag in BLOCKS:
                yield 1, "div", ""
                yield -1, "div", ""

    def _make_room(self, tag: str) -> Iterator[tuple[int, str, str]]:
        """End what ``tag`` ends and begin what it needs."""
        table = frozenset(["table"])
        if self._depths.get("head") and tag not in IN_HEAD:
            yield from self._close(self._open.index("head"))
        if tag in ("select", "input", "textarea"):
            yield from self._close(self._until(frozenset(["select"]), CELLS))
        if tag in CLOSES_P:
            yield from self._close(self._until(frozenset(["p"]), CELLS | table | {"button", "caption"}))
        if tag in HEADINGS and self._open and self._open[-1] in HEADINGS:
            yield from self._close(len(self._open) - 1)
        if tag == "li":
            yield from self._close(self._until(frozenset(["li"]), LISTS | CELLS | table))
        elif tag in ("dt", "dd"):
            yield from self._close(self._until(frozenset(["dt", "dd"]), CELLS | table | {"dl"}))
        elif tag in ("option", "optgroup"):
            yield from self._close(self._until(frozenset(["option", tag]), frozenset(["select", "optgroup"]) - {tag}))
        elif tag in GROUPS or tag in ("caption", "colgroup"):
            yield from self._close(self._until(GROUPS | {"caption", "colgroup"}, table))
        elif tag == "tr":
            yield from self._close(self._until(frozenset(["tr", "caption", "colgroup"]), table))
        elif tag in CELLS:
            yield from self._close(self._until(CELLS | {"caption", "colgroup"}, table))
        if tag in CELLS and self._until(table, frozenset()) is not None and self._until(frozenset(["tr"]), table) is None:
            self._push("tr")
            yield 1, "tr", ""

    def _leave(self, tag: str) -> Iterator[tuple[int, str, str]]:
        table = frozenset(["table"])
        if tag in ("html", "body"):
            return
        if tag == "select":
            yield from self._close(self._until(frozenset([tag]), frozenset()))
        elif tag == "br" or tag == "p" and self._until(frozenset(["p"]), CELLS | table) is None:
            yield 1, tag, ""
            yield -1, tag, ""
        elif tag in HEADINGS:
            yield from self._close(self._until(HEADINGS, CELLS | table))
        elif tag in BLOCKS:
            walls = frozenset() if tag == "table" else table if tag in _IN_TABLE else CELLS
            yield from self._close(self._until(frozenset([tag]), walls))
        else:
            # An inline end tag never ends a block that began after its start tag.
            yield from self._close(self._until(frozenset([tag, f"undrawn {tag}"]), BLOCKS))

    def __iter__(self) -> Iterator[tuple[int, str, str]]:
        page, at = self._page, 0
        while at < len(page):
            match = _TOKEN.search(page, at)
            stop = match.start() if match else len(page)
            if stop > at:
                text = page[at:stop]
                if self._depths.get("head") and not text.isspace():
                    yield from self._close(self._open.index("head"))
                yield 0, "", unescape(text) if "&" in text else text
            if match is None:
                break
            at = match.end()
            start, end = match["start"], match["end"]
            if end:
                yield from self._leave(end.lower())
            elif start:
                tag = start.lower()
                if tag in ("html", "body"):
                    if self._depths.get("head"):
                        yield from self._close(self._open.index("head"))
                    continue
                foreign = self._until(FOREIGN, _HTML_AGAIN) if self._foreign else None
                while foreign is not None and tag in _BREAKS_OUT:
                    yield from self._close(foreign)
                    foreign = self._until(FOREIGN, _HTML_AGAIN)
                yield from self._make_room(tag)
                name = f"undrawn {tag}" if foreign is not None and tag in _UNDRAWN else tag
                yield 1, name, match["attributes"]
                if tag in VOID or foreign is not None and match["attributes"].endswith("/"):
                    yield -1, name, ""
                elif tag == "plaintext":
                    yield 0, "", page[at:]
                    at = len(page)
                    yield -1, name, ""
                elif tag in _RAW_END:
                    ends = _RAW_END[tag].search(page, at)
                    stop = ends.start() if ends else len(page)
                    if stop > at:
                        yield 0, "", page[at:stop] if tag in RAW else unescape(page[at:stop])
                    at = ends.end() if ends else len(page)
                    yield -1, name, ""
                else:
                    if len(self._open) >= MAX_DEPTH:
                        # Over for the reader at once, unless it decides on what is seen inside.
                        found = _attributes(match["attributes"])
                        keeps = tag != "head" and (name in CHOICES | {"details", "summary"} or _hides(name, found) or _shows(found) is not None)
                        if keeps:
                            self._kept.append(len(self._open))
                        else:
                            yield -1, name, ""
                    self._push(name)
        yield from self._close(0)


class _Sheet:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self._line: list[str] = []
        self._space = False
        self._blank = False
        self.margin: list[str] = []
        self.bullet: str | None = None

    def words(self, text: str) -> None:
        if text[:1] in " \t\n\r\f":
            self._space = True
        bare = _SPACES.sub(" ", text).strip(" ")
        if bare:
            if self._space and self._line:
                self._line.append(" ")
            self._line.append(bare)
            self._space = text[-1] in " \t\n\r\f"

    def literal(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self._line.append(first)
        for line in rest:
            self.end_line(keep=True)
            self._line.append(line)
        self._space = False

    def end_line(self, keep: bool = False) -> None:
        if self._line or keep:
            if self._blank and self.lines:
                self.lines.append("")
            self._blank = False
            lead = "".join(self.margin)
            if self.bullet is not None:
                width = len(self.margin[-1]) if self.margin else 0
                lead, self.bullet = lead[: len(lead) - width] + self.bullet, None
            self.lines.append((lead + "".join(self._line)).rstrip())
        self._line, self._space = [], False

    def gap(self) -> None:
        self.end_line()
        if self.bullet is None:
            self._blank = True

    def put(self, lines: list[str]) -> None:
        for line in lines:
            self._line.append(line)
            self.end_line(keep=True)

    def text(self) -> list[str]:
        self.end_line()
        return self.lines


class _Select:
    """Options of a select: the chosen one is shown, or all of a list box."""

    def __init__(self, found: dict[str, str]):
        self.box = "multiple" in found or _number(found.get("size"), 1, 10**9) > 1
        self.options: list[tuple[bool, bool, list[str]]] = []
        self.inside = False
        self.off = False

    def option(self, found: dict[str, str]) -> None:
        self.options.append(("selected" in found, self.off or "disabled" in found, [found.get("label", "")]))
        self.inside = True

    def words(self, text: str) -> None:
        if self.inside and not self.options[-1][2][0]:
            self.options[-1][2].append(text)

    def shown(self) -> list[str]:
        texts = [_SPACES.sub(" ", "".join(t)).strip(" ") for *_, t in self.options]
        if self.box:
            return texts
        chosen = [k for k, (selected, _, _) in enumerate(self.options) if selected][-1:]
        usable = [k for k, (_, off, _) in enumerate(self.options) if not off]
        return [texts[k] for k in (chosen or usable)[:1]]


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.cell: _Sheet | None = None
        self.span = (1, 1)

    def finish(self) -> None:
        if self.cell is not None:
            lines = [w for line in self.cell.text() for w in (textwrap.wrap(line, CELL_WIDTH, drop_whitespace=True) or [""])]
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((*self.span, lines))
            self.cell = None

    def layout(self) -> list[str]:
        """Rows with columns of one width; a cell over several columns may use their room."""
        self.finish()
        placed: list[list[tuple[int, int, list[str]]]] = []
        # Cells that reach into further rows: first column, the one after the last, last row.
        tall: list[tuple[int, int, int]] = []
        for number, row in enumerate(self.rows):
            at, line, new = 0, [], []
            tall = [t for t in tall if t[2] >= number] if row else tall
            over = iter(tall)
            next_tall = next(over, None)
            for across, down, lines in row:
                while next_tall is not None and next_tall[0] <= at:
                    at = max(at, next_tall[1])
                    next_tall = next(over, None)
                line.append((at, across, lines))
                if down > 1:
                    new.append((at, at + across, number + down - 1))
                at += across
            placed.append(line)
            if new:
                tall = sorted(tall + new)
        # Only columns with a cell of their own have a width.
        width: dict[int, int] = {}
        for line in placed:
            for at, across, lines in line:
                if across == 1:
                    width[at] = max(width.get(at, 0), *map(len, lines or [""]))
        columns = sorted(width)
        lefts = [0, *accumulate(width[c] + 2 for c in columns)]
        out = []
        for line in placed:
            for k in range(max((len(lines) for _, _, lines in line), default=0)):
                text = ""
                for at, _, lines in line:
                    if k < len(lines) and lines[k]:
                        text = text.ljust(lefts[bisect_left(columns, at)])
                        text += ("  " if text and not text.endswith(" ") else "") + lines[k]
                out.append(text.rstrip())
        return out


def render(page: str) -> tuple[str, str]:
    """Title and visible text of a page.

    Hidden are: the head, scripts, styles, templates, embedded objects, what svg and math define
    or annotate without drawing it, all but the chosen or first option of a select (a list box
    shows all), elements with ``hidden`` or a style that doesn't display them, and closed details but for their
    summary. Of a style the last declaration counts. What ``visibility`` hides keeps its place; elements in it
    that are visible again are shown. Blocks begin and end lines; paragraphs, headings, lists, quotes and tables have a blank line around
    them; white space is collapsed outside ``pre``. List items have a bullet or number and a
    hanging indent; table cells are aligned in columns, long ones broken at 80 characters.
    """
    title: list[str] = []
    sheet = _Sheet()
    sheets: list[_Sheet] = []
    tables: list[_Table] = []
    counters: list[int | None] = []
    # Tag, whether it hides, whether it indents, whether what is around it is visible, whether it is a summary shown.
    open_: list[tuple[str, bool, bool, bool, bool]] = []
    unseen = literal = drawings = 0
    visible = True
    closed: list[int] = []  # depth of closed details
    summaries = 0  # open summaries of closed details
    in_title = False
    select: _Select | None = None
    for step, tag, text in Tree(page):
        if step == 0:
            if in_title:
                title.append(text)
            elif unseen or not visible or closed and not summaries:
                continue
            elif select is not None:
                select.words(text)
            elif tables and tables[-1].cell is None and sheet is not sheets[-1]:
                sheets[-1].words(text)
            elif literal:
                sheet.literal(text)
            else:
                sheet.words(text)
        elif step > 0:
            found: dict[str, str] = {}
            if text and not text.isspace():
                found = _attributes(text)
            hides = _hides(tag, found)
            if tag == "title":
                in_title = not title and not drawings
                hides = True
            unseen += hides
            drawings += tag == "svg"
            around, shows = visible, _shows(found)
            visible = around if shows is None else shows
            shown_summary = tag == "summary" and bool(closed)
            summaries += shown_summary
            indents = False
            if not unseen and (select is not None or tag == "select"):
                if tag == "select":
                    select = select or _Select(found)
                elif tag == "option":
                    select.option(found)
                elif tag == "optgroup":
                    select.off = "disabled" in found
            elif not unseen:
                if tag == "text":
                    sheet.words(" ")  # labels stand apart
                elif tag == "br":
                    sheet.end_line(keep=True)
                elif tag == "hr":
                    sheet.gap()
                elif tag == "img" and found.get("alt"):
                    sheet.words(found["alt"] if visible else "")
                elif tag in ("input", "button") and found.get("type", "").lower() in ("submit", "button", "reset"):
                    sheet.words(found.get("value", "") if visible else "")
                elif tag == "table":
                    sheet.gap()
                    tables.append(_Table())
                    sheets.append(sheet)
                elif tag == "tr" and tables:
                    tables[-1].finish()
                    tables[-1].rows.append([])
                elif tag in CELLS and tables:
                    tables[-1].finish()
                    tables[-1].span = (_number(found.get("colspan"), 1, 1000), _number(found.get("rowspan"), 1, 65534))
                    sheet = tables[-1].cell = _Sheet()
                elif tag in SPACED and not (tag in LISTS and counters):
                    sheet.gap()
                elif tag in BLOCKS:
                    sheet.end_line()
                if tag in LISTS:
                    counters.append(_integer(found.get("start"), 1) if tag == "ol" else None)
                elif tag == "li":
                    number = counters[-1] if counters else None
                    if number is not None:
                        number = _integer(found.get("value"), number)
                        counters[-1] = number + 1
                    mark = "- " if number is None else f"{number}. "
                    if sheet.bullet is not None:
                        sheet.end_line(keep=True)
                    sheet.margin.append(" " * len(mark))
                    sheet.bullet, indents = mark if visible else None, True
                elif tag in ("blockquote", "dd"):
                    sheet.margin.append("    " if tag == "dd" else "> ")
                    indents = True
                elif tag in _LITERAL:
                    literal += 1
                elif tag == "details" and "open" not in found:
                    closed.append(len(open_))
            open_.append((tag, hides, indents, around, shown_summary))
        else:
            tag, hides, indents, around, shown_summary = open_.pop()
            if closed and closed[-1] == len(open_):
                closed.pop()
            in_summary = bool(summaries)
            summaries -= shown_summary
            drawings -= tag == "svg"
            seen, was_visible = not unseen, visible
            visible = around
            unseen -= hides
            in_title = in_title and tag != "title"
            if not seen:
                continue
            if select is not None:
                if tag == "option":
                    select.inside = False
                elif tag == "optgroup":
                    select.off = False
                elif tag == "select":
                    if was_visible and (not closed or in_summary):
                        for k, line in enumerate(select.shown()):
                            if k:
                                sheet.end_line()
                            sheet.words(line)
                    select = None
                continue
            if tag == "text":
                sheet.words(" ")
            if tag in LISTS and counters:
                counters.pop()
            if tag == "table" and tables:
                table = tables.pop()
                lines = table.layout()
                sheet = sheets.pop()
                sheet.put(lines)
                sheet.gap()
            elif tag in CELLS and tables:
                tables[-1].finish()
                sheet = sheets[-1] if sheets else sheet
            elif tag in SPACED and not (tag in LISTS and counters):
                sheet.gap()
            elif tag in BLOCKS:
                sheet.end_line()
            if indents:
                if tag == "li" and sheet.bullet is not None:
                    sheet.end_line(keep=True)
                if sheet.margin:
                    sheet.margin.pop()
            if tag in _LITERAL:
                literal -= 1
    while sheets:
        sheet = sheets.pop()
    return _SPACES.sub(" ", "".join(title)).strip(" "), "\n".join(sheet.text()).strip("\n")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            rows = batch.slice(first, 200)
            both = [render(page or "") for page in rows.column(1).to_pylist()]
            texts = [text.encode("utf-8", "replace").decode() for _, text in both]
            titles = [title.encode("utf-8", "replace").decode() for title, _ in both]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "title", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Visible text of every row: ``page_id, title, text, n_chars``; see ``render``.

    NULL and empty pages have empty title and text. Damaged markup is read the way browsers
    read it; nesting beyond 512 elements is put side by side. Rows with NULL or repeated ids stay as they are.
    Other columns are ignored; an empty table gives no rows. No shuffle.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return own.mapInArrow(_rendered, f"page_id {kind}, title string, text string, n_chars long")
