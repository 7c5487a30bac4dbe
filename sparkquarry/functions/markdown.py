"""Main content of HTML as Markdown: tags on a stack of open elements, one row at a time inside Arrow batches.

Elements close as HTML says: void ones at once, a paragraph at the next block, an item, row or cell at the next of its kind, and an
end tag closes what is still open inside its element; one that was never opened is nothing.  So nested elements of one name
end where they should.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("head title script style nav noscript template svg iframe object".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}
#: An element that starts ends those open ones, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr"])), "th": (frozenset(["td", "th"]), frozenset(["tr"])),
}


def selector_parts(selector: str) -> list[tuple[str, str, frozenset[str]]]:
    """(tag, id, classes) of each part of a selector like ``main, #content, div.doc``."""
    out = []
    for part in filter(None, (p.strip() for p in selector.split(","))):
        if not (m := re.fullmatch(r"([A-Za-z][\w-]*)?((?:[#.][\w-]+)*)", part)):
            raise ValueError(f"selectors are lists of tag, #id and .class: {part!r}")
        marks = re.findall(r"[#.][\w-]+", m[2])
        out.append(((m[1] or "").lower(), "".join(x[1:] for x in marks if x[0] == "#"), frozenset(x[1:] for x in marks if x[0] == ".")))
    return out


class Page(HTMLParser):
    """Feeds on a page; ``markdown()`` is its content, ``title`` its <title> or first <h1>."""

    def __init__(self, selector: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = selector_parts(selector)
        self.open: list[tuple[str, bool, bool, str]] = []  # name, dropped, inside the selection, what closes its mark
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.lists: list[int] = []  # the next number of each open list, -1 for bullets
        self.quotes = 0
        self.item = ""
        self.code: list[str] | None = None
        self.table: list[list[str]] | None = None
        self.nested = 0
        self.heads = {"title": "", "h1": ""}
        self.href: list[str] = []

    def _inside(self, name: str) -> bool:
        return any(o[0] == name for o in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag in BLOCKS and self._inside("p") and tag not in ("html", "body"):
            self._close("p", frozenset(["td", "th", "li", "blockquote", "div"]))
        if tag in IMPLIED:
            for name in IMPLIED[tag][0]:
                self._close(name, IMPLIED[tag][1])
        dropped = tag in DROPPED or (bool(self.open) and self.open[-1][1])
        chosen = not self.wanted or (bool(self.open) and self.open[-1][2]) or any((not t or t == tag) and (not i or i == own.get("id")) and c <= set(own.get("class", "").split()) for t, i, c in self.wanted)
        shown, mark = chosen and not dropped, ""
        if shown:
            mark = self._begin(tag, own)
        if tag not in VOID:
            self.open.append((tag, dropped, chosen, mark))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # <br/> is void; on other elements the slash means nothing

    def _begin(self, tag: str, own: dict[str, str]) -> str:
        """What an element writes when it starts; the mark that ends it."""
        if tag in BLOCKS and self.code is None and self.table is None:
            self._flush()
        elif tag in BLOCKS and self.code is None:
            self.line.append(" ")
        if tag in ("ul", "ol"):
            self.lists.append(-1 if tag == "ul" else int(own["start"]) if own.get("start", "").isdecimal() else 1)
        elif tag == "li":
            number = self.lists[-1] if self.lists else -1
            self.item = f"{'  ' * max(0, len(self.lists) - 1)}{'-' if number < 0 else f'{number}.'} "
            if number >= 0:
                self.lists[-1] += 1
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.code = []
        elif tag == "br":
            self.code.append("\n") if self.code is not None else self.line.append(" " if self.table is not None else "\n")
        elif tag == "hr":
            self.blocks.append("---")
        elif tag == "img" and own.get("alt", "").strip():
            self.line.append(f"![{own['alt'].strip()}]({own.get('src', '')})")
        elif tag == "table":
            self.nested += self.table is not None
            if self.nested:  # a table inside a cell is the cell's text
                return "nested"
            self.table = []
            return "table"
        elif tag == "tr" and self.table is not None and not self.nested:
            self.table.append([])
        elif tag == "a" and own.get("href", "").strip():
            self.href.append(own["href"].strip())
            self.line.append("[")
            return "a"
        elif self.code is None and (tag in MARKS or tag == "code"):
            self.line.append(MARKS.get(tag, "`"))
            return MARKS.get(tag, "`")
        return ""

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, frozenset())

    def _close(self, tag: str, until: frozenset[str]) -> None:
        """End the nearest open element of this name and all inside it, unless one of ``until`` stands between."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                while len(self.open) > at:
                    name, dropped, chosen, mark = self.open.pop()
                    if chosen and not dropped:
                        self._end(name, mark)
                return
            if self.open[at][0] in until:
                return

    def _end(self, tag: str, mark: str) -> None:
        if mark == "a":
            self.line.append(f"]({self.href.pop()})")
        elif mark == "nested":
            self.nested -= 1
            self.line.append(" ")
        elif mark and mark != "table":
            while self.line and self.line[-1].isspace():
                self.line.pop()
            self.line.append(mark)
        if tag == "pre" and self.code is not None:
            text, self.code = "".join(self.code).strip("\n"), None
            if text.strip():
                self._add(f"```\n{text}\n```")
        elif tag in ("td", "th") and self.table is not None and not self.nested:
            if not self.table:
                self.table.append([])
            self.table[-1].append(self._text().replace("\n", " ").replace("|", "\\|"))
        elif mark == "table":
            rows, self.table = [r for r in self.table or [] if any(r)], None
            if rows:
                width = max(map(len, rows))
                lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
                self._add("\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]]))
        elif tag in BLOCKS and self.code is None and self.table is None:
            self._flush(tag)
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "blockquote":
            self.quotes = max(0, self.quotes - 1)

    def handle_data(self, data: str) -> None:
        for head in self.heads:
            if self._inside(head) and len(self.heads[head]) < 1000:
                self.heads[head] += data
        if self.open and (self.open[-1][1] or not self.open[-1][2]) or not self.open and self.wanted:
            return
        if self.code is not None:
            self.code.append(data)
        else:
            self.line.append(re.sub(r"\s+", " ", data))

    def _text(self) -> str:
        text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(self.line))).strip()
        self.line = []
        for mark in ("****", "~~~~", "[]"):  # marks around nothing
            text = text.replace(mark, "") if mark != "[]" else re.sub(r"(?<!!)\[\s*\]\([^)]*\)", "", text)
        return text.strip()

    def _flush(self, tag: str = "") -> None:
        if self.table is not None:
            return
        text = self._text()
        if text.strip("*~` \n"):
            level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
            self._add("#" * level + " " + text.replace("\n", " ") if level else text)

    def _add(self, text: str) -> None:
        if self.item:
            text, self.item = self.item + text.replace("\n", "\n" + " " * len(self.item)), ""
        elif self.lists and not self.quotes:
            text = "\n".join("  " * len(self.lists) + x for x in text.split("\n"))
        self.blocks.append("\n".join("> " * self.quotes + x for x in text.split("\n")) if self.quotes else text)

    def markdown(self) -> str:
        while self.open:
            self._close(self.open[-1][0], frozenset())
        self._flush()
        item = re.compile(r"\s*(-|\d+\.) ")
        out = ""
        for before, now in zip(["", *self.blocks], self.blocks, strict=False):
            out += ("" if not out else "\n" if item.match(before) and item.match(now) else "\n\n") + now
        return out

    @property
    def title(self) -> str:
        return next((t for t in (" ".join(x.split()) for x in self.heads.values()) if t), "")


def convert(html: str | None, selector: str = "") -> tuple[str, str]:
    """(title, markdown) of a page; of several blocks the order is the page's."""
    page = Page(selector)
    page.feed(html or "")
    page.close()
    return page.title, page.markdown()


def page_content(html: Column, selector: str = "") -> Column:
    """struct<title, markdown> of each page; selector: a list of tag, #id and .class, of which any may match."""
    selector_parts(selector)

    @F.pandas_udf("title string, markdown string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([convert(x, selector) for x in part], columns=["title", "markdown"])

    return run(html)
