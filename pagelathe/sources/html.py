"""HTML and XHTML to blocks."""

from __future__ import annotations

from dataclasses import replace
from html.parser import HTMLParser

from pagelathe.sources.model import Block, Cell, Document, Run, Style, Unit, cell_kind, inline

_STYLES = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "ins": "underline", "s": "strike", "del": "strike", "strike": "strike", "code": "code", "tt": "code", "kbd": "code"}
_SILENT = frozenset({"script", "style", "head", "template", "noscript"})
_BREAKS = frozenset("p div section article header footer main aside nav ul ol li table tr td th blockquote pre h1 h2 h3 h4 h5 h6 dl dt dd figure figcaption hr body form fieldset address".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.runs: list[Run] = []
        self.styles: list[tuple[str, Style]] = []
        self.lists: list[list] = []  # marker, count
        self.tables: list[dict] = []
        self.silent = self.quotes = self.pre = 0
        self.heading = 0
        self.item = False
        self.link: str | None = None
        self.title: list[str] | None = None
        self.properties: dict[str, str] = {}

    @property
    def style(self) -> Style:
        return self.styles[-1][1] if self.styles else Style()

    def flush(self) -> None:
        runs, self.runs = self.runs, []
        if self.pre:
            text = "".join(r.text for r in runs).strip("\n")
            if text:
                self.blocks.append(Block("code", text))
            return
        text = inline(runs)
        if not text:
            return
        if self.tables:
            cell = self.tables[-1].get("cell")
            if cell is not None:
                cell.text = f"{cell.text}\n{text}".strip()
                return
        if self.heading:
            self.blocks.append(Block("heading", text, self.heading))
        elif self.lists and self.item:
            marker, n = self.lists[-1]
            self.blocks.append(Block("item", text, depth=len(self.lists) - 1, marker=marker, ordinal=n))
            self.item = False
        elif self.quotes:
            self.blocks.append(Block("quote", text))
        else:
            self.blocks.append(Block("paragraph", text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.title = []
        if tag in _SILENT:
            self.silent += 1
        if self.silent:
            return
        a = {k: v or "" for k, v in attrs}
        if tag in _BREAKS:
            self.flush()
        if tag in _STYLES:
            self.styles.append((tag, replace(self.style, **{_STYLES[tag]: True})))
        elif tag in ("sup", "sub"):
            self.styles.append((tag, replace(self.style, script=tag)))
        elif tag == "a" and a.get("href"):
            self.link = a["href"]
        elif tag == "br":
            self.runs.append(Run("\n" if self.pre or self.tables else " ", self.style))
        elif tag == "img":
            self.runs.append(Run(f"![{a.get('alt', '')}]({a.get('src', '')})", raw=True))
        elif tag[0] == "h" and tag[1:].isdigit():
            self.heading = min(6, max(1, int(tag[1:])))
        elif tag in ("ul", "ol"):
            marker = {"a": "lower_alpha", "A": "upper_alpha", "i": "lower_roman", "I": "upper_roman"}.get(a.get("type", ""), "decimal") if tag == "ol" else "bullet"
            start = int(a["start"]) if a.get("start", "").isdigit() else 1
            self.lists.append([marker, start - 1])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.item = True
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.pre += 1
        elif tag == "hr":
            self.blocks.append(Block("rule"))
        elif tag == "table":
            self.tables.append({"cells": [], "row": -1, "taken": set(), "head": 0, "th": True, "cell": None})
        elif tag == "tr" and self.tables:
            t = self.tables[-1]
            t["row"] += 1
            t["cell"] = None
        elif tag in ("td", "th") and self.tables:
            t = self.tables[-1]
            row = max(0, t["row"])
            col = 0
            while (row, col) in t["taken"]:
                col += 1
            spans = [min(1000, int(a[k])) if a.get(k, "").isdigit() and int(a[k]) else 1 for k in ("rowspan", "colspan")]
            t["taken"] |= {(row + r, col + c) for r in range(spans[0]) for c in range(spans[1])}
            t["cell"] = Cell(row, col, "", *spans)
            t["cells"].append(t["cell"])
            if tag == "th" and row == t["head"] and col == 0:
                t["head"] = row + 1
        if tag in _VOID:
            return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title is not None:
            self.properties["title"] = " ".join("".join(self.title).split())
            self.title = None
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag in _BREAKS:
            self.flush()
        if tag in _STYLES or tag in ("sup", "sub"):
            for k in range(len(self.styles) - 1, -1, -1):
                if self.styles[k][0] == tag:
                    del self.styles[k:]
                    break
        elif tag == "a":
            self.link = None
        elif tag[0] == "h" and tag[1:].isdigit():
            self.heading = 0
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.item = False
        elif tag == "blockquote":
            self.quotes = max(0, self.quotes - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
        elif tag in ("td", "th") and self.tables:
            self.tables[-1]["cell"] = None
        elif tag == "table" and self.tables:
            t = self.tables.pop()
            for c in t["cells"]:
                c.kind = cell_kind(c.text)
            if t["cells"]:
                self.blocks.append(Block("table", cells=t["cells"], header_rows=t["head"]))
        elif tag == "p":
            self.styles = [s for s in self.styles if not self.heading]

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        if not self.silent:
            text = data if self.pre else (" " if data[:1].isspace() else "") + " ".join(data.split()) + (" " if data[-1:].isspace() and data.strip() else "")
            self.runs.append(Run(text, self.style, self.link))


def blocks_of(text: str) -> tuple[list[Block], dict[str, str]]:
    """Blocks and properties of a page. Scripts, styles and the head but its title leave nothing."""
    reader = _Reader()
    reader.feed(text)
    reader.close()
    while reader.tables:
        reader.handle_endtag("table")
    reader.flush()
    return reader.blocks, reader.properties


def read(data: bytes, options=None) -> Document:
    blocks, properties = blocks_of(data.decode("utf-8", "replace"))
    return Document("html", properties, [Unit("flow", properties.get("title"), blocks)])
