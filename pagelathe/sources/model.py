"""What every reader yields: a document of units of blocks, with notes, assets and warnings; and its Markdown."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field


class DocumentError(Exception):
    """A document that cannot be read; code is unsupported, malformed, encrypted, limit or missing."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


@dataclass(frozen=True)
class Limits:
    input_bytes: int = 256 << 20
    entry_bytes: int = 128 << 20
    total_bytes: int = 512 << 20
    entries: int = 100_000
    depth: int = 256
    nodes: int = 2_000_000
    expansion: int = 4_000_000


@dataclass
class Options:
    limits: Limits = field(default_factory=Limits)
    assets: bool = True
    notes: bool = True
    headers_footers: bool = False


@dataclass
class Cell:
    row: int
    col: int
    text: str
    row_span: int = 1
    col_span: int = 1
    kind: str = "text"
    formula: str | None = None


@dataclass
class Block:
    """type is heading, paragraph, item, table, code, quote, figure or rule; text is Markdown, but plain in code."""

    type: str
    text: str = ""
    level: int = 0
    depth: int = 0
    marker: str = ""
    ordinal: int | None = None
    cells: list[Cell] = field(default_factory=list)
    header_rows: int = 0


@dataclass
class Unit:
    kind: str
    label: str | None = None
    blocks: list[Block] = field(default_factory=list)


@dataclass
class Document:
    format: str
    properties: dict[str, str] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    notes: list[tuple[str, str, str]] = field(default_factory=list)  # kind, id, text
    assets: list[tuple[str, str, bytes]] = field(default_factory=list)  # name, media type, bytes
    warnings: list[tuple[str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class Style:
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    code: bool = False
    script: str = ""


@dataclass
class Run:
    text: str
    style: Style = Style()
    link: str | None = None
    raw: bool = False


_EDGE = re.compile(r"^(\s*)(.*?)(\s*)$", re.S)


def escape(text: str) -> str:
    text = re.sub(r"([\\`*\[\]])", r"\\\1", text)
    text = re.sub(r"(?<!\w)_|_(?!\w)", r"\\_", text)
    return text.replace("&", "&amp;").replace("<", "&lt;")


def inline(runs: list[Run]) -> str:
    """Markdown of runs: equal neighbours merged, marks outside none but the words."""
    merged: list[Run] = []
    for r in runs:
        if merged and (merged[-1].style, merged[-1].link, merged[-1].raw) == (r.style, r.link, r.raw):
            merged[-1] = Run(merged[-1].text + r.text, r.style, r.link, r.raw)
        elif r.text:
            merged.append(r)
    out = []
    for r in merged:
        before, core, after = _EDGE.match(r.text).groups()
        if not core:
            out.append(r.text)
            continue
        s = r.style
        if r.raw:
            body = core
        elif s.code:
            fence = "`" * (max(map(len, re.findall("`+", core)), default=0) + 1)
            body = f"{fence}{core}{fence}"
        else:
            body = escape(core)
        for on, mark in ((s.strike, "~~"), (s.italic, "*"), (s.bold, "**")):
            body = f"{mark}{body}{mark}" if on else body
        body = f"<u>{body}</u>" if s.underline else body
        body = f"<{s.script}>{body}</{s.script}>" if s.script else body
        if r.link:
            target = f"<{r.link}>" if re.search(r"[ ()]", r.link) else r.link
            body = f"[{body}]({target})"
        out.append(before + body + after)
    return "".join(out).strip()


def list_label(marker: str, ordinal: int) -> str:
    """The label of a list item: a bullet, a number, or a bullet and a letter or Roman numeral."""
    if marker == "decimal":
        return f"{ordinal}."
    if marker.endswith("alpha"):
        text, n = "", ordinal
        while n > 0:
            n, k = divmod(n - 1, 26)
            text = chr(97 + k) + text
    elif marker.endswith("roman"):
        text, n = "", ordinal
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            text += sign * (n // value)
            n %= value
    else:
        return "-"
    return f"- {text.upper() if marker.startswith('upper') else text}."


def table_markdown(cells: list[Cell], header_rows: int) -> str:
    """A pipe table, or HTML if any cell spans more than its own place."""
    if not cells:
        return ""
    rows, cols = max(c.row + c.row_span for c in cells), max(c.col + c.col_span for c in cells)
    by_place = {(c.row, c.col): c for c in cells}
    if any(c.row_span > 1 or c.col_span > 1 for c in cells):
        lines = []
        for r in range(rows):
            tag = "th" if r < header_rows else "td"
            own = [by_place[r, c] for c in range(cols) if (r, c) in by_place]
            span = lambda c: (f' rowspan="{c.row_span}"' if c.row_span > 1 else "") + (f' colspan="{c.col_span}"' if c.col_span > 1 else "")
            lines.append("<tr>" + "".join(f"<{tag}{span(c)}>{html.escape(c.text)}</{tag}>" for c in own) + "</tr>")
        return "<table>\n" + "\n".join(lines) + "\n</table>"
    text = lambda r, c: by_place[r, c].text.replace("|", "\\|").replace("\n", "<br>") if (r, c) in by_place else ""
    lines = ["| " + " | ".join(text(r, c) for c in range(cols)) + " |" for r in range(rows)]
    top = lines[:header_rows] or ["|" + "  |" * cols]
    return "\n".join([*top, "|" + " --- |" * cols, *lines[header_rows:]])


def block_markdown(b: Block) -> str:
    if b.type == "heading":
        return "#" * min(6, max(1, b.level)) + " " + b.text
    if b.type == "item":
        return "    " * b.depth + f"{list_label(b.marker, b.ordinal or 1)} {b.text}"
    if b.type == "table":
        return table_markdown(b.cells, b.header_rows)
    if b.type == "code":
        fence = "`" * max(3, max(map(len, re.findall("`+", b.text)), default=0) + 1)
        return f"{fence}\n{b.text}\n{fence}"
    if b.type == "quote":
        return "\n".join("> " + x for x in b.text.split("\n"))
    if b.type == "rule":
        return "---"
    return b.text


def document_markdown(d: Document) -> str:
    """Units under their labels, unless a unit is a whole flow or begins with its label; then the notes."""
    parts: list[str] = []
    for u in d.units:
        first = u.blocks[0].text if u.blocks and u.blocks[0].type == "heading" else None
        if u.label and not (u.kind == "flow" and len(d.units) == 1) and u.label != first:
            parts.append("# " + u.label)
        last = None
        for b in u.blocks:
            text = block_markdown(b)
            if last == b.type == "item":
                parts[-1] += "\n" + text
            elif text.strip():
                parts.append(text)
            last = b.type
    parts += [f"[^{i}]: {t}" for _, i, t in d.notes]
    return "\n\n".join(parts).strip() + "\n" if parts else ""


def cell_kind(text: str) -> str:
    t = text.strip()
    if not t:
        return "empty"
    if re.fullmatch(r"[+-]?(?i:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", t):
        return "number"
    return "boolean" if t.lower() in ("true", "false") else "text"
