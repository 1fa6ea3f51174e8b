"""Delimited text, plain text and rich text."""

from __future__ import annotations

import codecs
import csv
import io
import re

from pagelathe.sources.model import Block, Cell, Document, DocumentError, Options, Run, Style, Unit, cell_kind, inline

DELIMITERS = [",", "\t", ";", "|"]  # the last of equals is taken


def decode(data: bytes) -> str:
    for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(bom):
            return data[len(bom) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


def sniff(text: str) -> str:
    lines = [x for x in text.replace("\r", "").split("\n")[:20] if x]

    def score(k: int) -> tuple:
        counts = sorted(n for n in (x.count(DELIMITERS[k]) for x in lines) if n)
        median = counts[len(counts) // 2] if counts else 0
        return sum(n == median for n in counts), median, k

    return DELIMITERS[max(range(len(DELIMITERS)), key=score)]


def read_delimited(data: bytes, options: Options, delimiter: str | None = None) -> Document:
    text = decode(data)
    try:
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter or sniff(text)) if r]
    except csv.Error as e:
        raise DocumentError("malformed", str(e)) from None
    if sum(map(len, rows)) > options.limits.expansion:
        raise DocumentError("limit", "too many cells")
    cells = [Cell(r, c, v, kind=cell_kind(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    header = int(len(rows) > 1 and not any(c.kind in ("number", "boolean") for c in cells if c.row == 0))
    return Document("csv", units=[Unit("sheet", None, [Block("table", cells=cells, header_rows=header)] if cells else [])])


def read_text(data: bytes, options: Options) -> Document:
    parts = re.split(r"\n\s*\n", decode(data).replace("\r\n", "\n"))
    return Document("text", units=[Unit("flow", None, [Block("paragraph", " ".join(p.split())) for p in parts if p.strip()])])


_RTF = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object themedata colorschememapping latentstyles datastore generator listtable listoverridetable rsidtbl xmlnstbl fldinst header footer headerl headerr footerl footerr".split())
_SIGNS = {"emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "tab": "\t", "line": " ", "emspace": " ", "enspace": " "}


def read_rtf(data: bytes, options: Options) -> Document:
    """Paragraphs with bold, italic, underline and strike, tables, footnotes and links."""
    if not data.startswith(b"{\\rtf"):
        raise DocumentError("malformed", "no rich text")
    page = "cp1252"
    stack: list[dict] = []
    state = {"skip": False, "style": {}, "uc": 1, "note": False, "field": None}
    runs: list[Run] = []
    note: list[Run] = []
    blocks: list[Block] = []
    notes: list[tuple[str, str, str]] = []
    table: list[list[str]] = []
    row: list[str] = []
    in_table = False
    drop = 0
    link = ""
    depth = 0

    def put(text: str) -> None:
        nonlocal link
        if state["skip"]:
            if state["field"] == "inst":
                link += text
            return
        style = Style(**{k: True for k, v in state["style"].items() if v})
        found = re.search(r'HYPERLINK\s+"([^"]*)"', link) if state["field"] == "result" else None
        (note if state["note"] else runs).append(Run(text, style, found[1] if found else None))

    def end_table() -> None:
        if table:
            cells = [Cell(r, c, t, kind=cell_kind(t)) for r, cs in enumerate(table) for c, t in enumerate(cs)]
            blocks.append(Block("table", cells=cells, header_rows=1 if len(table) > 1 else 0))
            table.clear()

    def end_paragraph() -> None:
        text = inline(runs)
        runs.clear()
        if in_table:
            row.append(text) if text else None
            return
        end_table()
        if text:
            m = re.match(r"^[•·▪-]\s+(.*)", text, re.S)
            blocks.append(Block("item", m[1], marker="bullet", ordinal=1) if m else Block("paragraph", text))

    for m in _RTF.finditer(data):
        word, number, hexa, sign, brace, plain = m.groups()
        if brace == b"{":
            depth += 1
            if depth > options.limits.depth:
                raise DocumentError("limit", "groups too deep")
            stack.append({**state, "style": dict(state["style"])})
        elif brace:
            depth -= 1
            if not stack:
                break
            was = state
            state = stack.pop()
            if was["note"] and not state["note"]:
                ident = str(len(notes) + 1)
                notes.append(("footnote", ident, inline(note)))
                note.clear()
                runs.append(Run(f"[^{ident}]", raw=True))
        elif word:
            w, n = word.decode(), int(number) if number else None
            if w in ("fldinst",):
                state["skip"], state["field"], link = True, "inst", ""
            elif w == "fldrslt":
                state["field"] = "result"
            elif w in _SKIPPED:
                state["skip"] = True
            elif w == "footnote":
                state["note"] = True
            elif w == "ansicpg" and n:
                page = f"cp{n}"
            elif w == "uc" and n is not None:
                state["uc"] = n
            elif w == "u" and n is not None:
                put(chr(n % 65536) if not 0xD800 <= n % 65536 < 0xE000 else "\ufffd")
                drop = state["uc"]
            elif w in ("b", "i", "strike", "ul"):
                state["style"][{"b": "bold", "i": "italic", "ul": "underline"}.get(w, w)] = n != 0
            elif w == "ulnone":
                state["style"]["underline"] = False
            elif w in ("plain", "pard"):
                if w == "plain":
                    state["style"] = {}
                elif in_table and not row:
                    in_table = False
            elif w == "intbl":
                in_table = True
            elif w == "cell":
                row.append(inline(runs))
                runs.clear()
            elif w == "row":
                table.append(list(row))
                row.clear()
                in_table = False
            elif w in ("par", "sect", "page"):
                end_paragraph()
            elif w in _SIGNS:
                put(_SIGNS[w])
        elif hexa:
            if drop:
                drop -= 1
            else:
                try:
                    put(bytes([int(hexa, 16)]).decode(page, "replace"))
                except LookupError:
                    put(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
        elif sign:
            if sign == b"*":
                state["skip"] = True
            elif sign in (b"\\", b"{", b"}"):
                put(sign.decode())
            elif sign == b"~":
                put(" ")
            elif sign in (b"\n", b"\r"):
                end_paragraph()
        elif plain:
            text = plain.decode("latin-1")
            cut = min(drop, len(text))
            drop -= cut
            if text[cut:]:
                put(text[cut:])
    end_paragraph()
    end_table()
    return Document("rtf", units=[Unit("flow", None, blocks)], notes=notes if options.notes else [])


def blocks_from_control_text(text: str) -> list[Block]:
    """Text of a legacy word processor: 0x0D paragraph, 0x07 cell, 0x0B line, 0x0C page; fields show their result only."""
    out: list[Block] = []
    rows: list[list[str]] = []
    row: list[str] = []
    hidden: list[bool] = []
    part: list[str] = []

    def end_table() -> None:
        if rows:
            out.append(Block("table", cells=[Cell(r, c, t, kind=cell_kind(t)) for r, cs in enumerate(rows) for c, t in enumerate(cs)], header_rows=0))
            rows.clear()

    for ch in text:
        if ch == "\x13":
            hidden.append(True)
        elif ch == "\x14":
            if hidden:
                hidden[-1] = False
        elif ch == "\x15":
            if hidden:
                hidden.pop()
        elif any(hidden):
            continue
        elif ch == "\x07":
            cell = "".join(part).strip()
            part.clear()
            if cell or not row:
                row.append(cell)
            else:
                rows.append(list(row))
                row.clear()
        elif ch in "\r\x0c":
            if row:
                rows.append(list(row))
                row.clear()
            words = "".join(part).strip()
            part.clear()
            if words:
                end_table()
                out.append(Block("paragraph", words))
            if ch == "\x0c":
                end_table()
                out.append(Block("rule"))
        elif ch == "\x0b":
            part.append(" ")
        elif ch >= " " or ch == "\t":
            part.append(ch)
    if row:
        rows.append(list(row))
    end_table()
    words = "".join(part).strip()
    return out + ([Block("paragraph", words)] if words else [])
