"""Word-processing, presentation and spreadsheet packages of both families, e-books, and legacy word files."""

from __future__ import annotations

import hashlib
import re
import struct
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from pagelathe.sources import html
from pagelathe.sources.model import Block, Cell, Document, DocumentError, Options, Run, Style, Unit, cell_kind, inline
from pagelathe.sources.package import Compound, Package, attr, local
from pagelathe.sources.plain import blocks_from_control_text

_MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def _child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if local(c.tag) == name), None) if e is not None else None
    return e


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if local(c.tag) == name]


def _asset(document: Document, package: Package, name: str, options: Options) -> str:
    """The name under which a part is kept: its hash and extension."""
    try:
        data = package.read(name)
    except DocumentError as e:
        document.warnings.append(("asset", str(e)))
        return name
    ext = name.rpartition(".")[2].lower()
    kept = f"{hashlib.sha256(data).hexdigest()}.{ext}"
    if options.assets and all(n != kept for n, _, _ in document.assets):
        document.assets.append((kept, _MEDIA.get(ext, "application/octet-stream"), data))
    return kept


def _core_properties(package: Package, document: Document) -> None:
    if "docProps/core.xml" in package.names:
        for e in package.xml("docProps/core.xml"):
            if e.text and local(e.tag) in ("title", "creator", "subject", "language", "created", "modified"):
                document.properties[local(e.tag)] = e.text.strip()


def _main_part(package: Package, default: str) -> str:
    return next((t for k, t in package.relations("").values() if k == "officeDocument"), default)


def _on(e: ET.Element | None) -> bool:
    return e is not None and (attr(e, "val") or "true") not in ("0", "false", "none", "off")


class _Word:
    def __init__(self, data: bytes, options: Options) -> None:
        self.package, self.options = Package(data, options.limits), options
        self.document = Document("docx")
        self.main = _main_part(self.package, "word/document.xml")
        self.relations = self.package.relations(self.main)
        self.counters: dict[tuple[str, int], int] = {}
        folder = self.main.rpartition("/")[0]
        self.styles: dict[str, ET.Element] = {}
        if f"{folder}/styles.xml" in self.package.names:
            self.styles = {attr(s, "styleId") or "": s for s in self.package.xml(f"{folder}/styles.xml") if local(s.tag) == "style"}
        self.numbering = self._numbering(f"{folder}/numbering.xml")

    def _numbering(self, part: str) -> dict[tuple[str, int], tuple[str, int]]:
        if part not in self.package.names:
            return {}
        root = self.package.xml(part)
        kinds = {"decimal": "decimal", "lowerLetter": "lower_alpha", "upperLetter": "upper_alpha", "lowerRoman": "lower_roman", "upperRoman": "upper_roman"}
        abstract = {}
        for a in (e for e in root if local(e.tag) == "abstractNum"):
            for level in (e for e in a if local(e.tag) == "lvl"):
                fmt, start = _child(level, "numFmt"), _child(level, "start")
                kind = kinds.get((attr(fmt, "val") if fmt is not None else "") or "", "bullet")
                abstract[attr(a, "abstractNumId"), int(attr(level, "ilvl") or 0)] = (kind, int((attr(start, "val") if start is not None else None) or 1))
        out = {}
        for n in (e for e in root if local(e.tag) == "num"):
            ref = _child(n, "abstractNumId")
            for (ident, level), v in abstract.items():
                if ref is not None and ident == attr(ref, "val"):
                    out[attr(n, "numId") or "", level] = v
        return out

    def heading(self, style: str | None) -> int | None:
        """Along the chain of styles: a name or identifier like "heading 2" or "title", or an outline level."""
        for _ in range(16):
            s = self.styles.get(style or "")
            name = _child(s, "name")
            outline = _child(s, "pPr", "outlineLvl")
            for text in (style, attr(name, "val") if name is not None else None):
                m = re.match(r"(heading|title)(\d*)", re.sub(r"[ _-]", "", (text or "").lower()))
                if m:
                    return min(6, max(1, int(m[2] or 1)))
            if outline is not None and (attr(outline, "val") or "9").isdigit() and int(attr(outline, "val") or 9) < 6:
                return int(attr(outline, "val") or 0) + 1
            based = _child(s, "basedOn")
            if s is None or based is None or attr(s, "type") == "character":
                return None
            style = attr(based, "val")
        return None

    def runs(self, p: ET.Element, link: str | None = None) -> list[Run]:
        out: list[Run] = []
        for e in p:
            name = local(e.tag)
            if name == "hyperlink":
                out += self.runs(e, self.relations.get(attr(e, "id") or "", ("", None))[1] or (f"#{attr(e, 'anchor')}" if attr(e, "anchor") else None))
            elif name in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out += self.runs(e, link)
            elif name == "r":
                props = _child(e, "rPr")
                flag = lambda n, props=props: _on(_child(props, n))
                vertical = _child(props, "vertAlign")
                script = {"superscript": "sup", "subscript": "sub"}.get((attr(vertical, "val") if vertical is not None else "") or "", "")
                style = Style(flag("b"), flag("i"), flag("u"), flag("strike"), False, script)
                for c in e:
                    kind = local(c.tag)
                    if kind == "t":
                        out.append(Run(c.text or "", style, link))
                    elif kind in ("tab", "br", "cr"):
                        out.append(Run(" ", style, link))
                    elif kind in ("footnoteReference", "endnoteReference"):
                        out.append(Run(f"[^{kind[0]}{attr(c, 'id')}]", raw=True))
                    elif kind in ("drawing", "pict"):
                        for blip in [b for b in c.iter() if local(b.tag) in ("blip", "imagedata")]:
                            target = self.relations.get(attr(blip, "embed") or attr(blip, "id") or "", ("", ""))[1]
                            if target:
                                out.append(Run(f"![]({_asset(self.document, self.package, target, self.options)})", raw=True))
        return out

    def paragraph(self, p: ET.Element) -> Block | None:
        text = inline(self.runs(p))
        props = _child(p, "pPr")
        style = _child(props, "pStyle")
        level = self.heading(attr(style, "val") if style is not None else None)
        number = _child(props, "numPr")
        if not text:
            return None
        if level:
            return Block("heading", text, level)
        if number is not None and _child(number, "numId") is not None:
            ident, depth = attr(_child(number, "numId"), "val") or "", int((attr(_child(number, "ilvl"), "val") if _child(number, "ilvl") is not None else "0") or 0)
            kind, start = self.numbering.get((ident, depth), ("bullet", 1))
            for key in [k for k in self.counters if k[0] == ident and k[1] > depth]:
                del self.counters[key]
            n = self.counters[ident, depth] = self.counters.get((ident, depth), start - 1) + 1
            return Block("item", text, depth=depth, marker=kind, ordinal=n)
        return Block("paragraph", text)

    def table(self, t: ET.Element) -> Block:
        cells: list[Cell] = []
        open_: dict[int, Cell] = {}
        for r, tr in enumerate(e for e in t if local(e.tag) == "tr"):
            col = 0
            for tc in (e for e in tr if local(e.tag) == "tc"):
                props = _child(tc, "tcPr")
                grid, merge = _child(props, "gridSpan"), _child(props, "vMerge")
                span = int((attr(grid, "val") if grid is not None else None) or 1)
                text = "\n".join(x for x in (inline(self.runs(p)) for p in _all(tc, "p")) if x)
                if merge is not None and (attr(merge, "val") or "continue") == "continue" and col in open_:
                    open_[col].row_span = r - open_[col].row + 1
                else:
                    cell = Cell(r, col, text, 1, span, cell_kind(text))
                    cells.append(cell)
                    if merge is not None:
                        open_[col] = cell
                    else:
                        open_.pop(col, None)
                col += span
        rows = {c.row for c in cells}
        return Block("table", cells=cells, header_rows=1 if len(rows) > 1 else 0)

    def body(self, root: ET.Element) -> list[Block]:
        out: list[Block] = []
        for e in root:
            name = local(e.tag)
            if name == "p":
                b = self.paragraph(e)
                out += [b] if b else []
            elif name == "tbl":
                out.append(self.table(e))
            elif name in ("sdt", "sdtContent", "body", "ins", "txbxContent"):
                out += self.body(e)
        return out

    def read(self) -> Document:
        blocks = self.body(self.package.xml(self.main))
        if self.options.headers_footers:
            parts = {k: [self.body(self.package.xml(t)) for _, (kind, t) in sorted(self.relations.items()) if kind == k] for k in ("header", "footer")}
            blocks = [b for p in parts["header"] for b in p] + blocks + [b for p in parts["footer"] for b in p]
        self.document.units.append(Unit("flow", None, blocks))
        for kind, target in self.relations.values():
            if kind in ("footnotes", "endnotes") and self.options.notes and target in self.package.names:
                for n in self.package.xml(target):
                    text = " ".join(inline(self.runs(p)) for p in _all(n, "p")).strip()
                    if text and attr(n, "type") is None:
                        self.document.notes.append((kind[:-1], f"{kind[0]}{attr(n, 'id')}", text))
        _core_properties(self.package, self.document)
        return self.document


def read_docx(data: bytes, options: Options) -> Document:
    return _Word(data, options).read()


def _drawn_text(p: ET.Element) -> str:
    runs = []
    for r in p:
        if local(r.tag) in ("r", "fld"):
            props = _child(r, "rPr")
            flag = lambda n, props=props: props is not None and props.get(n) in ("1", "true")
            t = _child(r, "t")
            runs.append(Run((t.text if t is not None else "") or "", Style(flag("b"), flag("i"), props is not None and props.get("u") not in (None, "none"))))
        elif local(r.tag) == "br":
            runs.append(Run(" "))
    return inline(runs)


def read_pptx(data: bytes, options: Options) -> Document:
    """Slides in the order of the presentation's list: titles, text, bullets, tables, pictures, speaker notes."""
    package, document = Package(data, options.limits), Document("pptx")
    main = _main_part(package, "ppt/presentation.xml")
    relations = package.relations(main)
    for no, ref in enumerate(_all(package.xml(main), "sldId"), 1):
        part = relations.get(next((v for k, v in ref.attrib.items() if local(k) == "id" and "}" in k), ""), ("", ""))[1]
        if part not in package.names:
            document.warnings.append(("missing", f"slide {no}"))
            continue
        own, blocks = package.relations(part), []
        for shape in package.xml(part).iter():
            kind = local(shape.tag)
            if kind == "sp":
                ph = next((x for x in shape.iter() if local(x.tag) == "ph"), None)
                title = ph is not None and ph.get("type") in ("title", "ctrTitle")
                body = _child(shape, "txBody")
                for p in _all(body, "p") if body is not None else []:
                    text = _drawn_text(p)
                    props = _child(p, "pPr")
                    bullet = (ph is not None and not title and ph.get("type") in (None, "body", "obj")) or _child(props, "buChar") is not None or _child(props, "buAutoNum") is not None
                    if not text:
                        continue
                    if title:
                        blocks.append(Block("heading", text, 1))
                    elif bullet and _child(props, "buNone") is None:
                        numbered = _child(props, "buAutoNum") is not None
                        last = blocks[-1] if blocks else None
                        n = last.ordinal + 1 if numbered and last and last.type == "item" and last.marker == "decimal" else 1
                        blocks.append(Block("item", text, depth=int((props.get("lvl") if props is not None else None) or 0), marker="decimal" if numbered else "bullet", ordinal=n))
                    else:
                        blocks.append(Block("paragraph", text))
            elif kind == "tbl":
                cells = []
                for r, tr in enumerate(e for e in shape if local(e.tag) == "tr"):
                    for c, tc in enumerate(e for e in tr if local(e.tag) == "tc"):
                        if tc.get("hMerge") in ("1", "true") or tc.get("vMerge") in ("1", "true"):
                            continue
                        text = "\n".join(x for x in map(_drawn_text, _all(tc, "p")) if x)
                        cells.append(Cell(r, c, text, int(tc.get("rowSpan", 1)), int(tc.get("gridSpan", 1)), cell_kind(text)))
                blocks.append(Block("table", cells=cells, header_rows=1))
            elif kind == "pic":
                for blip in _all(shape, "blip"):
                    target = own.get(attr(blip, "embed") or "", ("", ""))[1]
                    if target:
                        blocks.append(Block("figure", f"![]({_asset(document, package, target, options)})"))
        document.units.append(Unit("slide", f"Slide {no}", blocks))
        for kind, target in own.values():
            if kind == "notesSlide" and options.notes and target in package.names:
                text = " ".join(x for x in map(_drawn_text, _all(package.xml(target), "p")) if x and not x.isdigit())
                if text:
                    document.notes.append(("speaker_note", f"slide{no}", text))
    _core_properties(package, document)
    return document


def number_text(value: float) -> str:
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return f"{value:.10f}".rstrip("0").rstrip(".")


def _place(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    if not m:
        return 0, 0
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def read_xlsx(data: bytes, options: Options) -> Document:
    """A sheet a unit, in the workbook's order: values, formulas, dates, merged cells."""
    package, document = Package(data, options.limits), Document("xlsx")
    main = _main_part(package, "xl/workbook.xml")
    relations, folder = package.relations(main), main.rpartition("/")[0]
    shared = []
    if f"{folder}/sharedStrings.xml" in package.names:
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in package.xml(f"{folder}/sharedStrings.xml") if local(si.tag) == "si"]
    dates: set[int] = set()
    if f"{folder}/styles.xml" in package.names:
        root = package.xml(f"{folder}/styles.xml")
        own = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in _all(root, "numFmt")}
        cell_xfs = _child(root, "cellXfs")
        for k, xf in enumerate(cell_xfs if cell_xfs is not None else []):
            fmt = int(xf.get("numFmtId", 0))
            if 14 <= fmt <= 22 or 45 <= fmt <= 47 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(fmt, "").lower())):
                dates.add(k)
    seen = 0
    for sheet in _all(package.xml(main), "sheet"):
        part = relations.get(next((v for k, v in sheet.attrib.items() if local(k) == "id"), ""), ("", ""))[1]
        if part not in package.names:
            document.warnings.append(("missing", sheet.get("name", "")))
            continue
        root, cells = package.xml(part), {}
        for c in _all(root, "c"):
            row, col = _place(c.get("r", "A1"))
            v, f, kind = _child(c, "v"), _child(c, "f"), c.get("t", "n")
            raw = (v.text if v is not None else "") or ""
            if kind == "s":
                text, is_a = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else "", "text"
            elif kind == "inlineStr":
                text, is_a = "".join(t.text or "" for t in _all(c, "t")), "text"
            elif kind == "b":
                text, is_a = ("TRUE" if raw == "1" else "FALSE"), "boolean"
            elif kind in ("e", "str", "d"):
                text, is_a = raw, {"e": "error", "str": "text", "d": "datetime"}[kind]
            elif raw and int(c.get("s", 0)) in dates:
                text, is_a = str(datetime(1899, 12, 30) + timedelta(seconds=round(float(raw) * 86400))).removesuffix(" 00:00:00"), "datetime"
            else:
                try:
                    text, is_a = (number_text(float(raw)), "number") if raw else ("", "empty")
                except ValueError:
                    text, is_a = raw, "text"
            if text or f is not None:
                cells[row, col] = Cell(row, col, text, kind=is_a, formula=f.text if f is not None else None)
        if not cells:
            document.units.append(Unit("sheet", sheet.get("name"), []))
            continue
        rows, cols = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
        seen += rows * cols
        if seen > options.limits.expansion:
            raise DocumentError("limit", "too many cells")
        covered = set()
        for m in _all(root, "mergeCell"):
            a, _, b = m.get("ref", "").partition(":")
            (r0, c0), (r1, c1) = _place(a), _place(b or a)
            if r1 >= rows or c1 >= cols:
                document.warnings.append(("merge", m.get("ref", "")))
                continue
            origin = cells.setdefault((r0, c0), Cell(r0, c0, "", kind="empty"))
            origin.row_span, origin.col_span = r1 - r0 + 1, c1 - c0 + 1
            covered |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
        grid = [cells.get((r, c), Cell(r, c, "", kind="empty")) for r in range(rows) for c in range(cols) if (r, c) not in covered]
        first, second = [c for c in grid if c.row == 0], [c for c in grid if c.row == 1]
        header = int(all(c.kind == "text" and c.text.strip() for c in first) and any(c.kind in ("number", "boolean", "datetime") for c in second))
        document.units.append(Unit("sheet", sheet.get("name"), [Block("table", cells=grid, header_rows=header)]))
    _core_properties(package, document)
    return document


def read_odf(data: bytes, options: Options, fmt: str) -> Document:
    """Text, sheets and presentations: headings, paragraphs, lists, tables with repeats and spans, notes, pictures."""
    package, document = Package(data, options.limits), Document(fmt)
    if "META-INF/manifest.xml" in package.names and b"encryption-data" in package.read("META-INF/manifest.xml"):
        raise DocumentError("encrypted", "manifest")
    root = package.xml("content.xml")
    styles: dict[str, tuple[str | None, dict]] = {}
    for part in [p for p in ("styles.xml",) if p in package.names] + ["content.xml"]:
        for s in _all(package.xml(part), "style"):
            own = {}
            for p in (c for c in s if local(c.tag) == "text-properties"):
                own = {"bold": attr(p, "font-weight") == "bold", "italic": attr(p, "font-style") == "italic", "underline": (attr(p, "text-underline-style") or "none") != "none", "strike": (attr(p, "text-line-through-style") or "none") != "none"}
            styles[attr(s, "name") or ""] = (attr(s, "parent-style-name"), own)
    numbered = {attr(s, "name") for s in _all(root, "list-style") if any(local(c.tag) == "list-level-style-number" for c in s)}
    expanded = 0

    def style_of(name: str | None) -> Style:
        found: dict = {}
        for _ in range(16):
            if name not in styles:
                break
            parent, own = styles[name]
            found = {**own, **found}
            name = parent
        return Style(**{k: v for k, v in found.items() if v})

    def runs(e: ET.Element, style: Style, link: str | None = None) -> list[Run]:
        out = [Run(e.text or "", style, link)]
        for c in e:
            name = local(c.tag)
            if name == "span":
                out += runs(c, style_of(attr(c, "style-name")), link)
            elif name == "a":
                out += runs(c, style, attr(c, "href"))
            elif name == "s":
                out.append(Run(" " * int(attr(c, "c") or 1), style, link))
            elif name in ("tab", "line-break"):
                out.append(Run(" ", style, link))
            elif name == "note":
                ident = str(len(document.notes) + 1)
                body = _child(c, "note-body")
                if options.notes and body is not None:
                    document.notes.append((attr(c, "note-class") or "footnote", ident, " ".join(inline(runs(p, Style())) for p in _all(body, "p"))))
                    out.append(Run(f"[^{ident}]", raw=True))
            elif name == "image":
                out.append(Run(f"![]({_asset(document, package, attr(c, 'href') or '', options)})", raw=True))
            elif name in ("frame", "text-box", "p"):
                out += runs(c, style, link)
            out.append(Run(c.tail or "", style, link))
        return [Run(re.sub(r"\s+", " ", r.text), r.style, r.link, r.raw) for r in out]

    def table(t: ET.Element) -> Block:
        nonlocal expanded
        cells: list[Cell] = []
        row = 0
        rows = [r for r in t.iter() if local(r.tag) == "table-row"]
        for k, tr in enumerate(rows):
            times = int(attr(tr, "number-rows-repeated") or 1)
            own, col = [], 0
            for tc in (c for c in tr if local(c.tag) in ("table-cell", "covered-table-cell")):
                repeat = int(attr(tc, "number-columns-repeated") or 1)
                text = "\n".join(x for x in (inline(runs(p, Style())) for p in tc if local(p.tag) == "p") if x)
                if local(tc.tag) == "table-cell" and (text or (attr(tc, "number-columns-spanned") or "1") != "1"):
                    kind = {"float": "number", "percentage": "number", "currency": "number", "boolean": "boolean", "date": "datetime", "time": "datetime"}.get(attr(tc, "value-type") or "", cell_kind(text))
                    expanded += repeat * times
                    if expanded > options.limits.expansion:
                        raise DocumentError("limit", "too many cells")
                    own += [(col + n, text, int(attr(tc, "number-rows-spanned") or 1), int(attr(tc, "number-columns-spanned") or 1), kind, attr(tc, "formula")) for n in range(repeat)]
                col += repeat
            if own:
                cells += [Cell(row + n, c, x, rs, cs, k2, f) for n in range(times) for c, x, rs, cs, k2, f in own]
            row += times if own or k < len(rows) - 1 else 0
        first = [c for c in cells if c.row == 0]
        width = max((c.col + c.col_span for c in cells), default=0)
        header = int(len({c.row for c in cells}) > 1 and len(first) == width and all(c.row_span == c.col_span == 1 for c in first))
        return Block("table", cells=cells, header_rows=header)

    def walk(e: ET.Element, blocks: list[Block], depth: int = -1, marker: str = "bullet") -> None:
        n = 0
        for c in e:
            name = local(c.tag)
            if name == "h":
                blocks.append(Block("heading", inline(runs(c, Style())), int(attr(c, "outline-level") or 1)))
            elif name == "p":
                text = inline(runs(c, style_of(attr(c, "style-name"))))
                if text:
                    blocks.append(Block("item", text, depth=max(0, depth), marker=marker, ordinal=max(1, walk.count)) if depth >= 0 else Block("paragraph", text))
            elif name == "list":
                style = attr(c, "style-name")
                walk(c, blocks, depth + 1, ("decimal" if style in numbered else "bullet") if style else marker)
            elif name == "list-item":
                n += 1
                walk.count = n
                walk(c, blocks, depth, marker)
            elif name == "table":
                blocks.append(table(c))
            elif name not in ("sequence-decls", "forms", "tracked-changes", "notes"):
                walk(c, blocks, depth, marker)

    walk.count = 1
    body = _child(root, "body")
    content = next(iter(body), None) if body is not None else None
    if content is None:
        raise DocumentError("malformed", "no body")
    if fmt == "ods":
        document.units = [Unit("sheet", attr(t, "name"), [table(t)]) for t in content if local(t.tag) == "table"]
    elif fmt == "odp":
        for k, page in enumerate((p for p in content if local(p.tag) == "page"), 1):
            blocks: list[Block] = []
            walk(page, blocks)
            document.units.append(Unit("slide", attr(page, "name") or f"Slide {k}", blocks))
    else:
        blocks = []
        walk(content, blocks)
        document.units = [Unit("flow", None, blocks)]
    if "meta.xml" in package.names:
        for e in package.xml("meta.xml").iter():
            if e.text and local(e.tag) in ("title", "creator", "subject", "language", "creation-date", "date"):
                document.properties[local(e.tag)] = e.text.strip()
    return document


def read_epub(data: bytes, options: Options) -> Document:
    """Chapters in the order of the spine, with the images that the manifest names."""
    package, document = Package(data, options.limits), Document("epub")
    if "META-INF/encryption.xml" in package.names and b"EncryptedData" in package.read("META-INF/encryption.xml") and b"font" not in package.read("META-INF/encryption.xml").lower():
        raise DocumentError("encrypted", "META-INF/encryption.xml")
    opf = next((attr(e, "full-path") for e in package.xml("META-INF/container.xml").iter() if local(e.tag) == "rootfile"), None)
    if not opf:
        raise DocumentError("missing", "package document")
    root, folder = package.xml(opf), opf.rpartition("/")[0]
    manifest = {e.get("id"): ((folder + "/" if folder else "") + e.get("href", ""), e.get("media-type", "")) for e in _all(root, "item")}
    for e in root.iter():
        if local(e.tag) in ("title", "creator", "language", "subject", "date") and e.text:
            document.properties.setdefault(local(e.tag), e.text.strip())
    for ref in _all(root, "itemref"):
        part = manifest.get(ref.get("idref"), ("", ""))[0]
        if part not in package.names:
            document.warnings.append(("missing", part or str(ref.get("idref"))))
            continue
        blocks, properties = html.blocks_of(package.read(part).decode("utf-8", "replace"))
        document.units.append(Unit("chapter", properties.get("title"), blocks))
    for part, kind in manifest.values():
        if kind.startswith("image/") and part in package.names:
            _asset(document, package, part, options)
    return document


def read_doc(data: bytes, options: Options) -> Document:
    """Text of a legacy word file by its piece table, 8-bit pieces in code page 1252."""
    compound = Compound(data)
    word = compound.read("WordDocument")
    try:
        magic, flags = struct.unpack_from("<H", word, 0)[0], struct.unpack_from("<H", word, 10)[0]
        if magic not in (0xA5EC, 0xA5DC):
            raise DocumentError("malformed", "no word file")
        if flags & 0x0100:
            raise DocumentError("encrypted", "WordDocument")
        text_size = struct.unpack_from("<I", word, 76)[0]
        at, size = struct.unpack_from("<II", word, 418)
        table = compound.read("1Table" if flags & 0x0200 else "0Table")
        text = _pieces(word, table[at : at + size]) if size else word[struct.unpack_from("<I", word, 24)[0] :][:text_size].decode("cp1252", "replace")
    except struct.error as e:
        raise DocumentError("malformed", f"word file: {e}") from None
    return Document("doc", units=[Unit("flow", None, blocks_from_control_text(text[:text_size]))])


def _pieces(word: bytes, clx: bytes) -> str:
    at = 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise DocumentError("malformed", "piece table")
    size = struct.unpack_from("<I", clx, at + 1)[0]
    plc = clx[at + 5 : at + 5 + size]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc, 0)
    out = []
    for k in range(n):
        place = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
        chars = ends[k + 1] - ends[k]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(word[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(word[place : place + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out)
