"""The text layer of PDF files: positioned items, thin rectangles, links, and what each page is made of."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pagelathe.sources.model import DocumentError, Options

_SPACE = b"\0\t\n\f\r "
_TOKEN = re.compile(rb"[\0\t\n\f\r ]+|%[^\r\n]*|<<|>>|[\[\]{}]|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+|\(", re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MOST_FORM_DEPTH = 5


class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    fields: dict
    raw: bytes


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses from its opening one."""
    out, depth, k = bytearray(), 1, at + 1
    while k < len(data):
        c = data[k : k + 1]
        if c == b"\\":
            n = data[k + 1 : k + 2]
            octal = re.match(rb"[0-7]{1,3}", data[k + 1 : k + 4])
            if octal:
                out.append(int(octal[0], 8) & 255)
                k += 1 + len(octal[0])
                continue
            out += _ESCAPES.get(n, b"" if n in b"\r\n" else n)
            k += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), k + 1
        out += c
        k += 1
    return bytes(out), k


def _tokens(data: bytes, at: int = 0):
    """(kind, value, end) of a byte string from a place on."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        t, at = m[0], m.end()
        if t[:1] in _SPACE and not t.strip(_SPACE) or t[:1] == b"%":
            continue
        if t[:1] == b"(":
            value, at = _literal(data, m.start())
            yield "value", value, at
        elif t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield "value", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif t[:1] == b"/":
            yield "value", Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), t[1:].decode("latin-1"))), at
        elif t in (b"<<", b">>", b"[", b"]", b"{", b"}"):
            yield t.decode(), None, at
        elif re.fullmatch(rb"[+-]?\d+", t):
            yield "value", int(t), at
        elif re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", t):
            yield "value", float(t), at
        elif t in (b"true", b"false", b"null"):
            yield "value", {b"true": True, b"false": False, b"null": None}[t], at
        else:
            yield "word", t, at


def _value(data: bytes, at: int) -> tuple[object, int]:
    """One object from a place on."""
    stack: list[tuple[str, list]] = [("", [])]
    for kind, value, end in _tokens(data, at):
        top = stack[-1][1]
        if kind in ("<<", "["):
            stack.append((kind, []))
        elif kind in (">>", "]"):
            if len(stack) < 2:
                return None, end
            _, own = stack.pop()
            made = own if kind == "]" else {k: v for k, v in zip(own[::2], own[1::2], strict=False) if isinstance(k, str)}
            stack[-1][1].append(made)
        elif kind == "value":
            top.append(value)
        elif value == b"R" and len(top) > 1 and isinstance(top[-2], int):
            top[-2:] = [Ref(top[-2])]
        elif len(stack) == 1:
            return (top[-1] if top else None), end - len(value)
        if len(stack) == 1 and stack[0][1] and not isinstance(stack[0][1][-1], int):
            return stack[0][1][-1], end
    return (stack[0][1][-1] if stack[0][1] else None), len(data)


class Pdf:
    """Objects found by scanning for them, the last of a number counting; so a damaged table of them does no harm."""

    def __init__(self, data: bytes, options: Options) -> None:
        start = data.find(b"%PDF-")
        if start < 0 or start > 1024:
            raise DocumentError("malformed", "no PDF header")
        self.data, self.options = data[start:], options
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(self.data)}
        self.packed: dict[int, tuple[int, int]] = {}
        self.cache: dict[int, object] = {}
        trailers = [_value(self.data, m.end())[0] for m in re.finditer(rb"\btrailer\b", self.data)]
        for n in list(self.places):
            o = self.get(Ref(n))
            if isinstance(o, Stream) and o.fields.get("Type") == "ObjStm":
                count, first = self.get(o.fields.get("N")), self.get(o.fields.get("First"))
                head = [v for k, v, _ in _tokens(self.inflated(o)[: first or 0]) if k == "value"]
                for k in range(min(count or 0, len(head) // 2)):
                    self.packed.setdefault(head[2 * k], (n, (first or 0) + head[2 * k + 1]))
            elif isinstance(o, Stream) and o.fields.get("Type") == "XRef":
                trailers.append(o.fields)
        if any(isinstance(t, dict) and "Encrypt" in t for t in trailers):
            raise DocumentError("encrypted", "Encrypt")
        self.info = next((self.get(t["Info"]) for t in trailers if isinstance(t, dict) and "Info" in t), None) or {}
        root = next((self.get(t["Root"]) for t in reversed(trailers) if isinstance(t, dict) and "Root" in t), None)
        if not isinstance(root, dict):
            root = next((o for o in map(self.get, map(Ref, {*self.places, *self.packed})) if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if root is None:
            raise DocumentError("malformed", "no catalog")
        self.pages = self._pages(root)

    def get(self, o: object) -> object:
        for _ in range(20):
            if not isinstance(o, Ref):
                return o
            o = self._load(o.number)
        return None

    def _load(self, n: int) -> object:
        if n in self.cache:
            return self.cache[n]
        self.cache[n] = None
        if n in self.places:
            value, end = _value(self.data, self.places[n])
            m = re.compile(rb"\s*stream\r?\n?").match(self.data, end) if isinstance(value, dict) else None
            if m:
                size = self.get(value.get("Length"))
                raw = self.data[m.end() : m.end() + size] if isinstance(size, int) and self.data[m.end() + size : m.end() + size + 20].lstrip().startswith(b"endstream") else None
                if raw is None:
                    stop = self.data.find(b"endstream", m.end())
                    raw = self.data[m.end() : stop if stop >= 0 else len(self.data)]
                value = Stream(value, raw)
            self.cache[n] = value
        elif n in self.packed:
            holder, at = self.packed[n]
            self.cache[n] = _value(self.inflated(self.get(Ref(holder))), at)[0]
        return self.cache[n]

    def inflated(self, s: object) -> bytes:
        if not isinstance(s, Stream):
            return b""
        data = s.raw
        filters = self.get(s.fields.get("Filter")) or []
        params = self.get(s.fields.get("DecodeParms")) or {}
        for f in filters if isinstance(filters, list) else [filters]:
            f = self.get(f)
            if f in ("FlateDecode", "Fl"):
                unpack = zlib.decompressobj()
                try:
                    data = unpack.decompress(data, self.options.limits.entry_bytes)
                except zlib.error:
                    return b""
                p = self.get(params[0] if isinstance(params, list) and params else params)
                if isinstance(p, dict) and (self.get(p.get("Predictor")) or 1) >= 10:
                    data = _unpredicted(data, self.get(p.get("Columns")) or 1)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return b""
        return data

    def _pages(self, root: dict) -> list[dict]:
        out, seen, work = [], set(), [(root.get("Pages"), {})]
        while work:
            ref, above = work.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = {**above, **{k: node[k] for k in ("Resources", "MediaBox", "Rotate") if k in node}}
            if "Kids" in node:
                work += [(k, own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append({**own, **node})
        return out


def _unpredicted(data: bytes, columns: int) -> bytes:
    out, before = bytearray(), bytes(columns)
    for k in range(0, len(data) - columns, columns + 1):
        kind, line = data[k], bytearray(data[k + 1 : k + 1 + columns])
        for i in range(columns):
            left, up = line[i - 1] if i else 0, before[i]
            corner = before[i - 1] if i else 0
            if kind == 4:
                p = left + up - corner
                best = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line[i] = (line[i] + {0: 0, 1: left, 2: up, 3: (left + up) // 2}.get(kind, best if kind == 4 else 0)) & 255
        out += line
        before = bytes(line)
    return bytes(out)


@dataclass
class Font:
    name: str
    wide: bool
    codes: dict[int, str]
    widths: dict[int, float]
    default: float = 500.0

    def read(self, text: bytes) -> tuple[str, float]:
        """(text, width in thousandths) of a shown string."""
        step = 2 if self.wide else 1
        out, width = [], 0.0
        for k in range(0, len(text) - step + 1, step):
            code = int.from_bytes(text[k : k + step], "big")
            found = self.codes.get(code)
            out.append(found if found is not None else "�" if self.wide else bytes([code]).decode("cp1252", "replace"))
            width += self.widths.get(code, self.default)
        return "".join(out), width


def _codes(cmap: bytes) -> dict[int, str]:
    """Characters of a ToUnicode map, from its bfchar and bfrange sections."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for m in re.finditer(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        own = [v for k, v, _ in _tokens(m[1]) if k == "value"]
        out.update({int.from_bytes(a, "big"): text(b) for a, b in zip(own[::2], own[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)})
    for m in re.finditer(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        own, _ = _value(b"[" + m[1] + b"]", 0)
        for a, b, c in zip(own[::3], own[1::3], own[2::3], strict=False):
            if not isinstance(a, bytes) or not isinstance(b, bytes):
                continue
            low, high = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535)
            for k in range(low, high + 1):
                if isinstance(c, list):
                    if k - low < len(c) and isinstance(c[k - low], bytes):
                        out[k] = text(c[k - low])
                elif isinstance(c, bytes) and c:
                    out[k] = text(c[:-2] + ((int.from_bytes(c[-2:], "big") + k - low) & 0xFFFF).to_bytes(2, "big"))
    return out


@dataclass
class PageContent:
    items: list[dict] = field(default_factory=list)
    rects: list[tuple[float, float, float, float]] = field(default_factory=list)
    text_ops: int = 0
    image_count: int = 0
    path_ops: int = 0
    font_changes: int = 0
    undecodable_fonts: int = 0
    type3_fonts: int = 0
    fonts: int = 0


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class _Interpreter:
    def __init__(self, pdf: Pdf) -> None:
        self.pdf, self.page, self.fonts = pdf, PageContent(), {}

    def font(self, resources: dict, name: str) -> Font | None:
        d = self.pdf.get((self.pdf.get(resources.get("Font")) or {}).get(name))
        if not isinstance(d, dict):
            return None
        if id(d) in self.fonts:
            return self.fonts[id(d)]
        kind, wide = d.get("Subtype"), d.get("Subtype") == "Type0"
        codes = _codes(self.pdf.inflated(self.pdf.get(d.get("ToUnicode")))) if "ToUnicode" in d else {}
        widths, default = {}, 500.0
        if wide:
            below = self.pdf.get((self.pdf.get(d.get("DescendantFonts")) or [None])[0]) or {}
            default = float(self.pdf.get(below.get("DW")) or 1000)
            w, k = [self.pdf.get(x) for x in self.pdf.get(below.get("W")) or []], 0
            while k + 1 < len(w):
                if isinstance(w[k + 1], list):
                    widths.update({w[k] + n: float(self.pdf.get(x)) for n, x in enumerate(w[k + 1])})
                    k += 2
                elif k + 2 < len(w):
                    widths.update(dict.fromkeys(range(w[k], min(w[k + 1], w[k] + 65535) + 1), float(w[k + 2])))
                    k += 3
                else:
                    break
        else:
            first = self.pdf.get(d.get("FirstChar")) or 0
            widths = {first + n: float(self.pdf.get(x) or 0) for n, x in enumerate(self.pdf.get(d.get("Widths")) or [])}
        self.page.fonts += 1
        self.page.type3_fonts += kind == "Type3"
        self.page.undecodable_fonts += wide and not codes
        self.fonts[id(d)] = Font(str(d.get("BaseFont", "")), wide, codes, widths, default)
        return self.fonts[id(d)]

    def run(self, data: bytes, resources: dict, ctm: tuple = (1, 0, 0, 1, 0, 0), depth: int = 0) -> None:
        stack: list = []
        saved: list = []
        tm = line = (1, 0, 0, 1, 0, 0)
        font, size, char, word, scale, leading, rise = None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
        lists: list[list] = []

        def show(text: bytes) -> None:
            nonlocal tm
            if font is None:
                return
            found, width = font.read(text)
            step = (width / 1000 * size + char * len(found) + word * text.count(b" ") * (not font.wide)) * scale
            at = _times((size * scale, 0, 0, size, 0, rise), _times(tm, ctm))
            wide = _times((1, 0, 0, 1, step, 0), _times(tm, ctm))
            base = _times(tm, ctm)
            if found.strip():
                height = (at[2] ** 2 + at[3] ** 2) ** 0.5
                self.page.items.append({"text": found, "x": at[4], "y": at[5], "width": abs(wide[4] - base[4]), "height": height, "font": font.name, "font_size": round(height, 2)})
            tm = _times((1, 0, 0, 1, step, 0), tm)

        for kind, value, _ in _tokens(data):
            if kind in ("[", "<<"):
                lists.append(stack)
                stack = []
                continue
            if kind in ("]", ">>"):
                if lists:
                    own, stack = stack, lists.pop()
                    stack.append(own)
                continue
            if kind == "value":
                stack.append(value)
                if len(stack) > 10_000 and not lists:
                    stack.clear()
                continue
            if kind != "word" or lists:
                continue
            op, a = value, stack
            stack = []
            try:
                if op == b"q":
                    saved.append((ctm, font, size, char, word, scale, leading, rise))
                elif op == b"Q" and saved:
                    ctm, font, size, char, word, scale, leading, rise = saved.pop()
                elif op == b"cm":
                    ctm = _times(tuple(map(float, a[-6:])), ctm)
                elif op == b"BT":
                    tm = line = (1, 0, 0, 1, 0, 0)
                elif op == b"Tf":
                    font, size = self.font(resources, a[-2]), float(a[-1])
                    self.page.font_changes += 1
                elif op in (b"Td", b"TD"):
                    leading = -float(a[-1]) if op == b"TD" else leading
                    tm = line = _times((1, 0, 0, 1, float(a[-2]), float(a[-1])), line)
                elif op == b"Tm":
                    tm = line = tuple(map(float, a[-6:]))
                elif op == b"T*":
                    tm = line = _times((1, 0, 0, 1, 0, -leading), line)
                elif op in (b"Tc", b"Tw", b"TL", b"Ts"):
                    v = float(a[-1])
                    char, word, leading, rise = (v if op == b"Tc" else char), (v if op == b"Tw" else word), (v if op == b"TL" else leading), (v if op == b"Ts" else rise)
                elif op == b"Tz":
                    scale = float(a[-1]) / 100
                elif op in (b"Tj", b"'", b'"'):
                    self.page.text_ops += 1
                    if op != b"Tj":
                        if op == b'"':
                            word, char = float(a[-3]), float(a[-2])
                        tm = line = _times((1, 0, 0, 1, 0, -leading), line)
                    show(a[-1])
                elif op == b"TJ":
                    self.page.text_ops += 1
                    for part in a[-1]:
                        if isinstance(part, bytes):
                            show(part)
                        else:
                            tm = _times((1, 0, 0, 1, -float(part) / 1000 * size * scale, 0), tm)
                elif op == b"re":
                    x, y, w, h = map(float, a[-4:])
                    p, q = _times((1, 0, 0, 1, x, y), ctm), _times((1, 0, 0, 1, x + w, y + h), ctm)
                    self.page.rects.append((min(p[4], q[4]), min(p[5], q[5]), abs(q[4] - p[4]), abs(q[5] - p[5])))
                elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"b"):
                    self.page.path_ops += 1
                elif op == b"BI":
                    self.page.image_count += 1
                elif op == b"Do":
                    o = self.pdf.get((self.pdf.get(resources.get("XObject")) or {}).get(a[-1]))
                    if isinstance(o, Stream) and o.fields.get("Subtype") == "Image":
                        self.page.image_count += 1
                    elif isinstance(o, Stream) and depth < MOST_FORM_DEPTH:
                        matrix = tuple(map(float, self.pdf.get(o.fields.get("Matrix")) or (1, 0, 0, 1, 0, 0)))
                        self.run(self.pdf.inflated(o), self.pdf.get(o.fields.get("Resources")) or resources, _times(matrix, ctm), depth + 1)
            except (IndexError, TypeError, ValueError):
                continue  # an operator with the wrong operands has no effect


def read_pages(data: bytes, options: Options) -> list[PageContent]:
    """The content of each page in order."""
    pdf = Pdf(data, options)
    out = []
    for p in pdf.pages:
        reader = _Interpreter(pdf)
        contents = pdf.get(p.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        reader.run(b"\n".join(pdf.inflated(pdf.get(c)) for c in parts), pdf.get(p.get("Resources")) or {})
        for ref in pdf.get(p.get("Annots")) or []:
            note = pdf.get(ref)
            target = pdf.get(note.get("A")) if isinstance(note, dict) else None
            if isinstance(target, dict) and isinstance(pdf.get(target.get("URI")), bytes):
                x0, y0, x1, y1 = (float(pdf.get(v)) for v in pdf.get(note["Rect"]))
                reader.page.items.append({"text": "", "x": x0, "y": y0, "width": x1 - x0, "height": y1 - y0, "font": "", "font_size": 0.0, "url": pdf.get(target["URI"]).decode("latin-1")})
        out.append(reader.page)
    return out


def page_estimate(data: bytes) -> int:
    """Page objects by their marks in the raw bytes."""
    return len(re.findall(rb"/Type\s*/Page(?=[\s/<>\[\]{}%]|$)", data))
