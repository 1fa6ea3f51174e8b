"""Zip packages and compound files, within limits; what format a file has."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.etree import ElementTree as ET

from pagelathe.sources.model import DocumentError, Limits

OLE_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_MIMETYPES = {
    "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp", "application/epub+zip": "epub",
}


class Package:
    """A zip archive whose declared sizes were checked before anything was inflated."""

    def __init__(self, data: bytes, limits: Limits) -> None:
        self.limits = limits
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise DocumentError("malformed", f"not a zip archive: {e}") from None
        infos = self.zip.infolist()
        if len(infos) > limits.entries or sum(i.file_size for i in infos) > limits.total_bytes:
            raise DocumentError("limit", "too many or too large entries")
        self.names = {i.filename.lstrip("/"): i for i in infos}

    def read(self, name: str) -> bytes:
        info = self.names.get(name)
        if info is None:
            raise DocumentError("missing", name)
        if info.flag_bits & 1:
            raise DocumentError("encrypted", name)
        if info.file_size > self.limits.entry_bytes:
            raise DocumentError("limit", name)
        try:
            with self.zip.open(info) as f:
                data = f.read(info.file_size + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError) as e:
            raise DocumentError("malformed", f"{name}: {e}") from None
        if len(data) > info.file_size:
            raise DocumentError("limit", name)
        return data

    def xml(self, name: str) -> ET.Element:
        return parse_xml(self.read(name), name, self.limits)

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id to (kind, target) of a part; targets that lead out of the package are left out."""
        folder, _, base = part.rpartition("/")
        name = f"{folder}/_rels/{base}.rels".lstrip("/")
        if name not in self.names:
            return {}
        out = {}
        for r in self.xml(name):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = resolve(folder, target)
                if target is None:
                    continue
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target)
        return out


def parse_xml(data: bytes, name: str, limits: Limits) -> ET.Element:
    if b"<!ENTITY" in data[:65536]:
        raise DocumentError("malformed", f"{name}: entities are not allowed")
    nodes = depth = 0
    root = None
    try:
        for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
            if event == "start":
                root = e if root is None else root
                nodes, depth = nodes + 1, depth + 1
                if nodes > limits.nodes or depth > limits.depth:
                    raise DocumentError("limit", f"{name}: too many or too deep elements")
            else:
                depth -= 1
    except ET.ParseError as e:
        raise DocumentError("malformed", f"{name}: {e}") from None
    if root is None:
        raise DocumentError("malformed", f"{name}: empty")
    return root


def resolve(folder: str, target: str) -> str | None:
    """A path in a package from a folder; None if it leads out of it."""
    parts = [] if target.startswith("/") else [p for p in folder.split("/") if p]
    for p in target.split("/"):
        if p == "..":
            if not parts:
                return None
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(e: ET.Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


class Compound:
    """Streams of an OLE2 compound file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != OLE_MAGIC or len(data) < 512:
            raise DocumentError("malformed", "not a compound file")
        self.data = data
        try:
            self._open()
        except (struct.error, IndexError) as e:
            raise DocumentError("malformed", f"compound file: {e}") from None

    def _open(self) -> None:
        self.sector, self.mini = (1 << x for x in struct.unpack_from("<2H", self.data, 30))
        if not 512 <= self.sector <= 4096 or self.mini != 64:
            raise DocumentError("malformed", "sector sizes")
        n_fat, directory, _, self.cutoff, mini_fat, _, difat, _ = struct.unpack_from("<I I I I I I I I", self.data, 44)
        sectors = [s for s in struct.unpack_from("<109I", self.data, 76) if s < 0xFFFFFFFA]
        seen = set()
        while difat < 0xFFFFFFFA and difat not in seen:
            seen.add(difat)
            more = struct.unpack(f"<{self.sector // 4}I", self._at(difat))
            sectors += [s for s in more[:-1] if s < 0xFFFFFFFA]
            difat = more[-1]
        self.fat = [x for s in sectors[:n_fat] for x in struct.unpack(f"<{self.sector // 4}I", self._at(s))]
        entries = self._chain(directory)
        self.streams: dict[str, tuple[int, int]] = {}
        root = (0xFFFFFFFE, 0)
        for k in range(0, len(entries) - 127, 128):
            e = entries[k : k + 128]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<IQ", e, 116)
            if e[66] == 5:
                root = (start, size)
            elif e[66] == 2:
                self.streams[name] = (start, size & 0xFFFFFFFF if self.sector == 512 else size)
        mini = self._chain(mini_fat)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.mini_stream = self._chain(root[0])

    def _at(self, s: int) -> bytes:
        out = self.data[(s + 1) * self.sector : (s + 2) * self.sector]
        return out + bytes(self.sector - len(out))

    def _chain(self, s: int) -> bytes:
        out, seen = [], set()
        while s < 0xFFFFFFFA and s not in seen:
            seen.add(s)
            out.append(self._at(s))
            s = self.fat[s]
        return b"".join(out)

    def read(self, name: str) -> bytes:
        if name not in self.streams:
            raise DocumentError("missing", name)
        start, size = self.streams[name]
        try:
            if size >= self.cutoff:
                return self._chain(start)[:size]
            out, seen = [], set()
            while start < 0xFFFFFFFA and start not in seen:
                seen.add(start)
                out.append(self.mini_stream[start * 64 : start * 64 + 64])
                start = self.mini_fat[start]
            return b"".join(out)[:size]
        except IndexError:
            raise DocumentError("malformed", f"stream {name}") from None


def detect(data: bytes, name: str = "") -> str:
    """The format of a file by its signature, then of its package, then by its extension; "unknown" if none tells."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if data[:5] == b"{\\rtf":
        return "rtf"
    if data[:8] == OLE_MAGIC:
        try:
            streams = Compound(data).streams
        except DocumentError:
            return "unknown"
        for stream, fmt in (("WordDocument", "doc"), ("PowerPoint Document", "ppt"), ("Workbook", "xls"), ("Book", "xls")):
            if stream in streams:
                return fmt
        return "unknown"
    if data[:4] == b"PK\x03\x04":
        try:
            package = Package(data, Limits())
            if "mimetype" in package.names:
                kind = _MIMETYPES.get(package.read("mimetype").decode("latin-1").strip())
                if kind:
                    return kind
            main = next((t for k, t in package.relations("").values() if k == "officeDocument"), "")
        except DocumentError:
            return "unknown"
        for folder, fmt in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx")):
            if main.startswith(folder) or (not main and any(n.startswith(folder) for n in package.names)):
                return fmt
        return "epub" if "META-INF/container.xml" in package.names else "unknown"
    if b"%PDF-" in data[:1024]:
        return "pdf"
    for magic, fmt in ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif")):
        if data.startswith(magic):
            return fmt
    head = data[:1024].lstrip().lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "html"
    return {"csv": "csv", "tsv": "tsv", "html": "html", "htm": "html", "xhtml": "html", "txt": "text"}.get(ext, "unknown")
