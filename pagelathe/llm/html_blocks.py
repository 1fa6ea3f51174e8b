"""HTML pages to sequences of leaf blocks: text, path of open elements, and feature vectors."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from pagelathe.llm.shingles import word_hashes

PATH_SLOTS, WORD_SLOTS, NUMBERS = 512, 256, 6

_NAME_AT = re.compile(r"</?+([a-zA-Z][a-zA-Z0-9:-]*+)")
#: From behind a tag's name to behind its '>', which may stand in quoted values.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: So many tags of a page may have quotes that never close; after them quotes are no longer heeded.
_MOST_UNCLOSED = 16
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block, which do not end it.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


@dataclass
class Block:
    """A leaf block: its text, the slots of the path of open elements as bits, how many they are, the linked share."""

    text: str
    slots: int
    depth: int
    linked: float = 0.0


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, whether it closes, attributes) of the mark-up of a page; what is no tag has no name.

    A comment or a raw element reaches to its end, or where that is missing to the page's; a '<' that nothing
    closes is text. Every character is passed a bounded number of times, whatever the page.
    """
    at, size, unclosed = 0, len(page), 0
    while (low := page.find("<", at)) >= 0:
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            at = size if end < 0 else end + 3
            yield low, at, "", False, ""
            continue
        found = _NAME_AT.match(page, low)
        if not found and page[low + 1 : low + 2] not in ("!", "?"):
            at = low + 1
            continue
        after = found.end() if found else low + 2
        high = page.find(">", after)
        if high < 0:
            # no tag ends any more; only a comment may still begin
            if (low := page.find("<!--", low)) >= 0:
                yield low, size, "", False, ""
            return
        at = high + 1
        if not found:
            yield low, at, "", False, ""
            continue
        attrs = page[after:high]
        if ('"' in attrs or "'" in attrs) and unclosed < _MOST_UNCLOSED:
            if rest := _REST.match(page, after):
                at = rest.end()
                attrs = page[after : at - 1]
            else:
                unclosed += 1
        name, closes = found[1].lower(), page[low + 1] == "/"
        if name in _RAW_END and not closes and not (name == "svg" and attrs.endswith("/")):
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            name = ""
        elif name == "svg" and not closes:
            name = ""
        yield low, at, name, closes, attrs


def _element(tag: str, attrs: str) -> str:
    """tag and the words of its class, id and role, as one string; what the path is made of."""
    if not attrs or "=" not in attrs:
        return tag
    words = []
    for m in _ATTRIBUTE.finditer(attrs):
        words += [f"{m[1][:2].lower()}:{w.lower()}" for w in _NAME.findall(m[2] or m[3] or m[4] or "")[:8]]
    return " ".join([tag, *words])


def _bits(words: Iterable[str]) -> int:
    out = 0
    for w in words:
        out |= 1 << zlib.crc32(w.encode()) % PATH_SLOTS
    return out


@lru_cache(100_000)
def _element_bits(element: str) -> tuple[int, int, int]:
    """Slots of an element's words: as they are, and again as the last and as the last but one of a path."""
    words = element.split(" ")
    return _bits(words), _bits(f"0/{w}" for w in words), _bits(f"1/{w}" for w in words)


@lru_cache(50_000)
def _slots_of(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(PATH_SLOTS // 8, "little"), np.uint8), bitorder="little"))


class _Open:
    """The open elements of a page, with the slots of the path; every operation takes the same time at any depth."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.bits: list[tuple[int, int, int]] = []  # of the path so far, and the element's own two
        self.places: dict[str, list[int]] = {}

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of some tags, -1 for none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def push(self, tag: str, element: str) -> None:
        own, last, second = _element_bits(element)
        self.places.setdefault(tag, []).append(len(self.tags))
        self.bits.append(((self.bits[-1][0] if self.bits else 0) | own, last, second))
        self.tags.append(tag)

    def close(self, k: int) -> None:
        """Close elements down to the k-th, which closes too."""
        while len(self.tags) > k >= 0:
            self.places[self.tags.pop()].pop()
            self.bits.pop()

    def slots(self) -> int:
        out = self.bits[-1][0] | self.bits[-1][1] if self.bits else 0
        return out | self.bits[-2][2] if len(self.bits) > 1 else out


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order. Comments, scripts, styles and other raw elements leave nothing.

    References are decoded and white space becomes single blanks; blocks without text are left out. A null page
    has no blocks; a text without tags is one block. Work grows with the length of the page alone: neither unclosed
    tags nor deep nesting add to it.
    """
    page = page or ""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, opened.slots(), len(opened.tags), min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    for low, high, tag, closes, attrs in _tags(page):
        if low > at:
            parts.append(page[at:low])
            if in_link:
                linked += low - at
        at = high
        if not tag:
            continue
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            in_link = not closes
        if tag in _INLINE:
            continue
        flush()
        if closes:
            opened.close(opened.last((tag,)))
            continue
        if tag in _ENDS_P:
            opened.close(opened.last(("p",)))
        if tag in _SAME:
            same = opened.last(_SAME[tag])
            if same > opened.last(_FENCE[tag]):
                opened.close(same)
        if tag not in _VOID and not attrs.endswith("/"):
            opened.push(tag, _element(tag, attrs))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


@dataclass
class Features:
    """Of the blocks of many pages in a row: indices and weights into PATH_SLOTS + WORD_SLOTS rows, and numbers."""

    block: np.ndarray
    slot: np.ndarray
    weight: np.ndarray
    numbers: np.ndarray


def features(pages: list[list[Block]]) -> Features:
    flat = [b for p in pages for b in p]
    paths = [_slots_of(b.slots) for b in flat]
    n = len(flat)
    of_path = np.repeat(np.arange(n), [len(p) for p in paths]) if n else np.zeros(0, np.int64)
    words, counts = word_hashes([b.text.lower().encode("utf-8", "surrogatepass") for b in flat])
    of_word = np.repeat(np.arange(n), counts)
    key, times = np.unique(of_word * WORD_SLOTS + (words >> np.uint64(56)).astype(np.int64) % WORD_SLOTS, return_counts=True)
    word_block, word_slot = key // WORD_SLOTS, key % WORD_SLOTS
    strength = np.log1p(times)
    norm = np.sqrt(np.bincount(word_block, strength**2, n))
    sizes = np.array([len(b.text) for b in flat], np.float64)
    place = np.concatenate([(np.arange(len(p)) + 0.5) / len(p) for p in pages if p]) if n else np.zeros(0)
    numbers = np.stack(
        [np.log1p(sizes) / 8, np.log1p(counts) / 6, np.array([b.linked for b in flat], np.float64), place, np.array([b.depth for b in flat], np.float64) / 10, np.array([b.text[-1] in ".!?" for b in flat], np.float64)], 1
    ) if n else np.zeros((0, NUMBERS))
    return Features(
        np.concatenate([of_path, word_block]).astype(np.int64),
        np.concatenate([*paths, word_slot + PATH_SLOTS]).astype(np.int64),
        np.concatenate([np.ones(len(of_path)), strength / np.maximum(norm[word_block], 1e-9)]).astype(np.float32),
        numbers.astype(np.float32),
    )
