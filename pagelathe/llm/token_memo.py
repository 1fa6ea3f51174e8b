"""Whole texts to token ids by the tokenizers library, with a memo of the pieces that words repeat.

Byte-pair merges never cross the pieces that a tokenizer's pre-tokenizer cuts. A text may therefore be cut
wherever the pre-tokenizer always cuts, each distinct piece be encoded once by the library, and the ids be
joined; the result is that of encoding the whole text (tests/llm/test_tokens.py compares them). New pieces are
encoded many in a row where their ids tell where each piece ends, which spares the library a call a piece. Special
tokens that stand in a text are encoded as the library does by default.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The memo is emptied beyond so many pieces or characters. This bounds a worker's memory, not the result.
MOST_PIECES, MOST_CHARS_A_PIECE = 1_200_000, 25

_SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: White space other than a single blank or line feed, in Python's wide sense.
_RARE_SPACE = "[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A text without this has each of its blanks between two characters that are not white space.
_ODD_BLANKS = f"  | \n|\n |^ | $|{_RARE_SPACE}"
_SEVERAL = 1024


def _before_blank(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts, cut before each blank that stands between two other characters, and how many each text has."""
    odd = pc.match_substring_regex(texts, _ODD_BLANKS).to_numpy(zero_copy_only=False)
    if not odd.any():
        return _split(texts)
    plain, n_plain = _split(texts.filter(pa.array(~odd)))
    rest = [_SPACE_BETWEEN.split(x) for x in texts.filter(pa.array(odd)).to_pylist()]
    n = np.zeros(len(texts), np.int64)
    n[~odd], n[odd] = n_plain, [len(x) for x in rest]
    from_odd = np.repeat(odd, n)
    order = np.zeros(len(from_odd), np.int64)
    order[~from_odd] = np.arange(len(plain))
    order[from_odd] = len(plain) + np.arange(from_odd.sum())
    return pa.concat_arrays([plain, pa.array(list(chain.from_iterable(rest)), pa.large_string())]).take(pa.array(order)), n


def _at_blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return _split(pc.replace_substring(texts, "\n", " "))


def _whole(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return texts, np.ones(len(texts), np.int64)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


class _Memo(dict):
    """Piece to number; a piece not yet known gets the next number and is remembered as fresh."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, piece: str | tuple) -> int:
        k = self[piece] = len(self)
        self.fresh.append(piece)
        return k


class _BlankFirst:
    """Byte-level pieces, each after its blank: in a row of them, an id that begins with a blank begins a piece."""

    fits = re.compile(r"[^\s<]+(?:\n[^\s<]+)*").fullmatch

    @staticmethod
    def flags(token: str) -> bool:
        return token.startswith("\u0120")

    @staticmethod
    def joined(pieces: list[str]) -> str:
        return " " + " ".join(pieces)

    @staticmethod
    def ends(pieces: list[str], flagged: np.ndarray, total: int) -> np.ndarray | None:
        return np.append(flagged[1:], total) if len(flagged) == len(pieces) and not flagged[0] else None


class _WordEnds:
    """Latin words with or without marks after them: in a row of them, each word and each run of marks ends with its id."""

    fits = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,;:!?)]*").fullmatch

    @staticmethod
    def flags(token: str) -> bool:
        return token.endswith("</w>")

    @staticmethod
    def joined(pieces: list[str]) -> str:
        return " ".join(pieces)

    @staticmethod
    def ends(pieces: list[str], flagged: np.ndarray, total: int) -> np.ndarray | None:
        parts = np.cumsum([1 if p[-1].isalpha() else 2 for p in pieces])
        return flagged[parts - 1] + 1 if len(flagged) == parts[-1] else None


class TokenMemo:
    """Encodes batches of texts to one flat array of ids and the number of ids of each text."""

    def __init__(self, path: str, most_pieces: int = MOST_PIECES) -> None:
        from tokenizers import Tokenizer

        self.most_pieces, self.most_chars = most_pieces, most_pieces * MOST_CHARS_A_PIECE
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut, self.lead, self.rows = self._safe_cut(spec)
        if self.rows:
            self.flagged = np.zeros(self.vocabulary, np.bool_)
            self.flagged[[k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if self.rows.flags(token)]] = True
        self._reset()

    @staticmethod
    def _safe_cut(spec: dict):
        """The finest cut known to be safe, what its later pieces begin with, and how rows of pieces are encoded at once.

        Special tokens hold no white space, so a cut never parts one.
        """
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            return _whole, "", None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            return _before_blank, " ", _BlankFirst
        parts = pre.get("pretokenizers") or []
        drops_space = parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in (parts[0].get("pattern") or {}).get("Regex", "")
        kinds = {x.get("type") for x in (norm or {}).get("normalizers", [])}
        if drops_space and kinds <= {"NFC", "Replace", "Lowercase"}:
            return _at_blanks, "", _WordEnds if spec["model"].get("end_of_word_suffix") == "</w>" else None
        return _whole, "", None

    def _reset(self) -> None:
        self.memo, self.chars, self.used = _Memo(), 0, 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _grown(array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        out = np.zeros(max(need, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def _keep(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Store the ids of the pieces numbered at, one after the other."""
        self.pool = self._grown(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[at], self.counts[at] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)

    def _learn_row(self, pieces: list[str], at: np.ndarray) -> bool:
        """Encode pieces in a row; False if the ids do not tell the pieces apart."""
        ids = np.array(self.tokenizer.encode_batch_fast([self.rows.joined(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = self.rows.ends(pieces, np.flatnonzero(self.flagged[ids]), len(ids))
        if ends is not None:
            self._keep(at, ids, np.diff(ends, prepend=0))
        return ends is not None

    def _learn(self) -> None:
        fresh, known = self.memo.fresh, len(self.memo) - len(self.memo.fresh)
        self.starts, self.counts = (self._grown(x, known + len(fresh)) for x in (self.starts, self.counts))
        for a in range(0, len(fresh), _SEVERAL):
            some = fresh[a : a + _SEVERAL]
            in_row = [k for k, p in enumerate(some) if self.rows and type(p) is str and self.rows.fits(p)]
            row = [some[k] for k in in_row]
            self.chars += sum(len(p[0]) if type(p) is tuple else len(p) for p in some)
            if row and self._learn_row(row, np.array(in_row) + known + a):
                done = set(in_row)
                alone = [k for k in range(len(some)) if k not in done]
            else:
                alone = list(range(len(some)))
            if alone:
                texts = [p[0] if type(p) is tuple else self.lead + p for p in (some[k] for k in alone)]
                found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                self._keep(np.array(alone) + known + a, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts)
        fresh.clear()

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cutting and telling equal pieces apart is done by Arrow; only pieces distinct in this call become strings."""
        if len(self.memo) > self.most_pieces or self.chars > self.most_chars:
            self._reset()
        pa.default_memory_pool().release_unused()
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(array):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces, n = self.cut(pc.fill_null(array.cast(pa.large_string()), ""))
        get = self.memo.__getitem__
        heads = np.cumsum(n) - n
        coded = pieces.dictionary_encode()
        local = coded.indices.to_numpy().astype(np.int64)
        numbers = np.zeros(len(local), np.int64)
        if self.lead:
            # a text's first piece has no blank before it, and is a piece of its own kind
            later = np.ones(len(local), np.bool_)
            later[heads] = False
            seen = np.zeros(len(coded.dictionary), np.bool_)
            seen[local[later]] = True
            wanted = np.flatnonzero(seen)
            table = np.zeros(len(coded.dictionary), np.int64)
            table[wanted] = np.fromiter(map(get, coded.dictionary.take(pa.array(wanted)).to_pylist()), np.int64, len(wanted))
            numbers = table[local]
            numbers[heads] = [get((x,)) for x in pieces.take(pa.array(heads)).to_pylist()]
        else:
            numbers = np.fromiter(map(get, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[local]
        self._learn()
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        where = np.repeat(self.starts[numbers] - (ends - counts), counts)
        where += np.arange(len(where))
        upto = np.concatenate([[0], ends])
        return self.pool[where], np.diff(upto[np.cumsum(n)], prepend=0)


_memos: dict[tuple[str, int], TokenMemo] = {}


def memo_of(path: str, most_pieces: int = MOST_PIECES) -> TokenMemo:
    """The worker's own memo for a tokenizer's file; reused from task to task."""
    if (path, most_pieces) not in _memos:
        _memos[path, most_pieces] = TokenMemo(path, most_pieces)
    return _memos[path, most_pieces]


def slices(texts: list[str | None], most_chars: int = 2_000_000):
    """Ranges of texts that hold about so many characters: bounds what one encode() call holds."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= most_chars:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
