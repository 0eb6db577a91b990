"""Whole-text encoding through a tokenizer library, with each distinct piece of text encoded once.

Both BPE vocabularies break every text in front of a run of blanks and newlines, and between a letter or digit and an
ASCII punctuation mark other than the apostrophe, so the ids of a text are the ids of the pieces between such places.
Texts holding any other white space, or what may be a special token, are encoded in one piece.  Pieces are looked up in
a bounded table; only new ones go to the library: those of Latin letters alone, which no rule splits further, straight to
its BPE model, all others through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textprep import LOWER, gather_ranges, raw, release_unused, strings

_LONG = 64
_ID = attrgetter("id")
_WORD = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_BREAK, _MARK, _PLAIN, _ODD = 1, 2, 4, 8
_LOWERED = LOWER.tobytes()
_KINDS = bytes(
    _BREAK * (b in (10, 32)) | _MARK * (33 <= b <= 126 and not chr(b).isalnum() and b != 39) | _PLAIN * (b < 128 and chr(b).isalnum()) | _ODD * (b in (9, 11, 12, 13, 28, 29, 30, 31, 0xE1))
    for b in range(256)
)


def byte_characters() -> list[str]:
    """The character that byte-level BPE writes for each byte: itself if it shows, else the next one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _listed(column: pa.Array) -> list[str]:
    """``to_pylist`` of strings without nulls, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """``encode(column)`` gives the ids of all rows in one array, and the offsets of each row in it."""

    def __init__(self, path: str, max_pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)["normalizer"] or {}
        self.lower = any(x["type"] == "Lowercase" for x in parts.get("normalizers", [parts] if parts else []))
        # no other normalizer or post-processor may touch a word for the direct way
        self.direct = all(x["type"] in ("NFC", "Lowercase", "Replace") for x in parts.get("normalizers", []))
        chars = byte_characters()
        self.written = {c: c for c in range(128)} | {32: chars[32]} | {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        # lower-casing vocabularies drop what is blank in front of a word
        self.word = ("^[ \n]*" if self.lower else "^ ?") + _WORD
        self.max_pieces = max_pieces
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.again = np.zeros(1 << 14, bool)

    def shrink(self) -> None:
        """Keep only the pieces that were met again in a later call; none if those are over half of the table."""
        kept = {p: row for p, row in self.known.items() if self.again[row]}
        pool, at, length = self.pool, self.at, self.length
        self.clear()
        if 0 < len(kept) <= self.max_pieces // 2:
            rows = np.fromiter(kept.values(), np.int64, len(kept))
            index, offs = gather_ranges(at[rows], length[rows])
            self._append(pool[index], length[rows])
            self.known = dict(zip(kept, range(len(kept))))

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ``pieces`` with the plain words first, and in that order their ids and the number of each."""
        word = pc.match_substring_regex(pieces, self.word).to_numpy(zero_copy_only=False) if self.direct else np.zeros(len(pieces), bool)
        words, others = pieces.filter(pa.array(word)), pieces.filter(pa.array(~word))
        if self.lower:
            words = pc.utf8_lower(pc.utf8_ltrim(words, " \n"))
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        written = np.empty(len(words), object)
        written[plain] = pc.replace_substring(words.filter(pa.array(plain)), " ", self.written[32]).to_numpy(zero_copy_only=False)
        if not plain.all():  # no word holds a newline now
            written[~plain] = "\n".join(_listed(words.filter(pa.array(~plain)))).translate(self.written).split("\n")
        words, tokenize, ids, length = written.tolist(), self.tokenizer.model.tokenize, array("I"), array("I")
        for i in range(0, len(words), 64):  # tokens are freed with their few words: kept ones cost more than they save
            tokens = list(map(tokenize, words[i : i + 64]))
            length.extend(map(len, tokens))
            ids.extend(map(_ID, chain.from_iterable(tokens)))
        for e in self.tokenizer.encode_batch_fast(_listed(others), add_special_tokens=False):
            tokens = e.ids
            ids.extend(tokens)
            length.append(len(tokens))
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        return order, np.array(ids, np.uint32), np.array(length, np.int64)

    def _add(self, pieces: pa.Array) -> np.ndarray:
        """Rows of the table for new pieces; ids past ``max_pieces`` are dropped with the next ``clear``."""
        order, flat, length = self._ids(pieces)
        out = np.empty(len(length), np.int64)
        out[order] = self._append(flat, length)
        return out

    def _find(self, pieces: list[str]) -> np.ndarray:
        """Rows of the table, or -1."""
        rows = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.again[rows[rows >= 0]] = True
        return rows

    def _append(self, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        total, n = len(flat), len(length)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.rows + n > len(self.at):
            self.at, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.again))
        self.pool[self.used : self.used + total] = flat
        rows = np.arange(self.rows, self.rows + n)
        self.length[rows] = length
        self.at[rows] = self.used + np.cumsum(length) - length
        self.again[rows] = False
        self.used, self.rows = self.used + total, self.rows + n
        return rows

    def _pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, start places of the pieces, and the first piece of each row."""
        n = len(buf)
        kinds = np.frombuffer(buf.tobytes().translate(_KINDS), np.uint8)
        blank = (kinds & _BREAK).view(bool)
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        odd = kinds >= _ODD
        if n > 1:
            letter = (kinds & _PLAIN).astype(bool)
            letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            begin[1:] |= (kinds[1:] & _MARK).astype(bool) & letter[:-1]
            odd[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)
            odd[:-1] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0))
            odd[:-1] |= (buf[:-1] == 0xE2) & ((buf[1:] == 0x80) | (buf[1:] == 0x81))
            odd[:-1] |= (buf[:-1] == 0xE3) & (buf[1:] == 0x80)
        code = np.frombuffer(bytearray(buf).translate(_LOWERED), np.uint8) if self.lower else buf
        for row in np.unique(np.searchsorted(offs, np.flatnonzero(odd), "right") - 1):
            begin[offs[row] : offs[row + 1]] = False
            if self.lower:
                code[offs[row] : offs[row + 1]] = buf[offs[row] : offs[row + 1]]
        begin[offs[:-1][offs[:-1] < offs[1:]]] = True
        start = np.flatnonzero(begin)
        return code, start, np.searchsorted(start, offs)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, offs = raw(column)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        code, start, first = self._pieces(buf, offs)
        coded = strings(code, np.diff(start, append=len(buf))).dictionary_encode()
        pieces = _listed(coded.dictionary)
        rows = self._find(pieces)
        if len(self.known) + np.count_nonzero(rows < 0) > self.max_pieces:
            self.shrink()
            rows = self._find(pieces)
            if len(self.known) + np.count_nonzero(rows < 0) > self.max_pieces:
                self.clear()
                rows = self._find(pieces)
        mark = self.rows, self.used
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._add(coded.dictionary.take(pa.array(new)))
            short = new[pc.utf8_length(coded.dictionary).to_numpy()[new] <= _LONG]
            self.known.update(zip([pieces[i] for i in short.tolist()], rows[short].tolist()))
        which = rows[coded.indices.to_numpy(zero_copy_only=False)]
        index, at = gather_ranges(self.at[which], self.length[which])
        out = self.pool[index], at[first]
        if self.used > 40 * self.max_pieces or len(new) and self.used - mark[1] > 8 * self.max_pieces:
            self.clear()
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, max_pieces: int = 400_000) -> PieceEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].max_pieces = max_pieces
    return _ENCODERS[path]


def forget() -> None:
    """Free the encoders of a worker that has gone on to another operator."""
    if _ENCODERS:
        _ENCODERS.clear()
        release_unused()


def vocabulary(name: str) -> str:
    """The installed file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)
