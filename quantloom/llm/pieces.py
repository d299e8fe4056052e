"""Texts cut at single spaces between two characters that aren't white space.

No match of the byte-level pattern goes over such a cut: in every alternative white space stands only first, or all is white
space. So each piece, with its space in front, is encoded by itself. Nor does one go from a letter to a mark behind it, or over a
single newline between two characters that aren't white space, so on demand texts are cut there too, and words are known again
whatever stands behind them. The bytes of a run of texts are cut all at once, each distinct piece is looked up once, all new ones
are encoded together, and the texts' ids are gathered from those of the pieces. Where a text has other white space next to a space
or newline, it isn't cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 64  # characters of a piece that is still remembered
_ENTRY = 220  # bytes that a remembered piece takes, about
MARKS = ".,!?;:#$%&*"  # no letter, digit or white space; an apostrophe may begin a match with letters
_LETTER, _MARK, _WHITE, _SPACE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*MARKS.encode()]] = _MARK
_CLASS[[*range(9, 14), *range(28, 32)]] = _WHITE
_CLASS[32] = _SPACE
_CLASS[[*range(0xC3, 0xC9), 0xD0, 0xD1]] = _LETTER  # first bytes of Latin and Cyrillic letters of two bytes
_WIDE = [int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]  # white space of three bytes


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


def begins(data: np.ndarray, first: np.ndarray, last: np.ndarray, marks: bool = False) -> np.ndarray:
    """Where the pieces of texts begin. data: the texts' bytes; first, last: where those begin that aren't empty, and their last bytes."""
    kind = _CLASS[data]
    two = np.flatnonzero((data >= 0xC3) & (kind == _LETTER))
    signs = two[(data[two] == 0xC3) & ((data[two + 1] == 0x97) | (data[two + 1] == 0xB7))]  # multiplied and divided by
    kind[two + 1] = _LETTER
    kind[signs] = kind[signs + 1] = 0
    for n, lead, values in ((2, data == 0xC2, [0xC285, 0xC2A0]), (3, (data >= 0xE1) & (data <= 0xE3), _WIDE)):
        at = np.flatnonzero(lead)
        at = at[np.isin(sum(data[at + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n)), values)]
        for k in range(n):
            kind[at + k] = _WHITE
    cut, ink = np.zeros(len(data), bool), kind < _WHITE
    between = ink[:-2] & ink[2:]
    cut[1:-1] = (kind[1:-1] == _SPACE) & between
    cut[last] = False
    if marks:
        line = np.zeros(len(data), bool)
        line[1:-1] = (data[1:-1] == 10) & between
        line[first] = line[last] = False
        cut |= line
        cut[1:] |= line[:-1] | (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
    cut[first] = True
    return np.flatnonzero(cut)


def cut(texts: pa.Array, spaced: bool = False, marks: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts (no nulls), and where those of each text begin and end among them. spaced: a space is put before each text."""
    texts = texts.cast(pa.large_string())
    if spaced:
        texts = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, at = np.frombuffer(raw or b"", np.uint8)[at[0] : at[-1]], at - at[0]
    some = at[1:] > at[:-1]
    places = begins(data, at[:-1][some], at[1:][some] - 1, marks)
    pieces = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(data))), pa.py_buffer(data))
    return pieces, np.searchsorted(places, at)


class Remembered:
    """A dictionary of pieces in two generations: when the young one has taken half of `most` bytes, the old one is forgotten."""

    def __init__(self, most: int, entry: int = _ENTRY):
        self.entry, self.half, self.young, self.old, self.used = entry, most // 2, {}, {}, 0

    def get(self, xs: list[str]) -> list:
        got = list(map(self.young.get, xs))
        if self.old:
            lost = [i for i, y in enumerate(got) if y is None]
            back = [(i, y) for i, y in zip(lost, map(self.old.get, map(xs.__getitem__, lost))) if y is not None]
            for i, y in back:
                got[i] = y
            self.put_all([xs[i] for i, _ in back], [y for _, y in back])
        return got

    def put(self, x: str, y: bytes) -> None:
        self.put_all([x], [y])

    def put_all(self, xs: list[str], ys: list[bytes]) -> None:
        for i in range(0, len(xs), 4096):
            if self.used > self.half:
                self.old, self.young, self.used = self.young, {}, 0
            some = {x: y for x, y in zip(xs[i : i + 4096], ys[i : i + 4096]) if len(x) <= LONG}
            self.young.update(some)
            self.used += self.entry * len(some) + sum(map(len, some.values()))

    def clear(self) -> None:
        self.young, self.old, self.used = {}, {}, 0


class PieceEncoder:
    """encode(texts): the ids of texts, by what `encode_pieces` gives for lists of pieces, as bytes of ids of type `dtype`.
    marks: texts are also cut at marks and newlines; entry: bytes that a remembered piece takes, about."""

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], dtype: str, most: int, marks: bool = False, entry: int = _ENTRY):
        self.encode_pieces, self.dtype, self.known, self.marks = encode_pieces, np.dtype(dtype), Remembered(most, entry), marks

    def encode(self, texts: pa.Array, end: bytes = b"", spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text end. end: what follows each text's ids; spaced: a space is put before each text."""
        code, at, got = self.coded(texts, spaced)
        if end:
            code, at = np.insert(code, at[1:], len(got)), at + np.arange(len(at))
            got.append(end)
        out = pa.array(got, pa.large_binary()).take(pa.array(code))
        _, upto, raw = out.buffers()
        upto = np.frombuffer(upto, np.int64, len(out) + 1) // self.dtype.itemsize if len(out) else np.zeros(1, np.int64)
        return np.frombuffer(raw or b"", self.dtype, int(upto[-1])), upto[at[1:]]

    def coded(self, texts: pa.Array, spaced: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each piece of the texts the place of its ids in a list, where each text begins and ends among the pieces, and that list."""
        pieces, at = cut(pc.fill_null(texts, ""), spaced, self.marks)
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        got = self.known.get(distinct)
        lost = [i for i, y in enumerate(got) if y is None]
        if lost:
            new = [distinct[i] for i in lost]
            made = self.encode_pieces(new)
            self.known.put_all(new, made)
            for i, y in zip(lost, made):
                got[i] = y
        return pieces.indices.to_numpy().astype(np.int64), at, got


def merge(text: str) -> list[str]:
    """The pieces of a text."""
    return cut(pa.array([text]))[0].to_pylist()
