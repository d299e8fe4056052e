"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by an incremental UTF-8 state machine.

A split of a byte string into tokens is its BPE encoding just if every token is its own encoding and every two neighbours are the
encoding of their bytes. So each prefix has one last token, found from the last tokens of the prefixes a token's length before.
A state of the transducer is the set of live hypotheses: tokens not yet emitted, and the bytes of a token begun. Reading a byte
moves all hypotheses on; what all of them agree on is emitted, at most a token's length behind. States and moves are made when
first needed, and forgotten when they take more memory than they may, also within a long match. Where a match leaves the states that
there are, what is left of it, if it is short, is read without making any, the first time: most such ends never come again.

The pattern is matched by the library regex, whose Unicode tables may be newer than another library's for a few letters.

Defined results: a null text is an empty one and has no tokens. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import documents, slices
from .pieces import PieceEncoder, Remembered

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes that a Python worker remembers of states, moves, pairs and pieces; less where other stages need the memory too.
MEMORY = 640_000_000
SMALL = 80_000_000
_TAIL = 64  # bytes that are read without making states, at most
_MARKS = frozenset(".,;:!?")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def trie(ranks: dict[bytes, int]) -> dict[int, int]:
    """The prefixes of tokens as edges: node << 8 | byte to node << 21 | (token's id + 1, or 0) << 1 | whether a token goes on. Node 0 is the empty prefix."""
    nodes: dict[int, int] = {}
    ends, inner = {}, {0}
    for x, i in ranks.items():
        node = 0
        for byte in x:
            inner.add(node)
            node = nodes.setdefault(node << 8 | byte, len(nodes) + 1)
        ends[node] = i + 1
    return {k: node << 21 | ends.get(node, 0) << 1 | (node in inner) for k, node in nodes.items()}


class Transducer:
    """memory: bytes that states, moves and pairs may take; when they are used up all are forgotten, also within a match."""

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY // 2):
        self.ranks, self.memory, self.step = ranks, memory, trie(ranks).get
        self.bytes_of = {i: x for x, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.forget()

    def forget(self) -> None:
        start = ((-1, (), 0),)  # hypotheses: last token emitted, tokens pending, node of the token begun; the one with none begun is last
        self.hypotheses, self.number = [start], {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state * 256 + byte: next state, tokens emitted
        self.pairs: dict[int, bool] = {}
        self.met: set[int] = set()  # moves that one match wanted so far
        self.used = 0

    def merge(self, x: bytes, below: int = 1 << 60) -> list[int]:
        """Plain BPE of a short byte string: the pair of least rank is joined, leftmost first, as long as one has a rank less than `below`."""
        parts, get = [x[i : i + 1] for i in range(len(x))], self.ranks.get
        while len(parts) > 1:
            of = [get(p + q, below) for p, q in zip(parts, parts[1:])]
            rank = min(of)
            if rank >= below:
                break
            i = of.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens that merge last into a token; for one that is no merge of its own, the token twice."""
        got = self.halves.get(token)
        if got is None:
            x = self.bytes_of[token]
            if len(x) == 1:
                got = (token, token)
            else:
                parts = self.merge(x, token)
                got = (parts[0], parts[1]) if len(parts) == 2 and self.merge(x) == [token] else (token, token)
            self.halves[token] = got
        return got

    def _is_own(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._halves(token) != (token, token)

    def follows(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of the two tokens' bytes; for a = -1 whether b is its own encoding."""
        key = (a + 1) << 32 | b
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self._is_own(b) and (a < 0 or self._keeps_apart(a, b))
            self.used += 130
        return got

    def _keeps_apart(self, a: int, b: int) -> bool:
        # Undo merges at the boundary, the latest of both sides first. A pair met there would have been joined if its rank
        # comes before that of the merge undone last; on the right side, also at the same rank, as the leftmost goes first.
        ranks, bytes_of, limit = self.ranks, self.bytes_of, 1 << 60
        while True:
            if ranks.get(bytes_of[a] + bytes_of[b], 1 << 61) < limit:
                return False
            left, right = self._halves(a)[1], self._halves(b)[0]
            if left == a and right == b:
                return True
            if right == b or (left != a and a > b):
                limit, a = a, left
            else:
                limit, b = b + 1, right

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, done, said, step, known = [], None, (), self.step, self.pairs.get
        for last, pending, begun in self.hypotheses[state]:
            at = step(begun << 8 | byte)
            if at is None:
                continue
            if at & 1:
                live.append((last, pending, at >> 21))
            if done is None and at & 0x1FFFFE:
                token, before = (at >> 1 & 0xFFFFF) - 1, pending[-1] if pending else last
                fits = known((before + 1) << 32 | token)
                if self.follows(before, token) if fits is None else fits:
                    done = (last, (*pending, token), 0)  # the prefix read so far has one last token
        live.append(done)
        one = live[0][1]
        if one:  # else nothing is agreed: the longest hypothesis has no token yet
            agreed = len(one) if len(live) == 1 else 0
            for ids in zip(*[p for _, p, _ in live] if not agreed else ()):
                if ids.count(ids[0]) != len(ids):
                    break
                agreed += 1
            if agreed:
                said = one[:agreed]
                live = [(said[-1], p[agreed:], b) for _, p, b in live]
        key = tuple(live)
        if self.used > self.memory:
            self.forget()
            state = -1  # its number is no more
        to = self.number.setdefault(key, len(self.hypotheses))
        if to == len(self.hypotheses):
            self.hypotheses.append(key)
            self.used += 250 + 150 * len(key)
        out = (to, said)
        if state >= 0:
            self.moves[state << 8 | byte] = out
            self.used += 220
        return out

    def _tail(self, state: int, x: bytes) -> tuple[int, ...]:
        """The tokens that a match has from a state on, read by its hypotheses themselves."""
        live, step, known = self.hypotheses[state], self.step, self.pairs.get
        for byte in x:
            now, done = [], None
            for h in live:
                last, pending, begun = h
                at = step(begun << 8 | byte)
                if at is None:
                    continue
                if at & 1:
                    now.append((last, pending, at >> 21))
                if done is None and at & 0x1FFFFE:
                    token, before = (at >> 1 & 0xFFFFF) - 1, pending[-1] if pending else last
                    fits = known((before + 1) << 32 | token)
                    if self.follows(before, token) if fits is None else fits:
                        done = (last, (*pending, token), 0)
            now.append(done)
            live = now
        return live[-1][1]

    def encode(self, x: bytes) -> list[int]:
        """Of one match of the pattern; a match that is a token is that token."""
        whole = self.ranks.get(x)
        if whole is not None:
            return [whole]
        out, state, left = [], 0, len(x)
        for byte in x:
            left -= 1
            key = state << 8 | byte
            got = self.moves.get(key)
            if got is None:
                if left < _TAIL and key not in self.met:
                    self.met.add(key)
                    self.used += 90
                    out += self._tail(state, x[len(x) - left - 1 :])
                    return out
                got = self._move(state, byte)
            state, said = got
            if said:
                out += said
        out += self.hypotheses[state][-1][1]
        return out


def _utf8_moves() -> list[list[int]]:
    """State by state and byte: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 after E0, ED, F0, F4; -1 no UTF-8."""
    moves = [[-1] * 256 for _ in range(8)]
    for lo, hi, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        moves[0][lo : hi + 1] = [to] * (hi - lo + 1)
    for state, lo, hi, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        moves[state][lo : hi + 1] = [to] * (hi - lo + 1)
    return moves


class Decoder:
    """Streaming decoder: feed() takes ids and gives the bytes of whole characters; the rest waits. close() gives what was left.

    Bytes that can't be UTF-8 are given as they are, and the machine starts again. What a token does in a state is remembered.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.table = bytes_of, _utf8_moves()
        self.done: dict[tuple[int, int], tuple[int, int]] = {}  # (state, id) -> (state, bytes at the end that wait; -1: all)
        self.plain = np.zeros(max(bytes_of, default=0) + 1, bool)  # ids that go from state 0 to state 0
        for i in bytes_of:
            self.plain[i] = self._run(0, i) == (0, 0)
        self.state, self.waits = 0, b""

    def _run(self, state: int, token: int) -> tuple[int, int]:
        x, end = self.bytes_of[token], -1  # end: bytes of this token that belong to finished characters; -1: none
        for k, byte in enumerate(x):
            state = self.table[state][byte]
            if state < 0:
                state = 0
            if state == 0:
                end = k + 1
        return state, (len(x) - end if end >= 0 else -1)

    def feed(self, ids: np.ndarray) -> bytes:
        if not self.state and self.plain[ids].all():
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        out, done = [], self.done
        for i in ids.tolist():
            key = (self.state, i)
            got = done.get(key)
            if got is None:
                if len(done) > 20_000:
                    done.clear()
                got = done[key] = self._run(*key)
            self.state, left = got
            x = self.bytes_of[i]
            if left < 0:
                self.waits += x
            elif left:
                out.append(self.waits + x[:-left])
                self.waits = x[-left:]
            else:
                out.append(self.waits + x)
                self.waits = b""
        return b"".join(out)

    def close(self) -> bytes:
        out, self.state, self.waits = self.waits, 0, b""
        return out


class Codec:
    """Encoder and decoder for one vocabulary file; a Python worker keeps one. memory: bytes of what is remembered, about."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.transducer = Transducer(read_ranks(path), memory // 2)
        encode, find = self.transducer.encode, regex.compile(public_tokenizers.PATTERN).findall
        matches = Remembered(memory // 5)

        def fresh(m: str) -> bytes:
            ids = encode(m.encode())
            return struct.pack(f"<{len(ids)}I", *ids)

        def split(x: str) -> list[str]:
            """Matches of the pattern; a word, and a word and a mark, are told without it."""
            word = x[1:]
            if x[:1] == " " and word:
                if word.isalpha():
                    return [x]
                if word[-1] in _MARKS and word[:-1].isalpha():
                    return [x[:-1], word[-1]]
            return find(x)

        def pieces(xs: list[str]) -> list[bytes]:
            cut = list(map(split, xs))
            distinct = list(dict.fromkeys(m for ms in cut for m in ms))
            got = dict(zip(distinct, matches.get(distinct)))
            other = [m for m, y in got.items() if y is None]
            got.update((m, y or fresh(m)) for m, y in zip(other, self.pieces.known.get(other)))
            # A piece that is one match is remembered by the piece encoder.
            for m in {m for ms in cut if len(ms) > 1 for m in ms}:
                matches.put(m, got[m])
            return [b"".join([got[m] for m in ms]) for ms in cut]

        self.pieces = PieceEncoder(pieces, "<u4", 3 * memory // 10)
        self.matches, self.decoder = matches, Decoder(self.transducer.bytes_of)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each end."""
        return self.pieces.encode(texts)

    def forget(self) -> None:
        """Gives back the memory of all that was remembered."""
        self.transducer.forget(), self.matches.clear(), self.pieces.known.clear(), self.decoder.done.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.decoder.feed(ids[i : i + 65536]) for i in range(0, len(ids), 65536)]) + self.decoder.close()


@lru_cache(1)
def codec(path: str, memory: int = MEMORY) -> Codec:
    return Codec(path, memory)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.view("<i4")))


def _by_text(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [flat[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with a last column ids array<int>."""
    names = docs.columns

    def run(batches):
        c = codec(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(*c.encode(b.column(names.index("text"))))], names=[*names, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with a last column decoded binary, from ids array<int>."""
    names = rows.columns

    def run(batches):
        c = codec(path)
        for b in batches:
            out = [c.decode(np.asarray(x or [], "<u4")) for x in b.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("decoded", BinaryType()))


def _digested(c: Codec, flat: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """n_tokens, ids_sha256, decoded_sha256 of each text."""
    texts = _by_text(flat, ends)
    return [pa.array(np.diff(ends, prepend=0), pa.int64()), *(pa.array([sha256(f(x)).hexdigest() for x in texts], pa.string()) for f in (np.ndarray.tobytes, c.decode))]


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what the ids decode to; the ids stay within the task."""

    def run(batches):
        c = codec(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *_digested(c, *c.encode(b.column(1)))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {_DIGESTS}")


def tokens(docs: DataFrame, path: str, memory: int = SMALL) -> DataFrame:
    """doc_id, lang, source, ids array<int>, n_tokens and both digests of each row of docs. memory: see Codec."""
    names = ["doc_id", "lang", "source"]

    def run(batches):
        c = codec(path, memory)
        for b in slices(batches):
            flat, ends = c.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), _lists(flat, ends), *_digested(c, flat, ends)], names=[*names, "ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return docs.select(*names, "text").mapInArrow(run, f"doc_id long, lang string, source string, ids array<int>, {_DIGESTS}")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
