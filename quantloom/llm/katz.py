"""Language-model scoring: Katz backoff over word bigrams.

Tokens are words, lower-cased A-Z, and one end token per text, which is also the history of the first word. Bigram counts up to
`cutoff` are Good-Turing discounted; what the discount frees goes by an exact backoff weight of the history to the tokens not seen
after it, in proportion to their unigram probability. Unigram counts are discounted alike, and what that frees is the probability
of all unseen tokens together. So the probabilities of all tokens after a history, the unseen ones as one token, sum to one.
log10 P(w | h) is that of the discounted bigram if it was seen, else of the backoff weight times P(w), evaluated token by token.

All words have their own bigrams. The `head` most frequent tokens are known to every task, with short codes and counts: a bounded
short cut. Texts are read twice: for the counts of tokens, and for their events, a history and a word in a text. Events go, packed
by runs of texts, to parts of the n-gram tables, where counts are those of all events that met:

* history and word of the head: by history, in as many parts as its count asks for;
* the word not of the head: by word, so that the word's own count is there too;
* the history not of the head: by history, so that its backoff weight is there; of such events those with a word not of the head
  come from the word's part and bring its count along.

A bigram that stands in many texts of a run is sent once for the run, and the run keeps the list of texts; so what meets in a part
grows with the number of runs at most. Once the counts of counts of all parts are known, each part gives its texts their sums.

Defined results: a null text is an empty one and consists of the end token. With no training documents N and V are 0, and every
token is unseen. A row with a null doc_id is scored, not learned from, and held_out is false for it. Repeated rows give repeated
results. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, documents, fold, give_back, materialise, mix64

END = np.int64(np.uint64(xxh64_intdigest(b"\n")).astype(np.int64))  # no word has a line end
_AT_ONCE = 2_000_000  # tokens counted at a time in a task
_ROW = 20_000  # events to a row of a table, about
_GROUPS = 8 << 20
_HEAD, _WORD, _HISTORY, _RUN = range(4)  # what the rows of the tables hold; see the module


@dataclass(frozen=True)
class KatzParams:
    head: int = 65_535  # tokens that every task knows; their codes have two bytes
    cutoff: int = 5
    run_tokens: int = 1_000_000  # of texts whose events are sent together
    part_tokens: int = 500_000  # events that are expected in a part of the tables
    often: int = 64  # texts of a run: a bigram that stands in as many is sent once


def hashes(text: str | None) -> np.ndarray:
    """Of the tokens of a text, the end token last."""
    words = (text or "").encode().translate(LOWER).split()
    h = np.empty(len(words) + 1, np.int64)
    h[:-1] = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    h[-1] = END
    return h


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discount ratios of counts 0..k from the counts of counts n[1..k+1]. Where those are too thin for it, absolute discounting."""
    k = len(n) - 2
    d = np.ones(k + 1)
    last = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last < 1 else -1.0
        if not 0 < x < 1:
            off = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            x = 1 - min(0.9, off) / r
        d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


def backoff(c: np.ndarray, left: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histories with c events, `left` of them after discounts, and probability `seen` of the words met: log10 of the denominator and of the weight."""
    more = 1.0 - seen
    whole = more < 1e-9  # all words were seen after it: discounted counts alone, normalised
    # Without discounted counts, one is added for what wasn't seen.
    n = np.where(whole, np.maximum(left, 1e-300), np.where(c > left, c, c + 1.0))
    weight = np.where(whole, 1.0, (1 - left / n) / np.where(whole, 1.0, more))
    return np.where(c > 0, np.log10(np.where(c > 0, n, 1.0)), 0.0), np.where(c > 0, np.log10(np.where(c > 0, weight, 1.0)), 0.0)


class Unigrams:
    """What all tasks know: the head tokens by hash with their counts, and the probabilities of counts."""

    def __init__(self, hash_: np.ndarray, count: np.ndarray, events: np.ndarray, total: int, vocabulary: int, counts_of: np.ndarray, all_events: int, p: KatzParams):
        order = np.argsort(hash_)
        self.hash, self.c = hash_[order], count[order]
        self.total, self.smooth = total, total + vocabulary + 1
        self.d = discounts(counts_of)
        freed = float(sum((1 - self.d[r]) * r * counts_of[r] for r in range(1, len(self.d))))
        # Without counts that are discounted, one token is added for the unseen.
        self.unseen, self.norm = freed or 1.0, total + (0 if freed else 1)
        self.parts = max(1, -(-all_events // p.part_tokens))
        # Of events by a word, or a history, beyond the head. Each part of words sends to each of histories, so these are no more than their events need.
        self.tail_parts = max(1, -(-2 * (all_events - int(events.sum())) // p.part_tokens))
        self.split = 1 + 4 * events[order] // p.part_tokens

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Codes of tokens, -1 beyond the head."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def p(self, c: np.ndarray) -> np.ndarray:
        """The probability of a token by its count; that of all unseen ones together for 0."""
        return np.where(c > 0, discounted(c, self.d), self.unseen) / self.norm

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / self.smooth)


def _counted(batches):
    """Distinct tokens of runs of many texts: counts in training texts (c), and in all (n)."""
    held, n = ([], []), 0

    def out():
        for learn, some in enumerate(held):
            if some:
                h, c = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c * learn), pa.array(c)], names=["h", "c", "n"])

    for b in batches:
        for x, learn in zip(b.column("text").to_pylist(), b.column("learn").to_pylist()):
            held[learn].append(hashes(x))
            n += len(held[learn][-1])
            if n >= _AT_ONCE:
                yield from out()
                held, n = ([], []), 0
    yield from out()


def fit_unigrams(docs: DataFrame, p: KatzParams) -> Unigrams:
    """docs: text, learn."""
    rows = docs.select("text", "learn").mapInArrow(_counted, "h long, c long, n long")
    tokens = materialise(rows.groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in ("c", "n")] + [F.count_if(F.col("c") > 0)]
    total, events, vocabulary, *of = tokens.agg(*sums, *(F.count_if(F.col("c") == r) for r in range(1, p.cutoff + 2))).first()
    # Tokens by count: counts below 1024 by themselves, larger ones by 64 steps to an octave.
    n = F.col("n")
    step = F.when(n < 1024, n).otherwise(F.ceil(F.pow(F.lit(2.0), F.floor(F.log2(n) * 64) / 64)).cast("long")).alias("n")
    rows_to = 0
    least = 1 << 62
    for k, many in sorted(((r[0], r[1]) for r in tokens.groupBy(step).count().collect()), reverse=True):
        rows_to += many
        if rows_to > p.head:
            break
        least = k
    head = tokens.where(n >= least).toArrow()
    return Unigrams(*(head[x].to_numpy() for x in ("h", "c", "n")), total, vocabulary, np.array([0, *of]), events, p)


def _mixed(h: np.ndarray) -> np.ndarray:
    return mix64(h.view(np.uint64))


def _share(m: np.ndarray, parts: int) -> np.ndarray:
    """Parts of mixed hashes, in their order."""
    return ((m >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_BIGRAM = np.dtype([("h", "<u2"), ("w", "<u2")])


def _packed(*cols: np.ndarray) -> bytes:
    """Columns of one length: the length of each in bytes, then all."""
    return np.array([c.nbytes for c in cols], "<i8").tobytes() + b"".join([c.tobytes() for c in cols])


def _columns(x: bytes | pa.Buffer, *kinds: str) -> list[np.ndarray]:
    size = np.frombuffer(x, "<i8", len(kinds))
    at = 8 * len(kinds) + np.cumsum(size) - size
    return [np.frombuffer(x, k, n // np.dtype(k).itemsize, a) for k, n, a in zip(kinds, size.tolist(), at.tolist())]


def _ranges(part: np.ndarray):
    """(part, slice) of equal neighbours."""
    cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
    return [(int(part[i]), slice(i, j)) for i, j in zip([0, *cuts], [*cuts, len(part)])] if len(part) else []


_EVENTS = "what int, part long, run long, learn boolean, data binary"
_SENT = [("what", pa.int32()), ("part", pa.int64()), ("run", pa.int64()), ("learn", pa.bool_()), ("data", pa.binary())]
# Columns of the data that are sent: histories, words, texts; see _run.
_KINDS = {_HEAD: ("<u2", "<u2", "<u2", "<u2", "<u2", "<u4"), _WORD: ("<u8", "<u2", "<u2", "<u8", "<u8", "<u2"), _HISTORY: ("<u8", "<u2", "<u2")}
_OFTEN = ("<u2", "<u2", "<u4", "<u2")


def _run(run: int, learn: bool, ids: list, hs: list[np.ndarray], k: Unigrams, p: KatzParams):
    """Rows that a run of texts sends: the run's own, and the events by part."""
    size = np.array([len(h) for h in hs])
    w, doc = np.concatenate(hs), np.repeat(np.arange(len(hs), dtype=np.uint16), size)
    cw = k.codes(w)
    h, ch = np.append(END, w[:-1]), np.append(k.codes(np.array([END])), cw[:-1])  # a text starts after the end of the one before
    known = k.c[cw] if len(k.c) else np.zeros(len(w), np.int64)
    of_head = cw >= 0
    add = lambda x: np.bincount(doc[of_head], x[of_head], len(hs))
    n_known, base = add(known > 0), add(k.base(known))
    # Both of the head, sorted by part, history and word; what is frequent in the run is sent once.
    at = of_head & (ch >= 0)
    a, b, d = ch[at], cw[at], doc[at]
    salt = _mixed(b.astype(np.int64)) % k.split[a].astype(np.uint64) if len(a) else np.zeros(0, np.uint64)
    part = _share(mix64((a.astype(np.uint64) << np.uint64(20)) + salt), k.parts)
    key = part << 32 | a << 16 | b
    order = np.argsort(key, kind="stable")
    key, d = key[order], d[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    many = np.diff(np.append(first, len(key)))
    big = many >= p.often
    in_big = np.repeat(big, many)
    bk, bn, bd = key[first[big]], many[big], d[in_big]
    b_h, b_w = (bk >> 16 & 0xFFFF).astype("<u2"), (bk & 0xFFFF).astype("<u2")
    nulls = np.array([i is None for i in ids])
    yield _RUN, run, _packed(np.array([i or 0 for i in ids], "<i8"), nulls, size.astype("<i8"), n_known.astype("<i8"), base) + _packed(b_h, b_w, bn.astype("<u4"), bd)
    key, d = key[~in_big], d[~in_big]
    small = {q: s for q, s in _ranges(key >> 32)}
    large = {q: s for q, s in _ranges(bk >> 32)}
    for q in small.keys() | large.keys():
        s, t = small.get(q, slice(0, 0)), large.get(q, slice(0, 0))
        x = key[s]
        yield _HEAD, q, _packed((x >> 16 & 0xFFFF).astype("<u2"), (x & 0xFFFF).astype("<u2"), d[s], b_h[t], b_w[t], bn[t].astype("<u4"))
    # Words beyond the head, by word: histories of the head, and others.
    both = []
    for tail in (False, True):
        at = ~of_head & ((ch < 0) == tail)
        m = _mixed(w[at])
        order = np.argsort(m)
        m, x = m[order], (_mixed(h[at]) if tail else ch[at].astype("<u2"))[order]
        both.append((m, x, doc[at][order], dict(_ranges(_share(m, k.tail_parts)))))
    for q in both[0][3].keys() | both[1][3].keys():
        cols = [c[t[3].get(q, slice(0, 0))] for t in both for c in t[:3]]
        yield _WORD, q, _packed(*cols)
    # Histories beyond the head, before words of the head.
    at = of_head & (ch < 0)
    m = _mixed(h[at])
    order = np.argsort(m)
    m, x, d = m[order], cw[at][order].astype("<u2"), doc[at][order]
    for q, s in _ranges(_share(m, k.tail_parts)):
        yield _HISTORY, q, _packed(m[s], x[s], d[s])


def _sent(k: Unigrams, p: KatzParams):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[bool, tuple[list, list, list]] = {True: ([], [], [0]), False: ([], [], [0])}

        def out(learn: bool):
            nonlocal number
            ids, hs, n = held[learn]
            if ids:
                for what, part, data in _run(number, learn, ids, hs, k, p):
                    yield what, part, number, learn, data
                number += 1
            held[learn] = ([], [], [0])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _SENT)], names=[n for n, _ in _SENT])

        for b in batches:
            for i, x, learn in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "learn"))):
                ids, hs, n = held[learn]
                h = hashes(x)
                ids.append(i), hs.append(h)
                n[0] += len(h)
                if n[0] >= p.run_tokens or len(ids) == 1 << 16:
                    yield batch(list(out(learn)))
        for learn in (True, False):
            if held[learn][0]:
                yield batch(list(out(learn)))

    return run


def _grouped(key: np.ndarray):
    """The order that sorts keys, where each distinct one starts there, and how often it stands."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] ^ key.dtype.type(1))) if len(key) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(key)))


def _cut(sizes: np.ndarray):
    """Slices of keys with about _ROW events."""
    at, upto, i = [0], np.cumsum(sizes), 0
    while i < len(sizes):
        i = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _ROW, "right")))
        at.append(i)
    return list(zip(at, at[1:]))


def _of_counts(c: np.ndarray, k: int) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= k + 1)], minlength=k + 2)[1 : k + 2].tolist()


def _by_history(h: np.ndarray, c: np.ndarray, seen: np.ndarray, size: int, cutoff: int) -> np.ndarray:
    """Rows by history: events, bigrams by count 1..cutoff, probability of the words seen."""
    out = np.zeros((cutoff + 2, size))
    out[0] = np.bincount(h, c, size)
    for r in range(1, cutoff + 1):
        out[r] = np.bincount(h[c == r], minlength=size)
    out[-1] = np.bincount(h, np.where(c > 0, seen, 0.0), size)
    return out


_TABLE = "what int, part long, counts array<long>, data binary, stats binary"
_TABLE_ARROW = [("what", pa.int32()), ("part", pa.int64()), ("counts", pa.list_(pa.int64())), ("data", pa.binary()), ("stats", pa.binary())]


def _table(rows: list) -> pa.Table:
    return pa.table([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [[]] * 5, _TABLE_ARROW)], names=[n for n, _ in _TABLE_ARROW])


def _head_stats(h: np.ndarray, c: np.ndarray, seen: np.ndarray, cutoff: int) -> bytes:
    codes, at = np.unique(h, return_inverse=True)
    return _packed(codes.astype("<u2"), _by_history(at, c, seen, len(codes), cutoff))


#: Data of a row of the tables: by bigram history, count, count of the word, events; by event run and text; by bigram and run that sends it once; runs.
_ROWS = ("<u4", "<i8", "<i8", "<u4", "<u4", "<u2", "<u4", "<u4", "<i8")


def _rows_of(what: int, part: int, h: np.ndarray, c: np.ndarray, cw: np.ndarray, size: np.ndarray, run: np.ndarray, doc: np.ndarray, runs: np.ndarray, cutoff: int, stats: bytes | None = None, once=None) -> list:
    """Rows of a part, cut by events. once: number of the bigram, run, sorted by bigram. The first row has the statistics."""
    upto = np.append(0, np.cumsum(size))
    out = []
    for i, j in _cut(size + (np.bincount(once[0], minlength=len(size)) if once else 0)):
        e = slice(upto[i], upto[j])
        o = slice(*np.searchsorted(once[0], [i, j])) if once else slice(0, 0)
        ob, orun = ((once[0][o] - i).astype("<u4"), once[1][o].astype("<u4")) if once else (np.zeros(0, "<u4"), np.zeros(0, "<u4"))
        data = _packed(h[i:j].astype("<u4"), c[i:j].astype("<i8"), cw[i:j].astype("<i8"), size[i:j].astype("<u4"), run[e].astype("<u4"), doc[e], ob, orun, runs)
        out.append((what, part, _of_counts(c[i:j], cutoff), data, stats if not out else None))
    return out


def _met(k: Unigrams, p: KatzParams):
    """What each part makes of the events that were sent to it."""

    def head(part, t, runs, learn):
        cols = [_columns(x, *_KINDS[_HEAD]) for x in t]
        h, w, doc, bh, bw, bn = (np.concatenate([c[i] for c in cols]) for i in range(6))
        run, brun = (np.repeat(np.arange(len(cols)), [len(c[i]) for c in cols]) for i in (0, 3))
        key = np.concatenate([h.astype(np.uint32) << np.uint32(16) | w, bh.astype(np.uint32) << np.uint32(16) | bw])
        weight = np.concatenate([learn[run], learn[brun] * bn])
        distinct, at = np.unique(key, return_inverse=True)
        c = np.rint(np.bincount(at, weight, len(distinct))).astype(np.int64)
        order, border = np.argsort(at[: len(h)], kind="stable"), np.argsort(at[len(h) :], kind="stable")
        size = np.bincount(at[: len(h)], minlength=len(distinct))
        hist, cw = (distinct >> np.uint32(16)).astype(np.int64), k.c[distinct & np.uint32(0xFFFF)]
        stats = _head_stats(hist, c, k.p(cw), p.cutoff)
        # By bigram, the history's code and the word's follow as one number, for the runs that sent it once.
        return _rows_of(_HEAD, part, distinct, c, cw, size, run[order], doc[order], runs, p.cutoff, stats, (at[len(h) :][border], brun[border]))

    def word(part, t, runs, learn):
        cols = [_columns(x, *_KINDS[_WORD]) for x in t]
        m, h, doc, mt, ht, dt = (np.concatenate([c[i] for c in cols]) for i in range(6))
        run, rt = (np.repeat(np.arange(len(cols)), [len(c[i]) for c in cols]) for i in (0, 3))
        words, at = np.unique(np.concatenate([m, mt]), return_inverse=True)
        cw = np.rint(np.bincount(at, np.concatenate([learn[run], learn[rt]]), len(words))).astype(np.int64)
        out = []
        if len(m):
            order, first, size = _grouped(at[: len(m)].astype(np.int64) << 16 | h)
            hist, of = h[order[first]].astype(np.int64), cw[at[order[first]]]
            c = np.rint(np.add.reduceat(learn[run[order]], first)).astype(np.int64)
            out += _rows_of(_WORD, part, hist, c, of, size, run[order], doc[order], runs, p.cutoff, _head_stats(hist, c, k.p(of), p.cutoff))
        if len(mt):
            order = np.argsort(ht)
            cols, rt = (ht[order], mt[order], cw[at[len(m) :]][order], dt[order]), rt[order]
            for q, s in _ranges(_share(cols[0], k.tail_parts)):
                own, to = np.unique(rt[s], return_inverse=True)  # with all runs, what is sent would grow as parts times parts times runs
                out.append((_HISTORY, q, None, _packed(*(c[s] for c in cols), to.astype("<u4"), runs[own], learn[own].astype(np.uint8)), b"w"))
        return out

    def met(key, t):
        what, part = (x.as_py() for x in key)
        order = np.argsort(t.column("run").to_numpy(), kind="stable")  # ascending numbers take less room
        data, runs, learn = t.column("data").to_pylist(), t.column("run").to_numpy()[order], t.column("learn").to_numpy().astype(np.float64)[order]
        data = [data[i] for i in order.tolist()]
        if what == _HEAD:
            return _table(head(part, data, runs, learn))
        if what == _WORD:
            return _table(word(part, data, runs, learn))
        if what == _HISTORY:
            cols = [_columns(x, *_KINDS[_HISTORY]) for x in data]
            m, w, doc = (np.concatenate([c[i] for c in cols]) for i in range(3))
            run = np.repeat(np.arange(len(cols), dtype="<u4"), [len(c[0]) for c in cols])
            order = np.argsort(m)
            return _table([(what, part, None, _packed(m[order], w[order].astype("<u8"), k.c[w[order]], doc[order], run[order], runs, learn.astype(np.uint8)), b"h")])
        return _table([(what, part, None, x, None) for x in data])

    return met


_TAIL = ("<u8", "<u8", "<i8", "<u2", "<u4", "<i8", "u1")


def _histories(k: Unigrams, p: KatzParams):
    """Parts of histories beyond the head: all their events, with the words' counts."""

    def met(key, t):
        part = key[0].as_py()
        cols = [_columns(x, *_TAIL) for x in t.column("data").to_pylist()]
        runs, to = np.unique(np.concatenate([c[5] for c in cols]), return_inverse=True)
        learn = np.zeros(len(runs))
        learn[to] = np.concatenate([c[6] for c in cols])
        begin = np.cumsum([0, *(len(c[5]) for c in cols)])
        run = np.concatenate([to[b + c[4].astype(np.int64)] for b, c in zip(begin, cols)])
        tail = np.repeat([x == b"w" for x in t.column("stats").to_pylist()], [len(c[0]) for c in cols])
        m, w, cw, doc = (np.concatenate([c[i] for c in cols]) for i in range(4))
        hist, h = np.unique(m, return_inverse=True)
        order = np.lexsort((w, tail, h))
        h, w, tail, cw, doc, run = (x[order] for x in (h, w, tail, cw, doc, run))
        first = np.flatnonzero((np.diff(h, prepend=-1) != 0) | (np.diff(w, prepend=np.uint64(0)) != 0) | (np.diff(tail.astype(np.int8), prepend=2) != 0))
        c = np.rint(np.add.reduceat(learn[run], first)).astype(np.int64)
        size = np.diff(np.append(first, len(h)))
        h, cw, tail = h[first], cw[first], tail[first]
        stats = _by_history(h, c, k.p(cw), len(hist), p.cutoff)
        # Rows are cut between histories only, so that each has the statistics of its own; tail words' counts are negative, less one.
        ends = np.flatnonzero(np.diff(h, append=-1)) + 1
        out, i = [], 0
        per = np.add.reduceat(size, np.append(0, ends[:-1]))
        for a, b in _cut(per):
            j = int(ends[b - 1])
            e = slice(int(first[i]), int(first[j]) if j < len(first) else len(run))
            out += [(_HISTORY, part, _of_counts(c[i:j], p.cutoff), _packed((h[i:j] - a).astype("<u4"), c[i:j], np.where(tail[i:j], -1 - cw[i:j], cw[i:j]), size[i:j].astype("<u4"), run[e].astype("<u4"), doc[e], np.zeros(0, "<u4"), np.zeros(0, "<u4"), runs), _packed(stats[:, a:b].copy()))]
            i = j
        return _table(out)

    return met


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.where(x > 0, x, 1.0))


_SUMS = "run long, kind int, data binary"


def _sums(k: Unigrams, d: np.ndarray, log_n: np.ndarray, log_a: np.ndarray, cutoff: int):
    """What rows of the tables add to the texts of runs: scores (1); tokens known and base scores of words beyond the head (2); what a run's frequent bigrams are worth (3)."""

    def run(batches):
        number: dict[int, int] = {}
        held: dict[int, list] = {1: [], 2: []}
        n = 0

        def out():
            runs = np.array(list(number), np.int64)
            for kind, some in held.items():
                if not some:
                    continue
                key, at = np.unique(np.concatenate([x[0] for x in some]), return_inverse=True)
                cols = [np.bincount(at, np.concatenate([x[i] for x in some]), len(key)) for i in range(1, len(some[0]))]
                for r, s in _ranges(key >> 16):
                    yield int(runs[r]), kind, _packed((key[s] & 0xFFFF).astype("<u2"), *(c[s] for c in cols))
                some.clear()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["run", "kind", "data"])

        for b in batches:
            for what, data, stats in zip(*(map(b.column(c).__getitem__, range(b.num_rows)) for c in ("what", "data", "stats"))):
                what, data, stats = what.as_py(), data.as_buffer(), stats.as_buffer()
                if what == _RUN:
                    continue
                h, c, cw, size, r, doc, ob, orun, runs = _columns(data, *_ROWS)
                h, tail = h.astype(np.int64), np.full(len(h), what == _WORD)
                if what == _HISTORY:
                    tail, cw = cw < 0, np.where(cw < 0, -1 - cw, cw)
                    (x,) = _columns(stats, "<f8")
                    x = x.reshape(cutoff + 2, -1)
                    left = x[0] - sum((1 - d[i]) * i * x[i] for i in range(1, cutoff + 1))
                    of_n, of_a = (y[h] for y in backoff(x[0], left, x[-1]))
                else:
                    code = h >> 16 if what == _HEAD else h
                    of_n, of_a = log_n[code], log_a[code]
                value = np.where(c > 0, _log(discounted(c, d)) - of_n, of_a + np.log10(k.p(cw)))
                to = np.array([number.setdefault(x, len(number)) for x in runs.tolist()], np.int64)
                key = to[r] << 16 | doc
                at = np.repeat(np.arange(len(h)), size)
                held[1].append((key, value[at]))
                if tail.any():
                    of = tail[at]
                    held[2].append((key[of], (cw > 0).astype(float)[at[of]], k.base(cw)[at[of]]))
                if len(ob):
                    order = np.argsort(orun, kind="stable")
                    ob, orun = ob[order], orun[order]
                    yield batch([(int(runs[x]), 3, _packed(h[ob[s]].astype("<u4"), value[ob[s]])) for x, s in _ranges(orun)])
                n += len(key)
                if n > 4_000_000:
                    rows = list(out())
                    n = 0
                    number.clear()
                    if rows:
                        yield batch(rows)
        rows = list(out())
        if rows:
            yield batch(rows)
        give_back()

    return run


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scores(t: pa.Table) -> pa.Table:
    """The texts of a run, with the sums from all parts added up."""
    rows = list(zip(t.column("kind").to_pylist(), t.column("data").to_pylist()))
    own = next(x for kind, x in rows if kind == 0)
    first = ("<i8", "?", "<i8", "<i8", "<f8")
    ids, nulls, n, known, base = (c.copy() for c in _columns(own, *first))
    after = 8 * len(first) + int(np.frombuffer(own, "<i8", len(first)).sum())
    bh, bw, bn, bd = _columns(own[after:], *_OFTEN)
    known, score = known.astype(float), np.zeros(len(ids))
    of = bh.astype(np.uint32) << np.uint32(16) | bw
    order = np.argsort(of)
    worth = np.zeros(len(of))
    for kind, x in rows:
        if kind == 1:
            doc, s = _columns(x, "<u2", "<f8")
            score[doc] += s
        elif kind == 2:
            doc, a, s = _columns(x, "<u2", "<f8", "<f8")
            known[doc] += a
            base[doc] += s
        elif kind == 3:
            key, s = _columns(x, "<u4", "<f8")
            worth[order[np.searchsorted(of[order], key)]] = s
    score += np.bincount(bd, np.repeat(worth, bn), len(ids))
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=nulls), "n_tokens": n, "n_known": np.rint(known).astype(np.int64), "base_score": base, "score": score})


def tables(docs: DataFrame, k: Unigrams, p: KatzParams) -> tuple[DataFrame, DataFrame]:
    """The n-gram tables: parts of bigrams with a history of the head, and the runs; parts of bigrams with another history."""
    events = docs.select("doc_id", "text", "learn").mapInArrow(_sent(k, p), _EVENTS)
    first = materialise(events.groupBy("what", "part").applyInArrow(_met(k, p), _TABLE), _GROUPS)
    rest = first.where((F.col("what") == _HISTORY)).select("part", "data", "stats")
    return first, materialise(rest.groupBy("part").applyInArrow(_histories(k, p), _TABLE), _GROUPS)


def _stats_rows(cutoff: int):
    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                code, s = _columns(x, "<u2", "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), *map(pa.array, s.reshape(cutoff + 2, -1))], names=["code", *(f"s{i}" for i in range(cutoff + 2))])

    return run


def backoffs(first: DataFrame, rest: DataFrame, k: Unigrams, p: KatzParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discounts of bigrams; log10 of denominators and backoff weights of the head, one row of which a token is sent to the driver."""
    parts = first.select("counts").unionByName(rest.select("counts")).where("counts is not null")
    got = parts.agg(*(F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(p.cutoff + 1))).first()
    d = discounts(np.array([0, *got]))
    names = [f"s{i}" for i in range(p.cutoff + 2)]
    stats = first.where((F.col("what") != _HISTORY) & F.col("stats").isNotNull()).select("stats").mapInArrow(_stats_rows(p.cutoff), ", ".join(["code int", *(f"{n} double" for n in names)]))
    sums = np.zeros((p.cutoff + 2, max(1, len(k.hash))))
    t = stats.groupBy("code").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    for i, n in enumerate(names):
        sums[i, t["code"].to_numpy()] = t[n].to_numpy()
    left = sums[0] - sum((1 - d[i]) * i * sums[i] for i in range(1, p.cutoff + 1))
    return d, *backoff(sums[0], left, sums[-1])


def score(docs: DataFrame, p: KatzParams = KatzParams()) -> DataFrame:
    """docs: doc_id, text, learn (whether the text is learned from). Gives doc_id, n_tokens, n_known, train_tokens, base_score, score of each row."""
    k = fit_unigrams(docs, p)
    first, rest = tables(docs, k, p)
    d, log_n, log_a = backoffs(first, rest, k, p)
    rows = first.where(F.col("what").isin(_HEAD, _WORD)).unionByName(rest).select("what", "data", "stats")
    sums = rows.mapInArrow(_sums(k, d, log_n, log_a, p.cutoff), _SUMS)
    own = first.where(F.col("what") == _RUN).select(F.col("part").alias("run"), F.lit(0).alias("kind"), "data")
    out = own.unionByName(sums).groupBy("run").applyInArrow(_scores, _SCORES)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(k.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_katz_lm(spark, sf_dir: str) -> DataFrame:
    third = fold(F.col("doc_id"), 7)
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(third != 2, F.lit(False)).alias("learn"))
    out = score(docs)
    return out.select("doc_id", F.coalesce(third == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
