"""Cross-tokenizer alignment: which ids of two tokenizers end at the same bytes, how often over the corpus, and how well they agree.

Each text is encoded by a byte-level BPE (A) and by a sentencepiece model (B). Where a token of A and one of B end at the same
byte they are linked; these ends cut the text into groups. Pieces cut at single spaces are aligned by themselves, once, and
remembered. The links of a run of documents leave their task packed by stripe, B's ids modulo `STRIPES`: one row for each run
and stripe, alike links of a document once with their number. Counts over the corpus are dense matrices, one for each stripe,
with a row for each of its B ids and a column for each A id: partial ones for parts of the runs, whose sums make the stripe's.
Row maxima tell the best count of a B id. To score the links they meet their stripe's counts in one partition: a stripe with
many links is split into parts, each of which gets the counts. A task holds one stripe's matrix at a time, and streams the
links. A run's scores are then added up by document.

Defined results: a text that is null or empty, or whose tokens' bytes aren't a space and the text (the model may change white space or
letters), has no tokens, zeros and empty groups. Rows alike in doc_id or text count each. An empty table gives no rows. Other columns
are ignored. Tokens have at least a byte each, so one end is one link.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, materialise, setting, slices
from .pieces import PieceEncoder, byte_letters
from .tokenfiles import _TOGETHER, BATCH, INK, VOCABULARY, _encoder

PIECES = "piece_bpe_32k.model"
STRIPES = 1024
RUN = 1_000_000  # links of a run of documents, about
DOCS = 1 << 16  # documents of a run, at most
SALTS = 16  # parts of the runs whose counts are added first
PART = 8_000_000  # links of a stripe that one partition scores, about
MEMORY = 120_000_000  # bytes of pieces whose links a Python worker remembers
_ENTRY = 320  # bytes that such a piece takes, about
_CHUNK = 200_000  # pairs of ids to a row of counts


class _Pair:
    """Both tokenizers, with the bytes of each id, and its decimal form followed by what can follow it in a group's text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        _, self.encode_a = _encoder(a_path, True, MEMORY // 2)
        t, letters = Tokenizer.from_file(a_path), byte_letters()
        tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in tokens]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.written = [b"%d%s" % (i, s) for n, ends in ((len(tokens), (b",", b"|")), (len(self.b_bytes), (b",", b";", b""))) for i in range(n) for s in ends]

        self.opens = np.array([x.startswith(b" ") for x in self.b_bytes])
        self.parted = _parted(self.b)
        self.known = PieceEncoder(self.aligned, "<u4", MEMORY, entry=_ENTRY)

    def encode_b(self, xs: list[str]) -> list[list[int]]:
        """B's ids of pieces, which begin with a space. Those that may are encoded as one text; a piece's first token is its only one with a space."""
        out: list = [None] * len(xs)
        plain = np.flatnonzero(pc.match_substring_regex(pa.array(xs, pa.large_string()), INK)).tolist() if self.parted else []
        for first in range(0, len(plain), _TOGETHER):
            some = plain[first : first + _TOGETHER]
            got = self.b.encode("".join([xs[i] for i in some])[1:], num_threads=1)
            cuts = np.flatnonzero(self.opens[got]).tolist()
            if len(cuts) == len(some) and cuts[0] == 0:
                for i, k, j in zip(some, cuts, [*cuts[1:], len(got)]):
                    out[i] = got[k:j]
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self.b.encode([xs[i][1:] for i in left], num_threads=1) if left else ()):
            out[i] = x
        return out

    def aligned(self, xs: list[str]) -> list[bytes]:
        """Of pieces that begin with a space: five numbers (1 if both tokenizers give the piece back, A's and B's ids, links, bytes of
        the groups), the links' A ids and B ids, and the groups."""
        a, ends = self.encode_a(pa.array(xs, pa.large_string()))
        lists = self.encode_b(xs)
        na, nb = np.diff(ends, prepend=0), np.fromiter(map(len, lists), np.int64, len(lists))
        a, b = a.astype(np.int64), np.fromiter(chain.from_iterable(lists), np.int64, int(nb.sum()))
        good = _gives(a, na, self.a_bytes, self.a_size, xs) & _gives(b, nb, self.b_bytes, self.b_size, xs)
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = na * good, nb * good
        la, lb, piece, groups = align(self, a, b, na, nb)
        n = np.bincount(piece, minlength=len(xs))
        heads = np.stack([good, na, nb, n, np.fromiter(map(len, groups), np.int64, len(xs))], 1).astype("<u4").tobytes()
        la, lb, upto = la.astype("<u4").tobytes(), lb.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return [heads[20 * i : 20 * i + 20] + la[k:j] + lb[k:j] + g + b"\0" * (-len(g) % 4) for i, (k, j, g) in enumerate(zip([0, *upto], upto, groups))]

    def links(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids and texts of the links, and for each text the hash of its groups and both numbers of ids. A text's pieces end where tokens
        of both tokenizers do, so its links and groups are those of its pieces."""
        if self.parted:
            code, at, got = self.known.coded(texts, True)
        else:
            got = self.aligned([f" {x}" for x in texts.to_pylist()])
            code, at = np.arange(len(got)), np.arange(len(got) + 1)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat, head = np.frombuffer(b"".join(got), "<u4"), np.cumsum(size) - size
        good, na, nb, n, written = (flat[head + k].astype(np.int64) for k in range(5))
        words = [x[i:j] for x, i, j in zip(got, (20 + 8 * n).tolist(), (20 + 8 * n + written).tolist())]
        pieces = np.diff(at)
        whole = (np.add.reduceat(good[code], at[:-1]) == pieces) & (pc.binary_length(texts).to_numpy() > 0)
        a, b = (np.add.reduceat(x[code], at[:-1]) * whole for x in (na, nb))
        hashes = []
        for i, j, w in zip(at.tolist(), at[1:].tolist(), whole.tolist()):
            hashes.append(hashlib.sha256(b";".join(map(words.__getitem__, code[i:j].tolist()))).hexdigest() if w else "")
        code, doc = code[np.repeat(whole, pieces)], np.repeat(np.flatnonzero(whole), pieces[whole])
        here = n[code]
        at = np.repeat(head[code] + 5 - np.cumsum(here) + here, here) + np.arange(int(here.sum()))
        return flat[at].astype(np.int64), flat[at + np.repeat(here, here)].astype(np.int64), np.repeat(doc, here), hashes, a, b


def _gives(ids: np.ndarray, n: np.ndarray, tokens: list[bytes], sizes: np.ndarray, xs: list[str]) -> np.ndarray:
    """Which pieces their ids, n of each, give back; none has less than a space and a character."""
    raw = [x.encode() for x in xs]
    size, upto = np.fromiter(map(len, raw), np.int64, len(raw)), np.append(0, np.cumsum(n))
    made = np.append(0, np.cumsum(sizes[ids]))[upto]
    got = list(map(tokens.__getitem__, ids.tolist()))
    if (np.diff(made) == size).all() and b"".join(got) == b"".join(raw):
        return size > 1
    return (size > 1) & [b"".join(got[i:j]) == x for x, i, j in zip(raw, upto.tolist(), upto[1:].tolist())]


def _parted(b) -> bool:
    """Whether a sentencepiece model's ids of a text are those of its pieces one after another: texts stay as they are behind a space,
    merges go by pieces, and no piece has a space behind another character. What isn't a piece falls to bytes."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(b.serialized_model_proto())
    norm, spec, kinds = m.normalizer_spec, m.trainer_spec, {p.type for p in m.pieces}
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    bpe = spec.model_type == spec.BPE and spec.byte_fallback and not spec.treat_whitespace_as_suffix
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    return bool(plain and bpe and not kinds & {kind.USER_DEFINED, kind.UNUSED} and not any("▁" in p.piece.lstrip("▁") for p in m.pieces))


@lru_cache(1)
def _pair(a_path: str, b_path: str) -> _Pair:
    return _Pair(a_path, b_path)


def _forget() -> None:
    """A Python worker that goes on to a later step gives back what it kept for encoding."""
    _pair.cache_clear(), _encoder.cache_clear()
    give_back()


def align(p: _Pair, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ids and texts of the links, and for each text its groups. All texts are one stream of bytes here: both sides of
    a text have the same bytes, and end together."""
    a_end, b_end = np.cumsum(p.a_size[a]), np.cumsum(p.b_size[b])
    ends = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, bool)
    ends[a_end] = True
    ib = np.flatnonzero(ends[b_end])
    ia = np.searchsorted(a_end, b_end[ib])
    doc = np.searchsorted(np.cumsum(nb), ib, "right")
    # A group's A ids come first, then its B ids, then those of the next group.
    since_a, since_b = np.append(0, ia + 1), np.append(0, ib + 1)
    group_a, group_b = np.searchsorted(ia, np.arange(len(a))), np.searchsorted(ib, np.arange(len(b)))
    kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    kind_a[ia], kind_b[ib] = 1, 1
    kind_b[np.cumsum(nb)[nb > 0] - 1] = 2
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + since_b[group_a]] = a * 2 + kind_a
    code[np.arange(len(b)) + since_a[group_b + 1]] = b * 3 + kind_b + 2 * len(p.a_bytes)
    words = list(map(p.written.__getitem__, code.tolist()))
    upto = np.cumsum(na + nb).tolist()
    return a[ia], b[ib], doc, [b"".join(words[i:j]) for i, j in zip([0, *upto], upto)]


_TOKENS = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("stripe", pa.int64()), ("docs", pa.binary()), ("pairs", pa.binary()), ("n", pa.binary()), ("i", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())])
_TOKENS_SQL = "p long, q long, stripe long, docs binary, pairs binary, n binary, i long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"


def _batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([(cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type)) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed(run: list[tuple], width: int) -> tuple[np.ndarray, list, list, list]:
    """stripe, docs, pairs, n of a run's links, packed by stripe; pairs: B id // STRIPES * width + A id."""
    a, b, doc = (np.concatenate(x) for x in zip(*run))
    pair = b // STRIPES * width + a
    most = int(pair.max()) + 1
    key, n = np.unique(((b % STRIPES) * most + pair) * DOCS + doc, return_counts=True)
    pair, doc = np.divmod(key, DOCS)
    stripe, pair = np.divmod(pair, most)
    cut = np.flatnonzero(np.diff(stripe, prepend=-1))
    bounds = list(zip(cut.tolist(), [*cut[1:].tolist(), len(stripe)]))
    return stripe[cut], *([x[i:j].tobytes() for i, j in bounds] for x in (y.astype("<u4") for y in (doc, pair, n)))


def tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document (stripe null), and one for each run (p, q) and stripe with that run's links, packed."""

    def run(batches):
        pair, p, q, i, links, held = _pair(a_path, b_path), TaskContext.get().partitionId(), 0, 0, [], 0
        width = len(pair.a_bytes)

        def close():
            stripe, docs, pairs, n = _packed(links, width)
            return _batch(_TOKENS, p=np.full(len(stripe), p), q=np.full(len(stripe), q), stripe=stripe, docs=docs, pairs=pairs, n=n)

        for whole in slices(batches):
            for first in range(0, whole.num_rows, DOCS // 2):
                b = whole.slice(first, DOCS // 2)
                if held > RUN or i + b.num_rows > DOCS:
                    if held:
                        yield close()
                    q, i, links, held = q + 1, 0, [], 0
                texts = b.column("text").fill_null("")
                la, lb, doc, hashes, na, nb = pair.links(texts)
                links.append((la, lb, doc + i))
                held += len(la)
                yield _batch(_TOKENS, p=np.full(len(b), p), q=np.full(len(b), q), i=np.arange(i, i + len(b)), doc_id=b.column("doc_id").cast(pa.int64()), n_a=na, n_b=nb, n_groups=np.bincount(doc, minlength=len(b)), groups_sha256=hashes)
                i += b.num_rows
        if held:
            yield close()
        give_back()

    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)):
        return materialise(docs.select("doc_id", "text").mapInArrow(run, _TOKENS_SQL), 16 << 20)


def _u4(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)


def _i8(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<i8")


def _keyed(batches, keys: list[str]):
    """(key, row) of rows that come in order of their keys."""
    for b in batches:
        for key, row in zip(zip(*(b.column(c).to_pylist() for c in keys)), range(b.num_rows)):
            yield key, {c: b.column(c)[row] for c in b.schema.names}


_COUNTS = "stripe long, salt long, chunk long, pairs binary, counts binary, links long"


def _added(shape: tuple[int, int], keys: list[str]):
    """mapInArrow function: dense matrices of the rows of each (stripe, salt), which come in order; gives their entries that aren't zero."""

    def run(batches):
        _forget()
        block, at = np.zeros(shape[0] * shape[1], np.int64), None

        def emit():
            pairs = np.flatnonzero(block)
            rows = [(k, pairs[k * _CHUNK : (k + 1) * _CHUNK]) for k in range(-(-len(pairs) // _CHUNK))]
            total = int(block[pairs].sum())
            for k, x in rows:  # a row at a time: a stripe's entries may be many
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((at[0], pa.int64()), (at[-1] if len(at) > 1 else 0, pa.int64()), (k, pa.int64()), (x.astype("<u4").tobytes(), pa.binary()), (block[x].astype("<i8").tobytes(), pa.binary()), (total, pa.int64()))], names=["stripe", "salt", "chunk", "pairs", "counts", "links"])
            block[pairs] = 0

        for key, row in _keyed(batches, keys):
            if key != at:
                if at is not None:
                    yield from emit()
                at = key
            np.add.at(block, _u4(row["pairs"]), _i8(row["counts"]) if "counts" in row else _u4(row["n"]))
        if at is not None:
            yield from emit()

    return run


def counts(links: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """stripe, salt (0), chunk, pairs, counts, links: over all links how many hold each pair of ids, packed by stripe in chunks; links: the stripe's."""
    partial = links.select("stripe", F.pmod(F.hash("p", "q"), F.lit(SALTS)).cast("long").alias("salt"), "pairs", "n").repartition("stripe", "salt").sortWithinPartitions("stripe", "salt")
    partial = partial.mapInArrow(_added(shape, ["stripe", "salt"]), _COUNTS)
    whole = partial.select("stripe", "pairs", "counts").repartition("stripe").sortWithinPartitions("stripe")
    return materialise(whole.mapInArrow(_added(shape, ["stripe"]), _COUNTS))


_SCORES = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("docs", pa.binary()), ("best", pa.binary()), ("sums", pa.binary())])


def scores(links: DataFrame, counted: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """p, q, docs, best, sums: for each row of links, by document, its links whose count is the best of their B id, and the sum of counts."""
    large = counted.where(F.col("links") > PART).groupBy("stripe").agg(F.max("links").alias("links")).collect()  # fewer rows than stripes
    more = [F.lit(x).cast("long") for r in large for x in (r["stripe"], -(-r["links"] // PART))]
    of = F.coalesce(F.try_element_at(F.create_map(*more), F.col("stripe")), F.lit(1)) if more else F.lit(1).cast("long")
    left = counted.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), of - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("binary").alias("docs"), "pairs", F.col("counts").alias("n"))
    right = links.select("stripe", F.pmod(F.hash("p", "q"), of).cast("long").alias("salt"), F.lit(1).alias("kind"), "p", "q", "docs", "pairs", "n")
    met = left.unionByName(right).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")

    def run(batches):
        _forget()
        block, at, best = np.zeros(shape, np.int64), None, None
        flat = block.reshape(-1)
        for b in batches:
            out = []
            for key, row in _keyed([b], ["stripe", "salt"]):
                if key != at:
                    block[:], at, best = 0, key, None
                pairs = _u4(row["pairs"])
                if row["kind"].as_py() == 0:
                    flat[pairs] = _i8(row["n"])
                    continue
                if best is None:
                    best = block.max(axis=1)
                n, c = _u4(row["n"]), flat[pairs]
                docs, place = np.unique(_u4(row["docs"]), return_inverse=True)
                good, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(good, place, np.where(c == best[pairs // shape[1]], n, 0)), np.add.at(total, place, n * c)
                out.append((row["p"].as_py(), row["q"].as_py(), docs.astype("<u4").tobytes(), good.astype("<i8").tobytes(), total.astype("<i8").tobytes()))
            if out:
                yield _batch(_SCORES, **dict(zip(_SCORES.names, zip(*out))))

    with setting(links.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BATCH)):
        return materialise(met.mapInArrow(run, "p long, q long, docs binary, best binary, sums binary"))


_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of docs (doc_id, text)."""
    from tokenizers import Tokenizer
    from sentencepiece import SentencePieceProcessor

    shape = (-(-SentencePieceProcessor(model_file=b_path).get_piece_size() // STRIPES), Tokenizer.from_file(a_path).get_vocab_size())
    rows = tokens(docs, a_path, b_path)
    links = rows.where("stripe is not null").select("p", "q", "stripe", "docs", "pairs", "n")
    scored = scores(links, counts(links, shape), shape)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """A run's documents and scores: at most DOCS documents, and a row for each stripe."""
        _forget()
        left = left.sort_by("i")
        best, total = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        for d, x, y in zip(*(right.column(c) for c in ("docs", "best", "sums"))):
            d = _u4(d)
            best[d] += _i8(x)  # a document once in a row
            total[d] += _i8(y)
        cols = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        return pa.table([*(cols[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")), pa.array(best), pa.array(total), cols["groups_sha256"]], schema=_RESULT)

    docs_rows = rows.where("stripe is null").select("p", "q", "i", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return docs_rows.groupBy("p", "q").cogroup(scored.groupBy("p", "q")).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))
