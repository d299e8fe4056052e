"""op11, op12 and op13 as registered, and their operators, against brute force on the awkward table."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, rows

from quantloom.llm import alignment, entries, filters, packing, pieces, tokenfiles

MARKED = [(100 + i, t, None, s) for i, (t, s) in enumerate([("ONE two " * 150, "a"), ("price $5 & more", ""), ("w " * 250, "a"), (" lead  two\tspaces  ", "b"), ("<|endoftext|> and <s> text", "b"), ("ONE two " * 150, "b"), ("a▁b naïve ﬁ 中文", "c"), ("ﬁ" * 40, "c")])]
MARKED += [(90, "price $5 & more", None, None), (90, "price $5 & more", None, None), (None, "price $5 & more", None, "a")]


@pytest.fixture(scope="module")
def table():
    return rows() + MARKED


@pytest.fixture(scope="module")
def sf_dir(spark, table, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, None, 0.5, 1, 2, 3, 4, 5, 6) for r in table], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, i % 2, i % 3 == 0, 7) for i in [*range(1, 18), *range(95, 105), 11, 90]] + [(90, 1, False, 7), (999, 1, True, 7)]
    spark.createDataFrame([(i, int(q), int(t), s) for i, q, t, s in labels], "doc_id long, quality int, toxic int, source int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", ["op11_bin_slack_packing", "op12_token_alignment", "op13_filter_audit"])
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert entries.queries()[name](spark, empty_dir).count() == 0


def ids_of(text, ordinary=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = ordinary
    return t.encode(text, add_special_tokens=False).ids


def test_packing_holds_every_id_once(spark, sf_dir, table):
    got = [r.asDict() for r in entries.queries()["op11_bin_slack_packing"](spark, sf_dir).collect()]
    by = {}
    for r in got:
        by.setdefault((r["sequence_id"]), []).append(r)
    for q in by.values():
        q.sort(key=lambda r: r["offset"])
        at = 0
        for r in q:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
    want = [(i, np.array([*ids_of(t or ""), 0], "<u4")) for i, t, *_ in table]
    # Rows of one doc_id can't be told apart by it, so only the others are held piece by piece.
    alone = {i for i, n in Counter(i for i, _ in want).items() if n == 1 and i is not None}
    for i, x in want:
        if i in alone:
            mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
            at = 0
            for r in mine:
                assert r["start"] == at and r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(x)
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in want)


def test_sequences_are_put_together(spark, sf_dir, table):
    pieces_ = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 64)
    seqs = packing.sequences(pieces_).collect()
    got = Counter(np.concatenate([np.frombuffer(r["ids"], "<u4") for r in seqs]).tolist())
    want = Counter()
    for _, t, *_ in table:
        want.update([*ids_of(t or ""), 0])
    assert got == want and max(len(r["ids"]) for r in seqs) == 64 * 4


def test_fill_is_the_closest_there_is():
    r = random.Random(3)
    for _ in range(200):
        counts, room = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}, r.randrange(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        take = packing.fill(counts, room)
        assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in take.items())


@pytest.mark.parametrize("capacity", [8, 64, 1024])
def test_plan_fills_windows_and_stays_small(capacity):
    r = random.Random(capacity)
    for most in (1, 5, 10**7):
        counts = {r.randrange(1, capacity): r.randrange(1, most + 1) for _ in range(300)}
        p = packing.plan(counts, capacity)
        assert len(p.length) < 12 * capacity
        counts = {k: min(n, 40) for k, n in counts.items()}
        p = packing.plan(counts, capacity)
        length = np.concatenate([np.full(n, k) for k, n in counts.items()])
        number = np.concatenate([np.arange(n) for n in counts.values()])
        row, window, offset, size = packing.places(p, length, number)
        assert np.array_equal(np.bincount(row, size, len(length)), length)
        used = np.zeros((window.max() + 1, capacity), int)
        for w, o, s in zip(window, offset, size):
            used[w, o : o + s] += 1
        assert used.max() == 1 and all(n & (n - 1) == 0 for n in used.sum(1).tolist())


def test_alignment_agrees_with_plain_counts(spark, sf_dir, table, monkeypatch):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, letters = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), alignment.byte_letters()
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want, counts, links = [], Counter(), []
    for i, text, *_ in table:
        a, b = (ids_of(" " + text, True), sp.encode(text)) if text else ([], [])
        xs = [bytes(letters[c] for c in t.id_to_token(k)) for k in a]
        ys = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or {b"".join(xs), b"".join(ys)} != {(" " + text).encode()}:
            want.append((i, 0, 0, 0, ""))
            links.append([])
            continue
        ex, ey = ({e: k for k, e in enumerate(np.cumsum([len(z) for z in zs]).tolist())} for zs in (xs, ys))
        ends, groups, pa, pb, mine = sorted(set(ex) & set(ey)), [], 0, 0, []
        for e in ends:
            groups.append(",".join(map(str, a[pa : ex[e] + 1])) + "|" + ",".join(map(str, b[pb : ey[e] + 1])))
            pa, pb = ex[e] + 1, ey[e] + 1
            mine.append((a[ex[e]], b[ey[e]]))
        want.append((i, len(a), len(b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(mine)
        counts.update(mine)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter((i, na, nb, g, len(x), sum(counts[k] == best[k[1]] for k in x), sum(counts[k] for k in x), h) for (i, na, nb, g, h), x in zip(want, links))
    name = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in name) for r in entries.queries()["op12_token_alignment"](spark, sf_dir).collect()) == want
    assert sum(k[1] > 0 for k in want) > 5 and sum(k[1] == 0 for k in want) > 3
    # Stripes with many links are scored by parts, and a stripe's counts come in chunks.
    monkeypatch.setattr(alignment, "PART", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert Counter(tuple(r[c] for c in name) for r in alignment.alignment(docs, *paths).collect()) == want


def test_matrices_by_chunks_and_salts(spark):
    r = np.random.default_rng(5)
    pairs = [r.choice(6, size=4, replace=False) for _ in range(40)]
    table = spark.createDataFrame([(p % 7, 0, p % 3, bytearray(x.astype("<u4").tobytes()), bytearray((x + 1).astype("<u4").tobytes())) for p, x in enumerate(pairs)], "p long, q long, stripe long, pairs binary, n binary")
    got = {}
    for row in alignment.counts(table, (2, 3)).collect():
        got |= {(row["stripe"], int(k)): int(v) for k, v in zip(np.frombuffer(row["pairs"], "<u4"), np.frombuffer(row["counts"], "<i8"))}
    want = Counter()
    for p, x in enumerate(pairs):
        for k in x.tolist():
            want[p % 3, k] += k + 1
    assert got == want


def test_pieces_behind_a_space():
    _, encode = tokenfiles._encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    import pyarrow as pa

    texts = ["", " ", "a b", " a", "a ", "\ta\n b", "x  y", "<|endoftext|> z", "naïve 中文　  q", "a\x1cb \x85c"]
    flat, ends = encode(pa.array(texts), b"", True)
    assert [flat[i:j].tolist() for i, j in zip([0, *ends], ends)] == [ids_of(" " + t, True) for t in texts]
    flat, ends = encode(pa.array(texts), b"")
    assert [flat[i:j].tolist() for i, j in zip([0, *ends], ends)] == [ids_of(t, True) for t in texts]
    assert pieces.merge(" a  b c") == [" a  b", " c"]


def test_audit_agrees_with_every_order(spark, sf_dir, table):
    def split(t):
        return t.encode().split()

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good, toxic = {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1}
    docs = [(i, t or "", s or "") for i, t, _, s in table]
    rows_ = []
    for i, t, s in docs:
        w = split(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum(c.isascii() and c.isupper() for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)}
        rows_.append((s, fails, i in good, i in toxic))
    want, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for s, fails, g, x in rows_:
            first = next((k for k, f in enumerate(order) if fails[f]), 5)
            if first < 5:
                shapley[s, order[first]] += 1
            for k, f in enumerate(order):
                c = want.setdefault((s, order, k + 1), [0] * 6)
                for j, hit in enumerate((first > k, first == k, fails[f] and first < k, fails[f] and sum(fails.values()) == 1, first == k and g, first == k and x)):
                    c[j] += hit
    out = entries.queries()["op13_filter_audit"](spark, sf_dir).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in out}
    assert got == want and all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in out)
    assert all(any(f[k] for _, f, *_ in rows_) for k in "ABCDE")


def test_audit_of_other_filters(spark):
    df = spark.createDataFrame([("p", True, False), ("p", True, True), ("p", False, False)], "part string, x boolean, y boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filters.audit(df, "xy").collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (1, 0, 1, 0, 1), ("yx", 1): (2, 1, 0, 0, 1), ("yx", 2): (1, 1, 1, 1, 3)}
    assert filters.audit(df.withColumn("g", F.col("y")), "xy", lost={"g_lost": "g"}).where("filter_order = 'xy' and step = 1").first().g_lost == 1


_BITS = [*" \n.,'$▁", "  ", "   ", "\t", "\xa0", "　", " ▁", "▁ ", "é", "ﬁ", "中", "😀", "7", "Word", " two", " word", "...", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "\x00", "é"]


def test_links_of_texts_are_those_of_their_pieces():
    import pyarrow as pa

    p, draw = alignment._Pair(*(public_tokenizers.path(x) for x in (tokenfiles.VOCABULARY, alignment.PIECES))), random.Random(3)
    assert p.parted
    some = pa.array(["", " ", *("".join(draw.choices(_BITS, k=draw.randint(1, 40))) for _ in range(1500))])
    plain = pa.array([x.replace("▁", "") for x in some.to_pylist()])
    for texts in (some, plain, some):
        p.parted = True
        got = p.links(texts)
        p.parted = False
        for x, y in zip(got, p.links(texts)):
            assert list(x) == list(y)
        lists = p.b.encode(texts.to_pylist())
        assert all(n in (0, len(x)) for n, x in zip(got[5].tolist(), lists)) and (texts is some or got[5].sum() > 15_000)


def test_pieces_met_before_are_not_aligned_again():
    import pyarrow as pa

    p, seen = alignment._Pair(*(public_tokenizers.path(x) for x in (tokenfiles.VOCABULARY, alignment.PIECES))), []
    made = p.known.encode_pieces
    p.known.encode_pieces = lambda xs: seen.extend(xs) or made(xs)
    first, again = (p.links(pa.array(["one two, three one", "two, one"])) for _ in range(2))
    assert sorted(seen) == [" one", " three", " two,"]
    assert all(list(x) == list(y) for x, y in zip(first, again)) and first[4].tolist() == [5, 3]
