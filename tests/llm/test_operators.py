"""The operators of quantloom.llm against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import bpe, katz, langid, mixing, pieces, rptree, simhash, substrings, tokenfiles, topk, toxicity
from quantloom.llm.components import components

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, h long, fp long, pos int, size long, id long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows():
    """Awkward documents: (doc_id, text, lang, source)."""
    base, shared = words(300, 1), words(80, 2)
    out = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", None, None), (4, words(60, 3) + " " + shared + " " + words(30, 4), "de", "b"), (5, shared + "\n" + words(100, 5), "de", "b")]
    out += [(6, None, "en", "a"), (7, "", None, "b"), (8, " \t\n ", "en", None), (9, "12 345 !", "fr", "c"), (10, "Ünï 中文 😀 <|endoftext|>  x", "fr", "c"), (None, base, "en", "a"), (None, None, None, None), (11, "A b", "en", "c"), (11, "A b", "en", "c")]
    out += [(12, words(49, 6), "en", "a"), (13, words(50, 7), "en", "a"), (14, words(50, 7), "en", "a"), (15, words(20_000, 8, 5000), "de", "c"), (16, "x" * 20_000, "en", "a"), (17, shared.upper(), "en", "b")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, 0.5, 1, 2, 3, 4, 5, 6) for r in rows()], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in rows()]


def fingerprint(t):
    w = t.encode().translate(LOW).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    x = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    return x - (1 << 64) if x >> 63 else x


def test_simhash_agrees_with_all_pairs(docs):
    got = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [(i, fingerprint(t)) for i, t in texts()]
    group = list(range(len(fps)))
    for i, (_, a) in enumerate(fps):
        for j, (_, b) in enumerate(fps[:i]):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), k in zip(fps, group) if k == g and i is not None), default=None) for g in group}
    assert got == Counter((i, f, least[g]) for (i, f), g in zip(fps, group))


@pytest.mark.parametrize("dense", [2, 64])
def test_simhash_links_dense_lists_exactly(spark, dense):
    r = random.Random(5)
    centre = r.getrandbits(64)
    some = {centre} | {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(60)} | {r.getrandbits(64) for _ in range(60)}
    some = [x - (1 << 64) if x >> 63 else x for x in some]
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in some], "fp long"), dense)).collect()}
    label = {x: x for x in some}
    for a in some:
        for b in some:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert all(roots.get(x, x) == label[x] for x in some)


def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_substrings_agree_with_a_plain_scan(docs):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect())
    first, want = {}, Counter()
    for i, t in texts():
        w = t.encode().split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    for i, t in texts():
        w = t.encode().split()
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want and any(k[2] for k in got)


def test_mix_reaches_targets(docs):
    out = mixing.mix(mixing.sized(docs.select("doc_id", "source", "text"))).collect()
    size = [len(t.encode().split()) for _, t in texts()]
    by = Counter()
    for r, n in zip(rows(), size):
        by[r[3]] += n
    assert len(out) == len(size) and sum(r.size for r in out) == sum(size)
    weights = dict(zip(sorted((k for k in by if k is not None)) + [None], (1, 2, 3, 1)))
    stopped, share = set(), 0
    while True:
        left = sum(by.values()) - sum(3 * by[k] for k in stopped)
        share = left / sum(w for k, w in weights.items() if k not in stopped)
        more = {k for k in by if k not in stopped and 3 * by[k] < weights[k] * share}
        if not more:
            break
        stopped |= more
    want = {k: 3.0 * by[k] if k in stopped else weights[k] * share for k in by}
    assert sorted({round(r.target, 6) for r in out}) == sorted({round(v, 6) for v in want.values()})
    for source, target in want.items():
        sums = {0}
        for r, n in zip(rows(), size):
            sums |= {x + n for x in sums} if r[3] == source else set()
        whole = math.floor(target / by[source]) * by[source]
        best = min(abs(whole + x - target) for x in sums)
        # What the first step takes of each length stays, here a few words.
        assert abs(sum(r.taken for r in out if abs(r.target - target) < 1e-6) - target) <= best + 5, source
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    again = mixing.mix(mixing.sized(docs.select("doc_id", "source", "text"))).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_knapsack_is_exact():
    r = random.Random(2)
    for _ in range(30):
        sizes, counts = [r.randrange(1, 40) for _ in range(4)], [r.randrange(0, 4) for _ in range(4)]
        budget = r.randrange(0, 120)
        sums = {0}
        for s, n in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        take = mixing.knapsack(np.array(sizes), np.array(counts), budget)
        assert (take <= counts).all() and abs(int((take * sizes).sum()) - budget) == min(abs(x - budget) for x in sums)


def test_bpe_is_that_of_tiktoken(docs):
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for i, t in texts():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs, path).collect())) == want
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in decoded)


def test_transducer_pairs_and_decoder():
    import pyarrow as pa

    c = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    t, r = c.transducer, random.Random(1)
    for _ in range(3000):
        a, b = r.randrange(len(t.ranks)), r.randrange(len(t.ranks))
        if t._is_own(a):
            assert t.follows(a, b) == (t.merge(t.bytes_of[a] + t.bytes_of[b]) == [a, b])
    ids, _ = c.encode(pa.array(["naïve 中文 😀 é" * 20]))
    whole = b""
    for i in ids:
        part = c.decoder.feed(np.array([i]))
        part.decode()  # characters are whole
        whole += part
    assert (whole + c.decoder.close()).decode() == "naïve 中文 😀 é" * 20


def test_pieces_are_cut_only_where_they_may_be():
    import pyarrow as pa

    e = pieces.PieceEncoder(lambda xs: [x.encode() for x in xs], "u1", 3000)
    for _ in range(2):
        some = ["a b", " a  b\n c ", None, "x \n y", "", " ", "a b", "a\n b c", "d e\n"] + [words(40, k) for k in range(6)]
        ids, ends = e.encode(pa.array(some), b"!")
        assert ids.tobytes().decode() == "".join(f"{x or ''}!" for x in some)
        assert ends.tolist() == np.cumsum([len(x or "") + 1 for x in some]).tolist()
    assert pieces.merge(" a  b\n c d") == [" a  b\n c", " d"]


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path, vocabulary = f"file://{tmp_path}/ids", public_tokenizers.path(tokenfiles.VOCABULARY)
    tokenfiles.write(docs, path, vocabulary, 20_000)
    t = Tokenizer.from_file(vocabulary)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts() if i is not None}
    got = tokenfiles.shards(spark, path).mapInArrow(tokenfiles._rows, tokenfiles._ROW).collect()
    assert len(got) == len(rows())
    assert all(r.n_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) for r in got if r.doc_id is not None)
    tokenfiles.write_manifest(spark, path)
    found = tokenfiles.lookup(spark, path, spark.createDataFrame([(k,) for k in (1, 10, 11, 999, -4)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in found) == {1: 1, 10: 1, 11: 2} and all(list(r.ids) == ids[r.doc_id] for r in found)


def test_memory_of_the_transducer_is_bounded_within_a_match():
    t, x = bpe.codec(public_tokenizers.path(bpe.VOCABULARY)).transducer, "".join(random.Random(8).choices("abcdefgh", k=30_000)).encode()
    want, small = t.encode(x), bpe.Transducer(t.ranks, 200_000)
    assert small.encode(x) == want and small.used < 210_000


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 7, 1000):
        keys = np.random.default_rng(n).choice(10**12, n, replace=False) - 5 * 10**11
        assert sorted(tokenfiles.PerfectHash.build(keys).slots(keys).tolist()) == list(range(n)) if n else True


def plain_katz(data, cutoff=5):
    """doc_id -> list of results, by dictionaries: (n_tokens, n_known, N, base, score); and the sums of probabilities by history."""
    toks = lambda t: [*(t or "").encode().translate(LOW).split(), b"\n"]
    train = [t for _, t, learn in data if learn]
    c = Counter(w for t in train for w in toks(t))
    two = Counter(z for t in train for z in zip([b"\n", *toks(t)], toks(t)))
    n, v = sum(c.values()), len(c)

    def ratios(counts):
        of = Counter(counts)
        last = (cutoff + 1) * of[cutoff + 1] / of[1] if of[1] else 1.0
        d = {}
        for r in range(1, cutoff + 1):
            x = ((r + 1) * of[r + 1] / (r * of[r]) - last) / (1 - last) if of[r] and last < 1 else -1
            d[r] = x if 0 < x < 1 else 1 - min(0.9, of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5) / r
        return d

    d1, d2 = ratios(c.values()), ratios(two.values())
    freed = sum((1 - d1.get(x, 1)) * x for x in c.values())
    uni = lambda w: (d1.get(c[w], 1) * c[w] if c[w] else freed or 1.0) / (n + (0 if freed else 1))
    after = {}
    for (h, w), x in two.items():
        after.setdefault(h, []).append((w, x))
    norm, alpha, sums = {}, {}, {}
    for h, ws in after.items():
        total, left, seen = sum(x for _, x in ws), sum(d2.get(x, 1) * x for _, x in ws), sum(uni(w) for w, _ in ws)
        norm[h] = total if total > left else total + 1
        alpha[h] = (1 - left / norm[h]) / (1 - seen)
        sums[h] = left / norm[h] + alpha[h] * (sum(uni(w) for w in c if w not in dict(ws)) + uni(b" "))
    out = []
    for i, t, _ in data:
        ws, s = toks(t), 0.0
        for h, w in zip([b"\n", *ws], ws):
            x = two[h, w]
            s += math.log10(d2.get(x, 1) * x / norm[h] if x else alpha.get(h, 1.0) * uni(w))
        out.append((i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), s))
    return out, sums


@pytest.mark.parametrize("p", [katz.KatzParams(), katz.KatzParams(head=40, run_tokens=300, part_tokens=150, often=3), katz.KatzParams(head=0, run_tokens=100), katz.KatzParams(head=5, often=1, part_tokens=20)])
def test_katz_agrees_with_plain_counts(spark, p):
    r = random.Random(3)
    data = [(i, " ".join(f"t{int(r.paretovariate(0.9))}" for _ in range(r.randrange(0, 40))) + " of the" * 3, i % 7 != 2) for i in range(150)]
    data += [(200, None, True), (None, "t1 t2 new", False), (201, "t1 T2", True), (201, "t1 T2", True), (202, "unseen unseen words words unseen", False)]
    want, sums = plain_katz(data)
    assert all(abs(x - 1) < 1e-9 for x in sums.values())
    got = katz.score(spark.createDataFrame(data, "doc_id long, text string, learn boolean").repartition(3), p).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1:4])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-8 and abs(a[5] - b[5]) < 1e-8, (a, b)


def test_katz_without_training(spark):
    got = katz.score(spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, learn boolean")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_language_and_toxicity(spark, docs):
    r = random.Random(4)
    tongues = {"aa": ["kala", "mala", "vala"], "bb": ["schrunz", "knorz", "pflug"], "cc": ["ieu", "oui", "eau"]}
    data = [(i, " ".join(r.choice(tongues[k]) for _ in range(r.randrange(2, 30))) + (" awful stuff" if i % 5 == 0 else ""), k) for i, k in enumerate(sorted(tongues) * 100)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    m = langid.fit(langid.training_rows(df))
    got = langid.predict(df, m).collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.99 * len(got) and all(0 <= x.score <= 1 for x in got)
    odd = {(x.doc_id, x.text): (x.lang_pred, x.score) for x in langid.predict(docs.select("doc_id", "text"), m).collect()}
    assert odd[6, None] == odd[7, ""] == odd[9, "12 345 !"] == ("und", 0.0)
    assert langid.predict(df.select("doc_id", "text"), langid.fit(langid.training_rows(df.where("false")))).where("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _, _ in data if i % 3], "doc_id long, toxic int")
    tox = {x.doc_id: x.score for x in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all((tox[i] >= 0.5) == (i % 5 == 0) for i, _, _ in data)
    assert toxicity.score(docs, toxicity.fit(df, labels)).count() == len(rows())
    assert {x.score for x in toxicity.score(docs, toxicity.fit(df, labels.where("false"))).collect()} == {0.0}


def vectors():
    g = np.random.default_rng(6)
    x = g.normal(size=(600, 16))
    x[300:420] = x[:120] + 0.08 * g.normal(size=(120, 16))
    x[500:520] = x[500]
    out = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    return [*out, (700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (None, out[3][1]), (704, out[3][1]), (705, [float("inf")] * 16)]


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in vectors()], "vec_id long, embedding array<float>, label int, n long")


def test_exact_top_k(spark, embeddings):
    table = topk.clean(embeddings.select("vec_id", "embedding")).select("vec_id", F.transform("v", lambda x: F.floor(64 * x).cast("double")).alias("v"))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table.where("vec_id % 20 = 0"), table, topk.TopKParams(k=20, block=50, centres=9, pivots=4)).collect()}
    fine = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in vectors() if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in fine:
        if i % 20 == 0:
            best = sorted(((-int(q @ c), j) for j, c in fine if j != i))[:20]
            want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert got == want
    assert topk.top_k(table.where("false"), table.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 26])
def test_exact_top_k_of_large_scores_and_repeated_ids(spark, scale):
    r = np.random.default_rng(9)
    v = r.integers(-9, 10, (300, 6)) * scale + r.integers(0, 3, (300, 6))
    v[50:90] = v[50]  # ties
    ids = [i // 2 if i < 60 else i for i in range(300)]
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v)], "vec_id long, v array<double>").repartition(3)
    got = {(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(table.where("vec_id % 5 = 0"), table, topk.TopKParams(k=7, block=40, centres=6, pivots=5)).collect()}
    want = set()
    for i in sorted(set(ids)):
        if i % 5 == 0:
            q = min(tuple(row) for j, row in zip(ids, v.tolist()) if j == i)
            best = sorted((-sum(a * b for a, b in zip(q, row)), j) for j, row in zip(ids, v.tolist()) if j != i)[:7]
            want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert got == want and (scale == 1 or max(s for *_, s in got) > 2**53)


def test_exact_top_k_beyond_doubles(spark):
    rows = [(1, 1 << 30, 1 << 30), (2, (1 << 30) + 1, (1 << 30) + 40), (3, (1 << 30) + 2, (1 << 30) + 38), (4, (1 << 30) + 3, (1 << 30) + 37), (5, (1 << 30) + 1, (1 << 30) + 39)]
    table = spark.createDataFrame([(i, [float(a), float(b)]) for i, a, b in rows], "vec_id long, v array<double>")
    query = spark.createDataFrame([(0, [float((1 << 30) + 1), float((1 << 30) + 3)])], "vec_id long, v array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(query, table, topk.TopKParams(k=3)).orderBy("rank").collect()]
    best = sorted(((-(((1 << 30) + 1) * a + ((1 << 30) + 3) * b), i) for i, a, b in rows))[:3]
    assert got == [(i, -s) for s, i in best]


def test_forest_finds_the_links(spark, embeddings):
    out = rptree.near_duplicates(embeddings, rptree.ForestParams(leaf=60)).collect()
    fine = [(i, np.array(v, float)) for i, v in vectors() if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v for _, v in fine])
    n = np.sqrt((x * x).sum(1))
    link = (x @ x.T) / np.outer(n, n) >= 0.95
    np.fill_diagonal(link, False)
    want = dict(zip((i for i, _ in fine), link.sum(1).tolist()))
    got = {r.vec_id: r.n_links for r in out if r.vec_id in want}
    assert len(out) == len(vectors()) and sum(got.values()) >= 0.9 * sum(want.values()) and all(got[k] <= want[k] for k in want)
    by = {r.vec_id: r for r in out}
    assert by[704].component_id == 3 and not by[704].kept and by[3].kept and by[500].n_links == 19
    assert all(by[i].n_links == 0 and by[i].kept for i in (700, 701, 702, 703, 705, None))
    assert rptree.near_duplicates(embeddings.where("false")).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(50)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in alone}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    path = public_tokenizers.path(bpe.VOCABULARY)
    assert simhash.near_duplicates(none).count() == substrings.remove_repeats(none).count() == bpe.digests(none, path).count() == 0
    assert mixing.mix(mixing.sized(none.select("doc_id", "source", "text"))).count() == katz.score(none.select("doc_id", "text", F.lit(True).alias("learn"))).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as cp

    more = [(1000 + i, words(60, 50 + i, 60), ("en", "de")[i % 2], "ab"[i % 2], 9, 0.5, 1, 2, 3, 4, 5, 6) for i in range(40)]
    clash = {c: F.lit(7) for c in ("lang_pred", "t1", "t2", "u", "k", "times", "alike", "copy", "n_words", "n_removed", "kept_text", "Root", "s", "taken")}
    table = docs.unionByName(spark.createDataFrame(more, SCHEMA)).withColumns(clash)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    d = cp.documents(spark, str(tmp_path))
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        before, d = d, cp.materialise(stage(spark, d, str(tmp_path)))
        assert d.columns == before.columns, k
        ids = {r.doc_id for r in d.collect()}
        assert k > 2 or {1000 + i for i in range(40)} <= ids
        if k == 0:
            assert not ids & {6, 7, 8, 9}
        if k == 1:
            assert not ids & {2, 14} and 1 in ids
    out = cp.run(spark, str(tmp_path)).collect()
    assert out and all(len(r.ids) == r.n_tokens for r in out)


_ODD = [*" \n.,'$a", "  ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", "​", "×", "÷", "é", "ß", "д", "ѿ", "҂", "中", "ﬁ", "😀", "é", "7", "½", "'s", "'ll", "Word", " two", "...", "#%&*", "_", "|", "<|endoftext|>", "<|", "|>", "ª", "ʰ", "ͅ"]


@pytest.mark.parametrize("ordinary", [False, True])
def test_texts_cut_at_marks_and_newlines_have_the_librarys_ids(ordinary):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, draw = public_tokenizers.path(tokenfiles.VOCABULARY), random.Random(5)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = ordinary
    some = [None, "", *("".join(draw.choices(_ODD, k=draw.randint(1, 40))) for _ in range(3000))]
    want = [[list(e.ids) for e in t.encode_batch([before + (x or "") for x in some], add_special_tokens=False)] for before in ("", " ")]
    _, encode = tokenfiles._encoder(path, ordinary)
    for spaced in (False, True, False):
        ids, ends = encode(pa.array(some), b"", spaced)
        assert [ids[i:j].tolist() for i, j in zip([0, *ends], ends)] == want[spaced]


def test_a_word_is_encoded_once_whatever_stands_behind_it():
    import pyarrow as pa

    seen = []
    e = pieces.PieceEncoder(lambda xs: seen.extend(xs) or [x.encode() for x in xs], "u1", 1 << 20, True)
    text = "a word. word, word\nword $5 word... word"
    assert e.encode(pa.array([text, text]))[0].tobytes().decode() == text * 2
    assert sorted(seen) == sorted(["a", " word", ".", ",", "\n", "word", " $5", "..."])
