"""Registered queries on the awkward table: columns, types, a row for each document, and what follows from one row to the next."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_operators import LOW
from test_packing_alignment_audit import empty_dir, ids_of, sf_dir, table  # noqa: F401 (fixtures)

from quantloom.llm import entries

KINDS = {
    "op3_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op7_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(KINDS))
def test_a_row_for_each_document(spark, sf_dir, empty_dir, table, name):  # noqa: F811
    df = entries.queries()[name](spark, sf_dir)
    assert dict(df.dtypes) == KINDS[name]
    assert Counter(r.doc_id for r in df.collect()) == Counter(i for i, *_ in table)
    none = entries.queries()[name](spark, empty_dir)
    assert dict(none.dtypes) == KINDS[name] and none.count() == 0


def test_token_files_follow_each_other(spark, sf_dir, table):  # noqa: F811
    rows = sorted(entries.queries()["op7_token_files"](spark, sf_dir).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for i, t, *_ in table for x in (np.array([*ids_of(t or ""), 0], "<u4"),))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_fingerprints_are_written_in_hex(spark, sf_dir, table):  # noqa: F811
    want = Counter()
    for i, t, *_ in table:
        w = (t or "").encode().translate(LOW).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        want[i, f"{sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)):016x}"] += 1
    assert Counter((r.doc_id, r.fingerprint) for r in entries.queries()["op10_simhash_near_dedup"](spark, sf_dir).collect()) == want


def test_decoding_gives_the_text_back(spark, sf_dir, table):  # noqa: F811
    got = Counter((r.doc_id, r.decoded_sha256) for r in entries.queries()["op9_byte_bpe"](spark, sf_dir).collect())
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in table)
