import hashlib

import pytest

from loomtext.llm import exact_dedup

from .helpers import AWKWARD, table


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda x: (x is not None, x)):
            kept = i == best and left > 0
            left -= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [8, 1 << 12])
def test_marks_equal_brute_force(spark, bits):
    rows = AWKWARD + [(100 + i, f"copy {i % 7}") for i in range(40)]
    got = exact_dedup.mark(table(spark, rows).repartition(5), filter_bits=bits, digest_all=True)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_prefix_alone_does_not_make_copies(spark):
    head = "x" * 5000
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "A"), (4, head)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.mark(table(spark, rows)).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_dedup_returns_documents(spark):
    docs = table(spark, AWKWARD)
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 5, 7, 9, 10, 12, 13]


def test_empty_table(spark):
    docs = table(spark, [])
    assert exact_dedup.mark(docs).count() == 0
    assert exact_dedup.dedup(docs).count() == 0
