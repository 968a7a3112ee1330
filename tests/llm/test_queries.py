"""The thin queries: columns, types and digests of the contract."""

import hashlib
import zlib

import numpy as np
import xxhash

from loomtext.llm import packing, pii

from .helpers import AWKWARD, query, write_tables

ROWS = [r for r in AWKWARD if r[0] not in (None, 6, 7, 13)] + [(40 + i, f"write to a{i}@b.org or 10.0.0.{i}, some words number {i}") for i in range(6)]


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_simhash_query(spark, tmp_path):
    got = query(spark, write_tables(spark, tmp_path, ROWS), "op2_simhash")
    assert types(got) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    prints = {r.doc_id: r.fingerprint for r in got.collect()}
    for doc_id, text in ROWS:
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert prints[doc_id] == f"{want:016x}"


def test_pii_query(spark, tmp_path):
    got = query(spark, write_tables(spark, tmp_path, ROWS), "op4_pii")
    assert {k: v for k, v in types(got).items() if k != "n_all"} == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in pii.KINDS}, "base_sha256": "string", "spans": "string"}
    rows = {r.doc_id: r for r in got.collect()}
    for doc_id, text in ROWS:
        base, every = pii.all_spans(text or "")
        told = [",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans) for spans in (base, every)]
        assert (rows[doc_id].base_sha256, rows[doc_id].spans) == (hashlib.sha256(told[0].encode()).hexdigest(), told[1])
        assert [rows[doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]


def test_packing_query(spark, tmp_path):
    got = query(spark, write_tables(spark, tmp_path, ROWS), "op6_packing")
    assert types(got) == {"doc_id": "bigint", **{c: "bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}}
    tokenizer = packing.Encoder().tokenizer
    rows = got.collect()
    for doc_id, text in ROWS:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        parts = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert [(r.ids_crc32, r.doc_tokens) for r in parts] == [(zlib.crc32(ids[r.start : r.start + r.length].tobytes()), len(ids)) for r in parts]
        assert sum(r.length for r in parts) == len(ids)
