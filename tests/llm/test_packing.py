import random
import string
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import packing

from .helpers import AWKWARD, table


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(pieces, docs, encoder, limit):
    """An exact round trip: every id in one piece, sequences gapless, padding as counted."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in docs:
        parts = sorted(by_doc[doc_id], key=lambda p: p["start"])
        want = whole(encoder, text)
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).tolist() == want
        assert [p["start"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
        assert {p["doc_tokens"] for p in parts} == {len(want)}
        assert all(len(p["ids"]) == 4 * p["length"] > 0 for p in parts)
    assert set(by_doc) == {d for d, _ in docs}
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
        n = sum(p["length"] for p in parts)
        assert n <= limit
        padding += 0 if n & (n - 1) == 0 else limit - n
    return padding / sum(p["length"] for p in pieces)


def test_ids_of_capitals_with_combining_marks(encoder):
    marks = [chr(c) for c in range(0x300, 0x3100) if unicodedata.combining(chr(c))]
    texts = [" ".join(f"{c}{m}x a{c}{m}. {c.lower()}{m}" for c in string.ascii_uppercase) for m in marks]
    texts += [f"Above {c}\u0323{m} and {c}\u05b0{m}\u0331 Below" for c in string.ascii_uppercase for m in "\u0308\u030a\u030c\u0331\u0344\u0301"]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() + [packing.END_ID] == whole(encoder, text), ascii(text)


def test_ids_by_piece_equal_ids_by_text(encoder):
    texts = [
        "It's Mr. O'Neil's, isn't it?\nYes\t!!\r\n\x0b\x0c done...",
        "é café ́x  nbsp line \x1c\x1dsep 　wide ﬁ ß İI Σας",
        "<|endoftext|> a<|startoftext|>b  12345 １２ ٣٤ 東京。はい",
        "x" * 3000 + " " + "​‍",
        "",
        " \n ",
    ]
    rng = random.Random(3)
    latin = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]
    texts += ["".join(latin[i : i + 20]) for i in range(0, len(latin), 20)] + latin + [f"x{c}y" for c in latin]
    texts += ["word%%% w'' 's' don't'. é... é, »... a». ..a b.c. !!x ?! \x7f\x7f. (a) [b] x_ _y __ z", "end. ", ". .. ... '", "'s 's. x's. x'. '' ' s"]
    alphabet = "ab'st 12.!?%,'»…é́  \x1cÜ<|>\n\tΩ日"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plan_is_the_cheapest(encoder):
    rng = random.Random(4)
    limit = 128
    for _ in range(60):
        at, penalty = [0], [0]
        for _ in range(rng.randint(1, 25)):
            at.append(at[-1] + rng.randint(1, 60))
            penalty.append(rng.choice([0, packing.SENTENCE, packing.HARD]))

        def cost(cuts):
            total, before = 0, 0
            for j in cuts:
                n = at[j] - before
                assert 0 < n <= limit
                total += (0 if n >= 64 and n & (n - 1) == 0 else limit - n) + penalty[j] + packing.EACH
                before = at[j]
            return total

        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            options = [
                best[i] + (0 if (n := at[j] - at[i]) >= 64 and n & (n - 1) == 0 else limit - n) + penalty[j] + packing.EACH
                for i in range(j)
                if at[j] - at[i] <= limit
            ]
            best[j] = min(options)
        cuts = packing.plan(at, penalty, limit)
        assert cuts[-1] == len(at) - 1 and cost(cuts) == best[-1]


@pytest.mark.parametrize("n", [1, 2, 37, 64, 1000, 3000, 4095, 4096])
def test_tail_is_whole(n):
    parts = packing.split_tail(10, 10 + n)
    assert parts[0][0] == 10 and parts[-1][1] == 10 + n
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_round_trip(spark, encoder):
    rows = [r for r in AWKWARD if r[0] not in (None, 13)] + [(100 + i, f"A sentence. Number {i} here! " * (i % 90)) for i in range(300)]
    pieces = packing.pack(table(spark, rows).repartition(3), block=20_000)
    pieces = [r.asDict() for r in pieces.collect()]
    assert check(pieces, rows, encoder, packing.LIMIT) < 0.02


def test_repeated_rows_null_ids_and_empty_table(spark, encoder):
    rows = [(None, "no id"), (3, "twice"), (3, "twice")]
    got = packing.pack(table(spark, rows)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = len(whole(encoder, "twice"))
    assert {r.doc_id: r.n for r in got} == {None: len(whole(encoder, "no id")), 3: 2 * n}
    assert packing.pack(table(spark, [])).count() == 0
