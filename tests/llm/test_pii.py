import re
import time

from loomtext.llm import pii

from .helpers import AWKWARD, LONG, table


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def brute(text):
    text = text or ""
    out = []
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for kind, (rx, ok) in enumerate(rules):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rx, text) if ok(m[0])]
    return sorted(out)


BASE = [
    "mail a.b+c@x-y.example.com, or d@e.f.g. and @no and no@ and a@b",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255 0000000001.1.1.1 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 42795589076491 5500005555555559 12345678901234567890123",
    "call +1 (988) 555-2485 or +49.30.123456 or +1 2 3 or +1234567890123456",
    "4111 1111 1111 1111 1.2.3.4 x@y.z +1 555 555 5555\n" * 3,
]


def test_base_spans_equal_brute_force():
    for text in BASE + [t for _, t in AWKWARD]:
        assert pii.base_spans(text or "") == brute(text)
        base, every = pii.all_spans(text or "")
        assert base == brute(text) and set(base) <= set(every)


DISGUISED = [
    ("write to jane.roe [at] mail8 [dot] example [dot] com now", "email", "jane.roe [at] mail8 [dot] example [dot] com"),
    ("jane(at)example(dot)com", "email", "jane(at)example(dot)com"),
    ("mail jane dot roe at example dot com please", "email", "jane dot roe at example dot com"),
    ("mail jane @ example.com please", "email", "jane @ example.com"),
    ("cyrillic jаnе@exаmple.com here", "email", "jаnе@exаmple.com"),
    ("wide ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ here", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("zero​ width ja​ne@example.com here", "email", "ja​ne@example.com"),
    ("host 29[.]217[.]126[.]147 is down", "ip", "29[.]217[.]126[.]147"),
    ("host 29 [dot] 217 [dot] 126 [dot] 147 is down", "ip", "29 [dot] 217 [dot] 126 [dot] 147"),
    ("call plus one nine eight eight five five five two four eight five today", "phone", "plus one nine eight eight five five five two four eight five"),
    ("call +1 nine eight eight - five five five - two four eight five today", "phone", "+1 nine eight eight - five five five - two four eight five"),
    ("wählen plus vier neun drei null eins zwei drei vier fünf sechs sieben jetzt", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"),
    ("call +1 (988) five five five 2485 today", "phone", "+1 (988) five five five 2485"),
    ("host 29 dot 217 DOT 126 dot 147 is down", "ip", "29 dot 217 DOT 126 dot 147"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
]


def test_disguises_map_back_to_the_source():
    for text, kind, want in DISGUISED:
        base, every = pii.all_spans(text)
        added = [(pii.KINDS[k], text[s:e]) for s, k, e in every if (s, k, e) not in base]
        assert (kind, want) in added, (text, added)


CLEAN = [
    "He looked at the dot on the page and met her at home. One two three, he said.",
    "Привет, это обычный текст; ничего личного. Встреча в 10.30.",
    "Ein Text – mit Gedankenstrich, 1.000.000 Euro und 12:30 Uhr.",
    "un deux trois quatre cinq six sept huit neuf, comptons encore une fois",
    "at dot at dot (at) [dot] <at>",
    "We won five four three two one nil, then four and six and eight, 12 of 30.",
    "10 dot 20 dot 30 and 300 dot 1 dot 1 dot 1",
    "Meet at example dot and come.",
]


def test_clean_texts_get_nothing():
    for text in CLEAN:
        assert pii.all_spans(text) == ([], []), text


def test_query_shape_and_awkward_rows(spark):
    rows = AWKWARD + [(200 + i, t) for i, t in enumerate(BASE)] + [(300 + i, t[0]) for i, t in enumerate(DISGUISED)]
    got = pii.find(table(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base] == brute(texts[r.doc_id])
    assert pii.find(table(spark, [])).count() == 0


def test_redact_keeps_columns_and_rest(spark):
    docs = table(spark, [(1, "a jane@x.org b +1 555 555 5555."), (2, None)])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [email] b [phone].", 2: None}


def test_long_texts_take_linear_time():
    began = time.time()
    pii.all_spans(LONG + " [at] one two " * 2000)
    pii.all_spans("1" * 200_000 + " " + "a" * 200_000 + "@")
    assert time.time() - began < 30
