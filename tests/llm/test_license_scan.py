import random
import re

from loomtext.llm import license_scan

from .helpers import AWKWARD, same_as_sql, table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_base(text):
    w = words(text)
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def aligned(text, k=3):
    """Labels and score by trying every template at every place: the method without joins."""
    w, found = words(text), []
    for label, template in license_scan.TEMPLATES:
        t = template.split()
        votes = {}
        for d in range(-len(t), len(w)):
            at = {a for a in range(len(t) - k + 1) if 0 <= d + a <= len(w) - k and w[d + a : d + a + k] == t[a : a + k]}
            if at:
                votes[d] = at
        runs = []
        for d in sorted(votes):
            if not runs or d - runs[-1][-1] > license_scan.DRIFT:
                runs.append([])
            runs[-1].append(d)
        for run in runs:
            at = set().union(*[votes[d] for d in run])
            share = len({a + i for a in at for i in range(k)}) / len(t)
            if share >= license_scan.COVER:
                found.append((min(d + min(votes[d]) for d in run), max(d + max(votes[d]) for d in run) + k - 1, len(at), label, share))
    kept = [x for x in found if not any(y[2] > x[2] and y[0] <= x[1] and y[1] >= x[0] for y in found)]
    base = brute_base(text)
    labels = {x[3] for x in kept} | set(base[4])
    return sorted(labels), round(max([x[4] for x in kept] + [1.0] * bool(base[1]), default=0.0), 6)


HEADER = license_scan.TEMPLATES[0][1]
MIT = dict((label, text) for label, text in license_scan.TEMPLATES)["mit"]
TEXTS = [
    "Released under the MIT License.",
    "under the mit under the mit license under the mit license cc-by-nc CC BY NC",
    "Licensed under the Apache License, Version 2.0.\nMore text.",
    "This work is licensed under the GNU General Public License, version 3.",
    "cc by nc cc by nc by nc cc by",
    "prose before " + MIT.capitalize() + " prose after",
    "prose " + MIT.replace("hereby granted", "granted") + " with one word less",
    "prose " + MIT.replace("free of charge", "free of any extra charge") + " with words more",
    "only a part: permission is hereby granted free of",
    "the license of the mit the license version 2 apache",
    "É under É the mit license",
]


def test_base_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(500 + (i or 0), t) for i, t in AWKWARD if i != 13]
    got = license_scan.scan(table(spark, rows).repartition(3)).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {i: brute_base(t) for i, t in rows}


def test_method_adds_labels(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in license_scan.scan(table(spark, rows)).collect()}
    assert got[3].labels == ["gpl-3"] and got[3].base_labels == []
    assert got[5].labels == ["mit"] and got[5].score == 1.0 and got[5].n_base == 0
    assert got[6].labels == ["mit"] and got[7].labels == ["mit"]  # drift by a lost and by inserted words
    assert got[8].labels == [] and got[8].score == 0.0
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in got.values())
    span = got[5].spans[0]
    assert words(TEXTS[5])[span.start : span.last + 1] == MIT.split()


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(7, TEXTS[0]), (7, TEXTS[0]), (None, TEXTS[0]), (None, None)]
    got = sorted((str(r.doc_id), r.n_base) for r in license_scan.scan(table(spark, rows)).collect())
    assert got == [("7", 1), ("7", 1), ("None", 0), ("None", 1)]
    assert license_scan.scan(table(spark, [])).count() == 0


def test_main_path_has_no_python(spark):
    plan = license_scan.scan(table(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def noisy(rng):
    """Templates with words lost, put in and repeated, between words of other templates."""
    out = []
    for _ in range(rng.randint(1, 3)):
        w = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = rng.choice(["the license", "permission is hereby", "foo", "of the software", ""]).split()
        out += ["own", "words"] * rng.randint(0, 3) + w + rng.choice(license_scan.TEMPLATES)[1].split()[: rng.randint(0, 9)]
    return " ".join(out)


def test_stray_votes_do_not_split_a_license(spark):
    at = HEADER.split()
    stray = [
        " ".join([*at[:10], "permission is hereby", *at[10:]]),
        " ".join([*at[:10], "foo bar baz", *at[10:]]),
        "licensed under the apache license version 2 0 licensed under the the license you may not use this file except in compliance with the license",
    ]
    got = {r.doc_id: r.labels for r in license_scan.scan(table(spark, list(enumerate(stray)))).collect()}
    assert got == {0: ["mit"], 1: ["mit"], 2: ["apache-2"]}


def test_equals_an_aligner_and_the_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(100 + i, noisy(rng)) for i in range(150)] + [(900, None), (901, ""), (902, "one two")]
    got = same_as_sql(spark, tmp_path, "op10_license_scan", rows)
    texts = dict(rows)
    assert [(r[0], r[6], r[7]) for r in got] == [(r[0], ",".join(aligned(texts[r[0]])[0]), aligned(texts[r[0]])[1]) for r in got]
    assert sum(bool(r[6]) for r in got) > 80
