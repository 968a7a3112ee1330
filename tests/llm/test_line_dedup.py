import random

from loomtext.llm import line_dedup

from .helpers import AWKWARD, same_as_sql, table


def brute(rows):
    """Sorted (doc_id, text, n_removed); of rows with the same id the first in the table is the earlier."""
    first, out = {}, []
    for n, (doc_id, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        lines = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        gone = set()
        for at in zip(lines, lines[1:], lines[2:]) if len(lines) > 2 else [lines] if lines else []:
            if first.setdefault(tuple(x for _, x in at), (n, at[0][0])) != (n, at[0][0]):
                gone.update(range(at[0][0], at[-1][0] + 1))
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append((doc_id or -1, kept or "", kept is None, len(gone)))
    return sorted(out)


def run(docs):
    return sorted((r.doc_id or -1, r.text or "", r.text is None, r.n_removed) for r in line_dedup.dedup(docs).collect())


def test_equals_brute_force(spark):
    rng = random.Random(9)
    rows = AWKWARD + [(20, "a\nb"), (21, "a\nb"), (22, "x\n" * 9), (23, " a \n\n b\t\nc\r\n"), (24, "a\nb\n\n\nc"), (25, "q\na\nb\nc\nd\ne")]
    for i in range(120):
        rows.append((100 + i, "\n".join(rng.choice(["one", "two", "", " three", "four", "five\t"]) for _ in range(rng.randint(0, 12)))))
    assert run(table(spark, rows).repartition(3)) == brute(rows)


def test_a_passage_goes_from_all_but_the_first(spark):
    passage = "\n".join(f"line {i} of the passage" for i in range(6))
    rows = [(i, f"own start {i}\n{passage}\nown end {i}") for i in range(30)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(table(spark, rows).repartition(4)).collect()}
    assert got[0] == (rows[0][1], 0)
    assert all(got[i] == (f"own start {i}\nown end {i}", 6) for i in range(1, 30))


def test_rows_that_share_an_id_or_have_none_keep_their_own_lines(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (2, "u\nv\nw\nx"), (2, "u\nv\nw\ny"), (None, "k\nl\nm"), (None, "only\nhere\never"), (None, "k\nl\nm"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    got = run(table(spark, rows))
    assert got == brute(rows)
    assert (2, "u\nv\nw\nx", False, 0) in got and (-1, "only\nhere\never", False, 0) in got


def test_empty_table(spark):
    assert line_dedup.dedup(table(spark, [])).count() == 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = [r for r in AWKWARD if r[0] not in (None, 13)] + [(20 + i, f"{'x' * (i % 3)}\n\nb {i % 4}\n" + "c\nd" * (i % 2)) for i in range(40)]
    same_as_sql(spark, tmp_path, "op3_line_dedup", rows)
