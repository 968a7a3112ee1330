from loomtext.llm import simhash

from .helpers import table


def test_rows_that_share_an_id_are_dropped_each_for_itself(spark):
    copy, other, third = "one text that has a copy", "quite different words are in this", "and a third without any likeness here"
    rows = [(5, copy), (5, other), (3, copy), (None, copy), (None, third), (7, third.upper() + " "), (None, "alone with no id at all")]
    got = sorted((r.doc_id or 0, r.text) for r in simhash.dedup(table(spark, rows)).collect())
    assert got == sorted([(5, other), (3, copy), (7, third.upper() + " "), (0, "alone with no id at all")])
