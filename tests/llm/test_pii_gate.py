from loomtext.llm import pii


def test_words_and_digits_in_alternation_are_looked_at():
    assert pii.normalise("call five 5 five 1 two 1 two 3 four 7 now") is not None
    assert pii.normalise("no number in 3 lines of text") is None
