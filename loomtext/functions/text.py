"""Column functions over texts: sentences, classes, sentiment, rhetoric, parsing.

All of them are compositions of built-in functions, so they stay in generated code and
are pushed around by the optimizer. Every threshold and word list is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Marks and cue words of a writing system."""

    enders: str = ".!?"
    question: str = "?"
    exclaim: str = "!"
    dialogue: str = "\"'“”‘’«»"
    removed: str = ",;:\"' "
    rhetorical_cues: Sequence[str] = ()
    connectors: dict[str, Sequence[str]] = field(default_factory=dict)


LATIN = Profile(
    rhetorical_cues=("how could", "is it not", "who would"),
    connectors={
        "contrast": ("but", "however", "yet", "aber", "mais", "pero"),
        "cause": ("because", "for", "denn", "car", "porque"),
        "sequence": ("then", "and", "und", "et", "y"),
    },
)
#: marks and cues fixed by the data format for Chinese prose
CJK = Profile(
    enders="。！？!?",
    question="？?",
    exclaim="！!",
    dialogue="“”「」『』\"＂",
    removed="，、,：:；;“”\"「」 ",
    rhetorical_cues=("难道", "怎能", "怎么可能", "岂", "何必", "何尝"),
)


def char_class(chars: str) -> str:
    """A regex class of the characters that Java and RE2 read alike."""
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"


def lines(text: Column) -> Column:
    """Lines without white space at their ends, blank ones dropped."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(parts, lambda x: x != "")


def sentences(text: Column, profile: Profile = LATIN) -> Column:
    """Sentences with their final mark, trimmed, without empty ones."""
    inner = char_class(profile.enders)
    other = "[^" + inner[1:]
    parts = F.regexp_extract_all(text, F.lit(f"({other}*{inner}|{other}+$)"), F.lit(1))
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def clauses(text: Column, marks: str = ".!?", min_length: int = 1) -> Column:
    """Pieces between marks, the marks dropped, of at least min_length characters."""
    parts = F.transform(F.split(text, char_class(marks)), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.filter(parts, lambda x: F.length(x) >= min_length)


def length_bucket(n: Column, edges: Sequence[int] = (10, 20, 30, 40)) -> Column:
    """The name of the length bucket: '<=10', '<=20', ..., '41+'."""
    out = F.when(n <= edges[0], f"<={edges[0]}")
    for edge in edges[1:]:
        out = out.when(n <= edge, f"<={edge}")
    return out.otherwise(f"{edges[-1] + 1}+")


def sentence_type(sentence: Column, profile: Profile = LATIN) -> Column:
    """rhetorical or question, exclamation, statement, by the final mark and cue words."""
    last = F.right(sentence, F.lit(1))
    question = last.isin(*profile.question)
    cue = F.lit(False)
    for word in profile.rhetorical_cues:
        cue = cue | F.contains(F.lower(sentence), F.lit(word))
    return (
        F.when(question & cue, "rhetorical").when(question, "question").when(last.isin(*profile.exclaim), "exclamation").otherwise("statement")
    )


def connector(sentence: Column, words: Sequence[str]) -> Column:
    """The first listed word that the sentence starts with, or null."""
    low = F.lower(sentence)
    return F.coalesce(*[F.when(low.startswith(w), F.lit(w)) for w in words])


def paragraph_class(text: Column, long_chars: int = 40, long_sentences: int = 3, short_chars: int = 20, marks: str = ".!?") -> Column:
    """long (many characters or sentences), short, or mid."""
    n = F.length(text)
    return (
        F.when((n >= long_chars) | (F.size(clauses(text, marks)) >= long_sentences), "long").when(n <= short_chars, "short").otherwise("mid")
    )


def sentiment(text: Column, positive: str, negative: str, *, mode: str = "char") -> Column:
    """(positive - negative) / max(both, 1) over distinct characters, or words, that occur."""
    have = F.split(text, "") if mode == "char" else F.split(F.lower(text), r"\W+")
    pick = (lambda s: list(dict.fromkeys(s))) if mode == "char" else str.split
    pos, neg = (F.size(F.array_intersect(have, F.array(*map(F.lit, pick(s))))) for s in (positive, negative))
    return F.round((pos - neg) / F.greatest(pos + neg, F.lit(1)), 3)


def pattern_counts(text: Column, patterns: dict[str, str]) -> Column:
    """Counts per pattern as an array of structs (name, n); patterns that never match are left out."""
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.regexp_count(text, F.lit(rx)).cast("long").alias("n")) for name, rx in patterns.items()])
    return F.filter(rows, lambda x: x["n"] > 0)


def parallel_heads(text: Column, marks: str = ".!?", min_length: int = 6, head: int = 2) -> Column:
    """Number of sentence heads that two or more sentences share; 0 unless two heads do."""
    heads = F.transform(clauses(text, marks, min_length), lambda x: F.substring(x, 1, head))
    shared = F.size(F.filter(F.array_distinct(heads), lambda h: F.size(F.filter(heads, lambda x: x == h)) >= 2))
    return F.when(shared >= 2, shared).otherwise(0).cast("long")


def is_dialogue(text: Column, profile: Profile = LATIN) -> Column:
    return text.rlike(char_class(profile.dialogue))


def starts_with_any(text: Column, signals: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | text.startswith(s)
    return out


def chapter_numbers(text: Column, pattern: str = "第([0-9]+)(?:-[0-9]+)?章") -> Column:
    """All chapter numbers that a text mentions, first number of a range."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def relation_parts(text: Column, *, export: bool = True, max_label: int = 40) -> Column:
    """(target, label) of "与X：label" (export) or "X：label"."""
    rx = "与(.+?)[:：](.*)" if export else "^([^:：]{1,12})[:：](.*)"
    target = F.regexp_extract(text, rx, 1)
    return F.when(target != "", F.struct(target.alias("target"), F.substring(F.btrim(F.regexp_extract(text, rx, 2)), 1, max_label).alias("label")))


def slug(text: Column) -> Column:
    """Runs of characters that are neither word characters nor CJK become one underscore."""
    return F.regexp_replace(text, r"[^\w一-鿿]+", "_")


def content_key(model: Column, text: Column) -> Column:
    """SHA-1 of model, NUL and text: the key of model results."""
    return F.sha1(F.concat_ws("\x00", model, text).cast("binary"))


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / max(whole, 1), rounded."""
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def clipped(text: Column, limit: int) -> Column:
    """A text cut to a budget of characters."""
    return F.substring(F.coalesce(text, F.lit("")), 1, limit)


def duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s."""
    s = seconds.cast("long")
    return (
        F.when(s >= 3600, F.format_string("%dh%02dm%02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))
        .when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def short_count(n: Column) -> Column:
    """1234 as 1.2k, 1234567 as 1.2M."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6))).when(n >= 1000, F.format_string("%.1fk", n / F.lit(1e3))).otherwise(n.cast("string"))
    )


def progress_bar(done: Column, total: Column, width: int = 16) -> Column:
    filled = F.least(F.lit(width), F.floor(done * width / F.greatest(total, F.lit(1)))).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled))


def time_left(done: Column, total: Column, elapsed: Column) -> Column:
    """Remaining seconds at the rate so far; null before the first is done."""
    return F.when(done > 0, (total - done) * elapsed / done)
