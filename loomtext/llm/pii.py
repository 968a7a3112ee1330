"""Personal data, plain and disguised, with offsets into the original text.

Base spans are leftmost non-overlapping matches per kind on the text as it is: email,
ip (parts at most 255), card (14 to 19 digits that pass Luhn) and phone (10 to 15
digits). A match that fails its test is dropped and not tried again.

Disguises are undone by transducers, each a map from stretches of the input to
replacement text that carries source offsets along:

* homoglyphs: look-alike Cyrillic and Greek letters, full-width forms, digits of other
  scripts, and invisible characters, which vanish;
* spelled digits: runs of number words (English, German, French, Spanish) and digits, with
  at least `WORDS` words and `DIGITS` digits in all, and a "plus" before them;
* at and dot: bracketed anywhere, as plain words only where a whole address with a known
  ending, or four numbers, read so.

The base patterns then run on the normalised text, and matches that contain a changed
character are mapped back to the source characters that they came from. They are added
where they touch no base span, or hold whole base spans of their own kind with more
around them; base spans always stay.

A text that shows none of the signs of a disguise is not normalised at all. Work is
per text, in Arrow batches, without a shuffle, so nothing is skewed by a hot group.

Defined results: null text is empty and has no spans; rows, also repeated ones, each get
their result. Other columns are not looked at; an empty table gives an empty result.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
UNITS, WORDS, DIGITS = 4, 3, 10

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _is_card(match: str) -> bool:
    digits = re.sub(r"[^0-9]", "", match)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = domain.end()
                yield start, free
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Fours of numbers joined by dots, from the left of each chain; parts at most 255."""
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in four) and all(int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    # a cheap look for a character that every match has
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(a, 1, b) for a, b in _ips(text)]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and _is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


# --- transducers ---------------------------------------------------------------------

#: look-alikes of ASCII letters, by the letter that they look like
_LOOKS = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ց", "h": "һ", "i": "іι", "j": "ј", "k": "κк", "l": "ӏ",
    "m": "м", "n": "п", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ѡԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。｡", "-": "‐‑‒–−﹣", "+": "﹢➕",
}


def _table() -> dict[int, str]:
    table = {ord(c): to for to, like in _LOOKS.items() for c in like}
    table |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
    table |= {ord(c): " " for c in "   　"}
    table |= {ord(c): "" for c in "­​‌‍‎‏⁠﻿"}
    return table


_GLYPHS = _table()
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_GLYPHS)) + r"]|\d")

_WORDS = {
    "0": "zero oh null nul cero zéro", "1": "one eins un uno une", "2": "two zwei deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf fuenf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve", "+": "plus",
}
_SPELLED = {w: to for to, words in _WORDS.items() for w in words.split()}
_NUMBER_WORD = "|".join(sorted(map(re.escape, _SPELLED), key=len, reverse=True))
_SEP = r"[ \t,./()-]{1,3}"
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:{_NUMBER_WORD}|[+(]{{0,2}}[0-9]+)(?:{_SEP}(?:{_NUMBER_WORD}|[0-9]+)){{{UNITS - 1},}}(?!\w)", re.I)
_TOKEN = re.compile(rf"(?<!\w)(?:{_NUMBER_WORD})(?!\w)", re.I)
#: A number word beside a number word or a digit: every run that _digit_edits() takes has one.
_TWO_UNITS = re.compile(rf"(?<!\w)(?:{_NUMBER_WORD}){_SEP}(?:(?:{_NUMBER_WORD})(?!\w)|[0-9])|[0-9]{_SEP}(?:{_NUMBER_WORD})(?!\w)", re.I)

_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|@|ät|arroba|arobase)\s{0,3}[\])}>]\s{0,3}", re.I)
_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punkt|point|punto)\s{0,3}[\])}>]\s{0,3}", re.I)
_ENDINGS = "com|org|net|edu|gov|info|io|dev|app|biz|name|example|test|co|uk|us|eu|de|fr|es|it|nl|ch|at|be|ca|au|jp"
_PLAIN = re.compile(
    rf"(?<![\w.@%+-])[A-Za-z0-9._%+-]++(?:\s{{1,3}}dot\s{{1,3}}[A-Za-z0-9._%+-]++){{0,4}}(\s{{1,3}}at\s{{1,3}}|\s{{0,3}}@\s{{0,3}})"
    rf"[A-Za-z0-9-]++(?:(?:\s{{1,3}}dot\s{{1,3}}|\s{{0,3}}\.\s{{0,3}})[A-Za-z0-9-]++){{0,6}}?(?:\s{{1,3}}dot\s{{1,3}}|\.)(?:{_ENDINGS})(?!\w)",
    re.I,
)
_PLAIN_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s{1,3}dot\s{1,3}[0-9]{1,3}){3}(?!\w)", re.I)
_PLAIN_AT = re.compile(r"\s+at\s+|\s*@\s*", re.I)
_PLAIN_DOT = re.compile(r"\s+dot\s+|\s*\.\s*", re.I)
_SIGNS = re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|\.|ät|arroba|arobase|punkt|point|punto)\s{0,3}[\])}>]|\bdot\b|\s@|@\s", re.I)


class Mapped:
    """A text with, for each character, the source stretch and whether it was changed."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply sorted, disjoint edits (from, to, replacement)."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for a, b, to in edits:
            text += [self.text[at:a], to]
            start += self.start[at:a] + [self.start[a]] * len(to)
            end += self.end[at:a] + [self.end[b - 1]] * len(to)
            changed += self.changed[at:a] + b"\1" * len(to)
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ODD.finditer(text):
        c = m[0]
        if c > "\x7f":
            to = _GLYPHS.get(ord(c))
            out.append((m.start(), m.end(), str(unicodedata.decimal(c)) if to is None else to))
    return out


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Number words become digits and separators between them vanish."""
    out = []
    for m in _SPELLED_RUN.finditer(text):
        inside = list(_TOKEN.finditer(text, m.start(), m.end()))
        if len(inside) < WORDS or len(inside) + len(_DIGIT.findall(m[0])) < DIGITS:
            continue
        at = m.start()
        if (plus := re.search(r"(?<!\w)plus[ \t]+$", text[max(0, at - 8) : at], re.I)) is not None:
            out.append((max(0, at - 8) + plus.start(), at, "+"))
        for word in inside:
            between = text[at : word.start()]
            kept = re.sub(r"[ \t,./()-]", "", between)
            if at < word.start() and kept != between:
                if not kept:
                    out.append((at, word.start(), ""))
                else:  # digits between words stay where they are
                    out += [(at + s.start(), at + s.end(), "") for s in re.finditer(r"[ \t,./()-]+", between)]
            out.append((word.start(), word.end(), _SPELLED[word[0].lower()]))
            at = word.end()
    return [e for e in sorted(out) if e[0] < e[1]]


def _sign_edits(text: str) -> list[tuple[int, int, str]]:
    edits = {(m.start(), m.end()): "@" for m in _AT.finditer(text)} | {(m.start(), m.end()): "." for m in _DOT.finditer(text)}
    return [(a, b, to) for (a, b), to in sorted(edits.items())]


def _plain_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _PLAIN.finditer(text):
        at = _PLAIN_AT.match(text, m.start(1), m.end())
        dots = [d for part in ((m.start(), at.start()), (at.end(), m.end())) for d in _PLAIN_DOT.finditer(text, *part) if d[0] != "."]
        if "@" not in at[0] and not dots:
            continue  # a bare "at" counts only where a dot is spelled, too
        out += ([(at.start(), at.end(), "@")] if at[0] != "@" else []) + [(d.start(), d.end(), ".") for d in dots]
    out += [(d.start(), d.end(), ".") for m in _PLAIN_IP.finditer(text) for d in _PLAIN_DOT.finditer(text, m.start(), m.end())]
    return sorted(out)


def _disjoint(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for e in edits:
        if e[0] >= at:
            out.append(e)
            at = e[1]
    return out


def normalise(text: str) -> Mapped | None:
    """The text with its disguises undone; None where it shows no sign of any."""
    odd = not text.isascii() and _glyph_edits(text)
    if not (odd or _SIGNS.search(text) or _TWO_UNITS.search(text)):
        return None
    mapped = Mapped(text)
    if odd:
        mapped.replace(odd)
    for edits in (_sign_edits, _plain_edits, _digit_edits):
        mapped.replace(_disjoint(edits(mapped.text)))
    return mapped


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: (start, kind number, end), sorted."""
    base = base_spans(text)
    mapped = normalise(text)
    if mapped is None or not any(mapped.changed) and len(mapped.text) == len(text):
        return base, base
    more, taken = [], [bytearray(len(text)) for _ in range(2)]  # by base spans, by added ones
    for s, _, e in base:
        taken[0][s:e] = b"\1" * (e - s)
    for s, kind, e in base_spans(mapped.text):
        a, b = mapped.start[s], max(mapped.end[s:e])
        touched = any(mapped.changed[s:e]) or b - a != e - s
        if not touched or any(taken[1][a:b]):
            continue
        if any(taken[0][a:b]):  # beside base spans only where it has whole ones of its kind in it
            inner = [(x, k, y) for x, k, y in base if x < b and y > a]
            if any(k != kind or x < a or y > b or (x, y) == (a, b) for x, k, y in inner):
                continue
        more.append((a, kind, b))
        taken[1][a:b] = b"\1" * (b - a)
    return base, sorted(base + more)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per document: structs (kind, start, end, base), by start, then kind."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py() or "")
                plain = set(base)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in plain} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, spans_type)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


def redact(docs: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """The documents with every span replaced by its mask; all columns stay."""
    place = docs.columns.index("text")
    names = docs.columns
    ddl = ", ".join(f"c{i} {docs.schema[name].dataType.simpleString()}" for i, name in enumerate(names))

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, k, e in all_spans(text)[1]:
            if s >= at:
                out += [text[at:s], mask.format(kind=KINDS[k])]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([clean(x.as_py()) for x in columns[place]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    source = docs.select(*[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(names)])
    return source.mapInArrow(run, ddl).toDF(*names)
