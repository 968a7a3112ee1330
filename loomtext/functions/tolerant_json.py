"""Tolerant parsing of model answers: fenced, wrapped, single or truncated JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(raw: Column) -> Column:
    """The text inside a code fence, or the text itself, trimmed."""
    inside = F.regexp_extract(raw, r"(?s)```[A-Za-z]*\s*(.*?)\s*```", 1)
    return F.btrim(F.when(inside != "", inside).otherwise(raw), F.lit(" \t\r\n"))


def _parsed(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def as_object(raw: Column) -> Column:
    """The JSON object of an answer as normalised text: whole, or from the first { to the last }."""
    text = unfenced(raw)
    whole = _parsed(text)
    return F.coalesce(F.when(whole.startswith("{"), whole), _parsed(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def as_array(raw: Column, wrappers: Sequence[str] = ("entities", "data", "result", "terms", "items"), required: str = "name") -> Column:
    """The JSON array of an answer as array<variant>.

    A list; a list under one of the wrappers; a single object with the required key; else
    whole objects with that key, salvaged from a truncated answer. Unusable answers give
    an empty array.
    """
    text = unfenced(raw)
    variant = F.try_parse_json(text)
    kind = F.schema_of_variant(variant)
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(variant, "$", "array<variant>"))
    wrapped = [F.try_variant_get(variant, f"$.{w}", "array<variant>") for w in wrappers]
    single = F.when(F.try_variant_get(variant, f"$.{required}", "string").isNotNull(), F.array(variant))
    pieces = F.regexp_extract_all(text, F.lit(r'(\{[^{}]*"' + required + r'"[^{}]*\})'), F.lit(1))
    salvaged = F.filter(F.transform(pieces, lambda p: F.try_parse_json(p)), lambda v: v.isNotNull())
    return F.coalesce(listed, *wrapped, single, F.when(variant.isNull(), salvaged), F.array().cast("array<variant>"))


def text_of(variant: Column, keys: Sequence[str]) -> Column:
    """The first non-blank text under one of the keys."""
    return F.coalesce(*[F.nullif(F.btrim(F.try_variant_get(variant, f"$.{k}", "string")), F.lit("")) for k in keys])


def texts_of(variant: Column, key: str) -> Column:
    """An array of strings under the key; empty if absent."""
    return F.coalesce(F.try_variant_get(variant, f"$.{key}", "array<string>"), F.array().cast("array<string>"))
