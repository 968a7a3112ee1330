"""Cleaning of extracted records, as expressions over nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: values fixed by the record format
ROLES = ("主事", "参与", "提及")
LEAD, PART = ROLES[0], ROLES[1]
CHANNELS = ("see", "hear", "feel", "do", "say", "recall", "reason")
UNKNOWN = "未明示"


def list_items(items: Column, limit: int, min_length: int = 0) -> Column:
    """Trimmed, long enough, distinct in order, at most limit."""
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.btrim(x))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & (F.length(x) >= min_length))), 1, limit)


def who(people: Column, roles=ROLES, default: str = PART) -> Column:
    """People with unique non-empty names, the first entry of a name; unknown roles become the default."""
    named = F.filter(
        F.transform(
            people,
            lambda p: F.struct(F.btrim(p["name"]).alias("name"), F.when(p["role"].isin(*roles), p["role"]).otherwise(default).alias("role")),
        ),
        lambda p: p["name"].isNotNull() & (p["name"] != ""),
    )
    names = F.array_distinct(F.transform(named, lambda p: p["name"]))
    return F.transform(names, lambda n: F.filter(named, lambda p: p["name"] == n)[0])


def with_actors(people: Column, actors: Column, role: str = PART) -> Column:
    """People, with actors that they lack at the end."""
    names = F.transform(people, lambda p: p["name"])
    missing = F.filter(F.array_distinct(actors), lambda a: a.isNotNull() & (a != "") & ~F.array_contains(names, a))
    return F.concat(people, F.transform(missing, lambda a: F.struct(a.alias("name"), F.lit(role).alias("role"))))


def point_of_view(pov: Column, people: Column, described: str, max_length: int = 20) -> Column:
    """A name, not a description; else the first lead, the first person, or unknown."""
    good = F.when((F.btrim(pov) != "") & (F.length(pov) <= max_length) & ~pov.rlike(described), F.btrim(pov))
    lead = F.get(F.filter(people, lambda p: p["role"] == LEAD), F.lit(0))["name"]
    return F.coalesce(good, lead, F.get(people, F.lit(0))["name"], F.lit(UNKNOWN))


def where_or_unknown(place: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(place), F.lit("")), F.lit(UNKNOWN))


def valid_acts(acts: Column, names: Column) -> Column:
    """Acts and events with content, known channels, and scopes within the names or *."""
    scoped = F.transform(
        acts,
        lambda a: F.struct(
            a["type"].alias("type"),
            a["channel"].alias("channel"),
            F.btrim(a["who"]).alias("who"),
            F.btrim(a["content"]).alias("content"),
            F.filter(F.coalesce(a["scope"], F.array().cast("array<string>")), lambda s: (s == "*") | F.array_contains(names, s)).alias("scope"),
        ),
    )
    kept = F.filter(
        scoped,
        lambda a: (a["content"] != "")
        & (((a["type"] == "event")) | ((a["type"] == "act") & a["channel"].isin(*CHANNELS) & (F.coalesce(a["who"], F.lit("")) != ""))),
    )
    return F.transform(kept, lambda a: a.withField("scope", F.when((a["type"] == "event") & (F.size(a["scope"]) == 0), F.array(F.lit("*"))).otherwise(a["scope"])))


def merge_acts(acts: list[dict], source_length: int, per_key: int = 2) -> list[dict]:
    """At most per_key acts a (type, who, channel), then neighbours merged down to a cap.

    The cap is one act per 60 characters of the source, from 2 to 12. Neighbours merge
    where they have the type and either actor or channel in common; where none do, the
    list stays over the cap.
    """
    cap = max(2, min(12, source_length // 60))
    out: list[dict] = []
    for act in acts:
        same = [a for a in out if all(a.get(k) == act.get(k) for k in ("type", "who", "channel"))]
        if len(same) >= per_key:
            same[-1]["content"] += "；" + act["content"]
        else:
            out.append(dict(act))
    while len(out) > cap:
        at = next(
            (i for i, (a, b) in enumerate(zip(out, out[1:])) if a.get("type") == b.get("type") and (a.get("who") == b.get("who") or a.get("channel") == b.get("channel"))),
            None,
        )
        if at is None:
            break
        out[at]["content"] += "；" + out.pop(at + 1)["content"]
    return out


def within_chapters(events: Column, last: int, pattern: str = "^第([0-9]+)") -> Column:
    """Events whose chapter prefix is at most last; events without one stay."""
    number = lambda e: F.nullif(F.regexp_extract(e, pattern, 1), F.lit(""))
    return F.filter(events, lambda e: number(e).isNull() | (number(e).cast("int") <= last))


def first_seen_within(chapter: Column, last: int) -> Column:
    return F.when(chapter > last, 0).otherwise(chapter)


def score_0_100(value: Column) -> Column:
    """An integer from 0 to 100; 50 where there is none."""
    number = F.round(value.try_cast("double")).cast("int")
    return F.when(number.isNull(), 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), number)))


def any_dimension_set(dims: Column) -> Column:
    """Whether a map of scores has any that is not the neutral 50."""
    return F.exists(F.map_values(dims), lambda v: v != 50)
