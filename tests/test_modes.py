import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from loomtext.operators import folds
from loomtext.plans import modes
from loomtext.plans.book import build_runner
from loomtext.plans.models import Offline

ACTS = "array<struct<type:string,channel:string,who:string,content:string,scope:array<string>>>"
PEOPLE = "array<struct<name:string,role:string>>"
RECORDS = f"book string, chapter_no int, scene_id string, who {PEOPLE}, actinfo {ACTS}, notes string, `where` string, extract_status string"


@dataclass(frozen=True)
class Scripted:
    """Answers by the first rule (stage, part of the prompt) that fits."""

    rules: tuple
    name: str = "scripted"

    def answer(self, stage, prompts):
        return [next((a for s, part, a in self.rules if s == stage and part in p), "no answer") for p in prompts]


def record(book, chapter, scene, names, acts=(), status="ok", place="hall"):
    return (book, chapter, f"{book}#{scene}", [(n, "参与") for n in names], [("act", "do", w, c, ["*"]) for w, c in acts], "", place, status)


def test_model_scenes(spark, tmp_path):
    rows = [(b, 1, first + i, f"{b} line {i}") for b, first, n in (("a", 5, 30), ("b", 100, 20), ("c", 1, 3)) for i in range(n)]
    paras = spark.createDataFrame(rows, "book string, chapter_no int, para_id int, text string")
    listed = json.dumps([{"start": 5, "end": 15}, {"start": 16, "end": 24}, {"start": 25, "end": 34}])
    model = Scripted((("bounds", "a line 0", f"```json\n{listed}\n```"), ("bounds", "c line 0", '{"starts": []}')))
    got = modes.model_scenes(spark, paras, ["book", "chapter_no"], "para_id", model, str(tmp_path / "c"))
    cut = {}
    for r in got.orderBy("book", "event_seq").collect():
        cut.setdefault(r.book, []).append((r.event_seq, r.start, r.end, r.size))
    assert cut["b"] == [(1, 100, 119, 20)] and cut["c"] == [(1, 1, 3, 3)]
    assert [x[1] for x in cut["a"]] == [5, 16, 25] and cut["a"][-1][2] == 34 and sum(x[3] for x in cut["a"]) == 30
    assert modes.model_scenes(spark, paras.limit(0), ["book", "chapter_no"], "para_id", model, str(tmp_path / "c")).count() == 0


ONE = {"who": [{"name": " Ann ", "role": "主事"}, {"name": "Ann", "role": "x"}, {"name": "Bob", "role": "boss"}], "what": " falls ", "when": {"day": 1}, "where": " "}
TWO = {
    "pov": "第三人称",
    "emotion": "sad",
    "rhetoric": ["a", "b", "c", "d"],
    "key_sentences": ["short", "long enough to stay"],
    "keywords": ["k", "k", ""],
    "beats": [{"anchor": "third", "content": "late"}, {"anchor": "first", "content": "early"}, {"anchor": "", "content": "lost"}, {"anchor": "second", "content": ""}],
}


@pytest.mark.parametrize("rounds", [1, 2])
def test_detailed_scenes(spark, tmp_path, rounds):
    rows = [(s, 7, [f"{s} first", "second", "third"], tail) for s, tail in (("good", "tail"), ("bad1", None), ("bad2", ""))]
    scenes = spark.createDataFrame(rows, "scene_id string, first int, texts array<string>, prev_tail string")
    answers = (("record", "good", json.dumps(ONE | TWO)), ("round1", "good", json.dumps(ONE)), ("round1", "bad2", json.dumps(ONE)), ("round2", "good", json.dumps(TWO)))
    got = {r.scene_id: r for r in modes.detailed_scenes(spark, scenes, Scripted(answers), str(tmp_path / "c"), rounds=rounds).collect()}
    failed = {"bad1": "single_round_parse_fail", "bad2": "single_round_parse_fail"} if rounds == 1 else {"bad1": "round1_parse_fail", "bad2": "round2_parse_fail"}
    assert {s: r.extract_status for s, r in got.items()} == failed | {"good": "ok"}
    r = got["good"]
    assert [tuple(p) for p in r.who] == [("Ann", "主事"), ("Bob", "参与")] and r.what == "falls" and r["where"] == "未明示" and r.pov == "Ann"
    assert json.loads(r.when) == {"day": 1} and r.emotion == "{}" and r.rhetoric == ["a", "b", "c"]
    assert r.key_sentences == ["long enough to stay"] and r.keywords == ["k"]
    assert [(b.beat, b.start, b.end, b.content) for b in r.beats] == [(1, 7, 8, "early"), (2, 9, 9, "late")]
    assert got["bad1"].beats == []
    assert modes.beat_rows(spark.createDataFrame(list(got.values()))).count() == 2
    with pytest.raises(ValueError):
        modes.detailed_scenes(spark, scenes, Offline(), str(tmp_path / "c"), rounds=3)


def test_knowledge(spark, tmp_path):
    rows = [record("a", 1, 1, ["Ann"]), record("a", 2, 2, ["Annie"]), record("b", 1, 1, ["Ann"]), record("b", 2, 2, [], status="pending"), record("b", 3, 3, [], place="")]
    answers = (
        ("knowledge", "a#1", '[{"name": "Ann", "aliases": ["Annie"], "description": "tall"}]'),
        ("knowledge", "a#2", '{"entities": [{"name": "Annie", "description": "kind"}, {"name": " "}]}'),
        ("knowledge", "b#1", '[{"name": "Ann", "description": "old"}, {"na'),
        ("knowledge", "b#3", '[{"name": "Nobody"}]'),
    )
    got = folds.entity_fold(modes.knowledge(spark, spark.createDataFrame(rows, RECORDS), Scripted(answers), str(tmp_path / "c")), ["book"])
    assert {(r.book, r.name): (r.aliases, r.description) for r in got.collect()} == {("a", "Ann"): (["Annie"], "tall；kind"), ("b", "Ann"): ([], "old")}


def test_profiles(spark, tmp_path):
    rows = [record("a", c, c, ["Ann"] if c % 2 else ["Bob"], [("Ann", f"deed {c}")]) for c in range(1, 11)] + [record("b", 1, 1, ["Ann"], [("Ann", "other book")])]
    records = spark.createDataFrame(rows, RECORDS)
    names = spark.createDataFrame([("a", "Ann"), ("a", "Bob"), ("b", "Ann")], "book string, name string")
    blocks = {(r.book, r.name, r.chunk): r.text for r in modes.person_blocks(records, names, max_chapters=8, max_chars=10**6).collect()}
    assert set(blocks) == {("a", "Ann", 0), ("a", "Ann", 1), ("a", "Bob", 0), ("b", "Ann", 0)}
    assert "deed 8" in blocks["a", "Ann", 0] and "deed 9" in blocks["a", "Ann", 1] and "deed" not in blocks["b", "Ann", 0] and "deed 1\n" not in blocks["a", "Bob", 0]
    final = {"identity": "smith", "first_seen": 99, "events": ["第3章: met", "第40章: never", "free"], "relations": ["Bob: friend"], "arc": "grows"}
    answers = (
        ("profile-block", "deed 9", '{"part": 2}'),
        ("profile-block", "deed 1", '{"part": 1}'),
        ("profile", 'person: Ann\ndigests: [{"part":1},{"part":2}]\nothers: Bob', json.dumps(final)),
    )
    got = modes.profiles(spark, records, names, Scripted(answers), str(tmp_path / "c")).collect()
    assert [(r.book, r.name, r.identity, r.first_seen, r.events, r.relations, r.arc) for r in got] == [("a", "Ann", "smith", 0, ["第3章: met", "free"], ["Bob: friend"], "grows")]


def test_direct_settings(spark, tmp_path):
    streams = spark.createDataFrame([(b, c, f"{b} text {c}") for b in "ab" for c in range(1, 8)], "book string, chapter_no int, text string")
    answers = (
        ("direct-settings", "a text 1", '[{"name": "Hall", "type": "地点", "description": "first"}, {"名称": "Gate"}]'),
        ("direct-settings-again", "a text 6", '{"settings": [{"name": "Hall", "description": "second"}, {"name": "Well", "first_seen": 6}]}'),
        ("direct-settings", "b text 6", '{"name": "Hall", "description": "of b"}'),
    )
    got = modes.direct_settings(spark, streams, Scripted(answers), str(tmp_path / "c"))
    assert {(r.book, r.name): (r.description, r.first_seen) for r in got.collect()} == {("a", "Hall"): ("first", None), ("a", "Gate"): ("", None), ("a", "Well"): ("", 6), ("b", "Hall"): ("of b", None)}


def test_two_books(spark, tmp_path):
    """Books that share chapter numbers stay apart in every table with a book."""
    for name, lead in (("x", "Orrin"), ("y", "Maren")):
        lines = [line for c in (1, 2) for line in (f"第{c}章 Part", *[f"The day {p} was long. Then {lead} said so and saw {name.upper()}land." for p in range(22)])]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines), encoding="utf-8")
    folder = str(tmp_path / "out")
    runner = build_runner(spark, folder, str(tmp_path / "*.txt"), bounds="model", rounds=1)
    bad = [(r.module, r.message) for r in runner.run().collect() if r.status != "ok"]
    assert not bad, bad
    read = lambda t: spark.read.parquet(f"{folder}/{t}").withColumn("book", F.regexp_extract("book", r"(\w)\.txt", 1))
    scenes = read("scenes").groupBy("book", "chapter_no").agg(F.sum("size").alias("n"))
    assert {(r.book, r.chapter_no): r.n for r in scenes.collect()} == {(b, c): 22 for b in "xy" for c in (1, 2)}
    for table in ("knowledge", "profiles", "direct_settings"):
        found = {(r.book, r.name) for r in read(table).select("book", "name").collect()}
        assert ("x", "Orrin") in found and ("y", "Maren") in found and ("x", "Maren") not in found and ("y", "Orrin") not in found, table
    reg = {(r.book, r.canonical) for r in read("registry").collect()}
    assert ("x", "Orrin") in reg and ("y", "Orrin") not in reg
    assert spark.read.parquet(f"{folder}/beats").count() == read("detailed").count()
    sections = {r.section: json.loads(r.json) for r in spark.read.parquet(f"{folder}/detail").collect()}
    assert set(sections) == {"book", "chapters", "timeline", "outlines", "tags", "characters", "nodes", "edges", "settings", "style", "chapter_style"}
    assert {(x["book"][-5], x["chapters"]) for x in sections["book"]} == {("x", 2), ("y", 2)}
    assert len(sections["outlines"]) == len(sections["chapter_style"]) == 4
    new = {(x["book"][-5], x["chapter_no"], x["kind"]): x["names"] for x in sections["tags"]}
    assert "Orrin" in new["x", 1, "people"] and "Orrin" not in new["y", 1, "people"] and "Maren" in new["y", 1, "settings"]
