import pytest
from pyspark.sql import functions as F

from loomtext import config
from loomtext.functions import clean
from loomtext.functions import text as X
from loomtext.functions import tolerant_json as J
from loomtext.functions import vectors as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_sentences(spark):
    assert one(spark, " One. Two!  Three?\nfour ", X.sentences) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, "...", X.sentences) == [".", ".", "."]
    assert one(spark, "他走了。真的吗？好！完", lambda c: X.sentences(c, X.CJK)) == ["他走了。", "真的吗？", "好！", "完"]
    assert one(spark, None, X.sentences) is None and one(spark, "", X.sentences) == []


@pytest.mark.parametrize(("n", "bucket"), [(10, "<=10"), (11, "<=20"), (20, "<=20"), (21, "<=30"), (30, "<=30"), (31, "<=40"), (40, "<=40"), (41, "41+")])
def test_buckets(spark, n, bucket):
    assert spark.range(1).select(X.length_bucket(F.lit(n)).alias("b")).first()["b"] == bucket


def test_classes_and_types(spark):
    kind = lambda t: one(spark, t, lambda c: X.sentence_type(c, X.CJK))
    assert [kind(t) for t in ("难道是你？", "是你？", "是你！", "是你。", "是你")] == ["rhetorical", "question", "exclamation", "statement", "statement"]
    para = lambda t: one(spark, t, X.paragraph_class)
    assert [para(t) for t in ("x" * 40, "a. b. c.", "x" * 20, "x" * 21)] == ["long", "long", "short", "mid"]


def test_sentiment_and_rhetoric(spark):
    s = lambda t: one(spark, t, lambda c: X.sentiment(c, "喜乐", "怒哀"))
    assert [s("喜喜怒"), s("喜乐怒"), s("无"), s("怒")] == [0.0, 0.333, 0.0, -1.0]
    w = lambda t: one(spark, t, lambda c: X.sentiment(c, "good fine", "bad", mode="word"))
    assert [w("Good and fine, not bad"), w("badly")] == [0.333, 0.0]
    assert one(spark, "abcdef one. abzzzz. cdefgh. cdxxxx. zz", X.parallel_heads) == 2
    assert one(spark, "abcdef. abzzzz. cdefgh", X.parallel_heads) == 0
    found = one(spark, "a!! b", lambda c: X.pattern_counts(c, {"bang": "!", "none": "q"}))
    assert [(r.name, r.n) for r in found] == [("bang", 2)]


def test_references(spark):
    assert one(spark, "第3章见面，第12-14章再见", X.chapter_numbers) == [3, 12]
    r = one(spark, "与甲：旧友", X.relation_parts)
    assert (r.target, r.label) == ("甲", "旧友") and one(spark, "甲：旧友", X.relation_parts) is None
    assert one(spark, "甲：旧友", lambda c: X.relation_parts(c, export=False)).target == "甲"
    assert one(spark, "a b/红月!", X.slug) == "a_b_红月_"
    import hashlib

    assert one(spark, "t", lambda c: X.content_key(F.lit("m"), c)) == hashlib.sha1(b"m\0t").hexdigest()


def test_formats(spark):
    row = spark.range(1).select(X.duration(F.lit(3723)).alias("a"), X.duration(F.lit(9)).alias("b"), X.short_count(F.lit(1234)).alias("c"), X.progress_bar(F.lit(1), F.lit(2), 4).alias("d"), X.time_left(F.lit(2), F.lit(6), F.lit(10)).alias("e")).first()
    assert tuple(row) == ("1h02m03s", "9s", "1.2k", "##--", 20.0)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2**-0.5), 0.0]


@pytest.mark.parametrize(
    ("raw", "names"),
    [
        ('[{"name": "a"}, {"name": "b"}]', ["a", "b"]),
        ('```json\n[{"name": "a"}]\n```', ["a"]),
        ('{"data": [{"name": "a"}]}', ["a"]),
        ('{"name": "a", "x": 1}', ["a"]),
        ('[{"name": "a"}, {"name": "b"}, {"na', ["a", "b"]),
        ("not json", []),
        ("", []),
        (None, []),
        ("[]", []),
    ],
)
def test_tolerant_arrays(spark, raw, names):
    got = one(spark, raw, lambda c: F.transform(J.as_array(c), lambda v: J.text_of(v, ["name"])))
    assert got == names


def test_tolerant_objects(spark):
    assert one(spark, 'Sure: {"a": 1} ok', J.as_object) == '{"a":1}'
    assert one(spark, '```\n{"a": 1}\n```', J.as_object) == '{"a":1}'
    assert one(spark, "nothing", J.as_object) is None


PEOPLE = "array<struct<name:string,role:string>>"


def test_people(spark):
    rows = [(" A ", "主事"), ("A", "提及"), ("", "参与"), (None, "参与"), ("B", "other")]
    got = one(spark, rows, clean.who, PEOPLE)
    assert [tuple(p) for p in got] == [("A", "主事"), ("B", "参与")]
    more = one(spark, [("A", "主事")], lambda c: clean.with_actors(c, F.array(F.lit("B"), F.lit("A"), F.lit("B"))), PEOPLE)
    assert [tuple(p) for p in more] == [("A", "主事"), ("B", "参与")]
    pov = lambda t, people=(("X", "参与"), ("Y", "主事")): one(spark, list(people), lambda c: clean.point_of_view(F.lit(t), c, "man|woman"), PEOPLE)
    assert [pov("Zed"), pov("a tall man"), pov(""), pov("n" * 30), pov("", [("X", "参与")]), pov("", [])] == ["Zed", "Y", "Y", "Y", "X", "未明示"]


def test_lists_and_acts(spark):
    assert one(spark, [" a ", "bb", "a", "", None, "ccc"], lambda c: clean.list_items(c, 2, 1), "array<string>") == ["a", "bb"]
    acts = [("act", "say", "A", " hi ", ["A", "Q"]), ("act", "fly", "A", "x", []), ("event", None, None, "rain", ["Q"]), ("act", "do", "", "x", []), ("act", "do", "B", "", [])]
    got = one(spark, acts, lambda c: clean.valid_acts(c, F.array(F.lit("A"))), "array<struct<type:string,channel:string,who:string,content:string,scope:array<string>>>")
    assert [(a.type, a.content, a.scope) for a in got] == [("act", "hi", ["A"]), ("event", "rain", ["*"])]


def test_merge_acts():
    act = lambda who, ch, c: {"type": "act", "who": who, "channel": ch, "content": c}
    got = clean.merge_acts([act("A", "say", str(i)) for i in range(4)], 600)
    assert [a["content"] for a in got] == ["0", "1；2；3"]
    many = [act(f"P{i}", "say", str(i)) for i in range(9)]
    assert len(clean.merge_acts(many, 200)) == 3
    apart = [act(f"P{i}", ("say", "do")[i % 2], str(i)) for i in range(6)]
    assert len(clean.merge_acts(apart, 60)) == 6 and clean.merge_acts([], 0) == []


def test_chapter_limits_and_scores(spark):
    assert one(spark, ["第2章 a", "第9章 b", "c"], lambda c: clean.within_chapters(c, 5), "array<string>") == ["第2章 a", "c"]
    got = [one(spark, v, clean.score_0_100) for v in ("130", "-4", "61.6", "x", None)]
    assert got == [100, 0, 62, 50, 50]


def test_settings(monkeypatch):
    s = config.load()
    assert s.get("segment.most") == 15
    monkeypatch.setenv("LOOM_SEGMENT_MOST", "20")
    assert s.get("segment.most") == 20
    s.set("segment.most", "12")
    assert s.get("segment.most") == 12 and s.snapshot(True) == {"segment.most": 12}
    s.unset("segment.most")
    with pytest.raises(ValueError):
        s.set("segment.mode", "magic")
    monkeypatch.setenv("LOOM_FORCE", "perhaps")
    assert s.problems() and "segment.most" in s.markdown()
    assert [config.cast(v, "bool") for v in ("yes", "0", True)] == [True, False, True]
    assert config.role_models("review=a, mine = b,broken") == {"review": "a", "mine": "b"}
    assert config.api_url("http://h/v1/") == "http://h/v1/chat/completions"
    assert config.presets({"a": {"backend": "x", "base_url": "u", "model": "m"}, "b": {"backend": "x"}}).keys() == {"a"}
