import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext.plans import models
from loomtext.plans.book import build_runner
from loomtext.plans.runner import Runner
from loomtext.sources import novel, sinks, tables
from loomtext.streaming import folds as stream_folds

LINES = ["before all", "", "第一卷 North", "第一章 Start", " p one ", "p two", "第2章 Next", "p three", "第二卷 South", "第三章 End", "p four"]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def test_lines_and_chapters(spark):
    books = spark.createDataFrame([("b", "\n".join(LINES)), ("empty", ""), ("null", None)], "book string, text string")
    lines = novel.numbered_lines(books)
    paras = novel.paragraphs(lines)
    got = [(r.para_id, r.volume_no, r.chapter_no, r.text) for r in paras.orderBy("para_id").collect()]
    assert got == [(1, 0, 0, "before all"), (2, 1, 1, "p one"), (3, 1, 1, "p two"), (4, 1, 2, "p three"), (5, 2, 3, "p four")]
    chapters = [(r.chapter_no, r.volume_no, r.title, r.start_para, r.end_para) for r in novel.chapters(lines, paras).orderBy("chapter_no").collect()]
    assert chapters == [(1, 1, "第一章 Start", 2, 3), (2, 1, "第2章 Next", 4, 4), (3, 2, "第三章 End", 5, 5)]
    assert [r.para_id for r in novel.preamble(paras).collect()] == [1]
    few = novel.paragraphs(novel.numbered_lines(books, max_chapters=1))
    assert few.count() == 3
    assert {r.book: r.chapters for r in novel.identify(books.where("text IS NOT NULL")).collect()} == {"b": 3, "empty": 50}


def test_decoding(spark, tmp_path):
    text = "第一章 红月\n夜色"
    write(tmp_path / "a.txt", text)
    write(tmp_path / "b.txt", text, "gb18030")
    (tmp_path / "c.txt").write_bytes(b"ok \xff\xff end")
    got = {r.book.rsplit("/", 1)[1]: r.text for r in novel.ingest(spark, str(tmp_path / "*.txt")).collect()}
    assert got["a.txt"] == got["b.txt"] == text and got["c.txt"].startswith("ok ")


def test_epub(spark, tmp_path):
    page = lambda *ps: "<html><body>" + "".join(f"<p>{p}</p>" for p in ps) + "</body></html>"
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("OEBPS/content.opf", '<spine><itemref idref="cover"/><itemref idref="chapter_2"/><itemref idref="chapter_1"/><itemref idref="chapter_9"/></spine>')
        z.writestr("OEBPS/chapter_1", page("more &amp; more"))
        z.writestr("OEBPS/chapter_2", page("dropped", "第一章 Title", "text<b>!</b>"))
    (tmp_path / "bad.epub").write_bytes(b"PK")
    got = novel.ingest(spark, str(tmp_path / "b.epub")).first()
    assert got.text.split("\n") == ["第一章 Title", "text!", "more & more"]


def test_xhtml(spark):
    page = "<html><head><title>x</title></head><body><div>a<br/>b</div><script>no()</script><p>c &amp; d</p></body></html>"
    df = spark.createDataFrame([(page,), ("plain",), (None,)], "h string")
    got = [r[0] for r in df.select(novel.unescaped(novel.xhtml_to_text(F.col("h")))).collect()]
    assert [x for x in got[0].split("\n") if x] == ["a", "b", "c & d"] and got[1:] == ["plain", None]


def book(n_chapters=3, paras=25):
    out = ["a word before"]
    for c in range(1, n_chapters + 1):
        out.append(f"第{c}章 Part {c}")
        for p in range(paras):
            out.append(f"The day {p} was long. Then Orrin said “come now” to Vella. He looked at Maren and felt cold. Chapter {c} line {p}.")
    return "\n".join(out)


def test_whole_book(spark, tmp_path):
    write(tmp_path / "book.txt", book())
    folder = str(tmp_path / "out")
    runner = build_runner(spark, folder, str(tmp_path / "book.txt"), signals=("The day 9",))
    manifest = {r.module: (r.status, r.message) for r in runner.run().collect()}
    assert {s for s, _ in manifest.values()} == {"ok"}, manifest
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert {r.name: r.n for r in read("coverage").collect()}["paragraphs"] == 76
    scenes = read("scenes")
    assert scenes.agg(F.sum("size")).first()[0] == 75 and scenes.agg(F.max("size")).first()[0] <= 15
    assert {r.extract_status for r in read("records").select("extract_status").distinct().collect()} == {"ok"}
    names = {r.name for r in read("facts").collect()}
    assert {"Orrin", "Vella", "Maren"} <= names
    sections = {r.section: json.loads(r.json) for r in read("detail").collect()}
    assert len(sections["chapters"]) == 3 and sections["characters"]
    again = {r.status for r in runner.run().collect()}
    assert again == {"skip"}
    assert read("_answers").groupBy("key").count().where("count > 1").count() == 0


def test_runner_isolates_failures(spark, tmp_path):
    r = Runner(spark, str(tmp_path / "run"))
    r.add("a", lambda s, _: s.range(3))
    r.add("b", lambda s, t: 1 / 0, ["a"])
    r.add("c", lambda s, t: t["b"], ["b"])
    r.add("d", lambda s, t: t["a"], ["a"])
    assert {x.module: x.status for x in r.run().collect()} == {"a": "ok", "b": "fail", "c": "blocked", "d": "ok"}
    assert {x.module for x in r.run(["d"], force=True).collect()} == {"a", "d"}
    r.add("e", lambda s, t: t["f"], ["f"])
    r.add("f", lambda s, t: t["e"], ["e"])
    with pytest.raises(ValueError):
        r.run(["e"])


def test_http_protocols_and_retries():
    calls = []

    def send(url, headers, body):
        calls.append(url)
        if len(calls) < 3:
            raise ConnectionError
        return {"choices": [{"message": {"content": "yes"}}]}

    assert models.Http("m", "http://h").answer("s", ["p"], send, lambda s: None) == ["yes"] and len(calls) == 3
    assert models.Http("m", "http://h", "ollama").request("p")[0] == "http://h/api/chat"
    assert models.Http("m", "http://h", "anthropic").text({"content": [{"text": "t"}]}) == "t"
    assert models.Http("m", "http://h", "google").text({}) is None

    def never(*_):
        raise TimeoutError

    assert models.Http("m", "http://h", retries=2).answer("s", ["p"], never, lambda s: None) == [None]


def test_upsert_and_products(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int, x string")
    sinks.upsert(spark, rows((1, 1, "a"), (2, 1, "b")), path, ["k"], "v")
    sinks.upsert(spark, rows((1, 2, "c"), (3, 1, "d")), path, ["k"], "v")
    assert {r.k: r.x for r in spark.read.parquet(path).collect()} == {1: "c", 2: "b", 3: "d"}
    out = str(tmp_path / "p.json")
    assert not sinks.valid_json(out)
    sinks.export_json({"a": "红"}, out)
    assert sinks.valid_json(out)
    got = tables.json_products(spark, out, "a string, b int").collect()
    assert [tuple(r) for r in got] == [("红", None)]
    assert tables.json_products(spark, str(tmp_path / "none.json"), "a string").count() == 0
    assert {r.key: r.value for r in sinks.meta_rows(spark, {"a": [1], "b": "x"}).collect()} == {"a": "[1]", "b": "x"}
    with pytest.raises(ValueError):
        tables.assert_schema(rows((1, 1, "a")), spark.createDataFrame([], "k string").schema)


def test_workbook(spark, tmp_path):
    assert [sinks.column_name(n) for n in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]
    assert sinks.sheet_name("a/b" + "x" * 40, []) == "a_b" + "x" * 28 and sinks.sheet_name("t", ["t"]) == "t_2"
    df = spark.createDataFrame([(1, "x" * 300, True, None, [1, 2])], "a int, b string, c boolean, d string, e array<int>")
    path = str(tmp_path / "w.xlsx")
    sinks.export_xlsx({"meta": df.limit(0), "t<1>": df}, path, max_rows=5)
    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "x" * 200 + "…" in sheet and 't="b"' in sheet and "[1, 2]" in sheet
        assert z.read("xl/workbook.xml").decode().index("t&lt;1&gt;") < z.read("xl/workbook.xml").decode().index("meta")


def test_pages_and_logs(spark, tmp_path):
    assert sinks.render_page("<script>{{A}} {{B}}</script>", {"A": "</script>"}) == '<script>"<\\/script>" {{B}}</script>'
    log = sinks.RunLog(str(tmp_path / "log"))
    log.section("s", "t")
    log.progress("s", 5, 10, 2.0)
    log.gauge("s", "rate", 0.5)
    log.emit("DEBUG", "s", "hidden")
    log.error("s", "bad")
    got = tables.log_records(spark, log.path)
    assert got.count() == 4 and got.where("name = 'rate'").first()["value"] == 0.5
    assert sinks.markdown_table(spark.createDataFrame([(1, "a|b")], "x int, y string")) == "| x | y |\n|---|---|\n| 1 | a\\|b |\n"


def test_streamed_router_equals_batch(spark, tmp_path):
    from loomtext.operators import router

    rows = [(k, i, (i + k) % 4 == 0, i % 2 == 0, k == 3, False, 0) for k in range(5) for i in range(20)]
    ddl = "k int, o int, is_hit boolean, is_unknown boolean, is_definition boolean, is_meme boolean, gap_size int"
    df = spark.createDataFrame(rows, ddl)
    for part in range(4):
        df.where(f"o div 5 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_folds.route(stream, "k", "o").writeStream.format("memory").queryName("routed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("routed").collect()) == sorted(tuple(r) for r in router.decisions(df, ["k"], ["o"]).collect())


def test_streamed_upsert(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, v int").write.parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    stream = spark.readStream.schema("k int, v int").parquet(str(tmp_path / "in"))
    stream_folds.settings_upsert(stream, out, ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 1)]
