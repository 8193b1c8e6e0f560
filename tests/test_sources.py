"""Readers of books and scripts, and streams over what has landed."""

import json
import zipfile

import pytest

from scriptorium.sources import books, scripts
from scriptorium.streaming import jobs

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>Ann</dc:creator></metadata>
<manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="e" href="e.xhtml" media-type="application/xhtml+xml"/>
<item id="c" href="c.css" media-type="text/css"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="b"/><itemref idref="e"/><itemref idref="c"/><itemref idref="a"/></spine></package>"""
TOC = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Volume 1</text></navLabel>
<navPoint><navLabel><text>Start</text></navLabel><content src="b.xhtml#x"/></navPoint></navPoint></navMap></ncx>"""


def write_epub(path, title):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/book.opf", PACKAGE.format(title=title))
        z.writestr("OEBPS/toc.ncx", TOC)
        z.writestr("OEBPS/b.xhtml", "<html><head><title>B</title><style>x</style></head><body><p>One &amp; two</p><script>no</script><p>three</p></body></html>")
        z.writestr("OEBPS/e.xhtml", "<html><body> </body></html>")
        z.writestr("OEBPS/a.xhtml", "<html><body><h1>Head</h1><p>last</p></body></html>")


def test_epub_chapters(spark, tmp_path):
    write_epub(tmp_path / "my_book - Book 2.epub", "")
    write_epub(tmp_path / "other.epub", "Known")
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    rows = books.with_book_titles(books.epub_chapters(spark, str(tmp_path))).collect()
    by = {(r["path"].rsplit("/", 1)[-1], r["index"]): r for r in rows}
    assert len(rows) == 5
    first, second = by["other.epub", 0], by["other.epub", 1]
    assert (first["title"], first["author"], first["chapter_title"], first["volume"], first["content"]) == ("Known", "Ann", "Start", "Volume 1", "One & two\nthree")
    assert (second["chapter_title"], second["volume"], second["content"]) == ("Head", None, "Head\nlast")
    assert by["broken.epub", None]["error"].startswith("BadZipFile")
    assert {r["title"] for (name, _), r in by.items() if name.startswith("my_book")} == {"My Book"}


def test_epub_chapters_by_place_and_metadata(spark, tmp_path):
    write_epub(tmp_path / "a.epub", "Known")
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "bare.epub", "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/book.opf", "<package><metadata><title>Bare</title></metadata><manifest/><spine/></package>")
    rows = {r["index"]: r for r in books.epub_chapters(spark, str(tmp_path), "a.epub", strict=True).collect()}
    assert {i: (r["chapter_title"], r["content"]) for i, r in rows.items()} == {1: ("B", "One & two\n\nthree"), 2: ("Chapter 2", ""), 4: ("Head", "Head\n\nlast")}
    about = {r["path"].rsplit("/", 1)[-1]: (r["title"], r["author"], r["error"] is None) for r in books.epub_metadata(spark, str(tmp_path)).collect()}
    assert about == {"a.epub": ("Known", "Ann", True), "bare.epub": ("Bare", None, True), "broken.epub": (None, None, False)}


def test_preferred_glossary_and_odd_entries(spark, tmp_path):
    one = lambda name, x: (tmp_path / name).write_text(x)
    one("own.json", json.dumps({"terms": [{"name": "Qi", "raw": "x"}, "odd", {"raw": "no name"}, 5]}))
    one("shared.json", json.dumps({"terms": [{"name": "Shared", "raw": "y"}]}))
    one("bad.json", "{no json")
    names = lambda a, b: [r["name"] for r in scripts.preferred_glossary(spark, f"{tmp_path}/{a}", f"{tmp_path}/{b}").collect()]
    assert names("own.json", "shared.json") == ["Qi"]
    assert names("none.json", "shared.json") == ["Shared"] and names("bad.json", "shared.json") == ["Shared"]
    assert names("none.json", "bad.json") == []


def test_sinks(spark, tmp_path):
    scripts.write_chapters(spark.createDataFrame([(1, "a"), (2, "b")], "novel_id long, text string"), f"{tmp_path}/chapters")
    assert {r["novel_id"] for r in spark.read.parquet(f"{tmp_path}/chapters").collect()} == {1, 2}
    pages = spark.createDataFrame([("a.html", "<p>")], "name string, document string")
    assert scripts.write_documents(pages, f"{tmp_path}/pages").first()["document"] == "<p>"
    scripts.write_glossary(spark.createDataFrame([('x"y', '[{"name":"Qi"}]')], "category string, entries string"), f"{tmp_path}/glossary")
    row = json.loads(spark.read.text(f"{tmp_path}/glossary").first()["value"])
    assert row == {"category": 'x"y', "entries": [{"name": "Qi"}]}
    scripts.write_report(spark.createDataFrame([(1, 0.5)], "chapter long, score double"), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first()["score"] == 0.5


def test_text_books(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é 日本", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"")
    rows = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in books.text_books(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "é 日本", "b.txt": "café"}


def test_scripts(spark, tmp_path):
    block = {"type": "dialogue", "content": "hi", "speaker": "A"}
    (tmp_path / "ch_2.json").write_text(json.dumps({"chapter_title": "T", "blocks": [block, {"type": "narrator", "text": "old"}]}))
    (tmp_path / "ch_10.json").write_text("{broken")
    found = scripts.scripts(spark, str(tmp_path))
    assert found.count() == 2
    rows = scripts.blocks_of(found).orderBy("block_index").collect()
    assert [(r["chapter"], tuple(r["order_key"]), r["type"], r["content"]) for r in rows] == [("ch_2.json", (0, 2), "dialogue", "hi"), ("ch_2.json", (0, 2), "narrator", "old")]
    with pytest.raises(Exception, match="(?i)malformed|corrupt|FAILFAST|parse"):
        scripts.scripts(spark, str(tmp_path), strict=True).collect()


def test_manifest_and_glossary(spark, tmp_path):
    entry = {"index": 0, "title": "A", "filename": "000_a.txt", "token_estimate": 3, "metadata": {"tags": ["litrpg"]}}
    (tmp_path / "map.json").write_text(json.dumps({"source_filename": "x.txt", "chapters": [entry]}))
    row = scripts.manifest_entries(spark, f"{tmp_path}/map.json").first()
    assert (row["source_filename"], row["filename"], row["metadata"]) == ("x.txt", "000_a.txt", {"tags": ["litrpg"]})
    (tmp_path / "glossary.json").write_text(json.dumps({"characters": [{"name": "Kai", "raw": "카이", "aliases": ["K"]}, {"name": ""}], "terms": [{"name": "Qi", "raw": "기"}]}))
    rows = scripts.glossary_entries(spark, f"{tmp_path}/glossary.json").collect()
    assert {(r["category"], r["ord"], r["name"], tuple(r["aliases"])) for r in rows} == {("characters", 0, "Kai", ("K",)), ("terms", 0, "Qi", ())}


def test_exports(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", 'x "q"')], "id long, chapter string, content string")
    scripts.export_corrections(log, f"{tmp_path}/j")
    scripts.export_corrections(log, f"{tmp_path}/c", "csv")
    assert spark.read.json(f"{tmp_path}/j").first()["content"] == 'x "q"'
    assert spark.read.option("header", "true").option("escape", "\\").csv(f"{tmp_path}/c").first()["content"] == 'x "q"'
    with pytest.raises(ValueError, match="unknown"):
        scripts.export_corrections(log, f"{tmp_path}/y", "yaml")


def test_landed_texts_are_taken_once(spark, tmp_path):
    landing, target, place = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/place"
    landing.mkdir()
    (landing / "a.txt").write_text("one")
    assert jobs.ingest_new(spark, str(landing), target, place).count() == 1
    (landing / "b.txt").write_text("two")
    assert {r["filename"] for r in jobs.ingest_new(spark, str(landing), target, place).collect()} == {"a.txt", "b.txt"}
    # a lost checkpoint reads all files again, and adds none twice
    assert jobs.ingest_new(spark, str(landing), target, f"{tmp_path}/other").count() == 2


def test_reading_progress_goes_on(spark, tmp_path):
    landing = f"{tmp_path}/events"
    spark.sql("SELECT 1L novel_id, 4L chapter_id, timestamp'2024-01-01 00:00:00' ts UNION ALL SELECT 1L, 4L, timestamp'2024-01-02 00:00:00'").write.parquet(landing)
    stream = lambda: spark.readStream.schema(jobs.READS).parquet(landing)
    target, place = f"{tmp_path}/t", f"{tmp_path}/p"
    assert [tuple(r) for r in jobs.reading_progress(stream(), target, place).collect()] == [(1, 1, 4)]
    spark.sql("SELECT 1L novel_id, 2L chapter_id, timestamp'2024-01-03 00:00:00' ts UNION ALL SELECT 2L, 9L, timestamp'2024-01-01 00:00:00'").write.mode("append").parquet(landing)
    assert sorted(tuple(r) for r in jobs.reading_progress(stream(), target, place).collect()) == [(1, 2, 2), (2, 1, 9)]
    # a run without new data, after an odd number of batches, shows the same
    assert sorted(tuple(r) for r in jobs.reading_progress(stream(), target, place).collect()) == [(1, 2, 2), (2, 1, 9)]
    assert sorted(tuple(r) for r in jobs.reading_progress(stream(), target, place).collect()) == [(1, 2, 2), (2, 1, 9)]


def test_reading_progress_without_events(spark, tmp_path):
    landing = f"{tmp_path}/events"
    spark.createDataFrame([], jobs.READS).write.parquet(landing)
    assert jobs.reading_progress(spark.readStream.schema(jobs.READS).parquet(landing), f"{tmp_path}/t", f"{tmp_path}/p").count() == 0
