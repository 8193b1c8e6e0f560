"""Plain-text and EPUB books as tables.

Files are listed and read by Spark's ``binaryFile`` source, so any store that Spark reads
will do, and one file is the unit of work. A broken archive gives one row with ``error``
set and no chapters; it does not end the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.functions.names import title_from_filename
from scriptorium.functions.text import strip

EPUB_CHAPTERS = "path string, title string, author string, index int, chapter_title string, volume string, content string, error string"
_BROKEN = (zipfile.BadZipFile, KeyError, StopIteration, RuntimeError, ElementTree.ParseError)
_BREAKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote"}


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files under ``path`` whose names fit ``pattern``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content")


def text_books(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text): files as UTF-8, or as Latin-1 where they are not valid UTF-8.
    Files without bytes have no row."""
    raw = files(spark, path, pattern)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(valid, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


class _Words(HTMLParser):
    """Text of a page, a line for each block; nothing of scripts and styles."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.heads: dict[str, str] = {}
        self.hidden, self.tag = 0, ""

    def handle_starttag(self, tag, attrs):
        self.tag = tag
        self.hidden += tag in ("script", "style")
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.tag = ""
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.tag in ("title", "h1") and data.strip():
            self.heads.setdefault(self.tag, data.strip())
        if not self.hidden and self.tag != "title":
            self.parts.append(data)


def page_words(html: str) -> tuple[str, str | None]:
    """(text without empty lines, title) of a page; the title is that of the head, else the first main heading."""
    parser = _Words()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x), parser.heads.get("title") or parser.heads.get("h1")


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _contents(archive: zipfile.ZipFile, path: str) -> dict[str, tuple[str, str | None]]:
    """Title and nearest volume by page name, from the book's table of contents; the last entry holds."""
    out: dict[str, tuple[str, str | None]] = {}

    def walk(node, volume):
        label = next((t.text or "" for x in node if _local(x.tag) == "navLabel" for t in x if _local(t.tag) == "text"), "").strip()
        target = next((x.get("src", "") for x in node if _local(x.tag) == "content"), "")
        inner = [x for x in node if _local(x.tag) == "navPoint"]
        if target:
            out[posixpath.basename(unquote(target.split("#")[0]))] = (label, volume)
        for x in inner:
            walk(x, label or volume)

    for point in ElementTree.fromstring(archive.read(path)).iter():
        if _local(point.tag) == "navMap":
            for x in point:
                if _local(x.tag) == "navPoint":
                    walk(x, None)
    return out


def read_epub(path: str, content: bytes) -> Iterator[dict]:
    """Chapters of one archive in reading order. Pages without text are left out and the rest numbered from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        book, folder = ElementTree.fromstring(archive.read(package)), posixpath.dirname(package)
        items = {x.get("id"): x for x in book.iter() if _local(x.tag) == "item"}
        place = lambda item: posixpath.normpath(posixpath.join(folder, unquote(item.get("href", ""))))
        toc = next((place(x) for x in items.values() if x.get("media-type") == "application/x-dtbncx+xml"), None)
        contents = _contents(archive, toc) if toc in archive.namelist() else {}
        index = 0
        for ref in (x.get("idref") for x in book.iter() if _local(x.tag) == "itemref"):
            item = items.get(ref)
            if item is None or "html" not in item.get("media-type", "") or place(item) not in archive.namelist():
                continue
            text, heading = page_words(archive.read(place(item)).decode("utf-8", "replace"))
            if not text:
                continue
            name = posixpath.basename(place(item))
            title, volume = contents.get(name, ("", None))
            yield {
                "path": path, **_about(book), "index": index,
                "chapter_title": title or heading or posixpath.splitext(name)[0], "volume": volume, "content": text, "error": None,
            }
            index += 1


def read_epub_strict(path: str, content: bytes) -> Iterator[dict]:
    """Chapters of one archive numbered by their place in the reading order from 1, with gaps
    where a page is missing or no XHTML. Pages must be well-formed; their text is that of
    paragraphs, sections and headings, each by itself, so text nested in two shows twice."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        book, folder = ElementTree.fromstring(archive.read(package)), posixpath.dirname(package)
        about = _about(book)
        items = {x.get("id"): x for x in book.iter() if _local(x.tag) == "item"}
        for n, ref in enumerate((x.get("idref") for x in book.iter() if _local(x.tag) == "itemref"), 1):
            item = items.get(ref)
            if item is None or "xhtml" not in item.get("media-type", ""):
                continue
            place = posixpath.normpath(posixpath.join(folder, unquote(item.get("href", ""))))
            if place not in archive.namelist():
                continue
            page = ElementTree.fromstring(archive.read(place))
            said = lambda kinds, page=page: [t for x in page.iter() if _local(x.tag) in kinds and (t := "".join(x.itertext()).strip())]
            title = next(iter([*said(("title",)), *said(("h1",))]), f"Chapter {n}")
            words = "\n\n".join(said(("p", "div", "h1", "h2", "h3")))
            yield {"path": path, **about, "index": n, "chapter_title": title, "volume": None, "content": words, "error": None}


def _about(book) -> dict:
    named = lambda kind: next((x.text.strip() for x in book.iter() if _local(x.tag) == kind and x.text and x.text.strip()), None)
    return {"title": named("title"), "author": named("creator")}


def epub_metadata(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """(path, title, author, error): a row for each archive, with nulls for what it does not
    say; never ends the job."""
    schema = T._parse_datatype_string("path string, title string, author string, error string")

    def one(path: str, content: bytes) -> dict:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
                package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
                return {"path": path, **_about(ElementTree.fromstring(archive.read(package))), "error": None}
        except _BROKEN as e:
            return {"path": path, "error": f"{type(e).__name__}: {e}"[:300]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*x) for x in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return files(spark, path, pattern).mapInArrow(run, schema)


def epub_chapters(spark: SparkSession, path: str, pattern: str = "*.epub", strict: bool = False) -> DataFrame:
    """A row for each chapter of each archive, by ``read_epub`` or ``read_epub_strict``; a
    broken archive has one row with ``error``."""

    reader = read_epub_strict if strict else read_epub
    schema = T._parse_datatype_string(EPUB_CHAPTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for one, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = list(reader(one, content))
                except _BROKEN as e:
                    rows = [{"path": one, "error": f"{type(e).__name__}: {e}"[:300]}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files(spark, path, pattern).mapInArrow(run, schema)


def with_book_titles(chapters: DataFrame) -> DataFrame:
    """``title`` of the book from its package, or where that is blank from its file's name."""
    title = strip(F.col("title"))
    return chapters.withColumn("title", F.when(title != "", title).otherwise(title_from_filename(F.substring_index("path", "/", -1))))
