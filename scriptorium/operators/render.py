"""Pages from blocks: markup, navigation, tables of contents, prompts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import style
from scriptorium.functions.names import humanise, stem
from scriptorium.operators.scan import placed

BREAK = "\n\n--- CHAPTER BREAK ---\n\n"


def escape_html(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def block_html(kind: Column, speaker: Column, content: Column, tone: Column) -> Column:
    """One block of any of the seven types, with its speaker's class and tone sign where it has some."""
    who = F.when(F.coalesce(speaker, F.lit("")) == "", "").otherwise(
        F.concat(F.lit('<span class="speaker">'), escape_html(speaker), F.lit("</span>"))
    )
    sign = style.tone_emoji(tone)
    mark = F.when(sign == "", "").otherwise(F.concat(F.lit('<span class="tone">'), sign, F.lit("</span>")))
    return F.concat(
        F.lit('<div class="block '), kind, F.lit(" "), style.speaker_class(speaker), F.lit(" "), style.speaker_lane(speaker), F.lit('">'),
        who, mark, F.lit("<p>"), escape_html(F.coalesce(content, F.lit(""))), F.lit("</p></div>"),
    )


def chapter_pages(blocks: DataFrame, key: str = "chapter", order: str = "block_index") -> DataFrame:
    """(key, body, n_blocks): the blocks' markup in order; a block without content is left out."""
    one = F.struct(F.col(order), block_html(F.col("type"), F.col("speaker"), F.col("content"), F.col("tone")).alias("html"))
    rows = blocks.where("content is not null").groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r["html"]), "\n").alias("body"), F.size("rows").alias("n_blocks"))


def chapter_document(title: Column, body: Column, prev_link: Column, next_link: Column, toc: Column, about: Column | None = None) -> Column:
    """A whole page: head, links to the neighbours, contents, title, body and what is known of
    the chapter. Null links are left out, a null title is empty."""
    link = lambda to, rel: F.when(to.isNotNull(), F.concat(F.lit(f'<a rel="{rel}" href="'), escape_html(to), F.lit('">'), F.lit(rel), F.lit("</a>")))
    name = escape_html(F.coalesce(title, F.lit("")))
    note = F.lit("") if about is None else F.when(F.coalesce(about, F.lit("")) == "", "").otherwise(F.concat(F.lit("<footer>"), escape_html(about), F.lit("</footer>")))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body><nav>"),
        F.concat_ws(" ", link(prev_link, "prev"), link(next_link, "next")), F.lit("</nav><ol>"), F.coalesce(toc, F.lit("")), F.lit("</ol><h1>"), name, F.lit("</h1>\n"),
        body, F.lit("\n"), note, F.lit("</body></html>"),
    )


def render_outcomes(chapters: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Adds ``outcome`` to ``chapters(key, readable)``: ``failed`` where the script could not be
    read, ``skipped`` where it has no page in ``pages(key)``, else ``rendered``."""
    made = pages.select(F.col(key).alias("__key")).distinct()
    joined = chapters.join(made, F.col(key) == F.col("__key"), "left")
    outcome = F.when(~F.coalesce("readable", F.lit(False)), "failed").when(F.col("__key").isNull(), "skipped").otherwise("rendered")
    return joined.withColumn("outcome", outcome).drop("__key")


def render_stats(outcomes: DataFrame) -> DataFrame:
    """One row: rendered, failed, skipped, total."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.agg(n("rendered"), n("failed"), n("skipped"), F.count("*").alias("total"))


def issue_text(issue_id: Column, chapter: Column, phase: Column, kind: Column, message: Column) -> Column:
    """An issue as a section of markdown."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), issue_id),
        F.concat(F.lit("- chapter: "), chapter),
        F.concat(F.lit("- phase: "), phase),
        F.concat(F.lit("- kind: "), kind),
        F.concat(F.lit("- message: "), F.coalesce(message, F.lit(""))),
    )


def page_links(chapters: DataFrame, group: str, order: str, filename: str = "filename") -> DataFrame:
    """Adds ``prev_link`` and ``next_link``: ``<stem>.html`` of the neighbours; chapters of equal
    ``order`` come by file name."""
    ordered = placed(chapters, [group], [F.col(order), F.col(filename)])
    return ordered.with_neighbours(F.concat(stem(F.col(filename)), F.lit(".html")), "prev_link", "next_link").result()


def titles_from_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``shown_title`` to ``files(filename)``: the manifest's title of the same stem, or the stem in words."""
    known = manifest.select(stem(F.col("filename")).alias("__stem"), F.col("title").alias("__title")).dropDuplicates(["__stem"])
    own = files.withColumn("__own", stem(F.col("filename")))
    joined = own.join(known, F.col("__own") == F.col("__stem"), "left")
    return joined.withColumn("shown_title", F.coalesce(F.nullif("__title", F.lit("")), humanise(F.col("__own")))).drop("__stem", "__title", "__own")


def contents_list(chapters: DataFrame, group: str, order: str) -> DataFrame:
    """(group, toc): links ``#chapter-{order}`` with titles, in order."""
    rows = chapters.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("n"), F.coalesce("title", F.concat(F.lit("Chapter "), F.col(order))).alias("title")))).alias("rows"))
    item = lambda r: F.concat(F.lit('<li><a href="#chapter-'), r["n"].cast("string"), F.lit('">'), escape_html(r["title"]), F.lit("</a></li>"))
    return rows.select(group, F.array_join(F.transform("rows", item), "").alias("toc"))


def omnibus(pages: DataFrame, group: str, order: str) -> DataFrame:
    """(group, document): all chapters ``(title, body)`` in one text with anchors and a table of contents."""
    part = F.concat(F.lit('<section id="chapter-'), F.col(order).cast("string"), F.lit('"><h2>'), escape_html(F.col("title")), F.lit("</h2>"), F.col("body"), F.lit("</section>"))
    whole = pages.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order), part.alias("html")))).alias("rows"))
    joined = whole.join(contents_list(pages, group, order), group)
    return joined.select(group, F.concat(F.lit("<nav><ol>"), F.col("toc"), F.lit("</ol></nav>"), F.array_join(F.transform("rows", lambda r: r["html"]), "")).alias("document"))


def style_map(blocks: DataFrame) -> DataFrame:
    """(speaker, color, lane, css_class, first_chapter, first_block): by a speaker's first block."""
    first = blocks.where("speaker is not null and speaker <> ''").groupBy("speaker").agg(F.min(F.struct("chapter", "block_index")).alias("at"))
    name = F.col("speaker")
    return first.select(
        "speaker",
        style.speaker_color(name).alias("color"),
        style.speaker_lane(name).alias("lane"),
        style.speaker_class(name).alias("css_class"),
        F.col("at.chapter").alias("first_chapter"),
        F.col("at.block_index").alias("first_block"),
    )


def with_preferences(styles: DataFrame, prefs: DataFrame) -> DataFrame:
    """Styles with a reader's own colour, lane and name where ``prefs(speaker, color, lane, display_name)`` has them."""
    own = prefs.select("speaker", *[F.nullif(c, F.lit("")).alias(f"__{c}") for c in ("color", "lane", "display_name")])
    joined = styles.join(own, "speaker", "left")
    return joined.withColumns({"color": F.coalesce("__color", "color"), "lane": F.coalesce("__lane", "lane"), "display_name": F.coalesce("__display_name", "speaker")}).drop("__color", "__lane", "__display_name")


def render_window(chapters: DataFrame, group: str, order: str, width: int = 5) -> DataFrame:
    """Adds ``window_from`` and ``window_to``: the places (from 1) of ``width`` chapters around
    each one, moved to stay inside its novel."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    n = F.count("*").over(Window.partitionBy(group))
    first = F.greatest(F.lit(1), F.least(at - width // 2, n - width + 1))
    return chapters.withColumns({"window_from": first, "window_to": F.least(n, first + width - 1)})


def circle_layout(nodes: DataFrame, group: str, weight: str, name: str) -> DataFrame:
    """Adds ``x`` and ``y``: places on a circle in order of weight."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(weight).desc(), name)) - 1
    place = style.circle_place(rank, F.count("*").over(Window.partitionBy(group)))
    return nodes.withColumn("__p", place).withColumns({"x": F.col("__p.x"), "y": F.col("__p.y")}).drop("__p")


def manifest(chapters: DataFrame, source: str, order: str, fields: list[str]) -> DataFrame:
    """(source, chapters): each source's chapters in order, as JSON."""
    rows = chapters.groupBy(source).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("rows"))
    return rows.select(source, F.to_json("rows").alias("chapters"))


def prompt(system: str, keys: list[str], text: Column, glossary: Column | None = None) -> Column:
    """Instructions, the keys of the answer and the text; a glossary section stands before if it is not empty."""
    body = F.concat(F.lit(f"{system}\n\nReturn JSON with the keys: {', '.join(keys)}.\n\n"), text)
    if glossary is None:
        return body
    return F.when(F.coalesce(glossary, F.lit("")) == "", body).otherwise(F.concat(glossary, F.lit("\n\n"), body))


def extraction_prompts(chapters: DataFrame, group: str, order: str, most: int = 10) -> DataFrame:
    """(group, text): the first chapters of each novel, with breaks between."""
    if not 1 <= most <= 100:
        raise ValueError("between 1 and 100 chapters are asked for")
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = chapters.withColumn("__n", nth).where(F.col("__n") <= most)
    rows = first.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("__n", "text"))).alias("rows"))
    return rows.select(group, F.array_join(F.transform("rows", lambda r: r["text"]), BREAK).alias("text"))


def changelog_entry(job: Column, ts: Column, processed: Column, failed: Column, took: Column) -> Column:
    """A run's lines for the log."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" - "), job),
        F.concat(F.lit("- processed: "), processed.cast("string")),
        F.concat(F.lit("- failed: "), failed.cast("string")),
        F.concat(F.lit("- duration: "), took),
    )
