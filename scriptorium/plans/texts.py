"""Queries over texts: cleaning, names, segmentation, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import misc, names, style, text
from scriptorium.operators import segment
from scriptorium.plans import entities as E
from scriptorium.session import table

_DIRTY = [
    "Chapter {i}: T\n", "{t}", "\nRead more at www.example.com/x now\n\n\n\n", "  “quoted”\t\ttext ‘here’  \r\n", "TN: a note\n", "see HTTPS://a.b/c?d=1 end\rlast  "
]


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _dirty(spark, d):
    """Documents with marks to clean: links, notes, watermarks, quotes, odd space."""
    parts = [F.lit("Chapter "), F.col("doc_id").cast("string"), F.lit(": T\n"), F.col("text"), *map(F.lit, _DIRTY[2:])]
    return table(spark, d, "documents").select("doc_id", F.concat(*parts).alias("text"))


def clean_texts(spark, d):
    return _dirty(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("text"))


def sanitised_chapters(spark, d):
    return _dirty(spark, d).select("doc_id", text.sanitise_chapter(F.col("text")).alias("text"))


def text_measures(spark, d):
    t = F.col("text")
    return _documents(spark, d).select(
        "doc_id",
        text.token_estimate(t).cast("bigint").alias("tokens"),
        text.beyond_safety_limit(t).alias("beyond_limit"),
        text.word_count(t).cast("bigint").alias("words"),
        text.source_hash(t).alias("source_hash"),
        text.paragraph_count(t).cast("bigint").alias("paragraphs"),
    )


def content_tags(spark, d):
    odd = F.when(F.col("doc_id") % 5 == 0, "Status Window open").when(F.col("doc_id") % 5 == 1, "[System] hi").when(F.col("doc_id") % 5 == 2, "STATUS: ok").otherwise("")
    return _documents(spark, d).select("doc_id", F.array_join(text.content_tags(F.concat("text", odd)), ",").alias("tags"))


def code_fences(spark, d):
    """Answers in a fence with json, another language or none, on one line, and with an end alone."""
    t, nth = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id") % 5
    answer = (
        F.when(nth == 0, F.concat(F.lit("<think>plan\n"), t, F.lit("</think>\n```json\n{\"text\": "), t, F.lit("}\n```\n")))
        .when(nth == 1, F.concat(F.lit("```python x\n"), t, F.lit("\n```")))
        .when(nth == 2, F.concat(F.lit("```"), t, F.lit("```  ")))
        .when(nth == 3, F.concat(F.lit("\t"), t, F.lit("\n```\n")))
        .otherwise(F.concat(F.lit("``` \n"), t, F.lit(" ``` end")))
    )
    return _documents(spark, d).select("doc_id", text.strip_code_fence(answer).alias("answer"))


def chapter_filenames(spark, d):
    title = F.concat(F.lit("Chapter "), F.col("doc_id").cast("string"), F.lit(": The "), F.col("text"))
    return _documents(spark, d).select("doc_id", names.chapter_filename(F.col("doc_id").cast("int"), title).alias("filename"))


def filename_titles(spark, d):
    words = F.regexp_replace("text", "[^A-Za-z ]", "_")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "LOTM_-_").otherwise("my-"), words, F.when(F.col("doc_id") % 3 == 0, " - Book 2.epub").otherwise(".txt"))
    return _documents(spark, d).select("doc_id", names.title_from_filename(name).alias("title"))


def file_names(spark, d):
    name = F.concat(F.lit("vol_"), (F.col("doc_id") % 7).cast("string"), F.lit("_chapter_"), F.col("doc_id").cast("string"), F.lit(".xhtml"))
    key = names.natural_key(name)
    return _documents(spark, d).select(
        "doc_id", names.chapter_index_of(name).alias("number"), key["volume"].alias("volume"), key["chapter"].alias("chapter"), names.stem(name).alias("stem"),
        names.json_filename(name).alias("json_name"), names.basename(F.concat(F.lit("a/b/"), name, F.lit("#c"))).alias("base"),
    )


def display_titles(spark, d):
    title = F.concat(F.format_string("%03d Chapter ", F.col("doc_id")), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, " Some Words").otherwise(""))
    return _documents(spark, d).select("doc_id", names.display_title(title).alias("title"))


def tone_signs(spark, d):
    tone = F.element_at(F.array(*map(F.lit, ["furious", "made up", "calm", "Whispering", "in tears", "giggly", "gasping", "ROARING"])), (F.col("doc_id") % 8 + 1).cast("int"))
    return _documents(spark, d).select("doc_id", style.tone_emoji(tone).alias("sign"))


def highlighted(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.highlight(F.col("text"), ["the", "the and", "hath"]).alias("text")
    )


def durations(spark, d):
    seconds = F.col("value") * F.col("value")
    return table(spark, d, "events").select("event_id", misc.duration(F.floor(seconds) + 0.5).alias("took"))


_ERRORS = [
    "Error code: 401", "INVALID_API_KEY", "unauthorized: bad key", "HTTP 429", "Rate Limit hit", "rate_limit_exceeded", "quota used up",
    "Invalid response_format, code 401", "401 after 429", "permission denied (403)", "",
]


def error_kinds(spark, d):
    """Whole texts as error messages, most with a provider's words after them."""
    said = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("doc_id") % len(_ERRORS) + 1).cast("int"))
    return _documents(spark, d).select("doc_id", misc.error_kind(F.concat(F.coalesce("text", F.lit("")), said)).alias("kind"))


def backoff(spark, d):
    n = (F.col("event_id") % 8).cast("int")
    return table(spark, d, "events").select("event_id", misc.backoff_seconds(n, 10).alias("wait"), misc.clamp(n, 2, 5).cast("double").alias("clamped"))


def tags_cleaned(spark, d):
    tags = F.array(F.col("p_brand"), F.lower("p_brand"), F.lit(" "), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), F.lit("X"), F.lit("x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(misc.clean_tags(tags, 10), "|").alias("tags"))


def tags_parsed(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, "[\"a\", \"b\"]").when(F.col("p_partkey") % 3 == 1, "not json").otherwise(None)
    return table(spark, d, "part").select("p_partkey", F.size(misc.parse_tags(raw)).cast("bigint").alias("n_tags"))


def record_checks(spark, d):
    p = table(spark, d, "part")
    rules = misc.broken_rules(title=F.length("p_name").between(1, 500), known=F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), index=F.col("p_size") >= 10)
    return p.select("p_partkey", F.array_join(rules, ",").alias("broken"), (F.size(rules) == 0).alias("valid"))


def series_fields(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.novelupdates.com/series/n-"), F.col("page_id").cast("string"), F.lit("/"))).otherwise(
        F.concat(F.lit("https://www.royalroad.com/fiction/"), F.col("page_id").cast("string"), F.lit("/x"))
    )
    word = F.element_at(F.array(*map(F.lit, ["Ongoing", " completed ", "hiatus", "else"])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", misc.series_id(url).alias("series"), misc.series_status(word).alias("status"), misc.absolute_url(F.lit("/c.jpg"), "https://x.y").alias("cover"))


def html_fields(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(h, "<h1[^>]*>([^<]+)</h1>", 1).alias("heading"),
        F.array_join(F.slice(F.filter(F.transform(F.regexp_extract_all(h, F.lit("<a[^>]*>([^<]+)</a>"), 1), lambda t: F.trim(t)), lambda t: t != ""), 1, 10), "|").alias("tags"),
    )


_ODD_HTML = """<p title="a > b" class='c>d'>caf&eacute;  &#233;\t&#xE9; &#128512; &lt;b&gt; &unknown; &amp;lt; 1 < 2 &copy</p><!-- <a href="/x"> -->"""
_ODD_TEXT = "café é é 😀 <b> &unknown; &lt; 1 < 2 &copy"


def page_text(spark, d):
    """Visible text of pages, every other one with references, quotes, blanks and a lone mark before it."""
    odd = F.when(F.col("page_id") % 2 == 0, _ODD_HTML).otherwise("")
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.concat(odd, F.coalesce("html", F.lit("")))).alias("text"))


def _book(spark, d):
    """Documents as books: every third paragraph gets a chapter line; some have numbers, some none."""
    lines = F.split("text", "\n")
    head = lambda i: F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Chapter "), (i + 1).cast("string"), F.lit(": Part"))).when(F.col("doc_id") % 3 == 1, (i + 1).cast("string"))
    with_heads = F.transform(lines, lambda line, i: F.concat_ws("\n", head(i), line))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("before\n"), F.array_join(with_heads, "\n")).alias("text"))


def chapters_split(spark, d):
    return segment.split_chapters(_book(spark, d)).select("doc_id", "index", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def sections_split(spark, d):
    return segment.split_sections(_book(spark, d)).select("doc_id", "index", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def number_runs(spark, d):
    run = segment.number_run(F.col("text")).cast("bigint").alias("numbers")
    return _book(spark, d).select("doc_id", run).where("numbers > 0")


def segment_ends(spark, d):
    lines = segment.lines_of(_documents(spark, d)).select("doc_id", "line_no")
    return segment.boundaries_with_ends(lines, "doc_id", "line_no", F.lit(1_000_000))


def renumbered_lines(spark, d):
    lines = segment.lines_of(_documents(spark, d)).withColumn("size", F.length("line"))
    return segment.renumbered(lines, "doc_id", "line_no", F.col("size") > 200).select("doc_id", "line_no", "index")


def narrator_islands(spark, d):
    return segment.islands(E.blocks(spark, d)).select("chapter", "block_index", "island", "merge_top", "merge_bottom")


def block_stats(spark, d):
    turns = E.turns(spark, d).withColumnRenamed("speaker", "type")
    return segment.block_stats(turns, text.word_count(F.col("content")))


QUERIES = {
    f.__name__: f
    for f in (
        clean_texts, sanitised_chapters, text_measures, content_tags, code_fences, chapter_filenames, filename_titles, file_names, display_titles, tone_signs,
        highlighted, durations, error_kinds, backoff, tags_cleaned, tags_parsed, record_checks, series_fields, html_fields, page_text, chapters_split,
        sections_split, number_runs, segment_ends, renumbered_lines, narrator_islands, block_stats,
    )
}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


_DIRTY_SQL = "SELECT doc_id, 'Chapter ' || doc_id || ': T' || chr(10) || text || " + " || ".join(map(_sql_text, _DIRTY[2:])) + " AS text FROM documents"
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_SPACE = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_CLEANED = f"translate(text, '{text.CURLY}', '\"\"''''')"
for _p in (text.URL, text.NOTE.replace("(?dim)", "(?im)"), text.WATERMARK.replace("(?dim)", "(?im)")):
    _CLEANED = f"regexp_replace({_CLEANED}, {_sql_text(_p)}, '', 'g')"
_TITLE_WORD = "CASE WHEN length(w) <= 4 AND w = upper(w) AND w <> lower(w) THEN w ELSE list_aggregate(list_transform(regexp_extract_all(w, '\\p{L}+|\\P{L}+'), lambda q: upper(q[1]) || lower(q[2:])), 'string_agg', '') END"
_BOOK = """SELECT doc_id, 'before' || chr(10) || list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i:
  CASE doc_id % 3 WHEN 0 THEN 'Chapter ' || i || ': Part' || chr(10) WHEN 1 THEN i || chr(10) ELSE '' END || x), 'string_agg', chr(10)) AS text FROM documents"""
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM books)"
_NUMBERS = r"""nums AS (SELECT doc_id, line_no, CAST(nullif(regexp_extract(line, '^[ \t]*(\d+)[ \t]*$', 1), '') AS HUGEINT) AS v FROM lines),
lags AS (SELECT doc_id, line_no, v - row_number() OVER w AS lag FROM nums WHERE v IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
same AS (SELECT *, lag = first(lag) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM lags),
runs AS (SELECT doc_id, line_no FROM (SELECT *, bool_and(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS good FROM same) WHERE good QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2)"""

_BLANKS = "regexp_replace(x, '[ \\t]+', ' ', 'g')"

ORACLE_SQL = {
    "clean_texts": f"""WITH dirty AS ({_DIRTY_SQL}), c AS (SELECT doc_id, string_split({_SPACE(_CLEANED)}, chr(10)) AS ls FROM dirty)
SELECT doc_id, regexp_replace(list_aggregate(list_transform(ls, lambda x: {_STRIP('x')}), 'string_agg', chr(10)), '^\\n+|\\n+$', '', 'g') AS text FROM c""",
    "sanitised_chapters": f"WITH dirty AS ({_DIRTY_SQL}) SELECT doc_id, " + _STRIP("regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + " AS text FROM dirty",
    "text_measures": f"""SELECT doc_id, length(text) // 4 AS tokens, length(text) // 4 > 50000 AS beyond_limit, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')) AS words,
sha256(text) AS source_hash, len(list_filter(string_split(text, chr(10)), lambda p: {_STRIP('p')} <> '')) AS paragraphs FROM documents""",
    "content_tags": """WITH t AS (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN 'Status Window open' WHEN 1 THEN '[System] hi' WHEN 2 THEN 'STATUS: ok' ELSE '' END) AS t FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN contains(t, 'status window') OR contains(t, 'level up') OR contains(t, '[system]') THEN 'litrpg' END, CASE WHEN contains(t, 'status window') OR contains(t, 'status:') THEN 'stat_sheet' END) AS tags FROM t""",
    "code_fences": rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<think>plan' || chr(10) || t || '</think>' || chr(10) || '```json' || chr(10) || '{{"text": ' || t || '}}' || chr(10) || '```' || chr(10)
WHEN 1 THEN '```python x' || chr(10) || t || chr(10) || '```' WHEN 2 THEN '```' || t || '```  ' WHEN 3 THEN chr(9) || t || chr(10) || '```' || chr(10) ELSE '``` ' || chr(10) || t || ' ``` end' END AS x FROM a),
c AS (SELECT doc_id, {_STRIP("regexp_replace(x, '<think>.*?</think>', '', 'gis')")} AS x FROM b),
d AS (SELECT doc_id, CASE WHEN NOT starts_with(x, '```') THEN x WHEN contains(x, chr(10)) THEN substr(x, position(chr(10) IN x) + 1) ELSE substr(x, 4) END AS x FROM c)
SELECT doc_id, {_STRIP("CASE WHEN ends_with(x, '```') THEN left(x, length(x) - 3) ELSE x END")} AS answer FROM d""",
    "chapter_filenames": r"""WITH s AS (SELECT doc_id, regexp_replace(left(replace(regexp_replace(lower('Chapter ' || doc_id || ': The ' || text), '[^a-z0-9 _-]', '', 'g'), ' ', '_'), 50), '^[_-]+|[_-]+$', '', 'g') AS slug FROM documents)
SELECT doc_id, printf('%03d', doc_id) || '_' || coalesce(nullif(slug, ''), 'chapter_' || (doc_id + 1)) || '.txt' AS filename FROM s""",
    "filename_titles": rf"""WITH n AS (SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 'LOTM_-_' ELSE 'my-' END) || regexp_replace(text, '[^A-Za-z ]', '_', 'g') AS bare FROM documents),
w AS (SELECT doc_id, bare, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(bare, '_', ' '), '\s*-\s*', ' ', 'g'), '\s+'), lambda w: regexp_replace(w, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g')), lambda w: w <> '') AS ws FROM n)
SELECT doc_id, list_aggregate(list_transform(ws, lambda w: {_TITLE_WORD}), 'string_agg', ' ') AS title FROM w""",
    "file_names": "SELECT doc_id, CAST(doc_id AS INT) AS number, CAST(doc_id % 7 AS BIGINT) AS volume, doc_id AS chapter, n AS stem, n || '.json' AS json_name, n || '.xhtml' AS base FROM (SELECT doc_id, 'vol_' || (doc_id % 7) || '_chapter_' || doc_id AS n FROM documents)",
    "display_titles": "SELECT doc_id, 'Chapter ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' - Some Words' ELSE '' END AS title FROM documents",
    "tone_signs": "SELECT doc_id, ['💢', '💢', '', '🤫', '💧', '', '❗', '📢'][CAST(doc_id % 8 + 1 AS INT)] AS sign FROM documents",
    "highlighted": "SELECT doc_id, regexp_replace(text, '\\b(the and|hath|the)\\b', '<span class=\"keyword\">\\1</span>', 'gi') AS text FROM documents",
    "durations": """WITH s AS (SELECT event_id, floor(value * value) + 0.5 AS x FROM events) SELECT event_id, CASE WHEN x < 60 THEN printf('%.1fs', x) WHEN x < 3600 THEN printf('%dm %ds', CAST(floor(x / 60) AS BIGINT), CAST(floor(x) AS BIGINT) % 60)
ELSE printf('%dh %dm', CAST(floor(x / 3600) AS BIGINT), CAST(floor(x) AS BIGINT) % 3600 // 60) END AS took FROM s""",
    "error_kinds": f"""WITH m AS (SELECT doc_id, lower(coalesce(text, '') || {_ERRORS}[CAST(doc_id % {len(_ERRORS)} + 1 AS INT)]) AS m FROM documents)
SELECT doc_id, CASE WHEN contains(m, 'response_format') THEN 'json_mode' WHEN contains(m, '401') OR contains(m, 'invalid_api_key') OR contains(m, 'unauthorized') THEN 'auth'
WHEN contains(m, '429') OR contains(m, 'rate limit') OR contains(m, 'rate_limit') OR contains(m, 'quota') THEN 'rate_limit' ELSE 'other' END AS kind FROM m""",
    "backoff": "SELECT event_id, least(pow(2.0, event_id % 8), 10.0) AS wait, CAST(greatest(2, least(5, event_id % 8)) AS DOUBLE) AS clamped FROM events",
    "tags_cleaned": "SELECT p_partkey, p_brand || '|' || trim(p_type) || '|X' AS tags FROM part",
    "tags_parsed": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_tags FROM part",
    "record_checks": """SELECT p_partkey, concat_ws(',', CASE WHEN NOT length(p_name) BETWEEN 1 AND 500 THEN 'title' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'known' END, CASE WHEN p_size < 10 THEN 'index' END) AS broken,
length(p_name) BETWEEN 1 AND 500 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size >= 10 AS valid FROM part""",
    "series_fields": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'n-' || page_id ELSE CAST(page_id AS VARCHAR) END AS series, ['active', 'completed', 'dropped', 'active'][CAST(page_id % 4 + 1 AS INT)] AS status, 'https://x.y/c.jpg' AS cover FROM pages",
    "html_fields": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]+)</h1>', 1) AS heading, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<a[^>]*>([^<]+)</a>', 1), lambda t: trim(t)), lambda t: t <> '')[1:10], '|') AS tags FROM pages",
    "page_text": rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'gis'), '<[a-zA-Z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>', chr(10), 'gs') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[a-zA-Z/!?][^>]*>', chr(10), 'gs'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, coalesce(list_aggregate(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP(_BLANKS)}), lambda x: x <> ''), 'string_agg', chr(10)), '') AS t FROM b)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN rtrim('{_ODD_TEXT}' || chr(10) || t, chr(10)) ELSE t END AS text FROM c""",
    "chapters_split": rf"""WITH books AS ({_BOOK}), {_LINES}, {_NUMBERS},
heads AS (SELECT l.*, regexp_matches(line, '(?i)^[ \t]*(?:chapter|ch\.?|episode|ep\.?)\s+\d+.*$') OR (regexp_matches(line, '(?i)^[ \t]*(?:chapter|ch\.?|episode|ep\.?)[ \t]*$') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '^[ \t]*\d+'), false)) AS head FROM lines l),
final AS (SELECT h.doc_id, h.line_no, line, CASE WHEN bool_or(head) OVER (PARTITION BY h.doc_id) THEN head ELSE r.line_no IS NOT NULL END AS head FROM heads h LEFT JOIN runs r ON h.doc_id = r.doc_id AND h.line_no = r.line_no),
parts AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM final), most AS (SELECT *, max(part) OVER (PARTITION BY doc_id) AS parts FROM parts)
SELECT doc_id, CAST(greatest(part - 1, 0) AS INT) AS "index", CASE WHEN part = 0 THEN 'Chapter 1' ELSE {_STRIP('arg_min(line, line_no)')} END AS title, md5({_STRIP("string_agg(line, chr(10) ORDER BY line_no)")}) AS content_md5 FROM most WHERE part > 0 OR parts = 0 GROUP BY doc_id, part""",
    "sections_split": rf"""WITH books AS ({_BOOK}), {_LINES}, heads AS (SELECT *, regexp_matches({_STRIP('line')}, '(?i)^chapter\s+\d+|^第[一二三四五六七八九十百千]+章|^\d+\.|^==+\s*') AS head FROM lines),
parts AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM heads),
g AS (SELECT doc_id, part, max(CASE WHEN head THEN {_STRIP('line')} END) AS title, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT head) AS body FROM parts GROUP BY doc_id, part HAVING count(*) FILTER (NOT head) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT) AS "index", coalesce(title, 'Chapter 1') AS title, md5(body) AS content_md5 FROM g""",
    "number_runs": f"WITH books AS ({_BOOK}), {_LINES}, {_NUMBERS} SELECT doc_id, count(*) AS numbers FROM runs GROUP BY doc_id",
    "segment_ends": f"WITH books AS (SELECT doc_id, text FROM documents), {_LINES} SELECT doc_id, line_no, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), 1000000) AS \"end\" FROM lines",
    "renumbered_lines": f"WITH books AS (SELECT doc_id, text FROM documents), {_LINES} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS \"index\" FROM lines WHERE length(line) > 200",
    "narrator_islands": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY block_index, type, speaker) AS n FROM ({E.BLOCKS})),
f AS (SELECT chapter, block_index, n, type, coalesce(lag(type) OVER w = type, false) AS s, coalesce(lead(type) OVER w = type, false) AS e FROM b WINDOW w AS (PARTITION BY chapter ORDER BY n))
SELECT chapter, block_index, CAST(sum(CAST(NOT s AS INT)) OVER (PARTITION BY chapter ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island, type = 'narrator' AND s AS merge_top, type = 'narrator' AND e AS merge_bottom FROM f""",
    "block_stats": f"""WITH c AS (SELECT conv_id AS chapter, role AS type, count(*) AS blocks, CAST(sum(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> ''))) AS BIGINT) AS words FROM conversations GROUP BY 1, 2)
SELECT *, CAST(sum(blocks) OVER w AS BIGINT) AS total_blocks, CAST(sum(words) OVER w AS BIGINT) AS total_words FROM c WINDOW w AS (PARTITION BY chapter)""",
}
