"""Queries over speakers, novels, chapters and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import misc, names, style, text
from scriptorium.operators import graph, library, render, state
from scriptorium.plans import entities as E
from scriptorium.session import table

MAX_NODES = 80

_SPEAKING = "type IN ('dialogue', 'thought', 'monologue')"
_NODES = f"""SELECT * FROM (SELECT speaker, CAST(count(*) FILTER ({_SPEAKING}) AS BIGINT) AS lines, min(chapter) AS first_chapter,
  min({{'c': chapter, 'b': block_index}}) FILTER ({_SPEAKING}) AS said FROM blocks GROUP BY speaker) WHERE lines >= 2
  ORDER BY lines DESC, said, speaker LIMIT {MAX_NODES}"""


def _blocks(spark, d):
    return E.blocks(spark, d)


def character_edges(spark, d):
    """Co-appearance of the speakers with most lines."""
    blocks = _blocks(spark, d)
    return graph.edges(blocks, graph.nodes(blocks, 2, MAX_NODES))


def character_nodes(spark, d):
    return graph.nodes(_blocks(spark, d), 2, MAX_NODES).select("speaker", "lines", "first_chapter")


def graph_prefix(spark, d):
    blocks = graph.first_chapters(_blocks(spark, d), 200)
    return graph.edges(blocks)


def speaker_counts(spark, d):
    return graph.speaker_counts(_blocks(spark, d))


def node_layout(spark, d):
    nodes = character_nodes(spark, d).withColumn("all", F.lit(0))
    placed = render.circle_layout(nodes, "all", "lines", "speaker")
    return placed.select("speaker", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def neighbours(spark, d):
    return graph.met_with(_blocks(spark, d), "S1")


def novels_with_counts(spark, d):
    return library.novels_with_counts(E.novels(spark, d).select("id", "title"), E.chapters(spark, d).select("id", "novel_id"))


def novels_page(spark, d):
    return library.page(E.novels(spark, d), 25, 50).select("id", "title", "updated_at")


def novels_page_status(spark, d):
    return library.page_with_status(E.novels(spark, d), "BUILDING", 100, 0).select("id", "title")


def orphan_chapters(spark, d):
    known = E.novels(spark, d).where("id % 3 <> 0")
    return library.orphans(E.chapters(spark, d).select("id", "novel_id"), known)


def missing_files(spark, d):
    chapters = E.chapters(spark, d).select("id", "novel_id", "filename")
    path = names.chapter_path(F.lit("clean"), F.col("novel_id"), F.col("filename"))
    files = chapters.where("id % 4 <> 0").select(path.alias("path"))
    return library.missing_files(chapters, files, path).select("id", "path")


def cascade_survivors(spark, d):
    gone = E.novels(spark, d).where("id % 5 = 0").select("id")
    chapters = E.chapters(spark, d).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("novel_id")).alias("novel_id"))
    return library.without_novels(chapters, gone)


def chapter_neighbours(spark, d):
    return library.neighbour_ids(E.chapters(spark, d).select("id", "novel_id", "chapter_index"))


def page_links(spark, d):
    return render.page_links(E.chapters(spark, d), "novel_id", "chapter_index").select("id", "prev_link", "next_link")


def render_window(spark, d):
    return render.render_window(E.chapters(spark, d), "novel_id", "chapter_index").select("id", "window_from", "window_to")


def legacy_backfill(spark, d):
    old = E.chapters(spark, d).select("id", F.when(F.col("id") % 6 == 0, None).otherwise(F.col("novel_id")).alias("novel_id"))
    return library.adopt(old, 1).groupBy("novel_id").agg(F.count("*").alias("chapters"), F.count_if("adopted").alias("adopted"))


def database_info(spark, d):
    chapters = E.chapters(spark, d).select("id", F.when(F.col("id") % 6 == 0, None).otherwise(F.col("novel_id")).alias("novel_id"))
    return library.database_info(E.novels(spark, d), chapters)


def chapter_metadata(spark, d):
    c = E.chapters(spark, d)
    return c.select(
        "id",
        names.chapter_path(F.lit("json"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("novel_id")), names.json_filename(F.col("filename"))).alias("path"),
        F.coalesce("title", F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string"))).alias("title"),
        F.lit("complete").alias("status"),
        F.lit(0).alias("token_count"),
    )


def chapter_search(spark, d):
    c = E.chapters(spark, d)
    return c.where(text.fits_search(F.col("title"), F.col("chapter_index"), "12")).select("id")


def novel_search(spark, d):
    n = E.novels(spark, d)
    return n.where(text.fits_any("00 7", F.replace(F.col("title"), F.lit("#"), F.lit(" ")), F.col("status")) | text.fits_any("mach", F.col("status"))).select("id")


def state_upsert(spark, d):
    states = table(spark, d, "nation").select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.when(F.col("n_nationkey") < 3, None).otherwise(F.col("n_nationkey")).cast("bigint").alias("novel_id"),
        F.concat(F.lit("phase"), (F.col("n_nationkey") % 3).cast("string")).alias("phase"), F.col("n_name").alias("status"),
    )
    changes = states.where("id <= 10").select("novel_id", "phase", F.concat(F.lit("new "), F.col("status")).alias("status")).unionAll(
        table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("bigint"), F.lit("phase9"), "r_name")
    )
    return library.upsert(states, changes, ["novel_id", "phase"])


def _states(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("novel_id"), "event_type", "ts", "event_id", "value")


def overall_status(spark, d):
    word = F.when(F.col("value") < 40, "complete").when(F.col("value") < 80, "completed").when(F.col("value") < 99, "running").otherwise("failed")
    rows = _states(spark, d).select(F.concat_ws("-", "novel_id", "event_type", (F.hour("ts") % 4).cast("string")).alias("novel_id"), word.alias("status"))
    return library.overall_status(rows)


_WORD = "CASE WHEN value < 40 THEN 'complete' WHEN value < 80 THEN 'completed' WHEN value < 99 THEN 'running' ELSE 'failed' END"
_JOB = "CASE event_id % 6 WHEN 0 THEN 'raw' WHEN 1 THEN 'clean' WHEN 2 THEN 'json' WHEN 3 THEN 'html' WHEN 4 THEN 'failed' ELSE 'render_failed' END"


def _jobs(spark, d):
    return _states(spark, d).withColumn("status", F.expr(_JOB))


def phase_eligible(spark, d):
    return state.eligible(_jobs(spark, d), "json").groupBy("novel_id").agg(F.count("*").alias("todo"))


def job_progress(spark, d):
    return state.progress(_jobs(spark, d), ["novel_id"])


def incremental_plan(spark, d):
    sources = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("filename"), F.when(F.col("doc_id") % 50 == 0, None).otherwise(text.source_hash(F.col("text"))).alias("source_hash")
    )
    old = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("x"))).otherwise(F.col("text"))
    outputs = table(spark, d, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("filename"), text.source_hash(old).alias("source_hash"))
    return state.plan_batch(sources, outputs).select("filename", "outcome")


def batch_outcomes(spark, d):
    return state.outcome_counts(incremental_plan(spark, d))


def latest_state(spark, d):
    rows = _states(spark, d).select("novel_id", "event_type", "event_id", "ts", "value")
    return state.latest(rows, ["novel_id", "event_type"], F.struct("ts", "event_id")).select("novel_id", "event_type", "event_id", "value")


def issue_numbers(spark, d):
    errors = _states(spark, d).select(
        "ts", F.col("event_id").alias("id"), F.col("novel_id").alias("chapter"), F.lit("transform").alias("phase"), F.col("event_type").alias("kind")
    )
    return state.number_issues(errors).select("chapter", "kind", "id", "issue_id")


def paced_calls(spark, d):
    """Calls of each user, an hour after the end of the one before; some take days, some have no duration."""
    took = F.when(F.col("event_id") % 11 != 0, F.floor("value") * 3600)
    calls = _states(spark, d).select("novel_id", F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("arrival"), took.alias("took"))
    return state.paced(calls, ["novel_id"], "arrival", 3600, "took").select("id", F.col("start").cast("bigint").alias("start"))


def reading_progress(spark, d):
    events = _states(spark, d).select("novel_id", F.floor("value").cast("bigint").alias("chapter_id"), "ts")
    done = state.reading_progress(events)
    return done.select("novel_id", "chapters_read", "current_chapter", misc.reading_percent(F.col("chapters_read"), F.lit(120)).alias("percent"))


def speaker_styles(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("speaker"))
    c = F.col("speaker")
    return s.select("speaker", style.speaker_color(c).alias("color"), style.speaker_lane(c).alias("lane"), style.speaker_class(c).alias("css_class"))


def speaker_contrast(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("speaker"))
    rgb = style.hsl_rgb(style.speaker_color(F.col("speaker")))
    back = style.hex_rgb(F.lit("#1a1a1a"))
    ratio = style.contrast(rgb, back)
    return s.select("speaker", F.round(ratio, 6).alias("ratio"), style.passes_aa(rgb, back).alias("readable"))


def image_fit(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 11).alias("w"), (F.col("p_partkey") % 900 + 20).cast("int").alias("h"))
    return p.withColumn("f", style.aspect_fit(F.col("w"), F.col("h"))).select("p_partkey", "f.w", "f.h", "f.x", "f.y")


QUERIES = {
    f.__name__: f
    for f in (
        character_edges, character_nodes, graph_prefix, speaker_counts, node_layout, neighbours, novels_with_counts, novels_page, novels_page_status,
        orphan_chapters, missing_files, cascade_survivors, chapter_neighbours, page_links, render_window, legacy_backfill, database_info, chapter_metadata,
        chapter_search, novel_search, state_upsert, overall_status, phase_eligible, job_progress, incremental_plan, batch_outcomes, latest_state,
        issue_numbers, paced_calls, reading_progress, speaker_styles, speaker_contrast, image_fit,
    )
}

_WITH_BLOCKS = f"WITH blocks AS ({E.BLOCKS})"
_EDGES = """SELECT a.speaker AS source, b.speaker AS target, count(*) AS weight FROM present a JOIN present b ON a.chapter = b.chapter AND a.speaker < b.speaker GROUP BY 1, 2"""
_CHAPTERS = f"WITH chapters AS ({E.CHAPTERS})"
_OLD = "SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE novel_id END AS novel_id FROM chapters"


def _mod_sql(x: str, m: int) -> str:
    """MD5 as a number modulo m, in four chunks."""
    acc = "0"
    for i in range(4):
        acc = f"(({acc}) * {2**32 % m} + CAST(('0x' || substr(md5({x}), {1 + 8 * i}, 8)) AS BIGINT)) % {m}"
    return acc


_COLOR = "printf('hsl(%d, %d%%, %d%%)', h, sat, light)"
_COLORS = f"SELECT s_name AS speaker, {_mod_sql('s_name', 360)} AS h, 65 + {_mod_sql('s_name', 11)} AS sat, 70 + {_mod_sql('s_name', 6)} AS light, {_mod_sql('s_name', 2)} AS side FROM supplier"


def _channel_sql(n: int) -> str:
    k = f"fmod({n} + h / 30.0, 12)"
    return f"round_even((light / 100.0 - (1 - abs(2 * light / 100.0 - 1)) * sat / 100.0 / 2 * greatest(-1.0, least({k} - 3, 9 - {k}, 1.0))) * 255, 0)"


_LINEAR = lambda c: f"(CASE WHEN {c} / 255 <= 0.03928 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END)"
_LUM = lambda r, g, b: f"(0.2126 * {_LINEAR(r)} + 0.7152 * {_LINEAR(g)} + 0.0722 * {_LINEAR(b)})"

ORACLE_SQL = {
    "character_edges": f"{_WITH_BLOCKS}, nodes AS ({_NODES}), present AS (SELECT DISTINCT chapter, speaker FROM blocks WHERE speaker IN (SELECT speaker FROM nodes)) {_EDGES}",
    "character_nodes": f"{_WITH_BLOCKS} SELECT speaker, lines, first_chapter FROM ({_NODES})",
    "graph_prefix": f"{_WITH_BLOCKS}, present AS (SELECT DISTINCT chapter, speaker FROM blocks WHERE chapter IN (SELECT DISTINCT chapter FROM blocks ORDER BY chapter LIMIT 200)) {_EDGES}",
    "speaker_counts": f"{_WITH_BLOCKS} SELECT speaker, count(*) AS blocks FROM blocks GROUP BY speaker",
    "node_layout": f"{_WITH_BLOCKS}, n AS ({_NODES}), r AS (SELECT speaker, row_number() OVER (ORDER BY lines DESC, speaker) - 1 AS i, count(*) OVER () AS n FROM n) SELECT speaker, round(cos(2 * pi() * i / n - pi() / 2), 6) + 0.0 AS x, round(sin(2 * pi() * i / n - pi() / 2), 6) + 0.0 AS y FROM r",
    "neighbours": f"{_WITH_BLOCKS}, present AS (SELECT DISTINCT chapter, speaker FROM blocks), e AS ({_EDGES}) SELECT CASE WHEN source = 'S1' THEN target ELSE source END AS neighbour, weight FROM e WHERE source = 'S1' OR target = 'S1'",
    "novels_with_counts": f"WITH novels AS ({E.NOVELS}), chapters AS ({E.CHAPTERS}) SELECT n.id, n.title, count(c.id) AS chapter_count FROM novels n LEFT JOIN chapters c ON c.novel_id = n.id GROUP BY n.id, n.title",
    "novels_page": f"SELECT id, title, updated_at FROM ({E.NOVELS}) ORDER BY updated_at DESC, id LIMIT 25 OFFSET 50",
    "novels_page_status": f"SELECT id, title FROM (SELECT * FROM ({E.NOVELS}) ORDER BY updated_at DESC, id LIMIT 100) WHERE status = 'BUILDING'",
    "orphan_chapters": f"{_CHAPTERS} SELECT id, novel_id FROM chapters WHERE novel_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
    "missing_files": f"{_CHAPTERS} SELECT id, 'data/clean/novel_' || novel_id || '/' || filename AS path FROM chapters WHERE id % 4 = 0",
    "cascade_survivors": f"{_CHAPTERS}, c AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE novel_id END AS novel_id FROM chapters) SELECT * FROM c WHERE novel_id IS NULL OR novel_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)",
    "chapter_neighbours": f"{_CHAPTERS} SELECT id, novel_id, chapter_index, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM chapters WINDOW w AS (PARTITION BY novel_id ORDER BY chapter_index, id)",
    "page_links": f"{_CHAPTERS}, l AS (SELECT *, replace(filename, '.xhtml', '.html') AS link FROM chapters) SELECT id, lag(link) OVER w AS prev_link, lead(link) OVER w AS next_link FROM l WINDOW w AS (PARTITION BY novel_id ORDER BY chapter_index)",
    "render_window": f"{_CHAPTERS}, c AS (SELECT id, chapter_index AS i, CAST(count(*) OVER (PARTITION BY novel_id) AS INT) AS n FROM chapters), f AS (SELECT *, greatest(1, least(i - 2, n - 4)) AS a FROM c) SELECT id, a AS window_from, least(n, a + 4) AS window_to FROM f",
    "legacy_backfill": f"{_CHAPTERS}, old AS ({_OLD}) SELECT coalesce(novel_id, 1) AS novel_id, count(*) AS chapters, count(*) FILTER (novel_id IS NULL) AS adopted FROM old GROUP BY 1",
    "database_info": f"{_CHAPTERS}, old AS ({_OLD}) SELECT (SELECT count(*) FROM customer) AS novels, count(*) AS chapters, count(*) FILTER (novel_id IS NULL) AS legacy_chapters, count(DISTINCT novel_id) AS novels_with_chapters FROM old",
    "chapter_metadata": f"{_CHAPTERS} SELECT id, 'data/json/' || CASE WHEN id % 9 = 0 THEN '' ELSE 'novel_' || novel_id || '/' END || replace(filename, '.xhtml', '.json') AS path, coalesce(title, 'Chapter ' || chapter_index) AS title, 'complete' AS status, 0 AS token_count FROM chapters",
    "chapter_search": f"{_CHAPTERS} SELECT id FROM chapters WHERE coalesce(contains(lower(title), '12'), false) OR contains(CAST(chapter_index AS VARCHAR), '12')",
    "novel_search": "SELECT c_custkey AS id FROM customer WHERE contains(lower(replace(c_name, '#', ' ')), '00 7') OR contains(lower(c_mktsegment), '00 7') OR contains(lower(c_mktsegment), 'mach')",
    "state_upsert": """WITH s AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(CASE WHEN n_nationkey < 3 THEN NULL ELSE n_nationkey END AS BIGINT) AS novel_id, 'phase' || (n_nationkey % 3) AS phase, n_name AS status FROM nation)
SELECT id, novel_id, phase, CASE WHEN id <= 10 THEN 'new ' || status ELSE status END AS status FROM s
UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY r_regionkey), CAST(r_regionkey + 100 AS BIGINT), 'phase9', r_name FROM region""",
    "overall_status": f"""WITH s AS (SELECT user_id || '-' || event_type || '-' || (hour(ts) % 4) AS novel_id, {_WORD} AS status FROM events)
SELECT novel_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' ELSE 'in_progress' END AS overall FROM s GROUP BY novel_id""",
    "phase_eligible": f"SELECT user_id AS novel_id, count(*) AS todo FROM events WHERE {_JOB} NOT IN ('json', 'html') GROUP BY 1",
    "job_progress": f"SELECT user_id AS novel_id, count(*) AS total, count(*) FILTER ({_JOB} IN ('html', 'failed', 'render_failed')) AS completed, count(*) FILTER ({_JOB} IN ('html', 'failed', 'render_failed')) * 100.0 / count(*) AS percentage FROM events GROUP BY 1",
    "incremental_plan": "SELECT CAST(doc_id AS VARCHAR) AS filename, CASE WHEN doc_id % 50 = 0 THEN 'failed' WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN 'skipped' ELSE 'processed' END AS outcome FROM documents",
    "batch_outcomes": """WITH o AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'failed' WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN 'skipped' ELSE 'processed' END AS o FROM documents)
SELECT count(*) FILTER (o = 'processed') AS processed, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed, count(*) AS total, count(*) FILTER (o = 'failed') * 2 > count(*) AS alarm FROM o""",
    "latest_state": "SELECT user_id AS novel_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "issue_numbers": """WITH f AS (SELECT user_id AS chapter, event_type AS kind, event_id AS id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)
SELECT chapter, kind, id, printf('ISSUE-%s-%03d', strftime(ts, '%Y-%m-%d'), row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id)) AS issue_id FROM f""",
    "paced_calls": """WITH RECURSIVE c AS (SELECT user_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS BIGINT) * 3600 ELSE 0 END AS took,
row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
r AS (SELECT user_id, id, n, t AS start, t + took AS "end" FROM c WHERE n = 1
UNION ALL SELECT c.user_id, c.id, c.n, greatest(c.t, r."end" + 3600), greatest(c.t, r."end" + 3600) + c.took FROM r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1)
SELECT id, CAST(start AS BIGINT) AS start FROM r""",
    "reading_progress": """SELECT user_id AS novel_id, count(DISTINCT CAST(floor(value) AS BIGINT)) AS chapters_read, arg_max(CAST(floor(value) AS BIGINT), {'t': ts, 'c': CAST(floor(value) AS BIGINT)}) AS current_chapter,
CAST(floor(100.0 * count(DISTINCT CAST(floor(value) AS BIGINT)) / 120 + 0.5) AS BIGINT) AS percent FROM events GROUP BY 1""",
    "speaker_styles": f"SELECT speaker, {_COLOR} AS color, CASE side WHEN 0 THEN 'right' ELSE 'left' END AS lane, 'char-' || substr(regexp_replace(md5(speaker), '^0+', ''), 1, 16) AS css_class FROM ({_COLORS})",
    "speaker_contrast": f"""WITH c AS ({_COLORS}), rgb AS (SELECT speaker, {_channel_sql(0)} AS r, {_channel_sql(8)} AS g, {_channel_sql(4)} AS b FROM c),
l AS (SELECT speaker, ({_LUM('r', 'g', 'b')} + 0.05) / ({_LUM('26.0', '26.0', '26.0')} + 0.05) AS q FROM rgb) SELECT speaker, round(q, 6) AS ratio, q >= 4.5 AS readable FROM l""",
    "image_fit": """WITH s AS (SELECT p_partkey, p_size * 37 + 11 AS w, CAST(p_partkey % 900 + 20 AS INT) AS h FROM part), f AS (SELECT *, least(CAST(400 AS DOUBLE) / w, CAST(600 AS DOUBLE) / h) AS q FROM s),
g AS (SELECT p_partkey, CAST(floor(w * q) AS INT) AS w, CAST(floor(h * q) AS INT) AS h FROM f) SELECT p_partkey, w, h, CAST(floor((400 - w) / 2) AS INT) AS x, CAST(floor((600 - h) / 2) AS INT) AS y FROM g""",
}
