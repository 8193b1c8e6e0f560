"""Queries over upkeep of library and glossary, states of phases, whole pages and other sites' data."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import misc, text
from scriptorium.operators import corrections, glossary, graph, library, render, search, state
from scriptorium.plans import entities as E
from scriptorium.plans import markup
from scriptorium.plans import relational as R
from scriptorium.session import fresh_folder, table
from scriptorium.sources.state_table import StateTable, run_phases

NOVEL = 7


def novel_by_id(spark, d):
    return library.by_id(E.novels(spark, d), NOVEL).select("id", "title")


def novel_chapters(spark, d):
    return library.chapters_of(E.chapters(spark, d), NOVEL).select("id", "chapter_index")


def chapters_belonging(spark, d):
    """Each line asks for its order as a chapter of the novel with its supplier's number."""
    asked = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("novel_id"), F.col("l_orderkey").alias("chapter_id")).distinct()
    return library.belonging(asked, E.chapters(spark, d).select("id", "novel_id"))


def chapters_moved(spark, d):
    chapters = E.chapters(spark, d).select("id", "novel_id")
    moves = chapters.where("id % 4 = 0").select(F.col("id").alias("chapter_id"), F.when(F.col("id") % 8 != 0, F.col("novel_id") + 1).alias("novel_id"))
    return library.moved_to(chapters, moves)


def chapters_updated(spark, d):
    rows = E.novels(spark, d)
    changed = library.update_fields(rows, NOVEL, ["title", "status"], F.lit(0.0), title="New", id=1)
    return changed.select("id", "title", "status", "updated_at")


def chapters_appended(spark, d):
    old = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("title"))
    new = table(spark, d, "nation").select(F.col("n_name").alias("title"))
    return library.append_rows(old, new)


def absent_inserted(spark, d):
    old = table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_name", "n_regionkey")
    new = table(spark, d, "nation").select("n_name", "n_regionkey")
    return library.insert_absent(old, new, "n_name")


def unique_speakers(spark, d):
    found = graph.unique_speakers(E.blocks(spark, d))
    return found.select("chapter", F.array_join("speakers", ",").alias("speakers"))


def edges_by_weight(spark, d):
    return graph.by_weight(R.character_edges(spark, d))


def graph_scales(spark, d):
    return graph.scales(R.character_nodes(spark, d), R.character_edges(spark, d))


def glossary_of_category(spark, d):
    return glossary.of_category(E.glossary(spark, d), "ASIA").select("ord", "name")


def glossary_without(spark, d):
    entries = E.glossary(spark, d).select("category", "ord", "name", "raw")
    return glossary.without_names(entries, entries.where("ord % 4 = 0"))


def glossary_changed(spark, d):
    """Every entry twice; the first of each name is changed."""
    entries = E.glossary(spark, d).select("category", "ord", "name", "raw")
    twice = entries.unionAll(entries.withColumn("ord", F.col("ord") + 1_000_000))
    return glossary.with_first_changed(twice, entries.where("ord % 3 = 0").withColumn("raw", F.concat(F.lit("new "), F.col("raw"))))


def glossary_json(spark, d):
    return glossary.as_json(E.glossary(spark, d).select("category", "ord", "name", "raw"))


def glossary_sections(spark, d):
    """The text of the entries of each category that fit a prompt, with the notice of the rest."""
    block = glossary.format_entry(F.col("name"), F.col("raw"), F.col("aliases"), F.lit(""))
    entries = E.glossary(spark, d).select("category", "ord", "name", F.lit(1).alias("rank"), F.lit("Terms").alias("heading"), block.alias("block"))
    made = glossary.section(glossary.within_budget(entries, 200, ["category"]), ["category"])
    return made.select("category", F.regexp_count("section", F.lit(r"\*\* \(")).cast("bigint").alias("shown"), F.contains("section", F.lit("_Truncated: ")).alias("truncated"))


def glossary_effect(spark, d):
    again = E.turns(spark, d).withColumn("content", F.coalesce("content", F.lit("")))
    odd = lambda n: again.withColumn("content", F.when((F.col("chapter") + F.col("block_index")) % n == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    found = glossary.effectiveness(odd(2), odd(5), again, ["chapter"])
    return found.select("chapter", *[F.round(c, 6).alias(c) for c in ("score_plain", "score_helped", "gain")], "low")


def glossary_sample(spark, d):
    """How many entries a seeded sample of 40 holds, and that it is the same again."""
    sample = lambda: glossary.seeded_sample(E.glossary(spark, d), "name", 40, 3).select("name")
    one, two = sample(), sample()
    return one.join(two, "name", "left_semi").agg(F.count("*").alias("kept_twice"), F.countDistinct("name").alias("names"))


def common_transition(spark, d):
    """The most common transition of the users' events of one type."""
    before = F.expr("lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    log = table(spark, d, "events").select(before.alias("original_type"), F.col("event_type").alias("corrected_type"), F.col("event_type").alias("chapter"))
    counts = corrections.transitions(log.where("original_type <> corrected_type"), "click")
    return corrections.most_common(counts).select("transition", "count")


def phase_states(spark, d):
    """Jobs after the phases clean, json and html, with their error texts."""
    jobs = R._jobs(spark, d).select(F.col("event_id"), "status", F.lit(None).cast("string").alias("error"), "value")
    for n, phase in enumerate(state.PHASES[1:]):
        failed = F.when(F.floor("value") % 10 == n, F.concat(F.lit(f"{phase}: "), F.floor("value").cast("string")))
        jobs = state.after_phase(jobs, phase, F.col("value") >= 20, failed)
    return jobs.select("event_id", "status", "error")


def phase_table(spark, d):
    """The states of ``phase_states``, kept in a table of states: an epoch for the load and one for each phase."""
    jobs = R._jobs(spark, d).select("event_id", "status", F.lit(None).cast("string").alias("error"), "value")
    table_ = StateTable(spark, fresh_folder(spark, "states"), ["event_id"], jobs.schema, buckets=16)
    table_.upsert(jobs, 0, "load")

    def phase(n: int, name: str):
        failed = F.when(F.floor("value") % 10 == n, F.concat(F.lit(f"{name}: "), F.floor("value").cast("string")))
        return lambda due: due.select("event_id", (F.col("value") >= 20).alias("done"), failed.alias("failed"))

    run_phases(table_, [(name, phase(n, name)) for n, name in enumerate(state.PHASES[1:])])
    return table_.read().select("event_id", "status", "error")


def novel_index_search(spark, d):
    """Novels whose title holds a mark and zeros, by the index of trigrams."""
    rows, path = E.novels(spark, d).select("id", "title"), fresh_folder(spark, "titles")
    search.write_index(rows, "id", "title", path)
    return search.search(rows, "id", "title", path, "R#00000")


def phase_totals(spark, d):
    runs = R._jobs(spark, d).groupBy("novel_id", "status").agg(F.count_if(F.col("value") >= 20).alias("processed"), F.count_if(F.col("value") < 20).alias("failed"))
    return state.phase_totals(runs, ["novel_id"])


def run_summaries(spark, d):
    plan = R.incremental_plan(spark, d)
    rows = plan.select((F.col("filename").cast("bigint") % 10).alias("job"), F.col("filename").alias("name"), "outcome")
    return state.run_summary(rows, ["job"]).withColumn("failures", F.array_join("failures", ","))


def log_newest(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type")
    return state.newest_first(rows, "ts", "event_id").limit(50).select("event_id", misc.log_time(F.col("ts")).alias("at"), "event_type")


def _pages(spark, d):
    """Scripts of conversations: every seventh is not readable, every fifth is empty."""
    blocks = E.turns(spark, d).where("chapter % 7 <> 0").withColumns({"type": F.lit("dialogue"), "tone": F.lit(""), "content": F.when(F.col("chapter") % 5 != 0, F.coalesce("content", F.lit("")))})
    return render.chapter_pages(blocks)


def render_counts(spark, d):
    chapters = E.turns(spark, d).select("chapter").distinct().withColumn("readable", F.col("chapter") % 7 != 0)
    return render.render_stats(render.render_outcomes(chapters, _pages(spark, d), "chapter"))


def chapter_documents(spark, d):
    """Whole pages with links to the conversations before and after."""
    pages = _pages(spark, d).withColumns({"novel_id": F.col("chapter") % 20, "filename": F.concat(F.lit("c"), F.col("chapter").cast("string"), F.lit(".json"))})
    linked = render.page_links(pages, "novel_id", "chapter")
    title = F.concat(F.lit("Talk & "), F.col("chapter").cast("string"))
    whole = render.chapter_document(title, F.col("body"), F.col("prev_link"), F.col("next_link"), F.lit(None).cast("string"), F.lit("v1"))
    return linked.select("chapter", text.source_hash(whole).alias("document_hash"))


def issue_texts(spark, d):
    found = R.issue_numbers(spark, d)
    made = render.issue_text(F.col("issue_id"), F.col("chapter").cast("string"), F.lit("transform"), F.col("kind"), F.lit(None).cast("string"))
    return found.select("id", made.alias("issue"))


def series_pages(spark, d):
    """Fields of series pages that carry each web page's url and number."""
    key = F.col("page_id").cast("string")
    head = F.concat(F.lit('<h1 class="series-title"> T'), key, F.lit(' </h1><span class="author"><a href="/a">Ann '), key, F.lit("</a></span>"))
    rest = F.concat(F.lit('<img id="series_image" src="/c/'), key, F.lit('.jpg"><div id="editdescription">\n About '), key, F.lit('</div><a class="genre"> G </a><a class="genre"></a><a class="genre">H</a>'))
    mark = F.concat(F.lit('<span class="status">'), F.when(F.col("page_id") % 2 == 0, " Completed").otherwise("?"), F.lit("</span>"))
    html = F.concat(F.col("html"), F.when(F.col("page_id") % 3 != 0, head).otherwise(""), rest, mark)
    found = table(spark, d, "pages").select("page_id", misc.series_page(html).alias("s")).where("s is not null")
    return found.select("page_id", "s.title", "s.author", "s.cover_url", "s.synopsis", F.array_join("s.tags", "|").alias("tags"), "s.status")


def series_payloads(spark, d):
    """Records of search payloads that are made of each web page's number and url."""
    one = F.to_json(F.struct(F.concat(F.lit("T "), F.col("page_id").cast("string")).alias("title"), F.struct(F.lit("Ann").alias("name")).alias("author"), F.lit("/c.jpg").alias("coverUrl"), F.col("url").alias("description"), F.array(F.struct(F.lit(" A ").alias("name")), F.struct(F.lit("").alias("name"))).alias("genres"), F.lit("COMPLETED").alias("status")))
    payload = F.when(F.col("page_id") % 4 == 0, '{"data": []}').when(F.col("page_id") % 4 == 1, "broken").otherwise(F.concat(F.lit('{"data": ['), one, F.lit("]}")))
    found = table(spark, d, "pages").select("page_id", misc.series_record(payload, "https://x.y").alias("s")).where("s is not null")
    return found.select("page_id", "s.title", "s.author", "s.cover_url", "s.synopsis", F.array_join("s.tags", "|").alias("tags"), "s.status")


def preferred_styles(spark, d):
    styles = R.speaker_styles(spark, d)
    prefs = styles.where("speaker like '%7'").select("speaker", F.lit("#fff").alias("color"), F.lit("").alias("lane"), F.lower("speaker").alias("display_name"))
    return render.with_preferences(styles, prefs).select("speaker", F.col("color").alias("shown_color"), F.col("display_name").alias("shown_name"))


def speaker_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", corrections.text_mentions(F.coalesce("text", F.lit("")), "and").cast("bigint").alias("mentions"))


QUERIES = {
    f.__name__: f
    for f in (
        novel_by_id, novel_chapters, chapters_belonging, chapters_moved, chapters_updated, chapters_appended, absent_inserted, unique_speakers, edges_by_weight,
        graph_scales, glossary_of_category, glossary_without, glossary_changed, glossary_json, glossary_sections, glossary_effect, glossary_sample,
        common_transition, phase_states, phase_table, novel_index_search, phase_totals, run_summaries, log_newest, render_counts, chapter_documents, issue_texts, series_pages, series_payloads,
        preferred_styles, speaker_mentions,
    )
}

_GLOSSARY = f"g AS ({E.GLOSSARY})"
_TURNS = "t AS (SELECT conv_id AS chapter, turn AS block_index, role AS speaker, coalesce(text, '') AS content FROM conversations)"
_HTML = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"
_SCORES = lambda n: f"SELECT chapter, greatest(0.0, 1 - count(*) FILTER ((chapter + block_index) % {n} = 0) / CAST(count(*) AS DOUBLE)) AS s FROM t GROUP BY chapter"
_SHAPE = f"""CASE WHEN speaker = '' THEN '' ELSE '<span class="speaker">' || {_HTML('speaker')} || '</span>' END"""
_LANE = f"CASE ({R._mod_sql('speaker', 2)}) WHEN 0 THEN 'right' ELSE 'left' END"
_BLOCK = f"""'<div class="block dialogue char-' || substr(regexp_replace(md5(speaker), '^0+', ''), 1, 16) || ' ' || {_LANE} || '">' || {_SHAPE} || '<p>' || {_HTML('content')} || '</p></div>'"""


def _after_sql(n: int, phase: str, later: str, broken: str) -> str:
    """One phase: from ``p{n}`` to ``p{n + 1}``."""
    due = f"status NOT IN ({later})"
    bad = f"CAST(floor(value) AS BIGINT) % 10 = {n}"
    return f"""p{n + 1} AS (SELECT event_id, value, CASE WHEN {due} AND {bad} THEN '{broken}' WHEN {due} AND value >= 20 THEN '{phase}' ELSE status END AS status,
 CASE WHEN {due} AND {bad} THEN '{phase}: ' || CAST(floor(value) AS BIGINT) WHEN {due} AND value >= 20 THEN NULL ELSE error END AS error FROM p{n})"""


ORACLE_SQL = {
    "novel_by_id": f"SELECT id, title FROM ({E.NOVELS}) WHERE id = {NOVEL}",
    "novel_chapters": f"SELECT id, chapter_index FROM ({E.CHAPTERS}) WHERE novel_id = {NOVEL}",
    "chapters_belonging": "SELECT DISTINCT l_suppkey AS novel_id, l_orderkey AS chapter_id, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = l_suppkey) AS found FROM lineitem",
    "chapters_moved": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS novel_id FROM orders",
    "chapters_updated": f"SELECT id, CASE WHEN id = {NOVEL} THEN 'New' ELSE title END AS title, status, CASE WHEN id = {NOVEL} THEN 0.0 ELSE updated_at END AS updated_at FROM ({E.NOVELS})",
    "chapters_appended": """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS title FROM region
UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_name), n_name FROM nation""",
    "absent_inserted": "SELECT n_name, n_regionkey FROM nation",
    "unique_speakers": f"SELECT chapter, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers FROM ({E.BLOCKS}) WHERE type IN ('dialogue', 'thought') AND speaker <> '' GROUP BY chapter",
    "edges_by_weight": R.ORACLE_SQL["character_edges"],
    "graph_scales": f"SELECT (SELECT greatest(1, max(lines)) FROM ({R.ORACLE_SQL['character_nodes']})) AS max_lines, (SELECT greatest(1, max(weight)) FROM ({R.ORACLE_SQL['character_edges']})) AS max_weight",
    "glossary_of_category": f"SELECT ord, name FROM ({E.GLOSSARY}) WHERE category = 'ASIA'",
    "glossary_without": f"SELECT category, ord, name, raw FROM ({E.GLOSSARY}) WHERE ord % 4 <> 0",
    "glossary_changed": f"""WITH {_GLOSSARY} SELECT category, ord, name, CASE WHEN ord % 3 = 0 THEN 'new ' || raw ELSE raw END AS raw FROM g
UNION ALL SELECT category, ord + 1000000, name, raw FROM g""",
    "glossary_json": f"""SELECT category, '[' || string_agg('{{"name":"' || name || '","raw":"' || raw || '"}}', ',' ORDER BY ord) || ']' AS entries FROM ({E.GLOSSARY}) GROUP BY category""",
    "glossary_sections": f"""WITH {_GLOSSARY}, b AS ({markup.ORACLE_SQL['glossary_budget']}), n AS (SELECT category, count(*) AS n FROM g GROUP BY 1)
SELECT category, count(*) AS shown, count(*) < any_value(n) AS truncated FROM b JOIN n USING (category) GROUP BY 1""",
    "glossary_effect": f"""WITH {_TURNS}, a AS ({_SCORES(2)}), b AS ({_SCORES(5)})
SELECT chapter, round(a.s, 6) AS score_plain, round(b.s, 6) AS score_helped, round(b.s - a.s, 6) AS gain, b.s < 0.7 AS low FROM a JOIN b USING (chapter)""",
    "glossary_sample": "SELECT least(40, count(*)) AS kept_twice, least(40, count(*)) AS names FROM supplier",
    "common_transition": """WITH l AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events)
SELECT upper(a) || '->' || upper(b) AS transition, count(*) AS count FROM l WHERE a <> b AND b = 'click' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "phase_states": f"""WITH p0 AS (SELECT event_id, value, {R._JOB} AS status, CAST(NULL AS VARCHAR) AS error FROM events),
{_after_sql(0, 'clean', "'clean', 'json', 'html'", 'failed')}, {_after_sql(1, 'json', "'json', 'html'", 'failed')}, {_after_sql(2, 'html', "'html'", 'render_failed')} SELECT event_id, status, error FROM p3""",
    "novel_index_search": "SELECT c_custkey AS id, c_name AS title FROM customer WHERE contains(lower(c_name), 'r#00000')",
    "phase_totals": "SELECT user_id AS novel_id, count(*) FILTER (value >= 20) AS processed, count(*) FILTER (value < 20) AS failed FROM events GROUP BY 1",
    "run_summaries": f"""WITH p AS ({R.ORACLE_SQL['incremental_plan']})
SELECT CAST(filename AS BIGINT) % 10 AS job, count(*) FILTER (outcome = 'processed') AS created, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS errors, count(*) AS total,
coalesce(string_agg(filename, ',' ORDER BY filename) FILTER (outcome = 'failed'), '') AS failures FROM p GROUP BY 1""",
    "log_newest": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "render_counts": f"""WITH {_TURNS}, c AS (SELECT DISTINCT chapter FROM t) SELECT count(*) FILTER (chapter % 7 <> 0 AND chapter % 5 <> 0) AS rendered, count(*) FILTER (chapter % 7 = 0) AS failed,
count(*) FILTER (chapter % 7 <> 0 AND chapter % 5 = 0) AS skipped, count(*) AS total FROM c""",
    "chapter_documents": f"""WITH {_TURNS}, b AS (SELECT chapter, string_agg({_BLOCK}, chr(10) ORDER BY block_index, {_BLOCK}) AS body FROM t WHERE chapter % 7 <> 0 AND chapter % 5 <> 0 GROUP BY chapter),
l AS (SELECT *, 'c' || lag(chapter) OVER w || '.html' AS p, 'c' || lead(chapter) OVER w || '.html' AS n FROM b WINDOW w AS (PARTITION BY chapter % 20 ORDER BY chapter))
SELECT chapter, sha256('<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Talk &amp; ' || chapter || '</title></head><body><nav>' || concat_ws(' ', '<a rel="prev" href="' || p || '">prev</a>', '<a rel="next" href="' || n || '">next</a>')
|| '</nav><ol></ol><h1>Talk &amp; ' || chapter || '</h1>' || chr(10) || body || chr(10) || '<footer>v1</footer></body></html>') AS document_hash FROM l""",
    "issue_texts": f"""SELECT id, '## ' || issue_id || chr(10) || '- chapter: ' || chapter || chr(10) || '- phase: transform' || chr(10) || '- kind: ' || kind || chr(10) || '- message: ' AS issue FROM ({R.ORACLE_SQL['issue_numbers']})""",
    "series_pages": """SELECT page_id, 'T' || page_id AS title, 'Ann ' || page_id AS author, '/c/' || page_id || '.jpg' AS cover_url, 'About ' || page_id AS synopsis, 'G|H' AS tags,
CASE WHEN page_id % 2 = 0 THEN 'completed' ELSE 'active' END AS status FROM pages WHERE page_id % 3 <> 0""",
    "series_payloads": "SELECT page_id, 'T ' || page_id AS title, 'Ann' AS author, 'https://x.y/c.jpg' AS cover_url, url AS synopsis, 'A' AS tags, 'completed' AS status FROM pages WHERE page_id % 4 > 1",
    "preferred_styles": f"""WITH s AS ({R.ORACLE_SQL['speaker_styles']}) SELECT speaker, CASE WHEN speaker LIKE '%7' THEN '#fff' ELSE color END AS shown_color, CASE WHEN speaker LIKE '%7' THEN lower(speaker) ELSE speaker END AS shown_name FROM s""",
    "speaker_mentions": "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), 'and')) AS BIGINT) AS mentions FROM documents",
}
ORACLE_SQL["phase_table"] = ORACLE_SQL["phase_states"]
