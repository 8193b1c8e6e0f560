"""Queries over glossaries, corrections, pages and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import names, text
from scriptorium.operators import corrections, glossary, render, state
from scriptorium.plans import entities as E
from scriptorium.plans.relational import _mod_sql
from scriptorium.session import table

BUDGET = 200
SYSTEM, KEYS = "You are a careful editor.", ["chapter_title", "blocks"]


def _turns(spark, d):
    return E.turns(spark, d).withColumn("content", F.coalesce("content", F.lit("")))


def glossary_totals(spark, d):
    return glossary.totals(E.glossary(spark, d))


def glossary_lookup(spark, d):
    key = F.col("s_suppkey")
    word = F.when(key % 3 == 0, F.concat(F.lit("s"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("ALIAS "), key.cast("string")))
    mentions = table(spark, d, "supplier").select(F.coalesce(word, F.concat(F.lit("nobody "), key.cast("string"))).alias("mention"))
    return glossary.resolve(mentions, E.glossary(spark, d), "mention")


def glossary_merge(spark, d):
    entries = E.glossary(spark, d).select("category", "ord", "name", "raw", "faction")
    new = entries.where("ord % 2 = 0").withColumn("raw", F.concat(F.lit("new "), F.col("raw")))
    return glossary.merge(entries.where("ord % 3 <> 0"), new)


def glossary_budget(spark, d):
    """Entries of each category that fit a prompt of BUDGET tokens."""
    block = glossary.format_entry(F.col("name"), F.col("raw"), F.col("aliases"), F.lit(""))
    entries = E.glossary(spark, d).select("category", "ord", "name", F.lit(1).alias("rank"), F.lit("Terms").alias("heading"), block.alias("block"))
    return glossary.within_budget(entries, BUDGET, ["category"]).select("category", "name", F.col("nth").cast("bigint").alias("nth"))


def transform_differences(spark, d):
    """Transforms of unequal length, with empty and missing speakers, other speakers and other texts."""
    turns, place = _turns(spark, d), F.col("chapter") + F.col("block_index")
    first = turns.where("chapter % 4 <> 0 or block_index < 3").withColumn("speaker", F.when(F.col("block_index") % 3 == 0, "").otherwise(F.col("speaker")))
    speaker = F.when(F.col("block_index") % 3 == 0, None).when(place % 7 == 0, "other").otherwise(F.col("speaker"))
    content = F.when(place % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    second = turns.where("chapter % 5 <> 0 or block_index < 2").withColumns({"speaker": speaker, "content": content})
    return glossary.differences(first, second, ["chapter"]).withColumn("score", F.round("score", 6))


def transform_mean_score(spark, d):
    return glossary.mean_score(transform_differences(spark, d)).withColumn("mean_score", F.round("mean_score", 4))


def block_context(spark, d):
    found = corrections.with_context(_turns(spark, d))
    part = lambda side: F.get_json_object("context_json", f"$.{side}.speaker").alias(side)
    return found.select("chapter", "block_index", part("preceding"), part("following"))


def correction_counts(spark, d):
    """Transitions between the event types of each user."""
    before = F.expr("lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    log = table(spark, d, "events").select(before.alias("original_type"), F.col("event_type").alias("corrected_type"))
    return corrections.transitions(log.where("original_type <> corrected_type")).withColumn("share", F.round("share", 6))


def correction_lines(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return corrections.export_lines(rows)


def corrected_blocks(spark, d):
    blocks = _turns(spark, d).withColumns({"type": F.lit("dialogue"), "tone": F.lit(None).cast("string")})
    log = blocks.where("chapter % 3 = 0").select(
        (F.col("chapter") * 1000 + F.col("block_index")).alias("id"), "chapter", "block_index", F.lit("NARRATOR").alias("type"),
        F.lit("").alias("speaker"), F.concat(F.lit("fixed "), F.col("content")).alias("content"),
    )
    return corrections.apply_corrections(blocks, log).select("chapter", "block_index", "type", "speaker", text.source_hash(F.col("content")).alias("content_hash"), "corrected", "correction_id")


def renamed_speakers(spark, d):
    renamed = corrections.rename_speaker(E.blocks(spark, d), "s1", "Hero", any_case=True)
    return renamed.groupBy("speaker").agg(F.count("*").alias("blocks"), F.count_if("renamed").alias("renamed"))


def chapter_bodies(spark, d):
    blocks = _turns(spark, d).withColumns({"type": F.lit("dialogue"), "tone": F.lit("")})
    return render.chapter_pages(blocks).select("chapter", text.source_hash(F.col("body")).alias("body_hash"), F.col("n_blocks").cast("int").alias("n_blocks"))


def first_styles(spark, d):
    return render.style_map(E.blocks(spark, d)).select("speaker", "first_chapter", "first_block")


def chapter_manifest(spark, d):
    return render.manifest(E.chapters(spark, d), "novel_id", "chapter_index", ["filename"])


def contents_lists(spark, d):
    return render.contents_list(E.chapters(spark, d), "novel_id", "chapter_index")


def omnibus_pages(spark, d):
    pages = _turns(spark, d).select("chapter", "block_index", F.col("speaker").alias("title"), render.escape_html(F.col("content")).alias("body"))
    return render.omnibus(pages, "chapter", "block_index").select("chapter", text.source_hash(F.col("document")).alias("document_hash"))


def extraction_prompts(spark, d):
    turns = _turns(spark, d).withColumnRenamed("content", "text")
    return render.extraction_prompts(turns, "chapter", "block_index", 3).select("chapter", text.source_hash(F.col("text")).alias("text_hash"))


def transform_prompts(spark, d):
    whole = render.prompt(SYSTEM, KEYS, F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", text.source_hash(whole).alias("prompt_hash"))


def manifest_titles(spark, d):
    c = E.chapters(spark, d)
    return render.titles_from_manifest(c.select("id", "filename"), c.where("id % 2 = 0").select("filename", "title")).select("id", "shown_title")


def natural_order(spark, d):
    name = F.concat(F.lit("v"), (F.col("o_orderkey") % 7).cast("string"), F.lit("_ch"), F.col("o_orderkey").cast("string"))
    keyed = table(spark, d, "orders").select("o_orderkey", names.natural_key(F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(name)).alias("k"))
    return keyed.select("o_orderkey", "k.volume", "k.chapter")


def placeholder_records(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.coalesce("text", F.lit("")).alias("text"), F.lit("h").alias("source_hash"))
    made = state.placeholders(rows, "v1")
    return made.select("filename", "model_version", F.col("blocks")[0]["content"].alias("note"), text.source_hash(F.col("blocks")[1]["content"]).alias("kept_hash"))


def changelog(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("n"), F.count_if(F.col("value") > 99).alias("bad"))
    entry = render.changelog_entry(F.concat(F.lit("job "), F.col("user_id").cast("string")), F.col("ts"), F.col("n"), F.col("bad"), F.lit("1.0s"))
    return runs.select("user_id", entry.alias("entry"))


QUERIES = {
    f.__name__: f
    for f in (
        glossary_totals, glossary_lookup, glossary_merge, glossary_budget, transform_differences, transform_mean_score, block_context, correction_counts,
        correction_lines, corrected_blocks, renamed_speakers, chapter_bodies, first_styles, chapter_manifest, contents_lists, omnibus_pages,
        extraction_prompts, transform_prompts, manifest_titles, natural_order, placeholder_records, changelog,
    )
}

_TURNS = "t AS (SELECT conv_id AS chapter, turn AS block_index, role AS speaker, coalesce(text, '') AS content FROM conversations)"
_GLOSSARY = f"g AS ({E.GLOSSARY})"
_CHAPTERS = f"chapters AS ({E.CHAPTERS})"
_DIFFERENCES = f"""WITH {_TURNS},
 a AS (SELECT chapter, block_index, CASE WHEN block_index % 3 = 0 THEN '' ELSE speaker END AS speaker, content FROM t WHERE chapter % 4 <> 0 OR block_index < 3),
 b AS (SELECT chapter, block_index, CASE WHEN block_index % 3 = 0 THEN NULL WHEN (chapter + block_index) % 7 = 0 THEN 'other' ELSE speaker END AS speaker,
  content || CASE WHEN (chapter + block_index) % 5 = 0 THEN '!' ELSE '' END AS content FROM t WHERE chapter % 5 <> 0 OR block_index < 2),
 z AS (SELECT chapter, sum(CAST(nullif(a.speaker, '') IS DISTINCT FROM nullif(b.speaker, '') AS INT) + CAST(a.content <> b.content AS INT)) AS issues FROM a JOIN b USING (chapter, block_index) GROUP BY chapter),
 n AS (SELECT chapter, count(*) AS blocks FROM b GROUP BY chapter), c AS (SELECT DISTINCT chapter FROM (SELECT chapter FROM a UNION ALL SELECT chapter FROM b))
 SELECT chapter, CAST(coalesce(issues, 0) AS BIGINT) AS issues, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks,
 round(greatest(0.0, 1 - coalesce(issues, 0) / CAST(greatest(coalesce(blocks, 0), 1) AS DOUBLE)), 6) AS score FROM c LEFT JOIN z USING (chapter) LEFT JOIN n USING (chapter)"""
_NL = "chr(10)"


def _escaped(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        x = f"replace({x}, '{char}', '{entity}')"
    return x


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ORACLE_SQL = {
    "glossary_totals": f"WITH {_GLOSSARY} SELECT category, count(*) AS entries, grouping(category) = 1 AS is_total FROM g GROUP BY ROLLUP (category)",
    "glossary_lookup": """SELECT CASE s_suppkey % 3 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN 'ALIAS ' || s_suppkey ELSE 'nobody ' || s_suppkey END AS mention,
CASE WHEN s_suppkey % 3 < 2 THEN 'S' || s_suppkey END AS entry FROM supplier""",
    "glossary_merge": f"WITH {_GLOSSARY} SELECT category, ord, name, CASE WHEN ord % 2 = 0 THEN 'new ' || raw ELSE raw END AS raw, faction FROM g WHERE ord % 3 <> 0 OR ord % 2 = 0",
    "glossary_budget": f"""WITH {_GLOSSARY}, p AS (SELECT category, name, ord, row_number() OVER w AS nth, count(*) OVER (PARTITION BY category) AS total,
 length('- **' || name || '** (' || raw || ')' || {_NL} || '  Aliases: ' || aliases[1] || {_NL}) + CASE WHEN row_number() OVER w = 1 THEN {len(chr(10) + "### Terms" + chr(10))} ELSE 0 END AS n FROM g WINDOW w AS (PARTITION BY category ORDER BY ord)),
s AS (SELECT *, sum(n) OVER (PARTITION BY category ORDER BY ord) AS upto FROM p),
f AS (SELECT *, bool_and(({len(glossary.HEADER) + len(glossary.FOOTER) + 1} + upto + length({_NL} || '_Truncated: ' || (nth - 1) || ' of ' || total || ' entries shown._' || {_NL})) // 4 <= {BUDGET}) OVER (PARTITION BY category ORDER BY ord) AS fits FROM s)
SELECT category, name, nth FROM f WHERE fits""",
    "transform_differences": _DIFFERENCES,
    "transform_mean_score": f"SELECT coalesce(round(avg(score), 4), 0.0) AS mean_score, count(*) FILTER (score < 0.7) AS low_scores FROM ({_DIFFERENCES})",
    "block_context": f"WITH {_TURNS} SELECT chapter, block_index, lag(speaker) OVER w AS preceding, lead(speaker) OVER w AS following FROM t WINDOW w AS (PARTITION BY chapter ORDER BY block_index)",
    "correction_counts": """WITH l AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_type AS c FROM events)
SELECT upper(o) || '->' || upper(c) AS transition, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM l WHERE o <> c GROUP BY 1""",
    "correction_lines": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""",
    "corrected_blocks": f"""WITH {_TURNS} SELECT chapter, block_index, CASE WHEN chapter % 3 = 0 THEN 'narrator' ELSE 'dialogue' END AS type, CASE WHEN chapter % 3 <> 0 THEN speaker END AS speaker,
 sha256(CASE WHEN chapter % 3 = 0 THEN 'fixed ' || content ELSE content END) AS content_hash, chapter % 3 = 0 AS corrected, CASE WHEN chapter % 3 = 0 THEN chapter * 1000 + block_index END AS correction_id FROM t""",
    "renamed_speakers": f"WITH b AS ({E.BLOCKS}) SELECT CASE WHEN lower(speaker) = 's1' THEN 'Hero' ELSE speaker END AS speaker, count(*) AS blocks, count(*) FILTER (lower(speaker) = 's1') AS renamed FROM b GROUP BY 1",
    "chapter_bodies": f"""WITH {_TURNS}, h AS (SELECT chapter, block_index, '<div class="block dialogue char-' || substr(regexp_replace(md5(speaker), '^0+', ''), 1, 16) || ' ' || CASE {_mod_sql("speaker", 2)} WHEN 0 THEN 'right' ELSE 'left' END
 || '"><span class="speaker">' || {_escaped("speaker")} || '</span><p>' || {_escaped("content")} || '</p></div>' AS html FROM t)
SELECT chapter, sha256(string_agg(html, {_NL} ORDER BY block_index)) AS body_hash, CAST(count(*) AS INT) AS n_blocks FROM h GROUP BY chapter""",
    "first_styles": f"WITH b AS ({E.BLOCKS}), m AS (SELECT speaker, min({{'c': chapter, 'b': block_index}}) AS place FROM b GROUP BY speaker) SELECT speaker, place.c AS first_chapter, place.b AS first_block FROM m",
    "chapter_manifest": f"""WITH {_CHAPTERS} SELECT novel_id, '[' || string_agg('{{"chapter_index":' || chapter_index || ',"filename":"' || filename || '"}}', ',' ORDER BY chapter_index) || ']' AS chapters FROM chapters GROUP BY novel_id""",
    "contents_lists": f"""WITH {_CHAPTERS} SELECT novel_id, string_agg('<li><a href="#chapter-' || chapter_index || '">' || coalesce(title, 'Chapter ' || chapter_index) || '</a></li>', '' ORDER BY chapter_index) AS toc FROM chapters GROUP BY novel_id""",
    "omnibus_pages": f"""WITH {_TURNS} SELECT chapter, sha256('<nav><ol>' || string_agg('<li><a href="#chapter-' || block_index || '">' || {_escaped("speaker")} || '</a></li>', '' ORDER BY block_index) || '</ol></nav>' ||
 string_agg('<section id="chapter-' || block_index || '"><h2>' || {_escaped("speaker")} || '</h2>' || {_escaped("content")} || '</section>', '' ORDER BY block_index)) AS document_hash FROM t GROUP BY chapter""",
    "extraction_prompts": f"""WITH {_TURNS}, f AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY block_index) AS n FROM t)
SELECT chapter, sha256(string_agg(content, {_text(render.BREAK)} ORDER BY n)) AS text_hash FROM f WHERE n <= 3 GROUP BY chapter""",
    "transform_prompts": f"SELECT doc_id, sha256({_text(SYSTEM)} || chr(10) || chr(10) || 'Return JSON with the keys: {', '.join(KEYS)}.' || chr(10) || chr(10) || coalesce(text, '')) AS prompt_hash FROM documents",
    "manifest_titles": f"WITH {_CHAPTERS} SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN title END, 'ch ' || id) AS shown_title FROM chapters",
    "natural_order": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 7 END AS BIGINT) AS volume, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END AS BIGINT) AS chapter FROM orders",
    "placeholder_records": "SELECT CAST(doc_id AS VARCHAR) AS filename, 'v1-failed' AS model_version, 'Transformation failed for ' || doc_id AS note, sha256(coalesce(text, '')) AS kept_hash FROM documents",
    "changelog": """SELECT user_id, '## ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') || ' - job ' || user_id || chr(10) || '- processed: ' || count(*) || chr(10) || '- failed: ' || count(*) FILTER (value > 99) || chr(10) || '- duration: 1.0s' AS entry FROM events GROUP BY user_id""",
}
