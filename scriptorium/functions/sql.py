"""The library's functions under names that SQL texts can use.

``register`` makes temporary SQL functions of a session out of expressions, so a query text
gets the same plan as the Python form: no Python worker, and the optimiser sees through.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from scriptorium.functions import text


def _cleaned() -> str:
    """``text.clean_text`` step by step."""
    x = f"translate(coalesce(t, ''), '{text.CURLY}', '{text.STRAIGHT}')".replace("''')", "\\'\\'')")
    for pattern, to in ((text.URL, ""), (text.NOTE, ""), (text.WATERMARK, "")):
        x = f'regexp_replace({x}, r"{pattern}", "{to}")'
    x = rf'regexp_replace({x}, r"\r\n|\r", "\n")'
    x = rf'regexp_replace({x}, r"[ \t]+", " ")'
    x = rf'regexp_replace({x}, r"\n{{3,}}", "\n\n")'
    x = rf'regexp_replace({x}, r"(?dmU)^[^\S\n]+|[^\S\n]+$", "")'
    return rf'regexp_replace({x}, r"^\n+|\n+$", "")'


def _hash_mod() -> str:
    """MD5 as a number modulo m, in chunks of 32 bits."""
    acc = "0L"
    for i in range(4):
        acc = f"(({acc} * 4294967296 + cast(conv(substring(md5(cast(x AS binary)), {1 + 8 * i}, 8), 16, 10) AS decimal(20, 0))) % m)"
    return f"cast({acc} AS bigint)"


#: Name, parameters, result, body.
FUNCTIONS = [
    ("stable_hash_mod", "x STRING, m BIGINT", "BIGINT", _hash_mod()),
    ("clean_text", "t STRING", "STRING", _cleaned()),
    ("token_estimate", "t STRING", "BIGINT", "cast(floor(length(t) / 4) AS bigint)"),
    ("word_count", "t STRING", "BIGINT", r'cast(regexp_count(t, r"(?U)\S+") AS bigint)'),
    ("paragraph_count", "t STRING", "BIGINT", r'cast(regexp_count(t, r"(?U)\S[^\n]*") AS bigint)'),
    ("source_hash", "t STRING", "STRING", "sha2(cast(t AS binary), 256)"),
]

#: Lines of a text, numbered from 0, as a table.
TABLE_FUNCTIONS = [
    ("text_lines", "t STRING", "TABLE (line_no INT, line STRING)", r'SELECT pos AS line_no, col AS line FROM posexplode(split(t, "\n"))'),
    ("text_paragraphs", "t STRING", "TABLE (paragraph_no INT, paragraph STRING)", r'SELECT pos, col FROM posexplode(filter(split(t, "\n"), p -> regexp_count(p, r"(?U)\S") > 0))'),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL and returns their names."""
    for name, parameters, result, body in [*FUNCTIONS, *TABLE_FUNCTIONS]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in [*FUNCTIONS, *TABLE_FUNCTIONS]]
