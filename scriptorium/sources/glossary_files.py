"""Glossary files in YAML or JSON, read in tasks and written so that they read back the same.

A glossary is a mapping of the four categories to lists of entries (name, raw, aliases,
desc). Of YAML, what such files use is read: block and inline lists, plain and quoted
scalars, comments, null; anything else ends the job, as a file that is no JSON does.
Entries that are no mappings, or without a name or raw form, are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories in order.
CATEGORIES = ["characters", "factions", "locations", "terms"]
ENTRIES = "category string, ord int, name string, raw string, aliases array<string>, desc string"
_ROWS = "path string, " + ENTRIES
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:\[\]{},"'][^:#]*?)\s*:(?:\s+(.*))?$""")


def _scalar(text: str):
    """A scalar or an inline list; a comment behind it is dropped."""
    text = text.strip()
    if text[:1] == '"':
        value, end = json.JSONDecoder().raw_decode(text)
        rest = text[end:]
    elif text[:1] == "'":
        m = re.match(r"'((?:[^']|'')*)'", text)
        if not m:
            raise ValueError(f"a quote is not closed: {text!r}")
        value, rest = m[1].replace("''", "'"), text[m.end() :]
    elif text[:1] == "[":
        parts, rest = re.match(r"""\[((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\]"'])*)\](.*)$""", text, re.S).groups() if "]" in text else (None, "")
        if parts is None:
            raise ValueError(f"a list is not closed: {text!r}")
        value = [_scalar(p) for p in re.findall(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,"'])+""", parts) if p.strip()]
    else:
        plain = re.split(r"(?:^|\s)#", text, maxsplit=1)[0].strip()
        if plain[:1] in tuple("{}&*!|>%@`"):
            raise ValueError(f"not read: {text!r}")
        return None if plain in ("", "~", "null") else plain
    if rest.strip() and not rest.strip().startswith("#"):
        raise ValueError(f"text behind a value: {text!r}")
    return value


def parse_yaml(text: str) -> dict[str, list]:
    """The mapping of a glossary in YAML."""
    out: dict[str, list] = {}
    entries, entry, names, deep = None, None, None, -1
    for line in text.replace("\t", "    ").splitlines():
        body = line.strip()
        if not body or body.startswith("#") or body in ("---", "..."):
            continue
        indent = len(line) - len(line.lstrip(" "))
        item = body == "-" or body.startswith("- ")
        if names is not None and item and indent > deep:  # a block list of an entry's field
            names.append(_scalar(body[1:]))
            continue
        names = None
        if item:
            if entries is None:
                raise ValueError(f"an entry outside of a category: {line!r}")
            body, deep, entry = body[1:].strip(), indent, {}
            if not (m := _KEY.match(body)):
                entries.append(_scalar(body))  # no mapping
                entry = None
                continue
            entries.append(entry)
        elif not (m := _KEY.match(body)):
            raise ValueError(f"neither an entry nor a field: {line!r}")
        key = _scalar(m[1])
        if not item and indent == 0:
            value = _scalar(m[2] or "")
            if value not in (None, []) and not isinstance(value, list):
                raise ValueError(f"a category is no list: {line!r}")
            entries, entry, deep = out.setdefault(key, value or []), None, -1
        elif entry is None:
            raise ValueError(f"a field outside of an entry: {line!r}")
        else:
            entry[key] = _scalar(m[2] or "")
            if entry[key] is None:
                names = entry[key] = []
                if key != "aliases":
                    names, entry[key] = None, None
    return out


def _rows(path: str, text: str) -> Iterator[dict]:
    stripped = text.lstrip("﻿ \r\n\t")
    found = json.loads(text) if stripped.startswith("{") else parse_yaml(text)
    for category in CATEGORIES:
        for n, one in enumerate(found.get(category) or []):
            sound = isinstance(one, dict) and isinstance(one.get("name"), str) and isinstance(one.get("raw"), str) and one["name"]
            names = one.get("aliases") or [] if sound else None
            if sound and isinstance(names, list) and all(isinstance(a, str) for a in names):
                yield {"path": path, "category": category, "ord": n, "name": one["name"], "raw": one["raw"], "aliases": names, "desc": one.get("desc")}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, ord, name, raw, aliases, desc) of the glossary files at ``path``; each
    file is parsed by the task that reads it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    schema = pa.schema([("path", pa.string()), ("category", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("raw", pa.string()), ("aliases", pa.list_(pa.string())), ("desc", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(*(batch.column(c).to_pylist() for c in ("path", "value")), strict=True):
                yield pa.RecordBatch.from_pylist(list(_rows(file, text or "")), schema=schema)

    return files.mapInArrow(run, _ROWS)


def _quoted(x: Column) -> Column:
    """A string in JSON, which is one in YAML, too."""
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


def _entry(kind: str) -> Column:
    names = F.coalesce("aliases", F.array().cast("array<string>"))
    fields = {"name": _quoted(F.col("name")), "raw": _quoted(F.col("raw")), "aliases": F.to_json(names), "desc": F.coalesce(_quoted(F.col("desc")), F.lit("null"))}
    fields["desc"] = F.when(F.col("desc").isNull(), "null").otherwise(fields["desc"])
    if kind == "json":
        return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]), F.lit("}"))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{'- ' if k == 'name' else '  '}{k}: "), v) for k, v in fields.items()])


def write(entries: DataFrame, path: str, kind: str = "yaml") -> None:
    """``entries(category, ord, name, raw, aliases, desc)`` as one glossary file in the folder
    ``path``, all four categories in order; what it replaces goes as a whole."""
    if kind not in ("yaml", "json"):
        raise ValueError(f"unknown kind of glossary: {kind}")
    every = entries.sparkSession.createDataFrame([(c, n) for n, c in enumerate(CATEGORIES)], "category string, place int")
    lines = entries.select("category", F.struct("ord", "name", _entry(kind).alias("text")).alias("e"))
    lists = every.join(lines, "category", "left").groupBy("place", "category").agg(F.array_sort(F.collect_list("e")).alias("e"))
    texts = F.transform("e", lambda e: e["text"])
    if kind == "json":
        one = F.concat(_quoted(F.col("category")), F.lit(": ["), F.array_join(texts, ",\n"), F.lit("]"))
        whole = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))), lambda r: r["t"]), ",\n"), F.lit("}"))
    else:
        one = F.when(F.size("e") == 0, F.concat("category", F.lit(": []"))).otherwise(F.concat("category", F.lit(":\n"), F.array_join(texts, "\n")))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))), lambda r: r["t"]), "\n")
    lists.agg(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)
