"""Glossary files: what is read of YAML and JSON, and that a written one reads back the same."""

import pytest

from scriptorium.sources import glossary_files as G
from scriptorium.sources import scripts

YAML = """# names of the first volume
characters:
  - name: Klein Moretti
    raw: "克莱恩"   # hero
    aliases: [Sherlock, "The, Fool", 'it''s']
    desc: a seer
  - name: 'Audrey'
    raw: 奥黛丽
    aliases:
      - Miss Justice
      - "A # B"
  - just words
  - raw: no name
factions:
- name: Nighthawks
  raw: 值夜者
  desc:
locations: []
terms:
"""
WANT = [
    ("characters", 0, "Klein Moretti", "克莱恩", ["Sherlock", "The, Fool", "it's"], "a seer"),
    ("characters", 1, "Audrey", "奥黛丽", ["Miss Justice", "A # B"], None),
    ("factions", 0, "Nighthawks", "值夜者", [], None),
]


def rows(df):
    return sorted(tuple(r) for r in df.select("category", "ord", "name", "raw", "aliases", "desc").collect())


def test_yaml_is_read(spark, tmp_path):
    (tmp_path / "glossary.yaml").write_text(YAML)
    assert rows(G.read(spark, f"{tmp_path}/glossary.yaml")) == WANT
    assert rows(scripts.glossary_entries(spark, f"{tmp_path}/glossary.yaml")) == WANT


@pytest.mark.parametrize("kind", ["yaml", "json"])
def test_a_written_glossary_reads_back(spark, tmp_path, kind):
    odd = [("terms", 0, 'q " \\ x', "line\nbreak", ["a, b", "[c]", "#d", "e: f"], "- dash: yes"), ("terms", 1, "null", "~", ["null"], ""), ("factions", 0, "F", " spaced ", [], None)]
    entries = spark.createDataFrame(WANT[:2] + odd, G.ENTRIES)
    G.write(entries, f"{tmp_path}/g", kind)
    assert rows(G.read(spark, f"{tmp_path}/g")) == rows(entries)
    G.write(G.read(spark, f"{tmp_path}/g").drop("path"), f"{tmp_path}/again", kind)
    assert rows(G.read(spark, f"{tmp_path}/again")) == rows(entries)
    G.write(entries.limit(0), f"{tmp_path}/none", kind)
    assert G.read(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("text", ["characters: {a: b}", "characters:\n  - name: 'open", "{broken", "characters: word", "  name: outside", "characters:\n- name: [a"])
def test_broken_files_end_the_job(spark, tmp_path, text):
    (tmp_path / "g.yaml").write_text(text)
    with pytest.raises(Exception, match="(?i)ValueError|JSONDecodeError"):
        G.read(spark, f"{tmp_path}/g.yaml").collect()
    with pytest.raises(ValueError, match="unknown kind"):
        G.write(spark.createDataFrame([], G.ENTRIES), f"{tmp_path}/x", "toml")
