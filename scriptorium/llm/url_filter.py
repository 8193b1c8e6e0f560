"""URL rules whose block decisions spread over redirect and canonical-link aliases.

A rule is (host, path prefix, verdict). It fits its host and all subdomains where the
url's path starts with the rule's; the longest fitting rule decides. Urls without a rule
take the decision of their aliases: two urls are aliases if redirects, canonical links or
refresh headers connect them in any number of steps. A component with a blocked member
blocks its members, but a member that has an allow rule of its own stays allowed
(explicit allow precedence); all else is allowed.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule
and has no aliases; a fragment does not make another url; null html has no links; repeated
pages are judged alike, one row each; an empty table gives an empty result; only page_id,
url and html are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.components import connected_components
from scriptorium.session import table

#: The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Longer rule lists are matched by joins on host suffixes, not in one expression.
INLINE_RULES = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z are lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a graph node: scheme and host lower-cased, no fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` (host and path of the longest fitting one) and ``decided`` to ``urls(host, path, ...)``."""
    longest = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    if len(rules) <= INLINE_RULES:
        name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(longest):
            fits = _fits(F.col("host"), F.col("path"), r)
            name, verdict = F.when(fits, r[0] + r[1]).otherwise(name), F.when(fits, r[2]).otherwise(verdict)
        return urls.withColumns({"rule": name, "decided": verdict})
    ranked = urls.sparkSession.createDataFrame(
        [(n, *r) for n, r in enumerate(longest)], "rank int, rule_host string, rule_path string, verdict string"
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = urls.select("host", "path").distinct()
    best = (
        distinct.select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(ranked, "rule_host")
        .where(F.startswith("path", F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("decided")), "rank").alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "best.rule", "best.decided")


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps; those above the root are left out."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(F.array_append(acc, s)))
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), whole).otherwise(path)


def _absolute(base: Column, target: Column) -> Column:
    """A link's target as seen from its page; null if it has none. ``&amp;`` stands for ``&``; a
    target of a query alone keeps the page's path, one of a fragment alone is the page."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    page, rest = F.regexp_extract(base, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?):", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(path == "", F.concat(page, rest))
        .when(F.startswith(target, F.lit("/")), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v) of each page's canonical links and refreshes, as graph nodes."""
    tag = F.col("tag")
    href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    target = F.when(tag.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""), href).when(
        tag.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), refresh
    )
    tags = pages.where(F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b")).select(
        "url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag")
    )
    found = tags.select(node_of(F.col("url")).alias("u"), node_of(_absolute(F.col("url"), target)).alias("v"))
    return found.where("u is not null and v is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages(page_id, url, html)``.

    ``redirects(source_url, target_url)``: observed redirects, further edges.
    """
    edges = link_edges(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("source_url")).alias("u"), node_of(F.col("target_url")).alias("v"))
        edges = edges.unionAll(more.where("u is not null and v is not null"))
    members = connected_components(edges)
    judged = with_rules(members.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    blocked = judged.where("decided = 'block'").select("component").distinct()
    aliases = members.join(blocked, "component", "left_semi").select("node")
    url = F.col("url")
    own = with_rules(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), rules)
    return own.join(aliases.withColumn("spread", F.lit("block")), "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decided", "spread", F.lit("allow")).alias("verdict")
    )


def op10_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the fixed rules and its aliases."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


def _rule_sql(node: str) -> tuple[str, str]:
    host = f"translate(regexp_extract({node}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract({node}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    return host, path


def _decide_sql(column: int) -> str:
    cases = "".join(
        f" WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{r[0] + r[1] if column == 0 else r[2]}'"
        for r in sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
    )
    return f"CASE{cases} END"


def _node_sql(url: str) -> str:
    return (
        f"CASE WHEN contains({url}, '://') THEN translate(regexp_extract({url}, '^(.*?)://', 1, 's'), '{UPPER}', '{LOWER}') || '://' || "
        f"{_rule_sql(url)[0]} || regexp_extract({url}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"
    )


ORACLE_SQL = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '<(?:link|meta)\\b[^>]*>', 0, 'is')) AS tag FROM pages
), targets AS (
  SELECT url, CASE WHEN regexp_matches(tag, '^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b', 'is')
      THEN regexp_extract(tag, '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')
    WHEN regexp_matches(tag, '^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b', 'is')
      THEN regexp_extract(tag, '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') END AS target FROM tags
), absolute AS (
  SELECT url, CASE WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?):', 1, 's') || ':' || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || target
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*([^?#]*/)', 1, 's'), ''), '/') || target END AS target
  FROM targets WHERE coalesce(trim(target), '') <> ''
), edges AS (
  SELECT {_node_sql("url")} AS u, {_node_sql("target")} AS v FROM absolute
), both_ways AS (
  SELECT u, v FROM edges WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v
  UNION SELECT v, u FROM edges WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v
), nodes AS (
  SELECT DISTINCT u AS node, {_rule_sql("u")[0]} AS host, {_rule_sql("u")[1]} AS path FROM both_ways
), blocked AS (
  SELECT node FROM nodes WHERE {_decide_sql(1)} = 'block'
  UNION SELECT v FROM blocked JOIN both_ways ON node = u
), own AS (
  SELECT page_id, coalesce({_rule_sql("url")[0]}, '') AS host, coalesce({_rule_sql("url")[1]}, '') AS path, {_node_sql("url")} AS node FROM pages
)
SELECT page_id, host, path, {_decide_sql(0)} AS rule,
  coalesce({_decide_sql(1)}, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM own
"""
