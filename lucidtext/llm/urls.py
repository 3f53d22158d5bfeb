"""URL filter with redirect equivalence.

Rules decide the urls they fit, the longest first. Pages that redirect (meta refresh)
or name a canonical url are linked with the target; connected components over these
links carry a block from one alias to all others that no rule fits. Allow takes
precedence: a url that an allow rule fits stays allowed whatever its aliases are, and
only urls without a rule of their own take the verdict of their component.

Null urls, and those without "://", have no host and no path and fit no rule; they
are allowed. Null html names no target. Rows that repeat are judged each alike; pages
without any link are each their own component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from .components import components

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?i)<(?:link|meta)\s[^>]*>"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; written out, it would be compiled at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matched(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(len, rule, verdict) of the longest rule that fits, else null."""
    given = F.array(*(F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit("." + h).alias("sub"), F.lit(p).alias("p")) for v, h, p in rules))
    fits = lambda u: F.filter(given, lambda r: ((u["h"] == r["h"]) | u["h"].endswith(r["sub"])) & u["p"].startswith(r["p"]))
    return _let(F.struct(host.alias("h"), path.alias("p")), lambda u: F.array_max(fits(u)))


def node(url: Column) -> Column:
    """What stands for a url among aliases: scheme and host in lower case, no fragment."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def _resolved(target: Column, url: Column) -> Column:
    """An absolute url for what an attribute names."""
    given = F.struct(
        F.replace(F.trim(target), F.lit("&amp;"), F.lit("&")).alias("to"),
        F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1).alias("origin"),
        F.regexp_extract(url, r"(?s)^(.*?:)//", 1).alias("scheme"),
        F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1).alias("folder"),
    )
    return _let(
        given,
        lambda x: F.when(x["to"] == "", F.lit(None))
        .when(x["to"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x["to"])
        .when(x["to"].startswith("//"), F.concat(x["scheme"], x["to"]))
        .when(x["to"].startswith("/"), F.concat(x["origin"], x["to"]))
        .when(x["to"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^[#?]"), F.lit(None))
        .otherwise(F.concat(x["folder"], F.when(x["folder"].endswith("/"), F.lit("")).otherwise(F.lit("/")), x["to"])),
    )


def links(pages: DataFrame) -> DataFrame:
    """a, b: urls linked by a canonical link or a redirect in a page's html. ``pages`` has url and html."""
    tags = pages.where(F.col("url").contains("://") & F.col("html").isNotNull()).select("url", F.explode(F.expr(f"regexp_extract_all(html, r'{_TAG}', 0)")).alias("tag"))
    value = lambda name: F.coalesce(*(F.when(F.col("tag").rlike(p), F.regexp_extract("tag", p, 1)) for p in (rf'(?is)\s{name}\s*=\s*"([^"]*)"', rf"(?is)\s{name}\s*=\s*'([^']*)'", rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)")))
    canonical = F.when(F.lower(F.trim(value("rel"))) == "canonical", value("href"))
    refresh = F.when(F.lower(F.trim(value("http-equiv"))) == "refresh", F.regexp_extract(value("content"), r"(?is)url\s*=\s*['\"]?([^'\"\s>]+)", 1))
    target = _resolved(F.coalesce(canonical, refresh), F.col("url"))
    return tags.select(node(F.col("url")).alias("a"), node(target).alias("b")).where("b <> '' AND a <> b")


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component of each row of ``pages`` (page_id, url, html)."""
    edges = links(pages.select("url", "html"))
    rows = pages.select("page_id", "url").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node")).withColumn("m", matched(F.col("host"), F.col("path"), rules))
    comp = components(edges, "a", "b")
    # targets needn't be pages themselves: rules judge every url of a component
    nodes = comp.withColumn("m", matched(host(F.col("node")), path(F.col("node")), rules))
    blocked = nodes.groupBy("component").agg(F.max(F.col("m.verdict").eqNullSafe("block")).alias("blocked"))
    aliases = comp.join(blocked, "component").select(F.col("node").alias("alias"), "component", "blocked")
    own = F.col("m.verdict")
    return rows.join(aliases, F.col("node") == F.col("alias"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("m.rule").alias("rule"),
        F.coalesce(own, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "component",
    )


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page row. Null urls have neither host nor path and are allowed; of rules equally long none can fit the same url; repeated rows get the same verdict; without pages no rows."""
    return judged(table(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_HOST_SQL = r"translate(regexp_extract(coalesce({u}, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH_SQL = r"regexp_extract(coalesce({u}, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_NODE_SQL = r"translate(regexp_extract({u}, '^((?s:.*?)://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^#]*)', 1)"
#: Reachability by recursion. It reads canonical links and refreshes with absolute urls in double quotes; these are all that the tables may hold.
ORACLE = f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {_RULES_SQL}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM pages WHERE url LIKE '%://%'),
named AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)\\srel\\s*=\\s*"canonical"') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*"([^"]*)"', 1)
  WHEN regexp_matches(tag, '(?i)\\shttp-equiv\\s*=\\s*"refresh"') THEN regexp_extract(tag, '(?i)url\\s*=\\s*([^"\\s>]+)', 1) END AS target FROM tags),
e AS (SELECT DISTINCT {_NODE_SQL.format(u='url')} AS a, {_NODE_SQL.format(u='target')} AS b FROM named WHERE target LIKE '%://%'),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS root, a AS n FROM two UNION SELECT root, b FROM reach JOIN two ON n = two.a),
comp AS (SELECT n, min(root) AS component FROM reach GROUP BY n),
fit AS (SELECT n, component, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC) AS r FROM comp JOIN rules
  ON ({_HOST_SQL.format(u='n')} = h OR ends_with({_HOST_SQL.format(u='n')}, '.' || h)) AND starts_with({_PATH_SQL.format(u='n')}, p)),
bad AS (SELECT DISTINCT component FROM fit WHERE r = 1 AND v = 'block'),
pg AS (SELECT row_number() OVER () AS k, page_id, {_HOST_SQL.format(u='url')} AS host, {_PATH_SQL.format(u='url')} AS path, {_NODE_SQL.format(u='url')} AS node FROM pages),
own AS (SELECT k, v, h || p AS rule, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC) AS r FROM pg JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, own.rule AS rule, coalesce(own.v, CASE WHEN bad.component IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, comp.component AS component
FROM pg LEFT JOIN own ON pg.k = own.k AND own.r = 1 LEFT JOIN comp ON pg.node = comp.n LEFT JOIN bad ON comp.component = bad.component
"""
