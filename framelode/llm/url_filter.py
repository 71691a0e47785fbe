"""URL filters by host-suffix and path-prefix expressions.

A rule names a host, with all its subdomains, and the beginning of a path. Each URL is expanded into
those of its host's suffixes and its path's prefixes that have the length of some rule's, so that
neither a long path nor a host of many labels makes more expressions than there are lengths. An
expression's digest has a short prefix, by which it meets the rules; the full digest then says
whether they are the same, and the longest of a URL's rules decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, table, written

#: Hex digits of a digest by which expressions and rules meet; most bytes of rules that are broadcast.
SHORT, SENT = 8, 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path: then up to
    ``?``, ``#`` or the end. Both are empty of a null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def prepared(rules: DataFrame) -> DataFrame:
    """(short, digest, rule, order, verdict) of rules (host, path, verdict): one for each expression, ``block`` before
    ``allow``. ``order`` grows with precedence: the longer expression, then the longer host."""
    whole = rules.where("host is not null and path is not null and verdict in ('block', 'allow') and (path = '' or path like '/%')")
    whole = whole.withColumn("host", F.translate("host", _UPPER, _LOWER)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    digest = F.sha2(rule, 256)
    return whole.select(F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"), rule.alias("rule"), F.struct(F.length(rule).alias("length"), F.length("host").alias("host")).alias("order"), "verdict")


def expressions(host: Column, path: Column, hosts: list[int], paths: list[int]) -> Column:
    """Suffixes of ``host`` that are whole labels, each with prefixes of ``path``, of these lengths."""
    n, m = F.length(host), F.length(path)
    suffix = F.filter(F.array(*map(F.lit, hosts)), lambda x: (x == n) | ((x < n) & (F.substring(host, n - x, F.lit(1)) == ".")))
    prefix = F.filter(F.array(*map(F.lit, paths)), lambda x: x <= m)
    return F.flatten(F.transform(suffix, lambda x: F.transform(prefix, lambda y: F.concat(F.substring(host, n - x + 1, x), F.substring(path, F.lit(1), y)))))


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", sent: int = SENT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A rule fits a URL whose host is its own or a subdomain and whose path begins with its path; of
    several, the longest counts, then that of the longer host; a rule given twice with both verdicts
    blocks. A rule with a null, another verdict, or a path without a leading ``/`` is no rule. A URL that
    none fits, such as a null one, has a null rule and ``otherwise``. Repeated rows and null ids are rows of
    their own; very long URLs are read whole; other columns are not read; no rows give no rows.

    Rules of at most ``sent`` bytes, with their digests, are broadcast. More meet the expressions by short digest, the frequent ones,
    with or without a rule, by broadcast. The driver gets the rules' distinct lengths.
    """
    found = written(prepared(rules))
    hosts, paths = (sorted(r[0] for r in found.select(c).distinct().collect()) for c in (F.col("order.host"), F.col("order.length") - F.col("order.host")))
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = written(pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path")))
    if not hosts:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    asked = rows.select("row", F.explode(expressions(F.col("host"), F.col("path"), hosts, paths)).alias("e")).select("row", F.sha2("e", 256).alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    if found.agg(F.sum(F.octet_length("rule") + 128)).first()[0] <= sent:
        met = asked.join(F.broadcast(found), "short")
    else:
        of_short = found.groupBy("short").agg(F.collect_list(F.struct("digest", "rule", "order", "verdict")).alias("rules"))
        counted = asked.groupBy("short").agg(F.count("*").alias("_n")).join(of_short, "short", "left")
        met = by_group(asked, counted, ["short"]).select("row", "full", F.explode("rules").alias("x")).select("row", "full", "x.*")
    best = met.where("full = digest").groupBy("row").agg(F.max(F.struct("order", "rule", "verdict")).alias("x")).select("row", "x.rule", "x.verdict")
    return rows.join(best, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP12_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN LATERAL (
  SELECT host || path AS rule, verdict FROM rules WHERE (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  ORDER BY length(host || path) DESC, length(host) DESC LIMIT 1) r ON true
"""
