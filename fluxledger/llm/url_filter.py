r"""URL filters by token-indexed pattern rules (operator 8, DataFrame functions only).

A rule is a regular expression over ``host + path`` with an action. Each rule is indexed under
its rarest literal token (tokens counted over all URLs), a URL's own tokens fetch candidate
rules, and only those run their regular expressions; of those that match the longest rule wins
(ties: block before allow, then the rule's text). Rules without a literal token are candidates
of every URL. The index is broadcast only while its row count is under `broadcast_rules`;
beyond that the join shuffles by token and adaptive execution splits common tokens.

Defined results: a null URL or one without ``://`` has empty host and path and matches no rule
that names a host; rows with equal page_id stay separate rows; long URLs are judged whole; columns named
host, path, rule, verdict or _tokens are replaced, all others pass through; an empty table gives no rows, and
without rules every verdict is the default.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _UPPER, load, written

#: (action, rule); a rule is host + path prefix, `*` in the path stands for any run of characters.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def rule_regex(rule: str) -> str:
    host, _, path = rule.partition("/")
    path = ".*".join(re.escape(p) for p in ("/" + path).split("*"))
    return rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{path}"


def rule_tokens(rule: str) -> list[str]:
    """Literal tokens that every matching URL has: host labels and whole path segments."""
    host, _, path = rule.partition("/")
    labels = [f"h:{x}" for x in host.split(".") if x]
    whole = path.split("/")[:-1]  # what follows the last slash may go on
    return list(dict.fromkeys(labels + [f"p:{x}" for x in whole if x and "*" not in x])) or [""]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    whole = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, F.transform(whole, lambda x: F.concat(F.lit("p:"), x))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", default: str = "allow", broadcast_rules: int = 50_000) -> DataFrame:
    """Adds host, path, rule (null where none fits) and verdict to every row of `pages`."""
    spark = pages.sparkSession
    clash = [c for c in ("host", "path", "rule", "verdict", "_tokens") if c in pages.columns]
    rows = pages.drop(*clash)
    host, path = host_path(F.col(url_col))
    rows = rows.withColumn("host", host).withColumn("path", path)
    table = spark.createDataFrame([(r, a, rule_regex(r), rule_tokens(r)) for a, r in rules], "rule string, action string, regex string, tokens array<string>")
    fits = len(rules) <= broadcast_rules
    sized = (lambda df: F.broadcast(df)) if fits else (lambda df: df)
    # rarity of the rules' own tokens over all URLs
    asked = table.select(F.explode("tokens").alias("token")).distinct()
    seen = rows.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(sized(asked), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rare = table.select("rule", "action", "regex", F.explode("tokens").alias("token")).join(seen, "token", "left")
    index = rare.groupBy("rule", "action", "regex").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    # candidates by token, regular expressions on these alone, the best rule per distinct host and path
    target = F.concat("host", "path")
    urls = rows.select("host", "path").distinct()
    hits = urls.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(sized(index), "token").where(F.rlike(target, F.col("regex")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.when(F.col("action") == "block", 1).otherwise(0).alias("b"), "rule", "action")).alias("best"))
    best = written(best, "url-verdicts")  # a table, so that Spark can split the rows of a hot URL in the join
    out = rows.join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.col("best.rule")).withColumn("verdict", F.coalesce("best.action", F.lit(default))).drop("best")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r
), rules(rule, rhost, rpath, action) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT h.page_id, h.host, h.path, rules.rule, rules.action,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(rules.rule) DESC) AS n
  FROM h LEFT JOIN rules ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""
